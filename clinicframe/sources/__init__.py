"""Readers, writers and snapshots of the clinic tables."""
