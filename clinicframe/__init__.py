"""Clinic-records analytics expressed as Spark DataFrame jobs."""

from clinicframe.model import Clinic
from clinicframe.session import build_session

__all__ = ["Clinic", "build_session"]
