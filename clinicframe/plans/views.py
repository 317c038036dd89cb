"""The named views of the clinic, ready for ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clinicframe.model import Clinic
from clinicframe.operators.access import ROLE_VIEWS
from clinicframe.operators.encryption import patients_decrypted, payments_decrypted
from clinicframe.sources.tables import register_tables


def clinic_views(clinic: Clinic, key: str | bytes | None = None) -> dict[str, DataFrame]:
    """The role views, and the decrypted views where a key is given."""
    views = {name: view(clinic) for name, view in ROLE_VIEWS.values()}
    if key is not None:
        views["v_patients_decrypted"] = patients_decrypted(clinic, key)
        views["v_payments_decrypted"] = payments_decrypted(clinic, key)
    return views


def create_views(clinic: Clinic, key: str | bytes | None = None) -> list[str]:
    """Register base tables and views with the session and return the view names."""
    register_tables(clinic)
    views = clinic_views(clinic, key)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)
