"""Role grants, what each account may do, and an audit of access requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicframe.model import Clinic
from clinicframe.operators import joins

# Fixed values: (role, object, privileges) as first granted.
GRANTS = (
    ("role_admin", "*", ("ALL",)),
    ("role_front_desk", "clinic_patients", ("SELECT", "INSERT", "UPDATE")),
    ("role_front_desk", "lab_test", ("SELECT", "INSERT", "UPDATE")),
    ("role_front_desk", "lab_test_catalog", ("SELECT",)),
    ("role_front_desk", "payments", ("SELECT", "INSERT")),
    ("role_front_desk", "v_frontdesk_dashboard", ("SELECT",)),
    ("role_lab_tech", "cbc", ("SELECT", "UPDATE")),
    ("role_lab_tech", "urinalysis", ("SELECT", "UPDATE")),
    ("role_lab_tech", "fecalysis", ("SELECT", "UPDATE")),
    ("role_lab_tech", "lab_test", ("SELECT", "UPDATE")),
    ("role_lab_tech", "v_labtech_workspace", ("SELECT",)),
    ("role_doctor", "v_doctor_clinical_view", ("SELECT",)),
    ("role_doctor", "clinic_patients", ("SELECT",)),
    ("role_patient", "v_patient_portal", ("SELECT",)),
)
# Role privileges withdrawn later.
REVOKES = (("role_lab_tech", "lab_test", ("UPDATE",)),)
# Privileges given to and withdrawn from lab accounts directly.
DIRECT = (("role_lab_tech", "lab_test_catalog", ("SELECT",)),)

ROLE_VIEWS: dict[str, tuple[str, Callable[[Clinic], DataFrame]]] = {
    "role_admin": ("v_admin_audit_log", joins.admin_audit_log),
    "role_front_desk": ("v_frontdesk_dashboard", joins.frontdesk_dashboard),
    "role_lab_tech": ("v_labtech_workspace", joins.labtech_workspace),
    "role_doctor": ("v_doctor_clinical_view", joins.doctor_clinical_view),
    "role_patient": ("v_patient_portal", joins.patient_portal),
}


Entry = tuple[str, str, tuple[str, ...]]


def _spelled_out(entries: tuple[Entry, ...]) -> list[tuple[str, str, str]]:
    return [(role, thing, privilege) for role, thing, privileges in entries for privilege in privileges]


def _relation(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    values = ", ".join(f"('{role}', '{thing}', '{privilege}')" for role, thing, privilege in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS g(role_name, object_name, privilege)")


def effective_grants(grants: DataFrame, revokes: DataFrame) -> DataFrame:
    """Grants that were not revoked; a grant given twice counts once."""
    key = ["grantee", "object_name", "privilege"]
    return grants.select(*key).distinct().join(revokes.select(*key), key, "left_anti")


def role_grants(spark: SparkSession) -> DataFrame:
    """What each role may do after the revokes. A fixed handful of rows, safe to broadcast."""
    revoked = _spelled_out(REVOKES)
    return _relation(spark, [row for row in _spelled_out(GRANTS) if row not in revoked])


def granted_to_accounts(clinic: Clinic, entries: tuple[Entry, ...]) -> DataFrame:
    """Role entries spelled out per account holding the role."""
    holders = clinic.app_users.select(F.col("mysql_username").alias("grantee"), "role_name")
    return holders.join(F.broadcast(_relation(clinic.spark, _spelled_out(entries))), "role_name").select("grantee", "object_name", "privilege")


def account_grants(clinic: Clinic) -> DataFrame:
    """Every privilege of every account once grants and revokes, by role and direct, are settled."""
    granted = granted_to_accounts(clinic, GRANTS + DIRECT)
    return effective_grants(granted, granted_to_accounts(clinic, REVOKES + DIRECT))


def user_grants(clinic: Clinic) -> DataFrame:
    """Active accounts with the privileges of their role."""
    users = clinic.app_users.filter("is_active").select("user_id", "username", "mysql_username", "role_name")
    return users.join(F.broadcast(role_grants(clinic.spark)), "role_name")


def privilege_matrix(grants: DataFrame, grantee: str) -> DataFrame:
    """The privileges of each grantee on each object, as one sorted list."""
    named = grants.groupBy(grantee, "object_name").agg(F.array_sort(F.collect_set("privilege")).alias("held"))
    return named.select(grantee, "object_name", F.array_join("held", ", ").alias("privileges")).orderBy(grantee, "object_name")


def portal_for_users(clinic: Clinic) -> DataFrame:
    """For each active patient account its own released orders, latest first.

    Accounts meet their patient first; only the orders of those patients go on.
    """
    own = clinic.app_users.filter(F.col("is_active") & (F.col("role_name") == "role_patient") & F.col("patient_id").isNotNull())
    people = clinic.clinic_patients.join(own.select("username", "patient_id"), "patient_id")
    done = clinic.lab_test.filter(F.col("status") == "COMPLETED")
    lines = joins.order_lines(clinic.with_tables(clinic_patients=people, lab_test=done), ("username", "first_name", "last_name"))
    seen = lines.orderBy("username", F.desc("order_date"), "order_id")
    return seen.select("username", "patient_id", "first_name", "last_name", "order_date", "test_name", "status")


def view_for_role(clinic: Clinic, role: str) -> DataFrame:
    """The view a role works with."""
    if role not in ROLE_VIEWS:
        raise ValueError(f"unknown role {role!r}")
    return ROLE_VIEWS[role][1](clinic)


def role_projection(clinic: Clinic) -> DataFrame:
    """Which view each role reads, and how many rows and columns it shows."""
    sizes = None
    for role, (name, view) in ROLE_VIEWS.items():
        shown = view(clinic)
        size = shown.agg(
            F.lit(role).alias("role_name"), F.lit(name).alias("object_name"), F.lit(len(shown.columns)).alias("n_columns"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        sizes = size if sizes is None else sizes.unionByName(size)
    return sizes


def access_audit(clinic: Clinic, requests: DataFrame) -> DataFrame:
    """Allow or deny every logged request (``username``, ``object_name``, ``privilege``).

    The log joins the accounts from its many side, then a fixed set of role grants.
    """
    accounts = clinic.app_users.filter("is_active").select("username", "role_name")
    held = F.broadcast(role_grants(clinic.spark).filter(F.col("object_name") != "*").withColumn("__held", F.lit(True)))
    placed = requests.join(accounts, "username", "left")
    judged = placed.join(held, ["role_name", "object_name", "privilege"], "left")
    admin = F.coalesce(F.col("role_name") == "role_admin", F.lit(False))
    decision = F.when(admin | F.col("__held").isNotNull(), "ALLOWED").otherwise("DENIED")
    return judged.select(*requests.columns, "role_name", decision.alias("decision"))
