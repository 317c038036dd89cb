"""Fixed schemas, domains, keys and references of the clinic tables.

Key columns are BIGINT: the row counts this library is meant for do not fit a
32-bit counter. Every other type follows the clinic's own table definitions.
"""

from __future__ import annotations

from pyspark.sql import types as T

LONG = T.LongType()
INT = T.IntegerType()
TEXT = T.StringType()
WHEN = T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)
READING = T.DecimalType(5, 2)


def _struct(*fields: tuple, stamped: bool = True) -> T.StructType:
    """Build a schema from ``(name, type)`` or ``(name, type, nullable)``."""
    made = [T.StructField(f[0], f[1], f[2] if len(f) > 2 else False) for f in fields]
    if stamped:
        made += [T.StructField("created_at", WHEN, False), T.StructField("updated_at", WHEN, False)]
    return T.StructType(made)


TABLES: dict[str, T.StructType] = {
    "clinic_patients": _struct(
        ("patient_id", TEXT), ("first_name", TEXT), ("last_name", TEXT), ("age", INT), ("sex", TEXT),
        ("address", TEXT, True), ("contact", TEXT, True), ("registered_at", WHEN, True),
    ),
    "lab_test_catalog": _struct(
        ("test_id", LONG), ("test_name", TEXT), ("price", MONEY), ("description", TEXT, True),
    ),
    "lab_test": _struct(
        ("order_id", LONG), ("patient_id", TEXT), ("test_id", LONG), ("order_date", T.DateType()), ("status", TEXT),
    ),
    "cbc": _struct(
        ("cbc_id", LONG), ("order_id", LONG),
        ("wbc", READING, True), ("rbc", READING, True), ("hemoglobin", READING, True), ("hematocrit", READING, True),
        ("platelets", INT, True), ("mcv", INT, True), ("mch", INT, True),
        ("neutrophils", READING, True), ("lymphocytes", READING, True), ("monocytes", READING, True),
        ("eosinophils", READING, True), ("basophils", READING, True),
    ),
    "urinalysis": _struct(
        ("ua_id", LONG), ("order_id", LONG), ("appearance", TEXT, True), ("color", TEXT, True),
        ("ph", T.DecimalType(3, 1), True), ("specific_gravity", T.DecimalType(4, 3), True),
        ("glucose", TEXT, True), ("protein", TEXT, True), ("ketones", TEXT, True), ("nitrites", TEXT, True),
        ("other_findings", TEXT, True),
    ),
    "fecalysis": _struct(
        ("fa_id", LONG), ("order_id", LONG), ("appearance", TEXT, True), ("consistency", TEXT, True),
        ("occult_blood", TEXT, True), ("parasite_id", TEXT, True), ("wbc", TEXT, True), ("rbc", TEXT, True),
        ("bacteria", TEXT, True), ("other_findings", TEXT, True),
    ),
    "payments": _struct(
        ("payment_id", LONG), ("order_id", LONG), ("amount_paid", MONEY), ("payment_method", TEXT),
        ("payment_date", WHEN), ("receipt_number", TEXT, True), ("status", TEXT),
    ),
    "app_users": _struct(
        ("user_id", LONG), ("username", TEXT), ("password_hash", TEXT), ("role_name", TEXT),
        ("patient_id", TEXT, True), ("mysql_username", TEXT), ("is_active", T.BooleanType()),
    ),
}

# Parents come before children, so loading in this order never breaks a reference.
LOAD_ORDER = ("lab_test_catalog", "clinic_patients", "lab_test", "cbc", "urinalysis", "fecalysis", "payments", "app_users")

PRIMARY_KEY = {
    "clinic_patients": "patient_id", "lab_test_catalog": "test_id", "lab_test": "order_id", "cbc": "cbc_id",
    "urinalysis": "ua_id", "fecalysis": "fa_id", "payments": "payment_id", "app_users": "user_id",
}
# The key by whose ranges stored tables are cut into files.
CLUSTER_KEY = {**PRIMARY_KEY, "cbc": "order_id", "urinalysis": "order_id", "fecalysis": "order_id", "payments": "order_id"}
UNIQUE_KEYS = {
    "clinic_patients": ("contact",), "lab_test_catalog": ("test_name",), "lab_test": (), "cbc": ("order_id",),
    "urinalysis": ("order_id",), "fecalysis": ("order_id",), "payments": ("receipt_number",),
    "app_users": ("username", "patient_id"),
}
# (child table, child column, parent table): the parent column has the same name.
REFERENCES = (
    ("lab_test", "patient_id", "clinic_patients"),
    ("lab_test", "test_id", "lab_test_catalog"),
    ("cbc", "order_id", "lab_test"),
    ("urinalysis", "order_id", "lab_test"),
    ("fecalysis", "order_id", "lab_test"),
    ("payments", "order_id", "lab_test"),
    ("app_users", "patient_id", "clinic_patients"),
)

# Enumerated domains, in declaration order (this order is also the sort order).
ORDER_STATUS = ("PENDING", "COMPLETED", "CANCELLED")
PAYMENT_METHOD = ("CASH", "CARD", "GCASH", "INSURANCE")
PAYMENT_STATUS = ("PAID", "PARTIAL", "REFUNDED")
ROLES = ("role_admin", "role_front_desk", "role_lab_tech", "role_doctor", "role_patient")
DOMAINS = {
    "lab_test": {"status": ORDER_STATUS},
    "payments": {"payment_method": PAYMENT_METHOD, "status": PAYMENT_STATUS},
    "app_users": {"role_name": ROLES},
}

# Longest text each column may hold.
MAX_LENGTH = {
    "clinic_patients": {"patient_id": 10, "first_name": 50, "last_name": 50, "sex": 1, "address": 150, "contact": 20},
    "lab_test_catalog": {"test_name": 50, "description": 100},
    "lab_test": {"patient_id": 10},
    "cbc": {},
    "urinalysis": {"appearance": 50, "color": 50, "glucose": 20, "protein": 20, "ketones": 20, "nitrites": 20,
                   "other_findings": 100},
    "fecalysis": {"appearance": 50, "consistency": 50, "occult_blood": 20, "parasite_id": 50, "wbc": 20, "rbc": 20,
                  "bacteria": 20, "other_findings": 100},
    "payments": {"receipt_number": 50},
    "app_users": {"username": 80, "password_hash": 255, "patient_id": 10, "mysql_username": 80},
}

# The three result panels, by the catalog name of their test.
PANEL_OF_TEST = {"CBC": "cbc", "URINALYSIS": "urinalysis", "FECALYSIS": "fecalysis"}


def panel_fields(panel: str) -> list[T.StructField]:
    """The reading columns of a panel: everything but its keys and time stamps."""
    skip = {PRIMARY_KEY[panel], "order_id", "created_at", "updated_at"}
    return [f for f in TABLES[panel].fields if f.name not in skip]
