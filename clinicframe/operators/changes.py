"""Batch inserts, updates and deletes as functions from tables to new tables.

A change never writes in place: it returns the new DataFrames, which a snapshot
commit publishes (see ``clinicframe.sources.snapshots``). ``clinicframe.operators.edits``
says the same changes as edits of the rows they touch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime
from functools import cached_property, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicframe.functions.crypto import encrypted_columns
from clinicframe.functions.text import blank_to_null, in_order, patient_code, stripped
from clinicframe.model import Clinic
from clinicframe.operators.encryption import CONTACT, with_encryption_columns
from clinicframe.operators.firstcome import one_at_a_time, taken_keys
from clinicframe.operators.keys import assign_ids, free_patient_numbers, high_water_mark, number_rows
from clinicframe.operators.quality import CHECKS, account_rules
from clinicframe.operators.skew import join_grouped
from clinicframe.schemas import PANEL_OF_TEST, PRIMARY_KEY, REFERENCES, panel_fields
from clinicframe.session import ensure_checkpoint_dir


def moment(now: datetime | None) -> Column:
    return (F.current_timestamp() if now is None else F.lit(str(now))).cast("timestamp_ntz")


def _day(as_of: date | None) -> Column:
    return F.current_date() if as_of is None else F.lit(as_of)


# Inserts


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Add the rows whose key is not present yet; a NULL key counts as absent.

    Of new rows with one key the first is added, in the order of ``order_by`` or else of all columns.
    """
    fresh = new.join(existing.select(key), key, "left_anti")
    first = F.min_by(F.struct(*new.columns), F.struct(*(order_by or new.columns)))
    named = fresh.filter(F.col(key).isNotNull()).groupBy(key).agg(first.alias("row")).select("row.*")
    added = named.unionByName(fresh.filter(F.col(key).isNull()).select(*new.columns))
    return existing.unionByName(added, allowMissingColumns=True)


def orders_by_test_name(clinic: Clinic, requests: DataFrame) -> DataFrame:
    """Resolve requested test names through the catalog; unknown tests and patients place no order."""
    tests = clinic.lab_test_catalog.select("test_id", "test_name")
    known = requests.join(clinic.clinic_patients.select("patient_id"), "patient_id", "left_semi")
    return known.join(tests, "test_name").drop("test_name")


def place_orders(
    clinic: Clinic, requests: DataFrame, order_by: Sequence[str], high_water: int | None = None, now: datetime | None = None
) -> DataFrame:
    """The order table with the requested orders added as PENDING.

    ``requests`` holds ``patient_id``, ``test_name``, ``order_date`` and the columns of ``order_by``.
    """
    last = high_water_mark(clinic.lab_test, "order_id") if high_water is None else high_water
    placed = assign_ids(orders_by_test_name(clinic, requests), "order_id", order_by, last)
    new = placed.select(
        "order_id", "patient_id", "test_id", "order_date", F.lit("PENDING").alias("status"),
        moment(now).alias("created_at"), moment(now).alias("updated_at"),
    )
    return clinic.lab_test.unionByName(new)


def refused_order_requests(clinic: Clinic, requests: DataFrame) -> DataFrame:
    """The requests that place no order, with the reason."""
    people = clinic.clinic_patients.select("patient_id", F.lit(True).alias("__person"))
    tests = clinic.lab_test_catalog.select("test_name", F.lit(True).alias("__test")).distinct()
    looked_up = requests.join(people, "patient_id", "left")
    reason = F.when(F.col("__person").isNull(), "unknown patient").when(F.col("__test").isNull(), "unknown test")
    judged = join_grouped(looked_up, tests, "test_name", "left").withColumn("reject_reason", reason)
    return judged.filter(F.col("reject_reason").isNotNull()).select(*requests.columns, "reject_reason")


class RegisteredPatients(NamedTuple):
    """The new patient table and the refused arrivals."""

    clinic_patients: DataFrame
    rejected: DataFrame


def register_patients(
    clinic: Clinic, arrivals: DataFrame, order_by: Sequence[str], key: str | bytes, now: datetime | None = None
) -> RegisteredPatients:
    """The patient table with the arrivals added: identifiers filled into gaps, contact encrypted.

    Refused with a reason: a negative age, an unknown sex, and a contact that a patient
    or an earlier accepted arrival has.
    """
    cleaned = arrivals.withColumns({c: stripped(F.coalesce(c, F.lit(""))) for c in ("sex", "contact")})
    broken = [F.when(~F.expr(rule), F.lit(f"bad {name}")) for name, rule in CHECKS["clinic_patients"].items()]
    checked = taken_keys(clinic.clinic_patients, cleaned, {"contact": "contact exists"})
    screened = checked.withColumn("reject_reason", F.coalesce(*broken, "__taken")).drop("__taken")
    decided = one_at_a_time(
        screened.filter(F.col("reject_reason").isNull()).drop("reject_reason"), {"contact": "contact repeated in batch"}, order_by
    )
    numbered = number_rows(decided.filter("accepted").select(*arrivals.columns), order_by, "rank")
    numbers = free_patient_numbers(clinic.clinic_patients, numbered.count())
    text = {c: stripped(F.coalesce(c, F.lit(""))) for c in ("first_name", "last_name", "sex", "address", "contact")}
    moments = {c: moment(now) for c in ("registered_at", "created_at", "updated_at")}
    new = numbered.join(numbers, "rank").withColumns({"patient_id": patient_code(F.col("number")), **text, **moments})
    existing = with_encryption_columns(clinic.clinic_patients, CONTACT)
    plain = [c for c in existing.columns if c not in CONTACT.stored]
    rejected = screened.filter(F.col("reject_reason").isNotNull()).select(*order_by, "reject_reason").unionByName(
        decided.filter(~F.col("accepted")).select(*order_by, "reject_reason")
    )
    sealed = encrypted_columns(new.select(*plain), F.col("contact"), key, *CONTACT.stored)
    return RegisteredPatients(existing.unionByName(sealed), rejected)


class AddedUsers(NamedTuple):
    """The new account table and the refused requests."""

    app_users: DataFrame
    rejected: DataFrame


def add_users(
    clinic: Clinic, requests: DataFrame, order_by: Sequence[str], high_water: int | None = None, now: datetime | None = None
) -> AddedUsers:
    """The account table with the requested accounts added as active.

    ``requests`` holds ``username``, ``password_hash``, ``role_name``, ``patient_id``,
    ``mysql_username`` (the username where blank) and the columns of ``order_by``.
    Refused with a reason: malformed names or roles, unknown patients, and names or
    patients that have an account or that an earlier accepted request has.
    """
    login = stripped("username")
    cleaned = requests.withColumns({
        "username": login, "mysql_username": F.coalesce(blank_to_null("mysql_username"), login), "patient_id": blank_to_null("patient_id"),
    })
    broken = [F.when(F.coalesce(bad, F.lit(True)), F.lit(f"bad {name}")) for name, bad in account_rules().items()]
    people = clinic.clinic_patients.select("patient_id", F.lit(True).alias("__person"))
    known = cleaned.join(people, "patient_id", "left").withColumn("reject_reason", F.coalesce(
        *broken, F.when(F.col("patient_id").isNotNull() & F.col("__person").isNull(), "unknown patient")
    ))
    checked = taken_keys(clinic.app_users, known.drop("__person"), {"username": "name has an account", "patient_id": "patient has an account"})
    screened = checked.withColumn("reject_reason", F.coalesce("reject_reason", "__taken")).drop("__taken")
    decided = one_at_a_time(
        screened.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        {"username": "name repeated in batch", "patient_id": "patient repeated in batch"}, order_by,
    )
    last = high_water_mark(clinic.app_users, "user_id") if high_water is None else high_water
    numbered = assign_ids(decided.filter("accepted"), "user_id", order_by, last)
    new = numbered.withColumns({"is_active": F.lit(True), "created_at": moment(now), "updated_at": moment(now)})
    return AddedUsers(
        clinic.app_users.unionByName(new.select(*clinic.app_users.columns)),
        screened.filter(F.col("reject_reason").isNotNull()).select(*order_by, "username", "reject_reason").unionByName(
            decided.filter(~F.col("accepted")).select(*order_by, "username", "reject_reason")
        ),
    )


class ReadResults:
    """New panel rows, the patch that completes their orders, and the refused sheets.

    Only the new rows need numbers, so the sort and checkpoint for these wait until they are asked for.
    """

    def __init__(self, done: DataFrame, rejected: DataFrame, number: Callable[[], DataFrame]) -> None:
        self.done, self.rejected, self._number = done, rejected, number

    @cached_property
    def new(self) -> DataFrame:
        return self._number()


class PostedResults:
    """What posting a batch of results changes, and what it refuses."""

    def __init__(self, panel: DataFrame, orders: DataFrame, read: ReadResults, now: datetime | None) -> None:
        self._panel, self._read = panel, read
        self.lab_test = patch_rows(orders, read.done, "order_id", ("status",), now)
        self.rejected = read.rejected

    @cached_property
    def panel(self) -> DataFrame:
        return self._panel.unionByName(self._read.new)


def read_results(clinic: Clinic, panel: str, results: DataFrame, order_by: Sequence[str], now: datetime | None = None) -> ReadResults:
    """Judge a batch of results given as text and number the good ones.

    What is known of an order is put together first, so the sheets join only once
    and an order with very many of them can be split.
    """
    fields = panel_fields(panel)
    texts = {f.name: blank_to_null(f.name) for f in fields}
    values = {f"__{f.name}": F.col(f.name).try_cast(f.dataType) for f in fields}
    bad = reduce(lambda a, b: a | b, [F.col(f.name).isNotNull() & F.col(f"__{f.name}").isNull() for f in fields])
    have = clinic.table(panel).select("order_id", F.lit(True).alias("__have"))
    known = clinic.lab_test.select("order_id", F.lit(True).alias("__known"))
    read = results.withColumns(texts).withColumns(values)
    first = read.groupBy("order_id").agg(F.min(F.when(~bad, in_order(order_by))).alias("__first"))
    facts = first.join(known, "order_id", "left").join(have, "order_id", "left")
    judged = join_grouped(read, facts, "order_id", "left").withColumn(
        "reject_reason",
        F.when(F.col("__known").isNull(), "unknown order").when(F.col("__have").isNotNull(), "result exists")
        .when(bad, "unreadable number").when(in_order(order_by) != F.col("__first"), "repeated in batch"),
    )
    good = judged.filter(F.col("reject_reason").isNull())
    key = PRIMARY_KEY[panel]

    def number() -> DataFrame:
        numbered = assign_ids(good.drop(key), key, order_by, high_water_mark(clinic.table(panel), key))
        return numbered.select(
            key, "order_id", *[F.col(f"__{f.name}").alias(f.name) for f in fields],
            moment(now).alias("created_at"), moment(now).alias("updated_at"),
        )

    # An order is completed by its first readable sheet, so the facts alone tell which: no need to wait for the numbering.
    done = facts.filter(F.col("__known") & F.col("__have").isNull() & F.col("__first").isNotNull())
    return ReadResults(
        done.select("order_id", F.lit("COMPLETED").alias("status")),
        judged.filter(F.col("reject_reason").isNotNull()).select("order_id", "reject_reason"), number,
    )


def panel_of(test_type: str) -> str:
    panel = PANEL_OF_TEST.get(test_type.upper())
    if panel is None:
        raise ValueError(f"no result panel for test {test_type!r}")
    return panel


def post_results(
    clinic: Clinic, test_type: str, results: DataFrame, order_by: Sequence[str], now: datetime | None = None
) -> PostedResults:
    """Add panel rows given as text and complete their orders.

    Blank texts become NULL. Refused with a reason: unknown orders, orders that have
    this panel already, unreadable numbers, readable sheets after an order's first one.
    """
    panel = panel_of(test_type)
    return PostedResults(clinic.table(panel), clinic.lab_test, read_results(clinic, panel, results, order_by, now), now)


# Updates


def patch_rows(
    table: DataFrame, patch: DataFrame, key: str, columns: Sequence[str], now: datetime | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Set the columns of every row whose key is in ``patch``, NULL included.

    Of rows with one key the last counts, in the order of ``order_by`` or else of the
    columns set. ``updated_at`` moves only where a value really changes.
    """
    last = F.max_by(F.struct(*columns), F.struct(*(order_by or columns)))
    one = patch.groupBy(key).agg(last.alias("__new"))
    new = one.select(key, F.lit(True).alias("__hit"), *[F.col(f"__new.{c}").alias(f"__{c}") for c in columns])
    hit = F.col("__hit").isNotNull()
    values = {c: F.when(hit, F.col(f"__{c}").cast(table.schema[c].dataType)).otherwise(F.col(c)) for c in columns}
    differs = reduce(lambda a, b: a | b, [~F.col(f"__{c}").cast(table.schema[c].dataType).eqNullSafe(F.col(c)) for c in columns])
    if "updated_at" in table.columns:
        values["updated_at"] = F.when(hit & differs, moment(now)).otherwise(F.col("updated_at"))
    return table.join(new, key, "left").select(*[values.get(c, F.col(c)).alias(c) for c in table.columns])


def set_where(table: DataFrame, condition: Column, values: dict[str, Column], now: datetime | None = None) -> DataFrame:
    """Set columns of the rows that meet a condition; unknown conditions leave the row alone."""
    hit = F.coalesce(condition, F.lit(False))
    changed = {c: F.when(hit, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
    differs = reduce(lambda a, b: a | b, [~v.cast(table.schema[c].dataType).eqNullSafe(F.col(c)) for c, v in values.items()])
    if "updated_at" in table.columns:
        changed["updated_at"] = F.when(hit & differs, moment(now)).otherwise(F.col("updated_at"))
    return table.select(*[changed.get(c, F.col(c)).alias(c) for c in table.columns])


def edit_results(clinic: Clinic, panel: str, edits: DataFrame, now: datetime | None = None) -> DataFrame:
    """Replace all readings of the listed orders; blank texts clear the reading."""
    fields = [f.name for f in panel_fields(panel)]
    cleaned = edits.select("order_id", *[blank_to_null(c).alias(c) for c in fields])
    return patch_rows(clinic.table(panel), cleaned, "order_id", fields, now)


def edit_patients(clinic: Clinic, edits: DataFrame, key: str | bytes, now: datetime | None = None) -> DataFrame:
    """Replace name, age, sex, address and contact of the listed patients and encrypt the contact anew."""
    texts = ("first_name", "last_name", "sex", "address", "contact")
    cleaned = edits.select("patient_id", "age", *[stripped(F.coalesce(c, F.lit(""))).alias(c) for c in texts])
    sealed = encrypted_columns(cleaned, F.col("contact"), key, *CONTACT.stored)
    table = with_encryption_columns(clinic.clinic_patients, CONTACT)
    return patch_rows(table, sealed, "patient_id", ("age", *texts, *CONTACT.stored), now)


def edit_tests(clinic: Clinic, edits: DataFrame, now: datetime | None = None) -> DataFrame:
    """Replace name, price and description of the listed catalog tests."""
    return patch_rows(clinic.lab_test_catalog, edits, "test_id", ("test_name", "price", "description"), now)


def change_contact(
    clinic: Clinic, patient_id: str, contact: str, address: str, key: str | bytes, now: datetime | None = None
) -> DataFrame:
    """Set one patient's contact and address and renew the encrypted copy of the contact."""
    me = F.col("patient_id") == F.lit(patient_id)
    updated = set_where(clinic.clinic_patients, me, {"contact": F.lit(contact), "address": F.lit(address)}, now)
    if CONTACT.cipher not in updated.columns:
        return updated
    fresh = [f"__new_{c}" for c in CONTACT.stored]
    renewed = encrypted_columns(updated, F.when(me, F.lit(contact)), key, *fresh)
    picked = dict(zip(CONTACT.stored, fresh))
    return renewed.select(*[
        F.when(me, F.col(picked[c])).otherwise(F.col(c)).alias(c) if c in picked else F.col(c) for c in updated.columns
    ])


def complete_old_orders(clinic: Clinic, as_of: date | None = None, days: int = 7, now: datetime | None = None) -> DataFrame:
    """Complete the pending orders that are at least ``days`` old."""
    old = (F.col("status") == "PENDING") & (F.col("order_date") <= F.date_sub(_day(as_of), days))
    return set_where(clinic.lab_test, old, {"status": F.lit("COMPLETED")}, now)


def set_user_status(clinic: Clinic, status: DataFrame, now: datetime | None = None) -> DataFrame:
    """Activate or deactivate the listed accounts (``user_id``, ``is_active``)."""
    return patch_rows(clinic.app_users, status, "user_id", ("is_active",), now)


def grant_roles(clinic: Clinic, grants: DataFrame, now: datetime | None = None) -> DataFrame:
    """Give the listed database accounts (``mysql_username``, ``role_name``) a new role."""
    return patch_rows(clinic.app_users, grants, "mysql_username", ("role_name",), now)


def revoke_roles(clinic: Clinic, revokes: DataFrame, now: datetime | None = None) -> DataFrame:
    """Deactivate the accounts that hold a revoked role (``mysql_username``, ``role_name``)."""
    lost = revokes.select("mysql_username", "role_name").distinct()
    hit = clinic.app_users.select("user_id", "mysql_username", "role_name").join(lost, ["mysql_username", "role_name"], "left_semi")
    return set_user_status(clinic, hit.select("user_id", F.lit(False).alias("is_active")), now)


# Deletes


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Drop the rows that meet a condition; rows where it is unknown stay."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def delete_cancelled(clinic: Clinic) -> DataFrame:
    return delete_where(clinic.lab_test, F.col("status") == "CANCELLED")


def patient_test_condition(clinic: Clinic, patient_id: str, test_name: str) -> Column:
    """Orders of one patient for the first catalog test of that name."""
    named = clinic.lab_test_catalog.filter(F.col("test_name") == F.lit(test_name))
    test_id = named.agg(F.min("test_id").alias("test_id")).scalar()
    return (F.col("patient_id") == F.lit(patient_id)) & (F.col("test_id") == test_id)


def delete_patient_test(clinic: Clinic, patient_id: str, test_name: str) -> DataFrame:
    return delete_where(clinic.lab_test, patient_test_condition(clinic, patient_id, test_name))


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return join_grouped(table, keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def delete_payments(clinic: Clinic, payments: DataFrame) -> DataFrame:
    return delete_keys(clinic.payments, payments, "payment_id")


def cascade_delete_orders(clinic: Clinic, orders: DataFrame) -> Clinic:
    """Delete orders with their panel rows and payments."""
    children = [child for child, _, parent in REFERENCES if parent == "lab_test"]
    return clinic.with_tables(**{t: delete_keys(clinic.table(t), orders, "order_id") for t in ("lab_test", *children)})


def _found(orders: DataFrame) -> DataFrame:
    """The order numbers to delete, found once for all tables that hold rows of them."""
    ensure_checkpoint_dir(orders.sparkSession)
    return orders.checkpoint()


def cascade_delete_patients(clinic: Clinic, patients: DataFrame) -> Clinic:
    """Delete patients with all their orders; their accounts stay without a patient."""
    gone = patients.select("patient_id").distinct()
    orders = _found(join_grouped(clinic.lab_test, gone, "patient_id", "left_semi").select("order_id"))
    after = cascade_delete_orders(clinic, orders)
    users = _forget_patients(clinic.app_users, gone)
    return after.with_tables(clinic_patients=delete_keys(clinic.clinic_patients, gone, "patient_id"), app_users=users)


def _forget_patients(users: DataFrame, gone: DataFrame) -> DataFrame:
    # Most staff accounts have no patient: one key with very many rows.
    marked = join_grouped(users, gone.withColumn("__gone", F.lit(True)), "patient_id", "left")
    kept = F.when(F.col("__gone").isNull(), F.col("patient_id"))
    return marked.withColumn("patient_id", kept).select(*users.columns)


def cascade_delete_tests(clinic: Clinic, tests: DataFrame) -> Clinic:
    """Delete catalog tests with all orders of them."""
    gone = tests.select("test_id").distinct()
    orders = _found(join_grouped(clinic.lab_test, gone, "test_id", "left_semi").select("order_id"))
    after = cascade_delete_orders(clinic, orders)
    return after.with_tables(lab_test_catalog=delete_keys(clinic.lab_test_catalog, gone, "test_id"))


def rename_patients(clinic: Clinic, names: DataFrame) -> Clinic:
    """Change patient identifiers (``patient_id`` to ``new_patient_id``); accounts follow.

    Orders do not follow such a change, so a patient that has orders keeps the old identifier.
    """
    free = names.join(clinic.lab_test.select("patient_id").distinct(), "patient_id", "left_anti")
    return clinic.with_tables(
        clinic_patients=_rekey(clinic.clinic_patients, free, "patient_id"), app_users=_rekey(clinic.app_users, free, "patient_id")
    )


def renumber_orders(clinic: Clinic, numbers: DataFrame) -> Clinic:
    """Change order numbers (``order_id`` to ``new_order_id``); payments follow.

    Panel rows do not follow such a change, so an order that has one keeps its number.
    """
    free = numbers
    for panel in PANEL_OF_TEST.values():
        free = free.join(clinic.table(panel).select("order_id").distinct(), "order_id", "left_anti")
    return clinic.with_tables(lab_test=_rekey(clinic.lab_test, free, "order_id"), payments=_rekey(clinic.payments, free, "order_id"))


def _rekey(table: DataFrame, names: DataFrame, key: str) -> DataFrame:
    one = names.groupBy(key).agg(F.max(f"new_{key}").alias(f"new_{key}"))
    joined = join_grouped(table, one, key, "left")
    return joined.withColumn(key, F.coalesce(f"new_{key}", key)).select(*table.columns)
