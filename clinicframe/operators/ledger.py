"""Recording and editing payments from typed entries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicframe.functions.crypto import encrypted_columns
from clinicframe.functions.text import blank_to_null
from clinicframe.model import Clinic
from clinicframe.operators.caps import edit_payments, payment_cap
from clinicframe.operators.changes import moment, patch_rows
from clinicframe.operators.encryption import RECEIPT, encrypt_column, with_encryption_columns
from clinicframe.operators.firstcome import one_at_a_time, taken_keys
from clinicframe.operators.keys import assign_ids, high_water_mark
from clinicframe.operators.quality import payment_input
from clinicframe.session import stored


class RecordedPayments(NamedTuple):
    """The new payment table, or its new rows, and the refused entries."""

    payments: DataFrame
    rejected: DataFrame


def record_payments(
    clinic: Clinic, entries: DataFrame, order_by: Sequence[str], key: str | bytes, high_water: int | None = None,
    now: datetime | None = None,
) -> RecordedPayments:
    """The payment table with the acceptable entries added, see ``new_payments``."""
    entered = new_payments(clinic, entries, order_by, key, high_water, now)
    return RecordedPayments(with_encryption_columns(clinic.payments, RECEIPT).unionByName(entered.payments), entered.rejected)


def new_payments(
    clinic: Clinic, entries: DataFrame, order_by: Sequence[str], key: str | bytes, high_water: int | None = None,
    now: datetime | None = None,
) -> RecordedPayments:
    """Enter payments in the order of ``order_by``: parse, check the receipt, apply the cap, number, encrypt.

    ``entries`` holds ``order_id``, ``amount_text``, ``payment_method``, ``status``,
    ``receipt_number`` and the columns of ``order_by``, which identify an entry.
    Method and status default to CASH and PAID. A receipt may be used once: entries
    with one already on the ledger are refused, and so are those whose receipt an
    earlier accepted entry of the batch has. A refused entry leaves its receipt free.
    """
    typed = entries.withColumns({
        "payment_method": F.coalesce("payment_method", F.lit("CASH")), "status": F.coalesce("status", F.lit("PAID")),
        "receipt_number": blank_to_null("receipt_number"),
    })
    parsed = payment_input(typed).withColumn("amount_paid", F.col("amount").try_cast("decimal(10,2)"))
    # Screening, deciding and numbering write the entries out several times: the parsed text stays behind.
    used = ("order_id", "amount_paid", "payment_method", "status", "receipt_number")
    used += tuple(c for c in order_by if c not in used)
    checked = taken_keys(clinic.payments, parsed.select(*used, "reject_reason"), {"receipt_number": "receipt exists"})
    # Both what is fit and what is refused come from here, so receipts are looked up once.
    screened = stored(checked.withColumn("reject_reason", F.coalesce("reject_reason", "__taken")).drop("__taken"))
    fit = screened.filter(F.col("reject_reason").isNull()).select(*used)
    judged = one_at_a_time(fit, {"receipt_number": "receipt repeated"}, order_by, payment_cap(clinic, order_by))
    last = high_water_mark(clinic.payments, "payment_id") if high_water is None else high_water
    numbered = assign_ids(judged.filter("accepted").select(*fit.columns), "payment_id", order_by, last)
    new = numbered.select(
        "payment_id", "order_id", "amount_paid", "payment_method", moment(now).alias("payment_date"), "receipt_number", "status",
        moment(now).alias("created_at"), moment(now).alias("updated_at"),
    )
    kept = ["order_id", *[c for c in order_by if c != "order_id"], "reject_reason"]
    rejected = screened.filter(F.col("reject_reason").isNotNull()).select(*kept)
    return RecordedPayments(
        encrypt_column(new, RECEIPT, key, "empty"),
        rejected.unionByName(judged.filter(~F.col("accepted")).select(*kept)),
    )


def apply_payment_edits(
    clinic: Clinic, edits: DataFrame, order_by: Sequence[str], key: str | bytes, now: datetime | None = None
) -> DataFrame:
    """The payment table with the acceptable edits made; each edited receipt is encrypted anew.

    ``edits`` holds ``payment_id``, ``amount_paid``, ``payment_method``, ``status`` and
    ``receipt_number``; a blank receipt becomes NULL and loses its ciphertext.
    """
    cleaned = edits.withColumn("receipt_number", blank_to_null("receipt_number"))
    good = edit_payments(clinic, cleaned, order_by).filter("accepted")
    sealed = encrypted_columns(good.select(*cleaned.columns), F.col("receipt_number"), key, *RECEIPT.stored)
    table = with_encryption_columns(clinic.payments, RECEIPT)
    columns = ("amount_paid", "payment_method", "status", "receipt_number", *RECEIPT.stored)
    return patch_rows(table, sealed, "payment_id", columns, now)
