"""Encrypted contact and receipt columns: adding, filling, checking, reading, finding."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicframe.functions.crypto import decrypted, encrypted_columns, token
from clinicframe.model import Clinic
from clinicframe.operators.listings import BY_NAME
from clinicframe.operators.skew import join_grouped


#: Texts that one task of ``iv_proof`` encrypts.
PROOF_ROWS = 100_000


class Secret(NamedTuple):
    """A protected column and the three columns stored beside it."""

    table: str
    plain: str
    cipher: str
    iv: str
    token: str

    @property
    def stored(self) -> tuple[str, str, str]:
        return (self.cipher, self.iv, self.token)


CONTACT = Secret("clinic_patients", "contact", "contact_encrypted", "encryption_iv", "contact_token_hash")
RECEIPT = Secret("payments", "receipt_number", "receipt_number_encrypted", "encryption_iv", "receipt_token_hash")


def with_encryption_columns(df: DataFrame, secret: Secret) -> DataFrame:
    """Add the missing encryption columns as NULL; a complete table is returned as it is."""
    types = dict(zip(secret.stored, ("binary", "binary", "string")))
    missing = {c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def encrypt_column(df: DataFrame, secret: Secret, key: str | bytes, null_policy: str = "empty") -> DataFrame:
    """Encrypt every row. Missing text is stored as encrypted '' (``empty``) or as NULL (``keep``)."""
    if null_policy not in ("empty", "keep"):
        raise ValueError(f"null_policy must be 'empty' or 'keep', not {null_policy!r}")
    plain = F.col(secret.plain)
    text = F.coalesce(plain, F.lit("")) if null_policy == "empty" else plain
    return encrypted_columns(df, text, key, *secret.stored)


def encrypt_missing(df: DataFrame, secret: Secret, key: str | bytes) -> DataFrame:
    """Encrypt the rows that have text and no ciphertext yet; all other rows keep their bytes.

    Running it again changes nothing.
    """
    ready = with_encryption_columns(df, secret)
    todo = F.col(secret.plain).isNotNull() & F.col(secret.cipher).isNull()
    fresh = [f"__new_{c}" for c in secret.stored]
    filled = encrypted_columns(ready, F.when(todo, F.col(secret.plain)), key, *fresh)
    picked = dict(zip(secret.stored, fresh))
    return filled.select(*[
        F.when(todo, F.col(picked[c])).otherwise(F.col(c)).alias(c) if c in picked else F.col(c) for c in ready.columns
    ])


def missing_encryption_columns(clinic: Clinic) -> list[str]:
    """The encryption columns the tables still lack, as ``table.column``."""
    return [f"{s.table}.{c}" for s in (CONTACT, RECEIPT) for c in s.stored if c not in clinic.table(s.table).columns]


def missing_cipher_count(clinic: Clinic) -> DataFrame:
    """Rows of each protected table that lack ciphertext, IV or token."""
    counts = []
    for secret in (CONTACT, RECEIPT):
        lacking = F.lit(False)
        for column in secret.stored:
            lacking = lacking | F.col(column).isNull()
        counts.append(clinic.table(secret.table).agg(
            F.lit(secret.table).alias("table_name"), F.count_if(lacking).alias("missing_rows")
        ))
    return counts[0].unionByName(counts[1])


def check_encryption(clinic: Clinic) -> None:
    """Raise unless all encryption columns exist and are filled in every row."""
    absent = missing_encryption_columns(clinic)
    if absent:
        raise ValueError("missing encryption columns: " + ", ".join(absent))
    missing = missing_cipher_count(clinic).agg(F.sum("missing_rows")).first()[0]
    if missing:
        raise ValueError(f"{missing} rows have no encrypted value")


def visible(secret: Secret, key: str | bytes) -> Column:
    return decrypted(secret.cipher, secret.iv, key)


def patients_decrypted(clinic: Clinic, key: str | bytes) -> DataFrame:
    return clinic.clinic_patients.select(
        "patient_id", "first_name", "last_name", "age", "sex", visible(CONTACT, key).alias("visible_contact")
    )


def payments_decrypted(clinic: Clinic, key: str | bytes) -> DataFrame:
    return clinic.payments.select(
        "payment_id", "order_id", "amount_paid", "payment_method", "payment_date", visible(RECEIPT, key).alias("visible_receipt"), "status"
    )


def contact_list(clinic: Clinic, key: str | bytes) -> DataFrame:
    """The administrator's list of decrypted contacts, by name."""
    return clinic.clinic_patients.orderBy(*BY_NAME).select("patient_id", "first_name", "last_name", visible(CONTACT, key).alias("contact"))


def receipt_list(clinic: Clinic, key: str | bytes) -> DataFrame:
    """The administrator's list of decrypted receipts, latest first."""
    latest = clinic.payments.orderBy(F.desc("payment_date"), F.desc("payment_id"))
    return latest.select(
        "payment_id", "order_id", "amount_paid", "payment_method", "payment_date", "status", visible(RECEIPT, key).alias("receipt_number")
    )


def tokens(df: DataFrame, secret: Secret, row_key: str) -> DataFrame:
    return df.select(row_key, token(secret.plain).alias(secret.token))


def find_by_token(df: DataFrame, secret: Secret, term: str) -> DataFrame:
    """Rows whose protected text equals ``term``, found without decrypting anything."""
    return df.filter(F.col(secret.token) == F.sha2(F.lit(term), 256))


def find_many_by_token(df: DataFrame, secret: Secret, terms: DataFrame, term: str) -> DataFrame:
    """Rows whose protected text equals one of the terms; each row once."""
    wanted = terms.select(token(term).alias(secret.token)).distinct()
    return join_grouped(df, wanted, secret.token, "left_semi").select(*df.columns)


def raw_cipher(df: DataFrame, secret: Secret, k: int = 3) -> DataFrame:
    """The stored bytes of the first ``k`` rows as hexadecimal text."""
    first = df.orderBy(secret.token).limit(k)
    return first.select(F.hex(secret.cipher).alias("ciphertext_hex"), F.hex(secret.iv).alias("iv_hex"), secret.token)


def iv_proof(df: DataFrame, secret: Secret, key: str | bytes) -> DataFrame:
    """Encrypt every text twice and count: IVs and ciphertexts never repeat, tokens do.

    Each text becomes six wide rows of a grouping, so the texts are dealt out first: a small file of many rows is one task.
    """
    text = df.filter(F.col(secret.plain).isNotNull()).select(secret.plain)
    dealt = text.repartition(max(1, -(-text.count() // PROOF_ROWS)))
    twice = dealt.select(secret.plain, F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    stored = encrypted_columns(twice, F.col(secret.plain), key, "cipher", "iv", "token")
    return stored.agg(
        F.count("cipher").alias("n_ciphers"), F.count_distinct("cipher").alias("n_distinct_ciphers"),
        F.count_distinct("iv").alias("n_distinct_ivs"), F.count_distinct("token").alias("n_distinct_tokens"),
    )
