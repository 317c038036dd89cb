"""Column encryption, tokens and the decrypted views."""

from __future__ import annotations

import pytest
from clinic_cases import KEY, rows
from pyspark.sql import functions as F

from clinicframe.functions.crypto import fold_key
from clinicframe.operators import encryption, joins
from clinicframe.operators.encryption import CONTACT, RECEIPT

EMPTY_TOKEN = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def sealed(clinic, null_policy="keep"):
    return clinic.with_tables(
        clinic_patients=encryption.encrypt_column(clinic.clinic_patients, CONTACT, KEY, null_policy),
        payments=encryption.encrypt_column(clinic.payments, RECEIPT, KEY, null_policy),
    )


def test_key_folding():
    assert fold_key("ab") == b"ab" + bytes(30)
    assert fold_key(b"x" * 32) == b"x" * 32
    assert fold_key(b"a" * 32 + b"b") == bytes([ord("a") ^ ord("b")]) + b"a" * 31
    with pytest.raises(ValueError, match="key is required"):
        fold_key("")


def test_stored_layout_is_plain_aes_cbc(spark):
    # Iv and ciphertext kept apart decrypt with the padded key when put together again.
    df = encryption.encrypt_column(spark.createDataFrame([("0912",)], "contact string"), CONTACT, KEY)
    blob = F.concat(CONTACT.iv, CONTACT.cipher)
    plain = F.aes_decrypt(blob, F.lit(bytearray(KEY.encode().ljust(32, bytes(1)))), F.lit("CBC"), F.lit("PKCS")).cast("string")
    assert rows(df.select(plain)) == [("0912",)]


def test_round_trip_and_null_policies(clinic):
    keep = encryption.patients_decrypted(sealed(clinic), KEY)
    assert dict(rows(keep, "patient_id", "visible_contact"))["PAT-003"] is None
    assert dict(rows(keep, "patient_id", "visible_contact"))["PAT-001"] == "0901"
    empty = sealed(clinic, "empty").clinic_patients.filter("patient_id = 'PAT-003'")
    assert rows(empty, "contact", "contact_token_hash") == [(None, EMPTY_TOKEN)]
    assert rows(empty.select(encryption.visible(CONTACT, KEY))) == [("",)]
    with pytest.raises(ValueError, match="null_policy"):
        encryption.encrypt_column(clinic.payments, RECEIPT, KEY, "drop")


def test_wrong_key_shows_nothing(clinic):
    seen = rows(encryption.patients_decrypted(sealed(clinic), "another key"), "visible_contact")
    assert not {s for (s,) in seen} & {"0901", "0902", "0905", "0906"}


def test_every_row_has_its_own_iv_even_for_a_constant(spark):
    df = spark.range(500).select(F.lit("same").alias("contact"))
    proof = encryption.iv_proof(df, CONTACT, KEY).first()
    assert tuple(proof) == (1000, 1000, 1000, 1)


def test_texts_of_one_task_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(encryption, "PROOF_ROWS", 10)
    df = spark.range(0, 95, 1, 1).select(F.when(F.col("id") < 90, F.col("id").cast("string")).alias("contact"))
    proof = encryption.iv_proof(df, CONTACT, KEY)
    assert "RoundRobinPartitioning(9)" in proof._jdf.queryExecution().executedPlan().toString()
    assert proof.first()[:] == (180, 180, 180, 90)
    assert encryption.iv_proof(df.filter("false"), CONTACT, KEY).first()[:] == (0, 0, 0, 0)


def test_stored_parts_belong_together(spark, tmp_path):
    df = spark.range(2000).select(F.format_string("09%05d", "id").alias("contact")).repartition(8)
    encryption.encrypt_column(df, CONTACT, KEY).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.filter(encryption.visible(CONTACT, KEY) != F.col("contact")).isEmpty()
    assert stored.filter("length(encryption_iv) <> 16 or length(contact_encrypted) <> 16").isEmpty()


def test_migration_is_idempotent(clinic):
    first = encryption.encrypt_missing(clinic.payments, RECEIPT, KEY).withColumn("before", F.col(RECEIPT.cipher))
    again = encryption.encrypt_missing(first, RECEIPT, KEY)
    assert again.filter(~F.col("before").eqNullSafe(F.col(RECEIPT.cipher))).isEmpty()
    assert again.filter("receipt_number is null and receipt_number_encrypted is not null").isEmpty()
    assert again.filter(encryption.visible(RECEIPT, KEY) != F.col("receipt_number")).isEmpty()


def test_columns_are_added_once(clinic):
    assert encryption.missing_encryption_columns(clinic) == [
        "clinic_patients.contact_encrypted", "clinic_patients.encryption_iv", "clinic_patients.contact_token_hash",
        "payments.receipt_number_encrypted", "payments.encryption_iv", "payments.receipt_token_hash",
    ]
    added = encryption.with_encryption_columns(clinic.payments, RECEIPT)
    assert [t for _, t in added.dtypes[-3:]] == ["binary", "binary", "string"]
    assert encryption.with_encryption_columns(added, RECEIPT) is added


def test_check(clinic):
    with pytest.raises(ValueError, match="missing encryption columns"):
        encryption.check_encryption(clinic)
    with pytest.raises(ValueError, match="3 rows"):
        encryption.check_encryption(sealed(clinic))
    encryption.check_encryption(sealed(clinic, "empty"))
    assert dict(rows(encryption.missing_cipher_count(sealed(clinic)))) == {"clinic_patients": 1, "payments": 2}


def test_find_by_token(clinic, spark):
    table = sealed(clinic).clinic_patients
    assert rows(encryption.find_by_token(table, CONTACT, "0905"), "patient_id") == [("PAT-005",)]
    terms = spark.createDataFrame([("0902",), ("0902",), ("nobody",), (None,)], "term string")
    assert rows(encryption.find_many_by_token(table, CONTACT, terms, "term"), "patient_id") == [("PAT-002",)]
    shown = encryption.raw_cipher(table, CONTACT, 2).first()
    assert len(shown.iv_hex or "") in (0, 32)


def test_ledger_shows_receipts(clinic, spark):
    ledger = joins.payment_ledger(sealed(clinic), KEY)
    assert rows(ledger, "payment_id", "receipt_number") == [(6, None), (5, "R-5"), (4, "R-4"), (3, None), (2, "R-2"), (1, "R-1")]
    orders = spark.createDataFrame([(1,)], "order_id long")
    assert rows(joins.order_payments(sealed(clinic), KEY, orders), "payment_id", "receipt_number") == [(3, None), (2, "R-2"), (1, "R-1")]
