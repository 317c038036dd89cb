"""AES-256-CBC column encryption with a per-row IV, and equality tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IV_BYTES = 16
KEY_BYTES = 32


def fold_key(key: str | bytes) -> bytes:
    """Fit a passphrase to 32 bytes: short ones are zero-padded, long ones wrap around with XOR."""
    raw = key.encode("utf-8") if isinstance(key, str) else key
    if not raw:
        raise ValueError("an encryption key is required")
    folded = bytearray(KEY_BYTES)
    for place, byte in enumerate(raw):
        folded[place % KEY_BYTES] ^= byte
    return bytes(folded)


def _key_column(key: str | bytes) -> Column:
    return F.lit(bytearray(fold_key(key)))


def token(column: str | Column) -> Column:
    """SHA-256 of the text, in hex: equal values give equal tokens."""
    return F.sha2(F.col(column) if isinstance(column, str) else column, 256)


def encrypted_columns(
    df: DataFrame, plain: Column, key: str | bytes, cipher_name: str, iv_name: str, token_name: str
) -> DataFrame:
    """Append ciphertext, IV and token of ``plain``; NULL text gives three NULLs.

    Spark draws a fresh IV per call and returns it in front of the ciphertext. A random
    tail that is cut off again marks the call as non-deterministic: the optimizer then
    neither folds a constant plaintext into one ciphertext nor evaluates the call
    twice, so the two stored parts always belong together.
    """
    unfoldable = F.substring(F.concat(plain, F.rand().cast("string")), F.lit(1), F.length(plain))
    blob = F.aes_encrypt(unfoldable, _key_column(key), F.lit("CBC"), F.lit("PKCS"))
    kept = [c for c in df.columns if c not in (cipher_name, iv_name, token_name)]
    return df.select(*kept, plain.alias("__plain"), blob.alias("__blob")).select(
        *kept,
        F.expr(f"substring(__blob, {IV_BYTES + 1})").alias(cipher_name),
        F.substring("__blob", 1, IV_BYTES).alias(iv_name),
        token("__plain").alias(token_name),
    )


def decrypted(cipher: str, iv: str, key: str | bytes) -> Column:
    """The plaintext, or NULL when cipher or IV is missing or the key does not fit."""
    blob = F.concat(F.col(iv), F.col(cipher))
    return F.try_aes_decrypt(blob, _key_column(key), F.lit("CBC"), F.lit("PKCS")).cast("string")
