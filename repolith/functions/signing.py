"""Signatures of webhook bodies as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a SHA-256 block.
BLOCK = 64
HEADER = "sha256="


def _bytes(x: Column) -> Column:
    return F.encode(x.cast("string"), "UTF-8")


def _padded(key: Column, with_: int) -> Column:
    """The key, hashed if longer than a block, filled up with zeros and XORed with one byte."""
    short = F.when(F.octet_length(key) > BLOCK, F.unhex(F.sha2(key, 256))).otherwise(key)
    digits = F.rpad(F.hex(short), 2 * BLOCK, "0")
    one = lambda k: F.lpad(F.hex(F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("bigint").bitwiseXOR(F.lit(with_))), 2, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), one), ""))


def hmac_sha256(key: Column, message: Column) -> Column:
    """Lower-case hex of HMAC-SHA256 over bytes; null for a null key or message.

    Of a literal key the padding is folded to a constant before any row is read.
    """
    inner = F.unhex(F.sha2(F.concat(_padded(key, 0x36), message), 256))
    return F.when(key.isNotNull(), F.sha2(F.concat(_padded(key, 0x5C), inner), 256))


def signature_state(body: Column, signature: Column, secret: str | None) -> Column:
    """valid, missing-secret, missing-signature, bad-format or mismatch; a null body counts as an empty one.

    Digests of both sides are compared, so that how much of a signature is right takes no part.
    """
    if not secret:
        return F.lit("missing-secret")
    wanted = F.concat(F.lit(HEADER), hmac_sha256(F.lit(secret.encode()), _bytes(F.coalesce(body.cast("string"), F.lit("")))))
    same = F.sha2(_bytes(signature), 256) == F.sha2(_bytes(wanted), 256)
    return F.when(F.coalesce(signature, F.lit("")) == "", "missing-signature").when(~signature.startswith(HEADER), "bad-format").when(same, "valid").otherwise("mismatch")
