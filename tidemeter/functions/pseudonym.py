"""Keyed pseudonyms built from native hash expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# RFC 4648 alphabet, label prefixes, alias length and the message framing.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PREFIX = {"project": "Project-", "session": "Session-"}
LENGTH = 10
FRAME = "usage/{kind}/v1\0"

_BLOCK = 64
_FULL = 52


def hmac_hex(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as hex, from two ``sha2`` calls over padded-key literals."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    digest = F.unhex(F.sha2(F.concat(inner, message), 256))
    return F.sha2(F.concat(outer, digest), 256)


def base32(hex_text: Column, length: int) -> Column:
    """Leading ``length`` base-32 characters: five hex digits make four of them."""
    padded = F.concat(hex_text, F.lit("0"))
    chars = []
    for i in range(length):
        group = F.conv(F.substring(padded, 5 * (i // 4) + 1, 5), 16, 10).cast("int")
        digit = F.shiftright(group, 15 - 5 * (i % 4)).bitwiseAND(F.lit(31))
        chars.append(F.substring(F.lit(ALPHABET), digit + F.lit(1), F.lit(1)))
    return F.concat(*chars)


def token(key: bytes, kind: str, value: Column, length: int = LENGTH) -> Column:
    framed = F.encode(F.concat(F.lit(FRAME.format(kind=kind)), value.cast("string")), "UTF-8")
    return base32(hmac_hex(key, framed), length)


def pseudonym(key: bytes, kind: str, value: Column) -> Column:
    """Alias of fixed length; null and empty values pass through."""
    alias = F.concat(F.lit(PREFIX[kind]), token(key, kind, value))
    return F.when(value.isNull() | (value == ""), value).otherwise(alias)


def alias_table(values: DataFrame, column: str, key: bytes, kind: str) -> DataFrame:
    """Distinct values with collision-free aliases: (value, alias).

    Values that share a ten-character token get the shortest even length at which
    they differ from both neighbours in token order. The window is partitioned by
    the hashed token, so its groups stay tiny whatever the input skew.
    """
    distinct = (
        values.where(F.col(column).isNotNull() & (F.col(column) != ""))
        .select(F.col(column).alias("value"))
        .distinct()
        .withColumn("_hex", hmac_hex(key, F.encode(F.concat(
            F.lit(FRAME.format(kind=kind)), F.col("value")), "UTF-8")))
    )
    full = distinct.withColumn("_short", base32(F.col("_hex"), LENGTH))
    beside = W.partitionBy("_short").orderBy("_hex")
    full = full.withColumn("_before", F.lag("_hex").over(beside)).withColumn(
        "_after", F.lead("_hex").over(beside)
    )
    alone = F.col("_before").isNull() & F.col("_after").isNull()
    codes = {c: base32(F.col(c), _FULL) for c in ("_hex", "_before", "_after")}
    crowded = full.where(~alone).select("value", *[t.alias(c) for c, t in codes.items()])

    def differs(length: int) -> Column:
        mine = F.substring("_hex", 1, length)
        apart = lambda c: F.col(c).isNull() | (F.substring(c, 1, length) != mine)
        return apart("_before") & apart("_after")

    longer = F.coalesce(*[
        F.when(differs(n), F.substring("_hex", 1, n)) for n in range(LENGTH + 2, _FULL, 2)], F.col("_hex"))
    prefix = F.lit(PREFIX[kind])
    short = full.where(alone).select("value", F.concat(prefix, F.col("_short")).alias("alias"))
    return short.unionByName(crowded.select("value", F.concat(prefix, longer).alias("alias")))
