"""Deterministic hashing: row samples, order-free content digests, uniform draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = 1 << 32


def hash32(*parts: Column | str | int, at: int = 1) -> Column:
    """32 bits of an MD5 over the parts joined by '-'; the same in any engine with MD5.

    A resampling stream from these draws differs from a sequential generator's stream with the
    same seed; the distribution is the same.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("-", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("bigint")


def hash_sample(df: DataFrame, key: str, share: float) -> DataFrame:
    """Rows whose key hash falls below ``share`` of the hash space: a reproducible sample."""
    return df.where(hash32(F.col(key)) < int(share * SPACE))


def content_digest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-free digest of row contents: count, sum and xor of row hashes.

    Equal for equal multisets of rows, merges by addition, and keeps nothing per row.
    """
    row = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)

    def word(at: int) -> Column:
        return F.conv(F.substring(row, at, 8), 16, 10).cast("bigint")

    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(word(1)).alias("sum_a"), F.bit_xor(word(9)).alias("xor_b"))
