"""Digests of tables that add up, so that no task holds more than its own rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 32 bits in a digest.
WORDS = 8


def row_hash(columns: Sequence[str | Column]) -> Column:
    """SHA-256 of the cells as text, each with its length before it; a null is marked as such."""
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    texts = [c.cast("string") for c in cells]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts]), 256)


def summed(rows: DataFrame, by: Sequence[str], hashes: Column) -> DataFrame:
    """by, rows and digest: the sum of the rows' 256-bit hashes modulo 2^256, in hexadecimal.

    It doesn't depend on the rows' order and tells how often a row is there.
    """
    words = [F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(WORDS)]
    sums = rows.select(*by, hashes.alias("_h")).groupBy(*by).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(w), F.lit(0)).cast("decimal(38,0)").alias(f"_s{i}") for i, w in enumerate(words)])
    carry, out = F.lit(0).cast("decimal(38,0)"), []
    for i in reversed(range(WORDS)):
        sums = sums.withColumn(f"_t{i}", F.col(f"_s{i}") + carry)
        out.insert(0, F.lower(F.lpad(F.hex((F.col(f"_t{i}") % F.lit(2**32)).cast("long")), 8, "0")))
        carry = F.floor(F.col(f"_t{i}") / F.lit(2**32)).cast("decimal(38,0)")
    return sums.select(*by, "rows", F.concat(*out).alias("digest"))


def table_digest(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, rows and digest of the other columns."""
    return summed(rows, by, row_hash([c for c in rows.columns if c not in by]))
