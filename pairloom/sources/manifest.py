"""Order-insensitive table fingerprints and drift checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.keys import UNIT_SEPARATOR
from pairloom.operators.rules import union_all

# Two words of fifteen hex digits of each row digest are summed.
# Each is below 2**60, so sums stay exact in decimal(38,0) for any table.
WORD_HEX, WORDS = 15, 2


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): row count and a digest of the schema and of the sums of
    row digests, independent of row order and partitioning. Columns count in name
    order; format floating-point columns explicitly first.

    A cell is its length, a colon and its text, and null is a lone hyphen, so null,
    blank and shifted cells all differ.
    """
    names = sorted(df.columns)
    text = lambda c: F.col(f"`{c}`").cast("string")
    cells = [
        F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in names
    ]
    digest = F.sha2(F.concat_ws(UNIT_SEPARATOR, *cells), 256)
    sums = [
        F.coalesce(
            F.sum(F.conv(F.substring(digest, 1 + WORD_HEX * k, WORD_HEX), 16, 10).cast("decimal(38,0)")), F.lit(0)
        ).cast("string")
        for k in range(WORDS)
    ]
    schema = UNIT_SEPARATOR.join(names)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sha2(F.concat_ws(UNIT_SEPARATOR, F.lit(schema), *sums), 256).alias("fingerprint"),
    )


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows, fingerprint), one row per table."""
    return union_all(
        [fingerprint(df).select(F.lit(n).alias("table"), "rows", "fingerprint") for n, df in tables.items()]
    )


def verify_manifest(expected: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, issue) for every table that is missing, unlisted or changed."""
    now = manifest(tables).select("table", F.col("rows").alias("_r"), F.col("fingerprint").alias("_f"))
    both = expected.select("table", "rows", "fingerprint").join(now, "table", "full_outer")
    issue = (
        F.when(F.col("_r").isNull(), F.lit("missing"))
        .when(F.col("rows").isNull(), F.lit("unlisted"))
        .when(F.col("_r") != F.col("rows"), F.lit("row_count_changed"))
        .when(F.col("_f") != F.col("fingerprint"), F.lit("content_changed"))
    )
    return both.select("table", issue.alias("issue")).where(F.col("issue").isNotNull())
