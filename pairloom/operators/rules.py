"""Declarative row rules and the violations table every validator returns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Rule:
    """``broken`` is true on a row that violates the rule; null means it holds."""

    rule_id: str
    broken: Column
    message: Column | str = ""
    severity: str = "error"

    def as_struct(self) -> Column:
        text = self.message if isinstance(self.message, Column) else F.lit(self.message)
        return F.when(
            self.broken,
            F.struct(
                F.lit(self.rule_id).alias("rule_id"),
                F.lit(self.severity).alias("severity"),
                F.coalesce(text, F.lit("")).alias("message"),
            ),
        )


def key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def violations(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """All broken rules in one scan: (key, rule_id, severity, message)."""
    fired = F.array_compact(F.array(*[r.as_struct() for r in rules]))
    return df.select(key_text(keys).alias("key"), F.explode(fired).alias("v")).select(
        "key", "v.rule_id", "v.severity", "v.message"
    )


def duplicate_keys(
    df: DataFrame, keys: Sequence[str], rule_id: str = "duplicate_key", severity: str = "error"
) -> DataFrame:
    """One violation per repeated key. Counting combines map-side, so a hot
    duplicate never gathers its rows in one task."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return repeated.select(
        key_text(keys).alias("key"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"),
        F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("message"),
    )


def missing_keys(
    df: DataFrame, known: DataFrame, key: str, known_key: str, rule_id: str, severity: str = "error"
) -> DataFrame:
    """Distinct values of ``df[key]`` that ``known`` lacks."""
    left = df.select(F.col(key).alias("key")).distinct()
    right = known.select(F.col(known_key).alias("key")).distinct()
    return left.join(right, "key", "left_anti").select(
        F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"),
        F.lit("unknown reference").alias("message"),
    )


def require_min_rows(df: DataFrame, minimum: int, rule_id: str) -> DataFrame:
    """A violation when ``df`` has fewer than ``minimum`` rows."""
    return (
        df.agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") < minimum)
        .select(
            F.lit("").alias("key"),
            F.lit(rule_id).alias("rule_id"),
            F.lit("error").alias("severity"),
            F.concat(F.col("n").cast("string"), F.lit(f" of {minimum} rows")).alias("message"),
        )
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def require_ok(found: DataFrame, sample: int = 5) -> None:
    """Raise with a short sample when there is any error-level violation."""
    bad = found.where(F.col("severity") == "error").take(sample)
    if bad:
        lines = "; ".join(f"{r['rule_id']} [{r['key']}] {r['message']}".strip() for r in bad)
        raise ValueError(f"validation failed: {lines}")
