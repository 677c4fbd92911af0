"""Ontology stanza text to term and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _field(name: str) -> Column:
    return F.regexp_extract("stanza", rf"(?m)^\s*{name}: ([^\r\n]*?)\s*$", 1)


def parse_stanzas(stanzas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, edges) from one stanza per row in column ``stanza``."""
    own = stanzas.where(F.col("stanza").rlike(r"(?m)^\s*\[Term\]\s*$") & (_field("id") != ""))
    terms = own.select(
        _field("id").alias("term"),
        _field("name").alias("name"),
        (F.lower(_field("is_obsolete")) == "true").alias("is_obsolete"),
        _field("replaced_by").alias("replaced_by"),
    )
    parents = F.regexp_extract_all("stanza", F.lit(r"(?m)^\s*is_a: (.*?)\s*(?: ! .*)?$"), 1)
    edges = own.select(_field("id").alias("child"), F.explode(parents).alias("parent")).distinct()
    return terms, edges


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A stanza begins at each line that starts with a bracket, whatever the line
    ends and blank lines, so the file is split in front of those lines."""
    pieces = spark.read.text(path, lineSep="\n[").withColumnRenamed("value", "stanza")
    headed = F.when(F.col("stanza").startswith("["), F.col("stanza")).otherwise(F.concat(F.lit("["), "stanza"))
    return parse_stanzas(pieces.select(headed.alias("stanza")))
