"""Files and their retrieval manifests against a registry of expected files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import is_digest, strip
from pairloom.operators.rules import Rule, duplicate_keys, union_all, violations
from pairloom.sources.digests import whole_digests
from pairloom.sources.ranges import list_files

# Allowed download classes.
DOWNLOAD_CLASSES = ("core", "restricted_core", "large")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(filename, bytes) per file; the contents are not read. Whether the rows of
    a table are the expected ones is told by ``sources.manifest``."""
    return list_files(spark, path).select("filename", "bytes")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(filename, lines) of text files, counted by splittable scans."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return lines.groupBy(name.alias("filename")).agg(F.count(F.lit(1)).alias("lines"))


def audit_files(inventory: DataFrame, registry: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(source_id, filename, status, reasons) for every registered file.

    ``registry`` has expected_bytes and expected_lines (nullable). Status is
    pass, fail or not_acquired.
    """
    seen = inventory
    if lines is not None:
        seen = seen.join(lines, "filename", "left")
    else:
        seen = seen.withColumn("lines", F.lit(None).cast("bigint"))
    both = registry.join(seen, "filename", "left")
    absent = F.col("bytes").isNull()
    reasons = F.array_compact(
        F.array(
            F.when(F.col("bytes") != F.col("expected_bytes"), F.lit("byte_count_mismatch")),
            F.when(F.col("lines") != F.col("expected_lines"), F.lit("line_count_mismatch")),
        )
    )
    found = F.when(absent, F.array().cast("array<string>")).otherwise(reasons)
    return both.select(
        "source_id",
        "filename",
        F.when(absent, F.lit("not_acquired"))
        .when(F.size(found) == 0, F.lit("pass"))
        .otherwise(F.lit("fail"))
        .alias("status"),
        F.array_join(found, ";").alias("reasons"),
    )


#: What a retrieval manifest says.
_RETRIEVED = "struct<source_id:string,registry_url:string,retrieved_at:string,license_status:string,observed:struct<sha256:string,bytes:bigint>>"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(file, manifest): retrieval manifests, one JSON object a file. One that is not
    an object is a row with a null manifest."""
    texts = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    object_only = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    manifest = F.when(object_only, F.from_json("value", _RETRIEVED))
    return texts.select(F.col("_metadata.file_path").alias("file"), manifest.alias("manifest"))


def audit_sources(registry: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(source_id, status, reasons, bytes, sha256, lines) of every registered source.

    ``registry``: source_id, location (the end of the file's path), url, expected_bytes,
    and expected_sha256 and expected_lines, which may be null. ``files``: location, path,
    bytes. ``manifests``: source_id and the manifest, null where it is invalid. Every
    registered file is digested in one pass, whatever else is below the root. Status is
    pass, fail or not_acquired; reasons name all findings in a fixed order.
    """
    wanted = registry.select("location").distinct()
    present = files.join(wanted, "location", "left_semi")
    seen = present.join(whole_digests(present), "path").select("location", "bytes", "sha256", "lines")
    told = manifests.select(F.col("source_id"), F.lit(True).alias("_told"), F.col("manifest").alias("m"))
    both = registry.join(seen, "location", "left").join(told, "source_id", "left")
    absent, m = F.col("bytes").isNull(), F.col("m")
    read = F.coalesce(F.col("_told"), F.lit(False)) & m.isNotNull()
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    checks = {
        "byte_count_mismatch": F.col("bytes") != F.col("expected_bytes"),
        "sha256_mismatch": F.col("sha256") != F.col("expected_sha256"),
        "line_count_mismatch": F.col("lines") != F.col("expected_lines"),
        "manifest_missing": F.col("_told").isNull(),
        "manifest_invalid": F.col("_told").isNotNull() & m.isNull(),
        "manifest_source_id_mismatch": read & ~m["source_id"].eqNullSafe(F.col("source_id")),
        "manifest_url_mismatch": read & ~m["registry_url"].eqNullSafe(F.col("url")),
        "manifest_sha256_mismatch": read & ~m["observed"]["sha256"].eqNullSafe(F.col("sha256")),
        "manifest_byte_count_mismatch": read & ~m["observed"]["bytes"].eqNullSafe(F.col("bytes")),
        "manifest_time_missing": read & blank(m["retrieved_at"]),
        "manifest_license_missing": read & blank(m["license_status"]),
    }
    found = F.array_compact(F.array(*[F.when(when, F.lit(reason)) for reason, when in checks.items()]))
    status = F.when(absent, "not_acquired").when(F.size(found) == 0, "pass").otherwise("fail")
    reasons = F.when(absent, "").otherwise(F.array_join(found, ";"))
    return both.select("source_id", status.alias("status"), reasons.alias("reasons"), "bytes", "sha256", "lines")


def validate_registry(registry: DataFrame) -> DataFrame:
    """Contract of the registry itself."""
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    rules = [
        Rule("missing_source_id", blank("source_id")),
        Rule("filename_not_plain", blank("filename") | F.col("filename").contains("/") | F.col("filename").isin(".", "..")),
        Rule("url_not_allowed", ~F.coalesce(F.col("url").rlike("^(https|file)://"), F.lit(False))),
        Rule("expected_bytes_not_positive", F.coalesce(F.col("expected_bytes") <= 0, F.lit(True))),
        Rule("expected_sha256_invalid", F.col("expected_sha256").isNotNull() & ~is_digest(F.col("expected_sha256"))),
        Rule("expected_lines_not_positive", F.col("expected_lines") <= 0),
        Rule("unknown_download_class", ~F.coalesce(F.col("download_class").isin(*DOWNLOAD_CLASSES), F.lit(False))),
        Rule("missing_licence", blank("license_status")),
        Rule("missing_citation", blank("citation")),
    ]
    return union_all(
        [violations(registry, ["source_id"], rules), duplicate_keys(registry, ["source_id"], "duplicate_source")]
    )
