"""Delimited, gzip and JSON readers under explicit contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.text import strip
from pairloom.operators.rules import Rule, duplicate_keys, union_all, violations
from pairloom.runtime import stage
from pairloom.sources.ranges import BLOCK_BYTES, list_files, ranges
from pairloom.sources.records import gzip_blocks, placed, records, scanned


def read_table(
    spark: SparkSession,
    path: str,
    required: Sequence[str],
    sep: str = ",",
    encoding: str = "UTF-8",
    multi_line: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All-text table with a header; a missing required column is an error and
    extra columns are kept. A byte-order mark and blank padding in names are
    tolerated, and every file has the header of the first.

    A quoted cell may hold line breaks. Files up to ``block_bytes`` are read whole, one
    task each; larger ones are cut at record ends (``sources.records``), gzip files at
    their members. Single-member gzip files, files with irregular quotes or line ends and
    encodings other than UTF-8 are read whole at any size. Without such cells,
    ``multi_line=False`` lets Spark split at every line end.
    """
    options = {
        "sep": sep, "header": True, "inferSchema": False, "quote": '"', "escape": '"', "multiLine": multi_line, "encoding": encoding,
    }
    whole = spark.read.options(**options).csv(path)
    df = whole
    if multi_line and encoding.upper().replace("-", "") == "UTF8":
        df = _split_large(spark, whole, path, options, block_bytes)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{path} is missing columns: {', '.join(missing)}")
    return df.fillna("")


#: Endings that Spark unpacks on its own; of these only gzip is cut here.
_PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".zstd")


def _split_large(spark: SparkSession, whole: DataFrame, path: str, options: dict, block_bytes: int) -> DataFrame:
    """``whole`` with its large regular files cut into records. As when Spark plans a
    scan, the driver knows the names of files, and nothing of what is in them."""
    files = [(r["path"], r["bytes"]) for r in list_files(spark, path, recursive=False).collect()]
    large = [f for f in files if f[1] > block_bytes]
    if not large or any("=" in p.removeprefix(path) for p, _ in files):
        return whole
    plain = [f for f in large if not f[0].lower().endswith(_PACKED)]
    packed = [f for f in large if f[0].lower().endswith(".gz")]
    blocks = []
    if plain:
        blocks.append(ranges(spark.createDataFrame(plain, "path string, bytes long"), block_bytes).withColumn("gzip", F.lit(False)))
    if packed:
        members = gzip_blocks(spark.createDataFrame(packed, "path string, bytes long"), block_bytes)
        blocks.append(members.withColumn("gzip", F.lit(True)))
    if not blocks:
        return whole
    known = placed(stage(scanned(union_all(blocks), options["sep"]), "blocks"), options["sep"])
    regular = known.where(~F.col("irregular"))
    cut = {r["path"] for r in regular.where("block = 0").select("path").toLocalIterator()}
    names = whole.columns
    cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(names))), {k: str(options[k]) for k in ("sep", "quote", "escape")})
    parsed = records(regular).select(cells.alias("c")).select(*[F.col(f"c.c{i}").alias(f"c{i}") for i in range(len(names))])
    left = [p for p, _ in files if p not in cut]
    out = parsed.toDF(*names)
    return out.union(spark.read.options(**options).csv(left).toDF(*names)) if left else out


def read_headerless(
    spark: SparkSession, path: str, columns: Sequence[str], patterns: Mapping[str, str] | None = None, sep: str = "\t"
) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): a line must have exactly the columns, each
    matching its pattern. Bad lines keep their content and a reason."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    cells = F.split(F.col("value"), f"\\Q{sep}\\E", -1)
    arity = F.size(cells) == len(columns)
    shaped = F.lit(True)
    for i, name in enumerate(columns):
        pattern = (patterns or {}).get(name)
        if pattern:
            shaped = shaped & strip(F.get(cells, F.lit(i))).rlike(f"^(?:{pattern})$")
    reason = F.when(~arity, F.lit("wrong_column_count")).when(
        ~F.coalesce(shaped, F.lit(False)), F.lit("pattern_mismatch")
    )
    marked = lines.select("value", cells.alias("_c"), reason.alias("reason"))
    good = marked.where(F.col("reason").isNull()).select(
        *[strip(F.get(F.col("_c"), F.lit(i))).alias(n) for i, n in enumerate(columns)]
    )
    return good, marked.where(F.col("reason").isNotNull()).select(F.col("value").alias("line"), "reason")


def read_snapshot(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str],
    key: str,
    rules: Sequence[Rule] = (),
    expected_rows: int | None = None,
    partitions: int | None = None,
    sep: str = "\t",
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(records, violations) of a gzip reference snapshot.

    ``columns`` maps file columns to record columns; ``rules`` are checked on
    the renamed records. A gzip file of one member is read by one task, so the
    rows are spread afterwards.
    """
    raw = read_table(spark, path, list(columns), sep=sep, block_bytes=block_bytes)
    records = raw.select(*[strip(F.col(f"`{src}`")).alias(dst) for src, dst in columns.items()])
    records = records.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = [violations(records, [key], rules)] if rules else []
    found.append(duplicate_keys(records, [key], "duplicate_record"))
    if expected_rows is not None:
        found.append(
            records.agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") != expected_rows)
            .select(
                F.lit("").alias("key"),
                F.lit("row_count_mismatch").alias("rule_id"),
                F.lit("error").alias("severity"),
                F.concat(F.col("n").cast("string"), F.lit(f" of {expected_rows} rows")).alias("message"),
            )
        )
    return records, union_all(found)


def snapshot_rules(taxon: str = "9606") -> list[Rule]:
    """Record rules of a reviewed, single-taxon sequence snapshot."""
    return [
        Rule("not_reviewed", F.lower("reviewed") != "reviewed"),
        Rule("wrong_taxon", F.col("taxid") != taxon),
        Rule(
            "sequence_length_mismatch",
            F.coalesce(F.col("sequence_length").try_cast("bigint"), F.lit(-1)) != F.length("sequence"),
        ),
    ]


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Nested JSON documents, one per file; absent keys are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def scalar_or_list(col, item: str = "string"):
    """A JSON field read as text that may hold one value or a list: array."""
    text = strip(col)
    listed = F.from_json(text, f"array<{item}>")
    single = F.array(text.try_cast(item))
    return F.when(text.isNull() | (text == ""), F.array().cast(f"array<{item}>")).otherwise(
        F.array_distinct(F.when(text.startswith("["), listed).otherwise(single))
    )


def read_variants(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, document, reason) of JSON objects, one a file or one a line, as VARIANT.

    A document that does not parse or is no object stays as a row with a null document
    and the reason; blank lines are left out.
    """
    texts = spark.read.text(path) if lines else spark.read.text(path, wholetext=True)
    texts = texts.where(strip(F.col("value")) != "")
    parsed = texts.select(F.col("_metadata.file_path").alias("file"), "value", F.try_parse_json("value").alias("document"))
    is_object = F.schema_of_variant("document").startswith("OBJECT")
    reason = F.when(F.col("document").isNull(), "invalid_json").when(~is_object, "not_an_object")
    return parsed.select("file", F.when(reason.isNull(), F.col("document")).alias("document"), reason.alias("reason"))


def variant_items(document: Column, path: str, item: str = "$", kind: str = "string") -> Column:
    """The values at ``item`` of a field that may be a list, one value, null or absent, as
    an array of ``kind``; elements that are not of that kind are null."""
    field = F.try_variant_get(document, path, "variant")
    listed = F.try_variant_get(document, path, "array<variant>")
    items = F.when(field.isNull() | F.is_variant_null(field), F.array().cast("array<variant>")).otherwise(
        F.coalesce(listed, F.array(field))
    )
    return F.transform(items, lambda x: F.try_variant_get(x, item, kind))


def variant_number(document: Column, path: str) -> Column:
    """A finite number from a number or numeric text, or from the first of a list of them."""
    first = F.get(variant_items(document, path), F.lit(0))
    number = strip(first).try_cast("double")
    return F.when((number < float("inf")) & (number > float("-inf")), number)


def variant_texts(document: Column, path: str, item: str = "$") -> Column:
    """Distinct texts without padding or blanks, sorted."""
    texts = F.transform(variant_items(document, path, item), strip)
    return F.array_sort(F.array_distinct(F.filter(texts, lambda x: F.coalesce(x, F.lit("")) != "")))
