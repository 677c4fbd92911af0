"""Queries for sources, sinks and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.arrays import STANDARD_ALPHABET, composition, explode_windows, json_map_checks
from pairloom.functions.keys import canonical_pair, selection_key, stable_id, unit_hash
from pairloom.functions.numbers import parse_bool, parse_date, parse_fraction, parse_number, parse_zoned_ts
from pairloom.functions.text import (
    group_ids,
    is_digest,
    isoform_parts,
    publication_ids,
    single_term,
    split_namespace,
    strip_all,
    strip_version,
    terms,
)
from pairloom.operators.rules import Rule, violations
from pairloom.operators.validate import sequence_rules
from pairloom.plans.adapters import (
    IDS_SQL,
    LEDGER_SQL,
    OBS_SQL,
    PAIRS_SQL,
    SEQUENCES_SQL,
    entities,
    identifier_rows,
    ledger,
    observations,
    sequence_entities,
    table,
    unit_sql,
)
from pairloom.plans.catalog import query
from pairloom.runtime import scratch_path
from pairloom.sources.files import audit_sources, read_manifests, validate_registry
from pairloom.sources.manifest import manifest, verify_manifest
from pairloom.sources.ontology import read_ontology
from pairloom.sources.ranges import list_files
from pairloom.sources.sinks import write_gzip_members, write_once
from pairloom.sources.tables import (
    read_headerless,
    read_snapshot,
    read_table,
    read_variants,
    snapshot_rules,
    variant_number,
    variant_texts,
)


# ------------------------------------------------------------ sources, sinks


@query(
    "s1_read_table",
    """
select cast(p_partkey as varchar) as p_partkey, p_name, p_brand, p_type, cast(p_size as varchar) as p_size
from part""",
)
def s1(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    columns = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
    table(spark, d, "part").select(*columns).write.option("header", "true").csv(path)
    return read_table(spark, path, columns)


@query(
    "s1_quoted_records",
    "select cast(doc_id as varchar) as doc_id, source, length(text) as n_chars, md5(text) as text_md5 from documents",
)
def s1_quoted(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with their line breaks as quoted cells, in files of many blocks."""
    path = scratch_path(spark, "csv")
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    docs.write.options(header="true", quoteAll="true", escape='"').csv(path)
    rows = read_table(spark, path, ["doc_id", "text"], block_bytes=1 << 18)
    return rows.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(
    "s2_read_headerless",
    """
select case when o_orderpriority like '1%' then 'wrong_column_count'
            when o_orderstatus = 'P' then 'pattern_mismatch' else 'good' end as outcome,
       count(*) as n
from orders group by 1""",
)
def s2(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    cells = [F.concat(F.lit("K"), "o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")]
    urgent = F.col("o_orderpriority").startswith("1")
    line = F.when(urgent, F.concat_ws("\t", *cells[:2])).otherwise(F.concat_ws("\t", *cells))
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    good, bad = read_headerless(spark, path, ["key", "status", "priority"], {"key": r"K\d+", "status": "[FO]"})
    outcomes = good.select(F.lit("good").alias("outcome")).unionByName(bad.select(F.col("reason").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s3_read_snapshot",
    "with "
    + SEQUENCES_SQL
    + """
select rule_id, count(*) as n from (
  select 'wrong_taxon' as rule_id from proteins where taxid <> '9606'
  union all
  select 'sequence_length_mismatch' from proteins where cast(sequence_length as bigint) <> length(sequence))
group by 1""",
)
def s3(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "snapshot")
    rows = sequence_entities(spark, d).select(
        F.col("entity_id").alias("Entry"),
        F.lit("reviewed").alias("Reviewed"),
        F.col("taxid").alias("Organism (ID)"),
        F.col("sequence_length").alias("Length"),
        F.col("sequence").alias("Sequence"),
    )
    rows.write.option("header", "true").csv(path, sep="\t", compression="gzip")
    names = {
        "Entry": "entity_id",
        "Reviewed": "reviewed",
        "Organism (ID)": "taxid",
        "Length": "sequence_length",
        "Sequence": "sequence",
    }
    _, found = read_snapshot(spark, path, names, "entity_id", snapshot_rules())
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s3_gzip_members",
    """
select rule_id, count(*) as n from (
  select 'wrong_status' as rule_id from orders where o_orderstatus = 'P'
  union all select 'row_count_mismatch' from (select count(*) as n from orders) where n <> 1)
group by 1""",
)
def s3_members(spark: SparkSession, d: str) -> DataFrame:
    """Orders in gzip files of many members, read by ranges of members."""
    path = scratch_path(spark, "members")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    write_gzip_members(orders, path, member_bytes=1 << 15)
    names = {"o_orderkey": "order_id", "o_orderstatus": "status", "o_orderdate": "date"}
    rules = [Rule("wrong_status", ~F.col("status").isin("F", "O"))]
    _, found = read_snapshot(spark, path, names, "order_id", rules, expected_rows=1, block_bytes=1 << 15)
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("s4_json_documents", "select event_id, cast(json_extract(props, '$.k') as integer) as k from events")
def s4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    "s4_variant_documents",
    """
with shaped as (
  select event_id, user_id, event_type, value, event_id % 7 as shape from events)
select case when shape = 5 then null else event_id end as event_id,
       case when shape = 5 then 'invalid_json' end as reason,
       case when shape = 5 then null when shape in (0, 1) then concat(user_id) when shape = 2 then concat(user_id, ';', event_type)
            else '' end as refs,
       case when shape in (0, 1, 2) then user_id % 100 end as first_number,
       case when shape = 5 then null when shape in (2, 6) then concat(user_id % 9) else '' end as taxa
from shaped where shape <> 4
union all select null, 'not_an_object', null, null, null from shaped where shape = 4""",
)
def s4_variants(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON documents of seven shapes: scalars, lists, nulls, absent fields,
    broken text and values that are no objects."""
    user = F.col("user_id").cast("string")
    number = (F.col("user_id") % 100).cast("string")
    taxon = (F.col("user_id") % 9).cast("string")
    shapes = [
        F.format_string('{"id": %s, "refs": %s, "n": %s}', F.col("event_id"), user, number),
        F.format_string('{"id": %s, "refs": ["%s", " ", "%s"], "n": "%s"}', F.col("event_id"), user, user, number),
        F.format_string(
            '{"id": %s, "refs": ["%s", "%s"], "n": [%s, 1], "source": [{"taxon": "%s"}, {"other": 1}, {"taxon": %s}]}',
            F.col("event_id"), F.col("event_type"), user, number, taxon, taxon,
        ),
        F.format_string('{"id": %s, "refs": null, "n": []}', F.col("event_id")),
        F.format_string('["%s"]', user),
        F.format_string('{"id": %s, "refs": ', F.col("event_id")),
        F.format_string('{"id": %s, "n": "none", "source": {"taxon": %s}}', F.col("event_id"), taxon),
    ]
    line = shapes[6]
    for k, shape in enumerate(shapes[:6]):
        line = F.when(F.col("event_id") % 7 == k, shape).otherwise(line)
    path = scratch_path(spark, "json")
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    docs = read_variants(spark, path, lines=True)
    doc = F.col("document")
    # Digits sort before letters, so a sorted list is number, then word.
    return docs.select(
        F.try_variant_get(doc, "$.id", "bigint").alias("event_id"),
        "reason",
        F.when(doc.isNotNull(), F.array_join(variant_texts(doc, "$.refs"), ";")).alias("refs"),
        F.when(doc.isNotNull(), variant_number(doc, "$.n").cast("bigint")).alias("first_number"),
        F.when(doc.isNotNull(), F.array_join(variant_texts(doc, "$.source", "$.taxon"), ";")).alias("taxa"),
    )


@query(
    "s5_read_ontology",
    """
select cast(p_partkey as varchar) as child, cast(p_partkey // 10 as varchar) as parent,
       p_name as name, p_size > 45 as is_obsolete
from part where p_partkey > 0""",
)
def s5(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "ontology")
    stanza = F.concat(
        F.lit("[Term]\nid: "), F.col("p_partkey").cast("string"),
        F.lit("\nname: "), F.col("p_name"),
        F.when(F.col("p_partkey") > 0, F.concat(F.lit("\nis_a: "), F.floor(F.col("p_partkey") / 10).cast("string"), F.lit(" ! parent"))).otherwise(F.lit("")),
        F.when(F.col("p_size") > 45, F.lit("\nis_obsolete: true")).otherwise(F.lit("")),
    )
    # Some stanzas have Windows line ends, and no blank line parts any two.
    windows = F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace(stanza, "\n", "\r\n")).otherwise(stanza)
    table(spark, d, "part").select(windows.alias("value")).write.option("lineSep", "\n").text(path)
    found, edges = read_ontology(spark, path)
    return edges.join(found, edges["child"] == found["term"]).select("child", "parent", "name", "is_obsolete")


ORDER_LINE_SQL = "concat_ws(chr(9), cast(o_orderkey as varchar), o_orderstatus, cast(o_orderdate as varchar)) || chr(10)"


@query(
    "s6_audit_files",
    f"""
with files as (
  select o_orderpriority as db, o_orderstatus as version, sum(strlen({ORDER_LINE_SQL})) as bytes, count(*) as lines,
         sha256(string_agg({ORDER_LINE_SQL}, '' order by o_orderkey)) as sha256
  from orders group by all),
sources as (
  select db || '/' || version as source_id, substr(db, 1, 1) || version as k, cast(bytes as bigint) as bytes, lines, sha256 from files
  union all select distinct o_orderpriority || '/none', 'none', null::bigint, null::bigint, null::varchar from orders)
select source_id, bytes, sha256, lines,
       case when k = 'none' then 'not_acquired' when r = '' then 'pass' else 'fail' end as status, r as reasons
from (select *, case when k = 'none' then '' else concat_ws(';',
    case when k = '1F' then 'byte_count_mismatch' end, case when k in ('1F', '2F') then 'sha256_mismatch' end,
    case when k = '1O' then 'line_count_mismatch' end, case when k = '3F' then 'manifest_missing' end,
    case when k in ('3O', '3P') then 'manifest_invalid' end, case when k = '4F' then 'manifest_source_id_mismatch' end,
    case when k = '4O' then 'manifest_url_mismatch' end, case when k = '5F' then 'manifest_sha256_mismatch' end,
    case when k in ('5F', '5O') then 'manifest_byte_count_mismatch' end,
    case when k = '4P' then 'manifest_time_missing' end, case when k in ('4P', '5P') then 'manifest_license_missing' end) end as r
  from sources)""",
)
def s6(spark: SparkSession, d: str) -> DataFrame:
    """Orders as one file per priority and status; faults in the registry and in manifests."""
    root, told = scratch_path(spark, "raw"), scratch_path(spark, "retrieved")
    orders = table(spark, d, "orders").select(
        F.regexp_replace("o_orderpriority", " ", "_").alias("db"), F.col("o_orderstatus").alias("version"), "o_orderkey",
        F.concat_ws("\t", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("string")).alias("value"),
    )
    one_file = orders.repartition("db", "version").sortWithinPartitions("db", "version", "o_orderkey")
    one_file.select("db", "version", "value").write.partitionBy("db", "version").text(root)
    step = lambda path, back: F.regexp_extract(F.element_at(F.split(path, "/"), -back), "=(.*)", 1)
    files = list_files(spark, root, "*.txt").withColumn("location", F.concat_ws("/", step("path", 3), step("path", 2)))

    # The registry and the manifests as a fetcher would have noted them, then the faults.
    line = F.concat("value", F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line"))))
    noted = orders.groupBy("db", "version").agg(
        F.sum(F.octet_length(line)).alias("bytes"), F.count(F.lit(1)).alias("lines"),
        F.sha2(F.array_join(F.transform(ordered, lambda x: x["line"]), ""), 256).alias("sha256"),
    )
    absent = noted.select("db").distinct().selectExpr("db", "'none' AS version", "1L AS bytes", "1L AS lines", "repeat('0', 64) AS sha256")
    k = F.concat(F.substring("db", 1, 1), "version")
    spoilt = F.lit("0" * 64)
    registry = noted.unionByName(absent).select(
        F.concat_ws("/", "db", "version").alias("source_id"), F.concat_ws("/", "db", "version").alias("location"),
        F.lit("https://example.org").alias("url"),
        F.when(k == "1F", F.col("bytes") + 1).otherwise(F.col("bytes")).alias("expected_bytes"),
        F.when(k.isin("1F", "2F"), spoilt).otherwise(F.col("sha256")).alias("expected_sha256"),
        F.when(k == "1O", F.col("lines") + 1).otherwise(F.col("lines")).alias("expected_lines"),
    )
    written = noted.where(k != "3F").select(
        F.concat_ws("/", "db", "version").alias("source_id"), "db", "version",
        F.when(k == "3O", F.lit("{no json")).when(k == "3P", F.lit("[1]")).otherwise(
            F.to_json(F.struct(
                F.when(k == "4F", F.lit("other")).otherwise(F.concat_ws("/", "db", "version")).alias("source_id"),
                F.when(k == "4O", F.lit("https://example.org/x")).otherwise(F.lit("https://example.org")).alias("registry_url"),
                F.when(k == "4P", F.lit(" ")).otherwise(F.lit("2024-01-01T00:00:00Z")).alias("retrieved_at"),
                F.when(~k.isin("4P", "5P"), F.lit("open")).alias("license_status"),
                F.struct(
                    F.when(k == "5F", spoilt).otherwise(F.col("sha256")).alias("sha256"),
                    F.when(k.isin("5F", "5O"), F.col("bytes") - 1).otherwise(F.col("bytes")).alias("bytes"),
                ).alias("observed"),
            ))
        ).alias("value"),
    )
    written.repartition("db", "version").select("db", "version", "value").write.partitionBy("db", "version").text(told)
    manifests = read_manifests(spark, told).withColumn("source_id", F.concat_ws("/", step("file", 3), step("file", 2)))
    found = audit_sources(registry, files, manifests)
    return found.withColumn("source_id", F.regexp_replace("source_id", "_", " "))


@query(
    "s7_validate_registry",
    """
with registry as (
  select case when s_nationkey = 3 then '' else s_name end as source_id,
         s_acctbal as bytes, s_nationkey, s_suppkey from supplier)
select rule_id, count(*) as n from (
  select 'missing_source_id' as rule_id from registry where source_id = ''
  union all select 'expected_bytes_not_positive' from registry where floor(bytes) <= 0
  union all select 'expected_sha256_invalid' from registry where s_nationkey = 7
  union all select 'unknown_download_class' from registry where s_nationkey > 20
  union all select 'missing_licence' from registry where s_nationkey = 11
  union all select 'duplicate_source' from (select source_id from registry group by 1 having count(*) > 1))
group by 1""",
)
def s7(spark: SparkSession, d: str) -> DataFrame:
    nation = F.col("s_nationkey")
    registry = table(spark, d, "supplier").select(
        F.when(nation == 3, F.lit("")).otherwise(F.col("s_name")).alias("source_id"),
        F.concat(F.lit("f"), F.col("s_suppkey").cast("string"), F.lit(".tsv")).alias("filename"),
        F.lit("https://example.org/x").alias("url"),
        F.floor("s_acctbal").alias("expected_bytes"),
        F.when(nation == 7, F.lit("nothex")).when(nation > 7, F.sha2("s_name", 256)).alias("expected_sha256"),
        F.lit(None).cast("bigint").alias("expected_lines"),
        F.when(nation > 20, F.lit("other")).otherwise(F.lit("core")).alias("download_class"),
        F.when(nation == 11, F.lit(" ")).otherwise(F.lit("open")).alias("license_status"),
        F.lit("cited").alias("citation"),
    )
    return validate_registry(registry).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("s8_write_once", "select c_custkey, c_name, c_mktsegment from customer")
def s8(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "once")
    write_once(table(spark, d, "customer"), path, ["c_custkey"], ["c_custkey", "c_name", "c_mktsegment"])
    return spark.read.parquet(path)


def fingerprint_sql(name: str, cols: dict[str, str], source: str) -> str:
    """``cols``: the SQL text of every column, by name."""
    cells = ", ".join(f"coalesce(concat(length({c}), ':', {c}), '-')" for _, c in sorted(cols.items()))
    row = f"sha256(concat_ws(chr(31), {cells}))"
    words = ", ".join(
        f"coalesce(sum(cast(concat('0x', substr({row}, {at}, 15)) as bigint)), 0)::varchar" for at in (1, 16)
    )
    names = ", ".join(f"'{n}'" for n in sorted(cols))
    return (
        f"select '{name}' as \"table\", count(*) as rows, "
        f"sha256(concat_ws(chr(31), {names}, {words})) as fingerprint from {source}"
    )


CUSTOMER_COLS = {"c_custkey": "cast(c_custkey as varchar)", "c_mktsegment": "c_mktsegment", "c_name": "c_name"}
NATION_COLS = {"n_name": "n_name", "n_nationkey": "cast(n_nationkey as varchar)"}
# Null turned blank, and a renamed column, are changes.
PART_COLS = {"p_brand": "p_brand", "p_name": "case when p_size > 40 then null else p_name end"}
PART_BLANK = {"p_brand": "p_brand", "p_name": "case when p_size > 40 then '' else p_name end"}


@query(
    "s9_manifest",
    fingerprint_sql("customer", CUSTOMER_COLS, "customer")
    + " union all "
    + fingerprint_sql("nation", NATION_COLS, "nation"),
)
def s9(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    nation = table(spark, d, "nation").select("n_name", "n_nationkey")
    return manifest({"customer": customer, "nation": nation})


@query(
    "s10_verify_manifest",
    "with was as ("
    + fingerprint_sql("customer", CUSTOMER_COLS, "customer")
    + " union all "
    + fingerprint_sql("nation", NATION_COLS, "nation")
    + " union all "
    + fingerprint_sql("supplier", {"s_name": "s_name"}, "supplier")
    + " union all "
    + fingerprint_sql("part", PART_COLS, "part")
    + " union all "
    + fingerprint_sql("orders", {"o_orderstatus": "o_orderstatus"}, "orders")
    + "), now as ("
    + fingerprint_sql("customer", CUSTOMER_COLS, "customer")
    + " union all "
    + fingerprint_sql("nation", {**NATION_COLS, "n_name": "lower(n_name)"}, "nation")
    + " union all "
    + fingerprint_sql("region", {"r_name": "r_name"}, "region")
    + " union all "
    + fingerprint_sql("part", PART_BLANK, "part")
    + " union all "
    + fingerprint_sql("orders", {"status": "o_orderstatus"}, "orders")
    + """)
select coalesce(w."table", n."table") as "table",
       case when n.rows is null then 'missing' when w.rows is null then 'unlisted'
            when n.rows <> w.rows then 'row_count_changed' else 'content_changed' end as issue
from was w full join now n on w."table" = n."table"
where w.fingerprint is distinct from n.fingerprint""",
)
def s10(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    nation = table(spark, d, "nation").select("n_name", "n_nationkey")
    supplier, statuses = table(spark, d, "supplier").select("s_name"), table(spark, d, "orders").select("o_orderstatus")
    part = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") <= 40, F.col("p_name")).alias("p_name"))
    before = manifest({"customer": customer, "nation": nation, "supplier": supplier, "part": part, "orders": statuses})
    after = {
        "customer": customer,
        "nation": nation.withColumn("n_name", F.lower("n_name")),
        "region": table(spark, d, "region").select("r_name"),
        "part": part.fillna("", ["p_name"]),
        "orders": statuses.withColumnRenamed("o_orderstatus", "status"),
    }
    return verify_manifest(before, after)


# ---------------------------------------------------------------- text cells

SPACE = r"[\s\pZ\x0b\x1c-\x1f\x{85}]"


@query(
    "x1_strip_all",
    rf"""
with padded as (
  select conv_id, turn, case when turn % 3 = 0 then '  ' else role end as role,
         concat(' {{t}}', text, chr(10), ' ') as text from conversations)
select conv_id, turn, coalesce(nullif(trim(role), ''), '(null)') as role,
       sha256(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')) as digest
from padded""".replace("{t}", "\t"),
)
def x1(spark: SparkSession, d: str) -> DataFrame:
    padded = table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 3 == 0, F.lit("  ")).otherwise(F.col("role")).alias("role"),
        F.concat(F.lit(" \t"), "text", F.lit("\n ")).alias("text"),
    )
    return strip_all(padded, optional=["role"]).select(
        "conv_id", "turn", F.coalesce("role", F.lit("(null)")).alias("role"), F.sha2("text", 256).alias("digest")
    )


@query(
    "x2_parse_number",
    """
with cells as (
  select event_type, case event_type
    when 'error' then concat(cast(event_id as varchar), 'x')
    when 'view' then concat(' ', cast(event_id as varchar), '.25 ')
    when 'signup' then case when user_id % 2 = 0 then '' else concat('-', cast(event_id as varchar)) end
    when 'click' then concat(cast(event_id as varchar), 'e1')
    else 'inf' end as cell
  from events),
typed as (
  select event_type, trim(cell) as t,
         case when regexp_full_match(trim(cell), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?')
              then cast(trim(cell) as double) end as v from cells)
select event_type, count(*) as n,
       count(*) filter (where v between 0 and 50000) as n_valued,
       count(*) filter (where t = '' or v between 0 and 50000) as n_ok,
       round(coalesce(sum(v) filter (where v between 0 and 50000), 0), 6) as total
from typed group by 1""",
)
def x2(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("event_id").cast("string")
    kind = F.col("event_type")
    cell = (
        F.when(kind == "error", F.concat(number, F.lit("x")))
        .when(kind == "view", F.concat(F.lit(" "), number, F.lit(".25 ")))
        .when(kind == "signup", F.when(F.col("user_id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), number)))
        .when(kind == "click", F.concat(number, F.lit("e1")))
        .otherwise(F.lit("inf"))
    )
    parsed = table(spark, d, "events").select("event_type", parse_number(cell, 0, 50000, allow_blank=True).alias("p"))
    return parsed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("p.value").alias("n_valued"),
        F.count_if("p.ok").alias("n_ok"),
        F.round(F.coalesce(F.sum("p.value"), F.lit(0.0)), 6).alias("total"),
    )


@query(
    "x3_parse_fraction",
    """
with cells as (
  select p_partkey, case when p_type = 'ECONOMY' then p_size / 100.0::double
                         when p_brand = 'Brand#1' then p_size * 10.0::double else p_size::double end as v from part)
select p_partkey, case when v > 1 and v <= 100 then round(v / 100, 9) when v <= 1 then round(v, 9) else -1.0 end as fraction,
       v <= 100 as ok
from cells""",
)
def x3(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    cell = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("0."), F.lpad(size, 2, "0")))
        .when(F.col("p_brand") == "Brand#1", F.concat(size, F.lit("0")))
        .otherwise(size)
    )
    return table(spark, d, "part").select("p_partkey", parse_fraction(cell).alias("f")).select(
        "p_partkey", F.round(F.coalesce("f.value", F.lit(-1.0)), 9).alias("fraction"), F.col("f.ok").alias("ok")
    )


@query(
    "x4_parse_bool",
    """
select case o_orderstatus when 'O' then 'true' when 'F' then 'false' else '(null)' end as parsed, count(*) as n
from orders group by 1""",
)
def x4(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    cell = F.when(status == "O", F.lit(" True\t")).when(status == "F", F.lit("FALSE")).otherwise(F.lit("yes"))
    parsed = F.coalesce(parse_bool(cell).cast("string"), F.lit("(null)"))
    return table(spark, d, "orders").groupBy(parsed.alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x5_parse_times",
    """
select event_type,
       count(*) filter (where event_type in ('view', 'click', 'signup')) as n_zoned,
       cast(coalesce(sum(cast(floor(epoch(ts)) as bigint) - case when event_type = 'click' then 7200 else 0 end)
            filter (where event_type in ('view', 'click', 'signup')), 0) as bigint) as epoch_sum,
       count(distinct cast(ts as date)) filter (where event_type <> 'error') as n_dates
from events group by 1""",
)
def x5(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    cell = (
        F.when(kind.isin("view", "signup"), F.concat(stamp, F.lit("Z")))
        .when(kind == "click", F.concat(stamp, F.lit("+02:00")))
        .when(kind == "purchase", stamp)
        .otherwise(F.lit("notatimeZ"))
    )
    day = F.when(kind == "error", F.date_format("ts", "yyyy/MM/dd")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    parsed = table(spark, d, "events").select("event_type", parse_zoned_ts(cell).alias("t"), parse_date(day).alias("day"))
    return parsed.groupBy("event_type").agg(
        F.count("t").alias("n_zoned"),
        F.coalesce(F.sum(F.unix_seconds("t")), F.lit(0)).alias("epoch_sum"),
        F.count_distinct("day").alias("n_dates"),
    )


@query(
    "x6_is_digest",
    "with " + LEDGER_SQL + """
select method, count(*) filter (where length(stdout_sha256) = 64) as n_ok,
       count(*) filter (where length(stdout_sha256) <> 64) as n_bad from ledger group by 1""",
)
def x6(spark: SparkSession, d: str) -> DataFrame:
    ok = is_digest(F.upper("stdout_sha256"))
    return ledger(spark, d).groupBy("method").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_bad"))


@query(
    "x7_terms",
    "with " + OBS_SQL + """,
cells as (
  select concat(detection_method, '(a)|', interaction_type, '|', detection_method,
                case when polarity = 'negative' then '|none' else '' end) as cell, detection_method as own from named)
select array_to_string(list_sort(list_distinct(regexp_extract_all(cell, 'MI:\\d{4}'))), ';') as found,
       case when len(list_distinct(regexp_extract_all(own, 'MI:\\d{4}'))) = 1 then own else '' end as single,
       count(*) as n
from cells group by 1, 2""",
)
def x7(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat(
        "detection_method", F.lit("(a)|"), "interaction_type", F.lit("|"), "detection_method",
        F.when(F.col("polarity") == "negative", F.lit("|none")).otherwise(F.lit("")),
    )
    return observations(spark, d).groupBy(
        F.array_join(terms(cell), ";").alias("found"), single_term(F.col("detection_method")).alias("single")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x8_publication_ids",
    """
with cells as (
  select concat('PubMed:', cast(l_orderkey % 90 as varchar), '|pubmed:', cast(l_partkey % 90 as varchar), '|doi:1') as cell
  from lineitem)
select array_to_string([concat('PMID:', x) for x in list_sort(list_distinct(regexp_extract_all(cell, '(?i)pubmed:(\\d+)', 1)))], ';') as ids,
       count(*) as n
from cells group by 1""",
)
def x8(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat(
        F.lit("PubMed:"), (F.col("l_orderkey") % 90).cast("string"),
        F.lit("|pubmed:"), (F.col("l_partkey") % 90).cast("string"), F.lit("|doi:1"),
    )
    return table(spark, d, "lineitem").groupBy(publication_ids(cell).alias("ids")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x9_split_namespace",
    """
with cells as (
  select page_id, case when page_id % 4 = 0 then 'plain|a:b' else concat(upper(url), ' |x:y') end as cell from pages),
tokens as (select page_id, split_part(cell, '|', 1) as token from cells)
select page_id, case when instr(token, ':') = 0 then 'unknown' else lower(split_part(token, ':', 1)) end as namespace,
       case when instr(token, ':') = 0 then token else trim(substr(token, instr(token, ':') + 1)) end as identifier
from tokens""",
)
def x9(spark: SparkSession, d: str) -> DataFrame:
    cell = F.when(F.col("page_id") % 4 == 0, F.lit("plain|a:b")).otherwise(F.concat(F.upper("url"), F.lit(" |x:y")))
    return table(spark, d, "pages").select("page_id", split_namespace(cell).alias("s")).select("page_id", "s.*")


@query(
    "x10_isoform_parts",
    "with " + IDS_SQL + """
select raw_a, split_part(raw_a, '-', 1) as base_id, contains(raw_a, '-') as isoform_specific,
       case when contains(raw_a, '-') then 'quarantine_isoform_specific' else 'mapping_candidate' end as status,
       count(*) as n
from ids group by all""",
)
def x10(spark: SparkSession, d: str) -> DataFrame:
    counted = identifier_rows(spark, d).groupBy("raw_a").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("raw_a", isoform_parts(F.col("raw_a")).alias("p"), "n").select("raw_a", "p.*", "n")


@query(
    "x11_strip_version",
    """
select p_partkey, case when p_type = 'PROMO' then '(null)'
  else concat('ENSG', lpad(cast(p_partkey as varchar), 11, '0')) end as gene from part""",
)
def x11(spark: SparkSession, d: str) -> DataFrame:
    gene = F.concat(F.lit("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0"))
    cell = (
        F.when(F.col("p_type") == "PROMO", F.concat(gene, F.lit("-1")))
        .when(F.col("p_size") > 25, F.concat(gene, F.lit("."), F.col("p_size").cast("string")))
        .otherwise(gene)
    )
    found = strip_version(cell, r"ENSG\d{11}")
    return table(spark, d, "part").select("p_partkey", F.coalesce(found, F.lit("(null)")).alias("gene"))


@query(
    "x12_group_ids",
    """
with cells as (
  select o_orderkey, concat('x|rcsb pdb:', lpad(cast(o_orderkey % 9999 as varchar), 4, '0'),
                            '|RCSB PDB:a', lpad(cast(o_custkey % 999 as varchar), 3, '0')) as cell from orders)
select o_orderkey, array_to_string(list_sort(list_distinct(
         [upper(x) for x in regexp_extract_all(cell, '(?i)rcsb pdb:([0-9A-Za-z]{4})', 1)])), ';') as ids
from cells""",
)
def x12(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat(
        F.lit("x|rcsb pdb:"), F.lpad((F.col("o_orderkey") % 9999).cast("string"), 4, "0"),
        F.lit("|RCSB PDB:a"), F.lpad((F.col("o_custkey") % 999).cast("string"), 3, "0"),
    )
    found = group_ids(cell, r"(?i)rcsb pdb:([0-9A-Za-z]{4})")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(found, ";").alias("ids"))


@query("x13_canonical_pair", "with " + OBS_SQL + " select pair_id, node_a, node_b, count(*) as n from named group by all")
def x13(spark: SparkSession, d: str) -> DataFrame:
    raw = observations(spark, d).select(canonical_pair(F.col("raw_b"), F.col("raw_a"), "PAIR").alias("p"))
    return raw.groupBy("p.pair_id", "p.node_a", "p.node_b").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x14_stable_id",
    "with " + OBS_SQL + """,
ids as (
  select detection_method, concat('EVI_', substr(sha256(concat_ws(chr(31), source_database, source_version,
           source_record_id, pair_id, polarity, detection_method)), 1, 20)) as id from named)
select detection_method, min(id) as first_id, max(id) as last_id, count(distinct id) as n_ids from ids group by 1""",
)
def x14(spark: SparkSession, d: str) -> DataFrame:
    parts = ["source_database", "source_version", "source_record_id", "pair_id", "polarity", "detection_method"]
    ids = observations(spark, d).select("detection_method", stable_id("EVI", *[F.col(p) for p in parts]).alias("id"))
    return ids.groupBy("detection_method").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_distinct("id").alias("n_ids")
    )


@query(
    "x15_unit_hash",
    "with " + PAIRS_SQL + " select cluster_id, " + unit_sql("concat('0:', cluster_id)") + " as u, count(*) as n from nodes group by 1",
)
def x15(spark: SparkSession, d: str) -> DataFrame:
    sized = entities(spark, d).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sized.select("cluster_id", unit_hash(0, F.col("cluster_id")).alias("u"), "n")


@query(
    "x16_selection_key",
    """
with keyed as (
  select o_orderpriority, sha256(concat('20260915:', o_orderpriority, ':', cast(o_orderkey as varchar))) as k from orders)
select o_orderpriority, min(k) as first_key, max(k) as last_key from keyed group by 1""",
)
def x16(spark: SparkSession, d: str) -> DataFrame:
    key = selection_key(20260915, F.col("o_orderpriority"), F.col("o_orderkey"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key")
    )


@query(
    "x17_composition",
    f"""
with up as (select doc_id, upper(replace(text, 'ß', 'SS')) as t from documents),
sized as (select doc_id, t, length(regexp_replace(t, '[^{STANDARD_ALPHABET}]', '', 'g')) as total from up)
select doc_id, letter, round((length(t) - length(replace(t, letter, ''))) / total, 12) as share
from sized, unnest(string_split('{STANDARD_ALPHABET}', '')) as l(letter)
where total > 0""",
)
def x17(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "documents").select("doc_id", composition(F.col("text")).alias("v"))
    letters = F.array(*[F.lit(c) for c in STANDARD_ALPHABET])
    return vectors.select("doc_id", F.posexplode("v").alias("i", "share")).select(
        "doc_id", F.element_at(letters, F.col("i") + 1).alias("letter"), F.round("share", 12).alias("share")
    )


@query(
    "x18_sequence_checks",
    "with " + SEQUENCES_SQL + """
select entity_id as key, rule_id, severity from (
  select entity_id, 'invalid_sequence' as rule_id, 'error' as severity from proteins where sequence = ''
  union all select entity_id, 'sequence_length_mismatch', 'error' from proteins
    where cast(sequence_length as bigint) <> length(sequence)
  union all select entity_id, 'sequence_digest_mismatch', 'error' from proteins where sequence_sha256 <> sha256(sequence)
  union all select entity_id, 'ambiguous_letters', 'warning' from proteins where regexp_matches(sequence, '[BXZJUO]'))""",
)
def x18(spark: SparkSession, d: str) -> DataFrame:
    return violations(sequence_entities(spark, d), ["entity_id"], sequence_rules()).select("key", "rule_id", "severity")


@query(
    "x19_windows",
    """
with sized as (select doc_id, text, length(text) as n from documents where length(text) > 0),
starts as (
  select doc_id, text, n, unnest(range(0, cast(greatest(0, ceil((n - 512) / 256.0)) as bigint) * 256 + 1, 256)) as s
  from sized)
select doc_id, cast(s // 256 as bigint) as window_index, s as window_start,
       s + 512 >= n as is_last, sha256(substr(text, s + 1, 512)) as digest
from starts""",
)
def x19(spark: SparkSession, d: str) -> DataFrame:
    rows = explode_windows(table(spark, d, "documents").select("doc_id", "text"), "text", 512, 256)
    return rows.select(
        "doc_id",
        F.col("window_index").cast("bigint"),
        F.col("window_start").cast("bigint"),
        "is_last",
        F.sha2("window_text", 256).alias("digest"),
    )


@query(
    "x20_json_map_checks",
    """
with cells as (
  select event_type, user_id, case when event_type = 'error' then 0 when event_type = 'view' then 1 else 2 end as keys,
         event_type as a, case when user_id % 3 = 0 then event_type when user_id % 5 = 0 then ' ' else concat('u', cast(user_id as varchar)) end as b
  from events)
select event_type, count(*) as n,
       count(*) filter (where keys > 0) as parsed,
       count(*) filter (where keys = 2) as enough_keys,
       count(*) filter (where keys = 1 or (keys = 2 and trim(b) <> '')) as values_filled,
       count(*) filter (where keys = 2 and a <> trim(b)) as values_differ
from cells group by 1""",
)
def x20(spark: SparkSession, d: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    second = (
        F.when(user % 3 == 0, kind).when(user % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("u"), user.cast("string")))
    )
    cell = (
        F.when(kind == "error", F.lit("not json"))
        .when(kind == "view", F.to_json(F.create_map(F.lit("A"), kind)))
        .otherwise(F.to_json(F.create_map(F.lit("A"), kind, F.lit("B"), second)))
    )
    checked = table(spark, d, "events").select("event_type", json_map_checks(cell).alias("c"))
    return checked.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(f"c.{n}").alias(n) for n in ("parsed", "enough_keys", "values_filled", "values_differ")],
    )
