"""Queries for pair building, graphs, profiles and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.graph import attach_groups, closure, compile_policy, complex_groups
from pairloom.operators.ledger import (
    distribution,
    distributions,
    gpu_models,
    ledger_coverage,
    ledger_items,
    ledger_runs,
    ledger_status,
    listed_ids,
    set_coverage,
    validate_ledger,
)
from pairloom.operators.pairs import dedupe_evidence, label_pairs, split_ambiguous, with_evidence_id
from pairloom.operators.profile import cluster_stats, count_summary, funnel, profile_pairs, top_k
from pairloom.plans.adapters import (
    KEPT_SQL,
    LEDGER_SQL,
    OBS_SQL,
    PAIRS_SQL,
    entities,
    expected_items,
    labelled_pairs,
    ledger,
    observations,
    table,
)
from pairloom.plans.catalog import query

# ------------------------------------------------------------------- pairs


@query(
    "a1_label_pairs",
    "with " + PAIRS_SQL + """
select pair_id, node_a, node_b, coalesce(cast(label as varchar), '') as label, evidence_class, pair_status,
       exclusion_reason, n_evidence from pairs""",
)
def a1(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = split_ambiguous(observations(spark, d))
    return label_pairs(kept).withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("")))


@query(
    "a2_ambiguous_records",
    "with " + KEPT_SQL + """
select source_record_id, 'kept' as outcome, count(*) as n from kept group by 1
union all
select source_record_id, 'source_record_maps_to_multiple_normalized_pairs', count(*) from named
where source_record_id in (select source_record_id from ambiguous) group by 1""",
)
def a2(spark: SparkSession, d: str) -> DataFrame:
    kept, rejected = split_ambiguous(observations(spark, d))
    rows = kept.select("source_record_id", F.lit("kept").alias("outcome")).unionByName(
        rejected.select("source_record_id", F.col("quarantine_reason").alias("outcome"))
    )
    return rows.groupBy("source_record_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a3_dedupe_evidence",
    "with " + KEPT_SQL + """,
ids as (
  select distinct concat('EVI_', substr(sha256(concat_ws(chr(31), source_database, source_version, source_record_id,
           pair_id, polarity, detection_method)), 1, 20)) as evidence_id, pair_id, polarity, interaction_type
  from kept)
select evidence_id as key, 'distinct' as outcome, count(*) as n from ids group by 1
union all
select evidence_id, 'evidence_id_collision', 1 from ids group by 1 having count(*) > 1""",
)
def a3(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = split_ambiguous(observations(spark, d))
    rows = with_evidence_id(kept).select("evidence_id", "pair_id", "polarity", "interaction_type")
    distinct, collisions = dedupe_evidence(rows)
    counted = distinct.groupBy(F.col("evidence_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("key", F.lit("distinct").alias("outcome"), "n").unionByName(
        collisions.select("key", F.col("rule_id").alias("outcome"), F.lit(1).cast("bigint").alias("n"))
    )


@query(
    "a4_complex_groups",
    "with recursive " + KEPT_SQL.strip() + """,
links as (select distinct pair_id, group_id from kept where group_id <> ''),
hops as (select distinct a.group_id as g, b.group_id as h from links a join links b on a.pair_id = b.pair_id),
reach(g, h) as (
  select g, h from hops union select r.g, x.h from reach r join hops x on r.h = x.g),
roots as (select g, min(h) as root from reach group by 1),
names as (
  select root, case when count(*) = 1 then concat('PDB_', min(g))
                    else concat('PDB_COMPONENT_', substr(sha256(string_agg(g, ';' order by g)), 1, 12)) end as name
  from roots group by 1)
select distinct l.pair_id, n.name as complex_group_id
from links l join roots r on l.group_id = r.g join names n on r.root = n.root
union all
select distinct pair_id, '' from kept where pair_id not in (select pair_id from links)""",
)
def a4(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = split_ambiguous(observations(spark, d))
    links = kept.where(F.col("group_id") != "").select("pair_id", "group_id")
    groups = complex_groups(links)
    return attach_groups(kept.select("pair_id").distinct(), groups).select("pair_id", "complex_group_id")


def ontology_edges(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").where(F.col("p_partkey") > 0)
    return part.select(
        F.col("p_partkey").cast("string").alias("child"),
        F.floor(F.col("p_partkey") / 10).cast("string").alias("parent"),
    )


@query(
    "a5_closure",
    """
with recursive edges as (
  select cast(p_partkey as varchar) as child, cast(p_partkey // 10 as varchar) as parent from part where p_partkey > 0),
below(term) as (
  select unnest(['3', '17', '170']) union select e.child from below b join edges e on e.parent = b.term)
select term from below""",
)
def a5(spark: SparkSession, d: str) -> DataFrame:
    edges = ontology_edges(spark, d)
    roots = edges.where(F.col("child").isin("3", "17", "170")).select(F.col("child").alias("term"))
    return closure(edges, roots)


POLICY_ROWS = [
    ("type_accept", "1"),
    ("type_never", "2"),
    ("method_accept", "3"),
    ("method_never", "4"),
    ("method_never", "35"),
    ("method_manual", "31"),
    ("method_manual", "50"),
]


@query(
    "a5_compile_policy",
    """
with recursive edges as (
  select cast(p_partkey as varchar) as child, cast(p_partkey // 10 as varchar) as parent from part where p_partkey > 0),
obsolete as (select cast(p_partkey as varchar) as term from part where p_size > 45),
policy(section, term) as (values """
    + ", ".join(f"('{s}', '{t}')" for s, t in POLICY_ROWS)
    + """),
closed(root, term) as (
  select section, term from policy where section in ('type_accept', 'method_accept', 'method_never')
  union select c.root, e.child from closed c join edges e on e.parent = c.term)
select 'type_accept' as term_set, '1' as term
union all select 'type_manual', term from closed where root = 'type_accept' and term <> '1'
union all select 'type_never', '2'
union all select 'method_accept', term from closed where root = 'method_accept' and term not in ('31', '50')
   and term not in (select term from obsolete)
union all select 'method_obsolete', term from closed where root = 'method_accept' and term in (select term from obsolete)
union all select 'method_manual', unnest(['31', '50'])
union all select 'method_never', term from closed where root = 'method_never'
union all select 'accept_never_overlap', a.term from closed a join closed b on a.term = b.term
   where a.root = 'method_accept' and b.root = 'method_never'
union all select 'manual_term_outside_closure', '50'
union all select 'obsolete_policy_term', term from (select distinct term from policy) where term in (select term from obsolete)""",
)
def a5_policy(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    terms = part.select(F.col("p_partkey").cast("string").alias("term"), (F.col("p_size") > 45).alias("is_obsolete"))
    policy = spark.createDataFrame(POLICY_ROWS, "section string, term string")
    sets, found = compile_policy(terms, ontology_edges(spark, d), policy)
    return sets.unionByName(found.select(F.col("rule_id").alias("term_set"), F.col("key").alias("term")))


# ---------------------------------------------------------------- profiles


@query(
    "a6_profile_pairs",
    "with " + OBS_SQL + """,
v as (select *, not contains(raw_a, '99') as ok from named)
select unnest(['rows', 'invalid_rows', 'self_pairs', 'directed_pairs', 'undirected_pairs', 'duplicate_or_reciprocal_rows', 'distinct_endpoints']) as metric,
       unnest([count(*) filter (where ok), count(*) filter (where not ok), count(*) filter (where ok and raw_a = raw_b),
               count(distinct concat(raw_a, raw_b)) filter (where ok), count(distinct pair_id) filter (where ok),
               count(*) filter (where ok) - count(distinct pair_id) filter (where ok),
               (select count(distinct e) from (select raw_a as e from v where ok union all select raw_b from v where ok))]) as value
from v""",
)
def a6(spark: SparkSession, d: str) -> DataFrame:
    return profile_pairs(observations(spark, d), "raw_a", "raw_b", ~F.col("raw_a").contains("99"))


@query(
    "a7_funnel",
    "with " + OBS_SQL + """
select 'all' as level, count(*) as rows, count(distinct pair_id) as distinct_pairs from named
union all select 'direct', count(*), count(distinct pair_id) from named where interaction_type = 'MI:0407'
union all select 'curated', count(*), count(distinct pair_id) from named
  where interaction_type = 'MI:0407' and negative_class = 'curated_negative'
union all select 'negative', count(*), count(distinct pair_id) from named
  where interaction_type = 'MI:0407' and negative_class = 'curated_negative' and polarity = 'negative'""",
)
def a7(spark: SparkSession, d: str) -> DataFrame:
    levels = {
        "direct": F.col("interaction_type") == "MI:0407",
        "curated": F.col("negative_class") == "curated_negative",
        "negative": F.col("polarity") == "negative",
    }
    return funnel(observations(spark, d), levels, "raw_a", "raw_b")


@query(
    "a8_top_values",
    "with " + OBS_SQL + " select raw_a as value, count(*) as n from named group by 1 order by n desc, value limit 15",
)
def a8(spark: SparkSession, d: str) -> DataFrame:
    return top_k(observations(spark, d), "raw_a", 15)


@query(
    "a9_count_summary",
    "with " + PAIRS_SQL + """
select dimension, value, count(*) as n from (
  select unnest(['pair_status', 'evidence_class', 'exclusion_reason']) as dimension,
         unnest([pair_status, evidence_class, exclusion_reason]) as value from pairs)
group by 1, 2""",
)
def a9(spark: SparkSession, d: str) -> DataFrame:
    return count_summary(labelled_pairs(spark, d), ["pair_status", "evidence_class", "exclusion_reason"])


@query(
    "a11_cluster_stats",
    "with " + PAIRS_SQL + """,
sizes as (select cluster_id, count(*) as n from nodes group by 1)
select unnest(['entities', 'clusters', 'largest_cluster', 'singletons']) as metric,
       unnest([cast(sum(n) as bigint), count(*), max(n), count(*) filter (where n = 1)]) as value from sizes""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    return cluster_stats(entities(spark, d), "cluster_id")


# ----------------------------------------------------------------- ledgers


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "a12_distribution",
    """
select event_type, count(value) as n, round(avg(value), 6) as mean, round(median(value), 6) as median,
       round(quantile_cont(value, 0.95), 6) as p95, round(max(value), 6) as maximum, round(sum(value), 6) as total
from events group by 1""",
)
def a12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distribution(table(spark, d, "events"), "value", ["event_type"]))


@query(
    "a12_ledger_distributions",
    "with " + LEDGER_SQL + """,
long as (
  select method, seed, 'wall_time_seconds' as measure, wall_time_seconds as v from ledger
  union all select method, seed, 'preprocessing_seconds', preprocessing_seconds from ledger
  union all select method, seed, 'peak_gpu_memory_mib', peak_gpu_memory_mib from ledger)
select method, seed, measure, count(v) as n, round(coalesce(avg(v), 0), 6) as mean, round(coalesce(median(v), 0), 6) as median,
       round(coalesce(quantile_cont(v, 0.95), 0), 6) as p95, round(coalesce(max(v), 0), 6) as maximum,
       round(coalesce(sum(v), 0), 6) as total
from long group by 1, 2, 3""",
)
def a12_ledger(spark: SparkSession, d: str) -> DataFrame:
    measures = ["wall_time_seconds", "preprocessing_seconds", "peak_gpu_memory_mib"]
    return rounded(distributions(ledger(spark, d), ["method", "seed"], measures))


@query(
    "a13_ledger_items",
    "with " + LEDGER_SQL + """,
per_id as (
  select method, seed, stage, pair_id, bool_or(status = 'success') as ok, sum(wall_time_seconds * gpu_count) as gpu,
         coalesce(sum(wall_time_seconds) filter (where status = 'success'), 0) as ok_wall, sum(output_bytes) as bytes,
         min(input_residues) as lo, max(input_residues) as hi,
         pair_id in (select pair_id from expected) as known
  from ledger group by 1, 2, 3, 4)
select method, seed, stage, count(*) as attempted_items, count(*) filter (where ok) as successful_items,
       count(*) filter (where not ok) as failed_items, (select count(*) from expected) as expected_items,
       (select count(*) from expected) - count(*) filter (where known) as missing_items,
       count(*) filter (where not known) as unexpected_items,
       count(*) filter (where known) = (select count(*) from expected) and bool_and(known) as attempt_coverage_complete,
       count(*) filter (where known and ok) = (select count(*) from expected)
         and count(*) filter (where ok) = count(*) filter (where known and ok) as successful_coverage_complete,
       round(sum(gpu) / 3600, 6) as total_gpu_hours, cast(sum(bytes) as bigint) as total_output_bytes,
       round(count(*) filter (where ok) / (sum(ok_wall) / 3600), 6) as successful_items_per_wall_hour,
       min(lo) as residues_min, max(hi) as residues_max
from per_id group by 1, 2, 3""",
)
def a13(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger_items(ledger(spark, d), expected_items(spark, d)))


@query(
    "a13_ledger_first_ids",
    "with " + LEDGER_SQL + """,
per_id as (
  select method, seed, stage, pair_id, bool_or(status = 'success') as ok from ledger group by 1, 2, 3, 4),
groups as (select distinct method, seed, stage from ledger),
issues as (
  select g.method, g.seed, g.stage, 'missing' as issue, e.pair_id from groups g, expected e
  where not exists (select 1 from per_id p where p.method = g.method and p.seed = g.seed and p.stage = g.stage and p.pair_id = e.pair_id)
  union all select method, seed, stage, 'failed', pair_id from per_id where not ok
  union all select method, seed, stage, 'unexpected', pair_id from per_id where pair_id not in (select pair_id from expected))
select method, seed, stage, issue, string_agg(pair_id, ';' order by pair_id) as first_ids
from (select *, row_number() over (partition by method, seed, stage, issue order by pair_id) as r from issues)
where r <= 20 group by 1, 2, 3, 4""",
)
def a13_ids(spark: SparkSession, d: str) -> DataFrame:
    return listed_ids(ledger_coverage(ledger(spark, d), expected_items(spark, d)))


@query("a13_gpu_models", "with " + LEDGER_SQL + " select distinct method, seed, stage, gpu_model from ledger where gpu_model <> ''")
def a13_models(spark: SparkSession, d: str) -> DataFrame:
    return gpu_models(ledger(spark, d))


RUNS_SQL = LEDGER_SQL + """,
runs as (
  select method, case when method = 'view' then null when method = 'click' and seed = 999 then 7 else seed end as seed,
         stage, status, gpu_count, wall_time_seconds, output_bytes from ledger)"""


def run_rows(spark: SparkSession, d: str) -> DataFrame:
    seed = (
        F.when(F.col("method") == "view", F.lit(None).cast("int"))
        .when((F.col("method") == "click") & (F.col("seed") == 999), F.lit(7))
        .otherwise(F.col("seed"))
    )
    return ledger(spark, d).withColumn("seed", seed)


@query(
    "a14_ledger_runs",
    "with " + RUNS_SQL + """
select method, stage, count(*) as runs, count(*) filter (where status = 'success') as successful_runs,
       count(*) filter (where status = 'failure') as failed_runs, count(distinct seed) as observed_seeds,
       round(sum(wall_time_seconds * gpu_count) / 3600, 6) as total_gpu_hours,
       cast(sum(output_bytes) as bigint) as total_output_bytes,
       count(seed) = 0 or (count(distinct seed) = 3 and bool_and(seed in (42, 123, 999))) as seed_coverage_complete
from runs group by 1, 2""",
)
def a14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger_runs(run_rows(spark, d)))


@query(
    "a14_ledger_status",
    "with " + RUNS_SQL + """,
per_run as (
  select method, count(*) filter (where status = 'failure') as failed,
         count(seed) = 0 or (count(distinct seed) = 3 and bool_and(seed in (42, 123, 999))) as complete from runs group by 1),
per_id as (
  select method, seed, pair_id, bool_or(status = 'success') as ok from ledger group by 1, 2, 3),
per_item as (
  select method, seed, count(*) = (select count(*) from expected) and bool_and(pair_id in (select pair_id from expected)) as attempted,
         count(*) filter (where ok) = (select count(*) from expected)
           and bool_and(not ok or pair_id in (select pair_id from expected)) as successful from per_id group by 1, 2)
select 'attempt_coverage' as "check", bool_and(attempted) as passed from per_item
union all select 'successful_coverage', bool_and(successful) from per_item
union all select 'no_failed_runs', bool_and(failed = 0) from per_run
union all select 'registered_item_seeds', bool_and(n = 3) from (select method, count(distinct seed) as n from ledger group by 1)
union all select 'registered_run_seeds', bool_and(complete) from per_run""",
)
def a14_status(spark: SparkSession, d: str) -> DataFrame:
    items = ledger_items(ledger(spark, d), expected_items(spark, d))
    seeds = set_coverage(ledger(spark, d), ["method", "stage"], "seed", [42, 123, 999])
    return ledger_status(items, seeds, ledger_runs(run_rows(spark, d)))


@query(
    "a15_set_coverage",
    "with " + RUNS_SQL + """
select method, stage, count(distinct seed) as observed,
       count(distinct seed) = 3 and bool_and(seed in (42, 123, 999)) as complete
from runs where seed is not null group by 1, 2""",
)
def a15(spark: SparkSession, d: str) -> DataFrame:
    return set_coverage(run_rows(spark, d), ["method", "stage"], "seed", [42, 123, 999])


@query(
    "a17_validate_ledger",
    "with " + LEDGER_SQL + """
select rule_id, count(*) as n from (
  select 'gpu_row_without_model' as rule_id from ledger where gpu_count > 0 and gpu_model = ''
  union all select 'gpu_row_without_memory' from ledger where gpu_count > 0 and not coalesce(peak_gpu_memory_mib > 0, false)
  union all select 'negative_memory' from ledger where peak_gpu_memory_mib < 0
  union all select 'invalid_input_residues' from ledger where input_residues < 1
  union all select 'invalid_stdout_sha256' from ledger where stdout_sha256 = 'bad'
  union all select 'duplicate_ledger_row' from (
    select method, seed, stage, pair_id from ledger group by 1, 2, 3, 4 having count(*) > 1))
group by 1""",
)
def a17(spark: SparkSession, d: str) -> DataFrame:
    found = validate_ledger(ledger(spark, d), "item")
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
