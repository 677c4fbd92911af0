"""Queries for features, models and the end-to-end jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.arrays import symmetric_features
from pairloom.operators.features import build_examples, pool_windows, validate_vectors
from pairloom.operators.model import (
    C_GRID,
    balanced_weights,
    certificate,
    early_stop,
    grid_certificates,
    grid_scores,
    prepare,
    select_and_refit,
)
from pairloom.operators.ordered import running_totals
from pairloom.operators.ranking import metrics
from pairloom.plans.adapters import (
    KEPT_SQL,
    PAIR_PREFIX,
    PREDS_SQL,
    entities,
    folded_node,
    observations,
    own_node,
    predictions,
    table,
)
from pairloom.plans.benchmark import build_benchmark, build_summary, freeze
from pairloom.plans.catalog import query
from pairloom.runtime import scratch_path, stage

# ---------------------------------------------------------------- features

# Neighbouring vectors form pairs; the first endpoint's class is the target.
VECTOR_PAIRS_SQL = """
vectors as (select vec_id, label, list_transform_cast as v from (
  select vec_id, label, cast(embedding as double[]) as list_transform_cast from embeddings)),
vector_pairs as (
  select a.vec_id as pair_no, a.v as va, b.v as vb, a.label < 5 as target, 20 + a.vec_id % 300 as la, 20 + b.vec_id % 300 as lb
  from vectors a join vectors b on b.vec_id = a.vec_id + 1)"""


def vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(pair_no, node_a, node_b, label, partition) of neighbouring vectors."""
    base = table(spark, d, "embeddings").select("vec_id", "label")
    following = base.select((F.col("vec_id") - 1).alias("vec_id"))
    number = F.col("vec_id")
    return base.join(following, "vec_id").select(
        number.alias("pair_no"),
        number.cast("string").alias("pair_id"),
        number.cast("string").alias("node_a"),
        (number + 1).cast("string").alias("node_b"),
        (F.col("label") < 5).cast("int").alias("label"),
        F.when(number % 10 < 6, F.lit("train"))
        .when(number % 10 < 8, F.lit("validation"))
        .otherwise(F.lit("test"))
        .alias("partition"),
    )


def vector_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("entity_id"),
        F.col("embedding").alias("vector"),
        (F.col("vec_id") % 300 + 20).alias("length"),
        F.sha2(F.col("vec_id").cast("string"), 256).alias("sequence_sha256"),
    )


@query(
    "f1_symmetric_features",
    "with " + VECTOR_PAIRS_SQL + """,
parts as (
  select pair_no, generate_subscripts(va, 1) as i, unnest(va) as x, unnest(vb) as y from vector_pairs)
select pair_no, cast(i - 1 as integer) as feature, round((x + y) / 2, 9) as value from parts
union all select pair_no, cast(63 + i as integer), round(abs(x - y), 9) from parts
union all select pair_no, cast(127 + i as integer), round(x * y, 9) from parts
union all select pair_no, 192, round((ln(1 + la) + ln(1 + lb)) / 2, 9) from vector_pairs
union all select pair_no, 193, round(abs(ln(1 + la) - ln(1 + lb)), 9) from vector_pairs
union all select pair_no, 194, round(least(la, lb) / greatest(la, lb), 9) from vector_pairs""",
)
def f1(spark: SparkSession, d: str) -> DataFrame:
    examples, _ = build_examples(vector_pairs(spark, d), vector_table(spark, d))
    return examples.select(
        F.col("pair_id").cast("bigint").alias("pair_no"), F.posexplode("features").alias("feature", "value")
    ).select("pair_no", "feature", F.round("value", 9).alias("value"))


@query(
    "f1_swap_invariance",
    "with " + VECTOR_PAIRS_SQL + " select count(*) as pairs, count(*) as unchanged from vector_pairs",
)
def f1_swap(spark: SparkSession, d: str) -> DataFrame:
    v = vector_table(spark, d)
    pairs = vector_pairs(spark, d).select("node_a", "node_b")
    for s in "ab":
        pairs = pairs.join(
            v.select(F.col("entity_id").alias(f"node_{s}"), F.col("vector").alias(f"v{s}"), F.col("length").alias(f"l{s}")),
            f"node_{s}",
        )
    c = F.col
    same = symmetric_features(c("va"), c("vb"), c("la"), c("lb")) == symmetric_features(c("vb"), c("va"), c("lb"), c("la"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(same).alias("unchanged"))


@query(
    "f2_build_examples",
    "with " + VECTOR_PAIRS_SQL + """,
placed as (
  select pair_no, target, case when pair_no % 10 < 6 then 'train' when pair_no % 10 < 8 then 'validation' else 'test' end as partition
  from vector_pairs)
select partition, 'example' as outcome, count(*) as n from placed where pair_no not in (100, 99) group by 1
union all select '100', 'endpoint_without_vector', 1 union all select '99', 'endpoint_without_vector', 1""",
)
def f2(spark: SparkSession, d: str) -> DataFrame:
    renamed = F.when(F.col("entity_id") == "100", F.lit("-100")).otherwise(F.col("entity_id"))
    vectors = vector_table(spark, d).withColumn("entity_id", renamed)
    examples, found = build_examples(vector_pairs(spark, d), vectors)
    counted = examples.groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    issues = found.groupBy(F.col("key").alias("partition"), F.col("rule_id").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("partition", F.lit("example").alias("outcome"), "n").unionByName(issues)


@query(
    "f3_balanced_weights",
    "with " + PREDS_SQL + """
select label, count(*) as n, round((select count(*) from preds) / (2.0::double * count(*)), 9) as weight from preds group by 1""",
)
def f3(spark: SparkSession, d: str) -> DataFrame:
    rows = balanced_weights(predictions(spark, d))
    return rows.groupBy("label", F.round("weight", 9).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


def examples(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = build_examples(vector_pairs(spark, d), vector_table(spark, d))
    return stage(rows, "examples")


@query("f4_logistic_grid")
def f4(spark: SparkSession, d: str) -> DataFrame:
    rows = examples(spark, d)
    scores = grid_scores(rows.where(F.col("partition") == "train"), rows.where(F.col("partition") == "validation"))
    return scores.select("c", F.round("average_precision", 6).alias("average_precision"))


PARAMETERS_SQL = "(select cast(3 * max(len(embedding)) + 4 as bigint) from embeddings)"


@query(
    "f4_certificates",
    f"select c, {PARAMETERS_SQL} as parameters, true as stationary from (values {', '.join(f'({c}::double)' for c in C_GRID)}) as g(c)",
)
def f4_certificates(spark: SparkSession, d: str) -> DataFrame:
    """Whether every fit of the grid is an optimum: the gradient over all training rows."""
    rows = examples(spark, d)
    return grid_certificates(rows.where(F.col("partition") == "train")).select("c", "parameters", "stationary")


@query("f5_certificate", f"select {PARAMETERS_SQL} as parameters, true as stationary, true as in_grid")
def f5_certificate(spark: SparkSession, d: str) -> DataFrame:
    """The same for the fit that was selected and made again on train and validation."""
    rows = examples(spark, d)
    _, c, fit = select_and_refit(rows)
    training = prepare(rows.where(F.col("partition").isin("train", "validation")))
    found = certificate(training, fit, c)
    return found.select("parameters", "stationary", F.col("c").isin(*C_GRID).alias("in_grid"))


@query("f5_select_and_refit")
def f5(spark: SparkSession, d: str) -> DataFrame:
    scored, c, _ = select_and_refit(examples(spark, d))
    return metrics(scored).withColumn("c", F.lit(c))


@query(
    "f6_validate_vectors",
    """
with bad as (
  select vec_id, label, len(embedding) - case when label = 3 then 1 else 0 end as size, label = 4 as broken from embeddings)
select rule_id, count(*) as n from (
  select 'wrong_dimension' as rule_id from bad where size <> 64
  union all select 'not_finite' from bad where broken
  union all select 'missing_vector' from embeddings where label in (7, 9)
  union all select 'unexpected_vector' from bad where label in (7, 9)
  union all select 'sequence_digest_mismatch' from bad where label = 5)
group by 1""",
)
def f6(spark: SparkSession, d: str) -> DataFrame:
    marked = vector_table(spark, d).join(
        table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("entity_id"), "label"), "entity_id"
    )
    label = F.col("label")

    def renamed(wanted: int) -> Column:
        key = F.col("entity_id")
        return F.when(label == wanted, F.concat(F.lit(f"{wanted}:"), key)).otherwise(key).alias("entity_id")

    known = marked.select(renamed(7), "sequence_sha256")
    infinite = F.transform("vector", lambda x, i: F.when(i == 1, F.lit(float("inf"))).otherwise(x.cast("double")))
    bad = marked.select(
        renamed(9),
        F.when(label == 3, F.slice("vector", 1, 63).cast("array<double>"))
        .when(label == 4, infinite)
        .otherwise(F.col("vector").cast("array<double>"))
        .alias("vector"),
        F.when(label == 5, F.lit("stale")).otherwise(F.col("sequence_sha256")).alias("sequence_sha256"),
    )
    return validate_vectors(bad, known, 64).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


# A vector seen as 16 positions of 4 dimensions, cut into windows of 6 at
# stride 4: starts 0, 4, 8 and 12.
@query(
    "f7_pool_windows",
    """
with cells as (
  select vec_id, generate_subscripts(embedding, 1) - 1 as i, cast(unnest(embedding) as double) as x from embeddings),
placed as (select vec_id, i // 4 as pos, i % 4 as dim, x from cells),
windows as (
  select p.vec_id, p.pos, p.dim, p.x * (1 + w.s / 4 * 0.01::double) as x from placed p, (values (0), (4), (8), (12)) as w(s)
  where p.pos between w.s and w.s + 5),
per_position as (select vec_id, pos, dim, avg(x) as x from windows group by 1, 2, 3)
select vec_id, cast(dim as integer) as dim, round(avg(x), 9) as value from per_position group by 1, 2""",
)
def f7(spark: SparkSession, d: str) -> DataFrame:
    wide = F.col("embedding").cast("array<double>")
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.slice(wide, p * 4 + 1, F.lit(4)))
    cut = (
        table(spark, d, "embeddings")
        .select("vec_id", rows.alias("rows"), F.explode(F.array(*[F.lit(s) for s in (0, 4, 8, 12)])).alias("window_start"))
        .select("vec_id", "window_start", F.lit(16).alias("length"), F.slice("rows", F.col("window_start") + 1, F.lit(6)).alias("raw"))
    )
    # Each window sees the positions slightly differently.
    tilt = 1 + F.col("window_start") / 4 * 0.01
    values = F.transform("raw", lambda v: F.transform(v, lambda x: x * tilt))
    pooled = pool_windows(cut.withColumn("values", values), 6, 4, key="vec_id")
    return pooled.select("vec_id", F.posexplode("vector").alias("dim", "value")).select(
        "vec_id", "dim", F.round("value", 9).alias("value")
    )


@query(
    "f8_early_stop",
    """
with runs as (
  select o_custkey as run, row_number() over (partition by o_custkey order by o_orderkey) as epoch, o_totalprice as metric from orders),
marked as (
  select *, metric > coalesce(max(metric) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), -1) as better from runs),
held as (
  select *, max(case when better then epoch end) over (partition by run order by epoch rows unbounded preceding) as best from marked),
stops as (select run, min(epoch) filter (where epoch - best >= 4) as stop, max(epoch) as last from held group by 1)
select h.run, max(h.epoch) as best_epoch, round(max(h.metric), 6) as best_metric, max(coalesce(stop, last)) as stopped_epoch
from held h join stops s on h.run = s.run where h.better and h.epoch <= coalesce(stop, last) group by 1""",
)
def f8(spark: SparkSession, d: str) -> DataFrame:
    # A customer's orders, numbered by key, stand for one run's epochs.
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("run"),
        "o_orderkey",
        F.col("o_totalprice").alias("metric"),
        F.lit(1).cast("bigint").alias("one"),
    )
    numbered = running_totals(orders, ["run"], [F.col("o_orderkey")], ["one"])
    runs = numbered.select("run", F.col("cum_one").alias("epoch"), "metric")
    found = early_stop(runs, ["run"], patience=4)
    return found.select("run", "best_epoch", F.round("best_metric", 6).alias("best_metric"), "stopped_epoch")


# ------------------------------------------------------------- end to end


def accepted_nodes(spark: SparkSession, d: str, node: Callable[[Column], Column] = folded_node) -> DataFrame:
    """Resolution of the raw nodes: parts up to size 40 give nodes that are used."""
    name = node(F.col("p_partkey"))
    known = table(spark, d, "part").select(
        F.when(F.col("p_size") <= 40, name).otherwise(F.concat(F.lit("Z"), name)).alias("raw_identifier")
    ).distinct()
    roles = F.explode(F.array(F.lit("positive_evidence"), F.lit("negative_evidence")))
    return known.select(
        F.lit("lineitem").alias("source_database"),
        F.lit("1").alias("source_version"),
        roles.alias("evidence_role"),
        F.lit("node").alias("namespace"),
        "raw_identifier",
        F.lit("accepted").alias("resolution_status"),
        F.lit("").alias("resolution_reason"),
        F.col("raw_identifier").alias("resolved_id"),
    )


def built(spark: SparkSession, d: str, node: Callable[[Column], Column] = folded_node) -> dict[str, DataFrame]:
    obs = observations(spark, d, node).drop("pair_id", "node_a", "node_b")
    role = F.when(F.col("polarity") == "positive", F.lit("positive_evidence")).otherwise(F.lit("negative_evidence"))
    rows = obs.withColumn("namespace", F.lit("node")).withColumn("evidence_role", role)
    defined = rows.withColumn(
        "negative_definition", F.when(F.col("polarity") == "negative", F.lit("explicit")).otherwise(F.lit(""))
    )
    nodes = entities(spark, d, node)
    return {n: stage(df, f"built-{n}") for n, df in build_benchmark(defined, accepted_nodes(spark, d, node), nodes, PAIR_PREFIX).items()}


BUILD_SQL = KEPT_SQL.replace(
    "obs as (",
    "known as (select distinct concat(case when p_size <= 40 then 'N' else 'Z' end, lpad(cast(p_partkey % 997 as varchar), 4, '0')) as id from part),\nobs_all as (",
    1,
).replace(
    "named as (",
    "obs as (select * from obs_all where raw_a in (select id from known) and raw_b in (select id from known)),\nnamed as (",
    1,
)


@query(
    "v7_build_benchmark",
    "with " + BUILD_SQL + """,
flags as (
  select pair_id, node_a, node_b, bool_or(polarity = 'positive') as pos, bool_or(polarity = 'negative') as neg,
         bool_or(polarity = 'negative' and negative_class = 'curated_negative') as curated from kept group by 1, 2, 3),
pairs as (
  select *, case when pos and not neg then 'direct_positive' when neg and not pos and curated then 'curated_negative'
                 when neg and not pos then 'screen_negative' else 'unlabeled' end as klass,
         case when node_a = node_b or (pos and neg) then 'quarantine' else 'eligible' end as status from flags)
select 'rows_pairs' as item, count(*) as n from pairs
union all select 'rows_evidence', count(*) from (
  select distinct source_record_id, pair_id, polarity, detection_method, interaction_type from kept)
union all select 'rows_entities', count(*) from (select node_a as e from pairs union select node_b from pairs)
union all select 'rows_quarantine', (select count(*) from obs_all) - (select count(*) from kept)
union all select concat('class_', klass), count(*) from pairs group by 1
union all select concat('status_', status), count(*) from pairs group by 1
union all select 'quarantine_unresolved_endpoint', (select count(*) from obs_all) - (select count(*) from obs)
union all select 'quarantine_source_record_maps_to_multiple_normalized_pairs', (select count(*) from obs) - (select count(*) from kept)""",
)
def v7_build(spark: SparkSession, d: str) -> DataFrame:
    return build_summary(built(spark, d))


@query("v7_freeze")
def v7(spark: SparkSession, d: str) -> DataFrame:
    # Folded nodes would end as a graph of contradictions: in large tables every pair has
    # evidence of both kinds, no labelled negative is left, and no split is feasible.
    tables = built(spark, d, own_node)
    inputs = {n: tables[n] for n in ("pairs", "evidence", "entities")}
    return freeze(spark, inputs, scratch_path(spark, "frozen"), PAIR_PREFIX, id_shape=r"^N\d+$", taxon=None, rules=[])
