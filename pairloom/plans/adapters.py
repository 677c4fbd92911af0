"""The driver tables seen as evidence, identifiers, predictions and ledgers.

Each adapter exists twice: a Spark function and the same select as SQL text,
which the checks use as a common table expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.pairs import canonicalise, label_pairs, split_ambiguous, with_evidence_id

PAIR_PREFIX = "PAIR"
SPLIT_SEED = 0
COHORT_SEED = 20260915


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- evidence

OBS_SQL = """
obs as (
  select concat('N', lpad(cast(l_suppkey * 31 % 997 as varchar), 4, '0')) as raw_a,
         concat('N', lpad(cast(l_partkey % 997 as varchar), 4, '0')) as raw_b,
         case when l_returnflag = 'R' and l_quantity < 5 then 'negative' else 'positive' end as polarity,
         case when l_linestatus = 'F' then 'curated_negative' else 'screen_negative' end as negative_class,
         'lineitem' as source_database, '1' as source_version,
         concat('R', cast(l_orderkey as varchar), '-', cast(l_linenumber % 5 as varchar)) as source_record_id,
         case when l_quantity <= 1 then concat('G', cast(l_orderkey % 5000 as varchar)) else '' end as group_id,
         concat('MI:', lpad(cast(l_linenumber as varchar), 4, '0')) as detection_method,
         case when l_quantity > 45 then 'MI:0915' else 'MI:0407' end as interaction_type,
         case when l_returnflag = 'R' and l_quantity < 5 and l_discount < 0.1 then 'explicit' else '' end as negative_definition
  from lineitem),
named as (
  select *, concat('PAIR_', least(raw_a, raw_b), '_', greatest(raw_a, raw_b)) as pair_id,
         least(raw_a, raw_b) as node_a, greatest(raw_a, raw_b) as node_b
  from obs)"""


def folded_node(key: Column) -> Column:
    """One of 997 nodes, as the SQL names it."""
    return F.concat(F.lit("N"), F.lpad((key % 997).cast("string"), 4, "0"))


def own_node(key: Column) -> Column:
    """A node for every key, so that nodes and pairs grow with the tables."""
    return F.concat(F.lit("N"), key.cast("string"))


def observations(spark: SparkSession, sf_dir: str, node: Callable[[Column], Column] = folded_node) -> DataFrame:
    """One evidence row per line item; see OBS_SQL."""
    li = table(spark, sf_dir, "lineitem")
    negative = (F.col("l_returnflag") == "R") & (F.col("l_quantity") < 5)
    raw = li.select(
        node(F.col("l_suppkey") * (31 if node is folded_node else 1)).alias("raw_a"),
        node(F.col("l_partkey")).alias("raw_b"),
        F.when(negative, F.lit("negative")).otherwise(F.lit("positive")).alias("polarity"),
        F.when(F.col("l_linestatus") == "F", F.lit("curated_negative"))
        .otherwise(F.lit("screen_negative"))
        .alias("negative_class"),
        F.lit("lineitem").alias("source_database"),
        F.lit("1").alias("source_version"),
        F.concat(
            F.lit("R"), F.col("l_orderkey").cast("string"), F.lit("-"), (F.col("l_linenumber") % 5).cast("string")
        ).alias("source_record_id"),
        F.when(F.col("l_quantity") <= 1, F.concat(F.lit("G"), (F.col("l_orderkey") % 5000).cast("string")))
        .otherwise(F.lit(""))
        .alias("group_id"),
        F.concat(F.lit("MI:"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0")).alias("detection_method"),
        F.when(F.col("l_quantity") > 45, F.lit("MI:0915")).otherwise(F.lit("MI:0407")).alias("interaction_type"),
        F.when(negative & (F.col("l_discount") < 0.1), F.lit("explicit"))
        .otherwise(F.lit(""))
        .alias("negative_definition"),
    )
    return canonicalise(raw, "raw_a", "raw_b", PAIR_PREFIX)


# ------------------------------------------------------- pairs and entities

KEPT_SQL = OBS_SQL + """,
ambiguous as (
  select source_record_id from named group by 1 having count(distinct pair_id) > 1),
kept as (
  select * from named where source_record_id not in (select source_record_id from ambiguous))"""

PAIRS_SQL = KEPT_SQL + """,
flags as (
  select pair_id, node_a, node_b,
         bool_or(polarity = 'positive') as pos, bool_or(polarity = 'negative') as neg,
         bool_or(polarity = 'negative' and negative_class = 'curated_negative') as curated,
         count(*) as n_evidence, max(group_id) as complex_group_id
  from kept group by 1, 2, 3),
pairs as (
  select pair_id, node_a, node_b,
         case when pos and not neg then 1 when neg and not pos then 0 end as label,
         case when pos and not neg then 'direct_positive'
              when neg and not pos and curated then 'curated_negative'
              when neg and not pos then 'screen_negative' else 'unlabeled' end as evidence_class,
         case when node_a = node_b or (pos and neg) then 'quarantine' else 'eligible' end as pair_status,
         case when node_a = node_b then 'self_pair_outside_primary_heterotypic_scope'
              when pos and neg then 'positive_negative_contradiction' else '' end as exclusion_reason,
         n_evidence, complex_group_id
  from flags),
nodes as (
  select distinct node as entity_id,
         concat('CL', cast(cast(substr(node, 2) as integer) % 200 as varchar)) as cluster_id
  from (select node_a as node from named union all select node_b from named))"""


def kept_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unambiguous evidence rows."""
    return split_ambiguous(observations(spark, sf_dir))[0]


def labelled_pairs(spark: SparkSession, sf_dir: str, kept: DataFrame | None = None) -> DataFrame:
    """Labelled pairs of the unambiguous evidence, with one group id each."""
    kept = kept_observations(spark, sf_dir) if kept is None else kept
    # The greatest of texts sorts what it reads: only the few rows with a group take part.
    groups = (
        kept.where(F.col("group_id") != "").groupBy("pair_id").agg(F.max("group_id").alias("complex_group_id"))
    )
    pairs = label_pairs(kept)
    found = F.coalesce("complex_group_id", F.lit("")).alias("complex_group_id")
    return pairs.join(groups, "pair_id", "left").select(*pairs.columns, found)


def entities(spark: SparkSession, sf_dir: str, node: Callable[[Column], Column] = folded_node) -> DataFrame:
    """Every node of the evidence with its cluster."""
    ends = observations(spark, sf_dir, node).select(F.explode(F.array("node_a", "node_b")).alias("entity_id")).distinct()
    number = F.expr("substring(entity_id, 2)").cast("bigint") % 200
    return ends.withColumn("cluster_id", F.concat(F.lit("CL"), number.cast("string")))


def eligible_pairs(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    pairs = labelled_pairs(spark, sf_dir) if pairs is None else pairs
    return pairs.where((F.col("pair_status") == "eligible") & F.col("label").isin(0, 1))


def evidence(spark: SparkSession, sf_dir: str, kept: DataFrame | None = None) -> DataFrame:
    """The kept evidence rows with content ids, one row per id."""
    kept = kept_observations(spark, sf_dir) if kept is None else kept
    columns = [
        "pair_id", "source_database", "source_version", "source_record_id",
        "interaction_type", "detection_method", "polarity", "negative_definition",
    ]
    # The id follows from the other columns, so it is made once they are distinct.
    return with_evidence_id(kept.select(*columns).distinct()).select("evidence_id", *columns)


UNIT = "(cast(concat('0x', substr(sha256({key}), 1, 16)) as ubigint)::double / 18446744073709551616.0)"


def unit_sql(key: str) -> str:
    return UNIT.format(key=key)


def pool_sql(cluster: str, seed: str = str(SPLIT_SEED)) -> str:
    u = unit_sql(f"concat({seed}, ':', {cluster})")
    return f"case when {u} < 0.6 then 'train' when {u} < 0.8 then 'validation' else 'test' end"


LOCATED_SQL = PAIRS_SQL + """,
labelled as (
  select * from pairs where pair_status = 'eligible' and label in (0, 1)),
located as (
  select p.*, a.cluster_id as cluster_a, b.cluster_id as cluster_b
  from labelled p join nodes a on p.node_a = a.entity_id join nodes b on p.node_b = b.entity_id)"""

SPLIT_SQL = LOCATED_SQL + f""",
pools as (
  select cluster_id, {pool_sql('cluster_id')} as pool
  from (select distinct cluster_id from nodes)),
pooled as (
  select l.*, a.pool as pool_a, b.pool as pool_b
  from located l join pools a on l.cluster_a = a.cluster_id join pools b on l.cluster_b = b.cluster_id),
spanning as (
  select complex_group_id from (
    select complex_group_id, pool_a as pool from pooled where complex_group_id <> ''
    union all select complex_group_id, pool_b from pooled where complex_group_id <> '')
  group by 1 having count(distinct pool) > 1),
decided as (
  select *, case when complex_group_id in (select complex_group_id from spanning)
                 then 'complex_group_cross_partition_quarantine'
                 when pool_a <> pool_b then 'cross_partition_quarantine' else '' end as reason
  from pooled),
splits as (
  select 'c3_primary' as split_scheme, '0' as fold, pair_id, pool_a as partition,
         case when pool_a = 'train' then '' else 'C3' end as pm_class
  from decided where reason = '')"""


# -------------------------------------------------------------- predictions

PREDS_SQL = """
preds as (
  select cast(d.doc_id as varchar) as pair_id, l.quality as label,
         least(floor(d.n_chars / 100.0), 200.0) / 200.0 as score,
         (d.doc_id * 7919 % 101) / 101.0::double as baseline_score,
         case when l.quality = 1 then 'direct_positive'
              when l.toxic = 1 then 'curated_negative' else 'screen_negative' end as evidence_class,
         d.source as bootstrap_group, 'test' as partition
  from labels l join documents d on l.doc_id = d.doc_id)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored labels with many ties, and a baseline score; see PREDS_SQL."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return joined.select(
        F.col("doc_id").cast("string").alias("pair_id"),
        F.col("quality").cast("int").alias("label"),
        (F.least(F.floor(F.col("n_chars") / F.lit(100.0)), F.lit(200)).cast("double") / F.lit(200.0)).alias("score"),
        ((F.col("doc_id") * 7919 % 101).cast("double") / F.lit(101.0)).alias("baseline_score"),
        F.when(F.col("quality") == 1, F.lit("direct_positive"))
        .when(F.col("toxic") == 1, F.lit("curated_negative"))
        .otherwise(F.lit("screen_negative"))
        .alias("evidence_class"),
        F.col("source").alias("bootstrap_group"),
        F.lit("test").alias("partition"),
    )


SEEDED_SQL = PREDS_SQL + """,
seeded as (
  select p.*, s.seed,
         (p.score + (cast(p.pair_id as bigint) * (17 * s.seed + 3) % 53) / 106.0::double) / 2 as score_candidate,
         p.baseline_score as score_baseline
  from preds p cross join (values (42), (123), (999)) s(seed))"""


def seeded_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three registered seeds: a perturbed candidate score, one baseline."""
    rows = predictions(spark, sf_dir).withColumn(
        "seed", F.explode(F.array(F.lit(42), F.lit(123), F.lit(999)))
    )
    wobble = F.col("pair_id").cast("bigint") * (17 * F.col("seed") + 3) % 53
    return rows.withColumn(
        "score_candidate", (F.col("score") + wobble.cast("double") / F.lit(106.0)) / 2
    ).withColumn("score_baseline", F.col("baseline_score"))


# -------------------------------------------------------------- identifiers

IDS_SQL = """
ids as (
  select 'lineitem' as source_database, '1' as source_version,
         case when l_returnflag = 'R' then 'negative_evidence' else 'positive_evidence' end as evidence_role,
         case when l_tax = 0.08 and l_discount = 0.1 then 'other' else 'ACC' end as namespace,
         concat('ACC', lpad(cast(l_suppkey * 31 % 997 as varchar), 4, '0'),
                case when l_quantity = 50 then '-2' else '' end) as raw_a,
         concat('ACC', lpad(cast(l_partkey % 997 as varchar), 4, '0')) as raw_b,
         case when l_returnflag = 'R' then 'negative' else 'positive' end as polarity,
         concat('R', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as source_record_id
  from lineitem),
ends as (
  select source_database, source_version, evidence_role, namespace, raw_a as raw_identifier from ids
  union all
  select source_database, source_version, evidence_role, namespace, raw_b from ids),
inventory as (
  select source_database, source_version, evidence_role, namespace, raw_identifier,
         case when namespace <> 'ACC' then ''
              when contains(raw_identifier, '-') then split_part(raw_identifier, '-', 1)
              else raw_identifier end as mapping_query_id,
         namespace = 'ACC' and contains(raw_identifier, '-') as isoform_specific,
         case when namespace <> 'ACC' then 'manual_review_non_uniprot_primary'
              when contains(raw_identifier, '-') then 'quarantine_isoform_specific'
              else 'mapping_candidate' end as mapping_status,
         count(*) as occurrence_count
  from ends group by all),
mapping as (
  select concat('ACC', lpad(cast(p_partkey % 997 as varchar), 4, '0')) as source,
         concat('T', cast(p_partkey % 997 as varchar), '_', cast(p_size as varchar)) as target
  from part),
reviewed as (
  select distinct target, upper(concat('SEQ', target)) as sequence
  from mapping where split_part(target, '_', 2) in ('1', '2')),
current_records as (
  select distinct target, split_part(target, '_', 2) = '3' as in_taxon, concat('cur', target) as sequence
  from mapping where split_part(target, '_', 2) in ('3', '4'))"""

RESOLUTION_SQL = IDS_SQL + """,
per_source as (
  select m.source, count(*) as n_targets,
         count(r.target) as n_reviewed, count(c.target) as n_known,
         count(*) filter (where c.in_taxon) as n_human,
         min(r.target) as reviewed_target, min(c.target) filter (where c.in_taxon) as human_target
  from (select distinct source, target from mapping) m
  left join reviewed r on m.target = r.target
  left join current_records c on m.target = c.target
  group by 1),
tree as (
  select i.*, coalesce(n_targets, 0) as n_targets, coalesce(n_reviewed, 0) as n_reviewed,
         coalesce(n_known, 0) as n_known, coalesce(n_human, 0) as n_human, reviewed_target, human_target
  from inventory i left join per_source s on i.mapping_query_id = s.source),
resolution as (
  select source_database, source_version, evidence_role, namespace, raw_identifier, mapping_query_id,
         n_targets, n_reviewed, v.s as resolution_status, v.r as resolution_reason, v.id as resolved_id
  from (
    select *, case
      when mapping_status = 'quarantine_isoform_specific'
        then {'s': 'quarantine', 'r': 'isoform_specific_source_not_folded_to_canonical', 'id': ''}
      when mapping_status = 'manual_review_non_uniprot_primary'
        then {'s': 'manual_review', 'r': 'non_uniprot_primary_identifier', 'id': ''}
      when n_targets = 0 then {'s': 'quarantine', 'r': 'unmapped_in_pinned_uniprot_release', 'id': ''}
      when n_reviewed = 1 then {'s': 'accepted', 'r': 'unique_reviewed_human_target', 'id': reviewed_target}
      when n_reviewed > 1 then {'s': 'quarantine', 'r': 'multiple_reviewed_human_targets', 'id': ''}
      when n_targets = 1 and n_human = 1
        then {'s': 'accepted', 'r': 'unique_current_human_target_unreviewed', 'id': human_target}
      when n_known < n_targets then {'s': 'deferred', 'r': 'target_record_missing_from_pinned_snapshot', 'id': ''}
      when n_human = 0 then {'s': 'excluded', 'r': 'no_human_target_in_pinned_release', 'id': ''}
      else {'s': 'quarantine', 'r': 'multiple_or_cross_species_targets_without_unique_human_mapping', 'id': ''}
      end as v
    from tree))"""


def identifier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows with raw accessions, isoforms and foreign namespaces."""
    accession = lambda c: F.concat(F.lit("ACC"), F.lpad((c % 997).cast("string"), 4, "0"))
    removed = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("source_database"),
        F.lit("1").alias("source_version"),
        F.when(removed, F.lit("negative_evidence")).otherwise(F.lit("positive_evidence")).alias("evidence_role"),
        F.when((F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1), F.lit("other"))
        .otherwise(F.lit("ACC"))
        .alias("namespace"),
        F.concat(
            accession(F.col("l_suppkey") * 31), F.when(F.col("l_quantity") == 50, F.lit("-2")).otherwise(F.lit(""))
        ).alias("raw_a"),
        accession(F.col("l_partkey")).alias("raw_b"),
        F.when(removed, F.lit("negative")).otherwise(F.lit("positive")).alias("polarity"),
        F.concat(
            F.lit("R"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")
        ).alias("source_record_id"),
    )


def id_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target) id mapping with 1:1, 1:n and unmapped sources."""
    node = F.col("p_partkey") % 997
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("ACC"), F.lpad(node.cast("string"), 4, "0")).alias("source"),
        F.concat(F.lit("T"), node.cast("string"), F.lit("_"), F.col("p_size").cast("string")).alias("target"),
    )


def reviewed_records(mapping: DataFrame) -> DataFrame:
    kind = F.substring_index("target", "_", -1)
    return mapping.where(kind.isin("1", "2")).select(
        "target", F.upper(F.concat(F.lit("SEQ"), "target")).alias("sequence")
    ).distinct()


def current_records(mapping: DataFrame) -> DataFrame:
    kind = F.substring_index("target", "_", -1)
    return mapping.where(kind.isin("3", "4")).select(
        "target", (kind == "3").alias("in_taxon"), F.concat(F.lit("cur"), "target").alias("sequence")
    ).distinct()


# ------------------------------------------------------------------ ledgers

LEDGER_SQL = """
ledger as (
  select event_type as method, cast((array[42, 123, 999])[user_id % 3 + 1] as integer) as seed, 'score' as stage,
         concat('I', cast(event_id % 700 as varchar)) as pair_id,
         case when value > 200 then 'failure' else 'success' end as status,
         case when event_type = 'error' then 0 else 1 end as gpu_count,
         case when event_type in ('error', 'view') then '' else concat('gpu-', event_type) end as gpu_model,
         case when event_type <> 'error' then value * 10 - 5 end as peak_gpu_memory_mib,
         abs(value) + 1 as wall_time_seconds, value / 10 as preprocessing_seconds,
         cast(floor(value * 100) as bigint) as output_bytes,
         cast(user_id % 300 as integer) as input_residues,
         sha256(props) as input_sha256, sha256(event_type) as command_sha256,
         case when value > 300 then 'bad' else sha256(cast(event_id as varchar)) end as stdout_sha256
  from events),
expected as (
  select distinct concat('I', cast(o_orderkey % 650 as varchar)) as pair_id from orders)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an item cost ledger; see LEDGER_SQL."""
    value = F.col("value")
    kind = F.col("event_type")
    seed = F.element_at(F.array(F.lit(42), F.lit(123), F.lit(999)), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        kind.alias("method"),
        seed.alias("seed"),
        F.lit("score").alias("stage"),
        F.concat(F.lit("I"), (F.col("event_id") % 700).cast("string")).alias("pair_id"),
        F.when(value > 200, F.lit("failure")).otherwise(F.lit("success")).alias("status"),
        F.when(kind == "error", 0).otherwise(1).alias("gpu_count"),
        F.when(kind.isin("error", "view"), F.lit("")).otherwise(F.concat(F.lit("gpu-"), kind)).alias("gpu_model"),
        F.when(kind != "error", value * 10 - 5).alias("peak_gpu_memory_mib"),
        (F.abs(value) + 1).alias("wall_time_seconds"),
        (value / 10).alias("preprocessing_seconds"),
        F.floor(value * 100).cast("bigint").alias("output_bytes"),
        (F.col("user_id") % 300).cast("int").alias("input_residues"),
        F.sha2("props", 256).alias("input_sha256"),
        F.sha2("event_type", 256).alias("command_sha256"),
        F.when(value > 300, F.lit("bad")).otherwise(F.sha2(F.col("event_id").cast("string"), 256)).alias("stdout_sha256"),
    )


def expected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("I"), (F.col("o_orderkey") % 650).cast("string")).alias("pair_id")
    ).distinct()


# ---------------------------------------------------------------- sequences

SEQUENCES_SQL = """
sequences as (
  select concat('DOC', lpad(cast(doc_id as varchar), 6, '0')) as entity_id,
         case when source = 'src0' then '10090' else '9606' end as taxid,
         upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as sequence, doc_id
  from documents),
proteins as (
  select entity_id, taxid, sequence,
         cast(length(sequence) + (case when doc_id % 50 = 0 then 1 else 0 end) as varchar) as sequence_length,
         case when doc_id % 40 = 0 then 'x' else sha256(sequence) end as sequence_sha256
  from sequences)"""


def sequence_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequence records, some with wrong lengths or digests."""
    base = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("DOC"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("entity_id"),
        F.when(F.col("source") == "src0", F.lit("10090")).otherwise(F.lit("9606")).alias("taxid"),
        F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"),
        "doc_id",
    )
    off = F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0)
    return base.select(
        "entity_id",
        "taxid",
        "sequence",
        (F.length("sequence") + off).cast("string").alias("sequence_length"),
        F.when(F.col("doc_id") % 40 == 0, F.lit("x")).otherwise(F.sha2("sequence", 256)).alias("sequence_sha256"),
    )
