"""Queries for classification, identifier resolution and table joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.classify import (
    EvidenceSettings,
    TermPolicy,
    assess,
    both_contain,
    classify_evidence,
    decision_counts,
    eligible,
    screen_filter,
    stable_sample,
    write_routed,
)
from pairloom.operators.coverage import (
    align,
    apply_audit,
    apply_clusters,
    best_ranked,
    coverage,
    overlap_audit,
    ranked_hits,
    review_select,
    select_cohort,
    unchanged_except,
)
from pairloom.operators.pairs import union_sources, used_entities
from pairloom.operators.profile import reason_histogram
from pairloom.operators.resolve import (
    deferred_targets,
    entity_table,
    identifier_inventory,
    mapping_profile,
    merge_dims,
    missing_targets,
    one_to_one_gate,
    request_ids,
    resolution_targets,
    resolve_endpoints,
    resolve_mapping,
    split_unresolved,
    unique_dim,
)
from pairloom.operators.rules import Rule, union_all, violations
from pairloom.plans.adapters import (
    IDS_SQL,
    OBS_SQL,
    PAIRS_SQL,
    PREDS_SQL,
    RESOLUTION_SQL,
    current_records,
    entities,
    id_mapping,
    identifier_rows,
    labelled_pairs,
    observations,
    predictions,
    reviewed_records,
    table,
)
from pairloom.plans.catalog import query
from pairloom.runtime import folder_bytes, scratch_path
from pairloom.streaming.classify import read_stream, route_stream
from pairloom.streaming.dedupe import collisions

# --------------------------------------------------------- classification

EVIDENCE_ROWS_SQL = """
evidence_rows as (
  select l_returnflag, l_linestatus,
         l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax
  from lineitem),
cascade as (
  select case
      when l_tax = 0.08 then {'d': 'excluded', 'r': 'not_two_human_endpoints'}
      when l_discount = 0.1 then {'d': 'excluded', 'r': 'not_two_protein_endpoints'}
      when l_returnflag = 'R' and l_quantity < 5 then {'d': 'excluded', 'r': 'negative_record_in_positive_archive'}
      when l_quantity > 45 then {'d': 'review', 'r': 'missing_or_ambiguous_interaction_type'}
      when l_linenumber = 1 then {'d': 'excluded', 'r': 'generic_or_nonphysical_interaction_type'}
      when l_linenumber = 2 then {'d': 'review', 'r': 'direct_interaction_descendant_requires_review'}
      when l_linenumber > 5 then {'d': 'excluded', 'r': 'not_direct_interaction_type'}
      when l_quantity < 3 then {'d': 'review', 'r': 'missing_or_ambiguous_detection_method'}
      when l_suppkey % 10 in (1, 2) then {'d': 'review', 'r': 'detection_method_requires_review'}
      when l_suppkey % 10 in (3, 4) then {'d': 'review', 'r': 'unlisted_detection_method'}
      when l_linestatus = 'O' and l_discount < 0.02 then {'d': 'review', 'r': 'participant_expansion_requires_review'}
      when l_tax = 0.07 then {'d': 'review', 'r': 'non_uniprot_primary_identifier'}
      when l_suppkey % 50 = l_partkey % 50 then {'d': 'review', 'r': 'self_pair_outside_primary_scope'}
      when l_orderkey % 100 < 5 then {'d': 'review', 'r': 'missing_source_record_identifier'}
      else {'d': 'candidate', 'r': 'auto_direct_candidate'} end as v
  from evidence_rows)"""

SETTINGS = EvidenceSettings(
    TermPolicy(
        type_accept=["MI:0003", "MI:0004", "MI:0005"],
        type_manual=["MI:0002", "MI:0003"],
        type_never=["MI:0001"],
        method_accept=["MI:1000", "MI:1005", "MI:1006", "MI:1007", "MI:1008", "MI:1009"],
        method_manual=["MI:1001"],
        method_never=["MI:1002"],
    )
)


def evidence_rows(spark: SparkSession, d: str, *more: Column | str) -> DataFrame:
    """Line items as an evidence archive with every column the cascade reads, and more."""
    taxon = F.when(F.col("l_tax") == 0.08, F.lit("taxid:10090(mouse)")).otherwise(F.lit("taxid:9606(human)"))
    kind = F.when(F.col("l_discount") == 0.1, F.lit("MI:0250(gene)")).otherwise(F.lit("MI:0326(protein)"))
    type_id = F.concat(F.lit("MI:000"), F.col("l_linenumber").cast("string"), F.lit("(type)"))
    method_id = F.concat(F.lit("MI:100"), (F.col("l_suppkey") % 10).cast("string"), F.lit("(method)"))
    ns_a = F.when(F.col("l_tax") == 0.07, F.lit("other:")).otherwise(F.lit("uniprotkb:"))
    open_line = (F.col("l_linestatus") == "O") & (F.col("l_discount") < 0.02)
    return table(spark, d, "lineitem").select(
        taxon.alias("taxid_a"),
        F.lit("taxid:9606(human)").alias("taxid_b"),
        F.lit("MI:0326(protein)").alias("kind_a"),
        kind.alias("kind_b"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 5), F.lit(" TRUE")).otherwise(F.lit("false")).alias("negative"),
        F.when(F.col("l_quantity") > 45, F.concat(type_id, F.lit("|MI:0999(x)"))).otherwise(type_id).alias("interaction_types"),
        F.when(F.col("l_quantity") < 3, F.lit("-")).otherwise(method_id).alias("detection_methods"),
        F.when(open_line, F.lit("spoke expansion")).otherwise(F.lit(" - ")).alias("expansion"),
        F.concat(ns_a, (F.col("l_suppkey") % 50).cast("string")).alias("primary_id_a"),
        F.concat(F.lit("uniprotkb:"), (F.col("l_partkey") % 50).cast("string")).alias("primary_id_b"),
        F.when(F.col("l_orderkey") % 100 < 5, F.lit(" -")).otherwise(F.concat(F.lit("R"), "l_orderkey")).alias("source_record_id"),
        *more,
    )


@query(
    "c1_evidence_cascade",
    "with " + EVIDENCE_ROWS_SQL + " select v.d as decision, v.r as reason, count(*) as n from cascade group by 1, 2",
)
def c1(spark: SparkSession, d: str) -> DataFrame:
    return decision_counts(classify_evidence(evidence_rows(spark, d), SETTINGS))


@query(
    "c2_route_decisions",
    "with " + EVIDENCE_ROWS_SQL + """
select v.d as decision, count(*) as n from cascade where v.d in ('candidate', 'review') group by 1""",
)
def c2(spark: SparkSession, d: str) -> DataFrame:
    rows = classify_evidence(evidence_rows(spark, d), SETTINGS)
    routed = write_routed(rows, scratch_path(spark, "routed"), ["candidate", "review"])
    return routed.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


DECISIONS = ["candidate", "excluded", "review"]
# A batch has a bounded size. Its fixed costs are those of a task for every piece of the state.
BATCH_BYTES = 512 << 20


@query(
    "c2_streamed_decisions",
    """
with contents as (
  select l_orderkey, l_linenumber, l_tax = 0.08 as mouse, l_discount = 0.1 as gene, l_returnflag = 'R' and l_quantity < 5 as negative,
         l_quantity > 45 as two_types, l_quantity < 3 as no_method, l_linestatus = 'O' and l_discount < 0.02 as expanded,
         l_tax = 0.07 as other_space, l_suppkey % 50 as a, l_partkey % 50 as b
  from lineitem),
seen as (
  select * from contents union
  select * replace (true as negative) from contents where l_linenumber = 4 and l_orderkey % 10 = 0),
decided as (
  select case
      when mouse then {'d': 'excluded', 'r': 'not_two_human_endpoints'}
      when gene then {'d': 'excluded', 'r': 'not_two_protein_endpoints'}
      when negative then {'d': 'excluded', 'r': 'negative_record_in_positive_archive'}
      when two_types then {'d': 'review', 'r': 'missing_or_ambiguous_interaction_type'}
      when l_linenumber = 1 then {'d': 'excluded', 'r': 'generic_or_nonphysical_interaction_type'}
      when l_linenumber = 2 then {'d': 'review', 'r': 'direct_interaction_descendant_requires_review'}
      when l_linenumber > 5 then {'d': 'excluded', 'r': 'not_direct_interaction_type'}
      when no_method then {'d': 'review', 'r': 'missing_or_ambiguous_detection_method'}
      when a % 10 in (1, 2) then {'d': 'review', 'r': 'detection_method_requires_review'}
      when a % 10 in (3, 4) then {'d': 'review', 'r': 'unlisted_detection_method'}
      when expanded then {'d': 'review', 'r': 'participant_expansion_requires_review'}
      when other_space then {'d': 'review', 'r': 'non_uniprot_primary_identifier'}
      when a = b then {'d': 'review', 'r': 'self_pair_outside_primary_scope'}
      when l_orderkey % 100 < 5 then {'d': 'review', 'r': 'missing_source_record_identifier'}
      else {'d': 'candidate', 'r': 'auto_direct_candidate'} end as v
  from seen)
select v.d as decision, v.r as reason, count(*) as n from decided group by 1, 2
union all
select 'collision', 'evidence_id_collision', count(*) from (
  select l_orderkey, l_linenumber from seen group by 1, 2 having count(*) > 1) having count(*) > 0""",
)
def c2_streamed(spark: SparkSession, d: str) -> DataFrame:
    """An archive that arrives in batches, with records that come again in later ones:
    unchanged (dropped) or under other content (kept, and reported)."""
    columns = evidence_rows(spark, d).columns
    keyed = evidence_rows(spark, d, "l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"))
    again = keyed.where("l_linenumber = 3")
    changed = keyed.where("l_linenumber = 4 and l_orderkey % 10 = 0").withColumn("negative", F.lit(" TRUE"))
    names = ["line_id", *columns]
    feed, target = scratch_path(spark, "feed"), scratch_path(spark, "streamed")
    batch = BATCH_BYTES
    for part in (keyed, again, changed):
        part.select(*names).write.mode("append").parquet(feed)
        # The first part is one batch at least, so repeats come in later ones.
        batch = min(batch, folder_bytes(spark, feed))
    stream = read_stream(spark, feed, spark.read.parquet(feed).schema, max_bytes=batch)
    run = route_stream(stream, SETTINGS, target, scratch_path(spark, "offsets"), DECISIONS, key=["line_id"], content=columns)
    run.awaitTermination()
    seen = spark.read.parquet(target)
    found = collisions(seen, ["line_id"]).select(F.lit("collision").alias("decision"), F.lit("evidence_id_collision").alias("reason"))
    return decision_counts(seen.select("decision", "reason").unionByName(found))


ASSESS_SQL = """
assessed as (
  select o_orderkey, list_sort(
           case when o_orderdate < timestamp '1995-01-01' then ['not_post_cutoff'] else [] end
           || case when o_orderstatus <> 'F' then ['not_final'] else [] end
           || case when o_totalprice > 400000 then ['value_above_limit'] else [] end
           || case when o_totalprice < 20000 then ['value_below_minimum'] else [] end
           || case when o_orderpriority like '5%' then ['priority_too_low'] else [] end) as reasons
  from orders)"""


def assessed_orders(spark: SparkSession, d: str) -> DataFrame:
    return assess(
        table(spark, d, "orders"),
        {
            "not_post_cutoff": F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"),
            "not_final": F.col("o_orderstatus") != "F",
            "value_above_limit": F.col("o_totalprice") > 400000,
            "value_below_minimum": F.col("o_totalprice") < 20000,
            "priority_too_low": F.col("o_orderpriority").startswith("5"),
        },
    )


@query(
    "c3_assess_all_reasons",
    "with " + ASSESS_SQL + """
select array_to_string(reasons, ';') as reasons, len(reasons) = 0 as eligible, count(*) as n from assessed group by 1, 2""",
)
def c3(spark: SparkSession, d: str) -> DataFrame:
    return assessed_orders(spark, d).groupBy(F.array_join("reasons", ";").alias("reasons"), "eligible").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "v1_rule_violations",
    """
select cast(o_orderkey as varchar) as key, r.rule_id, r.severity, r.message from orders,
  unnest([case when o_totalprice < 20000 then {'rule_id': 'value_too_low', 'severity': 'error', 'message': concat('status ', o_orderstatus)} end,
          case when o_orderpriority like '5%' then {'rule_id': 'low_priority', 'severity': 'warning', 'message': ''} end]) as u(r)
where r is not null""",
)
def v1(spark: SparkSession, d: str) -> DataFrame:
    rules = [
        Rule("value_too_low", F.col("o_totalprice") < 20000, F.concat(F.lit("status "), "o_orderstatus")),
        Rule("low_priority", F.col("o_orderpriority").startswith("5"), severity="warning"),
    ]
    return violations(table(spark, d, "orders"), ["o_orderkey"], rules)


@query(
    "c4_screen_filter",
    """
select event_type as source, case when event_type = 'signup' then 'out_of_scope'
   else case cast(user_id % 7 as integer) when 0 then 'negative_result'
        when 1 then case when event_type = 'error' then 'unrecognized_result' else 'positive_result' end
        when 2 then 'invalid_test' when 3 then 'autoactivator' when 4 then 'missing_result'
        when 5 then case when event_type = 'error' then 'positive_result' else 'unrecognized_result' end
        else 'unrecognized_result' end end as screen_reason, count(*) as n
from events group by 1, 2""",
)
def c4(spark: SparkSession, d: str) -> DataFrame:
    bucket = F.col("user_id") % 7
    is_error = F.col("event_type") == "error"
    # The error source writes results as decimals, the others as integers.
    result = (
        F.when(bucket == 0, F.when(is_error, F.lit("0.0")).otherwise(F.lit("0")))
        .when(bucket == 1, F.when(is_error, F.lit("1.")).otherwise(F.lit("1")))
        .when(bucket == 2, F.lit(" NA"))
        .when(bucket == 3, F.lit("AA "))
        .when(bucket == 4, F.lit(" "))
        .when(bucket == 5, F.when(is_error, F.lit("1.0")).otherwise(F.lit("0.0")))
        .otherwise(F.lit("??"))
    )
    negative = F.when(is_error, F.lit("0.0")).otherwise(F.lit("0"))
    marked = screen_filter(table(spark, d, "events"), F.col("event_type") != "signup", result, negative)
    return marked.groupBy(F.col("event_type").alias("source"), "screen_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c5_eligible_pairs",
    "with " + PAIRS_SQL + """
select pair_id, label, evidence_class from pairs where pair_status = 'eligible' and label in (0, 1)""",
)
def c5(spark: SparkSession, d: str) -> DataFrame:
    return eligible(labelled_pairs(spark, d)).select("pair_id", "label", "evidence_class")


@query(
    "c6_both_endpoints",
    "with " + OBS_SQL + """
select contains(raw_a, '1') and contains(raw_b, '1') as both_sides, count(*) as n from named group by 1""",
)
def c6(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).groupBy(both_contain("raw_a", "raw_b", "1").alias("both_sides")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "c7_stable_sample",
    """
select o_orderkey, sha256(concat('7:', cast(o_orderkey as varchar))) as selection_key from orders
order by 2, 1 limit 40""",
)
def c7(spark: SparkSession, d: str) -> DataFrame:
    return stable_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7, 40)


# ------------------------------------------------------ identifiers, joins


@query(
    "j1_merge_dimensions",
    """
with merged as (
  select distinct * from (
    select n_nationkey as k, n_name as payload from nation
    union all select n_nationkey, case when n_regionkey = 2 then lower(n_name) else n_name end from nation
    union all select 100 + r_regionkey, r_name from region))
select 'merged' as outcome, count(*) as n from merged
union all select 'conflict', count(*) from (select k from merged group by 1 having count(*) > 1)
union all select 'duplicate', count(*) from (select c_nationkey from customer group by 1 having count(*) > 1)""",
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    base = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("payload"))
    other = nation.select(
        F.col("n_nationkey").alias("k"),
        F.when(F.col("n_regionkey") == 2, F.lower("n_name")).otherwise(F.col("n_name")).alias("payload"),
    )
    region = table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("k"), F.col("r_name").alias("payload"))
    merged, conflicts = merge_dims(base, other.unionByName(region), ["k"])
    _, duplicates = unique_dim(table(spark, d, "customer"), ["c_nationkey"])
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("outcome"), "n")
    return union_all([count(merged, "merged"), count(conflicts, "conflict"), count(duplicates, "duplicate")])


def resolved_ids(spark: SparkSession, d: str) -> DataFrame:
    """Inventory of the identifier rows, resolved against the mapping."""
    mapping = id_mapping(spark, d)
    return resolve_mapping(inventory_rows(spark, d), mapping, reviewed_records(mapping), current_records(mapping))


def inventory_rows(spark: SparkSession, d: str) -> DataFrame:
    return identifier_inventory(
        identifier_rows(spark, d),
        ["raw_a", "raw_b"],
        ["source_database", "source_version", "evidence_role"],
        "namespace",
        "ACC",
    )


ENDPOINTS_SQL = RESOLUTION_SQL + """,
endpoints as (
  select i.*, case when a.resolution_status = 'accepted' then a.resolved_id else '' end as resolved_a,
         case when a.resolution_status is null then 'identifier_not_in_resolution_table'
              when a.resolution_status = 'accepted' then 'accepted' else a.resolution_reason end as status_a,
         case when b.resolution_status = 'accepted' then b.resolved_id else '' end as resolved_b,
         case when b.resolution_status is null then 'identifier_not_in_resolution_table'
              when b.resolution_status = 'accepted' then 'accepted' else b.resolution_reason end as status_b
  from ids i
  left join known a on i.evidence_role = a.evidence_role and i.namespace = a.namespace and i.raw_a = a.raw_identifier
  left join known b on i.evidence_role = b.evidence_role and i.namespace = b.namespace and i.raw_b = b.raw_identifier)"""

# Identifiers seen at most twice have another name in the table, to give unknown ones.
ENDPOINTS_SQL = ENDPOINTS_SQL.replace(
    "endpoints as (",
    "known as (select r.* replace (case when i.occurrence_count > 2 then r.raw_identifier"
    " else concat('?', r.raw_identifier) end as raw_identifier)"
    " from resolution r join inventory i using (evidence_role, namespace, raw_identifier)),\nendpoints as (",
)


def resolved_endpoints(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw_identifier")
    named = F.when(F.col("occurrence_count") > 2, raw).otherwise(F.concat(F.lit("?"), raw))
    return resolve_endpoints(identifier_rows(spark, d), resolved_ids(spark, d).withColumn("raw_identifier", named))


@query(
    "j2_resolve_endpoints",
    "with " + ENDPOINTS_SQL + """
select resolved_a, status_a, resolved_b, status_b, count(*) as n from endpoints group by 1, 2, 3, 4""",
)
def j2(spark: SparkSession, d: str) -> DataFrame:
    return resolved_endpoints(spark, d).groupBy("resolved_a", "status_a", "resolved_b", "status_b").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "j3_unresolved_quarantine",
    "with " + ENDPOINTS_SQL + """
select source_database, source_version,
       case when polarity = 'positive' then 'positive_evidence' else 'negative_evidence' end as evidence_role,
       source_record_id, raw_a, raw_b, status_a, status_b, 'unresolved_endpoint' as reason
from endpoints where resolved_a = '' or resolved_b = ''""",
)
def j3(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = split_unresolved(resolved_endpoints(spark, d))
    return rejected


@query("j4_identifier_inventory", "with " + IDS_SQL + " select * from inventory")
def j4(spark: SparkSession, d: str) -> DataFrame:
    return inventory_rows(spark, d)


@query(
    "j4_request_ids",
    "with " + IDS_SQL + """
select distinct namespace, mapping_query_id from inventory where mapping_status = 'mapping_candidate'""",
)
def j4_requests(spark: SparkSession, d: str) -> DataFrame:
    return request_ids(inventory_rows(spark, d))


@query(
    "j5_mapping_profile",
    "with " + IDS_SQL + """,
asked as (select distinct mapping_query_id as source from inventory where mapping_status = 'mapping_candidate'),
degrees as (
  select a.source, count(m.target) as rows, count(distinct m.target) as degree
  from asked a left join mapping m on a.source = m.source group by 1)
select unnest(['requested_ids', 'mapping_rows', 'mapped_ids', 'unmapped_ids', 'one_to_one_ids', 'one_to_many_ids', 'unique_target_ids']) as metric,
       unnest([count(*), cast(sum(rows) as bigint), count(*) filter (where degree > 0), count(*) filter (where degree = 0),
               count(*) filter (where degree = 1), count(*) filter (where degree > 1),
               (select count(distinct target) from mapping)]) as value
from degrees""",
)
def j5(spark: SparkSession, d: str) -> DataFrame:
    requested = request_ids(inventory_rows(spark, d)).select(F.col("mapping_query_id").alias("source"))
    return mapping_profile(id_mapping(spark, d), requested)


@query(
    "j6_resolve_mapping",
    "with " + RESOLUTION_SQL + " select * from resolution",
)
def j6(spark: SparkSession, d: str) -> DataFrame:
    return resolved_ids(spark, d).drop("isoform_specific", "mapping_status", "occurrence_count")


@query(
    "j6_resolution_targets",
    "with " + IDS_SQL + """
select m.source as mapping_query_id, m.target, r.target is not null as is_reviewed
from (select distinct source, target from mapping) m left join reviewed r on m.target = r.target
where m.source in (select mapping_query_id from inventory where mapping_query_id <> '')""",
)
def j6_targets(spark: SparkSession, d: str) -> DataFrame:
    mapping = id_mapping(spark, d)
    return resolution_targets(inventory_rows(spark, d), mapping, reviewed_records(mapping))


@query(
    "j7_deferred_targets",
    "with " + RESOLUTION_SQL + """,
targets as (
  select distinct target from mapping
  where source in (select mapping_query_id from resolution where resolution_status = 'deferred'))
select target, target not in (select target from current_records) as missing from targets""",
)
def j7(spark: SparkSession, d: str) -> DataFrame:
    mapping = id_mapping(spark, d)
    targets = deferred_targets(resolved_ids(spark, d), mapping)
    missing = missing_targets(targets, current_records(mapping)).withColumn("missing", F.lit(True))
    return targets.join(missing, "target", "left").select("target", F.coalesce("missing", F.lit(False)).alias("missing"))


@query(
    "j8_entity_table",
    "with " + RESOLUTION_SQL + """,
accepted as (select distinct resolved_id as entity_id from resolution where resolved_id <> ''),
found as (
  select entity_id, upper(coalesce(r.sequence, c.sequence, '')) as sequence, r.target is not null as is_reviewed,
         coalesce(r.target, c.target) is not null as has_record
  from accepted a left join reviewed r on a.entity_id = r.target left join current_records c on a.entity_id = c.target)
select entity_id, sequence, cast(length(sequence) as integer) as sequence_length, sha256(sequence) as sequence_sha256,
       is_reviewed, has_record from found""",
)
def j8(spark: SparkSession, d: str) -> DataFrame:
    mapping = id_mapping(spark, d)
    return entity_table(resolved_ids(spark, d), reviewed_records(mapping), current_records(mapping))


@query(
    "j9_one_to_one_gate",
    "with " + IDS_SQL + """,
degree as (select source, count(distinct target) as n, min(target) as t from mapping group by 1),
gated as (
  select i.raw_a, i.raw_b, coalesce(a.n, 0) as na, coalesce(b.n, 0) as nb, a.t as ta, b.t as tb
  from ids i left join degree a on i.raw_a = a.source left join degree b on i.raw_b = b.source)
select raw_a, raw_b, case when na = 1 and nb = 1 then ta else '' end as target_a,
       case when na = 1 and nb = 1 then tb else '' end as target_b, na as mapping_count_a, nb as mapping_count_b,
       count(*) as n
from gated group by all""",
)
def j9(spark: SparkSession, d: str) -> DataFrame:
    kept, rejected = one_to_one_gate(identifier_rows(spark, d), id_mapping(spark, d))
    one = F.lit(1).cast("bigint")
    rows = kept.select("raw_a", "raw_b", "target_a", "target_b", one.alias("mapping_count_a"), one.alias("mapping_count_b"))
    blank = F.lit("")
    other = rejected.select(
        "raw_a", "raw_b", blank.alias("target_a"), blank.alias("target_b"), "mapping_count_a", "mapping_count_b"
    )
    both = rows.unionByName(other)
    return both.groupBy(*both.columns).agg(F.count(F.lit(1)).alias("n"))


NODE_TABLE_SQL = PAIRS_SQL + """,
known_nodes as (
  select distinct concat(case when p_size > 20 then 'N' else 'Z' end, lpad(cast(p_partkey % 997 as varchar), 4, '0')) as entity_id from part)"""


@query(
    "j10_used_entities",
    "with " + NODE_TABLE_SQL + """,
used as (select node_a as e from pairs union select node_b from pairs)
select entity_id as key, 'used' as outcome from known_nodes where entity_id in (select e from used)
union all select e, 'endpoint_without_entity' from used where e not in (select entity_id from known_nodes)""",
)
def j10(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "part").select(
        F.concat(F.when(F.col("p_size") > 20, F.lit("N")).otherwise(F.lit("Z")), F.lpad((F.col("p_partkey") % 997).cast("string"), 4, "0")).alias("entity_id")
    ).distinct()
    used, missing = used_entities(labelled_pairs(spark, d), known)
    return used.select(F.col("entity_id").alias("key"), F.lit("used").alias("outcome")).unionByName(
        missing.select("key", F.col("rule_id").alias("outcome"))
    )


@query(
    "j11_coverage",
    """
with wanted as (select case when c_acctbal > 0 then c_custkey else -c_custkey end as k from customer),
seen as (select case when o_orderstatus <> 'P' then o_custkey else -2 * o_custkey end as k, count(*) as n from orders group by 1)
select coalesce(w.k, s.k) as k, i.issue from wanted w full join seen s on w.k = s.k,
  unnest([case when s.k is null then 'missing' when w.k is null then 'unexpected' end,
          case when s.n > 1 then 'duplicate' end]) as i(issue)
where i.issue is not null""",
)
def j11(spark: SparkSession, d: str) -> DataFrame:
    customer, order = F.col("c_custkey"), F.col("o_custkey")
    wanted = table(spark, d, "customer").select(F.when(F.col("c_acctbal") > 0, customer).otherwise(-customer).alias("k"))
    seen = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", order).otherwise(-2 * order).alias("k"))
    return coverage(wanted, seen, ["k"])


BASELINE_SQL = PREDS_SQL + """,
base as (
  select case when score < 0.9 then pair_id else concat('-', pair_id) end as pair_id,
         case when bootstrap_group = 'src1' then 1 - label else label end as label, baseline_score as score,
         bootstrap_group from preds)"""


@query(
    "j12_align_predictions",
    "with " + BASELINE_SQL + """
select coalesce(p.pair_id, b.pair_id) as key,
       case when p.pair_id is null then 'missing_candidate' when b.pair_id is null then 'missing_baseline'
            when p.label <> b.label then 'label_mismatch' else 'aligned' end as outcome
from preds p full join base b on p.pair_id = b.pair_id""",
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    preds = predictions(spark, d)
    key = F.col("pair_id")
    base = preds.select(
        F.when(F.col("score") < 0.9, key).otherwise(F.concat(F.lit("-"), key)).alias("pair_id"),
        F.when(F.col("bootstrap_group") == "src1", 1 - F.col("label")).otherwise(F.col("label")).alias("label"),
        F.col("baseline_score").alias("score"),
        "bootstrap_group",
    )
    aligned, found = align(preds, base, ["pair_id"], ["label", "bootstrap_group"])
    bad = found.select("key", F.col("rule_id").alias("outcome"))
    good = aligned.join(bad.select(F.col("key").alias("pair_id")), "pair_id", "left_anti")
    return good.select(F.col("pair_id").alias("key"), F.lit("aligned").alias("outcome")).unionByName(bad)


@query(
    "j13_select_cohort",
    "with " + PREDS_SQL + """
select p.pair_id as key, 'selected' as outcome, p.score from preds p where p.label = 0
union all select p.pair_id, 'evidence_class_mismatch', 0.0 from preds p where p.label = 0 and p.bootstrap_group = 'src2'
union all select concat('-', p.pair_id), 'missing_prediction', 0.0 from preds p where p.label is distinct from 0""",
)
def j13(spark: SparkSession, d: str) -> DataFrame:
    preds = predictions(spark, d)
    off = F.when(F.col("bootstrap_group") == "src2", F.lit("other")).otherwise(F.col("evidence_class"))
    key = F.col("pair_id")
    members = preds.withColumns(
        {
            "evidence_class": off,
            "pair_id": F.when(F.col("label") == 0, key).otherwise(F.concat(F.lit("-"), key)),
        }
    )
    selected, found = select_cohort(preds, members)
    return selected.select(F.col("pair_id").alias("key"), F.lit("selected").alias("outcome"), "score").unionByName(
        found.select("key", F.col("rule_id").alias("outcome"), F.lit(0.0).alias("score"))
    )


@query(
    "j14_apply_clusters",
    "with " + PAIRS_SQL + """,
members as (
  select first(entity_id order by entity_id) over (partition by cluster_id) as rep, entity_id
  from (select case when entity_id = 'N0007' then 'X7' else entity_id end as entity_id, cluster_id from nodes)
  union all select 'N0001', 'N0002' union all select 'N0003', 'X1')
select entity_id as key, case when rep is null then '' else concat('CLU_', rep) end as outcome from nodes n left join members m using (entity_id)
union all select 'N0007', 'missing_member' union all select 'N0002', 'duplicate_member' union all select 'X1', 'unexpected_member' union all select 'X7', 'unexpected_member'
union all select distinct rep, 'unknown_representative' from members where rep = 'X7'""",
)
def j14(spark: SparkSession, d: str) -> DataFrame:
    nodes = entities(spark, d)
    wrong = F.when(F.col("entity_id") == "N0007", F.lit("X7")).otherwise(F.col("entity_id"))
    listed = nodes.withColumn("entity_id", wrong)
    reps = listed.groupBy("cluster_id").agg(F.min("entity_id").alias("representative"))
    real = listed.join(reps, "cluster_id").select(
        "representative", F.col("entity_id").alias("member")
    )
    # One repeated and one unknown member, taken from two of the nodes.
    extra = nodes.where(F.col("entity_id").isin("N0001", "N0003")).select(
        F.col("entity_id").alias("representative"),
        F.when(F.col("entity_id") == "N0001", F.lit("N0002")).otherwise(F.lit("X1")).alias("member"),
    )
    out, found = apply_clusters(nodes.select("entity_id"), real.unionByName(extra), "CLU")
    return out.select(F.col("entity_id").alias("key"), F.coalesce("cluster_id", F.lit("")).alias("outcome")).unionByName(
        found.select("key", F.col("rule_id").alias("outcome"))
    )


@query(
    "j15_unchanged_except",
    """
select cast(c_custkey as varchar) as key, 'c_mktsegment' as "column", c_mktsegment as before, lower(c_mktsegment) as after
from customer where c_nationkey = 3 and c_acctbal >= 0
union all select cast(c_custkey as varchar), '(row)', 'present', 'absent' from customer where c_acctbal < 0
union all select cast(-c_custkey as varchar), '(row)', 'absent', 'present' from customer where c_acctbal < 0""",
)
def j15(spark: SparkSession, d: str) -> DataFrame:
    before = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    changed = F.when(F.col("c_nationkey") == 3, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    renamed = F.when(F.col("c_acctbal") < 0, -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    after = before.withColumns({"c_mktsegment": changed, "c_custkey": renamed})
    after = after.withColumn("c_name", F.upper("c_name"))
    return unchanged_except(before, after, ["c_custkey"], ["c_name"])


HITS_SQL = """
hits as (
  select concat('O', cast(l_orderkey as varchar)) as query, concat('P', cast(l_partkey as varchar)) as target,
         l_quantity / 50 as identity, 1 - l_discount * 6 as qcov, 1 - l_tax * 7 as tcov, l_extendedprice as bits
  from lineitem),
members as (
  select o_custkey as group_id, concat('O', cast(o_orderkey as varchar)) as query,
         concat('P', cast(o_orderkey % 5000 as varchar)) as entity_id from orders),
train as (
  select concat(case when p_size <= 10 then 'P' else 'Q' end, cast(p_partkey as varchar)) as entity_id from part),
good as (select * from hits where identity >= 0.3 and least(qcov, tcov) >= 0.5),
audit as (
  select m.group_id, bool_or(m.entity_id in (select entity_id from train)) as direct_overlap,
         bool_or(g.n is not null) as homology_overlap, count(*) as n_members,
         cast(sum(coalesce(g.n, 0)) as bigint) as eligible_hits
  from members m left join (select query, count(*) as n from good group by 1) g on m.query = g.query
  group by 1),
best as (
  select group_id, target from (
    select m.group_id, g.target, row_number() over (
      partition by m.group_id order by g.identity desc, g.bits desc, g.target) as r
    from members m join good g on m.query = g.query) where r = 1)"""


def similarity(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, hits, train): line items as hits of an order on a part."""
    hits = table(spark, d, "lineitem").select(
        F.concat(F.lit("O"), "l_orderkey").alias("query"),
        F.concat(F.lit("P"), "l_partkey").alias("target"),
        (F.col("l_quantity") / 50).alias("identity"),
        (1 - F.col("l_discount") * 6).alias("qcov"),
        (1 - F.col("l_tax") * 7).alias("tcov"),
        F.col("l_extendedprice").alias("bits"),
    )
    members = table(spark, d, "orders").select(
        F.col("o_custkey").alias("group_id"),
        F.concat(F.lit("O"), "o_orderkey").alias("query"),
        F.concat(F.lit("P"), F.col("o_orderkey") % 5000).alias("entity_id"),
    )
    train = table(spark, d, "part").select(
        F.concat(F.when(F.col("p_size") <= 10, F.lit("P")).otherwise(F.lit("Q")), "p_partkey").alias("entity_id")
    )
    return members, hits, train


@query(
    "j16_overlap_audit",
    "with " + HITS_SQL + """
select a.*, not direct_overlap and not homology_overlap as independence_passed, coalesce(b.target, '') as best_target
from audit a left join best b using (group_id)""",
)
def j16(spark: SparkSession, d: str) -> DataFrame:
    members, hits, train = similarity(spark, d)
    return overlap_audit(members, hits, train, 0.3, 0.5)


@query(
    "j16_ranked_hits",
    "with " + HITS_SQL + " select query, target, round(identity, 9) as identity, bits from good",
)
def j16_ranked(spark: SparkSession, d: str) -> DataFrame:
    _, hits, _ = similarity(spark, d)
    return ranked_hits(hits, 0.3, 0.5).select("query", "target", F.round("identity", 9).alias("identity"), "bits")


@query(
    "j17_apply_audit",
    "with " + HITS_SQL + """
select c_custkey as group_id, c_mktsegment, not direct_overlap and not homology_overlap as homology_audit_passed,
       direct_overlap as train_overlap
from customer join audit on c_custkey = group_id""",
)
def j17(spark: SparkSession, d: str) -> DataFrame:
    members, hits, train = similarity(spark, d)
    audit = overlap_audit(members, hits, train, 0.3, 0.5)
    out, _ = apply_audit(
        table(spark, d, "customer").select(F.col("c_custkey").alias("group_id"), "c_mktsegment"), audit
    )
    return out


@query(
    "j18_review_selection",
    "with " + ASSESS_SQL + """,
reviews as (
  select o_orderkey, o_orderstatus = 'F' as include, o_totalprice < 300000 as ok, o_orderpriority like '1%' as consulted,
         o_orderpriority like '2%' as no_reason from orders),
joined as (select r.*, len(a.reasons) = 0 as auto from reviews r join assessed a using (o_orderkey))
select 'included_but_ineligible' as outcome, count(*) as n from joined where include and not auto
union all select 'selection_saw_outputs', count(*) from joined where include and consulted
union all select 'not_scope_confirmed', count(*) from joined where include and not ok
union all select 'missing_rationale', count(*) from joined where no_reason
union all select 'selected', count(*) from joined where include and auto and ok and not consulted
union all select 'reviewed', count(*) from joined
union all select 'included', count(*) from joined where include
union all select 'excluded', count(*) from joined where not include""",
)
def j18(spark: SparkSession, d: str) -> DataFrame:
    candidates = assessed_orders(spark, d).select("o_orderkey", F.col("eligible").alias("auto_eligible"))
    reviews = table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_orderstatus") == "F").alias("include"),
        F.lit(True).alias("assembly_confirmed"),
        F.lit(True).alias("mapping_confirmed"),
        (F.col("o_totalprice") < 300000).alias("scope_confirmed"),
        F.col("o_orderpriority").startswith("1").alias("outputs_consulted"),
        F.lit("curator").alias("reviewer_role"),
        F.when(F.col("o_orderpriority").startswith("2"), F.lit(" ")).otherwise(F.lit("checked")).alias("rationale"),
    )
    selected, found, counts = review_select(candidates, reviews, "o_orderkey")
    rules = found.groupBy(F.col("rule_id").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    chosen = selected.agg(F.count(F.lit(1)).alias("n")).select(F.lit("selected").alias("outcome"), "n")
    cells = F.array(*[F.struct(F.lit(c).alias("outcome"), F.col(c).alias("n")) for c in counts.columns])
    return union_all([rules, chosen, counts.select(F.explode(cells).alias("c")).select("c.outcome", "c.n")])


@query(
    "j19_union_sources",
    """
with united as (
  select 'lines' as source_database, concat('N', cast(l_suppkey as varchar)) as raw_a, concat('N', cast(l_partkey as varchar)) as raw_b,
         'positive' as polarity, '' as definition from lineitem
  union all
  select 'orders', concat('N', cast(o_custkey as varchar)), concat('N', cast(o_orderkey as varchar)), 'negative', 'screen' from orders)
select source_database, polarity, definition, count(*) as n, count(distinct raw_a) as n_a, count(distinct raw_b) as n_b
from united group by 1, 2, 3""",
)
def j19(spark: SparkSession, d: str) -> DataFrame:
    columns = ["source_database", "raw_a", "raw_b", "polarity", "definition"]
    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    united = union_sources(
        [
            (
                table(spark, d, "lineitem"),
                {"source_database": "lines", "raw_a": name("l_suppkey"), "raw_b": name("l_partkey"), "polarity": "positive"},
            ),
            (
                table(spark, d, "orders"),
                {
                    "source_database": "orders", "raw_a": name("o_custkey"), "raw_b": name("o_orderkey"),
                    "polarity": "negative", "definition": "screen",
                },
            ),
        ],
        columns,
    )
    return united.groupBy("source_database", "polarity", "definition").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("raw_a").alias("n_a"), F.count_distinct("raw_b").alias("n_b")
    )


@query(
    "j20_best_ranked",
    """
with per_key as (
  select l_orderkey, count(*) as n, count(distinct l_linenumber) as nd, min(l_linenumber) as lo, max(l_linenumber) as hi,
         max(l_quantity) as best, max(l_quantity) filter (where l_linenumber = 1) as first from lineitem group by 1)
select cast(l_orderkey as varchar) as key, 'best' as outcome from lineitem where l_linenumber = 1
union all select cast(l_orderkey as varchar), 'duplicate_rank' from per_key where nd < n
union all select cast(l_orderkey as varchar), 'ranks_not_contiguous' from per_key where not (n = 4 and nd = 4 and lo = 1 and hi = 4)
union all select cast(l_orderkey as varchar), 'rank_zero_not_best' from per_key where first is null or first <> best""",
)
def j20(spark: SparkSession, d: str) -> DataFrame:
    ranked = table(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("rank"), F.col("l_quantity").alias("score")
    )
    best, found = best_ranked(ranked, ["l_orderkey"], "rank", "score", 4)
    return best.select(F.col("l_orderkey").cast("string").alias("key"), F.lit("best").alias("outcome")).unionByName(
        found.select("key", F.col("rule_id").alias("outcome"))
    )


@query(
    "a10_reason_histogram",
    "with " + ASSESS_SQL + " select reason, count(*) as n from (select unnest(reasons) as reason from assessed) group by 1",
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    return reason_histogram(assessed_orders(spark, d))
