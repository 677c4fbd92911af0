"""Mix sources to target weights: equal-token blocks by Sainte-Laguë apportionment.

1. Sources get targets by weight, stopped at a multiple of their size; the
   excess is shared again by weight among the others.
2. Documents fall into shards by a seeded hash of their id. In a shard, the
   words of one source, in hash order, form a stream that is cut into blocks of
   equal length (the last one of a stream may be shorter).
3. Each shard has a house of blocks. Its sources compete for them with their
   highest quotients ``votes / (2 * seats + 1)``, which gives integer quotas.
4. A quota takes every block of the stream equally often, and the remainder by
   a seeded even spread, so what a document gives follows from where it lies in
   the stream: no block is ever a row.

Shards are of bounded size, so a source that holds a third of all rows is
spread over many windows. Null texts have size 0 and give nothing; null is a
source of its own, the last. Repeated rows are documents of their own. An empty
table gives an empty result. The result depends on ids, sources, sizes and the
seed only, never on the physical layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.catalog import query, table
from pairloom.runtime import stage

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 18
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _drawn(*parts: Column | int) -> Column:
    """60 seeded bits of the parts, the same in every engine that has MD5."""
    text = F.concat_ws("-", *[F.lit(p) if isinstance(p, int) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source with its ``target``: ``min(most * size, weight * level)``
    for the one level at which the targets share all words.

    Sources reach their stop in the order of size per weight, so running sums in
    that order give the level. One row per source meets in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    place = F.row_number().over(by_name)
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.get(F.array(*map(F.lit, weights)), (place - 1) % len(weights)))
    )
    spent = most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    passed = F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - spent) / (F.sum("weight").over(everything) - passed)
    sources = sources.withColumns({"level": level, "stop": F.row_number().over(by_stop)}).withColumn(
        "open", F.col("source_size") * most > F.col("weight") * F.col("level")
    )
    chosen = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("stop"))).over(
        everything
    )
    return sources.withColumn("share", F.col("weight") * F.coalesce(chosen, F.lit(0.0))).select(
        "source",
        "source_size",
        F.least((F.col("source_size") * most).cast("double"), F.col("share")).alias("target"),
    )


def sainte_lague(parties: DataFrame, group: str, party: str, votes: str, house: str, cap: str) -> DataFrame:
    """Add ``seats``: the ``house`` highest quotients ``votes / (2k + 1)`` of each
    group, at most ``cap`` per party; ties go to more votes, then to the party
    name, null last.

    The divisor that would seat the house in fractions starts every party within
    a few seats. Only quotients that can still move, those between the rounded
    seats and the last one that a single further seat each would reach, are
    ranked, so the work per group is in proportion to its parties.
    """
    whole = Window.partitionBy(group)
    divisor = F.sum(votes).over(whole) / F.col(house)
    start = F.when(
        (F.col(house) > 0) & (F.col(votes) > 0),
        F.least(F.col(cap), F.floor(F.col(votes) / divisor + 0.5)),
    ).otherwise(0)
    p = parties.withColumn("_start", start.cast("long"))
    p = p.withColumn("_gap", F.col(house) - F.sum("_start").over(whole))
    # Lacking seats: the next quotients, highest first. Excess: the last ones, lowest first.
    lacking = F.col("_gap") > 0
    room = F.when(lacking, F.col(cap) - F.col("_start")).otherwise(F.col("_start"))
    p = p.withColumn("_room", F.when((F.col("_gap") == 0) | (F.col(votes) <= 0), 0).otherwise(room))

    def quotient(step: Column) -> Column:
        seat = F.when(lacking, F.col("_start") + step).otherwise(F.col("_start") - step + 1)
        return F.col(votes) / (2 * seat - 1)

    # Order in which quotients move: sign * quotient descending.
    sign = F.when(lacking, 1).otherwise(-1)
    first = F.when(F.col("_room") > 0, sign * quotient(F.lit(1)))
    ranked = whole.orderBy(F.col("_first").desc_nulls_last())
    p = p.withColumn("_first", first)
    p = p.withColumn("_rank", F.row_number().over(ranked))
    least = F.max(F.when(F.col("_rank") == F.abs("_gap"), F.col("_first"))).over(whole)
    p = p.withColumn("_least", least)
    # seat numbers whose quotient is on the moving side of _least
    reach = F.when(
        F.col("_least").isNull(), F.abs("_gap")
    ).when(
        lacking, F.floor((F.col(votes) / F.col("_least") + 1) / 2) - F.col("_start") + 1
    ).otherwise(F.col("_start") - F.floor((F.col(votes) / -F.col("_least") + 1) / 2) + 2)
    steps = F.greatest(F.lit(0), F.least(F.col("_room"), F.abs("_gap"), reach)).cast("long")
    moving = p.select("*", F.explode_outer(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps))).alias("_step"))
    moving = moving.withColumn("_move", F.when(F.col("_step").isNotNull(), sign * quotient(F.col("_step"))))
    tie = F.when(lacking, F.col(votes)).otherwise(-F.col(votes))
    name_up = F.when(lacking, F.col(party))
    name_down = F.when(~lacking, F.col(party))
    order = whole.orderBy(
        F.col("_move").desc_nulls_last(),
        tie.desc(),
        name_up.asc_nulls_last(),
        name_down.desc_nulls_first(),
    )
    moved = F.when(
        F.col("_move").isNotNull() & (F.row_number().over(order) <= F.abs("_gap")), sign
    ).otherwise(0)
    keep = parties.columns
    return (
        moving.withColumn("_moved", moved)
        .groupBy(*keep, "_start")
        .agg(F.sum("_moved").alias("_moved"))
        .select(*keep, (F.col("_start") + F.col("_moved")).alias("seats"))
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, shard`` for every row of ``docs``.

    ``block_words`` is the longest block; where the smallest source has fewer
    than 16 of them, blocks are shorter, so that it too comes near its target.
    Join the result to the documents by id to write the mixture.
    """
    sized = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")
        ),
        "mix-sizes",
    )
    targets = stage(source_targets(sized, weights, most_repeats), "mix-targets")
    total, smallest = targets.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)),
        F.coalesce(F.min(F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(1)),
    ).first()
    block = max(1, min(block_words, smallest // 16))
    shards = -(-total // shard_words) or 1
    sized = sized.withColumns(
        {"at": _drawn(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))}
    ).withColumn("shard", F.col("at") % shards)

    cells = (
        sized.groupBy("shard", "source")
        .agg(F.sum("size").alias("cell_size"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("cell_size") / F.lit(block))).cast("long"))
        .alias("c")
        .join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        .select("c.shard", "c.source", "c.blocks", "c.cell_size", "t.source_size", "t.target")
        .withColumn(
            "votes",
            F.when(F.col("cell_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(0.0),
        )
        .withColumn("house", F.round(F.sum("votes").over(Window.partitionBy("shard"))).cast("long"))
        .withColumn("cap", F.col("blocks") * most_repeats)
    )
    # The start of the even spread: a seeded phase of each stream.
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    quotas = sainte_lague(cells, "shard", "source", "votes", "house", "cap").withColumn(
        "phase", _drawn(seed, F.col("shard"), name) % F.col("blocks")
    )
    stream = Window.partitionBy("shard", "source").orderBy("at", "doc_id", "size")
    placed = sized.withColumn(
        "end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )

    def taken_before(x: Column) -> Column:
        """Words taken from the first ``x`` words of a stream."""
        at = ((x - x % block) / block).cast("long")
        every = F.expr("seats div blocks")
        rest = F.col("seats") % F.col("blocks")
        chosen = F.floor((at * rest + F.col("phase")) / F.col("blocks"))
        following = F.floor(((at + 1) * rest + F.col("phase")) / F.col("blocks"))
        return every * x + chosen * block + (following - chosen) * (x - at * block)

    return (
        placed.alias("d")
        .join(
            quotas.alias("q"),
            (F.col("d.shard") == F.col("q.shard")) & F.col("d.source").eqNullSafe(F.col("q.source")),
        )
        .select("d.doc_id", "d.size", "q.source_size", "q.target", "q.seats", "q.blocks", "q.phase", "d.end", "d.shard")
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            F.coalesce(taken_before(F.col("end")) - taken_before(F.col("end") - F.col("size")), F.lit(0))
            .cast("long")
            .alias("taken"),
            "shard",
        )
    )


# The whole apportionment spelled out: every quotient is a row and is ranked.
_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('17-' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as drawn
  from documents),
w as (
  select source, sum(size)::bigint as ss, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from d group by source),
o as (
  select *, row_number() over p as stop,
    3 * coalesce(sum(ss) over (p rows between unbounded preceding and 1 preceding), 0) as spent,
    coalesce(sum(weight) over (p rows between unbounded preceding and 1 preceding), 0) as passed
  from w window p as (order by ss::double / weight, source nulls last)),
l as (
  select *, ((select sum(ss) from w) - spent)::double / ((select sum(weight) from w) - passed)::double as level from o),
t as (
  select source, ss, least(3.0 * ss, weight * coalesce(
    (select min_by(level, stop) from l where 3 * ss > weight * level), 0.0))::double as target from l),
n as (
  select greatest(1, least(32, coalesce(min(ss) filter (ss > 0), 1) // 16))::bigint as block,
    greatest(1, ceil(sum(ss) / 262144.0))::bigint as shards from t),
s as (select d.*, drawn % shards as shard, block from d, n),
c as (
  select shard, s.source, ss, target, block, greatest(1, ceil(sum(size)::double / block))::bigint as blocks,
    case when sum(size) > 0 then target / ss * greatest(1, ceil(sum(size)::double / block)) else 0.0 end as votes
  from s join t on s.source is not distinct from t.source group by shard, s.source, t.source, ss, target, block),
h as (select *, round(sum(votes) over (partition by shard))::bigint as house from c),
q as (
  select shard, source, house, votes, votes / (2 * k + 1) as quotient
  from (select *, unnest(range(0, 3 * blocks)) as k from h where votes > 0)),
r as (
  select * from q qualify row_number() over (
    partition by shard order by quotient desc, votes desc, source nulls last) <= house),
z as (
  select h.*, coalesce(x.seats, 0) as seats,
    ('0x' || substr(md5('17-' || h.shard || '-' || coalesce('s' || h.source, 'null')), 1, 15))::bigint % blocks as phase
  from h left join (select shard, source, count(*) as seats from r group by all) x
    on h.shard = x.shard and h.source is not distinct from x.source),
e as (
  select *, sum(size) over (partition by shard, source order by drawn, doc_id, size rows unbounded preceding)::bigint as stop from s),
b as (
  select e.doc_id, e.size, z.ss, z.target, z.shard, unnest([e.stop, e.stop - e.size]) as x, unnest([1, -1]) as sign,
    z.block, seats // blocks as every, seats % blocks as rest, blocks, phase, e.stop
  from e join z on e.shard = z.shard and e.source is not distinct from z.source)
select doc_id, size, ss as source_size, target, shard,
  sum(sign * (every * x + ((x // block * rest + phase) // blocks) * block
    + (((x // block + 1) * rest + phase) // blocks - (x // block * rest + phase) // blocks) * (x % block)))::bigint as taken
from b group by doc_id, size, ss, target, shard, stop
"""


@query("op10_mix", _SQL)
def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed at weights 5, 2, 1 with at most three repeats."""
    return mix(table(spark, sf_dir, "documents"))
