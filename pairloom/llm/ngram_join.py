"""N-gram Jaccard join by a forest of signature trees.

Texts with the same shingle set are one class; only classes are compared.

The upper levels of the forest are routed by Spark. A class stands under one
root for each token of its prefix: with its tokens in one order for all, the
first ``n - ceil(t * n) + 1`` of them. Classes without a common prefix token
cannot overlap enough, so no pair of roots is ever visited. The order puts
tokens that many texts hold last, by a sketch of fixed size; any order is exact,
this one keeps passages that many texts share from becoming roots.

Below a root stands a signature tree: its nodes hold the OR of their members'
token bitmaps and the range of their sizes. A dual traversal starts with the
pair of roots and opens pairs of children whose largest possible overlap still
reaches the threshold. Leaf pairs that survive are verified on the exact sets.

Large groups of near copies are joined beforehand by star links from a few
members (min-hash bands propose, exact sets verify); trees then visit only pairs
of classes that are not connected yet, so a group never turns into all its pairs.

Null and empty texts, and texts without words, have an empty set and link with
nothing. A row with a null id is its own component (null). Repeated rows and exact
copies share a component. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import fetch
from pairloom.llm.catalog import query, table
from pairloom.llm.words import mix, shingle_sets
from pairloom.operators.graph import components
from pairloom.runtime import drop_stage, stage

#: Bigints of a class's token bitmap.
BITMAP_WORDS = 8
#: Min-hash bands of two rows each, for the star links.
BANDS = 4
#: Slots of the sketch of token counts: two MiB whatever the data.
SKETCH_SLOTS = 1 << 20
#: Slots sent as one row.
SKETCH_RUN = 1 << 14
#: Members of one tree; larger roots are cut into blocks, and their trees meet in pairs.
TREE_MEMBERS = 1024
FAN_OUT = 8
#: Bits of the bitmap of roots with two classes or more: eight MiB.
ROOT_BITS = 1 << 26

_FEATURES = (
    "node bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, bits array<bigint>, run int, counts binary"
)
_FEATURE_SCHEMA = pa.schema(
    [
        ("node", pa.int64()),
        ("n", pa.int64()),
        ("d1", pa.int64()),
        ("d2", pa.int64()),
        ("bands", pa.list_(pa.int64())),
        ("bits", pa.list_(pa.int64())),
        ("run", pa.int32()),
        ("counts", pa.binary()),
    ]
)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    if not len(tokens):
        return 0, 0
    a, b = np.sum(mix(tokens + np.uint64(1)), dtype=np.uint64), np.bitwise_xor.reduce(mix(tokens ^ np.uint64(0xA5)))
    return int(mix(a.reshape(1)).view(np.int64)[0]), int(b.view(np.int64))


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * BITMAP_WORDS, np.uint8)
    bits[mix(tokens ^ np.uint64(0x51)) % np.uint64(len(bits))] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


_SALTS = np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)


def _bands(tokens: np.ndarray) -> list[int]:
    least = np.array([mix(tokens ^ s).min() for s in _SALTS])
    pairs = mix(mix(least[::2]) * np.uint64(3) + least[1::2] + _SALTS[:BANDS])
    return pairs.view(np.int64).tolist()


def features(docs: DataFrame, width: int) -> DataFrame:
    """One row per text with its set size, digest, bands and bitmap, and per task
    one row per run of the sketch of token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH_SLOTS, np.uint32)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for tokens in shingle_sets(batch.column(1), width):
                d1, d2 = _digest(tokens)
                some = len(tokens) > 0
                for column, value in zip(
                    columns,
                    (len(tokens), d1, d2, _bands(tokens) if some else None, _bitmap(tokens) if some else None),
                ):
                    column.append(value)
                np.add.at(sketch, tokens & np.uint64(SKETCH_SLOTS - 1), 1)
            rows = batch.num_rows
            nothing = [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
            arrays = [pa.array(c, t) for c, t in zip(columns, [f.type for f in _FEATURE_SCHEMA][1:6])]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *arrays, *nothing], schema=_FEATURE_SCHEMA)
        small = np.minimum(sketch, 65535).astype(np.uint16).reshape(-1, SKETCH_RUN)
        used = np.flatnonzero(small.any(axis=1))
        none = [pa.nulls(len(used), f.type) for f in list(_FEATURE_SCHEMA)[:6]]
        yield pa.record_batch(
            [*none, pa.array(used, pa.int32()), pa.array([small[r].tobytes() for r in used], pa.binary())],
            schema=_FEATURE_SCHEMA,
        )

    return docs.select("node", "text").mapInArrow(run, _FEATURES)


def token_sketch(rows: DataFrame) -> np.ndarray:
    """The summed sketch; runs are added on Spark, and the driver gathers a fixed number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for run, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[run] = sums.get(run, np.zeros(SKETCH_RUN, np.uint32)) + np.frombuffer(counts, np.uint16)
        yield pa.record_batch(
            [
                pa.array(list(sums), pa.int32()),
                pa.array([np.minimum(v, 1 << 31).astype(np.uint32).tobytes() for v in sums.values()], pa.binary()),
            ],
            names=["run", "counts"],
        )

    runs = rows.where("counts is not null").select("run", "counts").repartition("run")
    sketch = np.zeros((SKETCH_SLOTS // SKETCH_RUN, SKETCH_RUN), np.uint32)
    for run, counts in runs.mapInArrow(add, "run int, counts binary").toLocalIterator():
        sketch[run] += np.frombuffer(counts, np.uint32)
    # Only the order of magnitude matters: two bytes a slot travel to the tasks.
    return np.minimum(sketch.reshape(-1), 65535).astype(np.uint16)


def prefix_roots(
    docs: DataFrame, width: int, percent: int, sketch: np.ndarray, roots: np.ndarray | None
) -> DataFrame:
    """``root, d1`` rows: the prefix tokens of every text under the digest of its
    set, those in the bitmap ``roots`` if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, digests = [], []
            for tokens in shingle_sets(batch.column(0), width):
                n = len(tokens)
                if not n:
                    continue
                length = n - (n * percent + 99) // 100 + 1
                # The order: count of the slot, then the hash itself. Tokens are sorted.
                order = np.argsort(sketch[tokens & np.uint64(SKETCH_SLOTS - 1)], kind="stable")
                prefix = mix(tokens[order[:length]] + np.uint64(7))
                if roots is not None:
                    prefix = prefix[fetch.holds(roots, prefix & np.uint64(ROOT_BITS - 1))]
                found.append(prefix)
                digests.append(np.full(len(prefix), _digest(tokens)[0], np.int64))
            if found:
                yield pa.record_batch(
                    [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(digests))],
                    names=["root", "d1"],
                )

    return docs.select("text").mapInArrow(run, "root bigint, d1 bigint")


def _ones(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words.view(np.uint64)).sum(axis=-1).astype(np.int64)


def tree_pairs(
    sizes: np.ndarray, bits: np.ndarray, groups: np.ndarray, sides: np.ndarray | None, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of one tree that may reach the threshold and lie in
    different ``groups`` (and, if given, on different ``sides``).

    Members ordered by size are the leaves; each level above ORs the bitmaps of
    ``FAN_OUT`` nodes. A node's excess is the most tokens by which a member
    outnumbers its bits, so common tokens are at most the common bits plus it.
    """
    order = np.lexsort((bits[:, 0], sizes))
    levels = [(bits[order], sizes[order], sizes[order], sizes[order] - _ones(bits[order]))]
    while len(levels[-1][0]) > 1:
        b, low, high, excess = levels[-1]
        cut = np.arange(0, len(low), FAN_OUT)
        levels.append(
            (
                np.bitwise_or.reduceat(b, cut, axis=0),
                np.minimum.reduceat(low, cut),
                np.maximum.reduceat(high, cut),
                np.maximum.reduceat(excess, cut),
            )
        )
    left = right = np.zeros(1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        b, low, high, excess = levels[level]
        if level < len(levels) - 1:
            left, right = _children(left, right, len(low))
        if level == 0:
            apart = (left != right) & (groups[order[left]] != groups[order[right]])
            if sides is not None:
                apart &= sides[order[left]] != sides[order[right]]
            left, right = left[apart], right[apart]
        most = np.minimum(
            np.minimum(high[left], high[right]),
            _ones(b[left] & b[right]) + np.minimum(excess[left], excess[right]),
        )
        # overlap >= t / (1 + t) * (size + size), and size >= t * other size
        fits = most * (100 + percent) >= percent * (low[left] + low[right])
        fits &= np.minimum(high[left], high[right]) * 100 >= percent * np.maximum(low[left], low[right])
        if level == 0 and len(left):
            only = np.maximum(_ones(b[left] & ~b[right]) - high[left], _ones(b[right] & ~b[left]) - high[right])
            fits &= -only * (100 + percent) >= percent * (low[left] + low[right])
        left, right = left[fits], right[fits]
    return order[left], order[right]


def _children(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of node pairs, each unordered pair once."""
    step = np.arange(FAN_OUT)
    a = (left[:, None, None] * FAN_OUT + step[None, :, None]).repeat(FAN_OUT, 2).reshape(-1)
    b = (right[:, None, None] * FAN_OUT + step[None, None, :]).repeat(FAN_OUT, 1).reshape(-1)
    good = (a < n) & (b < n) & (a <= b)
    return a[good], b[good]


def tree_candidates(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs ``a, b`` of the rows of ``item, node, n, bits, component, side``;
    the rows of one item form one tree. Items are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            items = held.column("item").to_numpy()
            last = int(np.searchsorted(items, items[-1], "left")) if len(items) else 0
            if last:
                yield from pairs(held.slice(0, last))
                held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield from pairs(held)

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, n, group, side, item = (
            rows.column(c).to_numpy() for c in ("node", "n", "component", "side", "item")
        )
        bits = np.stack(rows.column("bits").combine_chunks().flatten().to_numpy().reshape(-1, BITMAP_WORDS))
        cuts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True])))
        a, b = [], []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            across = side[i:j] if side[i] != side[i:j].min() or side[i] != side[i:j].max() else None
            x, y = tree_pairs(n[i:j], bits[i:j], group[i:j], across, percent)
            if len(x):
                a.append(node[i + x])
                b.append(node[i + y])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    placed = members.select("item", "node", "n", "bits", "component", "side").repartition("item")
    return placed.sortWithinPartitions("item").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose exact sets reach the threshold. Texts of the second
    member travel to the first one's partition; a third of all pairs may share one."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = fetch.texts_of(docs, nodes)
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(
        texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("a").to_numpy()
            # Rows of one first member follow each other: its set is made once.
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            heads = list(shingle_sets(batch.column("ta").take(pa.array(first)), width))
            place = np.cumsum(np.concatenate(([0], a[1:] != a[:-1])))
            keep = np.zeros(len(a), bool)
            for k, tokens in enumerate(shingle_sets(batch.column("tb"), width)):
                head = heads[place[k]]
                common = len(np.intersect1d(head, tokens, assume_unique=True))
                keep[k] = common and 100 * common >= percent * (len(head) + len(tokens) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint").distinct()


def _may_reach(percent: int) -> Column:
    """Whether sizes and bitmaps of ``x`` and ``y`` allow the threshold."""

    def only(p: Column, q: Column) -> Column:
        return F.aggregate(
            F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))),
            F.lit(0),
            lambda s, c: s + c,
        )

    x, y = F.col("x.n"), F.col("y.n")
    most = F.least(x - only(F.col("x.bits"), F.col("y.bits")), y - only(F.col("y.bits"), F.col("x.bits")))
    return most * (100 + percent) >= (x + y) * percent


def ngram_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``node, n, component`` for the rows of ``node, text``: the component is the
    smallest node reachable over pairs with ``100 * common >= percent * union``."""
    known = stage(features(docs, width), "ngram-features")
    sets = known.where("counts is null").select("node", "n", "d1", "d2", "bands", "bits")
    classes = stage(
        sets.where("n > 0 and node is not null")
        .groupBy("d1", "d2", "n")
        .agg(F.min("node").alias("node"), F.min_by(F.struct("bands", "bits"), "node").alias("f"))
        .select("d1", "d2", "n", "node", "f.bands", "f.bits"),
        "ngram-classes",
    )
    sketch = token_sketch(known)

    # Star links: every member of a band with its smallest and its largest node.
    banded = classes.select("node", F.explode("bands").alias("band"))
    centres = banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    stars = (
        banded.join(centres, "band")
        .select("node", F.explode(F.array("lo", "hi")).alias("centre"))
        .where("node <> centre")
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        .distinct()
    )
    small = classes.select("node", "n", "bits")
    hopeful = (
        stars.join(small.alias("x"), F.col("a") == F.col("x.node"))
        .join(small.alias("y"), F.col("b") == F.col("y.node"))
        .where(_may_reach(percent))
        .select("a", "b")
    )
    links = stage(verified(stage(hopeful, "ngram-stars"), docs, width, percent), "ngram-links")
    reached = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    joined = stage(
        classes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node")),
        "ngram-joined",
    )

    # Roots that hold classes of at least two components.
    roots = prefix_roots(docs, width, percent, sketch, None)
    shared = roots.groupBy("root").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo < hi")
    marked = fetch.bitmap(shared.select(F.expr(f"root & {ROOT_BITS - 1}L")), ROOT_BITS)
    under = (
        prefix_roots(docs, width, percent, sketch, marked)
        .join(joined.select("d1", "node", "component"), "d1")
        .select("root", "node", "component")
        .distinct()
    )
    under = stage(under, "ngram-roots")
    count = (
        under.groupBy("root")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
        .where("lo < hi")
        .select("root", "members")
    )
    blocks = F.ceil(F.col("members") / TREE_MEMBERS).cast("int")
    members = (
        under.join(count, "root")
        .join(joined.select("node", "n", "bits"), "node")
        .withColumn("blocks", blocks)
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("item", F.xxhash64("root", F.least("side", "other"), F.greatest("side", "other")))
    )
    candidates = stage(tree_candidates(members, percent).distinct(), "ngram-pairs")
    more = verified(candidates, docs, width, percent)
    drop_stage(under)
    both = links.union(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
    final = components(both)
    named = classes.join(final, "node", "left").select(
        "d1", "d2", "n", F.coalesce("component", "node").alias("component")
    )
    return (
        sets.select("node", "n", "d1", "d2")
        .join(named, ["d1", "d2", "n"], "left")
        .select("node", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("node")).alias("component"))
    )


@query("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over 4-word shingles at 85 percent."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "text")
    return ngram_components(docs, 4, 85).select(
        F.col("node").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )
