"""Product codes of vectors: codebooks by rounds of nearest entries, with bounds.

Every vector is cut into equal parts, and each part position has a codebook. A round
assigns every part to its nearest entry and replaces entries by floored means. What a part
keeps between rounds is its entry, an upper bound on the distance to it, a lower bound for
each group of other entries, and the round in which each bound was made. All earlier
codebooks are kept, so a bound of round r is moved to round t by the distance between the
entry in r and in t: the norm of the sum of its moves, never more than the sum of the
norms. A group of entries is measured again only where the moved bounds meet. Distances
are whole numbers and bounds are rounded outwards, so the codes are those of a full search,
ties to the lower index included.

Each round is one pass over staged rows, which carry the scaled parts; a task adds one row
that holds its counts and sums, so that codes, bounds and sums come from the same attempt.
The driver gathers ``entries * (dimension + parts)`` totals a round, whatever the rows.

Rows whose vector is null or holds null, NaN or infinite components are left out. Vectors
shorter than the longest, or whose length the parts do not divide, count as ending in
zeros. Repeated ids are rows of their own; of the first codebook's ids each counts once,
with its least vector; a null id comes after all others. Null labels are a label. Fewer ids
than entries make a smaller codebook; no vectors, an empty result. Other columns are not
looked at. Components whose squares would not fit 64 bits raise ``OverflowError``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.catalog import query, table
from pairloom.runtime import drop_stage, stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Groups of entries that have a lower bound of their own.
GROUPS = 4
#: Room for rounding when bounds are moved.
SLACK = 1e-9

Codebook = np.ndarray  # (parts, entries, width), int64


@dataclass(frozen=True)
class Coded:
    """``id, label, code, error, measured`` rows, and the codebook of every round.

    ``measured`` is the number of distances to entries that a row needed in all rounds; a
    full search needs ``parts * entries`` in each.
    """

    rows: DataFrame
    history: list[Codebook]

    def digest(self) -> str:
        """SHA-256 of the last codebook's components by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.history[-1].ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))


def scaled(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of floored scaled components, padded with zeros."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(lengths), dim), np.int64)
    if len(flat) == out.size:
        out[:] = flat.reshape(out.shape)
    else:
        out[np.arange(dim) < lengths[:, None]] = flat
    return out


def profile(kept: DataFrame, entries: int) -> DataFrame:
    """One row per task: longest vector, largest magnitude, smallest distinct ids."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, top, nulls, ids = -1, 0.0, False, np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                keys, vectors = batch.column(0), batch.column(1)
                dim = max(dim, pc.max(pc.list_value_length(vectors)).as_py())
                top = max(top, float(np.abs(vectors.flatten().to_numpy(zero_copy_only=False)).max(initial=0)))
                nulls = nulls or keys.null_count > 0
                ids = np.unique(np.concatenate([ids, keys.drop_null().to_numpy(zero_copy_only=False)]))[:entries]
        if dim >= 0:
            columns = [pa.array([dim], pa.int32()), pa.array([top]), pa.array([nulls]), pa.array([ids], pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["dim", "top", "nulls", "ids"])

    return kept.select("id", "vector").mapInArrow(look, "dim int, top double, nulls boolean, ids array<long>")


def first_codebook(kept: DataFrame, ids: list[int], nulls: bool, dim: int, parts: int, entries: int) -> Codebook:
    chosen = F.col("id").isin(ids)
    if nulls and len(ids) < entries:
        chosen = chosen | F.col("id").isNull()
    rows = kept.where(chosen).groupBy("id").agg(F.min("vector").alias("vector"))
    found = rows.orderBy(F.col("id").asc_nulls_last()).toArrow().combine_chunks()
    vectors = scaled(found.column("vector").combine_chunks(), dim)
    return np.ascontiguousarray(vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2))


def squares(x: np.ndarray, entries: np.ndarray, small: bool) -> np.ndarray:
    """Squared distances of all rows to all entries, exact."""
    if small:  # every term and sum is below 2**53
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


@dataclass
class Bounds:
    """What the parts at one position keep: ``near`` is at least the distance to the
    entry ``code`` in round ``near_round``, ``far[g]`` at most the distance to any other
    entry of group g in ``far_round[g]``."""

    code: np.ndarray
    near: np.ndarray
    near_round: np.ndarray
    far: np.ndarray
    far_round: np.ndarray

    @classmethod
    def open(cls, n: int, groups: int) -> Bounds:
        """Bounds that say nothing."""
        return cls(
            np.zeros(n, np.uint8), np.full(n, np.inf, np.float32), np.zeros(n, np.uint8),
            np.zeros((n, groups), np.float32), np.zeros((n, groups), np.uint8),
        )


def nearest(x: np.ndarray, books: np.ndarray, kept: Bounds, small: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Make ``code`` the nearest entry in the last of ``books`` (rounds, entries, width)
    and return squared distances (in the last round only) and distances measured."""
    now = len(books) - 1
    entries = books[now]
    groups = np.array_split(np.arange(len(entries)), kept.far.shape[1])
    moves = np.sqrt(((books - entries) ** 2).sum(2).astype(np.float64)) * (1 + SLACK)
    widest = np.stack([moves[:, g].max(1) for g in groups], axis=1)
    near = (kept.near + moves[kept.near_round, kept.code]) * (1 + SLACK)
    far = kept.far - widest[kept.far_round, np.arange(len(groups))]
    far -= np.abs(far) * SLACK
    measured = np.zeros(len(x), np.int64)
    rows = np.arange(len(x)) if last else np.flatnonzero((far <= near[:, None]).any(1))

    # Measure the entry it has; then the groups whose bound still does not clear it.
    before = kept.code[rows].astype(np.int64)
    best = ((x[rows] - entries[before]) ** 2).sum(1)
    exact = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    measured[rows] += 1
    again = far[rows] <= np.minimum(near[rows], exact)[:, None]
    code, scans = before.copy(), []
    for g, members in enumerate(groups):
        at = np.flatnonzero(again[:, g])
        if not len(at):
            continue
        found = squares(x[rows[at]], entries[members], small)
        measured[rows[at]] += len(members)
        place = found.argmin(1)
        least, entry = found[np.arange(len(at)), place], members[place]
        better = (least < best[at]) | ((least == best[at]) & (entry < code[at]))
        best[at[better]], code[at[better]] = least[better], entry[better]
        scans.append((g, members, at, found))

    # The entry that a part left is now one of the others of its group.
    left = np.flatnonzero(code != before)
    group_of = np.repeat(np.arange(len(groups)), [len(m) for m in groups])
    behind = group_of[before[left]]
    bound = np.minimum(far[rows[left], behind], exact[left] * (1 - 3 * SLACK))
    kept.far[rows[left], behind] = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))
    kept.far_round[rows[left], behind] = now
    for g, members, at, found in scans:
        own = code[at] - members[0]
        held = np.flatnonzero((own >= 0) & (own < len(members)))
        others = np.sqrt(found.astype(np.float64))
        others[held, own[held]] = np.finfo(np.float32).max / 2
        kept.far[rows[at], g] = np.nextafter(others.min(1).astype(np.float32), np.float32(-np.inf))
        kept.far_round[rows[at], g] = now
    kept.code[rows] = code
    kept.near[rows] = np.nextafter(np.sqrt(best.astype(np.float64)).astype(np.float32), np.float32(np.inf))
    kept.near_round[rows] = now
    return best, measured


_KEPT = (("code", np.uint8), ("near", np.float32), ("near_round", np.uint8), ("far", np.float32), ("far_round", np.uint8))
_STATE = ", ".join(f"{name} binary" for name, _ in _KEPT)


def rows_of_bytes(values: np.ndarray) -> pa.Array:
    """A binary array with one row of ``values`` in each cell."""
    n = len(values)
    size = values.nbytes // max(n, 1)
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.Array.from_buffers(pa.binary(size), n, [None, data]).cast(pa.binary()) if size else pa.array([b""] * n)


def bytes_of_rows(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape).copy()


def round_of(rows: DataFrame, history: list[Codebook], whole: type, small: bool, groups: int, last: bool) -> DataFrame:
    """Assign all rows to the last codebook. Rows come as vectors in the first round,
    then as the staged rows of the round before."""
    parts, entries, width = history[0].shape
    books = np.stack(history).transpose(1, 0, 2, 3)
    fresh = "vector" in rows.columns
    shapes = {"far": (parts, groups), "far_round": (parts, groups)}
    keys = rows.select("id", "label").schema

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries, width + 1), np.int64)
        names = keys_like = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = dict(zip(batch.schema.names, batch.columns))
            n = batch.num_rows
            if fresh:
                x = scaled(cell["vector"], parts * width).reshape(n, parts, width)
                held = [Bounds.open(n, groups) for _ in range(parts)]
                measured = np.zeros(n, np.int64)
            else:
                x = bytes_of_rows(cell["whole"], whole, (parts, width)).astype(np.int64)
                tables = {name: bytes_of_rows(cell[name], kind, shapes.get(name, (parts,))) for name, kind in _KEPT}
                held = [Bounds(*(np.ascontiguousarray(tables[name][:, p]) for name, _ in _KEPT)) for p in range(parts)]
                measured = cell["measured"].to_numpy(zero_copy_only=False).copy()
            error = np.zeros(n, np.int64)
            for p in range(parts):
                best, cost = nearest(x[:, p], books[p], held[p], small, last)
                measured += cost
                if last:
                    error += best
                else:
                    np.add.at(counts[p], held[p].code, np.column_stack([np.ones(n, np.int64), x[:, p]]))
            code = np.stack([h.code for h in held], axis=1)
            if last:
                text = code.tobytes().hex()
                codes = [text[2 * parts * i : 2 * parts * (i + 1)] for i in range(n)]
                out = [cell["id"], cell["label"], pa.array(codes, pa.string()), pa.array(error), pa.array(measured)]
                yield pa.record_batch(out, ["id", "label", "code", "error", "measured"])
                continue
            out = [cell["id"], cell["label"], rows_of_bytes(x.astype(whole))]
            out += [rows_of_bytes(np.stack([getattr(h, name) for h in held], axis=1)) for name, _ in _KEPT]
            out += [pa.array(measured), pa.nulls(n, pa.list_(pa.int64()))]
            names = ["id", "label", "whole", *[name for name, _ in _KEPT], "measured", "sums"]
            keys_like = [c.type for c in out]
            yield pa.record_batch(out, names)
        if names:
            yield pa.record_batch(
                [*(pa.nulls(1, kind) for kind in keys_like[:-1]), pa.array([counts.ravel()], pa.list_(pa.int64()))], names
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    made = "code string, error long, measured long" if last else f"whole binary, {_STATE}, measured long, sums array<long>"
    return rows.mapInArrow(assign, f"{kinds}, {made}")


def next_codebook(staged: DataFrame, book: Codebook) -> Codebook:
    """Floored means of the parts of every entry; an entry without parts stays."""
    cells = staged.where("sums is not null").select(F.posexplode("sums").alias("cell", "v"))
    totals = np.zeros((book.shape[0], book.shape[1], book.shape[2] + 1), np.int64)
    flat = totals.reshape(-1)
    for cell, v in cells.groupBy("cell").agg(F.sum("v")).toLocalIterator():
        flat[cell] = v
    n = totals[:, :, :1]
    return np.where(n > 0, totals[:, :, 1:] // np.maximum(n, 1), book)


def compress(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS,
) -> Coded:
    """Train the codebooks on all rows and code them; ``entries`` is at most 256."""
    if not 1 <= entries <= 256 or rounds > 255:
        raise ValueError("entries and rounds must fit a byte")
    kept = df.select(
        F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")
    ).where(usable(F.col("vector")))
    seen = stage(profile(kept, entries), "vector-profile")
    dim, top, nulls = seen.agg(F.max("dim"), F.max("top"), F.max("nulls")).first()
    if dim is None:
        none = "string(null) AS code", "bigint(null) AS error", "bigint(null) AS measured"
        return Coded(kept.selectExpr("id", "label", *none), [])
    ids = [r[0] for r in seen.select(F.explode("ids").alias("id")).distinct().orderBy("id").limit(entries).collect()]
    dim = -(-max(dim, 1) // parts) * parts
    reach = dim * (2 * (SCALE * top + 1)) ** 2
    if reach >= 2**62 or SCALE * top >= 2**31 - 1:
        raise OverflowError(f"components up to {top}: errors would not fit 64 bits")
    small = reach < 2**52
    history = [first_codebook(kept, ids, nulls, dim, parts, entries)]
    groups = min(groups, history[0].shape[1])
    whole = np.int16 if SCALE * top < 2**15 - 1 else np.int32
    rows = kept
    for _ in range(rounds):
        done = stage(round_of(rows, history, whole, small, groups, last=False), "vector-round")
        history.append(next_codebook(done, history[-1]))
        if rows is not kept:
            drop_stage(rows)
        rows = done.where("sums is null")
        rows.staged_path = done.staged_path
    coded = stage(round_of(rows, history, whole, small, groups, last=True), "vector-codes")
    if rows is not kept:
        drop_stage(rows)
    return Coded(coded, history)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``, the error of all rows of the same label. Tasks add up first;
    the totals are staged, so that Spark knows their size when it picks the join."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = stage(totals.withColumnRenamed("label", "_label"), "label-errors")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def _round_sql(t: int) -> str:
    """Nearest entries in codebook t, ties to the lower index, and codebook t + 1."""
    return f"""
near{t} as materialized (
  select vec_id, p, min(d * {ENTRIES} + k) % {ENTRIES} as k, min(d * {ENTRIES} + k) // {ENTRIES} as d
  from (select c.vec_id, p, e.k, cast(sum((c.x - e.y) * (c.x - e.y)) as bigint) as d
        from cells c join book{t} e using (p, j) group by all) group by all),
book{t + 1} as materialized (
  select e.p, e.k, e.j, coalesce(m.y, e.y) as y
  from book{t} e left join (
    select p, k, j, cast(floor(sum(x)::double / count(*)) as bigint) as y
    from cells join near{t} using (vec_id, p) group by all) m using (p, k, j))"""


_SQL = f"""
with kept as (
  select vec_id, label, len(embedding) // {PARTS} as w,
         list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cells as materialized (
  select vec_id, i // w as p, i % w as j, v[i + 1] as x from (select *, unnest(range(len(v))) as i from kept)),
book0 as (
  select p, k, j, x as y
  from cells join (select vec_id, row_number() over (order by vec_id) - 1 as k from kept order by vec_id limit {ENTRIES}) using (vec_id)),
{",".join(_round_sql(t) for t in range(ROUNDS + 1))},
coded as (
  select vec_id, label, string_agg(format('{{:02x}}', n.k), '' order by p) as code, cast(sum(d) as bigint) as error
  from near{ROUNDS} n join kept using (vec_id) group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(cast(y as varchar), ',' order by p, k, j)) from book{ROUNDS}) as codebooks_sha256
from coded"""


@query("op11_vector_codes", _SQL)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all usable embeddings, and a digest of the codebooks."""
    coded = compress(table(spark, sf_dir, "embeddings"))
    rows = with_label_error(coded.rows)
    digest = coded.digest() if coded.history else None
    return rows.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256")
    )
