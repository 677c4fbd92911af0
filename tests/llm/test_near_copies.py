import random
from collections import Counter

import numpy as np
import pytest
from cases import SCHEMA, documents, lowered, shingles_of, with_extras
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, line_dedup, ngram_join, words


def components_of(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_ngram_components_equal_all_pairs(spark, width, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREE_MEMBERS", 4)  # blocks of a large root meet in pairs
    rows = documents()
    df = with_extras(spark.createDataFrame(rows, SCHEMA)).drop("node").withColumnRenamed("doc_id", "node")
    got = ngram_join.ngram_components(df, width, percent).collect()
    sets = {i: shingles_of(t, width) for i, t, _ in rows}
    want = components_of(sets, percent)
    assert len(got) == len(rows)
    assert {(r.node, r.n, r.component) for r in got} == {(i, len(s), want[i]) for i, s in sets.items()}


def test_links_without_stars_are_not_lost(spark, monkeypatch):
    """Trees alone find every link: the star links are only a shortcut."""
    monkeypatch.setattr(ngram_join, "_may_reach", lambda percent: F.lit(False))
    rows = documents(9)
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("doc_id", "node")
    got = {r.node: r.component for r in ngram_join.ngram_components(df, 4, 85).collect()}
    assert got == components_of({i: shingles_of(t, 4) for i, t, _ in rows}, 85)


def test_ngram_empty_table(spark):
    df = spark.createDataFrame([], "node bigint, text string")
    assert ngram_join.ngram_components(df, 4, 85).count() == 0


def test_tree_pairs_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 60, 80, dtype=np.uint64) for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(5):
            c = b.copy()
            c[rng.integers(0, 80, rng.integers(0, 14))] = rng.integers(0, 1 << 60, dtype=np.uint64)
            sets.append(np.unique(c))
    sizes = np.array([len(s) for s in sets])
    bits = np.stack([ngram_join._bitmap(s) for s in sets])
    found = set(map(frozenset, zip(*map(np.ndarray.tolist, ngram_join.tree_pairs(sizes, bits, np.arange(len(sets)), None, 85)))))
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (sizes[i] + sizes[j] - common):
                assert frozenset((i, j)) in found
    assert len(found) < len(sets) * (len(sets) - 1) / 4


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = [t for _, t, _ in documents()]
    for width in (1, 4, 5):
        sets = list(words.shingle_sets(pa.array(texts), width))
        assert [len(s) for s in sets] == [len(shingles_of(t, width)) for t in texts]
    sliced = list(words.shingle_sets(pa.array(["zz top", *texts]).slice(1), 4))
    assert all((a == b).all() for a, b in zip(sliced, words.shingle_sets(pa.array(texts), 4)))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choices("abc ", k=rng.randint(0, 14)))
        b = "".join(rng.choices("abc ", k=rng.randint(0, 14)))
        d, most = levenshtein(a, b), rng.randint(0, 14)
        assert line_dedup.edit_distance_within(a, b, most) == (d <= most), (a, b, d, most)


def test_edit_distance_of_long_strings():
    """Starts that are too far apart end the search; they never end it too early."""
    rng = random.Random(2)
    found = Counter()
    for k in range(400):
        a = "".join(rng.choices("abcde ", k=rng.randint(60, 160)))
        b = list(a)
        for _ in range(rng.randint(0, 24) if k % 4 else 150):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            b = b or ["x"]
        b = "".join(b)
        d, most = levenshtein(a, b), rng.randint(0, 20)
        assert line_dedup.edit_distance_within(a, b, most) == (d <= most), (a, b, d, most)
        assert line_dedup.edit_distance_within(b, a, d)
        assert d == 0 or not line_dedup.edit_distance_within(a, b, d - 1)
        found[d <= most] += 1
    assert min(found.values()) > 50


def brute_lines(spark, rows):
    """Which lines stay, by comparing all distinct lines of five words or more; shorter
    ones are equal or not."""
    df = spark.createDataFrame([r[:2] for r in rows if r[0] is not None], "doc_id bigint, text string")
    of = {(r.doc_id, r.text): r.of for r in df.withColumn("of", line_dedup.row_key()).collect()}
    at, texts = {}, {}
    for i, t, _ in rows:
        for k, line in enumerate((t or "").split("\n")):
            key = tuple(line_dedup.normalised(line).split())
            if key and i is not None:
                at.setdefault(key, set()).add((i, of[i, t], k))
                texts[key] = line
    keys = sorted(at)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(keys):
        for y in keys[:i]:
            if min(len(x), len(y)) >= line_dedup.MIN_WORDS and line_dedup.similar(texts[x], texts[y]):
                parent[root(x)] = root(y)
    groups = {}
    for k in keys:
        groups.setdefault(root(k), set()).update(at[k])
    gone = {p for g in groups.values() for p in g if p != min(g)}
    return {(i, t, k) for (i, t), o in of.items() for k in range(len((t or "").split("\n"))) if (i, o, k) in gone}


@pytest.mark.parametrize("short", [2, 32])
def test_line_dedup_equals_all_pairs(spark, monkeypatch, short):
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 3)
    monkeypatch.setattr(line_dedup, "SHORT_RUN", short)
    rng = random.Random(4)
    rows = documents()
    long = [" ".join(f"term{rng.randrange(900)}" for _ in range(150)) for _ in range(4)]
    for k, line in enumerate(long * 6):
        w = line.split()
        w[rng.randrange(150)] = "changed" if k >= 4 else w[0]
        rows.append((5000 + k, "short\n" + " ".join(w), "a"))
    df = with_extras(spark.createDataFrame(rows, SCHEMA))
    got = line_dedup.dedup_lines(df)
    assert set(df.columns) <= set(got.columns)
    gone = brute_lines(spark, rows)
    want = Counter()
    for i, t, _ in rows:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, t, k) not in gone)
        want[i, kept, sum((i, t, k) in gone for k in range(len((t or "").split("\n"))))] += 1
    assert Counter((r.doc_id, r.text, r.n_removed) for r in got.collect()) == want


def test_line_dedup_short_lines_and_rows_of_one_id(spark):
    """Short lines go when equal, with near ones beside them; rows of one id keep their own lines."""
    fox = "the quick brown fox jumps over it"
    rows = [
        (1, f"home\n{fox}\n--\nshare this"), (2, f"nothing like that one here at all\n{fox}"),
        (2, "another body with own first line\nthis second line stands once only here"),
        (3, "Share, this!\nhome\nshare thus\n--"), (3, "Share, this!\nhome\nshare thus\n--"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(df).collect())
    assert got == Counter(
        [
            (1, rows[0][1], 0), (2, "nothing like that one here at all", 1), (2, rows[2][1], 0),
            (3, "share thus\n--", 2), (3, "share thus\n--", 2),
        ]
    )


def test_line_dedup_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "a line of five words"), (1, None), (2, "")], "doc_id bigint, text string")
    assert {tuple(r) for r in line_dedup.dedup_lines(df).select("doc_id", "text", "n_removed").collect()} == {
        (None, "a line of five words", 0), (1, None, 0), (2, "", 0),
    }
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def brute_leaks(rows, items):
    import re

    word = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")
    cut = lambda t: word.findall(lowered(t or ""))
    windows = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    found = {}
    for i, t in rows:
        s, w = windows(cut(t)), cut(t)
        for j, item in items:
            own = Counter(windows(cut(item)))
            n = sum(own.values())
            for k in range(len(w) - n - 4 + 1):
                shared = sum((Counter(s[k : k + n]) & own).values())
                if n and 100 * shared >= 80 * n:
                    found[i, j] = max(found.get((i, j), 0), shared / n)
    return found


def test_leaks(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(150)] + ["Über", "été"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(15, 60)))) for k in range(12)]
    items += [(90, None), (91, ""), (92, "only four words here"), (93, items[0][1]), (94, "r r r r r r r r")]
    rows = [(k, " ".join(rng.choices(vocabulary, k=80))) for k in range(30)]
    rows += [(100 + k, f"{rows[k][1]} {items[k][1].upper() if k == 3 else items[k][1]}, {rows[k + 1][1]}") for k in range(10)]
    edited = items[5][1].split()
    edited[1] = "changed"
    rows += [(200, "x " + " ".join(edited)), (201, None), (202, ""), (203, "r " * 40), (204, items[2][1]), (204, items[2][1])]
    docs = with_extras(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = brute_leaks(rows, items)
    assert set(got) <= set(want)  # what is reported is verified
    exact = {p for p, s in want.items() if s == 1}
    assert exact <= set(got) and (200, 5) in got
    assert all(abs(got[p] - want[p]) < 1e-4 for p in exact)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.leaks(docs, none).count() == 0
    assert decontaminate.leaks(docs.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def test_near_prints_find_all_within_radius(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    near = [p ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 14))) for p in prints]
    left = spark.createDataFrame([(i, 7, p, [1]) for i, p in enumerate(prints)], "doc_id bigint, n_words int, print bigint, shingles array<bigint>")
    right = spark.createDataFrame([(i, 7, p, [1]) for i, p in enumerate(near)], "item_id bigint, n_words int, print bigint, shingles array<bigint>")
    got = [(r.doc_id, r.item_id) for r in decontaminate.near_prints(left, right, ["n_words"]).collect()]
    bits = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    want = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(near) if bits(p, q) <= decontaminate.RADIUS}
    assert sorted(got) == sorted(want)
