import hashlib
import random
import zlib

import pytest
from cases import documents, with_extras, words_of
from pyspark.sql import functions as F

from pairloom.llm import periodic_runs as pr


def plain(words):
    """Every stretch of equal distances, period by period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((i, e - i, q) for (i, e), q in found.items())


def collapsed(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def strings(rng, count):
    for _ in range(count):
        kind = rng.randrange(6)
        letters = "abcd"[: rng.randint(1, 4)]
        text = [rng.choice(letters) for _ in range(rng.randint(0, 120))]
        if kind == 1:  # powers of powers
            u = [rng.choice(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 5) + [rng.choice(letters)]
            text = text[:9] + u * rng.randint(2, 6) + text[9:20]
        elif kind == 2:  # two stretches that touch or nearly do
            a, b = rng.randint(0, 40), rng.randint(0, 40)
            text = ["a", "b"] * a + rng.choice([[], ["a"], ["b"], ["c"]]) + ["a", "b"] * b + text[:5]
        elif kind == 3:  # Fibonacci
            x, y = ["a"], ["a", "b"]
            while len(y) < 200:
                x, y = y, y + x
            text = y[rng.randint(0, 20) :]
        elif kind == 4:  # a long period
            u = [str(rng.randrange(40)) for _ in range(rng.randint(10, 90))]
            text = text[:7] + (u * 5)[: rng.randint(len(u), 5 * len(u))] + text[7:14]
        elif kind == 5:  # the same with rare changes
            u = [rng.choice("ab") for _ in range(rng.randint(2, 25))]
            text = u * rng.randint(2, 9)
            text[rng.randrange(len(text))] = "c"
        yield text


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_all_stretches(seed):
    rng = random.Random(seed)
    texts = [[w.encode() for w in t] for t in strings(rng, 150)]
    counts, (start, length, period), left = pr.runs_of(texts)
    at = 0
    for words, n, text in zip(texts, counts.tolist(), left):
        got = list(zip(start[at : at + n].tolist(), length[at : at + n].tolist(), period[at : at + n].tolist()))
        want = plain(words)
        assert got == want, (words, set(want) ^ set(got))
        assert text.decode() == collapsed([w.decode() for w in words], want)
        at += n


def test_long_periods_need_progressions():
    """Periods up to thousands of words, and blocks that are periodic themselves."""
    rng = random.Random(1)
    for base in (["a", "b"] * 60 + ["a"], ["x"] * 50 + ["y"], [str(rng.randrange(9)) for _ in range(700)]):
        words = ["start", *(base * 5), "end", *(base * 2)]
        want = plain(words)
        _, found, _ = pr.runs_of([[w.encode() for w in words]])
        assert list(zip(*(c.tolist() for c in found))) == want
        assert max(q for _, _, q in want) == len(base)


def test_one_word_many_times():
    counts, found, left = pr.runs_of([[b"x"] * 50_000, [b"x"] * 11, [b"x"] * 12])
    assert counts.tolist() == [1, 0, 1] and [c.tolist() for c in found] == [[0, 0], [50_000, 12], [1, 1]]
    assert left == [b"x", b" ".join([b"x"] * 11), b"x"]


def expected(doc_id, text):
    words = words_of(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    digest = hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
    rest = hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, digest, rest)


def test_query_equals_definition(spark, tmp_path, monkeypatch):
    rows = [(i, t) for i, t, _ in documents()] + [(None, "a b " * 20), (None, None), (-7, "q " * 30), (10**12, "a b c " * 9)]
    rows += [(5000 + i, " ".join(f"w{(i * j) % 50}" for j in range(40))) for i in range(60)]
    docs = with_extras(spark.createDataFrame(rows, "doc_id bigint, text string")).withColumn("runs", F.lit(1))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(pr, "CHUNK_WORDS", 700)
    got = pr.op12_periodic_runs(spark, str(tmp_path)).collect()
    short = [r for r in rows if len(words_of(r[1])) <= 4000]
    want = sorted((expected(*r) for r in short), key=repr)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == want
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows if r[0] is not None) > 5


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert pr.op12_periodic_runs(spark, str(tmp_path)).collect() == []
