import random

from test_near_copies import brute_leaks

from pairloom.llm import decontaminate


def test_every_item_of_enough_similarity_is_found(spark):
    """All pairs that brute force finds, also far ones, and documents shorter than the item."""
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(900)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(20, 60)))) for k in range(60)]
    rows = []
    for share in (0.05, 0.1, 0.15, 0.18):
        for k, item in items:
            w = item.split()
            kept = w[: len(w) - int(share * len(w))]
            rows.append((len(rows), " ".join(kept + rng.choices(vocabulary, k=30))))
    cut = [(1000 + k, " ".join(item.split()[:-2])) for k, item in items if len(item.split()) > 30]
    docs = spark.createDataFrame(rows + cut, "doc_id bigint, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    want = brute_leaks(rows, items)
    for i, t in cut:
        n = len(items[i - 1000][1].split()) - 4
        want[i, i - 1000] = (n - 2) / n
    assert set(got) == set(want)
    assert all(abs(got[p] - want[p]) < 1e-4 for p in want)
