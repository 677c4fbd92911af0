import hashlib
import json
import random

import pytest
from conftest import rows_of

from pairloom.sources import digests, files, ranges


def sha(data):
    return hashlib.sha256(data).hexdigest()


def tree(data, block, fan):
    level = [sha(data[i : i + block]) for i in range(0, max(len(data), 1), block)]
    while True:
        level = [sha("".join(level[i : i + fan]).encode()) for i in range(0, len(level), fan)]
        if len(level) == 1:
            return level[0]


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(2)
    sizes = {"empty": 0, "one": 1, "edge": 300, "over": 301, "many": 7_777, "deep/er/x y.bin": 2_500_000}
    made = {}
    for name, n in sizes.items():
        made[name] = b"\n".join(rng.randbytes(40) for _ in range(n // 41 + 1))[:n]
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(made[name])
    return tmp_path, made


def test_digests_by_block_and_whole(spark, folder):
    root, made = folder
    listed = ranges.list_files(spark, str(root))
    assert rows_of(listed.select("filename", "bytes")) == sorted(((n.split("/")[-1], len(x)) for n, x in made.items()), key=repr)
    by_name = {r["path"]: r["filename"] for r in listed.collect()}
    want = {n.split("/")[-1]: x for n, x in made.items()}
    for block, fan in ((100, 4), (1_000_000, 1024), (300, 2)):
        got = digests.tree_digests(listed, block, fan).collect()
        # Short files rise with the longest: a digest is taken again on each level.
        depth, width = 0, -(-max(map(len, made.values())) // block)
        while True:
            depth, width = depth + 1, -(-width // fan)
            if width <= 1:
                break
        for r in got:
            data = want[by_name[r["path"]]]
            level = [sha(data[i : i + block]) for i in range(0, max(len(data), 1), block)]
            for _ in range(depth):
                level = [sha("".join(level[i : i + fan]).encode()) for i in range(0, len(level), fan)]
            assert level == [r["tree_sha256"]]
        assert len(got) == len(made)
        assert len(digests.block_digests(listed, block).collect()) == sum(max(1, -(-len(x) // block)) for x in made.values())
    for r in digests.whole_digests(listed).collect():
        data = want[by_name[r["path"]]]
        assert r["sha256"] == sha(data) and r["lines"] == data.count(b"\n") + (data != b"" and not data.endswith(b"\n"))
    assert tree(want["over"], 300, 1024) == digests.tree_digests(listed.where("filename = 'over'"), 300).first()["tree_sha256"]


def test_every_status_and_reason(spark, folder, tmp_path_factory):
    root, made = folder
    told = tmp_path_factory.mktemp("told")
    good = {n: {"source_id": n, "registry_url": "u", "retrieved_at": "t", "license_status": "l", "observed": {"sha256": sha(x), "bytes": len(x)}} for n, x in made.items()}
    good["one"] |= {"source_id": "two", "registry_url": None, "retrieved_at": "", "observed": {}}
    del good["edge"]["license_status"]
    good["many"]["observed"]["sha256"] = "0"
    for n in ("empty", "one", "edge", "many", "over"):
        (told / f"{n}.manifest.json").write_text(json.dumps(good[n]) if n != "over" else "[1, 2]")
    (told / "gone.manifest.json").write_text("{")
    registry = spark.createDataFrame(
        [("empty", "empty", "u", 0, sha(b""), 0), ("one", "one", "u", 2, None, None), ("edge", "edge", "u", 300, sha(b"x"), 99),
         ("over", "over", "u", 301, None, None), ("many", "many", "u", 7_777, None, None), ("gone", "gone", "u", 1, None, None),
         ("x y.bin", "x y.bin", "u", 2_500_000, None, None)],
        "source_id string, location string, url string, expected_bytes long, expected_sha256 string, expected_lines long",
    )
    listed = ranges.list_files(spark, str(root)).withColumnRenamed("filename", "location")
    manifests = files.read_manifests(spark, str(told)).selectExpr("regexp_extract(file, '([^/]+)[.]manifest', 1) AS source_id", "manifest")
    got = {r["source_id"]: (r["status"], r["reasons"]) for r in files.audit_sources(registry, listed, manifests).collect()}
    assert got == {
        "empty": ("pass", ""), "gone": ("not_acquired", ""), "x y.bin": ("fail", "manifest_missing"), "over": ("fail", "manifest_invalid"),
        "one": ("fail", "byte_count_mismatch;manifest_source_id_mismatch;manifest_url_mismatch;manifest_sha256_mismatch;manifest_byte_count_mismatch;manifest_time_missing"),
        "edge": ("fail", "sha256_mismatch;line_count_mismatch;manifest_license_missing"), "many": ("fail", "manifest_sha256_mismatch"),
    }

