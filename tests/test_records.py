import gzip
import random

import pytest
from conftest import rows_of

from pairloom.sources import tables
from pairloom.sources.ranges import list_files, ranges
from pairloom.sources.records import gzip_blocks, placed, scanned
from pairloom.sources.sinks import write_gzip_members

HEAD = "id,text,more\n"


def cell(rng):
    kind = rng.randrange(7)
    plain = "".join(rng.choices("abé, \n\"'x;", k=rng.randint(0, 12)))
    return [lambda: f"{rng.random():.5f}", lambda: "", lambda: '""', lambda: '"' + plain.replace('"', '""') + '"', lambda: '"a\nb"',
            lambda: '""""', lambda: "w" * rng.randint(1, 9)][kind]()


def text(seed, n=400):
    rng = random.Random(seed)
    return HEAD + "".join(f"{i},{cell(rng)},{cell(rng)}\n" for i in range(n))


def whole(spark, path):
    return tables.read_table(spark, str(path), ["id"], block_bytes=1 << 40)


def same(spark, path, block, irregular=False, monkeypatch=None):
    want = rows_of(whole(spark, path))
    got = tables.read_table(spark, str(path), ["id"], block_bytes=block)
    assert rows_of(got) == want
    return got


@pytest.mark.parametrize("seed,block", [(1, 37), (2, 100), (3, 1000), (4, 5)])
def test_quoted_line_breaks_at_any_block_edge(spark, tmp_path, seed, block):
    body = text(seed, 60 if block < 10 else 400)
    if seed == 2:
        body = "﻿" + body.rstrip("\n")  # a mark in front, no last line end
    (tmp_path / "t.csv").write_text(body, encoding="utf-8")
    got = same(spark, tmp_path / "t.csv", block)
    assert got.columns == ["id", "text", "more"] and got.rdd.getNumPartitions() > 1
    seen = placed(scanned(ranges(list_files(spark, str(tmp_path)), block).selectExpr("*", "false AS gzip")))
    assert not seen.where("irregular").count() and seen.where("inside").count() > 0


@pytest.mark.parametrize(
    "body",
    [
        HEAD + '1,5" pipe,x\n2,"a\nb",y\n' * 30,  # a quote inside an open cell
        HEAD + '1,"a"b,x\n2,c,"d\n' + "3,e,f\n" * 30,  # text behind a closing quote, and no end
        HEAD + "1,a\rb,c\n" * 40,  # a return that ends no line
        HEAD.replace("\n", "\r\n") + '1,"a\r\nb",c\r\n' * 40,
        HEAD + '1,"a\r\nb",c\n' * 40,
        HEAD + "\n\n1,a,b\n\n2,c\n3,d,e,f\n  \n" * 20,  # empty, short and long rows
        HEAD + '"1","' + "long " * 300 + '\n","x"\n2,b,c\n',  # a cell longer than many blocks
        HEAD,
    ],
)
def test_odd_files_read_as_by_the_whole_reader(spark, tmp_path, body):
    (tmp_path / "t.csv").write_bytes(body.encode())
    same(spark, tmp_path / "t.csv", 50)


def test_folders_of_large_small_and_packed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(text(5))
    (tmp_path / "b.csv").write_text(HEAD + "1,a,b\n")
    (tmp_path / "c.csv").write_text(HEAD + '1,5" pipe,b\n' * 200)
    members = [gzip.compress(text(6)[i : i + 700].encode()) for i in range(0, len(text(6)), 700)]
    (tmp_path / "d.csv.gz").write_bytes(b"".join(members))
    (tmp_path / "e.csv.gz").write_bytes(gzip.compress(text(7).encode()))
    inner = gzip.compress(text(8).encode(), 0)
    (tmp_path / "f.csv.gz").write_bytes(gzip.compress(HEAD.encode() + b'1,"' + inner.hex().encode() + b'",x\n'))
    same(spark, tmp_path, 800)
    gz = list_files(spark, str(tmp_path), "*.gz")
    found = gzip_blocks(gz, 800).collect()
    assert {r["path"].split("/")[-1] for r in found} == {"d.csv.gz"} and len(found) > 3
    ends = sorted((r["first"], r["last"]) for r in found)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[-1][1] == sum(map(len, members))


def test_a_stored_gzip_file_inside_is_not_cut(spark, tmp_path):
    inner = gzip.compress(b"x" * 5000)
    (tmp_path / "one.gz").write_bytes(gzip.compress(inner, 0))  # stored: the inner head is in plain sight
    (tmp_path / "two.gz").write_bytes(gzip.compress(inner, 0) + gzip.compress(b"y" * 4000))
    assert b"\x1f\x8b\x08" in (tmp_path / "one.gz").read_bytes()[1:]
    assert gzip_blocks(list_files(spark, str(tmp_path)), 100).count() == 0


def test_snapshot_of_several_members(spark, tmp_path):
    rows = [f"P{i}\treviewed\t9606\t3\tACD\n" for i in range(3000)]
    body = ["Entry\tReviewed\tOrganism (ID)\tLength\tSequence\n", *rows, "P7\treviewed\t1\t4\tACD\n"]
    (tmp_path / "s.tsv.gz").write_bytes(b"".join(gzip.compress("".join(body[i : i + 100]).encode()) for i in range(0, len(body), 100)))
    names = {"Entry": "entity_id", "Reviewed": "reviewed", "Organism (ID)": "taxid", "Length": "sequence_length", "Sequence": "sequence"}
    records, found = tables.read_snapshot(spark, str(tmp_path), names, "entity_id", tables.snapshot_rules(), 3001, block_bytes=2000)
    assert records.count() == 3001
    assert rows_of(found.select("key", "rule_id")) == [("P7", "duplicate_record"), ("P7", "sequence_length_mismatch"), ("P7", "wrong_taxon")]


def test_written_members_are_read_by_many_tasks(spark, tmp_path):
    rows = [(i, f"cell {i}\twith 'tab'\nand \"quotes\"" if i % 3 else None, "x" * (i % 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, text string, more string").repartition(2)
    made = write_gzip_members(df, f"file:{tmp_path}/out", member_bytes=4000).collect()
    assert sum(r["rows"] for r in made) == 2000 and all(r["members"] > 5 for r in made)
    got = tables.read_table(spark, f"file:{tmp_path}/out", ["id"], sep="\t", block_bytes=3000)
    want = [(str(i), t or "", m) for i, t, m in rows]
    assert rows_of(got) == sorted(want, key=repr)
    assert rows_of(tables.read_table(spark, f"file:{tmp_path}/out", ["id"], sep="\t")) == sorted(want, key=repr)
    assert len(gzip_blocks(list_files(spark, str(tmp_path / "out")), 3000).collect()) > 4
