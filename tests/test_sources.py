import gzip
import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from pairloom.runtime import stage, work_dir
from pairloom.sources.files import audit_files, file_sizes, line_counts, validate_registry
from pairloom.sources.manifest import fingerprint, manifest, verify_manifest
from pairloom.sources.ontology import read_ontology
from pairloom.sources.sinks import write_once
from pairloom.sources.tables import (
    read_documents,
    read_variants,
    read_headerless,
    read_snapshot,
    read_table,
    scalar_or_list,
    variant_number,
    variant_texts,
    snapshot_rules,
)


def test_table_contract(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('﻿pair_id,label,note\nA,1,"x, ""y"""\nB,,\n', encoding="utf-8")
    df = read_table(spark, str(path), ["pair_id", "label"])
    assert df.columns == ["pair_id", "label", "note"] and dict(df.dtypes)["label"] == "string"
    assert rows_of(df) == [("A", "1", 'x, "y"'), ("B", "", "")]
    with pytest.raises(ValueError, match="missing columns: score"):
        read_table(spark, str(path), ["pair_id", "score"])


def test_headerless(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("E1\tE2\nE1\nE1\tx\n E3\tE4 \n\na\tb\tc\n")
    good, bad = read_headerless(spark, str(path), ["a", "b"], {"a": r"E\d", "b": r"E\d"})
    assert rows_of(good) == [("E1", "E2"), ("E3", "E4")]
    assert rows_of(bad) == [("E1", "wrong_column_count"), ("E1\tx", "pattern_mismatch"), ("a\tb\tc", "wrong_column_count")]


def test_snapshot_rules(spark, tmp_path):
    path = tmp_path / "s.tsv.gz"
    with gzip.open(path, "wt") as handle:
        handle.write("Entry\tReviewed\tOrganism (ID)\tLength\tSequence\n")
        handle.write("A\treviewed\t9606\t2\tMA\nA\treviewed\t9606\t2\tMA\nB\tunreviewed\t1\t9\tM\n")
    names = {"Entry": "entity_id", "Reviewed": "reviewed", "Organism (ID)": "taxid", "Length": "sequence_length", "Sequence": "sequence"}
    records, found = read_snapshot(spark, str(path), names, "entity_id", snapshot_rules(), expected_rows=4)
    assert records.count() == 3
    assert {(r["key"], r["rule_id"]) for r in found.collect()} == {
        ("A", "duplicate_record"), ("B", "not_reviewed"), ("B", "wrong_taxon"), ("B", "sequence_length_mismatch"), ("", "row_count_mismatch")
    }


def test_documents(spark, tmp_path):
    docs = {"a": {"id": "a", "info": {"n": 2}, "refs": [{"db": "u", "v": "1"}, {"db": "u", "v": "1"}]}, "b": {"id": "b"}}
    for name, body in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    df = read_documents(spark, str(tmp_path), "id string, info struct<n: int>, refs array<struct<db: string, v: string>>")
    got = df.select("id", F.col("info.n").alias("n"), F.size(F.array_distinct(F.coalesce("refs", F.array().cast("array<struct<db:string,v:string>>")))).alias("k"))
    assert rows_of(got) == [("a", 2, 1), ("b", None, 0)]
    cells = spark.createDataFrame([("[9606, 9606]",), ("10090",), ("",), (None,)], "c string")
    assert [r[0] for r in cells.select(scalar_or_list(F.col("c"), "int")).collect()] == [[9606], [10090], [], []]


def test_ontology(spark, tmp_path):
    path = tmp_path / "o.obo"
    path.write_text(
        "format-version: 1.2\n\n[Term]\nid: MI:1\nname: root\n\n[Term]\nid: MI:2\nname: child\nis_a: MI:1 ! root\nis_a: MI:9 ! other\n"
        "\n[Term]\nid: MI:3\nname: gone\nis_obsolete: true\nreplaced_by: MI:2\n\n[Typedef]\nid: part_of\nis_a: MI:1\n"
    )
    terms, edges = read_ontology(spark, str(path))
    assert rows_of(terms) == [("MI:1", "root", False, ""), ("MI:2", "child", False, ""), ("MI:3", "gone", True, "MI:2")]
    assert rows_of(edges) == [("MI:2", "MI:1"), ("MI:2", "MI:9")]


def test_file_audit(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\n2\n")
    (tmp_path / "b.txt").write_text("x\n")
    registry = spark.createDataFrame(
        [("a", "a.txt", 4, 2), ("b", "b.txt", 9, 5), ("c", "c.txt", 1, None)],
        "source_id string, filename string, expected_bytes bigint, expected_lines bigint",
    )
    got = rows_of(audit_files(file_sizes(spark, str(tmp_path)), registry, line_counts(spark, str(tmp_path))))
    assert got == [
        ("a", "a.txt", "pass", ""), ("b", "b.txt", "fail", "byte_count_mismatch;line_count_mismatch"), ("c", "c.txt", "not_acquired", "")
    ]


def test_registry_contract(spark):
    cols = "source_id string, filename string, url string, expected_bytes bigint, expected_sha256 string, expected_lines bigint, download_class string, license_status string, citation string"
    good = ("s", "f.txt", "https://example.org", 5, "a" * 64, None, "core", "open", "c")
    bad = ("t", "../f", "ftp://x", 0, "zz", 0, "odd", " ", "")
    found = validate_registry(spark.createDataFrame([good, bad, bad], cols))
    assert {r["rule_id"] for r in found.where("key = 't'").collect()} == {
        "filename_not_plain", "url_not_allowed", "expected_bytes_not_positive", "expected_sha256_invalid",
        "expected_lines_not_positive", "unknown_download_class", "missing_licence", "missing_citation", "duplicate_source",
    }
    assert found.where("key = 's'").count() == 0


def test_fingerprint_and_drift(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "n int, s string")
    assert fingerprint(a).first() == fingerprint(a.repartition(3).select("s", "n")).first()
    assert fingerprint(a).first() != fingerprint(a.distinct()).first()
    listed = manifest({"a": a, "b": a})
    assert verify_manifest(listed, {"a": a, "b": a}).count() == 0
    changed = a.withColumn("s", F.lit("q"))
    assert rows_of(verify_manifest(listed, {"a": changed, "c": a})) == [("a", "content_changed"), ("b", "missing"), ("c", "unlisted")]
    assert rows_of(verify_manifest(listed, {"a": a.limit(1), "b": a})) == [("a", "row_count_changed")]


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "n int, s string")
    write_once(df, str(tmp_path / "t"), ["n"], ["s", "n"], fmt="csv")
    assert read_table(spark, str(tmp_path / "t"), ["s", "n"]).columns == ["s", "n"]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_once(df, str(tmp_path / "t"), ["n"], fmt="csv")


def test_staging_uses_the_session_folder(spark):
    staged = stage(spark.range(5), "unit")
    assert staged.count() == 5 and work_dir(spark) in staged.inputFiles()[0]


def test_variant_documents_of_any_shape(spark, tmp_path):
    bodies = {
        "a": '{"ids": [" x", "b", "x", "", null, 3], "len": ["12.5", 1], "org": [{"t": 9606}, {"u": 1}, {"t": "10090"}]}',
        "b": '{"ids": "one", "len": 7, "org": {"t": 1}}',
        "c": '{"len": "NaN", "ids": null}',
        "d": '{"len": true, "ids": []}\n',
        "e": "[1, 2]", "f": "{broken", "g": "  \n", "h": "3",
    }
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    docs = read_variants(spark, str(tmp_path))
    doc = F.col("document")
    got = docs.select(
        F.substring(F.col("file"), -1, 1), "reason", variant_texts(doc, "$.ids"), variant_number(doc, "$.len"), variant_texts(doc, "$.org", "$.t")
    ).collect()
    assert sorted(tuple(r) for r in got if r[1] is None) == [
        ("a", None, ["3", "b", "x"], 12.5, ["10090", "9606"]), ("b", None, ["one"], 7.0, ["1"]), ("c", None, [], None, []), ("d", None, [], None, [])
    ]
    assert sorted(tuple(r[:2]) for r in got if r[1]) == [("e", "not_an_object"), ("f", "invalid_json"), ("h", "not_an_object")]
