"""Literal cases that once gave wrong answers or stopped a query."""

from pyspark.sql import functions as F

from pairloom.operators.ranking import metrics_from_groups, score_groups, validate_predictions
from pairloom.operators.validate import validate_pairs
from pairloom.sources.manifest import fingerprint
from pairloom.sources.ontology import read_ontology
from pairloom.sources.tables import read_table


def test_counts_beyond_bigint_products(frame):
    n = 4_000_000_000
    counts = frame([(0.9, n, n), (0.1, n, 0)], "score double, n bigint, positives bigint")
    row = metrics_from_groups(score_groups(counts, []), []).first()
    assert row["auroc"] == 1.0 and row["average_precision"] == 1.0


def test_quoted_line_break_is_one_cell(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    rows = read_table(spark, str(tmp_path / "t.csv"), ["a", "b"]).collect()
    assert [tuple(r) for r in rows] == [("1", "x\ny"), ("2", "z")]


def test_stanzas_by_header_line(spark, tmp_path):
    for name, text in {
        "crlf": "format: 1\r\n\r\n[Term]\r\nid: T:1\r\nname: a\r\n\r\n[Term]\r\nid: T:2\r\nname: b\r\nis_a: T:1 ! a\r\n",
        "tight": "format: 1\n[Term]\nid: T:1\nname: a\n[Term]\nid: T:2\nname: b\nis_a: T:1\n",
        "space": "[Term]\nid: T:1\nname: a\n \n[Term]\nid: T:2\nname: b\nis_a: T:1\n",
    }.items():
        (tmp_path / name).write_bytes(text.encode())
        terms, edges = read_ontology(spark, str(tmp_path / name))
        assert sorted((r.term, r.name) for r in terms.select("term", F.col("name")).collect()) == [("T:1", "a"), ("T:2", "b")]
        assert [tuple(r) for r in edges.collect()] == [("T:2", "T:1")]


def test_fingerprint_tells_null_blank_shift_and_names(frame):
    prints = [
        fingerprint(frame(rows, schema)).first()["fingerprint"]
        for rows, schema in [
            ([("a", None)], "x string, y string"),
            ([("a", "")], "x string, y string"),
            ([(None, "a")], "x string, y string"),
            ([("a", None)], "x string, z string"),
            ([("a", "-")], "x string, y string"),
        ]
    ]
    assert len(set(prints)) == 5


def test_null_pair_id_is_reported(frame):
    pairs = frame(
        [(None, "A", "B", 1, "direct_positive", "eligible"), ("P_A_B", "A", "B", 1, "direct_positive", "eligible")],
        "pair_id string, node_a string, node_b string, label int, evidence_class string, pair_status string",
    )
    found = validate_pairs(pairs, frame([("A",), ("B",)], "entity_id string"), "P")
    assert {r["rule_id"] for r in found.collect()} == {"missing_pair_id", "unexpected_pair_id"}


def test_tab_padded_partition_is_kept(frame):
    rows = [("p1", "1", "0.5", "test\t", "c", " ")]
    typed, found = validate_predictions(
        frame(rows, "pair_id string, label string, score string, partition string, evidence_class string, bootstrap_group string"), "test"
    )
    assert typed.first()["bootstrap_group"] == "p1" and found.count() == 0
