import hashlib
import math

from conftest import rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import arrays, keys, numbers, text


def one(frame, expr_of, value, kind="string"):
    return frame([(value,)], f"c {kind}").select(expr_of(F.col("c")).alias("r")).first()["r"]


def test_strip_handles_all_whitespace(frame):
    assert one(frame, text.strip, "\t x y  \n") == "x y"
    assert one(frame, text.blank_to_null, " \t ") is None
    every = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    assert set(every) == set(text.WHITESPACE)
    assert one(frame, text.strip, f"{every}x{every}y{every}") == f"x{every}y"


def test_strip_all_keeps_types(frame):
    df = text.strip_all(frame([(" a ", " ", 1)], "x string, y string, n int"), optional=["y"])
    assert rows_of(df) == [("a", None, 1)]


def test_terms_and_publications(frame):
    assert one(frame, text.terms, "MI:0018(x)|MI:0007|MI:0018") == ["MI:0007", "MI:0018"]
    assert one(frame, text.single_term, "a MI:0018 b MI:0018") == "MI:0018"
    assert one(frame, text.single_term, "MI:0018 MI:0019") == ""
    assert one(frame, text.terms, None) == []
    assert one(frame, text.publication_ids, "PubMed:9|pubmed:10|pubmed:9|doi:1") == "PMID:10;PMID:9"
    assert one(frame, text.publication_ids, "unassigned") == ""


def test_namespace_and_isoform(frame):
    split = lambda v: tuple(one(frame, text.split_namespace, v))
    assert split(" UniProtKB: P12345 |x:y") == ("uniprotkb", "P12345")
    assert split("P12345") == ("unknown", "P12345")
    assert split("a:b:c") == ("a", "b:c")
    assert split("") == ("unknown", "")
    part = lambda v: tuple(one(frame, text.isoform_parts, v))
    assert part("P12345-2") == ("P12345", True, "quarantine_isoform_specific")
    assert part("P12345") == ("P12345", False, "mapping_candidate")
    assert part("P12345-PRO_1") == ("P12345-PRO_1", False, "mapping_candidate")


def test_versions_groups_digest(frame):
    strip = lambda v: one(frame, lambda c: text.strip_version(c, r"ENSG\d{11}"), v)
    assert strip("ENSG00000000001.12") == "ENSG00000000001"
    assert strip("ENSG00000000001") == "ENSG00000000001"
    assert strip("ENSG1.2") is None
    found = one(frame, lambda c: text.group_ids(c, r"(?i)rcsb pdb:([0-9A-Za-z]{4})"), "RCSB PDB:1abc|rcsb pdb:1ABC|rcsb pdb:2xyz")
    assert found == ["1ABC", "2XYZ"]
    assert one(frame, text.is_digest, "A" * 64) and not one(frame, text.is_digest, "g" * 64)


def test_numbers(frame):
    parse = lambda v, **k: tuple(one(frame, lambda c: numbers.parse_number(c, **k), v))
    assert parse(" 1.5 ", lo=0) == (1.5, True)
    assert parse("-1", lo=0) == (None, False)
    for bad in ("1_0", "inf", "NaN", "1d", "", "1e999", "abc"):
        assert parse(bad) == (None, False), bad
    assert parse("", allow_blank=True) == (None, True)
    assert parse("7", kind="bigint") == (7, True)
    assert parse("7.0", kind="bigint") == (None, False)
    fraction = lambda v: tuple(one(frame, numbers.parse_fraction, v))
    assert fraction("55") == (0.55, True)
    assert fraction("0.4") == (0.4, True)
    assert fraction("101") == (None, False)
    assert fraction("-0.1") == (None, False)
    assert one(frame, numbers.parse_bool, " TRUE ") is True
    assert one(frame, numbers.parse_bool, "no") is None


def test_times(frame):
    ok = lambda v: one(frame, numbers.parse_zoned_ts, v) is not None
    assert ok("2026-09-15T01:02:03Z") and ok("2026-09-15T01:02:03+02:00")
    assert not ok("2026-09-15T01:02:03") and not ok("bad Z") and not ok("2026-13-15T01:02:03Z")
    assert str(one(frame, numbers.parse_date, "2026-02-28")) == "2026-02-28"
    assert one(frame, numbers.parse_date, "2026-02-30") is None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ids=st.lists(st.text(min_size=1, max_size=12), min_size=1, max_size=20, unique=True), seed=st.integers(0, 999))
def test_hashes_match_python(frame, ids, seed):
    df = frame([(i,) for i in ids], "id string")
    got = {r["id"]: (r["u"], r["k"], r["s"]) for r in df.select(
        "id",
        keys.unit_hash(seed, F.col("id")).alias("u"),
        keys.selection_key(seed, "cohort", F.col("id")).alias("k"),
        keys.stable_id("EVI", F.col("id"), F.lit(None).cast("string"), F.lit("z")).alias("s"),
    ).collect()}
    for i in ids:
        digest = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        assert got[i][0] == int.from_bytes(digest[:8], "big") / 2**64
        assert got[i][1] == hashlib.sha256(f"{seed}:cohort:{i}".encode()).hexdigest()
        assert got[i][2] == "EVI_" + hashlib.sha256("\x1f".join([i, "", "z"]).encode()).hexdigest()[:20]


def test_canonical_pair_is_symmetric(frame):
    df = frame([("b", "a"), ("a", "b")], "x string, y string")
    got = {tuple(r[0]) for r in df.select(keys.canonical_pair(F.col("x"), F.col("y"), "P")).collect()}
    assert got == {("P_a_b", "a", "b")}


def test_composition(frame):
    share = one(frame, arrays.composition, " aacX d ")
    assert math.isclose(sum(share), 1.0)
    by = dict(zip(arrays.STANDARD_ALPHABET, share))
    assert by["A"] == 0.5 and by["C"] == 0.25 and by["D"] == 0.25
    assert one(frame, arrays.composition, "123") is None


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(length=st.integers(1, 60), size=st.integers(1, 12), data=st.data())
def test_windows_match_definition(frame, length, size, data):
    stride = data.draw(st.integers(1, size))
    value = "".join(chr(97 + i % 26) for i in range(length))
    rows = arrays.explode_windows(frame([(value,)], "t string"), "t", size, stride).orderBy("window_index").collect()
    starts = [r["window_start"] for r in rows]
    assert all(s == k * stride for k, s in enumerate(starts))
    assert {i for s in starts for i in range(s, min(s + size, length))} == set(range(length))
    assert [s + size >= length for s in starts] == [r["is_last"] for r in rows]
    assert [r["is_last"] for r in rows].count(True) == 1
    assert all(r["window_text"] == value[r["window_start"] : r["window_start"] + size] for r in rows)


def test_json_map_checks(frame):
    check = lambda v: one(frame, arrays.json_map_checks, v).asDict()
    good = {"parsed": True, "enough_keys": True, "values_filled": True, "keys_distinct": True, "values_differ": True}
    assert check('{"A": "P1", "B": "P2"}') == good
    assert not check('{"A": "P1"}')["enough_keys"]
    assert not check('{"A": "P1", "B": " "}')["values_filled"]
    assert not check('{"A": "P1", "B": "REPLACE_ME"}')["values_filled"]
    assert not check('{"A": "P1", "B": "P1"}')["values_differ"]
    assert not any(check("not json").values())


def test_symmetric_features(frame):
    df = frame([([1.0, -2.0], [3.0, 4.0], 10, 20)], "a array<float>, b array<float>, la int, lb int")
    c = F.col
    row = df.select(
        arrays.symmetric_features(c("a"), c("b"), c("la"), c("lb")).alias("f"),
        arrays.symmetric_features(c("b"), c("a"), c("lb"), c("la")).alias("g"),
    ).first()
    la, lb = math.log1p(10), math.log1p(20)
    assert row["f"] == row["g"]
    assert row["f"][:6] == [2.0, 1.0, 2.0, 6.0, 3.0, -8.0]
    assert math.isclose(row["f"][6], (la + lb) / 2) and math.isclose(row["f"][7], abs(la - lb)) and row["f"][8] == 0.5
