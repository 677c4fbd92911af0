"""Registered queries against their SQL on tables that once told them apart."""

from pathlib import Path

import pytest
from test_queries import SF, rows_of

from pairloom.plans.registered import ORACLES, QUERIES
from pairloom.runtime import PIECE_SIZE, SHUFFLE_PIECES, fine_shuffles, tune, work_dir

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")


def check(spark, folder, name, **tables):
    """The query's rows over ``tables`` (name to select), which are those of its SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    cur = con.execute(ORACLES[name])
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
    return got


LINES = f"select * from '{SF}/lineitem.parquet'"


def test_no_seed_is_feasible_without_negatives(spark, tmp_path):
    assert check(spark, tmp_path, "p5_searched_split", lineitem=f"select * replace ('A' as l_returnflag) from ({LINES})") == []


def test_rows_without_pair_id_keep_their_own_findings(spark, tmp_path):
    docs = "select k as doc_id, 20000 as n_chars, concat('src', k % 6) as source from range(40) t(k)"
    rows = check(spark, tmp_path, "m14_validate_predictions", documents=docs, labels="select k as doc_id, 1 as quality, 0 as toxic from range(40) t(k)")
    assert [40, "score_not_finite"] in rows


def test_pairs_unknown_and_not_eligible_count_for_both(spark, tmp_path):
    often = f"select * replace ('A' as l_returnflag) from ({LINES}) where l_partkey % 997 between 100 and 110"
    far = f"select * replace (993 as l_partkey, l_orderkey + 1000000 as l_orderkey) from ({often})"
    check(spark, tmp_path, "p10_expected_pairs", lineitem=f"{LINES} union all select l.* from ({far}) l, range(5)")


def test_reasons_that_no_row_has_are_counted_as_zero(spark, tmp_path):
    parts = "select k as p_partkey, 1 as p_size from range(997) t(k)"
    rows = check(spark, tmp_path, "v7_build_benchmark", lineitem=LINES, part=parts)
    assert ["quarantine_unresolved_endpoint", 0] in rows


def test_payloads_that_share_an_evidence_id_all_count(spark, tmp_path):
    parts = "select k as p_partkey, 1 as p_size from range(997) t(k)"
    two = f"""
      select l.* replace (9000000 as l_orderkey, 4 as l_linenumber, q as l_quantity, 'A' as l_returnflag)
      from (select * from ({LINES}) where l_suppkey * 31 % 997 <> l_partkey % 997 limit 1) l, (values (10.0), (48.0)) v(q)"""
    check(spark, tmp_path, "v7_build_benchmark", lineitem=f"{LINES} union all {two}", part=parts)


def test_release_of_pairs_that_contradict_when_folded(spark, tmp_path):
    lines = f"""
      select l.* replace (l_partkey + 997 * k as l_partkey, l_suppkey + 997 * k as l_suppkey, l_orderkey + 1000000 * k as l_orderkey,
                        case when k = 1 and l_partkey % 3 = 0 then 'R' else 'A' end as l_returnflag, 3.0 as l_quantity)
      from ({LINES}) l, range(2) r(k)"""
    tables = {"lineitem": lines, "part": "select k as p_partkey, 1 as p_size from range(2000) t(k)"}
    for t, sql in tables.items():
        duckdb.sql(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
    listed = {r["table"]: r["rows"] for r in QUERIES["v7_freeze"](spark, str(tmp_path)).collect()}
    assert {"splits", "cohorts"} <= set(listed) and listed["cohorts"] > 0


def test_a_feed_is_written_by_a_task_a_split(spark, tmp_path):
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(5):
        duckdb.sql(f"copy (select * from ({LINES}) where l_orderkey % 5 = {k}) to '{tmp_path}/lineitem.parquet/{k}.parquet' (format parquet)")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    try:
        before = set(Path(work_dir(spark)).glob("pairloom/*/feed-*"))
        assert QUERIES["c2_streamed_decisions"](spark, str(tmp_path)).count() > 0
        (feed,) = set(Path(work_dir(spark)).glob("pairloom/*/feed-*")) - before
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list(feed.glob("*.parquet"))) > 6


def test_shuffles_of_table_queries_are_cut_finely(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert int(fine_shuffles(spark).conf.get(name)) >= SHUFFLE_PIECES
    assert tune(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") != PIECE_SIZE


def test_files_are_read_in_fine_pieces(spark):
    name = "spark.sql.files.maxPartitionBytes"
    given = tune(spark).conf.get(name)
    assert fine_shuffles(spark).conf.get(name) == PIECE_SIZE != given
    assert tune(spark).conf.get(name) == given


def test_a_stream_has_few_batches_and_its_state_on_disk(spark, tmp_path):
    """Every batch costs a task for each piece of the state; the default store copies all of it."""
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(9):
        duckdb.sql(f"copy (select * from ({LINES}) where l_orderkey % 9 = {k}) to '{tmp_path}/lineitem.parquet/{k}.parquet' (format parquet)")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    names = ("streamed", "offsets")
    try:
        before = {n: set(Path(work_dir(spark)).glob(f"pairloom/*/{n}-*")) for n in names}
        assert QUERIES["c2_streamed_decisions"](spark, str(tmp_path)).count() > 0
        streamed, offsets = ((set(Path(work_dir(spark)).glob(f"pairloom/*/{n}-*")) - before[n]).pop() for n in names)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list(streamed.glob("batch_id=*"))) == 2
    assert list(offsets.glob("state/0/*/*.changelog"))
