import glob

import pytest
from conftest import rows_of

from pairloom.sources import release


@pytest.fixture
def tables(frame):
    a = frame([(2, "b"), (1, "a")], "id int, v string")
    return {"one": (a, ["id"]), "two": (a.limit(0), ["id"]), "three": (a.union(a), ["v"])}


class Died(Exception):
    pass


def test_published_by_one_rename(spark, tables, tmp_path):
    out, extra = f"file:{tmp_path}/r/v1", {"input": tables["one"][0]}
    listing = release.publish(spark, tables, out, extra)
    assert {r["table"]: r["rows"] for r in listing.collect()} == {"input": 2, "one": 2, "two": 0, "three": 4}
    _, stored = release.stored(spark, out)
    assert rows_of(stored["three"]) == rows_of(tables["three"][0]) and set(stored) == set(tables)
    with pytest.raises(FileExistsError):
        release.publish(spark, tables, out, extra)
    assert glob.glob(f"{tmp_path}/r/*") == [f"{tmp_path}/r/v1"]
    assert release.recover(spark, out, extra) == "published"
    # Two jobs that pass the first look: the rename itself refuses the second.
    with pytest.raises(Exception, match="exists|Exists"):
        release.commit(spark, f"{out}/one", out)


@pytest.mark.parametrize("at", [0, 1, 2, 3])
def test_a_job_that_dies_between_writes_publishes_nothing(spark, tables, tmp_path, monkeypatch, at):
    out, real, calls = f"{tmp_path}/v1", release.write_once, []

    def dies(*args):
        if len(calls) == at:
            raise Died
        calls.append(args)
        real(*args)

    monkeypatch.setattr(release, "write_once", dies)
    with pytest.raises(Died):
        release.publish(spark, tables, out)
    assert not release.exists(spark, out) and len(glob.glob(f"{out}.staging-*")) == (at > 0)
    assert release.recover(spark, out) == ("discarded" if at else "nothing")
    assert glob.glob(f"{tmp_path}/*") == []
    monkeypatch.undo()
    assert release.publish(spark, tables, out).count() == 3


def test_a_job_that_dies_before_the_rename_is_completed(spark, tables, tmp_path, monkeypatch):
    out = f"{tmp_path}/v1"

    def dies(*_):
        raise Died

    monkeypatch.setattr(release, "commit", dies)
    with pytest.raises(Died):
        release.publish(spark, tables, out)
    monkeypatch.undo()
    assert not release.exists(spark, out)
    assert release.recover(spark, out) == "recovered"
    assert rows_of(release.stored(spark, out)[1]["one"]) == rows_of(tables["one"][0])
    assert release.recover(spark, out) == "published" and glob.glob(f"{tmp_path}/*") == [out]


def test_a_staged_table_that_lost_rows_is_not_published(spark, tables, tmp_path, monkeypatch):
    out, real = f"{tmp_path}/v1", release.write_once
    monkeypatch.setattr(release, "write_once", lambda df, path, order: real(df.limit(1) if path.endswith("three") else df, path, order))
    with pytest.raises(OSError, match="three row_count_changed"):
        release.publish(spark, tables, out)
    monkeypatch.undo()
    assert not release.exists(spark, out) and release.recover(spark, out) == "discarded"
