"""Files that arrive one after the other, as rows of a dataset."""

import pytest

from tidemill.api import Workspace
from tidemill.plans.store import Store
from tidemill.streaming.ingest import Follower


@pytest.fixture
def space(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "first.csv").write_text("a,b\n1,x\n2,y\n")
    space = Workspace(spark, str(tmp_path / "store"))
    return space, space.upload(str(tmp_path / "first.csv")).id


def rows(space, ds):
    return sorted(map(str, map(tuple, space.dataset(ds).df.collect())))


def test_types_widen_and_columns_come(spark, space, tmp_path):
    space, ds = space
    follow = lambda: space.follow(str(tmp_path / "in"), ds, str(tmp_path / "checkpoint"))
    (tmp_path / "in" / "1.csv").write_text('b,a\n"p\nq",3\n')
    (tmp_path / "in" / "2.csv").write_text("a;b;c\n4;z;0.5\n")
    assert follow().df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]
    assert rows(space, ds) == ["(1, 'x', None)", "(2, 'y', None)", "(3, 'p\\nq', None)", "(4, 'z', 0.5)"]
    (tmp_path / "in" / "3.csv").write_text("a,b\nten,w\n5,\n6,too,many\n")
    (tmp_path / "in" / "empty.csv").write_text("")
    assert follow().df.dtypes == [("a", "string"), ("b", "string"), ("c", "double")]
    assert rows(space, ds) == ["('1', 'x', None)", "('2', 'y', None)", "('3', 'p\\nq', None)", "('4', 'z', 0.5)", "('5', None, None)", "('ten', 'w', None)"]
    assert space.dataset(ds).meta["history"][-1]["action"] == "batch 1: 1 files, 1 records aside"
    aside = [p for p in (tmp_path / "store" / "datasets" / ds).iterdir() if p.name.startswith("aside-")]
    assert len(aside) == 1 and spark.read.parquet(str(aside[0])).first()["record"] == "6,too,many"
    # earlier versions stay as they were, and nothing new means no new version
    assert space.store.load(ds, 1).dtypes[0] == ("a", "bigint") and space.store.load(ds, 0).count() == 2
    version = space.dataset(ds).meta["current"]
    follow()
    assert space.dataset(ds).meta["current"] == version
    space.dataset(ds).clean("drop_columns", {"columns": ["c"]})
    assert space.dataset(ds).df.count() == 6 and space.store.load(ds, 2).count() == 6


def test_a_killed_commit_gives_each_file_once(spark, space, tmp_path, monkeypatch):
    space, ds = space
    (tmp_path / "in" / "1.csv").write_text("a,b\n3,z\n")
    held = Store._next_version
    monkeypatch.setattr(Store, "_next_version", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed before the commit")))
    with pytest.raises(Exception, match="killed"):
        space.follow(str(tmp_path / "in"), ds, str(tmp_path / "checkpoint"))
    assert space.dataset(ds).df.count() == 2

    def killed_after(self, *a, **k):
        held(self, *a, **k)
        raise RuntimeError("killed after the commit")

    monkeypatch.setattr(Store, "_next_version", killed_after)
    with pytest.raises(Exception, match="killed"):
        space.follow(str(tmp_path / "in"), ds, str(tmp_path / "checkpoint"))
    monkeypatch.setattr(Store, "_next_version", held)
    assert rows(space, ds) == ["(1, 'x')", "(2, 'y')", "(3, 'z')"]
    (tmp_path / "in" / "2.csv").write_text("a,b\n4,w\n")
    space.follow(str(tmp_path / "in"), ds, str(tmp_path / "checkpoint"))
    assert rows(space, ds) == ["(1, 'x')", "(2, 'y')", "(3, 'z')", "(4, 'w')"]
    assert [p.name for p in (tmp_path / "store" / "datasets" / ds).iterdir() if p.name.startswith("data-")].__len__() == 3


def test_few_files_at_a_time(spark, space, tmp_path):
    space, ds = space
    for k in range(5):
        (tmp_path / "in" / f"{k}.csv").write_text(f"a,b\n{k + 3},n\n")
    Follower(space.store, str(tmp_path / "in"), ds, 2).start(str(tmp_path / "checkpoint")).awaitTermination()
    assert space.dataset(ds).df.count() == 7 and space.dataset(ds).meta["current"] == 3
