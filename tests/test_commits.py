"""Commits of a store: between processes, between threads, and what stays after failures."""

import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from tidemill.errors import InputError
from tidemill.plans.store import Store

SAVES = """
import sys
from tidemill.plans.store import Store
from tidemill.session import session
spark = session(master="local[1]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1"})
store, ds, who = Store(spark, sys.argv[1]), sys.argv[2], int(sys.argv[3])
for k in range(20):
    store.save(ds, spark.range(who * 100 + k, who * 100 + k + 1), f"{who}:{k}")
    store.create_project(f"p{who}-{k}")
"""


def test_two_processes_lose_no_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    ds = store.create(spark.range(1), "shared")["id"]
    env = os.environ | {"PYTHONPATH": str(Path(__file__).parents[1])}
    both = [subprocess.Popen([sys.executable, "-c", SAVES, str(tmp_path), ds, str(k)], env=env, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE) for k in (1, 2)]
    for p in both:
        assert p.wait(300) == 0, p.stderr.read()[-2000:]
    m = store.meta(ds)
    actions = [h["action"] for h in m["history"]]
    assert sorted(actions[1:]) == sorted(f"{who}:{k}" for who in (1, 2) for k in range(20))
    assert [h["version"] for h in m["history"]] == list(range(41)) and m["next"] == 41 and len(m["versions"]) == 20
    for v, action in [(h["version"], h["action"]) for h in m["history"][1:] if h["version"] in m["versions"]]:
        who, k = map(int, action.split(":"))
        assert [r["id"] for r in store.load(ds, v).collect()] == [who * 100 + k]
    assert sorted(p["name"] for p in store.projects()) == sorted(f"p{who}-{k}" for who in (1, 2) for k in range(20))
    # data of pruned versions are gone, and no half-made file is left
    left = {p.name for p in (tmp_path / "datasets" / ds).iterdir()} - {"log"}
    assert left == {name for parts in m["paths"].values() for name, _ in parts} and not [p for p in (tmp_path / "datasets" / ds / "log").iterdir() if "tmp" in p.name]


def test_threads_lose_no_change(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    made = [store.create(spark.range(1), f"d{k}")["id"] for k in range(3)]
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda k: store.save_dashboard(made[k % 3], [{"kind": "describe", "params": {}}]), range(24)))
        list(pool.map(lambda k: store.rename(made[0], f"name {k}"), range(24)))
    assert all(store.dashboard(ds) for ds in made) and len(list((tmp_path / "dashboards").glob("*.json"))) == 24
    store.delete(made[1])
    with pytest.raises(InputError):
        store.dashboard(made[1])


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    ds = store.create(spark.range(3), "d")["id"]
    before = sorted(p.name for p in (tmp_path / "datasets" / ds).iterdir())
    with pytest.raises(Exception, match="wrong"):
        store.save(ds, spark.range(3).selectExpr("assert_true(id < 1, 'wrong') as x"), "fails")
    assert sorted(p.name for p in (tmp_path / "datasets" / ds).iterdir()) == before and store.meta(ds)["current"] == 0


def test_a_file_is_made_once(spark, tmp_path):
    files = Store(spark, str(tmp_path)).files
    path = f"{tmp_path}/once.json"
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: files.create(path, str(k).encode()), range(16)))
    assert sum(made) == 1 and files.read(path) == str(made.index(True)).encode()
