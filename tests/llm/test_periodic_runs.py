"""Periodic runs against a search of every period."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemill.llm import periodic_runs, queries


def plain(words, min_length=6, min_periods=4):
    """Each period in turn: stretches that equal themselves one period later; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= max(min_length, min_periods * q)), key=lambda r: (r[0], r[2]))


def figures(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sums = ["".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone)]
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, *(hashlib.sha256(x.encode()).hexdigest() for x in sums))


def documents():
    rng, rows = np.random.default_rng(11), []
    for i in range(300):
        words = rng.choice([f"w{k}" for k in range(int(rng.choice([1, 2, 3, 20, 400])))], int(rng.integers(0, 120)))
        rows.append((i, "".join(f"{w}{rng.choice([' ', '  ', chr(10), chr(9)])}" for w in words)))
    for i in range(300, 340):  # a run within prose, and two that touch
        p, q = rng.integers(1, 9, 2)
        rows.append((i, " ".join([f"x{k}" for k in range(30)] + [f"p{k}" for k in range(p)] * 5 + [f"q{k}" for k in range(q)] * 6 + ["end"])))
    rows += [(400, None), (401, ""), (402, " \n"), (403, "ha " * 6), (404, "ha " * 5), (405, "a b " * 7), (406, "é🙂 漢 " * 9), (407, "z " * 20000)]
    rows += [(408, " ".join(f"v{k % 700}" for k in range(4000))), (None, "so so so so so so"), (None, "no"), (7, "again " * 8), (7, "again " * 8)]
    return rows


def test_query_against_every_period(spark, tmp_path):
    rows = documents()
    ids, texts = zip(*rows)
    extra = {"id": pa.array(["clash"] * len(rows)), "runs": pa.array([1] * len(rows))}
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), **extra}), tmp_path / "documents.parquet", row_group_size=50)
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    # periods of the long texts are known, and to try all would take long
    long = {i: t for i, t in rows if i in (407, 408)}
    assert sorted(map(str, (r for r in got if r[0] not in long))) == sorted(str(figures(i, t)) for i, t in rows if i not in long)
    for r in got:
        if r[0] in long and zlib.crc32(str(r[0]).encode()) % 10:
            assert r[1:6] == ((1, 0, 20000, 1, 20_000_000) if r[0] == 407 else (1, 0, 4000, 700, 5714))


def test_empty_table(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), tmp_path / "documents.parquet")
    assert queries.op11_periodic_runs(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("block", [2, 5, 512])
def test_automaton_finds_squares_too(monkeypatch, block):
    monkeypatch.setattr(periodic_runs, "BLOCK", block)
    rng = np.random.default_rng(block)
    for _ in range(300):
        word = rng.integers(0, rng.integers(1, 4), rng.integers(0, 60)).tolist()
        for least in ((2, 2), (6, 4), (9, 3)):
            assert sorted(periodic_runs.runs_in(word, *least)) == sorted(plain(word, *least))


def test_ordered_sets_know_their_neighbours(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 6)
    order = np.random.default_rng(1).permutation(500).tolist()
    ends, seen = periodic_runs.Ends(order[0]), [order[0]]
    for x in order[1:]:
        assert ends.add(x) == (max((y for y in seen if y < x), default=-1), min((y for y in seen if y > x), default=-1))
        seen.append(x)
    assert list(ends) == sorted(seen) and ends.size == 500


def test_runs_and_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "so " + "la di " * 5 + "end"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(1, 10, 2)] and got[1]["collapsed"] == "so la di end"
    assert got[2]["runs"] == [] and got[2]["collapsed"] == ""
