"""Piecewise fingerprints and their likeness against plain programs; the edited copies of whole tables."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from tidemill.llm import fingerprints, queries


def plain_fingerprint(text):
    """One byte after the other."""
    data, mask = (text or "").encode(), 0xFFFFFFFF
    zeros = []
    for i in range(len(data)):
        h = 0
        for c in [0] * (6 - i) + list(data[max(0, i - 6) : i + 1]):
            h = (h * 0x01000193 + c) & mask
        h = h * 0x9E3779B1 & mask
        zeros.append(32 - ((h ^ h >> 15) * 0x9E3779B1 & mask).bit_length())

    def symbols(level):
        out, start = [], 0
        for i in range(len(data)):
            size = i + 1 - start
            if (zeros[i] >= level and size >= max(1, 2**level // 2)) or size == 4 * 2**level or i + 1 == len(data):
                out.append(xxhash.xxh3_64_intdigest(data[start : i + 1]) % 4096)
                start = i + 1
        return out

    level = max(0, (len(data) // 64).bit_length() - 2)
    while max(len(symbols(level)), len(symbols(level + 1))) > 64:
        level += 1
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return ":".join([str(2**level), *("".join(letters[x // 64] + letters[x % 64] for x in symbols(k)) for k in (level, level + 1))])


def plain_likeness(a, b):
    def parts(said):
        size, fine, coarse = said.split(":")
        return {int(size): [fine[i : i + 2] for i in range(0, len(fine), 2)], 2 * int(size): [coarse[i : i + 2] for i in range(0, len(coarse), 2)]}

    best = 0.0
    for size, x in parts(a).items():
        if (y := parts(b).get(size)) is not None:
            row = list(range(len(y) + 1))
            for i, u in enumerate(x, 1):
                last, row[0] = row[0], i
                for j, v in enumerate(y, 1):
                    last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
            best = max(best, 1 - row[-1] / max(len(x), len(y), 1))
    return best


def documents():
    rng = np.random.default_rng(12)
    words = "the of Straße naïve 漢字 🙂 and to in is that for it was on are with as his they".split()
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 400))))) for i in range(90)]
    rows += [(100, None), (101, ""), (102, "a"), (103, "abc"), (104, "z" * 900), (105, "so it is " * 300), (106, "x" * 63), (107, "0123456789" * 7), (108, "0123456789" * 7)]
    rows += [(200, "".join(chr(97 + c) for c in rng.integers(0, 26, 30000))), (None, "no id"), (None, "no id either"), (150, "twice"), (150, "twice")]
    return rows


@pytest.mark.parametrize("piece", [50, 1 << 20])
def test_fingerprints(spark, monkeypatch, piece):
    texts = [t for _, t in documents() if len(t or "") < 5000]
    monkeypatch.setattr(fingerprints, "PIECE", piece)
    assert [str(fingerprints.fingerprint(t)) for t in texts] == [plain_fingerprint(t) for t in texts]
    for t in texts:
        assert str(fingerprints.parse(str(fingerprints.fingerprint(t)))) == str(fingerprints.fingerprint(t))


def test_edit_distances():
    rng = np.random.default_rng(3)
    xs, ys = ([rng.integers(0, 5, int(n)).astype(np.uint16) for n in rng.choice([0, 1, 2, 31, 63, 64], 200)] for _ in range(2))
    for x, y, d in zip(xs, ys, fingerprints.edit_distances(xs, ys)):
        row = np.arange(len(y) + 1)
        for i, u in enumerate(x, 1):
            new = [i]
            for j, v in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (u != v)))
            row = new
        assert row[-1] == d


def test_query_against_plain_programs(spark, tmp_path):
    rows = documents()
    rng = np.random.default_rng(4)
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    ids, texts = zip(*shuffled)
    extra = {"part": pa.array(["clash"] * len(rows)), "kind": pa.array([1] * len(rows)), "place": pa.array([2] * len(rows))}
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), **extra}), tmp_path / "documents.parquet", row_group_size=20)
    got = queries.op12_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    # rows without an id come first, in some order of their own; so the first row after the last is one of them
    seen = {}
    for nulls in ([rows[-4], rows[-3]], [rows[-3], rows[-4]]):
        line = nulls + sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
        want = []
        for (i, t), (_, f) in zip(line, line[1:] + line[:1]):
            t, f = t or "", f or ""
            edited = t[: len(t) - len(t) // 4] + f[: len(t) // 4]
            a, b, c = map(plain_fingerprint, (t, edited, f))
            want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 12), round(plain_likeness(a, c), 12)))
        seen[tuple(sorted(want))] = nulls
    assert tuple(sorted((str(r[0]), *r[1:5], round(r[5], 12), round(r[6], 12)) for r in got)) in seen
    near = [r for r in got if (r["n_chars"] or 0) > 500 and r["doc_id"] not in (104, 105)]
    assert np.mean([r["near_edited"] for r in near]) > 0.6 and np.mean([r["near_next"] for r in near]) < 0.1


@pytest.mark.parametrize("rows", [[], [(1, "only one document, and it follows itself")], [(1, None), (2, None)]])
def test_few_rows(spark, tmp_path, rows):
    ids, texts = zip(*rows) if rows else ((), ())
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    got = sorted(queries.op12_fingerprints(spark, str(tmp_path)).collect())
    assert [r["doc_id"] for r in got] == list(ids)
    for r, t in zip(got, texts):
        t = t or ""
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 4] + t[: len(t) // 4]).encode()).hexdigest()
        assert r["near_next"] == 1


def test_likeness_of_columns(spark):
    a, b = str(fingerprints.fingerprint("one two three " * 30)), str(fingerprints.fingerprint("one two three " * 29 + "four"))
    pairs = spark.createDataFrame([(1, a, a), (2, a, b), (3, a, None)], "n long, x string, y string")
    got = {r["n"]: r["likeness"] for r in fingerprints.with_likeness(pairs, "x", "y").collect()}
    assert got[1] == 1 and got[2] == plain_likeness(a, b) and got[3] == 0
    docs = spark.createDataFrame([(1, "one two three " * 30), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint_documents(docs).collect()} == {1: a, 2: "1::"}
