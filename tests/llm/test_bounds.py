"""Bounds of memory and of samples, extreme values, and the digests of suffix-array dedup."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import chat, common, embedding_dedup, quality, queries, suffix_dedup


def test_a_long_conversation_takes_few_copies_of_itself():
    text = "words é " * 4_000_000
    size = len(text.encode())
    tracemalloc.start()
    column, spans = chat.assemble(np.array([0, 0, 1]), ["user", "assistant", "assistant"], ["x", text, "y"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * size
    said = column[0].as_py()
    assert said[spans[0][0]["start"] : spans[0][0]["end"]] == text and column[1].as_py()[spans[1][0]["start"] : spans[1][0]["end"]] == "y"


def test_parts_and_counts_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    turns = [("assistant" if rng.random() < 0.5 else "user", "".join(rng.choice(list("aé🙂\\</s>"), int(rng.integers(0, 40))))) for _ in range(200)]
    conv = np.sort(rng.integers(0, 30, 200))
    conv = np.unique(conv, return_inverse=True)[1]
    whole = chat.assemble(conv, *map(list, zip(*turns)))
    monkeypatch.setattr(chat, "LONG", 20)
    monkeypatch.setattr(chat, "AT_ONCE", 50)
    pieces = chat.assemble(conv, *map(list, zip(*turns)))
    assert whole[0].equals(pieces[0]) and whole[1] == pieces[1]


def test_a_labelled_id_with_many_rows(spark):
    docs = spark.range(20000).selectExpr("0 as doc_id", "concat('text ', id % 50) as text").unionByName(spark.range(1, 40).selectExpr("id as doc_id", "repeat('good words ', int(id)) as text"))
    labels = spark.range(40).selectExpr("id as doc_id", "int(id % 2) as quality")
    kept = []
    held = quality.train
    quality.train = lambda x, counts, y, **more: kept.append(len(counts)) or held(x, counts, y, rounds=1)
    try:
        quality.learn(docs, labels, docs_bound=60)
    finally:
        quality.train = held
    assert 20 < kept[0] <= 60


def test_vectors_of_extreme_lengths_have_directions(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1.0, 0.0]), (2, [1e200, 1e199]), (3, [0.0, 5e-324]), (4, [1e-310, 2e-310])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (0, 4)}


def test_suffix_dedup_digests(spark, tmp_path):
    """The registered query on a small table: every byte of a 100-byte string that also starts earlier goes."""
    rng = np.random.default_rng(5)
    line = "".join(chr(97 + c) for c in rng.integers(0, 26, 150))
    other = "é" * 70
    texts = [line + " one", "two " + line, "x" * 250, None, "", "z" + other + "y", other + other, line[:99], "w" + line[20:130] + line[:110], line + " one"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    seen, want = set(), []
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(data[p : p + 100])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    got = queries.op5_suffix_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_a_passage_of_all_documents_meets_in_shares(spark, monkeypatch):
    """No key has more than a few of the places of a passage that many tasks read, and one place is left in the end."""
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 20)
    monkeypatch.setattr(suffix_dedup, "SHARE", 4)
    rng = np.random.default_rng(11)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    shared = word(160)
    rows = spark.createDataFrame([(i, word(30) + shared + word(30)) for i in range(400)], "id long, text string").repartition(100, "id")
    conf = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        met = suffix_dedup.meet(suffix_dedup.text_runs(rows)).cache()
        asks = met.where("place % 2 = 0")
        asked = suffix_dedup.asked_bytes(rows, asks, suffix_dedup.hot_minimisers(asks)).where("bytes is not null").cache()
        most = lambda *by: asked.groupBy(*by).count().agg(F.max("count")).first()[0]
        assert most("bytes") > 60 and most("h") < most("bytes") / 4
        found = suffix_dedup.decide(asked).cache()
        again = found.where("bytes is not null")
        assert 0 < again.count() < asked.count()
        shares = again.groupBy("bytes").count()
        assert shares.where(F.col("bytes").cast("string") == shared[:100]).first()["count"] > 1
        left = suffix_dedup.decide(again.withColumn("h", F.xxhash64("bytes")))
        assert left.where("bytes is not null").isEmpty()
        spans = {r["id"]: [tuple(s) for s in r["spans"]] for r in suffix_dedup.repeated_spans(rows, id_col="id").collect()}
        # bytes beside the passage may be those of an earlier document by chance
        assert spans.pop(0) == [] and len(spans) == 399 and all(len(s) == 1 and s[0][0] <= 30 and s[0][1] >= 190 for s in spans.values())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.catalog.clearCache()


def test_the_pipeline_leaves_the_tables_of_its_last_stage_only(spark, tmp_path):
    texts = [f"some words of a plain text about number {i} and what comes after it, line by line and page by page" for i in range(60)]
    pq.write_table(pa.table({"doc_id": pa.array(range(60), pa.int64()), "text": texts, "lang": ["en"] * 60, "source": ["a"] * 60, "n_chars": pa.array([len(t) for t in texts], pa.int64())}), tmp_path / "documents.parquet")
    folder = common.shared_dir(spark)
    stages = [name.replace(" ", "-").lower() for name, _ in corpus_pipeline.STAGES]
    listed = lambda: {p.getPath().getName() for p in common._in_store(spark, folder)[0].listStatus(common._in_store(spark, folder)[1])}
    before = listed()
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {n.rsplit("-", 1)[0] for n in listed() - before}
    assert stages[3] in left and not left & {*stages[:3], "shingles", "entries", "runs", "windows", "places"}
