"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded by what
its bytes and words look like (classes of bytes, steps between classes, word lengths,
repeats, hashed words). A gated attention network learns, from labels of whole
documents, which passages count; the score is a logistic function of the weighted passage representation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, document_rows, pieces, texts_of

PASSAGE = 1024
#: Bounds of the sample that a model is fitted on: documents, and bytes of one (longer ones are only scored).
SAMPLE_DOCS = 3000
SAMPLE_BYTES = 1 << 17
HASHED = 32
HIDDEN, GATE = 16, 8
#: Byte classes: control, space, line break, digit, upper, lower, non-ASCII, then single marks, other marks last.
_MARKS = b".,!?|*#$%&-:;/\"'()<>@=_"
_CLASSES = 7 + len(_MARKS) + 1
_GROUP_COUNT = 8
_STATS = 8
N_FEATURES = _CLASSES + _GROUP_COUNT * _GROUP_COUNT + _STATS + HASHED


def _class_table() -> tuple[np.ndarray, np.ndarray]:
    fine = np.full(256, _CLASSES - 1, np.int64)
    fine[:32], fine[127], fine[128:] = 0, 0, 6
    fine[[32, 9]], fine[[10, 13]] = 1, 2
    fine[48:58], fine[65:91], fine[97:123] = 3, 4, 5
    for i, mark in enumerate(_MARKS):
        fine[mark] = 7 + i
    coarse = np.minimum(fine, 7)
    return fine, coarse


_FINE, _COARSE = _class_table()


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, one after the other, and how many each text has (one at least)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-lengths // PASSAGE))
    first = np.cumsum(counts) - counts
    n = int(counts.sum())
    data = np.frombuffer(b"".join(texts), np.uint8)
    start = np.cumsum(lengths) - lengths
    text_of = np.repeat(np.arange(len(texts)), lengths)
    passage = first[text_of] + (np.arange(len(data)) - start[text_of]) // PASSAGE
    size = np.maximum(1, np.bincount(passage, minlength=n))[:, None].astype(np.float64)
    fine, coarse = _FINE[data], _COARSE[data]
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :_CLASSES] = np.bincount(passage * _CLASSES + fine, minlength=n * _CLASSES).reshape(n, -1) / size
    at = _CLASSES
    if len(data) > 1:
        step = passage[1:] * 64 + coarse[:-1] * 8 + coarse[1:]
        out[:, at : at + 64] = np.bincount(step[passage[1:] == passage[:-1]], minlength=n * 64).reshape(n, -1) / size
    at += 64
    # words: runs of bytes above space; each belongs to the passage in which it starts
    solid = data > 32
    edge = np.ones(len(data), bool)
    edge[1:] = text_of[1:] != text_of[:-1]
    begins = np.flatnonzero(solid & (edge | np.r_[True, ~solid[:-1]][: len(data)]))
    if len(begins):
        ends = np.flatnonzero(solid & np.r_[edge[1:] | ~solid[1:], True]) + 1
        of, width = passage[begins], ends - begins
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(data), 0x9E3779B97F4A7C15, np.uint64)])
        lower = np.where((data >= 65) & (data < 91), data + 32, data).astype(np.uint64) + np.uint64(7)
        # a word's hash: bytes weighted by their place in the word
        place = np.arange(len(data)) - np.repeat(begins, np.diff(np.r_[begins, len(data)])) if begins[0] == 0 else np.arange(len(data)) - np.r_[np.zeros(begins[0], np.int64), np.repeat(begins, np.diff(np.r_[begins, len(data)]))]
        value = np.where(solid, lower * power[place], np.uint64(0))
        total = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
        word = total[ends] - total[begins]
        word ^= word >> np.uint64(31)
        words = np.maximum(1, np.bincount(of, minlength=n)).astype(np.float64)
        key = np.unique(of.astype(np.uint64) * np.uint64(1 << 40) ^ (word & np.uint64((1 << 40) - 1)))
        distinct = np.bincount(np.searchsorted(np.arange(n), (key >> np.uint64(40)).astype(np.int64)), minlength=n) if n < 1 << 23 else words
        again = np.zeros(len(of))
        again[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
        out[:, at] = np.bincount(of, width, n) / words / 10
        out[:, at + 1] = np.sqrt(np.maximum(0, np.bincount(of, width.astype(float) ** 2, n) / words - (np.bincount(of, width, n) / words) ** 2)) / 10
        out[:, at + 2] = distinct / words
        out[:, at + 3] = np.bincount(of, again, n) / words
        out[:, at + 4] = np.bincount(of, (data[begins] >= 65) & (data[begins] < 91), n) / words
        last = _FINE[data[ends - 1]]
        out[:, at + 5] = np.bincount(of, last >= 7, n) / words
        out[:, at + 6] = np.bincount(of, width == 1, n) / words
        out[:, at + 7] = np.log1p(words) / 10
        slot = (word % np.uint64(HASHED)).astype(np.int64)
        sign = np.where(word >> np.uint64(33) & np.uint64(1), 1.0, -1.0)
        out[:, at + 8 :] = np.bincount(of * HASHED + slot, sign, n * HASHED).reshape(n, -1) / np.sqrt(words)[:, None] / 4
    return out, counts


class MilModel:
    """h = tanh(x E); weights = softmax over a bag of (tanh(h V) * sigmoid(h U)) w; score = sigmoid(weighted h . c + b)."""

    def __init__(self, parts: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.parts, self.mean, self.scale = parts, mean, scale

    def forward(self, x: np.ndarray, counts: np.ndarray):
        p = self.parts
        first = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        m = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["b"], -30, 30)))
        return z, h, t, g, a, m, y, bag, first

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, counts = encode_passages(texts)
        return self.forward(x.astype(np.float64), counts)[6]


def train(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 300, rate: float = 0.02, decay: float = 1e-4) -> MilModel:
    """Fit by Adam over all bags at once; ``labels`` in 0..1. One class alone gives a model that says that class's share."""
    x, rng = x.astype(np.float64), np.random.default_rng(7)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    shape = {"E": (x.shape[1], HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": (1,)}
    parts = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s) for k, s in shape.items()}
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    parts["b"][:] = np.log(share / (1 - share))
    model, m1, m2 = MilModel(parts, mean, scale), {k: 0.0 for k in parts}, {k: 0.0 for k in parts}
    weight = np.ones(len(labels)) / len(labels)
    for i in range(1, rounds + 1):
        z, h, t, g, a, m, y, bag, first = model.forward(x, counts)
        d = (y - labels) * weight
        dm = d[:, None] * parts["c"]
        da = (dm[bag] * h).sum(1)
        da = a * (da - np.add.reduceat(a * da, first)[bag])
        dtg = da[:, None] * parts["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = a[:, None] * dm[bag] + dt @ parts["V"].T + dg @ parts["U"].T
        dz = dh * (1 - h * h)
        grads = {"E": z.T @ dz, "e": dz.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": m.T @ d, "b": np.array([d.sum()])}
        for k, v in grads.items():
            v = v + decay * parts[k] * (k not in "eb")
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * v, 0.999 * m2[k] + 0.001 * v * v
            parts[k] -= rate * m1[k] / (1 - 0.9**i) / (np.sqrt(m2[k] / (1 - 0.999**i)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs_bound: int = SAMPLE_DOCS) -> MilModel:
    """Fit on at most ``docs_bound`` labelled documents, chosen by a hash of the id among those whose crc32(id as text) mod 4 is not 2.

    Labels of one id are averaged, and a text that comes several times with an id counts once. Without any label the model knows nothing and scores everything alike.
    """
    arrow_limits(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("double").alias("__label"))
    known = known.where("__label is not null and crc32(cast(__id as string)) % 4 <> 2").groupBy("__id").agg(F.avg("__label").alias("__label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(docs_bound)
    rows = document_rows(docs, id_col, text_col).toDF("id", "text").where(F.octet_length("text") <= SAMPLE_BYTES)
    # at most docs_bound pairs of two numbers; an id may come with many texts, and a text of it many times
    labelled = rows.join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("id", "text", "__label", F.xxhash64("text").alias("h"))
    few = labelled.select(F.col("id").alias("i"), F.col("h").alias("k")).distinct().orderBy(F.xxhash64("i"), "i", "k").limit(docs_bound)
    met = labelled.join(F.broadcast(few), (F.col("id") == F.col("i")) & (F.col("h") == F.col("k")), "left_semi")
    sample = met.groupBy("id", "h").agg(F.first("text").alias("text"), F.first("__label").alias("__label")).select("id", "text", "__label")

    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            x, counts = encode_passages(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts), pa.array([r.tobytes() for r in np.split(x.astype("<f4"), np.cumsum(counts)[:-1])], pa.binary())], names=["id", "label", "n", "x"])

    found = sample.mapInArrow(run, "id long, label double, n long, x binary").collect()
    found.sort(key=lambda r: (r["id"], bytes(r["x"])))
    if not found:
        return train(np.zeros((1, N_FEATURES)), np.array([1]), np.array([0.5]), rounds=1)
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES) for r in found])
    return train(x, np.array([r["n"] for r in found]), np.array([r["label"] for r in found]))


def score(docs: DataFrame, model: MilModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The id, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) of every whole text.

    Null and empty texts are one empty passage and get the model's score for it; repeated
    rows are scored alike; an empty table gives an empty result. The model has a fixed size.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches, text_col, 1 << 20):
            y = shared.value.scores(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y), pa.array((y >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return document_rows(docs, id_col, text_col).mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)
