"""Language identification by interpolated Kneser-Ney character models.

A model counts character n-grams up to ``order`` per language on a bounded
sample of labelled documents. All n-grams of all languages share sorted arrays
of 64-bit hashes, one per order; beside each hash stand the interpolated log
probabilities of every language, worked out when the model is built, so scoring
needs one binary search for a position that the model knows. The language with
the lowest cross-entropy per character wins. A text is rejected if that entropy
is closer to what scrambled letters of the language give than to its prose.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_limits, document_rows, pieces

ORDER = 5
#: Bound of the sample that a model is fitted on: documents per language.
SAMPLE_DOCS_PER_LANG = 400
#: Longer texts are only judged, so the sample of a language has a size bound in bytes too.
SAMPLE_BYTES = 1 << 18
UNKNOWN = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = 32


@functools.lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: what it becomes (a lower-case letter or a space), and whether it is a letter."""
    out, letter = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i], letter[i] = (ord(low) if len(low) == 1 else i), True
        elif i > 0x2FF and unicodedata.category(c)[0] == "M":
            out[i] = i
    return out, letter


def normalised(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each after ``order - 1`` spaces, with runs of other characters as one space;
    the texts' starts (one more than there are texts), and which of them have a letter."""
    table, letter = _letters()
    pad = np.full(order - 1, _SPACE, np.uint32)
    parts, starts, known = [], [0], []
    for text in texts:
        raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        known.append(bool(letter[raw].any()))
        c = table[raw]
        gap = c == _SPACE
        c = c[~(gap & np.r_[True, gap[:-1]])] if len(c) else c
        parts += [pad, c]
        starts.append(starts[-1] + len(pad) + len(c))
    return np.concatenate(parts) if parts else pad[:0], np.asarray(starts, np.int64), np.asarray(known, bool)


def gram_hashes(c: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[n][i]: of the n characters from i; hashes[0] is unused."""
    c = c.astype(np.uint64) + np.uint64(1)
    out, h = [np.zeros(0, np.uint64)], np.zeros(len(c), np.uint64)
    for n in range(1, order + 1):
        m = len(c) - n + 1
        h = h[: max(m, 0)] * _STEP + c[n - 1 :]
        # only the mixed value leaves the function; the recurrence stays linear
        out.append((h ^ (h >> np.uint64(29))) * _MIX)
    return out


class SortedHashes:
    """A sorted array of hashes, with the place where each value of their leading bits begins."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __len__(self):
        return len(self.keys)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands (any place if it is missing), and which are there."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        i = np.minimum(self.begin[(h >> self.shift).astype(np.int64)], len(self.keys) - 1)
        hit = self.keys[i] == h
        left = np.flatnonzero(self.keys[i] < h)
        while len(left):
            i[left] += 1
            left = left[i[left] < len(self.keys)]
            at = self.keys[i[left]]
            hit[left] = at == h[left]
            left = left[at < h[left]]
        return np.minimum(i, len(self.keys) - 1), hit


class Model:
    """Sorted hash arrays with log probabilities (order n) and log back-off weights (of contexts of n - 1 characters)."""

    def __init__(self, langs, order, keys, logp, logg, mean, scrambled, heat):
        self.langs, self.order, self.keys, self.logp, self.logg = langs, order, keys, logp, logg
        self.mean, self.scrambled, self.heat = mean, scrambled, heat

    def _logp(self, hashes: list[np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities [position, language] of the last of n characters that end at ``at``."""
        if n == 0:
            return np.full((len(at), len(self.langs)), self.logp[0], np.float32)
        if not len(self.keys[n]):
            return self._logp(hashes, at, n - 1)
        i, hit = self.keys[n].find(hashes[n][at - n + 1])
        out, miss = self.logp[n][i], np.flatnonzero(~hit)
        if len(miss):
            low = self._logp(hashes, at[miss], n - 1)
            if n > 1 and len(self.keys[n - 1]):
                i, hit = self.keys[n - 1].find(hashes[n - 1][at[miss] - n + 1])
                low = low + np.where(hit[:, None], self.logg[n][i], np.float32(0))
            elif n == 1:
                low = low + self.logg[1]
            out[miss] = low
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character [text, language], and which texts have a letter."""
        c, starts, known = normalised(texts, self.order)
        pad, out = self.order - 1, np.zeros((len(texts), len(self.langs)))
        lengths = np.diff(starts) - pad
        inside = np.ones(len(c), bool)
        for i in range(pad):
            inside[starts[:-1] + i] = False
        for a in range(0, len(c), 1 << 18):
            part = c[max(0, a - pad) : a + (1 << 18)]
            hashes = gram_hashes(part, self.order)
            at = np.flatnonzero(inside[a : a + (1 << 18)]) + (a - max(0, a - pad))
            if not len(at):
                continue
            p = self._logp(hashes, at, self.order)
            text_of = np.searchsorted(starts, at + max(0, a - pad), side="right") - 1
            first = np.flatnonzero(np.r_[True, text_of[1:] != text_of[:-1]])
            out[text_of[first]] -= np.add.reduceat(p, first, axis=0, dtype=np.float64)
        out[known] /= lengths[known][:, None]
        out[~known] = 0
        return out, known

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Per text: language, score, entropy, and whether it is rejected."""
        e, known = self.entropies(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), ~known
        best = e.argmin(1)
        gap = (e - e.min(1, keepdims=True)) * self.heat
        score = np.where(known, 1 / np.exp(-gap).sum(1), 0.0)
        low = e[np.arange(len(e)), best]
        rejected = ~known | (low > (self.mean[best] + self.scrambled[best]) / 2)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], score, low, rejected


def _counted(texts: list[str], order: int) -> list[tuple[np.ndarray, ...]]:
    """For n from 1 to ``order`` the distinct n-grams of one language's texts: hash, hash of the first and of the last n - 1 characters, count.

    Counts are of occurrences at the top order; below it, of the distinct n-grams that an n-gram ends (continuations).
    """
    c, starts, _ = normalised(texts, order)
    hashes, pad = gram_hashes(c, order), order - 1
    ends = np.concatenate([np.arange(a + pad, b) for a, b in zip(starts[:-1], starts[1:])] or [np.zeros(0, np.int64)]).astype(np.int64)
    out = []
    for n in range(order, 0, -1):
        h, first, counts = np.unique(hashes[n][ends - n + 1], return_index=True, return_counts=True)
        ends = ends[first]
        none = np.zeros(len(h), np.uint64)
        out.append((h, hashes[n - 1][ends - n + 1] if n > 1 else none, hashes[n - 1][ends - n + 2] if n > 1 else none, counts.astype(np.float64)))
    return out[::-1]


def _at(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where hashes stand in sorted keys, and which are there."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return i, keys[i] == h


def fit(samples: dict[str, list[str]], order: int = ORDER) -> Model:
    """A model of the texts per language; every fifth text only calibrates (all do both if there are fewer than five).

    Languages are counted one after the other, so no more than one language's positions are in memory at once.
    """
    langs = sorted(samples)
    if not langs:
        return Model([], order, [SortedHashes(np.zeros(0, np.uint64))] * (order + 1), [np.float32(0)] * (order + 1), [np.float32(0)] * (order + 1), np.zeros(0), np.zeros(0), 1.0)
    held = {k: v[::5] for k, v in samples.items()}
    counted = [_counted([t for i, t in enumerate(samples[k]) if i % 5] or samples[k], order) for k in langs]
    n_langs = len(langs)

    keys, logp, logg = [np.zeros(0, np.uint64)], [np.float32(np.log(1 / 4096))], [np.zeros(0, np.float32)]
    below = None
    for n in range(1, order + 1):
        h, context, suffix, k = (np.concatenate([grams[n - 1][i] for grams in counted]) for i in range(4))
        l = np.repeat(np.arange(n_langs), [len(grams[n - 1][0]) for grams in counted])
        for grams in counted:
            grams[n - 1] = ()
        n1, n2 = (np.bincount(l[k == x], minlength=n_langs) for x in (1, 2))
        discount = np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.1, 0.95)
        if n == 1:
            ctx, n_ctx = np.zeros(len(h), np.int64), 1
        else:
            # at a text's start a context is no n-gram of its own: what follows it is left to the lower orders
            n_ctx = len(keys[n - 1])
            ctx, good = _at(keys[n - 1], context)
            h, suffix, k, l, ctx = h[good], suffix[good], k[good], l[good], ctx[good]
        cell = ctx * n_langs + l
        total = np.bincount(cell, k, n_ctx * n_langs).reshape(n_ctx, n_langs)
        kinds = np.bincount(cell, minlength=n_ctx * n_langs).reshape(n_ctx, n_langs)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        ukeys, first, u = np.unique(h, return_index=True, return_inverse=True)
        if n == 1:
            below = np.broadcast_to(weight[0] / 4096, (len(ukeys), n_langs)).copy()
        else:
            below = weight[ctx[first]] * below[_at(keys[n - 1], suffix[first])[0]]
        below[u, l] += np.maximum(k - discount[l], 0) / total[ctx, l]
        keys.append(ukeys)
        logp.append(np.log(below).astype(np.float32))
        logg.append(np.log(weight[0] if n == 1 else weight).astype(np.float32))
    del counted

    model = Model(langs, order, [SortedHashes(k) for k in keys], logp, logg, np.zeros(n_langs), np.full(n_langs, np.inf), 1.0)
    rng = np.random.default_rng(0)
    gaps, right = [], []
    for i, k in enumerate(langs):
        e, known = model.entropies(held[k])
        model.mean[i] = e[known][:, i].mean() if known.any() else 0.0
        mixed = ["".join(rng.permutation(list(t)).tolist()) for t in held[k]]
        s, known_s = model.entropies(mixed)
        model.scrambled[i] = s[known_s].min(1).mean() if known_s.any() else np.inf
        gaps.append(e[known] - e[known].min(1, keepdims=True))
        right.append(np.full(int(known.sum()), i))
    gaps, right = np.concatenate(gaps), np.concatenate(right)
    if len(right):
        heats = np.array([0.5, 1, 2, 4, 8, 16, 32])
        loss = [-np.log(np.maximum(1e-12, (np.exp(-gaps * t) / np.exp(-gaps * t).sum(1, keepdims=True))[np.arange(len(right)), right])).mean() for t in heats]
        model.heat = float(heats[int(np.argmin(loss))])
    return model


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, per_lang: int = SAMPLE_DOCS_PER_LANG) -> Model:
    """Fit on at most ``per_lang`` documents (of at most ``SAMPLE_BYTES`` each) of every labelled language, chosen by a hash of the id
    among those whose crc32(id as text) mod 5 is not 0."""
    rows = document_rows(docs, id_col, text_col, lang_col).toDF("id", "text", "lang").where("lang is not null and text is not null and crc32(cast(id as string)) % 5 <> 0").where(F.octet_length("text") <= SAMPLE_BYTES)
    # a cut on the hash leaves a few times as many as wanted, whatever a language's share; then the smallest hashes are taken
    share = rows.groupBy("lang").agg((F.lit(3.0 * per_lang) / F.count(F.lit(1))).alias("share"))
    mark = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e6
    few = rows.join(F.broadcast(share), "lang").where(F.col("share") > mark)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text"))
    picked = few.withColumn("rank", rank).where(F.col("rank") <= per_lang).orderBy("lang", "rank").select("lang", "text")
    samples: dict[str, list[str]] = {}
    for r in picked.toLocalIterator():  # never all rows in the JVM's and Python's memory at once
        samples.setdefault(r["lang"], []).append(r["text"])
    return fit(samples, order)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """The id with ``lang_pred``, ``score`` (0 to 1), ``entropy`` and ``rejected`` for every whole text.

    Texts that are null or have no letter are ``und`` with score 0 and rejected;
    a model that had no labelled document to learn from calls every text ``und``
    with score 0 and rejects only texts without a letter.
    With ``keep``, returns instead the rows of ``docs`` that are not rejected.
    The model, whose size is bounded by its sample, travels as a broadcast variable.
    """
    spark: SparkSession = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches, text_col, 1 << 20):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            lang, score, entropy, rejected = shared.value.judge(texts)
            if keep:
                yield batch.filter(pa.array(~rejected))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(entropy), pa.array(rejected)], names=["id", "lang_pred", "score", "entropy", "rejected"])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    return document_rows(docs, id_col, text_col).mapInArrow(run, "id long, lang_pred string, score double, entropy double, rejected boolean").withColumnRenamed("id", id_col)
