"""Where the tokens of two tokenizers meet.

Both vocabularies encode the same bytes, so a token is a byte range. Neither has
a token that begins before a space and ends behind it (but for spaces before a
word), so a word that a worker has seen isn't encoded again. The texts
of a whole Arrow batch are laid end to end with their byte offsets; the ends of
either tokenizer's tokens are counted once over all those bytes, and bytes where
both end cut the tokens into groups. Prefix sums over groups and tokens, taken
apart at the documents' offsets, give each document's own figures.

What ids are linked how often is counted over the corpus: documents are counted
for each pair of ids, then a pair's count returns to the documents that hold it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, document_rows, joined, pieces, stored

#: An id pair is one integer: the first tokenizer's id above, the second's in the low bits.
B_BITS = 15
#: Links of one group that are listed one by one; those of larger groups are listed by distinct ids.
LISTED = 4096
#: Bytes of text aligned at once.
AT_ONCE = 1 << 20
#: Characters of words that a worker remembers the tokens of, before it starts anew.
REMEMBERED = 3 << 20
#: No token of either tokenizer begins before such a place and ends behind it.
_WORDS = re.compile(r"(?<=\S)(?= .)", re.DOTALL)


@dataclass(frozen=True)
class Vocabularies:
    """Places of a byte-level BPE file (JSON) with its split pattern, and of a sentencepiece model."""

    byte_level: str
    pattern: str
    pieces: str


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes a byte as a letter: printable Latin-1 as itself, the others from U+0100 upwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class _Tables:
    """The two encoders, and for each id the token's bytes, its length and how a group writes it."""

    def __init__(self, names: Vocabularies):
        import sentencepiece
        import tiktoken

        letters = _byte_letters()
        with open(names.byte_level, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        # ids are merge ranks in such a file, so the faster library gives the ids of the file's own
        self.first = tiktoken.Encoding("first", pat_str=names.pattern, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=names.pieces)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self.second.vocab_size())]
        if len(self.b_bytes) > 1 << B_BITS or len(self.a_bytes) > 1 << 31 - B_BITS:
            raise ValueError("pairs of these vocabularies' ids don't fit an integer")
        self.a_length, self.b_length = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        a, b = ([str(i).encode() for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        if any(" " in x.decode(errors="replace").lstrip(" ") for x in self.b_bytes):
            raise ValueError("a piece with a space behind another character: words can't be encoded one by one")
        self.forget()
        #: a token within its side of a group, at the side's end, and (second tokenizer) at the document's end
        self.written = np.array([*(x + b"," for x in a), *(x + b"|" for x in a), *(x + b"," for x in b), *(x + b";" for x in b), *b], object)

    def _piece(self, i: int) -> bytes:
        if self.second.is_byte(i):
            return bytes([int(self.second.id_to_piece(i)[3:5], 16)])
        return self.second.id_to_piece(i).replace("▁", " ").encode()

    def forget(self) -> None:
        self.numbers, self.held = {}, 0
        self.same = bytearray()  # does the second tokenizer give the word back?
        self.a_ids, self.b_ids, self.a_ends, self.b_ends = array("i"), array("i"), array("q", [0]), array("q", [0])

    def word_numbers(self, words: list[str]) -> np.ndarray:
        """Words (each with the spaces before it) as numbers of remembered ones; those not seen yet are encoded."""
        if self.held > REMEMBERED:
            self.forget()
        new = list(dict.fromkeys(w for w in words if w not in self.numbers))
        # the model puts a space before what it encodes, so the word comes without its first
        for word, b in zip(new, self.second.encode([w[1:] for w in new], num_threads=1) if new else []):
            a = self.first.encode_ordinary(word)
            self.numbers[word] = len(self.numbers)
            self.held += len(word)
            self.same.append(b"".join(map(self.b_bytes.__getitem__, b)) == word.encode())
            self.a_ids.extend(a)
            self.b_ids.extend(b)
            self.a_ends.append(len(self.a_ids))
            self.b_ends.append(len(self.b_ids))
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))


def _gathered(ids: array, ends: array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after the other, and where each word's begin (and the end)."""
    ends = np.array(ends)
    length = np.diff(ends)[words]
    at = np.r_[0, np.cumsum(length)]
    return np.array(ids, np.int64)[np.repeat(ends[words] - at[:-1], length) + np.arange(at[-1])], at


@functools.lru_cache(2)
def tables(names: Vocabularies) -> _Tables:
    return _Tables(names)


@dataclass
class Alignment:
    """A batch of documents: flat token ids, groups of tokens and groups of documents."""

    names: Vocabularies
    a: np.ndarray  # ids by the first tokenizer
    b: np.ndarray
    a_at: np.ndarray  # where each document's ids begin, and their end
    b_at: np.ndarray
    a_group: np.ndarray  # the group of each token
    b_group: np.ndarray
    a_in: np.ndarray  # tokens of each group
    b_in: np.ndarray
    group_at: np.ndarray  # where each document's groups begin, and their end

    def links(self) -> np.ndarray:
        """Linked token pairs of each document."""
        before = np.r_[0, np.cumsum(self.a_in * self.b_in)]
        return np.diff(before[self.group_at])

    def groups_of(self) -> list[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3`` (ids in order)."""
        t = tables(self.names)
        n_a, n_b = len(t.a_bytes), len(t.b_bytes)
        a_before, b_before = np.r_[0, np.cumsum(self.a_in)], np.r_[0, np.cumsum(self.b_in)]
        word = np.empty(len(self.a) + len(self.b), np.int64)
        a_to = np.arange(len(self.a)) + b_before[self.a_group]
        b_to = np.arange(len(self.b)) + a_before[self.b_group + 1]
        word[a_to] = self.a + n_a * (np.arange(len(self.a)) == a_before[self.a_group + 1] - 1)
        word[b_to] = self.b + 2 * n_a + n_b * (np.arange(len(self.b)) == b_before[self.b_group + 1] - 1)
        ends = self.a_at + self.b_at
        full = np.flatnonzero(np.diff(ends) > 0)
        word[ends[full + 1] - 1] += n_b
        parts = t.written[word].tolist()
        return [b"".join(parts[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each document (``a << B_BITS | b``, ascending), how often each is linked, and where each document's begin."""
        size = self.a_in * self.b_in
        doc = np.repeat(np.arange(len(self.group_at) - 1), np.diff(self.group_at))
        a_start, b_start = np.cumsum(self.a_in) - self.a_in, np.cumsum(self.b_in) - self.b_in
        small = np.flatnonzero(size <= LISTED)
        k = size[small]
        group = np.repeat(small, k)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(k) - k, k)
        i, j = np.divmod(nth, self.b_in[group])
        keys = [doc[group] << 31 | self.a[a_start[group] + i] << B_BITS | self.b[b_start[group] + j]]
        counts = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(size > LISTED):
            u, m = np.unique(self.a[a_start[g] : a_start[g] + self.a_in[g]], return_counts=True)
            v, n = np.unique(self.b[b_start[g] : b_start[g] + self.b_in[g]], return_counts=True)
            keys.append((doc[g] << 31 | u[:, None] << B_BITS | v).ravel())
            counts.append((m[:, None] * n).ravel())
        key, count = np.concatenate(keys), np.concatenate(counts)
        if len(keys) == 1:
            key, count = np.unique(key, return_counts=True)
        else:
            key, where = np.unique(key, return_inverse=True)
            count = np.bincount(where, count, len(key)).astype(np.int64) if len(key) else count
        return key & (1 << 31) - 1, count, np.searchsorted(key >> 31, np.arange(len(self.group_at)))


def align(texts: list[str | None], names: Vocabularies) -> Alignment:
    """Align the tokens of texts. A text that is null or empty, or that a tokenizer doesn't give back byte by byte, has no tokens."""
    t = tables(names)
    split = [_WORDS.split(f" {x}") if x else [] for x in texts]
    words = t.word_numbers([w for x in split for w in x])
    ends = np.r_[0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
    changed = np.r_[0, np.cumsum(np.frombuffer(bytes(t.same), np.uint8)[words] == 0)]
    given_back = np.diff(changed[ends]) == 0
    words = words[np.repeat(given_back, np.diff(ends))]
    ends = np.r_[0, np.cumsum(np.diff(ends) * given_back)]
    (a, a_at), (b, b_at) = _gathered(t.a_ids, t.a_ends, words), _gathered(t.b_ids, t.b_ends, words)
    a_at, b_at = a_at[ends], b_at[ends]
    a_end, b_end = np.cumsum(t.a_length[a]), np.cumsum(t.b_length[b])
    at = np.r_[0, a_end][a_at]  # where each document's bytes begin, and their end
    total = int(at[-1])
    both = (np.bincount(a_end, minlength=total + 1) > 0) & (np.bincount(b_end, minlength=total + 1) > 0)
    groups = np.cumsum(both)  # groups that end at a byte or before
    a_group, b_group = groups[a_end - 1], groups[b_end - 1]
    n = int(groups[-1])
    return Alignment(names, a, b, a_at, b_at, a_group, b_group, np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n), groups[at])


def _lists(flat: np.ndarray, at: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))


def align_documents(docs: DataFrame, names: Vocabularies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment itself: id, ``a_ids`` and ``b_ids``, and of each group how many tokens of either it takes (``a_in``, ``b_in``).

    Every row is a document of its own. Needs no shuffle; an empty table gives an empty result.
    """
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in pieces(batches, text_col, AT_ONCE):
            x = align(batch.column(1).to_pylist(), names)
            lists = [_lists(x.a, x.a_at, pa.int32()), _lists(x.b, x.b_at, pa.int32()), _lists(x.a_in, x.group_at, pa.int32()), _lists(x.b_in, x.group_at, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "a_ids", "b_ids", "a_in", "b_in"])

    made = document_rows(docs, id_col, text_col).mapInArrow(run, "id long, a_ids array<int>, b_ids array<int>, a_in array<int>, b_in array<int>")
    return made.withColumnRenamed("id", id_col)


def document_pairs(docs: DataFrame, names: Vocabularies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures of each document's alignment, and its distinct linked id pairs (``pairs``) with their links (``times``)."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in pieces(batches, text_col, AT_ONCE):
            x = align(batch.column(1).to_pylist(), names)
            pairs, times, at = x.pairs()
            sums = [hashlib.sha256(g).hexdigest() if g else "" for g in x.groups_of()]
            figures = [pa.array(v, pa.int64()) for v in (np.diff(x.a_at), np.diff(x.b_at), np.diff(x.group_at), x.links())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *figures, pa.array(sums), _lists(pairs, at, pa.int32()), _lists(times, at, pa.int64())], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return document_rows(docs, id_col, text_col).mapInArrow(run, "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<bigint>")


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair``, its ``k`` (documents that hold it linked) and ``best`` (no pair of its first id has more).

    Documents are counted map-side first. The highest count of each first id has at most as many rows as the
    vocabulary has ids, so it is broadcast.
    """
    counts = stored(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("k")), "alignment-counts")
    first = F.shiftright("pair", B_BITS)
    top = counts.groupBy(first.alias("a")).agg(F.max("k").alias("top"))
    return counts.join(F.broadcast(top), first == F.col("a")).select("pair", "k", (F.col("k") == F.col("top")).alias("best"))


def alignment_digests(docs: DataFrame, names: Vocabularies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: tokens by either tokenizer, groups, links, and how the links stand in the whole corpus.

    ``n_best`` counts the links whose id pair is held linked by as many documents as any pair of its first id (ties
    included); ``count_sum`` adds these numbers of documents over all links; ``groups_sha256`` digests the groups. Texts
    that are null or empty, or that a tokenizer changes, have zeros and ''. Rows that repeat an id, or have none, are
    documents of their own. Texts are encoded once: a document's distinct pairs are stored, and counts meet them there,
    those of frequent pairs by broadcast.
    """
    found = stored(document_pairs(docs, names, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "alignment")
    counts = pair_counts(found)
    rows = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    n_rows = counts.agg(F.sum("k")).first()[0] or 0
    met = joined(rows, counts.select("pair", "k", "best", F.col("k").alias("docs")), ["pair"], n_rows)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return found.join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
