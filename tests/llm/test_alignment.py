"""Cross-tokenizer alignment against a plain program that encodes whole texts with the libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemill.llm import alignment, queries

NAMES = alignment.Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
BITS = ["'s", " ", "  ", "\n", "\t", "a", "Bc", "the", " of", "1", "é", "漢字", "🙂", "<|endoftext|>", ".", " ", "'ll", "\r\n", "▁", "<s>", "<0x41>", "\x1c", "\x85", "　", "\0", "ﬁ"]


def plain(texts):
    """(n_a, n_b, groups) of each text, by walking both token lists."""
    first, second = Tokenizer.from_file(NAMES.byte_level), sentencepiece.SentencePieceProcessor(model_file=NAMES.pieces)
    first.encode_special_tokens = True
    letters = alignment._byte_letters()
    out = []
    for text in texts:
        said = f" {text}".encode() if text else b""
        a, b = (first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        a_bytes = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
        groups = []
        if said and b"".join(a_bytes) == said == b"".join(b_bytes):
            i = j = x = y = 0
            u, v = [], []
            while i < len(a):
                if x <= y:
                    u.append(a[i])
                    x, i = x + len(a_bytes[i]), i + 1
                while y < x:
                    v.append(b[j])
                    y, j = y + len(b_bytes[j]), j + 1
                if x == y:
                    groups.append((u, v))
                    u, v = [], []
        out.append(groups)
    return out


def figures(ids, texts):
    found = plain(texts)
    held, best = Counter(), Counter()
    links = [Counter((a, b) for u, v in groups for a in u for b in v) for groups in found]
    for x in links:
        held.update(set(x))
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for i, groups, x in zip(ids, found, links):
        said = ";".join(f"{','.join(map(str, u))}|{','.join(map(str, v))}" for u, v in groups)
        n_best = sum(n for (a, b), n in x.items() if held[a, b] == best[a])
        out.append((str(i), sum(len(u) for u, _ in groups), sum(len(v) for _, v in groups), len(groups), sum(x.values()), n_best, sum(n * held[p] for p, n in x.items()), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return sorted(out)


def documents():
    rng = np.random.default_rng(13)
    texts = [None, "", " ", "  ", "a ", "x▁y", "zz" * 4000, "é" * 300, "漢字" * 200, " lead", "trail \n ", "\n", "the same", "the same"]
    texts += ["".join(rng.choice(BITS, int(rng.integers(1, 14)))) for _ in range(400)]
    texts += [" ".join(rng.choice("the of and Straße naïve tokenizers alignment of 1234 it's x=y".split(), int(n))) for n in rng.integers(1, 200, 40)]
    return [None, None, 5, 5, *range(10, 6 + len(texts))], texts


def test_alignment_against_a_plain_walk(spark, tmp_path):
    ids, texts = documents()
    extra = {"pairs": pa.array(["clash"] * len(ids)), "row": pa.array([1] * len(ids))}
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), **extra}), tmp_path / "documents.parquet", row_group_size=100)
    got = queries.op13_alignment(spark, str(tmp_path))
    assert sorted((str(a), *b) for a, *b in got.collect()) == figures(ids, texts)


def test_nothing_to_align(spark, tmp_path):
    for name, rows in (("none", []), ("null", [None, ""])):
        (tmp_path / name).mkdir()
        pq.write_table(pa.table({"doc_id": pa.array(range(len(rows)), pa.int64()), "text": pa.array(rows, pa.string())}), tmp_path / name / "documents.parquet")
        assert [tuple(r) for r in queries.op13_alignment(spark, str(tmp_path / name)).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in range(len(rows))]


@pytest.mark.parametrize("listed", [1, 4, 4096])
def test_large_groups_are_listed_by_distinct_ids(monkeypatch, listed):
    monkeypatch.setattr(alignment, "LISTED", listed)
    texts = documents()[1]
    x = alignment.align(texts, NAMES)
    pairs, times, at = x.pairs()
    found = [dict(zip(pairs[s:e].tolist(), times[s:e].tolist())) for s, e in zip(at[:-1], at[1:])]
    assert found == [dict(Counter(a << alignment.B_BITS | b for u, v in g for a in u for b in v)) for g in plain(texts)]


def test_words_are_forgotten(monkeypatch):
    texts = documents()[1]
    whole = alignment.align(texts, NAMES).groups_of()
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    assert [alignment.align([t], NAMES).groups_of()[0] for t in texts] == whole


def test_alignment_itself(spark):
    docs = spark.createDataFrame([(1, "the naïve tokenizers"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.align_documents(docs, NAMES).collect()}
    groups, at = defaultdict(list), [0, 0]
    for n, m in zip(got[1]["a_in"], got[1]["b_in"]):
        groups[1].append((got[1]["a_ids"][at[0] : at[0] + n], got[1]["b_ids"][at[1] : at[1] + m]))
        at = [at[0] + n, at[1] + m]
    assert groups[1] == plain(["the naïve tokenizers"])[0] and got[2]["a_ids"] == got[2]["b_in"] == []
