"""Brute-force tests of what the training-data operators have to find or leave alone as a whole."""

import hashlib
import re
import zlib

import numpy as np

from tidemill.llm import exact_dedup, langid, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in texts], SCHEMA)


def shingle_set(text, words=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def near_kept(texts, similarity=0.8):
    """(id, text) that stay: of each component the smallest id (null last)."""
    texts = sorted(set(texts), key=lambda x: (x[0] is None, x[0] or 0, str(x[1])))
    sets, label = [shingle_set(t) for _, t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if (both >= similarity * union) and label[i] != label[j]:
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    return sorted((texts[k] for k in set(label)), key=str)


def graded(rng, n, vocabulary=10**6):
    """Texts with copies of rising distance, similarities from 0.6 to 1."""
    out = []
    for i in range(n):
        base = [f"w{rng.integers(vocabulary)}" for _ in range(int(rng.integers(20, 200)))]
        copy = list(base)
        for at in rng.integers(0, len(copy), int(rng.integers(1, max(2, len(copy) // 20)))):
            copy[at] = "changed"
        out += [" ".join(base), " ".join(copy)]
    return out


def test_near_duplicates_against_brute_force(spark):
    texts = list(enumerate(graded(np.random.default_rng(9), 150)))
    texts += [(1000 + i, t) for i, t in enumerate(["a b c d e f g h", "A b c d e f g h", "a b c", "", None, "x y z u v w"])]
    exact = [len(shingle_set(a[1]) & shingle_set(b[1])) / len(shingle_set(a[1]) | shingle_set(b[1])) for a, b in zip(texts[:300:2], texts[1:300:2])]
    assert sum(0.8 <= x < 0.9 for x in exact) > 15 and sum(0.65 <= x < 0.8 for x in exact) > 15
    got = simhash.drop_near_duplicates(docs(spark, texts)).collect()
    # null and empty texts are one set without shingles
    want = [x for x in near_kept([(i, t or "") for i, t in texts if i != 1003 and i != 1004])] + [(1003, "")]
    assert sorted(((r["doc_id"], r["text"] or "") for r in got), key=str) == sorted(want, key=str)


def test_similar_texts_whose_fingerprints_are_far_apart(spark):
    """Four of five shingles in common, but more than 80 of 256 bits differ by chance."""
    words = [
        ["w3279", "w1650", "w3678", "w3591", "w102", "w4955", "w1490", "w543", "w441"],
        ["w2535", "w4654", "w4774", "w1938", "w101", "w2984", "w407", "w1", "w1313"],
    ]
    rows = [(10 * k + i, " ".join(w[: 8 + i])) for k, w in enumerate(words) for i in range(2)]
    sets = [simhash.shingles(t.encode(), 5) for _, t in rows]
    assert all(np.bitwise_count(simhash._wide(a, 4) ^ simhash._wide(b, 4)).sum() > 80 for a, b in zip(sets[::2], sets[1::2]))
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()) == [0, 10]


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(3)
    for size in [1, 4, 5, 340, 341, 342, 420, 426, 427, 430, 1365, 1706, 1707, 5000, 6826, 6900, 27000, 30000]:
        for similarity in (0.8, 0.95):
            union = rng.integers(1 << 64, size=int(size / similarity), dtype=np.uint64)
            for a, b in ((union[:size], union), (union[: (len(union) + size) // 2], np.r_[union[:size], union[(len(union) + size) // 2 :]])):
                kinds = set(simhash._kinds(len(a), similarity)) & set(simhash._kinds(len(b), similarity))
                assert max(simhash._kind(len(a)), simhash._kind(len(b))) in kinds
                for k in kinds:
                    x, y = (np.r_[np.uint64(0), np.uint64(len(s)), simhash.sketch(s, simhash.SKETCH_LANES[k])] for s in (a, b))
                    x[0] = ~x[0]  # fingerprints as far apart as can be
                    assert simhash._open(x[None], y, 1, 5, len(np.intersect1d(a, b)) / len(np.union1d(a, b)))[0]


def test_near_duplicates_of_all_sizes_without_fingerprints(spark, monkeypatch):
    """What fingerprints don't find sketches leave open, and chance meetings stay apart."""
    monkeypatch.setattr(simhash, "WIDE_SHARE", 0)
    rng, texts = np.random.default_rng(5), []
    for n in [6, 9, 30, 400, 425, 431, 440, 520, 530, 1700, 2000, 2100, 7500]:
        base = [f"w{rng.integers(10**6)}" for _ in range(n)]
        cut = (n - 4) * 8 // 10 + 4
        texts += [" ".join(base), " ".join(base[:cut]), " ".join(base[: cut - 1]), " ".join([*base[: cut + 1], *(f"v{rng.integers(10**6)}" for _ in range(n - cut - 1))])]
    rows = list(enumerate(texts[k] for k in rng.permutation(len(texts))))
    got = simhash.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == near_kept(rows)


def test_groups_larger_than_a_part(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:50] + [f"x{i}"] + base[50:])) for i in range(40)]
    d = docs(spark, rows).selectExpr("doc_id as id", "unhex(sha2(text, 256)) as key", "text")
    entries = simhash.shingle_entries(d, 5, 0.8, 4).selectExpr("key", "xxhash64(set) as entry", "f0", "f1", "f2", "f3").cache()
    groups = entries.selectExpr("entry as node", "0L as component")
    links = simhash.similar_links(d, entries, groups, 5, 0.8, 4, 80, size=7).collect()
    assert len({x for r in links for x in r}) == 40


def test_null_and_repeated_ids_lose_no_document(spark):
    a, b, c, d = ("alpha one two three four five six", "beta other words that stand alone here", "gamma third text of its own again", "delta fourth and last of them all")
    rows = [(None, a), (None, b), (1, c), (1, d), (1, d), (2, c), (None, d.upper())]
    exact = exact_dedup.drop_exact_duplicates(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in exact), key=str) == sorted([(None, a), (None, b), (2, c), (1, d)], key=str)
    near = simhash.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in near), key=str) == sorted([(None, a), (None, b), (1, c), (1, d)], key=str)


def without_repeats(rows, window=100):
    """{(id, text): bytes that stay}: places in the order of id (null first) and SHA-256 of the text."""
    order = sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[1].encode()).hexdigest()))
    seen, out = set(), {}
    for i, text in order:
        t = text.encode()
        mask = np.zeros(len(t), bool)
        for p in range(len(t) - window + 1):
            if t[p : p + window] in seen:
                mask[p : p + window] = True
            seen.add(t[p : p + window])
        out[i, text] = np.frombuffer(t, np.uint8)[~mask].tobytes()
    return out


def test_repeats_under_null_and_repeated_ids(spark):
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("abcde "), n))
    shared = word(160)
    rows = [(None, word(20) + shared), (None, word(20) + shared), (None, word(130)), (1, word(300) + shared + word(40)), (1, word(120)), (2, shared + word(60)), (2, shared + word(60)), (3, word(140)), (-(1 << 63), word(50) + shared)]
    rows.append(rows[3])
    want = without_repeats(rows)
    cut = suffix_dedup.cut_repeats(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in cut) == sorted((str(i), want[i, t].decode()) for i, t in rows)
    found = suffix_dedup.repeated_spans(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["kept_sha256"]) for r in found) == sorted((str(i), hashlib.sha256(want[i, t]).hexdigest()) for i, t in rows)
    assert all(s["end"] > s["start"] for r in found for s in r["spans"])


def test_every_labelled_language_is_learned(spark):
    words = lambda k: " ".join(chr(0x4E00 + 40 * k + i) * 3 for i in range(30))
    rows = [(3 * k + i, words(k), f"l{k:03d}") for k in range(205) for i in range(3)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.judge([words(k) for k in range(205)])[0]) == {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5}
