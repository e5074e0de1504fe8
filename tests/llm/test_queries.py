"""Every registered query without SQL, and the pipeline, on odd small tables against plain programs."""

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from tidemill.llm import bpe, langid, packing, quality, queries, simhash, suffix_dedup

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = {
    "en": "the of and to in is that for it was on are with his they at be this have from or had by word but not what all were we when".split(),
    "de": "der die und den von das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang], n)).capitalize() + "."


def documents():
    """(doc_id, text, lang): prose, copies of all kinds, shared passages, odd texts, null and repeated ids, one very long text."""
    rng, rows = np.random.default_rng(20), []
    shared = prose(rng, "en", 60)
    for i in range(60):
        lang = ("en", "de")[i % 2]
        rows.append((i, prose(rng, lang, int(rng.integers(8, 120))) + (f" {shared}" if i % 9 == 0 else ""), lang))
    base = rows[7][1]
    rows += [(100, base, "de"), (101, base.upper(), "de"), (102, base + " auch", None), (103, rows[4][1].replace("the", "this", 1), "en")]
    rows += [(200, None, "en"), (201, "", None), (202, "  \t\n", "en"), (203, "!!! 123 456", "en"), (204, "a", None), (205, "ÀÉ ü   漢字 🙂 x", "fr")]
    rows += [(300, " ".join(f"w{j % 977}x{j}" for j in range(30000)), "en"), (301, "z" * 5000, "de")]
    rows += [(None, prose(rng, "en", 30), "en"), (None, prose(rng, "de", 30), "de"), (400, prose(rng, "en", 25), "en"), (400, prose(rng, "de", 25), "de"), rows[3], rows[3]]
    return rows


DOCS = documents()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    ids, texts, langs = zip(*DOCS)
    extra = {"__key": pa.array(["clash"] * len(DOCS)), "__keep": pa.array(range(len(DOCS))), "__place": pa.array(["p"] * len(DOCS)), "entry": pa.array([1] * len(DOCS))}
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(["s"] * len(DOCS)), **extra}), path / "documents.parquet", row_group_size=20)
    turns = [(5, 1, "assistant", "hé </s> <|text|>"), (5, 0, "user", "a\\b"), (5, 2, None, None), (6, None, "assistant", "late"), (6, 0, "user", "[INST]"), (None, 0, "assistant", "x"), (7, 0, "user", "same"), (7, 0, "user", "same"), (7, 1, "assistant", "🙂<|end|>\\"), (8, 0, "assistant", "long " * 50000)]
    c, n, r, t = zip(*turns)
    pq.write_table(pa.table({"conv_id": pa.array(c, pa.int64()), "turn": pa.array(n, pa.int64()), "role": pa.array(r, pa.string()), "text": pa.array(t, pa.string())}), path / "conversations.parquet")
    return str(path), turns


def test_fingerprints_and_components(spark, folder):
    def shingles(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []

    def fingerprint(text):
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, fingerprint(t)) for i, t, _ in DOCS]
    label = {f: f for _, f in prints}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(label, 2):
        if (a ^ b).bit_count() <= 3:
            label[find(a)] = find(b)
    low = {}
    for i, f in prints:
        if i is not None:
            low[find(f)] = min(i, low.get(find(f), i))
    want = sorted((str(i), f"{f:016x}", str(low.get(find(f)))) for i, f in prints)
    got = queries.op8_simhash_dedup(spark, folder[0]).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_near_fingerprints_over_many_lists(spark):
    rng = np.random.default_rng(21)
    base = rng.integers(0, 2**63, 300, np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, int(k), False).astype(np.uint64)) for k in rng.integers(1, 6, 600)]
    prints = np.unique(np.concatenate([base, rng.choice(base, 600) ^ np.array(flips)]))
    rows = spark.createDataFrame([(int(np.int64(p)), i) for i, p in enumerate(prints.view(np.int64))], "f0 long, entry long")

    def joined(pairs):
        label = list(range(len(prints)))
        for a, b in pairs:
            x, y = label[a], label[b]
            label = [min(x, y) if k in (x, y) else k for k in label]
        return label

    # links of a list are contracted, so their components count, not each link
    near = [(a, int(b)) for a in range(len(prints)) for b in np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= 3) if a < b]
    assert joined((r["a"], r["b"]) for r in simhash.near_links(rows, chunk=37).collect()) == joined(near)


def test_token_digests(spark, folder):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    want = []
    for i, t, _ in DOCS:
        ids = enc.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(a), *b) for a, *b in queries.op10_bpe(spark, folder[0]).collect()) == sorted(want)
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    back = bpe.decode_ids(bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in back.collect()) == sorted((str(i), (t or "").encode()) for i, t, _ in DOCS)


def test_chats_read_back(spark, folder):
    path, turns = folder
    rows = [*turns, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    held = defaultdict(list)
    for c, n, r, t in rows:
        held[c].append(((n is not None, n or 0, r or "", t or "")))
    want = {}
    for c, parts in held.items():
        parts.sort()
        learned = "".join(t for _, _, r, t in parts if r == "assistant")
        want[c] = (len(parts), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in parts).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    got = queries.op7_chat_format(spark, path).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want and len(got) == len(want)


def plain_kneser_ney(texts, order):
    """Interpolated Kneser-Ney of one language with dictionaries: the probability of a character after a context."""
    c, starts, _ = langid.normalised(texts, order)
    text = [tuple(c[a:b]) for a, b in zip(starts[:-1], starts[1:])]
    top = Counter(t[i - order + 1 : i + 1] for t in text for i in range(order - 1, len(t)))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    known = {0: {()}}
    for n in range(1, order + 1):
        known[n] = {g for g in counts[n] if n == 1 or g[:-1] in known[n - 1]}
    discount = {}
    for n in range(1, order + 1):
        n1, n2 = (sum(v == x for v in counts[n].values()) for x in (1, 2))
        discount[n] = min(0.95, max(0.1, n1 / max(n1 + 2 * n2, 1)))
    followers = defaultdict(list)
    for n in range(1, order + 1):
        for g in known[n]:
            followers[g[:-1]].append(counts[n][g])

    def p(g):
        if not g:
            return 1 / 4096
        n, after = len(g), followers.get(g[:-1])
        if not after or (n > 1 and g[:-1] not in known[n - 1]):
            return p(g[1:])
        total, kinds = sum(after), len(after)
        direct = max(counts[n][g] - discount[n], 0) / total if g in known[n] else 0.0
        return direct + discount[n] * kinds / total * p(g[1:])

    return p


def test_language_model_against_dictionaries():
    rng = np.random.default_rng(22)
    samples = {k: [prose(rng, k, 25) for _ in range(4)] for k in WORDS}
    order = 3
    model = langid.fit(samples, order)
    plain = {k: plain_kneser_ney([t for i, t in enumerate(v) if i % 5], order) for k, v in samples.items()}
    tests = [prose(rng, "en", 12), prose(rng, "de", 12), "xyz qqq", "a"]
    got, _ = model.entropies(tests)
    for i, text in enumerate(tests):
        c, _, _ = langid.normalised([text], order)
        for j, k in enumerate(model.langs):
            grams = [tuple(c[e - order + 1 : e + 1]) for e in range(order - 1, len(c))]
            assert abs(got[i, j] + sum(math.log(plain[k](g)) for g in grams) / len(grams)) < 1e-4
    # probabilities after any context sum to one over an alphabet of 4096 characters
    for k in WORDS:
        letters = {int(x) for t in samples[k] for x in langid.normalised([t], 1)[0]}
        for context in ("th", "  ", "zz"):
            mass = sum(plain[k]((*map(ord, context), x)) for x in letters)
            assert abs(mass + (4096 - len(letters)) * plain[k]((*map(ord, context), 0x4E00)) - 1) < 1e-9


def test_language_of_documents(spark, folder):
    usable = [(i, t, k) for i, t, k in DOCS if t is not None and k is not None and i is not None and zlib.crc32(str(i).encode()) % 5]
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    model = langid.learn(docs)
    assert set(model.langs) == {k for _, _, k in usable}
    got = queries.op6_language_id(spark, folder[0]).collect()
    lang, score, _, rejected = model.judge([t for _, t, _ in DOCS])
    assert sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 9), r["rejected"]) for r in got) == sorted((str(d[0]), a, round(float(b), 9), bool(c)) for d, a, b, c in zip(DOCS, lang, score, rejected))
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (200, 201, 202, 203))
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(by_id[i]["lang_pred"] == ("en", "de")[i % 2] for i in range(60)) >= 58


def test_attention_forward_and_gradient():
    rng = np.random.default_rng(23)
    counts, d = np.array([3, 1, 4]), 6
    x, labels = rng.normal(size=(8, d)), np.array([1.0, 0.0, 1.0])
    one = quality.train(x, counts, labels, rounds=1)
    p = one.parts
    y = one.forward(x, counts)[6]
    at = 0
    for bag, n in enumerate(counts):  # one document after the other, passage by passage
        h = np.tanh((x[at : at + n] - one.mean) / one.scale @ p["E"] + p["e"])
        a = np.array([(np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"] for v in h])
        a = np.exp(a) / np.exp(a).sum()
        assert abs(y[bag] - 1 / (1 + math.exp(-((a @ h) @ p["c"] + p["b"][0])))) < 1e-12
        at += n

    # a step of Adam from zero moments goes by the sign of the gradient: hold it against differences of the loss
    start = quality.train(x, counts, labels, rounds=0)

    def loss(parts):
        y = quality.MilModel(parts, start.mean, start.scale).forward(x, counts)[6]
        return -(labels * np.log(y) + (1 - labels) * np.log(1 - y)).mean()

    for name, part in start.parts.items():
        for index in itertools.islice(np.ndindex(part.shape), 0, None, max(1, part.size // 5)):
            up, down = ({k: v.copy() for k, v in start.parts.items()} for _ in range(2))
            up[name][index] += 1e-6
            down[name][index] -= 1e-6
            slope = (loss(up) - loss(down)) / 2e-6 + 1e-4 * part[index] * (name not in "eb")
            if abs(slope) > 1e-7:
                assert np.sign(start.parts[name][index] - p[name][index]) == np.sign(slope), (name, index)


def test_quality_of_held_out_documents(spark):
    sf = os.path.join(os.environ.get("TESTDATA_DIR", "/root/testdata"), "sf0.01")
    if not os.path.isdir(sf):
        pytest.skip("the tables aren't here; TESTDATA_DIR names their folder")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op1_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x == 1 and y == 0]
    assert len(held) > 50 and np.mean(pairs) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_quality_of_odd_documents(spark, folder):
    path, _ = folder
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (200, 201)}) == 1  # null is empty


def test_bins_against_all_partitions():
    lengths, rng = (4, 8, 16), np.random.default_rng(24)

    def cheapest(sizes):
        """Least total cost over all ways to share the pieces out."""
        if not sizes:
            return 0.0
        first, rest = sizes[0], sizes[1:]
        best = math.inf
        for k in range(len(rest) + 1):
            for some in itertools.combinations(range(len(rest)), k):
                held = first + sum(rest[i] for i in some)
                if held <= lengths[-1]:
                    cost = packing.cost_of(min(n for n in lengths if n >= held))
                    best = min(best, cost + cheapest([x for i, x in enumerate(rest) if i not in some]))
        return best

    ratio = []
    for _ in range(25):
        sizes = sorted(rng.integers(1, 17, 7).tolist(), reverse=True)
        where, at, final = packing.best_fit(sizes, lengths)
        ratio.append(sum(map(packing.cost_of, final)) / cheapest(sizes))
        for b in range(len(final)):
            spans = sorted((at[i], at[i] + sizes[i]) for i in range(7) if where[i] == b)
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] <= final[b]
            assert final[b] == min(n for n in lengths if n >= spans[-1][1])
    assert min(ratio) > 0.999 and max(ratio) < 1.35 and np.mean(ratio) < 1.05


def test_several_lengths_win():
    """Which lengths are opened follows what is left to fill them."""
    rng = np.random.default_rng(25)
    for sizes in (np.full(600, 1100), rng.integers(1000, 1500, 2000), rng.lognormal(6, 1, 3000).astype(int).clip(1, 8192)):
        sizes = np.sort(sizes)[::-1]
        final = packing.best_fit(sizes)[2]
        single = [sum(packing.cost_of(packing.LENGTHS[np.searchsorted(packing.LENGTHS, u)]) for u in packing._packed(sizes.tolist(), sorted(packing.LENGTHS), n)[2]) for n in packing.LENGTHS]
        assert len(set(final.tolist())) > 1 and sum(map(packing.cost_of, final)) <= min(single)


def token_pieces(rows, longest=8192):
    enc, out = bpe.encoding(RANKS, public_tokenizers.PATTERN), Counter()
    for i, t in rows:
        n = len(enc.encode_ordinary(t or ""))
        for k in range(max(1, -(-n // longest))):
            out[str(i), k, k * longest, min(n - k * longest, longest)] += 1
    return out


def check_packed(rows, packed, longest=8192):
    assert Counter((str(r["doc_id"]), r["piece"], r["start"], r["n_tokens"]) for r in packed) == token_pieces(rows, longest)
    bins = defaultdict(list)
    for r in packed:
        if r["n_tokens"]:
            bins[r["shard"], r["bin_id"]].append(r)
        else:
            assert r["bin_id"] is None
    for held in bins.values():
        held.sort(key=lambda r: r["bin_offset"])
        ends = list(itertools.accumulate(r["n_tokens"] for r in held))
        assert [r["bin_offset"] for r in held] == [0, *ends[:-1]] and ends[-1] <= held[0]["bin_length"]
        assert held[0]["bin_length"] == min(n for n in packing.LENGTHS if n >= ends[-1])


def test_packing_and_sequences(spark, folder):
    packed = queries.op3_packing(spark, folder[0]).cache()
    rows = packed.collect()
    check_packed([(i, t) for i, t, _ in DOCS], rows)
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    made = packing.sequences(docs, packed, RANKS, public_tokenizers.PATTERN, pad=50256).collect()
    assert len(made) == len({(r["shard"], r["bin_id"]) for r in rows if r["n_tokens"]})
    enc, pieces = bpe.encoding(RANKS, public_tokenizers.PATTERN), Counter()
    for s in made:
        end = 0
        for seg in s["segments"]:
            ids = s["ids"][seg["bin_offset"] : seg["bin_offset"] + seg["n_tokens"]]
            pieces[str(seg["id"]), seg["start"], tuple(ids)] += 1
            end = seg["bin_offset"] + seg["n_tokens"]
        assert set(s["ids"][end:]) <= {50256}
    want = Counter()
    for i, t, _ in DOCS:
        ids = enc.encode_ordinary(t or "")
        for a in range(0, len(ids), 8192):
            want[str(i), a, tuple(ids[a : a + 8192])] += 1
    assert pieces == want


@pytest.mark.parametrize("share", [1, 7, 8192])
def test_hot_minimisers_are_met_window_by_window(spark, monkeypatch, share):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 3)
    monkeypatch.setattr(suffix_dedup, "SHARE", share)
    rng = np.random.default_rng(26)
    word = lambda n: "".join(rng.choice(list("abcde "), n))
    shared = word(180)
    rows = [(i, word(int(rng.integers(0, 60))) + shared[int(rng.integers(0, 20)) : int(rng.integers(150, 180))] + word(int(rng.integers(0, 60)))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    met = suffix_dedup.meet(suffix_dedup.text_runs(frame.toDF("id", "text")))
    assert len(suffix_dedup.hot_minimisers(met.where("place % 2 = 0"))) > 3
    seen, want = set(), {}
    for i, t in rows:
        t = t.encode()
        mask = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                mask[p : p + 100] = True
            seen.add(t[p : p + 100])
        want[i] = hashlib.sha256(np.frombuffer(t, np.uint8)[~mask].tobytes()).hexdigest()
    got = suffix_dedup.repeated_spans(frame).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in got} == want


def test_pipeline_against_plain_stages(spark, folder):
    from test_whole_job import near_kept, without_repeats

    path, docs = folder[0], spark.read.parquet(f"{folder[0]}/documents.parquet")
    rejected = langid.learn(docs).judge([t for _, t, _ in DOCS])[3]
    rows = [(i, t) for (i, t, _), gone in zip(DOCS, rejected) if not gone]
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)].append((i, t))
    kept = []
    for same in groups.values():
        top = max((i for i, _ in same if i is not None), default=None)
        kept.append(min((x for x in same if x[0] == top), key=lambda x: hashlib.sha256(x[1].encode()).digest()))
    near = near_kept(kept)
    left = without_repeats(near)
    final = [(i, left[i, t].decode("utf-8", "ignore")) for i, t in near]
    assert len(rows) > len(kept) > len(near) and sum(len(t) for _, t in final) < sum(len(t) for _, t in near)
    check_packed(final, corpus_pipeline.run(spark, path).collect())


def test_stages_keep_the_columns_and_survive_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder[0]).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder[0]).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder[0]).count() == 0
