import hashlib

import numpy as np
import public_tokenizers
import pytest

from tidemill.llm import bpe, chat, embedding_dedup, exact_dedup, langid, packing, quality, simhash, suffix_dedup, url_filter
from tidemill.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 97}x{i}" for i in range(4000))
    return docs(spark, [(1, None), (2, ""), (3, "Ab c"), (4, "aB C"), (4, "aB C"), (5, long), (6, long + " end"), (7, "!!! 123"), (None, "lost")])


def test_edge_cases_and_empty_tables(spark, odd):
    empty = odd.limit(0)
    model = langid.learn(empty)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    scorer = quality.learn(empty, spark.createDataFrame([], "doc_id long, quality int"))
    for f in (exact_dedup.exact_dedup, simhash.simhash_components, suffix_dedup.repeated_spans, packing.pack, lambda d: langid.identify(d, model), lambda d: quality.score(d, scorer), lambda d: bpe.token_digests(d, ranks, public_tokenizers.PATTERN)):
        assert f(odd).count() >= 9 and f(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(odd).columns == odd.columns


def test_exact_dedup_splits_heavy_hitters(spark):
    texts = [(i, "HOT" if i % 3 == 0 else f"t{i // 2}") for i in range(300)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, texts), k=4).collect()}
    for i, t in texts:
        same = [j for j, u in texts if u.lower() == t.lower()]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))


def test_suffix_dedup_against_brute_force(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared, texts = word(150), []
    for i in range(25):
        texts.append((i, word(int(rng.integers(0, 80))) + (shared[: int(rng.integers(90, 150))] if i % 2 else "") + word(30) + "z" * int(rng.integers(0, 220))))
    got, seen = {r["doc_id"]: r for r in suffix_dedup.repeated_spans(docs(spark, texts)).collect()}, set()
    for i, t in texts:
        t, mask = t.encode(), None
        mask = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            if w in seen:
                mask[p : p + 100] = True
            seen.add(w)
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == mask.sum()


def test_suffix_order_sorts_like_python():
    rng = np.random.default_rng(2)
    w = rng.integers(97, 99, (400, 100), np.uint8)
    w[:, :40] = 97
    w[200:] = w[:200]
    order, new = suffix_dedup.suffix_order(w)
    rows = [w[i].tobytes() for i in order]
    assert rows == sorted(rows) and [bool(x) for x in new[1:]] == [a != b for a, b in zip(rows, rows[1:])]


def test_simhash_forest_connects_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, np.uint64)
    prints = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40)]))[:, None]
    a, b = simhash.forest(prints, 3, 5)
    near = np.bitwise_count(prints[:, 0][:, None] ^ prints[:, 0][None, :]) <= 3
    label = list(range(len(prints)))
    for x, y in zip(a, b):
        assert near[x, y]
        old, new = label[y], label[x]
        label = [new if k == old else k for k in label]
    assert all(label[x] == label[y] for x, y in zip(*np.nonzero(near)))


def test_wide_fingerprints_find_near_copies(spark):
    rng = np.random.default_rng(4)
    text = [f"w{rng.integers(10**6)}" for _ in range(300)]
    copy, other = list(text), [f"w{rng.integers(10**6)}" for _ in range(300)]
    copy[100] = "changed"
    kept = simhash.drop_near_duplicates(docs(spark, [(1, " ".join(text)), (2, " ".join(copy)), (3, " ".join(other))]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_contracted_links_keep_components(spark):
    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2)) if a != b]
    label = list(range(300))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if k in (x, y) else k for k in label]
    made = simhash.contracted(spark.createDataFrame(links, "a long, b long"))
    got = {r["node"]: r["component"] for r in connected_components(made).collect()}
    assert [got.get(i, i) for i in range(300)] == label
    a, b = simhash.contracted_pairs(*np.array(links).T)
    assert len(a) <= len(links)
    got = list(range(300))
    for x, y in zip(a, b):
        got = [min(got[x], got[y]) if k in (got[x], got[y]) else k for k in got]
    assert got == label
    x, y = np.triu_indices(40, 1)  # all pairs of a group leave a star
    assert [len(c) for c in simhash.contracted_pairs(x, y)] == [39, 39]
    assert [len(c) for c in simhash.contracted_pairs(x[:0], y[:0])] == [0, 0]


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    x[60:] = x[:60] + rng.normal(scale=0.2, size=(60, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, x[0].tolist())]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), chunk=50).collect()}
    ids = [i for i in range(120)] + [203]
    u = np.concatenate([x, x[:1]]).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    low = np.array(ids)
    for _ in ids:
        low = np.minimum(low, np.where(hit, low[None, :], 10**9).min(1))
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"]) == (hit[k].sum(), low[k])
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (200, 201, 202))


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "a\\<|end|>\\\\b", "", None, "<|turn|>é"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert chat.parse(made["formatted"]) == [(r, t or "") for _, _, r, t in rows]
    assert "</s>" not in made["formatted"]
    learned = [chat.unescape(made["formatted"][s["start"] : s["end"]]) for s in made["loss_spans"]]
    assert learned == [said[1], ""]


def test_bpe_pieces_are_safe():
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    text = "It's  a test,\n\n  don't\t split 12 345 !!!  é ü\x1c. " * 40
    parts = bpe.safe_pieces(text, 37)
    whole = bpe.encoding(ranks, public_tokenizers.PATTERN).encode_ordinary(text)
    assert len(parts) > 5 and [i for p in parts for i in bpe.encoding(ranks, public_tokenizers.PATTERN).encode_ordinary(p)] == whole
    assert bpe.decode(whole, ranks, public_tokenizers.PATTERN) == text.encode()


def test_url_rules_and_aliases(spark):
    pages = [(1, "http://a.net/x", ""), (2, "http://example.net/en/1", ""), (3, "HTTP://Q.Example.COM/de/", '<link rel="canonical" href="http://free.io/a">'), (4, "http://free.io/a", ""), (5, None, None), (6, "nothing", ""), (7, "http://b.org/fr/?x", '<meta http-equiv="refresh" content="0; url=http://a.net/x">'), (8, "http://other.io/", '<link href="http://a.net/x" rel="canonical">')]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == ("net/", "block") and got[2] == ("example.net/en/", "allow")
    assert got[3] == ("example.com/de/", "block") and got[4] == (None, "block")
    assert got[5] == got[6] == (None, "allow") and got[7] == ("org/fr/", "allow")
    assert got[8] == (None, "allow")  # its component holds an explicit allow


def test_best_fit_holds_everything():
    rng = np.random.default_rng(6)
    sizes = np.sort(rng.integers(0, 8193, 500))[::-1]
    where, at, final = packing.best_fit(sizes)
    for b in range(len(final)):
        inside = where == b
        assert sizes[inside].sum() <= final[b] and sorted(at[inside][sizes[inside] > 0])[0:1] in ([0], [])
    assert set(final) <= set(packing.LENGTHS) and sizes.sum() / final.sum() > 0.9


def test_models_learn():
    samples = {"aa": ["the cat sat on the mat and the dog ran off"] * 10, "bb": ["der hund und die katze sind nicht im haus"] * 10}
    model = langid.fit(samples)
    lang, score, _, rejected = model.judge(["the dog and the cat", "die katze und der hund", "123", None])
    assert lang == ["aa", "bb", "und", "und"] and list(rejected) == [False, False, True, True] and 0 <= score.min() <= score.max() <= 1
    texts = [b"plain words of prose. " * 20, b"BUY!! NOW!! *** ### " * 20] * 20
    x, counts = quality.encode_passages(texts)
    scorer = quality.train(x, counts, np.array([1.0, 0.0] * 20), rounds=100)
    good, bad = scorer.scores(texts[:2])
    assert good > 0.9 and bad < 0.1


def linked_pages():
    """Pages whose links are relative, quoted, without quotes, with character references, behind comments, and chained; every third has a rule."""
    link = lambda t: f'<head><link rel="canonical" href="{t}"></head>'
    refresh = lambda t: f'<meta http-equiv="refresh" content="{t}">'
    hosts = ("free.io", "a.net", "q.example.net", "x.org", "shop.example.com", "HTTP.io")
    forms = (lambda h, k: link(f"http://{h}/p{k}"), lambda h, k: link(f"//{h}/p{k}"), lambda h, k: link(f"/p{k}"), lambda h, k: link(f"p{k}"), lambda h, k: link(f"../d/../p{k}"), lambda h, k: refresh(f"0; url='http://{h}/p{k}'"), lambda h, k: refresh(f"5;URL=HTTP://{h.upper()}/p{k}#top"), lambda h, k: link(f"http://{h}/p{k}?a=1&amp;b=2"), lambda h, k: f"<LINK href=/p{k} REL='alternate canonical'>", lambda h, k: refresh(f"0;url=&quot;/p{k}&quot;"), lambda h, k: f"<!-- {link(f'http://a.net/p{k}')} -->", lambda h, k: refresh("30"), lambda h, k: link("mailto:me@a.net"), lambda h, k: "")
    rng, rows = np.random.default_rng(12), []
    for i in range(240):
        host, k = hosts[int(rng.integers(len(hosts)))], int(rng.integers(120))
        url = f"http://{host}/{('en/', 'de/', 'fr/', '')[int(rng.integers(4))]}p{i % 120}" + ("?a=1&b=2" if i % 11 == 0 else "")
        rows.append((i, url, forms[i % len(forms)](hosts[int(rng.integers(len(hosts)))], k)))
    return rows + [(1000, None, link("/x")), (1001, "nothing", link("http://a.net/x")), (1001, "nothing", None), (1002, "http://free.io/p1", None)]


def test_url_aliases_against_brute_force(spark):
    import html as entities
    import re
    from urllib.parse import urldefrag, urljoin, urlsplit

    def parts(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    def ruled(url):
        host, path = parts(url)
        fits = [(len(r), a, r) for a, r in url_filter.RULES for d, p in [r.split("/", 1)] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
        return max(fits)[1:] if fits else (None, None)

    def spelt(url):
        s = urlsplit(urldefrag(url)[0])
        return s._replace(scheme=s.scheme.lower(), netloc=s.netloc.lower()).geturl()

    rows, up = linked_pages(), {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, url, page in rows:
        for tag in re.findall(r"(?is)<(?:link|meta)[^>]*>", re.sub(r"(?s)<!--.*?-->", "", page or "")):
            target = None
            if re.search(r"(?i)canonical", tag):
                target = re.search(r"""(?i)href=["']?([^"'\s>]+)""", tag)[1]
            elif "refresh" in tag:
                found = re.search(r"""(?i)url=["']?([^"'>]+)""", entities.unescape(re.search(r'content="([^"]*)"', tag)[1]))
                target = found and found[1]
            if target and url and "://" in url and not target.startswith("mailto:"):
                a, b = sorted((find(spelt(url)), find(spelt(urljoin(url, entities.unescape(target))))))
                up[b] = a
    want = {}
    for i, url, _ in rows:
        action = ruled(url)[0]
        if action is None:
            members = [ruled(x)[0] for x in list(up) if url and "://" in url and find(x) == find(spelt(url))]
            action = "allow" if "allow" in members or "block" not in members else "block"
        want[i, url] = (ruled(url)[1], action)
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    urls = {i: url for i, url, _ in rows}
    assert len(got) == len(rows) and {(r["page_id"], urls[r["page_id"]]): (r["rule"], r["verdict"]) for r in got} == want
    inherited = sum(rule is None and verdict == "block" for rule, verdict in want.values())
    assert inherited > 10 and sum(rule is None and verdict == "allow" for rule, verdict in want.values()) > 10


def test_embeddings_with_repeated_and_null_ids(spark):
    near = lambda a, b: [float(np.cos(a)), float(np.sin(a)), float(b)]
    rows = [(1, near(0, 0)), (1, near(np.pi / 2, 0)), (2, near(np.pi / 2 + 0.1, 0)), (3, near(np.pi / 2 - 0.1, 0)), (None, near(np.pi, 0)), (None, near(-np.pi / 2, 0)), (4, near(np.pi + 0.1, 0)), (5, None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 1, 4, False), (None, 0, None, True), (4, 1, 4, True), (5, 0, 5, True)], key=str)
