"""The registered queries of the training-data operators, with SQL for those that SQL can express."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import alignment, bpe, chat, embedding_dedup, exact_dedup, fingerprints, langid, packing, periodic_runs, quality, simhash, suffix_dedup, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(mod: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False)).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.learn(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", _held_out(4, 2), "score", "predicted")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return packing.pack(_read(spark, sf_dir, "documents"), count=packing.token_counts(ranks, public_tokenizers.PATTERN))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs)).select("doc_id", _held_out(5, 0), "lang_pred", "score", "rejected")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_chats(turns.unionByName(more)))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.token_digests(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def with_planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document (by the CRC-32 of its id) with their end made periodic; null ids have none."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(_read(spark, sf_dir, "documents"), rewrite=with_planted_run)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_test(_read(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = alignment.Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.alignment_digests(_read(spark, sf_dir, "documents"), names)


QUERIES = {f.__name__: f for f in (op1_quality, op2_url_filter, op3_packing, op4_embedding_dedup, op5_suffix_dedup, op6_language_id, op7_chat_format, op8_simhash_dedup, op9_exact_dedup, op10_bpe, op11_periodic_runs, op12_fingerprints, op13_alignment)}
QUERIES["pipeline"] = corpus_pipeline.run

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    # no edge is registered in the pages, so a page without a rule is allowed
    "op2_url_filter": f"""
        WITH parts AS (
            SELECT page_id,
                   CASE WHEN contains(url, '://') THEN split_part(split_part(split_part(substr(url, strpos(url, '://') + 3), '/', 1), '?', 1), '#', 1) ELSE '' END AS raw,
                   CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        cut AS (SELECT page_id, {_LOWER.format('raw')} AS host, split_part(split_part(substr(rest, length(raw) + 1), '?', 1), '#', 1) AS path FROM parts),
        rules AS (SELECT * FROM (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')) AS r(action, rule, domain, prefix)),
        best AS (
            SELECT c.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.action, length(r.rule)) AS action
            FROM (SELECT DISTINCT page_id, host, path FROM cut) c JOIN rules r ON (c.host = r.domain OR ends_with(c.host, '.' || r.domain)) AND starts_with(c.path, r.prefix)
            GROUP BY c.page_id)
        SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.action, 'allow') AS verdict FROM cut c LEFT JOIN best b USING (page_id)
    """,
    "op9_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op4_embedding_dedup": """
        WITH RECURSIVE good AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(low.b, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
    """,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
