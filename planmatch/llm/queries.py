"""The numbered queries over whole tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.llm.decontaminate import benchmark_passages
from planmatch.llm.minhash import near_sets
from planmatch.llm.packing import pack
from planmatch.llm.quality import plan_cascade, quality_cascade
from planmatch.llm.resampling import resample
from planmatch.llm.sharding import byte_shards
from planmatch.llm.simhash import near_copies
from planmatch.llm.suffix_dedup import repeated_passages
from planmatch.llm.token_cache import count_tokens
from planmatch.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity
from planmatch.llm.url_filter import Rule, filter_urls
from planmatch.llm.warc import read_archives, write_archives
from planmatch.llm.whitening import whiten
from planmatch.sources.storage import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 8
TOKEN_LIMIT = 2048
# The rules of the url query.
URL_RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(_table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    written = write_archives(_table(spark, sf_dir, "pages"), folder)
    written.write.parquet(f"{folder}/manifest.parquet")
    page = r"^<urn:x-page:(-?[0-9]+)>$"
    records = read_archives(spark, folder, payload=False)
    return records.select(
        F.regexp_extract("name", page, 1).try_cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.regexp_extract("refers_to", page, 1).try_cast("long").alias("refers_to"),
        "error",
    )


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality_cascade(docs, plan_cascade(docs), measures=measures)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(
        "doc_id", *measures, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept")
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), TOKENIZER).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("rest", 256).alias("kept_sha256"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings")).select(
        F.col("key").alias("vec_id"),
        "component",
        "n",
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
    )


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_sets(_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_shards": op2_shards,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_whitening": op11_whitening,
    "op12_minhash": op12_minhash,
    "op13_resampling": op13_resampling,
}

_OP1 = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n)
), met AS (SELECT p.doc_id, p.i, p.n, x.item FROM places p JOIN windows x ON p.n = x.n AND p.win = x.win),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS place FROM met) GROUP BY doc_id),
owned AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hit USING (doc_id) LEFT JOIN owned USING (doc_id)
"""

_OP3 = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to,
    NULL::VARCHAR AS error
FROM f
"""

_OP5 = r"""
WITH u AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
    SELECT *, CASE
        WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM s
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_OP7 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS lines FROM t),
win AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 8)
), twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS place FROM twice) GROUP BY doc_id),
m AS (
    SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
            - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
    FROM w LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
        OR word_chars > 15 * n_words OR 10 * n_dup_lines > 3 * n_lines) AS kept
FROM m
"""

_OP12 = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT row, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(
        list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), texts AS (SELECT s, min(row) AS node, min(doc_id) AS first FROM (SELECT row, doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
shingles AS (SELECT node, len(s) AS n, unnest(s) AS shingle FROM texts),
rare AS (
    SELECT node, n, shingle FROM (
        SELECT s.*, row_number() OVER (PARTITION BY node ORDER BY f.df, s.shingle) AS place
        FROM shingles s JOIN (SELECT shingle, count(*) AS df FROM shingles GROUP BY shingle) f USING (shingle))
    WHERE place <= n - (4 * n + 4) // 5 + 1
), met AS (
    SELECT DISTINCT a.node AS a, b.node AS b FROM rare a JOIN rare b USING (shingle)
    WHERE a.node < b.node AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), alike AS (
    SELECT a, b FROM (SELECT a, b, x.s AS s, y.s AS t, len(list_intersect(x.s, y.s)) AS i
        FROM met JOIN texts x ON x.node = a JOIN texts y ON y.node = b)
    WHERE 100 * i >= 80 * (len(s) + len(t) - i)
), edges AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
reach(node, other) AS (
    SELECT node, node FROM texts UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other
), least AS (SELECT r.node, min(t.first) AS component_id FROM reach r JOIN texts t ON t.node = r.other GROUP BY r.node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
    coalesce(c.component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN texts t ON list_sort(s.s) = t.s LEFT JOIN least c ON c.node = t.node
"""

ORACLE: dict[str, str] = {
    "op1_decontaminate": _OP1,
    "op3_warc": _OP3,
    "op5_url_filter": _OP5,
    "op7_quality": _OP7,
    "op12_minhash": _OP12,
}
