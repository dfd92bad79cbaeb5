"""The operators' queries over the supplied tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import binary_ids, line_dedup, minhash, mixing, packing, quality, simhash, topk, url_filter, viterbi
from flowmill.llm.shared import scratch_path

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: The list of URLs that the query is given: pages of these sites by number, all but each third. Most
#: are no page of the table, and the table has pages of these sites that aren't listed.
LISTED_HOSTS = [f"{name}.example.{end}" for name in ("spam-farm", "cheap-pills", "blog.cheap-pills") for end in ("com", "net", "org")]
LISTED_PATHS, LISTED_NUMBERS = ["/en/", "/de/", "/fr/", "/es/"], 10_000


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op4_binary_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_ids.round_trip(table(spark, sf_dir, "documents"), scratch_path(spark, "ids"), vocabulary(WORD_BPE))


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(found["fp"]).alias("fingerprint"), "component_id")


def op9_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def listed_urls(spark: SparkSession) -> DataFrame:
    numbers = spark.range(LISTED_NUMBERS).where("id % 3 <> 0")
    starts = F.explode(F.array(*[F.lit(h + p) for h in LISTED_HOSTS for p in LISTED_PATHS]))
    return numbers.withColumn("start", starts).select(F.concat("start", F.col("id").cast("string")).alias("listed"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), listed_urls(spark), URL_RULES)


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.token_counts(table(spark, sf_dir, "documents"), viterbi.zipf_scores(vocabulary(PIECES)))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("removed_lines").alias("n_removed"), "removed_lines", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_binary_token_ids": op4_binary_token_ids,
    "op5_url_filters": op5_url_filters,
    "op6_mixing_sources": op6_mixing_sources,
    "op7_token_counts": op7_token_counts,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_minhash_fingerprints": op9_minhash_fingerprints,
    "op10_simhash_near_duplicates": op10_simhash_near_duplicates,
}

OP5_SQL = r"""
WITH parts AS (
    SELECT page_id,
        coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), keyed AS (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[\s\S]*@', ''), ':(80|443)?$', ''), '^www\.', '')
        || rtrim(url_decode(replace(path, '+', '%2B')), '/') AS canonical FROM parts
), listed AS (
    SELECT h.host || p.path || n.id AS canonical
    FROM (VALUES ('spam-farm.example.com'), ('spam-farm.example.net'), ('spam-farm.example.org'), ('cheap-pills.example.com'), ('cheap-pills.example.net'), ('cheap-pills.example.org'), ('blog.cheap-pills.example.com'), ('blog.cheap-pills.example.net'), ('blog.cheap-pills.example.org')) h(host),
        (VALUES ('/en/'), ('/de/'), ('/fr/'), ('/es/')) p(path), range(10000) n(id)
    WHERE n.id % 3 <> 0
), rules(verdict, rule_host, rule_path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fitting AS (
    SELECT k.page_id, k.host, k.path, k.canonical, r.rule_host || r.rule_path AS rule, r.verdict
    FROM keyed k LEFT JOIN rules r
        ON (k.host = r.rule_host OR suffix(k.host, '.' || r.rule_host)) AND starts_with(k.path, r.rule_path)
    QUALIFY row_number() OVER (PARTITION BY k.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) = 1
)
SELECT f.page_id, f.host, f.path, f.rule,
    coalesce(f.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM fitting f LEFT JOIN listed l ON f.canonical = l.canonical
"""

ORACLE_SQL: dict[str, str] = {"op5_url_filters": OP5_SQL}
