"""The registered queries of this package: thin wrappers that derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op2_token_counts")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from sessionloom.llm.tokens import token_counts

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_license_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from sessionloom.llm.licenses import scan_licenses

    return scan_licenses(table(spark, folder, "documents"))


@query("op6_contamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from sessionloom.llm.contamination import contamination

    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op7_mix_sources")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from sessionloom.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op8_exact_top_k", _TOP_K_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from sessionloom.llm.search import exact_top_k

    return exact_top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op1_url_filter")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from sessionloom.llm.urls import page_words, url_filter

    pages = table(spark, folder, "pages")
    return url_filter(pages, pages, page_words(F.col("html")))


@query("op9_main_text")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from sessionloom.llm.extraction import extract, train

    pages = table(spark, folder, "pages")
    return extract(pages, train(pages))


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from sessionloom.llm.toxicity import taught, toxicity

    scored = toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), learn=taught(F.col("doc_id")))
    return scored.select(
        "doc_id", (~taught(F.col("doc_id"))).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query("op10_private_data")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from sessionloom.llm.private import KINDS, all_spans, count_of, joined, private_spans

    rows, _ = private_spans(table(spark, folder, "documents"))
    counts = [count_of("base", k).alias(f"n_{k}") for k in KINDS[:4]]
    return rows.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(all_spans(F.col("base"), F.col("found"))).alias("spans"))


@query("op5_jaccard_join")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from sessionloom.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, folder, "documents"), k=3, percent=90)


# Lowest bit of the crc32 of a decimal number: bytes and then bits are folded into the register.
_EVEN_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))), 1) & 1 = 0"""


def _fields(text: str) -> str:
    columns = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(
        f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in columns) + ")"


_MANIFEST_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, {_fields('text')} AS leaf,
         CASE WHEN {_EVEN_CRC} THEN {_fields("replace(text, chr(10), '')")} END AS tampered,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY t) AS n FROM leaf),
node AS (
  SELECT t, 0 AS level, idx, n AS size, leaf AS hash FROM l
  UNION ALL
  SELECT t, level + 1, idx // 3, any_value((size + 2) // 3), sha256(string_agg(hash, '' ORDER BY idx)) FROM node WHERE size > 1
  GROUP BY t, level, idx // 3),
tops AS (SELECT t, level AS h, hash AS subroot, count(*) OVER () AS trees FROM node WHERE size = 1),
above AS (
  SELECT 0 AS level, t AS idx, trees AS size, subroot AS hash FROM tops
  UNION ALL
  SELECT level + 1, idx // 3, any_value((size + 2) // 3), sha256(string_agg(hash, '' ORDER BY idx)) FROM above WHERE size > 1
  GROUP BY level, idx // 3),
root AS (SELECT hash AS root FROM above WHERE size = 1),
every AS (SELECT t, level, idx, size, hash FROM node UNION ALL SELECT -1, level, idx, size, hash FROM above),
side AS (
  SELECT t, level, idx,
    coalesce(string_agg(hash, '') OVER (PARTITION BY t, level, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(hash, '') OVER (PARTITION BY t, level, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM every WHERE size > 1),
step AS (
  SELECT l.t, l.idx, side.level AS k, a, b FROM l JOIN side ON side.t = l.t AND side.idx = l.idx // (3 ** side.level)::BIGINT
  UNION ALL
  SELECT l.t, l.idx, tops.h + side.level, a, b FROM l JOIN tops ON tops.t = l.t JOIN side ON side.t = -1 AND side.idx = l.t // (3 ** side.level)::BIGINT),
fold AS (
  SELECT t, idx, 0 AS k, coalesce(tampered, leaf) AS acc, '' AS proof FROM l
  UNION ALL
  SELECT fold.t, fold.idx, fold.k + 1, sha256(a || acc || b), proof || a || b FROM fold JOIN step ON step.t = fold.t AND step.idx = fold.idx AND step.k = fold.k),
last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY t, idx ORDER BY k DESC) = 1)
SELECT l.doc_id, l.leaf, tops.subroot, root.root, sha256(last.proof) AS proof_sha256, last.acc AS folded_root, last.acc = root.root AS verified
FROM l JOIN last ON last.t = l.t AND last.idx = l.idx JOIN tops ON tops.t = l.t CROSS JOIN root
"""


@query("op11_merkle_manifest", _MANIFEST_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from sessionloom.llm.manifest import document_manifest, folded, proof_text, prove

    made = document_manifest(table(spark, folder, "documents"))
    proven = prove(made).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    root = F.lit(made.root)
    return proven.select(
        "doc_id", "leaf", "subroot", root.alias("root"), F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == root).alias("verified"))


@query("op12_token_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from sessionloom.llm.alignment import aligned_documents

    return aligned_documents(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


_NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS u, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
  SELECT u, vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (
  SELECT a.u AS a, b.u AS b FROM ok a JOIN ok b ON a.label = b.label AND a.u <> b.u
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT u AS a, u AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT reach.a, min(v.vec_id) AS component_id FROM reach JOIN v ON v.u = reach.b GROUP BY reach.a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(deg.n, 0) AS n_links, least.component_id, coalesce(v.vec_id = least.component_id, false) AS kept
FROM v JOIN least ON least.a = v.u LEFT JOIN deg ON deg.a = v.u
"""


@query("op13_embedding_near_dedup", _NEAR_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from sessionloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, folder, "embeddings"))
