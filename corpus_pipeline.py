"""A training-data pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's documents. All stages but the last keep the columns of documents.

1. toxicity: documents that the nearest labelled examples call toxic (score of 0.5 or more) go.
2. near_duplicates: of the documents linked by five-word shingles at a similarity of 0.8 or more, directly or over
   others, the one with the smallest id stays. Documents without words are linked with nothing and stay.
3. decontamination: documents that hold a passage of a benchmark item go.
4. private_data: personal data is replaced by its kind, and n_chars follows the text. Every document stays.
5. mixing: each document with the number of `copies` that the mix takes of it; those taken no time go.

A null text counts as empty and stays null. Rows are told apart by id and text; of rows equal in both one stays (all do
where the text has no words). A null id sorts behind all others. Any table may be empty. Further columns of documents are
carried through, whatever their names; a given column `copies` is replaced by that of the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessionloom.llm.contamination import contamination
from sessionloom.llm.jaccard import jaccard_components
from sessionloom.llm.mixing import mix_sources
from sessionloom.llm.private import all_spans, masked, private_spans
from sessionloom.llm.toxicity import scored, taught, train
from sessionloom.sources.staging import fresh_path, small, stage
from sessionloom.sources.tables import table

TOXIC_FROM = 0.5
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def row_key() -> Column:
    """A string for each (id, text) that sorts as the id does, null last."""
    signed = F.hex(F.coalesce(F.col("doc_id"), F.lit(0)).bitwiseXOR(F.lit(-(2**63))))
    return F.concat(
        F.when(F.col("doc_id").isNull(), "1").otherwise("0"), F.lpad(signed, 16, "0"),
        F.lpad(F.hex(F.xxhash64("text", F.col("text").isNull())), 16, "0"))


def _rows(docs: DataFrame) -> DataFrame:
    """(_key, _row): each row as one struct, so that no name of its columns meets an inner one."""
    return docs.select(row_key().alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose _key is not among `keys`.

    The keys are broadcast where they are few; else both sides are shuffled by Spark.
    """
    return rows.join(small(stage(keys.select("_key").distinct(), "dropped")), "_key", "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"), learn=taught(F.col("doc_id")))
    judged = scored(_rows(docs), model, text_col="_row.text", name="_judged")
    return judged.where(F.col("_judged.score") < TOXIC_FROM).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _rows(docs)
    found = stage(jaccard_components(
        keyed.select("_key", F.col("_row.text").alias("text")), SHINGLE_WORDS, SIMILAR_PERCENT, id_col="_key"), "components")
    worded = found.where("n_shingles > 0")
    left = _without(keyed, worded.where("_key <> component_id"))
    # Rows that repeat id and text: rare, and the only ones whose columns are gathered.
    again = small(stage(worded.groupBy("_key").count().where("count > 1").select("_key"), "repeats"))
    once = left.join(again, "_key", "left_anti").select("_row")
    first = left.join(again, "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(first).select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _rows(docs)
    found = contamination(
        keyed.select("_key", F.col("_row.text").alias("text")), table(spark, sf_dir, "benchmark"), id_col="_key")
    return _without(keyed, found.where("n_hit > 0")).select("_row.*")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("_rest")
    rows, _ = private_spans(docs.select("doc_id", "text", rest), carry=("text", "_rest"))
    found = F.size("base") + F.size("found") > 0
    text = F.when(found, masked(F.col("text"), all_spans(F.col("base"), F.col("found")))).otherwise(F.col("text"))
    clean = rows.select("doc_id", text.alias("text"), found.alias("_found"), "_rest")
    length = F.when(F.col("_found"), F.length("text")).otherwise(F.col("_rest.n_chars")).cast(docs.schema["n_chars"].dataType)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": length}
    return clean.select(*[own.get(c, F.col("_rest").getField(c)).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _rows(docs)
    mixed = mix_sources(
        keyed.select("_key", F.col("_row.source").alias("source"), F.col("_row.text").alias("text")), id_col="_key")
    copies = mixed.groupBy("_key").agg(F.max("copies").alias("_copies")).where("_copies > 0")
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != "copies"]
    return keyed.join(copies, "_key").select(*kept, F.col("_copies").alias("copies"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("mixing", mixing),
]

# Scores and rounding draws have no SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
