"""Session, label, batch and parameter files: readers with their checks, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessionloom.operators import joins
from sessionloom.schema import LABELS, SESSION, strings

BOM = "\ufeff"
LABEL_NAMES = ("label", "action", "target", "next_action")


def read_sessions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSON lines with the session schema; blank lines are skipped.

    strict: a line that is no JSON object fails the read.
    """
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(SESSION).option("mode", mode).json(path)


def write_sessions(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_labels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(id, action) from CSV with a header; a byte-order mark is ignored.

    strict: a label outside the 14 is an error.
    """
    raw = spark.read.option("header", True).csv(path)
    named = raw.toDF(*[c.lstrip(BOM) for c in raw.columns])
    id_col, label_col = label_columns(named.columns)
    labels = named.select(F.col(id_col).alias("id"), F.col(label_col).alias("action"))
    if not strict:
        return labels
    known = F.array_contains(strings(LABELS), F.col("action"))
    return labels.withColumn(
        "action", F.when(known, F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), "action")))
    )


def label_columns(columns: list[str]) -> tuple[str, str]:
    """Id column and label column of a label table, from its column names."""
    id_col = "id" if "id" in columns else "sample_id"
    if id_col not in columns:
        raise ValueError(f"no id column among {columns}")
    for name in LABEL_NAMES:
        if name in columns:
            return id_col, name
    others = [c for c in columns if c != id_col]
    if len(others) != 1:
        raise ValueError(f"cannot tell the label column among {columns}")
    return id_col, others[0]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a fold manifest: JSON lines by extension, CSV otherwise."""
    if path.rstrip("/").endswith(".jsonl"):
        return spark.read.schema("id string").json(path)
    raw = spark.read.option("header", True).csv(path)
    named = raw.toDF(*[c.lstrip(BOM) for c in raw.columns])
    if "id" not in named.columns:
        raise ValueError(f"{path} has no id column")
    return named.select("id")


def label_report(labels: DataFrame) -> DataFrame:
    """Rows per label and whether the label is one of the 14."""
    return labels.groupBy("action").agg(F.count("*").alias("n")).withColumn(
        "known", F.array_contains(strings(LABELS), F.col("action"))
    )


def write_csv(df: DataFrame, path: str) -> None:
    """All values quoted, header with a byte-order mark in front of the first name."""
    first = df.columns[0]
    df.withColumnRenamed(first, BOM + first).write.option("header", True).option("quoteAll", True).csv(path)


def write_batches(rows: DataFrame, path: str, suffix: str = "") -> None:
    """One folder batch_NNN<suffix>.csv per batch number, written by all tasks at once."""
    named = rows.withColumn("file", F.concat(F.lit("batch_"), F.format_string("%03d", "batch"), F.lit(f"{suffix}.csv")))
    named.drop("batch").write.mode("append").partitionBy("file").option("header", True).option("quoteAll", True).option(
        "escape", '"'
    ).csv(path)


def read_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(batch rows, paraphrased batch rows); the number comes from the file name."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"batch_(\d+)(_para)?\.csv", 1).try_cast("int")

    def read(schema: str, pattern: str) -> DataFrame:
        raw = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option(
            "recursiveFileLookup", True
        ).csv(f"{path}/{pattern}")
        return raw.select(name.alias("batch"), "*")

    columns = "idx long, id string, action string, original string"
    return (
        read(columns, "*batch_[0-9][0-9][0-9].csv"),
        read(columns + ", paraphrase string", "*batch_[0-9][0-9][0-9]_para.csv"),
    )


def write_oof(rows: DataFrame, path: str) -> None:
    """Out-of-fold table (id, session, fold, y_true, model, proba), one folder per model and fold.

    A row without fold is refused.
    """
    checked = rows.withColumn("fold", joins.require(F.col("fold"), "row without fold", F.col("id")))
    checked.write.partitionBy("model", "fold").parquet(path)


def read_oof(spark: SparkSession, path: str) -> DataFrame:
    """Union of the fold folders; model and fold come from the folder names and prune the scan."""
    return spark.read.parquet(path)


def duplicate_ids(oof: DataFrame) -> DataFrame:
    """Ids that more than one shard of a model holds; must be empty."""
    return oof.groupBy("model", "id").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def unique_rows(oof: DataFrame) -> DataFrame:
    """The table with a failure on any id held twice by a model."""
    counted = oof.groupBy("model", "id").agg(
        F.count("*").alias("_n"), F.max(F.struct("fold", "y_true", "proba")).alias("r")
    )
    once = F.when(F.col("_n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("duplicate id: "), "id")))
    return counted.select("model", once.alias("id"), "r.*")


def class_index(truth: Column, classes: list[str] = LABELS) -> Column:
    """Truth given as class name or as index text."""
    named = F.array_position(strings(classes), truth)
    return F.when(named > 0, (named - 1).cast("int")).otherwise(truth.try_cast("int"))


def write_report(report: DataFrame, path: str) -> None:
    """A small report as JSON lines."""
    report.coalesce(1).write.json(path)


def read_parameters(spark: SparkSession, path: str, classes: list[str] = LABELS) -> DataFrame:
    """(label, bias_sim, bias_au) from a parameter file whose label order must equal the given one."""
    raw = spark.read.schema("labels array<string>, bias_sim array<double>, bias_au array<double>").option(
        "multiLine", True
    ).json(path)
    same = F.when(F.col("labels") == strings(classes), F.col("labels")).otherwise(
        F.raise_error(F.lit("label order of the parameter file differs"))
    )
    zipped = F.explode_outer(F.arrays_zip(same.alias("label"), F.col("bias_sim"), F.col("bias_au"))).alias("z")
    return raw.select(zipped).select(
        F.col("z.label").alias("label"), F.col("z.bias_sim").alias("bias_sim"), F.col("z.bias_au").alias("bias_au")
    )
