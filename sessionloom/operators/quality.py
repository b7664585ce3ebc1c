"""Paraphrase checks (two rule sets), reports, assembly and resumable merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.functions import scalars as S
from sessionloom.functions.text import SPACE, as_text, collapse, has_hangul
from sessionloom.operators import joins
from sessionloom.sources.staging import small, stage


def _reasons(**tests: Column) -> Column:
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


def check_v1(df: DataFrame) -> DataFrame:
    """First rule set: white space collapsed, case ignored, lost tokens named in the reason.

    df: original, paraphrase, action. An empty paraphrase fails at once.
    """
    df = df.withColumns({"_o": collapse(F.col("original")), "_p": collapse(F.col("paraphrase"))})
    df = df.withColumns({
        "_deixis": S.missing_in(S.deixis_terms(F.col("_o")), F.col("_p")),
        "_files": S.missing_in(S.file_tokens(F.col("_o")), F.col("_p")),
        "_ticks": S.missing_in(S.backtick_tokens(F.col("_o")), F.col("_p")),
        "n_sentences": S.sentences_protected(F.col("_p")),
        "action_kept": S.action_words_kept(F.col("action"), F.col("_p")),
        "len_ratio": S.length_ratio(F.col("_o"), F.col("_p")),
    })
    o, p = F.col("_o"), F.col("_p")
    named = lambda name, col: F.when(
        F.size(col) > 0, F.concat(F.lit(f"{name}:"), F.array_join(col, "|"))
    )
    hard = F.array_compact(F.array(
        F.when(F.lower(o) == F.lower(p), "same_text"),
        F.when(~S.length_kept(o, p), "len_ratio"),
        F.when(has_hangul(o) != has_hangul(p), "language_mismatch"),
        named("missing_deixis", "_deixis"),
        named("missing_filetok", "_files"),
        named("missing_backtick", "_ticks"),
        F.when(F.col("n_sentences") > 3, "too_many_sentences"),
    ))
    empty = p == ""
    df = df.withColumn("_hard", hard)
    soft = F.when(~F.col("action_kept"), F.array(F.lit("action_risk"))).otherwise(F.array().cast("array<string>"))
    every = F.concat("_hard", soft)
    return df.withColumns({
        "qc": F.when(~empty & (F.size("_hard") == 0), "OK").otherwise("FAIL"),
        "qc_reason": F.when(empty, "empty").when(F.size(every) == 0, "OK").otherwise(F.array_join(every, ";")),
        "len_ratio": F.when(empty, 0.0).otherwise(F.col("len_ratio")),
        "deixis_kept": ~empty & (F.size("_deixis") == 0),
        "filetok_kept": ~empty & (F.size("_files") == 0),
        "backtick_kept": ~empty & (F.size("_ticks") == 0),
        "action_kept": ~empty & F.col("action_kept"),
        "sentence_count": F.when(empty, 0).otherwise(F.col("n_sentences")),
    }).drop("_o", "_p", "_deixis", "_files", "_ticks", "_hard", "n_sentences")


def check_v2(df: DataFrame) -> DataFrame:
    """Second rule set: exact text, control characters, token subsets; reasons joined by '|'."""
    o, p = as_text(F.col("original")), as_text(F.col("paraphrase"))
    lost = F.size(S.missing_in(S.deixis_terms(o), p)) > 0
    df = df.withColumns({
        "deixis_kept": ~lost,
        "filetok_kept": S.subset_kept(S.FILE_TOKEN, o, p),
        "backtick_kept": S.subset_kept(S.BACKTICK, o, p, 1),
        "lang_kept": has_hangul(o) == has_hangul(p),
        "action_kept": S.action_pattern_kept(F.col("action"), p),
        "len_ratio": S.length_ratio(o, p),
    })
    hard = _reasons(
        empty=~p.rlike(f"[^{SPACE}]"),
        same_text=p == o,
        control_char=p.rlike(r"[\n\r\t]"),
        deixis_lost=~F.col("deixis_kept"),
        filetok_lost=~F.col("filetok_kept"),
        backtick_lost=~F.col("backtick_kept"),
        lang_mismatch=~F.col("lang_kept"),
        len_ratio=~S.length_kept(o, p),
        too_many_sentences=S.sentences_masked(p) > 3,
    )
    df = df.withColumn("hard_reasons", hard)
    soft = F.when(~F.col("action_kept"), F.array(F.lit("action_risk"))).otherwise(F.array().cast("array<string>"))
    every = F.concat("hard_reasons", soft)
    return df.withColumns({
        "qc": F.when(F.size("hard_reasons") == 0, "OK").otherwise("REJECT"),
        "qc_reason": F.when(F.size(every) == 0, "OK").otherwise(F.array_join(every, "|")),
    })


def report(checked: DataFrame, whole_reason: bool) -> DataFrame:
    """(section, name, n): accepted and rejected rows, reject reasons, actions of both.

    whole_reason: count the full reason text of a rejected row; otherwise each hard reason.
    One count over (qc, action, reasons), then count-table work.
    """
    reasons = F.array("qc_reason") if whole_reason else F.col("hard_reasons")
    counts = checked.groupBy("qc", "action", reasons.alias("reasons")).agg(F.count("*").alias("n"))
    ok = F.col("qc") == "OK"
    cell = lambda section, name: F.struct(F.lit(section).alias("section"), name.alias("name"))
    always = F.array(
        cell("all", F.lit("generated")),
        F.when(ok, cell("all", F.lit("accepted"))).otherwise(cell("all", F.lit("rejected"))),
        F.when(ok, cell("accepted_action", F.col("action"))).otherwise(cell("rejected_action", F.col("action"))),
    )
    why = F.when(~ok, F.transform("reasons", lambda r: cell("reject_reason", r))).otherwise(
        F.array().cast("array<struct<section:string,name:string>>")
    )
    flat = counts.select(F.explode_outer(F.concat(always, why)).alias("c"), "n")
    return flat.groupBy("c.section", "c.name").agg(F.sum("n").alias("n"))


_SAME = ["id", "action", "original"]


def batch_verdicts(base: DataFrame, para: DataFrame) -> DataFrame:
    """(batch, rows, para_rows, valid), staged; texts are compared by their SHA-256, so none of them travels.

    A batch is valid only when both files hold the same rows. Verdicts are one map-side combined aggregate, so a
    large batch is no task of its own.
    """
    narrow = lambda df, p: df.select("batch", "idx", *[
        F.unhex(F.sha2(F.col(c), 256)).alias(f"{p}_{c}") if c == "original" else F.col(c).alias(f"{p}_{c}") for c in _SAME
    ], F.lit(1).alias(f"in_{p}"))
    rows = narrow(base, "b").join(narrow(para, "p"), ["batch", "idx"], "full")
    equal = F.lit(True)
    for c in _SAME:
        equal = equal & F.col(f"b_{c}").eqNullSafe(F.col(f"p_{c}"))
    verdict = rows.groupBy("batch").agg(
        F.count("in_b").alias("rows"),
        F.count("in_p").alias("para_rows"),
        F.bool_and(equal & F.col("in_b").isNotNull() & F.col("in_p").isNotNull()).alias("valid"),
    )
    return stage(verdict, "batch-verdicts")


def pair_batches(base: DataFrame, para: DataFrame) -> DataFrame:
    """Rows of both files side by side with the verdict of their batch, see `batch_verdicts`.

    base: batch, idx, id, action, original; para: the same plus paraphrase. Batches without a second file are skipped.
    """
    left = base.select("batch", "idx", *[F.col(c).alias(f"b_{c}") for c in _SAME], F.lit(1).alias("in_base"))
    right = para.select("batch", "idx", *[F.col(c).alias(f"p_{c}") for c in _SAME], "paraphrase", F.lit(1).alias("in_para"))
    rows = left.join(right, ["batch", "idx"], "full")
    return rows.join(small(batch_verdicts(base, para)), "batch").where(F.col("para_rows") > 0)


def valid_rows(base: DataFrame, para: DataFrame) -> DataFrame:
    """The rows of `pair_batches` of valid batches, taken from the second file alone: there both files hold the same rows."""
    verdict = small(batch_verdicts(base, para).where("valid AND para_rows > 0"))
    return para.select("batch", "idx", *[F.col(c).alias(f"b_{c}") for c in _SAME], "paraphrase").join(verdict, "batch")


def assemble(paired: DataFrame, labels: DataFrame, sessions: DataFrame) -> DataFrame:
    """Checked rows of valid batches, with the source row each accepted one replaces.

    A label that differs from the label table or an id without source row is an error.
    """
    rows = paired.where("valid").select(
        "batch", "idx", F.col("b_id").alias("id"), F.col("b_action").alias("action"), F.col("b_original").alias("original"),
        F.trim("paraphrase").alias("paraphrase"),
    )
    known = joins.join_strict(rows, labels.withColumnRenamed("action", "_label"), "id", "_label", "no label for id")
    agreed = known.withColumn(
        "action",
        F.when(F.col("_label") == F.col("action"), F.col("action")).otherwise(
            F.raise_error(F.concat(F.lit("label differs: "), "id"))
        ),
    ).drop("_label")
    return check_v2(joins.join_strict(agreed, sessions, "id", "source", "no source row for id"))


def pending(rows: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Rows not reviewed yet."""
    return rows.join(reviewed.select("id"), "id", "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace existing ones of the same key. Keys are unique on each side."""
    kept = existing.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def merge_resume(accepted: DataFrame, review: DataFrame, newly_checked: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted set and review table after a further batch, each with its source position.

    A newly rejected row leaves the accepted set; output order is the source's row_no.
    """
    all_reviews = upsert(review, newly_checked.select("id", "qc", "qc_reason", "paraphrase"))
    ok = newly_checked.where(F.col("qc") == "OK").select("id", "paraphrase")
    kept = accepted.join(newly_checked.select("id"), "id", "left_anti").unionByName(ok)
    place = source.select("id", "row_no")
    return kept.join(place, "id"), all_reviews.join(place, "id")
