"""Labelled steps mined out of histories, without state of later steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.functions import events as E
from sessionloom.operators import keys
from sessionloom.schema import LABELS, strings

_STATE = "struct<n:int,at:int,found:array<struct<step:int,user_at:int,at:int>>>"


def walk(history: Column) -> Column:
    """(step, user_at, at) of every user message that an action answers.

    The last non-blank user message waits; the next known action answers it and takes the
    running number of actions as its step. Actions nobody asked for count as well.
    """
    known = strings(LABELS)

    def advance(state: Column, cell: Column) -> Column:
        e, i = cell["e"], cell["i"]
        speaks = F.coalesce((e["role"] == "user") & (F.trim(e["content"]) != ""), F.lit(False))
        acts = F.coalesce(F.array_contains(known, e["name"]), F.lit(False)) & ~speaks
        waiting = state["at"] >= 0
        n = state["n"] + F.when(acts, 1).otherwise(0)
        hit = F.struct(n.cast("int").alias("step"), state["at"].alias("user_at"), i.cast("int").alias("at"))
        return F.struct(
            n.cast("int").alias("n"),
            F.when(speaks, i).when(acts, -1).otherwise(state["at"]).cast("int").alias("at"),
            F.when(acts & waiting, F.concat(state["found"], F.array(hit))).otherwise(state["found"]).alias("found"),
        )

    start = F.struct(
        F.lit(0).alias("n"), F.lit(-1).alias("at"),
        F.array().cast("array<struct<step:int,user_at:int,at:int>>").alias("found"),
    ).cast(_STATE)
    cells = F.transform(E.items(history), lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    return F.aggregate(cells, start, advance, lambda s: s["found"])


def observations(rows: DataFrame) -> DataFrame:
    """One row per mined pair: root, step, prompt, action, indexes and the source row's id.

    rows: id, row_no, history.
    """
    found = rows.where(F.coalesce("id", F.lit("")) != "").select(
        "id", "row_no", "history", F.explode_outer(walk(F.col("history"))).alias("p")
    ).where(F.col("p").isNotNull())
    event = F.get("history", F.col("p.at"))
    return found.select(
        F.col("id").alias("source_id"), "row_no", F.size("history").alias("window"),
        keys.root_session(F.col("id")).alias("root"), F.col("p.step").alias("step"), F.col("p.user_at").alias("user_at"),
        F.col("p.at").alias("source_event_index"),
        F.trim(F.get("history", F.col("p.user_at"))["content"]).alias("prompt"),
        event["name"].alias("action"), E.event_signature(event).alias("source_event_signature"),
    )


def consolidate(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per (root, step) with its verdict: conflict, overlap, mismatch or mined.

    Differing labels or prompts make a conflict. A key with a known label is only checked.
    Otherwise the observation from the shortest history counts (first in source order on
    ties). All of it is one map-side combined aggregate: a key seen in a third of the rows
    still reduces before it travels. known: id, action (known labels).
    """
    pick = F.struct("window", "row_no", "source_id", "user_at", "source_event_index", "source_event_signature", "prompt")
    grouped = pairs.groupBy("root", "step").agg(
        F.count("*").alias("observed"),
        F.min("action").alias("action"), F.max("action").alias("_action_hi"),
        F.min(F.md5("prompt")).alias("_prompt_lo"), F.max(F.md5("prompt")).alias("_prompt_hi"),
        F.min(pick).alias("best"),
    )
    keyed = grouped.withColumn("id", F.concat("root", F.lit("-step_"), F.format_string("%02d", F.col("step"))))
    labelled = keyed.join(known.select("id", F.col("action").alias("known")), "id", "left")
    conflict = (F.col("action") != F.col("_action_hi")) | (F.col("_prompt_lo") != F.col("_prompt_hi"))
    verdict = (
        F.when(conflict, "conflict")
        .when(F.col("known").isNull(), "mined")
        .when(F.col("known") == F.col("action"), "overlap")
        .otherwise("mismatch")
    )
    return labelled.select("id", "root", "step", "action", "observed", "known", verdict.alias("verdict"), "best.*")


def mined_rows(consolidated: DataFrame, rows: DataFrame, keep_dynamic: bool = False) -> DataFrame:
    """Session rows of the mined keys: earlier events only, stable metadata only.

    rows: id, row_no, history, session_meta.
    """
    picked = consolidated.where(F.col("verdict") == "mined")
    source = rows.select(F.col("id").alias("source_id"), "row_no", "history", "session_meta")
    return picked.join(source, ["source_id", "row_no"]).select(
        "id",
        F.col("prompt").alias("current_prompt"),
        F.slice("history", F.lit(1), F.col("user_at")).alias("history"),
        keys.stable_meta(F.col("session_meta"), keep_dynamic).alias("session_meta"),
        F.struct(
            "source_id", "source_event_index", "source_event_signature", F.lit(keep_dynamic).alias("dynamic_meta_preserved")
        ).alias("mining_meta"),
        "action",
    )


def mining_report(consolidated: DataFrame, rows: DataFrame, strict: bool = False) -> DataFrame:
    """One row of counts; with strict, a mismatch against known labels is an error."""
    is_ = lambda *v: F.count_if(F.col("verdict").isin(*v))
    counts = consolidated.agg(
        F.count("*").alias("candidate_keys"),
        is_("mined").alias("mined_rows"),
        is_("conflict", "mismatch").alias("conflict_keys"),
        is_("conflict").alias("label_or_prompt_conflicts"),
        is_("overlap", "mismatch").alias("overlap_checked"),
        is_("mismatch").alias("overlap_mismatches"),
        F.lit(1).alias("_one"),
    )
    total = rows.agg(F.count("*").alias("source_rows"), F.lit(1).alias("_one"))
    out = total.join(counts, "_one").drop("_one")
    if strict:
        bad = F.raise_error(F.lit("mined labels differ from known ones"))
        out = out.withColumn(
            "overlap_mismatches", F.when(F.col("overlap_mismatches") == 0, F.col("overlap_mismatches")).otherwise(bad)
        )
    return out
