"""Blending, class bias, shrink selection and bounded tie-breaks on probability columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.functions.probs import add, argmax, log_clipped, margin, mix, normalise, softmax
from sessionloom.operators import metrics
from sessionloom.sources.staging import stage
from sessionloom.schema import CLASS_BIAS_AU, CLASS_BIAS_SIM, STACK, doubles


# Score differences below this are summation noise, not a gain.
GAIN = 1e-12


def blend(p: Column, q: Column, weight_p, weight_q) -> Column:
    return normalise(mix(p, q, weight_p, weight_q))


def biased(p: Column, bias: Column) -> Column:
    """Log-probabilities plus a bias vector."""
    return add(log_clipped(p), bias)


def apply_bias(p: Column, bias: Column) -> Column:
    return softmax(biased(p, bias))


def base_decision(
    scores: DataFrame,
    k: int,
    sim_weights: Sequence[float] = STACK["sim_weights"],
    au_weights: Sequence[float] = STACK["au_weights"],
    sim_bias: Sequence[float] = CLASS_BIAS_SIM,
    au_bias: Sequence[float] = CLASS_BIAS_AU,
) -> DataFrame:
    """Add raw blend of a and b, its margin, each choice and the biased base decision."""
    sim = F.col("domain") == "sim"
    weight = lambda i: F.when(sim, sim_weights[i]).otherwise(au_weights[i])
    bias = F.when(sim, doubles(sim_bias[:k])).otherwise(doubles(au_bias[:k]))
    return (
        scores.withColumn("raw", blend(F.col("a"), F.col("b"), weight(0), weight(1)))
        .withColumns({
            "pa": argmax(F.col("a")),
            "pb": argmax(F.col("b")),
            "pr": argmax(F.col("raw")),
            "mg": margin(F.col("raw")),
            "lp": biased(F.col("raw"), bias),
        })
        .withColumn("base", argmax(F.col("lp")))
    )


def decide(scores: DataFrame, k: int) -> DataFrame:
    """base_decision plus choice and confidence of the third model c."""
    return base_decision(scores, k).withColumns({"pc": argmax(F.col("c")), "cc": F.array_max("c")})


def tie_break(
    decided: DataFrame, margin_lt: float = STACK["margin_lt"], confidence_ge: float = STACK["confidence_ge"]
) -> DataFrame:
    """Third-model override on sim rows where a and b disagree and the blend is close.

    The override replaces the biased decision and needs the third model to side with a or b.
    """
    candidate = (F.col("domain") == "sim") & (F.col("pa") != F.col("pb")) & (F.col("mg") < margin_lt)
    agrees = (F.col("pc") == F.col("pa")) | (F.col("pc") == F.col("pb"))
    accepted = candidate & agrees & (F.col("cc") >= confidence_ge)
    return decided.withColumns({
        "candidate": candidate,
        "accepted": accepted,
        "final": F.when(accepted, F.col("pc")).otherwise(F.col("base")),
    })


def fold_deltas(conf: DataFrame, params: list[str], baseline: DataFrame) -> DataFrame:
    """Macro-F1 per parameter against the baseline, over all rows and per fold.

    conf: (params, fold, y, pred, n) counts; baseline: (fold, y, pred, n) counts.
    Both are staged first: the large table behind them is read once each.
    """
    conf, baseline = stage(conf, "confusion"), stage(baseline, "confusion")
    by_fold = metrics.per_class(conf, [*params, "fold"]).groupBy(*params, "fold").agg(F.avg("f").alias("score"))
    base_fold = metrics.per_class(baseline, ["fold"]).groupBy("fold").agg(F.avg("f").alias("base"))
    deltas = (
        by_fold.join(F.broadcast(base_fold), "fold")
        .withColumn("d", F.col("score") - F.col("base"))
        .groupBy(*params)
        .agg(
            F.sum(F.when(F.col("d") > GAIN, 1).otherwise(0)).alias("positive_folds"),
            metrics.rounded(F.avg("d")).alias("mean_fold_delta"),
            metrics.rounded(F.min("d")).alias("min_fold_delta"),
        )
    )
    pooled = conf.groupBy(*params, "y", "pred").agg(F.sum("n").alias("n"))
    overall = metrics.per_class(pooled, params).groupBy(*params).agg(
        F.avg("f").alias("m"), (F.sum("tp") / F.sum("nt")).alias("acc")
    )
    base_all = metrics.per_class(baseline.groupBy("y", "pred").agg(F.sum("n").alias("n"))).agg(F.avg("f").alias("b"))
    overall = overall.withColumn("_one", F.lit(1)).join(F.broadcast(base_all.withColumn("_one", F.lit(1))), "_one")
    return overall.join(deltas, params).select(
        *params,
        metrics.rounded(F.col("m")).alias("macro_f1"),
        metrics.rounded(F.col("m") - F.col("b")).alias("delta_macro_f1"),
        metrics.rounded(F.col("acc")).alias("accuracy"),
        "positive_folds", "mean_fold_delta", "min_fold_delta",
    )
