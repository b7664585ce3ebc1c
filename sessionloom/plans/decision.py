"""Batch decision: route, blend, arbitrate, calibrate, write by id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.functions.probs import argmax, log_clipped, normalise
from sessionloom.operators import bias_search, calibration, joins, keys, metrics
from sessionloom.schema import doubles
from sessionloom.sources.staging import stage


def fill_template(template: DataFrame, predictions: DataFrame) -> DataFrame:
    """Template rows (id, row_no) with their prediction; a template id without one is an error."""
    return joins.join_strict(template, predictions, "id", "action", "no prediction for id")


def decide_batch(scores: DataFrame, template: DataFrame, classes: int) -> DataFrame:
    """Final action per template row from the model probability columns a, b and c.

    The third model is read only for close sim disagreements: its probabilities are
    joined to the candidates alone, after the filter.
    """
    base = calibration.base_decision(scores.drop("c"), classes)
    close = (F.col("domain") == "sim") & (F.col("pa") != F.col("pb")) & (F.col("mg") < calibration.STACK["margin_lt"])
    ruled = base.where(close).select("id", "pa", "pb").join(scores.select("id", "c"), "id").select(
        "id", "pa", "pb", argmax(F.col("c")).alias("pc"), F.array_max("c").alias("cc")
    )
    agrees = (F.col("pc") == F.col("pa")) | (F.col("pc") == F.col("pb"))
    accepted = ruled.where(agrees & (F.col("cc") >= calibration.STACK["confidence_ge"])).select(
        "id", F.col("pc").alias("override")
    )
    final = base.join(accepted, "id", "left").select(
        "id", keys.decode_label(F.coalesce("override", "base")).alias("action")
    )
    return fill_template(template, final).withColumn("domain", keys.domain(F.col("id")))


def calibration_report(df: DataFrame, proba: str, bias: Column, shrinks: Sequence[float]) -> DataFrame:
    """Anchor score and biased scores for all rows and per domain, per shrink factor.

    df: domain, y, probability vector; bias: the row's bias vector. One pass, then counts.
    """
    log_p = log_clipped(normalise(F.col(proba)))
    preds = F.transform(
        doubles(shrinks),
        lambda s: F.struct(s.alias("shrink"), argmax(F.zip_with(log_p, bias, lambda x, b: x + s * b)).alias("pred")),
    )
    runs = df.select("domain", "y", argmax(F.col(proba)).alias("anchor"), F.explode_outer(preds).alias("r")).select(
        "domain", "y", "anchor", "r.*"
    )
    counts = stage(runs.groupBy("domain", "shrink", "y", "anchor", "pred").agg(F.count("*").alias("n")), "calibration")
    sliced = counts.select(F.explode_outer(F.array(F.col("domain"), F.lit("all"))).alias("domain"), "shrink", "y", "anchor", "pred", "n")
    conf = sliced.groupBy("domain", "shrink", "y", "pred").agg(F.sum("n").alias("n"))
    base = sliced.where(F.col("shrink") == shrinks[0]).groupBy("domain", "y", F.col("anchor").alias("pred")).agg(
        F.sum("n").alias("n")
    )
    new = metrics.per_class(conf, ["domain", "shrink"]).groupBy("domain", "shrink").agg(
        F.sum("nt").alias("rows"), F.avg("f").alias("m"), (F.sum("tp") / F.sum("nt")).alias("acc")
    )
    anchor = metrics.per_class(base, ["domain"]).groupBy("domain").agg(F.avg("f").alias("b"))
    return new.join(F.broadcast(anchor), "domain").select(
        "domain", "shrink", "rows", metrics.rounded(F.col("b")).alias("anchor_macro_f1"),
        metrics.rounded(F.col("m")).alias("macro_f1"), metrics.rounded(F.col("m") - F.col("b")).alias("delta"),
        metrics.rounded(F.col("acc")).alias("accuracy"),
    )


def cross_fit_bias(df: DataFrame, proba: str, k: int, folds: int = 5) -> tuple[DataFrame, list[float]]:
    """(sweep of shrink factors, bias to use): fit without each fold, shrink, accept, fit on all rows.

    df: fold, y and a probability vector. The sweep has a row for each shrink factor with
    its score and fold deltas against the unbiased choice, the number of changed rows and whether it is
    selected. The bias is the fit on all rows, scaled by the selected shrink.
    """
    found = _cross_fit(df.withColumn("domain", F.lit("all")), proba, k, ["all"], folds)
    return found.sweep.drop("domain"), found.bias["all"]


@dataclass
class CrossFit:
    """Sweep rows by domain and shrink, biases to use by domain, and the staged rows they were fitted on."""

    sweep: DataFrame
    bias: dict[str, list[float]]
    rows: DataFrame
    in_sample: dict[str, float]


def _cross_fit(df: DataFrame, proba: str, k: int, domains: Sequence[str], folds: int) -> CrossFit:
    """Biases of every domain, without each of its folds and on all of it; all these fits advance in the same jobs."""
    wide = folds + 1
    place = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(domains) for x in (d, i * wide)]), F.col("domain"))
    member = F.transform(
        F.concat(F.filter(F.array(*[F.lit(f) for f in range(folds)]), lambda f: f != F.col("fold")), F.array(F.lit(folds))),
        lambda f: f + place)
    known = df.where(F.col("domain").isin(*domains)).withColumn("fit", member)
    lp = bias_search.log_table(known, proba, ["fit", "domain", "fold"])
    fits = bias_search.coordinate_fit(lp, list(range(wide * len(domains))), k)
    held_out = F.get(F.array(*[doubles(fits[i][0]) for i in range(wide * len(domains))]), place + F.col("fold"))
    preds = F.transform(doubles(bias_search.SHRINKS), lambda s: F.struct(
        s.alias("shrink"), argmax(F.zip_with("logp", held_out, lambda x, b: x + s * b)).alias("pred")))
    runs = stage(
        lp.select("domain", "fold", "y", argmax(F.col("logp")).alias("anchor"), F.explode_outer(preds).alias("r"))
        .select("domain", "fold", "y", "anchor", "r.*")
        .groupBy("domain", "shrink", "fold", "y", "anchor", "pred").agg(F.count("*").alias("n")), "shrinks")
    tables, bias, in_sample = None, {}, {}
    # From here on only counts are read, a few rows for each domain.
    for i, domain in enumerate(domains):
        own = runs.where(F.col("domain") == domain)
        conf = own.groupBy("shrink", "fold", "y", "pred").agg(F.sum("n").alias("n"))
        base = own.where(F.col("shrink") == bias_search.SHRINKS[0]).groupBy("fold", "y", F.col("anchor").alias("pred")).agg(
            F.sum("n").alias("n"))
        changed = own.groupBy("shrink").agg(
            F.coalesce(F.sum(F.when(F.col("pred") != F.col("anchor"), F.col("n"))), F.lit(0)).alias("changed"))
        table = stage(calibration.fold_deltas(conf, ["shrink"], base).join(F.broadcast(changed), "shrink"), "shrink-sweep")
        rows = [r.asDict() for r in table.collect()]  # one row a shrink factor
        chosen = bias_search.select_shrink(rows)["shrink"] if rows else 0.0
        everyone = fits[i * wide + folds]
        bias[domain] = [chosen * b for b in everyone[0]]
        in_sample[domain] = float(everyone[1] or 0.0)
        part = table.select(F.lit(domain).alias("domain"), "*", (F.col("shrink") == chosen).alias("selected"))
        tables = part if tables is None else tables.unionByName(part)
    return CrossFit(tables, bias, lp, in_sample)


@dataclass
class Calibration:
    """Report of a fitted calibration, and the biases to use by domain."""

    report: DataFrame
    bias: dict[str, list[float]]


def calibrate_domains(
    df: DataFrame, proba: str, k: int, domains: Sequence[str] = ("sim", "au"), folds: int = 5
) -> Calibration:
    """Fits each domain's bias without each fold, picks its shrink, and scores what would be used.

    df: domain, fold, y and a probability vector; rows of other domains are left out. The report has two sections.
    `crossfit`: for each domain and shrink factor the score of biases fitted without the row's fold, the
    fold deltas, the rows changed and which shrink is selected. `deployment`: for all rows and each domain the
    anchor's score (no bias), that of the scaled bias fitted on all rows, rows changed, and for a domain its selected shrink
    and the unscaled fit's score. A domain without rows has no bias and no rows in the report.
    """
    found = _cross_fit(df, proba, k, list(domains), folds)
    vectors = F.element_at(
        F.create_map(*[x for d in domains for x in (F.lit(d), doubles(found.bias[d]))]), F.col("domain"))
    counts = stage(
        found.rows.groupBy(
            "domain", "y", argmax(F.col("logp")).alias("anchor"), argmax(F.zip_with("logp", vectors, lambda x, b: x + b)).alias("pred"))
        .agg(F.count("*").alias("n")), "deployment")
    scopes = counts.select(F.explode_outer(F.array(F.lit("all"), "domain")).alias("scope"), "y", "anchor", "pred", "n")

    def scored(choice: str, prefix: str) -> DataFrame:
        conf = scopes.groupBy("scope", "y", F.col(choice).alias("pred")).agg(F.sum("n").alias("n"))
        return metrics.per_class(conf, ["scope"]).groupBy("scope").agg(
            F.sum("nt").alias("rows"), F.avg("f").alias(f"{prefix}f"), (F.sum("tp") / F.sum("nt")).alias(f"{prefix}a"))

    changed = scopes.groupBy("scope").agg(
        F.sum(F.when(F.col("pred") != F.col("anchor"), F.col("n")).otherwise(0)).alias("changed"))
    selected = found.sweep.where("selected").select(F.col("domain").alias("scope"), F.col("shrink").alias("_shrink"))
    fitted = F.element_at(F.create_map(*[F.lit(x) for d in domains for x in (d, found.in_sample[d])]), F.col("scope"))
    none = F.lit(None).cast("double")
    deployment = (
        scored("pred", "").join(scored("anchor", "anchor_").drop("rows"), "scope").join(changed, "scope").join(selected, "scope", "left")
        .select(
            F.lit("deployment").alias("section"), "scope", F.col("_shrink").alias("shrink"), F.lit(True).alias("selected"), "rows",
            metrics.rounded(F.col("anchor_f")).alias("anchor_macro_f1"), metrics.rounded(F.col("f")).alias("macro_f1"),
            metrics.rounded(F.col("f") - F.col("anchor_f")).alias("delta"), metrics.rounded(F.col("a")).alias("accuracy"), "changed",
            F.lit(None).cast("long").alias("positive_folds"), none.alias("mean_fold_delta"), none.alias("min_fold_delta"),
            metrics.rounded(F.when(F.col("scope") != "all", fitted)).alias("unscaled_macro_f1"))
    )
    sizes = counts.groupBy("domain").agg(F.sum("n").alias("rows"))
    crossfit = found.sweep.join(F.broadcast(sizes), "domain").select(
        F.lit("crossfit").alias("section"), F.col("domain").alias("scope"), "shrink", "selected", "rows",
        metrics.rounded(F.col("macro_f1") - F.col("delta_macro_f1")).alias("anchor_macro_f1"), "macro_f1",
        F.col("delta_macro_f1").alias("delta"), "accuracy", "changed", F.col("positive_folds").cast("long").alias("positive_folds"),
        "mean_fold_delta", "min_fold_delta", none.alias("unscaled_macro_f1"))
    return Calibration(crossfit.unionByName(deployment), found.bias)
