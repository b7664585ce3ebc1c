"""Class-bias fitting by coordinate steps, each step one aggregation.

For one class, every candidate bias value changes a row's prediction only between that
class and the best of the others. So a row is summed up by its truth, the best other
class and the number of candidate values at which the class does not win yet. These
counts (at most K x K x values per fit) are all the driver needs to score every value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.functions.base import let
from sessionloom.functions.probs import log_clipped, normalise
from sessionloom.sources.staging import stage

# Relative steps of the coordinate fit, coarse to fine.
FIT_GRIDS = [
    [-0.60, -0.50, -0.40, -0.30, -0.20, -0.10, 0.0, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60],
    [-0.20, -0.15, -0.10, -0.05, 0.0, 0.05, 0.10, 0.15, 0.20],
    [-0.08, -0.06, -0.04, -0.02, 0.0, 0.02, 0.04, 0.06, 0.08],
]
SHRINKS = [0.00, 0.10, 0.20, 0.30, 0.40, 0.50, 0.70, 1.00]


def absolute_grid(low: float = -0.8, high: float = 0.8, step: float = 0.1) -> list[float]:
    n = int(round((high - low) / step)) + 1
    return [round(low + i * step, 10) for i in range(n)]


def _best_other(lp: Column, cls: Column) -> Column:
    """(index, value) of the largest entry apart from one class, first index on ties."""
    others = F.transform(lp, lambda x, i: F.when(i == cls, F.lit(float("-inf"))).otherwise(x))
    return let(others, lambda o: F.struct((F.array_position(o, F.array_max(o)) - 1).cast("int").alias("i"), F.array_max(o).alias("v")))


def step_counts(lp: DataFrame, by: list[str], cls: Column, values: Column, bias: Column) -> DataFrame:
    """Counts (by, y, other, lost): at how many ascending candidate values the class loses.

    lp: by columns, y, logp. bias: current bias vector; values: candidate values of the class.
    """
    shifted = F.zip_with(F.col("logp"), bias, lambda x, b: x + b)
    facts = lp.select(
        *by, "y", cls.alias("cls"), _best_other(shifted, cls).alias("o"), F.get(F.col("logp"), cls).alias("own"),
        values.alias("vals"),
    )

    def wins(v: Column) -> Column:
        score = F.col("own") + v
        return (score > F.col("o.v")) | ((score == F.col("o.v")) & (F.col("cls") < F.col("o.i")))

    return (
        facts.select(*by, "y", F.col("o.i").alias("other"), F.size(F.filter("vals", lambda v: ~wins(v))).alias("lost"))
        .groupBy(*by, "y", "other", "lost")
        .agg(F.count("*").alias("n"))
    )


def score_values(counts: Sequence[tuple[int, int, int, int]], cls: int, n_values: int, k: int) -> list[float]:
    """Macro-F1 over k classes for every candidate value, from (y, other, lost, n) counts."""
    scores = []
    for v in range(n_values):
        true, pred, hit = [0] * k, [0] * k, [0] * k
        for y, other, lost, n in counts:
            p = cls if v >= lost else other
            true[y] += n
            pred[p] += n
            if p == y:
                hit[y] += n
        scores.append(sum(2.0 * h / (t + p) if t + p else 0.0 for h, t, p in zip(hit, true, pred)) / k)
    return scores


def log_table(df: DataFrame, proba: str, carry: list[str]) -> DataFrame:
    """y and clipped log-probabilities, written once for the many steps that read them."""
    return stage(df.select(*carry, "y", log_clipped(normalise(F.col(proba))).alias("logp")), "bias-logp")


def grid_search(lp: DataFrame, k: int, grid: list[float] | None = None, passes: int = 2) -> tuple[list[float], float]:
    """Absolute-grid search, class by class; a value is kept when it scores strictly better."""
    grid = sorted(grid or absolute_grid())
    bias, best = [0.0] * k, None
    rows = lp.select(F.lit(0).alias("fit"), "y", "logp")
    for _ in range(passes):
        improved = False
        for cls in range(k):
            values = sorted({*grid, bias[cls]})
            scores = score_values(_step(rows, cls, {0: values}, {0: bias}).get(0, []), cls, len(values), k)
            current = scores[values.index(bias[cls])]
            best = current if best is None else best
            choice, top = bias[cls], current
            for v in grid:
                s = scores[values.index(v)]
                if s > top:
                    choice, top = v, s
            bias[cls] = choice
            if top > best:
                best, improved = top, True
        if not improved:
            break
    return bias, best


def coordinate_fit(
    lp: DataFrame, fits: list, k: int, order: Sequence[int] | None = None, rounds: int = 3,
    grids: Sequence[Sequence[float]] = FIT_GRIDS,
) -> dict:
    """Relative-step fit for several data subsets at once.

    lp: fit (array of the fit keys a row belongs to), y, logp. All fits advance together,
    so one job scores one class for every fit. Returns {fit: (bias, score)}; a bias is
    centred on zero at the end. order: class order of each round.
    """
    order = list(order or range(k))
    bias = {f: [0.0] * k for f in fits}
    best: dict = {f: None for f in fits}
    rows = lp.select(F.explode_outer("fit").alias("fit"), "y", "logp")
    for grid in grids:
        active = set(fits)
        for _ in range(rounds):
            improved = set()
            for cls in order:
                if not active:
                    break
                values = {f: sorted({round(bias[f][cls] + d, 12) for d in grid} | {bias[f][cls]}) for f in active}
                counts = _step(rows, cls, values, {f: bias[f] for f in active})
                for f in active:
                    scores = score_values(counts.get(f, []), cls, len(values[f]), k)
                    at_current = scores[values[f].index(bias[f][cls])]
                    best[f] = at_current if best[f] is None else best[f]
                    choice, top = bias[f][cls], best[f]
                    for d in grid:
                        v = round(bias[f][cls] + d, 12)
                        if scores[values[f].index(v)] > top + 1e-8:
                            choice, top = v, scores[values[f].index(v)]
                    bias[f][cls] = choice
                    if top > best[f] + 1e-9:
                        best[f] = top
                        improved.add(f)
            active = improved
            if not active:
                break
    return {f: ([b - sum(bias[f]) / k for b in bias[f]], best[f]) for f in fits}


def _step(rows: DataFrame, cls: int, values: dict, bias: dict) -> dict:
    """One job: counts of every active fit for one class.

    The step's numbers come in through a table with one row per fit, so the plan is the
    same for every step and its generated code is reused.
    """
    params = rows.sparkSession.createDataFrame(
        [(f, cls, [float(v) for v in values[f]], [float(b) for b in bias[f]]) for f in values],
        "fit int, cls int, vals array<double>, bias array<double>",
    )
    joined = rows.join(F.broadcast(params), "fit")
    out: dict = {}
    for r in step_counts(joined, ["fit"], F.col("cls"), F.col("vals"), F.col("bias")).collect():
        out.setdefault(r["fit"], []).append((r["y"], r["other"], r["lost"], r["n"]))
    return out


def select_shrink(sweep: list[dict]) -> dict:
    """Best eligible row: a gain overall, at least 4 positive folds, no fold below -0.0005; else no shrink."""
    ranked = sorted(sweep, key=lambda r: (-r["positive_folds"], -r["mean_fold_delta"], -r["min_fold_delta"]))
    for row in ranked:
        if row["delta_macro_f1"] > 0 and row["positive_folds"] >= 4 and row["min_fold_delta"] >= -0.0005:
            return row
    return next(r for r in ranked if r["shrink"] == 0.0)
