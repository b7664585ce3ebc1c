import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import bias_search, crossfit, joins, knn, priors, splits, textmodel
from sessionloom.operators.ordered import with_ordered_history
from sessionloom.schema import CLASS_BIAS_AU, CLASS_BIAS_SIM, GROUP_OF, LABELS, STACK


def test_fixed_settings():
    assert len(set(LABELS)) == 14 and LABELS == sorted(LABELS) and set(GROUP_OF) == set(LABELS)
    assert sum(STACK["sim_weights"]) == pytest.approx(1) and sum(STACK["au_weights"]) == pytest.approx(1)
    assert (STACK["margin_lt"], STACK["confidence_ge"]) == (0.08, 0.55)
    assert len(CLASS_BIAS_SIM) == len(CLASS_BIAS_AU) == 14


def test_ordered_history_equals_a_plain_scan_also_for_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"u{rng.randrange(9)}", t, f"a{rng.randrange(4)}") for t in range(600)]
    df = spark.createDataFrame(rows, "u string, t int, a string")
    seen, want = {}, {}
    for u, t, a in rows:
        past = seen.setdefault(u, [])
        want[(u, t)] = (len(past) + 1, past[-5:])
        past.append(a)
    first = {}
    for u, t, a in rows:
        first.setdefault(u, a)
    for heavy_rows in (50, 1000):
        got = with_ordered_history(df, "u", ["t"], F.floor(F.col("t") / 37), "a", 5, heavy_rows=heavy_rows).collect()
        assert {(r["u"], r["t"]): (r["step"], r["actions"]) for r in got} == want
        assert all(r["first_action"] == (first[r["u"]] if r["step"] > 1 else None) for r in got)


def _brute(rows, k):
    out = {}
    for i, _, f, v in rows:
        q = np.array(v) / np.linalg.norm(v)
        sims = [
            (-round(float(q @ (np.array(w) / np.linalg.norm(w))), 9), j) for j, _, g, w in rows if g != f
        ]
        out[i] = [j for _, j in sorted(sims)[:k]]
    return out


@pytest.mark.parametrize("copies", [0, 60])
def test_neighbours_equal_brute_force(spark, copies):
    rng = np.random.default_rng(3)
    vecs = [[float(np.float32(x)) for x in rng.normal(size=6)] for _ in range(160)] + [[1.0, 0.0, 0.0, 0.0, 0.0, 0.5]] * copies
    rows = [(i, i % 3, (i * 7) % 4, v) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, vec array<float>")
    got = {}
    # Tiny blocks force many blocks per pivot and many query groups.
    for r in knn.topk_other_folds(df, 7, block_rows=16).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["nid"])
    assert got == _brute(rows, 7)


def _macro(y, pred, k):
    total = 0.0
    for c in range(k):
        tp = sum(a == c and b == c for a, b in zip(y, pred))
        n = sum(a == c for a in y) + sum(b == c for b in pred)
        total += 2 * tp / n if n else 0.0
    return total / k


def test_bias_step_scores_equal_direct_scoring(spark):
    rng = np.random.default_rng(5)
    lp = np.log(rng.dirichlet([1.0] * 4, size=80))
    y = rng.integers(0, 4, size=80)
    df = spark.createDataFrame([(0, int(a), [float(v) for v in b]) for a, b in zip(y, lp)], "fit int, y int, logp array<double>")
    values = bias_search.absolute_grid(-0.6, 0.6, 0.3)
    counts = bias_search._step(df, 2, {0: values}, {0: [0.1, -0.2, 0.0, 0.3]})[0]
    got = bias_search.score_values(counts, 2, len(values), 4)
    base = np.array([0.1, -0.2, 0.0, 0.3])
    want = []
    for v in values:
        b = base.copy()
        b[2] = v
        want.append(_macro(list(y), list((lp + b).argmax(axis=1)), 4))
    assert got == pytest.approx(want)


def _direct_fit(lp, y, k):
    """Coordinate search that scores every candidate by predicting all rows again."""
    score = lambda b: _macro(list(y), list((lp + b).argmax(axis=1)), k)
    bias, best = np.zeros(k), None
    for grid in bias_search.FIT_GRIDS:
        for _ in range(3):
            improved = False
            for c in range(k):
                best = score(bias) if best is None else best
                choice, top = bias[c], best
                for d in grid:
                    trial = bias.copy()
                    trial[c] = round(bias[c] + d, 12)
                    if score(trial) > top + 1e-8:
                        choice, top = trial[c], score(trial)
                bias[c] = choice
                if top > best + 1e-9:
                    best, improved = top, True
            if not improved:
                break
    return bias - bias.mean(), best


def _direct_grid(lp, y, k):
    score = lambda b: _macro(list(y), list((lp + b).argmax(axis=1)), k)
    bias, best = np.zeros(k), None
    for _ in range(2):
        improved = False
        for c in range(k):
            current = score(bias)
            best = current if best is None else best
            choice, top = bias[c], current
            for v in bias_search.absolute_grid():
                trial = bias.copy()
                trial[c] = v
                if score(trial) > top:
                    choice, top = v, score(trial)
            bias[c] = choice
            if top > best:
                best, improved = top, True
        if not improved:
            break
    return bias, best


def test_fits_equal_a_direct_search(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([1.0] * 3, size=70)
    y, fold = rng.integers(0, 3, size=70), np.arange(70) % 2
    rows = [([-1, 1 - int(f)], int(a), [float(math.log(v)) for v in b]) for a, b, f in zip(y, p, fold)]
    df = spark.createDataFrame(rows, "fit array<int>, y int, logp array<double>")
    got = bias_search.coordinate_fit(df, [-1, 0, 1], 3)
    for fit in (-1, 0, 1):
        part = np.ones(70, bool) if fit == -1 else fold != fit
        bias, score = _direct_fit(np.log(p[part]), y[part], 3)
        assert got[fit][0] == pytest.approx(list(bias)) and got[fit][1] == pytest.approx(score)
    bias, score = bias_search.grid_search(df, 3)
    want, top = _direct_grid(np.log(p), y, 3)
    assert bias == pytest.approx(list(want)) and score == pytest.approx(top)


def test_cross_fitted_bias_equals_a_direct_one(spark):
    from sessionloom.plans.decision import cross_fit_bias

    rng = np.random.default_rng(8)
    n, k = 150, 3
    y = rng.integers(0, k, size=n)
    p = rng.dirichlet([1.0] * k, size=n) + 0.5 * np.eye(k)[y] * np.array([1.0, 0.6, 0.3])
    p /= p.sum(axis=1, keepdims=True)
    fold = np.arange(n) % 5
    df = spark.createDataFrame([(int(f), int(a), [float(v) for v in b]) for f, a, b in zip(fold, y, p)], "fold int, y int, p array<double>")
    table, final = cross_fit_bias(df, "p", k)
    lp = np.log(np.clip(p, 1e-9, 1.0))
    held = np.array([_direct_fit(lp[fold != f], y[fold != f], k)[0] for f in range(5)])[fold]
    anchor, sweep = lp.argmax(axis=1), {}
    for s in bias_search.SHRINKS:
        pred = (lp + s * held).argmax(axis=1)
        deltas = [_macro(list(y[fold == f]), list(pred[fold == f]), k) - _macro(list(y[fold == f]), list(anchor[fold == f]), k) for f in range(5)]
        sweep[s] = {
            "shrink": s, "delta_macro_f1": _macro(list(y), list(pred), k) - _macro(list(y), list(anchor), k),
            "positive_folds": sum(d > 1e-12 for d in deltas), "mean_fold_delta": np.mean(deltas), "min_fold_delta": min(deltas),
            "changed": int((pred != anchor).sum())}
    for r in table.collect():
        for c, v in sweep[r["shrink"]].items():
            assert r[c] == pytest.approx(v, abs=1e-6)
    chosen = bias_search.select_shrink(list(sweep.values()))["shrink"]
    assert [r["shrink"] for r in table.where("selected").collect()] == [chosen]
    assert final == pytest.approx(list(chosen * _direct_fit(lp, y, k)[0]))


def test_folds_keep_sessions_whole_and_balanced(spark):
    rng = random.Random(2)
    rows = [(f"s{s}", f"l{s % 3}") for s in range(97) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "root string, label string")
    plain = splits.group_kfold(df, 5).collect()
    assert len(plain) == len({r["root"] for r in plain}) == 97
    load = [sum(r["size"] for r in plain if r["fold"] == f) for f in range(5)]
    assert max(load) - min(load) <= 16
    strat = splits.stratified_group_kfold(df, 5).collect()
    for label in ("l0", "l1", "l2"):
        n = [sum(r["fold"] == f and r["dominant"] == label for r in strat) for f in range(5)]
        assert max(n) - min(n) <= 1


def test_prior_backs_off_to_the_global_one(spark):
    rows = [("a", 0, "x", ["p"]), ("b", 1, "y", ["q"]), ("c", 1, "x", ["p"]), ("d", 0, "x", ["q", "p"])]
    df = spark.createDataFrame(rows, "id string, fold int, label string, actions array<string>").select(
        "id", "fold", "label", priors.slot_keys(F.col("actions"), F.lit(3.0)).alias("slots")
    )
    got = {(r["id"], r["slot"]): (r["seen"], [round(v, 6) for v in r["prior"]]) for r in priors.transition_prior(df, ["x", "y"]).collect()}
    assert got[("a", "global")] == (2, [0.5, 0.5])
    assert got[("a", "last")] == (1, [round(2 / 3, 6), round(1 / 3, 6)])
    assert got[("d", "last2")] == (0, [0.5, 0.5])
    own = {(r["id"], r["slot"]): r["seen"] for r in priors.transition_prior(df, ["x", "y"], self_inclusive=True).collect()}
    assert own[("d", "last2")] == 1 and own[("a", "global")] == 4


def test_tfidf_by_hand(spark):
    rows = [(1, 0, "aa bb aa"), (2, 1, "aa cc"), (3, 1, "bb cc")]
    docs = spark.createDataFrame(rows, "doc int, fold int, text string")
    got = {
        (r["doc"], r["term"]): r["weight"]
        for r in textmodel.tfidf(docs, textmodel.word_terms(F.col("text"), 1, 1), 2, 1, 10).collect()
    }
    # Document 1 is weighed by documents 2 and 3: aa and bb occur in one of them each.
    idf = math.log(3 / 2) + 1
    w = {"aa": (1 + math.log(2)) * idf, "bb": idf}
    norm = math.sqrt(sum(v * v for v in w.values()))
    assert got[(1, "aa")] == pytest.approx(w["aa"] / norm) and got[(1, "bb")] == pytest.approx(w["bb"] / norm)
    assert (2, "cc") not in got


def test_tfidf_weights_are_not_shuffled(spark, monkeypatch):
    """Weights and norms come from the rows that hold the counts, also where rows are handled in small portions."""
    docs = spark.createDataFrame(
        [(i, i % 2, " ".join(f"w{j % 7}" for j in range(i, 2 * i))) for i in range(20)] + [(20, 0, None), (21, 1, "")],
        "doc int, fold int, text string")
    terms = textmodel.word_terms(F.col("text"), 1, 2)
    out = textmodel.tfidf(docs, terms, 2, 1, 50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    whole = sorted(map(tuple, out.collect()))
    assert {r[0] for r in whole} <= set(range(20)) and len(whole) > 100
    monkeypatch.setattr(textmodel, "TOGETHER", 3)
    assert sorted(map(tuple, textmodel.tfidf(docs, terms, 2, 1, 50).collect())) == whole


def test_most_frequent_terms_break_ties_by_name(spark):
    rows = [(f, t, n) for f in (0, 1) for t, n in [("d", 5), ("c", 3), ("a", 3), ("b", 3), ("e", 1)]]
    terms = spark.createDataFrame(rows, "fold int, term string, total long")
    got = sorted((r["fold"], r["term"]) for r in textmodel.most_frequent(terms, 3).collect())
    assert got == [(0, "a"), (0, "b"), (0, "d"), (1, "a"), (1, "b"), (1, "d")]
    assert textmodel.most_frequent(terms, 50).count() == 10


def test_strict_joins_fail_on_missing_rows(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    labels = spark.createDataFrame([("a", "x")], "id string, action string")
    with pytest.raises(Exception, match="missing label: b"):
        joins.join_strict(rows, labels, "id", "action", "missing label").collect()
    long = spark.createDataFrame([("a", 0, "m", [0.1]), ("a", 1, "n", [0.2])], "id string, y int, model string, proba array<double>")
    with pytest.raises(Exception, match="truth differs: a"):
        joins.strict_alignment(joins.align_models(long, ["m", "n"]), ["m", "n"]).collect()


def test_crossfit_scores_every_row_once(spark):
    rng = np.random.default_rng(0)
    rows = [(f"r{i}", i % 3, float(i % 2), [float(i % 2) + float(rng.normal(0, 0.1)), 1.0]) for i in range(60)]
    data = crossfit.dense(spark.createDataFrame(rows, "id string, fold int, y double, f array<double>"), "f")
    for kind in ("logreg", "svm"):
        out = crossfit.crossfit(data, 3, 4, kind=kind, max_iter=5).collect()
        assert sorted(r["id"] for r in out) == sorted(r[0] for r in rows)
        assert all(sum(r["proba"]) == pytest.approx(1) and len(r["proba"]) == 4 for r in out)
        assert np.mean([int(np.argmax(r["proba"])) == r["y"] for r in out]) > 0.95


@pytest.mark.parametrize("preset", ["story_word", "five_view_transition"])
def test_preset_features_cover_every_row(spark, folder, preset):
    from sessionloom.catalog.texts import FOLDS, _labelled

    rows = _labelled(spark, folder)
    long = crossfit.features(rows, crossfit.PRESETS[preset], FOLDS, LABELS)
    found, size = crossfit.cells(long)
    matrix = crossfit.sparse(rows.select("id").join(found, "id", "left"), "cells", size)
    assert size > 50 and matrix.count() == rows.count()
    want = {r["id"]: [(c["slot"], c["value"]) for c in r["cells"]] for r in found.collect()}
    for r in matrix.limit(20).collect():
        assert r["features"].size == size
        assert list(zip(r["features"].indices.tolist(), r["features"].values.tolist(), strict=True)) == want.get(r["id"], [])


def test_assembly_takes_valid_batches_from_the_second_file(spark):
    """Verdicts and rows of valid batches need no text of the first file beside the second."""
    from sessionloom.operators import quality

    base = spark.createDataFrame(
        [(b, i, f"{b}/{i}", "a", f"text {b} {i}") for b in range(4) for i in range(3)] + [(0, 3, "0/3", "a", None)],
        "batch int, idx long, id string, action string, original string")
    para = base.where("batch <> 1").where("NOT (batch = 2 AND idx = 1)").withColumn(
        "original", F.when(F.expr("batch = 3 AND idx = 0"), "other").otherwise(F.col("original"))).withColumn("paraphrase", F.lit("p"))
    verdicts = {r["batch"]: (r["rows"], r["para_rows"], r["valid"]) for r in quality.batch_verdicts(base, para).collect()}
    assert verdicts == {0: (4, 4, True), 1: (3, 0, False), 2: (3, 2, False), 3: (3, 3, False)}
    columns = ["batch", "idx", "b_id", "b_action", "b_original", "paraphrase"]
    key = lambda r: (r["batch"], r["idx"])
    got = sorted(quality.valid_rows(base, para).select(columns).collect(), key=key)
    assert got == sorted(quality.pair_batches(base, para).where("valid").select(columns).collect(), key=key) and len(got) == 4


def test_merge_reads_each_check_once(spark, folder):
    """Rows are made from staged checks: the plan of the result evaluates no check (no rule's reason stands in it)."""
    from sessionloom.catalog.quality import merge_resume_upsert

    plan = merge_resume_upsert(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "deixis_lost" not in plan and "backtick_lost" not in plan
