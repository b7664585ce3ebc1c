"""Flagship: held-out transition priors over event steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.oracle import STEPS, f1_ctes, q, sql
from sessionloom.catalog.registry import query
from sessionloom.functions.probs import argmax, at
from sessionloom.operators import keys, metrics, priors
from sessionloom.schema import strings
from sessionloom.sources import derived

CLASSES = derived.EVENT_CLASSES


def _rows(spark, folder):
    steps = derived.event_steps(spark, folder)
    return steps.select(
        "id", "domain", "step", "fold", F.col("action").alias("label"),
        priors.slot_keys(F.col("actions"), F.col("step"), F.col("first_action")).alias("slots"),
    )


def _tail_sql(slot: str, k: int) -> str:
    return (
        f"CASE WHEN len(actions) >= {k} THEN '{slot}=' || array_to_string(list_slice(actions, len(actions) - {k - 1}, len(actions)), '>')"
        f" ELSE '{slot}=NONE' END"
    )


_SLOTS = f"""
slotted AS (
  SELECT id, domain, step, fold, action AS label, unnest([
    struct_pack(slot := 'global', key := 'global'),
    struct_pack(slot := 'last', key := {_tail_sql('last', 1)}),
    struct_pack(slot := 'first', key := CASE WHEN len(actions) > 0 THEN 'first=' || first_action ELSE 'first=NONE' END),
    struct_pack(slot := 'last2', key := {_tail_sql('last2', 2)}),
    struct_pack(slot := 'last3', key := {_tail_sql('last3', 3)}),
    struct_pack(slot := 'turn', key := 'turn=' || step)]) AS s
  FROM ev),
sl AS (SELECT id, domain, step, fold, label, s.slot AS slot, s.key AS key FROM slotted),
cnt AS (SELECT slot, key, fold, label, count(*) AS n FROM sl GROUP BY ALL),
cls AS (SELECT unnest([{', '.join(q(c) for c in CLASSES)}]) AS c, unnest(range({len(CLASSES)})) AS ci),
folds AS (SELECT DISTINCT fold FROM sl),
held AS (
  SELECT k.slot, k.key, f.fold, c.c, c.ci, coalesce(sum(n.n), 0) AS n
  FROM (SELECT DISTINCT slot, key FROM cnt) k CROSS JOIN folds f CROSS JOIN cls c
  LEFT JOIN cnt n ON n.slot = k.slot AND n.key = k.key AND n.label = c.c AND n.fold <> f.fold
  GROUP BY ALL),
tot AS (SELECT slot, key, fold, sum(n) AS seen FROM held GROUP BY ALL),
gprior AS (
  SELECT h.fold, h.ci, (h.n + 1.0::DOUBLE) / (t.seen + 1.0::DOUBLE * {len(CLASSES)}) AS g
  FROM held h JOIN tot t USING (slot, key, fold) WHERE slot = 'global'),
pr AS (
  SELECT h.slot, h.key, h.fold, any_value(t.seen) AS seen, list(
      CASE WHEN t.seen > 0 THEN (h.n + 1.0::DOUBLE) / (t.seen + 1.0::DOUBLE * {len(CLASSES)}) ELSE g.g END ORDER BY h.ci) AS prior
  FROM held h JOIN tot t USING (slot, key, fold) JOIN gprior g ON g.fold = h.fold AND g.ci = h.ci
  GROUP BY h.slot, h.key, h.fold),
looked AS (SELECT sl.*, pr.seen, pr.prior FROM sl JOIN pr USING (slot, key, fold))
"""
_CL = "[" + ", ".join(q(c) for c in CLASSES) + "]"


@query("transition_prior", sql(STEPS, _SLOTS, select=f"""
SELECT id, slot, key, seen::BIGINT AS seen,
  {_CL}[list_position(prior, list_max(prior))] AS best,
  round(list_max(prior), 6) AS p_best, round(prior[list_position({_CL}, label)], 6) AS p_label
FROM looked"""))
def transition_prior(spark, folder):
    prior = priors.transition_prior(_rows(spark, folder), CLASSES)
    label_at = F.array_position(strings(CLASSES), F.col("label")) - 1
    return prior.select(
        "id", "slot", "key", "seen",
        F.get(strings(CLASSES), argmax(F.col("prior"))).alias("best"),
        metrics.rounded(F.array_max("prior")).alias("p_best"),
        metrics.rounded(at(F.col("prior"), label_at)).alias("p_label"),
    )


_BAND = ("CASE WHEN step <= 1 THEN 's1' WHEN step <= 3 THEN 's2_3' WHEN step <= 6 THEN 's4_6' "
         "WHEN step <= 10 THEN 's7_10' ELSE 's11p' END")


@query("transition_prior_metrics", sql(STEPS, _SLOTS, f"""
predicted AS (
  SELECT slot, domain, {_BAND} AS step_group, label AS y, {_CL}[list_position(prior, list_max(prior))] AS pred FROM looked),
conf AS (
  SELECT slot, domain, 'all' AS step_group, y, pred, count(*) AS n FROM predicted GROUP BY ALL
  UNION ALL SELECT slot, 'all', step_group, y, pred, count(*) FROM predicted GROUP BY ALL
  UNION ALL SELECT slot, 'all', 'all', y, pred, count(*) FROM predicted GROUP BY ALL)
""", f1_ctes("conf", ["slot", "domain", "step_group"]), select=f"""
SELECT slot, domain, step_group, sum(nt)::BIGINT AS rows, round(sum(tp) / sum(nt), 6) AS accuracy,
  round(sum(f) / {len(CLASSES)}.0::DOUBLE, 6) AS macro_f1
FROM f1 GROUP BY ALL"""))
def transition_prior_metrics(spark, folder):
    prior = priors.transition_prior(_rows(spark, folder), CLASSES)
    predicted = prior.select(
        "slot", "domain", keys.step_band(F.col("step")).alias("step_group"),
        F.col("label").alias("y"), F.get(strings(CLASSES), argmax(F.col("prior"))).alias("pred"),
    )
    by = ["slot", "domain", "step_group"]
    conf = metrics.confusion(predicted, by)
    sliced = metrics.with_grouping_sets(
        conf, [["slot", "domain"], ["slot", "step_group"], ["slot"]], by
    )
    return metrics.scores(sliced, by, classes=len(CLASSES))
