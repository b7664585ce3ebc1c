"""Running values against a plain scan, with and without buckets."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators.running import running


def _plain(rows, k):
    """(key, at) -> (sum of n, newest passing v, last k of the passing v) over earlier rows of the key."""
    out, by = {}, {}
    for key, at, n, v, ok in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        seen = by.setdefault(key, [])
        passing = [x[1] for x in seen if x[2]]
        out[(key, at)] = (sum(x[0] or 0 for x in seen), passing[-1] if passing else None, passing[-k:])
        seen.append((n, v, ok))
    return out


@pytest.mark.parametrize("heavy_rows", [10**9, 20])
def test_running_equals_a_plain_scan(spark, heavy_rows):
    draw = random.Random(4)
    rows = [("hot", i, draw.choice([None, 1, 2]), draw.choice([None, f"v{i}"]), draw.choice([True, False, False, None])) for i in range(300)]
    rows += [(f"k{i % 7}", i, 1, f"w{i}", i % 3 == 0) for i in range(60)] + [(None, i, 1, f"n{i}", i % 2 == 0) for i in range(40)]
    rows += [("quiet", i, 1, "x", False) for i in range(30)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at int, n int, v string, ok boolean")
    out = running(
        df, "key", ["at"], F.floor(F.col("at") / 11).cast("int"), {"total": F.col("n")}, {"last": (F.col("ok"), F.col("v"))},
        {"tail": (F.col("ok"), F.col("v"), 4)}, heavy_rows=heavy_rows)
    assert out.columns == [*df.columns, "total", "last", "tail"]
    got = {(r["key"], r["at"]): (r["total"], r["last"], r["tail"]) for r in out.collect()}
    assert got == _plain(rows, 4)
    assert running(df.limit(0), "key", ["at"], F.lit(0), {"total": F.col("n")}).count() == 0


def test_steps_equal_those_with_copied_histories(spark, folder):
    """Ids and running counts of user turns against the rows that carry whole histories."""
    from sessionloom.sources import derived

    steps = derived.session_steps(spark, folder, {"n": lambda e: F.lit(1)}, tails={"acted": (lambda e: e["name"].isNotNull(), 3)})
    got = sorted((r["id"], r["n"], [e["name"] for e in r["acted"]]) for r in steps.collect())
    whole = derived.sessions(spark, folder).select("id", "history").collect()
    assert got == sorted((r["id"], len(r["history"]), [e["name"] for e in r["history"] if e["name"]][-3:]) for r in whole)
    assert not {"history", "event"} & set(steps.columns)
