import pytest
from pyspark.sql import functions as F

from sessionloom.operators import mining
from sessionloom.schema import SESSION


def event(role=None, content=None, name=None, args=None, result=None):
    return (role, content, name, args, result)


def rows_of(spark, *rows):
    """rows: (id, history, user_tier, language_pref)"""
    data = [
        (i, "later", h, (tier, pref, 9000.0, None, None, (["app.py"], None, None, None, None))) for i, h, tier, pref in rows
    ]
    return spark.createDataFrame(data, SESSION).withColumn("row_no", F.monotonically_increasing_id())


def known_of(spark, labels=()):
    return spark.createDataFrame(list(labels), "id string, action string")


def test_only_the_missing_past_pair_is_mined_and_dynamic_state_is_dropped(spark):
    rows = rows_of(spark, ("sess_sim_demo-step_03", [
        event("user", "show files"), event(name="list_directory", args={"path": "."}, result="3 files"),
        event("user", "read app.py"), event(name="read_file", args={"path": "app.py"}, result="20 lines"),
    ], "pro", "en"))
    cons = mining.consolidate(mining.observations(rows), known_of(spark, [("sess_sim_demo-step_01", "list_directory")]))
    mined = mining.mined_rows(cons, rows).collect()
    report = mining.mining_report(cons, rows).collect()[0]
    assert (report["overlap_checked"], report["overlap_mismatches"], report["mined_rows"]) == (1, 0, 1)
    row = mined[0]
    assert (row["id"], row["action"], row["current_prompt"]) == ("sess_sim_demo-step_02", "read_file", "read app.py")
    assert len(row["history"]) == 2
    assert row["session_meta"].asDict() == {"language_pref": "en", "user_tier": "pro"}


def test_windows_that_disagree_are_rejected(spark):
    rows = rows_of(
        spark,
        ("sess_au_demo-step_02", [event("user", "find it"), event(name="grep_search")], None, None),
        ("sess_au_demo-step_03", [event("user", "find it"), event(name="glob_pattern")], None, None),
    )
    cons = mining.consolidate(mining.observations(rows), known_of(spark))
    assert mining.mined_rows(cons, rows).count() == 0
    assert mining.mining_report(cons, rows).collect()[0]["conflict_keys"] == 1


def test_walk_rules(spark):
    rows = rows_of(spark, ("s-step_09", [
        event(name="run_bash"),  # nobody asked: raises the step only
        event("user", "first"), event("user", "second"),  # the last one waits
        event(name="no_such_action"),  # skipped
        event(name="read_file"),
        event("user", "   "),  # blank: not waiting
        event(name="edit_file"),
        event("system", "note"), event("user", "third"), event(name="run_tests"),
    ], None, None))
    got = [tuple(r) for r in mining.observations(rows).orderBy("step").select("step", "prompt", "action", "user_at").collect()]
    assert got == [(2, "second", "read_file", 2), (4, "third", "run_tests", 8)]


def test_shortest_history_wins_then_source_order(spark):
    pair = [event("user", "go"), event(name="read_file")]
    rows = rows_of(
        spark,
        ("s-step_05", pair + [event("user", "x"), event(name="run_bash")], "a", None),
        ("s-step_02", pair, "b", None),
        ("s-step_03", pair, "c", None),
    )
    rows = rows.withColumn("row_no", F.when(F.col("id") == "s-step_05", 0).when(F.col("id") == "s-step_02", 1).otherwise(2))
    cons = mining.consolidate(mining.observations(rows), known_of(spark)).where("step = 1").collect()[0]
    assert cons["source_id"] == "s-step_02"


def test_strict_report_stops_on_mismatch(spark):
    rows = rows_of(spark, ("s-step_02", [event("user", "go"), event(name="read_file")], None, None))
    cons = mining.consolidate(mining.observations(rows), known_of(spark, [("s-step_01", "run_bash")]))
    with pytest.raises(Exception, match="differ"):
        mining.mining_report(cons, rows, strict=True).collect()
