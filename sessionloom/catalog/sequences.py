"""Sequence functions over session histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog import oracle_events as O
from sessionloom.catalog.oracle import SESS, STEPS, join, sql, tail
from sessionloom.catalog.registry import query
from sessionloom.functions import events as E
from sessionloom.functions.results import result_type
from sessionloom.operators import keys
from sessionloom.operators.ordered import last_items
from sessionloom.schema import LABELS
from sessionloom.sources import derived


def _history():
    return F.col("history")


def _meta():
    return F.col("session_meta")


def _prompt():
    return F.col("current_prompt")


def _ws():
    return _meta()["workspace"]


def _acts(e):
    return E.filled(e["name"])


def _acts_n(e):
    return _acts(e).cast("int")


def _is_name(name):
    return lambda e: (e["name"] == name).cast("int")


def text(values, sep=" "):
    return F.array_join(values, sep)


@query("seq_last_prev_action", sql(SESS, O.FEAT, select=f"""
SELECT id, {O.nth_last('an', 1)} AS last_action, {O.nth_last('an', 2)} AS prev_action, len(an) AS n_actions FROM feat"""))
def seq_last_prev_action(spark, folder):
    rows = derived.session_steps(spark, folder, {"n": _acts_n}, tails={"acted": (_acts, 2)})
    an = F.transform("acted", lambda e: e["name"])
    return rows.select(
        "id", E.nth_last(an, 1).alias("last_action"), E.nth_last(an, 2).alias("prev_action"), F.col("n").cast("long").alias("n_actions"),
    )


@query("seq_action_tail", sql(STEPS, select=f"""
SELECT id, {O.tail_text('actions', 3)} AS tail3, {O.tail_text('actions', 6)} AS tail6, {O.tail_text('actions', 8)} AS tail8,
  {O.tail_text('actions', 16)} AS tail16 FROM ev"""))
def seq_action_tail(spark, folder):
    steps = derived.event_steps(spark, folder)
    return steps.select("id", *[E.tail_text(F.col("actions"), k).alias(f"tail{k}") for k in (3, 6, 8, 16)])


@query("seq_action_ngrams", sql(STEPS, "gr AS (SELECT *, " + O.groups_of("actions") + " AS groups FROM ev)", select=f"""
SELECT id, {join(tail(O.ngrams('actions', 2, '>'), 8))} AS bigrams, {join(tail(O.ngrams('actions', 3, '__'), 8))} AS trigrams,
  {join(tail(O.ngrams('groups', 2, '>'), 8))} AS group_bigrams FROM gr"""))
def seq_action_ngrams(spark, folder):
    steps = derived.event_steps(spark, folder).withColumn("groups", F.transform("actions", lambda a: keys.action_group(a)))
    last8 = lambda c: text(last_items(c, 8))
    return steps.select(
        "id",
        last8(E.ngrams(F.col("actions"), 2, ">")).alias("bigrams"),
        last8(E.ngrams(F.col("actions"), 3, "__")).alias("trigrams"),
        last8(E.ngrams(F.col("groups"), 2, ">")).alias("group_bigrams"),
    )


@query("seq_last_nonempty", sql(SESS, O.FEAT, select=f"""
SELECT id, lr AS last_result, lu AS last_user, lus AS last_user_said, {O.last_args(180)} AS last_args FROM feat"""))
def seq_last_nonempty(spark, folder):
    rows = derived.session_steps(spark, folder, newest={
        "result": lambda e: E.filled(e["result_summary"]), "user": lambda e: e["role"] == "user",
        "said": lambda e: (e["role"] == "user") & E.filled(e["content"]), "args": lambda e: _acts(e) & E.has_args(e["args"])})
    of = lambda c: F.array(F.col(c))
    return rows.select(
        "id", E.last_result(of("result")).alias("last_result"), E.last_user(of("user")).alias("last_user"),
        E.last_user(of("said"), need_content=True).alias("last_user_said"), E.last_args(of("args"), 180).alias("last_args"),
    )


def _trace_sql(k):
    lines = (
        "list_transform(" + tail(O.ACTS, k) + ", lambda e: 'act=' || e.name || ' group=' || " + O.GROUP_CASE("e.name")
        + " || ' args=' || coalesce(left(" + O.args_json("e.args") + ", 140), 'none') || ' res_type=' || "
        + O.result_type("e.name", "lower(coalesce(" + O.compact("e.res", 500) + ", ''))")
        + " || ' res=' || " + O.compact("e.res", 120) + ")"
    )
    return lines


def trace_lines(history, k=14):
    """Newest k actions with group, arguments, result type and result."""
    return F.transform(
        last_items(E.acts(history), k),
        lambda e: F.concat(
            F.lit("act="), e["name"], F.lit(" group="), keys.action_group(e["name"]),
            F.lit(" args="), F.when(E.has_args(e["args"]), E.compact(E.args_json(e["args"]), 140)).otherwise("none"),
            F.lit(" res_type="), result_type(e["name"], E.compact(e["result_summary"], 500)),
            F.lit(" res="), E.compact(e["result_summary"], 120),
        ),
    )


@query("seq_event_render", sql(SESS, select=f"""
SELECT id, {join(O.event_lines(6), ' | ')} AS lines6, {join(_trace_sql(14), ' | ')} AS trace14 FROM sess"""))
def seq_event_render(spark, folder):
    rows = derived.session_steps(spark, folder, tails={"acted": (_acts, 14)})
    return rows.select(
        "id", text(E.event_lines(F.col("acted"), 6), " | ").alias("lines6"), text(trace_lines(F.col("acted")), " | ").alias("trace14")
    )


@query("seq_recent_args", sql(SESS, select=f"""
SELECT id, {join(O.arg_values(O.PATH_KEYS, 3))} AS paths3, {join(O.arg_values(O.CMD_KEYS, 6))} AS cmds,
  {join(O.arg_values(O.TARGET_KEYS, 6))} AS targets, {join(O.arg_values(['files', 'path'], 2))} AS files2 FROM sess"""))
def seq_recent_args(spark, folder):
    return derived.sessions(spark, folder).select(
        "id",
        text(E.arg_values(_history(), E.PATH_KEYS, 3)).alias("paths3"),
        text(E.arg_values(_history(), E.CMD_KEYS, 6)).alias("cmds"),
        text(E.arg_values(_history(), E.TARGET_KEYS, 6)).alias("targets"),
        text(E.arg_values(_history(), ["files", "path"], 2)).alias("files2"),
    )


_VALUES = "list_concat(list_concat(open_files, list_transform(open_files, lambda p: upper(p))), list_concat(['', ' x  y '], open_files[1:1]))"


@query("seq_dedupe_tail", sql(SESS, select=f"""
SELECT id, {join(O.dedupe(_VALUES, 3))} AS folded, {join(O.dedupe(_VALUES, 8, fold_case=False))} AS exact FROM sess"""))
def seq_dedupe_tail(spark, folder):
    opened = E.open_files(_meta())
    values = F.concat(opened, F.transform(opened, lambda p: F.upper(p)), F.array(F.lit(""), F.lit(" x  y ")), F.slice(opened, 1, 1))
    return derived.sessions(spark, folder).select(
        "id", text(E.dedupe_tail(values, 3)).alias("folded"), text(E.dedupe_tail(values, 8, fold_case=False)).alias("exact")
    )


@query("seq_recent_paths", sql(SESS, select=f"""
SELECT id, {join(O.recent_paths(2))} AS paths2, {join(O.recent_paths(10))} AS paths10, {join(O.recent_paths(8, 'heads'))} AS heads8,
  {join(O.recent_paths(10, 'inspect'))} AS inspect10 FROM sess"""))
def seq_recent_paths(spark, folder):
    return derived.sessions(spark, folder).select(
        "id",
        text(E.recent_paths(_history(), _meta(), 2)).alias("paths2"),
        text(E.recent_paths(_history(), _meta(), 10)).alias("paths10"),
        text(E.recent_paths(_history(), _meta(), 8, "heads")).alias("heads8"),
        text(E.recent_paths(_history(), _meta(), 10, "inspect")).alias("inspect10"),
    )


@query("seq_recent_patterns", sql(SESS, select=f"""
SELECT id, {join(O.recent_patterns(6))} AS patterns6, {join(O.recent_patterns(6, 'heads'))} AS heads6,
  {join(O.recent_patterns(8, 'inspect'))} AS inspect8 FROM sess"""))
def seq_recent_patterns(spark, folder):
    return derived.sessions(spark, folder).select(
        "id",
        text(E.recent_patterns(_history(), _prompt(), 6)).alias("patterns6"),
        text(E.recent_patterns(_history(), _prompt(), 6, "heads")).alias("heads6"),
        text(E.recent_patterns(_history(), _prompt(), 8, "inspect")).alias("inspect8"),
    )


@query("seq_path_flags", sql(SESS, f"pp AS (SELECT *, {O.recent_paths(6)} AS paths FROM sess)", select=f"""
SELECT id, {join('list_sort(' + O.READ_PATHS + ')')} AS read_paths, {O.overlaps('paths', O.READ_PATHS)} AS already_read,
  {O.overlaps('paths', 'open_files')} AS is_open FROM pp"""))
def seq_path_flags(spark, folder):
    rows = derived.sessions(spark, folder).select("id", "history", "session_meta", E.recent_paths(_history(), _meta(), 6).alias("paths"))
    reads = E.read_paths(_history())
    return rows.select(
        "id", text(F.array_sort(reads)).alias("read_paths"), E.overlaps(F.col("paths"), reads).alias("already_read"),
        E.overlaps(F.col("paths"), E.open_files(_meta())).alias("is_open"),
    )


@query("seq_history_counters", sql(SESS, O.FEAT, select=f"""
SELECT id, {O.sorted_counts('an')} AS counts, {O.USER_TURNS} AS user_turns, {O.FAILED_RESULTS} AS failed_results,
  {O.count_of('an', 'apply_patch', 'edit_file', 'write_file')} AS patches, {O.count_of('an', 'run_tests')} AS tests,
  {O.failure_terms()} AS failure_terms, len(evs) AS history_len FROM feat"""))
def seq_history_counters(spark, folder):
    named = {f"n_{name}": _is_name(name) for name in LABELS}
    rows = derived.session_steps(
        spark, folder,
        named | {"users": lambda e: (e["role"] == "user").cast("int"), "failed": lambda e: E.failed(e["result_summary"]).cast("int"),
                 "events": lambda e: F.lit(1)},
        tails={"told": (lambda e: (e["role"] == "assistant_action") & (F.trim(e["result_summary"]) != ""), 8)})
    shown = [F.when(F.col(f"n_{name}") > 0, F.concat(F.lit(f"{name}:"), F.col(f"n_{name}").cast("string"))) for name in sorted(LABELS)]
    n = lambda c: c.cast("long")
    return rows.select(
        "id", F.concat_ws(" ", *shown).alias("counts"), n(F.col("users")).alias("user_turns"), n(F.col("failed")).alias("failed_results"),
        n(F.col("n_apply_patch") + F.col("n_edit_file") + F.col("n_write_file")).alias("patches"),
        n(F.col("n_run_tests")).alias("tests"), n(E.failure_terms(F.col("told"))).alias("failure_terms"),
        n(F.col("events")).alias("history_len"),
    )


@query("seq_open_files", sql(SESS, select=f"""
SELECT id, {join(tail('open_files', 2))} AS newest2, {join('list_transform(open_files, lambda p: ' + O.base_name('p') + ')')} AS names,
  {join(O.sorted_exts('open_files'))} AS exts FROM sess"""))
def seq_open_files(spark, folder):
    opened = E.open_files(_meta())
    return derived.sessions(spark, folder).select(
        "id", text(last_items(opened, 2)).alias("newest2"), text(F.transform(opened, E.base_name)).alias("names"),
        text(E.sorted_extensions(opened)).alias("exts"),
    )
