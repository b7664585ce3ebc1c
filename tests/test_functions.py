from pyspark.sql import functions as F

from sessionloom.functions import events as E
from sessionloom.functions import keywords as KW
from sessionloom.functions import results as R
from sessionloom.functions import scalars as S
from sessionloom.functions import text as T
from sessionloom.functions.rewrite import rule_rewrite, strip_output
from sessionloom.operators import keys, textmodel
from sessionloom.schema import EVENT, strings


def one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


def history(spark, *args_list):
    data = [([("assistant_action", None, "read_file", a, None) for a in args_list],)]
    return spark.createDataFrame(data, __import__("pyspark").sql.types.StructType().add("h", __import__("pyspark").sql.types.ArrayType(EVENT)))


def test_dedupe_keeps_the_oldest_survivors(spark):
    dedupe = lambda values, limit: one(spark, E.dedupe_tail(strings(values), limit))
    assert dedupe(["p1", "p2", "p3", "p4"], 2) == ["p1", "p2"]
    assert dedupe(["A", "b", "a"], 8) == ["b", "a"]
    assert one(spark, E.dedupe_tail(strings(["A", "b", "a"]), 8, fold_case=False)) == ["A", "b", "a"]


def test_argument_values_drop_the_newest_when_over_full(spark):
    def values(*lists):
        df = history(spark, *lists)
        return df.select(E.arg_values(F.col("h"), ["path", "paths"], 2).alias("v")).collect()[0]["v"]

    assert values({"path": "e1"}, {"path": "e2"}, {"paths": '["x", "y", "z"]'}) == ["z", "y"]
    assert values({"path": "e1"}, {"path": "e2"}, {"path": "e3"}) == ["e2", "e3"]


def test_glob_in_brackets_is_no_list(spark):
    df = history(spark, {"path": "[ab]*.py"})
    assert df.select(E.arg_values(F.col("h"), ["path"], 2).alias("v")).collect()[0]["v"] == ["[ab]*.py"]


def test_arguments_as_json(spark):
    df = history(spark, {"b": 'say "hi"\n', "a": '["x","y"]'})
    got = df.select(E.args_json(F.col("h")[0]["args"]).alias("v")).collect()[0]["v"]
    assert got == '{"a": ["x", "y"], "b": "say \\"hi\\"\\n"}'


def test_needles_are_plain_text(spark):
    assert one(spark, T.has_any(F.lit("LOOK: **/x"), ["**/"]))
    assert not one(spark, T.has_any(F.lit("abcpy"), ["*.py", "c.p"]))
    assert one(spark, T.has_any(F.lit("파일 열어"), ["열어"]))


def test_collapse_knows_unicode_blanks(spark):
    assert one(spark, T.collapse(F.lit("  a  b\x1c c "))) == "a b c"
    assert one(spark, T.word_count(F.lit("a　b c"))) == 3


def test_root_variants(spark):
    def roots(value):
        return [one(spark, keys.root_session(F.lit(value), v)) for v in ("first", "last", "strict", "strip")]

    assert roots("s-step_01-step_02") == ["s", "s-step_01", "s-step_01", "s-step_01"]
    assert roots("s-step_x") == ["s", "s", "s-step_x", "s-step_x"]
    assert roots("plain") == ["plain"] * 4
    assert one(spark, keys.step_number(F.lit("s-step_12"))) == 12
    assert one(spark, keys.step_number(F.lit("s"))) == -1


def test_sentences(spark):
    protected = lambda t: one(spark, S.sentences_protected(F.lit(t)))
    masked = lambda t: one(spark, S.sentences_masked(F.lit(t)))
    assert protected("") == 0
    assert protected("open app.py v1.2. then call x.run() now! ok?") == 3
    assert protected("...") == 1
    assert masked("open app.py v1.2. then stop! ok?") == 3


def test_counts_and_status(spark):
    assert one(spark, R.first_count(F.lit("Patched 3 files"), "files")) == 3
    assert one(spark, R.first_count(F.lit("read app.py (40L)"), "lines")) == 40
    added, removed = R.added_removed(F.lit("7 insertions, 2 deletions"))
    assert (one(spark, added), one(spark, removed)) == ("le_10", "le_2")
    assert one(spark, R.status(F.lit("exit code 2"))) == "fail"
    assert one(spark, R.status_with_empty(F.lit("no matches"))) == "empty"


def test_rewrite_and_output(spark):
    assert one(spark, rule_rewrite(F.lit("Find the RUN"))) == "look for the RUN"
    assert one(spark, rule_rewrite(F.lit("hello"))) == "please hello"
    assert one(spark, rule_rewrite(F.lit("안녕"))) == "안녕 확인 부탁해"
    assert one(spark, strip_output(F.lit('1. "quoted"'))) == "quoted"


def test_sections_last_of_equal_names_wins(spark):
    text = "skip\n[A]\nx\ny\n[B]\n\n[A]\nz"
    assert one(spark, S.sections(F.lit(text))) == {"B": "", "A": "z"}


def test_char_terms_of_short_words(spark):
    assert one(spark, textmodel.char_terms(F.lit("a bcd"), 3, 5)) == [" a ", " bc", "bcd", "cd ", " bcd", "bcd ", " bcd "]
    assert one(spark, textmodel.char_terms(F.lit("a"), 4, 5)) == [" a "]


def test_keyword_tokens(spark):
    assert one(spark, KW.keyword_tokens(F.lit("please grep the *.py"))) == "KW_GREP_SEARCH KW_GLOB_PATTERN"
