"""URL filter: rules first, then naive Bayes over words that a unigram Viterbi finds in concatenated host names."""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.llm.common import stage, with_uid
from sessionloom.sources.staging import small

# Longest word of the segmentation; a longer run is split.
LONGEST = 20
# Additive smoothing of token counts, and the score from which a url is blocked.
SMOOTH, BLOCK_AT = 1.0, 0.5


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the url's path begins with `path`."""

    host: str
    path: str
    verdict: str


# The rules of the query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. The list is short and goes into the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def page_words(html: Column) -> Column:
    """Runs of letters a-z of a page's text, markup left out."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(html, r"<[^>]*+>", " ")), F.lit("[a-z]+"), F.lit(0))


def unigrams(texts: DataFrame, words: Column) -> DataFrame:
    """(word, n): counts over all texts of the words that the segmentation may use."""
    return (
        texts.select(F.explode_outer(words).alias("word"))
        .where(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))
    )


def best_split(text: str, known: list[tuple[int, int, int]], total: int) -> list[str]:
    """Most likely split of a run of letters; `known` has (start, length, count) of its words.

    An unknown word of length m costs as much as 1 / (total * 10**m), so that known words win.
    """
    logs = {(s, m): math.log(n / total) for s, m, n in known}
    best, back = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for m in range(1, min(LONGEST, end) + 1):
            cost = logs.get((end - m, m))
            if cost is None:
                cost = -math.log(total) - m * math.log(10.0)
            if best[end - m] + cost > best[end]:
                best[end], back[end] = best[end - m] + cost, m
    out, end = [], len(text)
    while end:
        out.append(text[end - back[end] : end])
        end -= back[end]
    return out[::-1]


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words) for distinct runs of letters: their parts meet the unigrams in a join, the rest is per run."""
    total = words.agg(F.sum("n")).first()[0] or 1
    length = F.length("run")
    starts = runs.select("run", F.explode(F.sequence(F.lit(0), length - 1)).alias("start"))
    parts = starts.select("run", "start", F.explode(
        F.sequence(F.lit(1), F.least(F.lit(LONGEST), length - F.col("start")))).alias("len"))
    parts = parts.withColumn("word", F.substring(F.col("run"), F.col("start") + 1, F.col("len")))
    found = parts.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("start", "len", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, known: pd.Series) -> pd.Series:
        def triples(k):
            return [(x["start"], x["len"], x["n"]) for x in k] if k is not None else []

        return pd.Series([best_split(r, triples(k), total) for r, k in zip(run, known, strict=True)])

    return runs.join(found, "run", "left").select("run", split("run", "known").alias("words"))


def url_filter(
    urls: DataFrame, texts: DataFrame, words: Column, rules: tuple[Rule, ...] = RULES,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, score) for each row.

    Urls that a rule decides also teach the classifier: a multinomial naive Bayes over the words of hosts
    (without their last label, which rules speak of) and of paths. `texts` and the expression `words` give the
    running text whose word counts guide the segmentation; all of it is counted. `score` is the
    probability of block. A null url, or one without `://`, has an empty host and path and no tokens; it
    gets the prior. With no taught url the score is 0.5 and the verdict block. Ids may be null or repeated.
    """
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    rows = with_uid(
        urls.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
        .select("_id", host.alias("host"), path.alias("path"))
        .select("*", longest_rule(F.col("host"), F.col("path"), rules).alias("fit"))
        .select("_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("by_rule")), "urls")
    hosts = stage(
        rows.groupBy("host").agg(
            F.count(F.when(F.col("by_rule") == "block", 1)).alias("block"),
            F.count(F.when(F.col("by_rule") == "allow", 1)).alias("allow"),
        ).select("*", F.regexp_extract_all(
            F.regexp_replace("host", r"\.?[^.]*$", ""), F.lit("[a-z]+"), F.lit(0)).alias("runs")), "hosts")
    counts = stage(unigrams(texts, words), "unigrams")
    runs = hosts.select(F.explode("runs").alias("run")).distinct()
    split = stage(segmented(runs, counts), "runs")
    host_tokens = stage(
        hosts.select("host", "block", "allow", F.explode("runs").alias("run")).join(small(split), "run")
        .select("host", "block", "allow", F.explode("words").alias("w"))
        .select("host", "block", "allow", F.concat(F.lit("host:"), "w").alias("token")), "host-tokens")
    path_tokens = rows.select(
        "_uid", "by_rule", F.explode(F.regexp_extract_all(
            F.regexp_replace(F.lower("path"), "[0-9]+", "0"), F.lit(r"[\p{L}0]+"), F.lit(0))).alias("w"),
    ).select("_uid", "by_rule", F.concat(F.lit("path:"), "w").alias("token"))
    taught = host_tokens.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).union(
        path_tokens.where("by_rule is not null").groupBy("token").agg(
            F.count(F.when(F.col("by_rule") == "block", 1)), F.count(F.when(F.col("by_rule") == "allow", 1)),
        )).where("block + allow > 0")
    taught = stage(taught, "token-counts")
    size = taught.agg(F.count("*"), F.sum("block"), F.sum("allow")).first()
    seen = hosts.agg(F.sum("block"), F.sum("allow")).first()
    kinds, n_block, n_allow = size[0], size[1] or 0, size[2] or 0
    prior = math.log(((seen[0] or 0) + SMOOTH) / ((seen[1] or 0) + SMOOTH))
    weight = (F.log((F.col("block") + SMOOTH) / F.lit(n_block + SMOOTH * (kinds + 1)))
              - F.log((F.col("allow") + SMOOTH) / F.lit(n_allow + SMOOTH * (kinds + 1))))
    weights = small(stage(taught.select("token", weight.alias("weight")), "weights"))
    by_host = host_tokens.join(weights, "token").groupBy("host").agg(F.sum("weight").alias("host_weight"))
    by_path = path_tokens.join(weights, "token").groupBy("_uid").agg(F.sum("weight").alias("path_weight"))
    scored = rows.join(small(stage(by_host, "host-weights")), "host", "left").join(by_path, "_uid", "left")
    log_odds = F.lit(prior) + F.coalesce("host_weight", F.lit(0.0)) + F.coalesce("path_weight", F.lit(0.0))
    score = 1 / (1 + F.exp(-log_odds))
    return scored.select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("by_rule", F.when(score >= BLOCK_AT, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"))
