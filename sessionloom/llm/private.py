"""Personal data: patterns for well-formed identifiers, and bootstrapped contextual extraction for the rest.

Everything is a DataFrame expression. Well-formed identifiers and key-like strings are the seeds. The words and
signs around each occurrence are lexical patterns; patterns and instances (distinct strings) form a graph whose
confidences are computed in rounds until none changes: a pattern is as sure as its instances are on average, an instance
as sure as its best pattern. Occurrences of any string within a sure pattern are reported.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.llm.common import stage, with_uid

# Kinds in their order. `secret` is the kind of keys and passwords, found by context alone.
KINDS = ("email", "ip", "card", "phone", "secret")

# The same languages as the plain patterns, written so that Java's matcher neither recurses nor rescans: possessive
# runs, and starts only where a run starts or the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
# On texts whose doubled separators are broken (see `broken`), digits with single separators are a plain run.
CARD = r"[0-9][0-9 -]*[0-9]"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
# Strings that may be identifiers: groups of digits or of an IBAN with single spaces (the first may be in brackets),
# or a run without space or quotes that holds a digit.
ENDED = r"(?=[\s\"'<>,;()\[\].:!?]|$)"
DIGITS = r"[0-9]++(?:[./-][0-9]++)*+"
GROUPS = rf"(?:\([0-9]++\)|{DIGITS})(?:[ ]{DIGITS}{ENDED})++|[A-Z]{{2}}[0-9]{{2}}(?:[ ][0-9A-Z]{{4}}{ENDED})++(?:[ ][0-9A-Z]{{1,3}}{ENDED})?+"
TOKEN = rf"(?<![^\s\"'<>,;()\[\]])(?:{GROUPS}|[^\s\"'<>,;()\[\]0-9]*+[0-9][^\s\"'<>,;()\[\]]*+)"
SECRET = r"^(?:AKIA[0-9A-Z]{16}|(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,})$"
# A key with its sign at the start of a token.
KEYED = r"^[\p{L}_.-]{2,24}[=:]+(?=.)"

# Characters of context on each side.
AROUND = 48
# Distinct sure instances that a pattern needs, confidence that makes a pattern or an instance count.
SUPPORT, SURE = 3, 0.8
# Rounds end when no pattern's confidence moves by more than this; a warning is given if they have not after ROUNDS.
SETTLED, ROUNDS = 1e-10, 100
# Unseen instances that a pattern is doubted with.
DOUBT = 0.5


def spans_of(text: Column, pattern: str, original: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,form>>, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("form")))
    empty = F.expr("named_struct('pos', 0, 'out', cast(array() as array<struct<start:int,end:int,form:string>>))")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.length(x["form"])
        span = F.struct(start.alias("start"), end.alias("end"), x["form"].alias("form"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


def broken(text: Column) -> Column:
    """The text with each separator that another one follows replaced by a control character, one for one."""
    return F.regexp_replace(text, "[ -](?=[ -])", "\u0001")


def digits(form: Column) -> Column:
    return F.regexp_replace(form, "[^0-9]", "")


NONE = "cast(array() as array<struct<start:int,end:int,form:string>>)"


def base_spans(text: Column) -> dict[str, Column]:
    """Valid well-formed identifiers of each kind; the costly patterns run only where a cheap test passes."""
    none = F.expr(NONE)
    ip_ok = lambda x: F.forall(F.split(x["form"], r"\."), lambda p: p.rlike(IP_PART))
    card_ok = lambda x: F.length(digits(x["form"])).between(16, 19) & F.call_function("luhn_check", digits(x["form"]))
    phone_ok = lambda x: F.length(digits(x["form"])).between(8, 15)
    return {
        "email": F.when(F.instr(text, "@") > 0, spans_of(text, EMAIL)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(spans_of(text, IP), ip_ok)).otherwise(none),
        "card": F.when(text.rlike("[0-9](?:[ -]?[0-9]){15}"), F.filter(spans_of(broken(text), CARD), card_ok)).otherwise(none),
        "phone": F.when(text.rlike(r"\+[0-9]"), F.filter(spans_of(text, PHONE), phone_ok)).otherwise(none),
    }


def _context(text: Column, x: Column, kind: Column) -> Column:
    """An occurrence with its lexical patterns: the word and signs before it, these with the word after it, two words."""
    left = F.lower(F.substring(text, F.greatest(F.lit(1), x["start"] + 1 - AROUND), F.least(x["start"], F.lit(AROUND))))
    right = F.lower(F.substring(text, x["end"] + 1, F.lit(AROUND)))
    before = F.regexp_replace(F.regexp_extract(left, r"([\p{L}_]+[^\p{L}0-9]*)$", 1), r"\s+", " ")
    two = F.regexp_replace(F.regexp_extract(left, r"([\p{L}_]+[^\p{L}0-9]+[\p{L}_]+[^\p{L}0-9]*)$", 1), r"\s+", " ")
    after = F.regexp_replace(F.regexp_extract(right, r"^([^\p{L}0-9]*[\p{L}_]+)", 1), r"\s+", " ")
    named = F.array(
        F.when(before != "", F.concat(F.lit("before:"), before)),
        F.when(two != "", F.concat(F.lit("two:"), two)),
        F.when((before != "") & (after != ""), F.concat(F.lit("around:"), before, F.lit("|"), after)))
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(x["form"]).alias("instance"),
                    kind.alias("kind"), F.filter(named, lambda p: p.isNotNull()).alias("patterns"))


def occurrences(text: Column, base: Column) -> Column:
    """Base spans (with their kind) and other identifier-like strings (null kind, or `secret`), with contexts.

    `base` is array<struct<kind,start,end,form>>.
    """
    def trimmed(x: Column) -> Column:
        """Without a key before it (which stays as context) and without signs behind it."""
        key = F.length(F.regexp_extract(x["form"], KEYED, 0))
        form = F.regexp_replace(F.substring(x["form"], key + 1, F.length(x["form"])), r"[^\p{L}0-9]+$", "")
        return F.struct((x["start"] + key).alias("start"), (x["start"] + key + F.length(form)).alias("end"), form.alias("form"))

    tokens = F.when(text.rlike("[0-9]"), F.transform(spans_of(text, TOKEN), trimmed)).otherwise(F.expr(NONE))
    free = F.filter(tokens, lambda x: (x["form"] != "") & ~F.exists(
        base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return F.concat(
        F.transform(base, lambda b: _context(text, b, b["kind"])),
        F.transform(free, lambda x: _context(text, x, F.when(x["form"].rlike(SECRET), F.lit("secret")))))


def _of_kind(kind: str):
    """Names the kind of a span. A function of one argument: a second would be taken for the place in the array."""
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["form"].alias("form"))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) of the sure patterns, from (pattern, instance, kind); kind is null but for seeds.

    Distinct edges are weighed, so copies of a text do not vote. Each round is two aggregates and two joins
    over the edges, with all instances learned so far as voters. Only patterns with too few instances of any kind,
    seeds or not, are left out at the start: they can never count.
    """
    distinct = stage(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    size = stage(distinct.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT), "sizes")
    graph = stage(distinct.join(size, "pattern", "left_semi"), "graph")
    seeds = graph.where("kind is not null").select("pattern", "instance", "kind").withColumn("confidence", F.lit(1.0))
    unknown = graph.where("kind is null").select("pattern", "instance")
    voters, sure = seeds, None
    for _ in range(rounds):
        held = voters.groupBy("pattern", "kind").agg(
            F.sum("confidence").alias("mass"), F.count(F.when(F.col("confidence") >= SURE, 1)).alias("support"))
        before, sure = sure, (
            held.where(F.col("support") >= SUPPORT).join(size, "pattern")
            .withColumn("confidence", F.col("mass") / (F.col("n") + DOUBT)).where(F.col("confidence") >= SURE)
            .groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("best"))
            .select("pattern", "best.kind", "best.confidence"))
        sure = stage(sure, "patterns")
        if before is None:
            moved = sure
        else:
            old = before.select("pattern", F.col("kind").alias("_kind"), F.col("confidence").alias("_confidence"))
            same = F.col("kind").eqNullSafe(F.col("_kind")) & (F.abs(F.col("confidence") - F.col("_confidence")) <= SETTLED)
            moved = sure.join(old, "pattern", "full").where(~F.coalesce(same, F.lit(False)))
        if not moved.limit(1).count():
            break
        learned = unknown.join(sure, "pattern").groupBy("instance").agg(F.max(F.struct("confidence", "kind")).alias("best"))
        voters = seeds.union(unknown.join(learned, "instance").select("pattern", "instance", "best.kind", "best.confidence"))
    else:
        warnings.warn(f"patterns still change after {rounds} rounds", stacklevel=2)
    return sure


def private_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(rows, patterns): rows are (_uid, id, *carry, base, found), each an array<struct<kind,start,end>>.

    `base` has the well-formed identifiers by kind, then start; `found` those that sure patterns add, which
    overlap no base span. A null or empty text has neither. Ids may be null or repeated; every row gets its
    own result. Only columns named in `carry` are kept besides the id. Texts are read once; rows with
    something to decide meet the patterns by joins on narrow rows, the others go through.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    kept = [c for c in read.columns if c != "_text"]
    per_kind = read.select("*", *[c.alias(f"_{k}") for k, c in base_spans(text).items()])
    base = F.concat(*[F.transform(f"_{k}", _of_kind(k)) for k in KINDS[:4]])
    with_base = per_kind.select(*kept, "_text", base.alias("base"))
    rows = with_uid(with_base.select(
        *kept, F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"))).alias("base"),
        occurrences(text, F.col("base")).alias("seen")), "private")
    places = stage(rows.where(F.size("seen") > 0).select("_uid", F.explode("seen").alias("o")).select("_uid", "o.*"), "places")
    edges = places.select(F.explode("patterns").alias("pattern"), "instance", "kind")
    known = patterns(edges)
    hits = (
        places.where("kind is null or kind = 'secret'").select("_uid", "start", "end", F.explode("patterns").alias("pattern"))
        .join(known, "pattern").groupBy("_uid", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
        .groupBy("_uid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "best.kind"))).alias("f")))
    order = F.array(*[F.lit(k) for k in KINDS])
    found = F.array_sort(
        F.transform("f", lambda x: F.struct(F.array_position(order, x["kind"]).alias("o"), x["start"].alias("start"),
                                            x["end"].alias("end"), x["kind"].alias("kind"))))
    spans = stage(hits.select("_uid", F.transform(found, lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found")), "found")
    names = ["_uid", F.col("_id").alias(id_col), *[F.col(f"_carry_{c}").alias(c) for c in carry], "base"]
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    open_rows = rows.where(F.size("seen") > 0).join(spans, "_uid", "left").select(*names, F.coalesce("found", none).alias("found"))
    closed = rows.where(F.size("seen") == 0).select(*names, none.alias("found"))
    return open_rows.unionByName(closed), known


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def all_spans(base: Column, found: Column) -> Column:
    """Base and found spans by kind as listed, then start."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(F.concat(base, found), lambda x: F.struct(
        F.array_position(order, x["kind"]).alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <KIND>; of overlapping spans the first, then the longer one counts."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    begin = F.expr("named_struct('pos', 0, 'out', cast('' as string))")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"])
        put = F.concat(acc["out"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        skip = x["start"] < acc["pos"]
        return F.struct(F.when(skip, F.greatest(acc["pos"], -x["back"])).otherwise(-x["back"]).alias("pos"),
                        F.when(skip, acc["out"]).otherwise(put).alias("out"))

    return F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
