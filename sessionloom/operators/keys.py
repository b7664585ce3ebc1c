"""Row keys: domain, root session, step number and band, label and group codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.schema import GROUP_OF, LABELS, STABLE_META, STACK, lookup, strings


def domain(row_id: Column, prefix: str = STACK["au_prefix"]) -> Column:
    """'au' for ids with the prefix, 'sim' for everything else."""
    return F.when(row_id.startswith(prefix), "au").otherwise("sim")


def root_session(row_id: Column, variant: str = "strict") -> Column:
    """Session part of a step id.

    first:  text before the first "-step_"
    last:   text before the last "-step_"
    strict: text before the last "-step_", which digits must follow to the end, else the whole id
    strip:  the id without a trailing "-step_<digits>"
    """
    if variant == "first":
        return F.substring_index(row_id, "-step_", 1)
    if variant == "last":
        return F.regexp_replace(row_id, r"(?s)^(.*)-step_.*$", "$1")
    if variant == "strict":
        # "$" also matches before a final line break, as the pattern "\d+$" does there.
        return F.regexp_replace(row_id, r"^(.+)-step_\p{Nd}+\n?$", "$1")
    if variant == "strip":
        return F.regexp_replace(row_id, r"-step_\p{Nd}+(?=\n?$)", "")
    raise ValueError(f"unknown variant {variant}")


def step_number(row_id: Column) -> Column:
    """Digits after the trailing "-step_", -1 when there are none."""
    return F.coalesce(F.regexp_extract(row_id, r"-step_(\p{Nd}+)$", 1).try_cast("int"), F.lit(-1))


def step_band(step: Column) -> Column:
    return (
        F.when(step <= 1, "s1")
        .when(step <= 3, "s2_3")
        .when(step <= 6, "s4_6")
        .when(step <= 10, "s7_10")
        .otherwise("s11p")
    )


def action_group(action: Column, respond_apart: bool = False) -> Column:
    """Semantic group of an action, 'other' when unknown.

    respond_apart: respond_only is named apart from the reason head.
    """
    group = F.coalesce(F.try_element_at(lookup(GROUP_OF), action), F.lit("other"))
    if respond_apart:
        return F.when(action == "respond_only", "reason:respond").otherwise(group)
    return group


def encode_label(label: Column, classes: list[str] = LABELS) -> Column:
    """Class index of a label given as text or as an index in text form; null when unknown."""
    named = F.array_position(strings(classes), label.cast("string"))
    return F.when(named > 0, (named - 1).cast("int")).otherwise(label.cast("string").try_cast("int"))


def decode_label(index: Column, classes: list[str] = LABELS) -> Column:
    return F.get(strings(classes), index.cast("int"))


def stable_meta(meta: Column, keep_dynamic: bool = False) -> Column:
    """Metadata known to hold for earlier steps too; everything else is dropped.

    Of the stable keys only tier and preference sit at the top level of session_meta.
    """
    if keep_dynamic:
        return meta
    return F.struct(*[meta[k].alias(k) for k in STABLE_META if k in ("language_pref", "user_tier")])


def first_sessions(df: DataFrame, session: str, position: str, n: int) -> DataFrame:
    """All rows of the n sessions that appear first."""
    wanted = df.groupBy(session).agg(F.min(position).alias("_first")).orderBy("_first").limit(n)
    return df.join(F.broadcast(wanted.select(session)), session, "left_semi")


def page(df: DataFrame, position: str, start: int, count: int | None) -> DataFrame:
    """Rows start .. start+count-1 in position order."""
    ordered = df.orderBy(position).offset(start)
    return ordered if count is None else ordered.limit(count)
