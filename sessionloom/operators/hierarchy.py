"""Two-stage probabilities: group first, action inside the group."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sessionloom.functions.base import let
from sessionloom.functions.probs import mix, total
from sessionloom.schema import GROUP_OF, GROUPS


def members(classes: list[str], group: str, respond_apart: bool = False) -> list[int]:
    """Class indexes of a group, in class order."""
    return [
        i for i, c in enumerate(classes) if GROUP_OF.get(c) == group and not (respond_apart and c == "respond_only")
    ]


def group_mass(p: Column, classes: list[str]) -> Column:
    """Probability of each group, in the order of GROUPS."""
    return F.array(*[_sum_at(p, members(classes, g)) for g in GROUPS])


def _sum_at(p: Column, indexes: list[int]) -> Column:
    out = F.lit(0.0)
    for i in indexes:
        out = out + F.get(p, F.lit(i))
    return out


def inside(p: Column, indexes: list[int], floor: float = 1e-12) -> Column:
    """The vector restricted to some classes and divided by its mass there."""
    part = F.array(*[F.get(p, F.lit(i)) for i in indexes])
    return let(part, lambda v: let(F.greatest(total(v), F.lit(floor)), lambda s: F.transform(v, lambda x: x / s)))


def hierarchical(group_p: Column, specialists: dict[str, Column], classes: list[str]) -> Column:
    """P(group) * P(action | group), each entry at least 1e-12, divided by the sum."""
    names = list(GROUPS)
    cells = []
    for c in classes:
        g = GROUP_OF[c]
        local = members(classes, g).index(classes.index(c))
        cells.append(F.get(group_p, F.lit(names.index(g))) * F.get(specialists[g], F.lit(local)))
    clipped = F.transform(F.array(*cells), lambda x: F.greatest(x, F.lit(1e-12)))
    return let(clipped, lambda v: let(total(v), lambda s: F.transform(v, lambda x: x / s)))


def with_respond_head(
    group_p: Column, specialists: dict[str, Column], respond_p: Column, global_p: Column, classes: list[str],
    global_blend: float,
) -> Column:
    """Reason mass split by the respond head, then mixed with the flat head.

    respond_p: (not respond, respond); the reason specialist covers its other actions.
    """
    names = list(GROUPS)
    cells = []
    for c in classes:
        g = GROUP_OF[c]
        mass = F.get(group_p, F.lit(names.index(g)))
        if c == "respond_only":
            cells.append(mass * F.get(respond_p, F.lit(1)))
            continue
        local = members(classes, g, respond_apart=True).index(classes.index(c))
        share = F.get(specialists[g], F.lit(local))
        cells.append(mass * F.get(respond_p, F.lit(0)) * share if g == "reason" else mass * share)
    two_stage = F.array(*cells)
    return two_stage if global_blend <= 0 else mix(two_stage, global_p, 1.0 - global_blend, global_blend)
