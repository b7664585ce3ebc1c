"""Row-local arithmetic on class-probability arrays (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sessionloom.functions.base import let


def total(p: Column) -> Column:
    """Sum in array order."""
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Max-shifted softmax."""
    t = F.lit(float(temperature))
    shifted = let(logits, lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp((x - top) / t))))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def normalise(p: Column, floor: float = 1e-12) -> Column:
    """Divide by the sum, the sum not below the floor."""
    return let(p, lambda q: let(F.greatest(total(q), F.lit(floor)), lambda s: F.transform(q, lambda x: x / s)))


def normalise_safe(p: Column) -> Column:
    """Divide by the sum; all-zero rows stay zero."""
    return let(p, lambda q: let(total(q), lambda s: F.transform(q, lambda x: x / F.when(s == 0, 1.0).otherwise(s))))


def min_max(p: Column, floor: float = 1e-6) -> Column:
    """Scale to [0, 1] by the row's own range."""
    def scaled(q: Column, lo: Column) -> Column:
        span = F.greatest(F.array_max(q) - lo, F.lit(floor))
        return let(span, lambda s: F.transform(q, lambda x: (x - lo) / s))

    return let(p, lambda q: let(F.array_min(q), lambda lo: scaled(q, lo)))


def log_clipped(p: Column, low: float = 1e-9) -> Column:
    """ln of values held to [low, 1]."""
    return F.transform(p, lambda x: F.log(F.least(F.greatest(x, F.lit(low)), F.lit(1.0))))


def add(p: Column, q: Column) -> Column:
    return F.zip_with(p, q, lambda x, y: x + y)


def mix(p: Column, q: Column, weight_p, weight_q) -> Column:
    """weight_p * p + weight_q * q."""
    wp = weight_p if isinstance(weight_p, Column) else F.lit(float(weight_p))
    wq = weight_q if isinstance(weight_q, Column) else F.lit(float(weight_q))
    return F.zip_with(p, q, lambda x, y: wp * x + wq * y)


def argmax(p: Column) -> Column:
    """0-based index of the largest value, first on ties."""
    return let(p, lambda q: (F.array_position(q, F.array_max(q)) - 1).cast("int"))


def margin(p: Column) -> Column:
    """Largest value minus the second largest (equal values count twice)."""
    return let(F.sort_array(p, asc=False), lambda r: F.get(r, F.lit(0)) - F.get(r, F.lit(1)))


def at(p: Column, index: Column) -> Column:
    """p[index], 0-based."""
    return F.get(p, index.cast("int"))


def align(p: Column, source_classes: list[str], target_classes: list[str], strict: bool = True) -> Column:
    """Reorder a vector from the source class order to the target one.

    strict: an absent class is an error; otherwise it gets 0.
    """
    position = {label: i for i, label in enumerate(source_classes)}
    missing = [label for label in target_classes if label not in position]
    if missing and strict:
        raise KeyError(f"classes absent in source: {missing}")
    return F.array(*[
        F.get(p, F.lit(position[label])) if label in position else F.lit(0.0) for label in target_classes
    ])


def scale(p: Column, factor) -> Column:
    """factor * p."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(p, lambda x: x * f)
