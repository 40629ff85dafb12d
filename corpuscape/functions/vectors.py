"""Vector expressions over ``array<float>`` or ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    # A lambda body runs per component, so the norm is taken outside it and repeated.
    norm = F.sqrt(F.greatest(squared_norm(v), F.lit(1e-300)))
    return F.zip_with(v.cast("array<double>"), F.array_repeat(norm, F.size(v)), lambda x, n: x / n)


def spread_vector(v: Column, names: Sequence[str]) -> list[Column]:
    """The first components of a vector as named scalar columns."""
    return [F.element_at(v, i + 1).alias(name) for i, name in enumerate(names)]


def sign_of_hash(word: Column, j: int) -> Column:
    """+1 or -1 from bit ``j`` of a 32-bit hash word."""
    return F.lit(1) - F.lit(2) * F.shiftright(word, j).bitwiseAND(F.lit(1))
