"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    The optimizer may copy an alias into every place that mentions it, also into a lambda that runs per
    array element; a one-element ``transform`` keeps the value computed once.
    """
    return F.transform(F.array(value), body)[0]


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column the optimizer computes exactly once per row.

    A plain alias may be copied into filters, field accesses and lambda bodies of later projections, which for a
    large expression multiplies both planning and run time. A generator over a one-element array is the barrier.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def safe_ratio(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """``numerator / denominator`` with a default for an empty or zero denominator."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def adjacent(items: Column, test: Callable[[Column, Column], Column]) -> Column:
    """True when ``test(previous, next)`` holds for every neighbouring pair of an array."""
    n = F.size(items)
    return F.when(n < 2, F.lit(True)).otherwise(
        F.forall(
            F.zip_with(
                F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))),
                F.slice(items, F.lit(2), F.greatest(n - 1, F.lit(0))),
                lambda a, b: F.coalesce(test(a, b), F.lit(False)),
            ),
            lambda ok: ok,
        )
    )


def array_median(items: Column) -> Column:
    """Median of a numeric array with the two middle values averaged; null for an empty array."""
    return bind(
        F.array_sort(items),
        lambda s: F.when(F.size(s) == 0, F.lit(None).cast("double")).otherwise(
            (
                F.element_at(s, F.floor((F.size(s) + 1) / 2).cast("int"))
                + F.element_at(s, F.floor((F.size(s) + 2) / 2).cast("int"))
            ).cast("double")
            / 2
        ),
    )


_BUILT: dict[tuple, Column] = {}


def built(fn: Callable[..., Column], *args) -> Column:
    """``fn`` applied to columns given by name, kept for the next plan that needs the same expression.

    A large expression takes seconds to assemble call by call, and it depends on column names only.
    """
    key = (fn, args, id(SparkContext._gateway))
    if key not in _BUILT:
        _BUILT[key] = fn(*[F.col(a) if isinstance(a, str) else a for a in args])
    return _BUILT[key]
