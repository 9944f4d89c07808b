"""Running values of endless series, as a segmented prefix scan.

A window partitioned by series puts a whole series into one task. That suits a panel,
whose series are as long as the calendar, but not raw ticks, where one
series may hold a third of all rows. Here the order column is cut into
segments of about equal numbers of rows, by quantiles of all rows:

1. each (series, segment) folds to its totals, before anything is shuffled;
2. the totals before each segment are carried along the segments of a series, which are few;
3. each row is folded inside its segment, and joined with what was carried to it.

Rows are shuffled once, by series and segment, for steps 1 to 3, and no task holds more than about one
segment of rows. Quantiles are taken over the whole table, so no series has more rows in a segment than
all series together. Rows equal in the first order column stay in one segment.

The rows are read three times (quantiles, totals, values): pass a stored table
rather than a long plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import safe_divide
from tideline.session import materialize

SEGMENTS = 200
#: Relative accuracy of the quantiles: a segment is off by at most one part in this many of all rows.
ACCURACY = 10_000


def boundaries(df: DataFrame, column: str, segments: int = SEGMENTS) -> list:
    """Quantiles that cut the rows into ``segments`` ranges of about equal size; fewer where values repeat."""
    shares = [k / segments for k in range(1, segments)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(column, shares, ACCURACY).alias("q")).first().q
    return sorted(set(found or []))


def segment_of(column: str, bounds: Sequence) -> Column:
    """Number of boundaries below a value, by halving; NULL is first of all."""
    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(column) > F.lit(bounds[mid]), halve(mid + 1, high)).otherwise(halve(low, mid))

    return F.when(F.col(column).isNull(), F.lit(-1)).otherwise(halve(0, len(bounds)))


def _fold(kind: str, column: Column, order: Column) -> Column:
    """Total of a group of rows, NULLs skipped."""
    known = F.when(column.isNotNull(), order)
    return {
        "first": lambda: F.min_by(column, known), "last": lambda: F.max_by(column, known),
        "max": lambda: F.max(column), "min": lambda: F.min(column),
        "sum": lambda: F.sum(column), "count": lambda: F.count(column),
    }[kind]()


def _over(kind: str, column: Column, window) -> Column:
    """The same fold of all rows of a window up to the current one."""
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    folds = {
        "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True),
        "max": F.max, "min": F.min, "sum": F.sum, "count": F.count,
    }
    return folds[kind](column).over(so_far)


#: What goes on from one segment to the next: counts add up, all other totals fold as rows do.
_CARRY = {"count": "sum"}


def _join(kind: str, before: Column, here: Column) -> Column:
    """A total of earlier rows and one of later rows; either may be NULL."""
    if kind in ("sum", "count"):
        return F.coalesce(before + here, before, here)
    return {"first": F.coalesce(before, here), "last": F.coalesce(here, before),
            "max": F.greatest(before, here), "min": F.least(before, here)}[kind]


def running(
    df: DataFrame,
    folds: Mapping[str, tuple[str, str]],
    order: Sequence[str] = ("date",),
    keys: Sequence[str] = ("series",),
    segments: int = SEGMENTS,
) -> DataFrame:
    """``df`` with running values: ``folds`` maps each new column to (fold, column).

    Folds are first and last known value, max, min, sum and count, from the start of the
    series up to each row, the row included. ``order`` must be unique within a series.
    """
    bounds = boundaries(df, order[0], segments)
    cut = df.withColumn("_segment", segment_of(order[0], bounds))
    names = list(folds)
    along = F.struct(*order)
    totals = cut.groupBy(*keys, "_segment").agg(*[
        _fold(kind, F.col(c), along).alias(f"_{name}") for name, (kind, c) in folds.items()
    ])
    earlier = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carry_folds = {"first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True),
                   "max": F.max, "min": F.min, "sum": F.sum}
    carried = materialize(totals.select(*keys, "_segment", *[
        carry_folds[_CARRY.get(kind, kind)](f"_{name}").over(earlier).alias(f"_{name}") for name, (kind, _) in folds.items()
    ]), "carried")
    within = Window.partitionBy(*keys, "_segment").orderBy(*order)
    local = cut.withColumns({f"_in_{name}": _over(kind, F.col(c), within) for name, (kind, c) in folds.items()})
    same = [local[k].eqNullSafe(carried[k]) for k in (*keys, "_segment")]
    joined = local.join(carried, _all(same), "left")
    return joined.select(
        *[local[c] for c in df.columns],
        *[_join(folds[name][0], carried[f"_{name}"], local[f"_in_{name}"]).alias(name) for name in names],
    )


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def running_metrics(
    ticks: DataFrame, value: str = "value", order: Sequence[str] = ("date",), keys: Sequence[str] = ("series",),
    segments: int = SEGMENTS,
) -> DataFrame:
    """Filled value, base-100 price and drawdown of series of any length, as columns filled, norm, drawdown."""
    c = F.col(value)
    folded = running(
        ticks, {"filled": ("last", value), "_first_price": ("first", value), "_peak": ("max", value)}, order, keys, segments
    )
    return folded.withColumns({
        "norm": safe_divide(c, F.col("_first_price")) * F.lit(100.0),
        "drawdown": safe_divide(c, F.col("_peak")) - F.lit(1.0),
    }).drop("_first_price", "_peak")
