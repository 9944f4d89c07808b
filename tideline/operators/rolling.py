"""Long trailing windows in constant work per row.

Spark evaluates a bounded row frame by folding every row of the frame again for
each output row, so a 252-row frame costs 252 updates per row. Here each series
is cut into blocks of the window length. A window then covers the end of one
block and the start of the next, so its statistics are those of one suffix and
one prefix, both of which are growing frames, merged by the pairwise update of
mean and central moments. Nothing is subtracted, so an outlier that has left the
window leaves no rounding residue behind.

All steps are partitioned by the series key: one shuffle, then sorts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import safe_divide


def _moments(x: Column, y: Column | None, frame) -> Column:
    """Statistics of one growing frame as a struct."""
    n = F.count(x).over(frame)
    fields = [
        n.alias("n"),
        F.avg(x).over(frame).alias("mx"),
        (F.var_pop(x).over(frame) * n).alias("sxx"),
        F.min(x).over(frame).alias("lox"),
        F.max(x).over(frame).alias("hix"),
    ]
    if y is not None:
        fields += [
            F.avg(y).over(frame).alias("my"),
            (F.var_pop(y).over(frame) * n).alias("syy"),
            (F.covar_pop(x, y).over(frame) * n).alias("sxy"),
            F.min(y).over(frame).alias("loy"),
            F.max(y).over(frame).alias("hiy"),
        ]
    return F.struct(*fields)


def _merge(a: Column, b: Column, paired: bool) -> Column:
    """Statistics of two disjoint row sets taken together; either may be absent or empty."""

    def part(s: Column, field: str) -> Column:
        return F.coalesce(s[field], F.lit(0.0))

    def count(s: Column) -> Column:
        return F.coalesce(s["n"], F.lit(0))

    n = count(a) + count(b)
    # one side empty: its zero count removes its mean from every term
    weight = safe_divide(count(a).cast("double") * count(b), n)

    def mean(m: str) -> Column:
        return safe_divide(part(a, m) * count(a) + part(b, m) * count(b), n)

    def spread(s: str, m1: str, m2: str) -> Column:
        cross = (part(a, m1) - part(b, m1)) * (part(a, m2) - part(b, m2)) * weight
        return part(a, s) + part(b, s) + F.coalesce(cross, F.lit(0.0))

    fields = [
        n.alias("n"),
        mean("mx").alias("mx"),
        spread("sxx", "mx", "mx").alias("sxx"),
        F.least(a["lox"], b["lox"]).alias("lox"),
        F.greatest(a["hix"], b["hix"]).alias("hix"),
    ]
    if paired:
        fields += [
            mean("my").alias("my"),
            spread("syy", "my", "my").alias("syy"),
            spread("sxy", "mx", "my").alias("sxy"),
            F.least(a["loy"], b["loy"]).alias("loy"),
            F.greatest(a["hiy"], b["hiy"]).alias("hiy"),
        ]
    return F.struct(*fields)


def trailing_moments(
    df: DataFrame,
    rows: int,
    x: str,
    y: str | None = None,
    keys: Sequence[str] = ("series",),
    order: str = "date",
    out: str = "moments",
) -> DataFrame:
    """Add the statistics of the last ``rows`` rows of each key as struct ``out``.

    NULLs are not counted; with ``y`` only rows where both are known count.
    """
    by_key = Window.partitionBy(*keys).orderBy(order)
    growing = (Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(*growing)
    down = Window.partitionBy(*keys, "_block").orderBy(F.col(order).desc()).rowsBetween(*growing)

    vx, vy = F.col(x), None
    if y is not None:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        vx, vy = F.when(both, F.col(x)), F.when(both, F.col(y))
    at = F.row_number().over(by_key) - 1
    blocked = df.withColumn("_at", at).withColumn("_block", F.floor(F.col("_at") / rows))
    sided = blocked.withColumn("_suffix", _moments(vx, vy, down)).withColumn(
        "_prefix", _moments(vx, vy, up)
    )
    # a window ending on the last row of a block lies inside that block
    before = F.when(F.col("_at") % rows < rows - 1, F.lag("_suffix", rows - 1).over(by_key))
    return (
        sided.withColumn("_before", before)
        .withColumn(out, _merge(F.col("_before"), F.col("_prefix"), y is not None))
        .drop("_at", "_block", "_suffix", "_prefix", "_before")
    )


def zscore_of(value: Column, m: Column, min_rows: int) -> Column:
    """(x - mean) / sd; 0.0 where all values of the window are equal."""
    sd = F.sqrt(safe_divide(m["sxx"], m["n"] - 1))
    return (
        F.when(m["n"] < min_rows, F.lit(None).cast("double"))
        .when(m["lox"] == m["hix"], F.lit(0.0))
        .otherwise(safe_divide(value - m["mx"], sd))
    )


def correlation_of(m: Column, min_rows: int) -> Column:
    """Pearson correlation; NULL where either side does not vary."""
    varies = (m["lox"] < m["hix"]) & (m["loy"] < m["hiy"])
    ratio = safe_divide(m["sxy"], F.sqrt(m["sxx"]) * F.sqrt(m["syy"]))
    return F.when((m["n"] >= min_rows) & varies, ratio)
