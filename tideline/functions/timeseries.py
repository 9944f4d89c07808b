"""Row-frame time-series expressions over a (series, date) panel.

Every window here is partitioned by the series key. The panel is unique on
(series, date) before any of these run, so one window partition never holds
more rows than the calendar has days, whatever the raw volume of a series was.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tideline.functions.scalar import safe_divide
from tideline.schemas import TRADING_DAYS

SQRT_TRADING_DAYS = math.sqrt(TRADING_DAYS)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def by_series(keys: str | Sequence[str] = "series", order: str = "date") -> WindowSpec:
    cols = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*cols).orderBy(order)


def _so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _trailing(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), Window.currentRow)


def ffill(col: Column | str, w: WindowSpec) -> Column:
    """Last non-null value up to the current row."""
    return F.last(_c(col), ignorenulls=True).over(_so_far(w))


def pct_change(col: Column | str, w: WindowSpec, fill: str = "pad") -> Column:
    """Row-over-row relative change.

    ``pad`` repeats the last price over a gap first, so a gap day returns 0.0
    and the next quoted day compares with the last quoted one; ``none`` leaves
    both days NULL. A zero base gives NULL.
    """
    if fill not in ("pad", "none"):
        raise ValueError(f"fill must be 'pad' or 'none', not {fill!r}")
    price = ffill(col, w) if fill == "pad" else _c(col)
    return safe_divide(price, F.lag(price).over(w)) - F.lit(1.0)


def rolling_std(col: Column | str, w: WindowSpec, rows: int, min_rows: int) -> Column:
    """Sample deviation of the trailing ``rows``; NULL below ``min_rows`` non-null values.

    For short frames; ``operators.rolling`` has the form whose cost does not
    grow with the frame.
    """
    frame = _trailing(w, rows)
    c = _c(col)
    return F.when(F.count(c).over(frame) >= min_rows, F.stddev_samp(c).over(frame))


def annualize(vol: Column | str) -> Column:
    return _c(vol) * F.lit(SQRT_TRADING_DAYS)


def base_100(col: Column | str, w: WindowSpec) -> Column:
    """Price relative to the first quoted price of the series, times 100.

    On a row with a price the first price so far is the first one ever, so the
    growing frame serves and no second pass over the series is needed.
    """
    c = _c(col)
    return safe_divide(c, F.first(c, ignorenulls=True).over(_so_far(w))) * F.lit(100.0)


def drawdown(col: Column | str, w: WindowSpec) -> Column:
    """Relative distance from the running maximum."""
    c = _c(col)
    return safe_divide(c, F.max(c).over(_so_far(w))) - F.lit(1.0)
