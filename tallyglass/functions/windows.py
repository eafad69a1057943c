"""Report windows. Every window takes its observation time explicitly."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    """Half-open ``[since, until)``; a missing bound is open."""

    since: datetime | None
    until: datetime | None
    days: int

    def on(self, col: str = "created_at") -> Column:
        cond = F.lit(True)
        if self.since is not None:
            cond = cond & (F.col(col) >= F.lit(self.since))
        if self.until is not None:
            cond = cond & (F.col(col) < F.lit(self.until))
        return cond

    def rows_of(self, rows: DataFrame, col: str = "created_at") -> DataFrame:
        """Rows of the window; on a table stored by day only the days it touches are read."""
        return between(rows.filter(self.on(col)), self.since, self.until, col)

    def previous(self) -> "Window":
        """The equal window directly before this one."""
        if self.since is None or self.until is None:
            raise ValueError("an open window has no predecessor")
        return Window(self.since - (self.until - self.since), self.since, self.days)


def between(
    rows: DataFrame, since: datetime | int | None, until: datetime | int | None, col: str = "created_at"
) -> DataFrame:
    """Keeps what a window's own filter on times or epochs needs, in terms that reach the scan.

    Both bounds are inclusive and may be times or epoch seconds. The bounds go to ``col`` and to
    the partition column ``event_date``, where the rows have them; a bound that is no constant is left out.
    """
    for bound, low in ((since, True), (until, False)):
        if bound is None or isinstance(bound, Column):
            continue
        at = F.timestamp_seconds(F.lit(bound)) if isinstance(bound, int) else F.lit(bound)
        if col in rows.columns:
            rows = rows.filter(F.col(col) >= at if low else F.col(col) <= (at + F.expr("INTERVAL 1 SECOND") if isinstance(bound, int) else at))
        if "event_date" in rows.columns:
            rows = rows.filter(F.col("event_date") >= F.to_date(at) if low else F.col("event_date") <= F.to_date(at))
    return rows


def relative(days: int, as_of: datetime) -> Window:
    """``created_at >= as_of - days``, open at the top; 0 days is all time."""
    return Window(as_of - timedelta(days=days) if days > 0 else None, None, days)


def exact(start: date | str, end: date | str) -> Window:
    """Whole days ``start`` to ``end`` inclusive."""
    start = date.fromisoformat(start) if isinstance(start, str) else start
    end = date.fromisoformat(end) if isinstance(end, str) else end
    days = (end - start).days + 1
    if days < 1:
        raise ValueError("start must not be after end")
    midnight = datetime(start.year, start.month, start.day)
    return Window(midnight, midnight + timedelta(days=days), days)


def resolve(
    as_of: datetime,
    days: int = 28,
    start: date | str | None = None,
    end: date | str | None = None,
    end_days_ago: int = 0,
) -> Window:
    """Exact dates when both are given, else a relative window shifted back ``end_days_ago``."""
    if (start is None) != (end is None):
        raise ValueError("start and end go together")
    if start is not None and end is not None:
        return exact(start, end)
    if end_days_ago > 0:
        until = as_of - timedelta(days=end_days_ago)
        return Window(until - timedelta(days=days), until, days)
    return relative(days, as_of)
