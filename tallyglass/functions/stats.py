"""Rates, rounding and interval arithmetic as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def half_up(value: Column, places: int) -> Column:
    """Round half away from zero on the decimal reading of a double."""
    return F.round(value.cast("decimal(28,10)"), places).cast("double")


def ratio(num: Column, den: Column, places: int, empty: float | None = None) -> Column:
    """``num / den`` rounded; ``empty`` when the denominator is zero or missing."""
    value = half_up(num.cast("double") / F.when(den != 0, den.cast("double")), places)
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def wilson_bounds(successes: Column, total: Column) -> tuple[Column, Column]:
    """Unrounded Wilson 95 % bounds, NULL outside ``0 <= successes <= total``."""
    usable = (total > 0) & (successes >= 0) & (successes <= total)
    n = F.when(usable, total.cast("double"))
    p = successes.cast("double") / n
    z2 = Z95 * Z95
    scale = 1 + F.lit(z2) / n
    mid = (p + F.lit(z2) / (2 * n)) / scale
    half = Z95 * F.sqrt((p * (1 - p) + F.lit(z2) / (4 * n)) / n) / scale
    lower = F.when(n.isNotNull(), F.greatest(F.lit(0.0), mid - half))
    upper = F.when(n.isNotNull(), F.least(F.lit(1.0), mid + half))
    return lower, upper


def wilson_interval(successes: Column, total: Column) -> tuple[Column, Column]:
    lower, upper = wilson_bounds(successes, total)
    return half_up(lower, 4), half_up(upper, 4)


def lift(
    successes: Column,
    total: Column,
    control_successes: Column,
    control_total: Column,
    is_control: Column,
) -> dict[str, Column]:
    """Absolute lift with a Newcombe-Wilson interval, relative lift with a log interval."""
    no_total = (total <= 0) | (control_total <= 0)
    bad = (
        (successes < 0)
        | (successes > total)
        | (control_successes < 0)
        | (control_successes > control_total)
    )
    n1 = F.when(total > 0, total.cast("double"))
    n0 = F.when(control_total > 0, control_total.cast("double"))
    r1, r0 = successes / n1, control_successes / n0
    diff = r1 - r0
    lo1, up1 = wilson_bounds(successes, total)
    lo0, up0 = wilson_bounds(control_successes, control_total)
    abs_lo = F.greatest(F.lit(-1.0), diff - F.sqrt(F.pow(r1 - lo1, 2) + F.pow(up0 - r0, 2)))
    abs_up = F.least(F.lit(1.0), diff + F.sqrt(F.pow(up1 - r1, 2) + F.pow(r0 - lo0, 2)))
    inner = (
        (successes > 0)
        & (successes < total)
        & (control_successes > 0)
        & (control_successes < control_total)
    )
    s1 = F.when(inner, successes.cast("double"))
    s0 = F.when(inner, control_successes.cast("double"))
    log_rr = F.log((s1 / n1) / (s0 / n0))
    err = F.sqrt(1 / s1 - 1 / n1 + 1 / s0 - 1 / n0)
    comparable = ~no_total & ~bad & ~is_control
    relative = F.when(control_successes > 0, diff / r0)
    zero = F.when(~no_total & ~bad & is_control, F.lit(0.0))
    return {
        "lift_absolute": F.coalesce(zero, F.when(comparable, half_up(diff, 4))),
        "lift_relative": F.coalesce(zero, F.when(comparable, half_up(relative, 4))),
        "lift_absolute_lower": F.when(comparable, half_up(abs_lo, 4)),
        "lift_absolute_upper": F.when(comparable, half_up(abs_up, 4)),
        "lift_relative_lower": F.when(comparable & inner, half_up(F.exp(log_rr - Z95 * err) - 1, 4)),
        "lift_relative_upper": F.when(comparable & inner, half_up(F.exp(log_rr + Z95 * err) - 1, 4)),
        "lift_status": F.when(no_total, "zero_denominator")
        .when(bad, "insufficient_data")
        .when(is_control, "control_reference")
        .when(inner, "measured")
        .otherwise("insufficient_data"),
    }


def first_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows; all of them where the limit is 0."""
    return rows.limit(limit) if limit > 0 else rows
