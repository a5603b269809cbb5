"""Missing-aware arithmetic.

NULL is the only missing marker.  NaN is turned into NULL where data enters; an
infinity may travel through an aggregate and is dropped at the panel boundary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: denominators this close to zero count as zero.
EPSILON = 1e-12


def _inf() -> Column:
    return F.lit(float("inf"))


def is_finite(value: Column) -> Column:
    """False for +-inf and NaN (Spark orders NaN above infinity), NULL for NULL."""
    return F.abs(value) < _inf()


def finite(value: Column) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    return F.when(is_finite(value), value)


def number(value: Column) -> Column:
    """DOUBLE with unreadable text and NaN turned into NULL; infinities are kept."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def strict_number(value: Column) -> Column:
    """DOUBLE with NaN turned into NULL; unreadable text fails the job (ANSI cast)."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """``a / b`` when both are finite and ``|b| > EPSILON``, else NULL."""
    valid = is_finite(numerator) & is_finite(denominator) & (F.abs(denominator) > EPSILON)
    return F.when(valid, numerator / denominator)


def change(value: Column, base: Column) -> Column:
    """Relative change ``value / base - 1`` through :func:`ratio`."""
    return ratio(value, base) - 1.0


def step_return(value: Column, previous: Column) -> Column:
    """Bar-to-bar return without filling gaps; a zero base gives a signed infinity."""
    from_zero = F.when(value > 0, _inf()).when(value < 0, -_inf())
    return F.when(previous == 0, from_zero).otherwise(value / previous - 1.0)


def both_max(left: Column, right: Column) -> Column:
    """Maximum that is NULL when either side is NULL (``greatest`` would skip it)."""
    return F.when(left.isNotNull() & right.isNotNull(), F.greatest(left, right))


def both_min(left: Column, right: Column) -> Column:
    """Minimum that is NULL when either side is NULL."""
    return F.when(left.isNotNull() & right.isNotNull(), F.least(left, right))


def clip(value: Column, low: Column, high: Column) -> Column:
    """Bound a value; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))
