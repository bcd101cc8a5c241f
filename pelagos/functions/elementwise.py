"""Element-wise operators on double columns.  NULL means missing; no function stores NaN.

Division comes in the three kinds that research code relies on: ``divide`` keeps signed infinity, ``over`` (the infix
slash) gives missing, ``protected_div`` gives zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def finite_or_null(x: Column) -> Column:
    """NaN becomes missing."""
    return F.when(~F.isnan(x), x)


def add(a, b) -> Column:
    return _col(a) + _col(b)


def subtract(a, b) -> Column:
    return _col(a) - _col(b)


def multiply(a, b) -> Column:
    return _col(a) * _col(b)


def divide(a, b) -> Column:
    """``x/0`` is infinity with the sign of ``x``; ``0/0`` is missing."""
    a, b = _col(a), _col(b)
    return F.when(b != 0, a / b).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))


def over(a, b) -> Column:
    """A zero denominator gives missing."""
    a, b = _col(a), _col(b)
    return F.when(b != 0, a / b)


def protected_div(a, b) -> Column:
    """A zero denominator gives zero."""
    a, b = _col(a), _col(b)
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def inverse(x) -> Column:
    x = _col(x)
    return F.when(x != 0, 1 / x).when(x == 0, F.lit(INF))


def negative(x) -> Column:
    return -_col(x)


def absolute(x) -> Column:
    return F.abs(_col(x))


def sign(x) -> Column:
    return F.signum(_col(x))


def power(x, e) -> Column:
    return finite_or_null(F.pow(_col(x), _col(e)))


def magnitude_power(x, e) -> Column:
    """``x ** |e|``; not sign preserving."""
    return finite_or_null(F.pow(_col(x), F.abs(_col(e))))


def signed_power(x, e) -> Column:
    x = _col(x)
    return F.signum(x) * F.pow(F.abs(x), _col(e))


def log(x) -> Column:
    x = _col(x)
    return F.when(x > 0, F.log(F.when(x > 0, x)))


def log10(x) -> Column:
    x = _col(x)
    return F.when(x > 0, F.log10(F.when(x > 0, x)))


def sqrt(x) -> Column:
    x = _col(x)
    return F.when(x >= 0, F.sqrt(x))


def square(x) -> Column:
    x = _col(x)
    return x * x


def signed_log1p(x) -> Column:
    x = _col(x)
    return F.signum(x) * F.log1p(F.abs(x))


def dead_zone(x, c) -> Column:
    """Zero strictly inside (-c, c)."""
    x, c = _col(x), _col(c)
    return F.when((x > -c) & (x < c), F.lit(0.0)).otherwise(x)


def tail(x, lower, upper, new) -> Column:
    """``new`` from ``lower`` to ``upper`` inclusive."""
    x = _col(x)
    return F.when((x >= _col(lower)) & (x <= _col(upper)), _col(new)).otherwise(x)


def maximum(a, b) -> Column:
    """``a`` where it is greater, else ``b``; so ``b`` where either is missing."""
    a, b = _col(a), _col(b)
    return F.when(a > b, a).otherwise(b)


def minimum(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.when(a < b, a).otherwise(b)


def maximum_skip(a, b) -> Column:
    """The greater of what is present."""
    return F.greatest(_col(a), _col(b))


def minimum_skip(a, b) -> Column:
    return F.least(_col(a), _col(b))


def pasteurize(x, member: Column | None = None) -> Column:
    """Infinities, and rows outside the universe, become missing."""
    x = _col(x)
    kept = F.abs(x) != INF
    return F.when(kept if member is None else kept & F.coalesce(member, F.lit(False)), x)


def clip(x, low, high) -> Column:
    x = _col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, _col(low)), _col(high)))


def truncate(x, w) -> Column:
    return clip(x, -w, w)


def is_missing(x) -> Column:
    return _col(x).isNull().cast("double")


def truthy(x: Column) -> Column:
    """Missing counts as true, as any number but zero does."""
    return x.isNull() | (x != 0)


def compare(a, op: str, b) -> Column:
    """1.0 or 0.0; a missing side makes every comparison false but ``!=``."""
    a, b = _col(a), _col(b)
    made = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    return F.coalesce(made, F.lit(op == "!=")).cast("double")


def both(a, b) -> Column:
    return (truthy(_col(a)) & truthy(_col(b))).cast("double")


def either(a, b) -> Column:
    return (truthy(_col(a)) | truthy(_col(b))).cast("double")


def if_else(c, a, b) -> Column:
    return F.when(truthy(_col(c)), _col(a)).otherwise(_col(b))


trade_when = if_else


def price_filter(x, close: Column, low: float | None = None, high: float | None = None) -> Column:
    """Missing where the price is outside [low, high]; a missing price filters nothing."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (close < low)
    if high is not None:
        bad = bad | (close > high)
    return F.when(F.coalesce(bad, F.lit(False)), None).otherwise(_col(x))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def div_fill(a, b, fill: float = 0.0, least: float = 1e-10) -> Column:
    """``a/b`` where ``|b|`` exceeds ``least``, else ``fill``."""
    a, b = _col(a), _col(b)
    return F.when(F.abs(b) > least, a / b).otherwise(F.lit(fill))
