"""Numeric column expressions. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from normlens import spec as S

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: ColumnOrName, digits: int) -> Column:
    """Round to ``digits`` decimals, ties to even (``round`` would go half-up)."""
    scale = float(10**digits)
    return F.rint(as_col(c) * scale) / scale


def row_mean(cols: Sequence[ColumnOrName]) -> Column:
    """Mean across columns of one row, skipping NULLs; NULL if all are NULL."""
    parts = [as_col(c).cast("double") for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    seen = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    return F.try_divide(total, seen)


def rescale(c: ColumnOrName, lo: Column, hi: Column,
            to: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Linear map of [lo, hi] onto ``to``; NULL where the range is empty."""
    unit = F.try_divide(as_col(c) - lo, hi - lo)
    if to == (0.0, 1.0):
        return unit
    return unit * (to[1] - to[0]) + to[0]


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, NULL when whole is zero."""
    return round_even(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, digits)


def pearson(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Aggregate Pearson r over rows where both sides are non-NULL.

    Unlike ``corr`` this yields NULL instead of failing when a side is constant,
    which is told by its range: merged moments of a constant are not always zero.
    """
    a, b = as_col(a), as_col(b)
    varies = F.lit(True)
    for here, other in ((a, b), (b, a)):
        value = F.when(other.isNotNull(), here)
        varies = varies & (F.min(value) < F.max(value))
    spread = F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b))
    return F.when(varies, F.try_divide(F.regr_sxy(a, b), spread))


def strength_label(r: ColumnOrName) -> Column:
    """Strength wording for a correlation that is already rounded."""
    r = as_col(r)
    out = F.when(r.isNull(), S.STRENGTH_MISSING)
    for cut, label in S.STRENGTH_CUTS:
        out = out.when(F.abs(r) >= cut, label)
    return out.otherwise(S.STRENGTH_FLOOR)


def direction_label(r: ColumnOrName) -> Column:
    r = as_col(r)
    return F.when(r > 0, "positive").when(r < 0, "negative").otherwise(S.NOT_AVAILABLE)


def in_band(c: ColumnOrName, lo: float, hi: float) -> Column:
    """Inclusive band test; a NULL value is outside every band."""
    return F.coalesce(as_col(c).between(lo, hi), F.lit(False))


def fixed_text(c: ColumnOrName, digits: int) -> Column:
    """Plain decimal text with a fixed number of decimals."""
    return F.replace(F.format_number(as_col(c), digits), F.lit(","), F.lit(""))


def rows_from_columns(structs: Iterable[Column]) -> Column:
    """Generator turning one wide row into one output row per struct."""
    return F.inline(F.array(*structs))


def pick(by: ColumnOrName, branches: Mapping[str, Column]) -> Column:
    """The branch named by ``by``, NULL for other names."""
    out = None
    for name, value in branches.items():
        cond = as_col(by) == name
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def two_sided_p(r: ColumnOrName, n: ColumnOrName, steps: int = 8_000) -> Column:
    """Two-sided p-value of a Pearson r on n rows (t test with n-2 degrees).

    With sin(a) = |r| the p-value is the share of the integral of cos(t)^(n-3)
    on [0, pi/2] that lies beyond a. Both parts use Simpson's rule; the range
    is cut where the integrand falls under 1e-40. Meant for a handful of result
    rows, so the array expressions here never touch the data.
    """
    r, n = as_col(r).cast("double"), as_col(n).cast("double")
    power = n - 3.0
    limit = F.least(F.lit(1.5707963267948966), F.try_divide(F.lit(14.0), F.sqrt(F.greatest(power, F.lit(1.0)))))

    def simpson(lo: Column, hi: Column) -> Column:
        h = (hi - lo) / float(steps)

        def term(acc: Column, i: Column) -> Column:
            weight = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            base = F.greatest(F.cos(lo + h * i), F.lit(0.0))
            value = F.when(power == 0, 1.0).otherwise(F.pow(base, power))
            return acc + weight * value

        total = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), term)
        return total * h / 3.0

    angle = F.least(F.asin(F.least(F.abs(r), F.lit(1.0))), limit)
    below, above = simpson(F.lit(0.0), angle), simpson(angle, limit)
    return F.when(r.isNotNull() & (n >= 3), F.try_divide(above, below + above)).when(
        r.isNotNull() & (n == 2), 1.0)
