"""Numeric expressions: rounding, coercion, weights and survey arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the two-sided 95 % normal quantile used by every interval.
Z_95 = 1.959963984540054


def rounded(value: Column | str, digits: int) -> Column:
    """Scale, round half to even, unscale. Differs from ``round``/``bround`` on decimal ties."""
    column = F.col(value) if isinstance(value, str) else value
    scale = 10.0**digits
    return F.rint(column * F.lit(scale)) / F.lit(scale)


def is_finite(value: Column) -> Column:
    """True for a present number that is neither NaN nor infinite."""
    number = value.cast("double")
    return value.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))


def to_number(text: Column) -> Column:
    """Lenient parse: null where the text is not a finite number."""
    number = F.trim(text.cast("string")).try_cast("double")
    return F.when(is_finite(number), number)


def to_number_strict(text: Column) -> Column:
    """Strict parse: an unparseable text fails the query."""
    number = to_number(text)
    return F.when(number.isNotNull(), number).otherwise(
        F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(text.cast("string"), F.lit("null")))).cast("double")
    )


def usable_weight(value: Column) -> Column:
    """A weight that is missing, non-finite or negative counts as zero."""
    return F.when(is_finite(value) & (value >= 0), value.cast("double")).otherwise(F.lit(0.0))


def weight_share(first: Column, second: Column) -> tuple[Column, Column]:
    """Two weights normalised to a sum of one, 6 decimals.

    Dividing by the larger weight first keeps the sum finite for huge weights; two zero
    weights share equally.
    """
    a, b = usable_weight(first), usable_weight(second)
    top = F.greatest(a, b)
    total = a / top + b / top
    share_a = F.when(top == 0, F.lit(0.5)).otherwise((a / top) / total)
    share_b = F.when(top == 0, F.lit(0.5)).otherwise((b / top) / total)
    return rounded(share_a, 6), rounded(share_b, 6)


def publication_round(df: DataFrame, digits: int = 12) -> DataFrame:
    """Round every double column on the way out; ranks must be computed before this."""
    return df.select(
        *[rounded(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
          for f in df.schema.fields]
    )


def required_sample_size(half_width: Column, prevalence: Column, design_effect: Column, z: float = Z_95) -> Column:
    """Points needed for a 95 % half-width; null where an argument is outside its domain."""
    points = F.ceil(design_effect * (F.lit(z * z) * prevalence * (1 - prevalence) / (half_width * half_width)))
    valid = (prevalence > 0) & (prevalence < 1) & (half_width > 0) & (half_width < 1) & (design_effect >= 1)
    return F.when(valid, points).cast("bigint")


def wilson_bounds(successes: Column, total: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval clipped to [0, 1]; null where the counts are impossible."""
    n = total.cast("double")
    p = successes / n
    scale = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / scale
    spread = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / scale
    valid = (total > 0) & (successes >= 0) & (successes <= total)
    low = F.when(valid, F.greatest(F.lit(0.0), centre - spread))
    high = F.when(valid, F.least(F.lit(1.0), centre + spread))
    return low, high


def min_max(value: Column, low: Column, high: Column, top: float = 100.0, flat: float = 50.0) -> Column:
    """Linear scale to [0, top]; a flat range maps to ``flat``."""
    return F.when(high == low, F.lit(flat)).otherwise((value - low) / (high - low) * F.lit(top))


_SMALL = 16


def log_factorial(n: Column) -> Column:
    """ln(n!): exact logs for small n, Stirling series beyond (error below 1e-13)."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(_SMALL)])
    x = F.greatest(n, F.lit(_SMALL)).cast("double")
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    large = (x + 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + series
    return F.when(n < _SMALL, F.get(small, n.cast("int"))).otherwise(large)


def log_binomial(n: Column, k: Column) -> Column:
    """ln C(n, k)."""
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def chance_overlap(total: Column, k: Column, observed: Column) -> tuple[Column, Column]:
    """Expected overlap of two random top-k sets, and the probability of at least ``observed``."""
    base = log_binomial(total, k)
    term = lambda o: F.when(k - o <= total - k, F.exp(log_binomial(k, o) + log_binomial(total - k, k - o) - base)).otherwise(F.lit(0.0))
    tail = F.aggregate(F.sequence(observed, k), F.lit(0.0), lambda acc, o: acc + term(o))
    valid = (k >= 0) & (k <= total) & (observed >= 0) & (observed <= k)
    return F.when(valid, k * k / total), F.when(valid, F.least(tail, F.lit(1.0)))


def struct_fields(column: Column, names: Sequence[str]) -> list[Column]:
    """Fields of a struct column as top-level columns."""
    return [column[name].alias(name) for name in names]
