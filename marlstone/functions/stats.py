"""Statistics as Catalyst expressions on arrays and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96
# Fixed values of the robust z: consistency factors of the MAD and of the mean deviation, and the cap without scale.
MAD_FACTOR, MEAN_AD_FACTOR, CAP = 0.6745, 1.253314, 25.0


def wilson(k: Column, n: Column) -> Column:
    """95 % interval of a rate as struct (lo, hi); (0, 1) for n = 0."""
    p, z2 = k / n, Z95 * Z95
    centre, margin, denom = p + z2 / (2 * n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)), 1 + z2 / n
    return F.when(n == 0, F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))).otherwise(
        F.struct(F.greatest(F.lit(0.0), (centre - margin) / denom).alias("lo"), F.least(F.lit(1.0), (centre + margin) / denom).alias("hi"))
    )


def rate_rose(k: Column, n: Column, base_k: Column, base_n: Column) -> Column:
    """The run's interval lies above the baseline's."""
    return wilson(k, n)["lo"] > wilson(base_k, base_n)["hi"]


def median_of(a: Column) -> Column:
    """Mean of the middle values of an array; null if empty."""
    s, n = F.array_sort(a), F.size(a)
    at = lambda k: F.try_element_at(s, k.cast("int"))
    return F.when(n > 0, F.when(n % 2 == 1, at(F.floor(n / 2) + 1)).otherwise((at(F.floor(n / 2)) + at(F.floor(n / 2) + 1)) / 2))


def upper_median(a: Column) -> Column:
    """The larger of the middle values."""
    return F.when(F.size(a) > 0, F.try_element_at(F.array_sort(a), (F.floor(F.size(a) / 2) + 1).cast("int")))


def nearest_rank(a: Column, p: float) -> Column:
    """The value at index round((n - 1) p), halves away from zero."""
    return F.when(F.size(a) > 0, F.try_element_at(F.array_sort(a), (F.floor((F.size(a) - 1) * p + 0.5) + 1).cast("int")))


def robust_z(x: Column, base: Column, tol: float, least: int = 3) -> Column:
    """Distance from the median in robust scale; null with fewer than ``least`` values, by tolerance if they don't vary."""
    med = median_of(base)
    dev = F.transform(base, lambda v: F.abs(v - med))
    mad, mean = median_of(dev), F.aggregate(dev, F.lit(0.0), lambda s, v: s + v) / F.size(dev)
    d = x - med
    flat = F.when(F.abs(d) <= max(tol, 0.0), 0.0)
    flat = flat.otherwise(F.signum(d) * CAP) if tol <= 0 else flat.otherwise(F.greatest(F.lit(-CAP), F.least(F.lit(CAP), d / tol)))
    return F.when(F.size(base) >= least, F.when(mad > 1e-12, MAD_FACTOR * d / mad).when(mean > 1e-12, d / (MEAN_AD_FACTOR * mean)).otherwise(flat))


def total_variation(p: Column, q: Column) -> Column:
    """Half of the summed differences of two profiles, each brought to sum 1."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    part = lambda a: F.transform(a, lambda v: F.when(total(a) > 0, v / total(a)).otherwise(0.0))
    return F.aggregate(F.zip_with(part(p), part(q), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / 2


def ewma(gaps: Column, alpha: float = 0.3) -> Column:
    """Exponential mean of an array in order, started by its first value; null if empty."""
    return F.aggregate(gaps.cast("array<double>"), F.lit(None).cast("double"), lambda s, g: F.when(s.isNull(), g).otherwise(alpha * g + (1 - alpha) * s))


def due_score(elapsed: Column, expected: Column) -> Column:
    """Likelihood of a change by now: 1 - exp(-elapsed / expected); 1 if never checked."""
    return F.when(elapsed.isNull(), 1.0).otherwise(1 - F.exp(-elapsed / expected))


def change_weight(distance: Column, boilerplate: int = 3, full: int = 16) -> Column:
    """0 up to the boilerplate distance, then in proportion up to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (distance - boilerplate) / (full - boilerplate)))


def len_bucket(n: Column) -> Column:
    """floor(log2 n) from 0 to 15."""
    return F.when(n <= 1, 0).otherwise(F.least(F.lit(15), F.floor(F.log2(n)).cast("int")))


def char_shares(c: Column) -> Column:
    """Shares of ASCII digits, letters, white space and the rest, as an array."""
    n = F.length(c)
    k = [F.regexp_count(c, F.lit(p)) for p in ("[0-9]", r"\p{IsAlphabetic}", r"[\s\u0085 ]")]
    return F.when(n > 0, F.array(*[x / n for x in k], (n - k[0] - k[1] - k[2]) / n)).otherwise(F.array(*[F.lit(0.0)] * 4))
