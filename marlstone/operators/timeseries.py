"""Time-series operators: velocity, cadence, streaks, recurrence, as-of, keep-newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalars import month_index
from marlstone.operators.kernels import value_ranks


def newest(df: DataFrame, key: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each key in ``order``."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= keep).drop("_n")


def as_of(versions: DataFrame, key: str, at: str, when: Column) -> DataFrame:
    """The newest version of each key not after ``when``."""
    others = [c for c in versions.columns if c not in (key, at)]
    return versions.where(F.col(at) <= when).groupBy(key).agg(F.max(F.struct(at, *others)).alias("r")).select(key, "r.*")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the newest right row of its key not after it.

    One union sorted by time within the key instead of a range join: both sides
    shuffle once and no pairs are formed. On equal times the right row counts.
    """
    sides = [
        left.select(key, F.col(left_at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_r")),
        right.select(key, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*values).alias("_r")),
    ]
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = sides[0].unionByName(sides[1]).withColumn("_r", F.last("_r", True).over(w))
    return both.where("_side = 1").select("_l.*", *[F.col(f"_r.{v}").alias(f"as_of_{v}") for v in values])


def velocity(months: DataFrame, group: list[str], period: str, value: str) -> DataFrame:
    """A row a group: trailing twelve months, the twelve before, change and acceleration in percent.

    Only windows of consecutive months count; percents need a positive base.
    """
    w = Window.partitionBy(*group).orderBy(F.desc(period))
    m = month_index(F.col(period))
    rows = months.withColumn("_n", F.row_number().over(w)).withColumn("_m", m)
    upto = lambda a, b, c: F.sum(F.when(F.col("_n").between(a, b), c))
    span = lambda k: (F.max(F.when(F.col("_n") <= k, F.col("_m"))) - F.min(F.when(F.col("_n") <= k, F.col("_m"))) == k - 1) & (F.count_if(F.col("_n") <= k) == k)
    r1 = lambda c: F.floor(F.abs(c) * 10 + 0.5) / 10 * F.signum(c)
    out = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("months_available"), F.max(period).alias("as_of"), span(12).alias("window_contiguous"), span(24).alias("prior_window_contiguous"),
        upto(1, 12, F.col(value)).alias("_t"), upto(13, 24, F.col(value)).alias("_p"), upto(1, 3, F.col(value)).alias("_l"),
    )
    ok, both = F.col("window_contiguous"), F.col("window_contiguous") & F.col("prior_window_contiguous")
    return out.select(
        *group, "months_available", "as_of", "window_contiguous", "prior_window_contiguous", F.when(ok, r1(F.col("_t"))).alias("t12m"), F.when(both, r1(F.col("_p"))).alias("prior12m"),
        F.when(both & (F.col("_p") > 0), r1((F.col("_t") - F.col("_p")) / F.col("_p") * 100)).alias("yoy_delta_pct"),
        F.when(ok & (F.col("_t") > 0), r1((F.col("_l") * 4 - F.col("_t")) / F.col("_t") * 100)).alias("accel_pct"),
    )


def freshness(checks: DataFrame, key: str, at: str, changed: str, now: Column, prior: float, alpha: float = 0.3) -> DataFrame:
    """A row a key: checks, changes, exponential mean gap between changes, predicted next change and seconds until it.

    The mean, started by the first gap, is a sum of gaps times powers of
    1 - alpha by their place from the newest; no key's times are gathered.
    """
    t = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    rows = checks.select(key, t.alias("_t"), F.col(changed).alias("_c"))
    base = rows.groupBy(key).agg(F.count(F.lit(1)).alias("checks"), F.count_if("_c").alias("changes"), F.max("_t").alias("last_check"), F.max(F.when(F.col("_c"), F.col("_t"))).alias("last_change"))
    w = Window.partitionBy(key)
    hits = rows.where("_c").select(key, (F.col("_t") - F.lag("_t").over(w.orderBy("_t"))).alias("_g"), F.row_number().over(w.orderBy(F.desc("_t"))).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    gaps = hits.where("_r < _n")  # the oldest change ends no gap
    weight = F.pow(F.lit(1 - alpha), F.col("_r") - 1) * F.when(F.col("_r") == F.col("_n") - 1, 1.0).otherwise(alpha)
    mean = gaps.groupBy(key).agg(F.sum(F.col("_g") * weight).alias("ewma_gap"))
    due = F.coalesce("last_change", "last_check") + F.coalesce("ewma_gap", F.lit(prior)) - F.unix_micros(now) / 1e6
    return base.join(mean, key, "left").withColumn("due_in", due)


def head_streak(df: DataFrame, key: str, order: Column, ok: Column) -> DataFrame:
    """How many of the newest rows of each key in a row satisfy ``ok``."""
    w = Window.partitionBy(key).orderBy(order)
    bad = F.sum(F.when(ok, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_bad", bad).groupBy(key).agg(F.count_if(F.col("_bad") == 0).alias("streak"))


def flips(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Rows whose flag differs from the row before of the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_f", flag).withColumn("_before", F.lag("_f").over(w)).where("_before is not null and _before <> _f").drop("_f", "_before")


def recurrence(df: DataFrame, key: str, day: str, within: int = 45, least: int = 3) -> DataFrame:
    """A row a key: cycles, upper-median gap in days, whether all gaps lie within ``within`` days of it, and the next day where predictable."""
    w = Window.partitionBy(key).orderBy(day)
    g = df.select(key, day).distinct().withColumn("_g", F.datediff(day, F.lag(day).over(w)))
    base = g.groupBy(key).agg(F.count(F.lit(1)).alias("cycles"), F.max(day).alias("last_day"), F.min("_g").alias("_lo"), F.max("_g").alias("_hi"))
    r = value_ranks(g, [key], "_g")
    at = F.floor(F.col("n") / 2)
    median = r.where((F.col("rank") <= at) & (at < F.col("rank") + F.col("count"))).select(key, F.col("_g").alias("median_gap"))
    m = F.col("median_gap")
    out = base.join(median, key, "left").withColumn("regular", F.coalesce((m - F.col("_lo") <= within) & (F.col("_hi") - m <= within), F.lit(False)))
    return out.withColumn("next_day", F.when(F.col("regular") & (F.col("cycles") >= least), F.date_add("last_day", m))).drop("_lo", "_hi")


def transitions(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Each change of state: (key, order..., from_state, to_state)."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("from_state", before).where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state))).select(key, *order, "from_state", F.col(state).alias("to_state"))
