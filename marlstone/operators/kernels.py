"""Reusable analytics kernels: percentiles of cells, roll-ups, blends, ratios, prefix covers, release diffs, economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, rank, count, n): a row a different value with its first rank from 0, how often it occurs, and the group's size.

    Equal values combine before the shuffle, so a hot group costs its different
    values, not its rows. Nulls take no rank.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*by)
    before = F.sum("count").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return c.select(*by, value, F.coalesce(before, F.lit(0)).alias("rank"), "count", F.sum("count").over(w).alias("n"))


def nearest_rank_cells(df: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of each group: the value at index round((n - 1) p), halves up."""
    r = value_ranks(df, by, value)
    at = lambda p: F.floor((F.col("n") - 1) * p + 0.5)
    hit = lambda p: (F.col("rank") <= at(p)) & (at(p) < F.col("rank") + F.col("count"))
    return r.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(hit(p), F.col(value))).alias(name) for name, p in ps.items()])


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., middle, upper, nearest): the mean of the two middle values, the upper one, and the nearest-rank median.

    Read off ranks of different values, so no group is gathered. Nulls take no
    rank; a group of nulls only has no row.
    """
    r = value_ranks(df, by, value)
    hit = lambda at: F.max(F.when((F.col("rank") <= at) & (at < F.col("rank") + F.col("count")), F.col(value)))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return r.groupBy(*by).agg(((hit(low) + hit(high)) / 2).alias("middle"), hit(high).alias("upper"), hit(F.floor((F.col("n") - 1) * 0.5 + 0.5)).alias("nearest"))


def region_cube(df: DataFrame, region: str, kind: str, aggs: list[Column], all_regions: str = "ALL", all_kinds: str = "all") -> DataFrame:
    """Cube over region and kind with names for the totals; rows without region feed the totals over regions only."""
    out = df.cube(region, kind).agg(F.grouping(region).alias("_r"), F.grouping(kind).alias("_k"), *aggs)
    out = out.where((F.col("_r") == 1) | F.col(region).isNotNull())
    return out.withColumns({region: F.when(F.col("_r") == 1, all_regions).otherwise(F.col(region)), kind: F.when(F.col("_k") == 1, all_kinds).otherwise(F.col(kind))}).drop("_r", "_k")


def paired_ratio(num: Column, den: Column) -> Column:
    """Summed numerator by summed denominator over rows that have both; null without any."""
    both = num.isNotNull() & den.isNotNull()
    return F.sum(F.when(both, num)) / F.nullif(F.sum(F.when(both, den)), F.lit(0))


def blend(left: DataFrame, right: DataFrame, keys: list[str], left_name: str, right_name: str) -> DataFrame:
    """Full outer join of two sources on keys, with which of them cover a row."""
    a, b = left.withColumn("_a", F.lit(True)), right.withColumn("_b", F.lit(True))
    cover = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), left_name).otherwise(right_name)
    return a.join(b, keys, "full_outer").withColumn("coverage", cover).drop("_a", "_b")


def release_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """added, dropped, changed or same for each code of two releases, with the difference."""
    j = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "dropped").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return j.withColumn("kind", kind).withColumn("delta", F.col("after") - F.col("before"))


def without_covered(codes: DataFrame, code: str) -> DataFrame:
    """Codes of which no proper prefix is a code too. Prefixes are exploded and joined by equality."""
    c = codes.select(code).where(F.length(code) > 0).distinct()
    prefixes = c.where(F.length(code) > 1).select(code, F.explode(F.transform(F.sequence(F.lit(1), F.length(code) - 1), lambda n: F.substring(F.col(code), F.lit(1), n))).alias("_p"))
    covered = prefixes.join(c.select(F.col(code).alias("_c")), F.col("_p") == F.col("_c"), "left_semi").select(code).distinct()
    return c.join(covered, code, "left_anti")


def lifo_matches(opened: DataFrame, closed: DataFrame, keys: list[str], opened_order: list[Column], closed_order: list[Column]) -> DataFrame:
    """One-to-one matches of opened to closed rows on keys: the k-th by each side's order."""
    n = lambda o: F.row_number().over(Window.partitionBy(*keys).orderBy(*o))
    return opened.withColumn("_n", n(opened_order)).join(closed.withColumn("_n", n(closed_order)), [*keys, "_n"]).drop("_n")


def per_record(cost: Column, n: Column) -> Column:
    """Cost by count; null if the count is 0 or unknown."""
    return F.when(n > 0, cost / n)


def advice(rate: Column, base: Column, up: float = 1.5, down: float = 0.5) -> Column:
    """raise, lower or keep, by the recent rate against the longer one; unknown without either."""
    return F.when(rate.isNull() | base.isNull() | (base == 0), "unknown").when(rate >= up * base, "raise").when(rate <= down * base, "lower").otherwise("keep")


def full_sync(desired: DataFrame, actual: DataFrame, key: str, body: str) -> DataFrame:
    """What to do for each key: create, update, disable or keep."""
    j = desired.select(key, F.col(body).alias("_d"), F.lit(True).alias("_w")).join(actual.select(key, F.col(body).alias("_a"), F.lit(True).alias("_h")), key, "full_outer")
    return j.select(key, F.when(F.col("_h").isNull(), "create").when(F.col("_w").isNull(), "disable").when(~F.col("_d").eqNullSafe(F.col("_a")), "update").otherwise("keep").alias("action"))
