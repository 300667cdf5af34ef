"""Labour-market kernels: nowcasts from the newest observations of a cell, chains of reposted postings, and how long postings stay open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import stats
from marlstone.operators.kernels import nearest_rank_cells
from marlstone.sources.stored import fresh_path, remove

# Observations and spread of each confidence, the least evidence, the plausible ratios, and days after which an anchor is stale.
HIGH, MEDIUM = (6, 0.10), (3, 0.25)
LEAST_OBSERVATIONS, RATIOS, STALE_DAYS = 2, (0.25, 4.0), 400


def newest(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``. Each map task passes on ``n`` a key at most, so a hot key is never gathered."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def ratio_history(history: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """(by..., ratios): posted by official of the newest ``n`` observations (at, tie, posted, official) in which both are positive, ascending."""
    good = history.where((F.col("posted") > 0) & (F.col("official") > 0)).withColumn("ratio", F.col("posted") / F.col("official"))
    return newest(good, by, [F.desc("at"), F.desc("tie")], n).groupBy(*by).agg(F.array_sort(F.collect_list("ratio")).alias("ratios"))  # n values at most


def confidence(observations: Column, spread: Column, stale: Column) -> Column:
    """high, med or low by number and spread of the observations; a stale anchor costs one level."""
    level = lambda least: (observations >= least[0]) & (spread <= least[1])
    return F.when(level(HIGH), F.when(stale, "med").otherwise("high")).when(level(MEDIUM) & ~stale, "med").otherwise("low")


def nowcast(posted: DataFrame, history: DataFrame, anchors: DataFrame, by: Sequence[str], today: Column, band: tuple[float, float], window: int = 6, least: int = 3) -> DataFrame:
    """A row a cell of ``by``: its posted median brought to the official level by the median ratio of its newest observations.

    ``posted`` (by..., value) are today's points, ``history`` (by..., at, tie,
    posted, official) past medians, ``anchors`` (by..., anchor date) the age of
    the official figure. Cells with fewer than ``least`` points, without usable
    history or without an anchor give no row. A number that can't be stood by
    is withheld with its cause, and the row stays: an implausible ratio, a
    result outside ``band``, or too few observations, in this order.
    """
    cells = nearest_rank_cells(posted, list(by), "value", {"posted_median": 0.5}).where(F.col("n") >= max(1, least))
    ratios = ratio_history(history, by, window)
    j = cells.join(ratios, list(by)).join(anchors, list(by)).withColumns({"ratio": stats.median_of(F.col("ratios")), "observations": F.size("ratios"), "staleness_days": F.datediff(today, F.col("anchor"))})
    projected, stale = F.col("posted_median") / F.col("ratio"), F.col("staleness_days") > STALE_DAYS
    withheld = F.when(~F.col("ratio").between(*RATIOS), "implausible_ratio").when(~projected.between(*band), "out_of_band").when(F.col("observations") < LEAST_OBSERVATIONS, "thin_evidence")
    spread = (F.element_at("ratios", -1) - F.element_at("ratios", 1)) / F.col("ratio")
    j = j.withColumns({"withheld": withheld, "spread": spread})
    shown = F.col("withheld").isNull()
    return j.select(
        *by, "posted_median", F.when(shown, F.round(projected).cast("long")).alias("nowcast_median"), "withheld", F.round("ratio", 4).alias("ratio_used"), "observations", F.when(shown, F.round("spread", 3)).alias("dispersion"),
        F.when(shown, confidence(F.col("observations"), F.col("spread"), stale)).otherwise("none").alias("confidence"), "staleness_days", stale.alias("anchor_stale"),
    )


def chains(postings: DataFrame) -> DataFrame:
    """(first, last, postings, days): postings (id, days, next) linked by ``next`` into chains, one row a chain; each id has one predecessor at most.

    Pointers are doubled: after k rounds a row knows the 2^k postings after it,
    so a chain of n takes log2 n joins. Rounds read written tables, so a hot
    partition can be split and a lost executor costs one round. A ``next`` that
    isn't there ends its chain. Cycles have no first posting and are left out.
    """
    spark = postings.sparkSession
    known = postings.select(F.col("id").alias("next"))
    linked = postings.join(known, "next", "left_semi").select("id", F.col("next").alias("to"), "days")
    now = linked.unionByName(postings.join(linked.select("id"), "id", "left_anti").select("id", F.lit(None).cast(postings.schema["id"].dataType).alias("to"), "days"))
    now = now.select("id", "to", F.col("id").alias("last"), F.lit(1).cast("long").alias("postings"), F.col("days").cast("long").alias("days"))
    starts = postings.select("id").join(linked.select(F.col("to").alias("id")).distinct(), "id", "left_anti")
    paths, most = [], max(1, postings.count()).bit_length() + 1
    for _ in range(most):
        path = fresh_path(spark, "chains")
        now.write.parquet(path)
        paths.append(path)
        now = spark.read.parquet(path)
        if not now.where("to is not null").limit(1).count():
            break
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("last").alias("_last"), F.col("postings").alias("_postings"), F.col("days").alias("_days"))
        more = F.col("_last").isNotNull()
        now = now.join(ahead, "to", "left").select("id", F.col("_to").alias("to"), F.when(more, F.col("_last")).otherwise(F.col("last")).alias("last"), (F.col("postings") + F.coalesce("_postings", F.lit(0))).alias("postings"), (F.col("days") + F.coalesce("_days", F.lit(0))).alias("days"))
        for old in paths[:-1]:
            remove(spark, old)
        del paths[:-1]
    return now.where("to is null").join(starts, "id").select(F.col("id").alias("first"), "last", "postings", "days")


def lifecycle(closed: DataFrame, live: DataFrame, least: int = 1) -> DataFrame:
    """(kind, region, n, median_days, p75_days, reposts, repost_pct, live, churn_pct) of closed postings (kind, region, days, reposted), by kind and region and over ALL regions.

    One histogram of days serves all levels: different (kind, region, days) are
    counted first, grouping sets add the histograms up, and nearest-rank
    percentiles are read off cumulative counts, so no posting is shuffled or
    sorted. Rows without a region count in ALL only. ``live`` (kind, region,
    live) is joined as given, ALL too. Cells of fewer than ``least`` are left out.
    """
    hist = closed.groupBy("kind", "region", "days").agg(F.count(F.lit(1)).alias("m"), F.count_if("reposted").alias("reposts"))
    kind, region, days = F.col("kind"), F.col("region"), F.col("days")
    cube = hist.groupingSets([[kind, region, days], [kind, days]], kind, region, days).agg(F.grouping("region").alias("every"), F.sum("m").alias("m"), F.sum("reposts").alias("reposts"))
    cube = cube.where("every = 1 or region is not null").withColumn("region", F.when(F.col("every") == 1, "ALL").otherwise(F.col("region"))).drop("every")
    w = Window.partitionBy("kind", "region")
    ranked = cube.withColumns({"upto": F.sum("m").over(w.orderBy("days")), "n": F.sum("m").over(w)})
    at = lambda p: F.floor((F.col("n") - 1) * p + 0.5)
    hit = lambda p: (F.col("upto") - F.col("m") <= at(p)) & (at(p) < F.col("upto"))
    cells = ranked.groupBy("kind", "region").agg(F.max("n").alias("n"), *[F.max(F.when(hit(p), F.col("days"))).alias(name) for name, p in (("median_days", 0.5), ("p75_days", 0.75))], F.sum("reposts").alias("reposts"))
    share = lambda a, b: F.when(b > 0, F.round(a * 100.0 / b, 1))
    out = cells.where(F.col("n") >= max(1, least)).join(live, ["kind", "region"], "left")
    return out.withColumns({"repost_pct": share(F.col("reposts"), F.col("n")), "churn_pct": share(F.col("n"), F.col("live"))})
