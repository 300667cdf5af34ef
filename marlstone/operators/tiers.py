"""Tier memory of hosts: strikes that add up, reset and expire, from parts of a host's log that combine in any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Strikes that pin a host, and the tier it is pinned to.
STRIKE_LIMIT, PINNED = 3, "browser"


def writes(fetches: DataFrame) -> DataFrame:
    """(host, at, tie, reset, strike) of the fetches (host, at, tie, winner, http_lost) that teach something: http won, or lost to another tier. Hosts in lower case."""
    won, lost = F.col("winner").eqNullSafe("http"), F.coalesce("http_lost", F.lit(False))
    rows = fetches.where(F.col("host").isNotNull() & F.col("at").isNotNull() & (won | lost))
    return rows.select(F.lower("host").alias("host"), "at", "tie", won.alias("reset"), F.when(won, 0).otherwise(1).alias("strike"))


def _since_reset(parts: DataFrame, by: list[str], order: list[str], ttl: float) -> DataFrame:
    """Parts in order as one a group. A part is (first, last, writes, reset, strikes): strikes since its last reset, or all where it has none.

    A part that begins more than ``ttl`` after the one before ended starts
    anew, as if it began with a reset. This is associative: parts of parts give
    what the whole does. Single writes are parts too.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.lag("last").over(w)
    stale = F.coalesce(before < F.col("first") - F.lit(ttl), F.lit(False)) if ttl > 0 else F.lit(False)
    run = parts.withColumn("_anew", F.col("reset") | stale).withColumn("_run", F.sum(F.col("_anew").cast("long")).over(w))
    runs = run.groupBy(*by, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("writes").alias("writes"), F.sum("strikes").alias("strikes"))
    return runs.groupBy(*by).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("writes").alias("writes"), (F.max("_run") > 0).alias("reset"), F.max_by("strikes", "_run").alias("strikes"))


def parts(log: DataFrame, ttl: float, span: float | None = None) -> DataFrame:
    """Writes as parts a host, or with ``span`` (seconds) a host and stretch of time, so that a long log is many tasks' work."""
    one = log.select("host", "tie", F.col("at").alias("first"), F.col("at").alias("last"), F.lit(1).cast("long").alias("writes"), "reset", F.col("strike").cast("long").alias("strikes"))
    if span is None:
        return _since_reset(one, ["host"], ["first", "tie"], ttl)
    return _since_reset(one.withColumn("stretch", F.floor(F.col("first") / span)), ["host", "stretch"], ["first", "tie"], ttl)


def memory(fetches: DataFrame, ttl: float, span: float = 86_400.0) -> DataFrame:
    """(host, strikes, preferred, updated_at, observations) after all of ``fetches`` (host, at in seconds, tie, winner, http_lost).

    A win of http clears a host; a loss is a strike, and three in a row, none
    more than ``ttl`` seconds after the last write, pin the host. With ``ttl``
    of 0 nothing expires. Equal times go by ``tie``. Rows without host or time
    teach nothing. A host's log is cut into stretches of ``span`` seconds that
    are summed up apart; the stretches are then combined.
    """
    out = _since_reset(parts(writes(fetches), ttl, span), ["host"], ["stretch"], ttl)
    return out.select("host", "strikes", F.when(F.col("strikes") >= STRIKE_LIMIT, PINNED).alias("preferred"), F.col("last").alias("updated_at"), F.col("writes").alias("observations"))


def preferred_now(preferred: Column, updated_at: Column, now: Column, ttl: float) -> Column:
    """The tier to start with: a pin that has aged past ``ttl`` no longer counts."""
    return preferred if ttl <= 0 else F.when(updated_at >= now - ttl, preferred)
