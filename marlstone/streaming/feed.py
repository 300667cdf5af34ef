"""Structured Streaming over the change feed: arrival dedup, windowed counts, keyed cadence state, triggers, saved searches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.functions.filters import all_of, parse_filters

# Seconds of the delivery retries, after which a delivery is dead.
RETRY_LADDER = (30, 60, 300, 1800, 7200)


def change_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Revisions as they are appended under a folder; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fresh_only(stream: DataFrame, ids: list[str], at: str, late: str = "1 day") -> DataFrame:
    """The first arrival of each id; ids are held as long as late rows may come."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(ids)


def windowed_counts(stream: DataFrame, at: str, by: list[str], size: str, late: str) -> DataFrame:
    """Counts by event-time window and group; closed windows only are given out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count(F.lit(1)).alias("n"))


def matching(stream: DataFrame, trigger: dict, data: str = "data") -> DataFrame:
    """Changes that a trigger waits for: its dataset (or *), kinds of change, and filters on the data."""
    kinds = {"any": ("new", "changed", "removed"), "fresh": ("new", "changed")}.get(trigger.get("on", "any"), (trigger.get("on"),))
    out = stream.where(F.col("change").isin(*kinds))
    if trigger.get("dataset", "*") != "*":
        out = out.where(F.col("dataset") == trigger["dataset"])
    return out.where(all_of(parse_filters(trigger.get("filters")), F.col(data), "memory"))


def fires(changes: DataFrame, name: str, key_cap: int) -> DataFrame:
    """One row a run and dataset: at most ``key_cap`` keys for the payload, whether there are more, and the idempotency key.

    Keys are counted and ranked before any are gathered, so a run of any size gathers one more than the cap.
    """
    keys = changes.groupBy("job_id", "dataset", "key").agg(F.count(F.lit(1)).alias("m"))
    keys = keys.withColumn("r", F.row_number().over(Window.partitionBy("job_id", "dataset").orderBy(F.col("key").asc_nulls_last())))
    g = keys.groupBy("job_id", "dataset").agg(F.sum("m").alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= key_cap + 1, F.col("key")))).alias("k"))
    return g.select(
        F.lit(name).alias("trigger"), "job_id", "dataset", "n", F.slice("k", 1, key_cap).alias("keys"), (F.size("k") > key_cap).alias("truncated"),
        F.sha2(F.concat_ws("|", F.lit(name), "job_id", "dataset"), 256).alias("idempotency_key"),
    )


def may_fire(chain: list[str], app: str, depth: int = 5) -> bool:
    """An app isn't fired by its own chain, and chains have a greatest depth."""
    return app not in chain and len(chain) < depth


def retry_after(attempt, hint=None):
    """Seconds until the next try, by the ladder or the receiver's hint if longer; null once dead."""
    step = F.try_element_at(F.array(*map(F.lit, RETRY_LADDER)), attempt)
    return step if hint is None else F.when(step.isNotNull(), F.greatest(step, F.coalesce(hint, F.lit(0))))


CADENCE_OUT = "key string, checks long, changes long, ewma_gap double, last_change double"
CADENCE_STATE = "checks long, changes long, ewma_gap double, last_change double"


def cadence(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per key: checks, changes and the exponential mean gap between changes (weight 0.3, started by the first gap)."""
    checks, changes, gap, last = state.get if state.exists else (0, 0, None, None)
    for pdf in batches:
        for t, changed in sorted(zip(pdf["at"], pdf["changed"], strict=True)):
            checks += 1
            if changed:
                changes += 1
                if last is not None:
                    gap = (t - last) if gap is None else 0.3 * (t - last) + 0.7 * gap
                last = t
    state.update((checks, changes, gap, last))
    yield pd.DataFrame([(key[0], checks, changes, gap, last)], columns=["key", "checks", "changes", "ewma_gap", "last_change"])


def cadence_stream(stream: DataFrame) -> DataFrame:
    """Cadence state of (key, at seconds, changed) as it comes."""
    return stream.groupBy("key").applyInPandasWithState(cadence, CADENCE_OUT, CADENCE_STATE, "update", GroupStateTimeout.NoTimeout)


def penalty(strikes: int, seconds: float, retry_hint: float | None, ok: bool, floor: float = 1.0, cap: float = 300.0) -> tuple[int, float]:
    """A host's pause after a response: doubled on a strike, at least the hint, at most the cap; halved on success."""
    if ok:
        return max(0, strikes - 1), max(floor, seconds / 2)
    return strikes + 1, min(cap, max(seconds * 2, retry_hint or 0.0, floor))


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Start a sink that acts on micro-batches; with ``once`` it takes all there is and stops."""
    w = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def append_json(path: str) -> Callable[[DataFrame, int], None]:
    """An action that appends each micro-batch once as JSON lines: its folder is named by the batch and replaced on a retry."""
    return lambda df, n: df.write.mode("overwrite").json(f"{path}/batch={n:012d}")
