"""The versioned store: verdicts of a batch against the current state, revisions, tombstones and their guards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import jsonv
from marlstone.sources.shipping import ship

HEALTH = ("healthy", "suspect", "degraded", "quarantined", "probation")


def fingerprinted(rows: DataFrame, data: str = "data", derived: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``hash`` (of the canonical JSON less derived paths) and ``canon`` (the canonical text).

    Malformed or null JSON has null for both. One Arrow pass.
    """
    ship(rows.sparkSession)
    fields = [f.name for f in rows.schema.fields if f.name not in ("hash", "canon")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, texts = [], []
            for text in batch.column(data).to_pylist():
                v = jsonv.parse(text)
                hashes.append(None if v is jsonv.MISSING else jsonv.content_hash(v, list(derived)))
                texts.append(None if v is jsonv.MISSING else jsonv.canonical(v))
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], [*fields, "hash", "canon"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in fields)
    return rows.select(*fields).mapInArrow(run, f"{schema}, hash string, canon string")


def verdicts(state: DataFrame, batch: DataFrame) -> DataFrame:
    """One row (key, seq, hash, action, revision) for each row of ``batch`` (key, seq, hash) against ``state`` (key, hash, removed_at, revision).

    ``new``, ``changed`` or ``unchanged``; a key met twice in a batch is judged
    against its earlier row; a tombstone that comes back is changed even with
    the same hash. Each new or changed row takes the key's next revision.
    """
    w = Window.partitionBy("key").orderBy("seq")
    s = state.select("key", F.col("hash").alias("_hash"), F.col("removed_at").alias("_removed"), F.col("revision").alias("_revision"), F.lit(True).alias("_known"))
    joined = batch.join(s, "key", "left").withColumn("_before", F.lag("hash").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    action = (
        F.when(~F.col("_first"), F.when(F.col("hash") == F.col("_before"), "unchanged").otherwise("changed"))
        .when(F.col("_known").isNull(), "new").when(F.col("_removed").isNotNull(), "changed").when(F.col("hash") == F.col("_hash"), "unchanged").otherwise("changed")
    )
    out = joined.withColumn("action", action)
    step = F.sum(F.when(F.col("action") != "unchanged", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("revision", (F.coalesce("_revision", F.lit(0)) + step).cast("long")).select("key", "seq", "hash", "action", "revision")


def removals(state: DataFrame, present: DataFrame, health: str | None) -> DataFrame:
    """Live keys of ``state`` that a whole snapshot lacks. Needs a healthy source; an empty snapshot removes nothing."""
    if health is None:
        raise ValueError("removals need the source's health")
    gone = state.where("removed_at is null").join(present.select("key").distinct(), "key", "left_anti").select("key")
    if health not in ("healthy", "probation"):
        return gone.where(F.lit(False))
    some = present.limit(1).agg((F.count(F.lit(1)) > 0).alias("_some"))
    return gone.crossJoin(F.broadcast(some)).where("_some").drop("_some")  # a single row


def last_writes(batch: DataFrame) -> DataFrame:
    """Of several rows for one key, the last by ``seq``."""
    others = [c for c in batch.columns if c not in ("key", "seq")]
    return batch.groupBy("key").agg(F.max_by(F.struct("seq", *others), "seq").alias("r")).select("key", "r.*")


def applied(state: DataFrame, batch: DataFrame, at: str) -> DataFrame:
    """The state after a batch (key, seq, hash, data, trust): last writes win, unchanged rows move last_seen and trust only."""
    last, now = last_writes(batch), F.lit(at).cast("timestamp")
    v = verdicts(state, batch).groupBy("key").agg(F.max("revision").alias("_rev"), F.max(F.when(F.col("action") != "unchanged", 1).otherwise(0)).alias("_moved"))
    n = last.join(v, "key").select("key", F.col("hash").alias("_h"), F.col("data").alias("_d"), F.col("trust").alias("_t"), "_rev", "_moved")
    j = state.join(n, "key", "full_outer")
    hit, moved = F.col("_rev").isNotNull(), F.coalesce("_moved", F.lit(0)) == 1
    return j.select(
        "key", F.when(hit, F.col("_h")).otherwise(F.col("hash")).alias("hash"), F.when(hit, F.col("_d")).otherwise(F.col("data")).alias("data"),
        F.when(hit, F.col("_t")).otherwise(F.col("trust")).alias("trust"), F.when(moved, None).otherwise(F.col("removed_at")).alias("removed_at"),
        F.coalesce("_rev", "revision").alias("revision"), F.when(hit, now).otherwise(F.col("last_seen")).alias("last_seen"), F.when(moved, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def removed_revisions(gone: DataFrame, state: DataFrame, at: str) -> DataFrame:
    """Revisions of kind removed: no data, diff, trust or provenance."""
    none = {c: F.lit(None).cast("string") for c in ("data", "diff", "trust", "source_url", "artifact_sha", "rules_hash")}
    return gone.join(state.select("key", "revision"), "key").select("key", (F.col("revision") + 1).alias("revision"), F.lit("removed").alias("change"), F.lit(at).cast("timestamp").alias("created_at"), *[c.alias(n) for n, c in none.items()])


def diffs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (key, old, new JSON texts) with the field-level diff as a map path -> {from, to} of JSON texts."""

    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.struct([("from", pa.string()), ("to", pa.string())]))
        for batch in batches:
            out = []
            for a, b in zip(batch.column("old").to_pylist(), batch.column("new").to_pylist(), strict=True):
                x, y = (None if (v := jsonv.parse(t)) is jsonv.MISSING else v for t in (a, b))
                out.append([(p, {k: jsonv.canonical(c) for k, c in d.items()}) for p, d in jsonv.diff(x, y).items()])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, kind)], ["key", "diff"])

    return pairs.select(F.col("key").cast("string").alias("key"), "old", "new").mapInArrow(run, "key string, diff map<string,struct<from:string,to:string>>")


def quarantine_dataset(dataset: str, state: str) -> str:
    """Where a source's writes go: aside while it is quarantined."""
    return f"{dataset}@q" if state == "quarantined" else dataset


def coverage(expected: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """One row: expected, covered, ratio, and how many are missing."""
    c = covered.select(F.col(key).alias("_k")).distinct()
    j = expected.select(key).distinct().join(c, F.col(key) == F.col("_k"), "left")
    return j.agg(F.count(F.lit(1)).alias("expected"), F.count("_k").alias("covered")).withColumn("ratio", F.when(F.col("expected") > 0, F.col("covered") / F.col("expected"))).withColumn("missing", F.col("expected") - F.col("covered"))
