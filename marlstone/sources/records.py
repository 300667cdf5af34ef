"""Record and revision frames: reading them, and bringing tables into their shape.

A record is (app, dataset, key, hash, data JSON text, first_seen, last_seen,
updated_at, removed_at, trust); a revision is (app, dataset, key, revision,
change, data, diff, created_at, trust, job_id, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.filters import all_of, parse_filters, trust_label
from marlstone.sources.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_records(df: DataFrame, app: str, dataset: str, key: Column, updated: Column, removed: Column | None = None, trust: Column | None = None) -> DataFrame:
    """Rows of any table as records, the row itself as JSON (``data``) and typed (``value``); columns that start with _ stay out of both.

    A query that doesn't ask for ``data`` never builds it, and members taken
    from ``value`` prune and filter the scan.
    """
    inside = [c for c in df.columns if c[0] != "_"]
    return df.select(
        F.lit(app).alias("app"), F.lit(dataset).alias("dataset"), key.cast("string").alias("key"), F.to_json(F.struct(*inside)).alias("data"), F.struct(*inside).alias("value"), updated.alias("updated_at"),
        (F.lit(None).cast("timestamp") if removed is None else removed).alias("removed_at"), (F.lit(None).cast("string") if trust is None else trust).alias("trust"),
    )


def members(records: DataFrame) -> dict[str, tuple[Column, str]]:
    """Path -> (column, kind) of the members that ``value`` holds as strings or integers and doubles."""
    if "value" not in records.columns:
        return {}
    kinds = {"string": "string", "bigint": "number", "int": "number", "double": "number"}
    return {f"$.{f.name}": (F.col(f"value.{f.name}"), kinds[k]) for f in records.schema["value"].dataType.fields if (k := f.dataType.simpleString()) in kinds}


def live(records: DataFrame) -> DataFrame:
    """Rows without a tombstone."""
    return records.where(F.col("removed_at").isNull())


def before_cursor(at: Column, key: Column, cursor: tuple[str, str] | None) -> Column:
    """What comes after the cursor in descending (at, key) order; everything without one."""
    if cursor is None:
        return F.lit(True)
    t = F.lit(cursor[0]).cast("timestamp")
    return (at < t) | ((at == t) & (key < cursor[1]))


def records_view(records: DataFrame, app: str, dataset: str, filters: list[str] | None = None, cursor: tuple[str, str] | None = None, limit: int | None = None, trust: str | None = None, removed: str = "exclude", mode: str = "sql") -> DataFrame:
    """The one reader behind lists, pages and exports: newest first, ties by key, predicates on the JSON."""
    out = records.where((F.col("app") == app) & (F.col("dataset") == dataset))
    if removed == "exclude":
        out = live(out)
    elif removed != "include":
        raise ValueError("removed is include or exclude")
    if trust not in (None, "", "all"):
        out = out.where(trust_label(F.col("trust")) == trust)
    out = out.where(all_of(parse_filters(filters), F.col("data"), mode, members(records))).where(before_cursor(F.col("updated_at"), F.col("key"), cursor))
    return out if limit is None else out.orderBy(F.desc("updated_at"), F.desc("key")).limit(limit)


def ordered_by_path(records: DataFrame, value: Column, limit: int) -> DataFrame:
    """Ascending by a JSON member: missing first, then numbers by value, then text; ties by key."""
    number = value.try_cast("double")
    rank = F.when(value.isNull(), 0).when(number.isNotNull(), 1).otherwise(2)
    return records.orderBy(rank, number.asc_nulls_first(), value.asc_nulls_first(), "key").limit(limit)


def cursor_of(at: str, tie: str) -> str:
    """``<timestamp>|<tie>``."""
    return f"{at}|{tie}"


def parse_cursor(text: str) -> tuple[str, str]:
    """Split at the first bar."""
    at, sep, tie = text.partition("|")
    if not sep:
        raise ValueError(f"not a cursor: {text!r}")
    return at, tie


def changes(revisions: DataFrame, since: str | None = None, dataset: str | None = None, trust: str | None = None, kinds: str = "any") -> DataFrame:
    """The change feed: revisions from ``since`` on, optionally of one dataset, trust and kind of change."""
    wanted = {"any": ("new", "changed", "removed"), "fresh": ("new", "changed")}.get(kinds, (kinds,))
    out = revisions.where(F.col("change").isin(*wanted))
    if since:
        out = out.where(F.col("created_at") > F.lit(since).cast("timestamp"))
    if dataset and dataset != "*":
        out = out.where(F.col("dataset") == dataset)
    return out if trust in (None, "", "all") else out.where(trust_label(F.col("trust")) == trust)


def event_revisions(events: DataFrame) -> DataFrame:
    """The events table as a revision feed: one dataset a type, one key a user, numbered in time order."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    n = F.row_number().over(w)
    return events.select(
        F.lit("events").alias("app"), F.col("event_type").alias("dataset"), F.col("user_id").cast("string").alias("key"), n.alias("revision"),
        F.when(n == 1, "new").when(F.pmod("event_id", F.lit(11)) == 0, "removed").otherwise("changed").alias("change"),
        F.col("props").alias("data"), F.col("value"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"), F.lag("props").over(w).alias("previous"),
        F.when(F.pmod("event_id", F.lit(7)) == 0, "provisional").when(F.pmod("event_id", F.lit(13)) == 0, "quarantined").alias("trust"),
        F.when(F.pmod("event_id", F.lit(5)) != 0, F.concat(F.lit("sha"), F.pmod("event_id", F.lit(97)).cast("string"))).alias("artifact_sha"),
        F.when(F.pmod("event_id", F.lit(3)) != 0, F.concat(F.lit("rules"), F.pmod("event_id", F.lit(9)).cast("string"))).alias("rules_hash"),
        F.concat(F.lit("job"), F.floor(F.col("event_id") / 50).cast("string")).alias("job_id"),
    )
