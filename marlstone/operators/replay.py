"""Replays and plans: comparing two extractions, re-deriving archived bodies, samples, schedules, buckets, yields, lineage of fields."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_values(extracted: DataFrame, fields: list[str], key: str) -> DataFrame:
    """(key, field, value JSON text or null) of extracted data."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.get_json_object("data", f"$['{f}']").alias("value")) for f in fields]))
    return extracted.select(key, pairs.alias("p")).select(key, "p.*")


def field_diff(base: DataFrame, candidate: DataFrame, fields: list[str], key: str, samples: int = 20) -> DataFrame:
    """A row a field: match rates of both rule sets on the same documents, their difference, and what was added, lost or changed.

    At most ``samples`` keys that differ are shown, smallest first. Worst difference first by ``delta``.
    """
    a, b = field_values(base, fields, key).withColumnRenamed("value", "a"), field_values(candidate, fields, key).withColumnRenamed("value", "b")
    j = a.join(b, [key, "field"])
    has = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    kind = F.when(has("b") & ~has("a"), "added").when(has("a") & ~has("b"), "lost").when(has("a") & has("b") & (F.col("a") != F.col("b")), "changed")
    j = j.withColumn("kind", kind)
    shown = j.where("kind is not null").withColumn("_n", F.row_number().over(Window.partitionBy("field").orderBy(key))).where(F.col("_n") <= samples)
    shown = shown.groupBy("field").agg(F.array_sort(F.collect_list(key)).alias("samples"))
    rate = lambda c: F.round(F.count_if(has(c)) / F.count(F.lit(1)), 3)
    out = j.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), rate("a").alias("base_rate"), rate("b").alias("candidate_rate"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "lost", "changed")])
    return out.withColumn("delta", F.round(F.col("candidate_rate") - F.col("base_rate"), 3)).join(shown, "field", "left")


def rederived(bodies: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, same): whether the stored value is what its body gives now; both are canonical JSON in ``data``."""
    return bodies.select(key, F.col("data").alias("_a")).join(stored.select(key, F.col("data").alias("_b")), key).select(key, F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


def newest_and_random(df: DataFrame, group: str, order: list[Column], key: str, n: int, seed: int) -> DataFrame:
    """For each group the newest half of ``n`` and the rest by a seeded hash of the key: a sampling operator."""
    w = lambda o: F.row_number().over(Window.partitionBy(group).orderBy(*o))
    half = (n + 1) // 2
    ranked = df.withColumn("_a", w(order))
    ranked = ranked.withColumn("_b", F.row_number().over(Window.partitionBy(group, F.col("_a") <= half).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)))
    return ranked.where((F.col("_a") <= half) | (F.col("_b") <= n - half)).drop("_a", "_b")


def url_allowed(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Any of the included patterns (or none given), and none of the excluded."""
    any_of = lambda ps: reduce(lambda a, b: a | b, [url.rlike(p) for p in ps], F.lit(False))
    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)


def cron_field(text: str, lo: int, hi: int) -> set[int]:
    """Numbers of one field of a schedule: *, lists, ranges and steps."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (lo, hi) if span == "*" else (int(a), int(b or (hi if step else a)))
        if not lo <= first <= last <= hi:
            raise ValueError(f"not a schedule field: {text!r}")
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def firings(cron: str, after: datetime, until: datetime) -> list[datetime]:
    """Minutes at which a five-field schedule fires in (after, until]; days of month and week both restrict unless one is *."""
    fields = cron.split()
    if len(fields) != 5:
        raise ValueError("a schedule has five fields")
    m, h, dom, mon, dow = (cron_field(f, lo, hi) for f, (lo, hi) in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
    dow = {x % 7 for x in dow}
    t, out = after.replace(second=0, microsecond=0) + timedelta(minutes=1), []
    while t <= until:
        day = (t.day in dom, t.isoweekday() % 7 in dow)
        ok = any(day) if fields[2] != "*" and fields[4] != "*" else all(day)
        if t.month not in mon or not ok:
            t = (t + timedelta(days=1)).replace(hour=0, minute=0)
        elif t.hour not in h:
            t = (t + timedelta(hours=1)).replace(minute=0)
        else:
            if t.minute in m:
                out.append(t)
            t += timedelta(minutes=1)
    return out


def decide(missed: list[datetime], running: bool, policy: str) -> str:
    """idle, fire or skip; with ``collapse`` any number of missed firings is one."""
    if not missed:
        return "idle"
    return "skip" if running else "fire" if policy == "collapse" or len(missed) == 1 else "skip-then-fire"


def bucket_step(tokens: float, last: float, now: float, rate: float, burst: float) -> tuple[bool, float]:
    """Whether a request at ``now`` may pass, and the tokens left."""
    held = min(burst, tokens + max(0.0, now - last) * rate)
    return (True, held - 1) if held >= 1 else (False, held)


def yields(value: Any, depth: int = 3, most: int = 16) -> list[tuple[str, int]]:
    """(name, count) of the counted lists and numbers in a job's result, to a depth and number that are the report's format."""
    out: list[tuple[str, int]] = []

    def go(name: str, v: Any, left: int) -> None:
        if isinstance(v, list):
            out.append((name, len(v)))
        elif isinstance(v, int) and not isinstance(v, bool):
            out.append((name, v))
        elif isinstance(v, dict) and left:
            for k in sorted(v):
                go(f"{name}.{k}" if name else k, v[k], left - 1)

    go("", value, depth)
    return out[:most]


def field_lineage(rules: dict[str, dict[str, Any]], source: str) -> list[tuple[str, str, str]]:
    """(source, field, operation) of a rule set, with one level of ``each``."""
    def op(r: dict[str, Any]) -> str:
        what = next((str(r[k]) for k in ("selector", "pattern", "pointer", "path", "value") if k in r), "")
        return " | ".join([f"{r['kind']}({what})", *[t["kind"] for t in r.get("transforms", ())]])

    out = []
    for name, r in rules.items():
        out.append((source, name, op(r)))
        out += [(source, f"{name}.{k}", op(x)) for k, x in r.get("fields", {}).items()]
    return out


def host_merge(local: DataFrame, remote: DataFrame, host: str, sums: list[str], worst: list[str]) -> DataFrame:
    """Profiles of two sides by host: counters add up, penalties take the larger."""
    both = local.unionByName(remote)
    return both.groupBy(host).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in worst])


def level_changes(stored: DataFrame, now: DataFrame, key: str, level: str) -> DataFrame:
    """(key, level, write, act): written on any change, acted on where the level rises."""
    j = now.select(key, level).join(stored.select(key, F.col(level).alias("_s")), key, "left")
    before = F.coalesce("_s", F.lit(0))
    return j.select(key, level, (before != F.col(level)).alias("write"), (F.col(level) > before).alias("act"))
