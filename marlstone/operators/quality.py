"""Statistical data quality: field sketches, drift terms, verdicts, invariants, contracts, state machine, doctor."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import stats
from marlstone.operators.kernels import value_ranks
from marlstone.sources.shipping import ship

# Weights of the five terms, gates of a run, and bounds of a collapse.
WEIGHTS = {"missrate": 0.30, "distinct": 0.20, "invariant": 0.20, "shape": 0.15, "divergence": 0.15}
FETCH_FLOOR, DEGRADE, MIN_DOCS = 0.7, 0.5, 10
COLLAPSE_DOCS, COLLAPSE_RUN, COLLAPSE_BASE = 5, 0.9, 0.1


def field_sketch(values: DataFrame, by: list[str], value: str, at: list[str] | None = None) -> DataFrame:
    """A row a group: count, misses, length moments and log2 histogram, character shares, distinct ratio. Mergeable sums only but the last.

    Different values are counted by themselves: beside them, Spark would add
    up the shares value by value in hash order, and not as the rows come. With
    ``at``, columns that order the rows, the shares are added up in that order
    whatever tasks the rows are dealt to, as SQL does on one thread; else as
    the partial sums come, which leaves the last digits open.
    """
    c = F.col(value)
    miss = c.isNull() | (F.trim(c) == "")
    n = F.length(c)
    names = [f"_share{k}" for k in range(4)]
    shares = [] if at else [F.sum(F.when(~miss, stats.char_shares(c)[k])).alias(names[k]) for k in range(4)]
    hist = [F.count_if(~miss & (stats.len_bucket(n) == k)) for k in range(16)]
    sums = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(miss).alias("misses"), F.avg(F.when(~miss, n)).alias("mean_len"), F.stddev_pop(F.when(~miss, n)).alias("sd_len"),
        F.array(*hist).alias("len_hist"), *shares, F.count_if(~miss).alias("_held"),
    )
    different = values.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(F.countDistinct(F.when(~miss, c)).alias("_different"))
    same = lambda prefix: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in by])
    both = sums.join(different, same("_"))
    if at:
        rows = values.where(~miss).select(*by, *at, F.transform(stats.char_shares(c), lambda x: x.cast("double")).alias("_shares"))
        added = added_in_order(rows, by, at, "_shares").withColumnsRenamed({k: f"_of_{k}" for k in by})
        both = both.join(added.select(*[f"_of_{k}" for k in by], *[F.col("_shares")[k].alias(names[k]) for k in range(4)]), same("_of_"), "left")
    held = F.nullif(F.col("_held"), F.lit(0))
    classes = F.array(*[F.col(k) / held for k in names])
    return both.select(*by, "n", "misses", "mean_len", "sd_len", "len_hist", classes.alias("classes"), (F.col("_different") / held).alias("distinct_ratio"))


def added_in_order(rows: DataFrame, by: list[str], at: list[str], values: str) -> DataFrame:
    """(by, values): the arrays of doubles of each group added up place by place, row after row in the order of ``at``.

    Sums of doubles depend on their order, so a group is one task's stream of
    narrow rows; it holds a batch at a time, and the sort before it spills.
    """
    ship(rows.sparkSession)
    kinds = {k: rows.schema[k].dataType.simpleString() for k in by}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, kind = None, None, None
        for batch in batches:
            kind, start = batch.schema, 0
            lists = batch.column(values)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else None
            for group, same in itertools.groupby(zip(*(batch.column(k).to_pylist() for k in by), strict=True)):
                end = start + sum(1 for _ in same)
                if group != key and total is not None:
                    yield made(key, total, kind)
                first = x[start:end] if group != key or total is None else np.concatenate([total[None], x[start:end]])
                key, total, start = group, np.add.accumulate(first)[-1], end
        if total is not None:
            yield made(key, total, kind)

    def made(key: tuple, total: np.ndarray, kind: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([v], kind.field(k).type) for k, v in zip(by, key, strict=True)), pa.array([total.tolist()], pa.list_(pa.float64()))], [*by, values])

    sorted_rows = rows.select(*by, *at, values).repartition(*by).sortWithinPartitions(*by, *at).select(*by, values)
    return sorted_rows.mapInArrow(run, ", ".join([f"`{k}` {t}" for k, t in kinds.items()] + [f"`{values}` array<double>"]))


def missrate_term(k: Column, n: Column, bk: Column, bn: Column) -> Column:
    """Share of the head room lost where the run's rate lies above the baseline's interval."""
    rate, base = k / n, bk / bn
    return F.when((n > 0) & (bn > 0) & stats.rate_rose(k, n, bk, bn) & (base < 1), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (rate - base) / (1 - base)))).otherwise(0.0)


def verdict(docs: Column, fetch_ok: Column, collapsed: Column, quiet: Column, terms: dict[str, Column]) -> Column:
    """struct(verdict, score): gates in order, then the weighted terms against the threshold."""
    score = F.least(F.lit(1.0), sum((w * terms[k] for k, w in WEIGHTS.items()), F.lit(0.0)))
    named = lambda v, s: F.struct(F.lit(v).alias("verdict"), s.cast("double").alias("score"))
    zero = F.lit(0.0)
    return (
        F.when(fetch_ok < FETCH_FLOOR, named("inconclusive", zero)).when(collapsed, named("broken", F.lit(1.0))).when(quiet, named("content_empty", zero))
        .when(docs < MIN_DOCS, named("below_cohort", zero)).when(score >= DEGRADE, named("broken", F.round(score, 4))).otherwise(named("ok", F.round(score, 4)))
    )


def cohort_drift(now: DataFrame, before: DataFrame, key: str, channels: list[str]) -> DataFrame:
    """One row: documents in common, and the median drift (share of bits) of each fingerprint channel."""
    j = now.select(key, *[F.col(c).alias(f"n_{c}") for c in channels]).join(before.select(key, *[F.col(c).alias(f"b_{c}") for c in channels]), key)
    d = lambda c: F.bit_count(F.col(f"n_{c}").bitwiseXOR(F.col(f"b_{c}"))) / 64.0
    return j.agg(F.count(F.lit(1)).alias("common"), *[F.median(d(c)).alias(f"{c}_drift") for c in channels])


# --- invariants ------------------------------------------------------------


def mine_invariants(values: DataFrame, field_col: str, value: str, conf: float = 0.99, support: int = 500, trim: float = 0.01) -> DataFrame:
    """(field, kind, detail, support): never null, numeric, range without the outer percent, one pattern, distinct.

    Quantiles are exact ranks over a field's different values.
    """
    v = F.col(value)
    num = v.try_cast("double")
    rows = values.select(F.col(field_col).alias("field"), v.alias("v"), num.alias("x"), pattern_of(v).alias("p"))
    base = rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("held"), F.count("x").alias("numbers"), F.countDistinct("v").alias("distinct"))
    enough = base.where(F.col("n") >= support)
    out = [
        enough.where(F.col("held") >= conf * F.col("n")).select("field", F.lit("nonnull").alias("kind"), F.lit("").alias("detail"), "n"),
        enough.where(F.col("numbers") >= conf * F.col("held")).select("field", F.lit("type"), F.lit("number"), "held"),
        enough.where(F.col("distinct") >= 0.9 * F.col("held")).select("field", F.lit("distinct"), F.lit(""), "held"),
    ]
    r = value_ranks(rows, ["field"], "x")
    cut = F.floor(F.col("n") * trim)
    inside = (F.col("rank") + F.col("count") > cut) & (F.col("rank") < F.col("n") - cut)
    rng = r.where(inside).groupBy("field").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("n").alias("m"))
    out.append(rng.join(enough.where(F.col("numbers") >= conf * F.col("held")).select("field"), "field").select("field", F.lit("range"), F.concat_ws("..", F.col("lo").cast("decimal(28,4)").cast("string"), F.col("hi").cast("decimal(28,4)").cast("string")), "m"))
    pats = rows.where("v is not null").groupBy("field", "p").agg(F.count(F.lit(1)).alias("c"))
    tot = pats.groupBy("field").agg(F.max(F.struct("c", "p")).alias("b"), F.sum("c").alias("t"))
    out.append(tot.where((F.col("b.c") >= conf * F.col("t")) & (F.col("t") >= support)).select("field", F.lit("pattern"), F.col("b.p"), "t"))
    both = out[0]
    for o in out[1:]:
        both = both.union(o)
    return both.toDF("field", "kind", "detail", "support")


def pattern_of(c: Column) -> Column:
    """The class pattern of a value: runs of digits, letters and spaces as classes."""
    p = F.regexp_replace(c, r"[0-9]+", "\u0001")
    p = F.regexp_replace(p, r"\p{IsAlphabetic}+", "\u0002")
    p = F.regexp_replace(p, r"\s+", "\u0003")
    return F.replace(F.replace(F.replace(p, F.lit("\u0001"), F.lit("[0-9]+")), F.lit("\u0002"), F.lit("[a-z]+")), F.lit("\u0003"), F.lit("\\s+"))


# --- contracts -------------------------------------------------------------


@dataclass(frozen=True)
class Contract:
    """What a dataset has promised."""

    required: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    max_row_delta_pct: float | None = None
    enforce: bool = False


def contract_report(df: DataFrame, c: Contract, previous_rows: Column | None = None) -> DataFrame:
    """(rule, broke) for each rule, one aggregation over the data."""
    aggs = {f"required:{f}": F.count_if(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")) for f in c.required}
    aggs |= {f"type:{f}": F.count_if(F.col(f).isNotNull() & F.col(f).try_cast("double").isNull()) for f in c.numeric}
    for f, (lo, hi) in c.ranges.items():
        x = F.col(f).try_cast("double")
        out = F.lit(False)
        if lo is not None:
            out = out | (x < lo)
        if hi is not None:
            out = out | (x > hi)
        aggs[f"range:{f}"] = F.count_if(out)
    if c.max_row_delta_pct is not None and previous_rows is not None:
        delta = F.abs(F.count(F.lit(1)) - previous_rows) * 100.0 / previous_rows
        aggs["row_delta"] = F.when(delta > c.max_row_delta_pct, F.lit(1)).otherwise(0).cast("long")
    one = df.agg(F.array(*[F.struct(F.lit(n).alias("rule"), a.alias("broke")) for n, a in aggs.items()]).alias("r"))
    return one.select(F.inline("r"))


def contract_verdict(report: DataFrame, enforce: bool) -> DataFrame:
    """One row: violations and pass, warn or block."""
    n = F.count_if(F.col("broke") > 0)
    return report.agg(n.alias("violations"), F.when(n == 0, "pass").otherwise("block" if enforce else "warn").alias("verdict"))


# --- state machine ---------------------------------------------------------

STATES = ("healthy", "suspect", "degraded", "quarantined", "probation")


def next_state(state: str, bad: bool, judged: bool, streak: int) -> tuple[str, int]:
    """One run's step; ``streak`` counts runs of the same kind since the state was entered. Unjudged runs change nothing.

    Two bad runs degrade a suspect, three more quarantine it; a suspect or
    degraded source heals after two clean runs, a quarantined one goes on
    probation after one and is healthy after three clean ones there.
    """
    if not judged:
        return state, streak
    steps = {("healthy", True): (1, "suspect"), ("suspect", True): (1, "degraded"), ("degraded", True): (3, "quarantined"), ("probation", True): (1, "quarantined"), ("suspect", False): (2, "healthy"), ("degraded", False): (2, "suspect"), ("quarantined", False): (1, "probation"), ("probation", False): (3, "healthy")}
    streak = max(streak, 0) + 1 if bad else min(streak, 0) - 1
    need, to = steps.get((state, bad), (0, state))
    return (to, 0) if need and abs(streak) >= need else (state, streak)


def replay_states(runs: DataFrame, source: str, at: str, tie: str, bad: str, judged: str) -> DataFrame:
    """(source, at, tie, state) after each run: a fold in time order over sorted partitions, one state held, however long a source's log is."""
    ship(runs.sparkSession)
    rows = runs.select(source, at, tie, bad, judged).repartition(source).sortWithinPartitions(source, at, tie)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (source, at, tie)) + ", state string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, streak = object(), "healthy", 0
        for batch in batches:
            out = []
            for k, b, j in zip(*(batch.column(c).to_pylist() for c in (source, bad, judged)), strict=True):
                if k != last:
                    last, state, streak = k, "healthy", 0
                state, streak = next_state(state, bool(b), bool(j), streak)
                out.append(state)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (source, at, tie)), pa.array(out, pa.string())], [source, at, tie, "state"])

    return rows.mapInArrow(fold, schema)


def scrapeability(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the components that are there, in percent with one decimal."""
    top = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()), F.lit(0.0))
    low = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    return F.when(low > 0, F.round(100 * top / low, 1))


def findings(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(finding, n) for integrity checks whose frame has rows."""
    out = None
    for name, df in checks:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


VALID_NAME = re.compile(r"^[a-z][a-z0-9_-]*$")
