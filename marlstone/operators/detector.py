"""Quality of a run against its source's earlier runs: mergeable sketches, baseline frames, five weighted terms, verdict, diagnosis and reasons.

Everything works on a row a (source, run, field), which sketches bring raw
values down to; only those rows are windowed, joined and judged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import stats
from marlstone.operators.quality import WEIGHTS
from marlstone.sources.stored import fresh_path, remove

BUCKETS, CLASSES = 16, 4
COUNTS = ("n", "empty", "error", "container_empty", "coerced", "coercion_failed", "held")
# What a distributional test needs, its tolerances, and the bounds of collapses.
LEAST_RUNS, PER_RECORD, RATIO_TOL, SHAPE_TOL = 3, 0.5, 0.02, 0.10
COLLAPSE_DOCS, COLLAPSE_RUN, COLLAPSE_BASE = 5, 0.9, 0.1
REBIND_BASE, REBIND_RUN = 0.9, 0.1


@dataclass(frozen=True)
class Limits:
    """Thresholds of a judgement."""

    min_docs: int = 30
    window: int = 20
    degrade: float = 0.6
    fetch_floor: float = 0.7
    mad_z: float = 3.5
    drift_low: float = 0.08
    drift_high: float = 0.20
    broke: float = 0.2


# --- sketches --------------------------------------------------------------


def sketched(values: DataFrame, by: tuple[str, ...] = ("source", "run", "field"), value: str = "value", status: str = "status", coerced: str = "coerced", precision: int = 14, exact: bool = False) -> DataFrame:
    """A row a group of ``by``: counts, length histogram and character counts of the values held, and a sketch of different ones.

    ``status`` is matched, empty, error or container_empty; ``coerced`` true or
    false where a value was to be coerced, else null. Sums and a HyperLogLog
    sketch only, so ``merged`` parts equal the whole. ``exact`` adds
    ``different``, the exact number of different values, which judgements then
    go by; it can't be merged.
    """
    v, s = F.col(value), F.col(status)
    held = (s == "matched") & v.isNotNull()
    kept, n = F.when(held, v), F.length(F.when(held, v))
    found = [F.regexp_count(kept, F.lit(p)) for p in ("[0-9]", r"\p{IsAlphabetic}", r"\s")]
    chars = [*found, n - found[0] - found[1] - found[2]]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(s == k).alias(k) for k in ("empty", "error", "container_empty")], F.count_if(F.col(coerced)).alias("coerced"), F.count_if(~F.col(coerced)).alias("coercion_failed"), F.count_if(held).alias("held"),
        F.array(*[F.count_if(held & (stats.len_bucket(n) == k)) for k in range(BUCKETS)]).alias("lengths"), F.array(*map(total, chars)).alias("chars"), F.hll_sketch_agg(kept, precision).alias("seen"),
    )
    if not exact:
        return sums
    different = values.where(held).select(*by, v.alias("_v")).distinct().groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(F.count(F.lit(1)).alias("_different"))
    both = sums.join(different, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]), "left")
    return both.select(*sums.columns, F.coalesce("_different", F.lit(0)).alias("different"))


def merged(sketches: DataFrame, by: tuple[str, ...] = ("source", "run", "field")) -> DataFrame:
    """Sketches of parts as one a group."""
    each = lambda c, k: F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(c)
    return sketches.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS], each("lengths", BUCKETS), each("chars", CLASSES), F.hll_union_agg("seen").alias("seen"))


def _share(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(a, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def _described(sketches: DataFrame) -> DataFrame:
    """Sketches with their ratios and profiles."""
    different = F.col("different") if "different" in sketches.columns else F.hll_sketch_estimate("seen")
    return sketches.withColumns({
        "misses": F.col("empty") + F.col("error"), "tried": F.col("coerced") + F.col("coercion_failed"),
        "distinct": F.when(F.col("held") > 0, F.least(F.lit(1.0), different / F.col("held"))).otherwise(0.0), "length_shape": _share(F.col("lengths")), "char_class_shape": _share(F.col("chars")),
    })


# --- baselines -------------------------------------------------------------


def framed(sketches: DataFrame, runs: DataFrame, limits: Limits) -> DataFrame:
    """Described sketches with ``base``: the last ``window`` healthy runs' sketches of the field before this run, newest last.

    ``runs`` (source, run, healthy) numbers a source's healthy runs; a range
    frame over that number takes the last ``window`` of them whatever lies
    between, so a row never gathers more than ``window``.
    """
    before = F.coalesce(F.sum(F.col("healthy").cast("long")).over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = runs.select("source", "run", "healthy", before.alias("_before"))
    w = Window.partitionBy("source", "field").orderBy("_before").rangeBetween(-limits.window, -1)
    kept = F.when(F.col("healthy"), F.struct("run", "n", "misses", "tried", "coercion_failed", "distinct", "length_shape", "char_class_shape"))
    return _described(sketches).join(numbered, ["source", "run"]).withColumn("base", F.sort_array(F.collect_list(kept).over(w))).drop("healthy", "_before")


def _series(name: str) -> Column:
    return F.transform("base", lambda b: b[name])


def _part(profiles: Column, k: int) -> Column:
    return F.transform(profiles, lambda p: p[k])


def _pooled(name: str) -> Column:
    return F.aggregate("base", F.lit(0).cast("long"), lambda s, b: s + b[name])


def _apart(p: Column, q: Column) -> Column:
    """Half of the summed differences of two profiles."""
    return F.least(F.lit(1.0), F.aggregate(F.zip_with(p, q, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 2)


# --- terms -----------------------------------------------------------------


def _test(name: str, score: Column, run: Column, base: Column) -> Column:
    return F.struct(F.lit(name).alias("test"), score.cast("double").alias("score"), run.cast("double").alias("run"), base.cast("double").alias("base"))


def field_tests(frames: DataFrame, limits: Limits) -> DataFrame:
    """(source, run, field, tests): the tests of a field that fire, each with its score and both figures."""
    def rate(name: str, k: str, n: str) -> Column:
        bk, bn = _pooled(k), _pooled(n)
        run, base = F.col(k) / F.col(n), bk / bn
        rose = (F.col(n) > 0) & (bn > 0) & stats.rate_rose(F.col(k), F.col(n), bk, bn)
        lost = F.when(base < 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (run - base) / (1 - base)))).otherwise(0.0)
        return F.when(rose, _test(name, lost, run, base))

    enough = F.size("base") >= LEAST_RUNS
    ratios = _series("distinct")
    usual, z = stats.median_of(ratios), stats.robust_z(F.col("distinct"), ratios, RATIO_TOL, LEAST_RUNS)
    distinct = F.when(enough & (usual >= PER_RECORD) & (z <= -limits.mad_z), _test("distinct_ratio", F.greatest(F.lit(0.0), (usual - F.col("distinct")) / usual), F.col("distinct"), usual))

    def shape(name: str) -> Column:
        centre = F.col(f"_centre_{name}")
        tv, history = _apart(F.col(name), centre), F.transform(_series(name), lambda p: _apart(p, centre))
        z = stats.robust_z(tv, history, SHAPE_TOL, LEAST_RUNS)
        return F.when(enough & (z >= limits.mad_z) & (tv >= SHAPE_TOL), _test(name, tv, tv, stats.median_of(history)))

    shapes = (("length_shape", BUCKETS), ("char_class_shape", CLASSES))
    for name, size in shapes:
        past = _series(name)
        frames = frames.withColumn(f"_centre_{name}", F.when(enough, F.array(*[stats.median_of(_part(past, k)) for k in range(size)])))
    tests = [rate("miss_rate", "misses", "n"), rate("coercion_failure_rate", "coercion_failed", "tried"), distinct, *[shape(name) for name, _ in shapes]]
    bk, bn = _pooled("misses"), _pooled("n")
    collapsed = (F.col("n") >= COLLAPSE_DOCS) & (F.col("misses") / F.col("n") >= COLLAPSE_RUN) & (bn >= COLLAPSE_DOCS) & (bk / bn <= COLLAPSE_BASE)
    rebound = enough & (usual >= REBIND_BASE) & (F.col("distinct") <= REBIND_RUN)
    return frames.select(
        "source", "run", "field", "n", "misses", F.filter(F.array(*tests), lambda t: t.isNotNull()).alias("tests"), F.coalesce(collapsed, F.lit(False)).alias("collapsed"), F.coalesce(rebound, F.lit(False)).alias("rebound"),
        ((F.col("n") > 0) & (F.col("container_empty") == F.col("n"))).alias("quiet"), F.coalesce(F.array_max(_series("n")), F.lit(0)).alias("peak"),
    )


def divergence(text: Column, dom: Column, value: Column, limits: Limits) -> Column:
    """Where a run lies by the drift of its texts, markup and values: markup_drift, self_inflicted, content_changed, ambiguous; null while values hold still or nothing is known."""
    still = lambda c: c <= limits.drift_low
    moved = lambda c: c >= limits.drift_high
    return F.when(moved(value), F.when(still(text) & moved(dom), "markup_drift").when(still(text) & still(dom), "self_inflicted").when(~still(text) & ~moved(dom), "content_changed").otherwise("ambiguous"))


def evaluated(sketches: DataFrame, runs: DataFrame, invariants: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """A row a run: verdict, diagnosis, score, cohort, the five terms and the names of the reasons.

    ``runs`` (source, run, docs, attempted, ok, healthy, d_text, d_dom, d_val):
    its documents and fetches, whether it may serve later runs as baseline, and
    the median drift of its three channels (null without one). ``invariants``
    (source, run, field, kind, support, checked, broke). Runs without sketches
    are judged on their own figures. Gates come in order: fetches, a field that
    vanished, a quiet listing, a small cohort; then the weighted terms, unless
    a field that told records apart became constant and no change of content
    explains it.
    """
    tests = field_tests(framed(sketches, runs, limits), limits)
    best = lambda *names: F.coalesce(F.array_max(F.transform(F.filter(F.flatten(F.collect_list("tests")), lambda t: t["test"].isin(*names)), lambda t: t["score"])), F.lit(0.0))
    fields = tests.groupBy("source", "run").agg(
        best("miss_rate", "coercion_failure_rate").alias("missrate"), best("distinct_ratio").alias("distinct"), best("length_shape", "char_class_shape").alias("shape"), F.max("peak").alias("peak"),
        F.bool_or("collapsed").alias("collapsed"), F.bool_or("rebound").alias("rebound"), (F.bool_or("quiet") & (F.sum("misses") == 0)).alias("quiet"),
        F.flatten(F.collect_list(F.transform("tests", lambda t: F.concat_ws(":", t["test"], F.col("field"))))).alias("fired"),
        F.collect_list(F.when(F.col("collapsed"), F.concat(F.lit("total_collapse:"), F.col("field")))).alias("gone"), F.collect_list(F.when(F.col("rebound"), F.concat(F.lit("distinctness_collapse:"), F.col("field")))).alias("same"),
    )
    out = runs.join(fields, ["source", "run"], "left")
    if invariants is not None:
        violated = (F.col("checked") > 0) & (F.col("broke") / F.col("checked") >= limits.broke)
        inv = invariants.groupBy("source", "run").agg((F.sum(F.when(violated, F.col("support")).otherwise(0)) / F.nullif(F.sum("support"), F.lit(0))).alias("invariant"), F.collect_set(F.when(violated, F.concat_ws(":", F.lit("invariant"), "kind", "field"))).alias("violations"))
        out = out.join(inv, ["source", "run"], "left")
    else:
        out = out.withColumns({"invariant": F.lit(0.0), "violations": F.array().cast("array<string>")})
    none = F.array().cast("array<string>")
    cell = divergence(F.col("d_text"), F.col("d_dom"), F.col("d_val"), limits)
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("missrate", "distinct", "shape", "invariant")} | {c: F.coalesce(c, F.lit(False)) for c in ("collapsed", "rebound", "quiet")} | {c: F.coalesce(c, none) for c in ("fired", "gone", "same", "violations")} | {"peak": F.coalesce("peak", F.lit(0)), "cell": cell})
    out = out.withColumn("divergence", F.when(F.col("cell").isin("markup_drift", "self_inflicted"), 1.0).when(F.col("cell") == "ambiguous", 0.5).otherwise(0.0))
    cohort = F.when(F.col("docs") >= limits.min_docs, "full").when(F.col("peak") >= limits.min_docs, "shrunken").otherwise("chronic")
    # Without a drift to go by, the values' shape has to have left its range too.
    ruled_out = F.when(F.col("d_val").isNull() | F.col("d_text").isNull() | F.col("d_dom").isNull(), F.col("shape") > 0).otherwise(~F.coalesce(F.col("cell") == "content_changed", F.lit(False)))
    sure = F.col("rebound") & ruled_out
    weighted = F.least(F.lit(1.0), sum((w * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0)))
    fetched = F.when(F.col("attempted") > 0, F.col("ok") / F.col("attempted")).otherwise(1.0)
    gate = F.when(fetched < limits.fetch_floor, "inconclusive").when(F.col("collapsed") & (F.col("docs") >= COLLAPSE_DOCS), "collapsed").when(F.col("quiet"), "content_empty").when(F.col("docs") < limits.min_docs, "below_cohort")
    out = out.withColumns({"cohort": cohort, "gate": gate, "sure": sure, "raw": F.when(sure, 1.0).otherwise(weighted)})
    heaviest = _heaviest({"field_loss": WEIGHTS["missrate"] * F.col("missrate"), "silent_rebind": WEIGHTS["distinct"] * F.col("distinct"), "invariant_break": WEIGHTS["invariant"] * F.col("invariant"), "value_domain_drift": WEIGHTS["shape"] * F.col("shape")})
    diagnosis = F.when(F.col("gate") == "collapsed", "field_loss").when(F.col("gate").isNull(), F.when(F.col("cell").isin("markup_drift", "self_inflicted"), F.col("cell")).otherwise(F.coalesce(heaviest, F.col("cell"))))
    out = out.withColumn("diagnosis", diagnosis)
    tripped = F.col("raw") >= limits.degrade
    verdict = F.when(F.col("gate") == "collapsed", "broken").when(F.col("gate").isNotNull(), F.col("gate")).when(~tripped, "ok").when(F.col("diagnosis") == "self_inflicted", "self_inflicted").otherwise("broken")
    reasons = F.when(F.col("gate") == "inconclusive", F.array(F.lit("fetch_ok_rate"))).when(F.col("gate") == "collapsed", F.col("gone")).when(F.col("gate") == "content_empty", F.array(F.lit("container_empty"))).when(F.col("gate") == "below_cohort", F.array(F.concat(F.lit("cohort_docs:"), F.col("cohort"))))
    reasons = reasons.otherwise(F.concat("fired", "violations", F.when(F.col("sure"), F.col("same")).otherwise(none)))
    return out.select(
        "source", "run", verdict.alias("verdict"), "diagnosis", F.round(F.when(F.col("gate") == "collapsed", 1.0).when(F.col("gate").isNotNull(), 0.0).otherwise(F.col("raw")), 4).alias("score"), "cohort", *[F.col(k) for k in WEIGHTS], F.array_sort(reasons).alias("reasons")
    )


def _heaviest(terms: dict[str, Column]) -> Column:
    """The name of the greatest term over 0; of equal ones, the last named."""
    most = F.greatest(*terms.values())
    name = F.lit(None).cast("string")
    for n, t in terms.items():
        name = F.when((most > 0) & (t == most), n).otherwise(name)
    return name


def judged(sketches: DataFrame, runs: DataFrame, invariants: DataFrame | None = None, limits: Limits = Limits(), most_passes: int = 1000) -> DataFrame:
    """``evaluated`` where only runs judged ok serve as baseline, as if runs had been judged one by one in order.

    A run's verdict depends on earlier runs' alone. Starting from all being
    healthy, each pass judges every run of every source by the last pass's
    verdicts; after k passes at least the first k runs of each source are
    final, and a pass that changes nothing is the answer. A few passes over
    sketches do in practice, whatever the number of sources.
    """
    spark, last = sketches.sparkSession, None
    base = runs.drop("healthy")
    now = base.withColumn("healthy", F.lit(True))
    for _ in range(most_passes):
        path = fresh_path(spark, "judged")
        evaluated(sketches, now, invariants, limits).write.parquet(path)
        out = spark.read.parquet(path)
        ok = out.select("source", "run", (F.col("verdict") == "ok").alias("healthy"))
        changed = now.select("source", "run", F.col("healthy").alias("_was")).join(ok, ["source", "run"]).where(F.col("_was") != F.col("healthy")).limit(1).count()
        if last:
            remove(spark, last)
        if not changed:
            return out
        now, last = base.join(ok, ["source", "run"]), path
    raise RuntimeError("the verdicts didn't settle")


# --- drifts and invariants -------------------------------------------------


def drifts(prints: DataFrame, channels: tuple[str, ...] = ("text", "dom", "val")) -> DataFrame:
    """(source, run, d_text, d_dom, d_val): the median share of fingerprint bits in which a run's keys differ from their last appearance.

    ``prints`` (source, run, key and a 64-bit fingerprint a channel). Keys met
    for the first time say nothing. Medians are exact, over the 65 distances
    that a fingerprint can have: a histogram a group, not a list of its keys.
    """
    w = Window.partitionBy("source", "key").orderBy("run")
    both = prints.withColumns({f"_{c}": F.lag(c).over(w) for c in channels})
    out = None
    for c in channels:
        bits = F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))).cast("long")
        hist = both.where(F.col(f"_{c}").isNotNull() & F.col(c).isNotNull()).groupBy("source", "run", bits.alias("bits")).agg(F.count(F.lit(1)).alias("m"))
        g = Window.partitionBy("source", "run")
        upto, total = F.sum("m").over(g.orderBy("bits")), F.sum("m").over(g)
        ranked = hist.withColumns({"upto": upto, "total": total}).withColumn("from", F.col("upto") - F.col("m"))
        at = lambda k: F.max(F.when((F.col("from") < k) & (k <= F.col("upto")), F.col("bits")))
        med = ranked.groupBy("source", "run").agg(((at(F.floor((F.col("total") + 1) / 2)) + at(F.floor((F.col("total") + 2) / 2))) / 128.0).alias(f"d_{c}"))
        out = med if out is None else out.join(med, ["source", "run"], "full_outer")
    return out


def checked(values: DataFrame, mined: DataFrame) -> DataFrame:
    """(source, run, field, kind, support, checked, broke) of mined invariants (source, field, kind, detail, support) over values (source, run, field, value).

    Kinds: nonnull; type (number); range lo..hi; pattern (a regular expression
    that a whole value matches). Nulls are checked by nonnull only. One join
    with the mined rows, which are few, and one aggregation.
    """
    j = values.select("source", "run", "field", F.col("value").alias("v")).join(mined.where(F.col("kind").isin("nonnull", "type", "range", "pattern")), ["source", "field"])
    x, v = F.col("v").try_cast("double"), F.col("v")
    ends = F.split("detail", r"\.\.")
    lo, hi = F.get(ends, F.lit(0)).try_cast("double"), F.get(ends, F.lit(1)).try_cast("double")
    broke = (
        F.when(F.col("kind") == "nonnull", v.isNull() | (F.trim(v) == "")).when(F.col("kind") == "type", x.isNull())
        .when(F.col("kind") == "range", x.isNotNull() & ~x.between(lo, hi)).when(F.col("kind") == "pattern", ~F.expr("v rlike concat('^(?:', detail, ')$')"))
    )
    counted = (F.col("kind") == "nonnull") | v.isNotNull()
    return j.groupBy("source", "run", "field", "kind", "detail", "support").agg(F.count_if(counted).alias("checked"), F.count_if(counted & broke).alias("broke"))
