"""Runs judged in Spark against judging them one by one in Python."""

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from marlstone.operators import detector as T

LIMITS = T.Limits(window=5)


def wilson(k, n):
    p, z = k / n, 1.96
    c, m, d = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (c - m) / d, (c + m) / d


def robust(x, base, tol):
    if len(base) < 3:
        return None
    med = statistics.median(base)
    dev = [abs(v - med) for v in base]
    if statistics.median(dev) > 1e-12:
        return 0.6745 * (x - med) / statistics.median(dev)
    if sum(dev) / len(dev) > 1e-12:
        return (x - med) / (1.253314 * sum(dev) / len(dev))
    return 0.0 if abs(x - med) <= tol else max(-25, min(25, (x - med) / tol))


def sketch(rows):
    held = [v for v, s, _ in rows if s == "matched" and v is not None]
    lens, chars = [0] * 16, [0] * 4
    for v in held:
        lens[min(15, int(math.log2(len(v)))) if len(v) > 1 else 0] += 1
        for c in v:
            chars[0 if c in "0123456789" else 1 if c.isalpha() else 2 if c.isspace() else 3] += 1
    share = lambda a: [x / sum(a) if sum(a) else 0.0 for x in a]
    return {
        "n": len(rows), "misses": sum(s in ("empty", "error") for _, s, _ in rows), "quiet": all(s == "container_empty" for _, s, _ in rows), "tried": sum(c is not None for *_, c in rows), "failed": sum(c is False for *_, c in rows),
        "distinct": len(set(held)) / len(held) if held else 0.0, "length_shape": share(lens), "char_class_shape": share(chars),
    }


def judge(docs, ok, fields, base, drift, inv):
    """One run against the sketches of its baseline, a list a field."""
    peak = max([b["n"] for bs in base.values() for b in bs], default=0)
    if docs and ok / docs < 0.7:
        return "inconclusive", None, 0.0, ["fetch_ok_rate"]
    sums = lambda f, k: sum(b[k] for b in base.get(f, []))
    gone = [f for f, s in fields.items() if docs >= 5 and s["n"] >= 5 and s["misses"] / s["n"] >= 0.9 and sums(f, "n") >= 5 and sums(f, "misses") / sums(f, "n") <= 0.1]
    if gone:
        return "broken", "field_loss", 1.0, sorted(f"total_collapse:{f}" for f in gone)
    if any(s["quiet"] for s in fields.values()) and not any(s["misses"] for s in fields.values()):
        return "content_empty", None, 0.0, ["container_empty"]
    if docs < 30:
        return "below_cohort", None, 0.0, [f"cohort_docs:{'shrunken' if peak >= 30 else 'chronic'}"]
    why, miss, dist, shape, rebound = [], 0.0, 0.0, 0.0, []
    for f, s in fields.items():
        bs = base.get(f, [])
        for name, k, n in (("miss_rate", "misses", "n"), ("coercion_failure_rate", "failed", "tried")):
            if s[n] and sums(f, n) and wilson(s[k], s[n])[0] > min(1, wilson(sums(f, k), sums(f, n))[1]):
                r, b = s[k] / s[n], sums(f, k) / sums(f, n)
                miss = max(miss, (r - b) / (1 - b))
                why.append(f"{name}:{f}")
        if len(bs) < 3:
            continue
        usual = statistics.median([b["distinct"] for b in bs])
        if usual >= 0.9 and s["distinct"] <= 0.1:
            rebound.append(f)
        if usual >= 0.5 and robust(s["distinct"], [b["distinct"] for b in bs], 0.02) <= -3.5:
            dist = max(dist, (usual - s["distinct"]) / usual)
            why.append(f"distinct_ratio:{f}")
        for name in ("length_shape", "char_class_shape"):
            centre = [statistics.median(c) for c in zip(*[b[name] for b in bs], strict=True)]
            tv = lambda p, centre=centre: sum(abs(x - y) for x, y in zip(p, centre, strict=True)) / 2
            d = tv(s[name])
            if d >= 0.1 and robust(d, [tv(b[name]) for b in bs], 0.1) >= 3.5:
                shape = max(shape, d)
                why.append(f"{name}:{f}")
    total = sum(i[2] for i in inv)
    bad = [i for i in inv if i[3] and i[4] / i[3] >= 0.2]
    broke = sum(i[2] for i in bad) / total if total else 0.0
    why += [f"invariant:{i[1]}:{i[0]}" for i in bad]
    cell = None
    if drift and drift[2] >= 0.2:
        t, m, _ = drift
        cell = "markup_drift" if t <= 0.08 and m >= 0.2 else "self_inflicted" if t <= 0.08 and m <= 0.08 else "content_changed" if t > 0.08 and m < 0.2 else "ambiguous"
    sure = rebound and (shape > 0 if not drift else cell != "content_changed")
    score = 1.0 if sure else min(1.0, 0.3 * miss + 0.2 * dist + 0.2 * broke + 0.15 * shape + 0.15 * {"markup_drift": 1.0, "self_inflicted": 1.0, "ambiguous": 0.5}.get(cell, 0.0))
    why += [f"distinctness_collapse:{f}" for f in rebound] if sure else []
    terms = [(0.3 * miss, "field_loss"), (0.2 * dist, "silent_rebind"), (0.2 * broke, "invariant_break"), (0.15 * shape, "value_domain_drift")]
    best = max(((w, k, n) for k, (w, n) in enumerate(terms) if w > 0), default=None)
    name = cell if cell in ("markup_drift", "self_inflicted") else best[2] if best else cell
    return ("ok" if score < 0.6 else "self_inflicted" if name == "self_inflicted" else "broken"), name, round(score, 4), sorted(why)


@pytest.fixture(scope="module")
def world():
    """(source, run) -> docs, ok, drift, rows by field, with faults of every kind."""
    r, out = random.Random(12), {}
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    for s in ("a", "b", "c", "d"):
        for run in range(14):
            n = 12 if s == "c" or s == "b" and run == 9 else 40
            fault = {("a", 4): "gone", ("a", 5): "gone", ("a", 7): "rebind", ("a", 9): "misses", ("b", 5): "fetch", ("b", 6): "text", ("b", 11): "quiet", ("d", 5): "both", ("d", 6): "both", ("d", 9): "own", ("d", 11): "same"}.get((s, run))
            price = [(f"{r.randint(1, 999)}", "matched", True) for _ in range(n)]
            title = [(word(r.randint(5, 25)) + f" {k}", "matched", None) for k in range(n)]
            if fault == "gone":
                price = [(None, "error", None)] * n
            if fault == "misses":
                price[: n // 2] = [(None, "empty", None)] * (n // 2)
            if fault == "rebind":
                title = [("Free shipping on all orders over 50 Euro today", "matched", None)] * n
            if fault == "same":
                title = [(word(12), "matched", None)] * n
            if fault == "text":
                price = [("Add to cart", "matched", False)] * n
            if fault == "both":
                price = [(None, "error", None)] * (3 * n // 4) + [("Add to cart", "matched", False)] * (n - 3 * n // 4)
                title = [("Menu", "matched", None)] * n
            if fault == "quiet":
                title = [(None, "container_empty", None)] * n
            drift = {"rebind": (0.02, 0.4, 0.5), "same": (0.5, 0.01, 0.6), "both": (0.3, 0.4, 0.5), "own": (0.0, 0.05, 0.4)}.get(fault, None if s == "b" else (0.1, 0.05, 0.1))
            out[s, run] = n, n // 2 if fault == "fetch" else n, drift, {"price": price, "title": title}
    return out


def frames(spark, world):
    rows = [(s, run, f, *v) for (s, run), (*_, fields) in world.items() for f, vs in fields.items() for v in vs]
    values = spark.createDataFrame(rows, "source string, run int, field string, value string, status string, coerced boolean").repartition(6)
    runs = spark.createDataFrame([(s, run, n, n, ok, True, *(d or (None,) * 3)) for (s, run), (n, ok, d, _) in world.items()], "source string, run int, docs int, attempted int, ok int, healthy boolean, d_text double, d_dom double, d_val double")
    mined = spark.createDataFrame([(s, *m) for s in "abcd" for m in (("price", "type", "number", 600), ("price", "range", "1..999", 500), ("title", "nonnull", "", 900), ("title", "pattern", "[a-z]+ [0-9]+", 700))], "source string, field string, kind string, detail string, support long")
    return values, runs, T.checked(values, mined)


def broken(fields):
    out = []
    for f, kind, support, test in (("price", "type", 600, lambda v: not re.fullmatch("[0-9]+", v)), ("price", "range", 500, lambda v: v.isdigit() and not 1 <= int(v) <= 999), ("title", "pattern", 700, lambda v: not re.fullmatch("[a-z]+ [0-9]+", v))):
        vs = [v for v, *_ in fields[f] if v is not None]
        out.append((f, kind, support, len(vs), sum(map(test, vs))))
    return [*out, ("title", "nonnull", 900, len(fields["title"]), sum(not (v or "").strip() for v, *_ in fields["title"]))]


@pytest.mark.parametrize("only_ok", [True, False])
def test_runs_in_order(spark, world, only_ok):
    values, runs, inv = frames(spark, world)
    run = T.judged if only_ok else T.evaluated
    got = {(r.source, r.run): r for r in run(T.sketched(values), runs, inv, LIMITS).collect()}
    seen, kinds = {}, set()
    for (s, n), (docs, ok, drift, fields) in sorted(world.items()):
        past = seen.setdefault(s, [])
        now = {f: sketch(vs) for f, vs in fields.items()}
        base = {f: [p[f] for p in past[-LIMITS.window :]] for f in now}
        want = judge(docs, ok, now, base, drift, broken(fields))
        g = got[s, n]
        assert (g.verdict, g.diagnosis, g.score, list(g.reasons)) == (want[0], want[1], pytest.approx(want[2], abs=2e-4), want[3]), (s, n)
        kinds.add(want[0])
        if want[0] == "ok" or not only_ok:
            past.append(now)
    assert len(got) == len(world) and kinds >= {"ok", "broken", "inconclusive", "content_empty", "below_cohort"}


def test_parts_merge_to_the_whole(spark, world):
    values = frames(spark, world)[0]
    whole = T.sketched(values)
    parts = T.sketched(values.withColumn("part", F.pmod(F.xxhash64("value", F.rand(3)), F.lit(5))), ("source", "run", "field", "part"))
    plain = lambda df: sorted(map(str, df.withColumn("seen", F.hll_sketch_estimate("seen")).select("source", "run", "field", *T.COUNTS, "lengths", "chars", "seen").collect()))
    assert plain(T.merged(parts)) == plain(whole) == plain(T.merged(whole))


def test_drifts(spark):
    r = random.Random(2)
    rows = [(s, run, k, *(r.getrandbits(63) if r.random() < 0.9 else None for _ in range(3))) for s in "ab" for run in range(4) for k in range(25) if r.random() < 0.7]
    got = {(x.source, x.run): x for x in T.drifts(spark.createDataFrame(rows, "source string, run int, key int, text long, dom long, val long")).collect()}
    last, found = {}, {}
    for s, run, k, *prints in sorted(rows, key=lambda x: x[:3]):
        for c, (a, b) in enumerate(zip(prints, last.get((s, k), [None] * 3), strict=True)):
            if a is not None and b is not None:
                found.setdefault((s, run, c), []).append((a ^ b).bit_count() / 64)
        last[s, k] = prints
    for (s, run, c), ds in found.items():
        assert got[s, run][2 + c] == pytest.approx(statistics.median(ds))


def test_empty_inputs(spark, world):
    values, runs, inv = frames(spark, world)
    assert T.evaluated(T.sketched(values.where("false")), runs.where("false"), inv.where("false")).collect() == []
    alone = T.evaluated(T.sketched(values.where("false")), runs, None).collect()  # runs without a value
    assert len(alone) == len(world) and {x.verdict for x in alone} <= {"ok", "inconclusive", "below_cohort"}
