"""The store's set-shaped plans against a row-by-row fold, and near pairs against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from marlstone.operators import cdc, documents, quality, timeseries


def test_verdicts_fold(spark):
    r = random.Random(4)
    state = {f"k{i}": (r.choice("ab"), r.random() < 0.3, r.randint(1, 4)) for i in range(40)}
    batch = [(f"k{r.randint(0, 60)}", n, r.choice("ab")) for n in range(150)]
    hashes, live, rev, want = {k: v[0] for k, v in state.items()}, {k: not v[1] for k, v in state.items()}, {k: v[2] for k, v in state.items()}, []
    for k, n, h in batch:
        a = "new" if k not in hashes else "changed" if not live[k] or hashes[k] != h else "unchanged"
        hashes[k], live[k], rev[k] = h, True, rev.get(k, 0) + (a != "unchanged")
        want.append((k, n, a, rev[k]))
    s = spark.createDataFrame([(k, h, "2024-01-01" if g else None, v) for k, (h, g, v) in state.items()], "key string, hash string, removed_at string, revision long").withColumn("removed_at", F.col("removed_at").cast("timestamp"))
    got = cdc.verdicts(s, spark.createDataFrame(batch, "key string, seq int, hash string"))
    assert sorted(want) == sorted((x.key, x.seq, x.action, x.revision) for x in got.collect())


def test_removals(spark):
    s = spark.createDataFrame([("a", None), ("b", None), ("c", "2024-01-01")], "key string, removed_at string").withColumn("removed_at", F.col("removed_at").cast("timestamp"))
    p = spark.createDataFrame([("a",)], "key string")
    assert [r.key for r in cdc.removals(s, p, "healthy").collect()] == ["b"]
    assert cdc.removals(s, p, "degraded").count() == 0
    assert cdc.removals(s, p.where("false"), "healthy").count() == 0


def test_applied(spark):
    state = spark.createDataFrame([("a", "h", "d", None, None, 1, None, None), ("b", "h", "d", None, "2024-01-01", 2, None, None)], "key string, hash string, data string, trust string, removed_at string, revision long, last_seen string, updated_at string")
    state = state.withColumns({c: F.col(c).cast("timestamp") for c in ("removed_at", "last_seen", "updated_at")})
    batch = spark.createDataFrame([("a", 1, "h", "d", "provisional"), ("b", 2, "h", "d", None), ("c", 3, "x", "e", None)], "key string, seq int, hash string, data string, trust string")
    got = {r.key: r for r in cdc.applied(state, batch, "2024-05-01").collect()}
    assert got["a"].revision == 1 and got["a"].trust == "provisional" and got["a"].updated_at is None and got["a"].last_seen is not None
    assert got["b"].revision == 3 and got["b"].removed_at is None
    assert got["c"].revision == 1


def test_near_pairs(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(12)]
    rows = [(i, x) for i, x in enumerate(b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(8))] + [(500, 0), (501, 0)]
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in rows], "id long, simhash long")
    for d in (0, 3, 7):
        got = {(p.a, p.b) for p in documents.near_pairs(df, "id", d).collect()}
        rep = {}
        for i, x in rows:
            rep.setdefault(x, i)
        want = {tuple(sorted((rep[x], rep[y]))) for x, y in itertools.combinations(sorted(set(x for _, x in rows if x)), 2) if bin(x ^ y).count("1") <= d}
        want |= {(rep[x], i) for i, x in rows if x and rep[x] != i}
        assert got == want, d


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "v", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("u", 2, "x"), ("u", 5, "y")], "k string, t int, v string")
    got = {r.id: r.as_of_v for r in timeseries.as_of_join(left, right, "k", "t", "t", ["v"]).collect()}
    assert got == {1: "y", 2: None, 3: None}


def test_state_machine():
    state, streak, seen = "healthy", 0, []
    for bad in (1, 1, 1, 1, 1, 0, 0, 0, 0):
        state, streak = quality.next_state(state, bool(bad), True, streak)
        seen.append(state)
    assert seen == ["suspect", "degraded", "degraded", "degraded", "quarantined", "probation", "probation", "probation", "healthy"]
    assert quality.next_state("suspect", True, False, 0) == ("suspect", 0)


def test_freshness_fold(spark):
    r = random.Random(3)
    rows = [(f"k{i % 7}", t, r.random() < 0.4) for i, t in enumerate(r.sample(range(100_000), 200))]
    df = spark.createDataFrame(rows, "k string, s long, c boolean").withColumn("t", F.timestamp_seconds("s"))
    got = {x.k: x for x in timeseries.freshness(df, "k", "t", "c", F.lit("1970-01-02").cast("timestamp"), 60.0).collect()}
    for k in got:
        times, mean = sorted(s for n, s, c in rows if n == k and c), None
        for a, b in zip(times, times[1:]):
            mean = float(b - a) if mean is None else 0.3 * (b - a) + 0.7 * mean
        assert got[k].changes == len(times) and (mean is None) == (got[k].ewma_gap is None) and (mean is None or abs(mean - got[k].ewma_gap) < 1e-6)


def test_replay_states(spark):
    r = random.Random(8)
    rows = [(f"s{r.randint(0, 4)}", t, t, r.random() < 0.4, r.random() < 0.8) for t in range(300)]
    df = spark.createDataFrame(rows, "s string, t long, e long, bad boolean, judged boolean")
    got = {(x.s, x.t): x.state for x in quality.replay_states(df, "s", "t", "e", "bad", "judged").collect()}
    want, held = {}, {}
    for s, t, _, b, j in rows:
        held[s] = quality.next_state(*held.get(s, ("healthy", 0))[:1], b, j, held.get(s, ("healthy", 0))[1])
        want[s, t] = held[s][0]
    assert got == want


def test_group_values_typed_and_json_agree(spark):
    from marlstone.operators import derived
    from marlstone.sources import records

    t = spark.createDataFrame([(1, "a", 5, 1.5), (2, "a", None, 2.0), (3, None, 7, 3.0), (4, "b", 9, None)], "k int, s string, n long, d double")
    r = records.as_records(t, "x", "y", F.col("k"), F.lit("2024-01-01").cast("timestamp"))
    spec = derived.Spec("x", "y", "z", ("$.d:numgte:1",), {}, None, ("$.s",), {"rows": "count", "total": "sum($.n)", "text": "sum($.s)"})
    got = [sorted(map(tuple, derived.group_values(spec, df).collect())) for df in (r, r.drop("value"))]
    assert got[0] == got[1] == [("a", 2, 5.0, 0.0)]
