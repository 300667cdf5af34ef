"""Keyed streams against folds: several batches, a restart, and the batch form of the same."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import tiers
from marlstone.sources.stored import fresh_path
from marlstone.streaming import keyed


def fold_kept(rows, d):
    kept, out = {}, {}
    for scope, seq, fp in rows:
        u = None if fp is None else fp & (1 << 64) - 1
        if not u:
            out[scope, seq] = True
            continue
        out[scope, seq] = not any((u ^ k).bit_count() <= d for k in kept.setdefault(scope, []))
        if out[scope, seq]:
            kept[scope].append(u)
    return out


def signed(u):
    return u - (1 << 64) if u >> 63 else u


@pytest.mark.parametrize("d", [0, 3, 8])
def test_bands(d):
    cut = keyed.bands(d)
    assert len(cut) == d + 1 and sum(m.bit_length() for _, m in cut) == 64
    assert sum(m << s for s, m in cut) == (1 << 64) - 1


@pytest.mark.parametrize("d", [0, 3])
def test_near_of_kept(spark, d, monkeypatch):
    r = random.Random(d)
    base = [r.getrandbits(64) for _ in range(25)]
    rows = []
    for seq in range(600):
        u = r.choice(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            u ^= 1 << r.randrange(64)
        rows.append((r.choice("abb"), seq, r.choice([signed(u)] * 20 + [None, 0])))
    rows += [("c", 600 + k, signed(k | 7 << 40)) for k in range(300)]  # one band value holds them all
    source, out, check = (fresh_path(spark, n) for n in ("in", "out", "check"))
    kind = "scope string, seq long, fingerprint long"

    def add(part):
        spark.createDataFrame(part, kind).repartition(3).coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        return keyed.collected(keyed.near_of_kept(stream, d), out, check)

    add(rows[:250])
    go()
    add(rows[250:600])  # a restart: the state comes from the checkpoint
    go()
    add(rows[600:])
    got = go()().collect()
    assert {(x.scope, x.seq): x.kept for x in got} == fold_kept(rows, d) and len(got) == len(rows)
    assert len({x.batch for x in got}) == 3
    by = {(x.scope, x.seq): x for x in got}
    for x in got:
        if not x.kept:
            assert ((x.near ^ x.fingerprint) & (1 << 64) - 1).bit_count() <= d and any(y.kept and y.fingerprint == x.near for y in by.values())


def fold_tiers(rows, ttl):
    state = {}
    for host, at, _, winner, lost in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda x: (x[1], x[2])):
        if winner != "http" and not lost:
            continue
        strikes, updated, n = state.get(host.lower(), (0, None, 0))
        stale = ttl > 0 and updated is not None and updated < at - ttl
        state[host.lower()] = (0 if winner == "http" else 1 if stale else strikes + 1, at, n + 1)
    return {h: (s, "browser" if s >= 3 else None, u, n) for h, (s, u, n) in state.items()}


@pytest.fixture(scope="module")
def fetches():
    r = random.Random(9)
    rows, at = [], 0.0
    for k in range(900):
        at += r.choice([0.0, 1.0, 5.0, 40.0])
        rows.append((r.choice(["a.com", "A.com", "b.org", "b.org", "b.org", f"h{r.randint(0, 30)}.net"]), at, k, r.choice(["http", "browser", "browser", "claude", None]), r.choice([True, True, True, False, None])))
    return rows + [(None, 5.0, 0, "http", False), ("z.com", None, 0, "browser", True)]


KIND = "host string, at double, tie long, winner string, http_lost boolean"


@pytest.mark.parametrize("ttl", [0.0, 60.0, 300.0])
def test_tier_memory_is_a_fold(spark, fetches, ttl):
    df = spark.createDataFrame(fetches, KIND).repartition(5)
    want = fold_tiers(fetches, ttl)
    for span in (7.0, 100.0, 10_000_000.0):
        got = {x.host: (x.strikes, x.preferred, x.updated_at, x.observations) for x in tiers.memory(df, ttl, span).collect()}
        assert got == want, span
    assert tiers.memory(df.where("false"), ttl).collect() == []


def test_parts_combine_in_any_grouping(spark, fetches):
    log = tiers.writes(spark.createDataFrame(fetches, KIND))
    fine = tiers.parts(log, 60.0, 11.0)
    coarse = tiers._since_reset(fine.withColumn("wide", F.floor(F.col("stretch") / 13)), ["host", "wide"], ["stretch"], 60.0)
    both = [tiers._since_reset(p, ["host"], [o], 60.0) for p, o in ((fine, "stretch"), (coarse, "wide"))]
    assert sorted(map(tuple, both[0].collect())) == sorted(map(tuple, both[1].collect())) == sorted(map(tuple, tiers.parts(log, 60.0).collect()))


def test_tier_stream(spark, fetches):
    """Several batches and a restart give the batch form's state; a pin ends by timer."""
    ttl, rows = 60.0, [f for f in fetches if f[0] and f[1] is not None]
    source, out, check = (fresh_path(spark, n) for n in ("in", "out", "check"))

    def go(part):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source)
        return keyed.collected(keyed.tier_stream(tiers.writes(stream), ttl, "10 seconds"), out, check, "update")

    go(rows[:300])
    go(rows[300:301])
    read = go(rows[301:])
    got = {}
    for x in sorted(read().where("not expired").collect(), key=lambda x: x.batch):
        got[x.host] = (x.strikes, x.preferred, x.updated_at, x.observations)
    assert got == fold_tiers(fetches[:-2], ttl)
    end = max(f[1] for f in rows) + 10_000
    read = go([("late.com", end, 0, "http", False)])
    go([("later.com", end + 1, 0, "http", False)])
    ended = {x.host for x in read().where(f"expired and updated_at > {rows[300][1]}").collect()}
    assert {h for h, (_, p, *_) in got.items() if p} <= ended
    now = F.lit(10.0)
    pins = spark.createDataFrame([("browser", 9.0), ("browser", 1.0), (None, 9.0)], "p string, u double").select(tiers.preferred_now(F.col("p"), F.col("u"), now, 5.0).alias("x"), tiers.preferred_now(F.col("p"), F.col("u"), now, 0).alias("y")).collect()
    assert [(r.x, r.y) for r in pins] == [("browser", "browser"), (None, "browser"), (None, None)]
