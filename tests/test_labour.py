"""Labour kernels, the record store and taxonomies against plain versions."""

import random
import statistics
from datetime import date

from pyspark.sql import functions as F
from test_stored import files

from marlstone.operators import labour as L
from marlstone.operators import taxonomy as T
from marlstone.operators.record_store import Store
from marlstone.sources.stored import fresh_path


def test_nowcast(spark):
    """Each cause of a withheld number, each confidence, and cells that give no row."""
    steady, wide = [1.0, 1.02, 0.98, 1.0, 1.01, 0.99], [0.8, 1.0, 1.25]
    cells = {"high": (steady, 100), "stale": (steady, 900), "med": ([1.0, 1.1, 1.2], 100), "low": (wide, 100), "ratio": ([9.0] * 4, 10), "band": ([0.3] * 6, 10), "thin": ([1.0], 10), "old": ([7.0] * 9 + steady, 10), "gap": ([1.0, None, -1.0, 0.0, 1.1], 10), "none": ([None], 10), "anchorless": (steady, None), "few": (steady, 10)}
    history = [(k, n, n, None if r is None else 1000.0 * r, 1000.0) for k, (rs, _) in cells.items() for n, r in enumerate(rs)] + [("high", -1, 0, None, 5.0), ("high", -1, 1, 5.0, None)]
    posted = [(k, float(v)) for k in cells for v in ([900, 1000] if k == "few" else [900, 1000, 1100, 5000])]
    anchors = [(k, date(2024, 6, 1).fromordinal(date(2024, 6, 1).toordinal() - a)) for k, (_, a) in cells.items() if a is not None]
    got = L.nowcast(spark.createDataFrame(posted, "k string, value double"), spark.createDataFrame(history, "k string, at int, tie int, posted double, official double"), spark.createDataFrame(anchors, "k string, anchor date"), ["k"], F.lit("2024-06-01").cast("date"), (100.0, 3000.0))
    by = {r.k: r for r in got.collect()}
    assert set(by) == set(cells) - {"none", "anchorless", "few"}
    assert {k: r.confidence for k, r in by.items()} == {"high": "high", "stale": "med", "med": "med", "low": "low", "ratio": "none", "band": "none", "thin": "none", "old": "high", "gap": "low"}
    assert {k: r.withheld for k, r in by.items() if r.withheld} == {"ratio": "implausible_ratio", "band": "out_of_band", "thin": "thin_evidence"}
    for k, r in by.items():
        rs = [x for x in cells[k][0] if x and x > 0][-6:]
        assert r.observations == len(rs) and r.ratio_used == round(statistics.median(rs), 4) and r.posted_median == 1100  # nearest rank of 4 values
        assert r.nowcast_median == (None if r.withheld else round(1100 / statistics.median(rs)))


def test_newest_passes_on_few_rows(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id").repartition(4)
    got = L.newest(df, ["k"], [F.desc("id")], 4)
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()  # before the shuffle too
    assert sorted(r.id for r in got.collect()) == sorted(sorted(i for i in range(5000) if i % 3 == 0)[-4:] + sorted(i for i in range(5000) if i % 3)[-4:])


def test_chains(spark):
    r = random.Random(4)
    ids = list(range(400))
    r.shuffle(ids)
    cuts = sorted(r.sample(range(1, 400), 30))
    groups = [ids[a:b] for a, b in zip([0, *cuts], [*cuts, 400], strict=True)]
    rows = [(i, r.randint(1, 9), n) for g in groups for i, n in zip(g, [*g[1:], r.choice([None, 9999])], strict=True)]
    rows += [(1001, 1, 1002), (1002, 1, 1001)]  # a cycle
    days = {i: d for i, d, _ in rows}
    got = L.chains(spark.createDataFrame(rows, "id int, days int, next int"))
    assert sorted(map(tuple, got.collect())) == sorted((g[0], g[-1], len(g), sum(days[i] for i in g)) for g in groups)
    assert L.chains(spark.createDataFrame([], "id int, days int, next int")).collect() == []


def test_lifecycle(spark):
    r = random.Random(8)
    rows = [(r.choice("ab"), r.choice(["x", "y", None]), r.randint(1, 30), r.random() < 0.3) for _ in range(300)] + [("c", "x", 5, None)]
    live = [("a", "x", 10), ("a", "ALL", 0), ("b", "ALL", 7)]
    got = {(x.kind, x.region): x for x in L.lifecycle(spark.createDataFrame(rows, "kind string, region string, days int, reposted boolean"), spark.createDataFrame(live, "kind string, region string, live int"), 2).collect()}
    want = {}
    for k, g, d, p in rows:
        for region in {g, "ALL"} - {None}:
            want.setdefault((k, region), []).append((d, bool(p)))
    assert set(got) == {k for k, v in want.items() if len(v) >= 2}
    for k, x in got.items():
        ds, n = sorted(d for d, _ in want[k]), len(want[k])
        at = lambda p, ds=ds, n=n: ds[int((n - 1) * p + 0.5)]
        open_ = {(a, b): c for a, b, c in live}.get(k)
        assert (x.n, x.median_days, x.p75_days, x.reposts) == (n, at(0.5), at(0.75), sum(p for _, p in want[k]))
        assert x.repost_pct == round(x.reposts * 100 / n + 1e-9, 1) and (x.churn_pct is None) == (not open_)


def test_deletion(spark):
    rows = [("app", d, f"k{i}", i) for d in ("one", "two/odd = name", "three") for i in range(60)]
    records = spark.createDataFrame(rows, "app string, dataset string, key string, data int")
    revisions = records.withColumn("revision", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    store = Store(fresh_path(spark, "store"), 6)
    store.write(records, revisions)
    keys = spark.createDataFrame([("app", "one", "k7"), ("app", "one", "k8"), ("app", "two/odd = name", "k7"), ("app", "one", "nope"), ("other", "one", "k1"), (None, "one", "k1")], "app string, dataset string, key string")
    before = files(store.path)
    assert store.delete_records(spark, keys) == 3
    after = files(store.path)
    slots = {("one", r[0]) for r in keys.where("dataset = 'one' and key in ('k7', 'k8')").select(F.pmod(F.xxhash64("key"), F.lit(6)).cast("int")).collect()} | {("two", r[0]) for r in keys.where("key = 'k7'").select(F.pmod(F.xxhash64("key"), F.lit(6)).cast("int")).collect()}
    for line in before - after:  # only partitions of these keys, and those of keys that aren't there
        assert any(f"dataset={d}" in line and f"slot={s}/" in line for d, s in slots) or "dataset=one" in line
    untouched = [line for line in before if "dataset=three" in line]
    assert untouched and set(untouched) <= after
    gone = {("one", "k7"), ("one", "k8"), ("two/odd = name", "k7")}
    left = lambda name: sorted((r.dataset, r.key) for r in store.table(spark, name).collect())
    want = [(d, k) for _, d, k, _ in rows if (d, k) not in gone]
    assert left("records") == sorted(want) and left("revisions") == sorted(want * 3)
    assert store.delete_records(spark, keys) == 0 and left("records") == sorted(want)
    assert store.delete_dataset(spark, "app", "two/odd = name") == 59 and store.delete_dataset(spark, "app", "two/odd = name") == 0
    assert {d for d, _ in left("records")} == {d for d, _ in left("revisions")} == {"one", "three"}
    assert store.delete_records(spark, records.select("app", "dataset", "key")) == 118 and left("revisions") == []
    assert store.delete_records(spark, keys) == 0


ENTRY = "label string, rank int, aliases array<string>, codes array<string>"


def test_classes(spark):
    chain = [(f"n{k}", 50 - k % 7, [f" N{k + 1} "]) for k in range(40)]  # each calls the next one
    rows = [*chain, ("Roofer", 3, ["roof", "Slater"]), ("Slater man", 3, ["slater"]), ("A tie", 5, ["tied"]), ("B tie", 5, ["TIED"]), ("alone", 9, []), ("nul", 9, None), (" ", 1, ["roof"]), ("twice", 8, ["x1"]), ("Twice", 2, ["x2"])]
    entries = spark.createDataFrame([(a, b, c, []) for a, b, c in rows], ENTRY)
    got = {r.name: (r.label, r.rank) for r in T.classes(entries).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for label, _, aliases in rows:
        if label.strip():
            for a in [label, *(aliases or [])]:
                parent[find(a.strip().lower())] = find(label.strip().lower())
    best = {}
    for label, rank, _ in rows:
        if label.strip():
            root = find(label.strip().lower())
            best[root] = min(best.get(root, (99, "")), (rank, label)) if root in best else (rank, label)
    assert got == {n: (best[find(n)][1], best[find(n)][0]) for n in parent}
    assert T.classes(entries.where("false")).collect() == []


def test_merged_and_canonical(spark):
    seeds = spark.createDataFrame([("Roofing", 1, ["roof", "slate"], ["47"]), ("Plumbing", 2, ["plumb", "pipe"], ["48"]), ("Painting", 3, ["paint"], ["49"])], ENTRY)
    records = spark.createDataFrame([("Plumbing", True, ["drain"], [], "reg"), ("Painting", False, [], [], "reg"), ("Zinc work", True, ["zinc", "pipe roof"], ["50"], "reg"), ("Off", False, ["off"], [], "reg"), (" ", True, ["blank"], [], "reg"), ("Zinc work", False, [], [], "later")], "label string, enabled boolean, aliases array<string>, codes array<string>, source string")
    merged = T.merged_entries(seeds, records)
    assert sorted((r.label, tuple(r.aliases), tuple(r.codes), r.source) for r in merged.collect()) == [("Plumbing", ("drain",), ("48",), "reg"), ("Roofing", ("roof", "slate"), ("47",), "seed"), ("Zinc work", ("zinc", "pipe roof"), ("50",), "reg")]
    raws = [" ROOFING ", "old roofs", "drains and roofs", "zinc", "Unknown trade ", "", None, "roofing", "roofing", "a pipe roof"]
    got = T.canonical(spark.createDataFrame([(i, r, 1) for i, r in enumerate(raws)], "i int, raw string, label int"), "raw", T.classes(merged)).orderBy("i").collect()
    assert [(r.canonical, r.matched) for r in got] == [("Roofing", True), ("Roofing", True), ("Roofing", True), ("Zinc work", True), ("Unknown trade", False), ("", False), (None, False), ("Roofing", True), ("Roofing", True), ("Roofing", True)]
