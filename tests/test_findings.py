"""Cases that reviews found."""

import compare
from marlstone import registry


def test_sketch_profiles_to_the_last_digit(spark):
    """Arrays are compared as they are: shares are added up in the order of the rows, as SQL does."""
    d = "/root/testdata/sf0.01"
    got = {r.lang: r.classes for r in registry.QUERIES["field_sketch_profiles"](spark, d).collect()}
    names, rows = compare.oracle(registry.ORACLE_SQL["field_sketch_profiles"], d)
    assert got == {r[names.index("lang")]: r[names.index("classes")] for r in rows}


def test_index_in_parts(spark, monkeypatch):
    """Blocks are made part by part, without a shuffle of single postings, and changes of few and of many keys rank as the whole corpus does."""
    from marlstone.operators import search
    from marlstone.operators import search_index as X
    from marlstone.operators.search import Request
    from marlstone.sources.stored import fresh_path

    monkeypatch.setattr(X, "PART", 300)
    docs = spark.createDataFrame([(k, " ".join(f"w{k * j % 13} of the" for j in range(k % 9))) for k in range(300)], "doc_id long, text string")
    index = X.Index(fresh_path(spark, "index"), "doc_id", "text", (), slots=2, buckets=3, block=4)
    plan = X._contents(docs, index, 5)[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Window" not in plan
    X.build(docs, index)
    assert int(index.layout(spark)["parts"]) > 5 and index.table(spark, "postings").select("slot", "part").distinct().count() > 10
    new = spark.createDataFrame([(7, "w3 the the of"), (900, "of the w3")], "doc_id int, text string")
    for most in (X.MOST_KEYS, 1):
        monkeypatch.setattr(X, "MOST_KEYS", most)
        X.upsert(spark, index, new)
        X.delete_keys(spark, index, spark.createDataFrame([(most % 5 + k,) for k in range(20, 26)], "doc_id int"))
        docs = docs.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new).where(f"doc_id not between {most % 5 + 20} and {most % 5 + 25}")
        for q in (Request(("w3", "the"), limit=400), Request(("w3",), limit=3), Request(("the",), phrase=("of", "the", "w3"), limit=400)):
            want = [(r.doc_id, round(r.score, 8)) for r in search.top(search.scored(docs, q, "doc_id", "text"), q, "doc_id").collect()]
            assert [(r.doc_id, round(r.score, 8)) for r in X.search(spark, index, q).collect()] == want


def test_exact_different_values(spark):
    """Judgements go by exact numbers of different values where they are asked for: a sketch of 40,000 is some hundreds off."""
    from pyspark.sql import functions as F

    from marlstone.operators import detector as T

    values = spark.range(60_000).select(F.lit("s").alias("source"), F.lit(1).alias("run"), F.lit("f").alias("field"), F.pmod("id", F.lit(40_000)).cast("string").alias("value"), F.lit("matched").alias("status"), F.lit(None).cast("boolean").alias("coerced"))
    assert T._described(T.sketched(values, exact=True)).first()["distinct"] == 40_000 / 60_000


def test_near_kept_touches_state_once_a_batch():
    """Rows of one batch that share bands read and write a state entry once, not once a row; later batches go on from it."""
    import random

    import pandas as pd

    from marlstone.streaming import keyed

    class State(dict):
        calls = 0

        def exists(self):
            return bool(self)

        def getValue(self, k):
            self.calls += 1
            return self.get(k)

        def updateValue(self, k, v):
            self.calls += 1
            self[k] = v

    r, kept = random.Random(3), []
    state, near = State(), keyed.NearKept(3)
    near.kept = state
    for batch in range(3):
        prints = [r.getrandbits(12) << 52 | 0xABC_DEF0_1234_0 | r.getrandbits(4) for _ in range(3000)]
        rows = pd.DataFrame({"seq": range(3000), "print": [keyed.signed(x) for x in prints], "none": False})
        state.calls = 0
        out = next(near.handleInputRows(("s",), iter([rows]), None))
        assert state.calls < 3000
        for x, was in zip(prints, out["kept"], strict=True):
            want = all((x ^ y).bit_count() > 3 for y in kept)
            assert was == want
            kept += [x] if want else []


def test_near_links(spark):
    """A row a document: its class and its links, as all pairs give them, within and across parts."""
    import random

    from marlstone.functions.fingerprints import signed
    from marlstone.operators import documents

    r = random.Random(4)
    bases = [r.getrandbits(64) for _ in range(12)]
    fps = {k: 0 if k < 3 else r.choice(bases) ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 4, 7]))) for k in range(260)}
    near = {k: [j for j in fps if fps[k] and fps[j] and (fps[k] ^ fps[j]).bit_count() <= 8] for k in fps if fps[k]}
    low = {k: k for k in near}
    for _ in range(260):
        low = {k: min(low[j] for j in near[k]) for k in near}
    df = spark.createDataFrame([(k, signed(x)) for k, x in fps.items()], "id long, simhash long").repartition(4)
    for part in (1 << 14, 50):
        got = {x.id: (x.class_id, x.links) for x in documents.near_links(df, "id", 8, part).collect()}
        assert got == {k: (low[k], len(near[k]) - 1) for k in near}


def test_pairs_are_checked_once(spark, monkeypatch):
    """MinHash is made for documents in pairs only, and fingerprints for each document once."""
    from marlstone.operators import documents
    from marlstone.plans import documents_q

    seen, count = [], documents.minhashes
    monkeypatch.setattr(documents, "minhashes", lambda df, *a: seen.append(df.count()) or count(df, *a))
    d = "/root/testdata/sf0.001"
    out = documents_q.minhash_near_pairs_checked(spark, d).collect()
    assert seen == [len({x for r in out for x in (r.a, r.b)})] and seen[0] < 200
    assert "MapInArrow" not in documents_q.neardup_pairs_d3(spark, d)._jdf.queryExecution().toString()


def test_near_copies_by_simhash(spark, monkeypatch):
    """The pipeline's near copies go through SimHash and its trees; the sets' exact check and prefixes follow."""
    from marlstone.llm import simhash

    calls, links = [], simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda *a, **k: calls.append(1) or links(*a, **k))
    base = " ".join(f"word{k}" for k in range(400))
    docs = spark.createDataFrame([(1, base), (2, base + " end"), (3, "other words than these are in this text"), (4, base), (5, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == [1, 3, 5] and calls == [1]


def test_sketch_profiles_of_many_files(spark, tmp_path):
    """Shares are added up in the order of the files and their rows, as SQL does on one thread, however the files are dealt to tasks."""
    import duckdb

    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(9, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(f"select lang, classes from ({registry.ORACLE_SQL['field_sketch_profiles']})").fetchall())
    assert {r.lang: r.classes for r in registry.QUERIES["field_sketch_profiles"](spark, str(tmp_path)).collect()} == want


def test_sketch_of_odd_groups(spark):
    """Groups without a name, without values or with blanks only keep their rows."""
    from marlstone.operators import quality

    rows = [(1, None, "a1"), (2, None, "b "), (3, "x", None), (4, "x", " "), (5, "y", "12"), (6, "y", None)]
    df = spark.createDataFrame(rows, "k long, g string, v string").repartition(3)
    got = {r.g: (r.n, r.misses, r.classes, r.distinct_ratio) for r in quality.field_sketch(df, ["g"], "v", ["k"]).collect()}
    assert got == {None: (2, 0, [0.25, 0.5, 0.25, 0.0], 1.0), "x": (2, 2, [None] * 4, None), "y": (2, 1, [1.0, 0.0, 0.0, 0.0], 1.0)}


def test_simhash_of_many_texts():
    """Texts fingerprinted together get what each gets by itself."""
    import random

    from marlstone.functions import fingerprints

    r, letters = random.Random(5), "".join(map(chr, [*range(9, 300), 0x212A, 0x3A3, 0x3C2, 0x201C, 0x65E5, 0x130, 0x1E9E])) + " " * 60
    texts = [None, "", "a", "é", "_", "ab " * 90_000, "x" * 200 + " cd", *("".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(900))]
    assert fingerprints.simhashes(texts).tolist() == [fingerprints.signed(fingerprints.simhash(t)) for t in texts]


def test_near_counts_leave_far_cells_out(monkeypatch):
    """Counts of near rows, copies too, are those of all pairs, though cells that the bounds rule out aren't compared."""
    import numpy as np

    from marlstone.operators import documents

    monkeypatch.setattr(documents, "CELL", 32)  # few rows here
    r = np.random.default_rng(8)
    centres = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (9000, 4), dtype=np.uint64), axis=1)
    fps = np.unique(centres[r.integers(0, 12, 9000)] ^ flips)
    fps, m = fps[r.permutation(len(fps))], r.choice([1, 1, 1, 5, 300], len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 8
    sides = np.arange(3000), np.arange(3000, len(fps))
    for left, right in ((sides[0], sides[0]), sides):
        trees, compared = documents._Trees(np.arange(len(fps))), []
        documents.np = _Counting(np, compared)
        try:
            got = documents._near_counts(fps, m, left, right, 8, trees)
        finally:
            documents.np = np
        trees.join()
        seen = np.zeros_like(near)
        seen[np.ix_(left, right)] = seen[np.ix_(right, left)] = True
        assert (got == (near & seen) @ m).all()
        low = np.arange(len(fps))
        for _ in range(12):
            low = np.where(near & seen, low[None], len(fps)).min(axis=1).clip(max=low)
        assert (trees.up == low).all()
        assert sum(compared) < len(left) * len(right) / 3


class _Counting:
    """numpy, with the sizes of what is compared noted."""

    def __init__(self, numpy, compared):
        self.numpy, self.compared = numpy, compared

    def __getattr__(self, name):
        return getattr(self.numpy, name)

    def less_equal(self, x, *a, **k):
        self.compared.append(x.size)
        return self.numpy.less_equal(x, *a, **k)


def test_pictures_are_drawn_once(spark):
    """Originals and edited copies come from one pass over the vectors, and pictures of one size are described together as they are alone."""
    import numpy as np
    from marlstone.llm import media

    r = np.random.default_rng(2)
    vectors = r.normal(size=(6, 64))
    df = spark.createDataFrame([(100 * k, v.tolist()) for k, v in enumerate(vectors)] + [(None, vectors[0].tolist()), (601, None)], "vec_id long, embedding array<double>")
    copies = media.edited_copies(media.rendered_vectors(df))
    assert copies._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    got = sorted(((x.image_id is None, x.image_id) for x in copies.collect()), key=str)
    assert got == sorted([(False, 800 * k + n) for k in range(6) for n in range(8)] + [(True, None), (False, 4808)], key=str)
    images = np.stack([media.picture_of(v).astype(np.float32) for v in vectors] + [np.zeros((96, 96), np.float32)])
    for one, (points, codes) in zip(map(media.describe, images), media.described(images), strict=True):
        assert np.array_equal(one[0], points) and np.array_equal(one[1], codes)
    assert len(media.describe(images[0])[0]) and not len(media.describe(images[-1])[0])


def test_close_pairs_in_long_runs():
    """Many rows that agree in subtables are compared in blocks; every pair still comes once."""
    import numpy as np
    from marlstone.llm import media

    r = np.random.default_rng(6)
    d = np.repeat(r.integers(0, 1 << 63, (3, 2), dtype=np.uint64), [700, 90, 30], axis=0)
    d[np.arange(len(d)), r.integers(0, 2, len(d))] ^= np.uint64(1) << r.integers(0, 40, len(d), dtype=np.uint64)
    c = r.integers(0, 200, len(d))
    key = lambda t: (d[:, t // 4] >> np.uint64(16 * (3 - t % 4))) & np.uint64(65535)
    got = [tuple(sorted(p)) for t in range(media.TABLES) for i, j in media.close_pairs(t, np.unique(key(t), return_inverse=True)[1], c, d[:, 0], d[:, 1], np.full(len(d), -1)) for p in zip(i.tolist(), j.tolist(), strict=True)]
    near = (np.bitwise_count(d[:, None] ^ d[None]).sum(axis=2) <= media.NEAR) & (c[:, None] != c[None])
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
