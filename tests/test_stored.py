"""Stored tables: only touched partitions change, repeats change nothing, and the stored index ranks as the whole corpus does."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from marlstone.operators import search
from marlstone.operators import search_index as X
from marlstone.operators.search import Request
from marlstone.sources.stored import fresh_path, replace_partitions


def files(path, inside=""):
    """Files with their content's digest."""
    out = subprocess.run(["find", path.replace("file://", ""), "-name", "*.parquet", "-path", f"*{inside}*", "-exec", "md5sum", "{}", "+"], capture_output=True, text=True).stdout
    return set(out.splitlines())


def test_replace_partitions(spark):
    path = fresh_path(spark, "parts")
    spark.range(40).select("id", (F.col("id") % 4).cast("int").alias("p")).write.partitionBy("p").parquet(path)
    before = {p: files(path, f"p={p}/") for p in range(4)}
    now = lambda: spark.read.schema("id long, p int").parquet(path)
    replace_partitions(now().where("p in (1, 2) and p = 1 and id > 10"), path, ["p"], [(1,), (2,)])
    assert sorted(r.id for r in now().collect()) == sorted(i for i in range(40) if i % 4 in (0, 3) or i % 4 == 1 and i > 10)
    assert files(path, "p=0/") == before[0] and files(path, "p=3/") == before[3] and not files(path, "p=2/")
    with pytest.raises(ValueError):
        replace_partitions(now().where("p = 3"), path, ["p"], [(1,)])
    assert now().count() == 27
    replace_partitions(now().where("false"), path, ["p"], [(k,) for k in range(4)])
    assert now().count() == 0


WORDS = ["the", "und", "a", "license", "licence", "licensed", "of", "zebra", "word"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(WORDS, weights=[30, 12, 9, 2, 1, 2, 8, 1, 5], k=r.randint(0, 60))), r.choice(["de", "en", None]), r.randint(0, 9)) for i in range(400)]
    rows += [(900, None, "de", 1), (901, "", "en", 2), (902, "The, the; THE! und", "en", 3), (903, "zebra " * 400, None, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, day int").repartition(5).cache()


REQUESTS = [
    Request(("the", "und"), limit=7), Request(("zebra", "the", "of"), limit=3, offset=2), Request(("the", "the", "license"), limit=500), Request(("absent",)), Request(("absent", "zebra"), limit=4), Request(("the", "a"), equal={"lang": "de"}, limit=5),
    Request(("the", "of"), at_least={"day": 8}, limit=5), Request(("license",), fuzzy=True, limit=9), Request(("absentt",), fuzzy=True), Request(("the",), phrase=("of", "the"), limit=8), Request(("the",), phrase=("the", "the", "the")), Request(("und",), newest=True, limit=6), Request(("the", "und"), equal={"lang": "xx"}),
]


def same_ranking(spark, index, docs, requests=REQUESTS):
    for q in requests:
        by = "day" if q.newest else None
        want = [(r.doc_id, round(r.score, 8), r.lang, r.day) for r in search.top(search.scored(docs, q, "doc_id", "text"), q, "doc_id", by).collect()]
        assert [(r.doc_id, round(r.score, 8), r.lang, r.day) for r in X.search(spark, index, q, by).collect()] == want, q


def test_index(spark, corpus):
    index = X.build(corpus, X.Index(fresh_path(spark, "index"), "doc_id", "text", ("lang", "day"), slots=5, buckets=4, block=4))
    same_ranking(spark, index, corpus)
    every = X.hits(spark, index, REQUESTS[0])
    assert every.count() == search.scored(corpus, REQUESTS[0], "doc_id", "text").count()


def test_pruning(spark, corpus):
    index = X.build(corpus, X.Index(fresh_path(spark, "index"), "doc_id", "text", ("lang", "day"), slots=5, buckets=4, block=4))
    for terms, share in ((("zebra",), 0.6), (("the",), 0.95), (("zebra", "the"), 0.95)):
        q = Request(terms, limit=3)
        read, every = X.reading(spark, index, q, 3), X.reading(spark, index, q, None)
        assert read.bar > 0 and read.blocks.count() < share * every.blocks.count()
    plan = X.blocks_of(spark, index, ["zebra"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "entries" not in X.blocks_of(spark, index, ["zebra"]).groupBy("term").agg(F.sum("docs"))._jdf.queryExecution().toString().split("ReadSchema")[1]


def test_index_changes(spark, corpus):
    index = X.build(corpus, X.Index(fresh_path(spark, "index"), "doc_id", "text", ("lang", "day"), slots=6, buckets=3, block=4))
    of = lambda slot: files(index.path, f"slot={slot}/")
    new = spark.createDataFrame([(3, "zebra zebra the", "de", 9), (7777, "und of the the", "en", 9)], "doc_id long, text string, lang string, day int")
    touched = {r[0] for r in new.select(X.slot_of(F.col("doc_id"), 6)).collect()}
    before = {s: of(s) for s in range(6)}
    X.upsert(spark, index, new)
    assert all((of(s) == before[s]) != (s in touched) for s in range(6))
    now = corpus.where("doc_id not in (3, 7777)").unionByName(new)
    same_ranking(spark, index, now, REQUESTS[:10:3])
    for _ in range(2):  # a repeat is no change
        X.upsert(spark, index, new)
        X.delete_where(spark, index, {"lang": "de", "day": 1})
        X.delete_keys(spark, index, spark.createDataFrame([(10,), (902,), (123456,), (None,)], "doc_id long"))
    now = now.where("not (lang <=> 'de' and day = 1) and doc_id not in (10, 902)")
    same_ranking(spark, index, now, REQUESTS[:10:3])
    s = X.stats(spark, index).first()
    assert (s.docs, s.words) == tuple(now.agg(F.count(F.lit(1)), F.sum(F.size(search.words(F.coalesce("text", F.lit("")))))).first()) and s.bytes > 0
    X.delete_keys(spark, index, corpus.select("doc_id").unionByName(new.select("doc_id")))
    assert X.stats(spark, index).first()[:4] == (0, 0, 0, 0) and X.search(spark, index, REQUESTS[0]).count() == 0
    assert X.degraded(0, 5) and X.degraded(5, 5) is None and X.degraded(0, 0) is None
    X.upsert(spark, index, new)
    same_ranking(spark, index, new, REQUESTS[:2])
