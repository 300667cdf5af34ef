"""A stored search index: postings in blocks with bounds, in partitions by document slot and term bucket; top-k reads only blocks that can matter.

Under the index's path lie three tables. ``documents`` (a row a document: key,
word count, stored columns) and ``postings`` (a row a block: term, its
documents, and their greatest tf and least length) are partitioned by ``slot``,
a hash of the key; postings also by ``bucket``, a hash of the term. ``sizes``
has a row a slot. A query reads the buckets of its terms; a change rewrites the
slots of its keys.

Within a slot, keys fall into parts by another hash; their number is set at the
build, so that a part has about ``PART`` characters of text. Blocks are made
part by part in numpy: a build shuffles the texts once, and no task ever holds
more than a part or sorts single postings. A change of up to ``MOST_KEYS`` keys
shuffles new texts only and puts their blocks beside the old ones; a larger one
also shuffles the blocks of its slots, which joins a term's blocks again.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marlstone.operators.search import B, K1, Request, near, top, words
from marlstone.sources.shipping import ship
from marlstone.sources.stored import bytes_of, replace_partitions, slot_of, within

#: Scores are compared after rounding to 9 digits; bounds get this much slack.
SLACK = 1e-8
#: Characters of text of one part, about.
PART = 1 << 22
#: Keys of a change up to which they are broadcast; each task then thins the blocks it reads. With more, keys and blocks meet part by part.
MOST_KEYS = 1 << 20


@dataclass(frozen=True)
class Index:
    """An index at ``path``: its layout, and the names of the key, text and stored columns."""

    path: str
    key: str
    text: str
    keep: tuple[str, ...]
    slots: int = 16
    buckets: int = 32
    block: int = 128

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema(StructType.fromJson(json.loads(self.layout(spark)[name]))).parquet(f"{self.path}/{name}")

    def layout(self, spark: SparkSession) -> dict[str, str]:
        """The tables' schemas as JSON texts, and the number of parts of a slot."""
        if self.path not in _layouts:
            _layouts[self.path] = {r.table: r.schema for r in spark.read.parquet(f"{self.path}/layout").collect()}
        return _layouts[self.path]


#: Layouts of open indexes: one emptied of documents has no file to tell its schemas.
_layouts: dict[str, dict[str, str]] = {}


def build(docs: DataFrame, index: Index) -> Index:
    """Write the index of ``docs``. Keys are unique; null text counts as empty, and rows of a null key are left out."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(index.text))).first()[0] or 0
    parts = max(1, math.ceil(chars / index.slots / PART))
    stored, blocks = _contents(docs, index, parts)
    sizes = _sizes(stored)
    layout = [(n, t.schema.json()) for n, t in (("documents", stored), ("postings", blocks), ("sizes", sizes))] + [("parts", str(parts))]
    spark.createDataFrame(layout, "table string, schema string").coalesce(1).write.parquet(f"{index.path}/layout")
    stored.write.partitionBy("slot").parquet(f"{index.path}/documents")
    blocks.write.partitionBy("slot", "bucket").parquet(f"{index.path}/postings")
    _sizes(index.table(spark, "documents")).write.partitionBy("slot").parquet(f"{index.path}/sizes")
    return index


def _sizes(stored: DataFrame) -> DataFrame:
    return stored.groupBy("slot").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words"))


def part_of(key: Column, parts: int) -> Column:
    """The part of a key in its slot."""
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts)).cast("int")


def _contents(docs: DataFrame, index: Index, parts: int) -> tuple[DataFrame, DataFrame]:
    ship(docs.sparkSession)
    key, text = F.col(index.key), F.coalesce(F.col(index.text), F.lit(""))
    rows = docs.where(key.isNotNull()).select(key.alias("key"), *index.keep, text.alias("_text"), slot_of(key, index.slots).alias("slot"), part_of(key, parts).alias("part"))
    stored = rows.select("key", *index.keep, "slot", F.size(words(F.col("_text"))).alias("n"))
    dealt = rows.select("slot", "part", "key", "_text").repartition("slot", "part").sortWithinPartitions("slot", "part")  # texts are sorted, not their words
    kind = rows.schema["key"].dataType.simpleString()
    schema = _block_schema(kind)
    arrow, block = to_arrow_schema(StructType.fromDDL(schema)), index.block

    def run(x: pa.Table) -> pa.Table:
        w = x["w"].combine_chunks()
        n = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = w.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        both = coded.indices.to_numpy().astype(np.int64) * max(1, len(n)) + row
        order = np.argsort(both, kind="stable")  # by term and document; places stay in order
        both = both[order]
        lo = np.flatnonzero(np.diff(both, prepend=-1))
        tf = np.diff(np.append(lo, len(both)))
        code, row = np.divmod(both[lo], max(1, len(n)))
        return _blocks(x, arrow, block, coded.dictionary, code, x["key"].combine_chunks().take(pa.array(row)), tf, n[row], at[order], lo)

    blocks = dealt.select("slot", "part", "key", words(F.col("_text")).alias("w")).groupBy("slot", "part").applyInArrow(run, schema)
    return stored, _in_buckets(blocks, index)


def _block_schema(kind: str) -> str:
    return f"slot int, part int, term string, docs int, most int, least int, entries struct<key:array<{kind}>,tf:array<int>,n:array<int>,at:array<int>>"


def _in_buckets(blocks: DataFrame, index: Index) -> DataFrame:
    return blocks.withColumn("bucket", slot_of(F.col("term"), index.buckets))


def _blocks(x: pa.Table, schema: pa.Schema, block: int, terms: pa.Array, code: np.ndarray, key: pa.Array, tf: np.ndarray, n: np.ndarray, at: np.ndarray, lo: np.ndarray, by_row: bool = False) -> pa.Table:
    """The blocks of one part, of the same slot and part as ``x`` (``by_row``: as the row of x that the code tells): a term's entries (key, tf, n, and its ``tf`` places in ``at`` from ``lo``) that weigh most together.

    ``entries`` holds lists, an item a document, but for ``at``: the places of all documents in turn.
    """
    if not len(code):
        return schema.empty_table()
    order = np.lexsort((-(tf / (tf + n / 100)), code))
    code, tf, n, lo = code[order], tf[order], n[order], lo[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    rank = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    cuts = np.flatnonzero(rank % block == 0)
    upto = np.cumsum(tf)
    places = at[np.repeat(lo - (upto - tf), tf) + np.arange(int(upto[-1]))]
    ends = pa.array(np.append(cuts, len(code)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, v) for v in (key.take(pa.array(order)), pa.array(tf, pa.int32()), pa.array(n, pa.int32()))]
    lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, upto)[np.append(cuts, len(code))], pa.int32()), pa.array(places, pa.int32())))
    m = len(cuts)
    same = [x[c].take(pa.array(code[cuts])) if by_row else pa.array(np.full(m, x[c][0].as_py()), pa.int32()) for c in ("slot", "part")]
    counts = [pa.array(v, pa.int32()) for v in (np.diff(np.append(cuts, len(code))), np.maximum.reduceat(tf, cuts), np.minimum.reduceat(n, cuts))]
    entries = pa.StructArray.from_arrays(lists, ["key", "tf", "n", "at"])
    return pa.Table.from_arrays([*same, terms.take(pa.array(code[cuts])), *counts, entries], schema.names)


def _entries(blocks: DataFrame, *more: str) -> DataFrame:
    """(more, key, tf, n) of each entry; places stay unread."""
    lists = blocks.select(*more, *[F.col(f"entries.{c}").alias(c) for c in ("key", "tf", "n")])
    return lists.select(*more, F.explode(F.arrays_zip("key", "tf", "n")).alias("e")).select(*more, "e.*")


def _places(blocks: DataFrame) -> DataFrame:
    """(key, at) of each place of each entry."""
    lists = blocks.select(*[F.col(f"entries.{c}").alias(c) for c in ("key", "tf", "at")])
    lists = lists.select(F.flatten(F.zip_with("key", "tf", lambda k, m: F.array_repeat(k, m))).alias("key"), "at")
    return lists.select(F.explode(F.arrays_zip("key", "at")).alias("e")).select("e.*")


# --- changes ---------------------------------------------------------------


def upsert(spark: SparkSession, index: Index, docs: DataFrame) -> None:
    """Replace the documents of these keys, or add them. Only the keys' slots are rewritten; running it again changes nothing."""
    docs = docs.where(F.col(index.key).isNotNull()).withColumn(index.key, F.col(index.key).cast(_key_kind(spark, index)))
    _rewrite(spark, index, docs.select(F.col(index.key).alias("key")), docs)


def delete_keys(spark: SparkSession, index: Index, keys: DataFrame) -> None:
    """Remove the documents of ``keys`` (its column of the index's key). Keys that aren't there are no error."""
    _rewrite(spark, index, keys.select(F.col(index.key).cast(_key_kind(spark, index)).alias("key")).where("key is not null"), None)


def delete_where(spark: SparkSession, index: Index, equal: dict[str, str]) -> None:
    """Remove the documents whose stored columns have all these values."""
    found = index.table(spark, "documents")
    for c, v in equal.items():
        found = found.where(F.col(c) == v)
    _rewrite(spark, index, found.select("key"), None)


def _key_kind(spark: SparkSession, index: Index) -> str:
    return index.table(spark, "documents").schema["key"].dataType.simpleString()


def _rewrite(spark: SparkSession, index: Index, gone: DataFrame, docs: DataFrame | None) -> None:
    slots = [r.slot for r in gone.select(slot_of(F.col("key"), index.slots).alias("slot")).distinct().collect()]  # slots, not keys
    if not slots:
        return
    parts = int(index.layout(spark)["parts"])
    mine, keys = within(["slot"], [(s,) for s in slots]), gone.distinct()
    stored, kind = index.table(spark, "documents").where(mine).join(keys, "key", "left_anti"), _key_kind(spark, index)
    blocks, fresh = index.table(spark, "postings").where(mine).drop("bucket"), None
    if docs is not None:
        new, fresh = _contents(docs, index, parts)
        stored, fresh = stored.unionByName(new), fresh.drop("bucket")
    few = keys.limit(MOST_KEYS + 1).toArrow()["key"]
    if len(few) <= MOST_KEYS:
        blocks = _thinned(blocks, few, kind)
        blocks = blocks if fresh is None else blocks.unionByName(fresh)
    else:
        blocks = blocks.withColumn("fresh", F.lit(False))
        blocks = blocks if fresh is None else blocks.unionByName(fresh.withColumn("fresh", F.lit(True)))
        blocks = _without(blocks, keys.select("key", slot_of(F.col("key"), index.slots).alias("slot"), part_of(F.col("key"), parts).alias("part")), index.block, kind)
    every = [(s, b) for s in slots for b in range(index.buckets)]
    replace_partitions(_in_buckets(blocks, index), f"{index.path}/postings", ["slot", "bucket"], every, rebalanced=False)
    replace_partitions(stored.select("key", *index.keep, "n", "slot"), f"{index.path}/documents", ["slot"], [(s,) for s in slots])
    replace_partitions(_sizes(index.table(spark, "documents").where(mine)).select("docs", "words", "slot"), f"{index.path}/sizes", ["slot"], [(s,) for s in slots])


def _thinned(blocks: DataFrame, keys: pa.ChunkedArray, kind: str) -> DataFrame:
    """``blocks`` without the entries of ``keys``, each cut by itself, where it's read."""
    ship(blocks.sparkSession)
    schema = _block_schema(kind)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    shared = blocks.sparkSession.sparkContext.broadcast(keys.combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = shared.value
        for old in batches:
            lists = {c: pc.struct_field(old.column("entries"), c).flatten() for c in ("key", "tf", "n", "at")}
            kept = np.flatnonzero(~pc.is_in(lists["key"], value_set=gone).to_numpy(zero_copy_only=False))
            tf, n = (lists[c].to_numpy().astype(np.int64) for c in ("tf", "n"))
            row = np.repeat(np.arange(old.num_rows), old.column("docs").to_numpy())
            yield from _blocks(old, arrow, len(row) + 1, old.column("term"), row[kept], lists["key"].take(pa.array(kept)), tf[kept], n[kept], lists["at"].to_numpy(), (np.cumsum(tf) - tf)[kept], by_row=True).to_batches()

    return blocks.select(arrow.names).mapInArrow(run, schema)


def _without(blocks: DataFrame, keys: DataFrame, block: int, kind: str) -> DataFrame:
    """``blocks`` cut anew, part by part, without the entries of ``keys`` (slot, part, key); those of ``fresh`` blocks stay."""
    schema = _block_schema(kind)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(old: pa.Table, gone: pa.Table) -> pa.Table:
        if not old.num_rows:
            return arrow.empty_table()
        if not gone.num_rows:
            return old.select(arrow.names)
        lists = {c: pc.struct_field(old["entries"].combine_chunks(), c).flatten() for c in ("key", "tf", "n", "at")}
        docs = old["docs"].to_numpy()
        coded = old["term"].combine_chunks().dictionary_encode()
        tf, n = (lists[c].to_numpy().astype(np.int64) for c in ("tf", "n"))
        dropped = pc.is_in(lists["key"], value_set=gone["key"].combine_chunks()).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(~dropped | np.repeat(old["fresh"].to_numpy(), docs))
        code = np.repeat(coded.indices.to_numpy().astype(np.int64), docs)
        return _blocks(old, arrow, block, coded.dictionary, code[kept], lists["key"].take(pa.array(kept)), tf[kept], n[kept], lists["at"].to_numpy(), (np.cumsum(tf) - tf)[kept])

    return blocks.groupBy("slot", "part").cogroup(keys.groupBy("slot", "part")).applyInArrow(run, schema)


def stats(spark: SparkSession, index: Index) -> DataFrame:
    """One row: documents, words, blocks, different terms, bytes on disk."""
    sizes = index.table(spark, "sizes").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    blocks = index.table(spark, "postings").agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("term").alias("terms"))
    return sizes.crossJoin(blocks).withColumn("bytes", F.lit(bytes_of(spark, index.path)).cast("long"))  # a row each


def degraded(docs_in_index: int, docs_in_store: int) -> str | None:
    """Why an index can't be trusted: it is empty while the store isn't."""
    return "index empty" if docs_in_index == 0 and docs_in_store > 0 else None


# --- queries ---------------------------------------------------------------


def _score(tf: Column, n: Column, idf: Column, mean: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))


@dataclass(frozen=True)
class Reading:
    """What a query reads: its blocks with the terms' weights, the bar that a block's documents must be able to reach, and the corpus figures."""

    blocks: DataFrame
    bar: float
    docs: int
    mean: float


def blocks_of(spark: SparkSession, index: Index, terms: list[str]) -> DataFrame:
    """The blocks of these terms; their buckets are a partition filter of the scan."""
    buckets = [r[0] for r in spark.range(1).select(F.explode(F.array(*[slot_of(F.lit(t), index.buckets) for t in terms]))).distinct().collect()]
    return index.table(spark, "postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def reading(spark: SparkSession, index: Index, q: Request, limit: int | None) -> Reading:
    """The blocks that can hold one of the best ``limit`` documents; with None, all of the terms' blocks.

    A score grows with tf and shrinks with length, so a block's greatest tf and
    least length bound its documents' score whatever the corpus mean is now. The
    bar is the ``limit``-th best score by a single term among that term's
    weightiest blocks: so many documents reach it. A block stays if its bound
    and the other terms' greatest bounds together reach the bar. A document
    that reaches the bar has all its blocks among these, so its sum is whole.
    """
    total = index.table(spark, "sizes").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    docs, mean = int(total.docs or 0), (total.words or 0) / max(1, total.docs or 0) or 1.0
    terms = list(dict.fromkeys(q.terms))
    blocks = blocks_of(spark, index, terms)
    times = {t: q.terms.count(t) for t in terms}
    found = {r.term: r for r in blocks.groupBy("term").agg(F.sum("docs").alias("df")).collect()}  # the query's terms
    idf = {t: times[t] * _idf(docs, found[t].df) for t in found}
    if not idf:
        return Reading(blocks.withColumns({"idf": F.lit(0.0), "bound": F.lit(0.0)}), 0.0, docs, mean)
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in idf.items() for x in pair]), F.col("term"))
    blocks = blocks.withColumn("idf", weight).withColumn("bound", _score(F.col("most"), F.col("least"), F.col("idf"), mean))
    if limit is None or q.fuzzy or q.newest or q.phrase:
        return Reading(blocks, 0.0, docs, mean)
    some = -(-limit // index.block) + 4
    best = reduce(DataFrame.unionByName, [blocks.where(F.col("term") == t).orderBy(F.desc("bound")).limit(some) for t in idf])
    single = _entries(best, "term", "idf").select("term", "key", _score(F.col("tf"), F.col("n"), F.col("idf"), mean).alias("s"))
    single = _kept(spark, index, single, q)
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("s")))
    bar = single.withColumn("r", rank).where(F.col("r") == limit).agg(F.max("s")).first()[0] or 0.0
    most = {r.term: r.b for r in blocks.groupBy("term").agg(F.max("bound").alias("b")).collect()}
    rest = F.element_at(F.create_map(*[x for t in most for x in (F.lit(t), F.lit(float(sum(most.values()) - most[t])))]), F.col("term"))
    return Reading(blocks.where(F.col("bound") + rest >= bar - SLACK), bar, docs, mean)


def _idf(docs: int, df: int) -> float:
    return math.log(1 + (docs - df + 0.5) / (df + 0.5))


def _kept(spark: SparkSession, index: Index, hits: DataFrame, q: Request) -> DataFrame:
    """Hits whose stored columns pass the request's filters."""
    if not (q.equal or q.at_least):
        return hits
    stored = index.table(spark, "documents")
    for c, v in q.equal.items():
        stored = stored.where(F.col(c) == v)
    for c, v in q.at_least.items():
        stored = stored.where(F.col(c) >= v)
    return hits.join(stored.select("key"), "key", "left_semi")


def _fuzzy(spark: SparkSession, index: Index, q: Request, r: Reading) -> DataFrame:
    """Documents by words within one edit of a term: the different words are compared, not every word of every document."""
    known = index.table(spark, "postings").select("bucket", "term").distinct()
    close = reduce(DataFrame.unionByName, [known.where(near(F.col("term"), t)).withColumn("q", F.lit(k)) for k, t in enumerate(q.terms)])
    hits = index.table(spark, "postings").join(close, ["bucket", "term"])
    tf = _entries(hits, "q").groupBy("q", "key", "n").agg(F.sum("tf").alias("tf"))
    df = {x.q: x.df for x in tf.groupBy("q").agg(F.count(F.lit(1)).alias("df")).collect()}  # the query's terms
    if not df:
        return tf.select("key", F.lit(0.0).alias("score")).limit(0)
    idf = F.element_at(F.create_map(*[F.lit(x) for k, n in df.items() for x in (k, _idf(r.docs, n))]), F.col("q"))
    return tf.groupBy("key").agg(F.sum(_score(F.col("tf"), F.col("n"), idf, r.mean)).alias("score"))


def _phrase(spark: SparkSession, index: Index, phrase: tuple[str, ...]) -> DataFrame:
    """Keys of documents that hold these words in a row."""
    at = {t: [k for k, w in enumerate(phrase) if w == t] for t in phrase}
    starts = []
    for t, places in at.items():
        e = _places(blocks_of(spark, index, [t]))
        starts += [e.select("key", (F.col("at") - k).alias("start")) for k in places]
    return reduce(DataFrame.unionByName, starts).groupBy("key", "start").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") == len(phrase)).select("key").distinct()


def hits(spark: SparkSession, index: Index, q: Request, limit: int | None = None) -> DataFrame:
    """(key, score, stored columns) of documents with any term; with ``limit``, at least the best so many of them."""
    r = reading(spark, index, q, limit)
    if q.fuzzy:
        out = _fuzzy(spark, index, q, r)
    else:
        out = _entries(r.blocks, "idf").groupBy("key").agg(F.sum(_score(F.col("tf"), F.col("n"), F.col("idf"), r.mean)).alias("score"))
    if q.phrase:
        out = out.join(_phrase(spark, index, q.phrase), "key", "left_semi")
    stored = index.table(spark, "documents").select("key", *index.keep)
    out = _kept(spark, index, out, q)
    return out.join(stored, "key").withColumnRenamed("key", index.key)


def search(spark: SparkSession, index: Index, q: Request, newest_by: str | None = None) -> DataFrame:
    """A page of hits, by score or newest, ties by key: the same as ranking the whole corpus."""
    return top(hits(spark, index, q, q.offset + q.limit), q, index.key, newest_by)
