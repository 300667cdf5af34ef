"""Helpers shared by the operators: shared-folder tables, fixed-size key filters, bounded Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.sources.shipping import ship
from marlstone.sources.stored import forget, shared_folder, written

__all__ = ["crc32_mod", "forget", "held", "key_filter", "mapped", "marked", "shared_dir", "ship", "slices", "unused", "without", "written"]

#: Bits of a key filter. 2^22 bits are at most 65,536 words of 64 bits, about 1 MB, whatever the input size.
FILTER_BITS = 22
#: Bytes of a record batch between Spark and Python, and of text handed to numpy or regex work at once.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 2 << 20


shared_dir = shared_folder


def key_filter(keys: DataFrame, key: Column) -> DataFrame:
    """A hashed bitmap of ``key`` as rows (word, mask), never more than 65,536 of them: fit to broadcast at any size."""
    at = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)).cast("int")
    bits = keys.select(at.alias("h")).select(F.shiftright("h", 6).alias("word"), F.expr("shiftleft(1L, h & 63)").alias("bit"))
    return bits.groupBy("word").agg(F.bit_or("bit").alias("mask"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def marked(df: DataFrame, bitmap: DataFrame, key: Column, name: str) -> DataFrame:
    """``df`` with boolean ``name``: false if ``key`` is surely not in the bitmap, true if it may be. No shuffle of ``df``."""
    h, word, mask = (unused(df, n) for n in ("_hash", "_word", "_mask"))
    small = F.broadcast(bitmap.select(F.col("word").alias(word), F.col("mask").alias(mask)))
    hit = F.expr(f"coalesce((shiftright(`{mask}`, `{h}` & 63) & 1L) = 1L, false)")
    out = df.withColumn(h, F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)).cast("int"))
    return out.join(small, F.shiftright(F.col(h), 6) == F.col(word), "left").withColumn(name, hit).drop(h, word, mask)


def without(docs: DataFrame, gone: DataFrame, key: str, also: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``gone``. Only rows that a fixed-size filter can't clear are shuffled.

    With ``also``, columns of ``gone`` by what they must equal in ``docs`` (the
    digest of a text), a row goes only if these agree too, so other rows of the
    same key stay. Null keys stay. Columns of ``docs`` keep their order and names.
    """
    maybe, id_ = unused(docs, "_maybe"), unused(docs, "_gone")
    names = {c: unused(docs, f"_gone{k}") for k, c in enumerate(also or {})}
    gone = gone.select(F.col(key).alias(id_), *(F.col(c).alias(n) for c, n in names.items())).distinct()
    both = marked(docs, key_filter(gone, F.col(id_)), F.col(key), maybe)
    sure = both.where(~F.col(maybe)).drop(maybe)
    same = F.col(key) == F.col(id_)
    for c, n in names.items():
        same &= also[c] == F.col(n)
    rest = both.where(F.col(maybe)).drop(maybe).join(gone, same, "left_anti")
    return sure.unionByName(rest)


def mapped(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors and record batches of ``BATCH_BYTES`` at most, so that long rows don't add up.

    The size is a setting of the session and is left so, as the plan runs later.
    """
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def trimmed() -> None:
    """Give memory that is free in this worker back to the system; it would else stay with the worker between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``; a single longer row stays whole."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
        trimmed()
    trimmed()


_held: dict = {}


def held(key, make: Callable):
    """Per worker: what ``make`` returned for ``key``. Only the last key's is held, so stages that follow in one worker don't add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))
