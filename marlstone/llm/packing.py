"""Operator 3, best-fit packing with large-item matching, planned on a histogram of piece lengths."""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.scale import held, mapped, slices, written
from marlstone.llm.word_bpe import Bounded, byte_letters, splitter, vocabulary


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, first rank, end rank, first bin, slots a bin, offset) for all items, and the number of bins.

    Items are told apart by length only, so the plan works on whole classes:
    its size depends on ``capacity``, not on the number of items. Items above
    one third of the capacity go first, from the largest down, each matched
    with the largest remaining one that fits beside it (two at most fill a bin
    that way). Smaller items, from the largest down, then go to the smallest
    gap that holds them; with no such gap they open bins.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    slots: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of bins (first, number)
    bins = 0

    def put(n: int, first: int, number: int, each: int = 1) -> None:
        """``each`` items of length n into each of ``number`` bins that have the gap the caller took them from."""
        slots.append((n, used[n], used[n] + number * each, first, each, at))
        used[n] += number * each

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        if k < 0:
            m, gap = left[a], capacity - a
            at = 0
            put(a, bins, m)
            left[a] = 0
        else:
            b = large[k]
            m = left[a] // 2 if a == b else min(left[a], left[b])
            if m == 0:  # one of its kind is left: it looks for the next smaller one
                k -= 1
                if k < 0:
                    m, gap, at = 1, capacity - a, 0
                    put(a, bins, 1)
                    left[a] = 0
                else:
                    b = large[k]
                    m = 1
            if left[a]:
                at = 0
                put(a, bins, m)
                at = a
                put(b, bins, m)
                left[a] -= m
                left[b] -= m
                gap = capacity - a - b
        gaps[gap].append((bins, m))
        bins += m
        large = [n for n in large if left[n]]
    held = sorted(g for g in gaps if g)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(held, n)
            if k < len(held):
                gap = held[k]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], held[k]
            else:
                gap, first, number = capacity, bins, -(-left[n] // (capacity // n))
                bins += number
            each = gap // n
            full = min(number, left[n] // each)
            at = capacity - gap
            parts = [(first, full, each)] if full else []
            rest = left[n] - full * each
            if full < number and rest:
                parts.append((first + full, 1, rest))
                rest = 0
            done = sum(p[1] for p in parts)
            for f, m, e in parts:
                put(n, f, m, e)
                left[n] -= m * e
                if g := gap - e * n:
                    if g not in gaps:
                        bisect.insort(held, g)
                    gaps[g].append((f, m))
            if done < number:
                if gap not in gaps:
                    bisect.insort(held, gap)
                gaps[gap].append((first + done, number - done))
    return slots, bins


#: New words that go to the library at once.
TOGETHER = 5_000


class WordIds:
    """Words of a text to the tokenizers library's ids, packed; words seen are kept in bounded memory.

    The library's model is given pre-tokens, already lower-cased and split as
    its file says, in the file's byte letters, so only its merges remain to do.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        specials = vocabulary(source)[2]
        self.split = splitter(list(specials))
        self.model = Tokenizer(Tokenizer.from_str(source).model)
        self.letters = byte_letters()
        self.specials = {w: packed_ids([i]) for w, i in specials.items()}
        self.known = Bounded(lambda w: self.encode([w])[0], 250_000)

    def encode(self, words: list[str]) -> list[bytes]:
        at = self.letters.__getitem__
        found = self.model.encode_batch_fast(["".join(map(at, w.encode())) for w in words], add_special_tokens=False)
        return [self.specials[w] if w in self.specials else packed_ids(x.ids) for w, x in zip(words, found, strict=True)]

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; words that are new to a batch go to the library together."""
        split = [self.split(t) if t else [] for t in texts]
        new = self.known.unseen(set().union(*split))
        for at in range(0, len(new), TOGETHER):  # what the library returns is large
            some = new[at : at + TOGETHER]
            for w, ids in zip(some, self.encode(some), strict=True):
                self.known.keep(w, ids)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, _part, _rank): each document's ids cut every ``capacity``.

    ``_rank`` counts pieces of the same length within one task's input, so
    that (task, length, rank) is unique; the table is written before use.
    """
    source = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        words = held(("packing", zlib.crc32(source.value.encode())), lambda: WordIds(source.value))
        part, ranks = TaskContext.get().partitionId(), defaultdict(int)
        for batch in slices(batches, "_t", 1 << 20):
            rows, piece, start, length, crc, rank = [], [], [], [], [], []
            for row, ids in enumerate(words.texts(batch.column("_t").to_pylist())):
                ids += end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    m = min(capacity, n - at)
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(m)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + m)]))
                    rank.append(ranks[m])
                    ranks[m] += 1
            big = [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *big, pa.array([part] * len(rows), pa.int32()), pa.array(rank, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32", "_part", "_rank"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return mapped(rows, run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, _part int, _rank long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    Every document ends with ``end_id``; only documents longer than
    ``capacity`` are cut. The histogram of lengths (``capacity`` rows at most)
    is all that reaches the driver; it plans the bins there, and the plan,
    whose size depends on ``capacity`` alone, is broadcast. A piece finds its
    slot by its rank among pieces of its length: the rank in its own task plus
    the count in tasks before, a prefix sum over one row a (task, length).

    Null and empty texts are packed as their end id alone. Null or repeated
    ids, and repeated rows, are packed row by row. Other columns are ignored.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = written(tokenised_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    local = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    local = local.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, _ = plan_bins(counts, capacity)
    plan = F.broadcast(spark.createDataFrame(slots, "_len long, _lo long, _hi long, _bin long, _each long, _at long"))
    ranked = pieces.join(local, ["_part", "length"]).withColumn("_r", F.col("_rank") + F.col("_before"))
    placed = ranked.join(plan, (F.col("length") == F.col("_len")) & (F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_hi")))
    k = F.col("_r") - F.col("_lo")
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("_bin") + F.floor(k / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(k, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )
