"""Operator 2, substring dedup: units (paragraphs, lines, runs of lines, sentences) hashed, grouped, and all but the earliest removed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.scale import mapped, slices, written

#: A unit of fewer words is no passage; it is never removed.
LEAST_WORDS = 8
#: Paragraphs, lines, runs of lines where lines are short, and sentences: a passage may fill a line, lie within one, or take several.
LEVELS = ("paragraph", "line", "run", "sentence")
_ENDS = "。！？｡।॥؟۔"  # these end a sentence whether or not a blank follows
PATTERNS = {
    "paragraph": re.compile(r"(?:[^\n]|\n(?!\s*\n))+"),
    "line": re.compile(r"[^\n]+"),
    "sentence": re.compile(rf"[^\n.!?{_ENDS}]+(?:[.!?]+(?!\s)[^\n.!?{_ENDS}]+)*[.!?{_ENDS}]*"),
}
NOT_WORD = re.compile(r"[\W_]+")
#: Letters of scripts that set no blanks between words: Thai, Lao, Burmese, Khmer, kana, Han. Two of them count as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")


def normalised(part: str) -> str:
    """Lower case, and every run of anything but letters and digits is one blank."""
    return NOT_WORD.sub(" ", part.lower()).strip()


def word_count(words: str) -> int:
    """Words of a normalised text."""
    return (words.count(" ") + 1 if words else 0) + (0 if words.isascii() else len(UNSPACED.findall(words)) // 2)


def runs(text: str, least: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised text) of the shortest run of lines with ``least`` words from each line of fewer on, and up to it.

    They depend on nothing outside, and together cover every stretch of whole
    lines that has so many words; lines without words don't count.
    """
    lines = []
    for m in PATTERNS["line"].finditer(text):
        if words := normalised(m[0]):
            lines.append((m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip()), words, word_count(words)))
    for k, line in enumerate(lines):
        if line[3] >= least:
            continue
        for step, stop in ((1, len(lines)), (-1, -1)):
            n = 0
            for j in range(k, stop, step):
                n += lines[j][3]
                if n >= least:
                    i, j = min(j, k), max(j, k)
                    yield lines[i][0], lines[j][1], " ".join(x[2] for x in lines[i : j + 1])
                    break


def units(text: str, levels: tuple[str, ...] = LEVELS, least: int = LEAST_WORDS) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the text's units with at least ``least`` words, in code points of the text, by ``normalised``.

    A unit that spans one of a level before is that one again and isn't repeated.
    """
    found: dict[tuple[int, int], bytes] = {}
    for level in levels:
        for a, b, words in runs(text, least) if level == "run" else parts(text, level):
            if (a, b) not in found and word_count(words) >= least:
                found[a, b] = hashlib.blake2b(words.encode(), digest_size=16).digest()
    return [(a, b, h) for (a, b), h in sorted(found.items())]


def parts(text: str, level: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised text) of the level's parts without blanks around them."""
    for m in PATTERNS[level].finditer(text):
        part = m[0]
        yield m.start() + len(part) - len(part.lstrip()), m.start() + len(part.rstrip()), normalised(part)


def hashed_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: tuple[str, ...] = LEVELS, least: int = LEAST_WORDS) -> DataFrame:
    """Rows (_id, _text, _start, _end, _digest) for the units of every text; ``_text`` is the XXH64 of the whole text, so that texts of one id are told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            rows, found = [], []
            for k, text in enumerate(batch.column("_t").to_pylist()):
                mine = units(text, levels, least) if text else []
                rows += [k] * len(mine)
                found += mine
            a, b, c = zip(*found, strict=True) if found else ((), (), ())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(at), batch.column("_text").take(at), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["_id", "_text", "_start", "_end", "_digest"])

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.col(text_col).alias("_t"))
    return mapped(rows, run, f"_id {rows.schema['_id'].dataType.simpleString()}, _text long, _start int, _end int, _digest binary")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: tuple[str, ...] = LEVELS, least: int = LEAST_WORDS) -> DataFrame:
    """One row (id, start, end, keep_id, keep_start, occurrences, text_hash) for each unit to remove.

    Units rank by id, then, where an id has several texts, by the texts' hash, and then by start; the first of a digest stays, all later
    ones go, but none that overlaps the one that stays (a line and its sentence
    may read the same, and runs of equal lines overlap). A line that goes holds sentences that go; their rows are given too. Offsets are those of the original text. Counts and the first
    occurrence combine on the map side; a digest that many rows share is split
    by adaptive execution in the join back, where rows are narrow.

    Null and empty texts have no units; neither do texts of fewer than
    ``least`` words. Null ids rank first. Rows that repeat id and text are the
    same occurrence and lose nothing to each other; another text under the same
    id is another document, told by ``text_hash``. Other columns are ignored;
    an empty table gives an empty result.
    """
    found = written(hashed_units(docs, id_col, text_col, levels, least), "units")
    first = found.groupBy("_digest").agg(F.min(F.struct("_id", "_text", "_start", "_end")).alias("_first"), F.max(F.struct("_id", "_text", "_start", "_end")).alias("_last"), F.count(F.lit(1)).alias("occurrences"))
    first = written(first.where("not (_first <=> _last)").drop("_last"), "first")  # else the join takes the aggregation's partitions, which can't be split
    joined = found.join(first, "_digest")
    return joined.where("not (_id <=> _first._id and _text = _first._text and _start < _first._end)").select(
        F.col("_id").alias(id_col), F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_first._id").alias("keep_id"), F.col("_first._start").alias("keep_start"), "occurrences", F.col("_text").alias("text_hash")
    )


def removed(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans (start, end), which may touch or overlap."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a])
        at = max(at, b)
    return "".join(out) + text[at:]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: tuple[str, ...] = LEVELS, least: int = LEAST_WORDS) -> DataFrame:
    """One row (id, text, spans) for each row: the text without its repeated units, and what went as (start, end) in the original text.

    Spans that touch or overlap are one. Spans belong to an id and a text, so
    texts that share an id lose their own repeats only, and rows that repeat id
    and text lose the same. Texts without repeats, nulls and texts of null ids
    stay whole with no spans. Other columns are ignored; an empty table gives
    an empty result.
    """
    gone = repeated_units(docs, id_col, text_col, levels, least).where(F.col(id_col).isNotNull())
    gone = written(gone.groupBy(F.col(id_col).alias("_gone"), "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans")), "spans")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(gone, (F.col("_id") == F.col("_gone")) & (F.xxhash64("_t") == F.col("text_hash")), "left").select("_id", "_t", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            texts, merged = [], []
            for text, spans in zip(batch.column("_t").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                out: list[dict] = []
                for x in spans or []:
                    if out and x["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], x["end"])
                    else:
                        out.append(dict(x))
                merged.append(out)
                texts.append(removed(text, [(x["start"], x["end"]) for x in out]) if text and out else text)
            kind = pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string()), pa.array(merged, kind)], [id_col, text_col, "spans"])

    return mapped(rows, run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, `{text_col}` string, spans array<struct<start:int,end:int>>")
