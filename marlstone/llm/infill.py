"""Operator 13, fill-in-middle: a document's tokens as one big integer of boundary bits, cut at two ranked bits and put in prefix, suffix, middle order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.scale import mapped, slices

#: Byte for each code point after encoding to Latin-1 (others become "?"): "1" for A-Z and a-z, else "0".
LETTERS = bytes(0x31 if chr(b).isascii() and chr(b).isalpha() else 0x30 for b in range(256))


@dataclass(frozen=True)
class Shape:
    """How documents are changed: the three marks, percent changed at all, percent of these with the suffix first, and the seed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    percent: int = 90
    spm_percent: int = 20
    seed: str = "1"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or any(a != b and a in b for a in marks for b in marks) or len(set(marks)) < 3 or any(b.startswith(a[k:]) or b.endswith(a[:k]) for a in marks for b in marks for k in range(1, len(a))):
            raise ValueError("a mark is empty, repeated, or shares its end or start with a mark: outputs couldn't be taken apart")


def boundaries(text: str) -> int:
    """Bit i is set where a token starts at code point i: everywhere but between two letters A-Z, a-z."""
    if not text:
        return 0
    letters = int(text.encode("latin-1", "replace").translate(LETTERS)[::-1], 2)
    return ~(letters & letters << 1) & (1 << len(text)) - 1


def place(bits: int, rank: int, width: int) -> int:
    """Position of the set bit with ``rank`` others below it, found by halving; ``width`` if there are no more than ``rank``."""
    at, end = 0, width
    if rank >= bits.bit_count():
        return end
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - n, at + half
    return at


def numbers(doc_id: object, seed: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of the id; a null id counts as an empty one."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[k : k + 4]) for k in (0, 4, 8, 12))


def infilled(text: str, doc_id: object, shape: Shape) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    bits = boundaries(text)
    n = bits.bit_count()
    h1, h2, h3, h4 = numbers(doc_id, shape.seed)
    if not text or h3 % 100 >= shape.percent or any(m in text for m in (shape.prefix, shape.suffix, shape.middle)):
        return n, "plain", None, None, text
    a, b = (place(bits, r, len(text)) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    head, mid, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < shape.spm_percent:
        return n, "spm", a, b - a, f"{shape.suffix}{tail}{shape.prefix}{head}{shape.middle}{mid}"
    return n, "psm", a, b - a, f"{shape.prefix}{head}{shape.suffix}{tail}{shape.middle}{mid}"


def fill_in_middle(docs: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``, over its whole text.

    Tokens are runs of A-Z and a-z and single other code points; two cuts are
    drawn by the hash of seed and id, so a rerun gives the same. ``form`` is
    plain (unchanged: empty texts, texts that hold a mark, and the share that
    isn't drawn), psm or spm. Null text counts as empty, a null id as an empty
    one in the hash. Rows that repeat an id are cut at the same ranks, each in
    its own text. Other columns are ignored whatever their names. An empty
    table gives an empty result. Memory: a few times the text in hand; the
    integers take a bit a code point.
    """
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            rows = [infilled(t or "", i, shape) for i, t in zip(batch.column("_id").to_pylist(), batch.column("_t").to_pylist(), strict=True)]
            n, form, head, mid, out = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(head, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.string())], names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    return mapped(rows, run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, shape: Shape = Shape()) -> Column:
    """The text that ``output`` was made of, from it and its form alone. No text between marks holds one, so each mark is found once."""

    def between(a: str, b: str | None) -> Column:
        tail = F.substring_index(output, a, -1)
        return tail if b is None else F.substring_index(tail, b, 1)

    p, s, m = shape.prefix, shape.suffix, shape.middle
    return F.when(form == "psm", F.concat(between(p, s), between(m, None), between(s, m))).when(form == "spm", F.concat(between(p, m), between(m, None), between(s, p))).otherwise(output)
