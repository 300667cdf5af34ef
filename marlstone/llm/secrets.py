"""Operator 4, secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.scale import mapped, slices

# Kinds in the order in which they are listed, their patterns, and their least lengths.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 12
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")  # a run of these letters: 18 or more with AKIA
HEX = re.compile("[0-9a-f]{16,}")  # the longest runs, 16 or more

#: Entropy scan: candidate strings, window, and the least bits a character by class.
CANDIDATE = re.compile("[A-Za-z0-9+/_-]{20,}")
WINDOW = 20
LEAST_BITS = {"hex": 3.0, "alnum": 3.55, "base64": 3.7}
# Fixed values of the allow-list: shapes and strings that look random and aren't secret.
ALLOWED = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9T_:-]*|(?:[A-Za-z]+[/_-])+[A-Za-z]*|[0-9_/+-]+")
ALLOWED_PARTS = ("0123456789", "abcdefghijkl", "ABCDEFGHIJKL", "EXAMPLE", "example", "xxxxx", "XXXXX")

#: n log2 n for counts within a window.
N_LOG_N = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 1))]


def char_class(text: str) -> str:
    """The narrowest class that holds the candidate."""
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", text):
        return "hex"
    return "alnum" if text.isalnum() else "base64"


def high_entropy(text: str) -> list[tuple[int, int]]:
    """Spans of ``text`` made of windows whose entropy reaches the class's bound and which hold both letters and digits.

    Counts are kept as the window slides: one character enters, one leaves, and
    the sum of n log2 n changes by their two terms only.
    """
    bound = math.log2(WINDOW) - LEAST_BITS[char_class(text)] + 1e-9
    counts: dict[str, int] = {}
    total, digits, alphas = 0.0, 0, 0
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += N_LOG_N[n + 1] - N_LOG_N[n]
        digits += c.isdigit()
        alphas += c.isalpha()
        if i >= WINDOW:
            out = text[i - WINDOW]
            n = counts[out]
            counts[out] = n - 1
            total += N_LOG_N[n - 1] - N_LOG_N[n]
            digits -= out.isdigit()
            alphas -= out.isalpha()
        if i >= WINDOW - 1 and digits >= 2 and alphas >= 2 and total / WINDOW <= bound:
            start = i - WINDOW + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind; code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that the entropy scan adds, with the allow-list's shapes left out."""
    out = []
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if ALLOWED.fullmatch(word) or any(p in word for p in ALLOWED_PARTS) or "://" in text[max(0, m.start() - 3) : m.start() + 2]:
            continue
        out += [(m.start() + s, m.start() + e, "entropy") for s, e in high_entropy(word)]
    return out


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans in the same order."""
    base = base_spans(text)
    added = entropy_spans(text)
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) if added else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join([f"{k}:{s}:{e}" for s, e, k in spans])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) for each row, over its whole text.

    Null text counts as empty; without spans ``spans`` is empty and the digest
    is that of the empty string. Repeated rows are scanned each; other columns
    are ignored. Spans of different kinds may overlap; none is dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            counts: list[list[int]] = [[], [], [], []]
            digests, texts = [], []
            for text in batch.column("_t").to_pylist():
                base, every = all_spans(text) if text else ([], [])
                kinds = [k for *_, k in every]
                for k, n in zip(KINDS, counts, strict=True):
                    n.append(kinds.count(k))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                texts.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())], [id_col, "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return mapped(rows, run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``; a text without spans is the same."""
    _, spans = all_spans(text)
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if s > at or not out:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with its own columns, secrets in the text replaced by ``mark``; ``length_col``, where given, holds the new length.

    Rows without spans are unchanged, null texts included.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            old = batch.column(text_col).to_pylist()
            new = [redact(t, mark) if t else t for t in old]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns[text_col] = pa.array(new, batch.schema.field(text_col).type)
            if length_col:
                kind = batch.schema.field(length_col).type
                columns[length_col] = pa.array([v if a == b else len(b) for a, b, v in zip(old, new, batch.column(length_col).to_pylist(), strict=True)], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return mapped(docs, run, docs.schema)
