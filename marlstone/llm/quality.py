"""Operator 10, quality classifier by co-training: a text view and a metadata view teach each other, then score together."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.scale import mapped, slices
from marlstone.llm.toxicity import logistic

#: Labelled rows and unlabelled rows that the classifiers are fitted on at most (about; chosen by hash of the id).
LABELLED_ROWS, POOL_ROWS = 15_000, 15_000
ROUNDS, TAKE, SURE = 5, 400, 0.95
META_BUCKETS = 64
#: Buckets of the text's words, and of its runs of three bytes.
WORD_BUCKETS, RUN_BUCKETS = 128, 128

_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), list(range(ord(a), ord(b) + 1))) for a, b in ("AZ", "az", "09"))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_HIGH = np.arange(256) >= 128
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)
SHAPES = 16
TEXT_FEATURES = SHAPES + WORD_BUCKETS + RUN_BUCKETS


def text_view(text: str) -> np.ndarray:
    """The whole text: its shapes, and how often each bucket of words and of runs of three bytes is met, as square roots of shares; all zero if it's empty."""
    if not text:
        return np.zeros(TEXT_FEATURES)
    words = np.bincount([zlib.crc32(w) % WORD_BUCKETS for w in text.lower().encode().split()], minlength=WORD_BUCKETS)
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    runs = np.bincount((b[:-2] * 7919 + b[1:-1] * 104729 + b[2:] * 1299709 >> 5) % RUN_BUCKETS, minlength=RUN_BUCKETS) if len(b) > 2 else np.zeros(RUN_BUCKETS)
    return np.concatenate([shapes(text), *(np.sqrt(n / max(1, n.sum())) for n in (words, runs))])


def shapes(text: str) -> list[float]:
    """Shares and shapes of a text: letters, symbols, words, repeats and lines."""
    n = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = int(n.sum())
    share = [float(n[k].sum()) / size for k in (_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _SYMBOL)]
    words = text.split()
    k = max(1, len(words))
    same = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = n[_SYMBOL]
    return [
        *share, np.log1p(len(words)), len(set(words)) / k, same / k, size / k, float(symbols.max()) / size, float(n[ord("|")]) / k, float(n[ord("!")]) / k,
        (float(n[ord(".")]) + 1) / k, len(lines) / k, len(set(lines)) / max(1, len(lines)),
    ]


def hashed(*names: object) -> list[int]:
    """Buckets of metadata values."""
    return [zlib.crc32(f"{k}={v}".encode()) % META_BUCKETS for k, v in enumerate(names)]


def meta_view(source: str | None, lang: str | None, chars: int | None) -> np.ndarray:
    """What is known without reading the text: source and language, alone and together, and the listed length's size in buckets, and the length."""
    x = np.zeros(META_BUCKETS + 3)
    x[hashed(source, lang, (source, lang), None if chars is None else max(0, chars).bit_length())] = 1
    c = np.log1p(max(0, chars or 0))
    x[-3:] = c, c * c / 10, chars is None
    return x


@dataclass
class View:
    """A standardised logistic classifier, and the (bias, slope) that calibrate its logit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    calibration: tuple[float, float] = (0.0, 1.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0], -30, 30)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration[0] + self.calibration[1] * self.raw(x), -30, 30)


def fit_view(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> View:
    """Fitted on one set of rows, calibrated on another."""
    scale = x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    view = View(x.mean(axis=0), scale, logistic((x - x.mean(axis=0)) / scale, y, ridge=10.0))
    a, b = logistic(view.raw(held_x)[:, None], held_y)
    view.calibration = (float(a), float(b))
    return view


@dataclass
class CoTrained:
    """Both views, and the weights (bias, text, metadata) that combine their calibrated logits."""

    text: View
    meta: View
    mix: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        z = self.mix[0] + self.mix[1] * self.text.logit(text) + self.mix[2] * self.meta.logit(meta)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> CoTrained | None:
    """``y``: 1, 0, or NaN for the unlabelled pool. None if a label is missing from the labelled rows.

    In each round each view labels the pool rows that it is sure of, by its
    calibrated likelihood, at most ``TAKE`` of each label in proportion to the
    labelled share, for the other view. A quarter of the labelled rows is kept
    out of both views: one half calibrates each, the other mixes them. Too few
    labelled rows for that serve for all.
    """
    labelled = np.flatnonzero(~np.isnan(y))
    if len({*y[labelled]}) < 2:
        return None
    turn = np.arange(len(labelled)) % 8
    calibrate, mixed, own = labelled[turn == 3], labelled[turn == 7], labelled[(turn != 3) & (turn != 7)]
    if any(len({*y[k]}) < 2 for k in (calibrate, mixed, own)):
        calibrate = mixed = own = labelled
    pool = np.flatnonzero(np.isnan(y))
    views, x = {}, {"text": text, "meta": meta}
    taught: dict[str, dict[int, float]] = {"text": {}, "meta": {}}
    share = y[own].mean()
    for k in range(rounds + 1):
        for v in x:
            more = taught[v]
            rows = np.concatenate([own, np.fromiter(more, np.int64, len(more))])
            views[v] = fit_view(x[v][rows], np.concatenate([y[own], np.fromiter(more.values(), float, len(more))]), x[v][calibrate], y[calibrate])
        if k == rounds:
            break
        for v, other in (("text", "meta"), ("meta", "text")):
            left = pool[~np.isin(pool, np.fromiter(taught[other], np.int64, len(taught[other])))]
            p = 1 / (1 + np.exp(-views[v].logit(x[v][left])))
            for label, sure, part in ((1.0, p, share), (0.0, 1 - p, 1 - share)):
                best = np.argsort(-sure, kind="stable")[: max(1, int(TAKE * part))]
                taught[other] |= {int(i): label for i in left[best[sure[best] >= SURE]]}
    mix = logistic(np.column_stack([views["text"].logit(text[mixed]), views["meta"].logit(meta[mixed])]), y[mixed])
    return CoTrained(views["text"], views["meta"], mix)


def _rows(docs: DataFrame, id_col: str, text_col: str, meta: tuple[str, str, str]) -> DataFrame:
    s, lang, n = meta
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(s).cast("string").alias("_s"), F.col(lang).cast("string").alias("_l"), F.col(n).cast("long").alias("_n"))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_view(t or "") for t in batch.column("_t").to_pylist()]).reshape(-1, TEXT_FEATURES)
    return text, np.array([meta_view(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("_s", "_l", "_n")), strict=True)])


META = ("source", "lang", "n_chars")


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta: tuple[str, str, str] = META) -> CoTrained | None:
    """Fit on about ``LABELLED_ROWS`` labelled rows and ``POOL_ROWS`` others, all where ``learn`` (of the id) holds, drawn by hash.

    Features alone reach the driver, of a bounded number of rows. None without
    labels, or with one label only; null labels teach nothing, and of several
    labels of one id the largest counts.
    """
    wanted = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(label_col).cast("double").alias("_y")).groupBy("_i").agg(F.max("_y").alias("_y"))
    n, total = wanted.count(), docs.count()
    if not n:
        return None
    h = lambda c, m: F.pmod(F.xxhash64(c), F.lit(1_000_000)) < int(min(1.0, m) * 1_000_000)
    drawn = F.broadcast(wanted.where(h("_i", LABELLED_ROWS / n)))
    rows = _rows(docs.where(learn), id_col, text_col, meta).where("_id is not null")
    pool = h(F.concat(F.lit("pool"), F.col("_id").cast("string")), POOL_ROWS / max(1, total))
    rows = rows.join(drawn, F.col("_id") == F.col("_i"), "left").where(F.col("_y").isNotNull() | pool)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            text, m = _views(batch)
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), *(pa.array([x.tobytes() for x in v.astype(np.float32)], pa.binary()) for v in (text, m)), batch.column("_y")], ["i", "t", "m", "y"])

    found = mapped(rows, measure, "i string, t binary, m binary, y double").toPandas().sort_values("i")
    if not len(found):
        return None
    text, m = (np.frombuffer(b"".join(found[c]), np.float32).reshape(len(found), -1) for c in "tm")  # as bytes: lists of numbers would fill the driver
    return co_train(text, m, found["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, str, str] = META) -> DataFrame:
    """One row (id, score, text_score, meta_score, predicted) for each row; score is the likelihood of label 1.

    Null text counts as empty, null metadata as a value of its own. Without a
    model every score is 0.5. Repeated rows are scored each; columns other than
    those named are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, "score", "text_score", "meta_score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "_t"):
            if model is None:
                three = [np.full(batch.num_rows, 0.5)] * 3
            else:
                text, m = _views(batch)
                three = [model.score(text, m), *(1 / (1 + np.exp(-v.logit(x))) for v, x in ((model.text, text), (model.meta, m)))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *map(pa.array, three), pa.array((three[0] >= 0.5).astype(np.int32))], names)

    rows = _rows(docs, id_col, text_col, meta)
    return mapped(rows, run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, score double, text_score double, meta_score double, predicted int")
