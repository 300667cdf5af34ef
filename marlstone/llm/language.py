"""Operator 9, language identification: script ranges, per-word scores, and Viterbi with a switching penalty."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.scale import held, mapped, slices

#: Runs of letters, once numerals that patterns take for word characters (from a rule: fractions, circled digits and the like; none is beyond the second plane) are blanked.
WORD = re.compile(r"[^\W\d_]+")
NUMERALS = frozenset(c for c in map(chr, range(0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())


def lowered(text: str) -> str:
    """Lower case, with blanks for numerals."""
    low = text.lower()
    return low if low.isascii() or NUMERALS.isdisjoint(low) else "".join([" " if c in NUMERALS else c for c in low])


# First and last code points of scripts.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)), "greek": ((0x370, 0x3FF),), "cyrillic": ((0x400, 0x52F),), "armenian": ((0x530, 0x58F),), "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)), "devanagari": ((0x900, 0x97F),), "thai": ((0xE00, 0xE7F),), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),), "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
#: Documents of each language that the model is fitted on at most (about; chosen by hash of the id), and grams kept for each. Every language that is met is learned.
TRAIN_DOCS, TRAIN_GRAMS = 1_500, 30_000
#: Weight of a gram, bound of what one word can say, cost of a switch, and of a script that a language doesn't use; share of a language's words from which it uses a script.
GRAM_WEIGHT, WORD_BOUND, SWITCH, WRONG_SCRIPT, USED = 0.5, 6.0, 9.0, 12.0, 0.02
BLOCK = 32
#: Letters of a piece at most, in scripts that set blanks between words and in those that don't.
PIECE_LETTERS, UNSPACED_LETTERS, UNSPACED = 40, 4, ("thai", "kana", "han")
_RANGES = {s: "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) for s, ranges in SCRIPTS.items()}
PIECE = re.compile("|".join(f"[{x}]{{1,{UNSPACED_LETTERS if s in UNSPACED else PIECE_LETTERS}}}" for s, x in _RANGES.items()) + f"|[^{''.join(_RANGES.values())}]{{1,{PIECE_LETTERS}}}")


def script_of(word: str) -> str:
    """The script of the word's first letter; "other" outside the listed ranges."""
    c = ord(word[0])
    return next((s for s, ranges in SCRIPTS.items() if any(a <= c <= b for a, b in ranges)), "other")


def pieces(run: str) -> list[str]:
    """The words of a run of letters: cut where the script changes, and after so many letters of one; no letter is left out."""
    return [run] if PIECE.match(run).end() == len(run) else PIECE.findall(run)


def grams(word: str) -> list[str]:
    """Runs of one to four characters of the word within blanks."""
    w = f" {word} "
    k = len(w)
    return [*word, *[w[i : i + 2] for i in range(k - 1)], *[w[i : i + 3] for i in range(k - 2)], *[w[i : i + 4] for i in range(k - 3)]]


@dataclass
class Candidates:
    """The languages (numbers) that use a script, and log-likelihoods of its grams in these only: a row for each gram, row 0 for an unseen one."""

    langs: np.ndarray
    grams: dict[str, int]
    table: np.ndarray


@dataclass
class Model:
    """The languages, and by script the candidates of its words."""

    langs: list[str]
    scripts: dict[str, Candidates]

    def key(self) -> tuple:
        """Tells models apart within a worker."""
        return (*self.langs, *((s, len(c.grams), zlib.crc32(c.table.tobytes())) for s, c in self.scripts.items()))

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of lower-case words, a row each, at most 0.

        A word's script narrows the languages: only those that use it are
        compared, where the best has 0 and the others no less than
        ``-WORD_BOUND``; all others have ``-WRONG_SCRIPT``. A word of a script
        that no language uses says nothing.
        """
        out = np.zeros((len(words), len(self.langs)), np.float32)
        of_script: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            of_script.setdefault(script_of(w), []).append(k)
        for script, rows in of_script.items():
            if script not in self.scripts:
                continue
            c = self.scripts[script]
            at, flat, sizes = c.grams.get, [], []
            for k in rows:
                found = [at(g, 0) for g in grams(words[k])]
                flat += found
                sizes.append(len(found))
            s = np.add.reduceat(c.table[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
            full = np.full((len(rows), len(self.langs)), -WRONG_SCRIPT, np.float32)
            full[:, c.langs] = np.maximum(GRAM_WEIGHT * (s - s.max(axis=1, keepdims=True)), -WORD_BOUND)
            out[rows] = full
        return out


def fit_languages(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from the rows where ``learn`` holds and language and text are not null; None if there is none.

    Rows are drawn by hash of the id, about ``TRAIN_DOCS`` a language; grams are
    counted on the executors over whole texts and the most frequent ones of
    each language are sent to the driver. A script's table has the languages
    that use it only, so the model grows with the languages, not with their square.
    """
    rows = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_l"), F.col(text_col).alias("_t"))
    counts = rows.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return None
    langs = sorted(r["_l"] for r in counts)
    share = rows.sparkSession.createDataFrame([(r["_l"], int(min(1.0, TRAIN_DOCS / r["n"]) * 1_000_000)) for r in counts], "_l string, _share long")
    drawn = rows.join(F.broadcast(share), "_l").where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.col("_share")).select("_id", "_l", "_t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("grams",), lambda: None)  # what a stage before this one held in the worker goes
        for batch in slices(batches, "_t", 1 << 20):
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column("_l").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(lowered(text)))
            for lang, found in words.items():
                n: Counter = Counter()
                for run, k in found.items():
                    for w in pieces(run):
                        script = script_of(w)
                        n[script] += k
                        for g in grams(w):
                            n[f"{script}\t{g}"] += k
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(list(n)), pa.array(list(n.values()), pa.int64())], ["lang", "gram", "n"])

    table = mapped(drawn, count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = table.where("n > 1 or instr(gram, '\t') = 0").withColumn("r", rank).where(F.col("r") <= TRAIN_GRAMS).select("lang", "gram", "n").toPandas()
    at = {x: k for k, x in enumerate(langs)}
    words: dict[str, np.ndarray] = {}
    counts: dict[str, dict[str, list[tuple[int, int]]]] = {}
    total = np.zeros(len(langs))
    for lang, gram, k in found.itertuples(index=False):
        script, tab, g = gram.partition("\t")
        if tab:
            counts.setdefault(script, {}).setdefault(g, []).append((at[lang], k))
            total[at[lang]] += k
        else:
            words.setdefault(script, np.zeros(len(langs)))[at[lang]] += k
    total += 0.5 * max(1, sum(map(len, counts.values())))
    letters = sum(words.values(), np.zeros(len(langs)))
    scripts = {}
    for script, n in words.items():
        used = np.flatnonzero(n > USED * letters)
        if not len(used):
            continue
        column = {int(k): i for i, k in enumerate(used)}
        mine = {g: v for g, v in counts.get(script, {}).items() if any(k in column for k, _ in v)}
        x = np.full((len(mine) + 1, len(used)), 0.5)
        for row, v in enumerate(mine.values(), 1):
            for k, many in v:
                if k in column:
                    x[row, column[k]] += many
        scripts[script] = Candidates(used, {g: k + 1 for k, g in enumerate(mine)}, np.log(x / total[used]).astype(np.float32))
    return Model(langs, scripts)


def viterbi(texts: list[np.ndarray], scores: np.ndarray, switch: float = SWITCH) -> list[np.ndarray]:
    """The best label of every word of every text: the sum of word scores less ``switch`` for each change is largest.

    ``texts`` index rows of ``scores``; row 0 must be zeros. Steps run over
    blocks of ``BLOCK`` words of all texts at once: first each block's best sums
    from any label before it to any label at its end, then these chained text
    by text, then the way back. On equal sums a label is kept, else the first wins.
    """
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    blocks = [-(-len(texts[k]) // BLOCK) for k in order]
    m, many = sum(blocks), scores.shape[1]
    if not m:
        return [np.zeros(0, np.int64) for _ in texts]
    x = np.zeros(m * BLOCK, np.int64)
    first = np.concatenate(([0], np.cumsum(blocks)))[:-1]
    for k, at in zip(order, first, strict=True):
        x[at * BLOCK : at * BLOCK + len(texts[k])] = texts[k]
    x = x.reshape(m, BLOCK)
    whole = np.empty((m, many, many), np.float32)
    step = max(1, (1 << 22) // (many * many))
    for at in range(0, m, step):
        rows = x[at : at + step]
        a = np.where(np.eye(many, dtype=bool), np.float32(0), np.float32(-1e9))[None].repeat(len(rows), axis=0)
        for t in range(BLOCK):
            np.maximum(a, a.max(axis=2, keepdims=True) - switch, out=a)
            a += scores[rows[:, t]][:, None, :]
        whole[at : at + step] = a
    sizes = np.array(blocks)
    v, before = np.zeros((len(texts), many), np.float32), np.zeros((m, many), np.float32)
    for k in range(blocks[0]):
        n = int((sizes > k).sum())
        at = first[:n] + k
        before[at] = v[:n]
        v[:n] = (v[:n, :, None] + whole[at]).max(axis=1)
        v[:n] -= v[:n].max(axis=1, keepdims=True)
    back = np.empty((BLOCK, m, many), np.int16)
    own = np.arange(many, dtype=np.int16)[None]
    for t in range(BLOCK):
        top = before.argmax(axis=1)
        best = before.max(axis=1, keepdims=True) - switch
        back[t] = np.where(before >= best, own, top[:, None])
        before = np.maximum(before, best) + scores[x[:, t]]
    start = np.broadcast_to(own.astype(np.int64), (m, many))
    for t in reversed(range(BLOCK)):
        start = np.take_along_axis(back[t], start, 1).astype(np.int64)
    state, ends = v.argmax(axis=1), np.zeros(m, np.int64)
    for k in reversed(range(blocks[0])):
        n = int((sizes > k).sum())
        at = first[:n] + k
        ends[at] = state[:n]
        state[:n] = start[at, state[:n]]
    labels = np.empty((m, BLOCK), np.int64)
    for t in reversed(range(BLOCK)):
        labels[:, t] = ends
        ends = back[t][np.arange(m), ends].astype(np.int64)
    flat, out = labels.ravel(), [np.zeros(0, np.int64)] * len(texts)
    for k, at in zip(order, first, strict=True):
        out[k] = flat[at * BLOCK : at * BLOCK + len(texts[k])]
    return out


class Labeller:
    """Per worker: word scores in a table of bounded size, and labels of texts.

    Two generations of words: when the younger holds ``most``, it becomes the
    older, whose scores are copied when met again.
    """

    def __init__(self, model: Model, most: int = 120_000):
        self.model, self.most = model, most
        self.row: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.langs)), np.float32)
        self.old: tuple[dict[str, int], np.ndarray] = ({}, self.scores)

    def _turn(self) -> None:
        self.old = (self.row, self.scores)
        self.row, self.scores = {}, np.zeros((1024, len(self.model.langs)), np.float32)

    def _learn(self, words: list[str]) -> None:
        """Give each of these new words a row."""
        row, (old, old_scores) = self.row, self.old
        need = len(row) + len(words) + 1
        if need > len(self.scores):
            grown = np.zeros((max(need, 2 * len(self.scores)), self.scores.shape[1]), np.float32)
            grown[: len(self.scores)] = self.scores
            self.scores = grown
        known = [w for w in words if w in old]
        fresh = [w for w in words if w not in old]
        for part, values in ((known, lambda x: old_scores[[old[w] for w in x]]), (fresh, self.model.words)):
            for at in range(0, len(part), 20_000):
                some = part[at : at + 20_000]
                first = len(row) + 1
                self.scores[first : first + len(some)] = values(some)
                row.update(zip(some, range(first, first + len(some)), strict=True))

    def labels(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.row) > self.most:
            self._turn()
        words = [WORD.findall(lowered(t)) for t in texts]
        row = self.row
        new = {w for x in words for w in x if w not in row}
        if broken := {w: p for w in new if len(p := pieces(w)) > 1}:
            words = [[p for w in x for p in broken.get(w, (w,))] for x in words]
            new = {w for x in words for w in x if w not in row}
        if new:
            self._learn(list(new))
        found = [np.fromiter(map(row.__getitem__, x), np.int64, len(x)) for x in words]
        return viterbi(found, self.scores)

    def spans(self, text: str, labels: np.ndarray) -> list[dict]:
        """Runs of words of one label as (start, end, lang), in code points of ``text``."""
        if not len(labels):
            return []
        edge = np.flatnonzero(np.diff(labels)) + 1
        if not len(edge):
            return [{"start": 0, "end": len(text), "lang": self.model.langs[int(labels[0])]}]
        low = lowered(text)
        at = np.array([m.span() for run in WORD.finditer(low) for m in PIECE.finditer(low, *run.span())])
        if len(low) != len(text):  # some letters become two: back to places in the text
            place = np.append(np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]), len(text))
            at = np.stack([place[at[:, 0]], place[at[:, 1] - 1] + 1], axis=1)
        bounds = [0, *edge.tolist(), len(labels)]
        return [{"start": int(at[a][0]), "end": int(at[b - 1][1]), "lang": self.model.langs[int(labels[a])]} for a, b in zip(bounds, bounds[1:], strict=False)]


def identify_languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """One row (id, lang_pred, score[, spans]) for each row: the language of most words, their share, and the spans found.

    Null texts and texts without letters are ``und`` with score 0; so is every
    text if the model is None. Equal shares go to the language that sorts
    first. Repeated rows are labelled each; other columns are ignored; whole
    texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = None if shared.value is None else held(("language", shared.value.key()), lambda: Labeller(shared.value))
        for batch in slices(batches, "_t", 1 << 20):
            texts = [t or "" for t in batch.column("_t").to_pylist()]
            labels = labeller.labels(texts) if labeller is not None else [np.zeros(0, np.int64)] * len(texts)
            counts = [np.bincount(x) for x in labels]
            lang = [shared.value.langs[int(n.argmax())] if len(n) else "und" for n in counts]
            score = [float(n.max() / n.sum()) if len(n) else 0.0 for n in counts]
            columns = {id_col: batch.column("_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
            if spans:
                columns["spans"] = pa.array([labeller.spans(t, x) if len(x) else [] for t, x in zip(texts, labels, strict=True)], pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "lang": pa.string()})))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return mapped(rows, run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans)


#: Share of words below which no language owns a document.
LEAST_SHARE = 0.5


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = LEAST_SHARE) -> DataFrame:
    """``docs`` with its own columns, without rows whose language is ``und`` or owns less than ``least`` of the words.

    Decided row by row in one pass, so no join is needed and repeated ids are no
    matter. Null and empty texts go; without a model all rows do. An empty
    table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is None:
            return
        labeller = held(("language", shared.value.key()), lambda: Labeller(shared.value))
        for batch in slices(batches, text_col, 1 << 20):
            counts = [np.bincount(x) for x in labeller.labels([t or "" for t in batch.column(text_col).to_pylist()])]
            yield batch.filter(pa.array([bool(len(n)) and n.max() >= least * n.sum() for n in counts], pa.bool_()))

    return mapped(docs, run, docs.schema)
