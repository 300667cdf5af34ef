"""Operator 6, toxicity: weighted finite-state transducers, composed, over clauses; terminals and weights learned from labels."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.scale import mapped, slices

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
# What French and Italian put before a vowel without its own.
ELIDED = frozenset("l d j m t s n c qu jusqu lorsqu puisqu dell all nell un".split())
CLAUSE_END = re.compile(r"[.!?;:\n]+")
# Starting terminals of the grammar, in four languages.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile dumb ugly vermin filth filthy dummkopf abschaum connard idiota idiotas imbécil basura".split()
THREATS = "kill killed murder hurt destroy beat shoot stab burn töten umbringen tuer tuez matar mataré".split()
TARGETS = "you your yours he him she her they them these those people everyone du dich ihr euch sie er tu te toi vous il elle ils tú ti usted ellos ella él".split()
NEGATIONS = "n' not no never isn't aren't don't doesn't wasn't nobody nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say wrote writes reported reports claimed claims called quoted according sagte sagt schrieb laut dit écrit selon dijo dice escribió según".split()

#: Labelled rows that the model is fitted on at most (about; chosen by hash of the id), and terminals learned at most.
TRAIN_ROWS, TERMINALS = 20_000, 3_000
#: A learned terminal is in so many toxic documents at least and so many times likelier there.
LEAST_DOCS, LEAST_LIFT = 6, 20.0
PREFIXES = (4, 5, 6)
#: A starting terminal that so many documents hold stays only if it is so many times likelier in toxic ones.
LEAST_SEEN, LEAST_START_LIFT = 20, 3.0
#: Words over which a negation reaches.
REACH = 3
#: Starting log weights of what a clause says of its match, refitted from labels: a match that nobody is the target of, a negated and a reported one.
STARTING = {"untargeted": -0.25, "negated": -2.3, "reported": -0.5}
NAMES = tuple(STARTING)


def words_of(text: str) -> list[str]:
    """The words of a lower-case text in order; an elided article or pronoun is a word of its own (``l'`` before a vowel)."""
    out = []
    for word in WORD.findall(text):
        head, mark, tail = word.replace("’", "'").partition("'")
        out += [f"{head}'", tail] if mark and head in ELIDED and len(tail) > 1 else [f"{head}{mark}{tail}"]
    return out


@dataclass(frozen=True)
class Transducer:
    """A weighted finite-state transducer. ``arcs[state][symbol]`` lists (output, next state, weight); symbols without arcs of their own take those of None, with themselves as output. ``final`` has the weights of the states in which a clause may end."""

    start: int
    arcs: dict[int, dict[str | None, list[tuple[str | None, int, float]]]]
    final: dict[int, float]

    def step(self, state: int, symbol: str) -> list[tuple[str, int, float]]:
        """The moves on one symbol."""
        own = self.arcs.get(state, {})
        return [(symbol if out is None else out, to, w) for out, to, w in own.get(symbol, own.get(None, []))]

    def best(self, symbols: list[str]) -> float:
        """The weight of the best path over all symbols; minus infinity if none ends."""
        at = {self.start: 0.0}
        for x in symbols:
            after: dict[int, float] = {}
            for state, w in at.items():
                for _, to, more in self.step(state, x):
                    after[to] = max(after.get(to, -math.inf), w + more)
            at = after
        return max((w + self.final[k] for k, w in at.items() if k in self.final), default=-math.inf)


def compose(first: Transducer, second: Transducer, alphabet: set[str]) -> Transducer:
    """The machine that runs ``second`` on the output of ``first``, over the symbols of ``alphabet``: states are the pairs that are reached, weights add."""
    numbers, work = {(first.start, second.start): 0}, [(first.start, second.start)]
    arcs: dict[int, dict] = {}
    final: dict[int, float] = {}
    while work:
        p, q = work.pop()
        k = numbers[p, q]
        if p in first.final and q in second.final:
            final[k] = first.final[p] + second.final[q]
        for x in alphabet:
            for mid, p2, w in first.step(p, x):
                for out, q2, v in second.step(q, mid):
                    if (p2, q2) not in numbers:
                        numbers[p2, q2] = len(numbers)
                        work.append((p2, q2))
                    arcs.setdefault(k, {}).setdefault(x, []).append((out, numbers[p2, q2], w + v))
    return Transducer(0, arcs, final)


#: Symbols of words, and of the matches that the machines rewrite: mark! is negated, mark" reported, mark!" both.
WORDS = {"other", "insult", "threat", "target", "negation", "report"}
MARKS = ("", "!", '"', '!"')


def negation() -> Transducer:
    """Marks insults and threats within ``REACH`` words after a negation; state k has k words to go."""
    arcs: dict[int, dict] = {}
    for k in range(REACH + 1):
        to = max(0, k - 1)
        arcs[k] = {None: [(None, to, 0.0)], "negation": [("negation", REACH, 0.0)]}
        if k:
            arcs[k] |= {m: [(m + "!", to, 0.0)] for m in ("insult", "threat")}
    return Transducer(0, arcs, {k: 0.0 for k in range(REACH + 1)})


def reported() -> Transducer:
    """Marks insults and threats after a word of reported speech, to the end of the clause."""
    marked = {m + k: [(m + k + '"', 1, 0.0)] for m in ("insult", "threat") for k in MARKS[:2]}
    return Transducer(0, {0: {None: [(None, 0, 0.0)], "report": [("report", 1, 0.0)]}, 1: {None: [(None, 1, 0.0)]} | marked}, {0: 0.0, 1: 0.0})


def target() -> Transducer:
    """Guesses whether the clause has a target, as it may come after the match: state 1 says none, 2 one that is to come, 3 one that was met. A threat without a target is none."""
    kinds = [m + k for m in ("insult", "threat") for k in MARKS]
    none = {"target": []} | {x: [("other" if x.startswith("threat") else "bare " + x, 1, 0.0)] for x in kinds} | {None: [(None, 1, 0.0)]}
    one = lambda to: {None: [(None, to, 0.0)], "target": [("target", 3, 0.0)]} | {x: [("at " + x, to, 0.0)] for x in kinds}
    start = {x: none.get(x, none[None]) + one(2).get(x, one(2)[None]) for x in [*kinds, "target", None]}
    return Transducer(0, {0: start, 1: none, 2: one(2), 3: one(3)}, {0: 0.0, 1: 0.0, 3: 0.0})


def insult(weights: dict[str, float]) -> Transducer:
    """Takes one match of a clause, of an insult, and weighs what the machines before it found out."""
    return _picked("insult", weights)


def threat(weights: dict[str, float]) -> Transducer:
    """Takes one match of a clause, of a threat, and weighs what the machines before it found out."""
    return _picked("threat", weights)


def _picked(kind: str, weights: dict[str, float]) -> Transducer:
    skip, pick = {None: [(None, 0, 0.0)]}, {}
    for place in ("at ", "bare "):
        for k in MARKS:
            w = weights["untargeted"] * (place == "bare ") + weights["negated"] * ("!" in k) + weights["reported"] * ('"' in k)
            pick[place + kind + k] = [(None, 0, 0.0), ("match", 1, w)]
    return Transducer(0, {0: skip | pick, 1: {None: [(None, 1, 0.0)]}}, {1: 0.0})


def machines(weights: dict[str, float]) -> dict[str, Transducer]:
    """By kind of match, the grammar as one machine: negation, then reported speech, then the target, then the match."""
    context = compose(compose(negation(), reported(), WORDS), target(), WORDS)
    return {"insult": compose(context, insult(weights), WORDS), "threat": compose(context, threat(weights), WORDS)}


@dataclass
class Grammar:
    """Log weights of insult terminals (a word, or a prefix written with *), of threats, of the arcs, and of the calibration."""

    insults: dict[str, float]
    threats: set[str] = field(default_factory=lambda: set(THREATS))
    calibration: tuple[float, ...] = (-4.0, 2.0, 1.0, 0.5, 0.5)
    arcs: dict[str, float] = field(default_factory=lambda: dict(STARTING))


class Scorer:
    """Runs the composed machines over the clauses that hold an insult or threat; other clauses weigh nothing.

    A clause weighs as much as its matches, each by the best path that takes
    it: the weight of the terminal times exp of the path's.
    """

    def __init__(self, grammar: Grammar):
        self.g = grammar
        self.classes = {w: "target" for w in TARGETS} | {w: "negation" for w in NEGATIONS} | {w: "report" for w in REPORTS} | {w: "threat" for w in grammar.threats}
        self.find = ahocorasick.Automaton()
        for w in {*(x.rstrip("*") for x in grammar.insults), *grammar.threats}:
            self.find.add_word(w, len(w))
        if len(self.find):
            self.find.make_automaton()
        self.longest = max((len(w) for w in grammar.insults if w.endswith("*")), default=1) - 1
        self.machines = machines(grammar.arcs)

    def insult(self, word: str) -> float:
        """The weight of the word as an insult; 0 if it is none."""
        g = self.g.insults
        best = g.get(word, 0.0)
        for n in range(min(PREFIXES), min(self.longest, len(word)) + 1):
            best = max(best, g.get(word[:n] + "*", 0.0))
        return best

    def clause(self, words: list[str]) -> float:
        """Weight of one clause, lower-case words in order."""
        return self.weighed(words)[0]

    def weighed(self, words: list[str]) -> tuple[float, float]:
        """Weight of one clause, and the share of its terminals' weight that its best paths leave: near 1 for a plain match, little for a negated one."""
        weights = [self.insult(w) for w in words]
        symbols = [self.classes.get(w) or ("insult" if x else "other") for w, x in zip(words, weights, strict=True)]
        total = plain = 0.0
        for kind, machine in self.machines.items():
            if kind in symbols:
                terminal = [x if kind == "insult" else 1.0 for x in weights]
                for k, w in self.matches(machine, symbols).items():
                    total, plain = total + terminal[k] * math.exp(w), plain + terminal[k]
        return total, total / plain if plain else 0.0

    def matches(self, machine: Transducer, symbols: list[str]) -> dict[int, float]:
        """By place of a match, the weight of the best path of the machine that takes it.

        One pass: states without a match yet hold one weight; a state after a
        match holds one for each place that may still count, and places whose
        paths have come together in one state differ by a constant from then on.
        """
        before, groups = {machine.start: 0.0}, []
        for at, x in enumerate(symbols):
            moved: dict[int, float] = {}
            taken: dict[int, float] = {}
            for state, w in before.items():
                for out, to, more in machine.step(state, x):
                    into = taken if out == "match" else moved
                    into[to] = max(into.get(to, -math.inf), w + more)
            before = moved
            after = []
            for vector, places in groups:
                new: dict[int, float] = {}
                for state, w in vector.items():
                    for _, to, more in machine.step(state, x):
                        new[to] = max(new.get(to, -math.inf), w + more)
                after.append((new, places))
            if taken:
                after.append((taken, {at: 0.0}))
            groups = self._joined(after)
        out: dict[int, float] = {}
        for vector, places in groups:
            end = max((w + machine.final[k] for k, w in vector.items() if k in machine.final), default=-math.inf)
            if end > -math.inf:
                out |= {k: end + w for k, w in places.items()}
        return out

    @staticmethod
    def _joined(groups: list[tuple[dict[int, float], dict[int, float]]]) -> list[tuple[dict[int, float], dict[int, float]]]:
        """Groups whose weights by state are the same but for a constant become one."""
        found: dict[tuple, tuple[dict[int, float], dict[int, float]]] = {}
        for vector, places in groups:
            if not vector:
                continue
            base = max(vector.values())
            key = tuple(sorted((k, round(w - base, 9)) for k, w in vector.items()))
            if key in found:
                kept, all_places = found[key]
                shift = base - max(kept.values())
                all_places.update({k: w + shift for k, w in places.items()})
            else:
                found[key] = (vector, dict(places))
        return list(found.values())

    def clauses(self, text: str) -> Iterator[list[str]]:
        """The words of each clause that holds a terminal, however long it is."""
        low = text.lower()
        until = start_at = 0
        for end, n in self.find.iter(low) if len(self.find) else ():
            start = end - n + 1
            if start < until or start and low[start - 1].isalpha():
                continue
            while m := CLAUSE_END.search(low, start_at):  # ends before the match; each is passed once
                if m.start() >= start:
                    break
                start_at = m.end()
            until = m.start() if m else len(low)
            yield words_of(low[start_at:until])

    def features(self, text: str) -> tuple[float, float, float, float]:
        """log(1 + summed clause weights), the largest one, matched clauses, each by the share that is left of it, and their number per 1,000 words, in logs."""
        total = most = matched = 0.0
        for words in self.clauses(text):
            w, share = self.weighed(words)
            if w > 0:
                total, most, matched = total + w, max(most, w), matched + share
        return math.log1p(total), min(most, 10.0), math.log1p(matched), math.log1p(1000 * matched / (1 + len(text) / 6))

    def score(self, text: str) -> float:
        """From 0 to 1."""
        z = self.g.calibration[0] + sum(a * b for a, b in zip(self.g.calibration[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def contexts(self, text: str) -> list[float]:
        """By what is said of a match (plain, then ``NAMES``): log(1 + matches), to learn the arcs from."""
        n = dict.fromkeys(("plain", *NAMES), 0)
        for words in self.clauses(text):
            symbols = [self.classes.get(w) or ("insult" if self.insult(w) else "other") for w in words]
            for kind, machine in self.probes.items():
                if kind in symbols:
                    for w in self.matches(machine, symbols).values():
                        code = round(-w)
                        for k, name in enumerate(NAMES):
                            n[name] += code >> k & 1
                        n["plain"] += not code
        return [math.log1p(x) for x in n.values()]

    @functools.cached_property
    def probes(self) -> dict[str, Transducer]:
        """The same machines with weights that tell which arcs a path took."""
        return machines({name: -float(1 << k) for k, name in enumerate(NAMES)})


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression, by Newton's steps."""
    a = np.column_stack([np.ones(len(x), x.dtype), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9).astype(a.dtype)[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """A grammar from labelled rows where ``learn`` (of the id) holds; null labels teach nothing.

    About ``TRAIN_ROWS`` labels are drawn by hash, which is the bound of what
    is broadcast and sent to the driver. Document frequencies of words and of
    prefixes, toxic against other, give the terminals, and end starting ones
    that clean documents hold as well (a word may be harmless in another
    language); what the matches'
    contexts tell gives the weights of the arcs; the weighted clauses then
    calibrate the score. With no labels, or none of one kind, what would be
    learned keeps its starting values.
    """
    wanted = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).groupBy("_id").agg(F.max("_y").alias("_y"))
    total = wanted.count()
    starting = Grammar({w: 1.0 for w in INSULTS})
    if not total:
        return starting
    drawn = wanted.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(min(1.0, TRAIN_ROWS / total) * 1_000_000))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_t is not null").join(F.broadcast(drawn), "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches, "_t"):
            for text, y in zip(batch.column("_t").to_pylist(), batch.column("_y").to_pylist(), strict=True):
                words = set(words_of(text.lower()))
                found = words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}
                found.add("")
                n[bool(y)].update(found)
            if len(n[0]) + len(n[1]) > 1_000_000:
                yield table(n)
                n = (Counter(), Counter())
        yield table(n)

    def table(n: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = list(n[0].keys() | n[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in n)], ["term", "n0", "n1"])

    terms = mapped(rows, count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    begun = F.col("term").isin("", *INSULTS, *THREATS)
    terms = terms.where((F.col("n1") >= LEAST_DOCS) | begun).orderBy(F.desc(begun), F.desc(F.col("n1") / (F.col("n0") + 1)), "term").limit(3 * TERMINALS).toPandas()
    size = {k: (a, b) for k, a, b in terms.itertuples(index=False) if k == ""} or {"": tuple(rows.agg(F.count(F.when(F.col("_y") == 0, 1)), F.count(F.when(F.col("_y") != 0, 1))).first())}
    none, some = size[""]
    lift_of = lambda n0, n1: ((n1 + 0.1) / (some + 1)) / ((n0 + 0.5) / (none + 1))
    plain = {t for t, n0, n1 in terms.itertuples(index=False) if n0 + n1 >= LEAST_SEEN and lift_of(n0, n1) < LEAST_START_LIFT}
    insults = {w: x for w, x in starting.insults.items() if w not in plain}
    threats = {w for w in THREATS if w not in plain}
    for term, n0, n1 in sorted(terms.itertuples(index=False), key=lambda r: (len(r[0].rstrip("*")), r[0])):
        if not term or term in insults or n1 < LEAST_DOCS:
            continue
        lift = lift_of(n0, n1)
        covered = any(term[:k] + "*" in insults for k in PREFIXES if k < len(term))
        if lift >= LEAST_LIFT and not covered and len(insults) < TERMINALS:
            insults[term] = min(2.0, math.log(lift) / 4)
    first = Grammar(insults, threats)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            x = [scorer_of(first).contexts(t) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in x], pa.float64()) for k in range(4)] + [batch.column("_y").cast(pa.float64())], [*"abcd", "y"])

    x = mapped(rows, contexts, "a double, b double, c double, d double, y double").toPandas().to_numpy()
    if len({*x[:, 4]}) < 2:
        return first
    learned = Grammar(insults, threats, arcs=learned_arcs(x[:, :4], x[:, 4]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            x = [scorer_of(learned).features(t) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in x], pa.float64()) for k in range(4)] + [batch.column("_y").cast(pa.float64())], [*"abcd", "y"])

    x = mapped(rows, measure, "a double, b double, c double, d double, y double").toPandas().to_numpy()
    return Grammar(insults, threats, calibration=tuple(logistic(x[:, :4], x[:, 4]).tolist()), arcs=learned.arcs)


def learned_arcs(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Log weights of the arcs from documents' matches by context (plain, then ``NAMES``): how much less one says than a plain one; never more.

    The starting weights count as much as ten documents with such matches, so contexts that are rare keep them.
    """
    w = logistic(x, y)[1:]
    plain = max(float(w[0]), 1e-3)
    out = {}
    for k, name in enumerate(NAMES):
        seen = float((x[:, k + 1] > 0).sum())
        ratio = math.log(min(1.0, max(0.05, float(w[k + 1]) / plain)))
        out[name] = (10 * STARTING[name] + seen * ratio) / (10 + seen)
    return out


_loaded: dict = {}


def scorer_of(grammar: Grammar) -> Scorer:
    """Per worker: the scorer of this grammar, built once."""
    key = hash((tuple(sorted(grammar.insults.items())), tuple(sorted(grammar.threats)), grammar.calibration, tuple(sorted(grammar.arcs.items()))))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Scorer(grammar)
    return _loaded[key]


def score_toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, score, predicted) for each row, from its whole text only.

    Null and empty texts have no clause and score lowest. Repeated rows are
    scored each; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, "_t"):
            s = [scorer.score(t or "") for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [id_col, "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return mapped(rows, run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, score double, predicted int")
