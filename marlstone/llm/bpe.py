"""Operator 7, exact BPE encoding by per-prefix dynamic programming, and decoding."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.scale import held, mapped, slices
from marlstone.llm.word_bpe import Bounded, byte_letters, splitter, vocabulary

#: Added to the code point of a word's last letter: the same letter with the word-end mark is another symbol.
END_SHIFT = 0x1000
END_MARK = "</w>"


class PrefixEncoder:
    """BPE ids of a pre-token in one pass over its prefixes.

    An automaton over the vocabulary gives, at each position, the tokens that
    end there. Of these exactly one is the last token of the prefix's own
    encoding: the one that is compatible with the last token of the prefix
    before it, that is, whose border no merge would have crossed. It is stored
    for each prefix, and back-pointers (position less token length) emit the
    ids. Time is linear in the text for a vocabulary of bounded token length.
    """

    def __init__(self, source: str):
        self.vocab, merges, self.specials = vocabulary(source)
        self.letters = byte_letters()
        self.split = splitter(list(self.specials))
        shifted = {t: self._symbols(t) for t in self.vocab}
        self.token_of = {s: t for t, s in shifted.items()}
        self.rank = {(shifted[a], shifted[b]): r for r, (a, b) in enumerate(merges) if a in shifted and b in shifted}
        # the merge that makes each token: its first in order; tokens of more than one symbol without one are never made
        made: dict[str, tuple[str, str]] = {}
        for a, b in self.rank:
            made.setdefault(a + b, (a, b))
        usable = [s for s in self.token_of if len(s) == 1 or s in made]
        self.right_spine = {s: self._spine(s, made, 1) for s in usable}
        self.left_spine = {s: self._spine(s, made, 0) for s in usable}
        self.matches = ahocorasick.Automaton()
        for s in usable:
            self.matches.add_word(s, s)
        self.matches.make_automaton()
        self.fits = Bounded(self._fits, 500_000)
        # a token that its own pieces wouldn't merge into can't be the encoding of its text
        for s in sorted((s for s in usable if len(s) > 1), key=len):
            if not self._reached(s, made):
                self.matches.remove_word(s)
        self.matches.make_automaton()

    @staticmethod
    def _symbols(token: str) -> str:
        return token[: -len(END_MARK) - 1] + chr(ord(token[-len(END_MARK) - 1]) + END_SHIFT) if token.endswith(END_MARK) and len(token) > len(END_MARK) else token

    def _spine(self, token: str, made: dict[str, tuple[str, str]], side: int) -> list[tuple[str, float]]:
        """The pieces that lie at one edge of the token while it's built, each with the rank of the merge that ends it."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in made:
                return out
            until = self.rank[made[token]]
            token = made[token][side]

    def _reached(self, token: str, made: dict[str, tuple[str, str]]) -> bool:
        a, b = made[token]
        # no other merge may cross the border between its halves before its own does
        own = self.rank[a, b]
        return not any(self.rank.get((x, y), own) < min(own, p) and self.rank[x, y] <= q for x, p in self.right_spine[a] for y, q in self.left_spine[b])

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether two tokens stand side by side in an encoding: no merge crosses their border while both edge pieces exist."""
        for x, p in self.right_spine[pair[0]]:
            for y, q in self.left_spine[pair[1]]:
                r = self.rank.get((x, y))
                if r is not None and r < p and r <= q:
                    return False
        return True

    def tokens(self, word: str) -> list[str]:
        """The vocabulary's tokens for one pre-token."""
        if word in self.specials:
            return [word]
        text = "".join(map(self.letters.__getitem__, word.encode()))
        if not text:
            return []
        text = text[:-1] + chr(ord(text[-1]) + END_SHIFT)
        last: list[str | None] = [None] * (len(text) + 1)
        fits = self.fits
        for end, token in self.matches.iter(text):
            end += 1
            if last[end] is None:
                start = end - len(token)
                before = last[start]
                if start == 0 or before is not None and fits[before, token]:
                    last[end] = token
        at, out = len(text), []
        while at:
            token = last[at]
            out.append(self.token_of[token])
            at -= len(token)
        return out[::-1]

    def ids(self, tokens: list[str]) -> list[int]:
        return [self.vocab[t] if t in self.vocab else self.specials[t] for t in tokens]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [i for w in self.split(text) for i in self.ids(self.tokens(w))]

    def decode(self, ids: list[int]) -> str:
        """The text that the library's decode gives for a file without decoder: the tokens with a space between; unknown ids are left out."""
        if not hasattr(self, "by_id"):
            self.by_id = {i: t for t, i in [*self.vocab.items(), *self.specials.items()]}
        return " ".join(self.by_id[i] for i in ids if i in self.by_id)


def _digester(source: str):
    """Per worker: the encoder, and for each word (ids as text, decoded text) in bounded memory."""

    def make():
        enc = PrefixEncoder(source)
        return enc, Bounded(lambda w: _word(enc, w), 150_000)

    return held(("bpe", zlib.crc32(source.encode())), make)


def _word(enc: PrefixEncoder, word: str) -> tuple[bytes, bytes]:
    ids = enc.ids(enc.tokens(word))
    return " ".join(map(str, ids)).encode(), enc.decode(ids).encode()


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, ids array<int>, decoded string) for each row: the ids of the whole text, and what they decode to.

    Null and empty texts have no ids and decode to the empty text. Repeated
    rows are encoded each. Other columns are ignored. The vocabulary file is
    read on the driver and broadcast (a fixed file, a few MB).
    """
    source = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = _digester(source.value)
        for batch in slices(batches, "_t"):
            ids = [enc.encode(t or "") for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.string())], [id_col, "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return mapped(rows, run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_documents`` reduced in the same pass to (id, n_tokens, ids_sha256, decoded_sha256); null text is empty.

    Words repeat, so each worker keeps the tokens of words seen, up to a fixed
    number of words.
    """
    source = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, by_word = _digester(source.value)
        sha = hashlib.sha256
        for batch in slices(batches, "_t"):
            n, a, b = [], [], []
            for text in batch.column("_t").to_pylist():
                words = list(map(by_word.__getitem__, enc.split(text))) if text else []
                ids = b" ".join([w[0] for w in words])
                n.append(ids.count(b" ") + 1 if ids else 0)
                a.append(sha(ids).hexdigest())
                b.append(sha(b" ".join([w[1] for w in words])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return mapped(rows, run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
