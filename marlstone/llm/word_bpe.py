"""Pre-tokenising for a lower-casing BPE vocabulary with word ends, as the tokenizers library reads it from its JSON file."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import regex

# Fixed values of the tokenizer file's format: its white space, its contractions and its split pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"
ANY_SCRIPT = regex.compile(rf"\p{{L}}+|{CONTRACTIONS}|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")

#: Below this code point a pattern of plain classes does the same, faster.
LATIN_END = 0x180


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(LATIN_END)) if unicodedata.category(c)[0] == kind)


LATIN = re.compile(rf"[{_class('L')}]+|{CONTRACTIONS}|[{_class('N')}]|[^{SPACE}{_class('L')}{_class('N')}]+")
BEYOND_LATIN = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or 256 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def splitter(specials: list[str]) -> Callable[[str], list[str]]:
    """A function from a text to its pre-tokens; special tokens of the vocabulary come out whole."""
    special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def ordinary(text: str) -> list[str]:
        if BEYOND_LATIN.search(text):
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            return ANY_SCRIPT.findall(text)
        return LATIN.findall(text.lower()) if "İ" not in text else ANY_SCRIPT.findall(text.lower())

    def split(text: str) -> list[str]:
        if special is None or "<|" not in text:
            return ordinary(text)
        out: list[str] = []
        for k, part in enumerate(special.split(text)):
            out += [part] if k % 2 else ordinary(part)
        return out

    return split


class Bounded(dict):
    """Word -> value, made by ``make`` when missing, in bounded memory.

    Two generations of ``most`` words each: when the younger is full it becomes
    the older, whose words come back when they are met again; the others go.
    """

    def __init__(self, make: Callable, most: int = 300_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        """Hold a value; very long words aren't held."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value

    def unseen(self, keys: set) -> list:
        """Those of ``keys`` that neither generation holds."""
        return list(keys.difference(self).difference(self.old))


def vocabulary(source: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Token ids, merges in order, and special tokens of a tokenizer file's JSON text."""
    data = json.loads(source)
    merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in data["model"]["merges"]]
    return data["model"]["vocab"], merges, {x["content"]: x["id"] for x in data["added_tokens"]}
