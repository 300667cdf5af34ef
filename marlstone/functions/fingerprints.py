"""Fingerprints of records: SimHash of text, values and page shape, MinHash of values. numpy, used inside Arrow UDFs."""

from __future__ import annotations

import re

import numpy as np

# FNV-1a's start and prime, and splitmix64's shifts and multipliers, which make stored fingerprints comparable.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None))
GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
SPLIT = re.compile(r"[\W_]+")


def mixed(h: int) -> int:
    for shift, factor in MIX:
        h ^= h >> shift
        if factor:
            h = h * factor & MASK
    return h


_cache: dict[str, int] = {}


def token_hash(token: str) -> int:
    """64-bit hash of a token; the last ones are kept."""
    found = _cache.get(token)
    if found is None:
        h = FNV_START
        for b in token.encode():
            h = (h ^ b) * FNV_PRIME & MASK
        if len(_cache) > 200_000:
            _cache.clear()
        found = _cache[token] = mixed(h)
    return found


def tokens(text: str) -> list[str]:
    """Runs of letters and digits of two bytes or more, in lower case."""
    return [t.lower() for t in SPLIT.split(text) if len(t) > 1 or len(t.encode()) >= 2]


def vote(hashes: list[int]) -> int:
    """Bits that more than half of the hashes have; 0 without any."""
    if not hashes:
        return 0
    x = np.array(hashes, np.uint64)
    ones = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * k > len(x) else "0" for k in ones), 2)


def simhash(text: str | None) -> int:
    """SimHash of a text's tokens."""
    return vote([token_hash(t) for t in tokens(text or "")])


#: Latin-1 bytes in lower case, or a blank where ``SPLIT`` cuts.
_LATIN = bytes(32 if SPLIT.fullmatch(chr(c)) else ord(chr(c).lower()) for c in range(256))
#: Bytes of text whose tokens are hashed together.
_TOGETHER = 1 << 20


def _blanked(text: str) -> bytes:
    """The text's tokens in lower case as UTF-8, with blanks between them."""
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").encode()
    except UnicodeEncodeError:
        return SPLIT.sub(" ", text).lower().encode()


def simhashes(texts: list[str | None]) -> np.ndarray:
    """``simhash`` of each text, as signed numbers: tokens of many texts are hashed and counted at once in numpy."""
    out, lo = np.zeros(len(texts), np.int64), 0
    while lo < len(texts):
        parts, size, k = [], 0, lo
        while k < len(texts) and (not size or size < _TOGETHER):
            parts.append(_blanked(texts[k] or "") + b" ")
            size += len(parts[-1])
            k += 1
        out[lo:k] = _votes(parts)
        lo = k
    for k, text in enumerate(texts):  # its lower case has a byte only, which would pass for a short token
        if text and "\u212a" in text:
            out[k] = signed(simhash(text))
    return out


def _votes(parts: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(parts), np.uint8)
    edges = np.flatnonzero(np.diff(data != 32, prepend=False))  # each part ends with a blank
    at, sizes = edges[::2], edges[1::2] - edges[::2]
    at, sizes = at[sizes > 1], sizes[sizes > 1]
    order = np.argsort(-sizes, kind="stable")
    first, left, h = at[order], -sizes[order], np.full(len(at), FNV_START, np.uint64)
    for n in range(-int(left[0]) if len(at) else 0):
        k = int(np.searchsorted(left, -n))  # tokens longer than n
        h[:k] = (h[:k] ^ data[first[:k] + n]) * np.uint64(FNV_PRIME)
        if k < 4 and n >= 64:  # few and long: each by itself
            for i in range(k):
                x = int(h[i])
                for b in data[first[i] + n + 1 : first[i] - left[i]].tolist():
                    x = (x ^ b) * FNV_PRIME & MASK
                h[i] = x
            break
    for shift, factor in MIX:
        h ^= h >> np.uint64(shift)
        if factor:
            h *= np.uint64(factor)
    x = np.empty_like(h)
    x[order] = h
    counts = np.diff(np.searchsorted(at, np.cumsum([0, *map(len, parts)])))
    out, some = np.zeros(len(parts), np.uint64), np.flatnonzero(counts)
    ends = np.cumsum(counts[some])
    for lo in range(0, len(some), 64):  # 64 bytes a token
        hi = min(lo + 64, len(some))
        start = ends[lo] - counts[some[lo]]
        bits = np.unpackbits(x[start : ends[hi - 1]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, np.concatenate([[0], ends[lo : hi - 1] - start]), axis=0, dtype=np.int32)
        out[some[lo:hi]] = np.packbits(2 * ones > counts[some[lo:hi], None], axis=1).view(">u8")[:, 0]
    return out.view(np.int64)


def signed(h: int) -> int:
    """As stored: the same 64 bits as a signed number."""
    return h - (1 << 64) if h >> 63 else h


SALTS = np.array([mixed(i + GOLDEN & MASK) for i in range(64)], np.uint64)


def minhash(hashes: list[int]) -> list[int]:
    """The smallest mixed hash under each of 64 salts, as signed numbers; empty without values."""
    if not hashes:
        return []
    x = np.array(hashes, np.uint64)[:, None] ^ SALTS[None]
    with np.errstate(over="ignore"):
        for shift, factor in MIX:
            x ^= x >> np.uint64(shift)
            if factor:
                x *= np.uint64(factor)
    return x.min(axis=0).view(np.int64).tolist()
