"""Operator 1, media columns: local image descriptors find cropped or edited copies."""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.scale import mapped, slices, written
from marlstone.llm.simhash import MOST_BROADCAST, components

#: Corners described in each tile of an image, strongest first over all scales, and a tile's side in pixels: larger images have more corners, and crops keep those of their tiles.
PER_TILE, TILE, SCALES = 10, 48, (1.0, 0.84, 0.71, 0.59, 0.5)
#: Radius of a patch, binary tests, tables of 16 bits each, and bits in which two descriptors may differ: fewer than tables, so that all such pairs meet in one.
PATCH, TESTS, TABLES, NEAR = 9, 128, 8, 7
#: Matches that agree on one turn, scale and shift for two images to be copies; pixels (and share of the distance from the centre) by which a corner may miss its place; side of the cells that tell places apart.
CONSENSUS, MISS, MISS_SHARE, CELL = 5, 3.0, 0.02, 8
#: Matches of two images up to which every pair of them proposes a transform; beyond, each match proposes one by its own angle and scale.
MOST_PAIRS = 96
#: Pixels of images that are described together.
DESCRIBED = 1 << 16
#: Rows of one part of a table bucket.
PART = 40_000
#: Rows that agree in a subtable from which on they are compared in blocks, all pairs, and not neighbour by neighbour.
LONG = 48
#: Rows of whole groups that are worked on at once, if no group is larger.
TOGETHER = 1 << 17


def _subtables(t: int) -> np.ndarray:
    """Masks (two words each) of the subtables of table ``t``.

    The 112 bits beside the table's own are 16 pieces of 7, in four groups of
    four. Of ``NEAR`` or fewer differing bits at most seven pieces differ, so
    nine agree and some group has three that do: the four triples of each group
    hold every pair.
    """
    rest = [16 * c + k for c in range(TABLES) if c != t for k in range(16)]
    out = []
    for g in range(4):
        for left in range(4):
            bits = [b for n in range(4) if n != left for b in rest[4 * g + n :: 16]]
            out.append([sum(1 << 63 - b % 64 for b in bits if b // 64 == word) for word in (0, 1)])
    return np.array(out, np.uint64)


_SUBTABLES = [_subtables(t) for t in range(TABLES)]
_CHUNKS = np.array([[65535 << 16 * (3 - t % 4) if t // 4 == word else 0 for word in (0, 1)] for t in range(TABLES)], np.uint64)

_rng = np.random.default_rng(7)
_POINTS = np.clip(_rng.normal(0, PATCH / 2.2, (TESTS, 2, 2)), -PATCH + 2, PATCH - 2)
_TURNS = 36
_ROTATED = np.stack([np.rint(_POINTS @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])).astype(np.int64) for a in 2 * np.pi * np.arange(_TURNS) / _TURNS])
_DISC = np.array([(y, x) for y in range(-PATCH + 2, PATCH - 1) for x in range(-PATCH + 2, PATCH - 1) if y * y + x * x <= (PATCH - 2) ** 2])


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey levels (rows, columns) of a binary PGM or PPM, or of an 8-bit PNG without interlace; None if it can't be read."""
    if not data:
        return None
    try:
        return _pnm(data) if data[:2] in (b"P5", b"P6") else _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else None
    except (ValueError, IndexError, struct.error, zlib.error):
        return None


def _grey(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) if x.ndim == 2 else x[..., :3].astype(np.float32).mean(axis=2) if x.shape[2] >= 3 else x[..., 0].astype(np.float32)


def _pnm(data: bytes) -> np.ndarray | None:
    head, at = [], 2
    while len(head) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        head.append(int(data[at:end]))
        at = end
    w, h, most = head
    n = 3 if data[:2] == b"P6" else 1
    if most > 255 or len(data) - at - 1 < w * h * n or not w * h:
        return None
    x = np.frombuffer(data, np.uint8, w * h * n, at + 1)
    return _grey(x.reshape(h, w, n) if n == 3 else x.reshape(h, w))


def _png(data: bytes) -> np.ndarray | None:
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 4, 6):
        return None
    w, h, n = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8)[: h * (w * n + 1)].reshape(h, w * n + 1)
    out = np.zeros((h, w, n), np.int64)
    for y in range(h):
        line, up = raw[y, 1:].reshape(w, n).astype(np.int64), out[y - 1] if y else np.zeros((w, n), np.int64)
        kind = raw[y, 0]
        if kind == 1:
            line = np.cumsum(line, axis=0) % 256
        elif kind == 2:
            line = (line + up) % 256
        elif kind in (3, 4):
            left, corner = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x in range(w):
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    a, b, c = abs(p - left), abs(p - up[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[x], corner))
                corner = up[x]
                left = line[x] = (line[x] + guess) % 256
        out[y] = line
    return _grey(out)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over (2r + 1) squares of the last two axes, edges repeated."""
    k, h, w = 2 * r + 1, *x.shape[-2:]
    p = np.concatenate([x[..., :1, :]] * r + [x] + [x[..., -1:, :]] * r, axis=-2)
    s = p[..., :h, :] + p[..., 1 : 1 + h, :]
    for i in range(2, k):
        s += p[..., i : i + h, :]
    p = np.concatenate([s[..., :1]] * r + [s] + [s[..., -1:]] * r, axis=-1)
    s = p[..., :w] + p[..., 1 : 1 + w]
    for i in range(2, k):
        s += p[..., i : i + w]
    s /= k * k
    return s.astype(np.float32, copy=False)


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return x
    high, wide = x.shape[-2:]
    h, w = max(1, round(high * scale)), max(1, round(wide * scale))
    y, z = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y, z = np.clip(y, 0, high - 1), np.clip(z, 0, wide - 1)
    y0, z0 = np.floor(y).astype(int), np.floor(z).astype(int)
    y1, z1 = np.minimum(y0 + 1, high - 1), np.minimum(z0 + 1, wide - 1)
    fy, fz = (y - y0)[:, None], (z - z0)[None, :]
    rows = x.take(y0, -2) * (1 - fy) + x.take(y1, -2) * fy
    return (rows.take(z0, -1) * (1 - fz) + rows.take(z1, -1) * fz).astype(np.float32)


def _strength(smooth: np.ndarray) -> np.ndarray:
    """Corner strength of images from their gradients' second moments."""
    gy, gx = np.gradient(smooth, axis=(-2, -1))
    a, b, c = _box(np.stack([gx * gx, gy * gy, gx * gy]), 2)
    return a * b - c * c - 0.05 * (a + b) ** 2


def _peaks(r: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places (image, y, x) of strengths above 1 and above all eight around, away from the edges."""
    e = PATCH + 1
    sides = np.maximum(r[:, e - 1 : -e + 1, e - 1 : -e - 1], r[:, e - 1 : -e + 1, e + 1 : r.shape[2] - e + 1])
    rows = np.maximum(sides, r[:, e - 1 : -e + 1, e:-e])
    inner = r[:, e:-e, e:-e]
    b, y, z = np.nonzero((inner > np.maximum(np.maximum(rows[:, :-2], rows[:, 2:]), sides[:, 1:-1])) & (inner > 1.0))
    return b, y + e, z + e


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners as rows (x, y, scale, angle) in the image's own pixels from its centre, and their descriptors as rows of two 64-bit words.

    At each scale: corner strength from the gradients' second moments, local
    maxima only; the angle points to the patch's centre of mass, and tests
    compare smoothed grey levels at point pairs turned by that angle.
    """
    return described(image[None])[0]


def described(images: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``describe`` of each of some images of one size."""
    smooth, strength, at = [], [], []
    for k, scale in enumerate(SCALES):
        x = _resized(images, scale)
        smooth.append(_box(x, 1))
        if min(x.shape[1:]) < 2 * PATCH + 3:
            continue
        r = _strength(smooth[k])
        b, y, z = _peaks(r)
        at.append(np.stack([b, np.full(len(y), k), y, z], axis=1))
        strength.append(r[b, y, z])
    if not sum(map(len, strength)):
        return [(np.zeros((0, 4), np.float32), np.zeros((0, 2), np.uint64))] * len(images)
    at, sizes = np.concatenate(at), np.array(SCALES)
    at = at[np.lexsort((at[:, 3], at[:, 2], sizes[at[:, 1]], -np.concatenate(strength), at[:, 0]))]
    tile = (at[:, 2:] / sizes[at[:, 1:2]]).astype(np.int64) // TILE
    order = np.lexsort((tile[:, 1], tile[:, 0], at[:, 0]))
    tile = np.column_stack([at[:, 0], tile])[order]
    first = np.concatenate(([True], (tile[1:] != tile[:-1]).any(axis=1)))
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    at = at[np.sort(order[place < PER_TILE])]
    angles, codes = np.zeros(len(at)), np.zeros((len(at), TESTS // 8), np.uint8)
    for k in np.unique(at[:, 1]):
        rows = np.flatnonzero(at[:, 1] == k)
        flat, (h, w) = smooth[k].ravel(), smooth[k].shape[1:]
        centre = ((at[rows, 0] * h + at[rows, 2]) * w + at[rows, 3])[:, None]
        mass = flat[centre + (_DISC[:, 0] * w + _DISC[:, 1])]
        mass = mass - mass.min(axis=1, keepdims=True)
        angles[rows] = turn = np.arctan2((mass * _DISC[:, 0]).sum(axis=1), (mass * _DISC[:, 1]).sum(axis=1))
        tests = (_ROTATED[..., 1] * w + _ROTATED[..., 0])[np.rint(turn / (2 * np.pi) * _TURNS).astype(np.int64) % _TURNS]
        codes[rows] = np.packbits(flat[centre + tests[:, :, 0]] < flat[centre + tests[:, :, 1]], axis=1)
    scale = sizes[at[:, 1]]
    points = np.stack([at[:, 3] / scale - images.shape[2] / 2, at[:, 2] / scale - images.shape[1] / 2, scale, angles], axis=1).astype(np.float32)
    codes, cuts = codes.view(">u8").astype(np.uint64), np.searchsorted(at[:, 0], np.arange(1, len(images)))
    return list(zip(np.split(points, cuts), np.split(codes, cuts), strict=True))


def packed(points: np.ndarray) -> np.ndarray:
    """A corner's number, place (half pixels), scale (by number) and angle (1/256 turn) in 61 bits, to keep shuffled rows narrow."""
    x, y = (np.clip(np.rint(2 * points[:, k]) + (1 << 16), 0, (1 << 17) - 1).astype(np.int64) for k in (0, 1))
    s, a = np.searchsorted(-np.array(SCALES), -points[:, 2] - 1e-6), np.rint(points[:, 3] / (2 * np.pi) * 256).astype(np.int64) % 256
    return np.minimum(np.arange(len(points)), (1 << 15) - 1) | x << 15 | y << 32 | s << 49 | a << 53


def unpacked(g: np.ndarray) -> dict[str, np.ndarray]:
    """What ``packed`` holds; places as complex numbers x + iy."""
    x, y = (((g >> at & (1 << 17) - 1) - (1 << 16)) / 2 for at in (15, 32))
    return {"k": g & (1 << 15) - 1, "at": x + 1j * y, "s": np.array(SCALES)[g >> 49 & 15], "a": (g >> 53 & 255) * (2 * np.pi / 256)}


def agreeing(u: np.ndarray, v: np.ndarray) -> int:
    """Matches (packed corners of two images) of different corners on both sides that agree on one similarity transform, at most.

    Two matches propose a transform by their places; with many, each match
    proposes one by its angle and scale. A match agrees if its corner falls
    where the transform says and its own turn and scale are about the same.
    """
    p, q = unpacked(u), unpacked(v)
    places = [(np.rint(x["at"].real / CELL) * (1 << 20) + np.rint(x["at"].imag / CELL)).astype(np.int64) for x in (p, q)]  # a corner met at several scales is one
    if min(len({*x.tolist()}) for x in places) < CONSENSUS:
        return 0
    own = p["s"] / q["s"] * np.exp(1j * (q["a"] - p["a"]))  # a larger copy is met at a smaller scale
    if len(u) <= MOST_PAIRS:
        i, j = np.triu_indices(len(u), 1)
        apart = p["at"][j] - p["at"][i]
        i, j, apart = i[k := np.abs(apart) > 4], j[k], apart[k]
        turn = (q["at"][j] - q["at"][i]) / apart
        i, turn = i[k := (np.abs(turn) > 0.3) & (np.abs(turn) < 3.4)], turn[k]
    else:
        i, turn = np.arange(len(u)), own
    most = 0
    room = MISS + MISS_SHARE * np.abs(p["at"])
    for lo in range(0, len(i), max(1, (1 << 18) // len(u))):
        part = slice(lo, lo + max(1, (1 << 18) // len(u)))
        t = turn[part][:, None]
        miss = np.abs(q["at"][i[part]][:, None] + t * (p["at"][None] - p["at"][i[part]][:, None]) - q["at"][None])
        bend = own[None] / t
        hit = (miss <= room * np.maximum(1, np.abs(t))) & (np.abs(np.angle(bend)) < 0.5) & (np.abs(np.log2(np.abs(bend))) < 0.6)
        for row in hit[np.argsort(-hit.sum(axis=1), kind="stable")[:16]]:
            most = max(most, min(len({*x[row].tolist()}) for x in places))
    return most


def descriptors(images: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """Rows (_id, _class binary, _n, _d array<struct<g,d0,d1>>) for every image; _class digests the decoded pixels, or the bytes."""

    kind = pa.struct([(k, pa.int64()) for k in ("g", "d0", "d1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_i"):
            digest, same = [], {}  # different pictures of one size are described together
            for data in batch.column("_i").to_pylist():
                image = decode_image(data)
                if image is None:
                    digest.append(hashlib.blake2b(b"raw" + (data or b""), digest_size=16).digest())
                    continue
                digest.append(hashlib.blake2b(repr(image.shape).encode() + image.tobytes(), digest_size=16).digest())
                same.setdefault(image.shape, {})[digest[-1]] = image
            known = {}
            for (h, w), found in same.items():
                some, step = list(found), max(1, DESCRIBED // (h * w))
                for at in range(0, len(some), step):
                    known |= zip(some[at : at + step], described(np.stack([found[x] for x in some[at : at + step]])), strict=True)
            none = np.zeros((0, 4), np.float32), np.zeros((0, 2), np.uint64)
            parts = [known.get(x, none) for x in digest]
            values = [np.concatenate([packed(x) for x, _ in parts]), *np.concatenate([y for _, y in parts]).view(np.int64).T]
            all_d = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in values], fields=list(kind))
            ends = np.cumsum([0, *(len(x) for x, _ in parts)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), all_d)], ["_id", "_class", "_d"])

    rows = images.select(F.col(id_col).cast("long").alias("_id"), F.col(image_col).alias("_i"))
    return mapped(rows, run, "_id long, _class binary, _d array<struct<g:long,d0:long,d1:long>>")


def image_copies(images: DataFrame, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """One row (id, keypoints, links, class_id) for each image; ids are integers, ``class_id`` the smallest id reached.

    Images of equal pixels are one class, described once a batch and matched
    once. Each class's descriptors go into ``TABLES`` tables by 16 of their bits; in a bucket,
    descriptors of different classes within ``NEAR`` bits match, so no such
    pair is missed. Two classes' matches come together, and they are linked if
    ``CONSENSUS`` of different corners agree on one turn, scale and shift.
    Large buckets are cut into parts and each pair of parts is a task's work of
    bounded size. ``links`` counts the classes that an image's class is linked
    with, and other images of its own class.

    Null, empty and unreadable images have no descriptors: they are classes by
    their bytes and link nothing. Images without corners link only to equal
    ones. Rows with a null id are left out of links and have a null class if no
    other id shares it. Repeated rows count each. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = written(descriptors(images, id_col, image_col), "descriptors")
    classes = rows.groupBy("_class").agg(F.min("_id").alias("c"), F.count(F.lit(1)).alias("n"), F.max("_d").alias("d"))
    points = classes.where("c is not null").select("c", F.explode("d").alias("p")).select("c", "p.*")
    keys = [f"shiftrightunsigned(d{t // 4}, {16 * (3 - t % 4)}) & 65535L | {t}L << 16" for t in range(TABLES)]
    found = matches(points.select("c", "g", "d0", "d1", F.explode(F.array(*map(F.expr, keys))).alias("key")))
    links = written(agreed(found), "copies")
    degree = links.select(F.explode(F.array("u", "v")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("m"))
    found = components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("id").alias("c"), "component")
    named = classes.join(degree, "c", "left").join(found, "c", "left").select(
        F.col("_class").alias("_k"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).cast("long").alias("links"), F.coalesce("component", "c").alias("class_id")
    )
    return rows.join(named, F.col("_class") == F.col("_k")).select(F.col("_id").alias(id_col), F.size("_d").cast("int").alias("keypoints"), "links", "class_id")


def close_pairs(table: int, group: np.ndarray, c: np.ndarray, d0: np.ndarray, d1: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one group and of different ``c`` within ``NEAR`` bits, each once over all tables and subtables.

    Rows of a group agree in the bits of ``table``. In each subtable rows are
    sorted by a hash of the group and the masked bits, and equal neighbours
    compared: the work follows pairs that agree in 37 bits, not the square of a
    bucket. A pair belongs to the first table, and there to the first subtable,
    that holds it. ``side`` is -1 where all pairs count, else pairs of two
    different sides do.
    """
    masks = _SUBTABLES[table]
    low = np.uint64((1 << max(1, (len(c) - 1).bit_length())) - 1)
    number, turned = np.arange(len(c), dtype=np.uint64), group.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    for s, (m0, m1) in enumerate(masks):
        h = (d0 & m0) * np.uint64(0x9E3779B97F4A7C15) + (d1 & m1) * np.uint64(0xC2B2AE3D27D4EB4F) + turned
        h = np.sort(h & ~low | number)  # row numbers in the low bits: numpy sorts numbers faster than it finds their order
        order = (h & low).astype(np.int64)
        x0, x1 = d0[order], d1[order]
        for near, other in _within(h & ~low, x0, x1):
            i, j = order[near], order[other]
            hit = (c[i] != c[j]) & (group[i] == group[j]) & ((side[i] < 0) | (side[i] != side[j]))
            y0, y1 = x0[near] ^ x0[other], x1[near] ^ x1[other]
            hit &= (y0 & m0 | y1 & m1) == 0  # the hash of others may be equal
            for a, b in (*_CHUNKS[:table], *masks[:s]):
                hit &= (y0 & a | y1 & b) != 0
            if hit.any():
                yield i[hit], j[hit]


def _within(h: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (p, q), p < q, of equal sorted hashes whose bits differ in ``NEAR`` at most; some 2^20 pairs of places at a time or fewer."""
    edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    sizes = np.diff(edges)
    found, n = [], 0
    for start, end in zip(edges[:-1][sizes >= LONG].tolist(), edges[1:][sizes >= LONG].tolist(), strict=True):
        for lo in range(start, end, 32):  # rows of a long run against the rows from them on
            y0, y1 = x0[lo : min(lo + 32, end), None], x1[lo : min(lo + 32, end), None]
            for at in range(lo, end, 1024):
                z0, z1 = x0[at : min(at + 1024, end)], x1[at : min(at + 1024, end)]
                hit = np.flatnonzero(np.bitwise_count(y0 ^ z0) + np.bitwise_count(y1 ^ z1) <= NEAR)  # faster than places in two dimensions
                p, q = lo + hit // len(z0), at + hit % len(z0)
                found.append((p[p < q], q[p < q]))
                n += len(hit)
                if n >= 1 << 20:
                    yield tuple(map(np.concatenate, zip(*found, strict=True)))
                    found, n = [], 0
    short = (sizes > 1) & (sizes < LONG)
    at, left = edges[:-1][short], sizes[short] - 1
    near = np.repeat(at - np.concatenate([[0], np.cumsum(left)[:-1]]), left) + np.arange(left.sum()) if len(at) else at
    ends = np.repeat(at + left, left)  # the last place of each one's run
    apart = 1
    while len(near):
        q = near + apart
        hit = np.flatnonzero(np.bitwise_count(x0[near] ^ x0[q]) + np.bitwise_count(x1[near] ^ x1[q]) <= NEAR)
        found.append((near[hit], q[hit]))
        n += len(hit)
        if n >= 1 << 20:
            yield tuple(map(np.concatenate, zip(*found, strict=True)))
            found, n = [], 0
        apart += 1
        more = q < ends
        near, ends = near[more], ends[more]
    if n:
        yield tuple(map(np.concatenate, zip(*found, strict=True)))


def _whole(batches: Iterator[pa.RecordBatch], key: Callable[[pa.Table], np.ndarray]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows, sorted by ``key``, with their bounds: where each group starts, and the number of rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
            if rows < TOGETHER:
                continue
        if rows:
            t = pa.Table.from_batches(held).combine_chunks()
            k = key(t)
            new = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            if batch is None:
                yield t, np.concatenate([[0], new, [rows]])
            elif len(new):
                yield t.slice(0, new[-1]), np.concatenate([[0], new])
                t = t.slice(new[-1])
            held, rows = t.to_batches(), t.num_rows


def matches(points: DataFrame) -> DataFrame:
    """(u, v, gu, gv): classes u < v and their packed corners whose descriptors share a bucket and match, each match once."""
    large = points.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)
    large = written(large.select("key", F.ceil(F.col("n") / (PART / 2)).cast("int").alias("parts")), "large")
    if large.count() <= MOST_BROADCAST:
        large = F.broadcast(large)
    points = points.join(large, "key", "left")
    points = points.withColumn("at", F.pmod(F.xxhash64("c", "g"), F.col("parts")).cast("int"))
    pairs = F.expr("""if(parts is null, array(named_struct('i', 0, 'j', 0, 'side', 0)), transform(sequence(0, parts - 1),
        x -> named_struct('i', least(x, at), 'j', greatest(x, at), 'side', if(at > x, 1, 0))))""")
    points = points.withColumn("p", F.explode(pairs)).select("key", F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.col("p.side").alias("side"), "c", "g", "d0", "d1")
    points = points.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _whole(batches, lambda t: np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)):
            yield from pairs_of(t, bounds)

    def pairs_of(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(bounds)
        rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
        group = np.repeat(np.arange(len(sizes)), sizes)[rows]
        col = {n: t.column(n).to_numpy()[rows] for n in t.column_names}
        for number in np.unique(col["key"] >> 16):
            mine = np.flatnonzero(col["key"] >> 16 == number)
            x = {n: c[mine] for n, c in col.items()}
            for i, j in close_pairs(int(number), group[mine], x["c"], x["d0"].view(np.uint64), x["d1"].view(np.uint64), np.where(x["i"] == x["j"], -1, x["side"])):
                u, v = np.where(x["c"][i] < x["c"][j], i, j), np.where(x["c"][i] < x["c"][j], j, i)
                yield pa.RecordBatch.from_arrays([pa.array(x[c][k]) for c, k in (("c", u), ("c", v), ("g", u), ("g", v))], ["u", "v", "gu", "gv"])

    return mapped(points, run, "u long, v long, gu long, gv long")


def agreed(found: DataFrame) -> DataFrame:
    """(u, v) of the classes whose matches (u, v, gu, gv) agree on a transform."""
    rows = found.repartition("u", "v").sortWithinPartitions("u", "v", "gu", "gv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _whole(batches, lambda t: np.stack([t.column(c).to_numpy() for c in ("u", "v")], axis=1)):
            out, (u, v, gu, gv) = [], (t.column(c).to_numpy() for c in ("u", "v", "gu", "gv"))
            for k in np.flatnonzero(np.diff(bounds) >= CONSENSUS):
                part = slice(bounds[k], bounds[k + 1])
                if agreeing(gu[part], gv[part]) >= CONSENSUS:
                    out.append(bounds[k])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(u[out]), pa.array(v[out])], ["u", "v"])

    return mapped(rows, run, "u long, v long")


#: Waves of drawn pictures have up to this many periods a pixel, down and across, to either side. Longer waves make unlike pictures alike.
STEEP = 0.12


def picture_of(values: np.ndarray, side: int = 96) -> np.ndarray:
    """Plane waves whose directions, lengths, phases and heights are the vector's values, four at a time."""
    z = values / (np.sqrt(np.mean(values**2)) or 1.0)
    u = 1 / (1 + np.exp(-1.7 * np.concatenate([z, np.roll(z, 2)[::-1]])))
    u = np.pad(u, (0, -len(u) % 4), constant_values=0.5).reshape(-1, 4)
    at, high = 2 * np.pi * np.arange(side), (0.3 + u[:, 3])[:, None]
    down, across = np.multiply.outer(2 * STEEP * (u[:, 0] - 0.5), at) + 2 * np.pi * u[:, 2:3], np.multiply.outer(2 * STEEP * (u[:, 1] - 0.5), at)
    x = (high * np.cos(down)).T @ np.cos(across) - (high * np.sin(down)).T @ np.sin(across)  # sums of high * cos(down + across)
    return ((x - x.min()) / ((x.max() - x.min()) or 1) * 255).astype(np.uint8)


def rendered_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, image): each vector drawn as a binary PGM by ``picture_of``; null and empty vectors have a null image, null values count as 0.

    The given tables hold no images; these stand in for them, one for each vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for v in part.column("_v").to_pylist():
                    if not v:
                        out.append(None)
                        continue
                    grey = picture_of(np.nan_to_num(np.array([y or 0.0 for y in v], float)))
                    out.append(b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + grey.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(out, pa.binary())], [id_col, "image"])

    # vectors are small and drawing is much work: rows are spread first
    rows = embeddings.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v")).repartition(4 * embeddings.sparkSession.sparkContext.defaultParallelism)
    return mapped(rows, run, f"`{id_col}` long, image binary")


def _turned(x: np.ndarray, degrees: float) -> np.ndarray:
    """``x`` turned about its centre, edges repeated."""
    h, w = x.shape
    t, (y, z) = np.exp(1j * np.deg2rad(degrees)), np.mgrid[:h, :w]
    at = ((z - (w - 1) / 2) + 1j * (y - (h - 1) / 2)) * t
    y, z = np.clip(at.imag + (h - 1) / 2, 0, h - 1.001), np.clip(at.real + (w - 1) / 2, 0, w - 1.001)
    a, b = y.astype(int), z.astype(int)
    fy, fz = y - a, z - b
    return (x[a, b] * (1 - fz) + x[a, b + 1] * fz) * (1 - fy) + (x[a + 1, b] * (1 - fz) + x[a + 1, b + 1] * fz) * fy


#: Edits of a picture (grey levels; a generator for noise) by name, in the order of their numbers from 1.
EDITS = {
    "crop": lambda x, r: x[x.shape[0] // 10 : -(x.shape[0] // 10), x.shape[1] // 10 : -(x.shape[1] // 10)],
    "corner": lambda x, r: x[: x.shape[0] * 3 // 4, : x.shape[1] * 3 // 4],
    "smaller": lambda x, r: _resized(x, 0.75),
    "larger": lambda x, r: _resized(x, 1.3),
    "noisy": lambda x, r: x + r.normal(0, 3, x.shape),
    "darker": lambda x, r: x * 0.8 + 10,
    "turned": lambda x, r: _turned(x, 10),
}


def edited_copies(pictures: DataFrame, every: int = 100, id_col: str = "vec_id") -> DataFrame:
    """(image_id, image): every picture as 8 * id, and for ids divisible by ``every`` its copies by ``EDITS`` as 8 * id + 1 to 8 * id + 7.

    ``pictures`` has integer ids and images. Null ids and unreadable images have
    no copies; a null id stays null. Noise is drawn from the id, so a rerun gives
    the same bytes. Repeated rows each have their copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_i"):
            yield pa.RecordBatch.from_arrays([batch.column("_of"), batch.column("_i")], ["image_id", "image"])
            chosen = batch.filter(batch.column("_chosen"))  # null ids aren't
            for k, data in zip(chosen.column("_id").to_pylist(), chosen.column("_i").to_pylist(), strict=True):
                x = decode_image(data)
                if x is None:
                    continue
                ids, out = [], []
                for n, edit in enumerate(EDITS.values(), 1):
                    y = np.rint(np.clip(edit(x, np.random.default_rng([abs(k), n])), 0, 255)).astype(np.uint8)
                    ids.append(8 * k + n)
                    out.append(b"P5 %d %d 255\n" % (y.shape[1], y.shape[0]) + y.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["image_id", "image"])

    at = F.col("_id")
    rows = pictures.select(F.col(id_col).cast("long").alias("_id"), F.col("image").alias("_i"))
    return mapped(rows.select("_id", "_i", (at * 8).alias("_of"), (at % every == 0).alias("_chosen")), run, "image_id long, image binary")


def edit_of(image_id: Column) -> Column:
    """The name of the edit in an ``image_id`` of ``edited_copies``; null for the original."""
    return F.element_at(F.array(*map(F.lit, [None, *EDITS])), (image_id.bitwiseAND(7) + 1).cast("int"))
