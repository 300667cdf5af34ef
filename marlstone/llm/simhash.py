"""Operator 5, SimHash near-dedup: exact pairs by vantage-point trees; similar shingle sets by prefixes; connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.scale import held, key_filter, mapped, marked, slices, trimmed, without, written
from marlstone.operators.components import components, smallest_ids

#: Rows of one part of a shard; larger shards are dealt to pairs of parts.
PART = 40_000
#: Slices of the 64 bits that trees are grown on; rows that a leaf holds about; fingerprints that trees are grown on at most (about), leaves split further at once, and how often.
SLICES, LEAF_ROWS, SAMPLE, LEAVES, DEPTH = 3, 4_096, 65_536, 1_024, 4
#: Up to so many rows a set is compared directly.
LEAF = 2_048
#: Rows that share a shingle are all compared up to so many; each with so many others beyond that, to begin with.
FEW, BESIDE = 12, 4
#: Rows up to which a table of large shards is broadcast.
MOST_BROADCAST = 50_000
#: Documents drawn to find common shingles, and common shingles kept at most; they only order a set, so neither changes a result.
COMMON_DOCS, COMMON = 5_000, 1 << 16


def shingles(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """The hash of every run of ``words`` words of a text in UTF-8, in order; of the whole text if it has fewer words."""
    units = text.lower().split()  # bytes: only A-Z change, and white space is \x20 and \x09-\x0D
    if not units:
        return np.zeros(0, np.uint64)
    if len(units) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(units), seed)], np.uint64)
    flat = b" ".join(units)
    ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(units) - words + 1
    return np.fromiter([digest(flat[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())], np.uint64, n)


def shingle_bits(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text in UTF-8: bit i is 1 if more than half of its shingles' hashes have it, repeats counted."""
    h = shingles(text, words, seed)
    return int(h[0]) if len(h) == 1 else majority(h)


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half of ``h`` have."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * x > len(h) else "0" for x in total), 2)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """One row (id, fp long) for each row: 64 bits as a signed number; null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            found = np.array([shingle_bits(t, words) if t else 0 for t in batch.column("_t").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found.view(np.int64))], [id_col, "fp"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t"))
    return mapped(rows, run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, fp long")


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints."""
    return np.bitwise_count(x ^ y).astype(np.int64)


class Forest:
    """Union-find over positions; ``edges`` are the unions that joined two trees, at most n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        p, q = self.root(a), self.root(b)
        if p != q:
            self.up[max(p, q)] = min(p, q)
            self.edges.append((a, b))


def link(fps: np.ndarray, radius: int, forest: Forest, left: np.ndarray, right: np.ndarray | None = None) -> None:
    """Join all positions in ``left`` (or of ``left`` with ``right``) whose fingerprints differ in ``radius`` bits at most.

    Within a task the tree is grown on: a vantage point splits a set at the
    median shell, and beside the halves themselves only the shells at the
    border are compared across it, down to ``LEAF`` rows.
    """
    work = [(left, right)]
    while work:
        a, b = work.pop()
        if not len(a) or b is not None and not len(b):
            continue
        split = None
        if len(a) * len(a if b is None else b) > LEAF * LEAF:
            from_ = a if b is None or len(a) >= len(b) else b
            at = int(from_[len(from_) // 2])
            da = apart(fps[a], fps[at])
            db = da if b is None else apart(fps[b], fps[at])
            d = da if from_ is a else db
            if b is None:  # all within the radius of the vantage point hang together
                for x in a[da <= radius].tolist():
                    forest.join(at, x)
            shell = int(np.median(d))
            if (d > shell).any():
                split = shell
            elif d.min() < shell:
                split = shell - 1
        if split is None:
            compare(fps, radius, forest, a, b)
            continue
        if b is None:
            work += [(a[da <= split], None), (a[da > split], None), (a[(da <= split) & (da > split - radius)], a[(da > split) & (da <= split + radius)])]
        else:
            border_a, border_b = (da > split - radius) & (da <= split + radius), (db > split - radius) & (db <= split + radius)
            work += [(a[da <= split], b[db <= split]), (a[da > split], b[db > split])]
            work += [(a[(da <= split) & border_a], b[(db > split) & border_b]), (a[(da > split) & border_a], b[(db <= split) & border_b])]


def compare(fps: np.ndarray, radius: int, forest: Forest, a: np.ndarray, b: np.ndarray | None) -> None:
    """Join within ``a``, or across ``a`` and ``b``, by direct comparison, in blocks that grow; what hangs together already isn't listed again."""
    own = b is None
    b = a if own else b
    at, step, most = 0, 1, max(1, (1 << 18) // max(1, len(b)))
    while at < len(a):
        rows = a[at : at + step]
        columns = b[at:] if own else b
        i, j = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[columns][None, :]) <= radius)
        if len(i) > 256:
            u, v = (np.array([forest.root(x) for x in y.tolist()]) for y in (rows, columns))
            new = u[i] != v[j]
            i, j = i[new], j[new]
        for x, y in zip(rows[i].tolist(), columns[j].tolist(), strict=True):
            if x != y:
                forest.join(x, y)
        at += step
        step = min(2 * step, most)


#: What a row is in its shard: a home, a home of another part, a guest, a home that meets guests only.
HOME, OTHER, GUEST, HOST = range(4)


def links_of_shard(fps: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the shard connects: homes with each other and with guests, or homes with those of another part."""
    forest = Forest(len(fps))
    home, other, guest = (np.flatnonzero(side == k) for k in (HOME, OTHER, GUEST))
    if len(other):
        link(fps, radius, forest, home, other)
    else:
        link(fps, radius, forest, home)
        link(fps, radius, forest, np.flatnonzero((side == HOME) | (side == HOST)), guest)
    return forest.edges


@dataclass
class Trees:
    """Vantage-point trees. Node k deals rows by their distance to ``vantage[k]`` on the bits ``mask[k]``: up to ``split[k]`` to ``inner[k]``, else to ``outer[k]``. Leaves have an inner node of -1; ``root`` is by the number of the set of rows that a tree deals."""

    radius: int
    first: int
    root: dict[int, int]
    mask: np.ndarray
    vantage: np.ndarray
    split: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    def deal(self, fps: np.ndarray, place: np.ndarray, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, guest) for every leaf that a row reaches. Rows of a place without a tree stay there.

        A home goes to its own side. By the triangle inequality, rows within
        ``radius`` of each other have distances to the vantage point within
        ``radius``: so an inner home near the border is a guest of the outer
        side too, a guest goes to each side that may have homes within its
        radius, and every other branch is pruned. Two close rows meet in a
        leaf in which one of them at least is at home.
        """
        node = np.array([self.root.get(p, -1) for p in np.unique(place).tolist()], np.int64)[np.unique(place, return_inverse=True)[1]] if len(place) else place
        rows = np.arange(len(fps))
        out = [(rows[node < 0], place[node < 0], guest[node < 0])]
        rows, guest, node = rows[node >= 0], guest[node >= 0], node[node >= 0]
        while len(rows):
            leaf = self.inner[node] < 0
            out.append((rows[leaf], self.first + node[leaf], guest[leaf]))
            rows, guest, node = rows[~leaf], guest[~leaf], node[~leaf]
            d = np.bitwise_count((fps[rows] ^ self.vantage[node]) & self.mask[node]).astype(np.int64)
            split = self.split[node]
            near = d <= split
            into, beyond = near | guest & (d <= split + self.radius), ~near | (d > split - self.radius)
            rows, guest, node = np.concatenate((rows[into], rows[beyond])), np.concatenate((guest[into], (guest | near)[beyond])), np.concatenate((self.inner[node[into]], self.outer[node[beyond]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def grow(samples: dict[int, tuple[np.ndarray, int, float]], radius: int, first: int, leaf_rows: int) -> Trees:
    """Trees for the sets by number: (fingerprints drawn, bits to look at, rows that one of them stands for).

    A node tries a few of its own fingerprints as vantage points and all
    shells, and takes the one that tells most for the rows at its border.
    """
    root, nodes = {}, []
    for place, (fps, mask, share) in sorted(samples.items()):
        root[place] = len(nodes)
        nodes.append([mask, 0, 0, -1, -1])
        work = [(fps & np.uint64(mask), len(nodes) - 1)]
        while work:
            x, k = work.pop()
            if len(x) * share <= leaf_rows or len(x) < 8:
                continue
            best = (0.0, 0, 0)
            for v in x[np.linspace(0, len(x) - 1, 6).astype(int)].tolist():
                n = np.bincount(np.bitwise_count(x ^ np.uint64(v)), minlength=65) / len(x)
                inside = np.cumsum(n)
                border = np.array([n[max(0, s - radius + 1) : s + radius + 1].sum() if radius else 0.0 for s in range(65)])
                told = -inside * np.log2(inside + 1e-12) - (1 - inside) * np.log2(1 - inside + 1e-12)
                worth = np.where((inside > 0.02) & (inside < 0.98), told / (0.1 + border), 0)
                s = int(worth.argmax())
                best = max(best, (float(worth[s]), s, v))
            if not best[0]:
                continue
            _, s, v = best
            near = np.bitwise_count(x ^ np.uint64(v)) <= s
            nodes[k][1:] = v, s, len(nodes), len(nodes) + 1
            for part in (x[near], x[~near]):
                nodes.append([mask, 0, 0, -1, -1])
                work.append((part, len(nodes) - 1))
    columns = list(zip(*nodes, strict=True))
    return Trees(radius, first, root, *(np.array(c, np.uint64) for c in columns[:2]), *(np.array(c, np.int64) for c in columns[2:]))


def slice_masks(slices_: int) -> list[int]:
    """The bits of each of so many slices of 64."""
    cuts = [64 * k // slices_ for k in range(slices_ + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def drawn(rows: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Some ``SAMPLE`` of the rows' fingerprints by place, chosen by hash: what trees are grown on, whatever the size."""
    share = int(min(1.0, SAMPLE / max(1, total)) * 1_000_000_000)
    found = rows.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000_000)) < share).select("place", "fp").toPandas().sort_values(["place", "fp"])
    return {int(p): x["fp"].to_numpy(np.int64).view(np.uint64) for p, x in found.groupby("place")}


def dealt(rows: DataFrame, trees: Trees) -> DataFrame:
    """Rows (fp, id, place, guest) moved to the leaves of ``trees``, which are broadcast: their size has a bound."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, id_, place = (batch.column(c).to_numpy() for c in ("fp", "id", "place"))
            row, place, guest = shared.value.deal(fp.view(np.uint64), place, batch.column("guest").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(id_[row]), pa.array(place), pa.array(guest)], ["fp", "id", "place", "guest"])

    return mapped(rows, run, "fp long, id long, place long, guest boolean")


def in_leaves(classes: DataFrame, radius: int, slices_: int, part: int, leaf_rows: int) -> DataFrame:
    """``classes`` (fp, id) as rows (fp, id, place, guest) for every leaf of the slices' trees that they reach.

    Trees are grown on a bounded sample. Leaves that then hold over ``part``
    homes are dealt on by trees of their own, grown on a sample of their rows,
    until none does or no vantage point splits them.
    """
    masks, first = dict(enumerate(slice_masks(slices_))), slices_
    total = classes.count()
    rows = classes.select("fp", "id", F.lit(0).cast("long").alias("place"), F.lit(False).alias("guest"))
    one = drawn(rows, total).get(0, np.zeros(0, np.uint64))
    share = total / max(1, len(one))
    trees = grow({k: (one, m, share) for k, m in masks.items()}, radius // slices_, first, leaf_rows)
    rows = classes.select("fp", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices_ - 1).cast("long"))).alias("place"), F.lit(False).alias("guest"))
    bits: dict[int, int] = {}
    for _ in range(DEPTH):
        bits |= {trees.first + k: int(m) for k, m in enumerate(trees.mask.tolist())}
        rows, first = dealt(rows, trees), trees.first + len(trees.mask)
        full = {r["place"]: r["n"] for r in rows.where("not guest").groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).orderBy(F.desc("n")).limit(LEAVES).collect()}
        if not full:
            break
        of_these = rows.where("not guest").join(F.broadcast(rows.sparkSession.createDataFrame([(p,) for p in full], "place long")), "place")
        samples = {p: (x, bits[p], full[p] / len(x)) for p, x in drawn(of_these, sum(full.values())).items()}
        trees = grow(samples, radius // slices_, first, leaf_rows) if samples else trees
        if not samples or (trees.inner < 0).all():
            break
    return rows


def near_links(classes: DataFrame, radius: int = 4, part: int = PART, slices_: int = SLICES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Links (a, b) of ids in ``classes`` (fp, id), distinct fingerprints, that connect pairs within ``radius``, exactly.

    The 64 bits are cut into ``slices_``; two fingerprints within ``radius``
    are within ``radius // slices_`` in one slice at least. Each slice has
    vantage-point trees by Hamming distance on its bits, and every row goes to
    its leaf and, by triangle bounds, as a guest to the leaves across a border
    near it. A shard is a leaf: its homes are compared with each other and with
    its guests on all bits, and it returns a spanning forest, at most one link
    a row, never all pairs. With one slice the tree works on all 64 bits, but
    on unlike texts a radius of 4 spans most of a tree's shells.

    A leaf of more than ``part`` rows that no vantage point splits is cut into
    parts by hash; each pair of parts is a shard of its own, so no task holds
    more than two parts. The table of such leaves is broadcast only if it is small.
    """
    rows = in_leaves(classes, radius, slices_, part, leaf_rows)
    n = rows.groupBy("place").agg(F.count(F.when(~F.col("guest"), 1)).alias("homes"), F.count(F.when(F.col("guest"), 1)).alias("guests"))
    large = n.where((F.col("homes") > part) | (F.col("guests") > part)).select("place", *(F.greatest(F.lit(1), F.ceil(F.col(c) / (part / 2))).cast("int").alias(k) for c, k in (("homes", "p"), ("guests", "g"))))
    large = written(large, "large")
    if large.count() <= MOST_BROADCAST:
        large = F.broadcast(large)
    rows = rows.join(large, "place", "left").withColumn("at", F.pmod(F.xxhash64("id", "place"), F.when(F.col("guest"), F.col("g")).otherwise(F.col("p"))).cast("int"))
    # part k of p homes meets itself (shard k, k), every other part (shards k, j and j, k) and each part of the guests (shards k, p + y)
    deal = F.expr(f"""case when p is null then array(named_struct('i', 0, 'j', 0, 'side', if(guest, {GUEST}, {HOME})))
        when guest then transform(sequence(0, p - 1), x -> named_struct('i', x, 'j', p + at, 'side', {GUEST}))
        else concat(transform(sequence(0, p - 1), x -> named_struct('i', least(x, at), 'j', greatest(x, at), 'side', if(at > x, {OTHER}, {HOME}))),
                    transform(sequence(0, g - 1), y -> named_struct('i', at, 'j', p + y, 'side', {HOST}))) end""")
    rows = rows.select("fp", "id", "place", F.explode(deal).alias("s")).select("fp", "id", "place", "s.i", "s.j", F.col("s.side").cast("byte").alias("side"))
    rows = rows.repartition("place", "i", "j").sortWithinPartitions("place", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in grouped(batches, ["place", "i", "j"]):
            id_ = x.column("id").to_numpy()
            if found := links_of_shard(x.column("fp").to_numpy().view(np.uint64), x.column("side").to_numpy(), radius):
                both = id_[np.array(found)]
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return mapped(rows, run, "a long, b long")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with the same integer ``keys``, which follow each other."""
    group: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if group and (k[lo] != last).any():
                yield pa.Table.from_batches(group).combine_chunks()
                group = []
            group.append(batch.slice(lo, hi - lo))
            last = k[lo]
    if group:
        yield pa.Table.from_batches(group).combine_chunks()
    group.clear()
    trimmed()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, part: int = PART) -> DataFrame:
    """One row (id, fingerprint, component_id) for each row; ids are integers.

    Texts whose fingerprints are the same are one class and never compared.
    Classes within ``radius`` bits are linked, all of them and exactly, and
    ``component_id`` is the smallest id that is reached. Null, empty and
    wordless texts have the fingerprint zero and are linked like any other.
    Rows with a null id keep their fingerprint; a class of null ids only has a
    null component and links nothing. Repeated rows are given each, and so are
    different texts under one id, which aren't linked by that. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = written(fingerprints(docs, id_col, text_col, words).select(F.col(id_col).cast("long").alias("_id"), "fp"), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("_id").alias("low")), "classes")
    links = near_links(classes.where("low is not null").select("fp", F.col("fp").alias("id")), radius, part)
    named = written(smallest_ids(classes.select(F.col("fp").alias("key"), "low"), links), "named")
    return rows.join(named, F.col("fp") == F.col("key")).select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def common_shingles(docs: DataFrame, id_col: str, text_col: str, words: int) -> np.ndarray:
    """Shingles that three or more of some ``COMMON_DOCS`` documents have, the rarer first, ``COMMON`` at most."""
    share = int(min(1.0, COMMON_DOCS / max(1, docs.count())) * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            found = [np.unique(shingles(t, words)) for t in batch.column("_t").to_pylist() if t]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    rows = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share).select(F.col(text_col).cast("binary").alias("_t"))
    found = mapped(rows, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON)
    return np.array([r["h"] for r in found.collect()][::-1], np.int64).view(np.uint64)


def parity_sketch(h: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, modulo a power of two of 64 or more and no less than their number: 1 if it is met an odd number of times."""
    bits = max(64, 1 << (max(1, len(h)) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Members that two sets with these sketches don't share, at least: each bit that differs needs one. The longer sketch is folded to the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(a), len(b))
    return int(np.bitwise_count(np.bitwise_xor.reduce(a.reshape(-1, n)) ^ np.bitwise_xor.reduce(b.reshape(-1, n))).sum(dtype=np.int64))


#: Bytes of a sketch that goes into a bucket's shard, so that a shard of long texts stays small.
SHORT = 1_024


def short_sketches(classes: DataFrame) -> DataFrame:
    """(id, sketch) of ``classes`` (id, sketch), folded to ``SHORT`` bytes where they are longer; they then tell fewer pairs apart and still lose none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "sketch"):
            cut = [x if len(x) <= SHORT else np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, SHORT)).tobytes() for x in batch.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cut, pa.binary())], ["id", "sketch"])

    return mapped(classes.select("id", "sketch"), run, "id long, sketch binary")


def folded(sketches: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The sketches' lengths, and by each length that occurs a matrix of all longer ones folded to it; rows of shorter ones are zero there."""
    sizes = np.array([len(x) for x in sketches], np.int64)
    out = {}
    for n in np.unique(sizes).tolist():
        out[n] = np.zeros((len(sketches), n), np.uint8)
        for k in np.flatnonzero(sizes >= n):
            out[n][k] = np.bitwise_xor.reduce(np.frombuffer(sketches[k], np.uint8).reshape(-1, n))
    return sizes, out


def least_differences(sizes: np.ndarray, by_size: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``least_difference`` of the pairs (i, j) of ``folded`` sketches, some megabytes at a time."""
    out, short = np.zeros(len(i), np.int64), np.minimum(sizes[i], sizes[j])
    for n, m in by_size.items():
        pairs = np.flatnonzero(short == n)
        step = max(1, (4 << 20) // n)
        for at in range(0, len(pairs), step):
            some = pairs[at : at + step]
            out[some] = np.bitwise_count(m[i[some]] ^ m[j[some]]).sum(1, dtype=np.int64)
    return out


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, common: np.ndarray) -> DataFrame:
    """Rows (_id, _x, fp, fp1, n, sketch, simhash, prefix): the text's hash, digest, size, sketch and SimHash of its shingle set and the first shingles of it.

    All sets are in one order: by hash, ``common`` ones last. Two sets of
    Jaccard ``similarity`` or more share a shingle of their prefixes, since
    each holds at least n * similarity shingles of the other.
    """
    by_hash = np.argsort(common)
    known = common[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("shingles",), lambda: None)  # what a stage before this one held in the worker goes
        for batch in slices(batches, "_t"):
            digests, sizes, sketches, votes, first = [], [], [], [], []
            for text in batch.column("_t").to_pylist():
                h = np.unique(shingles(text or b"", words))
                votes.append(majority(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                sizes.append(len(h))
                sketches.append(parity_sketch(h))
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, by_hash[at] + 1, 0), kind="stable")]
                first.append(h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].view(np.int64))
            fp = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in first])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(first) if first else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_x"), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(np.array(votes, np.uint64).view(np.int64)), lists], ["_id", "_x", "fp", "fp1", "n", "sketch", "simhash", "prefix"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_t")).withColumn("_x", F.xxhash64("_t"))
    return mapped(rows, run, "_id long, _x long, fp long, fp1 long, n long, sketch binary, simhash long, prefix array<long>")


def may_be_similar(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles whose first shared one is at ``p`` and ``q`` can be similar. Later shared ones may say no."""
    return np.minimum(n - p, m - q) >= similarity / (1 + similarity) * (n + m) - 1e-6


def close_pairs(points: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ids in ``points`` (h, n, id, pos, hot) that share h and can be similar: all of them in a small bucket, and of each row of a hot one ``BESIDE`` others of about its size, others in each bucket."""
    rows = points.select("h", "n", "id", "pos", F.col("hot").cast("long").alias("hot"), F.floor(F.log2("n") * 4).alias("size"), F.xxhash64("id", "h").alias("any"))
    rows = rows.repartition("h").sortWithinPartitions("h", "size", "any").select("h", "n", "id", "pos", "hot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((0, 5), np.int64)
        for batch in batches:
            x = np.concatenate([tail, np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
            out = []
            for step in range(1, FEW):
                a, b = x[:-step], x[step:]
                new = max(0, len(tail) - step)  # pairs within the tail were given before
                a, b = a[new:], b[new:]
                hit = (a[:, 0] == b[:, 0]) & ((a[:, 4] == 0) | (step <= BESIDE))
                a, b = a[hit], b[hit]
                hit = may_be_similar(a[:, 1], a[:, 3], b[:, 1], b[:, 3], similarity)
                out.append(np.stack([a[hit, 2], b[hit, 2]], axis=1))
            tail = x[-FEW:].copy()
            both = np.sort(np.concatenate(out), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])
        trimmed()

    return mapped(rows, run, "a long, b long").where("a <> b").distinct()


def possible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, d) whose sketches in ``classes`` (id, n, sketch) don't rule out ``similarity``; no similar pair is lost. d: the share of members that surely differ, in millionths."""
    left, right = (classes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.maximum(1, batch.column("na").to_numpy() + batch.column("nb").to_numpy())
            found = np.array([least_difference(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)], np.int64)
            hit = found <= (1 - similarity) / (1 + similarity) * n + 1e-6
            d = pa.array((found[hit] * 1_000_000 // n[hit]).astype(np.int32))
            kept = batch.filter(pa.array(hit, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b"), d], ["a", "b", "d"])
        trimmed()

    return mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb"), run, "a long, b long, d int")


def sets_of(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, _s) of ``classes`` (id, _id, _x): the sorted shingle hashes of the text with this id and hash; written."""
    wanted = written(classes.select("id", "_id", "_x"), "wanted")
    known = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_t")).withColumn("_x", F.xxhash64("_t"))
    known = marked(known, key_filter(wanted, F.struct("_id", "_x")), F.struct("_id", "_x"), "_maybe").where("_maybe").drop("_maybe").join(wanted, ["_id", "_x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([np.unique(shingles(t or b"", words)).tobytes() for t in batch.column("_t").to_pylist()], pa.binary())], ["id", "_s"])

    return written(mapped(known.select("id", "_t"), run, "id long, _s binary"), "sets")


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Members that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard of two sorted sets is ``similarity`` or more."""
    both = overlap(x, y)
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), of ids, whose ``sets`` (id, _s) have Jaccard ``similarity`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_s"):
            hit = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in zip(batch.column("_s"), batch.column("_r"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    rows = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), "_s"), "a").join(sets.select(F.col("id").alias("b"), F.col("_s").alias("_r")), "b")
    return mapped(rows.select("a", "b", "_s", "_r"), run, "a long, b long")


def apart_in_buckets(points: DataFrame, sketches: DataFrame, similarity: float, part: int) -> DataFrame:
    """Pairs (a, b) of ``points`` (h, n, id, pos, c) of one bucket and different components c that can be similar by sizes, places and ``sketches`` (id, sketch).

    Sketches are compared where the rows of a bucket meet, so rows that share
    a passage but little else are never given as pairs. Only buckets that hold several components are looked at, so what hangs
    together already gives no pairs, however large the group. A bucket of more
    than ``part`` rows is cut into parts, and each pair of parts is a shard.
    """
    mixed = points.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")).where("lo < hi").select("h", "parts")
    mixed = written(mixed, "mixed")
    if mixed.count() <= MOST_BROADCAST:
        mixed = F.broadcast(mixed)
    rows = points.join(mixed, "h").join(sketches, "id").withColumn("at", F.pmod(F.xxhash64("id", "h"), F.col("parts")).cast("int"))
    deal = F.expr("transform(sequence(0, parts - 1), x -> named_struct('i', least(x, at), 'j', greatest(x, at), 'side', if(at > x, 1, 0)))")
    rows = rows.select("h", "n", "id", "pos", "c", "sketch", F.explode(deal).alias("s")).select("h", "s.i", "s.j", "n", "s.side", "id", "pos", "c", "sketch")
    rows = rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in grouped(batches, ["h", "i", "j"]):
            n, side, id_, pos, c = (x.column(k).to_numpy().astype(np.int64) for k in ("n", "side", "id", "pos", "c"))
            across = bool((side != side[0]).any())
            sizes, by_size = folded(x.column("sketch").to_pylist())
            step = max(1, (1 << 18) // len(n))
            for at in range(0, len(n), step):
                rows = np.arange(at, min(at + step, len(n)))
                to = int(np.searchsorted(n, n[rows[-1]] / similarity + 1e-6, "right"))
                hit = (c[rows][:, None] != c[at:to]) & (np.arange(at, to) > rows[:, None]) & may_be_similar(n[rows][:, None], pos[rows][:, None], n[at:to], pos[at:to], similarity)
                if across:
                    hit &= side[rows][:, None] != side[at:to]
                i, j = (k + at for k in np.nonzero(hit))
                near = least_differences(sizes, by_size, i, j) <= (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + 1e-6
                if near.any():
                    both = np.sort(np.stack([id_[i[near]], id_[j[near]]], axis=1), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return mapped(rows, run, "a long, b long").distinct()


def simhash_pairs(classes: DataFrame, radius: int, part: int) -> DataFrame:
    """Pairs (a, b) of ids in ``classes`` (id, simhash) that connect fingerprints within ``radius`` bits; zero is linked like any other."""
    known = written(classes.select("id", "simhash"), "known")
    prints = written(known.groupBy("simhash").agg(F.min("id").alias("id")), "prints")
    links = near_links(prints.select(F.col("simhash").alias("fp"), "id"), radius, part)
    same = known.join(prints.select("simhash", F.col("id").alias("a")), "simhash").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"))
    return same.unionByName(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


#: Partners by sketch that a row is checked with first.
FIRST = 3


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, part: int = PART, keyed: bool = False, radius: int = 4) -> DataFrame:
    """One row (id, component_id[, _x]) for each row: texts whose shingle sets overlap by ``similarity`` (Jaccard) or more hang together, and no others.

    Equal sets are one class. Classes whose SimHashes lie within ``radius``
    bits, found by vantage-point trees as in ``near_dedup``, are checked on the
    whole sets. SimHash alone would miss similar sets that lie further apart,
    so prefixes follow. Similar sets share a shingle of their prefixes
    (``shingle_sets``), so rows meet in buckets by these. Of the pairs that can
    be similar by sizes, places and sketches, each row's best few are checked on
    the whole sets first. Then the pairs that these links left in different
    components are checked: those of small buckets, and those of hot ones (over
    ``FEW`` rows), which give no others, so a group of K copies doesn't cost
    K^2 pairs. Nulls, empty texts, repeated rows and other columns: as for
    ``near_dedup``. ``keyed`` adds the text's hash.
    """
    rows = written(shingle_sets(docs, id_col, text_col, words, similarity, common_shingles(docs, id_col, text_col, words)), "shingles")
    one = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_x"))).alias("one")
    classes = rows.groupBy("fp", "fp1").agg(one, F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("simhash").alias("simhash"), F.first("prefix").alias("prefix"))
    classes = written(classes.select("fp", "fp1", "one.*", "n", "sketch", "simhash", "prefix", F.monotonically_increasing_id().alias("id")), "classes")
    known = classes.where("_id is not null")
    points = known.select("id", "n", F.posexplode("prefix").alias("pos", "h"))
    hot = written(points.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > FEW).select("h", F.lit(True).alias("hot")), "hot")
    some = hot.count()
    points = points.join(F.broadcast(hot) if some <= MOST_BROADCAST else hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    close = written(possible(close_pairs(points, similarity), known, similarity), "pairs")
    best = written(close.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("d", "a"))).where(F.col("r") <= FIRST).select("a", "b").unionByName(simhash_pairs(known, radius, part)).distinct(), "best")
    ids = best.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets_of(known.join(ids, "id", "left_semi"), docs, id_col, text_col, words)
    links = written(verified(best, sets, similarity), "similar")
    now = written(components(links), "components").select("id", F.col("component").alias("c"))
    component = lambda pairs: pairs.join(now.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a", "left").join(now.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    rest = component(close)
    if some:
        labelled = written(points.where("hot").join(now, "id", "left").select("h", "n", "id", "pos", F.coalesce("c", "id").alias("c")), "points")
        rest = rest.unionByName(apart_in_buckets(labelled, short_sketches(known), similarity, part)).distinct()
    rest = written(rest, "pairs")
    ids = rest.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets_of(known.join(ids, "id", "left_semi"), docs, id_col, text_col, words)
    links = links.unionByName(written(verified(rest, sets, similarity), "similar"))
    named = written(smallest_ids(classes.select(F.col("id").alias("key"), F.col("_id").alias("low")), links), "named")
    named = classes.join(named, F.col("id") == F.col("key")).select(F.col("fp").alias("_f"), F.col("fp1").alias("_g"), "component_id")
    out = rows.join(written(named, "named"), (F.col("fp") == F.col("_f")) & (F.col("fp1") == F.col("_g"))).select(F.col("_id").alias(id_col), "component_id", "_x")
    return out if keyed else out.drop("_x")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with its own columns; of texts that are similar, the row with the smallest id stays.

    Rows with null ids stay. Decided row by row: of two texts under one id only
    the similar one goes. Rows that repeat id and text go or stay together. An
    empty table gives an empty one.
    """
    gone = similar_dedup(docs, id_col, text_col, words, similarity, keyed=True).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col), "_x")
    return without(docs, written(gone, "near"), id_col, {"_x": F.xxhash64(F.col(text_col).cast("binary"))})
