"""Passes over documents and pages: one Arrow pass parses a page once and returns all that is asked of it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import dom, fingerprints, jsonv, rules
from marlstone.operators.components import smallest_ids
from marlstone.sources.shipping import ship
from marlstone.sources.stored import written


def mapped(df: DataFrame, columns: list[str], out: dict[str, tuple[str, pa.DataType]], keep: list[str], each: Callable[..., tuple]) -> DataFrame:
    """``keep`` columns with what ``each(*columns)`` returns as columns ``out`` (name -> Spark type, Arrow type)."""
    ship(df.sparkSession)
    base = df.select(*keep, *[F.col(c).alias(f"_in{k}") for k, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [each(*r) for r in zip(*(part.column(f"_in{k}").to_pylist() for k in range(len(columns))), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(out.values()))], [*keep, *out])

    schema = ", ".join([f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keep] + [f"`{n}` {t}" for n, (t, _) in out.items()])
    return base.mapInArrow(run, schema)


S, L, I32 = pa.string(), pa.int64(), pa.int32()


def text_simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash) of each text."""
    ship(df.sparkSession)
    base = df.select(key, F.col(text).alias("_in"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(fingerprints.simhashes(part.column("_in").to_pylist()), L)], [key, "simhash"])

    return base.mapInArrow(run, f"`{key}` {base.schema[key].dataType.simpleString()}, simhash long")


def value_simhash(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, simhash) over the strings and numbers of a JSON text; 0 for malformed or null JSON."""

    def one(t):
        v = jsonv.parse(t)
        return (0 if v is jsonv.MISSING else fingerprints.signed(fingerprints.simhash(jsonv.text_of(v))),)

    return mapped(df, [data], {"simhash": ("long", L)}, [key], one)


def minhashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, minhash array) over each text's distinct tokens; empty for texts without tokens."""
    return mapped(df, [text], {"minhash": ("array<long>", pa.list_(L))}, [key], lambda t: (fingerprints.minhash([fingerprints.token_hash(x) for x in set(fingerprints.tokens(t or ""))]),))


def page_facts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, title, text, excerpt, chars, links, text/DOM fingerprints, markdown, heading) from one parse of each page."""
    out = {"title": ("string", S), "text": ("string", S), "excerpt": ("string", S), "chars": ("int", I32), "links": ("array<string>", pa.list_(S)), "text_hash": ("long", L), "dom_hash": ("long", L), "markdown": ("string", S), "heading": ("string", S)}

    def one(u, h):
        root = dom.parse(h)
        text, md = dom.visible_text(root), dom.markdown(root)
        heading = next((x[2:].strip() for x in md.split("\n") if x.startswith("# ")), None)
        shape = fingerprints.vote([fingerprints.token_hash(s) for s in dom.shape(root)])
        return dom.title(root), text, text[:300], len(text), dom.links(root, u), fingerprints.signed(fingerprints.simhash(text)), fingerprints.signed(shape), md, heading

    return mapped(pages, [url, html], out, [key], one)


def extracted(pages: DataFrame, spec: dict[str, dict[str, Any]], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, data JSON, status map, inner map) of a rule set over each document. The rules are compiled once a task."""
    rules.RuleSet(spec)
    inner = pa.map_(S, pa.struct([("items", I32), ("matched", I32)]))
    out = {"data": ("string", S), "status": ("map<string,string>", pa.map_(S, S)), "inner": ("map<string,struct<items:int,matched:int>>", inner)}
    held: list[rules.RuleSet] = []

    def one(u, h):
        if not held:
            held.append(rules.RuleSet(spec))
        values, status, counts = held[0].extract(h, u)
        return jsonv.canonical(values), list(status.items()), list(counts.items())

    return mapped(pages, [url, html], out, [key], one)


def quality_rollup(reports: DataFrame) -> DataFrame:
    """A row a field: how many documents matched, were empty, had an empty container or failed, and the miss rate."""
    rows = reports.select(F.explode("status").alias("field", "s"))
    out = rows.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), *[F.count_if(F.col("s") == k).alias(k) for k in ("matched", "empty", "container_empty", "error")])
    return out.withColumn("misses", F.col("empty") + F.col("error")).withColumn("miss_rate", F.round(F.col("misses") / F.col("docs"), 3))


def link_edges(facts: DataFrame, pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(from_url, to_url, rel), each edge once, URLs canonical."""
    from marlstone.functions.scalars import canonical_url, edge_rel

    rows = facts.select(key, F.explode("links").alias("to")).join(pages.select(key, url), key)
    rows = rows.select(canonical_url(F.col(url)).alias("from_url"), canonical_url(F.col("to")).alias("to_url")).distinct()
    return rows.withColumn("rel", edge_rel(F.col("from_url"), F.col("to_url")))


def near_pairs(hashes: DataFrame, key: str, distance: int, min_band: int = 10) -> DataFrame:
    """(a, b, distance) of keys whose non-zero fingerprints differ in ``distance`` bits at most; a < b.

    Equal fingerprints are one class before the join, so a hot group costs a
    row; their members are linked to the class's smallest key (distance 0), not
    to each other. Classes meet by bands: ``distance + 1`` of them, of which two
    close fingerprints share one whole. Bands narrower than ``min_band`` bits
    would join too much; then the join goes by twice as many bits in pairs of
    bands, which two close fingerprints also share.
    """
    h = written(hashes.where("simhash <> 0"), "prints")  # read by each side of the joins
    classes = written(h.groupBy("simhash").agg(F.min(key).alias("rep")), "classes")
    same = h.join(classes, "simhash").where(F.col(key) != F.col("rep")).select(F.col("rep").alias("a"), F.col(key).alias("b"), F.lit(0).alias("distance"))
    bands = distance + 1
    pick = 1
    if 64 // bands < min_band:
        bands, pick = distance + 2, 2
    cuts = [64 * k // bands for k in range(bands + 1)]
    part = [f"(shiftrightunsigned(simhash, {lo}) & {(1 << hi - lo) - 1 if hi - lo < 64 else -1}L)" for lo, hi in zip(cuts, cuts[1:], strict=False)]
    groups = [(k,) for k in range(bands)] if pick == 1 else [(i, j) for i in range(bands) for j in range(i + 1, bands)]
    keys = F.array(*[F.struct(F.lit(n).alias("t"), F.expr(part[g[0]]).alias("x"), (F.expr(part[g[1]]) if pick == 2 else F.lit(0).cast("long")).alias("y")) for n, g in enumerate(groups)])
    rows = classes.select("simhash", "rep", F.explode(keys).alias("k")).select("simhash", "rep", "k.*")
    other = rows.select(F.col("simhash").alias("s2"), F.col("rep").alias("r2"), "t", "x", "y")
    d = F.bit_count(F.col("simhash").bitwiseXOR(F.col("s2")))
    pairs = rows.join(other, ["t", "x", "y"]).where((F.col("rep") < F.col("r2")) & (d <= distance))
    return pairs.select(F.col("rep").alias("a"), F.col("r2").alias("b"), d.alias("distance")).distinct().unionByName(same)


#: Fingerprints of one part; each pair of parts is compared in one call, so none holds more than two.
PART = 1 << 17
#: Fingerprints whose distances tell which cells can be near, and how many of them are asked for single rows; rows of a cell; columns met in one step by a few rows at a time, whose bits stay in a core's cache.
PIVOTS, CLOSEST, CELL, STEP, ROWS = 64, 8, 128, 4096, 8
#: Links gathered before trees are joined by them.
PENDING = 1 << 17


class _Trees:
    """Spanning forest of rows under links: ``up`` holds each row's root."""

    def __init__(self, up: np.ndarray):
        self.up, self.kept, self.wait, self.n = up, [], [], 0

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        if len(p):
            self.wait.append((p, q))
            self.n += len(p)
            if self.n >= PENDING:
                self.join()

    def join(self) -> None:
        p, q = (np.concatenate([w[k] for w in self.wait] or [np.zeros(0, np.int64)]) for k in (0, 1))
        self.wait, self.n, up = [], 0, self.up
        while len(p):  # the first link of each tree to another joins them; what hangs together goes
            u, v = up[p], up[q]
            p, q, u, v = (y[u != v] for y in (p, q, u, v))
            if not len(p):
                break
            low, high = np.minimum(u, v), np.maximum(u, v)
            one, first = np.unique(high, return_index=True)
            self.kept.append((p[first], q[first]))
            up[one] = low[first]
            while (up[up] != up).any():
                up = up[up]
        self.up = up


def _near_counts(fps: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int, trees: _Trees) -> np.ndarray:
    """For each row the number ``m`` of near rows of the other side (of its own if both are one), itself too; links go to ``trees``.

    Rows are ordered by their nearest pivot and cut into cells, whose rows lie
    close together. A cell is compared with the rows that the pivots' triangle
    bounds don't rule out, first by cells and then row by row.
    """
    own = left is right
    n = np.zeros(len(fps), np.int64)
    pivots = fps[np.argsort(fps * np.uint64(0x9E3779B97F4A7C15), kind="stable")[:PIVOTS]]

    def placed(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        d = np.stack([np.bitwise_count(fps[rows] ^ x) for x in pivots])
        near = d.argmin(axis=0)
        order = np.lexsort((d[near, np.arange(len(rows))], near))
        cuts, d = np.arange(0, len(rows), CELL), np.ascontiguousarray(d[:, order]).view(np.int8)
        return rows[order], d, np.minimum.reduceat(d, cuts, axis=1), np.maximum.reduceat(d, cuts, axis=1)

    if not (len(left) and len(right)):
        return n
    left, dr, lo, hi = placed(left)
    right, dr, low, high = (left, dr, lo, hi) if own else placed(right)
    fr, more = fps[right], (m[right] - 1).astype(float)
    bits, count, near = np.empty((ROWS, STEP), np.uint64), np.empty(CELL * STEP, np.uint8), np.empty(CELL * STEP, bool)
    for k in range(0, len(left), CELL):
        rows, cell = left[k : k + CELL], k // CELL
        start = cell if own else 0  # a pair of one side is met once, in the cell of its first row
        least, most = lo[:, cell] - distance, hi[:, cell] + distance
        cells = np.flatnonzero(((low[:, start:] <= most[:, None]) & (high[:, start:] >= least[:, None])).all(axis=0)) + start
        cols = (cells[:, None] * CELL + np.arange(CELL)).ravel()
        cols = cols[: np.searchsorted(cols, len(right))]
        for x in np.argsort(most - least)[:CLOSEST]:  # where this cell is narrowest; its own rows always stay
            d = dr[x][cols]
            cols = cols[(d >= least[x]) & (d <= most[x])]
        f, own_more = fps[rows][:, None], (m[rows] - 1).astype(float)
        trunks, held = np.unique(trees.up[rows], return_counts=True)
        trunk = trunks[held.argmax()]
        for at in range(0, len(cols), STEP):
            c = cols[at : at + STEP]
            fc, to = fr[c], right[c]
            size = len(rows), len(c)
            x, hit = count[: size[0] * size[1]].reshape(size), near[: size[0] * size[1]].reshape(size)
            for r in range(0, len(rows), ROWS):
                np.bitwise_count(np.bitwise_xor(f[r : r + ROWS], fc, out=bits[: len(f[r : r + ROWS]), : len(c)]), out=x[r : r + ROWS])
            np.less_equal(x, distance, out=hit)
            if own and not at:
                hit[:, : len(rows)] &= np.triu(np.ones((len(rows), len(rows)), bool))
            down = np.add.reduce(hit.view(np.uint8), axis=0, dtype=np.uint8)  # a cell has fewer than 256 rows
            if not down.any():
                continue
            across = np.bitwise_count(np.packbits(hit, axis=1)).sum(axis=1, dtype=np.int64)
            grown = np.flatnonzero((more[c] > 0) & (down > 0))
            n[rows] += across + (hit[:, grown].astype(float) @ more[c[grown]]).astype(np.int64)
            grown = np.flatnonzero((own_more > 0) & (across > 0))
            n[to] += down + (own_more[grown] @ hit[grown].astype(float)).astype(np.int64)
            # links with both ends in the cell's commonest tree tell nothing
            other = np.flatnonzero((down > 0) & (trees.up[to] != trunk))
            y, z = np.nonzero(hit[:, other])
            trees.add(rows[y], to[other[z]])
            other = np.flatnonzero((across > 0) & (trees.up[rows] != trunk))
            y, z = np.nonzero(hit[other])
            trees.add(rows[other[y]], to[z])
    if own:  # a row was met with itself from both ends
        n[left] -= m[left]
    return n


def near_links(hashes: DataFrame, key: str, distance: int, part: int = PART) -> DataFrame:
    """(key, class_id, links) of keys with non-zero fingerprints: the smallest key reached by links, and the number of other keys within ``distance``.

    For distances at which bands tell nothing apart and pairs grow with the
    square of the keys. Different fingerprints are dealt to parts, and every
    pair of parts is compared in numpy; it returns sums and a spanning forest,
    never pairs. Each part is compared with itself first, so pairs of parts
    link its trees and not its rows. All links count, copies too.
    """
    ship(hashes.sparkSession)
    h = written(hashes.where("simhash <> 0"), "prints")
    classes = written(h.groupBy("simhash").agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("m")), "classes")
    n = classes.count()
    parts = max(1, math.ceil(n / part), min(8, n >> 14))  # a few at least, so that tasks share the work
    deal = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda x: F.struct(F.least(x, F.col("at")).alias("i"), F.greatest(x, F.col("at")).alias("j")))

    def run(x: pa.Table) -> pa.Table:
        fps, m, at, tree = x["simhash"].to_numpy().view(np.uint64), x["m"].to_numpy(), x["at"].to_numpy(), x["tree"].to_numpy()
        i, j = x["i"][0].as_py(), x["j"][0].as_py()
        left = np.flatnonzero(at == i)
        _, first, which = np.unique(tree, return_index=True, return_inverse=True)
        trees = _Trees(first[which])
        n = _near_counts(fps, m, left, left if i == j else np.flatnonzero(at == j), distance, trees)
        trees.join()
        a, b = (fps[np.concatenate([y[k] for y in trees.kept] or [np.zeros(0, np.int64)])].view(np.int64) for k in (0, 1))
        sums = [fps.view(np.int64), fps[trees.up].view(np.int64), n, m, at, np.zeros(len(fps), bool)]
        links = [a, b, *(np.zeros(len(a), np.int64) for _ in range(3)), np.ones(len(a), bool)]
        return pa.table({k: np.concatenate(y).astype(t) for k, y, t in zip(("a", "b", "n", "m", "at", "link"), zip(sums, links, strict=True), ("i8", "i8", "i8", "i8", "i4", "?"), strict=True)})

    def compared(rows: DataFrame) -> DataFrame:
        return written(rows.groupBy("i", "j").applyInArrow(run, "a long, b long, n long, m long, at int, link boolean"), "found")

    at = F.pmod(F.xxhash64("simhash"), F.lit(parts)).cast("int").alias("at")
    found = compared(classes.select("simhash", "m", at, F.col("simhash").alias("tree")).select("*", F.col("at").alias("i"), F.col("at").alias("j")))
    if parts > 1:
        rows = found.where("not link").select(F.col("a").alias("simhash"), "m", "at", F.col("b").alias("tree"), F.explode(deal).alias("s"))
        found = found.unionByName(compared(rows.where("s.i < s.j").select("simhash", "m", "at", "tree", "s.i", "s.j")))
    sums = found.where("not link").groupBy(F.col("a").alias("simhash")).agg((F.sum("n") - 1).alias("links"))  # itself isn't another
    named = smallest_ids(classes.select(F.col("simhash").alias("key"), "low"), found.where("link").select("a", "b")).select(F.col("key").alias("simhash"), F.col("component_id").alias("class_id"))
    return h.join(sums.join(named, "simhash"), "simhash").select(key, "class_id", "links")


def jaccard(a, b):
    """Share of equal slots of two MinHash arrays; null if either is empty."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same / F.size(a))
