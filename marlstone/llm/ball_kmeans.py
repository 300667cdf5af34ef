"""Operator 11, ball k-means: exact Lloyd rounds in which a vector is compared only with centroids that the geometry of its cluster's ball leaves in play."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.scale import forget, mapped, ship, written

#: Components beyond this, scaled, are counted as non-finite: squared distances of vectors of up to 256 components then fit in 64 bits.
LARGEST = 1 << 26


def nearest(x: np.ndarray, home: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, centroids compared) of each row of the integers ``x``; ties go to the smaller number.

    ``home`` is the cluster that a row was in. Seen from its ball, with D the
    row's squared distance to the ball's centroid and C that of another
    centroid, the other can't be as near if C > 4 D. So: centroids beyond twice
    the ball's radius are no neighbours of the ball at all; members nearer than
    half the way to the first neighbour are its stable core and stay without a
    comparison; the rest lie in annuli by how many neighbours are in play, and
    are compared exactly with those alone. Whole numbers throughout, so no
    rounding can prune a nearest centroid.
    """
    cluster, dist, compared = home.copy(), np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
    for ball in np.unique(home):
        members = np.flatnonzero(home == ball)
        d = ((x[members] - centres[ball]) ** 2).sum(1)
        reach = -(-((centres - centres[ball]) ** 2).sum(1) // 4)  # C <= 4 D is ceil(C / 4) <= D
        order = np.argsort(reach, kind="stable")
        order = order[(order != ball) & (reach[order] <= d.max())]
        annulus = np.searchsorted(reach[order], d, side="right")  # 0: the stable core
        best, at = d.copy(), np.full(len(members), ball)
        for k, other in enumerate(order):
            near = np.flatnonzero(annulus > k)
            e = ((x[members[near]] - centres[other]) ** 2).sum(1)
            wins = (e < best[near]) | (e == best[near]) & (other < at[near])
            best[near[wins]], at[near[wins]] = e[wins], other
        cluster[members], dist[members], compared[members] = at, best, annulus + 1
    return cluster, dist, compared


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _assigned(vectors: DataFrame, centres: np.ndarray, id_col: str) -> DataFrame:
    dims = centres.shape[1]
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = nearest(_matrix(batch.column("_v"), dims), batch.column("cluster").to_numpy().astype(np.int64), centres)
                yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("_v"), pa.array(found[0], pa.int32()), *map(pa.array, found[1:])], [id_col, "_v", "cluster", "distance", "compared"])

    return mapped(vectors.select(id_col, "_v", "cluster"), run, f"`{id_col}` {kinds[id_col]}, _v array<int>, cluster int, distance long, compared long")


def _moved(assigned: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centroids at the floor of their members' means. Each batch gives a row a cluster at most, which are added before the k sums reach the driver."""
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cluster = _matrix(batch.column("_v"), dims), batch.column("cluster").to_numpy()
            for c in np.unique(cluster):
                own = x[cluster == c]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([own.sum(0).tolist()], pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = mapped(assigned.select("cluster", "_v"), run, "cluster int, n long, s array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(dims)])
    out = centres.copy()
    for r in sums.collect():  # k rows
        out[r.cluster] = [int(Decimal(r[f"s{k}"])) // r.n for k in range(dims)]
    return out


def ball_kmeans(vectors: DataFrame, k: int, rounds: int, dims: int, scale: float = 64.0, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row (id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared) for each vector that is kept.

    Kept are vectors of exactly ``dims`` components, none null or non-finite
    (or of 2^26 / scale and more, whose squared distances need not fit in 64
    bits); they become integers floor(scale * x). Centroids start as the k
    vectors whose hash of seed and id is smallest (equal hashes: by vector),
    are moved to the floor of their members' mean ``rounds`` times, and vectors
    are assigned once more. Distances are squared; ties go to the smaller
    number; an empty cluster stays where it is. ``compared`` counts the
    centroids that a vector was compared with in the last assignment.

    Fewer than k kept vectors give as many centroids; none give an empty
    result. A null id counts as an empty one in the hash; repeated rows are
    vectors each; other columns are ignored whatever their names. ``rounds`` of
    0 only assigns.

    Centroids (k times dims numbers, both parameters) are all that the driver
    and each task hold beside a record batch. A round reads the vectors from a
    table that the last one wrote, which is then removed.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector_col)
    ok = (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) * F.lit(float(scale)) < LARGEST, F.lit(False)))
    ints = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    kept = written(vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).alias("_id"), ints.alias("_v"), F.lit(0).alias("cluster")), "vectors")
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256).alias("h"), "_v").orderBy("h", "_v").limit(k).collect()
    if not first:
        return _named(kept.select(F.col("_id"), "cluster", *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"), F.lit(0).cast("long").alias("compared")), id_col)
    centres = np.array([r._v for r in first], np.int64).reshape(-1, dims)
    for n in range(rounds + 1):
        assigned = written(_assigned(kept, centres, "_id"), "assigned")
        forget(kept)
        kept = assigned
        if n < rounds:
            centres = _moved(kept, centres)
    inertia = {r.cluster: int(r.s) for r in kept.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    each = spark.createDataFrame([(c, s, sum(inertia.values()), shas[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = kept.join(F.broadcast(each), "cluster")  # k rows at most
    return _named(out.select("_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"), id_col)


def _named(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumnRenamed("_id", id_col)
