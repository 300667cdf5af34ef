"""Tables that outlive a job: partitioned Parquet folders of which single partitions are replaced or removed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Local sessions without one get a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="marlstone-store-")
        atexit.register(shutil.rmtree, folder, True)
        _own[app] = f"file://{folder}"
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/stored/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a path of any file system that Spark reads; false if it wasn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename a path within one file system; folders above the target are made."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    fs = a.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{source} can't be moved to {target}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(table: DataFrame) -> None:
    """Remove a table of ``written`` that nothing reads any more. Another frame is left alone."""
    path = getattr(table, "written_at", None)
    if path:
        remove(table.sparkSession, path)


def escaped(spark: SparkSession, value: object) -> str:
    """A partition value as it stands in a folder's name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes under a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(at).getLength()


def slot_of(key: Column, slots: int) -> Column:
    """The hash partition of a key."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def within(by: list[str], parts: list[tuple]) -> Column:
    """Rows of the given partitions; a plain predicate on partition columns, so that a scan is pruned by it."""
    if len(by) == 1:
        return F.col(by[0]).isin([p[0] for p in parts])
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(by, p, strict=True)]) for p in parts], F.lit(False))


def replace_partitions(rows: DataFrame, path: str, by: list[str], touched: list[tuple], rebalanced: bool = True) -> None:
    """Make ``rows`` the whole content of the ``touched`` partitions of the table at ``path``; no other partition's files change.

    ``rows`` may be computed from the table itself: they are written aside
    first, once, and their folders then take the places of the old ones. So a
    job that fails before that leaves the table as it was, and running the same
    call again gives the same table. A touched partition without rows is
    removed. ``touched`` is a list of partitions, not of keys, so its size is
    that of the table's layout. ``rebalanced`` false: the rows' own tasks write
    the files, without a shuffle by partition.
    """
    spark = rows.sparkSession
    if not touched:
        return
    aside = f"{path.rstrip('/')}.aside-{uuid.uuid4().hex}"
    try:
        (rows.hint("rebalance", *by) if rebalanced else rows).write.partitionBy(*by).parquet(aside)
        left = {tuple(r) for r in spark.read.schema(rows.schema).parquet(aside).select(*by).distinct().collect()}  # partitions
        if left - set(touched):
            raise ValueError(f"rows of partitions that aren't replaced: {sorted(left - set(touched))[:3]}")
    except BaseException:
        remove(spark, aside)
        raise
    for part in set(touched):
        folder = "/".join(f"{c}={escaped(spark, v)}" for c, v in zip(by, part, strict=True))
        remove(spark, f"{path.rstrip('/')}/{folder}")
        if part in left:
            moved(spark, f"{aside}/{folder}", f"{path.rstrip('/')}/{folder}")
    remove(spark, aside)
