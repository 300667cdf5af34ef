"""Mirroring a change feed: a stream whose offsets are (time, sequence), resumed inclusively, merged idempotently, and never moved past a batch that failed."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from marlstone.sources.shipping import ship
from marlstone.sources.stored import exists, replace_partitions, slot_of, within

FEED = "micros long, seq long, key string, revision long, change string, data string"


class Pages(InputPartition):
    """One file of the feed, and the stretch of it to read."""

    def __init__(self, path: str, start: dict, end: dict):
        self.path, self.start, self.end = path, start, end


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, list[str]]:
    fs, root = pyarrow.fs.FileSystem.from_uri(path) if urlparse(path).scheme else (pyarrow.fs.LocalFileSystem(), path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
    return fs, sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))


class FeedReader(DataSourceStreamReader):
    """Reads a feed's files (columns of ``FEED``), found anew for each batch.

    An offset is the newest (time, sequence) there is, with the number of rows
    of that time: a row that comes late with an equal time moves it too. A
    batch begins at its start's time itself, so rows of equal times over a
    restart are read again rather than lost; merging drops what is there. Rows
    without a time come with every batch: the guard is to see them.
    """

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"micros": -1, "seq": -1, "rows": 0}

    def latestOffset(self) -> dict:
        fs, files = _files(self.path)
        newest, seqs, rows = -1, -1, 0
        for f in files:
            with fs.open_input_file(f) as raw:
                page = pq.ParquetFile(raw)
                at = page.schema_arrow.names.index("micros")
                stats = [page.metadata.row_group(g).column(at).statistics for g in range(page.num_row_groups)]
                most = max((s.max for s in stats if s is not None and s.has_min_max), default=-1)
                if most < newest or most < 0:
                    continue
                groups = [g for g, s in enumerate(stats) if s is not None and s.has_min_max and s.max == most]
                mine = page.read_row_groups(groups, columns=["micros", "seq"])
                mine = mine.filter(pc.equal(mine["micros"], most))
                if most > newest:
                    newest, seqs, rows = most, -1, 0
                seqs, rows = max(seqs, pc.max(mine["seq"]).as_py() or -1), rows + mine.num_rows
        return {"micros": newest, "seq": seqs, "rows": rows}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [Pages(f, start, end) for f in _files(self.path)[1]]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        fs = _files(self.path)[0]
        with fs.open_input_file(partition.path) as raw:
            page = pq.ParquetFile(raw)
            at = page.schema_arrow.names.index("micros")
            for g in range(page.num_row_groups):
                s = page.metadata.row_group(g).column(at).statistics
                if s is not None and s.has_min_max and not s.null_count and (s.max < partition.start["micros"] or s.min > partition.end["micros"]):
                    continue
                table = page.read_row_group(g, columns=["micros", "seq", "key", "revision", "change", "data"])
                inside = pc.and_(pc.greater_equal(table["micros"], partition.start["micros"]), pc.less_equal(table["micros"], partition.end["micros"]))
                yield from table.filter(pc.fill_null(inside, True)).to_batches()


class ChangeFeed(DataSource):
    """``spark.readStream.format("change_feed").option("path", ...)``: a folder of Parquet pages that only grows."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return FEED

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))


def malformed(batch: DataFrame) -> int:
    """Rows of a batch that can't be placed: no key, no revision, no time, or data that is no JSON."""
    bad = F.col("key").isNull() | F.col("revision").isNull() | F.col("micros").isNull() | (F.col("data").isNotNull() & F.expr("try_parse_json(data)").isNull())
    return batch.where(bad).count()


def may_advance(completed: bool, skipped: int) -> bool:
    """The resume point moves only past a walk that ended and skipped nothing."""
    return completed and skipped == 0


def merge(batch: DataFrame, target: str, slots: int) -> None:
    """Add a batch's revisions to the mirror; those that are there already, or come twice, change nothing. Only touched slots are rewritten."""
    spark = batch.sparkSession
    rows = batch.withColumn("slot", slot_of(F.col("key"), slots))
    touched = [(r.slot,) for r in rows.select("slot").distinct().collect()]  # slots
    if not touched:
        return
    if exists(spark, target):
        rows = spark.read.schema(rows.schema).parquet(target).where(within(["slot"], touched)).unionByName(rows)
    one = rows.groupBy("slot", "key", "revision").agg(F.min_by(F.struct("micros", "seq", "change", "data"), F.struct("micros", "seq")).alias("r"))
    replace_partitions(one.select("r.micros", "r.seq", "key", "revision", "r.change", "r.data", "slot"), target, ["slot"], touched)


def mirror(spark: SparkSession, feed: str, target: str, checkpoint: str, slots: int = 8) -> None:
    """Take all that the feed holds beyond the checkpoint into the mirror at ``target``.

    A batch with malformed rows raises before anything of it is merged, so its
    offset isn't committed: once the feed is mended, the same stretch is read
    again. A batch whose merge is cut off is merged again as a whole.
    """
    ship(spark)
    spark.dataSource.register(ChangeFeed)

    def act(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            skipped = malformed(batch)
            if not may_advance(True, skipped):
                raise ValueError(f"{skipped} malformed rows: the mirror doesn't advance")
            merge(batch, target, slots)
        finally:
            batch.unpersist()

    stream = spark.readStream.format("change_feed").option("path", feed).load()
    stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

