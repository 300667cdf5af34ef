"""Operator 8, exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.scale import key_filter, marked, without, written

#: Characters of the prefix hash.
PREFIX = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest: bool = False) -> DataFrame:
    """One row (id, keep_id, group_size, kept, text_sha256) for each row of ``docs``.

    Of rows with equal text the one with the largest id stays. A row is told
    apart as early as it can be: rows of a length that no other row has, and
    then rows of a (length, prefix hash) that no other row has, are unique and
    their text is never hashed in full nor shuffled. What survives goes by the
    SHA-256 of its whole text. Survivors of a level reach the next scan as a
    bitmap of fixed size (``key_filter``), so false positives only cost a hash.
    Counts and the largest id combine on the map side; the join back splits a
    hot group by adaptive execution, as only narrow rows are shuffled.

    Null text counts as empty. Null ids take part; ``keep_id`` is null only
    where all ids of the group are. Rows that repeat both id and text are the
    same document listed again: each counts in ``group_size`` and all carry the
    same ``kept``. Other columns are ignored whatever their names. An empty
    table gives an empty result. With ``digest`` the SHA-256 is given for
    every row, else it is null for rows told apart before.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
    keys = written(rows.select("_id", F.octet_length("_t").alias("_n"), F.xxhash64(F.substring("_t", 1, prefix)).alias("_p")), "lengths")
    lengths = keys.groupBy("_n").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    same_length = marked(keys, key_filter(lengths, F.col("_n")), F.col("_n"), "_m").where("_m")
    prefixes = same_length.groupBy("_n", "_p").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    bitmap = written(key_filter(prefixes, F.struct("_n", "_p")), "prefixes")

    full = rows.withColumns({"_n": F.octet_length("_t"), "_p": F.xxhash64(F.substring("_t", 1, prefix))})
    full = marked(full, bitmap, F.struct("_n", "_p"), "_m")
    sha = F.sha2(F.col("_t").cast("binary"), 256)
    some = written(full.where("_m").select("_id", sha.alias("_sha")), "digests")
    groups = some.groupBy("_sha").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.where("group_size > 1"), "groups")  # else the join takes the aggregation's partitions, which can't be split
    hashed = some.join(groups, "_sha", "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    unique = full if digest else marked(keys, bitmap, F.struct("_n", "_p"), "_m").withColumn("_t", F.lit(""))
    alone = unique.where("not _m").select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), (sha if digest else F.lit(None).cast("string")).alias("text_sha256")
    )
    return alone.unionByName(hashed)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, without the rows that ``exact_dedup`` doesn't keep.

    Decided row by row, by id and SHA-256 of the text: another text under the
    same id stays. Rows that repeat the kept id and text stay; rows of a null
    id stay. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    gone = written(exact_dedup(docs, id_col, text_col).where("not kept").select(id_col, "text_sha256"), "copies")
    return without(docs, gone, id_col, {"text_sha256": F.sha2(text.cast("binary"), 256)})
