"""Taxonomies: seeds and records merged into classes of names that aliases connect, and raw names brought to their class's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.sources.stored import fresh_path, remove


def name_key(c: Column) -> Column:
    """How names are compared: trimmed, lower case."""
    return F.lower(F.trim(c))


def merged_entries(seeds: DataFrame, records: DataFrame) -> DataFrame:
    """(label, rank, aliases, codes, source) of seeds (label, rank, aliases, codes) and records (label, enabled, aliases, codes, source).

    A record of a seed's label overrides it where it says something, or removes
    it if it isn't enabled; other enabled records come after the seeds, by
    label. Of several records of one label the least by (enabled, source) that
    is enabled counts, else the label is off.
    """
    one = records.where("trim(label) <> ''").groupBy("label").agg(F.max("enabled").alias("enabled"), F.min_by(F.struct("aliases", "codes", "source"), F.struct(~F.col("enabled"), "source")).alias("r"))
    some = lambda a, b: F.when(F.size(F.coalesce(a, F.array())) > 0, a).otherwise(b)
    j = seeds.join(one, "label", "full_outer").where(F.coalesce("enabled", F.lit(True)))
    return j.select("label", F.coalesce("rank", F.lit(1 << 30)).alias("rank"), some(F.col("r.aliases"), F.col("aliases")).alias("aliases"), some(F.col("r.codes"), F.col("codes")).alias("codes"), F.coalesce("r.source", F.lit("seed")).alias("source"))


def classes(entries: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(name, label, rank): every label and alias as compared, with the label that stands for its class.

    Names are connected where an entry calls one by the other, so chains of
    aliases meet in one class; its label is the one of least (rank, label).
    Each round a name takes the least of its own and its neighbours' entries,
    and then its leader's leader, which halves what is left of a chain. Rounds
    read written tables.
    """
    spark = entries.sparkSession
    entry = F.struct(F.col("rank").cast("long").alias("rank"), F.col("label"))
    own = entries.where("trim(label) <> ''").select(name_key(F.col("label")).alias("name"), entry.alias("best"), "aliases")
    edges = own.select("name", F.explode("aliases").alias("a")).select("name", name_key(F.col("a")).alias("other")).where("other <> '' and other <> name").distinct()
    both = edges.unionByName(edges.select(F.col("other").alias("name"), F.col("name").alias("other"))).distinct()
    paths = [fresh_path(spark, "taxonomy") for _ in range(2)]
    both.write.parquet(paths[0])
    both = spark.read.parquet(paths[0])
    labels = own.groupBy("name").agg(F.min("best").alias("best"))
    names = labels.select("name", "best").unionByName(both.select("name").distinct().join(labels, "name", "left_anti").select("name", F.lit(None).cast("struct<rank:bigint,label:string>").alias("best")))
    names.write.parquet(paths[1])
    now, last = spark.read.parquet(paths[1]), paths[1]
    for _ in range(most_rounds):
        near = both.join(now.select(F.col("name").alias("other"), "best"), "other").groupBy("name").agg(F.min("best").alias("near"))
        step = now.join(near, "name", "left").select("name", F.col("best").alias("_was"), F.least("best", "near").alias("best"))
        lead = step.groupBy(name_key(F.col("best.label")).alias("_lead")).agg(F.count(F.lit(1)).alias("_n"))  # leaders only
        jump = lead.join(step.select(F.col("name").alias("_lead"), F.col("best").alias("_far")), "_lead").drop("_n")
        step = step.withColumn("_lead", name_key(F.col("best.label"))).join(jump, "_lead", "left").select("name", "_was", F.least("best", "_far").alias("best"))
        path = fresh_path(spark, "taxonomy")
        step.write.parquet(path)
        remove(spark, last)
        now, last = spark.read.parquet(path), path
        if not now.where("not (_was <=> best)").limit(1).count():
            break
        now = now.select("name", "best")
    else:
        raise RuntimeError("classes didn't settle")
    remove(spark, paths[0])
    return now.select("name", F.col("best.label").alias("label"), F.col("best.rank").alias("rank"))


def canonical(raws: DataFrame, raw: str, known: DataFrame) -> DataFrame:
    """``raws`` with ``canonical`` and ``matched``: the label of the class that the raw name is in, else of the best class with a name inside it, else the trimmed name itself.

    Different raw names alone are matched. Those that are no name are cut into
    their substrings of the lengths that names have and joined by equality, so
    no raw name meets every name; of several hits the least rank, then label,
    counts. Joins are broadcast only where Spark knows a side to be small.
    """
    names = raws.select(F.col(raw).alias("_raw")).where("_raw is not null").distinct().withColumn("name", name_key(F.col("_raw")))
    exact = names.join(known, "name").select("_raw", "label")
    rest = names.join(exact, "_raw", "left_anti")
    lengths = F.broadcast(known.agg(F.array_sort(F.collect_set(F.length("name"))).alias("_lengths")))  # one row of different lengths
    cut = rest.crossJoin(lengths).select("_raw", "name", F.explode(F.filter("_lengths", lambda n: n <= F.length("name"))).alias("n"))
    inside = cut.select("_raw", F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - F.col("n") + 1), lambda k: F.substring(F.col("name"), k, F.col("n")))).alias("name")).distinct()
    found = inside.join(known, "name").groupBy("_raw").agg(F.min(F.struct("rank", "label")).alias("b")).select("_raw", "b.label")
    both = exact.unionByName(found).withColumnRenamed("label", "_label")
    return raws.join(both, raws[raw] == both["_raw"], "left").withColumns({"canonical": F.coalesce("_label", F.trim(raw)), "matched": F.col("_label").isNotNull()}).drop("_raw", "_label")
