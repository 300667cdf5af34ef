"""Queries for replays, samples, merges, drift and levels."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from marlstone.operators import documents as D
from marlstone.operators import quality as Q
from marlstone.operators import replay as P
from marlstone.operators.registering import query
from marlstone.plans.documents_q import PAGE_RULES
from marlstone.sources.records import table

N = lambda: F.count(F.lit(1))


@query("""with x as (select page_id, regexp_extract(html, 'track\\(([0-9]+)\\)', 1) as a, case when page_id % 10 <> 0 then regexp_extract(html, 'track\\(([0-9]+)\\)', 1) end as b from pages)
    select 'track' as field, count(*) as docs, 1.0 as base_rate, round(count(b) / count(*), 3) as candidate_rate, 0 as added, count(*) - count(b) as lost, 0 as changed, round(round(count(b) / count(*), 3) - 1, 3) as delta from x""")
def replay_field_diff(spark, d):
    p = table(spark, d, "pages")
    rules = {"track": PAGE_RULES["track"]}
    worse = p.withColumn("html", F.when(F.col("page_id") % 10 == 0, F.replace("html", F.lit("track("), F.lit("trace("))).otherwise(F.col("html")))
    return P.field_diff(D.extracted(p, rules), D.extracted(worse, rules), ["track"], "page_id").drop("samples")


@query("select page_id, page_id % 10 <> 0 as same from pages")
def rederived_pages(spark, d):
    p = table(spark, d, "pages")
    now = D.extracted(p, PAGE_RULES)
    stored = now.select("page_id", F.when(F.col("page_id") % 10 == 0, F.lit("{}")).otherwise(F.col("data")).alias("data"))
    return P.rederived(now, stored, "page_id")


@query()
def observatory_sample(spark, d):
    return P.newest_and_random(table(spark, d, "events"), "event_type", [F.desc("ts"), F.col("event_id")], "event_id", 40, 7).select("event_type", "event_id")


@query("select page_id from pages where regexp_matches(url, '/(en|de)/') and not regexp_matches(url, 'page=|ref=')")
def url_allow_filter(spark, d):
    return table(spark, d, "pages").where(P.url_allowed(F.col("url"), ["/en/", "/de/"], ["page=", "ref="])).select("page_id")


@query("select user_id as host, count(*) as requests, count(*) filter (event_type = 'error') as errors, max(hour(ts)) as penalty from events group by 1")
def host_profile_merge(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "host")
    side = lambda r: e.where(F.col("event_id") % 2 == r).groupBy("host").agg(N().alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.hour("ts")).alias("penalty"))
    return P.host_merge(side(0), side(1), "host", ["requests", "errors"], ["penalty"])


@query("with l as (select user_id as k, case when count(*) filter (event_type = 'error') > 15 then 2 when count(*) filter (event_type = 'error') > 10 then 1 else 0 end as level from events group by 1), s as (select k, k % 3 as s from l where k % 4 <> 0) select k, level, coalesce(s, 0) <> level as write, level > coalesce(s, 0) as act from l left join s using (k)")
def level_transitions(spark, d):
    n = F.count_if(F.col("event_type") == "error")
    now = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.when(n > 15, 2).when(n > 10, 1).otherwise(0).alias("level"))
    return P.level_changes(now.where("k % 4 <> 0").select("k", (F.col("k") % 3).cast("int").alias("level")), now, "k", "level")


@query()
def cohort_drift(spark, d):
    p = table(spark, d, "pages")
    changed = p.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("<p>"), F.lit("<div class=x>"))).otherwise(F.col("html")))
    return Q.cohort_drift(D.page_facts(p), D.page_facts(changed), "page_id", ["text_hash", "dom_hash"])


@query("select * from (values ('pages', 'track', 'regex(track\\((\\d+)\\)) | to_int'), ('pages', 'nav', 'each(li)'), ('pages', 'nav.label', 'css(a)'), ('pages', 'nav.href', 'css(a) | url_absolute')) t(source, field, operation)")
def field_level_lineage(spark, d):
    rows = P.field_lineage({k: PAGE_RULES[k] for k in ("track", "nav")}, "pages")
    return spark.createDataFrame(rows, "source string, field string, operation string")


@query('select * from (values (0, timestamp \'2024-01-05 06:30:00\'), (1, timestamp \'2024-01-08 06:30:00\'), (2, timestamp \'2024-01-09 06:30:00\')) t(n, "at")')
def schedule_misses(spark, d):
    found = P.firings("30 6 * * 1-5", datetime(2024, 1, 4, 7), datetime(2024, 1, 9, 12))
    return spark.createDataFrame(list(enumerate(found)), "n int, at timestamp_ntz")


@query("select event_type, cast(strftime(ts, '%Y-%m-%d') as varchar) as day, count(*) as n from events group by all having count(*) > 2")
def daily_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(N().alias("n")).where("n > 2")
