"""Queries for text sources, scalars over texts made of the tables' values, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators.registering import query
from marlstone.sources import texts as T
from marlstone.sources.records import table
from marlstone.streaming import feed


def _values(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


CDX_LINES = ["com,a)/ 20240101000000 http://a.com/ text/html 200 D1 10", "com,a)/ 20240301000000 http://a.com/ text/html 200 D1 11", "com,a)/ 20240201000000 http://a.com/ text/html 200 D2 12", "broken line", "com,a)/ 20240401000000 http://a.com/ text/html 200 - 13", "com,a)/ 20240501000000 http://a.com/ text/html 200 - 14"]


@query("select * from (values ('http://a.com/', '2024-01-01', 'D1', true), ('http://a.com/', '2024-02-01', 'D2', true), ('http://a.com/', '2024-04-01', null, true)) t(url, day, digest, truncated)")
def archive_snapshots(spark, d):
    x = T.snapshots(T.cdx(_values(spark, "value string", [(v,) for v in CDX_LINES])), 3)
    return x.select("url", F.date_format("at", "yyyy-MM-dd").alias("day"), "digest", "truncated")


@query("select * from (values (1, 'url', 'http://x/a?b=1&c=2', '2024-01-01'), (1, 'url', 'http://x/b', null), (2, 'sitemap', 'http://x/s.xml', null)) t(k, kind, loc, lastmod)")
def sitemap_entries(spark, d):
    rows = [(1, "<urlset><url><loc> http://x/a?b=1&amp;c=2 </loc><lastmod>2024-01-01</lastmod></url><url><loc><![CDATA[http://x/b]]></loc></url></urlset>"), (2, "<sitemapindex><sitemap><loc>http://x/s.xml</loc></sitemap></sitemapindex>")]
    return T.sitemap(_values(spark, "k int, xml string", rows), "k", "xml")


@query("select page_id, case when path like '/en/%' and path not like '/en/1%' then true when path like '/en/%' or path like '/fr/%' then false else true end as allowed from (select page_id, '/' || regexp_extract(url, '^[^:]+://[^/]+/(.*)$', 1) as path from pages)")
def robots_decisions(spark, d):
    rules, _, _ = T.robots("User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow: /fr/\nAllow: /en/\nDisallow: /en/1*\n")
    path = F.concat(F.lit("/"), F.regexp_extract("url", "^[^:]+://[^/]+/(.*)$", 1))
    return table(spark, d, "pages").select("page_id", T.robots_allowed(path, rules).alias("allowed"))


@query("select * from (values ('a', 5, null), ('b', null, 7), ('c', null, 0)) t(place, n, m)")
def census_rows(spark, d):
    return T.census(_values(spark, "cells array<string>", [(["a", "5", "-1"],), (["b", " ", "7"],), (["c", "(D)", "0"],)]), ["$place", "n", "m"])


SALVAGE = "select event_id, case event_id % 4 when 2 then null else replace(props, ' ', '') end as value from events"


@query(SALVAGE)
def json_salvage(spark, d):
    p, n = F.col("props"), F.pmod("event_id", F.lit(4))
    said = F.when(n == 0, F.concat(F.lit(" "), p)).when(n == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(n == 2, "nothing").otherwise(F.concat(F.lit("so: "), p, F.lit(" ok")))
    return T.salvaged(table(spark, d, "events").select("event_id", said.alias("said")), "event_id", "said").select("event_id", "value")


@query("select o_orderkey, case when o_orderkey % 4 < 3 then cast(o_orderdate as date) end as d from orders")
def parsed_dates(spark, d):
    day, n = F.col("o_orderdate"), F.pmod("o_orderkey", F.lit(4))
    s = F.when(n == 0, F.date_format(day, "yyyy-MM-dd")).when(n == 1, F.date_format(day, "M/d/yyyy")).when(n == 2, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", S.parse_date(s).alias("d"))


@query("select o_orderkey, case when o_orderkey % 4 < 3 then o_totalprice end as v from orders")
def eu_amounts(spark, d):
    grouped, n = F.format_number("o_totalprice", 2), F.pmod("o_orderkey", F.lit(4))
    s = F.when(n == 0, F.translate(grouped, ",.", ".,")).when(n == 1, grouped).when(n == 2, F.translate(grouped, ",", "")).otherwise("x")
    return table(spark, d, "orders").select("o_orderkey", S.eu_amount(s).alias("v"))


@query("select o_orderkey, case o_orderstatus when 'F' then 'closed' when 'O' then 'open' else lower(o_orderpriority) end as v from orders")
def status_words(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", " Archived ").when(F.col("o_orderstatus") == "O", "Posted").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", S.norm_status(s).alias("v"))


@query("select o_orderkey, case when o_orderkey % 5 > 0 then year(o_orderdate) * 12 + month(o_orderdate) - 1 end as m from orders")
def month_indexes(spark, d):
    s = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-'13'"))
    return table(spark, d, "orders").select("o_orderkey", S.month_index(s).alias("m"))


@query("select p_partkey, p_name || ' Grant' as v from part")
def program_titles(spark, d):
    s = F.concat(F.col("p_name"), F.lit(" FY"), (F.col("p_partkey") % 30 + 2000).cast("string"), F.lit(" Grant "), (F.col("p_partkey") % 90 + 1950).cast("string"))
    return table(spark, d, "part").select("p_partkey", S.program_title(s).alias("v"))


@query("select page_id, split_part(url, '#', 1) || case when contains(split_part(url, '#', 1), '?') then '&' else '?' end || 'api_key=***&q=1' as v from pages")
def redacted_urls(spark, d):
    base = F.substring_index("url", "#", 1)
    s = F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit("api_key=k"), F.col("page_id").cast("string"), F.lit("&q=1"))
    return table(spark, d, "pages").select("page_id", S.redact_key(s).alias("v"))


@query("select event_id, case event_id % 7 + 1 when 1 then 30 when 2 then 60 when 3 then 300 when 4 then 1800 when 5 then 7200 end as wait from events")
def delivery_retries(spark, d):
    return table(spark, d, "events").select("event_id", feed.retry_after((F.pmod("event_id", F.lit(7)) + 1).cast("int")).alias("wait"))


TRIGGER = "with e as (select 'job' || (event_id // 50) as job_id, event_type as dataset, cast(user_id as varchar) as key from events where event_type = 'purchase' and cast(json_extract_string(props, '$.k') as integer) >= 20) select 'big' as trigger, job_id, dataset, count(*) as n, list_sort(list(distinct key))[1:3] as keys, count(distinct key) > 3 as truncated from e group by all"


@query(TRIGGER)
def dataset_triggers(spark, d):
    from marlstone.plans.records_q import revisions

    r = revisions(spark, d)
    return feed.fires(feed.matching(r, {"dataset": "purchase", "on": "any", "filters": ["$.k:numgte:20"]}), "big", 3).drop("idempotency_key")
