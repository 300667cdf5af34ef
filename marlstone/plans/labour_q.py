"""Labour kernels, taxonomies and the record store over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import hooks
from marlstone.operators import labour as L
from marlstone.operators import taxonomy as T
from marlstone.operators.record_store import Store
from marlstone.operators.registering import query
from marlstone.sources import mirror
from marlstone.sources.records import event_revisions, table
from marlstone.sources.stored import fresh_path

HISTORY = """select o_orderpriority as kind, o_orderstatus as region, date_trunc('month', o_orderdate) as at_month, avg(o_totalprice) * case when o_orderpriority = '2-HIGH' then 9 else 1 end as posted_avg,
    case when month(o_orderdate) <> 5 then avg(case when o_custkey % 3 > 0 then o_totalprice end) end as official_avg from orders group by o_orderpriority, o_orderstatus, date_trunc('month', o_orderdate), month(o_orderdate)"""
NOWCAST = f"""with h as ({HISTORY}), r as (select kind, region, posted_avg / official_avg as ratio, row_number() over (partition by kind, region order by at_month desc) as k from h where posted_avg > 0 and official_avg > 0),
    w as (select kind, region, list_sort(list(ratio)) as ratios from r where k <= 6 group by all), p as (select o_orderpriority as kind, o_orderstatus as region, (list_sort(list(o_totalprice)))[(round((count(*) - 1) * 0.5) + 1)::int] as posted_median, count(*) as n from orders group by all),
    a as (select o_orderpriority as kind, o_orderstatus as region, date_diff('day', max(o_orderdate::date - case when o_orderstatus = 'P' then 500 else 0 end), date '2000-01-01') as staleness_days from orders where o_orderpriority <> '5-LOW' group by all),
    j as (select *, list_median(ratios) as ratio, len(ratios) as m, posted_median / list_median(ratios) as projected from p join w using (kind, region) join a using (kind, region) where n >= 3),
    v as (select *, case when ratio not between 0.25 and 4 then 'implausible_ratio' when projected not between 100 and 190000 then 'out_of_band' when m < 2 then 'thin_evidence' end as withheld, (ratios[-1] - ratios[1]) / ratio as spread, staleness_days > 400 as anchor_stale from j)
    select kind, region, posted_median, case when withheld is null then round(projected)::bigint end as nowcast_median, withheld, round(ratio, 4) as ratio_used, m as observations, case when withheld is null then round(spread, 3) end as dispersion, staleness_days, anchor_stale,
        case when withheld is not null then 'none' when m >= 6 and spread <= 0.1 then case when anchor_stale then 'med' else 'high' end when m >= 3 and spread <= 0.25 and not anchor_stale then 'med' else 'low' end as confidence from v"""


@query(NOWCAST)
def salary_nowcast(spark, d):
    """Today's medians of order prices brought to the level of a second source by each cell's newest six monthly ratios."""
    o = table(spark, d, "orders")
    history = spark.sql(HISTORY.replace("from orders", "from {orders}"), orders=o).select("kind", "region", F.col("at_month").alias("at"), F.lit(0).alias("tie"), F.col("posted_avg").alias("posted"), F.col("official_avg").alias("official"))
    by = ["kind", "region"]
    points = o.select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("region"), F.col("o_totalprice").alias("value"))
    late = F.when(F.col("o_orderstatus") == "P", 500).otherwise(0)
    anchors = o.where("o_orderpriority <> '5-LOW'").groupBy("o_orderpriority", "o_orderstatus").agg(F.max("o_orderdate").cast("date").alias("m")).select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("region"), F.date_sub("m", late).alias("anchor"))
    return L.nowcast(points, history, anchors, by, F.lit("2000-01-01").cast("date"), (100.0, 190_000.0))


CLOSED = "select o_orderpriority as kind, case when o_orderkey % 13 <> 0 then o_orderstatus end as region, o_orderkey * 7919 % 61 + 1 as days, o_orderkey % 5 = 0 as reposted, o_custkey % 4 = 0 as is_live from orders"


@query(f"""with c as ({CLOSED}), e as (select * from c where region is not null union all select kind, 'ALL', days, reposted, is_live from c),
    l as (select kind, region, count(*) filter (is_live) as live from e group by all),
    g as (select kind, region, count(*) as n, (list_sort(list(days)))[(round((count(*) - 1) * 0.5) + 1)::int] as median_days, (list_sort(list(days)))[(round((count(*) - 1) * 0.75) + 1)::int] as p75_days, count(*) filter (reposted) as reposts from e group by all)
    select g.*, live, round(reposts * 100.0 / n, 1) as repost_pct, case when live > 0 then round(n * 100.0 / live, 1) end as churn_pct from g left join l using (kind, region) where n >= 5""")
def posting_lifecycle(spark, d):
    """Days to close by kind and region and over all regions, reposts and churn."""
    c = spark.sql(CLOSED.replace("from orders", "from {orders}"), orders=table(spark, d, "orders"))
    live = c.groupBy("kind", "region").agg(F.count_if("is_live").alias("live")).where("region is not null").unionByName(c.groupBy("kind").agg(F.count_if("is_live").alias("live")).withColumn("region", F.lit("ALL")))
    return L.lifecycle(c, live, 5)


LINKS = "select event_id as id, event_id % 30 + 1 as days, case when event_id % 6 <> 5 then event_id + 7 end as next from events"


@query(f"""with recursive l as ({LINKS}), p as (select l.id, l.days, case when n.id is not null then l.next end as next from l left join l n on l.next = n.id), s as (select * from p where id not in (select next from p where next is not null)),
    w as (select id as first, id as last, 1 as postings, days, next from s union all select first, p.id, postings + 1, w.days + p.days, p.next from w join p on w.next = p.id)
    select first, last, postings::bigint as postings, days::bigint as days from w where next is null""")
def repost_chains(spark, d):
    """Postings that follow one another as chains, with their days added up."""
    return L.chains(spark.sql(LINKS.replace("from events", "from {events}"), events=table(spark, d, "events")))


@query("""with s as (select 'event ' || event_type as label, min(event_id) as label_rank from events group by 1), a as (select distinct 'event ' || event_type as label, event_type as alias from events union all select 'event view', 'event click' union all select 'event click', 'Shared Name' union all select 'event purchase', ' shared name '),
    best as (select case when label in ('event view', 'event click', 'event purchase') then 'joined' else label end as class, min_by(label, label_rank) as canonical from s group by 1),
    c as (select label, canonical from s join best on class = case when label in ('event view', 'event click', 'event purchase') then 'joined' else label end)
    select event_id, canonical, true as matched from events join c on label = 'event ' || event_type""")
def canonical_labels(spark, d):
    """Events' labels by class: two labels that aliases connect, over a shared name, are one."""
    e = table(spark, d, "events")
    seeds = e.groupBy(F.concat(F.lit("event "), "event_type").alias("label")).agg(F.min("event_id").alias("rank")).withColumn("aliases", F.when(F.col("label") == "event view", F.array(F.lit("view"), F.lit("event click"))).when(F.col("label") == "event click", F.array(F.lit("click"), F.lit("Shared Name"))).when(F.col("label") == "event purchase", F.array(F.lit("purchase"), F.lit(" shared name "))).otherwise(F.array(F.substring("label", 7, 99))))
    entries = seeds.withColumns({"codes": F.array().cast("array<string>"), "source": F.lit("seed")})
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" Event "), F.initcap("event_type"))).otherwise(F.concat(F.lit("an "), "event_type", F.lit(" of today")))
    return T.canonical(e.select("event_id", raw.alias("raw")), "raw", T.classes(entries)).select("event_id", "canonical", "matched")


@query("""select 'records' as kind, event_type as dataset, count(distinct user_id) as n from events where event_type <> 'error' and user_id % 9 <> 4 group by 2 union all
    select 'revisions', event_type, count(*) from events where event_type <> 'error' and user_id % 9 <> 4 group by 2""")
def deleted_records(spark, d):
    """What a store of the events' revisions holds once a dataset and a ninth of the keys are deleted with their history."""
    r = event_revisions(table(spark, d, "events")).select("app", "dataset", "key", "revision", "change", "data", "created_at")
    store = Store(fresh_path(spark, "store"), 4)
    store.write(r.groupBy("app", "dataset", "key").agg(F.max_by("data", "revision").alias("data")), r)
    store.delete_dataset(spark, "events", "error")
    store.delete_records(spark, r.where("cast(key as long) % 9 = 4").select("app", "dataset", "key"))
    left = store.table(spark, "records").withColumn("kind", F.lit("records")).select("kind", "dataset").unionByName(store.table(spark, "revisions").withColumn("kind", F.lit("revisions")).select("kind", "dataset"))
    return left.groupBy("kind", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query("select event_type as dataset, count(*) as revisions, max(event_id)::bigint as newest from events group by event_type")
def mirrored_changes(spark, d):
    """The events' revisions mirrored from a feed in two walks, the second over times that the first has read."""
    feed, target, check = (fresh_path(spark, n) for n in ("feed", "mirror", "check"))
    e = event_revisions(table(spark, d, "events"))
    pages = e.select(F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / 600_000_000).alias("micros"), F.col("seq"), F.concat_ws("/", "dataset", "key").alias("key"), F.col("revision").cast("long").alias("revision"), "change", F.to_json(F.struct("dataset")).alias("data"))
    for name, part in (("first", "seq % 3 > 0"), ("second", "seq % 3 = 0")):
        pages.where(part).write.parquet(f"{feed}/{name}")
        if name == "first":
            newest = pages.where(part).agg(F.max("micros")).first()[0]
            spark.createDataFrame([(newest + 1, -1, "marker/0", 1, "new", '{"dataset": "marker"}')], mirror.FEED).coalesce(1).write.parquet(f"{feed}/marker")
        mirror.mirror(spark, feed, target, f"{check}-{name}", 4)  # a walk of its own: what was mirrored is merged again
    held = spark.read.parquet(target).where("key <> 'marker/0'")
    return held.groupBy(F.get_json_object("data", "$.dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("revisions"), F.max("seq").alias("newest"))


@query("select event_type, case when try_cast(json_extract_string(props, '$.k') as int) >= 50 then 'pass' else 'stop' end as verdict, count(*) as n from events group by all")
def plugin_hook_verdicts(spark, d):
    """A gate over the events' properties, by partition, called from SQL."""
    hooks.register_hooks(spark)
    events = table(spark, d, "events").select("event_id", "event_type", F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("count"))).alias("body"))
    out = spark.sql("select * from plugin_hooks(table({events}) partition by (event_type, event_id % 16), 'body', 'gate', 'slim', '{{\"min_count\": 50}}')", events=events)
    return out.where("hook_kind = 'row'").groupBy("event_type", "verdict").agg(F.count(F.lit(1)).alias("n"))
