"""Queries for joins, aggregates, windows, limits, sets and kernels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.functions import stats
from marlstone.operators import kernels as K
from marlstone.operators import timeseries as T
from marlstone.operators.registering import query
from marlstone.plans.records_q import EVENTS, revisions
from marlstone.sources.records import table

N = lambda: F.count(F.lit(1))
DEC = "cast({} as decimal(18, 2))"


def dec(c):
    return F.col(c).cast("decimal(18,2)")


@query("select event_type as app, user_id % 4 as engine, count(*) as events, cast(sum(cast(value as decimal(18, 4))) as double) as cost from events group by all")
def cost_summary(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("app"), F.pmod("user_id", F.lit(4)).alias("engine")).agg(N().alias("events"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("cost"))


@query("select event_type, count(distinct user_id) as users, count(*) as n from events group by all")
def yield_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), N().alias("n"))


@query("select o_orderstatus, count(*) as n from orders group by all")
def status_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(N().alias("n"))


@query("select user_id, count(*) as failures from events where event_type = 'error' group by all order by failures desc, user_id limit 20")
def failed_top_n(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(N().alias("failures")).orderBy(F.desc("failures"), "user_id").limit(20)


@query("select l_returnflag, count(*) as n, count(*) filter (l_shipdate > timestamp '1997-01-01') as late, max(date_diff('day', timestamp '1992-01-01', l_shipdate)) as longest, cast(sum(case when l_quantity > 25 then cast(l_quantity as decimal(18, 2)) end) as double) as large from lineitem group by all")
def job_timing_stats(spark, d):
    x = table(spark, d, "lineitem")
    late = F.col("l_shipdate") > F.lit("1997-01-01").cast("timestamp")
    return x.groupBy("l_returnflag").agg(N().alias("n"), F.count_if(late).alias("late"), F.max(F.datediff("l_shipdate", F.lit("1992-01-01"))).alias("longest"), F.sum(F.when(F.col("l_quantity") > 25, dec("l_quantity"))).cast("double").alias("large"))


@query("select l_linestatus, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'N') as n, count(*) filter (l_returnflag = 'R') as r, strftime(min(case when l_returnflag = 'R' then l_shipdate end), '%Y-%m-%d') as oldest from lineitem group by all")
def delivery_health(spark, d):
    x, flag = table(spark, d, "lineitem"), F.col("l_returnflag")
    return x.groupBy("l_linestatus").agg(*[F.count_if(flag == f).alias(f.lower()) for f in "ANR"], F.date_format(F.min(F.when(flag == "R", F.col("l_shipdate"))), "yyyy-MM-dd").alias("oldest"))


@query("select 'orders' as name, count(*) as n, strftime(min(o_orderdate), '%Y-%m-%d') as oldest from orders union all select 'events', count(*), strftime(min(ts), '%Y-%m-%d') from events union all select 'lineitem', count(*), strftime(min(l_shipdate), '%Y-%m-%d') from lineitem")
def ledger_stats(spark, d):
    parts = [table(spark, d, t).agg(F.lit(t).alias("name"), N().alias("n"), F.date_format(F.min(c), "yyyy-MM-dd").alias("oldest")) for t, c in (("orders", "o_orderdate"), ("events", "ts"), ("lineitem", "l_shipdate"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CELLS = "list_sort(list(l_quantity))[cast(floor((count(*) - 1) * {} + 0.5) as bigint) + 1] as {}"


@query(f"select l_returnflag, l_linestatus, count(*) as n, {CELLS.format(0.25, 'p25')}, {CELLS.format(0.5, 'median')}, {CELLS.format(0.75, 'p75')} from lineitem group by all")
def nearest_rank_percentiles(spark, d):
    return K.nearest_rank_cells(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", {"p25": 0.25, "median": 0.5, "p75": 0.75})


CUBE = """with x as (select case when c_custkey % 9 = 0 then null else n_name end as region, c_mktsegment as kind, c_acctbal from customer join nation on n_nationkey = c_nationkey)
    select case when grouping(region) = 1 then 'ALL' else region end as region, case when grouping(kind) = 1 then 'all' else kind end as kind, count(*) as n, cast(sum(cast(c_acctbal as decimal(18, 2))) as double) as total
    from x group by cube (region, kind) having grouping(region) = 1 or region is not null"""


@query(CUBE)
def cube_region_rollup(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    x = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.when(F.col("c_custkey") % 9 != 0, F.col("n_name")).alias("region"), F.col("c_mktsegment").alias("kind"), dec("c_acctbal").alias("b"))
    return K.region_cube(x, "region", "kind", [N().alias("n"), F.sum("b").cast("double").alias("total")])


@query("select l_shipmode_group as g, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) filter (l_tax > 0.02) as double) / nullif(sum(cast(l_quantity as decimal(18,2))) filter (l_tax > 0.02), 0) as ratio from (select *, l_suppkey % 10 as l_shipmode_group from lineitem) group by all")
def paired_ratio_totals(spark, d):
    x = table(spark, d, "lineitem")
    price = F.when(F.col("l_tax") > 0.02, dec("l_extendedprice"))
    return x.groupBy(F.pmod("l_suppkey", F.lit(10)).alias("g")).agg(N().alias("n"), K.paired_ratio(price, dec("l_quantity")).cast("double").alias("ratio"))


BLEND = """with a as (select c_nationkey as nation, c_mktsegment as seg, count(*) as employers from customer where c_custkey % 3 <> 0 and c_mktsegment <> 'BUILDING' group by all),
    b as (select c_nationkey as nation, c_mktsegment as seg, count(*) as solos from customer where c_custkey % 3 = 0 and c_nationkey > 4 group by all)
    select coalesce(a.nation, b.nation) as nation, coalesce(a.seg, b.seg) as seg, employers, solos, case when a.nation is not null and b.nation is not null then 'both' when a.nation is not null then 'employer' else 'solo' end as coverage,
    solos / (coalesce(employers, 0) + solos) as solo_share, s.suppliers from a full join b on a.nation = b.nation and a.seg = b.seg left join (select s_nationkey, count(*) as suppliers from supplier group by 1) s on s.s_nationkey = coalesce(a.nation, b.nation)"""


@query(BLEND)
def market_blend(spark, d):
    c = table(spark, d, "customer").withColumnsRenamed({"c_nationkey": "nation", "c_mktsegment": "seg"})
    a = c.where("c_custkey % 3 <> 0 and seg <> 'BUILDING'").groupBy("nation", "seg").agg(N().alias("employers"))
    b = c.where("c_custkey % 3 = 0 and nation > 4").groupBy("nation", "seg").agg(N().alias("solos"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(N().alias("suppliers"))
    share = F.col("solos") / (F.coalesce("employers", F.lit(0)) + F.col("solos"))
    return K.blend(a, b, ["nation", "seg"], "employer", "solo").withColumn("solo_share", share).join(s, "nation", "left")


RELEASE = """with a as (select p_partkey as code, p_retailprice as v from part where p_partkey % 7 <> 0), b as (select p_partkey as code, p_retailprice + case when p_partkey % 5 = 0 then p_partkey / 8.0 else 0 end as v from part where p_partkey % 11 <> 0),
    j as (select coalesce(a.code, b.code) as code, a.v as before, b.v as after from a full join b using (code)), k as (select *, case when before is null then 'added' when after is null then 'dropped' when before <> after then 'changed' else 'same' end as kind from j) """


def _release(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "code").withColumn("v", F.col("p_retailprice"))
    return K.release_diff(p.where("code % 7 <> 0"), p.where("code % 11 <> 0").withColumn("v", F.col("v") + F.when(F.col("code") % 5 == 0, F.col("code") / 8.0).otherwise(0)), "code", "v")


@query(RELEASE + "select kind, count(*) as n from k group by kind")
def release_diff_counts(spark, d):
    return _release(spark, d).groupBy("kind").agg(N().alias("n"))


@query(RELEASE + "select code, after - before as delta from k where kind = 'changed' order by abs(after - before) desc, code limit 25")
def release_diff_top_movers(spark, d):
    return _release(spark, d).where("kind = 'changed'").orderBy(F.desc(F.abs("delta")), "code").limit(25).select("code", "delta")


@query("with c as (select distinct cast(c_custkey as varchar) as code from customer where c_custkey % 3 = 1) select code from c where not exists (select 1 from c p where length(p.code) < length(c.code) and starts_with(c.code, p.code))")
def covering_prefix_antijoin(spark, d):
    return K.without_covered(table(spark, d, "customer").where("c_custkey % 3 = 1").select(F.col("c_custkey").cast("string").alias("code")), "code")


LIFO = """with o as (select o_orderkey, o_custkey % 50 as k, row_number() over (partition by o_custkey % 50 order by o_orderdate desc, o_orderkey) as n from orders where o_orderstatus = 'O'),
    c as (select o_orderkey, o_custkey % 50 as k, row_number() over (partition by o_custkey % 50 order by o_orderdate desc, o_orderkey) as n from orders where o_orderstatus = 'F') select o.k, o.o_orderkey as opened, c.o_orderkey as closed from o join c on o.k = c.k and o.n = c.n"""


@query(LIFO)
def repost_matching(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.pmod("o_custkey", F.lit(50)))
    a, b = o.where("o_orderstatus = 'O'").select("k", F.col("o_orderkey").alias("opened"), F.col("o_orderdate").alias("_a")), o.where("o_orderstatus = 'F'").select("k", F.col("o_orderkey").alias("closed"), F.col("o_orderdate").alias("_b"))
    return K.lifo_matches(a, b, ["k"], [F.desc("_a"), F.col("opened")], [F.desc("_b"), F.col("closed")]).select("k", "opened", "closed")


@query("select n_name, posted, official, posted - official as gap from (select c_nationkey as k, median(c_acctbal) as posted from customer group by 1) a join (select s_nationkey as k, median(s_acctbal) as official from supplier group by 1) b using (k) join nation on n_nationkey = k")
def salary_gap(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.median("c_acctbal").alias("posted"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.median("s_acctbal").alias("official"))
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "k")
    return a.join(b, "k").join(n, "k").select("n_name", "posted", "official", (F.col("posted") - F.col("official")).alias("gap"))


@query("select n_name, count(c_custkey) as total, coalesce(any_value(s.n), 0) as base, case when coalesce(any_value(s.n), 0) > 0 then round(count(c_custkey) * 10000.0 / any_value(s.n), 2) end as per_10k from nation left join customer on c_nationkey = n_nationkey left join (select s_nationkey, count(*) as n from supplier group by 1) s on s_nationkey = n_nationkey group by n_name")
def normalize_places(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(N().alias("total"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(N().alias("base"))
    n = table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("k")).join(c, "k", "left").join(s, "k", "left").fillna(0, ["total", "base"])
    return n.select("n_name", "total", "base", F.when(F.col("base") > 0, F.round(F.col("total") * 10000.0 / F.col("base"), 2)).alias("per_10k"))


@query("select c_custkey, coalesce(c_acctbal_known, s_acctbal) as amount from (select c_custkey, case when c_custkey % 4 <> 0 then c_acctbal end as c_acctbal_known from customer) left join supplier on s_suppkey = c_custkey")
def detail_overlay(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.join(s, c["c_custkey"] == s["s_suppkey"], "left").select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")), F.col("s_acctbal")).alias("amount"))


ECON = """with c as (select event_type as app, cast(sum(cast(value as decimal(18, 4))) filter (ts > timestamp '2024-01-24') as double) as cost_7, cast(sum(cast(value as decimal(18, 4))) as double) as cost_30 from events where event_type <> 'view' group by 1),
    y as (select event_type as app, count(*) filter (ts > timestamp '2024-01-24') as new_7, count(*) as new_30 from events where event_type <> 'error' and event_id % 3 = 0 group by 1)
    select coalesce(c.app, y.app) as app, cost_7, cost_30, new_7, new_30, case when new_7 > 0 then cost_7 / new_7 end as per_new_7, case when new_30 > 0 then cost_30 / new_30 end as per_new_30 from c full join y on c.app = y.app"""


@query(ECON)
def economics_report(spark, d):
    e = table(spark, d, "events")
    week, v = F.col("ts") > F.lit("2024-01-24").cast("timestamp"), F.col("value").cast("decimal(18,4)")
    c = e.where("event_type <> 'view'").groupBy(F.col("event_type").alias("app")).agg(F.sum(F.when(week, v)).cast("double").alias("cost_7"), F.sum(v).cast("double").alias("cost_30"))
    y = e.where("event_type <> 'error' and event_id % 3 = 0").groupBy(F.col("event_type").alias("app")).agg(F.count_if(week).alias("new_7"), N().alias("new_30"))
    return c.join(y, "app", "full_outer").withColumns({f"per_new_{k}": K.per_record(F.col(f"cost_{k}"), F.col(f"new_{k}")) for k in (7, 30)})


@query("with r as (select user_id, count(*) filter (ts > timestamp '2024-01-24') / 7.0 as recent, count(*) / 30.0 as longer from events group by 1) select user_id, case when longer = 0 then 'unknown' when recent >= 1.5 * longer then 'raise' when recent <= 0.5 * longer then 'lower' else 'keep' end as advice from r")
def budget_advice(spark, d):
    r = table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("ts") > F.lit("2024-01-24").cast("timestamp")) / 7.0).alias("a"), (N() / 30.0).alias("b"))
    return r.select("user_id", K.advice(F.col("a"), F.col("b")).alias("advice"))


@query("select cast(o_custkey as bigint) as o_custkey, max(strftime(o_orderdate, '%Y-%m-%d')) as day, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders where o_orderdate <= timestamp '1996-06-30' group by all")
def asof_version(spark, d):
    v = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return T.as_of(v, "o_custkey", "o_orderdate", F.lit("1996-06-30").cast("timestamp")).select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey")


@query("with p as (select event_id, user_id, ts from events where event_type = 'purchase'), c as (select user_id, ts, max(event_id) as click from events where event_type = 'click' group by all) select p.event_id, c.click as as_of_click from p asof left join c on p.user_id = c.user_id and p.ts >= c.ts")
def asof_join_click_purchase(spark, d):
    e = table(spark, d, "events")
    c = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click"))
    return T.as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), c, "user_id", "ts", "ts", ["click"]).select("event_id", "as_of_click")


VELO = """with m as (select o_orderpriority as g, strftime(o_orderdate, '%Y-%m') as p, year(o_orderdate) * 12 + month(o_orderdate) as i, count(*) as v from orders where o_orderdate < timestamp '1998-01-01' group by all), n as (select *, row_number() over (partition by g order by p desc) as n from m),
    a as (select g, count(*) as months_available, max(p) as as_of, sum(v) filter (n <= 12) as t, sum(v) filter (n between 13 and 24) as q, sum(v) filter (n <= 3) as l, count(*) >= 12 and max(i) - min(i) filter (n <= 12) = 11 as c1, count(*) >= 24 and max(i) - min(i) filter (n <= 24) = 23 as c2 from n group by g)
    select g, months_available, as_of, c1 as window_contiguous, c2 as prior_window_contiguous, case when c1 then cast(t as double) end as t12m, case when c1 and c2 then cast(q as double) end as prior12m, case when c1 and c2 then round((t - q) * 100.0 / q, 1) end as yoy_delta_pct, case when c1 then round((l * 4 - t) * 100.0 / t, 1) end as accel_pct from a"""


@query(VELO)
def velocity_t12m(spark, d):
    o = table(spark, d, "orders").where("o_orderdate < timestamp '1998-01-01'")
    m = o.groupBy(F.col("o_orderpriority").alias("g"), F.date_format("o_orderdate", "yyyy-MM").alias("p")).agg(N().alias("v"))
    return T.velocity(m, ["g"], "p", "v")


@query()
def freshness_due(spark, d):
    e = table(spark, d, "events").withColumn("changed", F.pmod("event_id", F.lit(3)) == 0)
    return T.freshness(e, "user_id", "ts", "changed", F.lit("2024-02-01").cast("timestamp"), 604_800.0).orderBy("due_in", "user_id").limit(500)


@query("with w as (select user_id, sum((event_type = 'error')::int) over (partition by user_id order by ts desc, event_id desc rows unbounded preceding) as bad from events) select user_id, count(*) filter (bad = 0) as streak from w group by all")
def streak_of_clean(spark, d):
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return T.head_streak(e, "user_id", F.desc("o"), F.col("event_type") != "error")


@query("select user_id, event_id from (select user_id, event_id, event_type = 'error' as f, lag(event_type = 'error') over (partition by user_id order by ts, event_id) as b from events) where b is not null and b <> f")
def match_flip_boundaries(spark, d):
    return T.flips(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id")


RECUR = """with x as (select distinct o_custkey as k, cast(o_orderdate as date) as d from orders), g as (select k, d, date_diff('day', lag(d) over (partition by k order by d), d) as g from x),
    a as (select k, count(*) as cycles, max(d) as last_day, list_sort(list(g) filter (g is not null)) as a from g group by k), m as (select *, a[len(a) // 2 + 1] as median_gap from a)
    select k, cycles, median_gap, coalesce(len(a) > 0 and len(list_filter(a, lambda x: abs(x - median_gap) > 45)) = 0, false) as regular from m"""


@query(RECUR)
def recurrence_projection(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"))
    return T.recurrence(o, "k", "d").select("k", "cycles", "median_gap", "regular")


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3")
def richest_samples(spark, d):
    return T.newest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("with w as (select user_id, event_id, sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) as t from events) select user_id, event_id, t as tripped from w")
def recent_trips(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.sum((F.col("event_type") == "error").cast("int")).over(w).alias("tripped"))


@query(EVENTS + "select key, dataset, from_state, to_state, seq from (select key, dataset, seq, change as to_state, lag(change) over (partition by key, dataset order by revision) as from_state from v) where from_state is not null and from_state <> to_state")
def state_transitions(spark, d):
    r = revisions(spark, d).withColumn("k", F.concat_ws("/", "key", "dataset"))
    return T.transitions(r, "k", ["revision"], "change").join(r.select("k", "revision", "key", "dataset", "seq"), ["k", "revision"]).select("key", "dataset", "from_state", "to_state", "seq")


@query("select l_orderkey, min(l_shipdate)::date::varchar as first_day from lineitem where l_shipdate between timestamp '1996-01-01' and timestamp '1996-03-31' group by 1 order by min(l_shipdate), l_orderkey limit 200")
def closing_soon(spark, d):
    x = table(spark, d, "lineitem").where(F.col("l_shipdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1996-03-31").cast("timestamp")))
    return x.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("m")).orderBy("m", "l_orderkey").limit(200).select("l_orderkey", F.date_format("m", "yyyy-MM-dd").alias("first_day"))


@query("select o_orderkey from orders order by (case o_orderpriority when '1-URGENT' then 5 when '2-HIGH' then 4 when '3-MEDIUM' then 3 else 1 end) * 365 + date_diff('day', o_orderdate, timestamp '1999-01-01') desc, o_orderdate, o_orderkey limit 100")
def claim_ordering(spark, d):
    o = table(spark, d, "orders")
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 5).when(F.col("o_orderpriority") == "2-HIGH", 4).when(F.col("o_orderpriority") == "3-MEDIUM", 3).otherwise(1)
    return o.orderBy(F.desc(rank * 365 + F.datediff(F.lit("1999-01-01"), "o_orderdate")), "o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("select user_id, event_type, arg_min(event_id, (ts, event_id)) as event_id, count(*) - 1 as duplicates from events group by all")
def idempotent_dedup(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"), (N() - 1).alias("duplicates"))


@query("select distinct o_custkey as id from orders where o_orderstatus = 'F' union select distinct c_custkey from customer where c_acctbal > 9000")
def pinned_refs_union(spark, d):
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return a.union(table(spark, d, "customer").where("c_acctbal > 9000").select("c_custkey")).distinct()


@query("select doc_id, coalesce(quality, -1) as quality, q.doc_id is not null as covered from documents left join labels q using (doc_id)")
def label_coverage(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("quality").isNotNull().alias("covered"))


SYNC = """with w as (select n_nationkey as k, n_name as b from nation where n_nationkey % 5 <> 0), h as (select n_nationkey as k, case when n_nationkey % 4 = 0 then 'x' else n_name end as b from nation where n_nationkey % 6 <> 0)
    select coalesce(w.k, h.k) as k, case when h.k is null then 'create' when w.k is null then 'disable' when w.b is distinct from h.b then 'update' else 'keep' end as action from w full join h on w.k = h.k"""


@query(SYNC)
def catalog_reconcile(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("b"))
    return K.full_sync(n.where("k % 5 <> 0"), n.where("k % 6 <> 0").withColumn("b", F.when(F.col("k") % 4 == 0, "x").otherwise(F.col("b"))), "k", "b")


@query("select l_suppkey, list_sort(list(distinct l_returnflag))[1:2] as flags, count(distinct l_returnflag) > 2 as truncated from lineitem group by 1")
def capped_keys(spark, d):
    a = F.sort_array(F.collect_set("l_returnflag"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.slice(a, 1, 2).alias("flags"), (F.size(a) > 2).alias("truncated"))


WILSON = """with a as (select o_custkey % 20 as g, count(*) as n, count(*) filter (o_orderstatus = 'F') as k from orders group by 1)
    select g, greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)) as lo, least(1, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)) as hi from a"""


@query(WILSON)
def wilson_intervals(spark, d):
    a = table(spark, d, "orders").groupBy(F.pmod("o_custkey", F.lit(20)).alias("g")).agg(N().alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    return a.withColumn("w", stats.wilson(F.col("k"), F.col("n"))).select("g", "w.lo", "w.hi")


MEDIANS = """with a as (select o_custkey as g, list_sort(list(o_totalprice)) as a from orders group by 1) select g, case when len(a) % 2 = 1 then a[len(a) // 2 + 1] else (a[len(a) // 2] + a[len(a) // 2 + 1]) / 2 end as middle, a[len(a) // 2 + 1] as upper, a[cast(floor((len(a) - 1) * 0.5 + 0.5) as bigint) + 1] as nearest from a"""


@query(MEDIANS)
def three_medians(spark, d):
    return K.medians(table(spark, d, "orders").select(F.col("o_custkey").alias("g"), "o_totalprice"), ["g"], "o_totalprice")


@query("select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug, case when p_retailprice between 900 and 1900 then p_retailprice end as sane, cast(cast(floor(floor(p_retailprice / 100) * 100 / 1000) as integer) as varchar) || 'k' as band from part")
def part_scalars(spark, d):
    price = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", S.slugify(F.col("p_name")).alias("slug"), S.salary_point(price, F.lit(0), 900, 1900).alias("sane"), S.salary_band(price, 100).alias("band"))


@query("select o_orderkey, strftime(cast(o_orderdate as date) + interval 1 day + interval 12 hour, '%Y-%m-%d %H:%M:%S') as due, o_orderstatus = 'O' and timestamp '1997-01-01' > cast(o_orderdate as date) + interval 36 hour as lapsed from orders")
def past_due_sweep(spark, d):
    o = table(spark, d, "orders")
    end = S.deadline_end(F.col("o_orderdate").cast("date"))
    open_ = F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed")
    return o.select("o_orderkey", F.date_format(end, "yyyy-MM-dd HH:mm:ss").alias("due"), S.is_past_due_open(open_, end, F.lit("1997-01-01").cast("timestamp")).alias("lapsed"))


@query("select event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as uuid from (select event_id, sha256(event_type || ':' || event_id) as h from events)")
def ingress_event_ids(spark, d):
    return table(spark, d, "events").select("event_id", S.digest_uuid(F.concat_ws(":", "event_type", "event_id")).alias("uuid"))


@query("select n_name, r_name, count(distinct s_suppkey) as suppliers, count(distinct c_custkey) as customers from region cross join nation left join supplier on s_nationkey = n_nationkey left join customer on c_nationkey = n_nationkey and c_custkey < 50 where n_regionkey = r_regionkey group by all")
def operator_economics(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.countDistinct("s_suppkey").alias("suppliers"))
    c = table(spark, d, "customer").where("c_custkey < 50").groupBy(F.col("c_nationkey").alias("k")).agg(F.countDistinct("c_custkey").alias("customers"))
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"]).withColumnRenamed("n_nationkey", "k").join(s, "k", "left").join(c, "k", "left")
    return j.fillna(0, ["suppliers", "customers"]).select("n_name", "r_name", "suppliers", "customers")


@query("select job, cost, n_new, n_changed, case when cost is null then ['cost'] else [] end as unknown from (select 'job' || (event_id // 50) as job, cast(sum(cast(value as decimal(18, 4))) filter (event_type = 'purchase') as double) as cost, count(*) filter (event_type = 'signup') as n_new, count(*) filter (event_type = 'view') as n_changed from events group by 1)")
def job_receipts(spark, d):
    e = table(spark, d, "events")
    t = F.col("event_type")
    r = e.groupBy(F.concat(F.lit("job"), F.floor(F.col("event_id") / 50).cast("string")).alias("job")).agg(F.sum(F.when(t == "purchase", F.col("value").cast("decimal(18,4)"))).cast("double").alias("cost"), F.count_if(t == "signup").alias("n_new"), F.count_if(t == "view").alias("n_changed"))
    return r.withColumn("unknown", S.covering([(F.col("cost").isNull(), "cost")]))
