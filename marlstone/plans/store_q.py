"""Queries over the versioned store and derived datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.filters import member
from marlstone.operators import cdc, derived
from marlstone.operators.registering import query
from marlstone.plans.records_q import RECORDS, orders
from marlstone.sources import records as R


def _store(spark, d):
    """Orders before, and a batch after: some keys changed, some new, some met twice, some tombstones back."""
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("k"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("v"))
    state = o.where("k % 3 <> 0").select("key", F.sha2("v", 256).alias("hash"), F.when(F.col("k") % 10 == 1, F.lit("2024-01-01").cast("timestamp")).alias("removed_at"), F.lit(1).cast("long").alias("revision"))
    one = o.where("k % 4 <> 0").select("key", (F.col("k") * 2).alias("seq"), F.sha2(F.when(F.col("k") % 5 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v")), 256).alias("hash"))
    two = o.where("k % 8 = 1").select("key", (F.col("k") * 2 + 1).alias("seq"), F.sha2(F.when(F.col("k") % 16 == 1, F.concat("v", F.lit("?"))).otherwise(F.col("v")), 256).alias("hash"))
    return state, one.unionByName(two)


STORE = """with o as (select cast(o_orderkey as varchar) as key, o_orderkey as k, o_orderstatus || '|' || o_orderpriority as v from orders),
    state as (select key, v as hash, k % 10 = 1 as gone from o where k % 3 <> 0),
    b as (select key, k * 2 as seq, case when k % 5 = 0 then v || '!' else v end as hash from o where k % 4 <> 0
        union all select key, k * 2 + 1, case when k % 16 = 1 then v || '?' else v end from o where k % 8 = 1),
    j as (select b.key, b.seq, b.hash, s.hash as old, s.gone, s.key is not null as known, lag(b.hash) over w as prev, row_number() over w as n from b left join state s using (key) window w as (partition by b.key order by b.seq)),
    a as (select *, case when n > 1 then case when hash = prev then 'unchanged' else 'changed' end when not known then 'new' when gone then 'changed' when hash = old then 'unchanged' else 'changed' end as action from j) """


@query(STORE + "select key, seq, action, case when known then 1 else 0 end + sum((action <> 'unchanged')::int) over (partition by key order by seq) as revision from a")
def upsert_verdicts(spark, d):
    return cdc.verdicts(*_store(spark, d)).select("key", "seq", "action", "revision")


@query(STORE + "select action, count(*) as n from a group by action")
def upsert_summary(spark, d):
    return cdc.verdicts(*_store(spark, d)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(STORE + "select key from state where not gone and key not in (select key from b)")
def removal_antijoin(spark, d):
    state, batch = _store(spark, d)
    return cdc.removals(state, batch, "healthy")


@query(STORE + "select count(*) as n from b where false")
def removal_guard_suspect(spark, d):
    state, batch = _store(spark, d)
    return cdc.removals(state, batch, "suspect").agg(F.count(F.lit(1)).alias("n"))


@query(STORE + "select key, max(seq) as seq, arg_max(hash, seq) = arg_min(hash, seq) as same from b group by key")
def last_write_wins(spark, d):
    _, b = _store(spark, d)
    first = b.groupBy("key").agg(F.min_by("hash", "seq").alias("h"))
    return cdc.last_writes(b).join(first, "key").select("key", "seq", (F.col("hash") == F.col("h")).alias("same"))


@query("select n_customers as expected, n_covered as covered, n_covered / n_customers as ratio, n_customers - n_covered as missing from (select (select count(*) from customer) as n_customers, (select count(distinct o_custkey) from orders) as n_covered)")
def coverage_ratio(spark, d):
    c, o = R.table(spark, d, "customer"), R.table(spark, d, "orders")
    return cdc.coverage(c.select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k")), "k")


@query()
def content_hashes(spark, d):
    return cdc.fingerprinted(R.table(spark, d, "events").select("event_id", "props"), "props").select("event_id", "hash", "canon")


@query()
def field_diffs(spark, d):
    o = R.table(spark, d, "orders")
    before = F.to_json(F.struct("o_orderstatus", "o_totalprice", F.struct("o_custkey").alias("who")))
    after = F.to_json(F.struct("o_orderstatus", (F.col("o_totalprice") + F.col("o_orderkey") % 2).alias("o_totalprice"), F.struct((F.col("o_custkey") + F.col("o_orderkey") % 3).alias("o_custkey")).alias("who")))
    return cdc.diffs(o.select(F.col("o_orderkey").alias("key"), before.alias("old"), after.alias("new"))).where("size(diff) > 0")


def _with_customers(spark, d):
    c = R.table(spark, d, "customer")
    lookup = R.as_records(c.select("c_name", "c_nationkey", F.col("c_custkey").alias("_k")), "tpch", "customers", F.col("_k"), F.lit("2024-01-01").cast("timestamp"), F.when(F.col("_k") % 13 == 0, F.lit("2024-02-01").cast("timestamp")), F.when(F.col("_k") % 3 == 0, "quarantined"))
    return orders(spark, d).drop("value").unionByName(lookup.drop("value"))


LOOKUP = RECORDS + """, c as (select cast(c_custkey as varchar) as k, c_name, c_nationkey, case when c_custkey % 3 = 0 then 'quarantined' else 'stable' end as t from customer where c_custkey % 13 <> 0),
    j as (select r.key, r.o_orderpriority as priority, c.c_name as name, c.c_nationkey as nation, case when greatest(case coalesce(nullif(r.trust, ''), 'stable') when 'stable' then 0 when 'provisional' then 1 else 2 end, case c.t when 'quarantined' then 2 else 0 end) = 0 then 'stable'
        when greatest(case coalesce(nullif(r.trust, ''), 'stable') when 'stable' then 0 when 'provisional' then 1 else 2 end, case c.t when 'quarantined' then 2 else 0 end) = 1 then 'provisional' else 'quarantined' end as trust
        from r left join c on c.k = cast(r.o_custkey as varchar) where r.removed_at is null and r.o_orderstatus = 'O') """
JOIN_SPEC = derived.Spec("tpch", "orders", "orders_named", ("$.o_orderstatus:eq:O",), {"priority": "$.o_orderpriority"}, derived.Lookup("customers", "$.o_custkey", "customer"))


@query(LOOKUP + "select key, priority, name, nation, trust from j")
def derived_lookup_join(spark, d):
    out = derived.row_values(JOIN_SPEC, _with_customers(spark, d))
    path = lambda p: member(F.col("data"), p)
    return out.select("key", path("$.priority").alias("priority"), path("$.customer.c_name").alias("name"), path("$.customer.c_nationkey").cast("int").alias("nation"), "trust")


@query(RECORDS + "select key, o_orderpriority as priority, o_totalprice as price from r where removed_at is null and contains(lower(o_orderpriority), 'high')")
def derived_project(spark, d):
    spec = derived.Spec("tpch", "orders", "p", ("$.o_orderpriority:contains:high",), {"priority": "$.o_orderpriority", "price": "$.o_totalprice"})
    out = derived.row_values(spec, orders(spark, d))
    return out.select("key", member(F.col("data"), "$.priority").alias("priority"), member(F.col("data"), "$.price").cast("double").alias("price"))


GROUP_SPEC = derived.Spec("tpch", "orders", "by_status", (), {}, None, ("$.o_orderstatus", "$.o_orderpriority"), {"n": "count", "keys": "sum($.o_orderkey)"})


@query(RECORDS + "select o_orderstatus, o_orderpriority, count(*) as n, cast(sum(o_orderkey) as double) as keys from r where removed_at is null group by all")
def derived_group_count_sum(spark, d):
    return derived.group_values(GROUP_SPEC, orders(spark, d))


@query(RECORDS + "select o_orderstatus, o_orderpriority, count(*) as n, cast(sum(o_orderkey) as double) as keys, count(*) > 1000 as stale from r where removed_at is null and o_orderpriority in (select o_orderpriority from r where o_orderkey % 501 = 0) and (o_orderstatus, o_orderpriority) in (select o_orderstatus, o_orderpriority from r where o_orderkey % 501 = 0) group by all")
def derived_group_incremental(spark, d):
    r = orders(spark, d)
    fresh = r.where("cast(key as long) % 501 = 0").withColumn("previous", F.lit(None).cast("string"))
    return derived.group_values(GROUP_SPEC, r, derived.affected_groups(GROUP_SPEC, fresh), 1000)
