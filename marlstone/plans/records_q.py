"""Queries over records: lists, filters, pages, counts, change feed, cursors."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.filters import trust_label
from marlstone.operators.registering import query
from marlstone.sources import records as R

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def orders(spark, d):
    o = R.table(spark, d, "orders").withColumn("_at", F.col("o_orderdate")).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    key = F.col("o_orderkey")
    return R.as_records(
        o, "tpch", "orders", key, F.col("_at"), F.when(F.pmod(key, F.lit(17)) == 0, F.col("_at")), F.when(F.pmod(key, F.lit(5)) == 0, "provisional").when(F.pmod(key, F.lit(7)) == 0, "").when(F.pmod(key, F.lit(11)) == 0, "quarantined"),
    )


#: The same records in SQL.
RECORDS = """with r as (select 'tpch' as app, 'orders' as dataset, cast(o_orderkey as varchar) as key, o.*, o_orderdate as updated_at,
    case when o_orderkey % 17 = 0 then o_orderdate end as removed_at,
    case when o_orderkey % 5 = 0 then 'provisional' when o_orderkey % 7 = 0 then '' when o_orderkey % 11 = 0 then 'quarantined' end as trust from orders o) """
SHOW = "key, strftime(updated_at, '%Y-%m-%d') as updated_on"


def shown(df, *more):
    return df.select("key", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"), *more)


def money(path):
    return F.col(f"value.{path.removeprefix('$.')}").cast("double")


@query(RECORDS + f"select {SHOW}, o_totalprice as price from r where removed_at is null and o_orderstatus = 'F' and o_totalprice >= 100000 order by updated_at desc, key desc limit 50")
def list_filtered_flagship(spark, d):
    out = R.records_view(orders(spark, d), "tpch", "orders", ["$.o_orderstatus:eq:F", "$.o_totalprice:numgte:100000"], limit=50)
    return shown(out, money("$.o_totalprice").alias("price"))


@query(RECORDS + f"select {SHOW} from r order by updated_at desc, key desc limit 200")
def list_with_tombstones(spark, d):
    return shown(R.records_view(orders(spark, d), "tpch", "orders", limit=200, removed="include"))


@query(RECORDS + f"select {SHOW} from r where removed_at is null and coalesce(nullif(trim(trust), ''), 'stable') = 'stable' and (updated_at < timestamp '1997-01-01' or (updated_at = timestamp '1997-01-01' and key < '5000')) order by updated_at desc, key desc limit 100")
def list_page_keyset_trust(spark, d):
    cursor = R.parse_cursor(R.cursor_of("1997-01-01 00:00:00", "5000"))
    return shown(R.records_view(orders(spark, d), "tpch", "orders", cursor=cursor, limit=100, trust="stable"))


@query(RECORDS + "select count(*) as n from r where removed_at is null and contains(lower(o_orderpriority), 'urgent')")
def count_filtered(spark, d):
    return R.records_view(orders(spark, d), "tpch", "orders", ["$.o_orderpriority:contains:URGENT"]).agg(F.count(F.lit(1)).alias("n"))


@query(RECORDS + "select count(*) as n, sum(o_orderkey) as keys from r where removed_at is null and o_totalprice >= 50000 and o_totalprice <= 150000.5 and strftime(o_orderdate, '%Y-%m-%d') >= '1995-06-01'")
def filter_sql_ranges(spark, d):
    out = R.records_view(orders(spark, d), "tpch", "orders", ["$.o_totalprice:gte:50000", "$.o_totalprice:lte:150000.5", "$.o_orderdate:gte:1995-06-01"])
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("key").cast("long")).alias("keys"))


@query(RECORDS + "select count(*) as n, sum(o_orderkey) as keys from r where removed_at is null and cast(o_orderkey as varchar) >= '3' and cast(o_custkey as varchar) <= '5'")
def filter_memory_text_ranges(spark, d):
    out = R.records_view(orders(spark, d), "tpch", "orders", ["$.o_orderkey:gte:3", "$.o_custkey:lte:5"], mode="memory")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("key").cast("long")).alias("keys"))


@query("select count(*) as n_memory, 0 as n_sql from orders where o_custkey = 7")
def filter_eq_two_modes(spark, d):
    """Equality with a number: text in memory, never in SQL mode."""
    r = orders(spark, d)
    a, b = (R.records_view(r, "tpch", "orders", ["$.o_custkey:eq:7"], removed="include", mode=m).agg(F.count(F.lit(1)).alias(f"n_{m}")) for m in ("memory", "sql"))
    return a.crossJoin(b.withColumn("n_sql", F.col("n_sql").cast("int")))  # two single rows


@query(RECORDS + "select key, o_totalprice as price from r where removed_at is null order by o_totalprice, key limit 100")
def list_filtered_ordered(spark, d):
    r = R.live(orders(spark, d)).withColumn("v", F.col("value.o_totalprice").cast("string"))
    return R.ordered_by_path(r, F.col("v"), 100).select("key", F.col("v").cast("double").alias("price"))


@query("select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events where cast(json_extract_string(props, '$.k') as integer) >= 50")
def filter_event_props(spark, d):
    from marlstone.functions.filters import parse_filter, predicate

    e = R.table(spark, d, "events")
    return e.where(predicate(parse_filter("$.k:numgte:50"), F.col("props"))).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(RECORDS + "select key, o_orderstatus as status from r where key in ('1', '34', '4000', '99999999')")
def get_by_keys(spark, d):
    keys = spark.createDataFrame([("1",), ("34",), ("4000",), ("99999999",)], "key string")
    return orders(spark, d).join(F.broadcast(keys), "key", "left_semi").select("key", F.col("value.o_orderstatus").alias("status"))


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as seen from customer")
def seen_keys(spark, d):
    c, o = R.table(spark, d, "customer"), R.table(spark, d, "orders")
    held = o.select(F.col("o_custkey").alias("k")).distinct()
    return c.join(held, c["c_custkey"] == held["k"], "left").select("c_custkey", F.col("k").isNotNull().alias("seen"))


@query(RECORDS + "select app, dataset, count(*) as records, count(*) filter (removed_at is null) as live_records from r group by all")
def record_counts(spark, d):
    return orders(spark, d).groupBy("app", "dataset").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("removed_at").isNull()).alias("live_records"))


@query("select distinct 'events' as app, event_type as dataset from events where event_id % 11 <> 0")
def list_all_datasets(spark, d):
    e = R.table(spark, d, "events").where("event_id % 11 <> 0")
    return e.select(F.lit("events").alias("app"), F.col("event_type").alias("dataset")).distinct()


@query(RECORDS + "select coalesce(nullif(trim(trust), ''), 'stable') as label, count(*) as n from r group by 1")
def trust_labels(spark, d):
    return orders(spark, d).groupBy(trust_label(F.col("trust")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(RECORDS + "select min(key) as k, case max(case coalesce(nullif(trim(trust), ''), 'stable') when 'stable' then 0 when 'provisional' then 1 when 'quarantined' then 2 else 3 end) when 0 then 'stable' when 1 then 'provisional' when 2 then 'quarantined' else 'unknown' end as weakest from r group by o_custkey")
def weakest_trust_by_customer(spark, d):
    from marlstone.functions.filters import trust_rank

    o = orders(spark, d).withColumn("c", F.col("value.o_custkey"))
    m = F.max(F.struct(trust_rank(F.col("trust")).alias("r"), trust_label(F.col("trust")).alias("l")))["l"]
    return o.groupBy("c").agg(F.min("key").alias("k"), m.alias("weakest")).drop("c")


EVENTS = """with w as (select *, row_number() over (partition by event_type, user_id order by ts, event_id) as revision, lag(props) over (partition by event_type, user_id order by ts, event_id) as previous from events),
    v as (select 'events' as app, event_type as dataset, cast(user_id as varchar) as key, revision, case when revision = 1 then 'new' when event_id % 11 = 0 then 'removed' else 'changed' end as change, props, previous, value, ts as created_at, event_id as seq,
    case when event_id % 7 = 0 then 'provisional' when event_id % 13 = 0 then 'quarantined' end as trust, case when event_id % 5 <> 0 then 'sha' || (event_id % 97) end as artifact_sha, case when event_id % 3 <> 0 then 'rules' || (event_id % 9) end as rules_hash,
    'job' || (event_id // 50) as job_id from w) """


def revisions(spark, d):
    return R.event_revisions(R.table(spark, d, "events"))


@query(EVENTS + "select key, revision, change from v where dataset = 'purchase' and key = '42' order by revision desc limit 20")
def history(spark, d):
    return revisions(spark, d).where((F.col("dataset") == "purchase") & (F.col("key") == "42")).orderBy(F.desc("revision")).limit(20).select("key", "revision", "change")


@query(EVENTS + "select seq, change from v where created_at > timestamp '2024-01-10' and dataset = 'click' and coalesce(trust, 'stable') = 'stable' and change in ('new', 'changed')")
def changes_since(spark, d):
    return R.changes(revisions(spark, d), "2024-01-10", "click", "stable", "fresh").select("seq", "change")


@query(EVENTS + "select seq, key, change from v where created_at < timestamp '2024-01-20' or (created_at = timestamp '2024-01-20' and seq < 100) order by created_at desc, seq desc limit 100")
def changes_page(spark, d):
    t = F.lit("2024-01-20").cast("timestamp")
    out = revisions(spark, d).where((F.col("created_at") < t) | ((F.col("created_at") == t) & (F.col("seq") < 100)))
    return out.orderBy(F.desc("created_at"), F.desc("seq")).limit(100).select("seq", "key", "change")


@query(EVENTS + "select dataset, change, count(*) as n from v group by all")
def job_revision_counts(spark, d):
    return revisions(spark, d).groupBy("dataset", "change").agg(F.count(F.lit(1)).alias("n"))


@query(EVENTS + "select dataset, count(*) as revisions, count(artifact_sha) as with_artifact, count(rules_hash) as with_rules, count(*) filter (artifact_sha is not null and rules_hash is not null) as replayable from v group by dataset")
def provenance_coverage_by_dataset(spark, d):
    both = F.col("artifact_sha").isNotNull() & F.col("rules_hash").isNotNull()
    return revisions(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("revisions"), F.count("artifact_sha").alias("with_artifact"), F.count("rules_hash").alias("with_rules"), F.count_if(both).alias("replayable"))


@query(EVENTS + "select dataset, count(*) as half_stamped from v where (artifact_sha is null) <> (rules_hash is null) group by dataset")
def half_stamped_revisions(spark, d):
    return revisions(spark, d).where(F.col("artifact_sha").isNull() != F.col("rules_hash").isNull()).groupBy("dataset").agg(F.count(F.lit(1)).alias("half_stamped"))


@query(EVENTS + "select rules_hash, count(*) as n from v where rules_hash is not null and rules_hash not in ('rules1', 'rules4') group by 1")
def unregistered_rules(spark, d):
    registered = spark.createDataFrame([("rules1",), ("rules4",)], "rules_hash string")
    return revisions(spark, d).where("rules_hash is not null").join(F.broadcast(registered), "rules_hash", "left_anti").groupBy("rules_hash").agg(F.count(F.lit(1)).alias("n"))


@query(EVENTS + "select seq from v where artifact_sha is not null and rules_hash is not null and change <> 'removed' order by created_at desc, seq desc limit 100")
def replayable_revisions(spark, d):
    r = revisions(spark, d).where("artifact_sha is not null and rules_hash is not null and change <> 'removed'")
    return r.orderBy(F.desc("created_at"), F.desc("seq")).limit(100).select("seq")


@query(EVENTS + "select job_id, dataset, count(*) as n, min(seq) as first_seq from v where change in ('new', 'changed') group by job_id, dataset")
def run_change_groups(spark, d):
    return R.changes(revisions(spark, d), kinds="fresh").groupBy("job_id", "dataset").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query(EVENTS + "select seq, case when change = 'new' then 'appeared' when change = 'removed' then 'withdrawn' when json_extract_string(props, '$.k') = json_extract_string(previous, '$.k') then 'touched' when cast(json_extract_string(props, '$.k') as integer) > cast(json_extract_string(previous, '$.k') as integer) then 'raised' else 'lowered' end as kind from v")
def event_classification(spark, d):
    k, p = (F.get_json_object(c, "$.k").cast("int") for c in ("data", "previous"))
    kind = F.when(F.col("change") == "new", "appeared").when(F.col("change") == "removed", "withdrawn").when(k == p, "touched").when(k > p, "raised").otherwise("lowered")
    return revisions(spark, d).select("seq", kind.alias("kind"))


@query(EVENTS + "select key, max(revision) + 1 as next_revision from v where dataset = 'view' group by key")
def next_revision_numbers(spark, d):
    return revisions(spark, d).where("dataset = 'view'").groupBy("key").agg((F.max("revision") + 1).alias("next_revision"))


@query(EVENTS + "select seq from v qualify row_number() over (partition by dataset, key order by revision desc) > 3")
def prune_keep_newest(spark, d):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("dataset", "key").orderBy(F.desc("revision")))
    return revisions(spark, d).withColumn("r", r).where("r > 3").select("seq")


@query("select conv_id, turn, length(text) as n, lag(length(text)) over (partition by conv_id order by turn) as before from conversations")
def conversation_lag(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return R.table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.lag(F.length("text")).over(w).alias("before"))


@query("select conv_id, max(turn) as turn, arg_max(role, turn) as role from conversations group by conv_id")
def latest_per_key(spark, d):
    return R.table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query(RECORDS + "select name, kind, count(*) as n from (select unnest(['o_custkey', 'o_orderdate', 'o_orderkey', 'o_orderpriority', 'o_orderstatus', 'o_totalprice']) as name, unnest(['number', 'string', 'number', 'string', 'string', 'number']) as kind from r) group by all")
def schema_inference(spark, d):
    from marlstone.functions.filters import raw_type

    names = ["o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), raw_type(F.col("data"), f"$.{n}").alias("kind")) for n in names]))
    return orders(spark, d).select(pairs.alias("p")).groupBy("p.name", "p.kind").agg(F.count(F.lit(1)).alias("n"))
