"""Queries for domain kernels, reports, index upkeep and plugins."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.functions import stats
from marlstone.operators import documents as D
from marlstone.operators import domain as M
from marlstone.operators import search
from marlstone.operators.registering import query
from marlstone.sources.records import table

N = lambda: F.count(F.lit(1))


@query("select * from (values (0, 1717200000), (1, null), (2, 1718409600), (3, 1735689600)) t(k, event_date)")
def deadline_enrichment(spark, d):
    rows = [(0, "Apply by the deadline 2024-06-01 please"), (1, "founded 2024-06-01"), (2, "submissions due June 15, 2024; closes 12/31/2025"), (3, "closing on 1/1/2025")]
    df = spark.createDataFrame(rows, "k int, text string").withColumn("now", F.lit(1_700_000_000).cast("long"))
    return M.deadlines(df, "k", "text", "now")


UNI = """select 'orders' as source, cast(o_orderkey as varchar) as key, o_orderpriority as title, null::varchar as agency, case o_orderstatus when 'O' then 'open' when 'F' then 'closed' else lower(o_orderstatus) end as status, o_totalprice as amount_max from orders
    union all select 'parts', cast(p_partkey as varchar), p_name, p_brand, null, p_retailprice from part"""


@query(UNI)
def unified_sources(spark, d):
    o, p = table(spark, d, "orders"), table(spark, d, "part")
    status = S.norm_status(F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise(F.col("o_orderstatus")))
    a = M.unified(o, "orders", {"key": F.col("o_orderkey"), "title": F.col("o_orderpriority"), "status": status, "amount_max": F.col("o_totalprice")})
    b = M.unified(p, "parts", {"key": F.col("p_partkey"), "title": F.col("p_name"), "agency": F.col("p_brand"), "amount_max": F.col("p_retailprice")})
    return a.unionByName(b).select("source", "key", "title", "agency", "status", "amount_max")


@query("""with p as (select a.o_orderkey as a, b.o_orderkey as b, a.o_orderpriority = b.o_orderpriority as same, cast(a.o_orderdate as date) as oa, cast(b.o_orderdate as date) as ob from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey),
    q as (select *, oa + 30 < ob or ob + 30 < oa as apart, abs(date_diff('day', oa, ob)) as gap, greatest(1, round(abs(date_diff('day', oa, ob)) / 365.25)) as y from p)
    select case when not apart and same then 'duplicate' when apart and y <= 3 and abs(gap - y * 365.25) <= 45 then 'recurrence' else 'none' end as relation, count(*) as n from q group by 1""")
def relation_linking(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("o"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("c"))
    x, y = o.select(F.col("o_orderkey").alias("a"), "o_custkey"), o.select(F.col("o_orderkey").alias("b"), "o_custkey")
    pairs = x.join(y, "o_custkey").where("a < b").select("a", "b")
    return M.relation(o, o, pairs, "o_orderkey", "o_orderpriority", "o", "c").groupBy("relation").agg(N().alias("n"))


@query("select g, level, median, median - gm as premium from (select c_mktsegment as g, c_nationkey % 3 as level, median(c_acctbal) as median from customer group by all) join (select c_mktsegment as g, median(c_acctbal) as gm from customer group by all) using (g)")
def education_premium(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), F.pmod("c_nationkey", F.lit(3)).alias("level"), "c_acctbal")
    return M.premium(c, "g", "level", "c_acctbal")


@query("with x as (select p_brand as g, unnest(list_distinct(string_split(p_name, ' '))) as skill from part), t as (select p_brand as g, count(*) as t from part group by 1) select g, skill, count(*) as n, count(*) / any_value(t) as share from x join t using (g) group by g, skill")
def skill_shares(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.split("p_name", " ").alias("s"))
    return M.skill_share(p, "g", "s")


@query("select c_nationkey, cast(sum(cast(c_acctbal as decimal(18, 2))) filter (c_acctbal >= 0) as double) as total, count(*) filter (c_acctbal < 0) as suppressed from customer group by 1")
def market_rollup(spark, d):
    x = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("decimal(18,2)"))
    out = table(spark, d, "customer").groupBy("c_nationkey").agg(*M.suppressed_sum(x))
    return out.withColumn("total", F.col("total").cast("double"))


TOPIC = """with o as (select o_orderpriority as family, [o_custkey % 40, o_orderkey % 7] as orgs, case when o_totalprice > 50000 then cast(o_totalprice as decimal(18, 2)) end as amount, year(o_orderdate) as y from orders),
    n as (select family, org, count(*) as n from (select family, unnest(list_distinct(orgs)) as org from o) group by all), r as (select *, row_number() over (partition by family order by n desc, org) as r from n)
    select b.*, t.orgs, t.top_orgs from (select family, count(*) as projects, cast(sum(amount) as double) as known_sum, min(y) as first_year, max(y) as last_year from o group by 1) b join (select family, count(*) as orgs, list(org order by r) filter (r <= 3) as top_orgs from r group by 1) t using (family)"""


@query(TOPIC)
def topic_family_stats(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("family"), F.array(F.pmod("o_custkey", F.lit(40)), F.pmod("o_orderkey", F.lit(7))).alias("orgs"), F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"), F.year("o_orderdate").alias("y"))
    out = M.topic_stats(o, "family", "orgs", "amount", "y", 3)
    return out.select("family", "projects", F.col("known_sum").cast("double").alias("known_sum"), "first_year", "last_year", "orgs", "top_orgs")


@query("select event_type, user_id, event_id from (select event_type, user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as r from events) where r <= 5 order by r, user_id limit 300")
def crawl_frontier(spark, d):
    return M.frontier(table(spark, d, "events"), "user_id", ["ts", "event_id"], 5, 300).select("event_type", "user_id", "event_id")


@query("select coalesce(a.k, b.k) as k, case when a.k is null then 'opened' when b.k is null then 'closed' else 'open' end as state from (select distinct user_id as k from events where event_type = 'click') a full join (select distinct user_id as k from events where event_type = 'signup') b on a.k = b.k")
def posting_ledger(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), "event_type")
    return M.ledger(e.where("event_type = 'click'"), e.where("event_type = 'signup'"), "k")


@query("select page_id, page_id % 10 = 3 or regexp_matches(lower(substr(html, 1, 4096)), 'attention required|captcha|cf-browser-verification|checking your browser|ddos protection by|enable javascript|just a moment|please enable cookies|verify you are human') as blocked from pages")
def bot_walls(spark, d):
    status = F.when(F.col("page_id") % 10 == 3, 403).otherwise(200)
    return table(spark, d, "pages").select("page_id", M.bot_wall(status, F.col("html")).alias("blocked"))


@query("select page_id, regexp_replace(url, '([?&])([^=&#]+)=([^&#]*)', '\\1\\2={\\2}', 'g') as template from pages")
def url_templates(spark, d):
    return table(spark, d, "pages").select("page_id", M.template_url(F.col("url")).alias("template"))


@query("with w as (select distinct n_name as v from nation where n_regionkey < 2), l as (select distinct r_name as k, n_name as v from nation join region on n_regionkey = r_regionkey) select k, count(*) as hits, count(*) / (select count(*) from w) as score from l where v in (select v from w) group by k")
def recipe_overlaps(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    leaves = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("k"), F.col("n_name").alias("v"))
    return M.recipe_overlap(leaves, n.where("n_regionkey < 2").select(F.col("n_name").alias("v")), "k", "v")


@query("select 'tpch/orders' as upstream, 'tpch/orders_named' as downstream, 'TRANSFORMED' as kind union all select 'tpch/customers', 'tpch/orders_named', 'TRANSFORMED'")
def dataset_lineage(spark, d):
    return M.lineage(spark, [("tpch/orders", "tpch/orders_named"), ("tpch/customers", "tpch/orders_named")])


@query("select o_orderstatus as app, case when c_custkey is not null then 'pinned' when o_orderdate >= timestamp '1997-01-01' then 'window' else 'reclaimable' end as reason, count(*) as files, cast(sum(o_orderkey) as bigint) as bytes from orders left join (select c_custkey from customer where c_custkey % 10 = 0) on c_custkey = o_orderkey group by all")
def retention_plan(spark, d):
    o = table(spark, d, "orders").withColumn("path", F.col("o_orderkey")).withColumn("app", F.col("o_orderstatus"))
    pins = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("path"))
    return M.retention(o, pins, "path", "o_orderdate", "app", "o_orderkey", F.lit("1997-01-01").cast("timestamp"))


@query("select 'jobs' as metric, o_orderstatus as label, cast(count(*) as double) as value from orders group by o_orderstatus union all select 'failures', event_type, cast(count(*) as double) from events where event_type = 'error' group by event_type")
def metrics_exposition(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(N().alias("value"))
    b = table(spark, d, "events").where("event_type = 'error'").groupBy(F.col("event_type").alias("label")).agg(N().alias("value"))
    return M.metrics({"jobs": a, "failures": b}, "label")


@query()
def reindex_simhash(spark, d):
    x = table(spark, d, "documents")
    old = D.text_simhash(x, "doc_id", "text").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit(0).cast("long")).otherwise(F.col("simhash")).alias("stored"))
    return M.simhash_moves(x.join(old, "doc_id"), "doc_id", "text", "stored")


@query()
def plugin_titles(spark, d):
    from marlstone.functions import dom

    r = M.Registry()
    r.add("title", lambda doc, params: {"title": dom.title(dom.parse(doc))[: params["most"]]})
    return r.run(table(spark, d, "pages"), "title", "page_id", "html", {"most": 40}).groupBy("outcome").agg(N().alias("n"))


@query("select item_id as doc_id, term, count(*) as tf from (select item_id, unnest(list_filter(string_split_regex(lower(case when item_id % 4 = 0 then 'changed text ' || item_id else text end), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as term from benchmark where item_id % 7 <> 0) group by all")
def index_upsert(spark, d):
    """Postings after some documents changed and some were deleted."""
    b = table(spark, d, "benchmark")
    old = search.postings(b, "item_id", "text")
    new = search.postings(b.where("item_id % 4 = 0").withColumn("text", F.concat(F.lit("changed text "), F.col("item_id").cast("string"))), "item_id", "text")
    gone = b.where("item_id % 7 = 0").select("item_id")
    kept = old.join(new.select("item_id").distinct(), "item_id", "left_anti").unionByName(new).join(gone, "item_id", "left_anti")
    return kept.select(F.col("item_id").alias("doc_id"), "term", "tf")


@query("select 'app:documents:' || doc_id as id, 'documents' as dataset, coalesce(nullif(trim(source), ''), lang) as title, length(text) as chars from documents")
def search_documents(spark, d):
    x = table(spark, d, "documents")
    return x.select(F.concat(F.lit("app:documents:"), F.col("doc_id").cast("string")).alias("id"), F.lit("documents").alias("dataset"), S.first_text(F.col("source"), F.col("lang")).alias("title"), F.length("text").alias("chars"))


@query("with w as (select doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents) select doc_id from w where (list_contains(w, 'the')) and doc_id % 3 <> 0")
def saved_search_new_hits(spark, d):
    """Hits that weren't seen before."""
    hits = search.scored(table(spark, d, "documents"), search.Request(("the",)), "doc_id", "text")
    seen = table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id")
    return hits.join(seen, "doc_id", "left_anti").select("doc_id")


@query("select g, round(sum(abs(p - q)) / 2, 9) as tv from (select g, k, n / sum(n) over (partition by g) as p, m / sum(m) over (partition by g) as q from (select lang as g, least(15, cast(floor(log2(greatest(1, length(text)))) as integer)) as k, count(*) filter (doc_id % 2 = 0) as n, count(*) filter (doc_id % 2 = 1) as m from documents group by all)) group by g")
def length_profile_shift(spark, d):
    x = table(spark, d, "documents").withColumn("b", stats.len_bucket(F.length("text")))
    hist = lambda r: F.array(*[F.count_if((F.col("doc_id") % 2 == r) & (F.col("b") == k)).cast("double") for k in range(16)])
    return x.groupBy(F.col("lang").alias("g")).agg(hist(0).alias("p"), hist(1).alias("q")).select("g", F.round(stats.total_variation(F.col("p"), F.col("q")), 9).alias("tv"))


ROBUST = """with c as (select user_id % 30 as k, count(*) as v, user_id % 30 % 6 as g from events group by all), m as (select g, median(v) as med, count(*) as n from c group by g), t as (select c.*, med, n, abs(v - med) as dev from c join m using (g)),
    s as (select g, median(dev) as mad, avg(dev) as mean from t group by g) select k, case when n < 3 then null when mad > 1e-12 then round(0.6745 * (v - med) / mad, 6) when mean > 1e-12 then round((v - med) / (1.253314 * mean), 6) when abs(v - med) <= 0.02 then 0 else greatest(-25, least(25, (v - med) / 0.02)) end as z from t join s using (g)"""


@query(ROBUST)
def robust_scores(spark, d):
    c = table(spark, d, "events").groupBy(F.pmod("user_id", F.lit(30)).alias("k")).agg(N().cast("double").alias("v")).withColumn("g", F.pmod("k", F.lit(6)))
    a = c.groupBy("g").agg(F.collect_list("v").alias("a"))
    return c.join(a, "g").select("k", F.round(stats.robust_z(F.col("v"), F.col("a"), 0.02), 6).alias("z"))


@query("select o_orderkey, case when o_totalprice <= 0 then ['positive'] else [] end || case when o_orderdate > timestamp '1998-06-01' then ['late'] else [] end as reasons from orders")
def validation_reasons(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.covering([(F.col("o_totalprice") <= 0, "positive"), (F.col("o_orderdate") > F.lit("1998-06-01").cast("timestamp"), "late")]).alias("reasons"))


@query("select user_id, cast(count(*) filter (event_type = 'purchase') as double) / count(*) as bought, cast(count(*) filter (event_type = 'error') as double) / count(*) as failed from events group by 1")
def outcome_rates(spark, d):
    rate = lambda t: F.count_if(F.col("event_type") == t) / N()
    return table(spark, d, "events").groupBy("user_id").agg(rate("purchase").alias("bought"), rate("error").alias("failed"))


@query("select c_mktsegment, per_dollar, verdict from (select c_mktsegment, count(*) / nullif(cast(sum(cast(c_acctbal as decimal(18, 2))) filter (c_acctbal > 0) as double), 0) as per_dollar, case when avg(c_acctbal) > 0 then 'worth' else 'not' end as verdict from customer group by 1)")
def value_per_dollar(spark, d):
    x = F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("decimal(18,2)"))).cast("double")
    return table(spark, d, "customer").groupBy("c_mktsegment").agg((N() / F.nullif(x, F.lit(0.0))).alias("per_dollar"), F.when(F.avg("c_acctbal") > 0, "worth").otherwise("not").alias("verdict"))
