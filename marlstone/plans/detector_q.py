"""Runs judged against their sources' earlier runs, from raw values to verdict and reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import detector as T
from marlstone.operators.registering import query
from marlstone.sources.records import table

#: Events as two sources of eight runs with planted faults: a constant value, lost values, a failed fetch, drifts of markup and of texts.
RUN = "event_id % 2 as source, cast(floor(event_id / 2.0) as bigint) % 8 as run"
RAW = f"""select source, run, field, v as value, case when v is null then 'empty' else 'matched' end as status, case when field = 'value' and v is not null then try_cast(v as bigint) is not null end as coerced from (
    select source, run, 'value' as field, case when source = 0 and run = 5 then 'Add to cart' when source = 1 and run = 6 and event_id % 5 < 3 then null else cast(cast(round(value * 100) as bigint) as string) end as v from (select *, {RUN} from events)
    union all select source, run, 'who', case when source = 1 and run = 7 then 'Footer' else cast(event_id * 7919 as string) end from (select *, {RUN} from events)
    union all select source, run, 'props', props from (select *, {RUN} from events))"""
PRINTS = f"""select source, run, user_id as key, min(user_id) * 97 + case when source = 1 and run >= 3 then 4503599626321920 else 0 end as text, min(user_id) * 31 + case when source = 0 and run >= 2 then 4503599626321920 else 0 end as dom,
    min(user_id) * 7 + case when run >= 3 - source and source = 1 or source = 0 and run >= 2 then 4503599626321920 else 0 end as val from (select *, {RUN} from events) group by source, run, user_id"""
COHORTS = f"select source, run, count(*) as docs, count(*) as attempted, case when source = 0 and run = 4 then cast(floor(count(*) / 2.0) as bigint) else count(*) end as ok from (select *, {RUN} from events) group by source, run"
#: Invariants as they would have been mined.
MINED = (("value", "range", "0..20000", 800), ("value", "type", "number", 700), ("who", "nonnull", "", 500), ("who", "type", "number", 900), ("props", "pattern", "\\{\"k\": [0-9]+\\}", 600))


def _inputs(spark, d):
    events = table(spark, d, "events")
    over = lambda sql: spark.sql(sql.replace("from events", "from {events}"), events=events)
    values = over(RAW)
    runs = over(COHORTS).join(T.drifts(over(PRINTS)), ["source", "run"], "left").withColumn("healthy", F.lit(True))
    mined = spark.createDataFrame(MINED, "field string, kind string, detail string, support long").crossJoin(spark.range(2).withColumnRenamed("id", "source"))  # two sources of five rows
    return T.sketched(values, exact=True), runs, T.checked(values, mined)


_CHARS = ["sum(length(regexp_replace(value, '[^0-9]', '', 'g')))", "sum(length(regexp_replace(value, '[^A-Za-z]', '', 'g')))", "sum(length(regexp_replace(value, '[^\\s]', '', 'g')))"]
_TV = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))) / 2"
_WILSON = "(({k}) / ({n}) + 3.8416 / (2 * ({n})) {s} 1.96 * sqrt(({k}) / ({n}) * (1 - ({k}) / ({n})) / ({n}) + 3.8416 / (4.0 * ({n}) * ({n})))) / (1 + 3.8416 / ({n}))"


def _z(x: str, series: str, tol: float) -> str:
    dev = f"list_transform({series}, lambda v: abs(v - list_median({series})))"
    d = f"({x} - list_median({series}))"
    return f"case when len({series}) >= 3 then case when list_median({dev}) > 1e-12 then 0.6745 * {d} / list_median({dev}) when list_avg({dev}) > 1e-12 then {d} / (1.253314 * list_avg({dev})) when abs({d}) <= {tol} then 0 else greatest(-25, least(25, {d} / {tol})) end end"


def _rate(name: str, k: str, n: str) -> str:
    return f"case when {n} > 0 and b{n} > 0 and {_WILSON.format(k=k, n=n, s='-')} > {_WILSON.format(k='b' + k, n='b' + n, s='+')} then greatest(0, least(1, ({k} / {n} - b{k} / b{n}) / nullif(1 - b{k} / b{n}, 0))) end as {name}"


JUDGED = f"""with raw as ({RAW}), prints as ({PRINTS}), cohorts as ({COHORTS}),
    lagged as (select *, lag(text) over w as t0, lag(dom) over w as m0, lag(val) over w as v0 from prints window w as (partition by source, key order by run)),
    drift as (select source, run, median(bit_count(xor(text, t0))) / 64 as d_text, median(bit_count(xor(dom, m0))) / 64 as d_dom, median(bit_count(xor(val, v0))) / 64 as d_val from lagged where t0 is not null group by all),
    sk as (select source, run, field, count(*) as n, count(*) filter (value is null) as misses, count(coerced) as tried, count(*) filter (not coerced) as failed, count(value) as held, coalesce(count(distinct value) / nullif(count(value), 0), 0) as dr,
        [{", ".join(f"count(*) filter (value is not null and least(15, floor(log2(greatest(length(value), 1)))) = {k})" for k in range(16))}] as lengths, [{", ".join(_CHARS)}, sum(length(value)) - {" - ".join(_CHARS)}] as chars from raw group by all),
    sh as (select * exclude (lengths, chars), list_transform(lengths, lambda x: case when list_sum(lengths) > 0 then x / list_sum(lengths) else 0 end) as ls, list_transform(chars, lambda x: case when list_sum(chars) > 0 then coalesce(x, 0) / list_sum(chars) else 0 end) as cs from sk),
    fr as (select *, sum(n) over w as bn, sum(misses) over w as bmisses, sum(tried) over w as btried, sum(failed) over w as bfailed, list(dr) over w as drs, list(ls) over w as lss, list(cs) over w as css, max(n) over w as peak from sh window w as (partition by source, field order by run rows between 20 preceding and 1 preceding)),
    ce as (select *, list_transform(range(1, 17), lambda k: list_median(list_transform(lss, lambda p: p[k]))) as lc, list_transform(range(1, 5), lambda k: list_median(list_transform(css, lambda p: p[k]))) as cc, list_median(drs) as usual from fr),
    tv as (select *, {_TV.format(a="ls", b="lc")} as lt, {_TV.format(a="cs", b="cc")} as ct, list_transform(lss, lambda p: {_TV.format(a="p", b="lc")}) as lh, list_transform(css, lambda p: {_TV.format(a="p", b="cc")}) as ch from ce),
    ts as (select source, run, field, n, misses, peak, {_rate("miss_rate", "misses", "n")}, {_rate("coercion_failure_rate", "failed", "tried")},
        case when len(drs) >= 3 and usual >= 0.5 and {_z("dr", "drs", 0.02)} <= -3.5 then greatest(0, (usual - dr) / usual) end as distinct_ratio,
        case when len(lss) >= 3 and lt >= 0.1 and {_z("lt", "lh", 0.1)} >= 3.5 then lt end as length_shape, case when len(css) >= 3 and ct >= 0.1 and {_z("ct", "ch", 0.1)} >= 3.5 then ct end as char_class_shape,
        coalesce(n >= 5 and misses / n >= 0.9 and bn >= 5 and bmisses / bn <= 0.1, false) as collapsed, coalesce(len(drs) >= 3 and usual >= 0.9 and dr <= 0.1, false) as rebound from tv),
    ag as (select source, run, coalesce(greatest(max(miss_rate), max(coercion_failure_rate)), 0) as missrate, coalesce(max(distinct_ratio), 0) as "distinct", coalesce(greatest(max(length_shape), max(char_class_shape)), 0) as shape, max(peak) as peak, bool_or(collapsed) as collapsed, bool_or(rebound) as rebound,
        list_concat({", ".join(f"list('{t}:' || field) filter ({t} is not null)" for t in ("miss_rate", "coercion_failure_rate", "distinct_ratio", "length_shape", "char_class_shape"))}) as fired, list('total_collapse:' || field) filter (collapsed) as gone, list('distinctness_collapse:' || field) filter (rebound) as same from ts group by all),
    iv as (select source, run, field, kind, support, count(*) filter (kind = 'nonnull' or value is not null) as checked, count(*) filter (case kind when 'nonnull' then value is null when 'type' then value is not null and try_cast(value as double) is null when 'range' then try_cast(value as double) not between 0 and 20000 else not regexp_full_match(value, '\\{{"k": [0-9]+\\}}') end) as broke
        from raw join (values ('value', 'range', 800), ('value', 'type', 700), ('who', 'nonnull', 500), ('who', 'type', 900), ('props', 'pattern', 600)) as m (field, kind, support) using (field) group by all),
    ia as (select source, run, sum(case when checked > 0 and broke / checked >= 0.2 then support else 0 end) / sum(support) as invariant, list('invariant:' || kind || ':' || field) filter (checked > 0 and broke / checked >= 0.2) as violations from iv group by all),
    al as (select *, case when d_val >= 0.2 then case when d_text <= 0.08 and d_dom >= 0.2 then 'markup_drift' when d_text <= 0.08 and d_dom <= 0.08 then 'self_inflicted' when d_text > 0.08 and d_dom < 0.2 then 'content_changed' else 'ambiguous' end end as cell from cohorts left join drift using (source, run) join ag using (source, run) join ia using (source, run)),
    sc as (select *, case when cell in ('markup_drift', 'self_inflicted') then 1.0 when cell = 'ambiguous' then 0.5 else 0.0 end as divergence, rebound and case when d_val is null then shape > 0 else coalesce(cell <> 'content_changed', true) end as sure,
        case when ok / attempted < 0.7 then 'inconclusive' when collapsed and docs >= 5 then 'collapsed' when docs < 30 then 'below_cohort' end as gate, case when docs >= 30 then 'full' when peak >= 30 then 'shrunken' else 'chronic' end as cohort from al),
    dg as (select *, case when sure then 1.0 else least(1.0, 0.3 * missrate + 0.2 * "distinct" + 0.2 * invariant + 0.15 * shape + 0.15 * divergence) end as raw,
        case when gate = 'collapsed' then 'field_loss' when gate is null then case when cell in ('markup_drift', 'self_inflicted') then cell else coalesce(case greatest(0.3 * missrate, 0.2 * "distinct", 0.2 * invariant, 0.15 * shape) when 0 then null when 0.15 * shape then 'value_domain_drift' when 0.2 * invariant then 'invariant_break' when 0.2 * "distinct" then 'silent_rebind' else 'field_loss' end, cell) end end as diagnosis from sc)
    select source, run, case when gate = 'collapsed' then 'broken' when gate is not null then gate when raw < 0.6 then 'ok' when diagnosis = 'self_inflicted' then 'self_inflicted' else 'broken' end as verdict, diagnosis, round(case when gate = 'collapsed' then 1.0 when gate is not null then 0.0 else raw end, 4) as score, cohort,
        round(missrate, 6) as missrate, round("distinct", 6) as "distinct", round(invariant, 6) as invariant, round(shape, 6) as shape, divergence,
        array_to_string(list_sort(case gate when 'inconclusive' then ['fetch_ok_rate'] when 'collapsed' then gone when 'below_cohort' then ['cohort_docs:' || cohort] else list_concat(fired, violations, case when sure then same end) end), ',') as reasons from dg"""


def _shown(df):
    return df.select("source", "run", "verdict", "diagnosis", "score", "cohort", *[F.round(k, 6).alias(k) for k in ("missrate", "distinct", "invariant", "shape", "divergence")], F.array_join("reasons", ",").alias("reasons"))


@query(JUDGED)
def run_quality(spark, d):
    """Verdict, diagnosis, terms and reasons of each run, all earlier runs as baseline."""
    return _shown(T.evaluated(*_inputs(spark, d)))


@query()
def run_quality_judged(spark, d):
    """The same with runs judged ok as the only baseline; a test holds it to judging run after run."""
    return _shown(T.judged(*_inputs(spark, d)))
