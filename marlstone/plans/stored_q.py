"""Queries over tables that outlive a job: the search index, and stores whose records are deleted."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import documents as D
from marlstone.operators import search_index as X
from marlstone.operators import tiers
from marlstone.operators.registering import query
from marlstone.operators.search import Request
from marlstone.plans.documents_q import BM25, WORDS
from marlstone.sources.records import table
from marlstone.sources.stored import fresh_path
from marlstone.streaming import keyed


def _built(spark, d) -> X.Index:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return X.build(docs, X.Index(fresh_path(spark, "index"), "doc_id", "text", ("lang", "source", "n_chars"), slots=4, buckets=8))


def _top(spark, index, q):
    return X.search(spark, index, q).select("doc_id", F.round("score", 6).alias("score"))


@query(BM25 + "select doc_id, round(score, 6) as score from h where score > 0 order by round(score, 9) desc, doc_id limit 50")
def stored_search_topk(spark, d):
    return _top(spark, _built(spark, d), WORDS)


@query(BM25 + "select doc_id, round(score, 6) as score from h where score > 0 and lang = 'de' and source is not null order by round(score, 9) desc, doc_id limit 10 offset 5")
def stored_search_filtered(spark, d):
    return _top(spark, _built(spark, d), Request(("the", "und"), equal={"lang": "de"}, limit=10, offset=5))


CHANGED = BM25.replace("from documents)", "from (select doc_id, lang, source, case when doc_id % 10 = 3 then 'und und the ' || coalesce(text, '') else text end as text from documents where lang is distinct from 'fr' and doc_id % 7 <> 0))", 1)


def _changed(spark, d) -> X.Index:
    """The index after an upsert, a deletion by id and a deletion by column."""
    index = _built(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    X.upsert(spark, index, docs.where("doc_id % 10 = 3").withColumn("text", F.concat(F.lit("und und the "), F.coalesce("text", F.lit("")))))
    X.delete_where(spark, index, {"lang": "fr"})
    X.delete_keys(spark, index, docs.where("doc_id % 7 = 0").select("doc_id"))
    return index


@query(CHANGED + "select doc_id, round(score, 6) as score from h where score > 0 order by round(score, 9) desc, doc_id limit 50")
def stored_search_after_changes(spark, d):
    return _top(spark, _changed(spark, d), WORDS)


@query(CHANGED.split(",\n")[0] + " select count(*) as docs, coalesce(sum(len(w)), 0)::bigint as words, (select count(distinct x) from (select unnest(w) as x from w)) as terms from w")
def stored_index_stats(spark, d):
    """Figures of the changed index agree with the corpus that it should hold."""
    return X.stats(spark, _changed(spark, d)).select("docs", "words", "terms")


@query(BM25 + "select doc_id from h where score > 0 and contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def stored_search_phrase(spark, d):
    return X.hits(spark, _built(spark, d), Request(("the", "und"), phrase=("of", "the"))).select("doc_id")


FETCHES = "select case when user_id % 3 = 0 then 'Hot.example' else 'h' || cast(user_id % 40 as string) || '.example' end as host, event_id * 100.0 as moment, event_id as tie, case when event_id % 11 = 0 then 'http' when event_id % 4 = 0 then 'claude' else 'browser' end as winner, event_id % 7 <> 3 as http_lost from events"
TIERS = f"""with w as (select lower(host) as host, moment, tie, coalesce(winner = 'http', false) as reset, case when winner = 'http' then 0 else 1 end as strike from ({FETCHES}) where winner = 'http' or http_lost),
    g as (select *, sum(case when reset or moment - 4000.0 > last_at then 1 else 0 end) over (partition by host order by moment, tie) as run from (select *, lag(moment) over (partition by host order by moment, tie) as last_at from w)),
    r as (select host, run, sum(strike) as strikes, max(moment) as updated_at, count(*) as n from g group by host, run)
    select host, max_by(strikes, run)::bigint as strikes, case when max_by(strikes, run) >= 3 then 'browser' end as preferred, max(updated_at)::double as updated_at, sum(n)::bigint as observations from r group by host"""


@query(TIERS)
def tier_memory(spark, d):
    """Strikes and pins of hosts over their fetches; a third of all rows are one host's."""
    fetches = spark.sql(FETCHES.replace("from events", "from {events}"), events=table(spark, d, "events")).withColumn("at", F.col("moment").cast("double"))
    return tiers.memory(fetches, 4000.0, 20_000.0)


@query()
def near_of_kept_stream(spark, d):
    """The documents' fingerprints as a stream: kept, or near to an earlier kept one of the same language. A test holds the stream to a fold."""
    prints = fresh_path(spark, "prints")
    both = D.text_simhash(table(spark, d, "documents"), "doc_id", "text").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    both.select(F.coalesce("lang", F.lit("")).alias("scope"), F.col("doc_id").alias("seq"), F.col("simhash").alias("fingerprint")).write.parquet(prints)
    stream = spark.readStream.schema("scope string, seq long, fingerprint long").parquet(prints)
    return keyed.collected(keyed.near_of_kept(stream, 3), fresh_path(spark, "kept"), fresh_path(spark, "checkpoint"))().select(F.col("seq").alias("doc_id"), "kept", "near")
