"""Full-text search over documents: postings, BM25, phrases, fuzzy terms, filters, facets."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Request:
    """A search: all words of ``must`` phrases included, any of ``terms`` scored."""

    terms: tuple[str, ...]
    phrase: tuple[str, ...] = ()
    equal: dict[str, str] = field(default_factory=dict)
    at_least: dict[str, float] = field(default_factory=dict)
    fuzzy: bool = False
    newest: bool = False
    limit: int = 20
    offset: int = 0


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def near(a: Column, b: str) -> Column:
    """Within one edit, a swap of neighbours counted as one."""
    n = len(b)
    swaps = [b[:k] + b[k + 1] + b[k] + b[k + 2 :] for k in range(n - 1)]
    one = F.coalesce(F.levenshtein(a, F.lit(b), 1), F.lit(-1)) >= 0
    return (F.length(a).between(n - 1, n + 1) & one) | a.isin(*swaps) if swaps else one


def scored(docs: DataFrame, q: Request, key: str, text: str) -> DataFrame:
    """(key, score and the filter columns) of documents with any term, filters applied; BM25 with the corpus's own statistics.

    Only the query's terms are exploded; document length comes from the array's
    size, so the corpus isn't turned into postings for one query. Statistics
    are one row, joined by broadcast.
    """
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, words(F.coalesce(F.col(text), F.lit(""))).alias("_w")).withColumn("_n", F.size("_w"))

    def hit(term: str, w: Column) -> Column:
        return near(w, term) if q.fuzzy else w == term

    tf = [F.size(F.filter("_w", partial(hit, t))) for t in q.terms]
    rows = rows.withColumns({f"_tf{k}": c for k, c in enumerate(tf)})
    stats = rows.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(f"_tf{k}") > 0).alias(f"_df{k}") for k in range(len(tf))])
    rows = rows.crossJoin(F.broadcast(stats))  # stats is a single row
    score = F.lit(0.0)
    for k in range(len(tf)):
        t, df = F.col(f"_tf{k}"), F.col(f"_df{k}")
        idf = F.log(1 + (F.col("_docs") - df + 0.5) / (df + 0.5))
        score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))
    out = rows.withColumn("score", score).where("score > 0")
    if q.phrase:
        joined = F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" "))
        out = out.where(F.contains(joined, F.lit(f" {' '.join(q.phrase)} ")))
    for c, v in q.equal.items():
        out = out.where(F.col(c) == v)
    for c, v in q.at_least.items():
        out = out.where(F.col(c) >= v)
    return out.select(*keep, "score")


def top(hits: DataFrame, q: Request, key: str, newest_by: str | None = None) -> DataFrame:
    """A page of hits, by score or newest, ties by key."""
    order = F.desc(newest_by) if q.newest and newest_by else F.desc(F.round("score", 9))
    return hits.orderBy(order, key).offset(q.offset).limit(q.limit)


def facets(hits: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of the given columns over the hits."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return hits.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def snippet(text: Column, term: str, around: int = 60) -> Column:
    """A fragment with the first hit marked."""
    at = F.locate(term, F.lower(text))
    part = F.substring(text, F.greatest(F.lit(1), at - around), F.lit(2 * around + len(term)))
    return F.when(at > 0, F.regexp_replace(part, f"(?i)({term})", "<b>$1</b>"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, positions): the inverted index as a table, to be written and pruned by term."""
    rows = docs.select(key, F.posexplode(words(F.coalesce(F.col(text), F.lit("")))).alias("pos", "term"))
    return rows.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
