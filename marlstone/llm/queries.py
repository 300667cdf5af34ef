"""The queries of this subpackage by name, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import ball_kmeans, bpe, exact_dedup, infill, language, media, packing, quality, secrets, simhash, substrings, toxicity, urls
from marlstone.llm.scale import crc32_mod, ship

TOKENIZER = "word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` as an image, edited copies beside those of ids divisible by 100, and each image's class."""
    found = media.image_copies(media.edited_copies(media.rendered_vectors(read(spark, sf_dir, "embeddings"))), "image_id")
    at = F.col("image_id")
    return found.select(at, F.shiftright(at, 3).alias("vec_id"), media.edit_of(at).alias("edit"), "keypoints", "links", "class_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit that repeats an earlier one, with its offsets in the original text."""
    return substrings.repeated_units(read(spark, sf_dir)).drop("text_hash")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack_documents(read(spark, sf_dir), public_tokenizers.path(TOKENIZER), 4096, 1)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.scan_secrets(read(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_dedup(read(spark, sf_dir), words=4, radius=4)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that aren't held out."""
    docs = read(spark, sf_dir)
    grammar = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"), crc32_mod(F.col("doc_id"), 5) != 0)
    return toxicity.score_toxicity(docs, grammar).select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return bpe.encode_digests(read(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    return exact_dedup.exact_dedup(read(spark, sf_dir), digest=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and of its spans, learned from those that aren't held out."""
    docs = read(spark, sf_dir)
    model = language.fit_languages(docs, crc32_mod(F.col("doc_id"), 3) != 1)
    return language.identify_languages(docs, model).select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that aren't held out."""
    docs = read(spark, sf_dir)
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"), crc32_mod(F.col("doc_id"), 5) != 0)
    return quality.score_quality(docs, model).withColumn("held_out", F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False)))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of ``embeddings`` after three rounds from 16 hashed starts."""
    return ball_kmeans.ball_kmeans(read(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64).drop("compared")


#: The rules of the URL filter.
URL_RULES = [urls.Rule("com", "/", "allow"), urls.Rule("example.com", "/en/", "block"), urls.Rule("www.example.com", "/en/", "allow"), urls.Rule("net", "/es/", "block"), urls.Rule("net", "/fr/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every url of ``pages``: by rule, or by trees learned from the urls that rules decide."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.fit_urls(urls.ruled_urls(pages, URL_RULES), F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    return urls.judge_urls(pages, URL_RULES, model)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-middle order: digests of the output and of the text restored from it."""
    out = infill.fill_in_middle(read(spark, sf_dir))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media_copies, op2_substring_dedup, op3_best_fit_packing, op4_secret_scan, op5_simhash_near_dedup, op6_toxicity, op7_bpe_encode_decode, op8_exact_dedup, op9_language_id, op10_quality_classifier, op11_ball_kmeans, op12_url_filter, op13_fill_in_middle, pipeline)}

#: One round of k-means: each vector's nearest centroid, and the floor of the members' means; an empty cluster stays.
ROUND = """
        a{p} as (select vec_id, any_value(v) as v, min_by(c, d * 16 + c) as c from (select vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from kept, c{p}) group by vec_id),
        s{p} as (select c, i, sum(x)::bigint as s, count(*) as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{p}) group by c, i),
        c{n} as (select o.c, coalesce(l.m, o.m) as m from c{p} o left join (select c, list((s - ((s % n) + n) % n) // n order by i) as m from s{p} group by c) l on l.c = o.c),
"""

ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as t from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, sha256(d.t) as text_sha256
        from d join g on d.t = g.t
    """,
    "op11_ball_kmeans": f"""
        with kept as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
        ),
        c0 as (select (row_number() over (order by sha256('1:' || vec_id), v) - 1)::int as c, v as m from kept order by sha256('1:' || vec_id), v limit 16),
        {"".join(ROUND.format(n=n, p=n - 1) for n in (1, 2, 3))}
        a3 as (select vec_id, min_by(c, d * 16 + c)::int as cluster, min(d) as distance from (select vec_id, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept, c3) group by vec_id)
        select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
        from a3 join c3 on c = cluster
    """,
    "op13_fill_in_middle": """
        with t as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
        u as (select *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]', 0, 's') as u, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
        k as (select *, len(u)::bigint as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
            case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
        p as (select *, array_to_string(u[1:a], '') as head, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as tail from k)
        select doc_id, n, form, case when form <> 'plain' then length(head) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>' || head || '<S>' || tail || '<M>' || mid else '<S>' || tail || '<P>' || head || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
        from p
    """,
}
