"""Text sources: archive indexes, sitemaps, robots rules, header-plus-rows tables, CSV with a header to find, catalogs, salvaged JSON."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import jsonv


def cdx(lines: DataFrame, line: str = "value") -> DataFrame:
    """(urlkey, at, url, mime, status, digest, length) of archive index lines; malformed ones are left out."""
    p = F.split(F.trim(line), r"\s+")
    at = F.try_to_timestamp(p[1], F.lit("yyyyMMddHHmmss"))
    return lines.where(F.size(p) >= 7).select(p[0].alias("urlkey"), at.alias("at"), p[2].alias("url"), p[3].alias("mime"), p[4].try_cast("int").alias("status"), F.nullif(p[5], F.lit("-")).alias("digest"), p[6].try_cast("long").alias("length")).where("at is not null")


def snapshots(index: DataFrame, most: int) -> DataFrame:
    """Oldest first, one a digest (those without digest all stay), ``most`` of each URL, and whether there were more."""
    from pyspark.sql import Window

    same = F.row_number().over(Window.partitionBy("url", F.coalesce("digest", F.concat(F.lit("\u0000"), F.col("at").cast("string"), F.coalesce(F.col("length").cast("string"), F.lit(""))))).orderBy("at"))
    kept = index.withColumn("_s", same).where("_s = 1").drop("_s")
    n = F.row_number().over(Window.partitionBy("url").orderBy("at", "digest"))
    total = F.count(F.lit(1)).over(Window.partitionBy("url"))
    return kept.withColumn("_n", n).withColumn("truncated", total > most).where(F.col("_n") <= most).drop("_n")


def sitemap(texts: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, kind, loc, lastmod) of the url and sitemap blocks of each text."""
    blocks = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<(?:url|sitemap)>.*?</(?:url|sitemap)>)"), F.lit(1)))
    b = texts.select(key, blocks.alias("b"))
    pick = lambda t: F.nullif(F.trim(F.regexp_extract("b", rf"(?s)<{t}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{t}>", 1)), F.lit(""))
    return b.select(key, F.regexp_extract("b", "^<(url|sitemap)>", 1).alias("kind"), F.replace(pick("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), pick("lastmod").alias("lastmod")).where("loc is not null")


def robots(text: str) -> tuple[list[tuple[bool, str]], float | None, list[str]]:
    """(rules as (allow, pattern), crawl delay, sitemaps) of the group for all agents."""
    rules, maps, delay, mine, fresh = [], [], None, False, False
    for raw in text.splitlines():
        name, sep, value = raw.split("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not sep:
            continue
        if name == "user-agent":
            mine = value == "*" or (mine and fresh)
            fresh = True
            continue
        fresh = False
        if name == "sitemap":
            maps.append(value)
        elif mine and name in ("allow", "disallow") and value:
            rules.append((name == "allow", value))
        elif mine and name == "crawl-delay":
            try:
                delay = float(value)
            except ValueError:
                pass
    return rules, delay, maps


def robots_regex(pattern: str) -> str:
    """A rule's pattern as an anchored regular expression: * is any text, a last $ the end."""
    end = pattern.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in (pattern[:-1] if end else pattern).split("*")) + ("$" if end else "")


def robots_allowed(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """The longest matching rule decides, allow wins ties; allowed without a match."""
    best = [F.when(path.rlike(robots_regex(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(int(a)).alias("a"))) for a, p in rules]
    if not best:
        return F.lit(True)
    top = F.greatest(*best) if len(best) > 1 else best[0]
    return F.coalesce(top["a"] == 1, F.lit(True))


def census(rows: DataFrame, names: list[str], cells: str = "cells") -> DataFrame:
    """Rows of text cells as named columns; numeric cells that are negative or blank are suppressed (null)."""
    def cell(k: int) -> Column:
        v = F.trim(F.col(cells)[k])
        n = v.try_cast("long")
        return F.when(n.isNull() & (v != ""), None).otherwise(F.when(n >= 0, n))

    return rows.select(*[cell(k).alias(n) if not n.startswith("$") else F.trim(F.col(cells)[k]).alias(n[1:]) for k, n in enumerate(names)])


def csv_columns(header: list[str], wanted: dict[str, list[str]]) -> dict[str, int]:
    """The index of each wanted column by any of its names; ValueError names what is missing."""
    low = [h.strip().lower() for h in header]
    found = {k: next((low.index(n.lower()) for n in names if n.lower() in low), -1) for k, names in wanted.items()}
    if missing := [k for k, at in found.items() if at < 0]:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return found


def csv_with_header(spark: SparkSession, path: str, wanted: dict[str, list[str]]) -> DataFrame:
    """A CSV whose columns go by one of several names, as text under the wanted names."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    at = csv_columns(df.columns, wanted)
    return df.select(*[F.col(f"`{df.columns[k]}`").alias(n) for n, k in at.items()])


def catalog(path: str) -> list[dict]:
    """Sources of a catalog file; none if there is no file, an error if it is malformed."""
    p = Path(path)
    return tomllib.loads(p.read_text(encoding="utf-8")).get("source", []) if p.exists() else []


def salvaged(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, value JSON) of what JSON each text holds; null if none."""
    import pyarrow as pa

    from marlstone.operators.documents import mapped

    def one(t):
        v = jsonv.salvage(t)
        return (None if v is jsonv.MISSING else jsonv.canonical(v),)

    return mapped(df, [text], {"value": ("string", pa.string())}, [key], one)


def write_export(df: DataFrame, path: str, kind: str) -> None:
    """A dataset as json, ndjson or csv (quotes doubled)."""
    w = df.write.mode("error")
    if kind in ("json", "ndjson"):
        w.json(path)
    elif kind == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        raise ValueError(f"export as json, ndjson or csv, not {kind!r}")
