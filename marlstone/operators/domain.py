"""Domain kernels: grants, census, labour, releases, crawl frontier, retention, lineage, metrics, plugins."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import jsonv
from marlstone.functions.scalars import blank_null, norm_text

# --- enrichment ------------------------------------------------------------

# Words that mark a deadline, within so many bytes before a date; how months begin, endings of a day; days of grace and horizon.
DEADLINE_WORDS = re.compile(r"\b(deadline|due|clos|expir|apply|submit|submission|respond|end[_\s-]?date)")
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAY_ENDINGS = ("st", "nd", "rd", "th")
WINDOW, GRACE, HORIZON = 120, timedelta(days=1), timedelta(days=3650)


TOKEN = re.compile("[0-9]+|[a-z]+|[^0-9a-z]+")


def written_dates(low: str) -> Iterator[tuple[int, int, int, int]]:
    """(place, year, month, day) of what reads like a date of this century in a lower-case text.

    Three forms: year-month-day (a time may follow after a t), month/day/year,
    and a month's name with day and year. A date is no part of a longer word or number.
    """
    tokens = [(m.start(), m[0]) for m in TOKEN.finditer(low)]
    words = [w for _, w in tokens] + [""] * 8
    joins = lambda c: c.isalnum() or c == "_"
    is_year = lambda w: len(w) == 4 and w.startswith("20") and w.isdigit()
    short = lambda w: len(w) <= 2 and w.isdigit()
    for k, (at, first) in enumerate(tokens):
        if k and joins(words[k - 1][-1]):
            continue
        _, gap, middle, gap2, last, after, more, colon = words[k : k + 8]
        ends = not after or not joins(after[0])
        if gap == gap2 == "-" and is_year(first) and short(middle) and short(last):
            if ends or after == "t" and len(more) == 2 and more.isdigit() and colon.startswith(":"):
                yield at, int(first), int(middle), int(last)
        elif gap == gap2 == "/" and short(first) and short(middle) and is_year(last) and ends:
            yield at, int(last), int(first), int(middle)
        elif first[:3] in MONTHS and gap.removeprefix(".").isspace() and short(middle):
            if gap2 in DAY_ENDINGS:
                gap2, last, after = last, after, more
            if gap2.removeprefix(",").isspace() and is_year(last) and not (after and joins(after[0])):
                yield at, int(last), MONTHS.index(first[:3]) + 1, int(middle)


def upcoming_deadline(text: str | None, now: int) -> int | None:
    """Seconds of the earliest date from a day before ``now`` to ten years on that a deadline word precedes; None without."""
    low, at, found = (text or "").lower(), datetime.fromtimestamp(now, timezone.utc), []
    for place, year, month, day in written_dates(low):
        if not DEADLINE_WORDS.search(low[max(0, place - WINDOW) : place].encode()[-WINDOW:].decode(errors="ignore")):
            continue
        try:
            t = datetime(year, month, day, tzinfo=timezone.utc)
        except ValueError:
            continue
        if at - GRACE <= t <= at + HORIZON:
            found.append(int(t.timestamp()))
    return min(found, default=None)


def deadlines(df: DataFrame, key: str, text: str, now: str) -> DataFrame:
    """(key, event_date) of each text, relative to its own ``now`` in seconds."""
    from marlstone.operators.documents import mapped

    return mapped(df, [text, now], {"event_date": ("long", pa.int64())}, [key], lambda t, n: (upcoming_deadline(t, n or 0),))


# --- grants ----------------------------------------------------------------


def unified(df: DataFrame, source: str, fields: dict[str, Column]) -> DataFrame:
    """A source's rows in the common schema; what it lacks is null."""
    names = ("key", "title", "agency", "status", "open_date", "close_date", "amount_min", "amount_max")
    return df.select(F.lit(source).alias("source"), *[fields.get(n, F.lit(None)).cast("string" if n in ("key", "title", "agency", "status") else "date" if n.endswith("date") else "double").alias(n) for n in names])


def relation(a: DataFrame, b: DataFrame, pairs: DataFrame, key: str, title: str, opened: str, closed: str, within: int = 45) -> DataFrame:
    """(a, b, relation): duplicate for equal titles and overlapping windows, recurrence for a gap near whole years, else none."""
    x, y = (df.select(F.col(key).alias(n), norm_text(F.col(title)).alias(f"t{n}"), F.col(opened).alias(f"o{n}"), F.col(closed).alias(f"c{n}")) for df, n in ((a, "a"), (b, "b")))
    j = pairs.join(x, "a").join(y, "b")
    gap = F.abs(F.datediff("ob", "oa"))
    years = F.greatest(F.lit(1), F.round(gap / 365.25))
    apart = (F.col("ca") < F.col("ob")) | (F.col("cb") < F.col("oa"))
    rel = F.when(~apart & (F.col("ta") == F.col("tb")), "duplicate").when(apart & (years <= 3) & (F.abs(gap - years * 365.25) <= within), "recurrence").otherwise("none")
    return j.select("a", "b", rel.alias("relation"))


def cutoff(dates: Column, now: Column) -> Column:
    """The earliest date that isn't past, else the latest."""
    ahead = F.array_min(F.filter(dates, lambda d: d >= now))
    return F.coalesce(ahead, F.array_max(dates))


# --- labour and census -----------------------------------------------------


def premium(df: DataFrame, group: str, level: str, value: str) -> DataFrame:
    """(group, level, median, premium): each level's median against its group's."""
    a = df.groupBy(group, level).agg(F.median(value).alias("median"))
    b = df.groupBy(group).agg(F.median(value).alias("_g"))
    return a.join(b, group).select(group, level, "median", (F.col("median") - F.col("_g")).alias("premium"))


def skill_share(df: DataFrame, group: str, skills: str) -> DataFrame:
    """(group, skill, n, share): how many of a group's rows name the skill."""
    total = df.groupBy(group).agg(F.count(F.lit(1)).alias("_t"))
    n = df.select(group, F.explode(F.array_distinct(skills)).alias("skill")).groupBy(group, "skill").agg(F.count(F.lit(1)).alias("n"))
    return n.join(total, group).select(group, "skill", "n", (F.col("n") / F.col("_t")).alias("share"))


def suppressed_sum(c: Column) -> list[Column]:
    """Sum of the known values and how many are suppressed."""
    return [F.sum(c).alias("total"), F.count_if(c.isNull()).alias("suppressed")]


def topic_stats(df: DataFrame, family: str, orgs: str, amount: str, year: str, k: int) -> DataFrame:
    """A row a family: rows, known sum and mean, distinct organisations, years, the ``k`` most frequent organisations."""
    base = df.groupBy(family).agg(F.count(F.lit(1)).alias("projects"), F.sum(amount).alias("known_sum"), F.avg(amount).alias("known_mean"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    n = df.select(family, F.explode(F.array_distinct(orgs)).alias("org")).groupBy(family, "org").agg(F.count(F.lit(1)).alias("n"))
    r = n.withColumn("_r", F.row_number().over(Window.partitionBy(family).orderBy(F.desc("n"), "org")))
    top = r.groupBy(family).agg(F.count(F.lit(1)).alias("orgs"), F.array_compact(F.sort_array(F.collect_list(F.when(F.col("_r") <= k, F.struct("_r", "org")))).getField("org")).alias("top_orgs"))
    return base.join(top, family, "left")


# --- crawl -----------------------------------------------------------------


def frontier(urls: DataFrame, host: str, order: list[str], per_host: int, total: int) -> DataFrame:
    """Round-robin over hosts: each host's n-th URL in round n, at most ``per_host`` of each and ``total`` in all."""
    n = F.row_number().over(Window.partitionBy(host).orderBy(*order))
    return urls.withColumn("round", n).where(F.col("round") <= per_host).orderBy("round", host).limit(total)


def ledger(before: DataFrame, today: DataFrame, key: str) -> DataFrame:
    """(key, state): opened, open, closed, by the keys of two days."""
    a, b = before.select(key, F.lit(1).alias("_a")).distinct(), today.select(key, F.lit(1).alias("_b")).distinct()
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "opened").when(F.col("_b").isNull(), "closed").otherwise("open").alias("state"))


# Phrases of challenge pages, and the characters from a page's start in which they count.
CHALLENGES = (
    "attention required", "captcha", "cf-browser-verification", "checking your browser", "ddos protection by", "enable javascript", "just a moment", "please enable cookies", "verify you are human",
)
CHALLENGE_CHARS = 4096


def bot_wall(status: Column, body: Column) -> Column:
    """A page that blocks machines: its status, or the words of a challenge at its start."""
    top = F.lower(F.substring(body, 1, CHALLENGE_CHARS))
    return status.isin(403, 429, 503) | top.rlike("|".join(CHALLENGES))


def template_url(url: Column) -> Column:
    """Query values replaced by their names in braces."""
    return F.regexp_replace(url, r"([?&])([^=&#]+)=([^&#]*)", "$1$2={$2}")


def recipe_overlap(leaves: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """(key, hits, score): how many of the wanted values each response holds."""
    n = wanted.select(value).distinct().count()
    hits = leaves.select(key, value).distinct().join(F.broadcast(wanted.select(value).distinct()), value, "left_semi") if n <= 100_000 else leaves.select(key, value).distinct().join(wanted.select(value).distinct(), value, "left_semi")
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("hits")).withColumn("score", F.col("hits") / n)


# --- lineage, retention, metrics -------------------------------------------


def lineage(spark, specs: list[tuple[str, str]]) -> DataFrame:
    """(upstream, downstream, kind) edges of derived datasets."""
    return spark.createDataFrame([(a, b, "TRANSFORMED") for a, b in specs], "upstream string, downstream string, kind string")


def retention(files: DataFrame, pinned: DataFrame, path: str, at: str, app: str, size: str, cutoff: Column) -> DataFrame:
    """(app, reason, files, bytes): pinned, kept by age, or reclaimable, in that order."""
    j = files.join(pinned.select(F.col(path).alias("_p")).distinct(), F.col(path) == F.col("_p"), "left")
    reason = F.when(F.col("_p").isNotNull(), "pinned").when(F.col(at) >= cutoff, "window").otherwise("reclaimable")
    return j.groupBy(app, reason.alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))


def metrics(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """(metric, label, value) of frames that have a label and a value."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("metric"), F.col(label).cast("string").alias("label"), F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def simhash_moves(rows: DataFrame, key: str, text: str, stored: str) -> DataFrame:
    """(key, simhash) of rows whose stored fingerprint isn't the text's any more."""
    from marlstone.operators.documents import text_simhash

    now = text_simhash(rows, key, text)
    return now.join(rows.select(key, stored), key).where(F.col("simhash") != F.col(stored)).select(key, "simhash")


# --- plugins ---------------------------------------------------------------


class Registry:
    """Named functions (document, parameters) -> JSON value, run over a column in one Arrow pass; a failure is a class, not an error."""

    def __init__(self):
        self.known: dict[str, Callable] = {}

    def add(self, name: str, f: Callable) -> None:
        if not re.fullmatch("[a-z][a-z0-9-]*", name):
            raise ValueError(f"not a plugin name: {name!r}")
        self.known[name] = f

    def run(self, df: DataFrame, name: str, key: str, column: str, params: dict) -> DataFrame:
        """(key, value JSON, outcome) with outcome ok, empty or trap."""
        from marlstone.operators.documents import mapped

        f = self.known[name]

        def one(doc):
            try:
                v = f(doc, params)
            except Exception:
                return None, "trap"
            return (None, "empty") if v is None or v in ("", [], {}) else (jsonv.canonical(v), "ok")

        return mapped(df, [column], {"value": ("string", pa.string()), "outcome": ("string", pa.string())}, [key], one)


def kept_keys(value: Iterator | dict, keys: list[str]) -> dict:
    """An object's listed members."""
    return {k: value[k] for k in keys if k in value}


def text_or(c: Column, other: Column) -> Column:
    return F.coalesce(blank_null(c), other)
