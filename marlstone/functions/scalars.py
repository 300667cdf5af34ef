"""Scalar functions on strings, dates, money, URLs and codes, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_null(c: Column) -> Column:
    """Trimmed text; null if blank."""
    return F.nullif(F.trim(c), F.lit(""))


def first_text(*columns: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*map(blank_null, columns))


def norm_text(c: Column) -> Column:
    """Letters and digits in lower case, single blanks between."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def slugify(c: Column) -> Column:
    """ASCII letters and digits in lower case, dashes between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def text_list(c: Column) -> Column:
    """Parts between semicolons, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(c, ";"), F.trim), lambda x: x != "")


def month_index(period: Column) -> Column:
    """Months since year 0 of ``YYYY-MM``; null if it isn't one."""
    y, m = F.regexp_extract(period, r"^(\d{4})-(0[1-9]|1[0-2])$", 1), F.regexp_extract(period, r"^(\d{4})-(0[1-9]|1[0-2])$", 2)
    return y.try_cast("int") * 12 + m.try_cast("int") - 1


def parse_date(c: Column) -> Column:
    """A date from ``m/d/Y`` or ``Y-m-d``, the latter also at the start of a timestamp."""
    iso = F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    us = [F.regexp_extract(c, r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$", k) for k in (3, 1, 2)]
    return F.coalesce(iso, F.concat_ws("-", us[0], F.lpad(us[1], 2, "0"), F.lpad(us[2], 2, "0")).try_cast("date"))


def deadline_end(date: Column, instant: Column | None = None) -> Column:
    """The instant if there is one, else noon UTC of the day after the date."""
    end = F.date_add(date, 1).cast("timestamp") + F.expr("interval 12 hours")
    return end if instant is None else F.coalesce(instant, end)


def is_past_due_open(status: Column, end: Column, now: Column) -> Column:
    """An open or forecasted item whose end has passed."""
    return F.coalesce(status.isin("open", "forecasted") & (now > end), F.lit(False))


# Status words of sources and what they mean.
STATUS_WORDS = {"posted": "open", "active": "open", "open": "open", "forecasted": "forecasted", "upcoming": "forecasted", "closed": "closed", "archived": "closed", "expired": "closed"}


def norm_status(c: Column) -> Column:
    """A source's status word in common terms; unknown words in lower case."""
    low = F.lower(F.trim(c))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS_WORDS.items() for x in kv])[low], low)


# What a unit after an amount multiplies it by, and the largest amount that counts.
UNITS = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "mm": 1e6, "k": 1e3, "m": 1e6, "b": 1e9}
LARGEST_AMOUNT = 1_000_000_000_000
#: Digits that may be grouped, up to 18 characters of them, and up to four decimals.
_NUMBER = r"[0-9][0-9,]{0,17}(?:\.[0-9]{1,4})?"
#: A dollar amount: its mark, the number, perhaps a unit, and no digit behind a separator after that.
AMOUNT = rf"(?:\$|\busd)\s*{_NUMBER}\s*(?:{'|'.join(UNITS)})?\b(?![.,][0-9])"


def max_amount_dollars(text: Column) -> Column:
    """The largest dollar amount named in a text, whole dollars, at most a trillion; null if none.

    Amounts carry ``$`` or ``usd`` and may end in k, m, b or their words; what
    a separator and a digit follow is ambiguous and left out.
    """
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    unit = lambda x: F.regexp_extract(x, "[0-9]\\s*([a-z]+)$", 1)
    value = lambda x: F.regexp_replace(x, "[^0-9.]", "").try_cast("double") * F.coalesce(F.try_element_at(units, unit(x)), F.lit(1.0))
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(AMOUNT), F.lit(0)), value)
    return F.array_max(F.filter(found, lambda v: (v > 0) & (v <= LARGEST_AMOUNT))).cast("long")


def scan_amounts(text: Column) -> Column:
    """All positive numbers of a text with k, m and b applied."""
    pattern = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*([kmb])?\b"
    n, u = (F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(k)) for k in (1, 2))
    times = lambda x: F.when(x == "k", 1e3).when(x == "m", 1e6).when(x == "b", 1e9).otherwise(1.0)
    return F.filter(F.zip_with(n, u, lambda a, b: F.regexp_replace(a, ",", "").try_cast("double") * times(b)), lambda v: v > 0)


# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "ref", "ref_src")


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters, query pairs sorted, scheme and host in lower case, no default port, no trailing slash but the root's."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, "^[^:]+://([^/?]*)", 1))
    host = F.when((scheme == "http") & host.endswith(":80"), F.regexp_replace(host, ":80$", "")).when((scheme == "https") & host.endswith(":443"), F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(bare, "^[^:]+://[^/?]*([^?]*)", 1)
    path = F.when(path == "", "/").when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).isin(*TRACKING))
    pairs = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    text = F.array_join(F.array_sort(pairs), "&")
    return F.when(scheme == "", bare).otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")))


def host_of(url: Column) -> Column:
    """Host in lower case, without port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def edge_rel(a: Column, b: Column) -> Column:
    """``internal`` if both URLs have one host."""
    return F.when(host_of(a) == host_of(b), "internal").otherwise("external")


def redact_key(url: Column) -> Column:
    """Values of secret parameters replaced."""
    return F.regexp_replace(url, r"(?i)([?&](?:api_?key|key|token|secret|access_token)=)[^&#]*", "$1***")


def salary_band(amount: Column, step: int) -> Column:
    """Floor to the band, as ``Nk``."""
    return F.concat((F.floor(amount / step) * step / 1000).cast("int").cast("string"), F.lit("k"))


def salary_point(low: Column, high: Column, least: float, most: float) -> Column:
    """Midpoint of two positive ends, else the positive one; null outside the sane band."""
    point = F.when((low > 0) & (high > 0), (low + high) / 2).when(low > 0, low).when(high > 0, high)
    return F.when(point.between(least, most), point)


def unit_group(code: Column) -> Column:
    """First four digits of the last part of a path-like code."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(code, "/"), -1), r"^(\d{4})", 1), F.lit(""))


def eu_amount(c: Column) -> Column:
    """A number with a decimal comma or with grouping."""
    s = F.regexp_replace(F.trim(c), r"[\s ]", "")
    return F.when(s.rlike(r"^-?\d{1,3}(\.\d{3})*,\d+$|^-?\d+,\d{1,2}$"), F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")).when(s.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), F.regexp_replace(s, ",", "")).otherwise(s).try_cast("double")


def start_year(c: Column) -> Column:
    """The first four characters as a year from 1980 to 2100."""
    y = F.substring(c, 1, 4).try_cast("int")
    return F.when(y.between(1980, 2100), y)


def program_title(c: Column) -> Column:
    """Words without fiscal-year marks and years."""
    return F.array_join(F.filter(F.split(F.trim(c), r"\s+"), lambda w: ~F.lower(w).rlike(r"^\(?(fy\d{2,4}|(19|20|21)\d{2})[),.:]*$")), " ")


def disjoint_lists(a: Column, b: Column) -> Column:
    """Both lists have values and share none."""
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), F.lit(False))


def digest_uuid(c: Column) -> Column:
    """The first 16 bytes of SHA-256, written as a UUID."""
    h = F.sha2(c.cast("binary"), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


# Cadence names in seconds.
CADENCE = {"hourly": 3600, "daily": 86_400, "weekly": 604_800, "biweekly": 1_209_600, "monthly": 2_592_000, "quarterly": 7_776_000, "yearly": 31_536_000}


def cadence_secs(name: Column) -> Column:
    """Seconds of a cadence name; null if unknown."""
    return F.create_map(*[F.lit(x) for kv in CADENCE.items() for x in kv])[F.lower(name)]


def freshness_window(cadence: Column, grace: float, contract_hours: Column) -> Column:
    """The shorter of cadence times grace and the contract's hours, in seconds."""
    return F.least(cadence_secs(cadence) * grace, contract_hours * 3600)


def to_number(c: Column) -> Column:
    """The first number of a text, commas as grouping, a sign only right before it."""
    return F.regexp_replace(F.regexp_extract(c, r"((?:(?<![\w])[-+])?\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")


def to_bool(c: Column) -> Column:
    """Usual words for true and false; null otherwise."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "yes", "y", "1", "on"), True).when(low.isin("false", "no", "n", "0", "off"), False)


def ordered_difference(a: Column, b: Column) -> Column:
    """Items of ``a`` that ``b`` lacks, in order."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def covering(flags: list[tuple[Column, str]]) -> Column:
    """The texts whose condition holds."""
    return F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in flags]), lambda x: x.isNotNull())


def any_of(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, columns)
