"""Derived datasets: filter, project and look up rows, or group them by count and sum, with incremental upkeep."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.filters import all_of, member, parse_filters, raw_type, trust_label, trust_rank
from marlstone.sources.records import members

#: Groups of more rows are marked stale on incremental upkeep.
MAX_GROUP_SCAN = 10_000
MAX_DEPTH = 3


@dataclass(frozen=True)
class Lookup:
    """Left outer join of a source member to the key of a live dataset, merged whole under one name."""

    dataset: str
    key_expr: str
    merge_as: str


@dataclass(frozen=True)
class Spec:
    """A derived dataset over records of one app."""

    app: str
    source: str
    target: str
    filters: tuple[str, ...] = ()
    project: dict[str, str] = field(default_factory=dict)
    lookup: Lookup | None = None
    group_by: tuple[str, ...] = ()
    aggregates: dict[str, str] = field(default_factory=dict)


def parse_aggregate(text: str) -> str | None:
    """None for ``count``; the path for ``sum($.path)``."""
    if text.strip() == "count":
        return None
    if text.startswith("sum($.") and text.endswith(")"):
        return text[4:-1]
    raise ValueError(f"an aggregate is count or sum($.path): {text!r}")


def field_name(path: str) -> str:
    """The last member of a path."""
    return path.rsplit(".", 1)[-1].removeprefix("$")


def validate(spec: Spec) -> None:
    """Group specs need paths and aggregates with names of their own; ``stale`` is reserved."""
    if not spec.group_by and not spec.aggregates:
        return
    names = [field_name(p) for p in spec.group_by] + list(spec.aggregates)
    if not spec.group_by or not spec.aggregates:
        raise ValueError("a group spec needs group paths and aggregates")
    if len(set(names)) < len(names) or "stale" in names:
        raise ValueError("names of groups and aggregates are unique, and stale is reserved")
    for a in spec.aggregates.values():
        parse_aggregate(a)


def reaches(edges: dict[str, set[str]], start: str, goal: str) -> bool:
    """Whether ``goal`` can be reached from ``start``, itself included."""
    seen, work = set(), [start]
    while work:
        x = work.pop()
        if x == goal:
            return True
        if x not in seen:
            seen.add(x)
            work += edges.get(x, ())
    return False


def accept(specs: list[Spec], new: Spec) -> None:
    """Refuse a spec that closes a cycle or makes a chain longer than ``MAX_DEPTH``."""
    validate(new)
    edges: dict[str, set[str]] = {}
    for s in specs:
        edges.setdefault(s.source, set()).add(s.target)
    if reaches(edges, new.target, new.source):
        raise ValueError(f"{new.source} is derived from {new.target}")
    back: dict[str, set[str]] = {}
    for s in [*specs, new]:
        back.setdefault(s.target, set()).add(s.source)
    depth = lambda x: 1 + max(map(depth, back[x])) if x in back else 0
    if depth(new.target) > MAX_DEPTH:
        raise ValueError("the chain of derived datasets is too long")


def row_values(spec: Spec, records: DataFrame) -> DataFrame:
    """(key, data, trust) of a row spec: filters in memory mode, projection without missing members, lookup under one name.

    A lookup without match leaves its member out. The result's trust is the
    weakest of all inputs. The lookup's live side is joined by key and left to
    adaptive execution to broadcast if it turns out small.
    """
    src = records.where((F.col("app") == spec.app) & (F.col("dataset") == spec.source) & F.col("removed_at").isNull())
    src = src.where(all_of(parse_filters(list(spec.filters)), F.col("data"), "memory", members(records)))
    fields = {out: member(F.col("data"), p) for out, p in spec.project.items()}
    if spec.lookup is None:
        data = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])) if fields else F.col("data")
        return src.select("key", data.alias("data"), trust_label(F.col("trust")).alias("trust"))
    other = records.where((F.col("app") == spec.app) & (F.col("dataset") == spec.lookup.dataset) & F.col("removed_at").isNull())
    other = other.select(F.col("key").alias("_key"), F.col("data").alias("_data"), F.col("trust").alias("_trust"))
    joined = src.join(other, member(F.col("data"), spec.lookup.key_expr) == F.col("_key"), "left")
    weakest = F.greatest(F.struct(trust_rank(F.col("trust")).alias("r"), trust_label(F.col("trust")).alias("l")), F.when(F.col("_key").isNotNull(), F.struct(trust_rank(F.col("_trust")).alias("r"), trust_label(F.col("_trust")).alias("l"))))["l"]
    parts = [F.concat(F.lit(f'"{n}":'), F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)) for n, c in fields.items()]
    parts = [F.when(c.isNotNull(), p) for p, c in zip(parts, fields.values(), strict=True)]
    parts.append(F.when(F.col("_key").isNotNull(), F.concat(F.lit(f'"{spec.lookup.merge_as}":'), F.col("_data"))))
    return joined.select("key", F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}")).alias("data"), weakest.alias("trust"))


def group_columns(spec: Spec, typed: dict[str, tuple[Column, str]] | None = None) -> tuple[list[Column], Column]:
    """Group texts, and whether all of them are strings or numbers; members held in typed columns are taken there."""
    data, typed = F.col("data"), typed or {}
    ok = [typed[p][0].isNotNull() if p in typed else F.coalesce(raw_type(data, p).isin("string", "number"), F.lit(False)) for p in spec.group_by]
    texts = [typed[p][0].cast("string") if p in typed else member(data, p) for p in spec.group_by]
    return [t.alias(field_name(p)) for t, p in zip(texts, spec.group_by, strict=True)], reduce(lambda a, b: a & b, ok)


def number_of(path: str, typed: dict[str, tuple[Column, str]]) -> Column:
    """The member where it is a number, else null."""
    if path in typed:
        return typed[path][0].cast("double") if typed[path][1] == "number" else F.lit(None).cast("double")
    return F.when(raw_type(F.col("data"), path) == "number", member(F.col("data"), path).try_cast("double"))


def group_values(spec: Spec, records: DataFrame, only: DataFrame | None = None, max_scan: int | None = None) -> DataFrame:
    """One row a group: its texts and aggregates; with ``only``, groups named there; ``stale`` tells those of more than ``max_scan`` rows, whose values are exact all the same.

    Rows whose group members aren't all strings or numbers belong to no group.
    """
    validate(spec)
    src = records.where((F.col("app") == spec.app) & (F.col("dataset") == spec.source) & F.col("removed_at").isNull())
    typed = members(records)
    src = src.where(all_of(parse_filters(list(spec.filters)), F.col("data"), "memory" if only is None else "sql", typed))
    groups, ok = group_columns(spec, typed)
    names = [field_name(p) for p in spec.group_by]
    sums = {n: parse_aggregate(a) for n, a in spec.aggregates.items()}
    rows = src.where(ok).select(*groups, *[number_of(p, typed).alias(f"_{n}") for n, p in sums.items() if p])
    if only is not None:
        rows = rows.join(only.select(*names).distinct(), names, "left_semi")
    aggs = [(F.count(F.lit(1)) if p is None else F.coalesce(F.sum(f"_{n}"), F.lit(0.0))).alias(n) for n, p in sums.items()]
    out = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    if max_scan is not None:
        out = out.withColumn("stale", F.col("_rows") > max_scan)
    return out.drop("_rows")


def affected_groups(spec: Spec, fresh: DataFrame) -> DataFrame:
    """Groups that a batch of changes touches: by the new data, and by the old where a member changed."""
    names = [field_name(p) for p in spec.group_by]
    both = [fresh.select(*[member(F.col(c), p).alias(n) for n, p in zip(names, spec.group_by, strict=True)]) for c in ("data", "previous")]
    return both[0].unionByName(both[1]).where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])).distinct()


def integral_text(c: Column) -> Column:
    """A sum as text: without a point if it is integral and fits 64 bits."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 9.2e18), c.cast("long").cast("string")).otherwise(c.cast("string"))
