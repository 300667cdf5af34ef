"""Plugin hooks as a table function: a predicate and then a transform over the JSON of each row, callable from SQL with PARTITION BY.

``select * from plugin_hooks(table(events) partition by (event_type), 'props', 'gate', 'slim', '{"keep": ["k"]}')``
gives every input column, and what the hooks made of the row. A plugin is a
function of (object, parameters); a row that makes one fail is let through
unchanged with its error, and other rows don't notice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marlstone.sources.shipping import ship

PLUGINS: dict[str, Callable[[Any, dict], Any]] = {}


def plugin(name: str) -> Callable:
    """Register a function of (object, parameters) as a plugin."""

    def keep(f: Callable) -> Callable:
        PLUGINS[name] = f
        return f

    return keep


@plugin("gate")
def gate(delta: Any, params: dict) -> dict:
    """Passes deltas of at least ``min_count`` changes, and of ``datasets`` where these are named."""
    named = params.get("datasets")
    return {"pass": delta.get("count", 0) >= params.get("min_count", 1) and (not named or delta.get("dataset") in named)}


@plugin("slim")
def slim(delta: Any, params: dict) -> dict:
    """Only the keys of ``keep``; all where it isn't given. What is no object becomes an empty one."""
    if not isinstance(delta, dict):
        return {"slimmed": True}
    keep = params.get("keep")
    return (delta if keep is None else {k: delta[k] for k in keep if k in delta}) | {"slimmed": True}


def passes(out: Any) -> bool | None:
    """A predicate's answer: a boolean, or an object's boolean ``pass``; None if it is neither."""
    if isinstance(out, dict):
        out = out.get("pass")
    return out if isinstance(out, bool) else None


RESULT = (("hook_kind", StringType()), ("verdict", StringType()), ("shaped", StringType()), ("error", StringType()), ("calls", LongType()), ("errors", LongType()), ("micros", LongType()))


class PluginHooks:
    """The table function. After a partition's rows (``hook_kind`` row) comes one of ``stats``: calls, errors and time of the partition.

    ``verdict`` is pass, stop (the predicate said no: the transform isn't run)
    or open (the predicate failed or gave no verdict: the row goes on).
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, predicate: AnalyzeArgument, transform: AnalyzeArgument, params: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("plugin_hooks takes a table first")
        if column.value not in rows.dataType.names:
            raise ValueError(f"the table has no column {column.value!r}")
        for arg in (predicate, transform):
            if arg.value is not None and arg.value not in PLUGINS:
                raise ValueError(f"no plugin named {arg.value!r}; there are {sorted(PLUGINS)}")
        if not isinstance(json.loads(params.value or "{}"), dict):
            raise ValueError("parameters are a JSON object")
        taken = {n.lower() for n in rows.dataType.names} & {n for n, _ in RESULT}
        if taken:
            raise ValueError(f"the table has columns of the result's names: {sorted(taken)}")
        return AnalyzeResult(StructType([*(StructField(f.name, f.dataType, True) for f in rows.dataType.fields), *(StructField(n, k) for n, k in RESULT)]))

    def __init__(self) -> None:
        self.calls = self.errors = self.micros = self.width = 0

    def call(self, name: str, value: Any, params: dict) -> tuple[Any, str | None]:
        began = time.perf_counter_ns()
        self.calls += 1
        try:
            return PLUGINS[name](value, params), None
        except Exception as e:  # the plugin's own fault, whatever it is: told in the row
            self.errors += 1
            return None, f"{name}: {type(e).__name__}: {e}"[:500]
        finally:
            self.micros += (time.perf_counter_ns() - began) // 1000

    def eval(self, row, column: str, predicate: str | None, transform: str | None, params: str | None) -> Iterator[tuple]:
        self.width = len(row)
        text, args, verdict, error = row[column], json.loads(params or "{}"), "pass", None
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            value = None
        if predicate is not None:
            out, error = self.call(predicate, value, args)
            said = None if error else passes(out)
            verdict = "open" if said is None else "pass" if said else "stop"
            if said is None and error is None:
                error = f"{predicate}: no verdict"
        shaped = text if verdict != "stop" else None
        if transform is not None and verdict != "stop":
            out, failed = self.call(transform, value, args)
            if failed is None:
                shaped = json.dumps(out, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            error = failed or error
        yield (*row, "row", verdict, shaped, error, None, None, None)

    def terminate(self) -> Iterator[tuple]:
        if self.width:
            yield (*[None] * self.width, "stats", None, None, None, self.calls, self.errors, self.micros)


def register_hooks(spark: SparkSession, name: str = "plugin_hooks") -> None:
    """Make the table function callable from this session's SQL."""
    ship(spark)
    spark.udtf.register(name, udtf(PluginHooks))
