"""Keyed state in streams: near duplicates of what was kept, and the tier memory of hosts. State lies in RocksDB, is checkpointed, and survives restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from marlstone.functions.fingerprints import signed
from marlstone.operators.tiers import PINNED, STRIKE_LIMIT
from marlstone.sources.shipping import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fingerprints of one state entry: a full one is never written again.
CHUNK = 512


def with_state_store(df: DataFrame) -> DataFrame:
    """``df`` with a session that can hold composite state, and this package on the executors."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df


# --- near duplicates -------------------------------------------------------


def bands(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, mask) of ``distance`` + 1 bands: two fingerprints within the distance agree in one of them."""
    edges = [k * bits // (distance + 1) for k in range(distance + 2)]
    return [(a, (1 << b - a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


class NearKept(StatefulProcessor):
    """Keeps a row if no kept one of its scope is within the distance; rows of a batch in order of ``seq``.

    Kept fingerprints lie in a map by (band, its value, chunk), so a row reads
    only the fingerprints that share a band with it.
    """

    def __init__(self, distance: int):
        self.bands, self.distance = bands(distance), distance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "band int, value long, chunk int", "prints binary")

    def bucket(self, held: dict, any_: bool, band: int, value: int) -> list:
        """[fingerprints, their number, how many of them state has] of a band's value; read from state once a batch."""
        found = held.get((band, value))
        if found is None:
            parts = []
            while any_ and (x := self.kept.getValue((band, signed(value), len(parts)))) is not None:
                parts.append(np.frombuffer(x[0], np.uint64))
                if len(parts[-1]) < CHUNK:
                    break
            prints = np.concatenate([*parts, np.zeros(8, np.uint64)])
            found = held[band, value] = [prints, len(prints) - 8, len(prints) - 8]
        return found

    def near(self, fp: int, held: dict, any_: bool) -> int | None:
        """A kept fingerprint within the distance; without one, ``fp`` is put to the kept ones."""
        buckets = [self.bucket(held, any_, band, fp >> shift & mask) for band, (shift, mask) in enumerate(self.bands)]
        one = np.uint64(fp)
        for prints, n, _ in buckets:
            if n:
                close = np.bitwise_count(prints[:n] ^ one) <= self.distance
                if (at := int(close.argmax())) or close[0]:
                    return int(prints[at])
        for x in buckets:
            if x[1] == len(x[0]):
                x[0] = np.concatenate([x[0], np.zeros(len(x[0]), np.uint64)])
            x[0][x[1]] = one
            x[1] += 1
        return None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The batch's share of one scope, three numbers a row; files per trigger bound it. Each bucket that it touches is read once and written once.
        batch = pd.concat(rows).sort_values(["seq", "none", "print"], kind="stable")
        found, held, any_ = [], {}, self.kept.exists()
        for seq, print_, none in zip(batch["seq"].tolist(), batch["print"].tolist(), batch["none"].tolist(), strict=True):
            if print_ == 0:  # no words, nothing to be near to
                found.append((seq, None if none else 0, True, None))
                continue
            other = self.near(print_ & (1 << 64) - 1, held, any_)
            found.append((seq, print_, other is None, None if other is None else signed(other)))
        for (band, value), (prints, n, before) in held.items():
            for chunk in range(before // CHUNK, -(-n // CHUNK)) if n > before else ():
                self.kept.updateValue((band, signed(value), chunk), (prints[chunk * CHUNK : min(n, (chunk + 1) * CHUNK)].tobytes(),))
        yield pd.DataFrame({"scope": [key[0]] * len(found), "seq": [x[0] for x in found], "fingerprint": pd.array([x[1] for x in found], "Int64"), "kept": [x[2] for x in found], "near": pd.array([x[3] for x in found], "Int64")})


def near_of_kept(stream: DataFrame, distance: int) -> DataFrame:
    """(scope, seq, fingerprint, kept, near) of a stream (scope, seq, fingerprint): whether a row is far from all kept before it, else one it is near to.

    Decided row after row: a row near to a dropped one only is kept. Exact at
    the distance. Null and zero fingerprints are kept and compared with nothing.
    A scope (a dataset, a host) is one task's work in a batch, as each decision
    rests on those before it; scopes run beside each other.
    """
    rows = with_state_store(stream).selectExpr("scope", "seq", "coalesce(fingerprint, 0L) as print", "fingerprint is null as none")  # pandas would make a column with nulls one of floats
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy("scope").transformWithStateInPandas(NearKept(distance), f"scope {kinds['scope']}, seq {kinds['seq']}, fingerprint long, kept boolean, near long", "Append", "None")


# --- tier memory -----------------------------------------------------------


class TierMemory(StatefulProcessor):
    """Strikes of a host as its fetches come; a pin ends by timer once ``ttl`` seconds pass without a write."""

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tier", "strikes long, updated double, observations long, timer long")

    def row(self, host: str, strikes: int, updated: float, observations: int, expired: bool) -> pd.DataFrame:
        pinned = strikes >= STRIKE_LIMIT and not expired
        return pd.DataFrame({"host": [host], "strikes": [strikes], "preferred": pd.array([PINNED if pinned else None], "string").astype(object), "updated_at": [updated], "observations": [observations], "expired": [expired]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        strikes, updated, seen, timer = self.state.get() if self.state.exists() else (0, None, 0, None)
        batch = pd.concat(rows).sort_values(["at", "tie"], kind="stable")
        for at, won in zip(batch["at"], batch["reset"], strict=True):
            stale = self.ttl > 0 and updated is not None and updated < at - self.ttl
            strikes = 0 if won else 1 if stale else strikes + 1
            updated, seen = float(at), seen + 1
        if timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        if self.ttl > 0 and strikes >= STRIKE_LIMIT:
            timer = int((updated + self.ttl) * 1000) + 1
            self.handle.registerTimer(timer)
        self.state.update((strikes, updated, seen, timer))
        yield self.row(key[0], strikes, updated, seen, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        strikes, updated, seen, _ = self.state.get()
        self.state.update((strikes, updated, seen, None))
        yield self.row(key[0], strikes, updated, seen, True)


def tier_stream(log: DataFrame, ttl: float, late: str = "0 seconds") -> DataFrame:
    """Updates (host, strikes, preferred, updated_at, observations, expired) of a stream of ``tiers.writes``; ``expired`` rows tell that a pin has ended.

    Time is the events' own: a pin ends once the watermark passes its last
    write by ``ttl``.
    """
    rows = with_state_store(log).selectExpr("host", "at", "tie", "reset", "timestamp_micros(cast(at * 1000000 as bigint)) as stamp").withWatermark("stamp", late)
    return rows.groupBy("host").transformWithStateInPandas(TierMemory(ttl), "host string, strikes long, preferred string, updated_at double, observations long, expired boolean", "Update", "EventTime")


def collected(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> Callable[[], DataFrame]:
    """Run a stream over all there is, its rows appended once each under ``path``, a folder a batch; the returned call reads them with their ``batch``."""
    spark = stream.sparkSession
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])

    def act(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return lambda: spark.read.schema(schema).parquet(path)
