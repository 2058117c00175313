"""Keyed state with time-outs: a version state machine and a cache whose entries expire.

State keeps what decides, not the events: of a version the latest transition (by time, then by rank of its status), so repeated and
late events don't change the answer and the order of arrival doesn't matter; of a cache key the latest entry. Event-time timers end versions that were
started and never finished, and drop entries that are past their time, so state is bounded by the keys that live.

Cases: rows with a null key, time or status are ignored; unknown statuses too; a late end of a version that has timed out still counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Statuses by rank: of transitions at one time the last in this order stands.
STATUSES = ("queued", "started", "failed", "ready")
VERSION = "key string, status string, since timestamp"
LOOKUP = "key string, ts timestamp, hit boolean, value string"


def _millis(t: pd.Timestamp) -> int:
    return int(t.value // 1_000_000)


def version_states(transitions: DataFrame, timeout_s: int, delay: str = "0 seconds") -> DataFrame:
    """A stream (key, ts, status) to updates (key, status, since): the latest status of a key, `timed_out` where it was started and the watermark is more than timeout_s further."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since, _ = state.get
            yield pd.DataFrame({"key": [key[0]], "status": ["timed_out"], "since": [pd.Timestamp(since, unit="us")]})
            return  # the state stays: a later transition must beat it
        since, rank = state.get if state.exists else (None, -1)
        for batch in batches:
            for t, s in zip(batch["ts"], batch["status"], strict=True):
                at = (int(t.value // 1000), STATUSES.index(s))
                if since is None or at > (since, rank):
                    since, rank = at
        state.update((since, rank))
        over = since // 1000 + 1000 * timeout_s
        late = STATUSES[rank] == "started" and over < state.getCurrentWatermarkMs()
        if STATUSES[rank] == "started" and not late:
            state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "status": ["timed_out" if late else STATUSES[rank]], "since": [pd.Timestamp(since, unit="us")]})

    fine = transitions.where(F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("status").isin(*STATUSES)).select(F.col("key").cast("string").alias("key"), "ts", "status")
    return fine.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(step, VERSION, "since long, rank int", "update", GroupStateTimeout.EventTimeTimeout)


def version_states_batch(transitions: DataFrame, timeout_s: int) -> DataFrame:
    """The same answer for all transitions at once; the watermark is the latest time of all."""
    fine = transitions.where(F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("status").isin(*STATUSES)).select(F.col("key").cast("string").alias("key"), "ts", "status")
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    last = fine.groupBy("key").agg(F.max(F.struct("ts", rank.alias("rank"), "status")).alias("x")).select("key", "x.status", F.col("x.ts").alias("since"))
    now = F.broadcast(fine.agg(F.max("ts").alias("now")))  # one row
    over = (F.col("status") == "started") & (F.col("since") + F.expr(f"INTERVAL {timeout_s} SECONDS") < F.col("now"))
    return last.crossJoin(now).select("key", F.when(over, "timed_out").otherwise(F.col("status")).alias("status"), "since")


def cached_lookups(requests: DataFrame, ttl_s: int, delay: str = "0 seconds") -> DataFrame:
    """A stream (key, ts, value) of writes (with a value) and reads (null) to one row a read: hit and the value of the latest write that is not older than ttl_s.

    Requests of a batch are taken in order of time, a write before a read of the same time; an entry leaves the state when the watermark has passed its end.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        entry = state.get if state.exists else None
        rows = sorted(((t, v is None, v) for b in batches for t, v in zip(b["ts"], b["value"], strict=True)), key=lambda r: (r[0], r[1], r[2] or ""))
        out = []
        for t, read, v in rows:
            ms = _millis(t)
            if not read and (entry is None or ms >= entry[0]):
                entry = (ms, v)
            elif read:
                hit = entry is not None and entry[0] <= ms < entry[0] + 1000 * ttl_s
                out.append((key[0], t, hit, entry[1] if hit else None))
        if entry is not None:
            state.update(entry)
            state.setTimeoutTimestamp(max(entry[0] + 1000 * ttl_s, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "hit", "value"])

    fine = requests.where("key is not null and ts is not null").select(F.col("key").cast("string").alias("key"), "ts", F.col("value").cast("string").alias("value"))
    return fine.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(step, LOOKUP, "at long, value string", "append", GroupStateTimeout.EventTimeTimeout)
