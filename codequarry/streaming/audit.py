"""Audit rows as micro-batches, last-seen state, expiry, policies read anew, and stateful twins of the rate limiter and the lease locks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import access


def sink(rows: DataFrame, table: str, checkpoint: str, every: str = "250 milliseconds") -> StreamingQuery:
    """Appends to a Parquet table exactly once: each batch is a file set of its own, tracked by the checkpoint."""
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(processingTime=every).outputMode("append").start()


def last_seen(rows: DataFrame, key: str = "agent_id", time: str = "ts", window: str = "30 seconds", late: str = "30 seconds") -> DataFrame:
    """Activity of each key in windows of event time, with a bound on lateness."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.max(time).alias("last_active"), F.count("*").alias("call_count"))


def limited(events: DataFrame, limit: int, window: float, key: str = "agent_id") -> DataFrame:
    """The rate limiter as a stateful stream over (key, id, t): state is the accepted times of the window, at most `limit` of them."""

    def step(k: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        kept = list(state.get[0]) if state.exists else []
        for pdf in batches:
            out = []
            for i, t in pdf.sort_values(["t", "id"])[["id", "t"]].itertuples(index=False, name=None):
                kept = [x for x in kept if x >= t - window]
                ok = len(kept) < limit
                if ok:
                    kept.append(t)
                out.append((k[0], i, ok))
            yield pd.DataFrame(out, columns=[key, "id", "accepted"])
        state.update((kept,))

    return events.select(key, "id", F.col("t").cast("double").alias("t")).groupBy(key).applyInPandasWithState(step, f"{key} string, id long, accepted boolean", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def leased(requests: DataFrame, timeout: float) -> DataFrame:
    """Lease locks as a stateful stream over (resource_key, seq, at, agent_id): state is the holder and its end."""

    def step(k: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        held, until = state.get if state.exists else (None, float("-inf"))
        for pdf in batches:
            out = []
            for at, seq, agent in pdf.sort_values(["at", "seq"])[["at", "seq", "agent_id"]].itertuples(index=False, name=None):
                ok = until <= at or held == agent
                if ok:
                    held, until = agent, at + timeout
                out.append((k[0], seq, agent, ok))
            yield pd.DataFrame(out, columns=["resource_key", "seq", "agent_id", "acquired"])
        state.update((held, until))

    chosen = requests.select("resource_key", F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"), "agent_id")
    return chosen.groupBy("resource_key").applyInPandasWithState(step, "resource_key string, seq long, agent_id string, acquired boolean", "held string, until double", "append", GroupStateTimeout.NoTimeout)


def expiring(puts: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A keyed store as a stateful stream over (key, ts, value, expires_at): each put, and each expiry once event time has passed it (`event`: put or
    expired). State is a key's value; a later put replaces it, and one without expiry stays."""

    def step(k: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        out = []
        if state.hasTimedOut:
            out.append((k[0], "expired", state.get[0]))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            out += [(k[0], "put", v) for v in rows["value"]]
            last = rows.iloc[-1]
            now = state.getCurrentWatermarkMs()
            if not pd.isna(last["expires_at"]) and int(last["expires_at"].timestamp() * 1000) <= now:
                out.append((k[0], "expired", last["value"]))
                if state.exists:
                    state.remove()
            else:
                state.update((last["value"],))
                if not pd.isna(last["expires_at"]):
                    state.setTimeoutTimestamp(int(last["expires_at"].timestamp() * 1000))
        yield pd.DataFrame(out, columns=["key", "event", "value"])

    rows = puts.withWatermark("ts", late).select("key", "ts", "value", "expires_at")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, event string, value string", "value string", "append", GroupStateTimeout.EventTimeTimeout)


def decided(requests: DataFrame, agents: Callable[[], DataFrame], read_only: list[str], out: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Access decisions of a stream of requests: `agents` reads the policies anew for each micro-batch, so a change counts from the next one on."""

    def batch(rows: DataFrame, k: int) -> None:
        out(access(rows, agents(), False, read_only), k)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
