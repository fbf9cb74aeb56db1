"""Structured Streaming forms of keyed state: idempotent claims, event-time windows, sessions, history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.state import Claims


def files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def claimed_once(events: DataFrame, key: list[str], at: str, ttl: str) -> DataFrame:
    """The first event of each key; later ones within ``ttl`` of event time are dropped, and state with them."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, at: str, key: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(window, key).agg(F.count("*").alias("events")).select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), key, "events")


def session_counts(events: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("events")).select(F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), key, "events")


def recent_values(events: DataFrame, key: str, at: str, value: str, keep: int, ttl_ms: int, late: str = "1 hour") -> DataFrame:
    """key, values: the last ``keep`` values of each key after each batch, none older than the TTL.

    State goes when the watermark passes a key's last event by the TTL, so idle keys hold none.
    """

    def update(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        for part in parts:
            held += [(int(t.timestamp() * 1000), str(v)) for t, v in zip(part[at], part[value])]
        held.sort()
        held = [x for x in held if x[0] > held[-1][0] - ttl_ms][-keep:]
        state.update(([t for t, _ in held], [v for _, v in held]))
        state.setTimeoutTimestamp(max(held[-1][0] + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]], "values": [[v for _, v in held]]})

    kind = dict(events.dtypes)[key]
    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, values array<string>", "times array<long>, held array<string>", "update", GroupStateTimeout.EventTimeTimeout)


class ClaimKeeper(StatefulProcessor):
    """Claims of a scope as a map of id to (place in order of claims, expiry).

    A timer at the last expiry empties a scope that stays idle, once the watermark is there.
    """

    def __init__(self, scope: str, order: str, ttl: float, most: int):
        self.scope, self.order, self.ttl, self.most = scope, order, ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "id string", "place long, expires double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        stored = sorted((v[0], k[0], v[1]) for k, v in self.held.iterator())
        claims = Claims(self.ttl, self.most, {k: expires for _, k, expires in stored})
        batch = pd.concat(list(rows)).sort_values(["claim_time", self.order], kind="stable")
        taken = [claims.take(*x) for x in zip(batch["claim_name"].where(batch["claim_name"].notna(), None).tolist(), batch["claim_time"].tolist(), batch["claim_release"].tolist())]
        self.held.clear()
        for place, (name, expires) in enumerate(claims.held.items()):
            self.held.updateValue((name,), (place, expires))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if claims.held:
            self.handle.registerTimer(int(max(claims.held.values()) * 1000) + 1)
        yield pd.DataFrame({self.scope: [key[0]] * len(batch), self.order: batch[self.order].tolist(), "claimed": pd.Series(taken, dtype="object")})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def bounded_claims(events: DataFrame, scope: str, name: str, at: str, release: str, order: str, ttl: float, most: int, late: str = "1 hour") -> DataFrame:
    """operators.state.bounded_claims of a stream: scope, order, claimed. Needs the RocksDB state store.

    A batch is taken in order of time; an event of a later batch comes after it whatever its time. A scope holds at most ``most`` ids, and none once
    the watermark has passed its last expiry.
    """
    stamped = events.withWatermark(at, late)
    rows = stamped.select(F.col(scope), F.col(order), F.col(name).cast("string").alias("claim_name"), F.col(at), F.coalesce(F.col(at).cast("double"), F.lit(0.0)).alias("claim_time"), F.coalesce(F.col(release), F.lit(False)).alias("claim_release"))
    kinds = dict(events.dtypes)
    out = f"{scope} {kinds[scope]}, {order} {kinds[order]}, claimed boolean"
    return rows.groupBy(scope).transformWithStateInPandas(ClaimKeeper(scope, order, ttl, most), out, "Append", "EventTime")


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there now, in a table beside the checkpoint: of a complete result the last one, else every batch's rows."""
    rows = f"{checkpoint.rstrip('/')}-{name}"
    keep = "overwrite" if mode == "complete" else "append"
    query = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode(keep).parquet(rows)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)
