"""Queries of keyed state and event time over events and conversations; the streaming ones drain a file source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import state
from corvane.operators.stored import shared_folder
from corvane.streaming import live

from .tables import table


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = state.history_window(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return found.select("conv_id", "turn", F.md5("history").alias("history"))


def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_turns(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], 3, "text", 80).select("conv_id", "turn", "back", F.md5("text").alias("text"))


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short turns are follow-ups of the first three words of the last long one."""
    topic = F.when(F.length("text") >= 60, F.substring_index("text", " ", 3))
    found = state.previous_topic(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", topic, F.length("text") < 60)
    return found.select("conv_id", "turn", F.md5("resolved").alias("resolved"))


def claim_dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and type within an hour of the last accepted one are refused."""
    return state.claims(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 3600, "event_id")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = state.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600, "event_id")
    return found.select("user_id", "session", micros("begin").alias("begin"), micros("end").alias("end"), "events")


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    found = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return found.select(micros("window.start").alias("begin"), "event_type", "events", "value")


def latest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event type of the ten days before the log's end."""
    events = table(spark, sf_dir, "events")
    ends = F.broadcast(events.agg(F.max("ts").alias("as_of")))  # one row
    return state.latest_within(events.crossJoin(ends), "user_id", "ts", "event_type", F.col("as_of"), 10 * 86400, "event_id")


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text hash isn't among those seen (the first of each text): what a resumed run would do."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    seen = table(spark, sf_dir, "labels").join(docs, "doc_id").select("sha").distinct()
    return docs.join(seen, "sha", "left_anti").select("doc_id", "sha")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # a file source needs a folder or a pattern
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Run over all that is there into a table in the shared folder, and read it."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "complete":
        name = f"drained_{uuid.uuid4().hex}"
        return live.drained(stream, name, mode, f"{base}/state")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def stream_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user, type, day) of a stream; a watermark of the whole log's length keeps all."""
    events = source(spark, sf_dir).select("user_id", "event_type", "ts", F.to_date("ts").alias("day"))
    return drained(live.claimed_once(events, ["user_id", "event_type", "day"], "ts", "40 days").select("user_id", "event_type", "day"), spark, "append")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drained(live.windowed_counts(source(spark, sf_dir), "ts", "event_type", "1 day", late="40 days"), spark, "complete")
    return found.select(micros("begin").alias("begin"), "event_type", "events")


GAPS = """g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)"""
ORACLE_SQL = {
    "history_window": "SELECT conv_id, turn, md5(coalesce(string_agg(role || ': ' || substr(coalesce(text, ''), 1, 1000), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '')) AS history FROM conversations",
    "last_turns": "SELECT conv_id, turn, back, md5(substr(text, 1, 80)) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3",
    "follow_ups": "SELECT conv_id, turn, md5(CASE WHEN length(text) < 60 AND t IS NOT NULL THEN t || ' ' || text ELSE text END) AS resolved FROM (SELECT *, last_value(CASE WHEN length(text) >= 60 THEN array_to_string(string_split(text, ' ')[1:3], ' ') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM conversations)",
    "claim_dedup_ttl": """WITH RECURSIVE n AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT user_id, event_type, event_id, i, t AS last, TRUE AS claimed FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.event_type, n.event_id, n.i, CASE WHEN n.t - c.last >= 3600000000 THEN n.t ELSE c.last END, n.t - c.last >= 3600000000 FROM c JOIN n ON n.user_id = c.user_id AND n.event_type = c.event_type AND n.i = c.i + 1)
SELECT user_id, event_type, event_id, claimed FROM c""",
    "sessions": f"WITH {GAPS} SELECT user_id, session::BIGINT AS session, min(epoch_us(ts)) AS begin, max(epoch_us(ts)) AS end, count(*) AS events FROM s GROUP BY 1, 2",
    "tumbling_windows": "SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS begin, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "latest_query": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events, (SELECT max(ts) AS as_of FROM events) WHERE epoch(date_trunc('second', as_of)) - epoch(date_trunc('second', ts)) < 864000 GROUP BY 1",
    "incremental": "SELECT doc_id, sha256(text) AS sha FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))",
    "stream_claims": "SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events",
    "stream_windows": "SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS begin, event_type, count(*) AS events FROM events GROUP BY 1, 2",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
