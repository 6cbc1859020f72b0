"""Queries that run a stream over a table to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import SPANS
from ..shared import scratch
from ..streaming import flows as S
from .registry import query


def _place(spark: SparkSession, name: str) -> tuple[str, str]:
    at = scratch(spark, f"stream-{name}")
    return f"{at}/table", f"{at}/checkpoint"


@query(
    """
    WITH s AS (SELECT event_no, original_tool_output AS o, list_filter(predicted_drop_spans, lambda s: s.start >= 0 AND s.start < s."end" AND s."end" <= length(original_tool_output)) AS p FROM defense_event),
    k AS (SELECT *, list_filter(range(0, length(o)), lambda i: NOT len(list_filter(p, lambda s: s.start <= i AND i < s."end")) > 0) AS left_ FROM s)
    SELECT event_no, CASE WHEN len(p) = 0 THEN o ELSE array_to_string(list_transform(left_, lambda i: o[i + 1]), '') END AS filtered, coalesce(len(p) > 0, NULL) AS was_changed FROM k"""
)
def stream_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Tool outputs filtered as they arrive: the text that is left, and whether it differs."""
    table, checkpoint = _place(spark, "filter")
    events = S.stream_table(spark, folder, "defense_event")
    fit = F.filter("predicted_drop_spans", lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length("original_tool_output")))
    events = events.withColumn("predicted_drop_spans", fit.cast(SPANS))
    S.run_to_table(S.filtered(events, "original_tool_output", "predicted_drop_spans").select("event_no", "filtered", "was_changed"), table, checkpoint)
    return spark.read.parquet(table)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def stream_running_means(spark: SparkSession, folder: str) -> DataFrame:
    """Means by type, kept up to date by the stream."""
    table, checkpoint = _place(spark, "means")
    means = S.stream_table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    S.run_to_table(means, table, checkpoint, mode="complete")
    return spark.read.parquet(table)


def _timed(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream; watermarks want times with a zone."""
    return S.stream_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type and hour as a stream gives them (an extension)."""
    table, checkpoint = _place(spark, "windows")
    S.run_to_table(S.windowed_counts(_timed(spark, folder), "ts", ["event_type"], "1 hour", late="20 years").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"), table, checkpoint, mode="complete")
    return spark.read.parquet(table)


@query(
    """
    WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL '30 minutes', true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users with a gap of half an hour as a stream gives them (an extension)."""
    table, checkpoint = _place(spark, "sessions")
    S.run_to_table(S.sessions(_timed(spark, folder), "ts", ["user_id"], "30 minutes", late="20 years").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n"), table, checkpoint, mode="complete")
    return spark.read.parquet(table)


@query("SELECT tool_call_id, 1::BIGINT AS times, max(event_no % 2 = 0) AS in_first FROM defense_event GROUP BY tool_call_id")
def stream_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Calls appended in two runs: the first stops after the even events, the second gets all and only adds what is missing."""
    table, checkpoint = _place(spark, "resume")
    calls = S.stream_table(spark, folder, "defense_event").select("tool_call_id", "event_no")
    S.append_new(calls.where("event_no % 2 = 0"), "tool_call_id", table, f"{checkpoint}-1")
    S.append_new(calls, "tool_call_id", table, f"{checkpoint}-2")
    rows = spark.read.parquet(table)
    return rows.groupBy("tool_call_id").agg(F.count("*").alias("times"), F.max(F.col("event_no") % 2 == 0).alias("in_first"))


@query("SELECT case_id, arg_max(defense, event_no) AS defense, max(event_no) AS event_no, count(*) AS versions FROM defense_event GROUP BY case_id")
def stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    """A log that is added to at every change, and the latest state of each case in it."""
    table, checkpoint = _place(spark, "latest")
    S.run_to_table(S.stream_table(spark, folder, "defense_event").select("case_id", "event_no", "defense"), table, checkpoint)
    return S.latest(spark.read.parquet(table), ["case_id"], "event_no")


@query("SELECT event_no, max(contains(lower(original_tool_output), 'please') OR contains(lower(original_tool_output), 'delete')) OVER (PARTITION BY case_id ORDER BY event_no) AS flagged FROM defense_event WHERE original_tool_output IS NOT NULL")
def stream_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the conversation up to each message shows a phrase, with the state kept between messages."""
    table, checkpoint = _place(spark, "prefixes")
    messages = S.stream_table(spark, folder, "defense_event").where("original_tool_output is not null")
    S.run_to_table(S.flagged_prefixes(messages, "case_id", "event_no", "original_tool_output", ["please", "delete"]), table, checkpoint)
    return spark.read.parquet(table).select(F.col("place").alias("event_no"), "flagged")


@query(
    """
    WITH e AS (SELECT event_no, tool_name, coalesce(max(tool_name = 'read_file') OVER (PARTITION BY case_id ORDER BY event_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM defense_event)
    SELECT event_no, NOT (seen AND tool_name IN ('read_file', 'get_weather', 'read_note')) AS allowed FROM e"""
)
def stream_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Calls allowed under a policy that changes once a tool has been called."""
    table, checkpoint = _place(spark, "policy")
    calls = S.stream_table(spark, folder, "defense_event")
    S.run_to_table(S.changing_policy(calls, "case_id", "event_no", "tool_name", {"read_file": ["read_file", "get_weather", "read_note"]}), table, checkpoint)
    return spark.read.parquet(table).select(F.col("place").alias("event_no"), "allowed")
