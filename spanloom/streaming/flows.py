"""Structured Streaming forms: filtering as records arrive, resuming by key, running means, latest state, windows with late data."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import merge_spans, remove_spans


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table of a folder as a stream of its files; the table may be one file or a directory."""
    path = f"{folder}/{name}.parquet"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(path)


def filtered(stream: DataFrame, text: str, spans: str) -> DataFrame:
    """Each output without its predicted spans; stateless."""
    return stream.withColumn("filtered", remove_spans(F.col(text), merge_spans(F.col(spans)))).withColumn("was_changed", F.col("filtered") != F.col(text))


def windowed_counts(stream: DataFrame, time: str, keys: list[str], length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by key and window; rows later than ``late`` behind the newest time are dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(window, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts by key and session, a session ending after ``gap`` without rows."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now into a Parquet table; a later call with the same checkpoint goes on where this one ended."""
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()


def append_new(stream: DataFrame, key: str, path: str, checkpoint: str) -> None:
    """Append rows whose key isn't in the table yet: finished keys are skipped, also after a restart.

    Each batch has a folder of its own below ``path``, named by the checkpoint and its number, which a repetition of the batch after a failure overwrites, so nothing is appended twice. Only the
    key column of the table is read, and any error in reading it fails the batch.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:10]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fresh = batch.dropDuplicates([key])
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            done = spark.read.schema(f"`{key}` {batch.schema[key].dataType.simpleString()}, batch string").parquet(path)
            fresh = fresh.join(done.where(F.col("batch") != f"{run}-{number}").select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={run}-{number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key of an append-only log, with the number of its ``versions``: what a file rewritten at every change would hold."""
    others = [c for c in log.columns if c not in (*keys, order)]
    return log.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in others), F.max(order).alias(order), F.count("*").alias("versions"))


def flagged_prefixes(stream: DataFrame, key: str, place: str, text: str, phrases: list[str]) -> DataFrame:
    """(key, place, flagged): whether the conversation up to each message, joined by line breaks, holds a phrase (in lower case).

    The state of a conversation is a flag and the end of its text, one character shorter than the longest phrase, so it doesn't grow. Messages of one batch are taken in the order of their places.
    """
    longest = max(map(len, phrases))

    def step(_: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        flagged, tail = state.get if state.exists else (False, "")
        rows = pd.concat(list(parts)).sort_values("place")
        out = []
        for words in rows["text"]:
            whole = f"{tail}\n{words or ''}".lower()
            flagged = flagged or any(p in whole for p in phrases)
            tail = whole[-(longest - 1) :] if longest > 1 else ""
            out.append(flagged)
        state.update((flagged, tail))
        yield pd.DataFrame({"key": rows["key"].astype(str), "place": rows["place"], "flagged": out})

    slim = stream.select(F.col(key).cast("string").alias("key"), F.col(place).cast("long").alias("place"), F.col(text).alias("text"))
    return slim.groupBy("key").applyInPandasWithState(step, "key string, place long, flagged boolean", "flagged boolean, tail string", "append", "NoTimeout")


def changing_policy(stream: DataFrame, key: str, place: str, tool: str, after: dict[str, list[str]]) -> DataFrame:
    """(key, place, tool, allowed): whether each call is allowed. Once a tool of ``after`` has been called, whether allowed or not, the tools named for it are denied to its key.

    The state of a key is the set of such tools called, at most as many as ``after`` has. Calls of one batch are taken in the order of their places.
    """

    def step(_: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        called = set(state.get[0].split("\0")) - {""} if state.exists else set()
        rows = pd.concat(list(parts)).sort_values("place")
        out = []
        for name in rows["tool"]:
            out.append(not any(name in after[t] for t in called))
            if name in after:
                called.add(name)
        state.update(("\0".join(sorted(called)),))
        yield pd.DataFrame({"key": rows["key"].astype(str), "place": rows["place"], "tool": rows["tool"], "allowed": out})

    slim = stream.select(F.col(key).cast("string").alias("key"), F.col(place).cast("long").alias("place"), F.col(tool).alias("tool"))
    return slim.groupBy("key").applyInPandasWithState(step, "key string, place long, tool string, allowed boolean", "called string", "append", "NoTimeout")
