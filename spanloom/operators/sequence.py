"""Ordered computations: neighbours of label changes, peaks of signals, overlapping windows, turns of conversations, schedules, lineage of values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.spans import let, span


def boundary_weights(labels: Column, radius: int, weight: float) -> Column:
    """Weight of each label of an array: ``weight`` within ``radius`` places of a change, else 1. The ends count as changes next to a 1 only, as if zeros stood around."""
    change = lambda x, k: F.when(k == 0, x[0] != 0).otherwise(x[k] != x[k - 1])
    places = lambda x: F.filter(F.sequence(F.lit(0), F.size(x)), lambda k: F.when(k == F.size(x), F.element_at(x, -1) != 0).otherwise(change(x, k)))
    near = lambda i, c: F.exists(c, lambda k: (i >= k - radius) & (i < k + radius))
    weights = lambda x: let(places(x), lambda c: F.transform(x, lambda _, i: F.when(near(i, c), F.lit(float(weight))).otherwise(F.lit(1.0))))
    return F.when(F.size(labels) > 0, let(labels, weights)).otherwise(F.array().cast("array<double>"))


def grouped_peaks(peaks: Column, max_gap: int) -> Column:
    """Half-open spans of sorted places whose gaps are at most ``max_gap``."""
    from ..functions.spans import bridge_gaps

    return bridge_gaps(F.transform(peaks, lambda p: span(p, p + 1)), max_gap - 1)


_GROUPS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def signal_peaks(window: int = 5, threshold: float = 0.5, max_gap: int = 3):
    """A vectorised function that smooths an array with a quadratic fit over ``window`` values, takes local maxima of at least ``threshold`` and groups them."""
    half = window // 2
    x = np.arange(-half, half + 1)
    kernel = np.linalg.pinv(np.vander(x, 3, increasing=True))[0]

    def groups(values) -> list[dict] | None:
        if values is None:
            return None
        v = np.asarray(values, float)
        if len(v) < window:
            return []
        smooth = np.convolve(np.pad(v, half, mode="edge"), kernel[::-1], mode="valid")
        up = np.r_[True, smooth[1:] > smooth[:-1]] & np.r_[smooth[:-1] >= smooth[1:], True] & (smooth >= threshold)
        at = np.flatnonzero(up)
        if not len(at):
            return []
        cut = np.flatnonzero(np.diff(at) > max_gap) + 1
        return [{"start": int(g[0]), "end": int(g[-1]) + 1} for g in np.split(at, cut)]

    @F.pandas_udf(_GROUPS)
    def run(signals: pd.Series) -> pd.Series:
        return signals.map(groups)

    return run


def sliding_windows(items: Column, size: int, stride: int) -> Column:
    """Overlapping windows of an array as struct(start, items); the last one ends with the array. An array of up to ``size`` items is one window, an empty one none."""
    starts = lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).when(F.size(x) <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), F.size(x) - size, F.lit(stride)), F.array(F.size(x) - size))))
    return let(items, lambda x: F.transform(starts(x), lambda s: F.struct(s.alias("start"), F.slice(x, s + 1, size).alias("items"))))


def turns(messages: DataFrame, conversation: str, order: str, role: str) -> DataFrame:
    """Messages with ``turn``: 0 before the first assistant message, then one more with each. Turns count on one ordered scan of a conversation."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn", F.count_if(F.col(role) == "assistant").over(w))


def merged_runs(messages: DataFrame, conversation: str, order: str, role: str, text: str, apart: str = "assistant") -> DataFrame:
    """Neighbouring messages that aren't the assistant's as one, its texts joined by line breaks; an assistant message stays alone."""
    w = Window.partitionBy(conversation).orderBy(order)
    new = (F.col(role) == apart) | (F.lag(role).over(w) == apart) | F.lag(role).over(w).isNull()
    marked = messages.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    runs = marked.groupBy(conversation, "_run").agg(F.min(order).alias(order), F.min_by(role, order).alias(role), parts.alias("_p"), F.count("*").alias("messages"))
    return runs.select(conversation, order, role, F.array_join(F.transform("_p", lambda p: p["t"]), "\n").alias(text), "messages")


def schedule(steps: Column, warmup: int, total: int) -> Column:
    """Learning-rate factor: linear from 0 over the warm-up, then linear to 0 at the last step."""
    return F.when(steps < warmup, steps / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), (total - steps) / max(1, total - warmup)))


def lineage(values: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, sources, readers) over a graph of values: sources are united and readers intersected over everything a value depends on, itself included. Null readers are everyone.

    ``values`` has id, sources and readers, ``edges`` id and needs. Reachability grows by doubling over written tables, and cycles end it like anything else.
    """
    from ..shared import discard, written

    reach = written(values.select("id", F.col("id").alias("needs")).unionAll(edges.select("id", "needs")).distinct(), "lineage")
    before = -1
    for _ in range(most_rounds):
        n = reach.count()
        if n == before:
            break
        before = n
        a, b = reach.select("id", F.col("needs").alias("k")), reach.select(F.col("id").alias("k"), "needs")
        grown = written(reach.unionAll(a.join(b, "k").select("id", "needs")).distinct(), "lineage")
        discard(reach)
        reach = grown
    own = values.select(F.col("id").alias("needs"), "sources", "readers")
    joined = reach.join(own, "needs")
    union = joined.select("id", F.explode_outer("sources").alias("s")).groupBy("id").agg(F.sort_array(F.collect_set("s")).alias("sources"))
    limited = joined.where("readers is not null").groupBy("id").agg(F.count("*").alias("n"))
    shared = joined.where("readers is not null").select("id", F.explode(F.array_distinct("readers")).alias("r")).groupBy("id", "r").agg(F.count("*").alias("k"))
    common = shared.join(limited, "id").where("k = n").groupBy("id").agg(F.sort_array(F.collect_set("r")).alias("readers"))
    return union.join(limited, "id", "left").join(common, "id", "left").select("id", "sources", F.when(F.col("n").isNotNull(), F.coalesce("readers", F.array().cast("array<string>"))).alias("readers"))
