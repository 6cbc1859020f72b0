"""Quality of predicted spans and tokens, and reports over groups."""

from __future__ import annotations

import re
from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spans import intersection_length, let, merge_spans, remove_spans, span_length, subtract_spans


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_metrics(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1 and support of a class; 0 on zero denominators."""
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "support": tp + fn}


def span_details(records: DataFrame, text: str, truth: str, predicted: str, clean: str) -> DataFrame:
    """Per record: lengths of true, predicted, common, wrong and missed spans, the text that is left, and whether it is the clean one.

    Null spans or texts give null lengths and ``exact`` false.
    """
    t, p = F.col(truth), F.col(predicted)
    return records.withColumns(
        {
            "true_length": span_length(t), "predicted_length": span_length(p), "common_length": intersection_length(p, t),
            "wrong_spans": subtract_spans(p, t), "missed_spans": subtract_spans(t, p), "left": remove_spans(F.col(text), p),
        }
    ).withColumn("exact", F.coalesce(F.col("left") == F.col(clean), F.lit(False)))


def grouped_report(details: DataFrame, groups: list[str]) -> DataFrame:
    """Report of ``span_details`` over all records and over each group column: long rows (grouping, value, ...).

    Injection recall is averaged over the records with true spans only; the others count everywhere else. One pass with grouping sets.
    """
    measured = details.select(
        *groups, "exact", "true_length", "predicted_length", "common_length",
        F.when(F.col("true_length") > 0, F.col("common_length") / F.col("true_length")).alias("injection_recall"),
    )
    aggregates = [
        F.count("*").alias("n"), F.avg(F.col("exact").cast("int")).alias("exact_match"), F.avg("injection_recall").alias("injection_recall"), F.count("injection_recall").alias("injection_records"),
        F.sum("common_length").alias("tp"), F.sum(F.col("predicted_length") - F.col("common_length")).alias("fp"), F.sum(F.col("true_length") - F.col("common_length")).alias("fn"),
    ]
    ids = F.grouping_id(*groups)
    full = (1 << len(groups)) - 1
    table = measured.groupingSets([[], *([g] for g in groups)], *groups).agg(ids.alias("gid"), *aggregates)
    name, value = F.lit("all"), F.lit(None).cast("string")
    for k, g in enumerate(groups):
        only = full & ~(1 << (len(groups) - 1 - k))
        name, value = F.when(F.col("gid") == only, F.lit(g)).otherwise(name), F.when(F.col("gid") == only, F.col(g)).otherwise(value)
    tp, fp, fn = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "fp", "fn"))
    chars = class_metrics(tp, fp, fn)
    return table.select(
        name.alias("grouping"), value.alias("value"), "n", F.round("exact_match", 6).alias("exact_match"), F.round("injection_recall", 6).alias("injection_recall"), "injection_records",
        F.round(chars["precision"], 6).alias("char_precision"), F.round(chars["recall"], 6).alias("char_recall"), F.round(chars["f1"], 6).alias("char_f1"),
    )


def token_metrics(tokens: DataFrame, label: str, prediction: str, groups: list[str]) -> DataFrame:
    """Confusion counts, metrics of DROP (1) and KEEP (0), macro F1 and accuracy of a token table; other labels are ignored."""
    n = lambda t, p: F.count_if((F.col(label) == t) & (F.col(prediction) == p)).alias(f"n{t}{p}")
    table = tokens.where(F.col(label).isin(0, 1)).groupBy(*groups).agg(n(0, 0), n(0, 1), n(1, 0), n(1, 1))
    return confusion_metrics(table, groups)


def confusion_metrics(table: DataFrame, groups: list[str]) -> DataFrame:
    """Metrics of a table with the counts n{label}{prediction}."""
    drop = class_metrics(F.col("n11"), F.col("n01"), F.col("n10"))
    keep = class_metrics(F.col("n00"), F.col("n10"), F.col("n01"))
    whole = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    return table.select(
        *groups, "n00", "n01", "n10", "n11", *(F.round(m, 6).alias(f"drop_{k}") for k, m in drop.items() if k != "support"), *(F.round(m, 6).alias(f"keep_{k}") for k, m in keep.items() if k != "support"),
        F.round((drop["f1"] + keep["f1"]) / 2, 6).alias("macro_f1"), F.round(ratio(F.col("n00") + F.col("n11"), whole), 6).alias("accuracy"),
    )


def token_labels(tokens: Column, text: Column, spans: Column, low: Column, high: Column) -> Column:
    """Label of each token of ``array<struct<start,end>>`` (text offsets, as the spans): -100 outside [low, high) or empty, 1 if it lies inside a span or
    shares a character that isn't white space with one, else 0. Labels are made before tokens are exploded, so that no row carries the text. Null spans or texts give null."""

    def label(t: Column, given: Column) -> Column:
        a, b = t["start"], t["end"]
        inside = F.exists(given["s"], lambda s: (s["start"] <= a) & (b <= s["end"]))
        shared = lambda s: F.substring(given["x"], F.greatest(a, s["start"]) + 1, F.least(b, s["end"]) - F.greatest(a, s["start"]))
        touches = F.exists(given["s"], lambda s: (s["start"] < b) & (a < s["end"]) & shared(s).rlike(r"(?U)\S"))
        return F.when((a < given["low"]) | (b > given["high"]) | (a >= b), F.lit(-100)).when(inside | touches, F.lit(1)).otherwise(F.lit(0))

    given = F.struct(spans.alias("s"), text.alias("x"), low.alias("low"), high.alias("high"))
    return F.when(spans.isNotNull() & text.isNotNull(), let(given, lambda g: F.transform(tokens, lambda t: label(t, g))))


_CONFUSION = T.StructType([T.StructField(f"n{t}{p}", T.LongType()) for t in (0, 1) for p in (0, 1)])
_WORDS = re.compile(r"\S+")


@F.pandas_udf(_CONFUSION)
def word_confusion(texts: pd.Series, truths: pd.Series, predictions: pd.Series) -> pd.DataFrame:
    """Counts of a text's words by true and predicted label, a word being dropped if a span touches it; null where an argument is.

    The same numbers as ``token_labels`` over ``word_spans``, which for millions of words take an expression's lambda twenty times as long.
    """

    def touched(starts: np.ndarray, ends: np.ndarray, spans: Iterable) -> np.ndarray:
        hit = np.zeros(len(starts), bool)
        for s in spans:
            # Words are in order, so those that a span touches stand next to each other.
            hit[np.searchsorted(ends, s["start"], "right") : np.searchsorted(starts, s["end"], "left")] |= s["start"] < s["end"]
        return hit

    rows = []
    for text, truth, prediction in zip(texts, truths, predictions, strict=True):
        if text is None or truth is None or prediction is None:
            rows.append((None,) * 4)
            continue
        at = np.array([m.span() for m in _WORDS.finditer(text)], np.int64).reshape(-1, 2)
        t, p = touched(at[:, 0], at[:, 1], truth), touched(at[:, 0], at[:, 1], prediction)
        both, n_t, n_p = int((t & p).sum()), int(t.sum()), int(p.sum())
        rows.append((len(at) - n_t - n_p + both, n_p - both, n_t - both, both))
    return pd.DataFrame(rows, columns=["n00", "n01", "n10", "n11"], dtype="Int64")


def threshold_sweep(records: DataFrame, tokens: str, grid: DataFrame) -> DataFrame:
    """Records with ``predicted`` spans for each (threshold, max_gap) of a small grid."""
    from ..functions.spans import bridge_gaps, spans_from_probabilities

    swept = records.crossJoin(F.broadcast(grid))
    return swept.withColumn("predicted", merge_spans(bridge_gaps(spans_from_probabilities(F.col(tokens), F.col("threshold")), F.col("max_gap"))))


_ALIGNED = T.StructType(
    [
        T.StructField("exact", T.BooleanType()), T.StructField("source_recall", T.DoubleType()), T.StructField("target_recall", T.DoubleType()),
        T.StructField("edit_distance", T.IntegerType()), T.StructField("normalised", T.DoubleType()), T.StructField("removed", T.ArrayType(T.StringType())),
    ]
)


@F.pandas_udf(_ALIGNED)
def alignment(source: pd.Series, predicted: pd.Series, truth: pd.Series) -> pd.DataFrame:
    """Alignment of a filtered text by longest common blocks, in one struct: whether it equals the truth, the shares of the source and of the truth it
    keeps, its distance to the truth in insertions and deletions, the same over the longer length, and the fragments removed from the source.

    No expression gives these numbers: the alignment takes the longest block first. Equal pairs are aligned once in a batch, and identical texts not at all.
    """
    known: dict[tuple[str, str], list] = {}

    def blocks(a: str, b: str) -> list:
        if a == b:
            return [(0, 0, len(a))]
        if (a, b) not in known:
            known[a, b] = [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()]
        return known[a, b]

    rows = []
    for s, p, t in zip(source, predicted, truth, strict=True):
        if s is None or p is None or t is None:
            rows.append((None,) * 6)
            continue
        kept, same = blocks(s, p), sum(n for _, _, n in blocks(t, p))
        distance = len(p) + len(t) - 2 * same
        removed, at = [], 0
        for a, _, n in [*kept, (len(s), 0, 0)]:
            if a > at:
                removed.append(s[at:a])
            at = max(at, a + n)
        share = same / len(t) if t else float(not p)
        rows.append((p == t, sum(n for _, _, n in kept) / max(1, len(s)), share, distance, distance / max(len(p), len(t), 1), removed))
    return pd.DataFrame(rows, columns=["exact", "source_recall", "target_recall", "edit_distance", "normalised", "removed"])


@F.pandas_udf(T.DoubleType())
def rouge_l(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    """F measure of the longest common subsequence of words; 0 for a text without words."""

    def lcs(a: list[str], b: list[str]) -> int:
        # Bit-parallel: one integer operation per word of b.
        at: dict[str, int] = {}
        for k, w in enumerate(a):
            at[w] = at.get(w, 0) | 1 << k
        row = 0
        for w in b:
            x = at.get(w, 0) | row
            row = x & ~(x - (row << 1 | 1))
        return row.bit_count()

    out = []
    for p, t in zip(prediction, truth, strict=True):
        a, b = (p or "").split(), (t or "").split()
        n = lcs(a, b) if a and b else 0
        out.append(2 * n / (len(a) + len(b)) if n else 0.0)
    return pd.Series(out)


def unaligned_tokens(tokens: DataFrame, place: str, label: str, prediction: str, records: DataFrame, record_no: str, groups: list[str]) -> DataFrame:
    """Confusion metrics of predictions without offsets: the token at place i (from 0) counts for record i modulo the number of records (numbered from 0 without gaps).

    This attribution is the contract of callers that only have a flat list; it says nothing about which record a token is from.
    """
    n = records.agg(F.count("*").alias("_n"))
    numbered = tokens.crossJoin(F.broadcast(n)).withColumn("_no", F.pmod(F.col(place), F.col("_n")))
    joined = numbered.join(records.select(F.col(record_no).alias("_no"), *groups), "_no")
    return token_metrics(joined, label, prediction, groups)


def checked_lengths(records: DataFrame, key: str, tokens: str, labels: str, limit: int) -> DataFrame:
    """One row with the number, least, mean, median, p95 and largest of the token counts. Reading it fails if a record is over the limit or has no label but -100, or if there are no records."""
    over = F.when(F.col(tokens) > limit, F.raise_error(F.concat(F.lit("record "), F.col(key).cast("string"), F.lit(" has "), F.col(tokens).cast("string"), F.lit(f" tokens, over the limit of {limit}"))).cast("int"))
    bare = F.when(~F.exists(F.col(labels), lambda x: x != -100), F.raise_error(F.concat(F.lit("record "), F.col(key).cast("string"), F.lit(" has no supervised token"))).cast("int"))
    checked = records.select(F.coalesce(over, bare, F.col(tokens)).alias("n"))
    q = F.percentile("n", [0.5, 0.95])
    whole = checked.agg(F.count("n").alias("records"), F.min("n").alias("least"), F.avg("n").alias("mean"), q[0].alias("median"), q[1].alias("p95"), F.max("n").alias("largest"))
    empty = F.when(F.col("records") == 0, F.raise_error(F.lit("no records")).cast("long")).otherwise(F.col("records"))
    return whole.withColumn("records", empty)
