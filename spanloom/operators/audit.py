"""Overlap between corpora, leaks, first-wins selections and quotas of records."""

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import normalise, shingles, words
from ..shared import broadcast_if_small


def exact_overlap(test: DataFrame, text: str, train: DataFrame, train_text: str) -> DataFrame:
    """Test rows with ``in_train``: whether the normalised text also stands in the training rows. Null texts don't."""
    known = train.select(F.xxhash64(normalise(F.col(train_text))).alias("h"), normalise(F.col(train_text)).alias("k")).where("k is not null").distinct().withColumn("in_train", F.lit(True))
    keyed = test.withColumns({"h": F.xxhash64(normalise(F.col(text))), "k": normalise(F.col(text))})
    return keyed.join(known, ["h", "k"], "left").withColumn("in_train", F.coalesce("in_train", F.lit(False))).drop("h", "k")


def shingle_overlap(test: DataFrame, id_col: str, text: str, train: DataFrame, train_text: str, n: int = 8) -> DataFrame:
    """(id, shingles, shared, fraction) of each test row: the share of its distinct runs of n words that stand in the training rows.

    Texts under n words have no shingles and a null fraction. The join is on 64-bit hashes of the runs; training hashes are
    made distinct before it, and each test row's hits are counted on the map side first.
    """
    w = lambda c: words(normalise(F.col(c)))
    known = train.select(F.explode(shingles(w(train_text), n)).alias("g")).distinct().withColumn("hit", F.lit(1))
    grams = test.select(F.col(id_col).alias("id"), F.explode_outer(shingles(w(text), n)).alias("g"))
    counts = grams.join(known, "g", "left").groupBy("id").agg(F.count("g").alias("shingles"), F.count("hit").alias("shared"))
    return counts.withColumn("fraction", F.expr("try_divide(shared, shingles)"))


def overlap_summary(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Per group of rows with in_train and fraction: n, exact, any, at least half, mean and largest percentage. The mean leaves out rows without shingles."""
    return rows.groupBy(*groups).agg(
        F.count("*").alias("n"), F.count_if("in_train").alias("exact"), F.count_if(F.col("fraction") > 0).alias("any_overlap"), F.count_if(F.col("fraction") >= 0.5).alias("half_overlap"),
        F.round(F.avg("fraction") * 100, 6).alias("mean_percent"), F.round(F.max("fraction") * 100, 6).alias("max_percent"),
    )


def leaky(records: DataFrame, clean: str, injection: str, prefix: int = 40, max_prefixes: int = 200_000) -> DataFrame:
    """Records with ``leaks``: whether the clean text holds the record's own injection or the first ``prefix`` characters of any injection in the table.

    Up to ``max_prefixes`` distinct prefixes become one automaton that scans each text once. Beyond, windows of the texts are
    joined with the prefixes: only those that stand at a place where the first eight characters of some prefix do. Injections shorter than ``prefix`` count for their own record only.
    """
    prefixes = records.select(F.left(F.col(injection), F.lit(prefix)).alias("p")).where(F.length("p") == prefix).distinct()
    own = F.coalesce((F.length(injection) > 0) & F.col(clean).contains(F.col(injection)), F.lit(False))
    few = prefixes.limit(max_prefixes + 1).collect()
    if len(few) <= max_prefixes:
        shared = records.sparkSession.sparkContext.broadcast([r.p for r in few])
        return records.withColumn("leaks", own | holds_any(shared)(F.col(clean)))
    starts = F.transform(F.sequence(F.lit(1), F.length(clean) - (prefix - 1)), lambda i: F.substring(F.col(clean), i, F.lit(prefix)))
    keyed = records.withColumn("_row", F.monotonically_increasing_id())
    windows = keyed.where(F.length(clean) >= prefix).select("_row", F.explode(F.array_distinct(starts)).alias("p"))
    heads = prefixes.select(F.left("p", F.lit(8)).alias("head")).distinct()
    near = windows.withColumn("head", F.left("p", F.lit(8))).join(broadcast_if_small(heads, max_prefixes), "head", "left_semi")
    hit = near.join(prefixes, "p", "left_semi").select("_row").distinct().withColumn("_hit", F.lit(True))
    return keyed.join(hit, "_row", "left").withColumn("leaks", own | F.coalesce("_hit", F.lit(False))).drop("_row", "_hit")


def holds_any(needles):
    """A vectorised test whether a text holds any of the broadcast strings; false for null."""

    @F.pandas_udf(T.BooleanType())
    def test(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for needle in needles.value:
            automaton.add_word(needle)
        automaton.make_automaton()
        empty = not needles.value
        for part in texts:
            yield pd.Series([not empty and t is not None and next(automaton.iter(t), None) is not None for t in part])

    return test


def first_per(records: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; the rank limit is pushed below the shuffle by the optimiser."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return records.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def quota(records: DataFrame, keys: list[str], order: list[Column], size: int, strict: bool = False) -> DataFrame:
    """Up to ``size`` rows of each key in the given order, with the number of rows the key has. With ``strict`` reading fails if a key has fewer than ``size``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = records.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
    n = F.count("*")
    if strict:
        n = F.when(n >= size, n).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {size} rows: "), n.cast("string"))).cast("long"))
    return ranked.join(records.groupBy(*keys).agg(n.alias("available")), keys)


def converted(records: DataFrame, leaks: str, marker: Column) -> tuple[DataFrame, DataFrame]:
    """Records without those that leak or show a marker, and one row with how many were written and skipped for either reason (a leak counts first)."""
    leak, marked = F.coalesce(F.col(leaks), F.lit(False)), F.coalesce(marker, F.lit(False))
    report = records.agg(F.count_if(~leak & ~marked).alias("written"), F.count_if(leak).alias("leaky"), F.count_if(~leak & marked).alias("marked"))
    return records.where(~leak & ~marked), report


def numbered_repeats(records: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Records whose name is made unique: the second and later ones of a name, in the given order, end in _2, _3 and so on."""
    w = Window.partitionBy(name).orderBy(*order)
    k = F.row_number().over(w)
    return records.withColumn(name, F.when(k > 1, F.concat(F.col(name), F.lit("_"), k.cast("string"))).otherwise(F.col(name)))


def clean_counterpart(records: DataFrame) -> DataFrame:
    """The Clean form of each record: spans, injection and labels emptied, the text replaced by the clean one and the id's ending by -clean."""
    empty = F.lit("")
    return records.withColumns(
        {
            "id": F.concat(F.regexp_replace("id", "-(ipi|attacked)$", ""), F.lit("-clean")), "attacked_data": F.col("clean_data"), "injection": empty, "inserted_text": empty,
            "drop_spans": F.array().cast("array<struct<start:int,end:int>>"), "attack_type": F.lit("Clean"), "position": F.lit("none"), "cut_type": F.lit("none"),
        }
    )


def paired(samples: DataFrame, keys: list[str], flag: str, text: str, injection: str) -> DataFrame:
    """One row per key with the benign and injected texts and whether it is a proper pair: exactly one of each, and removing the injection
    from the one gives the other. Repeated rows make a key improper."""
    return (
        samples.groupBy(*keys)
        .agg(
            F.count_if(~F.col(flag)).alias("benign"), F.count_if(F.col(flag)).alias("injected"),
            F.min(F.when(~F.col(flag), F.col(text))).alias("benign_text"), F.min(F.when(F.col(flag), F.col(text))).alias("injected_text"), F.min(F.when(F.col(flag), F.col(injection))).alias("injection"),
        )
        .withColumn("proper", (F.col("benign") == 1) & (F.col("injected") == 1))
        .withColumn("removable", F.col("proper") & F.coalesce(F.replace("injected_text", "injection", F.lit("")) == F.col("benign_text"), F.lit(False)))
    )
