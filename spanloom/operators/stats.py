"""Intervals, fronts, bins and length summaries."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def wilson(successes: Column, total: Column, z: float = Z95) -> Column:
    """struct(low, high) of the Wilson score interval in percent; null for no trials."""
    p, denom = successes / total, 1 + z * z / total
    center, half = (p + z * z / (2 * total)) / denom, z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / denom
    return F.when(total > 0, F.struct(((center - half) * 100).alias("low"), ((center + half) * 100).alias("high")))


def normal_interval(p: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of a proportion by the normal approximation, cut to [0, 1]."""
    half = z * F.sqrt(p * (1 - p) / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), p - half).alias("low"), F.least(F.lit(1.0), p + half).alias("high")))


def standard_error(x: Column) -> Column:
    """Standard error of the mean with n - 1 in the variance; 0 for one value."""
    return F.coalesce(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))


def length_summary(table: DataFrame, groups: list[str], length: Column, thresholds: list[int]) -> DataFrame:
    """Count, least, mean, percentiles (interpolated), largest, and how many lie over each threshold.

    Equal lengths are counted first, over all tasks, so what a group's last task sees is its distinct lengths, never its rows.
    """
    counted = table.select(*groups, length.alias("_len")).groupBy(*groups, "_len").agg(F.count("*").alias("_n"))
    n = F.when(F.col("_len").isNotNull(), F.col("_n"))
    quantiles = F.percentile("_len", [0.5, 0.9, 0.95, 0.99], F.col("_n"))
    names = ("p50", "p90", "p95", "p99")
    rows = counted.groupBy(*groups).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.min("_len").alias("least"), F.round(F.sum(F.col("_len") * F.col("_n")) / F.sum(n), 6).alias("mean"), quantiles.alias("q"), F.max("_len").alias("largest"),
        *(F.coalesce(F.sum(F.when(F.col("_len") > t, F.col("_n"))), F.lit(0)).alias(f"over_{t}") for t in thresholds),
    )
    return rows.select(*groups, "n", "least", "mean", *(F.round(F.col("q")[k], 6).alias(name) for k, name in enumerate(names)), "largest", *(f"over_{t}" for t in thresholds))


def running_mean(table: DataFrame, key: str, at: str, tie: str, value: str, bin_seconds: int = 86_400) -> DataFrame:
    """Rows with ``running_mean``: the mean of the values of their key up to them, in order of time and tie. Null values don't count.

    Sums of time bins come first and are carried on over the bins of a key, so a row is only ordered among those of its key and bin: a key that holds most rows is spread over its bins.
    """
    binned = table.withColumn("_bin", F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / bin_seconds))
    bins = binned.groupBy(key, "_bin").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    over = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select(F.col(key).alias("_key"), F.col("_bin").alias("_of"), F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_n0"))
    joined = binned.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bin").eqNullSafe(F.col("_of")))
    within = Window.partitionBy(key, "_bin").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    mean = (F.col("_s0") + F.coalesce(F.sum(value).over(within), F.lit(0))) / F.nullif(F.col("_n0") + F.count(value).over(within), F.lit(0))
    return joined.select(*table.columns, mean.alias("running_mean"))


def pareto_front(table: DataFrame, groups: list[str], first: str, second: str, second_high: bool = False) -> DataFrame:
    """Rows that beat all rows with a larger or equal ``first`` in ``second``: ordered by first descending and second ascending, strict improvements of the running maximum.
    With ``second_high`` the best ``second`` of equal ``first`` comes first, so only rows that no other beats are kept."""
    w = Window.partitionBy(*groups).orderBy(F.desc(first), F.desc(second) if second_high else F.asc(second)).rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("_best", F.max(second).over(w)).where(F.col("_best").isNull() | (F.col(second) > F.col("_best"))).drop("_best")


def bin_of(x: Column, bins: int, low: float = 0.0, high: float = 1.0) -> Column:
    """Number (from 1) of the equal bin of [low, high] that holds x; the last bin holds its upper end."""
    return F.least(F.floor((x - low) / (high - low) * bins) + 1, F.lit(bins)).cast("int")


def _generator(seed: int, key: tuple) -> np.random.Generator:
    """A generator of its own for each group, so that intervals are independent and don't depend on the order of groups."""
    return np.random.default_rng([seed, zlib.crc32(repr(key).encode())])


def _resampled_means(values: np.ndarray, counts: np.ndarray, iterations: int, rng: np.random.Generator) -> np.ndarray:
    """Means of resamples of as many values as there are, drawn with replacement: a resample of n values is a multinomial draw of the distinct ones."""
    n = int(counts.sum())
    if len(values) == 1:
        return np.full(iterations, values[0])
    if len(values) == 2:
        k = rng.binomial(n, counts[1] / n, iterations)
        return (values[0] * (n - k) + values[1] * k) / n
    out = np.empty(iterations)
    step = max(1, 4_000_000 // len(values))
    for k in range(0, iterations, step):
        out[k : k + step] = rng.multinomial(n, counts / n, min(step, iterations - k)) @ values / n
    return out


def bootstrap(table: DataFrame, groups: list[str], value: str, iterations: int = 10_000, seed: int = 42, most: int = 20_000) -> DataFrame:
    """Number, mean and 95 % percentile bootstrap interval of the mean of a numeric or boolean value per group, in percent: (groups, n, mean, low, high).

    Equal values are counted by Spark, so a group reaches Python as its distinct values and their counts. A group with more than ``most`` distinct values isn't resampled:
    the mean of a resample then is normal with the group's own variance to within the interval's own error, so Python gets the moments only and draws from that. Null values are ignored; an empty group gives nulls.
    """
    v = F.col(value).cast("double")
    counts = table.select(*groups, v.alias("_v")).groupBy(*groups, "_v").agg(F.count("*").alias("_n"))
    known = F.col("_v").isNotNull()
    few = counts.groupBy(*groups).agg(
        F.sum(F.when(known, F.col("_n"))).alias("n"), (F.sum(F.col("_v") * F.col("_n")) / F.sum(F.when(known, F.col("_n")))).alias("mean"),
        (F.sum(F.col("_v") * F.col("_v") * F.col("_n")) / F.sum(F.when(known, F.col("_n")))).alias("_square"), F.count("_v").alias("_distinct"),
    )
    # Distinct values of groups within the bound only, so that no row grows with the data.
    small = few.where(F.col("_distinct") <= most).select(*groups)
    same = [counts[g].eqNullSafe(small[g]) for g in groups]
    listed = counts.join(small, same, "left_semi") if groups else counts.join(few.where(F.col("_distinct") <= most).select(F.lit(1)), F.lit(True), "left_semi")
    values = listed.where(known).groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("_v", "_n"))).alias("_values"))
    joined = few.join(values, [few[g].eqNullSafe(values[g]) for g in groups], "left").select(*(few[g] for g in groups), "n", "mean", "_square", "_values") if groups else few.crossJoin(values).select("n", "mean", "_square", "_values")

    def draw(parts):
        for pdf in parts:
            low, high = [], []
            for row in pdf.itertuples(index=False):
                if not row.n or row.n != row.n:
                    low.append(np.nan), high.append(np.nan)
                    continue
                rng = _generator(seed, tuple(row[: len(groups)]))
                if row[-1] is None or not len(row[-1]):
                    means = rng.normal(row.mean, np.sqrt(max(0.0, row[-2] - row.mean**2) / row.n), iterations)
                else:
                    pairs = np.array([(p["_v"], p["_n"]) for p in row[-1]])
                    means = _resampled_means(pairs[:, 0], pairs[:, 1], iterations, rng)
                a, b = np.percentile(means, [2.5, 97.5])
                low.append(a * 100), high.append(b * 100)
            out = pdf.iloc[:, : len(groups) + 2].copy()
            yield out.assign(mean=out["mean"] * 100, low=pd.Series(low, index=pdf.index, dtype=float), high=pd.Series(high, index=pdf.index, dtype=float))

    fields = ", ".join(f"`{g}` {table.schema[g].dataType.simpleString()}" for g in groups)
    return joined.mapInPandas(draw, f"{fields}{', ' if groups else ''}n long, mean double, low double, high double")


def macro_bootstrap(table: DataFrame, groups: list[str], stratum: str, flag: str, iterations: int = 10_000, seed: int = 42) -> DataFrame:
    """Macro average of a 0/1 flag over strata and its 95 % percentile bootstrap interval, in percent: (groups, strata, mean, low, high).

    A resample draws within each stratum and averages the strata's means without weights. A stratum reaches Python as two counts; null flags are ignored and strata without any other left out.
    """
    x = F.col(flag).cast("int")
    counts = table.groupBy(*groups, stratum).agg(F.count(x).alias("n"), F.sum(x).alias("k")).where("n > 0")
    rows = counts.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("n", "k"))).alias("_strata"))

    def draw(parts):
        for pdf in parts:
            got = []
            for row in pdf.itertuples(index=False):
                rng = _generator(seed, tuple(row[:-1]))
                means = np.mean([rng.binomial(s["n"], s["k"] / s["n"], iterations) / s["n"] for s in row[-1]], axis=0)
                got.append((len(row[-1]), 100 * float(np.mean([s["k"] / s["n"] for s in row[-1]])), *(100 * np.percentile(means, [2.5, 97.5]))))
            strata, mean, low, high = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [], [])
            yield pdf[list(groups)].assign(strata=strata, mean=mean, low=low, high=high)

    fields = ", ".join(f"`{g}` {table.schema[g].dataType.simpleString()}" for g in groups)
    return rows.mapInPandas(draw, f"{fields}{', ' if groups else ''}strata long, mean double, low double, high double")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], bin_seconds: int | None = None) -> DataFrame:
    """Left rows with the values of the latest right row of their key at or before their time, null where there is none.

    Both sides are united and ordered by time within the key: no inequality join. At equal times right rows come first; of right rows at one time, the one
    with the largest values counts. With ``bin_seconds`` rows are ordered within the key's time bins only, and the last right row of earlier bins is carried on from bin to bin,
    so a key that holds most rows is spread over its bins.
    """
    kind = right.select(F.struct(*values).alias("v")).schema["v"].dataType
    both = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(kind)}).unionByName(
        right.select(F.col(key), F.col(at), F.lit(0).alias("_side"), F.struct(*values).alias("_v")), allowMissingColumns=True
    )
    if bin_seconds is None:
        w = Window.partitionBy(key).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
        filled = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    else:
        both = both.withColumn("_bin", F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / bin_seconds))
        last = F.max(F.when(F.col("_side") == 0, F.struct(F.col(at).alias("t"), F.col("_v").alias("v"))))
        bins = both.groupBy(key, "_bin").agg(last.alias("_b"))
        over = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        carried = bins.select(F.col(key).alias("_key"), F.col("_bin").alias("_of"), F.last("_b", ignorenulls=True).over(over)["v"].alias("_carried"))
        w = Window.partitionBy(key, "_bin").orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
        filled = both.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bin").eqNullSafe(F.col("_of"))).withColumn("_last", F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_carried")))
    return filled.where("_side = 1").select(*left.columns, *(F.col("_last")[v].alias(v) for v in values))


def version_compatible(items: DataFrame, key: str, version: list[str], bound: tuple[int, ...], strictly: bool = False) -> DataFrame:
    """The row of each key with the highest version (numeric columns, most significant first) up to a bound, or below it."""
    v = F.struct(*(F.col(c).cast("int").alias(f"v{k}") for k, c in enumerate(version)))
    limit = F.struct(*(F.lit(x).cast("int").alias(f"v{k}") for k, x in enumerate(bound)))
    kept = items.where(v < limit if strictly else v <= limit)
    return kept.groupBy(key).agg(F.max_by(F.struct(*[c for c in items.columns if c != key]), v).alias("r")).select(key, "r.*")
