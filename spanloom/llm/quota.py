"""A sample whose shares over categories follow given targets."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.detrand import random_key
from ..shared import broadcast_if_small, discard, written
from .keys import bin_bits


@dataclass(frozen=True)
class Cell:
    """A target cell with the number of ids it wants and has."""

    no: int
    permille: int
    floor: int
    available: int

    def wanted(self, n: int) -> int:
        return max(-(-self.permille * n // 1000), self.floor)


def lacking(cells: list[Cell], n: int) -> dict[int, int]:
    """Ids that each cell's availability takes from what it wants of a sample of n."""
    return {c.no: max(0, c.wanted(n) - c.available) for c in cells}


def allocate(cells: list[Cell], n: int) -> dict[int, int]:
    """Integer quotas for a sample of n: floors first (as far as there are ids), then the rest by largest remainder of the
    shares, with availability as a cap. What a full cell can't take goes to the others in proportion to their targets. The sum is n,
    or what all cells have if that is less (a cell without a share has its floor), or the sum of floors if that is more. Ties go to the smaller cell number.

    A round settles the cells under their floors if these ask for more than the full cells leave, else the full ones, so none is settled too early."""
    quota = {c.no: min(c.floor, c.available) for c in cells}
    open_cells = sorted(cells, key=lambda c: c.no)
    fixed: dict[int, int] = {}
    while open_cells:
        rest = n - sum(fixed.values())
        weight = sum(c.permille for c in open_cells)
        if rest <= 0 or weight == 0:
            break
        share = {c.no: Fraction(c.permille * rest, weight) for c in open_cells}
        low = {c.no: q for c in open_cells if (q := quota[c.no]) > share[c.no]}
        full = {c.no: c.available for c in open_cells if c.available < share[c.no]}
        over = sum(q - share[k] for k, q in (low | full).items())
        bound = (low if over >= 0 else {}) | (full if over <= 0 else {})
        if not bound:
            down = {k: int(s) for k, s in share.items()}
            left = rest - sum(down.values())
            for c in sorted(open_cells, key=lambda c: (down[c.no] - share[c.no], c.no)):
                more = int(left > 0 and down[c.no] < c.available)
                fixed[c.no] = down[c.no] + more
                left -= more
            open_cells = []
            break
        fixed |= bound
        open_cells = [c for c in open_cells if c.no not in bound]
    return {c.no: fixed.get(c.no, quota[c.no]) for c in cells}


@dataclass(frozen=True)
class QuotaSample:
    """``sample``: id and the category columns, spelt as in the targets. ``report``: one row per target cell with target_no, the categories, permille,
    wanted, available, quota (what was drawn), shortfall (wanted - available where positive) and size, the asked size of the sample."""

    sample: DataFrame
    report: DataFrame


def quota_sample(
    records: DataFrame, id_col: str, categories: list[str], targets: DataFrame, domains: dict[str, list[str]], per_mille_of_ids: int = 100, seed: int = 7
) -> QuotaSample:
    """Draw distinct ids so that the shares of the cells follow ``targets`` (the category columns, target_no, target_permille, min_rows).

    Labels are compared without surrounding spaces and in lower case; null labels match no cell, null ids take no part. The
    size is ``per_mille_of_ids`` of the distinct ids that have a row with all labels in ``domains``. Re-delivered rows of an id
    count once in a cell; an id with rows in two cells counts in both. A target table with a cell twice keeps both rows; they draw
    from the same ids. Empty records give zero quotas. The target table is a configuration: it and one
    row per cell come to the driver, never the records.

    The ids with the smallest hashed keys of each cell are drawn. Keys are first counted by their top bits, as many as leave some thousand ids of the largest
    cell in a bin, so only the bin in which a cell's last id lies is ranked; no cell is sorted as a whole.
    """
    spark = records.sparkSession
    names = [f"c{k}" for k in range(len(categories))]
    cleaned = [F.lower(F.trim(F.col(c))).alias(n) for c, n in zip(categories, names, strict=True)]
    ids = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *cleaned).dropna(subset=names).distinct()
    ids = written(ids, "quota-ids")
    known = F.lit(True)
    for n, c in zip(names, categories, strict=True):
        known = known & F.col(n).isin([x.strip(" ").lower() for x in domains[c]])
    total = ids.where(known).select("id").distinct().count()
    n = total * per_mille_of_ids // 1000
    wanted = targets.select("target_no", *categories, "target_permille", "min_rows", *cleaned)
    counts = ids.groupBy(*names).count()
    rows = wanted.join(counts, names, "left").select("target_no", *categories, "target_permille", "min_rows", F.coalesce("count", F.lit(0)).alias("available")).collect()
    cells = [Cell(k, r.target_permille, r.min_rows, r.available) for k, r in enumerate(rows)]
    quota, short = allocate(cells, n), lacking(cells, n)
    schema = T.StructType([*wanted.select("target_no", *categories).schema.fields, *(T.StructField(x, T.LongType()) for x in ("permille", "wanted", "available", "quota", "shortfall", "size"))])
    report = spark.createDataFrame([(r.target_no, *(r[c] for c in categories), c.permille, c.wanted(n), c.available, quota[c.no], short[c.no], n) for r, c in zip(rows, cells, strict=True)], schema)
    drawn = report.where("quota > 0").groupBy(*cleaned).agg(F.max(F.struct("quota", *categories)).alias("cell"))
    drawn = broadcast_if_small(drawn.select(*names, "cell.*"), 100_000)
    bits = bin_bits(max((c.available for c in cells), default=0))
    keyed = ids.join(drawn, names).withColumn("key", random_key(F.col("id"), "sample", seed)).withColumn("bin", F.shiftright("key", 60 - bits).cast("int"))
    bins = keyed.groupBy(*names, "quota", "bin").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy(*names).orderBy("bin")) - F.col("n")
    last = bins.withColumn("below", below).where("below < quota").withColumn("all", F.expr("below + n <= quota")).select(*names, "bin", "below", "all")
    near = keyed.join(broadcast_if_small(last, 500_000), [*names, "bin"])
    edge = near.where("not all").withColumn("rank", F.row_number().over(Window.partitionBy(*names).orderBy("key", "id"))).where("rank <= quota - below")
    cols = ["id", *categories]
    return QuotaSample(near.where("all").select(*cols).unionAll(edge.select(*cols)), report)
