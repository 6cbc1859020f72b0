"""Choosing, ordering and combining records: filters with checks, ranks, top rows by score, unions in which one side wins, and corpora put together from sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.detrand import random_key
from ..shared import discard, written


def chosen_records(records: DataFrame, attack_type: str | None = None, position: str | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Records of an attack type and a position (None is no condition), and of these the first ``limit`` in the given order."""
    for column, value in (("attack_type", attack_type), ("position", position)):
        if value is not None:
            records = records.where(F.col(column) == value)
    return records if limit is None else records.orderBy(*order).limit(limit)


def with_input(records: DataFrame, text: str, index: str) -> DataFrame:
    """Records with a text that isn't blank, and their place in the source as ``source_index``."""
    return records.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("source_index", F.col(index))


def without_prefix(records: DataFrame, column: str, prefix: str, expected: int | None = None) -> DataFrame:
    """Records whose column doesn't begin with a prefix; null stays. If a number of dropped records is expected, the result fails on reading where it is another one."""
    begins = F.coalesce(F.col(column).startswith(prefix), F.lit(False))
    kept = records.where(~begins)
    if expected is None:
        return kept
    n = records.agg(F.count_if(begins).alias("_n"))
    right = F.when(F.col("_n") == expected, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"expected {expected} records with {prefix}, got "), F.col("_n").cast("string"))).cast("boolean"))
    return kept.crossJoin(F.broadcast(n.where(right))).drop("_n")


def rank_keys(column: str, first: list[str]) -> list[Column]:
    """Sort keys that put some values first, in their order, and the rest by name."""
    return [*(~F.col(column).eqNullSafe(F.lit(v)) for v in first), F.col(column)]


def best_by(rows: DataFrame, keys: list[str], score: Column, place: str) -> DataFrame:
    """The row with the highest score of each key; of equal scores the one with the smallest place. No sort: one aggregate."""
    order = F.struct(score.alias("s"), (-F.col(place)).alias("p"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), order).alias("_r")).select(*keys, "_r.*")


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], width: int) -> DataFrame:
    """The ``width`` first rows of each key; the limit is applied before the shuffle, too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= width).drop("_rank")


def searched(start: DataFrame, expand: Callable[[DataFrame, int], DataFrame], score: str, width: int, rounds: int, enough: float, tie: str) -> DataFrame:
    """A search that keeps the ``width`` rows with the best score of each round and expands them to the next, until one reaches ``enough`` or rounds end.

    ``expand(rows, round)`` gives the rows of the next round; scores fall from expensive calls, so a round is written before it is ranked. The result is the last round's best rows. Rounds are few and rows of a
    round few; the rows of the best of earlier rounds stay in the running, so the best score never falls.
    """
    pool, table = start, None
    for k in range(rounds + 1):
        best = written(pool.orderBy(F.desc(score), tie).limit(width), "search")
        if table is not None:
            discard(table)
        table = best
        top = best.agg(F.max(score)).first()[0]
        if k == rounds or (top is not None and top >= enough):
            break
        pool = best.unionByName(expand(best, k + 1))
    return table


def one_side_wins(winner: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables; where both have a key only the first one's count."""
    return winner.unionByName(other.join(winner.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def all_of(tables: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """Rows of all tables, repeated ones too; columns that one lacks are null. With ``names`` each row says where it is from as ``origin``."""
    named = [t.withColumn("origin", F.lit(n)) for t, n in zip(tables, names, strict=True)] if names else tables
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def missing_fields(needed: list[str], present: Column) -> Column:
    """Needed fields that an array of names lacks, in order."""
    return F.array_except(F.array(*map(F.lit, sorted(needed))), present)


def keys_within(given: Column, known: Column) -> Column:
    """Whether all keys of a map are keys of another; an empty map's are."""
    return F.size(F.array_except(F.map_keys(given), F.map_keys(known))) == 0


def visible_placeholders(outputs: DataFrame, keys: list[str], text: str, canaries: dict[str, str]) -> DataFrame:
    """(keys, placeholder) for each canary that some output of the key shows. The canaries are a configuration; outputs are tested in place and nothing is crossed."""
    shown = F.filter(F.array(*(F.when(F.col(text).contains(c), F.lit(n)) for n, c in sorted(canaries.items()))), lambda x: x.isNotNull())
    return outputs.select(*keys, F.explode(shown).alias("placeholder")).distinct()


def injectable(outputs: DataFrame, keys: list[str], text: str, canaries: dict[str, str]) -> DataFrame:
    """(keys, injectable): whether any output of the key shows a canary."""
    any_of = reduce(lambda a, b: a | b, (F.col(text).contains(c) for c in canaries.values()))
    return outputs.groupBy(*keys).agg(F.coalesce(F.max(F.coalesce(any_of, F.lit(False))), F.lit(False)).alias("injectable"))


def relabelled(column: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """A value renamed by a dictionary; others stay, or become the default."""
    found = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[column]
    return F.coalesce(found, column if default is None else default)


def with_details(base: DataFrame, key: list[str], others: list[DataFrame]) -> DataFrame:
    """The rows with the columns of other tables of one row per key, null where a table has none."""
    return reduce(lambda a, b: a.join(b, key, "left"), others, base)


def paired_corpus(candidates: DataFrame, order: list[str], text: str, templates: list[tuple[str, str]], seed: int = 7) -> DataFrame:
    """A benign and an injected record of each candidate: pairs numbered in the given order, templates (attack type, fragment) taken in turn, and ids given in a random order of all records.

    Numbers come from a sort over all tasks and one number for each, so no task sees all rows.
    """
    numbered = numbered_rows(candidates, [F.col(c) for c in order], "pair_index")
    turn = F.pmod("pair_index", F.lit(len(templates))).cast("int")
    pick = lambda k: F.element_at(F.array(*(F.lit(t[k]) for t in templates)), turn + 1)
    injected = F.struct(F.lit(True).alias("is_injection"), pick(0).alias("attack_type"), pick(1).alias("injection_text"), F.concat(F.col(text), F.lit(" "), pick(1)).alias("tool_output"))
    benign = F.struct(F.lit(False).alias("is_injection"), F.lit("none").alias("attack_type"), F.lit(None).cast("string").alias("injection_text"), F.col(text).alias("tool_output"))
    halves = numbered.select(*(c for c in numbered.columns if c != text), F.explode(F.array(benign, injected)).alias("_h")).select("*", "_h.*").drop("_h")
    named = halves.withColumn("source_pair_id", F.format_string("test_pair_%03d", F.col("pair_index")))
    mixed = numbered_rows(named, [random_key(F.concat_ws("/", "source_pair_id", "is_injection"), "mix", seed), F.col("source_pair_id"), F.col("is_injection")], "_n")
    return mixed.withColumn("id", F.format_string("test_%03d", F.col("_n"))).drop("_n")


def numbered_rows(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in the given order, which must be total."""
    placed = rows.withColumns({f"_o{k}": c for k, c in enumerate(order)}).orderBy(*(f"_o{k}" for k in range(len(order))))
    placed = written(placed.drop(*(f"_o{k}" for k in range(len(order)))).withColumns({"_part": F.spark_partition_id(), "_k": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_k")).drop("_part", "_k", "_before")


def annotation_corpus(sources: dict[str, DataFrame], text: str, per_source: int, seed: int = 42, prefix: dict[str, int] | None = None, order: str | None = None) -> DataFrame:
    """(id, complete_text): up to ``per_source`` texts of each source that aren't blank, in a random order, numbered from 0 as "<source>-000000".

    A source in ``prefix`` is drawn from its first rows in ``order`` only, as many as said: a bounded read of a large source.
    """
    parts = []
    for name, table in sources.items():
        if prefix and name in prefix:
            table = table.orderBy(order).limit(prefix[name])
        texts = table.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(F.col(text).alias("complete_text"))
        key = random_key(F.md5("complete_text"), name, seed)
        drawn = texts.withColumn("_key", key).orderBy("_key", "complete_text").limit(per_source)
        numbered = drawn.withColumn("_n", F.row_number().over(Window.orderBy("_key", "complete_text")) - 1)  # at most per_source rows
        parts.append(numbered.select(F.format_string(f"{name}-%06d", F.col("_n")).alias("id"), "complete_text"))
    return reduce(DataFrame.unionByName, parts)


def routed(records: DataFrame, done: DataFrame, key: str, fine: Column) -> tuple[DataFrame, DataFrame]:
    """Records whose key isn't done yet, in two tables: those that are fine, and the rejected rest."""
    left = records.join(done.select(key).distinct(), key, "left_anti")
    ok = F.coalesce(fine, F.lit(False))
    return left.where(ok), left.where(~ok)


def best_buffer(rows: DataFrame, loss: str, size: int, tie: str) -> DataFrame:
    """The ``size`` rows with the least loss; null losses don't count."""
    return rows.where(F.col(loss).isNotNull()).orderBy(loss, tie).limit(size)
