"""Queries and changes of nested environments, on flat tables: one table per list of an environment, path tables for trees.

Changes are pure: each gives the table after the change. Nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..shared import written


def search(table: DataFrame, query: str | None = None, in_columns: list[str] | None = None, equal: dict | None = None, ranges: dict | None = None, ignore_case: bool = True) -> DataFrame:
    """Rows that hold ``query`` in any of the columns and meet all given equalities and inclusive (low, high) ranges; every argument that is None is no condition.

    Texts compare without case, nulls match nothing.
    """
    low = F.lower if ignore_case else (lambda c: c)
    conditions: list[Column] = []
    if query is not None:
        conditions.append(reduce(lambda a, b: a | b, (F.coalesce(low(F.col(c)).contains(query.lower() if ignore_case else query), F.lit(False)) for c in in_columns or table.columns)))
    for column, value in (equal or {}).items():
        if value is not None:
            conditions.append(low(F.col(column)) == value.lower() if isinstance(value, str) and ignore_case else F.col(column) == value)
    for column, (least, most) in (ranges or {}).items():
        conditions += [F.col(column) >= least] * (least is not None) + [F.col(column) <= most] * (most is not None)
    return table.where(reduce(lambda a, b: a & b, conditions)) if conditions else table


def require(table: DataFrame, what: str) -> DataFrame:
    """The table; a query over an empty one fails."""
    n = table.groupBy().agg(F.count("*").alias("_n"))
    ok = F.when(F.col("_n") > 0, F.lit(True)).otherwise(F.raise_error(F.lit(f"no {what} found")).cast("boolean"))
    return table.crossJoin(F.broadcast(n.where(ok))).drop("_n")


def next_id(table: DataFrame, column: str) -> DataFrame:
    """One row with the next free number: 1 in an empty table. Ids that are no numbers don't count."""
    return table.agg((F.coalesce(F.max(F.expr(f"try_cast({column} as bigint)")), F.lit(0)) + 1).alias("next_id"))


def append(table: DataFrame, rows: DataFrame, id_column: str) -> DataFrame:
    """The table with new rows, numbered on from its largest id in the order of their other columns.

    The rows are sorted over all tasks and written with their place in their task; one number for each task then makes places of the whole, so no task sees all rows.
    """
    free = next_id(table, id_column)
    others = [c for c in table.columns if c != id_column]
    placed = rows.select(*others).orderBy(*others).select(*others, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_k"))
    placed = written(placed, "appended")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = placed.join(F.broadcast(before), "_part").crossJoin(F.broadcast(free))
    return table.unionByName(numbered.select((F.col("next_id") + F.col("_before") + F.col("_k")).cast(table.schema[id_column].dataType).alias(id_column), *others))


def lookup(table: DataFrame, keys: dict[str, object], columns: list[str] | None = None) -> DataFrame:
    """The rows with exactly these key values (null matches null), with some or all columns; nested fields by their dotted path."""
    found = table.where(reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in keys.items())))
    return found.select(*(F.col(c).alias(c.rsplit(".", 1)[-1]) for c in columns)) if columns else found


def update(table: DataFrame, where: Column, values: dict[str, Column | None]) -> DataFrame:
    """Rows that meet the condition with new values; a value of None leaves its column as it is."""
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items() if v is not None})


def delete(table: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """The table without the rows that meet the condition, and those rows."""
    hit = F.coalesce(where, F.lit(False))
    return table.where(~hit), table.where(hit)


def take_unread(mails: DataFrame, read: str = "read") -> tuple[DataFrame, DataFrame]:
    """The unread mails, and the table with all mails read."""
    return mails.where(~F.coalesce(F.col(read), F.lit(False))), mails.withColumn(read, F.lit(True))


def most_recent(table: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def conflicts(events: DataFrame, keys: list[str], id_column: str, start: str, end: str, as_listed: bool = False, bin_seconds: int = 604_800) -> DataFrame:
    """Pairs of events of a key that overlap, as (keys, first, second) with first < second.

    An event stands in every bin of ``bin_seconds`` that it touches, and only events of one bin are compared, so the work of a busy key grows with what happens at one time. A pair
    counts in the first bin that both touch. Times are timestamps or numbers of seconds; an event without one has no conflicts.

    With ``as_listed`` an event counts only if it starts or ends within the one listed before it, which misses a later one that
    encloses an earlier one.
    """
    def seconds(c: str) -> Column:
        at = F.col(c) if isinstance(events.schema[c].dataType, T.NumericType) else F.unix_seconds(F.col(c).cast("timestamp"))
        return F.floor(at / bin_seconds)

    given = events.select(*keys, id_column, start, end).where(F.col(start).isNotNull() & F.col(end).isNotNull())
    bins = given.withColumn("_first", seconds(start)).withColumn("_bin", F.explode(F.sequence("_first", F.greatest("_first", seconds(end)))))
    a, b = bins.alias("a"), bins.alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_bin"])) & (F.col("a._bin") == F.greatest("a._first", "b._first"))
    s1, e1, s2, e2 = F.col(f"a.{start}"), F.col(f"a.{end}"), F.col(f"b.{start}"), F.col(f"b.{end}")
    meet = ((s1 <= s2) & (s2 < e1)) | ((s1 < e2) & (e2 <= e1)) if as_listed else (s1 < e2) & (s2 < e1)
    return a.join(b, same & (F.col(f"a.{id_column}") < F.col(f"b.{id_column}")) & meet).select(*(F.col(f"a.{k}") for k in keys), F.col(f"a.{id_column}").alias("first"), F.col(f"b.{id_column}").alias("second"))


def basket_total(items: DataFrame, products: DataFrame, basket: str, product: str, quantity: str, price: str) -> DataFrame:
    """Sum of price times quantity of each basket, with the number of items; items without a product are left out."""
    joined = items.join(products, product)
    return joined.groupBy(basket).agg(F.count("*").alias("items"), F.sum(F.col(price) * F.col(quantity)).alias("total"))


def contacts(mails: DataFrame, addresses: Column) -> DataFrame:
    """Distinct addresses, lower-cased, with a name made of the part before the @."""
    found = mails.select(F.explode(addresses).alias("a")).select(F.lower("a").alias("email")).distinct()
    return found.withColumn("name", F.initcap(F.replace(F.substring_index("email", "@", 1), F.lit("."), F.lit(" "))))


def members_of(users: DataFrame, user: str, channels: str, channel: str | Column) -> DataFrame:
    """Users of a channel, from an array of channels per user."""
    return users.where(F.array_contains(channels, channel)).select(user)


def as_map(table: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a map from keys to values; of repeated keys the largest value counts."""
    one = table.groupBy(key).agg(F.max(value).alias("_v"))
    return one.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "_v")))).alias("map"))


# Trees as tables of paths with "/" between names and no slash at the end.


def parent(path: Column) -> Column:
    """The directory of a path; empty at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def under(path: Column, root: str) -> Column:
    """Whether a path is the root or lies below it; all do below the empty root."""
    return F.lit(True) if root == "" else (path == root) | path.startswith(root + "/")


def listing(nodes: DataFrame, root: str) -> DataFrame:
    """Names right below a directory, with the number of nodes at or below each."""
    inner = nodes.where(under(F.col("path"), root) & (F.col("path") != root))
    rest = F.substring("path", F.lit(len(root) + 2 if root else 1), F.length("path"))
    return inner.groupBy(F.substring_index(rest, "/", 1).alias("name")).agg(F.count("*").alias("nodes"))


def copy_tree(nodes: DataFrame, source: str, target: str) -> DataFrame:
    """The table with the subtree at ``source`` also at ``target``; what stood there is replaced."""
    moved = nodes.where(under(F.col("path"), source)).withColumn("path", F.concat(F.lit(target), F.substring("path", F.lit(len(source) + 1), F.length("path"))))
    return nodes.join(moved.select("path"), "path", "left_anti").unionByName(moved)


def move_tree(nodes: DataFrame, source: str, target: str) -> DataFrame:
    return delete(copy_tree(nodes, source, target), under(F.col("path"), source))[0]


def merge_trees(local: DataFrame, remote: DataFrame, local_wins: bool) -> DataFrame:
    """Union of two trees by path with ``state``: added, removed, changed or same, seen from the local one; the winner's content counts."""
    a, b = local.select("path", F.col("content").alias("mine")), remote.select("path", F.col("content").alias("theirs"))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "path", "full")
    state = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("mine").eqNullSafe(F.col("theirs")), "same").otherwise("changed")
    first, second = ("mine", "theirs") if local_wins else ("theirs", "mine")
    content = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col(first)).otherwise(F.coalesce(F.col(first), F.col(second)))
    return both.select("path", content.alias("content"), state.alias("state"))


def standard_url(url: Column) -> Column:
    """An address without scheme, leading www. and slash at the end, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://", ""), r"^www\.|/+$", "")


def placeholders_filled(template: Column, values: Column) -> Column:
    """A text with each {name} of a map replaced; unknown ones stay."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def filled_with_defaults(template: Column, values: Column, defaults: Column) -> Column:
    """A text with each {name} of the defaults replaced by its value, or by its default where there is none; unknown names stay."""
    return placeholders_filled(template, F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(values, k)), F.map_filter(values, lambda k, v: F.map_contains_key(defaults, k))))


def first_rule(calls: DataFrame, call: str, rules: DataFrame, tool: str, priority: str, effect: str, matches: Column) -> DataFrame:
    """The effect of the first rule of each call's tool that matches: smallest priority first, deny before allow; calls without one are denied."""
    joined = calls.join(F.broadcast(rules) if rules.isLocal() else rules, tool, "left")
    hit = F.coalesce(matches, F.lit(False))
    order = F.struct(F.when(hit, F.col(priority)), F.when(hit, (F.col(effect) != "deny").cast("int")), F.when(hit, F.col(effect)))
    chosen = joined.groupBy(call).agg(F.min(F.when(hit, order)).alias("_r"))
    return chosen.select(call, F.coalesce(F.col("_r")["col3"], F.lit("deny")).alias(effect))
