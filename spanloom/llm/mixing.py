"""Mixing sources to target weights, by hierarchical budgeting."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.detrand import random_key
from ..shared import broadcast_if_small
from .keys import bin_bits


@dataclass
class Node:
    """A node of the tree of sources: ``weight`` is its share among its siblings, None to follow the sizes; ``repeats`` caps its leaves. ``asked`` is what its weight gives it before any
    shortage, ``amount`` what it gets in the end, both exact; it is ``short`` if it can't hold what it was asked."""

    name: tuple[str, ...]
    weight: float | Fraction | None = None
    repeats: int = 1
    size: int = 0
    asked: Fraction = Fraction(0)
    amount: Fraction = Fraction(0)
    short: bool = False
    children: list[Node] = field(default_factory=list)

    def total(self) -> int:
        return sum(c.total() for c in self.children) if self.children else self.size

    def capacity(self) -> int:
        return sum(c.capacity() for c in self.children) if self.children else self.size * self.repeats

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


def demand(node: Node, asked: Fraction) -> None:
    """Propagate weights down the tree: what each node is asked for, and whether it is short of it."""
    node.asked, node.short = asked, node.capacity() < asked
    weights = _weights(node)
    whole = sum(weights.values())
    for c in node.children:
        demand(c, asked * weights[c.name] / whole if whole else Fraction(0))


def _weights(node: Node) -> dict[tuple[str, ...], Fraction]:
    return {c.name: Fraction(c.total() if c.weight is None else c.weight) for c in node.children}


def spread(node: Node, amount: Fraction | int) -> None:
    """Give ``amount`` to a node and divide it among its children by weight.

    A child gets no more than its capacity; what it can't take goes to its siblings in proportion to their weights. Only what
    all children together can't take stays with the node's own siblings, because a node's capacity is that of its leaves."""
    node.amount = min(Fraction(amount), Fraction(node.capacity()))
    if not node.children:
        return
    weights = _weights(node)
    waiting, rest = list(node.children), node.amount
    while waiting:
        whole = sum(weights[c.name] for c in waiting)
        if whole <= 0:
            for c in waiting:
                spread(c, 0)
            return
        full = [c for c in waiting if c.capacity() < rest * weights[c.name] / whole]
        if not full:
            for c in waiting:
                spread(c, rest * weights[c.name] / whole)
            return
        for c in full:
            spread(c, c.capacity())
            rest -= c.capacity()
        waiting = [c for c in waiting if c not in full]


@dataclass(frozen=True)
class Mixture:
    """``rows``: the id, leaf (array of names), epoch (from 1) and size of every drawn document, once for each epoch. ``report``: one row per
    target with its domain, weight_permille, max_repeats, size (of its documents), reachable, asked, short (whether it can't reach what it is asked), and budget (allotted). ``total``: size of all documents of the targets."""

    rows: DataFrame
    report: DataFrame
    total: int


def mixture(
    documents: DataFrame, id_col: str, size: Column, source: Column, targets: DataFrame, below: list[Column] = [], budget: int | None = None, seed: int = 7, max_leaves: int = 100_000, domain: Callable[[str], str] | None = None  # noqa: B006
) -> Mixture:
    """A mixture in which each source of ``targets`` (source, weight_permille, max_repeats) has its share of ``budget``, by default the size of all its documents.

    ``source`` is the cleaned source of a document and ``below`` holds further levels of the tree under it (such as the
    language), which follow their own sizes. Documents with a null size, a null source or one that isn't in ``targets`` take no part;
    a null level below counts as "". ``domain`` names the domain of a source, a level above the sources whose weight is the sum of theirs; without it there is none.
    Repeated documents count under each id. Sources without documents are reported with size 0. Shortages go to siblings first (the sources of the same domain),
    then up the tree. A leaf's whole epochs take all its documents, the last one those with the smallest seeded keys as long as they fit into the
    leaf's budget: whole documents only, so a leaf stays below its budget by less than one document. The keys' sizes are first summed by
    their top bits, so that no leaf is sorted as a whole. One row per leaf comes to the driver; more than ``max_leaves`` raise an error.
    """
    spark = documents.sparkSession
    levels = [f"l{k}" for k in range(len(below) + 1)]
    docs = documents.select(F.col(id_col).alias("id"), size.cast("long").alias("size"), source.alias("l0"), *(F.coalesce(c, F.lit("")).alias(n) for c, n in zip(below, levels[1:], strict=True)))
    wanted = targets.select("source", "weight_permille", "max_repeats").collect()
    docs = docs.where(F.col("size").isNotNull() & F.col("l0").isin([r.source for r in wanted]))
    sizes = docs.groupBy(*levels).agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_leaves + 1).collect()
    if len(sizes) > max_leaves:
        raise ValueError(f"the tree has more than {max_leaves} leaves")
    root = Node(())
    nodes = {(): root}
    above: dict[str, Node] = {}
    for r in wanted:
        nodes[(r.source,)] = Node((r.source,), Fraction(r.weight_permille), r.max_repeats)
        over = root
        if domain:
            over = above.get(name := domain(r.source))
            if over is None:
                over = above[name] = Node(("", name), Fraction(0))
                root.children.append(over)
            over.weight += Fraction(r.weight_permille)
        over.children.append(nodes[(r.source,)])
    by_source: dict[str, int] = defaultdict(int)
    for row in sorted(sizes, key=lambda r: tuple(r[n] for n in levels)):
        path = tuple(row[n] for n in levels)
        by_source[path[0]] += row["size"]
        for k in range(2, len(path) + 1):
            if path[:k] not in nodes:
                nodes[path[:k]] = Node(path[:k], None, nodes[path[:1]].repeats)
                nodes[path[: k - 1]].children.append(nodes[path[:k]])
        nodes[path].size = row["size"]
    total = sum(by_source.values())
    asked = total if budget is None else budget
    demand(root, Fraction(asked))
    spread(root, asked)
    of = lambda r: nodes[(r.source,)]
    report = spark.createDataFrame(
        [(r.source, domain(r.source) if domain else None, r.weight_permille, r.max_repeats, by_source[r.source], of(r).capacity(), float(of(r).asked), of(r).short, float(of(r).amount)) for r in wanted],
        "source string, domain string, weight_permille int, max_repeats int, size long, reachable long, asked double, short boolean, budget double",
    )
    plans = [(*x.name, int(x.amount // x.size), int(x.amount - x.amount // x.size * x.size)) for x in root.leaves() if x.size and len(x.name) == len(levels)]
    plan = spark.createDataFrame(plans, ", ".join(f"{n} string" for n in levels) + ", epochs int, rest long")
    rows = docs.join(broadcast_if_small(plan, max_leaves), levels)
    whole_epochs = rows.where("epochs > 0").select("id", *levels, F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("epoch"), "size")
    bits = bin_bits(max((r["n"] for r in sizes), default=0))
    keyed = rows.where("rest > 0").withColumn("key", random_key(F.concat_ws("/", "id", "epochs"), "epoch", seed)).withColumn("bin", F.shiftright("key", 60 - bits).cast("int"))
    bins = keyed.groupBy(*levels, "rest", "bin").agg(F.sum("size").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*levels).orderBy("bin"))
    last = bins.withColumn("below", up_to - F.col("n")).where("below < rest").withColumn("all", F.expr("below + n <= rest")).select(*levels, "bin", "below", "all")
    near = keyed.join(broadcast_if_small(last, 500_000), [*levels, "bin"])
    edge = near.where("not all").withColumn("upto", F.sum("size").over(Window.partitionBy(*levels, "bin").orderBy("key", "id"))).where("below + upto <= rest")
    cols = ["id", *levels, F.expr("epochs + 1").alias("epoch"), "size"]
    drawn = whole_epochs.unionAll(near.where("all").select(*cols)).unionAll(edge.select(*cols))
    return Mixture(drawn.select("id", F.array(*levels).alias("leaf"), "epoch", "size"), report, total)
