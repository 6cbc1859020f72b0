"""Near-duplicate records with small edits, by a blocked sparse matrix product.

The incidence matrix of records and shingles is multiplied with its transpose, block of columns by block of
columns. Three size-derived bounds keep the product sparse without losing a pair:

* columns are ordered by rarity over the whole corpus (a fixed-size count sketch gives the order), and a record
  only enters the product with its rarest columns, as many as the threshold makes necessary;
* a product term counts only if its place in both records leaves room for the overlap that their sizes ask for;
* the accumulated terms of a pair must reach a floor that grows with the asked overlap.

Pairs that survive are checked against the full shingle sets. Records with the same shingle set form one class and
enter the product once, so a group of copies costs no more than one record, however large it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, spread, written
from .keys import Sketch, arrow_rows, bitmap_size, deal, signature, sketch_size, window_hashes, word_hashes, words
from .sketches import BLOB, SketchBuilder, blobs, collected_sketch, corpus_words, prefiltered


@dataclass(frozen=True)
class Similarity:
    """Shingle width in words, threshold in thousandths, and the fewest words a text needs to be similar to anything."""

    width: int = 5
    permille: int = 800
    min_words: int = 5

    def asked(self, a, b):
        """Overlap two sets of sizes a and b need."""
        return -(-self.permille * (a + b) // (1000 + self.permille))

    def floor(self, asked):
        """Terms a pair must accumulate. Each one lets records enter with one more column; one in twenty pays."""
        return 1 + asked // 20

    def prefix(self, n: int) -> int:
        """Columns of a record of n shingles that must enter: the smallest partner asks for the least overlap."""
        least = -(-self.permille * n // 1000)
        return min(n, n - least + int(self.floor(least)))


_ENTRY = np.dtype([("gram", "<u8"), ("sig", "<i8"), ("grp", "<i8"), ("size", "<i4"), ("pos", "<i4")])
_KEYED = f"{BLOB}, field string, id long, grp string, sig long, size int, words binary"


def _batch(columns: dict[str, list | np.ndarray], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in types.items()], list(types))


def hashed_words(text: str | None, how: Similarity) -> np.ndarray | None:
    """Hashes of the words of a text, or None if it has no similarity to anything."""
    if text is None:
        return None
    found = words(text)
    return word_hashes(found) if len(found) >= max(how.min_words, how.width) else None


def field_set(field: str, w: np.ndarray, how: Similarity) -> np.ndarray:
    """The sorted shingle set of a text, told apart by field, so that one product serves several fields."""
    return np.unique(window_hashes(w, how.width) ^ salt(field))


def salt(field: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(field))


def _keyed(how: Similarity, bits: int) -> Callable:
    types = {"part": pa.string(), "chunk": pa.int32(), "blob": pa.binary(), "field": pa.string(), "id": pa.int64(), "grp": pa.string(), "sig": pa.int64(), "size": pa.int32(), "words": pa.binary()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SketchBuilder(bits)
        rows: list[tuple] = []
        held = 0
        for field, key, grp, text in arrow_rows(batches, "field", "id", "grp", "text"):
            if (w := hashed_words(text, how)) is not None:
                found = field_set(field, w, how)
                sketch.add(found)
                rows.append((None, None, None, field, key, grp, signature(found), len(found), w.tobytes()))
                held += len(w)
                if held > 500_000 or len(rows) == 4096:
                    yield _batch(dict(zip(types, zip(*rows, strict=True), strict=True)), types)
                    rows, held = [], 0
        rows += [(*blob, *[None] * 6) for blob in blobs("counts", sketch.array())]
        for k in range(0, len(rows), 4096):
            yield _batch(dict(zip(types, zip(*rows[k : k + 4096], strict=True), strict=True)), types)

    return run


def stored(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows (*names, hashes of the words) of batches of a written table of records."""
    for batch in batches:
        at = [batch.schema.get_field_index(n) for n in names]
        for *row, blob in zip(*(batch.column(k).to_pylist() for k in at), batch.column(batch.schema.get_field_index("words")), strict=True):
            yield *row, np.frombuffer(blob.as_buffer(), np.uint64)


_BLOCKS = "block long, parts int, blob binary"
_BLOCK_TYPES = {"block": pa.int64(), "parts": pa.int32(), "blob": pa.binary()}


def _entries(how: Similarity, sketch, blocks: int, hot: int) -> Callable:
    """Matrix entries of the necessary columns, packed by block of columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Sketch(*sketch.value)
        kept: dict[int, set[int]] = {}
        held: list[np.ndarray] = []
        n = 0
        for field, sig, grp, w in stored(batches, "field", "sig", "grp"):
            group = int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grp))))
            # Two groups of a class are enough: any third one differs from one of them.
            seen = kept.setdefault(sig, set())
            if group in seen or len(seen) == 2:
                continue
            seen.add(group)
            if len(kept) > 200_000:
                kept.clear()
            found = field_set(field, w, how)
            df = counts.estimate(found)
            first = np.argsort(df, kind="stable")[: how.prefix(len(found))]  # of equal counts the smaller hash
            once = df[first] > 1  # a column counted once has no second record
            e = np.empty(int(once.sum()), _ENTRY)
            e["gram"], e["sig"], e["grp"], e["size"], e["pos"] = found[first][once], sig, group, len(found), np.flatnonzero(once)
            held.append(e)
            n += len(e)
            if n > 200_000:
                yield from packed_entries(np.concatenate(held), counts, blocks, hot)
                held, n = [], 0
        if held:
            yield from packed_entries(np.concatenate(held), counts, blocks, hot)

    return run


def dealt(sig: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """The part of a hot column to which a record's entry is dealt."""
    return ((sig.view(np.uint64) >> np.uint64(7)) % np.asarray(parts, np.uint64)).astype(np.int64)


def packed_entries(e: np.ndarray, counts: Sketch, blocks: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Group entries by block. The entries of a column that exceeds the mean by more than ``hot`` are dealt out to as many parts as hold ``hot`` of them each, and
    each pair of parts is a block of its own."""
    excess = counts.excess(e["gram"])
    heavy = excess > hot
    h, parts = e[heavy], 1 + excess[heavy] // hot
    yield from _by_block(e[~heavy], (e["gram"][~heavy] % np.uint64(blocks)).astype(np.int64), np.ones(int((~heavy).sum()), np.int64))
    for k in range(0, len(h), 1000):  # an entry is copied as often as its column has parts
        own = parts[k : k + 1000]
        at, block = deal(h["gram"][k : k + 1000], dealt(np.ascontiguousarray(h["sig"][k : k + 1000]), own), own)
        yield from _by_block(h[k : k + 1000][at], block + blocks, own[at])


def _by_block(e: np.ndarray, block: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(block, kind="stable")
    e, block, parts = e[order], block[order], parts[order]
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(cuts[1:], len(e))
    for k in range(0, len(cuts), 256):
        at = cuts[k : k + 256]
        yield _batch({"block": block[at], "parts": parts[at].astype(np.int32), "blob": [e[a:b].tobytes() for a, b in zip(at, ends[k : k + 256], strict=True)]}, _BLOCK_TYPES)


def block_product(e: np.ndarray, how: Similarity, parts: int = 1, chunk: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Terms of one block: for each column, pairs of records that pass the size, place and group bounds.

    Yields (smaller signature, larger signature, floor) arrays of at most about ``chunk`` terms. Within a column, records lie
    in order of size, so step k compares every record with its k-th next one; records that have got too large a partner
    drop out of all further steps. In a block of two of a hot column's ``parts``, only records of different parts are compared: each part has a
    block of its own for the rest.
    """
    e = np.unique(e[["gram", "size", "sig", "grp", "pos"]])
    new = np.ones(len(e), bool)
    new[1:] = (e["gram"][1:] != e["gram"][:-1]) | (e["sig"][1:] != e["sig"][:-1])
    starts = np.flatnonzero(new)
    same = np.arange(len(e)) - starts[np.cumsum(new) - 1]
    e = e[same < 2]
    gram, sig, grp = np.ascontiguousarray(e["gram"]), np.ascontiguousarray(e["sig"]), np.ascontiguousarray(e["grp"])
    size, pos = e["size"].astype(np.int64), e["pos"].astype(np.int64)
    part = dealt(sig, parts)
    across = parts > 1 and len(part) > 0 and bool((part != part[0]).any())
    live = np.arange(len(e))
    k = 1
    out: list[tuple] = []
    n = 0
    while len(live):
        live = live[live + k < len(e)]
        other = live + k
        near = (gram[live] == gram[other]) & (1000 * size[live] >= how.permille * size[other])
        live, other = live[near], other[near]
        asked = how.asked(size[live], size[other])
        room = how.floor(asked) - 1
        ok = (pos[live] <= size[live] - asked + room) & (pos[other] <= size[other] - asked + room)
        ok &= (sig[live] != sig[other]) & (grp[live] != grp[other])
        if across:
            ok &= part[live] != part[other]
        if ok.any():
            a, b = sig[live[ok]], sig[other[ok]]
            out.append((np.minimum(a, b), np.maximum(a, b), room[ok] + 1))
            n += len(a)
            if n >= chunk:
                yield tuple(map(np.concatenate, zip(*out, strict=True)))
                out, n = [], 0
        k += 1
    if out:
        yield tuple(map(np.concatenate, zip(*out, strict=True)))


def _product(how: Similarity, product: Callable = block_product, entry: np.dtype = _ENTRY) -> Callable:
    types = {"a": pa.int64(), "b": pa.int64(), "floor": pa.int32(), "n": pa.int32()}

    def terms(parts: int, blobs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a, b, floor in product(np.concatenate(blobs), how, parts):
            order = np.lexsort((b, a))
            a, b, floor = a[order], b[order], floor[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(a)))
            for k in range(0, len(at), 50_000):
                s = at[k : k + 50_000]
                yield _batch({"a": a[s], "b": b[s], "floor": floor[s].astype(np.int32), "n": n[k : k + 50_000].astype(np.int32)}, types)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, blobs in whole_blocks(batches, entry):
            yield from terms(parts, blobs)

    return run


def whole_blocks(batches: Iterable[pa.RecordBatch], entry: np.dtype) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(parts, entries) of each block of batches that are sorted by block."""
    now, n, held = None, 1, []
    for batch in batches:
        for block, parts, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if block != now and held:
                yield n, held
                held = []
            now, n = block, parts
            held.append(np.frombuffer(blob.as_buffer(), entry).copy())
    if held:
        yield n, held


def _sets(how: Similarity) -> Callable:
    types = {"sig": pa.int64(), "grams": pa.binary()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for sig, field, w in stored(batches, "sig", "field"):
            rows.append((sig, field_set(field, w, how).tobytes()))
            if len(rows) == 1024:
                yield _batch(dict(zip(types, zip(*rows, strict=True), strict=True)), types)
                rows = []
        if rows:
            yield _batch(dict(zip(types, zip(*rows, strict=True), strict=True)), types)

    return run


def class_sets(rows: DataFrame, wanted: DataFrame, how: Similarity, name: str) -> DataFrame:
    """The written shingle sets (sig, grams) of the classes of ``wanted``, each from one of its records; ``rows`` are records with field, id, sig and words."""
    classes = written(wanted.distinct(), f"{name}-wanted")
    near = prefiltered(rows.select("sig", "id", "field"), ["sig"], classes, bitmap_size(classes.count()))
    chosen = written(near.groupBy("sig").agg(F.min(F.struct("id", "field")).alias("m")).join(classes, "sig", "left_semi").select("sig", "m.id", "m.field"), f"{name}-chosen")
    kept = prefiltered(rows.select("id", "field", "words"), ["id", "field"], chosen, bitmap_size(chosen.count())).join(chosen, ["id", "field"])
    sets = written(kept.select("sig", "field", "words").mapInArrow(_sets(how), "sig long, grams binary"), f"{name}-sets")
    discard(classes, chosen)
    return sets


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _verified(how: Similarity) -> Callable:
    types = {"a": pa.int64(), "b": pa.int64(), "both": pa.int32(), "either": pa.int32()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple] = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = overlap(p, q)
                either = len(p) + len(q) - n
                if 1000 * n >= how.permille * either:
                    got.append((a, b, n, either))
            if got:
                yield _batch(dict(zip(types, zip(*got, strict=True), strict=True)), types)

    return run


def blocks_and_tasks(spark: SparkSession, entered: int, per_block: int) -> tuple[int, int]:
    """How many blocks hold so many entries, and how many tasks multiply them: at most eight blocks' worth each."""
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entered // per_block + 1)
    return blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), entered // (8 * per_block) + 1)


@dataclass(frozen=True)
class NearDuplicates:
    """``members``: field, id, grp, sig (its class), size. ``links``: pairs of classes a < b with both and either, the sizes of
    intersection and union. Texts of one class have equal shingle sets; ``links`` holds no pair of a class with itself."""

    members: DataFrame
    links: DataFrame


def near_duplicates(
    records: DataFrame,
    id_col: str,
    text_cols: list[str],
    group_col: str | None = None,
    how: Similarity = Similarity(),
    *,
    sketch_bits: int | None = None,
    entries_per_block: int = 300_000,
    hot_column: int = 50_000,
) -> NearDuplicates:
    """Classes of records and all links between classes with similarity of at least the threshold.

    ``id_col`` must be a unique integer. With ``group_col``, records of one group aren't compared with each other and records
    with a null group take no part; without it, each record is a group of its own. Null texts and texts under ``how.min_words`` words take no part. Empty tables give
    empty results. Very long texts are processed whole. Other columns are ignored, whatever their names.

    ``hot_column`` is the count above the mean of the sketch's counters from which a column's entries are dealt out to parts of about that many, whose pairs
    are blocks of their own; nothing is dropped. ``sketch_bits`` follows from the number of words unless given.
    """
    spark = records.sparkSession
    grp = F.lit("") if group_col is None else F.col(group_col).cast("string")
    docs = spread(records.select(F.col(id_col).cast("long").alias("id"), grp.alias("grp"), *(F.col(c).alias(f"_t{k}") for k, c in enumerate(text_cols)))).select("id", "grp", F.explode(F.create_map(*[x for k, c in enumerate(text_cols) for x in (F.lit(c), F.col(f"_t{k}"))])).alias("field", "text"))
    docs = docs.where(F.col("grp").isNotNull() & F.col("text").isNotNull()).select("field", "id", "grp", "text")
    if group_col is None:
        group_of = docs.withColumn("grp", F.col("id").cast("string"))
    else:
        group_of = docs
    if sketch_bits is None:
        sketch_bits = sketch_size(corpus_words(docs) // 2)
    keyed = written(group_of.mapInArrow(_keyed(how, sketch_bits), _KEYED), "neardup-keys")
    rows = keyed.where(F.col("part").isNull())
    members = rows.select("field", "id", "grp", "sig", "size")
    sketch = collected_sketch(keyed, sketch_bits)
    total = int(sketch.counts[: 1 << (sketch_bits - 1)].astype(np.int64).sum())
    shared = spark.sparkContext.broadcast((sketch_bits, sketch.counts))
    blocks, tasks = blocks_and_tasks(spark, total * (1000 - how.permille) // 1000, entries_per_block)
    entries = rows.select("field", "sig", "grp", "words").mapInArrow(_entries(how, shared, blocks, hot_column), _BLOCKS)
    terms = entries.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_product(how), "a long, b long, floor int, n int")
    pairs = written(terms.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("floor").alias("floor")).where("n >= floor").select("a", "b"), "neardup-pairs")
    sets = class_sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("sig")), how, "neardup")
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("grams").alias("y")), "b")
    links = written(both.select("a", "b", "x", "y").mapInArrow(_verified(how), "a long, b long, both int, either int"), "neardup-links")
    members = written(members, "neardup-members")
    discard(pairs, sets, keyed)
    return NearDuplicates(members, links)


def row_pairs(found: NearDuplicates) -> DataFrame:
    """All pairs of records a < b of different groups that are similar: links between classes and copies within one.

    This is the expanded form: a group of n copies gives n * n / 2 rows, as many as the result has. ``groups_of`` tells the same in one row per record.
    """
    m = found.members.select("field", "id", "grp", "sig")
    left = m.select(F.col("field"), F.col("id").alias("id_l"), F.col("grp").alias("grp_l"), F.col("sig").alias("a"))
    right = m.select(F.col("id").alias("id_r"), F.col("grp").alias("grp_r"), F.col("sig").alias("b"))
    several = m.groupBy("sig").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("sig")
    copies = m.join(several, "sig", "left_semi")
    within = copies.select("sig", "field", F.col("id").alias("id_l"), F.col("grp").alias("grp_l")).join(copies.select("sig", F.col("id").alias("id_r"), F.col("grp").alias("grp_r")), "sig").where("id_l < id_r")
    across = left.join(found.links.select("a", "b"), "a").join(right, "b")
    cols = ["field", "id_l", "grp_l", "id_r", "grp_r"]
    return (
        across.select(*cols).unionAll(within.select(*cols)).where("grp_l <> grp_r").select("field", F.least("id_l", "id_r").alias("row_id_a"), F.greatest("id_l", "id_r").alias("row_id_b"))
    )


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of the pairs (a, b) as (sig, label), label being the smallest member.

    Alternates two star contractions over written tables until nothing changes; the number of rounds grows with the
    logarithm of the longest chain. A node's neighbours are never gathered into one row.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-start")
    before = None
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        large = written(large, "cc-large")
        discard(edges)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.select(F.col("m").alias("x"), F.col("a").alias("y")).unionAll(joined.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = written(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "cc-small")
        discard(large)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("b").alias("sig")).agg(F.min("a").alias("label"))
        before = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def groups_of(found: NearDuplicates) -> DataFrame:
    """One row per record: field, id, class_id (of equal shingle sets), group_id (of linked classes) and n_links (links of its class to other classes)."""
    degree = found.links.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("n_links"))
    labels = components(found.links)
    return (
        found.members.join(degree, "sig", "left")
        .join(labels, "sig", "left")
        .select("field", "id", F.col("sig").alias("class_id"), F.coalesce("label", "sig").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
