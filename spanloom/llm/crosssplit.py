"""Same or near-same records across splits, by a partitioned suffix array over the concatenated texts.

The words of all records are one long text with a mark after each record. A suffix is ranked as by prefix doubling: by the hash of its first words, then of
twice, four and eight times as many. The array is partitioned by the first rank and sorted by all of them, so that suffixes with a common prefix are neighbours
and the deepest rank that two of them share tells how long it is. Stretches in which evaluation and training suffixes are neighbours reveal shared spans. The
array is used twice:

* Pairs (``links``): the suffixes start at necessary starts, and the first rank is one shingle. With the shingles of a record ordered by rarity over the corpus,
  two records of at least the threshold share one of the first few, as many as the threshold makes necessary, so the starts of these shingles are
  enough and no pair is lost. The starts that the shared spans of two records cover are merged into a count, which must reach a floor derived from
  their sizes; a start counts only if its place in both orders leaves room for the asked overlap. Pairs that reach it are compared exactly.
* Coverage (``spans``): all suffixes of evaluation records, and the first ranks of all training suffixes. The spans of an evaluation record are merged into the words that some
  training text shares with it in a run of at least ``lead`` words. This is exact.

Records of equal shingle sets are one class in the first use, records of equal words in the second, so copies cost nothing. A stretch that is too long for one
task is dealt out to parts: each training suffix to one, each evaluation suffix to all (in the second use the other way round), so all pairs of the stretch meet once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import discard, drop_old_shuffles, spread, written
from .keys import Sketch, arrow_rows, bitmap_size, mix, signature, sketch_size, window_hashes
from .neardup import _BLOCKS, Similarity, _batch, _by_block, blocks_and_tasks, class_sets, dealt, field_set, hashed_words, overlap, salt, stored, whole_blocks
from .sketches import BLOB, Bitmap, SketchBuilder, blobs, collected

_SUFFIX = np.dtype([("r0", "<u8"), ("r1", "<u4"), ("r2", "<u4"), ("r3", "<u4"), ("sig", "<i8"), ("size", "<i4"), ("place", "<i4")])
_START = np.dtype([("r0", "<u8"), ("seq", "<i8"), ("pos", "<i4")])
_SIDE = 1 << 30  # set in the place of an evaluation suffix
_END = np.uint64(0x9E3779B97F4A7C15)  # the mark after a record
_RANKS = ("r0", "r1", "r2", "r3")


@dataclass(frozen=True)
class SuffixPlan:
    """``lead``: fewest words of a span of ``spans``. ``hot`` and ``hot_starts``: suffixes above the mean from which a stretch of the first and of the second use
    is dealt out to parts of about that many; nothing is dropped. ``entries``: suffixes in a block. ``counts_bits``, ``seen_bits``: sizes of the sketch that orders shingles by rarity and of the bitmaps of what
    evaluation records hold; they follow from the number of words unless given."""

    lead: int = 6
    hot: int = 20_000
    hot_starts: int = 400_000
    entries: int = 300_000
    counts_bits: int | None = None
    seen_bits: int | None = None


def _leads(field: str, w: np.ndarray, plan: SuffixPlan) -> np.ndarray:
    """First ranks of all suffixes of at least ``lead`` words."""
    return window_hashes(w, plan.lead) ^ salt(field)


def padded_hashes(w: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` words from each place of a record and the marks after it."""
    return window_hashes(np.concatenate([w, np.full(width * 8, _END, np.uint64)]), width)


def ranks(h: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Hashes of twice, four and eight times ``width`` words from each start, from those of ``width`` words. The mark stands past the end and is told apart by
    what is before it, so suffixes that end alike share the rank of what they hold."""
    odd = np.uint64(0xD6E8FEB86659FD93)
    parts = h[at[:, None] + np.arange(8) * width]
    found = []
    for _ in range(3):
        parts = parts[:, 0::2] * odd + parts[:, 1::2]
        found.append((parts[:, 0] * odd >> np.uint64(32)).astype(np.uint32))
    return found


class _Held:
    """Hashes gathered for a bitmap, half a million at a time."""

    def __init__(self, bits: int) -> None:
        self.map, self.held, self.n = Bitmap(bits), [], 0

    def add(self, h: np.ndarray) -> None:
        self.held.append(h)
        self.n += len(h)
        if self.n > 300_000:
            self.array()

    def array(self) -> np.ndarray:
        if self.held:
            self.map.add(np.unique(np.concatenate(self.held)))
            self.held, self.n = [], 0
        return self.map.array()


def _first(how: Similarity, plan: SuffixPlan, counts_bits: int, seen_bits: int, spans: bool) -> Callable:
    types = {"part": pa.string(), "chunk": pa.int32(), "blob": pa.binary(), "field": pa.string(), "id": pa.int64(), "side": pa.int32(), "sig": pa.int64(), "seq": pa.int64(), "n": pa.int32(), "words": pa.binary()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, leads = SketchBuilder(counts_bits), _Held(seen_bits), _Held(seen_bits if spans else 3)
        rows: list[tuple] = []
        n = 0
        for field, key, side, text in arrow_rows(batches, "field", "id", "side", "text"):
            if (w := hashed_words(text, how)) is None:
                continue
            found = field_set(field, w, how)
            counts.add(found)
            if side:
                seen.add(found)
                if spans:
                    leads.add(_leads(field, w, plan))
            rows.append((None, None, None, field, key, side, signature(found), signature(w ^ salt(field)), len(w), w.tobytes()))
            n += len(w)
            if n > 500_000 or len(rows) == 4096:
                yield _batch(dict(zip(types, zip(*rows, strict=True), strict=True)), types)
                rows, n = [], 0
        for name, array in (("counts", counts.array()), ("seen", seen.array()), ("leads", leads.array())):
            rows += [(*blob, *[None] * 7) for blob in blobs(name, array)]
        for k in range(0, len(rows), 64):
            yield _batch(dict(zip(types, zip(*rows[k : k + 64], strict=True), strict=True)), types)

    return run


def _packed(e: np.ndarray, key: np.ndarray, test: np.ndarray, name: np.ndarray, excess: np.ndarray, hot: int, blocks: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Group suffixes by block of ``key``. A stretch whose ``excess`` is over ``hot`` is dealt out to parts by ``name``: where ``test`` is ``every``, a suffix goes to all parts, else to one."""
    heavy = excess > hot
    yield from _by_block(e[~heavy], (key[~heavy] % np.uint64(blocks)).astype(np.int64), np.ones(int((~heavy).sum()), np.int64))
    h, k, copied, parts = e[heavy], key[heavy], test[heavy] == every, 1 + excess[heavy] // hot
    own = dealt(np.ascontiguousarray(name[heavy]), parts)
    for lo in range(0, len(h), 20_000):
        s = slice(lo, lo + 20_000)
        n = np.where(copied[s], parts[s], 1)
        at = np.repeat(np.arange(len(n)), n)
        part = np.where(copied[s][at], np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n), own[s][at])
        block = mix(k[s][at] + mix(part.astype(np.uint64) + np.uint64(1))) % np.uint64(blocks)
        yield from _by_block(h[s][at], block.astype(np.int64) + blocks, parts[s][at])


def _suffixes(how: Similarity, plan: SuffixPlan, shared, counts_bits: int, seen_bits: int, blocks: int) -> Callable:
    """The suffixes at necessary starts, packed by block; training records have only those that evaluation records may have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = Sketch(counts_bits, shared.value["counts"]), Bitmap(seen_bits, shared.value["seen"])
        done: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        n = 0

        def packed() -> Iterator[pa.RecordBatch]:
            e = np.concatenate(held)
            yield from _packed(e, e["r0"], e["place"] >= _SIDE, e["sig"], counts.excess(e["r0"]), plan.hot, blocks, True)

        for field, side, sig, w in stored(batches, "field", "side", "sig"):
            if (sig, side) in done:
                continue
            done.add((sig, side))
            if len(done) > 200_000:
                done.clear()
            h = padded_hashes(w, how.width)
            found, at = np.unique(h[: len(w) - how.width + 1] ^ salt(field), return_index=True)
            df = counts.estimate(found)
            first = np.argsort(df, kind="stable")[: how.prefix(len(found))]  # of equal counts the smaller hash
            useful = df[first] > 1  # a shingle counted once has no second record
            if not side:
                useful &= seen.has(found[first])
            if not useful.any():
                continue
            first = first[useful]
            e = np.empty(len(first), _SUFFIX)
            e["r0"], e["sig"], e["size"], e["place"] = found[first], sig, len(found), np.flatnonzero(useful) | (_SIDE if side else 0)
            e["r1"], e["r2"], e["r3"] = ranks(h, at[first], how.width)
            held.append(e)
            n += len(e)
            if n > 200_000:
                yield from packed()
                held, n = [], 0
        if held:
            yield from packed()

    return run


def suffix_ranks(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a block (order of its suffixes), and for each suffix in this order the number of its stretch at each depth.

    Neighbours with equal ranks down to a depth have a common prefix of that depth and are in one stretch of it."""
    order = np.lexsort([e[r] for r in reversed(_RANKS)])
    e = e[order]
    stretch = np.zeros((len(_RANKS), len(e)), np.int64)
    new = np.zeros(max(len(e) - 1, 0), bool)
    for depth, name in enumerate(_RANKS):
        new |= e[name][1:] != e[name][:-1]
        stretch[depth, 1:] = np.cumsum(new)
    return order, stretch


def crossing(e: np.ndarray, how: Similarity, chunk: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of an evaluation and a training suffix of one stretch that pass the size and place bounds.

    Yields (evaluation class, training class, floor, words of the common prefix as far as the ranks tell them) of at most about ``chunk`` pairs."""
    order, stretch = suffix_ranks(e)
    e = e[order]
    side = e["place"] >= _SIDE
    # Within a stretch of the first rank by size, so that sizes bound where a partner may stand; each class once on each side.
    by = np.lexsort((e["sig"], e["size"], side, stretch[0]))
    e, side, stretch = e[by], side[by], stretch[:, by]
    new = np.ones(len(e), bool)
    new[1:] = (stretch[0, 1:] != stretch[0, :-1]) | (e["sig"][1:] != e["sig"][:-1]) | (side[1:] != side[:-1])
    test, train = new & side, new & ~side
    if not test.any() or not train.any():
        return
    x, y, depth_x, depth_y = e[test], e[train], stretch[:, test], stretch[:, train]
    known = depth_y[0] << 32 | y["size"]
    size = x["size"].astype(np.int64)
    lo = np.searchsorted(known, depth_x[0] << 32 | -(-how.permille * size // 1000), "left")
    n = np.searchsorted(known, depth_x[0] << 32 | np.minimum(1000 * size // how.permille, (1 << 31) - 1), "right") - lo
    ends = np.cumsum(n)
    k = 0
    while k < len(x):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + chunk, "right")))
        m = n[k:stop]
        p = np.repeat(np.arange(k, stop), m)
        q = np.repeat(lo[k:stop] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
        k = stop
        a, b = x["size"][p].astype(np.int64), y["size"][q].astype(np.int64)
        asked = how.asked(a, b)
        floor = how.floor(asked)
        ok = ((x["place"][p] & (_SIDE - 1)) < a - asked + floor) & (y["place"][q] < b - asked + floor) & (x["sig"][p] != y["sig"][q])
        if ok.any():
            p, q = p[ok], q[ok]
            deep = sum((depth_x[d, p] == depth_y[d, q]).astype(np.int32) for d in range(1, len(_RANKS)))
            yield x["sig"][p], y["sig"][q], floor[ok], how.width << deep


def _covered(how: Similarity) -> Callable:
    """For each pair of classes the starts that its shared spans cover in a block, counted, and the longest span."""
    types = {"test": pa.int64(), "train": pa.int64(), "floor": pa.int32(), "n": pa.int32(), "longest": pa.int32()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in whole_blocks(batches, _SUFFIX):
            for a, b, floor, length in crossing(np.concatenate(held), how):
                order = np.lexsort((b, a))
                a, b, floor, length = a[order], b[order], floor[order], length[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                at = np.flatnonzero(new)
                n, longest = np.diff(np.append(at, len(a))), np.maximum.reduceat(length, at)
                for k in range(0, len(at), 50_000):
                    s, r = at[k : k + 50_000], slice(k, k + 50_000)
                    yield _batch({"test": a[s], "train": b[s], "floor": floor[s].astype(np.int32), "n": n[r].astype(np.int32), "longest": longest[r].astype(np.int32)}, types)

    return run


def _compared(how: Similarity) -> Callable:
    types = {"test": pa.int64(), "train": pa.int64(), "both": pa.int32(), "either": pa.int32(), "longest": pa.int32()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple] = []
            for a, b, longest, x, y in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = overlap(p, q)
                either = len(p) + len(q) - n
                if 1000 * n >= how.permille * either:
                    got.append((a, b, n, either, longest))
            if got:
                yield _batch(dict(zip(types, zip(*got, strict=True), strict=True)), types)

    return run


def _all_starts(how: Similarity, plan: SuffixPlan, shared, counts_bits: int, seen_bits: int, blocks: int) -> Callable:
    """All suffixes of at least ``lead`` words of evaluation records, and the first ranks of training suffixes (with ``pos`` -1) that evaluation records may have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, leads = Sketch(counts_bits, shared.value["counts"]), Bitmap(seen_bits, shared.value["leads"])
        done: set[int] = set()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}
        n = [0, 0]

        def packed(side: int) -> Iterator[pa.RecordBatch]:
            e, near = (np.concatenate(x) for x in zip(*held[side], strict=True))
            held[side], n[side] = [], 0
            if not side:
                _, once = np.unique(e["r0"], return_index=True)
                e, near = e[once], near[once]
            yield from _packed(e, e["r0"], e["pos"] >= 0, e["seq"], counts.excess(near), plan.hot_starts, blocks, False)

        for field, side, seq, w in stored(batches, "field", "side", "seq"):
            if (seq, side) in done or len(w) < plan.lead:
                continue
            done.add((seq, side))
            if len(done) > 200_000:
                done.clear()
            r0 = _leads(field, w, plan)
            # The shingle at a suffix's start tells how common it may be at most; suffixes of equal first rank have the same.
            near = (window_hashes(w, how.width) ^ salt(field))[: len(r0)]
            pos = np.arange(len(r0))
            if not side:
                pos = np.flatnonzero(leads.has(r0))
            e = np.empty(len(pos), _START)
            e["r0"], e["seq"], e["pos"] = r0[pos], seq if side else 0, pos if side else -1
            held[side].append((e, near[pos]))
            n[side] += len(e)
            if n[side] > 200_000:
                yield from packed(side)
        for side in (0, 1):
            if held[side]:
                yield from packed(side)

    return run


def trained_starts(e: np.ndarray) -> np.ndarray:
    """The evaluation suffixes of one block whose first rank some training suffix has, in order of class and place."""
    e = e[np.lexsort((e["pos"], e["seq"], e["r0"]))]
    new = np.ones(len(e), bool)
    new[1:] = e["r0"][1:] != e["r0"][:-1]
    # Training suffixes stand first in their stretch, as their place is -1 and their class 0; classes may be negative, so look at all of the stretch.
    stretch = np.cumsum(new) - 1
    trained = np.zeros(int(new.sum()), bool)
    trained[stretch[e["pos"] < 0]] = True
    e = e[trained[stretch] & (e["pos"] >= 0)]
    return e[np.lexsort((e["pos"], e["seq"]))]


def _matched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"seq": pa.int64(), "starts": pa.binary()}
    for _, held in whole_blocks(batches, _START):
        e = trained_starts(np.concatenate(held))
        cuts = np.flatnonzero(np.diff(e["seq"], prepend=e["seq"][0] ^ 1)) if len(e) else np.empty(0, np.int64)
        ends, pos = np.append(cuts[1:], len(e)), np.ascontiguousarray(e["pos"])
        for k in range(0, len(cuts), 10_000):
            yield _batch({"seq": e["seq"][cuts[k : k + 10_000]], "starts": [pos[a:b].tobytes() for a, b in zip(cuts[k : k + 10_000], ends[k : k + 10_000], strict=True)]}, types)


def merged_spans(starts: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, words) of the spans that suffixes of ``lead`` shared words at these starts make up, overlapping and touching ones merged."""
    starts = np.unique(starts)
    cuts = np.flatnonzero(np.diff(starts, prepend=starts[0] - lead - 1) > lead)
    lasts = starts[np.append(cuts[1:], len(starts)) - 1]
    return starts[cuts], lasts + lead - starts[cuts]


def _merged(lead: int) -> Callable:
    types = {"seq": pa.int64(), "spans": pa.list_(pa.struct([("pos", pa.int32()), ("length", pa.int32())])), "covered": pa.int32()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for seq, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pos, length = merged_spans(np.frombuffer(b"".join(parts), np.int32), lead)
                rows.append((seq, [{"pos": a, "length": n} for a, n in zip(pos.tolist(), length.tolist(), strict=True)], int(length.sum())))
            if rows:
                yield _batch(dict(zip(types, zip(*rows, strict=True), strict=True)), types)

    return run


@dataclass(frozen=True)
class CrossSplit:
    """``members``: field, id, side (1 evaluation, 0 training), sig (class of equal shingle sets), seq (class of equal words), words. ``links``: classes test and
    train with similarity of at least the threshold, both and either (sizes of intersection and union) and longest, the words of their longest shared span at a necessary start, as
    far as the ranks tell it. ``spans``: seq of an evaluation text with its merged spans (pos, length) in words and the words covered by them; None unless asked for."""

    members: DataFrame
    links: DataFrame
    spans: DataFrame | None


def cross_split_overlaps(records: DataFrame, id_col: str, side: Column, text_cols: list[str], how: Similarity = Similarity(), plan: SuffixPlan = SuffixPlan(), spans: bool = False) -> CrossSplit:
    """Near-same pairs between evaluation records (``side`` 1) and training records (0) and, with ``spans``, what evaluation texts share with any training text.

    Rows with a null ``side``, null texts and texts under ``how.min_words`` words take no part. ``id_col`` must be a unique
    integer. Texts are processed whole. Other columns are ignored. No pair of at least the threshold is lost, and results don't depend on partitions.
    """
    if plan.lead < how.width:
        raise ValueError("a lead has at least a shingle's words")
    spark = records.sparkSession
    docs = spread(records.select(F.col(id_col).cast("long").alias("id"), side.cast("int").alias("side"), *(F.col(c).alias(f"_t{k}") for k, c in enumerate(text_cols)))).select("id", "side", F.explode(F.create_map(*[x for k, c in enumerate(text_cols) for x in (F.lit(c), F.col(f"_t{k}"))])).alias("field", "text"))
    docs = docs.where(F.col("side").isNotNull() & F.col("text").isNotNull()).select("field", "id", "side", "text")
    chars = {r.side: int(r.n or 0) // 6 for r in docs.groupBy("side").agg(F.sum(F.length("text")).alias("n")).collect()}
    counts_bits = plan.counts_bits or sketch_size(sum(chars.values()))
    seen_bits = plan.seen_bits or bitmap_size(chars.get(1, 0))
    first = written(docs.mapInArrow(_first(how, plan, counts_bits, seen_bits, spans), f"{BLOB}, field string, id long, side int, sig long, seq long, n int, words binary"), "split-keys")
    rows = first.where(F.col("part").isNull())
    members = rows.select("field", "id", "side", "sig", "seq", F.col("n").alias("words"))
    bitmap = np.zeros(1 << (seen_bits - 3), np.uint8)
    merged = collected(first, {"counts": np.zeros(1 << counts_bits, np.int32), "seen": bitmap, "leads": bitmap.copy()})
    total = int(merged["counts"][: 1 << (counts_bits - 1)].astype(np.int64).sum())
    shared = spark.sparkContext.broadcast(merged)
    covered = None
    if spans:
        blocks, tasks = blocks_and_tasks(spark, 2 * chars.get(1, 0), 4 * plan.entries)
        starts = rows.select("field", "side", "seq", "words").mapInArrow(_all_starts(how, plan, shared, counts_bits, seen_bits, blocks), _BLOCKS).repartition(tasks, "block").sortWithinPartitions("block")
        matched = starts.mapInArrow(_matched, "seq long, starts binary").groupBy("seq").agg(F.collect_list("starts").alias("starts"))
        covered = written(matched.mapInArrow(_merged(plan.lead), "seq long, spans array<struct<pos:int,length:int>>, covered int"), "split-spans")
        del starts, matched
        drop_old_shuffles(spark)
    blocks, tasks = blocks_and_tasks(spark, total * (1000 - how.permille) // 1000, plan.entries)
    suffixes = rows.select("field", "side", "sig", "words").mapInArrow(_suffixes(how, plan, shared, counts_bits, seen_bits, blocks), _BLOCKS).repartition(tasks, "block").sortWithinPartitions("block")
    terms = suffixes.mapInArrow(_covered(how), "test long, train long, floor int, n int, longest int")
    pairs = terms.groupBy("test", "train").agg(F.sum("n").alias("n"), F.first("floor").alias("floor"), F.max("longest").alias("longest")).where("n >= floor")
    pairs = written(pairs.select("test", "train", "longest"), "split-pairs")
    sets = class_sets(rows, pairs.select(F.explode(F.array("test", "train")).alias("sig")), how, "split")
    both = pairs.join(sets.select(F.col("sig").alias("test"), F.col("grams").alias("x")), "test").join(sets.select(F.col("sig").alias("train"), F.col("grams").alias("y")), "train")
    links = written(both.select("test", "train", "longest", "x", "y").mapInArrow(_compared(how), "test long, train long, both int, either int, longest int"), "split-links")
    members = written(members, "split-members")
    discard(pairs, sets, first)
    return CrossSplit(members, links, covered)


def cross_pairs(found: CrossSplit) -> DataFrame:
    """Pairs of an evaluation and a training record with similarity of at least the threshold in some field: (test_id, train_id), distinct.

    This is the expanded form: classes of copies are expanded into pairs of records."""
    test = found.members.where("side = 1").select(F.col("id").alias("test_id"), F.col("sig").alias("test"))
    train = found.members.where("side = 0").select(F.col("id").alias("train_id"), F.col("sig").alias("train"))
    across = test.join(found.links.select("test", "train"), "test").join(train, "train").select("test_id", "train_id")
    same = test.join(train, test["test"] == train["train"]).select("test_id", "train_id")
    return across.unionAll(same).distinct()
