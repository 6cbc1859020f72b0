"""Evaluation passages inside a training corpus, by a prefix-filtered set join of word shingles.

An item passage is a window of ``run`` words, seen as the set of its shingles of ``width`` words. A document holds
it only if it holds all of these shingles, so any one of them is a sufficient prefix; the rarest in the
corpus is joined. One pass over the corpus counts the shingles of items and keeps the windows that can hold a passage: those of the length of one whose shingles all stand in some
item at their places. The join is on the prefix shingle and its place in the window, and the words of the window are compared one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import broadcast_if_small, discard, spread, written
from .keys import arrow_rows, bitmap_size, window_hashes, word_hashes, words
from .sketches import Bitmap, known


@dataclass(frozen=True)
class Passage:
    """``run``: words of a passage; ``width``: words of a shingle; ``seen_bits``: size of the bitmaps of the items' shingles and passages, which follows from
    their number unless given; ``small``: passages up to which they are broadcast; ``salts``: parts of a hot shingle where they are more."""

    run: int = 10
    width: int = 5
    seen_bits: int | None = None
    small: int = 200_000
    salts: int = 16

    @property
    def inner(self) -> int:
        return self.run - self.width + 1


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))


_WINDOWS = "item long, pos int, n_windows int, passage long, said string, grams array<long>"


def _windows(how: Passage) -> Callable:
    types = {"item": pa.int64(), "pos": pa.int32(), "n_windows": pa.int32(), "passage": pa.int64(), "said": pa.string(), "grams": pa.list_(pa.int64())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, text in arrow_rows(batches, "item", "text"):
            found = words(text)
            w = word_hashes(found)
            passages = window_hashes(w, how.run).view(np.int64)
            grams = window_hashes(w, how.width).view(np.int64)
            for lo in range(0, len(passages), 4096):
                yield _batch([(item, k, len(passages), int(passages[k]), " ".join(found[k : k + how.run]), grams[k : k + how.inner].tolist()) for k in range(lo, min(lo + 4096, len(passages)))], types)

    return run


_CANDIDATES = "gram long, n long, doc long, said string, grams array<long>"


def _scanned(how: Passage, shared, bits: int) -> Callable:
    """Counts of item shingles (gram, n), and the windows of documents that may hold a passage (doc, said, grams)."""
    types = {"gram": pa.int64(), "n": pa.int64(), "doc": pa.int64(), "said": pa.string(), "grams": pa.list_(pa.int64())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, whole = (Bitmap(bits, x) for x in shared.value)
        held: list[np.ndarray] = []
        rows: list[tuple] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            gram, count = np.unique(np.concatenate(held), return_counts=True)
            gram = gram.view(np.int64)
            for k in range(0, len(gram), 10_000):
                g, none = gram[k : k + 10_000], [None] * len(gram[k : k + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((g, count[k : k + 10_000], none, none, none), types.values(), strict=True)], list(types))

        for doc, text in arrow_rows(batches, "doc", "text"):
            found = words(text)
            w = word_hashes(found)
            grams = window_hashes(w, how.width)
            hit = seen.has(grams)
            if not hit.any():
                continue
            held.append(np.unique(grams[hit]))
            n += len(held[-1])
            if n > 300_000:
                yield from flush()
                held, n = [], 0
            # Places where all shingles of a window stand in items, and the window as a whole in one.
            runs = np.flatnonzero(np.convolve(hit, np.ones(how.inner, np.int64), "valid") == how.inner) if len(hit) >= how.inner else np.empty(0, np.int64)
            if len(runs):
                passages = window_hashes(w, how.run)
                for p in runs[whole.has(passages[runs])]:
                    rows.append((None, None, doc, " ".join(found[p : p + how.run]), grams[p : p + how.inner].view(np.int64).tolist()))
                if len(rows) > 4096:
                    yield _batch(rows, types)
                    rows = []
        if held:
            yield from flush()
        if rows:
            yield _batch(rows, types)

    return run


def leaked_passages(documents: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, how: Passage = Passage()) -> DataFrame:
    """Rows (doc, item, pos, n_windows): document ``doc`` holds the ``how.run`` words of the item from word ``pos`` on; the item has ``n_windows`` passages.

    Distinct rows. Null texts and texts under ``how.run`` words hold and give no passage. Ids must be integers; repeated items or documents count under
    each id. Other columns are ignored. The items may outgrow a broadcast: only two bitmaps are always sent to
    executors, and where the passages are many the join shuffles, with the windows of a hot shingle dealt out to ``how.salts`` parts.
    """
    spark = documents.sparkSession
    docs = spread(documents.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("text is not null"))
    given = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    windows = written(given.mapInArrow(_windows(how), _WINDOWS), "leak-windows")
    grams = windows.select(F.explode("grams").alias("gram")).distinct()
    bits = how.seen_bits or bitmap_size(2 * windows.count())
    maps = [known(hashes, bits).value for hashes in (grams, windows.select("passage").distinct())]
    scanned = written(docs.mapInArrow(_scanned(how, spark.sparkContext.broadcast(maps), bits), _CANDIDATES), "leak-scanned")
    counts = scanned.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    # A shingle that no document holds has no count, and its window can stand nowhere.
    each = windows.select("item", "pos", "n_windows", "said", F.posexplode("grams").alias("off", "gram")).join(counts, "gram", "left")
    rarest = each.groupBy("item", "pos", "n_windows", "said").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "off")).alias("r")).where("r.n > 0")
    prefix = written(rarest.select("item", "pos", "n_windows", "said", "r.gram", "r.off"), "leak-prefix")
    discard(windows)
    found = scanned.where("doc is not null").select("doc", "said", F.posexplode("grams").alias("off", "gram"))
    on = ["gram", "off", "said"]
    if (small := broadcast_if_small(prefix, how.small)) is prefix:
        found = found.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(how.salts)).cast("int"))
        small = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(how.salts - 1))))
        on.append("salt")
    return found.join(small, on).select("doc", "item", "pos", "n_windows").distinct()
