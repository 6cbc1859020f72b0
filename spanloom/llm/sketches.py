"""Count sketches and bitmaps over a whole corpus: built in every task, merged by a shuffle, of fixed size on the driver."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import Sketch, sketch_slots

CHUNK = 1 << 18  # bytes of a stretch
_FLUSH = 1 << 20
#: Columns of the stretches, null in ordinary rows of the same table.
BLOB = "part string, chunk int, blob binary"


class SketchBuilder:
    """Gathers hashes of one task and counts them a million at a time."""

    def __init__(self, bits: int) -> None:
        self.bits, self.counts, self.held, self.n = bits, np.zeros(1 << bits, np.int32), [], 0

    def add(self, h: np.ndarray) -> None:
        self.held.append(h)
        self.n += len(h)
        if self.n >= _FLUSH:
            self.flush()

    def flush(self) -> None:
        if self.held:
            h = np.concatenate(self.held)
            for slots in sketch_slots(h, self.bits):
                at, n = np.unique(slots, return_counts=True)
                self.counts[at] += n.astype(np.int32)
            self.held, self.n = [], 0

    def array(self) -> np.ndarray:
        self.flush()
        return self.counts


class Bitmap:
    """Presence of hashes, two bits each; it may take an absent hash for present, never the other way round."""

    def __init__(self, bits: int, cells: np.ndarray | None = None) -> None:
        self.bits = bits
        self.cells = np.zeros(1 << (bits - 3), np.uint8) if cells is None else cells

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64((1 << self.bits) - 1)
        return h & low, (h >> np.uint64(64 - self.bits)) & low

    def add(self, h: np.ndarray) -> None:
        for at in self._places(h):
            np.bitwise_or.at(self.cells, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self._places(h):
            found &= (self.cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return found

    def array(self) -> np.ndarray:
        return self.cells


def blobs(part: str, array: np.ndarray) -> Iterator[tuple[str, int, bytes]]:
    """Non-zero stretches of an array as (part, number, compressed bytes); those of one task are mostly zeros."""
    flat = array.view(np.uint8)
    for k in range(0, len(flat), CHUNK):
        if (stretch := flat[k : k + CHUNK]).any():
            yield part, k // CHUNK, zlib.compress(stretch.tobytes(), 1)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for part, chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = np.frombuffer(zlib.decompress(blob.as_buffer()), np.int32 if part == "counts" else np.uint8)
            if (part, chunk) not in merged:
                merged[part, chunk] = raw.astype(np.int64) if part == "counts" else raw.copy()
            elif part == "counts":
                merged[part, chunk] += raw
            else:
                merged[part, chunk] |= raw
    for (part, chunk), total in merged.items():
        raw = np.minimum(total, 2**31 - 1).astype(np.int32) if part == "counts" else total
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([chunk], pa.int32()), pa.array([zlib.compress(raw.tobytes(), 1)], pa.binary())], ["part", "chunk", "blob"]
        )


def collected(table: DataFrame, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Merge the stretches that all tasks wrote and fill the given arrays with them: part "counts" is summed, any other
    part or-ed. The driver gets as many bytes as the arrays have, whatever the size of the corpus."""
    rows = table.where(F.col("part").isNotNull()).select("part", "chunk", "blob")
    flat = {name: array.view(np.uint8) for name, array in arrays.items()}
    merged = rows.repartition(32, "part", "chunk").mapInArrow(_merge, BLOB)
    for row in merged.collect():
        stretch = np.frombuffer(zlib.decompress(row.blob), np.uint8)
        flat[row.part][row.chunk * CHUNK : row.chunk * CHUNK + len(stretch)] = stretch
    return arrays


def corpus_words(docs: DataFrame) -> int:
    """About how many words the texts of ``docs`` have; counted in the JVM, for the size of a sketch."""
    return int(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 6


def collected_sketch(table: DataFrame, bits: int) -> Sketch:
    return Sketch(bits, collected(table, {"counts": np.zeros(1 << bits, np.int32)})["counts"])


def _marks(bits: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Bitmap(bits)
        for batch in batches:
            seen.add(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        for part, chunk, blob in blobs("seen", seen.array()):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([chunk], pa.int32()), pa.array([blob], pa.binary())], ["part", "chunk", "blob"])

    return run


def known(hashes: DataFrame, bits: int):
    """A broadcast bitmap of a column of 64-bit hashes; its size is fixed."""
    table = hashes.mapInArrow(_marks(bits), BLOB)
    return hashes.sparkSession.sparkContext.broadcast(collected(table, {"seen": np.zeros(1 << (bits - 3), np.uint8)})["seen"])


def _keep(shared, bits: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Bitmap(bits, shared.value)
        for batch in batches:
            key = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.filter(pa.array(seen.has(key)))

    return run


def prefiltered(rows: DataFrame, keys: list[str], wanted: DataFrame, bits: int = 24) -> DataFrame:
    """Rows whose keys may be among those of ``wanted``, found by a bitmap of fixed size: an inner join on the keys gives the same
    with or without this step, but after it only rows that count are shuffled. Nothing passes an empty ``wanted``."""
    key = F.xxhash64(*keys).alias("_key")
    shared = known(wanted.select(key), bits)
    marked = rows.select(*rows.columns, key)
    return marked.mapInArrow(_keep(shared, bits), marked.schema).drop("_key")
