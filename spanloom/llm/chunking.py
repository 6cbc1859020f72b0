"""Splitting oversized texts at natural boundaries, by content-defined chunking.

A rolling hash over the last 32 code points marks landmarks. From the start of a piece, the first landmark between the
minimum and the maximum size is taken and moved to the nearest natural boundary within those sizes: the end of a
paragraph, line or sentence close to it, else of a word. Where a stretch has no landmark, the natural boundary of the
best kind with the smallest hash is taken; where it has no boundary, the piece is cut at the landmark or at
the maximum. All choices depend on nearby text only, so an edit alters the pieces around it and later cuts fall where they fell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import arrow_rows, mix

#: Kinds of cuts, from weakest to strongest; "end" is the end of the text.
CUTS = ("forced", "word", "sentence", "line", "paragraph", "end")

_WINDOW = 32
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_STOPS = np.array([ord(c) for c in ".!?…"], np.uint32)
_WIDE_STOPS = np.array([ord(c) for c in "。！？"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]}»”’」』"], np.uint32)


@dataclass(frozen=True)
class Sizes:
    """``limit``: most code points of a piece, the overlap included. ``overlap``: code points a piece repeats from the one before.
    ``least``: fewest new code points of a piece but the last. ``every``: mean distance of landmarks, a power of two. ``near``: how far
    from a landmark the end of a sentence or better is preferred to the end of a word."""

    limit: int = 2000
    overlap: int = 100
    least: int = 400
    every: int = 512
    near: int = 200

    def __post_init__(self) -> None:
        if not 0 < self.least < self.limit - self.overlap or self.overlap < 0:
            raise ValueError("need 0 <= overlap and 0 < least < limit - overlap")


def rolling_hash(points: np.ndarray) -> np.ndarray:
    """Hash of the ``_WINDOW`` code points that end at each place (fewer at the start)."""
    n = len(points)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, _BASE, np.uint64))
        down = np.cumprod(np.full(n, _INVERSE, np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * down)])
        ends = np.arange(1, n + 1)
        return mix((sums[ends] - sums[np.maximum(0, ends - _WINDOW)]) * up)


def boundaries(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a text may be cut, and the kind of each (an index into ``CUTS``)."""
    n = len(points)
    space = np.isin(points, _SPACES)
    feed = (points == 10) | (points == 0x2029)
    at = np.flatnonzero(space[:-1] & ~space[1:]) + 1  # before the first character after white space
    # The run of white space before each place, and what stands before the run.
    last = np.maximum.accumulate(np.where(~space, np.arange(n), -1))[at - 1]
    feeds = np.concatenate([[0], np.cumsum(feed)])
    lines = feeds[at] - feeds[last + 1]
    closed = last - ((last > 0) & np.isin(points[np.maximum(last, 0)], _CLOSERS))
    stop = (closed >= 0) & np.isin(points[np.maximum(closed, 0)], np.concatenate([_STOPS, _WIDE_STOPS]))
    kind = np.where(lines >= 2, 4, np.where(lines == 1, 3, np.where(stop, 2, 1)))
    wide = np.flatnonzero(np.isin(points[:-1], _WIDE_STOPS) & ~space[1:] & ~np.isin(points[1:], _CLOSERS)) + 1
    at, kind = np.concatenate([at, wide]), np.concatenate([kind, np.full(len(wide), 2)])
    order = np.argsort(at, kind="stable")
    return at[order], kind[order]


def _joined(points: np.ndarray, at: int) -> bool:
    """Whether a cut at this place would part a character from its marks or a joined sequence."""
    c, before = int(points[at]), int(points[at - 1])
    return c == 0x200D or before == 0x200D or 0x300 <= c <= 0x36F or 0xFE00 <= c <= 0xFE0F or 0x1F3FB <= c <= 0x1F3FF or (before == 13 and c == 10)


def cut_places(text: str, sizes: Sizes) -> tuple[list[tuple[int, int]], int]:
    """(place, kind) of each cut, the end of the text included, and the longest run without space, tab, CR or LF."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    breaks = np.flatnonzero(np.isin(points, np.array([32, 9, 13, 10], np.uint32)))
    unbroken = int(np.diff(np.concatenate([[-1], breaks, [n]])).max() - 1)
    if n <= sizes.limit:
        return [(n, 5)], unbroken
    h = rolling_hash(points)
    marks = np.flatnonzero((h & np.uint64(sizes.every - 1)) == 0) + 1
    natural, kinds = boundaries(points)
    cuts: list[tuple[int, int]] = []
    start = 0
    while n - start > sizes.limit - (sizes.overlap if start else 0):
        lo, hi = start + sizes.least, start + sizes.limit - (sizes.overlap if start else 0)
        first = int(np.searchsorted(marks, lo))
        mark = int(marks[first]) if first < len(marks) and marks[first] <= hi else None
        a, b = np.searchsorted(natural, lo, "left"), np.searchsorted(natural, hi, "right")
        if b > a:
            places, kind = natural[a:b], kinds[a:b]
            if mark is None:
                best = np.flatnonzero(kind == kind.max())
                pick = best[np.argmin(h[places[best] - 1])]
            else:
                far = np.abs(places - mark)
                close = np.flatnonzero((kind >= 2) & (far <= sizes.near))
                pool = close if len(close) else np.arange(len(places))
                pick = pool[np.argmin(far[pool])]
            cut, why = int(places[pick]), int(kind[pick])
        else:
            cut, why = mark or hi, 0
            while cut > lo and _joined(points, cut):
                cut -= 1
        cuts.append((cut, why))
        start = cut
    return [*cuts, (n, 5)], unbroken


def pieces(text: str, sizes: Sizes) -> tuple[list[tuple[int, int, str]], int]:
    """(start, end, cut) of each piece, end exclusive, and the longest unbroken run."""
    cuts, unbroken = cut_places(text, sizes)
    found, start = [], 0
    for place, kind in cuts:
        found.append((max(0, start - sizes.overlap) if start else 0, place, CUTS[kind]))
        start = place
    return found, unbroken


PIECES = "id long, piece int, n_pieces int, start int, end int, cut string, text string, spans array<struct<start:int,end:int>>, bad_spans int, unbroken int"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_TYPES = {"id": pa.int64(), "piece": pa.int32(), "n_pieces": pa.int32(), "start": pa.int32(), "end": pa.int32(), "cut": pa.string(), "text": pa.string(), "spans": _SPANS, "bad_spans": pa.int32(), "unbroken": pa.int32()}


def _split(sizes: Sizes) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for key, text, spans in arrow_rows(batches, "id", "text", "spans"):
            found, unbroken = pieces(text, sizes)
            fit, bad = None, 0
            if spans is not None:
                fit = [s for s in spans if s and s["start"] is not None and s["end"] is not None and 0 <= s["start"] < s["end"] <= len(text)]
                bad = len(spans) - len(fit)
            for k, (a, b, cut) in enumerate(found):
                own = None if fit is None else [{"start": max(s["start"], a) - a, "end": min(s["end"], b) - a} for s in fit if s["start"] < b and s["end"] > a]
                rows.append((key, k + 1, len(found), a, b, cut, text[a:b], own, bad, unbroken))
                held += b - a
            if held > 4_000_000:
                yield _rows(rows)
                rows, held = [], 0
        if rows:
            yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES.values(), strict=True)], list(_TYPES))


def split_oversized(records: DataFrame, id_col: str, text_col: str, spans_col: str | None = None, sizes: Sizes = Sizes()) -> DataFrame:
    """Pieces of the texts over the limit, in order, with ``spans_col`` carried over to each piece's own offsets.

    Consecutive pieces overlap by exactly ``sizes.overlap`` code points; without the overlaps the pieces make up the text. A
    span that crosses a cut is cut with it; one that doesn't fit the text (null, empty or out of bounds) is left out and
    counted in ``bad_spans``. Null spans stay null. Null texts and texts within the limit give no row here; ``all_pieces``
    gives one for the latter. Repeated rows are split each; other columns are ignored. No shuffle.
    """
    spans = F.lit(None).cast("array<struct<start:int,end:int>>") if spans_col is None else F.col(spans_col).cast("array<struct<start:int,end:int>>")
    long = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), spans.alias("spans")).where(F.length("text") > sizes.limit)
    return long.mapInArrow(_split(sizes), PIECES)


def all_pieces(records: DataFrame, id_col: str, text_col: str, spans_col: str | None = None, sizes: Sizes = Sizes()) -> DataFrame:
    """``split_oversized``, and texts within the limit (the empty one too) as their only piece, without Python. Null texts give no piece.
    ``unbroken`` is null for the latter."""
    spans = F.lit(None).cast("array<struct<start:int,end:int>>") if spans_col is None else F.col(spans_col).cast("array<struct<start:int,end:int>>")
    short = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), spans.alias("given")).where(F.length("text") <= sizes.limit)
    fits = F.filter("given", lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length("text")))
    whole = short.select(
        "id", F.lit(1).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("end").alias("cut"), "text",
        fits.alias("spans"), F.coalesce(F.size("given") - F.size(fits), F.lit(0)).cast("int").alias("bad_spans"), F.lit(None).cast("int").alias("unbroken"),
    )
    return split_oversized(records, id_col, text_col, spans_col, sizes).unionByName(whole)
