"""Interval algebra on arrays of half-open spans ``struct<start int, end int>``, as Column expressions.

Offsets count code points. Null arrays give null. Arrays may come unsorted unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int>>"


def span(start: Column | int, end: Column | int) -> Column:
    as_int = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return F.struct(as_int(start).alias("start"), as_int(end).alias("end"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; inside a lambda a repeated expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def no_spans() -> Column:
    return F.array().cast(SPANS)


def bridge_gaps(spans: Column, max_gap: Column | int = 0) -> Column:
    """Sorted spans, merged where the gap to the one before is at most ``max_gap``; touching spans always merge."""
    gap = F.lit(max_gap) if isinstance(max_gap, int) else max_gap

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(span(last["start"], F.greatest(last["end"], s["end"]))))
        return F.when(F.size(done) == 0, F.array(s)).when(s["start"] - last["end"] <= gap, joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans.cast(SPANS)), no_spans(), step)


def merge_spans(spans: Column) -> Column:
    """Sorted spans without overlaps; touching spans merge."""
    return bridge_gaps(spans, 0)


def span_length(spans: Column) -> Column:
    """Code points in the union of the spans."""
    return F.aggregate(merge_spans(spans), F.lit(0), lambda n, s: n + s["end"] - s["start"])


def intersect_spans(a: Column, b: Column) -> Column:
    """Sorted intersection of two unions of spans."""
    meet = lambda s, t: span(F.greatest(s["start"], t["start"]), F.least(s["end"], t["end"]))
    within = lambda s, y: F.transform(F.filter(y, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])), lambda t: meet(s, t))
    return let(merge_spans(b), lambda y: F.flatten(F.transform(merge_spans(a), lambda s: within(s, y))))


def intersection_length(a: Column, b: Column) -> Column:
    """Code points in the intersection of two unions of spans."""
    common = lambda s, t: F.greatest(F.lit(0), F.least(s["end"], t["end"]) - F.greatest(s["start"], t["start"]))
    inner = lambda s, y: F.aggregate(y, F.lit(0), lambda k, t: k + common(s, t))
    return let(merge_spans(b), lambda y: F.aggregate(merge_spans(a), F.lit(0), lambda n, s: n + inner(s, y)))


def gaps(spans: Column, length: Column) -> Column:
    """What the union of the spans leaves of [0, length), without empty spans."""
    starts = lambda m: F.concat(F.array(F.lit(0)), F.transform(m, lambda s: s["end"]))
    ends = lambda m: F.concat(F.transform(m, lambda s: s["start"]), F.array(length.cast("int")))
    return let(merge_spans(spans), lambda m: F.filter(F.zip_with(starts(m), ends(m), span), lambda s: s["start"] < s["end"]))


def subtract_spans(a: Column, b: Column) -> Column:
    """Sorted difference of two unions of spans."""
    top = F.coalesce(F.array_max(F.transform(a, lambda s: s["end"])), F.lit(0))
    return intersect_spans(a, gaps(b, top))


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without the union of the spans. Parts of spans outside the text are ignored; a null text or array gives null."""
    kept = F.transform(gaps(clip_spans(spans, F.lit(0), F.length(text)), F.length(text)), lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    return F.when(text.isNotNull() & spans.isNotNull(), F.array_join(kept, ""))


def clip_spans(spans: Column, low: Column, high: Column) -> Column:
    """Spans cut to [low, high); empty ones drop out."""
    cut = F.transform(spans.cast(SPANS), lambda s: span(F.greatest(s["start"], low), F.least(s["end"], high)))
    return F.filter(cut, lambda s: s["start"] < s["end"])


def shift_spans(spans: Column, by: Column | int) -> Column:
    return F.transform(spans, lambda s: span(s["start"] + by, s["end"] + by))


def span_texts(text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))


def spans_fit(text: Column, spans: Column) -> Column:
    """Whether all spans are non-empty, within the text, sorted and without overlaps. False for an array with null fields."""
    inside = F.forall(spans, lambda s: F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)), F.lit(False)))
    pairs = F.when(F.size(spans) > 1, F.sequence(F.lit(1), F.size(spans) - 1)).otherwise(F.array().cast("array<int>"))
    ordered = F.forall(pairs, lambda k: F.coalesce(F.element_at(spans, k)["end"] <= F.element_at(spans, k + 1)["start"], F.lit(False)))
    return inside & ordered


def occurrences(text: Column, needle: Column) -> Column:
    """Spans of all non-overlapping occurrences of a non-empty string, from left to right."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), needle, F.lit("\\E")), -1)
    lengths = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p))
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("found"))

    def step(acc: Column, n: Column) -> Column:
        at = acc["at"] + n
        end = at + F.length(needle)
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(span(at, end))).alias("found"))

    return F.when(F.length(needle) > 0, F.aggregate(lengths, start, step, lambda acc: acc["found"])).when(needle.isNotNull() & text.isNotNull(), no_spans())


def spans_from_tokens(tokens: Column, low: Column, high: Column) -> Column:
    """Merged data-relative spans of the dropped tokens of ``array<struct<start,end,drop boolean>>``, cut to [low, high)."""
    dropped = F.transform(F.filter(tokens, lambda t: t["drop"]), lambda t: span(t["start"], t["end"]))
    return merge_spans(shift_spans(clip_spans(dropped, low, high), -low))


def spans_from_probabilities(tokens: Column, threshold: Column | float) -> Column:
    """Merged spans of the tokens of ``array<struct<start,end,p double>>`` with p of at least the threshold."""
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    return merge_spans(F.transform(F.filter(tokens, lambda t: t["p"] >= limit), lambda t: span(t["start"], t["end"])))


def runs_of_true(mask: Column) -> Column:
    """Half-open runs of true in an array of booleans."""
    marked = F.filter(F.transform(mask, lambda x, i: F.when(x, span(i, i + 1))), lambda s: s.isNotNull())
    return merge_spans(marked)
