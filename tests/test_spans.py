"""Span algebra against sets of characters."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import spans as S

_SPANS = st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)).map(lambda t: (t[0], t[0] + t[1])), max_size=5)
_CASES = st.lists(st.tuples(_SPANS, _SPANS, st.integers(0, 4)), min_size=20, max_size=40)


def _chars(spans):
    return {k for a, b in spans for k in range(a, b)}


def _runs(chars, gap=0):
    out = []
    for k in sorted(chars):
        if out and k - out[-1][1] <= gap:
            out[-1][1] = k + 1
        else:
            out.append([k, k + 1])
    return [tuple(x) for x in out]


def _rows(spans):
    return [(int(s["start"]), int(s["end"])) for s in spans]


@settings(max_examples=5, deadline=None)
@given(_CASES)
def test_algebra_matches_sets(spark, cases):
    text = "abcdefghijklmnopqrstuvwxyz0123456789äß日本"
    df = spark.createDataFrame([(k, a, b, g, text) for k, (a, b, g) in enumerate(cases)], f"k int, a {S.SPANS}, b {S.SPANS}, g int, t string")
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    got = df.select(
        "k", S.merge_spans(a).alias("merge"), S.bridge_gaps(a, F.col("g")).alias("bridge"), S.intersect_spans(a, b).alias("meet"), S.subtract_spans(a, b).alias("minus"),
        S.intersection_length(a, b).alias("n"), S.span_length(a).alias("len"), S.remove_spans(t, a).alias("left"), S.gaps(a, F.lit(40)).alias("gaps"),
    ).orderBy("k").collect()
    for row, (x, y, g) in zip(got, cases, strict=True):
        cx, cy = _chars(x), _chars(y)
        assert _rows(row["merge"]) == _runs(cx)
        assert _rows(row["bridge"]) == _runs(cx, g)
        assert _rows(row["meet"]) == _runs(cx & cy)
        assert _rows(row["minus"]) == _runs(cx - cy)
        assert row["n"] == len(cx & cy) and row["len"] == len(cx)
        assert row["n"] + sum(q - p for p, q in _rows(row["minus"])) == len(cx)
        assert row["left"] == "".join(c for k, c in enumerate(text) if k not in cx)
        assert _rows(row["gaps"]) == _runs(set(range(40)) - cx)


def test_fixed_cases(spark):
    df = spark.createDataFrame([([(5, 9), (1, 5), (12, 14)], "Rain today. Say hi.")], f"s {S.SPANS}, t string")
    row = df.select(S.merge_spans(F.col("s")).alias("m"), S.occurrences(F.lit("abcabcab"), F.lit("abc")).alias("o"), S.runs_of_true(F.array(*map(F.lit, [True, True, False, True]))).alias("r")).first()
    assert _rows(row["m"]) == [(1, 9), (12, 14)]
    assert _rows(row["o"]) == [(0, 3), (3, 6)]
    assert _rows(row["r"]) == [(0, 2), (3, 4)]


def test_nulls_empty_and_bad(spark):
    rows = [("abc", None), (None, [(0, 1)]), ("", []), ("abc", [(-5, 99)]), ("abc", [(2, 2)]), ("abc", [(1, 2), (0, 1)])]
    df = spark.createDataFrame(rows, f"t string, s {S.SPANS}")
    got = df.select(S.remove_spans(F.col("t"), F.col("s")).alias("left"), S.spans_fit(F.col("t"), F.col("s")).alias("fit")).collect()
    assert [r["left"] for r in got] == [None, None, "", "", "abc", "c"]
    assert [r["fit"] for r in got][2:] == [True, False, False, False]


def test_partitioning_does_not_matter(spark):
    df = spark.range(200).select("id", F.array(S.span(F.col("id") % 7, F.col("id") % 7 + 3), S.span(F.col("id") % 5 + 4, F.col("id") % 5 + 9)).alias("s"))
    one, many = (sorted((r.id, str(r.m)) for r in df.repartition(n).select("id", S.merge_spans(F.col("s")).alias("m")).collect()) for n in (1, 16))
    assert one == many
