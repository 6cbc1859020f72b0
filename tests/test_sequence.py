"""Ordered computations and JSON rewriting."""

import json

from pyspark.sql import functions as F

from spanloom.functions import jsonx as J
from spanloom.operators import sequence as Q


def test_boundary_weights(spark):
    rows = [([0, 0, 1, 1, 0, 0, 0],), ([],), (None,), ([1],), ([0, 0, 0],)]
    got = [r.w for r in spark.createDataFrame(rows, "x array<int>").select(Q.boundary_weights(F.col("x"), 1, 5.0).alias("w")).collect()]
    assert got == [[1.0, 5.0, 5.0, 5.0, 5.0, 1.0, 1.0], [], [], [5.0], [1.0, 1.0, 1.0]]


def test_windows_cover_everything(spark):
    rows = [(list(range(n)),) for n in (0, 1, 4, 5, 9, 10)]
    for row in spark.createDataFrame(rows, "x array<int>").select("x", Q.sliding_windows(F.col("x"), 4, 2).alias("w")).collect():
        assert {i for w in row.w for i in w["items"]} == set(row.x)
        assert all(len(w["items"]) == min(4, len(row.x)) and w["items"] == row.x[w["start"] : w["start"] + 4] for w in row.w)


def test_peaks(spark):
    rows = [([float(x) for x in (0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0)],), ([1.0],), (None,)]
    got = [r.g for r in spark.createDataFrame(rows, "x array<double>").select(Q.signal_peaks(5, 0.3, 3)("x").alias("g")).collect()]
    assert [(g["start"], g["end"]) for g in got[0]][0] == (3, 4) and got[1] == [] and got[2] is None
    peaks = spark.createDataFrame([([1, 2, 5, 9],)], "p array<int>").select(Q.grouped_peaks(F.col("p"), 3).alias("g")).first().g
    assert [(g["start"], g["end"]) for g in peaks] == [(1, 6), (9, 10)]


def test_messages(spark):
    rows = [("c", k, r, f"m{k}") for k, r in enumerate(["user", "tool", "assistant", "tool", "tool", "assistant"])]
    m = spark.createDataFrame(rows, "c string, k int, role string, t string")
    assert [r.turn for r in Q.turns(m, "c", "k", "role").orderBy("k").collect()] == [0, 0, 1, 1, 1, 2]
    assert [(r.role, r.t, r.messages) for r in Q.merged_runs(m, "c", "k", "role", "t").orderBy("k").collect()] == [("user", "m0\nm1", 2), ("assistant", "m2", 1), ("tool", "m3\nm4", 2), ("assistant", "m5", 1)]


def test_lineage_with_a_cycle(spark):
    values = spark.createDataFrame([(1, ["a"], None), (2, ["b"], ["x", "y"]), (3, ["c"], ["y", "z"]), (4, ["d"], ["q"])], "id long, sources array<string>, readers array<string>")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3)], "id long, needs long")
    got = {r.id: (r.sources, r.readers) for r in Q.lineage(values, edges).collect()}
    assert got[1] == (["a", "b", "c"], ["y"]) == got[2] and got[4] == (["a", "b", "c", "d"], [])


def test_json_rewriting(spark):
    text = json.dumps({"b": ["x", {"a": "y x"}], "a": 1})
    df = spark.createDataFrame([(text,), ("no json x",), (None,), ("[1",)], "t string")
    got = df.select(J.string_leaves("t").alias("l"), J.set_path("t", F.lit("$.b[1].a"), F.lit("é")).alias("s"), J.replace_in_strings("t", F.lit("x"), F.lit("z")).alias("r")).collect()
    assert [(x["path"], x["value"]) for x in got[0].l] == [("$.b[0]", "x"), ("$.b[1].a", "y x")]
    assert got[0].s == '{"b":["x",{"a":"é"}],"a":1}' and got[0].r == '{"b":["z",{"a":"y z"}],"a":1}'
    assert (got[1].l, got[1].s, got[1].r) == (None, None, "no json z") and (got[2].l, got[2].r) == (None, None) and got[3].s is None
    fixed = spark.createDataFrame([("{'a': True, 'b': None}",), ('```json\n{"a": 1}\n```',), ('"{\\"a\\": 2}"',), ('{"a": 3} and more',), ("{a",)], "t string").select(J.repaired("t").alias("x")).collect()
    assert [r.x for r in fixed] == ['{"a":true,"b":null}', '{"a":1}', '{"a":2}', '{"a":3}', None]


def test_calls(spark):
    df = spark.createDataFrame([("f", '{"x": [1, "é"], "y": null}'), ("not a name", "{}"), ("g", None)], "n string, a string")
    got = df.select(J.call_source("n", "a").alias("s")).select("s", J.parsed_calls("s").alias("c")).collect()
    assert got[0].s == "f(x=[1, 'é'], y=None)" and json.loads(got[0].c[0]["args"]) == {"x": [1, "é"], "y": None}
    assert got[1].s is None and got[1].c is None and got[2].c[0]["args"] == "{}"
    bad = spark.createDataFrame([("f(1)",), ("__import__('os').system('x')",), ("[f(a=1), g()]",)], "s string").select(J.parsed_calls("s").alias("c")).collect()
    assert bad[0].c is None and bad[1].c is None and [c["function"] for c in bad[2].c] == ["f", "g"]
