"""Sources, sinks and streams."""

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanloom.sources import records as R
from spanloom.streaming import flows as S


def _trace(**changes):
    base = {
        "suite_name": "s", "pipeline_name": "p", "user_task_id": "user_task_1", "injection_task_id": None, "attack_type": None, "error": None, "injections": {"v": "do it"},
        "messages": [{"role": "user", "content": [{"type": "text", "content": "hi"}]}, {"role": "assistant", "content": [{"type": "text", "content": "done"}], "tool_calls": [{"function": "f", "args": {"x": [1, {"y": 2}]}, "id": "c1"}]}],
        "utility": True, "security": True, "duration": 1.5, "data_filter_events": [{"tool_name": "f", "original_tool_output": "a", "filtered_tool_output": "", "changed": True, "latency_ms": 5}],
    }
    return base | changes


def test_traces(spark, tmp_path):
    from spanloom.operators.traces import final_output, function_calls

    place = tmp_path / "runs" / "p" / "s" / "user_task_1" / "none"
    place.mkdir(parents=True)
    (place / "none.json").write_text(json.dumps(_trace()))
    (place / "injection_task_3.json").write_text('{"suite_name": ')
    (place / "notes.txt").write_text("no")
    traces = R.read_traces(spark, str(tmp_path / "runs")).cache()
    good = traces.where("suite_name is not null").first()
    assert traces.count() == 2 and (good.path_pipeline, good.path_attack, good.path_injection_task) == ("p", None, None)
    events = R.trace_events(traces).collect()
    assert len(events) == 1 and events[0].event_tool_name == "f" and events[0].event_latency_ms == 5
    calls = traces.where("suite_name is not null").select(F.get(function_calls(F.col("messages")), F.lit(0))["function"].alias("f"), final_output(F.col("messages")).alias("o")).first()
    assert (calls.f, calls.o) == ("f", "done")


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("é", [(1, 2)]), (None, [])], "id string, drop_spans array<struct<start:int,end:int>>")
    R.write_jsonl(df, str(tmp_path / "out"))
    lines = sorted(x for f in Path(tmp_path / "out").glob("part*") for x in f.read_text().splitlines())
    assert '{"id":"é","drop_spans":[{"start":1,"end":2}]}' in lines
    (tmp_path / "in.jsonl").write_text('{"id": "a"}\n\n{"id": \n{"id": "b", "drop_spans": [{"start": true, "end": 2}]}\n')
    back = R.read_jsonl(spark, str(tmp_path / "in.jsonl")).cache()
    assert back.count() == 3 and back.where("_corrupt_record is not null").count() >= 1


def test_indexed_json_and_html(spark, tmp_path):
    (tmp_path / "squad-direct.json").write_text('{"0": {"utility": true}, "7": {"utility": false}}')
    assert sorted((r["index"], r.utility) for r in R.read_indexed_json(spark, str(tmp_path / "squad-direct.json"), "utility boolean").collect()) == [(0, True), (7, False)]
    html = '<table id="t"><tr><th>A</th><th>B</th></tr><tr><td rowspan="2">x &amp;<b>y</b></td><td>1</td></tr><tr><td> 2 </td></tr></table>'
    cells = R.read_html_table(spark.createDataFrame([(1, html)], "p int, h string"), "h", "t").collect()
    assert sorted((r["row"], r["col"], r["text"]) for r in cells) == [(0, 0, "A"), (0, 1, "B"), (1, 0, "x &amp;y"), (1, 1, "1"), (2, 0, "x &amp;y"), (2, 1, "2")]


def test_environment(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "inner.yaml").write_text("- {id: 1, name: a}\n- {id: 2, name: b}\n")
    (tmp_path / "note.txt").write_text("plain")
    (tmp_path / "env.yaml").write_text("mail:\n  list: !include inner.yaml\nnote: !include note.txt\n")
    env = R.read_environment(str(tmp_path / "env.yaml"))
    assert env["note"] == "plain"
    assert [(r.id, r.name) for r in R.environment_table(spark, env, "mail.list", "id int, name string").orderBy("id").collect()] == [(1, "a"), (2, "b")]


def test_publish_and_fingerprint(spark, tmp_path):
    at = f"file://{tmp_path}/table"
    R.publish(spark.range(3).toDF("k"), at)
    R.publish(spark.range(5).toDF("k"), at)
    assert spark.read.parquet(at).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["table"]
    with pytest.raises(Exception):  # noqa: B017
        R.publish(spark.range(2).select(F.raise_error(F.lit("no")).alias("k")), at)
    assert spark.read.parquet(at).count() == 5
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("x")
    one = R.folder_fingerprint(spark, str(tmp_path / "f"))
    (tmp_path / "f" / "a.txt").write_text("y")
    assert one != R.folder_fingerprint(spark, str(tmp_path / "f"))
    for name, text in (("p", "1"), ("q", "2")):
        (tmp_path / "g" / name).mkdir(parents=True)
        (tmp_path / "g" / name / "x").write_text(text)
    two = R.folder_fingerprint(spark, str(tmp_path / "g"))
    assert sorted(r.path for r in R.fingerprint(spark, str(tmp_path / "g")).collect()) == ["p/x", "q/x"]
    (tmp_path / "g" / "p" / "x").write_text("2"), (tmp_path / "g" / "q" / "x").write_text("1")
    assert two != R.folder_fingerprint(spark, str(tmp_path / "g"))


def test_rendered_tables(spark):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "x string, y int")
    assert R.markdown(df).splitlines()[2] == "| a\\|b | 1 |"
    assert r"a|b & 1 \\" in R.latex(df)
    with pytest.raises(ValueError, match="more than"):
        R.markdown(df, most=1)


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    schema = "event_no int, tool_call_id string"
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema).coalesce(1).write.parquet(f"{folder}/t.parquet")
    S.append_new(S.stream_table(spark, folder, "t"), "tool_call_id", out, checkpoint)
    spark.createDataFrame([(4, "b"), (5, "c")], schema).coalesce(1).write.mode("append").parquet(f"{folder}/t.parquet")
    S.append_new(S.stream_table(spark, folder, "t"), "tool_call_id", out, checkpoint)
    assert sorted(r.tool_call_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    # A second checkpoint starts anew but finds the keys; a batch that is done again replaces itself.
    S.append_new(S.stream_table(spark, folder, "t"), "tool_call_id", out, checkpoint + "2")
    assert spark.read.parquet(out).count() == 3
    shutil.rmtree(f"{checkpoint}/commits"), shutil.rmtree(f"{checkpoint}/offsets")
    S.append_new(S.stream_table(spark, folder, "t"), "tool_call_id", out, checkpoint)
    assert sorted(r.tool_call_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
