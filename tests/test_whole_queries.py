"""Queries whose SQL covers only some rows, by brute force on the rest."""

import re

from spanloom.plans import QUERIES


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarity_of_pairs_in_any_script(spark, tmp_path):
    pairs = [("plain", "plane"), ("café “now”", "cafe 'now'"), ("日本語の文", "日本の文"), ("Zürich\n", "Zurich"), ("é", ""), ("", ""), (None, "é"), ("only", None)]
    rows = [(f"p{k}", side == 0, t) for k, p in enumerate(pairs) for side, t in enumerate(p)]
    spark.createDataFrame(rows, "source_pair_id string, is_injection boolean, tool_output string").write.parquet(f"{tmp_path}/sanitizer_sample.parquet")
    got = {r.source_pair_id: (r.distance, r.similarity) for r in QUERIES["sanitizer_similarity"](spark, str(tmp_path)).collect()}
    whole = {f"p{k}": (d := _distance(i, b), round(1 - d / max(len(i), len(b), 1), 6)) for k, (i, b) in enumerate(pairs) if i is not None and b is not None}
    assert got == whole and len(got) == 6


def test_snippets_of_items_of_any_length(spark, tmp_path):
    texts = ["short <b> & more", "x" * 999, "word & word\n" * 200, "é <i>\t" * 5000, "", None]
    spark.createDataFrame([(k, f"bench{k}", t) for k, t in enumerate(texts)], "item_id long, benchmark string, text string").write.parquet(f"{tmp_path}/eval_item.parquet")
    got = {r.item_id: (r.snippet, r.title) for r in QUERIES["html_snippets"](spark, str(tmp_path)).collect()}
    escaped = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    assert got == {k: (re.sub(r"\s+", " ", f"bench{k} {escaped(t)}").strip(), f"bench{k}") for k, t in enumerate(texts) if t is not None}
