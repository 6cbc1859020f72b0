"""Ordered computations and JSON rewriting over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.text import html_snippet, html_title
from ..operators import sequence as Q
from ..operators.generate import escape_xml
from ..shared import read_table
from .registry import query


@query(
    """
    WITH r AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: (length(w) > 7)::INT) AS x FROM documents WHERE text <> ''),
    e AS (SELECT doc_id, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS i, len(x) AS n FROM r),
    c AS (SELECT doc_id, i, n, x <> coalesce(lag(x) OVER w, 0) AS start_change, x <> coalesce(lead(x) OVER w, 0) AS end_change FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    m AS (SELECT doc_id, i, max(start_change::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS a, max(end_change::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS b FROM c)
    SELECT doc_id, round(sum(CASE WHEN a = 1 OR b = 1 THEN 3 ELSE 1 END), 6)::DOUBLE AS weight FROM m GROUP BY doc_id"""
)
def boundary_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Total weight of the words of each document, those near a change of kind counting three times."""
    d = read_table(spark, folder, "documents").where("text <> ''")
    labels = F.transform(F.split("text", " "), lambda w: (F.length(w) > 7).cast("int"))
    return d.select("doc_id", F.aggregate(Q.boundary_weights(labels, 2, 3.0), F.lit(0.0), lambda n, w: n + w).alias("weight"))


@query(
    """
    WITH r AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text <> ''), e AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM r),
    p AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 3 AS new FROM e WHERE regexp_matches(w, '[0-9]')),
    g AS (SELECT doc_id, i, sum(coalesce(new, false)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM p)
    SELECT doc_id, min(i)::INT AS start, (max(i) + 1)::INT AS "end" FROM g GROUP BY doc_id, k"""
)
def grouped_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of words with digits that stand at most three words apart."""
    d = read_table(spark, folder, "documents").where("text <> ''")
    at = F.filter(F.transform(F.split("text", " "), lambda w, i: F.when(w.rlike("[0-9]"), i)), lambda i: i.isNotNull())
    return d.select("doc_id", F.explode(Q.grouped_peaks(at, 3)).alias("g")).select("doc_id", "g.start", "g.end")


@query()
def signal_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of peaks of the vectors of the embedding table."""
    e = read_table(spark, folder, "embeddings")
    return e.select("vec_id", F.explode(Q.signal_peaks(5, 0.1, 3)(F.col("embedding").cast("array<double>"))).alias("g")).select("vec_id", "g.start", "g.end")


@query(
    """
    WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text <> ''),
    s AS (SELECT doc_id, w, CASE WHEN len(w) <= 64 THEN [0] ELSE list_distinct(list_concat(range(0, len(w) - 63, 32), [len(w) - 64])) END AS starts FROM w)
    SELECT doc_id, unnest(starts)::INT AS start, md5(array_to_string(w[unnest(starts) + 1:unnest(starts) + 64], ' ')) AS words_md5 FROM s"""
)
def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 64 words that overlap by half."""
    d = read_table(spark, folder, "documents").where("text <> ''")
    w = d.select("doc_id", F.explode(Q.sliding_windows(F.split("text", " "), 64, 32)).alias("w"))
    return w.select("doc_id", "w.start", F.md5(F.array_join("w.items", " ")).alias("words_md5"))


_SQL_MESSAGES = "WITH m AS (SELECT case_id, event_no AS no, CASE WHEN event_no % 3 = 0 THEN 'assistant' WHEN event_no % 3 = 1 THEN 'tool' ELSE 'user' END AS role, tool_name AS text FROM defense_event)"


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    role = F.when(F.col("event_no") % 3 == 0, "assistant").when(F.col("event_no") % 3 == 1, "tool").otherwise("user")
    return read_table(spark, folder, "defense_event").select("case_id", F.col("event_no").alias("no"), role.alias("role"), F.col("tool_name").alias("text"))


@query(_SQL_MESSAGES + "SELECT case_id, no, count(*) FILTER (role = 'assistant') OVER (PARTITION BY case_id ORDER BY no) AS turn FROM m")
def conversation_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turn of each message."""
    return Q.turns(_messages(spark, folder), "case_id", "no", "role").select("case_id", "no", "turn")


@query(
    _SQL_MESSAGES
    + """, f AS (SELECT *, role = 'assistant' OR coalesce(lag(role) OVER w, 'assistant') = 'assistant' AS new FROM m WINDOW w AS (PARTITION BY case_id ORDER BY no)),
    g AS (SELECT *, sum(new::INT) OVER (PARTITION BY case_id ORDER BY no) AS k FROM f)
    SELECT case_id, min(no) AS no, min_by(role, no) AS role, string_agg(text, chr(10) ORDER BY no) AS text, count(*) AS messages FROM g GROUP BY case_id, k"""
)
def merged_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring tool and user messages as one."""
    return Q.merged_runs(_messages(spark, folder), "case_id", "no", "role", "text")


@query("SELECT s AS step, round(CASE WHEN s < 50 THEN s / 50 ELSE greatest(0, (400 - s) / 350) END, 6) AS factor FROM range(0, 420, 7) t(s)")
def schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Warm-up and decay of a learning rate."""
    del folder
    return spark.range(0, 420, 7).select(F.col("id").alias("step"), F.round(Q.schedule(F.col("id"), 50, 400), 6).alias("factor"))


@query(
    """
    WITH RECURSIVE e AS (SELECT n_nationkey AS id, n_regionkey AS needs FROM nation WHERE n_nationkey <> n_regionkey), r(id, needs) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.id, e.needs FROM r JOIN e ON e.id = r.needs)
    SELECT r.id, array_to_string(list_sort(list_distinct(list(n.n_name))), ',') AS sources,
           CASE WHEN count(*) FILTER (n.n_nationkey % 2 = 0) > 0 THEN 'ann' || CASE WHEN bool_and(n.n_nationkey % 2 = 1 OR n.n_nationkey % 3 = 0) THEN ',bob' ELSE '' END || CASE WHEN bool_and(n.n_nationkey % 2 = 1 OR n.n_nationkey % 3 <> 0) THEN ',eve' ELSE '' END END AS readers
    FROM r JOIN nation n ON n.n_nationkey = r.needs GROUP BY r.id"""
)
def value_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Sources and readers of values over what they depend on; odd ones are for everyone."""
    n = read_table(spark, folder, "nation")
    readers = F.when(F.col("n_nationkey") % 2 == 0, F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("ann"), F.lit("bob"))).otherwise(F.array(F.lit("ann"), F.lit("eve"))))
    values = n.select(F.col("n_nationkey").cast("long").alias("id"), F.array("n_name").alias("sources"), readers.alias("readers"))
    edges = n.where("n_nationkey <> n_regionkey").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("needs"))
    return Q.lineage(values, edges).select("id", F.array_join("sources", ",").alias("sources"), F.array_join("readers", ",").alias("readers"))


@query("SELECT doc_id, (json_array_length(text, '$.rows') + 1)::INT AS leaves, json_extract_string(text, '$.rows[0].note') AS first_note FROM documents WHERE starts_with(text, '{\"tool\"') AND json_valid(text)")
def json_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """String values inside JSON tool outputs."""
    d = read_table(spark, folder, "documents").where(F.col("text").startswith('{"tool"'))
    leaves = d.select("doc_id", J.string_leaves("text").alias("l")).where("l is not null")
    return leaves.select("doc_id", F.size("l").alias("leaves"), F.get(F.filter("l", lambda x: x["path"] == "$.rows[0].note"), F.lit(0))["value"].alias("first_note"))


@query("SELECT doc_id, replace(json_extract_string(text, '$.rows[0].note'), 'the', 'THE') AS note FROM documents WHERE starts_with(text, '{\"tool\"') AND json_valid(text) AND json_array_length(text, '$.rows') > 0")
def json_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """A string of JSON tool outputs after a replacement in all of them."""
    d = read_table(spark, folder, "documents").where(F.col("text").startswith('{"tool"') & F.try_parse_json("text").isNotNull())
    new = d.select("doc_id", J.replace_in_strings("text", F.lit("the"), F.lit("THE")).alias("t"))
    return new.select("doc_id", F.get_json_object("t", "$.rows[0].note").alias("note")).where("note is not null")


@query("SELECT case_id, suite_name || '(task=''' || user_task_id || ''', n=' || (case_id % 5) || ')' AS source FROM trace_case")
def call_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Calls as source text, parsed and printed again."""
    c = read_table(spark, folder, "trace_case")
    args = F.to_json(F.struct(F.col("user_task_id").alias("task"), (F.col("case_id") % 5).alias("n")))
    parsed = c.select("case_id", F.get(J.parsed_calls(J.call_source("suite_name", args)), F.lit(0)).alias("p"))
    return parsed.select("case_id", J.call_source("p.function", "p.args").alias("source"))


@query(
    """
    SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace('<h2>' || benchmark || '</h2><p>' || h || '</p>', '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), '^ | $', '', 'g')) AS snippet, benchmark AS title
    FROM (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS h FROM eval_item) WHERE length(text) < 1000"""
)
def html_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Plain text and title of pages built from the items. The SQL only covers items under 1,000 characters."""
    i = read_table(spark, folder, "eval_item").where("text is not null")
    page = i.select("item_id", F.concat(F.lit("<h2>"), "benchmark", F.lit("</h2><p>"), escape_xml(F.col("text")), F.lit("</p>")).alias("html"))
    return page.select("item_id", html_snippet(F.col("html"), 2**31 - 1).alias("snippet"), html_title(F.col("html")).alias("title"))
