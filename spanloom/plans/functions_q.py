"""Functions over texts, spans, messages and calls that the other queries don't show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import labels as LB
from ..functions import spans as SP
from ..functions import text as X
from ..operators import agents as G
from ..operators import plugins as P
from ..operators import stats as ST
from ..operators import traces as T
from ..operators.metrics import alignment
from ..shared import read_table
from .registry import SQL_SPACE, query

_WORD_SPANS = f"""
    w AS (SELECT doc_id, text, regexp_extract_all(text, '{SQL_SPACE}*{SQL_SPACE.replace("[", "[^", 1)}+') AS parts FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM w),
    t AS (SELECT doc_id, text, k, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k) AS b, length(regexp_replace(part, '^{SQL_SPACE}+', '')) AS n FROM e),
    s AS (SELECT doc_id, text, k, (b - n)::INT AS a, b::INT AS b FROM t)
"""


@query("WITH" + _WORD_SPANS + "SELECT doc_id, count(*) AS words, sum(a)::BIGINT AS starts, sum(b)::BIGINT AS ends FROM s GROUP BY doc_id")
def word_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets of the words of each text, summed."""
    d = read_table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(X.word_spans(F.col("text"))).alias("w"))
    return d.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum("w.start").alias("starts"), F.sum("w.end").alias("ends"))


# A word is flagged if its number leaves no rest by three or four; neighbours whose spans touch or overlap merge.
_SQL_RUNS = """,
    f AS (SELECT *, k % 3 = 0 OR k % 4 = 0 AS flag FROM s), c AS (SELECT doc_id, greatest(a, 7) - 7 AS a, least(b, 400) - 7 AS b FROM f WHERE flag AND greatest(a, 7) < least(b, 400)),
    g AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM c),
    r AS (SELECT doc_id, a, b, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM g), m AS (SELECT doc_id, run, min(a) AS a, max(b) AS b FROM r GROUP BY ALL)
"""


@query("WITH" + _WORD_SPANS + _SQL_RUNS + "SELECT doc_id, a AS start, b AS \"end\" FROM m")
def flagged_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Merged spans of flagged words, relative to the data and cut to it."""
    words = F.transform(X.word_spans(F.col("text")), lambda w, i: F.struct(w["start"].alias("start"), w["end"].alias("end"), (((i + 1) % 3 == 0) | ((i + 1) % 4 == 0)).alias("drop")))
    d = read_table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(SP.spans_from_tokens(words, F.lit(7), F.lit(400))).alias("s"))
    return d.select("doc_id", "s.start", "s.end")


@query("WITH" + _WORD_SPANS + ", f AS (SELECT doc_id, a, b FROM s WHERE ((k * 37) % 100) / 100 >= 0.8) SELECT doc_id, count(*) AS spans, sum(b - a)::BIGINT AS chars FROM f GROUP BY doc_id")
def decoded_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of words whose probability reaches a threshold."""
    tokens = F.transform(X.word_spans(F.col("text")), lambda w, i: F.struct(w["start"].alias("start"), w["end"].alias("end"), (((i + 1) * 37) % 100 / 100).alias("p")))
    spans = SP.spans_from_probabilities(tokens, 0.8)
    d = read_table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(spans).alias("s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("s.end") - F.col("s.start")).alias("chars"))


@query(
    """
    WITH b AS (SELECT doc_id, list_transform(range(0, 40), lambda i: (doc_id // (i + 1)) % 3 = 0) AS m FROM documents), e AS (SELECT doc_id, unnest(range(0, 40)) AS i, unnest(m) AS x FROM b),
    g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e WHERE x) SELECT doc_id, min(i)::INT AS start, (max(i) + 1)::INT AS "end" FROM g GROUP BY doc_id, run"""
)
def mask_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of true in a mask."""
    mask = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.floor(F.col("doc_id") / (i + 1)) % 3 == 0)
    return read_table(spark, folder, "documents").select("doc_id", F.explode(SP.runs_of_true(mask)).alias("s")).select("doc_id", "s.start", "s.end")


@query(
    """
    WITH s AS (SELECT source_pair_id, max(tool_output) FILTER (is_injection) AS i, max(tool_output) FILTER (NOT is_injection) AS b FROM sanitizer_sample GROUP BY 1)
    SELECT source_pair_id, i = b AS exact, length(b) AS kept_at_least, true AS removed_is_the_rest FROM s WHERE i IS NOT NULL AND b IS NOT NULL AND length(i) > length(b) AND contains(i, b)"""
)
def aligned_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment of injected and benign texts where the one holds the other whole: what is removed is as long as the rest."""
    s = read_table(spark, folder, "sanitizer_sample").groupBy("source_pair_id").agg(F.max(F.when(F.col("is_injection"), F.col("tool_output"))).alias("i"), F.max(F.when(~F.col("is_injection"), F.col("tool_output"))).alias("b"))
    s = s.where(F.col("i").isNotNull() & F.col("b").isNotNull() & (F.length("i") > F.length("b")) & F.col("i").contains(F.col("b"))).withColumn("a", alignment("i", "b", "b"))
    removed = F.aggregate("a.removed", F.lit(0), lambda n, x: n + F.length(x))
    return s.select("source_pair_id", (F.col("i") == F.col("b")).alias("exact"), F.length("b").cast("long").alias("kept_at_least"), ((removed == F.length("i") - F.length("b")) & F.col("a.exact")).alias("removed_is_the_rest"))


@query("SELECT row_id, upper(instruction[1]) || substr(instruction, 2) AS first, regexp_replace(regexp_replace(replace(replace(instruction, '\\\\', '\\\\\\\\'), '\"', '\\\\\"'), '\\n', '\\\\n', 'g'), '\\t', '\\\\t', 'g') AS escaped FROM tagger_record WHERE regexp_full_match(instruction, '[ -~\\n\\t]*')")
def cased_and_escaped(spark: SparkSession, folder: str) -> DataFrame:
    """Instructions with a first capital, and as they stand inside a JSON string."""
    r = read_table(spark, folder, "tagger_record").where(F.col("instruction").rlike("^[ -~\n\t]*$"))
    return r.select("row_id", X.capitalise_first(F.col("instruction")).alias("first"), X.escape_json(F.col("instruction")).alias("escaped"))


@query(
    """
    SELECT case_id, CASE WHEN abs(duration - 50) <= 1e-12 THEN 'tie' WHEN duration > 50 THEN 'first' ELSE 'second' END AS winner, contains(lower(pipeline_name), lower(split_part(pipeline_name, '_', 2))) AS holds, starts_with(lower(trim(pipeline_name, ' ')), 'model-a') AS begins,
           coalesce(contains(lower(error), 'yes') AND NOT contains(error, 'Rejected'), false) AS judged FROM trace_case WHERE duration IS NOT NULL"""
)
def simple_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Winners with a tolerance, substring and prefix matches, and a judge's yes."""
    c = read_table(spark, folder, "trace_case").where("duration is not null")
    part = F.split_part("pipeline_name", F.lit("_"), F.lit(2))
    return c.select(
        "case_id", LB.winner(F.col("duration"), F.lit(50.0)).alias("winner"), LB.substring_match(F.col("pipeline_name"), part).alias("holds"), LB.prefix_match(F.col("pipeline_name"), F.lit("Model-A")).alias("begins"),
        LB.judged_yes(F.col("error")).alias("judged"),
    )


@query("SELECT event_no, '{\"tool\":\"' || coalesce(tool_name, 'none') || '\",\"n\":' || event_no || ',\"ok\":true}' AS json, CASE WHEN event_no % 2 = 0 THEN coalesce(tool_name, 'none') END AS field FROM defense_event")
def repaired_json(spark: SparkSession, folder: str) -> DataFrame:
    """JSON and Python literals, fenced or quoted or with text after them, as compact JSON; a field of the fenced ones."""
    e = read_table(spark, folder, "defense_event")
    tool, n = F.coalesce("tool_name", F.lit("none")), F.col("event_no").cast("string")
    as_json = F.concat(F.lit('{"tool": "'), tool, F.lit('", "n": '), n, F.lit(', "ok": true}'))
    literal = F.concat(F.lit("{'tool': '"), tool, F.lit("', 'n': "), n, F.lit(", 'ok': True}"))
    k = F.col("event_no") % 4
    said = F.when(k == 0, F.concat(F.lit("```json\n"), as_json, F.lit("\n```"))).when(k == 1, F.concat(as_json, F.lit(" and so on"))).when(k == 2, F.concat(F.lit("```\n"), as_json, F.lit("\n```"))).otherwise(literal)
    return e.select("event_no", J.repaired(said).alias("json"), F.when(k % 2 == 0, X.last_json_string(said, "tool")).alias("field"))


_SQL_MESSAGES = "FROM (SELECT case_id, list(tool_name ORDER BY event_no) AS t FROM defense_event GROUP BY 1)"


@query(f"SELECT case_id, len(list_filter(t, lambda x: x IS NOT NULL)) AS calls, CASE WHEN len(t) % 2 = 1 THEN t[-1] || chr(10) || 'end' END AS final {_SQL_MESSAGES}")
def message_views(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of the old form upgraded: the calls in them, and the text of the last one if an assistant sent it."""
    e = read_table(spark, folder, "defense_event").groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("event_no", "tool_name"))).alias("e"))
    call = lambda x: F.when(x["tool_name"].isNotNull(), F.array(F.struct(x["tool_name"].alias("function"))))
    old = F.transform("e", lambda x, i: F.struct(F.when((F.size("e") - 1 - i) % 2 == (F.size("e") + 1) % 2, "assistant").otherwise("tool").alias("role"), x["tool_name"].alias("content"), call(x).alias("tool_calls")))
    new = T.upgraded_messages(old)
    every = F.transform(new, lambda m: m.withField("role", F.lit("assistant")))
    ended = F.transform(new, lambda m: m.withField("content", F.when(m["content"].isNotNull(), F.concat(m["content"], F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("content")), F.struct(F.lit("text").alias("type"), F.lit("end").alias("content")))))))
    return e.select("case_id", F.size(T.function_calls(every)).cast("long").alias("calls"), F.when(F.size("e") % 2 == 1, T.final_output(ended)).alias("final"))


@query(
    """
    WITH v AS (SELECT DISTINCT user_task_id, agentdojo_package_version AS v FROM trace_case WHERE agentdojo_package_version IS NOT NULL)
    SELECT user_task_id, max_by(v, string_split(v, '.')::INT[]) AS version FROM v WHERE string_split(v, '.')::INT[] < [0, 1, 32] GROUP BY user_task_id"""
)
def version_below(spark: SparkSession, folder: str) -> DataFrame:
    """The highest version strictly below a bound that each task ran under."""
    c = read_table(spark, folder, "trace_case").where("agentdojo_package_version is not null")
    parts = F.split("agentdojo_package_version", r"\.")
    items = c.select("user_task_id", F.col("agentdojo_package_version").alias("version"), *(parts[k].cast("int").alias(f"n{k}") for k in range(3))).distinct()
    return ST.version_compatible(items, "user_task_id", ["n0", "n1", "n2"], (0, 1, 32), strictly=True).select("user_task_id", "version")


@query("WITH m AS (SELECT pipeline_name, suite_name, round(avg(utility::INT), 6) AS u, round(-avg(security::INT), 6) AS v FROM trace_case GROUP BY ALL HAVING avg(security::INT) IS NOT NULL AND avg(utility::INT) IS NOT NULL) SELECT suite_name, u, v FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.suite_name = a.suite_name AND b.u >= a.u AND b.v >= a.v AND (b.u > a.u OR b.v > a.v)) GROUP BY ALL")
def pareto_back(spark: SparkSession, folder: str) -> DataFrame:
    """Front of utility and negated attack success among the pipelines of a suite."""
    c = read_table(spark, folder, "trace_case").groupBy("pipeline_name", "suite_name").agg(F.round(F.avg(F.col("utility").cast("int")), 6).alias("u"), F.round(-F.avg(F.col("security").cast("int")), 6).alias("v"))
    return ST.pareto_front(c.where("u is not null and v is not null"), ["suite_name"], "u", "v", second_high=True).select("suite_name", "u", "v")


@query(
    """
    SELECT event_no, CASE WHEN tool_name IS NULL THEN NULL WHEN tool_name = 'get_weather' THEN '{"n": ' || event_no * 2 || '}' WHEN tool_name = 'read_file' THEN NULL ELSE NULL END AS result,
           CASE WHEN tool_name = 'get_weather' THEN NULL WHEN tool_name = 'read_file' THEN 'ValueError: no' ELSE 'ToolNotFoundError: ' || tool_name END AS error FROM defense_event WHERE tool_name IS NOT NULL"""
)
def called_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Functions applied to their arguments; failures and unknown names become error texts."""

    def broken(n: int) -> None:
        raise ValueError("no")

    e = read_table(spark, folder, "defense_event").where("tool_name is not null").select("event_no", "tool_name", F.to_json(F.struct(F.col("event_no").alias("n"))).alias("args"))
    return P.called(e, "tool_name", "args", {"get_weather": lambda n: {"n": 2 * n}, "read_file": broken}).select("event_no", "result", "error")


@query(
    """
    SELECT event_no, CASE WHEN original_tool_output LIKE '%please%' THEN [strpos(original_tool_output, 'please') - 1] ELSE [] END AS starts, NOT contains(original_tool_output, 'delete') AS success FROM defense_event WHERE original_tool_output IS NOT NULL AND NOT contains(original_tool_output, 'delete')
    UNION ALL SELECT event_no, [], false FROM defense_event WHERE contains(original_tool_output, 'delete')"""
)
def tagged_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Spans from a tagger that fails on some texts: batches are halved until a failing text stands alone."""

    def tag(instructions: list[str], texts: list[str]) -> list[list[tuple[int, int]]]:
        if any("delete" in t for t in texts):
            raise ValueError("no")
        return [[(t.find("please"), t.find("please") + 6)] if "please" in t else [] for t in texts]

    e = read_table(spark, folder, "defense_event")
    found = P.tagged(e, "event_no", "tool_name", "original_tool_output", tag)
    return found.select(F.col("key").alias("event_no"), F.transform("predicted", lambda s: s["start"]).alias("starts"), "success")


@query("SELECT item_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS tokens FROM eval_item WHERE text IS NOT NULL")
def counted_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each item by a counter that is loaded once per worker; here words."""
    counter = G.token_counter(lambda: lambda texts: [len(t.split()) for t in texts])
    return read_table(spark, folder, "eval_item").where("text is not null").select("item_id", counter("text").alias("tokens"))


@query("WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT contains(x, chr(96)) AND NOT contains(x, '#') AND NOT contains(x, '//')) AS k FROM documents WHERE text IS NOT NULL) SELECT doc_id, coalesce(k[1], '') AS line FROM l")
def first_code_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The first line of each text that is no comment or fence."""
    return read_table(spark, folder, "documents").where("text is not null").select("doc_id", X.first_code_line(F.col("text")).alias("line"))


@query("SELECT row_id, instruction AS back, CASE WHEN contains(instruction, ' the ') THEN rtrim(left(instruction, strpos(instruction, ' the ') - 1)) ELSE instruction END AS cut FROM tagger_record WHERE regexp_full_match(instruction, '[ -~]*') AND instruction = trim(instruction, ' ')")
def fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Instructions escaped for JSON and back, and cut at a marker."""
    r = read_table(spark, folder, "tagger_record").where(F.col("instruction").rlike("^[ -~]*$") & (F.trim("instruction") == F.col("instruction")))
    return r.select("row_id", X.unescape_json(X.escape_json(F.col("instruction"))).alias("back"), X.cut_at(F.col("instruction"), [" the "]).alias("cut"))


@query(
    """
    WITH f AS (SELECT item_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS t, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS a, list_distinct(regexp_extract_all(lower(benchmark || ' ' || split || ' the a of'), '[a-z0-9_]+')) AS b, benchmark FROM eval_item WHERE text IS NOT NULL)
    SELECT item_id, CASE WHEN length(t) > 200 THEN left(t, 197) || '...' ELSE t END AS short, len(list_filter(a, lambda x: list_contains(b, x))) AS shared, true AS same FROM f"""
)
def short_views(spark: SparkSession, folder: str) -> DataFrame:
    """Items squeezed and shortened, tokens they share with their labels, and an equality without case."""
    i = read_table(spark, folder, "eval_item").where("text is not null")
    return i.select("item_id", X.shortened(F.col("text")).alias("short"), X.token_overlap(F.col("text"), F.concat_ws(" ", "benchmark", "split", F.lit("the a of"))).cast("long").alias("shared"), X.same_text(F.concat(F.lit(" "), F.upper("benchmark")), F.col("benchmark")).alias("same"))


@query("SELECT case_id, CASE case_id % 4 WHEN 3 THEN NULL WHEN 2 THEN evaluation_timestamp::DATE::TIMESTAMP WHEN 1 THEN date_trunc('minute', evaluation_timestamp) ELSE date_trunc('second', evaluation_timestamp) END AS at FROM trace_case")
def parsed_times(spark: SparkSession, folder: str) -> DataFrame:
    """Times in several forms, and a text that is none."""
    t, k = F.col("evaluation_timestamp"), F.col("case_id") % 4
    said = F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format(t, "dd.MM.yyyy HH:mm")).when(k == 2, F.date_format(t, "yyyy-MM-dd")).otherwise(F.lit("next week"))
    return read_table(spark, folder, "trace_case").select("case_id", X.parsed_time(said).cast("timestamp_ntz").alias("at"))
