"""Records built from texts: prompts, delimiters, wrappers, hard negatives, template tasks and records found in nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evals as V
from ..functions.spans import remove_spans, spans_fit
from ..operators import builders as B
from ..shared import read_table
from .registry import SQL_SPACE, query

_S = SQL_SPACE


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _draw_sql(key: str, purpose: str) -> str:
    return f"(('0x' || substr(md5({key} || '|{purpose}|7'), 1, 8))::BIGINT / 4294967296.0)"


def _pick_sql(key: str, purpose: str, options: list[str]) -> str:
    listed = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"([{listed}])[floor({_draw_sql(key, purpose)} * {len(options)})::INT + 1]"


@query(
    f"""
    WITH t AS (SELECT row_id, {_strip_sql("coalesce(instruction, '')")} AS i, {_strip_sql("coalesce(injection, '')")} AS d FROM tagger_record),
    s AS (SELECT *, lower(i[1]) || substr(i, 2) || CASE WHEN d = '' THEN '' ELSE ' ' || d END AS said FROM t)
    SELECT row_id, CASE WHEN i = '' THEN d WHEN ends_with(i, '?') THEN 'answer the following question. ' || i || CASE WHEN d = '' THEN '' ELSE ' ' || d END WHEN right(said, 1) IN ('.', '!', '?') THEN said ELSE said || '.' END AS prompt FROM s"""
)
def injected_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The task that an instruction and its input ask for, as an injection says it."""
    return read_table(spark, folder, "tagger_record").select("row_id", B.injected_prompt(F.col("instruction"), F.col("injection")).alias("prompt"))


@query(
    "WITH w AS (SELECT row_id, injection, " + _pick_sql("row_id", "wrapper", B.WRAPPERS["train"]).replace("\n", "' || chr(10) || '") + " AS a, " + _pick_sql("row_id", "wrapper", B.WRAPPERS["test"]).replace("\n", "' || chr(10) || '")
    + " AS b FROM tagger_record) SELECT row_id, replace(a, '{payload}', injection) AS train, replace(b, '{payload}', injection) AS test FROM w"
)
def wrapped_injections(spark: SparkSession, folder: str) -> DataFrame:
    """Injections in drawn wrappers of training and of tests."""
    of = lambda pool: B.wrapped_injection(F.col("injection"), F.col("row_id"), pool).alias(pool)
    return read_table(spark, folder, "tagger_record").select("row_id", of("train"), of("test"))


@query("SELECT doc_id, " + _pick_sql("doc_id", "negative", B.HARD_NEGATIVES) + " AS sentence, true AS rest_is_kept, true AS at_a_word FROM documents WHERE text IS NOT NULL")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with a harmless request put in: the request, whether the text is the old one without it, and whether it stands before a word or at the end."""
    d = read_table(spark, folder, "documents").where("text is not null")
    put = d.select("doc_id", "text", B.with_hard_negative(F.col("text"), F.col("doc_id")).alias("new"))
    sentence = F.element_at(F.filter(F.array(*map(F.lit, B.HARD_NEGATIVES)), lambda s: F.col("new").contains(s) & ~F.col("text").contains(s)), 1)
    at = F.instr("new", F.col("sentence"))
    before, after = F.substring("new", F.lit(1), at - 1), F.substring("new", at + F.length("sentence"), F.length("new"))
    lone = F.regexp_replace(F.concat(before, after), r"(?U)\s+", "") == F.regexp_replace("text", r"(?U)\s+", "")
    return put.withColumn("sentence", sentence).select("doc_id", "sentence", lone.alias("rest_is_kept"), ((after == "") | after.rlike(r"(?U)^\s\S") | before.rlike(r"(?U)\s$") | (before == "")).alias("at_a_word"))


_GROUPS = [("### instruction", "### input", "### response"), ("<q>", "<d>", "<a>")]


def _delimiter_sql(g: int, kind: str) -> str:
    roles = B.ROLES["train"]["user" if kind in ("inst", "inpt") else "asst"]
    name = f"({_pick_sql('k', f'{g}-{kind}-role', roles)} || {_pick_sql('k', f'{g}-{kind}-name', B.DELIMITERS['train'][kind])})"
    u = _draw_sql("k", f"{g}-{kind}-case")
    return f"replace({_pick_sql('k', 'mark', B.MARKS['train'])} || ':', '{{s}}', CASE WHEN {u} < 1 / 3 THEN upper({name}) WHEN {u} < 2 / 3 THEN lower({name}) ELSE {name} END)"


def _delimited_sql() -> str:
    x = "'### instruction do ### input ' || k || ' ### response <q> why <d> x <a> y'"
    for g, group in enumerate(_GROUPS):
        for old, kind in zip(group, ("inst", "inpt", "resp"), strict=True):
            x = f"replace({x}, '{old}', {_delimiter_sql(g, kind)})"
    return x


@query(f"SELECT case_id, {_delimited_sql()} AS prompt FROM (SELECT case_id, case_id::VARCHAR AS k FROM trace_case)")
def other_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts with drawn delimiters in place of the usual ones."""
    text = F.concat(F.lit("### instruction do ### input "), F.col("case_id").cast("string"), F.lit(" ### response <q> why <d> x <a> y"))
    return read_table(spark, folder, "trace_case").select("case_id", B.other_delimiters(text, F.col("case_id"), _GROUPS).alias("prompt"))


_CATEGORIES = ["direct", "strategy", "agent_tool_output"]


def _positives(spark: SparkSession, folder: str) -> DataFrame:
    sources = read_table(spark, folder, "documents").where("text is not null").select("doc_id", "text", F.lit("Summarise the text.").alias("instruction"))
    category = F.element_at(F.array(*map(F.lit, _CATEGORIES)), (F.col("doc_id") % 3).cast("int") + 1)
    return B.positive_records(sources, "doc_id", "train", category)


_SQL_LONG = "list_sum(list_transform(list_sort([" + ", ".join(f"{{'u': {_draw_sql('k', f'context-{n}')}, 'n': {len(x)}}}" for n, x in enumerate(B.LONG_FRAGMENTS)) + "])[1:4], lambda s: s.n))"


@query(
    f"""
    WITH d AS (SELECT doc_id, {_strip_sql("text")} AS t, (['direct', 'strategy', 'agent_tool_output'])[(doc_id % 3) + 1] AS category, 'train/' || doc_id AS k FROM documents WHERE text IS NOT NULL),
    u AS (SELECT *, {_draw_sql("k", "p3-position")} AS u FROM d)
    SELECT 'train-p3-' || replace(category, '_', '-') || '-' || format('{{:06d}}', doc_id) AS id, 'p3-' || category || '-' || format('{{:06d}}', doc_id) AS base_id, CASE WHEN category = 'strategy' THEN 'Ignore' ELSE 'Naive' END AS attack_type,
           CASE WHEN u < 0.25 THEN 'prepend' WHEN u < 0.8 THEN 'middle' ELSE 'append' END AS position, true AS fits, true AS clean, true AS holds,
           CASE WHEN category = 'agent_tool_output' THEN {_pick_sql("k", "p3-format", ["json", "xml", "kvlog", "markdown", "email", "yaml"])} END AS envelope_format,
           CASE WHEN category = 'agent_tool_output' THEN NULL ELSE length(CASE WHEN t = '' THEN 'The file holds notes about daily work.' ELSE t END)
                + CASE WHEN category = 'direct' AND doc_id % 2 = 1 THEN 8 + {_SQL_LONG} ELSE 0 END END AS clean_length
    FROM u"""
)
def positive_records(spark: SparkSession, folder: str) -> DataFrame:
    """Attacked records of three categories: labels, and whether spans fit, leave the clean text and mark the injection."""
    r = _positives(spark, folder)
    s = F.col("drop_spans")[0]
    marked = F.substring("attacked_data", s["start"] + 1, s["end"] - s["start"])
    return r.select(
        "id", "base_id", "attack_type", "position", spans_fit(F.col("attacked_data"), F.col("drop_spans")).alias("fits"), (remove_spans(F.col("attacked_data"), F.col("drop_spans")) == F.col("clean_data")).alias("clean"),
        ((marked == F.col("inserted_text")) & F.col("inserted_text").contains(F.col("injection"))).alias("holds"), "envelope_format", F.when(F.col("envelope_format").isNull(), F.length("clean_data")).cast("long").alias("clean_length"),
    )


@query(
    f"""
    WITH d AS (SELECT doc_id, {_strip_sql("text")} AS t, 'train/' || doc_id || '/hard' AS k FROM documents WHERE text IS NOT NULL),
    s AS (SELECT *, list_transform(list_sort([{", ".join(f"{{'u': {_draw_sql('k', f'snippets-{n}')}, 'x': '{x}'}}" for n, x in enumerate(B.HARD_SNIPPETS))}])[1:2], lambda s: s.x) AS s, CASE WHEN t = '' THEN 'The file holds notes about business.' ELSE t END AS b FROM d)
    SELECT 'train-p3-clean-hard-negative-' || format('{{:06d}}', doc_id) AS id, CASE WHEN {_draw_sql("k", "snippets-at")} < 0.5 THEN b || chr(10) || chr(10) || s[1] || chr(10) || chr(10) || s[2] ELSE s[1] || chr(10) || chr(10) || b || chr(10) || chr(10) || s[2] END AS attacked_data, 0 AS spans FROM s"""
)
def hard_negative_records(spark: SparkSession, folder: str) -> DataFrame:
    """Clean records with two harmless requests in each."""
    sources = read_table(spark, folder, "documents").where("text is not null").select("doc_id", "text", F.lit("Summarise the text.").alias("instruction"))
    return B.hard_negative_records(sources, "doc_id", "train").select("id", "attacked_data", F.size("drop_spans").alias("spans"))


@query(
    """
    WITH t AS (SELECT row_id, attacked_data AS a, injection AS i FROM tagger_record WHERE length(injection) > 0 AND attacked_data IS NOT NULL AND contains(attacked_data, injection) AND NOT regexp_matches(attacked_data || injection, '[^ -~]|["\\\\]'))
    SELECT row_id, '{"id": ' || row_id || ', "body": "' || a || '"}' AS attacked_data, '{"id": ' || row_id || ', "body": "' || replace(a, i, '') || '"}' AS clean_data, len(string_split(a, i)) - 1 AS spans, 'middle' AS position FROM t"""
)
def nested_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records found in nested objects: the innermost object that holds the injection, with and without it."""
    r = read_table(spark, folder, "tagger_record").where(~F.concat("attacked_data", "injection").rlike(r'[^ -~]|["\\]') & (F.length("injection") > 0) & F.col("attacked_data").contains(F.col("injection")))
    inner = F.struct(F.col("row_id").alias("id"), F.col("attacked_data").alias("body"))
    environment = F.to_json(F.struct(F.lit("inbox").alias("name"), F.array(F.struct(F.lit("other").alias("body")).cast("struct<body:string>")).alias("first"), F.array(inner).alias("items")))
    found = r.select("row_id", B.nested_records()(environment, "injection").alias("n"))
    return found.select("row_id", "n.attacked_data", "n.clean_data", F.size("n.drop_spans").cast("long").alias("spans"), "n.position")


@query("SELECT case_id, string_agg(tool_name, chr(10) ORDER BY event_no) FILTER (event_no % 2 = 0 AND tool_name IS NOT NULL) AS said FROM defense_event GROUP BY case_id")
def user_turns(spark: SparkSession, folder: str) -> DataFrame:
    """What the user said in each conversation, joined; here every second message is theirs."""
    message = F.struct(F.col("event_no").alias("n"), F.when(F.col("event_no") % 2 == 0, "user").otherwise("tool").alias("role"), F.col("tool_name").alias("content"))
    chats = read_table(spark, folder, "defense_event").groupBy("case_id").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    said = B.user_instruction(F.col("messages"))
    return chats.select("case_id", F.when(said != "", said).alias("said"))


@query("SELECT row_id, list_extract(fit, 1).start::INT AS first, list_extract(fit, -1).\"end\"::INT AS last, CASE WHEN len(fit) = 0 THEN NULL WHEN list_extract(fit, 1).start = 0 THEN 'prepend' WHEN list_extract(fit, -1).\"end\" = length(attacked_data) THEN 'append' ELSE 'middle' END AS place FROM (SELECT *, list_sort(list_filter(drop_spans, lambda s: s.start >= 0 AND s.start < s.\"end\" AND s.\"end\" <= length(attacked_data))) AS fit FROM tagger_record WHERE drop_spans IS NOT NULL AND attacked_data IS NOT NULL)")
def edge_spans(spark: SparkSession, folder: str) -> DataFrame:
    """First start and last end of each record's spans, and the position they tell."""
    r = read_table(spark, folder, "tagger_record").where("drop_spans is not null and attacked_data is not null")
    fit = F.array_sort(F.filter("drop_spans", lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length("attacked_data"))))
    e = r.select("row_id", V.edge_spans(fit, F.length("attacked_data")).alias("e"))
    return e.select("row_id", F.col("e.first.start").alias("first"), F.col("e.last.end").alias("last"), F.col("e.position").alias("place"))
