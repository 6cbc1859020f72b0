"""Generated records and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detrand import uniform, weighted
from ..functions.spans import remove_spans, span_texts
from ..operators import generate as G
from ..shared import read_table
from .audit_q import SQL_UNIFORM
from .registry import SQL_SPACE, query


def _u(key: str, purpose: str) -> str:
    return SQL_UNIFORM.format(key=key, purpose=purpose)


def _built(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "eval_item").select((F.col("item_id") - 1).alias("no"), "text")
    return G.attacked_records(read_table(spark, folder, "documents"), "doc_id", "text", items, "no", "text", ["Clean", "Naive", "Ignore", "Completion"])


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SQL_BUILT = f"""
    WITH each AS (SELECT doc_id AS key, text AS original_data, unnest(['Clean', 'Naive', 'Ignore', 'Completion']) AS attack_type FROM documents WHERE text IS NOT NULL),
    keyed AS (SELECT *, key || '/' || attack_type AS k FROM each),
    drawn AS (
        SELECT k.*, CASE attack_type WHEN 'Clean' THEN '' WHEN 'Ignore' THEN {_list(G.IGNORE_LINES)}[(floor({_u('k', 'ignore')} * {len(G.IGNORE_LINES)}))::INT + 1] || e.text
               WHEN 'Completion' THEN {_list([a for a, _ in G.COMPLETION_FRAMES])}[(floor({_u('k', 'frame')} * {len(G.COMPLETION_FRAMES)}))::INT + 1] || e.text ELSE e.text END AS injection,
               {_u('k', 'cut')} AS uc, {_u('k', 'position')} AS up, {_u('k', 'offset')} AS uo
        FROM keyed k JOIN eval_item e ON e.item_id - 1 = floor({_u('k', 'injection')} * (SELECT count(*) FROM eval_item))::INT),
    cut AS (
        SELECT *, CASE WHEN attack_type = 'Clean' THEN 'none' WHEN uc < 0.15 THEN 'empty' WHEN uc < 0.25 THEN 'two_thirds' WHEN uc < 0.35 THEN 'half' ELSE 'none' END AS cut_type,
               CASE WHEN attack_type = 'Clean' THEN 'none' WHEN up < 0.2 THEN 'prepend' WHEN up < 0.8 THEN 'middle' ELSE 'append' END AS position FROM drawn),
    clean AS (
        SELECT *, CASE cut_type WHEN 'empty' THEN '' WHEN 'two_thirds' THEN regexp_replace(substr(original_data, 1, floor(length(original_data) * (2 / 3))::INT), '{SQL_SPACE}+$', '')
               WHEN 'half' THEN regexp_replace(substr(original_data, 1, floor(length(original_data) * 0.5)::INT), '{SQL_SPACE}+$', '') ELSE original_data END AS clean_data FROM cut),
    pieced AS (
        SELECT *, regexp_extract_all(clean_data, '{SQL_SPACE}*{SQL_SPACE.replace('[', '[^', 1)}+') AS pieces FROM clean),
    placed AS (
        SELECT *, CASE WHEN position = 'prepend' THEN 0 WHEN position = 'append' OR len(pieces) = 0 THEN length(clean_data)
               ELSE list_sum(list_transform(pieces[1:floor(uo * len(pieces))::INT + 1], lambda p: length(p))) END::INT AS pos FROM pieced),
    parts AS (SELECT *, substr(clean_data, 1, pos) AS l, substr(clean_data, pos + 1) AS r FROM placed),
    built AS (
        SELECT *, CASE WHEN injection = '' THEN '' ELSE
            CASE WHEN l = '' OR regexp_matches(right(l, 1), '{SQL_SPACE}') OR regexp_matches(left(injection, 1), '{SQL_SPACE}') THEN '' ELSE ' ' END || injection ||
            CASE WHEN r = '' OR regexp_matches(left(r, 1), '{SQL_SPACE}') OR regexp_matches(right(injection, 1), '{SQL_SPACE}') THEN '' ELSE ' ' END END AS inserted_text FROM parts)
"""


@query(_SQL_BUILT + "SELECT key, attack_type, position, cut_type, md5(clean_data) AS clean_md5, md5(l || inserted_text || r) AS attacked_md5, CASE WHEN injection <> '' THEN pos END AS start, CASE WHEN injection <> '' THEN pos + length(inserted_text) END AS \"end\" FROM built")
def inject_records(spark: SparkSession, folder: str) -> DataFrame:
    """Four variants of every document: cut, with an evaluation text inserted at a drawn place, and the exact span of the insertion."""
    b = _built(spark, folder)
    return b.select("key", "attack_type", "position", "cut_type", F.md5("clean_data").alias("clean_md5"), F.md5("attacked_data").alias("attacked_md5"), F.get("drop_spans", F.lit(0))["start"].alias("start"), F.get("drop_spans", F.lit(0))["end"].alias("end"))


@query("SELECT t.attack_type, count(*) AS records, 0::BIGINT AS broken FROM documents, (SELECT unnest(['Clean', 'Naive', 'Ignore', 'Completion']) AS attack_type) t WHERE text IS NOT NULL GROUP BY ALL")
def inject_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Built records whose span isn't the inserted text, or whose text without the span isn't the clean text: none."""
    b = _built(spark, folder)
    ok = (remove_spans(F.col("attacked_data"), F.col("drop_spans")) == F.col("clean_data")) & (F.array_join(span_texts(F.col("attacked_data"), F.col("drop_spans")), "") == F.col("inserted_text")) & F.col("inserted_text").contains(F.col("injection"))
    return b.groupBy("attack_type").agg(F.count("*").alias("records"), F.count_if(~ok).alias("broken"))


@query("SELECT t.envelope_format, count(*) > 0 AS used, 0::BIGINT AS broken FROM documents, (SELECT unnest(['json', 'xml', 'kvlog', 'markdown', 'email', 'yaml']) AS envelope_format) t GROUP BY ALL")
def envelope_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Wrapped records whose moved spans don't hold the escaped insertion: none."""
    b = _built(spark, folder).where("attack_type <> 'Clean'").withColumn("k", F.concat_ws("/", "key", "attack_type"))
    format_ = weighted(F.col("k"), "format", dict.fromkeys(G.ENVELOPES, 1))
    w = G.wrap_in_envelope(b, "k", format_)
    ok = (remove_spans(F.col("attacked_data"), F.col("drop_spans")) == F.col("clean_data")) & (F.array_join(span_texts(F.col("attacked_data"), F.col("drop_spans")), "") == G.escape_for(F.col("envelope_format"), F.col("inserted_text")))
    # After a line break the YAML indent of the insertion's first character belongs to the text before it.
    return w.groupBy("envelope_format").agg((F.count("*") > 0).alias("used"), F.count_if(~ok).alias("broken"))


@query(f"SELECT CASE WHEN {_u('row_id', 'blank')} < 0.3 THEN '' ELSE instruction END AS instruction, count(*) AS n FROM tagger_record GROUP BY 1")
def instruction_dropout(spark: SparkSession, folder: str) -> DataFrame:
    """Instructions after emptying a random three in ten."""
    r = read_table(spark, folder, "tagger_record").select("row_id", "instruction")
    return G.blank_instructions(r, "row_id", "instruction", 0.3).groupBy("instruction").agg(F.count("*").alias("n"))


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_u('doc_id', 'split')}, doc_id) AS k FROM documents) SELECT doc_id, CASE WHEN k <= 100 THEN 'validation' ELSE 'train' END AS part FROM r")
def seeded_split(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred random documents for validation, the rest for training."""
    return G.split_by_seed(read_table(spark, folder, "documents").select("doc_id"), "doc_id", 100)


@query(f"SELECT floor({_u('row_id', 'check')} * 10)::INT AS tenth, count(*) AS n FROM tagger_record GROUP BY 1")
def seeded_uniform(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by tenths of a seeded draw."""
    return read_table(spark, folder, "tagger_record").groupBy(F.floor(uniform(F.col("row_id"), "check") * 10).cast("int").alias("tenth")).agg(F.count("*").alias("n"))
