"""Sources and sinks: what is written is read back and has to be the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TAGGER_RECORD
from ..shared import read_table, scratch
from ..sources import records as R
from .registry import query

_SQL_TEXTS = "row_id::VARCHAR AS id, base_id, attacked_data, injection, len(drop_spans) AS spans FROM tagger_record"


@query(f"SELECT {_SQL_TEXTS}")
def jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Records as JSON lines and back, in all scripts and with nulls."""
    at = scratch(spark, "jsonl")
    R.write_jsonl(read_table(spark, folder, "tagger_record").select(F.col("row_id").cast("string").alias("id"), "base_id", "attacked_data", "injection", "drop_spans"), at)
    back = R.read_jsonl(spark, at, TAGGER_RECORD)
    return back.where("_corrupt_record is null").select("id", "base_id", "attacked_data", "injection", F.when(F.col("drop_spans").isNotNull(), F.size("drop_spans")).cast("long").alias("spans"))


@query("SELECT count(*) AS lines, count(*) FILTER (doc_id % 10 = 0) AS broken FROM documents WHERE doc_id % 7 <> 0")
def jsonl_with_broken_lines(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines with blank and malformed ones: blank ones are skipped, malformed ones counted."""
    at = scratch(spark, "broken")
    line = F.when(F.col("doc_id") % 7 == 0, F.lit("")).when(F.col("doc_id") % 10 == 0, F.lit('{"id": ')).otherwise(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"))))
    read_table(spark, folder, "documents").select(line.alias("value")).write.text(at)
    back = R.read_jsonl(spark, at, "id string")
    return back.agg(F.count("*").alias("lines"), (F.count("*") - F.count("id")).alias("broken"))


@query("SELECT suite_name, attack_type, count(*) AS n FROM trace_case GROUP BY ALL")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A grouped result as CSV and back."""
    at = scratch(spark, "csv")
    R.write_grouped_csv(read_table(spark, folder, "trace_case").groupBy("suite_name", "attack_type").agg(F.count("*").alias("n")), at)
    return R.read_csv(spark, at, "suite_name string, attack_type string, n long")


@query("SELECT suite_name, count(*) AS n, round(avg(duration), 3) AS seconds FROM trace_case GROUP BY ALL")
def pretty_json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A small result as an indented JSON array and back."""
    at = scratch(spark, "pretty")
    R.write_pretty_json(read_table(spark, folder, "trace_case").groupBy("suite_name").agg(F.count("*").alias("n"), F.round(F.avg("duration"), 3).alias("seconds")), at)
    return R.read_json_array(spark, at, "suite_name string, n long, seconds double")


@query("SELECT suite_name, count(*) AS n FROM trace_case GROUP BY ALL")
def published_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table published twice at one place."""
    at = scratch(spark, "published")
    c = read_table(spark, folder, "trace_case")
    R.publish(c.groupBy("suite_name").agg(F.lit(0).cast("long").alias("n")), at)
    R.publish(c.groupBy("suite_name").agg(F.count("*").alias("n")), at)
    return spark.read.parquet(at)


@query("SELECT 0 AS row, 0 AS col, 'suite_name' AS text UNION ALL SELECT 0, 1, 'n' UNION ALL SELECT row_number() OVER (ORDER BY suite_name)::INT, 0, suite_name FROM (SELECT DISTINCT suite_name FROM trace_case) UNION ALL SELECT row_number() OVER (ORDER BY suite_name)::INT, 1, n::VARCHAR FROM (SELECT suite_name, count(*) AS n FROM trace_case GROUP BY 1)")
def html_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A small result as an HTML table and its cells."""
    table = read_table(spark, folder, "trace_case").groupBy("suite_name").agg(F.count("*").alias("n")).orderBy("suite_name")
    pages = spark.createDataFrame([(R.html(table, "results"),)], "page string")
    return R.read_html_table(pages, "page", "results").select("row", "col", "text")


@query("SELECT suite_name, m AS metric, CASE m WHEN 'n' THEN n::DOUBLE WHEN 'share' THEN NULL ELSE round(p, 1) END AS value FROM (SELECT suite_name, count(*) AS n, 100 * avg(utility::INT) AS p FROM trace_case GROUP BY 1), (VALUES ('n'), ('percent'), ('share')) v(m)")
def long_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Wide text cells of a table as long numbers; what is no number is null."""
    wide = read_table(spark, folder, "trace_case").groupBy("suite_name").agg(F.count("*").cast("string").alias("n"), F.concat(F.round(100 * F.avg(F.col("utility").cast("int")), 1).cast("string"), F.lit(" %")).alias("percent"), F.lit("n/a").alias("share"))
    trimmed = wide.withColumn("percent", F.regexp_replace("percent", " %$", "%"))
    return R.long_cells(trimmed, ["suite_name"], ["n", "percent", "share"])


@query("SELECT pipeline_name, suite_name, user_task_id, attack_type, injection_task_id, utility, count(*) AS runs FROM trace_case WHERE attack_type IS NOT NULL GROUP BY ALL HAVING pipeline_name = 'model-a_none'")
def trace_files(spark: SparkSession, folder: str) -> DataFrame:
    """Traces of a pipeline's attacked cases written as one JSON file each, and read with the keys of their paths."""
    at = scratch(spark, "traces")
    c = read_table(spark, folder, "trace_case").where("attack_type is not null and pipeline_name = 'model-a_none'")
    parts = ["pipeline_name", "suite_name", "user_task_id", "attack_type"]
    body = F.to_json(F.struct("suite_name", "pipeline_name", "user_task_id", "injection_task_id", "attack_type", "utility", "security"))
    files = c.select(*(F.col(p).alias(f"k{k}") for k, p in enumerate(parts)), "injection_task_id", "case_id", body.alias("value"))
    jvm = spark.sparkContext._jvm
    for row in files.toLocalIterator():
        place = "/".join(row[f"k{k}"] for k in range(4))
        jvm.org.apache.hadoop.fs.Path(f"{at}/{row.case_id}").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jvm.org.apache.hadoop.fs.Path(f"{at}/{row.case_id}/{place}"))
        R.replace_file(spark, f"{at}/{row.case_id}/{place}/{row.injection_task_id}.json", row.value)
    t = R.read_traces(spark, at).where("_corrupt_record is null")
    keys = ["path_pipeline", "path_suite", "path_user_task", "path_attack", "path_injection_task"]
    names = ["pipeline_name", "suite_name", "user_task_id", "attack_type", "injection_task_id"]
    return t.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "utility").groupBy(*names, "utility").agg(F.count("*").alias("runs"))


@query("SELECT s AS name, count(*) AS lines FROM documents JOIN (VALUES ('chat_log'), ('email_body')) v(s) ON source = s GROUP BY 1")
def copied_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files copied where they are there, with the number of their lines; one of three isn't."""
    at, to = scratch(spark, "sources"), scratch(spark, "copies")
    d = read_table(spark, folder, "documents")
    for s in ("chat_log", "email_body"):
        d.where(F.col("source") == s).select(F.col("doc_id").cast("string").alias("value")).write.text(f"{at}/{s}")
    return R.copied_lines(spark, {s: f"{at}/{s}" for s in ("chat_log", "email_body", "missing")}, to)


@query("SELECT suite_name, sha256(string_agg(case_id::VARCHAR, chr(10) ORDER BY case_id) || chr(10)) AS sha256 FROM trace_case GROUP BY 1")
def file_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of files below a folder, each in a folder of its own."""
    at = scratch(spark, "files")
    read_table(spark, folder, "trace_case").repartition(1).sortWithinPartitions("suite_name", "case_id").select("suite_name", F.col("case_id").cast("string").alias("value")).write.partitionBy("suite_name").text(at)
    files = R.fingerprint(spark, at).where("path like '%.txt'")
    return files.select(F.regexp_extract("path", "suite_name=([^/]*)/", 1).alias("suite_name"), "sha256")
