"""Overlap audit, leaks, first-wins selections, quotas and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detrand import uniform
from ..functions.text import most_repeated_run, normalise, overlong_word
from ..operators import audit as A
from ..shared import read_table
from .registry import SQL_SPACE, query

#: The SQL form of ``normalise``.
SQL_NORMALISE = "lower(regexp_replace(regexp_replace(<x>, '" + SQL_SPACE + "+', ' ', 'g'), '^ | $', '', 'g'))"
SQL_UNIFORM = "(('0x' || substr(md5(concat_ws('|', {key}, '{purpose}', '7')), 1, 8))::BIGINT / 4294967296.0)"


def _n(x: str) -> str:
    return SQL_NORMALISE.replace("<x>", x)


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    r = read_table(spark, folder, "tagger_record")
    split = F.lower(F.trim("split"))
    return r.where(split.endswith("_test")).withColumn("s", split), r.where(split == "train")


_SQL_SIDES = """
    WITH test AS (SELECT *, lower(trim(split, ' ')) AS s FROM tagger_record WHERE ends_with(lower(trim(split, ' ')), '_test')),
    train AS (SELECT * FROM tagger_record WHERE lower(trim(split, ' ')) = 'train')
"""


@query(_SQL_SIDES + f", known AS (SELECT DISTINCT {_n('injection')} AS k FROM train WHERE injection IS NOT NULL) SELECT s AS split, count(*) AS n, count(k) AS exact FROM test LEFT JOIN known ON k = {_n('injection')} WHERE injection <> '' GROUP BY s")
def contamination_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Test injections that stand in train after normalisation, per split."""
    test, train = _sides(spark, folder)
    rows = A.exact_overlap(test.where("injection <> ''"), "injection", train, "injection")
    return rows.groupBy(F.col("s").alias("split")).agg(F.count("*").alias("n"), F.count_if("in_train").alias("exact"))


@query(
    _SQL_SIDES
    + f""", tw AS (SELECT row_id, s, list_filter(string_split({_n('clean_data')}, ' '), lambda w: w <> '') AS w, {_n('clean_data')} AS k FROM test),
    rw AS (SELECT list_filter(string_split({_n('clean_data')}, ' '), lambda w: w <> '') AS w FROM train),
    grams AS (SELECT DISTINCT row_id, s, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM tw),
    known AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM rw),
    f AS (SELECT row_id, s, count(known.g) / count(grams.g) AS fraction FROM grams LEFT JOIN known USING (g) GROUP BY ALL),
    exact AS (SELECT DISTINCT {_n('clean_data')} AS k FROM train WHERE clean_data IS NOT NULL)
    SELECT tw.s AS split, count(*) AS n, count(exact.k) AS exact, count(*) FILTER (fraction > 0) AS any_overlap, count(*) FILTER (fraction >= 0.5) AS half_overlap,
           round(avg(fraction) * 100, 6) AS mean_percent, round(max(fraction) * 100, 6) AS max_percent
    FROM tw LEFT JOIN f USING (row_id) LEFT JOIN exact ON exact.k = tw.k GROUP BY tw.s"""
)
def contamination_shingles(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap audit of clean texts: exact copies and shares of runs of eight words that stand in train, per test split."""
    test, train = _sides(spark, folder)
    exact = A.exact_overlap(test.select("row_id", "s", "clean_data"), "clean_data", train, "clean_data")
    shares = A.shingle_overlap(test, "row_id", "clean_data", train, "clean_data").select(F.col("id").alias("row_id"), "fraction")
    return A.overlap_summary(exact.join(shares, "row_id", "left").withColumnRenamed("s", "split"), ["split"])


@query(_SQL_SIDES + "SELECT s AS split, count(DISTINCT base_id) AS bases FROM test WHERE base_id IN (SELECT base_id FROM train WHERE base_id IS NOT NULL) GROUP BY s")
def base_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Bases of a test split that train has, too."""
    test, train = _sides(spark, folder)
    return test.join(train.select("base_id").distinct(), "base_id", "left_semi").groupBy(F.col("s").alias("split")).agg(F.count_distinct("base_id").alias("bases"))


@query(
    """
    WITH p AS (SELECT DISTINCT substr(injection, 1, 40) AS p FROM tagger_record WHERE length(injection) >= 40)
    SELECT source_name, count(*) AS records, count(*) FILTER (coalesce(length(injection) > 0 AND contains(clean_data, injection), false) OR EXISTS (SELECT 1 FROM p WHERE contains(clean_data, p.p))) AS leaking
    FROM tagger_record GROUP BY source_name"""
)
def leak_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Clean texts that hold their own injection or the beginning of any injection, per source."""
    r = read_table(spark, folder, "tagger_record").select("row_id", "source_name", "clean_data", "injection")
    return A.leaky(r, "clean_data", "injection").groupBy("source_name").agg(F.count("*").alias("records"), F.count_if("leaks").alias("leaking"))


@query(
    """
    SELECT base_id, row_id, length(original_data) AS n FROM tagger_record WHERE base_id IS NOT NULL AND original_data <> ''
    QUALIFY row_number() OVER (PARTITION BY base_id ORDER BY row_id) = 1"""
)
def source_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The first non-empty text of each base."""
    r = read_table(spark, folder, "tagger_record").where("base_id is not null and original_data <> ''")
    return A.first_per(r, ["base_id"], [F.col("row_id")]).select("base_id", "row_id", F.length("original_data").alias("n"))


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY {_n('text')}")
def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first document of each normalised text and the number of its copies."""
    d = read_table(spark, folder, "documents").where("text is not null")
    return d.groupBy(F.md5(normalise(F.col("text"))).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


@query(
    f"""
    WITH k AS (SELECT doc_id, coalesce(source, '') AS source, {SQL_UNIFORM.format(key='doc_id', purpose='quota')} AS u FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS available FROM k)
    SELECT source, doc_id, rank, available FROM r WHERE rank <= 8"""
)
def quota_per_source(spark: SparkSession, folder: str) -> DataFrame:
    """Eight random documents of each source, with the number it has."""
    d = read_table(spark, folder, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return A.quota(d, ["source"], [uniform(F.col("doc_id"), "quota"), F.col("doc_id")], 8).select("source", "doc_id", "rank", "available")


@query("SELECT id, count(*) AS n, min(row_id) AS first_row, max_by(row_id, loaded_at) AS latest_row FROM tagger_record WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1 AND count(DISTINCT loaded_at) = count(*)")
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Re-delivered records: ids with several rows, the first row and the one loaded last."""
    r = read_table(spark, folder, "tagger_record").where("id is not null")
    found = r.groupBy("id").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"), F.max_by("row_id", "loaded_at").alias("latest_row"), F.count_distinct("loaded_at").alias("times"))
    return found.where("n > 1 and times = n").drop("times")


@query(
    """
    SELECT regexp_replace(id, '-(ipi|attacked)$', '') || '-clean' AS id, md5(clean_data) AS text_md5, count(*) AS n FROM tagger_record
    WHERE id IS NOT NULL AND attack_type IN ('Naive', 'Ignore', 'Completion', 'IndirectAgentic') GROUP BY ALL"""
)
def clean_counterparts(spark: SparkSession, folder: str) -> DataFrame:
    """Clean forms of the attacked records."""
    r = read_table(spark, folder, "tagger_record").where("id is not null and attack_type in ('Naive', 'Ignore', 'Completion', 'IndirectAgentic')")
    return A.clean_counterpart(r).groupBy("id", F.md5("attacked_data").alias("text_md5")).agg(F.count("*").alias("n"))


_SQL_PAIRS = """
    WITH p AS (SELECT source_pair_id, count(*) FILTER (NOT is_injection) AS benign, count(*) FILTER (is_injection) AS injected, min(tool_output) FILTER (NOT is_injection) AS b, min(tool_output) FILTER (is_injection) AS i,
               min(injection_text) FILTER (is_injection) AS t FROM sanitizer_sample GROUP BY source_pair_id)
"""


@query(_SQL_PAIRS + "SELECT source_pair_id, benign, injected, benign = 1 AND injected = 1 AS proper, benign = 1 AND injected = 1 AND coalesce(replace(i, t, '') = b, false) AS removable FROM p")
def pair_check(spark: SparkSession, folder: str) -> DataFrame:
    """Benign and injected halves of each pair, and whether removing the injection gives the benign text."""
    s = read_table(spark, folder, "sanitizer_sample")
    return A.paired(s, ["source_pair_id"], "is_injection", "tool_output", "injection_text").select("source_pair_id", "benign", "injected", "proper", "removable")


@query(
    """
    SELECT attack_type, decoy, count(*) AS n, count(*) FILTER (is_injection) AS injected, count(DISTINCT tool_name) AS tools, count(DISTINCT user_instruction) AS instructions
    FROM sanitizer_sample GROUP BY attack_type, decoy"""
)
def pair_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Samples, tools and instructions by attack type and decoy."""
    s = read_table(spark, folder, "sanitizer_sample")
    return s.groupBy("attack_type", "decoy").agg(F.count("*").alias("n"), F.count_if("is_injection").alias("injected"), F.count_distinct("tool_name").alias("tools"), F.count_distinct("user_instruction").alias("instructions"))


@query("SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]{50,}'), lambda w: NOT contains(w, 'http'))) > 0")
def overlong_words(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a word of fifty characters or more that is no address."""
    return read_table(spark, folder, "documents").where(overlong_word(F.col("text"))).select("doc_id")


@query(
    f"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SQL_SPACE}+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM w),
    c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL)
    SELECT doc_id, max(n)::INT AS times FROM c GROUP BY doc_id HAVING max(n) >= 2"""
)
def repeated_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which a run of eight words repeats, with the largest number of times."""
    d = read_table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", most_repeated_run(F.col("text"), 8).alias("times")).where("times >= 2")


@query("SELECT count(*) FILTER (NOT coalesce(contains(clean_data, injection) AND length(injection) > 0, false) AND NOT coalesce(contains(clean_data, '{'), false)) AS written, count(*) FILTER (coalesce(contains(clean_data, injection) AND length(injection) > 0, false)) AS leaky, count(*) FILTER (NOT coalesce(contains(clean_data, injection) AND length(injection) > 0, false) AND coalesce(contains(clean_data, '{'), false)) AS marked FROM tagger_record")
def conversion_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many records a conversion writes, and why it skips others."""
    r = read_table(spark, folder, "tagger_record")
    own = r.withColumn("leaks", F.coalesce((F.length("injection") > 0) & F.col("clean_data").contains(F.col("injection")), F.lit(False)))
    return A.converted(own, "leaks", F.col("clean_data").contains("{"))[1]


@query("SELECT row_id, CASE WHEN k > 1 THEN instruction || '_' || k ELSE instruction END AS instruction FROM (SELECT row_id, instruction, row_number() OVER (PARTITION BY instruction ORDER BY row_id) AS k FROM tagger_record WHERE instruction IS NOT NULL)")
def unique_instructions(spark: SparkSession, folder: str) -> DataFrame:
    """Instructions made unique by a number."""
    return A.numbered_repeats(read_table(spark, folder, "tagger_record").where("instruction is not null").select("row_id", "instruction"), "instruction", [F.col("row_id")])


@query("SELECT tool_name, id, available FROM (SELECT tool_name, id, count(*) OVER (PARTITION BY tool_name) AS available, row_number() OVER (PARTITION BY tool_name ORDER BY id) AS k FROM (SELECT DISTINCT tool_name, id FROM sanitizer_sample WHERE tool_name IS NOT NULL)) WHERE k <= 1")
def strict_quota(spark: SparkSession, folder: str) -> DataFrame:
    """The first sample of each tool, of which every one has enough (the quota is the feature)."""
    s = read_table(spark, folder, "sanitizer_sample").where("tool_name is not null").select("tool_name", "id").distinct()
    return A.quota(s, ["tool_name"], [F.col("id")], 1, strict=True).select("tool_name", "id", "available")
