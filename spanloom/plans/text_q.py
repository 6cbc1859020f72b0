"""Text, JSON and label functions over documents, items and events; length and group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.labels import MARKERS, label_score, parse_label
from ..operators import stats as ST
from ..shared import read_table
from .audit_q import SQL_NORMALISE
from .registry import SQL_SPACE, query


def _n(x: str) -> str:
    return SQL_NORMALISE.replace("<x>", x)


@query(f"SELECT doc_id, md5({_n('text')}) AS norm_md5, len(list_filter(regexp_split_to_array(text, '{SQL_SPACE}+'), lambda w: w <> ''))::INT AS words FROM documents")
def normalise_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised documents and their words."""
    return read_table(spark, folder, "documents").select("doc_id", F.md5(X.normalise(F.col("text"))).alias("norm_md5"), F.size(X.words(F.col("text"))).alias("words")).select("doc_id", "norm_md5", F.when(F.col("norm_md5").isNotNull(), F.col("words")).alias("words"))


@query("SELECT item_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM eval_item")
def slugs(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers made of item texts."""
    return read_table(spark, folder, "eval_item").select("item_id", X.slug(F.col("text")).alias("slug"))


@query("SELECT item_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?]+)( +|$)', '\\1|', 'g'), '\\|'), lambda s: trim(s)), lambda s: s <> '') AS s FROM eval_item".replace("SELECT item_id, list", "SELECT item_id, unnest(list").replace("s <> '') AS s", "s <> '')) AS sentence"))
def item_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of the items."""
    return read_table(spark, folder, "eval_item").select("item_id", F.explode(X.sentences(F.col("text"))).alias("sentence"))


@query(f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SQL_SPACE}+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, k::INT AS segment, md5(array_to_string(w[k * 100 + 1:k * 100 + 100], ' ')) AS text_md5 FROM w, unnest(range(0, (len(w) + 99) // 100)) AS t(k)")
def word_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in pieces of a hundred words."""
    d = read_table(spark, folder, "documents")
    return d.select("doc_id", F.posexplode(X.segments(F.col("text"), 100)).alias("segment", "text")).select("doc_id", "segment", F.md5("text").alias("text_md5"))


@query(
    """
    WITH p AS (SELECT source_pair_id, max(tool_output) FILTER (is_injection) AS i, max(tool_output) FILTER (NOT is_injection) AS b FROM sanitizer_sample GROUP BY 1),
    w AS (SELECT source_pair_id, <i> AS x, <b> AS y FROM p WHERE i IS NOT NULL AND b IS NOT NULL),
    c AS (SELECT source_pair_id, len(x) AS nx, len(y) AS ny, list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda a: a = t)), len(list_filter(y, lambda a: a = t))))) AS s FROM w)
    SELECT source_pair_id, round(CASE WHEN coalesce(s, 0) = 0 THEN 0 ELSE 2 * s / (nx + ny) END, 6) AS f1 FROM c""".replace("<i>", "<w>(i)").replace("<b>", "<w>(b)")
    .replace("<w>(i)", f"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(i), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '{SQL_SPACE}+'), lambda t: t <> '')")
    .replace("<w>(b)", f"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(b), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '{SQL_SPACE}+'), lambda t: t <> '')")
)
def qa_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Word F1 of the two halves of each pair."""
    s = read_table(spark, folder, "sanitizer_sample")
    p = s.groupBy("source_pair_id").agg(F.max(F.when(F.col("is_injection"), F.col("tool_output"))).alias("i"), F.max(F.when(~F.col("is_injection"), F.col("tool_output"))).alias("b")).where("i is not null and b is not null")
    return p.select("source_pair_id", F.round(X.qa_f1(F.col("i"), F.col("b")), 6).alias("f1"))


@query()
def rouge(spark: SparkSession, folder: str) -> DataFrame:
    """Longest-common-subsequence F of the two halves of each pair."""
    from ..operators.metrics import rouge_l

    s = read_table(spark, folder, "sanitizer_sample")
    p = s.groupBy("source_pair_id").agg(F.max(F.when(F.col("is_injection"), F.col("tool_output"))).alias("i"), F.max(F.when(~F.col("is_injection"), F.col("tool_output"))).alias("b")).where("i is not null and b is not null")
    return p.select("source_pair_id", F.round(rouge_l("i", "b"), 6).alias("rouge_l"))


_SQL_TASKS = {
    "equivalence": "CASE WHEN x = '' THEN -1 WHEN contains(x, 'not equivalent') OR contains(x, 'no') THEN 0 WHEN contains(x, 'equivalent') OR contains(x, 'yes') THEN 1 ELSE -1 END",
    "entailment": "CASE WHEN x = '' THEN -1 WHEN contains(x, 'not entail') OR contains(x, 'no') THEN 0 WHEN contains(x, 'entail') OR contains(x, 'yes') THEN 1 ELSE -1 END",
    "sentiment": "CASE WHEN x = '' THEN -1 WHEN contains(x, 'positive') THEN 1 WHEN contains(x, 'negative') THEN 0 ELSE -1 END",
    "spam": "CASE WHEN x = '' THEN -1 WHEN contains(x, 'not spam') THEN 0 WHEN contains(x, 'spam') THEN 1 ELSE -1 END",
    "hate": "CASE WHEN x = '' THEN -1 WHEN contains(x, 'not hateful') THEN 0 WHEN contains(x, 'hateful') THEN 1 ELSE -1 END",
}


@query("WITH t AS (SELECT lower(text) AS x FROM eval_item) " + " UNION ALL ".join(f"SELECT '{k}' AS task, {v}::INT AS label, count(*) AS n FROM t GROUP BY ALL" for k, v in _SQL_TASKS.items()))
def label_parsers(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that the parsers read from item texts, per task; -1 where there is none."""
    items = read_table(spark, folder, "eval_item")
    labels = F.array(*(F.struct(F.lit(task).alias("task"), parse_label(task, F.col("text")).alias("label")) for task in MARKERS))
    return items.select(F.explode(labels).alias("l")).groupBy("l.task", "l.label").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN contains(lower(attack_type), 'completion') THEN 1 WHEN contains(lower(attack_type), 'ignore') THEN 0 ELSE -1 END AS score, count(*) AS n FROM sanitizer_sample GROUP BY 1")
def ordered_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """First matching rule of an ordered list, tested by substring."""
    rules = [("completion", 1), ("ignore", 0)]
    return read_table(spark, folder, "sanitizer_sample").groupBy(label_score(F.col("attack_type"), rules, -1).alias("score")).agg(F.count("*").alias("n"))


@query("SELECT event_id, json_valid(props) AS valid, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Validity and a field of the events' JSON."""
    e = read_table(spark, folder, "events")
    return e.select("event_id", F.coalesce(X.is_json(F.col("props")), F.lit(False)).alias("valid"), F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT doc_id, json_extract_string(text, '$.tool') AS tool, json_array_length(text, '$.rows')::INT AS n_rows FROM documents WHERE starts_with(text, '{\"tool\"') AND json_valid(text)")
def tool_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are JSON tool outputs, with the tool and the number of rows."""
    d = read_table(spark, folder, "documents").where(F.col("text").startswith('{"tool"') & X.is_json(F.col("text")))
    v = F.parse_json("text")
    return d.select("doc_id", F.try_variant_get(v, "$.tool", "string").alias("tool"), F.size(F.try_variant_get(v, "$.rows", "array<variant>")).alias("n_rows"))


@query(
    """
    SELECT lower(trim(split, ' ')) AS split, count(length(attacked_data)) AS n, min(length(attacked_data))::INT AS least, round(avg(length(attacked_data)), 6) AS mean, round(quantile_cont(length(attacked_data), 0.5), 6) AS p50,
           round(quantile_cont(length(attacked_data), 0.9), 6) AS p90, round(quantile_cont(length(attacked_data), 0.95), 6) AS p95, round(quantile_cont(length(attacked_data), 0.99), 6) AS p99, max(length(attacked_data))::INT AS largest,
           count(*) FILTER (length(attacked_data) > 512) AS over_512, count(*) FILTER (length(attacked_data) > 1024) AS over_1024, count(*) FILTER (length(attacked_data) > 4096) AS over_4096
    FROM tagger_record GROUP BY 1"""
)
def length_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of attacked texts per split: percentiles and how many lie over limits."""
    r = read_table(spark, folder, "tagger_record").select(F.lower(F.trim("split")).alias("split"), F.length("attacked_data").alias("len"))
    return ST.length_summary(r, ["split"], F.col("len"), [512, 1024, 4096])


@query(
    """
    SELECT split, attack_type, position, cut_type, count(*) AS n, GROUPING(split, attack_type, position, cut_type)::INT AS level FROM tagger_record
    GROUP BY GROUPING SETS ((split, attack_type, position), (split, cut_type), (attack_type))"""
)
def nested_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Records by several combinations of labels in one pass."""
    r = read_table(spark, folder, "tagger_record")
    keys = ["split", "attack_type", "position", "cut_type"]
    return r.groupingSets([["split", "attack_type", "position"], ["split", "cut_type"], ["attack_type"]], *keys).agg(F.count("*").alias("n"), F.grouping_id(*keys).cast("int").alias("level"))


@query("SELECT coalesce(p3_category, 'p2') AS category, p3_source_kind, count(*) AS n, count(DISTINCT base_id) AS bases, count(*) FILTER (augmentation.wrapper) AS wrapped FROM tagger_record GROUP BY ALL")
def category_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Records, bases and wrapped records by category and kind of source."""
    r = read_table(spark, folder, "tagger_record")
    return r.groupBy(F.coalesce("p3_category", F.lit("p2")).alias("category"), "p3_source_kind").agg(F.count("*").alias("n"), F.count_distinct("base_id").alias("bases"), F.count_if("augmentation.wrapper").alias("wrapped"))


@query(
    """
    WITH s AS (SELECT attack_type, attacked_data AS t, unnest(drop_spans) AS s FROM tagger_record WHERE attacked_data IS NOT NULL),
    f AS (SELECT attack_type, substr(t, s.start + 1, s."end" - s.start) AS x FROM s WHERE s.start >= 0 AND s.start < s."end" AND s."end" <= length(t))
    SELECT attack_type, count(*) AS spans, count(*) FILTER (regexp_matches(x, '^<S>')) AS starts_blank, count(*) FILTER (regexp_matches(x, '<S>$')) AS ends_blank FROM f GROUP BY attack_type""".replace("<S>", SQL_SPACE)
)
def span_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Spans that begin or end with white space, by attack type."""
    r = read_table(spark, folder, "tagger_record").where("attacked_data is not null")
    s = r.select("attack_type", "attacked_data", F.explode("drop_spans").alias("s")).where("s.start >= 0 and s.start < s.end and s.end <= length(attacked_data)")
    x = s.select("attack_type", F.expr("substring(attacked_data, s.start + 1, s.end - s.start)").alias("x"))
    return x.groupBy("attack_type").agg(F.count("*").alias("spans"), F.count_if(F.col("x").rlike(r"(?U)^\s")).alias("starts_blank"), F.count_if(F.col("x").rlike(r"(?U)\s\z")).alias("ends_blank"))


_P, _N = "avg(is_injection::INT)", "count(*)"


@query(
    f"""
    SELECT tool_name, {_N} AS n, round({_P}, 6) AS share, round(greatest(0, {_P} - 1.96 * sqrt({_P} * (1 - {_P}) / {_N})), 6) AS low, round(least(1, {_P} + 1.96 * sqrt({_P} * (1 - {_P}) / {_N})), 6) AS high,
           round(coalesce(stddev_samp(length(tool_output)) / sqrt(count(length(tool_output))), 0), 6) AS length_sem, round(sum(is_injection::INT), 6)::BIGINT AS injected
    FROM sanitizer_sample GROUP BY tool_name"""
)
def normal_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Share of injected samples per tool with its interval, and the standard error of the mean length."""
    s = read_table(spark, folder, "sanitizer_sample")
    p = s.groupBy("tool_name").agg(F.count("*").alias("n"), F.avg(F.col("is_injection").cast("int")).alias("p"), ST.standard_error(F.length("tool_output")).alias("sem"), F.count_if("is_injection").alias("injected"))
    i = ST.normal_interval(F.col("p"), F.col("n"))
    return p.select("tool_name", "n", F.round("p", 6).alias("share"), F.round(i["low"], 6).alias("low"), F.round(i["high"], 6).alias("high"), F.round("sem", 6).alias("length_sem"), "injected")


@query(
    """
    WITH s AS (SELECT attacked_data AS t, drop_spans[1].start AS a, security FROM (SELECT *, row_id % 3 = 0 AS security FROM tagger_record) WHERE len(drop_spans) > 0 AND length(attacked_data) > 0),
    b AS (SELECT least(floor(a / length(t) * 6) + 1, 6)::INT AS bin, security::INT AS s FROM s WHERE a BETWEEN 0 AND length(t))
    SELECT bin, count(*) AS n, round(avg(s), 6) AS rate, round(greatest(0, avg(s) - 1.96 * sqrt(avg(s) * (1 - avg(s)) / count(*))), 6) AS low FROM b GROUP BY bin"""
)
def binned_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Records by sixths of the place of their first span, with a rate and its lower bound."""
    r = read_table(spark, folder, "tagger_record").where((F.size("drop_spans") > 0) & (F.length("attacked_data") > 0))
    a = F.col("drop_spans")[0]["start"]
    b = r.where((a >= 0) & (a <= F.length("attacked_data"))).select(ST.bin_of(a / F.length("attacked_data"), 6).alias("bin"), (F.col("row_id") % 3 == 0).cast("int").alias("s"))
    g = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("s").alias("rate"))
    return g.select("bin", "n", F.round("rate", 6).alias("rate"), F.round(ST.normal_interval(F.col("rate"), F.col("n"))["low"], 6).alias("low"))


@query(
    """
    WITH m AS (SELECT p_brand, p_type, avg(p_retailprice) AS price, avg(p_size) AS size FROM part GROUP BY ALL)
    SELECT p_brand, p_type, round(price, 6) AS price, round(size, 6) AS size FROM m
    QUALIFY size > coalesce(max(size) OVER (PARTITION BY p_brand ORDER BY price DESC, size ASC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300)"""
)
def pareto_front(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of parts of each brand that no dearer kind beats in size."""
    m = read_table(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"))
    return ST.pareto_front(m, ["p_brand"], "price", "size").select("p_brand", "p_type", F.round("price", 6).alias("price"), F.round("size", 6).alias("size"))


@query("SELECT source_suite, count(*) FILTER (attack_type = 'none') AS none, count(*) FILTER (attack_type = 'ignore') AS ignore, count(*) FILTER (attack_type = 'completion') AS completion, count(*) FILTER (attack_type = 'straightforward') AS straightforward FROM sanitizer_sample GROUP BY source_suite")
def pivot_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of each suite in a column per attack."""
    s = read_table(spark, folder, "sanitizer_sample")
    return s.groupBy("source_suite").pivot("attack_type", ["none", "ignore", "completion", "straightforward"]).agg(F.count(F.lit(1))).na.fill(0)


@query("WITH m AS (SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, round(max(c_acctbal), 6) AS largest FROM customer GROUP BY 1) UNPIVOT m ON mean, largest INTO NAME metric VALUE value")
def unpivot_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of customer segments in long form."""
    m = read_table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("mean"), F.round(F.max("c_acctbal"), 6).alias("largest"))
    return m.unpivot("c_mktsegment", ["mean", "largest"], "metric", "value")


@query("WITH c AS (SELECT attack_type, count(*) AS n FROM tagger_record WHERE attack_type IS NOT NULL GROUP BY 1) SELECT attack_type, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights by inverse frequency of the attack types."""
    c = read_table(spark, folder, "tagger_record").where("attack_type is not null").groupBy("attack_type").agg(F.count("*").alias("n"))
    whole = c.agg(F.sum("n").alias("whole"), F.count("*").alias("kinds"))
    return c.crossJoin(F.broadcast(whole)).select("attack_type", "n", F.round(F.col("whole") / (F.col("kinds") * F.col("n")), 6).alias("weight"))


@query("SELECT source_name, round_even(avg(length(clean_data)), 0) AS cell, CASE WHEN count(DISTINCT lower(trim(split, ' '))) >= 5 THEN round(avg(length(clean_data)), 6) END AS mean_if_complete FROM tagger_record GROUP BY source_name")
def rounded_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Means rounded half to even, and given only for sources that have at least five splits."""
    g = read_table(spark, folder, "tagger_record").groupBy("source_name").agg(F.avg(F.length("clean_data")).alias("m"), F.count_distinct(F.lower(F.trim("split"))).alias("splits"))
    return g.select("source_name", F.bround("m", 0).alias("cell"), F.when(F.col("splits") >= 5, F.round("m", 6)).alias("mean_if_complete"))
