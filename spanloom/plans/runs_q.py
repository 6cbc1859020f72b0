"""Tables of runs, filter events, policies and summaries over trace cases and defense events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as R
from ..shared import read_table
from .registry import query

#: A passage that some outputs hold: a time stamp stands for the tag.
_TAG = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z"
_SQL_TAG = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z"
_SQL_RUNS = f"""
    WITH o AS (SELECT case_id, original_tool_output AS t, regexp_extract_all(original_tool_output, '{_SQL_TAG}') AS m FROM defense_event),
    s AS (SELECT case_id, count(*) AS outputs, sum(len(m)) AS times, min(strpos(t, m[1]) - 1) AS a, min(length(m[1])) AS n, min(length(t)) AS whole FROM o WHERE len(m) > 0 GROUP BY case_id),
    r AS (SELECT c.*, coalesce(times, 0) > 0 AS injection_seen, coalesce(times, 0)::BIGINT AS times_seen,
                 CASE WHEN outputs = 1 AND times = 1 THEN a / whole END AS start_position, CASE WHEN outputs = 1 AND times = 1 THEN (a + n) / whole END AS end_position
          FROM trace_case c LEFT JOIN s USING (case_id))
"""


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return R.run_table(read_table(spark, folder, "trace_case"), read_table(spark, folder, "defense_event").select("case_id", "original_tool_output"), "case_id", "original_tool_output", _TAG)


@query(_SQL_RUNS + "SELECT case_id, suite_name, utility, security, injection_seen, times_seen, round(start_position, 6) AS start_position, round(end_position, 6) AS end_position FROM r")
def run_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row per case with how often and where its outputs show the tag."""
    return _runs(spark, folder).select("case_id", "suite_name", "utility", "security", "injection_seen", "times_seen", F.round("start_position", 6).alias("start_position"), F.round("end_position", 6).alias("end_position"))


@query(_SQL_RUNS + "SELECT suite_name, times_seen, count(*) AS n, round(avg(security::INT), 6) AS security FROM r WHERE security IS NOT NULL GROUP BY ALL")
def security_by_times_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Attack success by how often the tag was seen."""
    return R.by_times_seen(_runs(spark, folder), ["suite_name"])


@query("SELECT case_id, 'Untargeted' AS attack, 1 - utility::INT AS asr FROM trace_case WHERE attack_type IS NOT NULL UNION ALL SELECT case_id, 'Targeted', security::INT FROM trace_case WHERE attack_type IS NOT NULL")
def attack_view(spark: SparkSession, folder: str) -> DataFrame:
    """Untargeted and targeted success of every attacked case, stacked."""
    return R.attack_view(read_table(spark, folder, "trace_case").where("attack_type is not null")).select("case_id", "attack", "asr")


@query(
    """
    WITH f AS (SELECT suite_name, min(injection_task_id) AS first FROM trace_case WHERE attack_type = 'ignore_previous' GROUP BY 1)
    SELECT case_id, 'all' AS kind FROM trace_case WHERE attack_type IS NULL AND injection_task_id IS NULL OR attack_type = 'ignore_previous'
    UNION ALL SELECT case_id, 'first' FROM trace_case LEFT JOIN f USING (suite_name) WHERE attack_type IS NULL AND injection_task_id IS NULL OR attack_type = 'ignore_previous' AND injection_task_id = first"""
)
def suite_results(spark: SparkSession, folder: str) -> DataFrame:
    """Benign runs and those of one attack, with all injection tasks and with the first one only (as for attacks on availability)."""
    c = read_table(spark, folder, "trace_case")
    renamed = c.withColumn("attack_type", F.when(F.col("attack_type") == "ignore_previous", "dos_ignore").otherwise(F.col("attack_type")))
    return R.suite_results(c, "ignore_previous").select("case_id", F.lit("all").alias("kind")).unionByName(R.suite_results(renamed, "dos_ignore").select("case_id", F.lit("first").alias("kind")))


@query("SELECT CASE WHEN grouping(suite_name) = 1 THEN 'combined' ELSE suite_name END AS suite_name, count(*) AS n, round(coalesce(100 * avg(utility::INT), 0), 6) AS utility, round(coalesce(100 * avg(security::INT), 0), 6) AS security FROM trace_case GROUP BY GROUPING SETS ((suite_name), ())")
def suite_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Utility and security per suite and over all."""
    return R.summary_with_total(read_table(spark, folder, "trace_case"), "suite_name", ["utility", "security"])


_KEYS = ["suite_name", "attack_type", "agentdojo_package_version"]
_SQL_ONE = "(SELECT suite_name, attack_type AS a, agentdojo_package_version AS v, max_by(utility, case_id) AS u, max_by(security, case_id) AS s FROM (SELECT * REPLACE (coalesce(utility, false) AS utility, coalesce(security, false) AS security) FROM trace_case) WHERE pipeline_name LIKE '%{p}' GROUP BY ALL)"


@query(
    f"""
    SELECT b.suite_name, count(*) AS runs, round(avg((b.u IS DISTINCT FROM n.u)::INT), 6) AS normal_triggering, round(avg((b.s IS DISTINCT FROM n.s)::INT), 6) AS normal_tpr,
           round(avg((b.u IS DISTINCT FROM t.u)::INT), 6) AS strict_triggering, round(avg((b.s IS DISTINCT FROM t.s)::INT), 6) AS strict_tpr
    FROM {_SQL_ONE.format(p='none')} b JOIN {_SQL_ONE.format(p='tagger')} n ON b.suite_name = n.suite_name AND b.a IS NOT DISTINCT FROM n.a AND b.v IS NOT DISTINCT FROM n.v
    JOIN {_SQL_ONE.format(p='filter')} t ON b.suite_name = t.suite_name AND b.a IS NOT DISTINCT FROM t.a AND b.v IS NOT DISTINCT FROM t.v GROUP BY 1"""
)
def policy_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often a normal and a strict policy change the outcome of runs under one attack and version, either of which may be null."""
    c = read_table(spark, folder, "trace_case").withColumns({x: F.coalesce(x, F.lit(False)) for x in ("utility", "security")})
    of = lambda end: c.where(F.col("pipeline_name").endswith(end)).groupBy(*_KEYS).agg(F.max_by("utility", "case_id").alias("utility"), F.max_by("security", "case_id").alias("security"))
    return R.policy_rates(of("none"), {"normal": of("tagger"), "strict": of("filter")}, _KEYS, ["suite_name"])


# Filter events: a payload is the text an event's own spans mark, or a phrase of the text.

_SQL_FILTERED = r"""
    WITH e AS (SELECT event_no, defense, original_tool_output AS o, filtered_tool_output AS f, changed,
                      list_filter([CASE WHEN changed AND predicted_drop_spans[1].start >= 0 AND predicted_drop_spans[1].start < predicted_drop_spans[1]."end" AND predicted_drop_spans[1]."end" <= length(original_tool_output)
                                        THEN substr(original_tool_output, predicted_drop_spans[1].start + 1, predicted_drop_spans[1]."end" - predicted_drop_spans[1].start) END,
                                   CASE WHEN event_no % 3 = 0 THEN substr(original_tool_output, 5, 25) END], lambda x: length(x) > 0) AS p FROM defense_event),
    b AS (SELECT *, list_filter(p, lambda x: contains(o, x)) AS xb, list_filter(p, lambda x: contains(f, x)) AS xa FROM (SELECT * REPLACE (coalesce(o, '') AS o, coalesce(f, '') AS f, coalesce(p, []) AS p) FROM e)),
    n AS (SELECT *, len(xb) > 0 OR len(list_filter(p, lambda x: contains(<o>, <x>))) > 0 AS present_before, len(xa) > 0 OR len(list_filter(p, lambda x: contains(<f>, <x>))) > 0 AS present_after, coalesce(changed, o <> f) AS did,
                 CASE WHEN len(xb) > 0 THEN replace(replace(o, xb[1], ''), coalesce(xb[2], xb[1]), '') END AS gold FROM b)
"""


def _squeezed_sql(x: str) -> str:
    from .registry import SQL_SPACE

    return f"regexp_replace(regexp_replace(regexp_replace({x}, '\\\\[nrt]', ' ', 'g'), '{SQL_SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


_SQL_FILTERED = _SQL_FILTERED.replace("<o>", _squeezed_sql("o")).replace("<f>", _squeezed_sql("f")).replace("<x>", _squeezed_sql("x"))


def _filtered(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "defense_event")
    s = F.get("predicted_drop_spans", F.lit(0))
    fits = F.col("changed") & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length("original_tool_output"))
    marked = F.when(fits, F.substring("original_tool_output", s["start"] + 1, s["end"] - s["start"]))
    phrase = F.when(F.col("event_no") % 3 == 0, F.substring("original_tool_output", 5, 25))
    return R.filter_events(e.withColumn("payloads", F.array_compact(F.array(marked, phrase))), "original_tool_output", "filtered_tool_output", "payloads", "changed")


@query(_SQL_FILTERED + "SELECT event_no, present_before, present_after, present_before AND NOT present_after AS cleaned, present_before AND present_after AS missed, NOT present_before AND did AS over_filtered, did = present_before AS detected, length(gold) AS gold_length FROM n")
def filter_events(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each event's payloads stood in the output before and after the filter, and what follows."""
    return _filtered(spark, folder).select("event_no", "present_before", "present_after", "cleaned", "missed", "over_filtered", "detected", F.length("gold").alias("gold_length"))


@query(
    _SQL_FILTERED
    + """SELECT defense, count(*) AS events, count(*) FILTER (present_before) AS injection_events, round(coalesce(avg((NOT present_after)::INT) FILTER (present_before), 0), 6) AS cleaning_rate,
        round(coalesce(avg(present_after::INT) FILTER (present_before), 0), 6) AS missed_rate, round(avg((NOT present_before AND did)::INT), 6) AS over_filter_rate, round(avg((did = present_before)::INT), 6) AS detection_accuracy FROM n GROUP BY defense"""
)
def filter_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaning, misses, over-filtering and detection per defense."""
    return R.filter_summary(_filtered(spark, folder), ["defense"]).drop("mean_sas")


@query(_SQL_FILTERED + "SELECT event_no, defense FROM n WHERE present_before AND present_after OR NOT present_before AND did OR NOT coalesce(event_no % 7 <> 0, false) OR event_no % 11 = 0")
def filter_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Events that belong into a report of failures."""
    e = _filtered(spark, folder).withColumns({"api_ok": F.col("event_no") % 7 != 0, "parse_ok": F.when(F.col("event_no") % 11 != 0, F.lit(True))})
    return R.failures(e).select("event_no", "defense")


@query(
    """
    WITH p AS (SELECT source_pair_id, max(tool_output) FILTER (is_injection) AS i, max(tool_output) FILTER (NOT is_injection) AS b, max(injection_text) FILTER (is_injection) AS x FROM sanitizer_sample GROUP BY 1),
    s AS (SELECT *, CASE WHEN ascii(right(source_pair_id, 1)) % 2 = 0 THEN b ELSE i END AS f, CASE WHEN ascii(right(source_pair_id, 1)) % 3 = 0 THEN b ELSE left(i, 60) END AS g FROM p WHERE i IS NOT NULL AND b IS NOT NULL),
    m AS (SELECT *, f = b AS fe, g = b AS ge, b <> i AS gold, f <> i AS fc, g <> i AS gc, coalesce(length(x) > 0 AND contains(f, x), false) AS fr, coalesce(length(x) > 0 AND contains(g, x), false) AS gr FROM s)
    SELECT source_pair_id, fe AS exact_match, fc = gold AS detection_correct, NOT gold AND fc AS over_filter, gold AND NOT fc AS under_filter, fr AS residual,
           (NOT gold AND fc) OR (gold AND NOT fc) OR fr OR NOT fe OR (NOT gold AND gc) OR (gold AND NOT gc) OR gr OR NOT ge AS shown FROM m"""
)
def sanitizer_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Diagnostics of two filters' outputs against the benign half of each pair, and whether a tie between them is worth showing."""
    s = read_table(spark, folder, "sanitizer_sample")
    of = lambda flag, c: F.max(F.when(flag, F.col(c)))
    p = s.groupBy("source_pair_id").agg(of(F.col("is_injection"), "tool_output").alias("i"), of(~F.col("is_injection"), "tool_output").alias("b"), of(F.col("is_injection"), "injection_text").alias("x"))
    p = p.where(F.col("i").isNotNull() & F.col("b").isNotNull())
    turn = F.ascii(F.right("source_pair_id", F.lit(1)))
    p = p.withColumns({"f": F.when(turn % 2 == 0, F.col("b")).otherwise(F.col("i")), "g": F.when(turn % 3 == 0, F.col("b")).otherwise(F.left("i", F.lit(60)))})
    scored = p.withColumns({n: R.sanitizer_score(F.col("i"), F.col(n), F.col("b"), F.col("x")) for n in "fg"})
    return scored.select("source_pair_id", *(F.col(f"f.{n}").alias(n) for n in ("exact_match", "detection_correct", "over_filter", "under_filter", "residual")), R.worth_showing(F.lit("tie"), [F.col("f"), F.col("g")]).alias("shown"))


@query("WITH s AS (SELECT suite_name, count(*) AS n, count(*) FILTER (security) AS k FROM trace_case WHERE attack_type IS NOT NULL GROUP BY 1) SELECT suite_name, k AS attacks, round(n * (k / n - greatest(0, k / n - 1.959963984540054 * sqrt((k / n) * (1 - k / n) / n))), 6) AS half FROM s")
def attack_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Successful attacks per suite with the half width of their interval."""
    c = read_table(spark, folder, "trace_case").where("attack_type is not null")
    return c.groupBy("suite_name").agg(R.count_interval(F.col("security")).alias("x")).select("suite_name", F.col("x.n").alias("attacks"), F.round("x.half", 6).alias("half"))


@query("SELECT suite_name, sum(utility::INT) FILTER (pipeline_name = 'model-a_none')::BIGINT AS first, sum(utility::INT) FILTER (pipeline_name = 'model-a_tagger')::BIGINT AS second, first - second AS difference FROM trace_case WHERE pipeline_name IN ('model-a_none', 'model-a_tagger') GROUP BY 1")
def solved_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Solved cases without and with a defense, and their difference, per suite."""
    return R.difference(read_table(spark, folder, "trace_case"), ["suite_name"], "pipeline_name", F.col("utility").cast("int"), "model-a_none", "model-a_tagger")


@query(
    """
    WITH m AS (SELECT pipeline_name, suite_name, avg(utility::INT) AS utility, avg(security::INT) AS security, count(*) AS n FROM trace_case GROUP BY ALL)
    SELECT pipeline_name, s.set, round(avg(utility), 6) AS utility, round(avg(security), 6) AS security, sum(n)::BIGINT AS n
    FROM m JOIN (VALUES ('static', 'banking'), ('static', 'slack'), ('static', 'travel'), ('dynamic', 'shopping'), ('dynamic', 'github'), ('dynamic', 'dailylife')) s(set, suite_name) USING (suite_name)
    GROUP BY pipeline_name, s.set HAVING count(*) = 3"""
)
def composite_suites(spark: SparkSession, folder: str) -> DataFrame:
    """Unweighted means of the static and of the dynamic suites, where all of a set are there."""
    c = read_table(spark, folder, "trace_case")
    m = c.groupBy("pipeline_name", "suite_name").agg(F.avg(F.col("utility").cast("int")).alias("utility"), F.avg(F.col("security").cast("int")).alias("security"), F.count("*").alias("n"))
    return R.composite(m, ["pipeline_name"], "suite_name", {"static": ["banking", "slack", "travel"], "dynamic": ["shopping", "github", "dailylife"]}, ["utility", "security"], "n")


@query(
    """
    WITH l AS (SELECT pipeline_name, suite_name, user_task_id, 'utility' AS m, round(avg(utility::INT), 6) AS v FROM trace_case GROUP BY ALL UNION ALL SELECT pipeline_name, suite_name, user_task_id, 'security', round(avg(security::INT), 6) FROM trace_case GROUP BY ALL)
    SELECT pipeline_name, suite_name, user_task_id, max(v) FILTER (m = 'utility') AS utility, max(v) FILTER (m = 'security') AS security FROM l GROUP BY ALL HAVING max(v) FILTER (m = 'utility') IS NOT NULL AND max(v) FILTER (m = 'security') IS NOT NULL"""
)
def complete_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of cases that have both metrics, one column each."""
    keys = ["pipeline_name", "suite_name", "user_task_id"]
    means = read_table(spark, folder, "trace_case").groupBy(*keys).agg(*(F.round(F.avg(F.col(x).cast("int")), 6).alias(x) for x in ("utility", "security")))
    long = means.unpivot(keys, ["utility", "security"], "metric", "value")
    return R.complete_groups(long, keys, "metric", "value", ["utility", "security"])


@query("WITH s AS (SELECT pipeline_name, count(*) / sum(duration) AS rate, avg(duration) AS latency FROM trace_case GROUP BY 1) SELECT round(coalesce(a.rate / nullif(b.rate, 0), 0), 6) AS speedup, round(coalesce(a.latency / nullif(b.latency, 0), 0), 6) AS latency_ratio FROM s a, s b WHERE a.pipeline_name = 'model-b_tagger' AND b.pipeline_name = 'model-c_data_filter'")
def speed_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Throughput and latency of one pipeline over those of another."""
    c = read_table(spark, folder, "trace_case").where(F.col("pipeline_name").isin("model-b_tagger", "model-c_data_filter"))
    of = lambda p, x: F.max(F.when(F.col("pipeline_name") == p, F.col(x)))
    s = c.groupBy("pipeline_name").agg((F.count("*") / F.sum("duration")).alias("rate"), F.avg("duration").alias("latency"))
    ratio = lambda x: F.round(R.speed_ratio(of("model-b_tagger", x), of("model-c_data_filter", x)), 6)
    return s.agg(ratio("rate").alias("speedup"), ratio("latency").alias("latency_ratio"))


@query("WITH s AS (SELECT defense, avg(latency_ms) AS ms FROM defense_event GROUP BY 1) SELECT defense, n::INT AS n, round(ms * n, 4) AS total FROM s, range(1, 31) r(n)")
def latency_line(spark: SparkSession, folder: str) -> DataFrame:
    """Latency of 1 to 30 calls of each defense."""
    s = read_table(spark, folder, "defense_event").groupBy("defense").agg(F.avg("latency_ms").alias("ms"))
    return R.cumulative_line(s, ["defense"], "ms").select("defense", "n", F.round("total", 4).alias("total"))


@query("SELECT pipeline_name, max(b).d AS day, round(max(b).s, 6) AS score FROM (SELECT pipeline_name, {'s': round(avg(utility::INT), 2), 'd': evaluation_timestamp::DATE} AS b FROM trace_case WHERE utility IS NOT NULL GROUP BY pipeline_name, evaluation_timestamp::DATE) GROUP BY 1")
def best_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """The latest of the days with the best utility of each pipeline."""
    c = read_table(spark, folder, "trace_case").where("utility is not null")
    days = c.groupBy("pipeline_name", F.to_date("evaluation_timestamp").alias("day")).agg(F.round(F.avg(F.col("utility").cast("int")), 2).alias("score"))
    return R.best_epoch(days, ["pipeline_name"], "score", "day").select("pipeline_name", "day", F.round("score", 6).alias("score"))


@query(
    """
    WITH t AS (SELECT suite_name, user_task_id, injection_task_id, list_distinct(list(tool_name)) AS tools FROM trace_case JOIN defense_event USING (case_id) GROUP BY ALL),
    u AS (SELECT suite_name, user_task_id, list_distinct(flatten(list(tools))) AS tools FROM t WHERE injection_task_id IS NULL GROUP BY ALL), i AS (SELECT suite_name, injection_task_id, list_distinct(flatten(list(tools))) AS tools FROM t WHERE injection_task_id IS NOT NULL GROUP BY ALL)
    SELECT suite_name, count(*) AS pairs, round(avg((len(list_filter(i.tools, lambda x: NOT list_contains(u.tools, x))) = 0)::INT), 6) AS subset_share FROM u JOIN i USING (suite_name) GROUP BY 1"""
)
def tool_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the task pairs of a suite whose injection needs no further tool."""
    c = read_table(spark, folder, "trace_case").select("case_id", "suite_name", "user_task_id", "injection_task_id").join(read_table(spark, folder, "defense_event").select("case_id", "tool_name"), "case_id")
    users = c.where("injection_task_id is null").groupBy("suite_name", "user_task_id").agg(F.collect_set("tool_name").alias("tools"))
    injections = c.where("injection_task_id is not null").groupBy("suite_name", "injection_task_id").agg(F.collect_set("tool_name").alias("tools"))
    return R.tool_subset(users, injections, "suite_name", "tools")


@query("SELECT suite_name, pipeline_name, CASE WHEN count(security) > 0 THEN printf('%.1f', round(100.0 * count(*) FILTER (security) / count(security), 1)) ELSE '-' END AS asr FROM trace_case WHERE user_task_id <> 'user_task_0' GROUP BY ALL")
def score_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Attack success with one decimal, and a dash without trials."""
    c = read_table(spark, folder, "trace_case").where("user_task_id <> 'user_task_0'").groupBy("suite_name", "pipeline_name")
    return c.agg(R.score_text(F.count_if("security"), F.count("security")).alias("asr"))


@query("SELECT attack_type, agentdojo_package_version AS version, count(duration) AS n, round(avg(duration), 6) AS mean, round(median(duration), 6) AS median, round(stddev_pop(duration), 6) AS deviation FROM trace_case GROUP BY ALL")
def usage_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Durations by attack and version, null ones included."""
    c = read_table(spark, folder, "trace_case").withColumnRenamed("agentdojo_package_version", "version")
    return R.usage_stats(c, ["attack_type", "version"], "duration")
