"""Span algebra, validation and span metrics over tagger records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..operators.metrics import confusion_metrics, grouped_report, span_details, word_confusion
from ..operators.validate import validated
from ..schema import ATTACK_TYPES, CUT_TYPES, POSITIONS, SPLITS, TEXT_FIELDS
from ..shared import read_table, spread
from .registry import SQL_SPACE, query


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Records with true spans (cut to the text) and those of a rule that looks for the injection, a little off and with some false alarms."""
    r = read_table(spark, folder, "tagger_record")
    n = F.length("attacked_data")
    at = F.expr("locate(injection, attacked_data)")
    hit = F.when((F.length("injection") > 0) & (at > 0), F.array(S.span(F.least(at - 1 + F.pmod("row_id", F.lit(3)), n), at - 1 + F.length("injection")))).otherwise(S.no_spans())
    alarm = F.when((F.pmod("row_id", F.lit(7)) == 0) & (n >= 4), F.array(S.span(0, 4))).otherwise(S.no_spans())
    return r.select(
        "row_id", "attack_type", "position", "cut_type", "clean_data", "attacked_data",
        S.clip_spans(F.col("drop_spans"), F.lit(0), n).alias("truth"), F.filter(F.concat(alarm, hit), lambda s: s["start"] < s["end"]).alias("pred"),
    ).where("attacked_data is not null and truth is not null")


SQL_PREDICTED = """
    WITH base AS (
        SELECT row_id, attack_type, position, cut_type, clean_data, attacked_data, length(attacked_data) AS n, length(injection) AS m,
               CASE WHEN length(injection) > 0 THEN strpos(attacked_data, injection) ELSE 0 END AS hit, drop_spans
        FROM tagger_record WHERE attacked_data IS NOT NULL AND drop_spans IS NOT NULL),
    spans AS (
        SELECT row_id, attack_type, position, cut_type, clean_data, attacked_data, n,
               list_filter(list_transform(drop_spans, lambda s: {'a': greatest(s.start, 0), 'b': least(s."end", n)}), lambda s: s.a < s.b) AS truth,
               CASE WHEN row_id % 7 = 0 AND n >= 4 THEN 4 ELSE 0 END AS e1,
               CASE WHEN hit > 0 AND row_id % 3 < m THEN hit - 1 + row_id % 3 ELSE n END AS a2, CASE WHEN hit > 0 AND row_id % 3 < m THEN hit - 1 + m ELSE n END AS b2
        FROM base),
    r AS (
        SELECT *, list_distinct(flatten(list_transform(truth, lambda s: range(s.a, s.b)))) AS t,
               list_distinct(list_concat(range(0, e1), range(a2, b2))) AS p,
               substr(attacked_data, e1 + 1, greatest(a2 - e1, 0)::BIGINT) || substr(attacked_data, greatest(b2, e1)::BIGINT + 1) AS left_text
        FROM spans)
"""


@query(
    SQL_PREDICTED
    + """, f AS (SELECT *, coalesce(left_text = clean_data, false) AS exact, len(t) AS tl, len(p) AS pl, len(list_intersect(t, p)) AS cl FROM r)
    SELECT CASE WHEN GROUPING(attack_type) = 0 THEN 'attack_type' WHEN GROUPING(position) = 0 THEN 'position' WHEN GROUPING(cut_type) = 0 THEN 'cut_type' ELSE 'all' END AS grouping,
           CASE WHEN GROUPING(attack_type) = 0 THEN attack_type WHEN GROUPING(position) = 0 THEN position WHEN GROUPING(cut_type) = 0 THEN cut_type END AS value,
           count(*) AS n, round(avg(exact::INT), 6) AS exact_match, round(avg(CASE WHEN tl > 0 THEN cl / tl END), 6) AS injection_recall, count(CASE WHEN tl > 0 THEN 1 END) AS injection_records,
           round(coalesce(sum(cl) / nullif(sum(pl), 0), 0), 6) AS char_precision, round(coalesce(sum(cl) / nullif(sum(tl), 0), 0), 6) AS char_recall,
           round(coalesce(2 * sum(cl) / nullif(sum(pl) + sum(tl), 0), 0), 6) AS char_f1
    FROM f GROUP BY GROUPING SETS ((), (attack_type), (position), (cut_type))"""
)
def report_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Exact match, injection recall and character metrics over all records and by each label."""
    details = span_details(predicted(spark, folder), "attacked_data", "truth", "pred", "clean_data")
    return grouped_report(details, ["attack_type", "position", "cut_type"])


@query(SQL_PREDICTED + "SELECT row_id, len(t) AS true_length, len(p) AS predicted_length, len(list_intersect(t, p)) AS common_length, len(p) - len(list_intersect(t, p)) AS wrong_length, len(t) - len(list_intersect(t, p)) AS missed_length FROM r")
def span_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of unions, intersection and differences of true and predicted spans."""
    d = span_details(predicted(spark, folder), "attacked_data", "truth", "pred", "clean_data")
    return d.select("row_id", "true_length", "predicted_length", "common_length", S.span_length(F.col("wrong_spans")).alias("wrong_length"), S.span_length(F.col("missed_spans")).alias("missed_length"))


_ISLANDS = """
    , chars AS (SELECT row_id, unnest({positions}) AS i FROM r),
    marked AS (SELECT row_id, i, i - row_number() OVER (PARTITION BY row_id ORDER BY i) AS island FROM chars)
    SELECT row_id, min(i)::INT AS start, (max(i) + 1)::INT AS "end" FROM marked GROUP BY row_id, island
"""


@query(SQL_PREDICTED + _ISLANDS.format(positions="list_distinct(list_concat(t, p))"))
def span_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Union of true and predicted spans, touching ones merged."""
    d = predicted(spark, folder)
    return d.select("row_id", F.explode(S.merge_spans(F.concat("truth", "pred"))).alias("s")).select("row_id", "s.start", "s.end")


@query(SQL_PREDICTED + _ISLANDS.format(positions="list_filter(p, lambda x: NOT list_contains(t, x))"))
def span_subtract(spark: SparkSession, folder: str) -> DataFrame:
    """False alarms: predicted spans without the true ones."""
    d = predicted(spark, folder)
    return d.select("row_id", F.explode(S.subtract_spans(F.col("pred"), F.col("truth"))).alias("s")).select("row_id", "s.start", "s.end")


@query(SQL_PREDICTED + _ISLANDS.format(positions="list_intersect(t, p)"))
def span_intersect(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted spans that are true."""
    d = predicted(spark, folder)
    return d.select("row_id", F.explode(S.intersect_spans(F.col("pred"), F.col("truth"))).alias("s")).select("row_id", "s.start", "s.end")


@query(
    SQL_PREDICTED
    + """, chars AS (SELECT row_id, unnest(list_distinct(list_concat(t, p))) AS i FROM r),
    steps AS (SELECT row_id, i, i - coalesce(lag(i) OVER w, i) - 1 AS gap FROM chars WINDOW w AS (PARTITION BY row_id ORDER BY i)),
    marked AS (SELECT row_id, i, sum((gap > 40)::INT) OVER (PARTITION BY row_id ORDER BY i) AS island FROM steps)
    SELECT row_id, min(i)::INT AS start, (max(i) + 1)::INT AS "end" FROM marked GROUP BY row_id, island"""
)
def span_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """Union of true and predicted spans, merged over gaps of up to 40 characters."""
    d = predicted(spark, folder)
    return d.select("row_id", F.explode(S.bridge_gaps(F.concat("truth", "pred"), 40)).alias("s")).select("row_id", "s.start", "s.end")


@query(SQL_PREDICTED + "SELECT row_id, md5(left_text) AS left_md5, length(left_text) AS left_length FROM r")
def span_remove(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of the text without the predicted spans."""
    left = S.remove_spans(F.col("attacked_data"), F.col("pred"))
    return predicted(spark, folder).select("row_id", F.md5(left).alias("left_md5"), F.length(left).alias("left_length"))


_ERRORS = """
    WITH r AS (
        SELECT *, attack_type IN ({attacks}) AS attacked, attack_type = 'Clean' AS clean, length(attacked_data) AS n,
               drop_spans IS NOT NULL AND attacked_data IS NOT NULL
               AND len(list_filter(drop_spans, lambda s: NOT coalesce(s.start >= 0 AND s.start < s."end" AND s."end" <= length(attacked_data), false))) = 0
               AND len(list_filter(range(1, len(drop_spans)), lambda k: NOT coalesce(drop_spans[k]."end" <= drop_spans[k + 1].start, false))) = 0 AS fit
        FROM tagger_record),
    e AS (
        SELECT row_id, [{nulls}, CASE WHEN drop_spans IS NULL THEN 'null_drop_spans' END,
            CASE WHEN split NOT IN ({splits}) THEN 'split' END, CASE WHEN attack_type NOT IN ('Clean', {attacks}) THEN 'attack_type' END,
            CASE WHEN position NOT IN ({positions}) THEN 'position' END, CASE WHEN cut_type NOT IN ({cuts}) THEN 'cut_type' END,
            CASE WHEN id = '' OR base_id = '' THEN 'empty_id' END, CASE WHEN drop_spans IS NOT NULL AND attacked_data IS NOT NULL AND NOT fit THEN 'spans' END,
            CASE WHEN clean AND len(drop_spans) > 0 THEN 'clean_spans' END, CASE WHEN clean AND (coalesce(injection, '') <> '' OR coalesce(inserted_text, '') <> '') THEN 'clean_injection' END,
            CASE WHEN clean AND (position <> 'none' OR cut_type <> 'none') THEN 'clean_labels' END, CASE WHEN clean AND attacked_data <> clean_data THEN 'clean_text' END,
            CASE WHEN attacked AND len(drop_spans) = 0 THEN 'attack_spans' END, CASE WHEN attacked AND (coalesce(injection, '') = '' OR coalesce(inserted_text, '') = '') THEN 'attack_injection' END,
            CASE WHEN attacked AND position = 'none' THEN 'attack_position' END,
            CASE WHEN attacked AND fit AND len(drop_spans) > 0 AND substr(attacked_data, drop_spans[1].start + 1, drop_spans[1]."end" - drop_spans[1].start) <> inserted_text THEN 'first_span' END,
            CASE WHEN attacked AND NOT contains(inserted_text, injection) THEN 'inserted_text' END,
            CASE WHEN attacked AND fit AND len(drop_spans) > 0 AND list_reduce(list_reverse(drop_spans), lambda t, s: substr(t, 1, s.start) || substr(t, s."end" + 1), attacked_data) <> clean_data THEN 'round_trip' END] AS all_errors
        FROM r),
    f AS (SELECT row_id, list_filter(all_errors, lambda x: x IS NOT NULL) AS errors FROM e)
"""


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_SQL_ERRORS = (
    _ERRORS.replace("{nulls}", ", ".join(f"CASE WHEN {f} IS NULL THEN 'null_{f}' END" for f in TEXT_FIELDS))
    .replace("{attacks}", _quoted(ATTACK_TYPES[1:])).replace("{splits}", _quoted(SPLITS)).replace("{positions}", _quoted(POSITIONS)).replace("{cuts}", _quoted(CUT_TYPES))
)


@query(_SQL_ERRORS + "SELECT row_id, array_to_string(errors, ',') AS errors FROM f WHERE len(errors) > 0")
def validate_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records that break the contract, with the codes of the broken rules."""
    found = validated(read_table(spark, folder, "tagger_record")).where(F.size("errors") > 0)
    return found.select("row_id", F.array_join("errors", ",").alias("errors"))


@query(_SQL_ERRORS + "SELECT error, count(*) AS records FROM (SELECT unnest(errors) AS error FROM f) GROUP BY error")
def validate_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many records break each rule."""
    return validated(read_table(spark, folder, "tagger_record")).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("records"))


# Tokens are the words between white space; a token is dropped if the rule's spans touch it.
_SQL_TOKENS = SQL_PREDICTED + """
    , pieces AS (SELECT row_id, attack_type, attacked_data, t, p, regexp_extract_all(attacked_data, '<S>*<N>+') AS parts FROM r),
    ends AS (SELECT *, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM pieces),
    tokens AS (
        SELECT row_id, attack_type, k, sum(length(part)) OVER (PARTITION BY row_id ORDER BY k) AS b, length(regexp_replace(part, '^<S>+', '')) AS m, t, p FROM ends),
    labelled AS (
        SELECT attack_type, list_has_any(t, range((b - m)::BIGINT, b::BIGINT))::INT AS label, list_has_any(p, range((b - m)::BIGINT, b::BIGINT))::INT AS pred FROM tokens)
"""
_SQL_TOKENS = _SQL_TOKENS.replace("<S>", SQL_SPACE).replace("<N>", SQL_SPACE.replace("[", "[^", 1))


@query(
    _SQL_TOKENS
    + """, c AS (SELECT attack_type, count(*) FILTER (label = 0 AND pred = 0) AS n00, count(*) FILTER (label = 0 AND pred = 1) AS n01, count(*) FILTER (label = 1 AND pred = 0) AS n10,
                 count(*) FILTER (label = 1 AND pred = 1) AS n11 FROM labelled GROUP BY attack_type),
    m AS (SELECT *, coalesce(2 * n11 / nullif(2 * n11 + n01 + n10, 0), 0) AS df, coalesce(2 * n00 / nullif(2 * n00 + n01 + n10, 0), 0) AS kf FROM c)
    SELECT attack_type, n00, n01, n10, n11, round(coalesce(n11 / nullif(n11 + n01, 0), 0), 6) AS drop_precision, round(coalesce(n11 / nullif(n11 + n10, 0), 0), 6) AS drop_recall, round(df, 6) AS drop_f1,
           round(coalesce(n00 / nullif(n00 + n10, 0), 0), 6) AS keep_precision, round(coalesce(n00 / nullif(n00 + n01, 0), 0), 6) AS keep_recall, round(kf, 6) AS keep_f1,
           round((df + kf) / 2, 6) AS macro_f1, round(coalesce((n00 + n11) / nullif(n00 + n01 + n10 + n11, 0), 0), 6) AS accuracy
    FROM m"""
)
def token_report(spark: SparkSession, folder: str) -> DataFrame:
    """Token confusion, F1 of both classes, macro F1 and accuracy by attack type."""
    counts = spread(predicted(spark, folder)).select("attack_type", word_confusion("attacked_data", "truth", "pred").alias("c"))
    return confusion_metrics(counts.groupBy("attack_type").agg(*(F.sum(f"c.{n}").alias(n) for n in ("n00", "n01", "n10", "n11"))), ["attack_type"])


@query()
def threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Character metrics of spans decoded from token probabilities, for each threshold and bridged gap of a grid."""
    from ..functions.detrand import uniform
    from ..functions.text import word_spans
    from ..operators.metrics import threshold_sweep

    d = spread(predicted(spark, folder))
    truth = F.col("truth")
    p = lambda w: F.when(F.exists(truth, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])), 0.55 + 0.45 * uniform(F.concat_ws("-", "row_id", w["start"]), "p")).otherwise(0.6 * uniform(F.concat_ws("-", "row_id", w["start"]), "p"))
    probabilities = F.transform(word_spans(F.col("attacked_data")), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.bround(p(w), 4).alias("p")))
    grid = spark.createDataFrame([(t, g) for t in (0.5, 0.6, 0.7) for g in (0, 1)], "threshold double, max_gap int")
    swept = threshold_sweep(d.withColumn("tokens", probabilities), "tokens", grid)
    details = span_details(swept, "attacked_data", "truth", "predicted", "clean_data")
    return details.groupBy("threshold", "max_gap").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("exact").cast("int")), 6).alias("exact_match"),
        F.round(F.sum("common_length") / F.sum("predicted_length"), 6).alias("char_precision"), F.round(F.sum("common_length") / F.sum("true_length"), 6).alias("char_recall"),
    )
