"""The queries of the training-data problems over the test tables. SQL checks stand beside those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import read_table
from .chunking import Sizes, all_pieces, split_oversized
from .crosssplit import SuffixPlan, cross_pairs, cross_split_overlaps
from .leakage import Passage, leaked_passages
from .mixing import mixture
from .neardup import Similarity, groups_of, near_duplicates, row_pairs
from .pii import personal_information
from .quota import quota_sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def cleaned(label: str) -> F.Column:
    """The label without surrounding spaces, in lower case."""
    return F.lower(F.trim(F.col(label)))


_SQL_WORDS = "list_filter(regexp_split_to_array(lower({t}), '[^\\pL\\pN]+'), lambda x: x <> '')"


def _sql_grams(n: int) -> str:
    return f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"


# Problem 1: splitting oversized items at natural boundaries.

_SIZES = Sizes(limit=2000, overlap=100)


@query(
    """
    SELECT row_id, 'oversized' AS kind FROM tagger_record WHERE length(attacked_data) > 2000
    UNION ALL
    SELECT row_id, 'unbroken' AS kind FROM tagger_record
    WHERE len(list_filter(regexp_split_to_array(attacked_data, '[ \\t\\r\\n]'), lambda x: length(x) > 2000)) > 0
    """
)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that are split, and those of them with a run without white space longer than a piece."""
    found = split_oversized(read_table(spark, folder, "tagger_record"), "row_id", "attacked_data", "drop_spans", _SIZES)
    kinds = F.when(F.col("unbroken") > _SIZES.limit, F.array(F.lit("oversized"), F.lit("unbroken"))).otherwise(F.array(F.lit("oversized")))
    return found.where("piece = 1").select(F.col("id").alias("row_id"), F.explode(kinds).alias("kind"))


@query()
def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All records in pieces within the limit, with each piece's own drop spans."""
    found = all_pieces(read_table(spark, folder, "tagger_record"), "row_id", "attacked_data", "drop_spans", _SIZES)
    return found.withColumnRenamed("id", "row_id")


@query(
    """
    WITH t AS (SELECT row_id, attacked_data AS t, list_filter(drop_spans, lambda s: s.start >= 0 AND s.start < s."end" AND s."end" <= length(attacked_data)) AS fit, drop_spans FROM tagger_record WHERE attacked_data IS NOT NULL)
    SELECT row_id, md5(t) AS rebuilt, true AS within, true AS overlapping, coalesce(list_sum(list_transform(fit, lambda s: s."end" - s.start)), 0)::BIGINT AS span_chars, coalesce(len(drop_spans) - len(fit), 0)::INT AS bad_spans FROM t"""
)
def p1_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each record give when put together again: the text, whether every piece is within the limit and has the asked overlap, and the characters its spans mark."""
    found = all_pieces(read_table(spark, folder, "tagger_record"), "row_id", "attacked_data", "drop_spans", _SIZES)
    repeated = F.when(F.col("piece") == 1, F.lit(0)).otherwise(F.lit(_SIZES.overlap))
    marked = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], F.col("repeated"))))
    each = found.withColumn("repeated", repeated).select("id", "piece", "start", "end", "n_pieces", "bad_spans", F.substring("text", F.col("repeated") + 1, F.length("text")).alias("own"), (F.length("text") <= _SIZES.limit).alias("fits"), marked.alias("marked"))
    rows = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("piece", "start", "end", "own"))).alias("p"), F.min("fits").alias("within"), F.sum("marked").alias("span_chars"), F.max("bad_spans").alias("bad_spans"))
    gaps = F.zip_with(F.slice("p", 2, F.size("p")), F.slice("p", 1, F.size("p") - 1), lambda b, a: a["end"] - b["start"] == _SIZES.overlap)
    return rows.select(F.col("id").alias("row_id"), F.md5(F.array_join(F.transform("p", lambda x: x["own"]), "")).alias("rebuilt"), "within", F.forall(gaps, lambda x: x).alias("overlapping"), "span_chars", "bad_spans")


# Problem 2: near-duplicate records with small edits.

_EDITS = Similarity(width=3, permille=700, min_words=8)
_SQL_SIMILAR = f"""
    w AS (SELECT *, {_SQL_WORDS.format(t="t")} AS w FROM r WHERE t IS NOT NULL),
    g AS (SELECT DISTINCT row_id, field, part, unnest({_sql_grams(3)}) AS g FROM w WHERE len(w) >= 8),
    n AS (SELECT row_id, field, count(*) AS n FROM g GROUP BY ALL),
    j AS (SELECT a.field, a.row_id AS x, b.row_id AS y, count(*) AS k FROM g a JOIN g b USING (field, g) WHERE <pair> GROUP BY ALL),
    s AS (SELECT j.field, least(x, y) AS row_id_a, greatest(x, y) AS row_id_b, k, p.n + q.n - k AS u FROM j JOIN n p ON p.row_id = x AND p.field = j.field JOIN n q ON q.row_id = y AND q.field = j.field)
"""


def _edited(spark: SparkSession, folder: str):
    records = read_table(spark, folder, "tagger_record").select("row_id", "base_id", "attacked_data", "inserted_text")
    return near_duplicates(records, "row_id", ["attacked_data", "inserted_text"], "base_id", _EDITS)


@query(
    "WITH r AS (SELECT row_id, base_id AS part, unnest(['attacked_data', 'inserted_text']) AS field, unnest([attacked_data, inserted_text]) AS t FROM tagger_record WHERE base_id IS NOT NULL),"
    + _SQL_SIMILAR.replace("<pair>", "a.row_id < b.row_id AND a.part <> b.part")
    + "SELECT field, row_id_a, row_id_b FROM s WHERE 1000 * k >= 700 * u"
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of different bases whose texts in a field differ only in small edits."""
    return row_pairs(_edited(spark, folder))


@query(
    "WITH RECURSIVE r AS (SELECT row_id, base_id AS part, unnest(['attacked_data', 'inserted_text']) AS field, unnest([attacked_data, inserted_text]) AS t FROM tagger_record WHERE base_id IS NOT NULL),"
    + _SQL_SIMILAR.replace("<pair>", "a.row_id < b.row_id AND a.part <> b.part")
    + """,
    c AS (SELECT row_id, field, part, md5(string_agg(g, '|' ORDER BY g)) AS class FROM g GROUP BY ALL),
    l AS (SELECT DISTINCT s.field, x.class AS a, y.class AS b FROM s JOIN c x ON x.row_id = row_id_a AND x.field = s.field JOIN c y ON y.row_id = row_id_b AND y.field = s.field WHERE 1000 * k >= 700 * u AND x.class <> y.class),
    e AS (SELECT field, a, b FROM l UNION SELECT field, b, a FROM l),
    reach AS (SELECT DISTINCT field, a AS class, a AS other FROM e UNION SELECT r.field, r.class, e.b FROM reach r JOIN e ON e.field = r.field AND e.a = r.other),
    lab AS (SELECT field, class, min(other) AS label FROM reach GROUP BY ALL)
    SELECT c.row_id, c.field, count(*) OVER (PARTITION BY c.field, c.class) AS in_class, count(*) OVER (PARTITION BY c.field, coalesce(lab.label, c.class)) AS in_group,
           coalesce((SELECT count(*) FROM (SELECT DISTINCT field, b FROM e WHERE e.field = c.field AND e.a = c.class)), 0) AS n_links
    FROM c LEFT JOIN lab ON lab.field = c.field AND lab.class = c.class"""
)
def p2_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record and field with the sizes of its class and of its group, and the number of links of its class."""
    groups = groups_of(_edited(spark, folder))
    classes = groups.groupBy("class_id").agg(F.count("*").alias("in_class"))
    whole = groups.groupBy("group_id").agg(F.count("*").alias("in_group"))
    return groups.join(classes, "class_id").join(whole, "group_id").select(F.col("id").alias("row_id"), "field", "in_class", "in_group", "n_links")


@query()
def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record and field with its class of equal shingle sets, its group of linked classes and the number of links."""
    return groups_of(_edited(spark, folder)).withColumnRenamed("id", "row_id")


# Problem 3: same or near-same records across splits.

_SAME = Similarity(width=3, permille=800, min_words=8)


def _overlaps(spark: SparkSession, folder: str, spans: bool = False):
    records = read_table(spark, folder, "tagger_record").select("row_id", "split", "clean_data", "attacked_data")
    split = cleaned("split")
    side = F.when(split == "train", 0).when(split.endswith("_test"), 1)
    return cross_split_overlaps(records, "row_id", side, ["clean_data", "attacked_data"], _SAME, SuffixPlan(), spans)


@query(
    "WITH l AS (SELECT *, CASE WHEN lower(trim(split, ' ')) = 'train' THEN 0 WHEN ends_with(lower(trim(split, ' ')), '_test') THEN 1 END AS part FROM tagger_record),"
    + "r AS (SELECT row_id, part, unnest(['clean_data', 'attacked_data']) AS field, unnest([clean_data, attacked_data]) AS t FROM l WHERE part IS NOT NULL),"
    + _SQL_SIMILAR.replace("<pair>", "a.part = 1 AND b.part = 0")
    + "SELECT DISTINCT row_id_a, row_id_b FROM s WHERE 1000 * k >= 800 * u"
)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a train and a test record that are the same or nearly so in one field."""
    pairs = cross_pairs(_overlaps(spark, folder))
    return pairs.select(F.least("test_id", "train_id").alias("row_id_a"), F.greatest("test_id", "train_id").alias("row_id_b"))


@query(
    "WITH l AS (SELECT *, CASE WHEN lower(trim(split, ' ')) = 'train' THEN 0 WHEN ends_with(lower(trim(split, ' ')), '_test') THEN 1 END AS part FROM tagger_record),"
    + "r AS (SELECT row_id, part, unnest(['clean_data', 'attacked_data']) AS field, unnest([clean_data, attacked_data]) AS t FROM l WHERE part IS NOT NULL),"
    + _SQL_SIMILAR.replace("<pair>", "a.part = 1 AND b.part = 0")
    + f""",
    hit AS (SELECT DISTINCT x AS row_id FROM (SELECT j.x, k, p.n + q.n - k AS u FROM j JOIN n p ON p.row_id = x AND p.field = j.field JOIN n q ON q.row_id = y AND q.field = j.field) WHERE 1000 * k >= 800 * u),
    starts AS (SELECT row_id, field, part, w, unnest(range(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 8),
    run AS (SELECT row_id, field, part, i, array_to_string(w[i:i + 5], ' ') AS g FROM starts),
    known AS (SELECT DISTINCT row_id, field, i FROM run WHERE part = 1 AND (field, g) IN (SELECT (field, g) FROM run WHERE part = 0)),
    covered AS (SELECT row_id, field, count(DISTINCT i + o) AS n FROM known, range(6) o(o) GROUP BY ALL),
    share AS (SELECT row_id, max(c.n / len(w.w)) AS share FROM covered c JOIN w USING (row_id, field) GROUP BY ALL)
    SELECT lower(trim(split, ' ')) AS split, source_name, count(*) AS records, count(hit.row_id) AS overlapping, round(avg(coalesce(share, 0)), 6) AS mean_shared
    FROM tagger_record t LEFT JOIN hit USING (row_id) LEFT JOIN share USING (row_id) WHERE ends_with(lower(trim(split, ' ')), '_test') GROUP BY ALL"""
)
def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per test split and source_name: records, those that overlap with train, and the mean share of words that train holds in runs of six words or more."""
    found = _overlaps(spark, folder, spans=True)
    near = found.links.select(F.col("test").alias("sig")).unionAll(found.members.groupBy("sig").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo < hi").select("sig")).distinct().withColumn("hit", F.lit(True))
    test = found.members.where("side = 1").join(found.spans.select("seq", "covered"), "seq", "left").join(near, "sig", "left")
    share = F.coalesce(F.col("covered") / F.col("words"), F.lit(0.0))
    per_row = test.groupBy("id").agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"), F.max(share).alias("share"))
    rows = read_table(spark, folder, "tagger_record").where(cleaned("split").endswith("_test"))
    rows = rows.select(F.col("row_id").alias("id"), cleaned("split").alias("split"), "source_name")
    return (
        rows.join(per_row, "id", "left")
        .groupBy("split", "source_name")
        .agg(F.count("*").alias("records"), F.count_if(F.coalesce("hit", F.lit(False))).alias("overlapping"), F.round(F.avg(F.coalesce("share", F.lit(0.0))), 6).alias("mean_shared"))
    )


# Problem 4: a sample that matches target proportions.

_CATEGORIES = ["attack_type", "position", "cut_type"]
_DOMAINS = {
    "attack_type": ["Clean", "Naive", "Ignore", "Completion", "IndirectAgentic"],
    "position": ["none", "prepend", "middle", "append"],
    "cut_type": ["none", "empty", "two_thirds", "half"],
}
_SQL_CELLS = """
    WITH labels AS (
        SELECT DISTINCT id, lower(trim(attack_type, ' ')) AS a, lower(trim(position, ' ')) AS p, lower(trim(cut_type, ' ')) AS c FROM tagger_record WHERE id IS NOT NULL),
    size AS (
        SELECT count(DISTINCT id) // 10 AS n FROM labels WHERE a IN ('clean', 'naive', 'ignore', 'completion', 'indirectagentic')
        AND p IN ('none', 'prepend', 'middle', 'append') AND c IN ('none', 'empty', 'two_thirds', 'half')),
    cells AS (
        SELECT t.*, n, greatest((target_permille * n + 999) // 1000, min_rows) AS wanted,
               (SELECT count(DISTINCT id) FROM labels WHERE a = lower(trim(t.attack_type, ' ')) AND p = lower(trim(t.position, ' ')) AND c = lower(trim(t.cut_type, ' '))) AS available
        FROM sample_target t, size)
"""


def _quota(spark: SparkSession, folder: str):
    records = read_table(spark, folder, "tagger_record").select("id", *_CATEGORIES)
    return quota_sample(records, "id", _CATEGORIES, read_table(spark, folder, "sample_target"), _DOMAINS)


@query(_SQL_CELLS + "SELECT attack_type, position, cut_type FROM cells WHERE available < wanted")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells whose target can't be met."""
    return _quota(spark, folder).report.where("shortfall > 0").select(*_CATEGORIES)


# Shares grow with one multiplier of the targets and stop at a cell's floor or availability; the multiplier lies after the last such point that still leaves ids to give.
_SQL_QUOTA = (
    _SQL_CELLS
    + """,
    q AS (SELECT *, least(min_rows, available)::BIGINT AS lo, target_permille::BIGINT AS p, row_number() OVER (ORDER BY target_no) AS k FROM cells),
    points AS (SELECT 0.0::DOUBLE AS x UNION SELECT lo / p::DOUBLE FROM q WHERE p > 0 UNION SELECT available / p::DOUBLE FROM q WHERE p > 0),
    sums AS (SELECT x, sum(CASE WHEN p = 0 THEN lo ELSE least(greatest(x * p, lo), available) END) AS given FROM points, q GROUP BY x),
    at AS (SELECT max(x) AS x FROM sums, size WHERE given <= n + 1e-6),
    free AS (SELECT q.*, p > 0 AND lo / p::DOUBLE <= at.x AND available / p::DOUBLE > at.x AS open, CASE WHEN p > 0 AND available / p::DOUBLE <= at.x THEN available ELSE lo END AS fixed FROM q LEFT JOIN at ON true),
    rest AS (SELECT max(n) - sum(CASE WHEN open THEN 0 ELSE fixed END) AS r, sum(CASE WHEN open THEN p ELSE 0 END) AS w FROM free),
    down AS (SELECT free.*, r, w, CASE WHEN open THEN (p * r) // w ELSE fixed END AS d, CASE WHEN open THEN (p * r) % w ELSE -1 END AS over FROM free, rest),
    ranked AS (SELECT *, row_number() OVER (ORDER BY over DESC, k) AS place, r - sum(CASE WHEN open THEN d ELSE 0 END) OVER () AS left_ FROM down),
    quota AS (SELECT target_no, attack_type, position, cut_type, wanted, available, (d + CASE WHEN open AND place <= left_ THEN 1 ELSE 0 END)::BIGINT AS quota FROM ranked)
"""
).replace(" at AS", " stop AS").replace("at.x", "stop.x").replace("JOIN at ON", "JOIN stop ON")


@query(
    _SQL_QUOTA
    + """, ids AS (SELECT id, q.attack_type, q.position, q.cut_type, quota, row_number() OVER (PARTITION BY target_no ORDER BY substr(md5(id || '|sample|7'), 1, 15), id) AS n
        FROM labels l JOIN quota q ON l.a = lower(trim(q.attack_type, ' ')) AND l.p = lower(trim(q.position, ' ')) AND l.c = lower(trim(q.cut_type, ' ')))
    SELECT id, attack_type, position, cut_type FROM ids WHERE n <= quota"""
)
def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sample: ids with their cell."""
    return _quota(spark, folder).sample


@query(_SQL_QUOTA + "SELECT target_no, attack_type, position, cut_type, wanted, available, quota, greatest(wanted - available, 0) AS shortfall FROM quota")
def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """What each cell wants, has, gets and lacks."""
    return _quota(spark, folder).report.select("target_no", *_CATEGORIES, "wanted", "available", "quota", "shortfall")


# Problem 5: evaluation texts leaking into training text.


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "eval_item").select("item_id", F.col("text").alias("item_text"))
    return leaked_passages(read_table(spark, folder, "documents"), "doc_id", "text", items, "item_id", "item_text", Passage(run=10, width=5))


@query(
    f"""
    WITH i AS (SELECT item_id, {_SQL_WORDS.format(t="text")} AS w FROM eval_item WHERE text IS NOT NULL), d AS (SELECT doc_id, {_SQL_WORDS.format(t="text")} AS w FROM documents WHERE text IS NOT NULL),
    ig AS (SELECT DISTINCT item_id, unnest({_sql_grams(10)}) AS g FROM i), dg AS (SELECT DISTINCT doc_id, unnest({_sql_grams(10)}) AS g FROM d)
    SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (g)"""
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items and documents that share a run of at least ten words."""
    return _leaks(spark, folder).select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id")).distinct()


@query(
    f"""
    WITH i AS (SELECT item_id, {_SQL_WORDS.format(t="text")} AS w FROM eval_item WHERE text IS NOT NULL), d AS (SELECT doc_id, {_SQL_WORDS.format(t="text")} AS w FROM documents WHERE text IS NOT NULL),
    ig AS (SELECT item_id, len(w) - 9 AS windows, unnest(range(1, len(w) - 8)) AS pos, unnest({_sql_grams(10)}) AS g FROM i), dg AS (SELECT DISTINCT doc_id, unnest({_sql_grams(10)}) AS g FROM d),
    n AS (SELECT item_id, doc_id, count(DISTINCT pos) / any_value(windows) AS share FROM ig JOIN dg USING (g) GROUP BY ALL)
    SELECT item_id, count(*) AS documents, round(max(share), 6) AS largest_share FROM n GROUP BY item_id"""
)
def p5_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaked item with the number of documents that hold some of it and the largest share of its passages that one document holds."""
    per_doc = _leaks(spark, folder).groupBy("item", "doc").agg(F.count("*").alias("n"), F.first("n_windows").alias("n_windows"))
    return per_doc.groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("documents"), F.round(F.max(F.col("n") / F.col("n_windows")), 6).alias("largest_share"))


# Problem 6: mixing sources to target weights.

_SQL_SOURCES = """
    WITH docs AS (
        SELECT replace(replace(lower(trim(source, ' ' || chr(9))), '-', '_'), ' ', '_') AS s, strlen(text) + 1 AS size FROM documents WHERE text IS NOT NULL),
    sizes AS (SELECT t.source, t.weight_permille, t.max_repeats, coalesce(sum(d.size), 0)::BIGINT AS size FROM mix_target t LEFT JOIN docs d ON d.s = t.source GROUP BY ALL),
    whole AS (SELECT sum(size) AS b FROM sizes)
"""


#: Domains of the sources, the level above them in the tree of budgets.
_SOURCE_DOMAINS = {
    "agents": ["tool_output", "run_note", "file_dump"],
    "messages": ["email_body", "chat_log", "call_transcript", "voice_memo", "calendar_dump"],
    "tracking": ["issue_thread", "ticket_log"],
    "web": ["web_context", "product_review", "policy_page"],
}
_DOMAIN_OF = {source: domain for domain, sources in _SOURCE_DOMAINS.items() for source in sources}


def _mixed(spark: SparkSession, folder: str):
    source = F.regexp_replace(F.lower(F.regexp_replace("source", "^[ \\t]+|[ \\t]+$", "")), "[- ]", "_")
    size = F.octet_length("text") + 1
    language = F.lower(F.trim(F.col("lang")))
    documents = read_table(spark, folder, "documents")
    return mixture(documents, "doc_id", size, source, read_table(spark, folder, "mix_target"), below=[language], domain=lambda s: _DOMAIN_OF.get(s, "other"))


@query(_SQL_SOURCES + "SELECT source FROM sizes, whole WHERE size * max_repeats * 1000 < weight_permille * b")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that can't reach their share even with all repeats."""
    return _mixed(spark, folder).report.where("short").select("source")


_SQL_DOMAINS = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in _SOURCE_DOMAINS.items()) + " ELSE 'other' END"


def _sql_filled(name: str, rows: str, group: str, whole: str) -> str:
    """Amounts of nodes (group, node, w, cap) by weight up to their capacity, as tables ``name``_1 and so on: in each group the multiplier of the weights lies after the last full node that still leaves something."""
    return f"""
    {name}_n AS ({rows}), {name}_a AS ({whole}),
    {name}_x AS (SELECT DISTINCT {group}, cap / w AS x FROM {name}_n WHERE w > 0 UNION SELECT DISTINCT {group}, 0 FROM {name}_n),
    {name}_s AS (SELECT {group}, x, sum(least(x * w, cap)) AS given FROM {name}_x JOIN {name}_n USING ({group}) GROUP BY ALL),
    {name}_l AS (SELECT {group}, max(x) AS x FROM {name}_s JOIN {name}_a USING ({group}) WHERE given <= amount * (1 + 1e-12) GROUP BY ALL),
    {name}_f AS (SELECT {name}_n.*, w = 0 OR cap / w <= x AS full_ FROM {name}_n JOIN {name}_l USING ({group})),
    {name}_r AS (SELECT {group}, greatest(0, any_value(amount) - sum(CASE WHEN full_ THEN cap ELSE 0 END)) AS rest, sum(CASE WHEN full_ THEN 0 ELSE w END) AS open_w FROM {name}_f JOIN {name}_a USING ({group}) GROUP BY ALL),
    {name} AS (SELECT f.*, CASE WHEN w = 0 THEN 0 WHEN full_ THEN cap ELSE rest * w / open_w END AS given FROM {name}_f f JOIN {name}_r USING ({group}))"""


_SQL_MIX = (
    _SQL_SOURCES
    + ", t AS (SELECT *, "
    + _SQL_DOMAINS
    + " AS domain FROM sizes),"
    + _sql_filled("dom", "SELECT 0 AS root, domain AS node, sum(weight_permille)::DOUBLE AS w, sum(size * max_repeats)::DOUBLE AS cap FROM t GROUP BY domain", "root", "SELECT 0 AS root, least(b, (SELECT sum(size * max_repeats) FROM t))::DOUBLE AS amount FROM whole")
    + ","
    + _sql_filled("src", "SELECT domain, source AS node, weight_permille::DOUBLE AS w, (size * max_repeats)::DOUBLE AS cap FROM t", "domain", "SELECT node AS domain, given AS amount FROM dom")
    + """,
    leaf AS (SELECT d.s AS source, coalesce(lower(trim(lang, ' ')), '') AS lang, sum(strlen(text) + 1)::BIGINT AS size FROM (SELECT *, replace(replace(lower(trim(source, ' ' || chr(9))), '-', '_'), ' ', '_') AS s FROM documents WHERE text IS NOT NULL) d JOIN t ON t.source = d.s GROUP BY ALL),
    plan AS (
        SELECT l.source, l.lang, l.size, CASE WHEN full_ THEN max_repeats ELSE floor(given / t.size)::INT END AS epochs, CASE WHEN full_ THEN 0 ELSE floor(given * l.size / t.size - floor(given / t.size) * l.size + 1e-7)::BIGINT END AS rest
        FROM leaf l JOIN t ON t.source = l.source JOIN src ON src.node = l.source),
    docs_ AS (SELECT doc_id, p.*, strlen(text) + 1 AS n FROM documents d JOIN plan p ON replace(replace(lower(trim(d.source, ' ' || chr(9))), '-', '_'), ' ', '_') = p.source AND coalesce(lower(trim(d.lang, ' ')), '') = p.lang WHERE text IS NOT NULL),
    last_ AS (SELECT *, sum(n) OVER (PARTITION BY source, lang ORDER BY substr(md5(doc_id || '/' || epochs || '|epoch|7'), 1, 15), doc_id) AS upto FROM docs_ WHERE rest > 0),
    mixed AS (SELECT doc_id, source, lang, e::INT AS epoch, n::BIGINT AS size FROM docs_, range(1, 20) r(e) WHERE e <= epochs UNION ALL SELECT doc_id, source, lang, epochs + 1, n::BIGINT FROM last_ WHERE upto <= rest)
"""
)


@query(_SQL_MIX + "SELECT doc_id, source, lang, epoch, size FROM mixed")
def p6_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture: documents with source, language, epoch and size."""
    rows = _mixed(spark, folder).rows
    return rows.select(F.col("id").alias("doc_id"), F.col("leaf")[0].alias("source"), F.col("leaf")[1].alias("lang"), F.col("epoch").cast("int").alias("epoch"), "size")


@query(
    _SQL_MIX
    + """, drawn AS (SELECT source, sum(size)::BIGINT AS drawn, max(epoch) AS epochs FROM mixed GROUP BY source)
    SELECT t.domain, t.source, weight_permille, max_repeats, t.size, t.size * max_repeats * 1000 < weight_permille * b AS short, round(given, 3) AS budget, coalesce(drawn, 0) AS drawn, coalesce(epochs, 0) AS epochs, round(1000 * coalesce(drawn, 0) / (SELECT sum(drawn) FROM drawn), 3) AS reached_permille
    FROM t JOIN src ON node = t.source LEFT JOIN drawn ON drawn.source = t.source, whole"""
)
def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Asked, allotted and reached sizes and shares of the sources; shortages go to the sources of the same domain first."""
    mixed = _mixed(spark, folder)
    drawn = mixed.rows.groupBy(F.col("leaf")[0].alias("source")).agg(F.sum("size").alias("drawn"), F.max("epoch").alias("epochs"))
    rows = mixed.report.join(drawn, "source", "left")
    whole = F.sum(F.coalesce("drawn", F.lit(0))).over(Window.partitionBy(F.lit(0)))  # one row per source of the configuration
    return rows.select(
        "domain", "source", "weight_permille", "max_repeats", "size", "short", F.round("budget", 3).alias("budget"), F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce("epochs", F.lit(0)).cast("int").alias("epochs"),
        F.round(1000 * F.coalesce("drawn", F.lit(0)) / whole, 3).alias("reached_permille"),
    )


# Problem 7: personal information inside free text.


def _personal(spark: SparkSession, folder: str) -> DataFrame:
    return personal_information(read_table(spark, folder, "documents"), "doc_id", "text")


@query()
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every occurrence of personal information with its kind and place."""
    return _personal(spark, folder).select(F.col("id").alias("doc_id"), F.explode("found").alias("f")).select("doc_id", "f.kind", "f.start_at")


@query()
def p7_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with placeholders in place of personal information."""
    return _personal(spark, folder).select(F.col("id").alias("doc_id"), "text", F.size("found").alias("replaced"))
