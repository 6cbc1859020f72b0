"""Environment queries over the product, order and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import envq as E
from ..shared import read_table
from .registry import query


@query("SELECT p_partkey, p_name, p_brand, round(p_retailprice, 6) AS p_retailprice FROM part WHERE contains(lower(p_type), 'stan') AND lower(p_brand) = 'brand#17' AND p_retailprice BETWEEN 910 AND 990 AND p_size >= 10")
def product_search(spark: SparkSession, folder: str) -> DataFrame:
    """Products by a word, a brand and ranges of price and size."""
    found = E.search(read_table(spark, folder, "part"), "Stan", ["p_type"], {"p_brand": "Brand#17"}, {"p_retailprice": (910, 990), "p_size": (10, None)})
    return found.select("p_partkey", "p_name", "p_brand", F.round("p_retailprice", 6).alias("p_retailprice"))


@query("SELECT l_orderkey, count(*) AS items, round(sum(p_retailprice * l_quantity), 4) AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def cart_total(spark: SparkSession, folder: str) -> DataFrame:
    """Value of every order's items at list price."""
    items = read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    products = read_table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return E.basket_total(items, products, "l_orderkey", "l_partkey", "l_quantity", "p_retailprice").withColumn("total", F.round("total", 4))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS no FROM orders")
def order_history(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of each customer, numbered by date."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read_table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("no"))


_SQL_EVENTS = "WITH e AS (SELECT o_custkey AS who, o_orderkey AS id, o_orderdate AS s, o_orderdate + to_days((o_orderkey % 40)::INT) AS e FROM orders)"


def _bookings(spark: SparkSession, folder: str) -> DataFrame:
    o = read_table(spark, folder, "orders")
    return o.select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("s"), F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 40 as int))").alias("e"))


@query(_SQL_EVENTS + 'SELECT a.who, a.id AS first, b.id AS second FROM e a JOIN e b ON a.who = b.who AND a.id < b.id AND a.s < b.e AND b.s < a.e')
def calendar_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping bookings of a person."""
    return E.conflicts(_bookings(spark, folder), ["who"], "id", "s", "e")


@query(_SQL_EVENTS + 'SELECT a.who, a.id AS first, b.id AS second FROM e a JOIN e b ON a.who = b.who AND a.id < b.id AND ((a.s <= b.s AND b.s < a.e) OR (a.s < b.e AND b.e <= a.e))')
def calendar_conflicts_as_listed(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping bookings, with the rule that looks at the later-listed event's ends only."""
    return E.conflicts(_bookings(spark, folder), ["who"], "id", "s", "e", as_listed=True)


@query("SELECT o_orderdate::DATE AS day, count(*) AS events FROM orders GROUP BY 1")
def day_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each day."""
    return read_table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("events"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'passport') AND lower(source) = 'email_body'")
def inbox_search(spark: SparkSession, folder: str) -> DataFrame:
    """Mails that mention a word."""
    return E.search(read_table(spark, folder, "documents"), "Passport", ["text"], {"source": "email_body"}).select("doc_id")


@query("SELECT count(*) FILTER (doc_id % 3 <> 0) AS unread, count(*) AS read_after FROM documents WHERE source = 'email_body'")
def unread_mails(spark: SparkSession, folder: str) -> DataFrame:
    """Unread mails, and mails read after they are taken."""
    mails = read_table(spark, folder, "documents").where("source = 'email_body'").select("doc_id", (F.col("doc_id") % 3 == 0).alias("read"))
    unread, after = E.take_unread(mails)
    return unread.agg(F.count("*").alias("unread")).crossJoin(after.agg(F.count_if("read").alias("read_after")))


@query("SELECT DISTINCT lower(a) AS email, split_part(lower(a), '@', 1) AS local FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]*[A-Za-z]')) AS a FROM documents)")
def contact_list(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct mail addresses of the documents."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z.]*[A-Za-z]"), F.lit(0))
    return E.contacts(read_table(spark, folder, "documents"), found).select("email", F.substring_index("email", "@", 1).alias("local"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def recent_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The last three orders of each customer."""
    o = read_table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return E.most_recent(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT max(c_custkey) + 1 AS next_id FROM customer")
def next_customer_id(spark: SparkSession, folder: str) -> DataFrame:
    """The next free customer number."""
    return E.next_id(read_table(spark, folder, "customer"), "c_custkey")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(CASE WHEN c_nationkey = 3 THEN c_acctbal + 100 ELSE c_acctbal END), 4) AS balance FROM customer WHERE c_acctbal >= 0 GROUP BY c_mktsegment")
def updated_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts after a credit to one nation and the removal of overdrawn ones."""
    kept, _ = E.delete(read_table(spark, folder, "customer"), F.col("c_acctbal") < 0)
    after = E.update(kept, F.col("c_nationkey") == 3, {"c_acctbal": F.col("c_acctbal") + 100, "c_name": None})
    return after.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 4).alias("balance"))


_SQL_PATHS = "WITH n AS (SELECT coalesce(suite, 'none') || '/' || coalesce(lower(lang), 'none') || '/' || doc_id AS path, md5(text) AS content FROM documents)"


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("suite", F.lit("none")), F.coalesce(F.lower("lang"), F.lit("none")), "doc_id")
    return read_table(spark, folder, "documents").select(path.alias("path"), F.md5("text").alias("content"))


@query(_SQL_PATHS + "SELECT split_part(path, '/', 2) AS name, count(*) AS nodes FROM n WHERE starts_with(path, 'workspace/') GROUP BY 1")
def directory_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Names below a directory of the document tree."""
    return E.listing(_paths(spark, folder), "workspace")


@query(_SQL_PATHS + "SELECT CASE WHEN starts_with(path, 'workspace/') THEN 'archive/w/' || substr(path, 11) ELSE path END AS path, content FROM n")
def moved_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The document tree with one directory moved."""
    return E.move_tree(_paths(spark, folder), "workspace", "archive/w")


@query(
    _SQL_PATHS
    + """, a AS (SELECT path, content FROM n WHERE length(path) % 5 <> 0), b AS (SELECT path, CASE WHEN length(path) % 7 = 0 THEN 'edited' ELSE content END AS content FROM n WHERE length(path) % 3 <> 0)
    SELECT CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.content IS NOT DISTINCT FROM b.content THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM a FULL JOIN b USING (path) GROUP BY 1"""
)
def merged_trees(spark: SparkSession, folder: str) -> DataFrame:
    """States of paths after merging two versions of the tree."""
    n = _paths(spark, folder)
    local = n.where(F.length("path") % 5 != 0)
    remote = n.where(F.length("path") % 3 != 0).withColumn("content", F.when(F.length("path") % 7 == 0, F.lit("edited")).otherwise(F.col("content")))
    return E.merge_trees(local, remote, local_wins=True).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT suite_name, count(DISTINCT u.t || '|' || i.t) AS pairs FROM (SELECT DISTINCT suite_name, user_task_id AS t FROM trace_case) u JOIN (SELECT DISTINCT suite_name, injection_task_id AS t FROM trace_case WHERE injection_task_id IS NOT NULL) i USING (suite_name) GROUP BY suite_name")
def task_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """User tasks times injection tasks of each suite."""
    c = read_table(spark, folder, "trace_case")
    u, i = (c.where(F.col(x).isNotNull()).select("suite_name", x).distinct() for x in ("user_task_id", "injection_task_id"))
    return u.join(i, "suite_name").groupBy("suite_name").agg(F.count("*").alias("pairs"))


@query("SELECT defense, CASE WHEN defense = 'tagger' AND tool_name LIKE 'get_%' THEN 'allow' WHEN defense = 'tagger' AND latency_ms > 400 THEN 'deny' WHEN defense = 'data_filter' THEN 'allow' ELSE 'deny' END AS effect, count(*) AS n FROM defense_event GROUP BY ALL")
def policy_check(spark: SparkSession, folder: str) -> DataFrame:
    """Calls allowed and denied by the first matching rule of their defense; without one they are denied."""
    rules = spark.createDataFrame([("tagger", 1, "allow", "^get_", None), ("tagger", 2, "deny", None, 400), ("data_filter", 1, "allow", None, None)], "defense string, priority int, effect string, pattern string, over int")
    calls = read_table(spark, folder, "defense_event").select("event_no", "defense", "tool_name", "latency_ms")
    matches = (F.col("pattern").isNull() | F.expr("tool_name rlike pattern")) & (F.col("over").isNull() | (F.col("latency_ms") > F.col("over"))) & F.col("effect").isNotNull()
    return E.first_rule(calls, "event_no", rules, "defense", "priority", "effect", matches).join(calls, "event_no").groupBy("defense", "effect").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 4) AS c_acctbal FROM customer WHERE c_custkey = 42 UNION ALL SELECT NULL, mail.doc, mail.owner, NULL FROM (SELECT doc_id::VARCHAR AS doc, origin_key AS owner FROM documents WHERE doc_id = 7) mail")
def looked_up(spark: SparkSession, folder: str) -> DataFrame:
    """An account and a file by their ids, a field inside a record by its path."""
    account = E.lookup(read_table(spark, folder, "customer"), {"c_custkey": 42}, ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 4))
    files = read_table(spark, folder, "documents").select("doc_id", F.struct(F.col("doc_id").cast("string").alias("doc"), F.struct(F.col("origin_key").alias("owner")).alias("meta")).alias("file"))
    found = E.lookup(files, {"doc_id": 7}, ["file.doc", "file.meta.owner"])
    return account.unionByName(found.select(F.lit(None).cast("long").alias("c_custkey"), F.col("doc").alias("c_name"), F.col("owner").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal")))


@query(
    """
    WITH n AS (SELECT doc_id, origin_key, suite, row_number() OVER (ORDER BY origin_key NULLS FIRST, suite NULLS FIRST, doc_id) AS k FROM documents WHERE source = 'chat_log'),
    t AS (SELECT doc_id AS id, suite, origin_key FROM documents WHERE source <> 'chat_log' OR source IS NULL)
    SELECT id, suite, origin_key FROM t UNION ALL SELECT (SELECT max(id) FROM t) + k, suite, origin_key FROM n"""
)
def appended_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A table of records with new ones numbered on from its largest id, in the order of their columns."""
    d = read_table(spark, folder, "documents")
    table = d.where("source <> 'chat_log' or source is null").select(F.col("doc_id").alias("id"), "origin_key", "suite")
    return E.append(table, d.where("source = 'chat_log'").select("origin_key", "suite"), "id").select("id", "suite", "origin_key")


@query("SELECT p_brand AS key, max(p_retailprice)::DOUBLE AS value FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') GROUP BY p_brand")
def price_map(spark: SparkSession, folder: str) -> DataFrame:
    """The map of the asked names to their largest value, as its entries."""
    asked = read_table(spark, folder, "part").where(F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#33")).withColumn("price", F.col("p_retailprice").cast("double"))
    return E.as_map(asked, "p_brand", "price").select(F.explode("map").alias("key", "value"))


@query("SELECT c AS channel, count(*) AS users FROM (SELECT user_id, unnest(list_distinct(list(event_type))) AS c FROM events GROUP BY user_id) WHERE c IN (SELECT min(event_type) FROM events) GROUP BY c")
def channel_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members of a channel, from the list of channels that each user has."""
    e = read_table(spark, folder, "events")
    users = e.groupBy("user_id").agg(F.collect_set("event_type").alias("channels"))
    first = e.agg(F.min("event_type").alias("channel"))
    joined = users.crossJoin(F.broadcast(first))
    return E.members_of(joined.withColumn("c", F.col("channel")), "c", "channels", F.col("channel")).groupBy(F.col("c").alias("channel")).agg(F.count("*").alias("users"))


@query("SELECT p_partkey FROM part WHERE p_size = 7")
def required_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that a query must find."""
    return E.require(E.search(read_table(spark, folder, "part"), equal={"p_size": 7}), "part").select("p_partkey")


@query(_SQL_PATHS + "SELECT path, content FROM n UNION ALL SELECT 'copies/' || substr(path, 11), content FROM n WHERE starts_with(path, 'workspace/')")
def copied_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The document tree with a copy of one directory."""
    return E.copy_tree(_paths(spark, folder), "workspace", "copies")


@query("SELECT case_id, 'Go to ' || suite_name || ' with ' || CASE WHEN case_id % 2 = 0 THEN user_task_id ELSE 'nothing' END || ' and {other}' AS text FROM trace_case WHERE suite_name IS NOT NULL AND user_task_id IS NOT NULL")
def filled_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Templates filled with values where there are some, else with defaults; unknown names stay."""
    c = read_table(spark, folder, "trace_case").where("suite_name is not null and user_task_id is not null")
    values = F.map_concat(F.create_map(F.lit("suite"), "suite_name", F.lit("unknown"), "suite_name"), F.when(F.col("case_id") % 2 == 0, F.create_map(F.lit("task"), "user_task_id")).otherwise(F.create_map().cast("map<string,string>")))
    return c.select("case_id", E.filled_with_defaults(F.lit("Go to {suite} with {task} and {other}"), values, F.create_map(F.lit("suite"), F.lit("home"), F.lit("task"), F.lit("nothing"))).alias("text"))
