"""Files written and read back, guards, limits and decisions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import contracts
from quern.functions import text as X
from quern.operators import aggregates as A
from quern.operators import joins as J
from quern.operators import state as S
from quern.session import table
from quern.sources import readers, sinks

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("""SELECT CAST(n_nationkey AS varchar) AS n_nationkey, n_name || ' "quoted", line' || chr(10) || 'break' AS label, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS blank FROM nation""")
def csv_round_trip(spark, d):
    """Quotes, separators, line breaks and nulls through a CSV table."""
    path = contracts.shared_folder(spark)
    rows = table(spark, d, "nation").withColumn("label", F.concat("n_name", F.lit(' "quoted", line\nbreak')))
    sinks.write_csv(rows.select("n_nationkey", "label", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("blank")), path)
    return readers.read_csv(spark, path, ["n_nationkey", "label", "blank"])


@query("SELECT '/img/' || doc_id || '.jpg' AS image, CAST(doc_id AS varchar) || ' \"' || lang || '\"' || chr(10) || source AS caption FROM documents WHERE doc_id % 3 <> 0 AND lang IS NOT NULL AND source IS NOT NULL")
def captions_round_trip(spark, d):
    """Captions of the rows that succeeded, through a tab-separated table."""
    path = contracts.shared_folder(spark)
    docs = table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    title = F.concat(F.col("doc_id").cast("string"), F.lit(' "'), "lang", F.lit('"\n'), "source")
    rows = docs.select((F.col("doc_id") % 3 != 0).alias("ok"), title.alias("title"), F.concat(F.lit("/img/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("filepath"))
    sinks.write_captions(rows, path, "ok")
    return readers.read_captions(spark, path)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def jsonl_round_trip(spark, d):
    path = contracts.shared_folder(spark)
    sinks.append_metrics(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    return readers.read_jsonl(spark, path, "c_custkey long, c_name string, c_nationkey int")


@query("SELECT substr(sha256('page ' || page_id || chr(9) || url), 1, 16) AS uid, 'page ' || page_id AS caption, url FROM pages WHERE url IS NOT NULL AND NOT contains(url, chr(9)) AND NOT contains(url, chr(10)) AND NOT contains(url, chr(13))")
def url_list(spark, d):
    path = contracts.shared_folder(spark)
    pages = table(spark, d, "pages").where(r"url IS NOT NULL AND NOT url RLIKE '[\t\n\r]'")
    pages.select(F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit("\t"), "url").alias("value")).write.text(path)
    return readers.read_url_list(spark, path)


@query("SELECT page_id, replace(url_encode(url), '%2F', '/') AS quoted FROM pages WHERE url IS NOT NULL")
def quoted_urls(spark, d):
    return table(spark, d, "pages").where("url IS NOT NULL").select("page_id", X.url_quote(F.col("url")).alias("quoted"))


@query("SELECT c_custkey, o_orderkey AS ordinal, o_orderstatus FROM customer JOIN orders ON c_custkey = o_custkey")
def inner_fanout_join(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("ordinal"), "o_orderstatus")
    return J.inner_fanout(table(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"], "ordinal", ["o_orderstatus"])


@query("SELECT o_orderkey, o_custkey FROM orders")
def required_members(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return J.require_members(table(spark, d, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey")


@query("SELECT '/data/' || n_name || '/' || c_custkey || '.jpg' AS path, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def labels_from_folders(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    paths = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("/data/"), "n_name", F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".jpg")).alias("path"))
    return J.label_from_folder(paths, "path", nation, "n_name", "n_nationkey")


@query(
    """SELECT l_orderkey, count(*) AS n_rows FROM lineitem WHERE l_orderkey IN
    (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ORDER BY l_orderkey LIMIT 25) GROUP BY l_orderkey"""
)
def first_pending_ids(spark, d):
    """The first 25 orders that are still open, with all their rows."""
    state = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_orderkey").alias("place"))
    return S.first_pending(rows, state, "l_orderkey", "place", ["F"], 25).groupBy("l_orderkey").agg(F.count("*").alias("n_rows"))


@query(
    """SELECT CAST(c_custkey AS varchar) AS path, length(c_name) AS size, CASE WHEN c_custkey % 4 = 0 THEN 'copied' WHEN c_custkey % 2 = 0 AND c_nationkey = 12 THEN 'existing'
    WHEN c_nationkey > 12 THEN 'overwritten' ELSE 'skipped_conflict' END AS decision FROM customer"""
)
def sync_newer(spark, d):
    """A target that lacks every fourth file, differs in size for odd ones and has one modification time."""
    source = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.length("c_name").alias("size"), F.col("c_nationkey").alias("mtime"), "c_custkey")
    target = source.where("c_custkey % 4 <> 0").select("path", (F.col("size") + F.col("c_custkey") % 2).alias("size"), F.lit(12).alias("mtime"))
    return S.sync_decisions(source, target, policy="newer", compare="mtime")


@query(
    """SELECT coalesce(a.user_id, b.user_id) AS user_id, first_value, last_value, CASE WHEN b.user_id IS NULL THEN 'direct_only' WHEN a.user_id IS NULL THEN 'sync_only' ELSE 'direct_and_sync' END AS source_tables
    FROM (SELECT user_id, arg_min(value, event_id) AS first_value FROM events WHERE event_type = 'purchase' GROUP BY user_id) a
    FULL JOIN (SELECT user_id, arg_max(value, event_id) AS last_value FROM events WHERE event_type = 'click' GROUP BY user_id) b ON a.user_id = b.user_id"""
)
def provenance_first_and_last(spark, d):
    """The first of the direct rows and the last of the synced ones, by event."""
    events = table(spark, d, "events").where("value IS NOT NULL")
    direct = events.where("event_type = 'purchase'").select("user_id", F.col("value").alias("first_value"), "event_id")
    sync = events.where("event_type = 'click'").select("user_id", F.col("value").alias("last_value"), "event_id")
    return J.provenance_merge(direct, sync, "user_id", "first_value", ["last_value"], "event_id")


@query(
    """WITH v AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN r_name ELSE 'nowhere' END AS name FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT v.n_nationkey, coalesce(n.n_nationkey, 100 + r_regionkey) AS resolved FROM v LEFT JOIN nation n ON name = n.n_name LEFT JOIN region ON name = r_name"""
)
def resolve_names(spark, d):
    """Names of nations, of regions and of neither, looked up among nations first."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    third = F.col("n_nationkey") % 3
    values = joined.select("n_nationkey", F.when(third == 0, F.col("n_name")).when(third == 1, F.col("r_name")).otherwise("nowhere").alias("name"))
    domains = [nation.select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("id")), region.select(F.col("r_name").alias("key"), (F.col("r_regionkey") + 100).alias("id"))]
    return J.resolve_first(values, "name", domains, "resolved").select("n_nationkey", "resolved")


@query("SELECT conv_id, arg_max(text, (length(text), -turn)) AS text, string_agg(DISTINCT role, ';' ORDER BY role) AS role FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def longest_text_with_labels(spark, d):
    """The longest text of each conversation with the set of its roles."""
    rows = table(spark, d, "conversations").where(F.trim("text") != "")
    roles = A.union_sets(rows, "conv_id", ["role"])
    return A.one_text(rows, "conv_id", "text", "turn", "longest").join(roles, "conv_id")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    return contracts.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")
