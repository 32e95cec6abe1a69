"""Joins, aggregates, windows and set operations over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import aggregates as A
from quern.operators import joins as J
from quern.operators import windows as W
from quern.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT c.c_custkey AS cust, c_name, o_orderkey, coalesce(o_orderpriority, '') AS o_orderpriority FROM customer c LEFT JOIN orders ON c_custkey = o_custkey")
def left_fanout_join(spark, d):
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("cust"), "c_name")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), "o_orderkey", "o_orderpriority")
    return J.left_fanout(cust, orders, "cust", ["o_orderkey", "o_orderpriority"])


@query("SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def strict_lookup_join(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return J.strict_lookup(nation, table(spark, d, "region"), "r_regionkey", ["r_name"])


@query("SELECT doc_id, coalesce(max(quality), -1) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id")
def lookup_with_default(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return J.lookup_or(table(spark, d, "documents").select("doc_id").distinct(), labels, "doc_id", "quality", -1)


@query("SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_pairs(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").dropDuplicates()


_ALIGNED = """SELECT l_orderkey, to_json(list(l_returnflag ORDER BY l_returnflag, l_linestatus)) AS labels, to_json(list(l_linestatus ORDER BY l_returnflag, l_linestatus)) AS names
    FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem) GROUP BY l_orderkey"""


def _aligned(spark, d) -> DataFrame:
    arrays = A.aligned_arrays(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus")
    return arrays.select("l_orderkey", F.to_json("labels").alias("labels"), F.to_json("names").alias("names"))


@query(_ALIGNED)
def aligned_label_arrays(spark, d):
    return _aligned(spark, d)


@query(f"SELECT o_orderkey, coalesce(labels, '[]') AS labels, coalesce(names, '[]') AS names FROM orders LEFT JOIN ({_ALIGNED}) ON o_orderkey = l_orderkey")
def attach_label_arrays(spark, d):
    grouped = _aligned(spark, d).withColumnRenamed("l_orderkey", "o_orderkey")
    return J.attach_grouped(table(spark, d, "orders").select("o_orderkey"), grouped, "o_orderkey", {"labels": F.lit("[]"), "names": F.lit("[]")})


@query("SELECT conv_id, turn, role FROM conversations WHERE trim(text) <> ''")
def captioned_only(spark, d):
    from quern.functions.text import strip_ws

    return table(spark, d, "conversations").where(strip_ws(F.col("text")) != "").select("conv_id", "turn", "role")


@query("SELECT d.doc_id, lang, source, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE CAST(quality AS varchar) IN ('1', '1.0')")
def confidence_inner_join(spark, d):
    sure = table(spark, d, "labels").where(F.trim(F.col("quality").cast("string")).isin("1", "1.0")).select("doc_id", "toxic")
    return table(spark, d, "documents").join(sure, "doc_id").select("doc_id", "lang", "source", "toxic")


@query(
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, source, quality, toxic,
    CASE WHEN b.doc_id IS NULL THEN 'direct_only' WHEN a.doc_id IS NULL THEN 'sync_only' ELSE 'direct_and_sync' END AS source_tables
    FROM (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id) a FULL JOIN labels b ON a.doc_id = b.doc_id"""
)
def provenance_full_outer(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.lit(0).alias("row"))
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic", F.lit(0).alias("row"))
    return J.provenance_merge(docs, labels, "doc_id", "source", ["quality", "toxic"], "row")


@query(
    """SELECT source_tables, count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id,
    CASE WHEN b.doc_id IS NULL THEN 'direct_only' WHEN a.doc_id IS NULL THEN 'sync_only' ELSE 'direct_and_sync' END AS source_tables
    FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN labels b ON a.doc_id = b.doc_id) GROUP BY source_tables"""
)
def provenance_counts(spark, d):
    return provenance_full_outer(spark, d).groupBy("source_tables").agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_ids"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def semi_anti_report(spark, d):
    found, missing = J.found_and_missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


@query("SELECT a.conv_id, a.turn, a.role, length(b.text) AS n_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.role = b.role WHERE trim(b.text) <> ''")
def composite_key_join(spark, d):
    rows = table(spark, d, "conversations").where(F.trim("text") != "")
    keys = ["conv_id", "turn", "role"]
    return J.composite_join(rows.select(keys), rows, keys, "text", "turn").select(*keys, F.length("text").cast("long").alias("n_chars"))


@query("SELECT conv_id, arg_max(turn, (length(text), -turn)) AS turn, max(length(text)) AS n_chars FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def caption_policy_longest(spark, d):
    rows = table(spark, d, "conversations").where(F.trim("text") != "")
    return rows.groupBy("conv_id").agg(F.max_by("turn", F.struct(F.length("text"), -F.col("turn"))).alias("turn"), F.max(F.length("text")).cast("long").alias("n_chars"))


@query("SELECT conv_id, text FROM conversations c WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def caption_policy_first(spark, d):
    return A.one_text(table(spark, d, "conversations"), "conv_id", "text", "turn", "first")


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS o_orderpriority, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS o_orderstatus FROM orders GROUP BY o_custkey")
def group_union_sets(spark, d):
    return A.union_sets(table(spark, d, "orders"), "o_custkey", ["o_orderpriority", "o_orderstatus"])


@query("SELECT event_type, count(*) AS n_rows FROM events GROUP BY event_type")
def status_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n_rows"))


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def count_distinct(spark, d):
    return table(spark, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT lang, source, count(*) AS n_rows FROM documents GROUP BY lang, source UNION ALL SELECT '__ALL__', '__ALL__', count(*) FROM documents")
def counts_with_total(spark, d):
    return A.counts_with_total(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean, round(sum(l_quantity), 2) AS weight FROM lineitem GROUP BY l_returnflag")
def weighted_batch_mean(spark, d):
    means = A.weighted_mean(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")
    return means.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("weight", 2).alias("weight"))


@query("SELECT p_brand, arg_min(p_name, (lower(p_name), p_name)) AS p_name, count(*) - 1 AS n_others FROM part GROUP BY p_brand")
def smallest_path_by_id(spark, d):
    return A.smallest_path(table(spark, d, "part"), "p_brand", "p_name")


@query("SELECT user_id, min(event_id) AS first_at, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY user_id")
def first_occurrence_codes(spark, d):
    return A.first_occurrence_codes(table(spark, d, "events"), "user_id", "event_id")


@query("SELECT o_custkey, to_json(list(o_orderstatus ORDER BY p, o_orderstatus)) AS choices FROM (SELECT o_custkey, o_orderstatus, min(o_orderpriority) AS p FROM orders GROUP BY ALL) GROUP BY o_custkey")
def priority_choices(spark, d):
    return A.priority_values(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority").select("o_custkey", F.to_json("choices").alias("choices"))


@query("SELECT source, count(*) AS n_rows, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def first_filled_values(spark, d):
    return A.first_filled(table(spark, d, "documents"), "source", ["lang"], "doc_id")


@query("SELECT a.o_custkey AS a, b.o_custkey AS b, count(*) AS n_shared FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders) a JOIN (SELECT DISTINCT o_custkey, o_orderdate FROM orders) b ON a.o_orderdate = b.o_orderdate AND a.o_custkey < b.o_custkey GROUP BY ALL")
def set_overlap_pairs(spark, d):
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderdate").alias("dates"))
    return J.sharing_pairs(sets, "o_custkey", "dates")


@query(
    """SELECT a.o_custkey AS a, b.o_custkey AS b, count(*) AS n_shared FROM (SELECT DISTINCT o_custkey, o_orderpriority || o_orderstatus AS tag FROM orders ) a
    JOIN (SELECT DISTINCT o_custkey, o_orderpriority || o_orderstatus AS tag FROM orders ) b ON a.tag = b.tag AND a.o_custkey < b.o_custkey GROUP BY ALL HAVING count(*) >= 8"""
)
def heavy_overlap_pairs(spark, d):
    """Customers with eight or more kinds of orders in common; every kind is held by many of them."""
    tags = F.collect_set(F.concat("o_orderpriority", "o_orderstatus")).alias("tags")
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(tags)
    return J.sharing_pairs(sets, "o_custkey", "tags", least=8)


@query("SELECT n_nationkey, i AS template_no, replace(t, '{}', n_name) AS prompt FROM nation, (SELECT unnest([0, 1]) AS i, unnest(['a photo of {}.', 'a drawing of {}.']) AS t)")
def class_prompts(spark, d):
    return J.with_templates(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", ["a photo of {}.", "a drawing of {}."]).drop("n_name")


@query("SELECT c_custkey, coalesce(n.n_nationkey, m.r_regionkey) AS resolved FROM customer LEFT JOIN nation n ON c_mktsegment = n.n_name LEFT JOIN region m ON upper(c_mktsegment) = m.r_name")
def resolve_label_domains(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("id"))
    region = table(spark, d, "region").select(F.lower("r_name").alias("key"), F.col("r_regionkey").alias("id"))
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return J.resolve_first(rows, "c_mktsegment", [nation, region], "resolved").select("c_custkey", "resolved")


@query("SELECT user_id, run, event_type, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS n_rows FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS c FROM events)) GROUP BY ALL")
def contiguous_runs(spark, d):
    return W.contiguous_runs(table(spark, d, "events"), "user_id", "event_id", "event_type")


def _numbered(spark, d):
    return W.with_row_number(table(spark, d, "events").select("event_id", "event_type"), "event_id")


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) % 7 AS shard FROM events")
def strided_shards(spark, d):
    return _numbered(spark, d).select("event_id", W.shard_of(F.col("row_number"), 7).alias("shard"))


@query("SELECT event_id, (r - 1) // 64 AS batch FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r, count(*) OVER () AS n FROM events) WHERE ((r - 1) // 64 + 1) * 64 <= n")
def batches_drop_last(spark, d):
    return W.full_batches(_numbered(spark, d), 64).select("event_id", "batch")


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 500 + 1 AS part_no FROM events")
def part_numbers(spark, d):
    return _numbered(spark, d).select("event_id", (W.batch_of(F.col("row_number"), 500) + 1).alias("part_no"))


@query("SELECT event_type, count(*) AS n_samples, CAST(ceil(ceil(count(*) / 256.0) / 4) * 4 AS bigint) AS num_batches, CAST(ceil(ceil(count(*) / 256.0) / 4) * 4 * 256 AS bigint) AS num_samples FROM events GROUP BY event_type")
def epoch_rounding(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n_samples"))
    batches = (F.ceil(F.ceil(F.col("n_samples") / 256) / 4) * 4).cast("long")
    return counts.select("event_type", "n_samples", batches.alias("num_batches"), (batches * 256).alias("num_samples"))


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS is_last FROM events")
def last_flags(spark, d):
    return W.last_flag(table(spark, d, "events"), "user_id", "event_id").select("event_id", "is_last")


@query("SELECT vec_id, label, turn FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS turn FROM embeddings) ORDER BY turn, label, vec_id LIMIT 100")
def round_robin_balanced(spark, d):
    return W.round_robin(table(spark, d, "embeddings").select("vec_id", "label"), "label", ["vec_id"], 100)


@query("SELECT user_id, event_id, row_number() OVER w AS rank, count(*) OVER (PARTITION BY user_id) AS candidates FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)")
def ranked_candidates(spark, d):
    return W.ranked_with_count(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", [F.desc("value"), "event_id"]).drop("value")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def top_by_value(spark, d):
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(50)


@query("SELECT p_brand, dense_rank() OVER (ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS int)) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def natural_sort(spark, d):
    from pyspark.sql import Window

    from quern.functions.text import natural_key

    brands = table(spark, d, "part").select("p_brand").distinct()
    # One row a brand, whatever the size of the table, so that one task may sort them.
    return brands.withColumn("place", F.dense_rank().over(Window.orderBy(natural_key(F.col("p_brand")))))


@query("SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark UNION ALL SELECT conv_id, text FROM conversations")
def union_all_parts(spark, d):
    parts = [("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id")]
    return reduce(DataFrame.unionByName, [table(spark, d, t).select(F.col(k).alias("id"), "text") for t, k in parts])


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_ids(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("SELECT l_orderkey AS o_orderkey FROM lineitem INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def intersect_ids(spark, d):
    open_ = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).intersect(open_)


@query("SELECT count(*) AS n_missing FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem)")
def completeness_check(spark, d):
    expected = table(spark, d, "orders").select("o_orderkey")
    return expected.exceptAll(table(spark, d, "lineitem").select("l_orderkey").distinct()).agg(F.count("*").alias("n_missing"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n_values FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 1")
def dependency_violations(spark, d):
    from quern.contracts import dependency_violations as check

    return check(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT doc_id, lang, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) >= 2)")
def groups_with_two_members(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    wide = docs.groupBy("source").agg(F.count_distinct("lang").alias("n")).where("n >= 2").select("source")
    return docs.join(wide, "source", "left_semi").select("doc_id", "lang", "source")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL AND isfinite(value) AND value < 1000")
def candidate_predicate(spark, d):
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v < 1000)
    return table(spark, d, "events").where(F.col("event_type").isin("click", "purchase") & ok).select("event_id", "user_id")


@query("SELECT conv_id, CAST(sum(length(text)) AS bigint) AS n_chars, count(*) AS n_turns FROM conversations GROUP BY conv_id HAVING min(length(text)) * 50 >= max(length(text))")
def aspect_filter(spark, d):
    """Groups whose smallest side is not far below the largest."""
    sides = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n_chars"), F.count("*").alias("n_turns"), F.min(F.length("text")).alias("lo"), F.max(F.length("text")).alias("hi"))
    return sides.where(F.col("lo") * 50 >= F.col("hi")).select("conv_id", "n_chars", "n_turns")


@query("SELECT user_id, round(sum(value) / count(*), 3) AS mean, count(*) AS n FROM events GROUP BY user_id")
def mergeable_mean(spark, d):
    """Running means merged from (sum, count) parts of each event type."""
    parts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return parts.groupBy("user_id").agg(F.round(F.sum("s") / F.sum("n"), 3).alias("mean"), F.sum("n").alias("n"))


@query("SELECT n_regionkey, count(*) AS n_samples FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def shard_size_totals(spark, d):
    sizes = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("shard")).agg(F.count("*").alias("n"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("shard"), "n_regionkey")
    return nation.join(sizes, "shard").groupBy("n_regionkey").agg(F.sum("n").alias("n_samples"))


@query("SELECT conv_id, count(DISTINCT role) AS n_roles, round(count(DISTINCT role) * 1.0 / count(*), 6) AS unique_share FROM conversations GROUP BY conv_id")
def unique_fraction(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_distinct("role").alias("n_roles"), F.round(F.count_distinct("role") / F.count("*"), 6).alias("unique_share"))
