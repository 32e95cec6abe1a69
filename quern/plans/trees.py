"""Nested arrays, class trees, sampling and splits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import nested as N
from quern.operators import hierarchy as H
from quern.operators import sampling as S
from quern.operators import splits as P
from quern.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_PAIRS = "(SELECT l_orderkey, list(DISTINCT {label: l_returnflag, name: l_linestatus}) AS pairs FROM lineitem GROUP BY l_orderkey)"


def _pairs(spark, d):
    pairs = F.array_sort(F.collect_set(F.struct(F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("name"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(pairs.alias("pairs"))


def _shown(pairs):
    return F.array_join(F.array_sort(F.transform(pairs, lambda p: F.concat(p["label"], p["name"]))), ";")


@query(f"SELECT l_orderkey, array_to_string(list_sort([p.label || p.name FOR p IN pairs IF p.label IN ('A', 'N')]), ';') AS kept FROM {_PAIRS} WHERE len([p FOR p IN pairs IF p.label IN ('A', 'N')]) > 0")
def array_retain_in_set(spark, d):
    kept = _pairs(spark, d).withColumn("pairs", N.retain(F.col("pairs"), F.array(F.lit("A"), F.lit("N")))).where(F.size("pairs") > 0)
    return kept.select("l_orderkey", _shown(F.col("pairs")).alias("kept"))


@query(f"SELECT l_orderkey, array_to_string(list_sort([p.label || p.name FOR p IN pairs IF p.label <> 'R']), ';') AS kept, len(pairs) - len([p FOR p IN pairs IF p.label <> 'R']) AS n_removed FROM {_PAIRS}")
def array_remove_in_set(spark, d):
    rows = _pairs(spark, d).withColumn("left", N.remove(F.col("pairs"), F.array(F.lit("R"))))
    return rows.select("l_orderkey", _shown(F.col("left")).alias("kept"), (F.size("pairs") - F.size("left")).alias("n_removed"))


@query("SELECT l_orderkey, l_returnflag AS label, l_linestatus AS name FROM lineitem GROUP BY ALL")
def explode_aligned(spark, d):
    zipped = _pairs(spark, d).select("l_orderkey", N.zip_labels(N.labels_of(F.col("pairs")), N.names_of(F.col("pairs"))).alias("z"))
    return zipped.select("l_orderkey", F.explode("z").alias("p")).select("l_orderkey", "p.label", "p.name")


@query("SELECT o_custkey, to_json(list_sort(list(DISTINCT o_orderstatus))) AS labels FROM orders GROUP BY o_custkey")
def json_array_round_trip(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_set("o_orderstatus"))).alias("text"))
    return rows.select("o_custkey", F.to_json(N.parse_strings(F.col("text"))).alias("labels"))


def _tree(spark, d):
    """root -> region -> nation -> segments of its customers, as a table of nodes."""
    segment = table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    parts = [
        spark.range(1).select(F.lit("root"), F.lit(None).cast("string"), F.lit("Extracted_Root"), F.lit("root")),
        table(spark, d, "region").select(F.concat(F.lit("r_"), "r_regionkey"), F.lit("root"), F.concat(F.lit("/m/r_"), "r_regionkey"), "r_name"),
        table(spark, d, "nation").select(F.concat(F.lit("n_"), "n_nationkey"), F.concat(F.lit("r_"), "n_regionkey"), F.concat(F.lit("/m/n_"), "n_nationkey"), "n_name"),
        segment.select(F.concat_ws("/", F.lit("s"), "c_nationkey", "c_mktsegment"), F.concat(F.lit("n_"), "c_nationkey"), F.concat(F.lit("/m/s_"), "c_mktsegment"), "c_mktsegment"),
    ]
    parts = [p.toDF("node", "parent", "name", "text") for p in parts]
    return H.class_nodes(parts[0].union(parts[1]).union(parts[2]).union(parts[3]), "node", "parent", "node", "name", "text")


def _tree_document(spark, d):
    """The same tree as one class-tree document."""
    segment = table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    leaf = F.struct(F.concat(F.lit("/m/s_"), "c_mktsegment").alias("LabelName"), F.col("c_mktsegment").alias("TextName"))
    segments = segment.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
    nation = table(spark, d, "nation").join(segments, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    node = F.struct(F.concat(F.lit("/m/n_"), "n_nationkey").alias("LabelName"), F.col("n_name").alias("TextName"), F.col("leaves").alias("Subcategory"))
    nations = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(node)).alias("nations"))
    region = table(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    top = F.struct(F.concat(F.lit("/m/r_"), "r_regionkey").alias("LabelName"), F.col("r_name").alias("TextName"), F.col("nations").alias("Subcategory"))
    tops = region.agg(F.array_sort(F.collect_list(top)).alias("tops"))
    root = F.struct(F.lit("Extracted_Root").alias("LabelName"), F.lit("root").alias("TextName"), F.col("tops").alias("Subcategory"))
    return H.flatten_tree(tops.select(F.to_json(root).alias("tree")), "tree")


_NODES = """(SELECT '/m/r_' || r_regionkey AS label, r_name AS text, '/m/r_' || r_regionkey AS top, r_name AS top_text, 1 AS depth, r_regionkey IN (SELECT n_regionkey FROM nation) AS inner_node, 'Extracted_Root' AS parent FROM region
    UNION ALL SELECT '/m/n_' || n_nationkey, n_name, '/m/r_' || n_regionkey, r_name, 2, n_nationkey IN (SELECT c_nationkey FROM customer), '/m/r_' || n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT DISTINCT '/m/s_' || c_mktsegment, c_mktsegment, '/m/r_' || n_regionkey, r_name, 3, false, '/m/n_' || n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"SELECT DISTINCT label FROM {_NODES}")
def tree_labels(spark, d):
    return H.tree_labels(_tree(spark, d))


@query(f"SELECT DISTINCT label FROM {_NODES} WHERE inner_node")
def tree_internal(spark, d):
    return H.internal_labels(_tree(spark, d))


@query(f"SELECT label, arg_min(top, CAST(substr(top, 6) AS int)) AS top_label, count(DISTINCT top) AS n_tops FROM {_NODES} GROUP BY label")
def tree_top_ancestor(spark, d):
    return H.top_ancestors(_tree(spark, d)).select("label", "top_label", "n_tops")


@query(f"SELECT depth, count(*) AS n_nodes, count(DISTINCT label) AS n_labels, count(DISTINCT parent) AS n_parents FROM {_NODES} GROUP BY depth")
def tree_levels(spark, d):
    nodes = _tree_document(spark, d).where("depth > 0")
    return nodes.groupBy("depth").agg(F.count("*").alias("n_nodes"), F.count_distinct("label").alias("n_labels"), F.count_distinct("parent_label").alias("n_parents"))


@query(f"SELECT label, arg_min(top_text, CAST(substr(top, 6) AS int)) AS parent_dir, min(text) AS leaf_dir FROM {_NODES} WHERE NOT inner_node GROUP BY label")
def tree_leaf_paths(spark, d):
    return H.leaf_paths(_tree(spark, d))


@query(f"SELECT top AS top_label, count(*) AS n_children FROM {_NODES} WHERE depth = 2 GROUP BY top HAVING count(*) >= 2")
def tree_top_groups(spark, d):
    return H.top_groups(_tree(spark, d)).select("top_label", "n_children")


@query(
    """WITH n AS (SELECT 'r' || r_regionkey AS id, NULL AS top_id, 0 AS depth, r_regionkey AS r, -1 AS n, -1 AS c, -1 AS o FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey, 1, n_regionkey, n_nationkey, -1, -1 FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || n_nationkey, 2, n_regionkey, n_nationkey, c_custkey, -1 FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'o' || o_orderkey, 'n' || n_nationkey, 3, n_regionkey, n_nationkey, c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT id, top_id, depth, row_number() OVER (ORDER BY r, n, c, o) - 1 AS path,
    CASE depth WHEN 0 THEN count(*) OVER (PARTITION BY r) WHEN 1 THEN count(*) OVER (PARTITION BY r, n) WHEN 2 THEN count(*) OVER (PARTITION BY r, n, c) ELSE 1 END AS subtree_size FROM n"""
)
def tree_preorder(spark, d):
    """Regions, nations, customers and orders as one forest."""
    levels = (("region", "r", "r_regionkey", None, None), ("nation", "n", "n_nationkey", "r", "n_regionkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("orders", "o", "o_orderkey", "c", "o_custkey"))
    nodes = None
    for name, mark, key, up, parent in levels:
        above = F.lit(None).cast("string") if up is None else F.concat(F.lit(up), F.col(parent))
        level = table(spark, d, name).select(F.concat(F.lit(mark), key).alias("node"), above.alias("parent"), F.col(key).cast("long").alias("order"))
        nodes = level if nodes is None else nodes.unionByName(level)
    return H.walk_nodes(nodes, "node", "parent", "order").select("id", "top_id", "depth", "path", "subtree_size")


@query(
    """SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY
    sha256(concat_ws(chr(0), '7', trim(source), CAST(doc_id AS varchar), CAST(doc_id + 2 AS varchar))), doc_id) AS rank FROM documents) WHERE rank <= 5"""
)
def sample_bottomk_per_class(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") + 2).alias("row_no"))
    return S.hash_bottom_k(docs, "source", "doc_id", "row_no", 5, seed=7).select("doc_id", "source", "rank")


@query("SELECT source, count(*) AS n_rows, least(count(*), 5) AS n_sampled FROM documents GROUP BY source")
def sample_class_counts(spark, d):
    return S.class_counts(table(spark, d, "documents"), sample_bottomk_per_class(spark, d), "source")


@query(
    """SELECT s_suppkey, n_regionkey, n_nationkey FROM (SELECT s_suppkey, n.n_regionkey, n.n_nationkey, row_number() OVER (PARTITION BY s_suppkey, n.n_regionkey
    ORDER BY sha256(concat_ws(':', '3', CAST(s_suppkey AS varchar), CAST(n.n_regionkey AS varchar), CAST(n.n_nationkey AS varchar))), n.n_nationkey) AS r
    FROM (SELECT DISTINCT l_suppkey AS s_suppkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) JOIN nation n ON c_nationkey = n.n_nationkey) WHERE r = 1"""
)
def one_label_per_parent(spark, d):
    sold = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sold = sold.select(F.col("l_suppkey").alias("s_suppkey"), "c_nationkey").distinct()
    rows = sold.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return S.one_per_parent(rows, "s_suppkey", "n_regionkey", "n_nationkey", seed=3)


@query()
def weighted_resample(spark, d):
    weights = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("w"))
    return S.resample(weights, "source", "w", 10_000, seed=5)


@query()
def epoch_shuffle_batches(spark, d):
    return S.shuffled_batches(table(spark, d, "events").select("event_id"), "event_id", 128, epoch=2, seed=11)


@query()
def balanced_class_batches(spark, d):
    return S.balanced_pairs(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 4, seed=1)


@query()
def distinct_image_batches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.crc32("text").alias("image"))
    return S.distinct_image_batches(docs, "source", "doc_id", "image", 2)


@query(
    """WITH leaf AS (SELECT c_nationkey AS p, c_mktsegment AS f, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)),
    img AS (SELECT c_nationkey AS p, c_mktsegment AS f, list(c_custkey ORDER BY c_custkey) AS ids FROM customer GROUP BY ALL)
    SELECT c_custkey, t.f AS donor_leaf, t.ids[1 + CAST(CAST(('0x' || substr(sha256('0:' || c_nationkey || ':' || c_mktsegment || ':' || c_custkey), 1, 16)) AS ubigint) % len(t.ids) AS int)] AS donor
    FROM customer JOIN leaf a ON a.p = c_nationkey AND a.f = c_mktsegment JOIN leaf b ON b.p = a.p AND b.i = (a.i + 1) % a.n JOIN img t ON t.p = b.p AND t.f = b.f WHERE a.n > 1"""
)
def donor_assignment(spark, d):
    rows = table(spark, d, "customer")
    return S.donors(rows, "c_nationkey", "c_mktsegment", "c_custkey").select("c_custkey", "donor_leaf", "donor")


@query("SELECT conv_id, turn, dense_rank() OVER (ORDER BY sha256('4:' || conv_id)) <= greatest(1, round((SELECT count(DISTINCT conv_id) FROM conversations) * 0.2)) AS held_out FROM conversations")
def group_holdout_split(spark, d):
    return P.group_holdout(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", 0.2, seed=4)


_TARGETS = """SELECT source, n AS total, b0 + CASE WHEN (r1 > r0)::int + (r2 > r0)::int < rest THEN 1 ELSE 0 END AS train, b1 + CASE WHEN (r0 >= r1)::int + (r2 > r1)::int < rest THEN 1 ELSE 0 END AS validation,
    b1 + CASE WHEN (r0 >= r2)::int + (r1 >= r2)::int < rest THEN 1 ELSE 0 END AS test
    FROM (SELECT source, n, 8 * n // 10 AS b0, n // 10 AS b1, 8 * n % 10 AS r0, n % 10 AS r1, n % 10 AS r2, n - 8 * n // 10 - 2 * (n // 10) AS rest FROM (SELECT source, count(*) AS n FROM documents GROUP BY source))"""


@query(_TARGETS)
def split_targets(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total"))
    return counts.select("source", "total", *[t.alias(s) for s, t in zip(P.SPLITS, P.integer_targets(F.col("total")))])


_SPLIT = """(WITH c AS (SELECT doc_id, coalesce('=' || lang, '') || chr(0) || coalesce('=' || source, '') AS k, count(*) AS n FROM documents GROUP BY ALL),
    g AS (SELECT doc_id, sha256(string_agg(k || ':' || n, chr(1) ORDER BY k || ':' || n)) AS sig FROM c GROUP BY doc_id),
    r AS (SELECT doc_id, (row_number() OVER (ORDER BY sha256(sig), sha256('0:' || doc_id), doc_id) - 1) % 10 AS i FROM g)
    SELECT d.doc_id, d.lang, d.source, CASE i WHEN 4 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM documents d JOIN r ON d.doc_id = r.doc_id)"""


@query(f"SELECT * FROM {_SPLIT}")
def systematic_stratified_split(spark, d):
    return P.systematic_stratified(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"])


@query(
    f"""WITH a AS (SELECT * FROM {_SPLIT}), t AS (SELECT lang, source, split FROM a UNION ALL SELECT '__ALL__', '__ALL__', split FROM a),
    n AS (SELECT lang, source, count(*) AS total, count(*) FILTER (WHERE split = 'train') AS train_actual, count(*) FILTER (WHERE split = 'validation') AS validation_actual,
    count(*) FILTER (WHERE split = 'test') AS test_actual FROM t GROUP BY lang, source),
    b AS (SELECT *, 8 * total // 10 AS b0, total // 10 AS b1, 8 * total % 10 AS r0, total % 10 AS r1, total - 8 * total // 10 - 2 * (total // 10) AS rest FROM n)
    SELECT lang, source, total, train_actual, validation_actual, test_actual, round(train_actual / total, 6) AS train_ratio, round(validation_actual / total, 6) AS validation_ratio,
    round(test_actual / total, 6) AS test_ratio, b0 + CASE WHEN 2 * (r1 > r0)::int < rest THEN 1 ELSE 0 END AS train_target,
    b1 + CASE WHEN (r0 >= r1)::int < rest THEN 1 ELSE 0 END AS validation_target, b1 + CASE WHEN (r0 >= r1)::int + 1 < rest THEN 1 ELSE 0 END AS test_target FROM b"""
)
def split_summary_rollup(spark, d):
    return P.split_summary(systematic_stratified_split(spark, d), ["lang", "source"])


@query()
def greedy_stratified_split(spark, d):
    """Orders as whole groups, stratified by the return flags and states of their lines; the last 5,000 orders one after another."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return P.greedy_stratified(lines, "l_orderkey", ["l_returnflag", "l_linestatus"], last=5_000).distinct()
