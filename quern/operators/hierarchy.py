"""Class trees: JSON documents flattened by a recursive query, node tables by pointer doubling, and the label sets that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.contracts import checkpointed, shared_folder
from quern.operators.windows import in_ranges

_FLATTEN = """
WITH RECURSIVE walk(node, label, text, parent_label, top_label, top_text, path, depth) AS (
    SELECT root, root:{label}::string, root:{text}::string, CAST(NULL AS string), CAST(NULL AS string), CAST(NULL AS string), array(0), 0
    FROM {{roots}}
    UNION ALL
    SELECT child.value, child.value:{label}::string, child.value:{text}::string, walk.label,
           CASE WHEN walk.depth = 0 THEN child.value:{label}::string ELSE walk.top_label END,
           CASE WHEN walk.depth = 0 THEN child.value:{text}::string ELSE walk.top_text END,
           concat(walk.path, array(child.pos)), walk.depth + 1
    FROM walk, LATERAL variant_explode(variant_get(walk.node, '$.{children}', 'variant')) AS child
)
SELECT label, text, parent_label, top_label, top_text, path, depth,
       variant_get(node, '$.{children}[0]', 'variant') IS NULL AS is_leaf
FROM walk
"""


def flatten_tree(documents: DataFrame, column: str, label: str = "LabelName", text: str = "TextName", children: str = "Subcategory") -> DataFrame:
    """Nodes of JSON class trees, with parent, top ancestor, place (pre-order path) and depth; the root has depth 0.

    The tree is walked level by level inside the plan; trees of other child lists (``children``) are ignored.
    """
    roots = documents.select(F.parse_json(column).alias("root"))
    sql = _FLATTEN.format(label=label, text=text, children=children)
    return documents.sparkSession.sql(sql, roots=roots)


def _doubled(state: DataFrame, n: int, step) -> DataFrame:
    """Pointers ``up`` of (id, up, ...) doubled until all have left their root: log2 of the depth rounds. ``step`` makes a round's next state."""
    spark = state.sparkSession
    for _ in range(n.bit_length() + 1):
        if state.where("up IS NOT NULL").isEmpty():
            return state
        # A table, as the optimizer's constraints of a checkpointed plan double with each round.
        path = shared_folder(spark)
        step(state).write.parquet(path)
        state = spark.read.parquet(path)
    raise ValueError("the node table has a cycle")


def _grow(state: DataFrame) -> DataFrame:
    """Each node's ``size`` goes to the node 2^i levels above it, and its pointer jumps as far again."""
    open_ = state.where("up IS NOT NULL")
    sizes = state.select("id", "size").unionByName(open_.select(F.col("up").alias("id"), "size")).groupBy("id").agg(F.sum("size").alias("size"))
    above = state.where("up IS NOT NULL").select(F.col("id").alias("_i"), F.col("up").alias("_u"))
    jumps = open_.join(above, F.col("up") == F.col("_i")).select(F.col("id").alias("_j"), F.col("_u"))
    return sizes.join(jumps, F.col("id") == F.col("_j"), "left").select("id", F.col("_u").alias("up"), "size")


def _climb(state: DataFrame) -> DataFrame:
    """Sums of ``weight`` and ``depth`` over twice as many ancestors, and the highest one below the root among them."""
    above = state.select(F.col("id").alias("_i"), F.col("up").alias("_u"), F.col("weight").alias("_w"), F.col("depth").alias("_d"), F.col("top").alias("_t"))
    met = state.where("up IS NOT NULL").join(above, F.col("up") == F.col("_i"))
    top = F.when(F.col("_d") == 0, F.col("top")).otherwise(F.col("_t"))
    met = met.select("id", F.col("_u").alias("up"), (F.col("weight") + F.col("_w")).alias("weight"), (F.col("depth") + F.col("_d")).alias("depth"), top.alias("top"))
    return state.where("up IS NULL").unionByName(met)


def walk_nodes(nodes: DataFrame, key: str, parent: str, order: str) -> DataFrame:
    """Depth, place and size of every node of a table of nodes with their parents, whatever the depth or width of the trees.

    Siblings, and the roots, stand in the order of ``order``, then ``key``. Pointer doubling over the inner nodes, those that are some
    node's parent, gives subtree sizes, then sums along the way to the root: a node's place in pre-order is the sum of one, and the sizes of
    earlier siblings, over it and its ancestors. Each round is a few equi-joins and an aggregate; rounds grow with the logarithm of the depth.
    Leaves, mostly the bulk of a tree, take no part in the rounds: they count in their parent's size and take depth and place from it at the end.
    Siblings are numbered within ranges of (parent, order) with a summary for each, so no task holds all children of a node. All rows move three times: by
    key, by range and by (range, parent).

    A parent that is null or no node makes a root; rows without key take no part and repeated rows count once; a key with two parents or
    orders and a cycle are a ValueError; an empty table gives an empty result.

    Returns ``id, parent_id, depth`` (0 for a root), ``top_id`` (the ancestor of depth 1 or the node itself; null for a root),
    ``path`` (place in pre-order from 0), ``subtree_size`` (itself included) and ``is_leaf``.
    """
    named = F.col(parent)
    if nodes.schema[key].dataType != nodes.schema[parent].dataType:  # the key's type, unless that would be another value
        cast = named.try_cast(nodes.schema[key].dataType)
        named = F.when(cast == named, cast)
    rows = nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), named.alias("named"), F.col(order).alias("o"))
    facts = F.struct("named", "o")
    one = rows.groupBy("id").agg(F.min(facts).alias("low"), F.max(facts).alias("high"))
    parents = rows.where("named IS NOT NULL").select(F.col("named").alias("_p")).distinct()
    met = one.join(parents, F.col("id") == F.col("_p"), "full")
    rows = checkpointed(met.select("id", "low.named", "low.o", "_p", (F.col("low") != F.col("high")).alias("twice")))
    n_inner, n_unknown, twice = rows.agg(F.count_if(F.col("id").isNotNull() & F.col("_p").isNotNull()), F.count_if(F.col("id").isNull()), F.coalesce(F.bool_or("twice"), F.lit(False))).first()
    if twice:
        raise ValueError("a node has two parents or orders")
    up = F.col("named")
    unknown = rows.where("id IS NULL").select(F.col("_p").alias("_u"))
    rows = rows.where("id IS NOT NULL")
    if n_unknown:
        rows, up = rows.join(unknown, F.col("named") == F.col("_u"), "left"), F.when(F.col("_u").isNull(), F.col("named"))
    rows = rows.select(up.alias("up"), F.struct("o", F.col("id").alias("k")).alias("place"), F.col("_p").isNotNull().alias("inner"))
    dealt = in_ranges(rows, "up", "place")

    # A range is one partition, so that numbers follow (parent, order) in it; the project with the number keeps the sort from being dropped.
    numbered = dealt.sortWithinPartitions("up", "place").withColumn("_at", F.monotonically_increasing_id())
    families = checkpointed(numbered.groupBy("_range", "up").agg(F.count("*").alias("n"), F.count_if(~F.col("inner")).alias("leaves"), F.min("_at").alias("_first")))
    leaves = families.groupBy(F.col("up").alias("_k")).agg(F.sum("leaves").alias("leaves"))
    inner = numbered.where("inner").select(F.col("place.k").alias("id"), "up", "place", "_range", "_at")
    inner = checkpointed(inner.join(leaves, F.col("id") == F.col("_k")).select(*inner.columns, (F.col("leaves") + 1).alias("size")))
    sizes = _doubled(inner.select("id", "up", "size"), n_inner, _grow)
    sized = checkpointed(inner.drop("size").join(sizes.select(F.col("id").alias("_s"), "size"), F.col("id") == F.col("_s")).drop("_s"))

    earlier = lambda size, w: F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = sized.select("_range", "up", (F.col("size") - 1).alias("n"), F.lit(None).cast("long").alias("_first"))
    borders = families.select("_range", "up", "n", "_first").unionByName(more).groupBy(F.col("_range").alias("_r"), F.col("up").alias("_u")).agg(F.sum("n").alias("n"), F.min("_first").alias("_first"))
    borders = checkpointed(borders.select("_r", "_u", "_first", earlier("n", Window.partitionBy("_u").orderBy("_r")).alias("_before")))
    beside = sized.withColumn("_beside", earlier(F.col("size") - 1, Window.partitionBy("_range", "up").orderBy("_at")))
    beside = beside.join(borders, (F.col("_range") == F.col("_r")) & F.col("up").eqNullSafe(F.col("_u")))
    weight = F.col("_before") + F.col("_at") - F.col("_first") + F.col("_beside") + F.col("up").isNotNull().cast("long")
    state = checkpointed(beside.select("id", "up", weight.alias("weight"), F.col("up").isNotNull().cast("int").alias("depth"), F.col("id").alias("top")))
    walked = _doubled(state, n_inner, _climb).select(F.col("id").alias("_i"), "weight", "depth", "top")

    # A head stands before the rows of each (range, parent): the place, depth and top ancestor that they take from their parent.
    heads = borders.join(walked, F.col("_u") == F.col("_i"), "left")
    first = F.col("_before") + F.coalesce(F.col("weight") + 1, F.lit(0))
    heads = heads.select(F.col("_r").alias("_range"), F.col("_u").alias("up"), first.alias("size"), F.coalesce(F.col("depth") + 1, F.lit(0)).alias("depth"), F.when(F.col("depth") > 0, F.col("top")).alias("top"))
    rows = dealt.where("NOT inner").select("_range", "up", "place", F.lit(1).cast("long").alias("size")).unionByName(sized.select("_range", "up", "place", "size"))
    w = Window.partitionBy("_range", "up").orderBy("place")
    joined = rows.unionByName(heads, allowMissingColumns=True)
    joined = joined.withColumns({"path": earlier("size", w), "depth": F.first("depth").over(w), "top": F.first("top").over(w)}).where("place IS NOT NULL")
    top = F.when(F.col("depth") == 1, F.col("place.k")).when(F.col("depth") > 1, F.col("top")).alias("top_id")
    return joined.select(F.col("place.k").alias("id"), F.col("up").alias("parent_id"), "depth", top, "path", F.col("size").alias("subtree_size"), (F.col("size") == 1).alias("is_leaf"))


def class_nodes(nodes: DataFrame, key: str, parent: str, order: str, label: str, text: str) -> DataFrame:
    """A table of class nodes in the columns of :func:`flatten_tree`, for the functions below; ``path`` is the place in pre-order.

    A label may stand at several nodes, as it may in a document.
    """
    names = nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(label).alias("label"), F.col(text).alias("text")).dropDuplicates(["_k"])
    named = lambda side: names.select(F.col("_k").alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in ("label", "text")])
    met = walk_nodes(nodes, key, parent, order).join(names, F.col("id") == F.col("_k"))
    met = met.join(named("parent"), F.col("parent_id") == F.col("_parent"), "left").join(named("top"), F.col("top_id") == F.col("_top"), "left")
    return met.select("label", "text", "parent_label", "top_label", "top_text", "path", "depth", "is_leaf")


def tree_labels(nodes: DataFrame, prefix: str = "/m/") -> DataFrame:
    return nodes.where(F.col("label").startswith(prefix)).select("label").distinct()


def internal_labels(nodes: DataFrame, prefix: str = "/m/") -> DataFrame:
    return nodes.where(F.col("label").startswith(prefix) & ~F.col("is_leaf")).select("label").distinct()


def top_ancestors(nodes: DataFrame, prefix: str = "/m/", policy: str = "first") -> DataFrame:
    """Label to top class; a label under several takes the first in pre-order, or is an error; ``n_tops`` counts them."""
    below = nodes.where((F.col("depth") >= 1) & F.col("label").startswith(prefix))
    tops = below.groupBy("label").agg(
        F.min_by("top_label", "path").alias("top_label"), F.min_by("top_text", "path").alias("top_text"), F.count_distinct("top_label").alias("n_tops")
    )
    if policy == "error":
        return tops.withColumn("n_tops", F.when(F.col("n_tops") > 1, F.raise_error(F.lit("label under several tops")).cast("long")).otherwise(F.col("n_tops")))
    return tops


def leaf_paths(nodes: DataFrame, prefix: str = "/m/") -> DataFrame:
    """Leaf label to (top name, leaf name) as safe directory names; the first leaf in pre-order wins."""
    from quern.functions.text import safe_name

    leaves = nodes.where(F.col("is_leaf") & F.col("label").startswith(prefix))
    first = leaves.groupBy("label").agg(F.min_by(F.struct("top_text", "text"), "path").alias("n"))
    return first.select("label", safe_name(F.col("n.top_text")).alias("parent_dir"), safe_name(F.col("n.text")).alias("leaf_dir"))


def top_groups(nodes: DataFrame, least: int = 2) -> DataFrame:
    """Top classes with at least ``least`` direct children."""
    return nodes.where("depth = 2").groupBy("top_label").agg(F.count("*").alias("n_children"), F.array_sort(F.collect_set("text")).alias("children")).where(F.col("n_children") >= least)
