"""Vector search, mining and evaluation metrics over the embeddings table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import matching, neighbors
from quern.operators import metrics as M
from quern.session import table

QUERIES, ORACLE_SQL = {}, {}
DIM = 64


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


_E = "(SELECT vec_id, label, embedding::double[] AS v FROM embeddings)"
_SIM = f"(SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, list_cosine_similarity(a.v, b.v) AS s FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id)"


def _nearest(where: str, k: int) -> str:
    return f"SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY round(s, 12) DESC, b) AS r FROM {_SIM} WHERE {where} QUALIFY r <= {k}"


def _best(where: str) -> str:
    return f"SELECT a, arg_max(b, (round(s, 12), -b)) AS b, arg_max(s, (round(s, 12), -b)) AS s FROM {_SIM} WHERE {where} GROUP BY a"


@query(f"SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN v])), 6) AS norm, round(list_sum([x * x FOR x IN v]) / sqrt(list_sum([x * x FOR x IN v])) / sqrt(list_sum([x * x FOR x IN v])), 6) AS unit FROM {_E}")
def vector_norms(spark, d):
    rows = _vectors(spark, d)
    u = V.normalise(F.col("v"))
    return rows.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(V.dot(u, u), 6).alias("unit"))


@query(f"SELECT a AS source_id, CAST(r AS int) AS rank, b AS neighbour_id, round(s, 6) AS value FROM ({_nearest('la <> lb', 5)})")
def knn_cross_label_topk(spark, d):
    found = neighbors.knn(_vectors(spark, d), "vec_id", "v", "label", 5, rule="other")
    return found.withColumn("value", F.round("value", 6))


@query(f"SELECT a AS source_id, max(CASE WHEN r = 1 THEN b END) AS top1_id, max(CASE WHEN r = 2 THEN b END) AS top2_id, max(CASE WHEN r = 1 THEN round(s, 6) END) AS top1_value, max(CASE WHEN r = 2 THEN round(s, 6) END) AS top2_value FROM ({_nearest('la = lb', 2)}) WHERE s > 0.2 GROUP BY a")
def knn_wide_threshold(spark, d):
    wide = neighbors.wide_neighbours(neighbors.knn(_vectors(spark, d), "vec_id", "v", "label", 2, rule="same"), 2, 0.2)
    return wide.withColumns({f"top{i}_value": F.round(f"top{i}_value", 6) for i in (1, 2)})


@query(f"SELECT a.vec_id AS source_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 12), b.vec_id) AS int) AS rank, b.vec_id AS neighbour_id, round(list_distance(a.v, b.v), 6) AS value FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id QUALIFY rank <= 3")
def knn_euclidean(spark, d):
    found = neighbors.knn(_vectors(spark, d), "vec_id", "v", "label", 3, metric="euclidean")
    return found.withColumn("value", F.round("value", 6))


@query(f"SELECT a.vec_id AS source_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_sum([abs(t[1] - t[2]) FOR t IN list_zip(a.v, b.v)]), 12), b.vec_id) AS int) AS rank, b.vec_id AS neighbour_id, round(list_sum([abs(t[1] - t[2]) FOR t IN list_zip(a.v, b.v)]), 6) AS value FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id QUALIFY rank <= 2")
def knn_manhattan(spark, d):
    found = neighbors.knn(_vectors(spark, d), "vec_id", "v", "label", 2, metric="manhattan")
    return found.withColumn("value", F.round("value", 6))


@query(f"SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM {_E} a JOIN {_E} b ON a.label = b.label AND a.vec_id < b.vec_id")
def pairs_within_category(spark, d):
    return neighbors.pairs_within(_vectors(spark, d), "vec_id", "label", "v").withColumn("cosine", F.round("cosine", 6))


_CENT = f"(SELECT label, [x / sqrt(list_sum([y * y FOR y IN m])) FOR x IN m] AS w FROM (SELECT label, list(mean ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS mean FROM (SELECT label, unnest(range(1, {DIM + 1})) AS i, unnest([x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v]) AS x FROM {_E}) GROUP BY label, i) GROUP BY label))"


@query(f"SELECT a.label AS row_label, b.label AS col_label, round(list_cosine_similarity(a.w, b.w), 6) AS cosine FROM {_CENT} a JOIN {_CENT} b ON a.label <= b.label")
def pair_matrix(spark, d):
    """Similarity matrix of the categories, upper half with the diagonal."""
    cent = M.class_centroids(_vectors(spark, d), "label", "v", DIM)
    other = cent.select(F.col("label").alias("col_label"), F.col("centroid").alias("w"))
    pairs = cent.join(F.broadcast(other), F.col("label") <= F.col("col_label"))
    return pairs.select(F.col("label").alias("row_label"), "col_label", F.round(V.dot(F.col("centroid"), F.col("w")), 6).alias("cosine"))


@query(
    f"""SELECT e.vec_id AS anchor_id, e.label, p.b AS positive_id, round(p.s, 6) AS positive_value, n.b AS negative_id, round(n.s, 6) AS negative_value,
    CASE WHEN p.b IS NULL THEN 'no_positive' WHEN n.b IS NULL THEN 'no_hard_negative' ELSE 'ok' END AS status
    FROM embeddings e LEFT JOIN ({_best('la = lb')}) p ON p.a = e.vec_id LEFT JOIN ({_best('la <> lb')}) n ON n.a = e.vec_id"""
)
def hard_negative_triplets(spark, d):
    found = neighbors.triplets(_vectors(spark, d), "vec_id", "v", "label")
    return found.withColumns({"positive_value": F.round("positive_value", 6), "negative_value": F.round("negative_value", 6)})


@query(f"SELECT round(avg(CAST(e.label = f.label AS int)), 6) AS accuracy FROM ({_nearest('true', 1)}) JOIN embeddings e ON e.vec_id = a JOIN embeddings f ON f.vec_id = b")
def knn_1nn_accuracy(spark, d):
    rows = _vectors(spark, d)
    tags = rows.select(F.col("vec_id").alias("i"), "label")
    found = neighbors.knn(rows, "vec_id", "v", "label", 1).join(tags, F.col("source_id") == F.col("i")).drop("i")
    found = found.join(tags.select("i", F.col("label").alias("other")), F.col("neighbour_id") == F.col("i"))
    return found.agg(F.round(F.avg((F.col("label") == F.col("other")).cast("double")), 6).alias("accuracy"))


@query(f"SELECT k, round(avg(CAST(hit <= k AS int)), 6) AS recall FROM (SELECT a, coalesce(min(CASE WHEN e.label = f.label THEN r END), 99) AS hit FROM ({_nearest('true', 10)}) JOIN embeddings e ON e.vec_id = a JOIN embeddings f ON f.vec_id = b GROUP BY a), (SELECT unnest([1, 5, 10]) AS k) GROUP BY k")
def recall_at_k(spark, d):
    rows = _vectors(spark, d)
    tags = rows.select(F.col("vec_id").alias("i"), "label")
    found = neighbors.knn(rows, "vec_id", "v", "label", 10).join(tags, F.col("source_id") == F.col("i")).drop("i")
    found = found.join(tags.select("i", F.col("label").alias("other")), F.col("neighbour_id") == F.col("i"))
    hits = found.groupBy("source_id").agg(F.coalesce(F.min(F.when(F.col("label") == F.col("other"), F.col("rank"))), F.lit(99)).alias("hit"))
    return hits.select("hit", F.explode(F.array(*map(F.lit, (1, 5, 10)))).alias("k")).groupBy("k").agg(F.round(F.avg((F.col("hit") <= F.col("k")).cast("double")), 6).alias("recall"))


@query()
def greedy_pairs(spark, d):
    found = neighbors.knn(_vectors(spark, d), "vec_id", "v", "label", 10, rule="other")
    return matching.greedy_pairs(found, "source_id", "neighbour_id", "value")


_MAP = "(SELECT vec_id, label, [x * least(n, 1.0) / n * tan(least(n, 1.0)) / least(n, 1.0) FOR x IN v] AS h FROM (SELECT *, sqrt(list_sum([y * y FOR y IN v])) AS n FROM {0}))".format(_E)


@query(f"SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN h])), 6) AS radius FROM {_MAP}")
def hypersphere_radius(spark, d):
    return _vectors(spark, d).select("vec_id", F.round(V.norm(V.exp_map(F.col("v"))), 6).alias("radius"))


@query(
    f"""SELECT a.label, round(avg(acos(least(greatest(1 - 2 * power(list_distance(a.h, b.h), 2) / ((1 + list_inner_product(a.h, a.h)) * (1 + list_inner_product(b.h, b.h))), -1 + 1e-7), 1 - 1e-7))), 5) AS mean_distance
    FROM {_MAP} a JOIN (SELECT label, min(vec_id) AS m FROM embeddings GROUP BY label) c ON a.label = c.label JOIN {_MAP} b ON b.vec_id = c.m WHERE a.vec_id <> b.vec_id GROUP BY a.label"""
)
def geodesic_to_first(spark, d):
    rows = _vectors(spark, d).select("vec_id", "label", V.exp_map(F.col("v")).alias("h"))
    first = rows.groupBy(F.col("label").alias("c")).agg(F.min_by(F.struct("vec_id", "h"), "vec_id").alias("f"))
    far = rows.join(first, F.col("label") == F.col("c")).where("vec_id <> f.vec_id")
    return far.groupBy("label").agg(F.round(F.avg(V.geodesic(F.col("h"), F.col("f.h"))), 5).alias("mean_distance"))


@query(f"SELECT label, round(w[1], 6) AS first, round(list_sum([x * x FOR x IN w]), 6) AS norm2 FROM {_CENT}")
def zero_shot_centroids(spark, d):
    cent = M.class_centroids(_vectors(spark, d), "label", "v", DIM)
    return cent.select("label", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(V.dot(F.col("centroid"), F.col("centroid")), 6).alias("norm2"))


_LOGITS = f"(SELECT e.vec_id, e.label, c.label AS class, 100 * list_cosine_similarity(e.v, c.w) AS logit FROM {_E} e, {_CENT} c)"
_RANKED = f"(SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) / sum(exp(logit - t)) OVER (PARTITION BY vec_id) AS probability, row_number() OVER (PARTITION BY vec_id ORDER BY round(logit, 9) DESC, class) AS rank FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS t FROM {_LOGITS}))"


def _zero_shot(spark, d):
    rows = _vectors(spark, d)
    return M.zero_shot(rows, M.class_centroids(rows, "label", "v", DIM), "vec_id", "v", "label")


@query(f"SELECT vec_id, class, CAST(rank AS int) AS rank, round(probability, 6) AS probability FROM {_RANKED} WHERE rank <= 5")
def zero_shot_topk(spark, d):
    return _zero_shot(spark, d).where("rank <= 5").select("vec_id", "class", "rank", F.round("probability", 6).alias("probability"))


@query(f"SELECT count(*) AS n_rows, round(avg(CAST(rank <= 1 AS int)), 6) AS top1, round(avg(CAST(rank <= 5 AS int)), 6) AS top5 FROM {_RANKED} WHERE class = label")
def topk_accuracy(spark, d):
    return M.topk_accuracy(_zero_shot(spark, d)).select("n_rows", F.round("top1", 6).alias("top1"), F.round("top5", 6).alias("top5"))


@query(f"SELECT round(avg(rank - 1) + 1, 6) AS mean_rank, floor(median(rank - 1)) + 1 AS median_rank, round(avg(CAST(rank - 1 < 1 AS int)), 6) AS recall_at_1, round(avg(CAST(rank - 1 < 5 AS int)), 6) AS recall_at_5, round(avg(CAST(rank - 1 < 10 AS int)), 6) AS recall_at_10 FROM {_RANKED} WHERE class = label")
def retrieval_ranks(spark, d):
    """Each vector retrieves its class among all classes."""
    places = _zero_shot(spark, d).where("class = label").select((F.col("rank") - 1).alias("place"))
    found = M.retrieval(places)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


_CL = f"(SELECT a.label AS r, b.label AS c, 10 * list_cosine_similarity(a.w, b.w) AS s FROM {_CENT} a, {_CENT} b)"


@query(f"SELECT round(avg((lr + lc) / 2 - s), 6) AS loss FROM (SELECT *, ln(sum(exp(s)) OVER (PARTITION BY r)) AS lr, ln(sum(exp(s)) OVER (PARTITION BY c)) AS lc FROM {_CL}) WHERE r = c")
def contrastive_loss(spark, d):
    cent = M.class_centroids(_vectors(spark, d), "label", "v", DIM)
    other = cent.select(F.col("label").alias("c"), F.col("centroid").alias("w"))
    logits = cent.select(F.col("label").alias("r"), "centroid").join(F.broadcast(other), F.lit(True)).select("r", "c", (10 * V.dot(F.col("centroid"), F.col("w"))).alias("s"))
    return M.contrastive_loss(logits, "r", "c", "s").select(F.round("loss", 6).alias("loss"))


@query(f"SELECT round(avg(loss), 6) AS loss FROM (SELECT vec_id, sum(-u * ln(probability)) AS loss FROM (SELECT *, exp(logit / 2) / sum(exp(logit / 2)) OVER (PARTITION BY vec_id) AS u FROM {_RANKED}) GROUP BY vec_id)")
def soft_loss(spark, d):
    """Cross entropy of the class distribution against a softer teacher with half the logits."""
    scored = _zero_shot(spark, d)
    teacher = F.exp(F.col("logit") / 2) / F.sum(F.exp(F.col("logit") / 2)).over(Window.partitionBy("vec_id"))
    terms = scored.withColumn("t", teacher).groupBy("vec_id").agg(F.sum(M.soft_target_loss(F.col("probability"), F.col("t"))).alias("loss"))
    return terms.agg(F.round(F.avg("loss"), 6).alias("loss"))


@query(f"SELECT round(avg(CASE WHEN n.s > p.s THEN n.s ELSE ln(exp(p.s / 0.1) + exp(n.s / 0.1)) - p.s / 0.1 END), 6) AS loss, round(avg(CAST(n.s > p.s AS int)), 6) AS hard_share, round(avg(greatest(n.s - 0.2, 0)), 6) AS margin_loss FROM ({_best('la = lb')}) p JOIN ({_best('la <> lb')}) n ON p.a = n.a")
def sct_loss(spark, d):
    t = neighbors.triplets(_vectors(spark, d), "vec_id", "v", "label").where("status = 'ok'")
    p, n = F.col("positive_value"), F.col("negative_value")
    return t.agg(
        F.round(F.avg(M.triplet_terms(p, n)), 6).alias("loss"), F.round(F.avg((n > p).cast("double")), 6).alias("hard_share"), F.round(F.avg(M.margin_term(n, 0.2)), 6).alias("margin_loss")
    )


@query("SELECT range AS step, round(CASE WHEN range < 100 THEN 0.001 * (range + 1) / 100 ELSE 0.5 * (1 + cos(pi() * (range - 100) / 900)) * 0.001 END, 9) AS cosine, round(0.001 * power(0.5, range // 250), 9) AS stepped FROM range(1000)")
def lr_schedule(spark, d):
    step = F.col("step")
    return spark.range(1000).select(F.col("id").alias("step")).select(
        "step", F.round(M.warmup_cosine(step, 1000, 100, 1e-3), 9).alias("cosine"), F.round(M.step_decay(step, 250, 1e-3, 0.5), 9).alias("stepped")
    )


@query("SELECT user_id, round(1 / (1 / sum(value) + 1.0 / count(*)), 6) AS pairs_per_second FROM events GROUP BY user_id")
def harmonic_throughput(spark, d):
    sums = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("a"), F.count("*").cast("double").alias("b"))
    return sums.select("user_id", F.round(M.harmonic_throughput(F.col("a"), F.col("b")), 6).alias("pairs_per_second"))


@query(
    f"""SELECT round(avg(loss), 6) AS loss, count(*) AS n_anchors FROM (SELECT a, ln(sum(exp(s / 0.1))) - sum(CASE WHEN la = lb THEN s END) / 0.1 / count(*) FILTER (WHERE la = lb) AS loss
    FROM {_SIM} GROUP BY a HAVING count(*) FILTER (WHERE la = lb) > 0)"""
)
def supcon_loss(spark, d):
    """Supervised contrastive loss over all vectors, averaged over anchors that have positives."""
    sums = neighbors.contrastive_sums(_vectors(spark, d), "vec_id", "v", "label", 0.1).where("n_positive > 0")
    loss = F.col("log_mass") - F.col("positive_sum") / F.col("n_positive") / 0.1
    return sums.agg(F.round(F.avg(loss), 6).alias("loss"), F.count("*").alias("n_anchors"))


@query(
    f"""WITH p AS (SELECT vec_id, label, v, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 2 AS batch, count(*) OVER (PARTITION BY label) AS n FROM {_E}),
    q AS (SELECT * FROM p WHERE (batch + 1) * 2 <= n)
    SELECT a.batch, a.vec_id AS a, max(CASE WHEN a.label = b.label THEN b.vec_id END) AS positive,
    arg_max(b.vec_id, (round(list_cosine_similarity(a.v, b.v), 12), -b.vec_id)) FILTER (WHERE a.label <> b.label) AS negative
    FROM q a JOIN q b ON a.batch = b.batch AND a.vec_id <> b.vec_id GROUP BY ALL"""
)
def batch_hard_negatives(spark, d):
    """Batches of two vectors of every label: the positive and the hardest negative in each."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = _vectors(spark, d).withColumns({"batch": F.floor(place / 2), "n": F.count("*").over(Window.partitionBy("label"))})
    return neighbors.batch_positives(rows.where((F.col("batch") + 1) * 2 <= F.col("n")), "batch", "vec_id", "label", "v")


@query(f"SELECT round(avg(CAST(list_has_any([e.label, e.label // 2 + 100], [f.label, f.label // 2 + 100]) AS int)), 6) AS accuracy FROM ({_nearest('true', 1)}) JOIN embeddings e ON e.vec_id = a JOIN embeddings f ON f.vec_id = b")
def knn_overlap_accuracy(spark, d):
    """Share of vectors whose nearest neighbour shares one of its labels, with two labels each."""
    rows = _vectors(spark, d)
    tags = rows.select(F.col("vec_id").alias("i"), F.array(F.col("label"), F.floor(F.col("label") / 2).cast("int") + 100).alias("tags"))
    found = neighbors.knn(rows, "vec_id", "v", "label", 1).join(tags, F.col("source_id") == F.col("i")).drop("i")
    found = found.join(tags.select("i", F.col("tags").alias("others")), F.col("neighbour_id") == F.col("i"))
    return found.agg(F.round(F.avg(F.arrays_overlap("tags", "others").cast("double")), 6).alias("accuracy"))


_PARENT = "CASE WHEN {0} = 0 THEN -1 ELSE {0} // 3 END"


def _with_parent(rows):
    parent = F.when(F.col("label") == 0, -1).otherwise(F.floor(F.col("label") / 3))
    return rows.withColumn("parent", parent)


@query(
    f"""SELECT e.vec_id AS source_id, CAST(coalesce(r, 0) AS int) AS rank, b AS neighbour_id, round(s, 6) AS value, coalesce(c, 0) AS candidate_count FROM embeddings e LEFT JOIN
    (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY round(s, 12) DESC, b) AS r, count(*) OVER (PARTITION BY a) AS c FROM {_SIM}
    WHERE la <> lb AND {_PARENT.format('la')} = {_PARENT.format('lb')} QUALIFY r <= 3) ON a = e.vec_id"""
)
def knn_in_parent(spark, d):
    """Neighbours of another label with the same parent; label 0 has a parent of its own and so no candidates."""
    found = neighbors.knn_in_scope(_with_parent(_vectors(spark, d)), "vec_id", "v", "label", "parent", 3)
    return found.withColumn("value", F.round("value", 6))


@query(
    f"""WITH t AS (SELECT vec_id, v, {_PARENT.format('label')} AS parent, CASE WHEN vec_id % 97 = 5 THEN [vec_id + 1000] ELSE [CAST(label AS bigint), CAST(label // 2 + 100 AS bigint)] END AS tags FROM {_E}),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_has_any(a.tags, b.tags) AS same, a.parent = b.parent AS near, list_cosine_similarity(a.v, b.v) AS s FROM t a JOIN t b ON a.vec_id <> b.vec_id),
    p AS (SELECT a, arg_max(b, (round(s, 12), -b)) AS b, arg_max(s, (round(s, 12), -b)) AS s FROM s WHERE same GROUP BY a),
    n AS (SELECT a, arg_max(b, (round(s, 12), -b)) AS b, arg_max(s, (round(s, 12), -b)) AS s FROM s WHERE NOT same AND near GROUP BY a)
    SELECT t.vec_id AS anchor_id, p.b AS positive_id, round(p.s, 6) AS positive_value, n.b AS negative_id, round(n.s, 6) AS negative_value,
    CASE WHEN p.b IS NULL THEN 'no_positive' WHEN n.b IS NULL THEN 'no_hard_negative' ELSE 'ok' END AS status FROM t LEFT JOIN p ON p.a = t.vec_id LEFT JOIN n ON n.a = t.vec_id"""
)
def label_set_triplets(spark, d):
    """Triplets over two labels each and negatives of the same parent; every 97th vector has a label that no other has."""
    alone = F.col("vec_id") % 97 == 5
    tags = F.when(alone, F.array(F.col("vec_id") + 1000)).otherwise(F.array(F.col("label").cast("long"), F.floor(F.col("label") / 2) + 100))
    found = neighbors.triplets(_with_parent(_vectors(spark, d)).withColumn("tags", tags), "vec_id", "v", "tags", scope="parent")
    return found.drop("label").withColumns({"positive_value": F.round("positive_value", 6), "negative_value": F.round("negative_value", 6)})


@query(f"SELECT count(*) AS n_rows, round(avg(CAST(list_contains([label, label // 2 * 2, label // 2 * 2 + 1], class) AS int)), 6) AS top1 FROM {_RANKED} WHERE rank = 1")
def multi_label_top1(spark, d):
    """Each vector may be of either label of a pair."""
    half = F.floor(F.col("label") / 2).cast("int") * 2
    ranked = _zero_shot(spark, d).withColumn("labels", F.array(F.col("label").cast("int"), half, half + 1)).withColumn("class", F.col("class").cast("int"))
    return M.multi_label_top1(ranked).withColumn("top1", F.round("top1", 6))


_GEO = "acos(least(greatest(1 - 2 * power(list_distance(a.h, b.h), 2) / ((1 + list_inner_product(a.h, a.h)) * (1 + list_inner_product(b.h, b.h))), -1 + 1e-7), 1 - 1e-7))"
_GEOS = f"(SELECT a.vec_id AS a, a.label = b.label AS same, {_GEO} AS g FROM {_MAP} a JOIN {_MAP} b ON a.vec_id <> b.vec_id)"


@query(
    f"""SELECT round(avg(loss), 5) AS loss, round(sum(ps) / sum(np), 5) AS positive_distance, round(sum(ns) / sum(nn), 5) AS negative_distance FROM (SELECT a, ln(sum(exp(-g / 0.1))) + sum(g) FILTER (WHERE same) / 0.1 / count(*) FILTER (WHERE same) AS loss,
    sum(g) FILTER (WHERE same) AS ps, count(*) FILTER (WHERE same) AS np, sum(g) FILTER (WHERE NOT same) AS ns, count(*) FILTER (WHERE NOT same) AS nn FROM {_GEOS} GROUP BY a HAVING count(*) FILTER (WHERE same) > 0)"""
)
def supcon_geodesic(spark, d):
    """Supervised contrastive loss on distances of the projected hypersphere, and the mean distances of both kinds of pairs."""
    rows = _vectors(spark, d).select("vec_id", "label", V.exp_map(F.col("v")).alias("h"))
    sums = neighbors.contrastive_sums(rows, "vec_id", "h", "label", 0.1, metric="geodesic").where("n_positive > 0")
    loss = F.col("log_mass") - F.col("positive_sum") / F.col("n_positive") / 0.1
    means = [F.round(-F.sum(f"{kind}_sum") / F.sum(f"n_{kind}"), 5).alias(f"{kind}_distance") for kind in ("positive", "negative")]
    return sums.agg(F.round(F.avg(loss), 5).alias("loss"), *means)


@query(
    f"""WITH p AS (SELECT a.vec_id // 2 AS i, a.v AS x, b.v AS y FROM {_E} a JOIN {_E} b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
    s AS (SELECT p.i, q.i AS j, round(list_cosine_similarity(p.x, q.y), 12) AS s FROM p, p q),
    o AS (SELECT i AS o, s AS own FROM s WHERE i = j),
    f AS (SELECT i, count(*) FILTER (WHERE i <> j AND (s > own OR (s = own AND j < i))) AS place FROM s JOIN o ON o = i GROUP BY i),
    g AS (SELECT j, count(*) FILTER (WHERE i <> j AND (s > own OR (s = own AND i < j))) AS place FROM s JOIN o ON o = j GROUP BY j)
    SELECT i AS id, f.place AS place, g.place AS reverse_place FROM f JOIN g ON i = j"""
)
def retrieval_both_ways(spark, d):
    """Even vectors retrieve the odd vector after them, and are retrieved by it."""
    rows = _vectors(spark, d)
    second = rows.select((F.col("vec_id") - 1).alias("_first"), F.col("v").alias("w"))
    pairs = rows.where("vec_id % 2 = 0").join(second, F.col("vec_id") == F.col("_first")).select(F.floor(F.col("vec_id") / 2).alias("pair"), "v", "w")
    return neighbors.paired_places(pairs, "pair", "v", "w")


@query("SELECT range AS step, round(CASE WHEN range < 100 THEN 0.001 * (range + 1) / 100 ELSE 0.001 * power(0.1, (range - 100) / 900.0 * 2) END, 9) AS rate FROM range(1000)")
def exponential_schedule(spark, d):
    step = F.col("id")
    return spark.range(1000).select(step.alias("step"), F.round(M.warmup_exponential(step, 1000, 100, 1e-3, 0.1, 2.0), 9).alias("rate"))


@query()
def pca_variance(spark, d):
    """Explained variance of the first components; the projection's signs are free."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = _vectors(spark, d).select(array_to_vector("v").alias("v"))
    shares = PCA(k=8, inputCol="v", outputCol="p").fit(rows).explainedVariance
    return spark.createDataFrame([(i, round(float(x), 9)) for i, x in enumerate(shares)], "component int, share double")


@query()
def fourier_mixed(spark, d):
    """For every vector as an 8 x 8 image, its nearest neighbour of another label with the vector's low amplitudes."""
    from quern.functions.arrays2d import amplitude_mixer

    rows = _vectors(spark, d)
    near = neighbors.knn(rows, "vec_id", "v", "label", 1, rule="other").select("source_id", "neighbour_id")
    both = rows.join(near, F.col("vec_id") == F.col("source_id")).join(rows.select(F.col("vec_id").alias("j"), F.col("v").alias("w")), F.col("neighbour_id") == F.col("j"))
    return both.select("vec_id", amplitude_mixer(8, 8)("w", "v").alias("mixed"))
