"""Deterministic sampling: order always comes from hashes of keys, so reruns and layouts agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.contracts import checkpointed
from quern.operators.windows import batch_of, bottom_k, numbered_in_groups


def digest(*parts: Column, separator: str = "\0") -> Column:
    """SHA-256 hex of the parts' texts joined by ``separator``."""
    return F.sha2(F.concat_ws(separator, *[p.cast("string") for p in parts]), 256)


def hash_bottom_k(rows: DataFrame, label: str, key: str, row_number: str, k: int, seed: int = 0) -> DataFrame:
    """The k rows of each label with the smallest digests of (seed, label, key, row)."""
    ranked = rows.withColumn("digest", digest(F.lit(seed), F.trim(label), F.col(key), F.col(row_number)))
    return bottom_k(ranked, label, ["digest", row_number], k)


def class_counts(rows: DataFrame, sampled: DataFrame, label: str) -> DataFrame:
    """Rows and sampled rows of each label."""
    took = sampled.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("n_sampled"))
    counts = rows.groupBy(label).agg(F.count("*").alias("n_rows"))
    return counts.join(took, F.col(label) == F.col("_l"), "left").select(label, "n_rows", F.coalesce("n_sampled", F.lit(0)).alias("n_sampled"))


def one_per_parent(rows: DataFrame, key: str, parent: str, label: str, seed: int = 0) -> DataFrame:
    """One label of each (key, parent), the one with the smallest digest."""
    d = digest(F.lit(seed), F.col(key), F.col(parent), F.col(label), separator=":")
    return rows.groupBy(key, parent).agg(F.min_by(label, F.struct(d, F.col(label))).alias(label))


def resample(items: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement by weight: draws and items meet by cumulative weight in buckets, not all against all.

    ``items`` (shards, sources) may be large; its running totals come from one window over it, so it should
    be the smaller side, as shard lists are.
    """
    spark = items.sparkSession
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = items.where(F.col(weight) > 0).withColumn("_hi", F.sum(F.col(weight).cast("double")).over(w))
    total = items.where(F.col(weight) > 0).agg(F.sum(F.col(weight).cast("double"))).first()[0]
    buckets = 1024
    place = lambda c: F.floor(c / F.lit(total) * buckets).cast("int")
    cum = cum.withColumn("_lo", F.col("_hi") - F.col(weight))
    spread = cum.select(key, "_lo", "_hi", F.explode(F.sequence(place(F.col("_lo")), F.least(place(F.col("_hi")), F.lit(buckets - 1)))).alias("_b"))
    unit = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / float(1 << 52) * total
    draws = spark.range(n).select(F.col("id").alias("draw"), unit.alias("_u")).withColumn("_d", place(F.col("_u")))
    return draws.join(spread, (F.col("_d") == F.col("_b")) & (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select("draw", key)


def shuffled_batches(rows: DataFrame, key: str, size: int, epoch: int = 0, seed: int = 0) -> DataFrame:
    """A permutation of the rows for each epoch, cut into batches."""
    from quern.operators.windows import with_row_number

    mixed = rows.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed + epoch)))
    return with_row_number(mixed, "_h", [key]).withColumn("batch", batch_of(F.col("row_number"), size)).drop("_h")


def balanced_pairs(rows: DataFrame, label: str, key: str, classes: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Batches of ``classes`` classes with two items each.

    Items of a class are paired in hash order (a last odd one waits for another epoch); a class's i-th pair goes to
    round i, and the classes of a round are cut into batches in hash order, so no batch has a class twice.
    """
    mark = digest(F.lit(seed), F.lit(epoch), F.col(key), separator=":")
    placed = numbered_in_groups(rows.select(label, key, mark.alias("_d")), label, "_d", [key])
    paired = placed.where(F.col("_place") + 1 <= F.col("_size") - F.col("_size") % 2)
    paired = paired.withColumns({"round": F.floor(F.col("_place") / 2), "item": F.col("_place") % 2})
    turn = F.dense_rank().over(Window.partitionBy("round").orderBy(digest(F.lit(seed), F.lit(epoch), F.col(label), F.col("round"), separator=":"), label)) - 1
    return paired.withColumn("batch", F.floor(turn / classes)).select("round", "batch", label, "item", key)


def distinct_image_batches(rows: DataFrame, label: str, item: str, image: str, classes: int, parts: int = 4, seed: int = 0) -> DataFrame:
    """Batches of ``classes`` classes with two items of different images, no image twice in a batch.

    A class's items are numbered in the order of their images' digests, and number i is paired with number i + half: the two have different
    images unless one image has over half of the class. The pairs of all classes then fill batches: a class's i-th pair goes to round i, the
    classes of a round in hash order. A batch that is short or holds an image twice dissolves, and its pairs
    are dealt anew in the next pass; after ``parts`` passes the rest waits for another epoch, as a last short batch does.
    Numbers come from counts of digest prefixes, so a hot class is no task's alone; each pass is two shuffles of ids.

    Returns ``part`` (the pass), ``batch, label, item, image``.
    """
    slim = rows.select(F.col(label).cast("string").alias("label"), F.col(item).cast("long").alias("item"), F.col(image).cast("string").alias("image"))
    slim = slim.where("label IS NOT NULL AND item IS NOT NULL AND image IS NOT NULL").dropDuplicates(["label", "item"])
    order = F.concat(digest(F.lit(seed), F.col("image"), separator=":"), digest(F.lit(seed), F.col("item"), separator=":"))
    placed = numbered_in_groups(slim.withColumn("_d", order), "label", "_d", ["item"])
    half = F.floor(F.col("_size") / 2)
    placed = placed.where(F.col("_place") < 2 * half).withColumn("_pair", F.pmod(F.col("_place"), half))
    pairs = placed.groupBy("label", "_pair").agg(F.array_sort(F.collect_list(F.struct("item", "image"))).alias("two"))
    open_ = checkpointed(pairs.where(F.col("two")[0]["image"] != F.col("two")[1]["image"]))
    in_round, done = -(-open_.agg(F.count_distinct("label")).first()[0] // classes), None
    for n in range(parts):
        mark = digest(F.lit(seed), F.lit(n), F.col("label"), F.col("_pair"), separator=":")
        dealt = numbered_in_groups(open_.withColumn("_d", mark), "label", "_d", ["_pair"]).withColumnRenamed("_place", "round")
        turn = F.row_number().over(Window.partitionBy("round").orderBy(digest(F.lit(seed), F.lit(n), F.col("label"), F.col("round"), separator=":"), "label")) - 1
        dealt = checkpointed(dealt.withColumn("batch", F.col("round") * in_round + F.floor(turn / classes)).select("label", "_pair", "two", "batch"))
        whole = dealt.select("batch", "label", F.explode("two").alias("x")).groupBy("batch").agg(F.count_distinct("label").alias("n"), F.count_distinct("x.image").alias("m"))
        whole = whole.where((F.col("n") == classes) & (F.col("m") == 2 * classes)).select("batch")
        won = dealt.join(whole, "batch", "left_semi").withColumn("part", F.lit(n))
        done = won if done is None else done.unionByName(won)
        open_ = checkpointed(dealt.join(whole, "batch", "left_anti").select("label", "_pair", "two"))
    return done.select("part", "batch", "label", F.explode("two").alias("x")).select("part", "batch", "label", "x.item", "x.image")


def donors(rows: DataFrame, parent: str, leaf: str, image: str, seed: int = 0) -> DataFrame:
    """For every row a donor image of the next leaf (cyclic) of its parent, starting at a digest's place, never of the same image.

    Leaves are numbered in each parent, and images in each leaf by their order; the row meets the image at its place of the next leaf through
    equi-joins on (parent, leaf number) and (leaf, place). Where that is the row's own image, the next different one of the leaf stands in, and rows for which
    the next leaf has no other image go to the following leaves; parents with one leaf give nothing. No row carries the images of a leaf.
    """
    leaves = rows.select(parent, leaf).distinct()
    number = F.row_number().over(Window.partitionBy(parent).orderBy(leaf)) - 1
    numbered = leaves.select(F.col(parent).alias("_p"), F.col(leaf).alias("_f"), number.alias("_i"), F.count("*").over(Window.partitionBy(parent)).alias("_n"))
    keys = [F.col(parent).alias("_q"), F.col(leaf).alias("_g")]
    placed = rows.where(F.col(image).isNotNull()).select(*keys, F.col(image).alias("_image"))
    placed = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_q", "_g").orderBy("_image")) - 1)
    ring = Window.partitionBy("_q", "_g").orderBy("_image")
    later = placed.select("_q", "_g", "_image").distinct().withColumn("_later", F.lead("_image").over(ring))
    sizes = placed.groupBy(F.col("_q").alias("_q2"), F.col("_g").alias("_g2")).agg(F.count("*").alias("_size"), F.min("_image").alias("_first"))
    later = later.select(F.col("_q").alias("_q1"), F.col("_g").alias("_g1"), F.col("_image").alias("_image1"), "_later")
    donors_ = placed.join(later, (F.col("_q") == F.col("_q1")) & (F.col("_g") == F.col("_g1")) & (F.col("_image") == F.col("_image1")))
    donors_ = donors_.select(F.col("_q").alias("_q1"), F.col("_g").alias("_g1"), "_at", "_image", "_later")
    leaf_of = numbered.select(F.col("_p").alias("_q"), F.col("_f").alias("_g"), F.col("_i").alias("_j"))
    leaf_of = leaf_of.join(sizes, (F.col("_q") == F.col("_q2")) & (F.col("_g") == F.col("_g2"))).select("_q", "_g", "_j", "_size", "_first")
    own = rows.where(F.col(image).isNotNull()).join(numbered, (F.col(parent) == F.col("_p")) & (F.col(leaf) == F.col("_f"))).where("_n > 1")
    start = F.conv(F.substring(digest(F.lit(seed), F.col(parent), F.col(leaf), F.col(image), separator=":"), 1, 16), 16, 10).cast("decimal(20,0)")
    own = own.select(parent, leaf, image, "_i", "_n", start.alias("_start"))

    def met(asked):
        found = asked.join(leaf_of, (F.col(parent) == F.col("_q")) & ((F.col("_i") + F.col("_step")) % F.col("_n") == F.col("_j"))).drop("_q")
        found = found.withColumn("_place", (F.col("_start") % F.col("_size")).cast("int"))
        found = found.join(donors_, (F.col(parent) == F.col("_q1")) & (F.col("_g") == F.col("_g1")) & (F.col("_place") == F.col("_at")))
        other = F.coalesce("_later", F.when(F.col("_first") != F.col(image), F.col("_first")))
        return found.withColumn("_donor", F.when(F.col("_image") != F.col(image), F.col("_image")).otherwise(other))

    first = checkpointed(met(own.withColumn("_step", F.lit(1))).select(parent, leaf, image, "_i", "_n", "_start", "_step", "_g", "_donor"))
    rest = first.where("_donor IS NULL").select(parent, leaf, image, "_i", "_n", "_start").unionByName(own.join(leaf_of.select("_q", "_j"), (F.col(parent) == F.col("_q")) & ((F.col("_i") + 1) % F.col("_n") == F.col("_j")), "left_anti"))
    rest = met(rest.where("_n > 2").withColumn("_step", F.explode(F.sequence(F.lit(2), F.col("_n") - 1))))
    best = first.select(parent, leaf, image, "_step", "_g", "_donor").unionByName(rest.select(parent, leaf, image, "_step", "_g", "_donor")).where("_donor IS NOT NULL")
    return best.groupBy(parent, leaf, image).agg(F.min_by("_g", "_step").alias("donor_leaf"), F.min_by("_donor", "_step").alias("donor"))
