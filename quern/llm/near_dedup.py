"""MinHash near-duplicate detection: one-permutation hashing, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LOWER, checkpointed, mix64, right_sized, text_slices, word_hashes, word_spans
from quern.llm.components import connected_components

#: Cells of the shingle counts that order shingles by rarity; any order is right, a rare one first is fast.
GRAM_CELLS = 1 << 20
#: Tasks that compare texts get about this many bytes of bucket members' texts, each counted once a bucket.
TASK_BYTES = 64 << 20
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """For every row the sorted distinct hashes of its word n-grams; a shorter text is one shingle, none without words."""
    starts, ends, rows = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    grams = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        grams += hashes[k : k + len(grams)] * _MIX[k]
    grams = mix64(grams)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = int(b - a)
        if n >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif n:
            short = (hashes[a:b] * _MIX[:n]).sum(dtype=np.uint64) + np.uint64(words - n)
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def one_permutation_signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One hash pass per set, one minimum per bin; empty bins copy a bin chosen by a hash of (bin, attempt)."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    edges = np.arange(bins, dtype=np.uint64) << shift
    signature, full = np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.minimum(np.searchsorted(s, edges), len(s) - 1)
            signature[i] = s[at]
            full[i] = (s[at] >> shift) == np.arange(bins, dtype=np.uint64)
    row, bin_ = np.nonzero(~full & (full.any(axis=1)[:, None]))
    dense, attempt = signature.copy(), 0
    while len(row):
        attempt += 1
        source = (mix64(bin_.astype(np.uint64) * _MIX[10] + np.array([attempt], np.uint64) * _MIX[11]) % np.uint64(bins)).astype(np.int64)
        hit = full[row, source]
        dense[row[hit], bin_[hit]] = signature[row[hit], source[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return dense


def _features(words: int, bands: int, band_rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_bytes", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_slices(batch.column("text")):
                sets = shingle_sets(LOWER[data], offsets, words)
                sig = one_permutation_signatures(sets, bands * band_rows).reshape(len(sets), bands, band_rows)
                key = (sig * _MIX[20 : 20 + band_rows]).sum(axis=2, dtype=np.uint64)
                key = mix64(key + np.arange(bands, dtype=np.uint64) * _MIX[12]).view(np.int64)
                marks = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(sets)).cast(pa.int64()),
                        batch.column("text_key").slice(row, len(sets)),
                        pa.array(np.diff(offsets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(marks[:, 0]),
                        pa.array(marks[:, 1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(key.ravel())),
                    ],
                    schema=schema,
                )

    return run


def _confirm(words: int, percent: int):
    """Keep the pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            sides = []
            for name, text in (("a", "text_a"), ("b", "text_b")):
                # A centre comes in many pairs; its set is built once a batch.
                _, first, place = np.unique(batch.column(name).to_numpy(), return_index=True, return_inverse=True)
                own = [s for _, data, offsets in text_slices(batch.column(text).take(pa.array(first))) for s in shingle_sets(LOWER[data], offsets, words)]
                sides.append([own[i] for i in place])
            keep = []
            for x, y in zip(*sides):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def _gram_cells(words: int):
    """Counts of the texts' shingles by hash cell."""

    def run(batches):
        total = np.zeros(GRAM_CELLS, np.int64)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column("text")):
                grams = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(LOWER[data], offsets, words)])
                total += np.bincount((grams % np.uint64(GRAM_CELLS)).astype(np.int64), minlength=GRAM_CELLS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])

    return run


def _packed_cells(batches):
    """The counts as bytes, so that the driver holds no row for each cell."""
    for batch in batches:
        n = np.minimum(batch.column("n").to_numpy(zero_copy_only=False), np.iinfo(np.int32).max).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([batch.column("cell").to_numpy(zero_copy_only=False).tobytes()]), pa.array([n.tobytes()])], names=["cell", "n"])


def _prefixes(words: int, percent: int, weights):
    """Each text's rarest shingles, so many that two linked sets share one: n - ceil(percent * n / 100) + 1."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_slices(batch.column("text")):
                sets = shingle_sets(LOWER[data], offsets, words)
                grams, sizes = [np.zeros(0, np.uint64)], [len(s) for s in sets]
                takes = [n + percent * n // -100 + 1 if n else 0 for n in sizes]
                for s, take in zip(sets, takes):
                    weight = weights.value[(s % np.uint64(GRAM_CELLS)).astype(np.int64)]
                    grams.append(s[np.lexsort((s, weight))[:take]])
                ids = batch.column("doc_id").slice(row, len(sets)).to_numpy(zero_copy_only=False)
                places = np.concatenate([np.zeros(0, np.int64), *[np.arange(take) for take in takes]])
                columns = [np.concatenate(grams).view(np.int64), np.repeat(ids, takes), np.repeat(np.array(sizes, np.int64), takes), places]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "rep", "n", "place"])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, bands: int = 32, band_rows: int = 4, text_key: bool = False
) -> DataFrame:
    """Group documents linked by Jaccard similarity >= percent / 100 on distinct word shingles.

    Every text is hashed once into ``bands * band_rows`` bins (one permutation, optimal
    densification). Documents with the same set collapse into a class named by its
    smallest id, so groups of copies cost one row per band. In each bucket of a band all
    classes are paired with one centre only, the smallest class: pairs grow with the bucket,
    not its square. Pairs are confirmed on full sets.

    Members of buckets that then still hold several components are searched exactly, split by content: two sets
    with the wanted similarity share one of their rarest shingles (prefix filter: ``n - ceil(percent * n / 100) + 1`` of n
    shingles, in one order for all, by counts in hash cells). In groups of a prefix shingle the untested pairs across components
    that could still be linked are compared: where the group's shingle is the first that two sets share, all they share
    follows it in both (positional filter), so texts that have only a common template behind their own shingles make
    no pair. Shingles that the same texts hold count as one group. Pairs whose set sizes rule the similarity out are left
    out throughout. So the rounds are two, whatever the buckets hold.

    Misses: two linked documents meet in no bucket with probability (1 - J**4)**32, at most
    6e-6 at J = 0.75 (parameters ``bands``, ``band_rows``); a link between members of one bucket is never missed. In a crowd of texts
    that share their rarest shingles, whose similarity lies just below the limit, the pairs compared can be quadratic in the crowd:
    no bound on shared shingles rules them out.

    Nulls and edge cases: null or blank text has no shingle and is linked with nothing;
    rows that share an id count as one document; a row with null id takes no part, with null
    ``component_id`` and ``kept`` true. An empty table gives an empty result. Only the two
    named columns are read.

    Returns ``doc_id, n_shingles, component_id, kept``, a row for each input row; with ``text_key`` also the xxhash64 of its text.
    """
    if (bands * band_rows) & (bands * band_rows - 1):
        raise ValueError("bands * band_rows must be a power of two")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = F.xxhash64(F.coalesce("text", F.lit(""))) if text_key else F.lit(None).cast("long")
    features = texts.withColumn("text_key", key).mapInArrow(_features(words, bands, band_rows), "doc_id long, text_key long, n_bytes long, n_shingles long, k1 long, k2 long, bands array<long>")
    features = checkpointed(features)
    classes = features.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    labelled = features.join(classes, ["k1", "k2"], "left").select("doc_id", "text_key", "n_bytes", "n_shingles", "bands", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep"))
    rows = labelled.where("doc_id = rep").select(F.explode("bands").alias("bucket"), "rep", F.col("n_shingles").alias("n"), "n_bytes")
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("bucket")
    buckets = checkpointed(rows.join(shared, "bucket"))
    n_rows, n_bytes = buckets.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    buckets = buckets.drop("n_bytes")
    sized = lambda df: right_sized(df, n_rows)
    with_text = lambda df: right_sized(df, n_bytes, TASK_BYTES)
    buckets = sized(buckets)
    members = sized(buckets.select("rep").distinct())
    pool = with_text(checkpointed(texts.join(members.withColumnRenamed("rep", "doc_id"), "doc_id")))

    tested = linked = found_parts = None

    def compare(pairs):
        """Confirm the untested ones of ``pairs``; the new links."""
        nonlocal tested
        pairs = sized(pairs.distinct())
        if tested is not None:
            pairs = sized(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        pairs = with_text(pairs.join(pool.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a"))
        pairs = pairs.join(pool.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        new = sized(checkpointed(with_text(pairs).mapInArrow(_confirm(words, percent), "a long, b long, linked boolean")))
        tested = new if tested is None else tested.unionByName(new)
        return new.where("linked").select("a", "b")

    def join_up(found):
        nonlocal linked, found_parts
        linked = found if linked is None else linked.unionByName(found)
        found_parts = connected_components(linked)

    def named(groups):
        parts = groups.drop("component")
        if found_parts is None:
            return parts.withColumn("component", F.col("rep"))
        return sized(parts.join(sized(found_parts), F.col("rep") == F.col("node"), "left")).select(*parts.columns, F.coalesce("component", "rep").alias("component"))

    near_size = lambda m, n: F.least(m, n) * 100 >= F.greatest(m, n) * percent

    def stars(groups):
        """Pair the members of each group with its smallest one."""
        centres = groups.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("c"))
        pairs = sized(groups.join(sized(centres), "bucket")).where("rep <> c.rep").where(near_size(F.col("n"), F.col("c.n")))
        join_up(compare(pairs.select(F.col("c.rep").alias("a"), F.col("rep").alias("b"))))

    def mixed(groups):
        """The members of groups that hold several components."""
        now = checkpointed(named(groups))
        several = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
        return sized(now.join(sized(several), "bucket"))

    stars(buckets)
    open_ = checkpointed(mixed(buckets).select("rep").distinct())
    if not open_.isEmpty():
        texts_open = checkpointed(with_text(pool.join(open_.withColumnRenamed("rep", "doc_id"), "doc_id")))
        cells = texts_open.mapInArrow(_gram_cells(words), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
        weights = np.zeros(GRAM_CELLS, np.int32)
        for part in cells.mapInArrow(_packed_cells, "cell binary, n binary").collect():
            weights[np.frombuffer(part.cell, np.int32)] = np.frombuffer(part.n, np.int32)
        prefixes = texts_open.mapInArrow(_prefixes(words, percent, spark.sparkContext.broadcast(weights)), "bucket long, rep long, n long, place long")
        prefixes = checkpointed(prefixes)
        n_rows = prefixes.count()
        # Shingles of the same texts say the same of their pairs; the first of them in the order stands for all.
        same = ["members", "low", "high", "d1", "d2"]
        lists = prefixes.groupBy("bucket").agg(
            F.count("*").alias("members"), F.min("rep").alias("low"), F.max("rep").alias("high"),
            F.bit_xor(F.xxhash64("rep")).alias("d1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("d2"), F.sum("place").alias("at"),
        )
        firsts = lists.where("low < high").groupBy(*same).agg(F.min(F.struct("at", "bucket")).alias("first")).select("first.bucket")
        grams = sized(checkpointed(prefixes.join(firsts, "bucket")))
        rest = checkpointed(mixed(grams))
        left = rest.select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("rep", "n", "place", "component")])
        right = rest.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("rep", "n", "place", "component")])
        # Of two sets whose first common shingle this is, no more can be common than what follows it in either.
        most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
        may_link = (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
        pairs = left.join(right, "bucket").where("rep_a < rep_b AND component_a <> component_b").where(near_size(F.col("n_a"), F.col("n_b")) & may_link)
        join_up(compare(pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))))
    labels = labelled.drop("bands", "n_bytes")
    labels = labels.join(found_parts, labels.rep == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    return labels.select("doc_id", "n_shingles", component.alias("component_id"), kept, *(["text_key"] if text_key else []))
