"""Uniform shuffle into exact shard sizes through a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw of any size; NumPy's own is limited to 10**9 items, beyond that by inversion from the mode."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n and good else 0
    low, high = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    p_up = p_down = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    u, up, down = rng.random() - p_up, mode, mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) / (up + 1) * (n - up) / (bad - n + up + 1)
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down / (good - down + 1) * (bad - n + down) / (n - down + 1)
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(sources: np.ndarray, targets: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draw how many rows each source block sends to each target block.

    Row and column sums are exact; the law is that of a uniform permutation cut into target blocks.
    """
    left, out = [int(x) for x in targets], np.zeros((len(sources), len(targets)), np.int64)
    total = sum(left)
    for i, n in enumerate(sources):
        n, rest = int(n), total
        if 0 < total < 10**9:
            own = rng.multivariate_hypergeometric(np.array(left, np.int64), n, method="marginals")
            out[i], left, total = own, [a - b for a, b in zip(left, own.tolist())], total - n
            continue
        for j in range(len(left)):
            if not n:
                break
            rest -= left[j]
            out[i, j] = x = _hypergeometric(rng, left[j], rest, n) if rest else n
            n -= x
        for j, x in enumerate(out[i].tolist()):
            left[j] -= x
            total -= x
    return out


def _shard_plan(seed: int, block_rows: int):
    """The second matrix, of one shard: from source blocks to stretches of the shard's slots."""

    def run(key, counts):
        shard, counts = int(key[0]), counts.sort_values("source")
        size = int(counts["n"].sum())
        cuts = np.linspace(0, size, max(1, -(-size // block_rows)) + 1).astype(np.int64)
        matrix = communication_matrix(counts["n"].to_numpy(), np.diff(cuts), np.random.default_rng([seed, 1 + shard]))
        i, j = np.nonzero(matrix)
        return pd.DataFrame({"source": counts["source"].to_numpy()[i], "shard": np.int32(shard), "block": j.astype(np.int32), "first": cuts[j], "n": matrix[i, j]})

    return run


def _deal(key, rows, plan):
    """Permute one source block by its hashes and cut it by its row of the matrix."""
    rows, plan = rows.sort_by([("h", "ascending"), ("row", "ascending")]), plan.sort_by([("shard", "ascending"), ("block", "ascending")])
    n = plan["n"].to_numpy()
    for name in ("shard", "block", "first"):
        rows = rows.append_column(name, pa.array(np.repeat(plan[name].to_numpy(), n)))
    return rows.select(["doc_id", "size", "text_crc32", "h", "row", "shard", "block", "first"])


def _arrange(seed: int):
    """Permute one target block again; its rows take the block's slots in that order."""

    def run(key, rows):
        rows = rows.sort_by([("h", "ascending"), ("row", "ascending")])
        block = np.random.default_rng([seed, 1 << 20, *(int(k.as_py()) for k in key)])
        slot = rows["first"].to_numpy() + block.permutation(rows.num_rows)
        return rows.select(["doc_id", "size", "text_crc32", "shard"]).append_column("slot", pa.array(slot))

    return run


def uniform_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, seed: int = 17, block_rows: int | None = None) -> DataFrame:
    """Deal all rows to ``shards`` shards as a uniform random permutation would; counts differ by at most one.

    Rows are hashed to source blocks of about ``block_rows`` (by default 10 times the root of the row
    count, 20,000 at least). Only the blocks' counts reach the driver, which draws the matrix from source
    blocks to shards; a second matrix for each shard, drawn in tasks, leads to stretches of its slots. Its cells
    grow with the rows (about one for each 2,500 rows of 10**10), each one draw.
    Each source block is permuted on its own and cut by its row, the pieces are exchanged, and each
    stretch is permuted again, which gives the slots. No task holds more than one block, and a task that
    runs again repeats its draw: order comes from hashes and seeded generators.

    Nulls and edge cases: null text has size 8 and the checksum of the empty string; a null id stays
    null; rows are hashed with their place in the checkpointed table, so repeated rows are dealt one by one and fill no
    block together; an empty table gives an empty result. Only the two named columns are read.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    slim = checkpointed(slim.withColumn("row", F.monotonically_increasing_id()))
    slim = slim.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "row"))
    total = slim.count()
    block_rows = block_rows or max(20_000, 10 * math.isqrt(total))
    blocks = max(1, -(-total // block_rows))
    slim = slim.withColumn("source", F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int"))
    counts = {r["source"]: r["n"] for r in slim.groupBy("source").agg(F.count("*").alias("n")).collect()}
    sizes = np.full(shards, total // shards, np.int64)
    sizes[: total % shards] += 1
    matrix = communication_matrix(np.array([counts.get(i, 0) for i in range(blocks)]), sizes, np.random.default_rng([seed, 0]))
    source, shard = np.nonzero(matrix)
    rows = pd.DataFrame({"source": source.astype(np.int32), "shard": shard.astype(np.int32), "n": matrix[source, shard]})
    draws = spark.createDataFrame(rows, "source int, shard int, n long") if len(rows) else spark.createDataFrame([], "source int, shard int, n long")
    plan = draws.groupBy("shard").applyInPandas(_shard_plan(seed, block_rows), "source int, shard int, block int, first long, n long")
    plan = checkpointed(plan)
    dealt = slim.groupBy("source").cogroup(plan.groupBy("source")).applyInArrow(
        _deal, "doc_id long, size long, text_crc32 long, h long, row long, shard int, block int, first long"
    )
    placed = dealt.groupBy("shard", "block").applyInArrow(_arrange(seed), "doc_id long, size long, text_crc32 long, shard int, slot long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
