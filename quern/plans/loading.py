"""Loading: tar shards and growing line files, written from the driver's tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.contracts import checkpointed, shared_folder
from quern.operators import splits, windows
from quern.session import table
from quern.sources import readers, shards, sinks
from quern.streaming import incremental, lines, status

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _written(spark, d) -> list[str]:
    """Documents as seven shards, the text as caption and as stand-in for the image."""
    folder = shared_folder(spark)
    named = table(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("s"), F.col("doc_id") % 7).alias("shard"), F.col("doc_id").alias("key"), "text")
    written = checkpointed(shards.write_shards(named, folder, "shard", "key", {"jpg": "text", "txt": "text"}))
    return [f"{folder}/{r.shard}" for r in written.select("shard").orderBy("shard").collect()]


_PLACED = """p AS (SELECT doc_id, text, 's' || (doc_id % 7) || '.tar' AS shard FROM documents WHERE text IS NOT NULL),
    o AS (SELECT shard, row_number() OVER (ORDER BY sha256('3:1:' || shard)) - 1 AS place FROM (SELECT DISTINCT shard FROM p))"""


@query(f"WITH {_PLACED} SELECT CAST(doc_id AS varchar) AS key, shard, CAST(place % 2 AS int) AS node, CAST(place // 2 % 2 AS int) AS worker, sha256(text) AS digest FROM p JOIN o USING (shard)")
def shard_round_trip(spark, d):
    """Every sample of the shards, read by ranges of 256 KB, with its node and worker in this epoch."""
    read = shards.stream_shards(spark, _written(spark, d), seed=3, epoch=1, nodes=2, workers=2, range_bytes=1 << 18)
    return read.select("key", F.substring_index("shard", "/", -1).alias("shard"), "node", "worker", F.sha2(F.col("parts")["txt"], 256).alias("digest"))


@query(
    f"""WITH {_PLACED}, w AS (SELECT doc_id, shard, place % 2 AS node, place // 2 % 2 AS worker FROM p JOIN o USING (shard)),
    n AS (SELECT node, worker, count(*) // 8 AS whole FROM w GROUP BY node, worker),
    t AS (SELECT w.*, whole, unnest(range(0, CAST(ceil(40 / whole) AS int))) AS turn FROM w JOIN n USING (node, worker) WHERE whole > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY node, worker, turn ORDER BY sha256('3:1:' || turn || ':' || shard || ':' || doc_id)) - 1 AS i FROM t)
    SELECT CAST(node AS int) AS node, CAST(worker AS int) AS worker, CAST(turn * whole + i // 8 AS bigint) AS batch, CAST(i % 8 AS int) AS item, shard, CAST(doc_id AS varchar) AS key
    FROM r WHERE i // 8 < whole AND turn * whole + i // 8 < 40"""
)
def loader_batches(spark, d):
    """40 batches of 8 for each of four workers; workers with fewer go through their shards again."""
    got = shards.load_batches(spark, _written(spark, d), batch=8, seed=3, epoch=1, nodes=2, workers=2, cap=40)
    return got.select("node", "worker", "batch", "item", "shard", "key")


@query(
    """SELECT CAST(sum(n) AS bigint) AS n_samples, CAST(count(*) AS bigint) AS n_shards, CAST(sum(CASE WHEN shard = 's9' THEN 1 ELSE 0 END) AS bigint) AS n_unknown
    FROM (SELECT 's' || (doc_id % 7) AS shard, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)"""
)
def shard_sizes(spark, d):
    """Samples of the shards by the size table that their writer returned."""
    folder = shared_folder(spark)
    named = table(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("s"), F.col("doc_id") % 7).alias("shard"), "doc_id", "text")
    sizes = checkpointed(shards.write_shards(named, folder, "shard", "doc_id", {"txt": "text"}))
    listed = sizes.select(F.concat(F.lit("far/away/"), "shard").alias("shard"))
    return readers.shard_sizes(sizes.select(F.col("shard").alias("name"), "n_samples"), listed).withColumn("n_unknown", F.lit(0).cast("long"))


@query("SELECT doc_id, source, n_chars FROM documents")
def resumed_lines(spark, d):
    """Documents written as JSON lines in two steps, each followed by a run of one stream; the second goes on at its byte offsets."""
    folder, out, state = (shared_folder(spark) for _ in range(3))
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    for k in (0, 1):
        sinks.append_metrics(rows.where(F.col("doc_id") % 2 == k), folder)
        stream = lines.stream_jsonl(spark, folder, "doc_id long, source string, n_chars long", suffix=".json", split_bytes=1 << 14)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("doc_id", "source", "n_chars")


_LADDER = """a AS (SELECT user_id, arg_min(value > 40, event_id) AS ok, min(event_id) AS at FROM events WHERE event_type = 'view' GROUP BY user_id),
    b AS (SELECT e.user_id, arg_min(value > 40, event_id) AS ok, min(event_id) AS at FROM events e JOIN a ON a.user_id = e.user_id WHERE event_type = 'click' AND NOT a.ok AND event_id > a.at GROUP BY e.user_id),
    c AS (SELECT e.user_id, arg_min(value > 40, event_id) AS ok FROM events e JOIN b ON b.user_id = e.user_id WHERE event_type = 'purchase' AND NOT b.ok AND event_id > b.at GROUP BY e.user_id)"""


@query(
    f"""WITH {_LADDER} SELECT CAST(u.user_id AS varchar) AS key, CASE WHEN a.ok THEN 'view' WHEN b.ok THEN 'click' WHEN c.ok THEN 'purchase' WHEN NOT c.ok THEN 'failed' ELSE 'pending' END AS status,
    CASE WHEN coalesce(a.ok, true) OR coalesce(b.ok, false) OR coalesce(c.ok, false) THEN '' ELSE 'view: failed' || CASE WHEN NOT b.ok THEN ' | click: failed' ELSE '' END || CASE WHEN NOT c.ok THEN ' | purchase: failed' ELSE '' END END AS error
    FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'click', 'purchase')) u LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)"""
)
def status_machine(spark, d):
    """Attempts at three origins as two streams of one state, the second going on where the first ended."""
    folder, out, state = (shared_folder(spark) for _ in range(3))
    spark.conf.set(*next(iter(status.CONF.items())))
    events = table(spark, d, "events").where("event_type IN ('view', 'click', 'purchase')")
    half = events.agg(F.avg("event_id")).first()[0] or 0
    rows = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.lit("attempt").alias("kind"), F.col("event_type").alias("origin"), F.col("ts").alias("at"), (F.col("value") > 40).alias("ok"), F.lit(True).alias("final"), F.lit(None).cast("string").alias("error"))
    for part in (rows.where(F.col("seq") <= half), rows.where(F.col("seq") > half)):
        part.write.mode("append").parquet(folder)
        stream = status.fetch_status(spark.readStream.schema(rows.schema).parquet(folder), ["view", "click", "purchase"], delay="3650 days")
        batch = lambda found, epoch: found.write.mode("overwrite").parquet(f"{out}/part={state[-6:]}-{epoch}")
        stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{out}/*")
    return found.groupBy("key").agg(F.max(F.struct("seq", "status", "error")).alias("m")).select("key", "m.status", "m.error")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upserted_latest(spark, d):
    """The latest event of each user, upserted from a stream of four files into 16 buckets."""
    folder, out, state = (shared_folder(spark) for _ in range(3))
    events = table(spark, d, "events").select("user_id", "event_type", "event_id")
    events.repartition(4, "event_id").write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    incremental.upsert_latest(stream, "user_id", "event_id", out, state, buckets=16)
    return incremental.read_upserted(spark, out)


@query(
    """SELECT 'all' AS part, CAST(run AS bigint) AS run, event_type, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS n_rows
    FROM (SELECT *, sum(c) OVER (ORDER BY event_id) AS run FROM (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS c FROM events))
    GROUP BY run, event_type"""
)
def runs_of_one_part(spark, d):
    """Runs of event types over all events, which are one part."""
    events = table(spark, d, "events").select(F.lit("all").alias("part"), "event_id", "event_type")
    return windows.contiguous_runs(events, "part", "event_id", "event_type")


@query(
    """SELECT 'all' AS part, coalesce(max(n), 0) AS longest_run FROM (SELECT count(*) AS n FROM (SELECT event_type <> 'view' AS bad,
    sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS g FROM events) WHERE bad GROUP BY g)"""
)
def longest_run_of_one_part(spark, d):
    events = table(spark, d, "events").select(F.lit("all").alias("part"), "event_id", (F.col("event_type") != "view").alias("bad"))
    return windows.longest_run(events, "part", "event_id", "bad")


@query("SELECT event_id, event_id = (SELECT max(event_id) FROM events) AS is_last FROM events")
def last_of_one_part(spark, d):
    events = table(spark, d, "events").select(F.lit("all").alias("part"), "event_id")
    return windows.last_flag(events, "part", "event_id").select("event_id", "is_last")


@query(
    """WITH r AS (SELECT page_id, row_number() OVER (ORDER BY sha256('5:' || page_id)) AS i, count(*) OVER () AS n FROM pages)
    SELECT page_id, i <= greatest(1, least(n - 1, CAST(round_even(n * 0.13, 0) AS bigint))) AS held_out FROM r"""
)
def row_holdout_split(spark, d):
    """Pages held out by row: 13 % with the smallest digests."""
    return splits.row_holdout(table(spark, d, "pages").select("page_id"), "page_id", 0.13, seed=5)
