"""Incremental state, text functions and streaming over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import state as S
from quern.session import table
from quern.sources import sinks
from quern.streaming import incremental as I

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _versions(spark, d):
    """Pages as a file scan, documents as the state of an older scan: sizes stand for versions."""
    seen = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.length("html").alias("size"), F.col("page_id").alias("mtime"))
    old = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"), F.lit("ok").alias("status"))
    return seen, old


_SCAN = """(SELECT coalesce(p.page_id, d.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'new' WHEN p.page_id IS NULL THEN 'removed' WHEN length(html) = n_chars THEN 'reuse' ELSE 'recompute' END AS action
    FROM pages p FULL JOIN documents d ON p.page_id = d.doc_id)"""


@query(f"SELECT CAST(id AS varchar) AS path, action FROM {_SCAN}")
def incremental_scan(spark, d):
    return S.incremental_scan(*_versions(spark, d)).select("path", "action")


@query(f"SELECT CAST(id AS varchar) AS path, CASE WHEN action = 'reuse' THEN 'ok' WHEN id IN (SELECT doc_id FROM labels) THEN 'checked' ELSE 'pending' END AS status FROM {_SCAN} WHERE action <> 'removed'")
def state_after_scan(spark, d):
    checked = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("path"), F.lit("checked").alias("status"))
    return S.next_state(S.incremental_scan(*_versions(spark, d)), checked)


@query("SELECT CAST(d.doc_id AS varchar) AS path, n_chars AS size, CASE WHEN p.page_id IS NULL THEN 'copied' WHEN length(html) = n_chars THEN 'existing' ELSE 'skipped_conflict' END AS decision FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def sync_decisions(spark, d):
    seen, old = _versions(spark, d)
    return S.sync_decisions(old.select("path", "size"), seen.select("path", "size", F.lit("").alias("digest")))


@query(
    """SELECT user_id, CASE min(r) WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' ELSE 'failed' END AS status
    FROM (SELECT user_id, CASE WHEN value > 40 THEN CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END END AS r FROM events WHERE event_type IN ('view', 'click', 'purchase')) GROUP BY user_id"""
)
def fallback_status(spark, d):
    attempts = table(spark, d, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    attempts = attempts.select("user_id", F.col("event_type").alias("origin"), (F.col("value") > 40).alias("ok"), F.lit("refused").alias("error"))
    return S.fallback_status(attempts, "user_id", ["view", "click", "purchase"]).select("user_id", "status")


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending_rows(spark, d):
    state = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("error").alias("status"))
    return S.pending(table(spark, d, "documents").select("doc_id"), state, "doc_id", ["ok"])


@query(
    """SELECT doc_id, CASE WHEN p.page_id IS NULL THEN 'missing' WHEN length(html) > 0 THEN 'present' ELSE 'empty' END AS file_status
    FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id"""
)
def file_semi_join(spark, d):
    listing = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("path"), F.length("html").alias("size"), F.lit("html").alias("ext"))
    return S.with_file(table(spark, d, "documents").select("doc_id"), listing, ["doc_id"], ["jpg", "html"]).select("doc_id", "file_status")


@query(
    """SELECT user_id, coalesce(max(n), 0) AS longest_run FROM (SELECT user_id, g, count(*) FILTER (WHERE bad) AS n FROM
    (SELECT user_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) GROUP BY ALL) GROUP BY user_id"""
)
def longest_error_run(spark, d):
    return S.longest_run(table(spark, d, "events").withColumn("bad", F.col("event_type") == "error"), "user_id", "event_id", "bad")


@query(
    r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) IN ('https') AS secure, split_part(url, '/', -1) AS last_part, split_part(url, '/', -2) AS second_part,
    translate(url, '<>:"/\|?*', '_________') AS safe FROM pages"""
)
def url_path_functions(spark, d):
    u = F.col("url")
    safe = X.safe_name(u)
    return table(spark, d, "pages").select("page_id", X.scheme_allowed(u, ("https",)).alias("secure"), X.path_part(u, 1).alias("last_part"), X.path_part(u, 2).alias("second_part"), safe.alias("safe"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS folded, length(text) AS n_chars FROM documents")
def text_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.collapse_ws(F.col("text"))).alias("folded"), F.length("text").cast("long").alias("n_chars"))


@query(r"SELECT item_id, len(regexp_extract_all(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '''s|''t|''re|''ve|''m|''ll|''d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+')) AS n_tokens FROM benchmark")
def pretokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(X.pretokens(F.col("text"))).alias("n_tokens"))


@query("SELECT doc_id, sha256(concat_ws(chr(0), '1', source, CAST(doc_id AS varchar))) AS sha, substr(sha1(lang), 1, 12) AS short FROM documents")
def hash_functions(spark, d):
    from quern.operators.sampling import digest

    return table(spark, d, "documents").select("doc_id", digest(F.lit(1), F.col("source"), F.col("doc_id")).alias("sha"), F.substring(F.sha1("lang"), 1, 12).alias("short"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS int) AS k, format('{:06d}:{}', event_id, event_type) AS name FROM events")
def json_and_format(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.format_string("%06d:%s", "event_id", "event_type").alias("name"))


@query()
def table_fingerprint(spark, d):
    kinds = {"documents": "doc_id", "labels": "doc_id", "events": "event_id"}
    return spark.createDataFrame([(k, sinks.fingerprint(table(spark, d, k), [by])) for k, by in kinds.items()], "name string, fingerprint string")


@query("SELECT event_type, count(*) AS n_rows FROM events GROUP BY event_type")
def stream_dedup_counts(spark, d):
    """The events as a file stream, deduplicated by id, written with checkpoints and counted."""
    from quern.contracts import checkpointed

    checkpointed(spark.range(1))  # so that a shared folder is set
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    events = I.stream_table(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = I.deduplicated(events, ["event_id"], "ts", "3650 days")
    I.run_available(stream.select("event_id", "event_type"), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n_rows"))
