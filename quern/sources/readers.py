"""Sources: CSV, TSV, JSON lines, documents, file listings, tar shards, synthetic rows."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.shards import stream_shards


def read_csv(spark: SparkSession, path, columns: list[str], separator: str = ",") -> DataFrame:
    """Delimited text with a header, all strings, blank for missing; quoted newlines and a byte-order mark are read as such."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    options = {"header": True, "multiLine": True, "escape": '"', "sep": separator, "enforceSchema": False, "mode": "FAILFAST"}
    return spark.read.schema(schema).options(**options).csv(path).na.fill("")


def read_captions(spark: SparkSession, path, image: str = "filepath", caption: str = "title", separator: str = "\t") -> DataFrame:
    """The two columns of an image-caption table; quoted fields may hold quotes, separators and line breaks; the others are not read into the plan."""
    df = spark.read.options(header=True, sep=separator, escape='"', multiLine=True).csv(path)
    return df.select(F.col(image).alias("image"), F.col(caption).alias("caption"))


def read_url_list(spark: SparkSession, path) -> DataFrame:
    """Lines ``caption<TAB>url`` without header, with ``uid``, 16 hex digits from a SHA-256 of the line; lines without a tab are none."""
    line = F.col("value")
    parts = F.split(line, "\t")
    return spark.read.text(path).where(line.contains("\t")).select(F.substring(F.sha2(line, 256), 1, 16).alias("uid"), parts[0].alias("caption"), parts[1].alias("url"))


def read_jsonl(spark: SparkSession, path, schema: str, strict: bool = True) -> DataFrame:
    """One object a line, blank lines skipped; with ``strict`` a malformed line is an error of the running job."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema).alias("r"), F.get_json_object("value", "$").startswith("{").alias("object"))
    bad = ~F.coalesce(F.col("object"), F.lit(False))
    row = F.when(bad, F.raise_error(F.lit("line is not a JSON object")).cast(parsed.schema["r"].dataType)).otherwise(F.col("r")) if strict else F.col("r")
    kept = parsed if strict else parsed.where(~bad)
    return kept.select(row.alias("r")).select("r.*")


def read_documents(spark: SparkSession, path) -> DataFrame:
    """Whole files as one text each, with their path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("document"))


def list_files(spark: SparkSession, root: str, suffixes=("jpg", "jpeg", "png", "webp")) -> DataFrame:
    """Recursive listing: relative path, size, modification time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = files.select(F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/'))}/", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    listed = listed.withColumn("ext", F.lower(F.substring_index("path", ".", -1)))
    return listed.where(F.col("ext").isin([s.lower() for s in suffixes]))


def labelled_folder(spark: SparkSession, root: str, split: str, **kw) -> DataFrame:
    """Files of ``root/split/class/...`` with their class and its number in the order of the class names."""
    files = list_files(spark, f"{root.rstrip('/')}/{split}", **kw).withColumn("class", F.split("path", "/")[0]).where(F.col("path").contains("/"))
    classes = files.select("class").distinct().agg(F.array_sort(F.collect_set("class")).alias("_all"))
    return files.crossJoin(F.broadcast(classes)).withColumn("label", F.array_position("_all", F.col("class")) - 1).drop("_all")


def tree_listing(spark: SparkSession, root: str, parents: list[str] | None = None, **kw) -> DataFrame:
    """parent/leaf/file trees: directory names as columns, optionally for some parents."""
    parts = F.split("path", "/")
    files = list_files(spark, root, **kw).where(F.size(parts) >= 3)
    named = files.withColumns({"parent": F.element_at(parts, -3), "leaf": F.element_at(parts, -2), "id": F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")})
    return named.where(F.col("parent").isin(parents)) if parents else named


def expand_braces(pattern: str) -> list[str]:
    """``a{00..02}b{x,y}`` to its paths, ``::`` joining several patterns."""
    out = []
    for one in pattern.split("::"):
        m = re.search(r"\{([^{}]*)\}", one)
        if not m:
            out.append(one)
            continue
        body = re.fullmatch(r"(\d+)\.\.(\d+)", m[1])
        values = [str(i).zfill(len(body[1])) for i in range(int(body[1]), int(body[2]) + 1)] if body else m[1].split(",")
        out += [p for v in values for p in expand_braces(one[: m.start()] + v + one[m.end() :])]
    return out


def weighted_shards(spark: SparkSession, pattern: str, weights: list[float] | None = None) -> DataFrame:
    """Shard paths with the weight of the pattern they come from."""
    groups = pattern.split("::")
    if weights is not None and len(weights) != len(groups):
        raise ValueError("one weight for each pattern")
    rows = [(p, float(w)) for g, w in zip(groups, weights or [1.0] * len(groups)) for p in expand_braces(g)]
    return spark.createDataFrame(rows, "shard string, weight double")


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Samples of tar shards, ``shard, key, parts``; those before the break of a broken archive.

    :func:`quern.sources.shards.stream_shards` is the source; it also gives the errors.
    """
    return stream_shards(spark, paths).where("error IS NULL").select("shard", "key", "parts")


def image_text(samples: DataFrame) -> DataFrame:
    """image (first of jpg, png, jpeg, webp) and text of the samples that have both."""
    image = F.coalesce(*[F.col("parts")[s] for s in ("jpg", "png", "jpeg", "webp")])
    return samples.select("shard", "key", image.alias("image"), F.decode(F.col("parts")["txt"], "utf-8").alias("text")).where("image IS NOT NULL AND text IS NOT NULL")


def shard_sizes(sizes: DataFrame, shards: DataFrame) -> DataFrame:
    """Total samples of the listed shards by a size table (name, n_samples); null if one is unknown."""
    name = F.substring_index("shard", "/", -1)
    joined = shards.select(name.alias("_n")).join(sizes, F.col("_n") == F.col("name"), "left")
    return joined.agg(F.when(F.count_if(F.col("n_samples").isNull()) == 0, F.sum("n_samples")).alias("n_samples"), F.count("*").alias("n_shards"))


def synthetic(spark: SparkSession, n: int, caption: str = "Dummy caption", side: int = 224) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("sample_id"), F.lit(caption).alias("text"), F.lit(side).alias("width"), F.lit(side).alias("height"))


def fetch_urls(rows: DataFrame, key: str, url: str, fetch: Callable[[str], bytes], retries: int = 3) -> DataFrame:
    """Fetch each URL through an injected function; failures become error rows, never a failed task."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, u in zip(pdf["k"], pdf["u"]):
                content, error = None, None
                for _ in range(retries):
                    try:
                        content, error = fetch(u), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                out.append((k, content, error))
            yield pd.DataFrame(out, columns=["key", "content", "error"])

    return rows.select(F.col(key).cast("string").alias("k"), F.col(url).alias("u")).mapInPandas(run, "key string, content binary, error string")


def open_dataset(spark: SparkSession, path: str, kind: str = "auto", **kw) -> DataFrame:
    """Dispatch by type or extension: csv, tsv, jsonl, parquet, tar."""
    kind = path.rsplit(".", 1)[-1] if kind == "auto" else kind
    readers = {
        "csv": lambda: read_captions(spark, path, separator=",", **kw),
        "tsv": lambda: read_captions(spark, path, **kw),
        "tar": lambda: image_text(read_shards(spark, expand_braces(path))),
        "parquet": lambda: spark.read.parquet(path),
        "jsonl": lambda: read_jsonl(spark, path, **kw),
    }
    if kind not in readers:
        raise ValueError(f"unknown dataset type {kind}")
    return readers[kind]()
