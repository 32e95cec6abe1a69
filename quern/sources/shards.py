"""Tar shards as a streamed Python data source, the loader chain over them, and a writer.

A shard is never held: its headers are walked, contents are read member by member, and rows leave in batches of bounded bytes.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import json
import os
import re
import shutil
import tarfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.operators.sampling import digest
from quern.operators.windows import numbered_in_groups
from quern.sources import stores

SCHEMA = "place long, shard string, node int, worker int, offset long, key string, parts map<string,binary>, error string"
_ARROW = pa.schema([("place", pa.int64()), ("shard", pa.string()), ("node", pa.int32()), ("worker", pa.int32()), ("offset", pa.int64()), ("key", pa.string()), ("parts", pa.map_(pa.string(), pa.binary())), ("error", pa.string())])
#: Path up to the first dot of its last part, and what follows that dot; a name without a dot belongs to no sample.
_NAME = re.compile(r"((?:.*/)?[^./][^./]*)\.([^/]*)")


#: Bytes between two entries of a shard's index.
INDEX_BYTES = 1 << 16


@dataclass
class ShardRange(InputPartition):
    """The samples of one shard whose first header lies in [first, last)."""

    place: int
    shard: str
    node: int
    worker: int
    first: int
    last: int


def shard_order(paths: list[str], seed: int | None, epoch: int) -> list[str]:
    """The epoch's order of shards: by a digest of seed, epoch and file name; as given without a seed."""
    if seed is None:
        return list(paths)
    return sorted(paths, key=lambda p: (hashlib.sha256(f"{seed}:{epoch}:{p.rsplit('/', 1)[-1]}".encode()).hexdigest(), p))


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.seed, self.epoch = json.loads(options["paths"]), json.loads(options.get("seed", "null")), int(options.get("epoch", 0))
        self.nodes, self.workers = int(options.get("nodes", 1)), int(options.get("workers", 1))
        self.node = json.loads(options.get("node", "null"))
        self.range_bytes, self.most = int(options.get("range_bytes", 0)), int(options.get("most_bytes", 1 << 30))
        self.batch_bytes = int(options.get("batch_bytes", 16 << 20))

    def partitions(self):
        out = []
        for place, shard in enumerate(shard_order(self.paths, self.seed, self.epoch)):
            node, worker = place % self.nodes, place // self.nodes % self.workers
            if self.node is not None and node != self.node:
                continue
            size = stores.file_size(shard) if self.range_bytes else 0
            cuts = list(range(0, size, self.range_bytes)) if size else [0]
            out += [ShardRange(place, shard, node, worker, a, b) for a, b in zip(cuts, [*cuts[1:], 1 << 62])]
        return out or [ShardRange(-1, "", 0, 0, 0, 0)]

    def read(self, partition):
        own = partition
        if own.place < 0:
            return
        rows, held = [], 0
        for offset, key, parts, error in samples(own.shard, own.first, own.last, self.most):
            rows.append({"place": own.place, "shard": own.shard, "node": own.node, "worker": own.worker, "offset": offset, "key": key, "parts": None if parts is None else list(parts.items()), "error": error})
            held += sum(map(len, parts.values())) if parts else 0
            if held >= self.batch_bytes or len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _index_of(shard: str) -> str:
    """A shard's index lies in a folder beside the shards' own, which holds nothing but shards."""
    folder, _, name = shard.rpartition("/")
    return f"{folder}.index/{name}"


def _nearest_start(shard: str, first: int) -> int:
    """The last indexed sample that begins at or before ``first``; 0 for shards without an index of their size, such as foreign ones."""
    try:
        with stores.input_file(_index_of(shard)) as file:
            size, *starts = json.loads(file.read())
        return starts[max(0, bisect.bisect_right(starts, first) - 1)] if starts and size == stores.file_size(shard) else 0
    except (OSError, ValueError):
        return 0


def samples(shard: str, first: int = 0, last: int = 1 << 62, most: int = 1 << 30):
    """Yield (first header's byte, key, suffix -> bytes, error) for the samples of a shard that begin in [first, last).

    Headers are walked from the last indexed sample before ``first`` (:func:`write_shards` leaves an index), or from the beginning. Consecutive members of one name are a sample; a repeated suffix (in lower case) begins a new one. A part above ``most`` bytes makes
    its sample an error row. Where the archive breaks, what was read before comes first, then an error row with the place.
    """
    key, begun, parts, error = None, 0, {}, None

    def complete():
        if key is not None and first <= begun < last and None not in parts.values():
            yield (begun, key, None, error) if error else (begun, key, parts, None)

    try:
        with stores.input_file(shard) as file:
            try:
                if first:
                    file.seek(_nearest_start(shard, first))
                with tarfile.open(fileobj=file, mode="r:") as tar:
                    for member in tar:
                        tar.members = []  # the archive keeps no list of what was seen
                        name = _NAME.fullmatch(member.name)
                        if not member.isfile() or not name:
                            continue
                        prefix, suffix = name[1], name[2].lower()
                        if prefix != key or suffix in parts:
                            yield from complete()
                            if member.offset >= last:
                                return
                            key, begun, parts, error = prefix, member.offset, {}, None
                        if begun < first:
                            parts[suffix] = b""
                        elif member.size > most:
                            error, parts[suffix] = f"{member.name} has {member.size} bytes", b""
                        else:
                            parts[suffix] = None  # stays so if the archive breaks within
                            parts[suffix] = tar.extractfile(member).read()
                    end = tar.offset
                yield from complete()
                key = None
                file.seek(end)
                if end < last and file.read(512).strip(b"\0"):
                    yield end, None, None, f"no header at byte {end}"
            except (tarfile.TarError, OSError, EOFError) as e:
                yield from complete()
                yield begun, None, None, f"{type(e).__name__}: {e}"
    except OSError as e:
        if first == 0:
            yield 0, None, None, f"{type(e).__name__}: {e}"


class ShardSource(DataSource):
    """``spark.read.format("quern_shards")``; see :func:`stream_shards` for the options."""

    @classmethod
    def name(cls):
        return "quern_shards"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ShardReader(self.options)


def stream_shards(spark: SparkSession, paths: list[str], seed: int | None = None, epoch: int = 0, nodes: int = 1, node: int | None = None, workers: int = 1, range_bytes: int = 0, most_bytes: int = 1 << 30) -> DataFrame:
    """Samples of tar shards: ``place, shard, node, worker, offset, key, parts, error``.

    With ``seed`` the shards are permuted for every epoch; shard i of the order goes to node i mod ``nodes`` and there to
    worker i div ``nodes`` mod ``workers``, and only those of ``node`` are read if it is given. A shard is one partition of the read, with
    ``range_bytes`` one for each such range, whose task walks the headers before its range (from the last indexed sample, where there is an index) and reads only its own samples.
    A task holds one sample and one batch of 16 MB. A broken archive, a missing file or a part above ``most_bytes`` gives a row with
    ``error`` and null ``parts``; nothing is lost silently. Shards are opened by Arrow's file systems (local, hdfs, s3, gs).
    """
    spark.dataSource.register(ShardSource)
    given = {"paths": list(paths), "seed": seed, "epoch": epoch, "nodes": nodes, "node": node, "workers": workers, "range_bytes": range_bytes, "most_bytes": most_bytes}
    return spark.read.format("quern_shards").options(**{k: json.dumps(v) for k, v in given.items()}).load()


def load_batches(spark: SparkSession, paths: list[str], batch: int, seed: int = 0, epoch: int = 0, nodes: int = 1, workers: int = 1, train: bool = True, cap: int | None = None, range_bytes: int = 1 << 26, **options) -> DataFrame:
    """The loader chain: shards, shuffle, split by node and worker, samples, shuffle, select, rename, batch, epoch cap.

    Shards are read by ranges of ``range_bytes``, so that a large one is many tasks. Samples without text or image and those in error are left out (:func:`stream_shards` shows them). For training, samples of a
    worker are shuffled by a digest of seed, epoch, pass, shard name and key, short batches go, and with ``cap`` every worker has just
    that many batches: a worker with fewer goes through its samples again in new orders, as many passes as it takes; one
    without a full batch has none. Otherwise shards and samples keep their order and the last batch may be short.
    Places come from counts by digest prefixes, so a worker's samples are no task's alone. Image bytes are shuffled twice, to be numbered and
    put in place; for large images pass on ``shard, key`` and read again.

    Returns ``node, worker, batch, item, shard, key, image, text``.
    """
    raw = stream_shards(spark, paths, seed if train else None, epoch, nodes, workers=workers, range_bytes=range_bytes, **options).where("error IS NULL")
    image = F.coalesce(*[F.col("parts")[s] for s in ("jpg", "png", "jpeg", "webp")])
    rows = raw.select("node", "worker", "place", "offset", F.substring_index("shard", "/", -1).alias("shard"), "key", image.alias("image"), F.decode(F.col("parts")["txt"], "utf-8").alias("text"))
    rows = rows.where("image IS NOT NULL AND text IS NOT NULL").withColumn("slot", F.concat_ws(":", "node", "worker"))
    rows = rows.withColumn("turn", F.lit(0))
    if train and cap:
        full = rows.groupBy(F.col("slot").alias("s")).agg(F.floor(F.count("*") / batch).alias("n")).where("n > 0")
        turns = full.select("s", F.sequence(F.lit(0), (F.ceil(F.lit(cap) / F.col("n")) - 1).cast("int")).alias("turns"))
        rows = rows.drop("turn").join(F.broadcast(turns), F.col("slot") == F.col("s")).withColumn("turn", F.explode("turns")).drop("s", "turns")
    name = F.concat_ws(":", "slot", "turn")
    mixed = digest(F.lit(seed), F.lit(epoch), F.col("turn"), F.col("shard"), F.col("key"), separator=":")
    kept = F.concat(F.lpad(F.hex("place"), 8, "0"), F.lpad(F.hex("offset"), 16, "0"))
    placed = numbered_in_groups(rows.withColumns({"_slot": name, "_d": mixed if train else kept}), "_slot", "_d", ["key"], prefix=3 if train else 12)
    placed = placed.withColumns({"b": F.floor(F.col("_place") / batch), "item": (F.col("_place") % batch).cast("int"), "full": F.floor(F.col("_size") / batch)})
    if train:
        placed = placed.where("b < full").withColumn("b", F.col("turn") * F.col("full") + F.col("b"))
        placed = placed.where(F.col("b") < cap) if cap else placed
    return placed.select("node", "worker", F.col("b").cast("long").alias("batch"), "item", "shard", "key", "image", "text")


def write_shards(rows: DataFrame, folder: str, shard: str, key: str, parts: dict[str, str]) -> DataFrame:
    """Write tar shards ``folder/<shard>.tar`` with the members ``<key>.<suffix>`` of every row, ``parts`` naming a column for each suffix.

    Rows are dealt by ranges of shard and key, so that a large shard is many tasks, each of which streams its rows into a segment in a folder beside the shards. The
    sizes of a shard's segments give each its place in the archive, and tasks of their own put them there side by side; on stores whose files
    cannot be written in place, one task a shard appends them. A file gets its name once it is whole, and a task that runs again leaves the same file. The folder
    ``<folder>.index`` holds for each shard the begin of a sample every 64 KB, so that a range is found without walking the shard. Null cells have
    no member. Returns ``shard, n_samples``, the size table of the shards; the write happens when it is read, so write or checkpoint it once.
    """
    columns = list(dict.fromkeys(parts.values()))
    members = [(suffix, columns.index(c)) for suffix, c in parts.items()]
    cells = [F.col(c).cast("binary").alias(f"_{i}") for i, c in enumerate(columns)]
    dealt = rows.select(F.col(shard).cast("string").alias("_shard"), F.col(key).cast("string").alias("_key"), *cells)
    segments = dealt.repartitionByRange("_shard", "_key").sortWithinPartitions("_shard", "_key").mapInArrow(_segments(folder, members), _SEGMENT)
    own = Window.partitionBy("shard")
    place = F.coalesce(F.sum("size").over(own.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = segments.withColumns({"place": place, "whole": F.sum("size").over(own)})
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # with a number given, adaptive execution leaves one task's rows apart, few as they are
    in_place = stores.writes_in_place(folder)
    put = placed.repartition(n, "shard", "segment").mapInArrow(_put(folder), f"{_SEGMENT}, place long, whole long") if in_place else placed
    return put.repartition(n, "shard").groupBy("shard").applyInArrow(_finish(folder, in_place), "shard string, n_samples long")


_SEGMENT = "shard string, segment int, size long, n_samples long, starts array<long>"
_ARROW_SEGMENT = pa.schema([("shard", pa.string()), ("segment", pa.int32()), ("size", pa.int64()), ("n_samples", pa.int64()), ("starts", pa.list_(pa.int64()))])


def _segment_path(folder: str, name: str, segment: int | None = None) -> str:
    held = f"{folder}.segments/{hashlib.sha256(str(name).encode()).hexdigest()}"
    return held if segment is None else f"{held}/{segment}"


def _segments(folder: str, members: list[tuple[str, int]]):
    """Write one segment, members without an end of the archive, for each shard among a task's sorted rows; its number is the task's."""

    def run(batches):
        tar = None

        def close():
            sink.close()
            store.move(unnamed, inner)
            row = {"shard": name, "segment": number, "size": tar.offset, "n_samples": count, "starts": starts}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW_SEGMENT)

        number = TaskContext.get().partitionId()
        for batch in batches:
            for row in batch.to_pylist():
                if tar is None or row["_shard"] != name:
                    if tar is not None:
                        yield close()
                    name, count, starts = row["_shard"], 0, []
                    store, inner = stores.opened(_segment_path(folder, name, number))
                    unnamed = f"{inner}.{uuid.uuid4().hex}"
                    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    sink = store.open_output_stream(unnamed, buffer_size=1 << 20)
                    tar = tarfile.TarFile(fileobj=sink, mode="w")
                if not starts or tar.offset >= starts[-1] + INDEX_BYTES:
                    starts.append(tar.offset)
                tar.members = []  # the archive keeps no list of what was written
                count += 1
                for suffix, i in members:
                    if (content := row[f"_{i}"]) is not None:
                        member = tarfile.TarInfo(f"{row['_key']}.{suffix}")
                        member.size = len(content)
                        tar.addfile(member, io.BytesIO(content))
        if tar is not None:
            yield close()

    return run


def _put(folder: str):
    """Copy segments to their places in the archives."""

    def run(batches):
        for batch in batches:
            for row in batch.select(["shard", "segment", "place"]).to_pylist():
                store, inner = stores.opened(f"{folder}/{row['shard']}.tar")
                store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with open(os.open(f"{inner}.part", os.O_CREAT | os.O_WRONLY, 0o666), "wb") as out, stores.input_file(_segment_path(folder, row["shard"], row["segment"])) as segment:
                    out.seek(row["place"])
                    shutil.copyfileobj(segment, out, 1 << 20)
            yield batch

    return run


def _finish(folder: str, in_place: bool):
    """End a shard's archive, which is made of its segments here if they are not in place, write its index, give it its name and drop its segments."""

    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        name, whole = rows[0]["shard"], rows[0]["whole"]
        size = -(-(whole + 2 * tarfile.BLOCKSIZE) // tarfile.RECORDSIZE) * tarfile.RECORDSIZE
        store, inner = stores.opened(f"{folder}/{name}.tar")
        held = stores.opened(_segment_path(folder, name))[1]
        if store.get_file_info(held).type != fs.FileType.NotFound:  # else this task ran before, to its end
            if in_place:
                if os.path.exists(f"{inner}.part"):
                    os.truncate(f"{inner}.part", whole)
                    os.truncate(f"{inner}.part", size)
            else:
                store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{inner}.part") as out:
                    for row in rows:
                        with stores.input_file(_segment_path(folder, name, row["segment"])) as segment:
                            shutil.copyfileobj(segment, out, 1 << 20)
                    out.write(bytes(size - whole))
            place = _index_of(inner)
            store.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(place) as index:
                index.write(json.dumps([size, *(r["place"] + s for r in rows for s in r["starts"])]).encode())
            if store.get_file_info(f"{inner}.part").type != fs.FileType.NotFound:
                store.move(f"{inner}.part", inner)
            store.delete_dir(held)
        return pa.table({"shard": [f"{name}.tar"], "n_samples": pa.array([sum(r["n_samples"] for r in rows)], pa.int64())})

    return run
