"""JSON lines as a stream whose state is a byte offset for each file, with a guard on what was read before."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quern.sources import stores

_ROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("value", pa.string())])


@dataclass
class LineRange(InputPartition):
    """The lines of a file that begin in [first, last); ``origin`` is where the batch begins."""

    path: str
    origin: int
    first: int
    last: int


def lines_of(own: LineRange):
    """Yield (offset, line) without line ends; the byte-order mark of a file is left out, the last line needs no end."""
    with stores.input_file(own.path) as file:
        at = own.first
        if at > own.origin:  # the line that reaches into this range belongs to the one before
            file.seek(at - 1)
            at += len(file.readline()) - 1
        else:
            file.seek(at)
        while at < own.last:
            line = file.readline()
            if not line:
                break
            yield at, line.rstrip(b"\r\n").decode("utf-8-sig" if at == 0 else "utf-8")
            at += len(line)


class LineReader(DataSourceStreamReader):
    """Offsets are ``{path: [bytes, digest of the file's head]}``, so Spark's own checkpoint holds them."""

    def __init__(self, options: dict):
        self.path, self.suffix, self.split, self.head = options["path"], options.get("suffix", ""), int(options.get("split_bytes", 64 << 20)), 4096

    def initialOffset(self):
        return {}

    def _mark(self, path: str, size: int) -> str:
        with stores.input_file(path) as file:
            return hashlib.sha256(file.read(min(self.head, size))).hexdigest()[:16]

    def latestOffset(self):
        out = {}
        for path in stores.files_below(self.path, self.suffix):
            size = stores.file_size(path)
            out[path] = [size, self._mark(path, size), min(self.head, size)]
        return out

    def partitions(self, start, end):
        out = []
        for path, (size, _, _) in sorted(end.items()):
            done, mark, length = start.get(path, [0, "", 0])
            if done > size or stores.file_size(path) < size or (done and self._mark(path, length) != mark):
                raise ValueError(f"{path} changed before byte {done}, up to which it was read")
            cuts = list(range(done, size, self.split))
            out += [LineRange(path, done, a, b) for a, b in zip(cuts, [*cuts[1:], size])]
        gone = set(start) - set(end)
        if gone:
            raise ValueError(f"files that were read are missing: {sorted(gone)}")
        return out or [LineRange("", 0, 0, 0)]

    def read(self, partition):
        rows, held = [], 0
        for offset, line in lines_of(partition) if partition.last > partition.first else ():
            rows.append((partition.path, offset, line))
            held += len(line)
            if held >= 16 << 20 or len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)

    def commit(self, end):
        pass


class LineSource(DataSource):
    """``spark.readStream.format("quern_lines")``; see :func:`stream_jsonl`."""

    @classmethod
    def name(cls):
        return "quern_lines"

    def schema(self):
        return "path string, offset long, value string"

    def streamReader(self, schema):
        return LineReader(self.options)


def stream_jsonl(spark: SparkSession, path: str, schema: str, suffix: str = "", split_bytes: int = 64 << 20) -> DataFrame:
    """JSON objects of a file or a folder's files, one a line: ``path, offset`` (in bytes) and the fields of ``schema``.

    A batch is all that was added since the last one, cut into ranges of ``split_bytes``, one task each. The state is how far
    each file was read, kept in the query's checkpoint: after a stop or a lost batch the query goes on at those bytes and a batch that is run again
    reads the same bytes. A file that is shorter than what was read, begins with other bytes or is gone is an error, as is a line that is
    blank or no JSON object. The last line of a file needs no line end; append whole lines only.
    """
    spark.dataSource.register(LineSource)
    lines = spark.readStream.format("quern_lines").options(path=path, suffix=suffix, split_bytes=str(split_bytes)).load()
    parsed = lines.select("path", "offset", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"), F.ltrim("value").startswith("{").alias("object"))
    where = F.concat(F.lit("no JSON object at byte "), F.col("offset"), F.lit(" of "), F.col("path"))
    fine = F.col("object") & F.col("r").isNotNull() & F.col("r._bad").isNull()
    checked = parsed.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(where).cast("boolean")))
    return checked.select("path", "offset", "r.*").drop("_bad")
