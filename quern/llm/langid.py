"""Language identification by compression against per-language raw-content dictionaries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, join_small

_LETTER = regex.compile(r"\p{L}")


def _folded(text: str) -> str:
    """Case and white space say nothing of the language."""
    return " ".join(text.lower().split())


def learn_dictionaries(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 64, sample_rows: int = 8_192, long_chars: int = 20_000
) -> dict[str, bytes]:
    """One raw-content dictionary for every language of ``labelled``, the most frequent language first.

    A language gives ``sample_docs`` rows (all, if fewer), those with the smallest hashes of the id, rows of over ``long_chars`` characters
    only after all others; with many languages so many fewer that about ``sample_rows`` rows are drawn in all, one a language at
    least. That is the bound on what reaches the driver. A drawn text is used whole: the dictionary is all of them, one after the
    other. Texts without a letter and null languages are left out.
    """
    rows = labelled.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    place = F.struct((F.length("text") > long_chars).alias("long"), F.col("h"))
    slim = checkpointed(rows.select("lang", place.alias("place")))
    counts = {r["lang"]: r["n"] for r in slim.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    most = max(1, min(sample_docs, sample_rows // len(counts)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    last = slim.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("lang").agg(F.max("place").alias("last"))
    drawn = join_small(rows.withColumn("place", place), last, ["lang"], len(counts)).where("place <= last").select("lang", "place", "text").collect()
    found: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        own = sorted((r["place"], r["text"]) for r in drawn if r["lang"] == lang)
        found[lang] = " ".join(dict.fromkeys(_folded(text) for _, text in own)).encode()
    return found


def compressors(dictionaries: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    """A compressor for each dictionary, whose window and tables span the whole of it.

    Matches of three bytes count: they tell languages apart in short texts, where longer ones are rare.
    """
    out = []
    for raw in dictionaries.values():
        bits = min(max(len(raw), 1 << 15).bit_length(), 27)
        fine = zstandard.ZstdCompressionParameters(window_log=bits + 1 if bits < 27 else 27, hash_log=min(bits, 20), chain_log=min(bits, 20), search_log=3, min_match=3, strategy=zstandard.STRATEGY_LAZY2)
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=fine)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=fine))
    return out


def _classify(dictionaries, margin: float, temperature: float):
    """``dictionaries`` is a Spark broadcast of the learned bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    def run(batches):
        langs, packers = list(dictionaries.value), compressors(dictionaries.value)
        for batch in batches:
            pred, score, accepted = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                if not langs or text is None or not _LETTER.search(text):
                    pred.append("und"), score.append(0.0), accepted.append(False)
                    continue
                raw = _folded(text).encode()
                sizes = np.array([len(p.compress(raw)) for p in packers], float)
                best = int(sizes.argmin())
                gain = sizes - sizes[best]
                rest = np.delete(gain, best)
                pred.append(langs[best])
                score.append(float(1 / np.exp(-gain / temperature).sum()))
                accepted.append(bool(len(rest) == 0 or rest.min() >= margin * max(math.sqrt(len(raw)), 1)))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def identify_languages(
    docs: DataFrame, dictionaries: dict[str, bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: float = 0.15, temperature: float = 4.0
) -> DataFrame:
    """Predict the language whose dictionary shortens the whole text most; narrow margins are rejected.

    Each text is compressed once with every language's dictionary; the smallest size decides, ties to
    the language that comes first in ``dictionaries``. ``score`` is the softmax of the size differences in bytes; ``accepted`` is false if the
    runner-up is within ``margin * sqrt(bytes)`` bytes, so that a caller may treat the row as undecided.
    Without ``dictionaries`` they are learned from the rows whose crc32 of the id's text, modulo 3, is not 1. They go to the
    tasks as one broadcast, of the sampled rows' size.

    Nulls and edge cases: null text and text without a letter give ``und``, score 0, not accepted; so
    does everything if no language was learned. A null id counts as learnable (not held out). Repeated rows and extra
    columns change nothing else; an empty table gives an empty result.

    Returns ``doc_id, held_out, lang_pred, score, accepted``.
    """
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    if dictionaries is None:
        dictionaries = learn_dictionaries(docs.where(~held_out), id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_classify(shared, margin, temperature), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
