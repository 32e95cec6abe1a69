"""Evaluation metrics and losses as aggregates over scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import mean_vector, normalise


def class_centroids(rows: DataFrame, label: str, vector: str, dim: int) -> DataFrame:
    """Mean of the unit vectors of each class, scaled to unit length."""
    unit = rows.select(label, normalise(F.col(vector).cast("array<double>")).alias("_u"))
    return unit.groupBy(label).agg(mean_vector("_u", dim).alias("_m")).select(label, normalise(F.col("_m")).alias("centroid"))


def zero_shot(rows: DataFrame, centroids: DataFrame, key: str, vector: str, label: str, scale: float = 100.0, most_classes: int = 20_000) -> DataFrame:
    """Logit, probability and rank of every class for each row: scores, softmax and order are made where the rows are, without a shuffle.

    The classifier is one matrix in the task's closure. More than ``most_classes`` classes are an error: they are
    prompts and no data, and each row carries all their scores. Equal logits (to 9 digits) go by class. A vector
    or class with a null (component) has null logits and probabilities, which come last and leave the others' as they are.
    """
    table = centroids.select(F.col(label).alias("class"), "centroid").orderBy("class").limit(most_classes + 1).toArrow()
    if table.num_rows > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    classes, weights = table["class"].combine_chunks(), [w if w is not None and None not in w else None for w in table["centroid"].to_pylist()]
    kinds = dict(rows.dtypes)
    unit = rows.select(key, F.col(label).alias("label"), normalise(F.col(vector).cast("array<double>")).alias("_x"))
    schema = f"`{key}` {kinds[key]}, label {kinds[label]}, class {dict(centroids.dtypes)[label]}, logit double, probability double, rank int"
    return unit.mapInArrow(_scored(classes, weights, scale), schema)


def _scored(classes: pa.Array, weights: list, scale: float):
    """Rows of every class for each vector, by one matrix product a part of a batch; a null or a null component leaves its logits null."""
    n, dim = len(classes), max([len(w) for w in weights if w is not None], default=0)
    known = np.array([w is not None and len(w) == dim for w in weights], bool)
    table = np.array([w if k else [0.0] * dim for w, k in zip(weights, known)], float).reshape(n, dim)

    def run(batches):
        step = max(1, 1_000_000 // max(n, 1))
        for batch in batches if n else ():
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                given = part.column("_x").to_pylist()
                whole = np.array([v is not None and len(v) == dim and None not in v for v in given], bool)
                x = np.array([v if w else [0.0] * dim for v, w in zip(given, whole)], float).reshape(len(given), dim)
                logit, void = scale * (x @ table.T), ~(whole[:, None] & known[None])
                first = np.where(void, np.inf, -np.round(logit, 9))
                order = np.argsort(first, axis=1, kind="stable")
                logit, void = np.take_along_axis(logit, order, axis=1), np.take_along_axis(void, order, axis=1)
                mass = np.exp(logit - np.where(void, -np.inf, logit).max(axis=1, keepdims=True), where=~void, out=np.zeros_like(logit))
                with np.errstate(invalid="ignore"):
                    probability = mass / mass.sum(axis=1, keepdims=True)
                of, hidden = np.repeat(np.arange(len(given)), n), void.reshape(-1)
                columns = [part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), classes.take(pa.array(order.reshape(-1))), pa.array(logit.reshape(-1), mask=hidden)]
                columns += [pa.array(probability.reshape(-1), mask=hidden), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(given)))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:2], "class", "logit", "probability", "rank"])

    return run


def topk_accuracy(ranked: DataFrame, ks=(1, 5)) -> DataFrame:
    hits = ranked.where(F.col("class") == F.col("label"))
    return hits.agg(F.count("*").alias("n_rows"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"top{k}") for k in ks])


def retrieval(ranks: DataFrame, rank: str = "place") -> DataFrame:
    """Mean and median rank and recalls from 0-based places of the true matches."""
    p = F.col(rank)
    return ranks.agg(
        (F.avg(p) + 1).alias("mean_rank"), (F.floor(F.median(p)) + 1).cast("double").alias("median_rank"), *[F.avg((p < k).cast("double")).alias(f"recall_at_{k}") for k in (1, 5, 10)]
    )


def multi_label_top1(ranked: DataFrame, labels: str = "labels") -> DataFrame:
    """Share of rows whose first class is one of their labels."""
    return ranked.where("rank = 1").agg(F.count("*").alias("n_rows"), F.avg(F.array_contains(labels, F.col("class")).cast("double")).alias("top1"))


def log_sum_exp(value: Column, top: Column, w) -> Column:
    """log of the summed exponentials over a window whose largest value is ``top``, so that none overflows."""
    return top + F.log(F.sum(F.exp(value - top)).over(w))


def contrastive_loss(logits: DataFrame, row: str, column: str, logit: str) -> DataFrame:
    """Symmetric cross entropy of a square logit table, the diagonal being the matches."""
    for c, name in ((row, "_r"), (column, "_c")):
        w = Window.partitionBy(c)
        logits = logits.withColumn("_top", F.max(logit).over(w)).withColumn(name, log_sum_exp(F.col(logit), F.col("_top"), w))
    both = logits.where(F.col(row) == F.col(column))
    return both.agg(F.avg((F.col("_r") + F.col("_c")) / 2 - F.col(logit)).alias("loss"))


def soft_target_loss(student: Column, teacher_probability: Column) -> Column:
    """One summand of the soft cross entropy; sum over classes, average over rows."""
    return -teacher_probability * F.log(student)


def triplet_terms(positive: Column, negative: Column, weight: float = 1.0, tau: float = 0.1) -> Column:
    """Selectively contrastive term: the weighted negative if it is nearer than the positive, else the two-way softmax loss."""
    return F.when(negative > positive, weight * negative).otherwise(F.log(F.exp(positive / tau) + F.exp(negative / tau)) - positive / tau)


def margin_term(similarity: Column, margin: float) -> Column:
    return F.greatest(similarity - margin, F.lit(0.0))


def warmup_cosine(step: Column, steps: int, warmup: int, base: float) -> Column:
    progress = (step - warmup) / (steps - warmup)
    return F.when(step < warmup, base * (step + 1) / warmup).otherwise(0.5 * (1 + F.cos(F.pi() * progress)) * base)


def step_decay(step: Column, every: int, base: float, gamma: float) -> Column:
    return base * F.pow(F.lit(gamma), F.floor(step / every))


def warmup_exponential(step: Column, steps: int, warmup: int, base: float, gamma: float, power: float = 1.0) -> Column:
    """Linear warm-up, then a decay that reaches ``base * gamma ** power`` at the last step."""
    return F.when(step < warmup, base * (step + 1) / warmup).otherwise(base * F.pow(F.lit(gamma), (step - warmup) / (steps - warmup) * power))


def harmonic_throughput(a: Column, b: Column) -> Column:
    """Pairs a second if both parts run one after the other."""
    return 1 / (1 / a + 1 / b)
