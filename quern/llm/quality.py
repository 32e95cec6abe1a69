"""Quality rules: text statistics and robust multivariate outliers (minimum covariance determinant), in SQL functions only."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, join_small

_WHITE = "[\\x20\\x09-\\x0D]"
_INK = "[^\\x20\\x09-\\x0D]"
#: The transformed statistics, each with the standard deviation below which a direction counts as having no spread of its own.
STATS = {
    "log_words": ("ln(1 + n_words)", 0.5),
    "log_word_len": ("ln(1 + word_chars / greatest(n_words, 1))", 0.10),
    "symbols": ("ln(1 + 200.0 * n_symbols / greatest(word_chars, 1))", 0.5),
    "dup_lines": ("ln(1 + 50.0 * n_dup_lines / greatest(n_words, 1))", 0.5),
    "repeats": ("sqrt(n_repeat_words / greatest(n_words, 1))", 0.15),
}
#: chi-square quantile at 1 - 1e-5 for as many degrees of freedom as there are statistics.
CUTOFF = 30.86


def with_repeat_words(rows: DataFrame, n: int = 3) -> DataFrame:
    """Add n_repeat_words: words inside n-word windows that occur twice or more in the text, the first included.

    The windows' hashes are sorted with their places; equal neighbours are repeats. Each step is a column of its own,
    so that no lambda computes an array again, and texts without a repeat skip the sort.
    """
    words = F.col("words")
    windows = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    rows = rows.withColumn("grams", F.transform(windows, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)])))
    grams = F.col("grams")
    placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct(grams)) < F.size(grams), placed).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
    placed = F.col("placed")

    def flag(z, i):
        same = lambda j: F.coalesce(F.get(placed, j)["g"] == z["g"], F.lit(False))
        return F.when(((i > 0) & same(i - 1)) | same(i + 1), z["i"])

    starts = F.array_sort(F.array_compact(F.transform(placed, flag)))
    step = lambda acc, s: F.struct((acc["n"] + F.least(F.lit(n), s - acc["last"])).alias("n"), s.alias("last"))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")), step, lambda acc: acc["n"])
    return rows.withColumn("n_repeat_words", covered.cast("long"))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys=("lang", "source"), keep_cols: bool = False) -> DataFrame:
    """Word and line statistics of every whole text (null: no words), with the group columns beside them.

    With ``keep_cols`` the row itself stays, as the struct ``_whole_row``.
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole_row")] if keep_cols else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*whole, F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[F.col(k).cast("string").alias(f"key{i}") for i, k in enumerate(keys)])
    words = F.filter(F.split("text", _WHITE + "+"), lambda w: w != "")
    rows = with_repeat_words(rows.withColumn("words", words))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_INK))
    return rows.select(
        *(["_whole_row"] if keep_cols else []),
        "doc_id",
        *[f"key{i}" for i in range(len(keys))],
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(_WHITE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


#: The starts of the concentration steps: scatters about the median of transforms of the standardised statistics.
STARTS = ("sign", "tanh", "spatial sign", "all rows")
#: Rank error of the mergeable quantile sketches is one in this many rows.
SKETCH = 2_000


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function, by the recurrence over the degrees of freedom."""
    value = math.erf(math.sqrt(x / 2)) if k % 2 else 1 - math.exp(-x / 2)
    for j in range(1 if k % 2 else 2, k - 1, 2):
        value -= math.exp(j / 2 * math.log(x / 2) - x / 2 - math.lgamma(j / 2 + 1)) if x > 0 else 0.0
    return value


def chi2_quantile(share: float, k: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < share else (low, mid)
    return low


def consistency(share: float, p: int) -> float:
    """What the covariance of the nearest ``share`` of normal rows must be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, p), p + 2)


def _pairs(p: int) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(p), 2))


def _moments(rows: DataFrame, keys: list[str], stats: list[str], factor: float) -> DataFrame:
    """Count, means and covariances times ``factor`` of each group, map-side combined."""
    means = [F.avg(s).alias(f"m{i}") for i, s in enumerate(stats)]
    cross = [F.avg(F.col(stats[i]) * F.col(stats[j])).alias(f"p{i}_{j}") for i, j in _pairs(len(stats))]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), *means, *cross)
    cov = [(F.lit(factor) * (F.col(f"p{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}"))).alias(f"c{i}_{j}") for i, j in _pairs(len(stats))]
    return groups.select(*keys, "n", *[f"m{i}" for i in range(len(stats))], *cov)


def _factor(groups: DataFrame, keys: list[str], floors: list[float]) -> DataFrame:
    """Cholesky factor of each group's covariance, a column for each entry, and its log determinant.

    A direction whose variance, given the directions before it, is below its floor is singular for our purpose and takes the floor.
    """
    p = len(floors)
    for j in range(p):
        rest = sum((F.col(f"l{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        groups = groups.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(F.col(f"c{j}_{j}") - rest, F.lit(floors[j] ** 2))))
        below = {}
        for i in range(j + 1, p):
            rest = sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
            below[f"l{i}_{j}"] = (F.col(f"c{j}_{i}") - rest) / F.col(f"l{j}_{j}")
        groups = groups.withColumns(below) if below else groups
    log_det = sum((2 * F.log(f"l{j}_{j}") for j in range(p)), F.lit(0.0))
    return groups.select(*keys, "n", log_det.alias("log_det"), *[f"m{i}" for i in range(p)], *[f"l{i}_{j}" for i in range(p) for j in range(i + 1)])


def _with_distance(rows: DataFrame, groups: DataFrame, keys: list[str], stats: list[str], n_groups: int, how: str = "inner") -> DataFrame:
    """Add the squared Mahalanobis distance ``d2`` of every row to its group, by forward substitution."""
    joined = join_small(rows, groups.drop("n", "log_det"), keys, n_groups, how)
    for i, s in enumerate(stats):
        rest = sum((F.col(f"l{i}_{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        joined = joined.withColumn(f"y{i}", (F.col(s) - F.col(f"m{i}") - rest) / F.col(f"l{i}_{i}"))
    return joined.select(*rows.columns, sum((F.col(f"y{i}") ** 2 for i in range(len(stats))), F.lit(0.0)).alias("d2"))


def _starts(fit: DataFrame, keys: list[str], stats: list[str], floors: list[float], n_groups: int) -> DataFrame:
    """Cholesky factors of every group and start."""
    p = len(stats)
    quarter = [F.percentile_approx(s, [0.25, 0.5, 0.75], SKETCH).alias(f"q{i}") for i, s in enumerate(stats)]
    scales = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(floors[i])) for i in range(p)]
    middle = fit.groupBy(*keys).agg(*quarter)
    middle = checkpointed(middle.select(*keys, *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(p)], *[s.alias(f"s{i}") for i, s in enumerate(scales)]))
    z = join_small(fit, middle, keys, n_groups).select(*keys, *[((F.col(s) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i, s in enumerate(stats)])
    length = F.greatest(F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(p)), F.lit(0.0))), F.lit(1e-9))
    z = z.withColumn("length", length).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(len(STARTS) - 1))))
    forms = lambda c: F.when(F.col("start") == 0, F.signum(c)).when(F.col("start") == 1, F.tanh(c)).when(F.col("start") == 2, c / F.col("length")).otherwise(c)
    z = z.withColumns({f"z{i}": forms(F.col(f"z{i}")) for i in range(p)})
    cross = z.groupBy(*keys, "start").agg(F.count("*").alias("n"), *[F.avg(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}_{j}") for i, j in _pairs(p)])
    both = join_small(cross, middle, keys, n_groups)
    groups = both.select(*keys, "start", "n", *[f"m{i}" for i in range(p)], *[(F.col(f"p{i}_{j}") * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}_{j}") for i, j in _pairs(p)])
    return _factor(groups, [*keys, "start"], floors)


def robust_estimates(fit: DataFrame, keys: list[str], stats: list[str], floors: list[float], n_groups: int, share: float = 0.75, steps: int = 12, refit: float = 0.975) -> DataFrame:
    """Minimum covariance determinant estimate of every group of ``keys``: mean ``m{i}`` and Cholesky factor ``l{i}_{j}``.

    Two concentration steps from each of four deterministic starts (``STARTS``) keep the ``share`` of rows nearest to the
    estimate and re-estimate; the start with the smallest determinant goes on until no determinant of any group falls by a hundredth, or
    for ``steps`` steps (the determinant falls at every step, so the last estimate is the best). Its covariance is made consistent at the
    normal law, and mean and covariance are estimated once more, with their own factor, from the rows within the ``refit`` quantile. Each
    step is two map-side combined aggregates over the slim rows; the subset's edge comes from a mergeable quantile sketch.
    """
    p, both = len(stats), [*keys, "start"]

    def concentrated(rows, groups, by, size):
        near = _with_distance(rows, groups, by, stats, size)
        limit = near.groupBy(*by).agg(F.percentile_approx("d2", share, SKETCH).alias("limit"))
        near = join_small(near, limit, by, size).where("d2 <= limit")
        return checkpointed(_factor(_moments(near, by, stats, 1.0), by, floors))

    groups = checkpointed(_starts(fit, keys, stats, floors, n_groups))
    started = fit.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(len(STARTS) - 1))))
    for _ in range(2):
        groups = concentrated(started, groups, both, n_groups * len(STARTS))
    best = groups.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in groups.columns if c not in both]), F.struct("log_det", "start")).alias("g")).select(*keys, "g.*")
    best = checkpointed(best)
    for _ in range(steps):
        new = concentrated(fit, best, keys, n_groups)
        falling = new.join(best.select(*keys, F.col("log_det").alias("before")), keys).where("log_det < before - 0.01").limit(1).count()
        best = new
        if not falling:
            break
    grow = math.sqrt(consistency(share, p))
    best = best.withColumns({f"l{i}_{j}": F.col(f"l{i}_{j}") * grow for i in range(p) for j in range(i + 1)})
    near = _with_distance(fit, best, keys, stats, n_groups).where(F.col("d2") <= chi2_quantile(refit, p))
    return checkpointed(_factor(_moments(near, keys, stats, consistency(refit, p)), keys, floors))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys=("lang", "source"), share: float = 0.75, cutoff: float = CUTOFF, least_group: int = 30, keep_cols: bool = False
) -> DataFrame:
    """Base rules, then rejection by robust Mahalanobis distance within (language, source).

    For every group of ``keys`` mean and covariance of the transformed statistics (``STATS``) are the minimum covariance
    determinant estimate (:func:`robust_estimates`). Text is read once; all else works on the slim statistics table, by aggregates and
    by joins with the table of groups, which is broadcast if it is small and salted if not, so a hot source costs no more than
    its share. Where a statistic has next to no spread (a constant), its floor in ``STATS`` stands in.

    Groups of fewer than ``least_group`` rows that pass the base rules are judged by the estimate
    of all rows with the same keys but the last (the language), and where these are too few, too, of all rows.

    Nulls and edge cases: null text has no words and fails the base rules; null keys form a
    group of their own; only a table of fewer than ``least_group`` such rows in all gives no estimate and rejects nothing by distance;
    repeated rows count as often as they occur; an empty table gives an empty result.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2``
    and the keys as ``key0, key1``; a row for each input row. With ``keep_cols`` the columns of ``docs`` come first, as ``_whole_row``.
    """
    names, stats, floors = [f"key{i}" for i in range(len(keys))], list(STATS), [f for _, f in STATS.values()]
    rows = text_statistics(docs, id_col, text_col, keys, keep_cols)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, **{s: F.expr(e).cast("double") for s, (e, _) in STATS.items()}})
    rows = checkpointed(rows.withColumns({k: F.coalesce(F.concat(F.lit("="), k), F.lit("")) for k in names}))
    slim = checkpointed(rows.select(*names, *stats, "base_failed")) if keep_cols else rows
    fit = slim.where("NOT base_failed").select(*names, *stats)
    levels = [[F.col(k) if i < len(names) - j else F.lit("*").alias(k) for i, k in enumerate(names)] for j in range(len(names) + 1)]
    counted = fit.groupBy(*names).agg(F.count("*").alias("n"))
    counted = checkpointed(slim.select(*names).distinct().join(counted, names, "left"))
    at = [F.sum("n").over(Window.partitionBy(*level)) for level in levels[:-1]]
    all_rows = counted.agg(F.count("*"), F.sum("n")).first()
    at.append(F.lit(all_rows[1]))
    judge = F.coalesce(*[F.when(n >= least_group, F.struct(*[c.alias(f"j_{k}") for c, k in zip(level, names)])) for n, level in zip(at, levels)])
    judge = checkpointed(counted.select(*names, judge.alias("j")).select(*names, "j.*"))
    n_groups = all_rows[0]
    wanted = judge.select(*[F.col(f"j_{k}").alias(k) for k in names]).dropna().distinct()
    own = reduce(DataFrame.unionByName, [join_small(fit.select(*level, *stats), wanted.where((F.lit(j) == 0) | (F.col(names[-j]) == "*")), names, n_groups, "left_semi") for j, level in enumerate(levels)])
    groups = robust_estimates(checkpointed(own), names, stats, floors, n_groups, share)
    groups = groups.withColumnsRenamed({k: f"j_{k}" for k in names})
    judged = _with_distance(join_small(rows, judge, names, n_groups, "left"), groups, [f"j_{k}" for k in names], stats, n_groups, "left")
    far = F.coalesce("d2", F.lit(0.0)) > cutoff
    return judged.select(
        *(["_whole_row"] if keep_cols else []), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "d2", *names
    )
