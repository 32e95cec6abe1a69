"""Joins with the curation tables' rules: blank for missing, trimmed keys, totality and provenance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.contracts import checkpointed, forbid_columns, raise_if, require_columns
from quern.functions.text import clean, path_part


def left_fanout(left: DataFrame, right: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Every left row with each of its right rows; text payload of unmatched rows is blank, other types null.

    Keys compare trimmed; a blank or null right key is an error of the running job.
    """
    require_columns(left, key), require_columns(right, key, *payload), forbid_columns(left, *payload)
    k = F.trim(F.col(key).cast("string"))
    right = right.select(raise_if(clean(k) == "", f"blank {key}", k).alias("_k"), *payload)
    types = dict(right.dtypes)
    filled = [clean(F.col(c)).alias(c) if types[c] == "string" else F.col(c) for c in payload]
    return left.withColumn("_l", k).join(right, F.col("_l") == F.col("_k"), "left").select(*left.columns, *filled)


def strict_lookup(left: DataFrame, dim: DataFrame, key: str, values: list[str]) -> DataFrame:
    """N:1 lookup in which every left key must be found; equal repeats in ``dim`` are one, conflicting ones an error."""
    require_columns(left, key), require_columns(dim, key, *values), forbid_columns(left, *values)
    one = [raise_if(F.count_distinct(F.col(v)) > 1, f"conflicting {v}", F.first(v, ignorenulls=True)).alias(v) for v in values]
    dim = dim.groupBy(F.col(key).alias("_k")).agg(*one)
    joined = left.join(dim, F.col(key) == F.col("_k"), "left")
    return joined.select(*left.columns, *[raise_if(F.col("_k").isNull(), f"{key} not found", F.col(v)).alias(v) for v in values])


def lookup_or(left: DataFrame, dim: DataFrame, key: str, value: str, default, order: str | None = None) -> DataFrame:
    """N:1 lookup with a default; of a repeated key the first value by ``order``, or the least one."""
    dim = dim.groupBy(F.col(key).alias("_k")).agg((F.min_by(value, order) if order else F.min(value)).alias(value))
    return left.join(dim, F.col(key) == F.col("_k"), "left").select(*left.columns, F.coalesce(value, F.lit(default)).alias(value))


def attach_grouped(left: DataFrame, grouped: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Left join to a table with one row for each key; misses take the defaults."""
    renamed = grouped.select(F.col(key).alias("_k"), *defaults)
    return left.join(renamed, F.col(key) == F.col("_k"), "left").select(*left.columns, *[F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()])


def found_and_missing(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    keys = right.select(key)
    return left.join(keys, key, "left_semi"), left.join(keys, key, "left_anti")


def first_text_by_key(rows: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """First non-blank text of each composite key."""
    return rows.where(F.trim(text) != "").groupBy(*keys).agg(F.min_by(text, order).alias(text))


def composite_join(left: DataFrame, rows: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Join on several columns to each key's first non-blank text; a missing key is an error of the running job."""
    own = first_text_by_key(rows, keys, text, order).withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    return left.join(own, on, "left").select(*left.columns, raise_if(F.col(text).isNull(), "no text for key", F.col(text)).alias(text))


def provenance_merge(direct: DataFrame, sync: DataFrame, key: str, direct_value: str, sync_values: list[str], order: str) -> DataFrame:
    """Full outer merge: the first direct row and the last sync row of each key, and which tables had it."""
    d = direct.groupBy(key).agg(F.min_by(direct_value, order).alias(direct_value))
    s = sync.groupBy(F.col(key).alias("_k")).agg(*[F.max_by(v, order).alias(v) for v in sync_values])
    both = d.join(s, F.col(key) == F.col("_k"), "full")
    tables = F.when(F.col("_k").isNull(), "direct_only").when(F.col(key).isNull(), "sync_only").otherwise("direct_and_sync")
    return both.select(F.coalesce(key, "_k").alias(key), direct_value, *sync_values, tables.alias("source_tables"))


def resolve_first(values: DataFrame, column: str, domains: list[DataFrame], out: str) -> DataFrame:
    """Resolve ``column`` in the first domain that knows it; each domain has columns (key, id)."""
    found = []
    for i, d in enumerate(domains):
        one = d.groupBy(F.col("key").alias(f"_k{i}")).agg(F.min("id").alias(f"_v{i}"))
        values = values.join(one, F.col(column) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    keep = [c for c in values.columns if not c.startswith(("_k", "_v"))]
    return values.select(*keep, F.coalesce(*found).alias(out))


def inner_fanout(left: DataFrame, right: DataFrame, keys: list[str], ordinal: str, payload: list[str]) -> DataFrame:
    """Every left row with each of its right rows and their ordinal; left rows without any disappear."""
    require_columns(left, *keys), require_columns(right, *keys, ordinal, *payload), forbid_columns(left, ordinal, *payload)
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], ordinal, *payload)
    return left.join(other, [F.col(k) == F.col(f"_{k}") for k in keys]).select(*left.columns, ordinal, *payload)


def require_members(left: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``left`` as it is; a key that ``known`` lacks is an error of the running job."""
    known = known.select(F.col(key).alias("_k")).distinct()
    joined = left.join(known, F.col(key) == F.col("_k"), "left")
    return joined.select(*[raise_if(F.col("_k").isNull(), f"{key} not found", F.col(c)).alias(c) if c == key else F.col(c) for c in left.columns])


def label_from_folder(rows: DataFrame, path: str, classes: DataFrame, name: str, label: str) -> DataFrame:
    """Label of each path by the name of its directory; every directory must be a class."""
    named = rows.withColumn(name, path_part(F.col(path), 2))
    return strict_lookup(named, classes, name, [label]).drop(name)


def in_cells(members: DataFrame, key: str, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join of ``members(key, _m)`` on ``_m, _i, _j``, in which no cell has much over ``cell_rows`` rows a side.

    A member of more rows is cut by a hash of the key into n parts, and its pairs into the n (n + 1) / 2 cells (i <= j) of a grid: a
    row of part c is the left one in the cells (c, j) and the right one in (i, c). A light member has one cell.
    """
    sizes = members.groupBy(F.col("_m").alias("_n")).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("_parts"))
    cut = members.join(sizes, F.col("_m") == F.col("_n")).withColumn("_c", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))
    left = cut.select(key, "_m", F.col("_c").alias("_i"), F.explode(F.sequence(F.col("_c"), F.col("_parts") - 1)).alias("_j"))
    right = cut.select(F.col(key).alias("_b"), F.col("_m").alias("_n"), F.explode(F.sequence(F.lit(0), F.col("_c"))).alias("_k"), F.col("_c").alias("_l"))
    return left, right


#: A self-join by blocks has this many of them, so that what moves grows with the rows, until a block would hold more than MOST_ROWS. A task has this many meetings.
MOST_BLOCKS, MOST_ROWS, TASK_MEETINGS = 24, 50_000, 4
_PACKED = "part int, ids binary, n_ids binary, members binary, n_members binary"


def _packed_sets(key, rows):
    """A block of different sets as one row: the keys that hold each set, its members' codes, and the lengths of both."""
    sizes = [np.array([len(x) for x in rows[c].to_pylist()], np.int32).tobytes() for c in ("keys", "codes")]
    flat = [pa.concat_arrays(rows[c].chunks).flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("keys", "codes")]
    columns = [[key[0].as_py()], [flat[0]], [sizes[0]], [flat[1]], [sizes[1]]]
    return pa.table(columns, schema=pa.schema([("part", pa.int32())] + [(n, pa.binary()) for n in ("ids", "n_ids", "members", "n_members")]))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... of every span, one span after another."""
    return np.repeat(first - _starts(sizes)[:-1], sizes) + np.arange(int(sizes.sum()))


def _set_counts(left, right, cells: int = 1 << 22, dense: int = 1 << 22):
    """Yield (rows of the left block, rows of the right one, shared members) for the pairs of sets that share any, some rows at a time."""
    (own, own_sizes), (other, other_sizes) = left, right
    names, codes = np.unique(other, return_inverse=True)
    n = len(other_sizes)
    found = np.minimum(np.searchsorted(names, own), max(len(names) - 1, 0))
    known = names[found] == own if len(names) else np.zeros(len(own), bool)
    row = np.repeat(np.arange(len(own_sizes)), own_sizes)[known]
    found = found[known]
    at = np.repeat(np.arange(n), other_sizes)
    if len(names) * n <= dense:
        table = np.zeros((n, len(names)), np.float32)
        table[at, codes] = 1
    order = np.argsort(codes, kind="stable")
    holders, sizes = at[order], np.bincount(codes, minlength=len(names))
    first = _starts(sizes)[:-1]
    begin, step = 0, max(1, cells // max(n, 1))
    while begin < len(own_sizes):
        lo, hi = np.searchsorted(row, [begin, begin + step])
        if len(names) * n <= dense:
            mine = np.zeros((min(step, len(own_sizes) - begin), len(names)), np.float32)
            mine[row[lo:hi] - begin, found[lo:hi]] = 1
            counts = (mine @ table.T).ravel()
        else:
            many = sizes[found[lo:hi]]
            met = holders[_spans(first[found[lo:hi]], many)]
            counts = np.bincount(np.repeat(row[lo:hi] - begin, many) * n + met)
        cell = np.flatnonzero(counts)
        yield cell // n + begin, cell % n, counts[cell].astype(np.int64)
        begin += step


def _set_meetings(least: int, out_rows: int = 1 << 20):
    """Pairs of keys of two blocks whose sets share ``least`` members, in batches of bounded size; within one block each pair once."""
    names = ("a", "b", "n_shared")

    def emit(a, b, n):
        """The rows in which a is the smaller key. The larger ones come by a call with both sides changed, as files are small where one column stays the same for many rows."""
        kept = a < b
        if kept.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept]), pa.array(n[kept])], names=names)

    def expanded(x, y, n, ids, starts, other, other_starts):
        """All pairs of the keys of the sets x and y."""
        if not len(x):
            return
        many, each = starts[x + 1] - starts[x], other_starts[y + 1] - other_starts[y]
        if many.max() == 1 and each.max() == 1:
            a, b = ids[starts[x]], other[other_starts[y]]
            yield from emit(a, b, n)
            yield from emit(b, a, n)
            return
        cut = _starts(many * each)
        lo = 0
        while lo < len(x):
            hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + out_rows, "right")) - 1)
            total = many[lo:hi] * each[lo:hi]
            place, shared = _spans(np.zeros(hi - lo, np.int64), total), np.repeat(n[lo:hi], total)
            mine, its = np.repeat(starts[x[lo:hi]], total), np.repeat(other_starts[y[lo:hi]], total)
            wide = np.repeat(each[lo:hi], total)
            yield from emit(ids[mine + place // wide], other[its + place % wide], shared)
            wide = np.repeat(many[lo:hi], total)
            yield from emit(other[its + place // wide], ids[mine + place % wide], shared)
            lo = hi

    def within(block, starts):
        """All pairs of the keys that hold one set, for every set of a block."""
        held, rows = [], 0
        for k in np.flatnonzero((block["n_ids"] > 1) & (block["n_members"] >= least)):
            x, y = np.triu_indices(block["n_ids"][k], 1)
            held.append((block["ids"][starts[k] + x], block["ids"][starts[k] + y], np.full(len(x), block["n_members"][k], np.int64)))
            rows += len(x)
            if rows >= out_rows:
                yield from emit(*map(np.concatenate, zip(*held)))
                held, rows = [], 0
        if held:
            yield from emit(*map(np.concatenate, zip(*held)))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                side = [{c: np.frombuffer(row[f"{s}_{c}"], np.int32 if c.startswith("n_") else np.int64) for c in ("ids", "n_ids", "members", "n_members")} for s in "lr"]
                left, right = side
                starts, other = _starts(left["n_ids"]), _starts(right["n_ids"])
                same = row["l_part"] == row["r_part"]
                for x, y, n in _set_counts((left["members"], left["n_members"]), (right["members"], right["n_members"])):
                    kept = (n >= least) & (x < y) if same else n >= least
                    yield from expanded(x[kept], y[kept], n[kept], left["ids"], starts, right["ids"], other)
                if same:
                    yield from within(left, starts)

    return run


def sharing_pairs(rows: DataFrame, key: str, members: str, least: int = 1, cell_rows: int = 2_000) -> DataFrame:
    """Pairs a < b of rows that share ``least`` members or more, with the count of shared ones; keys are long.

    Rows with equal sets are folded into one (up to ``cell_rows`` / 4 keys each, by a hash of the key, so that none is hot) and dealt into blocks of about ``cell_rows``
    keys. Every block meets every other one, and itself, once: it meets the blocks up to half the circle before it, TASK_MEETINGS of them in a task, by an equi-join
    on the block number and the task's place, so that tasks are many and even however small the blocks are. A meeting counts the shared members of
    its pairs of sets and expands those with enough of them into pairs of keys, in batches of bounded size. So no pair is ever shuffled:
    what moves are the sets, at most once for each block, and the work beyond is the result's own size.

    Nulls: a null set or key takes part in nothing; null members and repeated ones within a set count once at most; keys are unique.
    """
    sets = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_k"), F.array_distinct(F.filter(members, lambda x: x.isNotNull())).alias("_set"))
    each = checkpointed(sets.where(F.size("_set") >= least).select("_k", F.explode("_set").alias("_m")))
    codes = checkpointed(each.select(F.col("_m").alias("_n")).distinct().withColumn("_code", F.monotonically_increasing_id()))
    coded = each.join(codes, F.col("_m") == F.col("_n")).groupBy("_k").agg(F.array_sort(F.collect_list("_code")).alias("codes"))
    sizes = coded.groupBy(F.col("codes").alias("_c")).agg(F.ceil(F.count("*") / max(1, cell_rows // 4)).cast("int").alias("_cuts"))
    cut = coded.join(sizes, F.col("codes") == F.col("_c")).withColumn("_cut", F.pmod(F.xxhash64("_k"), F.col("_cuts")))
    folded = checkpointed(cut.groupBy("codes", "_cut").agg(F.array_sort(F.collect_list("_k")).alias("keys")))
    n = folded.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    parts = max(1, -(-n // MOST_ROWS), min(-(-n // cell_rows), MOST_BLOCKS))
    dealt = folded.select(F.pmod(F.xxhash64("codes", "_cut"), F.lit(parts)).cast("int").alias("part"), "keys", "codes")
    blocks = checkpointed(dealt.groupBy("part").applyInArrow(_packed_sets, _PACKED))
    packed = ("ids", "n_ids", "members", "n_members")
    apart, half = F.explode(F.sequence(F.lit(0), F.lit(parts // 2))).alias("_apart"), parts // 2
    left = blocks.select(F.col("part").alias("l_part"), *[F.col(c).alias(f"l_{c}") for c in packed], apart)
    left = left.where((F.col("_apart") * 2 < parts) | (F.col("l_part") < half))  # two blocks half a circle apart meet once
    left = left.withColumns({"_at": (F.col("l_part") + F.col("_apart")) % parts, "_task": (F.col("_apart") / TASK_MEETINGS).cast("int")}).drop("_apart")
    right = blocks.select(F.col("part").alias("r_part"), *[F.col(c).alias(f"r_{c}") for c in packed], F.explode(F.sequence(F.lit(0), F.lit(half // TASK_MEETINGS))).alias("_its"))
    tasks = parts * (half // TASK_MEETINGS + 1)
    left, right = left.repartition(tasks, "_at", "_task"), right.repartition(tasks, "r_part", "_its")
    met = left.join(right.hint("shuffle_hash"), (F.col("_at") == F.col("r_part")) & (F.col("_task") == F.col("_its"))).drop("_at", "_task", "_its")
    return met.mapInArrow(_set_meetings(least), "a long, b long, n_shared long")


def with_templates(classes: DataFrame, name: str, templates: list[str]) -> DataFrame:
    """Every class in every prompt template; the templates are a literal array, so this is an explode, not a cross join."""
    return classes.select("*", F.posexplode(F.array(*map(F.lit, templates))).alias("template_no", "_t")).withColumn("prompt", F.replace("_t", F.lit("{}"), F.col(name))).drop("_t")
