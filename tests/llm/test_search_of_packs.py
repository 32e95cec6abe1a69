"""A pack of queries goes through a block's tree once: answers, ties, repeated ids and work."""

import numpy as np
import pytest

from quern.llm.topk import NONE, MTree, exact_top_k


class Counted(list):
    """Pages that count how often one is opened."""

    opened = 0

    def __getitem__(self, place):
        self.opened += 1
        return super().__getitem__(place)


def wanted(vectors, ids, queries, own, k):
    scores = queries @ vectors.T
    return [sorted(((-int(s), int(i)) for s, i in zip(row, ids) if i != o))[:k] for row, o in zip(scores, own)]


def answered(tree, queries, own, k, known=None):
    known = np.full(len(queries), np.nan) if known is None else known
    scores, ids, compared = tree.search(queries, own, k, known)
    return [[(-int(s), int(i)) for s, i in zip(*row) if s > NONE] for row in zip(scores, ids)], compared


@pytest.mark.parametrize("size", [900, 1 << 28])
def test_a_pack_has_the_answers_of_each_query(size):
    rng = np.random.default_rng(3)
    vectors = np.r_[rng.integers(-size, size, (600, 6)), np.tile(rng.integers(-size, size, (1, 6)), (300, 1)), np.zeros((20, 6), np.int64)]
    ids = np.r_[np.arange(900), np.arange(20)]  # some ids come twice
    queries, own = np.r_[vectors[:150], vectors[700:702], vectors[-1:]], np.r_[np.arange(150), [5_000, 650], [19]]
    tree = MTree(ids, vectors, float((vectors.astype(float) ** 2).sum(axis=1).max()), page=16)
    want = wanted(vectors, ids, queries, own, 10)
    assert answered(tree, queries, own, 10)[0] == want
    limits = np.array([-w[9][0] for w in want], float)
    got = answered(tree, queries, own, 10, np.where(np.arange(len(limits)) % 3 == 0, np.nan, limits))[0]
    assert [g[: len(w)] for g, w in zip(got, want)] == want
    assert answered(MTree(ids[:4], vectors[:4], tree.norm2), queries[:9], own[:9], 10)[0] == wanted(vectors[:4], ids[:4], queries[:9], own[:9], 10)
    assert answered(tree, queries[:0], own[:0], 10)[0] == []


def test_a_page_is_opened_once_for_all_queries():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-900, 900, (2_000, 16))
    tree = MTree(np.arange(2_000), vectors, float((vectors.astype(float) ** 2).sum(axis=1).max()), page=32)
    tree.pages = Counted(tree.pages)
    got, compared = answered(tree, vectors[:400], np.arange(400), 5)
    assert got == wanted(vectors, np.arange(2_000), vectors[:400], np.arange(400), 5) and compared.max() <= 2_000
    assert tree.pages.opened <= len(tree.pages)


def test_null_and_repeated_rows_in_packs(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 250, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(500, 4)))] + [(None, [1.0] * 4), (0, None), (100, [None] * 4)]
    rows += rows[:300]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block_rows=60, query_rows=2, k=5).collect()
    whole = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v and v[0] is not None]
    ids, vectors = np.array([i for i, _ in whole]), np.array([v for _, v in whole])
    asked = {(i, tuple(v)) for i, v in whole if i % 100 == 0}
    want = set()
    for q in {i for i, _ in asked}:  # the queries of one id share its k places
        mine = [v for i, v in asked if i == q]
        best = sorted((s, i) for v in mine for s, i in wanted(vectors, ids, np.array([v]), [q], 5)[0])[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
