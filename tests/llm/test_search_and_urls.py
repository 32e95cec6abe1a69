"""Top-k search and URL filters against brute force, with nulls, ties, repeats and clashing columns."""

import re

import numpy as np
from pyspark.sql import functions as F

from quern.llm.topk import MTree, exact_top_k
from quern.llm.urls import PATTERN_RULES, SITE_RULES, filter_urls, index_rules


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(500)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(600, rows[100][1]), (601, rows[200][1])]
    rows += [(700, None), (701, [1.0, None] + [0.0] * 6), (702, [float("nan")] + [0.0] * 7), (703, [float("inf")] + [0.0] * 7), (704, []), (None, rows[5][1])]
    rows += [(800, [1.0, 2.0]), (801, [0.5, 0.5]), (900, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return rows, df.withColumns({c: F.lit(1) for c in ("dim", "block", "v", "ids", "rank", "score")})


def brute(rows, k=10):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            usable[i] = np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)
    out = set()
    for q, x in usable.items():
        if q % 100 == 0:
            scored = sorted((-int(x @ y), i) for i, y in usable.items() if i != q and len(y) == len(x))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k_matches_brute_force(spark):
    rows, df = vectors(spark)
    for block in (4_000, 90):
        got = exact_top_k(df, block_rows=block, query_rows=3).collect()
        assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_top_k_prunes_cells_and_pages(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 10
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8) * 0.3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = exact_top_k(df, block_rows=150, query_rows=10, page=16, counts=True).collect()
    assert {tuple(r)[:4] for r in got} == brute(rows)
    compared = sorted({r.query_id: r.n_compared for r in got}.values())
    assert compared[len(compared) // 2] < 3000 / 4 and sum(compared) < 30 * 3000 / 2, compared


def test_a_block_meets_only_the_packs_of_its_cell(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 6)) * 20
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=6) * 0.1]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    meetings = []
    got = exact_top_k(df, queries=df, block_rows=100, query_rows=50, page=16, meetings=meetings)
    usable = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64)
    scores = usable @ usable.T
    np.fill_diagonal(scores, -(1 << 60))
    want = {(q, r + 1, int(i), int(scores[q, i])) for q in range(1600) for r, i in enumerate(np.lexsort((np.arange(1600), -scores[q]))[:10])}
    assert {tuple(r) for r in got.collect()} == want
    # Alone, 32 packs would meet some 16 blocks; here each cell has as many packs as its queries fill.
    assert meetings[0] <= 2 * (1600 / 50) * (1600 / 100) / 8 and sum(meetings) < (1600 / 50) * (1600 / 100), meetings


def test_top_k_refuses_scores_beyond_a_long(spark):
    import pytest

    with pytest.raises(ValueError):
        exact_top_k(spark.createDataFrame([(100, [1e30, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>"))


def test_top_k_of_an_empty_table(spark):
    assert exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tree_radii_cover_their_points():
    rng = np.random.default_rng(4)
    v = np.r_[rng.integers(-900, 900, (700, 6)), np.tile(rng.integers(-900, 900, (1, 6)), (300, 1))]
    tree = MTree(np.arange(1000), v, float((v.astype(float) ** 2).sum(1).max()), page=16)
    assert max(len(p[1]) for p in tree.pages) <= 16

    def points(n):
        leaf, _, _, below, pts, _ = tree.pages[n]
        return pts if leaf else np.concatenate([points(c) for c in below])

    for leaf, _, radii, below, centres, _ in tree.pages:
        if not leaf:
            for child, r, c in zip(below, radii, centres):
                assert np.sqrt(((points(child) - c) ** 2).sum(1)).max() <= r + 1e-6


def pages(spark):
    urls = ["http://www.example.org/es/1", "https://EXAMPLE.org/en/12?x#y", "http://a.org", "http://a.org?x", "http://shop.com/fr/1", "http://shop.com/de/", "http://shop.com/en/"]
    urls += ["http://adult-x.net/", "http://my-cheap-pills.net/p", "http://x.net/login", "http://x.net/catalogin", "http://u@x.net/", "http://x.net/a.zip?b", None, "", "no scheme", "://", "http://notexample.org.evil/es/", "http://x.net/login"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return urls, df.withColumns({c: F.lit("own") for c in ("host", "path", "rule", "verdict", "html")})


def test_url_verdicts(spark):
    urls, df = pages(spark)
    got = {r.page_id: r for r in filter_urls(df).collect()}
    for i, url in enumerate(urls):
        m = re.search("://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if any(re.search(p, (url or "").lower()) for p, _ in PATTERN_RULES) else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), url
    assert filter_urls(df.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    _, df = pages(spark)
    index, everywhere = index_rules(df)
    assert "pills" in index or "cheap" in index
    assert everywhere == [len(PATTERN_RULES) - 1] and index["login"] == [3]
    common = spark.createDataFrame([("http://cheap.net/cheap",)] * 5 + [("http://pills.net",)], "url string")
    assert index_rules(common)[0]["pills"] == [1] and "cheap" not in index_rules(common)[0]


def test_tokens_come_from_the_parsed_patterns():
    from quern.llm.urls import literal_tokens

    sets = {p: {frozenset(s) for s in t} for p, t in PATTERN_RULES}
    assert sets[r"://([^/]*[.-])?(cheap|discount)-pills[.-]"] == {frozenset({"cheap", "discount"}), frozenset({"pills"})}
    for unsure in (r"foo[0-9]+bar", r"a.b", r"x{2,}foo", r"(?i:foo)", r"(?i)/foo/", r"foo", r"[a-z]foo/"):
        assert literal_tokens(unsure) == (), unsure
    assert literal_tokens(r"^https?://spam[.]") == (frozenset({"http", "https"}), frozenset({"spam"}))
    assert literal_tokens(r"/ads?/") == (frozenset({"ad", "ads"}),)


def test_rules_from_a_table(spark):
    from quern.llm.urls import load_rules

    table = spark.createDataFrame([("a.org", "/x", "block", None), ("org", None, "allow", None), (None, None, None, r"/bad/"), (None, None, None, r"/bad/")], "host string, path string, verdict string, pattern string")
    sites, patterns = load_rules(table)
    assert sites == (("a.org", "/x", "block"), ("org", "/", "allow")) and patterns == ((r"/bad/", (frozenset({"bad"}),)),)
    pages = spark.createDataFrame([(1, "http://b.a.org/x1"), (2, "http://q.org/bad/"), (3, "http://q.net/bad/"), (4, "http://" + "a." * 50_000 + "net/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in filter_urls(pages, sites=sites, patterns=patterns).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}
