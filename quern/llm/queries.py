"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from itertools import permutations

from quern.llm.audit import FILTERS, filter_audit
from quern.llm.clusters import ball_tree_clusters
from quern.llm.common import table
from quern.llm.debruijn import remove_repeated_windows
from quern.llm.langid import identify_languages
from quern.llm.mixing import mixing_plan
from quern.llm.near_dedup import near_duplicates
from quern.llm.packing import best_fit_packing
from quern.llm.quality import quality_rules
from quern.llm.repeats import remove_repeats
from quern.llm.secrets import BASE, RULES, report, secret_ledger
from quern.llm.sharding import uniform_shards
from quern.llm.topk import exact_top_k
from quern.llm.urls import PATTERN_RULES, SITE_RULES, filter_urls


def op1_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_compression_langid(spark, sf_dir):
    return identify_languages(table(spark, sf_dir, "documents"))


def op3_mtree_top_k(spark, sf_dir):
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op4_repeated_bytes(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op5_robust_quality(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_hypergeometric_shards(spark, sf_dir):
    return uniform_shards(table(spark, sf_dir, "documents"))


def op7_residual_packing(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op8_temperature_mix(spark, sf_dir):
    return mixing_plan(table(spark, sf_dir, "documents"))


def op9_rarest_token_urls(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


def op10_secret_ledger(spark, sf_dir):
    return report(secret_ledger(table(spark, sf_dir, "documents"))[0])


def op11_de_bruijn_windows(spark, sf_dir):
    return remove_repeated_windows(table(spark, sf_dir, "documents"), digest=True)


def op12_ball_tree_clusters(spark, sf_dir):
    return ball_tree_clusters(table(spark, sf_dir, "embeddings"))


def op13_filter_interactions(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_compression_langid": op2_compression_langid,
    "op3_mtree_top_k": op3_mtree_top_k,
    "op4_repeated_bytes": op4_repeated_bytes,
    "op5_robust_quality": op5_robust_quality,
    "op6_hypergeometric_shards": op6_hypergeometric_shards,
    "op7_residual_packing": op7_residual_packing,
    "op8_temperature_mix": op8_temperature_mix,
    "op9_rarest_token_urls": op9_rarest_token_urls,
    "op10_secret_ledger": op10_secret_ledger,
    "op11_de_bruijn_windows": op11_de_bruijn_windows,
    "op12_ball_tree_clusters": op12_ball_tree_clusters,
    "op13_filter_interactions": op13_filter_interactions,
}



def _url_sql() -> str:
    sites = sorted(SITE_RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in sites]
    hits = [f"regexp_matches(lower(url), '{p}')" for p, _ in PATTERN_RULES]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, sites))
    site = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, sites))
    hit = " ".join(f"WHEN {h} THEN '{p}'" for h, (p, _) in zip(hits, PATTERN_RULES))
    return f"""
        WITH split AS (
            SELECT page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_UPPER.lower()}') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), ruled AS (SELECT *, CASE {rule} END AS rule, CASE {site} END AS site, CASE {hit} END AS hit FROM split)
        SELECT page_id, host, path, rule, coalesce(site, CASE WHEN hit IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
               CASE WHEN rule IS NULL THEN hit END AS pattern
        FROM ruled
    """


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_NEAR_SQL = f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_TOP_SQL = """
    WITH v AS (
        SELECT vec_id, [floor(1024 * x::double) FOR x IN embedding] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS bigint) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_REPEATS_SQL = """
    WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
    g AS (SELECT doc_id, i, h[i:i + 49] AS g FROM (SELECT doc_id, h, unnest(range(1, octet_length(h) - 48)) AS i FROM t WHERE octet_length(h) >= 50)),
    m AS (SELECT g, min(doc_id) AS lo FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
    marks AS (SELECT g.doc_id, i FROM g JOIN m ON g.g = m.g WHERE m.lo < g.doc_id),
    runs AS (
        SELECT doc_id, run, min(i) AS a, max(i) + 49 AS b
        FROM (SELECT doc_id, i, sum(CASE WHEN i - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
              FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM marks))
        GROUP BY doc_id, run
    ), gaps AS (
        SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS f, a - 1 AS u FROM runs
        UNION ALL SELECT doc_id, 1000000000000, max(b) + 1, 1000000000000 FROM runs GROUP BY doc_id
    ), kept AS (
        SELECT t.doc_id, unhex(string_agg(CASE WHEN f <= least(u, octet_length(h)) THEN hex(h[f:least(u, octet_length(h))]) ELSE '' END, '' ORDER BY a)) AS h
        FROM t JOIN gaps ON t.doc_id = gaps.doc_id GROUP BY t.doc_id
    ), sums AS (SELECT doc_id, CAST(sum(b - a + 1) AS bigint) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
    SELECT t.doc_id, octet_length(t.h) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept.h, t.h)) AS kept_sha256
    FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id LEFT JOIN sums ON sums.doc_id = t.doc_id
"""


def _secrets_sql() -> str:
    parts = []
    for k, (name, pattern, least, by_group) in enumerate(RULES):
        p = pattern.replace("'", "''")
        size = f"len(regexp_extract(m, '{p}', 2))" if by_group else "len(m)"
        parts.append(f"""
            SELECT doc_id, {k} AS k, '{name}' AS kind, pos AS a, pos + len(m) AS b FROM (
                SELECT doc_id, f[i] AS m, CAST(list_sum([len(x) FOR x IN s[1:i]]) + coalesce(list_sum([len(x) FOR x IN f[1:i - 1]]), 0) AS bigint) AS pos
                FROM (SELECT doc_id, f, s, unnest(range(1, len(f) + 1)) AS i
                      FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS f, regexp_split_to_array(text, '{p}') AS s FROM documents WHERE regexp_matches(text, '{p}')))
            ) WHERE {size} >= {least}""")
    base = ", ".join(f"count(*) FILTER (WHERE kind = '{n}') AS n_{n}" for n in BASE)
    names = ", ".join(f"'{n}'" for n in BASE)
    shown = "kind || ':' || a || ':' || b, ',' ORDER BY a, k"
    zeros = ", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in BASE)
    return f"""
        WITH spans AS ({" UNION ALL ".join(parts)}),
        found AS (SELECT doc_id, {base}, string_agg({shown}) FILTER (WHERE kind IN ({names})) AS own, string_agg({shown}) AS spans FROM spans GROUP BY doc_id)
        SELECT d.doc_id, {zeros}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id
    """


_WINDOWS_SQL = """
    WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
    g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
    marks AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM marks),
    kept AS (
        SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS text, count(*) AS n
        FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) p ANTI JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i
        GROUP BY p.doc_id
    )
    SELECT w.doc_id, CAST(len(ws) AS bigint) AS n_words, CAST(len(ws) - coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


def _clusters_sql(dims: int = 64, clusters: int = 8, rounds: int = 10) -> str:
    distance = "list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e)"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT v.vec_id, v.e, min({{'d': CAST({distance} AS bigint), 'k': k}}) AS m FROM v CROSS JOIN c{k} c GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
                SELECT c.k, coalesce(n.e, c.e) AS e FROM c{k} c LEFT JOIN (
                    SELECT k, list(q ORDER BY i) AS e FROM (
                        SELECT k, i, (CAST(sum(x) AS hugeint) - ((CAST(sum(x) AS hugeint) % count(*)) + count(*)) % count(*)) / count(*) AS q
                        FROM (SELECT m.k AS k, unnest(e) AS x, unnest(range(1, {dims + 1})) AS i FROM a{k}) GROUP BY k, i
                    ) GROUP BY k
                ) n ON n.k = c.k)""")
    return f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, [floor(1024 * x::double) FOR x IN embedding] AS e FROM embeddings
            WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, e) - 1 AS k, e FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT {clusters})
        ), {", ".join(steps)}
        SELECT vec_id, CAST(m.k AS int) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS bigint) AS cluster_inertia, CAST(sum(m.d) OVER () AS bigint) AS inertia,
               sha256(array_to_string([CAST(x AS bigint) FOR x IN c.e], ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.k = a.m.k
    """


def _audit_sql() -> str:
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(f"('{''.join(FILTERS[x] for x in order)}', {step}, {1 << f}, {before})")
            before |= 1 << f
    return f"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM t),
        o AS (SELECT text, min(doc_id) AS lo FROM t GROUP BY text),
        l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        f AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text) THEN 4 ELSE 0 END
                   + CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > lo THEN 16 ELSE 0 END AS mask
            FROM w JOIN o ON o.text = w.text LEFT JOIN l ON l.doc_id = w.doc_id
        ), m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, mask),
        s(filter_order, step, bit, before) AS (VALUES {", ".join(steps)})
        SELECT part, filter_order, step,
               CAST(sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS bigint) AS kept,
               CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS bigint) AS removed,
               CAST(sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS bigint) AS redundant,
               CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS bigint) AS unique_fails,
               CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS bigint) AS good_lost,
               CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS bigint) AS toxic_lost,
               CAST(sum(CASE WHEN mask & bit > 0 THEN n * 120 // bit_count(mask) ELSE 0 END) AS bigint) AS shapley
        FROM m CROSS JOIN s GROUP BY part, filter_order, step
    """


ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": _NEAR_SQL,
    "op3_mtree_top_k": _TOP_SQL,
    "op4_repeated_bytes": _REPEATS_SQL,
    "op9_rarest_token_urls": _url_sql(),
    "op10_secret_ledger": _secrets_sql(),
    "op11_de_bruijn_windows": _WINDOWS_SQL,
    "op12_ball_tree_clusters": _clusters_sql(),
    "op13_filter_interactions": _audit_sql(),
}
