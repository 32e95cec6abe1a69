"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host suffix, path prefix, verdict): the longest that fits decides.
SITE_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Patterns over the lower-cased URL that block what no site rule decides.
PATTERNS = (
    r"://([^/]*[.-])?adult[.-]",
    r"://([^/]*[.-])?(cheap|discount)-pills[.-]",
    r"://([^/]*[.-])?casino[.-]",
    r"/(login|signin|logout)([/?#.]|$)",
    r"[?&](sessionid|phpsessid|sid)=",
    r"\.(exe|zip|apk|dmg|iso)([?#]|$)",
    r"://[^/]*@",
)
_TOKEN = re.compile("[a-z0-9]+")
#: What stands for an anchor in the strings a pattern can match: no part of a token.
_EDGE = "\0"
_HOST = re.compile("://([^/?#]*)([^?#]*)")


def _split(url: str | None) -> tuple[str, str]:
    m = _HOST.search(url or "")
    if m is None:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def _strings(items, most: int = 1_000) -> set[str] | None:
    """All strings that a piece of a parsed pattern matches, None if they are not few and known."""
    out = {""}
    for kind, value in items:
        kind = str(kind)
        if kind == "LITERAL":
            own = {chr(value)}
        elif kind == "AT" and "BOUNDARY" not in str(value):
            own = {_EDGE}
        elif kind == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            own = {chr(v) for _, v in value}
        elif kind == "SUBPATTERN":
            own = _strings(value[-1], most) if not value[1] and not value[2] else None
        elif kind == "BRANCH":
            parts = [_strings(x, most) for x in value[1]]
            own = None if None in parts else set().union(*parts)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT") and str(value[1]) != "MAXREPEAT" and value[1] <= 3:
            one = _strings(value[2], most)
            own = None if one is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(one, repeat=n)} if len(one) ** value[1] <= most else None
        else:
            own = None
        if own is None or len(out) * len(own) > most:
            return None
        out = {a + b for a, b in product(out, own)}
    return out


def _clean_edge(items, last: bool) -> tuple[bool, bool]:
    """Whether a piece can match nothing, and whether all else it matches ends (or begins) outside tokens."""
    nothing, clean = True, True
    for kind, value in reversed(items) if last else items:
        known = _strings([(kind, value)])
        if known is not None:
            empty, own = "" in known, not any(_TOKEN.match(x[-1 if last else 0]) for x in known if x)
        elif str(kind) == "SUBPATTERN":
            empty, own = _clean_edge(list(value[-1]), last)
        elif str(kind) in ("MAX_REPEAT", "MIN_REPEAT"):
            empty, own = _clean_edge(list(value[2]), last)
            empty = empty or value[0] == 0
        else:
            empty, own = True, False
        clean = clean and own
        if not empty:
            nothing = False
            break
    return nothing, clean


def literal_tokens(pattern: str) -> tuple[frozenset[str], ...]:
    """Sets of whole tokens of each of which every match of ``pattern`` in a URL holds a member, from the parsed pattern.

    A stretch of the pattern that matches few strings gives the tokens at each place of these strings; a token at its
    edge counts only where what stands beside it cannot be part of a token. None means that the rule must run on every URL.
    """
    parsed = re._parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return ()
    items = list(parsed)
    known = [_strings([x]) is not None for x in items]
    found, at = [], 0
    while at < len(items):
        end = at
        while end < len(items) and known[end]:
            end += 1
        strings = _strings(items[at:end]) if end > at else None
        if strings:
            nothing, left = _clean_edge(items[:at], True)
            left = left and not nothing
            nothing, right = _clean_edge(items[end:], False)
            right = right and not nothing
            whole = []
            for x in strings:
                spans = [m for m in _TOKEN.finditer(x) if (left or m.start() > 0) and (right or m.end() < len(x))]
                whole.append([m[0] for m in spans])
            if len({len(t) for t in whole}) == 1:
                found += [frozenset(t[k] for t in whole) for k in range(len(whole[0]))]
        at = max(end, at + 1)
    return tuple(dict.fromkeys(found))


#: Each pattern with its token sets.
PATTERN_RULES = tuple((p, literal_tokens(p)) for p in PATTERNS)


def load_rules(rules: DataFrame, most: int = 1_000_000) -> tuple[tuple, tuple]:
    """Site and pattern rules from a table ``host, path, verdict, pattern``: a row holds a site rule or a pattern.

    The rules go to the driver and into every task, so more than ``most`` are an error. Repeated rules count once; a null path is ``/``.
    """
    rows = rules.select("host", "path", "verdict", "pattern").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    sites = sorted((r.host, r.path or "/", r.verdict) for r in rows if r.host is not None)
    return tuple(sites), tuple((p, literal_tokens(p)) for p in sorted({r.pattern for r in rows if r.pattern is not None}))


def index_rules(urls: DataFrame, patterns=PATTERN_RULES, url_col: str = "url") -> tuple[dict[str, list[int]], list[int]]:
    """Choose for every pattern the set of literal tokens that is rarest over all URLs.

    Counts are one map-side combined aggregate over the tokens that some rule holds, so what reaches the driver is
    bounded by the rules. Returns (token -> pattern numbers, patterns that run everywhere).
    """
    sets = [options for _, options in patterns]
    wanted = sorted({t for options in sets for s in options for t in s})
    counts: dict[str, int] = {}
    if wanted:
        tokens = F.array_intersect(F.regexp_extract_all(F.lower(F.col(url_col).cast("string")), F.lit("[a-z0-9]+"), F.lit(0)), F.array(*map(F.lit, wanted)))
        counts = {r["t"]: r["n"] for r in urls.select(F.explode(tokens).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    index, everywhere = defaultdict(list), []
    for i, options in enumerate(sets):
        if not options:
            everywhere.append(i)
            continue
        for token in min(options, key=lambda s: (sum(counts.get(t, 0) for t in s), sorted(s))):
            index[token].append(i)
    return dict(index), everywhere


def _judge(sites, patterns, index, everywhere):
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("pattern", pa.string())])
    by_host = defaultdict(list)
    for host, path, verdict in sites:
        by_host[host].append((path, host + path, verdict))
    sizes = sorted({len(host) for host in by_host})

    def run(batches):
        compiled = [re.compile(p) for p, _ in patterns]
        for batch in batches:
            out = [[] for _ in range(5)]
            for url in batch.column("url").to_pylist():
                host, path = _split(url)
                ends = [host[-n:] for n in sizes if n == len(host) or n < len(host) and host[-n - 1] == "."] if host else []
                fits = [r for end in ends for r in by_host.get(end, ()) if path.startswith(r[0])]
                rule, verdict, hit = None, "allow", None
                if fits:
                    _, rule, verdict = max(fits, key=lambda r: (len(r[1]), r[1]))
                elif url:
                    low = url.lower()
                    tokens = set(_TOKEN.findall(low))
                    candidates = sorted({i for t in tokens & index.keys() for i in index[t]} | set(everywhere))
                    hit = next((patterns[i][0] for i in candidates if compiled[i].search(low)), None)
                    verdict = "block" if hit else "allow"
                for column, value in zip(out, (host, path, rule, verdict, hit)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), *[pa.array(c, pa.string()) for c in out]], schema=schema)

    return run


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", sites=SITE_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """Judge every URL: the longest site rule that fits, else block if a pattern rule matches, else allow.

    Each pattern is filed under its rarest literal token (:func:`index_rules`, :func:`literal_tokens`); a URL's tokens
    fetch candidates and only those regular expressions run. Site rules are looked up by the host's
    suffixes of the rules' lengths. :func:`load_rules` takes both from a table. The rules are the only shared data; the pages stream through one map stage with no shuffle.

    Nulls and edge cases: a null URL or one without ``://`` has empty host and path, fits no site rule and is allowed unless a
    pattern matches it; null ids stay null; repeated rows are judged one by one; an empty table gives an empty
    result; only the two named columns are read.

    Returns ``page_id, host, path, rule, verdict, pattern`` (the pattern that blocked, else null).
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    index, everywhere = index_rules(rows, patterns, "url")
    return rows.mapInArrow(_judge(sites, patterns, index, everywhere), "page_id long, host string, path string, rule string, verdict string, pattern string")
