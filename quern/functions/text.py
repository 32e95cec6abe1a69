"""Text, path and file-name expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Alternatives of the pre-tokeniser, in order (special tokens, contractions, letters, one digit, other).
PRETOKEN = r"(?i)<start_of_text>|<end_of_text>|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Characters that file names may not hold.
UNSAFE = '<>:"/\\|?*'


def strip_ws(c: Column) -> Column:
    """Strip every Unicode white space, not blanks alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Null is the empty string."""
    return F.coalesce(c, F.lit(""))


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def pretokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(collapse_ws(c)), F.lit(PRETOKEN), F.lit(0))


@F.pandas_udf(StringType())
def unescape_twice(s: pd.Series) -> pd.Series:
    """HTML entities resolved twice, as captions are often escaped twice."""
    return s.map(lambda x: None if x is None else html.unescape(html.unescape(x)).strip())


def pad_ids(ids: Column, length: int = 77, end_id: int = 49407) -> Column:
    """Token ids cut to ``length`` with ``end_id`` last, or padded with zeros."""
    cut = F.when(F.size(ids) > length, F.concat(F.slice(ids, 1, length - 1), F.array(F.lit(end_id)))).otherwise(ids)
    return F.concat(cut, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(cut), F.lit(0))))


def safe_name(c: Column, default: str = "unnamed") -> Column:
    """File-name safe text: reserved characters become ``_``, outer white space and trailing dots go."""
    named = F.regexp_replace(strip_ws(F.translate(c, UNSAFE, "_" * len(UNSAFE))), r"\.+$", "")
    return F.when(F.coalesce(named, F.lit("")) == "", F.lit(default)).otherwise(named)


def forward_slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def path_tail(c: Column, marker: str) -> Column:
    """What follows the last ``marker``."""
    return F.substring_index(forward_slashes(c), marker, -1)


def path_part(c: Column, from_end: int) -> Column:
    """Part ``from_end`` of a path, 1 being the file name; null if there are fewer."""
    parts = F.split(forward_slashes(c), "/")
    return F.when(F.size(parts) >= from_end, F.element_at(parts, -from_end))


def stem(c: Column) -> Column:
    return F.regexp_replace(path_part(c, 1), r"\.[^.]*$", "")


def image_id(c: Column) -> Column:
    """The last ``_`` part of a file stem if it is 16 hex digits, else the stem, in lower case."""
    s = F.lower(stem(c))
    last = F.substring_index(s, "_", -1)
    return F.when(last.rlike("^[0-9a-f]{16}$"), last).otherwise(s)


def is_safe_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z0-9_-]+$"), F.lit(False))


def is_safe_path(c: Column) -> Column:
    """Relative, without drive and without ``..`` parts."""
    p = forward_slashes(c)
    return F.coalesce((p != "") & ~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & ~p.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def scheme_allowed(c: Column, schemes=("http", "https")) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(*schemes), F.lit(False))


def url_quote(c: Column) -> Column:
    """Percent-encoding of all but letters, digits, ``_.-~`` and slashes."""
    coded = F.url_encode(c)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        coded = F.replace(coded, F.lit(old), F.lit(new))
    return coded


def utc_text(c: Column | None = None) -> Column:
    """A time, or now, as ISO text in UTC, in a session whose time zone is UTC."""
    return F.date_format(F.current_timestamp() if c is None else c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def join_errors(*parts: Column, limit: int = 4000) -> Column:
    """Error texts joined by `` | ``, capped."""
    return F.substring(F.concat_ws(" | ", *[F.nullif(p, F.lit("")) for p in parts]), 1, limit)


def damage_kind(c: Column) -> Column:
    """Classify a decoder's message."""
    low = F.lower(clean(c))
    return F.when(low == "", "ok").when(low.rlike("truncat|premature|unexpected end|end of file"), "truncated").otherwise("unreadable")


def natural_key(c: Column) -> Column:
    """Sort key that compares digit runs as numbers: an array of (text, number)."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(runs, lambda r: F.struct(F.when(r.rlike("^[0-9]"), F.lit("")).otherwise(r).alias("t"), F.coalesce(r.try_cast("decimal(38,0)"), F.lit(-1)).alias("n")))
