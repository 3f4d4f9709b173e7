"""Text column functions (match keys, keyword tests, truncation, URLs, flags).

All functions build native Column expressions, so they stay inside
whole-stage codegen; none of them calls Python per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Whitespace as stripped by the match key: ASCII blanks, tabs, newlines.
_EDGE_WS = " \t\n\x0b\f\r"
# Up to so many terms are tested one after the other.
_FEW_TERMS = 64


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: ColumnOrName, body) -> Column:
    """Evaluate ``c`` once and apply ``body`` to it.

    A function that uses its argument several times would otherwise copy the
    argument's whole expression into each use; when Catalyst then inlines a
    projection into a pushed-down filter, nested helpers multiply into huge
    expression trees. Binding through a one-element array keeps every
    expression linear in the size of its inputs.
    """
    return F.element_at(F.transform(F.array(_col(c)), body), 1)


def strip_ws(c: ColumnOrName) -> Column:
    """Trim all leading/trailing whitespace (Spark ``trim`` removes blanks only)."""
    return F.btrim(_col(c), F.lit(_EDGE_WS))


def norm_key(c: ColumnOrName) -> Column:
    """F14 match key: whitespace-trimmed and lower-cased; NULL stays NULL."""
    return F.lower(strip_ws(c))


def blank_to_null(c: ColumnOrName) -> Column:
    """'' and all-blank strings become NULL (missing key == None == '')."""
    s = strip_ws(c)
    return F.when(F.length(s) > 0, s)


def null_to_blank(c: ColumnOrName) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def first_nonblank(*cols: ColumnOrName) -> Column:
    """P12 alias fallback: first argument that is neither NULL nor blank."""
    return F.coalesce(*[F.nullif(strip_ws(c), F.lit("")) for c in cols])


def default_fill(c: ColumnOrName, default: ColumnOrName) -> Column:
    """Trimmed value, or ``default`` when empty."""
    d = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(strip_ws(c), F.lit("")), d)


def keyword_regex(terms: Iterable[str], whole_word: bool = False) -> str:
    """One alternation over literal terms (each quoted, so no escaping issues)."""
    parts = [re.escape(t) for t in terms if t]
    if not parts:
        return r"(?!x)x"  # matches nothing
    body = "(?:" + "|".join(parts) + ")"
    return r"\b" + body + r"\b" if whole_word else body


def any_in(lowered: Column, terms: Iterable[str]) -> Column:
    """Substring test of an already lower-cased column against literal terms:
    it stops at the first hit and each ``contains`` is a byte search, which
    beats a regex alternation when most texts match nothing (the alternation
    then scans every position). Many terms go into one array."""
    terms = [t.lower() for t in terms if t]
    if not terms:
        return F.lit(False)
    if len(terms) <= _FEW_TERMS:
        return reduce(or_, [F.contains(lowered, F.lit(t)) for t in terms])
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda k: F.contains(lowered, k))


def contains_any(c: ColumnOrName, terms: Iterable[str], whole_word: bool = False) -> Column:
    """Lower-cased text holds any term (substring test by default; word
    boundaries with ``whole_word``). NULL text counts as no match."""
    if whole_word:
        rx = keyword_regex([t.lower() for t in terms], True)
        return F.coalesce(F.lower(_col(c)).rlike(rx), F.lit(False))
    return F.coalesce(let(F.lower(_col(c)), lambda s: any_in(s, terms)), F.lit(False))


def keep_skip(c: ColumnOrName, keep: Iterable[str], skip: Iterable[str],
              whole_word: bool = False) -> Column:
    """Skip-list has precedence over keep-list."""
    if whole_word:
        return let(c, lambda t: ~contains_any(t, skip, True) & contains_any(t, keep, True))
    return F.coalesce(let(F.lower(_col(c)), lambda s: ~any_in(s, skip) & any_in(s, keep)), F.lit(False))


def truncate(c: ColumnOrName, n: int) -> Column:
    """First ``n`` characters (code points)."""
    return F.substring(_col(c), 1, n)


def absolute_url(href: ColumnOrName, base: Column | str) -> Column:
    """Keep absolute links, prefix relative ones with ``base``
    (a Column, or a literal string)."""
    h = _col(href)
    b = F.lit(base) if isinstance(base, str) else base
    return F.when(h.startswith("http"), h).otherwise(F.concat(b, h))


def cut_query(url: ColumnOrName) -> Column:
    """Drop everything from the first '?'."""
    return F.substring_index(_col(url), "?", 1)


def lenient_flag(c: ColumnOrName, default: bool = True) -> Column:
    """yes/true/1/on/y (any case, trimmed) -> True; blank -> default."""
    return let(F.lower(strip_ws(c)), lambda v: F.when(v.isNull() | (v == ""), F.lit(default))
               .otherwise(v.isin("yes", "true", "1", "on", "y")))


def city_key(c: ColumnOrName) -> Column:
    """lower-case, blanks removed."""
    return F.replace(F.lower(_col(c)), F.lit(" "), F.lit(""))


def strip_code_fence(c: ColumnOrName) -> Column:
    """F23 (classifier variant): text starting with a fence -> the part after it,
    a leading 'json' tag dropped, trimmed."""
    def body(s):
        inner = F.regexp_replace(F.element_at(F.split(s, "```"), 2), "^json", "")
        return F.when(s.startswith("```"), strip_ws(inner)).otherwise(s)

    return let(strip_ws(c), body)


def date_range_label(start: ColumnOrName, end: ColumnOrName, default: str = "unknown") -> Column:
    """"start – end" with stray blanks/dashes cut from both ends."""
    s = F.concat(null_to_blank(start), F.lit(" – "), null_to_blank(end))
    return let(F.regexp_replace(s, "^[ –]+|[ –]+$", ""),
               lambda v: F.when(v == "", F.lit(default)).otherwise(v))


def html_unescape_basic(c: ColumnOrName) -> Column:
    """Decode the five XML entities (``&amp;`` last so it is not decoded twice)."""
    s = _col(c)
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(ent), F.lit(ch))
    return s


def strip_tags(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), "<[^>]*>", "")
