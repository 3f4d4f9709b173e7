"""DuckDB SQL twins of the catalogue queries (same names, same columns).

Written independently from the Spark code, directly from the operator
definitions, over the pre-registered driver tables.
"""

from __future__ import annotations

import re

from ..vocab import CATEGORIES
from .tables import (AS_OF_DOCS, AS_OF_EVENTS, AS_OF_ORDERS, CATEGORY_RULES, DOC_CFP_CLOSED, DOC_CFP_CLOSED_WHEN_OPEN,
                     DOC_CFP_OPEN, DOC_KEEP, DOC_SKIP, MEETUP_RULES, ROUTE_RULES)

SQL: dict[str, str] = {}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(expr: str, terms) -> str:
    """Substring test of lower(expr) against literal terms."""
    return "(" + " OR ".join(f"contains(lower({expr}), {_lit(t.lower())})" for t in terms) + ")"


def _trim(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def _parse5(e: str) -> str:
    n = f"regexp_replace({_trim(e)}, '\\s+', ' ', 'g')"
    fmts = [(r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "%b %d, %Y"), (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "%B %d, %Y"),
            (r"^\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d"), (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "%b %d %Y"),
            (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "%d %b %Y")]
    parts = [f"CASE WHEN regexp_matches({n}, '{g}') THEN CAST(try_strptime({n}, '{f}') AS DATE) END"
             for g, f in fmts]
    return "coalesce(" + ", ".join(parts) + ")"


def _parse3(e: str) -> str:
    n = f"regexp_replace({_trim(e)}, '\\s+', ' ', 'g')"
    fmts = [(r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "%b %d, %Y"), (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "%B %d, %Y"),
            (r"^\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d")]
    parts = [f"CASE WHEN regexp_matches({n}, '{g}') THEN CAST(try_strptime({n}, '{f}') AS DATE) END"
             for g, f in fmts]
    return "coalesce(" + ", ".join(parts) + ")"


def _days(s: str, e: str) -> str:
    return (f"CASE WHEN {_parse3(s)} IS NOT NULL AND {_parse3(e)} IS NOT NULL "
            f"THEN CAST(greatest(date_diff('day', {_parse3(s)}, {_parse3(e)}) + 1, 1) AS BIGINT) END")


def _fmt(d: str) -> str:
    return f"strftime({d}, '%b %d, %Y')"


def _render5(d: str, k: str) -> str:
    return (f"CASE {k} % 5 WHEN 0 THEN strftime({d}, '%b %d, %Y') WHEN 1 THEN strftime({d}, '%B %-d, %Y') "
            f"WHEN 2 THEN strftime({d}, '%Y-%m-%d') WHEN 3 THEN strftime({d}, '%b %-d %Y') "
            f"ELSE strftime({d}, '%-d %b %Y') END")


def _unescape(e: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        e = f"replace({e}, {_lit(a)}, {_lit(b)})"
    return e


def _cfp_state(e: str, open_, closed_open, closed) -> str:
    return (f"CASE WHEN {_any(e, open_)} AND {_any(e, closed_open)} THEN 'Closed' "
            f"WHEN {_any(e, open_)} THEN 'Open' WHEN {_any(e, closed)} THEN 'Closed' ELSE 'Check site' END")


def _base(url: str) -> str:
    return f"regexp_extract({url}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1)"


def _host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"


_ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*\"([^\"]*)\"[^>]*>(.*?)</a>".replace('\\"', '"')
_A = _lit(_ANCHOR)

AS_O = f"DATE '{AS_OF_ORDERS}'"

SQL["parse_dates"] = f"""
WITH b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
r AS (SELECT o_orderkey, d, {_render5('d', 'o_orderkey')} AS raw0 FROM b),
j AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN upper(raw0) WHEN 2 THEN '  ' || raw0 || ' '
        WHEN 3 THEN replace(raw0, ' ', '  ') WHEN 4 THEN 'TBC'
        WHEN 5 THEN strftime(d, '%b %-d, ') || strftime(d, '%y') ELSE raw0 END AS raw_date FROM r)
SELECT o_orderkey, raw_date, CAST({_parse5('raw_date')} AS VARCHAR) AS parsed FROM j
"""

SQL["days_span"] = f"""
WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS s FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber,
        CASE l_linenumber % 3 WHEN 0 THEN strftime(s, '%b %d, %Y') WHEN 1 THEN strftime(s, '%B %-d, %Y')
             ELSE strftime(s, '%Y-%m-%d') END AS start_date,
        CASE l_orderkey % 4 WHEN 0 THEN strftime(s + (l_linenumber - 3) * INTERVAL 1 DAY, '%b %d, %Y')
             WHEN 1 THEN strftime(s + (l_linenumber - 3) * INTERVAL 1 DAY, '%Y-%m-%d')
             WHEN 2 THEN strftime(s + (l_linenumber - 3) * INTERVAL 1 DAY, '%b %-d %Y') ELSE '' END AS end_date
      FROM b)
SELECT l_orderkey, l_linenumber, start_date, end_date, {_days('start_date', 'end_date')} AS days FROM r
"""

_RX_DATE = r"([A-Za-z]+ \d+(?:-[A-Za-z]* ?\d+)?)"
SQL["date_range_split"] = f"""
WITH x AS (
  SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS d, c.c_name, n.n_name
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
p AS (
  SELECT o_orderkey,
    concat_ws(' ', CASE o_orderkey % 5
        WHEN 0 THEN strftime(d, '%b %-d') || '-' || strftime(d + INTERVAL 3 DAY, '%b %-d')
        WHEN 1 THEN strftime(d, '%b %-d') || '-' || CAST(day(d) + 2 AS VARCHAR)
        WHEN 2 THEN strftime(d, '%b %-d')
        WHEN 3 THEN strftime(d, '%b %-d') || ' - ' || CAST(day(d) + 1 AS VARCHAR) END, c_name, n_name) AS parent_text,
    CASE WHEN o_orderkey % 11 = 0 THEN c_name || ' Summit' ELSE c_name END AS name
  FROM x),
q AS (
  SELECT *, contains(parent_text, name) AS has,
    {_trim("split_part(parent_text, name, -1)")} AS after_,
    {_trim("split_part(parent_text, name, 1)")} AS before_ FROM p),
r AS (
  SELECT *, CASE WHEN has THEN {_trim("split_part(after_, chr(10), 1)")} ELSE '' END AS location,
    CASE WHEN has THEN regexp_extract(before_, '{_RX_DATE}', 1) ELSE '' END AS date_raw FROM q),
s AS (SELECT *, {_trim('date_raw')} AS dd FROM r)
SELECT o_orderkey, parent_text, name, date_raw,
  CASE WHEN date_raw = '' THEN ''
       WHEN regexp_extract(dd, '^([A-Za-z]+ \\d+)-([A-Za-z]+ \\d+)', 1) <> '' THEN regexp_extract(dd, '^([A-Za-z]+ \\d+)-([A-Za-z]+ \\d+)', 1)
       WHEN regexp_extract(dd, '^([A-Za-z]+) (\\d+)-(\\d+)', 1) <> '' THEN regexp_extract(dd, '^([A-Za-z]+) (\\d+)-(\\d+)', 1) || ' ' || regexp_extract(dd, '^([A-Za-z]+) (\\d+)-(\\d+)', 2)
       WHEN regexp_extract(dd, '^([A-Za-z]+ \\d+)', 1) <> '' THEN regexp_extract(dd, '^([A-Za-z]+ \\d+)', 1)
       ELSE dd END AS start_part,
  CASE WHEN date_raw = '' THEN ''
       WHEN regexp_extract(dd, '^([A-Za-z]+ \\d+)-([A-Za-z]+ \\d+)', 1) <> '' THEN regexp_extract(dd, '^([A-Za-z]+ \\d+)-([A-Za-z]+ \\d+)', 2)
       WHEN regexp_extract(dd, '^([A-Za-z]+) (\\d+)-(\\d+)', 1) <> '' THEN regexp_extract(dd, '^([A-Za-z]+) (\\d+)-(\\d+)', 1) || ' ' || regexp_extract(dd, '^([A-Za-z]+) (\\d+)-(\\d+)', 3)
       WHEN regexp_extract(dd, '^([A-Za-z]+ \\d+)', 1) <> '' THEN regexp_extract(dd, '^([A-Za-z]+ \\d+)', 1)
       ELSE dd END AS end_part,
  location
FROM s
"""

SQL["year_inference"] = f"""
WITH b AS (SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%b %-d') AS month_day FROM orders),
c AS (SELECT *, CAST(try_strptime(month_day || ', ' || CAST(year({AS_O}) AS VARCHAR), '%b %d, %Y') AS DATE) AS y1,
             CAST(try_strptime(month_day || ', ' || CAST(year({AS_O}) + 1 AS VARCHAR), '%b %d, %Y') AS DATE) AS y2 FROM b)
SELECT o_orderkey, month_day,
  CAST(CASE WHEN y1 >= {AS_O} THEN y1 WHEN y2 < {AS_O} + INTERVAL 12 MONTH THEN y2 END AS VARCHAR) AS inferred
FROM c
"""

SQL["past_future"] = f"""
WITH e AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 7 = 0 THEN 'TBC' ELSE strftime(CAST(o_orderdate AS DATE), '%b %d, %Y') END AS start_date,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'conference' ELSE 'meetup' END AS event_type
  FROM orders),
f AS (SELECT *, {_parse5('start_date')} AS d FROM e)
SELECT o_orderkey, start_date, coalesce(d < {AS_O}, false) AS is_past, coalesce(d >= {AS_O}, true) AS is_future,
  CASE WHEN coalesce(d < {AS_O}, false) THEN 'Time Passed' ELSE 'Conferences' END AS sheet
FROM f WHERE event_type = 'conference'
"""

SQL["lookahead"] = f"""
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%b %d, %Y') AS raw_start_date FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN {AS_O} AND {AS_O} + INTERVAL 180 DAY
"""

SQL["calendar_gates"] = """
SELECT CAST(d AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS n_events, day(d) <= 7 AS first_run,
  weekofyear(d) % 2 = 1 AS odd_week, day(d) <= 7 AS run_next_edition, weekofyear(d) % 2 = 1 AS run_cfp_search
FROM (SELECT CAST(ts AS DATE) AS d FROM events) GROUP BY d
"""

SQL["keyword_filter"] = f"""
SELECT doc_id, source, lang FROM documents WHERE {_any('text', DOC_KEEP)}
"""

SQL["keep_skip_filter"] = f"""
SELECT doc_id, source FROM documents WHERE NOT {_any('text', DOC_SKIP)} AND {_any('text', DOC_KEEP)}
"""

SQL["cfp_state"] = f"""
WITH s AS (
  SELECT doc_id, {_cfp_state('text', DOC_CFP_OPEN, DOC_CFP_CLOSED_WHEN_OPEN, DOC_CFP_CLOSED)} AS page_state,
    strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER) * INTERVAL 1 DAY, '%b %d, %Y') AS deadline
  FROM documents)
SELECT doc_id, page_state, deadline,
  CASE WHEN page_state = 'Open' AND coalesce({_parse5('deadline')} < DATE '{AS_OF_DOCS}', false) THEN 'Closed'
       ELSE page_state END AS cfp_status
FROM s
"""

_LINKS = f"""
a AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, {_A}, 1)) AS href0,
         unnest(regexp_extract_all(html, {_A}, 2)) AS inner0,
         unnest(generate_series(1, len(regexp_extract_all(html, {_A}, 1)))) AS ord
  FROM pages),
b AS (
  SELECT page_id, url, CAST(ord AS INTEGER) AS ord, {_unescape('href0')} AS href,
         {_trim(_unescape("regexp_replace(inner0, '<[^>]*>', '', 'g')"))} AS text
  FROM a),
c AS (
  SELECT *, split_part(CASE WHEN starts_with(href, 'http') THEN href ELSE {_base('url')} || href END, '?', 1) AS link
  FROM b WHERE href IS NOT NULL AND href <> '' AND href NOT IN ('#', '/')),
d AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY ord) AS rn FROM c) WHERE rn = 1),
links AS (SELECT * FROM d WHERE length(text) >= 5)
"""

SQL["page_links"] = f"WITH {_LINKS} SELECT page_id, ord, link, text FROM links"

SQL["link_dedup"] = f"""
WITH {_LINKS}
SELECT link, page_id, ord, text FROM (
  SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, ord) AS rn2 FROM links) WHERE rn2 = 1
"""

SQL["page_title_dedup"] = f"""
WITH {_LINKS},
t AS (SELECT page_id, url,
        {_trim(_unescape("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))} AS title
      FROM pages),
s AS (SELECT page_id, arg_min(href, ord) AS slug FROM b WHERE regexp_matches(href, '^/[a-zA-Z0-9_-]{{4,}}$') GROUP BY page_id),
x AS (SELECT t.page_id, t.title, {_base('t.url')} || s.slug AS card_link FROM t JOIN s ON t.page_id = s.page_id
      WHERE t.title <> '')
SELECT page_id, title, card_link FROM (
  SELECT *, row_number() OVER (PARTITION BY title ORDER BY page_id) AS rn FROM x) WHERE rn = 1
"""

SQL["source_registry"] = f"""
WITH p AS (SELECT page_id, {_host('url')} AS host,
             {_cfp_state('html', DOC_CFP_OPEN + ['cfp is open'], DOC_CFP_CLOSED_WHEN_OPEN, DOC_CFP_CLOSED)} AS cfp_status
           FROM pages),
r AS (SELECT DISTINCT host FROM p)
SELECT p.page_id, p.host, split_part(r.host, '.', 1) AS label,
  CASE split_part(r.host, '.', -1) WHEN 'com' THEN 'San Francisco, USA' WHEN 'org' THEN 'Berlin, Germany'
       WHEN 'net' THEN 'London, UK' ELSE 'Various' END AS default_location, p.cfp_status
FROM p JOIN r ON p.host = r.host
"""

_PART_EVENTS = """
ev AS (SELECT p_partkey AS ord, p_name || ' ' || lower(p_type) AS name,
         'https://' || lower(replace(p_brand, '#', '-')) || '.example.com/' || CAST(p_size AS VARCHAR) AS website,
         p_size FROM part)
"""


def _key(e: str) -> str:
    return f"nullif(lower({_trim(e)}), '')"


SQL["exclude_anti"] = f"""
WITH {_PART_EVENTS},
ex AS (SELECT '  ' || upper(name) || chr(9) AS name, CASE WHEN ord % 3 = 0 THEN '' ELSE upper(website) END AS website
       FROM ev WHERE p_size < 5),
bn AS (SELECT DISTINCT {_key('name')} AS k FROM ex WHERE {_key('name')} IS NOT NULL),
bu AS (SELECT DISTINCT {_key('website')} AS k FROM ex WHERE {_key('website')} IS NOT NULL)
SELECT ord, name, website FROM ev
WHERE NOT EXISTS (SELECT 1 FROM bn WHERE bn.k = {_key('ev.name')})
  AND NOT EXISTS (SELECT 1 FROM bu WHERE bu.k = {_key('ev.website')})
"""

SQL["known_anti"] = f"""
WITH t AS (
  SELECT CASE WHEN p_size <= 3 THEN 'Conferences' WHEN p_size <= 6 THEN 'Time Passed'
              WHEN p_size <= 8 THEN 'Meet-ups' WHEN p_size <= 9 THEN 'SF Product Demos' END AS sheet,
         p_name || ' ' || p_brand AS name FROM part),
known AS (SELECT DISTINCT {_key('name')} AS k FROM t WHERE sheet IS NOT NULL AND {_key('name')} IS NOT NULL),
cand AS (SELECT p_partkey AS ord, p_name || ' ' || p_brand AS name FROM part),
kept AS (SELECT * FROM cand WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.k = {_key('cand.name')}))
SELECT ord, name FROM (
  SELECT *, row_number() OVER (PARTITION BY lower({_trim('name')}) ORDER BY ord) AS rn FROM kept) WHERE rn = 1
"""

SQL["known_sketch"] = SQL["known_anti"]

SQL["wide_first_wins"] = r"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY source, lang, lower(regexp_extract(text, '^\W*(\w*)', 1)) ORDER BY doc_id) AS rn
  FROM documents) WHERE rn = 1
"""

SQL["text_norm"] = f"""
WITH d AS (
  SELECT doc_id, text,
    CASE doc_id % 3 WHEN 0 THEN chr(9) || ' ' WHEN 1 THEN chr(10) ELSE '' END AS pad,
    CASE doc_id % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'off' WHEN 2 THEN '' WHEN 3 THEN 'ON'
                    WHEN 4 THEN 'maybe' ELSE '1' END AS flag0
  FROM documents)
SELECT doc_id, lower({_trim("pad || text || '  ' || pad")}) AS key,
  CASE WHEN {_trim('flag0')} = '' THEN true ELSE lower({_trim('flag0')}) IN ('yes', 'true', '1', 'on', 'y') END AS flag,
  substring(text, 1, 400) AS card_text
FROM d
"""

SQL["known_block"] = f"""
WITH n AS (SELECT DISTINCT name FROM (
    SELECT lower({_trim('p_name')}) AS name FROM part UNION ALL SELECT lower({_trim('c_name')}) FROM customer)
  WHERE name IS NOT NULL),
tot AS (SELECT count(*) AS total FROM n),
top AS (SELECT name, row_number() OVER (ORDER BY name) AS rn FROM n)
SELECT CAST(rn AS BIGINT) AS line_no, '  - ' || name AS line FROM top WHERE rn <= 60
UNION ALL SELECT CAST(61 AS BIGINT), '  ...and ' || CAST(total - 60 AS VARCHAR) || ' more' FROM tot WHERE total > 60
UNION ALL SELECT CAST(1 AS BIGINT), '  (none yet)' FROM tot WHERE total = 0
"""


def _greedy_sql(src: str, cols: str) -> str:
    """Sequential greedy two-key dedup as a recursive CTE over ``src``
    (ord, name, website): carry the set of kept keys row by row."""
    return f"""
  g0 AS (SELECT ord, name, website, coalesce(lower({_trim('name')}), '') AS nk,
           nullif(lower({_trim('website')}), '') AS uk,
           row_number() OVER (ORDER BY ord) AS step FROM {src}),
  walk AS (
    SELECT 0::BIGINT AS step, []::VARCHAR[] AS seen, NULL::BIGINT AS kept_ord
    UNION ALL
    SELECT g0.step,
      CASE WHEN list_contains(walk.seen, g0.nk) OR (g0.uk IS NOT NULL AND list_contains(walk.seen, g0.uk))
           THEN walk.seen
           ELSE list_concat(walk.seen, CASE WHEN g0.uk IS NULL THEN [g0.nk] ELSE [g0.nk, g0.uk] END) END,
      CASE WHEN list_contains(walk.seen, g0.nk) OR (g0.uk IS NOT NULL AND list_contains(walk.seen, g0.uk))
           THEN NULL ELSE g0.ord END
    FROM walk JOIN g0 ON g0.step = walk.step + 1),
  greedy AS (SELECT {cols} FROM g0 WHERE ord IN (SELECT kept_ord FROM walk WHERE kept_ord IS NOT NULL))
"""


SQL["greedy_dedup"] = f"""
WITH RECURSIVE src AS (
  SELECT p_partkey AS ord, p_name AS name,
    'https://' || lower(replace(p_brand, '#', '')) || '.example/' || lower(p_type) AS website FROM part),
{_greedy_sql('src', 'ord, name, website')}
SELECT ord, name, website FROM greedy
"""

SQL["host_links"] = f"""
WITH {_LINKS},
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, ord) AS rn2 FROM links)
      WHERE rn2 = 1 AND NOT {_any('text', ['nav', 'menu'])}),
k AS (SELECT DISTINCT {_key("split_part(url, '?', 1)")} AS k FROM pages)
SELECT {_host('link')} AS host, CAST(count(*) AS BIGINT) AS n_links FROM w
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.k = lower({_trim('link')}))
GROUP BY 1
"""


# ------------------------------------------------------------- upsert ----

def _dfmt_sql(n: str) -> str:
    return f"strftime(DATE '2026-01-01' + CAST({n} AS INTEGER) * INTERVAL 1 DAY, '%b %d, %Y')"


def _url_sql(off: int) -> str:
    return f"'https://' || lower(replace(p_brand, '#', '')) || '.example/' || CAST(p_size + {off} AS VARCHAR)"


_UPSERT_IN = f"""
ex AS (SELECT 'Conferences' AS sheet, p_partkey AS row_id, CAST(p_partkey / 2 + 2 AS BIGINT) AS row_no,
         p_name AS name, p_type AS category, '' AS cfp_date, CASE WHEN p_size % 4 = 0 THEN 'Open' ELSE '' END AS cfp_status,
         'Loc ' || CAST(p_size % 10 AS VARCHAR) AS location, {_dfmt_sql('p_size')} AS start_date,
         {_dfmt_sql('p_size + 2')} AS end_date, {_url_sql(0)} AS website, 3 AS days,
         'note ' || CAST(p_partkey AS VARCHAR) AS notes
       FROM part WHERE p_partkey % 2 = 0),
inc AS (SELECT p_partkey AS ord,
         CASE p_size % 3 WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN ' ' || upper(p_name) ELSE p_name END AS name,
         CASE WHEN p_size % 5 = 0 THEN '' ELSE {_url_sql(1)} END AS website,
         CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS category, '' AS cfp_date,
         CASE p_size % 3 WHEN 0 THEN 'Open' WHEN 1 THEN '' ELSE 'Check site' END AS cfp_status,
         'Loc ' || CAST(p_size % 7 AS VARCHAR) AS location, {_dfmt_sql('p_size % 20')} AS start_date,
         CASE WHEN p_size % 2 = 0 THEN {_dfmt_sql('p_size % 20 + 3')} ELSE '' END AS end_date
       FROM part WHERE p_partkey % 2 = 1),
named AS (SELECT * FROM ex WHERE {_key('name')} IS NOT NULL),
by_name AS (SELECT {_key('name')} AS k, arg_max(row_id, row_no) AS rid FROM named GROUP BY 1),
by_url AS (SELECT {_key('website')} AS k, arg_max(row_id, row_no) AS rid FROM named
           WHERE {_key('website')} IS NOT NULL GROUP BY 1),
mt AS (SELECT inc.*, coalesce(bn.rid, bu.rid) AS match_row_id,
         CASE WHEN bn.rid IS NOT NULL THEN 'name' WHEN bu.rid IS NOT NULL THEN 'url' END AS match_by
       FROM inc LEFT JOIN by_name bn ON bn.k = {_key('inc.name')}
                LEFT JOIN by_url bu ON bu.k = {_key('inc.website')})
"""

_MANAGED = ["category", "cfp_date", "cfp_status", "location", "start_date", "end_date"]

_chg = ",\n".join(
    f"{_trim(f'coalesce(m.{c}, {chr(39)}{chr(39)})')} AS new_{c}, "
    f"({_trim(f'coalesce(m.{c}, {chr(39)}{chr(39)})')} <> '' AND {_trim(f'coalesce(m.{c}, {chr(39)}{chr(39)})')} "
    f"<> {_trim(f'coalesce(ex.{c}, {chr(39)}{chr(39)})')}) AS chg_{c}"
    for c in _MANAGED)

_UPSERT_CORE = _UPSERT_IN + f""",
mm AS (SELECT m.ord, m.match_row_id, m.start_date AS in_start, m.end_date AS in_end,
         {_trim("coalesce(ex.start_date, '')")} AS old_start, {_trim("coalesce(ex.end_date, '')")} AS old_end,
         {_chg}
       FROM mt m JOIN ex ON ex.row_id = m.match_row_id),
mc AS (SELECT *, ({' OR '.join('chg_' + c for c in _MANAGED)}) AS changed,
         CASE WHEN chg_start_date OR chg_end_date THEN
           {_days("CASE WHEN coalesce(in_start, '') <> '' THEN in_start ELSE old_start END",
                  "CASE WHEN coalesce(in_end, '') <> '' THEN in_end ELSE old_end END")} END AS days_new
       FROM mm),
per_row AS (SELECT match_row_id AS row_id,
         {', '.join(f'arg_max(new_{c}, ord) FILTER (WHERE chg_{c}) AS fin_{c}' for c in _MANAGED)},
         arg_max(days_new, ord) FILTER (WHERE days_new IS NOT NULL) AS fin_days
       FROM mc WHERE changed GROUP BY 1),
updated AS (SELECT ex.sheet, ex.row_id, ex.row_no, ex.name,
         {', '.join(f'coalesce(p.fin_{c}, ex.{c}) AS {c}' for c in _MANAGED)},
         ex.website, CAST(coalesce(p.fin_days, ex.days) AS BIGINT) AS days, ex.notes
       FROM ex LEFT JOIN per_row p ON p.row_id = ex.row_id),
src AS (SELECT ord, name, website FROM mt WHERE match_row_id IS NULL),
{_greedy_sql('src', 'ord')},
appended AS (SELECT 'Conferences' AS sheet,
         (SELECT max(row_id) FROM ex) + row_number() OVER (ORDER BY u.ord) AS row_id,
         CAST((SELECT max(row_no) FROM ex) + row_number() OVER (ORDER BY u.ord) AS BIGINT) AS row_no,
         {_trim("coalesce(u.name, '')")} AS name,
         {', '.join(f"coalesce(u.{c}, '') AS {c}" for c in _MANAGED)},
         {_trim("coalesce(u.website, '')")} AS website,
         {_days("coalesce(u.start_date, '')", "coalesce(u.end_date, '')")} AS days, '' AS notes
       FROM mt u WHERE u.ord IN (SELECT ord FROM greedy))
"""

SQL["upsert_match"] = f"WITH {_UPSERT_IN} SELECT ord, match_row_id, match_by FROM mt"

SQL["upsert_snapshot"] = f"""
WITH RECURSIVE {_UPSERT_CORE}
SELECT sheet, row_id, row_no, name, category, cfp_date, cfp_status, location, start_date, end_date, website, days, notes
FROM updated UNION ALL
SELECT sheet, row_id, row_no, name, category, cfp_date, cfp_status, location, start_date, end_date, website, days, notes
FROM appended
"""

SQL["plan_apply"] = SQL["upsert_snapshot"]

_fields_unnest = ", ".join(
    f"{{'field': '{c}', 'old': ex.{c}, 'new': p.fin_{c}}}" for c in _MANAGED)

SQL["change_plan"] = f"""
WITH RECURSIVE {_UPSERT_CORE},
u AS (SELECT p.row_id, unnest([{_fields_unnest},
        {{'field': 'days', 'old': CAST(ex.days AS VARCHAR), 'new': CAST(p.fin_days AS VARCHAR)}}]) AS c
      FROM per_row p JOIN ex ON ex.row_id = p.row_id)
SELECT 'update' AS action, 'Conferences' AS sheet, row_id, c.field AS field, c.old AS old, c.new AS new
FROM u WHERE c.new IS NOT NULL
UNION ALL
SELECT 'insert', 'Conferences', row_id, 'name', NULL, name FROM appended
"""

SQL["upsert_counts"] = f"""
WITH RECURSIVE {_UPSERT_CORE}
SELECT (SELECT CAST(count(*) AS BIGINT) FROM appended) AS added,
       (SELECT CAST(count(*) AS BIGINT) FROM mc WHERE changed) AS updated
"""


# -------------------------------------------------------------- route ----

def _first_rule_sql(e: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {_any(e, needles)} THEN {_lit(label)}" for label, needles in rules) + " END"


_CLASSIFIED = f"""
cl AS (SELECT e.event_id,
         CASE WHEN e.event_type IN ('click', 'view', 'signup') THEN 'meetup' ELSE 'conference' END AS event_type,
         concat_ws(', ', c.c_name, n.n_name, r.r_name) AS location,
         strftime(CAST(e.ts AS DATE), '%b %d, %Y') AS start_date,
         json_extract_string(e.props, '$.k') AS fit_raw, e.value > 50 AS demo_suitable,
         CASE WHEN e.event_id % 4 = 0 THEN true WHEN e.event_id % 4 = 1 THEN NULL ELSE false END AS hint
       FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
       JOIN region r ON n.n_regionkey = r.r_regionkey)
"""

SQL["city_route"] = f"""
WITH {_CLASSIFIED},
f AS (SELECT *, {_first_rule_sql('location', ROUTE_RULES)} AS city,
        coalesce(TRY_CAST(fit_raw AS INTEGER), 0) AS fit_score,
        coalesce(demo_suitable, false) OR coalesce(hint, false) AS is_demo
      FROM cl WHERE event_type = 'meetup'
        AND NOT coalesce({_parse5('start_date')} < DATE '{AS_OF_EVENTS}', false))
SELECT event_id, city, CAST(fit_score AS BIGINT) AS fit_score, is_demo,
  CASE WHEN city = 'San Francisco' AND is_demo THEN 'SF Product Demos' ELSE 'Meet-ups' END AS sheet
FROM f WHERE city IS NOT NULL AND fit_score >= 0
"""


# ------------------------------------------------------------ replies ----

def _disc_sql(truncate_odd: bool) -> str:
    drop_last = "AND NOT (reply_id % 2 = 1 AND pos = n_items)" if truncate_odd else ""
    return f"""
WITH it AS (
  SELECT CAST(user_id * 4294967296 + floor(event_id / 64) AS BIGINT) AS reply_id,
    CAST(user_id % 3 AS INTEGER) AS search_rank, event_id,
    CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type || ' meetup ' || CAST(event_id % 97 AS VARCHAR) END AS name,
    'City ' || CAST(user_id % 7 AS VARCHAR) AS location, strftime(CAST(ts AS DATE), '%b %d, %Y') AS start_date,
    'https://ev.example/' || CAST(event_id AS VARCHAR) AS website, event_type AS why,
    CASE WHEN user_id % 3 = 2 THEN value > 50 END AS demo
  FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY reply_id ORDER BY event_id) AS pos,
        count(*) OVER (PARTITION BY reply_id) AS n_items FROM it),
known AS (SELECT DISTINCT {_key("event_type || ' meetup ' || CAST(event_id % 97 AS VARCHAR)")} AS k
          FROM events WHERE value > 140),
c AS (SELECT * FROM p WHERE {_trim('name')} <> '' {drop_last}
        AND NOT EXISTS (SELECT 1 FROM known WHERE known.k = {_key('p.name')})),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower({_trim('name')})
        ORDER BY search_rank, reply_id, pos) AS rn FROM c) WHERE rn = 1)
SELECT {_trim('name')} AS name,
  'Web discovery (' || CASE search_rank WHEN 0 THEN 'CFP-open conference' WHEN 1 THEN 'ticketed conference'
                          ELSE 'meetup/Berlin' END || ')' AS source,
  location AS raw_location, start_date AS raw_start_date, '' AS raw_end_date, website,
  CASE search_rank WHEN 0 THEN 'CFP-open conference' WHEN 1 THEN 'ticketed conference' ELSE 'meetup/Berlin' END
    || '. ' || why AS card_text,
  CAST(NULL AS VARCHAR) AS cfp_status, CAST(NULL AS VARCHAR) AS cfp_date, demo AS hint_demo_suitable,
  search_rank AS source_rank, concat(reply_id, ':', pos - 1) AS ord
FROM w
"""


SQL["reply_explode"] = _disc_sql(False)
SQL["reply_repair"] = _disc_sql(True)


# ----------------------------------------------------------- patterns ----

_LEARN = """
ld AS (SELECT d.doc_id, d.text, d.lang AS category, l.quality AS label
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
tot AS (SELECT category, CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
               CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos FROM ld GROUP BY 1),
tk AS (SELECT category, label, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}+'))) AS term FROM ld),
dfc AS (SELECT category, term, CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg_df,
               CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos_df
        FROM tk GROUP BY 1, 2 HAVING neg_df + pos_df >= 5),
wt AS (SELECT dfc.*, round(ln((neg_df + 1.0) / (n_neg - neg_df + 1.0)) - ln((pos_df + 1.0) / (n_pos - pos_df + 1.0)), 6) AS weight
       FROM dfc JOIN tot USING (category)),
sg AS (SELECT *, CASE WHEN weight > 0 THEN 'reject' ELSE 'prefer' END AS side FROM wt WHERE weight <> 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY category, side ORDER BY abs(weight) DESC, term) AS rank FROM sg),
signals AS (SELECT category, side, CAST(rank AS BIGINT) AS rank, term, weight, neg_df, pos_df FROM rk WHERE rank <= 10)
"""

SQL["learn_patterns"] = f"WITH {_LEARN} SELECT * FROM signals"

SQL["reject_patterns"] = f"""
WITH {_LEARN.replace("HAVING neg_df + pos_df >= 5", "HAVING neg_df + pos_df >= 40").replace("rank <= 10", "rank <= 12")},
bad AS (SELECT category, term FROM signals WHERE side = 'reject'),
held AS MATERIALIZED (
  SELECT DISTINCT doc_id, category, label, term
  FROM (SELECT doc_id, category, label, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+'))) AS term FROM ld)
  JOIN bad USING (category, term)),
two AS (SELECT a.doc_id, a.category, a.label, a.term || ' + ' || b.term AS pattern, b.term AS last, 2 AS n_words
        FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.term < b.term),
three AS (SELECT two.doc_id, two.category, two.label, pattern || ' + ' || c.term AS pattern, c.term AS last, 3 AS n_words
          FROM two JOIN held c ON c.doc_id = two.doc_id AND two.last < c.term),
cnt AS (SELECT category, pattern, n_words, count(*) FILTER (label = 0) AS neg_df, count(*) FILTER (label = 1) AS pos_df
        FROM (SELECT * FROM two UNION ALL SELECT * FROM three) GROUP BY ALL HAVING count(*) FILTER (label = 0) >= 3),
sc AS (SELECT cnt.*, round(ln((neg_df + 1.0) / (n_neg - neg_df + 1.0)) - ln((pos_df + 1.0) / (n_pos - pos_df + 1.0)), 6) AS weight
       FROM cnt JOIN tot USING (category)),
top AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY weight DESC, neg_df DESC, pattern) AS rank
        FROM sc WHERE weight > 0)
SELECT category, CAST(rank AS BIGINT) AS rank, pattern, CAST(n_words AS BIGINT) AS n_words, weight,
  CAST(neg_df AS BIGINT) AS neg_df, CAST(pos_df AS BIGINT) AS pos_df
FROM top WHERE rank <= 20
"""

SQL["scorer_udf"] = """
WITH w AS (SELECT doc_id, contains(coalesce(text, ''), '|') AS bars,
                  regexp_extract_all(coalesce(text, ''), '\\S+') AS ws FROM documents),
f AS (SELECT doc_id, bars, CAST(100 * len([x FOR x IN ws IF len(x) >= 6]) // greatest(1, len(ws)) AS BIGINT) AS fit FROM w)
SELECT doc_id, CASE WHEN bars THEN 'failed' WHEN fit >= 30 THEN 'relevant' ELSE 'rejected' END AS outcome,
  CASE WHEN NOT bars THEN fit END AS fit_score, CASE WHEN bars THEN 'ValueError: bars' END AS score_error
FROM f
"""

SQL["observed_outcomes"] = f"""
SELECT o.outcome, count(s.outcome) AS n FROM (VALUES ('relevant'), ('rejected'), ('failed')) AS o(outcome)
LEFT JOIN ({SQL["scorer_udf"]}) s ON s.outcome = o.outcome GROUP BY o.outcome
"""

SQL["signal_score"] = f"""
WITH {_LEARN},
d AS (SELECT doc_id, text, lang AS category, sha256(text) AS name FROM documents),
tox AS (SELECT DISTINCT {_key('d.name')} AS k FROM d JOIN labels l ON d.doc_id = l.doc_id
        WHERE l.toxic = 1 AND {_key('d.name')} IS NOT NULL),
bl AS (SELECT d.*, EXISTS (SELECT 1 FROM tox WHERE tox.k = {_key('d.name')}) AS blocked FROM d),
toks AS (SELECT doc_id, category, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+'))) AS term
         FROM bl WHERE NOT blocked),
ev AS (SELECT t.doc_id, CAST(sum(CAST(round(s.weight * 1000000) AS BIGINT)) AS BIGINT) AS ev, CAST(count(*) AS BIGINT) AS n
       FROM toks t JOIN signals s ON s.category = t.category AND s.term = t.term GROUP BY 1),
sc AS (SELECT bl.doc_id, coalesce(ev.ev, 0) AS evidence_micro, coalesce(ev.n, 0) AS n_signals
       FROM bl LEFT JOIN ev ON ev.doc_id = bl.doc_id WHERE NOT bl.blocked),
fs AS (SELECT *, CAST(least(greatest(round(50.0 - 0.00001 * evidence_micro), 0.0), 100.0) AS BIGINT) AS fit_score FROM sc)
SELECT doc_id, evidence_micro, n_signals, fit_score,
  CASE WHEN fit_score >= 50 THEN 'relevant' ELSE 'rejected' END AS outcome FROM fs
UNION ALL
SELECT doc_id, NULL, NULL, NULL, 'blocked' FROM bl WHERE blocked
"""


# ----------------------------------------------------------- editions ----

def _strip_year_sql(e: str) -> str:
    return _trim(f"regexp_replace({e}, '\\s*\\b(20\\d{{2}})\\b\\s*', ' ', 'g')")


SQL["edition_link"] = f"""
WITH p AS (
  SELECT p_partkey AS row_id, p_name || ' ' || CAST(2000 + p_size % 5 AS VARCHAR) AS name,
    CASE WHEN p_size % 9 = 0 THEN '' ELSE strftime(DATE '1995-01-10' + CAST(p_size * 30 AS INTEGER) * INTERVAL 1 DAY, '%b %d, %Y') END AS start_date,
    p_type AS category, 'City ' || p_brand AS location, 'https://past.example/' || CAST(p_partkey AS VARCHAR) AS website
  FROM part),
pk AS (SELECT *, lower({_strip_year_sql('name')}) AS base, {_parse5('start_date')} AS pd FROM p),
c0 AS (
  SELECT CAST(l.l_orderkey * 8 + l.l_linenumber AS BIGINT) AS cand_id, pt.p_name AS base_name,
    CASE WHEN l.l_linenumber = 2 THEN '' ELSE pt.p_name || ' ' || CAST(year(l.l_shipdate) AS VARCHAR) || ' edition' END AS name,
    CASE WHEN l.l_linenumber = 5 THEN '' ELSE strftime(CAST(l.l_shipdate AS DATE), '%b %d, %Y') END AS start_date,
    strftime(CAST(l.l_shipdate AS DATE) + INTERVAL 2 DAY, '%b %d, %Y') AS end_date,
    CASE WHEN l.l_linenumber = 3 THEN '' ELSE 'Loc ' || CAST(l.l_suppkey AS VARCHAR) END AS location,
    CASE WHEN l.l_linenumber = 4 THEN '' ELSE 'https://next.example/' || CAST(l.l_orderkey AS VARCHAR) END AS website,
    CASE l.l_linenumber % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
    l.l_returnflag <> 'R' AS found
  FROM lineitem l JOIN part pt ON l.l_partkey = pt.p_partkey),
c AS (SELECT *, lower({_strip_year_sql('base_name')}) AS base, {_parse5('start_date')} AS cd FROM c0
      WHERE coalesce(found, false) AND NOT coalesce(confidence = 'low', false)
        AND NOT coalesce({_parse5('start_date')} < {AS_O}, false)),
nd AS (SELECT pk.row_id, pk.base, min(c.cd) AS nd FROM pk JOIN c ON pk.base = c.base
       WHERE c.cd IS NOT NULL AND (pk.pd IS NULL OR c.cd > pk.pd) GROUP BY 1, 2),
best AS (SELECT nd.row_id, min({{'cand_id': c.cand_id, 'name': c.name, 'start_date': c.start_date,
           'end_date': c.end_date, 'location': c.location, 'website': c.website}}) AS cs
         FROM nd JOIN c ON c.base = nd.base AND c.cd = nd.nd GROUP BY 1),
und AS (SELECT base, min({{'cand_id': cand_id, 'name': name, 'start_date': start_date, 'end_date': end_date,
           'location': location, 'website': website}}) AS cs FROM c WHERE cd IS NULL GROUP BY 1),
ch AS (SELECT pk.*, coalesce(best.cs, und.cs) AS cs FROM pk LEFT JOIN best ON best.row_id = pk.row_id
       LEFT JOIN und ON und.base = pk.base)
SELECT row_id,
  coalesce(nullif(cs.name, ''), {_strip_year_sql('name')} || ' ' || CAST(year({AS_O}) + 1 AS VARCHAR)) AS next_name,
  coalesce(category, '') AS category, coalesce(nullif(cs.location, ''), location) AS location,
  coalesce(cs.start_date, '') AS start_date, coalesce(cs.end_date, '') AS end_date,
  coalesce(nullif(cs.website, ''), website) AS website, cs.cand_id AS cand_id
FROM ch WHERE cs IS NOT NULL
"""


# ---------------------------------------------------------------- cfp ----

_CFP_IN = f"""
t AS (SELECT o_orderkey AS row_id, 'Conf ' || CAST(o_orderkey AS VARCHAR) AS name,
        CASE WHEN o_orderkey % 10 = 0 THEN 'TBC' ELSE strftime(CAST(o_orderdate AS DATE), '%b %d, %Y') END AS start_date,
        CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN ' Check Site ' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'not yet announced'
             WHEN 4 THEN 'Open' WHEN 5 THEN 'Closed' WHEN 6 THEN '—' END AS cfp_status, '' AS cfp_date
      FROM orders),
f0 AS (SELECT 'Conf ' || CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS ord,
         coalesce(CASE o_orderstatus WHEN 'F' THEN 'Open' WHEN 'O' THEN 'Closed' END, 'Unknown') AS st,
         CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY, '%b %d, %Y') END AS fact_date
       FROM orders),
facts AS (SELECT lower({_trim('key')}) AS fact_key,
            CASE WHEN st = 'Open' AND coalesce({_parse5('fact_date')} < {AS_O}, false) THEN 'Closed' ELSE st END AS fact_status,
            fact_date FROM (SELECT *, row_number() OVER (PARTITION BY lower({_trim('key')}) ORDER BY ord) AS rn FROM f0) WHERE rn = 1)
"""

SQL["cfp_refresh"] = f"""
WITH {_CFP_IN},
cand AS (SELECT * FROM t WHERE NOT coalesce({_parse5('start_date')} < {AS_O}, false)
           AND coalesce(lower({_trim('cfp_status')}), '') IN ('', 'check site', 'not yet announced', 'unknown')),
pt AS (SELECT cand.row_id, facts.fact_date, facts.fact_status FROM cand JOIN facts ON lower({_trim('cand.name')}) = facts.fact_key
       WHERE facts.fact_status <> '' OR facts.fact_date <> '')
SELECT t.row_id, coalesce(nullif(coalesce(pt.fact_date, ''), ''), t.cfp_date) AS cfp_date,
  coalesce(nullif(coalesce(pt.fact_status, ''), ''), t.cfp_status) AS cfp_status
FROM t JOIN pt ON pt.row_id = t.row_id
"""

SQL["cfp_enrich"] = f"""
WITH {_CFP_IN},
ev AS (SELECT row_id, name, cfp_date,
         CASE WHEN coalesce(cfp_status, '') <> '' AND coalesce(cfp_status, '') <> 'Check site' THEN cfp_status ELSE 'Open' END AS cfp_status
       FROM t)
SELECT ev.row_id, CASE WHEN facts.fact_key IS NOT NULL THEN facts.fact_status ELSE ev.cfp_status END AS cfp_status,
  CASE WHEN facts.fact_key IS NOT NULL AND facts.fact_date <> '' THEN facts.fact_date ELSE ev.cfp_date END AS cfp_date
FROM ev LEFT JOIN facts ON lower({_trim('ev.name')}) = facts.fact_key
"""


# ---------------------------------------------------------- lifecycle ----

_LIFE = f"""
tr AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'Time Passed' WHEN o_orderstatus = 'O' THEN 'Conferences'
                   WHEN o_orderkey % 2 = 0 THEN 'Meet-ups' ELSE 'SF Product Demos' END AS sheet,
         o_orderkey AS row_id, CAST(o_orderkey + 2 AS BIGINT) AS row_no, 'Conf ' || CAST(o_custkey AS VARCHAR) AS name,
         o_orderpriority AS category, CAST(NULL AS VARCHAR) AS cfp_date, CAST(NULL AS VARCHAR) AS cfp_status,
         CAST(NULL AS VARCHAR) AS location,
         CASE WHEN o_orderkey % 10 = 0 THEN 'TBC' ELSE strftime(CAST(o_orderdate AS DATE), '%b %d, %Y') END AS start_date,
         CAST(NULL AS VARCHAR) AS end_date, 'https://c.example/' || CAST(o_orderkey AS VARCHAR) AS website,
         CAST(NULL AS BIGINT) AS days, 'n' || CAST(o_orderkey AS VARCHAR) AS notes
       FROM orders)
"""

SQL["purge_past"] = f"""
WITH {_LIFE}
SELECT sheet, row_id, start_date FROM tr
WHERE NOT (sheet IN ('Meet-ups', 'SF Product Demos') AND coalesce({_parse5('start_date')} < {AS_O}, false))
"""


def _upsert_sql(target: str, inc: str, all_rows: str, sheet: str, carry_notes: bool) -> str:
    """CTEs of a K1 upsert of ``inc`` (ord, name, website, managed fields,
    notes) into ``target`` (tracker rows of one sheet); defines ``arch``."""
    chg = ",\n".join(
        f"{_trim(f'coalesce(m.{c}, {chr(39)}{chr(39)})')} AS new_{c}, "
        f"({_trim(f'coalesce(m.{c}, {chr(39)}{chr(39)})')} <> '' AND {_trim(f'coalesce(m.{c}, {chr(39)}{chr(39)})')} "
        f"<> {_trim(f'coalesce(x.{c}, {chr(39)}{chr(39)})')}) AS chg_{c}"
        for c in _MANAGED)
    notes = "coalesce(u.notes, '')" if carry_notes else "''"
    return f"""
u_named AS (SELECT * FROM {target} WHERE {_key('name')} IS NOT NULL),
u_bn AS (SELECT {_key('name')} AS k, arg_max(row_id, row_no) AS rid FROM u_named GROUP BY 1),
u_bu AS (SELECT {_key('website')} AS k, arg_max(row_id, row_no) AS rid FROM u_named WHERE {_key('website')} IS NOT NULL GROUP BY 1),
u_mt AS (SELECT i.*, coalesce(bn.rid, bu.rid) AS match_row_id FROM {inc} i
         LEFT JOIN u_bn bn ON bn.k = {_key('i.name')} LEFT JOIN u_bu bu ON bu.k = {_key('i.website')}),
u_mm AS (SELECT m.ord, m.match_row_id, m.start_date AS in_start, m.end_date AS in_end,
           {_trim("coalesce(x.start_date, '')")} AS old_start, {_trim("coalesce(x.end_date, '')")} AS old_end, {chg}
         FROM u_mt m JOIN {target} x ON x.row_id = m.match_row_id),
u_mc AS (SELECT *, ({' OR '.join('chg_' + c for c in _MANAGED)}) AS changed,
           CASE WHEN chg_start_date OR chg_end_date THEN
             {_days("CASE WHEN coalesce(in_start, '') <> '' THEN in_start ELSE old_start END",
                    "CASE WHEN coalesce(in_end, '') <> '' THEN in_end ELSE old_end END")} END AS days_new
         FROM u_mm),
u_pr AS (SELECT match_row_id AS row_id,
           {', '.join(f'arg_max(new_{c}, ord) FILTER (WHERE chg_{c}) AS fin_{c}' for c in _MANAGED)},
           arg_max(days_new, ord) FILTER (WHERE days_new IS NOT NULL) AS fin_days
         FROM u_mc WHERE changed GROUP BY 1),
u_upd AS (SELECT x.sheet, x.row_id, x.row_no, x.name, {', '.join(f'coalesce(p.fin_{c}, x.{c}) AS {c}' for c in _MANAGED)},
            x.website, CAST(coalesce(p.fin_days, x.days) AS BIGINT) AS days, x.notes
          FROM {target} x LEFT JOIN u_pr p ON p.row_id = x.row_id),
u_src AS (SELECT ord, name, website FROM u_mt WHERE match_row_id IS NULL),
{_greedy_sql('u_src', 'ord')},
u_app AS (SELECT '{sheet}' AS sheet,
            (SELECT coalesce(max(row_id), 0) FROM {all_rows}) + row_number() OVER (ORDER BY u.ord) AS row_id,
            CAST((SELECT coalesce(max(row_no), 1) FROM {target}) + row_number() OVER (ORDER BY u.ord) AS BIGINT) AS row_no,
            {_trim("coalesce(u.name, '')")} AS name, {', '.join(f"coalesce(u.{c}, '') AS {c}" for c in _MANAGED)},
            {_trim("coalesce(u.website, '')")} AS website,
            {_days("coalesce(u.start_date, '')", "coalesce(u.end_date, '')")} AS days, {notes} AS notes
          FROM u_mt u WHERE u.ord IN (SELECT ord FROM greedy)),
arch AS (SELECT * FROM u_upd UNION ALL SELECT * FROM u_app)
"""


SQL["migrate_past"] = f"""
WITH RECURSIVE {_LIFE},
tgt AS (SELECT * FROM tr WHERE sheet = 'Time Passed'),
mv AS (SELECT * FROM tr WHERE sheet = 'Conferences' AND coalesce({_parse5('start_date')} < {AS_O}, false)),
ev AS (SELECT CAST(row_no AS BIGINT) AS ord, name, website,
         {', '.join(f"nullif({_trim(c)}, '') AS {c}" for c in _MANAGED)}, notes FROM mv),
{_upsert_sql('tgt', 'ev', 'tr', 'Time Passed', True)},
keys AS (SELECT {_key('name')} AS k FROM arch WHERE {_key('name')} IS NOT NULL
         UNION SELECT {_key('website')} FROM arch WHERE {_key('website')} IS NOT NULL),
gone AS (SELECT row_id FROM mv WHERE {_key('name')} IN (SELECT k FROM keys) OR {_key('website')} IN (SELECT k FROM keys))
SELECT sheet, row_id, row_no, name, category, start_date, website, days, notes FROM tr
WHERE sheet <> 'Time Passed' AND row_id NOT IN (SELECT row_id FROM gone)
UNION ALL
SELECT sheet, row_id, row_no, name, category, start_date, website, days, notes FROM arch
"""


# ------------------------------------------------------------ reports ----

SQL["shortfall"] = """
WITH t(segment, wanted) AS (VALUES ('click', 3000), ('view', 15), ('signup', 5), ('purchase', 5), ('error', 5), ('per_city', 3)),
f AS (SELECT event_type AS segment, count(*) AS found FROM events GROUP BY 1)
SELECT t.segment, CAST(t.wanted AS BIGINT) AS wanted, CAST(coalesce(f.found, 0) AS BIGINT) AS found,
  CAST(greatest(t.wanted - coalesce(f.found, 0), 0) AS BIGINT) AS short, coalesce(f.found, 0) < t.wanted AS retry
FROM t LEFT JOIN f ON f.segment = t.segment
"""

SQL["run_metrics"] = """
WITH x AS (
  SELECT d.source, CASE WHEN l.toxic = 1 THEN 'blocked' WHEN l.quality = 1 THEN 'relevant'
                        WHEN l.quality = 0 THEN 'rejected' ELSE 'failed' END AS outcome
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT CASE WHEN grouping(source) = 1 THEN '(all)' ELSE coalesce(source, '') END AS source,
       CASE WHEN grouping(outcome) = 1 THEN '(all)' ELSE coalesce(outcome, '') END AS outcome,
       CAST(count(*) AS BIGINT) AS n
FROM x GROUP BY ROLLUP (source, outcome)
"""

SQL["digest"] = """
WITH e AS (
  SELECT event_type, ts, event_id,
    '  • <https://ev.example/' || CAST(event_id AS VARCHAR) || '|' || event_type || ' ' || CAST(event_id AS VARCHAR)
      || '> — ' || strftime(CAST(ts AS DATE), '%b %d, %Y') || ', City ' || CAST(user_id % 7 AS VARCHAR) AS line
  FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM e)
SELECT event_type, CAST(count(*) AS BIGINT) AS n_rows,
  string_agg(line, chr(10) ORDER BY ts, event_id) FILTER (WHERE rn <= 6) AS text
FROM r GROUP BY 1
"""

SQL["sheet_normalise"] = f"""
WITH c AS (
  SELECT c_custkey AS k, c_mktsegment AS seg,
    CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN '  ' || c_name || ' ' ELSE c_name END AS nm,
    'https://c' || CAST(c_custkey AS VARCHAR) || '.example' AS site, 'n' || CAST(c_custkey AS VARCHAR) AS note
  FROM customer)
SELECT CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS sheet, CAST(k + 2 AS BIGINT) AS row_no,
  {_trim('nm')} AS name, site AS website,
  CASE WHEN k % 2 = 0 THEN (CASE WHEN k % 4 = 2 THEN '' ELSE note END)
       ELSE (CASE WHEN k % 4 = 1 THEN '' ELSE note END) END AS notes,
  CASE WHEN k % 2 = 0 THEN (CASE WHEN k % 4 = 2 THEN '' ELSE seg END)
       ELSE (CASE WHEN k % 4 = 1 THEN '' ELSE seg END) END AS segment
FROM c WHERE {_trim('nm')} <> ''
"""

_CITIES = ["San Francisco", "Munich", "Berlin", "Bucharest", "London", "Dublin"]
_label = (f"CASE WHEN regexp_replace(coalesce(st, '') || ' – ' || coalesce(en, ''), '^[ –]+|[ –]+$', '', 'g') = '' "
          f"THEN 'unknown' ELSE regexp_replace(coalesce(st, '') || ' – ' || coalesce(en, ''), '^[ –]+|[ –]+$', '', 'g') END")
SQL["requests"] = f"""
WITH x AS (
  SELECT e.event_id, e.event_type || ' ' || CAST(e.event_id AS VARCHAR) AS name,
    CASE WHEN e.event_id % 5 = 0 THEN '' ELSE n.n_name END AS loc,
    CASE WHEN e.event_id % 7 = 0 THEN '' ELSE strftime(CAST(e.ts AS DATE), '%b %d, %Y') END AS st,
    CASE WHEN e.event_id % 3 = 0 THEN '' ELSE strftime(CAST(e.ts AS DATE) + INTERVAL 1 DAY, '%b %d, %Y') END AS en,
    CASE WHEN e.event_id % 4 = 0 THEN '' ELSE 'https://ev.example/' || CAST(e.event_id AS VARCHAR) END AS site
  FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
segs AS (SELECT DISTINCT event_type AS seg FROM events),
cities AS (SELECT unnest([{', '.join(_lit(c) for c in _CITIES)}]) AS city)
SELECT 'cfp:' || CAST(event_id AS VARCHAR) AS req_id, 'cfp' AS kind, CAST(event_id AS VARCHAR) AS key,
  'CFP lookup | ' || name || ' | ' || coalesce(nullif({_trim('loc')}, ''), 'unknown') || ' | ' || {_label}
    || ' | ' || coalesce(nullif({_trim('site')}, ''), 'unknown') AS text
FROM x
UNION ALL
SELECT 'city:' || seg || ':' || replace(lower(city), ' ', ''), 'meetup', seg || '/' || replace(lower(city), ' ', ''),
  'Find ' || seg || ' meetups in ' || city || ' (' || replace(lower(city), ' ', '') || ')'
FROM segs, cities
"""


# --------------------------------------------------------------- ical ----

def _ical_date(kind: str, ts: str) -> str:
    return (f"CASE {kind} WHEN 2 THEN CAST(timezone('UTC', ({ts}) AT TIME ZONE 'America/Los_Angeles') AS DATE) "
            f"ELSE CAST({ts} AS DATE) END")


SQL["ical_scan"] = f"""
WITH e AS (
  SELECT event_id, user_id % 3 AS feed, floor(event_id / 64) AS chunk, event_id % 4 AS kind,
    CASE WHEN event_id % 6 = 0 THEN event_type || ', ' || CAST(event_id % 50 AS VARCHAR)
         ELSE event_type || ' ' || CAST(event_id % 50 AS VARCHAR) END AS name,
    CAST(date_trunc('second', ts) AS TIMESTAMP) AS t0,
    CASE WHEN event_id % 5 = 0 THEN 'Default ' || CAST(user_id % 3 AS VARCHAR)
         ELSE 'City ' || CAST(user_id % 7 AS VARCHAR) END AS raw_location,
    'https://ev.example/' || CAST(event_id AS VARCHAR) AS website,
    'Event ' || CAST(event_id AS VARCHAR) || ' of type ' || event_type || ', value '
      || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || chr(10) || 'more' AS card_text,
    event_id % 17 <> 0 AS has_summary, event_id % 19 <> 0 AS has_start
  FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY feed, chunk ORDER BY event_id) AS pos,
        {_ical_date('kind', 't0')} AS sd, {_ical_date('kind', 't0 + INTERVAL 1 HOUR')} AS ed FROM e),
k AS (SELECT * FROM p WHERE has_summary AND has_start
        AND sd BETWEEN DATE '{AS_OF_EVENTS}' AND DATE '{AS_OF_EVENTS}' + INTERVAL 180 DAY),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY feed, chunk, pos) AS rn
                     FROM k) WHERE rn = 1)
SELECT name, 'iCal (Feed ' || CAST(feed AS VARCHAR) || ')' AS source, raw_location,
  strftime(sd, '%b %d, %Y') AS raw_start_date, strftime(ed, '%b %d, %Y') AS raw_end_date, website,
  substring(card_text, 1, 400) AS card_text
FROM w
"""


SQL["ical_files"] = SQL["ical_scan"]


# -------------------------------------------------------------- union ----

def _seeds_sql() -> str:
    from ..vocab import SEED_EVENTS, SEED_SOURCES

    rows = []
    for i, ((n, url, loc, s, e, cat, st), src) in enumerate(zip(SEED_EVENTS, SEED_SOURCES), start=1):
        rows.append(f"({_lit(src)}, CAST({i} AS BIGINT), {_lit(n)}, {_lit(url)}, {_lit(loc)}, {_lit(s)}, "
                    f"{'NULL' if st is None else _lit(st)})")
    return "VALUES " + ", ".join(rows)


SQL["source_union"] = f"""
WITH {_LINKS},
seeds(source, ord, name, website, raw_location, raw_start_date, st) AS ({_seeds_sql()}),
pg AS (SELECT DISTINCT ON (url) url, {_cfp_state('html', ['cfp is open', 'call for proposals', 'call for papers', 'submit a talk', 'submit your proposal', 'submit now', 'apply to speak', 'sessionize'], ['cfp is closed', 'submissions are closed', 'cfp closed'], ['cfp is closed', 'submissions closed', 'cfp has closed'])} AS ps FROM pages ORDER BY url),
reg AS (SELECT DISTINCT {_host('url')} AS host FROM pages),
x AS (
  SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS d, c.c_name, n.n_name
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
lp AS (
  SELECT o_orderkey,
    concat_ws(' ', CASE o_orderkey % 5
        WHEN 0 THEN strftime(d, '%b %-d') || '-' || strftime(d + INTERVAL 3 DAY, '%b %-d')
        WHEN 1 THEN strftime(d, '%b %-d') || '-' || CAST(day(d) + 2 AS VARCHAR)
        WHEN 2 THEN strftime(d, '%b %-d')
        WHEN 3 THEN strftime(d, '%b %-d') || ' - ' || CAST(day(d) + 1 AS VARCHAR) END, c_name, n_name) AS parent_text,
    CASE WHEN o_orderkey % 11 = 0 THEN c_name || ' Summit' ELSE c_name END AS name
  FROM x),
lq AS (SELECT *, contains(parent_text, name) AS has, {_trim("split_part(parent_text, name, -1)")} AS after_,
         {_trim("split_part(parent_text, name, 1)")} AS before_ FROM lp),
lr AS (SELECT *, CASE WHEN has THEN {_trim("split_part(after_, chr(10), 1)")} ELSE '' END AS location,
         CASE WHEN has THEN regexp_extract(before_, '{_RX_DATE}', 1) ELSE '' END AS date_raw FROM lq),
ls AS (SELECT *, {_trim('date_raw')} AS dd FROM lr),
lt AS (SELECT *,
  CASE WHEN date_raw = '' THEN ''
       WHEN regexp_extract(dd, '^([A-Za-z]+ \\d+)-([A-Za-z]+ \\d+)', 1) <> '' THEN regexp_extract(dd, '^([A-Za-z]+ \\d+)-([A-Za-z]+ \\d+)', 1)
       WHEN regexp_extract(dd, '^([A-Za-z]+) (\\d+)-(\\d+)', 1) <> '' THEN regexp_extract(dd, '^([A-Za-z]+) (\\d+)-(\\d+)', 1) || ' ' || regexp_extract(dd, '^([A-Za-z]+) (\\d+)-(\\d+)', 2)
       WHEN regexp_extract(dd, '^([A-Za-z]+ \\d+)', 1) <> '' THEN regexp_extract(dd, '^([A-Za-z]+ \\d+)', 1)
       ELSE dd END AS start_part FROM ls)
SELECT s.source, CAST(1 AS BIGINT) AS source_rank, CAST(s.ord AS VARCHAR) AS ord, s.name, s.website, s.raw_location, s.raw_start_date,
  coalesce(nullif({_trim('s.st')}, ''), pg.ps, 'Check site') AS cfp_status
FROM seeds s LEFT JOIN pg ON pg.url = s.website
UNION ALL
SELECT 'Pages', CAST(2 AS BIGINT), concat(page_id, ':', ord), text, link,
  CASE split_part({_host('url')}, '.', -1) WHEN 'com' THEN 'San Francisco, USA' WHEN 'org' THEN 'Berlin, Germany'
       WHEN 'net' THEN 'London, UK' ELSE 'Various' END, NULL, NULL
FROM links
UNION ALL
SELECT 'Listing', CAST(3 AS BIGINT), CAST(o_orderkey AS VARCHAR), name, '', coalesce(nullif({_trim('location')}, ''), 'Various'),
  coalesce(coalesce(nullif({_trim('start_part')}, ''), nullif({_trim('date_raw')}, '')), ''), NULL
FROM lt
"""


# ------------------------------------------------------ lookup replies ----

SQL["classifier_replies"] = """
SELECT event_id,
  CASE WHEN event_id % 3 = 2 THEN 'failed' WHEN value > 50 THEN 'relevant' ELSE 'rejected' END AS outcome,
  CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_type IN ('click', 'view') THEN 'meetup' ELSE 'conference' END AS event_type,
  CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS fit_score,
  CASE WHEN event_id % 4 = 0 THEN 'Closed'
       WHEN event_id % 3 = 2 THEN NULL
       WHEN event_id % 5 = 0 THEN 'Open' ELSE 'Check site' END AS cfp_status
FROM events
"""

SQL["cfp_lookup_replies"] = f"""
WITH f AS (
  SELECT 'conf ' || CAST(o_orderkey AS VARCHAR) AS fact_key,
    CASE o_orderstatus WHEN 'F' THEN 'Open' WHEN 'O' THEN 'Closed' ELSE 'Unknown' END AS st,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY, '%b %d, %Y') END AS fact_date,
    CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE 'https://cfp.example/' || CAST(o_orderkey AS VARCHAR) END AS fact_url
  FROM orders WHERE o_orderkey % 4 <> 3)
SELECT fact_key,
  CASE WHEN st = 'Open' AND coalesce({_parse5('fact_date')} < {AS_O}, false) THEN 'Closed' ELSE st END AS fact_status,
  fact_date, fact_url
FROM f
"""

SQL["discovery_round"] = f"""
WITH d AS ({_disc_sql(False)}),
c AS (SELECT regexp_extract(source, '^Web discovery \\((.*)\\)$', 1) AS segment, count(*) AS found FROM d GROUP BY 1),
t(segment, wanted) AS (VALUES ('CFP-open conference', 5), ('ticketed conference', 5), ('meetup/Berlin', 3))
SELECT t.segment, CAST(t.wanted AS BIGINT) AS wanted, CAST(coalesce(c.found, 0) AS BIGINT) AS found,
  CAST(greatest(t.wanted - coalesce(c.found, 0), 0) AS BIGINT) AS short, coalesce(c.found, 0) < t.wanted AS retry
FROM t LEFT JOIN c ON c.segment = t.segment
"""


# ------------------------------------------------------------ page scans ----
# On the fixture pages every anchor sits alone in an <li>, so the parent's
# text is the anchor's own text, no parent holds a heading, and a page's
# first slug link lies in its <nav>, before the heading's <article>.

_RAW_A = f"""
ra AS (
  SELECT page_id, url, {_base('url')} AS base, unnest(regexp_extract_all(html, {_A}, 1)) AS href0,
         unnest(regexp_extract_all(html, {_A}, 2)) AS inner0,
         unnest(generate_series(1, len(regexp_extract_all(html, {_A}, 1)))) AS ord
  FROM pages),
rb AS (SELECT page_id, url, base, CAST(ord AS INTEGER) AS ord, {_unescape('href0')} AS href,
         {_trim(_unescape("regexp_replace(inner0, '<[^>]*>', '', 'g')"))} AS text FROM ra)
"""

_LOC = ("CASE split_part({h}, '.', -1) WHEN 'com' THEN 'San Francisco, USA' WHEN 'org' THEN 'Berlin, Germany' "
        "WHEN 'net' THEN 'London, UK' ELSE 'Various' END")

SQL["listing_scan"] = f"""
WITH {_RAW_A},
x AS (SELECT * FROM rb WHERE contains(href, '/') AND text <> '')
SELECT text AS name, 'Listing' AS source, '' AS raw_location, base || href AS website,
  concat(page_id, ':', ord) AS ord, '' AS raw_start_date, '' AS raw_end_date
FROM x WHERE NOT {_any('text', ['gnu', 'und'])} AND {_any('text', DOC_KEEP + ['the'])}
"""

SQL["group_scan"] = f"""
WITH {_RAW_A},
x AS (SELECT *, split_part(CASE WHEN starts_with(href, 'http') THEN href ELSE base || href END, '?', 1) AS website
      FROM rb WHERE regexp_matches(href, '^/[A-Za-z]{{5,}}$')),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, website ORDER BY ord) AS rn FROM x) WHERE rn = 1),
z AS (SELECT * FROM y WHERE length(text) >= 5 AND {_any('text', ['e'])}),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY website ORDER BY page_id, ord) AS rn2 FROM z) WHERE rn2 = 1)
SELECT text AS name, 'Groups' AS source, {_LOC.format(h=_host('url'))} AS raw_location, website,
  concat(page_id, ':', ord) AS ord
FROM w
"""

SQL["side_event_scan"] = f"""
WITH {_RAW_A},
x AS (SELECT *, CASE WHEN starts_with(href, 'http') THEN href ELSE base || href END AS website
      FROM rb WHERE href <> '' AND href NOT IN ('#', '/') AND length(text) >= 5),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, website ORDER BY ord) AS rn FROM x) WHERE rn = 1),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY website ORDER BY page_id, ord) AS rn2 FROM y) WHERE rn2 = 1)
SELECT text AS name, 'Side events' AS source, 'Various' AS raw_location, website,
  concat(page_id, ':', ord) AS ord, substring(text, 1, 400) AS card_text
FROM w
"""

SQL["card_scan"] = f"""
WITH {_RAW_A},
t AS (SELECT page_id, url,
        {_trim(_unescape("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))} AS title
      FROM pages),
s AS (SELECT page_id, arg_min(href, ord) AS slug FROM rb WHERE regexp_matches(href, '^/[a-zA-Z0-9_-]{{4,}}$')
      GROUP BY page_id),
x AS (SELECT t.page_id, t.url, t.title, {_base('t.url')} || s.slug AS website FROM t JOIN s ON s.page_id = t.page_id
      WHERE t.title <> '' AND NOT {_any('s.slug', ['/discover', '/signin', '/pricing', '/help', '/app'])}),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY website ORDER BY page_id) AS rn FROM x) WHERE rn = 1)
SELECT title AS name, 'Cards' AS source, {_LOC.format(h=_host('url'))} AS raw_location, website,
  concat(page_id, ':', 1) AS ord
FROM w
"""


# ------------------------------------------- options and plans of operators ----

SQL["rule_table"] = """
WITH rules AS (
  SELECT n_nationkey % 7 AS priority, 'L' || CAST(n_regionkey AS VARCHAR) AS label,
    CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE list_last(string_split(lower(replace(n_name, '_', ' ')), ' ')) END AS needle
  FROM nation),
o AS (SELECT o_orderkey, 'customer ' || CAST(o_custkey AS VARCHAR) AS t FROM orders),
h AS (SELECT o_orderkey, label, row_number() OVER (PARTITION BY o_orderkey ORDER BY priority, label) AS rn
      FROM o JOIN rules ON needle <> '' AND contains(t, needle))
SELECT o.o_orderkey, h.label FROM o LEFT JOIN h ON h.o_orderkey = o.o_orderkey AND h.rn = 1
"""

_VOCABULARY = """
v AS MATERIALIZED (SELECT term, count(*) AS n_texts
  FROM (SELECT item_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) AS term FROM benchmark)
  WHERE length(term) >= 4 GROUP BY term)
"""

SQL["keyword_table"] = f"""
WITH {_VOCABULARY},
t AS (SELECT term FROM v WHERE n_texts = 1 AND length(term) >= 9),
a AS (SELECT DISTINCT doc_id FROM documents JOIN t ON contains(lower(text), term)),
w AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS term FROM documents)
      SEMI JOIN t USING (term))
SELECT doc_id, a.doc_id IS NOT NULL AS anywhere, w.doc_id IS NOT NULL AS as_word
FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN w USING (doc_id)
"""

SQL["rule_vocabulary"] = f"""
WITH {_VOCABULARY},
h AS (SELECT doc_id, arg_min(upper(term), struct_pack(a := n_texts, b := upper(term))) AS label
      FROM documents JOIN v ON contains(lower(text), term) GROUP BY doc_id)
SELECT doc_id, label FROM documents LEFT JOIN h USING (doc_id)
"""

SQL["capped_batch"] = """
SELECT user_id % 3 AS source_rank, event_id AS ord FROM events ORDER BY source_rank, ord LIMIT 80
"""

SQL["demo_fold"] = f"""
WITH {_CLASSIFIED},
f AS (SELECT *, {_first_rule_sql('location', ROUTE_RULES)} AS city,
        coalesce(TRY_CAST(fit_raw AS INTEGER), 0) AS fit_score,
        coalesce(demo_suitable, false) OR coalesce(hint, false) AS is_demo
      FROM cl WHERE event_type = 'meetup'
        AND NOT coalesce({_parse5('start_date')} < DATE '{AS_OF_EVENTS}', false))
SELECT 'Meet-ups' AS sheet, city, is_demo, count(*) AS n FROM f
WHERE city IS NOT NULL AND fit_score >= 0 GROUP BY ALL
"""

SQL["category_rules"] = f"""
SELECT p_partkey, {_first_rule_sql('p_type', CATEGORY_RULES)} AS category FROM part
"""

SQL["registered_sources"] = """
SELECT CAST(CASE event_type WHEN 'click' THEN 1 ELSE 2 END AS BIGINT) AS source_rank, event_type AS source,
  event_type || ' ' || CAST(event_id AS VARCHAR) AS name, CAST(event_id AS VARCHAR) AS ord
FROM events WHERE event_type IN ('click', 'view')
"""

SQL["source_failures"] = """
SELECT CAST(CASE event_type WHEN 'click' THEN 1 ELSE 4 END AS BIGINT) AS source_rank, event_type AS source,
  event_type || ' ' || CAST(event_id AS VARCHAR) AS name
FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT 2, 'failed', 'gone'
UNION ALL SELECT 3, 'failed', 'broken' FROM events WHERE event_type = 'error' HAVING count(*) FILTER (event_id > 100) > 0
UNION ALL SELECT 3, 'error', 'error ' || CAST(event_id AS VARCHAR) FROM events
  WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'error' AND event_id > 100)
"""

SQL["exclusion_load"] = f"""
SELECT DISTINCT 'name' AS kind, {_key('c_name')} AS k FROM customer WHERE c_acctbal < 0 AND {_key('c_name')} IS NOT NULL
"""

SQL["lifecycle_plan"] = f"""
WITH {_LIFE}
SELECT CASE WHEN sheet = 'Conferences' THEN 'migrate' ELSE 'purge' END AS action, sheet,
  CASE WHEN sheet = 'Conferences' THEN 'Time Passed' END AS target, row_id, name
FROM tr WHERE sheet <> 'Time Passed' AND coalesce({_parse5('start_date')} < {AS_O}, false)
"""

SQL["lifecycle_apply"] = f"""
SELECT * FROM ({SQL["migrate_past"]})
WHERE NOT (sheet IN ('Meet-ups', 'SF Product Demos') AND coalesce({_parse5('start_date')} < {AS_O}, false))
"""

SQL["route_plan"] = f"""
WITH r AS ({SQL["city_route"]})
SELECT 'route' AS action, sheet, count(*) AS rows FROM r GROUP BY sheet
"""

SQL["edition_replies"] = f"""
WITH {_LIFE},
pk AS (SELECT row_id, name, lower({_strip_year_sql('name')}) AS base, {_parse5('start_date')} AS pd
       FROM tr WHERE sheet = 'Time Passed'),
c AS (SELECT o_orderkey AS cand_id, lower('Conf ' || CAST(o_custkey AS VARCHAR)) AS base,
        CAST(o_orderdate AS DATE) + INTERVAL 900 DAY AS cd FROM orders
      WHERE o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 0),
f AS (SELECT * FROM c WHERE cd >= {AS_O}),
nd AS (SELECT pk.row_id, min(f.cd) AS nd FROM pk JOIN f USING (base) WHERE pk.pd IS NULL OR f.cd > pk.pd GROUP BY 1),
b AS (SELECT nd.row_id, nd.nd, min(f.cand_id) AS cand_id
      FROM nd JOIN pk USING (row_id) JOIN f ON f.base = pk.base AND f.cd = nd.nd GROUP BY 1, 2)
SELECT b.row_id, {_strip_year_sql('pk.name')} || ' ' || CAST(year({AS_O}) + 1 AS VARCHAR) AS next_name,
  strftime(b.nd, '%b %d, %Y') AS start_date, b.cand_id, 'seen ' || CAST(b.cand_id AS VARCHAR) AS note
FROM b JOIN pk USING (row_id)
"""

SQL["lookup_requests"] = f"""
WITH s AS ({SQL["shortfall"]}),
p AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name, p_brand AS location, p_type AS card_text,
        CASE WHEN p_size % 2 = 0 THEN 'https://p.example' ELSE 'unknown' END AS website FROM part)
SELECT 'classify:' || key AS req_id, 'classify' AS kind, key,
  'Classify | ' || name || ' | Parts | ' || location || ' | unknown | ' || website || ' | ' || card_text AS text FROM p
UNION ALL
SELECT 'edition:' || key, 'edition', key,
  'Next edition | ' || {_strip_year_sql('name')} || ' | after ' || CAST(year({AS_O}) AS VARCHAR) || ' | ' || location || ' | ' || website FROM p
UNION ALL
SELECT 'discover:' || segment, 'discover', segment, 'Find new ' || segment || ' events. Already known:' || chr(10) || '  - A' FROM s
UNION ALL
SELECT 'retry:' || segment, 'retry', segment,
  'Find ' || CAST(short AS VARCHAR) || ' more ' || segment || ' events; search more widely.' FROM s WHERE retry
"""


# ---------------------------------------------------------- streaming ----

def _incremental_sql(weeks: int) -> str:
    """One upsert after the other, a week at a time."""
    parts = [f"""
inc AS (SELECT event_id AS ord, event_type || ' meetup ' || CAST(event_id % 97 AS VARCHAR) AS name,
          'https://ev.example/' || CAST(event_id % 500 AS VARCHAR) AS website,
          {', '.join(f"CAST(NULL AS VARCHAR) AS {c}" for c in _MANAGED if c not in ('location', 'start_date'))},
          'City ' || CAST(user_id % 7 AS VARCHAR) AS location, strftime(CAST(ts AS DATE), '%b %d, %Y') AS start_date,
          CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INTEGER) AS week FROM events),
t0 AS (SELECT 'Meet-ups' AS sheet, CAST(0 AS BIGINT) AS row_id, CAST(0 AS BIGINT) AS row_no, '' AS name,
         {', '.join(f"'' AS {c}" for c in _MANAGED)}, '' AS website, CAST(0 AS BIGINT) AS days, '' AS notes WHERE false)"""]
    for w in range(weeks):
        step = _upsert_sql(f"t{w}", f"inc{w}", f"t{w}", "Meet-ups", False)
        step = re.sub(r"\b(u_\w+|g0|walk|greedy)\b", rf"\1_w{w}", step)
        step = re.sub(r"\barch AS \(", f"t{w + 1} AS (", step)
        parts.append(f"inc{w} AS (SELECT * FROM inc WHERE week = {w})")
        parts.append(step.strip())
    cols = "sheet, row_id, row_no, name, category, cfp_status, start_date, website, days"
    return f"WITH RECURSIVE {', '.join(parts)} SELECT {cols} FROM t{weeks}"


SQL["incremental"] = _incremental_sql(5)

SQL["first_seen"] = f"""
WITH RECURSIVE e AS (
  SELECT event_id AS ord, event_type || ' meetup ' || CAST(event_id % 97 AS VARCHAR) AS name, ts AS scraped_at,
    CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INTEGER) AS week FROM events),
wk AS (SELECT week, max(scraped_at) AS top FROM e GROUP BY week),
wm AS (SELECT week, max(top) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 7 DAY AS mark FROM wk),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(name), week ORDER BY scraped_at, ord) AS rn FROM e),
b AS (SELECT lower(name) AS k, name, ord, scraped_at, week, row_number() OVER (PARTITION BY lower(name) ORDER BY week) AS n
      FROM f WHERE rn = 1),
walk AS (
  SELECT k, n, scraped_at + INTERVAL 7 DAY AS until, true AS kept FROM b WHERE n = 1
  UNION ALL
  SELECT b.k, b.n, CASE WHEN w.until > wm.mark THEN w.until ELSE b.scraped_at + INTERVAL 7 DAY END, NOT (w.until > wm.mark)
  FROM walk w JOIN b ON b.k = w.k AND b.n = w.n + 1 JOIN wm ON wm.week = b.week)
SELECT b.ord, b.name, b.scraped_at FROM b JOIN walk USING (k, n) WHERE walk.kept
"""


# --------------------------------------------------------------- runs ----

def _meetup_run_sql() -> str:
    """The meetup run from its parts: purge, the two sources in rank order,
    scorer, routing and one upsert (no demo is left without the hints)."""
    cal = SQL["ical_scan"].replace("FROM w\n", ", 1 AS source_rank, CAST(feed AS BIGINT) AS o1, CAST(chunk AS BIGINT) AS o2, pos AS o3 FROM w\n")
    disc = SQL["reply_explode"].replace(
        "search_rank AS source_rank, concat(reply_id, ':', pos - 1) AS ord",
        "2 AS source_rank, reply_id AS o1, pos - 1 AS o2, CAST(0 AS BIGINT) AS o3")
    a, b = disc.index("known AS ("), disc.index("c AS (SELECT * FROM p")
    disc = disc[:a] + f"known AS (SELECT DISTINCT {_key('name')} AS k FROM t),\n" + disc[b:]
    cols = "name, source, raw_location, raw_start_date, raw_end_date, website, card_text, source_rank, o1, o2, o3"
    text = "concat_ws(' ', name, card_text)"
    categories = [(c, [c.split(" /")[0].lower()]) for c in CATEGORIES]
    fixed = f"""
x AS (SELECT sheet, row_id, row_no, name, {', '.join(_MANAGED)}, website, days, notes FROM tr
      UNION ALL
      SELECT 'Excluded', 1000000000 + c_custkey, c_custkey + 2, c_name, {', '.join('NULL' for _ in _MANAGED)}, '', NULL, NULL
      FROM customer WHERE c_acctbal < 0),
t AS (SELECT * FROM x WHERE NOT (sheet IN ('Meet-ups', 'SF Product Demos')
                                 AND coalesce({_parse5('start_date')} < DATE '{AS_OF_EVENTS}', false))),
target AS (SELECT * FROM t WHERE sheet = 'Meet-ups'),
raw AS (SELECT {cols} FROM ({cal}) UNION ALL SELECT {cols} FROM ({disc})),
scored AS (SELECT *, {_any("concat_ws(' ', name, source)", ["ical", "meetup", "web discovery"])} AS is_meetup,
             coalesce({_first_rule_sql(text, categories)}, 'Startup / General Tech') AS category,
             coalesce(strftime({_parse5('raw_start_date')}, '%b %d, %Y'), '') AS start_date,
             coalesce(strftime({_parse5('raw_end_date')}, '%b %d, %Y'), '') AS end_date,
             {_first_rule_sql('raw_location', MEETUP_RULES)} AS city
           FROM raw WHERE {_any(text, ["meetup", "click", "view", "signup", "purchase", "error"])}
             AND NOT EXISTS (SELECT 1 FROM x WHERE x.sheet = 'Excluded' AND {_key('x.name')} = {_key('raw.name')})),
inc AS (SELECT row_number() OVER (ORDER BY source_rank, o1, o2, o3) AS ord, name, website, category, '' AS cfp_date,
          'Check site' AS cfp_status, raw_location AS location, start_date, end_date
        FROM scored WHERE is_meetup AND city IS NOT NULL
          AND NOT coalesce({_parse5('start_date')} < DATE '{AS_OF_EVENTS}', false))"""
    out = "sheet, row_id, row_no, name, category, cfp_status, start_date, website, days"
    return f"""
WITH RECURSIVE {_LIFE}, {fixed},
{_upsert_sql('target', 'inc', 't', 'Meet-ups', False)}
SELECT {out} FROM t WHERE sheet <> 'Meet-ups' UNION ALL SELECT {out} FROM arch
"""


SQL["meetup_run"] = _meetup_run_sql()


def _conference_raw_sql() -> str:
    """Raw events of the conference run: seeds, page links, listing rows, echoes
    of the tracker (discovery is added by the caller)."""
    from ..vocab import SEED_EVENTS

    union = SQL["source_union"]
    parts = union[:union.index("SELECT s.source, CAST(1 AS BIGINT)")]
    split = SQL["date_range_split"]
    ends = split[split.index("  CASE WHEN date_raw = '' THEN ''", split.index("AS start_part")):split.index("AS end_part")]
    parts = parts.replace("ELSE dd END AS start_part FROM ls)", f"ELSE dd END AS start_part, {ends} AS end_part FROM ls)")
    more = ", ".join(f"(CAST({i} AS BIGINT), {_lit(cat)}, {_lit(e)})" for i, (_, _, _, _, e, cat, _) in enumerate(SEED_EVENTS, 1))
    first = lambda a, b: f"coalesce(coalesce(nullif({_trim(a)}, ''), nullif({_trim(b)}, '')), '')"
    return parts.rstrip() + f""",
more(ord, category, e) AS (VALUES {more})
SELECT 1 AS source_rank, s.ord AS o1, CAST(0 AS BIGINT) AS o2, s.name, s.source, more.category, s.raw_location, s.raw_start_date,
  more.e AS raw_end_date, s.website, CAST(NULL AS VARCHAR) AS card_text, coalesce(nullif({_trim('s.st')}, ''), pg.ps, 'Check site') AS cfp_status
FROM seeds s JOIN more ON more.ord = s.ord LEFT JOIN pg ON pg.url = s.website
UNION ALL
SELECT 2, page_id, ord, text, 'Pages', NULL,
  CASE split_part({_host('url')}, '.', -1) WHEN 'com' THEN 'San Francisco, USA' WHEN 'org' THEN 'Berlin, Germany'
       WHEN 'net' THEN 'London, UK' ELSE 'Various' END, NULL, NULL, link, text, NULL
FROM links
UNION ALL
SELECT 3, o_orderkey, 0, name, 'Listing', NULL, coalesce(nullif({_trim('location')}, ''), 'Various'),
  {first('start_part', 'date_raw')}, {first('end_part', 'date_raw')}, '', parent_text, NULL
FROM lt
UNION ALL
SELECT 4, o_orderkey, 0, 'Conf ' || CAST(o_custkey AS VARCHAR), 'Echo', NULL, 'City ' || CAST(o_custkey % 9 AS VARCHAR),
  strftime(CAST(o_orderdate AS DATE) + INTERVAL 400 DAY, '%b %d, %Y'), NULL, NULL, 'conf echo', NULL
FROM orders
"""


def _conference_run_sql() -> str:
    """The conference run from its parts: migration, sources in rank order,
    rules, routing, editions, CFP facts, two upserts, refresh."""
    disc = SQL["reply_explode"].replace(
        "search_rank AS source_rank, concat(reply_id, ':', pos - 1) AS ord", "5 AS source_rank, reply_id AS o1, pos - 1 AS o2")
    a, b = disc.index("known AS ("), disc.index("c AS (SELECT * FROM p")
    disc = disc[:a] + f"known AS (SELECT DISTINCT {_key('name')} AS k FROM x),\n" + disc[b:]
    cols = "source_rank, o1, o2, name, source, category, raw_location, raw_start_date, raw_end_date, website, card_text, cfp_status"
    facts = _CFP_IN[_CFP_IN.index("f0 AS ("):]

    def upserted(step: str, name: str, *args) -> str:
        sql = _upsert_sql(*args)
        # of rows with the same keys only the first can be kept
        sql = sql.replace("WHERE match_row_id IS NULL)", "WHERE match_row_id IS NULL QUALIFY row_number() OVER "
                          f"(PARTITION BY {_key('name')}, {_key('website')} ORDER BY ord) = 1)")
        sql = re.sub(r"\b(u_\w+|g0|walk|greedy)\b", rf"\1_{step}", sql)
        return re.sub(r"\barch AS \(", f"{name} AS (", sql).strip()

    def date(e: str) -> str:
        n = f"regexp_replace({_trim(e)}, '\\s+', ' ', 'g')"
        day = lambda k: (f"CASE WHEN regexp_matches({n}, '^[A-Za-z]{{3}} \\d{{1,2}}$') THEN "  # noqa: E731
                         f"CAST(try_strptime({n} || ', ' || CAST(year({AS_O}) + {k} AS VARCHAR), '%b %d, %Y') AS DATE) END")
        return (f"coalesce(strftime(coalesce({_parse5(e)}, CASE WHEN {day(0)} >= {AS_O} THEN {day(0)} "
                f"WHEN {day(1)} < {AS_O} + INTERVAL 12 MONTH THEN {day(1)} END), '%b %d, %Y'), '')")

    text = "concat_ws(' ', name, card_text)"
    categories = [(c, [c.split(" /")[0].lower()]) for c in CATEGORIES]
    row = f"sheet, row_id, row_no, name, {', '.join(_MANAGED)}, website, days, notes"
    out = "sheet, row_id, row_no, name, category, cfp_status, start_date, website, days"
    return f"""
WITH RECURSIVE {_LIFE},
x AS (SELECT {row} FROM tr UNION ALL
      SELECT 'Excluded', 1000000000 + c_custkey, c_custkey + 2, c_name, {', '.join('NULL' for _ in _MANAGED)}, '', NULL, NULL
      FROM customer WHERE c_acctbal < 0),
tgt AS (SELECT * FROM x WHERE sheet = 'Time Passed'),
mv AS (SELECT * FROM x WHERE sheet = 'Conferences' AND coalesce({_parse5('start_date')} < {AS_O}, false)),
ev AS (SELECT CAST(row_no AS BIGINT) AS ord, name, website, {', '.join(f"nullif({_trim(c)}, '') AS {c}" for c in _MANAGED)}, notes FROM mv),
{upserted('m', 'arch0', 'tgt', 'ev', 'x', 'Time Passed', True)},
keys AS (SELECT {_key('name')} AS k FROM arch0 WHERE {_key('name')} IS NOT NULL
         UNION SELECT {_key('website')} FROM arch0 WHERE {_key('website')} IS NOT NULL),
gone AS (SELECT row_id FROM mv WHERE {_key('name')} IN (SELECT k FROM keys) OR {_key('website')} IN (SELECT k FROM keys)),
t1 AS MATERIALIZED (SELECT {row} FROM x WHERE sheet <> 'Time Passed' AND row_id NOT IN (SELECT row_id FROM gone)
       UNION ALL SELECT {row} FROM arch0),
raw AS (SELECT {cols} FROM ({_conference_raw_sql()}) UNION ALL
        SELECT source_rank, o1, o2, name, source, NULL, raw_location, raw_start_date, raw_end_date, website, card_text, cfp_status
        FROM ({disc})),
scored AS (SELECT source_rank, o1, o2, name, website, '' AS cfp_date,
             coalesce(nullif({_trim('category')}, ''), {_first_rule_sql(text, categories)}, 'Startup / General Tech') AS category,
             CASE WHEN coalesce(cfp_status, '') NOT IN ('', 'Check site') THEN cfp_status ELSE 'Check site' END AS cfp_status,
             coalesce(raw_location, '') AS location, {date('raw_start_date')} AS start_date, {date('raw_end_date')} AS end_date
           FROM raw WHERE {_any(text, ["customer", "conf", "summit", "kubecon", "cloud"])}
             AND NOT EXISTS (SELECT 1 FROM x WHERE x.sheet = 'Excluded' AND {_key('x.name')} = {_key('raw.name')})),
routed AS MATERIALIZED (SELECT *, coalesce({_parse5('start_date')} < {AS_O}, false) AS past FROM scored),
pk AS (SELECT row_id, {_strip_year_sql('name')} AS base_name, category, location, website, {_parse5('start_date')} AS pd
       FROM t1 WHERE sheet = 'Time Passed'),
ec AS (SELECT lower({_strip_year_sql("'Conf ' || CAST(o_custkey AS VARCHAR)")}) AS base,
         CAST(o_orderdate AS DATE) + INTERVAL 900 DAY AS cd FROM orders
       WHERE CAST(o_orderdate AS DATE) + INTERVAL 900 DAY >= {AS_O}),
nd AS (SELECT pk.row_id, min(ec.cd) AS nd FROM pk JOIN ec ON ec.base = lower(pk.base_name) WHERE pk.pd IS NULL OR ec.cd > pk.pd GROUP BY 1),
editions AS (SELECT CAST(1099511627776 AS BIGINT) AS source_rank, pk.row_id AS o1, CAST(0 AS BIGINT) AS o2,
               base_name || ' ' || CAST(year({AS_O}) + 1 AS VARCHAR) AS name, website, '' AS cfp_date, coalesce(category, '') AS category,
               'Check site' AS cfp_status, location, strftime(nd.nd, '%b %d, %Y') AS start_date, '' AS end_date
             FROM pk JOIN nd USING (row_id)),
{facts.strip()},
f1 AS (SELECT * EXCLUDE (past) FROM routed WHERE NOT past UNION ALL BY NAME SELECT * FROM editions),
future AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY source_rank, o1, o2) AS ord, f1.name, website, category, location, start_date, end_date,
    CASE WHEN facts.fact_key IS NOT NULL THEN facts.fact_status ELSE f1.cfp_status END AS cfp_status,
    CASE WHEN facts.fact_key IS NOT NULL AND facts.fact_date <> '' THEN facts.fact_date ELSE f1.cfp_date END AS cfp_date
  FROM f1 LEFT JOIN facts ON lower({_trim('f1.name')}) = facts.fact_key),
passed AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY source_rank, o1, o2) AS ord, name, website, category, location, start_date, end_date, cfp_status, cfp_date
  FROM routed WHERE past),
conf AS MATERIALIZED (SELECT * FROM t1 WHERE sheet = 'Conferences'),
{upserted('c', 'conf1', 'conf', 'future', 't1', 'Conferences', False)},
t2 AS MATERIALIZED (SELECT {row} FROM t1 WHERE sheet <> 'Conferences' UNION ALL SELECT {row} FROM conf1),
old AS MATERIALIZED (SELECT * FROM t2 WHERE sheet = 'Time Passed'),
{upserted('a', 'old1', 'old', 'passed', 't2', 'Time Passed', False)},
t3 AS MATERIALIZED (SELECT {row} FROM t2 WHERE sheet <> 'Time Passed' UNION ALL SELECT {row} FROM old1),
pt AS (SELECT t3.row_id, facts.fact_status FROM t3 JOIN facts ON lower({_trim('t3.name')}) = facts.fact_key
       WHERE sheet = 'Conferences' AND NOT coalesce({_parse5('start_date')} < {AS_O}, false) AND (fact_status <> '' OR fact_date <> '')
         AND coalesce(lower({_trim('cfp_status')}), '') IN ('', 'check site', 'not yet announced', 'unknown'))
SELECT {out.replace("cfp_status", "coalesce(nullif(coalesce(pt.fact_status, ''), ''), t3.cfp_status) AS cfp_status").replace("row_id", "t3.row_id")}
FROM t3 LEFT JOIN pt ON pt.row_id = t3.row_id
"""


SQL["conference_run"] = _conference_run_sql()
