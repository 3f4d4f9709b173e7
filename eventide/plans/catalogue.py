"""Query catalogue: each operator of the survey mapped onto the driver tables.

Every query reads whole tables (no id subsets, no row caps) and builds its
inputs from them with expressions, so its work grows with the data. The SQL
twin of each query is in ``oracle.py`` under the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import cfp as C
from ..operators.common import order_key
from ..operators.dedup import first_wins, greedy_two_key
from ..operators.match import block_anti, key_set, known_anti, union_keys
from ..operators.report import known_block
from ..sources import html as H
from ..sources.listing import split_listing
from .tables import (AS_OF_DOCS, AS_OF_EVENTS, AS_OF_ORDERS, DOC_CFP_CLOSED, DOC_CFP_CLOSED_WHEN_OPEN,
                     DOC_CFP_OPEN, DOC_KEEP, DOC_SKIP, load)

Q = {}


def query(fn=None, *, name: str | None = None):
    """Register a query under its function name (or ``name``)."""
    def reg(f):
        Q[name or f.__name__] = f
        return f
    return reg(fn) if fn is not None else reg


# ---------------------------------------------------------------- dates ----

def _render_formats(d, key):
    """One of the five accepted formats, chosen by ``key % 5``."""
    return (F.when(key % 5 == 0, F.date_format(d, "MMM dd, yyyy"))
            .when(key % 5 == 1, F.date_format(d, "MMMM d, yyyy"))
            .when(key % 5 == 2, F.date_format(d, "yyyy-MM-dd"))
            .when(key % 5 == 3, F.date_format(d, "MMM d yyyy"))
            .otherwise(F.date_format(d, "d MMM yyyy")))


@query
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    """F1 over every order date, rendered in the five formats plus junk."""
    o = load(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    k = F.col("o_orderkey")
    raw = _render_formats(F.col("d"), k)
    raw = (F.when(k % 7 == 1, F.upper(raw))
           .when(k % 7 == 2, F.concat(F.lit("  "), raw, F.lit(" ")))
           .when(k % 7 == 3, F.replace(raw, F.lit(" "), F.lit("  ")))
           .when(k % 7 == 4, F.lit("TBC"))
           .when(k % 7 == 5, F.concat(F.date_format("d", "MMM d, "), F.date_format("d", "yy")))
           .otherwise(raw))
    return (o.select("o_orderkey", raw.alias("raw_date"))
            .select("o_orderkey", "raw_date", D.parse_date("raw_date").cast("string").alias("parsed")))


@query
def days_span(spark: SparkSession, sf: str) -> DataFrame:
    """F2 over every line item: ship date .. ship date + (linenumber - 3)."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("s"))
    e = F.date_add("s", F.col("l_linenumber") - 3)
    n = F.col("l_linenumber")
    start = (F.when(n % 3 == 0, F.date_format("s", "MMM dd, yyyy"))
             .when(n % 3 == 1, F.date_format("s", "MMMM d, yyyy"))
             .otherwise(F.date_format("s", "yyyy-MM-dd")))
    k = F.col("l_orderkey")
    end = (F.when(k % 4 == 0, F.date_format(e, "MMM dd, yyyy"))
           .when(k % 4 == 1, F.date_format(e, "yyyy-MM-dd"))
           .when(k % 4 == 2, F.date_format(e, "MMM d yyyy"))
           .otherwise(F.lit("")))
    x = li.select("l_orderkey", "l_linenumber", start.alias("start_date"), end.alias("end_date"))
    return x.withColumn("days", D.days_span("start_date", "end_date").cast("long"))


def _parent_texts(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name")
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    k, d = F.col("o_orderkey"), F.col("d")
    rng = (F.when(k % 5 == 0, F.concat(F.date_format(d, "MMM d"), F.lit("-"),
                                       F.date_format(F.date_add(d, 3), "MMM d")))
           .when(k % 5 == 1, F.concat(F.date_format(d, "MMM d"), F.lit("-"), (F.dayofmonth(d) + 2).cast("string")))
           .when(k % 5 == 2, F.date_format(d, "MMM d"))
           .when(k % 5 == 3, F.concat(F.date_format(d, "MMM d"), F.lit(" - "), (F.dayofmonth(d) + 1).cast("string")))
           .otherwise(F.lit(None)))
    parent = F.concat_ws(" ", rng, F.col("c_name"), F.col("n_name"))
    name = F.when(k % 11 == 0, F.concat(F.col("c_name"), F.lit(" Summit"))).otherwise(F.col("c_name"))
    return x.select("o_orderkey", parent.alias("parent_text"), name.alias("name"))


@query
def date_range_split(spark: SparkSession, sf: str) -> DataFrame:
    """F3 F4 F5 over one listing text per order."""
    return split_listing(_parent_texts(spark, sf)).select(
        "o_orderkey", "parent_text", "name", "date_raw", "start_part", "end_part", "location")


@query
def year_inference(spark: SparkSession, sf: str) -> DataFrame:
    """year of each order's month-day relative to as_of."""
    o = load(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMM d").alias("month_day"))
    return o.withColumn("inferred", D.infer_year("month_day", AS_OF_ORDERS).cast("string"))


def _order_events(spark, sf):
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    start = F.when(k % 7 == 0, F.lit("TBC")).otherwise(F.date_format("o_orderdate", "MMM dd, yyyy"))
    etype = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("conference")).otherwise(F.lit("meetup"))
    return o.select("o_orderkey", start.alias("start_date"), etype.alias("event_type"))


@query
def past_future(spark: SparkSession, sf: str) -> DataFrame:
    """Conferences routed to Conferences / Time Passed."""
    from ..operators.route import route_conferences

    ev = _order_events(spark, sf)
    d = D.parse_date("start_date")
    ev = ev.withColumn("is_past", D.is_past(d, AS_OF_ORDERS)).withColumn("is_future", D.is_future(d, AS_OF_ORDERS))
    return route_conferences(ev, AS_OF_ORDERS).select("o_orderkey", "start_date", "is_past", "is_future", "sheet")


@query
def lookahead(spark: SparkSession, sf: str) -> DataFrame:
    """P5: orders starting within 180 days of as_of, filter pushed to the scan."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    o = D.timestamp_day_range(o, "o_orderdate", AS_OF_ORDERS, 180)
    return o.select("o_orderkey", D.fmt_date(F.to_date("o_orderdate")).alias("raw_start_date"))


@query
def calendar_gates(spark: SparkSession, sf: str) -> DataFrame:
    """F10 F11 F12 per event day (forced off: the calendar decides)."""
    e = load(spark, sf, "events").select(F.to_date("ts").alias("d"))
    g = e.groupBy("d").agg(F.count("*").cast("long").alias("n_events"))
    return g.select(F.col("d").cast("string").alias("day"), "n_events",
                    D.first_run_of_month("d").alias("first_run"), D.odd_iso_week("d").alias("odd_week"),
                    D.gate(D.first_run_of_month("d")).alias("run_next_edition"),
                    D.gate(D.odd_iso_week("d")).alias("run_cfp_search"))


# ------------------------------------------------------------ keywords ----

@query
def keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose lower-cased text holds any keep term (substring)."""
    d = load(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return d.where(X.contains_any("text", DOC_KEEP)).select("doc_id", "source", "lang")


@query
def keep_skip_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Skip terms take precedence over keep terms."""
    d = load(spark, sf, "documents").select("doc_id", "source", "text")
    return d.where(X.keep_skip("text", DOC_KEEP, DOC_SKIP)).select("doc_id", "source")


@query
def cfp_state(spark: SparkSession, sf: str) -> DataFrame:
    """Phrase state of each document, then the past-deadline rule."""
    d = load(spark, sf, "documents").select("doc_id", "text")
    deadline = D.fmt_date(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 400).cast("int")))
    x = d.select("doc_id", C.cfp_text_state("text", DOC_CFP_OPEN, DOC_CFP_CLOSED_WHEN_OPEN,
                                             DOC_CFP_CLOSED).alias("page_state"), deadline.alias("deadline"))
    return x.withColumn("cfp_status", C.cfp_sanity("page_state", "deadline", AS_OF_DOCS))


# --------------------------------------------------------------- pages ----

def page_links_df(spark, sf) -> DataFrame:
    pages = load(spark, sf, "pages").select("page_id", "url", "html")
    a = H.anchors(pages).withColumn("base", H.page_base(F.col("url")))
    a = H.link_candidates(a)
    a = first_wins(a, ["page_id", "link"], ["page_id", "ord"])            # W3, before the name test
    return a.where(F.length("text") >= 5)                                  # P3


@query
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links per page, absolute, query cut,
    first-wins per page by URL, then a minimum name length."""
    return page_links_df(spark, sf).select("page_id", "ord", "link", "text")


@query
def link_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """First-wins by URL across pages (page order, then document order)."""
    a = page_links_df(spark, sf)
    return first_wins(a, ["link"], ["page_id", "ord"]).select("link", "page_id", "ord", "text")


@query
def page_title_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Page heading + first slug link of the page; first-wins by title
    across pages."""
    pages = load(spark, sf, "pages").select("page_id", "url", "html")
    t = H.headings_native(pages).where(F.col("title") != "")
    a = H.anchors(pages).where(F.col("href").rlike(r"^/[a-zA-Z0-9_-]{4,}$"))
    first_slug = a.groupBy("page_id").agg(F.min_by("href", "ord").alias("slug"))
    x = t.join(first_slug, "page_id").withColumn(
        "card_link", F.concat(H.page_base(F.col("url")), F.col("slug")))
    return first_wins(x, ["title"], ["page_id"]).select("page_id", "title", "card_link")


def registry_df(pages: DataFrame) -> DataFrame:
    """One registry row per page host: label and default location."""
    h = pages.select(H.page_host(F.col("url")).alias("host")).distinct()
    tld = F.substring_index("host", ".", -1)
    loc = (F.when(tld == "com", F.lit("San Francisco, USA")).when(tld == "org", F.lit("Berlin, Germany"))
           .when(tld == "net", F.lit("London, UK")).otherwise(F.lit("Various")))
    return h.select("host", F.substring_index("host", ".", 1).alias("label"), loc.alias("default_location"))


@query
def source_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Pages joined to the registry by host, with the page's CFP state."""
    pages = load(spark, sf, "pages").select("page_id", "url", "html")
    reg = registry_df(pages)
    p = pages.select("page_id", H.page_host(F.col("url")).alias("host"),
                     C.cfp_text_state("html", DOC_CFP_OPEN + ["cfp is open"], DOC_CFP_CLOSED_WHEN_OPEN,
                                      DOC_CFP_CLOSED).alias("cfp_status"))
    return p.join(reg, "host").select("page_id", "host", "label", "default_location", "cfp_status")


# ----------------------------------------------------------- matching ----

def part_events(spark, sf) -> DataFrame:
    """Raw events from ``part``: name = part name + type, URL by brand/size."""
    p = load(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type")).alias("name"),
        F.concat(F.lit("https://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))),
                 F.lit(".example.com/"), F.col("p_size").cast("string")).alias("website"),
        "p_size", "p_brand")


@query
def exclude_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Events blocked by the Excluded table (p_size < 5) by name OR URL;
    the excluded rows carry padded / upper-cased text to exercise the key."""
    ev = part_events(spark, sf)
    excl = ev.where(F.col("p_size") < 5).select(
        F.concat(F.lit("  "), F.upper("name"), F.lit("\t")).alias("name"),
        F.when(F.col("ord") % 3 == 0, F.lit("")).otherwise(F.upper("website")).alias("website"))
    out = block_anti(ev, "name", "website",
                     key_set(excl, "name"), key_set(excl, "website"))
    return out.select("ord", "name", "website")


def tracker_names(spark, sf) -> DataFrame:
    """Four named tables of ``part`` rows (by p_size band), names with brand."""
    p = load(spark, sf, "part")
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"))
    sheet = (F.when(F.col("p_size") <= 3, F.lit("Conferences")).when(F.col("p_size") <= 6, F.lit("Time Passed"))
             .when(F.col("p_size") <= 8, F.lit("Meet-ups")).when(F.col("p_size") <= 9, F.lit("SF Product Demos")))
    return p.select(sheet.alias("sheet"), name.alias("name")).where(F.col("sheet").isNotNull())


@query(name="known_anti")
def known_anti_q(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates (all parts) not named in any of four tables,
    first seen per name key."""
    t = tracker_names(spark, sf)
    known = union_keys(*[key_set(t.where(F.col("sheet") == s), "name")
                         for s in ("Conferences", "Time Passed", "Meet-ups", "SF Product Demos")])
    p = load(spark, sf, "part")
    cand = p.select(F.col("p_partkey").alias("ord"),
                    F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("name"))
    cand = known_anti(cand, "name", known)
    return first_wins(cand.withColumn("_k", X.norm_key("name")), ["_k"], ["ord"]).select("ord", "name")


@query
def known_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """known_anti with the four tables' keys sketched, saved, merged
    and tested map-side; only probable hits are joined."""
    from ..operators import keysketch as S
    from ..session import scratch_path

    t = tracker_names(spark, sf)
    sets = [key_set(t.where(F.col("sheet") == s), "name") for s in ("Conferences", "Time Passed", "Meet-ups", "SF Product Demos")]
    known = union_keys(*sets)
    n_bits = S.bits_for(t.count())
    path = scratch_path(spark, "sketch")
    S.save_sketch(S.merged(*[S.sketch(k, n_bits) for k in sets]), n_bits, path)
    cand = load(spark, sf, "part").select(F.col("p_partkey").alias("ord"),
                                          F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("name"))
    cand = known_anti(cand, "name", known, S.load_sketch(spark, path))
    return first_wins(cand.withColumn("_k", X.norm_key("name")), ["_k"], ["ord"]).select("ord", "name")


@query
def wide_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of each source and language that opens with the
    same word, whole rows fetched after the reduction."""
    d = load(spark, sf, "documents")
    word = F.lower(F.regexp_extract("text", r"^\W*(\w*)", 1))
    return first_wins(d, ["source", "lang", word], ["doc_id"], late=True)


@query
def text_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Match key of the whole padded text, lenient flag,
    400-char card text (the reference's card budget)."""
    d = load(spark, sf, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    pad = (F.when(k % 3 == 0, F.lit("\t ")).when(k % 3 == 1, F.lit("\n")).otherwise(F.lit("")))
    padded = F.concat(pad, F.col("text"), F.lit("  "), pad)
    flag = (F.when(k % 6 == 0, F.lit(" Yes ")).when(k % 6 == 1, F.lit("off")).when(k % 6 == 2, F.lit(""))
            .when(k % 6 == 3, F.lit("ON")).when(k % 6 == 4, F.lit("maybe")).otherwise(F.lit("1")))
    return d.select("doc_id", X.norm_key(padded).alias("key"), X.lenient_flag(flag, True).alias("flag"),
                    X.truncate("text", 400).alias("card_text"))


@query(name="known_block")
def known_block_q(spark: SparkSession, sf: str) -> DataFrame:
    """Known names of two tables as a bounded prompt block."""
    p = load(spark, sf, "part").select(X.norm_key("p_name").alias("name"))
    c = load(spark, sf, "customer").select(X.norm_key("c_name").alias("name"))
    return known_block(p.unionByName(c), "name")


@query
def greedy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """W5 over the whole part table: name = p_name, URL = brand + type."""
    p = load(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"),
        F.concat(F.lit("https://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".example/"),
                 F.lower("p_type")).alias("website"))
    return greedy_two_key(p, "name", "website", "ord").select("ord", "name", "website")


# ----------------------------------------------------------- flagship ----

@query
def host_links(spark: SparkSession, sf: str) -> DataFrame:
    """Minimum slice: page links, first-wins by URL across pages, keyword
    filter, anti join against the known URLs (the pages' own addresses),
    links per host."""
    pages = load(spark, sf, "pages").select("page_id", "url")
    links = first_wins(page_links_df(spark, sf), ["link"], ["page_id", "ord"])
    links = links.where(~X.contains_any("text", ["nav", "menu"]))
    known = key_set(pages.select(X.cut_query("url").alias("u")), "u")
    k = known.select(F.col("key").alias("_known"))
    links = links.join(k, X.norm_key("link") == F.col("_known"), "left_anti")
    return (links.select(H.page_host(F.col("link")).alias("host"))
            .groupBy("host").agg(F.count("*").cast("long").alias("n_links")))


# ------------------------------------------------------------- upsert ----

def _dfmt(days_expr):
    """'MMM dd, yyyy' of 2026-01-01 + n days."""
    return D.fmt_date(F.date_add(F.to_date(F.lit("2026-01-01")), days_expr.cast("int")))


def upsert_inputs(spark, sf):
    """Existing Conferences rows = even part keys, incoming = odd part keys."""
    from ..operators.upsert import conform_tracker

    p = load(spark, sf, "part")
    sz = F.col("p_size")
    url = lambda off: F.concat(F.lit("https://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))),
                               F.lit(".example/"), (sz + off).cast("string"))
    ex = p.where(F.col("p_partkey") % 2 == 0).select(
        F.lit("Conferences").alias("sheet"), F.col("p_partkey").alias("row_id"),
        (F.col("p_partkey") / 2 + 2).cast("long").alias("row_no"),
        F.col("p_name").alias("name"), F.col("p_type").alias("category"),
        F.lit("").alias("cfp_date"), F.when(sz % 4 == 0, F.lit("Open")).otherwise(F.lit("")).alias("cfp_status"),
        F.concat(F.lit("Loc "), (sz % 10).cast("string")).alias("location"),
        _dfmt(sz).alias("start_date"), _dfmt(sz + 2).alias("end_date"), url(0).alias("website"),
        F.lit(3).alias("days"), F.concat(F.lit("note "), F.col("p_partkey").cast("string")).alias("notes"))
    ex = conform_tracker(ex)
    inc = p.where(F.col("p_partkey") % 2 == 1).select(
        F.col("p_partkey").alias("ord"),
        F.when(sz % 3 == 0, F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")))
         .when(sz % 3 == 1, F.concat(F.lit(" "), F.upper("p_name")))
         .otherwise(F.col("p_name")).alias("name"),
        F.when(sz % 5 == 0, F.lit("")).otherwise(url(1)).alias("website"),
        F.when(sz % 4 == 0, F.lit("")).otherwise(F.col("p_type")).alias("category"),
        F.lit("").alias("cfp_date"),
        F.when(sz % 3 == 0, F.lit("Open")).when(sz % 3 == 1, F.lit("")).otherwise(F.lit("Check site")).alias("cfp_status"),
        F.concat(F.lit("Loc "), (sz % 7).cast("string")).alias("location"),
        _dfmt(sz % 20).alias("start_date"),
        F.when(sz % 2 == 0, _dfmt(sz % 20 + 3)).otherwise(F.lit("")).alias("end_date"))
    return ex, inc


@query
def upsert_match(spark: SparkSession, sf: str) -> DataFrame:
    """Existing row each incoming row updates (name first, then URL)."""
    from ..operators.match import match_existing

    ex, inc = upsert_inputs(spark, sf)
    return match_existing(inc, ex).select("ord", "match_row_id", "match_by")


_SNAP_COLS = ["sheet", "row_id", "row_no", "name", "category", "cfp_date", "cfp_status", "location",
              "start_date", "end_date", "website", "days", "notes"]


@query
def upsert_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The Conferences table after the upsert."""
    from ..operators.upsert import upsert

    ex, inc = upsert_inputs(spark, sf)
    snap = upsert(ex, inc, "Conferences").snapshot
    return snap.select(*_SNAP_COLS).withColumn("days", F.col("days").cast("long"))


@query
def change_plan(spark: SparkSession, sf: str) -> DataFrame:
    """K8: the changes the upsert would make, without applying them."""
    from ..operators.upsert import upsert

    ex, inc = upsert_inputs(spark, sf)
    return upsert(ex, inc, "Conferences").changes


@query
def plan_apply(spark: SparkSession, sf: str) -> DataFrame:
    """K8: the upsert's plan, stored and applied by a call of its own."""
    from ..operators.upsert import apply_changes, upsert
    from ..session import write_table

    ex, inc = upsert_inputs(spark, sf)
    plan = write_table(upsert(ex, inc, "Conferences").plan, "plan")
    return apply_changes(ex, plan).select(*_SNAP_COLS).withColumn("days", F.col("days").cast("long"))


@query
def upsert_counts(spark: SparkSession, sf: str) -> DataFrame:
    """K1 return values: rows added, inputs that updated a row."""
    from ..operators.upsert import upsert

    ex, inc = upsert_inputs(spark, sf)
    return upsert(ex, inc, "Conferences").counts


# -------------------------------------------------------------- route ----

def classified_events(spark, sf):
    """Classified rows from events: location from customer/nation/region,
    score from props.k, demo flag from value, hint on some rows."""
    e = load(spark, sf, "events")
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = load(spark, sf, "region").select("r_regionkey", "r_name")
    x = (e.join(c, e.user_id == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    k = F.col("event_id")
    return x.select(
        "event_id", F.col("event_id").alias("ord"),
        F.when(F.col("event_type").isin("click", "view", "signup"), F.lit("meetup"))
         .otherwise(F.lit("conference")).alias("event_type"),
        F.concat(F.col("event_type"), F.lit(" "), k.cast("string")).alias("name"),
        F.concat_ws(", ", "c_name", "n_name", "r_name").alias("location"),
        D.fmt_date(F.to_date("ts")).alias("start_date"),
        F.get_json_object("props", "$.k").alias("fit_score"),
        (F.col("value") > 50).alias("demo_suitable"),
        F.when(k % 4 == 0, F.lit(True)).when(k % 4 == 1, F.lit(None)).otherwise(F.lit(False))
         .cast("boolean").alias("hint_demo_suitable"))


@query
def city_route(spark: SparkSession, sf: str) -> DataFrame:
    """Future meetups routed by first matching city rule."""
    from ..operators.route import route_meetups
    from .tables import AS_OF_EVENTS as A, ROUTE_RULES

    ev = classified_events(spark, sf)
    out = route_meetups(ev, A, ROUTE_RULES)
    return out.select("event_id", "city", F.col("fit_score").cast("long"), "is_demo", "sheet")


# ------------------------------------------------------------ replies ----

def replies_df(spark, sf, truncate_odd: bool = False) -> DataFrame:
    """One reply per (user, block of 64 event ids): the events as a JSON
    ``events`` array wrapped in prose, fenced on even replies. With
    ``truncate_odd`` the odd replies are cut inside their last item's name."""
    e = load(spark, sf, "events")
    k = F.col("event_id")
    rank = (F.col("user_id") % 3).cast("int")
    name = F.when(k % 13 == 0, F.lit("")).otherwise(
        F.concat(F.col("event_type"), F.lit(" meetup "), (k % 97).cast("string")))
    item = F.struct(name.alias("name"),
                    F.concat(F.lit("City "), (F.col("user_id") % 7).cast("string")).alias("location"),
                    D.fmt_date(F.to_date("ts")).alias("start_date"),
                    F.concat(F.lit("https://ev.example/"), k.cast("string")).alias("website"),
                    F.col("event_type").alias("why_relevant"),
                    F.when(rank == 2, F.col("value") > 50).alias("demo_suitable"))
    x = e.select((F.shiftleft("user_id", 32) + F.floor(k / 64)).cast("long").alias("reply_id"),
                 rank.alias("search_rank"), k, F.to_json(item).alias("j"), name.alias("_n"))
    g = x.groupBy("reply_id", "search_rank").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "j", "_n"))).alias("items"))
    full = F.concat(F.lit('{"events":['), F.array_join(F.transform("items", lambda i: i["j"]), ","), F.lit("]}"))
    if truncate_odd:
        head = F.slice("items", 1, F.size("items") - 1)
        last = F.element_at("items", -1)
        cut = F.concat(F.lit('{"events":['), F.array_join(F.transform(head, lambda i: i["j"]), ","),
                       F.when(F.size("items") > 1, F.lit(",")).otherwise(F.lit("")),
                       F.lit('{"name":"'), F.substring(last["_n"], 1, 2))
        body = F.when(F.col("reply_id") % 2 == 1, cut).otherwise(full)
    else:
        body = full
    text = F.when(F.col("reply_id") % 2 == 0,
                  F.concat(F.lit("Results:\n```json\n"), body, F.lit("\n```\nDone.")))\
        .otherwise(F.concat(F.lit("Here is what I found: "), body))
    label = (F.when(F.col("search_rank") == 0, F.lit("CFP-open conference"))
             .when(F.col("search_rank") == 1, F.lit("ticketed conference")).otherwise(F.lit("meetup/Berlin")))
    return g.select("reply_id", F.lit("discovery").alias("kind"), "search_rank", label.alias("label"),
                    text.alias("text"))


def known_event_names(spark, sf) -> DataFrame:
    """Names already tracked: those of high-value events."""
    e = load(spark, sf, "events").where(F.col("value") > 140)
    k = F.col("event_id")
    return key_set(e.select(F.concat(F.col("event_type"), F.lit(" meetup "), (k % 97).cast("string")).alias("n")), "n")


# An order key as text, for results that are compared with SQL.
_ORD_TEXT = "array_join(cast(ord as array<string>), ':') as ord"
_DISC_COLS = ["name", "source", "raw_location", "raw_start_date", "raw_end_date", "website", "card_text",
              "cfp_status", "cfp_date", "hint_demo_suitable", "source_rank", _ORD_TEXT]


@query
def reply_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Discovery replies -> new raw events."""
    from ..sources.replies import discovered_events

    return discovered_events(replies_df(spark, sf), known_event_names(spark, sf)).selectExpr(*_DISC_COLS)


@query
def reply_repair(spark: SparkSession, sf: str) -> DataFrame:
    """the same replies with odd ones cut mid-item; salvaged items kept."""
    from ..sources.replies import discovered_events

    return discovered_events(replies_df(spark, sf, truncate_odd=True),
                             known_event_names(spark, sf)).selectExpr(*_DISC_COLS)


# ----------------------------------------------------------- patterns ----

def labelled_docs(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text", "lang")
    lab = load(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select("doc_id", "text", F.col("lang").alias("category"),
                                        F.col("quality").alias("label"))


@query
def learn_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """A3: reject / prefer terms per language from labelled documents."""
    from ..operators.patterns import learn_signals

    return learn_signals(labelled_docs(spark, sf), min_support=5, top_k=10).select(
        "category", "side", F.col("rank").cast("long"), "term", "weight", "neg_df", "pos_df")


@query
def reject_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """A3: sets of reject words that rejected documents of a language share."""
    from ..operators.patterns import learn_signals, reject_patterns as patterns
    from ..session import cut_lineage

    docs = labelled_docs(spark, sf)
    signals = cut_lineage(learn_signals(docs, min_support=40, top_k=12))
    return patterns(docs, signals, min_support=3, top_k=20).select(
        "category", F.col("rank").cast("long"), "pattern", F.size("signals").cast("long").alias("n_words"), "weight",
        "neg_df", "pos_df")


def _length_model():
    """A user's model, loaded by a worker: fit by the share of long words; it
    raises on texts that it cannot read."""
    def model(rows):
        import pandas as pd

        if rows["text"].str.contains("|", regex=False).any():
            raise ValueError("bars")
        words = rows["text"].str.split()
        fit = words.map(lambda ws: 100 * sum(len(w) >= 6 for w in ws) // max(1, len(ws)))
        return pd.DataFrame({"relevant": fit >= 30, "fit_score": fit})

    return model


@query
def scorer_udf(spark: SparkSession, sf: str) -> DataFrame:
    """M1 M2: documents scored by a user's model in Arrow batches; rows that it
    raises on are failed, and the batch goes on."""
    from ..operators.classify import classify_batch, model_scorer

    d = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("name"),
                                            F.lit("").alias("website"))
    empty = key_set(d.where(F.lit(False)), "name")
    scorer = model_scorer(_length_model, ["text"], "relevant boolean, fit_score int")
    _, _, scored = classify_batch(d, scorer, empty, empty)
    return scored.select("doc_id", "outcome", F.col("fit_score").cast("long").alias("fit_score"), "score_error")


@query
def observed_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A2 in flight: the outcome counts of scorer_udf, gathered by the job that
    writes the scored documents."""
    from pyspark.sql import Observation

    from ..operators.classify import classify_batch, model_scorer
    from ..session import write_table

    d = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("name"),
                                            F.lit("").alias("website"))
    empty = key_set(d.where(F.lit(False)), "name")
    seen = Observation("outcomes")
    scorer = model_scorer(_length_model, ["text"], "relevant boolean, fit_score int")
    write_table(classify_batch(d, scorer, empty, empty, observation=seen)[2], "scored")
    return spark.createDataFrame([(k, n or 0) for k, n in seen.get.items()], "outcome string, n long")


@query
def signal_score(spark: SparkSession, sf: str) -> DataFrame:
    """Every document scored with the learned signals after
    the exact block (exact copies of a toxic document, keyed by a hash of the
    whole text)."""
    from ..operators.classify import classify_batch, native_scorer
    from ..operators.patterns import learn_signals

    sig = learn_signals(labelled_docs(spark, sf), min_support=5, top_k=10)
    # integer micro-weights: sums are exact whatever the summation order
    sig = sig.withColumn("weight", (F.round(F.col("weight") * 1_000_000)).cast("long"))
    d = load(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("category"),
                                            F.sha2("text", 256).alias("name"), F.lit("").alias("website"))
    lab = load(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")
    toxic_names = key_set(d.join(lab, "doc_id").select("name"), "name")
    empty = key_set(d.where(F.lit(False)).select("website"), "website")

    def scorer(df):
        out = native_scorer(sig, "doc_id", "text", "category", scale=1e-5)(df)
        return out.withColumn("evidence", F.col("evidence").cast("long"))

    relevant, blocked, scored = classify_batch(d, scorer, toxic_names, empty)
    a = scored.select("doc_id", F.col("evidence").alias("evidence_micro"), "n_signals", "fit_score", "outcome")
    b = blocked.select("doc_id", F.lit(None).cast("long").alias("evidence_micro"),
                       F.lit(None).cast("long").alias("n_signals"), F.lit(None).cast("int").alias("fit_score"),
                       "outcome")
    return a.unionByName(b).withColumn("fit_score", F.col("fit_score").cast("long"))


# ----------------------------------------------------------- editions ----

def edition_inputs(spark, sf):
    """Archived rows from part (name with a 20xx year), edition candidates
    from lineitem x part (one lookup result per line item)."""
    p = load(spark, sf, "part")
    sz = F.col("p_size")
    past = p.select(
        F.col("p_partkey").alias("row_id"),
        F.concat(F.col("p_name"), F.lit(" "), (F.lit(2000) + sz % 5).cast("string")).alias("name"),
        F.when(sz % 9 == 0, F.lit("")).otherwise(
            D.fmt_date(F.date_add(F.to_date(F.lit("1995-01-10")), (sz * 30).cast("int")))).alias("start_date"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("City "), F.col("p_brand")).alias("location"),
        F.concat(F.lit("https://past.example/"), F.col("p_partkey").cast("string")).alias("website"))
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                           "l_returnflag", "l_shipdate")
    pn = p.select("p_partkey", "p_name")
    x = li.join(pn, li.l_partkey == pn.p_partkey)
    ln = F.col("l_linenumber")
    cand = x.select(
        (F.col("l_orderkey") * 8 + ln).cast("long").alias("cand_id"),
        F.col("p_name").alias("base_name"),
        F.when(ln == 2, F.lit("")).otherwise(
            F.concat(F.col("p_name"), F.lit(" "), F.year("l_shipdate").cast("string"), F.lit(" edition"))).alias("name"),
        F.when(ln == 5, F.lit("")).otherwise(D.fmt_date(F.to_date("l_shipdate"))).alias("start_date"),
        D.fmt_date(F.date_add(F.to_date("l_shipdate"), 2)).alias("end_date"),
        F.when(ln == 3, F.lit("")).otherwise(F.concat(F.lit("Loc "), F.col("l_suppkey").cast("string"))).alias("location"),
        F.when(ln == 4, F.lit("")).otherwise(
            F.concat(F.lit("https://next.example/"), F.col("l_orderkey").cast("string"))).alias("website"),
        F.when(ln % 4 == 0, F.lit("low")).when(ln % 4 == 1, F.lit("medium")).otherwise(F.lit("high")).alias("confidence"),
        (F.col("l_returnflag") != "R").alias("future_edition_found"),
        F.lit("").alias("evidence"))
    return past, cand


@query
def edition_link(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest later, not-past, not-low edition per archived row."""
    from ..operators.editions import next_editions

    past, cand = edition_inputs(spark, sf)
    return next_editions(past, cand, AS_OF_ORDERS).select(
        "row_id", "next_name", "category", "location", "start_date", "end_date", "website", "cand_id")


# ---------------------------------------------------------------- cfp ----

def cfp_tracker(spark, sf):
    """Conferences rows from orders with a spread of CFP statuses."""
    from ..operators.upsert import conform_tracker

    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    status = (F.when(k % 8 == 0, F.lit("")).when(k % 8 == 1, F.lit(" Check Site ")).when(k % 8 == 2, F.lit("Unknown"))
              .when(k % 8 == 3, F.lit("not yet announced")).when(k % 8 == 4, F.lit("Open"))
              .when(k % 8 == 5, F.lit("Closed")).when(k % 8 == 6, F.lit("—")))
    t = o.select(F.lit("Conferences").alias("sheet"), k.alias("row_id"), (k + 2).cast("long").alias("row_no"),
                 F.concat(F.lit("Conf "), k.cast("string")).alias("name"),
                 F.when(k % 10 == 0, F.lit("TBC")).otherwise(D.fmt_date(F.to_date("o_orderdate"))).alias("start_date"),
                 status.alias("cfp_status"), F.lit("").alias("cfp_date"))
    return conform_tracker(t)


def cfp_fact_rows(spark, sf):
    """Lookup results keyed by event name: orders above a price."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("Conf "), k.cast("string")).alias("key"), k.alias("ord"),
                    F.when(F.col("o_orderstatus") == "F", F.lit("Open"))
                     .when(F.col("o_orderstatus") == "O", F.lit("Closed")).alias("cfp_status"),
                    F.when(k % 3 == 0, F.lit("")).otherwise(
                        D.fmt_date(F.date_add(F.to_date("o_orderdate"), 30))).alias("cfp_deadline"),
                    F.lit("").alias("cfp_url"))


@query
def cfp_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Re-checkable rows patched with new CFP facts."""
    from ..operators.upsert import patch_cfp

    t = cfp_tracker(spark, sf)
    facts = C.facts_from_lookups(cfp_fact_rows(spark, sf), AS_OF_ORDERS)
    patches = C.refresh_patches(C.refresh_candidates(t, AS_OF_ORDERS), facts)
    patched = patch_cfp(t, patches)
    return patched.join(patches.select("row_id"), "row_id", "left_semi").select("row_id", "cfp_date", "cfp_status")


@query
def cfp_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """Source status beats the model's unless empty / Check site;
    then CFP facts replace the status (and the date when they have one)."""
    t = cfp_tracker(spark, sf).select("row_id", "name", "cfp_status", "cfp_date")
    ev = t.withColumn("cfp_status", C.cfp_precedence(F.col("cfp_status"), F.lit("Open")))
    facts = C.facts_from_lookups(cfp_fact_rows(spark, sf), AS_OF_ORDERS)
    return C.enrich(ev, facts).select("row_id", "cfp_status", "cfp_date")


# ---------------------------------------------------------- lifecycle ----

def lifecycle_tracker(spark, sf):
    """Tracker over orders: F -> Time Passed, O -> Conferences, P -> Meet-ups
    or SF Product Demos; names by customer so archive matches happen."""
    from ..operators.upsert import conform_tracker

    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    sheet = (F.when(F.col("o_orderstatus") == "F", F.lit("Time Passed"))
             .when(F.col("o_orderstatus") == "O", F.lit("Conferences"))
             .when(k % 2 == 0, F.lit("Meet-ups")).otherwise(F.lit("SF Product Demos")))
    t = o.select(sheet.alias("sheet"), k.alias("row_id"), (k + 2).cast("long").alias("row_no"),
                 F.concat(F.lit("Conf "), F.col("o_custkey").cast("string")).alias("name"),
                 F.col("o_orderpriority").alias("category"),
                 F.when(k % 10 == 0, F.lit("TBC")).otherwise(D.fmt_date(F.to_date("o_orderdate"))).alias("start_date"),
                 F.concat(F.lit("https://c.example/"), k.cast("string")).alias("website"),
                 F.concat(F.lit("n"), k.cast("string")).alias("notes"))
    return conform_tracker(t)


_LIFE_COLS = ["sheet", "row_id", "row_no", "name", "category", "start_date", "website", "days", "notes"]


@query
def migrate_past(spark: SparkSession, sf: str) -> DataFrame:
    """K6 K4: past Conferences rows upserted into Time Passed (manual
    columns kept) and removed from Conferences."""
    from ..operators.lifecycle import migrate_past as migrate

    res = migrate(lifecycle_tracker(spark, sf), AS_OF_ORDERS)
    return res.tracker.select(*_LIFE_COLS).withColumn("days", F.col("days").cast("long"))


@query
def purge_past(spark: SparkSession, sf: str) -> DataFrame:
    """K7: past rows of the two short-lived tables dropped."""
    from ..operators.lifecycle import purge_past as purge

    return purge(lifecycle_tracker(spark, sf), AS_OF_ORDERS).select("sheet", "row_id", "start_date")


# ------------------------------------------------------------ reports ----

@query
def shortfall(spark: SparkSession, sf: str) -> DataFrame:
    """A5 M7: new candidates per segment against targets; retry flag."""
    from ..operators.report import per_city_target, run_target, shortfall as short

    e = load(spark, sf, "events")
    found = e.groupBy(F.col("event_type").alias("segment")).agg(F.count("*").cast("long").alias("found"))
    targets = spark.createDataFrame(
        [("click", 3000), ("view", run_target(True)), ("signup", run_target(False)),
         ("purchase", run_target(False)), ("error", run_target(False)), ("per_city", per_city_target())],
        "segment string, wanted long")
    return short(found, targets)


@query
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A2: outcome counts per source with rollup totals."""
    from ..operators.report import run_metrics as metrics

    d = load(spark, sf, "documents").select("doc_id", "source")
    lab = load(spark, sf, "labels")
    x = d.join(lab, "doc_id", "left")
    outcome = (F.when(F.col("toxic") == 1, F.lit("blocked")).when(F.col("quality") == 1, F.lit("relevant"))
               .when(F.col("quality") == 0, F.lit("rejected")).otherwise(F.lit("failed")))
    return metrics(x.select("source", outcome.alias("outcome")))


@query
def digest(spark: SparkSession, sf: str) -> DataFrame:
    """Per bucket the count and the first six formatted lines."""
    from ..operators.report import digest as dg

    e = load(spark, sf, "events").select("event_id", "ts", "event_type", "user_id")
    line = F.format_string("  • <%s|%s> — %s, %s",
                           F.concat(F.lit("https://ev.example/"), F.col("event_id").cast("string")),
                           F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")),
                           D.fmt_date(F.to_date("ts")),
                           F.concat(F.lit("City "), (F.col("user_id") % 7).cast("string")))
    return dg(e, "event_type", ["ts", "event_id"], line, 6)


# -------------------------------------------------------------- sheet ----

def sheet_rows_df(spark, sf) -> DataFrame:
    """customer rendered as spreadsheet cells under a header row: sheet A
    (even keys) and sheet B (odd keys, other column order, a duplicate
    header); short rows, surplus cells, padded and empty names."""
    c = load(spark, sf, "customer")
    k = F.col("c_custkey")
    name = (F.when(k % 9 == 0, F.lit("")).when(k % 5 == 0, F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))
            .otherwise(F.col("c_name")))
    site = F.concat(F.lit("https://c"), k.cast("string"), F.lit(".example"))
    note = F.concat(F.lit("n"), k.cast("string"))
    a_cells = F.array(F.lit(""), name, site, note, F.col("c_mktsegment"))
    a_cells = (F.when(k % 4 == 2, F.slice(a_cells, 1, 3))
               .when(k % 7 == 0, F.concat(a_cells, F.array(F.lit("extra")))).otherwise(a_cells))
    b_cells = F.array(site, name, F.col("c_mktsegment"), F.lit("old"), note)
    b_cells = F.when(k % 4 == 1, F.slice(b_cells, 1, 2)).otherwise(b_cells)
    rows = c.select(F.when(k % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("sheet"),
                    (k + 2).cast("long").alias("row_no"),
                    F.when(k % 2 == 0, a_cells).otherwise(b_cells).alias("cells"))
    hdr = spark.createDataFrame([("A", 1, ["", " Name ", "Website", "Notes", "Segment"]),
                                 ("B", 1, ["Website", "name ", "SEGMENT", "Notes", "notes"])],
                                "sheet string, row_no long, cells array<string>")
    return rows.unionByName(hdr)


@query
def sheet_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Header-driven read of spreadsheet rows."""
    from ..sources.sheet import read_sheet

    return read_sheet(sheet_rows_df(spark, sf), ["name", "website", "notes", "segment"])


# ----------------------------------------------------------- requests ----

@query
def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One CFP lookup request per event, one discovery request
    per (segment, city)."""
    from ..operators.requests import cfp_requests, city_requests

    e = load(spark, sf, "events")
    n = load(spark, sf, "nation")
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    x = e.join(c, e.user_id == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    k = F.col("event_id")
    ev = x.select(k.alias("key"),
                  F.concat(F.col("event_type"), F.lit(" "), k.cast("string")).alias("name"),
                  F.when(k % 5 == 0, F.lit("")).otherwise(F.col("n_name")).alias("location"),
                  F.when(k % 7 == 0, F.lit("")).otherwise(D.fmt_date(F.to_date("ts"))).alias("start_date"),
                  F.when(k % 3 == 0, F.lit("")).otherwise(D.fmt_date(F.date_add(F.to_date("ts"), 1))).alias("end_date"),
                  F.when(k % 4 == 0, F.lit("")).otherwise(
                      F.concat(F.lit("https://ev.example/"), k.cast("string"))).alias("website"))
    segs = e.select(F.col("event_type").alias("segment")).distinct()
    return cfp_requests(ev).unionByName(city_requests(segs))


# --------------------------------------------------------------- ical ----

def ics_files(spark, sf) -> DataFrame:
    """Calendar documents assembled from events: one file per (feed, block of
    64 event ids), feed = user_id % 3; DTSTART in the four iCal shapes,
    escaped and folded text, some events without SUMMARY / DTSTART / LOCATION."""
    e = load(spark, sf, "events")
    k = F.col("event_id")
    crlf = F.lit("\r\n")

    def dt(prop, ts):
        d8 = F.date_format(ts, "yyyyMMdd")
        t15 = F.date_format(ts, "yyyyMMdd'T'HHmmss")
        return (F.when(k % 4 == 0, F.concat(F.lit(prop + ";VALUE=DATE:"), d8))
                .when(k % 4 == 1, F.concat(F.lit(prop + ":"), t15, F.lit("Z")))
                .when(k % 4 == 2, F.concat(F.lit(prop + ";TZID=America/Los_Angeles:"), t15))
                .otherwise(F.concat(F.lit(prop + ":"), t15)))

    name = F.when(k % 6 == 0, F.concat(F.col("event_type"), F.lit("\\, "), (k % 50).cast("string"))) \
        .otherwise(F.concat(F.col("event_type"), F.lit(" "), (k % 50).cast("string")))
    desc = F.concat(F.lit("DESCRIPTION:Event "), k.cast("string"), F.lit(" of type "), F.col("event_type"),
                    F.lit("\\, value "), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("\\nmore"))
    desc = F.when(F.length(desc) > 30, F.concat(F.substring(desc, 1, 30), crlf, F.lit(" "), F.substring(desc, F.lit(31), F.length(desc)))) \
        .otherwise(desc)
    lines = F.array_compact(F.array(
        F.lit("BEGIN:VEVENT"),
        F.when(k % 17 != 0, F.concat(F.lit("SUMMARY:"), name)),
        F.when(k % 19 != 0, dt("DTSTART", F.col("ts"))),
        dt("DTEND", F.col("ts") + F.expr("INTERVAL 1 HOUR")),
        F.when(k % 5 != 0, F.concat(F.lit("LOCATION:City "), (F.col("user_id") % 7).cast("string"))),
        F.concat(F.lit("URL:https://ev.example/"), k.cast("string")),
        desc, F.lit("END:VEVENT")))
    block = F.array_join(lines, "\r\n")
    x = e.select((F.col("user_id") % 3).cast("int").alias("feed"), F.floor(k / 64).cast("long").alias("chunk"),
                 k, block.alias("block"))
    g = x.groupBy("feed", "chunk").agg(F.array_sort(F.collect_list(F.struct("event_id", "block"))).alias("b"))
    body = F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n"),
                    F.array_join(F.transform("b", lambda i: i["block"]), "\r\n"), F.lit("\r\nEND:VCALENDAR\r\n"))
    return g.select(F.format_string("feed%d/%d.ics", F.col("feed"), F.col("chunk")).alias("path"),
                    body.alias("value"), "feed", "chunk")


@query
def ical_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Upcoming calendar events, first-wins by name."""
    from ..sources.ical import scan_calendars
    from ..sources.registry import feed_registry

    files = ics_files(spark, sf)
    reg = feed_registry(files, F.concat(F.lit("Feed "), F.col("feed").cast("string")),
                        F.concat(F.lit("Default "), F.col("feed").cast("string")),
                        F.col("feed"), F.col("chunk"))
    out = scan_calendars(files.select("path", "value"), reg, AS_OF_EVENTS)
    return out.select("name", "source", "raw_location", "raw_start_date", "raw_end_date", "website", "card_text")


FEEDS = [(0, "Feed 0", "Default 0"), (1, "Feed 1", "Default 1"), (2, "Feed 2", "Default 2")]


@query
def ical_files(spark: SparkSession, sf: str) -> DataFrame:
    """The calendars of ical_scan landed as one file per feed, read
    event by event from byte ranges of the files, joined to a feed table."""
    from ..session import scratch_path
    from ..sources.ical import read_calendars, scan_calendars

    root = scratch_path(spark, "calendars")
    files = ics_files(spark, sf).repartition("feed").sortWithinPartitions("feed", "chunk")
    files.select("feed", "value").write.partitionBy("feed").text(root)
    reg = spark.createDataFrame([(*f, f[0]) for f in FEEDS], "feed int, label string, default_location string, rank long")
    out = scan_calendars(read_calendars(spark, root), reg, AS_OF_EVENTS, key="feed")
    return out.select("name", "source", "raw_location", "raw_start_date", "raw_end_date", "website", "card_text")


# -------------------------------------------------------------- union ----

def listing_events(spark, sf) -> DataFrame:
    x = split_listing(_parent_texts(spark, sf))
    return x.select("name", F.lit("Listing").alias("source"),
                    X.default_fill(F.col("location"), "Various").alias("raw_location"),
                    F.coalesce(X.first_nonblank("start_part", "date_raw"), F.lit("")).alias("raw_start_date"),
                    F.coalesce(X.first_nonblank("end_part", "date_raw"), F.lit("")).alias("raw_end_date"),
                    F.lit("").alias("website"), F.col("parent_text").alias("card_text"),
                    F.col("o_orderkey").alias("ord"))


def page_link_events(spark, sf) -> DataFrame:
    pages = load(spark, sf, "pages").select("page_id", "url", "html")
    reg = registry_df(pages)
    a = page_links_df(spark, sf).withColumn("host", H.page_host(F.col("url")))
    a = a.join(reg, "host")
    return a.select(F.col("text").alias("name"), F.lit("Pages").alias("source"),
                    X.default_fill(F.lit(""), F.col("default_location")).alias("raw_location"),
                    F.col("link").alias("website"), F.col("text").alias("card_text"),
                    order_key("page_id", "ord").alias("ord"))


@query
def source_union(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds (status from their pages), page links
    and listing rows, unioned by name with a source rank."""
    from ..sources.registry import seed_events, union_sources

    pages = load(spark, sf, "pages").select("url", "html")
    seeds = C.seed_status(seed_events(spark), pages)
    u = union_sources([(1, seeds), (2, page_link_events(spark, sf)), (3, listing_events(spark, sf))])
    return u.select("source", F.col("source_rank").cast("long"), F.expr(_ORD_TEXT), "name", "website", "raw_location",
                    "raw_start_date", "cfp_status")


# --------------------------------------------------------------- runs ----

_RUN_COLS = ["sheet", "row_id", "row_no", "name", "category", "cfp_status", "start_date", "website", "days"]


def run_tracker(spark, sf):
    """Tracker over orders plus an Excluded table from customers in debt."""
    from ..operators.upsert import conform_tracker

    c = load(spark, sf, "customer").where(F.col("c_acctbal") < 0)
    ex = conform_tracker(c.select(F.lit("Excluded").alias("sheet"), (F.lit(10**9) + F.col("c_custkey")).alias("row_id"),
                                  (F.col("c_custkey") + 2).cast("long").alias("row_no"),
                                  F.col("c_name").alias("name"), F.lit("").alias("website")))
    return lifecycle_tracker(spark, sf).unionByName(ex)


@query
def conference_run(spark: SparkSession, sf: str) -> DataFrame:
    """C1 over the fixture: tracker from orders, candidates from seeds, pages,
    listings and tracker echoes, editions and CFP facts from orders."""
    from ..sources.registry import seed_events, union_sources
    from ..sources.replies import discovered_events
    from .runs import conference_run as run, rule_scorer

    o = load(spark, sf, "orders")
    echoes = o.select(
        F.concat(F.lit("Conf "), F.col("o_custkey").cast("string")).alias("name"), F.lit("Echo").alias("source"),
        D.fmt_date(F.date_add(F.to_date("o_orderdate"), 400)).alias("raw_start_date"),
        F.concat(F.lit("City "), (F.col("o_custkey") % 9).cast("string")).alias("raw_location"),
        F.lit("conf echo").alias("card_text"), F.col("o_orderkey").alias("ord"))
    pages = load(spark, sf, "pages").select("url", "html")
    tracker = run_tracker(spark, sf)
    # discovery asks for what no table of the tracker knows yet
    disc = discovered_events(replies_df(spark, sf), key_set(tracker, "name")).drop("source_rank")
    raw = union_sources([(1, C.seed_status(seed_events(spark), pages)), (2, page_link_events(spark, sf)),
                         (3, listing_events(spark, sf)), (4, echoes), (5, disc)])
    cand = o.select(F.col("o_orderkey").alias("cand_id"),
                    F.concat(F.lit("Conf "), F.col("o_custkey").cast("string")).alias("base_name"),
                    F.lit("").alias("name"), D.fmt_date(F.date_add(F.to_date("o_orderdate"), 900)).alias("start_date"),
                    F.lit("").alias("end_date"), F.lit("").alias("location"), F.lit("").alias("website"),
                    F.lit("high").alias("confidence"), F.lit(True).alias("future_edition_found"),
                    F.lit("").alias("evidence"))
    res = run(tracker, raw, rule_scorer(["customer", "conf", "summit", "kubecon", "cloud"], AS_OF_ORDERS),
              AS_OF_ORDERS, edition_candidates=cand, cfp_lookups=cfp_fact_rows(spark, sf))
    return res.tracker.select(*_RUN_COLS).withColumn("days", F.col("days").cast("long"))


@query
def meetup_run(spark: SparkSession, sf: str) -> DataFrame:
    """C2 over the fixture: calendar scan and discovery replies as sources."""
    from ..sources.ical import scan_calendars
    from ..sources.registry import feed_registry, union_sources
    from ..sources.replies import discovered_events
    from .runs import meetup_run as run, rule_scorer
    from .tables import MEETUP_RULES

    files = ics_files(spark, sf)
    reg = feed_registry(files, F.concat(F.lit("Feed "), F.col("feed").cast("string")),
                        F.concat(F.lit("Default "), F.col("feed").cast("string")),
                        F.col("feed"), F.col("chunk"))
    cal = scan_calendars(files.select("path", "value"), reg, AS_OF_EVENTS)
    tracker = run_tracker(spark, sf)
    disc = discovered_events(replies_df(spark, sf), key_set(tracker, "name")).drop("source_rank")
    raw = union_sources([(1, cal), (2, disc)])
    scorer = rule_scorer(["meetup", "click", "view", "signup", "purchase", "error"], AS_OF_EVENTS,
                         type_rules=[("meetup", ["ical", "meetup", "web discovery"])])
    res = run(tracker, raw, scorer, AS_OF_EVENTS, rules=MEETUP_RULES)
    return res.tracker.select(*_RUN_COLS).withColumn("days", F.col("days").cast("long"))


# ---------------------------------------------------------- streaming ----

def _weekly_incoming(spark, sf):
    e = load(spark, sf, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("ord"), F.concat(F.col("event_type"), F.lit(" meetup "), (k % 97).cast("string")).alias("name"),
        F.concat(F.lit("https://ev.example/"), (k % 500).cast("string")).alias("website"),
        F.concat(F.lit("City "), (F.col("user_id") % 7).cast("string")).alias("location"),
        D.fmt_date(F.to_date("ts")).alias("start_date"), F.col("ts").cast("timestamp").alias("scraped_at"),
        F.floor(F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))) / 7).cast("int").alias("week"))


def stage_weeks(spark, sf, staging: str):
    """Write the incoming rows by week, in one pass; (schema, weeks in order)."""
    inc = _weekly_incoming(spark, sf)
    inc.write.partitionBy("week").parquet(staging)
    weeks = sorted(r["week"] for r in spark.read.parquet(staging).select("week").distinct().collect())  # a handful
    return inc.drop("week").schema, weeks


def land_week(spark, schema, staging: str, week: int, landing: str) -> None:
    """Files of one week arrive (a test harness standing in for a weekly feed)."""
    spark.read.schema(schema).parquet(f"{staging}/week={week}").write.mode("append").parquet(landing)


@query
def incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Each week's files arrive and are upserted into Meet-ups as one
    micro-batch."""
    from ..operators.upsert import empty_tracker
    from ..session import scratch_path
    from ..streaming.incremental import init_store, run_incremental

    root = scratch_path(spark, "incremental")
    schema, weeks = stage_weeks(spark, sf, f"{root}/staging")
    store = init_store(spark, f"{root}/tracker", empty_tracker(spark))
    for week in weeks:
        land_week(spark, schema, f"{root}/staging", week, f"{root}/landing")
        snap = run_incremental(spark, f"{root}/landing", schema, store, "Meet-ups", f"{root}/_stream_ckpt")
    return snap.select(*_RUN_COLS).withColumn("days", F.col("days").cast("long"))


@query
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """First sighting of each name within a 7-day watermark, streamed week
    by week."""
    from ..session import scratch_path
    from ..streaming.incremental import first_seen as dedup

    root = scratch_path(spark, "first_seen")
    schema, weeks = stage_weeks(spark, sf, f"{root}/staging")
    out = f"{root}/out"
    for week in weeks:
        land_week(spark, schema, f"{root}/staging", week, f"{root}/landing")
        stream = spark.readStream.schema(schema).parquet(f"{root}/landing")
        q = (dedup(stream, "name", "scraped_at", "7 days").writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", f"{root}/_ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(schema).parquet(out).select("ord", "name", "scraped_at")


# ------------------------------------------------------ lookup replies ----

def classifier_reply_rows(spark, sf):
    """One classifier reply per event: fenced JSON, bare JSON, or prose."""
    e = load(spark, sf, "events")
    k = F.col("event_id")
    rec = F.struct(
        (F.col("value") > 50).alias("relevant"),
        F.when(F.col("event_type").isin("click", "view"), F.lit("meetup")).otherwise(F.lit("conference")).alias("event_type"),
        F.concat(F.col("event_type"), F.lit(" "), k.cast("string")).alias("name"),
        F.when(k % 2 == 0, F.lit("DevOps")).otherwise(F.lit("Agentic AI")).alias("category"),
        F.concat(F.lit("City "), (F.col("user_id") % 7).cast("string")).alias("location"),
        D.fmt_date(F.to_date("ts")).alias("start_date"), F.lit("").alias("end_date"), F.lit("").alias("cfp_date"),
        F.when(k % 5 == 0, F.lit("Open")).otherwise(F.lit("Check site")).alias("cfp_status"),
        F.concat(F.lit("https://ev.example/"), k.cast("string")).alias("website"),
        F.get_json_object("props", "$.k").cast("int").alias("fit_score"),
        (F.col("value") > 100).alias("demo_suitable"), F.lit("fits").alias("relevance_note"))
    j = F.to_json(rec)
    text = (F.when(k % 3 == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
            .when(k % 3 == 1, F.concat(F.lit("  "), j)).otherwise(F.lit("Sorry, I cannot classify this.")))
    raw_status = F.when(k % 4 == 0, F.lit("Closed")).when(k % 4 == 1, F.lit("Check site")).otherwise(F.lit(""))
    return e.select(k.alias("req_id"), text.alias("text"), raw_status.alias("cfp_status"),
                    F.col("event_type").alias("source"))


@query
def classifier_replies(spark: SparkSession, sf: str) -> DataFrame:
    """F23 M2 (reply scorer) P8 F17: classifier replies parsed per event;
    outcome relevant / rejected / failed; the source's CFP status wins."""
    from ..operators.classify import classify_batch
    from ..sources.replies import reply_scorer

    rows = classifier_reply_rows(spark, sf)
    raw = rows.select("req_id", "cfp_status", "source", F.lit("").alias("name"), F.lit("").alias("website"))
    empty = key_set(raw.where(F.lit(False)), "name")
    _, _, scored = classify_batch(raw, reply_scorer(rows.select("req_id", "text")), empty, empty)
    return scored.select(F.col("req_id").alias("event_id"), "outcome", F.col("model_event_type").alias("event_type"),
                         F.col("model_fit_score").cast("long").alias("fit_score"),
                         C.cfp_precedence(F.col("cfp_status"), F.col("model_cfp_status")).alias("cfp_status"))


def cfp_reply_rows(spark, sf):
    """One CFP lookup reply per order: prose-wrapped, truncated in the URL, or
    without any JSON."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    rec = F.struct(
        F.when(F.col("o_orderstatus") == "F", F.lit("Open")).when(F.col("o_orderstatus") == "O", F.lit("Closed"))
         .otherwise(F.lit("Unknown")).alias("cfp_status"),
        F.when(k % 3 == 0, F.lit("")).otherwise(D.fmt_date(F.date_add(F.to_date("o_orderdate"), 30))).alias("cfp_deadline"),
        F.concat(F.lit("https://cfp.example/"), k.cast("string")).alias("cfp_url"),
        F.lit("high").alias("confidence"))
    j = F.to_json(rec)
    cut = F.substring(j, 1, F.instr(j, '"cfp_url":"') + 14)
    text = (F.when(k % 4 == 0, F.concat(F.lit("Found it: "), j, F.lit(" (source: web)")))
            .when(k % 4 == 1, cut).when(k % 4 == 2, j).otherwise(F.lit("No data.")))
    return o.select(k.alias("reply_id"), F.concat(F.lit("Conf "), k.cast("string")).alias("label"), text.alias("text"))


@query
def cfp_lookup_replies(spark: SparkSession, sf: str) -> DataFrame:
    """CFP lookup replies -> one fact per event key."""
    from ..sources.replies import cfp_lookups

    facts = C.facts_from_lookups(cfp_lookups(cfp_reply_rows(spark, sf)), AS_OF_ORDERS)
    return facts.select("fact_key", "fact_status", "fact_date", "fact_url")


@query
def discovery_round(spark: SparkSession, sf: str) -> DataFrame:
    """M7 A5: one discovery round over the replies: new candidates per
    search label against per-search targets, with the retry flag."""
    from .runs import discovery_round as run

    targets = spark.createDataFrame([("CFP-open conference", 5), ("ticketed conference", 5), ("meetup/Berlin", 3)],
                                    "segment string, wanted long")
    _, short = run(replies_df(spark, sf), known_event_names(spark, sf), targets)
    return short


# ------------------------------------------------------------ page scans ----

def _host_location(pages):
    tld = F.substring_index(H.page_host(F.col("url")), ".", -1)
    return (F.when(tld == "com", F.lit("San Francisco, USA")).when(tld == "org", F.lit("Berlin, Germany"))
            .when(tld == "net", F.lit("London, UK")).otherwise(F.lit("Various")))


_SCAN_COLS = ["name", "source", "raw_location", "website", _ORD_TEXT]


@query
def listing_scan(spark: SparkSession, sf: str) -> DataFrame:
    """S2 on the DOM engine: every page link, split against its parent text,
    skip-list before keep-list."""
    from ..sources.listing import scan_listing

    pages = load(spark, sf, "pages").select("page_id", "url", "html")
    out = scan_listing(pages, href_contains="/", keep=DOC_KEEP + ["the"], skip=["gnu", "und"])
    return out.selectExpr(*_SCAN_COLS, "raw_start_date", "raw_end_date")


@query
def card_scan(spark: SparkSession, sf: str) -> DataFrame:
    """S3 on the DOM engine: page heading with its nearest slug link."""
    from ..sources.listing import scan_cards

    pages = load(spark, sf, "pages").select("page_id", "url", "html")
    out = scan_cards(pages, _host_location(pages), heading_tag="h1", keep=["e", "a"])
    return out.selectExpr(*_SCAN_COLS)


@query
def group_scan(spark: SparkSession, sf: str) -> DataFrame:
    """S4 on the DOM engine: links matching an event-path pattern."""
    from ..sources.listing import scan_group_pages

    pages = load(spark, sf, "pages").select("page_id", "url", "html")
    out = scan_group_pages(pages, _host_location(pages), href_pattern=r"^/[A-Za-z]{5,}$", keep=["e"])
    return out.selectExpr(*_SCAN_COLS)


@query
def side_event_scan(spark: SparkSession, sf: str) -> DataFrame:
    """S5 on the DOM engine: all named links, greedy per page, first by URL."""
    from ..sources.listing import scan_side_events

    pages = load(spark, sf, "pages").select("page_id", "url", "html")
    return scan_side_events(pages).selectExpr(*_SCAN_COLS, "card_text")


# ------------------------------------------- options and plans of operators ----

@query
def rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """J4 with rules as data: parts by the first rule, in priority order, whose
    needle their name holds; rules from nations and brands, some needles empty."""
    from ..operators.rules import first_rule_from_table

    n = load(spark, sf, "nation")
    words = F.split(F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))), " ")
    rules = n.select((F.col("n_nationkey") % 7).cast("int").alias("priority"),
                     F.concat(F.lit("L"), F.col("n_regionkey").cast("string")).alias("label"),
                     F.when(F.col("n_nationkey") % 5 == 0, F.lit("")).otherwise(F.element_at(words, -1)).alias("needle"))
    o = load(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("t"))
    return first_rule_from_table(o, "t", rules).select("o_orderkey", "label")


def vocabulary(spark, sf) -> DataFrame:
    """Words of four letters or more of the benchmark texts, with the number of
    texts that hold them."""
    b = load(spark, sf, "benchmark").select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("term"))
    return b.where(F.length("term") >= 4).groupBy("term").agg(F.count("*").alias("n_texts"))


@query
def keyword_table(spark: SparkSession, sf: str) -> DataFrame:
    """P1 with keywords as a table: documents that hold any of the rare long
    words of the benchmark texts, anywhere and as whole words."""
    from ..operators.rules import holds_term_from_table

    terms = vocabulary(spark, sf).where((F.col("n_texts") == 1) & (F.length("term") >= 9))
    d = load(spark, sf, "documents").select("doc_id", "text")
    d = holds_term_from_table(d, "text", terms, out="anywhere")
    return holds_term_from_table(d, "text", terms, out="as_word", whole_word=True).drop("text")


@query
def rule_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """J4 M4 with a rule for each word of the benchmark texts: documents by the
    rarest such word they hold (of equally rare ones the first label)."""
    from ..operators.rules import first_rule_from_table

    rules = vocabulary(spark, sf).select(F.col("n_texts").alias("priority"), F.upper("term").alias("label"),
                                         F.col("term").alias("needle"))
    d = load(spark, sf, "documents").select("doc_id", "text")
    return first_rule_from_table(d, "text", rules).select("doc_id", "label")


@query
def capped_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The first 80 events in arrival order, and no others."""
    from ..operators.classify import cap_in_order

    e = load(spark, sf, "events").select((F.col("user_id") % 3).alias("source_rank"), F.col("event_id").alias("ord"))
    return cap_in_order(e, 80)


@query
def demo_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The routing of city_route with demos folded into Meet-ups."""
    from ..operators.route import route_meetups
    from .tables import ROUTE_RULES

    out = route_meetups(classified_events(spark, sf), AS_OF_EVENTS, ROUTE_RULES, include_demos=False)
    return out.groupBy("sheet", "city", "is_demo").agg(F.count("*").alias("n"))


@query
def category_rules(spark: SparkSession, sf: str) -> DataFrame:
    """M4: category of every part by ordered rules over its type."""
    from ..operators.rules import first_rule
    from .tables import CATEGORY_RULES

    return load(spark, sf, "part").select("p_partkey", first_rule("p_type", CATEGORY_RULES).alias("category"))


@query
def registered_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Registered sources of a mode, collected in rank order."""
    from ..sources.registry import Source, collect_sources

    def of(kind):
        def rows(spark, cfg):
            e = load(spark, cfg["sf"], "events").where(F.col("event_type") == kind)
            return e.select(F.concat(F.lit(kind + " "), F.col("event_id").cast("string")).alias("name"),
                            F.lit(kind).alias("source"), F.col("event_id").alias("ord"))
        return rows

    sources = [Source("views", 2, of("view"), {"conference", "meetup"}), Source("clicks", 1, of("click"), {"conference"}),
               Source("errors", 3, of("error"), {"meetup"})]
    got = collect_sources(spark, {"sf": sf}, "conference", sources)
    return got.select(F.col("source_rank").cast("long"), "source", "name", F.expr(_ORD_TEXT))


@query
def source_failures(spark: SparkSession, sf: str) -> DataFrame:
    """A run goes on without a source that cannot be read and without
    one that fails at its last rows; of the latter none are kept."""
    from ..sources.registry import Source, collect_sources

    def of(kind, table="events", fails=F.lit(False)):
        def rows(spark, cfg):
            e = load(spark, cfg["sf"], table).where(F.col("event_type") == kind)
            name = F.concat(F.lit(kind + " "), F.col("event_id").cast("string"))
            return e.select(F.when(fails, F.raise_error(F.lit("source broke off"))).otherwise(name).alias("name"),
                            F.lit(kind).alias("source"), F.col("event_id").alias("ord"))
        return rows

    sources = [Source("clicks", 1, of("click")), Source("gone", 2, of("view", table="no_such_table")),
               Source("broken", 3, of("error", fails=F.col("event_id") > 100)), Source("views", 4, of("view"))]
    failed: list[tuple[str, int]] = []
    got = collect_sources(spark, {"sf": sf}, "conference", sources, lambda s, _: failed.append((s.name, s.rank)))
    reported = spark.createDataFrame(failed, "name string, source_rank int").withColumn("source", F.lit("failed"))
    return (got.select("source_rank", "source", "name").unionByName(reported)
            .withColumn("source_rank", F.col("source_rank").cast("long")))


@query
def exclusion_load(spark: SparkSession, sf: str) -> DataFrame:
    """The key sets of the tracker's Excluded table."""
    from .runs import load_exclusions

    names, urls, _ = load_exclusions(run_tracker(spark, sf))
    return (names.select(F.lit("name").alias("kind"), F.col(names.columns[0]).alias("k"))
            .unionByName(urls.select(F.lit("url").alias("kind"), F.col(urls.columns[0]).alias("k"))))


@query
def lifecycle_plan(spark: SparkSession, sf: str) -> DataFrame:
    """K8: what migration and purge would do, without doing it."""
    from ..operators.lifecycle import plan_migrate, plan_purge

    t = lifecycle_tracker(spark, sf)
    return plan_migrate(t, AS_OF_ORDERS).unionByName(plan_purge(t, AS_OF_ORDERS))


@query
def lifecycle_apply(spark: SparkSession, sf: str) -> DataFrame:
    """K8 K6 K7: the lifecycle plan, stored and applied by a call of its own."""
    from ..operators.lifecycle import apply_lifecycle, plan_migrate, plan_purge
    from ..session import write_table

    t = lifecycle_tracker(spark, sf)
    plan = write_table(plan_migrate(t, AS_OF_ORDERS).unionByName(plan_purge(t, AS_OF_ORDERS)), "plan")
    return apply_lifecycle(t, plan).select(*_LIFE_COLS).withColumn("days", F.col("days").cast("long"))


@query
def route_plan(spark: SparkSession, sf: str) -> DataFrame:
    """K8: rows that each table would receive from the routing."""
    from ..operators.route import plan_routes, route_meetups
    from .tables import ROUTE_RULES

    return plan_routes(route_meetups(classified_events(spark, sf), AS_OF_EVENTS, ROUTE_RULES))


def edition_reply_rows(spark, sf):
    """One next-edition reply per order, wrapped in prose or bare."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    j = F.to_json(F.struct(
        (k % 5 != 0).alias("future_edition_found"), F.when(k % 4 == 0, F.lit("low")).otherwise(F.lit("high")).alias("confidence"),
        F.lit("").alias("name"), D.fmt_date(F.date_add(F.to_date("o_orderdate"), 900)).alias("start_date"),
        F.lit("").alias("end_date"), F.lit("").alias("location"), F.lit("").alias("website"),
        F.concat(F.lit("seen "), k.cast("string")).alias("evidence")))
    text = F.when(k % 2 == 0, F.concat(F.lit("I found: "), j, F.lit(" (web)"))).otherwise(j)
    return o.select(k.alias("reply_id"), F.concat(F.lit("Conf "), F.col("o_custkey").cast("string")).alias("label"),
                    text.alias("text"))


@query
def edition_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Next-edition replies linked to the archived rows of their event,
    with the evidence as a note."""
    from ..operators.editions import next_editions
    from ..sources.replies import edition_lookups

    past = lifecycle_tracker(spark, sf).where(F.col("sheet") == "Time Passed").select(
        "row_id", "name", "start_date", "category", "location", "website")
    out = next_editions(past, edition_lookups(edition_reply_rows(spark, sf)), AS_OF_ORDERS)
    return out.select("row_id", "next_name", "start_date", "cand_id", "note")


@query
def lookup_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Classification, next-edition and discovery requests, and the
    retry requests of the segments that fell short."""
    from ..operators import requests as R

    ev = load(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.lit("Parts").alias("source"),
        F.col("p_brand").alias("location"), F.lit("").alias("start_date"), F.col("p_type").alias("card_text"),
        F.when(F.col("p_size") % 2 == 0, F.lit("https://p.example")).otherwise(F.lit("")).alias("website"))
    short = shortfall(spark, sf).withColumn("known", F.lit("  - A"))
    return (R.classify_requests(ev).unionByName(R.edition_requests(ev, AS_OF_ORDERS))
            .unionByName(R.discovery_requests(short)).unionByName(R.retry_requests(short)))
