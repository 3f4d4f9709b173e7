"""Header-driven table read.

Input ``sheet_rows(sheet, row_no, cells ARRAY<STRING>)`` with row 1 the
header. Each data row is joined to its sheet's header (one row per sheet, so
the header side is small and broadcast behind a size check); columns are
found by trimmed lower-cased header name, short rows are padded, surplus
cells and blank headers ignored, a duplicated header keeps its last column,
and rows without a name are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..operators.common import sized_broadcast


def sheet_records(rows: DataFrame) -> DataFrame:
    """sheet, row_no, rec MAP<STRING,STRING> (header name -> trimmed cell)."""
    hdr = rows.where(F.col("row_no") == 1).select(
        "sheet", F.transform("cells", lambda h: F.lower(strip_ws(h))).alias("_hdr"))
    hdr = sized_broadcast(hdr)
    data = rows.where(F.col("row_no") > 1).join(hdr, "sheet")
    entries = F.transform("_hdr", lambda h, i: F.struct(
        h.alias("key"),
        F.coalesce(strip_ws(F.try_element_at("cells", i + 1)), F.lit("")).alias("value"),
        i.alias("i")))
    keep = F.filter(entries, lambda e: (e["key"] != "") & ~F.exists(
        F.slice("_hdr", e["i"] + 2, F.greatest(F.size("_hdr") - e["i"] - 1, F.lit(0))),
        lambda later: later == e["key"]))
    rec = F.map_from_entries(F.transform(keep, lambda e: F.struct(e["key"], e["value"])))
    return data.select("sheet", "row_no", rec.alias("rec"))


def read_sheet(rows: DataFrame, columns: list[str], require: str = "name") -> DataFrame:
    """Typed columns by header name ('' when the header is absent);
    rows whose ``require`` column is empty are dropped."""
    r = sheet_records(rows)
    out = r.select("sheet", "row_no", *[F.coalesce(F.try_element_at("rec", F.lit(c)), F.lit("")).alias(
        c.replace(" ", "_")) for c in columns])
    return out.where(F.col(require.replace(" ", "_")) != "")
