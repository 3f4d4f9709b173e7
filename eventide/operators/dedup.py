"""Order-dependent de-duplication.

The reference's first-wins / last-wins rules come from Python list order; here
order is an explicit column and every rule is an aggregate or a short loop of
joins, never a collect.

Scale notes
* ``first_wins`` / ``last_wins`` are one hash aggregate keyed by the dedup key
  with partial (map-side) aggregation, so a key that holds a third of all rows
  is reduced inside each map task before the shuffle -- unlike a
  ``row_number()`` window, which would sort that whole key in one task.
* ``greedy_two_key`` (W5) peels off, by aggregates, the rows whose keys nobody
  else holds and the later rows with the same shared keys, and splits what is
  left into connected components. A component of bounded size is walked in order inside one task;
  larger ones are thinned by rounds of two key-joins first. What is undecided is
  written into the shared folder, so lineage stays short and a lost executor
  replays one step only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import norm_key, strip_ws
from ..session import cut_lineage, write_table
from .common import require_unique
from .components import components

# Rows of a component that one task walks in order.
TASK_ROWS = 200_000


def _pick(df: DataFrame, keys: list[str | Column], order: list[str], first: bool, late: bool) -> DataFrame:
    cols = df.columns
    key_cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    key_names = [f"_k{i}" for i in range(len(key_cols))]
    keyed = df.select(*[c.alias(n) for c, n in zip(key_cols, key_names)], *cols)
    reduce_by = F.min if first else F.max
    if late:
        # the order alone is reduced; one column needs no struct and stays in the hash aggregate
        places = [F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]
        best = reduce_by(F.col(order[0]) if len(order) == 1 else F.struct(*places))
        won = keyed.groupBy(*key_names).agg(best.alias("_w"))
        won = won.select(F.col("_w").alias("_o0")) if len(order) == 1 else won.select("_w.*")
        same = [F.col(o).eqNullSafe(F.col(f"_o{i}")) for i, o in enumerate(order)]
        return df.join(won, same, "left_semi")
    payload = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                       F.struct(*cols).alias("_row"))
    return keyed.groupBy(*key_names).agg(reduce_by(payload).alias("_w")).select("_w._row.*")


def first_wins(df: DataFrame, keys: list[str | Column], order: list[str], late: bool = False) -> DataFrame:
    """Keep the first row per key in ``order`` (which must end in a
    unique column). NULL keys form one group, as '' does in the reference.

    Rows travel through the aggregate, which reads ``df`` once and is best for
    narrow rows or dear inputs. With ``late`` only keys and order are reduced and
    the winners' rows are fetched by a semi join on the order: for wide rows of
    a stored table, which is read twice."""
    return _pick(df, keys, order, True, late)


def last_wins(df: DataFrame, keys: list[str | Column], order: list[str], late: bool = False) -> DataFrame:
    """Keep the last row per key (dict-overwrite semantics)."""
    return _pick(df, keys, order, False, late)


def dedup_keys(name: Column, url: Column, case_fold: bool = True) -> Column:
    """Key array of W5: the name key always (also when empty), the URL key only
    when non-empty; both live in one namespace."""
    fold = norm_key if case_fold else strip_ws
    n = F.coalesce(fold(name), F.lit(""))
    u = fold(url)
    return F.when(u.isNull() | (u == ""), F.array(n)).otherwise(F.array(n, u))


def _peeled(undecided: DataFrame, kept_parts: list[DataFrame]) -> DataFrame:
    """The first row (_ord, _keys) of each key array, with the keys that another
    of these rows holds too; rows that share none are kept (``kept_parts``)."""
    first = write_table(undecided.groupBy("_keys").agg(F.min("_ord").alias("_ord")), "w5-first")
    edges = first.select("_ord", F.explode("_keys").alias("_key"))
    shared = edges.groupBy("_key").count().where("count > 1").select(F.col("_key").alias("_shared"))
    # at most two keys a row
    held = (edges.join(shared, edges["_key"] == shared["_shared"], "left").groupBy("_ord")
            .agg(F.min("_shared").alias("_a"), F.max("_shared").alias("_b")))
    held = held.select("_ord", F.array_compact(F.array_distinct(F.array("_a", "_b"))).alias("_keys"))
    held = write_table(held, "w5-held")
    kept_parts.append(held.where(F.size("_keys") == 0).select("_ord"))
    return held.where(F.size("_keys") > 0)


def _walk():
    """The orders that the two-key rule keeps; the rows of a component follow
    one another in their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, owned = None, set()
        for batch in batches:
            keep = []
            for row, (at, keys) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if at != component:
                    component, owned = at, set()
                if owned.isdisjoint(keys):
                    owned.update(keys)
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(keep, pa.int64()))], names=["_ord"])

    return run


def _thinned(undecided: DataFrame, rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """Rows kept by some rounds over (_ord, _keys), and the rows left undecided:

    1. m(key) = min(ord) over the undecided rows holding the key;
    2. a row whose ord equals m(key) for all of its keys is kept;
    3. undecided rows sharing a key with a row kept in 2 are dropped.
    """
    parts = []
    for _ in range(rounds):
        edges = undecided.select("_ord", F.explode("_keys").alias("_key"))
        first_of_key = edges.groupBy("_key").agg(F.min("_ord").alias("_m"))
        kept = cut_lineage(edges.join(first_of_key, "_key")
                           .groupBy("_ord").agg(F.min((F.col("_ord") == F.col("_m")).cast("int")).alias("_all"))
                           .where("_all = 1").select("_ord"))
        parts.append(kept)
        kept_keys = edges.join(kept, "_ord", "left_semi").select("_key").distinct()
        blocked = edges.join(kept_keys, "_key", "left_semi").select("_ord")
        undecided = cut_lineage(undecided.join(blocked, "_ord", "left_anti"))
    return parts, undecided


def greedy_two_key(df: DataFrame, name: str | Column, url: str | Column, ord_col: str,
                   case_fold: bool = True, check_order: bool = True, task_rows: int = TASK_ROWS,
                   stored: bool = False) -> DataFrame:
    """Walk rows in ``ord_col`` order and keep a row unless one of its keys
    belongs to an already kept row. Exact:

    * of rows with the same keys only the first can be kept, so one aggregate
      reduces them first, and a row that shares no key is kept at once;
    * a key that one row alone holds decides nothing and is left out; rows may
      then have the same keys, and both steps go on while they halve the rows
      (a common name with a URL of its own on each row is settled so);
    * the others fall into components of rows that hang together by their keys;
      a component of at most ``task_rows`` rows is walked in order by a task
      (few rows in all are walked without looking for components);
    * a larger component is thinned by rounds and split again. One with a hot
      key falls apart in a round or two; only a chain of more than ``task_rows``
      rows in ascending order takes rounds in proportion to its length.

    ``ord_col`` must be unique (rows are told apart by it); a repeated value
    raises ``ValueError``. A ``stored`` input is read again instead of written. Returns the kept rows of ``df`` (all columns).
    """
    name_c = F.col(name) if isinstance(name, str) else name
    url_c = F.col(url) if isinstance(url, str) else url
    # the walk and the final pick both read the input
    base = df.withColumn("_keys", F.array_distinct(dedup_keys(name_c, url_c, case_fold)))
    base = base if stored else write_table(base, "w5-base")
    if check_order:
        require_unique(base, ord_col, "greedy_two_key")
    undecided = base.select("_keys", F.col(ord_col).alias("_ord"))
    kept_parts: list[DataFrame] = []
    schema = T.StructType([T.StructField("_ord", base.schema[ord_col].dataType)])
    before = None
    while True:
        rest = _peeled(undecided, kept_parts)
        n_rest = rest.count()
        if not n_rest:
            break
        if n_rest > task_rows and (before is None or 2 * n_rest < before):
            undecided, before = rest, n_rest
            continue
        before = None
        nodes = F.transform("_keys", lambda k: F.xxhash64(k))
        if n_rest <= task_rows:
            small, large = rest.select(F.lit(0).cast("long").alias("_component"), "_keys", "_ord"), None
        else:
            pairs = rest.where(F.size("_keys") > 1).select(F.get(nodes, F.lit(0)).alias("a"), F.get(nodes, F.lit(1)).alias("b"))
            found = components(pairs).withColumnRenamed("component", "_found")
            placed = rest.withColumn("_node", nodes[0]).join(found, F.col("_node") == F.col("node"), "left")
            placed = cut_lineage(placed.select(F.coalesce("_found", "_node").alias("_component"), "_keys", "_ord"))
            sizes = placed.groupBy("_component").count().where(F.col("count") > task_rows).select("_component")
            sizes = cut_lineage(sizes)
            small = placed.join(sizes, "_component", "left_anti")
            large = None if sizes.isEmpty() else placed.join(sizes, "_component", "left_semi").select("_ord", "_keys")
        walked = (small.repartition(F.col("_component")).sortWithinPartitions("_component", "_ord")
                  .select("_component", "_keys", "_ord").mapInArrow(_walk(), schema))
        kept_parts.append(cut_lineage(walked))
        if large is None:
            break
        parts, undecided = _thinned(large, 2)
        kept_parts += parts
    kept_all = kept_parts[0]
    for k in kept_parts[1:]:
        kept_all = kept_all.unionByName(k)
    return base.join(kept_all.withColumnRenamed("_ord", ord_col), ord_col, "left_semi").drop("_keys")
