"""Source plug-ins and fan-in.

A source is any ``(spark, cfg) -> DataFrame`` returning raw events. Sources
register with a name, a rank (the order their rows count as "first") and the
run modes they serve; ``collect_sources`` unions the enabled ones by name
(missing columns become NULL) and stamps ``source_rank``. With ``on_failure``
a source that fails is reported and left out, and the run goes on without it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import order_key
from ..schema import RAW_EVENT
from ..session import write_table
from ..vocab import SEED_EVENTS, SEED_SOURCES

SourceFn = Callable[[SparkSession, dict], DataFrame]


@dataclass
class Source:
    name: str
    rank: int
    fn: SourceFn
    modes: set[str] = field(default_factory=lambda: {"conference", "meetup"})


_REGISTRY: dict[str, Source] = {}


def source(name: str, rank: int, modes=("conference", "meetup")):
    """M5: decorator registering a raw-event source."""
    def reg(fn: SourceFn) -> SourceFn:
        _REGISTRY[name] = Source(name, rank, fn, set(modes))
        return fn
    return reg


def registered() -> list[Source]:
    return sorted(_REGISTRY.values(), key=lambda s: s.rank)


def conform_raw(df: DataFrame) -> DataFrame:
    """Give a source's rows the raw-event schema (missing columns NULL)."""
    if dict(df.dtypes).get("ord") in ("int", "bigint"):
        df = df.withColumn("ord", order_key("ord"))
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in RAW_EVENT.fields])


def union_sources(frames: list[tuple[int, DataFrame]]) -> DataFrame:
    """Union by name, each frame stamped with its rank."""
    parts = [conform_raw(df.withColumn("source_rank", F.lit(rank))) for rank, df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def collect_sources(spark: SparkSession, cfg: dict, mode: str, sources: list[Source] | None = None,
                    on_failure: Callable[[Source, Exception], None] | None = None) -> DataFrame:
    """Run the sources serving ``mode`` and concatenate them.

    Without ``on_failure`` the union is lazy and a failing source ends the run.
    With it each source's rows are written to the shared folder first, as rows
    are only then known to be whole; a source that raises while its plan is
    built or while it runs is handed to ``on_failure`` and gives no rows at
    all. If every source fails the result is empty."""
    chosen = [s for s in (sources or registered()) if mode in s.modes]
    frames = []
    for s in chosen:
        if on_failure is None:
            frames.append((s.rank, s.fn(spark, cfg)))
            continue
        try:
            frames.append((s.rank, write_table(conform_raw(s.fn(spark, cfg)), f"source-{s.rank}")))
        except Exception as e:  # a source is anyone's code: whatever it raises concerns it alone
            on_failure(s, e)
    return union_sources(frames) if frames else spark.createDataFrame([], RAW_EVENT)


def seed_events(spark: SparkSession) -> DataFrame:
    """The fixed seed events in raw-event shape (status may be NULL: it
    is then taken from the event's page, J7)."""
    rows = [(n, src, cat, loc, s, e, url, st, i)
            for i, ((n, url, loc, s, e, cat, st), src) in enumerate(zip(SEED_EVENTS, SEED_SOURCES), start=1)]
    return spark.createDataFrame(
        rows, "name string, source string, category string, raw_location string, raw_start_date string, "
              "raw_end_date string, website string, cfp_status string, ord long")


def feed_registry(feeds: DataFrame, label: F.Column, default_location: F.Column, *rank: F.Column) -> DataFrame:
    """S7 for landed files: one row per path with label, default location and
    rank (one or more columns, compared in order)."""
    return feeds.select("path", label.alias("label"), default_location.alias("default_location"),
                        order_key(*rank).alias("rank"))
