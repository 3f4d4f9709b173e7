"""Loading the driver tables and the query parameters shared with the SQL
twins in ``oracle.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..vocab import LISTING_KEEP, LISTING_SKIP

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Query parameters (ours: the fixture text is invented, so few of the
# reference's terms occur in it; its own lists are included unchanged).
AS_OF_ORDERS = "1998-08-02"
AS_OF_EVENTS = "2024-01-15"
AS_OF_DOCS = "2024-06-01"
DOC_KEEP = LISTING_KEEP + ["license", "date"]
DOC_SKIP = LISTING_SKIP + ["gnu", "secret"]
DOC_CFP_OPEN = ["apache license", "mit license", "submit now"]
DOC_CFP_CLOSED_WHEN_OPEN = ["version 2.0"]
DOC_CFP_CLOSED = ["gnu general public license", "cc by-nc"]
# (label, needles) in priority order, over "customer, nation, region" text
ROUTE_RULES = [
    ("San Francisco", ["america", "94"]),
    ("Berlin", ["europe"]),
    ("Munich", ["nation_1"]),
    ("London", ["asia"]),
    ("Dublin", ["nation_2"]),
]
# (category, needles) in priority order, over part types
CATEGORY_RULES = [("Metal", ["copper", "brass", "steel"]), ("Small", ["small"]), ("Promo", ["promo", "e"])]
ROUTE_DEMO_CITY = "San Francisco"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

# (label, needles) for the meetup run over the calendar / discovery locations
MEETUP_RULES = [
    ("San Francisco", ["city 1", "default 0"]),
    ("Berlin", ["city 2"]),
    ("Munich", ["city 3", "default 1"]),
    ("London", ["city 4"]),
    ("Dublin", ["city 5"]),
]
