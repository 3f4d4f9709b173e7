"""Filter interaction audit by the Hart-Mas-Colell potential.

Five filters judge every document. The removal game of a part of the corpus
gives a coalition of filters the number of documents that at least one of them
fails. One pass turns each document into a mask of the filters it fails; masks
are counted, and everything else follows from 32 coalition values for each part:

* The potential of a coalition S is ``P(S) = (v(S) + sum of P(S without i)) /
  |S|``, with ``P(empty) = 0``. It is kept as the integer ``|S|! P(S)``, built
  up by coalition size.
* A filter's Shapley value is the grand potential minus the potential without
  that filter; times 120 it is the sum of its removals over all orders.
* A step of an order goes from one coalition to the next: the difference of
  their values is what the step removes, of good and toxic documents likewise.

The duplicate filter fails a document whose text a smaller id also has anywhere
in the table. Texts are compared by SHA-256. Only skinny rows are shuffled, and
every aggregate has a map-side part, so that a text, a part or a source that
holds a third of all rows is reduced before it moves.

Defined cases: a null text is the empty text; a null part is the empty string;
a row without an id is no copy and makes none, and has no labels; rows that
repeat an id and a text are all judged, none is a copy of the other; a document
with several label rows is good or toxic if one of them says so; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table

FILTERS = "ABCDE"
_FULL = (1 << len(FILTERS)) - 1
MEASURES = ("n", "good", "toxic")
BLANKS = " \t\n\x0b\x0c\r"


def content_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    failed = (n < 100, 100 * distinct < 80 * n,
              100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
              text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)), F.lit(0)).cast("int")


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of a part that fail just the
    filters of the mask. Mask 0 is what every filter keeps."""
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    judged = docs.select(docs[f"`{doc_id}`"].cast("long").alias("id"),
                         F.coalesce(docs[f"`{part}`"].cast("string"), F.lit("")).alias("part"),
                         F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), content_mask(body).alias("mask"))
    rows = judged.groupBy("digest", "mask", "part", "id").agg(F.count("*").alias("c"))
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                  F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    none = F.lit(0)
    labelled = (rows.where("id is not null").join(marks, "id", "left")
                .withColumns({m: F.coalesce(m, none) for m in ("good", "toxic")})
                .unionByName(rows.where("id is null").withColumns({m: none for m in ("good", "toxic")})))
    # after the first grouping an id is one row here, so the smallest id's row says how many are no copies
    kinds = labelled.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("c")).otherwise(0)).alias("with_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "c"))).alias("first"))
    kinds = write_table(kinds, "audit-kinds")
    # only texts of two rows or more can hold a copy
    first = (kinds.groupBy("digest").agg(F.min("first.id").alias("low"), F.sum("with_id").alias("rows"))
             .where("rows > 1").select("digest", "low"))
    first = write_table(first, "audit-texts")
    copies = F.when(F.col("low").isNull(), 0).otherwise(
        F.col("with_id") - F.when(F.col("first.id") == F.col("low"), F.col("first.c")).otherwise(0))
    split = kinds.join(first, "digest", "left").withColumn("copies", copies)
    sides = split.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), F.col("copies").alias("n")))).alias("s")).select("*", "s.*")
    return sides.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def coalition_values(counted: DataFrame) -> DataFrame:
    """One row per part: arrays of 32 values ``n``, ``good`` and ``toxic`` by
    coalition (documents that one of its filters fails), and the part's total."""
    def value(measure: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(measure)).otherwise(0))
                         for s in range(_FULL + 1)]).alias(measure)

    return counted.groupBy("part").agg(F.sum("n").alias("total"), *[value(m) for m in MEASURES])


def potentials(values: DataFrame) -> DataFrame:
    """The values with ``potential``, an array of ``|S|! P(S)`` by coalition.
    Coalitions are filled in by size, each from those without one of its filters."""
    known = values.withColumn("q0", F.lit(0).cast("long"))
    for size in range(1, len(FILTERS) + 1):
        level = {}
        for s in (s for s in range(_FULL + 1) if s.bit_count() == size):
            smaller = [F.col(f"q{s & ~(1 << i)}") for i in range(len(FILTERS)) if s >> i & 1]
            level[f"q{s}"] = F.element_at("n", s + 1) * factorial(size - 1) + sum(smaller[1:], smaller[0])
        known = known.withColumns(level)
    return known.select(*values.columns, F.array(*[f"q{s}" for s in range(_FULL + 1)]).alias("potential"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part."""
    # a row per part from here on
    game = potentials(coalition_values(masks(docs, labels, doc_id, text, part)))
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    steps = (game.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))))

    def coalition(holds) -> Column:
        """The filters of an order for whose place the test holds."""
        return sum((F.when(holds(F.instr("filter_order", name)), F.lit(1 << i)).otherwise(F.lit(0))
                    for i, name in enumerate(FILTERS)), F.lit(0))

    def at(column: str, s: Column) -> Column:
        return F.element_at(column, s + 1)

    before, after = coalition(lambda place: place < F.col("step")), coalition(lambda place: place <= F.col("step"))
    own = F.col("after") - F.col("before")
    steps = steps.withColumns({"before": before, "after": after})

    def lost(measure: str) -> Column:
        return at(measure, F.col("after")) - at(measure, F.col("before"))

    without = F.lit(_FULL) - own
    return steps.select(
        "part", "filter_order", "step", F.expr("substring(filter_order, step, 1)").alias("filter"),
        (F.col("total") - at("n", F.col("after"))).alias("kept"), lost("n").alias("removed"),
        (at("n", own) - lost("n")).alias("redundant"), (at("n", F.lit(_FULL)) - at("n", without)).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        # 120 (P(all) - P(without)) in integers: 5! P(all) - 5 * 4! P(without)
        (at("potential", F.lit(_FULL)) - len(FILTERS) * at("potential", without)).alias("shapley"))
