"""Filter interaction audit: what each filter removes in every order of application, in long form with windows.

Each document gets a mask of the filters that it fails; equal masks of a part are one cell with counts, made in each task before the
shuffle, so from there on work grows with parts and masks, not with documents. Cells are unpivoted against the steps of
every order (five filters: 120 orders of 5 steps), and a running bit-or over the earlier steps of an order tells which
failures came before: a cell is removed at the first step whose filter it fails. Conditional sums over the cells of a part give each step's metrics, and
a window over the part's rows of one filter totals what it removes over all orders.

Filters: A under 200 words; B 100 * distinct words < 50 * words; C 100 * capitals (A-Z) > 3 * code points; D holds one of
`#$%&*|`; E its text is that of a smaller id anywhere in the table.

Cases: null texts are empty (0 words, fail A only, and E as copies of each other); a null lang is the empty string's part; a null id is neither smaller nor larger
than another, so such rows never fail E; rows that repeat an id and a text don't make each other fail; a document is
good or toxic if any row of labels with its id says so; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.shared import stage

#: The filters' letters; the bit of each in a mask is its place here.
FILTERS = "ABCDE"
WHITE = " \t\n\x0b\x0c\r"


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the mask of the filters A to D that each row fails."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split(F.trim("text", F.lit(WHITE)), r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    n = F.size("words")
    fails = [
        n < 200,
        100 * F.size(F.array_distinct("words")) < 50 * n,
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 3 * F.char_length("text").cast("long"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and how many documents fall there: n, good, toxic."""
    rows = stage(failures(docs), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    rows = rows.join(stage(first, "audit-first"), "digest", "left")  # a plain exchange on both sides: partitions of a hot text are split
    rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.select("doc_id", "part", "mask").join(said, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def bit(letter: Column) -> Column:
    """The bit of a filter in a mask."""
    return F.element_at(F.array(*(F.lit(1 << i) for i in range(len(FILTERS)))), F.instr(F.lit(FILTERS), letter))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = stage(cells(docs, labels), "audit-cells").withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("fails", F.col("mask").bitwiseAND(bit(F.col("letter"))))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    total = lambda count, when: F.coalesce(F.sum(F.when(when, F.col(count))), F.lit(0)).cast("long")
    fails, fresh = F.col("fails") != 0, F.col("earlier") == 0
    out = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total("n", fresh & ~fails).alias("kept"),
        total("n", fresh & fails).alias("removed"),
        total("n", ~fresh & fails).alias("redundant"),
        total("n", fails & (F.col("mask") == F.col("fails"))).alias("unique_fails"),
        total("good", fresh & fails).alias("good_lost"),
        total("toxic", fresh & fails).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")
