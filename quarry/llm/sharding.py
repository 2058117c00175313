"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Every row gets a global row number that depends on the rows alone, the permutation moves it to a place in
[0, n), and the place gives the shard (place mod shards) and the slot in it (place div shards). So the order is a
reproducible shuffle, shard counts differ by one at most, slots are gapless, and any place can be computed again
from a row number. Only DataFrame expressions are used.

Row numbers: rows are hashed into a fixed number of ranges of hash values, ranges are counted, and a row's number is
its range's start plus its rank in the range. No sort runs over the whole table and no task holds more than one range.
Rows that agree in all columns that matter are counted as one and expanded at the end, so that a third of all rows
being equal makes no large range.

Cases: null ids and texts are values of their own (size 1, crc of the empty text); repeated rows take adjacent
numbers; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.shared import stage

ROUNDS = 4
RANGES = 4096
EXPAND = 4096


def feistel(place: Column, side: Column, seed: int = 42) -> Column:
    """One pass of a Feistel network over [0, side * side): halves are digits to the base side, the round function is a keyed hash."""
    left, right = F.floor(place / side), place % side
    for i in range(ROUNDS):
        left, right = right, (left + F.pmod(F.xxhash64(right.cast("long"), F.lit(seed + i)), side)) % side
    return left * side + right


def permute(place: Column, n: Column, side: Column, seed: int = 42, walk: int = 128) -> Column:
    """The permutation of [0, n): pass again while the place lies outside.

    The square of the side exceeds n by 2 * sqrt(n) + 1 at most, so a pass leaves [0, n) with a chance of 2 / sqrt(n).
    walk bounds the passes; it is never reached (for n under 4,000 it exceeds the number of places outside, above that
    its chance is under 1e-190), and a row that did reach it would raise an error.
    """
    start = feistel(place, side, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), start.cast("long"), lambda p, _: F.when(p < n, p).otherwise(feistel(p, side, seed)))
    again = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))
    return F.when(start < n, start).otherwise(again)


def shard(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs with size, text_crc32, law, shard, slot and grown_shard (null: the law is `rows`)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    h = F.xxhash64("doc_id", "size", "text_crc32")
    kinds = stage(kinds.select("*", h.alias("h"), F.shiftrightunsigned(h, 52).cast("int").alias("range")), "shard-kinds")
    ranges = kinds.groupBy("range").agg(F.sum("copies").alias("n"))
    starts = ranges.select(
        "range",
        (F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )  # RANGES rows at most
    w = Window.partitionBy("range").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    side = F.ceil(F.sqrt(F.col("total").cast("double"))).cast("long")
    placed = (
        kinds.withColumn("before", F.sum("copies").over(w) - F.col("copies"))
        .join(F.broadcast(starts), "range")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / EXPAND))))
        .withColumn("k", F.explode(F.sequence(F.col("block") * EXPAND, F.least(F.col("copies"), (F.col("block") + 1) * EXPAND) - 1)))
        .withColumn("place", permute(F.col("start") + F.col("before") + F.col("k"), F.col("total"), side, seed))
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
