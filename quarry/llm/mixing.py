"""Mixing sources to target weights by a low-discrepancy source schedule.

Targets: the sources share the whole size of the corpus by weight, but no target exceeds `repeat` times its source's
size; the excess is shared again by weight (water filling, exact).

Blocks: each source's documents are put in a hashed order and read as one stream of tokens, cut into blocks of
`block` tokens; a source takes the first `target` tokens of the stream, read round and round, so it takes whole blocks
and one part of a block, and its number of schedule slots is known.

Schedule: slot i of 2**k has the van der Corput point v = (bits of i reversed); the points run through the cumulative
slot counts of the sources, so source s owns a range [from, to) of points and gets exactly its number of slots, spread
evenly over the schedule. A slot's rank among its source's slots is counted from the bits of i alone, without a sort:
the earlier slots fall into k classes with v fixed mod 2**m, and each class meets [from, to) a computable number of times.
The r-th slot of a source takes the r-th block of its stream; a join on (source, block) gives the documents of each slot.

Skew: streams are laid out in two levels (sums of hash ranges of each source, then windows inside a range), so a source
with a third of all rows is dealt over RANGES tasks.

Cases: a null source is a source of its own, last; null and word-less texts have size 0 and are taken 0 times; a corpus
without words has targets of 0; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.shared import stage, word_count

WEIGHTS = (5, 2, 1)
RANGES = 256
#: Source tables of up to so many rows are broadcast.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = 3) -> DataFrame:
    """From (source, source_size): s (place in code-point order, null last), weight, target. One row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("s") % len(weights)) + 1).cast("int"))
    rows = sizes.withColumn("s", (F.row_number().over(order) - 1).cast("int")).withColumn("weight", w.cast("long"))
    # sources in order of the level at which they reach their cap; those before the turning point are capped
    cap = F.col("source_size") * repeat
    by_level = Window.orderBy((cap / F.col("weight")).asc(), F.col("s"))
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumn("cap", cap).withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
    rows = rows.withColumn("w_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    rows = rows.withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("weight"))
    open_ = ~F.col("capped")
    rest = F.max(F.when(open_, F.col("left"))).over(every)
    w_open = F.max(F.when(open_, F.col("w_left"))).over(every)
    share = F.col("weight") * rest / w_open
    return rows.select("source", "s", "weight", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share.cast("double")).alias("target"))


def reversed_bits(i: Column, bits: Column) -> Column:
    """The bits of i, which has at most `bits`, in reverse order."""
    back = F.reverse(F.call_function("lpad", F.bin(i), bits.cast("int"), F.lit("0")))
    return F.coalesce(F.conv(back, 2, 10).cast("long"), F.lit(0).cast("long"))


def rank_below(i: Column, bits: Column, start: Column, end: Column) -> Column:
    """How many j < i have their van der Corput point in [start, end)."""

    def class_size(t: Column) -> Column:
        # j agrees with i above bit t, has 0 where i has 1 at t: the point is fixed mod 2**m, m = bits - t
        m = F.call_function("shiftleft", F.lit(1).cast("long"), (bits - t).cast("int"))
        head = F.call_function("shiftleft", F.call_function("shiftright", i, t) - 1, t)
        c = reversed_bits(head, bits)
        upto = lambda x: F.floor((x - 1 - c + m) / m)  # noqa: E731  points under x in the class
        return F.greatest(upto(end), F.lit(0)) - F.greatest(upto(start), F.lit(0))

    has = lambda t: F.call_function("mod", F.call_function("shiftright", i, t), F.lit(2)) == 1
    places = F.filter(F.sequence(F.lit(0), F.greatest(bits - 1, F.lit(0))), lambda t: (t < bits) & has(t))
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, t: a + class_size(t))


def layout(docs: DataFrame, seed: int) -> DataFrame:
    """Documents with their source's number and the place of their first token in the source's shuffled stream."""
    by = ["s", "range"]
    docs = docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_hash", "size")).withColumn("range", F.shiftrightunsigned("h", 56).cast("int"))
    sums = docs.groupBy(*by).agg(F.sum("size").alias("range_size"))
    starts = sums.select(*by, (F.sum("range_size").over(Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_size")).alias("range_start"))
    within = Window.partitionBy(*by).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return docs.withColumn("inside", F.sum("size").over(within) - F.col("size")).join(starts, by).withColumn("first", F.col("range_start") + F.col("inside")).drop("inside", "range_start", "h", "range")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """The slots in use: slot, s, rank, and the part of the source's stream they take: round, block_no, from_token, to_token."""
    need = F.floor("target").cast("long")
    a_round = F.ceil(F.col("source_size") / block).cast("long")
    rounds = F.floor(need / F.col("source_size")).cast("long")
    rest = need - rounds * F.col("source_size")
    s = sources.where("source_size > 0").select("s", "source_size", need.alias("need"), a_round.alias("a_round"), (rounds * a_round + F.ceil(rest / block)).cast("long").alias("slots"))
    s = s.withColumn("to_point", F.sum("slots").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0))).withColumn("from_point", F.col("to_point") - F.col("slots"))
    s = s.withColumn("bits", F.ceil(F.log2(F.greatest(F.sum("slots").over(Window.partitionBy()), F.lit(1)).cast("double"))).cast("int")).where("slots > 0")
    # a source owns the points from_point .. to_point - 1; reversing the bits of a point gives its slot
    runs = s.withColumn("run", F.explode(F.sequence(F.floor(F.col("from_point") / 4096), F.floor((F.col("to_point") - 1) / 4096))))
    # rows multiply after this shuffle, so their number says nothing of the work: a fixed number of tasks, never merged
    runs = runs.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run")
    lo, hi = F.greatest(F.col("from_point"), F.col("run") * 4096), F.least(F.col("to_point"), (F.col("run") + 1) * 4096) - 1
    points = runs.withColumn("point", F.explode(F.sequence(lo, hi))).withColumn("slot", reversed_bits(F.col("point"), F.col("bits")))
    ranked = points.withColumn("rank", rank_below(F.col("slot"), F.col("bits"), F.col("from_point"), F.col("to_point")))
    ranked = ranked.withColumn("round", F.floor(F.col("rank") / F.col("a_round"))).withColumn("block_no", F.col("rank") % F.col("a_round"))
    start = F.col("block_no") * block
    end = F.least(start + block, F.col("source_size"), F.col("need") - F.col("round") * F.col("source_size"))
    return ranked.select("slot", "s", "rank", "round", "block_no", start.alias("from_token"), end.alias("to_token"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = 3, block: int = 2048, seed: int = 42) -> DataFrame:
    """Every document with size, source_size, target, taken (its words in the mix, repeats counted), first_slot (null: not taken) and a hash of the text."""
    rows = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "mix-docs")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stage(targets(sizes, weights, repeat), "mix-sources")
    facts = sources.select(F.col("source").alias("_source"), "s", "source_size", "target")
    if sources.count() <= BROADCAST_SOURCES:  # else a shuffled join, whose large partitions adaptive execution splits
        facts = F.broadcast(facts)
    joined = rows.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = stage(layout(joined, seed), "mix-layout")
    slots = schedule(sources, block)
    # a document with words lies in a few blocks; several documents lie in a block
    parts = laid.where("size > 0").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))))
    over = F.least(F.col("to_token"), F.col("first") + F.col("size")) - F.greatest(F.col("from_token"), F.col("first"))
    taken = (
        parts.join(slots.hint("merge"), ["s", "block_no"])  # slots grow with the corpus and are never broadcast
        .withColumn("words", over)
        .where("words > 0")
        .groupBy("s", "first")
        .agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    )
    out = laid.join(taken.withColumnRenamed("s", "_s").withColumnRenamed("first", "_first"), (F.col("s") == F.col("_s")) & (F.col("first") == F.col("_first")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "text_hash")
