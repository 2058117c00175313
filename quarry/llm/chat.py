"""Chat formatting: cumulative snapshots are collapsed before conversations are rendered.

Chat logs often hold a conversation again after each turn. Rolling hashes over the turns give every prefix of every
conversation a key; a conversation whose whole key is a proper prefix of another one goes (anti-join), and of equal
conversations the one with the least id stays. What is left is rendered with role markers.

Rolling hash: turn i of a conversation is hashed together with i, and the prefix key is the xor of the first t hashes
in two independent 64-bit halves, so it is a plain windowed aggregate. Prefix rows are reduced to distinct keys with
counts before anything is joined, so a first turn or a whole conversation that a third of the table shares meets the
join as one row.

Cases: rows without a conversation id are left out; null roles read as "unknown" and null texts as empty; turns are
ordered by turn number (nulls first), then role, then text, so ties and repeated turns are kept in a fixed order; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.shared import stage


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, t (1 for the first turn), n (turns of the conversation), role, text and the prefix key (a, b) through turn t."""
    role = F.coalesce(F.lower(F.trim("role")), F.lit("unknown"))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("t", F.row_number().over(order).cast("long"))
    one = rows.select(
        "*",
        F.xxhash64("t", "role", "text").alias("ha"),
        F.conv(F.substring(F.sha2(F.concat_ws("\u0001", "t", "role", "text"), 256), 1, 15), 16, 10).cast("long").alias("hb"),
    )
    upto = Window.partitionBy("conv_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("conv_id")
    return one.select("conv_id", "t", F.max("t").over(every).alias("n"), "role", "text", F.bit_xor("ha").over(upto).alias("a"), F.bit_xor("hb").over(upto).alias("b"))


def collapse(hashed: DataFrame) -> DataFrame:
    """The maximal conversations: conv_id, n, and how many equal logs stand behind each."""
    whole = hashed.where("t = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    inner = hashed.where("t < n").select(F.col("t").alias("n"), "a", "b").distinct()
    return whole.join(inner, ["n", "a", "b"], "left_anti").select("conv_id", "n", "n_equal")


def chat_format(conversations: DataFrame) -> DataFrame:
    """One row a maximal conversation: conv_id, n_turns, n_equal (logs equal to it, itself included), n_chars, rendered."""
    hashed = stage(prefix_hashes(conversations), "chat-prefixes")
    kept = collapse(hashed)
    turn = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
    rendered = (
        hashed.select("conv_id", "t", turn.alias("turn"))
        .join(kept, "conv_id")
        .groupBy("conv_id", "n", "n_equal")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "turn"))), lambda x: x["turn"]), "\n").alias("rendered"))
    )
    return rendered.select("conv_id", F.col("n").alias("n_turns"), "n_equal", F.char_length("rendered").cast("long").alias("n_chars"), "rendered")
