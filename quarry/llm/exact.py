"""Exact dedup: a minimal perfect hash over the distinct digests of the history, and lookups that compare whole digests.

The history is what an earlier load has settled; the new load is checked against it. Texts count as equal when their
SHA-256 digests and byte lengths agree. Both sides are reduced to distinct digests in each task before any shuffle, so a
text that is a third of all rows is a row a task.

Index: digests are dealt out to shards of about `SHARD_KEYS`. A shard's minimal perfect hash is a stack of bit arrays: a
key that falls alone on a place of a level sets its bit there, the others go on to the next, smaller level; a key's slot is
the number of set bits before its own. So n keys get the slots 0 to n - 1, and slot i holds the whole digest, the byte
length, the locator (id) of the winner and the number of rows. The index is a table, a row a shard, and can be stored and used for
later loads.

Lookup: the shard's rows of both sides meet in one task. A digest that no level knows, or whose slot holds another digest
(all bytes are compared), is no member; members are repeats of the history and are added to their slot; nonmembers are
grouped by themselves. A stored index keeps its number of shards; a larger new load is dealt out to blocks of each shard.

Of equal texts the row with the largest id stays. Cases: null text is the empty one; a null id is below every id, so such
rows stay only where all rows of the text have none; rows that repeat an id and a text are one document, and each is
marked as kept; an empty table gives an empty result; without history all are nonmembers; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quarry.llm.neardup import mix
from quarry.llm.shared import stage

U = np.uint64
#: Keys of a shard of the index, and digests of a new load that meet one shard in a task.
SHARD_KEYS, BLOCK_KEYS = 1024, 1 << 16
#: Places of a level for each key that reaches it.
GAMMA = 2
INDEX = "shard int, sizes array<long>, bits binary, digests binary, length array<long>, winner array<long>, n_rows array<long>"
FOUND = "digest binary, keep_id long, group_size long, member boolean"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes) and length in bytes of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("length"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """A row a digest: length, winner (the largest id) and n_rows."""
    return rows.groupBy("digest", "length").agg(F.max("doc_id").alias("winner"), F.count("*").alias("n_rows"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """32-byte values as rows of bytes."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, 32)


def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The place of each key (a row of four 64-bit words) in a level."""
    h = np.full(len(keys), (0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64), U)
    for k in range(4):
        h = mix(h ^ keys[:, k])
    return (h % U(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and the bits of all levels, for distinct keys."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = GAMMA * len(left)
        at = places(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 for those that no level knows."""
    rank = np.cumsum(bits) - bits
    out = np.full(len(keys), -1)
    left, start = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = start + places(keys[left], level, size)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + size
    return out


def by_bytes(first: int, n: int) -> Column:
    """A number below n from four bytes of the digest, which tasks can compute as well (`word`)."""
    return F.pmod(F.conv(F.hex(F.substring("digest", first, 4)), 16, 10).cast("long"), F.lit(n)).cast("int")


def word(raw: np.ndarray, first: int) -> np.ndarray:
    return raw[:, first - 1 : first + 3].copy().view(">u4")[:, 0].astype(np.int64)


def build_index(known: DataFrame, n_shards: int) -> DataFrame:
    """The index over `distinct_digests`, a row a shard that has keys."""
    schema = to_arrow_schema(_parse_datatype_string(INDEX))

    def build(t: pa.Table) -> pa.Table:
        raw = matrix(t.column("digest"))
        sizes, bits = perfect_hash(raw.view(U))
        order = np.argsort(slots(raw.view(U), sizes, bits))
        row = {"shard": t.column("shard")[0].as_py(), "sizes": sizes, "bits": np.packbits(bits).tobytes(), "digests": raw[order].tobytes()}
        row |= {c: t.column(c).to_numpy()[order].tolist() for c in ("length", "winner", "n_rows")}
        return pa.Table.from_pylist([row], schema=schema)

    return known.withColumn("shard", by_bytes(1, n_shards)).groupBy("shard").applyInArrow(build, INDEX)


def look_up(fresh: DataFrame, index: DataFrame, n_shards: int, blocks: int = 1) -> DataFrame:
    """Every digest of the index and of `fresh` (`distinct_digests`) once: digest, keep_id, group_size and member (whether the history holds it)."""
    schema = to_arrow_schema(_parse_datatype_string(FOUND))

    def table(digest: list[bytes], keep: pa.Array, size: np.ndarray, member: bool) -> pa.Table:
        return pa.Table.from_arrays([pa.array(digest, pa.binary()), keep, pa.array(size, pa.int64()), pa.array([member] * len(digest), pa.bool_())], schema=schema)

    def meet(t: pa.Table, new: pa.Table) -> pa.Table:
        raw, size, keep = matrix(new.column("digest")), new.column("n_rows").to_numpy(), new.column("winner").combine_chunks()
        if not t.num_rows:
            return table(new.column("digest").to_pylist(), keep, size, False)
        row = t.to_pylist()[0]
        held, lengths, winners, counts = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32), *(np.array(row[c]) for c in ("length", "winner", "n_rows"))
        slot = slots(raw.view(U), row["sizes"], np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool))
        member = slot >= 0
        member[member] = (held[slot[member]] == raw[member]).all(1) & (lengths[slot[member]] == new.column("length").to_numpy()[member])
        counts[slot[member]] += size[member]  # digests of a block are distinct, so slots are
        winners[slot[member]] = np.maximum(winners[slot[member]], pc.fill_null(keep, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)[member])
        own = np.flatnonzero(word(held, 5) % blocks == row["block"])  # every block meets the whole shard
        rest = pa.array(~member)
        return pa.concat_tables([table([held[i].tobytes() for i in own], pa.array(winners[own]), counts[own], True), table(new.column("digest").filter(rest).to_pylist(), keep.filter(rest), size[~member], False)])

    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = fresh.select("*", by_bytes(1, n_shards).alias("shard"), by_bytes(5, blocks).alias("block"))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, FOUND)


def decide(rows: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and in_history of each of `digests`' rows. Only digests of several rows are joined; the others decide themselves."""
    several = found.where("group_size > 1").select("digest", "keep_id", "group_size")
    joined = rows.join(several, "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_history")


def exact_dedup(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """A row for each of docs: doc_id, keep_id, group_size, kept, text_sha256, in_history.

    history: the condition on doc_id that tells the settled rows. Without it, the newer half of the range of ids is settled, as
    of equal texts the newest stays, and the older half is loaded after it.
    """
    rows = stage(digests(docs), "exact-digests")
    if history is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        history = F.lit(False) if low is None else F.col("doc_id") > (low + high) // 2
    rows = rows.withColumn("in_history", F.coalesce(history & F.col("doc_id").isNotNull(), F.lit(False)))
    known = stage(distinct_digests(rows.where("in_history")), "exact-known")
    fresh = stage(distinct_digests(rows.where("not in_history")), "exact-fresh")
    n_known, n_fresh = known.count(), fresh.count()
    n_shards = max(1, -(-n_known // SHARD_KEYS))
    index = stage(build_index(known, n_shards), "exact-index")
    blocks = max(1, -(-n_fresh // (n_shards * BLOCK_KEYS)))
    return decide(rows, stage(look_up(fresh, index, n_shards, blocks), "exact-found"))
