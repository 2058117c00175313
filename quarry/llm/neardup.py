"""Near-duplicate detection by SuperMinHash: signatures, banding, verification on full sets, union-find grouping.

Sets: the distinct word shingles of a whole text (a shorter text is one shingle), as 64-bit hashes that are computed
for a whole batch at once from its UTF-8 bytes.

Signatures: SuperMinHash. Each element visits the positions in the order of its own random permutation, with rank j
plus a random fraction at the j-th; a position keeps its least value. Ranks of one element are correlated, which lowers
the variance against independent minima, and a text is done (early stopping) as soon as all its positions hold a value
below the next rank: after one visit for long texts. Batches of texts run through the ranks together.

Candidates: equal sets are one node, known by a hash of the set. Bands of `rows` positions give bucket keys, and the
members of a bucket are compared as in `group_buckets`: first with one hub, then those in other components with their
likeliest partners, until every two members share a component or were compared (signatures that agree too little rule a
pair out, and so do marks, one bit a shingle, that differ in more places than the threshold allows).

Verification: pairs are joined with the full sets and linked if 100 * |intersection| >= percent * |union|.

Cases: null, empty and word-less texts have no shingle and are linked with nothing; a null id is never a
representative (its rows get the least id that shares their set, or null); rows that repeat an id and a text are alike, and
with other texts each row is judged by its own text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import map_texts, utf8
from quarry.llm.shared import bound_batches, crowded, group_buckets, stage

U = np.uint64
#: Ids of candidate documents are broadcast up to so many rows (32 MB); beyond it the joins on them are shuffled.
BROADCAST_IDS = 2_000_000
#: Fixed odd 64-bit multipliers.
BYTE, MIX1, MIX2, STEP = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)
#: Longs of a set's marks: 1,024 bits tell sets of a few hundred shingles apart that are just below the threshold.
MARKS = 16
UNSET = U(0xFFFFFFFFFFFFFFFF)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each value, sorted, one after the other, and how many each value has."""
    data, starts = utf8(column)
    n = len(starts) - 1
    if not len(data):
        return np.zeros(0, U), np.zeros(n, np.int64)
    white = WHITE[data]
    edge = np.diff(white.astype(np.int8), prepend=np.int8(1))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    last = last[last > 0] if len(last) > len(first) else last
    # word hash: its bytes as a polynomial in an odd multiplier mod 2**64, from prefix sums
    power = np.full(len(data), BYTE)
    power[0] = U(1)
    power = np.multiply.accumulate(power)
    sums = np.append(U(0), np.add.accumulate((LOWER[data].astype(U) + U(1)) * power))
    unit = np.full(int(first[-1]) + 1 if len(first) else 1, U(pow(int(BYTE), -1, 1 << 64)))
    unit[0] = U(1)
    word = mix((sums[last] - sums[first]) * np.multiply.accumulate(unit)[first] + (last - first).astype(U))
    doc = np.searchsorted(starts, first, side="right") - 1
    per = np.bincount(doc, minlength=n)
    # a shingle begins at every word with enough words after it, and at the first word of a short text
    begin = np.cumsum(per) - per
    rank = np.arange(len(word)) - begin[doc]
    starts_here = (rank + words <= per[doc]) | ((rank == 0) & (per[doc] < words))
    at = np.flatnonzero(starts_here)
    h = np.zeros(len(at), U)
    for k in range(words):
        there = rank[at] + k < per[doc[at]]
        h = h * STEP + np.where(there, word[np.minimum(at + k, len(word) - 1)] | U(1), U(0))
    h, own = mix(h), doc[at]
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], np.bincount(own[new], minlength=n)


def superminhash(elements: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """Signatures (texts x m) of sets given one after the other. A value is rank << 32 | random; unset positions are all ones."""
    n = len(sizes)
    sig = np.full(n * m, UNSET)
    x, doc = elements, np.repeat(np.arange(n), sizes)
    places = None
    for j in range(m):
        if not len(x):
            break
        r = mix(x + U((int(STEP) * (j + 1)) % (1 << 64)))
        k = j + ((r & U(0xFFFFFFFF)) * U(m - j) >> U(32)).astype(np.int64)
        if j == 0:
            place = k
        else:  # one step of each element's shuffle of the positions
            row = np.arange(len(x))
            place = places[row, k]
            places[row, k] = places[:, j]
        np.minimum.at(sig, doc * m + place, (U(j) << U(32)) | (r >> U(32)))
        worst = sig.reshape(n, m).max(1) >> U(32)
        going = (worst > U(j))[doc]
        if j == 0:
            x, doc, k = x[going], doc[going], k[going]
            places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
            places[np.arange(len(x)), k] = 0  # the first swap; position 0 itself is spent
        elif not going.all():
            x, doc, places = x[going], doc[going], places[going]
    return sig.reshape(n, m)


def set_hashes(h: np.ndarray, sizes: np.ndarray) -> dict:
    """n_shingles and two hashes of each whole set."""
    ends = np.append(0, np.cumsum(sizes))
    total = lambda v: np.diff(np.append(U(0), np.add.accumulate(v))[ends]).view(np.int64)
    return {"n_shingles": sizes, "set_a": total(mix(h + U(1))), "set_b": total(mix(h ^ STEP))}


def node() -> Column:
    """The id of a set."""
    return F.xxhash64("set_a", "set_b", "n_shingles").alias("u")


def sign(docs: DataFrame, words: int, bands: int, rows: int, positions: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, u (the set), the bucket keys of its bands and 8 bits of each position (empty for an empty set)."""

    def f(part: pa.RecordBatch) -> dict:
        h, sizes = shingles(part.column("text"), words)
        whole = superminhash(h, sizes, positions)
        sig = whole[:, : bands * rows].reshape(len(sizes), bands, rows)
        key = np.arange(bands, dtype=U)[None, :] + U(1)
        for i in range(rows):
            key = mix(key * STEP + sig[:, :, i])
        some = sizes > 0
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some * x.shape[1])).astype(np.int32)), pa.array(x[some].reshape(-1).view(np.int64)))
        short = (whole & U(255)).astype(np.uint8)
        return set_hashes(h, sizes) | {"bands": lists(key), "short": lists(short.view(np.int64))}

    out = map_texts(docs, f, "n_shingles long, set_a long, set_b long, bands array<long>, short array<long>", ["doc_id", "text_hash"], limit=2 << 20)
    return out.select("doc_id", "text_hash", "n_shingles", node(), "bands", "short")


def sets(docs: DataFrame, words: int) -> DataFrame:
    """u, its shingle hashes, sorted, packed as 64-bit values, and marks: `MARKS` longs in which each shingle flips one bit. A row a document."""

    def f(part: pa.RecordBatch) -> dict:
        h, sizes = shingles(part.column("text"), words)
        ends = np.append(0, np.cumsum(sizes))
        bits = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * (64 * MARKS) + (h % U(64 * MARKS)).astype(np.int64), minlength=len(sizes) * 64 * MARKS)
        flat = np.packbits((bits & 1).astype(np.uint8)).view(np.int64)
        marks = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * MARKS), pa.array(flat))
        return set_hashes(h, sizes) | {"marks": marks, "packed": [h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]}

    return map_texts(docs, f, "n_shingles long, set_a long, set_b long, marks array<long>, packed binary", ["doc_id"]).select(node(), "n_shingles", "marks", "packed")


def verify(pairs: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs (u, v and other longs) that are similar enough by their full sets."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(names).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(packed.select("u", F.col("packed").alias("a")), "u")
    joined = joined.join(packed.select(F.col("u").alias("v"), F.col("packed").alias("b")), "v")
    return joined.select(*names, "a", "b").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, positions: int = 128, slack: float = 0.115) -> DataFrame:
    """positions: of the signature, a multiple of 8; the first bands * rows give buckets. Pairs whose signatures agree in a share of them under percent / 100 - slack (over three deviations) are not verified.

    Per row of docs: doc_id, n_shingles, component_id (the least id reachable over links), kept, n_links (links found from its set's node)
    and text_hash, which tells rows that repeat an id with other texts."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = stage(sign(docs, words, bands, rows, positions), "neardup-signed")
    nodes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("u").agg(F.min("doc_id").alias("first"), F.first(F.struct("bands", "short")).alias("sign"))
    nodes = stage(nodes.select("u", "first", "sign.*"), "neardup-nodes")

    entries = crowded(nodes.select("u", F.explode("bands").alias("bucket")), "neardup")
    ids = stage(entries.select("u").distinct().join(nodes.select("u", "first"), "u"), "neardup-ids")
    few = ids.count() <= BROADCAST_IDS
    some = lambda cols: F.broadcast(cols) if few else cols
    wanted = docs.join(some(ids.select(F.col("first").alias("doc_id")).distinct()), "doc_id", "left_semi")
    packed = stage(sets(wanted, words).join(some(ids.select("u")), "u", "left_semi").groupBy("u").agg(F.first(F.struct("n_shingles", "marks", "packed")).alias("x")).select("u", "x.*"), "neardup-sets")

    least = int((percent / 100 - slack) * positions)
    short = [F.col("short")[i].alias(f"s{i}") for i in range(positions // 8)]
    marks = [F.col("marks")[i].alias(f"mark{i}") for i in range(MARKS)]
    signs = nodes.select("u", *short).join(packed.select("u", F.col("n_shingles").alias("n"), *marks), "u")
    links, roots = group_buckets(entries, signs, lambda pairs: verify(pairs, packed, percent), least, "neardup", percent)
    firsts = roots.join(ids, "u")
    label = firsts.join(firsts.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("u", "component_id")
    degree = links.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count("*").alias("n_links"))
    label = nodes.select("u", "first").join(label, "u", "left").join(degree, "u", "left").select("u", F.coalesce("component_id", "first").alias("component_id"), "n_links")
    out = signed.select("doc_id", "text_hash", "n_shingles", "u").join(label, "u", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_hash")
