"""Full-text search over a stored inverted index with places: all terms required, ranked by cover density.

Index: one row a term and document with the term's places, in folders by a bucket of the term and sorted inside,
so a query reads the folders of its terms and there only the row groups that can hold them. A frequent term's rows are
dealt out to `SPREAD` tasks.

Rank: a cover is a shortest run of words that holds all terms; each gives WEIGHT / (1 + its words that are no terms of the
query), and a document's score is the sum. Covers come from running maxima over the places in order: for each place the
last place of every term so far, whose least begins the only cover that can end there; for each beginning the first end counts.

Pruning: a document has at most (number of terms) times (occurrences of its rarest term) covers, so counts alone
bound its score. The `PILOT` documents for each wanted one with the highest bounds are scored first; then only those whose bound
reaches the k-th of these scores. So results equal the exhaustive ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.stemming import analyze

WEIGHT = 0.1
BUCKETS, SPREAD, PILOT = 64, 8, 4


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, term, tf, places and n_words, a row a term of each document. Texts without terms give none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = Postings()
            for row, text in enumerate(batch.column("text").to_pylist()):
                held.add(row, text)
                if len(held.terms) > 1 << 16:
                    yield held.batch(batch.column("id"))
                    held = Postings()
            yield held.batch(batch.column("id"))

    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, term string, tf int, places array<int>, n_words int")


class Postings:
    """Rows of some texts as flat columns: places lie one after another, with the offset of each row."""

    def __init__(self) -> None:
        self.rows: list[int] = []
        self.terms: list[str] = []
        self.offsets: list[int] = [0]
        self.places: list[int] = []
        self.n_words: list[int] = []

    def add(self, row: int, text: str) -> None:
        found, n = analyze(text)
        for own in found.values():
            self.places += own
            self.offsets.append(len(self.places))
        self.terms += found
        self.rows += [row] * len(found)
        self.n_words += [n] * len(found)

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        offsets = np.array(self.offsets, np.int32)
        columns = [ids.take(pa.array(self.rows, pa.int64())), pa.array(self.terms, pa.string()), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(offsets, pa.array(self.places, pa.int32())), pa.array(self.n_words, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["id", "term", "tf", "places", "n_words"])


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> None:
    """Write the index of docs to a new folder."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few large row groups or sizes alone would give few tasks
    texts = docs.select(id_col, text_col).repartition(parts, id_col)
    rows = postings(texts, id_col, text_col).withColumn("bucket", bucket(F.col("term"), buckets))
    dealt = rows.repartition(parts, "bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "id")
    dealt.write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows of some terms; other buckets are not opened."""
    own = spark.createDataFrame([(t,) for t in terms], "t string").select(bucket(F.col("t"), buckets)).collect()  # a row a term of the query
    return spark.read.parquet(path).where(F.col("bucket").isin([r[0] for r in own]) & F.col("term").isin(terms)).drop("bucket")


def covers(rows: DataFrame, terms: list[str]) -> DataFrame:
    """id, begin and end (places) and noise (words that are no terms) of every cover of documents that hold all terms."""
    places = rows.select("id", "term", F.explode("places").alias("place"))
    order = Window.partitionBy("id").orderBy("place")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("term") == t, F.col("place"))).over(so_far).alias(f"last{i}") for i, t in enumerate(terms)]
    seen = places.select("id", "place", F.row_number().over(order).alias("nth"), *last)
    ends = reduce(lambda a, b: a & b, [F.col(f"last{i}").isNotNull() for i in range(len(terms))])
    begin = F.least(*(F.col(f"last{i}") for i in range(len(terms)))) if len(terms) > 1 else F.col("last0")
    open_ = seen.where(ends).select("id", begin.alias("begin"), F.col("place").alias("end"), F.col("nth").alias("to"))
    first = open_.groupBy("id", "begin").agg(F.min("end").alias("end"), F.min("to").alias("to"))
    at = seen.select("id", F.col("place").alias("begin"), F.col("nth").alias("from"))
    return first.join(at, ["id", "begin"]).select("id", "begin", "end", (F.col("end") - F.col("begin") - (F.col("to") - F.col("from"))).alias("noise"))


def scored(rows: DataFrame, terms: list[str]) -> DataFrame:
    """id and score, covers summed from the first to the last."""
    parts = covers(rows, terms).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("begin", "noise"))).alias("c"))
    return parts.select("id", F.aggregate("c", F.lit(0.0), lambda a, x: a + WEIGHT / (1 + x["noise"])).alias("score"))


def search(spark: SparkSession, path: str, query: str, k: int = 50, allowed: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """id, score and rank of the best k documents that hold all terms of a query (ties: the least id).

    allowed (id): only these documents are searched. A query without terms finds nothing.
    """
    terms = sorted(analyze(query)[0])
    own = read(spark, path, terms or [""], buckets)
    if not terms:
        return own.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    own = own if allowed is None else own.join(allowed.select("id").distinct(), "id", "left_semi")
    bounds = own.groupBy("id").agg(F.count("*").alias("n"), F.min("tf").alias("least")).where(F.col("n") == len(terms)).select("id", (F.col("least") * (WEIGHT * len(terms))).alias("bound"))
    pilot = bounds.orderBy(F.desc("bound"), "id").limit(PILOT * k)
    known = scored(own.join(pilot, "id", "left_semi"), terms).orderBy(F.desc("score"), "id").limit(k).agg(F.min("score"), F.count("*")).first()
    # with fewer than k scores nothing can be left out; rounding must not cut a tie
    rest = bounds if known[1] < k else bounds.where(F.col("bound") >= known[0] * (1 - 1e-9))
    best = scored(own.join(rest, "id", "left_semi"), terms).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
