"""The corpus pipeline: five stages over `documents`, each reading all that its predecessor kept.

quality rules -> line dedup -> near-duplicate removal -> mixing sources to target weights -> SentencePiece ids.
Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. SQL cannot express the
stages (trained model, hashed order, tokenizer), so there is no ORACLE_SQL and tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import linededup, mixing, neardup, quality, sentencepiece
from quarry.llm.shared import spare, stage

ORACLE_SQL = None


def matching(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """docs joined with rows of (id, hash of the text, ...) that belong to them; null ids match null ids."""
    i, h = other.columns[:2]
    return docs.join(other, docs["doc_id"].eqNullSafe(other[i]) & (F.xxhash64(docs["text"]) == other[h]), how)


def named(docs: DataFrame, *names: str) -> list[str]:
    """Internal column names that docs doesn't have."""
    return [spare(docs, f"pipeline_{n}") for n in names]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the perplexity bands reject go. Rows are matched by id (null too) and text."""
    kept = quality.quality(docs).where("kept").select("doc_id", "text_hash").distinct().toDF(*named(docs, "id", "hash"))
    return matching(docs, kept, "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines, only the first in the corpus stays; documents stay, with what is left of their text."""
    return linededup.dedup_text(docs).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id, told by id and text.

    Of rows that repeat an id and a text one stays, the first by its other columns; only such rows are shuffled whole.
    """
    i, h, n = named(docs, "id", "hash", "n")
    kept = neardup.near_duplicates(docs, words=5, percent=80).where("kept").select("doc_id", "text_hash").distinct().toDF(i, h)
    rest = matching(docs, kept, "left_semi")
    keyed = rest.withColumn(h, F.xxhash64("text"))
    repeated = stage(keyed.groupBy(F.col("doc_id").alias(i), h).count().where("count > 1").select(i, h), "pipeline-repeated")
    if repeated.isEmpty():
        return rest.select(docs.columns)
    order = Window.partitionBy("doc_id", h).orderBy(*(c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map" not in kind), F.lit(0))
    several = matching(rest, repeated, "left_semi").withColumn(h, F.xxhash64("text")).withColumn(n, F.row_number().over(order)).where(F.col(n) == 1)
    return matching(rest, repeated, "left_anti").select(docs.columns).union(several.select(docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, once for each time it reads them (whole, also where it stops within one); others go."""
    i, h, times, k = named(docs, "id", "hash", "times", "k")
    taken = mixing.mix(docs).where("taken > 0").groupBy("doc_id", "text_hash").agg(F.max(F.ceil(F.col("taken") / F.col("size")).cast("int")).alias("times")).toDF(i, h, times)
    return matching(docs, taken, "inner").withColumn(k, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding gives the text again."""
    return sentencepiece.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mixing", source_mixing),
    ("sentencepiece", sentencepiece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
