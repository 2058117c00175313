"""The domain frames that the named queries share, in Spark and as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table


#: Lines of orders that a task of a shuffle by commit takes, about.
LINES = 500_000


def commit_parts(spark: SparkSession, d: str) -> int:
    """Tasks of a shuffle of all touches by commit: they grow with the lines, so a task's memory doesn't."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), table(spark, d, "lineitem").count() // LINES + 1)


def touches(spark: SparkSession, d: str) -> DataFrame:
    """Files touched in commits: a part in an order; additions are the ordered quantity, the author is the customer."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"), "l_quantity").repartition(commit_parts(spark, d), "commit")  # noqa: E741
    l = l.groupBy("commit", "file").agg(F.sum("l_quantity").alias("adds"))  # noqa: E741
    return l.join(o, "commit")


TOUCHES = "SELECT l_orderkey AS commit, l_partkey AS file, sum(l_quantity) AS adds, any_value(o_orderdate) AS ts, any_value(o_custkey) AS author FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_partkey"


def files(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files with a container, a component, metrics, and coverage for two thirds of them."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("file"), F.col("p_brand").alias("container"), F.concat("p_brand", F.lit("/"), "p_type").alias("component"),
        F.col("p_size").cast("long").alias("loc"), (F.col("p_partkey") % 17).alias("complexity"),
        F.when(F.col("p_partkey") % 3 != 0, (F.col("p_partkey") % 101).cast("double")).alias("coverage"),
    )


FILES = "SELECT p_partkey AS file, p_brand AS container, p_brand || '/' || p_type AS component, CAST(p_size AS BIGINT) AS loc, p_partkey % 17 AS complexity, CASE WHEN p_partkey % 3 != 0 THEN CAST(p_partkey % 101 AS DOUBLE) END AS coverage FROM part"


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """Directed part graph: p1 -> p2 for adjoining lines of one order (p1 before p2), plus p2 -> p1 where (p1 + p2) mod 5 = 0."""
    l = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))  # noqa: E741
    e = l.join(l.select("l_orderkey", (F.col("n") - 1).alias("n"), F.col("p").alias("q")), ["l_orderkey", "n"]).where("p <> q")
    back = e.where("(p + q) % 5 = 0").select(F.col("q").alias("src"), F.col("p").alias("dst"))
    return e.select(F.col("p").alias("src"), F.col("q").alias("dst")).union(back).distinct()


PART_EDGES = """e0 AS (SELECT a.l_partkey AS p, b.l_partkey AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1 WHERE a.l_partkey <> b.l_partkey),
    edges AS (SELECT p AS src, q AS dst FROM e0 UNION SELECT q, p FROM e0 WHERE (p + q) % 5 = 0)"""


def kinds(df: DataFrame) -> DataFrame:
    """Part nodes with a kind by key."""
    k = F.col("p_partkey") % 5
    kind = F.when(k == 0, "class").when(k == 1, "function").when(k == 2, "method").when(k == 3, "module").otherwise("variable")
    return df.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_size").alias("lines"), F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).otherwise(F.col("p_partkey") - 1).alias("parent"))


KINDS = "SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'module' ELSE 'variable' END AS kind, p_size AS lines, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey - 1 END AS parent FROM part"
