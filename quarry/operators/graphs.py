"""Set-based graph operators: projections, paging, ranking, roll-ups, differences and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.intervals import narrowest


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes (id)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) counting parallel edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def subgraph_by_kind(nodes: DataFrame, edges: DataFrame, kinds: list[str], linked_kinds: list[str]) -> DataFrame:
    """Edges that touch a node of the kinds, or join two nodes of the kinds or linked kinds; decided on the first selection."""
    k = nodes.select("id", "kind")
    e = edges.join(k.select(F.col("id").alias("src"), F.col("kind").alias("sk")), "src").join(k.select(F.col("id").alias("dst"), F.col("kind").alias("dk")), "dst")
    touch = F.col("sk").isin(kinds) & F.col("dk").isin(kinds + linked_kinds) | F.col("dk").isin(kinds) & F.col("sk").isin(kinds + linked_kinds)
    return e.where(touch).select("src", "dst")


def top_degree_subgraph(edges: DataFrame, n: int) -> DataFrame:
    """The subgraph of the n nodes with most edges (ties: greatest id)."""
    top = degrees(edges).orderBy(F.desc("degree"), F.desc("id")).limit(n).select("id")
    return induced(edges, top)


def lift(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges between entities: cross product of both ends' memberships (id, entity), loops dropped, weights counted."""
    a = membership.select(F.col("id").alias("src"), F.col("entity").alias("a"))
    b = membership.select(F.col("id").alias("dst"), F.col("entity").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def importance(nodes: DataFrame, edges: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Symbol score: 2 * in + out + weight of the kind, +2 for a root, +1 each for more than 20 and 50 lines."""
    d = degrees(induced(edges, nodes))
    kind = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    s = nodes.join(d, "id", "left").na.fill(0, ["in_degree", "out_degree"])
    score = 2 * F.col("in_degree") + F.col("out_degree") + F.coalesce(F.try_element_at(kind, F.col("kind")), F.lit(1.0)) + F.when(F.col("parent").isNull(), 2).otherwise(0)
    return s.select("id", (score + (F.col("lines") > 20).cast("int") + (F.col("lines") > 50).cast("int")).alias("score"))


def page(nodes: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page (from 0) in a total order."""
    return nodes.orderBy(*order).offset(number * size).limit(size)


def cut_edges(edges: DataFrame, page_nodes: DataFrame) -> DataFrame:
    """How many edges stay within a page and how many cross its border."""
    a = page_nodes.select(F.col("id").alias("src"), F.lit(1).alias("s"))
    b = page_nodes.select(F.col("id").alias("dst"), F.lit(1).alias("d"))
    e = edges.join(a, "src", "left").join(b, "dst", "left")
    return e.agg(F.count_if(F.col("s").isNotNull() & F.col("d").isNotNull()).alias("inside"), F.count_if(F.col("s").isNotNull() != F.col("d").isNotNull()).alias("crossing"))


def merge_nodes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: new rows win over old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def drift(base: DataFrame, now: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """Full outer difference of two fact sets: added, removed, or changed by at least `least`; unchanged facts are left out."""
    j = base.select(key, F.col(value).alias("old")).join(now.select(key, F.col(value).alias("new")), key, "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.abs(F.col("new") - F.col("old")) >= least, "changed")
    return j.withColumn("delta", kind).where("delta is not null")


def enclosing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Narrowest range of the same file that holds each point: (point, range_id), by dyadic blocks."""
    return narrowest(points, ranges).select("point", "range_id")
