"""Findings, evidence, communities and entity resolution over set-based frames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.scalars import clamp
from quarry.operators.iterate import bfs, connected_components, materialize, undirected
from quarry.operators.vectorindex import similar_pairs

#: Keywords that make a statement write.
WRITES = re.compile(r"\b(insert|update|delete|merge|create|drop|alter|truncate|replace|set|call|load|refresh|cache|use|grant)\b", re.I)


def read_only_sql(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Run one SELECT or WITH statement over the given frames as views; anything else is refused."""
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    if not re.match(r"\s*(select|with)\b", bare, re.I) or WRITES.search(bare) or ";" in bare.strip().rstrip(";"):
        raise ValueError("only a single read-only query is allowed")
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql.strip().rstrip(";"))


def best_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def select_candidates(df: DataFrame, key: str, score: str, least: float, delta: float) -> DataFrame:
    """Candidates at or above `least` and within `delta` of the key's best; ambiguous where several stay."""
    w = Window.partitionBy(key)
    kept = df.withColumn("_best", F.max(score).over(w)).where((F.col(score) >= least) & (F.col(score) >= F.col("_best") - delta)).drop("_best")
    return kept.withColumn("ambiguous", F.count("*").over(w) > 1)


def community_profile(members: DataFrame) -> DataFrame:
    """Of (community, domain): size, dominant domain (most frequent, ties alphabetical), its ratio, number of domains."""
    n = members.groupBy("community", "domain").agg(F.count("*").alias("n"))
    return n.groupBy("community").agg(F.sum("n").alias("size"), F.min_by("domain", F.struct((-F.col("n")).alias("m"), "domain")).alias("dominant"), (F.max("n") / F.sum("n")).alias("ratio"), F.count("*").alias("domains"))


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Of members (id, community): inner edges over possible edges; 0 for a single member. edges: distinct undirected pairs."""
    a, b = (members.select(F.col("id").alias(x), F.col("community").alias(f"c_{x}")) for x in ("src", "dst"))
    inner = edges.join(a, "src").join(b, "dst").where("c_src = c_dst").groupBy(F.col("c_src").alias("community")).agg(F.count("*").alias("inner"))
    n = members.groupBy("community").agg(F.count("*").alias("n")).join(inner, "community", "left")
    possible = F.col("n") * (F.col("n") - 1) / 2
    return n.select("community", "n", F.when(possible > 0, F.coalesce("inner", F.lit(0)) / possible).otherwise(0.0).alias("cohesion"))


def resolve_entities(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Of (id, block, type, vector): (id, entity) by closing similar pairs of one block with agreeing types; entity is the least id."""
    fits = (F.col("ta") == F.col("tb")) | (F.col("ta") == "OTHER") | (F.col("tb") == "OTHER")
    pairs = similar_pairs(entities, threshold, 16, "id", "vector", "block")
    pairs = pairs.join(entities.select(F.col("id").alias("a"), F.col("type").alias("ta")), "a").join(entities.select(F.col("id").alias("b"), F.col("type").alias("tb")), "b").where(fits)
    cc = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return entities.select("id").join(cc, "id", "left").select("id", F.coalesce("component", "id").alias("entity"))


def evidence_support(evidence: DataFrame, key: str) -> DataFrame:
    """Of (key, score, provenance): clamp(.4 * min(n / 5, 1) + .4 * mean score + min(.1 * provenances, .3) + .1)."""
    n, p = F.count("*"), F.count_distinct("provenance")
    s = 0.4 * F.least(n / 5, F.lit(1.0)) + 0.4 * F.avg("score") + F.least(0.1 * p, F.lit(0.3)) + 0.1
    return evidence.groupBy(key).agg(clamp(s, 0.0, 1.0).alias("support"))


def bfs_order(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes in breadth-first order from start: (id, position), by level and id. One ordering pass over the reached nodes."""
    reached = bfs(undirected(edges), start, depth)
    per = reached.groupBy("level").agg(F.count("*").alias("n"))
    before = per.select("level", (F.sum("n").over(Window.orderBy("level")) - F.col("n")).alias("before"))  # a row a level
    inner = F.row_number().over(Window.partitionBy("level").orderBy("id"))
    return reached.join(F.broadcast(before), "level").select("id", (F.col("before") + inner - 1).alias("position"))


def processes(edges: DataFrame, depth: int = 4, branch: int = 3, keep: int = 75, entries: int = 200) -> DataFrame:
    """Longest simple paths from entry points: (path, length); contained paths are dropped.

    Entry points have edges out and none in; where every node has one in, those with the fewest in, then the most out, then the
    least ids; `entries` of them at most. Each node continues to its `branch` least targets, as the operator's definition bounds it.
    """
    out = edges.select("src", "dst").distinct()
    step_edges = materialize(out.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("r") <= branch).select("src", "dst"))
    ins = out.where("src <> dst").groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("n_in"))
    outs = out.where("src <> dst").groupBy("src").agg(F.count("*").alias("n_out")).join(ins, "src", "left").na.fill(0, ["n_in"])
    ranked = materialize(outs.orderBy("n_in", F.desc("n_out"), "src").limit(entries))
    first = ranked.where("n_in = 0")
    front = (ranked if first.isEmpty() else first).select(F.array("src").alias("path"))
    done = None
    for _ in range(depth - 1):
        grown = front.withColumn("at", F.element_at("path", -1)).join(step_edges, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        grown = materialize(grown.select(F.concat("path", F.array("dst")).alias("path")))
        # a path that goes on is contained in its continuation; those that end stay
        prefix = grown.select(F.slice("path", 1, F.size("path") - 1).alias("path")).distinct()
        ended = front.join(prefix, "path", "left_anti")
        done = ended if done is None else done.union(ended)
        front = grown
    done = done.union(front).where(F.size("path") >= 2)
    return done.select("path", F.size("path").alias("length")).orderBy(F.desc("length"), "path").limit(keep)


def random_projection(points: DataFrame, seed: int = 7) -> DataFrame:
    """(vec_id, x, y): projection on two coefficient vectors of a linear congruential generator, scaled to [-1, 1]."""
    dims = 64
    state, coef = seed, []
    for _ in range(2 * dims):
        state = (1_103_515_245 * state + 12_345) % (1 << 31)
        coef.append(state / (1 << 30) - 1.0)

    def along(c: list[float]) -> Column:
        return F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, c)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)

    p = points.select("vec_id", along(coef[:dims]).alias("x"), along(coef[dims:]).alias("y"))
    m = p.agg(F.max(F.abs("x")).alias("mx"), F.max(F.abs("y")).alias("my"))
    return p.crossJoin(F.broadcast(m)).select("vec_id", (F.col("x") / F.col("mx")).alias("x"), (F.col("y") / F.col("my")).alias("y"))  # one row
