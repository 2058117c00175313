"""Iterative frames: materialised steps in the shared folder, and graph traversal by frontier joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import shared_dir


def materialize(df: DataFrame) -> DataFrame:
    """Write a step to the folder in spark.checkpoint.dir and read it back, so plans stay short and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of edges (src, dst), without loops and repeats."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").union(back).where("src <> dst").distinct()


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """(id, neighbor, direction) of nodes (id) over edges (src, dst): out, in or both."""
    out = edges.join(nodes, edges["src"] == nodes["id"]).select("id", F.col("dst").alias("neighbor"), F.lit("out").alias("direction"))
    into = edges.join(nodes, edges["dst"] == nodes["id"]).select("id", F.col("src").alias("neighbor"), F.lit("in").alias("direction"))
    both = {"out": [out], "in": [into], "both": [out, into]}[direction]
    return both[0].union(both[1]).distinct() if len(both) == 2 else both[0].distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, level) of all nodes within `depth` directed steps of the seeds (id). Pass undirected(edges) for either way."""
    seen = materialize(seeds.select("id").distinct().withColumn("level", F.lit(0)))
    for level in range(1, depth + 1):
        frontier = seen.where(F.col("level") == level - 1)
        step = edges.join(frontier, edges["src"] == frontier["id"]).select(F.col("dst").alias("id")).distinct()
        fresh = step.join(seen, "id", "left_anti").withColumn("level", F.lit(level))
        grown = materialize(seen.union(fresh))
        if grown.where(F.col("level") == level).isEmpty():
            return grown
        seen = grown
    return seen


def expand(edges: DataFrame, seeds: DataFrame, depth: int, limit: int) -> DataFrame:
    """Neighbourhood with a node limit: (id, level, relevance), nearest first, then by id; relevance falls by 0.2 a step."""
    found = bfs(edges, seeds, depth).orderBy("level", "id").limit(limit)
    return found.withColumn("relevance", 1.0 - 0.2 * F.col("level"))


def shortest_dag(edges: DataFrame, start: int, goal: int, max_hops: int) -> tuple[int, DataFrame] | None:
    """Length of the shortest paths from start to goal and the edges (hop, src, dst) that lie on one of them; None beyond max_hops.

    Two frontiers grow towards each other, always the smaller one next; levels are kept, not paths. Where they meet, the
    edges between neighbouring levels are walked back to both ends, so every edge that comes out lies on a whole shortest path.
    """
    spark = edges.sparkSession
    edges = edges.select("src", "dst")
    ways = {"f": edges, "b": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}
    seen = {side: spark.createDataFrame([(node, 0)], "id long, d int") for side, node in (("f", start), ("b", goal))}
    depth, width = {"f": 0, "b": 0}, {"f": 1, "b": 1}
    met = None if start != goal else seen["f"].select("id")
    while met is None:
        if depth["f"] + depth["b"] == max_hops:
            return None
        side = min("fb", key=lambda x: width[x])
        other = "b" if side == "f" else "f"
        front = seen[side].where(F.col("d") == depth[side])
        step = ways[side].join(front, F.col("src") == F.col("id")).select(F.col("dst").alias("id")).distinct()
        fresh = materialize(step.join(seen[side], "id", "left_anti").withColumn("d", F.lit(depth[side] + 1)))
        seen[side] = seen[side].union(fresh)
        depth[side], width[side] = depth[side] + 1, fresh.count()
        if not width[side]:
            return None
        both = materialize(fresh.join(seen[other].where(F.col("d") == depth[other]), "id", "left_semi").select("id"))
        met = None if both.isEmpty() else both
    hops, parts = depth["f"] + depth["b"], []
    for side in "fb":
        nodes = met
        for d in range(depth[side] - 1, -1, -1):  # towards the side's own end
            near = seen[side].where(F.col("d") == d).select(F.col("id").alias("src"))
            step = materialize(ways[side].join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").join(near, "src", "left_semi").distinct())
            parts.append(step.select(F.lit(d if side == "f" else hops - 1 - d).alias("hop"), *(("src", "dst") if side == "f" else (F.col("dst").alias("src"), F.col("src").alias("dst")))))
            nodes = step.select(F.col("src").alias("id")).distinct()
    out = parts[0] if parts else edges.select(F.lit(0).alias("hop"), "src", "dst").limit(0)
    for p in parts[1:]:
        out = out.union(p)
    return hops, materialize(out)


def shortest_path(edges: DataFrame, start: int, goal: int, max_hops: int) -> DataFrame:
    """One row (hops, path) if goal is within max_hops of start; of equally short paths the one with the least ids."""
    spark = edges.sparkSession
    found = shortest_dag(edges, start, goal, max_hops)
    if found is None:
        return spark.createDataFrame([], "hops int, path array<long>")
    path = [start]
    for hop in range(found[0]):  # one row a hop
        path.append(found[1].where((F.col("hop") == hop) & (F.col("src") == path[-1])).agg(F.min("dst")).first()[0])
    return spark.createDataFrame([(found[0], path)], "hops int, path array<long>")


def simple_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, cut: DataFrame, max_hops: int, fan_out: int) -> DataFrame:
    """Source-to-sink paths without repeated nodes: (source, sink, path, hops, confidence).

    Nodes of `cut` (sanitizers) are never entered; each node passes to its `fan_out` least targets; paths stop at a sink.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("src").orderBy("dst")
    usable = edges.select("src", "dst").distinct().join(cut.select(F.col("id").alias("dst")), "dst", "left_anti")
    usable = materialize(usable.withColumn("r", F.row_number().over(w)).where(F.col("r") <= fan_out).select("src", "dst"))
    ends = sinks.select(F.col("id").alias("end"), F.lit(True).alias("is_sink"))
    front = sources.select(F.col("id").alias("source"), F.col("id").alias("at"), F.array("id").alias("path"))
    done = []
    for hops in range(1, max_hops + 1):
        step = front.join(usable, front["at"] == usable["src"]).where(~F.array_contains("path", F.col("dst")))
        step = step.select("source", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        step = materialize(step.join(ends, step["at"] == ends["end"], "left").drop("end"))
        done.append(step.where("is_sink").select("source", F.col("at").alias("sink"), "path", F.lit(hops).alias("hops")))
        front = step.where("is_sink is null").select("source", "at", "path")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.withColumn("confidence", F.when(F.size("path") <= 4, "high").otherwise("medium"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) with the least id of each component, by alternating least-neighbour steps; isolated nodes are not returned."""
    both = materialize(undirected(edges))
    label = materialize(both.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(label, both["dst"] == label["id"]).groupBy("src").agg(F.min("component").alias("near"))
        hooked = label.join(near, label["id"] == near["src"]).select("id", F.least("component", "near").alias("c"))
        # pointer jumping: a label is replaced by its own label
        jump = hooked.select(F.col("id").alias("j"), F.col("c").alias("to"))
        new = materialize(hooked.join(jump, hooked["c"] == jump["j"], "left").select("id", F.least("c", F.coalesce("to", "c")).alias("component")))
        changed = new.join(label.withColumnRenamed("component", "old"), "id").where("component <> old")
        if changed.isEmpty():
            return new
        label = new


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(id, component) of nodes in directed cycles; the component is its greatest id.

    Rounds of trimming (nodes without in- or out-edges leave) and colouring: the greatest id is spread forward, then
    backward within its colour; what the backward pass reaches is a component and leaves the graph. Each round takes out
    at least one component, and rounds go on until no edge is left.
    """
    edges = materialize(edges.select("src", "dst").where("src <> dst").distinct())
    found = []
    while True:
        while True:  # trim
            kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            kept = materialize(kept.select("src", "dst"))
            same = kept.count() == edges.count()
            edges = kept
            if same:
                break
        if edges.isEmpty():
            break
        color = materialize(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("color", F.col("id")))
        while True:
            into = edges.join(color, edges["src"] == color["id"]).groupBy("dst").agg(F.max("color").alias("c"))
            new = materialize(color.join(into, color["id"] == into["dst"], "left").select("id", F.greatest("color", F.coalesce("c", "color")).alias("color")))
            moved = new.join(color.withColumnRenamed("color", "old"), "id").where("color <> old")
            stop = moved.isEmpty()
            color = new
            if stop:
                break
        inside = edges.join(color.select(F.col("id").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("cd")), "dst").where("cs = cd")
        inside = materialize(inside.select("src", "dst", F.col("cs").alias("color")))
        reach = bfs(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), inside.select(F.col("color").alias("id")).distinct(), 1 << 20)
        part = materialize(color.join(reach.select("id"), "id", "left_semi").withColumnRenamed("color", "component"))
        found.append(part)
        rest = edges.join(part.select(F.col("id").alias("src")), "src", "left_anti").join(part.select(F.col("id").alias("dst")), "dst", "left_anti")
        edges = materialize(rest.select("src", "dst"))
    if not found:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    sizes = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return out.join(sizes.select("component"), "component", "left_semi").select("id", "component")


def louvain_pass(edges: DataFrame, rounds: int = 10, resolution: float = 1.0) -> DataFrame:
    """(id, community) by synchronous modularity moves over weighted undirected edges (src, dst, w).

    Each round a node moves to the neighbouring community with the best gain k_in - resolution * k * K / 2m (ties: least
    label); nodes of one hash parity move in one round, which keeps pairs from swapping for ever.
    """
    from pyspark.sql.window import Window

    both = materialize(edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w")))
    strength = both.groupBy("src").agg(F.sum("w").alias("k")).withColumnRenamed("src", "id")
    two_m = strength.agg(F.sum("k").alias("two_m"))
    label = materialize(strength.withColumn("community", F.col("id")))
    for r in range(rounds):
        mass = label.groupBy("community").agg(F.sum("k").alias("mass"))
        to = both.join(label.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("w").alias("k_in"))
        own = label.select(F.col("id").alias("src"), "k", F.col("community").alias("own"))
        options = to.join(own, "src").join(mass, "community").crossJoin(F.broadcast(two_m))  # one row
        rest = F.when(F.col("community") == F.col("own"), F.col("mass") - F.col("k")).otherwise(F.col("mass"))
        options = options.withColumn("gain", F.col("k_in") - resolution * F.col("k") * rest / F.col("two_m"))
        best = options.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("gain"), "community"))).where("n = 1")
        moved = label.join(best.select(F.col("src").alias("id"), F.col("community").alias("to"), "gain"), "id", "left")
        turn = (F.pmod(F.xxhash64("id"), F.lit(2)) == r % 2) & (F.col("gain") > 0)
        label = materialize(moved.select("id", "k", F.when(turn, F.col("to")).otherwise(F.col("community")).alias("community")))
    return label.select("id", "community")
