"""Change-history analytics over touches (commit, ts, author, file, adds) and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.scalars import min_max


def change_metrics(touches: DataFrame, since: Column) -> DataFrame:
    """Per file in the window: commits, churn, authors, last change."""
    return touches.where(F.col("ts") >= since).groupBy("file").agg(
        F.count_distinct("commit").alias("commits"), F.sum("adds").alias("churn"), F.count_distinct("author").alias("authors"), F.max("ts").alias("last_ts")
    )


def ownership(touches: DataFrame) -> DataFrame:
    """Per file and author: additions, touches, last touch and share of the file's additions (of its touches if it has none)."""
    own = touches.groupBy("file", "author").agg(F.sum("adds").alias("additions"), F.count("*").alias("touches"), F.max("ts").alias("last_ts"))
    total = touches.groupBy("file").agg(F.sum("adds").alias("file_adds"))
    share = F.when(F.col("file_adds") > 0, F.col("additions") / F.col("file_adds")).otherwise(1.0)
    return own.join(total, "file").select("file", "author", "additions", "touches", "last_ts", share.alias("share"))


def dominant_owner(own: DataFrame, key: str = "file") -> DataFrame:
    """The author with the largest share, ties by additions, then least author."""
    best = F.max_by(F.struct("author", "share", "additions"), F.struct("share", "additions", (-F.col("author")).alias("a")))
    return own.groupBy(key).agg(best.alias("b")).select(key, F.col("b.author").alias("author"), F.col("b.share").alias("share"))


def bus_factor(contrib: DataFrame, key: str, threshold: float = 0.8) -> DataFrame:
    """Of (key, author, amount): the least number of top contributors that reach the threshold; 0 where nothing was contributed."""
    w = Window.partitionBy(key).orderBy(F.desc("amount"), "author").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(key)
    ranked = contrib.select(key, F.sum("amount").over(w).alias("upto"), F.row_number().over(Window.partitionBy(key).orderBy(F.desc("amount"), "author")).alias("r"), F.sum("amount").over(every).alias("total"))
    return ranked.groupBy(key).agg(F.coalesce(F.min(F.when((F.col("total") > 0) & (F.col("upto") >= threshold * F.col("total")), F.col("r"))), F.lit(0)).alias("bus_factor"))


def upper_percentile(df: DataFrame, value: str, p: float, by: list[str]) -> DataFrame:
    """Nearest upper rank: the value at index ceil((n - 1) * p) of the ascending list, per group."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return ranked.where(F.col("i") == F.ceil((F.col("n") - 1) * p)).select(*by, F.col(value).alias("percentile"))


def pairings(touches: DataFrame, entity: str, max_per_commit: int = 200, parts: int | None = None) -> DataFrame:
    """Temporal coupling: (a, b, co, jaccard, ratio_a, ratio_b) of entities that change in the same commits.

    A commit pairs at most its max_per_commit entities with most churn, which bounds the pairs of a commit (the cap is the
    measure's own definition); change counts take all commits. Pairs are made from a commit's sorted list, so commits are sorted
    once and never joined with themselves. parts: of the shuffle by commit, where touches aren't dealt by commit already.
    """
    touches = touches if parts is None else touches.repartition(parts, "commit")
    per = touches.groupBy("commit", entity).agg(F.sum("adds").alias("churn"))
    counts = per.groupBy(entity).agg(F.count("*").alias("n"))
    w = Window.partitionBy("commit").orderBy(F.desc("churn"), F.desc(entity))
    capped = per.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_per_commit)
    lists = capped.where("commit is not null").groupBy("commit").agg(F.array_sort(F.collect_list(entity)).alias("x")).where("size(x) > 1")
    later = lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))
    pairs = lists.select(F.explode(F.flatten(F.transform("x", later))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("co"))
    pairs = pairs.join(counts.select(F.col(entity).alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col(entity).alias("b"), F.col("n").alias("nb")), "b")
    return pairs.select("a", "b", "co", (F.col("co") / (F.col("na") + F.col("nb") - F.col("co"))).alias("jaccard"), (F.col("co") / F.col("na")).alias("ratio_a"), (F.col("co") / F.col("nb")).alias("ratio_b"))


def investment_utilization(entities: DataFrame) -> DataFrame:
    """Quadrants of (entity, avg_churn, avg_changes, coverage): investment from scaled churn and changes, utilization from coverage.

    Utilization is known only where at least 30 % of the entities have coverage.
    """
    x = entities.withColumn("lc", F.log1p("avg_churn"))
    s = x.agg(F.min("lc").alias("c0"), F.max("lc").alias("c1"), F.min("avg_changes").alias("f0"), F.max("avg_changes").alias("f1"), (F.count("coverage") / F.count("*")).alias("covered"))
    x = x.crossJoin(F.broadcast(s))  # one row
    x = x.withColumn("investment", 0.6 * min_max(F.col("lc"), F.col("c0"), F.col("c1")) + 0.4 * min_max(F.col("avg_changes"), F.col("f0"), F.col("f1")))
    x = x.withColumn("utilization", F.when(F.col("covered") >= 0.3, F.col("coverage") / 100))
    i, u = F.col("investment") >= 0.5, F.col("utilization") >= 0.5
    q = F.when(F.col("utilization").isNull(), "unknown").when(i & u, "strength").when(i, "overinvestment").when(u, "efficient_core").otherwise("opportunity_or_retire")
    return x.select("entity", "investment", "utilization", q.alias("quadrant"))


def file_coupling(relations: DataFrame) -> DataFrame:
    """Of relations (src, dst, src_file, dst_file): per file in, out, cohesion, instability, fan-in and fan-out."""
    out = relations.groupBy(F.col("src_file").alias("file")).agg(
        F.count("*").alias("outgoing"), F.count_if(F.col("src_file") == F.col("dst_file")).alias("internal"), F.count_if(F.col("src_file") != F.col("dst_file")).alias("coupling_out"), F.count_distinct("dst").alias("fan_out")
    )
    into = relations.groupBy(F.col("dst_file").alias("file")).agg(F.count_if(F.col("src_file") != F.col("dst_file")).alias("coupling_in"), F.count_distinct("src").alias("fan_in"))
    both = out.join(into, "file", "full_outer").na.fill(0)
    io = F.col("coupling_in") + F.col("coupling_out")
    return both.select(
        "file", "coupling_in", "coupling_out", "fan_in", "fan_out",
        F.when(F.col("outgoing") > 0, F.col("internal") / F.col("outgoing")).otherwise(1.0).alias("cohesion"),
        F.when(io > 0, F.col("coupling_out") / io).otherwise(0.0).alias("instability"),
    )


def weighted_rollup(metrics: DataFrame, levels: list[str], values: list[str], weight: str) -> DataFrame:
    """Weighted means (weight 1 where it is not positive) and the summed weight at every level of a hierarchy."""
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(1).cast("double")
    means = [(F.sum(F.when(F.col(v).isNotNull(), F.col(v) * w)) / F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in values]
    return metrics.rollup(*levels).agg(*means, F.sum(weight).alias(f"sum_{weight}"), F.count("*").alias("members"), F.grouping_id().alias("level"))


def line_duplication(texts: DataFrame, id_col: str = "doc_id", min_len: int = 8) -> DataFrame:
    """Share of each text's lines (squeezed, min_len or longer, no comments) that stand in two texts or more."""
    lines = texts.select(id_col, F.explode(F.split("text", "\n")).alias("l")).withColumn("l", F.regexp_replace(F.trim("l"), "[ \\t]+", " "))
    lines = lines.where((F.char_length("l") >= min_len) & ~F.col("l").rlike(r"^(#|//|\*|/\*|--)")).select(id_col, F.xxhash64("l").alias("h"))
    per = lines.groupBy("h", id_col).agg(F.count("*").alias("n"))
    shared = per.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h", F.lit(1).alias("dup"))
    return per.join(shared, "h", "left").groupBy(id_col).agg(F.sum("n").alias("lines"), (F.coalesce(F.sum(F.col("n") * F.col("dup")), F.lit(0)) / F.sum("n")).alias("ratio"))
