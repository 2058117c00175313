"""What the operators share: tables written to the cluster's shared folder, a uniform hash, and distributed union-find."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import shared_dir

#: Words are runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches small enough that a batch of very long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Distributed union-find over edges (u, v): returns (node, root), root the least node of the component.

    Alternates large-star and small-star steps, each a grouped minimum (combined before the shuffle) and a join on the
    node, until the edges form stars. Nodes are longs; loops are ignored; a node without an edge is not returned.
    """
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = None
    while True:
        seen = Observation()
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = stage(small.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), name)
        now = seen.get
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        mark = now


#: The lowest bit of each byte of a long.
LOW_BITS = 0x0101010101010101


def packed_matches(a: list[Column], b: list[Column]) -> Column:
    """How many bytes agree in two lists of longs."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        d = x.bitwiseXOR(y)
        for by in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, by))
        total = total + 8 - F.bit_count(d.bitwiseAND(F.lit(LOW_BITS)))
    return total


def can_link(a: Callable[[str], Column], b: Callable[[str], Column], marks: int, percent: int) -> Column:
    """Whether two sets can have a Jaccard similarity of `percent`. False only for pairs that can't, so no link is lost.

    a and b give n (elements or more) and mark0, mark1, ..., longs in whose bits each element sets or flips one bit: bits that
    differ are at most the elements that only one set has, and those are at most (100 - percent) / (100 + percent) of n + n.
    """
    differ = [F.bit_count(a(f"mark{i}").bitwiseXOR(b(f"mark{i}"))) for i in range(marks)]
    room = (100 - percent) * (a("n") + b("n"))
    few = reduce(Column.__add__, differ[:4])  # most pairs end here
    return ((100 + percent) * few <= room) & ((100 + percent) * reduce(Column.__add__, differ[4:], few) <= room)


def crowded(entries: DataFrame, name: str) -> DataFrame:
    """Of entries (bucket, u) those whose bucket holds two nodes or more, with the number of members.

    Entries are dealt out once, by bucket; counting and picking both read that exchange.
    """
    dealt = entries.select("bucket", "u").repartition("bucket")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("members"), F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo < hi")
    return stage(dealt.join(sizes.select("bucket", "members").hint("shuffle_hash"), "bucket"), f"{name}-entries")


def grown(roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(node, root) after new links: components are nodes of a small graph, whose own components rename them."""
    at = lambda c: F.coalesce(F.col(f"{c}_root"), F.col(c))
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "uv"]
    short = links.join(ends[0], "u", "left").join(ends[1], "v", "left").select(at("u").alias("u"), at("v").alias("v")).where("u <> v")
    new = stage(components(short, f"{name}-cc"), f"{name}-merged").select(F.col("node").alias("old"), F.col("root").alias("to"))
    kept = roots.join(new, roots["root"] == new["old"], "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = new.join(roots.select(F.col("node").alias("old")), "old", "left_anti").select("old", "to")
    return stage(kept.union(fresh), f"{name}-roots")


def group_buckets(entries: DataFrame, nodes: DataFrame, verify: Callable[[DataFrame], DataFrame], least: int, name: str, percent: int, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """The components of nodes that share buckets, without making all pairs of a bucket.

    entries: bucket, u, members (see `crowded`). nodes: u, its signature s0, s1, ... (8 bits a position) and n, mark0, mark1, ... (see
    `can_link`); pairs that agree in fewer than `least` positions or can't reach `percent` are skipped. verify gets distinct
    pairs (u, v) and keeps the similar ones.

    First every member is compared with its bucket's hub, the member that meets most others over all its buckets: one pair
    a member, which joins groups of copies. A bucket is open while its members lie in several components; those outside its
    largest one are its outliers. Then, in rounds, each outlier's signature is held against all members of its open buckets
    (dealt out in blocks of about `block`, so a large bucket is many tasks' work), and its `most` likeliest partners in other
    components are verified, most likely first. A pair is met in one bucket only, the least that both have. An outlier is spent in
    a bucket when a round has verified every partner that it has left; the others go on with a larger `most`. So two members of a bucket end in one component, or were compared. Returns the links
    found (u, v) and (u, root) of the linked nodes, root being the least node of its component.
    """
    sig = [c for c in nodes.columns if c[0] == "s" and c[1:].isdigit()]
    marks = [c for c in nodes.columns if c.startswith("mark")]
    own = entries.groupBy("u").agg(F.array_sort(F.collect_list("bucket")).alias("buckets"))
    nodes = stage(nodes.select("u", *sig, "n", *marks).join(own, "u"), f"{name}-own")
    ends = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    mates = entries.groupBy("u").agg(F.sum("members").alias("mates"))
    hubs = entries.join(mates, "u").groupBy("bucket").agg(F.max(F.struct("mates", "u")).alias("hub")).select("bucket", F.col("hub.u").alias("v"))
    links = stage(verify(entries.join(hubs, "bucket").where("u <> v").select(*ends).distinct()), f"{name}-links")
    most, spent, roots = 8, None, stage(components(links, f"{name}-cc"), f"{name}-roots")
    while True:
        state = entries.select("bucket", "u").join(roots.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
        parts = state.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket")
        parts = parts.agg(F.max(F.struct("n", "root")).alias("major"), F.sum("n").alias("size"), F.count("*").alias("roots")).where("roots > 1")
        parts = parts.select("bucket", F.col("major.root").alias("major"), F.ceil(F.col("size") / block).cast("int").alias("blocks"))
        open_ = stage(state.join(parts, "bucket").join(nodes, "u"), f"{name}-open")
        if open_.isEmpty():
            return links, roots.withColumnRenamed("node", "u")
        dealt = open_.groupBy("bucket", F.pmod(F.xxhash64("u"), "blocks").cast("int").alias("block")).agg(F.collect_list(F.struct("u", "root", "buckets", *sig, "n", *marks)).alias("others"))
        outliers = open_.where("root <> major")
        outliers = outliers if spent is None else outliers.join(spent, ["u", "bucket"], "left_anti")
        asked = outliers.select("u", "bucket")
        outliers = outliers.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        alike = lambda x: packed_matches([F.col(c) for c in sig], [x[c] for c in sig])
        first = lambda x: F.get(F.array_intersect("buckets", x["buckets"]), F.lit(0)) == F.col("bucket")
        met_here = lambda x: (x["root"] != F.col("root")) & can_link(F.col, x.__getitem__, len(marks), percent) & first(x)
        rated = F.transform(F.filter("others", met_here), lambda x: F.struct((-alike(x)).alias("minus"), x["u"].alias("v")))
        best = F.slice(F.sort_array(F.filter(rated, lambda x: x["minus"] <= -least)), 1, most + 1)
        met = outliers.join(dealt, ["bucket", "block"]).select("u", F.explode(best).alias("x")).select("u", "x.*").distinct()
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("minus", "v")))
        ranked = stage(ranked.where(F.col("rank") <= most + 1).select("u", "v", "rank"), f"{name}-ranked")
        top = ranked.agg(F.max("rank")).first()[0] or 0
        if top:
            found = stage(verify(ranked.where(F.col("rank") <= most).select(*ends).distinct()), f"{name}-links")
            links, roots = links.union(found), grown(roots, found, name)
        if top <= most:
            return links, roots.withColumnRenamed("node", "u")
        done = asked.join(ranked.where(F.col("rank") > most).select("u"), "u", "left_anti")
        spent = stage(done if spent is None else spent.union(done), f"{name}-spent")
        most *= 64
