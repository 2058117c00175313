"""Vector search over cells: an inverted-file index for nearest neighbours, and an exact join of similar pairs.

Cells are k-means centres (cosine) fitted on a bounded sample; every vector is stored in the folder of its nearest centre. A
search probes the cells nearest to each query and ranks their vectors exactly, so only recall depends on the number of
probes (all cells: exact). Groups that meet are cut into blocks of `ROWS` on both sides, and each task multiplies two such
blocks, so a crowded cell is many tasks' work.

Similar pairs are exact: by the triangle inequality of angles, a vector within the angle of the threshold of x lies in a cell whose
radius plus that angle reaches x, so x visits just these cells. With clear clusters that is a few cells; without, all.

Cases: null ids and vectors, vectors with null entries and those of length 0 (norm) are left out; of equals the least id comes first; one dimension
a table is expected.
"""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.vectors import dot
from quarry.operators.iterate import materialize

#: Rows of the sample that centres are fitted on, and rows of a block.
SAMPLE, ROWS = 20_000, 2048
#: Rows of a block where all pairs meet, and those multiplied at a time.
WIDE, STRIP = 8192, 512


def usable(points: DataFrame, id_col: str, vec_col: str, *keep: str) -> DataFrame:
    """id, vector (doubles of norm 1) and kept columns."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    rows = points.where(F.col(id_col).isNotNull() & F.coalesce(F.forall(vec_col, lambda x: x.isNotNull()), F.lit(False)))
    norm = F.sqrt(dot(v, v))
    return rows.where(norm > 1e-12).select(F.col(id_col).alias("id"), F.transform(v, lambda x: x / norm).alias("vector"), *keep)


def fit_cells(points: DataFrame, cells: int, seed: int = 7) -> np.ndarray:
    """Centres (a row each, norm 1), from SAMPLE rows at most, the least by a hash of the id."""
    sample = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("vector").alias("features"))
    centres = np.array(KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=15).fit(sample).clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def nearest_cells(vector: Column, centres: np.ndarray, many: int) -> Column:
    """Numbers of the `many` nearest centres, nearest first."""

    @F.pandas_udf("array<int>")
    def near(vs: pd.Series) -> pd.Series:
        like = np.stack(vs.to_numpy()) @ centres.T if len(vs) else np.zeros((0, len(centres)))
        return pd.Series(list(np.argsort(-like, axis=1, kind="stable")[:, :many].astype(np.int32)))

    return near(vector)


def build(points: DataFrame, path: str, cells: int, id_col: str = "vec_id", vec_col: str = "embedding", spread: int = 8) -> None:
    """Write centres and vectors (in folders by cell) to new folders under path."""
    rows = materialize(usable(points, id_col, vec_col))
    centres = fit_cells(rows, cells)
    spark = points.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    placed = rows.withColumn("cell", nearest_cells(F.col("vector"), centres, 1)[0])
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(spread))).write.partitionBy("cell").parquet(f"{path}/vectors")


def centres_of(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # a row a cell
    return np.array([r["centre"] for r in rows])


def in_blocks(homes: DataFrame, visitors: DataFrame, keys: list[str], size: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with block numbers (h, v) so that every home meets every visitor of its key in one pair of blocks of about `size` rows."""
    count = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    grid = materialize(count(homes, "nh").join(count(visitors, "nv"), keys))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    a = homes.join(grid, keys).withColumn("h", own("nh")).withColumn("v", every("nv")).drop("nh", "nv")
    b = visitors.join(grid, keys).withColumn("v", own("nv")).withColumn("h", every("nh")).drop("nh", "nv")
    return a, b


def nearest(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, id_col: str = "qid", vec_col: str = "q") -> DataFrame:
    """qid, id, similarity and rank of each query's best k in the cells that it probes."""
    centres = centres_of(spark, path)
    asked = usable(queries, id_col, vec_col)
    asked = materialize(asked.withColumn("cell", F.explode(nearest_cells(F.col("vector"), centres, probes))))
    homes, visitors = in_blocks(spark.read.parquet(f"{path}/vectors"), asked, ["cell"])
    kind = queries.schema[id_col].dataType.simpleString()
    id_kind = homes.schema["id"].dataType.simpleString()

    def best(rows: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(qs):
            like = np.stack(qs["vector"].to_numpy()) @ np.stack(rows["vector"].to_numpy()).T
            ids = rows["id"].to_numpy()
            for q, row in zip(qs["id"], like, strict=True):
                top = np.lexsort((ids, -row))[:k]
                out.append(pd.DataFrame({"qid": q, "id": ids[top], "similarity": row[top]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "id": [], "similarity": []})

    key = ["cell", "h", "v"]
    found = homes.groupBy(*key).cogroup(visitors.groupBy(*key)).applyInPandas(best, f"qid {kind}, id {id_kind}, similarity double")
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(points: DataFrame, threshold: float, cells: int, id_col: str = "id", vec_col: str = "vector", block_col: str | None = None) -> DataFrame:
    """All pairs (a, b), a < b, of one block whose cosine similarity is at least the threshold (over 0)."""
    keep = [F.col(block_col).alias("block")] if block_col else [F.lit(0).alias("block")]
    rows = materialize(usable(points, id_col, vec_col, *keep))
    kind = rows.schema["id"].dataType.simpleString()
    if rows.isEmpty():
        return points.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
    centres = fit_cells(rows, cells)
    rows = materialize(rows.withColumn("cell", nearest_cells(F.col("vector"), centres, 1)[0]))

    @F.pandas_udf("double")
    def angle(vs: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series(np.arccos(np.clip((np.stack(vs.to_numpy()) * centres[own.to_numpy()]).sum(1), -1, 1)))

    radius = np.full(len(centres), -np.inf)
    for r in rows.groupBy("cell").agg(F.max(angle("vector", "cell")).alias("r")).collect():  # a row a cell
        radius[r["cell"]] = r["r"]
    reach = radius + np.arccos(threshold) + 1e-7

    @F.pandas_udf("array<int>")
    def visits(vs: pd.Series) -> pd.Series:
        away = np.arccos(np.clip(np.stack(vs.to_numpy()) @ centres.T, -1, 1))
        return pd.Series([np.flatnonzero(x).astype(np.int32) for x in away <= reach])

    visitors = materialize(rows.drop("cell").withColumn("cell", F.explode(visits("vector"))))
    homes, visitors = in_blocks(rows, visitors, ["cell", "block"])

    def meet(own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(came):
            return pd.DataFrame({"a": [], "b": []})
        like = np.stack(came["vector"].to_numpy()) @ np.stack(own["vector"].to_numpy()).T
        x, y = came["id"].to_numpy(), own["id"].to_numpy()
        i, j = np.nonzero((like >= threshold) & (x[:, None] < y[None, :]))
        return pd.DataFrame({"a": x[i], "b": y[j]})

    key = ["cell", "block", "h", "v"]
    return homes.groupBy(*key).cogroup(visitors.groupBy(*key)).applyInPandas(meet, f"a {kind}, b {kind}")


def nearest_distances(points: DataFrame, id_col: str, vec_col: str, block_col: str) -> DataFrame:
    """id and dist: the least cosine distance to a row of another id in the same block. Rows without id, block or vector are left out; a vector of length 0 is at distance 1.

    All pairs of a block are compared, as products of blocks of WIDE rows with each other, STRIP rows at a time; the nearest ones (ties within rounding) are
    measured again in the order of their entries, so distances are those of `cosine` and the same from both sides.
    """
    known = F.col(id_col).isNotNull() & F.col(block_col).isNotNull() & F.coalesce(F.forall(vec_col, lambda x: x.isNotNull()), F.lit(False))
    rows = points.where(known).select(F.col(id_col).alias("id"), F.col(block_col).alias("block"), F.col(vec_col).alias("vector"))
    homes, visitors = in_blocks(rows, rows.select(*(F.col(c).alias(c) for c in rows.columns)), ["block"], WIDE)
    kind = rows.schema["id"].dataType.simpleString()
    inner = lambda x, y: np.cumsum(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))

    def least(own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(came):
            x, y = (np.stack(t["vector"].to_numpy()).astype(float) for t in (came, own))
            ids, others = came["id"].to_numpy(), own["id"].to_numpy()
            nx, ny = np.sqrt(inner(x, x)), np.sqrt(inner(y, y))
            unit = (y / np.maximum(ny, 1e-12)[:, None]).T
            for a in range(0, len(x), STRIP):
                like = x[a : a + STRIP] / np.maximum(nx[a : a + STRIP], 1e-12)[:, None] @ unit
                like[ids[a : a + STRIP, None] == others[None, :]] = -np.inf
                i, j = np.nonzero(like >= np.maximum(like.max(axis=1), -2)[:, None] - 1e-12)
                for b in range(0, len(i), 1 << 16):
                    p, q = i[b : b + (1 << 16)] + a, j[b : b + (1 << 16)]
                    norms = nx[p] * ny[q]
                    exact = np.where(norms > 1e-12, inner(x[p], y[q]) / np.maximum(norms, 1e-300), 0.0)
                    out.append(pd.DataFrame({"id": ids[p], "dist": 1 - exact}).groupby("id", as_index=False).min())
        return pd.concat(out) if out else pd.DataFrame({"id": [], "dist": []})

    key = ["block", "h", "v"]
    met = homes.groupBy(*key).cogroup(visitors.groupBy(*key)).applyInPandas(least, f"id {kind}, dist double")
    return met.groupBy("id").agg(F.min("dist").alias("dist"))
