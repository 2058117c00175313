"""Embedding whitening: Welford moments in partition iterators, merged by the parallel formula, and a symmetric QR eigen-solve.

Entries c of a vector become the whole numbers x = floor(64 * c) + 1000000. Moments are taken over the distinct x vectors (the fit
list). Each task streams its vectors through rank-one updates of mean and centred products; the tasks' moments, a
d x d matrix each, are merged `FAN` bytes at a time in rounds of grouped merges, so no task or driver holds all of them.
Sums are whole numbers and exact. The covariance (one row) is solved on the driver: Householder tridiagonal form,
then implicit QR steps with Wilkinson's shift. A second pass of the same moments over the whitened fit list measures how far its
covariance is from the identity.

Cases: vectors that are null or hold a null, a NaN, an infinity or an entry of 2**40 or more in size are dropped; so are
those whose length is not the most frequent one (by rows; of equals the longer); a null id is kept; repeated rows are
rows of their own but count once in the fit list; directions without variance (eigenvalue at the level of rounding
errors) can't be whitened and give no row, so a single distinct vector gives none; an empty table gives an empty result; extra columns are
ignored. A deviation that is no 64-bit number raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import bound_batches, stage

SCALE, OFFSET, LIMIT = 64, 1_000_000, float(1 << 40)
#: Bytes of moments that a merging task holds at a time, two of them at least.
FAN = 64 << 20
MOMENTS = "part long, n long, high binary, low binary, mean binary, m2 binary"
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, x (whole numbers) and d (their count) of the rows whose entries are all finite."""
    fine = F.forall(vec_col, lambda c: F.abs(c.cast("double")) < LIMIT)  # null with a null entry
    x = F.transform(vec_col, lambda c: F.floor(SCALE * c.cast("double")) + OFFSET)
    return vectors.where(fine).select(F.col(id_col).alias("vec_id"), x.alias("x"), F.size(vec_col).alias("d"))


def rows_of(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class Moments:
    """Count, mean and centred products of a stream of vectors, and exact sums of whole ones."""

    def __init__(self, d: int) -> None:
        self.n, self.mean, self.m2 = 0, np.zeros(d), np.zeros((d, d))
        self.high, self.low = np.zeros(d, np.int64), np.zeros(d, np.int64)

    def add(self, rows: np.ndarray) -> None:
        """Rank-one updates, a vector at a time."""
        outer = np.empty_like(self.m2)
        for v in rows:
            self.n += 1
            delta = v - self.mean
            self.mean += delta / self.n
            np.multiply(delta[:, None], delta * ((self.n - 1) / self.n), out=outer)
            self.m2 += outer

    def add_sums(self, x: np.ndarray) -> None:
        """Sums in two parts of 20 and more bits, which don't overflow."""
        self.high += (x >> 20).sum(0)
        self.low += (x & 0xFFFFF).sum(0)

    def merge(self, other: Moments) -> None:
        """The parallel update."""
        n = self.n + other.n
        delta = other.mean - self.mean
        self.m2 += other.m2 + np.outer(delta, delta) * (self.n * other.n / n)
        self.mean += delta * (other.n / n)
        self.high, self.low, self.n = self.high + other.high, self.low + other.low, n

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n} | {k: getattr(self, k).tobytes() for k in ("high", "low", "mean", "m2")}

    @classmethod
    def of(cls, row: dict) -> Moments:
        self = cls(len(row["mean"]) // 8)
        self.n, self.high, self.low = row["n"], np.frombuffer(row["high"], np.int64), np.frombuffer(row["low"], np.int64)
        self.mean, self.m2 = np.frombuffer(row["mean"]).copy(), np.frombuffer(row["m2"]).reshape(self.m2.shape).copy()
        return self

    def sums(self) -> list[int]:
        return [(int(a) << 20) + int(b) for a, b in zip(self.high, self.low, strict=True)]


def moments(fit: DataFrame, d: int, project: np.ndarray | None = None, shift: np.ndarray | None = None) -> Moments | None:
    """The moments of fit's x (less OFFSET), or of (x - OFFSET - shift) @ project. None without rows."""
    width = d if project is None else project.shape[1]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments(width)
        for batch in batches:
            x = rows_of(batch.column("x"))
            m.add_sums(x) if project is None else None
            v = (x - OFFSET).astype(float)
            m.add(v if project is None else (v - shift) @ project)
        if m.n:
            yield pa.RecordBatch.from_pylist([m.row(TaskContext.get().partitionId())])

    def merge(t: pa.Table) -> pa.Table:
        own = sorted(t.to_pylist(), key=lambda r: r["part"])
        m = Moments.of(own[0])
        for r in own[1:]:
            m.merge(Moments.of(r))
        return pa.Table.from_pylist([m.row(own[0]["part"] // fan)])

    fan = max(2, FAN // (8 * width * width))
    parts = stage(fit.select("x").mapInArrow(stream, MOMENTS), "whiten-moments")
    while (n := parts.count()) > 1:
        parts = stage(parts.groupBy(F.floor(F.col("part") / fan)).applyInArrow(merge, MOMENTS), "whiten-moments")
    return Moments.of(parts.first().asDict()) if n else None


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and q with q.T @ a @ q tridiagonal, by Householder reflections."""
    a, q = a.copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns; the largest entry of each is positive."""
    diag, off, q = tridiagonal(a)
    q = q.T.copy()  # rows are the vectors, so that rotations work on whole rows
    floor = np.finfo(float).eps * max(np.abs(diag).max(initial=0), np.abs(off).max(initial=0)) * 0.01
    hi = len(diag) - 1
    while hi > 0:
        small = np.abs(off) <= np.maximum(floor, np.finfo(float).eps * 0.5 * np.minimum(np.abs(diag[:-1]), np.abs(diag[1:])))
        off[small] = 0
        while hi > 0 and off[hi - 1] == 0:
            hi -= 1
        if hi == 0:
            break
        lo = hi - 1
        while lo > 0 and off[lo - 1] != 0:
            lo -= 1
        half = (diag[hi - 1] - diag[hi]) / 2
        shift = diag[hi] - off[hi - 1] ** 2 / (half + (np.hypot(half, off[hi - 1]) if half >= 0 else -np.hypot(half, off[hi - 1])))
        x, z = diag[lo] - shift, off[lo]
        for k in range(lo, hi):  # chase the bulge down the block
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                off[k - 1] = r
            d0, d1, e = diag[k], diag[k + 1], off[k]
            diag[k] = c * c * d0 + 2 * c * s * e + s * s * d1
            diag[k + 1] = s * s * d0 - 2 * c * s * e + c * c * d1
            off[k] = (c * c - s * s) * e + c * s * (d1 - d0)
            if k + 1 < hi:
                x, z = off[k], s * off[k + 1]
                off[k + 1] *= c
            q[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ q[[k, k + 1]]
    order = np.argsort(-diag, kind="stable")
    vectors = q[order].T
    return diag[order], vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(diag))] < 0, -1.0, 1.0)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums as doubles, and their exact sums of squares."""
    d = len(sums)
    if n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        q = n * x - np.array(sums, np.int64)
        if d * int(np.abs(q).max(initial=0)) ** 2 < 1 << 63:
            return q.astype(float), (q * q).sum(1)
    q = n * x.astype(object) - np.array(sums, object)
    total = (q * q).sum(1)
    if max(total) >= 1 << 63:
        raise OverflowError("a deviation exceeds 64 bits")
    return q.astype(float), total.astype(np.int64)


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each fine vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = stage(integers(vectors, id_col, vec_col), "whiten-rows")
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {OUT}"
    length = rows.where("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    d = length["d"]
    rows = rows.where(F.col("d") == d)
    fit = stage(rows.select("x").distinct(), "whiten-fit")
    m = moments(fit, d)
    n, sums = m.n, m.sums()
    values, vectors_ = symmetric_qr(m.m2 / n)
    shift = np.array([float((s - n * OFFSET) / n) for s in sums])
    k = min(components, int((values > 64 * d * np.finfo(float).eps * max(values[0], 0)).sum()))
    if not k:
        return spark.createDataFrame([], schema)
    project = vectors_[:, :k] / np.sqrt(values[:k])
    again = moments(fit, d, project, shift)
    error = float(np.abs(again.m2 / n - np.eye(k)).max())
    explained = values[:k] / values.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, dev = deviations(rows_of(batch.column("x")), n, sums)
            z, many = (q / n) @ project, batch.num_rows
            cols = [np.tile(np.arange(1, k + 1, dtype=np.int32), many), np.full(many * k, n), np.repeat(dev, k), z.reshape(-1), np.tile(explained, many), np.full(many * k, error)]
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(many), k)))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cols)], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
