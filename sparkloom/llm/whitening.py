r"""Embeddings whitened by the leading eigenvectors of their covariance, found by block Lanczos without the matrix.

Entries become integers x = floor(64 c) + 1000000. A pass over the rows adds up Xᵀ(X v) of the centred rows for a block of vectors, so the covariance
is never formed; only the block goes out and only a matrix as large comes back, summed by Spark. Each new block is made orthogonal
to all earlier ones, twice; directions in which nothing is left (a breakdown: an invariant subspace) are started again with random vectors. What the passes
have given for the whole basis is projected onto it (Rayleigh-Ritz), and the passes end when the residual of every wanted vector is at rounding
level, or the basis spans the whole space. A block is as wide as the number of wanted components, so that an eigenvalue of that multiplicity is found whole.

Sums and deviations are exact integers; their total gives the trace, hence the explained shares. A last pass measures the covariance of
the whitened rows; each component is scaled to the variance measured there.

Rows whose vector is null or empty, or holds null or non-finite entries, are dropped; so are those not as long as most others (of equally
frequent lengths the longer one). Ids may be null or repeat: each row is a vector. Directions without variance beyond rounding (NOISE) can't be
whitened and give no component. An empty table, or one without variance, gives an empty result. Entries with
|64 c| over 2**61 are held at that bound; a deviation that a long can't hold is null. Columns of the table other than the two named aren't read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Rows that one numpy step works on; shares of the largest eigenvalue at which a residual, and an eigenvalue, is rounding.
ROWS, CONVERGED, NOISE = 4096, 1e-14, 1e-12
BOUND = float(1 << 61)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v: doubles) of the vectors that count, and their length; built-in functions only."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    good = rows.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(~F.coalesce(bad, F.lit(True)))
    sizes = good.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.agg(F.max_by("size", F.struct("n", "size")).alias("size")).first()["size"] or 0
    return good.where(F.size("v") == usual), usual


def integers(batch: pa.RecordBatch, d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, x) of at most ROWS rows."""
    for lo in range(0, len(batch), ROWS):
        part = batch.slice(lo, ROWS)
        flat = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        yield part.column(0), np.floor(np.clip(flat * SCALE, -BOUND, BOUND)).astype(np.int64) + SHIFT


class Centre:
    """n and the exact sums S of the fitted rows."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.base = n, np.array([s // n for s in sums], np.int64)
        self.over = np.array([s % n for s in sums], np.int64)  # S - n * base
        self.rest = self.over / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) ** 2 of each row."""
        x = x - self.base
        small = ((x.astype(float) * self.n) ** 2).sum(axis=1) + float(self.n) ** 2 * x.shape[1] < 2.0 ** 60
        m = np.where(small[:, None], x, 0) * self.n - self.over if self.n < 1 << 30 else np.zeros_like(x)
        out: list[int | None] = (m * m).sum(axis=1).tolist()
        for i in np.flatnonzero(~small | (self.n >= 1 << 30)):
            exact = sum((int(a) * self.n - int(o)) ** 2 for a, o in zip(x[i], self.over))
            out[i] = exact if exact < 1 << 63 else None
        return out


def fitted(rows: DataFrame, d: int) -> Centre | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            for ids, x in integers(batch, d):
                n += len(ids)
                exact = x.sum(axis=0) if np.abs(x.astype(float)).max() * len(x) < BOUND else x.astype(object).sum(axis=0)
                sums = [a + int(b) for a, b in zip(sums, exact)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(d), -1], pa.int32()), pa.array([Decimal(s) for s in [*sums, n]], pa.decimal128(38, 0))], ["i", "s"])

    total = {r["i"]: int(r["s"]) for r in rows.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}  # d + 1 rows
    return Centre(total[-1], [total[i] for i in range(d)]) if total else None


def summed(rows: DataFrame, d: int, height: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(x), a matrix of height x width, over all rows; tasks add up, then Spark, and the sum comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((height, width)), False
        for batch in batches:
            for _, x in integers(batch, d):
                total, some = total + part(x), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    each = rows.mapInArrow(run, "i int, v array<double>").groupBy("i").agg(F.array(*(F.sum(F.get("v", F.lit(j))) for j in range(width))).alias("v"))
    out = np.zeros((height, width))
    for r in each.collect():  # height rows
        out[r["i"]] = r["v"]
    return out


def orthogonal(block: np.ndarray, basis: np.ndarray, least: float, wanted: int, r: np.random.Generator) -> np.ndarray:
    """Up to `wanted` unit vectors orthogonal to basis and each other: what of block is longer than least, then random ones."""
    found = basis[:, :0]
    for vectors in (block, None, None):
        room = min(wanted, len(basis) - basis.shape[1]) - found.shape[1]
        if room <= 0:
            break
        if vectors is None:
            vectors, least = r.standard_normal((len(basis), room)), 1e-6
        have = np.hstack((basis, found))
        for _ in range(2):
            vectors = vectors - have @ (have.T @ vectors)
        u, s, _ = np.linalg.svd(vectors, full_matrices=False)
        u = u[:, s > least][:, :room]
        u, _ = np.linalg.qr(u - have @ (have.T @ u))
        found = np.hstack((found, u))
    return found


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors (columns) of the symmetric matrix that times() multiplies a block by."""
    r = np.random.default_rng(seed)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    block = orthogonal(np.zeros((d, 0)), basis, 0.0, k, r)
    while True:
        new = times(block)
        basis, image = np.hstack((basis, block)), np.hstack((image, new))
        inner = basis.T @ image
        values, s = np.linalg.eigh((inner + inner.T) / 2)
        values, s = values[::-1][:k], s[:, ::-1][:, :k]
        top = max(float(values[0]), 0.0)
        residual = np.linalg.norm(image @ s - (basis @ s) * values, axis=0)
        if basis.shape[1] == d or residual.max() <= CONVERGED * top:
            return values, basis @ s
        block = orthogonal(new, basis, CONVERGED * top, k, r)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    shape = f"id {rows.schema[id_col].dataType.simpleString()}, component int, deviation long, whitened double"
    rows, d = usable(rows, id_col, vector_col)
    centre = fitted(rows, d) if d else None
    k = min(components, d)
    values, frame, trace = np.zeros(0), np.zeros((d, 0)), 0.0
    if centre:
        def squares(x: np.ndarray) -> np.ndarray:  # deviation / n ** 2
            return np.array([[(centre.centred(x) ** 2).sum()]])

        def products(block: np.ndarray) -> np.ndarray:
            def part(x: np.ndarray) -> np.ndarray:
                c = centre.centred(x)
                return c.T @ (c @ block)
            return summed(rows, d, d, block.shape[1], part) / centre.n

        trace = summed(rows, d, 1, 1, squares)[0, 0] / centre.n
        values, frame = block_lanczos(products, d, k)
        real = values > NOISE * max(values[0], 0.0)
        values, frame = values[real], frame[:, real] / np.sqrt(values[real])
    k = len(values)
    error = 0.0
    if k:
        def moments(x: np.ndarray) -> np.ndarray:
            y = centre.centred(x) @ frame
            return np.vstack((y.T @ y, y.sum(axis=0)))

        found = summed(rows, d, k + 1, k, moments) / centre.n
        found = found[:k] - np.outer(found[k], found[k])
        # a small eigenvalue beside a very large one is known better by its own component's variance than from the projection
        scale = np.sqrt(np.diag(found))
        values, frame = values * scale ** 2, frame / scale
        error = float(np.abs(found / np.outer(scale, scale) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in integers(batch, d) if k else ():
                each = pa.array(np.repeat(np.arange(len(ids)), k))
                yield pa.RecordBatch.from_arrays([
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                    pa.array(centre.deviations(x), pa.int64()).take(each), pa.array((centre.centred(x) @ frame).ravel())], ["id", "component", "deviation", "whitened"])

    made = rows.mapInArrow(run, shape)
    explained = F.get(F.array(*(F.lit(float(e / trace)) for e in values)), F.col("component") - 1) if k else F.lit(None).cast("double")
    return made.select(
        F.col("id").alias(id_col), "component", F.lit(centre.n if centre else 0).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
