"""Embedding whitening with exact covariances by digit-slice matrix products.

Vectors are made integer, and each distinct one enters the fit list once. With n of them and sums S, a vector is centred as n * x - S, still an integer. Centred components are split
into signed limbs of ``LIMB`` bits, so that the float64 BLAS product of two limbs over a block of ``ROWS`` rows is exact; the products of each shift are summed as
integers within a task, and over all tasks in decimals, and what reaches the driver is one number for each pair of dimensions and shift. There the limbs are recombined as big
integers: n^3 times the covariance, without an error. Its entries are rounded once, to doubles, for the eigendecomposition. So neither the order of rows nor their partitioning changes a bit of the model.

Edge cases: rows with a null vector, or a null or non-finite entry, are left out. Repeated rows and copies of a vector count once in the fit and get their rows in the result each. A null vec_id stays. Vectors of fewer
entries than others end in zeros. A vector without entries has no component. Components whose eigenvalue is zero in double precision cannot be whitened and are left out (all of them,
if all vectors are equal); tied eigenvalues give one choice of axes, the same for all rows. A deviation beyond a long is null. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import stored, table

SCALE = 256
COMPONENTS = 4
#: Bits of a limb and rows of a block: ROWS * 2^(2 * (LIMB - 1)) stays below 2^53.
LIMB, ROWS = 20, 4096
#: Blocks whose products a task adds up in longs before it hands them on.
FLUSH = 1024
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Model:
    n: int
    sums: list[int]
    reach: int  # no centred entry is larger
    axes: np.ndarray | None = None  # (dim, components)
    values: np.ndarray | None = None
    explained: np.ndarray | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in longs or, where they do not hold it, in big integers."""
        kind = np.int64 if self.reach < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return y.astype(np.float64) / self.n @ self.axes / np.sqrt(self.values)


def limbs_of(y: np.ndarray, count: int) -> list[np.ndarray]:
    """y as ``count`` signed limbs, least first, each a float64 matrix of integers of at most LIMB - 1 bits and sign."""
    half, full = 1 << (LIMB - 1), 1 << LIMB
    out = []
    for _ in range(count):
        low = (y + half) % full - half
        y = (y - low) // full
        out.append(low.astype(np.float64))
    return out


def limb_count(reach: int) -> int:
    count = 1
    while reach >= 1 << (LIMB * count - 2):
        count += 1
    return count


def sliced_products(y: np.ndarray, count: int) -> np.ndarray:
    """(2 * count - 1, dim, dim) longs: the exact product of a block's transpose with it, by shift of LIMB bits."""
    parts = limbs_of(y, count)
    out = np.zeros((2 * count - 1, y.shape[1], y.shape[1]), np.int64)
    for a, b in combinations_with_replacement(range(count), 2):
        product = (parts[a].T @ parts[b]).astype(np.int64)
        out[a + b] += product if a == b else product + product.T
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x of the rows that take part."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return embeddings.select("vec_id", "embedding").where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def fit_sums(fit: DataFrame, dim: int) -> Model:
    """n, S and a bound of the centred entries."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), dim).astype(object) if batch.num_rows else np.zeros((0, dim), object)
            if len(x):
                yield pa.RecordBatch.from_pydict({"at": pa.array(range(dim), pa.int32()), "total": pa.array([str(t) for t in x.sum(axis=0)]), "n": pa.array([len(x)] * dim, pa.int64()), "most": pa.array(np.abs(x).max(axis=0).astype(np.int64))})

    found = fit.mapInArrow(partial, "at int, total string, n long, most long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("at").collect()
    n, sums = found[0].n, [int(r.total) for r in found]
    return Model(n, sums, max(n * r.most + abs(s) for r, s in zip(found, sums, strict=True)))


def scatter(fit: DataFrame, model: Model, dim: int) -> list[list[int]]:
    """Sum over the fit list of the products of centred entries, as big integers."""
    count = limb_count(model.reach)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(dim)
        total, blocks = np.zeros((2 * count - 1, dim, dim), np.int64), 0

        def rows() -> pa.RecordBatch:
            shifts = np.repeat(np.arange(2 * count - 1), len(upper[0]))
            cells = [pa.array(np.tile(k, 2 * count - 1), pa.int32()) for k in upper]
            return pa.RecordBatch.from_arrays([*cells, pa.array(shifts, pa.int32()), pa.array(total[:, upper[0], upper[1]].ravel())], names=["i", "j", "shift", "value"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                total += sliced_products(model.centred(matrix(batch.column(0).slice(at, ROWS), dim)), count)
                blocks += 1
                if blocks == FLUSH:
                    yield rows()
                    total, blocks = np.zeros_like(total), 0
        if blocks:
            yield rows()

    sums = fit.mapInArrow(partial, "i int, j int, shift int, value long").groupBy("i", "j", "shift").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = [[0] * dim for _ in range(dim)]
    for r in sums.collect():  # dim * dim entries, whatever the number of rows
        out[r.i][r.j] += int(r.value) << (LIMB * r.shift)
    for i in range(dim):
        for j in range(i):
            out[i][j] = out[j][i]
    return out


def decompose(model: Model, products: list[list[int]], components: int) -> Model:
    """Axes, eigenvalues and explained shares of the covariance products / n^3, each entry rounded once."""
    cube = model.n**3
    cov = np.array([[v / cube for v in row] for row in products])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    whole = sum(products[i][i] for i in range(len(products))) / cube
    count = int((values[:components] > len(values) * np.finfo(float).eps * max(values[0], 0)).sum())
    model.axes, model.values = np.ascontiguousarray(axes[:, :count]), values[:count]
    model.explained = values[:count] / whole if count else values[:0]
    return model


def identity_error(fit: DataFrame, model: Model, dim: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    count = len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = model.whitened(model.centred(matrix(batch.column(0), dim)))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(count)], names=[f"w{k}" for k in range(count)])

    w = fit.mapInArrow(project, ", ".join(f"w{k} double" for k in range(count)))
    pairs = list(combinations_with_replacement(range(count), 2))
    covs = w.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(covs, pairs, strict=True))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    rows = stored(integer_vectors(embeddings))
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dim:
        return spark.createDataFrame([], RESULT)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x"))))
    fit = stored(rows.select("x").distinct())
    model = fit_sums(fit, dim)
    model = decompose(model, scatter(fit, model, dim), components)
    count = len(model.values)
    if not count:
        return spark.createDataFrame([], RESULT)
    error = identity_error(fit, model, dim)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = model.centred(matrix(batch.column(1), dim))
            exact = y if dim * model.reach**2 < 1 << 63 else y.astype(object)
            deviation = pa.array([d if d < 1 << 63 else None for d in (exact**2).sum(axis=1).tolist()], pa.int64())
            w = model.whitened(y)
            for k in range(count):
                fill = lambda v, kind: pa.array([v] * len(y), kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), fill(k + 1, pa.int32()), fill(model.n, pa.int64()), deviation, pa.array(w[:, k]), fill(float(model.explained[k]), pa.float64()), fill(error, pa.float64())], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(result, RESULT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
