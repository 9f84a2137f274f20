"""Embedding whitening: singular values of the centred rows, rescaled to eigenvalues of their covariance, turn vectors into uncorrelated components of variance 1."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, stash, tidy

#: Scale and offset of an entry's whole number, components that are returned.
SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Eigenvalues below this share of the largest are rounding of the covariance: such components don't exist.
LEAST_SHARE = 1e-12


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): remaining rows, entries as whole numbers floor(1024 c) + 100000 of the entries as doubles.

    Vectors that are null or hold null, NaN or infinite entries go. So do those whose length isn't the commonest one (of equally common ones the longest), empty ones, and
    those with an entry too large for a long, since they have no covariance with the rest.
    """
    entries = F.transform(F.col(quoted(vector_col)), lambda c: c.cast("double"))
    finite = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**62 / SCALE))
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), entries.alias("c")).filter(F.col("c").isNotNull() & (F.size("c") > 0)).filter(F.coalesce(finite, F.lit(False)))
    usual = rows.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if usual is None:
        return rows.select("vec_id", F.lit(None).cast("array<long>").alias("x")).limit(0)
    # tolerant addition: the filters above may be evaluated after it
    return rows.filter(F.size("c") == usual.d).select("vec_id", F.transform("c", lambda c: F.try_add(F.floor(c * SCALE).cast("long"), F.lit(OFFSET))).alias("x"))


def sums(x: DataFrame) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension): one row a dimension comes to the driver."""
    got = x.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("decimal(20,0)")).cast("decimal(38,0)").alias("s"), F.count("*").alias("n")).orderBy("d").collect()
    return (got[0].n if got else 0), [int(r.s) for r in got]


def axes(x: DataFrame, n: int, s: list[int], components: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues of the covariance with divisor n, falling; eigenvectors in columns) by MLlib's SVD of the centred rows.

    All singular values are asked for, so that the decomposition is a direct one: asked for a few, MLlib iterates to a tolerance short of double precision.
    """
    mean = F.lit([float(Decimal(v) / n) for v in s])
    centred = x.select(array_to_vector(F.zip_with("x", mean, lambda a, m: a.cast("double") - m)).alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, len(s))
    found = matrix.computeSVD(len(s), computeU=False)
    sigma = found.s.toArray()
    if not len(sigma):
        return np.zeros(0), np.zeros((len(s), 0))
    e = sigma**2 / n
    k = int(np.sum(e[:components] > LEAST_SHARE * e[0])) if e[0] > 0 else 0
    return e[:k], found.V.toArray()[:, :k]


def _projected(n: int, s: list[int], e: np.ndarray, v: np.ndarray):
    mean, axis, offsets = np.array([float(Decimal(a) / n) for a in s]), v / np.sqrt(e), np.array(s, object)
    small = all(abs(a) < 2**62 for a in s)

    def deviation(x: np.ndarray) -> list[str]:
        """Sums of (n x - S)^2: in 64 bits where every sum fits, else in whole numbers of any size."""
        if small and len(x) and float(np.abs(x.astype(float)).max()) * n < 2**62:
            y = x * n - offsets.astype(np.int64)
            if float(np.abs(y.astype(float)).max()) ** 2 * x.shape[1] < 2**62:
                return [str(d) for d in (y * y).sum(1)]
        return [str(d) for d in ((x.astype(object) * n - offsets) ** 2).sum(1)] if len(x) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(s))
            white = (x - mean) @ axis
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(e), pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation(x), pa.string()), lists], ["vec_id", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) of every remaining row and component.

    Components are unit eigenvectors of the covariance of all remaining rows (divisor n), numbered from 1 by falling eigenvalue, up to `components`; those without variance
    (LEAST_SHARE) are left out, so that equal vectors, or a single one, give no rows. `deviation` is null where the exact sum doesn't fit a long; `deviation_exact` has it
    always. `explained` is the eigenvalue over the total variance, from the exact deviations. Repeated ids are rows of their own, a null id stays null, other columns are
    ignored. What rows go: see `whole_vectors`. No vectors: no rows.

    Four passes over the rows (sums, Gram matrix, projections, moments of the projections); what comes to the driver has the size of the dimensions, not of the rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    x = whole_vectors(vectors, id_col, vector_col)
    n, s = sums(x)
    e, v = axes(x, n, s, components) if n else (np.zeros(0), np.zeros((0, 0)))
    if not len(e):
        return spark.createDataFrame([], schema)
    rows = stash(x.mapInArrow(tidy(_projected(n, s, e, v)), "vec_id long, deviation string, whitened array<double>"))
    at = lambda i: F.element_at("whitened", i + 1)
    cells = [(i, j) for i in range(len(e)) for j in range(i + 1)]
    got = rows.agg(F.sum(F.col("deviation").cast("double")).alias("total"), *(F.covar_pop(at(i), at(j)).alias(f"c{i}_{j}") for i, j in cells)).first()
    error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in cells)
    explained = [float(a) / (got.total / n / n / n) for a in e]
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return out.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.element_at(F.lit(explained), F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )
