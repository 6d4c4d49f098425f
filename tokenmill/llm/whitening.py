"""Embedding whitening by incremental eigendecomposition (operator 12).

Vectors become integers ``x = floor(64 c) + 1000000``. Every partition keeps the
spectrum of its scatter matrix and updates it vector by vector: a vector is a
rank-one change, centred on the mean so far,

    scatter + n / (n + 1) * (x - mean)(x - mean)^T

whose eigenvalues are the roots of a secular equation and whose eigenvectors
follow from them; directions that the change doesn't touch, and all but one of
equal eigenvalues, are deflated. Equal vectors of a batch are one update.
Spectra of partitions are combined in groups of ``FAN_IN``, as successive
rank-one updates by the other's eigenvectors and the difference of the means.

The result is a basis close to the covariance's eigenvectors, whatever rounding
gathered on the way. A distributed Rayleigh-Ritz step makes it exact: one more
pass projects the centred vectors on it, sums the small matrix of their
products, and its eigenvectors turn the basis into the final components.

The driver holds matrices of dimension x dimension only. Intermediate tables
are written to the shared folder.

Defined results: vectors that are null, empty or hold null or non-finite
entries are left out, and so are vectors of another dimension than the most
common one (of equally common ones: the largest). Components whose eigenvalue is zero up to
rounding cannot be whitened and have no rows: a table of one vector, or of
copies of one, gives none. Repeated rows and ids count and return once each;
further columns are not read. ``64 c`` is expected to fit 48 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import landed, table
from tokenmill.session import ship_code

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
FAN_IN = 32
#: Eigenvalues below this share of the trace count as zero.
LEAST = 1e-12
_EPS = np.finfo(np.float64).eps
#: Relative accuracy of a root's distance from its pole; eigenvectors stay orthogonal at any accuracy.
_ROOT = 1e-12


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z2 / (d - t)) = 0`` for rising distinct ``d``, ``z2 > 0`` and ``rho > 0``.

    Root ``i`` lies between ``d[i]`` and ``d[i + 1]`` (the last one up to ``rho * sum(z2)`` above). Returns the
    nearer pole's index and the root's offset from it, which keeps all differences ``d[j] - root`` accurate.
    A step goes to the root of the two-pole function with the same value and slopes on both sides; steps that
    leave the bracket halve it.
    """
    n = len(d)
    width = np.append(np.diff(d), rho * z2.sum())
    rise = d[None, :] - d[:, None]                     # row: root, column: pole
    half = width / 2
    value = 1 + rho * (z2 / (rise - half[:, None])).sum(1)
    right = (value < 0) & (np.arange(n) < n - 1)       # the root lies in the right half: measure from the right pole
    near = np.arange(n) + right
    gap = rise - np.where(right, width, 0.0)[:, None]
    low, high = np.where(right, -half, np.where(value < 0, half, 0.0)), np.where(right, 0.0, np.where(value < 0, width, half))
    left, upper = np.where(right, -width, 0.0), np.where(right, 0.0, width)   # the poles around the root
    below = np.tri(n)
    at = (low + high) / 2
    todo = np.arange(n)
    z2 = rho * z2
    with np.errstate(all="ignore"):
        for _ in range(100):
            t = at[todo]
            delta = gap[todo] - t[:, None]
            part = z2 / delta
            f = 1 + part.sum(1)
            slopes = part / delta
            to_left = (slopes * below[todo]).sum(1)
            slope = slopes.sum(1)
            lo, hi = np.where(f < 0, t, low[todo]), np.where(f < 0, high[todo], t)
            d1, d2 = left[todo] - t, upper[todo] - t
            c = f - d1 * to_left - d2 * (slope - to_left)
            a = (d1 + d2) * f - d1 * d2 * slope
            b = d1 * d2 * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            after = t + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            after = np.where((after > lo) & (after < hi), after, (lo + hi) / 2)
            # as near as f can tell: its terms cancel
            exact = np.abs(f) <= _EPS * n * (1 + np.abs(part).sum(1))
            at[todo] = np.where(exact, t, after)
            low[todo], high[todo] = lo, hi
            todo = todo[~exact & (np.abs(after - t) > _ROOT * np.abs(after))]
            if not len(todo):
                break
    return near, at


def rank_one_update(values: np.ndarray, vectors: np.ndarray, change: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (rising) of ``vectors diag(values) vectors^T + rho * change change^T``, ``rho >= 0``."""
    z = vectors.T @ change
    size = rho * (z @ z)
    if not size > 0:
        return values, vectors
    scale = max(np.abs(values).max(), size)
    small = 8 * _EPS * scale
    values, vectors = values.copy(), vectors.copy()
    # deflation: of nearly equal eigenvalues all but one lose their share, by a rotation within their plane
    keep: list[int] = []
    for k in np.flatnonzero(rho * np.abs(z) * np.sqrt(z @ z) > small).tolist():
        if keep and values[k] - values[keep[-1]] <= small:
            j = keep[-1]
            r = np.hypot(z[j], z[k])
            c, s = z[k] / r, z[j] / r
            vectors[:, [j, k]] = vectors[:, [j, k]] @ np.array([[c, s], [-s, c]])
            z[j], z[k] = 0.0, r
            keep.pop()
        keep.append(k)
    at = np.array(keep, np.int64)
    if len(at):
        d, zk = values[at], z[at]
        near, off = secular_roots(d, zk * zk, rho)
        delta = d[None, :] - d[near][:, None] - off[:, None]         # d[j] - root[i]
        # the change whose exact spectrum these roots are: its eigenvectors are orthogonal
        n = len(d)
        gap = d[None, :] - d[:, None]
        np.fill_diagonal(gap, 1.0)
        ratio = -delta.T / np.where(np.eye(n, dtype=bool), 1.0, gap.T)   # [j, i]: (root[i] - d[j]) / (d[i] - d[j])
        zh = np.sqrt(np.maximum(np.prod(np.abs(ratio), axis=1), 0)) * np.where(zk < 0, -1.0, 1.0)
        w = zh[None, :] / delta
        w /= np.sqrt((w * w).sum(1))[:, None]
        vectors[:, at] = vectors[:, at] @ w.T
        values[at] = d[near] + off
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, mean, and the scatter matrix's eigenvalues and eigenvectors."""

    def __init__(self, dim: int):
        self.n, self.mean = 0, np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray, times: int = 1) -> None:
        n = self.n + times
        if self.n:
            off = x - self.mean
            self.values, self.vectors = rank_one_update(self.values, self.vectors, off, self.n * times / n)
            self.mean = self.mean + off * (times / n)
        else:
            self.mean = x.astype(np.float64)
        self.n = n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one_update(self.values, self.vectors, vector, float(value))
        n = self.n + other.n
        off = other.mean - self.mean
        self.values, self.vectors = rank_one_update(self.values, self.vectors, off, self.n * other.n / n)
        self.mean = self.mean + off * (other.n / n)
        self.n = n

    def row(self) -> dict:
        return {"n": self.n, "mean": self.mean.tolist(), "values": self.values.tolist(), "vectors": self.vectors.ravel().tolist()}

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        s = cls(len(row["mean"]))
        s.n, s.mean, s.values = int(row["n"]), np.array(row["mean"]), np.array(row["values"])
        s.vectors = np.array(row["vectors"]).reshape(len(s.mean), -1)
        return s


_SPECTRUM = "id long, n long, mean array<double>, values array<double>, vectors array<double>"


def usable(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x``: the integer vectors of usable rows of the most common dimension."""
    e = F.col(embedding)
    fine = F.forall(e, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    good = embeddings.filter(e.isNotNull() & (F.size(e) > 0) & fine) \
        .select(F.col(vec_id).alias("vec_id"),
                F.transform(e, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))
    dim = good.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return good.filter(F.size("x") == (dim.d if dim else 0))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), -1)


def _spectrum_of_partition(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, total, number = Spectrum(dim), np.zeros(dim, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            number = batch.column(0)[0].as_py() if number is None else number
            total += x.sum(0)
            rows, times = np.unique(x, axis=0, return_counts=True)
            for k in np.random.default_rng(0).permutation(len(rows)).tolist():
                s.add(rows[k], int(times[k]))
        if number is not None:
            row = s.row()
            yield pa.RecordBatch.from_pylist([{"id": number, "total": total.tolist(), **row}], schema=pa.schema(
                [("id", pa.int64()), ("total", pa.list_(pa.int64())), ("n", pa.int64()),
                 *((c, pa.list_(pa.float64())) for c in ("mean", "values", "vectors"))]))
    return run


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    rows = group.sort_values("id").to_dict("records")
    s = Spectrum.of(rows[0])
    for r in rows[1:]:
        s.merge(Spectrum.of(r))
    return pd.DataFrame([{"id": rows[0]["group"], **s.row()}])


def combined(spectra: DataFrame, fan_in: int = FAN_IN) -> Spectrum:
    """One spectrum of all rows of ``spectra``, in rounds of groups of ``fan_in``."""
    count = spectra.agg(F.max("id")).first()[0] + 1
    while count > 1:
        groups = -(-count // fan_in)
        # ids are distinct and below `count`: a group holds at most `fan_in` rows
        spectra = landed(spectra.withColumn("group", F.col("id") % groups).groupBy("group").applyInPandas(_merged, _SPECTRUM), "spectra")
        count = groups
    return Spectrum.of(spectra.first().asDict())


def _summed(df: DataFrame, fn, size: int) -> np.ndarray:
    """The sum of the arrays of ``size`` numbers that ``fn`` returns for each partition."""
    rows = df.mapInArrow(fn, "part array<double>").select(F.posexplode("part")).groupBy("pos").agg(F.sum("col").alias("s")).toArrow()
    out = np.zeros(size)
    out[rows["pos"].to_numpy()] = rows["s"].to_numpy()
    return out


def _products(column: str, of, size: int):
    """Per partition: products ``y^T y`` and sums of ``y = of(rows)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                y = of(_matrix(batch.column(column)))
                total += y.sum(0)
                product += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([product.ravel(), total])], pa.list_(pa.float64()))], names=["part"])
    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding",
           fan_in: int = FAN_IN) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component."""
    spark = embeddings.sparkSession
    ship_code(spark)
    id_type = embeddings.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = landed(usable(embeddings, vec_id, embedding), "vectors")
    first = x.first()
    if first is None:
        return spark.createDataFrame([], schema)
    dim = len(first.x)
    states = landed(x.select(F.spark_partition_id().cast("long").alias("id"), "x")
                    .mapInArrow(_spectrum_of_partition(dim), f"id long, total array<long>, {_SPECTRUM.split(', ', 1)[1]}"), "states")
    n = states.agg(F.sum("n")).first()[0]
    sums = np.zeros(dim, object)
    for r in states.select(F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("s")).collect():  # one row per dimension
        sums[r.pos] = r.s
    basis = combined(states.drop("total"), fan_in).vectors
    sums = sums.astype(np.int64)
    mean = sums / n

    def project(rows: np.ndarray) -> np.ndarray:
        return (rows - mean) @ basis

    found = _summed(x.select("x"), _products("x", project, dim), dim * dim + dim)
    small, off = found[:dim * dim].reshape(dim, dim) / n, found[dim * dim:] / n
    values, turn = np.linalg.eigh((small + small.T) / 2 - np.outer(off, off))
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    use = int((values[:components] > LEAST * max(trace, 0)).sum()) if trace > 0 else 0
    if not use:
        return spark.createDataFrame([], schema)
    map_to = vectors[:, :use] / np.sqrt(values[:use])
    explained = values[:use] / trace
    exact = _exact_deviation(n, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(1))
                white = (rows - mean) @ map_to
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(exact(rows), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * use, pa.int32()), pa.array(white.ravel()))],
                    names=["vec_id", "deviation", "white"])

    white = landed(x.mapInArrow(run, f"vec_id {id_type}, deviation long, white array<double>"), "white")
    found = _summed(white.select("white"), _products("white", lambda w: w, use), use * use + use)
    off = found[use * use:] / n
    error = float(np.abs(found[:use * use].reshape(use, use) / n - np.outer(off, off) - np.eye(use)).max())
    share = F.array(*(F.lit(float(v)) for v in explained))
    return white.select("vec_id", "deviation", F.posexplode("white").alias("k", "whitened")) \
        .select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(int(n)).cast("long").alias("n"), "deviation",
                "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


def _exact_deviation(n: int, sums: np.ndarray):
    def exact(rows: np.ndarray) -> list[int]:
        d = rows.astype(object) * n - sums.astype(object) if n * float(np.abs(rows).max()) > 2 ** 62 else rows * n - sums
        if d.dtype != object and float(np.abs(d).max()) ** 2 * d.shape[1] > 2 ** 62:
            d = d.astype(object)
        return (d * d).sum(1).tolist()
    return exact


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
