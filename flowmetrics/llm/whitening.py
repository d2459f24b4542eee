"""Embedding whitening by spectral divide and conquer on polar decompositions.

The covariance matrix V of all vectors comes from two passes over the table:
exact integer sums, then sums of centred products, both added up by Spark.
V is a d x d matrix whatever the number of vectors.  Its components are
found by splitting: for a shift s between the eigenvalues, the orthogonal
polar factor U of V - s I, by dynamically weighted Halley iterations with QR
(QDWH), gives the projector (U + I) / 2 on the eigenvectors above s; an
orthonormal basis of that range and of its complement cuts V into two
smaller blocks, which are split in turn down to single components (Nakatsukasa
and Higham, "Stable and efficient spectral divide and conquer").  Only
blocks that hold one of the wanted components are split.  The d x k
projection, k at most ``COMPONENTS``, is broadcast, its size set by the
dimension, and a third pass whitens every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .store import broadcast, materialize

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
#: Widest vectors: the covariance of 4096 dimensions is 134 MB on the driver.
MAX_DIMENSION = 4096
_EPS = float(np.finfo(float).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric nonsingular matrix, by QDWH iterations with QR."""
    d = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    r = np.linalg.qr(x, mode="r")
    least = np.abs(np.diag(r)).min()
    # a lower bound of the smallest singular value: the iteration only needs one
    if least > _EPS:
        least = 1 / max(np.linalg.norm(np.linalg.solve(r, np.eye(d))), 1.0)
    low = min(max(least, _EPS), 1.0)
    for _ in range(60):
        gamma = (4 * max(1 - low**2, 0.0) / low**4) ** (1 / 3)
        root = np.sqrt(1 + gamma)
        h = root + 0.5 * np.sqrt(max(8 - 4 * gamma + 8 * (2 - low**2) / (low**2 * root), 0.0))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(c) * x, np.eye(d)]))
        new = (b / c) * x + (h - b / c) / np.sqrt(c) * (q[:d] @ q[d:].T)
        new = (new + new.T) / 2
        low = min(low * (h + b * low**2) / (1 + c * low**2), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= (4 * _EPS) ** (1 / 3) and 1 - low <= 10 * _EPS:
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces, the one of larger eigenvalues first; None if all eigenvalues are equal."""
    d = len(a)
    mean = np.trace(a) / d
    spread = np.linalg.norm(a - mean * np.eye(d))
    if spread <= 2 * d * _EPS * scale:
        return None
    best = None
    middle = float(np.median(np.diag(a)))
    # the mean lies between the extreme eigenvalues; a shift next to an eigenvalue is moved off it
    for shift in (middle, mean, mean + 0.1 * spread / d, mean - 0.1 * spread / d):
        u = polar(a - shift * np.eye(d))
        above = round((np.trace(u) + d) / 2)
        if not 0 < above < d:
            continue
        projector = (u + np.eye(d)) / 2
        start = np.random.default_rng(d).standard_normal((d, above))
        basis, _ = np.linalg.qr(projector @ start)
        basis, _ = np.linalg.qr(projector @ basis, mode="complete")
        off = np.linalg.norm(basis[:, above:].T @ a @ basis[:, :above])
        if best is None or off < best[0]:
            best = off, basis[:, :above], basis[:, above:]
        if off <= 10 * d * _EPS * scale:
            break
    return None if best is None else best[1:]


def top_components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors in columns) of the ``count`` largest eigenvalues of a symmetric matrix, falling."""
    scale = max(float(np.linalg.norm(v)), np.finfo(float).tiny)
    values, vectors = [], []
    # blocks still to split, the one of the largest eigenvalues on top
    stack = [np.eye(len(v))]
    while stack and len(values) < count:
        basis = stack.pop()
        block = basis.T @ v @ basis
        block = (block + block.T) / 2
        halves = _split(block, scale) if len(block) > 1 else None
        if halves is None:
            values += np.diag(block).tolist()
            vectors += list(basis.T)
        else:
            upper, lower = halves
            stack += [basis @ lower, basis @ upper]
    values, vectors = np.array(values), np.array(vectors).reshape(-1, len(v))
    # blocks come out in falling order up to rounding
    order = np.argsort(-values, kind="stable")[:count]
    return values[order], vectors[order].T


@dataclass
class Whitening:
    """Fitted on n vectors: sums per dimension, eigenvalues and d x k unit eigenvectors, trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def filled(self) -> np.ndarray:
        """Components with a variance above rounding; the others cannot be scaled to one."""
        return self.values > len(self.sums) * _EPS * max(self.trace, 0.0)

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(np.where(self.filled, self.values, np.inf))


def vectors_of(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``keep`` and x, the integer vector; rows without a whole, finite vector go."""
    entry = F.col(column).cast("array<double>")
    whole = entry.isNotNull() & (F.size(entry) > 0) & F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.where(whole).select(*keep, F.transform(entry, lambda c: F.least(F.floor(c * SCALE).cast("long"), F.lit(2**63 - 1 - SHIFT)) + SHIFT).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, d)


def product_batches(batches: Iterator[pa.RecordBatch], mean: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(i, row) of the task's sum of centred products, one output row per dimension."""
    d = len(mean)
    total = np.zeros((d, d))
    seen = False
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            y = matrix(batch.column(0).slice(lo, 4096), d) - mean
            total += y.T @ y
            seen = True
    if seen:
        rows = pa.ListArray.from_arrays(pa.array(np.arange(d + 1) * d, pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), rows], schema=schema)


def white_batches(batches: Iterator[pa.RecordBatch], model: Whitening, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(id, deviation, whitened) of (id, x)."""
    d, mean = len(model.sums), np.array([s / model.n for s in model.sums])
    scaled = model.scaled
    most = max(abs(s) for s in model.sums)
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            x = matrix(part.column(1), d)
            largest = model.n * max(abs(int(x.max())), abs(int(x.min()))) + most
            if d * largest**2 < 2**63:
                far = model.n * x - np.array(model.sums, np.int64)
                deviation = (far * far).sum(1).tolist()
            else:  # Python integers where 64 bits do not hold the squares
                deviation = [sum((model.n * c - s) ** 2 for c, s in zip(row, model.sums)) for row in x.tolist()]
            white = (x - mean) @ scaled
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([str(v) for v in deviation], pa.string()), rows], schema=schema)


def moment_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(n, sums, products about the own mean) of each task's whitened rows."""
    n, mean, total = 0, 0.0, 0.0
    for batch in batches:
        k = len(batch.column(0)[0]) if batch.num_rows else 0
        if not k:
            continue
        w = matrix(batch.column(0), k)
        m, own = len(w), w.mean(0)
        centred = w - own
        gap = own - mean
        total = total + centred.T @ centred + np.outer(gap, gap) * (n * m / (n + m))
        mean = mean + gap * (m / (n + m))
        n += m
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "products": [total.ravel().tolist()]}, schema=schema)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the integer vectors ``x`` (all of one length); None for an empty table."""
    facts = vectors.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("d")).first()
    n, d = facts.n, facts.d
    if not n:
        return None
    if facts.lo != d:
        raise ValueError(f"vectors have {facts.lo} to {d} entries: whitening needs one length")
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors have {d} entries; the most is {MAX_DIMENSION}")
    each = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    sums = [int(r.s) for r in each.orderBy("i").collect()]
    mean = np.array([s / n for s in sums])
    shape = "i int, row array<double>"
    arrow = _arrow(vectors, shape)
    partial = vectors.select("x").mapInArrow(lambda it: product_batches(it, mean, arrow), shape)
    rows = partial.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    v = np.zeros((d, d))
    for r in rows:
        v[r.i, r.j] = r.v / n
    values, basis = top_components((v + v.T) / 2, min(components, d))
    return Whitening(n, sums, values, basis, float(np.trace(v)))


def _arrow(df: DataFrame, shape: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], shape).schema)


def identity_error(white: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with a variance."""
    shape = "n long, mean array<double>, products array<double>"
    arrow = _arrow(white, shape)
    parts = white.select("white").mapInArrow(lambda it: moment_batches(it, arrow), shape)
    k = len(model.values)
    # moments of a task: a few dozen numbers, added up by Spark entry by entry
    parts = materialize(parts, "moments")
    sums = parts.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m")).collect()
    mean = np.zeros(k)
    for r in sums:
        mean[r.i] = r.m
    centre = F.lit(mean.tolist())
    cells = parts.select("n", "mean", F.posexplode("products").alias("at", "p"))
    i, j = (F.col("at") / k).cast("int"), F.col("at") % k
    gap = lambda at: F.get("mean", at) - F.get(centre, at)
    products = cells.select("at", (F.col("p") + F.col("n") * gap(i) * gap(j)).alias("p")).groupBy("at").agg(F.sum("p").alias("p")).collect()
    cov = np.zeros(k * k)
    for r in products:
        cov[r["at"]] = r.p / model.n
    filled = model.filled
    error = np.abs(cov.reshape(k, k) - np.eye(k))[np.ix_(filled, filled)]
    return float(error.max(initial=0.0))


def whiten(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per row of ``df`` with a whole vector and component: row_id, component, n, deviation, whitened, explained, identity_error.

    A row whose vector is null, empty or holds a null, NaN or infinite entry
    gets no row; all other vectors must have one length (ValueError
    otherwise).  An entry c is taken as floor(1024 c) + 100000; one beyond
    64 bits is the nearest 64-bit integer.  Components are numbered from 1 by
    falling variance, at most ``components`` and the dimension.  deviation is
    a decimal: the sum over dimensions of (n x - S)^2, exact.  A component
    without variance (n = 1, or equal rows) has whitened 0 and is left out of
    identity_error; explained is null if no dimension varies.  Repeated rows
    count and are returned each, a null id stays null; other columns are
    ignored, whatever their names; an empty table gives no row.
    """
    spark = df.sparkSession
    id_type = dict(df.dtypes)[row_id]
    shape = f"{row_id} {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = vectors_of(df, vector, [row_id])
    model = fit(vectors, components)
    if model is None:
        return spark.createDataFrame([], shape)
    sent = broadcast(spark, model)
    white_shape = f"id {id_type}, deviation string, white array<double>"
    arrow = _arrow(df, white_shape)

    def run(batches):
        import pickle

        return white_batches(batches, pickle.loads(sent.value), arrow)

    white = materialize(vectors.select(F.col(row_id).alias("id"), "x").mapInArrow(run, white_shape), "whitened")
    error = identity_error(white, model)
    share = (model.values / model.trace).tolist() if model.trace > 0 else [None] * len(model.values)
    explained = F.array(*(F.lit(s).cast("double") for s in share))
    rows = white.select(F.col("id").alias(row_id), F.posexplode("white").alias("at", "whitened"), F.col("deviation").try_cast("decimal(38,0)").alias("deviation"))
    return rows.select(row_id, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
