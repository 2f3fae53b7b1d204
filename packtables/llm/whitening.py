"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The rows X are vectors of whole numbers (``floor(scale * c) + offset``), centred by their exact sums before anything is
multiplied. A step takes the right vector v, forms u = Xv less its part along the last u, takes out what is left along all
earlier u, and forms X'u, which gives the next v after two rounds of reorthogonalisation against all earlier v. The
coefficients are an upper bidiagonal matrix B with XV = UB; as the steps run to the full dimension, the singular values of
the small B are those of X and V times its right singular vectors are the components.

A left vector has as many entries as there are rows. It is never gathered: every u is X times a short vector of
coefficients that the driver holds, so a pass over the rows computes u's entries anew where the rows lie and returns
only sums (its products with the earlier u, its length, X'u). Lost executors cost a task's rows read again. A
step is one pass: the products Xv and X'u are taken from the same read, and the correction of u is applied to the sums. A
pass returns fewer than ``2 d`` numbers a task, added up by Spark before the driver sees them.

When the next v or u vanishes (repeated singular values, fewer directions than dimensions), the steps go on with a new
random direction orthogonal to all earlier ones, so equal singular values are found as well.

Defined results: rows with a null or empty vector or a null or non-finite entry are dropped; of vectors of several
dimensions, those of the most frequent one stay (the larger of two equally frequent); directions without deviation
(below ``RANK_TOLERANCE`` of the largest) are no components, so one row, or equal rows, have none and give no rows; rows
that repeat are whitened one by one; null ids are ids like any other; an empty table gives an empty table; extra columns are ignored.
An entry whose whole number, or a deviation that, exceeds 64 bits raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packtables.llm.common import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
SEED = 13
RANK_TOLERANCE = 1e-10


@dataclass
class Fit:
    """What whitening needs; ``d`` numbers for each of at most ``d`` components."""
    n: int
    sums: np.ndarray            # exact, of each dimension
    components: np.ndarray      # rows are unit vectors, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float


def vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vec_id`` and ``x``, the whole numbers of each usable vector, as a written table."""
    v = rows.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.filter(F.col("v").isNotNull() & finite)
    x = F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c) + F.lit(offset).cast("long"))
    out = written(v.select("vec_id", x.alias("x")), "vectors")
    sizes = out.filter(F.size("x") > 0).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first().d
    return out.filter(F.size("x") == F.lit(most)) if most else out.limit(0)


def _block(batch: pa.RecordBatch, n: int, sums: np.ndarray) -> np.ndarray:
    """``n`` times the centred rows of a batch, exact."""
    flat = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False)
    return n * flat.reshape(-1, len(sums)) - sums


def _added(rows: DataFrame, n: int, sums: np.ndarray, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``part`` of their centred blocks; what a task returns is one array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = part(_block(b, n, sums) / n)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    found = rows.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r.v for r in sorted(found, key=lambda r: r.i)])


def _clean(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` without its parts along the rows of ``basis``; taken out twice, as one round leaves rounding errors."""
    for _ in range(2):
        v = v - basis.T @ (basis @ v)
    return v


def _direction(rng: np.random.Generator, basis: np.ndarray, d: int) -> np.ndarray:
    v = _clean(rng.standard_normal(d), basis)
    v = _clean(v / np.linalg.norm(v), basis)
    return v / np.linalg.norm(v)


def bidiagonalise(rows: DataFrame, n: int, sums: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """``V`` (right vectors as rows) and the bidiagonal ``B`` of the centred rows, in as many steps as there are dimensions."""
    d = len(sums)
    rng = np.random.default_rng(seed)
    right = np.zeros((0, d))                        # v by row
    left = np.zeros((0, d))                         # coefficients of u by row: u = X @ left[j]
    back = np.zeros((0, d))                         # X'u by row
    b = np.zeros((d, d))
    v = _direction(rng, right, d)
    beta, least = 0.0, 0.0
    for j in range(d):
        right = np.vstack([right, v])
        c = v - beta * left[j - 1] if j else v

        def part(m: np.ndarray, c=c, left=left) -> np.ndarray:
            q = m @ c
            return np.concatenate([[q @ q], q @ m, q @ (m @ left.T)])

        got = _added(rows, n, sums, part)
        along = got[1 + d:]                         # what is left of q along the earlier u
        alpha = float(np.sqrt(max(0.0, got[0] - along @ along)))
        least = max(least, RANK_TOLERANCE * alpha)
        if alpha > least:
            u, xu = (c - along @ left) / alpha, (got[1:1 + d] - along @ back) / alpha
        else:                                       # no row deviates along v beyond the earlier u
            alpha, u, xu = 0.0, np.zeros(d), np.zeros(d)
        b[j, j] = alpha
        left, back = np.vstack([left, u]), np.vstack([back, xu])
        if j + 1 < d:
            nxt = _clean(xu - alpha * v, right)
            beta = float(np.linalg.norm(nxt))
            if beta > least:
                v = _clean(nxt / beta, right)
                v = v / np.linalg.norm(v)
                b[j, j + 1] = beta
            else:
                beta, v = 0.0, _direction(rng, right, d)
    return right, b


def fit(rows: DataFrame, seed: int = SEED) -> Fit:
    """Components and deviations of all ``rows(vec_id, x)``."""
    by_dim = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(
        F.count("*").alias("n"), F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    stats = sorted(by_dim, key=lambda r: r.i)
    if not stats:
        return Fit(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    n = stats[0].n
    if sum(max((n * r.hi - r.s) ** 2, (n * r.lo - r.s) ** 2) for r in stats) >= 2 ** 63 or any(n * max(abs(r.hi), abs(r.lo)) >= 2 ** 63 for r in stats):
        raise OverflowError("deviations of these vectors may exceed 64 bits")
    sums = np.array([r.s for r in stats], np.int64)
    right, b = bidiagonalise(rows, n, sums, seed)
    _, sigma, turned = np.linalg.svd(b)
    kept = sigma > RANK_TOLERANCE * sigma[0]
    e = sigma ** 2 / n
    return Fit(n, sums, (turned @ right)[kept], e[kept], float(e.sum()))


def identity_error(rows: DataFrame, model: Fit, k: int) -> float:
    """Largest entry, in absolute value, of the whitened rows' covariance less the identity: one pass."""
    if not k:
        return 0.0
    turn = (model.components[:k] / np.sqrt(model.eigenvalues[:k])[:, None]).T

    def part(m: np.ndarray) -> np.ndarray:
        w = m @ turn
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    got = _added(rows, model.n, model.sums, part) / model.n
    mean = got[k * k:]
    return float(np.abs(got[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def transform(rows: DataFrame, model: Fit, components: int = COMPONENTS) -> DataFrame:
    """``vec_id``, ``deviation`` (exact) and ``whitened`` (an array) of each row."""
    k = min(components, len(model.eigenvalues))
    turn = (model.components[:k] / np.sqrt(model.eigenvalues[:k])[:, None]).T if k else np.zeros((len(model.sums), 0))
    n, sums = model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _block(b, n, sums)
            w = np.ascontiguousarray((m / n) @ turn)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k, dtype=np.int32)), pa.array(w.ravel())) if k \
                else pa.array([[]] * b.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((m * m).sum(1)), lists], ["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    x = vectors(rows, id_col, vector)
    model = fit(x)
    k = min(components, len(model.eigenvalues))
    error = identity_error(x, model, k)
    shares = F.array(*[F.lit(float(s)) for s in model.eigenvalues[:k] / model.trace]) if k else F.array().cast("array<double>")
    flat = transform(x, model, components).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return flat.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
