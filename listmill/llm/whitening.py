"""Whitening of embeddings (operator 13) by Jacobi-Davidson on the covariance.

The covariance is never formed. Each product of it with a block of vectors is one pass over
the distinct quantised vectors: every task multiplies its centred rows by the block and back
(numpy on an Arrow batch), and the driver adds the tasks' d x b partial products, one per
task. The eigenproblem itself is small (d x b) and is
solved on the driver: a search space, Rayleigh-Ritz on it, locking of converged pairs, and
for each pair still open the correction equation (I - UU')(V - theta I)(I - UU') t = -r,
solved approximately by a few MINRES steps whose products are again passes, all open pairs
in one block. It stops when every residual is below ``TOL`` times the largest eigenvalue.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.llm.common import written

COMPONENTS = 16
#: Residual norm, relative to the largest eigenvalue, below which a pair is locked.
TOL = 1e-13
#: MINRES steps per correction equation, and passes at most.
INNER = 4
MAX_PASSES = 400
SCALE, OFFSET = 64, 1_000_000


def quantised(vector: Column) -> Column:
    """Each entry c, as double, becomes floor(64 c) + 1000000 (long)."""
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + OFFSET).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and every entry neither null nor NaN nor infinite."""
    return vector.isNotNull() & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))


def _summed(frame: DataFrame, column: str) -> np.ndarray:
    """Element-wise sum of an array column over all rows, by a Spark aggregation."""
    sums = frame.select(F.posexplode(column).alias("_lm_i", "_lm_v")).groupBy("_lm_i").agg(
        F.sum("_lm_v").alias("_lm_s")).collect()
    out = np.zeros(len(sums))
    for r in sums:
        out[r["_lm_i"]] = r["_lm_s"]
    return out


class Covariance:
    """Products of the covariance of a table of quantised vectors with small blocks."""

    def __init__(self, fit: DataFrame, n: int, sums: list[int]):
        self.fit, self.n, self.d = fit, n, len(sums)
        self.mean = np.array([s / n for s in sums])
        self.passes = 0

    def _pass(self, make) -> np.ndarray:
        """Sum over all rows of ``make(centred rows)``, flattened, from partial sums per task."""
        mean = self.mean

        def partial(batches):
            total = None
            for batch in batches:
                if len(batch) == 0:
                    continue
                rows = np.stack(batch["x"].to_numpy()).astype(np.float64) - mean
                part = make(rows).ravel()
                total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"_lm_p": [total.tolist()]})

        self.passes += 1
        # One d x b partial per task: what reaches the driver is bounded by the task count
        # times the block, not by the rows.
        parts = self.fit.select("x").mapInPandas(partial, "_lm_p array<double>").collect()
        return np.sum([np.asarray(r["_lm_p"]) for r in parts], axis=0)

    def times(self, block: np.ndarray) -> np.ndarray:
        """V @ block, V the covariance (divisor n)."""
        block = np.asarray(block, dtype=np.float64)
        flat = self._pass(lambda rows: rows.T @ (rows @ block))
        return flat.reshape(self.d, block.shape[1]) / self.n


def _orthonormal_add(basis: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The basis with the parts of ``new`` outside it, twice orthogonalised; tiny parts dropped."""
    for j in range(new.shape[1]):
        v = new[:, j].copy()
        size = np.linalg.norm(v)
        for _ in range(2):
            v -= basis @ (basis.T @ v)
        if size > 0 and np.linalg.norm(v) > 1e-10 * size:
            basis = np.column_stack([basis, v / np.linalg.norm(v)])
    return basis


def _minres(apply, rhs: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for every column of ``rhs`` at once; ``apply`` maps a block to its products."""
    d, m = rhs.shape
    x = np.zeros((d, m))
    beta1 = np.linalg.norm(rhs, axis=0)
    live = beta1 > 0
    if not live.any():
        return x
    y, r1, r2 = rhs.copy(), rhs.copy(), rhs.copy()
    oldb, beta = np.zeros(m), beta1.copy()
    dbar, epsln, phibar = np.zeros(m), np.zeros(m), beta1.copy()
    cs, sn = -np.ones(m), np.zeros(m)
    w, w2 = np.zeros((d, m)), np.zeros((d, m))
    for step in range(steps):
        safe = np.where(beta > 0, beta, 1.0)
        v = y / safe
        y = apply(v)
        if step > 0:
            y = y - (beta / np.where(oldb > 0, oldb, 1.0)) * r1
        alfa = np.einsum("ij,ij->j", v, y)
        y = y - (alfa / safe) * r2
        r1, r2 = r2, y
        oldb, beta = beta, np.linalg.norm(y, axis=0)
        oldeps = epsln
        delta = cs * dbar + sn * alfa
        gbar = sn * dbar - cs * alfa
        epsln = sn * beta
        dbar = -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), np.finfo(float).eps)
        cs, sn = gbar / gamma, beta / gamma
        phi = cs * phibar
        phibar = sn * phibar
        w1, w2 = w2, w
        w = (v - oldeps * w1 - delta * w2) / gamma
        x = x + np.where(live & (oldb > 0), phi, 0.0) * w
        if not (beta > 1e-14 * beta1).any():
            break
    return x


def eigenpairs(cov: Covariance, k: int, tol: float = TOL, inner: int = INNER, seed: int = 3):
    """The ``k`` largest eigenvalues (falling) and unit eigenvectors of the covariance."""
    d = cov.d
    k = min(k, d)
    rng = np.random.default_rng(seed)
    basis = _orthonormal_add(np.zeros((d, 0)), rng.standard_normal((d, min(d, k + 8))))
    product = cov.times(basis)
    most = min(d, 3 * k + 8)
    while True:
        small = basis.T @ product
        theta, s = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-theta)
        theta, s = theta[order], s[:, order]
        ritz, aritz = basis @ s, product @ s
        residual = aritz - ritz * theta
        norms = np.linalg.norm(residual, axis=0)
        scale = max(abs(theta[0]), np.finfo(float).tiny)
        open_ = [j for j in range(k) if norms[j] > tol * scale]
        if not open_ or basis.shape[1] >= d and norms[:k].max() <= 1e3 * np.finfo(float).eps * scale:
            return theta[:k], ritz[:, :k]
        if cov.passes >= MAX_PASSES:
            raise RuntimeError(f"no convergence in {cov.passes} passes; residuals {norms[:k]}")
        wanted = ritz[:, :k]
        shifts = theta[open_]

        def project(block):
            return block - wanted @ (wanted.T @ block)

        def apply(block):
            inside = project(block)
            return project(cov.times(inside) - inside * shifts)

        corrections = _minres(apply, -project(residual[:, open_]), inner)
        if basis.shape[1] + len(open_) > most:  # restart on the best Ritz vectors
            keep = min(basis.shape[1], k + 8)
            basis, product = ritz[:, :keep], aritz[:, :keep]
        grown = _orthonormal_add(basis, corrections)
        if grown.shape[1] == basis.shape[1]:  # nothing new: add what the residuals point to
            grown = _orthonormal_add(basis, residual[:, open_])
            if grown.shape[1] == basis.shape[1]:
                return theta[:k], ritz[:, :k]
        added = grown[:, basis.shape[1]:]
        basis, product = grown, np.column_stack([product, cov.times(added)])


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS,
) -> DataFrame:
    """One row per usable row and component: id, ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``.

    Rows whose vector is null or holds a null or non-finite entry are dropped; so are rows
    whose vector is shorter or longer than the longest usable one. Entries are quantised
    (``quantised``); the fit list is each distinct quantised vector once: n of them with sums
    S. The covariance is over the fit list, divisor n, centred first. Components are its unit
    eigenvectors by falling eigenvalue e, up to ``k``, each with its largest entry positive.
    ``deviation`` is the sum of (n x - S)^2 (exact, long); ``whitened`` is x - S/n projected
    on the component, over sqrt(e), null where e is not above 1e-12 of the trace;
    ``explained`` is e over the trace (null if the trace is 0); ``identity_error`` the largest
    entry of the whitened fit list's covariance minus the identity (over components with a
    whitened value). Repeated rows each give their rows; an empty table gives none.
    """
    spark = rows.sparkSession
    good = rows.where(usable(F.col(vector_col)))
    width = good.agg(F.max(F.size(vector_col))).first()[0]
    if width is None or width == 0:
        return spark.createDataFrame([], f"{id_col} long, component int, n long, deviation long, "
                                         "whitened double, explained double, identity_error double")
    good = good.where(F.size(vector_col) == width).withColumn("_lm_x", quantised(F.col(vector_col)))
    fit = written(good.select(F.col("_lm_x").alias("x")).distinct(), "whitening-fit")
    n = fit.count()
    # Exact sums: a long per dimension.
    sums = [0] * width
    exact = fit.select(F.posexplode("x").alias("_lm_i", "_lm_v")).groupBy("_lm_i").agg(
        F.sum("_lm_v").alias("_lm_s")).collect()
    for r in exact:
        sums[r["_lm_i"]] = int(r["_lm_s"])
    cov = Covariance(fit, n, sums)
    values, vectors = eigenpairs(cov, k)
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    vectors = vectors * np.where(signs == 0, 1, signs)
    trace = float(cov._pass(lambda r: (r * r).sum(axis=0)).sum() / n)
    live = values > 1e-12 * trace if trace > 0 else np.zeros(len(values), bool)
    scale = np.where(live, 1 / np.sqrt(np.where(live, values, 1)), 0.0)
    loads = vectors * scale
    if live.any():
        gram = cov._pass(lambda r: (r @ loads).T @ (r @ loads)).reshape(len(values), len(values)) / n
        means = cov._pass(lambda r: (r @ loads).sum(axis=0)) / n
        wcov = gram - np.outer(means, means)
        idx = np.flatnonzero(live)
        error = float(np.abs(wcov[np.ix_(idx, idx)] - np.eye(len(idx))).max())
    else:
        error = None
    centred = F.transform("_lm_x", lambda v, i: (F.lit(n) * v - F.get(F.lit(sums), i)))
    deviation = F.aggregate(centred, F.lit(0).cast("long"), lambda a, c: a + c * c)
    comps = F.array(*[F.struct(
        F.lit(j + 1).alias("component"),
        F.lit(float(values[j] / trace) if trace > 0 else None).cast("double").alias("explained"),
        F.lit(bool(live[j])).alias("live"),
        F.array(*[F.lit(float(x)) for x in loads[:, j]]).alias("load")) for j in range(len(values))])
    keep = [c for c in rows.columns if c not in {"component", "n", "deviation", "whitened", "explained",
                                                  "identity_error"} and not c.startswith("_lm_")]
    out = good.select(*keep, "_lm_x", deviation.alias("deviation"), F.explode(comps).alias("_lm_c"))
    shifted = F.transform("_lm_x", lambda v, i: (F.lit(n) * v - F.get(F.lit(sums), i)).cast("double") / n)
    projected = F.aggregate(F.zip_with(shifted, F.col("_lm_c.load"), lambda a, b: a * b), F.lit(0.0),
                            lambda a, b: a + b)
    return out.select(
        *keep, F.col("_lm_c.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.col("_lm_c.live"), projected).alias("whitened"), F.col("_lm_c.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whiten(vectors).select("vec_id", "component", "n", "deviation", "whitened", "explained",
                                  "identity_error")
