"""Whitening (operator 13) against numpy's dense eigensolver on the same fit list."""

import math

import numpy as np

from listmill.llm import whitening


def dense(vectors, k=16):
    x = np.array([[math.floor(float(c) * 64) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)
    return x, n, s, e[order][:k], u[:, order][:, :k], np.trace(cov)


def _check(rows, vectors, k=16):
    x, n, s, e, u, trace = dense(vectors, k)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    for i, xi in enumerate(x):
        for j in range(len(e)):
            r = by[(i, j + 1)]
            assert r["n"] == n and r["deviation"] == int(((n * xi - s) ** 2).sum())
            assert math.isclose(r["explained"], e[j] / trace, rel_tol=1e-9)
            want = (xi - s / n) @ u[:, j] / math.sqrt(e[j])
            assert math.isclose(abs(r["whitened"]), abs(want), rel_tol=1e-7, abs_tol=1e-9)
    assert rows[0]["identity_error"] <= 1e-4


def test_query_against_dense(spark, sf):
    import pyarrow.parquet as pq
    table = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    rows = whitening.query(spark, sf).collect()
    vectors = table["embedding"]
    ids = {v: i for i, v in enumerate(table["vec_id"])}
    _check([r.asDict() | {"vec_id": ids[r["vec_id"]]} for r in rows], vectors)
    # One sign for all rows: each component's largest entry is positive, so reruns agree.
    again = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.query(spark, sf).collect()}
    assert all(again[(r["vec_id"], r["component"])] == r["whitened"] for r in rows)


def test_dropped_repeated_and_few_dimensions(spark):
    rng = np.random.default_rng(1)
    good = [list(map(float, rng.standard_normal(5))) for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(good)] + [(40, good[0]), (41, None), (42, [1.0, None, 0.0, 0.0, 0.0]),
                                                   (43, [float("nan")] * 5), (44, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = whitening.whiten(frame).collect()
    assert sorted({r["vec_id"] for r in out}) == list(range(41))
    assert {r["component"] for r in out} == {1, 2, 3, 4, 5}
    _check([r.asDict() for r in out if r["vec_id"] < 40], good, 16)
    assert out[0]["n"] == 40  # the repeated vector counts once in the fit list


def test_degenerate_and_empty(spark):
    frame = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    out = whitening.whiten(frame).collect()
    assert len(out) == 4 and all(r["whitened"] is None and r["deviation"] == 0 for r in out)
    assert whitening.whiten(frame.limit(0)).count() == 0
