import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import whitening as w
from trafficlens.llm.queries import QUERIES


def spectra(rng):
    yield np.arange(1.0, 41.0)
    yield np.concatenate([np.ones(10), np.zeros(10), np.full(5, 1e-6)])
    yield 10.0 ** -np.arange(20)
    yield np.array([-1.0, 0.0, 1.0])
    yield np.zeros(4)
    yield np.full(6, 3.5)
    yield np.array([2.0])
    yield rng.standard_normal(64) ** 2
    yield np.concatenate([[1e6], np.full(30, 1.0)])


@pytest.mark.parametrize("turned", [True, False])
def test_eigen_against_lapack(turned):
    rng = np.random.default_rng(3)
    for e in spectra(rng):
        q = np.linalg.qr(rng.standard_normal((len(e), len(e))))[0] if turned else np.eye(len(e))
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        values, vectors = w.eigen(a)
        size = max(np.abs(e).max(), 1e-300)
        assert np.abs(values - np.sort(e)[::-1]).max() <= 1e-13 * size * len(e)
        assert np.abs(vectors.T @ vectors - np.eye(len(e))).max() < 1e-13 * max(10, len(e))
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size * len(e)


def test_polar_has_signs_as_eigenvalues():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 30))
    a += a.T
    u = w.polar(a)
    e, q = np.linalg.eigh(a)
    assert np.abs(u - (q * np.sign(e)) @ q.T).max() < 1e-12


def brute(rows, components=8):
    """Exact integers and LAPACK."""
    kept = [(i, v) for i, v in rows if v is not None and all(
        c is not None and math.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in kept)
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] + [100000] * (dims - len(v)) for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    centred = (n * np.array(x, dtype=object) - np.array(s, dtype=object))
    v = np.array((centred.T @ centred) / n ** 3, float)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    z = (np.array(centred, float) / n) @ q[:, :components] / np.sqrt(e[:components])
    return kept, n, deviation, z, e / e.sum(), q


def check(got, rows):
    kept, n, deviation, z, share, _ = brute(rows)
    k = min(8, z.shape[1])
    assert len(got) == len(kept) * k
    by = {}
    for r in got:
        by.setdefault((r[0], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    sign = np.zeros(k)
    for (i, _), d, line in zip(kept, deviation, z):
        for c in range(k):
            r = by[i, d][c + 1][0]
            assert r["n"] == n and math.isclose(r["explained"], share[c], rel_tol=1e-9)
            if not sign[c] and abs(line[c]) > 0.1:
                sign[c] = math.copysign(1, r["whitened"] * line[c])
            assert math.isclose(r["whitened"], sign[c] * line[c], abs_tol=1e-7) or not sign[c]


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.standard_normal(12) * np.arange(1, 13) ** 2])
            for i in range(200)]
    rows += [(300, None), (301, [float("nan")] * 12), (302, [1.0, None]), (303, [float("inf")] * 12),
             (304, []), (305, [0.5, 2.0]), (7, rows[7][1]), (None, rows[3][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {"v": F.lit(1), "k0": F.lit("x"), "component": F.lit(2), "n": F.lit(3)}).repartition(5)
    model = w.fit(frame)
    got = w.whiten(frame, model, ["vec_id"]).collect()
    check(got, rows)
    assert w.identity_error(frame, model) < 1e-9
    assert len(w.whiten(frame, model, ["vec_id", "n"]).columns) == 8


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float((-1) ** i * i * 10 ** 9), float(i)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = w.fit(frame)
    got = {r.k0: r for r in w.whiten(frame, model, ["vec_id"]).where("component = 1").collect()}
    _, _, deviation, *_ = brute(rows)
    for (i, _), d in zip(rows, deviation):
        assert int(got[i].deviation_exact) == d
        assert got[i].deviation == (d if d < 1 << 63 else None)
    assert any(d >= 1 << 63 for d in deviation)


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])],
                                 "vec_id long, embedding array<float>")
    model = w.fit(same)
    got = w.whiten(same, model, ["vec_id"]).collect()
    assert len(got) == 4 and {r.whitened for r in got} == {0.0} and {r.deviation for r in got} == {0}
    assert w.identity_error(same, model) == 1.0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)],
                                 "vec_id long, embedding array<float>")
    got = w.whiten(line, w.fit(line), ["vec_id"]).where("component = 2").collect()
    assert {r.whitened for r in got} == {0.0}
    for none in (same.limit(0), same.select("vec_id", F.array().cast("array<float>").alias("embedding"))):
        model = w.fit(none)
        assert w.whiten(none, model, ["vec_id"]).isEmpty() and w.identity_error(none, model) == 0.0


def test_query_against_brute_force(spark, sf_dir):
    got = QUERIES["op12_qdwh_whitening"](spark, sf_dir).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(got, rows)
    assert max(r.identity_error for r in got) < 1e-9
