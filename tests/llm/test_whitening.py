import numpy as np
import pytest

from comarca.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, whitened double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 0.5) for i, v in rows], SCHEMA).repartition(3)


def valid(rows, dim):
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and len(v) == dim and None not in v]
    return [(i, v) for i, v in kept if np.isfinite(v).all()]


def check(found, rows, dim, most=32):
    kept = valid(rows, dim)
    x = np.array([np.floor(64 * v) + 1_000_000 for _, v in kept])
    n, mean = len(x), x.mean(0)
    cov = (x - mean).T @ (x - mean) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-10 * values.sum()).sum()))
    assert len(found) == n * k
    total = [sum(int(r[j]) for r in x) for j in range(dim)]
    white = {}
    for r in found:
        white.setdefault(r["component"], []).append((r["vec_id"], r["whitened"]))
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-6
    assert sorted(white) == list(range(1, k + 1))
    deviations = sorted((i, sum((n * int(a) - t) ** 2 for a, t in zip(row, total, strict=True))) for (i, _), row in zip(kept, x, strict=True))
    assert sorted({(r["vec_id"], r["deviation"]) for r in found}) == sorted(set(deviations))
    for c in range(1, k + 1):
        apart = min([abs(values[c - 1] - v) for j, v in enumerate(values) if j != c - 1] or [1.0])
        if apart > 1e-6 * values.sum():
            want = (x - mean) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
            got = np.array([w for _, w in sorted(white[c])])
            want = np.array([w for _, w in sorted(zip([i for i, _ in kept], want, strict=True))])
            assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7


def test_against_a_dense_eigensolver(spark):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(0, 1, 40) @ np.diag(1 / np.arange(1, 41))).tolist()) for i in range(300)]
    rows += [(900, None), (901, []), (902, [None] * 40), (903, [float("nan")] * 40), (904, [float("inf")] * 40)]
    check(whitening.whiten(table(spark, rows)).collect(), rows, 40)


def test_lengths_are_fit_apart(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(0, 3, 5 if i % 3 else 7).tolist()) for i in range(200)]
    found = whitening.whiten(table(spark, rows)).collect()
    for dim in (5, 7):
        ids = {i for i, _ in valid(rows, dim)}
        check([r for r in found if r["vec_id"] in ids], rows, dim)


def test_several_parts_of_lengths(monkeypatch, spark):
    monkeypatch.setattr(whitening, "CELLS", 30)
    test_lengths_are_fit_apart(spark)


def test_equal_eigenvalues_and_missing_variance(spark):
    # every sign pattern of three entries: three equal eigenvalues; the fourth entry never changes
    rows = [(i, [*(float(1 - 2 * (i >> b & 1)) for b in range(3)), 5.0]) for i in range(16)]
    found = whitening.whiten(table(spark, rows)).collect()
    assert len(found) == 16 * 3 and max(r["identity_error"] for r in found) < 1e-9
    assert {round(r["explained"], 12) for r in found} == {round(1 / 3, 12)}
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 4)).collect() == []
    assert whitening.whiten(table(spark, [])).collect() == []


def test_repeated_rows_missing_ids_and_large_entries(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (4, [1e30, -1e30]), (5, [0.0, 0.5])]
    found = whitening.whiten(table(spark, rows)).collect()
    assert len(found) == 5 * 1 and sum(r["vec_id"] is None for r in found) == 1
    assert all(r["deviation"] is None for r in found)


@pytest.mark.parametrize("dim", [1, 2, 9, 33])
def test_counts_are_those_of_the_spectrum(dim):
    draw = np.random.default_rng(dim)
    for turn in range(20):
        a = draw.normal(size=(dim, dim))
        a = a + a.T
        if turn % 3 == 0:
            np.fill_diagonal(a, 0)  # no pivot on the diagonal to start with
        values = np.linalg.eigvalsh(a)
        for shift in draw.uniform(values[0] - 1, values[-1] + 1, 8):
            assert whitening.above(a, shift) == int((values > shift).sum())


def test_close_eigenvalues_stay_orthogonal():
    draw = np.random.default_rng(5)
    q = np.linalg.qr(draw.normal(size=(12, 12)))[0]
    values = np.array([1, 1 - 1e-7, 1 - 2e-7, 0.5, 0.5, 0.5 - 1e-11, 0.2, 0.1, 0.1 - 1e-5, 1e-3, 1e-6, 0])
    v = q @ np.diag(values / values.sum()) @ q.T
    v = (v + v.T) / 2
    found = [whitening.component(v, k) for k in range(1, 13)]
    assert found[11] is None
    vectors = np.array([x for _, x, _, _ in found[:11]]).T
    assert np.abs(vectors.T @ vectors - np.eye(11)).max() < 1e-6
    assert np.allclose([f[0] for f in found[:11]], values[:11] / values.sum(), rtol=1e-6)
    assert all(over < k <= level for k, (_, _, over, level) in enumerate(found[:11], 1))
