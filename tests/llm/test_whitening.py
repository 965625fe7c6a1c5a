"""Whitening against a dense eigensolver, and its odd rows."""

import numpy as np
import pytest

from cairn.llm import whitening
from cairn.session import table

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x string"


def plain(vectors):
    """(n, S, trace, values, vectors) of the distinct vectors of integers."""
    x = np.array(sorted({tuple(v) for v in vectors}), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, float(np.trace(centred.T @ centred / n)), values[::-1], basis[:, ::-1]


def integers(rows):
    return {i: [int(np.floor(256 * float(c))) for c in v] for i, v in rows}


def test_table(spark):
    docs = table(spark, DATA, "embeddings")
    x = integers([(r.vec_id, r.embedding) for r in docs.collect()])
    n, sums, trace, values, basis = plain(x.values())
    got = whitening.op12_whitening(spark, docs).collect()
    assert len(got) == 4 * len(x)
    signs = {}
    for r in got:
        row, k = x[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))
        want = float(np.dot([float(n * a - s) / n for a, s in zip(row, sums, strict=True)], basis[:, k]) / np.sqrt(values[k]))
        if abs(want) > 1e-3:
            sign = signs.setdefault(k, np.sign(want * r.whitened))
            assert r.whitened * sign == pytest.approx(want, rel=1e-8, abs=1e-8)
        assert r.explained == pytest.approx(values[k] / trace, rel=1e-10)
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.25], 1, "a"), (2, [0.5, -0.25, 0.0], 1, None), (None, [-0.001, 1.0], None, ""), (1, [2.0], 0, ""), (3, [], 0, ""), (4, None, 0, ""), (5, [None, 1.0], 0, ""), (6, [nan, 1.0], 0, ""), (7, [inf], 0, ""), (8, [1.0, 2.0, 3.0], 0, "")]
    got = whitening.op12_whitening(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    usable = [(1, [128, -64, 0]), (2, [128, -64, 0]), (None, [-1, 256, 0]), (1, [512, 0, 0]), (3, [0, 0, 0]), (8, [256, 512, 768])]
    n, sums, trace, values, basis = plain([v for _, v in usable])
    assert n == 5 and len(got) == 3 * len(usable) and {r.component for r in got} == {1, 2, 3}
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for i, v in usable)
    assert {round(r.explained, 10) for r in got} == {round(float(v / trace), 10) for v in values}
    assert max(r.identity_error for r in got) < 1e-9


@pytest.mark.parametrize("rows", [[], [(4, None, 0, "")], [(3, [], 0, "")]])
def test_empty(spark, rows):
    got = whitening.op12_whitening(spark, spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not got.collect()


def test_without_variance(spark):
    rows = [(i, [1.0, 2.0], 0, "") for i in range(3)]
    got = whitening.op12_whitening(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    rows = [(1, [1.0, 2.0], 0, ""), (2, [3.0, 2.0], 0, "")]
    got = whitening.op12_whitening(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.component, r.explained) for r in got) == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 0.0)]
    assert [abs(r.whitened) for r in got if r.component == 1] == [1.0, 1.0] and {r.whitened for r in got if r.component == 2} == {None}


def test_large_entries(spark):
    """Wide integers: deviations stay exact as decimals, and are null where a long cannot hold them."""
    rows = [(1, [3.0e9, 1.0], 0, ""), (2, [-3.0e9, 2.0], 0, ""), (3, [1.0e38, 0.0], 0, "")]
    x = [[min(1 << 61, int(256 * float(np.float32(c)))) for c in v] for _, v, _, _ in rows[:2]]
    df = spark.createDataFrame(rows[:2], SCHEMA)
    n, sums = 2, [sum(c) for c in zip(*x, strict=True)]
    want = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert sorted(int(r.deviation) for r in whitening.whiten(df).collect() if r.component == 1) == sorted(want)
    assert {r.deviation for r in whitening.op12_whitening(spark, df).collect()} == {None}
    x.append([1 << 61, 0])
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert sorted(int(r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() if r.component == 1) == sorted(want)


@pytest.mark.parametrize("values", [[5.0, 5, 5, 1, 0, 0], [9.0, 3, 3, 3, 3, 3, 2, 1], [1.0] * 8, [4.0, 1e-9, 1e-9, 0], [7.0]])
def test_solver(values):
    """Multiple and vanishing eigenvalues, in a turned basis."""
    d = len(values)
    turn = np.linalg.qr(np.random.default_rng(3).standard_normal((d, d)))[0]
    matrix = turn @ np.diag(values) @ turn.T
    found, vectors, left = whitening.leading(lambda b: matrix @ b, d, 4, float(np.trace(matrix)))
    k = min(4, d)
    assert np.allclose(found, sorted(values)[::-1][:k], atol=1e-13 * max(values) * d)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12) and left.max() <= 4 * d * whitening.EPS * max(values)
    assert np.allclose(matrix @ vectors, vectors * found, atol=1e-12 * max(values))
