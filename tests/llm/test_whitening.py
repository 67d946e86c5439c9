"""Whitening against exact whole numbers and numpy's eigenvectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.llm import queries, whitening


def on_lattice(vector):
    return [math.floor(64 * float(c)) + 1000000 for c in vector]


def vectors():
    rng = random.Random(3)
    basis = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(5)]
    rows = []
    for k in range(300):
        mix = [rng.gauss(0, 3 / (1 + j)) for j in range(5)]
        rows.append((k, [sum(m * b[d] for m, b in zip(mix, basis)) + rng.gauss(0, 0.05) for d in range(20)]))
    rows += [(1000 + k, rows[7][1]) for k in range(200)]
    odd = [(2000, None), (2001, [float("nan")] * 20), (2002, [1.0] * 19 + [None]), (2003, [float("inf")] * 20), (2004, [1.0, 2.0]), (None, rows[3][1])]
    return rows, odd


def check(out, rows, dimensions, wanted=16):
    x = {k: on_lattice(v) for k, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    by_component = {}
    for r in out:
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums))
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-6
        want = (np.array(x[r.vec_id]) - np.array(sums) / n) @ axes[:, r.component - 1] / np.sqrt(values[r.component - 1])
        by_component.setdefault(r.component, []).append((r.whitened, want))
    assert sorted(by_component) == list(range(1, min(wanted, dimensions) + 1))
    for found in by_component.values():
        got, want = np.array(found).T
        sign = np.sign(got @ want)
        assert np.abs(sign * got - want).max() < 1e-7 and len(got) == len(rows)


def test_matches_exact_numbers(spark, tmp_path):
    rows, odd = vectors()
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "x": F.lit("clash"), "whitened": F.lit(0)})
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    out = queries.QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).collect()
    assert sorted(r.component for r in out if r.vec_id is None) == list(range(1, 17))
    check([r for r in out if r.vec_id is not None], rows, 20)


def test_given_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding is not None]
    check(queries.QUERIES["op12_embedding_whitening"](spark, folder).collect(), rows, 64)


@pytest.mark.parametrize("kind", ["spread", "equal", "cluster", "blocks", "low rank", "nought", "one"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(1)
    size = 1 if kind == "one" else 40
    values = {
        "spread": np.geomspace(1, 1e-6, size), "equal": np.ones(size), "cluster": 1 + 1e-12 * np.arange(size), "blocks": np.repeat([5.0, 5.0, 2.0, 1.0], 10),
        "low rank": np.r_[3.0, 2.0, np.zeros(38)], "nought": np.zeros(size), "one": np.array([7.0]),
    }[kind]
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading(matrix, 16)
    assert np.abs(found - np.sort(values)[::-1][:16]).max() < 1e-12 * max(values.max(), 1)
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-11 * max(values.max(), 1)


def test_tables_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        usable = whitening.usable(spark.createDataFrame(rows, schema), "embedding")
        model = whitening.fit(usable, "embedding")
        assert not len(model.values)
        assert [list(r.whitened) for r in whitening.apply(usable, "embedding", model).collect()] == [[]] * sum(bool(v) or v == [] for _, v in rows)


def test_exact_beyond_machine_numbers():
    model = whitening.Whitening(10**13, [10**19, -3], np.eye(2), np.ones(2), np.ones(2))
    assert model.deviations(np.array([[10**6 + 1, 5]])) == [(10**13) ** 2 + (5 * 10**13 + 3) ** 2]
