"""Whitening against exact rational arithmetic."""

from fractions import Fraction
from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from folio.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x int, n string, i int, label int"


def exact(vectors):
    """n, sums, covariance (as fractions) of the distinct integer vectors."""
    fit = sorted({tuple(floor(64 * c) + 1_000_000 for c in v) for v in vectors})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    v = [[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3) for j in range(d)] for i in range(d)]
    return fit, n, s, v


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "n", 2, 3) for k, v in rows], SCHEMA).repartition(3)


def check(spark, rows, components=W.COMPONENTS):
    good = [(k, [float(np.float32(c)) for c in v]) for k, v in rows if v is not None and all(c is not None and isfinite(c) for c in v)]
    _, n, s, v = exact([x for _, x in good])
    e, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    e, vectors = e[::-1], vectors[:, ::-1]
    got: dict = {}
    for r in W.whiten(frame(spark, rows)).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == {k for k, _ in good}
    errors = {r["identity_error"] for x in got.values() for r in x.values()}
    assert len(errors) == 1 and (next(iter(errors)) or 0) <= 1e-4
    signs: dict = {}
    for k, vector in good:
        x = [floor(64 * c) + 1_000_000 for c in vector]
        deviation = sum((n * c - t) ** 2 for c, t in zip(x, s))
        centred = np.array([float(Fraction(c) - Fraction(t, n)) for c, t in zip(x, s)])
        assert sorted(got[k]) == list(range(1, min(components, len(x)) + 1))
        for c, r in got[k].items():
            assert r["n"] == n and r["deviation"] == (deviation if deviation < 2**63 else None)
            if e[c - 1] <= len(x) * np.finfo(float).eps * e[0]:
                assert r["whitened"] is None
                continue
            want = centred @ vectors[:, c - 1] / np.sqrt(e[c - 1])
            if abs(want) > 1e-6:
                signs.setdefault(c, np.sign(want) * np.sign(r["whitened"]))
            assert abs(want * signs.get(c, 1) - r["whitened"]) < 1e-6
            assert abs(r["explained"] - e[c - 1] / e.sum()) <= 1e-6


def test_primes_and_reconstruction():
    for bound in (0, 5, 2**40, 2**160):
        p = W.primes(bound)
        assert all(q < 2**21 for q in p) and len(set(p)) == len(p)
        for value in (bound, -bound, bound // 3):
            assert W.reconstruct([value % q for q in p], p) == value


def test_scatter_is_exact(spark):
    r = np.random.default_rng(1)
    x = r.integers(-(2**40), 2**40, (300, 5))
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<bigint>").repartition(4)
    m = W.moments(fit)
    assert m.n == 300 and m.sums == [int(sum(map(int, c))) for c in x.T]
    y = [[int(a) - b for a, b in zip(v, m.centre)] for v in x.tolist()]
    assert W.scatter(fit, m) == [[sum(v[i] * v[j] for v in y) for j in range(5)] for i in range(5)]


def test_whitened(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(200, 20)) * np.linspace(1, 30, 20)
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(1_000 + k, rows[0][1]) for k in range(150)]  # one very common vector
    rows += [(2_000, None), (2_001, [nan] * 20), (2_002, [inf] + [0.0] * 19), (2_003, [None] + [0.0] * 19)]
    check(spark, rows)


def test_few_and_flat_vectors(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 3.0])])
    one = W.whiten(frame(spark, [(1, [0.5, 0.5]), (None, [0.5, 0.5])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["n"] == 1 and r["explained"] is None for r in one)


def test_large_entries(spark):
    check(spark, [(k, [float(2**50) * k, 1.0 * k * k]) for k in range(5)])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_fit(spark, rows):
    assert W.whiten(frame(spark, rows)).count() == 0


def test_other_lengths_are_left_out(spark):
    got = W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0])])).collect()
    assert {r["vec_id"] for r in got} == {1, 2}


def test_query_on_the_given_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(120).collect()]
    check(spark, rows)
    assert W.op12_whitening(spark, sf).count() == 16 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
