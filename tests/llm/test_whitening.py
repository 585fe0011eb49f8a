"""Whitening against exact integers and fractions."""

import math

import numpy as np
import pytest

from spanmark.llm import whitening as wh
from spanmark.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, component string"


def exact(vectors):
    """n, deviations, eigenvalues, eigenvectors and trace from Python integers."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    scatter = [[sum(r[i] * r[j] for r in y) for j in range(len(sums))] for i in range(len(sums))]
    cov = np.array([[g / n**3 for g in row] for row in scatter])
    values, vectors_ = np.linalg.eigh(cov)
    return n, [sum(c * c for c in r) for r in y], values[::-1], vectors_[:, ::-1], np.trace(cov), np.array([[c / n for c in r] for r in y]), scatter


def check(spark, rows, good):
    got = wh.whiten(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).toPandas().sort_values(["vec_id", "component"], kind="stable")
    n, deviation, values, vectors, trace, centred, _ = exact([v for _, v in good])
    most = min(8, len(good[0][1]))
    assert len(got) == n * most and (got["n"] == n).all()
    dev = dict(zip([i for i, _ in good], deviation, strict=True))
    assert all(int(r.deviation_exact) == dev[r.vec_id] for r in got.itertuples())
    for k in range(most):
        mine = got[got["component"] == k + 1].set_index("vec_id").loc[[i for i, _ in good], "whitened"].to_numpy()
        theirs = centred @ vectors[:, k] / math.sqrt(values[k])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-9
        assert abs(got["explained"][got["component"] == k + 1].iloc[0] - values[k] / trace) < 1e-12
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    return got


def test_equals_exact_sums(spark):
    """Nulls, non-finite entries, another length, entries of 2**42 and more are dropped; equal rows count each."""
    rng = np.random.default_rng(1)
    good = [(k, [float(np.float32(c)) for c in rng.normal(0, 1 + k % 3, 5)]) for k in range(60)]
    good += [(60, good[0][1]), (61, good[0][1])]
    bad = [(70, None), (71, [1.0, None, 0.0, 0.0, 0.0]), (72, [float("nan")] + [0.0] * 4), (73, [float("-inf")] + [0.0] * 4), (74, [1.0] * 6), (75, []), (76, [1e30] + [0.0] * 4)]
    got = check(spark, [(i, v, "clash") for i, v in good + bad], good)
    assert got["deviation"].notna().all()


def test_great_entries_stay_exact(spark):
    """Entries near 2**41: centred numbers pass 64 bits, deviation is beyond a long and its decimal is exact."""
    rng = np.random.default_rng(2)
    good = [(k, [float(np.float32(c)) for c in rng.normal(0, 2**39, 3)]) for k in range(25)]
    rows = [(i, v, "x") for i, v in good]
    got = wh.whiten(spark, spark.createDataFrame(rows, SCHEMA)).toPandas()
    dev = dict(zip([i for i, _ in good], exact([v for _, v in good])[1], strict=True))
    assert all(int(r.deviation_exact) == dev[r.vec_id] for r in got.itertuples())
    assert all((r.deviation == dev[r.vec_id]) if dev[r.vec_id] < 2**63 else np.isnan(r.deviation) for r in got.itertuples())


def test_scatter_is_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(np.float32(c)) for c in rng.normal(0, 1, 4)] for _ in range(40)]
    good = wh.usable(spark.createDataFrame([(k, v, "") for k, v in enumerate(vectors)], SCHEMA).repartition(4), "vec_id", "embedding")
    made = wh.fit(good, 8)
    assert wh.exact_scatter(good, made.n, made.sums, made.low, made.high).tolist() == exact(vectors)[6]


@pytest.mark.parametrize("value", [0, 1, -1, 12345678901234567890, -(10**25)])
def test_residues_give_the_number_back(value):
    moduli = wh.primes(2 * abs(value) + 1)
    assert wh.reconstructed([value % p for p in moduli], moduli) == value
    assert all(p < 1 << 20 and all(p % d for d in range(2, 1024)) for p in moduli) and len(set(moduli)) == len(moduli)


def test_no_variance_and_empty(spark):
    """Equal rows have nothing to whiten; one constant dimension leaves its component null; no rows, no result."""
    same = wh.whiten(spark, spark.createDataFrame([(1, [1.0, 2.0], ""), (1, [1.0, 2.0], "")], SCHEMA)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] is None for r in same)
    flat = wh.whiten(spark, spark.createDataFrame([(k, [float(k), 7.0], "") for k in range(5)], SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    empty = wh.whiten(spark, spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == same[0].__fields__


def test_whole_table(spark):
    got = op12_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == 500 * 8 and got["identity_error"].max() < 1e-9 and got["explained"].is_monotonic_decreasing is False
