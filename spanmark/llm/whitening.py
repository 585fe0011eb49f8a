"""Whitening of embeddings from an exact scatter, counted in residue numbers.

An entry c becomes the integer x = floor(1024 c) + 100000. With n vectors and sums S, y = n x - S is centred and an integer, so the
scatter G = sum of y yT is one too and the covariance is G / n**3. Each task reduces its y modulo several primes below 2**20 and
multiplies the residues as doubles, BLOCK rows at a time, which stays below 2**53 and so is exact; sums of residues are added up by
Spark, and Chinese remaindering over as many primes as the bound of G takes gives G itself. No digit cancels and no order of
summation shows. Then one double eigh.

Rows whose vector is null, or holds a null, NaN or infinity, or an entry with 1024 |c| >= 2**52 (whose x doubles can't tell apart) are dropped, and so are
vectors of another length than most have (the longer of two equally common lengths stays). Equal rows count each. A component without
variance (to double precision) has null in `whitened`. No vectors left: no rows. Other columns are ignored. What the driver gets are
sums by slot, dims * (dims + 1) / 2 rows at most; what tasks keep is one such matrix for each prime.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, trimmed, written

SCALE, SHIFT = 1024, 100_000
BLOCK = 1 << 13  # rows of one product: BLOCK * (2**19)**2 < 2**53
HALF = 26  # bits of the low part of a sum


def primes(product: int) -> list[int]:
    """The greatest primes below 2**20 whose product is above this."""
    out, so_far = [], 1
    for p in (q for q in count((1 << 20) - 1, -2) if all(q % d for d in range(3, 1024, 2))):
        if so_far > product:
            return out
        out.append(p)
        so_far *= p
    raise AssertionError


def reconstructed(residues: list[int], moduli: list[int]) -> int:
    """The integer of least magnitude with these residues."""
    whole, out = 1, 0
    for m in moduli:
        whole *= m
    for r, m in zip(residues, moduli, strict=True):
        rest = whole // m
        out += r * rest * pow(rest, -1, m)
    out %= whole
    return out - whole if out > whole // 2 else out


def integers(column, dims: int) -> np.ndarray:
    """x of an Arrow column of lists of doubles, a row a vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.floor(flat * SCALE).astype(np.int64) + SHIFT


def centred_residues(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """n x - S modulo p, between -p/2 and p/2, as doubles."""
    s = np.array([v % p for v in sums], np.int64)
    r = (n % p * (x % p) - s) % p
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def modular_scatter(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """The scatter of n x - S modulo p."""
    out = np.zeros((x.shape[1],) * 2, np.int64)
    for at in range(0, len(x), BLOCK):
        r = centred_residues(x[at : at + BLOCK], n, sums, p)
        out = (out + (r.T @ r).astype(np.int64)) % p
    return out


@dataclass
class Whitening:
    """A fitted transformation. components: a column each, by falling eigenvalue."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros_like(self.values)

    def varied(self) -> np.ndarray:
        """Which components have variance, to double precision."""
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(np.float64).eps

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """x - S / n as doubles, and per row the exact sum of (n x - S)**2."""
        reach = [max(abs(self.n * b - s), abs(self.n * a - s)) for a, b, s in zip(self.low, self.high, self.sums, strict=True)]
        small = sum(r * r for r in reach) < 1 << 63
        y = self.n * x.astype(np.int64 if small else object) - np.array(self.sums, np.int64 if small else object)
        return (y / self.n).astype(np.float64), (y * y).sum(axis=1).tolist()

    def applied(self, centred: np.ndarray) -> np.ndarray:
        """Components scaled to variance 1; null (NaN) where there is none."""
        scale = np.where(self.varied(), np.sqrt(np.where(self.varied(), self.values, 1)), np.nan)
        return centred @ self.components / scale


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and vector (doubles) of the rows that can be whitened, and only those of the commonest length."""
    v = F.col(vector).cast("array<double>")
    good = rows.select(F.col(key).alias("key"), v.alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda c: F.coalesce(F.abs(c) < float(2**52 // SCALE), F.lit(False)) & ~F.coalesce(F.isnan(c), F.lit(True))))
    common = good.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return good.where(F.size("vector") == (common["dims"] if common else 0))


def _sums(good: DataFrame) -> list:
    """n, S in two halves, least and greatest x of each dimension."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = integers(batch["vector"], len(batch["vector"][0]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array(np.full(x.shape[1], len(x))), pa.array((x >> HALF).sum(axis=0)), pa.array((x & ((1 << HALF) - 1)).sum(axis=0)), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], names=["dim", "n", "top", "rest", "low", "high"])

    parts = good.select("vector").mapInArrow(lambda batches: trimmed(rows(batches)), "dim long, n long, top long, rest long, low long, high long")
    return parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("top").alias("top"), F.sum("rest").alias("rest"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()


def exact_scatter(good: DataFrame, n: int, sums: list[int], low: list[int], high: list[int]) -> np.ndarray:
    """The scatter of n x - S, Python integers."""
    dims = len(sums)
    reach = max(max(abs(n * b - s), abs(n * a - s)) for a, b, s in zip(low, high, sums, strict=True))
    moduli = primes(2 * n * reach * reach + 1)
    upper = np.triu_indices(dims)

    def rows(batches):
        import pyarrow as pa

        parts = [np.zeros((dims, dims), np.int64) for _ in moduli]
        for batch in batches:
            if batch.num_rows:
                x = integers(batch["vector"], dims)
                parts = [(a + modular_scatter(x, n, sums, p)) % p for a, p in zip(parts, moduli, strict=True)]
        if any(p.any() for p in parts):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), *[pa.array(p[upper]) for p in parts]], names=["slot", *[f"r{k}" for k in range(len(moduli))]])

    names = [f"r{k}" for k in range(len(moduli))]
    summed = good.select("vector").mapInArrow(lambda batches: trimmed(rows(batches)), ", ".join(["slot long", *[f"{c} long" for c in names]])).groupBy("slot").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros((dims, dims), object)
    for r in summed.toLocalIterator():
        j, k = upper[0][r["slot"]], upper[1][r["slot"]]
        out[j, k] = out[k, j] = reconstructed([r[c] % p for c, p in zip(names, moduli, strict=True)], moduli)
    return out


def fit(good: DataFrame, most: int) -> Whitening | None:
    """Fitted on all rows of `good`; None if there are none."""
    found = _sums(good)
    if not found:
        return None
    n, sums = found[0]["n"], [(r["top"] << HALF) + r["rest"] for r in found]
    low, high = [r["low"] for r in found], [r["high"] for r in found]
    scatter = exact_scatter(good, n, sums, low, high)
    covariance = np.array([[int(g) / n**3 for g in row] for row in scatter], np.float64)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    trace = sum(int(scatter[k, k]) for k in range(len(sums))) / n**3
    return Whitening(n, sums, low, high, values, vectors * np.where(lead < 0, -1.0, 1.0), trace)


def transformed(good: DataFrame, made: Whitening) -> DataFrame:
    """key, deviation (decimal, exact) and whitened (a double a component) of each row."""
    from decimal import Decimal

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                centred, deviation = made.centred(integers(batch["vector"], len(made.sums)))
                white = made.applied(centred)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), pa.array(white.reshape(-1), from_pandas=True))
                yield pa.RecordBatch.from_arrays([batch["key"], pa.array([Decimal(d) for d in deviation], pa.decimal128(38, 0)), lists], names=["key", "deviation", "whitened"])

    kind = good.schema["key"].dataType.simpleString()
    return good.mapInArrow(lambda batches: trimmed(rows(batches)), f"key {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, components: list[int]) -> float | None:
    """The largest absolute entry of the covariance of these components minus the identity; covar_pop centres before it multiplies."""
    pairs = [(j, k) for j in components for k in components if j <= k]
    if not pairs:
        return None
    off = [F.abs(F.covar_pop(F.col("whitened")[j], F.col("whitened")[k]) - float(j == k)).alias(f"e{j}_{k}") for j, k in pairs]
    return max(white.agg(*off).first())


def whiten(spark: SparkSession, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """A row for each usable vector and component (at most `most`): key, component (from 1), n, deviation (long; null where it is beyond that),
    deviation_exact (decimal), whitened, explained and identity_error."""
    bound_batches(spark)
    good = usable(rows, key, vector)
    kind = good.schema["key"].dataType.simpleString()
    made = fit(good, most)
    if made is None:
        return spark.createDataFrame([], f"{key} {kind}, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double")
    white = written(spark, transformed(good, made), "whitened")
    error = identity_error(white, np.flatnonzero(made.varied()).tolist())
    shares = F.array(*[F.lit(float(v)) for v in made.explained])
    long = white.select("key", "deviation", F.posexplode("whitened").alias("at", "w"))
    return long.select(F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(made.n).cast("long").alias("n"), F.expr("try_cast(deviation as bigint)").alias("deviation"), F.col("deviation").alias("deviation_exact"), F.col("w").alias("whitened"), shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
