"""Whitening of embeddings over an exact scatter matrix.

Method: residue-number scatter.  Entries are made integers, and each distinct integer vector counts once.  Each task
multiplies its vectors, less a common integer centre, modulo several primes below 2^21, where products of up to 4,096 rows
are exact in double precision; the tasks' matrices are added up by Spark, and Chinese remaindering gives every entry of the
scatter as an exact integer.  From it the covariance follows without cancellation: each entry is one exact quotient,
rounded once, and is decomposed in double precision.  As many primes are used as the largest possible entry needs.

What reaches the driver grows with the square of the dimension only.  Vectors travel once, to find the distinct ones,
after repeats within a task are gone; repeats of one vector, however many, therefore never meet in a task.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, and so are rows with an
entry of 2^55 or more (whose integers' differences a long may not hold) and rows whose vector is not of the most frequent length (of
equally frequent ones the greatest).  Equal vectors get equal results, repeated rows a result each; a null vec_id
stays.  Components without variance (an eigenvalue that rounding can't tell from zero) have a null `whitened`; where no
vector varies, `explained` and `identity_error` are null too.  A deviation that no long can hold is null.  An empty table
gives an empty result; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**55
ROWS = 4_096  # (2^20)^2 * 4096 = 2^52: sums of products of residues are exact doubles
TOP = 2**21
COMPONENTS = 16
LONG = 2**63 - 1


def primes(bound: int) -> list[int]:
    """The largest primes below 2^21 whose product exceeds 2 * bound + 1, so that they tell all integers of at most that size apart."""
    out, n = [], TOP
    while prod(out) <= 2 * bound + 1:
        n -= 1
        if all(n % k for k in range(2, isqrt(n) + 1)):
            out.append(n)
    return out


def reconstruct(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size with these residues."""
    value, span = 0, 1
    for r, p in zip(residues, moduli):
        value += span * ((r - value) * pow(span, -1, p) % p)
        span *= p
    return value - span if 2 * value > span else value


def integers(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """vec_id and x, the vector as integers, of the rows that count."""
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))  # NaN is above every number
    kept = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & finite)
    if dimension is not None:
        kept = kept.where(F.size("embedding") == dimension)
    return kept.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _blocks(batches):
    for batch in batches:
        x = _matrix(batch.column(batch.schema.get_field_index("x"))) if len(batch) else np.zeros((0, 0), np.int64)
        for at in range(0, len(x), ROWS):
            yield x[at : at + ROWS]


@dataclass
class Moments:
    """Of distinct vectors: how many, sums by dimension, an integer centre, and the greatest distance of an entry from it."""

    n: int
    sums: list[int]
    centre: list[int]
    reach: int

    @property
    def rest(self) -> list[int]:
        """Sums of what is left after the centre is taken away."""
        return [s - self.n * c for s, c in zip(self.sums, self.centre)]


def moments(fit: DataFrame) -> Moments | None:
    """fit(x): exact, for high and low halves of the entries are summed apart."""

    def run(batches):
        total = None
        for x in _blocks(batches):
            part = [np.full(x.shape[1], len(x)), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), x.min(0), x.max(0)]
            total = part if total is None else [*(a + b for a, b in zip(total[:3], part[:3])), np.minimum(total[3], part[3]), np.maximum(total[4], part[4])]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total[0])), pa.int32()), *(pa.array(c, pa.int64()) for c in total)], names=["i", "n", "high", "low", "least", "most"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.mapInArrow(run, "i int, n long, high long, low long, least long, most long").groupBy("i").agg(F.sum("n").alias("n"), wide("high"), wide("low"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["i"])
    n = rows[0]["n"]
    sums = [int(r["high"]) * 2**32 + int(r["low"]) for r in rows]
    centre = [s // n for s in sums]
    return Moments(n, sums, centre, max(max(r["most"] - c, c - r["least"]) for r, c in zip(rows, centre)))


def scatter(fit: DataFrame, m: Moments) -> list[list[int]]:
    """The exact sums of products of centred entries, as a symmetric matrix."""
    moduli, centre, d = primes(m.n * m.reach**2), np.array(m.centre, np.int64), len(m.centre)
    rows, columns = np.triu_indices(d)

    def run(batches):
        totals = [np.zeros((d, d), np.int64) for _ in moduli]
        seen = False
        for x in _blocks(batches):
            seen = True
            for p, total in zip(moduli, totals):
                r = (x - centre) % p
                r = np.where(r > p // 2, r - p, r).astype(np.float64)
                total += (r.T @ r).astype(np.int64) % p
                total %= p
        for k, total in enumerate(totals if seen else []):
            size = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k), pa.int32()), pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array(total[rows, columns], pa.int64())], names=["k", "i", "j", "r"])

    sums = fit.mapInArrow(run, "k int, i int, j int, r long").groupBy("i", "j").agg(*(F.sum(F.when(F.col("k") == k, F.col("r"))).alias(f"r{k}") for k in range(len(moduli)))).collect()
    out = [[0] * d for _ in range(d)]
    for row in sums:
        i, j, *residues = row
        out[i][j] = out[j][i] = reconstruct([r % p for r, p in zip(residues, moduli)], moduli)
    return out


def covariance(m: Moments, products: list[list[int]]) -> np.ndarray:
    """Each entry is an exact quotient, rounded once."""
    s = m.rest
    return np.array([[(m.n * products[i][j] - s[i] * s[j]) / m.n**2 for j in range(len(s))] for i in range(len(s))])


@dataclass
class Whitening:
    moments: Moments
    values: np.ndarray  # eigenvalues, falling, as many as components are wanted
    vectors: np.ndarray  # a column for each
    trace: float

    @property
    def varying(self) -> np.ndarray:
        return self.values > len(self.vectors) * np.finfo(float).eps * max(self.values[0], 0.0) if len(self.values) else np.zeros(0, bool)

    def projection(self) -> tuple[np.ndarray, np.ndarray]:
        """(W, mean): centred integers, less mean, times W are whitened."""
        scale = np.where(self.varying, 1 / np.sqrt(np.where(self.varying, self.values, 1.0)), np.nan)
        return self.vectors * scale, np.array([s / self.moments.n for s in self.moments.rest])


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    m = moments(fit)
    if m is None:
        return None
    v = covariance(m, scatter(fit, m))
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:components]
    return Whitening(m, values[order], vectors[:, order], float(np.trace(v)))


def identity_error(fit: DataFrame, w: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over the components that vary."""
    if not w.varying.any():
        return None
    centre, (projection, mean) = np.array(w.moments.centre, np.int64), w.projection()
    projection = projection[:, w.varying]
    k = projection.shape[1]

    def run(batches):
        total = np.zeros((k + 1, k))  # products, and sums in the last row
        for x in _blocks(batches):
            y = ((x - centre) - mean) @ projection
            total += np.vstack([y.T @ y, y.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    rows = fit.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1) * k)
    for r in rows:
        total[r["at"]] = r["v"]
    total = total.reshape(k + 1, k) / w.moments.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """The exact sums of (n * x - rest)^2 of each row of centred integers; None where no long holds it."""
    near = ((x.astype(np.float64) * n - rest.astype(np.float64)) ** 2).sum(1)
    sure = near < 0.99 * LONG
    out: list[int | None] = [None] * len(x)
    for i, v in zip(np.flatnonzero(sure), ((x[sure] * n - rest.astype(np.int64)) ** 2).sum(1).tolist() if sure.any() else []):
        out[i] = v
    for i in np.flatnonzero(~sure & (near < 1.01 * LONG)):
        v = sum((int(c) * n - int(s)) ** 2 for c, s in zip(x[i], rest))
        out[i] = v if v <= LONG else None
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row that counts and each component."""
    columns = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([vectors.schema["vec_id"], *(T.StructField(c, t) for c, t in columns)])
    spark = vectors.sparkSession
    lengths = integers(vectors).groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or lengths["d"] == 0:
        return spark.createDataFrame([], schema)
    rows = integers(vectors, lengths["d"])
    fit = common.durable(rows.select("x").distinct(), "vectors")
    w = fitted(fit, components)
    error = identity_error(fit, w)
    (projection, mean), centre = w.projection(), np.array(w.moments.centre, np.int64)
    n, rest, k = w.moments.n, np.array(w.moments.rest, dtype=object), len(w.values)
    explained = [float(e) / w.trace if w.trace > 0 else None for e in w.values]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1)) - centre
            y = (x - mean) @ projection
            repeat = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(repeat), n), pa.int64()), pa.array(deviations(x, n, rest), pa.int64()).take(pa.array(repeat)),
                    pa.array(y.ravel(), pa.float64(), from_pandas=True), pa.array(explained * len(x), pa.float64()), pa.array([error] * len(repeat), pa.float64()),
                ], names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.read(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLE_SQL: dict[str, str] = {}
