"""Operator 13: embedding whitening by spectral divide and conquer with QDWH polar decompositions.

Components become integers, x = floor(64 * c) + 1000000. The fit list holds each distinct x once. Sums of its dimensions are
exact integers added by partition; the covariance is added by partition too, each vector centred before it is multiplied.
Only sums by dimension and by pair of dimensions come to the driver: their size is that of the covariance, whatever the rows.

There the covariance is split: the polar factor U of V - shift * I, from dynamically weighted Halley steps on QR
factorisations, is its matrix sign, so (I + U) / 2 projects on the subspace of eigenvalues over the shift. Orthonormal bases
of that subspace and its complement shrink V to two smaller blocks, which are split in turn until they are single values (or
multiples of the identity, which any basis suits). The components, one small matrix, are broadcast and one pass whitens all
rows. A second pass over the fit list measures the covariance of what it gives.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, and so are vectors of another length
than the most common one (of equally common lengths the longest); components over 2 ** 46 in size count as 2 ** 46;
null ids and repeated rows give rows like any other; a deviation that no long holds is null; a component without variance
(less than 1e-12 of the first, as with one distinct vector) has null whitened values, and of its variance nothing is
explained; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityweave.llm.common import columns_of, staged

SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**52
#: Components that are returned.
COMPONENTS = 16
#: Share of the first component's variance up to which a component counts as without variance.
NO_VARIANCE = 1e-12
EPS = float(np.finfo(float).eps)


def polar_sign(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, which is its matrix sign, by QDWH steps."""
    n = len(a)
    x, low = a / max(np.linalg.norm(a), np.finfo(float).tiny), EPS
    for _ in range(12):
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = math.sqrt(1 + d)
        wa = root + math.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.r_[math.sqrt(wc) * x, np.eye(n)])
        after = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * q[:n] @ q[n:].T
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x, low = after, min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if moved < EPS ** (1 / 3) and 1 - low < 10 * EPS:
            break
    return x


def divided(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces of the larger and the smaller eigenvalues; None where they are all alike."""
    n = len(a)
    diagonal = np.diag(a)
    mean, spread = diagonal.mean(), np.linalg.norm(a - np.eye(n) * diagonal.mean())
    if spread <= n * EPS * np.linalg.norm(a):
        return None
    random = np.random.default_rng(n)
    for shift in (np.median(diagonal), mean, *(mean + spread * random.uniform(-0.5, 0.5, 32) / math.sqrt(n))):
        sign = polar_sign(a - shift * np.eye(n))
        over = (np.eye(n) + sign) / 2
        k = round(float(np.trace(over)))
        if 0 < k < n and np.linalg.norm(over @ over - over) <= 1e-10 * n:
            bases = []
            for projector, size in ((over, k), (np.eye(n) - over, n - k)):
                basis = random.standard_normal((n, size))
                for _ in range(3):
                    basis, _ = np.linalg.qr(projector @ basis)
                bases.append(basis)
            return bases[0], bases[1]
    raise ArithmeticError("no shift parts the eigenvalues")


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, the largest entry of each positive) of a symmetric matrix."""
    found: list[tuple[float, np.ndarray]] = []
    left = [(v, np.eye(len(v)))]
    while left:
        a, basis = left.pop()
        parts = divided(a) if len(a) > 1 else None
        if parts is None:
            found += [(float(b @ v @ b), b) for b in basis.T]
            continue
        for part in parts:
            block = part.T @ a @ part
            left.append(((block + block.T) / 2, basis @ part))
    found.sort(key=lambda x: -x[0])
    vectors = np.stack([b / np.linalg.norm(b) for _, b in found], axis=1) if found else np.zeros((0, 0))
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if found else 1.0
    return np.array([e for e, _ in found]), vectors * signs


def integers(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x array<long>) of the rows that take part."""
    v = columns_of(rows, key, vector).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.where(F.col("v").isNotNull() & good)
    lengths = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    held = lambda c: F.greatest(F.least(F.floor(F.least(F.greatest(c * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))), F.lit(int(LARGEST))), F.lit(-int(LARGEST)))
    v = v.where(F.size("v") == (lengths[0].d if lengths else 0))
    return v.select("key", F.transform("v", lambda c: held(c) + OFFSET).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension: a row for each partition and dimension, added up."""

    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & ((1 << 26) - 1)).sum(axis=0)
        total = [Decimal((int(h) << 26) + int(lo)) for h, lo in zip(high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([*total, Decimal(n)], pa.decimal128(38, 0))], ["i", "s"])

    got = fit.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    by = {r.i: int(r.s) for r in got}
    return by.get(d, 0), [by.get(i, 0) for i in range(d)]


def moments(fit: DataFrame, d: int, n: int, total: list[int], project: np.ndarray | None = None) -> np.ndarray:
    """Mean products of the centred (and projected) vectors: a row for each partition and pair of columns, added up."""
    m = d if project is None else project.shape[1]
    held = fit.sparkSession.sparkContext.broadcast((np.array([s / n for s in total]), project))

    def run(batches):
        mean, to = held.value
        out = np.zeros((m, m))
        for batch in batches:
            x = _matrix(batch.column(0), d) - mean
            x = x if to is None else x @ to
            out += x.T @ x
        i, j = np.divmod(np.arange(m * m), m)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(out.ravel())], ["i", "j", "c"])

    rows = fit.select("x").mapInArrow(run, "i int, j int, c double").groupBy("i", "j").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros((m, m))
    out[rows["i"], rows["j"]] = rows["c"] / n
    return (out + out.T) / 2


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2 for each row, exact; None where no long holds it."""
    reach = max(n * int(np.abs(x).max(initial=0)), max(map(abs, total), default=0))
    if reach < 1 << 61:
        off = n * x - np.array(total, dtype=np.int64)
        if int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (off * off).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each row and each of its first
    `most` components."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    x = integers(rows, key, vector)
    fit = staged(x.select("x").distinct(), "fit-list")
    first = fit.head()
    d = len(first.x) if first else 0
    if not d:
        return spark.createDataFrame([], schema)
    n, total = sums(fit, d)
    values, vectors = components(moments(fit, d, n, total))
    trace = float(values.sum())
    m = min(most, d)
    told = values[:m] > max(NO_VARIANCE * values[0], 0.0)
    to = vectors[:, :m] / np.sqrt(np.where(told, values[:m], 1.0))
    error = float(np.abs(moments(fit, d, n, total, to[:, told]) - np.eye(int(told.sum()))).max()) if told.any() else None
    share = [float(e / trace) if t else 0.0 for e, t in zip(values[:m], told)]
    held = spark.sparkContext.broadcast((total, to))

    def run(batches):
        own_total, own_to = held.value
        mean = np.array([s / n for s in own_total])
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                size, ints = batch.num_rows, _matrix(batch.column(1), d)
                out = (ints - mean) @ own_to
                each = np.repeat(np.arange(size), m)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * m, n, dtype=np.int64)),
                    pa.array(deviations(ints, n, own_total), pa.int64()).take(pa.array(each)),
                    pa.array(out.ravel(), mask=np.tile(~told, size)),
                    pa.array(np.tile(share, size)),
                    pa.array([error] * (size * m), pa.float64()),
                ], schema.names)

    return x.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
