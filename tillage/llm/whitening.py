"""Whitening of embeddings by block Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers (``floor(scale * c) + shift``), are centred exactly and never multiplied before that.  From
a random block of directions V1 the iteration alternates two distributed products: P = X V_j, whose part outside the left
vectors found so far is made orthonormal (U_j), and Z = X' U_j, whose part outside all right vectors gives V_j+1.
Both sides are reorthogonalised in full, twice.  U is as long as the table, so it is never stored: U = X W with a small
W, and a task works out the entries of its own rows.  U'XV is block bidiagonal; its singular values are the deviations
and its right singular vectors, taken through V, the components.

A start block of ``block`` directions finds up to that many copies of one deviation.  The iteration ends when the wanted
components have residuals at rounding level, unless ``block`` or more of them share a deviation; then, or if residuals
stay, it goes on until V spans all dimensions, where it is exact.  A block that yields no new direction (an invariant
subspace) is filled up with random ones.  A pass sends a few numbers for each dimension from each task; they are summed by
Spark, so that the driver gets (dimensions + components) x ``block`` numbers.

Vectors that are null, or hold null or non-finite entries, take no part.  Entries beyond 2**55 count as that much.
Vectors of different dimensions are whitened apart, each dimension with its own n.  A component whose variance is less
than TOLERANCE of the largest counts as none, so constant dimensions, repeated rows only, or a single row give fewer
components or no rows at all.  Rows that repeat an id, or have none, are rows of their own; equal vectors get, up to rounding, equal
results.  Deviations beyond 64 bits count as the largest 64-bit number.  An empty table gives an empty result; other
columns are passed by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import shared
from tillage.llm.topk import usable

SCALE, SHIFT, COMPONENTS, BLOCK = 64, 1_000_000, 32, 8
#: Bytes of whole numbers packed into one row of the scratch table.
PACKED = 1 << 21
TOLERANCE = 1e-12
LARGEST = 2.0**55
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def packed(table: DataFrame, id_col: str, vector: str, scale: int, shift: int) -> DataFrame:
    """dim, n, ids, x: the whole numbers of up to PACKED bytes of vectors of one dimension, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            ids = pa.concat_arrays([p[0] for p in parts])
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([b"".join(p[1].tobytes() for p in parts)], pa.binary())],
                names=["dim", "n", "ids", "x"],
            )

        for batch in batches:
            v = batch.column("v")
            dims = np.asarray(v.value_lengths())
            for dim in np.unique(dims).tolist():
                own = v.filter(pa.array(dims == dim))
                ids = batch.column("id").filter(pa.array(dims == dim))
                flat = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), dim)
                x = np.clip(np.floor(scale * flat), -LARGEST, LARGEST).astype(np.int64) + shift
                step = max(1, PACKED // (8 * dim))
                for at in range(0, len(x), step):
                    held.setdefault(dim, []).append((ids.slice(at, step), x[at : at + step]))
                    if sum(len(p[1]) for p in held[dim]) >= step:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    return shared.save(rows.mapInArrow(run, "dim int, n long, ids array<long>, x binary"), "packed")


@dataclass
class Centre:
    """Means as whole parts and remainders: sum = n * whole + rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums over dimensions of (n * x - sum)**2, exactly."""
        away = x - self.whole
        most = self.n * (int(np.abs(away).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 2**63:
            return ((self.n * away - self.rest) ** 2).sum(1)
        exact = (self.n * away.astype(object) - self.rest.astype(object)) ** 2
        return np.array([min(int(s), 2**63 - 1) for s in exact.sum(1)], np.int64)


def matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column("x"):
            yield np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dim)


def centre(own: DataFrame, dim: int, n: int) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for x in matrices(batches, dim):
            small = int(np.abs(x).max(initial=0)) * len(x) < 2**62
            total = [a + int(b) for a, b in zip(total, x.sum(0) if small else x.astype(object).sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    rows = own.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()  # a number for each dimension
    sums = {r["i"]: int(r["s"]) for r in rows}
    parts = [divmod(sums[i], n) for i in range(dim)]
    return Centre(n, np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64))


def summed(own: DataFrame, mean: Centre, make: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
    """The sum over all packed rows of the matrix that ``make`` has for their centred vectors."""
    dim = len(mean.whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for x in matrices(batches, dim):
            total += make(mean.of(x))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(height), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = own.select("x").mapInArrow(run, "i int, row array<double>").groupBy("i").agg(F.array(*(F.sum(F.col("row")[j]) for j in range(width))).alias("row")).collect()
    out = np.zeros((height, width))
    for r in rows:
        out[r["i"]] = r["row"]
    return out


class Products:
    """The two products with the centred vectors X of one table, and what reorthogonalising needs beside them."""

    def __init__(self, own: DataFrame, mean: Centre) -> None:
        self.own, self.mean = own, mean

    def forward(self, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """U'P and P'P, where P = X v and U = X w."""

        def make(c: np.ndarray) -> np.ndarray:
            p = c @ v
            return np.vstack([(c @ w).T @ p, p.T @ p])

        k, b = w.shape[1], v.shape[1]
        found = summed(self.own, self.mean, make, k + b, b)
        return found[:k], found[k:]

    def backward(self, w: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """X'Q, U'Q and Q'Q, where Q = X new and U = X w."""

        def make(c: np.ndarray) -> np.ndarray:
            q = c @ new
            return np.vstack([c.T @ q, (c @ w).T @ q, q.T @ q])

        d, k, b = len(w), w.shape[1], new.shape[1]
        found = summed(self.own, self.mean, make, d + k + b, b)
        return found[:d], found[d : d + k], found[d + k :]


def outside(z: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The part of the columns of z that is orthogonal to those of v, taken out twice."""
    for _ in range(2):
        z = z - v @ (v.T @ z)
    return z


def bidiagonalise(times: Products, dim: int, wanted: int, block: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """V, the block bidiagonal B = U'XV, and W with U = X W."""
    rng = np.random.default_rng(seed)
    v, w, z_all = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))
    b = np.zeros((0, 0))
    new = np.linalg.qr(rng.standard_normal((dim, min(block, dim))))[0]
    last, top = 0, 0.0  # how many left vectors the block before this one has; the largest square of a length seen
    while True:
        coupling, gram = times.forward(w, new)
        top = max(top, float(np.linalg.eigvalsh(gram)[-1]))
        values, turns = np.linalg.eigh(gram - coupling.T @ coupling)
        keep = values > 0.1 * TOLERANCE * top
        k, m, r = w.shape[1], v.shape[1], int(keep.sum())
        v = np.hstack([v, new])
        grown = np.zeros((k + r, v.shape[1]))
        grown[:k, :m] = b
        left = np.zeros((dim, 0))
        if r:
            root = np.sqrt(values[keep])
            first = root[:, None] * turns[:, keep].T
            fresh = (new - w @ coupling) @ turns[:, keep] / root
            z, along, within = times.backward(w, fresh)  # once more, now that they are nearly orthonormal
            second = np.linalg.cholesky(within - along.T @ along).T
            fresh, z = (np.linalg.solve(second.T, a.T).T for a in (fresh - w @ along, z - z_all @ along))
            grown[k:, m:] = second @ first
            coupling = coupling + along @ first
            w, z_all = np.hstack([w, fresh]), np.hstack([z_all, z])
            left = outside(z, v)
        grown[k - last : k, m:] = coupling[k - last :]  # further up it is nothing but rounding
        b, last = grown, r
        if v.shape[1] >= dim or top == 0.0:
            return v, b, w
        p, s, _ = np.linalg.svd(b, full_matrices=False)
        if len(s) >= wanted:
            residuals = np.sqrt(((left @ p[k:, :wanted]) ** 2).sum(0)) if r else np.zeros(wanted)
            alike = (s[: len(s) - block + 1] - s[block - 1 :])[:wanted] <= 1e-8 * s[0]  # a whole block of one deviation
            if (residuals <= 1e-13 * s[0]).all() and not alike.any():
                return v, b, w
        q, lengths, _ = np.linalg.svd(left, full_matrices=False) if r else (left, np.zeros(0), None)
        new = outside(q[:, lengths > 1e-13 * np.sqrt(top)], v)
        room = min(block, dim - v.shape[1])
        new = new[:, :room]
        if new.shape[1] < room:
            new = np.hstack([new, outside(rng.standard_normal((dim, room - new.shape[1])), np.hstack([v, new]))])
        new = outside(np.linalg.qr(new)[0], v)
        new = np.linalg.qr(new)[0]


@dataclass
class Whitening:
    """The fit for vectors of one dimension: components as columns, their variances and shares of the whole variance."""

    mean: Centre
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def of(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.components / np.sqrt(self.variances)


def fit(own: DataFrame, dim: int, n: int, components: int = COMPONENTS, block: int = BLOCK) -> Whitening:
    """``own``: packed vectors of one dimension."""
    mean = centre(own, dim, n)
    v, b, _ = bidiagonalise(Products(own, mean), dim, min(components, dim), block)
    _, s, q = np.linalg.svd(b, full_matrices=False) if b.size else (None, np.zeros(0), np.zeros((0, v.shape[1])))
    variances = s**2 / n
    keep = (variances > TOLERANCE * variances.max(initial=0.0))[:components]
    trace = summed(own, mean, lambda c: np.array([[(c * c).sum()]]), 1, 1)[0, 0] / n
    found = Whitening(mean, (v @ q.T)[:, : len(keep)][:, keep], variances[: len(keep)][keep], np.zeros(0))
    found.explained = found.variances / trace if trace else found.variances
    k = len(found.variances)
    if k:
        plain = Whitening(found.mean, found.components, found.variances, found.explained)

        def products(c: np.ndarray) -> np.ndarray:
            y = plain.of(c)
            return np.vstack([y.T @ y, y.sum(0)])

        total = summed(own, mean, products, k + 1, k) / n
        found.identity_error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    return found


def transform(own: DataFrame, fitted: Whitening) -> DataFrame:
    """A row for each packed vector and component."""
    dim, k, n = len(fitted.mean.whole), len(fitted.variances), fitted.mean.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in zip(batch.column("ids"), matrices(iter([batch]), dim)):
                for at in range(0, len(x), 2048):
                    part = x[at : at + 2048]
                    many = len(part)
                    each = lambda a: pa.array(np.tile(a, many))
                    whose = ids.values.slice(at, many).take(pa.array(np.repeat(np.arange(many), k)))
                    yield pa.RecordBatch.from_arrays(
                        [whose, each(np.arange(1, k + 1, dtype=np.int32)), each(np.full(k, n, np.int64)), pa.array(np.repeat(fitted.mean.deviations(part), k)),
                         pa.array(fitted.of(fitted.mean.of(part)).ravel()), each(fitted.explained), each(np.full(k, fitted.identity_error))],
                        names=[c.split()[0] for c in OUT.split(", ")],
                    )

    return own.select("ids", "x").mapInArrow(run, OUT)


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT, block: int = BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable vector and component."""
    rows = packed(table, id_col, vector, scale, shift)
    found = None
    for r in rows.groupBy("dim").agg(F.sum("n").alias("n")).orderBy("dim").collect():  # dimensions, not vectors
        own = rows.where(F.col("dim") == r["dim"])
        one = transform(own, fit(own, r["dim"], r["n"], components, block))
        found = one if found is None else found.unionByName(one)
    return table.sparkSession.createDataFrame([], OUT) if found is None else found


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(shared.read(spark, sf_dir, "embeddings"))
