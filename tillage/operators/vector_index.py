"""A stored vector index: an inverted file of k-means cells whose residuals are product-quantized.

``build`` fits cells and codebooks on a bounded sample and writes every usable row, partitioned by its nearest cell: id,
vector, a code for each subspace, and how far the coded vector is from the row's.  ``search`` ranks the cells on the driver
(their number is a parameter), reads the codes of the nearest ones only, and scores the best rows again by exact cosine.  With ``exact`` it
goes on to all cells that can hold a better row: a row's cosine is at most that of its code plus the code's error, a
cell's at most that of its centre plus its radius.  The result then equals the scan's.

Vectors are compared by cosine, so unit vectors are indexed.  A vector that is null, all zero, of another length or with
null or non-finite entries has no cosine and is left out, as the scan leaves it out.  Ties go to the smaller id.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.operators.retrieval import cosine, score

#: Rows that cells and codebooks are fitted on at most, chosen by a hash of their ids.
SAMPLE_ROWS = 50_000
#: Sample rows for a cell at least.
ROWS_A_CELL = 30
SUBSPACES, CODES, ROUNDS = 8, 64, 12
#: Rounding that bounds allow for.
SLACK = 1e-6


def usable(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector has a cosine."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fits = (F.size(vector) > 0) if dim is None else F.size(vector) == dim
    return F.coalesce(vector.isNotNull() & fits & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1)[None] - 2 * rows @ centres.T, axis=1)


def k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of at most k clusters of a sample."""
    rows = np.unique(rows, axis=0)
    if len(rows) <= k:
        return rows
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        own = nearest(rows, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], rows[rng.integers(len(rows), size=k)])
    return centres


@dataclass
class Fitted:
    """Centres (cell x dimension) and, for each subspace, its columns and codebook."""

    centres: np.ndarray
    columns: list[np.ndarray]
    books: list[np.ndarray]

    def codes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code in each subspace, error of the coded vector and distance from the centre of each unit vector."""
        cells = nearest(rows, self.centres)
        rest = rows - self.centres[cells]
        found, left = [], np.zeros(len(rows))
        for at, book in zip(self.columns, self.books):
            own = nearest(rest[:, at], book)
            found.append(own)
            left += ((rest[:, at] - book[own]) ** 2).sum(1)
        return cells, np.array(found), np.sqrt(left), np.sqrt((rest * rest).sum(1))


def fit(sample: np.ndarray, cells: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 11) -> Fitted:
    rng = np.random.default_rng(seed)
    rows = unit(sample)
    centres = k_means(rows, cells, rng)
    rest = rows - centres[nearest(rows, centres)]
    columns = [c for c in np.array_split(np.arange(rows.shape[1]), min(subspaces, rows.shape[1])) if len(c)]
    return Fitted(centres, columns, [k_means(rest[:, c], codes, rng) for c in columns])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass
class Index:
    """A stored index; ``radius`` and ``rows`` of each cell."""

    spark: SparkSession
    path: str
    fitted: Fitted
    radius: np.ndarray
    rows: np.ndarray


def build(vectors: DataFrame, path: str, id_col: str = "chunk_id", vector: str = "embedding", cells: int | None = None, sample_rows: int = SAMPLE_ROWS, subspaces: int = SUBSPACES, codes: int = CODES) -> Index:
    """Write an index of all usable rows to ``path``.

    ``cells``: by default the square root of the number of rows, and no more than the sample can place.  The vectors' length is
    the most frequent one.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    table = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    lengths = table.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        raise ValueError("no vector has a cosine")
    dim, n = lengths
    table = table.where(F.size("vector") == dim)
    share = min(1.0, 1.5 * sample_rows / n)
    some = table.where(F.xxhash64("id") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    sample = np.array([r["vector"] for r in some.select("vector").collect()], float)  # at most sample_rows
    cells = cells or max(1, min(round(n**0.5), len(sample) // ROWS_A_CELL))
    fitted = fit(sample, cells, subspaces, codes)
    coded = [f"c{s}" for s in range(len(fitted.books))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, found, error, distance = fitted.codes(unit(_matrix(batch.column("vector"))))
                arrays = [*batch.columns, *(pa.array(c.astype(np.int16)) for c in found), pa.array(error), pa.array(distance), pa.array(cell.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "vector", *coded, "error", "distance", "cell"])

    rows = table.mapInArrow(run, f"id {kind}, vector array<double>, {', '.join(f'{c} short' for c in coded)}, error double, distance double, cell int")
    # Small cells share a task, a cell with very many rows is split over several.
    rows.hint("rebalance", "cell").sortWithinPartitions("cell", "id").write.partitionBy("cell").option("compression", "zstd").parquet(f"{path}/rows")
    sizes = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n"))
    facts = {r["cell"]: r for r in sizes.collect()}  # one for each cell
    spark.createDataFrame([(i, c.tolist(), facts[i]["radius"] if i in facts else 0.0, facts[i]["n"] if i in facts else 0) for i, c in enumerate(fitted.centres)], "cell int, centre array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/cells")
    books = [(s, k, v.tolist(), at.tolist()) for s, (at, book) in enumerate(zip(fitted.columns, fitted.books)) for k, v in enumerate(book)]
    spark.createDataFrame(books, "subspace int, code int, value array<double>, columns array<int>").coalesce(1).write.parquet(f"{path}/books")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    books: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/books").orderBy("subspace", "code").collect():
        books.setdefault(r["subspace"], []).append(r)
    fitted = Fitted(np.array([r["centre"] for r in cells]), [np.array(b[0]["columns"]) for b in books.values()], [np.array([r["value"] for r in b]) for b in books.values()])
    return Index(spark, path, fitted, np.array([r["radius"] for r in cells]), np.array([r["n"] for r in cells]))


def coded_score(index: Index, q: np.ndarray) -> Column:
    """The cosine that a row's code stands for, as an expression over its cell and codes."""
    table = lambda values: F.lit([float(x) for x in values])
    parts = [F.get(table(book @ q[at]), F.col(f"c{s}").cast("int")) for s, (at, book) in enumerate(zip(index.fitted.columns, index.fitted.books))]
    return functools.reduce(operator.add, parts, F.get(table(index.fitted.centres @ q), F.col("cell")))


def _in(index: Index, cells: np.ndarray) -> DataFrame:
    return index.spark.read.parquet(f"{index.path}/rows").where(F.col("cell").isin([int(c) for c in cells]))


def search(index: Index, vector: list[float], k: int = 10, probes: int = 16, candidates: int = 20, exact: bool = False) -> DataFrame:
    """id, cosine, score of the k rows most similar to ``vector``, among the ``probes`` nearest cells or, with ``exact``, all.

    ``candidates``: so many times k rows are scored exactly.
    """
    raw = np.array(vector, float)
    if len(raw) != index.fitted.centres.shape[1] or not np.isfinite(raw).all() or not raw.any():
        return index.spark.read.parquet(f"{index.path}/rows").limit(0).select("id", F.lit(None).cast("double").alias("cosine"), F.lit(None).cast("double").alias("score"))
    q = raw / np.sqrt(raw @ raw)
    by_centre = index.fitted.centres @ q
    order = np.lexsort((np.arange(len(by_centre)), -by_centre))
    order = order[index.rows[order] > 0]
    true = cosine(F.col("vector"), F.lit([float(x) for x in raw]))

    def best(rows: DataFrame) -> DataFrame:
        return rows.select("id", true.alias("cosine")).orderBy(F.desc("cosine"), "id").limit(k)

    near = _in(index, order[:probes])
    few = near.select("cell", "id", coded_score(index, q).alias("coded")).orderBy(F.desc("coded"), "id").limit(k * candidates).collect()  # k * candidates rows, without vectors
    found = best(_in(index, np.unique([r["cell"] for r in few])).where(F.col("id").isin([r["id"] for r in few])))
    if exact:
        floors = [r["cosine"] for r in found.collect()]  # k rows
        floor = min(floors) if len(floors) == k else -2.0
        reach = order[by_centre[order] + index.radius[order] + SLACK >= floor]
        found = best(_in(index, reach).where(coded_score(index, q) + F.col("error") + SLACK >= floor))
    return found.withColumn("score", score(F.col("cosine")))
