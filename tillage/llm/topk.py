"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

Vectors are floored to whole numbers (``floor(scale * x)``).  The rows are cut into shards by descending length, so
lengths within a shard are close.  A task holds one shard and takes the queries in blocks as they stream by.  For a
block it goes through the shard in descending length and keeps each query's k best so far.  A query stops at the
first block of rows whose largest length cannot reach its k-th best (Cauchy-Schwarz).  In a block it does reach, the
inner products over the first ``head`` coordinates after an SVD rotation, plus the product of the lengths of the
remaining coordinates, bound every score; only pairs whose bound reaches the k-th best get an exact whole-number
score.  Before the shards are searched, each query's k-th best among the ``seed_rows`` longest rows is found, and the
shards start from there; a query travels only to those whose longest row can reach it.  The bounds are widened by more
than rounding can take, so the result is exact.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id.  Vectors are
compared with those of their own dimension only.  Equal scores go to smaller ids.  Rows that repeat an id are
candidates each; queries that repeat an id share one list.  Scores beyond 64 bits count as the largest 64-bit
numbers, and so may tie.  An empty
table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillage.llm import shared

SCALE = 256
K = 5
HEAD = 16
BLOCK = 1024
#: Vectors in a shard at most: a task's memory; queries travel once to each shard.
SHARD_ROWS = 1 << 17
#: Vectors that a shard should have before a table is cut into more shards than memory asks for, one for each core.
LEAST_ROWS = 1 << 13
SEED_ROWS = 2048
OUT = "query_id long, vec_id long, score long"
#: Whole numbers up to here are exact as doubles, whatever the order in which they are added.
EXACT = 2.0**52
LOW, HIGH = -(2**63), 2**63 - 1


def floored(vector: Column, scale: int = SCALE) -> Column:
    """As whole numbers; beyond 2**52 a double is one, and F.floor() would end at 64 bits."""

    def whole(x: Column) -> Column:
        y = scale * x.cast("double")
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows, floored."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rotation(vectors: DataFrame, dim: int, scale: int) -> np.ndarray:
    """Right singular vectors of all floored vectors of a dimension, from the sum of their outer products (dim x dim)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = np.floor(scale * _matrix(batch.column("v")))
            size = np.abs(m).max(initial=1.0)
            if size < 1e100:  # larger ones would overflow; the rotation only steers pruning
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = vectors.mapInArrow(run, "i int, row array<double>").groupBy("i").agg(F.array(*(F.sum(F.col("row")[j]) for j in range(dim))).alias("row")).collect()  # dim x dim numbers
    gram = np.zeros((dim, dim))
    for r in rows:
        gram[r["i"]] = r["row"]
    if not np.isfinite(gram).all():
        return np.eye(dim)
    return np.linalg.eigh(gram)[1][:, ::-1]


class Shard:
    """Rows in descending length, rotated, with residual lengths."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, turn: np.ndarray, head: int) -> None:
        length = np.sqrt((rows * rows).sum(1))
        order = np.lexsort((ids, -length))
        self.ids, self.rows, self.length = ids[order], rows[order], length[order]
        self.head, self.rest = split(self.rows, turn, head)


def split(rows: np.ndarray, turn: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray]:
    turned = rows @ turn
    return np.ascontiguousarray(turned[:, :head]), np.sqrt((turned[:, head:] ** 2).sum(1))


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole-number inner products of each query with each row."""
    if len(queries) == 0 or len(rows) == 0:
        return np.zeros((len(queries), len(rows)), np.int64)
    if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1]) < EXACT:
        return (queries @ rows.T).astype(np.int64)
    as_int = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    big = as_int(queries) @ as_int(rows).T
    return np.array([[min(HIGH, max(LOW, int(x))) for x in r] for r in big], np.int64).reshape(big.shape)


def search(shard: Shard, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, turn: np.ndarray, head: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of the shard for each query that reach ``floor`` (a score already found k times, or -inf)."""
    length = np.sqrt((queries * queries).sum(1))
    heads, rests = split(queries, turn, head)
    best = np.full((len(ids), k), LOW, np.int64)
    whose = np.full((len(ids), k), HIGH, np.int64)
    filled = np.zeros(len(ids), np.int64)
    bar = floor.astype(np.float64)
    for at in range(0, len(shard.ids), BLOCK):
        end = min(at + BLOCK, len(shard.ids))
        slack = 1e-9 * length * shard.length[at] + 1e-6
        live = np.flatnonzero(length * shard.length[at] + slack >= bar)
        if not len(live):
            break
        bound = heads[live] @ shard.head[at:end].T + np.outer(rests[live], shard.rest[at:end]) + slack[live, None]
        reach = (bound >= bar[live, None]) & (ids[live, None] != shard.ids[None, at:end])
        some = reach.any(1)
        live, reach = live[some], reach[some]
        if not len(live):
            continue
        columns = np.flatnonzero(reach.any(0))
        scores = exact(queries[live], shard.rows[at:end][columns])
        reach = reach[:, columns]
        for n, q in enumerate(live.tolist()):
            mine = reach[n]
            new_scores, new_ids = scores[n][mine], shard.ids[at:end][columns][mine]
            if len(new_scores) > k:  # all that can be among the k best, ties included
                cut = np.partition(new_scores, len(new_scores) - k)[len(new_scores) - k]
                top = new_scores >= cut
                new_scores, new_ids = new_scores[top], new_ids[top]
            new_scores = np.concatenate([best[q, : filled[q]], new_scores])
            new_ids = np.concatenate([whose[q, : filled[q]], new_ids])
            order = np.lexsort((new_ids, -new_scores))[:k]
            filled[q] = len(order)
            best[q, : filled[q]], whose[q, : filled[q]] = new_scores[order], new_ids[order]
            if filled[q] == k:
                bar[q] = max(bar[q], float(best[q, k - 1]))
    row, col = np.nonzero((np.arange(k)[None] < filled[:, None]) & (best >= floor[:, None]))
    return ids[row], whose[row, col], best[row, col]


def shards_of(length: np.ndarray, dealt: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The shard of each row, 0 for the longest; ``cuts``: in ascending order.  Where several cuts are of a row's very
    length, the number ``dealt`` chooses one of the shards between them."""
    least = len(cuts) - np.searchsorted(cuts, length, "right")
    most = len(cuts) - np.searchsorted(cuts, length, "left")
    return (least + dealt % (most - least + 1)).astype(np.int32)


def last_shards(length: np.ndarray, floor: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """The last shard that each query can find a row in (-1: none), by Cauchy-Schwarz; ``tops``: in descending order."""
    most = np.where(length > 0, (floor - 1e-6) / np.maximum(length, 1e-300) / (1 + 1e-9), np.where(floor > 1e-6, np.inf, -np.inf))
    return len(tops) - 1 - np.searchsorted(tops[::-1], most, "left")


def _one_dimension(vectors: DataFrame, dim: int, n: int, is_query: Column, k: int, scale: int, head: int, shard_rows: int, seed_rows: int) -> DataFrame:
    """``vectors``: id, v, length."""
    turn = rotation(vectors, dim, scale)
    head = min(head, dim)
    spark = vectors.sparkSession
    queries = vectors.where(is_query).select("id", "v")
    seed = vectors.orderBy(F.desc("length"), "id").limit(seed_rows).select("id", "v").toArrow()  # a parameter bounds it
    seed_ids, seed_m = seed.column(0).to_numpy(), np.floor(scale * _matrix(seed.column(1).combine_chunks())).reshape(len(seed), dim)
    seeds = spark.sparkContext.broadcast(Shard(seed_ids, seed_m, turn, head))

    shards = max(1, -(-n // shard_rows), min(-(-n // LEAST_ROWS), spark.sparkContext.defaultParallelism))
    quantiles = [i / shards for i in range(1, shards)]
    cuts = np.sort(np.array(vectors.approxQuantile("length", quantiles, min(0.0005, 0.1 / shards)) if shards > 1 else [], float))
    longest = vectors.agg(F.max("length")).first()[0]
    tops = np.concatenate([[longest], cuts[::-1]])  # the largest length in each shard

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m = batch.column(0).to_numpy(), np.floor(scale * _matrix(batch.column(1))).reshape(batch.num_rows, dim)
            found = search(seeds.value, ids, m, np.full(len(ids), -np.inf), turn, head, k)
            floors = pd.Series(found[2]).groupby(found[0]).agg(["min", "size"])
            floors = floors["min"].where(floors["size"] >= k).reindex(ids)
            floors = floors.astype(float).fillna(-np.inf).to_numpy()
            last = last_shards(np.sqrt((m * m).sum(1)), floors, tops)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floors), pa.array(last, pa.int32())], names=["id", "v", "floor", "last"])

    @F.pandas_udf("int")
    def shard_of(length: pd.Series, dealt: pd.Series) -> pd.Series:
        return pd.Series(shards_of(length.to_numpy(), dealt.to_numpy(), cuts))

    key = shard_of("length", F.xxhash64("id")) if shards > 1 else F.lit(0)
    rows = vectors.select(key.alias("shard"), F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("floor"))
    asked = queries.mapInArrow(seeded, "id long, v array<double>, floor double, last int")
    copies = asked.where("last >= 0").select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("shard"), F.lit(1).alias("kind"), "id", "v", "floor")
    dealt = rows.unionByName(copies).repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, shard, held = None, None, []
        for batch in batches:
            numbers, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.diff(numbers * 2 + kinds)) + 1
            for at, end in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)]):
                piece = batch.slice(at, end - at)
                ids = piece.column("id").to_numpy()
                m = np.floor(scale * _matrix(piece.column("v"))).reshape(len(ids), dim)
                if numbers[at] != present:
                    present, shard, held = numbers[at], None, []
                if kinds[at] == 0:
                    held.append((ids, m))
                    continue
                if not held:
                    continue
                if shard is None:
                    shard = Shard(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), turn, head)
                    held = [(shard.ids[:0], m[:0])]
                found = search(shard, ids, m, piece.column("floor").to_numpy(), turn, head, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, OUT)


def top_k(table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, head: int = HEAD, shard_rows: int = SHARD_ROWS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row for which ``is_query`` (over a column ``id``) holds."""
    vectors = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    length = F.sqrt(F.aggregate(floored(F.col("v"), scale), F.lit(0.0), lambda a, x: a + x * x))
    vectors = shared.save(vectors.select("id", "v", length.alias("length"), F.size("v").alias("dim")), "vectors")
    found = None
    for r in vectors.groupBy("dim").count().orderBy("dim").collect():  # dimensions, not vectors
        own = vectors.where(F.col("dim") == r["dim"]).drop("dim")
        one = _one_dimension(own, r["dim"], r["count"], is_query, k, scale, head, shard_rows, seed_rows)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(shared.read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
