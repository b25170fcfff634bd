import math
import random

import numpy as np
from pyspark.sql import functions as F

from tillage.llm import topk as T


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in ok if i % every == 0}:
        pairs = [(-min(T.HIGH, max(T.LOW, sum(a * b for a, b in zip(v, w)))), j) for i, v in ok if i == q for j, w in ok if j != q and len(w) == len(v)]
        out |= {(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(pairs)[:k])}
    return out


def test_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.1, 1, 3])).tolist()) for i in range(500)]
    rows += [(500 + i, rows[7][1]) for i in range(120)]  # one very common vector
    rows += [(1000, None), (1010, [1.0, None] * 6), (1020, [float("nan")] * 12), (1030, [float("inf")] * 12), (None, [1.0] * 12)]
    rows += [(1040, [0.5, 1.5]), (1050, [2.0, -1.0]), (1060, []), (1070, []), (1080, [0.0] * 12)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string").repartition(4)
    for shard_rows, seed_rows in ((100, 10), (10000, 64)):
        got = T.top_k(df, F.col("id") % 10 == 0, shard_rows=shard_rows, seed_rows=seed_rows)
        assert {tuple(r) for r in got.collect()} == brute(rows, 5, 10)
    assert T.top_k(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(0, [1e15, -3.0]), (10, [2e15, 7.0]), (3, [1e15, 1.0]), (4, [-1e15, 1.0]), (5, [1e15 + 0.125, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in T.top_k(df, F.col("id") % 10 == 0).collect()} == brute(rows, 5, 10)


def test_pruning_skips_short_rows():
    rng = np.random.default_rng(0)
    rows = np.floor(rng.normal(size=(4096, 8)) * np.repeat([1000, 10], 2048)[:, None])
    shard = T.Shard(np.arange(4096), rows, np.eye(8), 4)
    seen = []
    inner = T.exact
    try:
        T.exact = lambda q, r: seen.append(q.shape[0] * r.shape[0]) or inner(q, r)
        T.search(shard, np.array([0]), rows[:1], np.array([-np.inf]), np.eye(8), 4, 5)
    finally:
        T.exact = inner
    assert sum(seen) <= 2048


def test_vectors_of_one_length_are_dealt_evenly(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.permutation([3.0, 1.0, 1.0, 0.0, -1.0, 2.0]).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in T.top_k(df, F.col("id") % 10 == 0, shard_rows=30, seed_rows=5).collect()} == brute(rows, 5, 10)


def test_shards_keep_the_order_of_lengths_and_queries_reach_all_they_need():
    rng = np.random.default_rng(6)
    length = np.concatenate([rng.integers(0, 9, 400).astype(float), np.full(300, 5.0)])
    cuts = np.sort(np.quantile(length, np.arange(1, 12) / 12))
    assert len(set(cuts)) < len(cuts)
    shard = T.shards_of(length, rng.integers(-(2**60), 2**60, len(length)), cuts)
    tops = np.concatenate([[length.max()], cuts[::-1]])
    assert (length <= tops[shard]).all() and shard.min() == 0 and shard.max() <= 11
    assert np.bincount(shard, minlength=12).max() < 200
    asked, floor = rng.integers(0, 5, 50).astype(float), np.concatenate([[-np.inf], rng.integers(-3, 40, 49)])
    for q, f, last in zip(asked, floor, T.last_shards(asked, floor, tops)):
        reached = np.flatnonzero(q * tops >= f)
        assert last == (reached.max() if len(reached) else -1)
