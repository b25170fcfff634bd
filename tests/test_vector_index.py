"""The stored vector index against the scan."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.operators import retrieval as R
from tillage.operators import vector_index as V


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    rows = centres[rng.integers(40, size=4000)] + 0.5 * rng.standard_normal((4000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "chunk_id long, embedding array<double>").cache()
    return df, rows, V.build(df, str(tmp_path_factory.mktemp("index") / "i"), cells=50)


def ids(df):
    return [(r[0], round(r["cosine"], 9)) for r in df.orderBy(F.desc("cosine"), df.columns[0]).collect()]


def brute(rows, q, k):
    found = rows @ q / np.sqrt((rows * rows).sum(1) * (q @ q))
    return [(int(i), round(float(found[i]), 9)) for i in np.lexsort((np.arange(len(rows)), -found))[:k]]


def test_recall_and_pruning(clustered):
    _, rows, index = clustered
    rng = np.random.default_rng(6)
    hits = 0
    for _ in range(12):
        q = rows[rng.integers(len(rows))] + 0.3 * rng.standard_normal(32)
        hits += len(set(ids(V.search(index, q.tolist(), 10, probes=8))) & set(brute(rows, q, 10)))
    assert hits >= 0.95 * 120
    plan = V._in(index, np.array([1, 2, 3]))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[cell#\d+ IN \(1,2,3\)\]", plan)


def test_exact_search_equals_the_scan(clustered, spark):
    df, rows, index = clustered
    for at in (0, 17, 2999):
        q = rows[at].tolist()
        assert ids(V.search(index, q, 7, probes=1, candidates=1, exact=True)) == brute(rows, rows[at], 7)
        scan = R.top_k(df, F.lit(q), 7).select("chunk_id", "cosine")
        assert ids(scan) == ids(V.search(V.open_index(spark, index.path), q, 7, exact=True))


def test_every_usable_row_is_indexed_once(clustered, spark, tmp_path):
    df, rows, _ = clustered
    odd = spark.createDataFrame([(9001, None), (9002, [0.0] * 32), (9003, [1.0] * 31), (9004, [float("nan")] * 32), (9005, [None] * 32)], df.schema)
    copies = spark.range(3000).select((F.col("id") + 10000).alias("chunk_id"), F.lit([1.0] * 32).alias("embedding"))  # a third of all rows
    index = V.build(df.unionByName(odd).unionByName(copies), str(tmp_path / "i"), sample_rows=1000)
    stored = spark.read.parquet(f"{index.path}/rows")
    assert stored.count() == 7000 and stored.select("id").distinct().count() == 7000 and index.rows.sum() == 7000
    assert [i for i, _ in ids(V.search(index, [1.0] * 32, 5, exact=True))] == [10000, 10001, 10002, 10003, 10004]
    assert V.search(index, [1.0] * 31).collect() == [] and V.search(index, [0.0] * 32).collect() == []


def test_small_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 2.0])], "chunk_id string, embedding array<double>")
    index = V.build(df, str(tmp_path / "i"))
    assert ids(V.search(index, [1.0, 0.1], 2)) == ids(R.top_k(df, F.lit([1.0, 0.1]), 2).select("chunk_id", "cosine"))
    with pytest.raises(ValueError):
        V.build(df.limit(0), str(tmp_path / "none"))
