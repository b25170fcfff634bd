"""The index of substrings against the scan."""

import random

import pytest
from pyspark.sql import functions as F

from tillage.functions.text import has
from tillage.operators import retrieval as R
from tillage.operators import text_index as X
from tillage.operators.graph import Graph
from tillage.sources.store import KeyViolation

LETTERS = "abcAB é😀İ%_\\\n"


def texts(seed, n, start=0):
    rng = random.Random(seed)
    return [(start + i, "".join(rng.choice(LETTERS) for _ in range(rng.choice((0, 2, 3, 30, 200))))) for i in range(n)]


def found(index, term):
    return sorted(r.id for r in X.search(index, term).collect())


def scanned(rows, term):
    return sorted(r.id for r in rows.where(has(F.col("text"), term)).collect())


@pytest.fixture(scope="module")
def pieces(spark):
    before = X.PIECE
    X.PIECE = 50  # most texts are of several pieces
    yield
    X.PIECE = before


@pytest.fixture(scope="module")
def indexed(spark, pieces, tmp_path_factory):
    rows = spark.createDataFrame([*texts(1, 300), (1000, None), (1001, "x" * 50 + "yz" + "w" * 49 + "v")], "id long, text string").cache()
    return rows, X.build(rows, str(tmp_path_factory.mktemp("index") / "i"), "id", folders=4, salts=2)


def test_index_equals_scan(indexed):
    rows, index = indexed
    rng = random.Random(2)
    own = [t for _, t in texts(1, 300) if len(t) >= 30]
    terms = ["", "ab", "xyz", "zww", "nowhere", "İAB", "é😀a"]
    for _ in range(5):
        text = rng.choice(own)
        at = rng.randrange(len(text) - 3)
        terms.append(text[at : at + rng.choice((3, 4, 6, 20))].swapcase())
    for term in terms:
        assert found(index, term) == scanned(rows, term), term


def test_search_reads_the_folders_of_a_term_and_the_buckets_of_its_candidates(indexed):
    _, index = indexed
    files = lambda df: {f.split("folder=")[1].split("/")[0] for f in df.inputFiles()}
    assert len(files(index.postings())) == 4
    plan = X.candidates(index, "xyz")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    assert "EqualTo(gram,xyz)" in plan or "In(gram, [xyz])" in plan
    assert len(X.search(index, "xyz").inputFiles()) == 1  # one candidate, one bucket
    assert X.candidates(index, "ab") is None


def test_batches_replace_texts_and_stale_lists_do_no_harm(spark, pieces, tmp_path):
    first = spark.createDataFrame([(1, "wild oats"), (2, "ryegrass")], "id long, text string")
    index = X.build(first, str(tmp_path / "i"), "id", folders=4, salts=2)
    X.add(index, spark.createDataFrame([(1, "capeweed"), (3, "Wild  oats, wild oats")], "id long, text string"), "id")
    assert (found(index, "wild oats"), found(index, "CAPE"), found(index, "grass")) == ([3], [1], [2])
    with pytest.raises(KeyViolation):
        X.add(index, spark.createDataFrame([(4, "clover"), (4, "dock")], "id long, text string"), "id")
    assert found(index, "clover") == []  # its lists are there, the text isn't
    X.add(index, spark.createDataFrame([(4, "clover")], "id long, text string"), "id")
    assert found(index, "clover") == [4]
    with pytest.raises(FileExistsError):
        X.build(first, str(tmp_path / "i"), "id")


def test_empty_table_and_odd_columns(spark, tmp_path):
    rows = spark.createDataFrame([], "gram string, folder string, text string")
    index = X.build(rows, str(tmp_path / "i"), "gram", folders=2, salts=1)
    assert found(index, "abc") == found(index, "a") == []
    X.add(index, spark.createDataFrame([("k", "f", "abcd")], rows.schema), "gram")
    assert found(index, "BCD") == ["k"]


def test_chunks_by_index(spark, tmp_path):
    chunk = spark.createDataFrame([("c1", "wild oats here", "text", "1"), ("c2", "nothing", "text", "1")], "chunk_id string, text string, chunk_type string, product_number string")
    mentions = spark.createDataFrame([("c2", "wild oats", "Weed")], "chunk_id string, entity string, entity_type string")
    g = Graph(chunk=chunk, mentions=mentions, document=spark.createDataFrame([("1", "s")], "product_number string, source string"), herbicide=spark.createDataFrame([("1", "p")], "product_number string, product_name string"))
    index = X.build(chunk, str(tmp_path / "i"), "chunk_id", folders=2, salts=1)
    assert R.chunks_for(g, "Wild O", "Weed", index=index).collect() == R.chunks_for(g, "Wild O", "Weed").collect()
