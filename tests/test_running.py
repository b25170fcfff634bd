"""Running totals by blocks against plain Python, and chunks of exploded table rows against chunks of whole tables."""

import random

import pytest
from pyspark.sql import functions as F

from tillage.operators import chunking as C
from tillage.operators import running as N
from tillage.operators import table_rows as T


@pytest.mark.parametrize("bits, levels", [(12, 2), (2, 1), (1, 3), (3, 0)])
def test_running_totals_are_those_of_a_loop(spark, bits, levels):
    draw = random.Random(bits)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.randrange(-40, 40), i, draw.choice([None, 1, 2, 5]), draw.choice([None, None, "x", "y"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at int, tie int, v int, word string")
    got = N.running(df, ["k"], "at", {"total": F.col("v"), "n": F.lit(1)}, {"word_before": F.col("word")}, ("tie",), bits, levels)
    assert got.columns == ["k", "at", "tie", "v", "word", "total", "n", "word_before"]
    want, state = [], {}
    for k, at, tie, v, word in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        total, n, last = state.get(k, (0, 0, None))
        want.append((k, at, tie, v, word, total, n, last))
        state[k] = (total + (v or 0), n + 1, word or last)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == sorted(want, key=lambda r: r[2])


def test_running_totals_of_odd_rows(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 5, 2), ("a", -7, 3)], "k string, at long, total int")
    got = N.running(df, ["k"], "at", {"total": F.col("total")}, order=("total",))  # replaces a column of its name
    assert got.columns == ["k", "at", "total"] and sorted((r.at is None, r.at or 0, r.total) for r in got.collect()) == [(False, -7, 1), (False, 5, 4), (False, 5, 6), (True, 0, 0)]
    assert N.number(df.limit(0), ["k"], "at", "n").collect() == []


def test_a_group_of_most_rows_is_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), "id")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = N.number(df, ["k"], "id", "n", bits=8)
        tasks = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 9_000
    assert got.where("n <> id").count() == 0


SCHEMA = "product_number string, position int, table_id string, rows array<array<string>>, markdown string, column_count int, row_count int, page int"


def both(spark, made, folder, most=20):
    df = spark.createDataFrame(made, SCHEMA)
    columns = ["chunk_id", "text", "chunk_type", "sequence_order", "product_number", "parent_section", "table_id", "row_count", "column_count", "headers", "page_number"]
    whole, rows = C.chunk_tables(df, most), T.chunk_table_rows(df.drop("rows"), T.explode_tables(df), str(folder), most)
    assert rows.columns == columns
    return [sorted((tuple(map(str, r)) for r in x.select(*columns).collect())) for x in (whole, rows)]


def test_chunks_of_rows_are_those_of_whole_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BITS", 2)  # blocks of four rows
    draw = random.Random(5)
    words = ["zz", "Label", "name", "resistance", "warning", "group", "b", "herbicide", "first", "aid", "", "  ", " ", "tank", "mix", "dock", "5 L/ha", "qqqqqqqqqqqq", "long " * 12]
    made = []
    for p in range(12):
        for at in range(5):
            n = draw.choice([0, 1, 2, 3, 4, 9, 30])
            width = draw.choice([1, 2, 3, 4])
            rows = [[draw.choice(words if draw.random() < 0.3 else ["zz", "", " ", "b"]) for _ in range(width)] for _ in range(n)]
            made.append((f"P{p}", at, f"t{at}", rows if n else None, draw.choice([None, None, "", "some markdown", "storage of " + "words " * 30]), draw.choice([None, width]), n, draw.choice([None, 3])))
    whole, rows = both(spark, made, tmp_path / "s")
    assert whole == rows and len(whole) > 60


def test_patterns_that_cross_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BITS", 2)
    fill = [["zzzzzzzz"]] * 3
    made = [
        ("A", 0, "t", [*fill, ["label"], [" "], [""], ["name zzzzzzzzzz"]], None, 1, 7, None), ("B", 0, "t", [*fill, ["group"], ["\t"], ["k"], [""], ["herbicide"], *fill], None, 1, 11, None),
        ("C", 0, "t", [["label" + "z" * 50], ["name" * 9]], None, 1, 2, None), ("D", 0, "t", [["x " * 30 + "first"], ["aid" + " y" * 30]], None, 1, 2, None), ("E", 0, "t", [["label"], ["\x1c"], ["name zzzzzzzzzzzzzzzz"]], None, 1, 3, None),
    ]
    whole, rows = both(spark, made, tmp_path / "s")
    assert whole == rows
    assert {r[4]: r[5] for r in rows} == {"A": "product_identity", "B": "resistance_warning", "C": "None", "D": "safety", "E": "None"}


def test_odd_tables_and_rows(spark, tmp_path):
    tables = spark.createDataFrame([("P", 0, "t", None, 1, 2, None, "x"), ("Q", 0, "t", None, None, None, None, "x"), (None, 0, "t", "markdown of no product at all", 1, 0, None, "x")], "product_number string, position int, table_id string, markdown string, column_count int, row_count int, page int, line string")
    rows = spark.createDataFrame([("P", 0, 1, ["b" * 30], 1), ("P", 0, 0, None, 1), ("P", None, 0, ["c"], 1), (None, 0, 0, ["d"], 1), ("R", 0, 0, ["e" * 30], 1)], "product_number string, position int, row int, cells array<string>, block int")
    assert [(r.chunk_id[:4], r.text) for r in T.chunk_table_rows(tables, rows, str(tmp_path / "a")).collect() if r.product_number] == [("P-t-", "\n" + "b" * 30)]
    assert T.chunk_table_rows(tables.limit(0), rows.limit(0), str(tmp_path / "b")).collect() == []


def test_columns_of_the_order_are_shuffled_once(spark):
    rows = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("at"), F.array(F.col("id").cast("string")).alias("cells"))
    numbered = N.number(rows, ["k"], "at", "n", ("cells",))
    dealt = next(line for line in numbered._jdf.queryExecution().optimizedPlan().toString().splitlines() if "false AS _run_start" in line)
    assert dealt.count("cells#") == 1
    assert sorted((r.at, r.n, r.cells) for r in numbered.collect()) == [(i, i, [str(i)]) for i in range(100)]
