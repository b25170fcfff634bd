"""Bounded paths against brute force, contexts with texts, and models made once a task."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tillage.operators import retrieval as R
from tillage.operators.graph import Graph


def brute(edges, start, steps):
    """Ends of all ways that use no edge twice."""
    best = {}

    def walk(node, used, depth):
        for e in edges:
            if e[0] == node and e not in used and depth < steps:
                best[e[1]] = min(best.get(e[1], 99), depth + 1)
                walk(e[1], used | {e}, depth + 1)

    walk(start, frozenset(), 0)
    return best


@pytest.mark.parametrize("edges", [
    [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")],  # a chain
    [("a", "b"), ("c", "d")],  # a broken one
    [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("c", "e")],  # branches that meet
    [("a", "b"), ("b", "c"), ("c", "a"), ("b", "b")],  # a cycle and a loop
    [(random.Random(i).choice("abcdef"), random.Random(i + 99).choice("abcdef")) for i in range(11)],
])
def test_bounded_paths(spark, edges):
    df = spark.createDataFrame([*edges, edges[0], ("a", None), (None, "b")], "src string, dst string")
    starts = spark.createDataFrame([(x,) for x in "abcz"], "start string")
    for steps in (1, 2, 4):
        got = {(r.start, r.node): r.depth for r in R.within(df, starts, steps).collect()}
        assert got == {(s, n): d for s in "abcz" for n, d in brute(set(edges), s, steps).items()}
    back = {(r.start, r.node): r.depth for r in R.within(df, starts, 2, "dst", "src").collect()}
    assert back == {(s, n): d for s in "abcz" for n, d in brute({(b, a) for a, b in edges}, s, 2).items()}
    assert R.within(df, starts, 0).collect() == []


def test_context_with_texts_over_any_edges(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}", "table", f"s{i % 2}", "P", i) for i in range(5)], "chunk_id string, text string, chunk_type string, parent_section string, product_number string, sequence_order int")
    edges = spark.createDataFrame([("c0", "c1"), ("c1", "c2"), ("c1", "c3"), ("c3", "c4")], "src string, dst string")
    got = {r.chunk_id: r for r in R.chunk_context(Graph(chunk=chunks, next=edges), 2).collect()}
    assert [tuple(x) for x in got["c3"].prev_chunks] == [("c0", "text 0"), ("c1", "text 1")] and [x.id for x in got["c3"].next_chunks] == ["c4"]
    assert [x.id for x in got["c1"].next_chunks] == ["c2", "c3", "c4"] and (got["c1"].section, got["c1"].product_number, got["c1"].text) == ("s1", "P", "text 1")
    assert got["c0"].prev_chunks == [] and len(got) == 5
    near = R.chunk_context(Graph(chunk=chunks.drop("parent_section"), next=edges), 1, chunks.where("chunk_id = 'c2'")).collect()
    assert [(r.chunk_id, r.section, [x.id for x in r.prev_chunks]) for r in near] == [("c2", None, ["c1"])]


def test_products_with_rates(spark):
    make = spark.createDataFrame
    controls = make([("P", f"w{i:02d}", "wheat", f"{i} L/ha", None, "control") for i in range(30)], "product_number string, weed string, crop string, rate_per_ha string, application_timing string, control_level string")
    g = Graph(
        chunk=make([("c", "P", "t"), ("d", "Q", "t")], "chunk_id string, product_number string, text string"), document=make([("P",), ("Q",)], "product_number string"), controls=controls,
        herbicide=make([("P", "one", "x"), ("Q", "two", "y")], "product_number string, product_name string, active_constituent string"), has_mode_of_action=make([("P", "A")], "product_number string, group string"),
    )
    got = {r.product_number: r for r in R.related_products(g, make([("c",), ("d",), ("c",)], "chunk_id string")).collect()}
    assert [tuple(c) for c in got["P"].controls] == [(f"w{i:02d}", "wheat", f"{i} L/ha", None, "control") for i in range(10)] and got["P"].moa_group == "A"
    assert got["Q"].controls == [] and got["Q"].moa_group is None


def test_a_model_is_made_once_a_task(spark):
    made = spark.sparkContext.accumulator(0)

    def model():
        made.add(1)
        return lambda texts: [[float(len(t))] for t in texts]

    df = spark.range(200).repartition(2).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert sorted(itertools.chain.from_iterable(r.embedding for r in R.embed_column(df, "t", model).collect())) == [float(i) for i in range(200)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made.value == 2


def test_context_in_order_equals_context_by_edges(spark):
    from tillage.operators import chunking as C
    from tillage.operators import retrieval as R
    from tillage.operators.graph import Graph

    rows = [(f"{p}-{i}", None if i == 2 else f"text {p} {i}", "text", 3 * i, p, "s") for p in ("a", "b") for i in range(6)] + [("c-0", "alone", "text", 0, "c", None), ("n-0", "t", "text", 0, None, None), ("n-1", "u", "text", 1, None, None)]
    chunk = spark.createDataFrame(rows, "chunk_id string, text string, chunk_type string, sequence_order int, product_number string, parent_section string")
    near = chunk.where("chunk_id IN ('a-0', 'b-3')").select("chunk_id")
    for window, some in ((2, None), (3, near), (1, near)):
        got, want = (sorted(map(repr, R.chunk_context(g, window, some).collect())) for g in (Graph(chunk=chunk), Graph(chunk=chunk, next=C.next_edges(chunk))))
        assert got == want and got
    plan = R.chunk_context(Graph(chunk=chunk))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
