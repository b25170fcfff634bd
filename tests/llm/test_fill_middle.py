"""The boundary set against plain lists, texts there and back, and the query against its SQL."""

import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillage.llm import fill_middle as M

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind, share", [("Runs", 1.0), ("Bitmap", 0.5), ("Array", 0.01)])
def test_each_container_selects(kind, share):
    rng = np.random.default_rng(2)
    low = np.arange(1000, 60000) if share == 1 else np.flatnonzero(rng.random(M.SPAN) < share)
    found = M.container(low)
    assert type(found).__name__ == kind
    assert [found.select(n) for n in range(0, len(low), 97)] == low[::97].tolist() and found.select(len(low) - 1) == low[-1]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é漢😀\n", max_size=60), st.integers(1, 4000))
def test_cuts_are_those_of_code_points(text, times):
    text = text * times if times % 7 == 0 else text
    found = M.Boundaries.of_text(text.encode())
    assert len(found) == len(text)
    for n in {0, 1, len(text) // 3, len(text) // 2, len(text)} & set(range(len(text) + 1)):
        assert found.cut(n) == len(text[:n].encode())


def test_long_texts_take_all_containers():
    rng = random.Random(4)
    text = "".join(rng.choice(["plain ascii text " * 9000, "é" * 50000, "aé" * 40000]) for _ in range(6))
    found = M.Boundaries.of_text(text.encode())
    assert len({type(c).__name__ for c in found.containers}) >= 2 and len(found) == len(text)
    for n in (1, 65535, 65536, 65537, len(text) - 1, *(rng.randrange(len(text)) for _ in range(200))):
        assert found.cut(n) == len(text[:n].encode())


def test_units_of_a_pattern():
    text = "one  two\nthree ünd vier".encode()
    found = M.Boundaries.of_text(text, re.compile(rb"\S+\s*"))
    assert len(found) == 5 and text[: found.cut(2)] == b"one  two\n" and found.cut(5) == len(text)


def brute(text, doc_id):
    import hashlib

    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_odd_texts_come_back(spark):
    texts = [None, "", "a", "<P>", "x<S>y", "<", "<S", "a<M", "<P<S<M" * 5, "é😀" * 40000, "\n", "a" * 300000, "dup", "dup"]
    df = spark.createDataFrame([(i if t != "dup" else 9999, t, "o", 1) for i, t in enumerate(texts * 12)], "doc_id long, text string, output string, n int")
    rows = M.fill_in_middle(df).withColumn("again", M.restored(M.F.col("output"), M.F.col("form"))).collect()
    assert len(rows) == len(texts) * 12 and {r.form for r in rows} == {"plain", "psm", "spm"}
    by = {r.doc_id: r for r in rows if r.doc_id != 9999}
    for i, t in enumerate(texts * 12):
        if t != "dup":
            r = by[i]
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(t or "", i) and r.again == (t or "")
    assert len({(r.output, r.form) for r in rows if r.doc_id == 9999}) == 1


def test_null_ids_and_an_empty_table(spark):
    df = spark.createDataFrame([(None, "some text")], "doc_id long, text string")
    assert M.fill_in_middle(df).first().output == brute("some text", "")[4]
    assert M.fill_in_middle(df.limit(0)).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = M.op12_fill_in_middle(spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({M.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
