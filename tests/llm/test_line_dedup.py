import random
from collections import Counter

from pyspark.sql import functions as F

from tillage.llm import line_dedup as L


def brute(texts, min_docs):
    strip = " \t\n\r\x0b\x0c"
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(strip).translate(table)
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or counts[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    pool = ["Menu", " menu\r", "MENU\t", "É", "é", "one", "two ", "", "  ", "\x0b", "Foot  er", "\xa0one"] + [f"line {i}" for i in range(30)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(6))) for _ in range(60)] + [None, "", "\n\n", "x\n" * 5000, "Menu", "Menu"]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 long").repartition(5)
    for min_docs, batches in ((2, 4), (10, 2)):
        got = L.dedup_lines(docs, min_docs=min_docs, batches=batches)
        assert got.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
        found = Counter((r.doc_id, r.h1, r.n_lines, r.n_dropped, r.text) for r in got.collect())
        assert found == Counter((i, n, *b) for (i, _, n), b in zip(rows, brute(texts, min_docs)))
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_levels_and_unseen_lines(spark):
    runs = L.LineRuns(spark, min_docs=2, buckets=2, fanout=2)
    for batch in (["a\nb", "b"], ["c\nb"], ["d"], ["a"], ["e"]):
        runs.add(L.keys(spark.createDataFrame([(t,) for t in batch], "text string")))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    probe = L.keys(spark.createDataFrame([("a\nb\nz\ne",)], "text string"))
    assert runs.unseen(probe).count() == 1 and runs.frequent().count() == 2
    plan = runs._merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert probe.agg(F.count_distinct("h1", "h2")).first()[0] == 4


def test_one_huge_text_and_line(spark):
    """A third of the rows share a text, and all share a line."""
    rows = [(i, "menu\n" + ("same\ntext" if i % 3 == 0 else f"own {i}\nMENU ")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.text, r.n_dropped) for r in L.dedup_lines(docs).collect()}
    assert got == {i: ("", 3) if i % 3 == 0 else (f"own {i}", 2) for i in range(3000)}
    names = {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    assert not any(n.startswith("tillage_") for n in names)  # no table names are left behind
