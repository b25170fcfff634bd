import math
import re
import zlib

from pyspark.sql import functions as F

from tillage.llm import quality_classifier as Q


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = Q.train(docs, labels)
    assert 0 < len(model.rules) < 150
    scored = Q.score_documents(docs, model)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert right / len(rows) >= 0.95, (right, len(rows))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored.collect())


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "w " * 50000, 5), (None, "x", 5)], "doc_id long, text string, words int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    rows = Q.score_documents(docs, Q.train(docs, labels)).collect()
    assert len(rows) == 4 and all(r.score == 0.5 and r.predicted == 0 for r in rows)
    one = Q.score_documents(docs, Q.train(docs, spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int"))).collect()
    assert all(r.predicted == 1 for r in one)
    assert Q.score_documents(docs.limit(0), Q.RuleEnsemble(0.0, ())).count() == 0


def test_rules_are_compiled_columns(spark):
    model = Q.RuleEnsemble(0.0, (Q.Rule((("log_words", True, 1.0), ("mark_share", False, 0.1)), 2.0),))
    docs = spark.createDataFrame([(1, "a!"), (2, "a")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in Q.score_documents(docs, model).collect()}
    assert abs(got[1] - 0.8807970779778823) < 1e-12 and got[2] == 0.5
    plan = Q.score_documents(docs, model).select(F.col("score"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def by_hand(text, model):
    text = text or ""
    n = {
        "chars": len(text), "words": len(re.findall(r"[^\x20\x09-\x0D]+", text)), "symbols": len(re.findall(r"[#*$%&|<>@^~={}\[\]\\/_+]", text)), "capitals": sum(c.isupper() and c.isalpha() for c in text),
        "marks": len(re.findall("[!?]", text)), "stops": len(re.findall("[.,;:]", text)), "digits": len(re.findall("[0-9]", text)), "lines": len(text.split("\n")),
        "unique_words": len(set(re.split(r"[\x20\x09-\x0D]+", text))), "unique_lines": len(set(text.split("\n"))),
    }
    stats = {k: eval(e, {"log1p": math.log1p, **n}) for k, e in Q.STATISTICS.items()}
    total = model.intercept
    for rule in model.rules:
        if all(stats[name] <= value if at_most else stats[name] > value for name, at_most, value in rule.conditions):
            total += rule.weight
    return 1 / (1 + math.exp(-total))


def test_scores_equal_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = Q.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "\n"), (-4, "A! " * 100_000), (-5, "[a]\\_+^~ É? 1.2;")], docs.schema)
    rows = docs.where("doc_id < 200").unionByName(odd)
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = {r.doc_id: (r.score, r.predicted) for r in Q.score_documents(rows, model).collect()}
    assert set(got) == set(texts) and model.rules
    for i, text in texts.items():
        assert abs(got[i][0] - by_hand(text, model)) < 1e-9 and got[i][1] == int(got[i][0] >= 0.7)


def test_training_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(400)], "doc_id long, quality int")
    seen, whole = [], Q.fit
    try:
        Q.fit = lambda sample: seen.append(sample.count()) or Q.RuleEnsemble(0.0, ())
        Q.train(docs, labels, sample_rows=7)
        Q.train(docs, labels)
    finally:
        Q.fit = whole
    assert seen == [7, sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))]
