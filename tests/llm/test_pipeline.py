import hashlib
from collections import defaultdict

import duckdb
import corpus_pipeline as P
from pyspark.sql import functions as F

from tillage.llm import line_dedup, near_dedup, quality_rules, shared, substring_dedup

SMALL = "/root/testdata/sf0.001"


def sql(docs, query):
    documents = docs.toPandas()  # noqa: F841  read by DuckDB
    con = duckdb.connect()
    con.register("documents", documents)
    found = con.execute(query)
    names = [d[0] for d in found.description]
    return {r[names.index("doc_id")]: dict(zip(names, r)) for r in found.fetchall()}


def test_each_stage_does_its_operator(spark):
    docs = shared.read(spark, SMALL, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = shared.save(stage(spark, docs, SMALL), name)
        assert out.columns == columns
        kept[name] = {r.doc_id: r for r in out.collect()}
        assert all(r.n_chars == len(r.text) for r in kept[name].values())
        before = {r.doc_id: r.text for r in docs.collect()}
        digest = lambda r: hashlib.sha256(r.text.encode()).hexdigest()
        if name == "quality_rules":
            assert set(kept[name]) == {i for i, r in sql(docs, quality_rules.ORACLE).items() if r["kept"]}
        elif name == "line_dedup":
            assert {i: digest(r) for i, r in kept[name].items()} == {i: r["kept_sha256"] for i, r in sql(docs, line_dedup.ORACLE).items()}
        elif name == "near_dedup":
            assert set(kept[name]) == {i for i, r in sql(docs, near_dedup.ORACLE).items() if r["kept"]}
        else:
            for i, r in sql(docs, substring_dedup.ORACLE).items():
                assert kept[name][i].text == before[i] if not r["n_removed"] else digest(kept[name][i]) == r["kept_sha256"]
        docs = out
    bins, tokens = defaultdict(list), defaultdict(int)
    for r in P.STAGES[-1][1](spark, docs, SMALL).collect():
        bins[r.sequence_id].append((r.offset, r.length))
        tokens[r.doc_id] += r.length
    assert set(tokens) == set(kept["substring_dedup"])
    assert all(sum(n for _, n in b) <= 4096 for b in bins.values()) and len(bins) == -(-sum(tokens.values()) // 4096)


def test_empty_corpus(spark):
    docs = shared.read(spark, SMALL, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b, c, d, e, f = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcdef")
    near = lambda t: t + " more"
    rows = [(3, b), (5, a), (5, near(b)), (None, near(b)), (None, near(a))]  # 5 is a's id and a copy's
    rows += [(7, c), (7, c), (7, near(c)), (8, c)]  # equal rows, and two texts of one component with one id
    rows += [(None, d), (None, d), (None, near(d)), (None, e)]  # no id at all
    rows += [(9, f), (4, near(f)), (9, ""), (9, ""), (None, None), (None, " \n"), (2, "\u2028")]  # rows without words stay
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, n_chars long").repartition(3)
    out = P.near_duplicates(spark, docs, SMALL)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    for group in (b, a, c, d, e, f):
        assert len([t for _, t in got if t in (group, near(group))]) == 1
    assert {(3, b), (5, a), (None, e), (4, near(f))} <= set(got) and [i for i, t in got if t in (c, near(c))] == [7]
    assert sorted(map(repr, (r for r in got if not (r[1] or "").split(" ")[0].strip() or r[1] == "\u2028"))) == sorted(map(repr, [(9, ""), (9, ""), (None, None), (None, " \n"), (2, "\u2028")]))
    assert len(got) == 11


NAMES = ["key", "kept", "n_lines", "n_dropped", "n_words", "n_removed", "spans", "host", "of_host", "n_docs", "base_failed", "component", "gone_id", "own_id", "stay_id", "digest", "c0", "c1", "u0", "tag", "h1", "t1", "a", "b", "anchors", "source_start", "batch"]


def test_stages_keep_columns_of_any_name_and_odd_rows(spark):
    """Columns named after the stages' own come back as they were; null texts, null and repeated ids and repeated rows pass."""
    docs = shared.read(spark, SMALL, "documents").where("doc_id < 120")
    odd = spark.createDataFrame([(None, None), (None, ""), (5, None), (5, " \n"), (None, "w " * 20), (7, "long " * 60_000), (7, "long " * 60_000)], "doc_id long, text string")
    odd = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = docs.unionByName(odd.select(*docs.columns)).unionByName(docs.where("doc_id % 40 = 3"))
    docs = docs.withColumns({n: F.concat_ws("-", F.lit(n), "doc_id") for n in NAMES})
    docs = shared.save(docs, "odd")
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        out = shared.save(stage(spark, docs, SMALL), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        assert all(r[n] == (n if r.doc_id is None else f"{n}-{r.doc_id}") for r in rows for n in NAMES)
        assert all(r.n_chars == len(r.text) for r in rows)
        sizes.append(len(rows))
        if name != "quality_rules":  # which drops texts without words
            again = stage(spark, docs.unionByName(spark.createDataFrame([(None,) * len(docs.columns)] * 2, docs.schema)), SMALL)
            assert again.where("coalesce(text, '') = ''").count() >= 2
        docs = out
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4] > 0
    packed = P.packed(spark, docs, SMALL)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0 and packed.where("start = 0").count() == sizes[4]
