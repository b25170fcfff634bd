"""Readers, sinks, the ledger and merged blocks on small files; guardrail metrics on hand-written rows."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tillage.functions import cleaning, guardrails, labels
from tillage.operators import chunking as C
from tillage.operators import retrieval as R
from tillage.sources import readers


def test_limits_take_the_first_files_by_name(spark, tmp_path):
    for name in ("c", "a", "_x", "extraction_summary", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"product_number": name}))
    (tmp_path / "d.json").write_text("{broken")
    rows = {r.stem: r._corrupt_record for r in readers.read_label_records(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b", "c", "d"} and rows["d"] and not rows["a"]
    assert sorted(r.stem for r in readers.read_label_records(spark, str(tmp_path), 2).collect()) == ["a", "b"]
    assert readers.read_label_records(spark, str(tmp_path), 0).count() == 0
    for name in ("2", "1"):
        table = {"id": "t", "row_count": 1, "column_count": 1, "rows": [["x"]], "bbox": {"page": 3}}
        (tmp_path / f"{name}ELBL.docling.json").write_text(json.dumps({"tables": [table, table]}))
    tables = readers.read_parsed_tables(spark, str(tmp_path), 1).collect()
    assert [(r.product_number, r.position, r.page) for r in tables] == [("1", 0, 3), ("1", 1, 3)]
    assert readers.read_parsed_files(spark, str(tmp_path)).count() == 2


def test_ledger_keeps_the_last_entry(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "stem string, status string, at int")
    path = str(tmp_path / "ledger")
    readers.write_ledger(make([("a", "failed", 1), ("b", "parsed", 1)]), path)
    readers.write_ledger(make([("a", "parsed", 2), ("c", "failed", 2)]), path)
    ledger = readers.read_ledger(spark, path)
    assert sorted(map(tuple, ledger.collect())) == [("a", "parsed", 2), ("b", "parsed", 1), ("c", "failed", 2)]
    files = spark.createDataFrame([("a",), ("c",), ("d",)], "stem string")
    assert sorted(r.stem for r in readers.pending(files, ledger.where("status = 'parsed'")).collect()) == ["c", "d"]


def test_blocks_of_a_file_are_merged(spark):
    one, two = '{"source": "s", "n": 1, "tables": [{"id": "t1"}], "text_items": ["x", " ", 5, null]}', '{"tables": null, "text_items": []}'
    rows = [("a", [one, two], "intro\n# Head\nbody\n#no"), ("b", [one], None), ("c", [one], "text"), ("d", [], "text"), ("e", [one, "[1]"], ""), ("f", None, None)]
    got = {r.file: r for r in readers.merge_blocks(spark.createDataFrame(rows, "file string, blocks array<string>, trailing string")).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"].fields == {"source": "s", "n": "1"} and [json.loads(t) for t in got["a"].tables] == [{"id": "t1"}]
    assert got["a"].text_items == ["x", "intro", "Head\nbody\n#no"] and got["c"].text_items == ["x", "text"]
    assert [(b.block_index, b.type, b.num_tables, b.has_text_items) for b in got["a"].raw_blocks] == [(0, "json", 1, True), (1, "json", 0, False), (2, "markdown", None, None)]
    assert got["a"].raw_blocks[2].content_preview == "intro\n# Head\nbody\n#no..."


def test_sinks_keep_file_names(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "one\ntwo\n"), ("b c.md", "x")], "file string, cleaned string")
    readers.write_files(rows, str(tmp_path / "md"), "cleaned")
    back = spark.read.text(str(tmp_path / "md"), wholetext=True).select("file", F.rtrim(F.regexp_replace("value", r"\s+$", "")).alias("t"))
    assert {(r.file, r.t) for r in back.collect()} == {("a.md", "one\ntwo"), ("b c.md", "x")}
    readers.write_json(rows, str(tmp_path / "json"), F.col("file"), "m", F.lit("now"))
    assert {tuple(r._meta) for r in spark.read.json(str(tmp_path / "json")).collect()} == {("now", "m", "a.md"), ("now", "m", "b c.md")}
    readers.write_texts(rows, str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).count() >= 3
    assert json.loads(readers.chunk_json(spark.createDataFrame([("c", ["h"])], "chunk_id string, headers array<string>")).first().json) == {"chunk_id": "c", "headers": ["h"]}
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "x.pdf").write_bytes(b"p1|p2")
    assert tuple(readers.read_pdfs(spark, str(tmp_path / "pdf"), lambda b: b.decode().split("|")).first()) == ("x.pdf", "p1\n\n---\n## Page 2\n\np2")


def test_first_row_of_a_key_strips_all_white_space(spark):
    rows = [("\tx ", " ", 0, "no number"), (" x\n", "7\t", 1, "first"), ("x", "8", 2, "later"), (" \t", "9", 3, "no key"), (None, "9", 4, "null"), ("y", None, 5, "null number")]
    got = readers.first_per_key(spark.createDataFrame(rows, "actives string, no string, at int, name string"), "actives", "at", ("no",)).collect()
    assert [tuple(r) for r in got] == [("x", "7", 1, "first")]


def test_reductions_and_minimum_lengths(spark):
    rows = spark.createDataFrame([("abcd", "ab"), ("abcdef", "abc"), ("zz", None)], "text string, cleaned string")
    assert tuple(cleaning.corpus_reduction(rows).first()) == (3, 2, 1, 10, 5, 50.0)
    assert tuple(cleaning.corpus_reduction(rows.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0)
    texts = spark.createDataFrame([("x" * 99 + "   ",), ("y" * 100,), (None,)], "t string")
    assert [r[0] for r in texts.select(labels.long_enough(F.col("t"))).collect()] == [False, True, False]
    page = lambda p, n: spark.range(1).select(labels.page_count(F.array(*map(F.lit, p)), F.lit(n))).first()[0]
    assert page([0, 3, -1], 2) == 3 and page([0, -2], 2) == 2


def test_contextualized_text_and_embeddings(spark):
    row = spark.range(1).select(C.contextualize(F.lit("P"), F.lit(""), F.lit("weed_table"), F.lit("text")).alias("a"), C.contextualize(F.lit(None), F.lit("s"), F.lit("table"), F.lit("text")).alias("b")).first()
    assert tuple(row) == ("[Product: P] [Weed Control Table] text", "[Section: s] text")
    sizes = []

    def model():
        return lambda texts: sizes.append(len(texts)) or [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(f"{'x' * i}",) for i in range(5)], "text string").coalesce(1)
    assert [r.embedding for r in R.embed_column(df, "text", model, batch=2).collect()] == [[float(i), 1.0] for i in range(5)]


def test_violation_records_and_rejections(spark):
    at = datetime(2024, 1, 1, 9)
    texts = ["mail me@x.org", "ask a doctor", "which weed", None]
    checked = guardrails.check_messages(spark.createDataFrame([(at, t) for t in texts], "ts timestamp_ntz, text string"))
    assert [(r.timestamp, r.violation_type, r.action_taken, r.metadata.pii_types) for r in guardrails.violation_records(checked, "ts").collect()] == [(at, "pii", "rejected", ["email"]), (at, "off_topic", "flagged", [])]
    rows = [(at + timedelta(minutes=5 * w, seconds=i), i < bad) for w, bad in enumerate((2, 3, 0, 2, 2, 2)) for i in range(10)]
    requests = spark.createDataFrame(rows, "ts timestamp_ntz, bad boolean")
    shares = guardrails.rejection_shares(requests, F.col("bad"))
    assert {r.start: r.share for r in shares.collect()}[at] == 0.2
    assert sorted(r.start for r in guardrails.rejection_alerts(shares).collect()) == [at + timedelta(minutes=5 * w) for w in (1, 4, 5)]
    slow = spark.createDataFrame([(at + timedelta(seconds=i), float(i)) for i in range(101)], "ts timestamp_ntz, ms double")
    assert [tuple(r) for r in guardrails.latency_percentile(slow, "ms").collect()] == [(at, 95.0)]


def test_result_pages_are_read_in_order(spark):
    page = lambda *links: "".join(f'<tr><td><A class="x" href="{x}">t {x}</a>' for x in links)
    rows = [("s", 1, page("a", "b", "a")), ("s", 2, page("b", "c")), ("s", 3, page("d")), ("t", 1, page("a")), ("t", 2, page("a")), ("t", 3, page("z")), ("u", 1, "none"), ("u", 2, page("q")), ("v", 1, None)]
    got = readers.result_links(spark.createDataFrame(rows, "search string, number int, html string"), "search", "number").collect()
    assert {tuple(r) for r in got} == {("s", "a", 1), ("s", "b", 1), ("s", "c", 2), ("t", "a", 1)}
    html = spark.createDataFrame([('<a href="/x">other</a> <a id="l" href="y.pdf">View E-Label </a><a href="z">e-label</a>',), ("<p>",), (None,)], "h string")
    assert [r[0] for r in html.select(readers.link_by_text(F.col("h"), "e-label")).collect()] == ["y.pdf", None, None]


def test_first_cell_links_and_limits(spark, tmp_path):
    page = """<a href="/menu">m</a><table class="nav"><tr><td><a href="/nav">n</a></td></tr></table><TABLE id="r" class="wide search-results-table">
<tr><th><a href="/head">h</a></th></tr><tr class="x"><td> <b><a class="k" href="/p1">one</a></b><a href="/second">s</a></td><td><a href="/other">o</a></td></tr>
<tr><td>no link</td><td><a href="/late">l</a></td></tr><tr><td><a href="/p2">two</a></td></tr></TABLE><a href="/foot">f</a>"""
    df = spark.createDataFrame([("q", 1, page), ("q", 2, page.replace("/p2", "/p3")), ("r", 1, "<p>none</p>"), ("s", 1, None)], "search string, number int, html string")
    got = {(r.search, r.number): r.l for r in df.select("search", "number", readers.first_cell_links(F.col("html")).alias("l")).collect()}
    assert got["q", 1] == ["/p1", "/p2"] and got["q", 2] == ["/p1", "/p3"] and not got["r", 1] and not got["s", 1]
    links = {tuple(r) for r in readers.result_links(df, "search", "number", links_of=readers.first_cell_links).collect()}
    assert links == {("q", "/p1", 1), ("q", "/p2", 1), ("q", "/p3", 2)}
    for name in ("b.md", "a.md", "_c.md", "a.cleaned.md", "y.pdf", "x.pdf"):
        (tmp_path / name).write_bytes(name.encode())
    assert sorted(r.file for r in readers.read_markdown(spark, str(tmp_path), limit=2).collect()) == ["a.md", "b.md"]  # Spark passes by names that start with _
    assert [r.file for r in readers.read_markdown(spark, str(tmp_path), for_extraction=True, limit=1).collect()] == ["a.md"]
    assert [tuple(r) for r in readers.read_pdfs(spark, str(tmp_path), lambda b: [b.decode()], limit=1).collect()] == [("x.pdf", "x.pdf")]


def test_percentiles_that_merge(spark):
    from tillage.functions import guardrails

    rows = spark.range(60_000).select((F.timestamp_seconds(F.col("id") % 7200)).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("double").alias("v"))
    short = guardrails.latency_sketches(rows, "v")
    hours = guardrails.sketched_percentile(guardrails.rolled_up(short)).collect()
    assert short.count() == 24 and sorted(r.n for r in hours) == [28_800, 31_200]
    assert all(abs(r.latency / 1_000_000 - 0.95) < guardrails.SKETCH_ERROR + 0.005 for r in hours)


def test_a_dotted_capital_counts_as_i(spark):
    from tillage.functions.text import any_of

    got = spark.createDataFrame([("FİRST AİD",), ("nothing",)], "t string").select(any_of("first aid")(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [True, False]
