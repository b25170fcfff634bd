"""The graph's semantics on a small invented graph, chunking against Python, files and streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tillage.operators import chunking as C
from tillage.operators import entities as E
from tillage.operators import graph as G
from tillage.operators import retrieval as R
from tillage.sources import readers
from tillage.streaming import violations


@pytest.fixture(scope="module")
def small(spark):
    make = spark.createDataFrame
    raw = make(
        [
            (1, "H1", "annual ryegrass", "wheat", "1 L/ha", "control", ["WA", "NSW"]), (2, "H1", "annual ryegrass", "wheat", "2 L/ha", "suppression", ["WA"]), (3, "H2", "annual ryegrass", "barley", "20 g/ha", "control", []),
            (4, "H2", "wild radish", "wheat", "", "control", ["wa"]), (5, "H3", "dock", "wheat", "5 mL/ha", "partial", None),
        ], "seq int, product_number string, weed string, crop string, rate_per_ha string, control_level string, states array<string>",
    ).withColumns({"application_timing": F.lit(None).cast("string"), "critical_comments": F.lit(None).cast("string")})
    return G.Graph(
        herbicide=make([(f"H{i}", f"Product {i}", "x", None, None) for i in (1, 2, 3, 4)], "product_number string, product_name string, active_constituent string, chemical_group string, withholding_period string"),
        mode_of_action=G.moa_nodes(spark), has_mode_of_action=make([("H1", "A"), ("H2", "B"), ("H3", "A")], "product_number string, group string"),
        weed=make([("annual ryegrass", "Annual Ryegrass", "Lolium rigidum"), ("wild radish", "Wild Radish", None), ("dock", "Paddock Dock", None)], "common_name string, display_name string, scientific_name string"),
        crop=make([(x, x.title()) for x in ("wheat", "barley", "canola")], "name string, display_name string"), controls=G.latest(raw, ["product_number", "weed", "crop"], ["seq"]),
        registered_for=make([("H1", "wheat"), ("H2", "barley")], "product_number string, name string"), registered_in=make([("H1", "WA")], "product_number string, code string"),
    )


def ids(df):
    return [r.product_number for r in df.collect()]


def test_last_writer_wins(small):
    row = small.controls.where("product_number = 'H1'").collect()
    assert len(row) == 1 and (row[0].rate_per_ha, row[0].states) == ("2 L/ha", ["WA"])


def test_products_for_weed(small):
    assert ids(E.find_products_for_weed(small, "RYEGRASS")) == ["H1", "H2"]
    assert ids(E.find_products_for_weed(small, "ryegrass", state="wa")) == ["H1"]
    assert ids(E.find_products_for_weed(small, "radish", state="wa")) == []  # stored in lower case
    assert ids(E.find_products_for_weed(small, "ryegrass", crop="barley", strict=False)) == ["H1", "H2"]
    assert ids(E.find_products_for_weed(small, "paddock", crop="canola", strict=False)) == []
    assert ids(E.find_products_for_weed(small, "", exclude_moa="A")) == ["H2", "H2"]
    assert ids(E.find_products_for_weed(small, "dock", state="wa")) == []  # null states


def test_details_crops_and_searches(small):
    h4 = E.product_details(small, "H4").first()
    assert h4.moa_group is None and h4.crops == [] and len(h4.controls) == 1 and h4.controls[0].weed is None
    assert E.product_details(small, "H9").count() == 0
    assert E.find_products_for_crop(small, "wheat", "nsw").first().weeds_controlled == []
    assert [tuple(r) for r in E.search_weeds(small, "lolium").collect()] == [("annual ryegrass", "Annual Ryegrass", "Lolium rigidum", 2)]
    assert E.search_crops(small, "canola").first().herbicide_count == 0 and E.search_crops(small, "zzz").count() == 0
    assert [r.moa_group for r in E.moa_rotation(small, "A", "wheat", "radish").collect()] == ["B"]


def test_totals_and_questions(small, spark):
    assert tuple(E.graph_totals(small).first()) == (4, 3, 3, 4)
    none = G.Graph(**{k: t.limit(0) for k, t in small.tables().items()})
    assert tuple(E.graph_totals(none).first()) == (0, 0, 0, 0)
    assert tuple(E.ask(small, "How many herbicides control ryegrass?").first()) == (2, "annual ryegrass")
    assert E.ask(small, "how many herbicides control nothing at all?").first()["count"] == 0
    assert E.ask(small, "How many herbicides?").first()["count"] == 4 and E.ask(small, "hello") is None
    assert E.ask(small, "most common MOA").first().moa == "A" and E.ask(small, "Which weeds are hit most?").first().weed == "annual ryegrass"
    assert G.clear(small.__class__()) is False
    routes = spark.createDataFrame([("rotation count",), ("How many",), ("control it",), ("hi",)], "t string").select(E.route(F.col("t")).alias("r")).collect()
    assert [r.r for r in routes] == ["rotation", "cypher", "graph", "semantic"]


def test_context_at_the_ends(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", i) for i in range(4)], "chunk_id string, product_number string, sequence_order int")
    got = {r.chunk_id: (r.prev, r.next) for r in R.context(chunks, 2).collect()}
    assert got["c0"] == ([], ["c1", "c2"]) and got["c3"] == (["c1", "c2"], []) and got["c1"] == (["c0"], ["c2", "c3"])
    assert {tuple(map(tuple, (r.prev, r.next))) for r in R.context(chunks, 0).collect()} == {((), ())}
    assert R.context(chunks, 9, near=chunks.where("chunk_id = 'c2'")).first().prev == ["c0", "c1"]


def python_chunks(product, tables, most):
    """Chunks by a plain loop over the tables."""
    import re

    out, current, seq = [], None, 0
    for t in tables:
        rows = t["rows"]
        if not rows:
            continue
        text = "\n".join(" | ".join(r) for r in rows)
        flat = " ".join(" ".join(r) for r in rows)
        section = next((n for n, p in C.SECTIONS if re.search(p, flat, re.I)), "directions_for_use" if t["column_count"] >= 4 else "metadata" if t["column_count"] == 2 else "general")
        current = section if section != "general" else current
        weed = len(rows) >= 3 and any(any(w in r[0].lower() for w in C.WEED_WORDS) or any(re.search(r"\d+\s*(mL|g|L)/ha", c, re.I) for c in r) for r in rows[:5] if r)
        kind = "weed_table" if weed else "directions" if section == "directions_for_use" else "metadata" if section == "metadata" or t["column_count"] <= 2 else "table"
        if len(text.strip()) < 20:
            continue
        digest = hashlib.md5(f"{product}-{t['table_id']}-{seq}".encode()).hexdigest()[:8]
        size = len(text.split())
        head = rows[0] if t["column_count"] >= 3 else None
        if size > most and len(rows) > 3:
            data = rows[1:] if head else rows
            per = max(1, len(data) // (size // most + 1))
            for k in range(0, len(data), per):
                body = "\n".join(" | ".join(r) for r in data[k : k + per])
                out.append((f"{product}-{t['table_id']}-part{k // per}-{digest}", (" | ".join(head) + "\n" if head else "") + body, kind, seq, current))
                seq += 1
        else:
            out.append((f"{product}-{t['table_id']}-{digest}", text, kind, seq, current))
            seq += 1
    return out


def test_table_chunks_are_those_of_a_loop(spark):
    tables = [
        ("a", [["Crop", "Weeds", "Rate"]] + [[f"wheat {i}", "dock dock dock", f"{i} L/ha"] for i in range(9)], 3), ("b", [["x"]], 1), ("c", [["zz yy", "qq"], ["ww vv uu", "tt"], ["ss rr", "pp"]], 2),
        ("d", [["one two three four five six", "k"]] * 8, 1), ("e", [], 4), ("f", [["nnnnnnnnnn", "mmmmmmmmmm", "llllllllll"]], 3),
    ]
    rows = [("P", i, n, r, None, c, len(r), None) for i, (n, r, c) in enumerate(tables)]
    df = spark.createDataFrame(rows, "product_number string, position int, table_id string, rows array<array<string>>, markdown string, column_count int, row_count int, page int")
    got = sorted(((r.chunk_id, r.text, r.chunk_type, r.sequence_order, r.parent_section) for r in C.chunk_tables(df, 20).collect()), key=lambda x: x[3])
    assert got == python_chunks("P", [{"table_id": n, "rows": r, "column_count": c} for n, r, c in tables], 20)


def test_label_files_to_graph_and_back(spark, tmp_path):
    one = {"product_number": "1", "product_name": "A", "active_constituent": "x", "mode_of_action_group": "b", "registered_crops": [" Wheat "], "registered_weeds": ["Paterson's Curse", ""], "weed_control_entries": [{"crop": "Oats", "weed_common_name": "Dock", "states": ["WA"]}, {"crop": " ", "weed_common_name": "Dock"}], "state_restrictions": ["wa", "xx"]}
    (tmp_path / "1ELBL.json").write_text(json.dumps(one))
    (tmp_path / "2ELBL.json").write_text(json.dumps({"product_name": "B", "weed_control_entries": [{"crop": "oats", "weed_common_name": "dock", "weed_scientific_name": "Rumex"}]}))
    (tmp_path / "_skip.json").write_text("{}")
    (tmp_path / "3ELBL.json").write_text("{broken")
    records = readers.read_label_records(spark, str(tmp_path))
    assert {r.stem: r._corrupt_record is not None for r in records.collect()} == {"1ELBL": False, "2ELBL": False, "3ELBL": True}
    g = G.load_labels(records.where("_corrupt_record IS NULL"))
    assert {(r.common_name, r.display_name, r.scientific_name) for r in g.weed.collect()} == {("patersons curse", "Paterson's Curse", None), ("dock", "dock", "Rumex")}
    assert {r.product_number for r in g.herbicide.collect()} == {"1", "2"} and {tuple(r) for r in g.registered_in.collect()} == {("1", "WA")}
    assert {tuple(r) for r in g.has_mode_of_action.collect()} == {("1", "B")} and {r.name for r in g.crop.collect()} == {"wheat", "oats"}
    assert tuple(g.loaded.first()) == (2, 1, 2, 2)
    g.write(str(tmp_path / "graph"))
    back = G.Graph.read(spark, str(tmp_path / "graph"), ["controls", "weed"])
    assert back.controls.count() == 2 and G.duplicate_keys(back.weed, "common_name").count() == 0


def test_files_and_blocks(spark, tmp_path):
    (tmp_path / "9ELBL.docling.json").write_text(json.dumps({"tables": [{"id": "t", "rows": [["a", 1]], "column_count": 2, "row_count": 1, "bbox": None}]}))
    (tmp_path / "a.md").write_text("# x\r\ny")
    (tmp_path / "a.cleaned.md").write_text("no")
    (tmp_path / "s.csv").write_text("No,Actives,Name\n1, a ,x\n2,a,y\n3,,z\n")
    assert tuple(readers.read_parsed_tables(spark, str(tmp_path)).select("product_number", "rows", "page").first()) == ("9", [["a", "1"]], None)
    assert [(r.file, r.text) for r in readers.read_markdown(spark, str(tmp_path)).collect()] == [("a.md", "# x\r\ny")]
    first = readers.first_per_key(readers.read_search_csv(spark, str(tmp_path / "s.csv")), "Actives", "No").collect()
    assert [(r.Actives, r.Name) for r in first] == [("a", "x")]
    rows = spark.createDataFrame([('{"a": "}{"} {"b": 1}\n# t {',), ("none",), (None,)], "t string").select(readers.split_json_blocks("t").alias("s")).collect()
    assert [(r.s.blocks, r.s.trailing) for r in rows] == [(['{"a": "}{"}', '{"b": 1}'], "# t {"), ([], "none"), ([], None)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in" / "events.parquet"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "events.parquet"))
    got = violations.run_once(violations.hourly_rates(stream, "30 days"), str(tmp_path / "rows"), str(tmp_path / "checkpoint"))
    want = events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").count()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_stream_of_many_unordered_part_files(spark, tmp_path):
    from tillage.plans import text_queries as T

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy(F.desc("ts")).coalesce(1)
    per_file = -(-events.count() // 20)
    events.write.option("maxRecordsPerFile", per_file).parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("part-*"))) == 20
    got, want = (sorted(map(repr, T.QUERIES[name](spark, str(tmp_path)).select("start", "event_type", "n").collect())) for name in ("violation_rate_stream", "violation_rate_hourly"))
    assert got == want and got


def test_chunks_in_the_graph_and_answers(small, spark):
    from tillage.operators import answers as A

    chunks = spark.createDataFrame(
        [("H1-t-1", "ryegrass and dock in wheat", "table", 0, "H1", [1.0, 0.0]), ("H1-t-2", "wild radish", "table", 1, "H1", [0.0, 1.0]), ("H9-t-1", "barley", "table", 0, "H9", None)],
        "chunk_id string, text string, chunk_type string, sequence_order int, product_number string, embedding array<double>",
    )
    docs = spark.createDataFrame([("H1", "old", 1), ("H1", "new", 2), ("H9", "x", 1)], "product_number string, source string, seq int")
    g = A.load_chunks(G.Graph(**small.tables()), chunks, docs, squash=False)
    assert {(r.product_number, r.source, r.chunk_count) for r in g.document.collect()} == {("H1", "new", 2), ("H9", "x", 1)}
    assert [r.product_number for r in g.has_label.collect()] == ["H1"] and [tuple(r) for r in g.next.collect()] == [("H1-t-1", "H1-t-2")]
    assert ("H1-t-2", "wild radish", "Weed") in {tuple(r) for r in g.mentions.collect()}
    assert "Product 1" in A.describe_vector_search(g, "q", lambda t: [1.0, 0.1], 2)
    assert "Annual" not in A.describe_entity(g, "weed", "nothing") and "Product 1" in A.describe_entity(g, "weed", "ryegrass")
    assert "Product 2" in A.describe_entity(g, "crop", "barley") and "group A" in A.describe_entity(g, "herbicide", "H1") and "Unknown" in A.describe_entity(g, "x", "y")
    assert "Group B" in A.describe_rotation(g, "A", "wheat", "radish") and "Product 1" in A.describe_hybrid(g, "q", lambda t: [1.0, 0.1], 1)
    assert A.describe_vector_search(g, "q", lambda t: [1.0, 0.1], 2, chunk_type="none") == "No matching chunks."
    assert "- Annual Ryegrass in wheat: 2 L/ha" in A.describe_entity(g, "Herbicide", "H1") and "ryegrass" not in A.describe_entity(g, "herbicide", "H1", include_controls=False).lower()
    assert "Products:" not in A.describe_hybrid(g, "q", lambda t: [1.0, 0.1], 1, expand_graph=False)
    assert [r.chunk_id for r in R.chunks_for(g, "radish", "Weed", once=True).collect()] == ["H1-t-2"]


def test_mentions_are_asked_by_parts(spark):
    from dataclasses import replace

    from tillage.operators import chunking as C

    texts = ["Wild radish, dock", "oats", "nothing", "dock and wild  oats", "paddock", None]
    chunk = spark.createDataFrame([(f"c{i}", t, "text", "1", [1.0, float(i)]) for i, t in enumerate(texts)], "chunk_id string, text string, chunk_type string, product_number string, embedding array<double>")
    names = spark.createDataFrame([(n,) for n in ("paddock dock", "wild oats", "oats", "burdock", "fern", "oats")], "name string")
    document, herbicide = spark.createDataFrame([("1", "s")], "product_number string, source string"), spark.createDataFrame([("1", "p")], "product_number string, product_name string")
    for patterns, squash in ((["dock", "oats"], True), (["dock", r"wild\s*oats?", "oats?"], False), (["dock", r"wild\s*oats?"], True)):
        links = C.Links(chunk, [C.Link(chunk, names, patterns, "Weed", squash), C.Link(chunk, names, ["fern", "oats"], "Crop", squash)])
        g = G.Graph(chunk=chunk, mentions=links.table, links=links, document=document, herbicide=herbicide)
        plain = replace(g, links=None)
        low = [(t or "").lower() for t in texts]
        token = lambda t, p: (m := __import__("re").search(p, t)) and m.group().replace(" ", "" if squash else " ")
        want = {(f"c{i}", n, kind) for kind, ps in (("Weed", patterns), ("Crop", ["fern", "oats"])) for i, t in enumerate(low) for p in ps for n in ("paddock dock", "wild oats", "oats", "burdock", "fern") if (x := token(t, p)) and x in n}
        assert sorted(map(tuple, g.mentions.collect())) == sorted(want) and {r.name: r.total for r in G.stats(g).collect()}["mentions"] == len(want)
        ids = chunk.where("chunk_id IN ('c1', 'c3')").select("chunk_id")
        assert sorted(map(repr, R.mentioned(g, ids, brief=True).collect())) == sorted(map(repr, R.mentioned(plain, ids).collect()))
        for term, kind in (("dock", "Weed"), ("OAT", "Crop"), ("fern", "Other")):
            for k in (2, 10):
                assert sorted(map(repr, R.chunks_for(g, term, kind, k).collect())) == sorted(map(repr, R.chunks_for(plain, term, kind, k).collect()))
            once = [sorted((r.chunk_id, r.score) for r in R.chunks_for(x, term, kind, 2, once=True).collect()) for x in (g, plain)]
            assert once[0] == once[1]
    g.mentions = g.mentions.limit(1)
    assert g.linked() is None and {r.name: r.total for r in G.stats(g).collect()}["mentions"] == 1
