"""The stored graph: batches against one fold, constraints, versions, lookups."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tillage.operators import graph as G
from tillage.operators import graph_store as S
from tillage.sources.store import Conflict, KeyViolation, Rule, Store

RECORD = {"product_number": None, "product_name": None, "active_constituent": None, "chemical_group": None, "mode_of_action_group": None, "registered_crops": [], "registered_weeds": [], "weed_control_entries": [], "application_methods": [], "state_restrictions": [], "withholding_period": None}
RULES = {"t": Rule(("k",), known=("known",)), "e": Rule(("a", "b"))}
T = "k int, v string, known string"


def records(spark, folder, batch):
    from tillage.sources import readers

    os.makedirs(folder)
    for seq, r in batch:
        with open(f"{folder}/{seq}.json", "w") as f:
            json.dump(RECORD | r, f)
    return readers.read_label_records(spark, str(folder))


def control(weed, crop, rate=None, scientific=None, level=None):
    return {"crop": crop, "weed_common_name": weed, "weed_scientific_name": scientific, "states": ["WA"], "rate_per_ha": rate, "control_level": level}


LABELS = [
    ("01", {"product_number": "P1", "product_name": "one", "active_constituent": "x", "chemical_group": "g1", "mode_of_action_group": "A", "registered_crops": ["Wheat"], "weed_control_entries": [control("Dock", "wheat", "1 L/ha", "Rumex"), control("dock", "wheat", "2 L/ha")], "state_restrictions": ["wa"]}),
    ("02", {"product_number": "P2", "product_name": "two", "active_constituent": "x", "chemical_group": "g2", "mode_of_action_group": "B", "registered_weeds": ["DOCK"]}),
    ("03", {"product_number": "P1", "product_name": None, "active_constituent": "x", "chemical_group": None, "mode_of_action_group": "C", "registered_crops": ["WHEAT", "Oats"], "weed_control_entries": [control("Dock", "wheat", "3 L/ha", ""), control("Burr", "oats")]}),
    ("04", {"product_number": "P3", "product_name": "three", "active_constituent": "y", "weed_control_entries": [control("burr", "Oats", "4 L/ha", "Xanthium")], "state_restrictions": ["nsw", "zz"]}),
    ("05", {"product_number": "P3", "product_name": "three again", "active_constituent": "y", "weed_control_entries": [control("Burr", "oats", None, None, "partial")]}),
]


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_three_batches_equal_one_fold(spark, tmp_path):
    store = S.init_schema(spark, str(tmp_path / "g"), buckets=3)
    totals = [tuple(S.load_label_batch(store, records(spark, tmp_path / f"b{i}", LABELS[a:b]), buckets=3).first()) for i, (a, b) in enumerate([(0, 2), (2, 4), (4, 5)])]
    whole = G.load_labels(records(spark, tmp_path / "all", LABELS))
    stored = S.open_graph(store)
    for name, table in whole.tables().items():
        assert rows(getattr(stored, name)) == rows(table), name
    assert tuple(map(sum, zip(*totals))) == tuple(whole.loaded.first())
    assert {tuple(r) for r in stored.has_mode_of_action.collect()} == {("P1", "A"), ("P1", "C"), ("P2", "B")}  # P1 keeps its first group
    assert {(r.common_name, r.scientific_name) for r in stored.weed.collect()} == {("dock", "Rumex"), ("burr", "Xanthium")}
    assert stored.herbicide.where("product_number = 'P1'").first().product_name is None  # replaced, by null too
    assert S.open_graph(store, 2).herbicide.count() == 2 and stored.herbicide.count() == 3
    assert S.init_schema(spark, store.path).numbers() == store.numbers()  # seeds aren't written twice


def files(store, name):
    table = store.manifest()["tables"][name]
    return {b: {f: os.path.getmtime(f"{store.path}/{p}/{f}") for f in os.listdir(f"{store.path}/{p}")} for b, p in table["paths"].items()}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.merge({"t": spark.range(200).selectExpr("id AS k", "'a' AS v", "'x' AS known")}, RULES, buckets=8)
    before = files(store, "t")
    store.merge({"t": spark.createDataFrame([(3, "b", None)], T)}, RULES)
    after = files(store, "t")
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert tuple(store.lookup("t", spark.createDataFrame([(3,)], "k int")).first()) == (3, "b", "x") and store.read("t").count() == 200


def test_sets_and_an_empty_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    edge = lambda *r: spark.createDataFrame(list(r), "a string, b string")
    store.merge({"e": edge(("1", "x"), ("2", "y")), "t": spark.createDataFrame([], T)}, RULES)
    store.merge({"e": edge(("1", "x"), ("1", "z"))}, RULES)
    assert {tuple(r) for r in store.read("e").collect()} == {("1", "x"), ("2", "y"), ("1", "z")} and store.read("t").collect() == []
    assert store.lookup("t", spark.createDataFrame([(1,)], "k int")).collect() == []


@pytest.mark.parametrize("batch, named", [([(7, "a", "x"), (7, "b", "y"), (8, "c", "z")], "7"), ([(None, "a", "x")], "null"), ([(1, "again", "x")], "1")])
def test_a_broken_key_constraint_refuses_the_whole_write(spark, tmp_path, batch, named):
    store = Store(spark, str(tmp_path / "s"))
    store.merge({"t": spark.createDataFrame([(1, "a", "x")], T)}, RULES)
    left = set(os.listdir(tmp_path / "s" / "data" / "t"))
    with pytest.raises(KeyViolation, match=f"such as {named}$"):
        store.merge({"e": spark.createDataFrame([("p", "q")], "a string, b string"), "t": spark.createDataFrame(batch, T)}, RULES, insert=True)
    assert store.names() == ["t"] and [tuple(r) for r in store.read("t").collect()] == [(1, "a", "x")]
    assert set(os.listdir(tmp_path / "s" / "data" / "t")) == left and store.numbers() == [1]


def test_a_crash_before_the_swap_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.merge({"t": spark.createDataFrame([(1, "old", "x")], T)}, RULES)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Store, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        store.merge({"t": spark.createDataFrame([(1, "new", "x"), (2, "new", "x")], T)}, RULES)
    monkeypatch.undo()
    (tmp_path / "s" / "manifest-0000000002.json").write_text('{"version": 2, "tab')  # killed while it wrote
    assert [tuple(r) for r in store.read("t").collect()] == [(1, "old", "x")]
    assert store.merge({"t": spark.createDataFrame([(2, "next", "x")], T)}, RULES) == 3 and store.read("t").count() == 2
    store.vacuum()
    assert store.read("t").count() == 2 and store.numbers() == [3]
    kept = {p.split("/")[2] for p in store.manifest()["tables"]["t"]["paths"].values()}
    assert set(os.listdir(tmp_path / "s" / "data" / "t")) == kept


def test_a_second_writer_fails(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    one.merge({"t": spark.createDataFrame([(1, "a", "x")], T)}, RULES)
    merge_one = Store._merge_one

    def slow(self, *args):
        merge_one(self, *args)
        if self is two:
            one.merge({"t": spark.createDataFrame([(2, "b", "x")], T)}, RULES)

    monkeypatch.setattr(Store, "_merge_one", slow)
    with pytest.raises(Conflict):
        two.merge({"t": spark.createDataFrame([(1, "late", "x")], T)}, RULES)
    assert {tuple(r) for r in one.read("t").collect()} == {(1, "a", "x"), (2, "b", "x")}


def test_a_lookup_reads_its_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.merge({"t": spark.range(5000).selectExpr("id AS k", "string(id * 7) AS v", "'x' AS known")}, RULES, buckets=64)
    keys = spark.createDataFrame([(k,) for k in (5, 5, 17, 999, 123456)], "k long")
    found = store.lookup("t", keys)
    assert {tuple(r)[:2] for r in found.collect()} == {(5, "35"), (17, "119"), (999, "6993")}
    assert len({f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles()}) <= 4
    assert "PushedFilters: [In(k" in found._jdf.queryExecution().toString()
    many = store.lookup("t", spark.range(0, 5000, 2).withColumnRenamed("id", "k"))
    assert many.count() == 2500


def test_clearing_and_labels_of_stored_products(spark, tmp_path):
    store = S.init_schema(spark, str(tmp_path / "g"), buckets=2)
    S.load_label_batch(store, records(spark, tmp_path / "b", LABELS), buckets=2)
    chunks = spark.createDataFrame([("P1-1", "dock in wheat", "P1", 0), ("P1-2", "nothing", "P1", 1), ("P9-1", "burr", "P9", 0)], "chunk_id string, text string, product_number string, sequence_order int")
    docs = spark.createDataFrame([("P1", "a.pdf", 1), ("P9", "b.pdf", 1)], "product_number string, source string, seq int")
    S.load_chunk_batch(store, chunks, docs, buckets=2)
    S.load_chunk_batch(store, chunks.withColumn("text", F.lit("burr")), docs, buckets=2)
    g = S.open_graph(store)
    assert [r.product_number for r in g.has_label.collect()] == ["P1"] and g.next.count() == 1 and g.chunk.count() == 3
    assert {("P1-1", "dock"), ("P1-1", "burr"), ("P1-1", "wheat")} <= {(r.chunk_id, r.entity) for r in g.mentions.collect()}  # mentions are only added
    assert store.clear() is False and store.names() != [] and store.clear(confirm=True) and store.names() == []
    assert S.open_graph(store).herbicide is None
