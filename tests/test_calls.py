"""Outside calls that fail, hang and throttle, and label files as a stream that is killed and goes on."""

import json
import os
import sys
import time
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tillage.operators import graph_store as S
from tillage.sources import calls as C
from tillage.sources.store import Store
from tillage.streaming import labels as L

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import tests


def caller(folder):
    """ok, a bad input, one that comes right at the third attempt, one that hangs, one that throttles once."""

    class ServiceUnavailable(Exception):
        pass

    class ResourceExhausted(Exception):
        retry_after = 0.3

    def made(text):
        with open(f"{folder}/{text}-{uuid.uuid4().hex}", "w") as f:
            f.write(str(time.time()))
        tries = sum(x.startswith(f"{text}-") for x in os.listdir(folder))
        kind = text.rstrip("0123456789")
        if kind == "bad":
            raise ValueError("no such thing")
        if kind == "flaky" and tries < 3:
            raise ServiceUnavailable("busy")
        if kind == "down":
            raise ConnectionResetError("gone")
        if kind == "hang":
            time.sleep(60)
        if kind == "throttle" and tries == 1:
            raise ResourceExhausted("slow down")
        return text.upper()

    return made


FAST = C.Limits(timeout=1.0, attempts=3, first_wait=0.01, least_wait=0.01, most_wait=0.05, tasks=2, at_once=3)


def test_every_input_has_one_outcome(spark, tmp_path):
    folder = str(tmp_path)
    texts = [f"{k}{i}" for k in ("ok", "bad", "flaky", "down", "hang", "throttle") for i in range(3)]
    df = spark.createDataFrame([(t, t, t == "ok2") for t in [*texts, "ok0"]] + [("null", None, False)], "id string, text string, short boolean")
    got = {r.key: r for r in C.call_each(df, "id", "text", lambda: caller(folder), FAST, F.col("short")).collect()}
    assert len(got) == len(texts) + 1
    assert [(got[f"{k}1"].status, got[f"{k}1"].output, got[f"{k}1"].attempts) for k in ("ok", "bad", "flaky", "down", "hang", "throttle")] == [
        ("ok", "OK1", 1), ("failed", None, 1), ("ok", "FLAKY1", 3), ("failed", None, 3), ("timeout", None, 1), ("ok", "THROTTLE1", 2)]
    assert got["bad0"].error == "ValueError: no such thing" and got["throttle0"].seconds >= 0.3 and got["null"].output == ""
    assert (got["ok2"].status, got["ok2"].attempts) == ("skipped", 0) and not any(f.startswith("ok2-") for f in os.listdir(folder))
    assert C.call_each(df.limit(0), "id", "text", lambda: caller(folder), FAST).collect() == []


def test_waits_double_between_bounds():
    limits = C.Limits()
    assert [limits.wait(n, ValueError()) for n in (1, 2, 3, 5, 9)] == [4, 4, 8, 32, 60]


def test_the_rate_is_shared_out(spark, tmp_path):
    df = spark.range(24).select(F.concat(F.lit("ok"), "id").alias("t"))
    C.call_each(df, "t", "t", lambda: caller(str(tmp_path)), C.Limits(rate=12, tasks=3, at_once=8)).collect()
    times = sorted(float(open(tmp_path / f).read()) for f in os.listdir(tmp_path))
    assert len(times) == 24 and all(sum(t <= x < t + 0.95 for x in times) <= 12 + 3 for t in times)


def test_a_killed_run_goes_on_behind_its_last_wave(spark, tmp_path, monkeypatch):
    folder, path = str(tmp_path / "calls"), str(tmp_path / "outcomes")
    os.makedirs(folder)
    df = spark.createDataFrame([(f"{k}{i}",) for k in ("ok", "bad") for i in range(20)], "t string")
    waves = []
    plain = C.call_each

    def killed(*args):
        waves.append(1)
        if len(waves) == 3:
            raise RuntimeError("killed")
        return plain(*args)

    monkeypatch.setattr(C, "call_each", killed)
    with pytest.raises(RuntimeError):
        C.run(df, "t", "t", lambda: caller(folder), path, FAST, wave=10)
    monkeypatch.undo()
    asked = len(os.listdir(folder))
    assert 0 < asked < 40
    found = C.run(df, "t", "t", lambda: caller(folder), path, FAST, wave=10)
    assert found.groupBy("status").count().orderBy("status").collect() == [("failed", 20), ("ok", 20)] and found.count() == 40
    assert len(os.listdir(folder)) == 40  # nothing was asked for twice
    assert C.run(df, "t", "t", lambda: caller(folder), path, FAST).count() == 40 and len(os.listdir(folder)) == 40
    C.run(df, "t", "t", lambda: caller(folder), path, FAST, again=True)
    assert len(os.listdir(folder)) == 60


def label(product, weed, group="A"):
    return {"product_number": product, "product_name": f"name {product}", "active_constituent": "x", "mode_of_action_group": group, "registered_crops": ["wheat"], "registered_weeds": [weed], "weed_control_entries": [{"crop": "wheat", "weed_common_name": weed}], "application_methods": [], "state_restrictions": []}


def test_label_files_as_a_stream(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    os.makedirs(folder)
    for i in range(5):
        (folder / f"{i}.json").write_text("{broken" if i == 3 else json.dumps(label(f"P{i}", f"weed {i}")))
    (folder / "_summary.json").write_text("{}")
    store = S.init_schema(spark, str(tmp_path / "g"), buckets=2)
    commit, done = Store._commit, []

    def killed(self, *args):
        number = commit(self, *args)
        done.append(number)
        if len(done) == 2:
            raise RuntimeError("killed behind the swap, before the stream knows")
        return number

    monkeypatch.setattr(Store, "_commit", killed)
    with pytest.raises(Exception):  # noqa: B017
        L.load_available(spark, str(folder), store, str(tmp_path / "checkpoint"), files=2, buckets=2)
    monkeypatch.undo()
    ledger = L.load_available(spark, str(folder), store, str(tmp_path / "checkpoint"), files=2, buckets=2)
    rows = {r.file: r for r in ledger.collect()}
    assert sorted(rows) == [f"{i}.json" for i in range(5)] and sum(r.controls for r in rows.values()) == 4
    assert rows["3.json"].status == "failed" and "broken" in rows["3.json"].error
    g = S.open_graph(store)
    assert g.herbicide.count() == 4 and g.controls.count() == 4 and g.weed.count() == 4
    (folder / "6.json").write_text(json.dumps(label("P0", "weed 0", "B")))
    before = len(store.numbers())
    L.load_available(spark, str(folder), store, str(tmp_path / "checkpoint"), buckets=2)
    assert {tuple(r) for r in S.open_graph(store).has_mode_of_action.where("product_number = 'P0'").collect()} == {("P0", "A"), ("P0", "B")}
    L.load_available(spark, str(folder), store, str(tmp_path / "lost"), buckets=2)  # without its checkpoint it reads all files, and loads the bad one again only
    assert len(store.numbers()) == before + 2 and store.read("ledger").count() == 6
