"""Alerts that hold for a time: the state machine, a table of windows, and a stream with late and missing windows."""

import datetime as dt
import os
import random

from tillage.streaming import held as H

T0 = dt.datetime(2024, 1, 1)


def brute(high, hold, width):
    """Runs of consecutive high windows that are long enough."""
    out, starts = [], sorted(high)
    while starts:
        first = last = starts.pop(0)
        while starts and starts[0] == last + width:
            last = starts.pop(0)
        if last + width - first >= hold:
            out.append((first, first + hold, last + width))
    return out


def fired(found):
    """pending, firing and resolved of each alert that fired."""
    out, since, at = [], None, None
    for state, when in found:
        since, at = (when, None) if state == "pending" else (since, at)
        at = when if state == "firing" else at
        if state == "resolved" and at is not None:
            out.append((since, at, when))
    return out


def test_the_state_machine_in_any_pieces():
    rng = random.Random(3)
    for _ in range(200):
        windows = [(60 * i, rng.random() < 0.6) for i in range(40) if rng.random() < 0.85]
        state, found, at = None, [], 0
        while at < len(windows):
            n = rng.randrange(1, 6)
            state, new = H.transitions(state, windows[at : at + n], 180, 60)
            found, at = found + new, at + n
        found += [("resolved", state[1])] if state else []
        assert fired(found) == brute([s for s, h in windows if h], 180, 60)


def events(rng, minutes):
    """A request a second or so; half of them bad in high windows; no request in missing ones."""
    kind = {w: rng.choice(["high", "high", "low", "none"]) for w in range(minutes // 5)}
    return [("a", T0 + dt.timedelta(minutes=5 * w, seconds=20 * i), kind[w] == "high" and i % 2 == 0) for w in kind if kind[w] != "none" for i in range(10)]


def test_stream_equals_table(spark, tmp_path):
    rows = events(random.Random(1), 400)
    schema = "name string, ts timestamp, bad boolean"
    df = spark.createDataFrame(rows, schema)
    want = [tuple(r)[1:] for r in H.held_alerts(H.window_shares(df, "name", df["bad"]), 0.1, 600, 300).orderBy("pending_at").collect()]
    high = {int(t.timestamp()) // 300 * 300 for _, t, bad in [(n, t.replace(tzinfo=dt.timezone.utc), b) for n, t, b in rows] if bad}
    assert want == brute(high, 600, 300) and len(want) > 5
    later = [("z", T0 + dt.timedelta(days=d), False) for d in (2, 3)]  # moves the watermark behind all windows
    for i in range(4):  # files in order of time, but within a file and with some rows in the file behind
        own = [r for j, r in enumerate(rows) if (j + (10 if j % 7 == 0 else 0)) * 4 // (len(rows) + 11) == i]
        random.Random(i).shuffle(own)
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(str(tmp_path / "made" / str(i)))
    for i, r in enumerate(later):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / "made" / str(4 + i)))
    (tmp_path / "in").mkdir()
    for i in range(6):
        part = next((tmp_path / "made" / str(i)).glob("part-*"))
        part.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")
    out = H.alert_stream(H.window_shares(stream, "name", stream["bad"]), 0.1, 600, 300)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [(r.state, r.at) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()]
    order = {"firing": 0, "resolved": 1, "pending": 2}
    assert fired(sorted(got, key=lambda x: (x[1], order[x[0]]))) == want
