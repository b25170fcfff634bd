"""Calls of an outside service for each row: time-outs, retries with back-off, a shared rate, outcomes as rows.

The caller is any function of a text, made once a task.  A task runs a few calls at a time and gets an equal share of the
rate, so that all tasks together stay below it, however many of them run.  A call that fails for good, or hangs, becomes
a row with its error; it fails no task.  ``run`` works in waves whose outcomes are appended to a table, and asks only for
keys that the table doesn't have: a run that was killed goes on behind its last whole wave.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOME = "status string, output string, error string, attempts int, seconds double"
Caller = Callable[[str], str]


@dataclass(frozen=True)
class Limits:
    """``timeout`` seconds for a call; ``attempts`` at most, with waits that double from ``first_wait``, not below
    ``least_wait`` nor above ``most_wait`` (a longer ``retry_after`` of the error counts); names of the errors worth another attempt;
    ``rate``: calls a second of all ``tasks`` together; calls that a task runs ``at_once``."""

    timeout: float = 90.0
    attempts: int = 5
    first_wait: float = 2.0
    least_wait: float = 4.0
    most_wait: float = 60.0
    retry_on: tuple[str, ...] = ("ResourceExhausted", "ServiceUnavailable", "InternalServerError", "ConnectionError")
    rate: float | None = None
    at_once: int = 4
    tasks: int = 8

    def wait(self, attempt: int, error: Exception) -> float:
        """Seconds between an attempt (from 1) and the next one."""
        return max(self.least_wait, min(self.most_wait, self.first_wait * 2 ** (attempt - 1)), float(getattr(error, "retry_after", 0) or 0))


class Gate:
    """Lets calls through at a rate."""

    def __init__(self, rate: float | None) -> None:
        self.step, self.next, self.lock = 1 / rate if rate else 0.0, 0.0, threading.Lock()

    def enter(self) -> None:
        with self.lock:
            at = max(time.monotonic(), self.next)
            self.next = at + self.step
        time.sleep(max(0.0, at - time.monotonic()))


class TimedOut(Exception):
    pass


def timed(call: Caller, text: str, seconds: float) -> str:
    """The call's result; after ``seconds`` it is given up (its thread can't be ended, and goes with the Python worker)."""
    got: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            got.put((call(text), None))
        except Exception as error:  # noqa: BLE001  becomes a row
            got.put((None, error))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, error = got.get(timeout=seconds)
    except queue.Empty:
        raise TimedOut(f"no answer within {seconds:g} seconds") from None
    if error is not None:
        raise error
    return value


def outcome(call: Caller, text: str | None, limits: Limits, gate: Gate) -> tuple:
    """status, output, error, attempts, seconds of one row."""
    began = time.monotonic()
    attempt = 0
    while True:
        attempt += 1
        gate.enter()
        try:
            return "ok", timed(call, text or "", limits.timeout), None, attempt, time.monotonic() - began
        except TimedOut as error:
            return "timeout", None, str(error), attempt, time.monotonic() - began
        except Exception as error:  # noqa: BLE001
            if attempt >= limits.attempts or not any(k.__name__ in limits.retry_on for k in type(error).__mro__):
                return "failed", None, f"{type(error).__name__}: {error}", attempt, time.monotonic() - began
            time.sleep(limits.wait(attempt, error))


def outcomes(rows: Iterator[tuple], call: Caller, limits: Limits, gate: Gate) -> Iterator[tuple]:
    """(key, *outcome) for each (key, text), as calls end; no more than ``at_once`` rows are held."""
    ended: queue.SimpleQueue = queue.SimpleQueue()
    running = 0
    for key, text in rows:
        if running >= limits.at_once:
            yield ended.get()
            running -= 1
        threading.Thread(target=lambda k=key, t=text: ended.put((k, *outcome(call, t, limits, gate))), daemon=True).start()
        running += 1
    for _ in range(running):
        yield ended.get()


def call_each(inputs: DataFrame, key: str, text: str, make: Callable[[], Caller], limits: Limits = Limits(), skip: Column | None = None) -> DataFrame:
    """key, status (ok, failed, timeout, skipped), output, error, attempts, seconds: one row for each distinct key.

    ``skip``: rows for which this holds are not asked for.  Of rows that repeat a key the one with the least text counts.
    """
    once = inputs.groupBy(F.col(key).alias("key")).agg(F.min(F.struct(F.col(text).alias("text"), (skip if skip is not None else F.lit(False)).alias("skip"))).alias("r"))
    rows = once.select("key", "r.text", F.coalesce("r.skip", F.lit(False)).alias("skip"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, gate = make(), Gate(limits.rate / limits.tasks if limits.rate else None)
        for batch in batches:
            asked = ((k, t) for k, t in zip(batch["key"], batch["text"]))
            yield pd.DataFrame(list(outcomes(asked, call, limits, gate)), columns=["key", "status", "output", "error", "attempts", "seconds"])

    asked = rows.where("NOT skip").select("key", "text").repartition(limits.tasks, "key").mapInPandas(run, f"key {kind}, {OUTCOME}")
    left = rows.where("skip").select("key", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("output"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"), F.lit(0.0).alias("seconds"))
    return asked.unionByName(left)


def run(inputs: DataFrame, key: str, text: str, make: Callable[[], Caller], path: str, limits: Limits = Limits(), skip: Column | None = None, wave: int = 10_000, again: bool = False) -> DataFrame:
    """Ask for all keys that the table at ``path`` lacks, in waves of about ``wave`` rows, and return the table's last
    outcome of each key.  ``again``: keys that failed or timed out are asked for once more."""
    spark = inputs.sparkSession
    kind = inputs.schema[key].dataType.simpleString()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def known() -> DataFrame:
        schema = f"key {kind}, {OUTCOME}, wave long"
        return spark.read.schema(schema).parquet(path) if fs.exists(at) else spark.createDataFrame([], schema)

    def last(rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c != "key"]
        return rows.groupBy("key").agg(F.max_by(F.struct(*names), "wave").alias("r")).select("key", "r.*")

    done = last(known())
    done = done.where("status IN ('ok', 'skipped')") if again else done
    open_keys = inputs.select(F.col(key).alias("key")).distinct().join(done.select("key"), "key", "left_anti")
    waves = max(1, -(-open_keys.count() // wave))
    first = (known().agg(F.max("wave")).first()[0] or 0) + 1
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(waves))
    before = done.select(F.col("key").alias(key))
    for i in range(waves):
        own = inputs.where(part == i).join(before, key, "left_anti")
        call_each(own, key, text, make, limits, skip).withColumn("wave", F.lit(first + i).cast("long")).write.mode("append").parquet(path)
    return last(known()).drop("wave")
