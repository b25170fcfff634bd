"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, with A-Z lower-cased.  Documents come in batches.
Each batch gives the 128-bit hashes of its keys with the number of its documents that hold each; it is merge-anti-joined
with the runs, which takes out keys already settled there (found in ``min_docs`` documents), and what is left becomes a
run of level 0.  A level that holds ``fanout`` runs is compacted into one run of the next level.  A run is a table
bucketed and sorted by hash in the shared folder, so that joining and compacting runs moves none of them.

A null or empty text is one empty line; empty keys are never dropped.  A key counts once for each row that holds it,
so equal rows count each, and repeated or null ids are rows like others.  An empty table gives an empty result.  Other
columns, whatever their names, are passed by or kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import shared
from tillage.llm import words as W
from tillage.llm.words import sha256

MIN_DOCS = 10
BATCHES = 2
FANOUT = 2
WHITE = b" \t\n\r\x0b\x0c"
EMPTY = b"\0" * 16


def line_hashes(text: bytes) -> list[bytes]:
    """The 128-bit hash of each line's key; EMPTY for an empty key."""
    from xxhash import xxh3_128_digest

    return [xxh3_128_digest(key) if (key := line.strip(WHITE).lower()) else EMPTY for line in text.split(b"\n")]


def _halves(hashes: list[bytes]) -> list[pa.Array]:
    pairs = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
    return [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]


def keys(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """h1, h2 of each distinct key of each row, beside the columns ``keep``."""
    narrow = docs.select(*keep, F.col(text).alias("text"))
    fields = [f for f in narrow.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            rows: list[int] = []
            found: list[bytes] = []
            for row, value in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                own = set(line_hashes(value)) - {EMPTY}
                rows.extend([row] * len(own))
                found.extend(own)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(at) for f in fields), *_halves(found)], names=[*(f.name for f in fields), "h1", "h2"])

    return narrow.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "h1 long", "h2 long"]))


class LineRuns:
    """Runs (h1, h2, n_docs) by level, newest last."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, buckets: int | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[DataFrame, str]]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        paths: list[str] = []
        table = shared.bucketed(run, "line_run", "h1", "h2", sort=True, buckets=self.buckets, paths=paths)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((table, *paths))
        if len(self.levels[level]) >= self.fanout:
            self.compact(level)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run, _ in level]

    def drop(self) -> None:
        """Delete all runs."""
        shared.delete(self.spark, [path for level in self.levels for _, path in level])
        self.levels = []

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        merged = runs[0]
        for run in runs[1:]:
            pair = merged.withColumnRenamed("n_docs", "a").join(run.withColumnRenamed("n_docs", "b"), ["h1", "h2"], "full_outer")
            merged = pair.select("h1", "h2", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n_docs"))
        return merged

    def compact(self, level: int) -> None:
        """All runs of a level become one run of the next."""
        old = self.levels[level]
        merged = self._merged([run for run, _ in old])
        self.levels[level] = []
        self._write(merged, level + 1)
        shared.delete(self.spark, [path for _, path in old])

    def add(self, batch: DataFrame) -> None:
        """Add the keys (h1, h2, a row for each document that holds one) of a batch."""
        fresh = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
        for run in self.runs():
            fresh = fresh.join(run.where(F.col("n_docs") >= self.min_docs), ["h1", "h2"], "left_anti")
        self._write(fresh, 0)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` (with h1, h2) whose keys are in no run."""
        for run in self.runs():
            batch = batch.join(run, ["h1", "h2"], "left_anti")
        return batch

    def frequent(self) -> DataFrame:
        """h1, h2 of the keys found in ``min_docs`` documents so far, as a table of their own: Spark knows its size when it
        joins lines with it, and can deal the occurrences of a very common line to several tasks."""
        runs = self.runs()
        found = self._merged(runs).where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
        return shared.save(found, "frequent-lines", sum(run.count() for run in runs))


def build_runs(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES) -> LineRuns:
    """Runs over all rows, taken in as many batches dealt by a hash of the text."""
    runs = LineRuns(docs.sparkSession, min_docs)
    dealt = docs.select(F.col(text).alias("text"))
    for i in range(batches):
        runs.add(keys(dealt.where(F.pmod(F.xxhash64("text"), F.lit(batches)) == i), "text"))
    return runs


def drop_lines(docs: DataFrame, frequent: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the lines whose keys are ``frequent``, with their own columns and n_lines, n_dropped.

    The keys of a text that are frequent reach it by a join on the text's 128-bit hash: equal texts lose equal lines,
    and no row id is needed.
    """
    names = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text), F.col(text).alias("text"))
    own = own.select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    hits = keys(own, "text", "t1", "t2").join(frequent, ["h1", "h2"], "left_semi")
    hits = hits.groupBy("t1", "t2").agg(F.collect_set(F.struct("h1", "h2")).alias("hits")).select("t1", "t2", F.col("hits.h1").alias("a"), F.col("hits.h2").alias("b"))
    hits = shared.save(hits, "line-hits")  # else the copies of one text would all meet in one task of the join
    joined = own.join(hits, ["t1", "t2"], "left").drop("t1", "t2")
    fields = [f for f in joined.schema if f.name not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            texts, lines, dropped = [], [], []
            for value, a, b in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                n = value.count(b"\n") + 1
                lines.append(n)
                if a:
                    gone = {np.array(pair, "<i8").tobytes() for pair in zip(a, b)}
                    kept = [line for line, h in zip(value.split(b"\n"), line_hashes(value)) if h not in gone]
                    dropped.append(n - len(kept))
                    value = b"\n".join(kept)
                else:
                    dropped.append(0)
                texts.append(value)
            out = pa.array(texts, pa.binary()).cast(pa.string())
            rest = [batch.column(f.name) for f in fields if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, out, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*(f.name for f in fields if f.name != "text"), "text", "n_lines", "n_dropped"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields if f.name != "text"), "text string", "n_lines long", "n_dropped long"])
    done = joined.mapInArrow(run, schema)
    kept = [F.col("text" if c == text else f"c{i}").alias(c) for i, c in enumerate(names) if c not in ("n_lines", "n_dropped")]
    return done.select(*kept, "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` without lines found in at least ``min_docs`` rows; a column called n_lines or n_dropped is replaced."""
    runs = build_runs(docs, text, min_docs, batches)
    frequent = runs.frequent()
    runs.drop()
    return drop_lines(docs, frequent, text)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), bad AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(bad.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (bad.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN bad ON l.k = bad.k GROUP BY doc_id
"""
