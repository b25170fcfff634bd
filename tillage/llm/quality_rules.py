"""Host-level quality rules.

Every text gets counts and the rules it fails.  The failures are summed by host; a beta prior fitted to all
hosts by beta-binomial moments shrinks each host's failure rates; a host whose shrunk rate of any rule passes
``max_rate`` is rejected, and the verdict is joined back to its documents.

Null text: a text without words.  Null host: a host of its own, like any other.  Equal rows are judged alike and
all returned.  An empty table gives an empty result.  Other columns of the input, whatever their names, are passed by
(judge) or kept (filter_documents).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import shared
from tillage.llm import words as W

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Rule: the condition on the counts under which a document fails it.
RULES = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "n_dup_lines > 30",
}
BASE = ("few_words", "repeats")
MAX_RATE = 0.5
#: Documents that the prior weighs as at least and at most: a host is never judged on its first few documents alone.
LEAST_WEIGHT, MOST_WEIGHT = 10.0, 1000.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(text: bytes, hashes: np.ndarray) -> int:
    """Words in windows of five that occur twice or more in the text."""
    if len(hashes) < WINDOW + 1:
        return 0
    _, inverse, counts = np.unique(W.shingles(hashes, WINDOW), return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    at, split = np.flatnonzero(again), text.split()
    places: dict[tuple, list[int]] = {}
    for i in at.tolist():  # only these few; the words decide, not their hashes
        places.setdefault(tuple(split[i : i + WINDOW]), []).append(i)
    starts = np.zeros(len(hashes) + 1, np.int64)
    for same in places.values():
        if len(same) > 1:
            starts[same] += 1
            starts[np.add(same, WINDOW)] -= 1
    return int((np.cumsum(starts)[:-1] > 0).sum())


def dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _count(text: str, keep_text: bool):
    """Rows with their counts, with or without their text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, text):
            texts = batch.column(text)
            found = W.words(texts)
            out = {k: np.zeros(len(texts), np.int64) for k in COUNTS}
            out["n_words"] = np.diff(found.bounds)
            for i, value in enumerate(texts.cast(pa.large_binary()).to_pylist()):
                solid = value.translate(None, b" \t\n\r\x0b\x0c")
                out["word_chars"][i] = len(solid.decode())
                out["n_symbols"][i] = len(solid) - len(solid.translate(None, SYMBOLS))
                out["n_dup_lines"][i] = dup_lines(value)
                out["n_repeat_words"][i] = repeat_words(value, found.hashes[found.bounds[i] : found.bounds[i + 1]])
            names = [k for k in batch.schema.names if keep_text or k != text]
            rest = [batch.column(k).cast(pa.string()) if k == text else batch.column(k) for k in names]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(out[k]) for k in COUNTS)], names=[*names, *COUNTS])

    return count


def _counted(rows: DataFrame, text: str, keep_text: bool = False) -> DataFrame:
    """``rows`` with the five counts; a null text is kept as an empty one."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep_text or f.name != text]
    return rows.mapInArrow(_count(text, keep_text), ", ".join([*fields, *(f"{k} long" for k in COUNTS)]))


def counts(docs: DataFrame, text: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """The five counts of each text beside the columns named in ``keep`` (output name: input name)."""
    keep = keep or {"doc_id": "doc_id"}
    return _counted(docs.select(*(F.col(v).alias(k) for k, v in keep.items()), F.col(text).alias("text")), "text")


def prior_weight(docs: float, squares: float, hosts: float, failed: float, spread: float) -> float:
    """How many documents a rule's prior weighs as, from sums over hosts: documents, their squares, 1, failures, and
    failures squared by documents.

    The hosts' rates, each weighted by its documents, spread by more than binomial sampling explains if hosts differ; that
    excess over what it would be were each host all good or all bad is the correlation within hosts, 1 / (weight + 1).
    Hosts of one document say nothing about it.
    """
    if not docs:
        return MOST_WEIGHT
    mean = failed / docs
    between = spread - failed * mean
    chance = mean * (1 - mean)
    room = chance * (docs - squares / docs - (hosts - 1))
    alike = (between - chance * (hosts - 1)) / room if room > 1e-9 * docs else 0.0
    return max(LEAST_WEIGHT, min(MOST_WEIGHT, 1 / alike - 1)) if alike > 0 else MOST_WEIGHT


def host_verdicts(counted: DataFrame, host: str, rules: dict[str, str] = RULES, max_rate: float = MAX_RATE) -> tuple[DataFrame, int]:
    """A row for each host: documents, failures and shrunk rate of each rule, and whether the host is accepted; and the
    number of hosts.

    The prior of a rule is Beta(m * k, (1 - m) * k), where m is the share of all documents that fail it and k is
    prior_weight().  Only the sums over hosts, a few numbers, go to the driver.
    """
    hosts = counted.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *(F.count_if(F.expr(rule)).alias(f"failed_{k}") for k, rule in rules.items())
    )
    hosts = shared.save(hosts, "hosts")  # documents can then join them in parts, if a host has very many
    n = F.col("n_docs").cast("double")
    of_rule = lambda k: (F.sum(f"failed_{k}").alias(f"failed_{k}"), F.sum(F.col(f"failed_{k}") * F.col(f"failed_{k}") / n).alias(f"spread_{k}"))
    sums = hosts.agg(F.count(F.lit(1)).alias("n_hosts"), F.sum(n).alias("docs"), F.sum(n * n).alias("squares"), *(c for k in rules for c in of_rule(k))).first()
    for k in rules:
        mean = (sums[f"failed_{k}"] or 0) / (sums["docs"] or 1)
        weight = prior_weight(sums["docs"] or 0, sums["squares"] or 0, sums["n_hosts"], sums[f"failed_{k}"] or 0, sums[f"spread_{k}"] or 0)
        hosts = hosts.withColumn(f"rate_{k}", (F.col(f"failed_{k}") + mean * weight) / (F.col("n_docs") + weight))
    return hosts.withColumn("host_ok", ~F.greatest(*(F.col(f"rate_{k}") > max_rate for k in rules))), sums["n_hosts"]


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """A row for each document: counts, base_failed, its host's shrunk rates, and kept.

    The counts are written once to the shared folder, as both the hosts and the documents need them.
    """
    counted = shared.save(counts(docs, text, {"doc_id": id_col, "host": host}), "rule-counts")
    hosts = host_verdicts(counted, "host", max_rate=max_rate)[0].select(F.col("host").alias("of_host"), "host_ok", *(f"rate_{k}" for k in RULES))
    failed = F.expr(" OR ".join(f"({RULES[k]})" for k in BASE))
    joined = counted.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    return joined.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & F.col("host_ok")).alias("kept"), *(f"rate_{k}" for k in RULES)
    )


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows whose text passes the base rules and whose host is accepted, with their own columns, whatever their names.

    Texts are counted once, and written with their counts: the hosts' sums then read the counts alone.  The rejected
    hosts are written too, so that Spark knows their size when it chooses between sending them out and moving the rows.
    """
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    counted = shared.save(_counted(docs.toDF(*at.values()), at[text], True), "rule-counts")
    hosts, n_hosts = host_verdicts(counted, at[host], max_rate=max_rate)
    rejected = shared.save(hosts.where("NOT host_ok").select("host"), "rejected-hosts", n_hosts)
    failed = F.expr(" OR ".join(f"({RULES[k]})" for k in BASE))
    out = counted.where(~failed).join(rejected, F.col(at[host]).eqNullSafe(F.col("host")), "left_anti")
    return out.select(*(F.col(at[c]).alias(c) for c in names))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(shared.read(spark, sf_dir, "documents"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, w, i, list_slice(w, i, i + 4) AS five FROM d, unnest(range(1, len(w) - 3)) AS u(i)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM again, unnest(range(0, 5)) AS u(j) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), s AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (n_words < 10) AS f1, count(*) FILTER (100 * n_repeat_words > 20 * n_words) AS f2,
    count(*) FILTER (10 * n_symbols > word_chars) AS f3, count(*) FILTER (n_dup_lines > 30) AS f4 FROM s GROUP BY source
), r AS (SELECT source, n, u.k, u.f FROM h, unnest([{'k': 1, 'f': f1}, {'k': 2, 'f': f2}, {'k': 3, 'f': f3}, {'k': 4, 'f': f4}]) AS v(u)
), m AS (SELECT k, sum(n)::DOUBLE AS docs, sum(n * n)::DOUBLE AS sq, count(*) AS hosts, sum(f) / sum(n) AS mean, sum(f * f / n) AS spread FROM r GROUP BY k
), x AS (SELECT k, mean, spread - mean * mean * docs - mean * (1 - mean) * (hosts - 1) AS excess, mean * (1 - mean) * (docs - sq / docs - (hosts - 1)) AS room, docs FROM m
), p AS (SELECT k, mean, CASE WHEN room > 1e-9 * docs AND excess / room > 0 THEN greatest(10.0, least(1000.0, room / excess - 1)) ELSE 1000.0 END AS weight FROM x
), rates AS (SELECT source, k, (f + mean * weight) / (n + weight) AS rate FROM r JOIN p USING (k)
), verdict AS (
  SELECT source, max(rate) FILTER (k = 1) AS rate_few_words, max(rate) FILTER (k = 2) AS rate_repeats,
    max(rate) FILTER (k = 3) AS rate_symbols, max(rate) FILTER (k = 4) AS rate_dup_lines FROM rates GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT greatest(rate_few_words, rate_repeats, rate_symbols, rate_dup_lines) > 0.5 AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s) JOIN verdict USING (source)
"""
