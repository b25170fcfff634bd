"""Fill-in-the-middle over a compressed set of the places where a text's units begin.

The begins of all units (code points, or what a pattern matches) are byte offsets of the UTF-8 text.  They are kept as
containers of 65,536 offsets each: a sorted array, a bitmap or a list of runs, whichever is smallest, beside the
cumulative cardinalities of the containers.  To cut after n units is to select the n-th begin: a binary search over the
cardinalities finds the container, a select within it the offset.  Nothing walks over the text for a cut.

Null text: empty, and so plain.  Null id: hashed as an empty number.  A row is judged on its own, so repeated rows get
equal results.  A text with a sentinel in it stays plain, which is what makes the output reversible.  Long texts are
taken whole; a text of one gigabyte takes 15,000 containers, of which an ASCII one is a single run.  An empty table gives
an empty result.  Other columns are passed by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import shared
from tillage.llm import words as W

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SPAN = 1 << 16
#: Percent of texts that are transformed, and of these in the order suffix, prefix, middle.
TRANSFORMED, SUFFIX_FIRST = 90, 20


@dataclass
class Array:
    """Sorted offsets, two bytes each."""

    low: np.ndarray

    def select(self, n: int) -> int:
        return int(self.low[n])


@dataclass
class Bitmap:
    """65,536 bits, with how many are set before each 64 bytes."""

    bits: np.ndarray
    before: np.ndarray

    def select(self, n: int) -> int:
        at = int(np.searchsorted(self.before, n, "right")) - 1
        ones = np.flatnonzero(np.unpackbits(self.bits[at * 64 : at * 64 + 64], bitorder="little"))
        return at * 512 + int(ones[n - int(self.before[at])])


@dataclass
class Runs:
    """First offset of each run, and how many offsets lie in the runs before it."""

    first: np.ndarray
    before: np.ndarray

    def select(self, n: int) -> int:
        at = int(np.searchsorted(self.before, n, "right")) - 1
        return int(self.first[at]) + n - int(self.before[at])


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest form of a container's offsets (of which there is at least one)."""
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    if 2 + 4 * (len(breaks) + 1) < min(2 * len(low), SPAN // 8):
        begins = np.concatenate([[0], breaks])
        return Runs(low[begins].astype(np.uint16), begins.astype(np.uint16))
    if 2 * len(low) <= SPAN // 8:
        return Array(low.astype(np.uint16))
    member = np.zeros(SPAN, np.uint8)
    member[low] = 1
    ones = member.reshape(-1, 512).sum(1, dtype=np.int64)
    return Bitmap(np.packbits(member, bitorder="little"), (np.cumsum(ones) - ones).astype(np.uint16))


class Boundaries:
    """The begins of a text's units; ``cumulative[i]``: how many lie in the containers up to the i-th."""

    def __init__(self, containers: list, keys: np.ndarray, cumulative: np.ndarray, end: int) -> None:
        self.containers, self.keys, self.cumulative, self.end = containers, keys, cumulative, end

    @classmethod
    def of(cls, begins: np.ndarray, end: int) -> Boundaries:
        high = begins >> 16
        firsts = np.flatnonzero(np.diff(high, prepend=-1))
        edges = np.append(firsts, len(begins))
        parts = [container(begins[a:b] & (SPAN - 1)) for a, b in zip(edges, edges[1:])]
        return cls(parts, high[firsts], edges[1:], end)

    @classmethod
    def dense(cls, end: int) -> Boundaries:
        """Every offset begins a unit: one run for each container."""
        keys = np.arange(-(-end // SPAN))
        return cls([Runs(np.zeros(1, np.uint16), np.zeros(1, np.uint16))] * len(keys), keys, np.minimum((keys + 1) * SPAN, end), end)

    @classmethod
    def of_text(cls, text: bytes, unit: re.Pattern[bytes] | None = None) -> Boundaries:
        """Of code points, or of the matches of ``unit`` from left to right (bytes between matches go with the unit before)."""
        if unit is not None:
            return cls.of(np.fromiter((m.start() for m in unit.finditer(text) if m.end() > m.start()), np.int64), len(text))
        if text.isascii():
            return cls.dense(len(text))
        return cls.of(np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80), len(text))

    def __len__(self) -> int:
        return int(self.cumulative[-1]) if len(self.cumulative) else 0

    def cut(self, n: int) -> int:
        """The byte offset after the first n units."""
        if n >= len(self):
            return self.end
        if n == 0:
            return 0
        at = int(np.searchsorted(self.cumulative, n, "right"))
        before = int(self.cumulative[at - 1]) if at else 0
        return (int(self.keys[at]) << 16) + self.containers[at].select(n - before)


def draws(doc_id: int | None, seed: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(text: bytes, doc_id: int | None, seed: str = "1", unit: re.Pattern[bytes] | None = None, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, units of prefix and middle, and output of one text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    begins = Boundaries.of_text(text, unit)
    n = len(begins)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= transformed:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    at, end = begins.cut(low), begins.cut(high)
    prefix, middle, suffix = text[:at], text[at:end], text[end:]
    if h4 % 100 < suffix_first:
        return n, "spm", low, high - low, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", low, high - low, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: str = "1", unit: str | None = None, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (units; null if plain) and output of each row.

    ``unit``: a regular expression over UTF-8 bytes; by default units are code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit.encode()) if unit else None
        for batch in W.slices(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.large_binary())
            rows = [transform(t.as_py(), i, seed, pattern, transformed, suffix_first) for i, t in zip(ids, texts)]
            n, form, low, middle, out = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(low, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again: its parts hold no sentinel, so that the sentinels are where the output was put together."""
    parts = F.split(output, "|".join(x.decode() for x in (PREFIX, SUFFIX, MIDDLE)))
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(shared.read(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), c AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c
), p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
