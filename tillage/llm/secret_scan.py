"""Secrets: patterns of known kinds, and strings in a sensitive context that a primed compressor finds new.

Names and words of the corpus are counted over all documents; the most frequent ones prime a zstandard compressor as a
dictionary, which every task gets.  A candidate is a long enough string of mixed characters shortly behind a sensitive
word ("token", "key", ...) in its line.  What it costs is what it adds: the compressed size of its surroundings with it less that of
its surroundings alone (without other occurrences of the same string, which would hide it).  A name, a path or a
phrase of known words costs a few bits a character; a secret can't be compressed and is reported as ``novel``, with its
cost.  A candidate that overlaps a pattern's match isn't reported again.

The dictionary holds pieces of lower-case letters, so that little of a secret can get into it, however often a document
was copied.  Its size is a parameter; the counts behind it cover all documents.

Null text: empty.  Equal rows are scanned alike and all returned.  Texts are taken whole, however long.  An empty
table gives an empty result, as an empty dictionary is one too.  Other columns are passed by.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import shared
from tillage.llm import words as W

# The patterns of known secrets and the least lengths of what they match, in the order of their kinds.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "novel")
# Parts of words behind which secrets stand.
SENSITIVE = ("access", "auth", "bearer", "cookie", "credential", "key", "login", "passphrase", "passw", "private", "pwd", "secret", "session", "signature", "token")

KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
SENSITIVE_WORD = re.compile("|".join(SENSITIVE).encode())
VALUE = re.compile(rb"[A-Za-z0-9+/_~-]+(?:\.[A-Za-z0-9+/_~-]+)*={0,2}")
IS_HEX = bytes(49 if chr(i) in "0123456789abcdef" else 48 for i in range(256))
PIECE = re.compile(rb"[A-Za-z]?[a-z]{3,23}")

#: Characters of a candidate at least, how far behind the sensitive word it may begin, and bytes of surroundings on each side.
LEAST_NOVEL, REACH, AROUND = 16, 48, 256
#: A candidate is new if it adds so many bytes a character.
NOVELTY = 0.75
#: Pieces in the dictionary.
DICTIONARY = 4096
#: Distinct pieces that a task holds before it hands on its counts.
HELD = 1 << 18
SPAN = "struct<kind string, start long, end long, novelty double>"


def pieces(docs: DataFrame, text: str = "text") -> DataFrame:
    """piece, n: in how many texts each piece of a name or word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p.decode() for p in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["piece", "n"])

        held: Counter = Counter()
        for batch in W.slices(batches):
            for t in batch.column("text").cast(pa.large_binary()):
                held.update(set(PIECE.findall(t.as_py())))
            if len(held) > HELD:
                yield out(held)
                held = Counter()
        yield out(held)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> bytes:
    """The most frequent pieces, the most frequent last, where the compressor reaches them with the shortest distances.

    A histogram of the counts' logarithms (some hundred numbers) says from which count on there are ``size`` pieces, so
    that only about so many rows are put in order, however many partitions there are.
    """
    paths: list[str] = []
    level = F.floor(8 * F.log2("n")).cast("int")
    counted = shared.save(pieces(docs, text).select("piece", "n", level.alias("level")), "pieces", paths=paths)
    cut, enough = -1, 0
    for r in sorted(counted.groupBy("level").count().collect(), reverse=True):
        cut, enough = r["level"], enough + r["count"]
        if enough >= size:
            break
    rows = counted.where(F.col("level") >= cut).orderBy(F.desc("n"), "piece").limit(size).collect()  # ``size`` bounds it
    shared.delete(docs.sparkSession, paths)
    return b" ".join(r["piece"].encode() for r in reversed(rows))


class Novelty:
    """What strings cost a compressor that knows the dictionary."""

    def __init__(self, known: bytes) -> None:
        primed = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(known) >= 8 else None
        if primed:
            primed.precompute_compress(level=9)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def cost(self, value: bytes, before: bytes, after: bytes) -> int:
        """Bytes that ``value`` adds to its surroundings."""
        before, after = before.replace(value, b""), after.replace(value, b"")
        return len(self.compressor.compress(before + value + after)) - len(self.compressor.compress(before + after))


def known_kinds(text: bytes, lower: bytes) -> list[tuple[int, int, int]]:
    """start, kind, end of what the patterns match; a pattern is tried where a plain search says that it may match."""
    found = []
    if any(word in lower for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"1" * LEAST_HEX in text.translate(IS_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def mixed(value: bytes) -> bool:
    """Letters and digits, or small letters and a capital that isn't the first."""
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 for c in value)
    if letters < 4:
        return False
    return any(48 <= c <= 57 for c in value) or (any(65 <= c <= 90 for c in value[1:]) and any(97 <= c <= 122 for c in value))


def candidates(text: bytes, lower: bytes) -> Iterator[tuple[int, int]]:
    """start, end of strings that may be secrets, in order."""
    done = 0
    for word in SENSITIVE_WORD.finditer(lower):
        at, last = max(word.end(), done), word.end() + REACH
        while at <= last and (m := VALUE.search(text, at)):
            at = m.end()
            if m.start() > last or b"\n" in text[word.end() : m.start()]:
                break
            if m.end() - m.start() >= LEAST_NOVEL:
                done = m.end()
                if mixed(m[0]):
                    yield m.start(), m.end()


def spans(text: bytes, novelty: Novelty, threshold: float = NOVELTY) -> list[tuple[str, int, int, float | None]]:
    """kind, start, end (code points) and cost a character (of novel strings) of all secrets of a text, in order."""
    lower = text.lower()  # of ASCII letters only, so that offsets stay
    found = [(*x, None) for x in known_kinds(text, lower)]
    taken = sorted((x[0], x[2]) for x in found)
    starts, ends = [x[0] for x in taken], np.maximum.accumulate([x[1] for x in taken]) if taken else []
    for start, end in candidates(text, lower):
        i = int(np.searchsorted(starts, end))  # known ones that begin before its end
        if i and ends[i - 1] > start:
            continue
        cost = novelty.cost(text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]) / (end - start)
        if cost >= threshold:
            found.append((start, 3, end, cost))
    found.sort(key=lambda x: x[:3])
    if found and not text.isascii():
        count = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        found = [(int(count[a]), kind, int(count[b]), cost) for a, kind, b, cost in found]
    return [(KINDS[kind], a, b, cost) for a, kind, b, cost in found]


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = NOVELTY, size: int = DICTIONARY) -> DataFrame:
    """doc_id, secrets (an array of kind, start, end, novelty, ordered by start, then kind) of each row."""
    content = dictionary(docs, text, size)
    known, key = docs.sparkSession.sparkContext.broadcast(content), W.sha256(content)  # ``size`` pieces of 24 letters at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            novelty = shared.per_process(("novelty", key), lambda: Novelty(known.value))
            rows = [spans(t.as_py(), novelty, threshold) for t in batch.column("text").cast(pa.large_binary())]
            flat = [s for r in rows for s in r]
            columns = [pa.array([s[i] for s in flat], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names=["kind", "start", "end", "novelty"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "secrets"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, secrets array<{SPAN}>")


def joined(secrets: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(shared.read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
