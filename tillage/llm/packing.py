"""Best-fit-decreasing packing of whole documents into sequences.

Lengths are whole numbers up to the capacity, so packing needs only how many pieces have each length: at most
``capacity`` counts, however many documents there are.  Best fit runs over those counts, longest first; a segment tree
over remaining capacities finds the tightest open bin in logarithmic time, and all bins of one remaining capacity are
filled at once, as one-by-one best fit would fill them.  The outcome, runs of equal pieces in runs of bins, is bounded
by the capacity too; each piece finds its place from its rank among the pieces of its length.

Null or empty text: the end id alone.  Longer documents are cut into pieces of the capacity; the last may be
shorter.  Equal rows and repeated ids are packed each on their own, a null id stays null.  An empty table gives an
empty result; other columns are passed by.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillage.llm import shared
from tillage.llm import words as W

CAPACITY = 4096
END_ID = 1
#: Bytes of text whose words are looked up at once.
SLICE = 4 << 20
#: Bytes of parts of words that a Python worker remembers before it forgets them.
REMEMBER = 90 << 20
#: Bytes that a remembered part takes besides its letters and ids: two objects and an entry.
OVERHEAD = 160


class Capacities:
    """A segment tree over remaining capacities: how many open bins each node has below it."""

    def __init__(self, capacity: int) -> None:
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.bins = [0] * (2 * self.size)

    def add(self, remaining: int, count: int) -> None:
        node = remaining + self.size
        while node:
            self.bins[node] += count
            node //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least ``length`` that an open bin has."""
        node = length + self.size
        if self.bins[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.bins[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.bins[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


@dataclass
class Runs:
    """Pieces of ``length`` from rank ``rank`` on fill bins from ``bin`` on, ``per_bin`` in each, from ``offset`` on."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of pieces."""
        by_length = np.searchsorted(-self.length, -length, "left")
        last = np.searchsorted(-self.length, -length, "right")
        low, high = by_length, last - 1  # runs of a length are in order of rank
        while (low < high).any():
            mid = (low + high + 1) // 2
            right = self.rank[mid] <= rank
            low, high = np.where(right, mid, low), np.where(right, high, mid - 1)
        nth = rank - self.rank[low]
        return self.bin[low] + nth // self.per_bin[low], self.offset[low] + nth % self.per_bin[low] * self.length[low]


def best_fit(counts: dict[int, int], capacity: int) -> Runs:
    """Best fit decreasing of ``counts[length]`` pieces of each length from 1 to ``capacity``."""
    tree = Capacities(capacity)
    open_bins: dict[int, deque] = {}
    out: list[tuple[int, int, int, int, int]] = []
    next_bin = 0

    def leave(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            open_bins.setdefault(remaining, deque()).append((first, count))
            tree.add(remaining, count)

    def fill(length: int, rank: int, todo: int, remaining: int, first: int, count: int) -> int:
        """Put up to ``todo`` pieces into these bins; how many went in."""
        per_bin = remaining // length
        full = min(count, todo // per_bin)
        rest = todo - full * per_bin if full < count else 0
        if full:
            out.append((length, rank, first, per_bin, capacity - remaining))
            leave(remaining - per_bin * length, first, full)
        if rest:
            out.append((length, rank + full * per_bin, first + full, per_bin, capacity - remaining))
            leave(remaining - rest * length, first + full, 1)
        used = full + (rest > 0)
        if used < count:
            leave(remaining, first + used, count - used)
        return full * per_bin + rest

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            remaining = tree.tightest(length)
            if remaining is None:
                bins = -(-todo // (capacity // length))
                done = fill(length, rank, todo, capacity, next_bin, bins)
                next_bin += bins
            else:
                first, count = open_bins[remaining].popleft()
                tree.add(remaining, -count)
                done = fill(length, rank, todo, remaining, first, count)
            rank, todo = rank + done, todo - done
    return Runs(*(np.array([r[i] for r in out], np.int64) for i in range(5)))


#: Words of these characters need no normalisation but lower case, so the tokenizer's own steps can be taken one by one.
PLAIN = "[!-~\u00a1-\u012f\u0131-\u017f]+"
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The parts that this finds besides runs of letters; with spaces around these, a word falls into its parts.
BESIDES = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+)"
#: Goes before a word that is no plain one; no part of a plain word has it.
ODD = "\0"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each character of one byte: itself if printable, else the next free one."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def take(ids: np.ndarray, bounds: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked stretches of ``ids``, one after the other, and their bounds."""
    sizes = np.diff(bounds)[picks]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(bounds[picks] - ends[:-1], sizes)
    at += np.arange(ends[-1])
    return ids[at], ends


def distinct(split: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of lists of strings: the different strings, the number of each string, and the bounds of the lists."""
    flat = split.flatten().dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])


class _Ids(dict):
    """Ids of words.  Words between ASCII white space are encoded one by one: the tokenizer drops white space and never
    looks beyond it.  Plain words are lower-cased and cut by the tokenizer's pattern, each different word of a batch once,
    and each part goes to its BPE model once; others go through the whole tokenizer.  Parts and other words are remembered
    with their ids as little-endian 32-bit numbers."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        letters = byte_letters()
        self.model, self.letters = self.tokenizer.model, {c: "".join([letters[b] for b in chr(c).encode()]) for c in range(161, 384)}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
        self.known = steps == (["NFC", "Replace", "Lowercase"], PRETOKENS)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.parts: dict[str, bytes] = {}
        self.bytes = 0

    def cut(self, words: pa.Array) -> pa.Array:
        """The parts of each plain word, and perhaps empty strings; a word that is no plain one, behind a mark."""
        mark, nothing = pa.scalar(ODD, words.type), pa.scalar("", words.type)
        spaced = pc.binary_join_element_wise(mark, words, nothing)
        if self.known:
            plain = pc.match_substring_regex(words, rf"\A{PLAIN}\z")
            for s in self.special:
                plain = pc.and_not(plain, pc.match_substring(words, s))
            spaced = pc.if_else(plain, pc.replace_substring_regex(pc.utf8_lower(words), BESIDES, r" \1 "), spaced)
        return pc.ascii_split_whitespace(spaced)

    def know(self, parts: list[str]) -> None:
        """Learn the parts that are not remembered."""
        if self.bytes > REMEMBER:
            self.parts.clear()
            self.bytes = 0
        new = [p for p in parts if p not in self.parts]
        tokenize, letters = self.model.tokenize, self.letters
        ids: list[int] = []
        sizes = []
        odd = [p for p in new if p[:1] == ODD]
        encoded = iter(self.tokenizer.encode_batch_fast([p[1:] for p in odd], add_special_tokens=False))
        for p in new:
            found = next(encoded).ids if p[:1] == ODD else [t.id for t in tokenize(p if p.isascii() else p.translate(letters))]
            ids += found
            sizes.append(len(found))
        packed, at = np.array(ids, "<u4").tobytes(), 0
        for p, n in zip(new, sizes):
            self.parts[p] = packed[at : at + 4 * n]
            at += 4 * n
        self.bytes += sum(map(len, new)) + len(packed) + OVERHEAD * len(new)

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and each word's bounds there."""
        parts, picks, bounds = distinct(self.cut(words))
        keys = parts.to_numpy(zero_copy_only=False).tolist()
        self.know(keys)
        ids = [self.parts[p] for p in keys]
        flat, ends = take(np.frombuffer(b"".join(ids), "<u4"), np.cumsum([0, *map(len, ids)]) // 4, picks)
        return flat, ends[bounds]

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As of_words(), for whole texts."""
        words, picks, bounds = distinct(pc.ascii_split_whitespace(texts))
        flat, ends = take(*self.of_words(words), picks)
        return flat, ends[bounds]

    def learn(self, found: list[list[bytes]]) -> None:
        """Hold just these words, as keys; for callers that have words and no texts."""
        self.clear()
        words = list({w for ws in found for w in ws})
        ids, bounds = self.of_words(pa.array(words, pa.large_binary()).cast(pa.large_string()))
        self.update((w, ids[i:j].tobytes()) for w, (i, j) in zip(words, pairwise(bounds.tolist())))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row for each piece, with its task's number and its rank among the pieces of its length in that task."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    extra = ", ids binary" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = shared.per_process(("word ids", tokenizer), lambda: _Ids(tokenizer))
        ranks, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in W.slices(batches, limit=SLICE):
            flat, bounds = known.of_texts(batch.column(1))
            rows: list[tuple] = []
            for row, (first, last) in enumerate(pairwise(bounds.tolist())):
                ids = flat[first:last].tobytes() + end
                for start in range(0, len(ids), 4 * capacity):
                    piece = ids[start : start + 4 * capacity]
                    length = len(piece) // 4
                    rows.append((row, start // (4 * capacity), start // 4, length, zlib.crc32(piece), int(ranks[length]), piece))
                    ranks[length] += 1
            cols = list(zip(*rows)) if rows else [[]] * 7
            out = [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:6]), pa.array([part] * len(rows), pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(cols[6], pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long, part int{extra}")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset of each piece.  ``cut``: from pieces(); it is written once, as ranks must not change."""
    spark = cut.sparkSession
    cut = shared.save(cut, "pieces")
    counts = cut.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col("part").alias("of_part"), F.col("length").alias("of_length"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.sparkContext.broadcast(best_fit(histogram, capacity))  # bounded by the capacity
    ranked = cut.join(firsts, (F.col("part") == F.col("of_part")) & (F.col("length") == F.col("of_length"))).select(
        *(c for c in cut.columns if c not in ("rank", "part")), (F.col("rank") + F.col("first")).alias("rank")
    )
    fields = [f for f in ranked.schema if f.name != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, offsets = runs.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(bins), pa.array(offsets)], names=[*(f.name for f in fields), "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(pieces(docs, tokenizer, capacity, keep_ids=keep_ids), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(shared.read(spark, sf_dir, "documents"))
