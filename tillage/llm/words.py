"""Words and word shingles of whole Arrow batches as NumPy arrays.

A word is ``[^\\x20\\x09-\\x0D]+``.  Each gets a 64-bit multilinear hash (a random number for each byte value
times a random odd number for each place in the word), computed for a whole batch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tillage.llm import shared

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
SEED = 20240611


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, stream: int) -> np.ndarray:
    """The first n odd pseudo-random numbers of a stream; the same in every task."""
    with np.errstate(over="ignore"):
        return splitmix(np.arange(n, dtype=np.uint64) + np.uint64(SEED + stream * 0x1000003)) | np.uint64(1)


def byte_table(lower: bool) -> np.ndarray:
    table = numbers(256, 1)
    if lower:
        table[65:91] = table[97:123]
    return table


@dataclass
class Words:
    """``hashes`` of all words; ``left`` words from this one to its text's end; ``bounds`` of each text's words."""

    hashes: np.ndarray
    left: np.ndarray
    bounds: np.ndarray


def values(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each text starts and ends; a null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str = "text", limit: int = 1 << 20):
    """The batches cut to about ``limit`` bytes of text each, as the arrays made from a text take some hundred times its size."""
    shared.worker_objects()
    for batch in batches:
        texts = batch.column(column)
        texts = texts.cast(pa.large_string()).fill_null("")
        batch = batch.set_column(batch.schema.get_field_index(column), column, texts)
        _, offsets = values(texts)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


#: Bytes whose words are found at once, as the arrays for it take some forty times as much.
CHUNK = 1 << 22


def _parts(data: np.ndarray) -> list[int]:
    """Where to cut data into parts of about CHUNK bytes, at white space only."""
    cuts = [0]
    while len(data) - cuts[-1] > CHUNK:
        at = cuts[-1] + CHUNK
        while at < len(data):  # a word may be long
            found = np.flatnonzero(WHITE[data[at : at + CHUNK]])
            if len(found):
                at += int(found[0])
                break
            at = min(len(data), at + CHUNK)
        cuts.append(at)
    return [*cuts, len(data)] if cuts[-1] < len(data) else cuts


def _hashed(data: np.ndarray, firsts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and their hashes; ``firsts``: where texts start."""
    solid = ~WHITE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    start[firsts] = solid[firsts]
    at = np.flatnonzero(start)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    packed = data[solid]
    begin = np.flatnonzero(start[solid])
    lengths = np.diff(np.append(begin, len(packed)))
    place = np.arange(len(packed)) - np.repeat(begin, lengths)
    with np.errstate(over="ignore"):
        hashes = np.add.reduceat(byte_table(lower)[packed] * numbers(int(lengths.max()), 2)[place], begin)
        return at, splitmix(hashes + lengths.astype(np.uint64))


def words(array: pa.Array, lower: bool = False) -> Words:
    data, offsets = values(array)
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    cuts = _parts(data)
    for low, high in zip(cuts, cuts[1:]):
        firsts = offsets[:-1][(offsets[:-1] >= low) & (offsets[:-1] < high)] - low
        at, found = _hashed(data[low:high], firsts, lower)
        starts.append(at + low)
        hashes.append(found)
    bounds = np.searchsorted(np.concatenate(starts), offsets)
    found = np.concatenate(hashes)
    return Words(found, np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(found)), bounds)


def shingles(hashes: np.ndarray, size: int, stream: int = 3) -> np.ndarray:
    """Hashes of all runs of ``size`` words, over the ends of texts too: use ``left`` to leave those out."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(numbers(size, stream)):
            out += hashes[i : i + n] * c
        return splitmix(out)


def sha256(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()
