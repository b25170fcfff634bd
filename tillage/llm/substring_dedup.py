"""Removal of repeated passages by prefix-partitioned suffix trees.

The suffixes of all texts that start a window of ``window`` words are split by prefix into groups that fit in memory;
each group's suffix tree shows which of them repeat.

Only suffixes that can repeat travel.  In every window the ``prefix``-word run with the least hash is its anchor; equal
windows have equal anchors, so a window whose anchor is in one document only is left out at once, and no repeat is
missed.  Neighbouring windows with one anchor travel as one run of words, as their suffixes overlap.  A task sends on a
run that it has met before only from a smaller document; what it holds back already has its answer.  This thins out
passages that very many documents share before anything is shuffled.

Runs are grouped by their anchor.  A group of more than ``subtree`` bytes is split by longer prefixes: its runs are cut
into windows, which are grouped by a prefix of more words, until each group fits or the prefix is the whole window.
Then all suffixes of a group are equal and need no tree: the first is an aggregate, which others learn by a salted join.

A tree is held as its suffixes in order with their longest common prefixes (suffix array by prefix doubling, on words
and not on hashes).  An internal node of depth ``window`` or more is a stretch of suffixes with such common prefixes.
Its least (doc_id, place) is the source of the others.  Windows that follow one another in a document and in their source join to a
repeat, which is as long as it can be with that source.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes if a window covering it also starts in a row with a smaller
doc_id; windows are judged on the input.  Null text: no words.  Rows with a null id lose nothing and remove nothing.
Rows that repeat an id don't remove each other's words.  An empty table gives an empty result; other columns are
passed by or kept.  Texts are taken whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import shared
from tillage.llm import words as W

WINDOW, PREFIX = 13, 6
#: Bytes of suffixes in a group; one that has more is split by a longer prefix, of so many more words.
SUBTREE, LONGER = 4 << 20, 3
#: Bytes of small groups whose trees are built at once.
TOGETHER = 2 << 20
#: Bytes of runs that a task remembers to have sent on.
REMEMBER = 16 << 20
FOUND = ("tag", "start", "n", "source", "source_start")


def anchored(found: W.Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first start, number of starts, the anchor's hash, and its text's number."""
    n = len(found.hashes) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.view(np.uint64), none
    grams = W.shingles(found.hashes, prefix)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, window - prefix + 1):
        other = grams[j : j + n]
        less = other < least
        least[less], at[less] = other[less], np.flatnonzero(less) + j
    starts = np.flatnonzero(found.left[:n] >= window)
    if not len(starts):
        return none, none, none.view(np.uint64), none
    doc = np.searchsorted(found.bounds, starts, "right") - 1
    new = np.concatenate([[True], (np.diff(at[starts]) != 0) | (np.diff(doc) != 0)])
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), grams[at[starts[first]]], doc[first]


def _anchors(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            _, _, keys, doc = anchored(W.words(batch.column("text")), window, prefix)
            order = np.lexsort((keys, doc))
            keys, doc = keys[order], doc[order]
            new = np.concatenate([[True], (np.diff(keys) != 0) | (np.diff(doc) != 0)]) if len(keys) else np.zeros(0, bool)
            own = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), batch.column("doc_id").take(own), batch.column("tag").take(own)], names=["anchor", "doc_id", "tag"])

    return run


def _runs(window: int, prefix: int):
    """Runs of windows at anchors that other documents have too: with their words, or with the source that this task has
    already sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, tuple] = {}
        size = 0
        for batch in W.slices(batches):
            first, count, keys, doc = anchored(W.words(batch.column("text")), window, prefix)
            lists = batch.column("anchors")
            of_row = np.repeat(np.arange(len(lists), dtype=np.uint64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            wanted = lists.flatten().to_numpy().view(np.uint64) ^ W.splitmix(of_row)
            hit = np.flatnonzero(np.isin(keys ^ W.splitmix(doc.astype(np.uint64)), wanted))  # a false hit costs a row, no more
            bounds = W.words(batch.column("text")).bounds if len(hit) else None
            ids, values = batch.column("doc_id"), batch.column("text").cast(pa.large_binary())
            known_ids = ids.to_pylist()
            split_of, split = -1, []
            held: dict[tuple, int] = {}
            rows: list[tuple] = []
            for d, at, n, key in zip(doc[hit].tolist(), (first[hit] - bounds[doc[hit]]).tolist() if len(hit) else (), count[hit].tolist(), keys[hit].view(np.int64).tolist()):
                if d != split_of:
                    split_of, split = d, values[d].as_py().split()
                content, own = b" ".join(split[at : at + n + window - 1]), known_ids[d]
                before = sent.get(content)
                if before is not None and before[0] < own:
                    rows.append((None, d, [at], None, n, before[0], before[1]))
                elif (d, content) in held:
                    rows[held[d, content]][2].append(at)
                else:
                    held[d, content] = len(rows)
                    rows.append((key, d, [at], content, n, None, None))
                    size += 0 if content in sent else len(content) + 200  # the entry itself takes about so much
                    if size > REMEMBER:
                        sent.clear()
                        size = len(content) + 200
                    sent[content] = (own, at)
            cols = list(zip(*rows)) if rows else [[]] * 7
            at_row = pa.array(cols[1], pa.int64())
            out = [pa.array(cols[0], pa.int64()), ids.take(at_row), batch.column("tag").take(at_row), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.binary()).cast(pa.string()), pa.array(cols[4], pa.int32()), pa.array(cols[5], ids.type), pa.array(cols[6], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=["key", "doc_id", "tag", "starts", "words", "n", "source", "source_start"])

    return run


def _lengthened(window: int, length: int):
    """The windows of runs, one by one, each with the key of its first ``length`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            keys, rows, starts, texts = [], [], [], []
            for row, (words, at) in enumerate(zip(batch.column("words").cast(pa.binary()).to_pylist(), batch.column("starts").to_pylist())):
                split = words.split(b" ")
                for i in range(len(split) - window + 1):
                    keys.append(xxh3_64_intdigest(b" ".join(split[i : i + length]), length) - (1 << 63))
                    rows.append(row)
                    starts.append([x + i for x in at])
                    texts.append(b" ".join(split[i : i + window]))
            at_row = pa.array(rows, pa.int64())
            out = [pa.array(keys, pa.int64()), batch.column("doc_id").take(at_row), batch.column("tag").take(at_row), pa.array(starts, pa.list_(pa.int32())), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["key", "doc_id", "tag", "starts", "words"])

    return run


def suffix_names(ids: np.ndarray, left: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each power of two up to ``longest`` the place in order of the suffix at each word, cut to so many words.

    ``ids``: words as numbers; ``left``: words from each to the end of its run, beyond which nothing counts.
    """
    names, length = [ids.astype(np.int64) + 1], 1
    while length < longest:
        own = names[-1]
        after = np.zeros_like(own)
        after[:-length] = own[length:]
        after[left <= length] = 0
        _, order = np.unique(own * (int(own.max()) + 1) + after, return_inverse=True)
        names.append(order.reshape(-1) + 1)
        length *= 2
    return names


def common_prefixes(names: list[np.ndarray], left: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``one`` and ``two`` have in common."""
    found = np.zeros(len(one), np.int64)
    room, last = np.minimum(left[one], left[two]), len(left) - 1
    for k in range(len(names) - 1, -1, -1):
        same = (room - found >= 1 << k) & (names[k][np.minimum(one + found, last)] == names[k][np.minimum(two + found, last)])
        found += same.astype(np.int64) << k
    return found


def deep_nodes(suffixes: np.ndarray, names: list[np.ndarray], left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and where among them the subtree of each topmost node of ``depth`` or more begins (that of a
    lone suffix, a leaf, too)."""
    order = suffixes[np.argsort(names[-1][suffixes], kind="stable")]
    shallow = common_prefixes(names, left, order[:-1], order[1:]) < depth
    return order, np.flatnonzero(np.concatenate([[True], shallow]))


def _subtrees(window: int, together: int):
    """Stream runs in order of their groups, and build the trees of whole groups."""

    def repeats(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        ids, tags, starts = (table.column(c).chunk(0) for c in ("doc_id", "tag", "starts"))
        lists = pc.split_pattern(table.column("words").chunk(0), " ")
        words = lists.flatten().dictionary_encode().indices.to_numpy()
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(words)) - (ends - sizes)[row]
        left = sizes[row] - place
        names = suffix_names(words, left, int(sizes.max()))
        order, begins = deep_nodes(np.flatnonzero(left >= window), names, left, window)
        doc = ids.to_numpy() if pa.types.is_integer(ids.type) else np.unique(np.array(ids.to_pylist(), object), return_inverse=True)[1]
        counts = pc.list_value_length(starts).to_numpy().astype(np.int64)
        flat = starts.flatten().to_numpy().astype(np.int64)
        begin = np.cumsum(counts) - counts
        at = flat[begin[row[order]]] + place[order]  # where each suffix first starts in its document
        earliest = np.lexsort((at, doc[row[order]]))
        precedence = np.empty(len(order), np.int64)
        precedence[earliest] = np.arange(len(order))
        source = earliest[np.minimum.reduceat(precedence, begins)]
        source = np.repeat(source, np.diff(np.append(begins, len(order))))
        repeated = np.flatnonzero(doc[row[order[source]]] < doc[row[order]])
        repeated = repeated[np.argsort(order[repeated], kind="stable")]  # by run and place
        source, mine = source[repeated], order[repeated]
        shift = at[source] - place[mine]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(mine) != 1) | (np.diff(row[mine]) != 0) | (np.diff(row[order[source]]) != 0) | (np.diff(shift) != 0)])[: len(mine)])
        length = np.diff(np.append(first, len(mine)))
        many = counts[row[mine[first]]]  # a run that its document has several times repeats at each place
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first, length = np.repeat(first, many), np.repeat(length, many)
        rows = row[mine[first]]
        out = [ids.take(pa.array(rows)), tags.take(pa.array(rows)), pa.array((flat[begin[rows] + nth] + place[mine[first]]).astype(np.int32)), pa.array(length.astype(np.int32)), ids.take(pa.array(row[order[source[first]]])), pa.array(at[source[first]].astype(np.int32))]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", *FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.worker_objects()
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("words").nbytes
            if size >= together:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                last = int(np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))[-1])  # this group may go on
                if last:
                    yield repeats(table.slice(0, last))
                    held, size = table.slice(last).to_batches(), 0
        if held:
            yield repeats(pa.Table.from_batches(held))

    return run


def repeated_windows(own: DataFrame, window: int, prefix: int, subtree: int, scanned: DataFrame | None = None) -> DataFrame:
    """doc_id, tag, start, n, source, source_start: from word ``start`` on, ``n`` windows of a row are those of the earlier
    document ``source`` from its word ``source_start`` on.  ``own``: doc_id, tag, text; ``scanned``: the same texts where
    they are cheaper to read in any order.  Rows without an id neither repeat others nor are repeated; they are left out by
    the caller."""
    kind = own.schema["doc_id"].dataType.simpleString()
    anchors = (scanned or own).select("doc_id", "tag", "text").mapInArrow(_anchors(window, prefix), f"anchor long, doc_id {kind}, tag long")
    shared_by = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    shared_by = shared.save(shared_by, "shared-anchors")  # see components._stars()
    # Rows that repeat an id are told apart by their texts, so that none gathers another's anchors.
    by_doc = anchors.join(shared_by, "anchor").groupBy(F.col("doc_id").alias("of_id"), F.col("tag").alias("of_tag")).agg(F.collect_set("anchor").alias("anchors"))
    texts = own.join(by_doc, (F.col("doc_id") == F.col("of_id")) & (F.col("tag") == F.col("of_tag"))).select("doc_id", "tag", "text", "anchors")
    suffix = f"key long, doc_id {kind}, tag long, starts array<int>, words string"
    runs = shared.save(texts.mapInArrow(_runs(window, prefix), f"{suffix}, n int, source {kind}, source_start int"), "runs")
    found = runs.where("key IS NULL").select("doc_id", "tag", F.col("starts")[0].alias("start"), "n", "source", "source_start")

    left, length, groups = runs.where("key IS NOT NULL").select("key", "doc_id", "tag", "starts", "words"), prefix, None
    size = F.length("words") + 8 * F.size("starts") + 32
    while True:
        large = left.groupBy("key").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > subtree)
        count, total = large.agg(F.count(F.lit(1)), F.sum("bytes")).first()
        if not count:
            groups = left if groups is None else groups.unionByName(left)
            break
        large = shared.save(large, "large-groups", count)
        small = left.join(large, "key", "left_anti")
        groups = small if groups is None else groups.unionByName(small)
        heavy = left.join(large, "key")
        if length == window:
            found = found.unionByName(_equal_windows(heavy, subtree))
            break
        length = min(window, length + LONGER)
        left = shared.save(heavy.mapInArrow(_lengthened(window, length), suffix), "windows")
    trees = groups.repartition("key").sortWithinPartitions("key").mapInArrow(_subtrees(window, TOGETHER), f"doc_id {kind}, tag long, start int, n int, source {kind}, source_start int")
    return found.unionByName(trees)


def _equal_windows(heavy: DataFrame, subtree: int) -> DataFrame:
    """Repeats among windows whose groups, of equal ones, are large: an aggregate tells the first, a salted join the others."""
    salts = F.ceil(F.col("bytes") / subtree).cast("int")
    firsts = heavy.groupBy("words").agg(F.min(F.struct("doc_id", F.col("starts")[0].alias("start"))).alias("first"), F.max(salts).alias("salts"))
    firsts = firsts.select("words", F.col("first.doc_id").alias("source"), F.col("first.start").alias("source_start"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = heavy.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tag"), salts).cast("int"))
    later = dealt.join(firsts, ["words", "salt"]).where("source < doc_id")
    return later.select("doc_id", "tag", F.explode("starts").alias("start"), F.lit(1).alias("n"), "source", "source_start")


def joined_repeats(found: list[tuple], window: int) -> list[dict]:
    """Stretches of words from runs of windows (start, n, source, source_start): runs that go on where the one before them
    ends, in the document and in its source, are one."""
    out: list[dict] = []
    for start, n, source, at in sorted(found):
        last = out[-1] if out else None
        if last and last["source"] == source and start == last["end"] - window + 1 and at - start == last["source_start"] - last["start"]:
            last["end"] = start + n + window - 1
        else:
            out.append({"start": start, "end": start + n + window - 1, "source": source, "source_start": at})
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX, subtree: int = SUBTREE) -> DataFrame:
    """``docs`` with n_words, n_removed, kept (words joined by one space) and spans beside their own columns; columns of
    these names are replaced.

    A span (start, end, source, source_start) is a repeat that removes words: they are also in the document ``source``, of
    a smaller id (often, but not always, the smallest that has them), from its word ``source_start`` on.  Spans may overlap.
    """
    made = ("n_words", "n_removed", "kept", "spans")
    names = [c for c in docs.columns if c not in made]
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c not in (id_col, text)), F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    # Two joins need the texts by row: they are dealt once, to a bucketed table.  The tag tells rows of one id apart.  Rows
    # without an id keep all their words, and are not dealt, as they would meet in one bucket.
    own = own.withColumn("tag", F.xxhash64("doc_id", "text"))
    known = own.where("doc_id IS NOT NULL")
    dealt = shared.bucketed(known, "texts", "doc_id", "tag")
    windows = repeated_windows(dealt.select("doc_id", "tag", "text"), window, prefix, subtree, known.select("doc_id", "tag", "text"))
    lists = windows.groupBy(F.col("doc_id").alias("of_id"), F.col("tag").alias("of_tag")).agg(*(F.collect_list(c).alias(f"l_{c}") for c in FOUND[1:]))
    joined = dealt.join(lists, (F.col("doc_id") == F.col("of_id")) & (F.col("tag") == F.col("of_tag")), "left").drop("of_id", "of_tag", "tag")
    unknown = own.where("doc_id IS NULL").drop("tag").select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in joined.schema if f.name.startswith("l_")))
    joined = joined.unionByName(unknown)
    rest = [f for f in joined.schema if f.name[0] == "c" or f.name == "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            counts, removed, kept, spans = [], [], [], []
            texts = batch.column("text")
            values = texts.cast(pa.large_binary()).to_pylist()
            for value, *found in zip(values, *(batch.column(f"l_{c}").to_pylist() for c in FOUND[1:])):
                split = value.split()
                counts.append(len(split))
                mine = joined_repeats(list(zip(*found)), window) if found[0] else []
                at, left = 0, []
                for span in mine:  # in order of their starts
                    left += split[at : max(at, span["start"])]
                    at = max(at, span["end"])
                left = left + split[at:] if mine else split
                removed.append(len(split) - len(left))
                kept.append(b" ".join(left).decode())
                spans.append(mine)
            id_type = batch.column("doc_id").type
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", id_type), ("source_start", pa.int32())]))
            out = [*(batch.column(f.name) for f in rest), texts.cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(out, names=[*(f.name for f in rest), "text", *made])

    of = joined.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rest), f"text string, n_words long, n_removed long, kept string, spans array<struct<start: int, end: int, source: {of}, source_start: int>>"])
    called = {id_col: "doc_id", text: "text"}
    return joined.mapInArrow(run, schema).select(*(F.col(called.get(c, f"c{i}")).alias(c) for i, c in enumerate(names)), *made)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM d, unnest(range(1, len(w) - 11)) AS u(i)
), hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM g) WHERE low < doc_id
), gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, unnest(range(0, 13)) AS u(j)
), x AS (SELECT d.doc_id, k.p, d.w[k.p] AS word FROM d, unnest(range(1, len(w) + 1)) AS k(p)
), kept AS (
  SELECT x.doc_id, count(gone.p)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (gone.p IS NULL) AS t
  FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
