"""Near-duplicates by chosen-path set similarity search.

A text's set is its distinct 5-word shingles, A-Z lower-cased.  Equal sets are one vertex.  In each of ``trees``
independent trees a set branches by its minwise token under a hash of the tree's own, to the node of all sets with that
token; two sets of similarity s share a node with probability s.  In a first round every node's members are linked to
its smallest member, and links are confirmed on the full sets; this joins groups of copies of any size with one
comparison a member and tree.  Then only members of different components are left to compare: small nodes compare all
those, large nodes branch again by the minwise token of the next level, ``levels`` deep at most.  A node that is still
large there is cut into blocks, and tasks compare the full sets of each pair of blocks and return links that join what
belongs together, never all pairs.  Candidates from small nodes pass a comparison of 48 minwise bytes (a linked pair
fails it with probability below 1e-6) and are confirmed on the full sets.  A pair of similarity 0.75 is missed with probability
0.25 ** 16 in small nodes, and 2e-4 at the third level.  No group is gathered in a task, no links go to the driver.
A set that very many are compared with in the first round is copied, and its pairs are dealt out; what joins a hot node,
vertex or component joins a written table, so that Spark can deal its rows out too.

Texts without words (null, empty) have no set and are linked with nothing.  With fewer than five words the whole
sequence is the one shingle.  Every row is a document of its own, so rows that repeat an id and differ in text are not
linked by that; the smallest id of a component ignores null ids; a row is kept if its id is the component's (keep_one()
returns one row of these).
An empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import shared
from tillage.llm import words as W
from tillage.llm.components import components

SIZE = 5
SIMILAR, OF = 75, 100
TREES, LEVELS = 16, 3
#: Members of a node that are compared exhaustively.
NODE = 50
#: Members of a block of a node that is still larger at the last level.
BLOCK = 256
#: Trees in which a member must share its node with the node's smallest for the first round to compare them.
FIRST_SHARED = 4
#: Pairs of the first round with one set that a task compares.
HUB = 1000
#: Of 48 minwise bytes, equal ones that a candidate needs.
SAME_BYTES = 20


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = W.words(texts, lower=True)
    grams = W.shingles(found.hashes, SIZE)
    out = []
    for at, end in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
        if end - at >= SIZE:
            out.append(np.unique(grams[at : end - SIZE + 1]))
        elif end > at:
            out.append(W.shingles(found.hashes[at:end], end - at, stream=10 + end - at))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise(flat: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """For each set (from ``starts`` on in ``flat``) its least value under each of ``count`` hashes."""
    out = np.zeros((len(starts), count), np.uint64)
    factors, adds = W.numbers(count, 5), W.numbers(count, 6)
    with np.errstate(over="ignore"):
        for k in range(count):
            x = (flat ^ adds[k]) * factors[k]
            x ^= x >> np.uint64(31)
            x *= factors[k]
            out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in W.slices(batches):
        sets = shingle_sets(batch.column("text"))
        sizes = np.array([len(s) for s in sets], np.int64)
        filled = np.flatnonzero(sizes)
        tokens: list = [None] * len(sets)
        if len(filled):
            starts = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
            for row, values in zip(filled.tolist(), minwise(np.concatenate([sets[i] for i in filled]), starts, TREES * LEVELS)):
                tokens[row] = values.view(np.int64)
        keys = [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        passed = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in passed), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))],
            names=[*passed, "n_shingles", "key", "tokens"],
        )


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and the set, as sorted 48-bit numbers."""
    from xxhash import xxh3_128_digest

    for batch in W.slices(batches):
        sets = [s for s in shingle_sets(batch.column("text")) if len(s)]
        packed = [s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(packed, pa.binary())], names=["key", "members"])


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            x, y = _unpack(a), _unpack(b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(OF * both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (keys a, b) whose full sets are similar enough."""
    of = lambda side: sets.select(F.col("key").alias(side), F.col("members").alias(f"s{side}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb").mapInArrow(_confirmed, "a binary, b binary")


def confirm_stars(stars: DataFrame, sets: DataFrame, rows: int, paths: list[str] | None) -> DataFrame:
    """As confirm(), for pairs of which very many can have one ``a``: such a set is copied, and its pairs are dealt out.
    ``rows``: at most so many pairs."""
    stars = shared.save(stars, "stars", rows, paths)
    hubs = stars.groupBy("a").count().where(F.col("count") > HUB).select("a", F.ceil(F.col("count") / HUB).cast("int").alias("salts"))
    hubs = shared.save(hubs, "hubs", rows // HUB, paths)
    links = confirm(stars.join(hubs, "a", "left_anti"), sets)
    if hubs.isEmpty():
        return links
    dealt = stars.join(hubs, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    copies = sets.join(hubs, F.col("key") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("members").alias("sa"))
    met = dealt.join(sets.select(F.col("key").alias("b"), F.col("members").alias("sb")), "b").join(copies, ["a", "salt"])
    return links.unionByName(met.select("a", "b", "sa", "sb").mapInArrow(_confirmed, "a binary, b binary"))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("ka", "kb"))
            batch = batch.filter(pa.array((x == y).sum(1) >= SAME_BYTES))
        yield batch.select(["a", "b"])


def _links_of(keys: list[bytes], parts: list[bytes], sets: list[np.ndarray], sides: list[bool]) -> list[tuple[bytes, bytes]]:
    """Links that join what full sets join among these members, and no more; ``sides``: with True on both, a pair is
    left to another block."""
    parent = {p: p for p in parts}

    def find(p: bytes) -> bytes:
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        return p

    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(flat.max() + 1, np.int32)
    second = np.array(sides)
    links = []
    for i in range(len(keys) - 1):
        mine = flat[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[flat[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        mark[mine] = 0
        near = OF * both >= SIMILAR * (sizes[i] + sizes[i + 1 :] - both)
        if second[i]:
            near &= ~second[i + 1 :]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            x, y = find(parts[i]), find(parts[j])
            if x != y:
                parent[x] = y
                links.append((keys[i], keys[j]))
    return links


def _blocks_compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream pairs of blocks (node, i, j), each with at most two blocks of members, and compare the members' full sets."""
    present, held = None, []

    def done() -> pa.RecordBatch:
        keys, parts, sets, sides = ([h[k] for h in held] for k in range(4))
        links = _links_of(keys, parts, sets, sides) if len(set(parts)) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for node, i, j, own, key, part, members in zip(*(batch.column(c).to_pylist() for c in ("node", "i", "j", "own", "key", "component", "members"))):
            if (node, i, j) != present:
                if held:
                    yield done()
                present, held = (node, i, j), []
            held.append((key, part, _unpack(members), i != j and own == j))
    if held:
        yield done()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte of each token."""
    for batch in batches:
        flat = batch.column("tokens").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sketch = (flat >> np.uint64(8)).astype(np.uint8).reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("rep"), batch.column("tokens"), pa.array([s.tobytes() for s in sketch], pa.binary())], names=["key", "rep", "tokens", "sketch"])


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Members of large nodes, once for each pair of blocks of about BLOCK members that theirs is in."""
    blocks = nodes.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    paired = blocks.select("node", "key", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return paired.select("node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "component")


def similar_links(vertices: DataFrame, docs: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Confirmed links (a, b) that join all vertices (key, rep, tokens, sketch) of a component.  ``docs``: doc_id, text.

    ``vertices`` and the sets are bucketed by key, so that only keys travel to them.  ``paths`` gets the scratch tables
    that the links rest on.
    """
    members = vertices.select("key", F.posexplode(F.slice("tokens", 1, TREES)).alias("tree", "node"))
    # Shares and sizes of nodes are written before the members join them: see components._stars().
    shares = shared.save(members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("first")).where("size > 1"), "shares", paths=paths)
    members = shared.save(members.join(shares.drop("size"), "node"), "nodes", paths=paths)
    rows = members.count()

    needed = vertices.join(members.select("key").distinct(), "key", "left_semi").select("rep").distinct()
    texts = docs.where("doc_id IS NOT NULL").join(needed, F.col("doc_id") == F.col("rep"), "left_semi")
    unnamed = docs.where("doc_id IS NULL")  # rows without an id can stand for a set too
    sets = shared.bucketed(texts.unionByName(unnamed).mapInArrow(_packed_sets, "key binary, members binary"), "sets", "key", distinct=True, paths=paths)

    stars = members.where(F.col("key") != F.col("first")).groupBy(F.col("first").alias("a"), F.col("key").alias("b")).count()
    stars = stars.where(F.col("count") >= FIRST_SHARED).select("a", "b")
    links = shared.save(confirm_stars(stars, sets, rows, paths), "confirmed", rows, paths)

    found = components(links, rows)
    now = members.drop("first").join(found, F.col("key") == F.col("member"), "left").withColumn("component", F.coalesce("component", "key")).drop("member")
    pairs = None
    for level in range(LEVELS):
        mixed = now.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").drop("low", "high")
        now = shared.save(now.join(shared.save(mixed, "sizes", rows, paths), "node"), "mixed", rows, paths)
        rows = now.count()
        small = now.where(F.col("size") <= NODE).join(vertices.select("key", "sketch"), "key")
        side = lambda s: small.select("node", F.col("key").alias(s), F.col("component").alias(f"c{s}"), F.col("sketch").alias(f"k{s}"))  # noqa: E731, B023
        alike = side("a").join(side("b"), "node").where("ca < cb").select("a", "b", "ka", "kb").mapInArrow(_alike, "a binary, b binary")
        pairs = alike if pairs is None else pairs.unionByName(alike)
        now = now.where(F.col("size") > NODE)
        if level == LEVELS - 1 or now.isEmpty():
            break
        branch = F.element_at("tokens", F.col("tree") + (level + 1) * TREES + 1)
        now = now.join(vertices.select("key", "tokens"), "key").select("key", "tree", F.xxhash64("node", branch).alias("node"), "component")
    large = _in_blocks(now).join(sets, "key").repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(_blocks_compared, "a binary, b binary")
    return links.unionByName(confirm(pairs.distinct(), sets)).unionByName(large)


def _judged(own: DataFrame) -> DataFrame:
    """A row for each of ``own`` (doc_id, text, others) with n_shingles, key, component, component_id and kept in place of
    its text."""
    kind = own.schema["doc_id"].dataType.simpleString()
    passed = [f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "text"]
    signed = shared.save(own.mapInArrow(_signatures, ", ".join([*passed, "n_shingles long, key binary, tokens array<long>"])), "signatures")
    grouped = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"))
    paths: list[str] = []  # what is needed no longer once the components are written
    vertices = shared.bucketed(grouped.mapInArrow(_sketched, f"key binary, rep {kind}, tokens array<long>, sketch binary"), "vertices", "key", paths=paths)
    found = components(similar_links(vertices, own.select("doc_id", "text"), paths))
    named = vertices.select("key", "rep").join(found, F.col("key") == F.col("member"), "left").withColumn("component", F.coalesce("component", "key"))
    named = shared.save(named, "members", paths=paths)
    least = shared.save(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least", paths=paths)
    named = shared.save(named.join(least, "component").select(F.col("key").alias("of_key"), "component", "component_id"), "named")
    shared.delete(own.sparkSession, paths)
    out = signed.drop("tokens").join(named, F.col("key") == F.col("of_key"), "left").drop("of_key")
    out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    return _judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, and all rows without words, with their own columns.

    Of a component's rows the one with its smallest id stays; where several have that id, or all ids are null, the one
    whose text has the least MD5, and of equal texts any one.  A row is judged by its id and its text, so a kept row's id can
    be that of a row which goes.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # numbered, no column of the caller's clashes with those made here
    own = docs.toDF(*at.values())
    digest, worded = F.md5(F.col(at[text]).cast("binary")), F.coalesce(F.col(at[text]), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    judged = _judged(own.select(F.col(at[id_col]).alias("doc_id"), F.col(at[text]).alias("text"), digest.alias("digest")))
    stay = judged.where("key IS NOT NULL AND kept").groupBy("component", "doc_id").agg(F.min("digest").alias("stay_digest"))
    stay = stay.select(F.struct("doc_id").alias("stay_id"), "stay_digest")  # in a struct, null equals null
    # Repeats of a row are dropped where they lie, before they meet; the join needs no other shuffle.
    once = own.where(worded).withColumns({"own_id": F.struct(F.col(at[id_col]).alias("doc_id")), "own_digest": digest}).dropDuplicates(["own_id", "own_digest"])
    once = once.join(stay, (F.col("own_id") == F.col("stay_id")) & (F.col("own_digest") == F.col("stay_digest")), "left_semi")
    return once.select(*at.values()).unionByName(own.where(~worded)).toDF(*docs.columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i, i + 4) END AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (SELECT a, b FROM met JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)
), reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
