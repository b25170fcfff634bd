"""Vector and graph retrieval over chunks.

Similarities are exact: one pass over the vectors, in generated code, then the k best of each partition and of all
(TakeOrderedAndProject).  Few rows remain, so what follows joins them by broadcast when Spark sees their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.functions.text import has
from tillage.operators import text_index
from tillage.operators.graph import Graph, few
from tillage.operators.text_index import TextIndex


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null if a vector is null, empty, all zero or of another length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def score(similarity: Column) -> Column:
    """From 0 to 1, as vector indexes report it."""
    return (similarity + 1) / 2


def top_k(chunks: DataFrame, query: Column, k: int = 10, id_col: str = "chunk_id", vector: str = "embedding", where: Column | None = None, prefilter: bool = False) -> DataFrame:
    """The k rows most similar to a vector.  ``where`` filters the k rows found, so fewer may remain, unless ``prefilter``."""
    if where is not None and prefilter:
        chunks = chunks.where(where)
    rows = chunks.withColumn("cosine", cosine(F.col(vector), query)).where("cosine IS NOT NULL").orderBy(F.desc("cosine"), id_col).limit(k)
    rows = rows.withColumn("score", score(F.col("cosine")))
    return rows.where(where) if where is not None and not prefilter else rows


def with_provenance(chunks: DataFrame, g: Graph) -> DataFrame:
    """Chunks with the source and product of their document, if there is one."""
    docs = g.document.select("product_number", F.col("source").alias("document"))
    products = g.herbicide.select("product_number", F.col("product_name").alias("herbicide"))
    return chunks.join(docs, "product_number", "left").join(products, "product_number", "left")


def vector_search(g: Graph, query: Column, k: int = 10, chunk_type: str | None = None, product_number: str | None = None, prefilter: bool = False) -> DataFrame:
    where = None
    for name, value in (("chunk_type", chunk_type), ("product_number", product_number)):
        if value is not None:
            one = F.col(name) == value
            where = one if where is None else where & one
    return with_provenance(top_k(g.chunk, query, k, where=where, prefilter=prefilter), g)


def adjacent(g: Graph, ids: DataFrame) -> DataFrame:
    """Chunks by id (repeated ids stay) with section, and id and text of the chunk before and after."""
    columns = [F.col(c) if c in g.chunk.columns else F.lit(None).cast("string").alias(c) for c in ("text", "chunk_type", "parent_section", "product_number")]
    texts = g.chunk.select("chunk_id", *columns).withColumnRenamed("parent_section", "section")
    wanted = ids.select("chunk_id").distinct()
    before = g.next.select(F.col("dst").alias("chunk_id"), F.col("src").alias("prev_id")).join(wanted, "chunk_id", "left_semi")
    after = g.next.select(F.col("src").alias("chunk_id"), F.col("dst").alias("next_id")).join(wanted, "chunk_id", "left_semi")
    other = lambda edges, side: edges.join(g.chunk.select(F.col("chunk_id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text")), f"{side}_id")
    return ids.join(texts, "chunk_id").join(other(before, "prev"), "chunk_id", "left").join(other(after, "next"), "chunk_id", "left")


def mentioned(g: Graph, ids: DataFrame, brief: bool = False) -> DataFrame:
    """Entities that the chunks mention, each with its chunks.  ``brief``: the chunks are few, so only their pairs are made."""
    wanted = ids.select("chunk_id").distinct()
    rows = links.near(wanted) if brief and (links := g.linked()) else wanted.join(g.mentions, "chunk_id")
    return rows.groupBy("entity_type", "entity").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def related_products(g: Graph, ids: DataFrame, limit: int = 10, brief: bool = False) -> DataFrame:
    """Products of the chunks' documents, with group and the first ``limit`` of what they control: weed, crop, rate, timing
    and level.  Only so many rows of a product are ever gathered, however many it has.  ``brief``: the chunks are few, so
    their products are asked for first."""
    products = ids.select("chunk_id").distinct().join(g.chunk.select("chunk_id", "product_number"), "chunk_id").select("product_number").distinct()
    products = few(products) if brief else products
    rows = products.join(g.document.select("product_number"), "product_number").join(g.herbicide.select("product_number", "product_name", "active_constituent"), "product_number")
    moa = g.has_mode_of_action.withColumnRenamed("group", "moa_group")
    fields = {"weed": "weed", "crop": "crop", "rate": "rate_per_ha", "timing": "application_timing", "control_level": "control_level"}
    own = g.controls.join(products, "product_number", "left_semi").select("product_number", *(F.col(c).alias(n) for n, c in fields.items())).distinct()
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("product_number").orderBy(*fields))).where(F.col("_n") <= limit)
    controls = first.groupBy("product_number").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("controls"))
    none = F.array().cast(controls.schema["controls"].dataType)
    return rows.join(moa, "product_number", "left").join(controls, "product_number", "left").withColumn("controls", F.coalesce("controls", none))


def expand(g: Graph, ids: DataFrame, include_adjacent: bool = True, brief: bool = False) -> dict[str, DataFrame]:
    """What the graph knows around some chunks."""
    chunks = adjacent(g, ids) if include_adjacent else ids.join(g.chunk.select("chunk_id", "text", "chunk_type", "product_number"), "chunk_id")
    return {"chunks": chunks, "mentions": mentioned(g, ids, brief), "herbicides": related_products(g, ids, brief=brief)}


def hybrid_search(g: Graph, text: str, embed: Callable[[str], list[float]], k: int = 5, expand_graph: bool = True, chunk_type: str | None = None) -> dict[str, DataFrame]:
    """Embed a question (``embed``: any model), find chunks and what the graph has around them."""
    found = vector_search(g, F.array(*(F.lit(float(x)) for x in embed(text))), k, chunk_type)
    if not expand_graph:
        return {"hits": found}
    found = few(found)
    return {"hits": found} | expand(g, found.select("chunk_id"), brief=True)


def chunks_for(g: Graph, term: str, kind: str, k: int = 10, once: bool = False, index: TextIndex | None = None) -> DataFrame:
    """Chunks that mention an entity like ``term`` (score 1), or whose text has it (0.8).  A chunk may come by both ways;
    ``once`` keeps its better row.  With an ``index`` over chunk texts by chunk_id these are found by it, not by a scan."""
    chunks, best = g.chunk.select("chunk_id", "text", "chunk_type", "product_number"), (F.desc("score"), "chunk_id", F.asc_nulls_last("entity"))
    found = text_index.search(index, term).select(F.col("id").alias("chunk_id")) if index else chunks.where(has(F.col("text"), term))
    by_text = found.select("chunk_id", F.lit(None).cast("string").alias("entity"), F.lit(0.8).alias("score"))
    like = lambda name: has(name, term)
    if links := g.linked():
        # Mentions come before texts: with k of them, and with ``once`` k chunks of them, texts needn't be read.
        hits = few(links.of_entities(kind, like, k).distinct().orderBy("chunk_id", "entity").limit(k)) if not once else links.of_entities(kind, like, k)
        enough = (hits.select("chunk_id").distinct() if once else hits).count() >= k
        rows = hits.withColumn("score", F.lit(1.0)) if enough else hits.withColumn("score", F.lit(1.0)).unionByName(by_text)
    else:
        rows = g.mentions.where((F.col("entity_type") == kind) & like(F.col("entity"))).select("chunk_id", "entity", F.lit(1.0).alias("score")).unionByName(by_text)
    rows = rows.distinct()
    if once:
        rows = rows.groupBy("chunk_id").agg(F.max_by("entity", "score").alias("entity"), F.max("score").alias("score"))
    # The first k that have a chunk are found without texts; a chunk id that is repeated can only make them more.
    rows = rows if g.linked() and not index else rows.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    rows = few(rows.orderBy(*best).limit(k))
    return with_provenance(few(F.broadcast(rows).join(chunks, "chunk_id").orderBy(*best).limit(k)), g)


def context(chunks: DataFrame, window: int = 2, doc: str = "product_number", order: str = "sequence_order", near: DataFrame | None = None) -> DataFrame:
    """Each chunk (or those of ``near``: chunk_id) with the ids of up to ``window`` chunks before and after it."""
    centre = chunks.select("chunk_id", F.col(doc).alias("_d"), F.col(order).alias("_o"))
    centre = centre.join(near, "chunk_id", "left_semi") if near is not None else centre
    steps = centre.select("chunk_id", "_d", "_o", F.explode(F.array(*(F.lit(s) for s in [*range(-window, 0), *range(1, window + 1)]))).alias("_s")) if window else None
    if steps is None:
        return centre.select("chunk_id", F.array().cast("array<string>").alias("prev"), F.array().cast("array<string>").alias("next"))
    other = chunks.select(F.col("chunk_id").alias("_id"), F.col(doc).alias("_d"), F.col(order).alias("_p"))
    met = steps.withColumn("_p", F.col("_o") + F.col("_s")).join(other, ["_d", "_p"])
    sides = met.groupBy("chunk_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_s") < 0, F.struct("_s", "_id")))), lambda x: x["_id"]).alias("prev"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_s") > 0, F.struct("_s", "_id")))), lambda x: x["_id"]).alias("next"),
    )
    none = F.array().cast("array<string>")
    return centre.select("chunk_id").join(sides, "chunk_id", "left").select("chunk_id", F.coalesce("prev", none).alias("prev"), F.coalesce("next", none).alias("next"))


def within(edges: DataFrame, starts: DataFrame, steps: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """start, node, depth: what is reached from each start (column ``start``) over 1 to ``steps`` edges, by the shortest way.

    Any graph will do: branches are all followed, a cycle brings a start back as a node, and no way is walked twice.  A step
    is a left join of the newest nodes with the edges and a min() by start and node, so the plan grows with ``steps`` alone.
    """
    ways = edges.select(F.col(src).alias("_src"), F.col(dst).alias("_dst")).where("_src IS NOT NULL AND _dst IS NOT NULL").distinct()
    # The start itself is marked, as a cycle may come back to it.
    found = starts.select("start", F.col("start").alias("node"), F.lit(True).alias("first"), F.lit(0).alias("depth")).distinct()
    for step in range(steps):
        met = found.join(ways, (F.col("node") == F.col("_src")) & (F.col("depth") == step), "left")
        row = lambda node, first, depth: F.struct(node.alias("node"), first.alias("first"), depth.alias("depth"))
        own, new = row(F.col("node"), F.col("first"), F.col("depth")), row(F.col("_dst"), F.lit(False), F.lit(step + 1))
        both = met.select("start", F.explode(F.when(F.col("_dst").isNull(), F.array(own)).otherwise(F.array(own, new))).alias("r"))
        found = both.groupBy("start", "r.node", "r.first").agg(F.min("r.depth").alias("depth"))
    return found.where("NOT first").select("start", "node", "depth")


def chunk_context(g: Graph, window: int = 2, near: DataFrame | None = None) -> DataFrame:
    """Chunks (all, or those of ``near``: chunk_id) with text, type, section and product, and {id, text} of the chunks
    within ``window`` NEXT edges before and after, in reading order.

    In a graph without NEXT edges chunks follow each other as ``chunking.next_edges`` has them, by product and
    sequence_order; then texts are shuffled once, and not once for each chunk that they are near to.
    """
    columns = [F.col(c) if c in g.chunk.columns else F.lit(None).cast("string").alias(c) for c in ("text", "chunk_type", "parent_section", "product_number")]
    if g.next is None:
        return _context_in_order(g.chunk.select("chunk_id", *columns, "sequence_order").withColumnRenamed("parent_section", "section"), window, near)
    centre = g.chunk.select("chunk_id", *columns).withColumnRenamed("parent_section", "section")
    centre = centre.join(near.select("chunk_id").distinct(), "chunk_id", "left_semi") if near is not None else centre
    starts = centre.select(F.col("chunk_id").alias("start"))
    before, after = within(g.next, starts, window, "dst", "src"), within(g.next, starts, window)
    reached = before.withColumn("depth", -F.col("depth")).unionByName(after)
    texts = g.chunk.select(F.col("chunk_id").alias("node"), "text")
    rows = reached.join(texts, "node").groupBy(F.col("start").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("depth", F.col("node").alias("id"), "text"))).alias("around"))
    out = centre.join(rows, "chunk_id", "left")
    side = lambda keep: F.transform(F.filter(F.coalesce("around", F.array().cast(rows.schema["around"].dataType)), keep), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text")))
    return out.select("chunk_id", "text", "chunk_type", "section", "product_number", side(lambda x: x["depth"] < 0).alias("prev_chunks"), side(lambda x: x["depth"] > 0).alias("next_chunks"))


def _context_in_order(chunks: DataFrame, window: int, near: DataFrame | None) -> DataFrame:
    order, one = Window.partitionBy("product_number").orderBy("sequence_order"), F.struct(F.col("chunk_id").alias("id"), "text")
    side = lambda of, steps: F.array_compact(F.array(*(of(one, n).over(order) for n in steps))) if window else F.array().cast("array<struct<id: string, text: string>>")
    out = chunks.select("chunk_id", "text", "chunk_type", "section", "product_number", side(F.lag, range(window, 0, -1)).alias("prev_chunks"), side(F.lead, range(1, window + 1)).alias("next_chunks"))
    return out.join(near.select("chunk_id").distinct(), "chunk_id", "left_semi") if near is not None else out


def embed_column(df: DataFrame, text: str, model: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """``df`` with an embedding of a text column.  ``model`` is made once a task; it embeds ``batch`` texts at a time."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = model()
        for series in parts:
            out: list = []
            for at in range(0, len(series), batch):
                out.extend(made(list(series[at : at + batch])))
            yield pd.Series(out)

    return df.withColumn("embedding", embed(F.col(text)))
