"""Answers as text, from the first few rows of a question's result, and chunks loaded into a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.text import preview
from tillage.operators import chunking, entities, retrieval
from tillage.operators.graph import Graph, edges, edges_to_known, latest


def load_chunks(g: Graph, chunks: DataFrame, documents: DataFrame, squash: bool = True) -> Graph:
    """Put chunks (chunk_tables() with or without embeddings) and their documents (product_number, source, seq) into the
    graph: documents, labels of known products, chunks, their order and what they mention."""
    counted = documents.join(chunks.groupBy("product_number").agg(F.count(F.lit(1)).alias("chunk_count")), "product_number", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    g.document = latest(counted, ["product_number"], ["seq"])
    g.has_label = edges(edges_to_known(g.document, "product_number", g.herbicide, "product_number"), "product_number")
    g.chunk = chunks
    g.contains_chunk = edges(chunks, "product_number", "chunk_id")
    g.next = chunking.next_edges(chunks)
    weeds, crops = g.weed.select(F.col("common_name").alias("name")), g.crop.select("name")
    g.links = chunking.Links(chunks, [chunking.Link(chunks, weeds, chunking.WEEDS, "Weed", squash), chunking.Link(chunks, crops, chunking.CROPS, "Crop", squash)])
    g.mentions = g.links.table
    return g


def _lines(title: str, rows: list, line: Callable) -> str:
    return "\n".join([title, *(line(i + 1, r) for i, r in enumerate(rows))])


def describe_vector_search(g: Graph, text: str, embed: Callable[[str], list[float]], k: int = 5, chunk_type: str | None = None) -> str:
    found = retrieval.hybrid_search(g, text, embed, k, expand_graph=False, chunk_type=chunk_type)["hits"]
    rows = found.withColumn("text", preview(F.col("text"), 500)).orderBy(F.desc("score"), "chunk_id").collect()  # k rows
    return _lines(f"Found {len(rows)} chunks:", rows, lambda i, r: f"{i}. [{r.chunk_id}] {r.herbicide or r.product_number} ({r.score:.3f}): {r.text}") if rows else "No matching chunks."


def describe_entity(g: Graph, entity_type: str, name: str, include_controls: bool = True) -> str:
    """Products for a weed or a crop, or the details of a product, with the first of what it controls."""
    entity_type = entity_type.lower()
    if entity_type == "weed":
        rows = entities.find_products_for_weed(g, name).limit(10).collect()
        return _lines(f"Products that control {name}:", rows, lambda i, r: f"{i}. {r.herbicide} ({r.product_number}), group {r.moa_group or '-'}: {r.crop}, {r.rate_per_ha}") if rows else f"No products found for weed {name}."
    if entity_type == "crop":
        rows = entities.find_products_for_crop(g, name).limit(10).collect()
        return _lines(f"Products for {name}:", rows, lambda i, r: f"{i}. {r.herbicide} ({r.product_number}): {', '.join(r.weeds_controlled[:5]) or '-'}") if rows else f"No products found for crop {name}."
    if entity_type == "herbicide":
        r = entities.product_details(g, name).withColumn("controls", F.slice(F.filter("controls", lambda c: c["weed"].isNotNull()), 1, 5)).first()
        controls = "".join(f"\n- {c.weed} in {c.crop}: {c.rate}" for c in r.controls) if r and include_controls else ""
        return f"{r.product_name} ({r.product_number}): {r.active_constituent}, group {r.moa_group or '-'}; crops {', '.join(r.crops) or '-'}; states {', '.join(r.states) or '-'}{controls}" if r else f"No product {name}."
    return f"Unknown kind of entity: {entity_type}."


def describe_rotation(g: Graph, current: str, crop: str, weed: str) -> str:
    rows = entities.moa_rotation(g, current, crop, weed).withColumn("options", F.slice("options", 1, 3)).collect()  # at most one row a group
    return _lines(f"Instead of group {current} against {weed} in {crop}:", rows, lambda i, r: f"{i}. Group {r.moa_group} ({r.moa_description}): {', '.join(o.herbicide for o in r.options)}") if rows else "No other group controls it."


def describe_hybrid(g: Graph, text: str, embed: Callable[[str], list[float]], k: int = 5, expand_graph: bool = True) -> str:
    found = retrieval.hybrid_search(g, text, embed, k, expand_graph)
    chunks = found["chunks" if expand_graph else "hits"].withColumn("text", preview(F.col("text"), 300, one_line=True)).orderBy("chunk_id").limit(5).collect()
    described = _lines("Chunks:", chunks, lambda i, r: f"{i}. {r.text}")
    if not expand_graph:
        return described
    products = found["herbicides"].orderBy("product_number").limit(3).collect()
    return described + "\n" + _lines("Products:", products, lambda i, r: f"{i}. {r.product_name} (group {r.moa_group or '-'}): {'; '.join(f'{c.weed} in {c.crop} at {c.rate or "-"}' for c in r.controls[:5])}")
