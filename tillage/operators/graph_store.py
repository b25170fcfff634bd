"""A graph that is kept and loaded in batches: nodes and edges are merged by key, and edges of earlier loads stay."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from tillage.operators import answers
from tillage.operators.graph import Graph, load_labels, moa_nodes, state_nodes
from tillage.sources.store import BUCKETS, Rule, Store

#: What makes a node or an edge one; only a control edge has properties besides.
RULES = {
    "herbicide": Rule(("product_number",)),
    "active_constituent": Rule(("name",)),
    "mode_of_action": Rule(("group",)),
    "crop": Rule(("name",)),
    "weed": Rule(("common_name",), known=("scientific_name",)),
    "state": Rule(("code",)),
    "document": Rule(("product_number",)),
    "chunk": Rule(("chunk_id",)),
    "contains": Rule(("product_number", "active_constituent")),
    "has_mode_of_action": Rule(("product_number", "group")),
    "registered_for": Rule(("product_number", "name")),
    "registered_in": Rule(("product_number", "code")),
    "controls": Rule(("product_number", "weed", "crop")),
    "has_label": Rule(("product_number",)),
    "contains_chunk": Rule(("product_number", "chunk_id")),
    "next": Rule(("src", "dst")),
    "mentions": Rule(("chunk_id", "entity", "entity_type")),
}


def init_schema(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Store:
    """The store at ``path``, with the fixed states and modes of action in it.  Key constraints hold from here on."""
    store = Store(spark, path)
    if not {"state", "mode_of_action"} <= set(store.names()):
        store.merge({"state": state_nodes(spark), "mode_of_action": moa_nodes(spark)}, RULES, buckets=buckets)
    return store


def merge_graph(store: Store, g: Graph, buckets: int = BUCKETS) -> int:
    """Add a graph to the stored one, as one version; a later value replaces an earlier one, edges join."""
    return store.merge(g.tables(), RULES, buckets=buckets)


def load_label_batch(store: Store, records: DataFrame, seq: str = "seq", buckets: int = BUCKETS) -> DataFrame:
    """Add label records to the stored graph.  Within the batch later ``seq`` wins; the batch wins over what is stored.
    Returns the counters of the batch: entries, not distinct nodes."""
    g = load_labels(records, seq)
    g.mode_of_action = g.state = None  # stored once, by init_schema
    merge_graph(store, g, buckets)
    return g.loaded


def load_chunk_batch(store: Store, chunks: DataFrame, documents: DataFrame, squash: bool = True, buckets: int = BUCKETS) -> int:
    """Add chunks and their documents; labels are linked to stored products, mentions to stored weeds and crops."""
    stored = open_graph(store)
    g = answers.load_chunks(stored, chunks, documents, squash=squash)
    return merge_graph(store, Graph(**{n: getattr(g, n) for n in ("document", "chunk", "has_label", "contains_chunk", "next", "mentions")}), buckets)


def open_graph(store: Store, version: int | None = None) -> Graph:
    """The stored graph as of a version; parts that were never loaded are None."""
    found = store.manifest(version)["tables"]
    return Graph(**{f.name: store._rows(found[f.name]) for f in fields(Graph) if f.name in found})
