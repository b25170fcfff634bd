"""Registered queries over a stored graph: loaded in batches, looked up by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.operators import graph as G
from tillage.operators import text_index, vector_index
from tillage.operators.graph_store import RULES
from tillage.plans import binding as B
from tillage.plans.entity_queries import Query
from tillage.sources import calls
from tillage.sources.store import Store
from tillage.streaming.violations import shared_folder

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name] = query
    SQL[name] = sql


def new_store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def loaded_in_batches(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """Control edges of all order lines, merged in batches of rising order keys."""
    raw = B.raw_controls(spark, sf_dir).drop("l_returnflag")
    most = B.table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    store = new_store(spark)
    for i in range(batches):
        own = raw.where((F.col("l_orderkey") > most * i // batches - (i == 0)) & (F.col("l_orderkey") <= most * (i + 1) // batches))
        store.merge({"controls": G.latest(own, ["product_number", "weed", "crop"], B.WRITE_ORDER)}, RULES)
    return store.read("controls")


add(
    "graph_upsert_batches",
    loaded_in_batches,
    B.SQL + "SELECT product_number, weed, crop, rate_per_ha, application_timing, control_level, critical_comments, states FROM controls",
)


def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with a group each, of which some are loaded again with the next group: the edge to the first one stays."""
    part = B.table(spark, sf_dir, "part")
    group = lambda shift: F.char(((F.col("p_partkey") + shift) % 30 + 65).cast("int"))
    edge = lambda rows, shift: G.edges_to_known(rows.select(F.col("p_partkey").cast("string").alias("product_number"), group(shift).alias("group")), "group", G.moa_nodes(spark), "group")
    store = new_store(spark)
    for rows, shift in ((part, 0), (part.where("p_size % 2 = 0"), 1)):
        store.merge({"has_mode_of_action": G.edges(edge(rows, shift), "product_number", "group")}, RULES)
    return store.read("has_mode_of_action")


add(
    "stale_edges",
    reloaded,
    B.SQL + """SELECT product_number, g AS "group" FROM (SELECT CAST(p_partkey AS VARCHAR) AS product_number, chr(CAST(65 + p_partkey % 30 AS INTEGER)) AS g FROM part
UNION SELECT CAST(p_partkey AS VARCHAR), chr(CAST(65 + (p_partkey + 1) % 30 AS INTEGER)) FROM part WHERE p_size % 2 = 0) WHERE g IN (SELECT "group" FROM moa)""",
)


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored products of the ten dearest parts, by key."""
    store = new_store(spark)
    store.merge({"herbicide": B.graph(spark, sf_dir).herbicide}, RULES, insert=True, buckets=64)
    ten = B.table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)
    return store.lookup("herbicide", ten.select(F.col("p_partkey").alias("product_number")))


add("key_lookup", looked_up, B.SQL + "SELECT * FROM herbicide WHERE product_number IN (SELECT CAST(p_partkey AS VARCHAR) FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10)")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors most similar to one of them, by the index, proven to be the best of all."""
    vectors = B.table(spark, sf_dir, "embeddings")
    question = vectors.where("vec_id = 7").select("embedding").first()[0]
    index = vector_index.build(vectors, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", "vec_id")
    return vector_index.search(index, question, 10, exact=True).select(F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


add(
    "vector_index_topk",
    indexed,
    """WITH s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]) AS c FROM embeddings)
SELECT vec_id, round(c, 6) AS cosine, round((c + 1) / 2, 6) AS score FROM s WHERE c IS NOT NULL ORDER BY c DESC, vec_id LIMIT 10""",
)


#: Terms of a text search: of one gram and of many, over a word's end, in capitals, too short for a gram, found nowhere.
TERMS = ["ing", "einheit", "tion a", "MENT", "e.", "no such words"]


def searched_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text has a term, by the index."""
    index = text_index.build(B.table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}", "doc_id", folders=16, salts=2)
    found = None
    for term in TERMS:
        own = text_index.search(index, term).select(F.lit(term).alias("term"), F.col("id").alias("doc_id"))
        found = own if found is None else found.unionByName(own)
    return found


add("text_index_search", searched_by_index, f"SELECT term, doc_id FROM documents, (VALUES {', '.join(f"('{term}')" for term in TERMS)}) AS t(term) WHERE contains(lower(text), lower(term))")


def measured() -> calls.Caller:
    """A service that tells a text's length, and refuses some."""

    def call(text: str) -> str:
        if len(text) % 7 == 0:
            raise ValueError("a multiple of seven")
        return str(len(text))

    return call


add(
    "call_outcomes",
    lambda s, d: calls.call_each(B.table(s, d, "documents"), "doc_id", "text", measured, skip=F.length("text") < 100).select(F.col("key").alias("doc_id"), "status", "output", "error", "attempts"),
    """SELECT doc_id, CASE WHEN n < 100 THEN 'skipped' WHEN n % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN n >= 100 AND n % 7 <> 0 THEN CAST(n AS VARCHAR) END AS output,
  CASE WHEN n >= 100 AND n % 7 = 0 THEN 'ValueError: a multiple of seven' END AS error, CASE WHEN n < 100 THEN 0 ELSE 1 END::INTEGER AS attempts FROM (SELECT doc_id, length(text) AS n FROM documents)""",
)
