"""Registered retrieval and chunking queries, with their SQL.  Chunks are the lines of documents; tables are order lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillage.functions.text import strip
from tillage.operators import chunking as C
from tillage.operators import retrieval as R
from tillage.operators import table_rows as T
from tillage.operators.graph import Graph, edges, edges_to_known, few, stats
from tillage.operators.running import number, running
from tillage.plans import binding as B
from tillage.plans.entity_queries import Query
from tillage.streaming.violations import shared_folder

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
STEMS = ["tion", "heit", "ment", "ing"]
STEM_TYPE = "Stem"


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def lines_in_place(docs: DataFrame) -> DataFrame:
    """The lines of documents whose ids are all different: numbered where they are, without a shuffle."""
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("text"))), lambda x: F.length(strip(x["text"])) >= C.MIN_CHARS)
    return docs.select("product_number", "parent_section", F.posexplode_outer(kept).alias("sequence_order", "x")).where("x IS NOT NULL").select("product_number", "parent_section", "x.line", "x.text", "sequence_order")


def lines_by_id(docs: DataFrame) -> DataFrame:
    lines = docs.select("product_number", "parent_section", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).where(F.length(strip(F.col("text"))) >= C.MIN_CHARS)
    return lines.withColumn("sequence_order", F.row_number().over(Window.partitionBy("product_number").orderBy("line")) - 1)


def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each line of at least 20 characters, numbered within its document."""
    docs = B.table(spark, sf_dir, "documents")
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    docs = docs.select(F.col("doc_id").cast("string").alias("product_number"), F.concat(F.lit("in "), "lang").alias("parent_section"), "text")
    lines = lines_by_id(docs) if repeated else lines_in_place(docs)
    chunk_id = F.concat_ws("-", "product_number", F.col("line").cast("string"), F.substring(F.md5(F.concat_ws("-", "product_number", F.col("line").cast("string"), F.col("sequence_order").cast("string"))), 1, 8))
    kind = F.when(F.contains("text", F.lit("|")), "table").otherwise("text")
    return lines.select(chunk_id.alias("chunk_id"), "text", kind.alias("chunk_type"), "sequence_order", "product_number", "parent_section")


def with_vectors(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Chunks with a vector for the first of each document.  Only these meet the vectors."""
    vectors = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("product_number"), "embedding")
    first = lines.where("sequence_order = 0").join(vectors, "product_number", "left")
    others = lines.where("sequence_order > 0").withColumn("embedding", F.lit(None).cast(vectors.schema["embedding"].dataType))
    return first.unionByName(others)


def chunk_graph(spark: SparkSession, sf_dir: str) -> Graph:
    g = B.graph(spark, sf_dir)
    lines = line_texts(spark, sf_dir)
    g.chunk = with_vectors(spark, sf_dir, lines)
    g.next = C.next_edges(lines)
    words = B.table(spark, sf_dir, "documents").select(F.lower(F.substring_index("text", " ", 1)).alias("name")).where("name <> ''")
    g.links = C.Links(g.chunk, [C.Link(lines, words, STEMS, STEM_TYPE)])
    g.mentions = g.links.table
    g.contains_chunk = edges(edges_to_known(lines, "product_number", g.document, "product_number"), "product_number", "chunk_id")
    return g


CHUNKS = B.SQL.rstrip() + r"""
, pieces AS (SELECT CAST(doc_id AS VARCHAR) AS product_number, unnest(range(len(s))) AS line, unnest(s) AS text, 'in ' || lang AS parent_section FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS s FROM documents)
), numbered AS (SELECT *, row_number() OVER (PARTITION BY product_number ORDER BY line) - 1 AS sequence_order FROM pieces WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20
), chunk AS (
  SELECT product_number || '-' || line || '-' || substr(md5(product_number || '-' || line || '-' || sequence_order), 1, 8) AS chunk_id, text, CASE WHEN contains(text, '|') THEN 'table' ELSE 'text' END AS chunk_type,
    sequence_order, product_number, parent_section, CASE WHEN sequence_order = 0 THEN embedding END AS embedding
  FROM numbered LEFT JOIN embeddings ON CAST(vec_id AS VARCHAR) = product_number
), document AS (SELECT CAST(doc_id AS VARCHAR) AS product_number, source FROM documents WHERE doc_id IN (SELECT p_partkey FROM part)
), nexts AS (SELECT * FROM (SELECT chunk_id AS src, lead(chunk_id) OVER (PARTITION BY product_number ORDER BY sequence_order) AS dst FROM chunk) WHERE dst IS NOT NULL
), q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7
), scored AS (SELECT chunk.*, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS cosine FROM chunk, q WHERE embedding IS NOT NULL
), top AS (SELECT *, (cosine + 1) / 2 AS score FROM scored ORDER BY cosine DESC, chunk_id LIMIT 10
), names AS (SELECT DISTINCT lower(string_split(text, ' ')[1]) AS entity FROM documents WHERE string_split(text, ' ')[1] <> ''
), tok AS (SELECT DISTINCT chunk_id, t AS token FROM chunk, (VALUES ('tion'), ('heit'), ('ment'), ('ing')) AS p(t) WHERE contains(lower(text), t)
), mentions AS (SELECT DISTINCT chunk_id, entity, 'Stem' AS entity_type FROM tok JOIN names ON contains(entity, token))
"""


def query_vector(spark: SparkSession, sf_dir: str) -> F.Column:
    """The vector of one stored row, as a question's would be: a few numbers, read by the driver."""
    row = B.table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()
    return F.array(*(F.lit(float(x)) for x in row[0]))


def searched(**options) -> Query:
    return lambda s, d: R.vector_search(chunk_graph(s, d), query_vector(s, d), **options).select("chunk_id", "text", "chunk_type", "product_number", "document", "herbicide", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


def hits(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    g = chunk_graph(spark, sf_dir)
    return g, few(R.top_k(g.chunk, query_vector(spark, sf_dir)).select("chunk_id"))


TOP = "SELECT chunk_id, text, chunk_type, t.product_number, source AS document, product_name AS herbicide, round(cosine, 6) AS cosine, round(score, 6) AS score FROM {top} t LEFT JOIN document USING (product_number) LEFT JOIN herbicide USING (product_number)"
add("vector_topk", searched(), CHUNKS + TOP.format(top="top"))
add("vector_topk_filtered", searched(chunk_type="text"), CHUNKS + TOP.format(top="(SELECT * FROM top WHERE chunk_type = 'text')"))
add("vector_topk_prefiltered", searched(k=5, chunk_type="table", prefilter=True), CHUNKS + TOP.format(top="(SELECT *, (cosine + 1) / 2 AS score FROM scored WHERE chunk_type = 'table' ORDER BY cosine DESC, chunk_id LIMIT 5)"))
add(
    "vector_neighbours",
    lambda s, d: B.table(s, d, "embeddings").select("vec_id", "label", F.round(R.cosine(F.col("embedding"), query_vector(s, d)), 6).alias("cosine")),
    "SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]), 6) AS cosine FROM embeddings",
)
add(
    "hybrid_chunks",
    lambda s, d: R.adjacent(*hits(s, d)),
    CHUNKS + """SELECT top.chunk_id, top.text, top.chunk_type, top.parent_section AS section, top.product_number, p.src AS prev_id, pc.text AS prev_text, n.dst AS next_id, nc.text AS next_text
FROM top LEFT JOIN nexts p ON p.dst = top.chunk_id LEFT JOIN chunk pc ON pc.chunk_id = p.src LEFT JOIN nexts n ON n.src = top.chunk_id LEFT JOIN chunk nc ON nc.chunk_id = n.dst""",
)
add("hybrid_mentions", lambda s, d: R.mentioned(*hits(s, d), brief=True), CHUNKS + "SELECT entity_type, entity, list_sort(list(DISTINCT chunk_id)) AS chunk_ids FROM mentions JOIN top USING (chunk_id) GROUP BY 1, 2")
add(
    "hybrid_herbicides",
    lambda s, d: R.related_products(*hits(s, d), brief=True).withColumn("controls", F.transform("controls", lambda c: F.concat_ws("|", *(c[f] for f in ("weed", "crop", "rate", "timing", "control_level"))))),
    CHUNKS + """SELECT product_number, product_name, active_constituent, "group" AS moa_group, coalesce(cs, []) AS controls FROM (SELECT DISTINCT product_number FROM top) JOIN document USING (product_number) JOIN herbicide USING (product_number) LEFT JOIN has_moa USING (product_number)
LEFT JOIN (SELECT product_number, list(concat_ws('|', weed, crop, rate_per_ha, application_timing, control_level) ORDER BY weed, crop, rate_per_ha, application_timing, control_level)[1:10] AS cs FROM controls GROUP BY 1) USING (product_number)""",
)


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hybrid search in one call; its parts joined to the hits."""
    vector = B.table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()[0]
    found = R.hybrid_search(chunk_graph(spark, sf_dir), "a question", lambda text: vector, 10)
    mentions = found["mentions"].select("entity", F.explode("chunk_ids").alias("chunk_id")).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_mentions"))
    herbicides = found["herbicides"].select("product_number", "moa_group", F.size("controls").alias("n_controls"))
    hits = found["hits"].select("chunk_id", "product_number", F.round("score", 6).alias("score"))
    return hits.join(found["chunks"].select("chunk_id", "prev_id", "next_id"), "chunk_id").join(mentions, "chunk_id", "left").join(herbicides, "product_number", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_mentions", "n_controls")})


add(
    "hybrid_search",
    hybrid,
    CHUNKS + """SELECT product_number, chunk_id, round(score, 6) AS score, p.src AS prev_id, n.dst AS next_id, coalesce(n_mentions, 0) AS n_mentions, h.moa_group, coalesce(n_controls, 0)::INTEGER AS n_controls FROM top LEFT JOIN nexts p ON p.dst = chunk_id LEFT JOIN nexts n ON n.src = chunk_id
LEFT JOIN (SELECT chunk_id, count(*) AS n_mentions FROM mentions GROUP BY 1) USING (chunk_id)
LEFT JOIN (SELECT product_number, "group" AS moa_group, coalesce(n, 0)::INTEGER AS n_controls FROM document JOIN herbicide USING (product_number) LEFT JOIN has_moa USING (product_number) LEFT JOIN (SELECT product_number, least(10, count(DISTINCT concat_ws('|', weed, crop, control_level))) AS n FROM controls GROUP BY 1) USING (product_number)) h USING (product_number)""",
)
add("chunk_ids", lambda s, d: line_texts(s, d).select("chunk_id", "chunk_type", "sequence_order", "product_number"), CHUNKS + "SELECT chunk_id, chunk_type, sequence_order, product_number FROM chunk")
add("next_edges", lambda s, d: C.next_edges(line_texts(s, d)), CHUNKS + "SELECT src, dst FROM nexts")
add(
    "chunk_context",
    lambda s, d: R.chunk_context(Graph(chunk=line_texts(s, d))).withColumns({side: F.transform(side, lambda x: F.concat_ws("|", x["id"], x["text"])) for side in ("prev_chunks", "next_chunks")}),
    CHUNKS + """SELECT c.chunk_id, c.text, c.chunk_type, c.parent_section AS section, c.product_number,
  coalesce(list(o.chunk_id || '|' || o.text ORDER BY o.sequence_order) FILTER (o.sequence_order < c.sequence_order), []) AS prev_chunks, coalesce(list(o.chunk_id || '|' || o.text ORDER BY o.sequence_order) FILTER (o.sequence_order > c.sequence_order), []) AS next_chunks
FROM chunk c LEFT JOIN chunk o ON o.product_number = c.product_number AND abs(o.sequence_order - c.sequence_order) BETWEEN 1 AND 2 GROUP BY ALL""",
)
add(
    "bounded_paths",
    lambda s, d: R.within(
        B.table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), B.table(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("start")), 3
    ),
    """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), w(start, node, depth) AS (
  SELECT p_partkey, dst, 1 FROM part JOIN e ON src = p_partkey WHERE p_size = 1 UNION SELECT start, dst, depth + 1 FROM w JOIN e ON src = node WHERE depth < 3)
SELECT start, node, min(depth) AS depth FROM w GROUP BY 1, 2""",
)
add("mentions_link", lambda s, d: chunk_graph(s, d).mentions, CHUNKS + "SELECT chunk_id, entity, entity_type FROM mentions")
FOR = """, hits AS (SELECT chunk_id, entity, 1.0::DOUBLE AS score FROM mentions WHERE contains(lower(entity), '{0}') UNION SELECT chunk_id, NULL, 0.8::DOUBLE FROM chunk WHERE contains(lower(text), '{0}'))
SELECT chunk_id, h.entity, h.score, text, chunk_type, product_number, source AS document, product_name AS herbicide
FROM (SELECT hits.*, text, chunk_type, product_number FROM hits JOIN chunk USING (chunk_id) ORDER BY score DESC, chunk_id, entity NULLS LAST LIMIT 25) h LEFT JOIN document USING (product_number) LEFT JOIN herbicide USING (product_number)"""
for name, term in (("chunks_for_weed", "thtion"), ("chunks_for_crop", "einheit")):
    add(name, lambda s, d, term=term: R.chunks_for(chunk_graph(s, d), term, STEM_TYPE, 25), CHUNKS.rstrip() + FOR.format(term))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as a layout model would give them: for each product one of each return flag, with or without Markdown."""
    raw = B.raw_controls(spark, sf_dir)
    line = F.array("crop", "weed", F.col("states")[0], F.concat("rate_per_ha", F.when(F.col("l_returnflag") == "A", " L/ha").otherwise(" parts")), "critical_comments")
    cut = F.when(F.col("l_returnflag") == "R", F.slice(line, 4, 2)).otherwise(line)
    rows = raw.groupBy("product_number", "l_returnflag").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_extendedprice", cut.alias("cells")))), lambda x: x["cells"]).alias("lines"))
    head = F.when(F.col("l_returnflag") == "A", F.array(F.array(*map(F.lit, ("crop", "name", "place", "amount", "notes"))))).when(F.col("l_returnflag") == "N", F.array(F.array(*map(F.lit, ("place", "name", "where", "how", "harvest")))))
    full = F.concat(F.coalesce(head, F.array().cast("array<array<string>>")), F.col("lines"))
    position = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return rows.select(
        "product_number", position.alias("position"), F.concat(F.lit("t"), position.cast("string")).alias("table_id"), full.alias("rows"), F.lit(None).cast("string").alias("markdown"), F.size(full[0]).alias("column_count"), F.size(full).alias("row_count"), F.lit(None).cast("int").alias("page"),
    )


STATS = {
    "herbicide": "herbicide", "active_constituent": "(SELECT DISTINCT active_constituent FROM herbicide)", "mode_of_action": "moa", "crop": "crop", "weed": "weed", "state": "region", "document": "document", "chunk": "chunk",
    "contains": "herbicide", "has_mode_of_action": "has_moa", "registered_for": "registered_for", "controls": "controls", "has_label": "document", "contains_chunk": "(SELECT * FROM chunk WHERE product_number IN (SELECT product_number FROM document))",
    "next": "nexts", "mentions": "mentions",
}
add("graph_stats", lambda s, d: stats(chunk_graph(s, d)), CHUNKS + " UNION ALL ".join(f"SELECT '{name}' AS name, (SELECT count(*) FROM {source}) AS total" for name, source in STATS.items()))
#: A stem of the documents' invented words, and the name written in its place.
PLANTED = {"tion": "ryegrass ", "heit": " Wild  Oats", "ment": "fat\nhen", "ing": "Wheat"}


def planted_text() -> F.Column:
    text = F.col("text")
    for stem, name in PLANTED.items():
        text = F.replace(text, F.lit(stem), F.lit(name))
    return text


# A line end between two words of a name is white space to the pattern, but stays when spaces are squashed.
add(
    "mention_tokens",
    lambda s, d: B.table(s, d, "documents").select("doc_id", F.array_join(C.mentions(planted_text(), C.WEEDS), ",").alias("weeds"), F.array_join(C.mentions(planted_text(), C.CROPS), ",").alias("crops")),
    """WITH d AS (SELECT doc_id, lower(replace(replace(replace(replace(text, 'tion', 'ryegrass '), 'heit', ' Wild  Oats'), 'ment', 'fat' || chr(10) || 'hen'), 'ing', 'Wheat')) AS t FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN contains(t, 'fat' || chr(10) || 'hen') THEN 'fat' || chr(10) || 'hen' END, CASE WHEN contains(t, 'ryegrass') THEN 'ryegrass' END, CASE WHEN contains(t, 'wild  oats') THEN 'wildoats' END) AS weeds,
  concat_ws(',', CASE WHEN contains(t, 'oats') THEN 'oats' END, CASE WHEN contains(t, 'wheat') THEN 'wheat' END) AS crops FROM d""",
)


TABLES = B.SQL.rstrip() + """
, lines AS (SELECT product_number, l_returnflag AS f, list(CASE WHEN l_returnflag = 'R' THEN rate_per_ha || ' parts | ' || critical_comments ELSE crop || ' | ' || weed || ' | ' || states[1] || ' | ' || rate_per_ha || CASE WHEN l_returnflag = 'A' THEN ' L/ha' ELSE ' parts' END || ' | ' || critical_comments END ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS ls FROM raw GROUP BY 1, 2
), tab AS (SELECT product_number, CASE f WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS position, CASE f WHEN 'R' THEN 2 ELSE 5 END AS n_cols, CASE f WHEN 'A' THEN ['crop | name | place | amount | notes'] WHEN 'N' THEN ['place | name | where | how | harvest'] ELSE [] END || ls AS rs FROM lines
), sec AS (SELECT *, CASE position WHEN 0 THEN 'directions_for_use' WHEN 1 THEN 'withholding_period' ELSE 'metadata' END AS section FROM tab)
"""
add("section_classify", lambda s, d: order_tables(s, d).select("product_number", "position", C.section(F.col("markdown"), F.col("rows"), F.col("column_count")).alias("section")), TABLES + "SELECT product_number, position, section FROM sec")
TABLE_CHUNKS = TABLES.rstrip() + r""", t AS (SELECT product_number, position, 't' || position AS table_id, rs, n_cols, section, array_to_string(rs, chr(10)) AS text FROM sec
), u AS (SELECT *, len(regexp_extract_all(text, '\S+')) AS est, CASE WHEN n_cols >= 3 THEN rs[2:] ELSE rs END AS data, CASE WHEN n_cols >= 3 THEN rs[1] ELSE '' END AS headers FROM t WHERE length(trim(text)) >= 20
), v AS (SELECT *, est > 60 AND len(rs) > 3 AS splits, greatest(1, len(data) // (est // 60 + 1)) AS per FROM u
), w AS (SELECT *, CASE WHEN splits THEN (len(data) + per - 1) // per ELSE 1 END AS n FROM v
), x AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY product_number ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seq FROM w
), y AS (SELECT *, substr(md5(product_number || '-' || table_id || '-' || seq), 1, 8) AS hash, unnest(range(n)) AS part FROM x)
SELECT product_number || '-' || table_id || CASE WHEN splits THEN '-part' || part ELSE '' END || '-' || hash AS chunk_id,
  CASE WHEN splits THEN CASE WHEN headers <> '' THEN headers || chr(10) ELSE '' END || array_to_string(data[part * per + 1 : (part + 1) * per], chr(10)) ELSE text END AS text,
  CASE WHEN position = 0 AND len(rs) >= 3 THEN 'weed_table' WHEN section = 'directions_for_use' THEN 'directions' WHEN section = 'metadata' OR n_cols <= 2 THEN 'metadata' ELSE 'table' END AS chunk_type,
  seq + part AS sequence_order, product_number, section AS parent_section, table_id,
  CASE WHEN splits THEN len(data[part * per + 1 : (part + 1) * per]) ELSE len(rs) END::INTEGER AS row_count, n_cols::INTEGER AS column_count, headers FROM y"""
add(
    "table_chunks",
    lambda s, d: C.chunk_tables(order_tables(s, d), max_tokens=60).withColumn("headers", F.array_join("headers", " | ")).drop("page_number"),  # order lines have no pages
    TABLE_CHUNKS,
)


def order_table_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tables of ``order_tables`` and their rows, numbered without gathering a table's lines."""
    raw = B.raw_controls(spark, sf_dir)
    line = F.array("crop", "weed", F.col("states")[0], F.concat("rate_per_ha", F.when(F.col("l_returnflag") == "A", " L/ha").otherwise(" parts")), "critical_comments")
    position = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    lines = raw.select("product_number", position.alias("position"), *B.WRITE_ORDER, F.when(F.col("l_returnflag") == "R", F.slice(line, 4, 2)).otherwise(line).alias("cells"))
    headed = F.col("position") < 2
    rows = number(lines, T.KEYS, "l_orderkey", "n", ("l_linenumber", "l_extendedprice", "cells")).select(*T.KEYS, (F.col("n") + headed.cast("int")).alias("row"), "cells")
    tables = lines.groupBy(*T.KEYS).agg(F.count(F.lit(1)).alias("lines")).select(
        *T.KEYS, F.concat(F.lit("t"), F.col("position").cast("string")).alias("table_id"), F.lit(None).cast("string").alias("markdown"), F.when(headed, 5).otherwise(2).alias("column_count"),
        (F.col("lines") + headed.cast("int")).cast("int").alias("row_count"), F.lit(None).cast("int").alias("page"),
    )
    heads = F.when(F.col("position") == 0, F.array(*map(F.lit, ("crop", "name", "place", "amount", "notes")))).otherwise(F.array(*map(F.lit, ("place", "name", "where", "how", "harvest"))))
    return tables, rows.unionByName(tables.where(headed).select(*T.KEYS, F.lit(0).cast("long").alias("row"), heads.alias("cells")))


def table_chunks_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of ``table_chunks``, of rows and not of arrays."""
    tables, rows = order_table_rows(spark, sf_dir)
    scratch = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    rows.write.parquet(f"{scratch}/rows")  # numbered once, as rows are read four times
    chunks = T.chunk_table_rows(tables, spark.read.parquet(f"{scratch}/rows"), f"{scratch}/facts", max_tokens=60)
    return chunks.withColumn("headers", F.array_join("headers", " | ")).drop("page_number")


add("table_chunks_by_rows", table_chunks_by_rows, TABLE_CHUNKS)
add(
    "running_totals",
    lambda s, d: running(B.table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_quantity").cast("long").alias("quantity"), "l_returnflag"), ["l_returnflag"], "l_orderkey", {"lines_before": F.lit(1), "quantity_before": F.col("quantity")}, {"last_large": F.when(F.col("quantity") >= 49, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey"))}, ("l_linenumber", "l_extendedprice", "l_suppkey", "quantity")),
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, quantity, l_returnflag, count(*) OVER w AS lines_before, coalesce(sum(quantity) OVER w, 0)::BIGINT AS quantity_before,
  last_value(CASE WHEN quantity >= 49 THEN concat_ws('-', l_orderkey, l_linenumber, l_suppkey) END IGNORE NULLS) OVER w AS last_large
FROM (SELECT *, l_quantity::BIGINT AS quantity FROM lineitem)
WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_suppkey, quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
add(
    "chunk_contexts",
    lambda s, d: C.chunk_tables(order_tables(s, d), max_tokens=60).select("chunk_id", F.sha2(C.contextualize(F.col("product_number"), F.nullif("parent_section", F.lit("metadata")), F.col("chunk_type"), F.col("text")), 256).alias("text_sha256")),
    f"""SELECT chunk_id, sha256('[Product: ' || product_number || '] ' || CASE WHEN parent_section <> 'metadata' THEN '[Section: ' || parent_section || '] ' ELSE '' END
  || CASE chunk_type WHEN 'weed_table' THEN '[Weed Control Table] ' WHEN 'directions' THEN '[Directions for Use] ' ELSE '' END || text) AS text_sha256 FROM ({TABLE_CHUNKS})""",
)
add(
    "weed_tables",
    lambda s, d: order_tables(s, d).select("product_number", "position", C.is_weed_table(F.col("rows")).alias("weed_table")),
    TABLES + "SELECT product_number, position, len(rs) >= 3 AND position = 0 AS weed_table FROM sec",
)
