"""The graph over the star-schema tables: parts are products, suppliers weeds, nations crops, regions states.

``SQL`` is the same binding as common table expressions, for checking queries against another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.operators.graph import MOA_GROUPS, Graph, edges, latest, moa_nodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A control entry for each order line, with the order of writing."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    level = F.when(F.col("l_returnflag") == "A", "control").when(F.col("l_returnflag") == "R", "suppression").otherwise("partial")
    return rows.select(
        F.col("l_partkey").cast("string").alias("product_number"), F.concat(F.lit("supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("weed"), F.lower("n_name").alias("crop"),
        F.col("l_quantity").cast("long").cast("string").alias("rate_per_ha"), F.col("l_linestatus").alias("application_timing"), level.alias("control_level"), F.col("o_orderpriority").alias("critical_comments"),
        F.array("r_name").alias("states"), "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice",
    )


WRITE_ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice"]


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    part, supplier, nation, region = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation", "region"))
    raw = raw_controls(spark, sf_dir)
    herbicide = part.select(
        F.col("p_partkey").cast("string").alias("product_number"), F.col("p_name").alias("product_name"), F.col("p_type").alias("active_constituent"), F.col("p_brand").alias("chemical_group"),
        F.when(F.col("p_size") % 7 != 0, F.concat(F.col("p_size").cast("string"), F.lit(" days"))).alias("withholding_period"),
    )
    index = F.col("p_partkey") % 20
    has_moa = part.where(index < 19).select(F.col("p_partkey").cast("string").alias("product_number"), F.when(index == 18, "Z").otherwise(F.char((index + 65).cast("int"))).alias("group"))
    weed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lower("s_name").alias("common_name"), F.col("s_name").alias("display_name"), F.when(F.col("s_suppkey") % 3 != 0, F.lower("n_name")).alias("scientific_name"))
    document = table(spark, sf_dir, "documents").join(part.select(F.col("p_partkey").alias("doc_id")), "doc_id", "left_semi")
    return Graph(
        herbicide=herbicide, mode_of_action=moa_nodes(spark), has_mode_of_action=has_moa, weed=weed,
        crop=nation.select(F.lower("n_name").alias("name"), F.col("n_name").alias("display_name")), state=region.select(F.col("r_name").alias("code"), F.col("r_name").alias("name")),
        active_constituent=herbicide.select(F.col("active_constituent").alias("name")).distinct(), contains=edges(herbicide, "product_number", "active_constituent"),
        controls=latest(raw.drop("l_returnflag"), ["product_number", "weed", "crop"], WRITE_ORDER),
        registered_for=raw.where("l_returnflag <> 'N'").select("product_number", F.col("crop").alias("name")).distinct(), registered_in=raw.select("product_number", F.col("states")[0].alias("code")).distinct(),
        document=document.select(F.col("doc_id").cast("string").alias("product_number"), "source"), has_label=document.select(F.col("doc_id").cast("string").alias("product_number")),
    )


_MOA = ", ".join("('" + "', '".join(x.replace("'", "''") for x in row) + "')" for row in MOA_GROUPS)
SQL = f"""WITH herbicide AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_number, p_name AS product_name, p_type AS active_constituent, p_brand AS chemical_group,
    CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS VARCHAR) || ' days' END AS withholding_period FROM part
), moa("group", description, chemical_classes) AS (VALUES {_MOA}
), has_moa AS (SELECT CAST(p_partkey AS VARCHAR) AS product_number, CASE WHEN p_partkey % 20 = 18 THEN 'Z' ELSE chr(CAST(65 + p_partkey % 20 AS INTEGER)) END AS "group" FROM part WHERE p_partkey % 20 < 19
), product_moa AS (SELECT product_number, moa."group" AS moa_group, description AS moa_description FROM has_moa JOIN moa USING ("group")
), weed AS (SELECT lower(s_name) AS common_name, s_name AS display_name, CASE WHEN s_suppkey % 3 <> 0 THEN lower(n_name) END AS scientific_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
), crop AS (SELECT lower(n_name) AS name, n_name AS display_name FROM nation
), raw AS (
  SELECT CAST(l_partkey AS VARCHAR) AS product_number, 'supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS weed, lower(n_name) AS crop, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS rate_per_ha,
    l_linestatus AS application_timing, CASE l_returnflag WHEN 'A' THEN 'control' WHEN 'R' THEN 'suppression' ELSE 'partial' END AS control_level, o_orderpriority AS critical_comments,
    [r_name] AS states, l_returnflag, l_orderkey, l_linenumber, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), controls AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_number, weed, crop ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn FROM raw) WHERE rn = 1
), registered_for AS (SELECT DISTINCT product_number, crop AS name FROM raw WHERE l_returnflag <> 'N'
), registered_in AS (SELECT DISTINCT product_number, states[1] AS code FROM raw
), facts AS (SELECT c.*, h.product_name, h.active_constituent, w.display_name AS weed_display, w.common_name, w.scientific_name FROM controls c JOIN herbicide h USING (product_number) JOIN weed w ON c.weed = w.common_name
)
"""
