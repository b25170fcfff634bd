"""Registered questions about products, weeds and crops, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.operators import entities as E
from tillage.operators import graph as G
from tillage.plans import binding as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def on_graph(build: Callable[[G.Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(B.graph(spark, sf_dir))


def joined(column: str) -> F.Column:
    """An array of structs as sorted strings, which any engine compares alike."""
    fields = {"options": ("herbicide", "product_number", "active_constituent", "rate", "timing", "control_level"), "controls": ("weed", "crop", "rate", "timing", "control_level")}
    return F.array_sort(F.transform(column, lambda x: F.concat_ws("|", *(x[f] for f in fields[column]))))


FOR_WEED = """SELECT product_name AS herbicide, product_number, active_constituent, moa_group, moa_description, weed_display AS weed, crop, rate_per_ha, application_timing, control_level, states, critical_comments
FROM facts {join} JOIN product_moa USING (product_number) WHERE {where}"""
LIKE = "(contains(lower(common_name), '{0}') OR contains(lower(weed_display), '{0}'))"

add("find_products_for_weed", on_graph(lambda g: E.find_products_for_weed(g, "#00000000")), B.SQL + FOR_WEED.format(join="LEFT", where=LIKE.format("#00000000")))
add(
    "find_products_for_weed_crop_state",
    on_graph(lambda g: E.find_products_for_weed(g, "Supplier#00000001", crop="Nation_1", state="asia")),
    B.SQL + FOR_WEED.format(join="LEFT", where=LIKE.format("supplier#00000001") + " AND contains(crop, 'nation_1') AND list_contains(states, 'ASIA')"),
)
add(
    "find_products_for_weed_loose",
    on_graph(lambda g: E.find_products_for_weed(g, "Supplier#00000000", crop="nation_2", strict=False)),
    B.SQL + FOR_WEED.format(join="LEFT", where="contains(lower(common_name), 'supplier#00000000') OR (contains(lower(weed_display), 'supplier#00000000') AND contains(crop, 'nation_2'))"),
)
add("find_products_for_weed_exclude_moa", on_graph(lambda g: E.find_products_for_weed(g, "#00000000", exclude_moa="A")), B.SQL + FOR_WEED.format(join="INNER", where=LIKE.format("#00000000") + " AND moa_group <> 'A'"))

FOR_CROP = """, there AS (SELECT product_number, list_sort(list(DISTINCT weed_display)) AS weeds FROM facts WHERE contains(crop, 'nation_7'){state} GROUP BY product_number)
SELECT h.product_name AS herbicide, h.product_number, h.active_constituent, m.moa_group, c.display_name AS crop, coalesce(weeds, []) AS weeds_controlled
FROM registered_for r JOIN crop c USING (name) JOIN herbicide h USING (product_number) LEFT JOIN product_moa m USING (product_number) LEFT JOIN there t USING (product_number)
WHERE contains(name, 'nation_7')"""
add("products_for_crop", on_graph(lambda g: E.find_products_for_crop(g, "NATION_7")), B.SQL.rstrip() + FOR_CROP.format(state=""))
add("products_for_crop_state", on_graph(lambda g: E.find_products_for_crop(g, "NATION_7", "africa")), B.SQL.rstrip() + FOR_CROP.format(state=" AND list_contains(states, 'AFRICA')"))
add(
    "moa_rotation",
    on_graph(lambda g: E.moa_rotation(g, "B", "nation_1", "#00000000").withColumn("options", joined("options"))),
    B.SQL + """SELECT moa_group, moa_description, list_sort(list(DISTINCT concat_ws('|', product_name, product_number, active_constituent, rate_per_ha, application_timing, control_level))) AS options
FROM facts JOIN product_moa USING (product_number) WHERE """ + LIKE.format("#00000000") + " AND contains(crop, 'nation_1') AND moa_group <> 'B' GROUP BY moa_group, moa_description",
)
add(
    "product_details",
    on_graph(lambda g: E.product_details(g).withColumn("controls", joined("controls"))),
    B.SQL.rstrip() + """, cr AS (SELECT product_number, list_sort(list(DISTINCT display_name)) AS crops FROM registered_for JOIN crop USING (name) GROUP BY 1
), st AS (SELECT product_number, list_sort(list(DISTINCT code)) AS states FROM registered_in GROUP BY 1
), ct AS (SELECT product_number, list_sort(list(DISTINCT concat_ws('|', weed_display, crop, rate_per_ha, application_timing, control_level))) AS controls FROM facts GROUP BY 1)
SELECT product_number, product_name, active_constituent, chemical_group, withholding_period, moa_group, moa_description, coalesce(crops, []) AS crops, coalesce(states, []) AS states,
  coalesce(controls, ['']) AS controls
FROM herbicide LEFT JOIN product_moa USING (product_number) LEFT JOIN cr USING (product_number) LEFT JOIN st USING (product_number) LEFT JOIN ct USING (product_number)""",
)
add(
    "search_weeds",
    on_graph(lambda g: E.search_weeds(g, "nation_1")),
    B.SQL + """SELECT common_name AS name, display_name, scientific_name, count(DISTINCT product_number) AS herbicide_count FROM weed LEFT JOIN controls c ON c.weed = common_name
WHERE contains(common_name, 'nation_1') OR contains(lower(display_name), 'nation_1') OR contains(scientific_name, 'nation_1') GROUP BY 1, 2, 3 ORDER BY 1 LIMIT 20""",
)
add(
    "search_crops",
    on_graph(lambda g: E.search_crops(g, "Nation_2")),
    B.SQL + "SELECT c.name, display_name, count(DISTINCT product_number) AS herbicide_count FROM crop c LEFT JOIN registered_for r ON r.name = c.name WHERE contains(c.name, 'nation_2') GROUP BY 1, 2 ORDER BY 1 LIMIT 20",
)
add(
    "graph_totals",
    on_graph(E.graph_totals),
    B.SQL + "SELECT (SELECT count(*) FROM herbicide) AS total_herbicides, (SELECT count(*) FROM crop) AS total_crops, (SELECT count(*) FROM weed) AS total_weeds, (SELECT count(*) FROM controls) AS total_control_relationships",
)
add("top_weeds", on_graph(E.top_weeds), B.SQL + "SELECT weed, count(DISTINCT product_number) AS herbicide_count FROM controls GROUP BY weed ORDER BY 2 DESC, 1 LIMIT 10")
add("top_crops", on_graph(E.top_crops), B.SQL + "SELECT name AS crop, count(DISTINCT product_number) AS herbicide_count FROM registered_for GROUP BY name ORDER BY 2 DESC, 1 LIMIT 10")
add("common_moa", on_graph(E.common_moa), B.SQL + "SELECT moa_group AS moa, moa_description AS description, count(*) AS count FROM product_moa GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 5")
add(
    "count_for_weed",
    on_graph(lambda g: E.ask(g, "How many herbicides control Supplier#00000000?")),
    B.SQL + "SELECT coalesce(max(n), 0) AS count, max(weed) AS weed FROM (SELECT weed, count(DISTINCT product_number) AS n FROM controls WHERE contains(weed, 'supplier#00000000') GROUP BY weed ORDER BY weed LIMIT 1)",
)
add(
    "upsert_last_wins",
    lambda spark, d: G.latest(B.raw_controls(spark, d).drop("l_returnflag"), ["product_number", "weed", "crop"], B.WRITE_ORDER),
    B.SQL + "SELECT product_number, weed, crop, rate_per_ha, application_timing, control_level, critical_comments, states FROM controls",
)
add(
    "coalesce_last_nonnull",
    lambda spark, d: G.latest_known(B.table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("seen")), ["user_id"], "seen", ["event_id"]),
    "SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS seen FROM events GROUP BY user_id",
)
add(
    "conditional_edges",
    lambda spark, d: G.edges(G.edges_to_known(B.table(spark, d, "part").select(F.col("p_partkey").alias("product"), F.upper(F.substring("p_name", 1, 1)).alias("group")), "group", G.moa_nodes(spark), "group"), "product", "group"),
    B.SQL + """SELECT DISTINCT p_partkey AS product, upper(p_name[1]) AS "group" FROM part WHERE upper(p_name[1]) IN (SELECT "group" FROM moa)""",
)
add("key_violations", lambda spark, d: G.duplicate_keys(B.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
add(
    "route_intent",
    lambda spark, d: B.table(spark, d, "conversations").select("conv_id", "turn", E.route(F.col("text")).alias("route")),
    """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'rotation|resistance|alternative') THEN 'rotation' WHEN regexp_matches(lower(text), 'how many|count|most common') THEN 'cypher'
    WHEN regexp_matches(lower(text), 'control|herbicide for') THEN 'graph' ELSE 'semantic' END AS route FROM conversations""",
)


def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label records as an extractor would write them, one for each product."""
    raw = B.raw_controls(spark, sf_dir)
    entry = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", F.struct(F.upper("crop").alias("crop"), "application_timing", F.col("weed").alias("weed_common_name"), F.lit(None).cast("string").alias("weed_scientific_name"), "states", "rate_per_ha", "critical_comments", "control_level").alias("e"))
    entries = raw.groupBy("product_number").agg(F.array_sort(F.collect_list(entry)).alias("es"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "N", F.upper("crop")))).alias("registered_crops"), F.array_sort(F.collect_set(F.col("states")[0])).alias("state_restrictions"))
    part = B.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_number"), "p_partkey", F.col("p_name").alias("product_name"), F.col("p_type").alias("active_constituent"), F.col("p_brand").alias("chemical_group"))
    group = F.lower(F.char((F.col("p_partkey") % 30 + 65).cast("int")))
    return part.join(entries, "product_number").select(
        F.col("p_partkey").alias("seq"), F.concat("product_number", F.lit("ELBL")).alias("stem"), F.lit(None).cast("string").alias("product_number"), "product_name", "active_constituent", "chemical_group", group.alias("mode_of_action_group"),
        "registered_crops", F.transform(F.slice("es", 1, 2), lambda x: F.upper(x["e"]["weed_common_name"])).alias("registered_weeds"), F.transform("es", lambda x: x["e"]).alias("weed_control_entries"), F.array().cast("array<string>").alias("application_methods"), "state_restrictions", F.lit(None).cast("string").alias("withholding_period"),
    )


add(
    "load_labels_controls",
    lambda spark, d: G.load_labels(label_records(spark, d)).controls,
    B.SQL + "SELECT product_number, weed, crop, rate_per_ha, application_timing, control_level, critical_comments, states FROM controls",
)
add(
    "load_labels_moa_edges",
    lambda spark, d: G.load_labels(label_records(spark, d)).has_mode_of_action,
    B.SQL + """SELECT DISTINCT product_number, chr(CAST(65 + CAST(product_number AS BIGINT) % 30 AS INTEGER)) AS "group" FROM raw WHERE upper(chr(CAST(65 + CAST(product_number AS BIGINT) % 30 AS INTEGER))) IN (SELECT "group" FROM moa)""",
)
add(
    "load_labels_weeds",
    lambda spark, d: G.load_labels(label_records(spark, d)).weed.select("common_name", "scientific_name"),
    B.SQL + "SELECT DISTINCT weed AS common_name, CAST(NULL AS VARCHAR) AS scientific_name FROM raw",
)
add(
    "load_labels_counters",
    lambda spark, d: G.load_labels(label_records(spark, d)).loaded,
    B.SQL + """SELECT (SELECT count(DISTINCT product_number) FROM raw) AS herbicides, (SELECT count(*) FROM (SELECT DISTINCT product_number, crop FROM raw WHERE l_returnflag <> 'N')) AS crops,
  (SELECT sum(least(n, 2)) FROM (SELECT product_number, count(*) AS n FROM raw GROUP BY 1))::BIGINT AS weeds, (SELECT count(*) FROM raw) AS controls""",
)
