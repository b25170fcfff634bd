"""Questions about products, weeds and crops.  Every order is made total; arrays are sorted, so results are deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.functions.text import has
from tillage.operators.graph import Graph


def _weed_like(term: str) -> Column:
    return has(F.col("common_name"), term) | has(F.col("weed_display"), term)


#: Weeds that a question may match for their names to be read by the driver.
FEW = 1000


def _of_weeds(controls: DataFrame, weeds: DataFrame) -> DataFrame:
    """The controls of some weeds.  The weed is part of a control's key: the names of few weeds are a condition that Spark
    takes below the fold that makes controls, so records of other weeds are dropped before it.  More weeds are joined."""
    wanted = weeds.select(F.col("common_name").alias("_wanted")).distinct()
    names = [r[0] for r in wanted.limit(FEW + 1).collect()]
    if len(names) <= FEW:
        return controls.where(F.col("weed").isin(names))
    return controls.join(wanted, F.col("weed") == F.col("_wanted"), "left_semi")


def _facts(g: Graph, of_weed: Column | None = None) -> DataFrame:
    """Controls with their product and weed; ``of_weed`` narrows the weeds."""
    weed = g.weed.select("common_name", F.col("display_name").alias("weed_display"), "scientific_name")
    controls = g.controls
    if of_weed is not None:
        weed = weed.where(of_weed)
        controls = _of_weeds(controls, weed)
    return controls.join(g.herbicide, "product_number").join(weed, F.col("weed") == F.col("common_name"))


def _with_moa(products: DataFrame, g: Graph, how: str = "left") -> DataFrame:
    moa = g.has_mode_of_action.join(F.broadcast(g.mode_of_action), "group").select("product_number", F.col("group").alias("moa_group"), F.col("description").alias("moa_description"))  # 19 groups
    return products.join(moa, "product_number", how)


def find_products_for_weed(g: Graph, weed: str, crop: str | None = None, state: str | None = None, exclude_moa: str | None = None, strict: bool = True) -> DataFrame:
    """Products that control a weed.  ``exclude_moa`` also drops products without a group.  Unless ``strict``, crop and state bind to
    matches of the display name only and a match of the common name passes by them."""
    rows = _facts(g, _weed_like(weed))
    more = F.lit(True)
    if crop:
        more = more & has(F.col("crop"), crop)
    if state:
        more = more & F.array_contains("states", state.upper())
    rows = rows.where(_weed_like(weed) & more if strict else has(F.col("common_name"), weed) | (has(F.col("weed_display"), weed) & more))
    rows = _with_moa(rows, g, "inner" if exclude_moa else "left")
    if exclude_moa:
        rows = rows.where(F.col("moa_group") != exclude_moa)
    return rows.select(
        F.col("product_name").alias("herbicide"), "product_number", "active_constituent", "moa_group", "moa_description", F.col("weed_display").alias("weed"),
        "crop", "rate_per_ha", "application_timing", "control_level", "states", "critical_comments",
    ).orderBy(*(F.asc_nulls_last(c) for c in ("herbicide", "crop", "product_number", "weed")))


def find_products_for_crop(g: Graph, crop: str, state: str | None = None) -> DataFrame:
    """Products registered for a crop, with the weeds they control there; ``state`` narrows the weeds only."""
    crops = g.crop.select("name", F.col("display_name").alias("crop")).where(has(F.col("name"), crop) | has(F.col("crop"), crop))
    rows = g.registered_for.join(crops, "name").join(g.herbicide, "product_number")
    there = _facts(g).where(has(F.col("crop"), crop))
    if state:
        there = there.where(F.array_contains("states", state.upper()))
    weeds = there.groupBy("product_number").agg(F.array_sort(F.collect_set("weed_display")).alias("weeds_controlled"))
    rows = _with_moa(rows, g).join(weeds, "product_number", "left")
    return rows.select(F.col("product_name").alias("herbicide"), "product_number", "active_constituent", "moa_group", "crop", F.coalesce("weeds_controlled", F.array().cast("array<string>")).alias("weeds_controlled")).orderBy("herbicide", "product_number", "crop")


def moa_rotation(g: Graph, current: str, crop: str, weed: str) -> DataFrame:
    """Products of other groups against a weed in a crop, by group."""
    rows = _with_moa(_facts(g, _weed_like(weed)).where(has(F.col("crop"), crop)), g, "inner").where(F.col("moa_group") != current)
    option = F.struct(F.col("product_name").alias("herbicide"), "product_number", "active_constituent", F.col("rate_per_ha").alias("rate"), F.col("application_timing").alias("timing"), "control_level")
    return rows.groupBy("moa_group", "moa_description").agg(F.array_sort(F.collect_set(option)).alias("options")).orderBy("moa_group")


def product_details(g: Graph, product_number: str | None = None) -> DataFrame:
    """A row for each product (or one): scalars, group, and the sets of crops, states and controls.

    Each branch is reduced to one row a product before it is joined, so branches don't multiply each other.  A product
    without controls has one all-null entry.
    """
    mine = (lambda df: df.where(F.col("product_number") == product_number)) if product_number else (lambda df: df)
    weed = g.weed.select("common_name", F.col("display_name").alias("weed_display"))
    crops = mine(g.registered_for).join(g.crop, "name").groupBy("product_number").agg(F.array_sort(F.collect_set("display_name")).alias("crops"))
    states = mine(g.registered_in).groupBy("product_number").agg(F.array_sort(F.collect_set("code")).alias("states"))
    control = F.struct(F.col("weed_display").alias("weed"), "crop", F.col("rate_per_ha").alias("rate"), F.col("application_timing").alias("timing"), "control_level")
    kind = "array<struct<weed: string, crop: string, rate: string, timing: string, control_level: string>>"
    controls = mine(g.controls).join(weed, F.col("weed") == F.col("common_name")).groupBy("product_number").agg(F.array_sort(F.collect_set(control)).alias("controls"))
    nothing = F.array(F.struct(*(F.lit(None).cast("string").alias(c) for c in ("weed", "crop", "rate", "timing", "control_level"))))
    none = F.array().cast("array<string>")
    rows = _with_moa(mine(g.herbicide), g).join(crops, "product_number", "left").join(states, "product_number", "left").join(controls, "product_number", "left")
    return rows.select(
        "product_number", "product_name", "active_constituent", "chemical_group", "withholding_period", "moa_group", "moa_description",
        F.coalesce("crops", none).alias("crops"), F.coalesce("states", none).alias("states"), F.coalesce(F.col("controls").cast(kind), nothing.cast(kind)).alias("controls"),
    )


def search_weeds(g: Graph, term: str, limit: int = 20) -> DataFrame:
    """Weeds by any of their names, with the number of products; the first ``limit`` by name."""
    found = g.weed.where(has(F.col("common_name"), term) | has(F.col("display_name"), term) | has(F.col("scientific_name"), term))
    controls = _of_weeds(g.controls.select("product_number", "weed"), found)
    rows = found.join(controls, F.col("common_name") == F.col("weed"), "left")
    counted = rows.groupBy(F.col("common_name").alias("name"), "display_name", "scientific_name").agg(F.count_distinct("product_number").alias("herbicide_count"))
    return counted.orderBy("name").limit(limit)


def search_crops(g: Graph, term: str, limit: int = 20) -> DataFrame:
    found = g.crop.where(has(F.col("name"), term) | has(F.col("display_name"), term))
    rows = found.join(g.registered_for.select("product_number", F.col("name").alias("of")), F.col("name") == F.col("of"), "left")
    return rows.groupBy("name", "display_name").agg(F.count_distinct("product_number").alias("herbicide_count")).orderBy("name").limit(limit)


def graph_totals(g: Graph) -> DataFrame:
    """One row of four totals; zeros where a part is empty."""
    parts = {"total_herbicides": g.herbicide, "total_crops": g.crop, "total_weeds": g.weed, "total_control_relationships": g.controls}
    counts = None
    for name, table in parts.items():
        one = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(*(F.max(F.when(F.col("part") == name, F.col("n"))).alias(name) for name in parts))


def top_weeds(g: Graph, limit: int = 10) -> DataFrame:
    counted = g.controls.groupBy("weed").agg(F.count_distinct("product_number").alias("herbicide_count"))
    return counted.orderBy(F.desc("herbicide_count"), "weed").limit(limit)


def top_crops(g: Graph, limit: int = 10) -> DataFrame:
    counted = g.registered_for.groupBy(F.col("name").alias("crop")).agg(F.count_distinct("product_number").alias("herbicide_count"))
    return counted.orderBy(F.desc("herbicide_count"), "crop").limit(limit)


def common_moa(g: Graph, limit: int = 5) -> DataFrame:
    rows = g.has_mode_of_action.join(F.broadcast(g.mode_of_action), "group").groupBy(F.col("group").alias("moa"), "description")
    return rows.agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "moa").limit(limit)


def count_for_weed(g: Graph, term: str) -> DataFrame:
    """The first weed that matches, with its number of products; zero if none does."""
    found = g.controls.where(has(F.col("weed"), term)).groupBy("weed").agg(F.count_distinct("product_number").alias("count")).orderBy("weed").limit(1)
    return found.agg(F.coalesce(F.max("count"), F.lit(0)).alias("count"), F.max("weed").alias("weed"))


def ask(g: Graph, question: str) -> DataFrame | None:
    """One of four canned questions, or None."""
    q = question.lower()
    if "how many herbicides" in q:
        if "control" in q:
            return count_for_weed(g, q.split("control")[-1].strip().rstrip("?"))
        return g.herbicide.agg(F.count(F.lit(1)).alias("count"))
    if "most common moa" in q or "most used moa" in q:
        return common_moa(g)
    if "which weeds" in q and "most" in q:
        return top_weeds(g)
    return None


def route(question: Column) -> Column:
    """Which kind of answer a question needs, by its words, in this order."""
    q = F.lower(question)

    def any_of(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(q, F.lit(w))
        return out

    return (
        F.when(any_of("rotation", "resistance", "alternative"), "rotation")
        .when(any_of("how many", "count", "most common"), "cypher")
        .when(any_of("control", "herbicide for"), "graph")
        .otherwise("semantic")
    )
