"""The property graph as DataFrames: one for each node label and edge type, upserts, seeds and statistics.

Keys are unique because every table is built by grouping on its key.  Where several records write one key, the last in
an explicit order wins, as a fold over the records would have it; ``max_by`` combines map-side, so a key with many
records shuffles a few rows only.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.text import strip

# The eight states and the mode-of-action groups of the public resistance classification.
STATES = [
    ("NSW", "New South Wales"), ("VIC", "Victoria"), ("QLD", "Queensland"), ("SA", "South Australia"),
    ("WA", "Western Australia"), ("TAS", "Tasmania"), ("NT", "Northern Territory"), ("ACT", "Australian Capital Territory"),
]
MOA_GROUPS = [
    ("A", "Inhibition of acetyl CoA carboxylase (ACCase inhibitors)", "Fops, Dims, Dens"),
    ("B", "Inhibition of acetolactate synthase (ALS inhibitors)", "Sulfonylureas, Imidazolinones, Triazolopyrimidines"),
    ("C", "Inhibition of photosynthesis at PSII", "Triazines, Ureas, Nitriles"),
    ("D", "Inhibition of photosynthesis at PSI", "Bipyridyliums"),
    ("E", "Inhibition of protoporphyrinogen oxidase (PPO)", "Diphenyl ethers, Oxadiazoles"),
    ("F", "Bleaching: Inhibition of carotenoid biosynthesis", "Triketones, Isoxazoles, Pyridazinones"),
    ("G", "Inhibition of EPSP synthase", "Glycines (glyphosate)"),
    ("H", "Inhibition of glutamine synthetase", "Phosphinic acids (glufosinate)"),
    ("I", "Inhibition of DHP synthase", "Carbamates"),
    ("J", "Inhibition of microtubule assembly", "Dinitroanilines, Benzamides"),
    ("K", "Inhibition of cell division / VLCFA inhibitors", "Chloroacetamides, Oxyacetamides"),
    ("L", "Inhibition of cell wall synthesis", "Nitriles, Benzamides"),
    ("M", "Uncouplers", "Dinitrophenols"),
    ("N", "Inhibition of lipid synthesis (not ACCase)", "Thiocarbamates, Phosphorodithioates"),
    ("O", "Synthetic auxins (IAA mimics)", "Phenoxy acids, Benzoic acids, Pyridine carboxylic acids"),
    ("P", "Inhibition of auxin transport", "Phthalamates, Semicarbazones"),
    ("Q", "Unknown mode of action", "Various"),
    ("R", "Inhibition of dihydropteroate synthase", "Sulfonamides"),
    ("Z", "Unknown / not classified", "Various"),
]


def latest(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: all other columns of its last record in ``order``, nulls of that record included."""
    others = [c for c in records.columns if c not in keys and c not in order]
    last = records.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"))
    return last.select(*keys, *(F.col("last")[c].alias(c) for c in others))


def latest_known(records: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """One row for each key: the last value that isn't null."""
    known = F.max_by(F.when(F.col(value).isNotNull(), F.struct(value)), F.when(F.col(value).isNotNull(), F.struct(*order)))
    return records.groupBy(*keys).agg(known[value].alias(value))


def edges(records: DataFrame, *keys: str) -> DataFrame:
    """Edges without properties are a set."""
    return records.select(*keys).distinct()


def edges_to_known(records: DataFrame, key: str, nodes: DataFrame, node_key: str) -> DataFrame:
    """Edges whose target exists."""
    target = nodes.select(F.col(node_key).alias("_known")).distinct()
    return records.join(target, F.col(key) == F.col("_known"), "left_semi")


def few(rows: DataFrame) -> DataFrame:
    """Rows that are few, such as the k best, asked for once and held by the driver: what joins them reads them as often
    as it likes, and Spark sees that they can be broadcast."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema)


def duplicate_keys(nodes: DataFrame, *keys: str) -> DataFrame:
    """Keys that break uniqueness."""
    return nodes.groupBy(*keys).count().where("count > 1")


def normal_crop(name: Column) -> Column:
    return strip(F.lower(name))


def normal_weed(name: Column) -> Column:
    return F.replace(strip(F.lower(name)), F.lit("'s"), F.lit("s"))


def _constant(spark: SparkSession, rows: list[tuple[str, ...]], *names: str) -> DataFrame:
    """Fixed rows as a local relation, whose size the optimizer knows."""
    values = ", ".join("(" + ", ".join("'" + x.replace("'", "\\'") + "'" for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(f'`{n}`' for n in names)})")


def moa_nodes(spark: SparkSession) -> DataFrame:
    return _constant(spark, MOA_GROUPS, "group", "description", "chemical_classes")


def state_nodes(spark: SparkSession) -> DataFrame:
    return _constant(spark, STATES, "code", "name")


@dataclass
class Graph:
    """Node tables by label and edge tables by type; a part that a source lacks is None."""

    herbicide: DataFrame | None = None
    active_constituent: DataFrame | None = None
    mode_of_action: DataFrame | None = None
    crop: DataFrame | None = None
    weed: DataFrame | None = None
    state: DataFrame | None = None
    document: DataFrame | None = None
    chunk: DataFrame | None = None
    contains: DataFrame | None = None
    has_mode_of_action: DataFrame | None = None
    registered_for: DataFrame | None = None
    controls: DataFrame | None = None
    registered_in: DataFrame | None = None
    has_label: DataFrame | None = None
    contains_chunk: DataFrame | None = None
    next: DataFrame | None = None
    mentions: DataFrame | None = None
    loaded: DataFrame | None = field(default=None, repr=False)
    #: What mentions are made of (chunking.Links); see linked().
    links: Any = field(default=None, repr=False)

    def linked(self) -> Any:
        """What mentions are made of, if mentions and chunks are still those that it is about."""
        ours = self.links is not None and self.links.table is self.mentions and self.links.chunk is self.chunk
        return self.links if ours else None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: t for f in fields(self) if f.name not in ("loaded", "links") and (t := getattr(self, f.name)) is not None}

    def write(self, path: str) -> None:
        """Each table as Parquet below ``path``, replaced as a whole."""
        for name, table in self.tables().items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, names: list[str]) -> Graph:
        return cls(**{name: spark.read.parquet(f"{path}/{name}") for name in names})


NODES = ["herbicide", "active_constituent", "mode_of_action", "crop", "weed", "state", "document", "chunk"]
#: registered_in is a table but not among the counted ones.
EDGES = ["contains", "has_mode_of_action", "registered_for", "controls", "has_label", "contains_chunk", "next", "mentions"]


def stats(graph: Graph) -> DataFrame:
    """name, total for each node label and edge type."""
    found = graph.tables()
    out = None
    for name in [*NODES, *EDGES]:
        if name in found:
            links = graph.linked() if name == "mentions" else None
            total = links.count() if links else found[name].agg(F.count(F.lit(1)).alias("total"))
            one = total.select(F.lit(name).alias("name"), "total")
            out = one if out is None else out.unionByName(one)
    return out


def clear(graph: Graph, confirm: bool = False) -> bool:
    """Forget all tables; refused without ``confirm``."""
    if confirm:
        for f in fields(graph):
            setattr(graph, f.name, None)
    return confirm


def load_labels(records: DataFrame, seq: str = "seq") -> Graph:
    """A graph from extracted label records (see sources.readers.LABEL_RECORD), later ``seq`` winning.

    Control entries make crops and weeds but no registrations; entries with a blank weed or crop are dropped; groups
    and states count only if known.  ``loaded`` counts entries, not distinct nodes.
    """
    spark = records.sparkSession
    r = records.withColumn("product_number", F.coalesce("product_number", F.replace("stem", F.lit("ELBL"), F.lit(""))))
    crops = r.select(seq, "product_number", F.posexplode("registered_crops").alias("pos", "display_name")).withColumn("name", normal_crop(F.col("display_name")))
    weeds = r.select(seq, "product_number", F.posexplode("registered_weeds").alias("pos", "display_name")).withColumn("name", normal_weed(F.col("display_name")))
    entries = r.select(seq, "product_number", F.posexplode("weed_control_entries").alias("pos", "e")).select(
        seq, "product_number", "pos", "e.*", normal_crop(F.col("e.crop")).alias("crop_name"), normal_weed(F.col("e.weed_common_name")).alias("weed_name")
    )
    entries = entries.where("weed_name <> '' AND crop_name <> ''")
    # A record's list of crops or weeds is written before its control entries.
    crop_rows = crops.select("name", "display_name", seq, F.lit(0).alias("part"), "pos").unionByName(entries.select(F.col("crop_name").alias("name"), F.col("crop").alias("display_name"), seq, F.lit(1).alias("part"), "pos"))
    weed_rows = weeds.select("name", "display_name", F.lit(None).cast("string").alias("scientific_name"), seq, F.lit(0).alias("part"), "pos").unionByName(
        entries.select(F.col("weed_name").alias("name"), F.col("weed_common_name").alias("display_name"), F.nullif("weed_scientific_name", F.lit("")).alias("scientific_name"), seq, F.lit(1).alias("part"), "pos")
    ).where("name <> ''")
    order = [seq, "part", "pos"]
    weed = latest(weed_rows.drop("scientific_name"), ["name"], order).join(latest_known(weed_rows, ["name"], "scientific_name", order), "name")
    herbicide = latest(r.select("product_number", "product_name", "active_constituent", "chemical_group", "withholding_period", "application_methods", seq), ["product_number"], [seq])
    moa, state = moa_nodes(spark), state_nodes(spark)
    groups = r.select("product_number", F.upper("mode_of_action_group").alias("group"))
    states = r.select("product_number", F.explode("state_restrictions").alias("s")).select("product_number", F.upper("s").alias("code"))
    controls = latest(
        entries.select(
            "product_number", F.col("weed_name").alias("weed"), F.col("crop_name").alias("crop"), F.coalesce("rate_per_ha", F.lit("")).alias("rate_per_ha"), "application_timing",
            F.coalesce("control_level", F.lit("control")).alias("control_level"), "critical_comments", F.coalesce("states", F.array().cast("array<string>")).alias("states"), seq, "pos",
        ), ["product_number", "weed", "crop"], [seq, "pos"],
    )
    valid = F.filter("weed_control_entries", lambda e: (normal_weed(e["weed_common_name"]) != "") & (normal_crop(e["crop"]) != ""))
    sizes = {"crops": F.size("registered_crops"), "weeds": F.size("registered_weeds"), "controls": F.size(valid)}
    loaded = r.agg(F.count(F.lit(1)).alias("herbicides"), *(F.sum(F.greatest(n, F.lit(0))).alias(k) for k, n in sizes.items()))
    return Graph(
        herbicide=herbicide, mode_of_action=moa, state=state, weed=weed.withColumnRenamed("name", "common_name"), crop=latest(crop_rows, ["name"], order),
        active_constituent=latest(r.where("active_constituent IS NOT NULL").select(F.col("active_constituent").alias("name"), "chemical_group", seq), ["name"], [seq]),
        contains=edges(r.where("active_constituent IS NOT NULL"), "product_number", "active_constituent"), registered_for=edges(crops, "product_number", "name"), controls=controls,
        has_mode_of_action=edges(edges_to_known(groups, "group", moa, "group"), "product_number", "group"), registered_in=edges(edges_to_known(states, "code", state, "code"), "product_number", "code"), loaded=loaded,
    )
