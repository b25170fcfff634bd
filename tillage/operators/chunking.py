"""Chunks of parsed tables: sections, kinds, splits, ids and links, as column expressions and windows over a document."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.functions.text import bind, strip, tokens
from tillage.operators.graph import few

# The section patterns, tried in this order, and the words and rates that mark a table of weeds.
SECTIONS = [
    ("product_identity", r"label\s*name|product\s*name|apvma"),
    ("claims", r"statement\s*of\s*claims|claim"),
    ("resistance_warning", r"resistance\s*warning|group\s*[a-z]\s*herbicide"),
    ("directions_for_use", r"situation|crop|weeds|rate|critical\s*comments"),
    ("weed_table", r"weed\s*table|weeds?\s*controlled"),
    ("withholding_period", r"withholding|whp|harvest"),
    ("compatibility", r"compatib|tank\s*mix|mixing"),
    ("safety", r"safety|first\s*aid|poison|hazard"),
    ("storage", r"storage|disposal|container"),
]
WEED_WORDS = ["weed", "grass", "thistle", "dock", "clover", "ryegrass"]
RATE = r"(?iU)\d+\s*(mL|g|L)/ha"
MAX_TOKENS, MIN_CHARS = 512, 20


def joined_rows(rows: Column, cell: str = " | ", row: str = "\n") -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, cell)), row)


def section(markdown: Column, rows: Column, columns: Column) -> Column:
    """The first section whose pattern is in the table's text; else by its number of columns."""
    text = F.when(F.coalesce(F.length(markdown), F.lit(0)) > 0, markdown).otherwise(joined_rows(rows, " ", " "))
    out = None
    for name, pattern in SECTIONS:
        hit = F.coalesce(F.regexp_like(text, F.lit("(?iU)" + pattern)), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(columns >= 4, "directions_for_use").when(columns == 2, "metadata").otherwise("general")


def is_weed_table(rows: Column) -> Column:
    """Among the first five of at least three rows: a weed word in the first cell, or a rate in any cell."""
    word = lambda cell: F.regexp_like(F.lower(cell), F.lit("|".join(WEED_WORDS)))
    row = lambda r: word(F.coalesce(r[0], F.lit(""))) | F.exists(r, lambda c: F.coalesce(F.regexp_like(c, F.lit(RATE)), F.lit(False)))
    return F.coalesce(F.size(rows) >= 3, F.lit(False)) & F.exists(F.slice(rows, 1, 5), lambda r: (F.size(r) > 0) & row(r))


def kind(weed_table: Column, of_section: Column, columns: Column) -> Column:
    return F.when(weed_table, "weed_table").when(of_section == "directions_for_use", "directions").when((of_section == "metadata") | (columns <= 2), "metadata").otherwise("table")


def product_of(stem: Column) -> Column:
    return F.replace(F.replace(stem, F.lit("ELBL"), F.lit("")), F.lit(".docling"), F.lit(""))


def chunk_tables(tables: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Chunks of tables (product_number, position, table_id, rows array<array<string>>, markdown, column_count, row_count,
    page): one for each table, or for each run of rows of a long one.

    A section carries forward to the tables after it, also from tables too short to be chunks.  Ids come from the number
    of chunks emitted before the table.
    """
    t = tables.where((F.coalesce(F.length("markdown"), F.lit(0)) > 0) | (F.coalesce(F.size("rows"), F.lit(0)) > 0))
    t = t.withColumn("rows", F.coalesce("rows", F.array().cast("array<array<string>>"))).withColumn("column_count", F.coalesce("column_count", F.lit(0)))
    t = t.withColumn("own_section", section(F.col("markdown"), F.col("rows"), F.col("column_count")))
    in_order = Window.partitionBy("product_number").orderBy("position")
    t = t.withColumn("parent_section", F.last(F.when(F.col("own_section") != "general", F.col("own_section")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("chunk_type", kind(is_weed_table(F.col("rows")), F.col("own_section"), F.col("column_count")))
    t = t.withColumn("text", F.when(F.coalesce(F.length("markdown"), F.lit(0)) > 0, F.col("markdown")).otherwise(joined_rows(F.col("rows"))))
    t = t.where(F.length(strip(F.col("text"))) >= MIN_CHARS)
    headed = (F.col("column_count") >= 3) & (F.size("rows") > 0)
    t = t.withColumn("headers", F.when(headed, F.col("rows")[0]).otherwise(F.array().cast("array<string>"))).withColumn("est", tokens(F.col("text")))
    t = t.withColumn("splits", (F.col("est") > max_tokens) & (F.size("rows") > 3))
    t = t.withColumn("data", F.when(headed, F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows")))
    t = t.withColumn("per", F.greatest(F.lit(1), F.floor(F.size("data") / (F.floor(F.col("est") / max_tokens) + 1)).cast("int")))
    t = t.withColumn("n_chunks", F.when(F.col("splits"), F.ceil(F.size("data") / F.col("per"))).otherwise(F.lit(1)))
    t = t.withColumn("sequence", F.coalesce(F.sum("n_chunks").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("hash", F.substring(F.md5(F.concat_ws("-", "product_number", "table_id", F.col("sequence").cast("string"))), 1, 8))
    parts = t.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_chunks").cast("int") - 1)))
    mine = F.slice("data", F.col("part") * F.col("per") + 1, F.col("per"))
    head = F.when(F.size("headers") > 0, F.concat(F.array_join("headers", " | "), F.lit("\n"))).otherwise("")
    return parts.select(
        F.when(F.col("splits"), F.concat_ws("-", "product_number", "table_id", F.concat(F.lit("part"), F.col("part").cast("string")), "hash")).otherwise(F.concat_ws("-", "product_number", "table_id", "hash")).alias("chunk_id"),
        F.when(F.col("splits"), F.concat(head, joined_rows(mine))).otherwise(F.col("text")).alias("text"), "chunk_type", (F.col("sequence") + F.col("part")).alias("sequence_order"), "product_number",
        "parent_section", "table_id", F.when(F.col("splits"), F.size(mine)).otherwise(F.col("row_count")).alias("row_count"), "column_count", "headers", F.col("page").alias("page_number"),
    )


def contextualize(product: Column, of_section: Column, chunk_type: Column, text: Column) -> Column:
    """The text behind its product, section and kind."""
    return F.concat_ws(
        " ",
        F.when(F.coalesce(product, F.lit("")) != "", F.concat(F.lit("[Product: "), product, F.lit("]"))),
        F.when(F.coalesce(of_section, F.lit("")) != "", F.concat(F.lit("[Section: "), of_section, F.lit("]"))),
        F.when(chunk_type == "weed_table", "[Weed Control Table]").when(chunk_type == "directions", "[Directions for Use]"),
        text,
    )


def next_edges(chunks: DataFrame) -> DataFrame:
    """src, dst of consecutive chunks of a document."""
    after = F.lead("chunk_id").over(Window.partitionBy("product_number").orderBy("sequence_order"))
    return chunks.select(F.col("chunk_id").alias("src"), after.alias("dst")).where("dst IS NOT NULL")


# Patterns of weed and crop names.
WEEDS = [
    "ryegrass", "capeweed", r"wild\s*radish", r"wild\s*oats?", r"brome\s*grass", r"barley\s*grass", "clover", "dock", "thistle", "fumitory", r"fat\s*hen", "charlock", r"sow\s*thistle", r"skeleton\s*weed",
    r"turnip\s*weed", r"shepherd'?s?\s*purse", "wireweed", "medic", "marshmallow", "sorrel", "deadnettle", "chickweed", "pigweed", "amaranth", "burr", "caltrop", "bindweed", "fleabane",
]
CROPS = [
    "wheat", "barley", "canola", "lupins?", "oats?", "triticale", "pasture", "fallow", "chickpea", "lentils?", r"field\s*pea", r"faba\s*bean", "vetch", "cereal", r"grain\s*legume",
]


def _plain(pattern: str) -> bool:
    """Whether a pattern has no special characters."""
    return re.fullmatch(r"\w+", pattern) is not None


def mentions(text: Column, patterns: list[str], squash: bool = True) -> Column:
    """The first match of each pattern in the lower-case text, distinct.  ``squash`` takes spaces out, so that names of
    several words no longer look like the names of entities."""
    # A plain pattern is looked for as a part.
    first = lambda low, p: F.when(F.contains(low, F.lit(p)), F.lit(p)) if _plain(p) else F.nullif(F.regexp_extract(low, f"(?U){p}", 0), F.lit(""))
    one = lambda f: F.replace(f, F.lit(" "), F.lit("")) if squash else f
    return bind(F.lower(text), lambda low: F.array_sort(F.array_distinct(F.array_compact(F.array(*(one(first(low, p)) for p in patterns))))))


#: Names are packed by their tokens in so many blocks, and chunks meet them in so many parts for each token.
NAME_BLOCKS, CHUNK_PARTS = 256, 32


def _owned(names: DataFrame, tokens: DataFrame, patterns: list[str]) -> DataFrame:
    """Names with the tokens that they contain, of those that chunks have (``tokens``: arrays, or one each).  Plain patterns
    are all the tokens that there can be; others must be looked for in the chunks."""
    if all(map(_plain, patterns)):
        seen = F.array(*map(F.lit, sorted(set(patterns))))
    else:
        tokens = tokens.select(F.explode_outer("tokens").alias("token")) if "tokens" in tokens.columns else tokens
        seen = tokens.agg(F.collect_set("token")).scalar()
    known = names.withColumn("seen", seen)
    return known.select("entity", F.filter("seen", lambda t: F.contains(F.lower("entity"), t)).alias("own")).where(F.size("own") > 0)


def link_mentions(chunks: DataFrame, entities: DataFrame, patterns: list[str], entity_type: str, squash: bool = True) -> DataFrame:
    """chunk_id, entity, entity_type for each entity whose name contains a token found in the chunk (a row for each).

    A pattern allows few tokens, so the distinct ones are one array, which each name is tested against once.  Names of the
    same tokens are packed, and chunks join packs by the token; a pack that several of a chunk's tokens lead to comes by
    the first of them alone, so pairs need no shuffle to become distinct.  Tokens are few, so a chunk's part is a second key.
    """
    # One generator makes a row for each token, with all of them: named again, the patterns would be planned and run again.
    of_chunk = bind(mentions(F.col("text"), patterns, squash), lambda ts: F.transform(ts, lambda t: F.struct(t.alias("token"), ts.alias("tokens"))))
    found = chunks.select("chunk_id", F.explode_outer(of_chunk).alias("m")).where("m IS NOT NULL").select("chunk_id", "m.token", "m.tokens", F.coalesce(F.pmod(F.xxhash64("chunk_id"), F.lit(CHUNK_PARTS)).cast("int"), F.lit(0)).alias("part"))
    names = _owned(entities.select(F.col("name").alias("entity")).distinct(), found.select("token"), patterns)
    packs = names.groupBy("own", F.pmod(F.xxhash64("entity"), F.lit(NAME_BLOCKS)).alias("block")).agg(F.collect_list("entity").alias("entities"))
    packs = packs.select("own", "entities", F.explode("own").alias("token")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(CHUNK_PARTS - 1))))
    # A merge of so many partitions: Spark would broadcast chunks, or deal few bytes, which many pairs come of, to few tasks.
    deal = lambda rows: rows.repartition(2 * CHUNK_PARTS, "token", "part").hint("merge")
    met = deal(found).join(deal(packs), ["token", "part"]).where(F.array_min(F.array_intersect("tokens", "own")) == F.col("token"))
    return met.select("chunk_id", F.explode("entities").alias("entity"), F.lit(entity_type).alias("entity_type"))


def count_mentions(chunks: DataFrame, entities: DataFrame, patterns: list[str], squash: bool = True) -> DataFrame:
    """total: the number of rows of ``link_mentions``, from the numbers of chunks and names of the same tokens."""
    found = chunks.select(mentions(F.col("text"), patterns, squash).alias("tokens")).groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    names = _owned(entities.select(F.col("name").alias("entity")).distinct(), found.select("tokens"), patterns)
    names = names.groupBy("own").agg(F.count(F.lit(1)).alias("m"))
    met = found.withColumn("token", F.explode("tokens")).join(names.withColumn("token", F.explode("own")), "token")
    return met.where(F.array_min(F.array_intersect("tokens", "own")) == F.col("token")).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("total"))


@dataclass(frozen=True)
class Link:
    """What ``link_mentions`` links: chunks, and entities of one type."""

    chunks: DataFrame
    entities: DataFrame
    patterns: list[str]
    entity_type: str
    squash: bool = True

    def edges(self, chunks: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
        """Of some of the chunks or entities only, if given."""
        chunks, entities = self.chunks if chunks is None else chunks, self.entities if entities is None else entities
        return link_mentions(chunks, entities, self.patterns, self.entity_type, self.squash)

    def near(self, ids: DataFrame) -> DataFrame:
        """The edges of few chunks (chunk_id), whose texts are fetched first."""
        return self.edges(few(self.chunks.join(F.broadcast(ids.select("chunk_id")), "chunk_id", "left_semi").select("chunk_id", "text")))

    def chunk_ids(self, entities: DataFrame) -> DataFrame:
        """Chunks with an edge to one of ``entities``."""
        found = self.chunks.select("chunk_id", mentions(F.col("text"), self.patterns, self.squash).alias("tokens"))
        wanted = _owned(entities.select(F.col("name").alias("entity")), found.select("tokens"), self.patterns).select(F.explode("own").alias("token")).agg(F.collect_set("token"))
        return found.withColumn("wanted", wanted.scalar()).where(F.arrays_overlap("tokens", "wanted")).select("chunk_id")


@dataclass(frozen=True)
class Links:
    """Mentions of a graph's chunks and what they are made of.  The pairs grow with chunks times names: a question for few
    chunks or names, or for the number of pairs, asks the parts, so that not all pairs are made."""

    chunk: DataFrame
    parts: list[Link]
    table: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "table", reduce(DataFrame.unionByName, (p.edges() for p in self.parts)))

    def near(self, ids: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, (p.near(ids) for p in self.parts))

    def of_entities(self, kind: str, like: Callable[[Column], Column], k: int) -> DataFrame:
        """chunk_id, entity: the first ``k``, and all those of their chunks, by chunk and entity."""
        found = None
        for part in (p for p in self.parts if p.entity_type == kind):
            named = part.entities.where(like(F.col("name")))
            # Each of these chunks has an edge, so that so many are enough.
            ids = few(part.chunk_ids(named).distinct().orderBy("chunk_id").limit(k))
            some = Link(part.chunks.join(F.broadcast(ids), "chunk_id", "left_semi"), named, part.patterns, kind, part.squash)
            some = some.edges(few(some.chunks.select("chunk_id", "text"))).select("chunk_id", "entity")
            found = some if found is None else found.unionByName(some)
        return found if found is not None else self.table.select("chunk_id", "entity").limit(0)

    def count(self) -> DataFrame:
        """total"""
        totals = (count_mentions(p.chunks, p.entities, p.patterns, p.squash) for p in self.parts)
        return reduce(DataFrame.unionByName, totals).agg(F.sum("total").alias("total")).select(F.coalesce("total", F.lit(0)).alias("total"))
