"""Chunks of tables whose rows are rows of a DataFrame: ``chunking.chunk_tables`` without a table in one value.

Facts of blocks of 4096 rows are written once and summed up to facts of tables, one row each; sections carry forward and
chunks are numbered among those.  The rows themselves then meet their tables by block and are gathered by chunk, so no
task or value holds more of a table than a block, or than a chunk: a chunk is what its text is, all of a table that isn't
split, blank rows included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.functions.text import SPACE, strip, tokens
from tillage.operators import chunking as C
from tillage.operators.running import BITS, running

KEYS = ["product_number", "position"]
#: Characters of a row's ends in which a section's pattern can begin or end: more than any matches, its spaces collapsed.
EDGE = 40


def _hits(text: Column, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{i}": F.coalesce(F.regexp_like(text, F.lit("(?iU)" + p)), F.lit(False)) for i, (_, p) in enumerate(C.SECTIONS)}


def row_facts(rows: DataFrame) -> DataFrame:
    """Rows with their text, their sizes and what the rules of tables ask about a row."""
    cells = F.coalesce("cells", F.array().cast("array<string>"))
    one = rows.select(*KEYS, F.col("row").cast("long").alias("row"), cells.alias("cells")).where("product_number IS NOT NULL AND position IS NOT NULL AND row >= 0")
    flat = F.trim(F.regexp_replace(F.array_join("cells", " "), r"(?U)\s+", " "))
    one = one.withColumns({"line": F.array_join("cells", " | "), "flat": flat, "block": F.shiftright("row", BITS)})
    return one.withColumns({"chars": F.length("line"), "ahead": F.length("line") - F.length(F.regexp_replace("line", rf"(?U)\A{SPACE}+", "")), "kept": F.length(strip(F.col("line")))})


def block_facts(rows: DataFrame) -> DataFrame:
    """A row for each block of 4096 rows of a table."""
    one = row_facts(rows)
    # Among fewer than three rows no table is one of weeds; C.is_weed_table wants three of them.
    weedy = C.is_weed_table(F.array("cells", "cells", "cells"))
    return one.withColumns(_hits(F.col("flat"), "hit")).groupBy(*KEYS, "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum(tokens(F.col("line"))).alias("words"), F.bool_or(F.when(F.col("row") < 5, weedy)).alias("weedy"), F.max(F.when(F.col("row") == 0, F.col("cells"))).alias("first"),
        *(F.bool_or(f"hit{i}").alias(f"hit{i}") for i in range(len(C.SECTIONS))),
    )


def across_rows(rows: DataFrame) -> DataFrame:
    """For each table the characters of its stripped text, and the patterns that match from one row into the next ones.

    A match is in a row, or in the end of one, a short row whole, and the head of another, with only blank rows between:
    no pattern has more than three parts with spaces between.  Rows that aren't blank are numbered, and each block of them
    has the last two of the one before it.
    """
    one = row_facts(rows).select(*KEYS, "row", "chars", "ahead", "kept", F.left("flat", F.lit(EDGE)).alias("head"), F.right("flat", F.lit(EDGE)).alias("tail"))
    one = running(one, KEYS, "row", {"start": F.col("chars") + 1, "n": F.when(F.col("head") != "", 1).otherwise(0)})
    first, last = F.min(F.when(F.col("kept") > 0, F.col("start") + F.col("ahead"))), F.max(F.when(F.col("kept") > 0, F.col("start") + F.col("ahead") + F.col("kept")))
    size = one.groupBy(*KEYS).agg(F.coalesce(last - first, F.lit(0)).alias("stripped"))
    full = one.where("head <> ''").select(*KEYS, "n", "head", "tail", F.shiftright("n", BITS).alias("home"), F.lit(False).alias("copy"))
    again = full.where(F.col("n") % (1 << BITS) >= (1 << BITS) - 2).withColumns({"home": F.col("home") + 1, "copy": F.lit(True)})
    order = Window.partitionBy(*KEYS, "home").orderBy("n")
    near = F.concat_ws(" ", F.lag("tail", 2).over(order), F.lag("tail", 1).over(order), "head")
    met = full.unionByName(again).withColumn("near", near).where("NOT copy").withColumns(_hits(F.col("near"), "over"))
    return size.join(met.groupBy(*KEYS).agg(*(F.bool_or(f"over{i}").alias(f"over{i}") for i in range(len(C.SECTIONS)))), KEYS, "left")


def table_facts(tables: DataFrame, blocks: DataFrame, across: DataFrame, max_tokens: int) -> DataFrame:
    """Tables with kind, section and size of their chunks: a row each, without their rows."""
    rules = range(len(C.SECTIONS))
    sums = blocks.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.bool_or("weedy").alias("weedy"), F.max("first").alias("first"), *(F.bool_or(f"hit{i}").alias(f"hit{i}") for i in rules))
    own = [*KEYS, "table_id", "markdown", "row_count", "page"]
    t = tables.select(*own, F.coalesce("column_count", F.lit(0)).alias("column_count")).join(sums, KEYS, "left").join(across, KEYS, "left")
    marked = F.coalesce(F.length("markdown"), F.lit(0)) > 0
    t = t.withColumns({"n": F.coalesce("n", F.lit(0)), "marked": marked}).where("marked OR n > 0")
    section = F.when(F.lit(False), "")
    for i, (name, pattern) in enumerate(C.SECTIONS):
        in_rows = F.coalesce(f"hit{i}", F.lit(False)) | F.coalesce(f"over{i}", F.lit(False))
        section = section.when(F.when(F.col("marked"), F.regexp_like("markdown", F.lit("(?iU)" + pattern))).otherwise(in_rows), name)
    section = section.when(F.col("column_count") >= 4, "directions_for_use").when(F.col("column_count") == 2, "metadata").otherwise("general")
    headed = (F.col("column_count") >= 3) & (F.col("n") > 0)
    t = t.withColumns({"own_section": section, "headed": headed, "est": F.when(F.col("marked"), tokens(F.col("markdown"))).otherwise(F.col("words"))})
    t = t.withColumn("chunk_type", C.kind((F.col("n") >= 3) & F.coalesce("weedy", F.lit(False)), F.col("own_section"), F.col("column_count")))
    t = t.withColumns({"splits": (F.col("est") > max_tokens) & (F.col("n") > 3), "data": F.col("n") - F.col("headed").cast("int")})
    t = t.withColumn("per", F.greatest(F.lit(1), F.floor(F.col("data") / (F.floor(F.col("est") / max_tokens) + 1))))
    emitted = F.when(F.col("marked"), F.length(strip(F.col("markdown")))).otherwise(F.coalesce("stripped", F.lit(0))) >= C.MIN_CHARS
    return t.withColumns({"emitted": emitted, "n_chunks": F.when(~emitted, 0).when(F.col("splits"), F.ceil(F.col("data") / F.col("per"))).otherwise(1)})


def chunk_table_rows(tables: DataFrame, rows: DataFrame, scratch: str, max_tokens: int = C.MAX_TOKENS) -> DataFrame:
    """The chunks that ``chunking.chunk_tables`` makes, of ``tables`` (product_number, position, table_id, markdown,
    column_count, row_count, page; one for each product_number and position) and their ``rows`` (product_number, position,
    row, cells; ``row`` counts a table's rows from 0: ``running.number`` gives it).

    ``scratch`` is a new folder, which driver and executors share; the result reads it.  ``rows`` are read four times, so
    they had better be a stored table.  Rows whose table is missing, or
    whose product, position or row is null, make no chunk; null cells count as an empty row; a table without rows is its
    Markdown.  Other columns of both are left out.
    """
    spark = tables.sparkSession

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{scratch}/{name}")
        return spark.read.parquet(f"{scratch}/{name}")

    blocks = saved(block_facts(rows), "blocks")
    facts = saved(table_facts(tables, blocks, across_rows(rows), max_tokens), "tables")
    facts = running(facts, ["product_number"], "position", {"sequence": F.col("n_chunks")}, {"section_before": F.when(F.col("own_section") != "general", F.col("own_section"))})
    facts = facts.where("emitted").withColumn("parent_section", F.when(F.col("own_section") != "general", F.col("own_section")).otherwise(F.col("section_before")))
    facts = facts.withColumns({"hash": F.substring(F.md5(F.concat_ws("-", "product_number", "table_id", F.col("sequence").cast("string"))), 1, 8), "headers": F.when(F.col("headed"), F.col("first")).otherwise(F.array().cast("array<string>"))})
    facts = saved(facts.drop("first", "words", "weedy", "stripped", *(f"{w}{i}" for w in ("hit", "over") for i in range(len(C.SECTIONS)))), "facts")

    gathered = facts.where("splits OR NOT marked")
    here = blocks.select(*KEYS, "block").join(gathered.select(*KEYS, "headed", "splits", "per"), KEYS)
    one = row_facts(rows).select(*KEYS, "block", "row", "line").join(here, [*KEYS, "block"])
    at = F.col("row") - F.col("headed").cast("int")
    one = one.where("NOT (splits AND headed AND row = 0)").withColumn("part", F.when(F.col("splits"), F.floor(at / F.col("per"))).otherwise(0))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"])
    parts = one.groupBy(*KEYS, "part").agg(lines.alias("lines")).select(*KEYS, "part", F.array_join("lines", "\n").alias("body"), F.size("lines").alias("size"))
    whole = facts.where("marked AND NOT splits").select(*KEYS, F.lit(0).cast("long").alias("part"), F.col("markdown").alias("body"), F.lit(None).cast("int").alias("size"))
    chunks = parts.unionByName(whole).join(facts.drop("markdown"), KEYS)
    head = F.when(F.size("headers") > 0, F.concat(F.array_join("headers", " | "), F.lit("\n"))).otherwise("")
    return chunks.select(
        F.when(F.col("splits"), F.concat_ws("-", "product_number", "table_id", F.concat(F.lit("part"), F.col("part").cast("string")), "hash")).otherwise(F.concat_ws("-", "product_number", "table_id", "hash")).alias("chunk_id"),
        F.when(F.col("splits"), F.concat(head, "body")).otherwise(F.col("body")).alias("text"), "chunk_type", (F.col("sequence") + F.col("part")).alias("sequence_order"), "product_number",
        "parent_section", "table_id", F.when(F.col("splits"), F.col("size")).otherwise(F.col("row_count")).alias("row_count"), "column_count", "headers", F.col("page").alias("page_number"),
    )


def explode_tables(tables: DataFrame) -> DataFrame:
    """The rows of tables that have them as arrays."""
    return tables.select(*KEYS, F.posexplode("rows").alias("row", "cells"))

