"""Connected components by alternating large-star and small-star steps, all by grouping and joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm import shared


def _stars(pairs: DataFrame, large: bool, rows: int, paths: list[str]) -> DataFrame:
    """Link each vertex's larger (``large``) or smaller neighbours, and itself, to its least neighbour or itself.

    The least neighbours are written first: a join of two plain exchanges can deal the links of a vertex that has very
    many to several tasks, which one with an aggregate on top can't.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.where("b < a")
    least = shared.save(around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least", 2 * rows, paths)
    linked = around.join(least, F.col("a") == F.col("u"))
    out = linked.where("b > a" if large else "b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """member, component: for each end of a link (a, b), the least vertex that it reaches.

    ``rows``: at most so many links, if known.  The links of a step are written to the shared folder; the driver sees two
    numbers of each step.
    """
    paths: list[str] = []
    now = shared.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", rows, paths)
    before = None
    while True:  # a step never has more links than ends of links before it
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        rows = state[0]
        if state == before:  # the last step's links stay, for the result
            return now.select(F.col("a").alias("member"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("member"), F.col("b").alias("component"))).distinct()
        before = state
        old, paths = paths, []
        wide = shared.save(_stars(now, True, rows, old), "links", 2 * rows, old)
        now = shared.save(_stars(wide, False, 2 * rows, old), "links", 4 * rows, paths)
        shared.delete(now.sparkSession, old)
