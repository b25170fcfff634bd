"""Substring search by index: posting lists of three-letter grams, intersected and confirmed.

``add`` writes a row for each gram of a lower-cased text, in folders by hash of the gram and sorted by it, and keeps the
texts themselves in a keyed ``Store``.  ``search`` reads the folders of a term's rarest grams, intersects their lists, reads
the buckets of the candidates and confirms each by the text, so it equals a scan.  Postings are only added: those that
a newer text has made stale, or that a killed batch left, lead to candidates that the text refuses.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.text import has
from tillage.sources.store import Rule, Store

GRAM = 3
#: Folders of postings, and the tasks and files that a folder's postings are spread over, by their text.
FOLDERS, SALTS = 64, 4
#: Grams of a term that are intersected: the rarest ones.
GRAMS = 4
#: Characters of a text whose grams are made at a time.
PIECE = 4096


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    folders: int = FOLDERS
    salts: int = SALTS

    @property
    def store(self) -> Store:
        return Store(self.spark, f"{self.path}/texts")

    def folder_of(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.folders)).cast("int")

    def postings(self) -> DataFrame:
        kind = self.store.schema("text")["id"].dataType.simpleString()
        return self.spark.read.schema(f"gram string, id {kind}, batch string, folder int").parquet(f"{self.path}/postings")

    def counts(self) -> DataFrame:
        return self.spark.read.schema("gram string, n long, batch string, folder int").parquet(f"{self.path}/counts")


def grams(rows: DataFrame) -> DataFrame:
    """id, gram of each text (id, text) in lower case; a gram may come once for each piece of a long text."""
    piece = rf"(?s)(?=(.{{{GRAM},{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"
    pieces = rows.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(piece), F.lit(1))).alias("piece"))
    return pieces.select("id", F.explode(F.array_distinct(F.regexp_extract_all("piece", F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))).alias("gram"))


def build(rows: DataFrame, path: str, key: str, text: str = "text", folders: int = FOLDERS, salts: int = SALTS) -> TextIndex:
    """A new index over a text column at ``path``, which has to be free.  ``folders`` and ``salts`` grow with the table: a
    search reads a few folders, and a folder's lists are made by ``salts`` tasks.  A null text is found by no term."""
    index = TextIndex(rows.sparkSession, path.rstrip("/"), folders, salts)
    if index.store.numbers():
        raise FileExistsError(path)
    add(index, rows, key, text)
    return index


def add(index: TextIndex, rows: DataFrame, key: str, text: str = "text") -> None:
    """Add a batch; a text replaces the one stored under its key.  Keys are distinct in a batch and not null, or
    ``KeyViolation`` is raised.

    The lists come first, so that no version of the texts has one that the lists lack.  A frequent gram's list is spread over
    tasks and files by the texts' keys.
    """
    mine = rows.select(F.col(key).alias("id"), F.col(text).alias("text"))
    found = grams(mine).select(index.folder_of(F.col("gram")).alias("folder"), F.pmod(F.xxhash64("id"), F.lit(index.salts)).alias("salt"), "gram", "id")
    once = found.repartition("folder", "salt").dropDuplicates(["folder", "salt", "gram", "id"])
    lists = once.sortWithinPartitions("folder", "gram", "id").select("gram", "id", "folder")
    at = f"batch={uuid.uuid4().hex}"
    _write(lists, f"{index.path}/postings/{at}")
    own = index.spark.read.schema(lists.schema).parquet(f"{index.path}/postings/{at}")
    _write(own.groupBy("gram", "folder").agg(F.count(F.lit(1)).alias("n")).select("gram", "n", "folder").sortWithinPartitions("folder", "gram"), f"{index.path}/counts/{at}")
    index.store.merge({"text": mine}, {"text": Rule(("id",))}, buckets=index.folders)


def _write(rows: DataFrame, path: str) -> None:
    # Small row groups, in order of the grams: a search skips those that can't have its grams.
    rows.write.partitionBy("folder").option("compression", "zstd").option("parquet.block.size", str(8 << 20)).parquet(path)


def candidates(index: TextIndex, term: str) -> DataFrame | None:
    """id of the texts that have the rarest grams of a term; None if the term is too short to have any."""
    low = index.spark.range(1).select(F.lower(F.lit(term))).first()[0]
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return None
    folder = dict(index.spark.createDataFrame([(g,) for g in wanted], "gram string").select("gram", index.folder_of(F.col("gram"))).collect())  # a term's grams
    mine = lambda grams: F.col("folder").isin({folder[g] for g in grams}) & F.col("gram").isin(grams)
    totals = index.counts().where(mine(wanted)).groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").collect()
    postings = index.postings()
    if len(totals) < len(wanted):  # a gram that no text has
        return postings.select("id").where(F.lit(False))
    rare = [r["gram"] for r in totals[:GRAMS]]
    bit = F.lit(0)
    for i, gram in enumerate(rare):
        bit = F.when(F.col("gram") == gram, 1 << i).otherwise(bit)
    return postings.where(mine(rare)).groupBy("id").agg(F.bit_or(bit).alias("bits")).where(F.col("bits") == (1 << len(rare)) - 1).select("id")


def search(index: TextIndex, term: str) -> DataFrame:
    """id, text of all texts that have ``term`` in any case: what a scan finds.  Terms of less than three characters scan."""
    ids = candidates(index, term)
    return (index.store.read("text") if ids is None else index.store.lookup("text", ids)).where(has(F.col("text"), term))
