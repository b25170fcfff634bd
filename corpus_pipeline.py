"""A corpus, cleaned and packed: five stages, each writing what it keeps for the next one.

Columns beyond doc_id, text and source are handed on as they are, whatever their names, but n_chars, which follows the
text.  A null or empty text has no words: quality rules drop it, and the other stages would hand it on (line_dedup as an
empty text).  Rows with a null id are documents of their own.  Rows that repeat an id or a whole row are judged each on
its own, and of near-duplicates one row stays.  A tie goes to the smallest id, and among rows of one id to one text by
its hash.  Long texts are taken whole.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import line_dedup, near_dedup, packing, quality_rules, shared, substring_dedup


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with numbered columns, so that none has the name of one that an operator adds, and the number of each."""
    at = {c: f"u{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*at.values()), at


def _with_text(docs: DataFrame, changed: DataFrame, at: dict[str, str], text: F.Column) -> DataFrame:
    """``changed`` in the columns of ``docs``, with a new text and its length."""
    new = {"text": text}
    if "n_chars" in at:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return changed.select(*(new.get(c, F.col(at[c])).alias(c) for c in docs.columns))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go from all texts."""
    own, at = _numbered(docs)
    return _with_text(docs, line_dedup.dedup_lines(own, at["text"]), at, F.col(at["text"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return near_dedup.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; texts without any stay as they are."""
    own, at = _numbered(docs)
    found = substring_dedup.remove_repeats(own, at["doc_id"], at["text"])
    return _with_text(docs, found, at, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(at["text"])))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all texts, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("best_fit_packing", packed),
]
#: Best-fit packing is beyond SQL: tests/llm/test_pipeline.py holds each stage against SQL or brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
