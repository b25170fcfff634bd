"""Readers and writers of label records, parsed tables, Markdown, CSV, pages and the ledger of processed files."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.functions.text import bind, strip

ENTRY = "crop string, application_timing string, weed_common_name string, weed_scientific_name string, states array<string>, rate_per_ha string, critical_comments string, control_level string"
LABEL_RECORD = (
    "product_number string, product_name string, active_constituent string, chemical_group string, mode_of_action_group string, registered_crops array<string>, registered_weeds array<string>, "
    f"weed_control_entries array<struct<{ENTRY.replace(' string', ': string').replace(' array', ': array')}>>, application_methods array<string>, state_restrictions array<string>, withholding_period string, "
    "compatible_products array<string>, _metadata struct<source_file: string, extracted_at: string, model: string>, _corrupt_record string"
)
PARSED_TABLES = (
    "source_path string, metadata struct<page_count: int, filesize: long, format: string>, text_items array<string>, tables array<struct<id: string, title: string, row_count: int, column_count: int, "
    "rows: array<array<string>>, markdown: string, bbox: struct<x0: double, y0: double, x1: double, y1: double, page: int>>>, _corrupt_record string"
)


def _stem(suffix: str) -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), suffix, "")


def first_files(spark: SparkSession, path: str, glob: str, limit: int, where: str = "true") -> list[str]:
    """The paths of the first ``limit`` files of a directory by name, of those whose ``file`` passes ``where``."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
    return [r["path"] for r in names.where(where).orderBy("file", "path").limit(limit).collect()]


def _files(spark: SparkSession, path: str, schema: str, glob: str, limit: int | None = None, where: str = "true") -> DataFrame:
    paths = path if limit is None else first_files(spark, path, glob, limit, where)
    if not paths:
        return spark.createDataFrame([], f"{schema}, file string")
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", glob).option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)
    return found.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_label_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row for each file; bad files have _corrupt_record.  Files that start with ``_`` and summaries are left out.
    ``seq`` is the order of file names, in which later records win; ``limit`` takes the first files of that order."""
    record = "NOT startswith(file, '_') AND file <> 'extraction_summary.json'"
    rows = _files(spark, path, LABEL_RECORD, "*.json", limit, record).where(record)
    return rows.withColumn("stem", F.regexp_replace("file", r"\.json$", "")).withColumn("seq", F.col("stem"))


def read_parsed_files(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row for each file (the first ``limit`` by name); bad files have _corrupt_record."""
    return _files(spark, path, PARSED_TABLES, "*.docling.json", limit)


def read_parsed_tables(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row for each table of each file, ready for chunk_tables(); read_parsed_files() tells bad files."""
    rows = read_parsed_files(spark, path, limit).withColumn("product_number", F.replace(F.regexp_replace("file", r"\.docling\.json$", ""), F.lit("ELBL"), F.lit("")))
    tables = rows.select("product_number", F.posexplode("tables").alias("position", "t"))
    return tables.select("product_number", "position", F.col("t.id").alias("table_id"), "t.rows", "t.markdown", "t.column_count", "t.row_count", F.col("t.bbox.page").alias("page"))


def read_markdown(spark: SparkSession, path: str, for_extraction: bool = False, limit: int | None = None) -> DataFrame:
    """file, text of whole Markdown files (the first ``limit`` by name).  Cleaned files are left out; for extraction also
    tests and names that start with ``_``."""
    where = "NOT endswith(file, '.cleaned.md')" + (" AND NOT startswith(file, '_') AND NOT contains(file, 'cleaned') AND NOT contains(file, 'test')" if for_extraction else "")
    paths = path if limit is None else first_files(spark, path, "*.md", limit, where)
    if not paths:
        return spark.createDataFrame([], "file string, text string")
    rows = spark.read.option("pathGlobFilter", "*.md").text(paths, wholetext=True)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text")).where(where)


def read_search_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, encoding="UTF-8")


def read_pdfs(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], limit: int | None = None) -> DataFrame:
    """file, text of PDFs (the first ``limit`` by name) by a parser of the caller's (bytes to page texts); pages are put behind rules and headings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for data in pdf["content"]:
                pages = parse(bytes(data))
                texts.append("\n\n".join(p if i == 0 else f"---\n## Page {i + 1}\n\n{p}" for i, p in enumerate(pages)))
            yield pd.DataFrame({"file": pdf["path"].str.rsplit("/", n=1).str[-1], "text": texts})

    paths = path if limit is None else first_files(spark, path, "*.pdf", limit)
    if not paths:
        return spark.createDataFrame([], "file string, text string")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(paths).select("path", "content").mapInPandas(run, "file string, text string")


def first_per_key(rows: DataFrame, key: str, order: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """The first row in ``order`` for each key.  The key and the columns ``needed`` are stripped of all white space; rows
    in which one of them is blank don't count."""
    trimmed = rows.withColumns({c: strip(F.col(c)) for c in (key, *needed)})
    for c in (key, *needed):
        trimmed = trimmed.where(F.coalesce(F.col(c), F.lit("")) != "")
    others = [c for c in trimmed.columns if c != key]
    return trimmed.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def page_links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Distinct links of each page."""
    return pages.select(key, F.explode(every_link(F.col(html))).alias("link")).distinct()


def every_link(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)


def first_cell_links(html: Column, table_class: str = "search-results-table") -> Column:
    """Of each row of a result table, but the first, the link in its first cell; menus and other cells' links don't count."""
    table = F.regexp_extract(html, rf'(?is)<table\b[^>]*class="(?:[^"]*\s)?{re.escape(table_class)}(?:\s[^"]*)?"[^>]*>(.*?)</table', 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|\z)"), 1)
    cell = lambda row: F.regexp_extract(row, r"(?is)<td\b[^>]*>(.*?)(?=<t[dh]\b|</t[dr]|\z)", 1)
    links = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda row: F.regexp_extract(cell(row), r'(?i)<a\s[^>]*href="([^"]*)"', 1))
    return F.filter(links, lambda x: x != "")


def result_links(pages: DataFrame, search: str, number: str, cap: int = 2, html: str = "html", links_of: Callable[[Column], Column] = every_link) -> DataFrame:
    """search, link, number of the page that has it first: the links that reading a search's result pages in order gives.

    ``links_of``: which links of a page count, as first_cell_links().  Reading ends before a page without links, at a page after the first that has no new ones, and after ``cap`` pages.
    """
    links = pages.select(search, number, F.explode_outer(links_of(F.col(html))).alias("link"))
    first = links.where("link IS NOT NULL").groupBy(search, "link").agg(F.min(number).alias(number))
    new = first.groupBy(search, number).agg(F.count(F.lit(1)).alias("new"))
    last = pages.select(search, number).join(new, [search, number], "left").where("new IS NULL")  # no links at all, or none that is new
    last = last.groupBy(search).agg(F.min(number).alias("stop"))
    kept = first.where(F.col(number) <= cap).join(last, search, "left").where(F.col("stop").isNull() | (F.col(number) < F.col("stop")))
    return kept.select(search, "link", number)


def link_by_text(html: Column, phrase: str) -> Column:
    """The first link whose text has a phrase, in any case; null if there is none."""
    anchor = F.lit(r'(?i)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a')
    has = F.transform(F.regexp_extract_all(html, anchor, 2), lambda t: F.contains(F.lower(t), F.lit(phrase.lower())))
    return bind(F.array_position(has, F.lit(True)).cast("int"), lambda at: F.when(at > 0, F.get(F.regexp_extract_all(html, anchor, 1), at - 1)))


def absolute(base: Column, link: Column) -> Column:
    """A link as an address: relative to the host if it starts with a slash, else to the page's folder."""
    host = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([a-z]+://[^?#]*/)", 1)
    return F.when(F.regexp_like(link, F.lit("^[a-z]+://")), link).when(F.startswith(link, F.lit("/")), F.concat(host, link)).otherwise(F.concat(F.when(F.length(folder) > F.length(host), folder).otherwise(F.concat(host, F.lit("/"))), link))


def file_name(url: Column) -> Column:
    """The last part of an address's path."""
    return F.substring_index(F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1), "/", -1)


def updated_ledger(ledger: DataFrame, done: DataFrame, key: str = "stem", at: str = "at") -> DataFrame:
    """The ledger with the files done since: of each file's entries the last in ``at``."""
    rows = ledger.unionByName(done)
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), at).alias("r")).select(key, "r.*")


def write_ledger(done: DataFrame, path: str) -> None:
    """Add entries; earlier ones stay, as a run that fails later must not lose them."""
    done.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str, key: str = "stem", at: str = "at") -> DataFrame:
    """The last entry of each file."""
    rows = spark.read.parquet(path)
    return updated_ledger(rows.limit(0), rows, key, at)


def pending(files: DataFrame, ledger: DataFrame, key: str = "stem") -> DataFrame:
    """Files that the ledger doesn't have."""
    return files.join(ledger.select(key).distinct(), key, "left_anti")


def tally(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


BLOCKS = T.StructType([T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("trailing", T.StringType())])


@F.pandas_udf(BLOCKS)
def split_json_blocks(texts: pd.Series) -> pd.DataFrame:
    """The JSON objects that stand one after the other at the start of a text, and the text behind them."""
    decoder = json.JSONDecoder()
    out = []
    for text in texts:
        blocks, at = [], 0
        while text is not None:
            begin = len(text) - len(text[at:].lstrip())
            if not text.startswith("{", begin):
                break
            try:
                _, end = decoder.raw_decode(text, begin)
            except ValueError:
                break
            blocks.append(text[begin:end])
            at = end
        out.append((blocks, None if text is None else text[at:].strip()))
    return pd.DataFrame(out, columns=["blocks", "trailing"])


def merge_blocks(files: DataFrame, key: str = "file") -> DataFrame:
    """Files that hold several blocks (key, blocks: JSON objects as strings, trailing: Markdown) as one record each.

    ``fields`` are the first block's own (values as JSON), ``tables`` those of all blocks in order (as JSON),
    ``text_items`` all non-blank strings of the blocks and then the Markdown's sections, ``raw_blocks`` what each block
    was.  Files with one block or none, and files with a block that is no JSON object, give no row.
    """
    fields = lambda b: F.from_json(b, "map<string,string>")
    strings = lambda b: F.transform(F.filter(F.variant_get(F.parse_json(b), "$.text_items", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    none = F.array().cast("array<string>")
    tables = lambda b: F.coalesce(F.from_json(F.element_at(fields(b), "tables"), "array<string>"), none)
    items = lambda b: F.filter(F.coalesce(strings(b), none), lambda x: strip(x) != "")
    has_items = lambda b: F.coalesce(F.get_json_object(b, "$.text_items[0]").isNotNull(), F.lit(False))
    has_text = F.coalesce(strip(F.col("trailing")), F.lit("")) != ""
    rows = files.where(F.coalesce(F.size("blocks"), F.lit(0)) + has_text.cast("int") > 1).where(F.size("blocks") > 0)
    rows = rows.where(F.forall("blocks", lambda b: F.try_parse_json(b).isNotNull() & fields(b).isNotNull()))
    sections = F.filter(F.transform(F.split("trailing", r"(?:^|\n)#+\s+", -1), strip), lambda x: x != "")
    raw = F.transform("blocks", lambda b, i: F.struct(i.alias("block_index"), F.lit("json").alias("type"), F.size(tables(b)).alias("num_tables"), has_items(b).alias("has_text_items"), F.lit(None).cast("string").alias("content_preview")))
    markdown = F.struct(F.size("blocks").alias("block_index"), F.lit("markdown").alias("type"), F.lit(None).cast("int").alias("num_tables"), F.lit(None).cast("boolean").alias("has_text_items"), F.concat(F.substring("trailing", 1, 100), F.lit("...")).alias("content_preview"))
    return rows.select(
        key, F.map_filter(fields(F.col("blocks")[0]), lambda k, v: ~k.isin("tables", "text_items")).alias("fields"), F.flatten(F.transform("blocks", tables)).alias("tables"),
        F.concat(F.flatten(F.transform("blocks", items)), F.when(has_text, sections).otherwise(none)).alias("text_items"), F.when(has_text, F.concat(raw, F.array(markdown))).otherwise(raw).alias("raw_blocks"),
    )


def write_json(rows: DataFrame, path: str, source: Column, model: str | None = None, at: Column | None = None) -> None:
    """Records with their provenance."""
    meta = F.struct(source.alias("source_file"), (at if at is not None else F.current_timestamp()).cast("string").alias("extracted_at"), F.lit(model).cast("string").alias("model"))
    rows.withColumn("_meta", meta).write.mode("overwrite").json(path)


def write_files(rows: DataFrame, path: str, value: str, file: str = "file") -> None:
    """A text for each input file, in a directory of its own (``file=<name>``), so that names are kept.  For JSON records,
    ``value`` is to_json() of them."""
    rows.select(F.col(value).alias("value"), F.col(file).alias("file")).write.mode("overwrite").option("lineSep", "\n").partitionBy("file").text(path)


def write_texts(rows: DataFrame, path: str, text: str = "cleaned") -> None:
    rows.select(F.col(text).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def chunk_json(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.to_json(F.struct("*")).alias("json"))
