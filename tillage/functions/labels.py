"""Fields of product labels: states, rates, metadata and usage tables, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.functions.text import bind, strip

# Names of states and their codes.
ALL_STATES = ["NSW", "VIC", "QLD", "SA", "WA", "TAS", "NT", "ACT"]
STATE_NAMES = {
    "all states": ALL_STATES, **{c.lower(): [c] for c in ALL_STATES}, "western australia": ["WA"], "south australia": ["SA"],
    "queensland": ["QLD"], "victoria": ["VIC"], "new south wales": ["NSW"],
}
# Fixed values here and below: the pattern of rate units, and those of the fields of labels, first pages and usage tables.
UNIT = r"(?iU)(m?L|g|kg)\s*/\s*ha"


def normalise_states(raw: Column) -> Column:
    """Codes of the states named, in order, each once."""
    names = F.create_map(*(x for name, codes in STATE_NAMES.items() for x in (F.lit(name), F.array(*map(F.lit, codes)))))
    pieces = F.transform(F.split(F.lower(raw), r"[,/]|\band\b", -1), strip)
    codes = F.transform(pieces, lambda p: F.coalesce(names[p], F.when(F.endswith(p, F.lit(" only")), names[F.regexp_replace(p, " only$", "")]), F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(codes))


def rate_value(text: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\d+(?:\.\d+)?"), 0), lambda x: x.cast("double")))


def rate_unit(text: Column) -> Column:
    unit = F.regexp_extract(text, UNIT, 0)
    return F.when(unit != "", F.replace(unit, F.lit(" "), F.lit(""))).otherwise(strip(text))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, stripped; null without a match."""
    return F.when(F.regexp_like(text, F.lit(pattern)), strip(F.regexp_extract(text, pattern, group)))


def product_metadata(text: Column, file_name: Column) -> Column:
    return F.struct(
        F.replace(F.replace(file_name, F.lit("ELBL"), F.lit("")), F.lit(".pdf"), F.lit("")).alias("product_number"), file_name.alias("source_file"),
        _first(text, r"(?dUi)Product Name:\s*\n?\s*(.+?)(?:\n|\z)").alias("product_name"),
        _first(text, r"(?dUi)APVMA Approval No:\s*\n?\s*(\d+(?:\s*/\s*\d+)?)").alias("apvma_number"),
        F.replace(_first(text, r"(?dUis)Active Constituents?:\s*\n?\s*(.+?)(?:\n\n|\nMode|\nStatement|\nNet)"), F.lit("\n"), F.lit(" ")).alias("active_constituent"),
        _first(text, r"(?dUi)GROUP\s+([A-Z0-9]+)\s+HERBICIDE").alias("mode_of_action_group"),
    )


def first_page_metadata(text: Column) -> Column:
    """Name (first line in capitals among ten, or the label's name), approval number, active, group and signal heading."""
    lines = F.transform(F.slice(F.split(text, "\n", -1), 1, 10), strip)
    loud = F.filter(lines, lambda x: (F.length(x) > 5) & (x == F.upper(x)) & (x != F.lower(x)) & ~F.regexp_like(F.lower(x), F.lit("product name:|apvma|label name:")))
    return F.struct(
        F.coalesce(_first(text, r"(?dU)Label Name:\s*\n?\s*(.+?)(?:\n|Signal)"), F.get(loud, 0)).alias("product_name"),
        _first(text, r"(?U)(\d{4,6})\s*/\s*\d+").alias("apvma_number"),
        F.split(_first(text, r"(?dUis)Active Constituents?:\s*(.+?)(?:\nMode of Action|\n?\z)"), "\n")[0].alias("active_constituent"),
        _first(text, r"(?U)GROUP\s+([A-Z0-9]+)\s+HERBICIDE").alias("mode_of_action_group"),
        _first(text, "(POISON|CAUTION|WARNING|DANGEROUS POISON)").alias("signal_heading"),
    )


def build_frontmatter(**values: Column) -> Column:
    """Values that hold a colon, a quote or a line end are quoted."""
    lines = []
    for key, value in values.items():
        text = value.cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))
        lines.append(F.concat(F.lit(f"{key}: "), F.when(F.regexp_like(text, F.lit('[:\n"]')), quoted).otherwise(text)))
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---\n\n"))


def table_to_markdown(headers: Column, rows: Column) -> Column:
    """A Markdown table; empty without headers or rows."""
    cell = lambda c: F.coalesce(F.replace(strip(c), F.lit("\n"), F.lit(" ")), F.lit(""))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    head = F.transform(headers, lambda h: F.coalesce(strip(h), F.lit("")))
    body = F.array_join(F.transform(rows, lambda r: line(F.transform(r, cell))), "")
    full = F.concat(line(head), line(F.transform(headers, lambda h: F.lit("---"))), body)
    return F.when((F.coalesce(F.size(headers), F.lit(0)) > 0) & (F.coalesce(F.size(rows), F.lit(0)) > 0), full).otherwise("")


def parse_table(lines: Column) -> Column:
    """The cells of the leading lines that start with a bar."""

    def leading(stripped: Column) -> Column:
        stop = F.array_position(F.transform(stripped, lambda x: F.startswith(x, F.lit("|"))), F.lit(False)).cast("int")
        return F.when(stop > 0, F.slice(stripped, 1, stop - 1)).otherwise(stripped)

    kept = bind(F.transform(lines, strip), leading)
    return F.transform(kept, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|", -1), strip))


def usage_records(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with record (a graph-ready label record or null) and problem (null if there is none).

    All of it is one expression, whose steps are bound: a column named inside a lambda would be worked out again for each
    element, hence the whole table for each of its rows.
    """
    cells_of = lambda r: F.struct(
        r[0].alias("crop"), strip(r[1]).alias("weed_text"), F.filter(F.transform(F.split(r[1], "[,/]", -1), strip), lambda w: w != "").alias("weeds"), normalise_states(r[2]).alias("states"),
        rate_value(r[3]).alias("rate_value"), rate_unit(r[3]).alias("rate_unit"), strip(r[3]).alias("rate"), strip(r[4]).alias("note"),
    )
    note = lambda x: F.when(x["note"] != "", F.array(F.struct(F.lit("Timing").alias("type"), x["note"].alias("description")))).otherwise(F.array().cast("array<struct<type: string, description: string>>"))
    usage = lambda x: F.struct(
        x["crop"].alias("crop"), F.coalesce(F.get(x["weeds"], 0), x["weed_text"]).alias("weed_common_name"), F.lit(None).cast("string").alias("weed_scientific_name"),
        F.when(F.size(x["states"]) > 0, x["states"]).otherwise(F.array(F.lit("All States"))).alias("states"), F.coalesce(x["rate_value"], F.lit(0.0)).alias("rate_value"), x["rate_unit"].alias("rate_unit"), x["rate"].alias("rate_full_text"),
        F.lit(None).cast("string").alias("growth_stage_weed"), F.lit(None).cast("string").alias("growth_stage_crop"), note(x).alias("constraints"),
    )

    def table_of(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: F.startswith(strip(x), F.lit("|"))), F.lit(True)).cast("int")
        return F.when(first > 0, parse_table(F.slice(lines, first, F.size(lines)))).otherwise(F.array().cast("array<array<string>>"))

    def record_of(t: Column, rows: Column) -> Column:
        actives = F.transform(F.regexp_extract_all(t, F.lit(r"(?U)Active Constituent:\s*([^\n]+)"), 1), strip)
        return F.struct(
            _first(t, r"(?dUm)^#\s+(.+)$").alias("product_name"), F.replace(_first(t, r"(?U)APVMA Approval No:\s*([^\n]+)"), F.lit(" "), F.lit("")).alias("apvma_number"), actives.alias("active_constituents"),
            F.lit(None).cast("string").alias("moa_number"), _first(t, r"(?U)GROUP\s+([A-Z0-9]+)\s+HERBICIDE").alias("moa_legacy_letter"),
            F.array_sort(F.array_distinct(rows["crop"])).alias("identified_crops"), F.array_sort(F.array_distinct(F.flatten(rows["weeds"]))).alias("identified_weeds"), F.transform(rows, usage).alias("usage_scenarios"),
        )

    def judged(at: Column, size: Column, rows: Column, record: Column) -> Column:
        incomplete = (F.coalesce(record["product_name"], F.lit("")) == "") | (F.coalesce(record["apvma_number"], F.lit("")) == "") | (F.size(record["active_constituents"]) == 0)
        problem = F.when(at == 0, "missing-directions").when(size < 3, "missing-table").when(F.size(rows) == 0, "empty-usage").when(incomplete, "incomplete-metadata")
        return bind(problem, lambda p: F.struct(F.when(p.isNull() | (p == "incomplete-metadata"), record).alias("record"), p.alias("problem")))

    def read(t: Column) -> Column:
        def of_table(at: Column, table: Column) -> Column:
            body = bind(F.size(F.get(table, F.lit(0))), lambda width: F.filter(F.slice(table, 3, F.greatest(F.size(table), F.lit(1))), lambda r: (F.size(r) >= width) & (F.size(r) >= 5)))
            return bind(F.transform(body, cells_of), lambda rows: bind(record_of(t, rows), lambda record: judged(at, F.size(table), rows, record)))

        def of_block(at: Column) -> Column:
            block = F.regexp_replace(F.substring(t, at, F.length(t)), r"(?s)\A.*?\n\n", "")
            return bind(bind(F.split(block, "\r\n|\n|\r", -1), table_of), lambda table: of_table(at, table))

        return bind(F.instr(F.lower(t), "# directions for use"), of_block)

    out = docs.withColumn("_read", bind(F.col(text), read))
    return out.withColumns({"record": F.col("_read.record"), "problem": F.col("_read.problem")}).drop("_read")


def to_label_record(record: Column) -> Column:
    """A graph-ready record in the shape that load_labels() reads."""
    entry = lambda u: F.struct(
        u["crop"].alias("crop"), F.lit(None).cast("string").alias("application_timing"), u["weed_common_name"].alias("weed_common_name"), u["weed_scientific_name"].alias("weed_scientific_name"), u["states"].alias("states"),
        u["rate_full_text"].alias("rate_per_ha"), F.get(u["constraints"], 0)["description"].alias("critical_comments"), F.lit("control").alias("control_level"),
    )
    return F.struct(
        record["apvma_number"].alias("product_number"), record["product_name"].alias("product_name"), F.array_join(record["active_constituents"], ", ").alias("active_constituent"), F.lit(None).cast("string").alias("chemical_group"),
        record["moa_legacy_letter"].alias("mode_of_action_group"), record["identified_crops"].alias("registered_crops"), record["identified_weeds"].alias("registered_weeds"), F.transform(record["usage_scenarios"], entry).alias("weed_control_entries"),
        F.array().cast("array<string>").alias("application_methods"), F.array_distinct(F.flatten(F.transform(record["usage_scenarios"], lambda u: u["states"]))).alias("state_restrictions"), F.lit(None).cast("string").alias("withholding_period"),
    )


MIN_DOCUMENT = 100


def long_enough(text: Column) -> Column:
    """Whether a document has enough text to extract from."""
    return F.coalesce(F.length(strip(text)) >= MIN_DOCUMENT, F.lit(False))


def truncate(text: Column, size: int = 15_000, marker: str = "\n\n[... truncated ...]") -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(marker))).otherwise(text)


def page_count(candidates: Column, documents: Column) -> Column:
    """The largest positive candidate, or the number of documents."""
    return F.coalesce(F.array_max(F.filter(candidates, lambda x: x > 0)), documents)


def table_quality(text_items: Column, tables: Column) -> Column:
    """Counters over text items (strings) and tables (array<array<array<string>>>), and why the extraction is poor."""
    cells = F.flatten(F.flatten(tables))
    solid = F.filter(F.transform(cells, strip), lambda c: c != "")
    chars = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.coalesce(F.length(strip(x)), F.lit(0)))
    n_items, n_tables = F.coalesce(F.size(text_items), F.lit(0)), F.coalesce(F.size(tables), F.lit(0))
    n_solid, n_chars = F.coalesce(F.size(solid), F.lit(0)), F.coalesce(chars(text_items), F.lit(0))
    reasons = F.array_compact(F.array(
        F.when((n_items == 0) & (n_tables == 0), "no_text_no_tables"), F.when((n_chars < 50) & (n_solid < 3), "very_little_text_and_table_cells"), F.when((n_tables > 0) & (n_solid == 0), "tables_present_but_empty"),
    ))
    return F.struct(
        n_items.alias("num_text_items"), n_chars.alias("text_chars"), n_tables.alias("num_tables"), F.coalesce(F.size(cells), F.lit(0)).alias("total_cells"), n_solid.alias("nonempty_cells"),
        F.coalesce(chars(solid), F.lit(0)).alias("cell_chars"), (F.size(reasons) > 0).alias("poor"), reasons.alias("reasons"),
    )
