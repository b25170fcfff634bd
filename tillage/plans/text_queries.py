"""Registered text, label, guardrail and source queries, with their SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions import cleaning, guardrails, labels
from tillage.functions.text import normalize, preview, tokens
from tillage.plans import binding as B
from tillage.plans.chunk_queries import order_tables
from tillage.plans.entity_queries import Query
from tillage.sources import readers
from tillage.streaming import held, violations

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def on(table: str, columns: Callable[[], tuple]) -> Query:
    """A selection from a table; columns are made when the query is, as they need a session."""
    return lambda s, d: B.table(s, d, table).select(*columns())


def t() -> Column:
    return F.col("text")


add("normalized_text", on("documents", lambda: ("doc_id", normalize(t()).alias("normal"), tokens(t()).alias("n_tokens"))), r"SELECT doc_id, trim(regexp_replace(lower(text), '[\s\x0b]+', ' ', 'g')) AS normal, len(regexp_extract_all(text, '[^\s\x0b]+'))::INTEGER AS n_tokens FROM documents")
add("previews", on("documents", lambda: ("doc_id", preview(t(), 500).alias("long"), preview(t(), 300, True).alias("short"))), "SELECT doc_id, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS long, replace(CASE WHEN length(text) > 300 THEN text[1:300] || '...' ELSE text END, chr(10), ' ') AS short FROM documents")
def noise_sql(text: str, rules: list[tuple[str, str]]) -> str:
    """The rules in DuckDB's dialect, which has neither (?dU) nor lookahead."""
    for pattern, new in rules:
        flags, body = re.match(r"(?s)(?:\(\?([a-zA-Z]+)\))?(.*)", pattern).groups()
        own = "".join(c for c in flags or "" if c in "mis")
        body = body.replace(r"(?=\n\*\*[A-Z]|\z)", r"(\n\*\*[A-Z]|\z)") if r"(?=" in body else body
        new = r"\2" if "AND" in body and "ENVIRONMENT" in body else r"\1" if r"(\n\*\*[A-Z]|\z)" in body else new
        text = f"regexp_replace({text}, '{(f'(?{own})' if own else '') + body}', '{new}', 'g')"
    return text


NOISY = """'Page 3 of 9' || chr(10) || '5/01/99' || chr(10) || replace(text, '. ', '.' || chr(10) || ' ' || chr(10) || chr(10) || chr(10) || chr(10) || '12' || chr(10) || '<b>') || chr(10) || 'Draft label' || chr(10) || '20L' || chr(10)"""
add(
    "clean_noise",
    on("documents", lambda: ("doc_id", cleaning.sub_if(F.concat(F.lit("Page 3 of 9\n5/01/99\n"), F.replace(t(), F.lit(". "), F.lit(".\n \n\n\n\n12\n<b>")), F.lit("\nDraft label\n20L\n")), cleaning.NOISE_RULES).alias("cleaned"))),
    f"SELECT doc_id, {noise_sql(NOISY, cleaning.NOISE)} AS cleaned FROM documents",
)
# The SQL leaves out what no document has: frontmatter, and the boilerplate of which the first stays.
TIDY = r"""trim(regexp_replace(regexp_replace(regexp_replace(b, '(?m)^[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), E' \n\t\r\f\x0b\x1c\x1d\x1e\x1f')"""
BLOCKS = r"""SELECT doc_id, coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (length(trim(p, E' \n\t\r')) < 50 OR first = i), '') AS b FROM (
  SELECT doc_id, i, p, min(i) OVER (PARTITION BY doc_id, trim(regexp_replace(lower(p), '\s+', ' ', 'g'))) AS first
  FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS p FROM (SELECT doc_id, string_split_regex(n, '\n{{2,}}') AS s FROM ({0})))) GROUP BY doc_id"""
add(
    "clean_documents",
    lambda s, d: cleaning.clean_documents(B.table(s, d, "documents").select("doc_id", "text")).select("doc_id", "cleaned"),
    f"SELECT doc_id, chr(10) || {TIDY} || chr(10) AS cleaned FROM ({BLOCKS.format(f'SELECT doc_id, {noise_sql("text", cleaning.NOISE + cleaning.SECTION_RULES + cleaning.PHONES)} AS n FROM documents')})",
)
LABEL_HEAD = "# **SPRAY**\n**Herbicide**\nActive Constituent: 100 g/L X\n\n# **GROUP A HERBICIDE**"
LABEL_TAIL = "# **group a herbicide**\n\nFIRST AID:\nwash\n**CROPS**\n\nPhone Australia 13 11 26 now\n\n**KEEP OUT OF REACH OF CHILDREN**\n**READ SAFETY DIRECTIONS BEFORE OPENING OR USING**\n\nWARRANTY:\nnone"

LABEL_LEFT = f"---\nid: 1\n---\n\n{LABEL_HEAD}\n\n**CROPS**\n\n**KEEP OUT OF REACH OF CHILDREN**\n**READ SAFETY DIRECTIONS BEFORE OPENING OR USING**\n"


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents between the head and the tail of a label, each with boilerplate that a copy of it follows."""
    parts = (F.lit("---\nid: 1\n---\n" + LABEL_HEAD + "\n\n"), F.replace(t(), F.lit("\n"), F.lit(" ")), F.lit("\n\n" + LABEL_HEAD.replace("SPRAY", "Spray") + "\n\n" + LABEL_TAIL))
    return B.table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"))


add(
    "clean_labels",
    lambda s, d: cleaning.clean_documents(label_texts(s, d)).select("doc_id", F.regexp_replace("cleaned", r"(?s)\A(---\nid: 1\n---\n\n# \*\*SPRAY.*?# \*\*GROUP A HERBICIDE\*\*)\n\n.*?(\n\n\*\*CROPS.*)\z", "$1$2").alias("frame"), F.length("cleaned").alias("n")),
    f"""SELECT doc_id, frame, length(frame) + CASE WHEN x = '' THEN 0 ELSE length(x) + 2 END AS n
FROM (SELECT doc_id, {" || chr(10) || ".join(f"'{line}'" for line in LABEL_LEFT.split(chr(10)))} AS frame, rtrim({noise_sql("replace(text, chr(10), ' ')", cleaning.NOISE + cleaning.SECTION_RULES + cleaning.PHONES)}) AS x FROM documents)""",
)
add(
    "clean_html",
    on("pages", lambda: ("page_id", F.sha2(cleaning.strip_html(F.col("html")), 256).alias("text_sha256"))),
    r"""SELECT page_id, sha256(trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))) AS text_sha256 FROM pages""",
)
def blocks() -> Column:
    return F.regexp_replace(t(), "\n", "\n\n")


add(
    "dedup_blocks",
    on("documents", lambda: ("doc_id", cleaning.keep_first_blocks(blocks()).alias("kept"))),
    r"""SELECT doc_id, coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (length(trim(p)) < 50 OR first = i), '') AS kept FROM (
  SELECT doc_id, i, p, min(i) OVER (PARTITION BY doc_id, trim(regexp_replace(lower(p), '\s+', ' ', 'g'))) AS first
  FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS p FROM (SELECT doc_id, string_split_regex(text, '\n+') AS s FROM documents))) GROUP BY doc_id""",
)
add(
    "size_reduction",
    lambda s, d: (lambda r: r.select(r.doc_id, *(c.alias(n) for c, n in zip(cleaning.reduction(F.col("text"), F.col("kept")), ("before", "after", "saved")))))(B.table(s, d, "documents").select("doc_id", "text", F.replace(t(), F.lit("the "), F.lit("")).alias("kept"))).withColumn("saved", F.round("saved", 4)),
    "SELECT doc_id, length(text)::INTEGER AS before, length(replace(text, 'the ', ''))::INTEGER AS after, CASE WHEN length(text) > 0 THEN round((length(text) - length(replace(text, 'the ', ''))) / length(text) * 100, 4) ELSE 0 END AS saved FROM documents",
)
add("join_hyphens", on("documents", lambda: ("doc_id", cleaning.clean_page_text(F.replace(t(), F.lit("tion"), F.lit("ti-\non"))).alias("joined"))), r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, 'tion', 'ti-' || chr(10) || 'on'), '\n{3,}', chr(10) || chr(10), 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), E' \n\t\r') AS joined FROM documents")
def with_front() -> Column:
    return F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\n---"))).otherwise(""), t())


add(
    "frontmatter_split",
    on("documents", lambda: ("doc_id", cleaning.frontmatter(with_front())[0].alias("front"), F.length(cleaning.frontmatter(with_front())[1]).alias("body_chars"))),
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'id: ' || doc_id || chr(10) || '---' || chr(10) ELSE '' END AS front, length(text)::INTEGER AS body_chars FROM documents",
)
add("truncated", on("documents", lambda: ("doc_id", F.length(labels.truncate(t(), 1000, "[...]")).alias("n"))), "SELECT doc_id, CASE WHEN length(text) > 1000 THEN 1005 ELSE length(text) END::INTEGER AS n FROM documents")

def raw_states() -> Column:
    return F.element_at(F.array(*map(F.lit, ("NSW and Vic only", "All States", "Tasmania", "WA, SA/Qld", "Western Australia only", ""))), (F.col("c_custkey") % 6 + 1).cast("int"))


add(
    "normalise_states",
    on("customer", lambda: ("c_custkey", labels.normalise_states(raw_states()).alias("states"))),
    "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ['NSW', 'VIC'] WHEN 1 THEN ['NSW', 'VIC', 'QLD', 'SA', 'WA', 'TAS', 'NT', 'ACT'] WHEN 3 THEN ['WA', 'SA', 'QLD'] WHEN 4 THEN ['WA'] ELSE [] END AS states FROM customer",
)
def rate_text() -> Column:
    return F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(".5 - "), (F.col("l_linenumber") * 3).cast("string"), F.when(F.col("l_returnflag") == "A", " mL / ha").when(F.col("l_returnflag") == "R", "kg/ha").otherwise(" see label "))


add(
    "extract_rate",
    on("lineitem", lambda: ("l_orderkey", "l_linenumber", "l_partkey", labels.rate_value(rate_text()).alias("value"), labels.rate_unit(rate_text()).alias("unit"))),
    "SELECT l_orderkey, l_linenumber, l_partkey, greatest(CAST(l_quantity AS BIGINT) + 0.5, l_linenumber * 3)::DOUBLE AS value, CASE l_returnflag WHEN 'A' THEN 'mL/ha' WHEN 'R' THEN 'kg/ha' ELSE CAST(l_quantity AS BIGINT) || '.5 - ' || (l_linenumber * 3) || ' see label' END AS unit FROM lineitem",
)


def label_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label Markdown for each product, as a converter would write it."""
    part = B.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_number"), "p_name", "p_type", "p_brand", "p_size")
    lines = order_tables(spark, sf_dir).where("position = 0").select("product_number", labels.table_to_markdown(F.col("rows")[0], F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1)))).alias("table"))
    head = F.concat(F.lit("# "), F.col("p_name"), F.lit("\nAPVMA Approval No: "), F.col("product_number"), F.lit(" / "), F.col("p_size").cast("string"), F.lit("\nActive Constituent: "), F.col("p_type"), F.lit("\nGROUP B HERBICIDE\n\n# DIRECTIONS FOR USE\n\n"))
    return part.join(lines, "product_number", "left").select("product_number", F.concat(head, F.coalesce("table", F.lit("none")), F.lit("\nend\n")).alias("text"))


USAGE = B.SQL.rstrip() + ", a AS (SELECT * FROM raw WHERE l_returnflag = 'A')\n"
# An outer explode, as a filter on the sizes of the arrays, which Spark puts before the other, would make all records twice.
add(
    "usage_rows",
    lambda s, d: labels.usage_records(label_markdown(s, d)).select("product_number", F.explode_outer("record.usage_scenarios").alias("u")).where("u IS NOT NULL").select("product_number", "u.crop", F.col("u.weed_common_name").alias("weed"), F.array_join("u.states", ",").alias("states"), "u.rate_value", "u.rate_unit", F.col("u.constraints")[0]["description"].alias("note")),
    USAGE + "SELECT product_number, crop, weed, 'All States' AS states, CAST(rate_per_ha AS DOUBLE) AS rate_value, 'L/ha' AS rate_unit, critical_comments AS note FROM a",
)
add(
    "usage_problems",
    lambda s, d: readers.tally(labels.usage_records(label_markdown(s, d)).withColumn("status", F.coalesce("problem", F.lit("ok"))), "status"),
    USAGE + "SELECT status, count(*) AS n FROM (SELECT CASE WHEN n IS NULL THEN 'missing-table' ELSE 'ok' END AS status FROM herbicide LEFT JOIN (SELECT product_number, count(*) AS n FROM a GROUP BY 1) USING (product_number)) GROUP BY 1",
)
add(
    "label_metadata",
    lambda s, d: label_markdown(s, d).select("product_number", labels.first_page_metadata(F.col("text")).alias("m")).select("product_number", "m.product_name", "m.apvma_number", "m.active_constituent", "m.mode_of_action_group", "m.signal_heading"),
    "SELECT CAST(p_partkey AS VARCHAR) AS product_number, 'GROUP B HERBICIDE' AS product_name, CASE WHEN p_partkey >= 1000 THEN CAST(p_partkey AS VARCHAR)[-6:] END AS apvma_number, p_type AS active_constituent, 'B' AS mode_of_action_group, CAST(NULL AS VARCHAR) AS signal_heading FROM part",
)


def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text items and tables of each product, as a layout model would give them; some have no text, some short text alone."""
    tables = order_tables(spark, sf_dir).groupBy("product_number").agg(F.collect_list("rows").alias("tables"))
    key = F.col("p_partkey")
    items = F.when(key % 3 == 0, F.array(F.col("p_name"), F.lit(" "), F.lit(" x "))).when(key % 3 == 1, F.array(F.lit("A label's text of more than fifty characters, all in all.")))
    part = B.table(spark, sf_dir, "part").select(key.cast("string").alias("product_number"), key.alias("p_partkey"), items.alias("items"))
    return part.join(tables, "product_number", "left").withColumn("tables", F.when(key % 10 < 8, F.col("tables")))


add(
    "quality_report",
    lambda s, d: parsed_files(s, d).select("product_number", labels.table_quality(F.col("items"), F.col("tables")).alias("q")).select("product_number", "q.num_text_items", "q.text_chars", "q.num_tables", "q.total_cells", "q.nonempty_cells", "q.cell_chars", "q.poor", F.array_join("q.reasons", ",").alias("reasons")),
    B.SQL.rstrip() + """, c AS (
  SELECT product_number, l_returnflag, CASE l_returnflag WHEN 'R' THEN 2 ELSE 5 END AS n, length(rate_per_ha) + CASE l_returnflag WHEN 'A' THEN 5 ELSE 6 END + length(critical_comments)
    + CASE l_returnflag WHEN 'R' THEN 0 ELSE length(crop) + length(weed) + length(states[1]) END AS chars FROM raw
), g AS (
  SELECT product_number, count(DISTINCT l_returnflag) AS n_tables, sum(n) + 5 * count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'R') AS cells, sum(chars) + 24 * count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'R') AS chars FROM c GROUP BY 1
), q AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_number, CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END::INTEGER AS num_text_items, CASE p_partkey % 3 WHEN 0 THEN length(p_name) + 1 WHEN 1 THEN 57 ELSE 0 END::INTEGER AS text_chars,
    CASE WHEN p_partkey % 10 < 8 THEN coalesce(n_tables, 0) ELSE 0 END::INTEGER AS num_tables, CASE WHEN p_partkey % 10 < 8 THEN coalesce(cells, 0) ELSE 0 END::INTEGER AS total_cells, CASE WHEN p_partkey % 10 < 8 THEN coalesce(chars, 0) ELSE 0 END::INTEGER AS cell_chars
  FROM part LEFT JOIN g ON g.product_number = CAST(p_partkey AS VARCHAR)
), r AS (SELECT *, concat_ws(',', CASE WHEN num_text_items = 0 AND num_tables = 0 THEN 'no_text_no_tables' END, CASE WHEN text_chars < 50 AND total_cells < 3 THEN 'very_little_text_and_table_cells' END) AS reasons FROM q)
SELECT *, total_cells AS nonempty_cells, reasons <> '' AS poor FROM r""",
)

PII_SQL = {name: pattern.replace("'", "''") for name, pattern in guardrails.PII.items()}
MATCHES = {name: f"regexp_matches(text, '{p}')" for name, p in PII_SQL.items()}
add("pii_flags", on("documents", lambda: ("doc_id", guardrails.has_pii(t()).alias("pii"))), "SELECT doc_id, " + " OR ".join(MATCHES.values()) + " AS pii FROM documents")
add("pii_types", on("documents", lambda: ("doc_id", F.array_join(guardrails.pii_types(t()), ",").alias("types"))), "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {m} THEN '{n}' END" for n, m in MATCHES.items()) + ") AS types FROM documents")
REDACTED = "text"
for _p in PII_SQL.values():
    REDACTED = f"regexp_replace({REDACTED}, '{_p}', '[REDACTED]', 'g')"
add("pii_redact", on("documents", lambda: ("doc_id", F.sha2(guardrails.redact(t()), 256).alias("redacted_sha256"))), f"SELECT doc_id, sha256({REDACTED}) AS redacted_sha256 FROM documents")
OFF, FARM = ("regexp_matches(lower(text), '" + "|".join(words) + "')" for words in (guardrails.OFF_TOPIC, guardrails.AGRICULTURE))
add("topic_class", on("documents", lambda: ("doc_id", guardrails.topic(t()).alias("topic"))), f"SELECT doc_id, CASE WHEN {OFF} THEN 'off_topic' WHEN {FARM} THEN 'agriculture' ELSE 'neutral' END AS topic FROM documents")
add("topic_class_farm_first", on("conversations", lambda: ("conv_id", "turn", guardrails.topic(t(), False).alias("topic"))), f"SELECT conv_id, turn, CASE WHEN {FARM} THEN 'agriculture' WHEN {OFF} THEN 'off_topic' ELSE 'neutral' END AS topic FROM conversations")
ANY = " OR ".join(MATCHES.values())
add("message_rails", lambda s, d: guardrails.check_messages(B.table(s, d, "conversations")).select("conv_id", "turn", "passed", "violation_type", "bot_message"), f"SELECT conv_id, turn, v IS NULL AS passed, v AS violation_type, CASE WHEN v = 'pii' THEN '{guardrails.REJECTION}' END AS bot_message FROM (SELECT *, CASE WHEN {ANY} THEN 'pii' WHEN {OFF} THEN 'off_topic' END AS v FROM conversations)")
RATES = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
add("violation_rate_hourly", lambda s, d: guardrails.violation_rates(B.table(s, d, "events"), "ts", "event_type"), RATES)
add("violation_alerts", lambda s, d: guardrails.alerts(guardrails.violation_rates(B.table(s, d, "events"), "ts", "event_type"), 3), RATES + " HAVING count(*) > 3")
add("violation_alerts_5_minutes", lambda s, d: guardrails.alerts(guardrails.violation_rates(B.table(s, d, "events"), "ts", "event_type", "5 minutes")), "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 5")

# An error counts as a rejected request, and an event's value as its latency.
REJECTED = "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS rejections, count(*) FILTER (event_type = 'error') / count(*) AS share FROM events GROUP BY 1"


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guardrails.rejection_shares(B.table(spark, sf_dir, "events"), F.col("event_type") == "error")


add("rejection_shares", shares, REJECTED)
add("rejection_alerts", lambda s, d: guardrails.rejection_alerts(shares(s, d)), f"WITH r AS ({REJECTED}), high AS (SELECT * FROM r WHERE share > 0.1) SELECT * FROM high WHERE start IN (SELECT start + INTERVAL '5 minutes' FROM high)")
add("latency_p95", lambda s, d: guardrails.latency_percentile(B.table(s, d, "events"), "value").withColumn("latency", F.round("latency", 6)), "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, round(quantile_cont(value, 0.95), 6) AS latency FROM events GROUP BY 1")


def sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile of each hour, by five-minute sketches rolled up, and whether its rank is as near as promised."""
    events = B.table(spark, sf_dir, "events")
    hours = guardrails.sketched_percentile(guardrails.rolled_up(guardrails.latency_sketches(events, "value")))
    own = events.select(F.window("ts", "1 hour")["start"].alias("start"), "value").join(hours, "start")
    ranks = own.groupBy("start", "n").agg(F.avg((F.col("value") < F.col("latency")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col("latency")).cast("int")).alias("upto"))
    error = guardrails.SKETCH_ERROR + 1 / F.col("n")  # a rank can't be nearer than one value
    return ranks.select("start", "n", ((F.col("below") <= 0.95 + error) & (F.col("upto") >= 0.95 - error)).alias("within"))


add("latency_sketches_hourly", sketched, "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(value) AS n, true AS within FROM events GROUP BY 1")
add(
    "held_alerts",
    lambda s, d: held.held_alerts(held.window_shares(B.table(s, d, "events"), "event_type", F.col("value") > 10, width="1 hour"), 0.3, 3 * 3600, 3600),
    """WITH w AS (SELECT event_type AS name, epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS s, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) AS share FROM events GROUP BY 1, 2
), r AS (SELECT name, s, s - 3600 * row_number() OVER (PARTITION BY name ORDER BY s) AS run FROM w WHERE share > 0.3
), x AS (SELECT name, min(s) AS pending_at, max(s) + 3600 AS resolved_at FROM r GROUP BY name, run)
SELECT name, pending_at, pending_at + 10800 AS fired_at, resolved_at FROM x WHERE resolved_at - pending_at >= 10800""",
)
add(
    "violation_records",
    lambda s, d: guardrails.violation_records(guardrails.check_messages(B.table(s, d, "documents")), "doc_id").select("timestamp", "violation_type", "action_taken", F.array_join("metadata.pii_types", ",").alias("pii_types")),
    "SELECT doc_id AS timestamp, v AS violation_type, CASE v WHEN 'pii' THEN 'rejected' ELSE 'flagged' END AS action_taken, pii_types FROM (SELECT *, CASE WHEN " + ANY + f" THEN 'pii' WHEN {OFF} THEN 'off_topic' END AS v, concat_ws(',', " + ", ".join(f"CASE WHEN {m} THEN '{n}' END" for n, m in MATCHES.items()) + ") AS pii_types FROM documents) WHERE v IS NOT NULL",
)
add("disclaimers", lambda s, d: B.table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", guardrails.with_disclaimer(F.col("text")).alias("answer")), "SELECT conv_id, turn, text || chr(10) || chr(10) || 'Always read the product label before use.' AS answer FROM conversations WHERE role = 'assistant'")
add("documents_to_extract", lambda s, d: B.table(s, d, "documents").where(labels.long_enough(F.col("text"))).select("doc_id"), r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')) >= 100")
add(
    "page_counts",
    lambda s, d: B.table(s, d, "part").groupBy("p_brand", "p_type").agg(F.collect_list(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") - 25)).alias("pages"), F.count(F.lit(1)).cast("int").alias("docs")).select("p_brand", "p_type", labels.page_count(F.col("pages"), F.col("docs")).alias("pages")),
    "SELECT p_brand, p_type, coalesce(max(p_size - 25) FILTER (p_partkey % 3 = 0 AND p_size > 25), count(*))::INTEGER AS pages FROM part GROUP BY 1, 2",
)
add(
    "corpus_reduction",
    lambda s, d: cleaning.corpus_reduction(B.table(s, d, "documents").select("text", F.when(F.col("doc_id") % 10 != 0, F.replace(t(), F.lit("the "), F.lit(""))).alias("cleaned"))),
    "SELECT count(*) AS files, count(*) FILTER (doc_id % 10 <> 0) AS succeeded, count(*) FILTER (doc_id % 10 = 0) AS failed, sum(length(text)) FILTER (doc_id % 10 <> 0)::BIGINT AS before, sum(length(replace(text, 'the ', ''))) FILTER (doc_id % 10 <> 0)::BIGINT AS after, round((sum(length(text)) FILTER (doc_id % 10 <> 0) - sum(length(replace(text, 'the ', ''))) FILTER (doc_id % 10 <> 0)) / sum(length(text)) FILTER (doc_id % 10 <> 0) * 100, 1) AS saved FROM documents",
)


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{violations.shared_folder(spark)}/rates-{uuid.uuid4().hex}"
    return violations.run_once(violations.hourly_rates(violations.stream_of(spark, sf_dir, "events.parquet"), None), f"{root}/rows", f"{root}/checkpoint")


add("violation_rate_stream", streamed, RATES)
LINKS = r"""(SELECT DISTINCT page_id, url, link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS link FROM pages))"""
add("links_from_pages", lambda s, d: readers.page_links(B.table(s, d, "pages")), f"SELECT page_id, link FROM {LINKS}")
add(
    "absolute_links",
    lambda s, d: readers.page_links(B.table(s, d, "pages")).join(B.table(s, d, "pages").select("page_id", "url"), "page_id").select("page_id", readers.absolute(F.col("url"), F.col("link")).alias("address")),
    rf"""SELECT page_id, CASE WHEN regexp_matches(link, '^[a-z]+://') THEN link WHEN link[1] = '/' THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || link ELSE regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || link END AS address FROM {LINKS}""",
)
add(
    "label_links",
    lambda s, d: B.table(s, d, "pages").select("page_id", "url", readers.link_by_text(F.col("html"), "TI").alias("link")).select("page_id", "link", readers.absolute(F.col("url"), F.col("link")).alias("address")),
    r"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a', 1) AS h, regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a', 2) AS t FROM pages
), b AS (SELECT page_id, url, h[list_position(list_transform(t, lambda x: contains(lower(x), 'ti')), true)] AS link FROM a)
SELECT page_id, link, CASE WHEN regexp_matches(link, '^[a-z]+://') THEN link WHEN link[1] = '/' THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || link ELSE regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || link END AS address FROM b""",
)
add(
    "result_links",
    lambda s, d: readers.result_links(B.table(s, d, "pages").select((F.col("page_id") % 40).alias("search"), F.floor(F.col("page_id") / 40 + 1).alias("number"), "html"), "search", "number", 4),
    rf"""WITH p AS (SELECT page_id % 40 AS search, page_id // 40 + 1 AS number, page_id FROM pages), f AS (SELECT search, link, min(number) AS number FROM p JOIN {LINKS} l USING (page_id) GROUP BY 1, 2
), stop AS (SELECT search, min(number) AS stop FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.search = p.search AND f.number = p.number) GROUP BY 1)
SELECT search, link, number FROM f LEFT JOIN stop USING (search) WHERE number <= 4 AND (stop IS NULL OR number < stop)""",
)
add("url_basename", on("pages", lambda: ("page_id", readers.file_name(F.col("url")).alias("name"))), r"SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '([^/]*)$', 1) AS name FROM pages")
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a search result: actives between white space of several kinds or blank, some without a number."""
    key = F.col("p_partkey")
    actives = F.when(key % 11 == 0, "\t").otherwise(F.concat(F.when(key % 2 == 0, "\t ").otherwise("\u00a0"), "p_type", F.lit("\n")))
    number = F.when(key % 7 == 3, " \t").otherwise(F.concat(F.lit(" "), key.cast("string")))
    return B.table(spark, sf_dir, "part").select(actives.alias("actives"), number.alias("number"), "p_partkey", "p_name")


add(
    "first_per_active",
    lambda s, d: readers.first_per_key(search_rows(s, d), "actives", "p_partkey", ("number",)),
    "SELECT p_type AS actives, CAST(min(p_partkey) AS VARCHAR) AS number, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 7 <> 3 GROUP BY 1",
)
add(
    "pending_files",
    lambda s, d: readers.pending(B.table(s, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("ELBL")).alias("stem")), B.table(s, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit("ELBL")).alias("stem"))),
    "SELECT doc_id || 'ELBL' AS stem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def ledger_of(rows: DataFrame, status: Column, at: int) -> DataFrame:
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("ELBL")).alias("stem"), status.alias("status"), F.lit(at).alias("at"))


add(
    "ledger_update",
    lambda s, d: readers.updated_ledger(ledger_of(B.table(s, d, "labels"), F.lit("parsed"), 1), ledger_of(B.table(s, d, "documents"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("parsed"), 2)),
    "SELECT doc_id || 'ELBL' AS stem, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'parsed' END AS status, 2 AS at FROM documents UNION ALL SELECT DISTINCT doc_id || 'ELBL', 'parsed', 1 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
)


def block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each event: one or two JSON blocks, and Markdown behind them or nothing."""
    own = F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "tables": [{"event_type": "'), "event_type", F.lit('"}, {"user_id": '), "user_id", F.lit('}], "text_items": ["'), "event_type", F.lit('", " "]}'))
    more = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(' {"tables": [{"t": "x"}], "text_items": [7, "'), "event_type", F.lit('", {"a": "b"}]}'))).otherwise("")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("\n# Notes\nfor "), "event_type", F.lit("\n\n## More\nend"))).otherwise("")
    split = readers.split_json_blocks(F.concat(own, more, text))
    return B.table(spark, sf_dir, "events").select("event_id", split.alias("s")).select("event_id", "s.blocks", "s.trailing")


add(
    "merged_blocks",
    lambda s, d: readers.merge_blocks(block_files(s, d), "event_id").select("event_id", F.col("fields")["event_id"].alias("own_id"), F.size("fields").alias("n_fields"), F.array_join("tables", ";").alias("tables"), F.array_join("text_items", "|").alias("items"), F.array_join(F.transform("raw_blocks", lambda b: F.concat_ws(":", b["block_index"], b["type"], b["num_tables"], b["has_text_items"], b["content_preview"])), ";").alias("raw")),
    """SELECT event_id, CAST(event_id AS VARCHAR) AS own_id, 1::INTEGER AS n_fields, '{"event_type":"' || event_type || '"};{"user_id":' || user_id || '}' || CASE WHEN event_id % 2 = 0 THEN ';{"t":"x"}' ELSE '' END AS tables,
  event_type || CASE WHEN event_id % 2 = 0 THEN '|' || event_type ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '|Notes' || chr(10) || 'for ' || event_type || '|More' || chr(10) || 'end' ELSE '' END AS items,
  '0:json:2:true' || CASE WHEN event_id % 2 = 0 THEN ';1:json:1:true' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ';' || CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END || ':markdown:# Notes' || chr(10) || 'for ' || event_type || chr(10) || chr(10) || '## More' || chr(10) || 'end...' ELSE '' END AS raw
FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0""",
)


def json_text() -> Column:
    return F.concat("props", F.lit(" "), F.to_json(F.struct("event_type", "event_id")), F.lit("\n# note {"), F.col("event_type"))


add(
    "json_blocks",
    lambda s, d: B.table(s, d, "events").select("event_id", readers.split_json_blocks(json_text()).alias("s")).select("event_id", F.size("s.blocks").alias("n"), F.col("s.blocks")[0].alias("first"), "s.trailing"),
    "SELECT event_id, 2::INTEGER AS n, props AS first, '# note {' || event_type AS trailing FROM events",
)
