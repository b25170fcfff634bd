"""Guardrails over messages: personal data, topics, rails and violation rates, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of personal data, in this order, and topic words.
PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone_au": r"\b(?:\+61|0)[0-9 ]{8,}\b",
    "phone_us": r"\b(?:\+1|\()?[0-9]{3}[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "abn": r"\b\d{11}\b",
    "acn": r"\b\d{9}\b",
}
AGRICULTURE = ["herbicide", "weed", "crop", "pesticide", "fungicide", "insecticide", "yield", "rotation", "infestation", "control", "spray", "mode of action", "moa", "resistance", "application", "dosage", "rate", "timing", "weather", "soil", "plant-back"]
OFF_TOPIC = ["doctor", "medical", "legal", "financial", "investment", "political", "religious", "mortgage", "stock", "bitcoin", "health", "diagnosis", "treatment", "medication", "surgery"]
REJECTION = "Please remove personal information from your message."
DISCLAIMER = "\n\nAlways read the product label before use."


def _unicode(pattern: str) -> str:
    return f"(?U){pattern}"


def has_pii(text: Column) -> Column:
    out = F.lit(False)
    for pattern in PII.values():
        out = out | F.regexp_like(text, F.lit(_unicode(pattern)))
    return F.coalesce(out, F.lit(False))


def pii_types(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.regexp_like(text, F.lit(_unicode(p))), F.lit(name)) for name, p in PII.items())))


def redact(text: Column, replacement: str = "[REDACTED]") -> Column:
    for pattern in PII.values():
        text = F.regexp_replace(text, _unicode(pattern), replacement)
    return text


def keyword_hits(text: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))


def topic(text: Column, off_topic_first: bool = True) -> Column:
    off, farm = keyword_hits(text, OFF_TOPIC) > 0, keyword_hits(text, AGRICULTURE) > 0
    if off_topic_first:
        return F.when(off, "off_topic").when(farm, "agriculture").otherwise("neutral")
    return F.when(farm, "agriculture").when(off, "off_topic").otherwise("neutral")


def check_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    """Messages with passed, modified_message, bot_message, violation_type and metadata."""
    t = F.col(text)
    kind = F.when(has_pii(t), "pii").when(topic(t) == "off_topic", "off_topic")
    out = messages.withColumn("violation_type", kind)
    return out.withColumns({
        "passed": F.col("violation_type").isNull(), "modified_message": redact(t), "bot_message": F.when(F.col("violation_type") == "pii", F.lit(REJECTION)), "metadata": F.struct(pii_types(t).alias("pii_types"), topic(t).alias("topic")),
    })


def with_disclaimer(answer: Column) -> Column:
    return F.concat(answer, F.lit(DISCLAIMER))


def violation_rates(violations: DataFrame, ts: str = "ts", kind: str = "violation_type", window: str = "1 hour") -> DataFrame:
    """Violations in each time window and kind; works on a stream with a watermark as on a table."""
    return violations.groupBy(F.window(ts, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def violation_records(checked: DataFrame, ts: str) -> DataFrame:
    """Of checked messages (see check_messages) a record for each violation: timestamp, type, action taken, metadata."""
    action = F.when(F.col("violation_type") == "pii", "rejected").otherwise("flagged")
    return checked.where("NOT passed").select(F.col(ts).alias("timestamp"), "violation_type", action.alias("action_taken"), "metadata")


def rejection_shares(requests: DataFrame, rejected: Column, ts: str = "ts", window: str = "5 minutes") -> DataFrame:
    """start, requests, rejections and share of each time window that has requests."""
    counted = requests.groupBy(F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(rejected).alias("rejections"))
    return counted.select(F.col("w.start").alias("start"), "requests", "rejections", (F.col("rejections") / F.col("requests")).alias("share"))


def rejection_alerts(shares: DataFrame, most: float = 0.1, width: str = "5 minutes") -> DataFrame:
    """Windows above ``most`` that follow one above it, so that the share has been high for two windows' time."""
    high = shares.where(F.col("share") > most)
    before = high.select((F.col("start") + F.expr(f"INTERVAL {width}")).alias("start"))
    return high.join(before, "start", "left_semi")


def latency_percentile(requests: DataFrame, latency: str, ts: str = "ts", window: str = "5 minutes", share: float = 0.95) -> DataFrame:
    """start and the exact percentile of a latency in each time window."""
    found = requests.groupBy(F.window(ts, window).alias("w")).agg(F.percentile(latency, share).alias("latency"))
    return found.select(F.col("w.start").alias("start"), "latency")


#: Of a sketch: a percentile's rank is off by less than SKETCH_ERROR, at 99 of 100 times by about half of it.
SKETCH_K, SKETCH_ERROR = 800, 0.01


def latency_sketches(requests: DataFrame, latency: str, ts: str = "ts", window: str = "5 minutes", k: int = SKETCH_K) -> DataFrame:
    """start and a sketch of the latencies of each time window: a few kilobytes, however many there are; to be stored."""
    found = requests.groupBy(F.window(ts, window).alias("w")).agg(F.kll_sketch_agg_double(F.col(latency).cast("double"), F.lit(k)).alias("sketch"))
    return found.select(F.col("w.start").alias("start"), "sketch")


def rolled_up(sketches: DataFrame, window: str = "1 hour", k: int = SKETCH_K) -> DataFrame:
    """start and the merged sketch of longer windows, from stored ones alone."""
    found = sketches.groupBy(F.window("start", window).alias("w")).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return found.select(F.col("w.start").alias("start"), "sketch")


def sketched_percentile(sketches: DataFrame, share: float = 0.95) -> DataFrame:
    """start, n and latency: the percentile that each sketch estimates."""
    return sketches.select("start", F.kll_sketch_get_n_double("sketch").alias("n"), F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias("latency"))


def alerts(rates: DataFrame, most: int = 5) -> DataFrame:
    return rates.where(F.col("n") > most)
