"""Language identification by Bayesian evidence fusion.

For each row and language, four kinds of evidence add up as logarithms: the likelihood of the text under byte
trigrams; the language that the markup declares; the suffix of the address (.de); and a prior for the host.  The
host's prior is smoothed hierarchically: expected counts of each language, from a first pass over text, markup and
address, are summed by host, by suffix and over all rows by grouped aggregation; a suffix's shares are shrunk towards
those of all rows, and a host's towards its suffix's.  A row's own share is taken out of all three sums before they tell
anything about it, so that its evidence counts once.

Trigram counts come from a bounded sample of labelled documents (``sample_rows`` ids with the least hashes, a row of
each); every language in it is in the model, which takes the driver BUCKETS numbers a language, and the queries an
expression a language.  Overlapping trigrams are not independent, so a text counts as ``evidence`` trigrams at most, with
the mean over its whole length.  Null or empty texts rest on the other evidence; null addresses on text and markup, with
null a host and suffix of its own.  Very long texts are taken whole.  Equal rows get equal results, ties go to the first
language in alphabetical order, and an empty table gives an empty result.  Other columns are kept, whatever their names,
but columns called lang and probability, which the results replace.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import shared
from tillage.llm import words as W

SAMPLE_ROWS = 8_000
BUCKETS = 1 << 15
EVIDENCE = 100
#: How often markup names the right language, and an address suffix that is a language's own.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
#: Rows that a suffix's and a host's parent counts for.
SUFFIX_WEIGHT, HOST_WEIGHT = 50.0, 20.0
#: Address suffixes that are not the code of the country's language.
SUFFIX_LANGUAGE = {"at": "de", "ch": "de", "mx": "es", "ar": "es", "cl": "es", "co": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "br": "pt", "jp": "ja", "cn": "zh", "kr": "ko"}

UNSEEN = re.compile(rb"<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", re.S | re.I)


def visible_text(html: bytes) -> bytes:
    return UNSEEN.sub(b" ", html)


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the three bytes that start at each byte, and the bounds of the texts."""
    data, bounds = W.values(texts)
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    low[(data < 65) & (data < 128)] = 32  # white space, digits and punctuation
    wide = np.concatenate([low, [32, 32]]).astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the trigrams that lie wholly in each text, and their number."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    n = np.maximum(np.diff(bounds) - 2, 0)
    return total[bounds[:-1] + n] - total[bounds[:-1]], n


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and the log likelihood of each trigram bucket in each."""
    known = docs.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    near = shared.least_hashes(known, "id", sample_rows)
    chosen = near.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = near.join(F.broadcast(chosen), "id", "left_semi").groupBy("id").agg(F.min(F.struct("lang", "text")).alias("row"))
    sample = rows.select("row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in W.slices(batches):
            codes, bounds = _trigrams(batch.column("text"))
            for i, name in enumerate(batch.column("lang").to_pylist()):
                one = codes[bounds[i] : max(bounds[i], bounds[i + 1] - 2)]
                counts[name] = counts.get(name, 0) + np.bincount(one, minlength=BUCKETS)
        for name, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    rows = sorted(counted.collect(), key=lambda r: r["lang"])  # the sample's languages times buckets, at most
    langs = [r["lang"] for r in rows]
    table = np.full((len(langs), BUCKETS), 0.5)
    for k, r in enumerate(rows):
        for c in r["counts"]:
            table[k, c["bucket"]] += c["n"]
    return langs, np.log(table / table.sum(1, keepdims=True)) if langs else table


def text_likelihoods(rows: DataFrame, model: tuple[list[str], np.ndarray], markup: Column, evidence: int = EVIDENCE) -> DataFrame:
    """``rows`` (with a column ``text``, and none called markup or likely) with ``likely``, a log likelihood for each
    language, in place of the text."""
    langs, table = model
    shared_table = rows.sparkSession.sparkContext.broadcast(table.astype(np.float32))  # languages times buckets
    fields = [f for f in rows.schema if f.name != "text"]
    rows = rows.withColumn("markup", markup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            texts = batch.column("text")
            if any(batch.column("markup").to_pylist()):
                plain = [visible_text(t) if m else t for t, m in zip(texts.cast(pa.large_binary()).to_pylist(), batch.column("markup").to_pylist())]
                texts = pa.array([p.decode("utf-8", "replace") for p in plain], pa.large_string())
            codes, bounds = _trigrams(texts)
            likely = np.zeros((len(texts), len(langs)))
            for k in range(len(langs)):
                total, n = _sums(shared_table.value[k][codes], bounds)
                likely[:, k] = total / np.maximum(n, 1) * np.minimum(n, evidence)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(list(likely), pa.list_(pa.float64()))], names=[*(f.name for f in fields), "likely"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "likely array<double>"]))


def _logs(langs: list[str], named: Column, right: float) -> Column:
    """Log likelihood of naming a language: ``right`` if it is the row's, the rest shared by the others."""
    wrong = (1 - right) / max(1, len(langs) - 1)
    known = F.coalesce(named.isin(langs), F.lit(False))
    return F.array(*(F.when(~known, F.lit(0.0)).when(named == x, F.lit(float(np.log(right)))).otherwise(F.lit(float(np.log(wrong)))) for x in langs))


def _plus(*logs: Column) -> Column:
    out = logs[0]
    for x in logs[1:]:
        out = F.zip_with(out, x, lambda a, b: a + b)
    return out


def _normal(logs: Column) -> Column:
    """Probabilities from logarithms."""
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], markup: Column | None = None) -> DataFrame:
    """``rows`` with lang and probability in place of the text.  They have text, declared, suffix and host; ``markup`` tells
    which texts are markup."""
    langs, _ = model
    read = ("text", "declared", "suffix", "host")
    others = {c: f"c{i}" for i, c in enumerate(rows.columns) if c not in (*read, "lang", "probability")}
    back = [(c, others.get(c, c)) for c in rows.columns if c not in ("text", "lang", "probability")]
    if not langs:
        return rows.select(*(F.col(f"`{c}`") for c, _ in back), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    own = rows.withColumn("_markup", F.lit(False) if markup is None else markup)
    own = own.select(*read, "_markup", *(F.col(f"`{c}`").alias(n) for c, n in others.items()))
    named = F.lower(F.regexp_extract(F.coalesce("declared", F.lit("")), "^[A-Za-z]+", 0))
    of_suffix = F.coalesce(F.create_map(*(F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv))[F.col("suffix")], F.col("suffix"))
    first = shared.save(text_likelihoods(own, model, F.col("_markup")), "likelihoods")
    evidence = first.withColumn("likely", _plus(F.col("likely"), _logs(langs, named, DECLARED_RIGHT), _logs(langs, of_suffix, SUFFIX_RIGHT))).withColumn("p", _normal(F.col("likely")))
    sums = lambda column: F.array(*(F.sum(F.col(column)[k]) for k in range(len(langs))))
    # Hosts are written before rows join them: Spark then knows their size, or can deal the rows of a very large one out.
    host = shared.save(evidence.groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("n"), sums("p").alias("h")), "hosts")
    suffix = host.groupBy("suffix").agg(F.sum("n").alias("suffix_n"), sums("h").alias("s"))
    total_n, total = host.agg(F.coalesce(F.sum("n"), F.lit(0)), sums("h")).first()  # one row
    total = F.array(*(F.lit(float(x or 0)) for x in total))
    of = host.join(suffix.withColumnRenamed("suffix", "other"), F.col("suffix").eqNullSafe(F.col("other"))).select(F.col("host").alias("of_host"), F.col("suffix").alias("of_suffix"), "n", "h", "suffix_n", "s")
    fused = evidence.join(of, F.col("host").eqNullSafe(F.col("of_host")) & F.col("suffix").eqNullSafe(F.col("of_suffix")), "left")

    def prior(p: Column, k: Column) -> Column:
        share = (F.get(total, k) - p + 1) / (total_n - 1 + len(langs))
        in_suffix = (F.get(F.col("s"), k) - p + SUFFIX_WEIGHT * share) / (F.col("suffix_n") - 1 + SUFFIX_WEIGHT)
        return F.log((F.get(F.col("h"), k) - p + HOST_WEIGHT * in_suffix) / (F.col("n") - 1 + HOST_WEIGHT))

    fused = fused.withColumn("fused", _normal(_plus(F.col("likely"), F.transform("p", prior))))
    best = F.array_max("fused")
    return fused.select(*(F.col(n).alias(c) for c, n in back), F.element_at(F.array(*map(F.lit, langs)), F.array_position("fused", best).cast("int")).alias("lang"), F.round(best, 6).alias("probability"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages with host, suffix and declared language."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    declared = F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1)
    return pages.select("page_id", F.nullif(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"), F.nullif(declared, F.lit("")).alias("declared"), F.col("html").alias("text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by all four kinds of evidence, and all documents by their text and their source, which stands for the host."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = train(docs)
    pages = page_rows(shared.read(spark, sf_dir, "pages")).withColumn("doc_id", F.lit(None).cast("long"))
    own = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("declared"), "text")
    return identify(pages.unionByName(own), model, F.col("page_id").isNotNull()).select("doc_id", "page_id", "host", "suffix", "declared", "lang", "probability")
