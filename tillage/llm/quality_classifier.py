"""Text quality by a sparse rule ensemble.

Statistics of a text are Spark column expressions.  On a bounded sample of labelled rows, a forest of shallow trees is
grown; every path from a root to a node is a conjunctive rule over the statistics.  A logistic regression with a lasso
penalty weighs the rules, most weights become zero, and the rest is compiled into one column expression, so all
documents are scored inside Spark's generated code.

Null text: empty.  Texts are read whole.  Without labels of both kinds the score is the share of label 1 (0.5 without
labels).  Null labels are left out.  Rows that repeat a doc_id are scored each; a null doc_id is not held out.  An empty
table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import shared

#: Labelled ids that training reads at most, a row of each: those with the smallest hashes.
SAMPLE_ROWS = 20_000
TREES, DEPTH, PENALTY, SEED = 12, 3, 0.002, 17
THRESHOLD = 0.7
SOLID = r"[^\x20\x09-\x0D]+"

#: Counts from which the statistics are made.
COUNTS = {
    "chars": lambda t: F.length(t),
    "words": lambda t: F.regexp_count(t, F.lit(SOLID)),
    "symbols": lambda t: F.regexp_count(t, F.lit(r"[#*$%&|<>@^~={}\[\]\\/_+]")),
    "capitals": lambda t: F.regexp_count(t, F.lit(r"\p{Lu}")),
    "marks": lambda t: F.regexp_count(t, F.lit("[!?]")),
    "stops": lambda t: F.regexp_count(t, F.lit("[.,;:]")),
    "digits": lambda t: F.regexp_count(t, F.lit(r"\d")),
    "lines": lambda t: F.size(F.split(t, "\n", -1)),
    "unique_words": lambda t: F.size(F.array_distinct(F.split(t, r"[\x20\x09-\x0D]+", -1))),
    "unique_lines": lambda t: F.size(F.array_distinct(F.split(t, "\n", -1))),
}
#: Statistics, as expressions over the counts.
STATISTICS = {
    "log_words": "log1p(words)",
    "word_length": "chars / (words + 1)",
    "symbol_share": "symbols / (chars + 1)",
    "capital_share": "capitals / (chars + 1)",
    "mark_share": "marks / (chars + 1)",
    "stop_share": "stops / (chars + 1)",
    "digit_share": "digits / (chars + 1)",
    "unique_share": "unique_words / (words + 1)",
    "unique_lines_share": "unique_lines / lines",
    "line_words": "words / lines",
    "marks_per_word": "marks / (words + 1)",
    "symbols_per_word": "symbols / (words + 1)",
}
NAMES = list(STATISTICS)


def statistics(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    counts = docs.select(*keep, *(make(value).alias(k) for k, make in COUNTS.items()))
    kept = [c for c in counts.columns if c not in COUNTS]
    return counts.select(*kept, *(F.expr(f"double({e})").alias(k) for k, e in STATISTICS.items()))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, whether it is at most the value, value), and a weight if all hold."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = None
        for name, at_most, value in self.conditions:
            one = F.col(name) <= F.lit(value) if at_most else F.col(name) > F.lit(value)
            out = one if out is None else out & one
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The compiled ensemble, over the statistics."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.column(), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_paths(node, above: tuple = ()) -> set[tuple]:
    """The conjunctions of all nodes below (and without) the root of a fitted tree."""
    found = {above} if above else set()
    if node.getClass().getSimpleName() == "InternalNode":
        name, value = NAMES[node.split().featureIndex()], float(node.split().threshold())
        for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
            held = {(n, low): v for n, low, v in above}
            old = held.get((name, at_most))
            held[name, at_most] = value if old is None else (min if at_most else max)(old, value)
            found |= tree_paths(child, tuple(sorted((n, low, v) for (n, low), v in held.items())))
    return found


def fit(sample: DataFrame) -> RuleEnsemble:
    """``sample``: the statistics and label (0.0 or 1.0) of a bounded number of rows."""
    import math

    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n, ones = sample.agg(F.count("label"), F.sum("label")).first()
    if not n or ones in (0, n):
        share = min(max((ones or 0) / n, 1e-6), 1 - 1e-6) if n else 0.5
        return RuleEnsemble(math.log(share / (1 - share)), ())
    features = VectorAssembler(inputCols=NAMES, outputCol="features").transform(sample).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", subsamplingRate=0.8).fit(features)
    paths = sorted(set().union(*(tree_paths(t._call_java("rootNode")) for t in forest.trees)))
    rules = [Rule(p) for p in paths]
    flags = sample.select("label", *(r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    flags = shared.save(VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(flags).select("features", "label"), "rules")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(flags)
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(float(lasso.intercept), tuple(Rule(r.conditions, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Learn from labelled rows that are not held out, ``sample_rows`` of them at most."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).alias("labelled"), F.col(label).cast("double").alias("label")).distinct()
    near = shared.least_hashes(known, "labelled", sample_rows)
    chosen = near.orderBy(F.xxhash64("labelled"), "labelled", "label").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("labelled"))
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))  # an id that many rows repeat counts once
    return fit(shared.save(statistics(rows, "text", F.col("label")).coalesce(8), "sample"))


def score_documents(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    stats = statistics(docs, text, F.col(id_col).alias("doc_id"))
    scored = stats.select("doc_id", held_out("doc_id").alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, train(docs, shared.read(spark, sf_dir, "labels")))
