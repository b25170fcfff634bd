import random
import re

import numpy as np
from pyspark.sql import functions as F

from tillage.llm import quality_rules as Q

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {i + j for i, five in enumerate(fives) if fives.count(five) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def verdicts(rows):
    """base_failed and kept of each (text, host), by the formulas."""
    counts = [by_hand(t) for t, _ in rows]
    fails = [(n < 10, 100 * again > 20 * n, 10 * symbols > chars, dup > 30) for n, chars, symbols, dup, again in counts]
    hosts = {}
    for (_, host), f in zip(rows, fails):
        hosts.setdefault(host, []).append(f)
    bad = set()
    for k in range(4):
        n = [len(fs) for fs in hosts.values()]
        rates = [sum(f[k] for f in fs) / len(fs) for fs in hosts.values()]
        total, mean = sum(n), sum(w * r for w, r in zip(n, rates)) / sum(n)
        spread = sum(w * (r - mean) ** 2 for w, r in zip(n, rates))
        sampling, room = sum(1 - w / total for w in n), sum(w * (1 - w / total) for w in n)
        chance = mean * (1 - mean)
        alike = (spread - chance * sampling) / (chance * (room - sampling)) if chance > 1e-9 and room - sampling > 1e-9 else 0
        weight = min(1000.0, max(10.0, 1 / alike - 1)) if alike > 0 else 1000.0
        bad |= {h for h, fs in hosts.items() if (sum(f[k] for f in fs) + mean * weight) / (len(fs) + weight) > 0.5}
    return [(f[0] or f[1], not (f[0] or f[1]) and host not in bad) for f, (_, host) in zip(fails, rows)]


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "#", "a|b", "\u2028", "x" * 50]
    text = lambda n: rng.choice([" ", "\n", " \t\n"]).join(rng.choice(vocabulary) for _ in range(n))
    rows = [(text(rng.choice([0, 5, 9, 10, 40, 120])), rng.choice(["a", "b", None])) for _ in range(60)]
    rows += [("# * | < > " * 8 + text(12), "symbols") for _ in range(24)] + [("a b c d e f " * 9, "repeats") for _ in range(18)]
    rows += [("\n".join(["same line"] * 40 + [text(200)]), "lines") for _ in range(16)] + [(text(30), "lines")]
    rows += [(None, "a"), ("", None), (None, None), (" \n\t", "b"), (text(30_000), "long"), ("one two three four five six seven " * 4_000, "long"), ("y" * 300_000, "long")]
    return rows + [rows[3]] * 3


def test_counts_and_verdicts_equal_plain_python(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, *r, i % 3, "own") for i, r in enumerate(rows)], "doc_id long, text string, source string, n_words int, host string").repartition(4)
    got = sorted(Q.judge(docs).collect(), key=lambda r: r.doc_id)
    slow = [i for i, (t, _) in enumerate(rows) if t and len(t) > 10_000]  # fives.count() takes the square of these
    assert [tuple(r[c] for c in Q.COUNTS) for i, r in enumerate(got) if i not in slow] == [by_hand(t) for i, (t, _) in enumerate(rows) if i not in slow]
    long = {len(rows[i][0].split()): got[i] for i in slow}
    assert long[28_000].n_repeat_words == 28_000 and long[28_000].base_failed and long[1].word_chars == 300_000
    short = [r for i, r in enumerate(rows) if i not in slow]
    again = Q.judge(spark.createDataFrame([(i, *r) for i, r in enumerate(short)], "doc_id long, text string, source string"))
    assert [(r.base_failed, r.kept) for r in sorted(again.collect(), key=lambda r: r.doc_id)] == verdicts(short)
    assert any(k for _, k in verdicts(short)) and any(not b and not k for b, k in verdicts(short))


def test_filter_gives_the_callers_columns_back(spark):
    rows = [r for r in corpus() if not r[0] or len(r[0]) < 10_000]
    names = ["c0", "host", "key", "kept", "n_words", "base_failed", "of_host", "host_ok", "n_docs"]
    docs = spark.createDataFrame([(i if i % 5 else None, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    docs = docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.length("text").cast("string"), F.lit("-"))) for n in names}).repartition(3)
    out = Q.filter_documents(docs)
    assert out.columns == docs.columns
    kept = sorted(((t, h) for (t, h), (_, k) in zip(rows, verdicts(rows)) if k), key=repr)
    found = out.collect()
    assert sorted(((r.text, r.source) for r in found), key=repr) == kept and len(kept) > 10
    assert all(r[n] == f"{n}{len(r.text)}" for r in found for n in names)
    assert Q.filter_documents(docs.limit(0)).count() == 0 and Q.judge(docs.limit(0)).count() == 0


def test_one_host_with_most_rows(spark):
    good = " ".join(f"g{i}" for i in range(40))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "bad text").otherwise(good).alias("text"), F.when(F.col("id") % 3 == 0, "spam").when(F.col("id") % 3 == 1, "big").otherwise(F.concat(F.lit("h"), F.col("id") % 50)).alias("source"))
    assert Q.filter_documents(docs).groupBy("source").count().count() == 51 and Q.filter_documents(docs).count() == 2000


def test_the_prior_shrinks_small_hosts(spark):
    """Hosts of one document and of two are not judged on their own word; a large host is judged on its record."""
    good, bad = " ".join(f"g{i}" for i in range(40)), " ".join(f"#|{i}" for i in range(40))
    rows = [(bad if i % 10 == 0 else good, f"one{i}") for i in range(200)]
    assert all(k for _, k in verdicts(rows))
    docs = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    assert Q.filter_documents(docs(rows)).count() == 200  # one failure each, and nothing else known of any host
    rows += [(bad, f"two{i // 2}") for i in range(20)] + [(bad, "spam")] * 1000 + [(good, f"big{i % 9}") for i in range(9000)]
    kept = Q.filter_documents(docs(rows)).groupBy("source").count().collect()
    assert {r.source for r in kept} == {h for _, h in rows} - {"spam"} and sum(r["count"] for r in kept) == len(rows) - 1000


def test_the_weight_is_that_of_a_known_prior():
    """Failures drawn from Beta(2, 6) hosts give a weight near 8, whatever their sizes; equal hosts give the most."""
    rng = np.random.default_rng(4)
    n = rng.integers(1, 60, size=6000)
    f = rng.binomial(n, rng.beta(2, 6, size=6000))
    weight = lambda f: Q.prior_weight(n.sum(), (n * n).sum(), len(n), f.sum(), (f * f / n).sum())
    Q_least, Q.LEAST_WEIGHT = Q.LEAST_WEIGHT, 1.0
    try:
        assert 7 < weight(f) < 9
    finally:
        Q.LEAST_WEIGHT = Q_least
    assert weight(rng.binomial(n, 0.2)) > 300 and weight(n) == weight(0 * n) == 1000 and Q.prior_weight(0, 0, 0, 0, 0) == 1000
