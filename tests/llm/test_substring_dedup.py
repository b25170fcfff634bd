import random

import numpy as np

from tillage.llm import substring_dedup as S
from tillage.llm import words as W


def brute(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, split):
        if d is not None:
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                first[g] = min(d, first.get(g, d))
    out = []
    for (d, _), w in zip(rows, split):
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        out.append((str(d), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def corpus():
    rng = random.Random(8)
    vocabulary = ["the", "of", "a", "The"] + [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [text(n) for n in (13, 14, 20, 60)]
    out = []
    for i in range(120):
        words = text(rng.randrange(0, 30))
        for _ in range(rng.randrange(3)):
            words += rng.choice(shared) + text(rng.randrange(4))
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    return out + [None, "", out[5], out[5], "x " * 40, "x " * 30, " ".join(shared[3] * 3), "é " * 20, "é " * 20]


def check_spans(found, window):
    """Each span is a repeat of its source, as long as it can be there, and spans remove what brute force removes."""
    texts = {}
    for r in found:
        texts.setdefault(r.doc_id, []).append((r.text or "").encode().split())
    for r in found:
        words = (r.text or "").encode().split()
        gone = {i for s in r.spans for i in range(s.start, s.end)}
        assert len(gone) == r.n_removed
        for s in r.spans:
            assert s.source < r.doc_id and s.end - s.start >= window
            length = s.end - s.start
            assert any(w[s.source_start : s.source_start + length] == words[s.start : s.end] for w in texts[s.source])


def test_equals_brute_force(spark, monkeypatch):
    texts = corpus()
    ids = [(i * 37) % 101 if i != 9 else None for i in range(len(texts))]  # ids repeat
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "doc_id long, text string, n_words int, tag string, key int, source int").repartition(3)
    for subtree, remember in ((S.SUBTREE, S.REMEMBER), (2000, 10), (1, 1)):  # the small ones lengthen prefixes, the last all
        monkeypatch.setattr(S, "REMEMBER", remember)
        got = S.remove_repeats(docs, subtree=subtree)
        assert got.columns == ["doc_id", "text", "tag", "key", "source", "n_words", "n_removed", "kept", "spans"]
        found = got.collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found) == brute(rows, 13)
        assert all((r.tag, r.key, r.source) == ("x", 2, 3) for r in found)
        check_spans(found, 13)
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_string_ids_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 1 << 12)
    rng = random.Random(5)
    long = [f"w{rng.randrange(40_000)}" for _ in range(120_000)]
    rows = [("b", " ".join(long)), ("a", " ".join(long[40_000:80_000])), ("c", " ".join(long[:50] + ["new"] + long[70_000:70_030])), ("ä", "one " * 30_000), ("z", "one " * 20)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = S.remove_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == brute(rows, 13)
    check_spans(found, 13)
    spans = {r.doc_id: [(s.start, s.end, s.source, s.source_start) for s in r.spans] for r in found}
    assert spans["b"] == [(40_000, 80_000, "a", 0)] and spans["c"] == [(0, 50, "b", 0), (51, 81, "a", 30_000)]


def test_repeats_of_two_documents_are_two_spans(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words[:25])), (2, " ".join(words[10:45])), (3, " ".join(words))]
    got = {r.doc_id: [(s.start, s.end, s.source, s.source_start) for s in r.spans] for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(0, 15, 1, 10)], 3: [(0, 25, 1, 0), (13, 45, 2, 3)]}


def test_trees_hold_true_prefixes():
    rng = np.random.default_rng(3)
    runs = [rng.integers(0, 3, n) for n in (9, 20, 5, 14, 20)] + [np.zeros(17, int)]
    ids = np.concatenate(runs)
    left = np.concatenate([np.arange(len(r), 0, -1) for r in runs])
    names = S.suffix_names(ids, left, int(left.max()))
    suffix = [tuple(ids[i : i + left[i]].tolist()) for i in range(len(ids))]
    at = np.flatnonzero(left >= 3)
    order, begins = S.deep_nodes(at, names, left, 3)
    assert [suffix[i] for i in order] == sorted(suffix[i] for i in at)
    common = S.common_prefixes(names, left, order[:-1], order[1:])
    same = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    assert common.tolist() == [same(suffix[a], suffix[b]) for a, b in zip(order, order[1:])]
    groups = [{suffix[i][:3] for i in part} for part in np.split(order, begins[1:])]
    assert all(len(g) == 1 for g in groups) and len(groups) == len({suffix[i][:3] for i in at})


def test_other_lengths(spark):
    rows = list(enumerate(corpus()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.remove_repeats(docs, window=5, prefix=3).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute(rows, 5)


def test_a_huge_group_of_copies(spark):
    """A third of the rows share a text, and all a passage; small groups force long prefixes and salts."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, passage if i % 3 else f"own{i} " + passage + f" end{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for subtree in (S.SUBTREE, 500):
        got = {r.doc_id: r.n_removed for r in S.remove_repeats(docs, subtree=subtree).collect()}
        assert got == {i: 20 if i else 0 for i in range(600)}


def test_rows_without_an_id_or_with_one_id_are_spread(spark):
    from pyspark.sql import functions as F

    passage = " ".join(f"p{i}" for i in range(20))
    df = spark.range(4000).select(
        F.when(F.col("id") % 10 == 0, F.when(F.col("id") % 20 == 0, 7).otherwise(F.col("id"))).alias("doc_id"), F.concat(F.lit("own"), "id", F.lit(f" {passage} end"), "id").alias("text")
    )
    out = S.remove_repeats(df)
    rows = out.select("doc_id", "n_words", "n_removed", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 4000 and all(r.n_words == 22 for r in rows)
    assert {r.n_removed for r in rows if r.doc_id in (None, 7)} == {0} and {r.n_removed for r in rows if r.doc_id not in (None, 7)} == {20}
    for own in ([r.task for r in rows if r.doc_id == 7], [r.task for r in rows if r.doc_id is None]):
        assert max(own.count(t) for t in set(own)) < 0.5 * len(own)
