import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tillage.llm import language_id as L


def test_held_out_accuracy_and_pages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taught = docs.where("doc_id % 2 = 0")
    model = L.train(taught)
    assert model[0] == ["de", "en", "es", "fr"]
    rows = docs.where("doc_id % 2 = 1 AND length(text) > 20").select("doc_id", "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("declared"), F.col("lang").alias("truth"))
    got = L.identify(rows, model).collect()
    assert sum(r.lang == r.truth for r in got) / len(got) > 0.98
    pages = L.identify(L.page_rows(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")), model, F.lit(True)).collect()
    assert sum(r.lang == r.declared for r in pages) / len(pages) > 0.95


def test_fusion_by_hand(spark):
    """Equal text: markup decides; without markup, the host's other pages do; without both, the address."""
    model = (["de", "en"], np.log(np.full((2, L.BUCKETS), 1 / L.BUCKETS)))
    rows = [(i, "http://a.example.com/", '<html lang="de">x y z</html>') for i in range(30)] + [(30, "http://a.example.com/q", "<p>x y z"), (31, "http://b.example.at", "<p>x"), (32, None, None), (33, "http://c.example.com", '<html lang="en-GB">'), (33, "http://c.example.com", '<html lang="en-GB">')]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, lang string")
    got = {r.page_id: r for r in L.identify(L.page_rows(pages), model, F.lit(True)).collect()}
    assert got[0].lang == got[30].lang == got[31].lang == "de" and got[33].lang == "en"
    # page 30 says nothing itself: it gets the shares of the others of its host, its suffix and all
    hosts = {"com": 30 * 0.9 + 0.2, "at": 0.8, None: 0.5}
    share = (sum(hosts.values()) + 1) / (34 + 2)
    s = (hosts["com"] + 50 * share) / (32 + 50)
    prior = (30 * 0.9 + 20 * s) / (30 + 20)
    assert abs(got[30].probability - prior) < 1e-5
    assert L.identify(L.page_rows(pages.limit(0)), model, F.lit(True)).count() == 0
    assert L.visible_text(b'<script>var t="</p>";</script>a<!-- b -->c<style>p</style>&amp;<b>d') .split() == [b"a", b"c", b"d"]


def test_all_languages_of_the_sample_are_in_the_model(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"x{i:03d}" for i in range(230)]
    texts = [f"{letters[i % 26]}{letters[i // 26]}q " * (30 - i // 10) for i in range(230)]
    docs = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(zip(texts, names))], "doc_id long, text string, lang string")
    model = L.train(docs)
    assert model[0] == names
    rows = docs.where("doc_id >= 226").select("doc_id", "text", *(F.lit(None).cast("string").alias(c) for c in ("host", "suffix", "declared")))
    assert {r.doc_id: r.lang for r in L.identify(rows, model).collect()} == {i: names[i] for i in range(226, 230)}


def by_hand(rows, model):
    """lang and probability of (text, declared, suffix, host, markup) by the formulas, in plain Python."""
    langs, table = model
    likely = []
    for text, declared, suffix, host, markup in rows:
        data = (text or "").encode()
        data = L.visible_text(data) if markup else data
        low = bytes(32 if c < 128 and not chr(c).isalpha() else c + 32 if 65 <= c <= 90 else c for c in data)
        buckets = [((low[i] << 16 | low[i + 1] << 8 | low[i + 2]) * 2654435761 % 2**32) >> 17 for i in range(len(low) - 2)]
        logs = [sum(np.float32(table[k][b]) for b in buckets) / max(1, len(buckets)) * min(len(buckets), L.EVIDENCE) for k in range(len(langs))]
        for name, right in ((re.match("[A-Za-z]*", declared or "")[0].lower(), L.DECLARED_RIGHT), (L.SUFFIX_LANGUAGE.get(suffix, suffix), L.SUFFIX_RIGHT)):
            if name in langs:
                logs = [x + math.log(right if y == name else (1 - right) / (len(langs) - 1)) for x, y in zip(logs, langs)]
        likely.append(logs)
    normal = lambda logs: [math.exp(x - max(logs)) / sum(math.exp(y - max(logs)) for y in logs) for x in logs]
    p, out = [normal(x) for x in likely], []
    for i, row in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i]
        fused = []
        for k in range(len(langs)):
            total = (sum(p[j][k] for j in others) + 1) / (len(others) + len(langs))
            same = [j for j in others if rows[j][2] == row[2]]
            suffix = (sum(p[j][k] for j in same) + L.SUFFIX_WEIGHT * total) / (len(same) + L.SUFFIX_WEIGHT)
            same = [j for j in same if rows[j][3] == row[3]]
            host = (sum(p[j][k] for j in same) + L.HOST_WEIGHT * suffix) / (len(same) + L.HOST_WEIGHT)
            fused.append(likely[i][k] + math.log(host))
        fused = normal(fused)
        out.append((langs[fused.index(max(fused))], round(max(fused), 5)))
    return out


def test_equals_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.train(docs, sample_rows=60)
    texts = [r.text for r in docs.select("text").orderBy("doc_id").limit(46).collect()] + [None, "", "x" * 400_000, "ab " * 100_000]
    rng = random.Random(4)
    rows = [(t, rng.choice([None, "de", "en-GB", "xx"]), rng.choice([None, "de", "at", "com"]), rng.choice([None, "a", "b"]), i % 3 == 0) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0]]
    frame = spark.createDataFrame([(i, *r, i * 2, i * 3, "own") for i, r in enumerate(rows)], "likely int, text string, declared string, suffix string, host string, is_markup boolean, prior int, p int, lang string")
    frame = frame.withColumns({"markup": F.col("p"), "n": F.col("p"), "h": F.lit("h"), "c0": F.lit("c")}).repartition(3)
    got = L.identify(frame, model, F.col("is_markup"))
    assert got.columns == [c for c in frame.columns if c not in ("text", "lang")] + ["lang", "probability"]
    found = sorted(got.collect(), key=lambda r: r.likely)
    assert [(r.lang, round(r.probability, 4)) for r in found] == [(x, round(y, 4)) for x, y in by_hand(rows, model)]
    assert all((r.prior, r.p, r.markup, r.h, r.c0) == (2 * i, 3 * i, 3 * i, "h", "c") for i, r in enumerate(found))
    assert L.identify(frame.limit(0), model).count() == 0


def test_the_sample_is_bounded_and_takes_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(i % 50, f"t{i}", "en" if i % 2 else None) for i in range(1000)], "doc_id long, text string, lang string")
    langs, table = L.train(docs, sample_rows=10)
    shares = np.exp(table[0])
    # ten texts t<number> of one to three trigrams each: no more than these have raised a bucket over the least share
    assert langs == ["en"] and 1 <= (shares > shares.min() * 1.5).sum() <= 20
