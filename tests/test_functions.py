"""Functions against Python's own behaviour and hand-written cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tillage.functions import cleaning, guardrails, labels
from tillage.functions import text as X
from tillage.operators import chunking as C


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", make(F.col("t")).alias("r"))
    return [r.r for r in sorted(rows.collect(), key=lambda r: r.i)]


TEXTS = ["", " a ", "\x1fA b ", "É\r\nx  Y\x0b", "no", "\n\n tab\t\n"]


def test_text_functions_are_pythons(spark):
    assert column(spark, TEXTS, X.strip) == [t.strip() for t in TEXTS]
    assert column(spark, TEXTS, X.normalize) == [re.sub(r"\s+", " ", t.lower().strip()) for t in TEXTS]
    assert column(spark, TEXTS, X.tokens) == [len(t.split()) for t in TEXTS]
    assert column(spark, [None], X.strip) == [None]


NOISY = [
    "5/01/99\nkeep\nPage 1 of 18\n12\n 3 44 \n*****\n|Col1|Col2|\nThis section contains file attachment.\n",
    "a <b>bold</b><br> * x\nFilename: Spinn4.doc\nDraft pack label leaflet\n20L\n\n\n\n\n\nend",
    "(c) Copyright, Some Company 1999 rest\n® mark of it\n95 5 Gibbon Road Baulkham Hills\n12 High Street, Some Town NSW 2000\nkept 12",
    "**SAFETY DIRECTIONS**\nwash hands\nand eyes\n**CROPS**\nwheat\nFIRST AID:\nphone\n**x**\nlast\nWARRANTY:\nnothing after",
    "Phone Australia 13 11 26 now\nTelephone 131126 Australia-wide.\n**PHONE - 1800 123 456** ok",
]


def test_noise_rules_are_pythons(spark):
    def python(text):
        for pattern, new in cleaning.NOISE + cleaning.SECTION_RULES + cleaning.PHONES:
            flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
            own = sum({"m": re.M, "i": re.I, "s": re.S}.get(c, 0) for c in (flags[1] if flags else ""))
            text = re.sub((pattern[flags.end() :] if flags else pattern).replace(r"\z", r"\Z"), new, text, flags=own)
        return text

    assert column(spark, NOISY, cleaning.remove_noise) == [python(t) for t in NOISY]
    assert "wash" not in python(NOISY[3]) and "wheat" in python(NOISY[3]) and "nothing" not in python(NOISY[3])


def test_rules_in_groups_equal_rules_one_by_one(spark):
    """A rule that makes another rule's match, in the same group and in a later one; letters that fold to i and s."""
    made = ["pa<br>ge 1\nP<b>a</b>ge 2 of 3\nrest", "1<i>2</i>\n<b>12</b>L\nkept", "WARRANTY:\n<p>x</p>\n**İ** y", "FİRST AID:\nwash", "ſafety directions:\nwash", " \n 7\n x 7\n\t1 22 \n", "", "none of them"]
    rules = cleaning.NOISE_RULES + cleaning.SECTION_IF + cleaning.PHONES_IF
    plain = column(spark, made + NOISY + [None], lambda c: X.sub_all(c, [(pattern, new) for _, pattern, new in rules]))
    for together in (1, 3, 8, len(rules)):
        assert column(spark, made + NOISY + [None], lambda c, n=together: X.sub_if(c, rules, n)) == plain
    assert plain[1] == "\nkept" and plain[0] == "pa ge 1\nPage 2 of 3\nrest"


def test_boilerplate_stays_once(spark):
    keep = "**Keep out of reach of children**\n**READ SAFETY DIRECTIONS BEFORE OPENING OR USING**"
    group = "# **GROUP A HERBICIDE**"
    texts = [f"{keep}\na\n{keep.upper()}\nb", f"{group}\n{group}\nx\n{group}", "plain", "", None]
    assert column(spark, texts, cleaning.keep_first_all) == [f"{keep}\na\n\nb", f"{group}\n\nx\n", "plain", "", None]


def test_spread_keeps_large_tables(spark, monkeypatch):
    rows = spark.range(10).coalesce(1)
    assert cleaning.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(cleaning, "SPLIT", 1)
    assert cleaning.spread(rows).rdd.getNumPartitions() == 1


def test_clean_documents(spark):
    head = "# **SPRAY**\n**Herbicide**\nActive Constituent: 100 g/L X\n\n# **GROUP A HERBICIDE**"
    block = "a paragraph that is quite long, longer than fifty characters in all"
    text = f"---\nid: 1\n---\n{head}\n\n{block}\n\n\nshort\n\n{block.upper()}\n\nshort   \n\n# **group a herbicide**\n"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "i int, text string")
    got = {r.i: r.cleaned for r in cleaning.clean_documents(docs).collect()}
    assert got[1] == f"---\nid: 1\n---\n\n{head}\n\n{block}\n\nshort\n\nshort\n" and got[2] == "\n\n" and got[3] is None
    again = spark.createDataFrame([(1, got[1])], "i int, text string")
    assert cleaning.clean_documents(again).first().cleaned == got[1]


def test_keep_first_equal(spark):
    one, two = ("# **%s**\n**Herbicide**\nActive Constituent: %d g/L\n\n# **GROUP A HERBICIDE**" % x for x in (("A", 1), ("B", 2)))
    assert column(spark, [f"x{one}y{two}z{one.lower()}w"], lambda c: cleaning.keep_first_equal(c, cleaning.PRODUCT_HEADER)) == [f"x{one}y{two}zw"]


def test_states_and_rates(spark):
    assert column(spark, ["NSW and Vic only", "All States", "Tasmania", "qld/WA, western australia only"], labels.normalise_states) == [["NSW", "VIC"], labels.ALL_STATES, [], ["QLD", "WA"]]
    assert column(spark, ["1.0 - 1.5 L/ha", "2 kg / ha", "see label ", ""], labels.rate_value) == [1.5, 2.0, None, None]
    assert column(spark, ["1.0 - 1.5 L/ha", "2 kg / ha", " see label "], labels.rate_unit) == ["L/ha", "kg/ha", "see label"]


def test_usage_records(spark):
    text = "# Wipe Out\nAPVMA Approval No: 123 / 4\nActive Constituent: 5 g/L X\nGROUP B HERBICIDE\n\n## Directions for Use\n\nintro\n\n| Crop | Weeds | State | Rate | Notes |\n|---|---|---|---|---|\n| wheat | dock, thistle | NSW and VIC | 1 - 2 L/ha | early |\n| barley | oats | | | |\n| short |\nend"
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, "# directions for use\n\n| a |"), (4, text.replace("APVMA", "X"))], "i int, text string")
    got = {r.i: r for r in labels.usage_records(docs).collect()}
    assert [got[i].problem for i in (1, 2, 3, 4)] == [None, "missing-directions", "missing-table", "incomplete-metadata"]
    r = got[1].record
    assert (r.product_name, r.apvma_number, r.active_constituents, r.moa_legacy_letter) == ("Wipe Out", "123/4", ["5 g/L X"], "B")
    assert r.identified_crops == ["barley", "wheat"] and r.identified_weeds == ["dock", "oats", "thistle"]
    first, second = r.usage_scenarios
    assert (first.weed_common_name, first.states, first.rate_value, first.rate_unit, first.constraints[0].description) == ("dock", ["NSW", "VIC"], 2.0, "L/ha", "early")
    assert (second.states, second.rate_value, second.rate_unit, second.constraints) == (["All States"], 0.0, "", [])
    from tillage.operators.graph import load_labels

    records = labels.usage_records(docs.where("i = 1")).select(labels.to_label_record(F.col("record")).alias("r"), F.col("i").alias("seq"), F.lit("x").alias("stem")).select("r.*", "seq", "stem")
    g = load_labels(records)
    assert {(c.product_number, c.weed, c.crop) for c in g.controls.collect()} == {("123/4", "dock", "wheat"), ("123/4", "oats", "barley")}


def test_first_page_and_product_metadata(spark):
    page = "intro\nSUPER SPRAY\nLabel Name: Spray\nAPVMA 12345/678\nActive Constituents: 10 g/L A\nmore\nMode of Action\nGROUP 2 HERBICIDE\nPOISON"
    m = column(spark, [page], labels.first_page_metadata)[0]
    assert tuple(m) == ("Spray", "12345", "10 g/L A", "2", "POISON")
    m = column(spark, ["Product Name:\n Wipe\nAPVMA Approval No: 5 / 6\nActive Constituent: a\nb\nNet"], lambda c: labels.product_metadata(c, F.lit("77ELBL.pdf")))[0]
    assert tuple(m) == ("77", "77ELBL.pdf", "Wipe", "5 / 6", "a b", None)
    assert column(spark, ['a"b'], lambda c: labels.build_frontmatter(x=c, y=F.lit(1))) == ['---\nx: "a\\"b"\ny: 1\n---\n\n']


def test_guardrails(spark):
    texts = ["mail me@x.org", "0412 345 678 please", "123-45-6789", "no data", "which weed, doctor?", None]
    assert column(spark, texts, guardrails.has_pii) == [True, True, True, False, False, False]
    assert column(spark, texts[:3], guardrails.pii_types) == [["email"], ["phone_au"], ["ssn"]]
    assert column(spark, texts[:1], guardrails.redact) == ["mail [REDACTED]"]
    assert column(spark, texts, guardrails.topic)[3:] == ["neutral", "off_topic", "neutral"]
    assert column(spark, texts[4:5], lambda c: guardrails.topic(c, False)) == ["agriculture"]


@pytest.mark.parametrize("text,weeds", [("Wild Radish and paddock", ["dock", "wildradish"]), ("wild  oats", ["wildoats"]), ("", [])])
def test_mentions(spark, text, weeds):
    assert column(spark, [text], lambda c: C.mentions(c, C.WEEDS)) == [weeds]


def test_mentions_link_by_containment(spark):
    chunks = spark.createDataFrame([("c1", "Wild radish, dock"), ("c2", "oats"), ("c3", "nothing")], "chunk_id string, text string")
    names = spark.createDataFrame([("wild radish",), ("paddock dock",), ("wild oats",)], "name string")
    for squash, first in ((True, set()), (False, {("c1", "wild radish")})):
        got = {(r.chunk_id, r.entity) for r in C.link_mentions(chunks, names, C.WEEDS + C.CROPS, "Weed", squash).collect()}
        assert got == first | {("c1", "paddock dock"), ("c2", "wild oats")}


def test_alerts_above_five_in_five_minutes(spark, tmp_path):
    from datetime import datetime, timedelta

    import duckdb

    from tillage.plans import text_queries as T

    at = datetime(2024, 1, 1, 10, 5)
    rows = [(at + timedelta(seconds=40 * i), "six") for i in range(6)] + [(at + timedelta(seconds=40 * i), "five") for i in range(5)]
    rows += [(at + timedelta(minutes=2 + i), "split") for i in range(6)] + [(at + timedelta(minutes=8 * i), "slow") for i in range(7)]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in T.QUERIES["violation_alerts_5_minutes"](spark, str(tmp_path)).select("start", "event_type", "n").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == con.execute(T.SQL["violation_alerts_5_minutes"]).fetchall() == [(at, "six", 6)]


def test_mentions_equal_the_pattern_loop(spark):
    """Tokens of random texts made of the patterns' letters, against Python's first matches."""
    rng = random.Random(3)
    words = ["ryegrass", "wild", "oat", "s", " ", "\n", "radish", "shepherd", "'", "purse", "fat", "hen", "BARLEY", "grass", "field\u00a0", "pea", "lupin", "x", "Clov", "er", "chickpea"]
    made = ["".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(200)] + [""]
    for patterns in (C.WEEDS, C.CROPS, ["a|lupins", "[xw]ild?", "(fat)hen", "s{2}"]):
        for squash in (True, False):
            want = [sorted({m[0].replace(" ", "") if squash else m[0] for p in patterns if (m := re.search(p, t.lower())) and m[0]}) for t in made]
            assert column(spark, made, lambda c, ps=patterns, q=squash: C.mentions(c, ps, q)) == want
    assert column(spark, [None], lambda c: C.mentions(c, C.WEEDS)) in ([[]], [None])


def test_strip_takes_what_python_takes(spark):
    texts = [f"{chr(c)}a{chr(c)} b{chr(c)}{chr(c)}" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + ["", " \x1f\u3000", "a", "\U0001f600 "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.strip(F.col("t")).alias("s")).collect()
    assert {r.i: r.s for r in rows} == {i: t.strip() for i, t in enumerate(texts)}


def test_usage_records_read_a_table_once(spark):
    # Read again for each of its rows, these tables take minutes.
    import time

    head = "# Spray\nAPVMA Approval No: 1\nActive Constituent: x\n\n# DIRECTIONS FOR USE\n\n| Crop | Weeds | State | Rate | Notes |\n|---|---|---|---|---|\n"
    text = F.concat(F.lit(head), F.repeat(F.lit("| wheat | dock, burr | WA | 1 - 2 L/ha | early |\n"), 1500))
    began = time.time()
    got = labels.usage_records(spark.range(4).select(text.alias("text"))).select(F.size("record.usage_scenarios").alias("n"), F.col("record.usage_scenarios")[1499]["weed_common_name"].alias("w")).collect()
    assert [tuple(r) for r in got] == [(1500, "dock")] * 4 and time.time() - began < 60
