"""Base spans against plain regular expressions over characters, novelty on planted strings, odd tables."""

import base64
import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tillage.llm import secret_scan as M

SF = "/root/testdata/sf0.01"
KEY = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
PLAIN = [(re.compile(KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24)]


def brute(text):
    found = [(m.start(), k, m.end()) for k, (p, group, least) in enumerate(PLAIN) for m in p.finditer(text) if len(m[group]) >= least]
    return [(M.KINDS[k], a, b) for a, k, b in sorted(found)]


def base(text, novelty):
    return [s[:3] for s in M.spans(text.encode(), novelty) if s[0] != "novel"]


NONE = M.Novelty(b"")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "secret", "ſecret", "toKen", "api_key", "APIKEY", "AKIA", "A" * 15, "B7" * 9, "0123456789ab", "deadbeef" * 3, "G", "é", "漢", "=", ":", '"', "'", " ", "\n", "\t", "x.y", "abcde", "/+-_"]), max_size=25).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert base(text, NONE) == brute(text)


def test_query_equals_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = M.op13_secret_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in want) for kind in M.KINDS[:3]]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def planted():
    rng = random.Random(8)
    words = "maximum request handler returns account summary window default service monitor update invoice printer channel".split()
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows, want = [], {}
    for i in range(120):
        kind = i % 4
        value = {0: base64.b64encode(rng.randbytes(24)).decode().rstrip("="), 1: "_".join(rng.sample(words, 5)) + "_v2", 2: "/".join(rng.sample(words, 5)) + "2.py", 3: "ab12" * 10}[kind]
        lead = f"{prose(40)} é\n" + rng.choice(["the access key is ", "Authorization Bearer ", "private-signature: "])
        rows.append((i, f"{lead}{value}\n{prose(30)}"))
        want[i] = (len(lead), len(lead) + len(value)) if kind == 0 else None
    return rows, want


def test_incompressible_strings_in_a_sensitive_context_are_found(spark):
    rows, want = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.secrets if s.kind == "novel"] for r in M.scan(df).collect()}
    secrets = [i for i in want if want[i]]
    assert sum(want[i] in got[i] for i in secrets) == len(secrets)
    assert sum(bool(got[i]) for i in want if not want[i]) <= 2


def test_context_decides():
    value = "q7Rk2mXv9LpTz4WbN8sJd5"
    novel = lambda t: [s[1:3] for s in M.spans(t.encode(), NONE) if s[0] == "novel"]
    assert novel(f"some build id {value} here") == []
    assert novel(f"the session cookie {value} here") == [(19, 19 + len(value))]
    assert novel(f"the session cookie\n{value} here") == []  # another line
    assert novel(f"auth {'x ' * 40}{value}") == []  # too far
    twice = f"key {value}, and again key {value}"
    assert novel(twice) == [(4, 26), (twice.rindex(value), len(twice))]  # the other copy doesn't hide it
    assert [s[0] for s in M.spans(f"token={value}".encode(), NONE)] == ["assign"]  # not twice


def test_a_secret_of_many_copies_stays_new(spark):
    value = "q7Rk2mXv9LpTzaWbNxsJdc5"
    df = spark.createDataFrame([(i, f"document with access key {value} in it") for i in range(500)], "doc_id long, text string")
    assert all([s.kind for s in r.secrets] == ["novel"] for r in M.scan(df).collect())


def test_odd_tables(spark):
    long = "plain words and " * 60000 + "token = abcdef123456 " + "éé " * 5000 + "AKIA" + "Z" * 16
    df = spark.createDataFrame([(1, None, 1), (None, "secret: hunter22", 2), (2, "", 3), (3, long, 4), (3, long, 4)], "doc_id long, text string, secrets int")
    rows = M.scan(df).collect()
    assert sorted((r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.secrets]) for r in rows) == sorted([(1, []), (0, brute("secret: hunter22")), (2, []), (3, brute(long)), (3, brute(long))])
    assert M.scan(df.limit(0)).collect() == [] and M.dictionary(df.limit(0)) == b""


def test_pieces_count_every_document(spark):
    df = spark.createDataFrame([(i, f"common camelCaseName {'rare' if i == 7 else ''} common") for i in range(50)], "doc_id long, text string")
    assert {r.piece: r.n for r in M.pieces(df).collect()} == {"common": 50, "camel": 50, "Case": 50, "Name": 50, "rare": 1}


def test_the_dictionary_holds_the_most_frequent_pieces(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, weights=range(1, 401), k=30))) for i in range(300)], "doc_id long, text string")
    n = {r.piece: r.n for r in M.pieces(df).collect()}
    want = sorted(n, key=lambda p: (-n[p], p))
    for size in (1, 50, 399, 1000):
        assert M.dictionary(df, size=size).decode().split() == want[:size][::-1]
