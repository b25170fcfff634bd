import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tillage.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(bins) if r >= x]
        if fits:
            bins[min(fits)[1]] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


def test_counts_pack_as_one_by_one():
    rng = random.Random(3)
    for case in range(150):
        capacity = rng.choice([1, 7, 10, 50, 100])
        lengths = [rng.randrange(1, rng.choice([capacity, max(1, capacity // 3)]) + 1) for _ in range(rng.randrange(80))]
        counts = Counter(lengths)
        runs = P.best_fit(counts, capacity)
        used = defaultdict(list)
        for length, n in counts.items():
            b, o = runs.place(np.full(n, length), np.arange(n))
            for x, y in zip(b, o):
                used[int(x)].append((int(y), length))
        for spans in used.values():
            at = 0
            for o, n in sorted(spans):
                assert o == at
                at += n
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in s) for s in used.values()) == one_by_one(lengths, capacity)


def test_documents(spark):
    texts = ["Hello, World! it's <|endoftext|> 123", None, "", "ÉTÉ é ﬁ   x\x1cy   z", "the " * 9001, "a b c", "a b c", "İstanbul ΣΑΣ ẞ", "x" * 30000, "́ a ́"]
    rows = [(i if i != 5 else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string").repartition(3)
    got = P.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            piece = ids[k : k + 4096]
            want[i, k // 4096, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) == len(one_by_one([r.length for r in got], 4096))
    assert P.pack_documents(docs.limit(0)).count() == 0


def test_words_alone_give_the_ids_of_the_text(spark):
    rng = random.Random(9)
    tokenizer = Tokenizer.from_file(PATH)
    alphabet = "aB'sédllvem 1½٣\t\n\r\x0b\x0c\x1c\x85 　.,!?<|>endoftextΣỊ̇́가각ᄀ"
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "it's", "'LL", "ŀŉſßĲ", "²¼½", "­", "don't", "×÷", "İI"]
    for _ in range(3000):
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(4))) + "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        ids = P._Ids(PATH) if _ == 0 else ids
        found = text.encode().split()
        ids.learn([found])
        assert b"".join(ids[w] for w in found) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def calls(work):
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        work()
    finally:
        sys.setprofile(None)
    return n


def test_forms_of_a_word_cost_no_steps_of_their_own():
    rng = random.Random(4)
    stems = ["".join(rng.choices("aeinorsté", k=8)) for _ in range(500)]
    words = [f(s) for s in stems for f in (str, str.title, str.upper, "{},".format, "({})".format, "{}&&&".format, "{}'s".format, "{}-1".format)]
    ids = P._Ids(PATH)
    ids.learn([[b"first", b"imports"]])
    assert calls(lambda: ids.learn([[w.encode() for w in words]])) < 8 * len(words)  # 17 when each word was cut on its own
    ids = P._Ids(PATH)
    assert calls(lambda: ids.of_texts(pa.array([" ".join(words)], pa.large_string()))) < len(words)


def test_texts_as_the_tokenizer_encodes_them(monkeypatch):
    monkeypatch.setattr(P, "REMEMBER", 20_000)  # parts are forgotten and learnt again
    rng = random.Random(6)
    tokenizer, ids = Tokenizer.from_file(PATH), P._Ids(PATH)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "\0", "\0a", "a\0b", "it's", "'LL've", "J̌", "H̱", "ΑΣ", "가", "\x1c", "\xa0", "ŉſĲİ", "½²ªµ", "&&&", "x" * 5000, "1" * 99, "'" * 99, " \x0b\t\x0c\r\n"]
    alphabet = "aBsTdé1½.,'&<|> \t"
    texts = ["", " ", *map(chr, range(0x250)), *(f"A{chr(c)}'s{chr(c)}1" for c in range(0x250))]
    texts += ["".join(rng.choice(bits) if rng.random() < 0.1 else rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)]
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        flat, bounds = ids.of_texts(pa.array(["not here", *some], pa.large_string()).slice(1))
        for text, i, j in zip(some, bounds, bounds[1:]):
            assert flat[i:j].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    flat, bounds = ids.of_texts(pa.array([], pa.large_string()))
    assert len(flat) == 0 and bounds.tolist() == [0]
