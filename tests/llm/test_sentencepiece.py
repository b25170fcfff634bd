import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from tillage.llm import sentencepiece as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return S.Pieces(MODEL), SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(5)
    yield from ("", " ", "  ", "a", "▁", "▁▁ x", "Hello  world\n\nfoo\tbar", "<s></s><unk><0x41>", "\x00\r\x1c", "💥🧑‍🌾", "日本語テキスト", "a" * 500, "ab" * 300, "=" * 200, "lower lowest")
    yield from (" " * n + w for n in range(1, 60, 3) for w in ("", "x", "the", "\n", "日"))
    pools = ["ab ", "the an in re on \n", " ▁\n\t.", "éàü日本 ▁x", "=-_* #", "0123456789,. ", "<0x41>/s"]
    for _ in range(1500):
        pool = rng.choice(pools)
        yield "".join(rng.choice(pool) for _ in range(rng.randrange(40)))
    for _ in range(150):
        yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x4E00, 0x9000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(60))


def test_encode_equals_library(both):
    ours, library = both
    for text in texts():
        assert ours.encode(text) == library.encode(text), repr(text)


def test_vocabulary_words_equal_library(both):
    ours, library = both
    rng = random.Random(6)
    pieces = [p for p, i in ours.ids.items()]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))).replace(S.SPACE, " ")
        assert ours.encode(text) == library.encode(text), repr(text)


def test_decode_equals_library(both):
    ours, library = both
    rng = random.Random(7)
    for text in texts():
        ids = library.encode(text)
        assert ours.decode(ids) == library.decode(ids), repr(text)
    for _ in range(1000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(12))]
        assert ours.decode(ids) == library.decode(ids), ids


def test_table(spark, both):
    _, library = both
    rows = [(1, "The quick  fox", "x"), (2, None, "x"), (2, "", "x"), (None, "▁ dup", "y"), (5, "long " * 20000, "z"), (5, "long " * 20000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(str, S.digests(docs, MODEL).collect()))
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), S.sha256(",".join(map(str, ids)).encode()), S.sha256(library.decode(ids).encode())))
    assert got == sorted(f"Row(doc_id={a}, n_tokens={b}, ids_sha256={c!r}, decoded_sha256={d!r})" for a, b, c, d in want)
    full = {(r.doc_id, tuple(r.ids), r.decoded) for r in S.encode_column(docs, MODEL).collect()}
    assert full == {(i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t, _ in rows}
    assert S.digests(docs.limit(0), MODEL).count() == 0
