"""Exact SentencePiece (BPE) encoding with a merge-type prefix table, and decoding.

For every prefix of a chunk the table holds the one token with which the encoding of that prefix ends.  It is the
token, among those an Aho-Corasick automaton finds ending there, that may follow the last token of the prefix before
it: merging the two tokens' characters must give these two tokens back.  Reading the table backwards from the end
gives the ids.  Chunks are runs of spaces with the word behind them: no piece has a space inside, so no merge crosses
from one chunk to the next.  Characters that are no piece become bytes.

Null text: empty, no ids.  Texts are encoded whole.  Equal rows are encoded alike.  Empty tables give empty results;
other columns are passed by.  A piece model of another kind, or with its own text normalisation, is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import shared
from tillage.llm.words import sha256

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
#: Bytes of words, and half as many of pairs of tokens, that a Python worker remembers before it forgets them.
REMEMBER = 128 << 20
#: Bytes that a remembered word or pair takes besides its letters.
OVERHEAD = 200


class Pieces:
    def __init__(self, model: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        processor = SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto.FromString(processor.serialized_model_proto())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models without text normalisation, with a dummy prefix, can be read")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4, 5)}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("a piece goes over a space or a line end")
        self.ids, self.score = normal, [p.score for p in proto.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = processor.unk_id()
        self.automaton = ahocorasick.Automaton()
        for piece, i in normal.items():
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        #: Marks that are a piece, and end no other piece behind a letter.
        self.stops = {c for c in ".,;:!?" if c in normal and not any(p.endswith(c) and p[-2:-1].isalpha() for p in normal)}
        self.fits: dict[str, dict[str, bool]] = {}  # by the token before
        self.pairs = 0

    def merge(self, text: str) -> list[str]:
        """The definition: join the pair of best score, leftmost first, until none is a piece."""
        parts, ids, score = list(text), self.ids, self.score
        scores = [score[i] if (i := ids.get(a + b)) is not None else None for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, x in enumerate(scores):
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            for i in (at - 1, at):
                if 0 <= i < len(scores):
                    k = ids.get(parts[i] + parts[i + 1])
                    scores[i] = None if k is None else score[k]

    def compatible(self, before: str, token: str) -> bool:
        """Whether the encoding of both strings together is these two tokens; ``before`` may be empty."""
        found = self.fits.get(before, {}).get(token)
        if found is None:
            if self.pairs * OVERHEAD > REMEMBER // 2:
                self.fits.clear()
                self.pairs = 0
            found = self.merge(before + token) == [t for t in (before, token) if t]
            self.fits.setdefault(before, {})[token] = found
            self.pairs += 1
        return found

    def split(self, chunk: str) -> list[str]:
        """The tokens of a chunk, by the prefix table."""
        last: list[str | None] = [""] + [None] * len(chunk)
        ids, fits, filled, none = self.ids, self.fits, 0, {}
        for at, piece in self.automaton.iter(chunk):  # in order of their ends, longest first
            while filled < at:
                filled += 1
                if last[filled] is None and chunk[filled - 1] not in ids:
                    last[filled] = chunk[filled - 1]
            if last[at + 1] is None:
                before = last[at + 1 - len(piece)]
                if before is not None:
                    fit = fits.get(before, none).get(piece)
                    if self.compatible(before, piece) if fit is None else fit:
                        last[at + 1] = piece
        for at in range(filled + 1, len(chunk) + 1):  # a character that is no piece is a token of its own
            if last[at] is None and chunk[at - 1] not in ids:
                last[at] = chunk[at - 1]
        tokens, end = [], len(chunk)
        while end:
            tokens.append(last[end])
            end -= len(last[end])
        return tokens[::-1]

    def chunk_ids(self, chunk: str) -> list[int]:
        return self.ids_of(self.tokens(chunk))

    def tokens(self, chunk: str) -> list[str]:
        if SPACE * 2 in chunk:  # pieces of spaces only share one score, so their order is that of the definition
            spaces = len(chunk) - len(chunk.lstrip(SPACE))
            return self.spaces(spaces, chunk[spaces:])
        return self.split(chunk)

    def ids_of(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        for token in tokens:
            i = self.ids.get(token)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in token.encode())
            else:
                out.append(self.unknown)
        return out

    def spaces(self, count: int, word: str) -> list[str]:
        """Tokens of several spaces and a word: the last space joins the word first, as its pieces have better scores."""
        tokens = self.split(SPACE + word) if word else [SPACE]
        rest = count if tokens[0] == SPACE else count - 1
        tail = tokens[1:] if tokens[0] == SPACE else tokens
        longest = max((len(p) for p in self.ids if not p.strip(SPACE)), default=1)
        lead: list[str] = []
        if rest > 4 * longest:  # equal scores merge from the left: whole runs of the longest piece come first
            whole = (rest - 4 * longest) // longest
            lead, rest = [SPACE * longest] * whole, rest - whole * longest
        return lead + self.merge(SPACE * rest) + tail

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for i in self.chunk_ids(chunk)]

    @staticmethod
    def chunks(text: str) -> list[str]:
        return CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; ``first``: they start a text, whose added space goes."""
        out, held = [], bytearray()
        for i in [*ids, -1]:
            kind = self.kinds[i] if i >= 0 else 0
            if kind == 6:
                held.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if kind in (1, 4, 5):
                piece = self.pieces[i]
                if first and piece.startswith(SPACE):
                    piece = piece[1:]
                first = False
                out.append(piece.replace(SPACE, " "))
            elif kind == 2:
                out.append(" ⁇ ")
                first = False
        return "".join(out)


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that starts no character becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            size = next((n for n in (1, 2, 3, 4) if _is_text(data[at : at + n])), 0)
            out.append(data[at : at + size].decode() if size else "�")
            at += size or 1
        return "".join(out)


def _is_text(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


class _Known(dict):
    """Chunk: its ids in decimal, joined by commas; ``words`` has the same for words behind a single space.

    Most chunks' ids decode to the chunk; ``decoded`` has the text of those whose ids don't, and ``odd`` the words that have
    such chunks.
    """

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces = pieces
        self.words: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.odd: set[str] = set()
        self.bytes = 0

    def __missing__(self, chunk: str) -> str:
        self[chunk] = found = self.ids(chunk)
        return found

    def ids(self, chunk: str) -> str:
        tokens, known = self.pieces.tokens(chunk), self.pieces.ids
        found = [known.get(t) for t in tokens]
        if None in found:
            found = self.pieces.ids_of(tokens)
            text = self.pieces.decode(found, first=False)
            if text != chunk.replace(SPACE, " "):
                self.decoded[chunk] = text
        out = ",".join(map(str, found))
        self.bytes += len(chunk) + len(out) + OVERHEAD
        return out

    def word(self, word: str) -> str:
        chunks = CHUNK.findall(SPACE + word)
        if len(chunks) == 1:
            self.words[word] = out = self.stopped(word) or self.ids(chunks[0])
        else:  # lines end in it; such words seldom come again, their chunks do
            out = ",".join([self[c] for c in chunks])
        if self.decoded and not self.decoded.keys().isdisjoint(chunks):
            self.odd.add(word)
            self.bytes += len(word) + OVERHEAD
        return out

    def stopped(self, word: str) -> str | None:
        """The ids of a word with a stop behind it, from those of the word: the table of a prefix is the prefix of the
        table.  None if another token than the stop may end there."""
        stem, stop, pieces = word[:-1], word[-1:], self.pieces
        if stop not in pieces.stops or not stem[-1:].isalpha():
            return None
        before = self.words.get(stem) or self.word(stem)
        last = pieces.pieces[int(before[before.rfind(",") + 1 :])]
        if stem in self.odd or not pieces.compatible(last, stop):
            return None
        out = f"{before},{pieces.ids[stop]}"
        self.bytes += len(word) + len(out) + OVERHEAD
        return out

    def encode(self, text: str) -> tuple[str, str]:
        """The ids of a text, joined by commas, and the text that they decode to."""
        if self.bytes > REMEMBER:
            for kept in (self, self.words, self.decoded, self.odd):
                kept.clear()
            self.bytes = 0
        words, known = text.split(" "), self.words.get
        if "" not in words and SPACE not in text:
            found = [known(w) or self.word(w) for w in words]
            if self.odd.isdisjoint(words):
                return ",".join(found), text
        chunks = self.pieces.chunks(text)
        out = ",".join([self[c] for c in chunks])
        whole = "".join([self.decoded.get(c, c.replace(SPACE, " ")) for c in chunks])
        return out, whole[whole[:1] == " " :]


def encode_column(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array) and the text they decode to, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            ids = [pieces.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([pieces.decode(x) for x in ids])], names=["doc_id", "ids", "decoded"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """n_tokens and the hashes of ids and decoded text.  A chunk's ids and decoded text are worked out once for a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.per_process(("pieces", model), lambda: _Known(Pieces(model)))
        for batch in batches:
            counts, ids_hashes, decoded_hashes = [], [], []
            for value in pc.fill_null(batch.column(1), "").to_pylist():
                ids, decoded = known.encode(value)
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_hashes.append(sha256(ids.encode()))
                decoded_hashes.append(sha256(decoded.encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hashes, pa.string()), pa.array(decoded_hashes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(shared.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
