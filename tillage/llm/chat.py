"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string.  It is rendered for successive prefixes of the
turns.  If an output starts with the output before it, what it adds is the new turn's span.  If it doesn't, the template
rewrites history: the output before it is closed as a sample of its own, and the new output starts the next sample,
whose loss covers the new turn only; each such turn is marked.  Where the text stands inside a turn's span is found by
rendering the turn again with a probe character in place of its text.

Turns are dealt by conversation, sorted, and streamed.  A template is rendered over the whole conversation so far, which
takes memory in proportion to a conversation and time with its square; nothing less is exact for a function that may
look at, or rewrite, any turn.  Only a template that is declared ``turn_local`` has old turns dropped: conversations of
more than ``window`` turns go on in a new window behind the last ``overlap`` turns, so that even a conversation with most
of a table's rows takes bounded memory and time in proportion.  If the outputs on both sides of a new window don't
agree on the overlap, the declaration is wrong, which is an error.

Rows are ordered by turn (null first), then role and text.  Null text and null role: empty.  Equal rows are turns of
their own.  A null conv_id is a conversation of its own.  Empty tables give empty results; other columns are passed by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import shared

Template = Callable[[list[tuple[str, str]]], str]
PROBE = ""
WINDOW, OVERLAP = 256, 8

#: Strings with which the template below marks turns; in texts, ESCAPE goes behind their first character.
CONTROL = re.compile(r"</?s>|\[/?INST\]|<</?SYS>>")
ESCAPE = "␛"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return re.sub(f"{ESCAPE}({ESCAPE}?)", r"\1", text)


def turn_local(render: Template) -> Template:
    """Declare that what a template adds for a turn depends on that turn's role and text only, and that it never rewrites
    history, and that it renders any run of turns, even none; what it puts before the first turn is always the same."""
    render.turn_local = True
    return render


@turn_local
def marked_turns(turns: list[tuple[str, str]]) -> str:
    """``<s>role[INST]text</s>`` for each turn, with control strings in roles and texts escaped."""
    return "".join(f"<s>{escape(role)}[INST]{escape(text)}</s>" for role, text in turns)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of an output of marked_turns()."""
    out = []
    for turn in formatted.split("</s>")[:-1]:
        role, _, text = turn.removeprefix("<s>").partition("[INST]")
        out.append((unescape(role), unescape(text)))
    return out


class Incremental:
    """Renders one conversation's turns as they come."""

    def __init__(self, render: Template, window: int, overlap: int) -> None:
        self.render, self.window, self.overlap = render, window, overlap
        self.turns: list[tuple[str, str]] = []
        self.local = getattr(render, "turn_local", False)
        self.before = ""
        self.total = self.sample = 0

    def add(self, role: str, text: str) -> tuple[int, int, str, int, int, bool]:
        """The sample's number, where the span starts in it, the span, where its text starts and ends in the span, and
        whether history was rewritten."""
        if self.local and len(self.turns) >= self.window:
            self.turns = self.turns[len(self.turns) - self.overlap :]
            again, head = self.render(self.turns), self.render([])
            if not again.startswith(head) or not self.before.endswith(again[len(head) :]):
                raise ValueError("the template is declared turn_local, but what it adds for a turn depends on others")
            self.before = again
        self.turns.append((role, text))
        output = self.render(self.turns)
        rewrites = not output.startswith(self.before)
        if rewrites:
            self.sample, self.total, span = self.sample + 1, 0, output
        else:
            span = output[len(self.before) :]
        probe = next(p for i in range(0x1900) if (p := chr(ord(PROBE) + i)) not in output)
        probed = self.render([*self.turns[:-1], (role, probe)])
        at = probed.find(probe)
        first = at - (len(output) - len(span))
        last = len(span) - (len(probed) - at - 1)
        if at < 0 or first < 0 or last < first:  # the template leaves this text out
            first = last = 0
        start, self.total, self.before = self.total, self.total + len(span), output
        return self.sample, start, span, first, last, rewrites


SPANS = "n long, sample int, start long, span string, text_start int, text_end int, rewrites boolean"


def format_turns(turns: DataFrame, render: Template = marked_turns, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """A row for each turn, in the order and partitioning of the conversations: conv_id, role, its number n, the sample
    and the place of its span, the span, the text's place in it, and whether the template rewrote history there."""
    narrow = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present: object = run
        state, n = Incremental(render, window, overlap), 0
        for batch in batches:
            rows = []
            for conv_id, r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if conv_id != present:
                    present, state, n = conv_id, Incremental(render, window, overlap), 0
                rows.append((n, *state.add(r, t)))
                n += 1
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
            names = [f.split()[0] for f in SPANS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["conv_id", "role", *names])

    return dealt.mapInArrow(run, f"conv_id {narrow.schema['conv_id'].dataType.simpleString()}, role string, {SPANS}")


def digest(spans: DataFrame) -> DataFrame:
    """One row for each conversation, read back from spans of marked_turns() as they stream by."""
    kind = spans.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present: object = run
        held = None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            closed = [(c, n, a.hexdigest(), loss, b.hexdigest(), total) for c, n, a, loss, b, total in done]
            done.clear()
            cols = list(zip(*closed)) if closed else [[]] * 6
            kinds = (batch_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        batch_type = None
        for batch in batches:
            batch_type = batch.schema.field("conv_id").type
            for conv_id, span, first, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "span", "text_start", "text_end"))):
                if conv_id != present or held is None:
                    if held:
                        done.append(tuple(held))
                    present, held = conv_id, [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(span):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        loss = unescape(span[first:last])
                        held[3] += len(loss)
                        held[4].update(loss.encode())
                held[5] += len(span)
            if done:
                yield flush()
        if held:
            done.append(tuple(held))
            yield flush()

    return spans.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one with control strings as its texts."""
    table = shared.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    return digest(format_turns(table.unionByName(planted)))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(replace(role, chr(9243), chr(9243) || chr(9243)), '(<|\\[)(/?s>|/?INST\\]|</?SYS>>)', '\\1' || chr(9243) || '\\2', 'g') AS erole,
    regexp_replace(replace(text, chr(9243), chr(9243) || chr(9243)), '(<|\\[)(/?s>|/?INST\\]|</?SYS>>)', '\\1' || chr(9243) || '\\2', 'g') AS etext FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(erole) + length(etext) + 13)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
