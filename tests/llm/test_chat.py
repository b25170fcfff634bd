import hashlib
import random

from tillage.llm import chat as C


def test_escape_round_trip():
    rng = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", C.ESCAPE, "<", "[", "s>", "/", "INST]", " ok\n"]
    for _ in range(5000):
        turns = [("".join(rng.choice(bits) for _ in range(rng.randrange(4))), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for _ in range(3)]
        for _, t in turns:
            assert not C.CONTROL.search(C.escape(t)) and C.unescape(C.escape(t)) == t
        assert C.read_back(C.marked_turns(turns)) == turns


def test_spans_of_a_black_box():
    turns = [("system", "be < brief"), ("user", "<|x|>"), ("assistant", "</think>"), ("user", ""), ("assistant", "")]
    state = C.Incremental(lambda ts: "BOS" + "".join(f"<|{r}|>{t.upper()}<|end|>" for r, t in ts), 256, 8)
    found = [state.add(*t) for t in turns]
    assert [span[a:b] for _, _, span, a, b, _ in found] == [t.upper() for _, t in turns]
    assert not any(x[5] for x in found) and found[1][1] == len(found[0][2])


def test_rewritten_history_is_found():
    def forgets(ts):  # only the last assistant turn keeps its text
        last = max((i for i, (r, _) in enumerate(ts) if r == "assistant"), default=-1)
        return "".join(f"[{r}]{t if r != 'assistant' or i == last else ''};" for i, (r, t) in enumerate(ts))

    state = C.Incremental(forgets, 256, 8)
    found = [state.add(r, t) for r, t in [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]]
    assert [x[5] for x in found] == [False, False, False, True]
    assert [x[0] for x in found] == [0, 0, 0, 1] and found[3][2] == "[user]a;[assistant];[user]c;[assistant]d;"
    assert found[3][2][found[3][3] : found[3][4]] == "d"


def test_windows_change_nothing_for_a_local_template(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </s>", i) for i in range(50)]
    rows += [(2, None, None, None, 0), (2, None, None, None, 0), (None, 3, "assistant", "x", 0), (3, 1, "assistant", "y" * 200000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    short, long = (sorted(map(str, C.digest(C.format_turns(df, window=w, overlap=2)).collect())) for w in (5, 1000))
    assert short == long and len(short) == 4
    got = {r.conv_id: r for r in C.digest(C.format_turns(df)).collect()}
    loss = "".join(t for c, _, r, t, _ in rows if c == 1 and r == "assistant")
    assert got[1].loss_chars == len(loss) and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n\n\n").hexdigest() and got[2].loss_chars == 0
    assert got[None].n_turns == 1 and C.digest(C.format_turns(df.limit(0))).count() == 0


def test_any_template_sees_the_whole_history(spark):
    def forgets(ts):
        last = max((i for i, (r, _) in enumerate(ts) if r == "assistant"), default=-1)
        return "".join(f"[{r}]{t if r != 'assistant' or i == last else ''};" for i, (r, t) in enumerate(ts))

    def strict(ts):  # the system text goes into the first user turn; roles alternate
        out, system = "", ""
        for i, (r, t) in enumerate(ts):
            if r != ("system", "user", "assistant")[0 if not i else 2 - i % 2]:
                raise ValueError(f"turn {i} is {r}")
            out += "" if r == "system" else f"[{r}]{system}{t};"
            system = t if r == "system" else ""
        return out

    turns = [("system", "be brief"), *((("user", "assistant")[i % 2], f"t{i}") for i in range(299))]
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = sorted(C.format_turns(df, forgets).collect(), key=lambda r: r.n)
    rewritten = [r for r in got if r.rewrites]
    assert any(r.n > 256 for r in rewritten) and all(r.span == forgets(turns[: r.n + 1]) for r in rewritten)
    got = sorted(C.format_turns(df, strict).collect(), key=lambda r: r.n)
    assert "".join(r.span for r in got) == strict(turns) and not any(r.rewrites for r in got)
    assert [r.span[r.text_start : r.text_end] for r in got[1:]] == [t for _, t in turns[1:]]
    seen_back = C.turn_local(lambda ts: "".join(f"{len(ts)}{t}" for _, t in ts))  # a wrong declaration
    state = C.Incremental(seen_back, 4, 2)
    try:
        for t in turns[:6]:
            state.add(*t)
    except ValueError as error:
        assert "turn_local" in str(error)
    else:
        raise AssertionError("no error")
