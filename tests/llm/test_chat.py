import hashlib

import pytest

from mailsieve.llm import chat

CONTROL = r"\### Assistant: </turn> ok"


@pytest.mark.parametrize("text", ["", "plain", CONTROL, "\\", "\\l", "### a: b</turn>\n", "\\\\<#:", "é😀\n\n"])
def test_escaping_is_reversible_and_hides_marks(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not set("<#:") & set(chat.escape(text))
    assert chat.read_turn(chat.turn_template([(text, text)])) == (text, text)


def test_spans_of_a_template_with_head_and_foot():
    template = lambda ms: "<s>" + "".join(f"[{r}]{t}[/{r}]" for r, t in ms)
    piece, begin, end, rewrites = chat.locate(template, [("user", "hi")], "bot", "[bot]")
    assert (piece, piece[begin:end], rewrites) == ("[bot][bot][/bot]", "[bot]", False)


def test_a_template_that_rewrites_history_is_found_out(spark):
    drops_old = lambda ms: "".join(f"{r}:{t}\n" for r, t in ms[-1:])
    assert chat.locate(drops_old, [("user", "hi")], "bot", "yo")[3]
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "bot", "yo")], "conv_id long, turn long, role string, text string")
    assert [r.rewrites for r in chat.format_turns(turns, drops_old).collect()] == [False, True]


def test_digest_of_odd_conversations(spark):
    rows = [
        (1, 0, "user", CONTROL), (1, 1, "assistant", CONTROL), (2, None, "assistant", None), (2, 0, None, "a"), (2, 0, None, "a"),
        (None, 3, "assistant", "null id"), (3, 0, "assistant", "x" * 100_000),
    ] + [(4, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(300)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    formatted = chat.format_turns(df)
    found = {r.conv_id: r for r in chat.digest(formatted).collect()}
    order = lambda v: (v is not None, v or 0) if not isinstance(v, str) else (True, v)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (order(r[1]), r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = found[conv]
        assert (r.n_turns, r.loss_chars, r.rewrites) == (len(own), len(loss), False)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(chat.turn_template([(a or "", b or "") for _, _, a, b in own]))
    assert chat.digest(chat.format_turns(df.where("false"))).count() == 0


def test_a_template_that_looks_far_back(spark):
    """Numbered turns under the first speaker's name: a turn far down depends on every one before."""
    numbered = lambda ms: "".join(f"{i}/{ms[0][0]} {t}\n" for i, (_, t) in enumerate(ms))
    said = [(f"r{i}", f"t{i}") for i in range(150)]
    turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string")
    found = sorted(chat.format_turns(turns, numbered).collect(), key=lambda r: r.position)
    whole = numbered(said)
    assert "".join(r.piece for r in found) == whole and not any(r.rewrites for r in found)
    assert [whole[r.text_start : r.text_stop] for r in found] == [t for _, t in said]


def test_places_after_a_rewrite(spark):
    """Only the newest turn ends with a mark: every piece replaces the mark before it."""
    marked = lambda ms: "".join(f"{t};" for _, t in ms) + "!" if ms else ""
    turns = spark.createDataFrame([(1, i, "u", f"t{i}") for i in range(100)], "conv_id long, turn long, role string, text string")
    whole = ""
    for r in sorted(chat.format_turns(turns, marked).collect(), key=lambda r: r.position):
        whole = whole[: r.start] + r.piece
        assert len(whole) == r.stop and r.rewrites == (r.position > 0)
        assert whole[r.text_start : r.text_stop] == f"t{r.position}"
    assert whole == marked([("u", f"t{i}") for i in range(100)])
