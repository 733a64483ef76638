"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to one string. It is
rendered for the turns so far and for the turns so far with one more; the place
where both outputs part is where the new turn begins. Two more renderings with
probes in place of the new text show how long the template's own head and foot
are, which gives the span of the text itself. A template that changes what it
has already written, so that the shorter output is no prefix, is found out.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

Template = Callable[[list[tuple[str, str]]], str]

_ESCAPES = {"\\": "\\\\", "<": "\\l", "#": "\\h", ":": "\\c"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
_PROBES = ("\ue000", "\ue001")


def escape(text: str) -> str:
    """No ``<``, ``#`` or ``:`` remains, so no mark of the template can occur inside a text."""
    return re.sub(r"[\\<#:]", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def turn_template(messages: list[tuple[str, str]]) -> str:
    """``### role: text</turn>`` for every turn, texts and roles escaped."""
    return "".join(f"### {escape(r)}: {escape(t)}</turn>\n" for r, t in messages)


_TURN = re.compile(r"### ([^:]*): ([^<]*)</turn>\n")


def read_turn(piece: str) -> tuple[str, str]:
    found = _TURN.fullmatch(piece)
    if not found:
        raise ValueError("not a turn of this template")
    return unescape(found[1]), unescape(found[2])


def _common(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    return len(os.path.commonprefix([a, b]))


#: How many turns before a turn its piece depends on; none, and one more shows rewriting.
turn_template.history = 1


def locate(template: Template, before: list[tuple[str, str]], role: str, text: str) -> tuple[str, int, int, bool]:
    """(piece, text begin, text end, rewrites): what one more turn adds to the output.

    Begin and end are places in the piece. ``rewrites`` says that the output of
    the turns before is not a prefix of the new output; the piece then begins
    where both part.
    """
    piece, begin, end, dropped = _locate(template, before, role, text)
    return piece, begin, end, dropped > 0


def _locate(template: Template, before: list[tuple[str, str]], role: str, text: str) -> tuple[str, int, int, int]:
    """As ``locate``, with how many characters of the earlier output the new piece replaces."""
    old, new = template(before), template([*before, (role, text)])
    start = _common(old, new)
    one, two = (template([*before, (role, p)]) for p in _PROBES)
    head = _common(one, two)
    foot = _common(one[head:][::-1], two[head:][::-1])
    begin = max(head - start, 0)
    return new[start:], begin, max(len(new) - foot - start, begin), len(old) - start


def format_turns(
    turns: DataFrame, template: Template = turn_template, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", history: int | None = None,
) -> DataFrame:
    """A row a turn: (conv_id, position, role, piece, start, stop, text_start, text_stop, rewrites).

    The pieces of a conversation in order are its formatted text, each from its
    ``start`` on in place of what was there (only a rewriting template has
    anything there); start to text_stop are code points in it. Rows of a
    conversation go by turn, ties by role and text, nulls first; null role and
    null text are the empty text, a null conv_id is a conversation of its own.
    Conversations stream through their task in sorted order, a turn at a time.

    A turn is rendered with all turns before it, which is right for every
    template and takes time by the square of a conversation's length. A
    template whose pieces depend on no more than some turns before says so, by
    ``history`` here or as its attribute; then only these are rendered, and
    memory stays bounded for any length. The result is ordered within each
    partition.
    """
    if history is None:
        history = getattr(template, "history", None)
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([rows.schema["conv_id"]])
    for name, kind in (("position", "long"), ("role", "string"), ("piece", "string"), ("start", "long"), ("stop", "long"), ("text_start", "long"), ("text_stop", "long"), ("rewrites", "boolean")):
        schema = schema.add(name, kind)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, before, position, at = object(), [], 0, 0
        for frame in frames:
            out = []
            ids = frame["conv_id"].astype(object).where(frame["conv_id"].notna(), None)
            for c, r, t in zip(ids, frame["role"], frame["text"], strict=True):
                if c != current:
                    current, before, position, at = c, [], 0, 0
                piece, begin, end, dropped = _locate(template, before, r, t)
                start = at - dropped
                out.append((c, position, r, piece, start, start + len(piece), start + begin, start + end, dropped > 0))
                before.append((r, t))
                if history is not None and len(before) > history:
                    del before[: len(before) - history]
                position, at = position + 1, start + len(piece)
            yield pd.DataFrame(out, columns=schema.names).astype({"conv_id": "Int64"} if pd.api.types.is_numeric_dtype(frame["conv_id"]) else {})

    return ordered.mapInPandas(run, schema)


def digest(formatted: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row a conversation, read back from the formatted text alone.

    Takes ``format_turns`` of ``turn_template`` as it comes, sorted within each
    partition. The loss mask is the text span of the roles to learn.
    """
    schema = T.StructType([formatted.schema["conv_id"]])
    for name, kind in (("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long"), ("rewrites", "boolean")):
        schema = schema.add(name, kind)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None

        def close():
            c, n, turns, chars, loss, size, rewrites = state
            return (c, n, turns.hexdigest(), chars, loss.hexdigest(), size, rewrites)

        for frame in frames:
            out = []
            ids = frame["conv_id"].astype(object).where(frame["conv_id"].notna(), None)
            rest = (frame[k] for k in ("piece", "start", "text_start", "text_stop", "rewrites"))
            for c, piece, start, begin, end, rewrites in zip(ids, *rest, strict=True):
                if state is None or c != state[0]:
                    if state is not None:
                        out.append(close())
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                role, text = read_turn(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if role in learn:
                    masked = unescape(piece[begin - start : end - start])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(piece)
                state[6] = state[6] or bool(rewrites)
            yield pd.DataFrame(out, columns=schema.names)
        if state is not None:
            yield pd.DataFrame([close()], columns=schema.names)

    return formatted.mapInPandas(run, schema)
