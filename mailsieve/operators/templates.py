"""Labelled rows from templates with named slots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F

from mailsieve.constants import CANONICAL
from mailsieve.functions.hashing import seeded_choice

Values = Sequence[str] | Column


@dataclass(frozen=True)
class Cell:
    """Templates of one channel and label, and slot values that apply to it alone."""

    channel: str
    label: int
    templates: Sequence[str]
    slots: Mapping[str, Values]


def fill_slots(template: str, values: Mapping[str, Column]) -> Column:
    """The template with every ``{slot}`` replaced by its value; braces within values stay.

    ``{{`` and ``}}`` stand for braces. An unknown slot is an error.
    """
    parts = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if slot is not None:
            if slot not in values:
                raise KeyError(f"template has an unknown slot: {slot!r}")
            parts.append(values[slot])
    return F.concat(*parts) if parts else F.lit("")


def _pick(values: Sequence[str | Column] | Column, seed: int, row: Column, slot: str) -> Column:
    if isinstance(values, Column):
        return values
    listed = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return seeded_choice(F.array(*listed), seed, row, F.lit(slot))


def expand_templates(
    rows: DataFrame,
    cells: Sequence[Cell],
    slots: Mapping[str, Values],
    seed: int = 42,
    index: str = "i",
    source: str = "nz_synth",
    amount_slots: Sequence[str] = ("amt",),
    lang: str = "en",
) -> DataFrame:
    """One canonical row for every input row and cell.

    A slot takes one of the listed values by hash, or the given column. Leading
    dollar signs are taken off amounts. ``rows`` may be ``spark.range(n)`` or
    any table; the cells are fanned out in the row, so nothing is joined.
    """
    cell = F.explode(F.array(*[F.lit(c) for c in range(len(cells))])).alias("_cell")
    fanned = rows.select("*", cell)
    text = label = channel = None
    for number, one in enumerate(cells):
        key = F.concat_ws("_", F.lit(one.channel), F.lit(one.label), F.col(index))
        values = {}
        for slot, options in {**slots, **one.slots}.items():
            value = _pick(options, seed, key, slot)
            values[slot] = F.ltrim(value, F.lit("$")) if slot in amount_slots else value
        filled = _pick([fill_slots(t, values) for t in one.templates], seed, key, "template")
        here = F.col("_cell") == number
        text = F.when(here, filled) if text is None else text.when(here, filled)
        label = F.when(here, one.label) if label is None else label.when(here, one.label)
        channel = F.when(here, one.channel) if channel is None else channel.when(here, one.channel)
    row_id = F.concat_ws("_", F.lit(source), channel, label, F.col(index))
    columns = {
        "id": row_id, "text": text, "channel": channel, "label": label,
        "source": F.lit(source), "lang": F.lit(lang),
    }
    return fanned.select(*[columns[c].alias(c) for c in CANONICAL])
