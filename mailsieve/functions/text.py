"""Text normalization, tokens and n-grams as Column expressions.

Spark has no Unicode normalization. Most text does not need one: characters
whose normal form is a single character are handled by ``translate``, inside
code generation. Only texts holding anything else are sent to Python; for all
other rows the Arrow batch carries a null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Ranges whose characters are looked at one by one for the translate tables.
_MAPPED_RANGES = (
    (0x0080, 0x036F), (0x0370, 0x052F), (0x1E00, 0x1EFF), (0x2000, 0x206F),
    (0x20A0, 0x20BF), (0x3000, 0x30FF), (0xFF01, 0xFF5E),
)
# Ranges of ideographs and pictographs, which both normal forms leave alone.
_STABLE_RANGES = ((0x4E00, 0x9FFF), (0x1F300, 0x1FAFF))

_WHITESPACE = r"[\s\x1c-\x1f]"


def _composing_seconds() -> set[str]:
    seconds = set()
    for point in range(0x10000):
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return seconds


def _fold_marks(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text)
    return "".join(ch for ch in decomposed if not unicodedata.combining(ch))


def _nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


class _Form:
    """One normal form: its translate table and the pattern of what that cannot do."""

    def __init__(self, apply: Callable[[str], str], composes: bool):
        seconds = _composing_seconds() if composes else set()
        kept: list[str] = []
        dropped: list[str] = []
        easy: list[int] = []
        for low, high in _MAPPED_RANGES:
            for point in range(low, high + 1):
                ch = chr(point)
                out = apply(ch)
                if composes and (
                    unicodedata.combining(ch) or ch in seconds or out in seconds or len(out) != 1
                ):
                    continue
                if len(out) > 1:
                    continue
                easy.append(point)
                if not out:
                    dropped.append(ch)
                elif out != ch:
                    kept.append(ch)
        self.apply = apply
        self.matching = "".join(kept + dropped)
        self.replacing = "".join(apply(ch) for ch in kept)
        self.needs_python = rf"[\x{{80}}-\x{{10FFFF}}&&[^{_ranges(easy)}]]"


def _ranges(points: list[int]) -> str:
    spans: list[list[int]] = []
    for point in points:
        if spans and spans[-1][1] == point - 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    spans += [list(span) for span in _STABLE_RANGES]
    return "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in spans)


_NFKC = _Form(_nfkc, composes=True)
_FOLD = _Form(_fold_marks, composes=False)


@F.pandas_udf(T.StringType())
def _nfkc_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(_nfkc, na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(_fold_marks, na_action="ignore")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def _normal_form(text: Column, form: _Form, udf) -> Column:
    hard = F.when(~is_ascii(text) & text.rlike(form.needs_python), text)
    native = F.when(is_ascii(text), text).otherwise(
        F.translate(text, form.matching, form.replacing)
    )
    return F.coalesce(udf(hard), native)


@F.pandas_udf(T.StructType().add("nfkc", "string").add("fold", "string"))
def _forms_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, lowered in batches:
        yield pd.DataFrame(
            {
                "nfkc": texts.map(_nfkc, na_action="ignore").astype(object),
                "fold": lowered.map(_fold_marks, na_action="ignore").astype(object),
            }
        )


def unicode_forms(c: Column | str) -> Column:
    """(nfkc, fold): ``nfkc_lower`` and ``fold_accents`` of one text, by one trip to Python at most."""
    text = text_or_empty(c)
    inputs, native = [], []
    for given, form in ((text, _NFKC), (F.lower(text), _FOLD)):
        inputs.append(F.when(~is_ascii(given) & given.rlike(form.needs_python), given))
        native.append(F.when(is_ascii(given), given).otherwise(F.translate(given, form.matching, form.replacing)))
    hard = _forms_udf(*inputs)
    return F.struct(
        F.lower(F.coalesce(hard["nfkc"], native[0])).alias("nfkc"),
        F.coalesce(hard["fold"], native[1]).alias("fold"),
    )


def normalize_text(c: Column | str) -> Column:
    """Lower case, every run of Unicode whitespace as one space, none at the ends."""
    squeezed = F.regexp_replace(F.lower(text_or_empty(c)), f"(?U){_WHITESPACE}+", " ")
    return F.trim(squeezed)


def strip_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{_WHITESPACE}+|{_WHITESPACE}+\z", "")


def nfkc_lower(c: Column | str) -> Column:
    """Compatibility-composed, then lower case; null becomes the empty text."""
    return F.lower(_normal_form(text_or_empty(c), _NFKC, _nfkc_udf))


def fold_accents(c: Column | str) -> Column:
    """Lower case, then decomposed with the combining marks taken out."""
    return _normal_form(F.lower(text_or_empty(c)), _FOLD, _fold_udf)


def tokens(folded: Column | str) -> Column:
    """Runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(_col(folded), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def words_apart(folded: Column | str) -> Column:
    """All runs of letters, digits or underscores, parted by one space; ``tokens`` are those of two or more."""
    return F.regexp_replace(_col(folded), r"[^\p{L}\p{N}_]+", " ")


def ngrams(words: Column | str, shortest: int = 1, longest: int = 2) -> Column:
    """All n-grams of the given lengths in one array, parts joined by a space."""
    words = _col(words)
    run = words
    found = [run] if shortest <= 1 else []
    for n in range(2, longest + 1):
        following = F.slice(words, n, F.greatest(F.size(words), F.lit(1)))
        # The run before is one longer than what follows, so its last pairing is null.
        run = F.array_compact(
            F.zip_with(run, following, lambda left, right: F.concat(left, F.lit(" "), right))
        )
        if n >= shortest:
            found.append(run)
    return found[0] if len(found) == 1 else F.concat(*found)


def count_terms(c: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """How many of the terms occur, each counted once, anywhere in the text."""
    if not terms:
        return F.lit(0)
    if len(terms) <= 200:
        hits = [F.contains(c, F.lit(term)).cast("int") for term in terms]
        total = hits[0]
        for hit in hits[1:]:
            total = total + hit
        return total
    listed = F.array(*[F.lit(term) for term in terms])
    return F.size(F.filter(listed, lambda term: F.contains(c, term)))


def any_term(c: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """1 if any of the terms occurs, else 0; stops at the first hit."""
    if not terms:
        return F.lit(0)
    if len(terms) > 200:
        return (count_terms(c, terms) > 0).cast("int")
    found = F.contains(c, F.lit(terms[0]))
    for term in terms[1:]:
        found = found | F.contains(c, F.lit(term))
    return found.cast("int")
