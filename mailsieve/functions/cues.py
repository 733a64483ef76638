"""The fourteen per-message cues, as one narrow pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from mailsieve import constants as K
from mailsieve.functions.domains import lookalike_count, registered_domain
from mailsieve.functions.text import any_term, count_terms, is_ascii, nfkc_lower, text_or_empty


@dataclass(frozen=True)
class Lexicons:
    """Word, domain and suffix lists; every one can be replaced."""

    government: Sequence[str] = K.GOVERNMENT_TERMS
    bank: Sequence[str] = K.BANK_TERMS
    telco_utility: Sequence[str] = K.TELCO_UTILITY_TERMS
    salutation: Sequence[str] = K.SALUTATION_TERMS
    lure: Sequence[str] = K.LURE_TERMS
    legitimate_domains: Sequence[str] = K.LEGITIMATE_DOMAINS
    suffixes: Sequence[str] = K.PUBLIC_SUFFIXES
    government_suffix: str = ".govt.nz"
    company_suffix: str = ".co.nz"

    def domains_under(self, suffix: str) -> list[str]:
        return [d for d in self.legitimate_domains if d.endswith(suffix)]


def mobile_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(K.MOBILE_PATTERN))


def landline_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(K.LANDLINE_PATTERN))


def money_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(K.MONEY_PATTERN))


def postcode_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(K.POSTCODE_PATTERN))


def extract_urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(K.URL_PATTERN), F.lit(0))


def homoglyph_count(c: Column) -> Column:
    without = F.translate(c, K.HOMOGLYPHS_BOTH_CASES, "")
    return F.when(is_ascii(c), F.lit(0)).otherwise(F.char_length(c) - F.char_length(without))


def has_punycode(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit("xn--")).cast("int")


def extract_cues(
    messages: DataFrame,
    text: str = "text",
    names: Sequence[str] = K.CUE_NAMES,
    lexicons: Lexicons = Lexicons(),
    norm: Column | None = None,
) -> DataFrame:
    """The input columns and the named cues as integers, in the order of ``names``.

    Row-local, so it takes streams as well. Normal form, URLs and candidate
    domains are columns of their own, made once a message. ``norm`` gives the
    normal form where it is there already.
    """
    unknown = [n for n in names if n not in K.CUE_NAMES]
    if unknown:
        raise ValueError(f"unknown cues: {unknown}")
    made = nfkc_lower(F.col("_raw")) if norm is None else norm
    raw, norm, candidates = F.col("_raw"), F.col("_norm"), F.col("_candidates")
    cues = {
        "impersonated_govt": any_term(norm, lexicons.government),
        "impersonated_bank": any_term(norm, lexicons.bank),
        "impersonated_telco_utility": any_term(norm, lexicons.telco_utility),
        "te_reo_salutation": any_term(norm, lexicons.salutation),
        "nz_lure_keyword_count": count_terms(norm, lexicons.lure),
        "nz_mobile_count": mobile_count(raw),
        "nz_landline_count": landline_count(raw),
        "nzd_mention_count": money_count(raw),
        "nz_postcode_count": postcode_count(raw),
        "url_count": F.size(F.col("_urls")),
        "suspicious_govt_lookalike": lookalike_count(
            candidates, lexicons.domains_under(lexicons.government_suffix)
        ),
        "suspicious_bank_lookalike": lookalike_count(
            candidates, lexicons.domains_under(lexicons.company_suffix)
        ),
        "homoglyph_chars": homoglyph_count(raw),
        "has_punycode": has_punycode(raw),
    }
    return (
        messages.select("*", text_or_empty(text).alias("_raw"))
        .select("*", made.alias("_norm"), extract_urls(raw).alias("_urls"))
        .select(
            "*",
            F.transform(
                F.col("_urls"), lambda u: registered_domain(u, lexicons.suffixes)
            ).alias("_candidates"),
        )
        .select(*messages.columns, *[cues[n].cast("int").alias(n) for n in names])
    )
