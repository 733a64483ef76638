"""Hosts, registered domains and look-alikes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, SparkSession, functions as F

from mailsieve.constants import PUBLIC_SUFFIXES

_HOST = r"(?i)^https?://(?:[^/?#]*@)?([^/?#:]+)"
_IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def url_host(url: Column) -> Column:
    """Host of an http(s) URL in lower case, without user, port or trailing dots."""
    host = F.translate(F.lower(F.regexp_extract(url, _HOST, 1)), "。．｡", "...")
    return F.rtrim(host, F.lit("."))


def parse_suffixes(lines: Iterable[str]) -> list[str]:
    """Rules in the format of the public list: one a line, comments after ``//``."""
    rules = (line.split("//")[0].split(maxsplit=1) for line in lines)
    return [rule[0].lower().strip(".") for rule in rules if rule]


def read_suffixes(spark: SparkSession, path: str) -> list[str]:
    """The rules of a file in the public list's format, some ten thousand lines."""
    return parse_suffixes(row[0] for row in spark.read.text(path).collect())


def registered_domain(url: Column, suffixes: Iterable[str] = PUBLIC_SUFFIXES) -> Column:
    """Label before the longest known suffix, with that suffix.

    ``*`` in a rule stands for any one label, and ``!`` begins an exception,
    whose suffix is one label shorter. Without a known suffix the last label is
    given, as is a host that is a suffix itself; an IPv4 host is given whole.
    """
    host = url_host(url)
    plain: dict[int, list[str]] = {}
    wild: dict[int, list[str]] = {}
    exceptions: list[str] = []
    for rule in dict.fromkeys(suffixes):
        if rule.startswith("!"):
            exceptions.append(rule[1:])
        elif rule.startswith("*"):
            wild.setdefault(rule.count(".") + 1, []).append(rule[2:])
        else:
            plain.setdefault(rule.count(".") + 1, []).append(rule)

    def last(labels: int) -> Column:
        return F.substring_index(host, ".", -labels)

    found = F.when(host.rlike(_IPV4), host)
    for length in sorted({e.count(".") + 1 for e in exceptions}, reverse=True):
        found = found.when(last(length).isin([e for e in exceptions if e.count(".") + 1 == length]), last(length))
    for length in sorted({*plain, *wild}, reverse=True):
        whole = F.size(F.split(host, r"\.")) >= length
        known = last(length).isin(plain[length]) if length in plain else F.lit(False)
        if length in wild:
            rest = last(length - 1).isin(wild[length]) if length > 1 else F.lit(True)
            known = known | (whole & rest)
        found = found.when(known, last(length + 1))
    return found.otherwise(last(1))


def domain_lookalike(candidate: Column, legitimate: str) -> Column:
    """The candidate holds the first label of the legitimate domain and is not it."""
    return F.contains(candidate, F.lit(legitimate.split(".")[0])) & (
        candidate != F.lit(legitimate)
    )


def lookalike_count(candidates: Column, legitimate: Iterable[str]) -> Column:
    """Number of (candidate, legitimate) pairs that are look-alikes.

    The array is the URLs of one message; the pairing stays inside the row.
    """
    def imitating(domain: str) -> Column:
        return F.size(F.filter(candidates, lambda c: domain_lookalike(c, domain)))

    total = F.lit(0)
    for domain in legitimate:
        total = total + imitating(domain)
    return F.when(F.size(candidates) > 0, total).otherwise(F.lit(0))
