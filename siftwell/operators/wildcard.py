"""Wildcards by k-gram intersection, and the query k-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WILD = "*"


def pattern_kgrams(pattern: str, k: int = 2) -> list[str]:
    """The k-grams that a term matching the pattern must have; its first * is the wildcard."""
    prefix, _, suffix = pattern.partition(WILD)
    pieces = [f"^{prefix}", f"{suffix}$"]
    return list(dict.fromkeys(p[i : i + k] for p in pieces for i in range(len(p) - k + 1)))


def matches(term: Column, pattern: str) -> Column:
    """Starts with what stands before the first * and ends with what follows; the two may overlap in the term."""
    prefix, _, suffix = pattern.partition(WILD)
    return term.startswith(prefix) & term.endswith(suffix)


def kgram_intersection(kgrams: DataFrame, wanted: list[str]) -> DataFrame:
    """(term): terms that have all wanted k-grams."""
    wanted = sorted(set(wanted))
    found = kgrams.where(F.col("kgram").isin(wanted)).groupBy("term").agg(F.count_distinct("kgram").alias("n"))
    return found.where(F.col("n") == len(wanted)).select("term")


def expand(kgrams: DataFrame, pattern: str, k: int = 2) -> DataFrame:
    """(term): the vocabulary's terms that match a pattern. A pattern that names no k-gram, such as a lone *, matches none."""
    wanted = pattern_kgrams(pattern, k)
    if not wanted:
        return kgrams.select("term").where(F.lit(False))
    return kgram_intersection(kgrams, wanted).where(matches(F.col("term"), pattern))


def scan_filter(terms: list[str]) -> Column | None:
    """A condition on term that all terms of a query with wildcards meet, of the kind that files' statistics can answer; none if a wildcard
    has no beginning."""
    found = None
    for t in terms:
        prefix = t.partition(WILD)[0]
        if not prefix:
            return None
        one = F.col("term").startswith(prefix) if WILD in t else F.col("term") == t
        found = one if found is None else found | one
    return found
