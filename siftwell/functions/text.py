"""Column functions on text: tokens, accents, k-grams, names, patterns and edit distance."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters and digits; with KEPT each punctuation sign is a token too. RAW is a chunk before punctuation is split off.
STANDARD = r"[\p{L}0-9]+"
KEPT = r"[\p{L}0-9]+|[!-/:-@\[-`{-~]"
RAW = r"[\p{L}!-~]+"


# Letters from U+00C0 to U+017E that Unicode doesn't decompose, and the letters they are read as.
_STROKES = dict(zip("ÆÐØÞßæðøþĐđĦħıĲĳĸĿŀŁłŉŊŋŒœŦŧ", "EDOTSedotDdHhiIikLlLlnNnOoTt", strict=True))


@cache
def accent_map() -> tuple[str, str]:
    """The accented Latin letters from U+00C0 to U+017E and the letters they stand on."""
    pairs = [(c, _STROKES.get(c, unicodedata.normalize("NFD", c)[0])) for c in map(chr, range(0xC0, 0x17F))]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(text: Column) -> Column:
    return F.translate(text, *accent_map())


def tokens(text: Column, case_folding: bool = True, accents: bool = True, punctuation: bool = False) -> Column:
    """The tokens of a text as an array; null text has none. accents=False removes them, punctuation=True keeps it."""
    text = text if accents else without_accents(text)
    text = F.lower(text) if case_folding else text
    found = F.regexp_extract_all(text, F.lit(KEPT if punctuation else STANDARD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def read_patterns(lines: list[str]) -> list[str]:
    """Regular expressions in order: blank lines and // comments don't count, the first malformed one ends the list."""
    found = []
    for line in (x.strip() for x in lines):
        if not line or line.startswith("//"):
            continue
        try:
            re.compile(line, re.ASCII)
        except re.error:
            break
        found.append(line)
    return found


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def pattern_tokens(patterns: list[str], case_folding: bool = True, punctuation: bool = False) -> Callable[[Column], Column]:
    """A column function like tokens() that keeps non-standard words whole where a pattern finds them.

    A chunk goes to the first pattern, in order, that occurs in it: what stands before is split as standard text, the match
    is one token, and what follows is treated as a chunk of its own. Patterns are the JVM's, look-around included; one that
    refers back to its own groups by number is an error, an empty match is none. Chunks without any match are split at once.
    """
    if any(re.search(r"\\[1-9]", p) for p in patterns):
        raise ValueError("patterns can't refer back to groups by number")
    plain = lambda s: F.regexp_extract_all(s, F.lit(KEPT if punctuation else STANDARD), F.lit(0))
    some = "|".join(f"(?:{p})" for p in patterns)

    def hit(rest: Column) -> Column:
        """(before, found) of the first pattern that occurs, or null."""
        found = [F.regexp_substr(rest, F.lit(p)) for p in patterns]
        return F.coalesce(*[F.when(F.length(f) > 0, F.struct(F.regexp_extract(rest, f"(?s)^(.*?)(?={p})", 1).alias("before"), f.alias("found"))) for f, p in zip(found, patterns, strict=True)])

    def step(state: Column) -> Column:
        none = F.struct(F.concat(state["out"], plain(state["rest"])).alias("out"), F.lit("").alias("rest"))
        more = lambda h: F.when(h.isNull(), none).otherwise(
            F.struct(F.concat(state["out"], plain(h["before"]), F.array(h["found"])).alias("out"), F.substr(state["rest"], F.length(h["before"]) + F.length(h["found"]) + 1).alias("rest"))
        )
        return F.when(state["rest"] == "", state).otherwise(_let(hit(state["rest"]), more))

    def split(chunk: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), chunk.alias("rest"))
        steps = F.sequence(F.lit(0), F.length(chunk))  # each but the last takes a character
        return F.when(chunk.rlike(some), F.aggregate(steps, start, lambda state, _: step(state), lambda state: state["out"])).otherwise(plain(chunk))

    def run(text: Column) -> Column:
        text = F.lower(text) if case_folding else text
        chunks = F.regexp_extract_all(text, F.lit(RAW), F.lit(0))
        each = F.transform(chunks, split) if patterns else F.transform(chunks, plain)
        return F.coalesce(F.flatten(each), F.array().cast("array<string>"))

    return run


def kgrams(term: Column, k: int = 2) -> Column:
    """The distinct k-grams of ^term$. An empty term has none, one shorter than k - 1 is its own only k-gram."""
    framed = F.concat(F.lit("^"), term, F.lit("$"))
    n = F.length(framed) - (k - 1)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(framed, i, F.lit(k))))
    empty = F.array().cast("array<string>")
    short = F.when(F.length(term) == k - 2, F.array(term)).otherwise(empty) if k > 2 else empty
    return F.when(F.length(term) == 0, empty).when(F.length(term) < k - 1, short).otherwise(grams)


def term_kgrams(term: str, k: int = 2) -> list[str]:
    """The same for one term on the driver."""
    framed = f"^{term}$"
    if not term or len(term) < k - 1:
        return [term] if term and len(term) == k - 2 else []
    return list(dict.fromkeys(framed[i : i + k] for i in range(len(framed) - k + 1)))


def base_name(path: Column) -> Column:
    """The last piece of a path."""
    return F.try_element_at(F.filter(F.split(path, r"[\\/]"), lambda x: x != ""), F.lit(-1))


def without_first_piece(path: Column) -> Column:
    """A path without its first piece."""
    return F.regexp_replace(path, r"^[^/]*/", "")


def shortened(text: Column, width: int = 50) -> Column:
    """At most width characters, marked with dots where text was longer."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def indel_distance(a: Column, b: Column) -> Column:
    """The edit distance where a letter can be added or left out at cost 1, so that changing one costs 2."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    start = F.transform(F.sequence(F.lit(0), F.length(b)), lambda j: j.cast("int"))

    def next_row(row: Column, x: Column) -> Column:
        first = F.array(row[0] + 1)
        return F.aggregate(
            F.transform(letters(b), lambda y, j: F.struct(y.alias("y"), row[j].alias("diagonal"), row[j + 1].alias("up"))),
            first,
            lambda done, c: F.concat(done, F.array(F.when(c["y"] == x, c["diagonal"]).otherwise(F.least(c["up"], F.element_at(done, -1)) + 1))),
        )

    return F.element_at(F.aggregate(letters(a), start, next_row), -1)
