"""Text that looks the same but is spelt with other characters.

Characters are first mapped to the form they look like (width, joined letters, blanks, letters of another script); then
values are grouped under the accent-sensitive, case-sensitive Unicode collation, under which composed and decomposed
accents are equal and signs without extent don't count. One member of each class is its canonical form.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.skew import checked_broadcast_join
from siftwell.session import cut_lineage

#: Texts to be changed that are broadcast at most.
CHANGES = 100_000

# Letters of other scripts and the Latin letters they can't be told from.
_CYRILLIC = "АВЕКМНОРСТУХЅІЈҺԚԜӀаеорсухѕіјһԁԛԝ"
_CYRILLIC_LATIN = "ABEKMHOPCTYXSIJHQWIaeopcyxsijhdqw"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ"
_GREEK_LATIN = "ABEZHIKMNOPTYXocj"
_ARMENIAN = "ՕօՍս"
_ARMENIAN_LATIN = "OoUu"
_CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦ"
_CHEROKEE_LATIN = "DRTAJEWMHGZVSLCPK"
# Signs without any extent: controls but blanks and line ends, soft hyphen, joiners, zero-width blanks, marks of
# direction, selectors of variants, invisible operators and vowels, annotation and layout controls, tags.
_NO_EXTENT = [
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0001, 0xE0001), (0xE0020, 0xE007F), (0xE0100, 0xE01EF),
]
ZERO_WIDTH = "".join(chr(cp) for a, b in _NO_EXTENT for cp in range(a, b + 1))
# Signs with an extent that the root collation passes over all the same.
_PASSED_OVER = [
    (0x488, 0x489), (0x591, 0x5AF), (0x5BD, 0x5BD), (0x5C4, 0x5C5), (0x600, 0x605), (0x610, 0x61A), (0x640, 0x640), (0x6D6, 0x6DD), (0x6DF, 0x6E4), (0x6E7, 0x6E8), (0x6EA, 0x6ED),
    (0x70F, 0x70F), (0x740, 0x740), (0x743, 0x744), (0x747, 0x74A), (0x7FA, 0x7FA), (0x890, 0x891), (0x898, 0x89D), (0x8CA, 0x8E2), (0x8EA, 0x8EF), (0x8F3, 0x8F3), (0x951, 0x952),
    (0xF18, 0xF19), (0xF35, 0xF35), (0xF37, 0xF37), (0xF3E, 0xF3F), (0xF86, 0xF87), (0xFC6, 0xFC6), (0x17D3, 0x17D3), (0x180A, 0x180A), (0x1A7F, 0x1A7F), (0x1B6B, 0x1B73),
    (0x1CD0, 0x1CE8), (0x1CF4, 0x1CF4), (0x1CF7, 0x1CF9), (0x2D7F, 0x2D7F), (0xA670, 0xA672), (0xA8E0, 0xA8F1), (0xFE21, 0xFE21), (0xFE23, 0xFE26), (0xFE28, 0xFE28), (0xFE2A, 0xFE2D),
    (0xFE2F, 0xFE2F), (0xFE73, 0xFE73), (0x110BD, 0x110BD),
]
# Hyphens that differ in breaking only.
_HYPHENS = "\u2010\u2011"
# Ranges of joined letters, and of Roman numerals written as letters.
_JOINED = [(0xFB00, 0xFB06), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F)]


@cache
def one_to_one() -> dict[str, str]:
    """Character to the single character it looks like."""
    table = {}
    for cp in [0x3000, *range(0xFF00, 0xFFF0)]:  # other width
        kind, _, to = unicodedata.decomposition(chr(cp)).partition(" ")
        if kind in ("<wide>", "<narrow>") and " " not in to:
            table[chr(cp)] = chr(int(to, 16))
    table |= {chr(cp): " " for cp in range(0x80, 0x3001) if unicodedata.category(chr(cp)) == "Zs"} | {"\t": " "}
    letters = dict(zip(_CYRILLIC + _GREEK + _ARMENIAN + _CHEROKEE, _CYRILLIC_LATIN + _GREEK_LATIN + _ARMENIAN_LATIN + _CHEROKEE_LATIN, strict=True))
    table |= {a: b for a, b in letters.items() if a != b} | dict.fromkeys(_HYPHENS, "-")
    for cp in range(0x370, 0x530):  # letters with accents follow their base
        base, *marks = unicodedata.normalize("NFD", chr(cp))
        if marks and base in table and len(whole := unicodedata.normalize("NFC", table[base] + "".join(marks))) == 1:
            table[chr(cp)] = whole
    return table | {c: to for c, to in _parts().items() if len(to) == 1}


@cache
def _parts() -> dict[str, str]:
    """Joined letters and numerals to their letters, in composed form."""
    held = (chr(cp) for a, b in _JOINED for cp in range(a, b + 1))
    return {c: unicodedata.normalize("NFKC", c).replace("ſ", "s") for c in held if unicodedata.decomposition(c).startswith("<compat>")}


@cache
def joined() -> dict[str, str]:
    """Joined letters to the letters they consist of."""
    return {c: to for c, to in _parts().items() if len(to) > 1}


@cache
def python_table() -> dict[int, str]:
    """For str.translate: both maps, and None for signs without extent."""
    return {ord(a): b for a, b in (one_to_one() | joined()).items()} | {ord(c): None for c in ZERO_WIDTH}


@cache
def _special() -> frozenset:
    return frozenset(map(chr, python_table()))


_CONTROLS = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


def skeleton(text: str) -> str:
    """The form of one text that all texts looking like it share; the same classes as in SQL."""
    if text.isascii():
        return _CONTROLS.sub("", text.replace("\t", " "))
    if not _special().isdisjoint(text):
        text = text.translate(python_table())
    return unicodedata.normalize("NFC", text)


@cache
def _fold_table() -> dict[int, str | None]:
    pairs = one_to_one() | joined()
    fold = {c.lower(): to.lower() for c, to in pairs.items() if c.isupper() and len(c.lower()) == 1}
    return {ord(c): to for c, to in (fold | {c: to.lower() for c, to in pairs.items()}).items()} | {ord(c): None for c in ZERO_WIDTH}


@cache
def _folded() -> frozenset:
    return frozenset(map(chr, _fold_table()))


def fold(text: str) -> str:
    """skeleton without case. A letter whose capital looks like a capital of another script folds to that one's small form."""
    if text.isascii():
        return _CONTROLS.sub("", text.lower())
    if not _folded().isdisjoint(text):
        text = text.translate(_fold_table())
    return unicodedata.normalize("NFC", text.lower())


def _apart(text: Column) -> Column:
    """text with joined letters in their parts; texts without any are passed over at once."""
    pairs = joined()
    return F.when(text.rlike(f"[{''.join(pairs)}]"), reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs.items(), text)).otherwise(text)


def looks(text: Column) -> Column:
    """text with each character in the form it looks like, without the signs that have no extent (one between a letter and its
    accent would keep the collation from seeing both as one). Accents are left to the collation; signs with an extent that
    it passes over become characters of private use, which it doesn't."""
    pairs = one_to_one() | {chr(cp): chr(0xE000 + i) for i, cp in enumerate(cp for a, b in _PASSED_OVER for cp in range(a, b + 1))}
    return _apart(F.translate(text, "".join(pairs) + ZERO_WIDTH, "".join(pairs.values())))


@cache
def _bases() -> dict[str, str]:
    """Each character of the first plane to the base letter of what it looks like, without its accents."""
    table = one_to_one() | {chr(cp): chr(cp) for cp in range(0x80, 0x10000) if not 0xAC00 <= cp <= 0xD7A3 and not 0xD800 <= cp <= 0xDFFF}
    first = {c: unicodedata.normalize("NFD", to)[0] for c, to in table.items()}
    first = {c: one_to_one().get(to, to) for c, to in first.items()}
    return {c: to for c, to in first.items() if c != to}


def _block(text: Column) -> Column:
    """A hash that texts of one class share: of the base letters and digits only. It is computed row by row, where keys of
    the collation would have to be sorted."""
    pairs = _bases()
    mapped = F.translate(_apart(text), "".join(pairs), "".join(pairs.values()))
    plain = F.when(F.octet_length(text) == F.length(text), text).otherwise(mapped)  # ASCII letters are their own bases
    return F.xxhash64(F.regexp_replace(plain, "[^\\p{L}\\p{N}]+|[\u1100-\u11ff\uac00-\ud7a3]+", ""))


@cache
def odd_signs() -> str:
    """Characters that the usual spelling doesn't have, but for letters of Greek and Cyrillic."""
    return "".join(sorted({a for a in one_to_one() if not ("Ͱ" <= a < "\u0530")} | set(joined()) | set(ZERO_WIDTH)))


def _oddness(text: Column) -> Column:
    """How far a spelling is from the usual one: changes of script within a word, then odd signs, then foreign letters."""
    switches = F.regexp_count(text, F.lit(r"\p{IsLatin}(?=[\p{IsCyrillic}\p{IsGreek}])|[\p{IsCyrillic}\p{IsGreek}](?=\p{IsLatin})"))
    signs = odd_signs()
    odd = F.length(text) - F.length(F.translate(text, signs, "")) + F.regexp_count(text, F.lit(r"\p{M}"))
    return F.struct((switches + odd).alias("odd"), F.regexp_count(text, F.lit(r"[\p{IsCyrillic}\p{IsGreek}]")).alias("foreign"), text.alias("text"))


def _candidates(df: DataFrame, text: str) -> DataFrame:
    """(text), distinct, of rows whose block holds several texts. Only hashes are shuffled to find them."""
    rows = df.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).withColumn("block", _block(F.col("text")))
    spellings = rows.select("block", F.xxhash64("text", F.length("text")).alias("x"), F.hash("text").alias("y")).distinct()
    several = spellings.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("block")
    return checked_broadcast_join(rows, cut_lineage(several), ["block"], "left_semi").select("text").distinct()


def look_alike_classes(df: DataFrame, text: str) -> DataFrame:
    """Every distinct text that shares its look with another one: (text, canonical, class_id, variants).

    Equal texts are one row from the start, and texts that are alone in their block go no further. Texts that stand alone
    have no row. Null texts have none; the empty text and texts of signs without extent are one class. class_id is the
    MD5 of the canonical text.
    """
    variants = cut_lineage(_candidates(df, text)).withColumn("look", F.collate(looks(F.col("text")), "UNICODE"))
    classes = variants.groupBy("look").agg(F.min(_oddness(F.col("text"))).alias("best"), F.count(F.lit(1)).alias("variants"))
    classes = classes.where(F.col("variants") > 1).select("look", F.col("best.text").alias("canonical"), "variants")
    joined_back = variants.join(classes, "look").drop("look")
    return joined_back.withColumn("class_id", F.md5(F.col("canonical").cast("binary"))).select("text", "canonical", "class_id", "variants")


def unify(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, text, canonical of every row: canonical is the one consistent form of all texts that look like text. Null
    texts stay null, rows stay as many as they are, other columns are dropped."""
    changes = look_alike_classes(df, text).where(F.col("text") != F.col("canonical")).select("text", "canonical")
    rows = df.select(*keys, F.col(text).alias("text"))
    out = checked_broadcast_join(rows, cut_lineage(changes), ["text"], "left", CHANGES)
    return out.select(*keys, "text", F.coalesce("canonical", "text").alias("canonical"))


def _members(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, class_id, variant): the rows whose text shares its look with another text; variant stands for the text."""
    classes = cut_lineage(look_alike_classes(df, text).select("text", "class_id"))
    rows = df.select(*keys, F.col(text).alias("text")).where(F.col("text").isNotNull())
    return checked_broadcast_join(rows, classes, ["text"], bound=CHANGES).select(*keys, "class_id", F.md5(F.col("text").cast("binary")).alias("variant"))


def look_alike_links(df: DataFrame, key: str, text: str) -> DataFrame:
    """The classes without their pairs: (key, class_id, links), a row for each row whose text has a look-alike; links is the number of
    rows of its class that are spelt otherwise. Every count is a partial sum, whatever the size of a class."""
    rows = cut_lineage(_members(df, [key], text))
    each = rows.groupBy("class_id", "variant").agg(F.count(F.lit(1)).alias("own"))
    links = each.join(each.groupBy("class_id").agg(F.sum("own").alias("all")), "class_id").select("variant", (F.col("all") - F.col("own")).alias("links"))
    return checked_broadcast_join(rows, links, ["variant"]).select(key, "class_id", "links")


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of rows whose texts differ in characters but look the same: (a, b), a < b, distinct.

    Spellings of a class are paired first, each pair of spellings once, and these pairs then meet the rows of both. So rows with
    the very same characters never meet, and each row that a join makes is a result; a spelling with very many rows is spread.
    """
    rows = cut_lineage(_members(df, [key], text).select(F.col(key).alias("id"), "class_id", "variant").distinct())
    spelt = rows.select("class_id", "variant").distinct()
    x, y = (spelt.select("class_id", F.col("variant").alias(v)) for v in ("x", "y"))
    both = cut_lineage(x.join(y, "class_id").where("x < y").select("x", "y"))
    left = checked_broadcast_join(rows.select(F.col("variant").alias("x"), F.col("id").alias("i")), both, ["x"]).select("y", "i")
    pairs = checked_broadcast_join(left, rows.select(F.col("variant").alias("y"), F.col("id").alias("j")), ["y"])
    return pairs.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
