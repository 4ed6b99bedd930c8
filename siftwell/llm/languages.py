"""The language of each passage and document, by string kernels.

Two sentences are alike by the n-grams of one to three characters that both hold (presence, not counts; the blended
spectrum), over the root of the product of how many each holds. Some sentences of each language are landmarks; by
Nyström's method a sentence is its kernel values with them, whitened by the landmarks' own kernel, and ridge regression
gives a score for each language against the rest. All that is linear behind the presence of n-grams, so sentences are
scored by one product of a block's presence matrix with an n-gram by language matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.confusables import skeleton
from siftwell.session import ship_package

# The languages and the names they go by.
LANGUAGES = {
    "en": "en eng english engelska engelsk", "sv": "sv swe swedish svenska", "de": "de deu ger german deutsch tyska", "fr": "fr fra fre french français francais franska",
    "es": "es spa spanish español espanol spanska", "da": "da dan danish dansk danska", "ru": "ru rus russian русский ryska",
}
CODES = list(LANGUAGES)

_MARKUP = re.compile(r"\{\{[^{}]*\}\}|\[\[[^\[\]]*\]\]|<ref[^<>]*>[^<]*</ref>|<[^<>]*>|\(?[\"“”„«»][^\"“”„«»]{0,80}[\"“”„«»]\)?|https?://\S+|[^\s@]{1,64}@\S+")
_MARKS = frozenset("{[<\"“”„«»@") | {"://"}
_ENDS = re.compile(r"(?<=[.!?])\s+")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
#: A sentence has this many words of two letters or more.
LEAST_WORDS = 3

_CLASSES = 108  # blank, a-z, the 32 small letters from U+00E0, the 48 from U+0430, any other letter
_PAD = np.zeros(2, np.int32)
#: Sentences in a block of the matrix product.
BLOCK = 256


def _class_table() -> np.ndarray:
    table = np.zeros(0x10000, np.int32)
    for cp in range(0x80, 0x2C00):
        if chr(cp).isalpha():
            table[cp] = _CLASSES - 1
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[0xE0:0x100] = np.arange(27, 59)
    table[0x430:0x460] = np.arange(59, 107)
    return table


_CLASS = _class_table()


def sentences(text: str | None) -> list[str]:
    """The sentences of a text: ended by . ! or ? before a blank or the line's end, with LEAST_WORDS words. Markup, quotations
    of a few words and addresses are cut out; lines without such an end hold none."""
    if not text:
        return []
    found = []
    for line in skeleton(text).splitlines():
        line = line.strip()
        if not line or line[0] == "*":
            continue
        if any(m in line for m in _MARKS):
            line = _MARKUP.sub(" ", line)
        found += [s for s in _ENDS.split(line) if s and s[-1] in ".!?" and len(_LETTERS.findall(s)) >= LEAST_WORDS]
    return found


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each position's sentence and trigram number; one and two characters are its leading digits."""
    codes = np.frombuffer("\n".join([" " + t.lower() + "  " for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = codes == 10
    kind = _CLASS[np.minimum(codes, 0xFFFF)]
    before = np.concatenate([[True], ends[:-1] | (kind[:-1] == 0)])
    keep = ~((kind == 0) & before) | ends  # runs of blanks become one
    kind, ends = kind[keep], ends[keep]
    owner = np.cumsum(ends) - ends
    kind = np.where(ends, 0, kind)
    after = np.concatenate([kind[1:], _PAD[:1]])
    third = np.concatenate([kind[2:], _PAD[: min(2, len(kind))]])[: len(kind)]
    return owner, (kind * _CLASSES + after) * _CLASSES + third


def _orders(tri: np.ndarray) -> list[np.ndarray]:
    """Trigrams, bigrams and letters as numbers that don't overlap."""
    return [tri, tri // _CLASSES + _CLASSES**3, tri // _CLASSES**2 + _CLASSES**3 + _CLASSES**2]


_GRAMS = _CLASSES**3 + _CLASSES**2 + _CLASSES


@dataclass
class Classifier:
    """columns: n-gram to column, -1 if no landmark holds it. weights: column by language."""

    columns: np.ndarray
    weights: np.ndarray

    def presence(self, texts: list[str]) -> np.ndarray:
        """A row for each text, 1 where it holds the column's n-gram."""
        width = self.weights.shape[0]
        out = np.zeros((len(texts), width + 1), np.float32)
        owner, tri = _grams(texts)
        for grams in _orders(tri):
            out[owner, self.columns[grams]] = 1.0  # the last column takes the n-grams no landmark holds
        return out[:, :width]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Kernel scores, a row for each text and a column for each language."""
        out = np.zeros((len(texts), self.weights.shape[1]), np.float32)
        for a in range(0, len(texts), BLOCK):
            held = self.presence(texts[a : a + BLOCK])
            out[a : a + BLOCK] = (held @ self.weights) / np.sqrt(np.maximum(held.sum(axis=1), 1.0))[:, None]
        return out


def fit(texts: list[str], labels: list[int], landmarks: int = 60, ridge: float = 0.05, rounds: int = 2, seed: int = 5) -> Classifier:
    """Nyström kernel ridge regression, one language against the rest.

    landmarks of each language are drawn from the texts. Labels may be wrong: after each round but the last, texts that
    their label's score isn't the greatest for are left out of the next.
    """
    labels_, draw = np.array(labels, dtype=np.int64), np.random.default_rng(seed)
    held = np.arange(len(texts))
    model = None
    for _ in range(rounds):
        picks = [draw.permutation(held[labels_[held] == c])[:landmarks] for c in range(len(CODES))]
        marks = np.concatenate(picks).astype(np.int64)
        columns = np.full(_GRAMS, -1, np.int32)
        _, tri = _grams([texts[i] for i in marks]) if len(marks) else (None, np.zeros(0, np.int64))
        used = np.unique(np.concatenate(_orders(tri)))
        columns[used] = np.arange(len(used))
        model = Classifier(columns, np.zeros((len(used), len(CODES)), np.float32))
        if not len(marks):
            return model
        unit = lambda ids: (p := model.presence([texts[i] for i in ids])) / np.sqrt(np.maximum(p.sum(axis=1), 1.0))[:, None]
        landmark = unit(marks).astype(np.float64)
        values, vectors = np.linalg.eigh(landmark @ landmark.T)
        good = values > 1e-6 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        features = np.concatenate([unit(held[a : a + BLOCK]).astype(np.float64) @ landmark.T @ whiten for a in range(0, len(held), BLOCK)])
        goal = np.where(labels_[held][:, None] == np.arange(len(CODES)), 1.0, -1.0)
        weight = 1.0 / np.maximum(np.bincount(labels_[held], minlength=len(CODES)), 1)[labels_[held]]  # languages weigh alike
        weight *= len(held) / weight.sum()
        gram = (features * weight[:, None]).T @ features + ridge * len(held) / len(CODES) * np.eye(features.shape[1])
        beta = np.linalg.solve(gram, (features * weight[:, None]).T @ goal)
        model.weights = (landmark.T @ (whiten @ beta)).astype(np.float32)
        held = held[model.scores([texts[i] for i in held]).argmax(axis=1) == labels_[held]]
    return model


def confidence(scores: np.ndarray) -> np.ndarray:
    """Scores (near 1 for the right language, -1 for others) as probabilities."""
    e = np.exp(3.0 * (scores - scores.max(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def label_code(label: Column) -> Column:
    """The two-letter code that a label names, else null."""
    word = F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)", 1)
    out = F.lit(None).cast("string")
    for code, names in LANGUAGES.items():
        out = F.when(word.isin(*names.split()), F.lit(code)).otherwise(out)
    return out


def _sentence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, h, id, place, sentence) of (code, h, id, text)."""
    for batch in batches:
        found = [sentences(t) for t in batch.column(3).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        columns = [batch.column(i).take(at) for i in range(3)] + [pa.array([i for f in found for i in range(len(f))], pa.int32()), pa.array([x for f in found for x in f], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["code", "h", "id", "place", "sentence"])


def training_sentences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = 150, sentences_per_language: int = 400) -> DataFrame:
    """(code, h, id, place, sentence), a bounded sample: of each language the per_language labelled documents with the least hash of
    their id, and of their sentences (whole texts are read) sentences_per_language, the first of each document before any
    second."""
    ship_package(documents.sparkSession)
    code, h = label_code(F.col(label)).alias("code"), F.xxhash64(F.col(doc_id).cast("string")).alias("h")
    first = Window.partitionBy("code")
    least = documents.select(code, h).where(F.col("code").isNotNull()).withColumn("r", F.row_number().over(first.orderBy("h")))
    limits = F.broadcast(least.where(F.col("r") <= per_language).groupBy("code").agg(F.max("h").alias("limit")))  # 7 rows
    rows = documents.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), code, h).join(limits, "code").where(F.col("h") <= F.col("limit"))
    rows = rows.withColumn("r", F.row_number().over(first.orderBy("h", "id", "text")))
    picked = rows.where((F.col("r") <= per_language) & F.col("text").isNotNull()).select("code", "h", "id", "text")
    found = picked.mapInArrow(_sentence_rows, "code string, h bigint, id string, place int, sentence string")
    found = found.withColumn("r", F.row_number().over(first.orderBy("place", "h", "id", "sentence")))
    return found.where(F.col("r") <= sentences_per_language).drop("r")


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = 150, sentences_per_language: int = 400) -> Classifier:
    """A classifier fitted on training_sentences, the only rows that reach the driver."""
    picked = training_sentences(documents, doc_id, text, label, per_language, sentences_per_language).collect()  # at most 7 * sentences_per_language rows
    picked.sort(key=lambda r: (CODES.index(r["code"]), r["place"], r["h"], r["id"], r["sentence"]))
    return fit([r["sentence"] for r in picked], [CODES.index(r["code"]) for r in picked])


#: A change of language within a document costs as much as this log-probability; so an unsure sentence goes with its neighbours.
SWITCH = 1.5


def smooth(logs: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The likeliest sequence of languages for a document's sentences."""
    best = logs.argmax(axis=1)
    if len(best) < 2 or (best == best[0]).all():
        return best
    n, score = len(logs), logs[0].copy()
    back = np.zeros(logs.shape, np.int64)
    stay = np.arange(logs.shape[1])
    for i in range(1, n):
        top = int(score.argmax())
        moved = score[top] - switch > score
        back[i] = np.where(moved, top, stay)
        score = np.where(moved, score[top] - switch, score) + logs[i]
    path = np.empty(n, np.int64)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def runs(languages: np.ndarray) -> list[tuple[int, int, int]]:
    """(language, first, length) of the runs of equal values."""
    if not len(languages):
        return []
    starts = np.concatenate([[0], np.flatnonzero(languages[1:] != languages[:-1]) + 1])
    return [(int(languages[a]), int(a), int(b - a)) for a, b in zip(starts, [*starts[1:], len(languages)], strict=True)]


def _passages(batches: Iterator[pa.RecordBatch], model: Classifier) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ends = [], []
        for t in batch.column(1).to_pylist():
            texts += sentences(t)
            ends.append(len(texts))
        scores = model.scores(texts)
        sure = confidence(scores) if len(texts) else scores
        logs = np.log(np.maximum(sure, 1e-9))
        rows: list[tuple] = []
        take = []
        for d, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            for c, first, n in runs(smooth(logs[a:b]) if b > a else logs[a:b, 0]):
                take.append(d)
                rows.append((first, n, CODES[c], float(sure[a + first : a + first + n, c].mean()), b - a))
            if a == b:
                take.append(d)
                rows.append((0, 0, None, None, 0))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        keep = batch.take(pa.array(take, pa.int32())) if take else batch.slice(0, 0)
        arrays = [keep.column(0), keep.column(2), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "label", "first", "sentences", "lang", "confidence", "of"])


def passages(documents: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Each document's passages, runs of sentences in one language: (doc_id, label, first, sentences, lang, confidence, of).

    first is the passage's first sentence, of the document's number of sentences, confidence the mean over the passage.
    Documents without a sentence (null and empty texts too) have one row without a language. Rows aren't shuffled, each
    text is read whole.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), label_code(F.col(label)).alias("label"))
    held = documents.sparkSession.sparkContext.broadcast(model)
    ship_package(documents.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _passages(batches, held.value), f"doc_id {kind}, label string, first int, sentences int, lang string, confidence double, of int")


def held_languages(parts: DataFrame) -> DataFrame:
    """The languages a document holds: two sentences of a passage, or the only sentence. (doc_id, label, lang, confidence)."""
    held = parts.where((F.col("sentences") >= 2) | ((F.col("of") == 1) & (F.col("sentences") == 1)))
    return held.groupBy("doc_id", "label", "lang").agg(F.try_divide(F.sum(F.col("confidence") * F.col("sentences")), F.sum("sentences")).alias("confidence"))


def wrong_labels(held: DataFrame) -> DataFrame:
    """(doc_id, lang) of documents whose label is missing or none of their languages, or that hold several."""
    each = held.groupBy("doc_id", "label").agg(F.collect_set("lang").alias("langs"))  # at most one of each language
    case = F.col("label").isNull() | ~F.array_contains("langs", F.col("label")) | (F.size("langs") > 1)
    return each.where(case).select("doc_id", F.explode("langs").alias("lang")).distinct()
