"""Evaluation items leaking into a corpus.

Items and documents become sequences of words; windows of as many words as make a leak slide over both. The CGK walk
embeds a window so that few word edits become few differing positions: it reads the window with one pointer, writes the
word under the pointer at each step, and a random bit of that word decides whether the pointer moves. The hash of some
sampled positions among a walk's first 2 * window is a key (later ones mostly read the pad behind the window), and windows
are embedded in several walks. Keys of both sides are
DataFrames and meet in a join; the exact edit distance of the words decides over each pair of windows that met.

Words are 64-bit hashes, so no side needs the other's vocabulary. Two Bloom filters of bounded size, of the items' words and of
their keys, go to the documents' tasks and keep back what can't meet anything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.confusables import fold
from siftwell.operators.skew import checked_broadcast_join
from siftwell.session import cut_lineage, ship_package

_WORD = re.compile(r"[^\W_]+")
#: Windows embedded at once in a task, and words a task knows by number before it begins anew.
CHUNK = 1 << 16
KNOWN = 1 << 19
#: 64-bit slots of a filter: one for each value in it, within these bounds (16 MB at most; with more values it only keeps less back).
LEAST_SLOTS, MOST_SLOTS = 1 << 10, 1 << 21

#: Numbers of the word that equals nothing and of the pad behind a short window; also their hashes.
_OTHER, _PAD = 0, 1


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case and in the form they look like."""
    return _WORD.findall(fold(text))


def _hash(word: str) -> int:
    return max(2, xxhash.xxh3_64_intdigest(word))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers from any (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Filter:
    """A blocked Bloom filter of 64-bit hashes: each sets four bits of one 64-bit slot."""

    SHIFTS = (40, 46, 52, 58)

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) - 1)

    @classmethod
    def of(cls, hashes: DataFrame) -> Filter:
        """hashes (h BIGINT). Only the filter's slots, at most MOST_SLOTS, reach the driver."""
        size = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << hashes.count().bit_length()))
        h = F.col("h")
        bits = F.lit(0).cast("bigint")
        for s in cls.SHIFTS:
            place = F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
            bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
        found = hashes.groupBy(h.bitwiseAND(F.lit(size - 1).cast("bigint")).alias("slot")).agg(F.bit_or(bits).alias("bits")).toArrow()
        table = np.zeros(size, np.uint64)
        table[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return cls(table)

    def has(self, h: np.ndarray) -> np.ndarray:
        bits = np.zeros_like(h)
        for s in self.SHIFTS:
            bits |= np.uint64(1) << ((h >> np.uint64(s)) & np.uint64(63))
        return self.table[h & self.mask] & bits == bits


@dataclass(frozen=True)
class Walks:
    """The walks: as many as repetitions, of which sampled positions make a key. With gaps, windows of the items are up to so many
    words shorter or longer than window, too, as a document may have words added or left out."""

    window: int
    max_edits: int
    repetitions: int
    sampled: int
    seed: int
    gaps: int = 0

    def keys(self, windows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """A row for each walk, a column for each window. windows holds numbers of words, hashes the words' hashes by number."""
        n, width = len(windows), self.window + self.gaps
        padded = np.full((n, width + 1), _PAD, dtype=np.int64)
        padded[:, : windows.shape[1]] = windows
        flat, base, steps = padded.ravel(), np.arange(n) * (width + 1), 2 * self.window
        draw = np.random.default_rng(self.seed)
        out = np.zeros((self.repetitions, n), np.uint64)
        for r in range(self.repetitions):
            salt = draw.integers(1, 2**63, -(-steps // 64), dtype=np.uint64)
            at = set(np.sort(draw.choice(steps, self.sampled, replace=False)).tolist())
            bits = [_mixed(hashes ^ s) for s in salt]
            pointer, key = base.copy(), np.full(n, salt[0], np.uint64)
            end = base + width
            for step in range(max(at) + 1 if at else 0):
                symbol = flat[pointer]
                if step in at:
                    key = _mixed(key + hashes[symbol] * np.uint64(2 * step + 1))
                pointer += ((bits[step // 64][symbol] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)
                np.minimum(pointer, end, out=pointer)
            out[r] = key
        return out


def _item_windows(batches: Iterator[pa.RecordBatch], walks: Walks) -> Iterator[pa.RecordBatch]:
    """(item_id, words, keys): the windows of each item."""
    for batch in batches:
        number: dict[str, int] = {}
        rows: dict[tuple, list] = {}
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = words(text)
            if len(found) < walks.window:
                continue
            for size in range(max(1, walks.window - walks.gaps), walks.window + walks.gaps + 1):
                for a in range(len(found) - size + 1):
                    rows.setdefault((item, tuple(found[a : a + size])), [number.setdefault(w, len(number) + 2) for w in found[a : a + size]])
        hashes = np.array([_OTHER, _PAD, *map(_hash, number)], np.uint64)
        ready = list(rows.items())
        for a in range(0, len(ready), CHUNK):
            part = ready[a : a + CHUNK]
            windows = np.full((len(part), walks.window + walks.gaps), _PAD, np.int64)
            for i, (_, ids) in enumerate(part):
                windows[i, : len(ids)] = ids
            keys = walks.keys(windows, hashes).view(np.int64).T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, walks.repetitions), pa.int32()), pa.array(keys.ravel()))
            columns = [pa.array([i for (i, _), _ in part], pa.int64()), pa.array([" ".join(w) for (_, w), _ in part], pa.string()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "words", "keys"])


def _hits(batches: Iterator[pa.RecordBatch], walks: Walks, known: Filter, wanted: Filter) -> Iterator[pa.RecordBatch]:
    """(doc_id, words, keys): windows of documents with the keys that may be an item's."""
    w, number, hashes = walks.window, {}, [_OTHER, _PAD]
    for batch in batches:
        if len(number) > KNOWN:
            number, hashes = {}, [_OTHER, _PAD]
        flat: list[str] = []
        ends = []
        docs = batch.column(0).to_numpy(zero_copy_only=False)
        for text in batch.column(1).to_pylist():
            if text:
                flat += words(text)
            ends.append(len(flat))
        if len(flat) < w:
            continue
        new = list({x for x in flat if x not in number})
        if new:
            h = np.fromiter(map(_hash, new), np.uint64, len(new))
            for x, code, held in zip(new, h.tolist(), known.has(h).tolist(), strict=True):
                number[x] = len(hashes) if held else _OTHER
                if held:
                    hashes.append(code)
        ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        of = np.array(hashes, np.uint64)
        count = np.concatenate([[0], np.cumsum(ids != _OTHER)])
        owner = np.searchsorted(np.array(ends), np.arange(len(ids)), "right")
        enough = count[w:] - count[:-w] >= w - walks.max_edits  # each other word costs an edit
        starts = np.flatnonzero(enough & (owner[: len(ids) - w + 1] == owner[w - 1 :]))
        for a in range(0, len(starts), CHUNK):
            part = starts[a : a + CHUNK]
            keys = walks.keys(ids[part[:, None] + np.arange(w)], of)
            row, column = np.nonzero(wanted.has(keys).T)
            if not len(row):
                continue
            held, first = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array([*first, len(row)], pa.int32()), pa.array(keys[column, row].view(np.int64)))
            at = part[held]
            columns = [pa.array(docs[owner[at]], pa.int64()), pa.array([" ".join(flat[i : i + w]) for i in at.tolist()], pa.string()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "words", "keys"])


def edit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of a and b; 0 in a equals nothing."""
    (n, w), v = a.shape, b.shape[1]
    row = np.tile(np.arange(v + 1), (n, 1))
    for i in range(w):
        before, row = row, np.empty_like(row)
        row[:, 0] = i + 1
        for j in range(v):
            swap = before[:, j] + (a[:, i] != b[:, j])
            row[:, j + 1] = np.minimum(np.minimum(before[:, j + 1], row[:, j]) + 1, swap)
    return row[:, v]


def _verified(batches: Iterator[pa.RecordBatch], walks: Walks) -> Iterator[pa.RecordBatch]:
    """(mine, theirs, edits) of the pairs within max_edits word edits."""
    for batch in batches:
        number: dict[str, int] = {}
        code = lambda column: [[number.setdefault(x, len(number) + 1) for x in t.split(" ")] for t in column.to_pylist()]  # noqa: E731,B023
        mine, theirs = code(batch.column(0)), code(batch.column(1))
        sizes = np.array([len(t) for t in theirs], np.int64)
        edits = np.full(len(mine), walks.max_edits + 1, np.int64)
        for size in np.unique(sizes):
            these = np.flatnonzero(sizes == size)
            a, b = np.array([mine[i] for i in these]), np.array([theirs[i] for i in these])
            if size != walks.window:  # a word more at an end is only a shorter window
                ends = (a[:, 0] == b[:, 0]) & (a[:, -1] == b[:, -1])
                these, a, b = these[ends], a[ends], b[ends]
            edits[these] = edit_distance(a, b)
        near = np.flatnonzero(edits <= walks.max_edits)
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(near)) for i in (0, 1)), pa.array(edits[near].astype(np.int32))], ["mine", "theirs", "edits"])


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    window: int = 10, max_edits: int = 1, repetitions: int = 16, sampled: int = 10, seed: int = 11, gaps: int = 1,
) -> DataFrame:
    """(doc_id, item_id, edits), a row for each pair: the document has window consecutive words within max_edits word edits of
    window consecutive words of the item; edits is the least number. With gaps (at most max_edits) the item's may be up to
    so many fewer or more, so that words added to the document or left out count as one edit each; the first and the last
    words then agree, since a word more at an end is only a shorter window.

    Equal windows take equal walks, so pairs of no edit are all found. With k edits the recall grows with repetitions and
    falls with sampled (the positions that must agree). Null and empty texts, and texts shorter than the window, leak
    nothing; ids must be integers, rows with a null id are left out; rows that repeat count once.

    Documents are read once, whole, and aren't shuffled; only windows that may meet an item's are. Items are spread over
    tasks like any table. Pairs of windows are verified once for each two texts, however many documents and items hold
    them, and joins with a hot window are balanced.
    """
    if not 0 <= gaps <= max_edits < window:
        raise ValueError("gaps can't be above max_edits, nor max_edits reach the window")
    spark = documents.sparkSession
    ship_package(spark)
    walks = Walks(window, max_edits, repetitions, sampled, seed, gaps)
    items = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).dropna()
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).dropna()
    cut = cut_lineage(items.mapInArrow(lambda batches: _item_windows(batches, walks), "item_id bigint, words string, keys array<bigint>"))
    keys = cut_lineage(cut.select(F.explode("keys").alias("key"), F.col("words").alias("theirs")).distinct())
    said = items.mapInArrow(_word_hashes, "h bigint").distinct()
    filters = spark.sparkContext.broadcast((Filter.of(said), Filter.of(keys.select(F.col("key").alias("h")).distinct())))
    hits = docs.mapInArrow(lambda batches: _hits(batches, walks, *filters.value), "doc_id bigint, words string, keys array<bigint>")
    hits = cut_lineage(hits.withColumnRenamed("words", "mine"))
    met = checked_broadcast_join(hits.select("mine", F.explode("keys").alias("key")).distinct(), keys, ["key"]).select("mine", "theirs").distinct()
    near = cut_lineage(met.mapInArrow(lambda batches: _verified(batches, walks), "mine string, theirs string, edits int"))
    owners = cut.select(F.col("words").alias("theirs"), "item_id").distinct()
    pairs = checked_broadcast_join(hits.select("doc_id", "mine").distinct(), near, ["mine"]).groupBy("doc_id", "theirs").agg(F.min("edits").alias("edits"))
    return checked_broadcast_join(pairs, owners, ["theirs"]).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {_hash(w) for text in batch.column(1).to_pylist() for w in words(text)}
        yield pa.RecordBatch.from_arrays([pa.array(np.array(sorted(found), np.uint64).view(np.int64))], ["h"])
