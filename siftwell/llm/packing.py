"""Filling containers of a fixed capacity with documents, by bounded-space online best-fit."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import ship_package

#: Containers a packer holds open.
OPEN_BINS = 64
LONG_TEXT = 100_000


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("held", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str, pattern: str) -> Callable[[str], int]:
    """Counts the tokens of a text by a byte-level BPE given as a file of ranks.

    The encoder splits texts by recursion and overflows on runs of some hundred thousand letters, so texts above LONG_TEXT
    characters are split here by the same pattern, piece by piece; the tokens are the same.
    """
    import regex

    encoding, pieces = _encoding(path, pattern), regex.compile(pattern)

    def count(text: str) -> int:
        if len(text) <= LONG_TEXT:
            return len(encoding.encode_ordinary(text))
        return sum(len(encoding._encode_single_piece(m.group())) for m in pieces.finditer(text))

    return count


class BestFit:
    """Online best-fit with at most open_bins open containers.

    Bit f of the bitset is set while some open container has f units free; the best container for an item of n units is
    the lowest set bit from n on. Where none fits and all places are taken, the fullest container, the lowest set bit,
    closes. A container without free units closes at once. Items are given out with their container's number when it
    closes; finish() closes the rest, after packing what those hold once more, largest first. Items of no units go to
    container 0.
    """

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.bins, self.open, self.next = 0, {}, 0, 0

    def _take(self, free: int) -> tuple[int, list]:
        held = self.bins[free]
        taken = held.pop()
        if not held:
            del self.bins[free]
            self.bits ^= 1 << free
        self.open -= 1
        return taken

    def put(self, units: int, item) -> list[tuple]:
        """Takes an item of at most capacity units; gives the (item, number) of the containers this closes."""
        if not units:
            return [(item, 0)]
        closed: list[tuple] = []
        fits = self.bits >> units
        if fits:
            free = units + (fits & -fits).bit_length() - 1
            number, held = self._take(free)
        else:
            if self.open == self.open_bins:
                full, items = self._take((self.bits & -self.bits).bit_length() - 1)
                closed += [(x, full) for _, x in items]
            free, number, held = self.capacity, self.next, []
            self.next += 1
        free -= units
        held.append((units, item))
        if free:
            if free not in self.bins:
                self.bins[free] = []
                self.bits |= 1 << free
            self.bins[free].append((number, held))
            self.open += 1
        else:
            closed += [(x, number) for _, x in held]
        return closed

    def finish(self) -> list[tuple]:
        """The (item, number) of all containers still open, which hold at most open_bins * capacity units."""
        rest = sorted((b for bins in self.bins.values() for b in bins), key=lambda b: b[0])
        numbers, items = [n for n, _ in rest], [i for _, held in rest for i in held]
        again = BestFit(self.capacity, max(1, len(items)))
        placed = [x for units, item in sorted(items, key=lambda i: -i[0]) for x in again.put(units, item)]
        placed += [(x, n) for bins in again.bins.values() for n, held in bins for _, x in held]
        if again.next > len(numbers):  # not better
            placed = [(x, k) for k, (_, held) in enumerate(rest) for _, x in held]
        self.bits, self.bins, self.open = 0, {}, 0
        return [(x, numbers[k]) for x, k in placed]


def pack(documents: DataFrame, capacity: int, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text", open_bins: int = OPEN_BINS) -> DataFrame:
    """The container of each document or piece: (doc_id, piece, start, tokens, container).

    Documents are measured in tokens of the vocabulary (a file of BPE ranks at a path all executors have, split by
    pattern). A document above the capacity is cut into pieces of capacity tokens and a rest; start is a piece's first
    token. No other document is cut. Null and empty texts have 0 tokens and still get a container. Each partition of the
    input is packed in its order by one packer, so nothing is shuffled, a task holds the items of open_bins containers
    whatever the size of its input, and a task that runs again gives the same rows; container is '<partition>-<number>'
    and holds documents of one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count, packer, part = token_counter(vocabulary, pattern), BestFit(capacity, open_bins), TaskContext.get().partitionId()

        def given(closed: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*[(*row, f"{part}-{number}") for row, number in closed], strict=True)) or [[]] * 5
            kinds = [kind, pa.int32(), pa.int64(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "tokens", "container"])

        kind = None
        for batch in batches:
            kind, closed = batch.schema.field(0).type, []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = count(t) if t else 0
                for piece, start in enumerate(range(0, n, capacity) or (0,)):
                    size = min(capacity, n - start)
                    closed += packer.put(size, (key, piece, start, size))
            yield given(closed, kind)
        if kind is not None:
            yield given(packer.finish(), kind)

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ship_package(documents.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, tokens int, container string")
