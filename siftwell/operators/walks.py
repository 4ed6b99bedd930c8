"""Monte-Carlo PageRank: ranks estimated from random walks.

Every draw is a hash of seed, step and walk, so the walks are the same however they are carried out, and those of a smaller number
are the first of a greater. A graph of at most local_links links is written to the shared folder once; every worker reads it
from there and takes its walks to their ends, so there is one pass and one aggregation of visits. Beyond RAW_LINKS Spark numbers and
sorts the links first, and workers read them as they stand. Larger graphs go step by step with the walks as a DataFrame, which
meets the links on (node, link number). Methods that begin alike take one pass together: a path is the walk up to its first
dangling node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.graph import BORED, nodes, out_degree
from siftwell.operators.hotkeys import ranked_pairs
from siftwell.operators.index import dense_ids
from siftwell.operators.skew import checked_broadcast_join
from siftwell.session import cut_lineage, scratch_dir, ship_package

#: Links of a graph that each worker may hold (4 bytes each; at most an eighth as many nodes, of some 30 bytes), links that workers
#: sort themselves, and walks taken together, whose arrays stay in a CPU's cache. Results don't depend on them.
LOCAL_LINKS = 50_000_000
RAW_LINKS = 4_000_000
LOCAL_WALKS = 1 << 17
#: Visits that are kept before they are counted, and rows of a batch.
KEPT_VISITS = 1 << 20
BATCH_ROWS = 1 << 16
#: Steps whose visits are added up at once.
MERGED = 16

# The primes of the public hash xxHash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


@dataclass(frozen=True)
class Method:
    """cyclic: walks begin at each node in turn, else anywhere. path: all visits count, else the last. A walk over a path
    ends at a dangling node, one that counts its end jumps anywhere from there."""

    cyclic: bool
    path: bool


METHODS = {1: Method(False, False), 2: Method(True, False), 4: Method(True, True), 5: Method(False, True)}


def _uniform(seed: int, step: int, walk: Column) -> Column:
    """In [0, 1), by seed, step and walk."""
    parts = (F.lit(seed).cast("bigint"), F.lit(step).cast("bigint"), walk.cast("bigint"))
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _mixed(x: np.ndarray) -> np.ndarray:
    """What a number brings to its hash, whatever the seed."""
    h = x.view(np.uint64) * _P2
    h = (h << np.uint64(31)) | (h >> np.uint64(33))
    h *= _P1
    return h


def _hash_of(mixed: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxHash64 of one 64-bit number, as the SQL function computes it."""
    h = mixed ^ (seed + _P5 + np.uint64(8))
    t = h << np.uint64(27)
    h >>= np.uint64(37)
    h |= t
    h *= _P1
    h += _P4
    for by, prime in ((33, _P2), (29, _P3), (32, None)):
        np.right_shift(h, np.uint64(by), out=t)
        h ^= t
        if prime is not None:
            h *= prime
    return h


def _draw(seed: int, step: int, mixed: np.ndarray) -> np.ndarray:
    """uniform for walks that are mixed already."""
    h = np.array([42], np.uint64)
    for part in (seed, step):
        h = _hash_of(_mixed(np.array([part], np.int64)), h)
    h = _hash_of(mixed, h)
    h >>= np.uint64(11)
    return h * (1.0 / (1 << 53))


def uniform(seed: int, step: int, walks: np.ndarray) -> np.ndarray:
    """_uniform for arrays."""
    return _draw(seed, step, _mixed(walks))


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _load(path: str) -> pa.Table:
    system, place = _place(path)
    return pq.read_table(place, filesystem=system)


def _in_order(path: str) -> Iterator[pq.ParquetFile]:
    """The files of a table that was written in order."""
    system, place = _place(path)
    for name in sorted(f.path for f in system.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet")):
        with system.open_input_file(name) as f:
            yield pq.ParquetFile(f)


@dataclass(frozen=True)
class Graph:
    """names of the nodes in order; the links of node i are ends[first[i] : first[i + 1]], in order."""

    names: pa.Array
    first: np.ndarray
    ends: np.ndarray

    @classmethod
    def read(cls, path: str, lone: bool) -> Graph:
        """From links and, if there are lone nodes, nodes below path."""
        edges = _load(f"{path}/edges")
        ends = [*edges["src"].chunks, *edges["dst"].chunks, *(_load(f"{path}/nodes")["node"].chunks if lone else [])]
        names = pc.unique(pa.chunked_array(ends, edges["src"].type))
        names = names.take(pc.array_sort_indices(names))
        src, dst = (pc.index_in(edges[c], names).to_numpy() for c in ("src", "dst"))
        order = np.lexsort((dst, src))
        return cls(names, np.searchsorted(src[order], np.arange(len(names) + 1)).astype(np.int32), dst[order].astype(np.int32))

    @classmethod
    def read_placed(cls, path: str) -> Graph:
        """From names and links below path that stand in order already, links by numbers of nodes."""
        names = pa.chunked_array([b["node"] for f in _in_order(f"{path}/names") for b in f.iter_batches(columns=["node"])]).combine_chunks()
        ends = np.empty(sum(f.metadata.num_rows for f in _in_order(f"{path}/placed")), np.int32)
        first, done = np.zeros(len(names) + 1, np.int32), 0
        for f in _in_order(f"{path}/placed"):
            for b in f.iter_batches(BATCH_ROWS):
                src = b["s"].to_numpy()
                ends[done : done + len(src)] = b["d"].to_numpy()
                first[src[0] + 1 : src[-1] + 2] += np.bincount(src - src[0]).astype(np.int32)
                done += len(src)
        pa.default_memory_pool().release_unused()
        return cls(names, np.cumsum(first, out=first), ends)

    def visits(self, begin: int, end: int, cyclic: bool, paths: tuple[bool, ...], bored: float, seed: int) -> Iterator[tuple[bool, np.ndarray]]:
        """(path, nodes) of the visits that count, step by step, of the walks from begin to end. paths: whether all visits of a walk
        that ends at a dangling node count (True), the ends of walks that jump from there (False), or each apart."""
        n, both, step = len(self.names), len(paths) > 1, 0
        walks = np.arange(begin, end)
        mixed = _mixed(walks)
        at = (walks % n if cyclic else _draw(seed, -1, mixed) * n).astype(np.int32)
        whole = np.ones(len(at), bool)  # not yet beyond a dangling node
        while len(at):
            goes = _draw(seed, 2 * step, mixed) >= bored
            if True in paths:
                yield True, at[whole] if both else at
            if False in paths:
                yield False, at[~goes]
            first = self.first.take(at)
            out = self.first.take(at + 1) - first
            if False not in paths:
                goes &= out > 0
            go = np.flatnonzero(goes)
            mixed, first, out = mixed.take(go), first.take(go), out.take(go)
            draw = _draw(seed, 2 * step + 1, mixed)
            link = first + (draw * out).astype(np.int32)
            lost = np.flatnonzero(out == 0)
            link[lost] = 0
            at = self.ends.take(link) if len(self.ends) else link
            at[lost] = (draw.take(lost) * n).astype(np.int32)
            if both:
                whole = whole.take(go)
                whole[lost] = False
            step += 1


@lru_cache(maxsize=1)
def _graph(path: str, lone: bool, placed: bool) -> Graph:
    """Workers run several tasks one after the other; the last graph stays."""
    return Graph.read_placed(path) if placed else Graph.read(path, lone)


class _Counts:
    """Visits of each slot by kind of method; slots are nodes, or with slot what it says of each node."""

    def __init__(self, slots: int, slot: np.ndarray | None):
        self.slots, self.slot, self.counts, self.kept = slots, slot, {}, {}

    def add(self, path: bool, at: np.ndarray) -> None:
        self.kept.setdefault(path, []).append(at if self.slot is None else self.slot.take(at))
        if sum(map(len, self.kept[path])) > max(KEPT_VISITS, self.slots):
            self.settle(path)

    def settle(self, path: bool) -> np.ndarray:
        if path not in self.counts:
            self.counts[path] = np.zeros(self.slots, np.int64)
        if self.kept.get(path):
            self.counts[path] += np.bincount(np.concatenate(self.kept.pop(path)), minlength=self.slots)
        return self.counts[path]


@dataclass(frozen=True)
class Laid:
    """A graph as walks need it: distinct links and lone nodes as files below path, its nodes, and how they are walked: 'raw', 'placed' or 'steps'."""

    edges: DataFrame
    path: str
    lone: bool
    graph: DataFrame
    n: int
    way: str

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None, local_links: int | None = None) -> Laid:
        spark, most = edges.sparkSession, LOCAL_LINKS if local_links is None else local_links
        path = scratch_dir(spark)
        edges.select("src", "dst").write.parquet(f"{path}/edges")
        edges = spark.read.parquet(f"{path}/edges")
        if vertices is not None:
            vertices.select(F.col("node").cast(edges.schema["src"].dataType)).dropna().write.parquet(f"{path}/nodes")
            vertices = spark.read.parquet(f"{path}/nodes")
        graph, links = nodes(edges, vertices), edges.count()
        if links > RAW_LINKS:
            graph = cut_lineage(graph)
        n = graph.count()
        way = "steps" if links > most or n > most // 8 else "raw" if max(n, links) <= RAW_LINKS else "placed"
        if way == "placed" and n:
            numbered, pairs = _numbered(edges, graph)
            numbered.select("node", "at").repartitionByRange("at").sortWithinPartitions("at").select("node").write.parquet(f"{path}/names")
            pairs = pairs.select(F.col("s").cast("int"), F.col("d").cast("int"))
            pairs.repartitionByRange("s", "d").sortWithinPartitions("s", "d").write.parquet(f"{path}/placed")
        return cls(edges, path, vertices is not None, graph if way != "steps" else cut_lineage(graph), n, way)

    def seen(self, numbers: list[int], cyclic: bool, paths: tuple[bool, ...], bored: float, seed: int, only: list | None = None) -> DataFrame:
        """(path, part, node, n): visits by the walks from each of the numbers to the next; nodes never visited have a row of 0. only: the
        nodes that have rows of their own, all others have one with a null."""
        if self.way != "steps":
            return _walk_local(self, numbers, cyclic, paths, bored, seed, only)
        found = None
        for path in paths:
            one = _walk_steps(self.edges, self.graph, numbers, self.n, Method(cyclic, path), bored, seed).select(F.lit(path).alias("path"), "part", "node", "n")
            found = one if found is None else found.unionAll(one)
        if only is None:
            return found
        return found.groupBy("path", "part", F.when(F.col("node").isin(only), F.col("node")).alias("node")).agg(F.sum("n").alias("n"))


def _walk_local(laid: Laid, numbers: list[int], cyclic: bool, paths: tuple[bool, ...], bored: float, seed: int, only: list | None) -> DataFrame:
    """Laid.seen from tasks that hold the whole graph."""
    spark, kind = laid.edges.sparkSession, laid.edges.schema["src"].dataType.simpleString()
    ship_package(spark)
    begins = [0, *numbers[:-1]]
    pieces = [-(-(end - begin) // LOCAL_WALKS) for begin, end in zip(begins, numbers, strict=True)]  # of each part
    upto = np.cumsum(pieces)
    path, lone, placed, size = laid.path, laid.lone, laid.way == "placed", LOCAL_WALKS

    def rows(graph: Graph, counts: _Counts, part: int, zeros: bool) -> Iterator[pa.RecordBatch]:
        names = graph.names if only is None else pa.array([None, *only], graph.names.type)
        for whole in paths:
            n = counts.settle(whole)
            found = np.arange(len(n)) if zeros else np.flatnonzero(n)
            for i in range(0, len(found), BATCH_ROWS):
                f = found[i : i + BATCH_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), whole)), pa.array(np.full(len(f), part, np.int32)), names.take(pa.array(f)), pa.array(n[f])], ["path", "part", "node", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = slot = counts = None
        part = zeros = -1
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                if graph is None:
                    graph = _graph(path, lone, placed)
                    if only is not None:
                        slot = np.zeros(len(graph.names), np.int16)
                        slot[pc.index_in(pa.array(only, graph.names.type), graph.names).to_numpy()] = np.arange(1, len(only) + 1)
                here = min(int(np.searchsorted(upto, chunk, "right")), len(pieces) - 1)
                if here != part:
                    if counts is not None:
                        yield from rows(graph, counts, part, zeros)
                    counts = _Counts(len(graph.names) if only is None else len(only) + 1, slot)
                    part, zeros = here, chunk == 0
                begin = begins[part] + (chunk - int(upto[part]) + pieces[part]) * size
                for whole, at in graph.visits(begin, min(numbers[part], begin + size), cyclic, paths, bored, seed):
                    counts.add(whole, at)
        if counts is not None:
            yield from rows(graph, counts, part, zeros)

    chunks = max(1, int(upto[-1]))
    # A task gives a row for each node that it saw, so as few tasks as keep all CPUs busy; a few rows, where few nodes are wanted.
    width = min(chunks, (1 if only is None else 4) * spark.sparkContext.defaultParallelism)
    return spark.range(0, chunks, 1, width).mapInArrow(run, f"path boolean, part int, node {kind}, n bigint").groupBy("path", "part", "node").agg(F.sum("n").alias("n"))


def _numbered(edges: DataFrame, graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, at) with the nodes' numbers in order, and the links as (s, d) between numbers."""
    numbered = cut_lineage(dense_ids(graph, "node", "at"))
    named = lambda end, to: numbered.select(F.col("node").alias(end), F.col("at").alias(to))
    pairs = checked_broadcast_join(checked_broadcast_join(edges, named("src", "s"), ["src"]), named("dst", "d"), ["dst"]).select("s", "d")
    return numbered, pairs


def _walk_steps(edges: DataFrame, graph: DataFrame, numbers: list[int], n: int, how: Method, bored: float, seed: int) -> DataFrame:
    """(part, node, n) step by step."""
    numbered, pairs = _numbered(edges, graph)
    numbered = cut_lineage(numbered.join(out_degree(edges, graph), "node"))
    ranked = ranked_pairs(cut_lineage(pairs), "s", "d", 1).select(F.col("s").alias("at"), F.col("piece").alias("link"), F.col("d").alias("to"))
    links = cut_lineage(checked_broadcast_join(ranked, numbered.select(F.col("at").alias("to"), F.col("out").alias("to_out")), ["to"]))
    part = sum(((F.col("walk") >= x).cast("int") for x in numbers), F.lit(0))
    walks = edges.sparkSession.range(numbers[-1]).select(F.col("id").alias("walk"))
    start = F.col("walk") % n if how.cyclic else F.floor(_uniform(seed, -1, F.col("walk")) * n)
    frontier = cut_lineage(walks.withColumn("at", start).join(numbered.select("at", "out"), "at").select("walk", "at", "out"))
    seen, fresh, step = None, [], 0
    while not frontier.isEmpty():
        goes = _uniform(seed, 2 * step, F.col("walk")) >= bored
        draw = _uniform(seed, 2 * step + 1, F.col("walk"))
        fresh.append((frontier if how.path else frontier.where(~goes)).select(part.alias("part"), "at"))
        moving = frontier.where(goes & (F.col("out") > 0)).select("walk", "at", F.floor(draw * F.col("out")).alias("link"))
        following = checked_broadcast_join(moving, links, ["at", "link"]).select("walk", F.col("to").alias("at"), F.col("to_out").alias("out"))
        if not how.path:
            lost = frontier.where(goes & (F.col("out") == 0)).select("walk", F.floor(draw * n).alias("at"))
            following = following.unionAll(lost.join(numbered.select("at", "out"), "at").select("walk", "at", "out"))
        frontier, step = cut_lineage(following), step + 1
        if len(fresh) == MERGED:
            seen, fresh = cut_lineage(_added(seen, fresh)), []
    counts = _added(seen, fresh).join(numbered.select("at", "node"), "at").select("part", "node", "n")
    return counts.unionAll(numbered.select(F.lit(0), "node", F.lit(0).cast("bigint"))).groupBy("part", "node").agg(F.sum("n").alias("n"))


def _added(seen: DataFrame | None, fresh: list[DataFrame]) -> DataFrame:
    """(part, at, n): seen and the visits of some more steps."""
    parts = [f.withColumn("n", F.lit(1).cast("bigint")) for f in fresh] + ([seen] if seen is not None else [])
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole.groupBy("part", "at").agg(F.sum("n").alias("n"))


def _ranks(seen: DataFrame, numbers: list[int]) -> DataFrame:
    """(path, walks, node, rank) for each number of walks, from Laid.seen."""
    if len(numbers) == 1:
        counts = seen.select("path", F.lit(numbers[0]).cast("bigint").alias("walks"), "node", "n")
    else:
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("upto"), F.lit(x).cast("bigint").alias("walks")) for i, x in enumerate(numbers)])).alias("at")
        counts = seen.select("path", "part", "node", "n", at).select("path", "at.walks", "node", F.when(F.col("part") <= F.col("at.upto"), F.col("n")).otherwise(0).alias("n"))
        counts = counts.groupBy("path", "walks", "node").agg(F.sum("n").alias("n"))
    totals = F.broadcast(counts.groupBy("path", "walks").agg(F.sum("n").alias("total")))  # a row for each number
    return counts.join(totals, ["path", "walks"]).select("path", "walks", "node", F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0)).alias("rank"))


def method_series(laid: Laid, numbers: Callable[[int, bool], list[int]], methods: list[int], bored: float = BORED, seed: int = 1, only: list | None = None) -> DataFrame:
    """(method, walks, node, rank): walk_series for several methods, those that begin alike in one pass. numbers says how many walks by the
    number of nodes and whether each node begins some. only: the nodes that are wanted."""
    if not 0 < bored <= 1:
        raise ValueError("a surfer who is never bored walks for ever")
    n, found = laid.n, None
    for cyclic in sorted({METHODS[m].cyclic for m in methods}):
        alike = {METHODS[m].path: m for m in methods if METHODS[m].cyclic == cyclic}
        wanted = sorted(set(numbers(n, cyclic)))
        if not n or not wanted:
            one = laid.graph.where("false").select(F.lit(0).alias("method"), F.lit(0).cast("bigint").alias("walks"), "node", F.lit(0.0).alias("rank"))
        else:
            if cyclic and wanted[0] < n:
                raise ValueError(f"{wanted[0]} walks can't begin at each of {n} nodes")
            ends = [x // n * n if cyclic else x for x in wanted]
            ranks = _ranks(cut_lineage(laid.seen(ends, cyclic, tuple(sorted(alike)), bored, seed, only)), wanted)
            method = F.when(F.col("path"), F.lit(alike.get(True))).otherwise(F.lit(alike.get(False))).cast("int")
            one = ranks.where("node is not null").select(method.alias("method"), "walks", "node", "rank")
        found = one if found is None else found.unionAll(one)
    return found


def walk_series(edges: DataFrame, numbers: list[int] | Callable[[int], list[int]], method: int, bored: float = BORED, seed: int = 1, local_links: int | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """(walks, node, rank) for each number of walks, from the walks of the greatest: visits of each node over all visits, 0 for nodes
    never visited; no nodes give no rows. vertices (node) adds nodes without links. numbers may be a function of the number
    of nodes. With a cyclic start each node begins as many walks, number // nodes, at least one. Methods: see METHODS.

    Equal arguments give equal walks; local_links, LOCAL_LINKS if not given, decides how they are carried out, not what comes out.
    """
    wanted = lambda n, _: numbers(n) if callable(numbers) else numbers
    return method_series(Laid.of(edges, vertices, local_links), wanted, [method], bored, seed).drop("method")


def monte_carlo(edges: DataFrame, walks: int | Callable[[int], int], method: int, bored: float = BORED, seed: int = 1, local_links: int | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """(node, rank): walk_series for one number of walks, or a function of the number of nodes."""
    numbers = (lambda n: [walks(n)]) if callable(walks) else [walks]
    return walk_series(edges, numbers, method, bored, seed, local_links, vertices).select("node", "rank")


def enough(n_nodes: int, least: int, per_node: int) -> int:
    """The least number of walks, as many from each node, that is at least least and per_node of each node."""
    return n_nodes * max(per_node, -(-least // max(1, n_nodes)))


def sweep(n_nodes: int) -> list[int]:
    """The numbers of walks to compare methods at: one to ten times each power of ten from the number of nodes' to two above."""
    least = len(str(max(1, n_nodes))) - 1
    return [k * 10**m for m in range(least, least + 3) for k in range(1, 11)]


def goodness_series(reference: DataFrame, laid: Laid, methods: list[int], numbers: Callable[[int], list[int]] = sweep, k: int = 30, **how) -> DataFrame:
    """(method, walks, goodness) of each method for each number of walks, over the reference's (node, rank) k greatest ranks. Numbers below
    that of the nodes are left out where each node begins a walk. Only visits of these k nodes are told apart."""
    taken = lambda n, cyclic: [x for x in numbers(n) if x >= n or not cyclic]
    best = reference.orderBy(F.desc("rank"), "node").limit(k).select("node", F.col("rank").alias("want"))
    best = cut_lineage(laid.graph.join(F.broadcast(best), "node"))  # k rows
    found = method_series(laid, taken, methods, only=[r["node"] for r in best.select("node").collect()], **how).join(F.broadcast(best), "node")
    return found.groupBy("method", "walks").agg(F.sum(F.pow(F.col("want") - F.col("rank"), 2)).alias("goodness"))


def sweep_goodness(reference: DataFrame, edges: DataFrame, method: int, numbers: Callable[[int], list[int]] = sweep, k: int = 30, local_links: int | None = None, vertices: DataFrame | None = None, **how) -> DataFrame:
    """(walks, goodness): goodness_series of one method."""
    return goodness_series(reference, Laid.of(edges, vertices, local_links), [method], numbers, k, **how).drop("method")
