"""Per-key results when a few keys hold most rows.

The work is cut by value, not by key. A key's values lie in cells, intervals that don't overlap. Each round counts a cell's
values in bins, partial counts of all tasks add up, and the bins are the next, finer cells. Ranks follow from the counts
alone, so only cells that still matter are refined: those that hold a wanted rank and more than one value (exact
selection), or those with too many values for one task (ranking). No task ever holds a hot key's values, and cold keys go
the same way.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.skew import checked_broadcast_join
from siftwell.session import cut_lineage

#: Bins of a histogram in each round, beside one for the least and one for the greatest value.
BINS = 256
#: Values ranked in one group: at most max(BLOCK_ROWS, total / BLOCKS), so at most BLOCKS cells are ever refined at once.
BLOCK_ROWS = 1_000
BLOCKS = 100_000

_CELL = ["key", "cell", "bin"]


def _bin(value: Column, lo: Column, hi: Column) -> Column:
    """0 for the least value, BINS + 1 for the greatest, else 1 to BINS in value order; so each round parts at least two values."""
    gap = lambda a, b: F.coalesce(F.try_subtract(a, b).cast("double"), a.cast("double") - b.cast("double"))
    part = F.nanvl(F.coalesce(F.try_divide(gap(value, lo), gap(hi, lo)), F.lit(0.0)), F.lit(0.0))
    step = F.least(F.greatest(F.floor(part * F.lit(float(BINS))) + 1, F.lit(1)), F.lit(BINS))
    return F.when(value == lo, F.lit(0)).when(value == hi, F.lit(BINS + 1)).otherwise(step).cast("int")


def _histogram(rows: DataFrame) -> DataFrame:
    """(key, cell, bin, n, lo, hi): counts that tasks add up before and after the shuffle, and the bin's ends."""
    return rows.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def _before(by: list[str]) -> Column:
    """Values in the bins before this one; a cell has at most BINS + 2 bins."""
    return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def exact_selection(rows: DataFrame, ranks: Callable[[Column], Column]) -> DataFrame:
    """The exact values at 1-based ranks: (key, rank, value, below, n) from rows (key, value) without nulls.

    ranks makes the array of a key's wanted ranks from its number of rows. below counts the key's lesser values, n those equal to
    the found one. rows must be cheap to read again (a table or checkpoint). The first round's bins are the same for all
    keys, so it joins nothing; later rounds read the rows of open cells only.
    """
    ends = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # one row
    rows = rows.join(F.broadcast(ends)).select("key", "value", F.col("lo").alias("cell"), _bin(F.col("value"), F.col("lo"), F.col("hi")).alias("bin"))
    cells = _histogram(rows).withColumn("below", _before(["key"])).withColumn("ranks", ranks(F.sum("n").over(Window.partitionBy("key"))))
    found = None
    while True:
        inside = F.filter("ranks", lambda r: (r > F.col("below")) & (r <= F.col("below") + F.col("n")))
        cells = cut_lineage(cells.withColumn("ranks", inside).where(F.size("ranks") > 0).select(*_CELL, "lo", "hi", "n", "below", "ranks"))
        one = cells.where("lo = hi").select("key", F.explode("ranks").alias("rank"), F.col("lo").alias("value"), "below", "n")
        found = one if found is None else found.unionAll(one)
        more = cells.where("lo <> hi")
        if more.isEmpty():
            return found
        narrow = more.select(*_CELL, "lo", "hi")
        rows = checked_broadcast_join(rows, narrow, _CELL, counts=more.select(*_CELL, "n")).select("key", "value", F.col("lo").alias("cell"), _bin(F.col("value"), F.col("lo"), F.col("hi")).alias("bin"))
        rows = cut_lineage(rows)
        parents = more.select("key", F.col("lo").alias("cell"), F.col("below").alias("base"), "ranks")
        cells = _histogram(rows).withColumn("inner", _before(["key", "cell"])).join(parents, ["key", "cell"]).withColumn("below", F.col("base") + F.col("inner"))


def exact_quantiles(df: DataFrame, key: str, value: str, probs: list[float]) -> DataFrame:
    """The exact discrete quantiles of each key: (key, prob, value), value at rank max(1, ceil(prob * n)).

    Rows with a null or NaN key or value are left out, repeated rows count each time, ties are ranks of the same value; no rows
    give no rows. value must be numeric.
    """
    rows = cut_lineage(df.select(F.col(key).alias("key"), F.col(value).alias("value")).dropna())
    rank = lambda p, n: F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(float(p)) * n).cast("bigint"))
    found = exact_selection(rows, lambda n: F.array_distinct(F.array(*[rank(p, n) for p in probs]))).select("key", "rank", "value")
    total = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    asked = total.select("key", F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), rank(p, F.col("n")).alias("rank")) for p in probs])).alias("at"))
    return asked.select("key", F.col("at.prob").alias("prob"), F.col("at.rank").alias("rank")).join(found, ["key", "rank"]).select("key", "prob", "value")


def heavy_values(rows: DataFrame, least: int) -> DataFrame:
    """(value, n): the values that occur at least least times in rows (value), with their exact counts; nulls don't count.

    In value order such a value fills least places in a row or more, so it stands at one of the ranks least, 2 * least, ...; exact
    selection finds what stands there, and its last cell holds the count. Only histograms are shuffled. rows must be cheap to read again.
    """
    if least < 1:
        raise ValueError("least must be positive")
    step = F.lit(least).cast("bigint")
    ranks = lambda n: F.when(n >= least, F.sequence(step, n, step)).otherwise(F.array().cast("array<bigint>"))
    found = exact_selection(rows.select(F.lit(0).alias("key"), "value").where("value is not null"), ranks)
    return found.where(F.col("n") >= least).select("value", "n").distinct()


def heavy_sources(edges: DataFrame, edge_id: str, src: Column, share: float) -> DataFrame:
    """(src, out): sources that hold at least share of the distinct edge ids, with their number of edge ids. Edges with a null
    source count in the whole only, rows that repeat count once, null edge ids never; no edges give no rows."""
    held = cut_lineage(edges.select(F.col(edge_id).alias("edge"), src.alias("value")).where("edge is not null").distinct())
    total = held.select("edge").distinct().count()
    least = max(1, math.ceil(Fraction(str(share)) * total))
    return heavy_values(held, least).select(F.col("value").alias("src"), F.col("n").alias("out"))


def ranked_pairs(pairs: DataFrame, key: str, value: str, capacity: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """pairs with their place within the key: columns key, value, cell, piece; a key's values are numbered in order and piece is
    that number by capacity. (key, value) must be distinct and not null, and pairs cheap to read again. Keys with more than
    a block of values are refined into cells of at most a block, each ranked by itself behind the values before it."""
    rows = pairs.select(F.col(key).alias("key"), F.col(value).alias("value"))
    block = max(block_rows, -(-rows.count() // BLOCKS))
    whole = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).where(F.col("n") > block))
    nothing = F.lit(None).cast(pairs.schema[value].dataType)
    if whole.isEmpty():
        placed = rows.select("key", "value", nothing.alias("cell"), F.lit(0).cast("bigint").alias("below"))
    else:
        split = checked_broadcast_join(rows, whole.select("key", "lo", "hi"), ["key"], "left", counts=whole.select("key", "n"))
        placed = split.where("lo is null").select("key", "value", nothing.alias("cell"), F.lit(0).cast("bigint").alias("below"))
        rows = split.where("lo is not null").withColumn("below", F.lit(0).cast("bigint"))
        while True:
            rows = cut_lineage(rows.select("key", "value", F.col("lo").alias("cell"), _bin(F.col("value"), F.col("lo"), F.col("hi")).alias("bin"), "below"))
            cells = rows.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("below").alias("base"))
            cells = cut_lineage(cells.select(*_CELL, "lo", "hi", "n", (F.col("base") + _before(["key", "cell"])).alias("below")))
            rows = checked_broadcast_join(rows.drop("below"), cells, _CELL, counts=cells.select(*_CELL, "n"))
            large = F.col("n") > block
            placed = placed.unionAll(rows.where(~large).select("key", "value", F.col("lo").alias("cell"), "below"))
            if cells.where(large).isEmpty():
                break
            rows = rows.where(large)
    number = F.col("below") + F.row_number().over(Window.partitionBy("key", "cell").orderBy("value")) - 1
    return placed.select(F.col("key").alias(key), F.col("value").alias(value), "cell", F.floor(number / F.lit(capacity)).alias("piece"))


def links_by_source(edges: DataFrame, edge_id: str, src: Column, dst: Column, capacity: int = 1000) -> DataFrame:
    """Each source's number of links and its list of targets, in pieces: (src, out, n_targets, piece, link).

    out: distinct edge ids of the source. link: its distinct targets that are not null, ascending, at most capacity in a
    row; piece numbers them from 0. Edges with a null source are left out, a source without targets has one row with an
    empty link; an edge that repeats counts once. No edges give no rows.
    """
    links = edges.select(F.col(edge_id).alias("edge"), src.alias("src"), dst.alias("dst")).where("src is not null").distinct()
    pairs = cut_lineage(links.groupBy("src", "dst").agg(F.count("edge").alias("edges")))
    outs = pairs.groupBy("src").agg(F.sum("edges").alias("out"), F.count("dst").alias("n_targets"))
    pieces = ranked_pairs(pairs.where(F.col("dst").isNotNull()).select("src", "dst"), "src", "dst", capacity)
    pieces = pieces.groupBy("src", "piece").agg(F.sort_array(F.collect_list("dst")).alias("link"))
    out = outs.join(pieces, "src", "left")
    return out.select("src", "out", "n_targets", F.coalesce("piece", F.lit(0)).cast("bigint").alias("piece"), F.coalesce("link", F.array().cast(f"array<{pairs.schema['dst'].dataType.simpleString()}>")).alias("link"))
