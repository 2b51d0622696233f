"""Problem 7: filling context windows with documents.

The sizes are a histogram of at most ``GRID`` cells a window, whatever the number of documents. The linear
program over configurations (multisets of cells that fit a window) is solved by multiplicative weights: a
round prices the cells by what of them is still uncovered, a knapsack by dynamic programming over the stock
that is left finds the best full configuration, and it is taken as often as the step says. Steps are whole
numbers of windows and shrink with what is left, so that the solution never holds more of a cell than there
is. The rounds stop when all but ``REST`` of the volume is covered or no configuration fills a window; the
rest is rounded up by windows filled with the largest item first. Documents then take the slots by their
rank within the cell, as joins.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, written

#: Cells of the length histogram at most.
GRID = 2048
#: A step takes this part of the windows that are left; share of the volume that is left to the rounding.
STEPS, REST = 100, 0.1
#: Dearest cells that a knapsack prices; half as many of the smallest and of evenly spaced ones join them.
DEAREST = 128
#: Items of one cell, or oversized documents, that are ranked in one part.
PART_ROWS = 50_000
#: Capacities at most; more raise an error.
MOST_WINDOWS = 1000


def _knapsack(size: np.ndarray, price: np.ndarray, stock: np.ndarray, room: int) -> np.ndarray:
    """Counts of the cells in the fullest configuration within ``stock``; among the fullest the dearest one."""
    best = np.full(room + 1, -np.inf)
    best[0], top, took = 0.0, 0, []
    for i in range(len(size)):
        left, part = min(int(stock[i]), room // int(size[i])), 1
        while left > 0:  # a stock in powers of two
            n = min(part, left)
            w = n * int(size[i])
            if w > room:
                break
            top = min(room, top + w)
            value, old = best[: top + 1 - w] + n * price[i], best[w : top + 1]
            up = value > old
            np.copyto(old, value, where=up)
            took.append((i, n, w, up))
            left, part = left - n, part * 2
    used, c = np.zeros(len(size), np.int64), int(np.flatnonzero(best > -np.inf)[-1])
    for i, n, w, up in reversed(took):
        if w <= c < w + len(up) and up[c - w]:
            used[i] += n
            c -= w
    return used


def program(size: np.ndarray, count: np.ndarray, room: int, rest: float = REST) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """([(multiplicity, counts)], what is left): the solution of the program by multiplicative weights.

    ``size`` ascends and is below ``room``. A cell's price is its size times a weight that falls with the
    part of it that is covered; larger cells start dearer, since small ones fill gaps to the end.
    """
    left, out, step = count.copy(), [], None
    volume, lead = float((size * count).sum()), size / room
    while True:
        todo = float((size * left).sum())
        if todo <= rest * volume:
            return out, left
        weight = np.exp(lead + left / count - todo / volume)
        most = max(1, int(todo / room / STEPS))
        step = most if step is None else min(most, 2 * step)
        while True:
            ok = np.flatnonzero(left >= step)
            gap = room
            if step == 1 or (size[ok] * left[ok]).sum() >= todo / 4:
                if len(ok) > 2 * DEAREST:
                    dear = np.argsort(-weight[ok], kind="stable")[:DEAREST]
                    even = np.linspace(0, len(ok) - 1, DEAREST // 2).astype(int)
                    ok = ok[np.unique(np.concatenate([dear, even, np.arange(DEAREST // 2)]))]
                used = _knapsack(size[ok], (size * weight)[ok], left[ok] // step, room)
                gap = room - int((used * size[ok]).sum())
            if gap == 0 or step == 1:
                break
            step //= 2
        if gap:
            return out, left
        full = np.zeros(len(size), np.int64)
        full[ok] = used
        out.append((step, full))
        left = left - full * step


def solve(size: np.ndarray, count: np.ndarray, room: int, rest: float = REST) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """[(multiplicity, cells, counts)]: configurations that hold all items, ``count`` of each ``size``, in windows of ``room``.

    No solution has fewer windows than the dual bound: the volume divided by ``room``, from the prices that
    are the sizes. With ``rest`` 1 the program is left out, for comparison.
    """
    order = np.argsort(size)
    size, count = size[order], count[order].astype(np.int64)
    live = size < room
    out = [(int(n), order[[i]], np.ones(1, np.int64)) for i, n in enumerate(count) if not live[i] and n]
    live &= count > 0
    at, size, count = order[live], size[live], count[live]
    if not len(size):
        return out
    taken, left = program(size, count, room, rest)
    return out + [(m, at[used > 0], used[used > 0]) for m, used in taken + _rounded(size, left, room)]


def _rounded(size: np.ndarray, left: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """Windows out of what is left, the largest item first."""
    out = []
    while left.any():
        have = left > 0
        pick = np.zeros(len(size), np.int64)
        pick[have] = _fill(size[have], left[have], room)
        some = pick > 0
        m = int((left[some] // pick[some]).min())
        out.append((m, pick))
        left = left - pick * m
    return out


def _fill(size: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """The largest item that is left, then the fullest completion of its window."""
    pick = np.zeros(len(size), np.int64)
    sizes = size.tolist()
    have = left.tolist()
    i = len(sizes) - 1
    while i >= 0:
        n = min(have[i], room // sizes[i])
        if n:
            pick[i] += n
            room -= sizes[i] * n
        i = min(i - 1, bisect.bisect_right(sizes, room) - 1)
    return pick


def _ahead(rows: DataFrame, keys: list[str], weight) -> DataFrame:
    """``rows`` with ``ahead``: the sum of ``weight`` over the rows of the same keys that come before, by parts of :data:`PART_ROWS` rows.

    Rows have ``id`` and ``k``. Only the parts' sums, a row for :data:`PART_ROWS`, are ordered as a whole.
    """
    many = written(rows.groupBy(*keys).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")), "parts")
    many = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    placed = rows.join(many, keys).withColumn("part", F.pmod(F.xxhash64("id", "k"), F.col("parts")).cast("int")).drop("parts")
    sums = placed.groupBy(*keys, "part").agg(F.sum(weight).alias("sum"))
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = written(sums.select(*keys, "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset")), "offsets")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    within = W.partitionBy(*keys, "part").orderBy("id", "k").rowsBetween(W.unboundedPreceding, -1)
    own = placed.withColumn("own", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return own.join(sums, [*keys, "part"]).withColumn("ahead", F.col("own") + F.col("offset")).drop("own", "offset", "part")


def pack(sizes: DataFrame, windows: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """Every document in windows of every capacity: ``window_code``, ``container``, ``id_col``, ``piece_no``, ``token_start``, ``tokens``.

    A document larger than the capacity is cut into full windows and a rest; no other one is split. A
    document of null or 0 tokens takes no room and goes to container 0. Codes with a null or non-positive
    capacity are left out; ids must be unique. More than :data:`MOST_WINDOWS` capacities raise an error.
    """
    caps = windows.where("capacity_tokens > 0").select("window_code", F.col("capacity_tokens").cast("long").alias("room")).distinct()
    caps = caps.orderBy("window_code", "room").limit(MOST_WINDOWS + 1).collect()
    if len(caps) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows")
    kind = "array<struct<window_code:string,room:bigint>>"
    each = F.explode(F.array(*[F.struct(F.lit(r.window_code).alias("window_code"), F.lit(r.room).cast("long").alias("room")) for r in caps]).cast(kind))
    docs = written(sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("n")), "sizes")
    tried = docs.where("n > 0").select("id", "n", each.alias("w")).select("w.window_code", "w.room", "id", "n", F.floor(F.col("n") / F.col("w.room")).alias("k"), (F.col("n") % F.col("w.room")).alias("tokens"))
    # full windows are numbered by document, not by piece
    full = _ahead(tried.where("k > 0").select("window_code", "room", "id", "k"), ["window_code"], F.col("k"))
    full = full.select("window_code", "id", "room", "ahead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    full = full.select("window_code", (F.col("ahead") + F.col("j")).alias("container"), F.col("id").alias(id_col), F.col("j").cast("int").alias("piece_no"), (F.col("j") * F.col("room")).alias("token_start"), F.col("room").alias("tokens"))
    grid = F.least(F.lit(GRID), F.col("room"))
    pieces = tried.where("tokens > 0").withColumn("cell", F.ceil(grid * F.col("tokens") / F.col("room")).cast("int"))
    filled = tried.groupBy("window_code").agg(F.sum("k").alias("filled"))
    cells = pieces.groupBy("window_code", "room", "cell").agg(F.count("*").alias("n")).join(filled, "window_code")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        # a window may have room left that the rounding to cells has hidden; sizes stay at most the cell
        pdf = pdf.sort_values("cell")
        at_cell, first = pdf.cell.to_numpy(np.int64), int(pdf.filled.iloc[0])
        out, used = [], np.zeros(len(pdf), np.int64)
        for m, at, counts in solve(at_cell, pdf.n.to_numpy(), min(GRID, int(pdf.room.iloc[0]))):
            for i, a in zip(at.tolist(), counts.tolist()):
                out.append((pdf.window_code.iloc[0], int(at_cell[i]), int(used[i]), a, first))
                used[i] += m * a
            first += m
        return pd.DataFrame(out, columns=["window_code", "cell", "from_rank", "each", "first"])

    # a task a window: a number of partitions that adaptive execution leaves as it is
    spread = cells.repartition(8 * max(1, len(caps)), "window_code")
    slots = spread.groupBy("window_code").applyInPandas(plan, "window_code string, cell int, from_rank long, each long, first long")
    runs = slots.groupBy("window_code", "cell").agg(F.array_sort(F.collect_list(F.struct("from_rank", "each", "first"))).alias("runs"))
    runs = written(runs, "slots")
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs  # GRID rows a window at most
    ranked = _ahead(pieces.select("window_code", "room", "cell", "id", "k", "tokens"), ["window_code", "cell"], F.lit(1)).join(runs, ["window_code", "cell"])
    run = F.element_at(F.filter("runs", lambda r: r["from_rank"] <= F.col("ahead")), -1)
    placed = ranked.withColumn("run", run).select(
        "window_code", (F.col("run.first") + F.floor((F.col("ahead") - F.col("run.from_rank")) / F.col("run.each"))).cast("long").alias("container"),
        F.col("id").alias(id_col), F.col("k").cast("int").alias("piece_no"), (F.col("k") * F.col("room")).alias("token_start"), "tokens",
    )
    zero = F.lit(0).cast("long")
    empty = docs.where("n <= 0").select("id", each.alias("w")).select("w.window_code", zero.alias("container"), F.col("id").alias(id_col), F.lit(0).alias("piece_no"), zero.alias("token_start"), zero.alias("tokens"))
    return placed.unionByName(full).unionByName(empty)
