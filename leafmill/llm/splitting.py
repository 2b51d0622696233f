"""Problem 3: cutting oversized texts at natural boundaries, with overlap.

Each position between two characters has a boundary strength. A sparse table over the strengths answers
range-maximum queries, so the strongest cut of a permissible window is found in constant time; ties go to
the right. Windows are never longer than the limit, so that the table has log2(limit) levels, and it is made
slice by slice. The next piece starts a step back by the overlap; only where that would put the next natural
boundary out of reach, and so force a cut, it is the largest step that doesn't.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strengths of the natural boundaries.
PARAGRAPH, LINE, SENTENCE, CLAUSE = 4, 3, 2, 1
_ENDS = re.compile(r"\r\n?|\n|[\u2028\u2029\x85]|[。！？!?]|[；;]|\.(?=\s)")


def strengths(text: str) -> np.ndarray:
    """Strength of the cut after each character; 0 where there is no natural boundary."""
    s = np.zeros(len(text), dtype=np.int8)
    for m in _ENDS.finditer(text):
        c = m[0][0]
        s[m.end() - 1] = LINE if c in "\n\r\u2028\u2029\x85" else CLAUSE if c in "；;" else SENTENCE
    for m in re.finditer(r"\n\s*\n", text):
        s[m.end() - 1] = PARAGRAPH
    return s


class SparseTable:
    """Range maximum with its rightmost place, in constant time a query, for ranges of at most ``longest`` values."""

    def __init__(self, values: np.ndarray, longest: int):
        n = len(values)
        best = values.astype(np.int32) * (n + 1) + np.arange(n, dtype=np.int32)  # ties go to the right
        self.n, self.rows = n, [best]
        step = 1
        while 2 * step <= min(n, longest):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[: n - 2 * step + 1], last[step : n - step + 1]))
            step *= 2

    def query(self, lo: int, hi: int) -> tuple[int, int]:
        """(largest value, its rightmost place) of lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        return divmod(int(max(self.rows[k][lo], self.rows[k][hi - (1 << k) + 1])), self.n + 1)


#: Characters that one sparse table covers, at least.
SLICE = 1 << 18


def cuts(text: str, limit: int = 1000, overlap: int = 100, least: float = 0.5) -> list[tuple[int, int, int]]:
    """(start, end, forced) of the pieces of ``text``; forced: the end is no natural boundary.

    A piece is at most ``limit`` characters; its end is sought first beyond ``least`` of the limit. A cut is
    forced only where more than ``limit`` characters lie between two neighbouring natural boundaries. Pieces
    overlap by ``overlap`` characters, or by fewer where more would force a cut, or would not move on.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 0)] if n else []
    strong = strengths(text)
    natural = np.append(np.flatnonzero(strong) + 1, n)  # ends at natural boundaries
    out, start, end, base, table = [], 0, 0, 0, None
    while n - start > limit:
        hi = start + limit - 1
        if table is None or hi >= base + table.n:
            base = start
            table = SparseTable(strong[base : base + max(SLICE, 2 * limit)], limit)
        lo = max(end, start + int(limit * least))
        value, at = table.query(lo - base, hi - base) if lo <= hi else (0, 0)
        if not value and lo > end:
            value, at = table.query(end - base, lo - 1 - base)
        at = at + base if value else hi
        out.append((start, at + 1, int(not value)))
        end = at + 1
        ahead = int(natural[np.searchsorted(natural, end, side="right")])  # the text goes on, so that there is one
        back = end - overlap
        if ahead - end <= limit:
            back = max(back, ahead - limit)
        start = max(back, start + 1)
    out.append((start, n, 0))
    return out


_PIECES = "array<struct<start:int,end:int,forced:int>>"


def split_oversized(df: DataFrame, id_col: str, text_col: str, page_start: str | None = None, page_end: str | None = None, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """Pieces of every text: id, ``piece_no`` from 1, ``piece_start``, ``piece_end``, ``forced``, ``piece``, and its pages.

    A null or empty text has no piece. A text within the limit is one piece and never reaches Python. The
    pages of a piece are its share of the pages of its row by characters; a missing or 0 page number takes
    the other one, and pages in the wrong order are put right; with neither, the pages are null.
    """
    text = F.col(text_col)

    @F.pandas_udf(_PIECES)
    def pieces(s: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "forced": f} for a, b, f in cuts(t, limit, overlap)] for t in s])

    a = F.nullif(F.col(page_start), F.lit(0)) if page_start else F.lit(None).cast("int")
    b = F.nullif(F.col(page_end), F.lit(0)) if page_end else F.lit(None).cast("int")
    rows = df.where(text.isNotNull() & (F.length(text) > 0)).select(
        F.col(id_col), text.alias("_text"), F.length(text).alias("_n"),
        F.least(F.coalesce(a, b), F.coalesce(b, a)).alias("_p0"), F.greatest(F.coalesce(a, b), F.coalesce(b, a)).alias("_p1"),
    )
    short = rows.where(F.col("_n") <= limit).withColumn("_cuts", F.array(F.struct(F.lit(0).alias("start"), F.col("_n").alias("end"), F.lit(0).alias("forced"))))
    long = rows.where(F.col("_n") > limit).withColumn("_cuts", pieces("_text"))
    each = short.unionByName(long).select("*", F.posexplode("_cuts").alias("_k", "_c"))
    span = F.col("_p1") - F.col("_p0") + 1

    def page(at):
        return (F.col("_p0") + F.floor(at * span / F.col("_n"))).cast("int")

    return each.select(
        id_col, (F.col("_k") + 1).alias("piece_no"), F.col("_c.start").alias("piece_start"), F.col("_c.end").alias("piece_end"), F.col("_c.forced").alias("forced"),
        F.substring("_text", F.col("_c.start") + 1, F.col("_c.end") - F.col("_c.start")).alias("piece"),
        page(F.col("_c.start")).alias("piece_page_start"), page(F.col("_c.end") - 1).alias("piece_page_end"),
    )
