"""Problem 2: near-duplicate records with small edits.

Texts with equal forms are one class. Each class has a MinHash signature of its distinct n-character
sequences, a byte a hash, and a band is a few of these bytes. Bands are shuffled by their value; the classes
of a bucket that meet there are candidates if this is their first shared band, so that no pair comes twice,
and if their whole signatures agree well enough. Candidates are verified on the full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, written
from .pairs import member_pairs
from .unify import consistent_form

#: Members of a bucket that meet as one block with another block.
BLOCK = 1000


def _small(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast if there are few of them; otherwise the join shuffles."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def bands_for(similarity: float, recall: float = 0.99, background: float = 0.1, most: int = 200) -> tuple[int, int]:
    """(bands, rows): the cheapest banding that finds a pair at ``similarity`` with ``recall``.

    Costs are the hashes plus the chance candidates that ``background``-similar texts give.
    """
    best = None
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > most:
            continue
        cost = bands * rows / most + 300 * bands * background**rows
        if best is None or cost < best[0]:
            best = cost, bands, rows
    return best[1], best[2]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngram_hashes(text: str, n: int) -> np.ndarray:
    """A 64-bit hash for each n-character sequence of ``text``; a shorter text is one sequence."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    k = min(n, len(c))
    h = np.zeros(max(0, len(c) - k + 1), dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : len(c) - k + 1 + i] + np.uint64(1)
    return _mix(h)


def _signature(h: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = (h >> np.uint64(16)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(out, (factors[:, None] * low[None, i : i + 2048]).min(1), out=out)
    return out


def _similar(a: str, b: str, n: int) -> float:
    x, y = np.unique(ngram_hashes(a, n)), np.unique(ngram_hashes(b, n))
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def _meet(least: float):
    """Candidates of the buckets of sorted rows: each pair in its first shared band, if its signatures agree in ``least`` of their bytes or more."""

    def pairs_of(rows: pd.DataFrame):
        band, place, own, ids = (rows[c].to_numpy() for c in ("band", "place", "block", "id"))
        bands = np.stack(rows.bands.to_numpy())
        marks, which = bands.view(np.uint8), (band >> 32).astype(np.int64)
        for d in range(1, len(rows)):
            at = np.flatnonzero((band[d:] == band[:-d]) & (place[d:] == place[:-d]))
            if not len(at):
                return
            # of two blocks only members of different ones meet
            at = at[(own[at] != own[at + d]) | (place[at] >> 32 == place[at] & 0xFFFFFFFF)]
            for i in range(0, len(at), 20_000):
                x = at[i : i + 20_000]
                y = x + d
                good = (bands[x] == bands[y]).argmax(1) == which[x]
                x, y = x[good], y[good]
                good = (marks[x] == marks[y]).mean(1) >= least
                x, y = ids[x[good]], ids[y[good]]
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    def run(batches):
        open_ = None
        for pdf in batches:
            rows = pdf if open_ is None else pd.concat([open_, pdf], ignore_index=True)
            if not len(rows):
                continue
            # the last bucket may go on in the next batch
            last = int(((rows.band == rows.band.iloc[-1]) & (rows.place == rows.place.iloc[-1])).to_numpy().argmax())
            open_ = rows.iloc[last:].reset_index(drop=True)
            yield from pairs_of(rows.iloc[:last])
        if open_ is not None:
            yield from pairs_of(open_)

    return run


def near_duplicates(texts: DataFrame, id_col: str, text_col: str, similarity: float = 0.6, n: int = 4, recall: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the texts that share ``similarity`` of their distinct n-character sequences.

    members: ``id`` (a whole number, unique), ``class_id`` (the least id with the same text), one row for
    each non-null text. links: ``class_a < class_b``, ``similarity`` of the different texts. Empty texts form
    a class without links. No bucket is capped: the members of a large one meet in blocks of :data:`BLOCK`.
    """
    bands, rows = bands_for(similarity, recall)
    seeds = np.random.RandomState(7).randint(0, 1 << 31, bands * rows).astype(np.uint32) * np.uint32(2) + np.uint32(1)

    width = 4 if rows <= 4 else 8  # bytes of a band

    @F.pandas_udf("array<int>" if width == 4 else "array<long>")
    def sign(s: pd.Series) -> pd.Series:
        sig = np.stack([_signature(ngram_hashes(t, n), seeds) for t in s]) if len(s) else np.zeros((0, len(seeds)), np.uint32)
        marks = (sig.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(12)).astype(np.uint8).reshape(len(sig), bands, rows)
        wide = np.zeros((len(sig), bands, width), np.uint8)
        wide[:, :, :rows] = marks
        return pd.Series(list(wide.reshape(len(sig), -1).view(np.int32 if width == 4 else np.int64)))

    ok = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ok = written(ok.select("id", "text", F.md5("text").alias("key")), "texts")
    members = written(ok.select("id", "key").join(ok.groupBy("key").agg(F.min("id").alias("class_id")), "key").select("id", "class_id"), "members")
    copies = members.where("id <> class_id").select("id")
    one = ok.where("text <> ''").select("id", "text").join(_small(copies), "id", "left_anti")
    signed = written(one.select("id", sign("text").alias("bands")), "signed")

    value = F.col("h").cast("long") if width == 4 else F.xxhash64("h")
    placed = signed.select("id", F.posexplode("bands").alias("i", "h")).select("id", (F.col("i").cast("long") * (1 << 32) + value.bitwiseAND(0xFFFFFFFF)).alias("band"))
    # members are counted with a map-side combine; only bands of two or more stay, and hash into their blocks
    several = placed.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    shared = placed.join(written(several, "bands"), "band").join(signed, "id")
    shared = shared.select("id", "band", "bands", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    place = (F.least("block", "other").cast("long") * (1 << 32) + F.greatest("block", "other")).alias("place")
    shared = shared.select("band", place, "block", "id", "bands").repartition("band", "place").sortWithinPartitions("band", "place")
    # padding bytes agree always, chance ones in one of 256
    share = similarity - 4 * math.sqrt(similarity * (1 - similarity) / (bands * rows))  # four standard errors
    least = ((share + (1 - share) / 256) * rows + width - rows) / width
    pairs = written(shared.mapInPandas(_meet(least), "a long, b long"), "candidates")

    @F.pandas_udf("double")
    def verify(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_similar(x, y, n) for x, y in zip(a, b)], dtype=float)

    text = ok.select("id", "text").join(_small(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id", "left_semi")
    links = pairs.join(text.toDF("a", "ta"), "a").join(text.toDF("b", "tb"), "b").select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), verify("ta", "tb").alias("similarity"))
    return members, written(links.where(F.col("similarity") >= similarity), "links")


#: White space of any kind.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def squashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``form``: the consistent form without any white space."""
    return consistent_form(df, id_col, text_col).select(id_col, F.translate("form", WHITE, "").alias("form"))


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of ids (a < b) of one class or of linked classes."""
    several = members.where("id <> class_id").select("class_id").distinct()
    both = links.select("class_a", "class_b").unionByName(several.select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b")))
    return member_pairs(both, members)


def groups(members: DataFrame, links: DataFrame, rounds: int = 50) -> DataFrame:
    """One row an id: ``class_id`` and ``group_id``, the least class of its connected component.

    Components come from rounds of large-star and small-star steps over the links as tables; each round is
    written, and the rounds end when a round changes nothing; if that takes more than ``rounds``, an error is raised.
    """
    edges = links.select(F.col("class_a").alias("u"), F.col("class_b").alias("v"))
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = written(small, "stars")
        sums = [d.agg(F.count("*"), F.sum(F.xxhash64(F.greatest("u", "v"), F.least("u", "v")).cast("decimal(38,0)"))).first() for d in (edges, new)]
        edges = new
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError(f"the components aren't final after {rounds} rounds")
    top = edges.select(F.greatest("u", "v").alias("class_id"), F.least("u", "v").alias("g")).groupBy("class_id").agg(F.min("g").alias("group_id"))
    return members.join(top, "class_id", "left").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))
