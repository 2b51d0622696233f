"""Problem 1: the most similar vectors of every vector.

Equal directions are one class. Classes go to shards around centroids that are fitted on a bounded sample; a
shard above its size has centroids of its own, fitted and applied the same way, so that neither the shards
nor the parts that a query visits grow with the data. In each shard a directed graph is built: greedy
searches propose neighbours, and relaxed distance pruning keeps diverse edges. Beam search then answers every
query that is routed to the shard; the best answers of all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, written

#: Directions, as expected, that the centroids of a level are fitted on; the index itself holds every row.
SAMPLE_ROWS = 40_000
#: Centroids of a level at most.
MOST_CENTROIDS = 4096
#: Rows of a shard that are routed to its centroids together, and copies of a class that are joined together.
ROUTE_ROWS, COPIES = 100_000, 10_000
#: Shards of the second level that a query visits in each one of the first.
SUB_PROBES = 2


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def centroids_of(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means of the sample."""
    rng = np.random.RandomState(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        order = np.argsort(at, kind="stable")
        used, first = np.unique(at[order], return_index=True)
        c = c.copy()
        c[used] = _unit(np.add.reduceat(x[order], first, axis=0)).astype(np.float32)
    return c


def beam_search(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, q: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the ``width`` best vectors that a beam search reaches for each query; -1: none.

    ``edges`` holds the out-neighbours of each vector, padded with -1.
    """
    n, b = len(x), len(q)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    seen[:, starts] = True
    ids = np.full((b, max(width, len(starts))), n, np.int32)
    sims = np.full(ids.shape, -9, np.float32)
    ids[:, : len(starts)] = starts
    sims[:, : len(starts)] = q @ x[starts].T
    todo = ids < n
    edges = np.where(edges < 0, n, edges)
    xs = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])
    live = np.arange(b)
    lines = np.arange(b)
    while len(live):
        key = np.where(todo[live], sims[live], -8)
        at = np.argpartition(-key, min(expand, key.shape[1]) - 1, axis=1)[:, :expand]
        rows = lines[: len(live), None]
        go = key[rows, at] > -8
        todo[live[:, None], at] = False
        front = np.where(go, ids[live[:, None], at], n)
        parts = []
        for j in range(front.shape[1]):
            e = np.where(front[:, j, None] < n, edges[np.minimum(front[:, j], n - 1)], n)
            e = np.where(seen[live[:, None], e], n, e)
            seen[live[:, None], e] = True
            parts.append(e)
        e = np.concatenate(parts, axis=1)
        s = np.matmul(xs[e], q[live][:, :, None])[:, :, 0]
        s[e == n] = -9
        all_ids, all_s = np.concatenate([ids[live], e], 1), np.concatenate([sims[live], s], 1)
        all_todo = np.concatenate([todo[live], e < n], 1)
        k = ids.shape[1]
        top = np.argpartition(-all_s, k - 1, axis=1)[:, :k]
        ids[live], sims[live], todo[live] = all_ids[rows, top], all_s[rows, top], all_todo[rows, top]
        live = live[todo[live].any(1)]
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(sims > -8, ids, -1), sims


def _prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: the nearest candidate stays, and drops those that it is ``alpha`` times nearer to."""
    b, c = cand.shape
    ok = (cand >= 0) & (cand != p[:, None])
    srt = np.sort(np.where(ok, cand, -1), axis=1)
    rows = np.arange(b)
    cand, ok = srt, srt >= 0
    ok[:, 1:] &= srt[:, 1:] != srt[:, :-1]
    v = x[np.maximum(cand, 0)]
    far = np.where(ok, 1 - np.matmul(v, x[p][:, :, None])[:, :, 0], np.inf).astype(np.float32)
    between = 1 - np.matmul(v, v.transpose(0, 2, 1))
    out = np.full((b, degree), -1, np.int32)
    left = far.copy()
    for r in range(degree):
        at = left.argmin(1)
        some = np.isfinite(left[rows, at])
        if not some.any():
            break
        out[some, r] = cand[rows, at][some]
        left[rows, at] = np.inf
        left[(alpha * between[rows, at] <= far) & some[:, None]] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = 16, width: int = 32, alpha: float = 1.2, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(edges, starts) of the pruned graph over unit vectors, built in growing batches of a random order."""
    n = len(x)
    mean = x.mean(0)
    starts = np.array([int((x @ mean).argmax())], np.int32)
    edges = np.full((n, degree), -1, np.int32)
    order = np.random.RandomState(seed).permutation(n).astype(np.int32)
    order = np.concatenate([starts, order[order != starts[0]]])
    done, step = 1, 1
    while done < n:
        batch = order[done : done + step]
        found, _ = beam_search(x, edges, starts, x[batch], width)
        if len(batch) > 1:  # vectors of one batch can be neighbours of each other
            near = x[batch] @ x[batch].T
            np.fill_diagonal(near, -9)
            k = min(8, len(batch) - 1)
            found = np.concatenate([found, batch[np.argpartition(-near, k - 1, axis=1)[:, :k]]], 1)
        edges[batch] = _prune(x, batch, found, degree, alpha)
        back = np.stack([edges[batch].ravel(), np.repeat(batch, degree)], 1)
        back = back[back[:, 0] >= 0]
        back = back[np.argsort(back[:, 0], kind="stable")]
        to, first, count = np.unique(back[:, 0], return_index=True, return_counts=True)
        most = int(min(count.max(), 2 * degree))
        place = np.arange(len(back)) - np.repeat(first, count)
        new = np.full((len(to), most), -1, np.int32)
        keep = place < most
        new[np.repeat(np.arange(len(to)), count)[keep], place[keep]] = back[keep, 1]
        both = np.concatenate([edges[to], new], 1)
        room = (edges[to] >= 0).sum(1) + (new >= 0).sum(1) <= degree
        if room.any():  # they fit without pruning
            packed = -np.sort(-both[room], axis=1)[:, :degree]
            packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = -1
            edges[to[room]] = packed
        if (~room).any():
            edges[to[~room]] = _prune(x, to[~room], both[~room], degree, alpha)
        done += len(batch)
        step = int(min(2 * step, 512, max(1, done // 2)))
    return edges, starts


def current_vectors(items: DataFrame, cache: DataFrame, dim: int = 64) -> DataFrame:
    """``vector_id`` and the unit vector of the record with the highest ``seq`` of its ``chunk_id``.

    If that record's vector is null, of another length, all zero, or holds a null, NaN or infinite number,
    the item has no vector and no row; an older record does not replace it. A null ``chunk_id`` has none.
    """
    last = cache.where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct(F.col("embedding").alias("e")), "seq").alias("r")).select("chunk_id", F.col("r.e").cast("array<double>").alias("e"))
    good = last.where(F.col("e").isNotNull() & (F.size("e") == dim) & ~F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, v: a + v * v))
    unit = good.withColumn("n", norm).where("n > 0").select("chunk_id", F.transform("e", lambda v: F.round(v / F.col("n"), 6).cast("float")).alias("vec"))
    return items.where("chunk_id is not null").select(F.col("vector_id").cast("long").alias("vector_id"), "chunk_id").join(unit, "chunk_id").select("vector_id", "vec")


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(np.float32)


def _nearest(x: np.ndarray, c: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centroids of each vector, the nearest first."""
    near = -(x @ c.T)
    at = np.argpartition(near, count - 1, axis=1)[:, :count] if count < len(c) else np.broadcast_to(np.arange(len(c)), near.shape)
    return np.take_along_axis(at, np.take_along_axis(near, at, 1).argsort(1, kind="stable"), 1).astype(np.int32)


def _subdivided(base: DataFrame, seek: DataFrame, sizes: dict[int, int], shard_rows: int, visits: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows of oversized shards (``shard``, ``rep``, ``vec``) with ``sub``, by centroids of each shard of its own."""
    spark = base.sparkSession
    big = [(s, n, -(-n // ROUTE_ROWS)) for s, n in sizes.items() if n > 2 * shard_rows]
    if not big:
        return base.withColumn("sub", F.lit(0)), seek.withColumn("sub", F.lit(0))
    big = F.broadcast(spark.createDataFrame(big, "shard int, n long, salts int"))  # MOST_CENTROIDS rows at most
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE_ROWS)) / F.col("n"))
    drawn = base.join(big, "shard").where(F.pmod(F.xxhash64("vec", F.lit(11)), F.lit(1 << 20)) < share * (1 << 20)).select("shard", "n", "vec")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c = centroids_of(_matrix(pdf.vec), int(max(1, min(MOST_CENTROIDS, pdf.n.iloc[0] // shard_rows))))
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "no": np.arange(len(c)), "centre": [v.tolist() for v in c]})

    centres = written(drawn.groupBy("shard").applyInPandas(fit, "shard int, no int, centre array<float>"), "centres")
    spread = centres.join(big, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "no", "centre")

    def routed(rows: DataFrame, count: int | None) -> DataFrame:
        def run(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(centres):
                return pd.DataFrame({"shard": [], "sub": [], "rep": [], "vec": []})
            c = _matrix(centres.sort_values("no").centre)
            at = _nearest(_matrix(rows.vec), c, len(c) if count is None else min(count, len(c)))
            k = at.shape[1]
            return pd.DataFrame({"shard": np.repeat(rows["shard"].to_numpy(), k), "sub": at.ravel(), "rep": np.repeat(rows.rep.to_numpy(), k), "vec": np.repeat(rows.vec.to_numpy(), k)})

        salt = F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt")
        over = rows.join(big, "shard").select("shard", salt, "rep", "vec")
        over = over.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(run, "shard int, sub int, rep long, vec array<float>")
        return rows.join(big, "shard", "left_anti").select("shard", F.lit(0).alias("sub"), "rep", "vec").unionByName(over)

    return routed(base, 1), routed(seek, None if visits is None else SUB_PROBES)


def similar_vectors(
    vectors: DataFrame, k: int = 10, least: float = -1.0, probes: int | None = 3, queries: DataFrame | None = None,
    degree: int = 16, width: int = 24, alpha: float = 1.2, shard_rows: int = 2000, query_rows: int = 20_000,
) -> DataFrame:
    """``query_id``, ``vector_id``, ``cosine``: up to ``k`` most similar other vectors of each query vector.

    vectors: ``vector_id`` (unique) and ``vec`` (unit, equal lengths); queries: those ids to answer, or all.
    ``probes``: how many shards a query visits, None for every shard; ``least``: smaller cosines are left out.
    Ties go to the smaller id. No vectors give an empty result.
    """
    spark = vectors.sparkSession
    vectors = written(vectors.select("vector_id", "vec", F.xxhash64("vec").alias("h")), "vectors")
    n = vectors.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    # a direction is drawn with all its copies, wherever they lie
    drawn = vectors.where(F.pmod(F.xxhash64("vec", F.lit(5)), F.lit(1 << 20)) < min(1.0, SAMPLE_ROWS / max(1, n)) * (1 << 20))
    sample = drawn.groupBy("h").agg(F.min("vec").alias("vec")).orderBy("h").select("vec").toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, vector_id long, cosine double")
    cent = centroids_of(_matrix(sample.vec), max(1, min(MOST_CENTROIDS, n // shard_rows)))
    visits = len(cent) if probes is None else min(probes, len(cent))
    shared_cent = spark.sparkContext.broadcast(cent)

    def route(batches):
        for pdf in batches:
            if len(pdf):
                pdf["shards"] = list(_nearest(_matrix(pdf.vec), shared_cent.value, visits))
            else:
                pdf["shards"] = []
            yield pdf

    classes = vectors.groupBy("h", "vec").agg(F.min("vector_id").alias("rep"), F.count("*").alias("copies"))
    classes = classes.select("rep", "copies", "h", "vec").mapInPandas(route, "rep long, copies long, h long, vec array<float>, shards array<int>")
    classes = written(classes, "classes")
    wanted, asked = None, classes
    if queries is not None:
        wanted = queries.select(F.col("vector_id").cast("long").alias("vector_id")).distinct()
        asked = classes.join(vectors.join(wanted, "vector_id").select("h").distinct(), "h", "left_semi")
    base = classes.select(F.col("shards")[0].alias("shard"), "rep", "vec")
    seek = asked.select(F.explode("shards").alias("shard"), "rep", "vec")
    sizes = {r["shard"]: r["count"] for r in classes.groupBy(F.col("shards")[0].alias("shard")).count().collect()}  # MOST_CENTROIDS rows at most
    base, seek = _subdivided(base, seek, sizes, shard_rows, probes)
    if any(m > 2 * shard_rows for m in sizes.values()):
        base, seek = written(base, "base"), written(seek, "seek")
    # a row a part; parts that are still large are split by hash, and their queries in blocks
    many = seek.groupBy("shard", "sub").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
    parts = base.groupBy("shard", "sub").agg(F.ceil(F.count("*") / (4 * shard_rows)).cast("int").alias("subs")).join(many, ["shard", "sub"])
    parts = written(parts, "shards")
    number, tasks = parts.agg(F.count("*"), F.sum(F.col("subs") * F.col("blocks"))).first()
    parts = F.broadcast(parts) if number <= BROADCAST_ROWS else parts
    salt = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    base = base.join(parts, ["shard", "sub"]).select("shard", "sub", (salt % F.col("subs")).cast("int").alias("part"), every("blocks").alias("block"), F.lit(0).alias("role"), "rep", "vec")
    seek = seek.join(parts, ["shard", "sub"]).select("shard", "sub", every("subs").alias("part"), (salt % F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), "rep", "vec")

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.role == 0].sort_values("rep")
        q = pdf[pdf.role == 1]
        out = []
        if len(own) and len(q):
            x, ids = _matrix(own.vec), own.rep.to_numpy()
            edges, starts = build_graph(x, degree, max(width, degree), alpha)
        for i in range(0, len(q) if len(own) else 0, 1024):
            part = q.iloc[i : i + 1024]
            at, sim = beam_search(x, edges, starts, _matrix(part.vec), max(width, k + 1))
            who = part.rep.to_numpy()
            keep = (at >= 0) & (sim >= least - 1e-6) & (ids[np.maximum(at, 0)] != who[:, None])
            keep &= np.cumsum(keep, 1) <= k
            line, col = np.nonzero(keep)
            out.append(pd.DataFrame({"q": who[line], "near": ids[at[line, col]], "cosine": sim[line, col].astype(float)}))
        return pd.concat(out) if out else pd.DataFrame({"q": np.zeros(0, np.int64), "near": np.zeros(0, np.int64), "cosine": np.zeros(0)})

    keys = ["shard", "sub", "part", "block"]
    spread = base.unionByName(seek).repartition(max(1, tasks or 0), *keys)  # about a graph a task, however many there are
    hits = spread.groupBy(*keys).applyInPandas(answer, "q long, near long, cosine double")
    best = W.partitionBy("q").orderBy(F.desc("cosine"), "near")
    hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("q", "near", "cosine")
    hits = written(hits, "hits")

    # members of the classes that have copies; classes of very many copies meet their rows by a broadcast
    several = classes.where("copies > 1").select("rep", "h", "vec", F.ceil(F.col("copies") / COPIES).cast("int").alias("blocks"))
    hot = several.where("blocks > 1")
    rare = several.where("blocks = 1") if hot.count() <= BROADCAST_ROWS else several
    mine = lambda c: vectors.join(c, ["h", "vec"]).select("rep", "vector_id", "blocks")
    owned = written(mine(rare) if rare is several else mine(rare).unionByName(mine(F.broadcast(hot))), "owned")
    # of a class only the first k + 1 can be among the k most similar
    first = owned.select("rep", "vector_id", F.row_number().over(W.partitionBy("rep").orderBy("vector_id")).alias("r")).where(F.col("r") <= k + 1).select("rep", "vector_id")
    near = hits.join(first.toDF("near", "other"), "near", "left").select("q", F.coalesce("other", "near").alias("other"), "cosine")
    near = near.unionByName(first.select(F.col("rep").alias("q"), F.col("vector_id").alias("other"), F.lit(1.0).alias("cosine")))
    best = W.partitionBy("q").orderBy(F.desc("cosine"), "other")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "other", "cosine"))).alias("near"))  # k + 1 of a class
    lists = lists.join(several.select(F.col("rep").alias("q"), "blocks"), "q", "left").select("q", "near", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
    single = classes.where("copies = 1").select("rep", F.col("rep").alias("vector_id"), F.lit(1).alias("blocks"))
    ids = owned.unionByName(single)
    if wanted is not None:
        ids = ids.join(wanted, "vector_id", "left_semi")
    ids = ids.select(F.col("rep").alias("q"), F.col("vector_id").alias("query_id"), F.pmod(F.xxhash64("vector_id"), F.col("blocks")).cast("int").alias("block"))
    others = F.slice(F.filter("near", lambda x: x["other"] != F.col("query_id")), 1, k)
    return ids.join(lists, ["q", "block"]).select("query_id", F.explode(others).alias("x")).select("query_id", F.col("x.other").alias("vector_id"), F.col("x.cosine").alias("cosine"))


def similar_pairs(found: DataFrame, least: float) -> DataFrame:
    """``vector_a < vector_b`` of the answers with a cosine of ``least`` or more."""
    return found.where(F.col("cosine") >= least).select(F.least("query_id", "vector_id").alias("vector_a"), F.greatest("query_id", "vector_id").alias("vector_b")).distinct()
