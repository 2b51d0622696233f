"""The embedding cache and the index over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import BROADCAST_ROWS, written

DIM = 64


def current_records(cache: DataFrame) -> DataFrame:
    """The record with the highest ``seq`` of each chunk; records without a chunk_id are skipped."""
    last = cache.where("chunk_id is not null and chunk_id <> ''").groupBy("chunk_id").agg(F.max_by(F.struct("seq", "embedding"), "seq").alias("r"))
    return last.select("chunk_id", "r.seq", "r.embedding")


def usable(vector, dim: int = DIM):
    """Of the right length, with finite numbers, not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def unit_vector(vector):
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x / n))[0]  # the norm once, not for each number


def pending(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with content that the cache has no record of, once each, in the order of ``chunk_no``."""
    text = chunks.where(T.strip(F.coalesce("content", F.lit(""))) != "")
    first = text.groupBy("chunk_id").agg(F.min("chunk_no").alias("chunk_no"))
    return first.join(cache.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_no", "chunk_id")


def index_items(metadata: DataFrame, cache: DataFrame) -> DataFrame:
    """Indexed items with their unit vectors and filter fields."""
    good = current_records(cache).where(usable(F.col("embedding"))).select("chunk_id", unit_vector(F.col("embedding")).alias("vec"))
    m = metadata.select(F.col("vector_id").cast("long").alias("vector_id"), "chunk_id", "content", "meta.company_name", "meta.stock_code", "meta.year", "meta.section", "meta.page_start", "meta.page_end")
    return m.join(good, "chunk_id")


def split_items(metadata: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`index_items` as (texts and filter fields, filter fields and ``embedding`` as it was given).

    Only ids and vectors move: the texts are read where they are, without the chunks that have no vector.
    """
    good = current_records(cache).where(usable(F.col("embedding"))).select("chunk_id", "embedding")
    m = metadata.where("chunk_id is not null").select(F.col("vector_id").cast("long").alias("vector_id"), "chunk_id", "meta.stock_code", "meta.year")
    both = written(m.join(good, "chunk_id", "left"), "vectors")
    vectors = both.where("embedding is not null").select("vector_id", "chunk_id", "stock_code", "year", "embedding")
    missing = both.where("embedding is null").select("chunk_id").distinct()
    rows = metadata.where("chunk_id is not null")
    if missing.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(missing), "chunk_id", "left_anti")
    else:
        rows = rows.join(vectors.select("chunk_id").distinct(), "chunk_id", "left_semi")
    fields = ("company_name", "stock_code", "year", "section", "page_start", "page_end")
    return rows.select(F.col("vector_id").cast("long").alias("vector_id"), "chunk_id", "content", *[f"meta.{f}" for f in fields]), vectors


#: Chunks whose numbers are ranked together.
RANGE = 1 << 16


def dense_items(chunks: DataFrame, cache: DataFrame, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """(items, missing): the chunks with a usable vector, ``vector_id`` dense from 0 in the order of ``chunk_no``, and the others.

    Chunks without content are neither. Ranks are taken within ranges of ``chunk_no`` (unique), with the
    ranges' counts ahead, so that no task orders all chunks.
    """
    text = chunks.where(T.strip(F.coalesce("content", F.lit(""))) != "")
    good = current_records(cache).where(usable(F.col("embedding"), dim)).select("chunk_id", unit_vector(F.col("embedding")).alias("vec"))
    rows = text.join(good, "chunk_id").withColumn("range", F.floor(F.col("chunk_no") / RANGE))
    ahead = rows.groupBy("range").agg(F.count("*").alias("n"))
    ahead = ahead.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row a range
    rank = F.row_number().over(W.partitionBy("range").orderBy("chunk_no")) - 1 + F.col("ahead")
    items = rows.join(ahead, "range").select(rank.cast("long").alias("vector_id"), "chunk_id", "content", "meta", "vec")
    return items, text.join(good.select("chunk_id"), "chunk_id", "left_anti").select("chunk_no", "chunk_id")


def companies(metadata: DataFrame) -> DataFrame:
    """Companies of the index with their years, in order."""
    name, code = T.strip(F.coalesce("meta.company_name", F.lit(""))), T.strip(F.coalesce("meta.stock_code", F.lit("")))
    rows = metadata.select(name.alias("company_name"), code.alias("stock_code"), F.nullif(T.strip(F.coalesce("meta.year", F.lit(""))), F.lit("")).alias("year"))
    rows = rows.where("company_name <> '' or stock_code <> ''")
    return rows.groupBy("company_name", "stock_code").agg(F.array_join(F.sort_array(F.collect_set("year")), ",").alias("years"), F.count("*").alias("items"))
