"""Incremental embedding: new chunk files are embedded as they arrive. An addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.providers import Embedder, embed, offline_embedder
from ..session import written
from ..sources.reports import append_cache, append_failed, load_chunks, read_cache, read_failed


def open_failures(spark: SparkSession, cache: str, failed: str) -> DataFrame:
    """Failed chunks that the cache still lacks, once each; without a chunk_id no reader of the cache would find one."""
    rows = read_failed(spark, failed).where("chunk_id is not null").dropDuplicates(["chunk_id"])
    return rows.join(read_cache(spark, cache).select("chunk_id"), "chunk_id", "left_anti").select("seq", "chunk_id", "content")


def embed_stream(chunks: DataFrame, cache: str, checkpoint: str, embedder: Embedder = offline_embedder, failed: str | None = None) -> StreamingQuery:
    """Embeds chunks that the cache lacks and appends them; a batch that runs again finds its records there.

    Chunks that fail are recorded once in ``failed`` (``<cache>-failed`` if not given), with their first error,
    and tried again at the start of every run and in every later batch until the cache has them. They keep the
    ``seq`` of their first try, which no other record has.
    """
    failed = failed or f"{cache.rstrip('/')}-failed"

    def attempt(rows: DataFrame) -> None:
        tried = rows.select("seq", "chunk_id", "content", "again", embed(F.col("content"), embedder).alias("e"))
        tried = written(tried, "embedded")  # the embedder is asked once for both tables
        append_failed(tried.where("e.error is not null and not again").select("seq", "chunk_id", "content", "e.error"), failed)
        append_cache(tried.where("e.error is null").select("seq", "chunk_id", "e.embedding"), cache)

    def retries(spark: SparkSession) -> DataFrame:
        return open_failures(spark, cache, failed).withColumn("again", F.lit(True))

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        old = retries(spark)
        new = load_chunks(df).dropDuplicates(["chunk_id"]).join(read_cache(spark, cache).select("chunk_id"), "chunk_id", "left_anti").join(old.select("chunk_id"), "chunk_id", "left_anti")
        seq = F.lit(number).cast("long") * (1 << 40) + F.col("chunk_no")
        attempt(new.select(seq.alias("seq"), "chunk_id", "content", F.lit(False).alias("again")).unionByName(old))

    waiting = retries(chunks.sparkSession)
    if not waiting.isEmpty():
        attempt(waiting)
    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
