"""Sources and sinks: report files, parsed JSON, chunks, the embedding cache and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as I

META = "block_type string, page int, filename string, company_name string, stock_code string, year string, section string"
PARSED = (
    "doc_meta struct<filename string, company_name string, stock_code string, year string, report_type string, source_path string, page_count int, skipped_pages struct<cover array<int>, toc array<int>>>, "
    f"blocks array<struct<content string, meta struct<{META}>>>"
)


def report_files(spark: SparkSession, folder: str, limit: int = 0) -> DataFrame:
    """The PDF files of a folder, by path; 0: no limit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).dropDuplicates(["path"])
    return files.orderBy("path").limit(limit) if limit else files


def read_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed reports of a folder of JSON files, with their file name."""
    return spark.read.schema(PARSED).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_parsed_in_order(spark: SparkSession, folder: str, limit: int = 0) -> DataFrame:
    """Parsed reports by the path of their file; 0: no limit."""
    rows = read_parsed(spark, folder)
    return rows.orderBy("file").limit(limit) if limit else rows


def _named(meta: str, otherwise) -> Column:
    part = lambda k: F.coalesce(F.nullif(F.col(f"{meta}.{k}"), F.lit("")), F.lit("unknown"))
    company = T.safe_filename(F.coalesce(F.nullif(F.col(f"{meta}.company_name"), F.lit("")), otherwise))
    return F.concat_ws("_", part("stock_code"), part("year"), company)


def parsed_names(parsed: DataFrame) -> Column:
    """The output name of each parsed report."""
    return F.concat(_named("doc_meta", F.lit("unknown")), F.lit(".json"))


def chunk_names(file: str = "file") -> Column:
    """The output name of a report's chunks; a report without a company takes the stem of its file."""
    return F.concat(_named("doc_meta", F.regexp_replace(F.col(file), r"\.[^.]*$", "")), F.lit("_chunks.json"))


def write_parsed(parsed: DataFrame, folder: str) -> None:
    """Reports under their output names, a partition of each code and year; of one name the last ``report_no`` stays, or without that column the last ``file``."""
    order = "report_no" if "report_no" in parsed.columns else "file"
    rows = parsed.withColumn("name", parsed_names(parsed))
    rows = rows.join(rows.groupBy("name").agg(F.max(order).alias(order)), ["name", order])
    rows.withColumn("stock_code", F.coalesce("doc_meta.stock_code", F.lit(""))).withColumn("year", F.coalesce("doc_meta.year", F.lit(""))).write.mode("overwrite").partitionBy("stock_code", "year").parquet(folder)


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """All chunks of all reports as one table; ``chunks`` may hold the reports' ``name``."""
    chunks.write.mode("overwrite").parquet(folder)


def load_chunks(chunks: DataFrame, limit: int = 0) -> DataFrame:
    """The first ``limit`` chunks (0: all), then without blank ones, in that order."""
    rows = chunks.orderBy("chunk_no").limit(limit) if limit else chunks
    return rows.where(T.strip(F.coalesce("content", F.lit(""))) != "")


def _appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows appended to a folder; a missing one is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache; a missing one is empty."""
    return _appended(spark, path, "seq long, chunk_id string, embedding array<float>")


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    """Chunks whose embedding failed, with their text for another try; a missing table is empty."""
    return _appended(spark, path, "seq long, chunk_id string, content string, error string")


def append_cache(records: DataFrame, path: str) -> None:
    records.select("seq", "chunk_id", "embedding").write.mode("append").parquet(path)


def append_failed(records: DataFrame, path: str) -> None:
    records.select("seq", "chunk_id", "content", "error").write.mode("append").parquet(path)


def write_index(chunks: DataFrame, cache: DataFrame, path: str, dim: int | None = None) -> DataFrame:
    """Writes the items of the chunks that the cache has (:func:`load_index` reads them) and the index's config; the missing chunks.

    ``vector_id`` is dense from 0 in the order of ``chunk_no``. Raises if no chunk has a vector.
    """
    items, missing = I.dense_items(chunks, cache, **({"dim": dim} if dim else {}))
    items.write.mode("overwrite").parquet(path)
    spark = chunks.sparkSession
    n, size = spark.read.parquet(path).agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        raise ValueError("no chunk has a vector")
    config = chunks.agg(F.count("*").alias("chunk_count_input")).select(
        F.lit("chunk.content").alias("embedding_text"), F.lit(True).alias("normalize_l2"), F.lit(size).alias("dimension"), "chunk_count_input",
        F.lit(n).alias("chunk_count_indexed"), (F.col("chunk_count_input") - n).alias("missing_count"), F.date_trunc("second", F.current_timestamp()).alias("created_at"),
    )
    config.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}-config")
    return missing


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Index items; raises if ids aren't dense from 0 or a vector is missing."""
    items = spark.read.parquet(path)
    n, ids, vectors, top = items.agg(F.count("*"), F.countDistinct("vector_id"), F.count("vec"), F.max("vector_id")).first()
    if n and not n == ids == vectors == top + 1:
        raise ValueError(f"{n} items, {ids} ids, {vectors} vectors, last id {top}")
    return items
