"""Queries of the numbered problems that are tagged llm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import neardup, packing, similar, splitting, subjects, tokens, unify


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    v = similar.current_vectors(table(spark, d, "metadata"), table(spark, d, "embedding_cache"))
    return similar.similar_pairs(similar.similar_vectors(v, k=10, least=0.85, probes=3), 0.85)


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar of every hundredth vector, through every shard."""
    v = similar.current_vectors(table(spark, d, "metadata"), table(spark, d, "embedding_cache"))
    found = similar.similar_vectors(v, k=10, probes=None, queries=v.where("vector_id % 100 = 0"))
    return found.select("query_id", "vector_id", F.round("cosine", 4).alias("cosine"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    form = neardup.squashed(table(spark, d, "all_chunks"), "chunk_no", "content")
    return neardup.all_pairs(*neardup.near_duplicates(form, "chunk_no", "form")).toDF("chunk_a", "chunk_b")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    form = neardup.squashed(table(spark, d, "all_chunks"), "chunk_no", "content")
    return neardup.groups(*neardup.near_duplicates(form, "chunk_no", "form")).withColumnRenamed("id", "chunk_no")


def _chunk_pieces(spark: SparkSession, d: str, long_only: bool = False) -> DataFrame:
    chunks = table(spark, d, "all_chunks").select("chunk_no", "content", "meta.page_start", "meta.page_end")
    if long_only:
        chunks = chunks.where(F.length("content") > 1000)
    return splitting.split_oversized(chunks, "chunk_no", "content", "page_start", "page_end")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_pieces(spark, d, long_only=True).groupBy("chunk_no").agg(F.max("forced").cast("int").alias("forced"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_pieces(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.same_reading_pairs(table(spark, d, "all_chunks"), "chunk_no", "content").toDF("chunk_a", "chunk_b")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """One form for every content of all_chunks, metadata and parsed, under one vocabulary.

    ``block_no`` counts the blocks of a report from 1; rows of the other tables have 0.
    """
    chunks, items = table(spark, d, "all_chunks"), table(spark, d, "metadata")
    blocks = table(spark, d, "parsed").select("report_no", F.posexplode("blocks").alias("k", "b"))

    def under(name: str, key: str, block_no: Column) -> Column:
        return F.struct(F.lit(name).alias("table"), F.col(key).cast("long").alias("key"), block_no.cast("long").alias("block_no")).alias("id")

    every = chunks.select(under("all_chunks", "chunk_no", F.lit(0)), "content")
    every = every.unionByName(items.select(under("metadata", "vector_id", F.lit(0)), "content"))
    every = every.unionByName(blocks.select(under("parsed", "report_no", F.col("k") + 1), F.col("b.content").alias("content")))
    return unify.consistent_form(every, "id", "content").select("id.table", "id.key", "id.block_no", "form")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p6_words(spark: SparkSession, d: str) -> DataFrame:
    return tokens.word_round_trip(table(spark, d, "documents"), "doc_id", "text")


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document comes back from its ids."""
    return tokens.text_round_trip(table(spark, d, "documents"), "doc_id", "text")


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text", counts=True)
    return packing.pack(sizes, table(spark, d, "token_windows"))


def _shares(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = subjects.train_subjects(documents, table(spark, d, "subject_labels"))
    if model is None:
        return spark.createDataFrame([], "doc_id long, subject_code string, sentences int, of int")
    return subjects.subject_shares(documents, model)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_subjects(spark, d).where("posterior >= 0.5").select("doc_id", "subject_code")


def p8_subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.calibrated(subjects.written(_shares(spark, d), "shares"), table(spark, d, "subject_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_nearest, p2_found, p2_groups, p3_found, p3_pieces, p5_found, p5_forms, p6_ids, p6_words, p6_texts, p7_windows, p8_found, p8_subjects)}
_WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
ORACLES: dict[str, str] = {
    "p1_found": """WITH cur AS (SELECT chunk_id, embedding AS e FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC) r FROM embedding_cache) WHERE r = 1),
        good AS (SELECT chunk_id, list_transform(e, lambda v: v::DOUBLE) AS v FROM cur WHERE len(e) = 64 AND len(list_filter(e, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(e, lambda v: v <> 0)) > 0),
        u AS (SELECT m.vector_id::BIGINT AS id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::DOUBLE[64] AS v FROM metadata m JOIN good USING (chunk_id)),
        c AS (SELECT a.id AS a, b.id AS b, array_inner_product(a.v, b.v) AS s FROM u a JOIN u b ON a.id <> b.id),
        k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM c WHERE s >= 0.85) WHERE r <= 10)
        SELECT DISTINCT least(a, b) AS vector_a, greatest(a, b) AS vector_b FROM k""",
    "p3_found": f"""WITH p AS (SELECT chunk_no, string_split(regexp_replace(regexp_replace(content, '\\.({_WS})', '.' || chr(1) || '\\1', 'g'), '([。！？；!?;\\n])', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM all_chunks WHERE length(content) > 1000)
        SELECT chunk_no, (list_max(list_transform(parts, lambda x: length(x))) > 1000)::INT AS forced FROM p""",
}
