"""Registered queries of the core: each reads whole tables of the given folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking as C
from .operators import index as I
from .operators import layout as L
from .operators import quantities
from .operators import retrieval as R
from .oracles import ORACLES  # noqa: F401
from .session import table, written


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    amounts = quantities.common_amounts(table(spark, d, "all_chunks"), table(spark, d, "metrics"))
    return amounts.where("amount is not null and not uncertain").select("chunk_no", "metric_code", "amount").distinct()


def p4_units(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each metric were stated, assigned and left uncertain."""
    amounts = quantities.common_amounts(table(spark, d, "all_chunks"), table(spark, d, "metrics"))
    return amounts.groupBy("metric_code").agg(
        F.count("*").alias("stated"), F.sum((F.col("posterior") < 1).cast("long")).alias("assigned"), F.sum(F.col("uncertain").cast("long")).alias("uncertain")
    )


# parsing rules


def normalize_text(spark, d):
    return table(spark, d, "all_chunks").select("chunk_no", T.normalize_text(F.col("content")).alias("text"))


def compact_text(spark, d):
    return table(spark, d, "all_chunks").select("chunk_no", T.compact_text(F.col("content")).alias("text"))


def safe_filename(spark, d):
    return table(spark, d, "parsed").select("report_no", T.safe_filename(F.col("doc_meta.filename")).alias("name"))


def company_from_filename(spark, d):
    return table(spark, d, "parsed").select("report_no", T.company_from_filename(F.coalesce("doc_meta.filename", F.lit(""))).alias("company"))


def doc_meta_fallback(spark, d):
    """Year from the file name, then from the first three pages; code from the first three pages, then by company."""
    p = table(spark, d, "parsed")
    name = F.coalesce("doc_meta.filename", F.lit(""))
    first = F.filter("blocks", lambda b: F.coalesce(b["meta"]["page"], F.lit(0)) <= 3)  # a block without a page may be on the first ones
    probe = F.array_join(F.transform(first, lambda b: F.coalesce(b["content"], F.lit(""))), "\n")
    code = F.regexp_extract(probe, T.unicode_pattern(T.STOCK_CODE), 1)
    rows = p.select(
        "report_no", F.coalesce(F.nullif(F.regexp_extract(name, T.YEAR, 0), F.lit("")), F.regexp_extract(F.coalesce(probe, F.lit("")), T.YEAR, 0)).alias("year"),
        F.nullif(code, F.lit("")).alias("code"), T.company_from_filename(name).alias("company_name"),
    )
    known = table(spark, d, "companies").groupBy("company_name").agg(F.max("stock_code").alias("known"))
    return rows.join(known, "company_name", "left").select("report_no", "company_name", "year", F.coalesce("code", "known", F.lit("")).alias("stock_code"))


def output_name(spark, d):
    """Output names; reports of one name: the last one stays."""
    m = F.col("doc_meta")
    part = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    name = F.concat(F.concat_ws("_", part(m["stock_code"]), part(m["year"]), T.safe_filename(m["company_name"])), F.lit(".json"))
    return table(spark, d, "parsed").select(name.alias("name"), "report_no").groupBy("name").agg(F.max("report_no").alias("report_no"), F.count("*").alias("reports"))


def _pages(spark, d):
    b = C.block_rows(table(spark, d, "parsed"))
    return b.groupBy("report_no", "page").agg(F.array_sort(F.collect_list(F.struct("block_no", "content"))).alias("b")).select("report_no", "page", F.array_join(F.transform("b", lambda x: x["content"]), "\n").alias("text"))


def toc_like(spark, d):
    """Pages that look like a table of contents."""
    sec, dots, toc = T.toc_marks(F.col("text"))
    return _pages(spark, d).select("report_no", "page", sec.cast("long").alias("sections"), dots.cast("long").alias("dotted"), toc.cast("long").alias("toc"))


def toc_detected(spark, d):
    """The first unbroken run of pages 2 to 12 that look like a table of contents, of each report that has one."""
    return L.toc_runs(_pages(spark, d), "report_no")


def toc_pages(spark, d):
    """The first unbroken run of skipped contents pages of each report."""
    p = table(spark, d, "parsed").select("report_no", F.explode("doc_meta.skipped_pages.toc").alias("page")).where("page is not null").distinct()
    run = F.col("page") - F.row_number().over(W.partitionBy("report_no").orderBy("page"))
    first = F.min("run").over(W.partitionBy("report_no"))
    return p.withColumn("run", run).withColumn("first", first).where("run = first").groupBy("report_no").agg(F.min("page").cast("long").alias("first_page"), F.max("page").cast("long").alias("last_page"), F.count("*").alias("pages"))


def marginal_repeats(spark, d):
    """Short texts that a report repeats three times or more."""
    b = C.block_rows(table(spark, d, "parsed")).select("report_no", T.compact_text(F.col("content")).alias("key"))
    return b.where((F.length("key") >= 1) & (F.length("key") <= 60) & ~T.is_page_number(F.col("key"))).groupBy("report_no", "key").agg(F.count("*").alias("n")).where("n >= 3")


def page_number_drop(spark, d):
    b = C.block_rows(table(spark, d, "parsed"))
    return b.groupBy("report_no").agg(F.count("*").alias("blocks"), F.sum((~T.is_page_number(F.col("content"))).cast("long")).alias("kept"))


def title_level(spark, d):
    b = C.block_rows(table(spark, d, "parsed")).where("kind = 'title'")
    return b.select("report_no", "block_no", T.title_level(F.col("content")).alias("level"))


def block_rows(spark, d):
    return C.block_rows(table(spark, d, "parsed"))


def section_path(spark, d):
    return C.section_paths(C.block_rows(table(spark, d, "parsed")))


# chunking


def unit_note(spark, d):
    b = C.block_rows(table(spark, d, "parsed")).where("kind in ('text', 'title')")
    return b.select("report_no", "block_no", T.is_unit_note(F.col("content")).cast("long").alias("unit_note"), T.is_short_title(F.col("content")).cast("long").alias("short_title"))


def absorbable(spark, d):
    """Blocks directly before a table that the table may take as context."""
    b = C.block_rows(table(spark, d, "parsed"))
    order = W.partitionBy("report_no").orderBy("block_no")
    b = b.select("*", *[F.lead(c).over(order).alias(f"n_{c}") for c in ("kind", "section", "page")]).where("n_kind = 'table' and kind <> 'table'")
    ok = C.absorbable(F.col("kind"), F.col("content"), F.col("section") == F.col("n_section"), F.col("n_page") - F.col("page"))
    return b.select("report_no", "block_no", ok.cast("long").alias("absorbable"))


def md_columns(spark, d):
    return table(spark, d, "all_chunks").select("chunk_no", T.markdown_columns(F.col("content")).alias("columns"))


def table_runs(spark, d):
    return C.table_runs(C.block_rows(table(spark, d, "parsed"))).select("report_no", "block_no", "columns", "head", "run")


def doc_chunks(spark, d):
    parsed = table(spark, d, "parsed")
    return C.build_chunks(C.block_rows(parsed), docs=parsed.select("report_no", "doc_meta.stock_code", "doc_meta.company_name", "doc_meta.year"))


def split_long_text(spark, d):
    p = C.split_long_text(F.col("content"), 1000)
    return table(spark, d, "all_chunks").select("chunk_no", F.posexplode(p).alias("k", "part")).select("chunk_no", F.col("k").cast("long").alias("k"), F.length("part").cast("long").alias("n"))


def chunk_pages(spark, d):
    """Pages of each section of a report: least and greatest that is not 0, otherwise 0."""
    b = C.block_rows(table(spark, d, "parsed"))
    page = F.nullif("page", F.lit(0))
    return b.groupBy("report_no", "section").agg(F.coalesce(F.min(page), F.lit(0)).cast("long").alias("page_start"), F.coalesce(F.max(page), F.lit(0)).cast("long").alias("page_end"))


def chunk_ids(spark, d):
    """Ids of the chunks by their report's file, in the order of ``chunk_no``."""
    c = table(spark, d, "all_chunks").select("chunk_no", *[F.coalesce(f"meta.{k}", F.lit("")).alias(k) for k in ("filename", "stock_code", "company_name", "year")])
    seq = F.row_number().over(W.partitionBy("filename").orderBy("chunk_no"))
    return c.withColumn("seq", seq).select("chunk_no", C.chunk_id("stock_code", "company_name", "year", "seq").alias("chunk_id"))


def buffer_ranges(spark, d):
    """Where each text block stands in its report's joined text, two characters between blocks."""
    b = C.block_rows(table(spark, d, "parsed")).where("kind = 'text'").select("report_no", "block_no", F.length(T.normalize_text(F.col("content"))).cast("long").alias("n")).where("n > 0")
    order = W.partitionBy("report_no").orderBy("block_no").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("n") + 2).over(order) - 2
    return b.select("report_no", "block_no", (end - F.col("n")).alias("start"), end.alias("end"))


def text_islands(spark, d):
    """Runs of text blocks of one section."""
    b = C.block_rows(table(spark, d, "parsed"))
    order = W.partitionBy("report_no").orderBy("block_no")
    new = (F.lag("kind").over(order) != "text") | (F.lag("section").over(order) != F.col("section"))
    b = b.withColumn("new", F.coalesce(new, F.lit(True)).cast("long")).where("kind = 'text'")
    b = b.withColumn("island", F.sum("new").over(order))
    return b.groupBy("report_no", "island").agg(F.count("*").alias("blocks"), F.sum(F.length("content")).alias("chars"))


# index


def emb_text(spark, d):
    return table(spark, d, "all_chunks").select("chunk_no", T.strip(F.coalesce("content", F.lit(""))).alias("text")).where("text <> ''")


def cache_last_wins(spark, d):
    r = I.current_records(table(spark, d, "embedding_cache"))
    return r.select("chunk_id", "seq", F.coalesce(F.size("embedding"), F.lit(-1)).cast("long").alias("numbers"))


def emb_pending_anti(spark, d):
    return I.pending(table(spark, d, "all_chunks"), table(spark, d, "embedding_cache"))


def emb_batches(spark, d):
    """Pending chunks in batches of 10: ranked within ranges of ``chunk_no``, with the ranges' counts ahead."""
    p = I.pending(table(spark, d, "all_chunks"), table(spark, d, "embedding_cache")).withColumn("range", F.floor(F.col("chunk_no") / 4096))
    ahead = p.groupBy("range").agg(F.count("*").alias("n"))
    ahead = ahead.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row for 4,096 chunks
    place = F.row_number().over(W.partitionBy("range").orderBy("chunk_no")) - 1 + F.col("ahead")
    return p.join(ahead, "range").select("chunk_no", "chunk_id", F.floor(place / 10).cast("long").alias("batch"))


def index_items(spark, d):
    it = I.index_items(table(spark, d, "metadata"), table(spark, d, "embedding_cache"))
    return it.select("vector_id", "chunk_id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v), 5).alias("vec_sum"))


def emb_missing(spark, d):
    have = I.current_records(table(spark, d, "embedding_cache")).where(I.usable(F.col("embedding"))).select("chunk_id")
    return table(spark, d, "metadata").join(have, "chunk_id", "left_anti").select(F.col("vector_id").cast("long").alias("vector_id"), "chunk_id")


def l2_normalize(spark, d):
    r = I.current_records(table(spark, d, "embedding_cache")).where(I.usable(F.col("embedding")))
    v = I.unit_vector(F.col("embedding"))
    return r.select("chunk_id", F.round(v[0], 6).alias("first"), F.round(F.sqrt(R.dot(v, v)), 6).alias("norm"))


def _one_row(*parts: DataFrame) -> DataFrame:
    """Aggregates of one row each, side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def index_config(spark, d):
    cache, meta = table(spark, d, "embedding_cache"), table(spark, d, "metadata")
    cur = I.current_records(cache).agg(F.sum(I.usable(F.col("embedding")).cast("long")).alias("usable"), F.count("*").alias("cached"))
    chunks = table(spark, d, "all_chunks").agg(F.count("*").alias("input"))
    items = I.index_items(meta, cache).agg(F.count("*").alias("indexed"), F.max(F.size("vec")).cast("long").alias("dimension"))
    failed = table(spark, d, "failed").agg(F.countDistinct("chunk_id").alias("failed"))
    return _one_row(chunks, cur, items, failed)


def index_integrity(spark, d):
    m = table(spark, d, "metadata")
    return m.agg(F.count("*").alias("items"), F.countDistinct("vector_id").alias("ids"), (F.max("vector_id") + 1).cast("long").alias("expected"))


def health_counts(spark, d):
    m = table(spark, d, "metadata").agg(F.count("*").alias("items"))
    return _one_row(m, table(spark, d, "questions").agg(F.count("*").alias("questions")))


def companies(spark, d):
    return I.companies(table(spark, d, "metadata"))


def failures(spark, d):
    return table(spark, d, "failed").groupBy(F.regexp_replace(F.coalesce("error", F.lit("unknown")), r"\d+", "#").alias("error")).agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("chunks"))


# questions


def _q(spark, d):
    return table(spark, d, "questions").withColumn("question", F.coalesce("question", F.lit("")))


def _items(spark, d):
    """Texts and vectors of the indexed items."""
    return I.split_items(table(spark, d, "metadata"), table(spark, d, "embedding_cache"))


def year_extract(spark, d):
    return _q(spark, d).select("question_id", F.array_join(T.years_in(F.col("question")), ",").alias("years"))


def years_normalize(spark, d):
    y = F.array_sort(F.array_distinct(F.filter(F.transform("years", T.strip), lambda x: x != "")))
    return table(spark, d, "questions").select("question_id", F.nullif(F.array_join(y, ","), F.lit("")).alias("years"))


def infer_company(spark, d):
    f = R.inferred_filters(_q(spark, d), _items(spark, d)[0])
    return f.select("question_id", "code", "company")


def _filters(spark, d, items):
    return written(R.resolved_filters(_q(spark, d), items), "filters")


def resolve_filters(spark, d):
    f = _filters(spark, d, _items(spark, d)[0])
    return f.select("question_id", "code", "year", F.array_join("years", ",").alias("years"))


def allowed_ids(spark, d):
    it = _items(spark, d)[0]
    filters = _filters(spark, d, it)
    f = R.signatures(filters).select("question_id", "sig")
    n = R.eligible(filters, it).groupBy("sig").agg(F.count("*").alias("n"))
    return f.join(n, "sig", "left").select("question_id", F.coalesce("n", F.lit(0)).alias("n"))


def tokens(spark, d):
    t = table(spark, d, "all_chunks").select(F.explode(T.bigrams(F.col("content"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"))


def _stages(spark, d):
    q, (it, vectors) = _q(spark, d), _items(spark, d)
    f = _filters(spark, d, it)
    kw = written(R.keyword_hits(q, f, it), "keyword")
    return q, it, vectors, f, kw


def _vectors(q, vectors, f, kw):
    """The offline embedder: a question has the vector of its best keyword hit."""
    best = kw.where("bm25_rank = 1").select("question_id", "vector_id")
    own = best.join(R.rows_of(vectors.select("vector_id", "embedding"), best), "vector_id").select("question_id", I.unit_vector(F.col("embedding")).alias("qvec"))
    return R.vector_hits(own, f, vectors, q)


def bm25_topk(spark, d):
    return _stages(spark, d)[4]


def vector_topk(spark, d):
    q, _, vectors, f, kw = _stages(spark, d)
    return _vectors(q, vectors, f, kw)


def rrf_fusion(spark, d):
    q, _, vectors, f, kw = _stages(spark, d)
    return R.fused(_vectors(q, vectors, f, kw), kw, q).select("question_id", "vector_id", "rrf_score", "rrf_rank", "sources")


def _ranked(spark, d):
    q, it, vectors, f, kw = _stages(spark, d)
    best = R.fused(_vectors(q, vectors, f, kw), kw, q).where("candidate")  # before the costlier scorer
    return q, it, written(R.reranked(best, q, it), "ranked")


def rerank_threshold(spark, d):
    return _ranked(spark, d)[2]


def rerank_document(spark, d):
    m = table(spark, d, "metadata").select("vector_id", "content", "meta.company_name", "meta.stock_code", "meta.year", "meta.section", "meta.page_start", "meta.page_end")
    return m.select(F.col("vector_id").cast("long").alias("vector_id"), R.document_text().alias("text"))


def references(spark, d):
    """The items cited for each question, with the characters they use of the context."""
    q, it, ranked = _ranked(spark, d)
    return R.cited_items(ranked, it, q).select("question_id", F.col("rerank_rank").alias("ref_id"), "vector_id", "chunk_id", "rerank_score", F.col("used").cast("long").alias("used"))


def hybrid_answer(spark, d):
    """End to end: the context of each question, or the fixed sentence where nothing was found."""
    q, it, ranked = _ranked(spark, d)
    c = R.context_items(ranked, it, q).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rerank_rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"), F.count("*").alias("cited"))
    none = F.lit("根据已检索到的资料，无法回答该问题。")
    return q.select("question_id").join(c, "question_id", "left").select("question_id", F.coalesce("cited", F.lit(0)).alias("cited"), F.md5(F.coalesce("context", none)).alias("context_md5"))


def answer_usage(spark, d):
    """How many items each stage had for each question, and the length of its context."""
    q, it, vectors, f, kw = _stages(spark, d)
    return R.answer_stages(q, f, it, written(_vectors(q, vectors, f, kw), "vector"), kw)["usage"]


def no_evidence(spark, d):
    q, _, ranked = _ranked(spark, d)
    return q.select("question_id").join(ranked.select("question_id").distinct(), "question_id", "left_anti")


def debug_preview(spark, d):
    m = table(spark, d, "metadata")
    return m.select(F.col("vector_id").cast("long").alias("vector_id"), T.page_label(F.col("meta.page_start"), F.col("meta.page_end")).alias("pages"), F.substring("content", 1, 200).alias("preview"))


def ui_candidate(spark, d):
    """Re-ranked items with the previews that each question asks for."""
    q, it, ranked = _ranked(spark, d)
    c = ranked.join(R.rows_of(it.select("vector_id", "chunk_id", "content"), ranked), "vector_id").join(q.select("question_id", "include_content"), "question_id")
    c = R.with_settings(c, q, "content_preview_chars")
    return c.select("question_id", "vector_id", F.format_string("%.4f", "rerank_score").alias("score"), F.expr("substring(content, 1, content_preview_chars)").alias("preview"), F.when(F.col("include_content"), F.length("content")).cast("long").alias("full_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        p4_found, p4_units, normalize_text, compact_text, safe_filename, company_from_filename, doc_meta_fallback, output_name, toc_like, toc_detected, toc_pages,
        marginal_repeats, page_number_drop, title_level, block_rows, section_path, unit_note, absorbable, md_columns, table_runs, doc_chunks, split_long_text,
        chunk_pages, chunk_ids, buffer_ranges, text_islands, emb_text, cache_last_wins, emb_pending_anti, emb_batches, index_items, emb_missing, l2_normalize,
        index_config, index_integrity, health_counts, companies, failures, year_extract, years_normalize, infer_company, resolve_filters, allowed_ids, tokens,
        bm25_topk, vector_topk, rrf_fusion, rerank_threshold, rerank_document, references, hybrid_answer, answer_usage, no_evidence, debug_preview, ui_candidate,
    )
}
