"""Page layout to blocks, over rows of words, spans, cells and elements keyed by (doc_id, page).

Pages are small, so that all joins are equi-joins on (doc_id, page) with a condition on the geometry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from .chunking import section_paths

PAGE = ["doc_id", "page"]
# Default font size, tolerances of centres, gaps of lines and blocks, margins.
FONT, CELL_TOLERANCE, LINE_TOLERANCE, LINE_GAP, MERGE_GAP, ROUND = 10.5, 1.5, 2.0, 4.0, 8.0, 3.0
COLLECT_MARGIN, DROP_MARGIN, TOC_PAGES = 80.0, 55.0, 12


def area(x0, y0, x1, y1):
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def overlap(a, b):
    """Area that two boxes share; ``a`` and ``b`` are prefixes of columns."""
    c = lambda p, k: F.col(f"{p}.{k}")
    return area(F.greatest(c(a, "x0"), c(b, "x0")), F.greatest(c(a, "y0"), c(b, "y0")), F.least(c(a, "x1"), c(b, "x1")), F.least(c(a, "y1"), c(b, "y1")))


def centre_inside(a, b, tolerance: float):
    """The centre of box ``a`` lies in box ``b``, borders and tolerance included."""
    x, y = (F.col(f"{a}.x0") + F.col(f"{a}.x1")) / 2, (F.col(f"{a}.y0") + F.col(f"{a}.y1")) / 2
    return x.between(F.col(f"{b}.x0") - tolerance, F.col(f"{b}.x1") + tolerance) & y.between(F.col(f"{b}.y0") - tolerance, F.col(f"{b}.y1") + tolerance)


def font_medians(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Median size of the page's non-blank spans, :data:`FONT` without any."""
    m = spans.where(T.strip(F.coalesce("text", F.lit(""))) != "").groupBy(*PAGE).agg(F.median("size").alias("m"))
    return pages.select(*PAGE).join(m, PAGE, "left").select(*PAGE, F.coalesce("m", F.lit(FONT)).alias("font_median"))


def words_to_text(words: DataFrame, keys: list[str]) -> DataFrame:
    """Text of the words of each key: lines by height, a line's height being the running mean of its words."""
    w = F.struct((F.bround(F.col("y0") / ROUND) * ROUND).alias("r"), "x0", "y0", "text")
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).alias("n"), F.lit(0).alias("line"), F.array().cast("array<struct<line:int,x0:double,text:string>>").alias("out"))

    def step(s, x):
        same = s["y"].isNotNull() & (F.abs(x["y0"] - s["y"]) <= LINE_GAP)
        line = F.when(same, s["line"]).otherwise(s["line"] + 1)
        return F.struct(
            F.when(same, (s["y"] * s["n"] + x["y0"]) / (s["n"] + 1)).otherwise(x["y0"]).alias("y"), F.when(same, s["n"] + 1).otherwise(1).alias("n"), line.alias("line"),
            F.concat(s["out"], F.array(F.struct(line.alias("line"), x["x0"].alias("x0"), x["text"].alias("text")))).alias("out"),
        )

    folded = words.groupBy(*keys).agg(F.array_sort(F.collect_list(w)).alias("ws")).withColumn("p", F.array_sort(F.aggregate("ws", start, step, lambda s: s["out"])))
    lines = F.transform(F.sequence(F.lit(1), F.coalesce(F.array_max(F.transform("p", lambda x: x["line"])), F.lit(1))), lambda i: F.array_join(F.transform(F.filter("p", lambda x: x["line"] == i), lambda x: x["text"]), " "))
    return folded.select(*keys, T.normalize_text(F.array_join(lines, "\n")).alias("text"))


def table_markdown(cells: DataFrame, words: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Each table as Markdown: the first row that isn't blank is the header; bars are escaped; rows are padded.

    ``tables`` has the box of each table (``bbox``). A table without any text in its cells, or without cells,
    is the plain text of the words in its box; without ``tables`` it is left out, as its box isn't known.
    """
    key = [*PAGE, "table_no", "row_no", "col_no"]
    w = words.alias("w").join(cells.where("bbox is not null").alias("c"), [F.col("w.doc_id") == F.col("c.doc_id"), F.col("w.page") == F.col("c.page"), centre_inside("w", "c.bbox", CELL_TOLERANCE)])
    inside = words_to_text(w.select("c.doc_id", "c.page", "c.table_no", "c.row_no", "c.col_no", "w.x0", "w.y0", "w.text"), key)
    full = cells.select(*key).join(inside, key, "left").withColumn("text", F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))
    rows = full.groupBy(*PAGE, "table_no", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda x: x["text"]).alias("cells")).where(F.exists("cells", lambda x: x != ""))
    t = rows.groupBy(*PAGE, "table_no").agg(F.max(F.size("cells")).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"]).alias("rows"))

    def line(r):
        return F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), F.col("n") - F.size(r))), " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n")), " | "), F.lit(" |"))
    lines = F.transform("rows", line)
    t = t.select(*PAGE, "table_no", F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))), "\n").alias("markdown"))
    if tables is None:
        return t
    table = [*PAGE, "table_no"]
    bare = tables.select(*table, "bbox").join(t.select(*table), table, "left_anti")
    on = [F.col("w.doc_id") == F.col("b.doc_id"), F.col("w.page") == F.col("b.page"), centre_inside("w", "b.bbox", CELL_TOLERANCE)]
    own = words_to_text(words.alias("w").join(bare.alias("b"), on).select("b.doc_id", "b.page", "b.table_no", "w.x0", "w.y0", "w.text"), table)
    plain = bare.select(*table).join(own, table, "left").select(*table, F.coalesce("text", F.lit("")).alias("markdown"))
    return t.unionByName(plain)


def toc_runs(pages: DataFrame, key: str = "doc_id", last: int = TOC_PAGES) -> DataFrame:
    """(key, ``first_page``, ``last_page``) of the first unbroken run of contents pages after the cover, of ``page`` 2 to ``last``.

    pages: key, ``page`` from 1 and ``text``; a page without a row breaks a run.
    """
    p = pages.where((F.col("page") >= 2) & (F.col("page") <= last)).where(T.toc_marks(F.col("text"))[2]).select(key, "page").distinct()
    run = F.col("page") - F.row_number().over(W.partitionBy(key).orderBy("page"))
    p = p.withColumn("run", run).withColumn("first", F.min("run").over(W.partitionBy(key))).where("run = first")
    return p.groupBy(key).agg(F.min("page").cast("long").alias("first_page"), F.max("page").cast("long").alias("last_page"))


def repeated_marginals(blocks: DataFrame, pages: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, key) of short texts wholly in the margins of a document's pages, ``least`` times or more."""
    b = blocks.join(pages.select(*PAGE, "height"), PAGE).where((F.col("y1") <= COLLECT_MARGIN) | (F.col("y0") >= F.col("height") - COLLECT_MARGIN))
    b = b.select("doc_id", T.compact_text(F.col("text")).alias("key")).where((F.length("key") >= 1) & (F.length("key") <= 60) & ~T.is_page_number(F.col("key")))
    return b.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def block_styles(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Text and style of each block without the lines whose centre is in a table; all lines without ``tables``."""
    keep = spans if tables is None else spans.alias("s").join(tables.alias("t"), [F.col("s.doc_id") == F.col("t.doc_id"), F.col("s.page") == F.col("t.page"), centre_inside("s.line_bbox", "t.bbox", LINE_TOLERANCE)], "left_anti")
    key = [*PAGE, "block_no"]
    line = keep.groupBy(*key, "line_no").agg(
        T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "")).alias("line"), F.max("size").alias("max_font"), F.sum("size").alias("sum_font"),
        F.sum((F.lower("font").contains("bold") | (F.col("flags").bitwiseAND(16) != 0)).cast("long")).alias("bold"), F.count("*").alias("spans"),
        *[f(F.col(f"line_bbox.{k}")).alias(k) for k, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))],
    )
    return line.groupBy(*key).agg(
        T.normalize_text(F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"] != ""), lambda x: x["line"]), "\n")).alias("text"),
        F.max("max_font").alias("max_font"), (F.sum("sum_font") / F.sum("spans")).alias("avg_font"), F.sum("bold").alias("bold"), F.sum("spans").alias("spans"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def marginal_noise(whole: DataFrame, pages: DataFrame, marginals: DataFrame) -> DataFrame:
    """(doc_id, page, block_no) of blocks wholly in a page's outer margins whose whole text is a page number or a repeated marginal text.

    ``whole`` has the blocks with their lines in tables (:func:`block_styles` without tables).
    """
    b = whole.join(pages.select(*PAGE, "height"), PAGE).where((F.col("y1") <= DROP_MARGIN) | (F.col("y0") >= F.col("height") - DROP_MARGIN))
    b = b.withColumn("key", T.compact_text(F.col("text"))).join(marginals.select("doc_id", "key", F.lit(True).alias("known")), ["doc_id", "key"], "left")
    return b.where(F.col("known").isNotNull() | T.is_page_number(F.col("key"))).select(*PAGE, "block_no")


def classified(blocks: DataFrame, medians: DataFrame, pages: DataFrame, marginals: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Text blocks as titles with their level, or text; page numbers and repeated marginal texts are dropped.

    With ``whole`` (see :func:`marginal_noise`) blocks in the outer margins are judged by their whole text too.
    """
    if whole is not None:
        blocks = blocks.join(marginal_noise(whole, pages, marginals), [*PAGE, "block_no"], "left_anti")
    b = blocks.where("text <> ''").withColumn("key", T.compact_text(F.col("text"))).join(medians, PAGE)
    b = b.join(marginals.select("doc_id", "key"), ["doc_id", "key"], "left_anti").where(~T.is_page_number(F.col("key")))
    flat, n = F.regexp_replace("text", r"\s+", " "), F.length("text")
    level, bold = T.title_level(flat), F.col("bold") / F.greatest(F.col("spans"), F.lit(1))
    closed = flat.rlike(T.END_MARKS)
    numbered = (level >= 2) & (level <= 5) & (n <= 60) & ~closed & ((F.col("max_font") >= F.col("font_median") + 0.8) | (bold >= 0.4) | (n <= 28))
    plain = (level != 1) & ~F.col("text").contains("\n") & n.between(2, 45) & ~closed & ((F.col("max_font") >= F.col("font_median") + 1.2) | (bold >= 0.5)) & ~flat.rlike(r"\d{4}年\d{1,2}月\d{1,2}日")
    title = ((level == 1) & (n <= 80)) | numbered | plain
    return b.select(*PAGE, "block_no", F.when(title, "title").otherwise("text").alias("kind"), F.when(title, level).alias("level"), "text", "x0", "y0", "x1", "y1")


def reading_order(elements: DataFrame) -> DataFrame:
    """``place`` of each element on its page: from top to bottom, left to right, text before tables on ties."""
    order = W.partitionBy(*PAGE).orderBy("y0", "x0", (F.col("kind") == "table").cast("int"), "seq")
    return elements.withColumn("place", F.row_number().over(order))


def merged_text(elements: DataFrame, gap: float = MERGE_GAP) -> DataFrame:
    """Neighbouring text elements that are at most ``gap`` apart as one; titles and tables stay."""
    order = W.partitionBy(*PAGE).orderBy("place")
    near = F.col("y0") - F.lag("y1").over(order)
    on = (F.col("kind") == "text") & (F.lag("kind").over(order) == "text") & (near >= 0) & (near <= gap)
    e = elements.withColumn("new", (~F.coalesce(on, F.lit(False))).cast("int")).withColumn("island", F.sum("new").over(order))
    return e.groupBy(*PAGE, "island").agg(
        F.min_by("kind", "place").alias("kind"), F.min_by("level", "place").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def document_meta(files: DataFrame, pages: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """(doc_id, ``doc_meta``): company by the file name, year by the file name or the first three pages, code by these pages or the company.

    files: doc_id, ``filename``, ``source_path``. companies: ``company_name``, ``stock_code``; of a name given
    more than once the greatest code counts. What isn't found is empty.
    """
    empty = F.lit("")
    first = pages.where(F.col("page") <= 3).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", empty).alias("text")))).alias("p"))
    first = first.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("probe"))
    rows = files.select("doc_id", F.coalesce("filename", empty).alias("filename"), "source_path").join(first, "doc_id", "left").withColumn("probe", F.coalesce("probe", empty))
    found = lambda c: F.nullif(c, empty)
    rows = rows.withColumn("company_name", T.company_from_filename(F.col("filename"))).withColumn("code", found(F.regexp_extract("probe", T.unicode_pattern(T.STOCK_CODE), 1)))
    year = F.coalesce(found(F.regexp_extract("filename", T.YEAR, 0)), F.regexp_extract("probe", T.YEAR, 0))
    known = F.lit(None).cast("string")
    if companies is not None:
        rows = rows.join(companies.groupBy("company_name").agg(F.max("stock_code").alias("known")), "company_name", "left")
        known = F.col("known")
    meta = F.struct("filename", "company_name", F.coalesce("code", known, empty).alias("stock_code"), year.alias("year"), F.lit("annual_report").alias("report_type"), "source_path")
    return rows.select("doc_id", meta.alias("doc_meta"))


def ordered_blocks(pages: DataFrame, words: DataFrame, spans: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """All steps from layout to blocks: (doc_id, ``block_no`` from 1, ``page``, ``kind``, ``content``, ``section``).

    pages: ``page`` from 1, ``height``, ``text``. The cover and contents pages give no blocks but count for
    repeated marginal texts. Blank contents are dropped. A document without blocks has no rows.
    """
    whole = written(block_styles(spans), "blocks-whole")
    marginals = written(repeated_marginals(whole, pages), "marginals")
    text = classified(block_styles(spans, tables), font_medians(pages, spans), pages, marginals, whole)
    box = [F.col(f"bbox.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")]
    table = table_markdown(cells, words, tables).join(tables, [*PAGE, "table_no"]).where("markdown <> ''")
    table = table.select(*PAGE, F.lit("table").alias("kind"), F.lit(None).cast("int").alias("level"), F.col("markdown").alias("text"), *box, F.col("table_no").alias("seq"))
    body = pages.select(*PAGE).where("page > 1").join(toc_runs(pages), "doc_id", "left").where("first_page is null or page not between first_page and last_page")
    elements = text.withColumnRenamed("block_no", "seq").unionByName(table).join(body, PAGE, "left_semi")
    merged = merged_text(reading_order(elements)).withColumn("content", T.normalize_text(F.col("text"))).where("content <> ''")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "island"))
    merged = written(merged, "elements")
    blocks = merged.select("doc_id", place.cast("long").alias("block_no"), "page", "kind", "level", "content")
    heads = blocks.select(F.col("doc_id").alias("report_no"), "block_no", "kind", "level", F.replace("content", F.lit("\n"), F.lit(" ")).alias("content"))
    paths = section_paths(heads, F.col("level")).select(F.col("report_no").alias("doc_id"), "block_no", F.col("path").alias("section"))
    return blocks.drop("level").join(paths, ["doc_id", "block_no"])


def parsed_reports(files: DataFrame, pages: DataFrame, words: DataFrame, spans: DataFrame, tables: DataFrame, cells: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """One row a file, as the sources read and write parsed reports: doc_id, ``doc_meta``, ``blocks`` (an empty list without any)."""
    metas = written(document_meta(files, pages, companies), "metas")
    blocks = ordered_blocks(pages, words, spans, tables, cells).join(metas, "doc_id")
    own = [F.col(f"doc_meta.{k}").alias(k) for k in ("filename", "company_name", "stock_code", "year")]
    block = F.struct("content", F.struct(F.col("kind").alias("block_type"), F.col("page").cast("int").alias("page"), *own, "section").alias("meta"))
    nested = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", block.alias("b")))).alias("all")).select("doc_id", F.transform("all", lambda x: x["b"]).alias("blocks"))
    count = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    rows = metas.join(count, "doc_id", "left").join(toc_runs(pages), "doc_id", "left").join(nested, "doc_id", "left")
    none = F.array().cast("array<int>")
    toc = F.when(F.col("first_page").isNotNull(), F.sequence(F.col("first_page").cast("int"), F.col("last_page").cast("int"))).otherwise(none)
    meta = F.struct("doc_meta.*", F.coalesce("page_count", F.lit(0)).alias("page_count"), F.struct(F.array(F.lit(1)).alias("cover"), toc.alias("toc")).alias("skipped_pages"))
    return written(rows.select("doc_id", meta.alias("doc_meta"), F.coalesce("blocks", F.array().cast(nested.schema["blocks"].dataType)).alias("blocks")), "parsed")
