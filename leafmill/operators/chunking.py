"""Ordered blocks of a report to chunks: islands of text, tables with their context, tables that run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def block_rows(parsed: DataFrame) -> DataFrame:
    """One row a block with its place in the report; a null or empty list has none."""
    b = parsed.select("report_no", F.posexplode("blocks").alias("k", "b"))
    empty = F.lit("")
    return b.select(
        "report_no", (F.col("k") + 1).cast("long").alias("block_no"), F.coalesce("b.content", empty).alias("content"), F.lower(F.coalesce("b.meta.block_type", empty)).alias("kind"),
        F.coalesce("b.meta.page", F.lit(0)).cast("long").alias("page"), F.coalesce("b.meta.section", empty).alias("section"),
        F.coalesce("b.meta.stock_code", empty).alias("stock_code"), F.coalesce("b.meta.company_name", empty).alias("company_name"), F.coalesce("b.meta.year", empty).alias("year"),
    )


def section_paths(blocks: DataFrame, level: Column | None = None) -> DataFrame:
    """The headings that are open at each block, joined by `` > ``.

    A heading closes those of its level and below. Level L is open where its last heading is later than the
    last heading of every higher level. ``level`` is a title's own level, where it is known; otherwise its text tells.
    """
    order = W.partitionBy("report_no").orderBy("block_no").rowsBetween(W.unboundedPreceding, 0)
    told = T.title_level(F.col("content"))
    level = F.when(F.col("kind") == "title", told if level is None else F.coalesce(level, told))
    b = blocks.withColumn("level", level)
    for k in range(1, 7):
        here = F.when(F.col("level") == k, F.struct("block_no", "content"))
        b = b.withColumn(f"t{k}", F.last(here, ignorenulls=True).over(order))
    parts = []
    for k in range(1, 7):
        above = [F.coalesce(F.col(f"t{j}.block_no"), F.lit(0)) for j in range(1, k)]
        top = F.greatest(F.lit(0), F.lit(0), *above)
        parts.append(F.when(F.col(f"t{k}.block_no") > top, F.col(f"t{k}.content")))
    return b.select("report_no", "block_no", F.concat_ws(" > ", *parts).alias("path"))


def table_runs(blocks: DataFrame) -> DataFrame:
    """Tables with the run they belong to: a table runs on if the one before is in its section, on the page before, with as many columns."""
    order = W.partitionBy("report_no").orderBy("block_no")
    b = blocks.withColumn("columns", T.markdown_columns(F.col("content")))
    prev = [F.lag(c).over(order).alias(f"p_{c}") for c in ("kind", "section", "page", "columns")]
    b = b.select("*", *prev)
    on = (F.col("kind") == "table") & (F.col("p_kind") == "table") & (F.col("section") == F.col("p_section")) & (F.col("page") == F.col("p_page") + 1) & (F.col("columns") == F.col("p_columns")) & (F.col("columns") > 0)
    b = b.where("kind = 'table'").withColumn("head", F.coalesce(~on, F.lit(True)).cast("long"))
    return b.withColumn("run", F.sum("head").over(order)).select("report_no", "block_no", "section", "page", "columns", "head", "run")


def absorbable(candidate_kind, candidate_text, same_section, page_gap):
    """A title or unit note close before a table that belongs to the table."""
    near = same_section & (F.abs(page_gap) <= 1) & (T.normalize_text(candidate_text) != "")
    return near & (((candidate_kind == "title") & T.is_short_title(candidate_text)) | ((candidate_kind == "text") & T.is_unit_note(candidate_text)))


def build_chunks(blocks: DataFrame, limit: int = 1000, docs: DataFrame | None = None) -> DataFrame:
    """Chunks of each report in order: ``report_no``, ``chunk_seq``, ``chunk_type``, ``chunk_id``, ``content``, ``page_start``, ``page_end``, ``n_blocks``.

    Titles end a text; a change of section ends it; a table takes up to two blocks before it as context,
    titles always and a unit note while it has not been emitted, and a block of another kind counts as one; tables that run on are one chunk. A text
    longer than ``limit`` is split, each part with the pages of the blocks it overlaps. Blank texts are left out,
    blank tables stay. ``docs`` (``report_no``, ``stock_code``, ``company_name``, ``year``) names the chunks;
    without it, or for a report it lacks, the first block of each chunk does. Windows run within a report.
    """
    order = W.partitionBy("report_no").orderBy("block_no")
    heads = table_runs(blocks).select("report_no", "block_no", "head", "run")
    known = ["title", "text", "table"]  # blocks of other kinds only stand between
    b = blocks.join(heads, ["report_no", "block_no"], "left")
    b = b.select("*", *[F.lead(c, k).over(order).alias(f"{c}_a{k}") for c in ("kind", "section", "page", "head") for k in (1, 2)])
    before = F.last(F.when(F.col("kind").isin(known), F.struct("kind", "section")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    b = b.withColumn("before", before)
    is_head = F.coalesce(F.col("head") == 1, F.lit(False))

    def absorbs(k):  # the table k blocks ahead takes this block
        fits = absorbable(F.col("kind"), F.col("content"), F.col("section") == F.col(f"section_a{k}"), F.col(f"page_a{k}") - F.col("page"))
        ahead = (F.col(f"kind_a{k}") == "table") & (F.col(f"head_a{k}") == 1)
        if k == 1:
            return F.coalesce(ahead & fits, F.lit(False))
        pending = (F.col("kind") == "title") | ((F.col("kind_a1") == "text") & (F.col("section_a1") == F.col("section"))) | ~F.col("kind_a1").isin(known)
        return F.coalesce(ahead & fits & pending, F.lit(False))

    b = b.withColumn("to1", absorbs(1)).withColumn("to2", absorbs(2))
    b = b.withColumn("taken", (F.col("kind") == "text") & (F.col("to1") | F.col("to2")))
    after_text = F.coalesce((F.col("before.kind") == "text") & (F.col("before.section") == F.col("section")), F.lit(False))
    starts = is_head | ((F.col("kind") == "text") & ~after_text)
    b = b.withColumn("island", F.sum(F.coalesce(starts, F.lit(False)).cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    # the island of a head one or two blocks ahead, for its context
    nxt = b.select("*", F.lead("island", 1).over(order).alias("i1"), F.lead("island", 2).over(order).alias("i2"))
    item = F.struct("block_no", F.col("content").alias("content"), "page", "stock_code", "company_name", "year")
    own = nxt.where("kind = 'table' or (kind = 'text' and not taken)").select("report_no", "island", "kind", item.alias("item"))
    context = nxt.select(
        "report_no",
        F.explode(F.array_compact(F.array(F.when(F.col("to1"), F.col("i1")), F.when(F.col("to2"), F.col("i2"))))).alias("island"),
        F.lit("table").alias("kind"), item.alias("item"),
    )
    c = own.unionByName(context).groupBy("report_no", "island").agg(F.max("kind").alias("k"), F.array_sort(F.collect_list("item")).alias("items"))
    said = F.filter(F.transform("items", lambda x: x.withField("content", T.normalize_text(x["content"]))), lambda x: x["content"] != "")
    c = c.withColumn("said", said).withColumn("body", F.array_join(F.transform("said", lambda x: x["content"]), "\n\n"))
    c = c.withColumn("parts", F.when(F.col("k") == "text", split_long_text(F.col("body"), limit)).otherwise(F.array(T.normalize_text(F.col("body")))))
    c = c.withColumn("ranges", block_ranges("said")).select("report_no", "island", "k", "items", "ranges", F.posexplode(located("parts", "body")).alias("part_no", "part"))
    over = F.transform(F.filter("ranges", lambda r: (r["start"] < F.col("part.end")) & (r["end"] > F.col("part.start"))), lambda r: r["item"])
    c = c.withColumn("of", F.when((F.col("k") == "text") & (F.size(over) > 0), over).otherwise(F.col("items")))
    pages = F.filter(F.transform("of", lambda x: x["page"]), lambda p: p != 0)
    first = F.element_at("of", 1)
    c = c.select(
        "report_no", "island", "part_no", F.when(F.col("k") == "table", "table").otherwise("text").alias("chunk_type"), T.normalize_text(F.col("part.text")).alias("content"),
        F.coalesce(F.array_min(pages), F.lit(0)).alias("page_start"), F.coalesce(F.array_max(pages), F.lit(0)).alias("page_end"), F.size("of").cast("long").alias("n_blocks"),
        first["stock_code"].alias("code"), first["company_name"].alias("company"), first["year"].alias("year"),
    ).where("content <> '' or chunk_type = 'table'")
    if docs is not None:
        named = docs.groupBy("report_no").agg(*[F.max(F.coalesce(k, F.lit(""))).alias(f"doc_{k}") for k in ("stock_code", "company_name", "year")], F.lit(True).alias("named"))
        pick = lambda a, b: F.when(F.col("named"), F.col(a)).otherwise(F.col(b)).alias(b)
        c = c.join(named, "report_no", "left").select(*[x for x in c.columns if x not in ("code", "company", "year")], pick("doc_stock_code", "code"), pick("doc_company_name", "company"), pick("doc_year", "year"))
    seq = F.row_number().over(W.partitionBy("report_no").orderBy("island", "part_no"))
    return c.withColumn("chunk_seq", seq.cast("long")).select("report_no", "chunk_seq", "chunk_type", chunk_id("code", "company", "year", "chunk_seq").alias("chunk_id"), "content", "page_start", "page_end", "n_blocks")


def block_ranges(items: str):
    """Where each item stands in the items' contents joined by a blank line."""
    kind = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(s, x):
        end = s["at"] + F.length(x["content"])
        return F.struct((end + 2).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), end.alias("end")))).alias("out"))

    placed = F.aggregate(items, start, step, lambda s: s["out"])
    return F.zip_with(placed, F.col(items), lambda r, x: F.struct(r["start"].alias("start"), r["end"].alias("end"), x.alias("item")))


def located(parts: str, body: str):
    """Each part with its place in the text, looked for from the end of the part before."""
    kind = "array<struct<text:string,start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(s, p):
        found = F.position(p, F.col(body), s["at"] + 1)
        begin = F.when(found > 0, found - 1).otherwise(s["at"])
        end = begin + F.length(p)
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(p.alias("text"), begin.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(parts, start, step, lambda s: s["out"])


def chunk_id(code: str, company: str, year: str, seq: str):
    name = F.coalesce(F.nullif(F.col(code), F.lit("")), T.safe_filename(F.col(company)))
    return F.format_string("%s_%s_%06d", name, F.coalesce(F.nullif(F.col(year), F.lit("")), F.lit("unknown")), F.col(seq).cast("long"))


def split_long_text(c, limit: int = 1000):
    """Parts of at most ``limit`` characters: at blank lines, then sentence ends, then lines, then by length.

    Greedy packing as one fold a pass; parts are stripped and blank ones dropped.
    """

    def pack(pieces, cut):
        def each(t):
            parts = F.split(t, cut, -1)
            start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

            def step(s, p):
                fits = F.length(s["cur"]) + F.length(p) <= limit
                return F.struct(
                    F.when(fits, F.concat(s["cur"], p)).otherwise(p).alias("cur"),
                    F.when(fits | (s["cur"] == ""), s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))).alias("out"),
                )

            folded = F.aggregate(parts, start, step, lambda s: F.concat(s["out"], F.array(s["cur"])))
            return F.when(F.length(t) <= limit, F.array(t)).otherwise(F.filter(F.transform(folded, T.strip), lambda x: x != ""))

        return F.flatten(F.transform(pieces, each))

    pieces = F.array(T.normalize_text(c))
    for cut in (r"(?<=\n\n)", r"(?<=[。；;])", r"(?<=\n)"):
        pieces = pack(pieces, cut)
    sliced = F.transform(pieces, lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(t), F.lit(1)) - 1) / limit).cast("int")), lambda i: T.strip(F.substring(t, i * limit + 1, F.lit(limit)))))
    return F.filter(F.flatten(sliced), lambda x: x != "")
