"""Layout, sources, providers and the stream on small fixtures."""

import pytest
from pyspark.sql import Row

from leafmill.operators import layout as L
from leafmill.operators.providers import embed, offline_embedder
from leafmill.plans.request import Request
from leafmill.sources import reports as S


def _word(x, y, text, w=5.0):
    return Row(doc_id="d", page=1, x0=x, y0=y, x1=x + w, y1=y + 5.0, text=text)


def test_words_and_tables(spark):
    words = spark.createDataFrame([_word(20.0, 10.0, "b"), _word(10.0, 11.0, "a"), _word(10.0, 30.0, "1|2"), _word(60.0, 30.5, "z")])
    assert L.words_to_text(words, ["doc_id", "page"]).first().text == "a b\n1|2 z"
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    cells = spark.createDataFrame([("d", 1, 0, 0, 0, (5.0, 5.0, 40.0, 20.0)), ("d", 1, 0, 0, 1, None), ("d", 1, 0, 1, 0, (5.0, 25.0, 40.0, 40.0)), ("d", 1, 0, 2, 0, (5.0, 80.0, 40.0, 90.0))], f"doc_id string, page long, table_no int, row_no int, col_no int, bbox {box}")
    assert L.table_markdown(cells, words).first().markdown == "| a b |  |\n| --- | --- |\n| 1\\|2 |  |"
    assert L.table_markdown(cells.limit(0), words).count() == 0


def test_tables_without_cell_text_keep_their_words(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    words = spark.createDataFrame([_word(20.0, 10.0, "b"), _word(10.0, 11.0, "a|"), _word(10.0, 30.0, "c"), _word(10.0, 60.0, "d"), _word(200.0, 10.0, "out")])
    cells = [(0, 0, 0, None), (0, 0, 1, None), (1, 0, 0, (5.0, 55.0, 40.0, 70.0)), (3, 0, 0, (300.0, 300.0, 310.0, 310.0))]  # table 2 has no cells
    cells = spark.createDataFrame([("d", 1, *c) for c in cells], f"doc_id string, page long, table_no int, row_no int, col_no int, bbox {box}")
    tables = [(0, (5.0, 5.0, 40.0, 40.0)), (1, (5.0, 55.0, 40.0, 70.0)), (2, (195.0, 5.0, 210.0, 20.0)), (3, (500.0, 500.0, 510.0, 510.0))]
    tables = spark.createDataFrame([("d", 1, *t) for t in tables], f"doc_id string, page long, table_no int, bbox {box}")
    got = {r.table_no: r.markdown for r in L.table_markdown(cells, words, tables).collect()}
    assert got == {0: "a| b\nc", 1: "| d |\n| --- |", 2: "out", 3: ""}


def test_blocks_are_classified(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [("d", 1, k, 0, 0, (0.0, 100.0 + 20 * k, 50.0, 110.0 + 20 * k), t, s, "Song", 0) for k, (t, s) in enumerate([("第一节 概况", 12.0), ("正文内容，说明。", 10.0), ("12", 10.0), ("in table", 10.0), ("", 10.0)])]
    spans = spark.createDataFrame(rows, f"doc_id string, page long, block_no int, line_no int, span_no int, line_bbox {box}, text string, size double, font string, flags int")
    tables = spark.createDataFrame([("d", 1, 0, (0.0, 155.0, 60.0, 175.0))], f"doc_id string, page long, table_no int, bbox {box}")
    pages = spark.createDataFrame([("d", 1, 800.0), ("d", 2, 800.0)], "doc_id string, page long, height double")
    med = L.font_medians(pages, spans)
    assert {r.page: r.font_median for r in med.collect()} == {1: 10.0, 2: 10.5}
    none = spark.createDataFrame([], "doc_id string, key string, n long")
    got = {r.text: (r.kind, r.level) for r in L.classified(L.block_styles(spans, tables), med, pages, none).collect()}
    assert got == {"第一节 概况": ("title", 1), "正文内容，说明。": ("text", None)}


def test_order_and_merging(spark):
    e = [("text", 10.0, 20.0, "a", 1), ("text", 25.0, 30.0, "b", 2), ("table", 25.0, 60.0, "t", 3), ("text", 100.0, 110.0, "c", 4)]
    df = spark.createDataFrame([("d", 1, k, None, 0.0, y0, 9.0, y1, t, s) for k, y0, y1, t, s in e], "doc_id string, page int, kind string, level int, x0 double, y0 double, x1 double, y1 double, text string, seq int")
    got = L.merged_text(L.reading_order(df)).orderBy("island").collect()
    assert [(r.kind, r.text) for r in got] == [("text", "a\nb"), ("table", "t"), ("text", "c")]


def test_marginals(spark):
    pages = spark.createDataFrame([("d", p, 800.0) for p in range(4)], "doc_id string, page int, height double")
    b = spark.createDataFrame([("d", p, 10.0, 20.0, "年度 报告") for p in range(3)] + [("d", p, 300.0, 310.0, "正文") for p in range(4)], "doc_id string, page int, y0 double, y1 double, text string")
    assert [(r.key, r.n) for r in L.repeated_marginals(b, pages).collect()] == [("年度报告", 3)]


def test_providers(spark):
    d = spark.createDataFrame([(1, "abc"), (2, None)], "chunk_no long, content string")
    got = d.select(embed(d.content).alias("e")).collect()
    assert all(len(r.e.embedding) == 64 and r.e.error is None for r in got)

    def broken(texts):
        raise RuntimeError("down")

    assert {r.e.error for r in d.select(embed(d.content, broken, pause=0.0).alias("e")).collect()} == {"down"}
    assert offline_embedder(["ab"]) == offline_embedder(["ab"])


def test_stream_resumes(spark, tmp_path):
    from leafmill.streaming.ingest import embed_stream

    schema, src, cache = "chunk_no long, chunk_id string, content string", f"{tmp_path}/in", f"{tmp_path}/cache"
    for n, rows in enumerate([[(1, "a", "x"), (2, "b", " "), (3, "a", "x")], [(4, "a", "x"), (5, "c", "y")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        embed_stream(spark.readStream.schema(schema).parquet(src), cache, f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.chunk_id for r in S.read_cache(spark, cache).collect()) == ["a", "c"]


def test_stream_records_and_retries_failures(spark, tmp_path):
    from leafmill.streaming.ingest import embed_stream, open_failures

    schema, src, cache, up, calls = "chunk_no long, chunk_id string, content string", f"{tmp_path}/in", f"{tmp_path}/cache", f"{tmp_path}/up", f"{tmp_path}/calls"

    def flaky(texts):
        import os

        with open(calls, "a") as f:
            f.write("\n".join(texts) + "\n")
        if "bad" in texts or not os.path.exists(up):
            raise RuntimeError("down")
        return offline_embedder(texts)

    def run(*rows):
        if rows:
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)
        embed_stream(spark.readStream.schema(schema).parquet(src), cache, f"{tmp_path}/cp", flaky).awaitTermination()
        left = {r.chunk_id for r in open_failures(spark, cache, f"{cache}-failed").collect()}
        return {r.chunk_id for r in S.read_cache(spark, cache).collect()}, left

    assert run((1, "a", "x")) == (set(), {"a"})
    assert open(calls).read().split() == ["x"] * 3  # three attempts, not three for each table
    assert run((2, "a", "x"), (3, "c", "y")) == (set(), {"a", "c"})
    assert [(r.chunk_id, r.error) for r in S.read_failed(spark, f"{cache}-failed").orderBy("seq").collect()] == [("a", "down"), ("c", "down")]
    (tmp_path / "up").write_text("")
    assert run() == ({"a", "c"}, set())  # without a new file
    assert run((4, "d", "bad")) == ({"a", "c"}, {"d"})
    seqs = [r.seq for r in S.read_cache(spark, cache).collect()]
    assert len(seqs) == len(set(seqs)) == 2


def test_sources(spark, tmp_path):
    assert S.read_cache(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert S.report_files(spark, str(tmp_path)).count() == 1
    (tmp_path / "r.json").write_text('{"doc_meta": {"stock_code": "600001", "year": "2020"}, "blocks": [{"content": "c", "meta": {"page": 3}}]}')
    p = S.read_parsed(spark, str(tmp_path))
    S.write_parsed(p, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("stock_code = '600001'").count() == 1
    c = spark.createDataFrame([(1, " "), (2, "a"), (3, "b")], "chunk_no long, content string")
    assert [S.load_chunks(c, k).count() for k in (0, 2)] == [2, 1]
    spark.createDataFrame([(0, [1.0]), (2, [1.0])], "vector_id long, vec array<double>").write.parquet(f"{tmp_path}/ix")
    with pytest.raises(ValueError):
        S.load_index(spark, f"{tmp_path}/ix")


def test_request_bounds():
    assert Request("q").get("rrf_k") == 60
    with pytest.raises(ValueError):
        Request("")
    with pytest.raises(ValueError):
        Request("q", numbers={"top_k": 21})


def test_index_writer_and_reader(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"c{i}", "t" if i != 3 else " ", ("x",)) for i in range(6)], "chunk_no long, chunk_id string, content string, meta struct<year: string>")
    cache = spark.createDataFrame([(1, "c0", [3.0, 4.0]), (2, "c2", [1.0, 0.0]), (3, "c2", [0.0, 2.0]), (4, "c3", [1.0, 1.0]), (5, "c4", None), (6, "c5", [1.0, 0.0])], "seq long, chunk_id string, embedding array<float>")
    missing = S.write_index(chunks, cache, f"{tmp_path}/index", dim=2)
    assert {r.chunk_id for r in missing.collect()} == {"c1", "c4"}
    items = {r.vector_id: (r.chunk_id, [round(x, 3) for x in r.vec]) for r in S.load_index(spark, f"{tmp_path}/index").collect()}
    assert items == {0: ("c0", [0.6, 0.8]), 1: ("c2", [0.0, 1.0]), 2: ("c5", [1.0, 0.0])}
    config = spark.read.json(f"{tmp_path}/index-config").first()
    assert (config.chunk_count_input, config.chunk_count_indexed, config.missing_count, config.dimension) == (6, 3, 3, 2)
    with pytest.raises(ValueError):
        S.write_index(chunks.limit(0), cache, f"{tmp_path}/none", dim=2)


def test_reports_of_one_name(spark, tmp_path):
    meta = "struct<stock_code: string, year: string, company_name: string>"
    rows = [(1, ("600001", "2020", "a/b"), "x.json"), (2, ("600001", "2020", "a/b"), "y.json"), (3, (None, "", None), "z.json")]
    parsed = spark.createDataFrame(rows, f"report_no long, doc_meta {meta}, file string")
    S.write_parsed(parsed, f"{tmp_path}/parsed")
    assert {(r.report_no, r.name) for r in spark.read.parquet(f"{tmp_path}/parsed").collect()} == {(2, "600001_2020_a_b.json"), (3, "unknown_unknown_unknown.json")}
    assert [r.n for r in parsed.select(S.chunk_names().alias("n")).where("report_no = 3").collect()] == ["unknown_unknown_z_chunks.json"]


def test_questions_are_embedded(spark):
    from leafmill.operators.providers import question_vectors

    q = spark.createDataFrame([(1, "abc"), (2, None)], "question_id long, question string")
    got = {r.question_id: r.qvec for r in question_vectors(q).collect()}
    assert set(got) == {1} or set(got) == {1, 2}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6


def test_contents_pages(spark):
    toc = "目录\n第一节 概况......1\n第二节 财务......9"
    rows = [("d", 1, toc), ("d", 2, "正文"), ("d", 3, toc), ("d", 4, toc), ("d", 6, toc), ("e", 13, toc), ("f", 2, None)]
    p = spark.createDataFrame(rows, "doc_id string, page long, text string")
    assert [tuple(r) for r in L.toc_runs(p).collect()] == [("d", 3, 4)]


def test_layout_to_parsed_reports(spark, tmp_path):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    toc = "目录\n第一节 概况......1\n第二节 财务......9"
    pages = [("d", 1, 800.0, "封面 股票代码：600001"), ("d", 2, 800.0, toc), ("d", 3, 800.0, "正文"), ("d", 4, 800.0, None), ("e", 1, 800.0, None)]
    spans = [("d", p, 0, 0, 0, (0.0, 10.0, 90.0, 20.0), "某某公司 2020", 9.0, "Song", 0) for p in (1, 2, 3, 4)]  # repeats in the margin
    spans += [("d", 2, 1, 0, 0, (0.0, 100.0, 90.0, 110.0), "目录", 10.0, "Song", 0), ("d", 3, 1, 0, 0, (0.0, 100.0, 90.0, 110.0), "第一节", 14.0, "Song", 0), ("d", 3, 1, 1, 0, (0.0, 111.0, 90.0, 120.0), "概况", 14.0, "Song", 0)]
    spans += [("d", 3, 2, 0, 0, (0.0, 130.0, 90.0, 140.0), "正文的内容，说明。", 10.0, "Song", 0), ("d", 3, 3, 0, 0, (0.0, 144.0, 90.0, 154.0), "续行，说明。", 10.0, "Song", 0), ("d", 3, 4, 0, 0, (0.0, 300.0, 90.0, 310.0), "甲 乙", 10.0, "Song", 0)]
    spans += [("d", 4, 1, 0, 0, (0.0, 100.0, 90.0, 110.0), "一、业务", 14.0, "Song", 0), ("d", 4, 2, 0, 0, (0.0, 130.0, 90.0, 140.0), "后文，说明。", 10.0, "Song", 0)]
    # a foot whose lines lie half in a table: only its whole text is a repeated one
    spans += [("d", 4, 3, 0, 0, (0.0, 780.0, 90.0, 785.0), "某某公司", 10.0, "Song", 0), ("d", 4, 3, 1, 0, (0.0, 786.0, 90.0, 790.0), "2020", 10.0, "Song", 0)]
    spans = spark.createDataFrame(spans, f"doc_id string, page long, block_no int, line_no int, span_no int, line_bbox {box}, text string, size double, font string, flags int")
    pages = spark.createDataFrame(pages, "doc_id string, page long, height double, text string")
    words = spark.createDataFrame([("d", 3, 10.0, 300.0, 20.0, 308.0, "甲"), ("d", 3, 60.0, 300.0, 70.0, 308.0, "乙")], "doc_id string, page long, x0 double, y0 double, x1 double, y1 double, text string")
    tables = spark.createDataFrame([("d", 3, 0, (0.0, 295.0, 100.0, 315.0)), ("d", 4, 0, (0.0, 785.5, 100.0, 795.0))], f"doc_id string, page long, table_no int, bbox {box}")
    cells = spark.createDataFrame([("d", 3, 0, 0, 0, (0.0, 295.0, 50.0, 315.0)), ("d", 3, 0, 0, 1, (50.0, 295.0, 100.0, 315.0))], f"doc_id string, page long, table_no int, row_no int, col_no int, bbox {box}")
    files = spark.createDataFrame([("d", "甲乙_2021.pdf", "/x/a.pdf"), ("e", None, None)], "doc_id string, filename string, source_path string")
    companies = spark.createDataFrame([("丙", "600002")], "company_name string, stock_code string")
    got = {r.doc_id: r for r in L.parsed_reports(files, pages, words, spans, tables, cells, companies).collect()}
    assert [(b.meta.block_type, b.meta.page, b.content, b.meta.section) for b in got["d"].blocks] == [
        ("title", 3, "第一节\n概况", "第一节 概况"), ("text", 3, "正文的内容，说明。\n续行，说明。", "第一节 概况"), ("table", 3, "| 甲 | 乙 |\n| --- | --- |", "第一节 概况"),
        ("title", 4, "一、业务", "第一节 概况 > 一、业务"), ("text", 4, "后文，说明。", "第一节 概况 > 一、业务"),
    ]
    m = got["d"].doc_meta
    assert (m.stock_code, m.year, m.page_count, m.skipped_pages.cover, m.skipped_pages.toc) == ("600001", "2021", 4, [1], [2])
    assert got["e"].blocks == [] and (got["e"].doc_meta.year, got["e"].doc_meta.stock_code, got["e"].doc_meta.page_count) == ("", "", 1)
    S.write_parsed(L.parsed_reports(files, pages, words, spans, tables, cells).withColumnRenamed("doc_id", "file"), f"{tmp_path}/parsed")
    assert spark.read.parquet(f"{tmp_path}/parsed").count() == 2
