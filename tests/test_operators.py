"""Core operators on small fixtures: nulls, empty texts, ties and odd columns."""

import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.forms import base_form_text, shape_text
from leafmill.operators import chunking as C
from leafmill.operators import quantities as Q
from leafmill.operators import retrieval as R


def _one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("text,years", [("良品铺子2020年营业收入", ["2020"]), ("2019到2021变化", ["2019", "2020", "2021"]), ("2021-2019 对比", ["2019", "2020", "2021"]),
                                        ("2019年 ~ 2021年", ["2019", "2020", "2021"]), ("2005到2020年", ["2005", "2020"]), ("2020到2020年", ["2020"]), ("营业收入", []), ("002021营业收入", ["2021"])])
def test_years(spark, text, years):
    assert _one(spark, text, T.years_in) == years


@pytest.mark.parametrize("text,parts", [("甲乙丙。丁戊己。庚辛", ["甲乙丙。丁戊己。", "庚辛"]), ("ab\ncd\nef", None), ("", []), (None, [])])
def test_split_long_text(spark, text, parts):
    got = _one(spark, text, lambda c: C.split_long_text(c, 8))
    assert all(len(p) <= 8 for p in got)
    if parts is not None:
        assert got == parts


def test_split_keeps_all_text(spark):
    text = "甲" * 30 + "。" + "ab。cd\n" * 9 + "\n\n" + "x" * 25
    got = _one(spark, text, lambda c: C.split_long_text(c, 10))
    assert re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", text)


@pytest.mark.parametrize("text,n", [("| a | b |\n| - | - |", 2), ("no table", 0), ("| a \\| b | c |", 3), ("||a||", 1), (None, 0)])
def test_markdown_columns(spark, text, n):
    assert _one(spark, text, T.markdown_columns) == n


def test_filenames(spark):
    assert _one(spark, "a/b:c", T.safe_filename) == "a_b_c"
    assert _one(spark, "***", T.safe_filename) == "unknown"
    assert _one(spark, None, T.safe_filename) == "unknown"
    assert _one(spark, "奥来德_2024年报.pdf", T.company_from_filename) == "奥来德"


def test_base_form():
    assert base_form_text(None) is None and base_form_text("") == ""
    assert base_form_text("Ａ１　ｘ​—é⼼") == "A1 x-é心"
    assert shape_text("RМВ") == "RMB"


def _blocks(spark, rows):
    return spark.createDataFrame([Row(report_no=1, block_no=i + 1, content=c, kind=k, page=p, section=s, stock_code="", company_name="c", year="2020") for i, (k, c, p, s) in enumerate(rows)])


@pytest.mark.parametrize("rows,types", [
    ([("title", "T", 1, "a"), ("text", "X", 1, "a"), ("text", "Y", 1, "a")], [("text", "X\n\nY")]),
    ([("text", "X", 1, "a"), ("title", "T", 1, "a"), ("text", "Y", 1, "a")], [("text", "X"), ("text", "Y")]),
    ([("title", "T", 1, "a"), ("text", "单位：元", 1, "a"), ("table", "| a |", 1, "a")], [("table", "T\n\n单位：元\n\n| a |")]),
    ([("text", "X", 1, "a"), ("text", "单位：元", 1, "a"), ("table", "| a |", 1, "a")], [("text", "X"), ("table", "单位：元\n\n| a |")]),
    ([("title", "T", 1, "a"), ("table", "| a |", 1, "a"), ("table", "| b |", 1, "a")], [("table", "T\n\n| a |"), ("table", "T\n\n| b |")]),
    ([("table", "| a |", 1, "a"), ("table", "| b |", 2, "a")], [("table", "| a |\n\n| b |")]),
    ([("table", "| a |", 1, "a"), ("table", "| b | c |", 2, "a")], [("table", "| a |"), ("table", "| b | c |")]),
    ([("text", "X", 1, "a"), ("text", "Y", 1, "b")], [("text", "X"), ("text", "Y")]),
])
def test_block_sequences(spark, rows, types):
    got = C.build_chunks(_blocks(spark, rows)).orderBy("chunk_seq").collect()
    assert [(r.chunk_type, r.content) for r in got] == types


def test_blocks_of_other_kinds_only_stand_between(spark):
    rows = [("text", "X", 1, "a"), ("figure", "f", 1, "a"), ("text", "单位：元", 1, "a"), ("figure", "g", 1, "a"), ("table", "| a |", 1, "a"), ("title", "T", 1, "a"), ("figure", "h", 1, "a"), ("figure", "i", 1, "a"), ("table", "", 1, "a")]
    got = C.build_chunks(_blocks(spark, rows)).orderBy("chunk_seq").collect()
    assert [(r.chunk_type, r.content, r.n_blocks) for r in got] == [("text", "X", 1), ("table", "单位：元\n\n| a |", 2), ("table", "", 1)]


def test_a_scorer_and_a_tokenizer_can_be_given(spark):
    items = spark.createDataFrame([(1, "ab cd", "n", "c", "2020", "s", 1, 2), (2, "cd", "n", "c", "2020", "s", 1, 2)], "vector_id long, content string, company_name string, stock_code string, year string, section string, page_start int, page_end int")
    q = spark.createDataFrame([(7, "AB")], "question_id long, question string")
    c = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "question_id long, vector_id long, rrf_rank long")
    got = R.reranked(c, q, items, scorer=lambda a, b: F.when(b.contains(F.lower(a)), 0.9).otherwise(0.3)).orderBy("rerank_rank").collect()
    assert [(r.vector_id, r.rerank_score) for r in got] == [(1, 0.9), (2, 0.3)]
    f = spark.createDataFrame([(7, None, None, [])], "question_id long, code string, year string, years array<string>")
    assert R.keyword_hits(q.selectExpr("question_id", "'ab' as question"), f, items.union(items.selectExpr("vector_id + 2", *["'x'"] * 5, "1", "2")), tokenize=lambda c: F.split(c, " ")).first().vector_id == 1


def test_long_islands_are_split(spark):
    same = "甲" * 299 + "。" + "乙" * 299 + "。"
    rows = [("text", same, 1, "a"), ("text", " ", 9, "a"), ("text", same, 2, "a"), ("text", "丙" * 300, 3, "a"), ("title", "T", 3, "a"), ("text", "x" * 2500, 4, "a"), ("table", "| " + "b" * 1500 + " |", 5, "b"), ("text", "Y", 6, "b")]
    got = C.build_chunks(_blocks(spark, rows)).orderBy("chunk_seq").collect()
    assert [(r.chunk_seq, r.chunk_type, len(r.content), r.page_start, r.page_end, r.n_blocks) for r in got] == [
        (1, "text", 600, 1, 1, 1), (2, "text", 902, 2, 3, 2), (3, "text", 1000, 4, 4, 1), (4, "text", 1000, 4, 4, 1), (5, "text", 500, 4, 4, 1), (6, "table", 1504, 5, 5, 1), (7, "text", 1, 6, 6, 1),
    ]
    assert [r.chunk_id[-6:] for r in got] == [f"{k:06d}" for k in range(1, 8)]


def test_fallback_reads_the_first_three_pages(spark, tmp_path):
    from leafmill.queries import doc_meta_fallback

    spark.createDataFrame([("600009", "乙")], "stock_code string, company_name string").write.parquet(f"{tmp_path}/companies.parquet")
    early = [("a", (1,)), (None, (1,)), ("b", (2,)), ("c", (2,)), ("股票代码：600001", (3,)), ("2021", (None,))]
    late = [("a", (1,)), ("股票代码：600002 2022", (4,))]
    rows = [(1, ("甲.pdf",), early), (2, ("甲.pdf",), late), (3, ("乙.pdf",), None)]
    spark.createDataFrame(rows, "report_no long, doc_meta struct<filename: string>, blocks array<struct<content: string, meta: struct<page: int>>>").write.parquet(f"{tmp_path}/parsed.parquet")
    got = {r.report_no: (r.year, r.stock_code) for r in doc_meta_fallback(spark, str(tmp_path)).collect()}
    assert got == {1: ("2021", "600001"), 2: ("", ""), 3: ("", "600009")}


METRICS = [("revenue", "营业收入", "Operating revenue", "money"), ("mass", "产品产量", "Product output", "mass"), ("staff", "员工总数", "Headcount", "people")]


@pytest.mark.parametrize("text,want", [
    ("公司实现营业收入520.24亿元，同比变动8.83%。", {("revenue", 52_024_000_000)}),
    ("营业收入由八亿七千万元变动至122.759百万元。", {("revenue", 870_000_000), ("revenue", 122_759_000)}),
    ("营业收入9亿3,832万元（上年同期：人民币6,336万元）。", {("revenue", 938_320_000), ("revenue", 63_360_000)}),
    ("按万元列示，营业收入1,587.615。", {("revenue", 15_876_150)}),
    ("Operating revenue amounted to RMB 0.290 billion, compared with CNY 6.198m a year earlier.", {("revenue", 290_000_000), ("revenue", 6_198_000)}),
    ("Product output reached 0.0807 million tonnes in 2018.", {("mass", 80_700_000)}),
    ("单位：千元\n| 项目 | 附注 | 本年 | 同比增减(%) |\n| --- | --- | --- | --- |\n| 营业收入 | 七、1 | (1,234.5) | 3.2 |", {("revenue", -1_234_500)}),
    ("| 项目 | 单位 | 本年 |\n| --- | --- | --- |\n| 产品产量 | 万吨 | 1.5 |\n| 员工总数（名） |  | 25 |\n| 产品产量 | 不适用 | - |", {("mass", 15_000_000), ("staff", 25)}),
    ("单位：万吨\n| 项目 | 本年 |\n| --- | --- |\n| 产品产量 | 1.5 |\n| 营业收入 | 0 |", {("mass", 15_000_000), ("revenue", 0)}),
    ("产品产量为0。员工总数7。", {("mass", 0)}),
    ("", set()), (None, set()), ("营业收入较好。", set()),
])
def test_quantities(spark, text, want):
    m = spark.createDataFrame(METRICS, "metric_code string, metric_name string, metric_name_en string, dimension string")
    d = spark.createDataFrame([(1, text, 9, "x")], "chunk_no long, content string, number int, unit string")
    got = {(r.metric_code, r.amount) for r in Q.common_amounts(d, m).collect() if r.amount is not None}
    assert got == want


def test_missing_units_are_assigned(spark):
    m = spark.createDataFrame(METRICS, "metric_code string, metric_name string, metric_name_en string, dimension string")
    rows = [(i, f"营业收入{1_000_000 + 977 * i}.25元。营业收入{100 + i}.1234万元。") for i in range(60)]
    rows += [(100, "| 项目 | 本年 | 上年 |\n| --- | --- | --- |\n| 营业收入 | 123.4567 | 140.1111 |")]
    d = spark.createDataFrame(rows, "chunk_no long, content string")
    got = Q.common_amounts(d, m).where("chunk_no = 100").collect()
    assert {r.amount for r in got} == {1_234_567, 1_401_111} and all(r.posterior < 1 for r in got)
    assert Q.common_amounts(d.limit(0), m).count() == 0


def test_missing_units_take_their_dimension_or_the_other_language(spark):
    more = [*METRICS, ("profit", "净利润", "Net profit", "money")]
    m = spark.createDataFrame(more, "metric_code string, metric_name string, metric_name_en string, dimension string")
    rows = [(i, f"营业收入{1_000_000 + 977 * i}.25元。营业收入{100 + i}.1234万元。") for i in range(60)]
    table = "| item | this year | last year |\n| --- | --- | --- |\n| {} | 123.4567 | 140.1111 |"
    rows += [(100, table.format("净利润")), (101, table.format("Operating revenue")), (102, table.format("Net profit"))]
    got = Q.common_amounts(spark.createDataFrame(rows, "chunk_no long, content string"), m).where("chunk_no >= 100").collect()
    assert len(got) == 6 and {r.amount for r in got} == {1_234_567, 1_401_111}
    assert all(0 < r.posterior < 1 for r in got)


def test_fusion_ties(spark):
    v = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "question_id long, vector_id long, vector_score double, vector_rank long")
    k = spark.createDataFrame([(1, 12, 3.0, 1), (1, 10, 2.0, 2)], "question_id long, vector_id long, bm25_score double, bm25_rank long")
    got = R.fused(v, k).orderBy("rrf_rank").collect()
    assert [r.vector_id for r in got] == [10, 12, 11]
    assert abs(got[0].rrf_score - (1 / 61 + 1 / 62)) < 1e-9
    assert R.fused(v.limit(0), k.limit(0)).count() == 0


def test_settings_of_questions(spark):
    q = spark.createDataFrame([(1, 7, None), (2, 900, 0.5), (3, 0, 2.0), (3, 0, 0.1)], "question_id long, top_k int, rerank_threshold double")
    d = spark.createDataFrame([(1,), (2,), (3,), (4,)], "question_id long")
    got = {r.question_id: (r.top_k, r.rerank_threshold, r.rrf_k) for r in R.with_settings(d, q, "top_k", "rerank_threshold", "rrf_k").collect()}
    assert got == {1: (7, 0.25, 60), 2: (20, 0.5, 60), 3: (1, 1.0, 60), 4: (4, 0.25, 60)}
    assert R.with_settings(d, None, "top_k").where("top_k = 4").count() == 4


def test_vector_hits_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "ITEM_BLOCK", 9)  # several blocks of items and of queries
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    rng = np.random.RandomState(4)
    x = rng.randn(60, 5)
    x[10:40] = x[10]  # ties beyond k
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = ["a" if i % 3 else "b" for i in range(60)]
    items = spark.createDataFrame([(i, code[i], "2020", x[i].tolist(), "z") for i in range(60)], "vector_id long, stock_code string, year string, vec array<double>, k string")
    filters = spark.createDataFrame([(n, "b" if n % 2 else None, None, []) for n in range(8)] + [(8, "none", None, [])], "question_id long, code string, year string, years array<string>")
    queries = spark.createDataFrame([(n, x[n + 5].tolist()) for n in range(9)], "question_id long, qvec array<double>")
    asked = spark.createDataFrame([(n, 3 + n) for n in range(8)], "question_id long, vector_top_k int")
    got = {}
    for r in R.vector_hits(queries, filters, items, asked).orderBy("question_id", "vector_rank").collect():
        got.setdefault(r.question_id, []).append(r.vector_id)
    s = np.round(x[5:13] @ x.T, 6)
    want = {n: sorted((i for i in range(60) if n % 2 == 0 or code[i] == "b"), key=lambda i: (-s[n, i], i))[: 3 + n] for n in range(8)}
    assert got == want
    assert R.vector_hits(queries.limit(0), filters, items).count() == 0
    assert R.vector_hits(queries, filters, items.limit(0)).count() == 0


def test_keyword_hits_of_odd_items(spark):
    schema = "vector_id long, content string, stock_code string, year string, sig string, atom string"
    rows = [(1, "营业收入增长", "600001", "2020"), (2, "营业收入", None, "2020"), (3, None, "600001", None), (4, "", "", ""), (5, "净利润", "600001", "2021"), (6, "研发投入", "600002", "2021"), (7, "货币资金", "600003", "2019")]
    items = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    asked = [(1, "营业收入"), (2, "营业收入"), (3, None), (4, "净利润")]
    questions = spark.createDataFrame(asked, "question_id long, question string")
    none: list = []
    filters = spark.createDataFrame([(1, None, None, none), (2, None, "2021", ["2020"]), (3, None, None, none), (4, "600001", None, ["2021", "2020", "2020"])], "question_id long, code string, year string, years array<string>")
    got = {}
    for r in R.keyword_hits(questions, filters, items).orderBy("question_id", "bm25_rank").collect():
        got.setdefault(r.question_id, []).append(r.vector_id)
    assert got[1] == [2, 1] and set(got) <= {1, 4}  # the shorter text first; a year and other years exclude each other
    assert {(r.question_id, r.n) for r in R.eligible(filters, items).join(R.signatures(filters), "sig").groupBy("question_id").agg(F.count("*").alias("n")).collect()} == {(1, 7), (3, 7), (4, 2)}
    assert R.keyword_hits(questions, filters, items.limit(0)).count() == 0
    assert R.keyword_hits(questions.limit(0), filters.limit(0), items).count() == 0


@pytest.mark.parametrize("code_items,item_block", [(10_000, 60_000), (5, 7), (0, 60_000)])
def test_keyword_hits_equal_brute_force(spark, monkeypatch, code_items, item_block):
    monkeypatch.setattr(R, "CODE_ITEMS", code_items)  # codes of many items meet their questions in blocks
    monkeypatch.setattr(R, "ITEM_BLOCK", item_block)
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    rng = np.random.RandomState(5)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    odds = 1 / np.arange(1, 13) / np.sum(1 / np.arange(1, 13))
    items = [(i, " ".join(rng.choice(words, 3 + i % 5, p=odds)), "aab"[i % 3] if i % 7 else None, str(2020 + i % 4) if i % 5 else None) for i in range(60)]
    filters = [(0, None, None, []), (1, "a", None, []), (2, "b", "2021", []), (3, None, "2022", ["2022", "2021"]), (4, "a", None, ["2020", "2023"]), (5, None, None, ["2021", "2023"]), (6, "none", None, []), (7, None, "2021", ["2022"])]
    filters += [(8, None, None, []), (9, "a", None, [])]
    asked = [(n, "wa wb wb wk" if n in (0, 1, 8, 9) else f"wa wa {words[n]} zz", 3 if n > 7 else 5) for n in range(10)]
    want = {}
    for (n, text, k), (_, code, year, years) in zip(asked, filters):
        own = [(i, t.split()) for i, t, c, y in items if (code is None or c == code) and (year is None or y == year) and (not years or y in years)]
        n_own, avgdl = len(own), sum(len(t) for _, t in own) / max(1, len(own))
        df = {w: sum(w in t for _, t in own) for w in words}
        raw = {w: np.log(n_own - d + 0.5) - np.log(d + 0.5) for w, d in df.items() if d}
        mean = np.mean(list(raw.values())) if raw else 0
        s = {i: sum((raw[w] if raw[w] >= 0 else 0.25 * mean) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in text.split() if w in t) for i, t in own}
        s = {i: round(v, 4) for i, v in s.items()}
        if best := sorted((i for i in s if s[i] > 0), key=lambda i: (-s[i], i))[:k]:
            want[n] = [(i, s[i]) for i in best]
    got = {}
    q = spark.createDataFrame(asked, "question_id long, question string, bm25_top_k int")
    f = spark.createDataFrame(filters, "question_id long, code string, year string, years array<string>")
    it = spark.createDataFrame(items, "vector_id long, content string, stock_code string, year string")
    for r in R.keyword_hits(q, f, it).orderBy("question_id", "bm25_rank").collect():
        got.setdefault(r.question_id, []).append((r.vector_id, pytest.approx(r.bm25_score, abs=2e-4)))
    assert want == got and {0, 1, 5} <= set(got)
