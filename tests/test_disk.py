"""What a query moves and writes stays in proportion to the tables that it reads."""

import os
import random
import time
from pathlib import Path

import pytest

from leafmill import queries
from leafmill.operators import retrieval as R
from leafmill.queries import QUERIES
from leafmill.session import CLEANUP, release, shared_folder

DATA = "/root/testdata/sf0.01"
#: MB of shuffle and written stages for each MB of metadata, embedding_cache and questions.
MOST = {"vector_topk": 6, "rerank_threshold": 8, "hybrid_answer": 8, "references": 8, "ui_candidate": 8, "answer_usage": 8, "no_evidence": 8}


def _moved(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize("name", list(MOST))
def test_moved_bytes(spark, name):
    release(spark)
    folder, before = Path(shared_folder(spark).removeprefix("file://")), _moved(spark)
    QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()
    written = sum(p.stat().st_size for p in folder.rglob("leafmill-*/*.parquet"))
    read = sum(os.path.getsize(f"{DATA}/{t}.parquet") for t in ("metadata", "embedding_cache", "questions"))
    moved = _moved(spark) - before + written
    print(f"MOVED {name} {moved / read:.2f}")
    release(spark)
    assert moved <= MOST[name] * read


def _settled(spark):
    time.sleep(0.5)  # the status store is updated now and then
    return _moved(spark)


@pytest.fixture
def no_broadcast(spark):
    """Small tables move as large ones do."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _long_texts(spark):
    """Questions, items of texts that don't compress (0.9 MB), each re-ranked for some questions."""
    rng = random.Random(3)
    text = ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(3000 + i)) for i in range(100)]
    items = [(i, f"c{i}", text[i], "n", "600000", "2020", "s", 1, 2) for i in range(100)]
    q = spark.createDataFrame([(n, "q", 9000) for n in range(20)], "question_id long, question string, max_context_chars int")
    fields = "vector_id long, chunk_id string, content string, company_name string, stock_code string, year string, section string, page_start int, page_end int"
    ranked = spark.createDataFrame([(n, (7 * n + r) % 100, r, 1.0, r) for n in range(20) for r in range(1, 12)], "question_id long, vector_id long, rrf_rank long, rerank_score double, rerank_rank long")
    return q, spark.createDataFrame(items, fields), ranked


def test_references_move_lengths_not_texts(spark, monkeypatch, no_broadcast):
    given = _long_texts(spark)
    monkeypatch.setattr(queries, "_ranked", lambda *_: given)
    before = _settled(spark)
    got = [r for r in queries.references(spark, DATA).collect() if r.question_id == 2]
    moved = _settled(spark) - before
    rest = len("【1】\n公司：n\n股票代码：600000\n年份：2020\n页码：1-2\n章节：s\n内容：")
    assert [(r.ref_id, r.vector_id, r.chunk_id, r.used) for r in sorted(got, key=lambda r: r.ref_id)] == [(1, 15, "c15", 3015 + rest), (2, 16, "c16", 6031 + 2 * rest)]
    assert moved < 100_000
    release(spark)


def test_vectors_move_as_they_were_given(spark, no_broadcast):
    """A vector as 64 floats, not as 64 doubles, and only the asked ones for the questions' vectors."""
    moved = []
    for name in ("bm25_topk", "vector_topk"):
        before = _settled(spark)
        QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()
        moved.append(_settled(spark) - before)
        release(spark)
    assert moved[1] - moved[0] < 1.1 * os.path.getsize(f"{DATA}/embedding_cache.parquet")


def test_rows_of_names_each_item_exactly(spark):
    ids = [0, 1, 63, 64, 65, 127, 4000, 1 << 40, -1, -64]
    items = spark.createDataFrame([(i, "x") for i in [*range(-130, 200), 1 << 40, 4000, 4001]], "vector_id long, k string")
    named = spark.createDataFrame([(i,) for i in [*ids, *ids, 999_999, None]], "vector_id long")
    got = R.rows_of(items, named)
    assert got.columns == items.columns and sorted(r.vector_id for r in got.collect()) == sorted(ids)


def test_answer_usage_writes_and_moves_no_texts(spark, no_broadcast):
    q, items, ranked = _long_texts(spark)
    # with a threshold of 0 every hit is ranked; question 100 has none
    q = q.unionByName(q.limit(1).selectExpr("question_id + 100 as question_id", "question", "max_context_chars")).selectExpr("*", "0.0D as rerank_threshold", "11 as top_k")
    keyword = ranked.selectExpr("question_id", "vector_id", "1.0D as bm25_score", "rerank_rank as bm25_rank")
    vector = keyword.limit(0).toDF("question_id", "vector_id", "vector_score", "vector_rank")
    release(spark)
    folder = Path(shared_folder(spark).removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("leafmill-*/*.parquet"))
    written = -size()
    stages = R.answer_stages(q, q.select("question_id"), items, vector, keyword)
    written += size()
    before = _settled(spark)
    usage = {r.question_id: (r.context_chars, r.rerank_output_count, r.final_reference_count) for r in stages["usage"].collect()}
    moved = _settled(spark) - before
    context = {r.question_id: len(r.context or "") for r in stages["answers"].collect()}
    assert {n: u[0] for n, u in usage.items()} == context and usage[100] == (0, 0, 0)
    assert all(usage[n][1:] == (11, 2) for n in range(20)) and stages["final_context"].where("text is null").count() == 0
    assert written + moved < 200_000
    release(spark)


def test_shuffle_files_go_with_their_stage(spark):
    """Behind no_evidence's last stage none of the shuffles that led to it is still on disk."""
    dirs = [Path(f.getPath()) for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    names = lambda: {p for d in dirs for p in d.rglob("shuffle_*.data")}
    before, setting = names(), spark.conf.get(CLEANUP)
    QUERIES["no_evidence"](spark, DATA)
    for _ in range(20):
        left = sum(p.stat().st_size for p in names() - before if p.exists())
        if left < 100_000:
            break
        time.sleep(0.5)
    assert left < 100_000 and spark.conf.get(CLEANUP) == setting
    release(spark)
