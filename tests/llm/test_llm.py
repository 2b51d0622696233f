"""Operators of the numbered problems against brute force, round trips and odd rows."""

import random

import numpy as np
import pandas as pd
import pytest

from leafmill.llm import neardup, packing, similar, splitting, subjects, tokens, unify


def test_cuts_are_forced_only_where_needed():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 300)
        t = "".join(rng.choice("abc。;\n . ") if rng.random() < 0.3 else "x" for _ in range(n))
        limit, overlap = rng.choice([5, 10, 50]), rng.choice([0, 1, 3])
        got = splitting.cuts(t, limit, overlap)
        places = [0] + [i + 1 for i, v in enumerate(splitting.strengths(t)) if v] + [n]
        if n > limit:
            assert any(f for *_, f in got) == (max(b - a for a, b in zip(places, places[1:])) > limit)
        assert got[0][0] == 0 and got[-1][1] == n and all(e - s <= limit for s, e, _ in got)
        assert all(s < s2 <= e < e2 for (s, e, _), (s2, e2, _) in zip(got, got[1:]))


def test_pieces_overlap_as_far_as_no_cut_is_forced(monkeypatch):
    monkeypatch.setattr(splitting, "SLICE", 64)  # several tables
    rng = random.Random(8)
    for _ in range(300):
        t = "".join("。" if rng.random() < 0.06 else "x" for _ in range(rng.randint(60, 900)))
        limit, overlap = 50, 12
        places = [i + 1 for i, v in enumerate(splitting.strengths(t)) if v] + [len(t)]
        got = splitting.cuts(t, limit, overlap)
        for (s, e, _), (s2, _, _) in zip(got, got[1:]):
            if e - s2 != overlap:  # one step more would force a cut
                ahead = min(p for p in places if p > e)
                assert s2 == s + 1 or (0 <= e - s2 < overlap and ahead - s2 == limit)


def test_pieces_of_odd_rows(spark):
    d = spark.createDataFrame([(1, None, 3, 2), (2, "", None, None), (3, "一二三。" * 700, 0, 5), (4, "x" * 2500, 9, 7)], "chunk_no long, content string, a int, b int")
    got = splitting.split_oversized(d, "chunk_no", "content", "a", "b").toPandas()
    assert set(got.chunk_no) == {3, 4}
    four = got[got.chunk_no == 4]
    assert four.forced.max() == 1 and four.piece_page_start.min() == 7 and four.piece_page_end.max() == 9
    assert got[got.chunk_no == 3].forced.max() == 0 and set(got[got.chunk_no == 3].piece_page_start) == {5}


def test_consistent_form(spark):
    rows = [(1, "使用OTC模块，Hybo。"), (2, "使用OТС模块,Hybο。"), (3, "​使用OTC模块，Hybo。"), (4, None), (5, ""), (6, "Привет мир"), (7, "使用OTC模块，Hybo。"), (8, "ХТ x"), (9, "XT x")]
    d = spark.createDataFrame([(*r, "a", "b") for r in rows], "chunk_no long, content string, base string, _id string")
    form = {r.chunk_no: r.form for r in unify.consistent_form(d, "chunk_no", "content").collect()}
    assert form[1] == form[2] == form[3] and form[4] is None and form[5] == "" and form[6] == "Привет мир" and form[8] == form[9]
    pairs = {tuple(r) for r in unify.same_reading_pairs(d, "chunk_no", "content").collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (2, 7), (3, 7), (8, 9)}
    assert unify.consistent_form(d.limit(0), "chunk_no", "content").count() == 0


def test_repairs_go_to_the_dominant_script(spark):
    assert unify.suspects("Москвa и Пpивет") == [("Москвa", "Москва"), ("Пpивет", "Привет")]
    assert unify.suspects("使用OТС和Ρlayοff") == [("OТС", "OTC"), ("Ρlayοff", "Playoff")]
    assert unify.suspects("Привет ОТС") == [] and unify.suspects("Αθήνa") == []
    d = spark.createDataFrame(list(enumerate(["г. Москвa", "г. Москва", "г. Mосква!", "Вoлга"])), "chunk_no int, content string")
    form = {r.chunk_no: r.form for r in unify.consistent_form(d, "chunk_no", "content").collect()}
    assert form == {0: "г. Москва", 1: "г. Москва", 2: "г. Москва!", 3: "Вoлга"}  # the last result is in no vocabulary


def test_many_copies_of_two_spellings(spark, monkeypatch):
    from leafmill.llm import pairs

    monkeypatch.setattr(pairs, "BLOCK", 10)
    d = spark.createDataFrame([(i, "使用OTC" if i % 3 else "使用ОТС") for i in range(90)], "chunk_no long, content string")
    got = [tuple(r) for r in unify.same_reading_pairs(d, "chunk_no", "content").collect()]
    assert len(got) == len(set(got)) == 30 * 60 and all(a < b and (a % 3 == 0) != (b % 3 == 0) for a, b in got)


def test_forms_are_one_over_all_tables(spark, tmp_path):
    from leafmill.llm.queries import p5_forms

    block = "content string, meta struct<page: int>"
    spark.createDataFrame([(7, "使用OTC模块"), (8, None)], "chunk_no long, content string").write.parquet(f"{tmp_path}/all_chunks.parquet")
    spark.createDataFrame([(0, "使用OТС模块")], "vector_id int, content string").write.parquet(f"{tmp_path}/metadata.parquet")
    rows = [(7, [("", (1,)), ("使用ОTС模块", (1,)), None]), (8, None), (9, [])]
    spark.createDataFrame(rows, f"report_no long, blocks array<struct<{block}>>").write.parquet(f"{tmp_path}/parsed.parquet")
    got = {(r.table, r.key, r.block_no): r.form for r in p5_forms(spark, str(tmp_path)).collect()}
    same = "使用OTC模块"  # the Latin spelling is in all_chunks only
    assert got == {("all_chunks", 7, 0): same, ("all_chunks", 8, 0): None, ("metadata", 0, 0): same, ("parsed", 7, 1): "", ("parsed", 7, 2): same, ("parsed", 7, 3): None}


def _jaccard(a, b, n=4):
    x, y = ({t[i : i + n] for i in range(max(1, len(t) - n + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)  # blocks meet each other
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghij") for _ in range(150)) for _ in range(6)]
    texts = []
    for i in range(120):
        t = list(base[i % 6])
        for _ in range(rng.choice([0, 2, 4, 6, 9])):
            t[rng.randrange(len(t))] = "z"
        texts.append("".join(t))
    texts += ["", "", "ab", None]
    d = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "chunk_no long, form string, id string, key int")
    members, links = neardup.near_duplicates(d, "chunk_no", "form", recall=0.9999)
    got = {tuple(r) for r in neardup.all_pairs(members, links).collect()}
    want = {(i, j) for i in range(123) for j in range(i + 1, 123) if texts[i] == texts[j] or (texts[i] and texts[j] and _jaccard(texts[i], texts[j]) >= 0.6)}
    assert len(want - got) <= 0.01 * len(want) and not got - want
    group = {r.id: r.group_id for r in neardup.groups(members, links).collect()}
    assert len(group) == 123 and all(group[a] == group[b] for a, b in got)


def test_one_bucket_of_many_near_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 40)
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefghij") for _ in range(400))
    texts = [base[:k] + "z" + base[k + 1 :] for k in range(300)] + [base] * 50
    d = spark.createDataFrame(list(enumerate(texts)), "chunk_no long, form string")
    members, links = neardup.near_duplicates(d, "chunk_no", "form", similarity=0.8)
    got = [tuple(r) for r in links.select("class_a", "class_b").collect()]
    assert len(got) == len(set(got)) == 301 * 300 // 2  # every pair once
    assert neardup.all_pairs(members, links).count() == 350 * 349 // 2
    assert {r.group_id for r in neardup.groups(members, links).collect()} == {0}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "class_a long, class_b long")
    alone = spark.createDataFrame([(i, i) for i in range(41)], "id long, class_id long")
    with pytest.raises(RuntimeError):
        neardup.groups(alone, chain, rounds=1)


def test_bands_reach_the_recall():
    for s in (0.5, 0.6, 0.8):
        bands, rows = neardup.bands_for(s)
        assert 1 - (1 - s**rows) ** bands >= 0.99


def test_similar_vectors_recall(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(1500, 16).astype(np.float32)
    x[::3] = x[1::3] + 0.1 * rng.randn(500, 16)
    x[:40] = x[0]  # a class of copies larger than k
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame(pd.DataFrame({"vector_id": range(1500), "vec": [v.tolist() for v in x]}), "vector_id long, vec array<float>")
    got = similar.similar_vectors(d, k=10, probes=None, shard_rows=400, width=32).toPandas()
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, 1, kind="stable")[:, :10]
    found = got.groupby("query_id").vector_id.apply(set)
    assert np.mean([len(found[i] & set(want[i])) / 10 for i in range(40, 1500)]) >= 0.9
    assert (got.groupby("query_id").size() == 10).all() and found[39] == set(range(10))
    few = similar.similar_vectors(d, k=3, probes=None, shard_rows=400, queries=d.where("vector_id % 100 = 0")).toPandas()
    assert set(few.query_id) == set(range(0, 1500, 100))
    assert similar.similar_vectors(d.limit(0)).count() == 0


def test_oversized_shards_have_centroids_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(similar, "MOST_CENTROIDS", 3)
    monkeypatch.setattr(similar, "ROUTE_ROWS", 150)
    monkeypatch.setattr(similar, "COPIES", 7)
    rng = np.random.RandomState(2)
    middle = rng.randn(40, 16)
    x = (middle[rng.randint(0, 40, 1200)] + 0.15 * rng.randn(1200, 16)).astype(np.float32)
    x[:60] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame(pd.DataFrame({"vector_id": range(1200), "vec": [v.tolist() for v in x]}), "vector_id long, vec array<float>")
    got = similar.similar_vectors(d, k=5, shard_rows=60).toPandas()
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, 1, kind="stable")[:, :5]
    found = got.groupby("query_id").vector_id.apply(set)
    assert np.mean([len(found[i] & set(want[i])) / 5 for i in range(60, 1200)]) >= 0.9
    assert (got.groupby("query_id").size() == 5).all() and found[59] == set(range(5))


def test_unusable_vectors(spark):
    ok = [1.0] * 64
    cache = spark.createDataFrame([(1, "a", ok), (2, "a", None), (3, "b", ok[:5]), (4, "c", [0.0] * 64), (5, "d", [float("nan")] * 64), (6, "e", None), (7, "e", ok), (8, None, ok)], "seq long, chunk_id string, embedding array<float>")
    items = spark.createDataFrame([(i, c) for i, c in enumerate(["a", "b", "c", "d", "e", "e", None, "x"])], "vector_id int, chunk_id string")
    assert {r.vector_id for r in similar.current_vectors(items, cache).collect()} == {4, 5}


TEXTS = ["Hello  world\n\n it's 2024!", "中文，混合 English 123。", "", None, "<|endoftext|> ok", " 　 ", "a" * 5000, "Hello  world\n\n it's 2024!", "😀é́"]


def test_tokens_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_ROWS", 2)
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, word string, place int")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(d, "doc_id", "text").collect()}
    enc = tokens._encoder(tokens.ranks_of("byte_bpe_50k"), "t")
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    sizes = {r.doc_id: r.n_tokens for r in tokens.encode_corpus(d, "doc_id", "text", counts=True).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    back = tokens.decode_ids(tokens.encode_corpus(d, "doc_id", "text"), "doc_id", "ids", tokens.piece_table(spark))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode_corpus(d.limit(0), "doc_id", "text").count() == 0


def test_whole_texts_come_back(spark, monkeypatch):
    texts = [*TEXTS, "中文，混合 English 😀。" * 400]  # more than one slice
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    assert {r.doc_id: r.exact for r in tokens.text_round_trip(d, "doc_id", "text").collect()} == dict.fromkeys(range(len(texts)), 1)
    ids = [(1, [5, 6, 7, 8, 9]), (2, []), (3, None)]
    pieces = spark.createDataFrame([(5, bytearray(b"a")), (6, bytearray(b"\xe4")), (7, bytearray(b"\xb8\xad")), (8, bytearray(b"b"))], "piece_id int, piece binary")
    coded = spark.createDataFrame(ids, "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode_ids(coded, "doc_id", "ids", pieces, slice_ids=2).collect()} == {1: "a中b", 2: "", 3: ""}
    assert tokens.decode_ids(coded.limit(1).selectExpr("doc_id", "array(5, 7) as ids"), "doc_id", "ids", pieces).first().text.startswith("a\ufffd")
    right = tokens.encode_corpus
    shifted = lambda *a: right(*a).selectExpr("doc_id", "reverse(ids) as ids")
    monkeypatch.setattr(tokens, "encode_corpus", shifted)
    assert 0 in {r.exact for r in tokens.text_round_trip(d, "doc_id", "text").collect()}


def test_packing(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 5, 40, 64, 65, 100, 200, 513]) for _ in range(3000)] + [None]
    d = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    w = spark.createDataFrame([("a", 64), ("b", 512), ("z", 0)], "window_code string, capacity_tokens int")
    p = packing.pack(d, w).toPandas()
    for code, room in (("a", 64), ("b", 512)):
        own = p[p.window_code == code]
        assert own.doc_id.nunique() == 3001 and own.tokens.sum() == sum(s or 0 for s in sizes)
        assert own.groupby("container").tokens.sum().max() <= room
        split = own.groupby("doc_id").piece_no.max()
        assert all((split[i] > 0) == ((s or 0) > room) for i, s in enumerate(sizes))
        assert own.container.nunique() <= 1.05 * sum(s or 0 for s in sizes) / room + 1 or code == "a"
    assert packing.pack(d.limit(0), w).count() == 0


def test_solver_is_tight():
    size, count = np.array([30, 40, 60, 70]), np.array([500, 500, 500, 500])
    out = packing.solve(size, count, 100)
    assert sum(m for m, _, _ in out) == 1000 and all((size[at] * n).sum() <= 100 for _, at, n in out)


def test_the_program_fills_most_windows():
    rng = np.random.RandomState(3)
    size, count = np.unique(np.minimum(rng.geometric(1 / 60, 20_000), 199), return_counts=True)
    taken, left = packing.program(size, count, 200)
    assert all((used * size).sum() == 200 for _, used in taken) and (sum(m * used for m, used in taken) + left == count).all()
    assert (left * size).sum() <= 0.11 * (count * size).sum()
    assert sum(m for m, _, _ in packing.solve(size, count, 200)) <= 1.005 * (size * count).sum() / 200 + 1


def test_subjects_held_out(spark):
    rng = random.Random(4)
    words = {"sport": ["马拉松赛道", "青训梯队", "goalkeeper"], "law": ["诉讼请求", "仲裁裁决", "injunction"], "energy": ["风电机组", "光伏组件", "substation"]}
    rows, truth, labels = [], {}, []
    for i in range(900):
        s = rng.choice(list(words))
        text = [f"本年度{rng.choice(words[s])}已完成改造，编号为{rng.randint(1, 99)}。" if k == 0 or rng.random() < 0.7 else "该项工作进展顺利。" for k in range(6)]
        text.insert(rng.choice([0, 6]), "值班表已更新，不存在争议。")  # only routine can open a text besides the subjects
        rows.append((i, "".join(text) if i % 50 else None))
        truth[i] = s
        if i % 3 == 0:
            labels.append((i, s if rng.random() < 0.9 else rng.choice(list(words)), "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, subject_code string, labeller string")
    model = subjects.train_subjects(docs, lab)
    assert {int(b) for b in subjects.sentences_of(["该项工作进展"]).bucket} & set(np.flatnonzero(model.goes_on))
    assert not {int(b) for b in subjects.sentences_of(["值班表"]).bucket} & set(np.flatnonzero(model.goes_on))
    shares = subjects.subject_shares(docs, model)
    of = {r.doc_id: r.n for r in shares.groupBy("doc_id").agg({"sentences": "sum"}).toDF("doc_id", "n").collect()}
    assert sum(of[i] == 6 for i in of) >= 0.95 * len(of)  # all but the routine
    got = {r.doc_id: r.subject_code for r in shares.where("sentences >= 0.5 * of").collect()}
    held = [i for i in range(900) if i % 3 and i % 50]
    assert sum(got.get(i) == truth[i] for i in held) >= 0.95 * len(held)
    cal = subjects.calibrated(shares, lab).toPandas()
    assert cal.posterior.between(0, 1).all() and cal[cal.share > 0.6].posterior.mean() > 0.7
    again = subjects.train_subjects(docs.repartition(7), lab)  # the order of the rows changes nothing
    assert (again.weights == model.weights).all() and (again.index == model.index).all()
    assert subjects.train_subjects(docs, lab.limit(0)) is None
    assert subjects.calibrated(shares, lab.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p3_found"])
def test_sql(spark, data, name):
    import glob
    import os

    import duckdb

    from leafmill.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for f in glob.glob(data + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, data)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall())


def test_subjects_fold_plain_characters_without_a_call_a_text(monkeypatch):
    """p8: characters that stand alone are folded by a table; the others' texts one by one, with the same result."""
    from leafmill.functions.forms import base_form_text

    odd = ["", None, "a\r\nb\rc", "éx", "が", "ΣΑΣ. ΟΔΟΣ", "…㎡", "각", "x​y", "\x00힣", "İ", "ﬁne", "⺝⺝", "𝐀b"]
    plain = ["营业收入（万元）：１２３．４％。\nＡＢＣ Revenue—up　 x", "Абв Élan ｱｲ²", "\x85‐\xa0z"]
    asked = []
    subjects._folded()
    monkeypatch.setattr(subjects, "base_form_text", lambda t: asked.append(t) or base_form_text(t))
    for texts in (plain, odd, plain + odd + plain, []):
        want = "".join((base_form_text(t) or "").lower().replace("\x00", " ") + "\n" for t in texts) + " "
        codes, lengths = subjects._codes_of(texts)
        assert "".join(map(chr, codes)) in (want, "\n" + want if not texts else want) and sum(lengths) == len(want) - 1
        assert not set(asked) & set(plain)
    assert asked
