import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluate, retrieval
from lodestone.operators.providers import ChatContext, ChatError, Contextualizer, Embedder, HashEmbedder, HttpChat, HttpEmbedder, ModelEmbedder, ModelRerank, OverlapRerank, PlainContext, PlainRerank, Reranker, embedder_of, or_plain, reranker_of

CHUNK = "note_path string, ordinal int, text string, embedding_text string"


def chunks_of(spark, texts):
    return spark.createDataFrame([(f"n{i:03}", 0, t, t) for i, t in enumerate(texts)], CHUNK)


def queries_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def bm25(spark, texts, queries, k=100):
    c = chunks_of(spark, texts)
    return retrieval.sparse(retrieval.postings(c), retrieval.corpus_stats(c), queries_of(spark, queries), k).collect()


def test_bm25_equals_sqlite(spark):
    rng = random.Random(1)
    vocab = ["alpha", "beta", "gamma", "foo_bar", "foo", "bar", "città", "über", "x1", "the", "the", "the"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for _ in range(80)]
    asked = ["alpha", "the the gamma", "foo_bar", "citta uber", "bar?! -- foo", "missing", "?? -- ::", ""]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts, 1)))
    got = {}
    for r in bm25(spark, texts, asked):
        got.setdefault(r.query_id, {})[r.note_path] = r.score
    import re

    for i, q in enumerate(asked):
        match = " OR ".join(f'"{w}"' for w in re.findall(r"\w+", q))
        rows = db.execute("select rowid, bm25(t) from t where t match ?", (match,)).fetchall() if match else []
        assert got.get(i, {}) == pytest.approx({f"n{k - 1:03}": -s for k, s in rows}, abs=1e-9), q


def test_accents_fold_both_ways(spark):
    texts = ["perche citta", "mañana", "straße", "coração", "tiếng Việt", "e\u0302\u0301 ḍ"]
    got = {(r.query_id, r.note_path) for r in bm25(spark, texts, ["perché", "manana", "strasse", "coracao", "tieng", "VIỆT", "ế d"])}
    assert got == {(0, "n000"), (1, "n001"), (3, "n003"), (4, "n004"), (5, "n004"), (6, "n005")}


def test_dense_nearest_first(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, 0.0, 0.0]), ("b", 0, [0.0, 1.0, 0.0]), ("c", 0, [1.0, 0.0, 0.0])], "note_path string, ordinal int, embedding array<float>")
    q = spark.createDataFrame([(0, [0.9, 0.1, 0.0]), (1, [0.0, 1.0, 0.0])], "query_id long, vector array<float>")
    got = [(r.query_id, r.rank, r.note_path) for r in retrieval.dense(rows, q, 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 0, "a"), (0, 1, "c"), (1, 0, "b"), (1, 1, "a")]


def ranked(spark, rows):
    return spark.createDataFrame([(0, n, 0, i) for i, n in enumerate(rows)], "query_id long, note_path string, ordinal int, rank int")


def test_fusion(spark):
    got = retrieval.fuse(ranked(spark, ["A", "B"]), ranked(spark, ["C", "A"]), 10).orderBy("rank").collect()
    assert [(r.note_path, r.dense_rank, r.sparse_rank) for r in got] == [("A", 0, 1), ("C", None, 0), ("B", 1, None)]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62)
    tie = retrieval.fuse(ranked(spark, ["A", "B"]), ranked(spark, ["B", "A"]), 1).collect()
    assert [r.note_path for r in tie] == ["A"]
    assert retrieval.fuse(ranked(spark, ["A"]).limit(0), ranked(spark, ["Z"]), 5).first().note_path == "Z"


def test_hybrid_sources_and_reading(spark):
    texts = ["violin strings and bow", "cello strings", "guitar frets", "rare token zyxw here"]
    c = chunks_of(spark, texts).withColumn("embedding", HashEmbedder(32).column(F.col("embedding_text")))
    c = c.unionByName(c.where("note_path = 'n000'").withColumn("ordinal", F.lit(1)))
    notes = spark.createDataFrame([("n000", "Violin"), ("n001", "Cello"), ("n003", "Rare")], "path string, title string")
    args = (c, retrieval.postings(c), retrieval.corpus_stats(c), queries_of(spark, ["violin bow", "zyxw"]), HashEmbedder(32))
    got = retrieval.search_knowledge(*args, k=3).orderBy("query_id", "rank").collect()
    assert (got[0].note_path, got[3].note_path) == ("n000", "n003") and len(got) == 6
    again = retrieval.search_knowledge(*args, k=2, reranker=OverlapRerank()).orderBy("query_id", "rank").collect()
    assert again[0].score == 1.0 and again[0].note_path == "n000"
    flip = ModelRerank(lambda: lambda pairs: [float(len(t)) for _, t in pairs])
    assert retrieval.search_knowledge(*args, k=1, reranker=flip).where("query_id = 0").first().note_path == "n000"
    roll = retrieval.search_sources(retrieval.search_knowledge(*args, k=50), notes, 2).where("query_id = 0").orderBy("rank").collect()
    assert (roll[0].title, roll[0].hit_count, roll[0].snippets) == ("Violin", 2, [texts[0]] * 2)
    assert retrieval.read_notes(notes, c).where("note_path = 'n000'").first().text == f"{texts[0]}\n\n{texts[0]}"
    assert retrieval.note_titles(notes, spark.createDataFrame([("n001",), ("q",)], "path string")).collect()[0].title == "Cello"


def test_filters(spark):
    c = chunks_of(spark, ["a", "b", "c"])
    notes = spark.createDataFrame([("n000", ["x"]), ("n001", ["y", "x"]), ("n002", [])], "path string, tags array<string>")
    names = lambda df: sorted(r.note_path for r in df.collect())
    assert names(retrieval.with_filters(c, notes, tags=["x"])) == ["n000", "n001"]
    assert names(retrieval.with_filters(c, notes, globs=["n?01", "*2"])) == ["n001", "n002"]
    assert names(retrieval.with_filters(c, notes)) == ["n000", "n001", "n002"]


def test_filters_narrow_a_search_down_but_not_its_statistics(spark):
    texts = ["oak oak", "oak elm", "elm", "ash"]
    c = chunks_of(spark, texts).withColumn("embedding", HashEmbedder(16).column(F.col("embedding_text")))
    notes = spark.createDataFrame([("n001", ["x"]), ("n003", ["y"])], "path string, tags array<string>")
    args = (retrieval.postings(c), retrieval.corpus_stats(c), queries_of(spark, ["oak elm"]))
    whole = {r.note_path: r.score for r in retrieval.sparse(*args, 9).collect()}
    some = retrieval.sparse(*args, 9, retrieval.filtered_notes(notes, tags=["x"])).collect()
    assert {r.note_path: r.score for r in some} == {"n001": whole["n001"]}
    got = retrieval.search_knowledge(c, *args, HashEmbedder(16), 9, notes=retrieval.filtered_notes(notes, globs=["n*"]))
    assert {r.note_path for r in got.collect()} == {"n001", "n003"}


def test_channels_and_runners(spark):
    texts = ["oak bark and leaves", "elm wood", "ash tree", "beech nut"]
    c = chunks_of(spark, texts)
    c = c.unionByName(c.withColumn("ordinal", F.lit(1)).withColumn("embedding_text", F.concat("text", F.lit(" more")))).withColumn("embedding", HashEmbedder(64).column(F.col("embedding_text")))
    all_of = retrieval.channels(c, retrieval.postings(c), retrieval.corpus_stats(c), HashEmbedder(64))
    assert len(all_of) == 6
    q = queries_of(spark, ["elm wood", "beech"])
    for kind in ("dense", "sparse", "hybrid"):
        notes = all_of[kind, "note"](q, 2).where("rank = 0").orderBy("query_id").collect()
        assert [r.note_path for r in notes] == ["n001", "n003"] and set(notes[0].asDict()) == {"query_id", "note_path", "rank"}
        first = all_of[kind, "chunk"](q, 2).where("rank = 0 and query_id = 1").first()
        assert (first.note_path, first.text) == ("n003", "beech nut")
    with pytest.raises(ValueError):
        retrieval.channel("odd", "note", c, c, c, HashEmbedder())
    cases = spark.createDataFrame([(0, "elm wood", ["n001"], "same"), (1, "beech", ["n000"], "other")], "query_id long, query string, expected array<string>, scenario string")
    got = {(r.channel, r.scenario): (r.n, r.recall) for r in evaluate.run_eval(all_of, cases, 1, 10).collect()}
    assert got["sparse", "same"] == (1, 1.0) and got["dense", "other"] == (1, 0.0) and got["hybrid", "overall"] == (2, 0.5)
    spans = "query_id long, query string, type string, expected_notes array<string>, answer_spans array<struct<note:string,text:string>>"
    cases = spark.createDataFrame([(0, "elm wood", "buried", ["n001"], [("n001", "ELM  wood")]), (1, "ash", "buried", ["n002"], [("n002", "none")])], spans)
    row = evaluate.evaluate_spans(all_of["sparse", "chunk"], cases, 1, 10).where("type = 'overall'").first()
    assert (row.n, row.span_recall, row.note_recall) == (2, 0.5, 1.0)
    on, search = c.withColumn("context_blurb", F.lit("about")), all_of["sparse", "chunk"]
    assert evaluate.run_contextual_eval(search, search, on, cases, 1, 10).where("type = 'buried'").first().span_recall_delta == 0.0
    with pytest.raises(ValueError, match="n000"):
        evaluate.run_contextual_eval(search, search, on.withColumn("context_blurb", F.lit(None)), cases)


def test_case_scores_and_report(spark):
    cases = spark.createDataFrame([(0, ["a"], "same"), (1, ["b", "z"], "same"), (2, ["q"], "it→en")], "query_id long, expected array<string>, scenario string")
    got = spark.createDataFrame([(0, "x", 0), (0, "y", 1), (0, "a", 2), (1, "b", 0)], "query_id long, note_path string, rank int")
    scored = evaluate.case_scores(cases, got, 2)
    assert {r.query_id: (r.recall, round(r.mrr, 3)) for r in scored.collect()} == {0: (0.0, 0.333), 1: (1.0, 1.0), 2: (0.0, 0.0)}
    rows = {r.scenario: (r.n, r.recall) for r in evaluate.report(scored, "scenario").collect()}
    assert rows == {"same": (2, 0.5), "it→en": (1, 0.0), "overall": (3, pytest.approx(1 / 3))}
    none = evaluate.report(scored.limit(0), "scenario").collect()
    assert [(r.scenario, r.n, r.recall) for r in none] == [("overall", 0, 0.0)]
    text = evaluate.format_delta(evaluate.delta(evaluate.report(scored, "scenario"), evaluate.report(scored.withColumn("recall", F.lit(1.0)), "scenario"), "scenario"), "scenario")
    assert "recall 0.500 → 1.000 (+0.500)" in text and "overall" in evaluate.format_report(evaluate.report(scored, "scenario"), "scenario")


def test_span_scores(spark):
    spans = "query_id long, expected_notes array<string>, answer_spans array<struct<note:string,text:string>>"
    cases = spark.createDataFrame([(0, ["n"], [("n", "The  answer")])], spans)
    got = spark.createDataFrame([(0, "other", 0, "the answer"), (0, "m", 1, "no"), (0, "n", 2, "here: THE\nanswer."), (0, "n", 3, "x")], "query_id long, note_path string, rank int, text string")
    score = lambda k: evaluate.span_case_scores(cases, got, k).first()
    assert (score(1).span_recall, score(3).span_recall, round(score(1).span_mrr, 3), score(3).note_recall) == (0.0, 1.0, 0.333, 1.0)


def test_gold_errors_keep_going(spark):
    schema = "case_no int, query string, type string, expected_notes array<string>, answer_spans array<struct<note:string,text:string>>"
    cases = spark.createDataFrame([(0, "q", "odd", ["a", "zz"], [("zz", "x"), ("b", "hit"), ("a", "miss")]), (1, "q", "buried", [], [])], schema)
    notes = spark.createDataFrame([("a", "text"), ("b", "a HIT here")], "path string, text string")
    got = evaluate.gold_errors(cases, notes).orderBy("case_no", "check_no", "item_no").collect()
    assert [(r.case_no, r.check_no, r.item_no) for r in got] == [(0, 1, -1), (0, 3, 1), (0, 4, 0), (0, 5, 2), (0, 6, 1), (1, 0, -1), (1, 2, -1)]


def test_providers(spark):
    for p, kind in ((HashEmbedder(), Embedder), (PlainContext(), Contextualizer), (PlainRerank(), Reranker), (ChatContext(None, "m"), Contextualizer)):
        assert isinstance(p, kind)
    rows = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    v = [r.v for r in rows.select(HashEmbedder(8).column(F.coalesce("t", F.lit(""))).alias("v")).collect()]
    assert sum(x * x for x in v[0]) == pytest.approx(1.0, abs=1e-6) and v[1] == [0.0] * 8
    own = ModelEmbedder(lambda: lambda texts: [[float(len(t))] for t in texts], 1, "len:1")
    assert [r.v for r in rows.select(own.column(F.col("t")).alias("v")).collect()] == [[3.0], [0.0], [0.0]]
    answers = {"good": '{"choices": [{"message": {"content": " hi "}}]}', "bad": "{}"}
    assert HttpChat("http://x/v1", "m", post=lambda *a: answers["good"]).complete("s", "u") == "hi"
    seen = []
    http = HttpEmbedder("http://x/v1", "m", 2, batch=2, post=lambda url, head, body, wait: seen.append(url) or json.dumps({"data": [{"index": 1 - i, "embedding": [float(i), 0.0]} for i in range(len(json.loads(body)["input"]))]}))
    assert http.vectors(["a", "b"]) == [[1.0, 0.0], [0.0, 0.0]] and seen == ["http://x/v1/embeddings"]
    assert embedder_of("http", 2, {"base_url": "u", "model": "m"}).fingerprint == "http:m:2" and embedder_of("hash", 8, {}) == HashEmbedder(8)
    assert isinstance(reranker_of("none", {}), PlainRerank) and reranker_of("builtins:dict", {"a": 1}) == {"a": 1}
    with pytest.raises(ValueError, match="no reranker"):
        reranker_of("odd", {})
    with pytest.raises(ChatError):
        HttpChat("http://x/v1", "m", post=lambda *a: answers["bad"]).complete("s", "u")
    assert isinstance(or_plain(lambda: 1 / 0, PlainRerank(), "it"), PlainRerank)
