import random

import pytest

import corpus_pipeline
from lodestone.llm.packing import WordIds

P = pytest.importorskip("public_tokenizers")


def prose(rng, n, letters):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def sentences(rng, n, letters="abcdefgh"):
    return " ".join(prose(rng, rng.randint(6, 12), letters).capitalize() + "." for _ in range(n))


def test_each_decision_takes_effect(spark, tmp_path):
    rng = random.Random(9)
    sets = {"aa": "abcdefgh", "bb": "stuvwxyz"}
    rows = [(i, sentences(rng, 6, sets[lang]), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    passage, item = sentences(rng, 8), prose(rng, 24, "abcdefgh")
    rows[10] = (10, rows[10][1] + " " + passage, "aa")
    own = rows[20][1]
    rows[20] = (20, own + " " + passage, "aa")
    rows.append((70, prose(rng, 20, "abcdefgh") + " " + item + " " + prose(rng, 20, "abcdefgh"), "aa"))
    near = prose(rng, 36, "stuvwxyz").split()
    rows += [(80, " ".join(near), "bb"), (81, " ".join(near[:-1] + ["tu"]), "bb"), (82, " ".join(["vw"] + near[1:]), "bb")]
    rows += [(90, "123 456 !!", "aa"), (91, None, "bb"), (92, "", "aa"), (93, rows[3][1], "bb")]
    d = str(tmp_path)
    frame = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item), (1, "unseen words of no document at all here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    text = {i: t for i, t, _ in rows} | {20: own}
    gone = {70, 81, 82, 90, 91, 92, 93}
    assert {r.doc_id for r in out} == {i for i, _, _ in rows} - gone
    enc = WordIds(P.path("word_bpe_49k.json"))
    for i in {r.doc_id for r in out}:
        want = sum(len(enc.ids(w)) for w in text[i].split()) + 1
        assert sum(r.length for r in out if r.doc_id == i) == want, i


def test_stages_keep_the_columns_of_documents(spark):
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "some words here", "aa", "s", 15), (2, None, None, None, None)], fields)
    benchmark = spark.createDataFrame([(0, "an item of seven words or so")], "item_id long, text string")
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.dedup_lines, corpus_pipeline.drop_near_copies):
        assert stage(spark, docs, "").columns == docs.columns
    from lodestone.llm import decontam

    assert decontam.decontaminate(docs, benchmark).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, FIELDS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "a", [], [])).count() == 0
    one = [(1, "some words of one language and no other", "aa", None, None)]
    assert {r.doc_id for r in corpus_pipeline.run(spark, write(spark, tmp_path / "b", one, [])).collect()} == {1}


def test_pipeline_of_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(10)
    sets = {"aa": "abcdefgh", "bb": "stuvwxyz"}
    clean = [(i, sentences(rng, 6, sets[lang]), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    item, own = prose(rng, 24, "abcdefgh"), [sentences(rng, 6) for _ in range(5)]
    rows = clean + [(None, own[0], "aa"), (None, own[0], "aa"), (None, own[1], None), (500, own[2], "aa"), (500, own[3], "aa"), (500, own[3], "aa"), (None, item, "aa"), (501, own[4] + " " + item, "aa"), (None, None, None)]
    d = write(spark, tmp_path / "c", [(i, t, lang, "s", len(t or "")) for i, t, lang in rows], [(0, item), (None, None)])
    out = corpus_pipeline.run(spark, d).collect()
    enc = WordIds(P.path("word_bpe_49k.json"))
    want = [(i, t) for i, t, _ in clean] + [(None, own[0]), (None, own[1]), (500, own[2]), (500, own[3]), (501, own[4])]  # the item is cut from the last as a repeat
    size = lambda t: sum(len(enc.ids(w)) for w in t.split()) + 1
    assert sum(r.length for r in out) == sum(size(t) for _, t in want)
    for i in {i for i, _ in want}:
        assert sum(r.length for r in out if r.doc_id == i) == sum(size(t) for k, t in want if k == i), i
