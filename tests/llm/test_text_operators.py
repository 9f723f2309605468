import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import decontam, langid, line_dedup, ngram_join
from lodestone.llm.common import connected_components
from lodestone.llm.queries import NGRAM_SQL

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, removed string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, l, "s", len(t or ""), "x", "y") for d, t, l in rows], FIELDS)


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def sentences(rng, n):
    return " ".join(prose(rng, rng.randint(6, 12)).capitalize() + "." for _ in range(n))


def test_ngram_join_equals_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.choice([3, 40, 200])), "en") for i in range(60)]
    for k in range(40):
        base = rows[k % 3][1] if k % 2 else rows[5][1]
        w = base.split()
        if k > 3:
            for _ in range(rng.randint(1, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = "changed%d" % k
        rows.append((100 + k, " ".join(w), "en"))
    rows += [(900, None, None), (901, "", "de"), (902, " \n", "de"), (903, "one", None), (904, "One", None), (905, "x " * 20000, "en")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_documents(frame(spark, rows)).collect()}
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})  # noqa: F841
    want = {d: (c, n) for d, c, n in duckdb.sql(NGRAM_SQL).fetchall()}
    assert got == want
    assert max(n for _, n in want.values()) > 4


def test_ngram_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(2)
    base = prose(rng, 300).split()
    rows = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(w), "en"))
    out = ngram_join.similar_documents(frame(spark, rows)).collect()
    assert {(r.class_id, r.n_links) for r in out} == {(0, 89)}
    assert [r.doc_id for r in ngram_join.one_of_each(frame(spark, rows)).collect()] == [0]


def test_ngram_join_of_large_buckets_equals_all_pairs(spark, monkeypatch):
    """Groups of near, less near and exact copies, with two centers, so that cores, blocks of the rest and pairs between them all occur."""
    monkeypatch.setattr(ngram_join, "SMALL", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(12)
    base = prose(rng, 200).split()
    second = list(base)
    for k in (20, 90, 150):
        second[k] = f"second{k}"
    rows = []
    for i in range(110):
        w = list(base if i % 3 else second)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5])):
            w[rng.randrange(200)] = f"new{rng.randrange(1000)}"
        rows.append((i, " ".join(w), "en"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_documents(frame(spark, rows)).collect()}
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})  # noqa: F841
    want = {d: (c, n) for d, c, n in duckdb.sql(NGRAM_SQL).fetchall()}
    assert got == want and len({n for _, n in want.values()}) > 10


def test_ngram_join_recalls_pairs_at_the_threshold(spark):
    """Pairs whose similarity is just 0.8 or little more, which share a path least often: at least 99 % are found, and no pair under it."""
    rng, rows, near = random.Random(13), [], set()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k in range(300):
        a = prose(rng, 104, "abcdefghijklm").split()
        b = list(a)
        b[30], b[70] = "other", "words"
        b[104 - rng.randint(0, 3) :] = []
        rows += [(2 * k, " ".join(a), "en"), (2 * k + 1, " ".join(b), "en")]
        x, y = grams(a), grams(b)
        if len(x & y) >= 0.8 * len(x | y) - 1e-9:
            near.add(2 * k + 1)
    found = {r.doc_id for r in ngram_join.similar_documents(frame(spark, rows)).collect() if r.class_id != r.doc_id}
    assert found <= near and 100 < len(near) < 300 and len(found) >= 0.99 * len(near)


def test_ngram_join_of_odd_rows(spark):
    out = ngram_join.similar_documents(frame(spark, [(None, "a b c d e f", "en"), (7, "a b c d e f", None), (7, "a b c d e f", None)])).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in out) == [("7", "7", 1), ("7", "7", 1), ("None", "None", 0)]
    assert ngram_join.similar_documents(frame(spark, []).limit(0)).count() == 0


def test_line_dedup_cuts_later_passages_only(spark):
    rng = random.Random(3)
    passage = sentences(rng, 8)
    own = [sentences(rng, 12) for _ in range(12)]
    rows = []
    for i, t in enumerate(own):
        w = t.split()
        k = rng.randrange(len(w))
        rows.append((i, " ".join(w[:k]) + " " + passage + " " + " ".join(w[k:]) if i % 2 == 0 else t, "en"))
    rows += [(50, None, "en"), (51, "", "en"), (52, own[1], "en"), (None, sentences(rng, 5), "en"), (60, "a" * 50000, "en"), (61, "Yes. No.\n" * 3000, "en")]
    out = {r.doc_id: r for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert out[0].text == rows[0][1] and passage.split()[30] in out[0].text
    for i in range(1, 12):
        assert out[i].text.split() == own[i].split(), i
        assert out[i].n_chars == len(out[i].text)
    assert out[52].text == "" and out[50].text is None and out[60].text == "a" * 50000
    assert out[None].text == rows[15][1] and out[0]["class_id"] == "x"
    kept = line_dedup.without_repeats(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t, _ in rows if d != 52)
    assert line_dedup.remove_repeats(frame(spark, []).limit(0)).count() == 0


def test_chunks_do_not_depend_on_where_lines_stand():
    rng = random.Random(4)
    a = sentences(rng, 40)
    _, pos, room, key = line_dedup.chunks_of(pa.array([a]))
    _, _, _, key2 = line_dedup.chunks_of(pa.array([sentences(rng, 3) + " " + a]))
    assert len(set(key.tolist()) & set(key2.tolist())) >= len(key) - 2
    assert all(len(a[p - x : p + n].split()) >= line_dedup.LEAST_WORDS for p, x, n in zip(pos, *room, strict=True))


def planted(spark, rng, passages, cut):
    """How many of the passages are removed (but for two words at either end) from a second document, each put between texts of its own; cut: beside no ends of lines."""
    rows = []
    for i, passage in enumerate(passages):
        for k in range(2):
            beside = [prose(rng, 30, "mnopqrst") + ("" if cut else ".") for _ in range(2)]
            rows.append((2 * i + k, f"{beside[0]} {passage} {beside[1]}", "en"))
    out = {r.doc_id: r.text for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert all(out[d] == t for d, t, _ in rows if d % 2 == 0)
    return sum(len(out[2 * i + 1].split()) <= 64 for i in range(len(passages)))


def test_line_dedup_finds_short_passages_whatever_is_beside_them(spark):
    rng = random.Random(21)
    passages = [" ".join(prose(rng, w // n).capitalize() + "." for _ in range(n)) for n in (2, 3, 4, 5) for w in (50, 60, 80) for _ in range(5)]
    assert planted(spark, rng, passages, False) == len(passages)


def test_line_dedup_finds_passages_inside_lines(spark):
    rng = random.Random(22)
    plain = [prose(rng, w) for w in (24, 51, 120) for _ in range(8)]
    one_sentence = [prose(rng, 18) + ". " + prose(rng, 30).capitalize() + ". " + prose(rng, 14) for _ in range(8)]
    assert planted(spark, rng, plain + one_sentence, True) == 32


def test_line_dedup_extends_to_the_first_word_that_differs(spark):
    rng = random.Random(23)
    words = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(60)]
    beside = [prose(rng, 30, "mnopqrst") for _ in range(4)]
    rows = [(i, f"{beside[2 * i]} {' '.join(words)} {beside[2 * i + 1]}", "en") for i in range(2)]
    out = {r.doc_id: r.text for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert out[0] == rows[0][1] and out[1].split() == (beside[2] + " " + beside[3]).split()


def plain_tiles(doc, item, least):
    """Greedy string tiling as it is written: all longest unmarked matches, in each round."""
    md, mi, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best, at = least - 1, None
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not md[i + k] and not mi[j + k]:
                    k += 1
                if k > best:
                    best, at = k, (i, j)
        if not at:
            return total / len(item)
        for k in range(best):
            md[at[0] + k] = mi[at[1] + k] = True
        total += best


def test_tiling_finds_reordered_items(spark):
    rng = random.Random(5)
    items = [prose(rng, 30) for _ in range(6)] + ["too short", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = []
    for i in range(30):
        w = items[i % 6].split()
        inner = {0: w, 1: w[15:] + prose(rng, 4).split() + w[:15], 2: w[:17], 3: w[20:] + w[10:20] + w[:10]}.get(i % 5, [])
        text = prose(rng, 25) + " " + " ".join(inner).upper().replace(" ", ", ") + " " + prose(rng, 25)
        rows.append((i, text, "en"))
    rows += [(90, None, None), (91, "", None), (92, "a b c d e " * 9000, "en"), (None, items[2], "en")]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id): r.coverage for r in decontam.overlaps(docs, bench).collect()}
    want = {}
    for d, t, _ in rows:
        for k, item in enumerate(items[:6]):
            a = [decontam.plain(x) for x in (t or "").lower().split()]
            if len(a) < 200 and (c := plain_tiles(a, item.split(), 5)) >= 0.6:
                want[d, k] = c
    assert got == pytest.approx(want)
    assert {i % 5 for i, _ in got if i is not None} == {0, 1, 3}
    left = decontam.decontaminate(docs, bench)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _, _ in rows if d is not None and (d, d % 6) not in want)
    assert decontam.overlaps(docs, bench.limit(0)).count() == 0 and decontam.overlaps(docs.limit(0), bench).count() == 0


def test_tiling_when_the_table_of_bits_is_full(spark, monkeypatch):
    rng = random.Random(6)
    items = [prose(rng, 20) for _ in range(5)]
    bench = spark.createDataFrame([*enumerate(items), (None, items[0])], "item_id long, text string")
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(items)] + [(9, prose(rng, 50), "en"), (1, items[1], "en")])
    monkeypatch.setattr(decontam, "CELLS", 2)
    found = sorted((r.doc_id, str(r.item_id)) for r in decontam.overlaps(docs, bench).collect())
    assert found == sorted([(i, str(i)) for i in range(5)] + [(0, "None"), (1, "1")])


def test_tiles_equal_plain_ones_of_few_words():
    rng = random.Random(7)
    for k in range(60):
        item = [rng.choice("abc") for _ in range(rng.randint(5, 30))]
        doc = [rng.choice("abcd") for _ in range(rng.randint(0, 60))] + item[3 : 3 + rng.randint(0, 20)]
        got = decontam.tile(doc, item)
        assert sum(x[2] for x in got) / len(item) == pytest.approx(plain_tiles(doc, item, 5))
        assert all(doc[i : i + n] == item[j : j + n] for i, j, n in got)
    assert sum(x[2] for x in decontam.tile(["x"] * 30000, ["x"] * 400)) == 400


def test_compiled_network_equals_the_plain_one():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (64, langid.WINDOW)).astype(np.uint8)
    net = langid.train(windows, rng.integers(0, 3, 64), ["a", "b", "c"], epochs=2)
    data = windows[:4].reshape(-1)
    got = langid.apply(net, net.tables(), data, np.arange(4) * 256, np.arange(1, 5) * 256)
    e = net.embed[windows[:4]]
    z = np.stack([sum(e[:, p + j] @ net.filters[j] for j in range(4)) for p in range(253)], 1)
    logit = np.maximum(z.max(1) + net.bias, 0) @ net.dense + net.out_bias
    want = np.exp(logit) / np.exp(logit).sum(1, keepdims=True)
    assert np.allclose(got, want, atol=1e-4)


def test_network_in_segments_equals_whole_texts(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 9000).astype(np.uint8)
    net = langid.train(data[:8192].reshape(-1, 256), rng.integers(0, 3, 32), ["a", "b", "c"], epochs=1)
    at = np.array([0, 0, 300, 7000, 7001, 9000])
    want = langid.apply(net, net.tables(), data, at[:-1], at[1:])
    monkeypatch.setattr(langid, "SEGMENT", 512)
    assert np.allclose(langid.apply(net, net.tables(), data, at[:-1], at[1:]), want, atol=1e-6)


def test_every_language_is_learned(spark):
    rng = random.Random(35)
    rows = [(i, prose(rng, 30), "aa") for i in range(80)]
    for k in range(6):
        repeated = [(1000 + k, f"eins zwei {k} drei vier fuenf sechs", "de")] * 60
        docs = frame(spark, rows + repeated + [(2000 + k, f"qq rr ss tt {k} uu vv ww", "zz")])
        assert langid.fit(docs, ~langid.held_out() | (docs.doc_id >= 1000), per_lang=2).langs == ["aa", "de", "zz"]


def test_language_id_on_odd_rows_and_held_out_text(spark):
    rng = random.Random(7)
    sets = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, prose(rng, rng.randint(5, 200), sets[l]), l) for i, l in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "123 !!", "aa"), (503, prose(rng, 9000, sets["bb"]), None), (None, "abc abd", "aa"), (1, rows[1][1], "bb")]
    docs = frame(spark, rows)
    net = langid.fit(docs, ~langid.held_out())
    out = langid.predict_languages(docs, net).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[k].lang_pred for k in (500, 501, 502, 503)] == ["und", "und", "und", "bb"]
    right = [by[d].lang_pred == l for d, t, l in rows[:120] if by[d].held_out]
    assert len(right) > 10 and sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 for r in out)
    kept = langid.keep_identified(docs, net)
    assert kept.columns == docs.columns and not {500, 501, 502} & {r.doc_id for r in kept.collect()}
    empty = docs.limit(0)
    assert langid.predict_languages(empty, langid.fit(empty, ~langid.held_out())).count() == 0


def test_ngram_join_of_one_id_with_several_texts(spark):
    rng = random.Random(31)
    a, b = prose(rng, 60), prose(rng, 60)
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(1, a, "en"), (1, b, "en"), (2, near(a), "en"), (3, near(b), "en"), (3, near(b), "en")]
    out = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_documents(frame(spark, rows)).collect())
    assert out == [(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (3, 1, 2)]
    assert sorted((r.doc_id, r.text) for r in ngram_join.one_of_each(frame(spark, rows)).collect()) == sorted([(1, a), (1, b)])


def test_components_leave_no_shuffle_files_of_their_rounds(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}

    before = files()
    parts = connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"))
    for _ in range(20):  # they are removed in the background
        left = {name.split("_")[1] for name in files() - before}
        if len(left) <= 12:
            break
        time.sleep(0.5)
    assert len(left) <= 12  # one of each round's sum of edges
    assert {(r.node, r.component) for r in parts.collect()} == {(i, 0) for i in range(61)}


def test_ngram_join_deals_many_large_nodes_by_salts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "HEAVY_ROWS", 0)
    rng = random.Random(32)
    base = prose(rng, 200).split()
    rows = [(i, " ".join([*base[:40], f"new{i}", *base[41:]]), "en") for i in range(40)]
    out = ngram_join.similar_documents(frame(spark, rows)).collect()
    assert {(r.class_id, r.n_links) for r in out} == {(0, 39)}


def test_line_dedup_of_null_and_repeated_ids(spark):
    rng = random.Random(33)
    passage = prose(rng, 40)
    texts = [f"{prose(rng, 30, 'mnopqrst')} {passage} {prose(rng, 30, 'mnopqrst')}" for _ in range(3)]
    for ids in ((1, 2, 3), (None, None, None), (5, 5, 5)):
        rows = [(d, t, "en") for d, t in zip(ids, texts, strict=True)]
        out = [len(r.text.split()) for r in line_dedup.remove_repeats(frame(spark, rows).coalesce(1)).collect()]
        assert sorted(out) == [60, 60, 100], ids
    same = line_dedup.without_repeats(frame(spark, [(None, texts[0], "en")] * 30)).collect()
    assert [r.text for r in same] == [texts[0]]


def test_line_dedup_removes_what_all_pairs_of_words_would(spark):
    """Against a plain search: every word of a run of 24 that an earlier text holds goes; no word goes that isn't in an earlier run of 20."""
    rng = random.Random(34)
    stock = [prose(rng, n) for n in (24, 30, 50, 90)]
    rows = []
    for i in range(30):
        parts = [prose(rng, rng.randint(1, 40), "mnopqrst") + f" u{i}{k} " + (rng.choice(stock) if rng.random() < 0.6 else "") for k in range(4)]
        rows.append((i, " ".join(parts) + f" end{i}", "en"))
    got = {r.doc_id: r for r in line_dedup.remove_repeats(frame(spark, rows).coalesce(1)).collect()}
    seen: set = set()
    for i, t, _ in rows:
        w = t.split()
        must, may = set(), set()
        for n, hit in ((24, must), (20, may)):
            for a in range(len(w) - n + 1):
                if (n, tuple(w[a : a + n])) in seen:
                    hit.update(range(a, a + n))
        for n in (20, 24):
            seen.update((n, tuple(w[a : a + n])) for a in range(len(w) - n + 1))
            for a in range(len(w) - n + 1):  # repeats within the text itself
                if any(w[a : a + n] == w[b : b + n] for b in range(a)):
                    (must if n == 24 else may).update(range(a, a + n))
        kept = got[i].text.split()
        assert len(w) - len(may) <= len(kept) <= len(w) - len(must), i
        assert [x for k, x in enumerate(w) if k not in may] == [x for x in kept if x not in {w[k] for k in may}] or set(kept) <= set(w)
