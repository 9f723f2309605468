import math
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import lm_scoring as lm
from lodestone.llm.common import words

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


def model(monkeypatch, m=8, groups=4, seed=1):
    """A small model: classes are symbols, of which the last two are BOS and END."""
    monkeypatch.setattr(lm, "CLASSES", m)
    monkeypatch.setattr(lm, "GROUPS", groups)
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 1, v.shape).astype(np.float32) for k, v in lm.fresh_parameters(m, groups).items()}
    table = rng.dirichlet(np.ones(m), m)
    table[:, m - 2] = 1e-12
    return lm.Lm(np.arange(m), np.zeros(m), np.log(table).astype(np.float32).reshape(m, groups, -1).transpose(1, 0, 2).copy(), np.log(table.reshape(m, groups, -1).sum(2)).astype(np.float32), p)


def texts(net, rng, sizes):
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return net.classes(rng.integers(0, len(net.of) - 2, starts[-1]), starts)


def test_windows_score_each_symbol_once_and_causally(monkeypatch):
    net, rng = model(monkeypatch), np.random.default_rng(2)
    x, begin = texts(net, rng, [0, 1, lm.STRIDE - 1, lm.STRIDE, lm.STRIDE + 1, 150])
    _, _, goal, real = lm.windows(x, begin)
    seen = np.bincount(goal[real], minlength=len(x))
    assert (np.delete(seen, begin[:-1]) == 1).all() and (seen[begin[:-1]] == 0).all()
    log = lm.symbol_logs(net, x, begin)
    assert np.allclose(lm.symbol_logs(net, x, begin, block=1, many=2), log, atol=1e-5)
    for cut in (5, 40, 100):
        y = x[begin[5] :].copy()
        y[cut:] = (y[cut:] + 1) % 6
        assert np.allclose(lm.symbol_logs(net, y, np.array([0, len(y)]))[:cut], log[begin[5] :][:cut], atol=1e-5)


def test_probabilities_of_the_next_symbol_add_up_to_one(monkeypatch):
    net = model(monkeypatch)
    total = 0
    for c in [*range(6), 7]:
        x = np.array([6, 2, 3, 1, 5, 2, c])
        total += np.exp(lm.symbol_logs(net, x, np.array([0, 7]))[6])
    assert total == pytest.approx(1, abs=1e-4)


def plain_logs(net, x):
    """Every place by loops, over the window that scores it."""
    p, size, out = net.p, net.p["bias"].shape[1], [0.0]
    for t in range(1, len(x)):
        low = max(0, (t - 1) // lm.STRIDE * lm.STRIDE - lm.CONTEXT)
        got = []
        for h in range(lm.HEADS):
            s = np.array([p["query"][x[t - 1], h] @ p["key"][x[j], h] + p["offset"][h, t - 1 - j] for j in range(low, t)])
            a = np.exp(s - s.max())
            got.append((a / a.sum()) @ np.array([p["value"][x[j], h] for j in range(low, t)]))
        g = np.concatenate(got)
        z = net.groups[x[t - 1]] + g @ p["group_out"] + p["group_bias"]
        n = x[t] // size
        y = net.table[n, x[t - 1]] + g @ p["out"][n] + p["bias"][n]
        out.append(z[n] - np.log(np.exp(z).sum()) + y[x[t] % size] - np.log(np.exp(y).sum()))
    return np.array(out)


def test_attention_equals_plain_loops(monkeypatch):
    net, rng = model(monkeypatch), np.random.default_rng(4)
    x, begin = texts(net, rng, [90])
    assert np.allclose(lm.symbol_logs(net, x, begin), plain_logs(net, x), atol=1e-3)


def test_gradients_equal_differences(monkeypatch):
    net, rng = model(monkeypatch), np.random.default_rng(5)
    x, begin = texts(net, rng, [40, 10])
    keys, there, goal, real = lm.windows(x, begin)
    loss = lambda: -lm.symbol_logs(net, x, begin).sum() / real.sum()
    g = lm.gradients(net, net.p, keys, there, x[goal], real)
    for name, w in net.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        old, e = w[at], 0.02
        w[at] = old + e
        up = loss()
        w[at] = old - e
        down = loss()
        w[at] = old
        assert (up - down) / (2 * e) == pytest.approx(float(g[name][at]), rel=0.05, abs=1e-4), name


def test_words_add_up_their_symbols(monkeypatch):
    net = model(monkeypatch)
    symbols, starts = np.array([0, 3, 2, 4, 5, 1]), np.array([0, 4, 4, 6])  # odd symbols end words: [0 3] [2 4.. runs on to the end
    symbols[3] = 5
    x, begin = net.classes(symbols, starts)
    log = lm.symbol_logs(net, x, begin)
    want = [log[1] + log[2], log[3] + log[4], log[5], log[7], log[9], log[10], log[11]]
    assert np.allclose(lm.word_logs(net, symbols, starts), want, atol=1e-5)


def test_base_scores_and_gain(spark):
    rng = random.Random(3)
    sets = [["la", "le", "mer", "sur"], ["the", "of", "sea", "on"]]
    docs = []
    for i in range(160):
        own = sets[i % 2]
        docs.append((i, " ".join("".join(rng.choices(own, k=rng.choice([1, 1, 2, 3]))) for _ in range(rng.randint(5, 60))).capitalize()))
    docs += [(500, None), (501, ""), (502, "ÉA\x0bb\x1cc " * 5000), (503, "x" * 20000), (None, "La mer"), (4, docs[4][1])]
    frame = spark.createDataFrame([(d, t, 1.5) for d, t in docs], "doc_id long, text string, score double")
    got = lm.score_documents(frame, PATH).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = {}
    for d, t in docs:
        if not held(d):
            for w in [*split(t), ""]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*split(t), ""])
    text = dict(docs)
    assert len(got) == len(docs)
    for r in got:
        t = text[r.doc_id]
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(split(t)) + 1 and r.train_tokens == n
        assert r.n_known == sum(w in counts for w in [*split(t), ""])
        assert r.base_score == pytest.approx(base(t), rel=1e-6)
        assert r.score < 0 and math.isfinite(r.score)
    ours = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 160]
    assert sum(r.score for r in ours) > sum(r.base_score for r in ours)
    assert lm.score_documents(frame.limit(0), PATH).count() == 0


def test_scores_do_not_depend_on_the_size_of_the_lexicon(spark):
    rng = random.Random(8)
    docs = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(40))) for i in range(40)] + [(90, None), (91, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole, small = ({r.doc_id: r for r in lm.score_documents(frame, PATH, n).collect()} for n in (lm.LEXICON, 3))
    for d, a in whole.items():
        b = small[d]
        assert (a.n_tokens, a.n_known, a.train_tokens) == (b.n_tokens, b.n_known, b.train_tokens)
        assert a.base_score == pytest.approx(b.base_score, rel=1e-9) and a.attention_score == pytest.approx(b.attention_score, rel=1e-4)
    assert sum(a.n_known for a in whole.values()) > 1000


def test_windows_are_drawn_at_one_rate_from_all_texts():
    begin = np.arange(0, 3_300_000, 330)
    got = np.concatenate([lm.drawn(np.arange(len(begin) - 1) + (5 << 40), begin, k) for k in range(lm.ROUNDS)])
    n = -(-329 // lm.STRIDE)
    assert len(got) / (n * (len(begin) - 1)) == pytest.approx(lm.SHARE, rel=0.05)
    assert len(set((got % n).tolist())) == n


def test_drawn_windows_are_those_that_score(monkeypatch):
    monkeypatch.setattr(lm, "SHARE", 1.2)
    rng = np.random.default_rng(6)
    sizes = [0, 1, lm.STRIDE - 1, lm.STRIDE, lm.STRIDE + 1, 300, 7]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    symbols, learned = rng.integers(0, 50, starts[-1]), np.array([True] * 6 + [False])
    flat, cuts = lm.window_rows(symbols, starts, np.arange(7) + (3 << 40), learned, 50)
    x, begin, _ = lm.with_ends(symbols, starts, 50, 51)
    seen = 0
    for turn in range(lm.ROUNDS):
        only = lm.drawn(np.arange(7) + (3 << 40), begin, turn)
        keys, there, goal, real = lm.windows(x, begin, only[only < (-(-(np.diff(begin)[:6] - 1) // lm.STRIDE)).sum()])
        got = flat.reshape(-1, lm.KEYS + 2)
        got = got[got[:, 0] == turn, 1:]
        assert (np.where(there, keys, -1) == got[:, : lm.KEYS]).all() and (np.where(real, x[goal], -1) == got[:, lm.CONTEXT + 1 :]).all()
        seen += len(got)
    assert seen > 8 and cuts[-1] == len(flat) and cuts[-1] == cuts[-2]


def test_each_window_is_learned_from_in_one_round():
    begin = np.arange(0, 330_000, 330)
    got = np.concatenate([lm.drawn(np.arange(len(begin) - 1) + (5 << 40), begin, k) for k in range(lm.ROUNDS)])
    assert np.sort(got).tolist() == list(range(-(-329 // lm.STRIDE) * (len(begin) - 1)))


def test_all_training_words_decide_on_the_weight(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("bcdfghklmnprstvwxz") for _ in range(9)) for _ in range(30)]
    docs = [(i, " ".join(rng.choices(vocab, k=20))) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole, small = ({r.doc_id: r for r in lm.score_documents(frame, PATH, n).collect()} for n in (lm.LEXICON, 3))
    for d, a in whole.items():
        assert a.score == pytest.approx(small[d].score, rel=1e-4)


class Here:
    """What a table function needs of a table, run in this process."""

    def __init__(self, batches):
        self.batches = batches

    sparkSession = sparkContext = property(lambda self: self)
    select = lambda self, *columns: self
    broadcast = lambda self, value: type("Shared", (), {"value": value})
    transform = lambda self, how, run, schema: list(run(iter(self.batches)))


def test_only_words_outside_the_lexicon_are_cut_by_each_task(monkeypatch, spark):
    import pyarrow as pa

    cut, plain = [], lm.word_symbols
    monkeypatch.setattr(lm, "word_symbols", lambda vocab, path: (cut.append(vocab), plain(vocab, path))[1])
    texts = ["La mer, la terre", None, "zyx la zyx mer, x"]
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([False, True, False]), pa.array(texts)], ["doc_id", "held_out", "text"])
    (got,) = lm.tokenized(Here([b]), pa.array(["", "mer,", "la"]), PATH)
    assert [sorted(v) for v in cut] == [["la", "mer,"], ["terre", "x", "zyx"]]
    assert got.column("rare").to_pylist() == [["terre"], [], ["zyx", "zyx", "x"]]
    assert lm.numbers(got.column("places"))[0].tolist() == [2, 1, 2, -1, -1, 2, -1, 1, -1]
    flat, starts = lm.numbers(got.column("symbols"))
    for i, t in enumerate(texts):
        want = [x for w in (t or "").lower().split() for x in plain([w], PATH)[0].tolist()]
        assert flat[starts[i] : starts[i + 1]].tolist() == want


def test_mixtures_equal_plain_logarithms():
    rng = np.random.default_rng(12)
    log = rng.normal(-12, 6, 3000).clip(max=-1e-6)
    log[::7] = -900  # exp of it is 0
    share = np.where(rng.random(3000) < 0.4, 0, rng.random(3000) ** 8)
    starts = np.array([0, 1, 2, 130, 131, 900, 2999])
    with np.errstate(divide="ignore"):
        plain = np.stack([np.logaddexp(np.log(w) + np.log(share), np.log(1 - w) + log) for w in lm.WEIGHTS], axis=1)
    assert np.allclose(lm.mixtures(share, log, starts), np.add.reduceat(plain, starts), rtol=1e-12)


def test_great_scores_and_logits_are_cut_off(monkeypatch):
    net, rng = model(monkeypatch), np.random.default_rng(13)
    net.p["query"] *= 40
    net.p["out"] *= 200
    x, begin = texts(net, rng, [70])
    log = lm.symbol_logs(net, x, begin)
    assert np.isfinite(log).all() and (log <= 1e-5).all()
    z = np.array([[500, 70, 1], [-3, 2, 0.5]], np.float32)
    want = np.minimum(z, 60).astype(float)
    want -= np.log(np.exp(want).sum(1, keepdims=True))
    assert np.allclose(lm.log_shares(z.copy(), np.array([1, 0])), want[[0, 1], [1, 0]], atol=1e-5)


def test_cells_are_added_up_over_all_tasks(spark):
    def count(b):  # frequent cells lie side by side
        return np.bincount(np.asarray(b.column("id")) % 64, minlength=4096).astype(float)

    cell, n = lm.summed(spark.range(0, 6400, 1, 4).select("id"), count, iter)
    order = np.argsort(cell)
    assert cell[order].tolist() == list(range(64)) and (n[order] == 100).all()
    assert [len(x) for x in lm.summed(spark.range(0).select("id"), count, iter)] == [0, 0]


def test_words_are_lower_cased_in_ascii_only():
    import pyarrow as pa

    assert words(pa.array(["AÉ b"])).vocab.to_pylist() == ["aÉ", "b"]
