"""Language identification with a byte convolutional network, trained in numpy.

Text bytes are embedded, convolved with filters of widths 2, 3 and 4, max-pooled over fixed windows of 256 bytes and
classified by softmax. A text's distribution is the mean over all its windows, weighted by their bytes. For application
the network is compiled: embedding and filters are linear, so a filter's value at a position is the sum of two rows of
tables that byte pairs index. That gives the same numbers with two look-ups for a position instead of a matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint, in_arrow, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
PER_WIDTH = 8
DIM = 8
#: So many languages are broadcast with their counts; more are joined.
MOST_LANGS = 10_000
#: Bytes of text that are laid out in windows at a time: whole windows.
SEGMENT = 1 << 19
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class ByteCnn:
    langs: list[str]
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # 4 x DIM x filters; a narrow filter is zero in the later places
    bias: np.ndarray
    dense: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        one = np.einsum("bd,jdf->jbf", self.embed, self.filters)
        pair = lambda j: (one[j][:, None] + one[j + 1][None]).reshape(65536, -1).astype(np.float32)
        return pair(0), pair(2)


def padded_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of WINDOW bytes over texts data[starts[i]:ends[i]], zeros behind each text; each window's text and bytes."""
    size = ends - starts
    n = -(-size // WINDOW)
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    begin = np.cumsum(size) - size
    out[np.repeat(first * WINDOW - begin, size) + np.arange(int(size.sum()))] = data[np.repeat(starts - begin, size) + np.arange(int(size.sum()))]
    text = np.repeat(np.arange(len(n)), n)
    held = np.minimum(WINDOW, size[text] - (np.arange(len(text)) - first[text]) * WINDOW)
    return out.reshape(-1, WINDOW), text, held


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 places where they start."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def train(windows: np.ndarray, label: np.ndarray, langs: list[str], epochs: int = 12, seed: int = 7) -> ByteCnn:
    """Adam over softmax loss, with classes weighted to count alike. One language, or none, needs no steps."""
    rng = np.random.default_rng(seed)
    f, width = PER_WIDTH * len(WIDTHS), max(WIDTHS)
    mask = np.zeros((width, 1, f), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w, :, i * PER_WIDTH : (i + 1) * PER_WIDTH] = 1
    p = {
        "embed": rng.normal(0, 0.5, (256, DIM)),
        "filters": rng.normal(0, 0.3, (width, DIM, f)) * mask,
        "bias": np.zeros(f),
        "dense": rng.normal(0, 0.3, (f, len(langs))),
        "out_bias": np.zeros(len(langs)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    share = np.bincount(label, minlength=len(langs)).astype(np.float32)
    weight, step = (len(label) / np.maximum(share, 1) / max(1, len(langs)))[label], 0
    n_at = WINDOW - width + 1
    for _ in range(epochs if len(langs) > 1 else 0):
        order = rng.permutation(len(label))
        for a in range(0, len(order), 32):
            pick = order[a : a + 32]
            x = windows[pick]
            e = p["embed"][x]
            cols = np.concatenate([e[:, j : j + n_at] for j in range(width)], axis=2)
            z = cols @ p["filters"].reshape(width * DIM, f)
            top = z.argmax(axis=1)
            high = np.take_along_axis(z, top[:, None], 1)[:, 0] + p["bias"]
            act = np.maximum(high, 0)
            logit = act @ p["dense"] + p["out_bias"]
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            d = prob
            d[np.arange(len(pick)), label[pick]] -= 1
            d *= weight[pick][:, None] / len(pick)
            dact = (d @ p["dense"].T) * (high > 0)
            picked = np.take_along_axis(cols, top[:, :, None], 1)  # batch x filters x (width * DIM)
            dfil = np.einsum("bfk,bf->kf", picked, dact).reshape(width, DIM, f) * mask
            dcol = np.einsum("bf,kf->bfk", dact, p["filters"].reshape(width * DIM, f)).reshape(len(pick), f, width, DIM)
            demb = np.zeros_like(p["embed"])
            where = top[:, :, None] + np.arange(width)
            np.add.at(demb, x[np.arange(len(pick))[:, None, None], where], dcol)
            grads = {"embed": demb, "filters": dfil, "bias": dact.sum(0), "dense": act.T @ d, "out_bias": d.sum(0)}
            step += 1
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
    return ByteCnn(langs, **p)


def apply(net: ByteCnn, tables: tuple[np.ndarray, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The distribution over languages of each text; a text without bytes has zeros. Long texts are laid out in segments."""
    out = np.zeros((len(starts), len(net.langs)))
    n = -(-(ends - starts) // SEGMENT)
    of = np.repeat(np.arange(len(starts)), n)
    low = starts[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * SEGMENT
    high = np.minimum(ends[of], low + SEGMENT)
    group = np.cumsum(high - low) // SEGMENT
    for some in np.split(np.arange(len(of)), np.flatnonzero(np.diff(group)) + 1):
        windows, text, held = padded_windows(data, low[some], high[some])
        text = of[some][text]
        for a in range(0, len(windows), 32):
            x = windows[a : a + 32].astype(np.int32)
            pair = x[:, :-1] * 256 + x[:, 1:]
            z = tables[0][pair[:, :-2]]
            z += tables[1][pair[:, 2:]]
            logit = np.maximum(z.max(axis=1) + net.bias, 0) @ net.dense + net.out_bias
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob *= (held[a : a + 32] / prob.sum(1))[:, None]
            np.add.at(out, text[a : a + 32], prob)
    total = out.sum(1, keepdims=True)
    return np.divide(out, total, out=out, where=total > 0)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, learn: Column, per_lang: int = 400, excerpt: int = 1024, most: int = 40_000) -> ByteCnn:
    """Trains on at most per_lang rows of each language, in the order of a hash, an excerpt of each from its midst; fewer where languages
    are so many that these are over `most` rows, but one of each at least.

    These bounds hold what reaches the driver; only rows where `learn` holds and text and lang are not null count. All
    languages of those rows can be predicted, also of rows that all repeat one. Languages are counted first, and only rows with hashes under a bound that
    about 4 * per_lang rows of a language pass, or with its least, are ranked, so that what is ranked doesn't grow with the table.
    """
    rank = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    rows = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", rank.alias("h"))
    sizes = checkpoint(rows.groupBy("lang").agg(F.count("*").alias("size"), F.min("h").alias("least")))
    n = sizes.count()
    per_lang = max(1, min(per_lang, most // max(1, n)))
    sizes = F.broadcast(sizes) if n <= MOST_LANGS else sizes
    rows = rows.join(sizes, "lang").where((F.col("h") * F.col("size") <= F.lit(float(4 * per_lang << 30))) | (F.col("h") == F.col("least")))
    at = F.floor(F.greatest(F.char_length("text") - excerpt, F.lit(0)) / 2).cast("int") + 1
    rows = rows.select("lang", "h", F.substring(F.col("text"), at, F.lit(excerpt)).alias("part"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))
    got = rows.withColumn("place", place).where(F.col("place") <= per_lang).select("lang", "part").collect()
    langs = sorted({r.lang for r in got})
    if not langs:
        return train(np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), ["und"], epochs=0)
    got.sort(key=lambda r: (r.lang, r.part))
    data, at = text_bytes(pa.array([r.part for r in got], pa.string()))
    windows, text, held = padded_windows(data, at[:-1], at[1:])
    label = np.array([langs.index(r.lang) for r in got])[text]
    return train(windows[held >= 16], label[held >= 16], langs)


def predict_languages(docs: DataFrame, net: ByteCnn, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the probability of lang_pred) for each row, and the columns `others`.

    Whole texts are read, in windows. A text that is null or has no letter gets `und` and score 0. Rows that repeat, null
    ids and columns that are not asked for change nothing; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((net, net.tables()))  # 13 MB whatever the input
    kept = docs.select("doc_id", held_out().alias("held_out"), "text", *(F.col(c).alias(f"__{c}") for c in others))
    fields = SCHEMA + "".join(f", __{c} {docs.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tables = shared.value
        names = np.array(net.langs, object)
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                texts = pc.fill_null(b.column("text"), "")
                data, at = text_bytes(texts)
                prob = apply(net, tables, data, at[:-1], at[1:])
                letter = np.asarray(pc.match_substring_regex(texts, r"\p{L}")).astype(bool)
                pred = np.where(letter, names[prob.argmax(1)], "und")
                score = np.where(letter, np.clip(prob.max(1), 0, 1), 0.0)
                columns = [b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score)]
                columns += [b.column(f"__{c}") for c in others]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", *(f"__{c}" for c in others)])

    out = kept.transform(in_arrow, run, fields)
    return out.select("doc_id", "held_out", "lang_pred", "score", *(F.col(f"__{c}").alias(c) for c in others))


def keep_identified(docs: DataFrame, net: ByteCnn, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text has a language: not `und`, and a score of `least` or more; docs' own columns.

    Null texts and texts without a letter go; rows that repeat, null ids and columns named as the results are kept as they are; an empty table stays empty."""
    others = [c for c in docs.columns if c != "doc_id"]
    out = predict_languages(docs, net, tuple(others)).toDF("doc_id", "held_out", "lang_pred", "score", *(f"__{c}" for c in others))
    out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return out.select(*(F.col(c if c == "doc_id" else f"__{c}").alias(c) for c in docs.columns))
