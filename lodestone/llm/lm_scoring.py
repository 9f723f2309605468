"""Scoring texts with a causal self-attention language model, trained in numpy on subword ids.

Symbols are subwords of words, each marked if it ends its word, and an end of the text. The frequent ones are classes of their own; the
others share classes by their mark and last letter, within which they have smoothed unigram shares. At each place, HEADS attention heads look
at the CONTEXT places before it or more; their values are projected to scores, which are added to the logarithms of a
table of class transitions. Classes are in GROUPS groups of equal size, halved again and again by what precedes them; a class has its group's
probability times its own within the group, so that no place needs the scores of all classes. The table is counted over all training texts. Queries, keys, values, offsets and the projection
are learned by gradient descent on all windows of them, each of which is in one of ROUNDS rounds: each partition takes Adam steps on its own, and
parameters are averaged after each round, so that no text reaches the driver.
A word's probability is the product of its symbols', mixed with its share among the training tokens; the weight is fitted on
all training texts with each word's own occurrence left out: texts are scored by each of WEIGHTS at once, since attention costs most. Each word has one sequence of symbols, none the beginning
of another's, so that the probabilities of words add up to no more than 1.

Texts are scored in windows of CONTEXT + STRIDE symbols that overlap by CONTEXT; each symbol is scored in one of them, in batches, under a causal mask.

Texts are tokenized once, into a table in the shared folder. Only word counts are shuffled, and words that aren't among the at most LEXICON frequent ones,
which are joined with their counts. What is broadcast has a size that is fixed by LEXICON and CLASSES.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import hash_strings, in_arrow, mix, slices, words, written

#: Frequent words whose counts are broadcast; those of others are joined, with the same result.
LEXICON = 200_000
#: Classes, and how many of them rare symbols share.
CLASSES, RARE = 1024, 64
GROUPS = 32
BOS, END = 0, 1
CONTEXT, STRIDE = 16, 48
KEYS = CONTEXT + STRIDE
HEADS, DIM, VALUE = 1, 8, 16
#: The share of training windows that is learned from (all), in how many rounds, and the windows of a step and of a shuffled pool.
SHARE, ROUNDS, STEP, POOL = 1.0, 2, 128, 1024
RATE = 0.02
WEIGHTS = np.linspace(0.02, 0.9, 23)
SLICE = 3 << 20
LONGEST = 40
#: symbols and places are 32-bit numbers in a row.
TEXT_SCHEMA = "row long, doc_id long, held_out boolean, symbols binary, places binary, rare array<string>"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c of all texts; the end of a text counts as the word ''. What is shuffled are blocks of words of the same bucket by hash."""
    buckets, schema = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pa.schema([("word", pa.string()), ("c", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                w = words(b.column("text"))
                n = np.append(np.bincount(w.codes, minlength=len(w.vocab)), b.num_rows)
                yield pa.table({"word": pa.concat_arrays([w.vocab, pa.array([""], pa.string())]), "c": pa.array(n, pa.int64())})

    def added(tables: Iterator[pa.Table], most: int) -> Iterator[pa.Table]:
        """One table of all words, or some, once more than `most` are held."""
        held: list[pa.Table] = []
        for t in tables:
            held.append(t)
            if sum(map(len, held)) > most:
                held = [merged(held)]
                if len(held[0]) > most // 2:
                    yield held.pop()
        if held:
            yield merged(held)

    def merged(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
        return pa.table({"word": t["word"], "c": t["c_sum"]}, schema=schema).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in added(counted(batches), 400_000):
            order, some = by_group((hash_strings(t["word"].combine_chunks()) % np.uint64(buckets)).astype(np.int64), buckets)
            b = t.take(pa.array(order)).combine_chunks().to_batches()[0]
            blocks = [b.slice(at.start, at.stop - at.start).serialize() for _, at in some]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in some], pa.int32()), pa.array([x.to_pybytes() for x in blocks], pa.binary())], ["bucket", "block"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (pa.Table.from_batches([pa.ipc.read_record_batch(x.as_buffer(), schema)]) for b in batches for x in b.column("block"))
        held: dict[int, pa.Table] = {}  # by size, so that each word is merged few times
        for t in blocks:
            while (size := len(t).bit_length()) in held:
                t = merged([held.pop(size), t])
            held[size] = t
        if held:
            yield from merged(list(held.values())).to_batches()

    rows = docs.select("text").transform(in_arrow, run, "bucket int, block binary")
    return rows.repartition(buckets, "bucket").transform(in_arrow, add, "word string, c long")


class Subwords:
    """Subwords of words, each of which is cut into letters, numbers and other signs first; parts of more than LONGEST signs are cut, too."""

    PIECES = r"\p{L}{1,%d}|\p{N}{1,%d}|[^\s\p{L}\p{N}]{1,%d}|\s" % ((LONGEST,) * 3)

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.last = [b""] * (max(ranks.values()) + 1)  # the last letter of each, if it is one byte
        for x, i in ranks.items():
            self.last[i] = x[-1:]
        self.core = tiktoken.Encoding("subwords", pat_str=self.PIECES, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.gap = ranks[b"\n"]

    def ids(self, vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (none of which is empty or has a line end) in a row, and where each word's last one is."""
        flat = np.frombuffer(self.core.encode_to_tiktoken_buffer("\n".join(vocab), set()), np.uint32).astype(np.int64)
        gap = flat == self.gap
        ends = np.append(np.flatnonzero(gap), len(flat))[: len(vocab)] - np.arange(len(vocab)) - 1
        return flat[~gap], ends


_subwords: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    """One for each Python worker and vocabulary."""
    if path not in _subwords:
        _subwords[path] = Subwords(path)
    return _subwords[path]


def word_symbols(vocab: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each word in a row, and how many each has: twice the subword's id, and one more at the word's end."""
    flat, ends = subwords(path).ids(vocab)
    flat *= 2
    flat[ends] += 1
    return flat, np.diff(ends, prepend=-1)


def blobs(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The 32-bit numbers of each text as bytes."""
    data = flat.astype("<i4", copy=False).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * 4).astype(np.int32).tobytes()), pa.py_buffer(data)])


def drawn(rows: np.ndarray, begin: np.ndarray, turn: int) -> np.ndarray:
    """The numbers of the windows that a round learns from: those whose hash of row and place lies in its part of SHARE, so that no two rounds learn from one."""
    n = -(-(np.diff(begin) - 1) // STRIDE)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    h = mix(mix(np.repeat(rows, n).astype(np.uint64)) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = (h >> np.uint64(11)).astype(np.float64) * 2.0**-53  # less than 1
    return np.flatnonzero((at >= SHARE * turn / ROUNDS) & (at < SHARE * (turn + 1) / ROUNDS))


def with_ends(symbols: np.ndarray, starts: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in a row, each between `first` and `last`, the texts' starts, and the symbols' places."""
    begin = starts + 2 * np.arange(len(starts))
    out = np.full(begin[-1], first, np.int64)
    out[begin[1:] - 1] = last
    spot = np.arange(1, len(symbols) + 1)
    spot += np.repeat(2 * np.arange(len(starts) - 1), np.diff(starts))
    out[spot] = symbols
    return out, begin, spot


def window_rows(symbols: np.ndarray, starts: np.ndarray, rows: np.ndarray, learned: np.ndarray, size: int, turns: Iterable[int] = range(ROUNDS)) -> tuple[np.ndarray, np.ndarray]:
    """The windows of some rounds of each text that is learned from, in a row, and where each text's start.

    A window is its round and the symbols at its keys and one more; `size` is the begin of a text, one more its end, and -1 what lies outside."""
    length = np.diff(starts)
    begin = starts + 2 * np.arange(len(starts))
    n = -(-(length + 1) // STRIDE)
    text, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    out, of = [np.zeros((0, KEYS + 2), np.int64)], [np.zeros(0, np.int64)]
    for turn in turns:
        only = drawn(rows, begin, turn)
        only = only[learned[text[only]]]
        t = text[only]
        at = (STRIDE * (only - first[t]) - CONTEXT)[:, None] + np.arange(KEYS + 1)  # 0 is the text's begin
        end = length[t][:, None] + 1
        got = np.where(at == 0, size, np.where(at == end, size + 1, -1))
        inner = (at > 0) & (at < end)
        got[inner] = symbols[(at + starts[t][:, None] - 1)[inner]]
        out.append(np.insert(got, 0, turn, axis=1))
        of.append(t)
    flat, of = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))]) * (KEYS + 2)
    return flat[order].reshape(-1), cuts


def tokenized(docs: DataFrame, lexicon: pa.Array, path: str) -> DataFrame:
    """TEXT_SCHEMA: of each row of docs the symbols of its words, the words' places in the lexicon (-1: outside), and the words outside, in their order."""

    def lists(vocab: pa.Array) -> pa.ListArray:
        flat, size = word_symbols(vocab.to_pylist(), path)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat, pa.int32()))

    empty = pa.array([[]], pa.list_(pa.int32()))  # the end, the first of the lexicon, has no symbols
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, pa.concat_arrays([empty, lists(lexicon[1:])])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 40
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                w = words(b.column("text"))
                known, ready = shared.value
                place = np.asarray(pc.fill_null(pc.index_in(w.vocab, value_set=known), -1), dtype=np.int32)
                new = place < 0
                each = pa.concat_arrays([ready, lists(w.vocab.filter(pa.array(new)))])
                of = np.where(new, len(known) - 1 + np.cumsum(new), place)[w.codes]
                at = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(each), dtype=np.int64)[of])])
                symbols, place = np.asarray(each.take(pa.array(of)).flatten()), place[w.codes]
                far = np.concatenate([[0], np.cumsum(place < 0)])
                rare = pa.ListArray.from_arrays(pa.array(far[w.starts], pa.int32()), w.vocab.take(pa.array(w.codes[place < 0])))
                columns = [pa.array(np.arange(row, row + b.num_rows)), b.column("doc_id"), b.column("held_out"), blobs(symbols, at[w.starts]), blobs(place, w.starts), rare]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in TEXT_SCHEMA.split(", ")])
                row += b.num_rows

    return docs.select("doc_id", held_out().alias("held_out"), "text").transform(in_arrow, run, TEXT_SCHEMA)


def numbers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts in a row, and where each text's start."""
    _, at, data = a.buffers()
    at = np.frombuffer(at, np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, "<i4", count=int(at[-1] - at[0]) // 4, offset=int(at[0])) if data is not None else np.zeros(0, np.int32)
    return flat, (at - at[0]) // 4


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about a megabyte of symbols together; a longer text is a part of its own."""
    for b in batches:
        yield from slices(b, "symbols", 1 << 20)


@dataclass
class Lm:
    of: np.ndarray  # symbol -> class; classes of one group follow each other
    within: np.ndarray  # symbol -> log of its share in its class
    table: np.ndarray  # group x class x next class of the group: log of its share
    groups: np.ndarray  # class x next group: log of its share
    p: dict[str, np.ndarray]

    def classes(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all texts in a row, each between BOS and END, and the texts' starts."""
        return with_ends(self.of[symbols], starts, *self.of[-2:])[:2]


def fresh_parameters(classes: int, groups: int, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"query": rng.normal(0, 0.1, (classes, HEADS, DIM)), "key": rng.normal(0, 0.1, (classes, HEADS, DIM)), "value": rng.normal(0, 0.3, (classes, HEADS, VALUE))}
    p |= {"offset": np.zeros((HEADS, KEYS)), "group_out": np.zeros((HEADS * VALUE, groups)), "group_bias": np.zeros(groups)}
    p |= {"out": np.zeros((groups, HEADS * VALUE, classes // groups)), "bias": np.zeros((groups, classes // groups))}
    return {k: v.astype(np.float32) for k, v in p.items()}


def windows(x: np.ndarray, begin: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of each window (or those numbered in `only`): the classes at its keys and whether they are there, its targets' places, and whether they are there."""
    targets = np.diff(begin) - 1
    n = -(-targets // STRIDE)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    if only is not None:
        text, place = text[only], place[only]
    base = begin[text] + STRIDE * place - CONTEXT
    keys = base[:, None] + np.arange(KEYS)
    there = (keys >= begin[text][:, None]) & (keys < begin[text + 1][:, None])
    goal = base[:, None] + CONTEXT + 1 + np.arange(STRIDE)
    return x[np.clip(keys, 0, len(x) - 1)], there, np.minimum(goal, len(x) - 1), goal < begin[text + 1][:, None]


OFFSET = CONTEXT + np.arange(STRIDE)[:, None] - np.arange(KEYS)[None]
CAUSAL = OFFSET >= 0
FAR = np.maximum(OFFSET, 0)
LIMIT = np.float32(30)
#: Windows that attention takes at a time, so that their weights stay in the cache.
BLOCK = 32


def by_head(p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Queries, keys and values of classes, heads first; the last class stands for no symbol, and the last value is 1 for any other. And what offsets add to scores."""
    classes = len(p["query"])
    query, key, value = (np.zeros((HEADS, classes + 1, n), np.float32) for n in (DIM, DIM, VALUE + 1))
    query[:, :-1], key[:, :-1], value[:, :-1, :VALUE] = (p[k].transpose(1, 0, 2) for k in ("query", "key", "value"))
    value[:, :-1, VALUE] = 1
    return query, key, value, np.where(CAUSAL, np.take(p["offset"], FAR, axis=1), np.float32(-1e9))[:, None]


def attend(heads: tuple[np.ndarray, ...], keys: np.ndarray, gathered: np.ndarray) -> tuple[np.ndarray, ...]:
    """Attention weights before they are divided by their sums (HEADS x windows x STRIDE x KEYS), the sums, queries, keys and values. What the heads gather is put into `gathered`.

    The key of a place without symbol is the last class. Scores are LIMIT at most, so that no greatest one needs to be found."""
    query, key, value, offset = heads
    q, k, v = np.take(query, keys[:, CONTEXT:], axis=1), np.take(key, keys, axis=1), np.take(value, keys, axis=1)
    a = q @ np.ascontiguousarray(k.transpose(0, 1, 3, 2))
    a += offset
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(a, out=a)
        g = a @ v
    if not (g[..., VALUE] < np.exp(LIMIT)).all():  # else no score is above it
        np.minimum(a, np.exp(LIMIT), out=a)
        g = a @ v
    total = g[..., VALUE:] + np.float32(1e-30)
    np.divide(g[..., :VALUE], total, out=gathered.reshape(len(keys), STRIDE, HEADS, VALUE).transpose(2, 0, 1, 3))
    return a, total, q, k, v


def exponentials(z: np.ndarray) -> np.ndarray:
    """The sums of the rows of exp(z), which z becomes. Logits are 2 * LIMIT at most."""
    ones = np.ones(z.shape[1], np.float32)
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
        total = z @ ones
    if not (total < np.exp(2 * LIMIT)).all():  # else no logit is above it
        np.minimum(z, np.exp(2 * LIMIT), out=z)
        total = z @ ones
    return total + np.float32(1e-30)


def log_shares(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The log of the softmax of the rows of z at the columns `own`. z is changed."""
    told = np.minimum(np.take(z, np.arange(len(z)) * z.shape[1] + own), 2 * LIMIT)
    return told - np.log(exponentials(z))


def slopes(z: np.ndarray, own: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The softmax of the rows of z less 1 at the columns `own`, times the rows' shares. z is changed."""
    z *= (share / exponentials(z))[:, None]
    at = np.arange(len(z)) * z.shape[1] + own
    np.put(z, at, np.take(z, at) - share)
    return z


def by_group(group: np.ndarray, groups: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The places in the order of their groups, and where each group that occurs lies in it."""
    order = np.argsort(group.astype(np.uint8 if groups <= 256 else np.int16), kind="stable")  # small numbers are sorted by their digits
    cuts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=groups))]).tolist()
    return order, [(g, slice(a, b)) for g, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]


def sums_by_class(x: np.ndarray, of: np.ndarray, classes: int, part: int = 16) -> np.ndarray:
    """The sum of the rows of x of each class: products with the classes' indicators, by parts of the classes."""
    out = np.zeros((-(-classes // part), part, x.shape[1]), np.float32)
    order, parts = by_group(of // part, len(out))
    x, own = np.take(x, order, axis=0), np.take(np.eye(part, dtype=np.float32), np.take(of, order) % part, axis=0)
    for n, at in parts:
        np.matmul(own[at].T, x[at], out=out[n])
    return out.reshape(-1, x.shape[1])[:classes]


def gradients(lm: Lm, p: dict[str, np.ndarray], keys: np.ndarray, there: np.ndarray, goal: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss (the negative log probability of the goal classes) by each parameter."""
    heads, n, classes, (groups, width, size) = by_head(p), len(keys) * STRIDE, len(p["query"]), p["out"].shape
    last, goal = keys[:, CONTEXT:].reshape(-1), goal.reshape(-1)
    keys = np.where(there, keys, classes)
    share = (real.reshape(-1) / max(1, real.sum())).astype(np.float32)
    told = np.ones((n, width + 1), np.float32)  # what is gathered, and 1 for the bias
    gathered = told[:, :width]
    blocks = [(slice(i, i + BLOCK), slice(i * STRIDE, (i + BLOCK) * STRIDE)) for i in range(0, len(keys), BLOCK)]
    kept = [attend(heads, keys[some], gathered[at]) for some, at in blocks]
    g = {}

    weights = np.concatenate([p["group_out"], p["group_bias"][None]])
    z, back, both = np.empty((n, groups), np.float32), np.empty((n, width), np.float32), np.zeros((width + 1, groups), np.float32)
    slabs = [slice(i, i + 512) for i in range(0, n, 512)]  # small products are faster than a large one of few columns
    for at in slabs:
        np.matmul(told[at], weights, out=z[at])
    z += np.take(lm.groups, last, axis=0)
    d = slopes(z, goal // size, share)
    for at in slabs:
        both += told[at].T @ d[at]
        np.matmul(d[at], p["group_out"].T, out=back[at])
    g["group_out"], g["group_bias"] = both[:width], both[width]

    weights, both = np.concatenate([p["out"], p["bias"][:, None]], axis=1), np.zeros((groups, width + 1, size), np.float32)
    order, parts = by_group(goal // size, groups)
    told_by, own = np.take(told, order, axis=0), np.take(goal, order)
    z = np.empty((n, size), np.float32)
    for m, at in parts:
        np.matmul(told_by[at], weights[m], out=z[at])
    z += np.take(lm.table.reshape(-1, size), own // size * classes + np.take(last, order), axis=0)
    d, more = slopes(z, own % size, np.take(share, order)), np.empty((n, width), np.float32)
    for m, at in parts:
        np.matmul(told_by[at].T, d[at], out=both[m])
        np.matmul(d[at], p["out"][m].T, out=more[at])
    g["out"], g["bias"] = both[:, :width], both[:, width]
    to = np.empty_like(order)
    to[order] = np.arange(n)
    back += np.take(more, to, axis=0)

    dg = np.empty((len(keys), STRIDE, HEADS, VALUE + 1), np.float32)
    less = ((back * gathered).reshape(-1, VALUE) @ np.ones(VALUE, np.float32)).reshape(dg.shape[:3])
    over = 1 / np.concatenate([total for _, total, *_ in kept], axis=1)[..., 0].transpose(1, 2, 0)
    np.multiply(back.reshape(*dg.shape[:3], VALUE), over[..., None], out=dg[..., :VALUE])
    np.multiply(less, -over, out=dg[..., VALUE])
    dg = dg.transpose(2, 0, 1, 3)
    x, by_offset = np.zeros((len(keys), KEYS, HEADS, 2 * DIM + VALUE), np.float32), np.zeros((HEADS, STRIDE * KEYS), np.float32)
    by_key = x.transpose(2, 0, 1, 3)
    for (some, _), (a, _, q, k, v) in zip(blocks, kept, strict=True):
        down, to = dg[:, some], by_key[:, some]
        ds = down @ np.ascontiguousarray(v.transpose(0, 1, 3, 2))
        ds *= a
        by_offset += np.ones(ds.shape[1], np.float32) @ ds.reshape(HEADS, ds.shape[1], -1)
        np.matmul(ds, k, out=to[:, :, CONTEXT:, :DIM])
        np.matmul(ds.transpose(0, 1, 3, 2), q, out=to[..., DIM : 2 * DIM])
        np.matmul(a.transpose(0, 1, 3, 2), down[..., :VALUE], out=to[..., 2 * DIM :])
    g["offset"] = np.stack([np.bincount(FAR.ravel(), weights=y, minlength=KEYS) for y in by_offset * CAUSAL.reshape(-1)])
    x = sums_by_class(x.reshape(keys.size, -1), keys.reshape(-1), classes + 1)[:classes].reshape(classes, HEADS, -1)
    g["query"], g["key"], g["value"] = x[..., :DIM], x[..., DIM : 2 * DIM], x[..., 2 * DIM :]
    return g


class Adam:
    """Steps on a vector, in place."""

    def __init__(self, w: np.ndarray, rate: float) -> None:
        self.w, self.rate, self.steps = w, rate, 0
        self.mean, self.square, self.up, self.down = (np.zeros_like(w) for _ in range(4))

    def step(self, g: np.ndarray) -> None:
        self.steps += 1
        m, s, up, down = self.mean, self.square, self.up, self.down
        m += np.multiply(np.subtract(g, m, out=up), 0.1, out=up)
        s += np.multiply(np.subtract(np.square(g, out=up), s, out=up), 0.01, out=up)
        np.sqrt(np.multiply(s, 1 / (1 - 0.99**self.steps), out=down), out=down)
        down += 1e-8
        np.divide(np.multiply(m, self.rate / (1 - 0.9**self.steps), out=up), down, out=up)
        self.w -= up


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)])


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32, copy=False)
        at += like[k].size
    return out


def learn(texts: DataFrame, lm: Lm, turn: int, slots: int = 16) -> dict[str, np.ndarray]:
    """The parameters after a round, averaged over partitions by their windows. At most `slots` sums reach the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(lm)
    size = len(packed(lm.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, task = shared.value, TaskContext.get()
        number = task.partitionId() if task else 0
        rng = np.random.default_rng([turn, number])
        flat = packed(lm.p)
        p = unpacked(flat, lm.p)  # parts of flat
        adam, pool, held, total = Adam(flat, RATE * (1 - 0.7 * turn / ROUNDS)), [], 0, 0

        def take() -> None:
            keys, there, goal, real = (np.concatenate(c) for c in zip(*pool, strict=True))
            order = rng.permutation(len(keys))
            for i in range(0, len(order), STEP):
                at = order[i : i + STEP]
                adam.step(packed(gradients(lm, p, keys[at], there[at], goal[at], real[at])).astype(np.float32, copy=False))
            pool.clear()

        for b in parts(batches):
            symbols, starts = numbers(b.column("symbols"))
            got = window_rows(symbols, starts, np.asarray(b.column("row")), np.ones(b.num_rows, bool), len(lm.of) - 2, [turn])[0]
            got = got.reshape(-1, KEYS + 2)[:, 1:]
            for i in range(0, len(got), POOL):
                there, x = got[i : i + POOL] >= 0, lm.of[got[i : i + POOL]].astype(np.int32)
                pool.append((x[:, :KEYS], there[:, :KEYS], x[:, CONTEXT + 1 :], there[:, CONTEXT + 1 :]))
                held, total = held + len(x), total + len(x)
                if held >= POOL:
                    take()
                    held = 0
        if pool:
            take()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([number % slots], pa.int32()), pa.array([total], pa.int64()), pa.array([(flat * np.float64(total)).tobytes()], pa.binary())], ["slot", "n", "p"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for b in batches:
            for k, x in zip(b.column("n").to_pylist(), b.column("p"), strict=True):
                total, n = total + np.frombuffer(x.as_buffer()), n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slot", "n", "p"])

    kind = "slot int, n long, p binary"
    got = texts.select("row", "symbols").transform(in_arrow, run, kind).repartition(slots, "slot").transform(in_arrow, add, kind).collect()
    n = sum(r.n for r in got)
    return unpacked(sum(np.frombuffer(bytes(r.p)) for r in got) / n, lm.p) if n else lm.p


def symbol_logs(lm: Lm, x: np.ndarray, begin: np.ndarray, block: int = BLOCK, many: int = 512) -> np.ndarray:
    """The log probability of each place's class given those before it; 0 at BOS. Windows are laid out `many` at a time."""
    out = np.zeros(len(x))
    number = int((-(-(np.diff(begin) - 1) // STRIDE)).sum())
    p, heads, (groups, width, size) = lm.p, by_head(lm.p), lm.p["out"].shape
    group_table, table = lm.groups + p["group_bias"], (lm.table + p["bias"][:, None]).reshape(-1, size)
    for low in range(0, number, many):
        keys, there, goal, real = windows(x, begin, np.arange(low, min(low + many, number)))
        last, own, n = keys[:, CONTEXT:].reshape(-1), x[goal].reshape(-1), goal.size
        keys = np.where(there, keys, len(p["query"]))
        gathered = np.empty((n, width), np.float32)
        for i in range(0, len(keys), block):
            attend(heads, keys[i : i + block], gathered[i * STRIDE : (i + block) * STRIDE])
        group, log = own // size, np.empty(n, np.float32)
        for i in range(0, n, 4096):
            part, z = slice(i, i + 4096), np.empty((min(4096, n - i), groups), np.float32)
            for j in range(0, len(z), 512):
                np.matmul(gathered[i + j : min(i + j + 512, i + len(z))], p["group_out"], out=z[j : j + 512])
            z += np.take(group_table, last[part], axis=0)
            log[part] = log_shares(z, group[part])
        order, parts = by_group(group, groups)
        gathered, last, own = np.take(gathered, order, axis=0), np.take(last + group * len(p["query"]), order), np.take(own % size, order)
        z, more = np.empty((n, size), np.float32), np.empty(n, np.float32)
        for m, at in parts:
            np.matmul(gathered[at], p["out"][m], out=z[at])
        for i in range(0, n, 4096):
            part = slice(i, i + 4096)
            z[part] += np.take(table, last[part], axis=0)
            more[part] = log_shares(z[part], own[part])
        log[order] += more
        out[goal[real]] = log.reshape(goal.shape)[real]
    return out


def word_logs(lm: Lm, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The log probability of each word, and behind each text's words of its end, by attention."""
    x, begin, spot = with_ends(lm.of[symbols], starts, *lm.of[-2:])
    log = symbol_logs(lm, x, begin)
    log[spot] += lm.within[symbols]
    final = np.zeros(len(x), bool)  # the last symbols of words, and the ends; at the begin, whose log is 0, the first word starts
    final[spot], final[begin[1:] - 1] = symbols % 2 == 1, True
    last = np.flatnonzero(final)
    return np.add.reduceat(log, np.concatenate([[0], last[:-1] + 1])) if len(last) else np.zeros(0)


def symbol_classes(n: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The class of each symbol (the last two are BOS and END), and the log of its share in it, from the symbols' counts.

    Rare symbols share a class by whether they end their word and by the last letter of their subword."""
    last = subwords(path).last
    kinds, seen = [(last[i // 2], i % 2) for i in range(len(n))], Counter()
    for k, c in zip(kinds, n.tolist(), strict=True):
        seen[k] += c
    frequent = sorted(seen, key=lambda k: (-seen[k], k))[: RARE - 1]
    number = {k: 2 + i for i, k in enumerate(frequent)}
    of = np.array([number.get(k, RARE + 1) for k in kinds])
    best = np.lexsort((np.arange(len(n)), -n))[: CLASSES - 2 - RARE]
    of[best] = 2 + RARE + np.arange(len(best))
    share = n + 0.5
    return np.append(of, [BOS, END]), np.log(share / np.bincount(of, weights=share, minlength=CLASSES)[of])


def grouped(both: np.ndarray, rounds: int = 12) -> np.ndarray:
    """An order of the classes whose equal parts are the groups: halved again and again along the main direction of what precedes the classes."""
    x = np.sqrt(both.T / np.maximum(1, both.sum(0)[:, None]))
    parts = [np.arange(len(both))]
    while len(parts) < GROUPS:
        halves = []
        for part in parts:
            y = x[part] - x[part].mean(0)
            v = y.T @ np.cos(np.arange(len(part)))
            for _ in range(rounds):
                v = y.T @ (y @ v)
                v /= max(1e-12, float(np.sqrt(v @ v)))
            order = part[np.lexsort((part, np.round(y @ v, 9)))]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = halves
    return np.concatenate([np.sort(part) for part in parts])


def summed(texts: DataFrame, count: Callable[[pa.RecordBatch], np.ndarray], cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = parts, slots: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The sum of count over all parts of texts: the cells that are not 0, and their sums. Each of `slots` adds up a part of the cells."""
    kind = "slot int, cell binary, n binary"

    def row(slot: int, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([cell.astype(np.int32).tobytes()], pa.binary()), pa.array([n.astype(np.float64).tobytes()], pa.binary())], ["slot", "cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in cut(batches):
            got = count(b)
            total = got if total is None else total + got
        if total is not None:
            some = np.flatnonzero(total)
            for k in range(slots):
                cell = some[some % slots == k]  # neighbours, which are often alike in frequency, go to different slots
                if len(cell):
                    yield row(k, cell, total[cell])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0)
        for b in batches:
            for x, y in zip(b.column("cell"), b.column("n"), strict=True):
                cell = np.frombuffer(x.as_buffer(), np.int32)
                total = np.pad(total, (0, max(0, int(cell[-1]) + 1 - len(total))))
                total[cell] += np.frombuffer(y.as_buffer())
        some = np.flatnonzero(total)
        if len(some):
            yield row(0, some, total[some])

    got = texts.transform(in_arrow, run, kind).repartition(slots, "slot").transform(in_arrow, add, kind).collect()
    joined = lambda k, of: np.concatenate([np.zeros(0, of), *(np.frombuffer(bytes(r[k]), of) for r in got)])
    return joined("cell", np.int32), joined("n", np.float64)


def fit(texts: DataFrame, path: str) -> Lm:
    """Learns from all of texts (tokenized). Without texts, every class is as likely as any other."""
    size = 2 * len(subwords(path).last)
    n = np.zeros(size)
    cell, c = summed(texts.select("symbols"), lambda b: np.bincount(numbers(b.column("symbols"))[0], minlength=size))
    n[cell] = c
    lm = Lm(*symbol_classes(n, path), np.zeros(0, np.float32), np.zeros(0, np.float32), {})
    shared = texts.sparkSession.sparkContext.broadcast(lm)

    def pairs(b: pa.RecordBatch) -> np.ndarray:
        x, begin = shared.value.classes(*numbers(b.column("symbols")))
        inside = np.ones(len(x), bool)
        inside[begin[:-1]] = False
        return np.bincount((x[:-1] * CLASSES + x[1:])[inside[1:]], minlength=CLASSES**2)

    both = np.zeros(CLASSES**2)
    cell, c = summed(texts.select("symbols"), pairs)
    both[cell] = c
    both = both.reshape(CLASSES, CLASSES)
    order = grouped(both)
    both, lm.of = both[np.ix_(order, order)], np.argsort(order)[lm.of]
    plain = both.sum(0) + 0.5
    plain[lm.of[-2]] = 1e-9
    plain /= plain.sum()
    p = (both + 5.0 * plain) / (both.sum(1, keepdims=True) + 5.0)
    lm.table = np.ascontiguousarray(np.log(p).astype(np.float32).reshape(CLASSES, GROUPS, -1).transpose(1, 0, 2))
    lm.groups = np.log(p.reshape(CLASSES, GROUPS, -1).sum(2)).astype(np.float32)
    lm.p = fresh_parameters(CLASSES, GROUPS)
    for turn in range(ROUNDS):
        lm.p = learn(texts, lm, turn)
    return lm


def mixtures(share: np.ndarray, log: np.ndarray, starts: np.ndarray, block: int = 128) -> np.ndarray:
    """By each of WEIGHTS, from each start to the next one, the sum of the logs of words' probabilities (whose logarithms are given) mixed with their shares.

    The greater of both is taken out of a mixture, which then is at least the smallest of WEIGHTS and of what they leave, so that the product of a block of words is a number: one logarithm is taken of each."""
    p = np.exp(log)
    above = share > p
    greatest = np.where(above, np.log(np.where(above, share, 1)), log)
    with np.errstate(divide="ignore", invalid="ignore"):
        less = np.where(above, p / np.where(above, share, 1), 1)
        step = np.where(above, 1 - less, np.nan_to_num(share / p) - 1)
    cuts = np.union1d(starts, np.arange(0, len(log), block))
    to, out, y = np.searchsorted(cuts, starts), np.empty((len(starts), len(WEIGHTS))), np.empty_like(p)
    for i, w in enumerate(WEIGHTS):
        np.multiply(step, w, out=y)
        y += less
        out[:, i] = np.add.reduceat(np.log(np.multiply.reduceat(y, cuts)), to)
    return out + np.add.reduceat(greatest, starts)[:, None]


def likelihoods(n: np.ndarray, total: int, log: np.ndarray) -> np.ndarray:
    """By each of WEIGHTS, the log likelihood of words of training texts, of whose counts n their own occurrence is left out."""
    return mixtures(np.maximum(n - 1, 0) / max(1, total), log, np.zeros(1, np.int64))[0] if len(n) else np.zeros(len(WEIGHTS))


def score_texts(texts: DataFrame, lm: Lm, counts: DataFrame, share: np.ndarray, total: int, distinct: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and attention_score of each row of texts (tokenized).

    A null text is empty: its end is its one token. Whole texts are scored. Rows that repeat, null ids and other
    columns change nothing; an empty table gives no rows. score is the log10 probability of the words and the end,
    attention_score that of attention alone. share: the counts of the lexicon, of which the first is the end's; counts: those of all other words.
    The weight of words' shares is the one of WEIGHTS that gives all training texts the greatest likelihood.
    """
    shared = texts.sparkSession.sparkContext.broadcast((lm, share))
    scale, many = total + 0.5 * (distinct + 1), len(WEIGHTS)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, attention_score double, told array<double>, rare array<string>, logs array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """scores: by each of WEIGHTS; told: the likelihoods of the training words of a part, in its first row."""
        lm, c = shared.value
        for b in parts(batches):
            log = word_logs(lm, *numbers(b.column("symbols")))
            at, starts = numbers(b.column("places"))
            own, ends = np.insert(at, starts[1:], 0), starts + np.arange(len(starts))
            near = own >= 0
            n = np.append(c, 0.0)[own]
            text = np.repeat(np.arange(b.num_rows), np.diff(ends))
            sums = lambda v: np.bincount(text, weights=v, minlength=b.num_rows)  # noqa: B023, E731
            score = mixtures(np.where(near, n / max(1, total), 1), np.where(near, log, 0), ends[:-1]) / np.log(10)
            learned = near & ~np.asarray(b.column("held_out"))[text]
            base = sums(np.where(near, np.log10((n + 0.5) / scale), 0))
            far = np.concatenate([[0], np.cumsum(~near)])[ends]
            columns = [
                b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array(np.diff(ends)), pa.array(sums(n > 0).astype(np.int64)), pa.array(base),
                pa.ListArray.from_arrays(pa.array(many * np.arange(b.num_rows + 1), pa.int32()), pa.array(score.reshape(-1))), pa.array(sums(log) / np.log(10)),
                pa.ListArray.from_arrays(pa.array([0] + [many] * b.num_rows, pa.int32()), pa.array(likelihoods(n[learned], total, log[learned]))),
                b.column("rare"), pa.ListArray.from_arrays(pa.array(far, pa.int32()), pa.array(log[~near])),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    rows = written(texts.transform(in_arrow, run, schema))
    far = rows.select("row", "held_out", F.explode(F.arrays_zip("rare", "logs")).alias("x")).select("row", "held_out", F.col("x.rare").alias("word"), F.col("x.logs").alias("log"))
    far = written(far.join(counts.select("word", "c").hint("shuffle_hash"), "word", "left").select("row", "held_out", "log", F.coalesce("c", F.lit(0)).alias("c")))

    fitted = np.log(WEIGHTS) + np.log(1 - WEIGHTS)
    for r in rows.select(F.posexplode("told")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        fitted[r.pos] += r.n
    cell, got = summed(far.where("not held_out").select("log", "c"), lambda b: likelihoods(np.asarray(b.column("c")), total, np.asarray(b.column("log"))), iter)
    fitted[cell] += got
    best = int(fitted.argmax())
    weight = float(WEIGHTS[best])

    a, b = F.log(F.lit(weight) * F.col("c") / max(1, total)), F.col("log") + F.log(F.lit(1 - weight))
    mixed = F.when(F.col("c") == 0, b).otherwise(F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b))))
    far = far.groupBy("row").agg(
        F.sum((F.col("c") > 0).cast("long")).alias("more"), F.sum(F.log10((F.col("c") + 0.5) / F.lit(scale))).alias("base"), F.sum(mixed / F.log(F.lit(10.0))).alias("mixed")
    )
    both = rows.withColumn("score", F.col("scores")[best]).drop("rare", "logs", "told", "scores").join(far, "row", "left")
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("mixed", F.lit(0.0))).alias("score"), "attention_score",
    )


def level() -> Column:
    return F.floor(F.log2("c") * 8)


def bound(levels: dict[int, int], most: int) -> int:
    """The level above which at most `most` words are, from how many each level has: no word needs to be sorted among all."""
    held = 0
    for k in sorted(levels, reverse=True):
        held += levels[k]
        if held > most:
            return k
    return -1  # below any word's


def score_documents(docs: DataFrame, path: str, lexicon: int = LEXICON) -> DataFrame:
    """score_texts of all docs by a model learned from those that aren't held out (crc32 of the id mod 5 is not 1)."""
    counts = written(word_counts(docs.where(~held_out())))
    sums = {r.level: r for r in counts.groupBy(F.when(F.col("word") != "", level()).alias("level")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    total, distinct = sum(r.n for r in sums.values()), sum(r.v for r in sums.values())
    ends = sums.pop(None).n if None in sums else 0  # the level of '', whatever its count
    least = bound({k: r.v for k, r in sums.items()}, lexicon)
    top = counts.where((F.col("word") != "") & (level() > least)).toArrow()
    share = np.concatenate([[ends], np.asarray(top["c"], dtype=np.float64)])
    known = pa.concat_arrays([pa.array([""], pa.string()), *(x.cast(pa.string()) for x in top["word"].chunks)])  # the end's place is the first
    texts = written(tokenized(docs, known, path))
    lm = fit(texts.where("not held_out"), path)
    return score_texts(texts, lm, counts.where(level() <= least), share, total, distinct)
