"""Benchmark decontamination by greedy string tiling.

Word 5-grams are seeds. Those of the documents are looked up in a table of CELLS bits of the benchmark's, which rules most of them out where they are
read; what is left is joined with the benchmark's seeds by hash. A text and an item that share seeds enough to reach the threshold are tiled: the longest common run
of words that are not marked yet is found by running Karp-Rabin hashes, marked on both sides, and so on down to five words. The
share of a benchmark item's words that tiles cover decides, so that passages whose parts were reordered are found too.

Documents are read once for the seeds, whatever the size of the benchmark. Shuffled are seeds, texts that are tiled, and found pairs; documents are told
from those that share enough by a broadcast of hashes, if these are few (counted), else by a join.
Equal texts are tiled once. The table of bits has a fixed size; a benchmark that fills it makes the join larger, not the result smaller.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint, hash_strings, in_arrow, kgrams, slices, words
from lodestone.operators.retrieval import small

MATCH = 5
CELLS = 1 << 22
PAIR_SCHEMA = "doc_id long, item_id long, coverage double, tiles array<struct<doc_start:int,item_start:int,length:int>>"
TILE = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
edges = re.compile(r"^[^\w]+|[^\w]+$")


def plain(word: str) -> str:
    return edges.sub("", word)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Where each text's words start, each word's index into the vocabulary, the vocabulary, and each word's hash.

    Words are lower-case, without punctuation at their ends; what is only punctuation is no word."""
    w = words(pc.utf8_lower(pc.fill_null(texts, "")), lower=False)
    vocab = [plain(x) for x in w.vocab.to_pylist()]
    full = np.fromiter(map(bool, vocab), bool, len(vocab))[w.codes] if len(vocab) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(full)])
    codes = w.codes[full]
    return kept[w.starts], codes, vocab, hash_strings(pa.array(vocab, pa.string()))[codes] if len(codes) else np.zeros(0, np.uint64)


def windows(prefix: np.ndarray, power: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs of n words none of which is marked, and their rolling hashes."""
    if len(free) <= n:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    at = np.flatnonzero(free[n:] - free[:-n] == n)
    return at, prefix[at + n] - prefix[at] * power[n]


def longest(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, sums: tuple[np.ndarray, ...], most: int) -> tuple[int, int, int] | None:
    """The longest common run (place in a, place in b, words) of unmarked words, of MATCH words at least and `most` at most; ties: the least place in a, then in b."""
    ha, hb, power = sums
    low, high, best = MATCH, most, None
    while low <= high:  # a common run of n words holds one of n - 1
        n = (low + high + 1) // 2 if best else low
        at, x = windows(ha, power, free_a, n)
        to, y = windows(hb, power, free_b, n)
        order = np.argsort(y, kind="stable")
        k = np.searchsorted(y[order], x)
        hit = np.flatnonzero((k < len(y)) & (y[order][np.minimum(k, len(y) - 1)] == x)) if len(y) else np.zeros(0, int)
        found = next(((int(at[i]), int(to[order[k[i]]]), n) for i in hit if (a[at[i] : at[i] + n] == b[to[order[k[i]]] : to[order[k[i]]] + n]).all()), None)
        if found:
            best, low = found, n + 1
            if n == high:
                break
        else:
            high = n - 1
            if best is None:
                return None
    return best


def tile(doc: list[str], item: list[str]) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in doc, place in item, words): the longest common run of unmarked words first, again and again, down to MATCH words."""
    code = {w: k + 1 for k, w in enumerate(dict.fromkeys(item))}
    a, b = (np.fromiter((code.get(w, 0) for w in x), np.int64, len(x)) for x in (doc, item))
    seeds = kgrams(b.astype(np.uint64), MATCH)
    kept = np.zeros(len(a) + 1, np.int64)  # only words within a run of MATCH that the item holds, too, can be matched
    for i in np.flatnonzero(np.isin(kgrams(a.astype(np.uint64), MATCH), seeds)).tolist():
        kept[i] += 1
        kept[i + MATCH] -= 1
    kept = np.cumsum(kept)[:-1] > 0
    where = np.flatnonzero(kept)
    gaps = np.flatnonzero(np.diff(where) > 1) + 1
    place = np.insert(where, gaps, -1)  # runs apart are kept apart
    a = np.where(place >= 0, a[np.maximum(place, 0)], 0) if len(a) else a
    power = np.cumprod(np.append(np.ones(1, np.uint64), np.full(max(len(a), len(b)), 0x9E3779B97F4A7C15, np.uint64)))
    sums = (*(prefix(x) for x in (a, b)), power)
    open_a, open_b, out, most = place >= 0, np.ones(len(b), bool), [], len(b)
    while found := longest(a, b, count(open_a), count(open_b), sums, most):
        i, j, most = found
        open_a[i : i + most] = open_b[j : j + most] = False
        out.append((int(place[i]), j, most))
    return sorted(out)


def count(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)])


def prefix(x: np.ndarray) -> np.ndarray:
    out, h = np.zeros(len(x) + 1, np.uint64), 0
    for i, v in enumerate(x.tolist()):
        h = (h * 0x9E3779B97F4A7C15 + v) & 0xFFFFFFFFFFFFFFFF
        out[i + 1] = h
    return out


def seeds_of(items: DataFrame) -> DataFrame:
    """item_row, h, m (how often the item holds this 5-gram) and n (the item's words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                starts, _, _, h = tokens(b.column("text"))
                out: list[list[np.ndarray]] = [[], [], [], []]
                for row, a, z in zip(b.column("item_row").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    g, m = np.unique(kgrams(h[a:z], MATCH), return_counts=True)
                    for c, x in zip(out, (np.full(len(g), row), g.view(np.int64), m, np.full(len(g), z - a)), strict=True):
                        c.append(x.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out], ["item_row", "h", "m", "n"])

    return items.select("item_row", "text").transform(in_arrow, run, "item_row long, h long, m long, n long")


def shared_seeds(docs: DataFrame, cells: np.ndarray) -> DataFrame:
    """text_hash and h of the 5-grams of texts that the table of bits doesn't rule out, each once a slice of texts."""
    bits = np.zeros(CELLS, bool)
    bits[cells] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        for whole in batches:
            for b in slices(whole, "text"):
                starts, _, _, h = tokens(b.column("text"))
                g = kgrams(h, MATCH)
                at = np.flatnonzero(bits[(g & np.uint64(CELLS - 1)).astype(np.int64)])
                text = np.searchsorted(starts, at, "right") - 1
                inside = at + MATCH <= starts[text + 1]
                pairs = np.unique(np.stack([np.asarray(b.column("text_hash"), dtype=np.int64)[text[inside]], g[at[inside]].view(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["text_hash", "h"])

    return docs.select("text", F.xxhash64("text").alias("text_hash")).transform(in_arrow, run, "text_hash long, h long").distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, item_id, coverage and tiles of each pair in which tiles cover a share `least` of the item's words.

    Whole texts are read. Null texts, items of under five words and nulls in other columns give no pairs (an item_id that is null is kept); a row that
    repeats gives its pairs again, and so do items that repeat; the tiles' places count words. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text").where("text is not null")
    items = checkpoint(benchmark.select("item_id", "text").where("text is not null")).withColumn("item_row", F.monotonically_increasing_id())
    seeds = checkpoint(seeds_of(items))
    cells = np.asarray(seeds.select(F.col("h").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell")).distinct().toArrow()["cell"], dtype=np.int64)
    hits = shared_seeds(docs, cells).join(seeds, "h")
    enough = F.sum("m") * MATCH >= F.lit(least) * F.first("n") - F.lit(1e-9)
    pairs = checkpoint(hits.groupBy("text_hash", "item_row").agg(enough.alias("enough")).where("enough").drop("enough"))
    wanted = small(checkpoint(pairs.select(F.col("text_hash").alias("wanted")).distinct()))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    texts = hashed.join(wanted, F.col("text_hash") == F.col("wanted"), "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    both = pairs.join(texts, "text_hash").join(items.select("item_row", "item_id", F.col("text").alias("item")), "item_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts, held = ([[vocab[c] for c in codes[a:z]] for a, z in zip(starts, starts[1:], strict=False)] for starts, codes, vocab, _ in (tokens(b.column("text")), tokens(b.column("item"))))
                tiles = [tile(a, z) for a, z in zip(texts, held, strict=True)]
                share = np.array([sum(x[2] for x in t) / len(item) for t, item in zip(tiles, held, strict=True)])
                some = np.flatnonzero(share >= least)
                told = [[dict(zip(("doc_start", "item_start", "length"), x, strict=True)) for x in tiles[k]] for k in some.tolist()]
                yield pa.RecordBatch.from_arrays([b.column("text_hash").take(pa.array(some)), b.column("item_id").take(pa.array(some)), pa.array(share[some]), pa.array(told, TILE)], ["text_hash", "item_id", "coverage", "tiles"])

    kinds = "text_hash long, item_id long, coverage double, tiles array<struct<doc_start:int,item_start:int,length:int>>"
    found = checkpoint(both.select("text_hash", "text", "item_id", "item").transform(in_arrow, run, kinds))
    return hashed.select("doc_id", "text_hash").join(small(found), "text_hash").select("doc_id", "item_id", "coverage", "tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.6) -> DataFrame:
    """The rows of docs whose text overlaps no benchmark item; a null text never goes. Rows with null or repeated ids are judged by their own texts."""
    found = overlaps(docs.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark, least)
    marked = small(checkpoint(found.select(F.col("doc_id").alias("__hash")).distinct()))
    return docs.join(marked, docs["text"].isNotNull() & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_anti").select(*docs.columns)
