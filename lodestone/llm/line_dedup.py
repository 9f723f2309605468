"""Removal of repeated passages by content-defined word k-grams.

Of each LEAST_WORDS neighbouring words, the k-gram with the least hash is an anchor (winnowing), so two copies of a passage of so many
words have an anchor in common wherever they stand, however they are cut into lines, and whatever is beside them. Anchors that occur again
anywhere in the corpus are counted by hash; those that repeat one other text at one distance are merged to a run; each run is compared with the bytes
of its first occurrence, with LEAST_WORDS words more on either side, and what is equal in so many words is removed. The first occurrence
(in the order in which the table is read) stays. Equal words farther than that from a run hold anchors, and so runs, of their own.

Texts are written once to the shared folder with a number for each row, so that repeated and null ids are rows of their own; an anchor is three numbers.
Shuffles: anchor hashes (the first and last place of each in a slice of texts), anchors by hash (a plain equi-join with a checkpointed table, whose skewed
partitions Spark splits), runs (merged before they are shuffled), and texts by row. No group of copies is ever held in one row or task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import in_arrow, kgrams, mix, slices, written

#: Repeated passages of so many words are removed.
LEAST_WORDS = 20
#: A place is a row's number and a position in its text; a longer text has further numbers.
POS_BITS, ROW_BITS = 24, 21
BLANK = " \t\n\v\f\r"
ANCHOR_SCHEMA = "h long, place long, rooms long"
K = 6  # words of an anchor
#: The bits of an anchor's hash that are told: what agrees in them by chance is refused when bytes are compared, and low bytes of 0 take no space.
TOLD = np.uint64(0xFFFFFFFFFFFF0000)
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
RADIX = np.uint64(0x9E3779B97F4A7C15)
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words_of(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """text, pos, end (in code points) and hash of the words, which ASCII white space separates, from the bytes of all texts at once."""
    at = np.frombuffer(texts.buffers()[1] or bytes(4), np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    first, last = cut[:-1].copy(), cut[1:].copy()
    first[1:] |= ~solid[:-1]
    last[:-1] |= ~solid[1:]
    start, stop = np.flatnonzero(first & solid), np.flatnonzero(last & solid) + 1
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    # of the first and the last eight bytes and the size: equal words have equal hashes, and what seems equal is compared later
    size = stop - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    head = eight[start] & LOW[np.minimum(size, 8)]
    h = mix(head + size.astype(np.uint64) * RADIX) + np.where(size > 8, eight[np.maximum(stop - 8, 0)], head)
    text = np.searchsorted(at, start, "right") - 1
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
    base = lead[at[text]]
    return text, (lead[start] - base).astype(np.int64), (lead[stop] - base).astype(np.int64), mix(h)


def farthest(x: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
    """of (minimum or maximum) over each n neighbours."""
    width = 1
    while 2 * width <= n:
        x, width = of(x[:-width], x[width:]), 2 * width
    return of(x[: len(x) - (n - width)], x[n - width :])


def chunks_of(texts: pa.Array, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """text, pos, room and hash of the anchors: the k-grams with the least hash among those of some least_words words in a row.

    Which ones these are follows from those words alone; of equal ones that follow each other, as in a text of one word, one in each stretch is
    enough. room: how far from pos the least_words words before, and the anchor with as many behind, reach."""
    text, pos, end, h = words_of(texts)
    k = min(K, least_words)
    n = least_words - k + 1
    if len(h) < least_words:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros((2, 0), np.int64), np.zeros(0, np.uint64))
    key = kgrams(h, k)
    low = farthest(key, n, np.minimum)
    low[text[: len(low)] != text[least_words - 1 :]] = 0
    # an anchor is the least of one of the n windows that it is in
    none = np.zeros(n - 1, np.uint64)
    at = np.flatnonzero((farthest(np.concatenate([none, low, none]), n, np.maximum) == key) & (text[: len(key)] == text[k - 1 :]))
    fresh = np.ones(len(at), bool)
    fresh[1:] = (key[at[1:]] != key[at[:-1]]) | (np.diff(at) >= n) | (text[at[1:]] != text[at[:-1]])
    since = at - at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(at) else at
    fresh[1:] |= (since[1:] // n != since[:-1] // n) & ~fresh[1:]
    at = at[fresh]
    last, own = at + k - 1, text[at]
    far = np.maximum(at - least_words, np.searchsorted(text, own)), np.minimum(last + least_words, np.searchsorted(text, own, "right") - 1)
    return own, pos[at], np.stack([pos[at] - pos[far[0]], end[far[1]] - pos[at]]), key[at]


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number `__row` for each row, in a table in the shared folder. A text takes one number for each 2 ** POS_BITS code points that it begins.

    Numbers ascend in the order in which docs is read."""
    names, i = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    kind = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))
    size = plain.withColumn("__n", (F.coalesce(F.char_length(f"c{i}"), F.lit(0)) / (1 << POS_BITS)).cast("long") + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        at, limit = number << ROW_BITS, (number + 1) << ROW_BITS
        for b in batches:
            n = np.asarray(b.column("__n"), dtype=np.int64)
            rows = at + np.cumsum(n) - n
            at += int(n.sum())
            if at >= limit or number >= 1 << (63 - POS_BITS - ROW_BITS):
                raise ValueError("more rows in a partition, or partitions, than numbers")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows)], [*b.schema.names[:-1], "__row"])

    out = written(size.transform(in_arrow, run, kind + ", __row long")).toDF(*names, "__row")
    return out.where("__row is not null")  # as every join asks: one plan for all


def find_chunks(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """ANCHOR_SCHEMA of docs(row, text): rooms are two numbers of 32 bits, how far to look before and behind, rounded up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                text, pos, room, key = chunks_of(pc.fill_null(b.column("text"), ""), least_words)
                place = (np.asarray(b.column("row"), dtype=np.int64)[text] << POS_BITS) + pos
                room = -(-room // 32) * 32  # few different numbers take less space
                yield pa.RecordBatch.from_arrays([pa.array((key & TOLD).view(np.int64)), pa.array(place), pa.array((room[0] << 32) + room[1])], ["h", "place", "rooms"])

    return docs.select("row", "text").transform(in_arrow, run, ANCHOR_SCHEMA)


def repeated_hashes(docs: DataFrame, least_words: int) -> DataFrame:
    """h and f (the first place) of the anchors that occur at several places; of each hash a slice of texts tells only its first and last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                text, pos, _, key = chunks_of(pc.fill_null(b.column("text"), ""), least_words)
                place = (np.asarray(b.column("row"), dtype=np.int64)[text] << POS_BITS) + pos
                key &= TOLD
                order = np.argsort(key, kind="stable")  # places ascend, as rows do
                key, place = key[order], place[order]
                change = key[1:] != key[:-1]
                ends = np.concatenate([[True], change]) | np.concatenate([change, [True]]) if len(key) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(key[ends].view(np.int64)), pa.array(place[ends])], ["h", "place"])

    rows = docs.select("row", "text").transform(in_arrow, run, "h long, place long")
    return rows.groupBy("h").agg(F.min("place").alias("f"), F.max("place").alias("l")).where("f < l").select("h", "f")


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """row, f_row (a number of the first occurrence's text), shift (how much farther the run stands than it), and from where (a) to where (z) to compare."""
    again = written(repeated_hashes(docs, least_words))
    found = find_chunks(docs, least_words).join(again.hint("shuffle_hash"), "h").where("place <> f")  # each hash once: the table of a partition is small
    pos, f_pos = (F.col(c).bitwiseAND(F.lit((1 << POS_BITS) - 1)) for c in ("place", "f"))
    found = found.select(
        F.shiftright("place", POS_BITS).alias("row"), F.shiftright("f", POS_BITS).alias("f_row"), (pos - f_pos).alias("shift"),
        (pos - F.shiftright("rooms", 32)).alias("a"), (pos + F.col("rooms").bitwiseAND(F.lit((1 << 32) - 1))).alias("z"),
    )
    return found.groupBy("row", "f_row", "shift").agg(F.min("a").alias("a"), F.max("z").alias("z"))


def equal_stretches(own: str, other: str, a: int, edge: bool, more: bool, least_words: int) -> list[tuple[int, int]]:
    """The stretches in which own (which begins at place a of its text) and other are equal, of whole words in both and least_words words or more.

    One that is shorter ends where its text does. edge: whether they begin where a text does; more: whether own's text goes on behind it."""
    if own == other:
        cuts = [(0, len(own))]
    else:
        n = min(len(own), len(other))
        same = np.frombuffer(own[:n].encode("utf-32-le"), np.uint32) == np.frombuffer(other[:n].encode("utf-32-le"), np.uint32)
        turn = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        cuts = [(int(x), int(z)) for x, z in zip(turn[::2], turn[1::2], strict=True) if z - x >= 2 * least_words - 1]
    out = []
    for x, z in cuts:
        if x or not edge:  # a word that began before is no whole one
            x = next((p for p in range(x, z) if own[p] in BLANK), z)
        while x < z and own[x] in BLANK:
            x += 1
        y = z
        if (more and z == len(own)) or not (own[z : z + 1] in BLANK and other[z : z + 1] in BLANK):
            while y > x and own[y - 1] not in BLANK:
                y -= 1
        while y > x and own[y - 1] in BLANK:
            y -= 1
        if x < y and len(own[x:y].split()) >= least_words:
            out.append((a + x, a + y))
    return out


def spans_to_cut(text: str, runs: list[dict], least_words: int) -> tuple[list[tuple[int, int]], int]:
    """The places of text that equal the runs' first occurrences, joined where they touch, each with the white space behind it;
    and how many code points equal other texts."""
    found = [(x, z, r["inside"]) for r in runs for x, z in equal_stretches(text[r["a"] : r["z"]], r["near"], r["a"], r["edge"], r["z"] < len(text), least_words)]
    merged = joined(text, [x[:2] for x in found])
    return merged, sum(z - x for x, z in joined(text, [x[:2] for x in found if not x[2]]))


def joined(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        while b < len(text) and text[b] in BLANK:
            b += 1
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with repeated passages cut from text, and the column `removed`: array of (start, end) in the old text.

    A passage is cut if it has least_words words, wherever they stand in lines. Nulls and texts
    without repeats stay as they are. Every row is a text of its own, also if ids repeat or are null: of equal rows, the
    first stays. n_chars, if there is such a column, follows the new text. Other
    columns are kept; one of the name `removed` is replaced. Equal passages of one text repeat each other too. An empty table gives no rows.
    """
    return cut_repeats(docs.drop("removed"), least_words).drop("copied")


def cut_repeats(docs: DataFrame, least_words: int) -> DataFrame:
    """remove_repeats, and the column `copied`: how many code points were cut because they equal other texts."""
    docs = numbered(docs)
    names, i = docs.columns[:-1], docs.columns.index("text")
    tagged = docs.toDF(*(f"c{k}" for k in range(len(names))), "row")
    runs = repeated_runs(tagged.select("row", F.col(f"c{i}").alias("text")), least_words)
    # a number of a text's later places stands for its first one
    long = tagged.where(F.char_length(f"c{i}") >= 1 << POS_BITS).select(F.col("row").alias("f_own"), (F.char_length(f"c{i}") / (1 << POS_BITS)).cast("long").alias("n"))
    long = long.withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select((F.col("f_own") + F.col("slot")).alias("f_row"), "slot")
    runs = runs.join(long, "f_row", "left").withColumn("slot", F.coalesce("slot", F.lit(0)))
    runs = runs.select(F.col("row").alias("r_row"), (F.col("f_row") - F.col("slot")).alias("f_own"), (F.col("shift") - F.shiftleft("slot", POS_BITS)).alias("shift"), "a", "z")
    told = runs.join(tagged, F.col("f_own") == F.col("row"))
    told = told.withColumns({"a": F.greatest(F.col("a") - 1, F.lit(0), "shift"), "z": F.col("z") + 1})
    near = F.expr(f"substring(c{i}, cast(a - shift + 1 as int), cast(z - a as int))")
    part = F.struct(
        F.col("a").cast("int").alias("a"), F.col("z").cast("int").alias("z"), ((F.col("a") == 0) | (F.col("a") == F.col("shift"))).alias("edge"), near.alias("near"), (F.col("r_row") == F.col("row")).alias("inside"),
    )
    # asking for all columns lets both joins read one shuffle of the texts
    plain = [f"c{k}" for k, c in enumerate(names) if k != i and docs.schema[c].dataType.typeName() not in ("map", "variant")]
    told = told.select(F.col("r_row").alias("row"), part.alias("r"), (F.hash(*plain) if plain else F.lit(0)).alias("all"))
    told = told.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("r.*", "all")).alias("runs"))
    both = tagged.join(told, F.col("row") == F.col("of"), "left").select(*(f"c{k}" for k in range(len(names))), "runs")
    n_at = names.index("n_chars") if "n_chars" in names else None
    fields = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(names)) + ", removed array<struct<start:int,end:int>>, copied long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = np.asarray(pc.is_valid(b.column("runs")))
            mask, cuts, fresh, copied = pa.array(some), [[]] * b.num_rows, [], np.zeros(b.num_rows, np.int64)
            for k in np.flatnonzero(some).tolist():
                t = b.column(i)[k].as_py()
                spans, copied[k] = spans_to_cut(t, b.column("runs")[k].as_py(), least_words) if t else ([], 0)
                cuts[k] = [{"start": x, "end": y} for x, y in spans]
                if spans:
                    edges = [0, *(p for s in spans for p in s), len(t)]
                    t = "".join(t[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                fresh.append(t)
            columns = list(b.columns[: len(names)])
            columns[i] = pc.replace_with_mask(columns[i], mask, pa.array(fresh, columns[i].type))
            if n_at is not None:
                size = pc.utf8_length(columns[i]).cast(columns[n_at].type)
                columns[n_at] = pc.if_else(pa.array([bool(c) for c in cuts]), size, columns[n_at])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cuts, kind), pa.array(copied)], [*(f"c{k}" for k in range(len(names))), "removed", "copied"])

    return both.transform(in_arrow, run, fields).toDF(*names, "removed", "copied")


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, least_left: float = 0.2) -> DataFrame:
    """remove_repeats, with docs' columns alone and without the documents of which all but a share least_left of the code points equals other texts.

    Such documents are copies or near copies of earlier ones. Documents that repeat only themselves stay, and null and empty texts too."""
    names = [c if c in ("doc_id", "text", "n_chars") else f"c{k}" for k, c in enumerate(docs.columns)]
    kept = cut_repeats(docs.toDF(*names), least_words)
    cut = F.aggregate("removed", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    whole = F.char_length("text") + cut
    return kept.where((F.size("removed") == 0) | (F.col("copied") < (1 - least_left) * whole)).drop("removed", "copied").toDF(*docs.columns)
