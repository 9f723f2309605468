"""Self-join of documents on the Jaccard similarity of their word 5-grams, by chosen paths.

Documents with one set of 5-grams form a class, and only a representative of each class is joined. Its set is embedded as
128 minima (sampled tokens of the set, one for each hash function). A run is a random tree: at each node one of the minima, chosen by the
node, sends a set to the child named by that token, so that similar sets part at a level with probability 1 - J. Buckets are
split until they have SMALL sets, or to DEPTH levels. What is still larger then holds many near copies: sets of a similarity of (1 + s) / 2 or more to the bucket's
least one form a core, whose members are all linked, since the Jaccard distance is a metric; their links are counted, not compared. The rest of such a bucket is dealt to blocks, and
all pairs of blocks, but for those of one core, are compared. Each small bucket or pair of blocks is compared by brute force. RUNS independent runs bring the recall of a pair at J = 0.8 in the deepest
buckets to the target; pairs are counted in the first bucket that they share. A first pass over sketches finds the buckets
in which a document has a likely partner; the second compares whole sets there, exactly.

Pairs are never written: a bucket gives each document's number of links, and a star for each local component. Each step is checkpointed, and its shuffle
files are removed then, so that disk holds those of one step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import connected_components, in_arrow, kgrams, mix, settled, slices, words
from lodestone.operators.retrieval import small

SHINGLE = 5
MINIMA = 128
DEPTH = 3
SMALL = 256
BLOCK = SMALL // 2
#: So many large nodes are broadcast; more are copied for each salt.
HEAVY_ROWS, SALTS = 100_000, 16
SKETCH_SCHEMA = "doc_id long, text_hash long, n int, key_a long, key_b long, sketch binary, paths array<long>"


def runs_for(similarity: float, recall: float) -> int:
    """Runs after which a pair at this similarity has met at DEPTH levels with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**DEPTH)))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 5-gram hashes of each text; a text of under five words has one, of all its words, or none."""
    w = words(texts)
    h = w.hashes()
    grams, out = kgrams(h, SHINGLE), []
    for a, b in zip(w.starts[:-1].tolist(), w.starts[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(kgrams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def embed(sets: list[np.ndarray], runs: int) -> tuple[np.ndarray, np.ndarray]:
    """The minima of each set, and its nodes at levels 1 to DEPTH of each run. No set is empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    seeds = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64))
    minima = np.empty((len(sets), MINIMA), np.uint64)
    for t in range(MINIMA):
        minima[:, t] = np.minimum.reduceat((flat ^ seeds[t]) * (seeds[MINIMA + t] | np.uint64(1)), starts)
    paths = np.empty((len(sets), runs, DEPTH), np.uint64)
    at = np.arange(len(sets))
    for r in range(runs):
        node = np.full(len(sets), mix(np.array([r + 1], np.uint64) << np.uint64(32))[0])
        for d in range(DEPTH):
            node = mix(node + minima[at, (node % np.uint64(MINIMA)).astype(np.int64)])
            paths[:, r, d] = node
    return minima, paths.reshape(len(sets), -1)


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    seeds = (np.uint64(0), np.uint64(0x5851F42D4C957F2D))
    return tuple(np.array([mix(s ^ seed).sum() for s in sets], np.uint64).view(np.int64) for seed in seeds)


def sketches(docs: DataFrame, runs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = shingle_sets(b.column("text"))
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                sets = [sets[i] for i in full]
                minima, paths = embed(sets, runs)
                keys = set_keys(sets)
                low = (mix(minima) & np.uint64(0xFFFF)).astype("<u2")
                columns = [
                    b.column("doc_id").take(pa.array(full)), b.column("text_hash").take(pa.array(full)), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys[0]), pa.array(keys[1]),
                    pa.array([x.tobytes() for x in low], pa.binary()), pa.array(list(paths.view(np.int64)), pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "key_a", "key_b", "sketch", "paths"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).transform(in_arrow, run, SKETCH_SCHEMA)


def with_heavy(rows: DataFrame, heavy: DataFrame, key: str) -> DataFrame:
    """rows with `size` from heavy(key, size), null where it has no such key.

    heavy has few keys, each of many rows: it is broadcast if it has HEAVY_ROWS rows at most (counted), else copied for SALTS salts, by which rows are dealt."""
    if heavy.count() <= HEAVY_ROWS:
        return rows.join(F.broadcast(heavy), key, "left")
    heavy = heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep", "run"), F.lit(SALTS)).cast("int")).join(heavy, [key, "salt"], "left").drop("salt")


def buckets(reps: DataFrame, runs: int) -> DataFrame:
    """rep, run, bucket and size (over 1) of the bucket in which each run's splitting ends.

    Nodes of more than SMALL sets are told apart first; the join of the others with their sizes has no larger key."""
    level = lambda d: F.array(*(F.col("paths")[r * DEPTH + d] for r in range(runs)))
    rows = reps.select("rep", F.posexplode(F.arrays_zip(*(level(d).alias(f"l{d}") for d in range(DEPTH)))).alias("run", "node"))
    rows = rows.select("rep", "run", *(F.col(f"node.l{d}").alias(f"l{d}") for d in range(DEPTH)))
    done = None
    for d in range(DEPTH):
        key = f"l{d}"
        counts = settled(rows.groupBy(key).agg(F.count("*").alias("size")).where("size > 1"))
        told = with_heavy(rows, counts.where(F.col("size") > SMALL), key)
        hot = settled(told.where("size is not null"))
        ended = told.where("size is null").drop("size").join(counts.where(F.col("size") <= SMALL), key)
        if d == DEPTH - 1:
            ended = ended.unionByName(hot)
        ended = ended.select("rep", "run", F.col(key).alias("bucket"), "size")
        done = ended if done is None else done.unionByName(ended)
        rows = hot.drop("size")
    return done


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b, "text"):
            sets = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, set_keys(sets)), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["key_a", "key_b", "grams"])


def sets_of(docs: DataFrame, classes: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and grams (its sorted 5-gram hashes) of each of reps(rep)."""
    wanted = settled(classes.join(reps.distinct(), "rep").select("rep", "key_a", "key_b", F.col("w.doc_id").alias("of")))
    of = small(settled(wanted.select(F.col("of").alias("doc_id")).distinct()))  # few ids are broadcast, so that documents aren't shuffled
    texts = docs.join(of, "doc_id", "left_semi").select("text")
    sets = texts.transform(in_arrow, grams, "key_a long, key_b long, grams binary")
    return sets.join(wanted.drop("of"), ["key_a", "key_b"]).groupBy("rep").agg(F.first("grams").alias("grams"))


def cores(found: DataFrame, docs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """rep and core (the least set of a large bucket that it is close to) of each set that is in a core; no rows without large buckets."""
    big = found.where(F.col("size") > SMALL).select("rep", "bucket")
    least = settled(big.groupBy("bucket").agg(F.min("rep").alias("core")))
    pairs = settled(big.join(least, "bucket").groupBy("rep").agg(F.min("core").alias("core")))
    if pairs.isEmpty():
        return pairs
    sets = settled(sets_of(docs, classes, pairs.select("rep").union(pairs.select("core"))))
    both = pairs.join(sets, "rep").join(sets.toDF("core", "center"), "core")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("grams"), b.column("center"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common >= (1 + similarity) / 2 * (len(x) + len(y) - common) + 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("core")], ["rep", "core"]).filter(pa.array(ok, pa.bool_()))

    return settled(both.select("rep", "core", "grams", "center").transform(in_arrow, close, "rep long, core long"))


def cells(found: DataFrame, core: DataFrame) -> DataFrame:
    """rep, run, cell, core (-1: none), side and crossed: a small bucket is a cell; a larger one gives a cell for each two of its blocks that aren't of one core."""
    rows = found.join(core, "rep", "left").withColumn("core", F.coalesce("core", F.lit(-1)))
    small = rows.where(F.col("size") <= SMALL).select("rep", "run", F.xxhash64("bucket", F.lit(0)).alias("cell"), "core", F.lit(0).alias("side"), F.lit(False).alias("crossed"))
    rows = rows.where(F.col("size") > SMALL)
    n = rows.groupBy("bucket", "core").agg(F.count("*").alias("n")).withColumn("part", F.when(F.col("n") >= BLOCK, F.col("core")).otherwise(-1))
    blocks = n.groupBy("bucket", "part").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("n"))
    blocks = blocks.select("bucket", "part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"), "n")
    layout = settled(blocks.groupBy("bucket").agg(F.collect_list(F.struct("part", "k")).alias("blocks"), F.map_from_entries(F.collect_set(F.struct("part", "n"))).alias("n")))
    rows = rows.join(layout, "bucket")
    part = F.when(F.map_contains_key("n", F.col("core")), F.col("core")).otherwise(-1)
    rows = rows.withColumn("part", part).withColumn("k", F.pmod(F.xxhash64("rep", "bucket"), F.col("n")[F.col("part")]).cast("int"))
    others = F.filter("blocks", lambda x: (x["part"] != F.col("part")) | (F.col("part") == -1))
    rows = rows.select("rep", "run", "bucket", "core", F.xxhash64("part", "k").alias("own"), F.explode(F.transform(others, lambda x: F.xxhash64(x["part"], x["k"]))).alias("other"))
    cell = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select("rep", "run", cell.alias("cell"), "core", F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("own") != F.col("other")).alias("crossed"))
    return small.unionByName(rows)


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, from batches in the order of cells."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cell = np.asarray(b.column("cell"))
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            part = b.slice(a, z - a)
            if held and held[0].column("cell")[0] != part.column("cell")[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def first_met(t: pa.Table) -> np.ndarray:
    """Which pairs of a cell's rows meet here and in no earlier run, and aren't of one core."""
    run = t.column("run")[0].as_py()
    met, core = np.array(t.column("met").to_pylist(), np.int64), np.asarray(t.column("core"))
    ok = np.triu(np.ones((len(met), len(met)), bool), 1)
    ok &= (core[:, None] != core[None]) | (core[:, None] < 0)
    if t.column("crossed")[0].as_py():
        side = np.asarray(t.column("side"))
        ok &= side[:, None] != side[None]
    for r in range(run):
        ok &= (met[:, None, r] != met[None, :, r]) | (met[:, None, r] == 0)
    return ok


def likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for t in by_cell(batches):
        if len(t) < 2:
            continue
        ok = first_met(t)
        x = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u2").reshape(len(t), -1)
        same = np.zeros(ok.shape, np.int16)
        for k in range(x.shape[1]):
            same += x[:, None, k] == x[None, :, k]
        ok &= same >= least * x.shape[1]
        some = np.flatnonzero(ok.any(0) | ok.any(1))
        if len(some):
            yield from t.select(["cell", "rep", "run", "core", "side", "crossed", "met", "copies"]).take(pa.array(some)).combine_chunks().to_batches()


def intersections(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """The sizes of all pairs' intersections, by products of 0/1 matrices over the tokens that occur twice at least."""
    flat = np.concatenate(sets)
    token, index, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    again = count[index] > 1
    place = np.cumsum(count > 1) - 1
    row, col = row[again], place[index[again]]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for a in range(0, int((count > 1).sum()), columns):
        lo, hi = np.searchsorted(col, [a, a + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[row[lo:hi], col[lo:hi] - a] = 1
        out += m @ m.T
    return out


def linked(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for t in by_cell(batches):
        if len(t) < 2:
            continue
        ok = first_met(t)
        sets = [np.frombuffer(x, "<u8") for x in t.column("grams").to_pylist()]
        size = np.array([len(s) for s in sets], float)
        both = intersections(sets)
        ok &= both >= similarity * (size[:, None] + size[None] - both) - 1e-9
        if not ok.any():
            continue
        ok |= ok.T
        copies, rep = np.asarray(t.column("copies")), np.asarray(t.column("rep"))
        root = np.arange(len(t))
        while True:  # the least index that a row's component holds
            low = np.where(ok, root[None], len(t)).min(1)
            low = np.minimum(low, root)
            low = low[low]
            if (low == root).all():
                break
            root = low
        least = np.array([rep[root == k].min() if (root == k).any() else 0 for k in range(len(t))])
        some = np.flatnonzero(ok.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array((ok * copies[None]).sum(1)[some]), pa.array(least[root[some]])], ["rep", "links", "least"])


def similar_documents(docs: DataFrame, similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """doc_id, class_id (the least doc_id of its component of links) and n_links (other documents linked to it) of each row.

    Two documents are linked if the Jaccard similarity of their sets of lower-case word 5-grams is `similarity` or more
    (white space separates words; under five words, all of them are the one 5-gram). Null texts and texts without words
    are linked to nothing, not even to each other. A null doc_id gives a null class and no links. Rows with one doc_id and one
    text count as copies; those of one doc_id and several texts are documents of their own, each with its class. An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    rest = docs.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t-\r]"))
    rest = rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return classified(docs, similarity, recall).drop("text_hash").unionByName(rest)


def classified(docs: DataFrame, similarity: float, recall: float) -> DataFrame:
    """doc_id, text_hash, class_id and n_links of each row with an id and a word."""
    runs = runs_for(similarity, recall)
    docs = docs.select("doc_id", "text")
    keys = ["key_a", "key_b"]
    sk = settled(sketches(docs.where("doc_id is not null"), runs))
    whole = F.struct("doc_id", "sketch", "paths")
    classes = settled(sk.groupBy(*keys).agg(F.min_by(whole, "doc_id").alias("w"), F.count("*").alias("copies")))
    classes = classes.withColumn("rep", F.monotonically_increasing_id())  # of rows that are written: the same whenever it is asked
    reps = classes.select("rep", "w.sketch", "w.paths", "copies")
    found = settled(buckets(reps, runs))
    met = found.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("run", "bucket"))).alias("m"))
    met = met.select("rep", F.array(*(F.coalesce(F.try_element_at("m", F.lit(r)), F.lit(0)) for r in range(runs))).alias("met"))
    core = cores(found, docs.where("doc_id is not null"), classes, similarity)
    rows = cells(found, core).join(reps.select("rep", "sketch", "copies").join(met, "rep"), "rep")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "rep")
    margin = 4 * math.sqrt(similarity * (1 - similarity) / MINIMA)
    likely_schema = "cell long, rep long, run int, core long, side int, crossed boolean, met array<long>, copies long"
    near = settled(rows.transform(in_arrow, lambda it: likely(it, similarity - margin), likely_schema))
    sets = sets_of(docs, classes, near.select("rep"))
    checked = near.join(sets, "rep").repartition("cell").sortWithinPartitions("cell", "rep")
    links = settled(checked.transform(in_arrow, lambda it: linked(it, similarity), "rep long, links long, least long"))
    edges = links.select(F.col("rep").alias("a"), F.col("least").alias("b")).union(core.select("rep", "core"))
    parts = settled(connected_components(edges).withColumnRenamed("node", "rep"))
    inner = core.join(classes.select("rep", "copies"), "rep")
    inner = inner.join(settled(inner.groupBy("core").agg(F.sum("copies").alias("all"))), "core").select("rep", (F.col("all") - F.col("copies")).alias("links"))
    total = links.select("rep", "links").union(inner).groupBy("rep").agg(F.sum("links").alias("links"))
    of = classes.select("rep", *keys, "copies", F.col("w.doc_id").alias("least")).join(total, "rep", "left").join(parts, "rep", "left")
    ids = of.where("component is not null").groupBy("component").agg(F.min("least").alias("class_id"))
    of = of.join(settled(ids), "component", "left")
    of = of.select(*keys, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class_id", "least").alias("class_id"))
    return sk.select("doc_id", "text_hash", *keys).join(of, keys).select("doc_id", "text_hash", "class_id", "n_links")


def one_of_each(docs: DataFrame, similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """The rows of docs without those linked, directly or by way of others, to a document of a lesser doc_id.

    Rows with a null id, and texts that are null or have no word, stay; rows that repeat one id and text stay or go together; of an id
    with several texts each is judged by its own. An empty table gives no rows; other columns are kept as they are."""
    gone = classified(docs, similarity, recall).where("doc_id <> class_id").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    gone = settled(gone.distinct())
    return docs.join(gone, (docs["doc_id"] == gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__hash"]), "left_anti").select(*docs.columns)
