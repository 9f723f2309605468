"""Helpers that the training-data operators share: tables, batched words, components. checkpoint and shared_dir are the engine's."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import checkpoint, shared_dir

__all__ = ["checkpoint", "settled", "shared_dir", "table", "written", "in_arrow", "slices", "Words", "words", "hash_strings", "mix", "kgrams", "connected_components"]

#: Bytes of text that a Python worker expands into arrays at a time, and bytes of the batches that it is sent.
SLICE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
#: Whether a query that is planned while this is set removes its shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """checkpoint, after which the shuffle files that df was made from are removed: no one reads them again, and garbage collection would leave them for long."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return checkpoint(df.select("*"))  # planned anew, under the setting
    finally:
        conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """df, written to a compressed table in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, in batches of BATCH_BYTES rather than of many long rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `limit` bytes of text each; a longer text is a part of its own."""
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(size + 64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


@dataclass
class Words:
    """The words of some texts: text i has codes[starts[i]:starts[i + 1]], which index into vocab."""

    starts: np.ndarray
    codes: np.ndarray
    vocab: pa.Array
    memo: dict = field(default_factory=dict)  # what users have looked up about the vocabulary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word, the same in every process."""
        return hash_strings(self.vocab)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)


def hash_strings(values: pa.Array) -> np.ndarray:
    if not len(values):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Splits texts at runs of ASCII white space, after lower-casing A-Z if asked; a null text has no words."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))])
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)).astype(bool)
    kept = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])
    coded = pc.dictionary_encode(flat.filter(pa.array(full)))
    return Words(kept[ends], np.asarray(coded.indices, dtype=np.int64), coded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer, over arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kgrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A rolling hash for each run of k entries: len(hashes) - k + 1 values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mix(out)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it is joined to) for every end of an edge (a, b).

    Alternates large-star and small-star steps until no edge changes. Each step is two aggregations over the
    edges, no node's neighbours are gathered in one row, and each round is cut off by checkpoints: minima are checkpointed
    before they are joined, so that Spark can split the join's partition of a node with many edges. Null ends and loops are ignored; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        large = settled(large)
        low = settled(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a")
        nexts = small.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = settled(nexts.union(low.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    parts = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return parts.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
