"""The index as segments: each change writes a small new folder of Parquet tables, then moves one pointer file over the old one.

A segment holds the notes that a commit adds, their chunks and postings, and the paths whose rows in earlier segments are dead (replaced or gone).
So a commit costs what it changes, not what the index holds; beyond MOST_SEGMENTS segments it writes them as one. Readers follow the pointer, so they see whole states
only; a run that dies leaves the old one. The fingerprint and the corpus' sums are part of the pointer and so change with the tables. Any file
system that Hadoop knows will do.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.markdown import chunk_notes, parse_notes
from lodestone.functions.text import tokens
from lodestone.operators.providers import Chunker, Contextualizer, Embedder, HashEmbedder, Parser, PlainContext
from lodestone.operators.retrieval import postings
from lodestone.sources.shared import checkpoint

NOTES = "path string, title string, frontmatter map<string,string>, tags array<string>, wikilinks array<string>, content_hash string, mtime double"
CHUNKS = "note_path string, ordinal int, heading_path array<string>, text string, token_count int, context_blurb string, embedding_text string, n_tokens long, embedding array<float>"
POSTINGS = "term string, note_path string, ordinal int, dl int, tf long, positions array<int>"
TABLES = {"notes": NOTES, "chunks": CHUNKS, "postings": POSTINGS}
KEYS = {"notes": "path", "chunks": "note_path", "postings": "note_path"}
MOST_SEGMENTS = 8


def changes(files: DataFrame, known: DataFrame, afresh: bool = False) -> DataFrame:
    """files(path, content_hash, ...) with `known`, the hash that is indexed (null: none), and `changed`: whether a note must be indexed again."""
    rows = files.join(known.select("path", F.col("content_hash").alias("known")), "path", "left")
    return rows.withColumn("changed", F.lit(afresh) | ~F.col("content_hash").eqNullSafe(F.col("known")))


def deletions(files: DataFrame, known: DataFrame) -> DataFrame:
    """path of what is indexed and no file any more."""
    return known.join(files.select("path"), "path", "left_anti").select("path")


class VaultIndex:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, contextualizer: Contextualizer | None = None, max_tokens: int = 512, parser: Parser = parse_notes, chunker: Chunker = chunk_notes) -> None:
        self.spark, self.root, self.max_tokens = spark, root.rstrip("/"), max_tokens
        self.parser, self.chunker = parser, chunker
        self.embedder, self.contextualizer = embedder or HashEmbedder(), contextualizer or PlainContext()
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def config_fingerprint(self) -> str:
        return f"{self.embedder.fingerprint}|{self.contextualizer.fingerprint}|words:{self.max_tokens}"

    def pointer(self) -> dict:
        at = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(at):
            return {}
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def fingerprint(self) -> str:
        return self.pointer().get("fingerprint", "")

    def table(self, name: str) -> DataFrame:
        return self._live(name, self.pointer().get("segments", []))

    def _live(self, name: str, segments: list[str]) -> DataFrame:
        """The rows of these segments that no later one replaces."""
        out, dead, key = None, None, KEYS[name]
        for segment in reversed(segments):
            rows = self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{segment}/{name}")
            rows = rows if dead is None else rows.join(dead, key, "left_anti").select(*rows.columns)
            out = rows if out is None else out.unionByName(rows)
            gone = self.spark.read.schema("path string").parquet(f"{self.root}/{segment}/dead").withColumnRenamed("path", key)
            dead = gone if dead is None else dead.unionByName(gone)
        return self.spark.createDataFrame([], TABLES[name]) if out is None else out

    def notes(self) -> DataFrame:
        return self.table("notes")

    def chunks(self) -> DataFrame:
        return self.table("chunks")

    def postings(self) -> DataFrame:
        return self.table("postings")

    def corpus_stats(self) -> DataFrame:
        """One row, from the pointer: the number of chunks and their average length in tokens."""
        now = self.pointer()
        n = now.get("chunks", 0)
        return self.spark.createDataFrame([(n, now.get("tokens", 0) / n if n else None)], "n_chunks long, avgdl double")

    def known_hashes(self) -> DataFrame:
        return self.notes().select("path", "content_hash")

    def stats(self) -> dict:
        now = self.pointer()
        return {"notes": now.get("notes", 0), "chunks": now.get("chunks", 0), "last_indexed": time.time(), "committed": now.get("committed"), "config_fingerprint": now.get("fingerprint", "")}

    def _commit(self, notes: DataFrame, chunks: DataFrame, dead: DataFrame, fingerprint: str, afresh: bool = False) -> None:
        """A segment of these notes and chunks, in which dead(path) names what leaves earlier ones. afresh: nothing of earlier ones stays."""
        before = self.pointer().get("segments", [])
        old = [] if afresh else before
        name = f"segment-{uuid.uuid4()}"
        self._write(name, notes, chunks, dead)
        segments = [*old, name]
        if len(segments) > MOST_SEGMENTS:
            whole = f"segment-{uuid.uuid4()}"
            self._write(whole, self._live("notes", segments), self._live("chunks", segments), dead.limit(0))
            segments = [whole]
        text = self._live("chunks", segments).agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
        now = {"segments": segments, "fingerprint": fingerprint, "committed": time.time(), "notes": self._live("notes", segments).count(), "chunks": text.n, "tokens": text.t}
        self._point(now)
        for s in self._fs.listStatus(self._path(self.root)):  # the segments before are kept for those who read them, until the next commit
            if s.getPath().getName().startswith("segment-") and s.getPath().getName() not in (*segments, *before):
                self._fs.delete(s.getPath(), True)

    def _write(self, name: str, notes: DataFrame, chunks: DataFrame, dead: DataFrame) -> None:
        notes.select(*self._names("notes")).write.parquet(f"{self.root}/{name}/notes")
        chunks.select(*self._names("chunks")).write.parquet(f"{self.root}/{name}/chunks")
        written = self.spark.read.schema(CHUNKS).parquet(f"{self.root}/{name}/chunks")
        postings(written).select(*self._names("postings")).repartitionByRange("term").sortWithinPartitions("term", "note_path", "ordinal").write.parquet(f"{self.root}/{name}/postings")
        dead.select("path").distinct().write.parquet(f"{self.root}/{name}/dead")

    def _point(self, now: dict) -> None:
        """Moves a new pointer over the old one, in one step."""
        part, at = self._path(f"{self.root}/.CURRENT-{uuid.uuid4()}"), self._path(f"{self.root}/CURRENT")
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps(now).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
        options[0] = getattr(jvm, "Options$Rename").OVERWRITE
        context = jvm.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(part), self._fs.makeQualified(at), options)

    @staticmethod
    def _names(table: str) -> list[str]:
        return [x.split()[0] for x in TABLES[table].split(", ")]

    def build_chunks(self, parsed: DataFrame) -> DataFrame:
        rows = self.chunker(parsed, self.max_tokens)
        blurbs = self.contextualizer.blurbs(parsed)
        rows = rows.withColumn("context_blurb", F.lit(None).cast("string")) if blurbs is None else rows.join(blurbs, "note_path", "left")
        text = F.when(F.coalesce("context_blurb", F.lit("")) == "", F.col("text")).otherwise(F.concat("context_blurb", F.lit("\n\n"), "text"))
        rows = rows.withColumn("embedding_text", text).withColumn("n_tokens", F.size(tokens(F.col("embedding_text"))).cast("long"))
        return rows.withColumn("embedding", self.embedder.column(F.col("embedding_text")))

    def diff(self, files: DataFrame) -> DataFrame:
        """files with `changed`: whether a note must be indexed again."""
        return changes(files, self.known_hashes(), self.fingerprint() != self.config_fingerprint).drop("known")

    def reindex(self, files: DataFrame) -> dict:
        """Brings the index to the state of files(path, raw, mtime, content_hash): only changed notes are parsed, chunked and embedded, once.

        Notes that are gone, or have no chunk (any more), leave the index."""
        afresh = self.fingerprint() != self.config_fingerprint
        marked = checkpoint(self.diff(files))
        gone = deletions(marked, self.known_hashes())
        if not afresh and not marked.where("changed").limit(1).count() and not gone.limit(1).count():
            return self.stats()
        parsed = checkpoint(self.parser(marked.where("changed")))
        fresh = checkpoint(self.build_chunks(parsed))
        notes = parsed.join(fresh.select(F.col("note_path").alias("path")), "path", "left_semi")
        self._commit(notes, fresh, gone.unionByName(parsed.select("path")), self.config_fingerprint, afresh)
        return self.stats()

    def upsert(self, notes: DataFrame, chunks: DataFrame) -> None:
        """Replaces these notes and all their chunks. A chunk without an embedding is refused."""
        if chunks.where("embedding is null").limit(1).count():
            raise ValueError("every chunk needs an embedding")
        notes, chunks = checkpoint(notes), checkpoint(chunks)
        self._commit(notes, chunks, notes.select("path"), self.fingerprint())

    def delete(self, paths: Sequence[str] | DataFrame) -> None:
        gone = paths.select("path") if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "path string")
        self._commit(self.notes().limit(0), self.chunks().limit(0), gone, self.fingerprint())
