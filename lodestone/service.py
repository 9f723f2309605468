"""The five tools as plain functions, for any server, and their JSON payloads."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import retrieval
from lodestone.operators.providers import ChatContext, HttpChat, PlainContext, PlainRerank, embedder_of, or_plain, reranker_of
from lodestone.sources.files import Config
from lodestone.sources.store import VaultIndex
from lodestone.sources.vault import scan_vault


class Service:
    def __init__(self, spark: SparkSession, config: Config) -> None:
        self.spark, self.config = spark, config
        build = (lambda: ChatContext(HttpChat(**config.chat), config.chat["model"])) if config.contextualize else None
        self.index = VaultIndex(spark, config.index_path, embedder_of(config.embedder, config.dimension, config.embedder_options), or_plain(build, PlainContext(), "the contextualizer"), config.max_tokens)
        rerank = (lambda: reranker_of(config.reranker, config.reranker_options)) if config.rerank else None
        self.reranker = or_plain(rerank, PlainRerank(), "the reranker")

    def _queries(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "query_id long, text string")

    def _search(self, text: str, k: int, tags: Sequence[str], paths: Sequence[str]) -> DataFrame:
        i, c = self.index, self.config
        kept = retrieval.filtered_notes(i.notes(), tags, paths)
        return retrieval.search_knowledge(i.chunks(), i.postings(), i.corpus_stats(), self._queries(text), i.embedder, k, c.k_dense, c.k_sparse, c.pool, self.reranker, kept)

    def status(self) -> dict:
        return self.index.stats()

    def reindex(self) -> dict:
        return self.index.reindex(scan_vault(self.spark, self.config.vault_path, self.config.ignore))

    def search_knowledge(self, query: str, k: int = 10, tags: Sequence[str] = (), paths: Sequence[str] = ()) -> dict:
        """Passages; tags and path globs, if given, narrow down the notes."""
        rows = self._search(query, k, tags, paths).join(self.index.chunks().select("note_path", "ordinal", "heading_path"), retrieval.KEY).orderBy("rank").collect()
        return {"results": [{"note_path": r.note_path, "heading_path": list(r.heading_path), "text": r.text, "score": r.score} for r in rows]}

    def search_sources(self, query: str, k: int = 10, tags: Sequence[str] = (), paths: Sequence[str] = ()) -> dict:
        rows = retrieval.search_sources(self._search(query, 50, tags, paths), self.index.notes(), k).orderBy("rank").collect()
        return {"sources": [{"note_path": r.note_path, "title": r.title, "hit_count": r.hit_count, "best_score": r.best_score, "snippets": list(r.snippets)} for r in rows]}

    def get_note(self, path: str) -> dict:
        row = retrieval.read_notes(self.index.notes(), self.index.chunks(), self.spark.createDataFrame([(path,)], "path string")).first()
        return {"found": True, "note_path": row.note_path, "title": row.title, "text": row.text} if row else {"found": False}

    def call(self, tool: str, arguments: dict) -> str:
        if tool not in ("status", "reindex", "search_knowledge", "search_sources", "get_note"):
            raise ValueError(f"no tool {tool!r}")
        return json.dumps(getattr(self, tool)(**arguments), ensure_ascii=False)
