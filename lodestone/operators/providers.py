"""Extension points: embedding, contextualizing, reranking and chat providers, with built-in ones."""

from __future__ import annotations

import importlib
import json
import logging
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestone.functions.text import tokens
from lodestone.operators.scan import hashed

log = logging.getLogger("lodestone")


@runtime_checkable
class Embedder(Protocol):
    dimension: int
    fingerprint: str

    def column(self, text: Column) -> Column: ...


@runtime_checkable
class Contextualizer(Protocol):
    fingerprint: str

    def blurbs(self, notes: DataFrame) -> DataFrame | None: ...


@runtime_checkable
class Reranker(Protocol):
    def rerank(self, candidates: DataFrame, queries: DataFrame) -> DataFrame: ...


#: files(path, raw, mtime) -> notes as parse_notes gives them; notes and a chunk's most words -> chunks as chunk_notes gives them.
Parser = Callable[[DataFrame], DataFrame]
Chunker = Callable[[DataFrame, int], DataFrame]
#: Two ranked lists and how many rows of each query to keep -> one ranked list as fuse gives it.
Fuser = Callable[[DataFrame, DataFrame, int], DataFrame]


@runtime_checkable
class ChatProvider(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class ChatError(Exception):
    """A chat call failed, for whatever reason."""


@dataclass(frozen=True)
class HashEmbedder:
    """Feature hashing: each token adds 1 or -1 to a bucket that its md5 names; the vector is scaled to length 1."""

    dimension: int = 64

    @property
    def fingerprint(self) -> str:
        return f"hash:{self.dimension}"

    def column(self, text: Column) -> Column:
        dimension = self.dimension

        @F.arrow_udf("array<float>")
        def embed(lowered: pa.Array) -> pa.Array:
            return hashed(lowered, dimension)

        return embed(F.lower(text))


@dataclass(frozen=True)
class ModelEmbedder:
    """Any batch model: load() is called once in each Python worker and returns texts -> vectors."""

    load: Callable[[], Callable[[list[str]], list[list[float]]]]
    dimension: int
    fingerprint: str

    def column(self, text: Column) -> Column:
        load = self.load

        @pandas_udf("array<float>")
        def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for p in parts:
                yield pd.Series(list(model(p.fillna("").tolist())))

        return embed(text)


@dataclass(frozen=True)
class HttpEmbedder:
    """An embeddings endpoint in the common form, called in batches by the Python workers. post: as HttpChat's."""

    base_url: str
    model: str
    dimension: int
    api_key: str = ""
    timeout: float = 30.0
    batch: int = 64
    post: Callable[[str, dict, bytes, float], str] | None = None

    @property
    def fingerprint(self) -> str:
        return f"http:{self.model}:{self.dimension}"

    def vectors(self, texts: list[str]) -> list[list[float]]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            body = json.dumps({"model": self.model, "input": texts[i : i + self.batch]}).encode()
            data = json.loads((self.post or http_post)(f"{self.base_url.rstrip('/')}/embeddings", head, body, self.timeout))["data"]
            out += [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]
        if any(len(v) != self.dimension for v in out):
            raise ValueError(f"{self.model} gives vectors of another length than {self.dimension}")
        return out

    def column(self, text: Column) -> Column:
        return ModelEmbedder(lambda: self.vectors, self.dimension, self.fingerprint).column(text)


class PlainContext:
    """No context: blurbs stay null and chunks are embedded as they are."""

    fingerprint = "noop"

    def blurbs(self, notes: DataFrame) -> None:
        return None


@dataclass(frozen=True)
class ChatContext:
    """One chat call for each note, on its whole body; a failure or a blank answer leaves the note without a blurb."""

    chat: ChatProvider
    model: str
    system: str = "Write one short sentence that says what this note is about, naming its topic. Answer with the sentence alone."

    @property
    def fingerprint(self) -> str:
        return f"llm:{self.model}"

    def blurbs(self, notes: DataFrame) -> DataFrame:
        chat, system = self.chat, self.system

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                out = []
                for path, title, body in zip(p["path"], p["title"], p["body"], strict=True):
                    try:
                        got = chat.complete(system, f"{title}\n\n{body}").strip()
                    except Exception as error:  # noqa: BLE001 - a note without context is still worth indexing
                        log.warning("no context for %s: %s", path, error)
                        got = ""
                    out.append(got or None)
                yield pd.DataFrame({"note_path": p["path"], "context_blurb": pd.Series(out, dtype=object, index=p.index)})

        return notes.select("path", "title", "body").mapInPandas(run, "note_path string, context_blurb string")


@dataclass(frozen=True)
class HttpChat:
    """A chat endpoint in the common chat-completions form. post: (url, headers, body, timeout) -> response text."""

    base_url: str
    model: str
    api_key: str = ""
    timeout: float = 30.0
    max_tokens: int = 128
    post: Callable[[str, dict, bytes, float], str] | None = None

    def complete(self, system: str, user: str) -> str:
        body = {"model": self.model, "temperature": 0, "max_tokens": self.max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        try:
            url = f"{self.base_url.rstrip('/')}/chat/completions"
            text = (self.post or http_post)(url, head, json.dumps(body).encode(), self.timeout)
            return json.loads(text)["choices"][0]["message"]["content"].strip()
        except Exception as error:
            raise ChatError(str(error)) from error


def http_post(url: str, headers: dict, body: bytes, timeout: float) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:  # noqa: S310
        return r.read().decode("utf-8")


class PlainRerank:
    """Keeps the fused order and score."""

    def rerank(self, candidates: DataFrame, queries: DataFrame) -> DataFrame:
        return candidates


class OverlapRerank:
    """Scores a candidate by the share of the query's distinct tokens that its bare text holds."""

    def rerank(self, candidates: DataFrame, queries: DataFrame) -> DataFrame:
        asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("__asked"))
        both = F.size(F.array_intersect(F.col("__asked"), tokens(F.col("text"))))
        score = F.when(F.size("__asked") > 0, both / F.size("__asked")).otherwise(0.0)
        return candidates.join(asked, "query_id").withColumn("score", score).drop("__asked")


@dataclass(frozen=True)
class ModelRerank:
    """A cross-encoder: load() gives pairs -> scores, called once in each Python worker, on fused candidates only."""

    load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]

    def rerank(self, candidates: DataFrame, queries: DataFrame) -> DataFrame:
        load = self.load

        @pandas_udf("double")
        def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for q, t in parts:
                yield pd.Series(model(list(zip(q, t, strict=True))), dtype=float)

        asked = queries.select("query_id", F.col("text").alias("__asked"))
        return candidates.join(asked, "query_id").withColumn("score", score("__asked", "text")).drop("__asked")


def made(name: str, known: dict[str, Callable[..., object]], what: str, **options: object) -> object:
    """What a configured name stands for: a built-in factory, or one that it names as module:function."""
    if name in known:
        return known[name](**options)
    module, colon, function = name.partition(":")
    if not colon:
        raise ValueError(f"no {what} {name!r}; there are {', '.join(known)}, or module:function")
    return getattr(importlib.import_module(module), function)(**options)


def embedder_of(name: str, dimension: int, options: dict) -> Embedder:
    return made(name, {"hash": HashEmbedder, "http": HttpEmbedder}, "embedder", dimension=dimension, **options)


def reranker_of(name: str, options: dict) -> Reranker:
    return made(name, {"overlap": OverlapRerank, "none": PlainRerank}, "reranker", **options)


def or_plain(build: Callable[[], object] | None, plain: object, what: str) -> object:
    """build(), or the plain provider with a warning if it can't be built."""
    if build is None:
        return plain
    try:
        return build()
    except Exception as error:  # noqa: BLE001 - search works without it
        log.warning("%s isn't available, going on without it: %s", what, error)
        return plain
