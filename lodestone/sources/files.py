"""Gold sets, configuration and small text files."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "query string, query_lang string, expected array<string>, scenario string"
SPAN_GOLD = "query string, query_lang string, type string, scenario string, expected_notes array<string>, answer_spans array<struct<note:string,text:string>>"


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """query_id (place in the file), query, query_lang, expected and scenario of a JSON list of cases."""
    return _numbered(spark, path, GOLD)


def load_span_gold(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark, path, SPAN_GOLD)


def _numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>>", {"mode": "FAILFAST"}).alias("cases"))
    return whole.select(F.posexplode("cases").alias("query_id", "c")).select("query_id", "c.*")


@dataclass(frozen=True)
class Config:
    """Settings; only the vault's path has no default."""

    vault_path: str
    ignore: tuple[str, ...] = (".obsidian/",)
    index_path: str = ".lodestone"
    dimension: int = 64
    embedder: str = "hash"
    embedder_options: dict = field(default_factory=dict)
    max_tokens: int = 512
    k_dense: int = 50
    k_sparse: int = 50
    pool: int = 100
    rerank: bool = True
    reranker: str = "overlap"
    reranker_options: dict = field(default_factory=dict)
    contextualize: bool = False
    chat: dict = field(default_factory=dict)


def load_config(path: str) -> Config:
    """A TOML file with tables vault, index, embedding, chunk, search, rerank, context, chat.

    embedding.provider and rerank.provider name a built-in provider (hash, http; overlap, none) or a factory as module:function, which
    gets the table's other keys; paths and dimensions are as in Config."""
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    get = lambda t, k, d: data.get(t, {}).get(k, d)
    if not get("vault", "path", None):
        raise ValueError(f"{path}: vault.path is missing")
    base = Config("")
    rest = lambda t, *known: {k: v for k, v in data.get(t, {}).items() if k not in known}
    return Config(
        data["vault"]["path"], tuple(get("vault", "ignore", base.ignore)), get("index", "path", base.index_path), get("embedding", "dimension", base.dimension),
        get("embedding", "provider", base.embedder), rest("embedding", "provider", "dimension"), get("chunk", "max_tokens", base.max_tokens), get("search", "k_dense", base.k_dense),
        get("search", "k_sparse", base.k_sparse), get("search", "pool", base.pool), get("rerank", "enabled", base.rerank), get("rerank", "provider", base.reranker),
        rest("rerank", "provider", "enabled"), get("context", "enabled", base.contextualize), dict(data.get("chat", {})),
    )
