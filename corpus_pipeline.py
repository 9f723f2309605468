"""A corpus pipeline: each stage works on all that the one before it kept.

Language ID drops texts without a recognised language; line dedup cuts passages that occurred earlier in the corpus; the
n-gram join keeps one document of each group of near copies; decontamination drops documents that hold a benchmark item;
packing lays the rest out in training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, langid, line_dedup, ngram_join, packing
from lodestone.llm.common import checkpoint, table
from lodestone.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with a recognised language. Null texts and texts without a letter go; rows with null or repeated ids are judged by their text, each
    for itself; an empty table stays empty; all columns are kept as they are."""
    return langid.keep_identified(docs, langid.fit(docs, ~langid.held_out()))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occurred before from text, and n_chars after it. Of equal rows one stays, whatever their ids; documents of which a fifth or less is
    left go; null, empty and short texts stay as they are; an empty table stays empty; other columns are kept."""
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near copies. Rows with a null id and texts without a word stay; rows that repeat one id and text
    stay or go together; of ids with several texts each row is judged by its own; an empty table stays empty; all columns are kept."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that hold a benchmark item, rows with null or repeated ids too. Null and empty texts stay; without documents or items nothing goes; all
    columns are kept."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence. A null or empty text is its end id alone; null ids stay null; rows that repeat are packed as often
    as they occur; an empty table gives no rows; other columns are left out."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages learn a model, compare sets and tokenize: SQL can't express them; tests/llm compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
