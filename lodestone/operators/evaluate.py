"""Offline retrieval evaluation: recall and reciprocal ranks of notes and answer spans, by group and overall, and their deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_ws
from lodestone.operators.retrieval import Channel, distinct_notes
from lodestone.sources.shared import checkpoint

TYPES = ("paraphrase", "exact_term", "buried", "cross_lingual")
METRICS = ("recall", "mrr")
SPAN_METRICS = ("span_recall", "span_mrr", "note_recall", "note_mrr")


def recall(rank: Column, k: int) -> Column:
    """1 if any relevant row ranks under k (from 0), else 0; rank is null where a row isn't relevant."""
    return F.coalesce(F.max(F.when(rank < k, 1.0).otherwise(0.0)), F.lit(0.0))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1.0 / (F.min(rank) + 1), F.lit(0.0))


def case_scores(cases: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """query_id, recall and mrr of each case(query_id, expected array) from ranked notes (query_id, note_path, rank)."""
    wanted = cases.select("query_id", F.explode("expected").alias("note_path")).distinct()
    hits = wanted.join(ranked.select("query_id", "note_path", "rank"), ["query_id", "note_path"])
    best = hits.groupBy("query_id").agg(recall(F.col("rank"), k).alias("recall"), reciprocal(F.col("rank")).alias("mrr"))
    return cases.join(best, "query_id", "left").fillna(0.0, list(METRICS))


def span_case_scores(cases: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Scores of each case(query_id, expected_notes, answer_spans) from ranked chunks (query_id, note_path, rank, text).

    A span counts in a chunk of its own note that holds its text, white space and case aside. Recall looks at k chunks and k
    distinct notes; reciprocal ranks look at the whole pool."""
    spans = cases.select("query_id", F.explode("answer_spans").alias("s")).select("query_id", F.col("s.note").alias("note_path"), normalize_ws(F.col("s.text")).alias("span"))
    chunks = ranked.select("query_id", "note_path", "rank", normalize_ws(F.col("text")).alias("body"))
    hits = chunks.join(spans, ["query_id", "note_path"]).where(F.contains("body", "span"))
    by_span = hits.groupBy("query_id").agg(recall(F.col("rank"), k).alias("span_recall"), reciprocal(F.col("rank")).alias("span_mrr"))
    notes = case_scores(cases.select("query_id", F.col("expected_notes").alias("expected")), distinct_notes(ranked), k)
    notes = notes.select("query_id", F.col("recall").alias("note_recall"), F.col("mrr").alias("note_mrr"))
    return cases.join(by_span, "query_id", "left").join(notes, "query_id", "left").fillna(0.0, list(SPAN_METRICS))


def asked(cases: DataFrame) -> DataFrame:
    return cases.select("query_id", F.col("query").alias("text"))


def evaluate(search: Channel, cases: DataFrame, k: int = 5, pool: int = 50) -> DataFrame:
    """Recall at k and reciprocal rank within the pool, by scenario and overall, of a search by note on cases(query_id, query, expected, scenario)."""
    return report(case_scores(cases, search(asked(cases), max(k, pool)), k), "scenario")


def evaluate_spans(search: Channel, cases: DataFrame, k: int = 5, pool: int = 50) -> DataFrame:
    """The four span metrics by type and overall of a search by chunk on cases(query_id, query, type, expected_notes, answer_spans)."""
    return report(span_case_scores(cases, checkpoint(search(asked(cases), max(k, pool))), k), "type", SPAN_METRICS)


def run_eval(channels: dict[tuple[str, str], Channel], cases: DataFrame, k: int = 5, pool: int = 50) -> DataFrame:
    """evaluate of the dense, sparse and hybrid channels by note, with the column `channel`."""
    parts = [evaluate(channels[kind, "note"], cases, k, pool).withColumn("channel", F.lit(kind)) for kind in ("dense", "sparse", "hybrid")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def run_contextual_eval(off: Channel, on: Channel, chunks_on: DataFrame, cases: DataFrame, k: int = 5, pool: int = 50) -> DataFrame:
    """The delta of the span metrics from an index without context to one with it. Notes of the latter that lack a blurb raise, since they would blur the comparison."""
    bare = [r.note_path for r in uncontextualized(chunks_on).limit(6).collect()]
    if bare:
        raise ValueError(f"notes without context: {', '.join(bare[:5])}{' ...' if len(bare) > 5 else ''}")
    return delta(evaluate_spans(off, cases, k, pool), evaluate_spans(on, cases, k, pool), "type", SPAN_METRICS)


def report(scored: DataFrame, group: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means by group and over all cases (group 'overall'; a row of zeros if there are none)."""
    means = [F.count("*").alias("n"), *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics)]
    overall = scored.agg(*means).select(F.lit("overall").alias(group), "n", *metrics)
    return scored.groupBy(group).agg(*means).unionByName(overall)


def delta(off: DataFrame, on: DataFrame, group: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Two reports side by side, with the signed change of each metric."""
    a = off.select(group, "n", *(F.col(m).alias(f"{m}_off") for m in metrics))
    rows = a.join(on.select(group, *(F.col(m).alias(f"{m}_on") for m in metrics)), group)
    return rows.select("*", *((F.col(f"{m}_on") - F.col(f"{m}_off")).alias(f"{m}_delta") for m in metrics))


def format_report(rows: DataFrame, group: str, metrics: tuple[str, ...] = METRICS, k: int = 5) -> str:
    got = sorted(rows.collect(), key=lambda r: (r[group] == "overall", r[group]))
    head = f"{group:<14}{'n':>5}" + "".join(f"{m + ('@' + str(k) if 'recall' in m else ''):>15}" for m in metrics)
    return "\n".join([head, *(f"{r[group]:<14}{r['n']:>5}" + "".join(f"{r[m]:>15.3f}" for m in metrics) for r in got)])


def format_delta(rows: DataFrame, group: str, metrics: tuple[str, ...] = METRICS) -> str:
    got = sorted(rows.collect(), key=lambda r: (r[group] == "overall", r[group]))
    part = lambda r, m: f"{m} {r[m + '_off']:.3f} → {r[m + '_on']:.3f} ({r[m + '_delta']:+.3f})"
    return "\n".join(f"{r[group]:<14} n={r['n']:<4} " + "  ".join(part(r, m) for m in metrics) for r in got)


def ndcg(rank: Column, k: int) -> Column:
    """1 / log2(rank + 2) of the first relevant row under k, else 0."""
    first = F.min(F.when(rank < k, rank))
    return F.coalesce(1.0 / F.log2(first + 2.0), F.lit(0.0))


def uncontextualized(chunks: DataFrame) -> DataFrame:
    """note_path of notes with a chunk whose blurb is null or empty, in order."""
    return chunks.where(F.coalesce("context_blurb", F.lit("")) == "").select("note_path").distinct().orderBy("note_path")


def gold_errors(cases: DataFrame, notes: DataFrame) -> DataFrame:
    """case_no, check_no, item_no and error for span-level gold cases(case_no, query, type, expected_notes, answer_spans) against notes(path, text).

    All checks go on after an error, so that one span may give two."""
    of = lambda c: F.concat(F.lit("case "), F.col("case_no").cast("string"), F.lit(": "), c)
    none = F.lit(-1)
    wrong_type = cases.where(~F.col("type").isin(*TYPES)).select("case_no", F.lit(1).alias("check_no"), none.alias("item_no"), of(F.concat(F.lit("unknown type "), F.col("type"))).alias("error"))
    no_notes = cases.where(F.size("expected_notes") == 0).select("case_no", F.lit(0).alias("check_no"), none.alias("item_no"), of(F.lit("no expected notes")).alias("error"))
    no_spans = cases.where(F.size("answer_spans") == 0).select("case_no", F.lit(2).alias("check_no"), none.alias("item_no"), of(F.lit("no answer spans")).alias("error"))
    wanted = cases.select("case_no", F.posexplode("expected_notes").alias("item_no", "path"))
    lost = wanted.join(notes.select("path"), "path", "left_anti").select("case_no", F.lit(3).alias("check_no"), "item_no", of(F.concat(F.lit("expected note not in corpus: "), F.col("path"))).alias("error"))
    spans = cases.select("case_no", "expected_notes", F.posexplode("answer_spans").alias("item_no", "s"))
    spans = spans.select("case_no", "expected_notes", "item_no", F.col("s.note").alias("path"), F.col("s.text").alias("span"))
    both = spans.join(notes.select("path", F.col("text").alias("body")), "path", "left")
    missing = both.where("body is null").select("case_no", F.lit(4).alias("check_no"), "item_no", of(F.concat(F.lit("span note not in corpus: "), F.col("path"))).alias("error"))
    absent = both.where(F.col("body").isNotNull() & ~F.contains(normalize_ws(F.col("body")), normalize_ws(F.col("span"))))
    absent = absent.select("case_no", F.lit(5).alias("check_no"), "item_no", of(F.concat(F.lit("span not found in "), F.col("path"))).alias("error"))
    stray = spans.where(~F.array_contains("expected_notes", F.col("path"))).select("case_no", F.lit(6).alias("check_no"), "item_no", of(F.concat(F.lit("span note not expected: "), F.col("path"))).alias("error"))
    out = wrong_type
    for x in (no_notes, no_spans, lost, missing, absent, stray):
        out = out.unionByName(x)
    return out
