import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import nearest, retrieval


def plain(rows, queries, k):
    """The k nearest by the definition: missing distances last, ties by key."""
    out = {}
    for q, v in queries:
        found = []
        for name, e in rows:
            d = None if e is None or len(e) != len(v) or None in e else math.sqrt(sum((a - b) * (a - b) for a, b in zip(e, v)))
            found.append(((2,) if d is None else (1,) if math.isnan(d) else (0, round(d, 9)), name))
        out[q] = [n for _, n in sorted(found)[:k]]
    return out


def test_dense_equals_plain_search_on_ties_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (300, 4)).astype(float).tolist()
    odd = [[math.nan, 0.0, 0.0, 0.0], None, [1.0], [None, 0.0, 0.0, 0.0], [1e300, 0.0, 0.0, 0.0]]
    rows = [(f"n{i:03}", v) for i, v in enumerate(vectors + odd)]
    queries = list(enumerate(rng.integers(-2, 3, (70, 4)).astype(float).tolist()))
    data = spark.createDataFrame([(n, 0, v) for n, v in rows], "note_path string, ordinal int, embedding array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    for most, k in ((128 << 20, 7), (128 << 20, 304), (10_000, 7)):  # in one round, and in three
        monkeypatch.setattr(retrieval, "QUERY_BYTES", most)
        got = {}
        for r in retrieval.dense(data, asked, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.note_path)
        assert got == plain(rows, queries, k)


def test_dense_compares_no_pairs_in_rows(spark):
    """All pairs of 400 queries and 20,000 vectors took minutes of a fold for each; the plan holds no join of the two now."""
    rows = spark.range(20_000).select(F.format_string("%05d", "id").alias("note_path"), F.lit(0).alias("ordinal"), F.array(*(F.sin(F.col("id") * (j + 1)).cast("float") for j in range(16))).alias("embedding"))
    asked = rows.where("note_path % 50 = 0").select(F.col("note_path").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieval.dense(rows, asked, 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("rank = 0 and query_id = note_path").count() == 400


def test_rounding_and_distances_are_those_of_sql(spark):
    d = np.array([0.1234567885, 2.5e-10, 1.0000000005, 1.4142135623730951, 1e5 + 5e-10, 3e7, 0.0])
    got = [r.x for r in spark.createDataFrame([(float(x),) for x in d], "x double").select(F.round("x", 9).alias("x")).collect()]
    assert nearest.rounded(d).tolist() == got
    state = nearest.Nearest(pa.array([[0.0, 0.0]]), 2)
    for part in ([[1.0, 0.0], [0.0, 1.0]], [[0.0, -1.0], [0.5, 0.0]]):
        state.add(pa.array(part))
        state.end(pa.record_batch({"note_path": ["a", "b"], "ordinal": [0, 0]}))
    assert state.row.tolist() == [[3, 0]] and state.d.tolist() == [[0.5, 1.0]]
