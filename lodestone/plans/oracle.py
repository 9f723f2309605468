"""DuckDB equivalents of the registered queries."""

from __future__ import annotations

from lodestone.plans.registry import QUERIES

PATH = "lang || '/' || source || '/' || doc_id || '.md'"
TOKENS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
SQUEEZE = r"lower(trim(regexp_replace({0}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')))"

#: Notes as chunks: their one section in windows of 512 words.
CHUNKS = rf"""
n AS (SELECT {PATH} AS note_path, 'Note ' || doc_id AS title, trim(text, E' \n\t\r') AS body, string_split_regex(trim(text, E' \n\t\r'), '\s+') AS w FROM documents WHERE trim(text, E' \n\t\r') <> ''),
chunks AS (
  SELECT note_path, title, i AS ordinal, CASE WHEN len(w) <= 512 THEN body ELSE array_to_string(w[i * 512 + 1:(i + 1) * 512], ' ') END AS text, least(len(w) - i * 512, 512) AS token_count
  FROM (SELECT *, unnest(generate_series(0, (len(w) - 1) // 512)) AS i FROM n))"""

ASKED = "asked(query_id, qtext) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUERIES) + ")"

#: The phrases of a query as lists of index tokens.
PHRASES = rf"""
ph AS (
  SELECT query_id, phrase, list_transform(x, lambda y: y) AS x FROM (
    SELECT query_id, unnest(generate_series(1, len(p))) AS phrase, unnest(list_transform(p, lambda y: {TOKENS.format("y")})) AS x
    FROM (SELECT query_id, regexp_extract_all(qtext, '[\p{{L}}\p{{N}}_]+') AS p FROM asked)) WHERE len(x) > 0)"""


def bm25(indexed: str, x: str = "") -> str:
    """CTEs that end in sparse{{x}}: BM25 of the phrases over this expression of the chunks."""
    return rf"""
ct{x} AS (SELECT note_path, ordinal, {TOKENS.format(indexed)} AS t FROM chunks),
cs{x} AS (SELECT count(*) AS n_chunks, sum(len(t)) / count(*) AS avgdl FROM ct{x}),
ps{x} AS (SELECT note_path, ordinal, len(t) AS dl, unnest(t) AS term, unnest(generate_series(1, len(t))) AS pos FROM ct{x}),
hit{x} AS (
  SELECT query_id, phrase, note_path, ordinal, dl, count(*) AS f FROM (
    SELECT q.query_id, q.phrase, p.note_path, p.ordinal, p.dl, p.pos - q.at AS start
    FROM (SELECT query_id, phrase, len(x) AS m, unnest(x) AS term, unnest(generate_series(0, len(x) - 1)) AS at FROM ph) q JOIN ps{x} p ON p.term = q.term
    GROUP BY ALL HAVING count(DISTINCT q.at) = any_value(q.m)) GROUP BY ALL),
idf{x} AS (SELECT query_id, phrase, greatest(ln((n_chunks - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf, avgdl FROM hit{x}, cs{x} GROUP BY query_id, phrase, n_chunks, avgdl),
bm{x} AS (
  SELECT query_id, note_path, ordinal, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM hit{x} JOIN idf{x} USING (query_id, phrase) GROUP BY ALL),
sparse{x} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, note_path, ordinal) - 1 AS rank FROM bm{x})"""


BM25 = PHRASES + "," + bm25("text")
#: The same over chunks whose note's source and language go before the text.
BM25_ON = bm25("('From ' || string_split(note_path, '/')[2] || ' in ' || string_split(note_path, '/')[1] || chr(10) || chr(10) || text)", "_on")


def vector(tokens: str) -> str:
    part = lambda at: f"('0x' || substr(md5(t), {at}, 8))::BIGINT"
    raw = f"list_transform(generate_series(0, 63), lambda i: coalesce(list_sum(list_transform(list_filter({tokens}, lambda t: {part(1)} % 64 = i), lambda t: {part(9)} % 2 * 2 - 1)), 0))"
    return raw


HYBRID = rf"""
ctk AS MATERIALIZED (SELECT note_path, ordinal, title, text, {TOKENS.format("text")} AS tk FROM chunks),
qtk AS MATERIALIZED (SELECT query_id, {TOKENS.format("qtext")} AS tk FROM asked),
cv AS MATERIALIZED (SELECT note_path, ordinal, title, text, {vector("tk")} AS raw FROM ctk),
ce AS (SELECT *, list_transform(raw, lambda v: (CASE WHEN list_sum(list_transform(raw, lambda z: z * z)) > 0 THEN v / sqrt(list_sum(list_transform(raw, lambda z: z * z))) ELSE 0.0 END)::FLOAT::DOUBLE) AS v FROM cv),
qv AS MATERIALIZED (SELECT query_id, {vector("tk")} AS raw FROM qtk),
qe AS (SELECT query_id, list_transform(raw, lambda v: (CASE WHEN list_sum(list_transform(raw, lambda z: z * z)) > 0 THEN v / sqrt(list_sum(list_transform(raw, lambda z: z * z))) ELSE 0.0 END)::FLOAT::DOUBLE) AS q FROM qv),
dn AS (SELECT query_id, note_path, ordinal, list_distance(v, q) AS d FROM ce, qe),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), note_path, ordinal) - 1 AS rank FROM dn),
fz AS (
  SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.note_path, b.note_path) AS note_path, coalesce(a.ordinal, b.ordinal) AS ordinal, a.rank AS dense_rank, b.rank AS sparse_rank,
    coalesce(1 / (61 + a.rank), 0) + coalesce(1 / (61 + b.rank), 0) AS score
  FROM (SELECT * FROM dense WHERE rank < 50) a FULL JOIN (SELECT * FROM sparse WHERE rank < 50) b USING (query_id, note_path, ordinal)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, note_path, ordinal) - 1 AS rank FROM fz)"""

MD = rf"""
md AS (SELECT {PATH} AS path, doc_id, lang, source,
  '---' || chr(10) || 'lang: ' || lang || chr(10) || 'url: http://' || source || '/x' || chr(10) || 'lang: second' || chr(10) || 'no colon' || chr(10) || '---' || chr(10) AS front,
  CASE WHEN doc_id % 3 > 0 THEN '# Note  ' || doc_id || ' ' || chr(10) || chr(10) ELSE 'intro' || chr(10) END || text || chr(10) || chr(10) || '## Links' || chr(10) || chr(10) || 'See [[' || source || ']] and [[ ' || lang || '#x|y]] #' || lang ||
  ' #b/c-1 no#tag' || chr(10) || '#### Deep' || chr(10) || substr(text, 1, 50) || chr(10) || '### Mid' || chr(10) || '## Empty' || chr(10) || '# Last' || chr(10) || 'end' || chr(10) AS body FROM documents)"""

VECTORS = """
v AS (SELECT vec_id, vec_id::VARCHAR AS note_path, embedding::DOUBLE[] AS e, label FROM embeddings),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe, label AS wanted FROM embeddings WHERE vec_id % 20 = 0),
dn AS (SELECT query_id, wanted, note_path, vec_id, label, list_distance(e, qe) AS d FROM v, q),
kn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), note_path) - 1 AS rank FROM dn)"""

VERSIONS = f"""
o AS (SELECT {PATH} AS path, sha256(text) AS known FROM documents WHERE doc_id % 11 <> 0),
w AS (SELECT {PATH} AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0)"""

#: The benchmark's items as cases: the documents that hold them are expected.
CASES = rf"""
asked AS (SELECT item_id AS query_id, text AS qtext, {SQUEEZE.format("text")} AS span, 'set ' || item_id % 3 AS scenario, ['paraphrase', 'exact_term', 'buried', 'cross_lingual'][item_id % 4 + 1] AS type FROM benchmark),
gold AS MATERIALIZED (SELECT a.query_id, d.path, a.span FROM asked a JOIN (SELECT {PATH} AS path, {SQUEEZE.format("text")} AS t FROM documents) d ON contains(d.t, a.span))"""


def scored(ranked: str, name: str) -> str:
    """CTEs that end in NAME: the four span metrics and the two note metrics of each case from a ranked list of chunks."""
    return rf"""
{name}_r AS MATERIALIZED (SELECT query_id, note_path, ordinal, rank FROM {ranked} WHERE rank < 50),
{name}_s AS (SELECT r.query_id, min(r.rank) AS first FROM {name}_r r JOIN gold g ON g.query_id = r.query_id AND g.path = r.note_path JOIN chunks c ON c.note_path = r.note_path AND c.ordinal = r.ordinal
  WHERE contains({SQUEEZE.format("c.text")}, g.span) GROUP BY r.query_id),
{name}_d AS (SELECT query_id, note_path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) - 1 AS rank FROM {name}_r GROUP BY query_id, note_path),
{name}_n AS (SELECT d.query_id, min(d.rank) AS first FROM {name}_d d JOIN gold g ON g.query_id = d.query_id AND g.path = d.note_path GROUP BY d.query_id),
{name} AS (SELECT a.query_id, a.scenario, a.type, CASE WHEN s.first < 5 THEN 1.0::DOUBLE ELSE 0 END AS span_recall, coalesce(1.0::DOUBLE / (s.first + 1), 0) AS span_mrr,
  CASE WHEN n.first < 5 THEN 1.0::DOUBLE ELSE 0 END AS note_recall, coalesce(1.0::DOUBLE / (n.first + 1), 0) AS note_mrr
  FROM asked a LEFT JOIN {name}_s s USING (query_id) LEFT JOIN {name}_n n USING (query_id))"""


SPAN = ("span_recall", "span_mrr", "note_recall", "note_mrr")

SQL = {
    "scan_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "token_count": rf"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n_words, len({TOKENS.format('text')}) AS n_tokens FROM documents",
    "doc_freq": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM documents) GROUP BY term",
    "term_freq_top": f"SELECT term, count(*) AS tf FROM (SELECT unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY term ORDER BY tf DESC, term LIMIT 50",
    "normalize_ws": f"SELECT doc_id, md5({SQUEEZE.format('text')}) AS h FROM documents",
    "accent_fold": "SELECT doc_id, md5(strip_accents(lower(text))) AS h FROM documents",
    "snippets": "SELECT doc_id, substr(text, 1, 160) AS snippet FROM documents",
    "slugify": "SELECT doc_id, CASE WHEN lang = 'en' OR s = '' THEN s ELSE s || '-' || lang END AS slug FROM (SELECT doc_id, lang, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents)",
    "parsed_notes": rf"""WITH {MD} SELECT path, CASE WHEN doc_id % 3 > 0 THEN 'Note  ' || doc_id ELSE 'Last' END AS title0,
      array_to_string(list_sort(list_distinct(regexp_extract_all(body, '(?:^|\s)#([A-Za-z0-9_\-/]+)', 1))), ',') AS tags,
      array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(body, '\[\[([^\]|#]+)', 1), lambda x: trim(x)))), ',') AS wikilinks,
      'second' AS lang, 'http://' || source || '/x' AS url, 2 AS n_front, sha256(front || body) AS content_hash FROM md""",
    "sections_heading_path": rf"""WITH {MD},
      li AS (SELECT path, unnest(string_split(body, chr(10))) AS line, unnest(generate_series(1, len(string_split(body, chr(10))))) AS i FROM md),
      hd AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 1)) AS lev, trim(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2)) AS t FROM li),
      se AS (SELECT *, sum((lev > 0)::INT) OVER (PARTITION BY path ORDER BY i) AS sec FROM hd),
      st AS (SELECT path, sec, max(lev) AS lev, max(t) FILTER (WHERE lev > 0) AS t, trim(string_agg(line, chr(10) ORDER BY i), E' \n\t\r') AS body FROM se GROUP BY ALL),
      hp AS (SELECT *, {", ".join(f"last_value(CASE WHEN lev BETWEEN 1 AND {k} THEN lev END IGNORE NULLS) OVER w AS l{k}, last_value(CASE WHEN lev BETWEEN 1 AND {k} THEN t END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 7))}
        FROM st WINDOW w AS (PARTITION BY path ORDER BY sec))
      SELECT path, row_number() OVER (PARTITION BY path ORDER BY sec) - 1 AS no,
        array_to_string(list_filter([{", ".join(f"CASE WHEN l{k} = {k} THEN t{k} END" for k in range(1, 7))}], lambda x: x IS NOT NULL AND x <> ''), '/') AS heading_path, md5(body) AS h FROM hp WHERE body <> ''""",
    "chunk_windows": f"WITH {CHUNKS} SELECT note_path, ordinal, token_count, md5(text) AS h FROM chunks",
    "read_note": f"WITH {CHUNKS} SELECT note_path, any_value(title) AS title, md5(string_agg(text, chr(10) || chr(10) ORDER BY ordinal)) AS h FROM chunks GROUP BY note_path",
    "note_titles": f"SELECT path, title FROM (SELECT {PATH} AS path, 'Note ' || doc_id AS title FROM documents) WHERE path IN ('en/src1/1.md', 'en/src2/2.md', 'none.md')",
    "turns_by_conversation": "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn, role, text)) AS h, count(*) AS n FROM conversations GROUP BY conv_id",
    "uncontextualized_notes": f"SELECT {PATH} AS note_path FROM documents WHERE doc_id % 10 IN (0, 1)",
    "index_diff_upsert": f"WITH {VERSIONS} SELECT w.path, CASE WHEN known IS NULL THEN 'new' ELSE 'changed' END AS kind FROM w LEFT JOIN o USING (path) WHERE h IS DISTINCT FROM known",
    "index_deletes": f"WITH {VERSIONS} SELECT path FROM o WHERE path NOT IN (SELECT path FROM w)",
    "index_stats": f"WITH {CHUNKS} SELECT (SELECT count(*) FROM documents) AS notes, count(*) AS chunks, sum(token_count)::BIGINT AS words FROM chunks",
    "bm25_topk": f"WITH {CHUNKS}, {ASKED}, {BM25} SELECT query_id, rank, note_path, ordinal, round(score, 6) AS score FROM sparse WHERE query_id = 0 AND rank < 10",
    "bm25_multi_query": f"WITH {CHUNKS}, {ASKED}, {BM25} SELECT query_id, rank, note_path, ordinal, round(score, 6) AS score FROM sparse WHERE rank < 50",
    "knn_topk": f"WITH {VECTORS} SELECT query_id, rank, note_path, round(1 / (1 + d), 6) AS score FROM kn WHERE rank < 50",
    "knn_multi_query": f"WITH {VECTORS} SELECT query_id, rank, note_path, round(1 / (1 + d), 6) AS score FROM kn WHERE rank < 10",
    "knn_report": f"""WITH {VECTORS},
      g AS (SELECT query_id, wanted, CASE WHEN label = wanted THEN rank END AS hit FROM kn WHERE rank < 11 AND vec_id <> query_id),
      s AS (SELECT query_id, wanted::VARCHAR AS scenario, coalesce(max(CASE WHEN hit < 3 THEN 1.0 ELSE 0.0 END), 0.0) AS recall, coalesce(1.0 / (min(hit) + 1), 0.0) AS mrr FROM g GROUP BY ALL)
      SELECT coalesce(scenario, 'overall') AS scenario, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM s GROUP BY GROUPING SETS ((scenario), ())""",
    "rrf_fuse": f"""WITH {VECTORS},
      a AS (SELECT query_id, note_path, rank FROM kn WHERE rank < 20),
      sg AS (SELECT query_id, note_path, list_distance(list_transform(e, lambda x: sign(x)::DOUBLE), list_transform(qe, lambda x: sign(x)::DOUBLE)) AS d FROM v, q),
      b AS (SELECT * FROM (SELECT query_id, note_path, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), note_path) - 1 AS rank FROM sg) WHERE rank < 20),
      f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.note_path, b.note_path) AS note_path, a.rank AS dense_rank, b.rank AS sparse_rank,
        coalesce(1 / (61 + a.rank), 0) + coalesce(1 / (61 + b.rank), 0) AS score FROM a FULL JOIN b USING (query_id, note_path)),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, note_path) - 1 AS rank FROM f)
      SELECT query_id, rank, note_path, round(score, 6) AS score, dense_rank, sparse_rank FROM r WHERE rank < 30""",
    "hybrid_search": f"WITH {CHUNKS}, {ASKED}, {BM25}, {HYBRID} SELECT query_id, rank, note_path, ordinal, round(score, 6) AS score, dense_rank, sparse_rank FROM fused WHERE rank < 10",
    "search_sources": f"""WITH {CHUNKS}, {ASKED}, {BM25}, {HYBRID},
      s AS (SELECT f.query_id, f.note_path, any_value(c.title) AS title, count(*) AS hit_count, max(score) AS best_score, min(rank) AS first, array_to_string(list(substr(c.text, 1, 160) ORDER BY rank)[1:3], '|') AS snippets
        FROM fused f JOIN chunks c USING (note_path, ordinal) WHERE rank < 50 GROUP BY ALL)
      SELECT * EXCLUDE (first, best_score), round(best_score, 6) AS best_score FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY best_score DESC, first) - 1 AS rank, * EXCLUDE (query_id) FROM s) WHERE rank < 10""",
    "span_recall": f"WITH {CHUNKS}, {CASES}, {BM25}, {scored('sparse', 'sc')} SELECT query_id, {', '.join(f'round({m}, 6) AS {m}' for m in SPAN)} FROM sc",
    "eval_report": f"WITH {CHUNKS}, {CASES}, {BM25}, {HYBRID}, {scored('dense', 'd1')}, {scored('sparse', 's1')}, {scored('fused', 'h1')} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS channel, coalesce(scenario, 'overall') AS scenario, count(*) AS n, round(avg(note_recall), 6) AS recall, round(avg(note_mrr), 6) AS mrr FROM {t} GROUP BY GROUPING SETS ((scenario), ())"
        for c, t in (("dense", "d1"), ("sparse", "s1"), ("hybrid", "h1"))
    ),
    "eval_delta": f"WITH {CHUNKS}, {CASES}, {BM25}, {BM25_ON}, {scored('sparse', 'x')}, {scored('sparse_on', 'y')} SELECT coalesce(x.type, 'overall') AS type, count(*) AS n, "
    + ", ".join(f"round(avg(x.{m}), 6) AS {m}_off, round(avg(y.{m}), 6) AS {m}_on, round(avg(y.{m}) - avg(x.{m}), 6) AS {m}_delta" for m in SPAN)
    + " FROM x JOIN y USING (query_id) GROUP BY GROUPING SETS ((x.type), ())",
    "strip_html_tags": "SELECT page_id, md5(regexp_replace(html, '</?[a-zA-Z][a-zA-Z0-9]*[^>\\n]*>', '', 'g')) AS h FROM pages",
    "strip_comments": "SELECT page_id, md5(regexp_replace(html || '<!-- a' || chr(10) || '--> b <!-- c', '(?s)<!--.*?-->', '', 'g')) AS h FROM pages",
    "wikitext_rows": """SELECT doc_id, '# Note ' || doc_id || E'\\n\\n**' || lang || '** in *' || source || '* weighs ' || doc_id || ' to ' || doc_id || ' kg and 2 ' || (doc_id % 7 + 1) || '/8 [[' || source || '-x|parts]] of ' || lang || ', ' || lang ||
      ' link ' || doc_id || E'\\n\\n### ' || source || E'\\n- a\\n  - ' || doc_id || E'\\n1. b\\nc\\n## Last\\nNo. ' || doc_id || E' end\\n' AS markdown, 1 AS efn FROM documents""",
    "gold_validation_errors": f"""WITH n AS (SELECT {PATH} AS path, {SQUEEZE.format("text")} AS t FROM documents),
      e(case_no, check_no, item_no, path, span, error) AS (VALUES (0, 3, 0, 'en/src1/1.md', NULL, 'expected note not in corpus: '), (1, 3, 0, 'nowhere.md', NULL, 'expected note not in corpus: '),
        (0, 4, 0, 'en/src1/1.md', 'is and retitioning', 'span note not in corpus: '), (1, 4, 0, 'en/src1/1.md', 'not in it', 'span note not in corpus: '), (1, 4, 1, 'gone.md', 'x', 'span note not in corpus: '))
      SELECT case_no, check_no, item_no, 'case ' || case_no || ': ' || error || path AS error FROM e WHERE path NOT IN (SELECT path FROM n)
      UNION ALL SELECT case_no, 5, item_no, 'case ' || case_no || ': span not found in ' || path FROM e JOIN n USING (path) WHERE span IS NOT NULL AND NOT contains(t, span)
      UNION ALL VALUES (1, 1, -1, 'case 1: unknown type guess'), (2, 0, -1, 'case 2: no expected notes'), (2, 2, -1, 'case 2: no answer spans'), (1, 6, 0, 'case 1: span note not expected: en/src1/1.md'), (1, 6, 1, 'case 1: span note not expected: gone.md')""",
    "manifest_errors": r"""WITH m AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'a/b' ELSE 'music' END AS cluster, CASE WHEN doc_id % 60 = 0 THEN '??' ELSE text END AS title, CASE WHEN doc_id % 70 = 0 THEN 'EN' ELSE lang END AS lang, doc_id % 80 AS revid FROM documents)
      SELECT cluster, title, 'bad cluster name' AS error FROM m WHERE cluster = 'a/b' UNION ALL SELECT cluster, title, 'bad language' FROM m WHERE lang = 'EN'
      UNION ALL SELECT cluster, title, 'empty slug' FROM m WHERE trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '-', 'g'), '-') = '' UNION ALL SELECT cluster, title, 'bad revision' FROM m WHERE revid < 1""",
    "slug_collisions": r"""SELECT path, count(*) AS n FROM (SELECT lower(source || '/' || CASE WHEN lang = 'en' OR s = '' THEN s ELSE s || '-' || lang END || '.md') AS path
      FROM (SELECT source, lang, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents)) GROUP BY path HAVING count(*) > 1""",
    "watch_events": "SELECT date_trunc('hour', ts) AS batch, count(DISTINCT user_id) AS n_changed, count(*) AS n_events FROM events GROUP BY 1",
}
SQL["parsed_notes"] = SQL["parsed_notes"].replace("title0", "title")
