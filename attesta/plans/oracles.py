"""SQL for DuckDB that must give what the queries give."""

from __future__ import annotations

from ..vocabulary import FIELDS, REFUSAL_TEXT, STATES, STOPWORDS

_W = r"[\p{L}\p{N}_]+"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_NL = "chr(10)"

DOCS = rf"""
docs AS (
  SELECT printf('DOC-%06d', doc_id) AS doc_id, 'Title ' || lang || ' ' || doc_id AS doc_title,
    CASE doc_id % 4 WHEN 0 THEN 'SOP' WHEN 1 THEN 'Policy' WHEN 2 THEN 'Specification' ELSE 'TechnicalNote' END AS doc_type,
    '1.' || (doc_id % 3) AS version,
    CASE WHEN doc_id % 10 = 0 THEN 'Draft' WHEN doc_id % 10 = 1 THEN 'Obsolete' WHEN doc_id % 10 = 2 THEN 'Superseded'
         WHEN doc_id % 10 <= 5 THEN 'Effective' ELSE 'Approved' END AS status,
    source AS department, 'documents/' || doc_id || '.md' AS source_file_path,
    '# Section ' || lang || {_NL} || {_NL} || replace(coalesce(text, ''), {_NL}, {_NL} || {_NL}) AS raw_text,
    doc_id AS doc_number, printf('FAM-%03d', doc_id % 97) AS family,
    printf('2024-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1) AS effective_date,
    CASE WHEN doc_id % 7 = 0 THEN printf('20%02d-01-15', 23 + doc_id % 4) END AS review_due_date
  FROM documents
)"""

_SPLIT = r"'[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"

LINES = rf"""
split AS (SELECT doc_id, doc_title, string_split_regex(raw_text, {_SPLIT}) AS ls FROM docs),
line AS (SELECT doc_id, doc_title, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_number FROM split),
lines AS (
  SELECT doc_id, doc_title, line, line_number,
    coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start,
    length(line) AS n_chars, regexp_matches(line, '^#{{1,6}}\s+\S') AS is_heading, regexp_full_match(line, '\s*') AS is_blank
  FROM line
)"""

CHUNKS = rf"""
marked AS (
  SELECT *, NOT is_heading AND NOT is_blank AS body,
    sum(CASE WHEN is_heading OR is_blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_number) AS grp,
    last_value(CASE WHEN is_heading THEN regexp_extract(line, '^#{{1,6}}\s+(.*\S)\s*$', 1) END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading
  FROM lines
),
paras AS (
  SELECT doc_id, grp, min(line_number) AS first, max(line_number) AS last, min(char_start) AS char_start,
    max(char_start + n_chars) AS char_end, coalesce(any_value(heading), any_value(doc_title)) AS section_heading
  FROM marked WHERE body GROUP BY doc_id, grp
),
every AS (
  SELECT d.*, p.section_heading, p.first, p.last, CAST(p.char_start AS INTEGER) AS char_start, CAST(p.char_end AS INTEGER) AS char_end,
    CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY p.first) AS INTEGER) AS chunk_index
  FROM paras p JOIN docs d ON d.doc_id = p.doc_id
),
blind AS (
  SELECT printf('%s_v%s_chunk_%03d', doc_id, trim(regexp_replace(version, '[^A-Za-z0-9]+', '_', 'g'), '_'), chunk_index) AS chunk_id,
    doc_id, doc_title, doc_type, version, status, department, section_heading, source_file_path,
    'sha256:' || sha256(raw_text) AS source_hash, chunk_index, printf('lines %d-%d', first, last) AS line_or_page_span,
    char_start, char_end, substring(raw_text, char_start + 1, char_end - char_start) AS text
  FROM every
),
gated AS (SELECT * FROM blind WHERE status IN ('Approved', 'Effective'))"""


def _index(chunks: str) -> str:
    return rf"""
tok AS (
  SELECT *, regexp_extract_all(lower(section_heading || {_NL} || text), '{_W}') AS tokens FROM {chunks}
),
ctok AS (SELECT *, len(tokens) AS n_tokens FROM tok),
stats AS (SELECT count(*) AS n_chunks, sum(n_tokens) / count(*) AS avg_tokens FROM ctok),
occ AS (SELECT doc_id, chunk_index, chunk_id, n_tokens, unnest(tokens) AS token FROM ctok),
tf AS (SELECT doc_id, chunk_index, chunk_id, n_tokens, token, count(*) AS tf FROM occ GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
raw AS (SELECT token, df, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS raw_idf FROM df, stats),
idf AS (
  SELECT token, df, raw_idf, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf FROM raw
)"""


ASKED = "asked AS (SELECT printf('Q-%05d', item_id) AS query_id, text AS question, item_id FROM benchmark)"
TURNS = (
    "turns AS (SELECT printf('C-%05d-%03d', conv_id, turn) AS query_id, text AS question "
    "FROM conversations WHERE role = 'user')"
)


def _score(asked: str = "asked") -> str:
    return rf"""
qt AS (SELECT query_id, regexp_extract_all(lower(question), '{_W}') AS ts FROM {asked}),
word AS (SELECT query_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS place FROM qt),
weight AS (
  SELECT t.doc_id, t.chunk_index, t.chunk_id, t.token,
    i.idf * (t.tf * 2.5 / (t.tf + 1.5 * (1 - 0.75 + 0.75 * (t.n_tokens / s.avg_tokens)))) AS weight
  FROM tf t JOIN idf i ON i.token = t.token, stats s
),
scores AS (
  SELECT query_id, doc_id, chunk_index, chunk_id, list_sum(list(CAST(weight AS DOUBLE) ORDER BY place)) AS score
  FROM word JOIN weight ON word.token = weight.token GROUP BY ALL
),
ranks AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index, chunk_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0
)"""


def _cover(asked: str = "asked") -> str:
    return rf"""
terms AS (
  SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(question), '{_W}'),
    lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))) AS terms FROM {asked}
),
covered AS (
  SELECT r.*, CASE WHEN len(t.terms) > 0 THEN len(list_intersect(t.terms, c.tokens)) / CAST(len(t.terms) AS DOUBLE) ELSE 0.0 END AS coverage
  FROM ranks r JOIN terms t ON t.query_id = r.query_id JOIN ctok c ON c.chunk_id = r.chunk_id
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_GATED = _with(DOCS, LINES, CHUNKS, _index("gated"))
_BLIND = _with(DOCS, LINES, CHUNKS, _index("blind"))
_HITS = ",".join((
    _GATED, ASKED, _score(), _cover(),
    """hits AS (
  SELECT v.*, c.status, c.version, c.section_heading, c.line_or_page_span, c.text FROM covered v JOIN ctok c ON c.chunk_id = v.chunk_id
  WHERE v.rank <= 5 AND v.query_id IN (SELECT query_id FROM covered WHERE rank = 1 AND coverage >= 0.4)
)""",
))
_ANSWERS = _HITS + rf""",
answers AS (
  SELECT a.query_id, CASE WHEN count(h.rank) > 0 THEN 'answer' ELSE 'refusal' END AS outcome,
    coalesce(string_agg(printf('[source: %d] %s v%s, %s, %s', h.rank, h.doc_id, h.version, h.section_heading, h.line_or_page_span)
      || {_NL} || h.text, {_NL} || {_NL} ORDER BY h.rank), '{REFUSAL_TEXT}') AS answer_text,
    coalesce(string_agg(h.rank || '=' || h.chunk_id, ';' ORDER BY h.rank), '') AS citations,
    max(CASE WHEN h.rank = 1 THEN h.score END) AS top_score
  FROM asked a LEFT JOIN hits h ON h.query_id = a.query_id GROUP BY a.query_id
)"""
_HELD = ",".join((_BLIND, ASKED, _score()))

_CASES = _GATED + "," + ",".join((
    ASKED, _score(), _cover(),
    """cases AS (
  SELECT query_id AS case_id, question, CASE WHEN item_id % 3 <> 2 THEN 'answer' ELSE 'refusal' END AS expected_outcome,
    item_id % 3 + 1 AS top_k, printf('DOC-%06d', item_id) AS doc, item_id AS n FROM asked
),
hits AS (
  SELECT v.* FROM covered v JOIN cases c ON c.case_id = v.query_id
  WHERE v.rank <= c.top_k AND v.query_id IN (SELECT query_id FROM covered WHERE rank = 1 AND coverage >= 0.4)
),
seen AS (
  SELECT c.*, coalesce(list(h.chunk_id ORDER BY h.rank) FILTER (h.rank IS NOT NULL), []) AS chunks,
    coalesce(list(h.doc_id ORDER BY h.rank) FILTER (h.rank IS NOT NULL), []) AS dlist
  FROM cases c LEFT JOIN hits h ON h.query_id = c.case_id GROUP BY ALL
),
flags AS (
  SELECT *, len(chunks) = 0 AS nothing, expected_outcome = 'answer' AS wants,
    n % 5 = 0 AND NOT list_contains(dlist, doc) AS missing, n % 6 = 1 AND list_contains(dlist, doc) AS forbidden,
    n % 4 = 0 AS fixture, CASE WHEN len(chunks) = 0 THEN 'refusal' ELSE 'answer' END AS told
  FROM seen
),
results AS (
  SELECT case_id, expected_outcome, array_to_string(chunks, ',') AS hit_chunk_ids, array_to_string(dlist, ',') AS hit_doc_ids,
    NOT missing AND NOT (wants AND nothing) AS retrieval_passed, NOT forbidden AS stale_passed,
    wants OR nothing AS refusal_passed, CASE WHEN fixture THEN true END AS citation_passed,
    CASE WHEN fixture THEN NOT wants END AS citation_resolves,
    CASE WHEN fixture THEN CASE WHEN wants THEN 'missing_answer_citation' ELSE '' END END AS citation_issue_codes,
    told AS generated_outcome, told = expected_outcome AS outcome_passed, true AS generated_citation_passed,
    concat_ws(',', CASE WHEN missing THEN 'expected_source_doc_missing:' || doc END,
      CASE WHEN forbidden THEN 'forbidden_doc_retrieved:' || doc END,
      CASE WHEN NOT wants AND NOT nothing THEN 'expected_no_hits' END,
      CASE WHEN wants AND nothing THEN 'answer_expected_but_no_hits' END,
      CASE WHEN told <> expected_outcome THEN 'generated_answer_outcome_mismatch:expected=' || expected_outcome || ',observed=' || told END
    ) AS issues
  FROM flags
),
finals AS (SELECT *, retrieval_passed AND stale_passed AND refusal_passed AND outcome_passed AS passed FROM results)""",
))


_LIBRARY = _with(DOCS, LINES, CHUNKS) + rf""",
ctok AS (
  SELECT g.*, CASE WHEN d.doc_number % 3 = 0 THEN 'main' ELSE 'c' || (d.doc_number % 7) END AS corpus,
    regexp_extract_all(lower(g.section_heading || {_NL} || g.text), '{_W}') AS tokens
  FROM gated g JOIN docs d ON d.doc_id = g.doc_id
),
stats AS (SELECT corpus, count(*) AS n_chunks, sum(len(tokens)) / count(*) AS avg_tokens FROM ctok GROUP BY corpus),
occ AS (SELECT corpus, doc_id, chunk_index, chunk_id, len(tokens) AS n_tokens, unnest(tokens) AS token FROM ctok),
tf AS (SELECT corpus, doc_id, chunk_index, chunk_id, n_tokens, token, count(*) AS tf FROM occ GROUP BY ALL),
df AS (SELECT corpus, token, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT d.*, s.avg_tokens, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS raw_idf FROM df d JOIN stats s ON s.corpus = d.corpus),
idf AS (
  SELECT *, CASE WHEN raw_idf < 0 THEN 0.25 * avg(raw_idf) OVER (PARTITION BY corpus) ELSE raw_idf END AS idf FROM raw
),
asked AS (
  SELECT printf('Q-%05d', item_id) AS query_id, text AS question, unnest(['main', 'c' || (item_id % 7)]) AS corpus FROM benchmark
),
qt AS (SELECT corpus, query_id, regexp_extract_all(lower(question), '{_W}') AS ts FROM asked),
word AS (SELECT corpus, query_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS place FROM qt),
weight AS (
  SELECT t.*, i.idf * (t.tf * 2.5 / (t.tf + 1.5 * (1 - 0.75 + 0.75 * (t.n_tokens / i.avg_tokens)))) AS weight
  FROM tf t JOIN idf i ON i.token = t.token AND i.corpus = t.corpus
),
scores AS (
  SELECT w.corpus, query_id, doc_id, chunk_index, chunk_id, list_sum(list(CAST(weight AS DOUBLE) ORDER BY place)) AS score
  FROM word w JOIN weight g ON w.token = g.token AND w.corpus = g.corpus GROUP BY ALL
),
ranks AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY corpus, query_id ORDER BY score DESC, doc_id, chunk_index, chunk_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0
),
terms AS (
  SELECT corpus, query_id, list_distinct(list_filter(regexp_extract_all(lower(question), '{_W}'),
    lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))) AS terms FROM asked
),
covered AS (
  SELECT r.*, CASE WHEN len(t.terms) > 0 THEN len(list_intersect(t.terms, c.tokens)) / CAST(len(t.terms) AS DOUBLE) ELSE 0.0 END AS coverage
  FROM ranks r JOIN terms t ON t.query_id = r.query_id AND t.corpus = r.corpus JOIN ctok c ON c.chunk_id = r.chunk_id AND c.corpus = r.corpus
)"""


def _rate(flag: str, where: str = "true") -> str:
    return (
        f"CASE WHEN count(*) FILTER ({where}) = 0 THEN 'n/a' ELSE count(*) FILTER (({where}) AND {flag}) "
        f"|| '/' || count(*) FILTER ({where}) END"
    )


_MESSY = rf"""
WITH m AS (
  SELECT doc_id AS n, lang, source,
    CASE WHEN doc_id % 9 = 0 THEN 'approved' WHEN doc_id % 9 = 1 THEN 'draft' WHEN doc_id % 9 = 2 THEN 'wip'
      WHEN doc_id % 9 = 3 THEN 'old' WHEN doc_id % 9 = 4 THEN 'replaced' ELSE 'in force' END AS st,
    'incoming/documents/' || doc_id || '/M-' || (doc_id % 300) || '_v1.' || (CASE WHEN doc_id % 11 = 0 THEN 7 ELSE doc_id % 4 END) || '.md' AS source_path,
    'M-' || (doc_id % 300) AS file_id, '1.' || (CASE WHEN doc_id % 11 = 0 THEN 7 ELSE doc_id % 4 END) AS file_version,
    '1.' || (doc_id % 4) AS reg_version, doc_id % 41 <> 0 AS safe, doc_id % 37 = 0 AS gone, doc_id % 37 <> 0 AND doc_id % 43 = 0 AS blank
  FROM documents
),
e AS (
  SELECT *, NOT gone AND NOT blank AS has,
    CASE WHEN n % 8 <> 0 OR (NOT gone AND NOT blank) THEN st END AS raw_status,
    CASE WHEN n % 31 = 0 THEN 'memo' WHEN n % 2 = 0 THEN 'procedure' ELSE 'policy' END AS raw_type
  FROM m
),
f AS (
  SELECT *, file_version <> reg_version AS clash,
    CASE raw_status WHEN 'approved' THEN 'Approved' WHEN 'in force' THEN 'Effective' WHEN 'draft' THEN 'Draft' WHEN 'old' THEN 'Obsolete' WHEN 'replaced' THEN 'Superseded' END AS status0,
    CASE raw_type WHEN 'procedure' THEN 'SOP' WHEN 'policy' THEN 'Policy' END AS type0
  FROM e
),
g AS (
  SELECT n, source_path, safe, n % 6 = 0 AS current_version,
    CASE WHEN safe THEN file_id END AS doc_id, CASE WHEN safe AND n % 29 <> 0 THEN 'Title ' || n END AS doc_title,
    CASE WHEN safe THEN type0 END AS doc_type, CASE WHEN safe AND NOT clash THEN file_version END AS version,
    CASE WHEN safe THEN status0 END AS canonical_status,
    CASE WHEN safe AND n % 23 <> 0 THEN printf('2024-01-%02d', n % 28 + 1) END AS effective_date,
    CASE WHEN safe AND has THEN source END AS department,
    CASE WHEN NOT safe THEN ['unsafe_source_path'] ELSE list_filter([
      CASE WHEN clash THEN 'conflicting_field_sources:version' END, CASE WHEN clash THEN 'missing_required_field:version' END,
      CASE WHEN n % 29 = 0 THEN 'missing_required_field:doc_title' END, CASE WHEN type0 IS NULL THEN 'missing_required_field:doc_type' END,
      CASE WHEN type0 IS NULL THEN 'unsupported_doc_type:' || raw_type END, CASE WHEN status0 IS NULL THEN 'missing_required_field:status' END,
      CASE WHEN status0 IS NULL AND raw_status IS NOT NULL THEN 'unknown_status_value:' || raw_status END,
      CASE WHEN n % 23 = 0 THEN 'missing_required_field:effective_date' END, CASE WHEN NOT has THEN 'missing_required_field:department' END,
      CASE WHEN gone THEN 'source_file_not_found' END, CASE WHEN NOT has THEN 'empty_source_text' END], lambda x: x IS NOT NULL) END AS r0
  FROM f
),
h AS (
  SELECT *, CASE WHEN list_has_any(r0, ['empty_source_text', 'unsafe_source_path', 'source_file_not_found']) THEN 'rejected'
    WHEN len(r0) > 0 THEN 'needs_review' WHEN canonical_status IN ('Approved', 'Effective') THEN 'mapped_cleanly' ELSE 'excluded' END AS s0,
    doc_id IS NOT NULL AND coalesce(canonical_status IN ('Approved', 'Effective'), false) AS gate
  FROM g
),
k AS (
  SELECT *, gate AND count(*) FILTER (gate) OVER (PARTITION BY doc_id) > 1
    AND count(*) FILTER (gate AND current_version) OVER (PARTITION BY doc_id) <> 1 AS twice FROM h
),
records AS (
  SELECT source_path, CASE WHEN twice THEN 'needs_review' ELSE s0 END AS state, s0 = 'mapped_cleanly' AND NOT twice AS retrievable,
    list_sort(CASE WHEN twice THEN list_append(r0, 'duplicate_current_version') ELSE r0 END) AS reasons,
    doc_id, doc_title, doc_type, version, canonical_status, effective_date, department, n
  FROM k
)"""

_COS = """
WITH v AS (SELECT vec_id AS item_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
q AS (SELECT CAST(label AS BIGINT) AS query_id, min_by(v, item_id) AS q FROM v GROUP BY label),
c AS (SELECT query_id, item_id, list_cosine_similarity(q, v) AS score, q[1] * v[1] AS other FROM q, v),
ra AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS ra,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY other DESC, item_id) AS INTEGER) AS rb FROM c),
fs AS (SELECT query_id, item_id, 1.0::DOUBLE / (60 + ra) + 1.0::DOUBLE / (60 + rb) AS score FROM ra),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM fs)"""

_HASHED = "'sha256:' || sha256(raw_text)"

SQL: dict[str, str] = {
    "status_gate": _with(DOCS) + " SELECT doc_id, status, version FROM docs WHERE status IN ('Approved', 'Effective')",
    "ingest_report": _with(DOCS) + """ SELECT count(*) AS metadata_files_seen, count(*) AS documents_valid,
      count(*) FILTER (status IN ('Approved', 'Effective')) AS documents_retrievable,
      count(*) FILTER (status NOT IN ('Approved', 'Effective')) AS documents_excluded FROM docs""",
    "duplicate_current_version": _with(DOCS) + """ SELECT family AS doc_id, count(*) AS n_versions,
      string_agg(version, ', ' ORDER BY version) AS versions FROM docs WHERE status IN ('Approved', 'Effective') GROUP BY family HAVING count(*) > 1""",
    "metadata_checks": _with(DOCS) + """ SELECT doc_id, CASE WHEN CAST(review_due_date AS DATE) < CAST(effective_date AS DATE)
      THEN 'review_due_date: must not be before effective_date' END AS problem FROM docs""",
    "source_hash": _with(DOCS) + f" SELECT doc_id, {_HASHED} AS source_hash FROM docs",
    "corpus_check": _with(DOCS) + """, p AS (
      SELECT *, CASE WHEN CAST(review_due_date AS DATE) < CAST(effective_date AS DATE) THEN 'review_due_date: must not be before effective_date'
        WHEN doc_number % 13 = 0 THEN 'source_file_path must stay inside the corpus directory'
        WHEN doc_number % 17 = 0 THEN 'source file not found: ' || source_file_path || '.gone'
        WHEN doc_number % 19 = 0 THEN 'source_hash does not match source file content' END AS problem FROM docs)
      SELECT 'metadata/' || doc_number || '.yaml' AS path, problem AS message FROM p WHERE problem IS NOT NULL
      UNION ALL
      SELECT family, 'more than one retrievable version for doc_id ''' || family || ''' (versions: ' || string_agg(version, ', ' ORDER BY version)
        || '); exactly one Approved/Effective version may be retrievable'
      FROM p WHERE problem IS NULL AND status IN ('Approved', 'Effective') GROUP BY family HAVING count(*) > 1""",
    "resolved_sources": _with(DOCS) + """, p AS (
      SELECT doc_number AS n, CASE doc_number % 6 WHEN 0 THEN './documents/' WHEN 1 THEN 'documents/gone/../sub//' WHEN 2 THEN 'annex/a/b/./../'
        WHEN 3 THEN 'documents/../../other/' WHEN 4 THEN '/documents/' ELSE 'x/y/../../documents/sub/./' END || doc_number || '.md' AS path FROM docs)
      SELECT CASE WHEN n % 6 IN (3, 4) OR n % 17 = 0 THEN 'metadata/' || n || '.yaml' ELSE path END AS path,
        CASE WHEN n % 6 IN (3, 4) THEN 'source_file_path must stay inside the corpus directory'
          WHEN n % 17 = 0 THEN 'source file not found: ' || path ELSE 'valid' END AS message FROM p""",
    "line_offsets": _with(DOCS, LINES) + """ SELECT doc_id, CAST(line_number AS INTEGER) AS line_number, CAST(char_start AS INTEGER) AS char_start,
      CAST(n_chars AS INTEGER) AS n_chars, is_heading, is_blank FROM lines""",
    "chunk_documents": _with(DOCS, LINES, CHUNKS) + " SELECT * FROM gated",
    "segment_chunks": _with(DOCS, LINES, CHUNKS) + " SELECT * FROM gated",
    "chunk_spans": _with(DOCS, LINES, CHUNKS) + " SELECT status, count(*) AS n_chunks, count(*) AS n_exact FROM blind GROUP BY status",
    "tokenize": f"SELECT doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '{_W}'), ' ') AS tokens FROM documents",
    "content_terms": f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '{_W}'),
      lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w)))), ' ') AS terms FROM documents""",
    "term_freq": _GATED + " SELECT chunk_id, token, tf FROM tf",
    "doc_freq": _GATED + " SELECT token, df FROM df",
    "corpus_stats": _GATED + " SELECT n_chunks, round(avg_tokens, 6) AS avg_tokens FROM stats",
    "idf": _GATED + " SELECT token, df, round(raw_idf, 6) AS raw_idf, round(idf, 6) AS idf FROM idf",
    "bm25_scores": ",".join((_GATED, ASKED, _score())) + " SELECT query_id, doc_id, chunk_index, chunk_id, round(score, 6) AS score FROM scores",
    "bm25_topk": ",".join((_GATED, ASKED, _score()))
    + " SELECT query_id, doc_id, chunk_index, chunk_id, round(score, 6) AS score, rank FROM ranks WHERE rank <= 5",
    "library_hits": _LIBRARY + """ SELECT corpus, query_id, rank, chunk_id, round(score, 6) AS score, round(coverage, 6) AS coverage
      FROM covered v WHERE rank <= 5 AND EXISTS (SELECT 1 FROM covered b
        WHERE b.corpus = v.corpus AND b.query_id = v.query_id AND b.rank = 1 AND b.coverage >= 0.4)""",
    "coverage_rank1": ",".join((_GATED, ASKED, _score(), _cover()))
    + " SELECT query_id, chunk_id, round(coverage, 6) AS coverage FROM covered WHERE rank = 1",
    "gated_hits": _HITS + " SELECT query_id, rank, doc_id, chunk_id, status, line_or_page_span, round(score, 6) AS score FROM hits",
    "status_blind_topk": _HELD + """ SELECT r.query_id, r.rank, r.chunk_id, c.status, round(r.score, 6) AS score
      FROM ranks r JOIN ctok c ON c.chunk_id = r.chunk_id WHERE r.rank <= 5""",
    "held_out_hits": _HELD + """ SELECT r.query_id, r.rank, r.chunk_id, c.status, round(r.score, 6) AS score
      FROM ranks r JOIN ctok c ON c.chunk_id = r.chunk_id WHERE r.rank <= 5 AND c.status NOT IN ('Approved', 'Effective')""",
    "held_out_best_per_doc": _HELD + """ SELECT query_id, doc_id, rank, chunk_id FROM (
      SELECT r.query_id, r.doc_id, r.rank, r.chunk_id, row_number() OVER (PARTITION BY r.query_id, r.doc_id ORDER BY r.rank) AS n
      FROM ranks r JOIN ctok c ON c.chunk_id = r.chunk_id WHERE r.rank <= 20 AND c.status NOT IN ('Approved', 'Effective')) WHERE n = 1""",
    "conversation_retrieval": ",".join((_GATED, TURNS, _score("turns")))
    + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranks WHERE rank <= 3",
    "extractive_answer": _ANSWERS + " SELECT query_id, outcome, answer_text, citations FROM answers",
    "citation_validation": _HELD + """, got AS (
        SELECT a.query_id, a.item_id % 4 AS kind, count(r.rank) AS n, count(r.rank) FILTER (c.status NOT IN ('Approved', 'Effective')) AS stale
        FROM asked a LEFT JOIN ranks r ON r.query_id = a.query_id AND r.rank <= 3 LEFT JOIN ctok c ON c.chunk_id = r.chunk_id GROUP BY ALL),
      v AS (SELECT *, CASE WHEN kind = 3 THEN 'refusal' ELSE 'answer' END AS outcome,
          CASE WHEN kind = 1 THEN 0 WHEN kind = 2 THEN n + 1 ELSE n END AS cited, CASE WHEN kind = 1 THEN 0 ELSE n END AS resolved FROM got),
      w AS (SELECT *, resolved = cited AND NOT (outcome = 'answer' AND cited = 0) AS citation_resolves,
          array_to_string(list_concat(list_concat(list_concat(
            list_transform(range(stale), lambda x: 'stale_retrieved_chunk'),
            CASE WHEN outcome = 'answer' AND cited = 0 THEN ['missing_answer_citation'] ELSE [] END),
            CASE WHEN outcome = 'refusal' AND cited > 0 THEN ['refusal_has_citation'] ELSE [] END),
            list_concat(list_transform(range(CASE WHEN kind = 1 THEN 0 ELSE stale END), lambda x: 'stale_citation'),
              CASE WHEN kind = 2 THEN ['unresolved_citation'] ELSE [] END)), ',') AS issue_codes FROM v)
      SELECT query_id, outcome, CAST(cited AS INTEGER) AS answer_citation_count, CAST(n AS INTEGER) AS retrieved_chunk_count,
        CAST(resolved AS INTEGER) AS resolved_citation_count, citation_resolves, issue_codes, citation_resolves AND issue_codes = '' AS valid FROM w""",
    "review_routing": _ANSWERS + """ SELECT query_id, outcome, outcome = 'refusal' OR coalesce(top_score <= 20.0, false) AS review_recommended,
      CASE WHEN outcome = 'refusal' THEN 'refusal_no_supporting_documents' WHEN top_score <= 20.0 THEN 'low_top_score' ELSE '' END AS review_reasons FROM answers""",
    "eval_cases": _CASES + " SELECT * FROM finals",
    "eval_metrics": _CASES + f""" SELECT count(*) AS cases_total, count(*) FILTER (passed) AS cases_passed, bool_and(passed) AS passed,
      {_rate('passed')} AS case_pass_rate, {_rate('retrieval_passed')} AS retrieval_expectation_match_rate,
      {_rate('stale_passed')} AS stale_document_exclusion_rate,
      {_rate('refusal_passed', "expected_outcome = 'refusal'")} AS refusal_expectation_match_rate,
      {_rate('citation_resolves', 'citation_resolves IS NOT NULL')} AS citation_resolves_to_retrieved_chunk_rate,
      {_rate('citation_passed', 'citation_resolves IS NOT NULL')} AS citation_expectation_match_rate,
      {_rate('outcome_passed')} AS generated_answer_outcome_match_rate,
      {_rate('generated_citation_passed')} AS generated_answer_citation_validation_rate FROM finals""",
    "onboard_version_norm": "SELECT doc_id AS doc_number, '1.' || (doc_id % 4) AS version FROM documents",
    "onboard_records": _MESSY + """ SELECT source_path, state, retrievable, array_to_string(reasons, ',') AS reasons, doc_id, doc_title, doc_type,
      version, canonical_status, effective_date, department FROM records""",
    "onboard_conflicts": _MESSY + """ SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM records)
      WHERE starts_with(reason, 'conflicting_field_sources:') GROUP BY reason""",
    "onboard_states": _MESSY + " SELECT s AS state, (SELECT count(*) FROM records WHERE state = s) AS n FROM (SELECT unnest(["
    + ", ".join(f"'{s}'" for s in STATES) + "]) AS s)",
    "field_coverage": _MESSY + " UNION ALL ".join(
        f" SELECT '{f}' AS field, count({'canonical_status' if f == 'status' else f}) AS established, "
        f"count(*) - count({'canonical_status' if f == 'status' else f}) AS missing FROM records" for f in FIELDS
    ),
    "status_counts": _MESSY + " SELECT canonical_status, count(*) AS n FROM records WHERE canonical_status IS NOT NULL GROUP BY canonical_status",
    "unknown_statuses": _MESSY + """ SELECT DISTINCT substring(reason, 22) AS value FROM (SELECT unnest(reasons) AS reason FROM records)
      WHERE starts_with(reason, 'unknown_status_value:')""",
    "duplicate_review": _MESSY + " SELECT source_path, doc_id, state FROM records WHERE list_contains(reasons, 'duplicate_current_version')",
    "source_paths": """WITH r AS (SELECT 'd/' || (doc_id % 700) AS source_path, max_by(lang, doc_id) AS language FROM documents GROUP BY 1),
      p AS (SELECT 'd/' || (doc_id % 500) AS source_path FROM documents UNION SELECT source_path FROM r)
      SELECT p.source_path, r.language FROM p LEFT JOIN r ON r.source_path = p.source_path""",
    "normalized_corpus": _MESSY + f""" SELECT r.doc_id, r.doc_title, r.doc_type, r.version, r.canonical_status AS status, r.effective_date, r.department,
      'documents/' || split_part(r.source_path, '/', 4) AS source_file_path,
      'sha256:' || sha256((CASE WHEN r.n % 8 = 0 THEN 'Status: ' || m.st || {_NL} ELSE '' END) || 'DEPARTMENT: ' || d.source || {_NL} || {_NL} || coalesce(d.text, '')) AS source_hash,
      r.source_path FROM records r JOIN documents d ON d.doc_id = r.n JOIN m ON m.n = r.n WHERE r.state IN ('mapped_cleanly', 'excluded')""",
    "cosine_topk": _COS + " SELECT query_id, item_id, round(score, 6) AS score, ra AS rank FROM ra WHERE ra <= 10",
    "rrf_fusion": _COS + " SELECT query_id, item_id, round(score, 9) AS score, rank FROM fused",
    "recall_mrr": _COS + """, rel AS (SELECT CAST(label AS BIGINT) AS query_id, CASE WHEN label % 2 = 0 THEN 'easy' ELSE 'hard' END AS tier, max(item_id) AS item_id FROM v GROUP BY label),
      f AS (SELECT r.tier, u.rank FROM rel r LEFT JOIN fused u ON u.query_id = r.query_id AND u.item_id = r.item_id)
      SELECT coalesce(tier, 'all') AS tier, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_1,
        round(avg(CASE WHEN rank <= 100 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_100, round(avg(CASE WHEN rank <= 500 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_500,
        round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 6) AS mrr FROM f GROUP BY ROLLUP (tier)""",
    "best_method": _COS + """, rel AS (SELECT CAST(label AS BIGINT) AS query_id, CASE WHEN label % 2 = 0 THEN 'easy' ELSE 'hard' END AS tier, max(item_id) AS item_id FROM v GROUP BY label),
      every AS (SELECT query_id, item_id, 'cosine' AS method, ra AS rank FROM ra UNION ALL SELECT query_id, item_id, 'first', rb FROM ra
        UNION ALL SELECT query_id, item_id, 'fused', rank FROM fused),
      f AS (SELECT m.method, r.tier, u.rank FROM rel r CROSS JOIN (VALUES ('cosine'), ('first'), ('fused')) m(method)
        LEFT JOIN every u ON u.query_id = r.query_id AND u.item_id = r.item_id AND u.method = m.method),
      s AS (SELECT coalesce(tier, 'all') AS tier, method, round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 9) AS mrr
        FROM f GROUP BY GROUPING SETS ((tier, method), (method)))
      SELECT tier, arg_max(method, (mrr, method)) AS method FROM s GROUP BY tier""",
    "separation": ",".join((
        _GATED, ASKED, TURNS,
        "both_ AS (SELECT query_id, question, true AS on_topic FROM asked UNION ALL SELECT query_id, question, false FROM turns)",
        _score("both_"), _cover("both_"),
    )) + """, top AS (SELECT b.query_id, b.on_topic, coalesce(c.score, 0) AS s, coalesce(c.coverage, 0) AS c
        FROM both_ b LEFT JOIN covered c ON c.query_id = b.query_id AND c.rank = 1),
      x AS (SELECT min(s) FILTER (on_topic) AS a, max(s) FILTER (NOT on_topic) AS b, count(*) FILTER (NOT on_topic AND c < 0.6) AS refused_off_topic,
        count(*) FILTER (NOT on_topic) AS n_off_topic, count(*) FILTER (on_topic AND c < 0.6) AS refused_on_topic, count(*) FILTER (on_topic) AS n_on_topic FROM top)
      SELECT round(a, 6) AS min_on_topic, round(b, 6) AS max_off_topic, refused_off_topic, n_off_topic, refused_on_topic, n_on_topic,
        coalesce(a > b, false) AS clean, CASE WHEN a > b THEN round((a + b) / 2, 6) END AS midpoint FROM x""",
    "excluded_documents": _with(DOCS) + """ SELECT doc_id, doc_title, doc_type, version, status, department, source_file_path
      FROM docs WHERE status NOT IN ('Approved', 'Effective')""",
    "page_questions": r"""WITH p AS (SELECT regexp_extract_all(regexp_replace(html, 'href="/([^"]*)"', 'data-q="\1"', 'g'), 'data-q="([^"]+)"', 1) AS qs FROM pages),
      u AS (SELECT unnest(qs) AS q FROM p)
      SELECT replace(replace(replace(replace(replace(replace(q, '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS question,
        count(*) AS n FROM u GROUP BY 1""",
    "audit_counts": """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
      FROM events GROUP BY 1, 2""",
    "audit_log": "SELECT event_id, event_type, user_id FROM events",
}
#: The stored and the incremental index give what a fresh one gives.
SQL |= {"stored_topk": SQL["bm25_topk"], "incremental_idf": SQL["idf"]}
