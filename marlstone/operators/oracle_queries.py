"""SQL twins of queries that other modules define, and queries made so that SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import collection_queries as cq
from marlstone.operators.retrieval_queries import BM25_CTE, K, TITLE_BOOST_SQL, WORDS

# Runs --------------------------------------------------------------------------------------------------------------------


def run_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`run_ledger` with its times as seconds."""
    r = cq.run_ledger(spark, sf_dir)
    return r.withColumns({"started": F.unix_timestamp("started"), "finished": F.unix_timestamp("finished"), "error": F.coalesce("error", F.lit(""))})


_PLAIN = "CASE WHEN lower({c}) IN ('ok', 'success') THEN 'succeeded' ELSE {c} END"
RUNS_CTE = f"""r AS (SELECT *, coalesce(nullif(runId, ''), 'anonymous-' || seq) AS run, {cq._TIME.format(c='startedAt')} AS s, {cq._TIME.format(c='finishedAt')} AS f, coalesce(source = 'script', false) AS script FROM runs_raw),
ph AS (SELECT run, seq, script, i, p FROM (SELECT run, seq, script, unnest(phases) AS p, unnest(range(len(phases))) AS i FROM r) WHERE p IS NOT NULL),
pk AS (SELECT *, coalesce(p.name, '#' || seq || '#' || i) AS key, {_PLAIN.format(c='p.status')} AS st FROM ph),
p1 AS (SELECT run, key, min((seq, i)) AS first, first(p.name ORDER BY script, seq, i) AS name, first(p.fatal ORDER BY script, seq, i) AS fatal,
  coalesce(first(p.startedAt ORDER BY script, seq, i), first(p.startedAt ORDER BY script, seq, i) FILTER (p.startedAt IS NOT NULL)) AS startedAt,
  CASE WHEN bool_or(st = 'failed') THEN 'failed' WHEN bool_or(st = 'degraded') THEN 'degraded' WHEN bool_or(st = 'unknown') THEN 'unknown' WHEN bool_or(st = 'skipped') THEN 'skipped' WHEN bool_or(st = 'succeeded') THEN 'succeeded' ELSE min(st) END AS status FROM pk GROUP BY ALL),
p2 AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY first) AS place, CASE WHEN startedAt IS NOT NULL THEN row_number() OVER (PARTITION BY run, startedAt IS NOT NULL ORDER BY first) END AS nth, CASE WHEN startedAt IS NOT NULL THEN row_number() OVER (PARTITION BY run, startedAt IS NOT NULL ORDER BY startedAt, first) END AS sorted FROM p1),
p3 AS (SELECT a.*, coalesce(b.place, a.place) AS slot FROM p2 a LEFT JOIN p2 b ON a.run = b.run AND a.sorted = b.nth),
pr AS (SELECT run, string_agg(concat_ws(':', name, status), ',' ORDER BY slot) AS phases, count(*) AS n_phases, bool_or(status = 'failed' AND coalesce(fatal, false)) AS lost, bool_or(NOT coalesce(status IN ('skipped', 'succeeded'), false)) AS bad, bool_and(status = 'skipped') AS idle FROM p3 GROUP BY run),
src AS (SELECT run, source, bool_or(stage = 'begin') AS b, bool_or(stage = 'end') AS e FROM r WHERE source IS NOT NULL GROUP BY ALL),
un AS (SELECT run, string_agg(source, ',' ORDER BY source) AS unclosed FROM src WHERE b AND NOT coalesce(e, false) GROUP BY run),
g AS (SELECT run, first(collection ORDER BY seq) AS collection, min(s) AS s, max(f) AS f, count(*) AS records, coalesce(string_agg(CASE WHEN error <> '' THEN error END, '; ' ORDER BY seq), '') AS error,
  coalesce(first(job ORDER BY seq) FILTER (script AND job IS NOT NULL), last(job ORDER BY seq) FILTER (NOT script AND job IS NOT NULL)) AS job,
  coalesce(first(trigger ORDER BY seq) FILTER (script AND trigger IS NOT NULL), last(trigger ORDER BY seq) FILTER (NOT script AND trigger IS NOT NULL)) AS trigger,
  coalesce(first(documentCount ORDER BY seq) FILTER (NOT script AND documentCount IS NOT NULL), last(documentCount ORDER BY seq) FILTER (script AND documentCount IS NOT NULL)) AS document_count,
  coalesce(first(chunkCount ORDER BY seq) FILTER (NOT script AND chunkCount IS NOT NULL), last(chunkCount ORDER BY seq) FILTER (script AND chunkCount IS NOT NULL)) AS chunk_count,
  last(variant ORDER BY CASE WHEN NOT script THEN 0 WHEN stage = 'begin' THEN 1 ELSE 2 END, seq) FILTER (variant IS NOT NULL) AS variant,
  count({_PLAIN.format(c='status')}) AS n_states, bool_or({_PLAIN.format(c='status')} = 'failed') AS s_failed, bool_or({_PLAIN.format(c='status')} = 'degraded') AS s_degraded, bool_or({_PLAIN.format(c='status')} = 'unknown') AS s_unknown, min({_PLAIN.format(c='status')}) AS s_any FROM r GROUP BY run),
runs AS (SELECT g.collection, g.run, g.job, g.trigger, g.variant, epoch(g.s)::BIGINT AS started, epoch(g.f)::BIGINT AS finished, CASE WHEN un.unclosed IS NULL THEN greatest(0, epoch(g.f)::BIGINT - epoch(g.s)::BIGINT) END AS duration_s,
  CASE WHEN un.unclosed IS NOT NULL THEN CASE WHEN epoch(TIMESTAMPTZ '{cq.NOW}+00') - epoch(g.s) < 21600 THEN 'running' ELSE 'incomplete' END
    WHEN pr.n_phases > 0 THEN CASE WHEN lost THEN 'failed' WHEN bad THEN 'degraded' WHEN idle THEN 'skipped' ELSE 'succeeded' END
    WHEN n_states = 0 THEN 'unknown' WHEN s_failed THEN 'failed' WHEN s_degraded THEN 'degraded' WHEN s_unknown THEN 'unknown' ELSE s_any END AS status,
  document_count, chunk_count, error, pr.phases, coalesce(un.unclosed, '') AS unclosed, records FROM g LEFT JOIN pr USING (run) LEFT JOIN un USING (run))"""
RUN_FOLDS_SQL = f"WITH {RUNS_CTE} SELECT * FROM runs"
LAST_RUNS_SQL = f"WITH {RUNS_CTE} SELECT collection, run, status, duration_s FROM runs QUALIFY row_number() OVER (PARTITION BY collection ORDER BY started DESC NULLS LAST, run DESC) <= 3"
MEDIAN_BY_VARIANT_SQL = f"WITH {RUNS_CTE}, d AS (SELECT * FROM runs WHERE duration_s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY collection, variant ORDER BY started DESC NULLS LAST, run DESC) <= 50) SELECT collection, variant, floor(median(duration_s))::BIGINT AS median_s, count(*) AS runs FROM d GROUP BY ALL"


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`job_overview` with its times as seconds."""
    return cq.job_overview(spark, sf_dir).withColumn("started", F.unix_timestamp("started"))


JOB_STATES_SQL = f"""WITH {RUNS_CTE}, l AS (SELECT collection AS name, run, status, started FROM runs QUALIFY row_number() OVER (PARTITION BY collection ORDER BY started DESC NULLS LAST, run DESC) = 1),
c AS (SELECT DISTINCT lower(trim(source)) AS name FROM documents WHERE source IS NOT NULL), s AS (SELECT * FROM (VALUES ('jira', 3600), ('archive', 86400)) t(name, cadence_s)), n AS (SELECT name FROM l UNION SELECT name FROM c UNION SELECT name FROM s)
SELECT n.name, c.name IS NOT NULL AS loaded, s.cadence_s, l.run, l.status, l.started FROM n LEFT JOIN l ON l.name IS NOT DISTINCT FROM n.name LEFT JOIN c ON c.name = n.name LEFT JOIN s ON s.name = n.name"""

# Graphs ------------------------------------------------------------------------------------------------------------------

ENTITY_CONTEXTS_SQL = f"""WITH {cq.STAR_CTE}, nb AS (SELECT source AS node, target AS other, type, 'outgoing' AS d FROM edges UNION ALL SELECT target, source, type, 'incoming' FROM edges),
l AS (SELECT nb.node, nb.type, nb.d, n.label AS l, count(*) AS c FROM nb JOIN nodes n ON n.id = nb.other GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY node, type, d ORDER BY l) AS n FROM l),
p AS (SELECT node, type || CASE WHEN d = 'incoming' THEN '⁻¹' ELSE '' END || ': ' || string_agg(CASE WHEN n <= 3 THEN l END, ', ' ORDER BY l) || CASE WHEN sum(c) > 3 THEN ' (+' || (sum(c) - 3)::BIGINT || ')' ELSE '' END AS t FROM k GROUP BY node, type, d)
SELECT id, concat_ws(' | ', label || ' (' || type || ')', (SELECT string_agg(t, ' | ' ORDER BY t) FROM p WHERE p.node = id)) AS context FROM nodes"""

ISSUE_GRAPH_CTE = rf"""{cq.LATEST_CTE}, k AS (SELECT * FROM latest WHERE issue_key IS NOT NULL), ep AS (SELECT epic_link AS e FROM k WHERE epic_link IS NOT NULL GROUP BY 1),
nodes AS (SELECT 'epic:' || e AS id, 'Epic' AS type, coalesce(k.title, e) AS label FROM ep LEFT JOIN k ON k.issue_key = e UNION ALL SELECT 'issue:' || issue_key, 'Issue', coalesce(title, issue_key) FROM k),
rf AS (SELECT issue_key, epic_link, unnest(list_distinct(regexp_extract_all(coalesce(description, ''), '\b([A-Z][A-Z0-9]+-\d+)\b', 1))) AS ref FROM k),
edges AS (SELECT 'issue:' || issue_key AS source, 'epic:' || epic_link AS target, 'belongs_to_epic' AS type FROM k WHERE epic_link IS NOT NULL UNION ALL SELECT 'issue:' || issue_key, 'issue:' || ref, 'refers_to' FROM rf WHERE ref <> issue_key AND ref <> coalesce(epic_link, '') AND ref IN (SELECT issue_key FROM k)),
asked AS (SELECT ingest_id, concat_ws(' ', title, epic_link) AS q, 'Which issues belong under epic ' || epic_link AS w FROM k_all WHERE epic_link IS NOT NULL)""".replace("asked AS", "k_all AS (SELECT * FROM latest), asked AS")
AUGMENTED_QUERIES_SQL = rf"""WITH {ISSUE_GRAPH_CTE},
codes AS (SELECT ingest_id, unnest(regexp_extract_all(q, '\b([A-Z][A-Z0-9]+-\d+)\b', 1)) AS c, unnest(range(len(regexp_extract_all(q, '\b([A-Z][A-Z0-9]+-\d+)\b', 1)))) AS i FROM asked),
hit AS (SELECT ingest_id, i, CASE WHEN 'issue:' || c IN (SELECT id FROM nodes) THEN 'issue:' || c ELSE 'epic:' || c END AS id, 'issue:' || c NOT IN (SELECT id FROM nodes) AS second FROM codes),
m AS (SELECT ingest_id, h.id, min(2 * i + second::INT) AS pos FROM hit h JOIN nodes n ON n.id = h.id GROUP BY ALL),
rr AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS n FROM edges WHERE type = 'refers_to'),
terms AS (SELECT id AS node, 0 AS step, 0 AS n, substr(label, 1, 60) AS term FROM nodes UNION ALL SELECT e.source, 1, 1, n.label FROM edges e JOIN nodes n ON n.id = e.target WHERE e.type = 'belongs_to_epic' UNION ALL SELECT rr.source, 2, rr.n, substr(x.label, 1, 60) FROM rr JOIN nodes x ON x.id = rr.target WHERE rr.n <= 3),
f AS (SELECT m.ingest_id, t.term, min((m.pos, m.id, t.step, t.n)) AS o FROM m JOIN terms t ON t.node = m.id WHERE t.term <> '' GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY ingest_id ORDER BY o) AS k FROM f),
t AS (SELECT ingest_id, string_agg(term, ' ' ORDER BY k) AS terms FROM s WHERE k <= 5 GROUP BY 1)
SELECT a.ingest_id AS query_id, concat_ws(' ', a.q, t.terms) AS expanded, (SELECT nullif(count(*), 0) FROM m WHERE m.ingest_id = a.ingest_id) AS entities FROM asked a LEFT JOIN t USING (ingest_id)"""

AUTHOR_GRAPH_SQL = r"""WITH c AS (SELECT split_part(author, ' ', 1) AS handle, body FROM jira_comments WHERE author IS NOT NULL AND body IS NOT NULL), s AS (SELECT DISTINCT lower(handle) AS h FROM c),
q AS (SELECT lower(handle) AS source, unnest(regexp_extract_all(body, '(?i)quot(?:ed|ing)[^@\n]{0,20}@(\w{1,30})', 1)) AS target, 3.0 AS w FROM c),
ln AS (SELECT lower(handle) AS source, unnest(string_split(body, chr(10))) AS l FROM c), mt AS (SELECT source, unnest(regexp_extract_all(l, '(?:^|[^\w.@])@(\w{1,30})', 1)) AS target, 1.0 AS w FROM ln WHERE NOT (starts_with(l, '#') OR starts_with(l, '**') OR starts_with(l, '>'))),
b AS (SELECT source, lower(target) AS target, w FROM (SELECT * FROM q UNION ALL SELECT * FROM mt)), k AS (SELECT source, target, sum(w) AS w FROM b WHERE source <> target AND target IN (SELECT h FROM s) GROUP BY ALL)
SELECT source, target, round((w / (SELECT max(w) FROM k))::DOUBLE, 6) AS weight FROM k"""

ENTITY_ANSWERS_SQL = rf"""WITH {ISSUE_GRAPH_CTE},
m AS (SELECT DISTINCT a.ingest_id, CASE WHEN 'issue:' || c IN (SELECT id FROM nodes) THEN 'issue:' || c ELSE 'epic:' || c END AS node FROM (SELECT ingest_id, unnest(regexp_extract_all(w, '\b([A-Z][A-Z0-9]+-\d+)\b', 1)) AS c FROM asked) a),
k2 AS (SELECT m.* FROM m JOIN nodes ON id = node),
nb AS (SELECT source AS node, target AS other, type FROM edges UNION ALL SELECT target, source, type FROM edges), nl AS (SELECT nb.*, coalesce(n.label, nb.other) AS l, n.label FROM nb LEFT JOIN nodes n ON n.id = nb.other),
li AS (SELECT ingest_id, node, type, list_slice(list_sort(list_distinct(list(l))), 1, 20) AS l FROM k2 JOIN nl USING (node) GROUP BY ALL),
an AS (SELECT ingest_id, string_agg(t, '; ' ORDER BY t) AS answer FROM (SELECT ingest_id, node || ' ' || type || ': ' || array_to_string(l, ', ') AS t FROM li) GROUP BY 1),
te AS (SELECT ingest_id, label, min((node, other)) AS o FROM k2 JOIN nl USING (node) WHERE coalesce(label, '') <> '' GROUP BY ALL), tk AS (SELECT *, row_number() OVER (PARTITION BY ingest_id ORDER BY o, label) AS n FROM te),
tt AS (SELECT ingest_id, string_agg(label, '; ' ORDER BY n) AS terms FROM tk WHERE n <= 5 GROUP BY 1)
SELECT ingest_id AS text_id, count(*) AS mentions, any_value(answer) AS answer, any_value(terms) AS terms FROM k2 LEFT JOIN an USING (ingest_id) LEFT JOIN tt USING (ingest_id) GROUP BY 1"""

STAR_EDGES_SQL = f"""WITH {cq.STAR_CTE}, nb AS (SELECT source AS id, target AS other, type, 'outgoing' AS direction FROM edges UNION ALL SELECT target, source, type, 'incoming' FROM edges)
SELECT nb.id, direction, row_number() OVER (PARTITION BY nb.id, direction ORDER BY nb.type, other) AS position, nb.type, other, n.label FROM nb JOIN nodes n ON n.id = other"""
REGION_TREES_SQL = f"""WITH {cq.STAR_CTE}, t AS (SELECT id AS root, [id] AS path, '- ' || label AS l FROM nodes WHERE type = 'Region' UNION ALL SELECT e.target, [e.target, e.source], '  - ' || n.label FROM edges e JOIN nodes n ON n.id = e.source WHERE e.type = 'in_region'
  UNION ALL SELECT r.target, [r.target, r.source, e.source], '    - ' || n.label FROM edges e JOIN edges r ON r.source = e.target AND r.type = 'in_region' JOIN nodes n ON n.id = e.source WHERE e.type = 'in_nation')
SELECT root, string_agg(l, chr(10) ORDER BY path) AS markdown FROM t GROUP BY root"""
LABELLED_TAGS_SQL = f"WITH {cq.TAGGED_CTE} SELECT DISTINCT doc_id, tag FROM tagged WHERE tag IN (SELECT unnest(labels) FROM jira_issues)"
VECTOR_CTE = """vu AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL), vn AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM vu),
vp AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS similarity FROM vn a JOIN vn b ON a.vec_id < b.vec_id), th AS (SELECT round(quantile_cont(similarity, 0.75), 6) AS t FROM vp)"""
VECTOR_THRESHOLD_SQL = f"WITH {VECTOR_CTE} SELECT t AS threshold FROM th"
VECTOR_PAIRS_SQL = f"WITH {VECTOR_CTE} SELECT a, b, similarity FROM vp, th WHERE similarity >= t"
VECTOR_EDGES_SQL = f"""WITH {VECTOR_CTE}, s AS (SELECT * FROM vp UNION ALL SELECT b, a, similarity FROM vp), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS n FROM s) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, similarity FROM r WHERE n <= 3 AND similarity >= -1"""
VECTOR_LINKS_SQL = f"""WITH {VECTOR_CTE}, l AS (SELECT vec_id, count(*) AS n FROM (SELECT unnest([a, b]) AS vec_id FROM vp, th WHERE similarity >= t) GROUP BY 1) SELECT e.vec_id, min(e.label) AS label, coalesce(any_value(l.n), 0) AS links FROM embeddings e LEFT JOIN l USING (vec_id) WHERE embedding IS NOT NULL GROUP BY 1"""

# Retrieval -----------------------------------------------------------------------------------------------------------------

COMPONENT_COMPARISON_SQL = f"""WITH t AS ({TITLE_BOOST_SQL}), p AS (WITH {BM25_CTE} SELECT query_id, doc_id, rank FROM bm25 WHERE rank < {K}), legs AS (SELECT 'bm25' AS component, query_id, doc_id, rank FROM p UNION ALL SELECT 'bm25+title', query_id, doc_id, rank FROM t),
k AS (SELECT c.component, l.rank FROM documents q CROSS JOIN (VALUES ('bm25'), ('bm25+title')) c(component) LEFT JOIN (SELECT * FROM legs WHERE query_id = doc_id) l ON l.query_id = q.doc_id AND l.component = c.component WHERE q.doc_id % 50 = 0 AND q.title IS NOT NULL),
m AS (SELECT component, count(*) AS n, round(avg(CASE WHEN rank < 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0 / (rank + 1), 0)), 6) AS mrr FROM k GROUP BY component)
SELECT component, n, recall_5, mrr, round(recall_5 - (SELECT recall_5 FROM m WHERE component = 'bm25'), 6) AS recall_lift, round(mrr - (SELECT mrr FROM m WHERE component = 'bm25'), 6) AS mrr_lift FROM m"""

_WORD = r"'[\p{L}\p{N}_]+'"
_EN = "['the','a','an','of','and','is','are','was','what','how','which','when','where','who','does','do','with','from']"
_NO = "['og','er','det','som','en','et','av','på','til','med','hva','hvem','hvor','hvordan','når','ikke']"
PIPELINE_CTE = f"""{BM25_CTE},
ql AS (SELECT doc_id AS query_id, title AS query, regexp_extract_all(lower(title), {_WORD}) AS w FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
qw AS (SELECT *, NOT (len(w) >= 3 AND len(list_intersect(list_distinct(w), {_EN})) > len(list_intersect(list_distinct(w), {_NO}))) AS reranked FROM ql),
fd AS (SELECT b.query_id, b.doc_id, -b.score AS score, q.reranked, q.query FROM bm25 b JOIN qw q USING (query_id) WHERE b.rank < 36),
sc AS (SELECT f.query_id, f.doc_id, f.reranked, f.query, CASE WHEN f.reranked THEN round(0.5 - coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(f.query), {WORDS})), regexp_extract_all(lower(d.text), {WORDS}))) / nullif(len(list_distinct(regexp_extract_all(lower(f.query), {WORDS}))), 0), 0), 6) ELSE f.score END AS score FROM fd f JOIN documents d USING (doc_id)),
tp AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) <= 12),
bo AS (SELECT tp.*, len(list_intersect(list_distinct(regexp_extract_all(lower(tp.query), {_WORD})), list_distinct(regexp_extract_all(lower(translate(coalesce(d.title, ''), '-_', '  ')), {_WORD})))) AS overlap, len(regexp_extract_all(lower(tp.query), {_WORD})) AS qn,
  max(score) OVER w - min(score) OVER w AS spread, min(score) OVER w AS first, count(*) OVER w AS n FROM tp JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY query_id)),
bs AS (SELECT query_id, doc_id, reranked, round(score + CASE WHEN n >= 2 AND qn >= 1 THEN greatest(-0.5 * st * overlap, -1.5 * st) ELSE 0 END, 7) AS score FROM (SELECT *, CASE WHEN spread < 1e-6 THEN greatest(abs(first) * 0.1, 0.01) ELSE spread END AS st FROM bo)),
rk AS (SELECT b.*, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) - 1 AS rank, coalesce(d.url, '') AS url, CASE WHEN coalesce(d.text, '') <> '' THEN md5(d.text) ELSE '' END AS hash FROM bs b JOIN documents d USING (doc_id)),
fo AS (SELECT query_id, rank, doc_id, true AS kept, CASE WHEN url <> '' THEN [url] ELSE []::VARCHAR[] END AS urls, CASE WHEN hash <> '' THEN [hash] ELSE []::VARCHAR[] END AS hashes FROM rk WHERE rank = 0
  UNION ALL SELECT r.query_id, r.rank, r.doc_id, NOT ((r.url <> '' AND list_contains(f.urls, r.url)) OR (r.hash <> '' AND list_contains(f.hashes, r.hash))),
    CASE WHEN r.url <> '' AND NOT (list_contains(f.urls, r.url) OR (r.hash <> '' AND list_contains(f.hashes, r.hash))) THEN list_append(f.urls, r.url) ELSE f.urls END,
    CASE WHEN r.hash <> '' AND NOT ((r.url <> '' AND list_contains(f.urls, r.url)) OR list_contains(f.hashes, r.hash)) THEN list_append(f.hashes, r.hash) ELSE f.hashes END FROM fo f JOIN rk r ON r.query_id = f.query_id AND r.rank = f.rank + 1),
kp AS (SELECT rk.* FROM rk JOIN fo USING (query_id, doc_id) WHERE fo.kept QUALIFY row_number() OVER (PARTITION BY rk.query_id ORDER BY rk.score, rk.doc_id) <= 5),
sh AS (SELECT k.query_id, coalesce(d.source, 'none') AS collection, k.doc_id, d.title, d.url, k.reranked, k.score, row_number() OVER (PARTITION BY k.query_id ORDER BY k.score, coalesce(d.source, 'none'), k.doc_id) - 1 AS position FROM kp k JOIN documents d USING (doc_id) WHERE NOT k.reranked OR k.score <= -0.10),
re AS (SELECT *, round(CASE WHEN reranked THEN 1 / (1 + exp((score + 0.15) * 8)) ELSE 0.75 / (1 + 0.12 * position) END, 6) AS relevance FROM sh),
res AS (SELECT query_id, position, collection, doc_id, title, url, relevance, CASE WHEN reranked THEN CASE WHEN relevance >= 0.65 THEN 'high' WHEN relevance >= 0.40 THEN 'medium' ELSE 'low' END WHEN relevance >= 0.5 THEN 'medium' ELSE 'low' END AS band, reranked FROM re)"""
SEARCH_PIPELINE_SQL = f"WITH RECURSIVE {PIPELINE_CTE} SELECT * FROM res"
RENDERED_RESULTS_SQL = f"""WITH RECURSIVE {PIPELINE_CTE} SELECT query_id, string_agg(concat_ws(chr(10), '### ' || (position + 1) || '. ' || coalesce(nullif(title, ''), doc_id::VARCHAR) || ' (' || round_even(relevance * 100, 0)::INT || '%, ' || band || ')', nullif(url, '')), chr(10) || chr(10) ORDER BY position) AS markdown FROM res GROUP BY 1"""

_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(tx.STOPWORDS)) + "]"
_SIGNS = "[.,!?;:\"''()]+"
_SCORED = BM25_CTE.split("scored AS")[1].split("bm25 AS")[0].replace("FROM asked a", "FROM asked2 a")
CORRECTIVE_VERDICTS_SQL = rf"""WITH {BM25_CTE},
q AS (SELECT doc_id AS query_id, title, trim(title) AS s, lower(trim(title)) AS low, string_split_regex(trim(title), '\s+') AS ws FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
w AS (SELECT *, list_transform(ws, lambda x: regexp_replace(lower(x), '^{_SIGNS}|{_SIGNS}$', '', 'g')) AS pl, regexp_replace(s, '\s*\([^)]*\)\s*$', '') AS bare, trim(replace(s, '"', '')) AS plain FROM q),
l AS (SELECT *, list_max(list_filter(range(1, len(ws) + 1), lambda i: pl[i] <> '' AND NOT list_contains({_STOP}, pl[i]))) AS last FROM w),
r AS (SELECT *, list_concat(ws[1:last - 1], ws[last + 1:]) AS rest, list_concat(pl[1:last - 1], pl[last + 1:]) AS rpl FROM l),
t AS (SELECT *, array_to_string(rest[1:coalesce(list_max(list_filter(range(1, len(rpl) + 1), lambda i: NOT list_contains({_STOP}, rpl[i]))), 0)], ' ') AS dropped FROM r),
c AS (SELECT *, CASE {' '.join(f"WHEN instr(low, '{x}') > 1 THEN trim(substr(s, 1, instr(low, '{x}') - 1))" for x in tx.CONJUNCTIONS)} WHEN bare <> s AND trim(bare) <> '' THEN trim(bare) WHEN contains(s, '"') AND plain <> '' THEN plain WHEN len(ws) > 2 AND last IS NOT NULL THEN dropped END AS cand FROM t),
h AS (SELECT query_id, CASE WHEN len(string_split_regex(cand, '\s+')) > 1 THEN cand END AS hint FROM c),
one AS (SELECT b.query_id, b.doc_id, round(1 / (1 + exp((0.5 - b.score / (b.score + 8) + 0.15) * 8)), 6) AS rel FROM bm25 b WHERE b.rank < 5),
sig AS (SELECT h.*, coalesce((SELECT max(rel) FROM one WHERE one.query_id = h.query_id), 0) < 0.45 AS weak FROM h), again AS (SELECT * FROM sig WHERE weak AND hint IS NOT NULL),
asked2 AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(hint), {WORDS})) AS term FROM again) GROUP BY ALL),
scored2 AS {_SCORED}
two AS (SELECT query_id, doc_id, round(1 / (1 + exp((0.5 - score / (score + 8) + 0.15) * 8)), 6) AS rel FROM scored2 WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5),
both_ AS (SELECT *, false AS rescued FROM one UNION ALL SELECT *, true FROM two), uni AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rescued DESC) = 1),
res AS (SELECT u.* FROM uni u JOIN documents d USING (doc_id) QUALIFY row_number() OVER (PARTITION BY u.query_id ORDER BY u.rel DESC, coalesce(d.source, 'none'), u.doc_id) <= 5),
g AS (SELECT query_id, count(*) AS results, sum(rescued::INT) AS rescued, max(rel) AS best FROM res GROUP BY 1)
SELECT s.query_id, CASE WHEN a.query_id IS NOT NULL THEN CASE WHEN coalesce(g.best, 0) < 0.45 THEN 'still_weak' ELSE 'rescued' END WHEN s.weak THEN 'weak_no_hint' ELSE 'confident' END AS verdict, g.results, g.rescued FROM sig s LEFT JOIN again a USING (query_id) LEFT JOIN g ON g.query_id = s.query_id"""

# Texts ---------------------------------------------------------------------------------------------------------------------

_MARK = r"'^\s*[\[(]?(\d{1,2}:\d{2}(?::\d{2})?)[\])]?\s*'"
TRANSCRIPT_DOCUMENTS_SQL = rf"""WITH l AS (SELECT ingest_id, unnest(string_split(transcript, chr(10))) AS r, unnest(range(len(string_split(transcript, chr(10))))) AS pos FROM youtube_videos WHERE transcript IS NOT NULL), m AS (SELECT *, regexp_extract(r, {_MARK}, 1) AS c FROM l WHERE trim(r) <> ''),
s AS (SELECT ingest_id, pos, trim(regexp_replace(r, {_MARK}, '')) AS line, CASE WHEN c <> '' THEN CASE WHEN len(string_split(c, ':')) = 2 THEN string_split(c, ':')[1]::INT * 60 + string_split(c, ':')[2]::INT ELSE string_split(c, ':')[1]::INT * 3600 + string_split(c, ':')[2]::INT * 60 + string_split(c, ':')[3]::INT END END AS t FROM m),
ch AS (SELECT *, CASE WHEN t IS NOT NULL THEN 'Minute ' || (t // 600 * 10) END AS chapter FROM s), g AS (SELECT *, sum(CASE WHEN pos = mn OR chapter IS DISTINCT FROM pc THEN 1 ELSE 0 END) OVER (PARTITION BY ingest_id ORDER BY pos) AS part FROM (SELECT *, lag(chapter) OVER (PARTITION BY ingest_id ORDER BY pos) AS pc, min(pos) OVER (PARTITION BY ingest_id) AS mn FROM ch)),
p AS (SELECT ingest_id, part, coalesce('## ' || any_value(chapter) || chr(10) || chr(10), '') || string_agg(line, ' ' ORDER BY pos) AS t FROM g GROUP BY ALL)
SELECT ingest_id, string_agg(t, chr(10) || chr(10) ORDER BY part) AS markdown FROM p GROUP BY 1"""

REDACTED_COMMENTS_SQL = rf"""WITH c AS (SELECT ingest_id, body, regexp_replace(body, '(?i)((?:passord|password)\s*(?:er|is|:)\s*)\S+', '\1<redacted-password>', 'g') AS t FROM jira_comments WHERE body IS NOT NULL),
i AS (SELECT *, list_filter(list_transform(regexp_extract_all(' ' || t || ' ', '[^/#\w]\d{{11}}\b'), lambda y: right(y, 11)), lambda x: (substr(x, 1, 2)::INT BETWEEN 1 AND 31 OR substr(x, 1, 2)::INT BETWEEN 41 AND 71) AND substr(x, 3, 2)::INT BETWEEN 1 AND 12 AND {cq._ID_CHECK}) AS ids FROM c),
d AS (SELECT ingest_id, body, list_reduce(list_prepend(t, ids), lambda a, v: replace(a, v, substr(v, 1, 6) || '*****')) AS t FROM i),
e AS (SELECT *, list_filter(regexp_extract_all(t, '\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}\b'), lambda x: NOT regexp_matches(x, '\.(?:xsl|xml|xsd|json|ya?ml|css|js|ts|java|kt|py|md|txt|html?|log)$') AND lower(string_split(x, '@')[2]) NOT IN ('example.com', 'example.org', 'test.com')) AS es FROM d),
f AS (SELECT ingest_id, body, list_reduce(list_prepend(t, es), lambda a, v: replace(a, v, '<redacted-email>')) AS redacted FROM e)
SELECT ingest_id, redacted FROM f WHERE body <> redacted"""


QUERIES = {"run_folds": run_folds, "job_states": job_states}
SQL = {
    "run_folds": RUN_FOLDS_SQL, "job_states": JOB_STATES_SQL, "last_runs": LAST_RUNS_SQL, "median_by_variant": MEDIAN_BY_VARIANT_SQL, "entity_contexts": ENTITY_CONTEXTS_SQL, "augmented_queries": AUGMENTED_QUERIES_SQL, "author_graph": AUTHOR_GRAPH_SQL,
    "component_comparison": COMPONENT_COMPARISON_SQL, "search_pipeline": SEARCH_PIPELINE_SQL, "rendered_results": RENDERED_RESULTS_SQL, "transcript_documents": TRANSCRIPT_DOCUMENTS_SQL, "redacted_comments": REDACTED_COMMENTS_SQL, "corrective_verdicts": CORRECTIVE_VERDICTS_SQL,
    "entity_answers": ENTITY_ANSWERS_SQL, "star_edges": STAR_EDGES_SQL, "region_trees": REGION_TREES_SQL, "labelled_tags": LABELLED_TAGS_SQL, "vector_threshold": VECTOR_THRESHOLD_SQL, "vector_pairs": VECTOR_PAIRS_SQL, "vector_edges": VECTOR_EDGES_SQL, "vector_links": VECTOR_LINKS_SQL,
}
