"""Queries of cleaning, maintenance, conversion, ledgers and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import cleanup, convert, graph, ledger, maintenance, quality
from marlstone.plans import staged, table

# Cleaning ----------------------------------------------------------------------------------------------------------------


def body_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "jira_issues")
    return j.select("ingest_id", cleanup.classify_body(F.col("description"), 300, cleanup.LINE_NOISE["confluence"], 40).alias("reason"))


BODY_CLASSIFIER_SQL = r"""WITH l AS (SELECT ingest_id, coalesce(description, '') AS t, list_filter(list_transform(string_split_regex(trim(coalesce(description, ''), E' \t\n\r'), '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM jira_issues),
k AS (SELECT ingest_id, t, list_filter(ls, lambda x: NOT (regexp_matches(x, '^#{1,6}\s+(?:Aktivitet|Bidragsytere|Spaceeier)\s*$') OR regexp_matches(x, '^https?://\S+$') OR regexp_matches(x, '^\[.+\]\(https?://\S+\)$') OR regexp_matches(x, '^Sjekk .*:.*https?://') OR regexp_matches(x, '^\*\*Spaceeier:\*\*\s*$'))) AS ls FROM l),
m AS (SELECT *, array_to_string(ls, ' ') AS r FROM k)
SELECT ingest_id, CASE WHEN regexp_replace(t, '\s', '', 'g') = '' THEN 'empty_stub' WHEN len(ls) = 0 THEN 'reference_only' WHEN length(r) < 300 THEN 'minimal_content' WHEN len(string_split_regex(r, '\s+')) < 40 THEN 'low_word_count' END AS reason FROM m"""


def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several tests excludes an issue first."""
    j = table(spark, sf_dir, "jira_issues")
    r = cleanup.first_reason(("no_title", F.coalesce("title", F.lit("")) == ""), ("closed", F.lower("status") == "closed"), ("label", F.arrays_overlap("labels", F.array(F.lit("cron"), F.lit("batch")))), ("short", F.length("description") < 400))
    return j.select("ingest_id", r.alias("reason"))


EXCLUSION_REASONS_SQL = "SELECT ingest_id, CASE WHEN coalesce(title, '') = '' THEN 'no_title' WHEN lower(status) = 'closed' THEN 'closed' WHEN list_has_any(labels, ['cron', 'batch']) THEN 'label' WHEN length(description) < 400 THEN 'short' END AS reason FROM jira_issues"


def noise_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("url", F.lit("")).alias("path"), F.coalesce("title", F.lit("")).alias("title"))
    patterns = spark.createDataFrame([(1, "glob", "https://jira.*/d/*7", "noise_path"), (2, "text", "flaky", "noise_title"), (3, "glob", "*FORMS*", "noise_forms")], "pattern_no int, kind string, pattern string, reason string")
    return cleanup.match_noise(docs, patterns)


NOISE_PATTERNS_SQL = """SELECT doc_id, CASE WHEN regexp_full_match(lower(coalesce(url, '')), 'https://jira\\..*/d/.*7') THEN 'noise_path' WHEN contains(lower(coalesce(title, '')), 'flaky') THEN 'noise_title' ELSE 'noise_forms' END AS reason
FROM documents WHERE regexp_full_match(lower(coalesce(url, '')), 'https://jira\\..*/d/.*7') OR contains(lower(coalesce(title, '')), 'flaky') OR contains(lower(coalesce(url, '')), 'forms')"""


def _latest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.latest_deliveries(table(spark, sf_dir, "jira_issues").select("ingest_id", "issue_key", "title", "status", "epic_link", "description", "received_at"), "issue_key")


def latest_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest_issues(spark, sf_dir).select("ingest_id", "issue_key", "title")


LATEST_CTE = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issue_key ORDER BY received_at DESC, ingest_id DESC) AS n FROM jira_issues) WHERE n = 1 OR issue_key IS NULL)"
LATEST_SQL = f"WITH {LATEST_CTE} SELECT ingest_id, issue_key, title FROM latest"


def rescued_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed issues that are the epic of an issue that isn't closed."""
    i = _latest_issues(spark, sf_dir).select(F.col("issue_key").alias("key"), F.col("epic_link").alias("parent"), F.coalesce(F.lower("status"), F.lit("")).alias("status"))
    return cleanup.keep_parents(i.filter("status = 'closed'"), i.filter("status <> 'closed'"))[1].select("key", "parent")


RESCUED_SQL = f"WITH {LATEST_CTE} SELECT issue_key AS key, epic_link AS parent FROM latest WHERE lower(coalesce(status, '')) = 'closed' AND issue_key IN (SELECT epic_link FROM latest WHERE lower(coalesce(status, '')) <> 'closed' AND epic_link IS NOT NULL)"


def recovered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents excluded before (their first line short, or a noise title), and how many are longer than 300 characters now."""
    d = table(spark, sf_dir, "documents")
    was = d.withColumn("reason", F.when(F.lower("title").contains("flaky"), "noise_title").when(F.col("n_chars") < 200, "minimal_content").when(F.year("modified_time") < 2024, "too_old")).filter("reason is not null").select(F.col("doc_id").alias("id"), "reason")
    return cleanup.recovered_report(was, d.filter("n_chars > 300").select(F.col("doc_id").alias("id")))


RECOVERED_SQL = """WITH w AS (SELECT doc_id, n_chars, CASE WHEN contains(lower(title), 'flaky') THEN 'noise' WHEN n_chars < 200 THEN 'content' WHEN year(modified_time) < 2024 THEN 'age' END AS bucket FROM documents)
SELECT bucket, count(*) AS excluded, count(CASE WHEN n_chars > 300 THEN 1 END) AS recovered FROM w WHERE bucket IS NOT NULL GROUP BY bucket"""


def sanitized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cleanup.sanitize_lines(F.col("text"))).alias("n_chars"), cleanup.is_work_in_progress(F.col("title"), F.col("text")).alias("wip"))


SANITIZED_SQL = r"""WITH l AS (SELECT doc_id, title, text, string_split(coalesce(text, ''), E'\n') AS ls FROM documents)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN length(array_to_string(list_filter(ls, lambda x: NOT (contains(x, '@@') OR regexp_matches(x, '(?i)^\s*\S+\s+(?:følger opp|tar det videre|sjekker|undersøker)\b'))), E'\n')) END AS n_chars,
regexp_matches(coalesce(title, ''), '(?i)(?:- )?under arbeid|utkast|\bWIP\b') OR len(list_filter(ls, lambda x: regexp_matches(x, '(?i)^#{1,6}\s+(?:UNDER ARBEID|WIP)\b') OR regexp_matches(x, '(?i)^(?:Under arbeid|WIP)\s*$'))) > 0 AS wip FROM l"""


def email_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses per comment that the plain sanitiser finds."""
    c = table(spark, sf_dir, "jira_comments").select("ingest_id", tx.email_addresses(F.col("body")).alias("e")).filter("size(e) > 0")
    return c.select("ingest_id", F.size("e").alias("n"))


EMAIL_COUNTS_SQL = r"""WITH e AS (SELECT ingest_id, list_filter(regexp_extract_all(body, '\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b'), lambda x: NOT regexp_matches(x, '\.(?:xsl|xml|xsd|json|ya?ml|css|js|ts|java|kt|py|md|txt|html?|log)$')
  AND lower(string_split(x, '@')[2]) NOT IN ('example.com', 'example.org', 'test.com')) AS l FROM jira_comments WHERE body IS NOT NULL)
SELECT ingest_id, len(l) AS n FROM e WHERE len(l) > 0"""


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.pii_counts(table(spark, sf_dir, "jira_comments"), "ingest_id", "body")


_ID_CHECK = " AND ".join("(" + " + ".join(f"substr(x, {i + 1}, 1)::INT * {w}" for i, w in enumerate(ws)) + ") % 11 = 0" for ws in ([3, 7, 6, 1, 8, 9, 4, 5, 2, 1], [5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1]))
PII_COUNTS_SQL = rf"""WITH ids AS (SELECT ingest_id, unnest(list_transform(regexp_extract_all(' ' || body || ' ', '[^/#\w]\d{{11}}\b'), lambda x: right(x, 11))) AS x FROM jira_comments),
i AS (SELECT * FROM ids WHERE (substr(x, 1, 2)::INT BETWEEN 1 AND 31 OR substr(x, 1, 2)::INT BETWEEN 41 AND 71) AND substr(x, 3, 2)::INT BETWEEN 1 AND 12 AND {_ID_CHECK}),
e AS ({EMAIL_COUNTS_SQL})
SELECT 'national_id' AS category, count(DISTINCT ingest_id) AS documents, count(*) AS findings FROM i HAVING count(*) > 0 UNION ALL SELECT 'email', count(*), sum(n)::BIGINT FROM e HAVING count(*) > 0"""


def redacted_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments in which the plain sanitiser replaced something."""
    c = table(spark, sf_dir, "jira_comments").select("ingest_id", "body", cleanup.redact(F.col("body")).alias("redacted"))
    return c.filter("body <> redacted").select("ingest_id", "redacted")


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents of one body: hash, the least id, and their number."""
    d = table(spark, sf_dir, "documents").filter("text is not null and text <> ''").select("doc_id", tx.md5_body(F.col("text")).alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


EXACT_COPIES_SQL = "SELECT md5(text) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1 HAVING count(*) > 1"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce("source", F.lit("none")).alias("collection"), F.explode(tx.parse_tags(F.col("metadata")["tags"])).alias("tag"))


TAGGED_CTE = "tagged AS (SELECT * FROM (SELECT doc_id, coalesce(source, 'none') AS collection, unnest(list_filter(list_transform(string_split(metadata['tags'], ','), lambda x: trim(x)), lambda x: x <> '')) AS tag FROM documents))"


def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.tag_histogram(_tagged(spark, sf_dir))


TAG_HISTOGRAM_SQL = f"WITH {TAGGED_CTE} SELECT collection, tag, count(*) AS n FROM tagged GROUP BY ALL"


def labelled_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that at least one issue uses as a label."""
    taxonomy = table(spark, sf_dir, "jira_issues").select(F.explode("labels").alias("tag"))
    return cleanup.valid_tags(_tagged(spark, sf_dir), taxonomy).select("doc_id", "tag")


def tag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.tag_coverage(table(spark, sf_dir, "documents").select(F.col("metadata")["tags"].alias("tags")))


TAG_COVERAGE_SQL = f"""WITH {TAGGED_CTE}, n AS (SELECT d.doc_id, count(t.tag) AS n FROM documents d LEFT JOIN tagged t USING (doc_id) GROUP BY ALL)
SELECT count(*) AS documents, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS tagged, round(avg(CASE WHEN n > 0 THEN n END), 6) AS mean_tags, min(CASE WHEN n > 0 THEN n END) AS least_tags, max(CASE WHEN n > 0 THEN n END) AS most_tags, (SELECT count(DISTINCT tag) FROM tagged) AS distinct_tags FROM n"""


def collection_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues as documents and comments as chunks, by project."""
    project = F.split("issue_key", "-")[0].alias("collection")
    return cleanup.collection_overview(table(spark, sf_dir, "jira_issues").filter("issue_key is not null").select(project), table(spark, sf_dir, "jira_comments").filter("issue_key is not null").select(project))


COLLECTION_OVERVIEW_SQL = """WITH c AS (SELECT split_part(issue_key, '-', 1) AS collection, count(*) AS chunks FROM jira_comments GROUP BY 1), d AS (SELECT split_part(issue_key, '-', 1) AS collection, count(*) AS documents FROM jira_issues WHERE issue_key IS NOT NULL GROUP BY 1)
SELECT collection, documents, coalesce(chunks, 0) AS chunks FROM d LEFT JOIN c USING (collection)"""

# Maintenance -------------------------------------------------------------------------------------------------------------


def _current(documents: DataFrame) -> DataFrame:
    """The last delivery of each address, and the documents without one."""
    return cleanup.latest_deliveries(documents.select("doc_id", "url", "modified_time"), "url", "modified_time", "doc_id").select("doc_id")


def _one_chunk(documents: DataFrame) -> DataFrame:
    """An index with every document's whole text as a chunk."""
    return documents.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("chunk"))


def orphan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without those of documents whose address was delivered again later."""
    d = table(spark, sf_dir, "documents")
    return maintenance.orphan_prune(_one_chunk(d), _current(d)).select("chunk_id", "doc_id", F.md5("chunk").alias("md5"))


CURRENT_CTE = "cur AS (SELECT * FROM documents QUALIFY url IS NULL OR row_number() OVER (PARTITION BY url ORDER BY modified_time DESC NULLS LAST, doc_id DESC) = 1)"
ORPHAN_PRUNE_SQL = f"WITH {CURRENT_CTE} SELECT doc_id AS chunk_id, doc_id, md5(text) AS md5 FROM cur"


def upsert_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after an update: documents changed since the mark come in anew, superseded ones go."""
    d = table(spark, sf_dir, "documents")
    current, since = staged(_current(d)), maintenance.high_water_mark(d).select("read_from")
    changed = d.join(F.broadcast(since), F.col("modified_time") >= F.col("read_from")).join(current, "doc_id", "left_semi")  # one row
    last_id = d.agg(F.max("doc_id")).first()[0] or 0
    new = maintenance.upsert_chunks(_one_chunk(d), changed.select("doc_id", F.col("text").alias("chunk")), last_id, ["doc_id"], source_ids=current)
    return new.select("chunk_id", "doc_id", F.md5("chunk").alias("md5"))


UPSERT_SQL = f"""WITH {CURRENT_CTE}, s AS (SELECT max(modified_time) - INTERVAL 1 DAY AS t FROM documents), c AS (SELECT cur.* FROM cur, s WHERE modified_time >= t)
SELECT doc_id AS chunk_id, doc_id, md5(text) AS md5 FROM cur WHERE doc_id NOT IN (SELECT doc_id FROM c) UNION ALL SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY doc_id), doc_id, md5(text) FROM c"""


def _whole_index(documents: DataFrame) -> DataFrame:
    """What an index held: the chunks of every document's whole text, numbered from 1."""
    return maintenance.number_chunks(staged(convert.chunk_documents(documents, "doc_id", "text")), 0, ["doc_id", "chunk_number"])


def pruned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of whole texts without those of documents whose address was delivered again later."""
    d = table(spark, sf_dir, "documents")
    return maintenance.orphan_prune(_whole_index(d), _current(d)).select("chunk_id", "doc_id", "chunk_number")


def upserted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of whole texts after an update: documents changed since the mark come in anew, superseded ones go."""
    d = table(spark, sf_dir, "documents")
    index, current, since = _whole_index(d), staged(_current(d)), maintenance.high_water_mark(d).select("read_from")
    changed = d.join(F.broadcast(since), F.col("modified_time") >= F.col("read_from")).join(current, "doc_id", "left_semi")  # one row
    chunks = staged(convert.chunk_documents(changed, "doc_id", "text"))
    last_id = index.agg(F.max("chunk_id")).first()[0] or 0
    # a changed document may have no text left: its old chunks go all the same
    kept = index.join(changed.select("doc_id"), "doc_id", "left_anti")
    return maintenance.upsert_chunks(kept, chunks, last_id, ["doc_id", "chunk_number"], source_ids=current).select("chunk_id", "doc_id", "chunk_number", "heading", "chunk")


def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "youtube_videos").select(F.col("video_id").alias("id"), "title", "ingest_id")
    first = v.filter("ingest_id % 2 = 0").groupBy("id").agg(F.min("title").alias("title")).filter("id is not null")
    new = v.filter("ingest_id % 2 = 1 and id is not null").groupBy("id").agg(F.min("title").alias("title")).unionByName(v.filter("ingest_id % 2 = 1 and id is null").select("id", "title"))
    return maintenance.merge_manifest(first, new)


MANIFEST_MERGE_SQL = """WITH o AS (SELECT video_id AS id, min(title) AS title FROM youtube_videos WHERE ingest_id % 2 = 0 AND video_id IS NOT NULL GROUP BY 1), n AS (SELECT video_id AS id, min(title) AS title FROM youtube_videos WHERE ingest_id % 2 = 1 AND video_id IS NOT NULL GROUP BY 1)
SELECT * FROM o UNION ALL SELECT * FROM n WHERE id <> '' AND id NOT IN (SELECT id FROM o) UNION ALL SELECT * FROM n WHERE id = '' UNION ALL SELECT video_id, title FROM youtube_videos WHERE ingest_id % 2 = 1 AND video_id IS NULL"""


def _plain_times(df: DataFrame) -> DataFrame:
    """Timestamps as text, which compares the same everywhere."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes])


def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(maintenance.high_water_mark(table(spark, sf_dir, "documents")))


HIGH_WATER_SQL = "SELECT strftime(max(modified_time), '%Y-%m-%d %H:%M:%S.%f') AS last_modified, strftime(max(modified_time) - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S.%f') AS read_from FROM documents"


def reread_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "notion_blocks").groupBy(F.col("page_id").alias("id")).agg(F.max("received_at").alias("time"))
    x = table(spark, sf_dir, "notion_blocks").filter("block_type = 'divider'").groupBy(F.col("page_id").alias("id")).agg(F.max("received_at").alias("excluded_time"))
    return _plain_times(maintenance.reread_excluded(b, x))


REREAD_SQL = """WITH b AS (SELECT page_id AS id, max(received_at) AS time FROM notion_blocks GROUP BY 1), x AS (SELECT page_id AS id, max(received_at) AS e FROM notion_blocks WHERE block_type = 'divider' GROUP BY 1)
SELECT id, strftime(time, '%Y-%m-%d %H:%M:%S.%f') AS time FROM b LEFT JOIN x USING (id) WHERE e IS NULL OR time > e OR time IS NULL"""


def prefix_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles").select(F.col("ingest_id").alias("doc_id"), F.col("summary").alias("chunk"), "title")
    cache = a.filter("doc_id % 2 = 0").select("doc_id", tx.chunk_fingerprint(F.col("doc_id").cast("string"), F.col("chunk")).alias("chunk_hash"), F.lit("echo").alias("model"), convert.echo_prefix(F.col("title"), F.col("chunk")).alias("prefix"))
    hit, _ = maintenance.cached_prefixes(a.withColumn("doc_id", F.col("doc_id").cast("string")), cache.withColumn("doc_id", F.col("doc_id").cast("string")), "echo")
    return hit.select(F.col("doc_id").cast("long").alias("doc_id"), "indexed_text")


PREFIX_CACHE_SQL = r"""SELECT ingest_id AS doc_id, CASE WHEN length(summary) >= 80 AND ingest_id % 2 = 0 THEN 'Context: ' || coalesce(title, 'untitled') || ' (' || length(summary) || E' characters).\n\n' || summary ELSE summary END AS indexed_text FROM articles"""


def article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of every article by its category and whole title, in the order of delivery."""
    a = table(spark, sf_dir, "articles").orderBy("ingest_id").select(F.coalesce(F.lower("category"), F.lit("none")).alias("category"), F.coalesce("title", F.lit("untitled")).alias("title"), "url")
    return maintenance.write_categorized(a, a.limit(0).withColumn("file_name", F.lit("")))


ARTICLE_FILES_SQL = """WITH a AS (SELECT ingest_id, coalesce(lower(category), 'none') AS category, coalesce(title, 'untitled') AS title, url, CASE WHEN coalesce(url, '') = '' THEN '#' || ingest_id ELSE url END AS k FROM articles),
f AS (SELECT category, title, k, min(ingest_id) AS i FROM a GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY category, title ORDER BY i) AS n FROM f)
SELECT a.category, a.title, a.url, a.category || '/' || a.title || CASE WHEN n > 1 THEN ' (' || least(n, 99) || ')' ELSE '' END || '.md' AS file_name, n > 99 AS replaces FROM a JOIN o USING (category, title, k)"""


# Conversion --------------------------------------------------------------------------------------------------------------


def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("url is not null")
    path = F.regexp_replace(F.concat_ws("/", F.regexp_replace("url", "^https://", ""), F.col("space_key"), F.coalesce("title", F.lit("x"))), "//+", "/")
    return d.select("doc_id", convert.breadcrumb(path).alias("breadcrumb"), tx.title_from_path(F.concat(path, F.lit(".json"))).alias("title"))


BREADCRUMBS_SQL = r"""WITH p AS (SELECT doc_id, regexp_replace(concat_ws('/', regexp_replace(url, '^https://', ''), space_key, coalesce(title, 'x')), '//+', '/', 'g') AS p FROM documents WHERE url IS NOT NULL),
s AS (SELECT doc_id, p, string_split(regexp_replace(p, '\.[^./]+$', ''), '/') AS a FROM p)
SELECT doc_id, CASE WHEN len(a) > 4 THEN a[1] || ' > ... > ' || a[-2] || ' > ' || a[-1] ELSE array_to_string(a, ' > ') END AS breadcrumb, string_split(p, '/')[-1] AS title FROM s"""


def clean_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jira_issues").filter("description is not null").select("ingest_id", F.md5(convert.clean_body(F.col("description"))).alias("clean_md5"))


CLEAN_BODIES_SQL = r"""SELECT ingest_id, md5(regexp_replace(regexp_replace(regexp_replace(description, '(?s)```.*?```', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), 'https?://\S*(?:amazonaws\.com|\.s3\.)\S*', '[file]', 'g')) AS clean_md5 FROM jira_issues WHERE description IS NOT NULL"""


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "x_articles").filter("summary is not null").select("ingest_id", tx.snippet(F.col("summary")).alias("snippet"), F.md5(F.array_join(tx.bm25_tokens(F.col("summary")), " ")).alias("words_md5"))


SNIPPETS_SQL = r"""WITH t AS (SELECT ingest_id, trim(summary) AS t, summary FROM x_articles WHERE summary IS NOT NULL),
p AS (SELECT *, regexp_extract(substr(t, 1, 240), '(?s)^(.{160,239}[.!?])\s', 1) AS s, regexp_extract(substr(t, 1, 220), '(?s)^(.*\S)\s', 1) AS b FROM t)
SELECT ingest_id, CASE WHEN length(t) <= 200 THEN t WHEN s <> '' THEN s ELSE (CASE WHEN b <> '' THEN b ELSE substr(t, 1, 200) END) || '…' END AS snippet, md5(array_to_string(regexp_extract_all(lower(summary), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*'), ' ')) AS words_md5 FROM p"""


def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def session_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("lower(trim(source)) = 'sessions'")
    return convert.chunk_documents(d, "doc_id", "text", convert.session_chunks)


def indexed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues as they would be indexed."""
    i = _latest_issues(spark, sf_dir).filter("issue_key is not null")
    return i.select("issue_key", F.md5(convert.indexed_text(F.concat_ws(" > ", F.split("issue_key", "-")[0], F.col("issue_key")), F.lit(None).cast("string"), F.col("epic_link"), F.col("title"), F.coalesce("description", F.lit("")))).alias("text_md5"))


INDEXED_TEXTS_SQL = rf"""WITH {LATEST_CTE} SELECT issue_key, md5(concat_ws(E'\n', split_part(issue_key, '-', 1) || ' > ' || issue_key, CASE WHEN coalesce(epic_link, '') <> '' THEN 'epic: ' || epic_link END, CASE WHEN coalesce(title, '') <> '' THEN '## ' || title END, nullif(coalesce(description, ''), ''))) AS text_md5 FROM latest WHERE issue_key IS NOT NULL"""


def issue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with their comments in order, as one text."""
    c = table(spark, sf_dir, "jira_comments").filter("body <> ''").groupBy("issue_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ingest_id", "body"))), lambda x: x["body"]).alias("comments"))
    i = _latest_issues(spark, sf_dir).filter("issue_key is not null").join(c, "issue_key", "left")
    return i.select("issue_key", F.md5(convert.issue_text(F.col("issue_key"), F.col("title"), F.col("description"), F.coalesce("comments", F.array().cast("array<string>")))).alias("text_md5"))


ISSUE_TEXTS_SQL = rf"""WITH {LATEST_CTE}, c AS (SELECT issue_key, string_agg(body, E'\n\n' ORDER BY pos, ingest_id) AS comments FROM jira_comments WHERE body <> '' GROUP BY 1)
SELECT issue_key, md5(concat_ws(E'\n\n', concat_ws(' : ', issue_key, title), nullif(description, ''), coalesce(comments, ''))) AS text_md5 FROM latest LEFT JOIN c USING (issue_key) WHERE issue_key IS NOT NULL"""


def issue_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "jira_issues").select("ingest_id", "issue_key", "title", "status", "priority", "assignee", "description", "received_at")
    new = cleanup.latest_deliveries(j, "issue_key").filter("issue_key is not null")
    old = j.filter("issue_key is not null").groupBy("issue_key").agg(*[F.min(c).alias(c) for c in ("title", "status", "priority", "assignee", "description")])
    return convert.issue_markdown(new, old).select("issue_key", F.md5("markdown").alias("md5"))


ISSUE_MARKDOWN_SQL = rf"""WITH {LATEST_CTE}, o AS (SELECT issue_key, min(title) AS t, min(status) AS s, min(priority) AS p, min(assignee) AS a, min(description) AS d FROM jira_issues GROUP BY 1),
m AS (SELECT l.issue_key, coalesce(nullif(title, ''), t) AS title, coalesce(nullif(status, ''), s) AS status, coalesce(nullif(priority, ''), p) AS priority, coalesce(nullif(assignee, ''), a) AS assignee, coalesce(nullif(description, ''), d) AS description FROM latest l JOIN o USING (issue_key))
SELECT issue_key, md5(E'---\n' || concat_ws(E'\n', 'issue_key: ' || issue_key, 'title: "' || replace(title, '"', '\"') || '"', 'status: "' || replace(status, '"', '\"') || '"', 'priority: "' || replace(priority, '"', '\"') || '"', 'assignee: "' || replace(assignee, '"', '\"') || '"')
  || E'\n---\n\n# ' || issue_key || ': ' || coalesce(title, '') || E'\n\n' || coalesce(description, '')) AS md5 FROM m"""


def notion_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.pages_from_blocks(table(spark, sf_dir, "notion_blocks"))


def transcript_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views read as lines and purchases as chapters of a user's session: each view under the last purchase before it."""
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    lines = e.filter("event_type = 'view'").select(F.col("user_id").alias("video"), F.col("event_id").alias("seconds"), "event_id")
    chapters = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("video"), F.col("event_id").alias("start"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("title"))
    return convert.assign_chapters(lines, chapters, "video").select("video", "event_id", "chapter")


CHAPTERS_SQL = "SELECT l.user_id AS video, l.event_id, 'c' || c.event_id AS chapter FROM (SELECT * FROM events WHERE event_type = 'view' AND user_id IS NOT NULL) l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') c ON l.user_id = c.user_id AND l.event_id >= c.event_id"


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = convert.transcript_lines(table(spark, sf_dir, "youtube_videos"), "ingest_id", "transcript")
    return lines.groupBy("ingest_id").agg(F.count("*").alias("lines"), F.count("seconds").alias("timed"), F.max("seconds").alias("last_s"))


TRANSCRIPT_LINES_SQL = r"""WITH l AS (SELECT ingest_id, unnest(string_split(coalesce(transcript, ''), E'\n')) AS r FROM youtube_videos), m AS (SELECT ingest_id, regexp_extract(r, '^\s*[\[(]?(\d{1,2}:\d{2}(?::\d{2})?)[\])]?\s*', 1) AS c FROM l WHERE trim(r) <> ''),
s AS (SELECT ingest_id, CASE WHEN c <> '' THEN CASE WHEN len(string_split(c, ':')) = 2 THEN string_split(c, ':')[1]::INT * 60 + string_split(c, ':')[2]::INT ELSE string_split(c, ':')[1]::INT * 3600 + string_split(c, ':')[2]::INT * 60 + string_split(c, ':')[3]::INT END END AS s FROM m)
SELECT ingest_id, count(*) AS lines, count(s) AS timed, max(s) AS last_s FROM s GROUP BY 1"""


def video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "youtube_videos").select("ingest_id", F.coalesce("video_id", tx.video_id(F.col("url"))).alias("video_id"), F.array_join(F.coalesce(tx.parse_tags(F.col("category")), F.array().cast("array<string>")), "|").alias("tags"))


VIDEO_IDS_SQL = r"""SELECT ingest_id, coalesce(video_id, nullif(regexp_extract(url, '(?:[?&]v=|youtu\.be/|/embed/|/shorts/)([\w-]{11})', 1), '')) AS video_id, coalesce(array_to_string(list_filter(list_transform(string_split(category, ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS tags FROM youtube_videos"""


def issue_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ["parser", "linter", "branch", "commit", "endpoint", "release"]
    i = _latest_issues(spark, sf_dir).filter("issue_key is not null")
    return convert.issue_queries(i, terms).select("issue_key", F.array_join("queries", "|").alias("queries"))


ISSUE_QUERIES_SQL = rf"""WITH {LATEST_CTE}, w AS (SELECT issue_key, title, epic_link, list_slice(list_sort(list_filter(['parser', 'linter', 'branch', 'commit', 'endpoint', 'release'], lambda x: list_contains(regexp_extract_all(lower(coalesce(description, '')), '\w+(?:-\w+)*'), x))), 1, 4) AS t FROM latest WHERE issue_key IS NOT NULL)
SELECT issue_key, concat_ws('|', nullif(title, ''), nullif(array_to_string(t, ' '), ''), nullif(epic_link, '')) AS queries FROM w"""

# Ledgers -----------------------------------------------------------------------------------------------------------------

NOW = "2026-06-30 00:00:00"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fold_runs(table(spark, sf_dir, "runs_raw"), NOW)


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).withColumn("phases", F.array_join(F.transform("phases", lambda p: F.concat_ws(":", p["name"], p["status"])), ",")).withColumn("unclosed", F.array_join("unclosed", ","))


def run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First start, last end and records of each run."""
    return _runs(spark, sf_dir).select("run", "records", F.unix_timestamp("started").alias("started_s"), F.unix_timestamp("finished").alias("finished_s"), "error")


_TIME = r"CASE WHEN regexp_matches({c}, '(Z|[+-]\d{{2}}:?\d{{2}})$') THEN {c} ELSE {c} || 'Z' END::TIMESTAMPTZ"
RUN_TIMES_SQL = f"""WITH r AS (SELECT coalesce(nullif(runId, ''), 'anonymous-' || seq) AS run, seq, error, {_TIME.format(c='startedAt')} AS s, {_TIME.format(c='finishedAt')} AS f FROM runs_raw)
SELECT run, count(*) AS records, epoch(min(s))::BIGINT AS started_s, epoch(max(f))::BIGINT AS finished_s, string_agg(CASE WHEN error <> '' THEN error END, '; ' ORDER BY seq) AS error FROM r GROUP BY run"""


def phase_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each record by its own phases."""
    return table(spark, sf_dir, "runs_raw").select("seq", ledger.rollup(F.col("phases")).alias("status"))


PHASE_ROLLUP_SQL = """WITH p AS (SELECT seq, phases, list_transform(phases, lambda p: CASE WHEN lower(p.status) IN ('ok', 'success') THEN 'succeeded' ELSE p.status END) AS s, list_filter(phases, lambda p: p.status = 'failed' AND coalesce(p.fatal, false)) AS f FROM runs_raw)
SELECT seq, CASE WHEN coalesce(len(phases), 0) = 0 THEN 'unknown' WHEN len(f) > 0 THEN 'failed' WHEN len(list_filter(s, lambda x: NOT coalesce(x IN ('skipped', 'succeeded'), false))) > 0 THEN 'degraded' WHEN len(list_filter(s, lambda x: x <> 'skipped')) = 0 THEN 'skipped' ELSE 'succeeded' END AS status FROM p"""


def median_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.median_durations(_runs(spark, sf_dir))


def job_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = table(spark, sf_dir, "documents").select(F.lower(F.trim("source")).alias("name")).filter("name is not null").distinct()
    schedules = spark.createDataFrame([("jira", 3600), ("archive", 86400)], "name string, cadence_s int")
    return ledger.job_overview(_runs(spark, sf_dir), loaded, schedules)


# Graphs ------------------------------------------------------------------------------------------------------------------


def _star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The star schema as two graph files: places, and customers and suppliers with their places."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda df, kind, key, label, no, props: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind.title()).alias("type"), F.col(label).alias("label"), props.alias("properties"), F.lit(no).alias("file_no"))
    one = lambda k, v: F.create_map(F.lit(k), v.cast("string"))
    nodes = node(t("region"), "region", "r_regionkey", "r_name", 1, one("a", F.lit("1"))).unionByName(node(t("nation"), "nation", "n_nationkey", "n_name", 1, one("a", F.lit("1")))).unionByName(node(t("nation"), "nation", "n_nationkey", "n_name", 2, one("a", F.lit("2")))).unionByName(
        node(t("customer"), "customer", "c_custkey", "c_name", 2, one("segment", F.col("c_mktsegment")))).unionByName(node(t("supplier"), "supplier", "s_suppkey", "s_name", 2, one("b", F.lit("1"))))
    edge = lambda df, a, ac, b, bc, kind, no: df.select(F.concat(F.lit(f"{a}:"), F.col(ac).cast("string")).alias("source"), F.concat(F.lit(f"{b}:"), F.col(bc).cast("string")).alias("target"), F.lit(kind).alias("type"), one("file", F.lit(no)).alias("properties"), F.lit(no).alias("file_no"))
    edges = edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "in_region", 1).unionByName(edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "in_region", 2)).unionByName(edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "in_nation", 2)).unionByName(edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "in_nation", 2))
    return graph.merge_nodes(nodes), graph.merge_edges(edges)


STAR_CTE = """nodes AS (SELECT 'region:' || r_regionkey AS id, 'Region' AS type, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name FROM supplier),
edges AS (SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'in_region' AS type FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in_nation' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in_nation' FROM supplier)"""


def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star(spark, sf_dir)[0].select("id", "type", "label", F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("properties"))


GRAPH_MERGE_SQL = """SELECT 'region:' || r_regionkey AS id, 'Region' AS type, r_name AS label, 'a=1' AS properties FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, 'a=2' FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name, 'segment=' || c_mktsegment FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, 'b=1' FROM supplier"""


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star(spark, sf_dir)[1].select("source", "target", "type", F.col("properties")["file"].alias("file"))


GRAPH_EDGES_SQL = f"WITH {STAR_CTE} SELECT source, target, type, CASE WHEN type = 'in_region' THEN '1' ELSE '2' END AS file FROM edges"


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_stats(*_star(spark, sf_dir))


GRAPH_STATS_SQL = f"WITH {STAR_CTE} SELECT 'node' AS what, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type"


def graph_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each node by kind of edge and direction."""
    return graph.neighbours(_star(spark, sf_dir)[1]).groupBy("node", "type", "direction").agg(F.count("*").alias("n"))


GRAPH_HOPS_SQL = f"WITH {STAR_CTE} SELECT source AS node, type, 'outgoing' AS direction, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT target, type, 'incoming', count(*) FROM edges GROUP BY ALL"


def graph_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes under each region, two levels deep."""
    nodes, edges = (staged(x) for x in _star(spark, sf_dir))
    return graph.subtree(nodes, edges, nodes.filter("type = 'Region'").select(F.col("id").alias("root")), "incoming", max_nodes=None)[0]


GRAPH_SUBTREE_SQL = f"""WITH RECURSIVE {STAR_CTE}, b AS (SELECT id AS root, id, 0 AS depth FROM nodes WHERE type = 'Region' UNION ALL SELECT b.root, e.source, b.depth + 1 FROM b JOIN edges e ON e.target = b.id WHERE b.depth < 2)
SELECT root, id, min(depth) AS depth FROM b GROUP BY ALL"""


def node_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _star(spark, sf_dir)
    ends = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws("/", e["type"], e["id"], e["label"])), ";")
    return graph.node_detail(nodes, edges).select("id", ends("outgoing").alias("outgoing"), ends("incoming").alias("incoming"))


NODE_DETAILS_SQL = f"""WITH {STAR_CTE}, j AS (SELECT e.source, e.target, e.type, s.label AS sl, t.label AS tl FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target)
SELECT n.id, coalesce((SELECT string_agg(type || '/' || target || '/' || tl, ';' ORDER BY type, target) FROM j WHERE source = n.id), '') AS outgoing, coalesce((SELECT string_agg(type || '/' || source || '/' || sl, ';' ORDER BY type, source) FROM j WHERE target = n.id), '') AS incoming FROM nodes n"""


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of every node of the star graph, of all kinds."""
    return graph.node_edges(*_star(spark, sf_dir))


def _issue_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = _latest_issues(spark, sf_dir).filter("issue_key is not null").select(F.col("issue_key").alias("key"), F.col("title").alias("summary"), F.col("epic_link").alias("epic"), F.lit(None).cast("string").alias("parent"), F.col("description").alias("text"))
    return graph.issue_graph(i)


def issue_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issue_graph(spark, sf_dir)[1].select("source", "target", "type")


ISSUE_EDGES_SQL = rf"""WITH {LATEST_CTE}, k AS (SELECT * FROM latest WHERE issue_key IS NOT NULL), r AS (SELECT issue_key, epic_link, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(description, ''), '\b([A-Z][A-Z0-9]+-\d+)\b', 1), lambda x: upper(x)))) AS ref FROM k)
SELECT 'issue:' || issue_key AS source, 'epic:' || epic_link AS target, 'belongs_to_epic' AS type FROM k WHERE epic_link IS NOT NULL
UNION ALL SELECT 'issue:' || issue_key, 'issue:' || ref, 'refers_to' FROM r WHERE ref <> issue_key AND ref <> coalesce(epic_link, '') AND ref IN (SELECT issue_key FROM k)"""


def epic_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issue_graph(spark, sf_dir)[0].filter("type = 'Epic'").select("id", "label", F.col("properties")["children"].alias("children"))


EPIC_CHILDREN_SQL = f"WITH {LATEST_CTE}, k AS (SELECT * FROM latest WHERE issue_key IS NOT NULL), e AS (SELECT epic_link, count(*) AS n FROM k WHERE epic_link IS NOT NULL GROUP BY 1) SELECT 'epic:' || e.epic_link AS id, coalesce(k.title, e.epic_link) AS label, e.n::VARCHAR AS children FROM e LEFT JOIN k ON k.issue_key = e.epic_link"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems that issue titles name, as entities."""
    names = table(spark, sf_dir, "jira_issues").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(r"\b([a-z]+-[a-z]+\d?)\b"), 1)).alias("label")).distinct()
    return names.select(F.concat(F.lit("entity:"), "label").alias("id"), F.lit("System").alias("type"), "label", F.create_map().cast("map<string,string>").alias("properties"))


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "x_articles").select(F.col("ingest_id").alias("text_id"), F.col("summary").alias("text"))
    return graph.detect_entities(texts, _entities(spark, sf_dir)).select("text_id", "node_id")


ENTITY_MENTIONS_SQL = r"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(title, '')), '\b[a-z]+-[a-z]+\d?\b')) AS label FROM jira_issues),
w AS (SELECT ingest_id, regexp_extract_all(lower(summary), '[\p{L}\p{N}_]+') AS t FROM x_articles WHERE summary IS NOT NULL),
g AS (SELECT DISTINCT ingest_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM w)
SELECT DISTINCT ingest_id AS text_id, 'entity:' || label AS node_id FROM g JOIN n ON gram = replace(label, '-', ' ')"""


def entity_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about the epics and issues that issue titles would raise."""
    nodes, edges = (staged(x) for x in _issue_graph(spark, sf_dir))
    asked = _latest_issues(spark, sf_dir).filter("epic_link is not null").select(F.col("ingest_id").alias("text_id"), F.concat(F.lit("Which issues belong under epic "), "epic_link").alias("text"))
    found = staged(graph.detect_entities(asked, nodes))
    answers = graph.answer_questions(asked, found, nodes, edges)
    terms = graph.expansion_terms(found, nodes, edges)
    return found.groupBy("text_id").agg(F.count("*").alias("mentions")).join(answers, "text_id", "left").join(terms, "text_id", "left").select("text_id", "mentions", "answer", F.array_join("terms", "; ").alias("terms"))


def entity_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_context(*_star(spark, sf_dir))


# Similarity --------------------------------------------------------------------------------------------------------------


def _label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mean_vectors(table(spark, sf_dir, "embeddings"), "label")


LABEL_CTE = """m AS (SELECT label AS doc, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL),
v AS (SELECT doc, i, m / sqrt(sum(m * m) OVER (PARTITION BY doc)) AS x FROM m),
pairs AS (SELECT a.doc AS a, b.doc AS b, round(sum(a.x * b.x), 6) AS similarity FROM v a JOIN v b ON a.i = b.i AND a.doc < b.doc GROUP BY ALL)"""


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label_vectors(spark, sf_dir).select("doc", F.posexplode("vector").alias("i", "x")).select("doc", "i", F.round("x", 6).alias("x"))


DOCUMENT_VECTORS_SQL = f"WITH {LABEL_CTE} SELECT doc, i, round(x, 6) AS x FROM v"


#: Vectors of a block, when all pairs of the single vectors are compared.
VECTOR_BLOCK = 500


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(graph.mean_vectors(table(spark, sf_dir, "embeddings"), "vec_id"))


def _vector_pairs(vectors: DataFrame, threshold: float | None = None, nearest: int | None = None) -> DataFrame:
    return graph.document_similarities(vectors, -(-vectors.count() // VECTOR_BLOCK) or 1, threshold, nearest)


def _vector_threshold(vectors: DataFrame) -> DataFrame:
    return graph.histogram_threshold(graph.similarity_histogram(vectors, -(-vectors.count() // VECTOR_BLOCK) or 1))


def _vector_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("embedding is not null").groupBy("vec_id").agg(F.min("label").alias("label"))


def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentile of the similarities of all pairs of vectors."""
    return _vector_threshold(_vectors(spark, sf_dir))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of vectors that are as similar as the threshold."""
    v = _vectors(spark, sf_dir)
    t = _vector_threshold(v).first()[0]
    return _vector_pairs(v, t if t is not None else 1.0)


def vector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest neighbours of each vector, every pair once."""
    return graph.nearest_edges(_vector_pairs(_vectors(spark, sf_dir), nearest=3), 3, -1.0)


def vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector, its class, and how many other vectors are as similar as the threshold."""
    v = _vectors(spark, sf_dir)
    t = _vector_threshold(v).first()[0]
    pairs = _vector_pairs(v, t)
    links = pairs.select(F.explode(F.array("a", "b")).alias("vec_id")).groupBy("vec_id").agg(F.count("*").alias("links"))
    return _vector_classes(spark, sf_dir).join(links, "vec_id", "left").select("vec_id", "label", F.coalesce("links", F.lit(0)).alias("links"))


def vector_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the vectors linked at the threshold, named by the commonest classes in them."""
    v = _vectors(spark, sf_dir)
    t = _vector_threshold(v).first()[0]
    t = t if t is not None else 1.0
    pairs = staged(_vector_pairs(v, t))
    docs = _vector_classes(spark, sf_dir).select(F.col("vec_id").alias("doc"), F.col("vec_id").cast("string").alias("title"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("category"), F.array().cast("array<string>").alias("tags"))
    return graph.community_summaries(graph.communities(pairs, docs, t), pairs, docs).select("community", "size", "name")


def gap_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the vectors of even labels are from those of odd ones."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    near = graph.one_nearest(e.filter("label % 2 = 0"), e.filter("label % 2 = 1"))
    return graph.coverage_gaps(near, e.select(F.col("chunk_id").alias("id"), F.col("label").alias("doc")))


GAP_CTE = """d AS (SELECT a.vec_id, a.label AS doc, min(round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE, 2))), 6)) AS distance FROM embeddings a, embeddings b WHERE a.label % 2 = 0 AND b.label % 2 = 1 GROUP BY ALL),
gaps AS (SELECT doc, round(avg(distance), 6) AS mean, min(distance) AS least, count(*) AS chunks FROM d GROUP BY doc)"""
GAP_SQL = f"WITH {GAP_CTE} SELECT doc, mean, least, chunks FROM gaps"


def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.gap_summary(gap_analysis(spark, sf_dir))


GAP_SUMMARY_SQL = f"WITH {GAP_CTE} SELECT round(avg(mean), 6) AS mean, round(median(mean), 6) AS median, max(mean) AS most, count(*) AS documents FROM gaps"


def author_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment authors who name issues' assignees by handle: handles are first names."""
    c = table(spark, sf_dir, "jira_comments").filter("author is not null and body is not null").select(F.split("author", " ")[0].alias("handle"), F.col("body").alias("text"))
    scores = c.select(F.lower("handle").alias("handle")).distinct().withColumn("score", F.lit(1.0))
    return graph.author_graph(c, scores)


QUERIES = {
    f.__name__: f
    for f in (
        body_classifier, exclusion_reasons, noise_patterns, latest_deliveries, rescued_parents, recovered_report, sanitized_lines, email_counts, pii_counts, redacted_comments, exact_copies, tag_histogram, labelled_tags, tag_coverage, collection_overview,
        orphan_prune, upsert_delta, pruned_chunks, upserted_chunks, manifest_merge, high_water_mark, reread_excluded, prefix_cache, article_files,
        breadcrumbs, clean_bodies, snippets, heading_chunks, session_chunks, indexed_texts, issue_texts, issue_markdown, notion_pages, transcript_chapters, transcript_lines, video_ids, issue_queries,
        run_ledger, run_times, phase_rollup, median_by_variant, job_overview,
        graph_merge, graph_edges, graph_stats, graph_hops, graph_subtree, node_details, star_edges, issue_graph_edges, epic_children, entity_mentions, entity_answers, entity_contexts,
        document_vectors, vector_threshold, vector_pairs, vector_edges, vector_links, vector_communities, gap_analysis, gap_summary, author_graph,
    )
}
SQL = {
    "body_classifier": BODY_CLASSIFIER_SQL, "exclusion_reasons": EXCLUSION_REASONS_SQL, "noise_patterns": NOISE_PATTERNS_SQL, "latest_deliveries": LATEST_SQL, "rescued_parents": RESCUED_SQL, "recovered_report": RECOVERED_SQL, "sanitized_lines": SANITIZED_SQL,
    "email_counts": EMAIL_COUNTS_SQL, "pii_counts": PII_COUNTS_SQL, "exact_copies": EXACT_COPIES_SQL, "tag_histogram": TAG_HISTOGRAM_SQL, "tag_coverage": TAG_COVERAGE_SQL, "collection_overview": COLLECTION_OVERVIEW_SQL,
    "orphan_prune": ORPHAN_PRUNE_SQL, "upsert_delta": UPSERT_SQL, "manifest_merge": MANIFEST_MERGE_SQL, "high_water_mark": HIGH_WATER_SQL, "reread_excluded": REREAD_SQL, "prefix_cache": PREFIX_CACHE_SQL, "article_files": ARTICLE_FILES_SQL,
    "breadcrumbs": BREADCRUMBS_SQL, "clean_bodies": CLEAN_BODIES_SQL, "snippets": SNIPPETS_SQL, "indexed_texts": INDEXED_TEXTS_SQL, "issue_texts": ISSUE_TEXTS_SQL, "issue_markdown": ISSUE_MARKDOWN_SQL, "transcript_chapters": CHAPTERS_SQL, "transcript_lines": TRANSCRIPT_LINES_SQL,
    "video_ids": VIDEO_IDS_SQL, "issue_queries": ISSUE_QUERIES_SQL, "run_times": RUN_TIMES_SQL, "phase_rollup": PHASE_ROLLUP_SQL,
    "graph_merge": GRAPH_MERGE_SQL, "graph_edges": GRAPH_EDGES_SQL, "graph_stats": GRAPH_STATS_SQL, "graph_hops": GRAPH_HOPS_SQL, "graph_subtree": GRAPH_SUBTREE_SQL, "node_details": NODE_DETAILS_SQL, "issue_graph_edges": ISSUE_EDGES_SQL, "epic_children": EPIC_CHILDREN_SQL, "entity_mentions": ENTITY_MENTIONS_SQL,
    "document_vectors": DOCUMENT_VECTORS_SQL, "gap_analysis": GAP_SQL, "gap_summary": GAP_SUMMARY_SQL,
}
