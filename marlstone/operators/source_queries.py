"""Queries of sources, sinks, converters and scalar functions on rows made from the tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import cleanup, collection_queries as cq, convert, graph, ledger, maintenance, quality, search, traces
from marlstone.operators.retrieval_queries import _documents, _ranked_docs
from marlstone.plans import checkpoint_folder, table
from marlstone.sources import files, paged

# Sources and sinks -----------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/marlstone-query-{uuid.uuid4().hex}"


def paged_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of two projects from a paged search, one of whose pages fails; by offset and by token."""
    spark.dataSource.register(paged.RowsSource)
    read = lambda name, keys: spark.read.format("rows").schema(paged.ISSUE_SCHEMA).option("reader", f"marlstone.sources.recorded.{name}").option("keys", keys).load()
    rows = read("issues", "AB,CD").withColumn("way", F.lit("offset")).unionByName(read("issues_by_token", "AB").withColumn("way", F.lit("token")))
    epics = rows.filter("way = 'offset'").select(F.col("issue_key").alias("key"), F.col("title").alias("summary"))
    named = graph.epic_of(rows.filter("way = 'offset'").select("issue_key", "parent", "parent_type", "parent_summary", "epic_link"), epics)
    return rows.join(named, "issue_key").select("way", "issue_key", "title", "status", F.array_join("labels", ",").alias("labels"), "description", "epic_key", "epic_summary", F.size("comments").alias("comments"), F.size(F.filter("comments", lambda c: c["author"] == "Unknown")).alias("unknown"))


PAGED_ISSUES_SQL = """WITH w AS (SELECT * FROM (VALUES ('offset', 'AB'), ('offset', 'CD'), ('token', 'AB')) t(way, p)), i AS (SELECT way, p, k::INT AS i FROM w, range(1, 231) r(k))
SELECT way, p || '-' || i AS issue_key, 'issue ' || i AS title, CASE WHEN i % 2 = 1 THEN 'Open' ELSE 'Closed' END AS status, 'l' || i % 3 AS labels, CASE WHEN i % 6 = 0 THEN NULL ELSE 'text ' || i END AS description,
CASE WHEN i % 10 = 5 THEN p || '-1' WHEN i % 2 = 1 THEN p || '-' || (i % 7 + 1) ELSE '' END AS epic_key, CASE WHEN i % 10 = 5 THEN 'first' WHEN i % 2 = 1 THEN 'issue ' || (i % 7 + 1) ELSE '' END AS epic_summary, i % 4 AS comments, CASE WHEN i % 3 = 0 THEN i % 4 ELSE 0 END AS unknown FROM i"""


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiki pages with their comments, cut to chunks: the path first, then the text."""
    spark.dataSource.register(paged.RowsSource)
    p = spark.read.format("rows").schema(paged.PAGE_SCHEMA).option("reader", "marlstone.sources.recorded.wiki").option("keys", "DOC").load()
    text = F.concat_ws(" ", "storage", F.array_join("comments", " "))
    return convert.page_chunks(p.select("page_id", "ancestors", "title", text.alias("storage"))).select("page_id", "chunk_number", "chunk")


WIKI_PAGES_SQL = """WITH p AS (SELECT k::INT AS i FROM range(120) r(k)) SELECT i::VARCHAR AS page_id, 0 AS chunk_number, repeat('home -> ', i % 3) || 'page ' || i AS chunk FROM p
UNION ALL SELECT i::VARCHAR, 1, 'body ' || i || CASE WHEN i % 3 = 0 THEN ' on ' || i ELSE '' END FROM p"""


def fetched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages, fetched level by level down to the tenth."""
    spark.dataSource.register(paged.RowsSource)
    return spark.read.format("rows").schema(paged.BLOCK_SCHEMA).option("reader", "marlstone.sources.recorded.blocks").option("keys", "p1,p2").load().select("page_id", "block_id", "parent_id", "pos", "block_type", "depth")


FETCHED_BLOCKS_SQL = """WITH p AS (SELECT * FROM (VALUES ('p1'), ('p2')) t(p)), d AS (SELECT k::INT AS d FROM range(10) r(k))
SELECT p AS page_id, p || ':' || d AS block_id, CASE WHEN d > 0 THEN p || ':' || (d - 1) END AS parent_id, d AS pos, 'toggle' AS block_type, d AS depth FROM p, d UNION ALL SELECT p, p || '-side:' || d, CASE WHEN d > 0 THEN p || ':' || (d - 1) END, 19 - d, 'paragraph', d FROM p, d"""


def file_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as Markdown files with frontmatter and read as documents, chunked, with the path where there is no text."""
    root = _folder(spark)
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    head = F.concat(F.lit("---\ntitle: \""), "n_name", F.lit("\"\ntags:\n  - a\n  - b\nurl: "), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("https://x.example/"), "n_nationkey")).otherwise(""), F.lit("\n---\n"))
    body = F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.concat(F.lit("# "), "n_name", F.lit("\nlies in "), "r_name", F.lit(".\n")))
    text = n.select(F.concat(head, body).alias("value"), F.regexp_replace("r_name", " ", "_").alias("region"), "n_nationkey")
    text.repartition("n_nationkey").write.partitionBy("region", "n_nationkey").text(root)
    d = files.documents_from_files(files.text_files(_named(files.scan_files(spark, root, exclude=[r"_SUCCESS"]))))
    chunks = convert.with_fallback_chunk(convert.chunk_documents(d, "id", "text"), d.select("id", "breadcrumb"), "id")
    return chunks.join(d.select("id", "url", "metadata"), "id").select(F.regexp_extract("id", r"(region=[^/]*/n_nationkey=\d+)", 1).alias("id"), "url", F.col("metadata")["tags"].alias("tags"), "chunk_number", "heading", F.regexp_replace("chunk", r" > part-[^>]*$", "").alias("chunk"))


def _named(scanned: DataFrame) -> DataFrame:
    """Text files as a writer names them, called Markdown."""
    return scanned.withColumn("path", F.regexp_replace("path", r"/part-[^/]*\.txt$", "/page.md"))


FILE_DOCUMENTS_SQL = """WITH n AS (SELECT 'region=' || replace(r_name, ' ', '_') || '/n_nationkey=' || n_nationkey AS id, n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT id, CASE WHEN k % 2 = 0 THEN 'https://x.example/' || k ELSE 'file://' || id || '/page.md' END AS url, 'a, b' AS tags, 0 AS chunk_number, CASE WHEN k % 5 <> 0 THEN n_name END AS heading, CASE WHEN k % 5 = 0 THEN replace(id, '/', ' > ') || ' > page' ELSE 'lies in ' || r_name || '.' END AS chunk FROM n"""


def versioned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a set of tables; the second is read, and a reader of the first keeps it."""
    store = maintenance.VersionedTables(spark, _folder(spark))
    n = table(spark, sf_dir, "nation")
    first = store.write({"chunks": n.select(F.col("n_nationkey").alias("id")), "mapping": n.select("n_name")})
    store.write({"chunks": n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id")), "mapping": n.select("n_name")})
    return store.read("chunks").withColumn("version", F.lit("current")).unionByName(store.read("chunks", first).withColumn("version", F.lit("first")))


VERSIONED_TABLES_SQL = "SELECT n_nationkey AS id, 'first' AS version FROM nation UNION ALL SELECT n_nationkey, 'current' FROM nation WHERE n_nationkey % 2 = 0"


def bucketed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments by issue as chunks of a bucketed table: all at first, then those of a project anew, those of another removed."""
    t = maintenance.BucketedTable(spark, _folder(spark), 8, "issue_key", "chunk_id")
    c = table(spark, sf_dir, "jira_comments").filter("issue_key is not null").select("issue_key", "ingest_id", F.lit("old").alias("state"))
    project = F.split("issue_key", "-")[0]
    names = table(spark, sf_dir, "projects").agg(F.min("project_key").alias("a"), F.max("project_key").alias("z"))
    own = c.join(F.broadcast(names))  # one row
    t.apply(c, ["issue_key", "ingest_id"], "1")
    t.apply(own.filter(project == F.col("a")).select("issue_key", "ingest_id", F.lit("new").alias("state")), ["issue_key", "ingest_id"], "2", own.filter(project == F.col("z")).select("issue_key"))
    t.apply(c.limit(5), ["issue_key", "ingest_id"], "2")  # applied before: skipped
    return t.read().select("issue_key", "ingest_id", "state", F.col("chunk_id").cast("long").alias("chunk_id"))


BUCKETED_UPDATES_SQL = """WITH c AS (SELECT issue_key, ingest_id, row_number() OVER (ORDER BY issue_key, ingest_id) AS n, split_part(issue_key, '-', 1) AS p FROM jira_comments WHERE issue_key IS NOT NULL), a AS (SELECT min(project_key) AS a, max(project_key) AS z FROM projects)
SELECT issue_key, ingest_id, 'old' AS state, n AS chunk_id FROM c, a WHERE p NOT IN (a, z) UNION ALL SELECT issue_key, ingest_id, 'new', (SELECT count(*) FROM c) + row_number() OVER (ORDER BY issue_key, ingest_id) FROM c, a WHERE p = a"""


def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a bench saved as files; the pointer leads to the last one."""
    root = _folder(spark)
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    maintenance.save_run(r.filter("r_regionkey < 2"), root, "one.json")
    maintenance.save_run(r.filter("r_regionkey >= 2"), root, "two.json")
    return maintenance.latest_run(spark, root)


SAVED_RUNS_SQL = "SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 2"


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records as log lines; details over the limit are cleared, and no record is lost."""
    r = table(spark, sf_dir, "runs_raw").select("seq", "runId", "status", F.concat(F.col("error"), F.repeat(F.lit("x"), F.when(F.col("seq") % 50 == 0, 70_000).otherwise(0))).alias("error"), F.transform("phases", lambda p: F.struct(p["name"].alias("name"), F.repeat(p["name"], F.when(F.col("seq") % 2 == 0, 1000).otherwise(1)).alias("detail"))).alias("phases"))
    j = convert.guarded_records(r)
    at = lambda path: F.get_json_object("record", path)
    return j.select("seq", at("$.runId").alias("run"), F.length(at("$.error")).alias("error_length"), F.length(at("$.phases[0].detail")).alias("detail_length"), at("$.phases[0].detailTruncated").alias("truncated"))


RUN_RECORDS_SQL = """WITH r AS (SELECT seq, runId, length(error) + CASE WHEN seq % 50 = 0 THEN 70000 ELSE 0 END AS e, phases[1].name AS n FROM runs_raw), d AS (SELECT *, length(n) * CASE WHEN seq % 2 = 0 THEN 1000 ELSE 1 END AS l FROM r)
SELECT seq, runId AS run, CASE WHEN e >= 70000 THEN 2048 ELSE e END AS error_length, CASE WHEN l <= 2048 THEN l END AS detail_length, CASE WHEN l > 2048 THEN 'true' END AS truncated FROM d"""


def exclusion_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues as files, every third of which is in the excluded folder; closed ones are excluded, and one in ten has no file."""
    i = cq._latest_issues(spark, sf_dir).filter("issue_key is not null").withColumn("_n", F.regexp_extract("issue_key", r"(\d+)$", 1).cast("int"))
    name = F.concat("issue_key", F.lit(".md"))
    f = i.filter("_n % 10 <> 0").select(F.when(F.col("_n") % 3 == 0, F.concat(F.lit(".excluded/"), name)).otherwise(name).alias("path"))
    return cleanup.exclusion_moves(f, i.filter("lower(status) = 'closed'").select(name.alias("path")))


EXCLUSION_MOVES_SQL = rf"""WITH {cq.LATEST_CTE}, i AS (SELECT issue_key || '.md' AS f, regexp_extract(issue_key, '(\d+)$', 1)::INT AS n, coalesce(lower(status) = 'closed', false) AS x FROM latest WHERE issue_key IS NOT NULL)
SELECT f AS path, NULL AS target, 'prune' AS action FROM i WHERE n % 10 = 0 AND x UNION ALL SELECT f, '.excluded/' || f, 'exclude' FROM i WHERE n % 10 <> 0 AND n % 3 <> 0 AND x UNION ALL SELECT '.excluded/' || f, f, 'restore' FROM i WHERE n % 10 <> 0 AND n % 3 = 0 AND NOT x"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as logged searches: results and first document, the query cut."""
    r = _ranked_docs(spark, sf_dir).select("query_id", "doc_id", F.col("rank").alias("position"), F.round(-F.col("score"), 4).alias("relevance"))
    q = _documents(spark, sf_dir).filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.repeat(F.coalesce("title", F.lit("-")), 20).alias("query"))
    return traces.query_log(r, q, "2026-01-01").select("ts", "query_id", "query", "result_count", "top_doc")


def _query_log_sql() -> str:
    from marlstone.operators.retrieval_queries import BM25_CTE, K

    return f"WITH {BM25_CTE} SELECT '2026-01-01' AS ts, d.doc_id AS query_id, substr(repeat(coalesce(d.title, '-'), 20), 1, 300) AS query, coalesce((SELECT count(*) FROM bm25 b WHERE b.query_id = d.doc_id AND b.rank < {K}), 0) AS result_count, (SELECT b.doc_id FROM bm25 b WHERE b.query_id = d.doc_id AND b.rank = 0) AS top_doc FROM documents d WHERE doc_id % 50 = 0"


# Converters ------------------------------------------------------------------------------------------------------------------


def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues as files with frontmatter, taken apart again."""
    i = table(spark, sf_dir, "jira_issues").filter("issue_key is not null and title is not null and title not like '%\"%' and title not like '%\\\\\\\\%' and trim(title) <> ''")
    text = F.concat(F.lit("---\nissue_key: "), "issue_key", F.lit("\ntitle: \""), "title", F.lit("\"\nstatus: "), F.coalesce("status", F.lit("")), F.lit("\ntags:\n"), F.array_join(F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), ""), F.lit("---\n"), F.coalesce("summary", F.lit("")))
    f = i.select("ingest_id", "issue_key", text.alias("text")).withColumn("f", convert.frontmatter("text"))
    m = convert.metadata_of(F.col("f"))
    return f.select("ingest_id", F.col("f")["title"].alias("title"), m["status"].alias("status"), m["tags"].alias("tags"), convert.strip_frontmatter(F.col("text")).alias("body"), convert.canonical_url(F.col("f"), F.col("issue_key")).alias("url"))


FRONTMATTER_FIELDS_SQL = r"""SELECT ingest_id, title, nullif(trim(status), '') AS status, nullif(array_to_string(labels, ', '), '') AS tags, coalesce(summary, '') AS body, 'file://' || issue_key AS url
FROM jira_issues WHERE issue_key IS NOT NULL AND title IS NOT NULL AND NOT contains(title, '"') AND NOT contains(title, '\') AND trim(title) <> ''"""


def rich_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment lines as paragraphs of a rich document tree, and the text of the tree."""
    c = table(spark, sf_dir, "jira_comments").filter("trim(body) <> ''")
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    tree = F.to_json(F.struct(F.lit("doc").alias("type"), F.transform(lines, lambda x: F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), x.alias("text"))).alias("content"))).alias("content")))
    return c.select("ingest_id", tree.alias("tree")).select("ingest_id", convert.rich_document_text("tree").alias("text")).select("ingest_id", F.md5(F.trim("text")).alias("md5"))


RICH_DOCUMENTS_SQL = "SELECT ingest_id, md5(trim(array_to_string(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> ''), chr(10)))) AS md5 FROM jira_comments WHERE trim(body) <> ''"


def storage_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as stored pages with a heading, a list and a table: Markdown, excerpt and title."""
    n = table(spark, sf_dir, "nation")
    html = F.concat(F.lit("<html><head><title> "), "n_name", F.lit(" </title></head><h2>"), "n_name", F.lit("</h2><p>a <strong>b</strong> &amp; c</p><ul><li>x</li><li>y<ol><li>z</li></ol></li></ul><table><tr><th>k</th><th>v|w</th></tr><tr><td>"), "n_nationkey", F.lit("</td></tr></table><script>no()</script><pre>code  here</pre>"))
    return n.select("n_nationkey", convert.page_markdown(html).alias("markdown"), convert.html_excerpt(html).alias("excerpt"), convert.html_title(html).alias("title"), convert.inject_html_tags(html, F.array(F.lit("t"))).startswith(F.concat(F.lit("<html><head>\n<meta name=\"keywords\" content=\"t\"><title> "), "n_name")).alias("tagged"))


STORAGE_PAGES_SQL = r"""SELECT n_nationkey, '## ' || n_name || E'\n\na **b** & c\n- x\n- y\n  1. z\n\n| k | v\\|w |\n| --- | --- |\n| ' || n_nationkey || E' |  |\n\n```\ncode  here\n```' AS markdown, n_name || ' a b & c x y z k v|w ' || n_nationkey || ' code here' AS excerpt, n_name AS title, true AS tagged FROM nation"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page properties as lines, and the path of a page's file."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = lambda c: F.to_json(F.struct(F.lit("rich_text").alias("type"), F.array(F.struct(c.alias("plain_text"))).alias("rich_text")))
    props = F.concat(F.lit('{"Name": {"type": "title", "title": []}, "Region": '), text(F.col("r_name")), F.lit(', "Key": {"type": "number", "number": '), "n_nationkey", F.lit('}, "Even": {"type": "checkbox", "checkbox": '), F.when(F.col("n_nationkey") % 2 == 0, "true").otherwise("false"), F.lit('}, "None": {"type": "select", "select": null}}'))
    tools = F.array(F.struct(F.lit("Read").alias("name"), F.to_json(F.struct(F.col("n_name").alias("file_path"))).alias("input")), F.struct(F.lit("Odd").alias("name"), F.lit("{}").alias("input")))
    return n.select("n_nationkey", convert.page_properties(props).alias("properties"), convert.page_path(F.array("r_name"), F.concat(F.col("n_name"), F.lit("/a:b"))).alias("path"), F.array_join(convert.tool_summary(tools), "; ").alias("tools"))


PAGE_FILES_SQL = r"""SELECT n_nationkey, '**Region:** ' || r_name || E'\n**Key:** ' || n_nationkey || E'\n**Even:** ' || CASE WHEN n_nationkey % 2 = 0 THEN 'yes' ELSE 'no' END AS properties, r_name || '/' || n_name || '_a_b.md' AS path, 'Read: ' || n_name || '; Odd' AS tools FROM nation JOIN region ON n_regionkey = r_regionkey"""


def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as files to tag: candidates, with their tags put in."""
    a = table(spark, sf_dir, "articles").filter("summary is not null").select("ingest_id", F.concat(F.when(F.col("ingest_id") % 7 == 0, ".excluded/").otherwise("a/"), F.col("ingest_id").cast("string"), F.when(F.col("ingest_id") % 5 == 0, ".txt").otherwise(".md")).alias("path"), F.when(F.col("ingest_id") % 3 == 0, F.concat(F.lit("---\ntags: [x]\n---\n"), "summary")).otherwise(F.col("summary")).alias("text"))
    c = search.tagging_candidates(a.select("path", "text"), "*.md")
    return c.select("path", F.md5(convert.inject_tags(F.col("text"), F.array(F.lit("p"), F.lit("q")))).alias("md5"))


TAGGED_FILES_SQL = r"SELECT 'a/' || ingest_id || '.md' AS path, md5(E'---\ntags: [p, q]\n---\n' || summary) AS md5 FROM articles WHERE summary IS NOT NULL AND ingest_id % 7 <> 0 AND ingest_id % 5 <> 0 AND ingest_id % 3 <> 0 AND NOT regexp_matches(lower(summary), '<meta\s+name=.keywords')"

# Scalar functions ------------------------------------------------------------------------------------------------------------


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    hexid = F.md5(F.col("doc_id").cast("string"))
    return d.select(
        "doc_id", tx.title_from_path(F.concat_ws("/", F.lit("a"), F.coalesce("title", F.lit("x.json")))).alias("file_title"), tx.ascii_slug(F.coalesce("title", F.lit("Å b—c"))).alias("slug"), tx.iso_z(F.col("modified_time")).alias("iso"),
        tx.page_id_of_url(F.concat(F.lit("https://n.example/Page-"), hexid, F.lit("?v=1"))).alias("page_id"), tx.contains_word(F.coalesce("text", F.lit("")), F.lit("the")).alias("has_the"), tx.line_of(F.coalesce("text", F.lit("")), F.lit(400)).alias("line_400"),
        ledger.incomplete_threshold(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") * 10)).alias("incomplete_s"), search.valid_collection(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "-ok").otherwise("/no"))).alias("valid"), tx.clock_seconds(F.date_format("modified_time", "H:mm:ss")).alias("clock_s"),
        tx.setting_bool(F.element_at(F.array(F.lit("TRUE"), F.lit("no"), F.lit(None), F.lit("1")), (F.col("doc_id") % 4 + 1).cast("int")), True).alias("setting"), tx.clean_command_text(F.concat(F.lit("a<command-name>x</command-name>"), F.col("doc_id").cast("string"), F.lit("<system-reminder>y\n</system-reminder>"))).alias("cleaned"),
        tx.embedding_text(F.lit("q"), "intfloat/multilingual-e5-base", False).alias("embedded"), tx.valid_category(F.when(F.col("doc_id") % 2 == 0, "ai/rag"), ["ai/general", "ai/rag"]).alias("category"),
    )


SCALAR_FUNCTIONS_SQL = r"""SELECT doc_id, regexp_replace(string_split('a/' || coalesce(title, 'x.json'), '/')[-1], '\.json$', '') AS file_title,
coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(coalesce(title, 'Å b—c')), '[^\x00-\x7f]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 100), '^_+|_+$', '', 'g'), ''), 'untitled') AS slug,
strftime(modified_time, '%Y-%m-%dT%H:%M:%SZ') AS iso, md5(doc_id::VARCHAR) AS page_id, regexp_matches(coalesce(text, ''), '(?i)(?:^|[^\p{L}\p{N}_\p{M}])the(?:$|[^\p{L}\p{N}_\p{M}])') AS has_the, len(string_split(substr(coalesce(text, ''), 1, 400), chr(10))) AS line_400,
CASE WHEN doc_id % 3 > 0 THEN greatest(doc_id * 20, 7200) ELSE 21600 END AS incomplete_s, doc_id % 2 = 0 AS valid, hour(modified_time) * 3600 + minute(modified_time) * 60 + second(modified_time) AS clock_s, doc_id % 4 <> 1 AS setting, 'a' || doc_id AS cleaned, 'query: q' AS embedded, CASE WHEN doc_id % 2 = 0 THEN 'ai/rag' ELSE 'ai/general' END AS category FROM documents"""


def next_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next time of four schedules after each event: every ten minutes, hourly, daily, and on Mondays."""
    e = table(spark, sf_dir, "events").filter("ts is not null").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    n = lambda v: F.lit(v).cast("int")
    fire = lambda h, m, w, i: F.unix_timestamp(ledger.next_fire(F.col("t"), n(h), n(m), n(w), n(i)))
    return e.select("event_id", fire(None, None, None, 600).alias("every"), fire(None, 15, None, None).alias("hourly"), fire(3, 30, None, None).alias("daily"), fire(3, 30, 1, None).alias("mondays"))


NEXT_FIRES_SQL = """WITH e AS (SELECT event_id, ts AS t, date_trunc('day', ts) AS d, date_trunc('hour', ts) + INTERVAL 15 MINUTE AS h FROM events WHERE ts IS NOT NULL),
f AS (SELECT *, d + INTERVAL 3 HOUR + INTERVAL 30 MINUTE AS a, d + to_days(((8 - isodow(t)) % 7)::INT) + INTERVAL 3 HOUR + INTERVAL 30 MINUTE AS m FROM e)
SELECT event_id, floor(epoch(t + INTERVAL 600 SECOND))::BIGINT AS every, epoch(CASE WHEN h > t THEN h ELSE h + INTERVAL 1 HOUR END)::BIGINT AS hourly, epoch(CASE WHEN a > t THEN a ELSE a + INTERVAL 1 DAY END)::BIGINT AS daily, epoch(CASE WHEN m > t THEN m ELSE m + INTERVAL 7 DAY END)::BIGINT AS mondays FROM f"""

# Graphs and measures ---------------------------------------------------------------------------------------------------------


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "articles").select(F.col("ingest_id").alias("doc_id"), "category", F.array_sort(F.array_distinct("tags")).alias("tags"))
    e = a.select("doc_id", F.explode("tags").alias("name"), F.lower(F.coalesce("category", F.lit("none"))).alias("type"))
    pairs = a.filter("size(tags) >= 2").select("doc_id", F.upper(F.col("tags")[0]).alias("source"), F.col("tags")[1].alias("target"), F.lit("with").alias("type"))
    return graph.merge_extractions(e, pairs.unionByName(pairs.limit(0)).unionByName(pairs.select("doc_id", "source", F.lit("nowhere").alias("target"), "type")))


def extracted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of articles as extracted entities: mentions, commonest type, documents."""
    return _extracted(spark, sf_dir)[0].select("id", "type", "label", "mentions", F.size("documents").alias("documents"))


EXTRACTED_ENTITIES_SQL = """WITH e AS (SELECT ingest_id, lower(coalesce(category, 'none')) AS type, unnest(list_distinct(tags)) AS name FROM articles), k AS (SELECT *, lower(trim(name)) AS key FROM e WHERE trim(name) <> ''), t AS (SELECT key, type, count(*) AS n FROM k GROUP BY ALL)
SELECT 'entity:' || key AS id, (SELECT t.type FROM t WHERE t.key = k.key ORDER BY n DESC, type DESC LIMIT 1) AS type, min(name) AS label, count(*) AS mentions, count(DISTINCT ingest_id) AS documents FROM k GROUP BY key"""


def extracted_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tags as relations; those to an unknown end are dropped."""
    return _extracted(spark, sf_dir)[1]


EXTRACTED_RELATIONS_SQL = """WITH a AS (SELECT list_sort(list_distinct(tags)) AS t FROM articles), e AS (SELECT DISTINCT lower(trim(unnest(t))) AS k FROM a)
SELECT 'entity:' || lower(trim(t[1])) AS source, 'entity:' || lower(trim(t[2])) AS target, 'with' AS type, count(*) AS n FROM a WHERE len(t) >= 2 AND lower(trim(t[1])) IN (SELECT k FROM e) AND lower(trim(t[2])) IN (SELECT k FROM e) GROUP BY ALL"""


def stale_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph files stamped with the number of a source's documents, every other one long ago."""
    d = _documents(spark, sf_dir).groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("collection")).agg(F.count("*").alias("current"))
    nodes = d.select(F.concat(F.lit("g-"), "collection").alias("graph"), "collection", F.when(F.length("collection") % 2 == 0, F.col("current")).otherwise(1).alias("stamped"))
    return graph.provenance(nodes.unionByName(nodes.limit(1).select(F.lit("g-x").alias("graph"), F.lit("gone").alias("collection"), F.lit(3).cast("long").alias("stamped"))), d).select("graph", "stale")


STALE_GRAPHS_SQL = "WITH d AS (SELECT coalesce(lower(trim(source)), 'none') AS c, count(*) AS n FROM documents GROUP BY 1) SELECT 'g-' || c AS graph, NOT (length(c) % 2 = 0 OR n = 1) AS stale FROM d UNION ALL SELECT 'g-x', true"


def matched_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where titles, expected without their signs, first come among the results."""
    r = _ranked_docs(spark, sf_dir).join(_documents(spark, sf_dir).select("doc_id", F.coalesce("title", F.lit("")).alias("t")), "doc_id").select("query_id", "rank", F.col("t").alias("doc_id"))
    q = _documents(spark, sf_dir).filter("doc_id % 50 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.upper(F.regexp_replace("title", r"[^\p{L}\p{N}]+", "_")).alias("expected"))
    return quality.match_expected(r, q)


def _matched_titles_sql() -> str:
    from marlstone.operators.retrieval_queries import BM25_CTE, K

    return rf"""WITH {BM25_CTE}, q AS (SELECT doc_id AS query_id, upper(regexp_replace(title, '[^\p{{L}}\p{{N}}]+', '_', 'g')) AS expected FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
r AS (SELECT b.query_id, b.rank, coalesce(d.title, '') AS t FROM bm25 b JOIN documents d USING (doc_id) WHERE b.rank < {K}), n AS (SELECT q.query_id, q.expected, r.rank, r.t, regexp_replace(lower(r.t), '[^\p{{L}}\p{{N}}]+', '', 'g') AS a, regexp_replace(lower(q.expected), '[^\p{{L}}\p{{N}}]+', '', 'g') AS e FROM q LEFT JOIN r USING (query_id))
SELECT query_id, expected, min(CASE WHEN contains(t, expected) OR contains(a, e) OR coalesce(nullif(regexp_extract(t, '\b([A-Z][A-Z0-9]+-\d+)\b', 1), '') = nullif(regexp_extract(expected, '\b([A-Z][A-Z0-9]+-\d+)\b', 1), ''), false) THEN rank END) AS rank FROM n GROUP BY ALL"""


def config_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as configs, in the order of their names."""
    e = table(spark, sf_dir, "events").filter("value is not null")
    no = F.array_position(F.array(*[F.lit(x) for x in ("click", "purchase", "signup", "view")]), F.col("event_type"))
    return quality.config_averages(e.select(no.alias("config_no"), F.col("event_type").alias("config"), F.col("value").alias("score")))


CONFIG_AVERAGES_SQL = """WITH a AS (SELECT coalesce(list_position(['click', 'purchase', 'signup', 'view'], event_type), 0) AS config_no, event_type AS config, round(avg(value), 6) AS average, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT *, round(average - first(average) OVER (ORDER BY config_no), 6) AS delta FROM a"""


QUERIES = {
    f.__name__: f
    for f in (
        paged_issues, wiki_pages, fetched_blocks, file_documents, versioned_tables, bucketed_updates, saved_runs, run_records, exclusion_moves, query_log, frontmatter_fields, rich_documents, storage_pages, page_files, tagged_files,
        scalar_functions, next_fires, extracted_entities, extracted_relations, stale_graphs, matched_titles, config_averages,
    )
}
SQL = {
    "paged_issues": PAGED_ISSUES_SQL, "wiki_pages": WIKI_PAGES_SQL, "fetched_blocks": FETCHED_BLOCKS_SQL, "file_documents": FILE_DOCUMENTS_SQL, "versioned_tables": VERSIONED_TABLES_SQL, "bucketed_updates": BUCKETED_UPDATES_SQL, "saved_runs": SAVED_RUNS_SQL, "run_records": RUN_RECORDS_SQL,
    "exclusion_moves": EXCLUSION_MOVES_SQL, "query_log": _query_log_sql(), "frontmatter_fields": FRONTMATTER_FIELDS_SQL, "rich_documents": RICH_DOCUMENTS_SQL, "storage_pages": STORAGE_PAGES_SQL, "page_files": PAGE_FILES_SQL, "tagged_files": TAGGED_FILES_SQL, "scalar_functions": SCALAR_FUNCTIONS_SQL,
    "next_fires": NEXT_FIRES_SQL, "extracted_entities": EXTRACTED_ENTITIES_SQL, "extracted_relations": EXTRACTED_RELATIONS_SQL, "stale_graphs": STALE_GRAPHS_SQL, "matched_titles": _matched_titles_sql(), "config_averages": CONFIG_AVERAGES_SQL,
}
