"""Queries of detection, search terms, contexts and answers on a graph of processes, with their SQL.

The star schema stands for the graph: nations are processes, suppliers messages of their nation's process, regions the
articles that processes rest on. Every customer asks about its nation's process, a message and an article.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import graph, knowledge
from marlstone.plans import staged, table


def _process_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    two, three = (lambda c: F.lpad(c.cast("string"), 2, "0")), (lambda c: F.lpad((c % 1000).cast("string"), 3, "0"))
    none = F.create_map().cast("map<string,string>")
    buc, sed, art = F.concat(F.lit("LA_BUC_"), two(F.col("n_nationkey"))), F.concat(F.lit("A"), three(F.col("s_suppkey"))), (F.col("r_regionkey") + 11).cast("string")
    messages = t("supplier").groupBy(sed.alias("label")).agg(F.min("s_name").alias("title"))
    nodes = t("nation").select(F.concat(F.lit("buc:"), buc).alias("id"), F.lit("BUC").alias("type"), buc.alias("label"), none.alias("properties"))
    nodes = nodes.unionByName(messages.select(F.concat(F.lit("sed:"), "label").alias("id"), F.lit("SED").alias("type"), "label", F.create_map(F.lit("title"), F.col("title")).alias("properties")))
    nodes = nodes.unionByName(t("region").select(F.concat(F.lit("artikkel:"), art).alias("id"), F.lit("Artikkel").alias("type"), F.concat(F.lit("Artikkel "), art).alias("label"), none.alias("properties")))
    nodes = nodes.unionByName(t("region").select(F.concat(F.lit("artikkel:"), art, F.lit(".1")).alias("id"), F.lit("Artikkel").alias("type"), F.concat(F.lit("Artikkel "), art, F.lit(" nr. 1")).alias("label"), F.create_map(F.lit("forordning"), F.lit("987/2009")).alias("properties")))
    has = t("supplier").select(F.concat(F.lit("buc:LA_BUC_"), two(F.col("s_nationkey"))).alias("source"), F.concat(F.lit("sed:"), sed).alias("target"), F.lit("inneholder_sed").alias("type"))
    on = t("nation").select(F.concat(F.lit("buc:"), buc).alias("source"), F.concat(F.lit("artikkel:"), (F.col("n_regionkey") + 11).cast("string")).alias("target"), F.lit("hjemlet_i").alias("type"))
    return nodes, has.unionByName(on).distinct()


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("Hvilke SEDer har la buc "), F.col("c_nationkey").cast("string"), F.lit("? a"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(", art. "), (k % 6 + 11).cast("string"), F.lit(" nr. "), (k % 3).cast("string"))
    return table(spark, sf_dir, "customer").select(k.alias("text_id"), text.alias("text"))


PROCESS_CTE = """nodes AS (SELECT 'buc:LA_BUC_' || lpad(n_nationkey::VARCHAR, 2, '0') AS id, 'BUC' AS type, 'LA_BUC_' || lpad(n_nationkey::VARCHAR, 2, '0') AS label, '' AS title, '883/2004' AS f FROM nation
  UNION ALL SELECT 'sed:A' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0'), 'SED', 'A' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0'), min(s_name), '' FROM supplier GROUP BY s_suppkey % 1000
  UNION ALL SELECT 'artikkel:' || (r_regionkey + 11), 'Artikkel', 'Artikkel ' || (r_regionkey + 11), '', '883/2004' FROM region UNION ALL SELECT 'artikkel:' || (r_regionkey + 11) || '.1', 'Artikkel', 'Artikkel ' || (r_regionkey + 11) || ' nr. 1', '', '987/2009' FROM region),
edges AS (SELECT DISTINCT 'buc:LA_BUC_' || lpad(s_nationkey::VARCHAR, 2, '0') AS source, 'sed:A' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') AS target, 'inneholder_sed' AS type FROM supplier
  UNION ALL SELECT 'buc:LA_BUC_' || lpad(n_nationkey::VARCHAR, 2, '0'), 'artikkel:' || (n_regionkey + 11), 'hjemlet_i' FROM nation),
asked AS (SELECT c_custkey AS text_id, 0 AS kind_no, 0 AS position, 'buc:LA_BUC_' || lpad(c_nationkey::VARCHAR, 2, '0') AS node_id FROM customer UNION ALL SELECT c_custkey, 1, 0, 'sed:A' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') FROM customer
  UNION ALL SELECT c_custkey, 3, 0, 'artikkel:' || (c_custkey % 6 + 11) || '.' || c_custkey % 3 FROM customer UNION ALL SELECT c_custkey, 3, 1, 'artikkel:' || (c_custkey % 6 + 11) FROM customer),
mentions AS (SELECT * FROM asked WHERE node_id IN (SELECT id FROM nodes))"""


def process_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.detect_entities(_questions(spark, sf_dir), _process_graph(spark, sf_dir)[0]).select("text_id", "node_id", "kind_no", "position")


PROCESS_MENTIONS_SQL = f"WITH {PROCESS_CTE} SELECT text_id, node_id, kind_no, position FROM mentions"


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    nodes, edges = (staged(x) for x in _process_graph(spark, sf_dir))
    q = _questions(spark, sf_dir)
    return q, staged(graph.detect_entities(q, nodes)), nodes, edges


def process_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, nodes, edges = _found(spark, sf_dir)
    return knowledge.typed_terms(found, nodes, edges).select("text_id", F.array_join("terms", "; ").alias("terms"))


PROCESS_TERMS_SQL = f"""WITH {PROCESS_CTE},
near AS (SELECT source AS node, 3 AS step, e.type AS edge, target AS other, CASE WHEN title <> '' THEN label || ' ' || title ELSE label END AS term FROM edges e JOIN nodes n ON n.id = e.target UNION ALL SELECT target, 4, e.type, source, label FROM edges e JOIN nodes n ON n.id = e.source),
terms AS (SELECT node, step, row_number() OVER (PARTITION BY node, step ORDER BY edge, other) AS n, term FROM near UNION ALL SELECT id, 0, 0, label FROM nodes),
f AS (SELECT m.text_id, t.term, min((m.kind_no, m.position, m.node_id, t.step, t.n)) AS o FROM mentions m JOIN terms t ON t.node = m.node_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY o) AS k FROM f)
SELECT text_id, string_agg(term, '; ' ORDER BY k) AS terms FROM r WHERE k <= 5 GROUP BY text_id"""


def process_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.typed_answers(*_found(spark, sf_dir))


# the name of the process holds the word that asks for processes, so its messages answer too
PROCESS_ANSWERS_SQL = f"""WITH {PROCESS_CTE}, l AS (SELECT e.source AS id, 'inneholder disse SEDene:' || chr(10) || string_agg('- ' || n.label || ': ' || n.title, chr(10) ORDER BY n.id) AS t FROM edges e JOIN nodes n ON n.id = e.target WHERE e.type = 'inneholder_sed' GROUP BY 1
  UNION ALL SELECT e.target, 'inngår i: ' || string_agg(n.label, ', ' ORDER BY n.id) FROM edges e JOIN nodes n ON n.id = e.source WHERE e.type = 'inneholder_sed' GROUP BY 1)
SELECT m.text_id, string_agg('**' || n.label || '** ' || l.t, chr(10) || chr(10) ORDER BY m.kind_no) AS answer FROM mentions m JOIN nodes n ON n.id = m.node_id JOIN l ON l.id = m.node_id GROUP BY 1"""


def process_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.typed_contexts(*_process_graph(spark, sf_dir))


PROCESS_CONTEXTS_SQL = f"""WITH {PROCESS_CTE},
up AS (SELECT e.target AS id, string_agg(n.label, ', ' ORDER BY n.id) AS l FROM edges e JOIN nodes n ON n.id = e.source GROUP BY 1),
d AS (SELECT e.source AS id, string_agg(n.label, ', ' ORDER BY n.label) FILTER (e.type = 'inneholder_sed') AS s, string_agg(n.label, ', ' ORDER BY n.id) FILTER (e.type = 'hjemlet_i') AS a FROM edges e JOIN nodes n ON n.id = e.target GROUP BY 1)
SELECT n.id, CASE type WHEN 'SED' THEN concat_ws(' | ', label || ': ' || title, 'Del av ' || up.l) WHEN 'Artikkel' THEN concat_ws(' | ', label || ' (Forordning ' || f || ')', 'Brukes i ' || up.l) ELSE concat_ws(' | ', label, 'Hjemlet i ' || d.a || ' (Forordning 883/2004)', 'SEDer: ' || d.s) END AS context FROM nodes n LEFT JOIN up USING (id) LEFT JOIN d USING (id)"""


QUERIES = {f.__name__: f for f in (process_mentions, process_terms, process_answers, process_contexts)}
SQL = {"process_mentions": PROCESS_MENTIONS_SQL, "process_terms": PROCESS_TERMS_SQL, "process_answers": PROCESS_ANSWERS_SQL, "process_contexts": PROCESS_CONTEXTS_SQL}
