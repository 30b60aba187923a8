"""Knowledge graphs as two frames: nodes (id, type, label, properties map) and edges (source, target, type, properties map).

Merging, entity detection, traversal, answers, subtrees and statistics; similarity graphs with communities; author graphs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators.maintenance import number_chunks
from marlstone.plans import cut, join_small, spread

# Merging -----------------------------------------------------------------------------------------------------------------


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of several files (with file_no, their order): type and label of the first file that has them, properties of all,
    a later file's value before an earlier one's. Nodes without an id are dropped."""
    n = nodes.filter("id is not null")
    first = lambda c: F.min_by(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)), F.when(F.coalesce(c, F.lit("")) != "", F.col("file_no"))).alias(c)
    base = n.groupBy("id").agg(first("type"), first("label"))
    one = n.select("id", "file_no", F.explode_outer("properties").alias("k", "v")).filter("k is not null").groupBy("id", "k").agg(F.max_by("v", "file_no").alias("v"))
    props = one.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    return base.join(props, "id", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges of several files, each (source, target, type) once, with the properties of the first file."""
    e = edges.filter("source is not null and target is not null")
    return e.groupBy("source", "target", "type").agg(F.min_by("properties", "file_no").alias("properties"))


def provenance(nodes: DataFrame, manifests: DataFrame) -> DataFrame:
    """Graph files whose source collection has moved on: graph, collection, stamped, current, stale.
    nodes: graph, collection, stamped; manifests: collection, current. A missing manifest counts as stale."""
    j = nodes.join(manifests, "collection", "left")
    return j.withColumn("stale", ~F.col("stamped").cast("string").eqNullSafe(F.col("current").cast("string")))


# Detection and answers ---------------------------------------------------------------------------------------------------


#: Words of a label that are looked up; of longer labels the rest is compared where these were found.
GRAM_WORDS = 6


def detect_entities(texts: DataFrame, nodes: DataFrame, id: str = "text_id", text: str = "text") -> DataFrame:
    """Nodes that texts mention: text_id, node_id, kind_no, position, span (of the first place). Their order is that of kind_no,
    position and node_id: kinds of codes in the order of ENTITY_PATTERNS, then labels.

    Codes come by pattern; position counts the codes of a kind. Labels of nodes `entity:...` of at least three characters are
    found as whole words, whatever the case; position is that of the first word. They are looked up by words: text n-grams of
    the lengths that labels have, at most GRAM_WORDS, join the labels' first words, and what was found is compared with the
    whole label, of any length. So no text is tested against every label. Labels without a letter or digit aren't found.
    Null texts mention nothing; repeated text ids count as one text.
    """
    base = spread(texts.select(F.col(id).alias("text_id"), F.col(text).alias("t")).filter("t is not null"))
    kinds = F.array(*[F.struct(F.lit(n).alias("kind_no"), F.lit(k == "article").alias("each"), tx.entity_candidates(F.col("t"), k).alias("found")) for n, k in enumerate(tx.ENTITY_PATTERNS)])
    codes = base.select("text_id", F.inline(kinds)).select("text_id", "kind_no", "each", F.posexplode("found").alias("position", "f")).select("text_id", "kind_no", "each", "position", "f.span", F.posexplode("f.ids").alias("choice", "node_id"))
    known = join_small(codes, nodes.select(F.col("id").alias("node_id")).distinct(), ["node_id"], "inner")
    best = F.min("choice").over(Window.partitionBy("text_id", "kind_no", "position"))  # at most two choices each
    by_code = known.withColumn("_best", best).filter(F.col("each") | (F.col("choice") == F.col("_best"))).select("text_id", "node_id", "kind_no", (F.col("position") * 2 + F.col("choice")).alias("position"), "span")
    labels = nodes.filter(F.col("id").startswith("entity:") & (F.length("label") >= 3)).select(F.col("id").alias("node_id"), "label", tx.word_tokens(F.col("label")).alias("_l"))
    labels = labels.filter(F.size("_l") > 0).select("node_id", "label", F.array_join(F.slice("_l", 1, GRAM_WORDS), " ").alias("gram"), F.least(F.size("_l"), F.lit(GRAM_WORDS)).alias("n"))
    sizes = sorted(r[0] for r in labels.select("n").distinct().collect())  # at most GRAM_WORDS numbers
    if not sizes:
        return _first_mentions(by_code)
    words = base.select("text_id", tx.word_tokens(F.col("t")).alias("w")).select("text_id", "w", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n")).filter(F.size("w") >= F.col("n"))
    grams = words.select("text_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: F.array_join(F.slice("w", i + 1, F.col("n")), " "))).alias("position", "gram"))
    hits = join_small(grams.groupBy("text_id", "gram").agg(F.min("position").alias("position")), labels.select("gram", "node_id", "label"), ["gram"], "inner")
    literal = F.replace("label", F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    span = F.regexp_substr("t", F.concat(F.lit(r"(?iU)(?<!\w)\Q"), literal, F.lit(r"\E(?!\w)")))
    by_label = hits.join(base, "text_id").withColumn("span", span).filter("span is not null")
    return _first_mentions(by_code.unionByName(by_label.select("text_id", "node_id", F.lit(len(tx.ENTITY_PATTERNS)).alias("kind_no"), "position", "span")))


def _first_mentions(found: DataFrame) -> DataFrame:
    first = found.groupBy("text_id", "node_id").agg(F.min(F.struct("kind_no", "position", "span")).alias("_f"))
    return first.select("text_id", "node_id", "_f.*")


def neighbours(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges as (node, other, type, direction) from both ends."""
    e = edges if types is None else edges.filter(F.col("type").isin(types))
    return e.select(F.col("source").alias("node"), F.col("target").alias("other"), "type", F.lit("outgoing").alias("direction")).unionByName(e.select(F.col("target").alias("node"), F.col("source").alias("other"), "type", F.lit("incoming").alias("direction")))


def expansion_terms(mentions: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """Labels of the neighbours of mentioned nodes, up to `limit` per text, each once: text_id, terms."""
    near = mentions.select("text_id", F.col("node_id").alias("node"), "position").join(neighbours(edges), "node")
    named = near.join(nodes.select(F.col("id").alias("other"), "label"), "other").filter(F.coalesce("label", F.lit("")) != "")
    first = named.groupBy("text_id", "label").agg(F.min(F.struct("position", "node", "other")).alias("o"))
    return first.groupBy("text_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("o", "label"))), 1, limit), lambda x: x["label"]).alias("terms"))


def entity_context(nodes: DataFrame, edges: DataFrame, per_type: int = 3) -> DataFrame:
    """A line for each node: its label, type, and up to `per_type` neighbours per kind of edge: id, context."""
    # counted by label and ranked before they are collected: a hot node's labels never meet in one value
    labels = neighbours(edges).join(nodes.select(F.col("id").alias("other"), "label"), "other", "left").groupBy("node", "type", "direction", F.coalesce("label", "other").alias("l")).agg(F.count("*").alias("c"))
    ranked = labels.withColumn("_n", F.row_number().over(Window.partitionBy("node", "type", "direction").orderBy("l")))
    near = ranked.groupBy("node", "type", "direction").agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_n") <= per_type, F.col("l")))).alias("labels"))
    part = F.concat(F.col("type"), F.when(F.col("direction") == "incoming", "⁻¹").otherwise(""), F.lit(": "), F.array_join("labels", ", "), F.when(F.col("n") > per_type, F.concat(F.lit(" (+"), (F.col("n") - per_type).cast("string"), F.lit(")"))).otherwise(""))
    parts = near.groupBy("node").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    head = F.concat(F.coalesce("label", "id"), F.lit(" ("), F.coalesce("type", F.lit("?")), F.lit(")"))
    return nodes.join(parts, F.col("node") == F.col("id"), "left").select("id", F.concat_ws(" | ", head, F.array_join("parts", " | ")).alias("context"))


def answer_questions(questions: DataFrame, mentions: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Answers to questions of relations: for each mentioned node of a question with such words, its neighbours: text_id, answer.
    Questions without relation words, or without neighbours, have none."""
    asked = questions.filter(tx.relational_intent(F.col("text"))).select("text_id")
    near = mentions.join(asked, "text_id").select("text_id", F.col("node_id").alias("node")).join(neighbours(edges), "node").join(nodes.select(F.col("id").alias("other"), "label"), "other", "left")
    listed = near.groupBy("text_id", "node", "type").agg(F.slice(F.array_sort(F.collect_set(F.coalesce("label", "other"))), 1, limit).alias("l"))
    return listed.groupBy("text_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("node"), F.lit(" "), F.col("type"), F.lit(": "), F.array_join("l", ", ")))), "; ").alias("answer"))


def narrower_seed(queries: DataFrame, nodes: DataFrame, mention_counts: DataFrame) -> DataFrame:
    """The node whose label shares most words with a query; more mentioned nodes win ties: text_id, node_id, shared.
    queries: text_id, text; mention_counts: id, mentions."""
    q = queries.select("text_id", F.explode(F.array_distinct(tx.word_tokens(F.col("text")))).alias("w")).filter((F.length("w") > 2) & ~F.col("w").isin(*sorted(tx.STOPWORDS)))
    n = nodes.select(F.col("id").alias("node_id"), F.explode(F.array_distinct(tx.word_tokens(F.coalesce("label", F.lit(""))))).alias("w"))
    c = q.join(n, "w").groupBy("text_id", "node_id").agg(F.count("*").alias("shared")).join(mention_counts.select(F.col("id").alias("node_id"), "mentions"), "node_id", "left")
    score = F.struct(F.col("shared") * 1000 + F.coalesce("mentions", F.lit(0)), F.col("node_id"))
    return c.groupBy("text_id").agg(F.max_by("node_id", score).alias("node_id"), F.max("shared").alias("shared"))


def node_detail(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Each node with its edges: id, type, label, properties, outgoing and incoming array<struct<type, id, label>>."""
    e = edges if types is None else edges.filter(F.col("type").isin(types))
    end = nodes.select(F.col("id").alias("_id"), F.coalesce("label", F.lit("")).alias("_label"))
    def side(own: str, other: str, name: str) -> DataFrame:
        j = e.join(end, F.col(other) == F.col("_id"), "left")
        return j.groupBy(F.col(own).alias("id")).agg(F.array_sort(F.collect_list(F.struct("type", F.col(other).alias("id"), F.coalesce("_label", F.lit("")).alias("label")))).alias(name))

    empty = F.array().cast("array<struct<type:string,id:string,label:string>>")
    out = nodes.join(side("source", "target", "outgoing"), "id", "left").join(side("target", "source", "incoming"), "id", "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("outgoing", "incoming")})


def node_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As `node_detail`, but a row for each edge of a node, which a node of any number of edges allows: id, direction,
    position (from 1, by type and id of the other end), type, other, label."""
    end = nodes.select(F.col("id").alias("other"), "label")
    e = neighbours(edges).withColumnRenamed("node", "id").join(nodes.select("id"), "id", "left_semi").join(end, "other", "left")
    position = F.row_number().over(Window.partitionBy("id", "direction").orderBy("type", "other"))
    return e.select("id", "direction", position.alias("position"), "type", "other", F.coalesce("label", F.lit("")).alias("label"))


def tree_paths(reached: DataFrame, walked: DataFrame, max_depth: int) -> DataFrame:
    """The path of ids from the root to each reached node, by the first parent: root, id, path. reached, walked: of `subtree`."""
    steps = walked.select("root", F.col("source").alias("id"), F.col("target").alias("parent")).unionByName(walked.select("root", F.col("target").alias("id"), F.col("source").alias("parent")))
    level = reached.filter("depth = 0").select("root", "id", F.array("id").alias("path"))
    out = level
    for depth in range(1, max_depth + 1):
        above = level.select("root", F.col("id").alias("parent"), F.col("path").alias("_p"))
        level = reached.filter(F.col("depth") == depth).select("root", "id").join(steps, ["root", "id"]).join(above, ["root", "parent"]).groupBy("root", "id").agg(F.min(F.concat("_p", F.array("id"))).alias("path"))
        out = out.unionByName(level)
    return out


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by kind: what (node, edge), type, n."""
    count = lambda df, what: df.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "type", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def subtree(nodes: DataFrame, edges: DataFrame, roots: DataFrame, direction: str = "incoming", types: list[str] | None = None, max_depth: int = 2, max_nodes: int | None = 1000) -> tuple[DataFrame, DataFrame]:
    """Breadth-first subtrees of many roots at once: reached (root, id, depth), walked (root, source, target, type).

    Each level is one join and is cut to the checkpoint folder. Edges to nodes that don't exist are left out; edges between
    nodes reached before are kept. Once a root has max_nodes nodes it goes no further: the last level is cut to the first
    nodes by id, which is why a cap of 1 still gives 2. None: no cap, and no order of a root's nodes is needed. An unknown
    root gives nothing.
    """
    ids = nodes.select("id").distinct()
    e = edges if types is None else edges.filter(F.col("type").isin(types))
    e = e.select("source", "target", "type").distinct()
    parts = []
    if direction in ("incoming", "both"):
        parts.append(e.select(F.col("target").alias("at"), F.col("source").alias("to"), "source", "target", "type"))
    if direction in ("outgoing", "both"):
        parts.append(e.select(F.col("source").alias("at"), F.col("target").alias("to"), "source", "target", "type"))
    step = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    step = step.join(ids.select(F.col("id").alias("to")), "to", "left_semi")
    reached = cut(roots.select("root").distinct().join(ids.select(F.col("id").alias("root")), "root", "left_semi").select("root", F.col("root").alias("id"), F.lit(0).alias("depth")))
    walked = reached.select("root", *[F.lit(None).cast("string").alias(c) for c in ("source", "target", "type")]).limit(0)
    frontier = reached
    for depth in range(1, max_depth + 1):
        going = frontier
        if max_nodes is not None:
            going = frontier.join(reached.groupBy("root").count().filter(F.col("count") >= max(max_nodes, 2)).select("root"), "root", "left_anti")
        out = cut(going.select("root", F.col("id").alias("at")).join(step, "at").select("root", "to", "source", "target", "type"))
        if out.isEmpty():
            break
        new = out.select("root", F.col("to").alias("id")).distinct().join(reached, ["root", "id"], "left_anti")
        if max_nodes is not None:
            have = reached.groupBy("root").agg(F.count("*").alias("have"))
            new = new.join(have, "root").withColumn("_n", F.row_number().over(Window.partitionBy("root").orderBy("id"))).filter(F.col("have") + F.col("_n") <= F.greatest(F.lit(max_nodes), F.lit(2)))
        frontier = cut(new.select("root", "id", F.lit(depth).alias("depth")))
        reached = reached.unionByName(frontier)
        walked = walked.unionByName(out.join(reached.select("root", F.col("id").alias("to")), ["root", "to"], "left_semi").select("root", "source", "target", "type"))
        if frontier.isEmpty():
            break
    return reached, walked.distinct()


# Building ----------------------------------------------------------------------------------------------------------------


def issue_graph(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of issues (key, summary, epic, parent, text): epics are nodes of their own, with the number of their
    issues; edges to epics, to parents other than the epic, and to issues that texts name. Repeated rows count once."""
    i = issues.groupBy("key").agg(*[F.min_by(c, F.struct(F.col("summary").isNull(), F.col("summary"))).alias(c) for c in ("summary", "epic", "parent", "text")])
    epics = i.filter("epic is not null").groupBy("epic").agg(F.count("*").alias("n"))
    named = epics.join(i.select(F.col("key").alias("epic"), "summary"), "epic", "left")
    prop = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    nodes = named.select(F.concat(F.lit("epic:"), "epic").alias("id"), F.lit("Epic").alias("type"), F.coalesce("summary", "epic").alias("label"), prop(children=F.col("n").cast("string")).alias("properties"))
    nodes = nodes.unionByName(i.select(F.concat(F.lit("issue:"), "key").alias("id"), F.lit("Issue").alias("type"), F.coalesce("summary", "key").alias("label"), F.create_map().cast("map<string,string>").alias("properties")))
    edge = lambda df, s, t, kind: df.select(F.concat(F.lit("issue:"), s).alias("source"), t.alias("target"), F.lit(kind).alias("type"))
    e1 = edge(i.filter("epic is not null"), F.col("key"), F.concat(F.lit("epic:"), F.col("epic")), "belongs_to_epic")
    e2 = edge(i.filter("parent is not null and not (parent <=> epic)"), F.col("key"), F.concat(F.lit("issue:"), F.col("parent")), "subtask_of")
    refs = i.select("key", F.explode(F.array_except(tx.entity_codes(F.coalesce("text", F.lit("")), "issue"), F.array(F.col("key"), F.coalesce("epic", F.lit(""))))).alias("ref"))
    e3 = edge(refs.join(i.select(F.col("key").alias("ref")), "ref", "left_semi"), F.col("key"), F.concat(F.lit("issue:"), F.col("ref")), "refers_to")
    return nodes, e1.unionByName(e2).unionByName(e3).distinct().withColumn("properties", F.create_map().cast("map<string,string>"))


def merge_extractions(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph of extracted entities (doc_id, name, type) and relations (doc_id, source, target, type): entities by
    lower-cased name with their most frequent type, number of mentions and documents; relations between known entities with
    their count."""
    e = entities.filter("name is not null").withColumn("key", F.lower(F.trim("name"))).filter("key <> ''")
    kinds = e.groupBy("key", "type").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("type", F.struct("n", "type")).alias("type"), F.sum("n").alias("mentions"))
    docs = e.groupBy("key").agg(F.min("name").alias("label"), F.array_sort(F.collect_set("doc_id")).alias("documents"))
    nodes = kinds.join(docs, "key").select(F.concat(F.lit("entity:"), "key").alias("id"), "type", "label", "mentions", "documents")
    r = relations.select(*[F.concat(F.lit("entity:"), F.lower(F.trim(c))).alias(c) for c in ("source", "target")], "type")
    ids = nodes.select("id")
    known = r.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, known.groupBy("source", "target", "type").agg(F.count("*").alias("n"))


def author_graph(documents: DataFrame, scores: DataFrame, skip: list[str] = ["#", "**", ">"]) -> DataFrame:
    """Weighted interactions between authors: source, target, weight (from 0 to 1 of the largest).

    documents: handle, text; scores: handle, score (who counts). A quote (`Quoted @x`) weighs 3, a mention 1; lines that
    start with a sign of `skip` hold none.
    """
    d = documents.select(F.lower("handle").alias("source"), "text").join(scores.select(F.lower("handle").alias("source")), "source", "left_semi")
    quotes = d.select("source", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)quot(?:ed|ing)[^@\n]{0,20}@(\w{1,30})"), 1)).alias("target"), F.lit(3.0).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: ~_starts(x, skip))
    mentions = d.select("source", F.explode(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"(?:^|[^\w.@])@(\w{1,30})"), 1)))).alias("target"), F.lit(1.0).alias("w"))
    both = quotes.unionByName(mentions).select("source", F.lower("target").alias("target"), "w").filter("source <> target")
    known = both.join(scores.select(F.lower("handle").alias("target")), "target", "left_semi").groupBy("source", "target").agg(F.sum("w").alias("w"))
    most = F.broadcast(known.agg(F.max("w").alias("most")))  # one row
    return known.crossJoin(most).select("source", "target", F.round(F.col("w") / F.col("most"), 6).alias("weight"))


def author_communities(members: DataFrame, authors: DataFrame) -> DataFrame:
    """Communities of at least two authors (doc, community; authors: handle, score, title): community, size, name (the two
    best-scored), top (the three best-scored), the largest first by position."""
    j = members.select(F.col("doc").alias("handle"), "community").join(authors, "handle")
    ranked = j.withColumn("_n", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("score"), "handle")))
    g = ranked.groupBy("community").agg(F.count("*").alias("size"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= 3, F.struct("_n", "title")))), lambda x: x["title"]).alias("top")).filter("size >= 2")
    return g.select(F.row_number().over(Window.orderBy(F.desc("size"), "community")).alias("position"), "community", "size", F.array_join(F.slice("top", 1, 2), " + ").alias("name"), "top")  # a row a community


def _starts(x: Column, signs: list[str]) -> Column:
    out = F.lit(False)
    for s in signs:
        out = out | F.startswith(x, F.lit(s))
    return out


# Similarity --------------------------------------------------------------------------------------------------------------


def mean_vectors(chunks: DataFrame, doc: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """The mean of each document's chunk vectors, of length 1: doc, vector. Null vectors are left out; a zero mean stays zero."""
    parts = chunks.select(F.col(doc).alias("doc"), F.posexplode(vector).alias("i", "x")).groupBy("doc", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    v = parts.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("doc", F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v")).alias("vector"))


def _blocks(vectors: DataFrame, blocks: int | None) -> tuple[DataFrame, DataFrame, str]:
    """Documents dealt to blocks, each block beside every other once: the two sides, and the type of the ids."""
    k = blocks or max(1, -(-vectors.count() // 2000))
    v = vectors.withColumn("_b", F.pmod(F.xxhash64("doc"), F.lit(k)).cast("int"))
    left = v.select(F.col("_b").alias("_x"), "doc", "vector", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_y")).filter("_x <= _y")
    # new names: a plan that cogroups a frame with itself would otherwise lose one side's columns to pruning
    right = v.select(F.col("_b").alias("_y"), F.col("doc").alias("doc2"), F.col("vector").alias("vector2"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_x")).filter("_x <= _y")
    return left, right, vectors.schema["doc"].dataType.simpleString()


def _cosines(key: tuple, l: pd.DataFrame, r: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of both sides, cosines (rounded to 6 places), and which pairs count: each unordered pair once."""
    a, b = l["doc"].to_numpy(), r["doc2"].to_numpy()
    s = (np.array(l["vector"].tolist()) @ np.array(r["vector2"].tolist()).T).round(6)  # before it meets a threshold, which is rounded too
    return a, b, s, (a[:, None] < b[None, :]) if key[0] == key[1] else np.ones(s.shape, bool)


def document_similarities(vectors: DataFrame, blocks: int | None = None, threshold: float | None = None, nearest: int | None = None) -> DataFrame:
    """Cosines of pairs of documents (a < b): a, b, similarity. Documents are dealt to blocks; a task multiplies two blocks, so no
    side is broadcast whole. All pairs are n * n rows: use `threshold`, or `nearest` (of each document the k most similar ones of
    each block, smaller ids first among ties, from which `nearest_edges` takes the same as from all), or `similarity_histogram`."""
    left, right, kind = _blocks(vectors, blocks)

    def run(key: tuple, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):
            return pd.DataFrame({"a": [], "b": [], "similarity": []}).astype({"similarity": float})
        a, b, s, keep = _cosines(key, l, r)
        if threshold is not None:
            keep = keep & (s >= threshold)
        if nearest is not None:
            best = np.zeros(s.shape, bool)
            own = np.where(a[:, None] == b[None, :], -np.inf, s)  # within one block every document also stands on the other side
            for m, t, ids in ((own, best, b), (own.T, best.T, a)):
                order = np.lexsort((np.broadcast_to(ids, m.shape), -m), axis=1)[:, :nearest]
                np.put_along_axis(t, order, True, axis=1)
            keep = keep & best
        i, j = np.nonzero(keep)
        x, y, s = a[i], b[j], s[i, j]
        return pd.DataFrame({"a": np.where(x > y, y, x), "b": np.where(x > y, x, y), "similarity": s})

    return left.groupBy("_x", "_y").cogroup(right.groupBy("_x", "_y")).applyInPandas(run, f"a {kind}, b {kind}, similarity double")


def similarity_histogram(vectors: DataFrame, blocks: int | None = None) -> DataFrame:
    """How many pairs of documents have each cosine: similarity (of 6 places, so at most two million rows), n. Each task counts
    its own pairs."""
    left, right, _ = _blocks(vectors, blocks)

    def run(key: tuple, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):
            return pd.DataFrame({"similarity": np.zeros(0), "n": np.zeros(0, np.int64)})
        _, _, s, keep = _cosines(key, l, r)
        values, n = np.unique(s[keep], return_counts=True)
        return pd.DataFrame({"similarity": values, "n": n.astype(np.int64)})

    parts = left.groupBy("_x", "_y").cogroup(right.groupBy("_x", "_y")).applyInPandas(run, "similarity double, n long")
    return parts.groupBy("similarity").agg(F.sum("n").alias("n"))


def histogram_threshold(histogram: DataFrame, q: float = 0.75) -> DataFrame:
    """The exact percentile of a histogram's values, linear between them: one row, threshold (null for an empty one)."""
    whole = Window.orderBy("similarity").rowsBetween(Window.unboundedPreceding, 0)  # a bounded table
    h = histogram.withColumn("_to", F.sum("n").over(whole)).crossJoin(F.broadcast(histogram.agg(((F.sum("n") - 1) * F.lit(q)).alias("_at"))))  # one row
    low, high = F.min(F.when(F.col("_to") > F.floor("_at"), F.col("similarity"))), F.min(F.when(F.col("_to") > F.ceil("_at"), F.col("similarity")))
    part = F.max(F.col("_at") - F.floor("_at"))
    return h.agg(F.round(low + (high - low) * part, 6).alias("threshold"))


def similarity_threshold(pairs: DataFrame, q: float = 0.75) -> DataFrame:
    """The exact percentile of the similarities, linear between values: one row, threshold."""
    return pairs.agg(F.round(F.percentile("similarity", q), 6).alias("threshold"))


def nearest_edges(pairs: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The k nearest neighbours of each document at or above `least`, every unordered pair once: a, b, similarity."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    near = both.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).filter((F.col("_n") <= k) & (F.col("similarity") >= least))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct()


def louvain(edges: list[tuple], resolution: float = 1.0, whole: float | None = None) -> dict:
    """Communities of a weighted undirected graph by modularity: nodes move in order of their ids while that gains, then
    communities become nodes, until nothing gains. Deterministic; community numbers follow the first node. whole: the weight of
    the whole graph's edges, where `edges` are those of one of its connected components."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {v: i for i, v in enumerate(nodes)}
    near: list[dict[int, float]] = [{} for _ in nodes]
    for a, b, w in edges:
        i, j = at[a], at[b]
        near[i][j] = near[i].get(j, 0.0) + w
        if i != j:
            near[j][i] = near[j].get(i, 0.0) + w
    member = list(range(len(nodes)))
    total = whole if whole is not None else sum(w for i, d in enumerate(near) for j, w in d.items() if j >= i)
    while total > 0:
        n = len(near)
        of, degree = list(range(n)), [sum(d.values()) + d.get(i, 0.0) for i, d in enumerate(near)]
        mass = degree[:]
        moved, again = False, True
        while again:
            again = False
            for i in range(n):
                own: dict[int, float] = {}
                for j, w in near[i].items():
                    if j != i:
                        own[of[j]] = own.get(of[j], 0.0) + w
                c = of[i]
                mass[c] -= degree[i]
                gain = lambda k: own.get(k, 0.0) - resolution * degree[i] * mass[k] / (2 * total)  # noqa: B023, E731
                best, most = c, gain(c)
                for k in sorted(own):
                    if gain(k) > most + 1e-12:
                        best, most = k, gain(k)
                mass[best] += degree[i]
                if best != c:
                    of[i], again, moved = best, True, True
        names: dict[int, int] = {}
        for c in of:
            names.setdefault(c, len(names))
        of = [names[c] for c in of]
        member = [of[m] for m in member]
        if not moved or len(names) == n:
            break
        merged: list[dict[int, float]] = [{} for _ in names]
        for i, d in enumerate(near):
            for j, w in d.items():
                if j >= i:
                    a, b = of[i], of[j]
                    merged[a][b] = merged[a].get(b, 0.0) + w
                    if a != b:
                        merged[b][a] = merged[b].get(a, 0.0) + w
        near = merged
    return {v: member[i] for v, i in at.items()}


def connected_components(links: DataFrame, a: str, b: str, rounds: int = 200) -> DataFrame:
    """Connected components of the undirected graph of `links` by alternating large and small stars (node, component: the
    least node). Each round is cut to the checkpoint folder; it ends when a round changes nothing. The rounds grow with the
    logarithm of the nodes; a graph that isn't done after `rounds` of them is an error."""
    e = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    for _ in range(rounds):
        if e.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        ends = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = ends.join(near, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = far.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(far.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        if now.count() == e.count() and now.join(e, ["u", "v"], "left_anti").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        e = now
    raise RuntimeError(f"components aren't found after {rounds} rounds")


def communities(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Communities of the graph of pairs at or above the threshold: doc, community. Communities never reach beyond a connected
    component, so each component is a task of its own; the edges of one component must fit in it. Numbers follow the first
    document; documents without an edge get numbers of their own after the others."""
    kind = docs.schema["doc"].dataType.simpleString()
    edges = cut(pairs.filter(F.col("similarity") >= threshold).select("a", "b", "similarity"))
    whole = float(edges.agg(F.sum("similarity")).first()[0] or 0.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = louvain(sorted(zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["similarity"].tolist())), whole=whole)
        return pd.DataFrame({"doc": list(got), "own": list(got.values())})

    of = connected_components(edges, "a", "b").withColumnRenamed("node", "a")
    found = cut(edges.join(of, "a").groupBy("component").applyInPandas(lambda k, pdf: run(pdf).assign(component=k[0]), f"doc {kind}, own int, component {kind}"))
    first = found.groupBy("component", "own").agg(F.min("doc").alias("first"))
    named = number_chunks(first, -1, ["first"], "community").select("component", "own", F.col("community").cast("int").alias("community"))
    found = cut(found.join(named, ["component", "own"]).select("doc", "community"))
    last = found.agg(F.max("community")).first()[0]
    rest = docs.select("doc").distinct().join(found, "doc", "left_anti")
    rest = number_chunks(rest, last if last is not None else -1, ["doc"], "community").withColumn("community", F.col("community").cast("int"))
    return found.unionByName(rest)


def community_summaries(members: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Size, commonest tags and categories, best-connected documents and name of each community.
    docs: doc, title, category, tags (array)."""
    m = members.join(docs, "doc", "left")
    size = m.groupBy("community").agg(F.count("*").alias("size"))
    def commonest(col: Column, k: int, name: str) -> DataFrame:
        c = m.select("community", col.alias("x")).filter(F.coalesce("x", F.lit("")) != "").groupBy("community", "x").agg(F.count("*").alias("n"))
        return c.groupBy("community").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "x"))), 1, k), lambda s: s["x"]).alias(name))

    inside = pairs.select(F.col("a").alias("doc"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("doc"), F.col("a").alias("other"), "similarity"))
    degree = inside.join(members, "doc").join(members.select(F.col("doc").alias("other"), F.col("community").alias("c2")), "other").filter("community = c2").groupBy("community", "doc").agg(F.count("*").alias("n"))
    best = degree.groupBy("community").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "doc"))), 1, 3), lambda s: s["doc"]).alias("central"))
    out = size.join(commonest(F.explode_outer("tags"), 5, "tags"), "community", "left").join(commonest(F.col("category"), 3, "categories"), "community", "left").join(best, "community", "left")
    name = F.when(F.size("tags") > 0, F.array_join(F.slice("tags", 1, 2), ", ")).when(F.size("categories") > 0, F.array_join(F.slice("categories", 1, 2), ", ")).otherwise(F.concat(F.lit("Cluster "), F.col("community").cast("string")))
    return out.withColumn("name", name)


def one_nearest(left: DataFrame, right: DataFrame, id: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The nearest row of another collection for each row: id, distance (squared L2)."""
    from marlstone.operators.retrieval import dense_search

    return dense_search(right, left.select(F.col(id).alias("query_id"), vector), 1, id, vector).select(F.col("query_id").alias("id"), F.col("chunk_id").alias("nearest"), F.col("score").alias("distance"))


def coverage_gaps(distances: DataFrame, documents: DataFrame) -> DataFrame:
    """Mean, least and number of chunk distances per document; the largest means are the gaps: doc, mean, least, chunks.
    distances: id, distance; documents: id, doc."""
    return distances.join(documents, "id").groupBy("doc").agg(F.round(F.avg("distance"), 6).alias("mean"), F.min("distance").alias("least"), F.count("*").alias("chunks"))


def top_gaps(gaps: DataFrame, k: int = 10) -> DataFrame:
    """The k documents that the other collection covers worst: the largest means, with their rank from 1."""
    first = gaps.orderBy(F.desc("mean"), "doc").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "doc")))  # k rows


def epic_of(issues: DataFrame, epics: DataFrame) -> DataFrame:
    """The epic of each issue: issue_key, epic_key, epic_summary. An issue whose parent is an epic has that; else the linked one,
    whose summary is looked up. issues: issue_key, parent, parent_type, parent_summary, epic_link; epics: key, summary."""
    own = (F.lower(F.coalesce("parent_type", F.lit(""))) == "epic") & (F.coalesce("parent", F.lit("")) != "")
    j = issues.join(epics.select(F.col("key").alias("epic_link"), F.col("summary").alias("_s")), "epic_link", "left")
    return j.select("issue_key", F.when(own, F.col("parent")).otherwise(F.coalesce("epic_link", F.lit(""))).alias("epic_key"), F.when(own, F.coalesce("parent_summary", F.lit(""))).otherwise(F.coalesce("_s", F.lit(""))).alias("epic_summary"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.median("mean"), 6).alias("median"), F.max("mean").alias("most"), F.count("*").alias("documents"))
