"""What a knowledge graph tells about mentioned nodes: search terms, contexts, answers, and hints for another search.

Graphs are the frames of `graph`; mentions those of `graph.detect_entities`. Kinds of nodes and edges have fixed names; other
nodes than issues, epics, processes (BUC), messages (SED), articles and extracted entities have only their label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators.graph import detect_entities, neighbours
from marlstone.plans import staged

# Kinds of edges, and how many rows each part takes.
CONTAINS, BASED_ON = "inneholder_sed", "hjemlet_i"
TO_EPIC, TO_ISSUE = ["tilhører_epic", "belongs_to_epic"], ["refererer_til", "refers_to"]
REFERENCES, ENTITY_NEIGHBOURS, LABEL_LENGTH, ISSUES_LISTED = 3, 5, 60, 20
EXPANSION_TERMS, RETRY_TERMS, CONTEXTS = 5, 8, 3


def _order(mentions: DataFrame) -> DataFrame:
    return mentions.select("text_id", F.col("node_id").alias("node"), F.struct("kind_no", "position", "node_id").alias("_o"))


def _property(name: str, of: str = "properties") -> Column:
    return F.coalesce(F.try_element_at(F.col(of), F.lit(name)), F.lit(""))


def _ends(own: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of `own` nodes (node, kind) with the other end: node, kind, edge, direction, other, label, title, status."""
    near = own.join(neighbours(edges).withColumnRenamed("type", "edge"), "node")
    end = nodes.select(F.col("id").alias("other"), F.coalesce("label", F.lit("")).alias("label"), _property("title").alias("title"), _property("status").alias("status"), _property("summary").alias("summary"))
    return near.join(end, "other")


def typed_terms(mentions: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int | None = EXPANSION_TERMS) -> DataFrame:
    """Search terms of the mentioned nodes, each once, at most `limit` a text, in the order of the mentions: text_id, terms.

    A node gives its label; an epic its summary; an issue its epic and three issues it refers to; an extracted entity five
    neighbours; other nodes the messages and articles of their process with titles, and the processes they are part of.
    Long labels of issues and epics are cut. Neighbours of one kind come in the order of their ids.
    """
    m = _order(mentions)
    own = nodes.join(m.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    work = F.col("type").isin("Epic", "Issue")
    kind = F.when(F.col("type").isin("Epic", "Issue"), F.col("type")).when(F.col("id").startswith("entity:"), "entity").otherwise("other")
    label = F.when(work, F.substring("label", 1, LABEL_LENGTH)).otherwise(F.col("label"))
    terms = own.select(F.col("id").alias("node"), F.lit(0).alias("step"), F.lit(0).alias("n"), label.alias("term"))
    terms = terms.unionByName(own.filter("type = 'Epic'").select(F.col("id").alias("node"), F.lit(1).alias("step"), F.lit(0).alias("n"), _property("summary").alias("term")))
    e = _ends(own.select(F.col("id").alias("node"), kind.alias("kind")).filter("kind <> 'Epic'"), nodes, edges)
    out, issue = F.col("direction") == "outgoing", F.col("kind") == "Issue"
    expanding = F.col("edge").isin(CONTAINS, BASED_ON) & (F.col("kind") == "other")
    step = F.when(issue & out & F.col("edge").isin(TO_EPIC), 1).when(issue & out & F.col("edge").isin(TO_ISSUE), 2).when((F.col("kind") == "entity") | expanding, F.when(out, 3).otherwise(4))
    text = F.when(issue & F.col("edge").isin(TO_ISSUE), F.substring("label", 1, LABEL_LENGTH)).when((F.col("kind") == "other") & out & (F.col("title") != ""), F.concat_ws(" ", "label", "title")).otherwise(F.col("label"))
    e = e.withColumn("step", step).filter("step is not null").withColumn("term", text)
    part = F.when(F.col("kind") == "entity", 3).otherwise(F.col("step"))  # an entity's neighbours on both sides count together
    w = Window.partitionBy("node", "part").orderBy("step", "edge", "other")
    most = F.when(F.col("kind") == "entity", ENTITY_NEIGHBOURS).when(F.col("step") == 2, REFERENCES)
    capped = e.withColumn("part", part).filter((F.col("kind") == "entity") | (F.col("step") == 2)).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    free = e.filter("kind <> 'entity' and step <> 2").groupBy("node", "step", "term").agg(F.min(F.struct("edge", "other")).alias("_e"))
    free = free.withColumn("n", F.row_number().over(Window.partitionBy("node", "step").orderBy("_e")))
    if limit is not None:  # the first `limit` different terms of a node are all that can be used
        free = free.filter(F.col("n") <= limit)
    every = terms.unionByName(capped.select("node", "step", "n", "term")).unionByName(free.select("node", "step", "n", "term")).filter("coalesce(term, '') <> ''")
    first = m.join(every, "node").groupBy("text_id", "term").agg(F.min(F.struct("_o", "step", "n")).alias("_f"))
    if limit is not None:
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy("text_id").orderBy("_f"))).filter(F.col("_n") <= limit)
    return first.groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "term"))), lambda x: x["term"]).alias("terms"))


def typed_contexts(nodes: DataFrame, edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """A line on each node (of `wanted`, a frame of ids, or all) that has one: id, context.

    Parts are joined by bars: a message with its title and processes, a process with its articles and messages, an article with
    its regulation and processes, an epic with its number of issues, an issue with its epic, an extracted entity with its type,
    five relations and its mentions. The messages and processes of one node are listed whole.
    """
    own = nodes.join(wanted.select("id").distinct(), "id", "left_semi") if wanted is not None else nodes
    kind = F.when(F.col("type").isin("SED", "BUC", "Artikkel", "Epic", "Issue"), F.col("type")).when(F.col("id").startswith("entity:"), "entity")
    own = own.withColumn("kind", kind).filter("kind is not null")
    e = _ends(own.select(F.col("id").alias("node"), "kind"), nodes, edges)
    out = F.col("direction") == "outgoing"
    is_ = lambda k, edge, direction: (F.col("kind") == k) & F.col("edge").isin(edge) & (out if direction else ~out)
    part = (
        F.when(is_("SED", [CONTAINS], False), "parents").when(is_("BUC", [BASED_ON], True), "articles").when(is_("BUC", [CONTAINS], True), "messages")
        .when(is_("Artikkel", [BASED_ON], False), "parents").when(is_("Issue", TO_EPIC, True), "epic").when(F.col("kind") == "entity", "related")
    )
    text = F.when(F.col("kind") == "entity", F.when(out, F.concat_ws(" ", "edge", "label")).otherwise(F.concat_ws(" ", "label", "edge"))).when(F.col("kind") == "Issue", F.when(F.col("summary") != "", F.col("summary")).otherwise(F.col("label"))).otherwise(F.col("label"))
    order = F.struct(F.when(out, 0).otherwise(1).alias("side"), F.when((F.col("kind") == "BUC") & (F.col("edge") == CONTAINS), F.col("label")).otherwise("").alias("by"), F.col("other"), F.col("edge"))
    e = e.withColumns({"part": part, "text": text, "_o": order}).filter("part is not null")
    e = e.withColumn("_n", F.row_number().over(Window.partitionBy("node", "part").orderBy("_o"))).filter(F.when(F.col("part") == "related", F.col("_n") <= ENTITY_NEIGHBOURS).when(F.col("part") == "epic", F.col("_n") == 1).otherwise(True))
    lists = e.groupBy("node", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), ", ").alias("list"))
    lists = lists.groupBy("node").pivot("part", ["parents", "articles", "messages", "epic", "related"]).agg(F.first("list"))
    j = own.join(lists, F.col("node") == F.col("id"), "left")
    given = lambda c, text: F.when(c.isNotNull() & (c != ""), text)
    title, count, regulation = _property("title"), _property("issue_count"), F.coalesce(F.try_element_at("properties", F.lit("forordning")), F.lit("883/2004"))
    mentions = F.coalesce(_property("mention_count").try_cast("int"), F.lit(0))
    parents, articles, messages, epic, related = (F.col(c) for c in ("parents", "articles", "messages", "epic", "related"))
    k = F.col("kind")
    parts = F.array(
        F.when(k == "SED", given(title, F.concat_ws(": ", "label", title))).when(k == "Artikkel", F.concat(F.col("label"), F.lit(" (Forordning "), regulation, F.lit(")"))).when(k == "entity", F.concat(F.col("label"), F.lit(" ("), F.coalesce("type", F.lit("")), F.lit(")"))).otherwise(F.col("label")),
        F.when(k == "SED", given(parents, F.concat(F.lit("Del av "), parents))).when(k == "Artikkel", given(parents, F.concat(F.lit("Brukes i "), parents))).when(k == "BUC", given(articles, F.concat(F.lit("Hjemlet i "), articles, F.lit(" (Forordning 883/2004)"))))
        .when(k == "Epic", F.when(F.coalesce(count.try_cast("int"), F.lit(0)) != 0, F.concat(count, F.lit(" issues")))).when(k == "Issue", given(epic, F.concat(F.lit("Epic: "), epic))).when(k == "entity", related),
        F.when(k == "BUC", given(messages, F.concat(F.lit("SEDer: "), messages))).when((k == "entity") & (mentions > 1), F.concat(mentions.cast("string"), F.lit(" mentions"))),
    )
    return j.select("id", F.nullif(F.array_join(F.filter(parts, lambda p: p.isNotNull()), " | "), F.lit("")).alias("context")).filter("context is not null")


def typed_answers(questions: DataFrame, mentions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Answers that the graph itself gives to questions of relations (text_id, text): text_id, answer; none otherwise.

    Asked for messages, a process lists them, and so on for a message's processes, a process's articles, an epic's issues (the
    first twenty and how many more) and an issue's epic. Parts follow the order of the mentions, rows that of their ids.
    """
    asked = questions.filter(tx.relational_intent(F.col("text"))).select("text_id", *[tx.asks_for(F.col("text"), ws).alias(k) for k, ws in tx.ASKED_WORDS.items()])
    m = _order(mentions).join(asked, "text_id").join(nodes.select(F.col("id").alias("node"), "type", F.coalesce("label", F.lit("")).alias("name")), "node")
    branch = (
        F.when(F.col("seds") & (F.col("type") == "BUC"), "seds").when(F.col("bucs") & (F.col("type") == "SED"), "bucs").when(F.col("articles") & (F.col("type") == "BUC"), "articles")
        .when((F.col("issues") | F.col("contains")) & (F.col("type") == "Epic"), "issues").when(F.col("epic") & (F.col("type") == "Issue"), "epic")
    )
    m = m.withColumn("branch", branch).filter("branch is not null").select("text_id", "node", "_o", "name", "branch")
    e = _ends(m.select("node", F.col("branch").alias("kind")).distinct(), nodes, edges)
    out, k = F.col("direction") == "outgoing", F.col("kind")
    fits = (
        F.when(k == "seds", out & (F.col("edge") == CONTAINS)).when(k == "bucs", ~out & (F.col("edge") == CONTAINS)).when(k == "articles", out & (F.col("edge") == BASED_ON))
        .when(k == "issues", ~out & F.col("edge").isin(TO_EPIC)).otherwise(out & F.col("edge").isin(TO_EPIC))
    )
    line = F.when(k == "seds", F.concat(F.lit("- "), F.col("label"), F.when(F.col("title") != "", F.concat(F.lit(": "), F.col("title"))).otherwise(""))).when(k == "issues", F.concat(F.lit("- "), F.col("label"), F.when(F.col("status") != "", F.concat(F.lit(" ["), F.col("status"), F.lit("]"))).otherwise(""))).otherwise(F.col("label"))
    e = e.filter(fits).withColumn("line", line).withColumn("_n", F.row_number().over(Window.partitionBy("node", "kind").orderBy("other", "edge")))
    shown = F.when(k == "issues", F.col("_n") <= ISSUES_LISTED).when(k == "epic", F.col("_n") == 1).otherwise(True)
    lists = e.groupBy("node", F.col("kind").alias("branch")).agg(F.count("*").alias("count"), F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("_n", "line")))), lambda x: x["line"]).alias("l"))
    j = m.join(lists, ["node", "branch"])
    b, n = F.col("branch"), F.col("count")
    more = F.when(n > ISSUES_LISTED, F.concat(F.lit("\n- ... og "), (n - ISSUES_LISTED).cast("string"), F.lit(" til"))).otherwise("")
    part = F.concat(
        F.lit("**"), F.col("name"), F.lit("** "),
        F.when(b == "seds", F.concat(F.lit("inneholder disse SEDene:\n"), F.array_join("l", "\n"))).when(b == "bucs", F.concat(F.lit("inngår i: "), F.array_join("l", ", "))).when(b == "articles", F.concat(F.lit("er hjemlet i: "), F.array_join("l", ", ")))
        .when(b == "issues", F.concat(F.lit("har "), n.cast("string"), F.lit(" issues:\n"), F.array_join("l", "\n"), more)).otherwise(F.concat(F.lit("tilhører epic: "), F.array_join("l", ", "))),
    )
    return j.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("answer"))


def enrich_results(results: DataFrame, asked: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = CONTEXTS) -> DataFrame:
    """Results (query_id, position, title, ...) with graph_context: lines on the nodes that the title names, the first `limit`;
    null where there is none. Only results of queries with mentions (`asked`: query_id) get them."""
    titled = results.join(asked.select("query_id").distinct(), "query_id", "left_semi").select(F.struct("query_id", "position").alias("text_id"), F.col("title").alias("text"))
    found = staged(detect_entities(titled, nodes))
    lines = found.join(typed_contexts(nodes, edges, found.select(F.col("node_id").alias("id"))).withColumnRenamed("id", "node_id"), "node_id")
    ranked = lines.withColumn("_n", F.row_number().over(Window.partitionBy("text_id").orderBy("kind_no", "position", "node_id"))).filter(F.col("_n") <= limit)
    context = ranked.groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "context"))), lambda x: x["context"]).alias("graph_context"))
    return results.join(context.select("text_id.*", "graph_context"), ["query_id", "position"], "left")


def label_seeds(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A term to narrow queries (text_id, text) by, where their words occur in labels: text_id, seed.

    The node whose label shares most words with the query (then the one with more mentions, then the smaller id) gives the
    label of its first neighbour, outgoing before incoming, or its own. Filler and words under three characters don't count.
    """
    sign = "[" + "".join("\\" + c for c in tx.WORD_SIGNS) + "]+"
    words = lambda c: F.array_distinct(F.transform(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: F.regexp_replace(w, f"^{sign}|{sign}$", "")))
    q = queries.select("text_id", F.explode(words(F.col("text"))).alias("w")).filter((F.length("w") >= 3) & ~F.col("w").isin(sorted(tx.STOPWORDS)))
    named = nodes.filter("coalesce(label, '') <> ''")
    n = named.select("id", "label", F.coalesce(_property("mention_count").try_cast("long"), F.lit(1)).alias("mentions"), F.explode(words(F.col("label"))).alias("w"))
    shared = q.join(n, "w").groupBy("text_id", "id").agg(F.count("*").alias("shared"), F.first("mentions").alias("mentions"), F.first("label").alias("own"))
    best = shared.groupBy("text_id").agg(F.min_by(F.struct("id", "own"), F.struct(-(F.col("shared") * 1000 + F.col("mentions")), F.col("id"))).alias("b")).select("text_id", F.col("b.id").alias("node"), "b.own")
    near = neighbours(edges).join(best.select("node").distinct(), "node").join(named.select(F.col("id").alias("other"), "label"), "other")
    first = near.groupBy("node").agg(F.min_by("label", F.struct((F.col("direction") == "incoming").alias("side"), F.col("other"), F.col("type"))).alias("label"))
    return best.join(first, "node", "left").select("text_id", F.coalesce("label", "own").alias("seed"))


def retry_hints(queries: DataFrame, mentions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a weak search may try next, for queries (text_id, text): text_id, entities (labels of the mentioned nodes),
    related_terms (at most eight that the query hasn't), narrower_query and broader_query with their strategies. Queries
    without any hint have no row."""
    q = queries.select("text_id", F.coalesce("text", F.lit("")).alias("text"))
    labels = _order(mentions).join(nodes.select(F.col("id").alias("node"), "label").filter("coalesce(label, '') <> ''"), "node").groupBy("text_id", "label").agg(F.min("_o").alias("_o"))
    labels = labels.groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "label"))), lambda x: x["label"]).alias("entities"))
    terms = typed_terms(mentions, nodes, edges, None)
    j = q.join(labels, "text_id", "left").join(terms, "text_id", "left")
    seeds = label_seeds(j.filter("entities is null").select("text_id", "text"), nodes, edges)
    j = j.join(seeds, "text_id", "left")
    has = lambda term: tx.contains_word(F.col("text"), term)
    related = F.slice(F.filter("terms", lambda t: ~has(t)), 1, RETRY_TERMS)
    top = F.coalesce(F.try_element_at("entities", F.lit(1)), F.col("seed"))
    narrow = F.when(top.isNotNull() & ~has(top), F.trim(F.concat_ws(" ", "text", top)))
    broad = tx.broaden(F.col("text"))
    broader = F.when(F.lower(broad["query"]) != F.lower("text"), broad["query"])
    out = j.select(
        "text_id", "entities", F.when(F.size(related) > 0, related).alias("related_terms"),
        narrow.alias("narrower_query"), F.when(narrow.isNotNull(), F.when(F.col("entities").isNotNull(), "entity_label_append").otherwise("fallback_seed")).alias("narrower_strategy"),
        broader.alias("broader_query"), F.when(broader.isNotNull(), broad["strategy"]).alias("broader_strategy"),
    )
    return out.filter("entities is not null or related_terms is not null or narrower_query is not null or broader_query is not null")
