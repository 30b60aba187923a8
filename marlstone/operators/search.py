"""Searches put together: collections, expansion by the graph, similar documents, index updates, constrained tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import graph, knowledge, retrieval as rt
from marlstone.plans import join_small, staged

# How many rows the stages ask for.
OVERFETCH = 3
CHUNK_LIMIT = 30


def fetch_size(n: int, reranked: bool) -> int:
    """Rows to fetch for n results: a third more (at least three), and half more again if they are reranked."""
    effective = n + max(3, n // 3)
    return int(effective * 1.5) if reranked else effective


# Function words by which a question's language is told.
ENGLISH_WORDS = "the a an of and is are was what how which when where who does do with from".split()
NORDIC_WORDS = "og er det som en et av på til med hva hvem hvor hvordan når ikke".split()


def wants_reranking(query: Column, has_reranker: bool, opted_out: bool = False, is_english: Callable[[Column], Column] | None = None) -> Column:
    """Reranking is skipped without a reranker, on demand, and for English questions of three words or more. `is_english` tells
    the language (a model); by default function words do."""
    if not has_reranker or opted_out:
        return F.lit(False)
    words = tx.word_tokens(query)
    common = lambda ws: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ws])))
    english = is_english(query) if is_english else common(ENGLISH_WORDS) > common(NORDIC_WORDS)
    return ~((F.size(words) >= 3) & english)


def augment_queries(queries: DataFrame, nodes: DataFrame, edges: DataFrame, terms: int = knowledge.EXPANSION_TERMS) -> DataFrame:
    """Queries (query_id, query) with the search terms of the nodes they mention: query_id, query, expanded, entities (in the
    order of their mention), answer. Queries that mention nothing stay as they are, with null entities."""
    texts = queries.select(F.col("query_id").alias("text_id"), F.col("query").alias("text"))
    found = staged(graph.detect_entities(texts, nodes))
    more = knowledge.typed_terms(found, nodes, edges, terms)
    answers = knowledge.typed_answers(texts, found, nodes, edges)
    ids = found.groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind_no", "position", "node_id"))), lambda x: x["node_id"]).alias("entities"))
    j = queries.join(ids.withColumnRenamed("text_id", "query_id"), "query_id", "left").join(more.withColumnRenamed("text_id", "query_id"), "query_id", "left").join(answers.withColumnRenamed("text_id", "query_id"), "query_id", "left")
    return j.select("query_id", "query", F.concat_ws(" ", "query", F.array_join("terms", " ")).alias("expanded"), "entities", "answer")


def search_collections(
    index: rt.BM25Index, chunks: DataFrame, documents: DataFrame, queries: DataFrame, limit: int, rerank: bool = True, scorer: Callable[[Column, Column], Column] = rt.overlap_reranker,
    corpus: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, filters: dict | None = None, title_queries: DataFrame | None = None,
) -> DataFrame:
    """The whole way of a batch of queries through collections that share an index.

    chunks: chunk_id, doc_id, text; documents: doc_id, collection, title, url, text, and metadata (map) if there are filters.
    corpus: chunk_id, embedding; with it retrieval is dense and lexical, fused (queries have an embedding, or `embed` makes it
    of their text). title_queries: the queries as they were asked, for the title boost, where `queries` are expanded ones.
    filters: project, branch, tags of `metadata_filter`; documents that don't match are left out before the limit.
    Retrieval with overfetch, reranking for the queries that want it, title boost, documents in order of their best chunk, no
    document twice, at most `limit` before noise is dropped, relevance and band: query_id, position, collection, doc_id, title,
    url, relevance, band, reranked.
    """
    n = fetch_size(limit, rerank)
    wanted = queries.withColumn("reranked", wants_reranking(F.col("query"), rerank))
    if corpus is None:
        found = staged(index.search(queries, OVERFETCH * n)).withColumn("score", -F.col("score"))
    else:
        vectors = queries if "embedding" in queries.columns else queries.withColumn("embedding", embed(F.col("query")))
        found = staged(rt.hybrid_search(index, corpus, vectors, OVERFETCH * n).select("query_id", "chunk_id", "score", "rank"))
    if filters:
        own = rt.metadata_filter(documents, **filters).select("doc_id")
        documents = documents.join(own, "doc_id", "left_semi")
        found = found.join(chunks.join(own, "doc_id", "left_semi").select("chunk_id"), "chunk_id", "left_semi")
    again = rt.rerank(found.join(wanted.filter("reranked").select("query_id"), "query_id", "left_semi"), queries, chunks, n, scorer)
    plain = rt.top_k(found.join(wanted.filter("not reranked").select("query_id"), "query_id", "left_semi").drop("rank"), n, [F.asc("score"), F.asc("chunk_id")])
    ranked = again.select("query_id", "chunk_id", "score", "rank").unionByName(plain.select("query_id", "chunk_id", "score", "rank")).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    boosted = rt.title_boost(ranked, documents.select("doc_id", "title"), title_queries if title_queries is not None else queries)
    docs = rt.group_documents(boosted).withColumnRenamed("doc_rank", "rank").join(documents, "doc_id")
    kept = rt.keep_first_documents(docs.select("query_id", "rank", "doc_id", "url", "text")).select("query_id", "doc_id")
    docs = rt.top_k(docs.join(kept, ["query_id", "doc_id"], "left_semi").drop("rank"), limit, [F.asc("best_score"), F.asc("doc_id")]).join(wanted.select("query_id", "reranked"), "query_id")
    docs = docs.filter(~F.col("reranked") | (F.col("best_score") <= tx.NOISE_SCORE))
    shaped = rt.shape_results(docs.select("query_id", "collection", "doc_id", "title", "url", "best_score", "reranked"), limit, F.col("reranked"))
    return shaped.select("query_id", "position", "collection", "doc_id", "title", "url", "relevance", "band", "reranked")


def answer_requests(queries: DataFrame, nodes: DataFrame, edges: DataFrame, run: Callable[[DataFrame, DataFrame], DataFrame], limit: int, mode: str = "auto", min_relevance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Search requests from end to end: queries (query_id, query) expanded by the graph, searched, enriched with the graph's
    contexts, and searched once more by a hint where the first pass is weak.

    run: (the queries to search, the queries as asked) to shaped results, as `search_collections`. Result: results (with
    rescued, graph_context), responses (query_id, verdict, rescue_query, strategy, answer, entities, entities_found, reranked,
    best, no_confident_results).
    """
    texts = queries.select(F.col("query_id").alias("text_id"), F.col("query").alias("text"))
    found = staged(graph.detect_entities(texts, nodes))
    augmented = staged(augment_queries(queries, nodes, edges))
    hints = knowledge.retry_hints(texts, found, nodes, edges).withColumnRenamed("text_id", "query_id")
    asked = augmented.select("query_id", F.col("expanded").alias("query"))

    def passes(batch: DataFrame) -> DataFrame:  # a second pass is boosted by what it asks itself
        own = batch.join(augmented.select("query_id", F.col("query").alias("_asked"), F.col("expanded").alias("_expanded")), "query_id", "left")
        return run(batch, own.select("query_id", F.when(F.col("query") == F.col("_expanded"), F.col("_asked")).otherwise(F.col("query")).alias("query")))

    results, verdicts = rt.corrective_search(passes, asked, limit, mode, min_relevance, hints)
    results = staged(results)
    best = results.groupBy("query_id").agg(F.round(F.max("relevance"), 3).alias("best"), F.bool_and("reranked").alias("reranked"), F.count("*").alias("n"))
    responses = verdicts.join(augmented.select("query_id", "answer", "entities"), "query_id", "left").join(best, "query_id", "left")
    responses = responses.withColumns({"entities_found": F.coalesce(F.size("entities"), F.lit(0)), "best": F.coalesce("best", F.lit(0.0)), "no_confident_results": F.col("n").isNull()}).drop("n")
    return knowledge.enrich_results(results, found.select(F.col("text_id").alias("query_id")), nodes, edges), responses


INDEXES = ("dense", "bm25")


def open_index(spark: SparkSession, path: str) -> Callable[[DataFrame, int], DataFrame]:
    """The search over what a collection's folder holds: `bm25` (postings, lengths, frequencies), `dense` (chunk_id, embedding), or
    both, fused. queries: query_id, query, and embedding for a dense search. An empty folder is an error."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    has = {n for n in INDEXES if fs_path(f"{path}/{n}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path(f"{path}/{n}"))}
    if not has:
        raise ValueError(f"no index in {path}")
    bm25 = rt.BM25Index.load(spark, f"{path}/bm25") if "bm25" in has else None
    corpus = spark.read.parquet(f"{path}/dense") if "dense" in has else None
    if bm25 is not None and corpus is not None:
        return lambda queries, k: rt.hybrid_search(bm25, corpus, queries, k)
    if corpus is not None:
        return lambda queries, k: rt.dense_search(corpus, queries, k)
    return bm25.search


def similar_documents(index: rt.BM25Index, chunks: DataFrame, documents: DataFrame, limit: int = 5) -> DataFrame:
    """Documents similar to each of `documents` (doc_id, text): by their best of 30 chunks, without the document itself."""
    q = documents.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    near = index.search(q, CHUNK_LIMIT).join(chunks.select("chunk_id", "doc_id"), "chunk_id").filter("doc_id <> query_id")
    best = near.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return rt.top_k(best, limit, [F.desc("score"), F.asc("doc_id")])


def update_index(postings: DataFrame, lengths: DataFrame, removed: DataFrame, added: rt.BM25Index) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths without the chunks of `removed` (chunk_id) and with those of another index; unknown ids are no error.
    Frequencies and averages come from the postings, so nothing is computed again."""
    gone = removed.select("chunk_id").distinct()
    return postings.join(gone, "chunk_id", "left_anti").unionByName(added.postings.select(*postings.columns)), lengths.join(gone, "chunk_id", "left_anti").unionByName(added.lengths)


def topic_coverage(index: rt.BM25Index, topics: DataFrame, documents: DataFrame, k: int = 100) -> DataFrame:
    """How well collections cover topics (topic_id, query): topic_id, collection, documents, best. documents: chunk_id, doc_id, collection."""
    hits = index.search(topics.select(F.col("topic_id").alias("query_id"), "query"), k).join(documents, "chunk_id")
    return hits.groupBy(F.col("query_id").alias("topic_id"), "collection").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.max("score").alias("best"))


def tag_documents(texts: DataFrame, taxonomy: DataFrame, most: int = 5, proposer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Tags of a taxonomy (tag, category) for documents (doc_id, text): those the text names, the most frequent first, at most
    `most`. `proposer` gives tags of a text in place of its words (a model); tags outside of the taxonomy are dropped."""
    words = proposer(F.col("text")) if proposer else tx.word_tokens(F.col("text"))
    w = texts.select("doc_id", F.explode(words).alias("tag")).groupBy("doc_id", "tag").agg(F.count("*").alias("n"))
    known = join_small(w, taxonomy.select(F.lower("tag").alias("tag"), "category").distinct(), ["tag"], "inner")
    r = Window.partitionBy("doc_id").orderBy(F.desc("n"), "tag")
    return known.withColumn("rank", F.row_number().over(r)).filter(F.col("rank") <= most).select("doc_id", "tag", "category", "n", "rank")


def tagging_candidates(files: DataFrame, include: str = "*", exclude: str | None = None, limit: int | None = None) -> DataFrame:
    """Files (path, text) to tag: not hidden, not excluded, matching the globs, and without tags yet."""
    glob = lambda g: "(?i)^" + g.replace(".", r"\.").replace("*", ".*").replace("?", ".") + "$"
    f = files.filter(~F.col("path").rlike(r"(^|/)\.|(^|/)\.excluded/") & F.element_at(F.split("path", "/"), -1).rlike(glob(include)))
    if exclude:
        f = f.filter(~F.element_at(F.split("path", "/"), -1).rlike(glob(exclude)))
    f = f.filter(~F.col("text").rlike(r"(?sm)\A---\n(?:(?!\n---).)*?^tags:\s*\[[^\]]") & ~F.lower("text").rlike(r"<meta\s+name=.keywords"))
    return f.orderBy("path").limit(limit) if limit else f


def tag_discovery(tagged: DataFrame) -> DataFrame:
    """Free tags (tag) with their number of uses, and whether they stand alone."""
    return tagged.groupBy("tag").agg(F.count("*").alias("n")).withColumn("single", F.col("n") == 1)


def valid_collection(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9._-]+$") & ~name.isin(".", "..")


def collection_variants(name: str) -> list[str]:
    """Spellings under which traces name a collection."""
    base = name.lower().removeprefix("my-").removesuffix("-collection")
    return sorted({name, base, f"my-{base}", f"{base}-collection", base.replace("-", "_"), base.replace("_", "-")})


def ancestor_paths(nodes: DataFrame, hops: int = 15) -> DataFrame:
    """The path of each node to its root: id, path (names from the root), depth. nodes: id, parent_id, name. Each hop is a join on
    what hasn't arrived yet; a missing parent ends the path, a circle ends after `hops`."""
    from marlstone.plans import cut

    names = nodes.groupBy("id").agg(F.min_by("parent_id", F.struct("parent_id", "name")).alias("parent_id"), F.min_by("name", F.struct("parent_id", "name")).alias("name"))
    names = cut(names)
    going = names.select("id", F.array("name").alias("path"), F.col("parent_id").alias("next"))
    done = going.filter("next is null").select("id", "path")
    going = going.filter("next is not null")
    up = names.select(F.col("id").alias("next"), F.col("parent_id").alias("after"), F.col("name").alias("parent_name"))
    for _ in range(hops):
        going = cut(going)
        if going.isEmpty():
            break
        j = going.join(up, "next", "left")
        done = done.unionByName(j.filter("parent_name is null or after is null").select("id", F.when(F.col("parent_name").isNull(), F.col("path")).otherwise(F.concat(F.array("parent_name"), "path")).alias("path")))
        going = j.filter("after is not null").select("id", F.concat(F.array("parent_name"), "path").alias("path"), F.col("after").alias("next"))
    done = done.unionByName(going.select("id", "path"))
    return done.select("id", "path", F.size("path").alias("depth"))
