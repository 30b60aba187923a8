"""Markdown for readers: results, documents, nodes, subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import percent


def render_results(results: DataFrame) -> DataFrame:
    """A query's results as one Markdown text: query_id, markdown. results: query_id, position, doc_id, relevance, band, and title, url, snippet if there are."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in results.columns else F.lit("")
    head = F.concat(F.lit("### "), (F.col("position") + 1).cast("string"), F.lit(". "), F.coalesce(F.nullif(has("title"), F.lit("")), F.col("doc_id").cast("string")), F.lit(" ("), percent(F.col("relevance")), F.lit(", "), F.col("band"), F.lit(")"))
    body = F.concat_ws("\n", head, F.nullif(has("url"), F.lit("")), F.nullif(has("snippet"), F.lit("")))
    return results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", body.alias("t")))), lambda x: x["t"]), "\n\n").alias("markdown"))


def render_nodes(details: DataFrame) -> DataFrame:
    """Nodes with their edges as Markdown. details: as of `node_detail`."""
    edges = lambda c, sign: F.transform(c, lambda e: F.concat(F.lit(f"- {sign} "), e["type"], F.lit(": "), F.when(e["label"] != "", e["label"]).otherwise(e["id"])))
    return details.select("id", F.array_join(F.concat(F.array(F.concat(F.lit("## "), F.coalesce("label", "id"), F.lit(" ("), F.coalesce("type", F.lit("?")), F.lit(")"))), edges("outgoing", "→"), edges("incoming", "←")), "\n").alias("markdown"))


def render_subtree(reached: DataFrame, nodes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Subtrees as indented lists: root, markdown. paths: of `tree_paths`; with them each node stands below its parent, else
    nodes go by depth and id."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.coalesce("label", "id"))
    j = reached.join(nodes.select("id", "label"), "id", "left")
    order = ["depth", "id"]
    if paths is not None:
        j, order = j.join(paths, ["root", "id"]), ["path"]
    return j.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("t")))), lambda x: x["t"]), "\n").alias("markdown"))


def render_tags(histogram: DataFrame) -> DataFrame:
    """Tags by number of uses: collection, markdown. histogram: collection, tag, n."""
    item = F.struct((-F.col("n")).alias("k"), "tag", F.concat(F.lit("- "), F.col("tag"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t"))
    return histogram.groupBy("collection").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n").alias("markdown"))
