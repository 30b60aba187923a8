"""The queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import languages as lg
from marlstone.llm import near_duplicates as nd
from marlstone.llm import personal_data as pii
from marlstone.llm import subjects as sj
from marlstone.llm.markup import clean_markup
from marlstone.llm.mixing import mix
from marlstone.llm.packing import pack_texts
from marlstone.llm.splitting import split_texts
from marlstone.llm.templates import deduce_templates, extract_slots
from marlstone.llm.text_quality import text_quality
from marlstone.operators.graph import connected_components
from marlstone.plans import content_key, cut, join_small, table

# problem 1 -----------------------------------------------------------------------------------------------------------


def _p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "jira_issues").select(F.lit("jira_issues").alias("table_name"), "ingest_id", F.col("description").alias("text"))
    return j.unionByName(table(spark, sf_dir, "articles").select(F.lit("articles").alias("table_name"), "ingest_id", F.col("summary").alias("text")))


def _p1(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return nd.near_duplicates(_p1_rows(spark, sf_dir), "ingest_id", "text", "table_name", threshold=0.6, size=3, least_words=20)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows: linked classes expanded to their members, and the members of one class (the definition asks for every pair)."""
    members, links = _p1(spark, sf_dir)
    members = cut(members)
    pairs = links.select("table_name", "rep_a", "rep_b").unionByName(members.filter("id <> rep").select("table_name", F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")).distinct())
    a = members.select("table_name", F.col("id").alias("x"), F.col("rep").alias("rep_a"))
    b = members.select("table_name", F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    all_pairs = pairs.join(a, ["table_name", "rep_a"]).join(b, ["table_name", "rep_b"]).filter("rep_a <> rep_b or x < y")
    return all_pairs.select("table_name", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of at least 20 words: its class of equal texts, its group (connected classes) and its class's links."""
    members, links = _p1(spark, sf_dir)
    members, links = cut(members), cut(links)
    node = lambda c: F.concat_ws(":", "table_name", F.lpad(F.col(c).cast("string"), 20, "0"))
    comp = connected_components(links.select(node("rep_a").alias("a"), node("rep_b").alias("b")), "a", "b")
    degree = links.select("table_name", F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("table_name", "rep").agg(F.count("*").alias("n_links"))
    out = members.join(degree, ["table_name", "rep"], "left").withColumn("node", node("rep")).join(comp, "node", "left")
    group = F.coalesce(F.split("component", ":")[1].cast("bigint"), F.col("rep"))
    return out.select("table_name", F.col("id").alias("ingest_id"), F.col("rep").alias("class_id"), group.alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


# problem 5 -----------------------------------------------------------------------------------------------------------


def _p5(spark: SparkSession, sf_dir: str, redact: bool) -> DataFrame:
    j, c = table(spark, sf_dir, "jira_issues"), table(spark, sf_dir, "jira_comments")
    texts = j.select(F.lit("jira_issues").alias("table_name"), "ingest_id", F.col("description").alias("text")).unionByName(c.select(F.lit("jira_comments").alias("table_name"), "ingest_id", F.col("body").alias("text")))
    names = j.select("assignee").unionByName(j.select("reporter").toDF("assignee")).unionByName(c.select("author").toDF("assignee"))
    return pii.find_personal_data(texts, "text", ["table_name", "ingest_id"], pii.train_names(names, texts, ["table_name", "ingest_id"]), redact)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5(spark, sf_dir, False).select("table_name", "ingest_id", F.inline("spans")).select("table_name", "ingest_id", F.col("type").alias("pii_type"), "occurrence")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5(spark, sf_dir, True).select("table_name", "ingest_id", F.size("spans").alias("n_spans"), "redacted")


# problem 6 -----------------------------------------------------------------------------------------------------------


def _p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"jira_issues": "description", "youtube_videos": "transcript", "x_articles": "summary"}
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "ingest_id", F.col(f).alias("text"), "lang") for t, f in fields.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Fitted models of this process by the key of what they were fitted on; only the last few are kept.
_MODELS: dict[str, lg.Model] = {}


def _language_model(spark: SparkSession, sf_dir: str) -> lg.Model:
    """The model of the collection's texts; problems 4 and 6 share it."""
    rows = _p6_rows(spark, sf_dir)
    keys = content_key(rows), content_key(table(spark, sf_dir, "common_words"))
    key = "/".join(keys) if all(keys) else ""
    if key not in _MODELS:
        while len(_MODELS) >= 3:
            _MODELS.pop(next(iter(_MODELS)))
        model = lg.train(rows, ["table_name", "ingest_id"], table(spark, sf_dir, "common_words"))
        if not key:
            return model
        _MODELS[key] = model
    return _MODELS[key]


def _p6(spark: SparkSession, sf_dir: str, with_segments: bool) -> DataFrame:
    rows = _p6_rows(spark, sf_dir).withColumn("label", lg.label_language(F.col("lang")))
    return lg.identify_languages(rows, "text", ["table_name", "ingest_id", "label"], _language_model(spark, sf_dir), with_segments)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of at least eight words in one language that the label doesn't name, and both languages of mixed texts."""
    t = _p6(spark, sf_dir, False).filter("n_words >= 8")
    wrong = F.col("label").isNull() | (F.col("label") != F.col("languages")[0]["lang"])
    return t.filter((F.size("languages") > 1) | ((F.size("languages") == 1) & wrong)).select("table_name", "ingest_id", F.explode("languages.lang").alias("true_lang"))


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6(spark, sf_dir, True).select("table_name", "ingest_id", F.inline("segments"))


# problem 2 -----------------------------------------------------------------------------------------------------------


def _p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"jira_issues": "description", "youtube_videos": "transcript", "x_articles": "summary"}
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.lit(f).alias("field_name"), "ingest_id", F.col(f).alias("text")) for t, f in fields.items()]
    limits = table(spark, sf_dir, "size_limits").filter("unit = 'char'").select("table_name", "field_name", "max_size", "overlap")
    rows = join_small(parts[0].unionByName(parts[1]).unionByName(parts[2]), limits, ["table_name", "field_name"])
    return split_texts(rows, "text", ["table_name", "field_name", "ingest_id", "max_size"], "max_size", "overlap")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come out in more than one piece."""
    return _p2(spark, sf_dir).filter("n_pieces > 1 and piece = 0").select("table_name", "ingest_id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p2(spark, sf_dir).select("table_name", "ingest_id", "piece", "n_pieces", "start", "end", "cut", "piece_text")


P2_FOUND_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, ingest_id FROM {t} WHERE length({f}) > (SELECT max_size FROM size_limits WHERE table_name = '{t}' AND field_name = '{f}')"
    for t, f in {"jira_issues": "description", "youtube_videos": "transcript", "x_articles": "summary"}.items()
)

# problems 8 and 9 ----------------------------------------------------------------------------------------------------


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = table(spark, sf_dir, "size_limits").filter("table_name = 'documents' and unit = 'token'").select("max_size").first()[0]
    return pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", capacity)


def p8_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by the tenth of their capacity that is used."""
    one = p8_containers(spark, sf_dir).groupBy("container").agg(F.first("used").alias("used"), F.first("unused").alias("unused"), F.count("*").alias("items"))
    tenth = F.ceil(F.lit(10) * F.col("used") / (F.col("used") + F.col("unused"))).cast("int")
    return one.groupBy(tenth.alias("tenth")).agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("used"), F.sum("unused").alias("unused"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text", table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text", table(spark, sf_dir, "mix_targets"))[1]


# problem 10 ----------------------------------------------------------------------------------------------------------


def p10_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"), "text", ["doc_id"], table(spark, sf_dir, "common_words"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_measures(spark, sf_dir).filter("text_class <> 'prose'").select("doc_id", "text_class")


# problem 4 -----------------------------------------------------------------------------------------------------------


def _p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"youtube_videos": "transcript", "x_articles": "summary", "articles": "summary"}
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "ingest_id", F.col(f).alias("text"), "category", "url") for t, f in fields.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    model = sj.train(table(spark, sf_dir, "subject_examples"), rows, ["table_name", "ingest_id"], ["category", "url"])
    spoken = lg.identify_languages(rows, "text", ["table_name", "ingest_id", "text"], _language_model(spark, sf_dir))
    english = spoken.filter("size(languages) = 1 and languages[0].lang = 'en'")
    return sj.assign_subjects(english, "text", ["table_name", "ingest_id"], model)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every text wholly in English."""
    return _p4(spark, sf_dir).select("table_name", "ingest_id", F.explode("subjects.subject").alias("subject"))


def p4_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and their share of each table by subject; a text with two subjects counts half for each."""
    rows = _p4(spark, sf_dir).select("table_name", F.explode("subjects.subject").alias("subject"), (F.lit(1.0) / F.size("subjects")).alias("part"))
    sums = rows.groupBy("table_name", "subject").agg(F.count("*").alias("texts"), F.round(F.sum("part"), 3).alias("weight"))
    whole = sums.groupBy("table_name").agg(F.sum("weight").alias("whole"))
    return sums.join(whole, "table_name").select("table_name", "subject", "texts", "weight", F.round(F.col("weight") / F.col("whole"), 6).alias("share"))


# problem 3 -----------------------------------------------------------------------------------------------------------


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "jira_issues").select(F.lit("jira_issues").alias("table_name"), "ingest_id", "description")
    n = table(spark, sf_dir, "notion_blocks").select(F.lit("notion_blocks").alias("table_name"), "ingest_id", "data", "block_type")
    return clean_markup(j, "description", ["table_name", "ingest_id"]).unionByName(clean_markup(n, "data", ["table_name", "ingest_id"], "block_type"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_clean(spark, sf_dir).select("table_name", "ingest_id", F.explode("kinds").alias("kind"))


def _p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of hosts: issues of a project, blocks of a page by their visible text."""
    j = table(spark, sf_dir, "jira_issues").select(F.lit("jira_issues").alias("table_name"), "ingest_id", F.concat(F.lit("jira:"), F.split("issue_key", "-")[0]).alias("host"), F.col("description").alias("text"))
    plain = F.array_join(F.regexp_extract_all("data", F.lit(r'"plain_text": ?"((?:[^"\\]|\\.)*)"'), 1), "")
    n = table(spark, sf_dir, "notion_blocks").select(F.lit("notion_blocks").alias("table_name"), "ingest_id", F.concat(F.lit("notion:"), "page_id").alias("host"), plain.alias("text"))
    return j.unionByName(n)


def p3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equivalence classes of tokens of each host, and the templates they nest into."""
    return deduce_templates(_p3_pages(spark, sf_dir), "text", "host")[0].withColumn("tokens", F.array_join("tokens", " "))


def p3_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text between its template's tokens."""
    pages = _p3_pages(spark, sf_dir)
    return extract_slots(pages, "text", "host", ["table_name", "ingest_id"], deduce_templates(pages, "text", "host")[1])


QUERIES = {
    "p3_templates": p3_templates, "p3_slots": p3_slots,
    "p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_clean": p3_clean, "p4_found": p4_found, "p4_composition": p4_composition, "p5_found": p5_found, "p5_redacted": p5_redacted,
    "p6_found": p6_found, "p6_segments": p6_segments, "p8_containers": p8_containers, "p8_space": p8_space, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_measures": p10_measures,
}
SQL: dict[str, str] = {"p2_found": P2_FOUND_SQL}
