"""The queries of problem 7 over the issue, comment and video tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.timestamps import normalise_timestamps
from marlstone.plans import join_small, table


def stated_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time field of the three tables with its project's zone and order of day and month."""
    def fields(name: str, key: str | None, columns: list[str]) -> DataFrame:
        t = table(spark, sf_dir, name)
        project = F.split(F.col(key), "-")[0] if key else F.lit(None).cast("string")
        return t.select("ingest_id", project.alias("project_key"), F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in columns])).alias("f")).select(F.lit(name).alias("table_name"), "ingest_id", "project_key", "f.field_name", "f.value")

    every = fields("jira_issues", "issue_key", ["created", "updated"]).unionByName(fields("jira_comments", "issue_key", ["date"])).unionByName(fields("youtube_videos", None, ["date"]))
    projects = table(spark, sf_dir, "projects").select("project_key", "tz", "date_order")
    return join_small(every, projects, ["project_key"]).withColumn("source", F.coalesce("project_key", "table_name"))


def p7_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_timestamps(stated_times(spark, sf_dir), "value", "source", "tz", "date_order", ["table_name", "ingest_id", "field_name", "source"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_instants(spark, sf_dir).filter("epoch_us is not null").select("table_name", "ingest_id", "field_name", "epoch_us")


def p7_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source uses each format, and how many values stay ambiguous."""
    t = p7_instants(spark, sf_dir)
    return t.groupBy("source", "format").agg(F.count("*").alias("n"), F.sum(F.col("ambiguous").cast("int")).alias("n_ambiguous"), F.sum(F.col("clock").isNotNull().cast("int")).alias("n_clock_change"))


QUERIES = {"p7_found": p7_found, "p7_instants": p7_instants, "p7_formats": p7_formats}
