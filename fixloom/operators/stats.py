"""Counts of datasets and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_stats(entries: DataFrame) -> DataFrame:
    """``src_dataset, total, with_diff, projects`` for each source, and TOTAL, in which an entry counts once."""
    sums = (F.count(F.lit(1)).alias("total"), F.count("_diff").alias("with_diff"), F.countDistinct("project_url").alias("projects"))
    rows = entries.select("project_url", "src_datasets", F.when(F.col("commit.diff").isNotNull(), 1).alias("_diff"))
    each = rows.withColumn("src_dataset", F.explode("src_datasets")).groupBy("src_dataset").agg(*sums)
    return each.unionByName(rows.agg(*sums).withColumn("src_dataset", F.lit("TOTAL")))


def split_quality(splits: DataFrame) -> DataFrame:
    """``split, n, n_vfc, n_projects, vfc_ratio`` of rows with ``split, is_vfc, project_url``."""
    return splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_vfc").cast("long")).alias("n_vfc"), F.countDistinct("project_url").alias("n_projects"),
        F.round(F.avg(F.col("is_vfc").cast("double")), 6).alias("vfc_ratio"),
    )


def group_sizes(entries: DataFrame, members: DataFrame) -> DataFrame:
    """``group_key, n, n_urls``: entries and projects of each group; a project without one is its own."""
    rows = entries.select("project_url").join(members.select("url", "group_id"), F.col("project_url") == F.col("url"), "left")
    return rows.groupBy(F.coalesce(F.col("group_id").cast("string"), F.col("project_url")).alias("group_key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("project_url").alias("n_urls"))


def split_groups(entries: DataFrame, members: DataFrame, *keys: str) -> DataFrame:
    """``group_key, name, n, n_vfc, n_urls`` (and ``keys``, such as ``split``) of each group of related projects.

    ``name`` is the end of the canonical URL, else of the smallest one of the group.
    """
    rows = entries.select("project_url", F.coalesce("is_vfc", F.lit(False)).cast("long").alias("_v"), *keys).join(members.select("url", "group_id", "canonical_url"), F.col("project_url") == F.col("url"), "left")
    key = F.coalesce(F.col("group_id").cast("string"), F.col("project_url")).alias("group_key")
    sums = rows.groupBy(key, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("n_vfc"), F.countDistinct("project_url").alias("n_urls"), F.coalesce(F.min("canonical_url"), F.min("project_url")).alias("_u"))
    return sums.withColumn("name", F.substring_index(F.regexp_replace("_u", "/+$", ""), "/", -2)).drop("_u")


def dataset_counts(entries: DataFrame) -> DataFrame:
    """``src_dataset, n_vfc, n_other, n_vfc_functions, n_other_functions``; functions are distinct (project, commit, name, file).

    What a source is known to hold is compared with these. Entries of several sources count in each.
    """
    rows = entries.select(F.explode("src_datasets").alias("src_dataset"), F.coalesce("is_vfc", F.lit(False)).alias("_v"), F.when(F.col("function_name").isNotNull(), F.struct("project_url", "commit_id", "function_name", "function_file")).alias("_f"))
    of = lambda c, v: F.when(F.col("_v") == v, c)
    return rows.groupBy("src_dataset").agg(F.count(of(F.lit(1), True)).alias("n_vfc"), F.count(of(F.lit(1), False)).alias("n_other"), F.countDistinct(of(F.col("_f"), True)).alias("n_vfc_functions"), F.countDistinct(of(F.col("_f"), False)).alias("n_other_functions"))


def clone_strategy(entries: DataFrame, full_from: int = 100) -> DataFrame:
    """``project_url, n_commits, strategy``."""
    counts = entries.groupBy("project_url").agg(F.countDistinct("commit_id").alias("n_commits"))
    return counts.withColumn("strategy", F.when(F.col("n_commits") >= full_from, "FULL").otherwise("PARTIAL"))
