"""Attaching commit data to entries, from a table or any provider, and completing shortened ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixloom.functions.comments import stripped_diff, without_comments
from fixloom.functions.commit_text import commit_struct, is_complete, merge_commits
from fixloom.functions.paths import language


def attach(entries: DataFrame, data: DataFrame) -> DataFrame:
    """Entries with gaps of ``commit`` filled from ``data`` (``project_url, commit_id, data``), a row for each commit.

    Existing values win. Every entry of a commit gets them; those that need nothing keep what they have.
    """
    joined = entries.join(data, ["project_url", "commit_id"], "left")
    filled = F.when(F.col("data").isNotNull() & ~is_complete(F.col("commit")), merge_commits(F.col("commit"), F.col("data"))).otherwise(F.col("commit"))
    return joined.withColumn("commit", filled).drop("data").select(*entries.columns)


def fetch(entries: DataFrame, provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What a provider says about each distinct commit that lacks something; a project's commits come together."""
    keys = entries.where(~is_complete(F.col("commit"))).select("project_url", "commit_id").distinct()
    return keys.repartition("project_url").mapInPandas(provider, schema)


def offline_commits(entries: DataFrame, commits: DataFrame) -> DataFrame:
    """``project_url, commit_id, data``: what a table of commits knows of those that lack something; for ``attach``.

    ``commits``: ``project_url, commit_id, _ord, message, diff, files_changed, authored_at, committed_at``, any number of
    rows a commit: each field takes its first known value. Stands in for a clone or a hosting service.
    """
    lacking = entries.where(~is_complete(F.col("commit"))).select("project_url", "commit_id").distinct()
    known = commits.join(lacking, ["project_url", "commit_id"], "left_semi")
    first = lambda c, real: F.min_by(c, F.when(real, F.col("_ord"))).alias(c)
    fields = [first(c, F.size(c) > 0 if c == "files_changed" else F.col(c).isNotNull()) for c in ("message", "diff", "files_changed", "authored_at", "committed_at")]
    rows = known.groupBy("project_url", "commit_id").agg(*fields)
    return rows.select("project_url", "commit_id", commit_struct(*(F.col(c) for c in ("message", "diff", "files_changed", "authored_at", "committed_at"))).alias("data"))


def diffs_without_comments(files: DataFrame, include_unsupported: bool = True) -> DataFrame:
    """``project_url, commit_id, diff`` made anew from the files of each commit, without their comments; for ``replace_diffs``.

    ``files``: ``project_url, commit_id, path, before, after, mode, original``, a row for each changed file; NULL ``before`` or
    ``after`` for one that was added or removed. Files of other languages keep their original diff, or are left out.
    Files whose code did not change give nothing, so a commit of comments alone has an empty diff. In order of path.
    """
    name = language(F.col("path"))
    new = stripped_diff(F.col("before"), F.col("after"), F.col("path"), name, F.col("mode"), F.col("original") if include_unsupported else F.lit(None).cast("string"))
    each = files.select("project_url", "commit_id", "path", new.alias("d"))
    parts = F.array_sort(F.collect_list(F.when(F.col("d") != "", F.struct("path", "d"))))
    return each.groupBy("project_url", "commit_id").agg(F.array_join(F.transform(parts, lambda p: p["d"]), "\n").alias("diff"))


def extend_ids(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Shortened ids as the one full id of their project that they begin; unresolved or ambiguous ones stay.

    ``known``: ``project_url, full_id``. An equi join on project and five digits, then a prefix test.
    """
    short = entries.where(F.length("commit_id") < 40).select("project_url", "commit_id").distinct().withColumn("_k", F.substring("commit_id", 1, 5))
    full = known.select("project_url", "full_id").distinct().withColumn("_k", F.substring("full_id", 1, 5))
    hits = short.join(full, ["project_url", "_k"]).where(F.expr("startswith(full_id, commit_id)"))
    one = hits.groupBy("project_url", "commit_id").agg(F.min("full_id").alias("_full"), F.count(F.lit(1)).alias("_k")).where("_k = 1").drop("_k")
    return entries.join(one, ["project_url", "commit_id"], "left").withColumn("commit_id", F.coalesce("_full", "commit_id")).drop("_full").select(*entries.columns)


def strip_code(blobs: DataFrame) -> DataFrame:
    """``blobs`` (``path, code``) with ``code`` free of comments; unknown languages keep theirs."""
    return blobs.withColumn("code", F.coalesce(without_comments(F.col("code"), language(F.col("path"))), F.col("code")))


def replace_diffs(entries: DataFrame, diffs: DataFrame) -> DataFrame:
    """Entries with the diff of ``diffs`` (``project_url, commit_id, diff``) where that has one."""
    new = diffs.select("project_url", "commit_id", F.col("diff").alias("_new"))
    joined = entries.join(new, ["project_url", "commit_id"], "left")
    return joined.withColumn("commit", F.col("commit").withField("diff", F.coalesce("_new", "commit.diff"))).select(*entries.columns)
