"""Merging entries that describe the same thing. "First" always means the smallest ``_ord``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixloom.schema import as_set

SETS = ("src_datasets", "cve_ids", "cwe_ids")
FIRST_KNOWN = ("ghsa_id", "function_file")
FIRST = ("project_url", "commit_id", "function_name", "is_vfc")
TEXTS = ("message", "diff", "authored_at", "committed_at")


def _union(column: str) -> Column:
    """Union of a set column over a group; distinct elements are collected, so a huge group stays small."""
    return as_set(F.flatten(F.collect_set(F.coalesce(F.col(column), F.array()))))


def _first_known(value: Column, name: str) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("_ord"))).alias(name)


def merge_columns(key: tuple[str, ...], label: str = "first") -> list[Column]:
    """Aggregates for every field of an entry that is no key. ``label``: ``first`` or ``any`` fixing entry."""
    out = [_union(c).alias(c) for c in SETS]
    out += [_first_known(F.col(c), c) for c in FIRST_KNOWN]
    out += [F.min_by(c, "_ord").alias(c) for c in FIRST if c not in key and c != "is_vfc"]
    out.append(F.min_by("is_vfc", "_ord").alias("is_vfc") if label == "first" else F.bool_or("is_vfc").alias("is_vfc"))
    known = F.collect_set(F.when(F.col("owasp_categories").isNotNull(), F.col("owasp_categories")))
    out.append(F.when(F.size(known) > 0, F.array_sort(F.array_distinct(F.flatten(known)))).alias("owasp_categories"))
    out += [_first_known(F.col(f"commit.{f}"), f"_{f}") for f in TEXTS]
    out.append(as_set(F.flatten(F.collect_set(F.coalesce(F.col("commit.files_changed"), F.array())))).alias("_files_changed"))
    return [*out, F.min("_ord").alias("_ord"), F.count(F.lit(1)).alias("_n"), F.bool_and("is_vfc").alias("_all"), F.bool_or("is_vfc").alias("_any")]


def _rebuilt(df: DataFrame) -> DataFrame:
    fields = ("message", "diff", "files_changed", "authored_at", "committed_at")
    return df.withColumn("commit", F.struct(*(F.col(f"_{f}").alias(f) for f in fields))).drop(*(f"_{f}" for f in fields))


def merge_groups(entries: DataFrame, *key: str, label: str = "first") -> DataFrame:
    """One entry for each ``key``: sets united, scalars the first known, label, key fields and name from the first.

    One shuffle on the key with map-side combine. NULL keys group together. Categories are united as stored, never
    derived again; NULL only if all are. Carries ``_n``, ``_all`` and ``_any`` (labels) for the caller.
    """
    return _rebuilt(entries.groupBy(*key).agg(*merge_columns(key, label)))


def _agreeing(merged: DataFrame) -> DataFrame:
    return merged.where((F.col("_n") == 1) | (F.col("_all") == F.col("_any"))).drop("_n", "_all", "_any")


def deduplicate_functions(entries: DataFrame) -> DataFrame:
    """One entry per (project, commit, function); groups of contradicting labels are left out whole."""
    return _agreeing(merge_groups(entries, "project_url", "commit_id", "function_name"))


def deduplicate_commits(entries: DataFrame) -> DataFrame:
    """One entry per (project, commit) without function fields; contradicting groups are left out whole."""
    none = F.lit(None).cast("string")
    return _agreeing(merge_groups(entries, "project_url", "commit_id")).withColumns({"function_name": none, "function_file": none})


def collapse_to_commits(entries: DataFrame, include_benign_only: bool = True) -> DataFrame:
    """One entry per (project, commit), a fix if any of its entries is; the function's name goes, its file stays."""
    merged = merge_groups(entries, "project_url", "commit_id", label="any")
    if not include_benign_only:
        merged = merged.where(F.col("is_vfc"))
    return merged.drop("_n", "_all", "_any").withColumn("function_name", F.lit(None).cast("string"))


def deduplicate_related(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Entries of one commit in related repositories as one. ``members``: ``url, group_id, canonical_url``, a row a url.

    An entry alone in its (commit, group) is unchanged; otherwise entries merge under the canonical URL, or the first
    one's if there is none. Repositories without a group pass through. Labels are not compared.
    """
    rows = entries.join(members, entries["project_url"] == members["url"], "left").drop("url")
    key = F.coalesce(F.col("group_id").cast("string"), F.concat(F.lit("#"), F.col("_ord").cast("string")))
    rows = rows.withColumn("_group", key)
    merged = _rebuilt(rows.groupBy("commit_id", "_group").agg(*merge_columns(("commit_id",)), F.min("canonical_url").alias("_canonical")))
    url = F.when(F.col("_n") > 1, F.coalesce("_canonical", "project_url")).otherwise(F.col("project_url"))
    return merged.withColumn("project_url", url).drop("_n", "_all", "_any", "_group", "_canonical")
