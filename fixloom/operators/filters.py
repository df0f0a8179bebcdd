"""Filters, relabelling and set operations on entries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixloom.functions.paths import suffix


def unique_diffs(entries: DataFrame) -> DataFrame:
    """One entry for each (diff, files), the first by project, commit and ``_ord``; entries without diff all stay.

    Digests are compared, never the texts. The winner is found by a min over narrow keys with map-side combine, so a
    diff that a third of all entries share needs no sort of them; a join by ``_ord`` brings the rows back.
    """
    key = [F.sha2("commit.diff", 256).alias("_d"), F.when(F.size("commit.files_changed") > 0, F.array_join(F.array_sort("commit.files_changed"), "\n")).alias("_f")]
    rank = F.struct("project_url", "commit_id", "_ord").alias("_rank")
    winners = entries.where(F.col("commit.diff").isNotNull()).select(*key, rank).groupBy("_d", "_f").agg(F.min("_rank").alias("_rank")).select(F.col("_rank._ord").alias("_ord"))
    kept = entries.where(F.col("commit.diff").isNotNull()).join(winners, "_ord", "left_semi")
    return kept.unionByName(entries.where(F.col("commit.diff").isNull()))


def with_extensions(entries: DataFrame, extensions: Iterable[str]) -> DataFrame:
    """Entries that touch a file with one of the suffixes; the function's file counts where no files are known."""
    wanted = sorted({("" if e.startswith(".") else ".") + e.lower() for e in extensions})
    paths = F.when(F.size("commit.files_changed") > 0, F.col("commit.files_changed")).otherwise(F.array("function_file"))
    return entries.where(F.coalesce(F.exists(paths, lambda p: suffix(p).isin(wanted)), F.lit(False)))


def with_diff(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("commit.diff").isNotNull())


def bound_diffs(entries: DataFrame, most: int = 100_000) -> DataFrame:
    """Diffs of more than ``most`` characters become NULL; the other fields stay."""
    return entries.withColumn("commit", F.col("commit").withField("diff", F.when(F.length("commit.diff") <= most, F.col("commit.diff"))))


def moved(entries: DataFrame, table: DataFrame) -> DataFrame:
    """Projects under their new URL, one hop. ``table``: ``old_url, new_url``; Spark broadcasts it if it is small."""
    return entries.join(table, entries["project_url"] == table["old_url"], "left").withColumn("project_url", F.coalesce("new_url", "project_url")).drop("old_url", "new_url")


def reachable(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """Entries whose project is not in ``gone`` (``url``)."""
    return entries.join(gone.select(F.col("url").alias("project_url")), "project_url", "left_anti")


def from_sources(entries: DataFrame, names: Iterable[str]) -> DataFrame:
    """Entries that one of the named sources reported."""
    return entries.where(F.arrays_overlap("src_datasets", F.array(*map(F.lit, names))))


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; ``_ord`` keeps the order of sources, then of rows, and no two rows share one.

    Each source begins after the largest ``_ord`` of the one before it, whatever made these numbers (one aggregate over
    one column a source). Columns that a source lacks are NULL; sources without rows take no room.
    """
    out, start = None, 0
    for df in sources:
        ranked = df.withColumn("_ord", F.lit(start).cast("long") + F.col("_ord"))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
        if df is not sources[-1]:
            start += (df.agg(F.max("_ord")).first()[0] or 0) + 1
    return out


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a declared order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
