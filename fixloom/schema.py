"""The typed entry every curation operator works on, and the checks a row must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixloom.functions.ids import commit_id, valid_cves, valid_cwes
from fixloom.functions.giturl import https_url
from fixloom.functions.owasp import owasp_of

_STRINGS = T.ArrayType(T.StringType())
COMMIT = T.StructType([
    T.StructField("message", T.StringType()), T.StructField("diff", T.StringType()), T.StructField("files_changed", _STRINGS),
    T.StructField("authored_at", T.TimestampType()), T.StructField("committed_at", T.TimestampType()),
])
ENTRY = T.StructType([
    T.StructField("project_url", T.StringType()), T.StructField("commit_id", T.StringType()), T.StructField("src_datasets", _STRINGS),
    T.StructField("is_vfc", T.BooleanType()), T.StructField("cve_ids", _STRINGS), T.StructField("cwe_ids", _STRINGS),
    T.StructField("function_name", T.StringType()), T.StructField("function_file", T.StringType()), T.StructField("ghsa_id", T.StringType()),
    T.StructField("owasp_categories", T.ArrayType(T.IntegerType())), T.StructField("commit", COMMIT), T.StructField("_ord", T.LongType()),
])


def as_set(values: Column) -> Column:
    """An array as a set: sorted, distinct, without NULL; NULL becomes empty."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(values, F.array()))))


def reject_reason(raw_commit: Column, commit: Column, url: Column, sources: Column) -> Column:
    """Why a row is no entry, or NULL: the checks in their fixed order, on the normalised commit id and URL."""
    return (
        F.when(F.coalesce(F.trim(raw_commit), F.lit("")) == "", "blank commit id")
        .when(~F.coalesce(commit.rlike(r"^[0-9a-f]{5,40}\z"), F.lit(False)), "bad commit id")
        .when(url.isNull(), "bad project url")
        .when(F.coalesce(F.size(sources), F.lit(0)) < 1, "no source")
    )


def conform(df: DataFrame, on_invalid: str = "drop") -> DataFrame:
    """Rows as entries: identifiers normalised, sets sorted, ids that don't match their pattern left out.

    Categories are derived from the weakness ids only where none are given. ``on_invalid``: ``drop`` leaves rows
    out that fail a check, ``fail`` makes the job fail. Extra columns are kept.
    """
    named = df.withColumns({"_url": https_url(F.col("project_url")), "_commit": commit_id(F.col("commit_id"))})
    checked = named.withColumn("_why", reject_reason(F.col("commit_id"), F.col("_commit"), F.col("_url"), F.col("src_datasets")))
    if on_invalid == "fail":
        checked = checked.where(F.when(F.col("_why").isNotNull(), F.raise_error(F.col("_why")).cast("boolean")).otherwise(F.lit(True)))
    else:
        checked = checked.where(F.col("_why").isNull())
    out = checked.withColumns({
        "project_url": F.col("_url"), "commit_id": F.col("_commit"), "src_datasets": as_set(F.col("src_datasets")),
        "is_vfc": F.coalesce("is_vfc", F.lit(True)), "cve_ids": as_set(valid_cves(F.col("cve_ids"))), "cwe_ids": as_set(valid_cwes(F.col("cwe_ids"))),
    }).drop("_why", "_url", "_commit")
    derived = F.when(F.col("owasp_categories").isNull() & (F.size("cwe_ids") > 0), owasp_of(F.col("cwe_ids")))
    return out.withColumn("owasp_categories", F.coalesce(F.array_sort(F.array_distinct("owasp_categories")), derived))
