"""What a source is: raw inputs with explicit schemas, and a parse that Catalyst can push into them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixloom.functions import commit_text, ids
from fixloom.functions.owasp import owasp_of
from fixloom.schema import ENTRY, as_set


@dataclass(frozen=True)
class Raw:
    """One input: format (csv, json, jsonl, text, whole, parquet, jdbc), schema in DDL, reader options."""

    format: str
    schema: str = ""
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Source:
    name: str
    granularity: str
    inputs: dict[str, Raw]
    parse: Callable[..., DataFrame]


def read_raw(spark: SparkSession, raw: Raw, path: str | list[str], options: dict | None = None) -> DataFrame:
    """Rows of one input with ``_row``, their order within it (by file and position, as far as files keep one).

    ``options`` come before the input's own. A database table is named by ``path`` and reached by the option ``url``.
    """
    reader = spark.read.options(**(raw.options | (options or {})))
    if raw.format == "jdbc" and "url" not in (options or {}):
        raise ValueError("a database input needs the option url")
    if raw.format == "jdbc":
        df = reader.format("jdbc").option("dbtable", path).load()
    elif raw.format == "text":
        df = reader.text(path)
    elif raw.format == "whole":
        df = reader.text(path, wholetext=True)
    elif raw.format == "parquet":
        df = reader.parquet(*([path] if isinstance(path, str) else path))
        df = df.select(*(F.col(c) for c in df.columns))
    elif raw.format == "csv":
        df = reader.option("header", raw.options.get("header", True)).option("multiLine", True).option("escape", '"').schema(raw.schema).csv(path)
    else:
        df = reader.option("multiLine", raw.format == "json").schema(raw.schema).json(path)
    return df.withColumn("_row", F.monotonically_increasing_id())


def array_of(value: Column) -> Column:
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


def entries_of(df: DataFrame, source: str, where: Column, is_vfc: Column | None = None, cves: Column | None = None, cwes: Column | None = None, name: Column | None = None, file: Column | None = None, ghsa: Column | None = None, commit: Column | None = None) -> DataFrame:
    """Entries out of raw rows. ``where``: ``struct<project_url, commit_id>``; rows without either are left out."""
    text, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    empty = commit_text.commit_struct(text, text, none, F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"))
    weak = none if cwes is None else ids.cwe_set(cwes)
    rows = df.select(
        where.alias("_w"), F.array(F.lit(source)).alias("src_datasets"), F.coalesce(F.lit(True) if is_vfc is None else is_vfc, F.lit(False)).alias("is_vfc"),
        (none if cves is None else ids.cve_set(cves)).alias("cve_ids"), weak.alias("cwe_ids"), (text if name is None else name).alias("function_name"),
        (text if file is None else file).alias("function_file"), (text if ghsa is None else ghsa).alias("ghsa_id"), (empty if commit is None else commit).alias("commit"), F.col("_row").alias("_ord"),
    )
    kept = rows.where(F.col("_w.project_url").isNotNull() & F.coalesce(F.col("_w.commit_id").rlike(r"^[0-9a-f]{5,40}\z"), F.lit(False)))
    out = kept.withColumns({"project_url": F.col("_w.project_url"), "commit_id": F.col("_w.commit_id"), "src_datasets": as_set(F.col("src_datasets")), "owasp_categories": F.when(F.size("cwe_ids") > 0, owasp_of(F.col("cwe_ids")))})
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in ENTRY))
