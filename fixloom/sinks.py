"""Entries to files and back: JSON lines with a header, CSV, and a parquet cache."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixloom.functions.commit_text import iso
from fixloom.schema import ENTRY, conform

VERSION = 2


def save_entries(entries: DataFrame, path: str) -> None:
    """A folder of JSON lines: times in ISO form, sets sorted, in order of ``_ord``; the first line is the header.

    Entries are range-sorted, so every file holds a stretch of the order. Nothing to save is an error.
    """
    n = entries.count()
    if not n:
        raise ValueError("no entries to save")
    head = {"_metadata": {"version": VERSION, "schema": [f.name for f in ENTRY if f.name != "_ord"], "created": datetime.now(timezone.utc).isoformat(), "entry_count": n}}
    c = F.col("commit").withField("authored_at", iso(F.col("commit.authored_at"))).withField("committed_at", iso(F.col("commit.committed_at")))
    fields = [F.col(f.name) if f.name != "commit" else c.alias("commit") for f in ENTRY if f.name != "_ord"]
    lines = entries.select("_ord", F.to_json(F.struct(*fields)).alias("value"))
    spark = entries.sparkSession
    header = spark.createDataFrame([(-(2**62), json.dumps(head))], "_ord long, value string")
    header.unionByName(lines).sort("_ord").select("value").write.text(path)


def load_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON lines. A header of another version and malformed JSON are errors; bad entries are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_ord", F.monotonically_increasing_id())
    head = F.get_json_object("value", "$._metadata.version")
    other = lines.select(head.alias("v")).where(F.col("v").isNotNull() & (F.col("v") != str(VERSION))).limit(1).collect()
    if other:
        raise ValueError(f"version {other[0][0]} is not {VERSION}")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTRY if f.name != "_ord")
    rows = lines.where(head.isNull()).select("_ord", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e")).select("_ord", "e.*")
    return conform(rows)


def save_csv(entries: DataFrame, path: str, fields: tuple[str, ...] = ("project_url", "commit_id", "is_vfc", "commit.committed_at")) -> None:
    """CSV with a header: lists joined by ``;``, empty ones blank, sorted by project where that is a column."""
    known = {f.name: f.dataType.simpleString() for f in ENTRY} | {f"commit.{f.name}": f.dataType.simpleString() for f in ENTRY["commit"].dataType}
    if unknown := [f for f in fields if f not in known]:
        raise ValueError(f"unknown fields {unknown}")
    out = []
    for f in fields:
        c = F.col(f)
        kind = known[f]
        value = F.nullif(F.array_join(c.cast("array<string>"), ";"), F.lit("")) if kind.startswith("array") else iso(c) if kind == "timestamp" else F.initcap(c.cast("string")) if kind == "boolean" else c
        out.append(value.alias(f))
    df = entries.select(*out, F.col("_ord"))
    order = ["project_url", "_ord"] if "project_url" in fields else ["_ord"]
    df.sort(*order).drop("_ord").write.option("header", True).csv(path)


def cached(entries: DataFrame, folder: str, key: str) -> DataFrame:
    """The parquet table of ``key``, made from ``entries`` if it is missing; an empty result is not kept."""
    spark = entries.sparkSession
    path = f"{folder}/{key}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.parquet(path)
    if entries.isEmpty():
        return entries
    entries.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
