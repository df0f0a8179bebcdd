"""Per-key results when a few keys hold most rows, and joins that survive such keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _dense(key: str, sums: list[str]):
    """Adds ``sums`` per ``key`` over one partition: keys become codes, every batch is one ``bincount`` per sum.

    The accumulator is a dense block (code x sum) that grows by doubling; memory follows the distinct keys of the
    partition, never its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict = {}
        block = np.zeros((1024, len(sums)), np.int64)
        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema
            coded = batch.column(batch.schema.get_field_index(key)).dictionary_encode()
            names = coded.dictionary.to_pylist()
            codes = np.asarray(coded.indices.fill_null(len(names)))
            if coded.indices.null_count:
                names.append(None)
            slots = np.fromiter((index.setdefault(x, len(index)) for x in names), np.int64, len(names))
            while len(index) > len(block):
                block = np.concatenate([block, np.zeros_like(block)])
            for j, name in enumerate(sums):
                values = np.asarray(batch.column(batch.schema.get_field_index(name)))
                if int(np.abs(values).max()) < (1 << 53) // len(values):
                    block[slots, j] += np.bincount(codes, weights=values, minlength=len(names)).astype(np.int64)
                else:  # sums beyond the whole numbers of a double
                    np.add.at(block[:, j], slots[codes], values)
        names = list(index)
        for a in range(0, len(names), 10_000):
            some = names[a : a + 10_000]
            columns = [pa.array(some, kind.field(key).type), *(pa.array(block[a : a + len(some), j]) for j in range(len(sums)))]
            yield pa.RecordBatch.from_arrays(columns, [key, *sums])

    return run


def per_key_totals(df: DataFrame, key: str, distinct: Column | None, measures: dict[str, Column], n_rows: str = "n_rows", n_distinct: str = "n_distinct") -> DataFrame:
    """Per value of ``key``: rows, distinct values of ``distinct``, and the sum of each 0/1 or whole-number measure.

    1. Rows are pre-aggregated map-side by (key, distinct value) and hashed by both, so a hot key is cut into as
       many equal splits as there are partitions. 2. Each split encodes its keys in a local dictionary and adds into
       a dense array (numpy ``bincount``). 3. The array blocks, one row for each key and split, are summed in a
       second distributed reduction. No task sees more of a hot key than its share of distinct values.

    Without ``distinct`` there is no first shuffle: the input splits themselves, equal by size, are encoded and added up, and
    no ``n_distinct`` comes out.

    NULL is a key of its own; NULL in ``distinct`` counts as no value; NULL measures count 0. Empty input gives
    no rows. Other columns of ``df`` play no part, whatever their names.
    """
    names = list(measures)
    if distinct is None:
        sums = ["_rows", *(f"_m{i}" for i in range(len(names)))]
        schema = T.StructType([T.StructField("_key", df.schema[key].dataType), *(T.StructField(s, T.LongType()) for s in sums)])
        ones = df.select(F.col(key).alias("_key"), F.lit(1).cast("long").alias("_rows"), *(F.coalesce(m.cast("long"), F.lit(0)).alias(f"_m{i}") for i, m in enumerate(measures.values())))
        total = ones.mapInArrow(_dense("_key", sums), schema).repartition("_key").mapInArrow(_dense("_key", sums), schema)
        return total.select(F.col("_key").alias(key), F.col("_rows").alias(n_rows), *(F.col(f"_m{i}").alias(n) for i, n in enumerate(names)))
    base = df.select(F.col(key).alias("_key"), distinct.alias("_value"), *(F.coalesce(m.cast("long"), F.lit(0)).alias(f"_m{i}") for i, m in enumerate(measures.values())))
    pairs = base.groupBy("_key", "_value").agg(F.count(F.lit(1)).alias("_rows"), *(F.sum(f"_m{i}").alias(f"_m{i}") for i in range(len(names))))
    pairs = pairs.select("_key", "_rows", F.col("_value").isNotNull().cast("long").alias("_values"), *(f"_m{i}" for i in range(len(names))))
    sums = ["_rows", "_values", *(f"_m{i}" for i in range(len(names)))]
    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), *(T.StructField(s, T.LongType()) for s in sums)])
    blocks = pairs.select("_key", *sums).mapInArrow(_dense("_key", sums), schema)
    total = blocks.repartition("_key").mapInArrow(_dense("_key", sums), schema)
    return total.select(F.col("_key").alias(key), F.col("_rows").alias(n_rows), F.col("_values").alias(n_distinct), *(F.col(f"_m{i}").alias(n) for i, n in enumerate(names)))


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """``key`` and its ``n_rows`` where it holds more than ``share`` of the rows (so 1/share rows at most)."""
    total = df.count()
    counts = df.select(F.col(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where(F.col("n_rows") > share * total)


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread: Column, how: str = "left", share: float = 0.002, salts: int = 32) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each ``key``) so that no hot key lands in one task.

    Keys above ``share`` of all rows, 1/share at most, are split over ``salts`` buckets by ``spread`` (any column
    that varies within a key); only their rows of ``table`` are repeated. NULL keys match nothing.
    """
    hot = [r[0] for r in hot_keys(rows, key, share).where(F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.col(key).isin(hot)
    left = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0).cast("long")))
    right = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
