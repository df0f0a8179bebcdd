"""Duplicates hidden by formatting: records that differ in case, white space, punctuation or field order only."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixloom.operators.skew import salted_join
from fixloom.runtime import written

SEGMENT_BITS = 1 << 20
BLOCK_WORDS = 64
# Blocks of the filter that are tested against at a time: 512 bytes each, so some 50 MB are broadcast at most.
SLICE_BLOCKS = 100_000

_SPACE = r"[\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+"
_SLASHES = r"/{2,}"
_EDGES = r"^[^\p{L}\p{N}]+|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$"
_NAME = r"""\s*+["']?([\p{L}_][\p{L}\p{N}_.-]*+)["']?\s*+(?:=>|[:=])"""
# A field of a record in braces: a value in quotes, in brackets, or bare up to the next comma.
_INSIDE = _NAME + r"""\s*+("[^"]*+"|'[^']*+'|\[[^\[\]]*+\]|\{[^{}]*+\}|[^,"'\[\]{}]*+)\s*+(?=[,}]|\z)"""
_BRACES, _HUSK = r"(?s)^\s*\{.*\}[\s,;]*\z", r"(?s)^\s*\{[\s,]*\}[\s,;]*\z"
_PLAIN = rf"(?s)^{_NAME}(.*)\z"
# Escaped quotes, and the end of a field, have signs of their own.
_DOUBLE, _SINGLE, _END = "\ue000", "\ue001", "\ue002"


def canonical_value(value: Column) -> Column:
    """Lower case, no white space, runs of slashes as one, no punctuation around it. NULL stays NULL; punctuation within a value counts."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(value), _SPACE, ""), _SLASHES, "/"), _EDGES, "")


def _field(name: Column, value: Column) -> Column:
    """``name=value``; a list or an object keeps its brackets, so that it differs from its only member."""
    plain = F.trim(value)
    nested = F.replace(F.lower(F.regexp_replace(plain, _SPACE, "")), F.lit("'"), F.lit('"'))
    return F.concat(F.lower(name), F.lit("="), F.when(plain.rlike(r"^[\[{]"), nested).otherwise(canonical_value(value)))


def _sorted(fields: Column) -> Column:
    return F.array_join(F.array_sort(fields), "\n")


def _inside_braces(text: Column) -> Column:
    """The fields of ``{...}``; NULL if anything but commas is left beside them, so that no character is lost."""
    names, values = (F.regexp_extract_all(text, F.lit(_INSIDE), F.lit(i)) for i in (1, 2))
    whole = text.rlike(_BRACES) & F.regexp_replace(text, _INSIDE, "").rlike(_HUSK)
    return F.when(whole, _sorted(F.zip_with(names, values, _field)))


def _separated(text: Column) -> Column:
    """The fields of lines, ``k: v | k: v``, ``k=v;k=v`` or ``k=v,k=v``; NULL if a part has no name.

    The first of line end, ``|``, ``;`` and ``,`` that occurs separates; the others belong to the values. A comma that
    no name follows belongs to the value before it.
    """
    ends = (
        F.when(text.contains("\n"), F.regexp_replace(text, r"[,;|]?[^\S\n]*+\n", _END)).when(text.contains("|"), F.replace(text, F.lit("|"), F.lit(_END)))
        .when(text.contains(";"), F.replace(text, F.lit(";"), F.lit(_END))).otherwise(F.regexp_replace(text, rf",(?={_NAME})", _END))
    )
    parts = F.filter(F.split(ends, _END), lambda p: p.rlike(r"[^\s,;]"))
    fields = F.transform(parts, lambda p: F.when(p.rlike(_PLAIN), _field(F.regexp_extract(p, _PLAIN, 1), F.regexp_extract(p, _PLAIN, 2))))
    return F.when(~F.exists(fields, lambda f: f.isNull()), _sorted(fields))


def canonical_fields(text: Column) -> Column:
    """The fields of a record written as JSON, ``k=v;``, ``k: v |``, lines or ``'k' => 'v'``: sorted ``name=value``.

    A text of any other build, and one of which these forms leave a character out (nested deeper than one level, a
    part without a name, text after the closing brace), stands for itself as a whole: it is the same as another one
    only if both differ in case and white space alone.
    """
    marked = F.replace(F.replace(text, F.lit('\\"'), F.lit(_DOUBLE)), F.lit("\\'"), F.lit(_SINGLE))
    unnamed = F.concat(F.lit("\u0002"), F.lower(F.regexp_replace(text, _SPACE, "")))
    return F.coalesce(F.when(F.ltrim(marked).startswith("{"), _inside_braces(marked)).otherwise(_separated(marked)), unnamed)


def canonical_record(project_url: Column, commit_id: Column, extra: Column) -> Column:
    """One text per record; two records are the same if and only if these texts are equal."""
    none = lambda c: F.coalesce(c, F.lit("\u0000"))  # noqa: E731  NULL is not the empty text
    return F.concat_ws("\u0001", none(canonical_value(project_url)), none(canonical_value(commit_id)), none(canonical_fields(extra)))


def _pack(at: np.ndarray) -> bytes:
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64))


def _partition_filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Both filters of one partition, by segment: bits set at least once, bits set again by another record."""
    parts = [np.concatenate([b["bit1"].to_numpy(), b["bit2"].to_numpy()]) for b in batches]
    if not parts:
        return
    at, times = np.unique(np.concatenate(parts), return_counts=True)
    segment = at // SEGMENT_BITS
    cuts = np.flatnonzero(np.diff(segment)) + 1
    rows = []
    for inside, often in zip(np.split(at, cuts), np.split(times, cuts), strict=True):
        if len(inside):
            local = inside % SEGMENT_BITS
            rows.append((int(inside[0] // SEGMENT_BITS), _pack(local), _pack(local[often > 1])))
    yield pd.DataFrame(rows, columns=["segment", "once", "again"])


def _merge_segment(pdf: pd.DataFrame) -> pd.DataFrame:
    once, again = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for first, more in zip(pdf["once"], pdf["again"], strict=True):
        at = _unpack(first)
        again[at[once[at]]] = True
        once[at] = True
        again[_unpack(more)] = True
    words = np.packbits(again, bitorder="little").view("<i8").reshape(-1, BLOCK_WORDS)
    used = np.flatnonzero(words.any(axis=1))
    return pd.DataFrame({"block": used + int(pdf["segment"].iloc[0]) * len(words), "bits": list(words[used])})


def repeat_filter(hashes: DataFrame) -> DataFrame:
    """``block, bits`` (64 words of 64 bits) of the Bloom filter of repeatedly seen hashes, from rows with ``bit1`` and ``bit2``.

    Every partition builds a filter of the hashes it saw and one of those it saw again, as sorted bit positions cut
    into segments of a fixed number of bits. Partials of a segment are merged in one task of 2 MB: a bit set by two
    partitions is set again. Only blocks of the second filter that have a bit come out. No filter is ever whole anywhere.
    """
    partial = hashes.select("bit1", "bit2").mapInPandas(_partition_filters, "segment long, once binary, again binary")
    return partial.groupBy("segment").applyInPandas(_merge_segment, "block long, bits array<long>")


def hashed(records: DataFrame, bits_per_record: int = 16, slice_blocks: int = SLICE_BLOCKS) -> tuple[DataFrame, int]:
    """``raw_id, digest, block, word, mask, bit1, bit2, slice``: the canonical hash of each record and its two bits.

    Written once, a folder for each slice of the filter (as many as come out second), each task its own rows.
    """
    text = canonical_record(F.col("project_url"), F.col("commit_id"), F.col("extra"))
    blocks = max(1, -(-records.count() * bits_per_record // (64 * BLOCK_WORDS)))
    rows = records.select("raw_id", text.alias("_t")).select("raw_id", F.unhex(F.sha2("_t", 256)).alias("digest"), F.xxhash64("_t").alias("_h"))
    low = F.pmod(F.xxhash64("_h", F.lit(1)), F.lit(64 * 63))
    one, other = F.pmod(low, F.lit(64)), F.pmod(F.pmod(low, F.lit(64)) + 1 + F.floor(low / 64), F.lit(64))
    placed = rows.select("raw_id", "digest", F.pmod(F.col("_h"), F.lit(blocks * BLOCK_WORDS)).alias("word"), one.alias("_a"), other.alias("_b"))
    mask = F.expr("shiftleft(1L, CAST(_a AS INT)) | shiftleft(1L, CAST(_b AS INT))")
    block = F.floor(F.col("word") / BLOCK_WORDS)
    out = placed.select(
        "raw_id", "digest", block.alias("block"), F.pmod(F.col("word"), F.lit(BLOCK_WORDS)).cast("int").alias("word"), mask.alias("mask"),
        (F.col("word") * 64 + F.col("_a")).alias("bit1"), (F.col("word") * 64 + F.col("_b")).alias("bit2"), F.floor(block / slice_blocks).alias("slice"),
    )
    return written(out, "hashed", "slice"), -(-blocks // slice_blocks)


def possible_repeats(records: DataFrame, slice_blocks: int = SLICE_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """Records that may have a copy, and records that certainly have none (``raw_id, digest`` both).

    The filter is tested slice by slice: a slice of at most ``slice_blocks`` blocks is broadcast, and the records of
    its folder, those that hash into it, are judged where they lie. So no record is shuffled, whatever their number,
    and what is broadcast does not grow with it; a slice holds 25 million records.
    """
    rows, slices = hashed(records, slice_blocks=slice_blocks)
    repeats = written(repeat_filter(rows).withColumn("slice", F.floor(F.col("block") / slice_blocks)), "filter", "slice")
    maybe = F.coalesce(F.get("bits", F.col("word")).bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    tested = None
    for k in range(slices):
        part = rows.where(F.col("slice") == k).join(F.broadcast(repeats.where(F.col("slice") == k).select("block", "bits")), "block", "left")
        part = written(part.select("raw_id", "digest", maybe.alias("maybe")), "tested")
        tested = part if tested is None else tested.unionByName(part)
    return tested.where("maybe").select("raw_id", "digest"), tested.where("NOT maybe").select("raw_id", "digest")


def collapsed(records: DataFrame, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """``first_id, n_copies``: each record once, under its smallest ``raw_id``, and how many rows wrote it.

    Only records that the filters call possible repeats are shuffled for exact grouping (by the 256-bit digest of
    the canonical text), with map-side counts, so a record with a third of all rows is no burden; all others come
    out as they are. NULL in a column differs from empty text. Empty input gives no rows.
    """
    maybe, single = possible_repeats(records, slice_blocks)
    groups = maybe.groupBy("digest").agg(F.min("raw_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return groups.select("first_id", "n_copies").unionByName(single.select(F.col("raw_id").alias("first_id"), F.lit(1).cast("long").alias("n_copies")))


def copies(records: DataFrame, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """``first_id, raw_id``: every row but the first of each record that occurs more than once."""
    maybe, _ = possible_repeats(records, slice_blocks)
    groups = maybe.groupBy("digest").agg(F.min("raw_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_id")
    return salted_join(maybe, groups, "digest", F.col("raw_id"), "inner").where("raw_id <> first_id").select("first_id", "raw_id")
