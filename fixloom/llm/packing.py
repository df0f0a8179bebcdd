"""Documents of varying length into containers of fixed capacity, neighbours on a space-filling curve together."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixloom.runtime import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the byte-level vocabulary splits a text before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
FEATURES, DIMENSIONS, BITS = 256, 3, 10


def _encoding(path: str):
    import tiktoken

    with open(path) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _vectors(path: str):
    made: list = []
    axes = np.random.default_rng(5).standard_normal((FEATURES, DIMENSIONS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(_encoding(path))
        for batch in batches:
            sizes, points = [], np.zeros((len(batch), DIMENSIONS))
            for i, text in enumerate(batch["text"]):
                ids = np.asarray(made[0].encode_ordinary(text), np.int64)
                sizes.append(len(ids))
                if len(ids):
                    hashed = np.log1p(np.bincount((ids * 2654435761 >> 7) % FEATURES, minlength=FEATURES))
                    points[i] = hashed @ axes / np.linalg.norm(hashed)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": sizes} | {f"x{d}": points[:, d] for d in range(DIMENSIONS)})

    return run


def document_points(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens, x0..x2``: tokens of the whole text, and its hashed token vector on three fixed axes."""
    rows = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(_vectors(tokenizer), "doc_id long, n_tokens long, " + ", ".join(f"x{d} double" for d in range(DIMENSIONS)))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with whole coordinates below 2**bits, one row for each point."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the largest cube to the smallest
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _curve(mean: list[float], spread: list[float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = (batch[[f"x{d}" for d in range(DIMENSIONS)]].to_numpy() - mean) / spread
            cells = np.clip(((np.tanh(z * 0.8) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": batch["n_tokens"], "curve": hilbert_keys(cells, BITS)})

    return run


def chosen(sizes: list[int], room: int, slack: int) -> list[int]:
    """Positions of the items that fill ``room`` best, from as few of the first items as leave at most ``slack`` free.

    Sums that the first items can reach are a bit set; items are added in order until one of its sums is near enough.
    """
    reach, history, mask = 1, [], (1 << room + 1) - 1
    for size in sizes:
        history.append(reach)
        reach = (reach | reach << size) & mask
        if room - reach.bit_length() + 1 <= slack:
            break
    total, out = reach.bit_length() - 1, []
    for i in range(len(history) - 1, -1, -1):
        if not history[i] >> total & 1:
            out.append(i)
            total -= sizes[i]
    return out


class Packer:
    """Packs a stretch of the curve for one capacity: the item furthest behind opens a container, neighbours fill it."""

    def __init__(self, capacity: int, ahead: int, slack: float):
        self.capacity, self.ahead, self.slack = capacity, ahead, int(capacity * slack)
        self.waiting: list[tuple] = []
        self.made = 0

    def put(self, item: tuple) -> Iterator[tuple[int, tuple]]:
        """Takes an item (its size first), gives the containers that became full as (container, item)."""
        self.waiting.append(item)
        if len(self.waiting) > self.ahead:
            yield from self.fill()

    def fill(self) -> Iterator[tuple[int, tuple]]:
        first, rest = self.waiting[0], self.waiting[1:]
        taken = set(chosen([i[0] for i in rest], self.capacity - first[0], self.slack))
        box, self.made = self.made, self.made + 1
        yield box, first
        yield from ((box, rest[i]) for i in sorted(taken))
        self.waiting = [item for i, item in enumerate(rest) if i not in taken]

    def close(self) -> Iterator[tuple[int, tuple]]:
        while self.waiting:
            yield from self.fill()


_PACKED = ["target_id", "container_id", "doc_id", "piece", "start_token", "n_tokens", "place"]


def _pack(targets: list[tuple[int, int]], ahead: int, slack: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packers, number = {t: Packer(c, ahead, slack) for t, c in targets}, {t: 0 for t, _ in targets}
        from pyspark import TaskContext

        part, place, out = TaskContext.get().partitionId(), 0, []

        def rows(target: int, placed: Iterator[tuple[int, tuple]]) -> None:
            out.extend((target, f"{part}-{box}", doc, piece, piece * capacity_of[target], n, at) for box, (n, doc, piece, at) in placed)

        capacity_of = dict(targets)
        for batch in batches:
            for doc, n in zip(batch["doc_id"].tolist(), batch["n_tokens"].tolist()):
                for target, capacity in targets:
                    whole = n // capacity if n > capacity else 0
                    for piece in range(whole):
                        out.append((target, f"{part}-full-{number[target]}", doc, piece, piece * capacity, capacity, place))
                        number[target] += 1
                    if n - whole * capacity or not n:
                        rows(target, packers[target].put((n - whole * capacity, doc, whole, place)))
                place += 1
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=_PACKED)
                    out.clear()
        for target, packer in packers.items():
            rows(target, packer.close())
        yield pd.DataFrame(out, columns=_PACKED)

    return run


def packed(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, items_per_task: int = 50_000, ahead: int = 256, slack: float = 1 / 128, most_targets: int = 1_000) -> DataFrame:
    """``target_id, container_id, doc_id, piece, start_token, n_tokens, place``: every token of every document, once for each target.

    Documents become points (hashed token vectors on few axes, centred by the corpus mean), points positions on a
    Hilbert curve, and one range sort by that position makes all targets. Each task packs its stretch of the curve
    along it: the first item not yet packed opens a container, and the nearest of the ``ahead`` items that follow it
    fill it, as many as it takes to leave at most ``slack`` of it free. So a container holds neighbours on the curve,
    and only the end of a stretch leaves any underfilled. ``place`` is a document's rank within its stretch. Copies
    have equal positions; the sort goes on by a hash of the id, so they spread over tasks.

    A text above the capacity is cut into full containers and a rest that is packed like any item; no other text is
    cut. Empty and NULL texts take no tokens and are listed in a container. Repeated rows are packed again; rows
    without ``doc_id`` are left out, as are targets that are NULL or not positive. ``targets`` is a list of
    capacities, checked to be at most ``most_targets``.
    """
    wanted = targets.where("target_id IS NOT NULL AND capacity_tokens > 0").select("target_id", "capacity_tokens").distinct().orderBy("target_id", "capacity_tokens").limit(most_targets + 1).collect()
    if len(wanted) > most_targets:
        raise ValueError(f"more than {most_targets} targets")
    points = written(document_points(documents, tokenizer), "points")
    axes = [f"x{d}" for d in range(DIMENSIONS)]
    facts = points.where("n_tokens > 0").agg(F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(f"m{x}") for x in axes), *(F.stddev_pop(x).alias(f"s{x}") for x in axes)).first()
    mean, spread = [facts[f"m{x}"] or 0.0 for x in axes], [facts[f"s{x}"] or 1.0 for x in axes]
    tasks = max(1, -(-points.count() // items_per_task))
    keyed = points.mapInPandas(_curve(mean, spread), "doc_id long, n_tokens long, curve long").withColumn("spread", F.xxhash64("doc_id"))
    sorted_ = keyed.repartitionByRange(tasks, "curve", "spread").sortWithinPartitions("curve", "spread", "doc_id").select("doc_id", "n_tokens")
    kind = targets.schema["target_id"].dataType.simpleString()
    return sorted_.mapInPandas(_pack([(r[0], int(r[1])) for r in wanted], ahead, slack), f"target_id {kind}, container_id string, doc_id long, piece long, start_token long, n_tokens long, place long")


def fill_report(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``target_id, n_containers, n_tokens, fill, spread, shuffled``.

    ``spread`` is how far apart on the curve the documents of a container lie, as a share of all documents, over the
    containers of two documents or more; ``shuffled`` is what it would be had the documents been put in at random.
    """
    n = documents.where(F.col("doc_id").isNotNull()).count()
    boxes = packed(documents, targets).groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("n"), (F.max("place") - F.min("place")).alias("far"), F.count(F.lit(1)).alias("k"))
    several = F.col("k") > 1
    sums = boxes.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.round(F.avg(F.when(several, F.col("far") / F.lit(max(n, 1)))), 4).alias("spread"),
        F.round(F.avg(F.when(several, (F.col("k") - 1) / (F.col("k") + 1))), 4).alias("shuffled"),
    ).join(F.broadcast(targets), "target_id")
    return sums.select("target_id", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 4).alias("fill"), "spread", "shuffled")


def packing_check(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``target_id, n_documents, n_overfull, n_gaps, n_cut``: documents packed, and what must not occur.

    Containers above the capacity, pieces that do not begin where the one before them ended, and cut documents that a
    container could have held.
    """
    rows = packed(documents, targets).join(F.broadcast(targets.select("target_id", "capacity_tokens")), "target_id")
    over = rows.groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.first("capacity_tokens").alias("c")).groupBy("target_id").agg(F.sum((F.col("n") > F.col("c")).cast("long")).alias("n_overfull"))
    each = rows.groupBy("target_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count(F.lit(1)).alias("k"), F.first("capacity_tokens").alias("c"))
    gaps, cut = (F.col("n") != F.col("end")).cast("long"), ((F.col("k") > 1) & (F.col("n") <= F.col("c"))).cast("long")
    return each.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(gaps).alias("n_gaps"), F.sum(cut).alias("n_cut")).join(over, "target_id").select("target_id", "n_documents", "n_overfull", "n_gaps", "n_cut")
