"""Train, validation and test by time, by hash, and by groups."""

from __future__ import annotations

import random
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixloom.runtime import written
from fixloom.sinks import save_csv


def check_ratios(ratios: tuple[float, float, float]) -> None:
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")


def cut_points(n: int, ratios: tuple[float, float, float]) -> tuple[int, int]:
    """Ends of train and validation: products in doubles, truncated."""
    return int(n * ratios[0]), int(n * ratios[0]) + int(n * ratios[1])


def ranked(df: DataFrame, order: list[Column], parts: int = 64) -> DataFrame:
    """``df`` with ``_rank`` from 0 by a total order, without ever sorting in one task.

    Narrow rows are range-partitioned and written; ranks are counted within each range and offset by the sizes of
    the ranges before it (``parts`` numbers on the driver).
    """
    # ranges hold contiguous stretches of the order
    placed = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = {r[0]: r[1] for r in placed.groupBy("_part").count().collect()}
    offsets, total = {}, 0
    for part in sorted(sizes):
        offsets[part], total = total, total + sizes[part]
    if not sizes:
        return placed.drop("_part").withColumn("_rank", F.lit(0).cast("long"))
    base = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv))[F.col("_part")]
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_rank", (within + base).cast("long")).drop("_part")


def _labelled(df: DataFrame, ratios: tuple[float, float, float]) -> DataFrame:
    train, val = cut_points(df.count(), ratios)
    return df.withColumn("split", F.when(F.col("_rank") < train, "train").when(F.col("_rank") < val, "validation").otherwise("test")).drop("_rank")


def temporal_split(entries: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """``_ord, split``: the oldest commits train, the newest test; a missing ``committed_at`` is an error."""
    check_ratios(ratios)
    rows = entries.select("_ord", F.col("commit.committed_at").alias("at"))
    if not rows.where(F.col("at").isNull()).isEmpty():
        raise ValueError("every entry needs committed_at")
    return _labelled(ranked(rows, [F.col("at"), F.col("_ord")]), ratios).select("_ord", "split")


def hash_split(entries: DataFrame, seed: int, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """``_ord, split`` in an order shuffled by a hash of seed and row; exact proportions, repeatable for a seed."""
    check_ratios(ratios)
    rows = entries.select("_ord", F.xxhash64(F.lit(seed), "project_url", "commit_id", "_ord").alias("h"))
    return _labelled(ranked(rows, [F.col("h"), F.col("_ord")]), ratios).select("_ord", "split")


def shuffled_split(entries: DataFrame, seed: int, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), most: int = 5_000_000) -> DataFrame:
    """``_ord, split`` by the generator's own shuffle of the input order; for inputs of at most ``most`` rows."""
    check_ratios(ratios)
    ords = [r[0] for r in entries.select("_ord").orderBy("_ord").limit(most + 1).collect()]
    if len(ords) > most:
        raise ValueError("too many rows for an exact shuffle; use hash_split")
    random.Random(seed).shuffle(ords)
    train, val = cut_points(len(ords), ratios)
    rows = [(o, "train" if i < train else "validation" if i < val else "test") for i, o in enumerate(ords)]
    return entries.sparkSession.createDataFrame(rows, "_ord long, split string")


def binary_counts(groups: dict[int, int], ratio: float, seed: int) -> dict[int, int]:
    """How many groups of each size (``size: groups``) make the first part.

    Each size gives its share, rounded at random and carried on from the largest to the smallest; then moves and swaps
    of any two sizes as long as one brings the rows closer to ``ratio``.
    """
    rng, taken = random.Random(seed), {}
    target, total, seen = ratio * sum(n * k for n, k in groups.items()), 0, 0
    for n in sorted(groups, reverse=True):
        seen += n * groups[n]
        share = min((ratio * seen - total) / n + rng.random(), (target - total) / n + 0.5) if n > 0 else ratio * groups[n]
        taken[n] = min(max(int(share), 0), groups[n])
        total += n * taken[n]
    while True:
        gap = target - total
        inside, outside = sorted(n for n in groups if taken[n] > 0), sorted(n for n in groups if taken[n] < groups[n])
        steps = [(abs(gap + a), a, 0) for a in inside] + [(abs(gap - b), 0, b) for b in outside]
        for a in inside:
            i = bisect_left(outside, a + gap)
            steps += [(abs(gap - (b - a)), a, b) for b in outside[max(i - 1, 0) : i + 1]]
        best, a, b = min(steps, default=(abs(gap), 0, 0))
        if best >= abs(gap) - 1e-9:
            return taken
        total += b - a
        if a:
            taken[a] -= 1
        if b:
            taken[b] += 1


def _places(groups: dict[int, int], seed: int, ratios: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """For each size, from the largest: up to which rank its groups train, and up to which they train or validate."""
    rng = random.Random(seed)
    rest = binary_counts(groups, ratios[0] + ratios[1], rng.randrange(2**31))
    train = binary_counts(rest, ratios[0] / max(ratios[0] + ratios[1], 1e-9), rng.randrange(2**31))
    ends, start = [], 0
    for n in sorted(groups, reverse=True):
        ends.append((n, start + train[n], start + rest[n]))
        start += groups[n]
    return ends


def seeded_splits(sizes: DataFrame, seeds: list[int], ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """``seed, group_key, split`` for any number of groups (``group_key, n``): test first, then train and validation.

    Groups of one size are alike, so the driver sees only how many groups each size has and decides for each seed how
    many of them go where; that is at most the root of twice the number of rows. Which ones is said by a hash of seed and
    key: groups are ranked by seed, size and hash without sorting in one task, and take their split by their place
    within the size. All seeds share one sort.
    """
    check_ratios(ratios)
    base = written(sizes.select("group_key", "n"), "groups")
    groups = {r["n"]: r["k"] for r in base.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    total = sum(groups.values())
    ends = [(seed, n, i * total + train, i * total + rest) for i, seed in enumerate(sorted(seeds)) for n, train, rest in _places(groups, seed, ratios)]
    table = sizes.sparkSession.createDataFrame(ends, "seed long, n long, _train long, _rest long")
    each = base.withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in sorted(seeds))))).withColumn("_h", F.xxhash64("seed", "group_key"))
    placed = ranked(each, [F.col("seed"), F.desc("n"), F.col("_h"), F.col("group_key")])
    split = F.when(F.col("_rank") < F.col("_train"), "train").when(F.col("_rank") < F.col("_rest"), "validation").otherwise("test")
    return placed.join(table, ["seed", "n"]).select("seed", "group_key", split.alias("split"))


def group_stratified_split(sizes: DataFrame, seed: int, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """``group_key, split`` of one seed; see ``seeded_splits``."""
    return seeded_splits(sizes, [seed], ratios).select("group_key", "split")


def split_scores(groups: DataFrame, *keys: str) -> DataFrame:
    """``keys, commits_per_project_balance, vfc_ratio_balance, combined_score`` of splits; the lower the better.

    ``groups``: ``split, n, n_vfc`` (and ``keys``), a row for each group of related projects in a split. A balance is
    the largest relative deviation of a split from the mean of the splits, of entries per group and of fixes per
    entry; the score weighs them 0.4 and 0.6. The three splits count even if one is empty, with 0.
    """
    sums = groups.groupBy(*keys, "split").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("n_vfc").alias("v"))
    at = lambda value, s: F.coalesce(F.max(F.when(F.col("split") == s, value)), F.lit(0.0))
    wide = sums.groupBy(*keys).agg(*(at(v, s).alias(f"_{m}{i}") for m, v in (("p", F.col("n") / F.col("k")), ("r", F.col("v") / F.col("n"))) for i, s in enumerate(("train", "validation", "test"))))

    def balance(m: str) -> Column:
        parts = [F.col(f"_{m}{i}") for i in range(3)]
        mean = (parts[0] + parts[1] + parts[2]) / 3
        return F.when(mean > 0, F.greatest(*(F.abs(p - mean) for p in parts)) / mean).otherwise(F.lit(0.0))

    scored = wide.select(*keys, balance("p").alias("commits_per_project_balance"), balance("r").alias("vfc_ratio_balance"))
    return scored.withColumn("combined_score", 0.4 * F.col("commits_per_project_balance") + 0.6 * F.col("vfc_ratio_balance"))


def top_splits(sizes: DataFrame, seeds: int = 50, top: int = 3, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> tuple[DataFrame, DataFrame]:
    """The ``top`` best of the splits of seeds 1 to ``seeds``: their scores, and ``seed, group_key, split`` of them.

    ``sizes``: ``group_key, n, n_vfc``. All seeds are placed and scored in one pass over groups x seeds narrow rows; ties go
    to the smaller seed.
    """
    placed = written(seeded_splits(sizes, list(range(1, seeds + 1)), ratios), "seeds")
    scores = split_scores(placed.join(sizes.select("group_key", "n", "n_vfc"), "group_key"), "seed").orderBy("combined_score", "seed").limit(top)
    scores = written(scores, "scores")
    return scores, placed.join(F.broadcast(scores.select("seed")), "seed", "left_semi")  # ``top`` rows


def split_report(groups: DataFrame, most: int = 10) -> list[str]:
    """Lines of text on splits: shares, counts and the ``most`` largest groups of each with a bar.

    ``groups``: ``split, name, n, n_vfc, n_urls``. Groups below the upper quartile of all sizes are counted, not named. The
    driver sees ``most`` groups and two sums for each split.
    """
    cut = groups.agg(F.percentile_approx("n", 0.75, 10_000).alias("cut"), F.max("n").alias("top"), F.sum("n").alias("n")).first()
    if not cut["n"]:
        return ["Empty split"]
    large = F.col("n") >= cut["cut"]
    sums = groups.groupBy("split").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("n_urls").alias("u"), F.sum("n_vfc").alias("v"), F.sum(large.cast("long")).alias("nl"), F.sum(F.when(large, F.col("n")).otherwise(0)).alias("l"))
    of = {r["split"]: r for r in sums.collect()}
    rank = F.row_number().over(Window.partitionBy("split").orderBy(F.desc("n"), "name"))
    named: dict[str, list] = {}
    for r in groups.where(large).withColumn("_rn", rank).where(F.col("_rn") <= most).orderBy("split", "_rn").collect():
        named.setdefault(r["split"], []).append(r)
    lines: list[str] = []
    for label in ("train", "validation", "test"):
        lines += [""] if lines else []
        if label not in of:
            lines += [f"{label} (0.0%) - 0 commits", "-" * 70, "  (empty)"]
            continue
        r, shown = of[label], named.get(label, [])
        lines += [f"{label} ({100 * r['n'] / cut['n']:.1f}%) - {r['n']:,} commits, {r['k']:,} projects, {r['u']:,} repos - fixes: {100 * r['v'] / r['n']:.1f}%", "-" * 70]
        lines += [f"  {'#' * max(1, int(30 * g['n'] / cut['top']))} {g['name']}{' [%d repos]' % g['n_urls'] if g['n_urls'] > 1 else ''} ({g['n']:,})" for g in shown]
        rest = r["l"] - sum(g["n"] for g in shown)
        lines += [f"  ... {r['nl'] - len(shown)} more large projects ({rest:,} commits)"] if r["nl"] > len(shown) else []
        lines += [f"  ... {r['k'] - r['nl']:,} small projects ({r['n'] - r['l']:,} commits)"] if r["k"] > r["nl"] else []
    return lines


def write_splits(entries: DataFrame, splits: DataFrame, folder: str, name: str, kind: str) -> None:
    """A CSV for each of train, validation and test: ``folder/name-kind-split.csv``. ``splits``: ``_ord, split``."""
    placed = written(entries.join(splits.select("_ord", "split"), "_ord"), "splits", "split")
    for split in ("train", "validation", "test"):
        save_csv(placed.where(F.col("split") == split).drop("split"), f"{folder}/{name}-{kind}-{split}.csv")
