"""Records of evaluation splits that the training split holds as well, identically or written otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixloom.operators.commits import commit_entries
from fixloom.operators.skew import hot_keys
from fixloom.runtime import written


def keyed(entries: DataFrame, train: str = "train", held_out: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """``entry_id, split, src_datasets, commit_of, h``: entries of the named splits under their commit's hash, written once."""
    rows = commit_entries(entries, "entry_id", "split", "src_datasets").where(F.col("split").isin(train, *held_out))
    return written(rows.withColumn("h", F.xxhash64("commit_of")), "overlap")


def commit_overlaps(entries: DataFrame, train: str = "train", held_out: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """``commit_of, first_id, n_train, n_held``: a row for each commit that is in ``train`` and held out, however many
    entries have it. The form for reports and removal at any size; ``split_overlaps`` lists the pairs themselves.
    """
    rows = keyed(entries, train, held_out)
    held = F.col("split") != train
    sums = rows.groupBy("h", "commit_of").agg(F.min("entry_id").alias("first_id"), F.sum((~held).cast("long")).alias("n_train"), F.sum(held.cast("long")).alias("n_held"))
    return sums.where("n_train > 0 AND n_held > 0").select("commit_of", "first_id", "n_train", "n_held")


def split_overlaps(entries: DataFrame, train: str = "train", held_out: tuple[str, ...] = ("validation", "test"), share: float = 0.002, salts: int = 32) -> DataFrame:
    """Each pair of entries of one commit, one in ``train`` and one held out: ``held_id, held_split, train_id``.

    Records are canonicalised (case, punctuation, white space, URL forms, shortened ids), hashed, and the held-out
    hashes joined with the training hashes; the canonical text is compared as well, so equal hashes of different
    commits don't count. Both sides carry four narrow columns. A commit above ``share`` of the held-out entries is hot: its
    held-out rows are split over ``salts`` tasks and meet its training rows in each.

    Entries without a commit id, or of another split (NULL included), give no pair; repeated rows give their own
    pairs; an ``entry_id`` of NULL is kept as NULL. Empty input gives no rows.
    """
    cols = ["h", "commit_of", "entry_id", "split"]
    rows = keyed(entries, train, held_out)
    held = rows.where(F.col("split") != train).select(*cols).toDF("h", "commit_of", "held_id", "held_split")
    base = rows.where(F.col("split") == train).select("h", "commit_of", "entry_id").toDF("h", "commit_of", "train_id")
    hot = [r[0] for r in hot_keys(held, "h", share).select("h").collect()]  # 1/share at most
    if hot:
        of, all_ = F.col("h").isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))
        held = held.withColumn("_salt", F.when(of, F.pmod(F.xxhash64("held_id"), F.lit(salts)).cast("int")).otherwise(0))
        base = base.withColumn("_salt", F.explode(F.when(of, all_).otherwise(F.array(F.lit(0)))))
    keys = ["h", "commit_of", *(["_salt"] if hot else [])]
    return held.join(base, keys).select("held_id", "held_split", "train_id")


def found(entries: DataFrame) -> DataFrame:
    """Pairs as ``entry_id_1 < entry_id_2``."""
    pairs = split_overlaps(entries).select(F.least("held_id", "train_id").alias("entry_id_1"), F.greatest("held_id", "train_id").alias("entry_id_2"))
    return pairs.where(F.col("entry_id_1") < F.col("entry_id_2"))


def overlap_report(entries: DataFrame, train: str = "train", held_out: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """``split, src_dataset, n_entries, n_leaked, n_pairs`` of the held-out entries, by each of their sources.

    No pair is built: per commit the training entries are counted first, so a commit with a third of the rows is
    one number. An entry of several sources counts in each. Entries without a recognisable commit id are left out.
    """
    rows = keyed(entries, train, held_out)
    base = rows.where(F.col("split") == train).groupBy("h", "commit_of").agg(F.count(F.lit(1)).alias("n"))
    held = rows.where(F.col("split") != train).join(base, ["h", "commit_of"], "left")
    held = held.groupBy("entry_id", "split", "src_datasets").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    each = held.select("split", F.explode_outer(F.array_distinct("src_datasets")).alias("src_dataset"), "n")
    return each.groupBy("split", "src_dataset").agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum((F.col("n") > 0).cast("long")).alias("n_leaked"), F.sum("n").alias("n_pairs")
    )
