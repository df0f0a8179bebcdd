"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixloom.functions.identity import commit_key, repo_key
from fixloom.llm.components import connected_components
from fixloom.operators.skew import salted_join
from fixloom.runtime import written

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def project_groups(keys: DataFrame) -> DataFrame:
    """``project, group_url`` (from rows with ``project`` and ``c``, a full commit id) for the projects that a shared commit links to another, directly or over others.

    A shortened id counts only within its project, whose entries are together anyway, so full ids suffice. The
    distinct (project, commit) pairs are small next to the rows; a commit of many projects links each of them to
    its smallest, not to one another.
    """
    pairs = keys.where("project IS NOT NULL AND c IS NOT NULL").select("project", "c").distinct()
    shared = pairs.groupBy("c").agg(F.min("project").alias("first"), F.max("project").alias("last")).where("first <> last")
    edges = pairs.join(shared, "c").where("project <> first").select("first", "project").distinct()
    return connected_components(edges, "first", "project").toDF("project", "group_url")


def entry_groups(entries: DataFrame, *keep: str) -> DataFrame:
    """Every entry with its ``group_url``, the smallest project it belongs with; ``keep`` are carried along.

    An entry without a recognisable project but with a full commit id of a project's entries goes with them; else
    full ids of their own, and then each entry, form a group (``#`` and the id). Hot projects are salted.
    """
    commit = commit_key(F.col("commit_id"))
    keys = written(entries.select("entry_id", *keep, repo_key(F.col("project_url")).alias("project"), F.when(F.length(commit) == 40, F.unhex(commit)).alias("c")), "keys")
    groups = project_groups(keys)
    named = salted_join(keys.where(F.col("project").isNotNull()).drop("c"), groups, "project", F.col("entry_id"))
    named = named.select("entry_id", *keep, F.coalesce("group_url", "project").alias("group_url"))
    lost = keys.where(F.col("project").isNull())
    if lost.isEmpty():
        return named
    owners = keys.where("c IS NOT NULL AND project IS NOT NULL").join(lost.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.min("project").alias("project"))
    lost = lost.drop("project").join(owners, "c", "left").join(groups, "project", "left")
    alone = F.concat(F.lit("#"), F.coalesce(F.lower(F.hex("c")), F.concat(F.lit("entry "), F.coalesce(F.col("entry_id").cast("string"), F.lit("")))))
    return named.unionByName(lost.select("entry_id", *keep, F.coalesce("group_url", "project", alone).alias("group_url")))


def place(units: list[tuple[dict[str, int], int]], shares: dict[str, float]) -> list[str]:
    """Grouped iterative stratification: a split for each unit (its label counts, its rows).

    The rarest outstanding label first; of its units the largest first; each into the split that still needs most of
    that label, then most rows. ``units`` is a list of bounded length.
    """
    total, rows = {}, sum(n for _, n in units)
    for labels, _ in units:
        for k, n in labels.items():
            total[k] = total.get(k, 0) + n
    need = {s: {k: n * share for k, n in total.items()} for s, share in shares.items()}
    room = {s: rows * share for s, share in shares.items()}
    left, out = dict(total), [""] * len(units)
    has: dict[str, list[int]] = {k: [] for k in total}
    for i, (labels, _) in enumerate(units):
        for k in labels:
            has[k].append(i)
    while any(not x for x in out):
        open_ = {k: n for k, n in left.items() if n > 0}
        rarest = min(open_, key=lambda k: (open_[k], k)) if open_ else None
        todo = [i for i in (has[rarest] if rarest is not None else range(len(units))) if not out[i]]
        for i in sorted(todo, key=lambda i: (-units[i][1], i)):
            labels, n = units[i]
            fits = [s for s in shares if room[s] >= n] or list(shares)
            out[i] = max(fits, key=lambda s: (need[s].get(rarest, 0) / max(shares[s], 1e-9) if rarest else 0, room[s] / max(shares[s], 1e-9)))
            room[out[i]] -= n
            for k, m in labels.items():
                need[out[i]][k] -= m
                left[k] -= m
        if rarest is not None:
            left[rarest] = 0
    return out


def labelled(rows: DataFrame, kept: int = 32, shared: int = 8) -> DataFrame:
    """``group_url, label`` for each label of each entry (NULL: the entry itself): fix or other, and its sources.

    The ``kept`` sources with most entries are labels of their own, all others share ``shared`` labels by hash, so there
    are at most ``kept`` + ``shared`` + 2 labels however many sources report.
    """
    sources = F.array_distinct(F.coalesce("src_datasets", F.array().cast("array<string>")))
    counts = rows.select(F.explode(sources).alias("s")).where("s IS NOT NULL").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    own = sorted(r[0] for r in counts.orderBy(F.desc("n"), "s").limit(kept).collect())
    source = lambda s: F.when(s.isin(own), F.concat(F.lit("src "), s)).otherwise(F.concat(F.lit("srcs "), F.pmod(F.xxhash64(F.coalesce(s, F.lit(""))), F.lit(shared)).cast("string")))
    marks = F.concat(F.array(F.lit(None), F.when(F.col("is_vfc"), "fix").otherwise("other")), F.array_distinct(F.transform(sources, source)))
    return rows.select("group_url", F.explode(marks).alias("label"))


def grouped_split(entries: DataFrame, shares: dict[str, float] | None = None, buckets: int = 256, heavy: float = 0.002) -> DataFrame:
    """``entry_id, group_url, split``: no project, and no commit that several projects share, in two splits.

    1. Groups are components of projects and shared commits. 2. Each group's label vector (fixes, others, and each
    source; see ``labelled``) is aggregated. 3. Groups above ``heavy`` of all rows, 1/heavy at most, are placed one by
    one; all others are gathered by their rarest label into ``buckets`` hash buckets each, and a bucket is placed as
    one unit. So the driver sees the sums of 1/heavy + 42 x ``buckets`` units and 42 labels at most, however many
    groups there are, and every group is placed. 4. Groups get their split by a join; entries follow their group (salted).

    Entries without project and commit are groups of their own. Empty input gives no rows.
    """
    rows = written(entry_groups(entries, "is_vfc", "src_datasets"), "grouped")
    placed = group_splits(rows, shares or SPLITS, buckets, heavy)
    return salted_join(rows.select("entry_id", "group_url"), placed, "group_url", F.col("entry_id"), "inner").select("entry_id", "group_url", "split")


def group_splits(rows: DataFrame, shares: dict[str, float], buckets: int, heavy: float) -> DataFrame:
    """``group_url, split`` of each group of ``rows`` (``entry_id, group_url, is_vfc, src_datasets``)."""
    labels = labelled(rows)
    vector = written(labels.groupBy("group_url", "label").agg(F.count(F.lit(1)).alias("m")).withColumn("n", F.when(F.col("label").isNull(), F.col("m")).otherwise(0)), "vectors")
    names = vector.where("label IS NOT NULL").groupBy("label").agg(F.sum("m").alias("total")).orderBy("total", "label").collect()  # 42 at most
    rank = {r["label"]: i for i, r in enumerate(names)}
    ranks = F.create_map(*(F.lit(x) for kv in rank.items() for x in kv)) if rank else F.create_map(F.lit(""), F.lit(0))
    total = rows.count()
    label_rank = F.coalesce(ranks[F.col("label")], F.lit(len(rank)))
    per_group = vector.groupBy("group_url").agg(F.sum("n").alias("rows"), F.min(F.when(F.col("label").isNotNull(), label_rank)).alias("rarest"))
    unit = F.when(F.col("rows") > heavy * total, F.col("group_url")).otherwise(
        F.concat(F.lit("~"), F.coalesce("rarest", F.lit(-1)).cast("string"), F.lit("~"), F.pmod(F.xxhash64("group_url"), F.lit(buckets)).cast("string"))
    )
    per_group = written(per_group.select("group_url", unit.alias("unit")), "units")
    sums = vector.join(per_group, "group_url").groupBy("unit", "label").agg(F.sum("m").alias("m"), F.sum("n").alias("n")).collect()
    units: dict[str, tuple[dict[str, int], int]] = {}
    for r in sorted(sums, key=lambda r: (r["unit"], r["label"] or "")):
        counts, n = units.get(r["unit"], ({}, 0))
        if r["label"] is not None:
            counts[r["label"]] = r["m"]
        units[r["unit"]] = (counts, n + r["n"])
    chosen = dict(zip(units, place(list(units.values()), shares), strict=True))
    table = rows.sparkSession.createDataFrame(list(chosen.items()), "unit string, split string")
    return per_group.join(F.broadcast(table), "unit").select("group_url", "split")  # table: a row for each unit


def split_labels(entries: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """``split, label, n, share``: the entries of each label in each split, and their share of the label's entries.

    Label ``rows`` counts all entries. An entry of several sources counts for each.
    """
    rows = written(entry_groups(entries, "is_vfc", "src_datasets"), "grouped")
    placed = group_splits(rows, shares or SPLITS, 256, 0.002)
    vector = labelled(rows).groupBy("group_url", F.coalesce("label", F.lit("rows")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    sums = vector.join(placed, "group_url").groupBy("split", "label").agg(F.sum("n").alias("n"))
    totals = sums.groupBy("label").agg(F.sum("n").alias("all"))  # 43 labels at most
    return sums.join(F.broadcast(totals), "label").select("split", "label", "n", F.round(F.col("n") / F.col("all"), 4).alias("share"))


def split_check(entries: DataFrame, shares: dict[str, float] | None = None, within: float = 0.02) -> DataFrame:
    """One row: ``n_entries`` placed, ``n_projects`` and ``n_commits`` (of full ids) found in two splits, ``in_share``.

    ``in_share``: every split holds its share of the rows, ``within`` so much of all.
    """
    shares = shares or SPLITS
    commit = commit_key(F.col("commit_id"))
    placed = written(grouped_split(entries, shares), "placed")
    keys = entries.select("entry_id", repo_key(F.col("project_url")).alias("p"), F.when(F.length(commit) == 40, F.unhex(commit)).alias("c")).join(placed.select("entry_id", "split"), "entry_id")
    keys = written(keys, "placed")
    torn = lambda k: keys.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").agg(F.lit(0).cast("long").alias("e"), *(F.count(F.lit(1)) * int(k == x) for x in "pc"), F.lit(True))
    n = F.count(F.lit(1))
    sizes = placed.agg(n.alias("n_entries"), *(F.abs(F.sum((F.col("split") == s).cast("long")) / n - share).alias(f"_{s}") for s, share in shares.items()))
    near = F.greatest(*(F.coalesce(f"_{s}", F.lit(0.0)) for s in shares), F.lit(0.0)) <= within
    parts = sizes.select("n_entries", F.lit(0), F.lit(0), near).union(torn("p")).union(torn("c")).toDF("n_entries", "n_projects", "n_commits", "in_share")
    return parts.agg(*(F.sum(c).alias(c) for c in ("n_entries", "n_projects", "n_commits")), F.bool_and("in_share").alias("in_share"))


def found(entries: DataFrame) -> DataFrame:
    """``group_url, entry_id``."""
    return entry_groups(entries).select("group_url", "entry_id")
