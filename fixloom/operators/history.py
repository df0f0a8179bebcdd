"""Repository histories: samples, shared commits, overlaps, and the graph of related repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixloom.runtime import written


def history_sample(history: DataFrame, recent: int = 100, early: int = 100, skip: int = 10) -> DataFrame:
    """The newest ``recent`` and, of long histories, the oldest ``early`` commits but the ``skip`` very oldest.

    ``history``: ``url, pos (0 is newest), commit_id``. Positions are given, so only a count per repository is needed.
    """
    rows = history.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("url")))
    tail = (F.col("_n") > early + skip) & F.lit(early > 0) & (F.col("pos") >= F.col("_n") - (early + skip)) & (F.col("pos") < F.col("_n") - skip)
    return rows.where((F.col("pos") < recent) | tail).drop("_n")


def shared_commits(sample: DataFrame) -> DataFrame:
    """``commit_id, urls`` of the commits that two repositories or more have."""
    return sample.select("commit_id", "url").distinct().groupBy("commit_id").agg(F.array_sort(F.collect_set("url")).alias("urls")).where(F.size("urls") >= 2)


def pair_overlaps(history: DataFrame, sample: DataFrame, least: float = 0.1) -> DataFrame:
    """``url1, url2, n_shared, overlap`` of repositories that share a sampled commit and enough of their histories.

    The overlap is the share of the smaller history. All histories are joined on the commit with ``url1 < url2``, marked
    where both sides have it in the sample, and a pair's shared and marked commits are counted in one sum. So the rows
    joined grow with the commits that repositories really share, not with pairs times whole histories.
    """
    full = history.select("url", "commit_id").distinct()
    marked = full.select("url", "commit_id", F.lit(1).alias("h"), F.lit(0).alias("s")).unionByName(sample.select("url", "commit_id", F.lit(0).alias("h"), F.lit(1).alias("s")))
    rows = marked.groupBy("url", "commit_id").agg(F.max("h").alias("h"), F.max("s").alias("s"))
    both = rows.toDF("url1", "commit_id", "h1", "s1").join(rows.toDF("url2", "commit_id", "h2", "s2"), "commit_id").where("url1 < url2")
    shared = both.groupBy("url1", "url2").agg(F.sum(F.col("h1") * F.col("h2")).alias("n_shared"), F.max(F.col("s1") * F.col("s2")).alias("_both")).where("_both = 1 AND n_shared > 0")
    sizes = full.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    sized = shared.join(sizes.toDF("url1", "n1"), "url1").join(sizes.toDF("url2", "n2"), "url2")
    return sized.withColumn("overlap", F.col("n_shared") / F.least("n1", "n2")).where(F.col("overlap") >= least).select("url1", "url2", "n_shared", "overlap")


def fork_edges(forks: DataFrame) -> DataFrame:
    """``url1, url2, method, commit_ids`` out of ``url, parent, source``."""
    other = F.explode(F.array_distinct(F.array_compact(F.array("parent", "source"))))
    rows = forks.select("url", other.alias("other")).where(F.col("url") != F.col("other"))
    return rows.select(F.least("url", "other").alias("url1"), F.greatest("url", "other").alias("url2"), F.lit("github_fork").alias("method"), F.array().cast("array<string>").alias("commit_ids")).distinct()


def components(edges: DataFrame, src: str = "url1", dst: str = "url2") -> DataFrame:
    """``url, label`` by alternating star contraction; ``label`` is the smallest URL of the component.

    Each round links every neighbour larger than a vertex, then every smaller one, to its smallest neighbour, and
    writes the edges to the shared folder; rounds grow with the logarithm of the size, not with path lengths.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    cur, before = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star"), None
    while True:  # until a round changes nothing
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v")
        cur = written(nxt.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    own = cur.select(F.col("v").alias("url"), F.col("v").alias("label")).distinct()
    return cur.select(F.col("u").alias("url"), F.col("v").alias("label")).unionByName(own)


def canonical_urls(members: DataFrame, sources: DataFrame, counts: DataFrame) -> DataFrame:
    """``label, canonical_url``: of the members that forks come from (else of all) the one with most commits.

    ``members``: ``url, label``; ``sources``: ``url``; ``counts``: ``url, n``. Without counts the first fork source
    by name, or NULL.
    """
    rows = members.join(sources.select("url").distinct().withColumn("_src", F.lit(1)), "url", "left").join(counts, "url", "left")
    rows = rows.withColumns({"_src": F.coalesce("_src", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    best = F.max(F.struct(F.col("_src"), F.col("n")))
    top = rows.groupBy("label").agg(best.alias("_best"), F.min(F.when(F.col("_src") == 1, F.col("url"))).alias("_first"))
    picked = rows.join(top, "label").where((F.col("_src") == F.col("_best._src")) & (F.col("n") == F.col("_best.n")))
    return picked.groupBy("label").agg(F.min(F.when(F.col("n") > 0, F.col("url"))).alias("_most"), F.first("_first").alias("_first")).select("label", F.coalesce("_most", "_first").alias("canonical_url"))


def suspicious_urls(members: DataFrame, edges: DataFrame, links: DataFrame, least: int = 2) -> DataFrame:
    """``label, url`` of members that no chain of validated edges joins to their group's canonical URL.

    ``members``: ``url, label, canonical_url``; ``edges``: ``url1, url2, method``; ``links``: ``label, commit_id,
    url``. An edge is valid if it is a fork or both ends share ``least`` linked commits.
    """
    forks = edges.where("method = 'github_fork'").select("url1", "url2")
    shared = links.toDF("label", "commit_id", "url1").join(links.toDF("label", "commit_id", "url2"), ["label", "commit_id"]).where("url1 < url2")
    valid = forks.unionByName(shared.groupBy("url1", "url2").agg(F.countDistinct("commit_id").alias("k")).where(F.col("k") >= least).select("url1", "url2"))
    reach = components(valid).toDF("url", "_comp")
    rows = members.join(reach, "url", "left").withColumn("_comp", F.coalesce("_comp", "url"))
    start = members.groupBy("label").agg(F.min("canonical_url").alias("_canon"), F.min("url").alias("_low")).select("label", F.coalesce("_canon", "_low").alias("_start"))
    home = rows.join(start, (rows["label"] == start["label"]) & (rows["url"] == start["_start"])).select(rows["label"].alias("_l"), F.col("_comp").alias("_home"))
    return rows.join(home, rows["label"] == home["_l"]).where(F.col("_comp") != F.col("_home")).select("label", "url")
