"""Groups of related repositories: found from forks and histories, looked up, checked, saved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixloom.operators.history import canonical_urls, components, fork_edges, history_sample, pair_overlaps, suspicious_urls


def local_edges(history: DataFrame, substantial: DataFrame, recent: int = 100, early: int = 100, skip: int = 10, least: float = 0.1) -> DataFrame:
    """``url1, url2, method, commit_ids`` of repositories whose histories overlap: ``local_history`` edges.

    ``history``: ``url, pos (0 is newest), commit_id``; ``substantial``: ``commit_id`` of the commits that have a
    signature (see ``functions.commit_text.signature``; an id is a hash of the content, so one repository's signature
    speaks for all). A pair counts if both sampled a substantial commit and share ``least`` of the smaller history;
    ``commit_ids`` are the substantial ones both sampled, so 2 x (``recent`` + ``early``) at most.
    """
    sample = history_sample(history, recent, early, skip).join(substantial.select("commit_id").distinct(), "commit_id", "left_semi").select("url", "commit_id").distinct()
    pairs = pair_overlaps(history, sample, least).select("url1", "url2")
    shared = sample.withColumnRenamed("url", "url1").join(pairs, "url1").join(sample.withColumnRenamed("url", "url2"), ["url2", "commit_id"])
    edges = shared.groupBy("url1", "url2").agg(F.array_sort(F.collect_set("commit_id")).alias("commit_ids"))
    return edges.select("url1", "url2", F.lit("local_history").alias("method"), "commit_ids")


def signature_sources(shared: DataFrame) -> DataFrame:
    """``commit_id, url``: the repository whose copy of a shared commit is read, the first by name (``commit_id, urls``)."""
    return shared.select("commit_id", F.array_min("urls").alias("url"))


def groups_of_edges(edges: DataFrame, sources: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and members of the graph of ``edges`` (``url1, url2, method, commit_ids``).

    Groups: ``group_id`` (the smallest URL), ``canonical_url``, ``project_urls``, ``detection_methods`` and ``n_links``
    (distinct linked commits). Members: ``url, group_id, canonical_url``, a row for each URL of a group. ``sources``: ``url``
    of the repositories that others were forked from; ``counts``: ``url, n`` commits. Self edges and open ends link nothing.
    """
    labels = components(edges)
    canonical = canonical_urls(labels, sources, counts)
    members = labels.join(canonical, "label").select("url", F.col("label").alias("group_id"), "canonical_url")
    urls = members.groupBy("group_id", "canonical_url").agg(F.array_sort(F.collect_list("url")).alias("project_urls"))
    of_edges = edges.where("url1 <> url2").join(labels, edges["url1"] == labels["url"]).select(F.col("label").alias("group_id"), "method", F.explode_outer("commit_ids").alias("c"))
    seen = of_edges.groupBy("group_id").agg(F.array_sort(F.collect_set("method")).alias("detection_methods"), F.countDistinct("c").alias("n_links"))
    return urls.join(seen, "group_id"), members


def links_of_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``label, commit_id, url``: the repositories of a group that a commit links."""
    ends = edges.where("url2 IS NOT NULL").select(F.explode("commit_ids").alias("commit_id"), F.array("url1", "url2").alias("urls")).select("commit_id", F.explode("urls").alias("url"))
    return ends.distinct().join(members.select("url", F.col("group_id").alias("label")), "url").select("label", "commit_id", "url")


def discover(history: DataFrame, substantial: DataFrame, forks: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, members and edges, from histories (see ``local_edges``) and ``forks`` (``url, parent, source``)."""
    edges = fork_edges(forks).unionByName(local_edges(history, substantial, **options))
    counts = history.groupBy("url").agg(F.countDistinct("commit_id").alias("n"))
    groups, members = groups_of_edges(edges, forks.where("source IS NOT NULL").select(F.col("source").alias("url")), counts)
    return groups, members, edges


def group_of(urls: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``urls`` (``url``) with ``group_id`` and ``canonical_url``, NULL without a group."""
    return urls.join(members.select("url", "group_id", "canonical_url"), "url", "left")


def are_related(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``pairs`` (``url1, url2``) with ``related``: both are in one group."""
    of = members.select("url", "group_id")
    sided = pairs.join(of.toDF("url1", "_g1"), "url1", "left").join(of.toDF("url2", "_g2"), "url2", "left")
    return sided.withColumn("related", F.coalesce(F.col("_g1") == F.col("_g2"), F.lit(False))).drop("_g1", "_g2")


def revalidated(members: DataFrame, edges: DataFrame, signatures: DataFrame, least: int = 2) -> DataFrame:
    """``label, url`` of members that stay suspicious after their commits were compared again.

    Two repositories of a group are joined by a fork, or by ``least`` commits that the edges link or whose signatures
    (``url, commit_id, content_hash, files_hash``) agree in both and that no edge of the group links yet. What no chain of
    such joins connects with the canonical URL is left. A repository without signatures stays as it is.
    """
    links = links_of_edges(edges, members)
    known = links.select("label", "commit_id").distinct()
    mine = signatures.join(members.select("url", F.col("group_id").alias("label")), "url").where("content_hash IS NOT NULL AND files_hash IS NOT NULL").select("label", "commit_id", "content_hash", "files_hash", "url").distinct()
    new = mine.join(known, ["label", "commit_id"], "left_anti")
    hidden = F.concat_ws(" ", "commit_id", "content_hash", "files_hash")
    both = links.unionByName(new.select("label", hidden.alias("commit_id"), "url"))
    return suspicious_urls(members.withColumnRenamed("group_id", "label").select("url", "label", "canonical_url"), edges.where("url1 <> url2"), both, least)


def save_relationships(groups: DataFrame, members: DataFrame, folder: str) -> None:
    """Two tables below ``folder``: groups as JSON lines, members as parquet."""
    groups.write.mode("overwrite").json(f"{folder}/groups")
    members.write.mode("overwrite").parquet(f"{folder}/members")


def load_relationships(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    schema = "group_id string, canonical_url string, project_urls array<string>, detection_methods array<string>, n_links long"
    return spark.read.schema(schema).json(f"{folder}/groups"), spark.read.parquet(f"{folder}/members")


def url_map(spark: SparkSession, path: str, names: tuple[str, str] = ("old_url", "new_url")) -> DataFrame:
    """A JSON object of URLs (moved ones to their new URL, unreachable ones to anything) as a table of two columns."""
    table = F.from_json("value", "map<string,string>")
    return spark.read.text(path, wholetext=True).select(F.explode(table).alias(*names))
