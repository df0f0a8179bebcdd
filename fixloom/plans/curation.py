"""Queries of the curation operators over whole tables, and the same in SQL.

Sets come out as joined text and times as microseconds, so that any engine's values compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixloom.functions import commit_text, ids, owasp, paths
from fixloom.functions.giturl import git_url
from fixloom.functions.identity import commit_key, repo_key
from fixloom.operators import enrich, filters, history, merge, relationships, splits, stats
from fixloom.plans.tables import table


def entries(spark, d) -> DataFrame:
    return table(spark, d, "entries").withColumn("_ord", F.col("entry_id"))


def _joined(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>"))))), "|")


def flat(df: DataFrame) -> DataFrame:
    c = F.col("commit")
    return df.select(
        "project_url", "commit_id", "is_vfc", "function_name", "function_file", "ghsa_id", F.col("_ord").alias("ord"),
        *(_joined(F.col(s)).alias(s) for s in merge.SETS), F.array_join(F.col("owasp_categories").cast("array<string>"), "|").alias("owasp"),
        c["message"].alias("message"), F.md5(c["diff"]).alias("diff_md5"), _joined(c["files_changed"]).alias("files"),
        F.unix_micros(c["authored_at"]).alias("authored_us"), F.unix_micros(c["committed_at"]).alias("committed_us"),
    )


def related(spark, d) -> DataFrame:
    """Projects of one owner on one host as related repositories, however their URL is written; the first is canonical."""
    urls = table(spark, d, "entries").select(F.col("project_url").alias("url")).distinct()
    keyed = urls.withColumn("group_id", F.substring_index(repo_key(F.col("url")), "/", 4)).where("group_id IS NOT NULL")
    return keyed.join(keyed.groupBy("group_id").agg(F.min("url").alias("canonical_url"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "group_id").select("url", "group_id", "canonical_url")


def histories(spark, d) -> DataFrame:
    """Suppliers as repositories and parts as commits, newest shipment first."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_shipdate").alias("at"))
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("at"), "l_partkey")) - 1
    return rows.select(F.concat(F.lit("https://github.com/s/r"), F.col("l_suppkey").cast("string")).alias("url"), F.md5(F.col("l_partkey").cast("string")).alias("commit_id"), pos.alias("pos"))


def q_dedup_related(spark, d):
    return flat(merge.deduplicate_related(entries(spark, d), related(spark, d)))


def q_unique_diff(spark, d):
    return filters.unique_diffs(entries(spark, d)).select(F.col("_ord").alias("ord"))


def q_ext_filter(spark, d):
    return filters.with_extensions(entries(spark, d), paths.extensions_for("c", "cpp")).select(F.col("_ord").alias("ord"))


def q_lang_of_path(spark, d):
    return entries(spark, d).where("function_file IS NOT NULL").select("entry_id", paths.suffix(F.col("function_file")).alias("suffix"), paths.language(F.col("function_file")).alias("language"), paths.is_template(F.col("function_file")).alias("template"))


def _moves(spark, d):
    urls = table(spark, d, "relationship_edges").where("method = 'github_fork' AND url2 IS NOT NULL").groupBy("url1").agg(F.min("url2").alias("new_url"))
    return urls.withColumnRenamed("url1", "old_url")


def q_moved_urls(spark, d):
    return filters.moved(entries(spark, d), _moves(spark, d)).select("entry_id", "project_url")


def q_unreachable_urls(spark, d):
    gone = table(spark, d, "documents").where("project_url IS NOT NULL").groupBy("project_url").count().where("count % 2 = 0").select(F.col("project_url").alias("url"))
    return filters.reachable(entries(spark, d), gone).select("entry_id", "project_url")


def q_norm_ids(spark, d):
    e = entries(spark, d)
    return e.select("entry_id", _joined(ids.cve_set(F.col("cve_ids"))).alias("cves"), _joined(ids.cwe_set(F.col("cwe_ids"))).alias("cwes"), _joined(owasp.owasp_of(F.col("cwe_ids"))).alias("owasp"))


def q_norm_commit(spark, d):
    return entries(spark, d).select("entry_id", ids.commit_id(F.col("commit_id")).alias("commit_id"))


def q_url_normalise(spark, d):
    g = git_url(F.col("project_url"))
    return entries(spark, d).select("entry_id", g.alias("g")).select("entry_id", "g.host", "g.owner", "g.repo", "g.https")


def q_url_key(spark, d):
    return entries(spark, d).select("entry_id", repo_key(F.col("project_url")).alias("project"))


def q_temporal_split(spark, d):
    return splits.temporal_split(entries(spark, d).where("commit.committed_at IS NOT NULL"), (0.6, 0.2, 0.2)).select(F.col("_ord").alias("ord"), "split")


def q_hash_split(spark, d):
    return splits.hash_split(entries(spark, d), 7, (0.6, 0.2, 0.2)).select(F.col("_ord").alias("ord"), "split")


def q_split_quality(spark, d):
    return stats.split_quality(table(spark, d, "entries"))


def q_group_sizes(spark, d):
    return stats.group_sizes(entries(spark, d), related(spark, d))


def q_grouped_split(spark, d):
    return splits.group_stratified_split(stats.group_sizes(entries(spark, d), related(spark, d)).select("group_key", "n"), 1)


def q_components(spark, d):
    return history.components(table(spark, d, "relationship_edges"))


def q_canonical_url(spark, d):
    edges, e = table(spark, d, "relationship_edges"), table(spark, d, "entries")
    sources = edges.where("method = 'github_fork'").select(F.col("url1").alias("url"))
    counts = e.groupBy(F.col("project_url").alias("url")).agg(F.countDistinct("commit_id").alias("n"))
    return history.canonical_urls(history.components(edges), sources, counts)


def q_suspicious(spark, d):
    edges = table(spark, d, "relationship_edges")
    members = history.components(edges).withColumn("canonical_url", F.col("label"))
    linked = edges.where("url2 IS NOT NULL").select(F.explode("commit_ids").alias("commit_id"), F.array("url1", "url2").alias("urls")).select("commit_id", F.explode("urls").alias("url")).distinct()
    return history.suspicious_urls(members, edges.where("url1 <> url2"), linked.join(members.select("url", "label"), "url").select("label", "commit_id", "url"))


def q_extend_ids(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("https://github.com/o/r"), (F.col("o_custkey") % 97).cast("string")).alias("project_url"), F.sha1(F.col("o_orderkey").cast("string")).alias("full_id"))
    short = e.select("k", "project_url", F.expr("substring(full_id, 1, CAST(5 + k % 8 AS INT))").alias("commit_id"))
    return enrich.extend_ids(short, e)


def q_attach(spark, d):
    data = table(spark, d, "commit_data").groupBy("project_url", "commit_id").agg(F.min_by("message", F.when(F.col("message").isNotNull(), F.col("row_id"))).alias("m"))
    none = F.lit(None)
    struct = commit_text.commit_struct(F.col("m"), none.cast("string"), none.cast("array<string>"), none.cast("timestamp"), none.cast("timestamp"))
    return enrich.attach(entries(spark, d), data.select("project_url", "commit_id", struct.alias("data"))).select("entry_id", F.col("commit.message").alias("message"), F.array_join("commit.files_changed", "|").alias("files"))


def q_files_of_diff(spark, d):
    return entries(spark, d).select("entry_id", F.array_join(commit_text.files_of_diff(F.col("commit.diff")), "|").alias("files"))


def q_git_show(spark, d):
    text = F.concat(F.lit("commit x\nAuthor: A <a@b>\nDate:   "), F.date_format("o_orderdate", "MMM d HH:mm:ss yyyy"), F.lit(" +0000\n\n    order "), F.col("o_orderkey").cast("string"), F.lit("\n\n    "), F.col("o_orderpriority"), F.lit("\n\ndiff --git a/f.c b/f.c\n"))
    c = commit_text.commit_of_show(text)
    return table(spark, d, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", F.col("c.message").alias("message"), F.unix_micros("c.authored_at").alias("authored_us"), F.array_join("c.files_changed", "|").alias("files"))


def q_signature(spark, d):
    s = commit_text.signature(F.col("commit.message"), F.col("project_url"), F.lit("a@b"), F.col("entry_id"), F.col("commit.files_changed"))
    return entries(spark, d).select("entry_id", s.alias("s")).where("s IS NOT NULL").select("entry_id", "s.content_hash", "s.files_hash")


def q_union(spark, d):
    e = entries(spark, d)
    both = filters.union_sources(e.where("split = 'test'"), e.where("split = 'train'").drop("ghsa_id"), e.where("split NOT IN ('test', 'train') OR split IS NULL"))
    return both.select("entry_id", "project_url", "ghsa_id", F.col("_ord").alias("ord"))


def q_history_sample(spark, d):
    return history.history_sample(histories(spark, d))


def q_shared(spark, d):
    return history.shared_commits(q_history_sample(spark, d)).select("commit_id", F.array_join("urls", "|").alias("urls"))


def q_overlap(spark, d):
    return history.pair_overlaps(histories(spark, d), q_history_sample(spark, d), 0.1).select("url1", "url2", "n_shared", F.round("overlap", 6).alias("overlap"))


def q_strip(spark, d):
    code = F.concat(F.lit("int a; // "), F.col("p_name"), F.lit("\n/* "), F.col("p_brand"), F.lit(" */\nchar *s = \"//\";\n"))
    return enrich.strip_code(table(spark, d, "part").select("p_partkey", F.lit("src/a.c").alias("path"), code.alias("code")))


def q_stripped_diffs(spark, d):
    """Parts as files of two versions: a third changes its comment alone, a third its code, a third is no source code."""
    part = table(spark, d, "part")
    code = lambda value, note: F.concat(F.lit("int size = "), value, F.lit("; // "), note, F.lit("\nchar *s = \"//\";\n"))
    kind = F.col("p_partkey") % 3
    size = F.col("p_size").cast("string")
    files = part.select(
        F.col("p_brand").alias("project_url"), F.sha1(F.col("p_partkey").cast("string")).alias("commit_id"), F.when(kind == 2, "README").otherwise("src/a.c").alias("path"), code(size, F.col("p_name")).alias("before"),
        code(F.when(kind == 1, F.concat(size, F.lit("0"))).otherwise(size), F.col("p_type")).alias("after"), F.lit("100644").alias("mode"), F.concat(F.lit("diff "), "p_name").alias("original"),
    )
    out = enrich.diffs_without_comments(files)
    return out.select("project_url", "commit_id", F.regexp_replace("diff", r"(?m)^index [0-9a-f]{7}\.\.[0-9a-f]{7}", "index x..y").alias("diff"))


def q_offline(spark, d):
    data = table(spark, d, "commit_data").select("project_url", "commit_id", F.col("row_id").alias("_ord"), "message", F.lit(None).cast("string").alias("diff"), "files_changed", F.col("ingested_at").alias("authored_at"), F.lit(None).cast("timestamp").alias("committed_at"))
    e = entries(spark, d)
    out = enrich.attach(e, enrich.offline_commits(e, data))
    return out.select("entry_id", F.md5("commit.message").alias("message_md5"), F.array_join("commit.files_changed", "|").alias("files"), F.unix_micros("commit.authored_at").alias("authored_us"))


def q_complete(spark, d):
    b = filters.bound_diffs(entries(spark, d))
    return b.select("entry_id", commit_text.is_complete(F.col("commit")).alias("complete"), F.length("commit.diff").cast("long").alias("n_diff"))


def commits_of(spark, d) -> DataFrame:
    """``url, commit_id, at, content_hash, files_hash``: commits of clean projects among the entries, hashes of substantial ones."""
    c = F.col("commit")
    sig = commit_text.signature(c["message"], F.lit("a"), F.lit("a@b"), F.lit(0), c["files_changed"])
    rows = table(spark, d, "entries").select(repo_key(F.col("project_url")).alias("url"), commit_key(F.col("commit_id")).alias("commit_id"), c["committed_at"].alias("at"), sig.alias("s"))
    rows = rows.where("url IS NOT NULL AND length(commit_id) = 40")
    return rows.groupBy("url", "commit_id").agg(F.max("at").alias("at"), F.min("s.content_hash").alias("content_hash"), F.min("s.files_hash").alias("files_hash"))


def _discovered(spark, d):
    commits = commits_of(spark, d)
    pos = F.row_number().over(Window.partitionBy("url").orderBy(F.desc_nulls_last("at"), "commit_id")) - 1
    forks = table(spark, d, "relationship_edges").where("method = 'github_fork'").select(F.col("url1").alias("url"), F.col("url2").alias("parent"), F.col("url2").alias("source"))
    return relationships.discover(commits.select("url", "commit_id", pos.alias("pos")), commits.where("files_hash IS NOT NULL"), forks)


def q_discover_groups(spark, d):
    groups, _, _ = _discovered(spark, d)
    return groups.select("group_id", "canonical_url", F.array_join("project_urls", "|").alias("urls"), F.array_join("detection_methods", "|").alias("methods"), "n_links")


def q_local_edges(spark, d):
    _, _, edges = _discovered(spark, d)
    return edges.where("method = 'local_history'").select("url1", "url2", F.array_join("commit_ids", "|").alias("commits"))


def _of_edges(spark, d):
    edges, e = table(spark, d, "relationship_edges"), table(spark, d, "entries")
    counts = e.groupBy(F.col("project_url").alias("url")).agg(F.countDistinct("commit_id").alias("n"))
    return edges, relationships.groups_of_edges(edges, edges.where("method = 'github_fork'").select(F.col("url1").alias("url")), counts)


def q_group_of(spark, d):
    _, (_, members) = _of_edges(spark, d)
    return relationships.group_of(table(spark, d, "entries").select("entry_id", F.col("project_url").alias("url")), members)


def q_are_related(spark, d):
    edges, (_, members) = _of_edges(spark, d)
    return relationships.are_related(edges.select("edge_id", F.col("url1"), F.coalesce("url2", F.lit("none")).alias("url2")), members)


def q_revalidated(spark, d):
    edges, (_, members) = _of_edges(spark, d)
    return relationships.revalidated(members, edges, commits_of(spark, d).where("content_hash IS NOT NULL"))


def q_split_groups(spark, d):
    return stats.split_groups(entries(spark, d), related(spark, d), "split")


def q_split_scores(spark, d):
    scores = splits.split_scores(q_split_groups(spark, d))
    return scores.select(*(F.round(c, 6).alias(c) for c in scores.columns))


def q_top_splits(spark, d):
    scores, _ = splits.top_splits(stats.split_groups(entries(spark, d), related(spark, d)))
    return scores.select("seed", *(F.round(c, 6).alias(c) for c in scores.columns if c != "seed"))


def q_top_splits_check(spark, d):
    """What must hold of each of the best splits: every group once, every entry, rows within a point of their share."""
    sizes = stats.split_groups(entries(spark, d), related(spark, d))
    _, placed = splits.top_splits(sizes)
    rows = placed.join(sizes, "group_key").groupBy("seed").agg(F.count(F.lit(1)).alias("n_groups"), F.countDistinct("group_key").alias("n_distinct"), F.sum("n").alias("n"), *(F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s) for s in ("train", "validation", "test")))
    near = (F.abs(F.col("train") / F.col("n") - 0.6) < 0.01) & (F.abs(F.col("validation") / F.col("n") - 0.2) < 0.01)
    return rows.select("n_groups", "n_distinct", "n", near.alias("in_share"))


def q_hash_split_sizes(spark, d):
    return q_hash_split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ord").alias("n_distinct"))


QUERIES = {
    "collapse_commit": lambda s, d: flat(merge.collapse_to_commits(entries(s, d))), "collapse_commit_vfc_only": lambda s, d: flat(merge.collapse_to_commits(entries(s, d), False)),
    "dedup_function": lambda s, d: flat(merge.deduplicate_functions(entries(s, d))), "dedup_repo": lambda s, d: flat(merge.deduplicate_commits(entries(s, d))),
    "dedup_related": q_dedup_related, "unique_diff": q_unique_diff, "dataset_stats": lambda s, d: stats.dataset_stats(entries(s, d)), "ext_filter": q_ext_filter,
    "lang_of_path": q_lang_of_path, "moved_urls": q_moved_urls, "unreachable_urls": q_unreachable_urls, "norm_ids": q_norm_ids, "norm_commit": q_norm_commit,
    "url_normalise": q_url_normalise, "url_key": q_url_key, "temporal_split": q_temporal_split, "hash_split": q_hash_split, "split_quality": q_split_quality,
    "group_sizes": q_group_sizes, "grouped_split": q_grouped_split, "components": q_components, "canonical_url": q_canonical_url, "suspicious": q_suspicious,
    "extend_commit_ids": q_extend_ids, "attach_commit_data": q_attach, "files_from_diff": q_files_of_diff, "git_show_parse": q_git_show, "signature": q_signature,
    "union_sources": q_union, "variant_overlap": lambda s, d: filters.from_sources(entries(s, d), ["SecTrace", "OpenMend"]).select("entry_id"),
    "history_sample": q_history_sample, "shared_commits": q_shared, "pair_overlap": q_overlap, "strip_comments": q_strip, "commit_complete": q_complete,
    "clone_strategy": lambda s, d: stats.clone_strategy(entries(s, d)), "discover_groups": q_discover_groups, "local_edges": q_local_edges, "group_of": q_group_of,
    "are_related": q_are_related, "revalidated": q_revalidated, "split_groups": q_split_groups, "split_scores": q_split_scores, "top_splits": q_top_splits,
    "top_splits_check": q_top_splits_check, "hash_split_sizes": q_hash_split_sizes, "stripped_diffs": q_stripped_diffs, "offline_commits": q_offline, "dataset_counts": lambda s, d: stats.dataset_counts(entries(s, d)),
}


# --- the same in SQL -------------------------------------------------------------------------------------------------


def _set(c: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct(flatten(list({c}) FILTER ({c} IS NOT NULL)))), '|'), '')"


def _known(x: str) -> str:
    return f"arg_min({x}, entry_id) FILTER ({x} IS NOT NULL)"


def _merged(label: str) -> str:
    return (
        f"{label} AS is_vfc, {_known('function_file')} AS function_file, {_known('ghsa_id')} AS ghsa_id, min(entry_id) AS ord, "
        + ", ".join(f"{_set(c)} AS {c}" for c in merge.SETS)
        + ", CASE WHEN count(owasp_categories) > 0 THEN coalesce(array_to_string(list_sort(list_distinct(flatten(list(owasp_categories) FILTER (owasp_categories IS NOT NULL)))), '|'), '') END AS owasp"
        + f", {_known('e.commit.message')} AS message, md5({_known('e.commit.diff')}) AS diff_md5, {_set('e.commit.files_changed')} AS files"
        + f", epoch_us({_known('e.commit.authored_at')}) AS authored_us, epoch_us({_known('e.commit.committed_at')}) AS committed_us"
    )


_FIRST_LABEL, _NONE = "arg_min(is_vfc, entry_id)", "CAST(NULL AS VARCHAR)"
_AGREE = "HAVING count(*) = 1 OR bool_and(is_vfc) = bool_or(is_vfc)"
_HIST = """h0 AS (SELECT l_suppkey, l_partkey, max(l_shipdate) AS ts FROM lineitem GROUP BY 1, 2),
hist AS (SELECT concat('https://github.com/s/r', CAST(l_suppkey AS VARCHAR)) AS url, md5(CAST(l_partkey AS VARCHAR)) AS commit_id,
 CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY ts DESC, l_partkey) - 1 AS INT) AS pos, count(*) OVER (PARTITION BY l_suppkey) AS n FROM h0),
samp AS (SELECT url, commit_id, pos FROM hist WHERE pos < 100 OR (n > 110 AND pos >= n - 110 AND pos < n - 10))"""
COMPONENTS = """e2 AS (SELECT url1 AS a, url2 AS b FROM relationship_edges WHERE url1 <> url2 UNION SELECT url2, url1 FROM relationship_edges WHERE url1 <> url2),
walk AS (SELECT a AS url, a AS label FROM e2 UNION SELECT e2.b, walk.label FROM walk JOIN e2 ON walk.url = e2.a),
comp AS (SELECT url, min(label) AS label FROM walk GROUP BY 1)"""
_SUFFIX = r"lower(regexp_extract(regexp_extract(regexp_replace({p}, '/+$', ''), '([^/]*)$', 1), '^.+(\.[^.]+)$', 1))"
_C_CPP = ", ".join(f"'{e}'" for e in sorted(paths.extensions_for("c", "cpp")))
_LANG = "CASE " + " ".join(f"WHEN suffix IN ({', '.join(repr(e) for e in es.split())}) THEN '{name}'" for name, es in paths.LANGUAGES.items()) + " END"
_OWASP = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in owasp.category_of().items()) + "}"
_TEMPLATE = ", ".join(f"'{t}'" for t in paths.TEMPLATES)
_HEADER = r"""'(?m)^diff --git ("?a/.*?"?) ("?b/.*?"?)\r?$'"""
KEY = r"""CASE WHEN regexp_matches({u}, '{r}') THEN regexp_replace({u}, '{r}', 'https://\1/\2') END""".replace(
    "{r}",
    r"^(?:[a-z][a-z0-9+.-]*:/+)?(?:[^@/?#]*@)?(?:www\.)?([^:/?#@\s]+\.[^:/?#@\s]+)(?::\d+)?[:/]+([^/?#\s]+/[^/?#\s]+?(?:/[^/?#\s]+?)*?|[^/?#\s]+?)(?:\.git)?/*"
    r"(?:/-(?:/[^?#]*)?|/(?:tree|blob|commit|commits|raw|src|browse|log|diff|compare|releases|tags|issues|pull|pulls|merge_requests|wiki|archive)(?:/[^?#]*)?)?(?:\?[^#]*)?(?:#.*)?$",
)
URL_KEY = KEY.replace("{u}", "lower(url_decode(replace(regexp_replace(project_url, '^\\s+|\\s+$', '', 'g'), '+', '%2B')))")
_RELATED = f"""keyed AS (SELECT DISTINCT project_url AS url, array_to_string(string_split({URL_KEY}, '/')[1:4], '/') AS group_id FROM entries),
related AS (SELECT url, k.group_id, canonical_url FROM keyed k JOIN (SELECT group_id, min(url) AS canonical_url FROM keyed WHERE group_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) c ON k.group_id = c.group_id)"""
_KEY_ID = r"nullif(regexp_extract(lower(commit_id), '(?:^|/)[^0-9a-z/]*([0-9a-f]{7,40})(?:\.(?:patch|diff))?[^0-9a-z?#]*(?:[?#].*)?$', 1), '')"
_REAL_FILES = f"list_sort([p FOR p IN e.commit.files_changed IF lower(regexp_extract(p, '([^/]*)/*$', 1)) NOT IN ({_TEMPLATE})])"
_COMMITS = f"""k0 AS (SELECT {URL_KEY} AS url, {_KEY_ID} AS c, epoch_us(e.commit.committed_at) AS ts, e.commit.message AS m, e.commit.files_changed AS f, {_REAL_FILES} AS r FROM entries e),
k1 AS (SELECT *, len(f) BETWEEN 2 AND 20 AND len(r) >= 2 AS ok FROM k0 WHERE url IS NOT NULL AND length(c) = 40),
sig AS (SELECT url, c, max(ts) AS ts, min(CASE WHEN ok THEN sha256(m || chr(10) || 'a|a@b|0') END) AS ch, min(CASE WHEN ok THEN sha256(array_to_string(r, chr(10))) END) AS fh FROM k1 GROUP BY 1, 2)"""
_DISCOVER = f"""{_COMMITS}, hi AS (SELECT url, c, row_number() OVER (PARTITION BY url ORDER BY ts DESC NULLS LAST, c) - 1 AS pos, count(*) OVER (PARTITION BY url) AS n FROM sig),
sm AS (SELECT url, c FROM hi WHERE (pos < 100 OR (n > 110 AND pos >= n - 110 AND pos < n - 10)) AND c IN (SELECT c FROM sig WHERE fh IS NOT NULL)),
pr AS (SELECT a.url AS url1, b.url AS url2, list_sort(list(a.c)) AS cs FROM sm a JOIN sm b ON a.c = b.c AND a.url < b.url GROUP BY 1, 2),
sh AS (SELECT a.url AS url1, b.url AS url2, count(*) / CAST(min(least(a.n, b.n)) AS DOUBLE) AS o FROM hi a JOIN hi b ON a.c = b.c AND a.url < b.url GROUP BY 1, 2),
loc AS (SELECT pr.* FROM pr JOIN sh USING (url1, url2) WHERE o >= 0.1),
ed AS (SELECT DISTINCT least(url1, url2) AS url1, greatest(url1, url2) AS url2, 'github_fork' AS method, CAST([] AS VARCHAR[]) AS cs FROM relationship_edges WHERE method = 'github_fork' AND url1 <> url2 UNION ALL SELECT url1, url2, 'local_history', cs FROM loc),
e2 AS (SELECT url1 AS a, url2 AS b FROM ed UNION SELECT url2, url1 FROM ed), walk AS (SELECT a AS url, a AS label FROM e2 UNION SELECT e2.b, walk.label FROM walk JOIN e2 ON walk.url = e2.a), comp AS (SELECT url, min(label) AS label FROM walk GROUP BY 1),
cnt AS (SELECT url AS u, count(*) AS n FROM sig GROUP BY 1), src AS (SELECT DISTINCT url2 AS s FROM relationship_edges WHERE method = 'github_fork' AND url2 IS NOT NULL)"""
_CANON = """m AS (SELECT url, label, CASE WHEN url IN (SELECT s FROM src) THEN 1 ELSE 0 END AS f, coalesce(n, 0) AS n FROM comp LEFT JOIN cnt ON url = u),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f DESC, n DESC, url) AS k, min(CASE WHEN f = 1 THEN url END) OVER (PARTITION BY label) AS first_src FROM m),
canon AS (SELECT label AS l, CASE WHEN n > 0 THEN url ELSE first_src END AS canonical_url FROM r WHERE k = 1)"""
_EDGE_GROUPS = f"""{COMPONENTS}, cnt AS (SELECT project_url AS u, count(DISTINCT commit_id) AS n FROM entries GROUP BY 1), src AS (SELECT url1 AS s FROM relationship_edges WHERE method = 'github_fork'), {_CANON}"""


def _left_over(links: str, start: str) -> str:
    """Members that no chain of valid edges joins to ``start``; ``links`` is a table of label, commit, url."""
    return f"""va AS (SELECT url1 AS a, url2 AS b FROM relationship_edges WHERE method = 'github_fork' AND url1 <> url2 UNION SELECT x.url, y.url FROM {links} x JOIN {links} y ON x.label = y.label AND x.c = y.c AND x.url < y.url GROUP BY 1, 2, x.label HAVING count(DISTINCT x.c) >= 2),
v2 AS (SELECT a, b FROM va UNION SELECT b, a FROM va), wa AS (SELECT a AS url, a AS lo FROM v2 UNION SELECT v2.b, wa.lo FROM wa JOIN v2 ON wa.url = v2.a), co AS (SELECT url, min(lo) AS lo FROM wa GROUP BY 1),
me AS (SELECT comp.label, comp.url, coalesce(lo, comp.url) AS lo FROM comp LEFT JOIN co ON comp.url = co.url), home AS (SELECT me.label AS hl, me.lo AS hlo FROM me JOIN ({start}) st ON me.label = st.l AND me.url = st.u)
SELECT label, url FROM me JOIN home ON label = hl WHERE lo <> hlo"""


_LINKS = "lk AS (SELECT DISTINCT label, c, comp.url FROM (SELECT unnest(commit_ids) AS c, url1 AS u FROM relationship_edges WHERE url2 IS NOT NULL UNION SELECT unnest(commit_ids), url2 FROM relationship_edges WHERE url2 IS NOT NULL) JOIN comp ON u = comp.url)"
_SPLIT_GROUPS = f"""{_RELATED}, sg AS (SELECT coalesce(group_id, project_url) AS group_key, split, count(*) AS n, CAST(sum(CASE WHEN is_vfc THEN 1 ELSE 0 END) AS BIGINT) AS n_vfc, count(DISTINCT project_url) AS n_urls, coalesce(min(canonical_url), min(project_url)) AS u FROM entries LEFT JOIN related ON project_url = url GROUP BY 1, 2)"""

SQL = {
    "discover_groups": f"WITH RECURSIVE {_DISCOVER}, {_CANON}, g AS (SELECT label, list_sort(list(url)) AS us FROM comp GROUP BY 1), mt AS (SELECT label AS ml, list_sort(list(DISTINCT method)) AS ms FROM ed JOIN comp ON url1 = url GROUP BY 1), nl AS (SELECT label AS nl, count(DISTINCT x) AS k FROM (SELECT url1, unnest(cs) AS x FROM ed) JOIN comp ON url1 = url GROUP BY 1) SELECT label AS group_id, canonical_url, array_to_string(us, '|') AS urls, array_to_string(ms, '|') AS methods, coalesce(k, 0) AS n_links FROM g JOIN canon ON label = l JOIN mt ON label = ml LEFT JOIN nl ON label = nl.nl",
    "local_edges": f"WITH RECURSIVE {_DISCOVER} SELECT url1, url2, array_to_string(cs, '|') AS commits FROM loc",
    "group_of": f"WITH RECURSIVE {_EDGE_GROUPS} SELECT entry_id, project_url AS url, label AS group_id, canonical_url FROM entries LEFT JOIN comp ON project_url = url LEFT JOIN canon ON label = l",
    "are_related": f"WITH RECURSIVE {COMPONENTS} SELECT edge_id, url1, coalesce(url2, 'none') AS url2, coalesce(a.label = b.label, false) AS related FROM relationship_edges LEFT JOIN comp a ON url1 = a.url LEFT JOIN comp b ON url2 = b.url",
    "suspicious": f"WITH RECURSIVE {COMPONENTS}, {_LINKS}, {_left_over('lk', 'SELECT label AS l, label AS u FROM comp WHERE url = label')}",
    "revalidated": f"WITH RECURSIVE {_EDGE_GROUPS}, {_LINKS}, {_COMMITS}, nw AS (SELECT label, concat_ws(' ', c, ch, fh) AS c, comp.url FROM sig JOIN comp ON sig.url = comp.url WHERE ch IS NOT NULL AND fh IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.label = comp.label AND lk.c = sig.c)), al AS (SELECT label, c, url FROM lk UNION ALL SELECT label, c, url FROM nw), {_left_over('al', 'SELECT label AS l, coalesce(canonical_url, min(url)) AS u FROM comp JOIN canon ON label = l GROUP BY label, canonical_url')}",
    "split_groups": f"WITH {_SPLIT_GROUPS} SELECT group_key, split, n, n_vfc, n_urls, CASE WHEN contains(regexp_replace(u, '/+$', ''), '/') THEN array_to_string(string_split(regexp_replace(u, '/+$', ''), '/')[-2:], '/') ELSE regexp_replace(u, '/+$', '') END AS name FROM sg",
    "split_scores": f"WITH {_SPLIT_GROUPS}, s AS (SELECT split, sum(n) / count(*) AS p, sum(n_vfc) / sum(n) AS r FROM sg GROUP BY 1), m AS (SELECT avg(p) AS mp, avg(r) AS mr FROM s), b AS (SELECT max(abs(p - mp)) / max(mp) AS x, max(abs(r - mr)) / max(mr) AS y FROM s, m) SELECT round(x, 6) AS commits_per_project_balance, round(y, 6) AS vfc_ratio_balance, round(0.4 * x + 0.6 * y, 6) AS combined_score FROM b",
    "top_splits_check": f"WITH {_RELATED}, g AS (SELECT coalesce(group_id, project_url) AS k, count(*) AS n FROM entries LEFT JOIN related ON project_url = url GROUP BY 1), t AS (SELECT count(*) AS n_groups, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n, true AS in_share FROM g) SELECT t.* FROM t, range(3)",
    "hash_split_sizes": "WITH x AS (SELECT count(*) AS n, CAST(trunc(count(*) * CAST(0.6 AS DOUBLE)) AS BIGINT) AS a, CAST(trunc(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS b FROM entries) SELECT 'train' AS split, a AS n, a AS n_distinct FROM x UNION ALL SELECT 'validation', b, b FROM x UNION ALL SELECT 'test', n - a - b, n - a - b FROM x",
    "strip_comments": """SELECT p_partkey, 'src/a.c' AS path, concat('int a;', chr(10), 'char *s = "//";', chr(10)) AS code FROM part""",
    "stripped_diffs": """SELECT p_brand AS project_url, sha1(CAST(p_partkey AS VARCHAR)) AS commit_id, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 2 THEN concat('diff ', p_name) ELSE array_to_string(['diff --git a/src/a.c b/src/a.c', 'index x..y 100644', '--- a/src/a.c', '+++ b/src/a.c', '@@ -1,2 +1,2 @@', concat('-int size = ', p_size, ';'), concat('+int size = ', p_size, '0;'), ' char *s = "//";'], chr(10)) END AS diff FROM part""",
    "offline_commits": "WITH c AS (SELECT project_url, commit_id, arg_min(message, row_id) FILTER (message IS NOT NULL) AS m, arg_min(files_changed, row_id) FILTER (len(files_changed) > 0) AS f, arg_min(ingested_at, row_id) FILTER (ingested_at IS NOT NULL) AS t FROM commit_data GROUP BY 1, 2), x AS (SELECT entry_id, e.commit AS c0, c.m, c.f, c.t, e.commit.message IS NOT NULL AND e.commit.diff IS NOT NULL AND e.commit.authored_at IS NOT NULL AND e.commit.committed_at IS NOT NULL AND len(e.commit.files_changed) > 0 AS whole FROM entries e LEFT JOIN c ON e.project_url = c.project_url AND e.commit_id = c.commit_id) SELECT entry_id, md5(CASE WHEN whole THEN c0.message ELSE coalesce(c0.message, m) END) AS message_md5, coalesce(array_to_string(CASE WHEN whole OR len(c0.files_changed) > 0 THEN c0.files_changed ELSE f END, '|'), '') AS files, epoch_us(CASE WHEN whole THEN c0.authored_at ELSE coalesce(c0.authored_at, t) END) AS authored_us FROM x",
    "dataset_counts": "WITH x AS (SELECT unnest(src_datasets) AS src_dataset, coalesce(is_vfc, false) AS v, CASE WHEN function_name IS NOT NULL THEN struct_pack(a := project_url, b := commit_id, c := function_name, d := function_file) END AS f FROM entries) SELECT src_dataset, count(*) FILTER (v) AS n_vfc, count(*) FILTER (NOT v) AS n_other, count(DISTINCT f) FILTER (v) AS n_vfc_functions, count(DISTINCT f) FILTER (NOT v) AS n_other_functions FROM x GROUP BY 1",
    "collapse_commit": f"SELECT project_url, commit_id, {_NONE} AS function_name, {_merged('bool_or(is_vfc)')} FROM entries e GROUP BY 1, 2",
    "collapse_commit_vfc_only": f"SELECT project_url, commit_id, {_NONE} AS function_name, {_merged('bool_or(is_vfc)')} FROM entries e GROUP BY 1, 2 HAVING bool_or(is_vfc)",
    "dedup_function": f"SELECT project_url, commit_id, function_name, {_merged(_FIRST_LABEL)} FROM entries e GROUP BY 1, 2, 3 {_AGREE}",
    "dedup_repo": f"SELECT * REPLACE ({_NONE} AS function_file) FROM (SELECT project_url, commit_id, {_NONE} AS function_name, {_merged(_FIRST_LABEL)} FROM entries e GROUP BY 1, 2 {_AGREE})",
    "dedup_related": f"WITH {_RELATED} SELECT CASE WHEN count(*) > 1 THEN coalesce(min(canonical_url), arg_min(project_url, entry_id)) ELSE arg_min(project_url, entry_id) END AS project_url, commit_id, (arg_min(struct_pack(f := function_name), entry_id)).f AS function_name, {_merged(_FIRST_LABEL)} FROM entries e LEFT JOIN related ON project_url = url GROUP BY commit_id, coalesce(group_id, concat('#', CAST(entry_id AS VARCHAR)))",
    "unique_diff": "SELECT entry_id AS ord FROM (SELECT entry_id, e.commit.diff AS diff, row_number() OVER (PARTITION BY sha256(e.commit.diff), array_to_string(list_sort(e.commit.files_changed), chr(10)), len(e.commit.files_changed) > 0 ORDER BY project_url, commit_id, entry_id) AS rn FROM entries e) WHERE rn = 1 OR diff IS NULL",
    "dataset_stats": "WITH x AS (SELECT unnest(src_datasets) AS src_dataset, project_url, e.commit.diff AS diff FROM entries e) SELECT src_dataset, count(*) AS total, count(diff) AS with_diff, count(DISTINCT project_url) AS projects FROM x GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), count(e.commit.diff), count(DISTINCT project_url) FROM entries e",
    "ext_filter": f"WITH x AS (SELECT entry_id, unnest(CASE WHEN len(e.commit.files_changed) > 0 THEN e.commit.files_changed ELSE [function_file] END) AS p FROM entries e) SELECT DISTINCT entry_id AS ord FROM x WHERE {_SUFFIX.format(p='p')} IN ({_C_CPP})",
    "lang_of_path": f"WITH x AS (SELECT entry_id, function_file AS p, {_SUFFIX.format(p='function_file')} AS suffix FROM entries WHERE function_file IS NOT NULL) SELECT entry_id, suffix, {_LANG} AS language, lower(regexp_extract(p, '([^/]*)/*$', 1)) IN ({_TEMPLATE}) AS template FROM x",
    "moved_urls": "WITH m AS (SELECT url1, min(url2) AS new_url FROM relationship_edges WHERE method = 'github_fork' AND url2 IS NOT NULL GROUP BY 1) SELECT entry_id, coalesce(new_url, project_url) AS project_url FROM entries LEFT JOIN m ON project_url = url1",
    "unreachable_urls": "SELECT entry_id, project_url FROM entries e WHERE NOT EXISTS (SELECT 1 FROM (SELECT project_url AS u FROM documents WHERE project_url IS NOT NULL GROUP BY 1 HAVING count(*) % 2 = 0) g WHERE g.u = e.project_url)",
    "norm_ids": f"SELECT entry_id, coalesce(array_to_string(list_sort(list_distinct([upper(trim(v)) FOR v IN cve_ids IF regexp_full_match(upper(trim(v)), 'CVE-[0-9]{{4}}-[0-9]{{4,}}')])), '|'), '') AS cves, coalesce(array_to_string(list_sort(list_distinct([concat('CWE-', CAST(CAST(regexp_extract(trim(v), '^(?i:CWE-)?([0-9]{{1,4}})$', 1) AS INT) AS VARCHAR)) FOR v IN cwe_ids IF regexp_extract(trim(v), '^(?i:CWE-)?([0-9]{{1,4}})$', 1) <> ''])), '|'), '') AS cwes, CASE WHEN len([v FOR v IN cwe_ids IF map_contains({_OWASP}, v)]) > 0 THEN array_to_string(list_sort(list_distinct([CAST({_OWASP}[v] AS VARCHAR) FOR v IN cwe_ids IF map_contains({_OWASP}, v)])), '|') ELSE '0' END AS owasp FROM entries",
    "norm_commit": r"WITH x AS (SELECT entry_id, regexp_replace(regexp_replace(regexp_replace(split_part(split_part(commit_id, '#', 1), '?', 1), '^\s+|\s+$', '', 'g'), '\.(?:patch|diff)$', ''), '[.,;]+$', '') AS c FROM entries) SELECT entry_id, CASE WHEN regexp_full_match(c, '[0-9a-fA-F]{5,40}') THEN lower(c) ELSE nullif(lower(regexp_extract(c, '^https?://[^/]+/.*/commits?/([0-9a-fA-F]{5,40})(?:/.*)?$', 1)), '') END AS commit_id FROM x",
    "url_key": f"SELECT entry_id, {URL_KEY} AS project FROM entries",
    "temporal_split": "WITH x AS (SELECT entry_id AS ord, row_number() OVER (ORDER BY e.commit.committed_at, entry_id) - 1 AS r, count(*) OVER () AS n FROM entries e WHERE e.commit.committed_at IS NOT NULL) SELECT ord, CASE WHEN r < trunc(n * CAST(0.6 AS DOUBLE)) THEN 'train' WHEN r < trunc(n * CAST(0.6 AS DOUBLE)) + trunc(n * CAST(0.2 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM x",
    "split_quality": "SELECT split, count(*) AS n, CAST(sum(CAST(is_vfc AS INT)) AS BIGINT) AS n_vfc, count(DISTINCT project_url) AS n_projects, round(avg(CAST(is_vfc AS DOUBLE)), 6) AS vfc_ratio FROM entries GROUP BY 1",
    "group_sizes": f"WITH {_RELATED} SELECT coalesce(group_id, project_url) AS group_key, count(*) AS n, count(DISTINCT project_url) AS n_urls FROM entries LEFT JOIN related ON project_url = url GROUP BY 1",
    "components": f"WITH RECURSIVE {COMPONENTS} SELECT url, label FROM comp",
    "canonical_url": f"""WITH RECURSIVE {COMPONENTS}, cnt AS (SELECT project_url AS u, count(DISTINCT commit_id) AS n FROM entries GROUP BY 1),
m AS (SELECT url, label, CASE WHEN url IN (SELECT url1 FROM relationship_edges WHERE method = 'github_fork') THEN 1 ELSE 0 END AS src, coalesce(n, 0) AS n FROM comp LEFT JOIN cnt ON url = u),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY src DESC, n DESC, url) AS k, min(CASE WHEN src = 1 THEN url END) OVER (PARTITION BY label) AS first_src FROM m)
SELECT label, CASE WHEN n > 0 THEN url ELSE first_src END AS canonical_url FROM r WHERE k = 1""",
    "extend_commit_ids": """WITH e AS (SELECT o_orderkey AS k, concat('https://github.com/o/r', CAST(o_custkey % 97 AS VARCHAR)) AS project_url, sha1(CAST(o_orderkey AS VARCHAR)) AS full_id FROM orders),
s AS (SELECT k, project_url, substring(full_id, 1, CAST(5 + k % 8 AS INT)) AS commit_id FROM e),
hit AS (SELECT s.project_url, s.commit_id, min(f.full_id) AS full_id FROM (SELECT DISTINCT project_url, commit_id FROM s) s JOIN (SELECT DISTINCT project_url, full_id FROM e) f ON s.project_url = f.project_url AND substring(f.full_id, 1, 5) = substring(s.commit_id, 1, 5) AND starts_with(f.full_id, s.commit_id) GROUP BY 1, 2 HAVING count(*) = 1)
SELECT s.k, s.project_url, coalesce(h.full_id, s.commit_id) AS commit_id FROM s LEFT JOIN hit h ON s.project_url = h.project_url AND s.commit_id = h.commit_id""",
    "attach_commit_data": "WITH c AS (SELECT project_url, commit_id, arg_min(message, row_id) FILTER (message IS NOT NULL) AS m FROM commit_data GROUP BY 1, 2) SELECT entry_id, coalesce(e.commit.message, m) AS message, coalesce(array_to_string(e.commit.files_changed, '|'), '') AS files FROM entries e LEFT JOIN c ON e.project_url = c.project_url AND e.commit_id = c.commit_id",
    "files_from_diff": f"WITH x AS (SELECT entry_id, regexp_extract_all(e.commit.diff, {_HEADER}, 2) AS b FROM entries e) SELECT entry_id, coalesce(array_to_string(list_sort(list_distinct([substring(p, 3) FOR p IN b])), '|'), '') AS files FROM x",
    "git_show_parse": "SELECT o_orderkey, concat('order ', CAST(o_orderkey AS VARCHAR), chr(10), chr(10), o_orderpriority) AS message, epoch_us(date_trunc('second', o_orderdate)) AS authored_us, 'f.c' AS files FROM orders",
    "signature": f"WITH x AS (SELECT entry_id, project_url, e.commit.message AS m, e.commit.files_changed AS f, list_sort([p FOR p IN e.commit.files_changed IF lower(regexp_extract(p, '([^/]*)/*$', 1)) NOT IN ({_TEMPLATE})]) AS r FROM entries e) SELECT entry_id, CASE WHEN m IS NOT NULL THEN sha256(m || chr(10) || concat_ws('|', project_url, 'a@b', CAST(entry_id AS VARCHAR))) END AS content_hash, sha256(array_to_string(r, chr(10))) AS files_hash FROM x WHERE len(f) BETWEEN 2 AND 20 AND len(r) >= 2",
    "union_sources": "WITH a AS (SELECT coalesce(max(entry_id), 0) + 1 AS k FROM entries WHERE split = 'test'), b AS (SELECT k + coalesce(max(entry_id), 0) + 1 AS k FROM entries, a WHERE split = 'train' GROUP BY a.k) SELECT entry_id, project_url, ghsa_id, entry_id AS ord FROM entries WHERE split = 'test' UNION ALL SELECT entry_id, project_url, NULL, k + entry_id FROM entries, a WHERE split = 'train' UNION ALL SELECT entry_id, project_url, ghsa_id, k + entry_id FROM entries, b WHERE split IS NULL OR split NOT IN ('test', 'train')",
    "variant_overlap": "SELECT entry_id FROM entries WHERE list_has_any(src_datasets, ['SecTrace', 'OpenMend'])",
    "history_sample": f"WITH {_HIST} SELECT url, commit_id, pos FROM samp",
    "shared_commits": f"WITH {_HIST} SELECT commit_id, array_to_string(list_sort(list(DISTINCT url)), '|') AS urls FROM samp GROUP BY 1 HAVING count(DISTINCT url) >= 2",
    "pair_overlap": f"""WITH {_HIST}, p AS (SELECT DISTINCT a.url AS url1, b.url AS url2 FROM samp a JOIN samp b ON a.commit_id = b.commit_id AND a.url < b.url),
full_ AS (SELECT DISTINCT url, commit_id FROM hist), sz AS (SELECT url, count(*) AS n FROM full_ GROUP BY 1),
s AS (SELECT url1, url2, count(*) AS n_shared FROM p JOIN full_ a ON a.url = url1 JOIN full_ b ON b.url = url2 AND a.commit_id = b.commit_id GROUP BY 1, 2)
SELECT url1, url2, n_shared, round(n_shared / CAST(least(x.n, y.n) AS DOUBLE), 6) AS overlap FROM s JOIN sz x ON x.url = url1 JOIN sz y ON y.url = url2 WHERE n_shared / CAST(least(x.n, y.n) AS DOUBLE) >= 0.1""",
    "commit_complete": "WITH x AS (SELECT entry_id, CASE WHEN length(e.commit.diff) <= 100000 THEN e.commit.diff END AS diff, e.commit AS c FROM entries e) SELECT entry_id, (c.message IS NOT NULL AND diff IS NOT NULL AND c.authored_at IS NOT NULL AND c.committed_at IS NOT NULL AND len(c.files_changed) > 0) AS complete, CAST(length(diff) AS BIGINT) AS n_diff FROM x",
    "clone_strategy": "SELECT project_url, count(DISTINCT commit_id) AS n_commits, CASE WHEN count(DISTINCT commit_id) >= 100 THEN 'FULL' ELSE 'PARTIAL' END AS strategy FROM entries GROUP BY 1",
}
