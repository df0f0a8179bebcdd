from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fixloom.operators import enrich, filters, history, merge, splits, stats
from fixloom.schema import ENTRY, conform

URL, URL2 = "https://github.com/test/repo1", "https://github.com/test/repo2"
NONE = {"function_name": None, "function_file": None, "ghsa_id": None, "owasp_categories": None, "cve_ids": [], "cwe_ids": [], "src_datasets": ["a"], "is_vfc": True, "project_url": URL, "commit_id": "abcdef1"}


def entries(spark, *rows):
    full = []
    for i, r in enumerate(rows):
        commit = {"message": None, "diff": None, "files_changed": [], "authored_at": None, "committed_at": None} | r.pop("commit", {})
        full.append(NONE | {"_ord": i} | r | {"commit": commit})
    return spark.createDataFrame([tuple(f[x.name] for x in ENTRY) for f in full], ENTRY)


def test_every_field_has_a_rule():
    covered = {*merge.SETS, *merge.FIRST_KNOWN, *merge.FIRST, "owasp_categories", "commit", "_ord"}
    assert covered == {f.name for f in ENTRY}


def test_merge(spark):
    df = entries(spark, {"cve_ids": ["CVE-2020-0002"], "owasp_categories": [0], "commit": {"files_changed": ["b"]}}, {"cve_ids": ["CVE-2020-0001"], "src_datasets": ["b"], "owasp_categories": [3], "ghsa_id": "g", "commit": {"message": "m", "files_changed": ["a"]}})
    row = merge.deduplicate_functions(df).first()
    assert (row.cve_ids, row.src_datasets, row.owasp_categories, row.ghsa_id, row.commit.message, row.commit.files_changed, row._ord) == (["CVE-2020-0001", "CVE-2020-0002"], ["a", "b"], [0, 3], "g", "m", ["a", "b"], 0)


def test_conflicts(spark):
    df = entries(spark, {"function_name": "f"}, {"function_name": "f", "is_vfc": False}, {"function_name": "g", "function_file": "x.c"}, {"commit_id": "abcdef2", "function_name": "h", "function_file": "y.c"})
    assert sorted(r.function_name for r in merge.deduplicate_functions(df).collect()) == ["g", "h"]
    assert [(r.commit_id, r.function_name, r.function_file) for r in merge.deduplicate_commits(df).collect()] == [("abcdef2", None, None)]
    got = {r.commit_id: (r.is_vfc, r.function_name, r.function_file) for r in merge.collapse_to_commits(df).collect()}
    assert got == {"abcdef1": (True, None, "x.c"), "abcdef2": (True, None, "y.c")}
    benign = entries(spark, {"is_vfc": False})
    assert merge.collapse_to_commits(benign, False).count() == 0 and merge.collapse_to_commits(benign).count() == 1
    assert merge.collapse_to_commits(df.limit(0)).count() == 0 and merge.deduplicate_functions(df.limit(0)).count() == 0


def test_related(spark):
    members = spark.createDataFrame([(URL, "g", URL2), (URL2, "g", URL2)], "url string, group_id string, canonical_url string")
    df = entries(spark, {}, {"project_url": URL2, "is_vfc": False}, {"commit_id": "abcdef2"}, {"project_url": "https://x.org/y"})
    got = sorted((r.project_url, r.commit_id, r.is_vfc) for r in merge.deduplicate_related(df, members).collect())
    assert got == [(URL, "abcdef2", True), (URL2, "abcdef1", True), ("https://x.org/y", "abcdef1", True)]


def test_unique_diffs(spark):
    df = entries(spark, {"commit": {"diff": "d"}}, {"commit_id": "abcdef0", "commit": {"diff": "d"}}, {}, {}, {"commit": {"diff": ""}}, {"commit": {"diff": "d", "files_changed": ["f"]}})
    assert sorted(r._ord for r in filters.unique_diffs(df).collect()) == [1, 2, 3, 4, 5]


def test_filters(spark):
    df = entries(spark, {"function_file": "a.C"}, {"commit": {"files_changed": ["x.py"]}}, {}, {"commit": {"diff": "x" * 11}, "src_datasets": ["b", "c"]})
    assert [r._ord for r in filters.with_extensions(df, ["c"]).collect()] == [0]
    assert [r._ord for r in filters.from_sources(df, ["c"]).collect()] == [3]
    assert filters.with_diff(df).count() == 1 and filters.with_diff(filters.bound_diffs(df, 10)).count() == 0
    moves = spark.createDataFrame([(URL, URL2)], "old_url string, new_url string")
    assert {r.project_url for r in filters.moved(df, moves).collect()} == {URL2}
    assert filters.reachable(df, spark.createDataFrame([(URL,)], "url string")).count() == 0
    assert sorted(r._ord for r in filters.union_sources(df.limit(1), df.limit(1)).collect()) == [0, 1]  # after the largest of the source before
    total = {r.src_dataset: (r.total, r.with_diff, r.projects) for r in stats.dataset_stats(df).collect()}
    assert total == {"a": (3, 0, 1), "b": (1, 1, 1), "c": (1, 1, 1), "TOTAL": (4, 1, 1)}


def test_conform(spark):
    df = entries(spark, {"commit_id": " ABCDEF1.patch", "project_url": "git@github.com:T/R.git", "cwe_ids": ["CWE-79", "bad"], "cve_ids": ["x"]}, {"commit_id": "zz"}, {"project_url": "n/a"}, {"src_datasets": []}, {"owasp_categories": [9], "cwe_ids": ["CWE-79"]})
    rows = conform(df).orderBy("_ord").collect()
    assert [(r.project_url, r.commit_id, r.cwe_ids, r.cve_ids, r.owasp_categories) for r in rows] == [("https://github.com/t/r", "abcdef1", ["CWE-79"], [], [3]), (URL, "abcdef1", ["CWE-79"], [], [9])]
    with pytest.raises(Exception, match="no source|bad commit id|bad project url"):
        conform(df, "fail").collect()


def test_history(spark):
    h = spark.createDataFrame([("u", i, f"c{i}") for i in range(20)] + [("v", i, f"c{i + 15}") for i in range(6)], "url string, pos int, commit_id string")
    s = history.history_sample(h, 3, 3, 2)
    assert sorted(r.pos for r in s.where("url = 'u'").collect()) == [0, 1, 2, 15, 16, 17] and sorted(r.pos for r in s.where("url = 'v'").collect()) == [0, 1, 2, 3][:4][:3] + [3][:1]
    assert history.shared_commits(s).count() == 3
    assert [(r.url1, r.url2, r.n_shared, round(r.overlap, 3)) for r in history.pair_overlaps(h, s).collect()] == [("u", "v", 5, 0.833)]
    assert history.pair_overlaps(h, s, 0.9).count() == 0


def test_graph(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "d"), ("x", "y"), ("e", None)], "url1 string, url2 string")
    assert sorted(map(tuple, history.components(e).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    chain = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(40)], "url1 string, url2 string")
    assert {r.label for r in history.components(chain).collect()} == {"0000"}
    m = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "url string, label string")
    n = spark.createDataFrame([("a", 9), ("b", 5)], "url string, n long")
    assert history.canonical_urls(m, spark.createDataFrame([("b",)], "url string"), n).first().canonical_url == "b"
    assert history.canonical_urls(m, m.select("url").limit(0), n).first().canonical_url == "a"
    assert history.canonical_urls(m, m.select("url").limit(0), n.limit(0)).first().canonical_url is None
    members = m.withColumn("canonical_url", F.lit("a"))
    edges = spark.createDataFrame([("a", "b", "github_fork"), ("b", "c", "local_history")], "url1 string, url2 string, method string")
    one = spark.createDataFrame([("a", "k1", "b"), ("a", "k1", "c")], "label string, commit_id string, url string")
    two = one.unionByName(spark.createDataFrame([("a", "k2", "b"), ("a", "k2", "c")], "label string, commit_id string, url string"))
    assert [r.url for r in history.suspicious_urls(members, edges, one).collect()] == ["c"] and history.suspicious_urls(members, edges, two).count() == 0
    forks = spark.createDataFrame([("b", "a", "a"), ("c", None, "a"), ("a", None, None)], "url string, parent string, source string")
    assert sorted((r.url1, r.url2) for r in history.fork_edges(forks).collect()) == [("a", "b"), ("a", "c")]


def test_splits(spark):
    df = entries(spark, *({"commit": {"committed_at": datetime(2020, 1, 1 + i % 28, i % 24)}} for i in range(100)))
    ratios = (0.6, 0.2, 0.2)
    t = {r._ord: r.split for r in splits.temporal_split(df, ratios).collect()}
    order = sorted(range(100), key=lambda i: (1 + i % 28, i % 24, i))
    assert [t[i] for i in order] == ["train"] * 60 + ["validation"] * 20 + ["test"] * 20
    for f in (splits.hash_split, splits.shuffled_split):
        a, b = ({r._ord: r.split for r in f(df, 3, ratios).collect()} for _ in range(2))
        assert a == b and sorted(a.values()).count("train") == 60
    with pytest.raises(ValueError):
        splits.temporal_split(entries(spark, {}), ratios)
    with pytest.raises(ValueError):
        splits.hash_split(df, 1, (0.5, 0.1, 0.1))
    assert splits.cut_points(100, (0.29, 0.5, 0.21))[0] == 28
    sizes = spark.createDataFrame([(f"g{i}", 1 + i * 7 % 40) for i in range(60)], "group_key string, n long")
    got = splits.group_stratified_split(sizes, 5).join(sizes, "group_key").groupBy("split").agg(F.sum("n").alias("n"))
    n = {r.split: r.n for r in got.collect()}
    assert abs(n["train"] / sum(n.values()) - 0.8) < 0.02 and abs(n["test"] / sum(n.values()) - 0.1) < 0.02


def test_enrich(spark):
    known = spark.createDataFrame([(URL, "abcdef1" + "0" * 33), (URL, "abcdef2" + "0" * 33), (URL, "abcdef2" + "1" * 33)], "project_url string, full_id string")
    got = sorted(r.commit_id for r in enrich.extend_ids(entries(spark, {}, {"commit_id": "abcdef2"}, {"commit_id": "fffffff"}), known).collect())
    assert got == ["abcdef1" + "0" * 33, "abcdef2", "fffffff"]
    data = entries(spark, {"commit": {"message": "new", "diff": "d"}}).select("project_url", "commit_id", F.col("commit").alias("data"))
    row = enrich.attach(entries(spark, {"commit": {"message": "old"}}), data).first()
    assert (row.commit.message, row.commit.diff) == ("old", "d")
    new = spark.createDataFrame([(URL, "abcdef1", "short")], "project_url string, commit_id string, diff string")
    assert enrich.replace_diffs(entries(spark, {"commit": {"diff": "long"}}), new).first().commit.diff == "short"
    blobs = spark.createDataFrame([("a.c", "int a; // b\n"), ("a.md", "# t")], "path string, code string")
    assert [r.code for r in enrich.strip_code(blobs).orderBy("path").collect()] == ["int a;\n", "# t"]
    seen = enrich.fetch(entries(spark, {}, {}), lambda it: (b.assign(n=len(b)) for b in it), "project_url string, commit_id string, n long")
    assert seen.count() == 1


def test_union_of_many_partitions(spark):
    """Row numbers of 200 partitions and more: no two rows of a union share one, and sources keep their order."""
    part = lambda: spark.range(400).repartition(250).select(F.col("id").cast("string").alias("project_url")).withColumn("_ord", F.monotonically_increasing_id())
    a, b, none = part().withColumn("s", F.lit(0)), part().withColumn("s", F.lit(1)), part().withColumn("s", F.lit(2)).limit(0)
    got = filters.union_sources(filters.union_sources(a, b), none, a.withColumn("s", F.lit(3))).select("s", "_ord").collect()
    assert len(got) == 1200 and len({r["_ord"] for r in got}) == 1200
    assert [r.s for r in sorted(got, key=lambda r: r["_ord"])] == [0] * 400 + [1] * 400 + [3] * 400
