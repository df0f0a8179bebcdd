import json
from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from fixloom.operators import relationships as rel
from fixloom.operators import splits, stats
from test_operators import entries

EDGE = "url1 string, url2 string, method string, commit_ids array<string>"


def test_discovery_lookup_and_round_trip(spark, tmp_path):
    same = [(u, p, f"c{p}") for u in ("https://a/x", "https://b/x") for p in range(30)]
    far = [("https://c/x", p, f"c{p}" if p < 2 else f"other{p}") for p in range(60)]
    history = spark.createDataFrame(same + far, "url string, pos int, commit_id string")
    substantial = history.select("commit_id").distinct().where("commit_id <> 'c0'")
    forks = spark.createDataFrame([("https://d/x", "https://a/x", "https://a/x"), ("https://e/x", None, None)], "url string, parent string, source string")
    groups, members, edges = rel.discover(history, substantial, forks)
    local = edges.where("method = 'local_history'").collect()
    assert [(r.url1, r.url2, len(r.commit_ids)) for r in local] == [("https://a/x", "https://b/x", 29)]  # c shares too little
    row = groups.collect()
    assert [(g.group_id, g.canonical_url, g.project_urls, g.detection_methods, g.n_links) for g in row] == [("https://a/x", "https://a/x", ["https://a/x", "https://b/x", "https://d/x"], ["github_fork", "local_history"], 29)]
    rel.save_relationships(groups, members, str(tmp_path))
    again, who = rel.load_relationships(spark, str(tmp_path))
    assert again.collect() == groups.select(*again.columns).collect() and sorted(map(tuple, who.collect())) == sorted(map(tuple, members.collect()))
    asked = spark.createDataFrame([("https://a/x", "https://d/x"), ("https://a/x", "https://c/x"), (None, None), ("https://b/x", "https://b/x")], "url1 string, url2 string")
    assert {(r.url1, r.url2): r.related for r in rel.are_related(asked, who).collect()} == {("https://a/x", "https://d/x"): True, ("https://a/x", "https://c/x"): False, (None, None): False, ("https://b/x", "https://b/x"): True}
    assert {r.url: r.group_id for r in rel.group_of(asked.select(F.col("url2").alias("url")), who).collect()} == {"https://d/x": "https://a/x", "https://c/x": None, None: None, "https://b/x": "https://a/x"}
    none, nobody, no_edges = rel.discover(history.limit(0), substantial.limit(0), forks.limit(0))
    assert none.count() == nobody.count() == no_edges.count() == 0


def test_revalidation(spark):
    edges = spark.createDataFrame([("a", "b", "github_fork", []), ("b", "c", "local_history", ["x1"]), ("c", "d", "local_history", ["x2"]), ("a", None, "github_fork", None), ("a", "a", "github_fork", [])], EDGE)
    _, members = rel.groups_of_edges(edges, edges.limit(0).select(F.col("url1").alias("url")), spark.createDataFrame([("a", 5)], "url string, n long"))
    sig = "url string, commit_id string, content_hash string, files_hash string"
    left = lambda *rows: sorted(r.url for r in rel.revalidated(members, edges, spark.createDataFrame(list(rows), sig)).collect())
    assert left() == ["c", "d"]
    assert left(("b", "n1", "h", "f"), ("c", "n1", "h", "f")) == ["d"]  # one linked commit and one new one
    assert left(("b", "n1", "h", "f"), ("c", "n1", "other", "f")) == ["c", "d"]  # signatures differ
    assert left(("b", "x1", "h", "f"), ("c", "x1", "h", "f")) == ["c", "d"]  # the linked commit counts once
    assert left(*((u, f"n{i}", "h", "f") for u in "cd" for i in range(2))) == ["c", "d"]  # joined to each other alone
    assert left(("b", "n1", "h", "f"), ("c", "n1", "h", "f"), ("c", "n2", "h", "f"), ("d", "n2", "h", "f")) == []


def brute_score(placed, sizes):
    of = defaultdict(lambda: [0, 0, 0])
    for key, split in placed.items():
        n, v = sizes[key]
        of[split] = [of[split][0] + 1, of[split][1] + n, of[split][2] + v]
    per = [of[s][1] / of[s][0] if of[s][0] else 0 for s in ("train", "validation", "test")]
    fix = [of[s][2] / of[s][1] if of[s][1] else 0 for s in ("train", "validation", "test")]
    spread = lambda xs: max(abs(x - sum(xs) / 3) for x in xs) / (sum(xs) / 3) if sum(xs) else 0.0
    return 0.4 * spread(per) + 0.6 * spread(fix)


def test_best_of_many_seeds(spark):
    sizes = {f"g{i}": (1 + i * 7 % 23, i % (2 + i * 7 % 23)) for i in range(90)}
    df = spark.createDataFrame([(k, n, v) for k, (n, v) in sizes.items()], "group_key string, n long, n_vfc long")
    every = defaultdict(dict)
    for r in splits.seeded_splits(df, list(range(1, 13)), (0.6, 0.2, 0.2)).collect():
        every[r.seed][r.group_key] = r.split
    assert all(set(p) == set(sizes) for p in every.values()) and len({tuple(sorted(p.items())) for p in every.values()}) > 1
    alone = {r.group_key: r.split for r in splits.group_stratified_split(df, 5, (0.6, 0.2, 0.2)).collect()}
    assert alone == every[5]
    want = sorted((round(brute_score(p, sizes), 9), s) for s, p in every.items())[:3]
    scores, placed = splits.top_splits(df, 12, 3)
    assert [(round(r.combined_score, 9), r.seed) for r in scores.orderBy("combined_score", "seed").collect()] == want
    assert {r.seed for r in placed.select("seed").distinct().collect()} == {s for _, s in want} and placed.count() == 270


def test_report_and_files(spark, tmp_path):
    urls = ["https://f.example/o/big"] * 40 + ["https://f.example/o/twin"] * 5 + [f"https://f.example/o/s{i}" for i in range(30)]
    df = entries(spark, *({"project_url": u, "is_vfc": i % 2 == 0, "commit": {"committed_at": datetime(2024, 1, 1)}} for i, u in enumerate(urls)))
    members = spark.createDataFrame([(u, "g", "https://f.example/o/big") for u in ("https://f.example/o/big", "https://f.example/o/twin")], "url string, group_id string, canonical_url string")
    splits_ = df.select("_ord", F.when(F.col("_ord") < 45, "train").otherwise("test").alias("split"))
    groups = stats.split_groups(df.join(splits_, "_ord"), members, "split")
    lines = splits.split_report(groups)
    assert lines[0] == "train (60.0%) - 45 commits, 1 projects, 2 repos - fixes: 51.1%" and lines[2] == f"  {'#' * 30} o/big [2 repos] (45)"
    assert "validation (0.0%) - 0 commits" in lines and any("more large projects" in x for x in lines)
    assert splits.split_report(groups.limit(0)) == ["Empty split"]
    splits.write_splits(df, splits_, str(tmp_path), "name", "random")
    count = lambda s: spark.read.option("header", True).csv(f"{tmp_path}/name-random-{s}.csv").count()
    assert (count("train"), count("test"), count("validation")) == (45, 30, 0)


def test_url_maps(spark, tmp_path):
    (tmp_path / "moved.json").write_text(json.dumps({"https://a/x": "https://b/x", "https://c/x": None}))
    assert sorted(map(tuple, rel.url_map(spark, str(tmp_path / "moved.json")).collect())) == [("https://a/x", "https://b/x"), ("https://c/x", None)]
