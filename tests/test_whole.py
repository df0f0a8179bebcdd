"""The registered queries do the whole job: brute force on small tables, where SQL is of no help."""

import hashlib
import random
from collections import defaultdict
from datetime import date, datetime
from itertools import combinations

from pyspark.sql import functions as F

from fixloom.operators import splits
from fixloom.plans import curation

COMMIT = "struct<message:string,diff:string,files_changed:array<string>,authored_at:timestamp,committed_at:timestamp>"


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def brute_histories(rows):
    newest = {}
    for s, p, at in rows:
        newest[s, p] = max(newest.get((s, p), at), at)
    out = defaultdict(list)
    for (s, p), at in sorted(newest.items(), key=lambda kv: (-kv[1].toordinal(), kv[0][1])):
        out[f"https://github.com/s/r{s}"].append(hashlib.md5(str(p).encode()).hexdigest())
    return out


def test_histories_are_whole(spark, tmp_path):
    rows = [(s, p, date.fromordinal(730_000 + (p * 31 + s * 7) % 500)) for s in range(1, 6) for p in range(1, 400) if p % (s + 1) or p < 40] + [(1, 7, date(2020, 1, 1))]
    d = save(spark, tmp_path, "lineitem", rows, "l_suppkey long, l_partkey long, l_shipdate date")
    hist = brute_histories(rows)
    sample = {u: {i: c for i, c in enumerate(h) if i < 100 or (len(h) > 110 and len(h) - 110 <= i < len(h) - 10)} for u, h in hist.items()}
    assert min(map(len, hist.values())) > 110
    assert {(r.url, r.pos, r.commit_id) for r in curation.QUERIES["history_sample"](spark, d).collect()} == {(u, i, c) for u, s in sample.items() for i, c in s.items()}
    urls = defaultdict(set)
    for u, s in sample.items():
        for c in s.values():
            urls[c].add(u)
    assert {r.commit_id: r.urls for r in curation.QUERIES["shared_commits"](spark, d).collect()} == {c: "|".join(sorted(us)) for c, us in urls.items() if len(us) > 1}
    want = {}
    for a, b in combinations(sorted(hist), 2):
        n = len(set(hist[a]) & set(hist[b]))
        if set(sample[a].values()) & set(sample[b].values()) and n / min(len(hist[a]), len(hist[b])) >= 0.1:
            want[a, b] = (n, round(n / min(len(hist[a]), len(hist[b])), 6))
    assert want and {(r.url1, r.url2): (r.n_shared, r.overlap) for r in curation.QUERIES["pair_overlap"](spark, d).collect()} == want


def test_every_full_id_is_known(spark, tmp_path):
    d = save(spark, tmp_path, "orders", [(k, k % 5) for k in range(1, 300)], "o_orderkey long, o_custkey long")
    full = {k: (k % 5 % 97, hashlib.sha1(str(k).encode()).hexdigest()) for k in range(1, 300)}
    want = {}
    for k, (repo, sha) in full.items():
        hits = {f for r, f in full.values() if r == repo and f.startswith(sha[: 5 + k % 8])}
        want[k] = hits.pop() if len(hits) == 1 else sha[: 5 + k % 8]
    assert {r.k: r.commit_id for r in curation.QUERIES["extend_commit_ids"](spark, d).collect()} == want


def test_commit_urls_are_normalised(spark, tmp_path):
    sha = "71983e4e6116e296ae6cc755f716055d3bba6c3d"
    given = {
        f"https://github.com/a/b/commit/{sha}": sha, f" https://github.com/a/b/commit/{sha[:9].upper()}.patch?w=1#diff ": sha[:9], f"https://forgehub.example/a/b/commit/{sha}.diff,": None,
        f"https://gitlab.com/a/b/-/commit/{sha}": sha, f"https://bitbucket.org/a/b/commits/{sha[:12]}": sha[:12], f"https://forgehub.example/a/b/commit/{sha}": sha,
        "https://forgehub.example/a/b": None, f"x/{sha}": None, sha.upper() + ".patch": sha, "abcd": None,
    }
    d = save(spark, tmp_path, "entries", list(enumerate(given)), "entry_id long, commit_id string")
    assert [r.commit_id for r in curation.QUERIES["norm_commit"](spark, d).orderBy("entry_id").collect()] == list(given.values())


def test_whole_diffs_count_as_complete(spark, tmp_path):
    at = datetime(2024, 1, 1)
    sizes = {0: 400, 1: 401, 2: 100_000, 3: 100_001, 4: None}
    rows = [(i, ("m", None if n is None else "x" * n, ["f.c"], at, at)) for i, n in sizes.items()]
    d = save(spark, tmp_path, "entries", rows, f"entry_id long, commit {COMMIT}")
    got = {r.entry_id: (r.complete, r.n_diff) for r in curation.QUERIES["commit_complete"](spark, d).collect()}
    assert got == {0: (True, 400), 1: (True, 401), 2: (True, 100_000), 3: (False, None), 4: (False, None)}


def test_any_number_of_groups_is_placed(spark):
    size = F.when(F.col("id") % 1000 == 0, F.col("id") / 100 + 1).otherwise(F.col("id") % 7 + 1).cast("long")
    sizes = spark.range(120_000).select(F.concat(F.lit("g"), F.col("id")).alias("group_key"), size.alias("n"))
    got = splits.group_stratified_split(sizes, 3).join(sizes, "group_key").groupBy("split").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.countDistinct("group_key").alias("d"))
    rows = {r.split: r for r in got.collect()}
    total = sum(r.n for r in rows.values())
    assert sum(r.k for r in rows.values()) == sum(r.d for r in rows.values()) == 120_000
    assert all(abs(rows[s].n - share * total) <= 1 for s, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    one, two = (sorted(map(tuple, splits.group_stratified_split(sizes.where("group_key < 'g11'"), 3).collect())) for _ in range(2))
    assert one == two


def test_no_move_or_swap_is_missed():
    for seed in range(20):
        rng = random.Random(seed)
        groups = {rng.randrange(10_000, 90_000) * 10: rng.randrange(1, 3) for _ in range(500)}
        taken = splits.binary_counts(groups, 0.37, seed)
        assert all(0 <= taken[n] <= k for n, k in groups.items())
        gap = 0.37 * sum(n * k for n, k in groups.items()) - sum(n * k for n, k in taken.items())
        inside, outside = [0, *(n for n in groups if taken[n])], [0, *(n for n in groups if taken[n] < groups[n])]
        assert min(abs(gap - b + a) for a in inside for b in outside) >= abs(gap) - 1e-6
