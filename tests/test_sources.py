import json

import pytest
from pyspark.sql import Row

from fixloom import sinks
from fixloom.sources.registry import load, parse, sources
from fixloom.streaming.ingest import append, arrivals, incoming
from test_operators import entries

SHA = "a" * 40
U = f"https://github.com/o/r/commit/{SHA}"


def got(df):
    return sorted((r.project_url, r.commit_id, r.is_vfc) for r in df.collect())


WANT = ("https://github.com/o/r", SHA)


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def test_all_sources_are_there(spark):
    assert len(sources()) == 32 and len({s.name for s in sources()}) == 32


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"ref_link,commit_id,cve_id,cwe_id\n{U},,CVE-2020-1234,CWE-79\nhttps://github.com/x/y,,,\n")
    row = load(spark, "bigvul", raw=str(tmp_path / "a.csv")).collect()
    assert [(r.project_url, r.commit_id, r.cve_ids, r.owasp_categories, r.src_datasets) for r in row] == [(*WANT, ["CVE-2020-1234"], [3], ["bigvul"])]
    (tmp_path / "x.json").write_text('{"vul": ["github.com/o/r/commit/' + SHA + '",], "nonvul": ["' + U + '"],}')
    assert got(load(spark, "fixseeker_balanced", raw=str(tmp_path / "x.json"))) == [(*WANT, False), (*WANT, True)]
    (tmp_path / "p.txt").write_text(U + "\n")
    (tmp_path / "n.txt").write_text(U + "\nnope\n")
    assert got(load(spark, "commitvulfix", fixes=str(tmp_path / "p.txt"), others=str(tmp_path / "n.txt"))) == [(*WANT, False), (*WANT, True)]
    (tmp_path / "v.json").write_text(json.dumps({"https://github.com/o/r": {SHA: {"html_url": U, "sha": SHA}, "b" * 40: None}}))
    assert got(load(spark, "vudenc", raw=str(tmp_path / "v.json"))) == [(*WANT, True)]
    (tmp_path / "f.jsonl").write_text(json.dumps({"project_url": "None", "commit_url": U, "commit_id": SHA, "func_hash": 2**100, "target": 1, "cve": "CVE-2020-1234", "cwe": ["CWE-79"]}) + "\n")
    row = load(spark, "primevul", raw=str(tmp_path / "f.jsonl")).first()
    assert (row.project_url, row.function_name) == (WANT[0], str(2**100))


def test_tables(spark):
    fixes = frame(spark, "cve_id string, hash string, repo_url string", ("CVE-2020-1234", SHA, WANT[0]), (None, SHA, WANT[0]))
    classes = frame(spark, "cve_id string, cwe_id string", ("CVE-2020-1234", "CWE-79"), ("CVE-2020-1234", "CWE-22"), (None, "CWE-1"))
    assert got(parse(spark, "cvefixes", fixes=fixes, classes=classes)) == [(*WANT, True)] * 2
    scored = frame(spark, "cve_id string, hash string, repo_url string, score int", ("CVE-2020-1234", SHA, WANT[0], 70), ("CVE-2020-1234", "b" * 40, WANT[0], 10))
    assert got(parse(spark, "morefixes", commits=frame(spark, "hash string", (SHA,), ("b" * 40,)), fixes=scored, classes=classes)) == [(*WANT, True)]
    patch = "owner string, repo string, commit_id string, category string, CVE_ID string, CWE_ID string, diff_code string"
    rows = [("o", "r", SHA + " x", None, None, None, "diff --git a/f b/f\n"), ("o", "r", SHA, "non-security", None, None, None), ("NA", "r", SHA, "security", None, None, None)]
    assert got(parse(spark, "patchdb", raw=frame(spark, patch, *rows))) == [(*WANT, False), (*WANT, True)]
    assert got(parse(spark, "repospd", raw=frame(spark, patch, *rows))) == [(*WANT, False)]
    info = frame(spark, "cve_id string, cwe_id string, advisory_id string", ("CVE-2020-1234", "CWE-79", "GHSA-x"))
    cols = "cve_id string, github_username string, github_repository_name string, commit string, file string, method string, signature string"
    row = parse(spark, "cwe_bench_java", info=info, fixes=frame(spark, cols, ("CVE-2020-1234", "o", "r", SHA, "A.java", "m", None))).first()
    assert (row.function_name, row.ghsa_id, row.cwe_ids) == ("m", "GHSA-x", ["CWE-79"])
    maps = frame(spark, "fc_hash string, repo_url string, cve_id string, cwe_id string", (SHA, None, "CVE-2020-1234", "CWE-79"), (SHA, WANT[0], "CVE-2020-1235", None), (None, None, None, None))
    commits = frame(spark, "hash string, msg string, author_date string", (SHA, "m", "2020-01-01 00:00:00"))
    functions = frame(spark, "hash string, name string, filename string, start_line int, end_line int, before_change boolean", (SHA, "f", "a.c", 1, 2, True))
    row = parse(spark, "icvul", mapping=maps, commits=commits, functions=functions).first()
    assert (row.project_url, row.function_name, row.cve_ids, row.commit.message) == (WANT[0], "f-[1-2]", ["CVE-2020-1234", "CVE-2020-1235"], "m")
    spi = "commit_msg string, patch string, vulnerability int"
    history = frame(spark, "project_url string, commit_id string, pos int, message string, diff string", (WANT[0], SHA, 0, "fix it", "x\n"), (WANT[0], "b" * 40, 1, "fix  it", "y"), (WANT[0], "c" * 40, 2, "other", "z"))
    assert got(parse(spark, "spidb", first=frame(spark, spi, ("fix\nit", "index 1..2\nx", 1)), second=frame(spark, spi, ("other", "q", 0), ("none", "", 1)), history=history)) == [(*WANT, True), (WANT[0], "c" * 40, False)]
    mail = frame(spark, "content string, label string, CVE_ID string", (f"From {SHA} Mon Sep 17\nFrom: A <a@b>\n", "security", None), (f"From {SHA} x\n", None, "CVE-2020-1234"), ("no mail", "security", None))
    row = parse(spark, "pysecdb", raw=mail, repos=frame(spark, "sha string, url string", (SHA, WANT[0]))).collect()
    assert [(r.commit_id, r.is_vfc, r.cve_ids) for r in row] == [(SHA, True, ["CVE-2020-1234"])]
    diverse = frame(spark, "commit_id string, project string, hash string, target int, cwe array<string>, message string", (SHA, "p", str(2**100 + 5), 1, ["CWE-79"], "m"))
    row = parse(spark, "diversevul", raw=diverse, projects=frame(spark, "project string, url string", ("p", WANT[0]))).first()
    assert row.function_name == format(2**100 + 5, "x")
    mega = "git_url string, commit_hash string, repo_name string, func_name string, file_path string, is_vul boolean, cve_id string, cwe_ids array<string>"
    assert got(parse(spark, "megavul", first=frame(spark, mega, (None, SHA, "ffmpeg", "f", "a.c", True, None, None)), second=frame(spark, mega, (WANT[0], SHA, "r", None, "a.c", True, None, None)))) == [("https://github.com/ffmpeg/ffmpeg", SHA, True)]


def test_small_sources(spark):
    cases = {
        "devign": {"first": ("sha_id string, project string, vulnerability int", (SHA, "FFmpeg", 1)), "second": ("sha_id string, project string, vulnerability int", (SHA, "other", 1))},
        "dimva2025": {"first": ("Owner string, Repo string, Commit_ID string, CVE_ID string", ("o", "r", SHA, None)), "second": ("Owner string, Repo string, Commit_ID string, CVE_ID string", (None, "r", SHA, None))},
        "msr2019": {"raw": ("cve_id string, project_url string, commit_id string, pos string", (None, WANT[0], SHA, "pos"))},
        "secbench": {"raw": ("owner string, project string, sha string, cve_id string, cwe_id string", ("o", "r", SHA, None, None))},
        "tracer": {"raw": ("cve string, github_commit string, other_platform_git_commit string", ("CVE-2020-1234", None, U))},
        "vcmatch": {"raw": ("repo string, commit string, cve string", ("linux", SHA, None))},
        "patcheval": {"raw": ("cve_id string, patch_url array<string>, cwe_info map<string, string>", ("CVE-2020-1234", [U], {"CWE-79": "x"}))},
        "crossvul": {"raw": ("cwe_id string, cve_id string, commit_url string", ("CWE-79", "CVE-2020-1234", U))},
        "cc900": {"positive": ("project string, sha string, cve_id string, cwe_id string, message string, diff string", (WANT[0], SHA, None, None, "m", "d")), "negative": ("github string, cve_id string, cwe_id string, message string, diff string", ("bad", None, None, None, None))},
        "tqrg": {"positive": ("project string, sha string, cve_id string, cwe_id string", (WANT[0], SHA, None, None)), "negative": ("github string, cve_id string, cwe_id string", ("bad", None, None))},
        "bigvulfixes": {"raw": ("repo_url string, commit_id string, label int, vuln_id string, patch string, patch_date_dt string", ("o/r", SHA, 1, None, "d", "2020-01-01"))},
        "javavfc": {"raw": ("commit_link string, diff_raw string, date bigint", (U, "commit a\n\n    m\n", 0))},
        "cleanvul": {"raw": ("commit_url string, func_after string, file_name string, vulnerability_score int, cve_id string, cwe_id string, commit_msg string", (U, "f", "a.c", 3, None, None, "m"))},
        "secvuleval": {"raw": ("project_url string, commit_id string, func_name string, filepath string, is_vulnerable boolean, cve_list array<string>, cwe_list array<string>, commit_message string", (WANT[0], SHA, "f", "a.c", True, None, None, "m"))},
        "sven": {"raw": ("commit_link string, func_name string, file_name string, vul_type string", (U.removeprefix("https://"), "f", "a.c", "cwe-089"))},
    }
    for name, raw in cases.items():
        df = parse(spark, name, **{k: frame(spark, ddl, row) for k, (ddl, row) in raw.items()})
        assert [r.commit_id for r in df.collect()] == [SHA], name


def test_sinks(spark, tmp_path):
    import pytest

    full = {"commit": {"message": "m", "files_changed": ["b", "a"]}, "cve_ids": ["CVE-2020-1234", "CVE-2020-1235"]}
    df = entries(spark, dict(full), {"is_vfc": False})
    sinks.save_entries(df, str(tmp_path / "j"))
    back = sinks.load_entries(spark, str(tmp_path / "j")).orderBy("_ord").collect()
    assert [(r.is_vfc, r.cve_ids, r.commit.message) for r in back] == [(True, ["CVE-2020-1234", "CVE-2020-1235"], "m"), (False, [], None)]
    with pytest.raises(ValueError):
        sinks.save_entries(df.limit(0), str(tmp_path / "k"))
    (tmp_path / "old.jsonl").write_text('{"_metadata": {"version": 1}}\n')
    with pytest.raises(ValueError):
        sinks.load_entries(spark, str(tmp_path / "old.jsonl"))
    sinks.save_csv(df, str(tmp_path / "c"), ("project_url", "is_vfc", "cve_ids", "commit.message"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "c")).collect()), key=str) == [("https://github.com/test/repo1", "False", None, None), ("https://github.com/test/repo1", "True", "CVE-2020-1234;CVE-2020-1235", "m")]
    with pytest.raises(ValueError):
        sinks.save_csv(df, str(tmp_path / "d"), ("nope",))
    assert sinks.cached(df, str(tmp_path), "key").count() == 2 and sinks.cached(df.limit(0), str(tmp_path), "key").count() == 2


def test_streaming(spark, tmp_path):
    df = entries(spark, {"commit_id": "ABCDEF1"}, {"commit_id": "no"})
    df.write.json(str(tmp_path / "in"))
    query = append(incoming(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert [r.commit_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["abcdef1"]
    assert arrivals(incoming(spark, str(tmp_path / "in")).withColumn("at", __import__("pyspark").sql.functions.current_timestamp()), "at").isStreaming


def test_a_database_source(spark, tmp_path):
    """Tables of a database, over JDBC; the embedded one that Spark ships stands in."""
    sha = "0123456789abcdef0123456789abcdef01234567"
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    tables = {
        "commits_": spark.createDataFrame([(sha,), ("f" * 40,)], "hash string"),
        "fixes_": spark.createDataFrame([("CVE-2020-0001", sha, "https://github.com/a/b", 70), ("CVE-2020-0002", "f" * 40, "https://github.com/a/b", 10)], "cve_id string, hash string, repo_url string, score int"),
        "classes_": spark.createDataFrame([("CVE-2020-0001", "CWE-79")], "cve_id string, cwe_id string"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.format("jdbc").options(url=url, driver="org.apache.derby.jdbc.EmbeddedDriver").option("dbtable", name).save()
    options = {"url": url, "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = load(spark, "morefixes", options, commits="commits_", fixes="fixes_", classes="classes_").collect()
    assert [(r.project_url, r.commit_id, r.cve_ids, r.cwe_ids) for r in rows] == [("https://github.com/a/b", sha, ["CVE-2020-0001"], ["CWE-79"])]
    with pytest.raises(ValueError):
        load(spark, "morefixes", commits="commits_", fixes="fixes_", classes="classes_")


def test_projects_of_mails(spark):
    """A mail's repository: the hit whose first line agrees with the subject, an original before a fork."""
    mail = lambda sha, subject, label="security": (f"From {sha} Mon Sep 17 00:00:00 2001\nFrom: Ann Bee <ann@b.example>\nSubject: {subject}\n\ntext", label, "CVE-2020-1234")
    raw = frame(spark, "content string, label string, CVE_ID string", mail("a" * 40, "[PATCH] Fix  the Überflow"), mail("b" * 7, "=?utf-8?q?Fix_b?="), mail("c" * 40, "other"), ("no mail", "security", None))
    hits = [("a" * 40, "https://github.com/fork/r", "fix the berflow in x\n\nmore", True), ("a" * 40, "https://github.com/o/r", "[tag] Fix the flow", False), ("a" * 40, "https://github.com/real/r", "Fix the berflow", False),
            ("B" * 40, "https://github.com/o/b", "fix b", True), ("c" * 40, "https://github.com/o/c", "nothing like it", False), ("c" * 40, "https://github.com/o/c2", "", False)]
    rows = got(parse(spark, "pysecdb", raw=raw, repos=frame(spark, "sha string, url string, message string, fork boolean", *hits)))
    assert rows == [("https://github.com/o/b", "b" * 7, True), ("https://github.com/real/r", "a" * 40, True)]


def test_projects_by_name(spark):
    patch = "owner string, repo string, commit_id string, category string, CVE_ID string, CWE_ID string, diff_code string, ori_dataset string"
    rows = [(None, None, SHA, "security", None, None, None, "qemu"), ("o", "r", SHA, "", None, None, None, "other"), ("", "r", SHA, "security", None, None, None, None)]
    assert got(parse(spark, "repospd", raw=frame(spark, patch, *rows))) == [("https://github.com/qemu/qemu", SHA, True)]
    diverse = [(c, p, h, 1, [], "m") for c, p, h in ((SHA, "LibRSVG", "255"), ("34c95743ca692ea0e44778e41a7c0a129363de84", "librsvg", "ff"), (SHA, "none", "1"), (SHA, "librsvg", ""))]
    urls = frame(spark, "project string, url string, _row long", ("librsvg", "https://gitlab.gnome.org/GNOME/librsvg", 1), ("librsvg", "https://a.example/first", 2))
    out = parse(spark, "diversevul", raw=frame(spark, "commit_id string, project string, hash string, target int, cwe array<string>, message string", *diverse), projects=urls).collect()
    assert sorted((r.project_url, r.function_name) for r in out) == [("https://github.com/gnome/librsvg", "ff"), ("https://gitlab.gnome.org/GNOME/librsvg", "ff")]
    prime = "project_url string, commit_url string, project string, commit_id string, func_hash string, target int, cve string, cwe array<string>"
    raw = frame(spark, prime, ("None", "https://old.example/a/b.git", None, SHA, "h", 1, None, []), (None, "none", "binaryen", SHA, "h", 0, None, []), ("https://github.com/o/r", U, None, SHA, "h", 0, None, []))
    moved = frame(spark, "old_url string, new_url string", ("https://old.example/a/b.git", "https://mid.example/a/b"), ("https://mid.example/a/b", "https://github.com/New/b"), ("https://github.com/o/r", "https://x.example/y/z"))
    assert got(parse(spark, "primevul", raw=raw, moved=moved)) == [("https://github.com/new/b", SHA, True), ("https://github.com/o/r", SHA, False), ("https://github.com/webassembly/binaryen", SHA, False)]
