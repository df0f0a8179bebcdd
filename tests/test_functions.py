from pyspark.sql import functions as F

from fixloom.functions import comments, commit_text, giturl, identity, ids, owasp, paths


def values(spark, data, f):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_repo_key(spark):
    want = "https://forge.example/own/repo"
    forms = [want, "HTTPS://Forge.Example/Own/Repo", "http://www.forge.example/own/repo.git", "git@forge.example:own/repo.git", "ssh://git@forge.example/own/repo", "git://forge.example/own/repo.git/",
             "https://bot@forge.example:443/own/repo/", "https://forge.example/own/repo/tree/main/src", "https://forge.example/own/repo/-/tree/main", "https://forge.example/own/repo/commit/0123456", "https://forge.example/own/repo?a=b#c",
             "https://forge.example/own/re%70o", "  https://forge.example/own/repo\n"]
    assert values(spark, forms, identity.repo_key) == [want] * len(forms)
    assert values(spark, ["https://g.example/a/b/c", "https://forge.example/a/b-c_d.e"], identity.repo_key) == ["https://g.example/a/b/c", "https://forge.example/a/b-c_d.e"]
    assert values(spark, [None, "", " ", "n/a", "https://forge.example", "x" * 100_000, "https://h.example/" + "a/" * 50_000], identity.repo_key) == [None] * 7


def test_commit_key(spark):
    full = "0123456789abcdef0123456789abcdef01234567"
    forms = [full, full.upper(), f" {full}.patch ", f"{full}#", f"{full}?w=1#L2", f"{full}.,", f"https://f.example/o/r/commit/{full}", f"\t{full}\n", f"{full}.diff"]
    assert values(spark, forms, identity.commit_key) == [full] * len(forms)
    assert values(spark, [None, "", "main", "12345", full + "0", "ABCDEF1"], identity.commit_key) == [None, None, None, None, None, "abcdef1"]


def test_git_url(spark):
    cases = {
        "https://github.com/Owner/Repo.git": "https://github.com/owner/repo", "https://github.com/owner": "https://github.com/owner", "https://github.com/": None, "git@github.com:O/R.git": "https://github.com/o/r",
        "https://gitlab.com/G/s/R/-/commit/abcdef1": "https://gitlab.com/G/s/R", "https://bitbucket.org/O/R/commits/abcdef1": "https://bitbucket.org/O/R", "https://a.googlesource.com/platform/x/+/abcdef1^!/": "https://a.googlesource.com/platform/x",
        "https://git.savannah.gnu.org/cgit/bash.git/commit/?id=abc": "https://git.savannah.gnu.org/git/bash.git", "https://git.kernel.org/pub/scm/a/b.git/commit/?id=abcdef1": "https://git.kernel.org/pub/scm/a/b.git",
        "https://cgit.freedesktop.org/mesa/mesa/commit/?id=abcdef1": "https://cgit.freedesktop.org/mesa/mesa", "https://h.org/project/?p=project.git": "https://h.org/project", "https://h.org/?p=x.git;h=abcdef1": "https://h.org/?p=x.git",
        "https://h.org/a/b/commit/abcdef1": "https://h.org/a/b", "ftp://x/y": None, "git://h.org/a/b.git": "https://h.org/a/b", "": None,
    }
    assert values(spark, list(cases), giturl.https_url) == list(cases.values())
    commits = {"https://github.com/o/r/commit/ABCDEF1": "abcdef1", "https://github.com/o/r/commit/v1-2-gabcdef12": "abcdef12", "https://github.com/o/r/pull/1/commits/abcdef1": None, "https://h.org/?p=x.git;h=abcdef1": "abcdef1"}
    assert values(spark, list(commits), lambda c: giturl.git_url(c)["commit_id"]) == list(commits.values())
    assert values(spark, ["https://github.com/O/R", None], giturl.path_name)[0] == "gh_o_r"
    assert values(spark, ["https://github.com/O/R", "https://h.org/a"], giturl.github_api_url) == ["https://api.github.com/repos/O/R", None]


def test_commit_id(spark):
    cases = {" abcdef1 ": "abcdef1", "abcdef1?w=1#x": "abcdef1", "ABCDEF1.patch": "abcdef1", "abcdef1,": "abcdef1", "https://github.com/o/r/commit/abcdef1.patch": "abcdef1", "master": None, "abc": None, "abcdef1\n": "abcdef1"}
    assert values(spark, list(cases), ids.commit_id) == list(cases.values())
    assert spark.range(1).select(ids.pinned(F.lit("https://github.com/dom4j/dom4j"), F.lit(" version-2.0.3 "))).first()[0].startswith("177069f0")
    assert spark.range(1).select(ids.pinned(F.lit("https://x"), F.lit("version-2.0.3"))).first()[0] is None


def test_sets(spark):
    row = spark.range(1).select(
        ids.cwe_set(F.array(*map(F.lit, ["79", "cwe-89", "CWE-022", "CWE-CUSTOM", "NA", " "]))), ids.cve_set(F.array(F.lit(" cve-2020-1234"), F.lit("CVE-1-1"), F.lit(None))), ids.cve_set(F.lit(None).cast("array<string>")),
        owasp.owasp_of(F.array(F.lit("CWE-79"), F.lit("CWE-22"))), owasp.owasp_of(F.array(F.lit("CWE-99999"))),
    ).first()
    assert list(row) == [["CWE-22", "CWE-79", "CWE-89"], ["CVE-2020-1234"], [], [1, 3], [0]]
    assert len(owasp.category_of()) == sum(len(v.split()) for v in owasp.CATEGORIES.values())


def test_paths(spark):
    assert values(spark, ["a.tar.gz", "foo.", "dir.c/", "..c", ".gitignore", "A.C", ""], paths.suffix) == [".gz", "", ".c", ".c", "", ".c", ""]
    assert values(spark, ["x/a.H", "a.pyi", "a.md", None], paths.language) == ["c", "python", None, None]
    assert values(spark, ["x/README.md", ".github", ".github/x.c"], paths.is_template) == [True, True, False]
    assert paths.extensions_for("go", "rust", "none") == {".go", ".rs"}


def test_diffs(spark):
    diff = 'diff --git a/x/y.c b/x/y.c\nindex 1..2\n--- a\ndiff --git a/old.c b/dev/null\ndiff --git "a/q r.c" "b/q r.c"\r\n'
    assert values(spark, [diff, None, "no"], commit_text.files_of_diff) == [["old.c", "q r.c", "x/y.c"], [], []]
    assert values(spark, ["a\r\nindex 1\r\nb\n\n"], commit_text.comparable_diff) == ["a\nb"]
    shown = "commit abc\nAuthor: X <x@y>\nDate:   Mon Jan 5 10:00:00 2015 +0200\n\n    Title\n\n    body\n        code\n\ndiff --git a/f.c b/f.c\n"
    got = values(spark, [shown, "commit a\nDate: never\n\n    T\n", None], lambda c: commit_text.commit_of_show(c))
    assert (got[0].message, got[0].files_changed, got[0].authored_at.isoformat()) == ("Title\n\nbody\n    code", ["f.c"], "2015-01-05T08:00:00")
    assert (got[1].message, got[1].diff, got[1].authored_at) == ("T", None, None)


def test_merge_and_signature(spark):
    a = commit_text.commit_of_diff(F.lit("diff --git a/f.c b/f.c"))
    b = commit_text.commit_struct(F.lit("m"), F.lit("other"), F.array(F.lit("z")), F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"))
    row = spark.range(1).select(commit_text.merge_commits(a, b).alias("c"), commit_text.is_complete(b).alias("done")).first()
    assert (row.c.message, row.c.diff, row.c.files_changed, row.done) == ("m", "diff --git a/f.c b/f.c", ["f.c"], False)
    sign = lambda *files: spark.range(1).select(commit_text.signature(F.lit("m"), F.lit("a"), F.lit("e"), F.lit(1), F.array(*map(F.lit, files)))).first()[0]
    assert sign("a.c") is None and sign("a.c", "README.md") is None and sign(*"abcdefghijklmnopqrstu") is None
    assert sign("a.c", "b.c", "LICENSE").files_hash == sign("b.c", "a.c").files_hash


def test_comments():
    c = 'int a; // x\n// only\n  /* b */\nchar *s = "// no"; /* y */ int b;\n'
    assert comments.strip_comments(c, "c") == 'int a;\nchar *s = "// no"; int b;\n'
    assert comments.strip_comments('x = 1  # c\n# only\ns = "#no"\n"""doc # x"""\n', "python") == 'x = 1\ns = "#no"\n"""doc # x"""\n'
    assert comments.strip_comments("x", "cobol") is None and comments.strip_comments(None, "c") is None and comments.strip_comments("/* open", "c") == ""


def test_long_queries_do_not_matter(spark):
    from fixloom.functions.identity import repo_key

    urls = {"https://f.example/A/b?" + "x" * 100_000: "https://f.example/a/b", "https://www.f.example/a/b.git#" + "/y" * 50_000: "https://f.example/a/b", "https://f.example/a/" + "p/" * 5_000: None, "https://f.example/a/b?x=%41": "https://f.example/a/b"}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", repo_key(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in rows} == urls


def test_commits_of_entries_by_join_or_broadcast(spark):
    from fixloom.operators.commits import commit_entries

    full = [f"{i % 40:07x}" + "a" * 32 + f"{i % 3}" for i in range(120)]
    rows = [(i, f"https://f.example/o/r{i % 5}", full[i]) for i in range(120)] + [(1000 + i, f"https://f.example/o/r{i % 7}", full[i][: 7 + i % 12]) for i in range(120)] + [(2000, None, full[0][:9]), (2001, None, None), (2002, "https://f.example/o/r0", "n/a")]
    df = spark.createDataFrame(rows, "entry_id long, project_url string, commit_id string")
    want = set()
    for i, url, c in rows:
        if c in (None, "n/a"):
            continue
        hits = {c} if len(c) == 40 else {f for _, u, f in rows if f and len(f) == 40 and u == url and f.startswith(c)}
        want |= {(i, h) for h in hits or {f"{url or ''}#{c}"}}
    for few in (0, 10_000):
        got = [tuple(r) for r in commit_entries(df, "entry_id", few=few).select("entry_id", "commit_of").collect()]
        assert len(got) == len(want) and set(got) == want


def test_comments_of_hard_code():
    strip = comments.strip_comments
    assert strip("var r = /[\"'/]\\/\\//g; // c\nx = a / b; // d / e\n", "javascript") == "var r = /[\"'/]\\/\\//g;\nx = a / b;\n"
    assert strip("f(/'/, `// ${a} /* b */`); /* c */\n", "javascript") == "f(/'/, `// ${a} /* b */`);\n"
    assert strip('auto s = R"x(// " )" /* no */)x"; // c\n', "cpp") == 'auto s = R"x(// " )" /* no */)x";\n'
    assert strip('String t = """\n// kept\n"quote" """; // c\n', "java") == 'String t = """\n// kept\n"quote" """;\n'
    assert strip("a; /* 1 */ /* 2 */ b; /* 3\n4 */ c;\n/* 5 */\n", "c") == "a; b; c;\n"
    assert strip("", "c") == "" and strip("fn f<'a>() {} // c", "rust") is None
    deep = "void f() " + "".join(f"{{ /* comment_{i} */ " for i in range(20_000)) + "} " * 20_000
    assert "comment_" not in strip(deep, "c") and strip("/* " * 100_000, "c") == "" and strip("'" * 100_001 + "// c", "c").startswith("''")


def test_diffs_of_files():
    assert comments.diff_of("a\nb\n", "a\nb\n", "p") == ""
    want = ["diff --git a/x/f.c b/x/f.c", "index 422c2b7..9405325 100755", "--- a/x/f.c", "+++ b/x/f.c", "@@ -1,2 +1,2 @@", " a", "-b", "+c", "\\ No newline at end of file"]
    assert comments.diff_of("a\nb\n", "a\nc", "x/f.c", "100755").split("\n")[4:] == want[4:]
    assert comments.diff_of("a\nb\n", "a\nc", "x/f.c", "100755").split("\n")[:1] == want[:1]
    assert comments._blob("") == "0000000" and comments._blob("hello\n") == "ce01362"  # as git names it


def test_commits_without_comments(spark):
    from fixloom.operators.enrich import diffs_without_comments

    rows = [("p", "c1", "b.c", "int a; // x\n", "int a; // y\n", None, "o1"), ("p", "c1", "a.py", "x = 1\n", "x = 2  # n\n", None, "o2"), ("p", "c1", "T.md", "a", "b", None, "o3"),
            ("p", "c2", "n.c", None, "int n;\n", None, "o4"), ("p", "c3", "only.c", "// a\n", "// b\n", None, "o5")]
    files = spark.createDataFrame(rows, "project_url string, commit_id string, path string, before string, after string, mode string, original string")
    got = {r.commit_id: r.diff for r in diffs_without_comments(files).collect()}
    assert got["c3"] == "" and got["c1"].startswith("o3\ndiff --git a/a.py b/a.py\n") and "b.c" not in got["c1"] and "+x = 2" in got["c1"] and "# n" not in got["c1"]
    assert "+int n;" in got["c2"] and "index 0000000.." in got["c2"]
    assert "o3" not in {r.commit_id: r.diff for r in diffs_without_comments(files, False).collect()}["c1"]
    assert diffs_without_comments(files.limit(0)).count() == 0
