"""The sources by name. Paths are local or shared folders; downloading is outside the engine."""

from __future__ import annotations

from email.errors import HeaderParseError
from email.header import decode_header

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixloom.functions import ids
from fixloom.functions.giturl import https_url
from fixloom.functions.commit_text import commit_of_diff, commit_of_show, commit_struct, comparable_diff, merge_commits
from fixloom.sources.base import Raw, Source, array_of, entries_of, read_raw

C = F.col
GITHUB = "https://github.com/"
# Projects that sources name without a URL (fixed values).
DEVIGN = {"ffmpeg": GITHUB + "ffmpeg/ffmpeg", "qemu": GITHUB + "qemu/qemu"}
VCMATCH = {
    "FFmpeg": GITHUB + "FFmpeg/FFmpeg", "ImageMagick": GITHUB + "ImageMagick/ImageMagick", "jenkins": GITHUB + "jenkinsci/jenkins", "linux": GITHUB + "torvalds/linux",
    "moodle": GITHUB + "moodle/moodle", "openssl": GITHUB + "openssl/openssl", "php-src": GITHUB + "php/php-src", "phpmyadmin": GITHUB + "phpmyadmin/phpmyadmin",
    "qemu": GITHUB + "qemu/qemu", "wireshark": GITHUB + "wireshark/wireshark",
}
PRIMEVUL = {"binaryen": GITHUB + "WebAssembly/binaryen", "mjg59_linux": GITHUB + "torvalds/linux", "qemu_qemu": GITHUB + "qemu/qemu"}


def _named(table: dict[str, str], name: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[name]


def _repo(owner: Column, repo: Column) -> Column:
    return F.concat(F.lit(GITHUB), owner, F.lit("/"), repo)


def _secure(url: Column) -> Column:
    return F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://") | url.startswith("git@"), url).otherwise(F.concat(F.lit("https://"), url))


def _message(text: Column, diff: Column | None = None, at: Column | None = None) -> Column:
    none, time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    own = commit_struct(text, none, F.array().cast("array<string>"), time if at is None else at, time)
    return own if diff is None else merge_commits(own, commit_of_diff(diff))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of ``a``, then all of ``b``: row numbers of a read stay below 2**56 (8 million partitions)."""
    return a.unionByName(b.withColumn("_row", C("_row") + F.lit(1 << 56)), allowMissingColumns=True)


def _bigvul(raw):
    # One report links a branch; its commit is a fixed value.
    envoy = F.when(C("ref_link").contains("envoyproxy/envoy") & C("cve_id").contains("CVE-2019-15226"), F.struct(F.lit(GITHUB + "envoyproxy/envoy").alias("project_url"), F.lit("afc39bea36fd436e54262f150c009e8d72db5014").alias("commit_id")))
    fixed = F.coalesce(envoy, ids.pinned_in(C("ref_link")), ids.url_and_commit(C("ref_link"), C("commit_id")))
    return entries_of(raw, "bigvul", fixed, cves=array_of(C("cve_id")), cwes=array_of(C("cwe_id")))


def _bigvulfixes(raw):
    at = F.try_to_timestamp("patch_date_dt")
    none = F.lit(None).cast("string")
    commit = commit_struct(none, C("patch"), F.array().cast("array<string>"), at, F.lit(None).cast("timestamp"))
    return entries_of(raw, "bigvulfixes", ids.url_and_commit(F.concat(F.lit(GITHUB), C("repo_url")), C("commit_id")), C("label") == 1, array_of(C("vuln_id")), commit=commit)


def _pairs(name, shipped):
    def parse(positive, negative):
        df = _both(positive.withColumn("_pos", F.lit(True)), negative.withColumn("_pos", F.lit(False)))
        pin = F.when(ids.pinned_in(C("sha")).isNotNull(), ids.pinned_in(C("sha"))) if name == "tqrg" else F.lit(None)
        where = F.when(C("_pos"), F.coalesce(pin, ids.url_and_commit(C("project"), C("sha")))).otherwise(ids.url_and_commit(C("github")))
        return entries_of(df, name, where, C("_pos"), array_of(C("cve_id")), array_of(C("cwe_id")), commit=_message(C("message"), C("diff")) if shipped else None)

    return parse


def _commitvulfix(fixes, others):
    df = _both(fixes.withColumn("_vfc", F.lit(True)), others.withColumn("_vfc", F.lit(False)))
    return entries_of(df, "commitvulfix", ids.url_and_commit(C("value")), C("_vfc"))


def _crossvul(raw):
    where = ids.url_and_commit(C("commit_url"))
    return entries_of(raw, "crossvul", F.when(where["commit_id"].isNotNull(), where).otherwise(ids.pinned_in(C("commit_url"))), cves=array_of(C("cve_id")), cwes=array_of(C("cwe_id")))


def _cvefixes(fixes, classes):
    df = fixes.where("cve_id IS NOT NULL").join(classes.drop("_row"), "cve_id")
    return entries_of(df, "cvefixes", ids.url_and_commit(C("repo_url"), C("hash")), cves=array_of(C("cve_id")), cwes=array_of(C("cwe_id")))


def _devign(first, second):
    df = _both(first, second)
    return entries_of(df, "devign", ids.url_and_commit(_named(DEVIGN, F.lower("project")), C("sha_id")), C("vulnerability") == 1)


def _dimva(first, second):
    df = _both(first, second).where("Owner IS NOT NULL AND Repo IS NOT NULL")
    return entries_of(df, "dimva2025", ids.url_and_commit(_repo(C("Owner"), C("Repo")), C("Commit_ID")), cves=array_of(C("CVE_ID")))


def _fixseeker(name):
    def parse(raw):
        fixed = F.from_json(F.regexp_replace("value", r",\s*([}\]])", "$1"), "vul array<string>, nonvul array<string>")
        each = raw.select("_row", F.explode(F.concat(F.transform(fixed["vul"], lambda u: F.struct(u.alias("u"), F.lit(True).alias("v"))), F.transform(fixed["nonvul"], lambda u: F.struct(u.alias("u"), F.lit(False).alias("v"))))).alias("_e"))
        return entries_of(each, name, ids.url_and_commit(_secure(C("_e.u"))), C("_e.v"))

    return parse


def _javavfc(name):
    def parse(raw):
        at = F.timestamp_seconds("date")
        none = F.lit(None).cast("string")
        own = commit_struct(none, none, F.array().cast("array<string>"), F.lit(None).cast("timestamp"), at)
        return entries_of(raw, name, ids.url_and_commit(C("commit_link")), commit=merge_commits(commit_of_show(C("diff_raw")), own))

    return parse


def _morefixes(commits, fixes, classes):
    df = fixes.where("score >= 65 AND hash IS NOT NULL").join(commits.select("hash").distinct(), "hash", "left_semi").join(classes.drop("_row"), "cve_id", "left")
    once = df.withColumn("_rn", F.row_number().over(Window.partitionBy("hash").orderBy("_row", "cve_id", "cwe_id"))).where("_rn = 1")
    trimmed = F.when((F.length("hash") == 41) & C("hash").endswith("C"), F.substring("hash", 1, 40)).otherwise(C("hash"))
    from_url, own = ids.url_and_commit(C("repo_url")), ids.url_and_commit(C("repo_url"), trimmed)
    return entries_of(once, "morefixes", F.when(from_url["commit_id"].isNotNull(), from_url).otherwise(own), cves=array_of(C("cve_id")), cwes=array_of(C("cwe_id")))


def _patchdb(name):
    def parse(raw):
        named = _named(DEVIGN, C("ori_dataset")) if "ori_dataset" in raw.columns else F.lit(None).cast("string")
        own = F.when((C("owner") != "") & (C("repo") != "") & (C("owner") != "NA") & (C("repo") != "NA"), _repo(C("owner"), C("repo")))
        known = raw.withColumn("_url", F.coalesce(named if name == "repospd" else F.lit(None), own)).where("_url IS NOT NULL")
        vfc = ~F.coalesce(C("category"), F.lit("")).contains("non-security") if name == "patchdb" else C("category") != "non-security"
        known = known if name == "patchdb" else known.where("category <> ''")
        return entries_of(known, name, ids.url_and_commit(C("_url"), F.split_part(F.trim("commit_id"), F.lit(" "), F.lit(1))), vfc, array_of(C("CVE_ID")), array_of(C("CWE_ID")), commit=commit_of_diff(C("diff_code")))

    return parse


def _patcheval(raw):
    each = raw.select("_row", "cve_id", F.map_keys("cwe_info").alias("cwes"), F.explode("patch_url").alias("u"))
    return entries_of(each, "patcheval", ids.url_and_commit(C("u")), cves=array_of(C("cve_id")), cwes=C("cwes"))


def _decoded(subjects: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if not text or "=?" not in text:
            return text
        try:
            return "".join(part.decode(charset or "utf-8", "replace") if isinstance(part, bytes) else part for part, charset in decode_header(text))
        except (LookupError, ValueError, HeaderParseError):
            return text

    return subjects.map(one)


def _subject_key(subject: Column) -> Column:
    """A subject for comparison: decoded, without ``[tags]`` before it, ASCII alone, lower case, single spaces."""
    text = F.when(F.contains(subject, F.lit("=?")), F.pandas_udf(_decoded, T.StringType())(subject)).otherwise(subject)
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(?:\s*\[[^\]]+\]\s*)+", ""), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def _pysecdb(raw, repos):
    """Mails of patches. ``repos`` are what a search for each commit gave: ``sha, url`` and, to tell hits apart, ``message, fork``.

    A hit counts if its sha begins with the mail's and its first line agrees with the mail's subject (one begins the
    other); originals go before forks, then the first.
    """
    head = F.array_join(F.slice(F.split("content", r"\r?\n"), 2, 512), "\n")
    part = lambda pattern: F.nullif(F.trim(F.regexp_extract(head, pattern, 1)), F.lit(""))
    sha = F.nullif(F.lower(F.regexp_extract("content", r"(?i)^\s*From\s+([0-9a-f]{5,40})\s+", 1)), F.lit(""))
    mails = raw.withColumns({"_sha": sha, "_email": part(r"(?m)^From:\s+[^<]*<([^>]+)>"), "_user": part(r"(?m)^From:\s+(\w+)\s+<"), "_subject": part(r"(?m)^Subject:\s+(.*)$")}).where("_sha IS NOT NULL")
    known = lambda c: F.min_by(c, F.when(C(c).isNotNull(), C("_row"))).alias(c)
    mails = mails.groupBy("_sha").agg(F.min("_row").alias("_row"), *(known(c) for c in ("label", "CVE_ID", "_email", "_user", "_subject")))
    lacks = {"message": F.lit(None).cast("string"), "fork": F.lit(None).cast("boolean")}
    hits = repos.withColumns({c: v for c, v in lacks.items() if c not in repos.columns}).select(F.lower("sha").alias("_hit"), C("url").alias("_url"), "message", F.coalesce("fork", F.lit(False)).alias("_fork"), C("_row").alias("_at"))
    pairs = mails.withColumn("_k", F.substring("_sha", 1, 5)).join(hits.withColumn("_k", F.substring("_hit", 1, 5)), "_k").where(F.expr("startswith(_hit, _sha)"))
    if "message" in repos.columns:
        line, subject = _subject_key(F.trim(F.split_part("message", F.lit("\n"), F.lit(1)))), _subject_key(C("_subject"))
        pairs = pairs.withColumns({"_line": line, "_want": subject}).where("message <> '' AND (_want IS NULL OR _want = '' OR startswith(_line, _want) OR startswith(_want, _line))")
    rows = pairs.groupBy("_sha").agg(F.min_by("_url", F.struct("_fork", "_at")).alias("_url"), *(F.first(c).alias(c) for c in ("_row", "label", "CVE_ID")))
    return entries_of(rows, "pysecdb", ids.url_and_commit(C("_url"), C("_sha")), C("label") == "security", array_of(C("CVE_ID")))


def _spidb(first, second, history):
    df = _both(first, second).withColumn("_key", F.regexp_replace("commit_msg", r"\s+", "")).where("_key <> ''")
    known = history.select("project_url", "commit_id", C("pos").alias("_pos"), comparable_diff(C("diff")).alias("_diff"), F.regexp_replace("message", r"\s+", "").alias("_key"))
    counts = known.groupBy("_key").agg(F.count(F.lit(1)).alias("_k")).where("_k <= 2")
    hits = df.join(counts, "_key").join(known, "_key").where((C("_k") == 1) | (C("_diff") == comparable_diff(C("patch"))))
    one = hits.groupBy("_row").agg(F.min_by(F.struct("project_url", "commit_id"), "_pos").alias("_w"), F.first("vulnerability").alias("vulnerability"))
    return entries_of(one, "spidb", ids.url_and_commit(C("_w.project_url"), C("_w.commit_id")), C("vulnerability") == 1)


def _tracer(raw):
    first, second = ids.url_and_commit(C("github_commit")), ids.url_and_commit(C("other_platform_git_commit"))
    return entries_of(raw, "tracer", F.when(first["project_url"].isNotNull() & first["commit_id"].isNotNull(), first).otherwise(second), cves=array_of(C("cve")))


def _vudenc(raw):
    flat = raw.select("_row", F.explode(F.from_json("value", "map<string, map<string, struct<html_url: string, sha: string>>>")).alias("_repo", "_commits"))
    each = flat.select("_row", "_repo", F.explode("_commits").alias("_sha", "_c")).where("_c IS NOT NULL")
    return entries_of(each, "vudenc", ids.url_and_commit(F.coalesce("_c.html_url", "_repo"), F.coalesce("_c.sha", "_sha")))


def _cleanvul(raw):
    kept = raw.where("vulnerability_score >= 3 AND func_after <> ''")
    return entries_of(kept, "cleanvul", ids.url_and_commit(C("commit_url")), cves=array_of(C("cve_id")), cwes=array_of(C("cwe_id")), name=F.md5("func_after"), file=C("file_name"), commit=_message(C("commit_msg")))


def _cwe_bench(info, fixes):
    df = fixes.join(info.drop("_row"), "cve_id", "left")
    return entries_of(df, "cwe_bench_java", ids.url_and_commit(_repo(C("github_username"), C("github_repository_name")), C("commit")), cves=array_of(C("cve_id")), cwes=array_of(C("cwe_id")), name=F.coalesce("signature", "method"), file=C("file"), ghsa=F.when(C("advisory_id").startswith("GHSA-"), C("advisory_id")))


def _digits_to_hex(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda n: format(int(n), "x") if isinstance(n, str) and n.strip().isdigit() else None)


def _hex(number: Column) -> Column:
    """Whole numbers of any length in base 16; they exceed 64 bits, so no built-in serves."""
    return F.pandas_udf(_digits_to_hex, T.StringType())(number)


# Commits of one project name that belong to another repository than its others (fixed values).
DIVERSEVUL = {
    ("profanity", GITHUB + "johguse/profanity"): ["69ff010c14ff80ec14246772db6a245aa59e6689"],
    ("librsvg", GITHUB + "gnome/librsvg"): [
        "34c95743ca692ea0e44778e41a7c0a129363de84", "d83e426fff3f6d0fa6042d0930fb70357db24125", "f01aded72c38f0e18bc7ff67dee800e380251c8e",
        "40af93e6eb1c94b90c3b9a0b87e0840e126bb8df", "a51919f7e1ca9c535390a746fbf6e28c8402dc61", "d1c9191949747f6dcfd207831d15dd4ba00e31f2",
        "0035e95118a60c0cd3949c2300472d805e16a022", "ecf9267a24b2c3c0cd211dbdfa9ef2232511972a", "572f95f739529b865e2717664d6fefcef9493135",
    ],
}


def _diversevul(raw, projects):
    first = projects.groupBy(F.lower("project").alias("_project")).agg(F.min_by("url", "_row").alias("_listed"))
    df = raw.withColumn("_project", F.lower("project")).join(first, "_project", "left")
    commit, special = ids.commit_id(C("commit_id")), F.lit(None).cast("string")
    for (project, url), commits in DIVERSEVUL.items():
        special = F.coalesce(special, F.when((C("_project") == project) & commit.isin(commits), F.lit(url)))
    name = F.when(C("hash").rlike(r"^\s*[0-9]+\s*$"), _hex(C("hash"))).otherwise(F.nullif("hash", F.lit("")))
    df = df.withColumns({"_url": F.coalesce(special, "_listed"), "_name": name}).where("_name IS NOT NULL")
    return entries_of(df, "diversevul", ids.url_and_commit(C("_url"), C("commit_id")), C("target") == 1, cwes=C("cwe"), name=C("_name"), commit=_message(C("message")))


def _icvul(mapping, commits, functions):
    joined = mapping.where("fc_hash IS NOT NULL").join(commits.select(C("hash").alias("fc_hash"), "msg", "author_date"), "fc_hash")
    known = lambda c: F.min_by(c, F.when(C(c).isNotNull(), C("_row"))).alias(c)
    per = joined.groupBy("fc_hash").agg(known("repo_url"), known("msg"), known("author_date"), F.collect_set("cve_id").alias("cves"), F.collect_set("cwe_id").alias("cwes"))
    df = functions.join(per, functions["hash"] == per["fc_hash"])
    name = F.concat(C("name"), F.lit("-["), C("start_line").cast("string"), F.lit("-"), C("end_line").cast("string"), F.lit("]"))
    return entries_of(df, "icvul", ids.url_and_commit(C("repo_url"), C("hash")), C("before_change"), C("cves"), C("cwes"), name, C("filename"), commit=_message(C("msg"), at=F.try_to_timestamp("author_date")))


def _megavul(first, second):
    df = _both(first, second).where("func_name IS NOT NULL")
    url = F.when(F.lower("repo_name") == "ffmpeg", F.lit(GITHUB + "ffmpeg/ffmpeg")).otherwise(C("git_url"))
    return entries_of(df, "megavul", ids.url_and_commit(url, C("commit_hash")), C("is_vul"), array_of(C("cve_id")), C("cwe_ids"), C("func_name"), C("file_path"))


def _primevul(raw, moved=None):
    """``moved`` (``old_url, new_url``) holds for the candidates that stand in for a missing URL, as written and normalised."""
    given = F.when(~F.trim("project_url").isin("None", ""), C("project_url"))
    real = lambda c: F.when(~F.lower(F.trim(c)).isin("none", ""), F.trim(c))
    df = raw.withColumns({"_0": real(C("project_url")), "_1": real(C("commit_url")), "_2": _named(PRIMEVUL, C("project"))})
    for c in ("_0", "_1", "_2"):
        for _ in range(2) if moved is not None else ():
            new = moved.groupBy(C("old_url").alias(c)).agg(F.min("new_url").alias("_new"))
            df = df.join(new, c, "left").withColumn(c, https_url(F.coalesce("_new", c))).drop("_new")
        df = df if moved is not None else df.withColumn(c, https_url(C(c)))
    url = F.coalesce(given, "_0", "_1", "_2")
    return entries_of(df.withColumn("_url", url), "primevul", ids.url_and_commit(C("_url"), C("commit_id")), C("target") == 1, array_of(C("cve")), C("cwe"), C("func_hash"))


def _secvuleval(raw):
    kept = raw.where("func_name IS NOT NULL")
    return entries_of(kept, "secvuleval", ids.url_and_commit(C("project_url"), C("commit_id")), C("is_vulnerable"), C("cve_list"), C("cwe_list"), C("func_name"), C("filepath"), commit=_message(C("commit_message")))


def _sven(raw):
    return entries_of(raw, "sven", ids.url_and_commit(_secure(C("commit_link"))), cwes=array_of(F.upper("vul_type")), name=C("func_name"), file=C("file_name"))


def _plain(name, url, commit, **columns):
    return lambda raw: entries_of(raw, name, ids.url_and_commit(url, commit), **columns)


def _csv(ddl: str, **options) -> Raw:
    return Raw("csv", ddl, options)


_PATCH = "owner string, repo string, commit_id string, category string, CVE_ID string, CWE_ID string, diff_code string"
_POSITIVE, _NEGATIVE = "project string, sha string, cve_id string, cwe_id string, message string, diff string", "github string, cve_id string, cwe_id string, message string, diff string"
_MEGA = Raw("json", "git_url string, commit_hash string, repo_name string, func_name string, file_path string, is_vul boolean, cve_id string, cwe_ids array<string>")
_SPI = _csv("commit_msg string, patch string, vulnerability int")


def sources() -> list[Source]:
    """All sources; made on call, as expressions need a session."""
    cve, cwe = array_of(C("cve_id")), array_of(C("cwe_id"))
    s = lambda name, grain, parse, **inputs: Source(name, grain, inputs, parse)
    return [
        s("bigvul", "commit", _bigvul, raw=_csv("ref_link string, commit_id string, cve_id string, cwe_id string")),
        s("bigvulfixes", "commit", _bigvulfixes, raw=Raw("parquet")),
        s("cc900", "commit", _pairs("cc900", True), positive=_csv(_POSITIVE), negative=_csv(_NEGATIVE)),
        s("tqrg", "commit", _pairs("tqrg", False), positive=_csv(_POSITIVE), negative=_csv(_NEGATIVE)),
        s("commitvulfix", "commit", _commitvulfix, fixes=Raw("text"), others=Raw("text")),
        s("crossvul", "commit", _crossvul, raw=_csv("cwe_id string, cve_id string, commit_url string", sep=";", header=False)),
        s("cvefixes", "commit", _cvefixes, fixes=Raw("parquet"), classes=Raw("parquet")),
        s("devign", "commit", _devign, first=_csv("sha_id string, project string, vulnerability int"), second=_csv("sha_id string, project string, vulnerability int")),
        s("dimva2025", "commit", _dimva, first=_csv("Owner string, Repo string, Commit_ID string, CVE_ID string"), second=_csv("Owner string, Repo string, Commit_ID string, CVE_ID string")),
        s("fixseeker_balanced", "commit", _fixseeker("fixseeker_balanced"), raw=Raw("whole")),
        s("fixseeker_imbalanced", "commit", _fixseeker("fixseeker_imbalanced"), raw=Raw("whole")),
        s("javavfc", "commit", _javavfc("javavfc"), raw=Raw("jsonl", "commit_link string, diff_raw string, date bigint")),
        s("javavfc_extended", "commit", _javavfc("javavfc_extended"), raw=Raw("jsonl", "commit_link string, diff_raw string, date bigint")),
        s("morefixes", "commit", _morefixes, commits=Raw("jdbc"), fixes=Raw("jdbc"), classes=Raw("jdbc")),
        s("msr2019", "commit", _plain("msr2019", C("project_url"), C("commit_id"), cves=cve), raw=_csv("cve_id string, project_url string, commit_id string, pos string", header=False)),
        s("patchdb", "commit", _patchdb("patchdb"), raw=Raw("json", _PATCH)),
        s("patcheval", "commit", _patcheval, raw=Raw("json", "cve_id string, patch_url array<string>, cwe_info map<string, string>")),
        s("pysecdb", "commit", _pysecdb, raw=Raw("json", "content string, label string, CVE_ID string"), repos=Raw("parquet")),
        s("repospd", "commit", _patchdb("repospd"), raw=Raw("jsonl", _PATCH + ", ori_dataset string")),
        s("secbench", "commit", _plain("secbench", _repo(C("owner"), C("project")), C("sha"), cves=cve, cwes=cwe), raw=_csv("owner string, project string, sha string, cve_id string, cwe_id string")),
        s("spidb", "commit", _spidb, first=_SPI, second=_SPI, history=Raw("parquet")),
        s("tracer", "commit", _tracer, raw=_csv("cve string, github_commit string, other_platform_git_commit string")),
        s("vcmatch", "commit", _plain("vcmatch", _named(VCMATCH, C("repo")), C("commit"), cves=array_of(C("cve"))), raw=_csv("repo string, commit string, cve string")),
        s("vudenc", "commit", _vudenc, raw=Raw("whole")),
        s("cleanvul", "function", _cleanvul, raw=Raw("parquet")),
        s("cwe_bench_java", "function", _cwe_bench, info=_csv("cve_id string, cwe_id string, advisory_id string"), fixes=_csv("cve_id string, github_username string, github_repository_name string, commit string, file string, method string, signature string")),
        s("diversevul", "function", _diversevul, raw=Raw("jsonl", "commit_id string, project string, hash string, target int, cwe array<string>, message string"), projects=Raw("parquet")),
        s("icvul", "function", _icvul, mapping=_csv("fc_hash string, repo_url string, cve_id string, cwe_id string"), commits=_csv("hash string, msg string, author_date string"), functions=_csv("hash string, name string, filename string, start_line int, end_line int, before_change boolean")),
        s("megavul", "function", _megavul, first=_MEGA, second=_MEGA),
        s("primevul", "function", _primevul, raw=Raw("jsonl", "project_url string, commit_url string, project string, commit_id string, func_hash string, target int, cve string, cwe array<string>"), moved=Raw("parquet")),
        s("secvuleval", "function", _secvuleval, raw=Raw("parquet")),
        s("sven", "function", _sven, raw=Raw("jsonl", "commit_link string, func_name string, file_name string, vul_type string")),
    ]


def load(spark: SparkSession, name: str, options: dict | None = None, **paths: str | list[str]) -> DataFrame:
    """Entries of a source from the paths of its inputs, or from their tables where it is a database.

    ``options`` go to the reader: ``{"url": "jdbc:...", "user": ...}`` for a database, with ``partitionColumn`` and the like
    where its tables are large.
    """
    source = {x.name: x for x in sources()}[name]
    return source.parse(**{key: read_raw(spark, raw, paths[key], options) for key, raw in source.inputs.items() if key in paths})


def parse(spark: SparkSession, name: str, **raw: DataFrame) -> DataFrame:
    """Entries of a source from raw rows; ``_row`` is added where it is missing."""
    source = {x.name: x for x in sources()}[name]
    given = {k: df if "_row" in df.columns else df.withColumn("_row", F.monotonically_increasing_id()) for k, df in raw.items()}
    return source.parse(**{key: given[key] for key in source.inputs if key in given})
