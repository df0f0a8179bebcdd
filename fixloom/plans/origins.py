"""Every source read from raw rows of its own form, made out of the entries, and the same in SQL.

The raw rows carry what entries hold: projects and commits freed of the way of writing, ids as dirty as they are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixloom.functions.identity import commit_key, repo_key
from fixloom.plans.curation import URL_KEY
from fixloom.plans.tables import table
from fixloom.sources.registry import DEVIGN, VCMATCH, parse

_GITHUB = "https://github.com/"
_SHOW = "concat('commit x\nAuthor: A <a@b>\nDate:   Mon Jan 6 10:00:00 2020 +0000\n\n    fix ', {n}, '\n\ndiff --git a/f', {n}, '.c b/f', {n}, '.c\n')"


def base(spark, d) -> DataFrame:
    """``_row``, project and commit of each entry that has both, in the shapes sources use."""
    key = repo_key(F.col("project_url"))
    rows = table(spark, d, "entries").select(
        F.col("entry_id").alias("_row"), key.alias("url"), commit_key(F.col("commit_id")).alias("sha"), F.split_part(key, F.lit("/"), F.lit(4)).alias("owner"), F.split_part(key, F.lit("/"), F.lit(5)).alias("repo"),
        F.coalesce("is_vfc", F.lit(False)).alias("vfc"), F.get("cve_ids", F.lit(0)).alias("cve"), F.get("cwe_ids", F.lit(0)).alias("cwe"), F.col("commit.message").alias("msg"), F.col("commit.diff").alias("diff"),
        F.col("function_name").alias("fn"), F.col("function_file").alias("file"), F.col("ghsa_id").alias("ghsa"), F.col("entry_id").cast("string").alias("n"),
    ).where("url IS NOT NULL AND sha IS NOT NULL AND owner <> '' AND repo <> ''")
    return rows.withColumns({"gh": F.concat(F.lit(_GITHUB), "owner", F.lit("/"), "repo"), "link": F.concat(F.lit(_GITHUB), "owner", F.lit("/"), "repo", F.lit("/commit/"), "sha")})


def _sel(b: DataFrame, **columns: str) -> DataFrame:
    return b.select("_row", *(F.expr(e).alias(c) for c, e in columns.items()))


def _flat(df: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.col(c), "|")
    c = F.col("commit")
    return df.select(
        "project_url", "commit_id", "is_vfc", joined("cve_ids").alias("cves"), joined("cwe_ids").alias("cwes"), "function_name", "function_file", "ghsa_id",
        F.md5(c["message"]).alias("message_md5"), F.md5(c["diff"]).alias("diff_md5"), F.array_join(c["files_changed"], "|").alias("files"), F.unix_micros(c["authored_at"]).alias("authored_us"), F.unix_micros(c["committed_at"]).alias("committed_us"),
    )


_HALF = "_row % 2 = 0"
_MAP = "named_struct('html_url', link, 'sha', sha)"


def _whole(b: DataFrame) -> DataFrame:
    """Texts of fifty JSON documents with the links of fixes and of others, with a comma too many, as the source has them."""
    lists = b.groupBy((F.col("_row") % 50).alias("_row")).agg(F.collect_list(F.when(F.col("vfc"), F.col("link"))).alias("vul"), F.collect_list(F.when(~F.col("vfc"), F.col("link"))).alias("nonvul"))
    return lists.select("_row", F.regexp_replace(F.to_json(F.struct("vul", "nonvul")), r"\]", ",]").alias("value"))


RAW = {
    "bigvul": lambda b: {"raw": _sel(b, ref_link="link", commit_id="sha", cve_id="cve", cwe_id="cwe")},
    "bigvulfixes": lambda b: {"raw": _sel(b, repo_url="concat(owner, '/', repo)", commit_id="sha", label="CAST(vfc AS INT)", vuln_id="cve", patch="diff", patch_date_dt="'2020-01-02 03:04:05'")},
    "cc900": lambda b: {"positive": _sel(b.where("vfc"), project="gh", sha="sha", cve_id="cve", cwe_id="cwe", message="msg", diff="diff"), "negative": _sel(b.where("NOT vfc"), github="link", cve_id="cve", cwe_id="cwe", message="msg", diff="diff")},
    "tqrg": lambda b: {"positive": _sel(b.where("vfc"), project="gh", sha="sha", cve_id="cve", cwe_id="cwe", message="msg", diff="diff"), "negative": _sel(b.where("NOT vfc"), github="link", cve_id="cve", cwe_id="cwe", message="msg", diff="diff")},
    "commitvulfix": lambda b: {"fixes": _sel(b.where("vfc"), value="link"), "others": _sel(b.where("NOT vfc"), value="link")},
    "crossvul": lambda b: {"raw": _sel(b, cwe_id="cwe", cve_id="cve", commit_url="link")},
    "cvefixes": lambda b: {"fixes": _sel(b, cve_id="cve", hash="sha", repo_url="url"), "classes": _sel(b, cve_id="cve", cwe_id="cwe").groupBy("cve_id", "cwe_id").agg(F.min("_row").alias("_row"))},
    "devign": lambda b: {"first": _sel(b.where(_HALF), sha_id="sha", project="IF(vfc, 'FFmpeg', 'qemu')", vulnerability="CAST(vfc AS INT)"), "second": _sel(b.where(f"NOT {_HALF}"), sha_id="sha", project="IF(vfc, 'qemu', 'other')", vulnerability="CAST(vfc AS INT)")},
    "dimva2025": lambda b: {"first": _sel(b.where(_HALF), Owner="owner", Repo="repo", Commit_ID="sha", CVE_ID="cve"), "second": _sel(b.where(f"NOT {_HALF}"), Owner="IF(vfc, owner, NULL)", Repo="repo", Commit_ID="sha", CVE_ID="cve")},
    "fixseeker_balanced": lambda b: {"raw": _whole(b)},
    "fixseeker_imbalanced": lambda b: {"raw": _whole(b)},
    "javavfc": lambda b: {"raw": _sel(b, commit_link="link", diff_raw=_SHOW.format(n="n"), date="_row")},
    "javavfc_extended": lambda b: {"raw": _sel(b, commit_link="link", diff_raw=_SHOW.format(n="n"), date="_row")},
    "morefixes": lambda b: {"commits": _sel(b.where("_row % 5 > 0"), hash="sha"), "fixes": _sel(b, cve_id="cve", hash="sha", repo_url="gh", score="CAST(_row % 100 AS INT)"), "classes": _sel(b, cve_id="cve", cwe_id="cwe").groupBy("cve_id").agg(F.min("cwe_id").alias("cwe_id"), F.min("_row").alias("_row"))},
    "msr2019": lambda b: {"raw": _sel(b, cve_id="cve", project_url="url", commit_id="sha", pos="'pos'")},
    "patchdb": lambda b: {"raw": _sel(b, owner="owner", repo="repo", commit_id="concat(sha, ' tail')", category="IF(vfc, NULL, 'non-security')", CVE_ID="cve", CWE_ID="cwe", diff_code="diff")},
    "patcheval": lambda b: {"raw": _sel(b, cve_id="cve", patch_url="array(link, 'https://github.com/no/commit')", cwe_info="map('cwe-079', 'x')")},
    "pysecdb": lambda b: {"raw": _sel(b, content="concat('From ', sha, ' Mon Sep 17 00:00:00 2001\nFrom: A <a@b>\nSubject: [PATCH] fix ', sha, '\n\nx')", label="IF(vfc, 'security', 'other')", CVE_ID="cve"), "repos": _sel(b, sha="sha", url="gh", message="concat('Fix  ', sha, '\n\nmore')", fork="NOT vfc")},
    "repospd": lambda b: {"raw": _sel(b, owner="owner", repo="repo", commit_id="sha", category="CASE WHEN vfc THEN 'security' WHEN _row % 3 = 0 THEN NULL ELSE 'non-security' END", CVE_ID="cve", CWE_ID="cwe", diff_code="diff", ori_dataset="IF(_row % 7 = 0, 'qemu', 'x')")},
    "secbench": lambda b: {"raw": _sel(b, owner="owner", project="repo", sha="sha", cve_id="cve", cwe_id="cwe")},
    "spidb": lambda b: {"first": _sel(b.where(_HALF), commit_msg="concat('fix ', n)", patch="diff", vulnerability="CAST(vfc AS INT)"), "second": _sel(b.where(f"NOT {_HALF}"), commit_msg="concat('fix', n)", patch="diff", vulnerability="CAST(vfc AS INT)"), "history": _sel(b, project_url="gh", commit_id="sha", pos="_row", diff="diff", message="concat('fix\n', n)")},
    "tracer": lambda b: {"raw": _sel(b, cve="cve", github_commit="IF(vfc, link, NULL)", other_platform_git_commit="IF(vfc, NULL, link)")},
    "vcmatch": lambda b: {"raw": _sel(b, repo="IF(vfc, 'openssl', IF(_row % 3 = 0, 'unknown', 'linux'))", commit="sha", cve="cve")},
    "vudenc": lambda b: {"raw": b.groupBy("gh", "sha").agg(F.min("link").alias("link")).groupBy("gh").agg(F.map_from_entries(F.collect_list(F.struct("sha", F.expr(_MAP)))).alias("m")).select(F.lit(0).cast("long").alias("_row"), F.to_json(F.create_map("gh", "m")).alias("value"))},
    "cleanvul": lambda b: {"raw": _sel(b, vulnerability_score="_row % 5", func_after="IF(_row % 11 = 0, '', coalesce(fn, 'f'))", commit_url="link", cve_id="cve", cwe_id="cwe", file_name="file", commit_msg="msg")},
    "cwe_bench_java": lambda b: {"info": _sel(b.where("cve IS NOT NULL"), cve_id="cve", cwe_id="cwe", advisory_id="ghsa").groupBy("cve_id").agg(F.min("cwe_id").alias("cwe_id"), F.max("advisory_id").alias("advisory_id"), F.min("_row").alias("_row")), "fixes": _sel(b, cve_id="cve", github_username="owner", github_repository_name="repo", commit="sha", file="file", method="fn", signature="IF(vfc, concat('s', fn), NULL)")},
    "diversevul": lambda b: {"raw": _sel(b, commit_id="sha", project="upper(repo)", hash="n", target="CAST(vfc AS INT)", cwe="array(cwe)", message="msg"), "projects": b.groupBy(F.col("repo").alias("project")).agg(F.min("_row").alias("_row"), F.min_by("gh", "_row").alias("url"))},
    "icvul": lambda b: {"mapping": _sel(b, fc_hash="sha", repo_url="gh", cve_id="cve", cwe_id="cwe"), "commits": _sel(b, hash="sha", msg="concat('m', sha)", author_date="'2020-01-02 03:04:05'").groupBy("hash", "msg", "author_date").agg(F.min("_row").alias("_row")), "functions": _sel(b, hash="sha", name="coalesce(fn, 'f')", filename="file", start_line="CAST(_row AS INT)", end_line="CAST(_row + 5 AS INT)", before_change="vfc")},
    "megavul": lambda b: {"first": _sel(b.where(_HALF), git_url="url", commit_hash="sha", repo_name="IF(vfc, 'FFmpeg', repo)", func_name="fn", file_path="file", is_vul="vfc", cve_id="cve", cwe_ids="array(cwe)"), "second": _sel(b.where(f"NOT {_HALF}"), git_url="url", commit_hash="sha", repo_name="repo", func_name="fn", file_path="file", is_vul="vfc", cve_id="cve", cwe_ids="array(cwe)")},
    "primevul": lambda b: {"raw": _sel(b, project_url="IF(vfc, gh, 'None')", commit_url="IF(_row % 3 = 0, 'None', link)", project="'binaryen'", commit_id="sha", func_hash="n", target="CAST(vfc AS INT)", cve="cve", cwe="array(cwe)")},
    "secvuleval": lambda b: {"raw": _sel(b, project_url="url", commit_id="sha", is_vulnerable="vfc", cve_list="array(cve)", cwe_list="array(cwe)", func_name="fn", filepath="file", commit_message="msg")},
    "sven": lambda b: {"raw": _sel(b, commit_link="substring(link, 9, 1000)", func_name="fn", file_name="file", vul_type="lower(cwe)")},
}


def _query(name: str):
    return lambda spark, d: _flat(parse(spark, name, **RAW[name](base(spark, d))))


QUERIES = {f"src_{name}": _query(name) for name in RAW}

# --- the same in SQL -------------------------------------------------------------------------------------------------

_ID = r"nullif(regexp_extract(lower(commit_id), '(?:^|/)[^0-9a-z/]*([0-9a-f]{7,40})(?:\.(?:patch|diff))?[^0-9a-z?#]*(?:[?#].*)?$', 1), '')"
_BASE = f"""k AS (SELECT *, {URL_KEY} AS url, {_ID} AS sha FROM entries e),
b AS (SELECT entry_id AS _row, url, sha, split_part(url, '/', 4) AS owner, split_part(url, '/', 5) AS repo, concat('https://github.com/', split_part(url, '/', 4), '/', split_part(url, '/', 5)) AS gh, coalesce(is_vfc, false) AS vfc, cve_ids[1] AS cve, cwe_ids[1] AS cwe,
 k.commit.message AS msg, k.commit.diff AS diff, function_name AS fn, function_file AS file, ghsa_id AS ghsa, CAST(entry_id AS VARCHAR) AS n FROM k WHERE url IS NOT NULL AND sha IS NOT NULL AND split_part(url, '/', 4) <> '' AND split_part(url, '/', 5) <> '')"""


def _cves(c: str) -> str:
    return f"CASE WHEN regexp_full_match(upper(trim({c})), 'CVE-[0-9]{{4}}-[0-9]{{4,}}') THEN upper(trim({c})) ELSE '' END"


def _cwes(c: str) -> str:
    digits = f"regexp_extract(trim({c}), '^(?i:CWE-)?([0-9]{{1,4}})$', 1)"
    return f"CASE WHEN {digits} <> '' THEN concat('CWE-', CAST(CAST({digits} AS INT) AS VARCHAR)) ELSE '' END"


_FILES = r"""coalesce(array_to_string(list_sort(list_distinct([substring(p, 3) FOR p IN regexp_extract_all({d}, '(?m)^diff --git ("?a/.*?"?) ("?b/.*?"?)\r?$', 2)])), '|'), '')"""
_NULL, _TEXT = "CAST(NULL AS VARCHAR)", "''"
_AT = "epoch_us(TIMESTAMP '2020-01-02 03:04:05')"
_REAL = "CASE WHEN trim(diff) <> '' THEN diff END"


def _sql(url="gh", sha="sha", vfc="true", cves=None, cwes=None, name=_NULL, file=_NULL, ghsa=_NULL, msg=_NULL, diff=_NULL, files=_TEXT, authored="CAST(NULL AS BIGINT)", committed="CAST(NULL AS BIGINT)", source="b", where="true", with_=""):
    """A row of ``source`` for each entry; ``cves`` and ``cwes`` are SQL of joined texts."""
    blank = lambda t: t or _TEXT
    return (
        f"WITH {_BASE}{with_} SELECT {url} AS project_url, {sha} AS commit_id, {vfc} AS is_vfc, coalesce({blank(cves)}, '') AS cves, coalesce({blank(cwes)}, '') AS cwes, {name} AS function_name, {file} AS function_file, {ghsa} AS ghsa_id, "
        f"md5({msg}) AS message_md5, md5({diff}) AS diff_md5, {files} AS files, {authored} AS authored_us, {committed} AS committed_us FROM {source} WHERE {where}"
    )


_CVE, _CWE, _OF_DIFF = _cves("cve"), _cwes("cwe"), _FILES.format(d="diff")
_JAVA = _sql(msg="concat('fix ', n)", diff="concat('diff --git a/f', n, '.c b/f', n, '.c', chr(10))", files="concat('f', n, '.c')", authored="epoch_us(TIMESTAMP '2020-01-06 10:00:00')", committed="_row * 1000000")
_DEVIGN = "CASE WHEN _row % 2 = 0 THEN CASE WHEN vfc THEN 'ffmpeg' ELSE 'qemu' END WHEN vfc THEN 'qemu' END"

SQL = {
    "src_bigvul": _sql(cves=_CVE, cwes=_CWE),
    "src_bigvulfixes": _sql(vfc="vfc", cves=_CVE, diff="diff", authored=_AT),
    "src_cc900": _sql(vfc="vfc", cves=_CVE, cwes=_CWE, msg="msg", diff=_REAL, files=_OF_DIFF),
    "src_tqrg": _sql(vfc="vfc", cves=_CVE, cwes=_CWE),
    "src_commitvulfix": _sql(vfc="vfc"),
    "src_crossvul": _sql(cves=_CVE, cwes=_CWE),
    "src_cvefixes": _sql(url="b.url", cves=_cves("b.cve"), cwes=_cwes("c.cwe"), source="b JOIN (SELECT DISTINCT cve, cwe FROM b) c ON b.cve = c.cve"),
    "src_devign": _sql(url="CASE p WHEN 'ffmpeg' THEN '" + DEVIGN["ffmpeg"] + "' ELSE '" + DEVIGN["qemu"] + "' END", vfc="vfc", source=f"(SELECT *, {_DEVIGN} AS p FROM b)", where="p IS NOT NULL"),
    "src_dimva2025": _sql(cves=_CVE, where="_row % 2 = 0 OR vfc"),
    "src_fixseeker_balanced": _sql(vfc="vfc"),
    "src_fixseeker_imbalanced": _sql(vfc="vfc"),
    "src_javavfc": _JAVA,
    "src_javavfc_extended": _JAVA,
    "src_morefixes": _sql(cves=_CVE, cwes=_cwes("w"), source="(SELECT b.*, c.w, row_number() OVER (PARTITION BY sha ORDER BY _row) AS rn FROM b LEFT JOIN (SELECT cve, min(cwe) AS w FROM b GROUP BY 1) c ON b.cve = c.cve WHERE _row % 100 >= 65 AND sha IN (SELECT sha FROM b WHERE _row % 5 > 0))", where="rn = 1"),
    "src_msr2019": _sql(url="url", cves=_CVE),
    "src_patchdb": _sql(vfc="vfc", cves=_CVE, cwes=_CWE, diff=_REAL, files=_OF_DIFF),
    "src_patcheval": _sql(cves=_CVE, cwes="'CWE-79'"),
    "src_pysecdb": _sql(url="hit", sha="s", vfc="v", cves=_cves("c"), source="m JOIN h ON s = hs",
        with_=", m AS (SELECT sha AS s, arg_min(vfc, _row) AS v, arg_min(cve, _row) FILTER (cve IS NOT NULL) AS c FROM b GROUP BY 1), h AS (SELECT s AS hs, arg_min(gh, struct_pack(f := NOT vfc, r := _row)) AS hit FROM m JOIN b ON s[1:5] = sha[1:5] AND starts_with(sha, s) GROUP BY 1)"),
    "src_repospd": _sql(url="CASE WHEN _row % 7 = 0 THEN '" + DEVIGN["qemu"] + "' ELSE gh END", vfc="vfc", cves=_CVE, cwes=_CWE, diff=_REAL, files=_OF_DIFF, where="vfc OR _row % 3 > 0"),
    "src_secbench": _sql(cves=_CVE, cwes=_CWE),
    "src_spidb": _sql(vfc="vfc"),
    "src_tracer": _sql(cves=_CVE),
    "src_vcmatch": _sql(url="CASE WHEN vfc THEN '" + VCMATCH["openssl"] + "' ELSE '" + VCMATCH["linux"] + "' END", cves=_CVE, where="vfc OR _row % 3 > 0"),
    "src_vudenc": _sql(source="(SELECT DISTINCT gh, sha FROM b)"),
    "src_cleanvul": _sql(cves=_CVE, cwes=_CWE, name="md5(coalesce(fn, 'f'))", file="file", msg="msg", where="_row % 5 >= 3 AND _row % 11 > 0 AND coalesce(fn, 'f') <> ''"),
    "src_cwe_bench_java": _sql(cves=_cves("b.cve"), cwes=_cwes("i.w"), name="coalesce(CASE WHEN vfc THEN concat_ws('', 's', nullif(fn, fn)) || fn END, fn)", file="file", ghsa="CASE WHEN starts_with(i.g, 'GHSA-') THEN i.g END", source="b LEFT JOIN (SELECT cve, min(cwe) AS w, max(ghsa) AS g FROM b WHERE cve IS NOT NULL GROUP BY 1) i ON b.cve = i.cve"),
    "src_diversevul": _sql(url="u", vfc="vfc", cwes=_CWE, name="lower(to_hex(_row))", msg="msg", source="b JOIN (SELECT repo AS r, arg_min(gh, _row) AS u FROM b GROUP BY 1) p ON repo = r"),
    "src_icvul": _sql(url="p.u", vfc="vfc", cves="p.v", cwes="p.w", name="concat(coalesce(fn, 'f'), '-[', _row, '-', _row + 5, ']')", file="file", msg="concat('m', b.sha)", authored=_AT, source="b JOIN p ON b.sha = p.s",
        with_=f", p AS (SELECT sha AS s, arg_min(gh, _row) AS u, array_to_string(list_sort(list_distinct([x FOR x IN list({_CVE}) IF x <> ''])), '|') AS v, array_to_string(list_sort(list_distinct([x FOR x IN list({_CWE}) IF x <> ''])), '|') AS w FROM b GROUP BY 1)"),
    "src_megavul": _sql(url="CASE WHEN vfc AND _row % 2 = 0 THEN 'https://github.com/ffmpeg/ffmpeg' ELSE url END", vfc="vfc", cves=_CVE, cwes=_CWE, name="fn", file="file", where="fn IS NOT NULL"),
    "src_primevul": _sql(url="CASE WHEN vfc OR _row % 3 > 0 THEN gh ELSE 'https://github.com/webassembly/binaryen' END", vfc="vfc", cves=_CVE, cwes=_CWE, name="n"),
    "src_secvuleval": _sql(url="url", vfc="vfc", cves=_CVE, cwes=_CWE, name="fn", file="file", msg="msg", where="fn IS NOT NULL"),
    "src_sven": _sql(cwes=_CWE, name="fn", file="file"),
}
