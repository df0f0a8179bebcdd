"""Git URLs of the usual hosts: host, path, owner, repository, commit and the https form. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixloom.functions.let import let

_HEX = r"^[0-9a-fA-F]{5,40}\z"
# Web paths of the generic hosts, looked for in this order (fixed values).
_WEB = ["/commit/", "/commits/", "/tree/", "/blob/", "/src/", "/browse/"]
# Web pages of the freedesktop cgit, looked for in this order (fixed values).
_CGIT_PAGES = ["/commit", "/tree", "/log", "/diff", "/refs", "/snapshot", "/patch"]


def _after(text: Column, mark: str) -> Column:
    return F.when(F.instr(text, mark) > 0, F.substring(text, F.instr(text, mark) + len(mark), F.length(text)))


def _before(text: Column, mark: str) -> Column:
    return F.when(F.instr(text, mark) > 0, F.substring(text, 1, F.instr(text, mark) - 1)).otherwise(text)


def _none(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _bare(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/+$", ""), r"\.git$", "")


def _hash(text: Column) -> Column:
    return F.when(text.rlike(_HEX), F.lower(text))


def _described(text: Column) -> Column:
    """A hash, or the hash at the end of ``tag-N-g<hash>``."""
    return F.coalesce(_hash(text), F.lower(_none(F.regexp_extract(text, r"^.+-[gG]([0-9a-fA-F]{7,40})$", 1))))


def _param(query: Column, name: str) -> Column:
    return _none(F.regexp_extract(query, rf"(?:^|[&;]){name}=([^&;]+)", 1))


def _parse(u: Column) -> Column:
    """``struct<ssh, host, path, query>`` or NULL."""
    scp, ssh = r"^\w+@([^:]+):(.+)$", r"^ssh://\w+@([^/]+)/(.+)$"
    web = r"^(?:https?)://(?:[^/?#]*@)?([^/?#:@]+)(?::\d*)?([^?#]*)(?:\?([^#]*))?"
    shell = F.struct(F.lit(True).alias("ssh"), F.when(u.rlike(scp), F.regexp_extract(u, scp, 1)).otherwise(F.regexp_extract(u, ssh, 1)).alias("host"),
                     F.concat(F.lit("/"), F.regexp_replace(F.when(u.rlike(scp), F.regexp_extract(u, scp, 2)).otherwise(F.regexp_extract(u, ssh, 2)), r"\.git$", "")).alias("path"), F.lit("").alias("query"))
    return F.when(
        u.startswith("git@") | u.startswith("ssh://"), F.when(u.rlike(scp) | u.rlike(ssh), shell)
    ).otherwise(let(F.when(u.startswith("git://"), F.concat(F.lit("https"), F.substring(u, 4, 100_000))).otherwise(u), lambda w: F.when(
        w.rlike(web), F.struct(F.lit(False).alias("ssh"), F.regexp_replace(F.lower(F.regexp_extract(w, web, 1)), r"^www\.", "").alias("host"), F.regexp_extract(w, web, 2).alias("path"), F.regexp_extract(w, web, 3).alias("query")))))


def _part(path: Column, i: int) -> Column:
    return F.get(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(i))


def _repo_of(g: Column) -> Column:
    """``struct<owner, repo, commit_id, path>`` by the rules of the host."""
    host, path, bare, query = g["host"], g["path"], _bare(g["path"]), g["query"]
    row = lambda owner, repo, commit, at=None: F.struct(owner.alias("owner"), repo.alias("repo"), commit.alias("commit_id"), (path if at is None else at).alias("path"))
    no = F.lit(None).cast("string")
    is_web = (F.size(F.filter(F.split(bare, "/"), lambda p: p != "")) >= 4)
    github = row(F.when(_part(bare, 1).isNotNull(), _part(bare, 0)), _part(bare, 1), F.when(is_web & (_part(bare, 2) == "commit"), F.coalesce(_described(_part(bare, 3)), _part(bare, 3))))
    cut = F.regexp_replace(bare, r"(?i)(?:/-/|/tree/|/blob/|/commit/|/merge_requests/).*$", "")
    gitlab = row(_none(F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, "^/+|/+$", ""), "/+", "/"), "(?:^|/)[^/]*$", "")), _none(F.regexp_extract(cut, "([^/]+)/*$", 1)), _hash(F.regexp_extract(bare, "(?i)/-/commit/([^/]+)", 1)))
    bitbucket = row(F.when(_part(bare, 1).isNotNull(), _part(bare, 0)), _part(bare, 1), F.when(is_web & (_part(bare, 2) == "commits"), _hash(_part(bare, 3))))
    google = row(no, F.regexp_replace(_before(bare, "/+/"), "^/+", ""), _hash(F.regexp_extract(bare, r"/\+/([^/^~!]*)", 1)))
    web = F.coalesce(*(_described(F.regexp_extract(F.coalesce(_after(bare, d), F.lit("")), "^([^/]*)", 1)) for d in _WEB))
    p_repo = F.regexp_replace(_param(query, "p"), r"\.git$", "")
    cgit = _none(F.regexp_replace(F.regexp_extract(bare, "/cgit/([^/]+)", 1), r"\.git$", ""))
    generic = F.when(p_repo.isNotNull(), row(no, p_repo, _hash(_param(query, "h")))).otherwise(row(no, F.coalesce(cgit, _none(F.regexp_extract(bare, "([^/]+)/*$", 1))), web))
    sav_cgit = F.regexp_replace(_before(_after(bare, "/cgit/"), "/commit"), r"\.git$", "")
    savannah = (
        F.when(p_repo.isNotNull(), row(no, p_repo, _hash(_param(query, "h"))))
        .when(F.instr(bare, "/cgit/") > 0, row(no, _none(sav_cgit), _hash(F.regexp_extract(bare, "/commit/*([^/]+)", 1))))
        .when(F.instr(bare, "/git/") > 0, row(no, _none(F.regexp_replace(_after(bare, "/git/"), r"\.git$", "")), no))
        .otherwise(generic)
    )
    by_id = _hash(_param(query, "id"))
    kernel_path = F.when((F.instr(path, "/pub/scm/") > 0) & (F.instr(path, ".git") > 0), _before(_after(path, "/pub/scm/"), ".git")).when((F.instr(path, "/cgit/") > 0) & (F.instr(path, ".git") > 0), _before(_after(path, "/cgit/"), ".git"))
    kernel = F.when(p_repo.isNotNull(), row(no, p_repo, F.coalesce(_hash(_param(query, "h")), by_id))).otherwise(row(no, kernel_path, F.coalesce(_hash(F.regexp_extract(path, "/commit/([^/]*)", 1)), by_id)))
    stripped = F.regexp_replace(path, "/+$", "")
    fd_path = F.coalesce(*(F.when(F.instr(stripped, s) > 0, _before(stripped, s)) for s in _CGIT_PAGES), stripped)
    freedesktop = row(no, _none(F.regexp_replace(fd_path, "^/+", "")), by_id, fd_path)
    return (
        F.when(host == "github.com", github).when(F.contains(host, F.lit("gitlab")), gitlab).when(F.contains(host, F.lit("bitbucket")), bitbucket)
        .when(F.endswith(host, F.lit("googlesource.com")), google).when(F.startswith(host, F.lit("git.savannah.")), savannah)
        .when(host == "git.kernel.org", kernel).when(host == "cgit.freedesktop.org", freedesktop).otherwise(generic)
    )


def _https(g: Column, r: Column) -> Column:
    host, repo, owner = g["host"], r["repo"], r["owner"]
    base = F.concat(F.lit("https://"), host)
    bare = _bare(r["path"])
    cut = F.coalesce(*(F.when(F.instr(bare, d) > 1, _before(bare, d)) for d in _WEB), bare)
    generic = F.when(repo.isNotNull() & (repo != "") & ~F.contains(r["path"], repo), F.concat(base, F.lit("/?p="), repo, F.lit(".git"))).when((cut != "") & (cut != "/"), F.concat(base, cut))
    has = repo.isNotNull() & (repo != "")
    both = has & owner.isNotNull()
    return (
        F.when(F.startswith(host, F.lit("git.savannah.")) & has, F.concat(base, F.lit("/git/"), repo, F.lit(".git")))
        .when((host == "git.kernel.org") & has, F.concat(base, F.lit("/pub/scm/"), repo, F.lit(".git")))
        .when((host == "cgit.freedesktop.org") & has, F.concat(base, F.lit("/"), repo))
        .when((host == "github.com") & both, F.concat(base, F.lit("/"), F.lower(owner), F.lit("/"), F.lower(repo)))
        .when((F.contains(host, F.lit("gitlab")) | F.contains(host, F.lit("bitbucket"))) & both, F.concat(base, F.lit("/"), owner, F.lit("/"), repo))
        .when(F.endswith(host, F.lit("googlesource.com")) & has, F.concat(base, F.lit("/"), repo))
        .otherwise(generic)
    )


def git_url(url: Column) -> Column:
    """``struct<scheme, host, path, owner, repo, commit_id, https>``; NULL for texts that are no git URL."""
    raw = F.regexp_replace(url, r"^\s+|\s+\z", "")
    decoded = F.when(F.contains(raw, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)).otherwise(raw)

    def whole(g: Column) -> Column:
        return let(_repo_of(g), lambda r: F.when(g["host"] != "", F.struct(
            F.lit("https").alias("scheme"), g["host"].alias("host"), r["path"].alias("path"), r["owner"].alias("owner"), r["repo"].alias("repo"), r["commit_id"].alias("commit_id"), _https(g, r).alias("https"))))

    return let(let(decoded, _parse), lambda g: F.when(g.isNotNull(), whole(g)))


def https_url(url: Column) -> Column:
    """The https form of a repository's URL; NULL if there is none."""
    return git_url(url)["https"]


def path_name(url: Column) -> Column:
    """A folder name for a repository: ``gh_owner_repo``, else its owner and name with the SHA-256 of the URL."""
    named = lambda g: F.when((g["host"] == "github.com") & g["owner"].isNotNull() & g["repo"].isNotNull(), F.concat(F.lit("gh_"), F.lower(g["owner"]), F.lit("_"), F.lower(g["repo"]))).otherwise(
        F.concat(F.when(g["owner"].isNotNull() & g["repo"].isNotNull(), F.concat(g["owner"], F.lit("_"), g["repo"], F.lit("_"))).otherwise(""), F.sha2(url, 256)))
    return let(git_url(url), named)


def github_api_url(url: Column, tail: str = "", base: str = "https://api.github.com") -> Column:
    """The REST address of a GitHub repository; NULL for other hosts."""
    return let(git_url(url), lambda g: F.when((g["host"] == "github.com") & g["owner"].isNotNull() & g["repo"].isNotNull(), F.concat(F.lit(f"{base}/repos/"), g["owner"], F.lit("/"), g["repo"], F.lit(tail))))
