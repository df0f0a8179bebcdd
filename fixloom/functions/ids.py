"""Identifiers of commits, vulnerabilities and weaknesses. Column expressions; ASCII digits only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixloom.functions.giturl import git_url
from fixloom.functions.let import let

CVE, CWE = r"^CVE-[0-9]{4}-[0-9]{4,}\z", r"^CWE-[0-9]+\z"
# Irregular references and the commits they were resolved to: project, reference, commit (fixed values).
PINNED = [
    ("https://github.com/curl/curl", "curl-7_51_0-162-g3ab3c16", "3ab3c16db6a5674f53cf23d5654366663f734493"),
    ("https://github.com/curl/curl", "curl-7_50_2~32", "7700fcba64bf5806de28f6c1c7da3b4f0b38567d"),
    ("https://github.com/imagemagick/imagemagick", "7.0.2-1", "01588fbdd5469847e919b472e8bfbd69bef0d652"),
    ("https://github.com/imagemagick/imagemagick", "7.0.1-5", "580b68fc398b9bf7ec1a025524f294ce76fcf521"),
    ("https://github.com/dom4j/dom4j", "version-2.0.3", "177069f0e96a40ddab5ab7f41519ec29e5a39652"),
]


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def commit_id(text: Column, urls: bool = True) -> Column:
    """A commit id out of an id or a commit URL: 5 to 40 hex digits in lower case, or what the URL names; else NULL.

    Fragment, then query, then one ``.patch`` or ``.diff``, then trailing ``.,;`` are cut off. Without ``urls``, for a
    text that is no URL, the plan is much smaller.
    """
    core = strip(F.split_part(F.split_part(text, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)))
    core = F.regexp_replace(F.regexp_replace(core, r"\.(?:patch|diff)$", ""), r"[.,;]+$", "")
    return let(core, lambda c: F.when(c == "", F.lit(None)).when(c.rlike("^[0-9a-fA-F]{5,40}\\z"), F.lower(c)).otherwise(git_url(c)["commit_id"] if urls else F.lit(None)))


def pinned(project: Column, ref: Column) -> Column:
    """The commit that an irregular reference of a project is pinned to."""
    table = F.create_map(*(F.lit(x) for url, r, sha in PINNED for x in (f"{url} {r}", sha)))
    return table[F.concat(project, F.lit(" "), strip(ref))]


def pinned_in(text: Column) -> Column:
    """``struct<project_url, commit_id>`` of the first pinned reference that occurs in a text."""
    found = None
    for url, ref, sha in PINNED:
        pair = F.struct(F.lit(url).alias("project_url"), F.lit(sha).alias("commit_id"))
        found = F.when(F.contains(text, F.lit(ref)), pair) if found is None else found.when(F.contains(text, F.lit(ref)), pair)
    return found


def url_and_commit(url: Column, commit: Column | None = None) -> Column:
    """``struct<project_url, commit_id>``: the commit from its own column, else from the URL, pinned ones included."""
    def pick(g: Column) -> Column:
        own = F.lit(None).cast("string") if commit is None else F.coalesce(commit_id(commit), pinned(g["https"], commit))
        return F.struct(g["https"].alias("project_url"), F.coalesce(own, commit_id(g["commit_id"], urls=False), pinned(g["https"], g["commit_id"])).alias("commit_id"))

    return let(git_url(url), pick)


def cve_set(values: Column) -> Column:
    """Vulnerability ids of an array in upper case, sorted and distinct; anything malformed is left out."""
    clean = F.filter(F.transform(values, lambda v: F.upper(strip(v))), lambda v: v.rlike(CVE))
    return F.coalesce(F.array_sort(F.array_distinct(clean)), F.array().cast("array<string>"))


def cwe_set(values: Column) -> Column:
    """Weakness ids of an array as ``CWE-n`` without leading zeros, sorted and distinct; anything else is left out."""
    digits = F.transform(values, lambda v: F.regexp_extract(strip(v), r"^(?i:CWE-)?([0-9]{1,4})\z", 1))
    clean = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.concat(F.lit("CWE-"), d.cast("int").cast("string")))
    return F.coalesce(F.array_sort(F.array_distinct(clean)), F.array().cast("array<string>"))


def valid_cves(values: Column) -> Column:
    return F.filter(values, lambda v: v.rlike(CVE))


def valid_cwes(values: Column) -> Column:
    return F.filter(values, lambda v: v.rlike(CWE))


def link_key(a: Column, b: Column) -> Column:
    """An unordered pair."""
    return F.struct(F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def display_name(url: Column) -> Column:
    """The last two segments of a URL."""
    return F.substring_index(url, "/", -2)
