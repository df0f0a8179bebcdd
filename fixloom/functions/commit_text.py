"""Diffs, ``git show`` texts, timestamps of commits, and signatures of what a commit changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixloom.functions.let import let
from fixloom.functions.paths import is_template

_HEADER = r'(?m)^diff --git ("?a/.*?"?) ("?b/.*?"?)\r?$'
_EMPTY = "array<string>"


def _plain(path: Column) -> Column:
    return F.substring(F.regexp_replace(path, '^"|"$', ""), 3, 1_000_000)


def files_of_diff(diff: Column) -> Column:
    """Sorted distinct files of a unified diff: the new side of each header, the old one of a deletion."""
    old, new = (F.regexp_extract_all(diff, F.lit(_HEADER), F.lit(i)) for i in (1, 2))
    each = F.zip_with(old, new, lambda a, b: F.when(F.regexp_replace(b, '"', "").endswith("/dev/null"), _plain(a)).otherwise(_plain(b)))
    return F.coalesce(F.array_sort(F.array_distinct(each)), F.array().cast(_EMPTY))


def commit_struct(message: Column, diff: Column, files: Column, authored: Column, committed: Column) -> Column:
    return F.struct(message.alias("message"), diff.alias("diff"), F.coalesce(files, F.array().cast(_EMPTY)).alias("files_changed"), authored.alias("authored_at"), committed.alias("committed_at"))


def commit_of_diff(diff: Column) -> Column:
    """A commit of which only the diff is known; blank diffs count as none."""
    none, time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    real = F.when(F.trim(diff) != "", diff)
    return commit_struct(none, real, F.when(real.isNotNull(), files_of_diff(real)), time, time)


def commit_of_show(text: Column) -> Column:
    """A commit out of the text of ``git show``: message without its indent, diff, files, author date."""
    at = F.regexp_instr(text, F.lit(r"(?m)^diff --git "))
    head = F.when(at > 0, F.substring(text, 1, at - 1)).otherwise(text)
    diff = F.when(at > 0, F.substring(text, at, F.length(text)))
    body = F.regexp_replace(F.regexp_replace(head, r"\r", ""), r"(?s)^.*?\n[ \t]*\n", "")
    message = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"(?m)^ {4}", ""), r"^\n+", ""), r"[\n\s]+$", "")
    date = F.regexp_extract(head, r"(?m)^(?:Author)?Date:\s+(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+)?(.+?)\s*$", 1)
    when = F.coalesce(F.try_to_timestamp(date, F.lit("MMM d HH:mm:ss yyyy Z")), F.try_to_timestamp(date))
    return commit_struct(F.nullif(message, F.lit("")), diff, files_of_diff(diff), when, F.lit(None).cast("timestamp"))


def commit_of_api(response: Column) -> Column:
    """A commit out of a hosting service's answer: patches joined, file names, both dates."""
    patches = F.filter(F.transform(response["files"], lambda f: f["patch"]), lambda p: p.isNotNull() & (p != ""))
    when = lambda who: F.try_to_timestamp(response["commit"][who]["date"])
    names = F.array_sort(F.array_distinct(F.filter(F.transform(response["files"], lambda f: f["filename"]), lambda n: n.isNotNull())))
    return commit_struct(response["commit"]["message"], F.nullif(F.array_join(patches, "\n"), F.lit("")), names, when("author"), when("committer"))


def merge_commits(left: Column, right: Column) -> Column:
    """Field by field: the left value if there is one, else the right; files if there are any."""
    pick = lambda f: F.coalesce(left[f], right[f])
    files = F.when(F.size(left["files_changed"]) > 0, left["files_changed"]).otherwise(right["files_changed"])
    return commit_struct(pick("message"), pick("diff"), files, pick("authored_at"), pick("committed_at"))


def is_complete(commit: Column) -> Column:
    has = [commit[f].isNotNull() for f in ("message", "diff", "authored_at", "committed_at")]
    return F.coalesce(has[0] & has[1] & has[2] & has[3] & (F.size(commit["files_changed"]) > 0), F.lit(False))


def iso(at: Column) -> Column:
    """ISO 8601 in UTC with ``Z``; microseconds only where there are any (session zone UTC)."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.pmod(F.unix_micros(at), F.lit(1_000_000)) != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("Z"))


def comparable_diff(diff: Column) -> Column:
    """A diff without its index lines and trailing line ends, with Unix line ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(diff, "\r\n?", "\n"), r"(?m)^index [^\n]*\n?", ""), r"\n+$", "")


def signature(message: Column, author: Column, email: Column, epoch: Column, files: Column) -> Column:
    """``struct<content_hash, files_hash>`` of a substantial commit (2 to 20 files, 2 of them no templates), else NULL."""
    def hashes(real: Column) -> Column:
        content = F.sha2(F.concat(message, F.lit("\n"), F.concat_ws("|", author, email, epoch.cast("string"))), 256)
        return F.when((F.size(files) >= 2) & (F.size(files) <= 20) & (F.size(real) >= 2), F.struct(content.alias("content_hash"), F.sha2(F.array_join(real, "\n"), 256).alias("files_hash")))

    return let(F.array_sort(F.filter(files, lambda f: ~is_template(f))), hashes)
