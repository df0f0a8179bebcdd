"""Keys of repositories and commits, freed of the way they are written. Pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segments after which a web path leaves the repository and enters one of its pages (fixed values).
_PAGES = "tree|blob|commit|commits|raw|src|browse|log|diff|compare|releases|tags|issues|pull|pulls|merge_requests|wiki|archive"

_REPO = (
    r"^(?:[a-z][a-z0-9+.-]*:/+)?(?:[^@/?#]*@)?(?:www\.)?([^:/?#@\s]+\.[^:/?#@\s]+)(?::\d+(?=/))?[:/]+"
    rf"([^/?#\s]+/[^/?#\s]+?(?:/[^/?#\s]+?)*?|[^/?#\s]+?)(?:\.git)?/*"
    rf"(?:/-(?:/[^?#]*)?|/(?:{_PAGES})(?:/[^?#]*)?)?(?:\?[^#]*)?(?:#.*)?$"
)
# Most URLs are written plainly; these take one cheap match.
_PLAIN = r"^https://(?!www\.)[a-z0-9.-]++/[a-z0-9_-]++/[a-z0-9_-]++$"
_KEY = r"^https://[^/?#\s]++/[^?#\s]++$"
_EDGE = r"^[\s <(\[\"']+|[\s >)\]\"',;]+$"
_COMMIT = r"(?:^|/)[^0-9a-z/]*([0-9a-f]{7,40})(?:\.(?:patch|diff))?[^0-9a-z?#]*(?:[?#].*)?$"


def repo_key(url: Column) -> Column:
    """``https://host/path`` in lower case: host without ``www.``, user, port; bare repository path.

    Scheme, scp form, escapes, ``.git``, trailing slashes, query, fragment and the pages of a web view are ignored.
    NULL for NULL, blank text, text that names no host and path, and one whose part before query and fragment exceeds
    2,048 characters, which no server takes for a path.
    """
    # What follows the path is cut off first, so that a URL is matched however long its query or fragment is.
    path = F.split_part(F.split_part(F.regexp_replace(url, _EDGE, ""), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    u = F.lower(F.regexp_replace(F.when(F.length(path) <= 2048, path), _EDGE, ""))
    u = F.when(u.contains("%"), F.lower(F.coalesce(F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%2B"))), u))).otherwise(u)
    key = F.regexp_replace(u, _REPO, r"https://$1/$2")
    return F.when(url.rlike(_PLAIN), url).otherwise(F.when(key.rlike(_KEY), key))


def commit_key(commit: Column) -> Column:
    """The 7 to 40 hex digits of a commit id in lower case, out of a bare id or a commit URL; else NULL.

    White space and punctuation around it, ``.patch``/``.diff``, query and fragment are ignored.
    """
    return F.nullif(F.regexp_extract(F.lower(commit), _COMMIT, 1), F.lit(""))
