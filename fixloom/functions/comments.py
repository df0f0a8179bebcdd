"""Source code without comments: a small lexer in a vectorised function, as no relational form exists."""

from __future__ import annotations

import hashlib
import re
from difflib import unified_diff

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTED = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_SLASHES = r"//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)"
_RAW = r'R"(?P<mark>[^()\\\s"]{0,16})\(.*?\)(?P=mark)"'
# After one of these signs a slash begins a regular expression, not a division.
_REGEX = r"[(,=:\[!&|?{};+~^<>]\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"


def _lexer(keep: str, drop: str) -> re.Pattern:
    return re.compile(rf"(?P<keep>{keep})|(?P<drop>{drop})", re.DOTALL)


_C = _lexer(f"{_RAW}|{_QUOTED}", _SLASHES)
FAMILIES = {
    "python": _lexer(r'"""(?:\\.|(?!""").)*"""|' + r"'''(?:\\.|(?!''').)*'''|" + _QUOTED, r"\#[^\n]*"),
    "java": _lexer(r'"""(?:\\.|(?!""").)*"""|' + _QUOTED, _SLASHES),
    "javascript": _lexer(rf"{_QUOTED}|`(?:\\.|[^`\\])*`|{_REGEX}", _SLASHES),
    "c": _C, "cpp": _C,
}
_BLANK = re.compile(r"[ \t]*(?:\r?\n|\Z)")


def strip_comments(code: str | None, language: str | None) -> str | None:
    """The code without comments; a line that held only comments goes whole, else the blanks before one go with it.

    NULL for languages other than C, C++, Java, JavaScript and Python; NULL and empty code stay. Quotes, raw strings, text
    blocks, templates and regular expressions are kept. Linear in the length of the code.
    """
    if not code:
        return code
    lexer = FAMILIES.get(language or "")
    if lexer is None:
        return None
    out: list[str] = []
    line, at = "", 0  # what the current line holds so far
    for m in lexer.finditer(code):
        if m.group("drop") is None:
            continue
        before = code[at : m.start()]
        line = before.rpartition("\n")[2] if "\n" in before else line + before
        tail = _BLANK.match(code, m.end())
        if not line.strip() and tail:
            kept, at = before[: len(before) - len(before.rpartition("\n")[2])], tail.end()
            line = ""
        else:
            kept, at = before.rstrip(" \t"), m.end()
            line = line.rstrip(" \t")
        out.append(kept)
    return "".join(out) + code[at:]


def _strip(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([strip_comments(c, name) for c, name in zip(code, language)])


def without_comments(code: Column, language: Column) -> Column:
    return F.pandas_udf(_strip, T.StringType())(code, language)


def _blob(text: str) -> str:
    """The short id that git gives a text; zeros for none."""
    data = text.encode("utf-8", "replace")
    return hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()[:7] if data else "0000000"


def diff_of(before: str, after: str, path: str, mode: str = "100644") -> str:
    """A unified diff with git's header for one file; empty if the texts are equal.

    Hunks have three lines of context, no name of a function behind them, and may be cut otherwise than git cuts them.
    """
    if before == after:
        return ""
    lines = [f"diff --git a/{path} b/{path}", f"index {_blob(before)}..{_blob(after)} {mode}", f"--- a/{path}", f"+++ b/{path}"]
    for line in list(unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), n=3))[2:]:
        lines.append(line[:-1] if line.endswith("\n") else line + "\n\\ No newline at end of file")
    return "\n".join(lines)


def _diffs(before: pd.Series, after: pd.Series, path: pd.Series, language: pd.Series, mode: pd.Series, original: pd.Series) -> pd.Series:
    out = []
    for a, b, p, name, m, own in zip(before, after, path, language, mode, original):
        plain = [strip_comments(text or "", name) if name in FAMILIES else None for text in (a, b)]
        out.append(own if None in plain else diff_of(*plain, p, m or "100644"))
    return pd.Series(out)


def stripped_diff(before: Column, after: Column, path: Column, language: Column, mode: Column, original: Column) -> Column:
    """The diff of a file between two versions without their comments; ``original`` for languages without a lexer."""
    return F.pandas_udf(_diffs, T.StringType())(before, after, path, language, mode, original)
