"""File paths: suffix, language, template files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each language (fixed values).
LANGUAGES = {
    "c": ".c .h", "cpp": ".cpp .cc .cxx .c++ .cp .hpp .hh .hxx .h++ .hp", "python": ".py .pyw .pyx .pyi", "java": ".java",
    "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .tsx", "go": ".go", "rust": ".rs",
}
# Names of files that a commit touches without being substantial (fixed values).
TEMPLATES = (
    ".gitignore .gitattributes .gitmodules readme readme.md readme.txt readme.rst license license.md license.txt licence changelog changelog.md changes "
    "history contributing contributing.md code_of_conduct code_of_conduct.md authors authors.md contributors setup.py setup.cfg pyproject.toml "
    "requirements.txt requirements-dev.txt manifest.in tox.ini .flake8 .pylintrc package.json package-lock.json yarn.lock .npmrc .nvmrc .eslintrc "
    ".prettierrc tsconfig.json jsconfig.json gemfile gemfile.lock .ruby-version cargo.toml cargo.lock go.mod go.sum makefile dockerfile .dockerignore "
    ".travis.yml .github .gitlab-ci.yml jenkinsfile azure-pipelines.yml .editorconfig .vscode .idea"
).split()


def extensions_for(*languages: str) -> set[str]:
    return {e for language in languages for e in LANGUAGES.get(language, "").split()}


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The lower-case suffix of the last component with its dot; empty for dotfiles and trailing dots."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for name, es in LANGUAGES.items() for e in es.split() for x in (e, name)))
    return table[suffix(path)]


def is_template(path: Column) -> Column:
    return F.lower(base_name(path)).isin(TEMPLATES)
