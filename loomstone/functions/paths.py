"""Predicates and classes of file paths and documentation tokens."""

from __future__ import annotations

import builtins
import functools
import keyword

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions import words

#: Parts of a lower-cased path that mark non-production files (anywhere, also inside a word).
NON_PRODUCTION = ("/tests/", "run_uat", "uat_test", "_rev", "/test_", "_test.py", "mock", "sandbox", "temp", "__pycache__", ".venv", ".git")
#: In order, the first class whose pattern the path (with / for \\, in any case) has.
PATH_CLASSES = (
    ("doc_tooling", r"(^|/)(conf\.py$|docs?/conf|sphinx|mkdocs)"),
    ("tooling", r"(^|/)(benchmarks?|prerelease|release|setup|build|[\w]*_shim|[\w]*_check|[\w]*_standalone[\w]*|conftest)\.py$"),
    ("test", r"(^|/)(tests?|testing|conftest\.py$)(/|$)"),
    ("example", r"(^|/)(examples?|tutorials?|samples?|demos?|docs?|doc)/"),
    ("cli", r"(^|/)(cli|__main__\.py$|scripts?)(/|$)"),
)
#: Ignored folders of a source scan.
IGNORED_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv")

#: What the project scan leaves out, besides folders that begin with a dot.
PROJECT_DIRS, PROJECT_FILES = (".venv", "__pycache__", ".git", ".idea", ".vscode"), ("main.py", "run_uat.py", "run_uat_per_case.py", "uat_test_cases.py")
#: Parts of a path that the graph scan leaves out.
GRAPH_IGNORED = (
    ".venv", "venv", "__pycache__", ".git", ".pytest_cache", "backups", "archive", "logs", "reports", "real_world", "site-packages", "vendor", "external",
)
#: Parts of a path that mark copies and archives.
BACKUP_MARKS = (".bak", "_old", "_backup", " - Copy", "_pre_", ".pre_", "_archive")


def _slashes(path) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def in_project_scan(path) -> Column:
    """Python files but for named ones, and those in named or hidden folders."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda p: p.isin(*PROJECT_DIRS) | (p.startswith(".") & ~p.isin(".", "..")))
    return path.endswith(".py") & ~F.element_at(parts, -1).isin(*PROJECT_FILES) & ~hidden


def in_graph_scan(path) -> Column:
    """Python files none of whose parts, the file's own name too, is ignored."""
    return path.endswith(".py") & ~F.exists(F.split(path, "/"), lambda p: p.isin(*GRAPH_IGNORED))


def is_internal(path) -> Column:
    """Files of the engine itself: under core/, and main.py anywhere."""
    p = _slashes(path)
    return p.startswith("./core/") | p.startswith("core/") | p.endswith("main.py")


def is_under(path, project_root) -> Column:
    """Whether the path begins with the project's root, whatever the case and the kind of slash."""
    return F.startswith(F.lower(_slashes(path)), F.lower(_slashes(F.lit(project_root) if isinstance(project_root, str) else project_root)))


def is_backup(path) -> Column:
    return functools.reduce(lambda a, b: a | b, (F.contains(path, F.lit(m)) for m in BACKUP_MARKS))


def is_test_name(name) -> Column:
    return name.startswith("test_") | name.startswith("_test_")


def is_production(path) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    bad = F.lit(False)
    for part in NON_PRODUCTION:
        bad = bad | F.contains(low, F.lit(part))
    return ~bad


def path_class(path) -> Column:
    out, low = F.lit("production"), F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    for name, pattern in reversed(PATH_CLASSES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def under_ignored(path, ignored=IGNORED_DIRS) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(x) for x in ignored)))


def is_declaration(path) -> Column:
    return F.lower(path).rlike(r"\.(h|hpp|hh|hxx|pyi)$|\.d\.ts$")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def module_name(path) -> Column:
    """Dotted module of a Python file: every .py goes, as does a last __init__."""
    dotted = F.replace(F.replace(path, F.lit(".py"), F.lit("")), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


#: Forms of file names and of settings.
FILE_NAME = r"(?i)^.*\.(py|html|txt|cfg|ini|toml|yaml|yml|json|rst|md|jinja2?|css|js|po|pot|mo)$"
SETTING = r"^[A-Z][A-Z0-9_]{2,}$"


def doc_token_class(token, with_role=None, own=()) -> Column:
    """Class of a name quoted in documentation; the first rule that fits.

    `with_role` tells that the text marks it as code of a kind; `own` are the repository's own dependencies.
    """
    role = F.lit(False) if with_role is None else F.coalesce(with_role, F.lit(False))
    parts = F.split(token, r"\.")
    head, last = F.element_at(parts, 1), F.element_at(parts, -1)
    any_in = lambda names, *columns: functools.reduce(lambda a, b: a | b, (c.isin(*names) for c in columns))
    keywords = sorted({*keyword.kwlist, *keyword.softkwlist, "match", "case", "type"})
    packages = sorted({*words.DEPENDENCY_WORDS, *own})
    dotted = F.contains(token, F.lit("."))
    return (
        F.when(any_in(keywords, last, token), "keyword")
        .when(token.rlike(FILE_NAME), "filename")
        .when(any_in(words.HTTP_WORDS, token, last), "http")
        .when(any_in(packages, head, token, last), "dependency")
        .when(token.rlike(SETTING), "config")
        .when(any_in(words.STDLIB_WORDS, last, head, token), "stdlib")
        .when(any_in(sorted(dir(builtins)), last), "builtin")
        .when(any_in(words.EXAMPLE_WORDS, last, token), "example")
        .when(dotted & ~role, "member")
        .when(~role & (token == F.lower(token)) & (token != F.upper(token)) & (F.length(token) < 14), "prose")
        .otherwise("api")
    )
