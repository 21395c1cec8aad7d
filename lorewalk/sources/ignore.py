"""Ignore rules: patterns compiled once on the driver, applied as column expressions.

Names of dims.IGNORED_NAMES are ignored wherever they stand and cannot be let in
again.  Then the last pattern that matches a path or one of its folders decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewalk import dims

#: The ignore files of folders, and the folder that holds a project's own.
IGNORE_FILE, PROJECT_FOLDER = ".gitignore", ".lorewalk"


@dataclass(frozen=True)
class Rule:
    pattern: str
    lets_in: bool
    folders_only: bool


def _regex(glob: str) -> str:
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif c == "*":
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            body = glob[k + 1 : end]
            out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]", end + 1
        else:
            out, k = out + re.escape(c), k + 1
    return out


def compile_rules(text: str, base: str = "") -> list[Rule]:
    """The rules of an ignore file that stands in the folder base."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip() if not line.endswith("\\ ") else line
        if not line or line.startswith("#"):
            continue
        lets_in = line.startswith("!")
        line = line.removeprefix("!").removeprefix("\\")
        folders_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        head = re.escape(base.rstrip("/") + "/") if base else ""
        rules.append(Rule("^" + head + ("" if anchored else "(?:.*/)?") + _regex(line.lstrip("/")), lets_in, folders_only))
    return rules


def by_name(path: Column) -> Column:
    """Whether a component of the path is one of the names that are always ignored."""
    names = [n for n in dims.IGNORED_NAMES if not n.startswith("*")]
    ends = [n[1:] for n in dims.IGNORED_NAMES if n.startswith("*")]

    def bad(x: Column) -> Column:
        out = x.isin(*names)
        for e in ends:
            out |= x.endswith(e)
        return out

    return F.exists(F.split(path, "/"), bad)


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.startswith(".") & ~x.isin(".", ".."))


def ignored(path: Column, rules: list[Rule], *, show_hidden: bool = False) -> Column:
    """Whether a relative file path is ignored. A rule for folders looks at the path's folders only."""
    decided = F.lit(False)
    for r in rules:
        hit = path.rlike(r.pattern + ("/" if r.folders_only else "(?:/|$)"))
        decided = F.when(hit, F.lit(not r.lets_in)).otherwise(decided)
    out = by_name(path) | decided
    return out if show_hidden else out | hidden(path)


def is_ignored(path: str, rules: list[Rule], *, folder: bool = False, show_hidden: bool = False) -> bool:
    """The same of one path, on the driver; a folder that is ignored need not be entered."""
    parts = path.split("/")
    names = [n for n in dims.IGNORED_NAMES if not n.startswith("*")]
    if any(x in names or x.endswith(tuple(n[1:] for n in dims.IGNORED_NAMES if n.startswith("*"))) for x in parts):
        return True
    if not show_hidden and any(x.startswith(".") and x not in (".", "..") for x in parts):
        return True
    decided = False
    for r in rules:
        if re.match(r.pattern + ("/" if r.folders_only else "(?:/|$)"), path + "/" * folder):
            decided = not r.lets_in
    return decided
