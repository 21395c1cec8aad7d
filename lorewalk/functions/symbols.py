"""Column builders over symbol paths, locations and file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX = r"\[\+?([0-9]+)\]$"


def overload(path: Column) -> tuple[Column, Column]:
    """The path without a trailing [n], and n (null without one)."""
    n = F.regexp_extract(path, INDEX, 1)
    return F.regexp_replace(path, INDEX, ""), F.when(n != "", n.try_cast("long"))


def _part_matches(value: Column, part: str) -> Column:
    """One path component against one with stars: a star at the end, else at the beginning, else the first one counts; the text before and after it may overlap."""
    if part == "*":
        return F.lit(True)
    if part.endswith("*"):
        return value.startswith(part[:-1])
    if part.startswith("*"):
        return value.endswith(part[1:])
    if "*" in part:
        before, after = part.split("*", 1)
        return value.startswith(before) & value.endswith(after)
    return value == part


def matches(path: Column, pattern: str) -> Column:
    """Whether a symbol's path matches: /absolute/path, relative/suffix, name, stars in components, and [n] for one overload."""
    exact = pattern.startswith("/")
    pattern = pattern.removeprefix("/") if exact else pattern
    wanted = re.search(INDEX, pattern)
    base, n = overload(path)
    if wanted:
        pattern = pattern[: wanted.start()]
    if "*" in pattern:
        parts, held = pattern.split("/"), F.split(base, "/")
        size = F.size(held) == len(parts) if exact else F.size(held) >= len(parts)
        found = size
        for k, part in enumerate(parts):
            found &= F.coalesce(_part_matches(F.try_element_at(held, F.lit(k - len(parts))), part), F.lit(False))
    elif exact:
        found = base == pattern
    elif "/" in pattern:
        found = (base == pattern) | base.endswith("/" + pattern)
    else:
        found = F.element_at(F.split(base, "/"), -1) == pattern
    return found & F.coalesce(n == int(wanted[1]), F.lit(False)) if wanted else found


def substring(name: Column, asked: str) -> Column:
    return F.contains(F.lower(name), F.lit(asked.lower()))


def normalized(name: Column, file: Column, kind: Column) -> Column:
    """The name trimmed; unnamed symbols are called after their file and kind."""
    base = F.element_at(F.split(file, "/"), -1)
    stem = F.when(F.locate(".", base, 2) > 0, F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")).otherwise(base)
    stem = F.when(F.coalesce(base, F.lit("")) == "", "anonymous").otherwise(stem)
    suffix = F.when(kind == "module", "module").when(kind == "function", "fn").when(kind.isin("variable", "constant"), "export").when(kind == "object", "config").otherwise("symbol")
    trimmed = F.trim(name)
    return F.when((trimmed != "") & ~trimmed.startswith("<"), trimmed).otherwise(F.concat(stem, F.lit("_"), suffix))


def without_type_parameters(name: Column) -> Column:
    return F.trim(F.split_part(F.split_part(name, F.lit("("), F.lit(1)), F.lit("<"), F.lit(1)))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def location(text: Column) -> Column:
    """struct<file, line, column, error> of file:line[:column], both from 1."""
    shape = r"^(?s)((?:[A-Za-z]:(?=.))?.*?):((?:-|[0-9]).*)$"
    number = lambda c: F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("bigint"))
    most = (1 << 32) - 1

    def read(t: Column) -> Column:
        found = t.rlike(shape)
        return _let(F.struct(F.regexp_extract(t, shape, 1).alias("file"), F.regexp_extract(t, shape, 2).alias("at")), lambda x: numbered(t, found, x["file"], x["at"]))

    def numbered(t: Column, found: Column, file: Column, at: Column) -> Column:
        colon = F.locate(":", at)
        line = number(F.when(colon > 0, F.substring_index(at, ":", 1)).otherwise(at))
        column = F.when(colon > 0, number(F.substr(at, colon + 1))).otherwise(F.lit(1).cast("bigint"))
        return _let(F.struct(line.alias("line"), column.alias("column")), lambda n: checked(t, found, file, at, n["line"], n["column"]))

    def checked(t: Column, found: Column, file: Column, at: Column, line: Column, column: Column) -> Column:
        error = (
            F.when(F.coalesce(t, F.lit("")) == "", "empty")
            .when(~found, "no position")
            .when(at.startswith("-"), "negative line")
            .when(line.isNull() | (line > most), "bad line")
            .when(column.isNull() | (column > most), "bad column")
            .when(line == 0, "line from 1")
            .when(column == 0, "column from 1")
        )
        return _let(error, lambda e: F.struct(F.when(e.isNull(), file).alias("file"), F.when(e.isNull(), line).cast("int").alias("line"), F.when(e.isNull(), column).cast("int").alias("column"), e.alias("error")))

    return _let(F.trim(text), read)


def position_valid(n_lines: Column, line_bytes: Column, line: Column, column: Column) -> Column:
    """Whether a position from 1 is in a file: the column may stand one byte after the line's last."""
    return line.between(1, n_lines) & column.between(1, line_bytes + 1)


def shown(file: Column, line: Column, column: Column) -> Column:
    """A place as file:line:column, what `location` reads."""
    return F.concat_ws(":", file, line.cast("string"), column.cast("string"))


def zero_based(n: Column) -> Column:
    return F.greatest(n - 1, F.lit(0))


def _bytes(text: Column) -> Column:
    """The text's UTF-8 bytes as one character each."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def path_to_uri(path: Column) -> Column:
    """file:// and the path, other bytes than letters, digits and /.-_~ as %XX."""
    each = F.regexp_extract_all(_bytes(path), F.lit("(?s)(.)"), 1)
    coded = F.transform(each, lambda c: F.when(c.rlike(r"[/A-Za-z0-9._~-]"), c).otherwise(F.concat(F.lit("%"), F.hex(F.encode(c, "ISO-8859-1")))))
    return F.concat(F.lit("file://"), F.array_join(coded, ""))


def percent_decoded(text: Column) -> Column:
    """%XX as bytes; a plus stays; a percent sign before anything else stays and the two bytes after it go."""
    each = F.regexp_extract_all(_bytes(text), F.lit("(?s)(%.{0,2}|[^%]+)"), 1)
    plain = F.transform(
        each,
        lambda x: F.when(x.rlike("^%[0-9A-Fa-f]{2}$"), F.decode(F.unhex(F.substring(x, 2, 2)), "ISO-8859-1")).when(x.startswith("%"), "%").otherwise(x),
    )
    return F.decode(F.encode(F.array_join(plain, ""), "ISO-8859-1"), "UTF-8")


def uri_to_path(uri: Column) -> Column:
    return F.when(uri.startswith("file://"), percent_decoded(F.substring(uri, 8, 1 << 30))).otherwise(uri)


def under(path: Column, root: str) -> Column:
    """Whether a path is the root or below it, component by component."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)


#: Parts of paths that are not the project's own.
FOREIGN = ("node_modules", ".venv", "__pycache__", "/vendor/", "/target/debug/", "/target/release/", "/.git/")


def own(path: Column, root: str) -> Column:
    """Whether a path is the project's own code."""
    out = under(path, root)
    for x in FOREIGN:
        out &= ~F.contains(path, F.lit(x))
    return out


def extension(path: Column) -> Column:
    """The file's extension in lower case, empty without one; a leading dot begins a name."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(base, r"^.+\.([^.]*)$", 1))
