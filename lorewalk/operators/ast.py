"""Structural search over syntax nodes.

Nodes are rows of a file: node_id (document order), parent_id, node_type, start_line
(from 1), end_line, start_column and end_column (from 0, in bytes), text and field (the
node's role in its parent, null without one).  They come from the parsers of
`lorewalk.sources.syntax` or from tables.

A query has one or more patterns:

* ``(type item*)`` is a node with children that match the items in their order, others
  between them; ``(_)`` and ``_`` are any node, ``type`` alone is a node without items.
* ``field: pattern`` asks for a child in a role, ``!field`` for a node without one.
* ``[a b]`` is any of several patterns, ``(a b)`` siblings in their order.
* ``?`` after a pattern: once if it can, ``+`` and ``*``: a run of neighbours, as long as
  it can be, for ``*`` also none.
* ``.`` before a pattern: the next sibling and no later one (the first child, at the
  beginning); after the last pattern: the last child.
* ``@name`` captures; ``(#eq? @a "x")``, ``#not-eq?``, ``#match?``, ``#not-match?``,
  ``#any-of?`` and ``#not-any-of?`` test the texts of captures, all nodes of one.

Anything else is refused.  A query is parsed once, on the driver.  A file's nodes are
matched together, in the pass that parses it or in a group of its own, so no node
travels that isn't captured; a pattern that is one node type is a plain filter.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewalk import dims
from lorewalk.sources import syntax
from lorewalk.sources.syntax import Tree

MATCHES = "file string, start_line int, end_line int, start_column int, end_column int, text string, captures array<struct<name: string, text: string>>"
#: Rows and characters of matches that a frame holds at most; a single match may be longer.
ROWS, CHARACTERS = 1 << 14, 1 << 22
TESTS = ("#eq?", "#not-eq?", "#match?", "#not-match?", "#any-of?", "#not-any-of?")
_TOKEN = re.compile(r'\s+|;[^\n]*|(?P<text>"(?:[^"\\]|\\.)*")|(?P<capture>@[\w.-]+)|(?P<test>#[\w-]+[?!])|(?P<field>\w+:)|(?P<no_field>!\w+)|(?P<name>\w[\w-]*)|(?P<mark>[()\[\].?*+])')


@dataclass
class Pattern:
    """A node (types: none for any), siblings (items alone) or several choices; how often; and what stands before it."""

    types: tuple[str, ...] = ()
    items: list[Pattern] = field(default_factory=list)
    choices: list[Pattern] = field(default_factory=list)
    siblings: bool = False
    captures: list[str] = field(default_factory=list)
    role: str | None = None
    without: list[str] = field(default_factory=list)
    often: str = ""
    next_only: bool = False
    ends: bool = False


@dataclass
class Query:
    patterns: list[Pattern]
    tests: list[tuple[str, str, tuple[str, ...]]]


def normalized(text: str) -> str:
    """The query with brackets round a bare type, and with a capture if it has none."""
    text = text.strip()
    if re.fullmatch(r"\w+", text, re.ASCII):
        text = f"({text})"
    return text if "@" in text else text + " @match"


def parse(text: str) -> Query:
    """The query of a text; ValueError where it isn't one."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"the pattern {text!r} has {text[at]!r} at {at}, which means nothing there")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
    place = 0
    tests: list[tuple[str, str, tuple[str, ...]]] = []

    def peek() -> tuple[str, str]:
        if place >= len(tokens):
            raise ValueError(f"the pattern {text!r} is not closed")
        return tokens[place]

    def take() -> tuple[str, str]:
        nonlocal place
        out = peek()
        place += 1
        return out

    def finished(p: Pattern) -> Pattern:
        nonlocal place
        while place < len(tokens):
            kind, token = tokens[place]
            if kind == "capture":
                p.captures.append(token[1:])
            elif token in ("?", "*", "+") and kind == "mark" and not p.often:
                p.often = token
            else:
                break
            place += 1
        return p

    def inner(close: str, out: list[Pattern], owner: Pattern | None) -> None:
        """Items up to a closing bracket."""
        next_only = False
        while peek()[1] != close:
            kind, token = peek()
            if kind == "mark" and token == ".":
                take()
                next_only = True
            elif kind == "no_field" and owner is not None:
                take()
                owner.without.append(token[1:])
            elif token == "(" and place + 1 < len(tokens) and tokens[place + 1][0] == "test":
                test()
            else:
                p = pattern()
                p.next_only, next_only = next_only, False
                out.append(p)
        take()
        if next_only:
            if owner is None:
                raise ValueError(f"the pattern {text!r} has a point at the end of choices")
            owner.ends = True

    def pattern() -> Pattern:
        kind, token = take()
        if kind == "field":
            p = pattern()
            p.role = token[:-1]
            return p
        if kind == "name":
            return finished(Pattern(() if token == "_" else (token,)))
        if kind == "text":
            return finished(Pattern((_unquoted(token),)))
        if token == "[":
            out = Pattern()
            inner("]", out.choices, None)
            if not out.choices:
                raise ValueError(f"the pattern {text!r} has no choice in []")
            return finished(out)
        if token == "(":
            kind, token = peek()
            if kind == "name":
                take()
                out = Pattern(() if token == "_" else (token,))
            else:
                out = Pattern(siblings=True)
            inner(")", out.items, out)
            if out.siblings and not out.items:
                raise ValueError(f"the pattern {text!r} has empty brackets")
            return finished(out)
        raise ValueError(f"the pattern {text!r} has {token!r} where a node should be")

    def test() -> None:
        take()
        name = take()[1]
        if name not in TESTS:
            raise ValueError(f"unknown predicate {name}; known: {', '.join(TESTS)}")
        kind, about = take()
        if kind != "capture":
            raise ValueError(f"{name} should begin with a capture, not {about}")
        given = []
        while peek()[1] != ")":
            kind, token = take()
            given.append(token if kind == "capture" else _unquoted(token) if kind == "text" else token)
        take()
        if not given or (len(given) > 1 and "any-of" not in name):
            raise ValueError(f"{name} has {len(given)} arguments")
        tests.append((name, about[1:], tuple(given)))

    patterns = []
    while place < len(tokens):
        if tokens[place][1] == "(" and place + 1 < len(tokens) and tokens[place + 1][0] == "test":
            test()
        else:
            patterns.append(pattern())
    if not patterns:
        raise ValueError("the pattern is empty")
    known = {c for p in patterns for c in _captures(p)}
    for name, about, given in tests:
        missing = {about, *(g[1:] for g in given if g.startswith("@"))} - known
        if missing:
            raise ValueError(f"{name} tests @{', @'.join(sorted(missing))}, which nothing captures")
    return Query(patterns, tests)


def _unquoted(token: str) -> str:
    return re.sub(r"\\(.)", r"\1", token[1:-1])


def _captures(p: Pattern) -> list[str]:
    return [*p.captures, *(c for x in [*p.items, *p.choices] for c in _captures(x))]


class Matcher:
    """Finds a query's matches in one file's tree: lists of (node, capture)."""

    def __init__(self, query: Query, tree: Tree):
        self.query, self.tree = query, tree

    def _one(self, p: Pattern, n: int) -> Iterator[list[tuple[int, str]]]:
        """Ways in which a node matches a pattern that stands for one node."""
        if p.role is not None and self.tree.roles[n] != p.role:
            return
        own = [(n, c) for c in p.captures]
        if p.choices:
            for choice in p.choices:
                if not choice.siblings:
                    for held in self._one(choice, n):
                        yield own + held
            return
        if p.types and self.tree.types[n] not in p.types:
            return
        kids = self.tree.children[n]
        if any(self.tree.roles[k] in p.without for k in kids):
            return
        if not p.items:
            if not p.ends:
                yield own
            return
        for _, held in self._row(p.items, 0, kids, 0, p.ends):
            yield own + held

    def _row(self, items: list[Pattern], k: int, kids: list[int], at: int, ends: bool) -> Iterator[tuple[int, list[tuple[int, str]]]]:
        """Ways in which siblings from a place on match items: where they end, and what they capture."""
        if k == len(items):
            if not ends or at == len(kids):
                yield at, []
            return
        p, some = items[k], False
        for begin in range(at, min(at + 1, len(kids)) if p.next_only else len(kids)):
            for end, held in self._often(p, kids, begin):
                some = True
                for stop, more in self._row(items, k + 1, kids, end, ends):
                    yield stop, held + more
            if some and p.often in ("*", "+", "?"):
                return  # as early and as long as it can be
        if not some and p.often in ("*", "?"):
            yield from self._row(items, k + 1, kids, at, ends)

    def _often(self, p: Pattern, kids: list[int], begin: int) -> Iterator[tuple[int, list[tuple[int, str]]]]:
        if p.often not in ("*", "+"):
            yield from self._once(p, kids, begin)
            return
        at, held = begin, []
        while at < len(kids):
            got = next(self._once(p, kids, at), None)
            if got is None or got[0] == at:
                break
            at, held = got[0], held + got[1]
        if at > begin:
            yield at, held

    def _once(self, p: Pattern, kids: list[int], begin: int) -> Iterator[tuple[int, list[tuple[int, str]]]]:
        if p.siblings:
            first = p.items[0]
            if next(self._often(first, kids, begin), None) is not None or first.often in ("*", "?"):
                yield from self._row([_at_once(first), *p.items[1:]], 0, kids, begin, p.ends)
            return
        for choice in p.choices:
            if choice.siblings:
                yield from self._once(choice, kids, begin)
        for held in self._one(p, kids[begin]):
            yield begin + 1, held

    def matches(self) -> Iterator[list[tuple[int, str]]]:
        """Captures of each match, in document order, outer nodes first."""
        for p in self.query.patterns:
            if not p.siblings and not p.often and not any(c.siblings for c in p.choices):
                found: Iterator = (held for n in range(len(self.tree.types)) for held in self._one(p, n))
            else:
                found = (held for kids in [self.tree.tops, *self.tree.children] for held in self._along(p, kids))
            for held in found:
                if held:
                    held.sort(key=lambda c: (self.tree.starts[c[0]], -self.tree.ends[c[0]]))
                    if all(self._holds(t, held) for t in self.query.tests):
                        yield held

    def _along(self, p: Pattern, kids: list[int]) -> Iterator[list[tuple[int, str]]]:
        at = 0
        while at < len(kids):
            step = at + 1
            for end, held in self._often(p, kids, at):
                yield held
                if p.often in ("*", "+"):
                    step = end
            at = step

    def _holds(self, test: tuple[str, str, tuple[str, ...]], held: list[tuple[int, str]]) -> bool:
        name, about, given = test
        texts = [self.tree.text(n) for n, c in held if c == about]
        others = [t for g in given for t in ([self.tree.text(n) for n, c in held if c == g[1:]] if g.startswith("@") else [g])]
        if "match" in name:
            hit = [re.search(others[0], t) is not None for t in texts] if others else []
        else:
            hit = [t in others for t in texts]
        return not any(hit) if "not-" in name else all(hit)


def _at_once(p: Pattern) -> Pattern:
    return Pattern(p.types, p.items, p.choices, p.siblings, p.captures, p.role, p.without, p.often, True, p.ends)


def found(file: str, tree: Tree, query: Query, texts: Collection[str] | None = None) -> Iterator[tuple]:
    """Rows of a file's matches; texts: the captures whose texts are wanted (none given: all), those of others are null."""
    held_texts: dict[int, str] = {}

    def text(n: int, c: str) -> str | None:
        if texts is not None and c not in texts:
            return None
        if n not in held_texts:
            held_texts[n] = tree.text(n)
        return held_texts[n]

    for held in Matcher(query, tree).matches():
        first, name = held[0]
        yield file, *tree.place(first), text(first, name), [{"name": c, "text": text(n, c)} for n, c in held]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MATCHES.split(", ", 6)])


def _frames(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    """Rows in frames of a bounded number of rows and characters, as many matches may repeat one long text."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r[5] or "") + sum(len(c["text"] or "") for c in r[6])
        if len(out) >= ROWS or size >= CHARACTERS:
            yield _frame(out)
            out, size = [], 0
    if out:
        yield _frame(out)


def search_files(files: DataFrame, text: str, language: str, limit: int = 0, texts: Collection[str] | None = None) -> DataFrame:
    """Matches in files (file, content) of one language, parsed and matched in one pass: file, position and text of the first capture, and all captures.

    texts: the captures whose texts are wanted, if not all; a long node that holds many others is else repeated with each of them.
    """
    query = parse(normalized(text))
    if language not in syntax.LANGUAGES:
        raise ValueError(f"no parser for {language}; known: {', '.join(syntax.LANGUAGES)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _frames(r for file, content in zip(batch["file"], batch["content"], strict=True) if content for r in found(file, syntax.tree(content, language), query, texts))

    return _limited(files.select("file", "content").mapInPandas(run, MATCHES), limit)


def search_ast(nodes: DataFrame, text: str, limit: int = 0) -> DataFrame:
    """Matches among the nodes of any number of files: file, position and text of the first capture, and all captures."""
    query = parse(normalized(text))
    p = query.patterns[0]
    if len(query.patterns) == 1 and not query.tests and not (p.items or p.choices or p.siblings or p.role or p.without or p.often or p.ends):
        rows = nodes.where(F.col("node_type").isin(*p.types)) if p.types else nodes
        captures = F.array(*[F.struct(F.lit(c).alias("name"), F.col("text").alias("text")) for c in p.captures])
        return _limited(rows.select("file", "start_line", "end_line", "start_column", "end_column", "text", captures.alias("captures")), limit)
    if "field" not in nodes.columns:
        nodes = nodes.withColumn("field", F.lit(None).cast("string"))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        return _frame(list(found(key[0], Tree.of_rows(rows.sort_values("node_id")), query)))

    columns = [c.split()[0] for c in syntax.NODES.split(", ")]
    return _limited(nodes.select(*columns).groupBy("file").applyInPandas(run, MATCHES), limit)


def _limited(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy("file", "start_line", "start_column").limit(limit) if limit else rows


def query_error(language: str, error: str) -> str:
    """What to say about a query that can't be read: the error, and some node types of the language."""
    types = dims.NODE_TYPES.get(language)
    if not types:
        return f"no syntax search for {language}; languages: {', '.join(dims.NODE_TYPES)}"
    hints = "\n".join(f"  ({t})  {category}: {example}" for category, t, example in types[:5])
    return f"{error}\nnode types of {language}, for example:\n{hints}"
