"""Syntax nodes of files: Python and HTML by the standard library's parsers, other languages by an outline parser.

The outline parser knows a language by its comments and strings, which it blanks out,
and by a table of declarations and statements: how one begins, and where it ends (its
block, its statement, its line, its closing word).  Nodes that lie in one another make
the tree; a declaration's name is a child of type `identifier` in the role `name`.
Expressions are not parsed.  A text that isn't well formed gives the nodes that are
found in it.

Node rows: file, node_id (document order), parent_id, node_type, start_line (from 1),
end_line, start_column and end_column (from 0, in bytes), text and field.
"""

from __future__ import annotations

import ast as python_ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

NODES = "file string, node_id long, parent_id long, node_type string, start_line int, end_line int, start_column int, end_column int, text string, field string"


class Tree:
    """A file's nodes: types, starts and ends (places that order nodes), roles, children and the top ones."""

    def __init__(self, content: str, nodes: list[tuple[str, int | None, int, int, str | None]]):
        """nodes: type, parent, start, end (in characters) and role, parents before their children."""
        self.content = content
        self.types = [n[0] for n in nodes]
        self.parents = [n[1] for n in nodes]
        self.starts: list = [n[2] for n in nodes]
        self.ends: list = [n[3] for n in nodes]
        self.roles = [n[4] for n in nodes]
        self._lines: list[int] | None = None
        self._rows: list[tuple] | None = None
        self._link()

    def _link(self) -> None:
        self.children: list[list[int]] = [[] for _ in self.types]
        self.tops: list[int] = []
        for k, p in enumerate(self.parents):
            (self.tops if p is None else self.children[p]).append(k)

    @staticmethod
    def of_rows(rows: pd.DataFrame) -> Tree:
        """A tree of node rows of one file, in document order."""
        out = Tree("", [])
        place = {n: k for k, n in enumerate(rows["node_id"])}
        out.types = list(rows["node_type"])
        out.parents = [place.get(p) if pd.notna(p) else None for p in rows["parent_id"]]
        out.starts = list(zip(rows["start_line"], rows["start_column"], strict=True))
        out.ends = [_Reversible(x) for x in zip(rows["end_line"], rows["end_column"], strict=True)]
        out.roles = [r if isinstance(r, str) else None for r in rows["field"]]
        out._rows = list(zip(rows["start_line"], rows["end_line"], rows["start_column"], rows["end_column"], rows["text"], strict=True))
        out._link()
        return out

    def _point(self, at: int) -> tuple[int, int]:
        if self._lines is None:
            self._lines = [0, *(m.end() for m in re.finditer("\n", self.content))]
        line = bisect_right(self._lines, at) - 1
        return line + 1, len(self.content[self._lines[line] : at].encode())

    def place(self, n: int) -> tuple[int, int, int, int]:
        """start_line, end_line, start_column and end_column."""
        if self._rows is not None:
            return tuple(map(int, self._rows[n][:4]))
        (a, b), (c, d) = self._point(self.starts[n]), self._point(self.ends[n])
        return a, c, b, d

    def text(self, n: int) -> str:
        return self._rows[n][4] if self._rows is not None else self.content[self.starts[n] : self.ends[n]]


class _Reversible(tuple):
    """A place that can be negated, for an order from the last to the first."""

    def __neg__(self) -> tuple:
        return tuple(-x for x in self)


# HTML -----------------------------------------------------------------------------

#: Elements without an end tag.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Html(HTMLParser):
    def __init__(self, content: str):
        super().__init__(convert_charrefs=False)
        self.lines = [0, *(m.end() for m in re.finditer("\n", content))]
        self.content, self.open, self.rows = content, [], []
        self.count: dict[str, int] = {}
        self.feed(content)
        self.close()
        while self.open:
            self._end(len(content))

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _end(self, stop: int) -> None:
        k = self.open.pop()
        self.rows[k][3] = stop
        self.count[self.rows[k][0]] -= 1

    def handle_starttag(self, tag, attrs):
        self.handle_startendtag(tag, attrs)
        if tag not in _VOID:
            self.open.append(len(self.rows) - 1)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        at = self._offset()
        self.rows.append([tag, self.open[-1] if self.open else None, at, at + len(self.get_starttag_text() or ""), None])

    def handle_endtag(self, tag):
        if self.count.get(tag):
            at = self._offset()
            stop = self.content.find(">", at) + 1 or len(self.content)
            while self.rows[self.open[-1]][0] != tag:
                self._end(at)
            self._end(stop)


def _html(content: str) -> Tree:
    return Tree(content, _Html(content).rows)


# Python ---------------------------------------------------------------------------

# Python's own node names and the ones used in patterns.
_PYTHON = {
    "ClassDef": "class_definition", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "Import": "import_statement", "ImportFrom": "import_from_statement",
    "Assign": "assignment", "AnnAssign": "assignment", "If": "if_statement", "For": "for_statement", "AsyncFor": "for_statement", "While": "while_statement", "Try": "try_statement",
    "TryStar": "try_statement", "With": "with_statement", "AsyncWith": "with_statement", "Lambda": "lambda", "Module": "module", "Name": "identifier", "Call": "call", "Return": "return_statement",
}
#: Roles by the names of Python's own fields.
_ROLES = {"func": "function", "targets": "left", "target": "left", "value": "right", "test": "condition", "returns": "return_type"}


def _python(content: str) -> Tree:
    try:
        top = python_ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return Tree(content, [])
    lines = [0, *(m.end() for m in re.finditer("\n", content))]

    def offset(line: int, column: int) -> int:
        begin = lines[min(line, len(lines)) - 1]
        end = lines[line] if line < len(lines) else len(content)
        return begin + len(content[begin:end].encode()[:column].decode(errors="ignore"))

    out: list[tuple[str, int | None, int, int, str | None]] = []
    todo: list[tuple[python_ast.AST, int | None, str | None]] = [(top, None, None)]
    while todo:
        node, parent, role = todo.pop()
        kind = _PYTHON.get(type(node).__name__)
        if kind:
            k = len(out)
            if isinstance(node, python_ast.Module):
                start, end = 0, len(content)
            else:
                start, end = offset(node.lineno, node.col_offset), offset(node.end_lineno, node.end_col_offset)
            decorators = getattr(node, "decorator_list", [])
            if decorators:  # the whole is one node, what is decorated the one below it
                out.append(("decorated_definition", parent, offset(decorators[0].lineno, decorators[0].col_offset) - 1, end, role))
                parent, role, k = k, "definition", k + 1
            out.append((kind, parent, start, end, role))
            parent = k
            name = getattr(node, "name", None)
            if isinstance(name, str):
                at = re.compile(rf"\b{re.escape(name)}\b").search(content, start, end)
                if at:
                    out.append(("identifier", k, at.start(), at.end(), "name"))
        below = [(x, parent, _ROLES.get(f, f) if kind else role) for f, v in python_ast.iter_fields(node) for x in (v if isinstance(v, list) else [v]) if isinstance(x, python_ast.AST)]
        todo += sorted(below, key=lambda b: (getattr(b[0], "lineno", 0), getattr(b[0], "col_offset", 0)), reverse=True)
    return Tree(content, out)


# Outlines -------------------------------------------------------------------------

# How declarations and statements begin in each language, by the names that tree-sitter grammars give them, and how
# they end: { a block, or a semicolon before it; ; a statement; [ or ( the bracket that opens last; = the line; E a closing word; . the match itself.
_C_IF = (("if_statement", r"\bif\s*(?:constexpr\s*)?\(", "{"), ("for_statement", r"\bfor\s*\(", "{"))
_MODS = r"(?:\b(?:public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|partial|readonly|synchronized|native|default|extern|unsafe|new|strictfp)\s+)*"
_TYPE = r"(?!(?:public|private|protected|internal|static|final|abstract|return|new|else|throw|using|namespace|import|package|await|yield|case|goto|typedef|if|for|while|switch)\b)[\w.:]+(?:<[^;{}()]*>)?(?:\s*\[\s*\])*[\s*&?]+"
_JS = (
    ("class_declaration", r"\bclass\s+(?P<name>[\w$]+)", "{"),
    ("generator_function_declaration", r"(?:\basync\s+)?\bfunction\s*\*\s*(?P<name>[\w$]+)", "{"),
    ("function_declaration", r"(?:\basync\s+)?\bfunction\s+(?P<name>[\w$]+)", "{"),
    ("arrow_function", r"(?:\basync\s+)?(?:\([^()]*\)|[\w$]+)(?:\s*:\s*[\w<>\[\]|. ]+)?\s*=>", ">"),
    ("method_definition", r"(?:^|(?<=[{};]))[ \t]*(?P<head>(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*\*?\s*(?!(?:if|for|while|switch|catch|function|return|with)\b)(?P<name>#?[\w$]+)\s*(?:<[^<>{}]*>)?\([^(){};]*\)\s*(?::[^{};=]+)?(?=\{))", "{"),
    ("import_statement", r"^[ \t]*(?P<head>import\b(?!\s*\())", ";"),
    ("export_statement", r"^[ \t]*(?P<head>export\b)", "X"),
    ("lexical_declaration", r"\b(?:const|let)\s+(?P<name>[\w$]+|[\[{])(?!\s+(?:in|of)\b)", ";"),
    ("variable_declaration", r"\bvar\s+(?P<name>[\w$]+)", ";"),
    ("for_in_statement", r"\bfor\s*(?:await\s*)?\([^();]*\b(?:in|of)\b", "{"),
    ("for_statement", r"\bfor\s*\((?![^();]*\b(?:in|of)\b[^();]*\))", "{"),
    ("if_statement", r"\bif\s*\(", "{"),
)
RULES: dict[str, tuple[tuple[str, str, str], ...]] = {
    "rust": (
        ("struct_item", r"(?:\bpub(?:\([^)]*\))?\s+)?\bstruct\s+(?P<name>\w+)", "{"),
        ("enum_item", r"(?:\bpub(?:\([^)]*\))?\s+)?\benum\s+(?P<name>\w+)", "{"),
        ("function_item", r"(?:\bpub(?:\([^)]*\))?\s+)?(?:\b(?:default|const|async|unsafe|extern)\s+)*\bfn\s+(?P<name>\w+)", "{"),
        ("trait_item", r"(?:\bpub(?:\([^)]*\))?\s+)?(?:\bunsafe\s+)?\btrait\s+(?P<name>\w+)", "{"),
        ("impl_item", r"^[ \t]*(?P<head>(?:unsafe\s+)?impl\b)", "{"),
        ("mod_item", r"(?:\bpub(?:\([^)]*\))?\s+)?\bmod\s+(?P<name>\w+)", "{"),
        ("use_declaration", r"(?:\bpub(?:\([^)]*\))?\s+)?\buse\s", ";"),
        ("type_item", r"(?:\bpub(?:\([^)]*\))?\s+)?\btype\s+(?P<name>\w+)[^=;{]*=", ";"),
        ("const_item", r"(?:\bpub(?:\([^)]*\))?\s+)?\bconst\s+(?P<name>\w+)\s*:", ";"),
        ("static_item", r"(?:\bpub(?:\([^)]*\))?\s+)?\bstatic\s+(?:mut\s+)?(?P<name>\w+)\s*:", ";"),
        ("macro_definition", r"\bmacro_rules!\s*(?P<name>\w+)", "{"),
        ("attribute_item", r"#!?\[", "["),
    ),
    "go": (
        ("struct_type", r"\bstruct\s*\{", "{"),
        ("interface_type", r"\binterface\s*\{", "{"),
        ("function_declaration", r"^func\s+(?P<name>\w+)", "{"),
        ("method_declaration", r"^func\s*\([^)]*\)\s*(?P<name>\w+)", "{"),
        ("type_declaration", r"^[ \t]*(?P<head>type\s+(?P<name>\w+))", "="),
        ("type_alias", r"^[ \t]*type\s+(?P<head>(?P<name>\w+)\s*=)", "="),
        ("import_declaration", r"^import\b", "="),
        ("const_declaration", r"^[ \t]*(?P<head>const\b)", "="),
        ("var_declaration", r"^[ \t]*(?P<head>var\b)", "="),
        ("short_var_declaration", r"\b(?P<name>\w+)(?:\s*,\s*\w+)*\s*:=", "="),
        ("if_statement", r"\bif\b", "{"),
        ("for_statement", r"\bfor\b", "{"),
    ),
    "java": (
        ("class_declaration", _MODS + r"\bclass\s+(?P<name>\w+)", "{"),
        ("annotation_type_declaration", _MODS + r"@interface\s+(?P<name>\w+)", "{"),
        ("interface_declaration", _MODS + r"(?<!@)\binterface\s+(?P<name>\w+)", "{"),
        ("enum_declaration", _MODS + r"\benum\s+(?P<name>\w+)", "{"),
        ("record_declaration", _MODS + r"\brecord\s+(?P<name>\w+)\s*\(", "{"),
        ("method_declaration", r"^[ \t]*(?P<head>" + _MODS + r"(?:<[^;{}()]*>\s*)?" + _TYPE + r"(?P<name>\w+)\s*\([^;{}()]*\)(?:\s*throws\s+[\w., ]+)?\s*(?=[{;]))", "{"),
        ("constructor_declaration", r"^[ \t]*(?P<head>(?:(?:public|private|protected)\s+)?(?P<name>[A-Z]\w*)\s*\([^;{}()]*\)(?:\s*throws\s+[\w., ]+)?\s*(?=\{))", "{"),
        ("field_declaration", r"^[ \t]*(?P<head>" + _MODS.replace(")*", ")+") + _TYPE + r"(?P<name>\w+)\s*(?=[=;,]))", ";"),
        ("import_declaration", r"^import\b", ";"),
        ("annotation", r"@(?!interface\b)(?P<name>[\w.]+)(?:\s*\([^()]*\))?", "."),
        *_C_IF,
    ),
    "kotlin": (
        ("class_declaration", r"(?:\b(?:public|private|protected|internal|open|abstract|sealed|data|enum|inner|annotation|value)\s+)*(?<!@)\b(?:class|interface)\s+(?P<name>\w+)", "B"),
        ("object_declaration", r"(?<!companion )\bobject\s+(?P<name>\w+)", "B"),
        ("companion_object", r"\bcompanion\s+object\b", "B"),
        ("function_declaration", r"(?:\b(?:public|private|protected|internal|open|override|abstract|suspend|inline|operator|infix|tailrec)\s+)*\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(?P<name>\w+)\s*\(", "B"),
        ("anonymous_function", r"\bfun\s*\(", "B"),
        ("property_declaration", r"(?<![(,])(?<![(,]\s)(?:\b(?:public|private|protected|internal|open|override|const|lateinit)\s+)*\b(?:val|var)\s+(?P<name>\w+)", "="),
        ("import_header", r"^import\b", "="),
        ("type_alias", r"\btypealias\s+(?P<name>\w+)", "="),
        ("annotation", r"@(?P<name>[\w.]+)(?:\([^()]*\))?", "."),
        ("if_expression", r"\bif\s*\(", "B"),
        ("when_expression", r"\bwhen\b", "B"),
    ),
    "cpp": (
        ("class_specifier", r"(?<!enum )\bclass\s+(?P<name>\w+)(?=[^;(){}>,]*\{)", "{"),
        ("struct_specifier", r"(?<!enum )\bstruct\s+(?P<name>\w+)?(?=[^;(){}>,]*\{)", "{"),
        ("function_definition", r"^[ \t]*(?:template\s*<[^;{}]*>\s*)?(?P<head>(?:(?:static|inline|constexpr|virtual|explicit|extern)\s+)*(?:" + _TYPE + r")?(?P<name>[\w:~]+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{}]*)?(?=\{))(?<!\bif)", "{"),
        ("namespace_definition", r"\bnamespace\b\s*(?P<name>[\w:]+)?(?=\s*\{)", "{"),
        ("template_declaration", r"\btemplate\s*<", "{"),
        ("enum_specifier", r"\benum\s+(?:class\s+|struct\s+)?(?P<name>\w+)", "{"),
        ("field_declaration", r"^[ \t]+(?P<head>(?:(?:static|mutable|const)\s+)*" + _TYPE + r"(?P<name>\w+)\s*(?:=[^;(){}]*)?(?=;))", ";"),
        ("type_definition", r"\btypedef\b", ";"),
        ("concept_definition", r"\bconcept\s+(?P<name>\w+)", ";"),
        ("using_declaration", r"\busing\s+(?!namespace\b)[\w:]+\s*;", "."),
        *_C_IF,
    ),
    "csharp": (
        ("class_declaration", _MODS + r"\bclass\s+(?P<name>\w+)", "{"),
        ("interface_declaration", _MODS + r"\binterface\s+(?P<name>\w+)", "{"),
        ("struct_declaration", _MODS + r"(?<!record )\bstruct\s+(?P<name>\w+)", "{"),
        ("enum_declaration", _MODS + r"\benum\s+(?P<name>\w+)", "{"),
        ("record_declaration", _MODS + r"\brecord\s+(?:class\s+|struct\s+)?(?P<name>\w+)", "{"),
        ("method_declaration", r"^[ \t]*(?P<head>" + _MODS + _TYPE + r"(?P<name>\w+)\s*(?:<[^<>;{}()]*>)?\s*\([^;{}()]*\)\s*(?=[{;]|=>|where\b))", "{"),
        ("constructor_declaration", r"^[ \t]*(?P<head>(?:(?:public|private|protected|internal|static)\s+)+(?P<name>[A-Z]\w*)\s*\([^;{}()]*\)\s*(?::\s*\w+\s*\([^;{}]*\)\s*)?(?=\{))", "{"),
        ("property_declaration", r"^[ \t]*(?P<head>" + _MODS + _TYPE + r"(?P<name>\w+)\s*(?=\{\s*(?:\w+\s+)?(?:get|set|init)\b))", "{"),
        ("field_declaration", r"^[ \t]*(?P<head>" + _MODS.replace(")*", ")+") + _TYPE + r"(?P<name>\w+)\s*(?=[=;,](?!>)))", ";"),
        ("namespace_declaration", r"\bnamespace\s+(?P<name>[\w.]+)", "{"),
        ("using_directive", r"^[ \t]*(?P<head>(?:global\s+)?using\s+(?:static\s+)?[\w.= ]+(?=;))", ";"),
        ("delegate_declaration", _MODS + r"\bdelegate\s+" + _TYPE + r"(?P<name>\w+)", ";"),
    ),
    "php": (
        ("class_declaration", r"(?:\b(?:abstract|final|readonly)\s+)*(?<!::)(?<!new )\bclass\s+(?P<name>\w+)", "{"),
        ("interface_declaration", r"\binterface\s+(?P<name>\w+)", "{"),
        ("trait_declaration", r"\btrait\s+(?P<name>\w+)", "{"),
        ("enum_declaration", r"\benum\s+(?P<name>\w+)", "{"),
        ("function_definition", r"^[ \t]*(?P<head>function\s+&?(?P<name>\w+))", "{"),
        ("method_declaration", r"(?:\b(?:public|private|protected|static|abstract|final)\s+)+function\s+&?(?P<name>\w+)", "{"),
        ("namespace_definition", r"\bnamespace\s+(?P<name>[\w\\]+)", "{"),
        ("namespace_use_declaration", r"^use\s+[\w\\]", ";"),
        ("property_declaration", r"(?:\b(?:public|private|protected|static|readonly|var)\s+)+(?:\??[\w\\|]+\s+)?\$(?P<name>\w+)", ";"),
        ("const_declaration", r"(?:\b(?:public|private|protected|final)\s+)*\bconst\s+(?:\w+\s+)?(?P<name>\w+)\s*=", ";"),
        ("if_statement", r"\bif\s*\(", "{"),
        ("foreach_statement", r"\bforeach\s*\(", "{"),
    ),
    "javascript": _JS,
    "typescript": (
        ("abstract_class_declaration", r"\babstract\s+class\s+(?P<name>[\w$]+)", "{"),
        ("interface_declaration", r"\binterface\s+(?P<name>[\w$]+)", "{"),
        ("type_alias_declaration", r"\btype\s+(?P<name>[\w$]+)[^=;{}]*=", ";"),
        ("enum_declaration", r"(?:\bconst\s+)?\benum\s+(?P<name>[\w$]+)", "{"),
        *((t, r"(?<!abstract )" + p if t == "class_declaration" else p.replace("(?:const|let)", "(?:const(?!\\s+enum)|let)"), e) for t, p, e in _JS),
    ),
    "shellscript": (
        ("function_definition", r"^[ \t]*(?P<head>(?:function\s+(?P<name>[\w-]+)(?:\s*\(\s*\))?|(?P<name2>[\w-]+)\s*\(\s*\))\s*(?=\{))", "{"),
        ("variable_assignment", r"(?:^|(?<=[\s;]))(?P<head>(?P<name>[A-Za-z_]\w*)\+?=)", "W"),
        ("if_statement", r"(?:^|(?<=[;&|]))[ \t]*(?P<head>if\b)", "E"),
        ("case_statement", r"(?:^|(?<=[;&|]))[ \t]*(?P<head>case\b)", "E"),
        ("c_style_for_statement", r"(?:^|(?<=[;&|]))[ \t]*(?P<head>for\s*\(\()", "E"),
        ("for_statement", r"(?:^|(?<=[;&|]))[ \t]*(?P<head>for\s+\w+\s+in\b)", "E"),
        ("while_statement", r"(?:^|(?<=[;&|]))[ \t]*(?P<head>(?:while|until)\b)", "E"),
        ("pipeline", r"^[ \t]*(?P<head>(?!#|(?:if|while|until|case|for|function)\b)[^\n;|&#]+(?<!\|)\|(?!\|)[^\n;&#]+)", "."),
        ("redirected_statement", r"^[ \t]*(?P<head>(?!#)[^\n;|&#<>]+[<>]{1,2}[ \t]*[^\s;|&()<>]+)", "."),
        ("command", r"(?:^|(?<=[;|&]))[ \t]*(?P<head>(?!(?:if|then|else|elif|fi|for|while|until|do|done|case|esac|in|function)\b)(?P<name>[A-Za-z_./][\w./-]*)(?!\s*\(\s*\)|\+?=|[\w./-])[^\n;|&#<>{}]*)", "."),
    ),
    "ruby": (
        ("class", r"^[ \t]*(?P<head>class\s+(?P<name>[\w:]+))", "E"),
        ("module", r"^[ \t]*(?P<head>module\s+(?P<name>[\w:]+))", "E"),
        ("singleton_method", r"^[ \t]*(?P<head>def\s+\w+\.(?P<name>[\w?!=]+))", "E"),
        ("method", r"^[ \t]*(?P<head>def\s+(?!\w+\.)(?P<name>[\w?!=]+))", "E"),
        ("lambda", r"->\s*(?:\([^()]*\))?\s*(?=\{)", "{"),
        ("do_block", r"\bdo\b(?=[ \t]*(?:\||\n|$))", "E"),
        ("block", r"(?<=[\w)?!])[ \t]*(?P<head>\{)(?=[ \t]*(?:\||\w))", "{"),
        ("assignment", r"^[ \t]*(?P<head>(?P<name>[@$]{0,2}[a-z_]\w*)\s*(?:\|\||&&|[+*/-])?=(?![=~>]))", "="),
        ("if", r"^[ \t]*(?P<head>if\b)", "E"),
        ("case", r"(?:^|(?<==))[ \t]*(?P<head>case\b)", "E"),
        ("while", r"^[ \t]*(?P<head>while\b)", "E"),
        ("for", r"^[ \t]*(?P<head>for\b)", "E"),
    ),
    "lua": (
        ("function_declaration", r"(?:\blocal\s+)?\bfunction\s+(?P<name>[\w.:]+)", "E"),
        ("function_definition", r"\bfunction\s*(?=\()", "E"),
        ("variable_declaration", r"^[ \t]*(?P<head>local\s+(?!function\b)(?P<name>\w+))", "="),
        ("assignment_statement", r"^[ \t]*(?P<head>(?!local\b|return\b)(?P<name>[\w.\[\]]+)\s*=(?!=))", "="),
        ("table_constructor", r"\{", "["),
        ("if_statement", r"\bif\b", "E"),
        ("for_in_statement", r"\bfor\s+[\w, ]+\s+in\b", "E"),
        ("for_statement", r"\bfor\s+\w+\s*=", "E"),
        ("while_statement", r"\bwhile\b", "E"),
        ("repeat_statement", r"\brepeat\b", "E"),
    ),
}
# Comments and strings, and words that open and close blocks.
_C_STRINGS = r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'"
_MASKED = {
    "rust": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\bb?r(?P<q>#*)\".*?\"(?P=q)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\[^\n]{1,9}?)'",
    "go": _C_STRINGS + r"|`[^`]*`",
    "kotlin": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'",
    "javascript": _C_STRINGS + r"|`(?:[^`\\]|\\.)*`",
    "typescript": _C_STRINGS + r"|`(?:[^`\\]|\\.)*`",
    "php": _C_STRINGS + r"|\#(?!\[)[^\n]*",
    "shellscript": r"(?:^|(?<=\s))\#[^\n]*|\"(?:[^\"\\]|\\.)*\"|'[^']*'",
    "ruby": r"(?:^|(?<=\s))\#[^\n]*|^=begin.*?^=end|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'",
    "lua": r"--\[(?P<q>=*)\[.*?\](?P=q)\]|--[^\n]*|\[(?P<r>=*)\[.*?\](?P=r)\]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'",
}
_WORDS = {
    "shellscript": (r"(?:^|(?<=[;&|\s]))(?:if|case)\b|\bdo\b", r"(?:^|(?<=[;&|\s]))(?:fi|esac|done)\b"),
    "ruby": (r"(?:^[ \t]*|(?<==)[ \t]*|;[ \t]*)(?:class|module|def|if|unless|case|while|until|for|begin)\b|\bdo\b(?=[ \t]*(?:\||\n|\Z))", r"\bend\b"),
    "lua": (r"\b(?:function|if|do|repeat)\b", r"\b(?:end|until)\b"),
}
_PAIRS = {")": "(", "]": "[", "}": "{"}


@cache
def _compiled(language: str) -> tuple[re.Pattern, tuple[tuple[str, re.Pattern, str], ...], re.Pattern | None]:
    masked = re.compile(_MASKED.get(language, _C_STRINGS), re.S | re.M)
    rules = tuple((t, re.compile(p, re.M), e) for t, p, e in RULES[language])
    words = _WORDS.get(language)
    return masked, rules, re.compile(f"(?P<open>{words[0]})|(?P<close>{words[1]})", re.M) if words else None


class _Outline:
    def __init__(self, content: str, language: str):
        masked, self.rules, words = _compiled(language)
        self.code = masked.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content)
        self.partner: dict[int, int] = {}
        held: list[tuple[str, int]] = []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            if m[0] in "([{":
                held.append((m[0], m.start()))
            elif any(c == _PAIRS[m[0]] for c, _ in held):
                while held[-1][0] != _PAIRS[m[0]]:
                    held.pop()
                self.partner[held.pop()[1]] = m.start()
        self.closed: dict[int, int] = {}  # a word that opens a block, and where the block ends
        open_: list[int] = []
        for m in words.finditer(self.code) if words else ():
            if m["open"] is not None:
                open_.append(m.end())
            elif open_:
                self.closed[open_.pop()] = m.end()
        self.opens = sorted(self.closed)

    def _statement(self, at: int, ends: str) -> int:
        """Where a statement stops: before one of the ends outside of brackets, or a bracket that isn't its own."""
        stop = re.compile(f"[{re.escape(ends)}()\\[\\]{{}}]" if "\n" not in ends else f"[\\n{re.escape(ends)}()\\[\\]{{}}]")
        while m := stop.search(self.code, at):
            if m[0] in "([{":
                if m.start() not in self.partner:
                    return len(self.code)
                at = self.partner[m.start()] + 1
            else:
                return m.start()
        return len(self.code)

    def _end(self, m: re.Match, how: str) -> int | None:
        start, at = m.span("head") if "head" in m.re.groupindex else m.span()
        if how == ".":
            return at
        if how in "[(":
            return self.partner.get(at - 1, len(self.code) - 1) + 1
        if how == "E":
            k = bisect_right(self.opens, start)
            return self.closed[self.opens[k]] if k < len(self.opens) else None
        if how == "=":
            return len(self.code[: self._statement(at, "\n;")].rstrip()) if self._statement(at, "\n;") > at else at
        if how == "W":
            return re.compile(r"\S*").match(self.code, at).end()
        if how == ";":
            stop = self._statement(at, ";")
            line = self._statement(at, "\n;") if not self.code[stop : stop + 1] == ";" else stop
            return stop + 1 if self.code[stop : stop + 1] == ";" and "\n\n" not in self.code[at:stop] else line
        if how == ">":  # an arrow: a block, or an expression
            body = re.compile(r"\s*").match(self.code, at).end()
            return self.partner.get(body, len(self.code) - 1) + 1 if self.code[body : body + 1] == "{" else self._statement(body, ",;\n")
        if how == "X":
            block = re.compile(r"\s*(?:default\s+)?(?:(?:abstract|async|declare|const)\s+)*(?:class|function|interface|enum|namespace)\b").match(self.code, at)
            return self._block(block.end(), False) if block else self._end(m, ";")
        return self._block(start if self.code[at - 1 : at] in ("(", "{", "<") else at, how == "B")

    def _block(self, at: int, line: bool) -> int:
        """The end of the next block, of the semicolon before it, or (line) of the line that has no block."""
        while m := re.compile(r"[({\[;}=\n]" if line else r"[({\[;}]").search(self.code, at):
            c, at = m[0], m.start()
            if c == "{":
                return self.partner.get(at, len(self.code) - 1) + 1
            if c in "([":
                at = self.partner.get(at, len(self.code)) + 1
            elif c == ";":
                return at + 1
            elif c == "}":
                return at
            elif c == "=" and self.code[at - 1 : at + 2] not in ("==", "!=", "<=", ">="):
                return len(self.code[: self._statement(at + 1, "\n")].rstrip())
            elif c == "\n" and not re.compile(r"\s*[{:=.]").match(self.code, at):
                return at
            else:
                at += 1
        return len(self.code)

    def nodes(self) -> list[tuple[str, int | None, int, int, str | None]]:
        found = []
        for rank, (kind, pattern, how) in enumerate(self.rules):
            for m in pattern.finditer(self.code):
                start = m.start("head") if "head" in pattern.groupindex else m.start()
                end = self._end(m, how)
                if end is None or end <= start:
                    continue
                start += len(self.code[start:end]) - len(self.code[start:end].lstrip())
                if kind == "function_item" and self.code[end - 1] == ";":
                    kind_here = "function_signature_item"
                else:
                    kind_here = kind
                name = next((m.span(g) for g in ("name", "name2") if g in pattern.groupindex and m[g]), None)
                found.append((start, -end, rank, kind_here, name))
        found.sort(key=lambda x: x[:3])
        out: list[tuple[str, int | None, int, int, str | None]] = []
        open_: list[tuple[int, int]] = []
        for start, end, _, kind, name in found:
            while open_ and open_[-1][1] < -end:
                open_.pop()
            while open_ and open_[-1][1] <= start:
                open_.pop()
            k = len(out)
            out.append((kind, open_[-1][0] if open_ else None, start, -end, None))
            if name:
                out.append(("identifier", k, *name, "name"))
            open_.append((k, -end))
        return out


def _ordered(nodes: list[tuple[str, int | None, int, int, str | None]]) -> list[tuple[str, int | None, int, int, str | None]]:
    """Nodes in document order, outer ones first."""
    order = sorted(range(len(nodes)), key=lambda k: (nodes[k][2], -nodes[k][3], k))
    place = {k: n for n, k in enumerate(order)}
    return [(nodes[k][0], None if nodes[k][1] is None else place[nodes[k][1]], *nodes[k][2:]) for k in order]


# ----------------------------------------------------------------------------------

LANGUAGES = ("python", "html", *RULES)


def tree(content: str, language: str) -> Tree:
    """The syntax tree of a text."""
    if language == "html":
        return _html(content)
    if language == "python":
        return _python(content)
    return Tree(content, _ordered(_Outline(content, language).nodes()))


def nodes(files: DataFrame, language: str) -> DataFrame:
    """Node rows of files (file, content) of one language; files without content have none."""
    if language not in LANGUAGES:
        raise ValueError(f"no parser for {language}; known: {', '.join(LANGUAGES)}")
    names = [x.split()[0] for x in NODES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                t = tree(content, language) if content else None
                if t and t.types:
                    rows = [(file, k, t.parents[k], kind, *t.place(k), t.text(k), t.roles[k]) for k, kind in enumerate(t.types)]
                    yield pd.DataFrame(rows, columns=names).astype({"parent_id": "Int64"})

    return files.select("file", "content").mapInPandas(run, NODES)
