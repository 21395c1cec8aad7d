"""A project's questions, one method each, over its fact tables.

Facts are DataFrames by name (see `TABLES`); a question about a table that a project
lacks raises KeyError.  Positions are given as file:line[:column], both from 1.
Every answer is a DataFrame; `response` turns a bounded one into a JSON object.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewalk import dims
from lorewalk.functions import symbols as S
from lorewalk.functions import text as X
from lorewalk.operators import ast, batch, diagnostics, edits, graph, search, symbols
from lorewalk.plans.tables import cut
from lorewalk.sources import files, syntax

TABLES = {
    "files": "file, language, size, content",
    "symbols": "sym_id, parent_id, file, name, kind, container, line, column, end_line, end_column, depth, ord, overload_idx, name_path",
    "refs": "target_id, file, line, column, is_declaration, ord",
    "defs": "target_id, file, line, column, ord",
    "type_defs": "target_id, file, line, column, ord",
    "impl_edges": "target_id, file, line, column, ord",
    "call_edges": "caller_id, callee_id, site_file, site_line, site_column, ord",
    "type_edges": "sub_id, super_id, ord",
    "diagnostics": "file, severity, message, code, source, line, column, seq",
    "code_actions": "file, line, column, ord, title, kind, is_preferred, action_id",
    "edits": "action_id, file, start_line, start_char, end_line, end_char, new_text",
    "hovers": "target_id, content, name",
    "signatures": "target_id, ord, label, parameters",
    "inlay_hints": "file, line, character, label, kind",
    "folding_ranges": "file, start_line, end_line, kind",
    "selection_ranges": "file, ord, level, start_line, start_char, end_line, end_char",
    "code_lenses": "file, start_line, title, command",
    "rename_targets": "target_id, placeholder",
    "ast_nodes": "file, node_id, parent_id, node_type, start_line, end_line, start_column, end_column, text",
}


class Unsupported(ValueError):
    """A feature that a language's server lacks; the message says what to do instead."""


class Project:
    def __init__(self, spark: SparkSession, facts: dict[str, DataFrame], root: str = ""):
        unknown = facts.keys() - TABLES.keys()
        if unknown:
            raise ValueError(f"unknown tables: {', '.join(sorted(unknown))}")
        self.spark, self.facts, self.root = spark, facts, root

    def __getitem__(self, name: str) -> DataFrame:
        return self.facts[name]

    def _position(self, location: str) -> tuple[str, int, int]:
        p = self.spark.createDataFrame([(location,)], "t string").select(S.location(F.col("t")).alias("p")).first().p
        if p.error:
            raise ValueError(f"{location!r}: {p.error}")
        return p.file, p.line, p.column

    def _asked(self, location: str, feature: str) -> tuple[str, int, int]:
        """The position of a question, if its file's language answers the feature."""
        file, line, column = self._position(location)
        self._gate(file, feature)
        return file, line, column

    def _gate(self, file: str, feature: str) -> None:
        ext = file.rsplit("/", 1)[-1].rpartition(".")[2].lower()
        language = next((i for i, _, e, *_ in dims.LANGUAGES if ext in e.split()), "unknown")
        if not self.supported(language, feature):
            raise Unsupported(dims.unsupported_message(language, feature))

    def target(self, location: str) -> DataFrame:
        """target_id of the symbol at a position: the one whose name stands there, else the innermost whose lines hold it."""
        at = self.spark.createDataFrame([(0, *self._position(location))], "pos_id int, file string, line int, column int")
        return symbols.at_positions(F.broadcast(at), self["symbols"]).select("target_id")

    def _about(self, table: str, location: str, key: str = "target_id", feature: str | None = None) -> DataFrame:
        if feature:
            self._asked(location, feature)
        target = self.target(location)
        return self[table].join(F.broadcast(target), self[table][key] == target["target_id"], "left_semi")

    def supported(self, language: str, feature: str) -> bool:
        """Whether a feature is answered for a language at all."""
        return dims.support_level(language, feature) != "none"

    # Symbols

    def find_symbols(self, file: str, path: str | None = None, *, body: bool = False, depth: int = 0, limit: int = 0, **filters) -> DataFrame:
        """Symbols of a file; a path without a depth looks ten levels down."""
        depth = symbols.DEEPEST if path is not None and depth == 0 else depth
        out = symbols.find_symbols(self["symbols"].where(F.col("file") == file), path, depth=depth, limit=limit, **filters)
        if body:
            content = self["files"].select("file", "content")
            out = out.join(content, "file").withColumn("body", symbols.body(F.col("content"), F.col("line"), F.coalesce("end_line", "line"))).drop("content")
        return out

    def workspace_symbols(self, query: str, language: str | None = None, *, limit: int = dims.LIMITS["symbols"], **filters) -> DataFrame:
        s = self["symbols"]
        if language is not None:
            s = s.join(self["files"].where(F.col("language") == language).select("file"), "file", "left_semi")
        found = symbols.find_symbols(s, substring=query, **filters)
        return search.first(symbols.distinct_first(found, ["name", "kind", "file", "line", "column"]), limit, "file", "line", "column")

    # Navigation

    def find_references(self, location: str, limit: int = dims.LIMITS["refs"]) -> DataFrame:
        refs = self._about("refs", location)
        return graph.find_references(refs, F.lit(True), root=self.root or None, limit=limit)

    def goto_definition(self, location: str) -> DataFrame:
        return graph.best_definition(self._about("defs", location)).select("file", "line", "column")

    def goto_type_definition(self, location: str) -> DataFrame:
        return graph.first_of(self._about("type_defs", location, feature="goto_type_definition"), "target_id", "file", "line", "column").drop("target_id")

    def find_implementations(self, location: str, limit: int = dims.LIMITS["impl"]) -> DataFrame:
        return graph.find_implementations(self._about("impl_edges", location, feature="find_implementations"), F.lit(True), "file", "line", "column", limit=limit)

    def calls(self, location: str, direction: str, limit: int = dims.LIMITS["calls"]) -> DataFrame:
        """Symbols that call the one at a position (incoming) or that it calls (outgoing), with the first place of each call."""
        own, other = ("callee_id", "caller_id") if direction == "incoming" else ("caller_id", "callee_id")
        first = graph.first_of(self._about("call_edges", location, own, f"{direction}_calls"), other, "site_file", "site_line", "site_column")
        s = self["symbols"].select(F.col("sym_id").alias(other), "name", "kind", "file", "line", "column")
        return search.first(first.join(s, other).drop(other), limit, "file", "line", "column")

    def types(self, location: str, direction: str) -> DataFrame:
        """Supertypes or subtypes of the type at a position, one step away."""
        own, other = ("sub_id", "super_id") if direction == "super" else ("super_id", "sub_id")
        e = self._about("type_edges", location, own, "type_hierarchy").select(F.col(other).alias("sym_id")).distinct()
        return self["symbols"].join(e, "sym_id", "left_semi").select("name", "kind", "file", "line", "column")

    def impact(self, location: str, depth: int = 1) -> DataFrame:
        """Files that refer to a symbol, with counts and places; beyond depth 1 the symbols that reach it through calls."""
        if depth <= 1:
            return graph.impact(self._about("refs", location), F.lit(True))
        e = self["call_edges"].select(F.col("caller_id").alias("caller"), F.col("callee_id").alias("callee"))
        near = graph.reached(e, self.target(location).select(F.col("target_id").alias("node")), depth)
        return near.join(self["symbols"], F.col("node") == F.col("sym_id")).select("name", "kind", "file", "line", "steps")

    # Texts about symbols

    def hover(self, location: str) -> DataFrame:
        return self._about("hovers", location).select("content")

    def signature_help(self, location: str) -> DataFrame:
        return self._about("signatures", location).select("ord", "label", "parameters")

    def inlay_hints(self, file: str, first_line: int, last_line: int) -> DataFrame:
        self._gate(file, "inlay_hints")
        return self["inlay_hints"].where((F.col("file") == file) & F.col("line").between(first_line, last_line))

    def of_file(self, table: str, file: str) -> DataFrame:
        """Folding ranges, selection ranges or lenses of a file."""
        return self[table].where(F.col("file") == file)

    # Search

    def search_text(self, pattern: str, *, kind: str | None = None, path: str | None = None, limit: int = dims.LIMITS["search"], **options) -> DataFrame:
        files = self["files"]
        if kind is not None:
            kind = search.file_type(kind)
            known = [i for i, _, e, _, _ in dims.LANGUAGES if kind in e.split() or i == kind]
            files = files.where(F.col("language").isin(known) | F.element_at(F.split("file", r"\."), -1).isin(kind))
        return search.search_text(files, pattern, under=path, limit=limit, **options)

    def search_ast(self, pattern: str, language: str, limit: int = dims.LIMITS["search"]) -> DataFrame:
        """Matches in a language's files: in the project's nodes if it has some, else by parsing the files."""
        try:
            of = self["files"].where(F.col("language") == language)
            if "ast_nodes" in self.facts:
                return ast.search_ast(self["ast_nodes"].join(of.select("file"), "file", "left_semi"), pattern, limit)
            return ast.search_files(of, pattern, language, limit)
        except ValueError as e:
            raise ValueError(ast.query_error(language, str(e))) from None

    def node_types(self, language: str) -> DataFrame:
        return dims.node_types(self.spark).where(F.col("language") == language).orderBy("ord")

    # Diagnostics and actions

    def diagnostics(self, file: str, severities: str | None = None, source: str | None = None) -> DataFrame:
        d = diagnostics.filtered(self["diagnostics"].where(F.col("file") == file), severities, source)
        return d.withColumn("severity", X.severity_name(F.col("severity")))

    def code_actions(self, location: str, kind: str | None = None) -> DataFrame:
        file, line, column = self._asked(location, "code_actions")
        return diagnostics.numbered_actions(self["code_actions"].where((F.col("file") == file) & (F.col("line") == line)), kind)

    def apply_action(self, location: str, *, index: int = 0, preferred: bool = False, kind: str | None = None) -> DataFrame:
        """file and content after the edits of the chosen action; nothing is written."""
        chosen = diagnostics.selected_action(self.code_actions(location, kind), preferred=preferred, index=index).select("action_id")
        return edits.applied(self["edits"].join(chosen, "action_id", "left_semi").drop("action_id"), self["files"])

    # Edits

    def name_at(self, location: str) -> str | None:
        """The name to rename at a position: what the server says it is, else that of the symbol there, else the one in its hover text."""
        target = F.broadcast(self.target(location))
        s = self["symbols"].select(F.col("sym_id").alias("target_id"), F.col("name").alias("symbol"))
        held = target.join(s, "target_id", "left")
        for table, column in (("rename_targets", "placeholder"), ("hovers", "name")):
            if table in self.facts:
                held = held.join(self[table].select("target_id", F.col(column).alias(table)), "target_id", "left")
        names = [c for c in ("rename_targets", "symbol", "hovers") if c in held.columns]
        got = held.select(F.coalesce(*names).alias("name")).take(1)
        return got[0].name if got else None

    def rename_plan(self, location: str, new: str) -> DataFrame:
        self._asked(location, "rename")
        name = self.name_at(location)
        if not name:
            raise ValueError(f"no symbol at {location}")
        return edits.rename_plan(self._about("refs", location), name, new)

    def _content(self, file: str, content: Column) -> DataFrame:
        f = self["files"].where(F.col("file") == file)
        return f.select("file", F.col("content").alias("old"), content.alias("content"))

    def edit_replace(self, start: str, text: str, end: str | None = None) -> DataFrame:
        """file, old and content with a range replaced; without an end, up to the end of the line."""
        file, line, column = self._position(start)
        last = self._position(end) if end else (file, None, None)
        n = lambda x: F.lit(x).cast("int")
        return self._content(file, edits.replaced(F.col("content"), n(line), n(column), n(last[1]), n(last[2]), F.lit(text)))

    def _symbol(self, file: str, path: str):
        found = symbols.find_by_path(self["symbols"].where(F.col("file") == file), path).collect()
        if not found:
            raise ValueError(f"no symbol {path} in {file}")
        return found[0]

    def edit_insert(self, file: str, path: str, text: str, *, after: bool) -> DataFrame:
        s = self._symbol(file, path)
        return self._content(file, edits.inserted(F.col("content"), F.lit((s.end_line or s.line) if after else s.line), F.lit(text), after=after))

    def edit_symbol(self, file: str, path: str, text: str) -> DataFrame:
        """The content with a symbol's lines replaced."""
        s = self._symbol(file, path)
        return self._content(file, edits.in_symbol(F.col("content"), F.lit(s.line), F.lit(s.end_line).cast("int"), F.lit(text)))

    # Batches and status

    def run_batch(self, lines: DataFrame) -> DataFrame:
        """index, command, success, result (sorted JSON rows) and error of many commands at once: one join per kind of command that is asked, not one job per command."""
        c = cut(batch.gated(batch.parsed(lines), self["files"]))
        s, asked = self["symbols"], c.where("error is null")
        kinds = {r.command for r in asked.select("command").distinct().collect()}
        row = lambda *cols: F.to_json(F.struct(*cols)).alias("result")
        of = lambda command: asked.where(F.col("command") == command)
        found = symbols.at_positions(asked.where("line is not null").select(F.col("index").alias("pos_id"), "file", "line", "column"), s)
        at = cut(asked.select("index", "command", "new_name").join(found, F.col("index") == F.col("pos_id")))
        place = [F.col("file"), F.col("line"), F.col("column")]
        answers: dict[str, DataFrame | None] = {"find_symbol": of("find_symbol").select("index", "file").join(s.where("depth = 0"), "file").select("index", row("name", "kind", *place))}

        def about(command: str, rows: DataFrame, *columns: Column | str, key: str = "target_id") -> None:
            answers[command] = at.where(F.col("command") == command).join(rows, F.col("target_id") == F.col(key)).select("index", row(*columns))

        if "refs" in self.facts:
            refs = self["refs"].where(S.own(F.col("file"), self.root)) if self.root else self["refs"]
            about("find_refs", refs.withColumnRenamed("target_id", "of"), *place, key="of")
            per = refs.groupBy(F.col("target_id").alias("of"), "file").agg(F.count(F.lit(1)).alias("edit_count"))
            about("rename", per, "file", "edit_count", key="of")
        for command, table, best in (("find_def", "defs", graph.best_definition), ("find_typedef", "type_defs", None), ("find_impl", "impl_edges", lambda x: x)):
            if table in self.facts:
                rows = best(self[table]) if best else graph.first_of(self[table], "target_id", "file", "line", "column")
                about(command, rows.withColumnRenamed("target_id", "of"), *place, key="of")
        if "hovers" in self.facts:
            about("hover", self["hovers"].withColumnRenamed("target_id", "of"), "content", key="of")
        if "call_edges" in self.facts:
            for direction, own, other in (("calls_incoming", "callee_id", "caller_id"), ("calls_outgoing", "caller_id", "callee_id")):
                ends = self["call_edges"].select(F.col(own).alias("of"), F.col(other).alias("sym_id")).distinct()
                about(direction, ends.join(s.select("sym_id", "name", *place), "sym_id"), "name", *place, key="of")
        if "diagnostics" in self.facts:
            d = self["diagnostics"].select("file", "severity", "message", "line", "column").withColumn("severity", X.severity_name(F.col("severity")))
            answers["diagnostics"] = of("diagnostics").select("index", "file").join(d, "file").select("index", row("message", "severity", "line", "column"))
        # What no line asks for is known, but not looked for.
        return batch.answered(c, {k: a if k in kinds else None for k, a in answers.items()})

    def status(self) -> DataFrame:
        """Files and bytes of each language."""
        return self["files"].groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))

    def doctor(self, installed: DataFrame, *, missing_only: bool = False) -> DataFrame:
        """Servers of all languages with whether their command is among the installed ones (command), and the features that they lack."""
        lacking = dims.capabilities(self.spark).where("level = 'none'").groupBy("language").agg(F.sort_array(F.collect_list("feature")).alias("limited"))
        s = dims.servers(self.spark).join(installed.select("command", F.lit(True).alias("installed")).distinct(), "command", "left").join(lacking, "language", "left")
        out = s.select("language", "server", "command", "tier", F.coalesce("installed", F.lit(False)).alias("installed"), "install", "limited")
        return (out.where("not installed") if missing_only else out).orderBy("language")

    def entries(self) -> DataFrame:
        """What shows a server the project, for each of its languages: a manifest in the root, else the first source file."""
        return files.project_entries(self["files"])


def counted(doctor: DataFrame) -> DataFrame:
    """How many of doctor's servers are installed and missing."""
    return doctor.agg(F.count_if("installed").alias("installed"), F.count_if(~F.col("installed")).alias("missing"))


def register(spark: SparkSession) -> None:
    """Gives SQL the table function ast_query(content, pattern, language): a row for each match."""

    @F.udtf(returnType="start_line int, end_line int, start_column int, end_column int, text string, captures array<struct<name: string, text: string>>")
    class AstQuery:
        def eval(self, content: str, pattern: str, language: str) -> Iterator[tuple]:
            if content:
                query = ast.parse(ast.normalized(pattern))
                for r in ast.found("", syntax.tree(content, language), query):
                    yield r[1:]

    spark.udtf.register("ast_query", AstQuery)


def response(rows: DataFrame, name: str = "rows", most: int = 1000) -> str:
    """A JSON object of up to `most` rows: success, count and the rows themselves, without nulls."""
    held = [json.loads(x) for x in rows.toJSON().take(most)]
    return json.dumps({"success": True, "count": len(held), name: held}, ensure_ascii=False, indent=2)
