"""Language-server messages, dumped as JSON, read into fact tables.

Wire positions count from 0, in UTF-16 units; facts count lines and columns from 1,
except where a table keeps wire positions (edits, hints, folding and selection
ranges).  Columns of facts are UTF-16 units too until `in_code_points` turns them into
code points, which needs the lines' text.  A result
may have several shapes; each is tried with its own schema.  Only what is nested to any depth
needs Python, symbol trees and chains of selection ranges, as neither has a Spark type.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorewalk import dims
from lorewalk.functions import symbols as S
from lorewalk.functions import text as X

_POSITION = "struct<line: int, character: int>"
_RANGE = f"struct<start: {_POSITION}, end: {_POSITION}>"
_LOCATION = f"struct<uri: string, range: {_RANGE}, targetUri: string, targetSelectionRange: {_RANGE}>"
SYMBOLS = "file string, sym_id long, parent_id long, name string, kind string, container string, line int, column int, end_line int, end_column int, depth int, ord int"


def frames(raw: bytes) -> list[str]:
    """The bodies of messages with Content-Length headers; an unfinished last one goes."""
    out, at = [], 0
    while (head := raw.find(b"\r\n\r\n", at)) >= 0:
        sizes = [line.split(b":", 1)[1] for line in raw[at:head].split(b"\r\n") if line.lower().startswith(b"content-length:")]
        if not sizes or head + 4 + int(sizes[0]) > len(raw):
            break
        at = head + 4 + int(sizes[0])
        out.append(raw[head + 4 : at].decode(errors="replace"))
    return out


def _kind(n) -> str:
    return dims.KINDS[n - 1] if isinstance(n, int) and 1 <= n <= len(dims.KINDS) else "variable"


def _flattened(file: str, result: str) -> list[tuple]:
    """Pre-order rows of a symbol tree or list; of a file without symbols a row for itself."""
    try:
        tops = json.loads(result or "null")
    except ValueError:
        tops = None
    out: list[tuple] = []
    todo = [(x, None, None, 0) for x in reversed(tops if isinstance(tops, list) else [])]
    while todo:
        x, parent, container, depth = todo.pop()
        if not isinstance(x, dict) or "name" not in x:
            continue
        whole = x.get("range") or (x.get("location") or {}).get("range")
        if not whole:
            continue
        start = (x.get("selectionRange") or whole)["start"]
        k = len(out)
        container = container or x.get("containerName") or None
        out.append((file, k, parent, x["name"].strip(), _kind(x.get("kind")), container, start["line"] + 1, start["character"] + 1, whole["end"]["line"] + 1, whole["end"]["character"] + 1, depth, k))
        todo += [(y, k, x["name"], depth + 1) for y in reversed(x.get("children") or [])]
    return out or [(file, 0, None, file.rsplit("/", 1)[-1], "file", None, 1, 1, None, None, 0, 0)]


def symbols(results: DataFrame) -> DataFrame:
    """Symbols of (file, result) rows; ids and order count in a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for f, x in zip(batch["file"], batch["result"], strict=True) for r in _flattened(f, x)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOLS.split(", ")])
            yield out.astype({"parent_id": "Int64", "end_line": "Int32", "end_column": "Int32"})

    flat = results.select("file", "result").mapInPandas(run, SYMBOLS)
    return flat.withColumn("name", S.normalized(F.col("name"), F.col("file"), F.col("kind")))


def _each(json_text: Column, one: str) -> Column:
    """A list of the one or many things of a result, empty for null."""
    t = F.trim(json_text)
    many = F.from_json(t, f"array<{one}>")
    single = F.from_json(t, one)
    return F.when(t.startswith("["), many).when(t.startswith("{"), F.array(single))


def locations(results: DataFrame, key: str = "target_id") -> DataFrame:
    """key, file, line, column, end_line, end_column and ord of locations and links, alone or in lists."""
    each = results.select(key, F.posexplode(_each(F.col("result"), _LOCATION)).alias("ord", "x"))
    uri, at = F.coalesce("x.uri", "x.targetUri"), F.coalesce("x.range", "x.targetSelectionRange")
    one = lambda c: (F.coalesce(c, F.lit(0)) + 1).cast("int")
    return each.where(uri.isNotNull()).select(
        key, S.uri_to_path(uri).alias("file"), one(at["start"]["line"]).alias("line"), one(at["start"]["character"]).alias("column"), one(at["end"]["line"]).alias("end_line"), one(at["end"]["character"]).alias("end_column"), "ord"
    )


def in_code_points(rows: DataFrame, files: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """rows with columns (line, column: both from 1) in code points in place of UTF-16 units; files: file, content."""
    held = rows.join(files.select("file", F.split("content", "\n").alias("lines__")), "file", "left")
    for line, column in columns or (("line", "column"),):
        text = F.try_element_at("lines__", F.greatest(F.col(line), F.lit(1)))
        held = held.withColumn(column, F.when(text.isNull(), F.col(column)).otherwise(X.code_points(text, F.col(column) - 1) + 1).cast("int"))
    return held.select(*rows.columns)


_EDIT = f"array<struct<range: {_RANGE}, newText: string>>"
_EDITS = f"struct<changes: map<string, {_EDIT}>, documentChanges: array<struct<textDocument: struct<uri: string>, edits: {_EDIT}>>>"


def file_changes(results: DataFrame, key: str = "action_id") -> DataFrame:
    """key, file and edit_count: of changes if there are any, else of documentChanges; files without edits count 0."""
    held = results.select(key, F.from_json("result", _EDITS).alias("r"))
    by_uri = F.transform(F.map_entries("r.changes"), lambda e: F.struct(e["key"].alias("uri"), F.size(e["value"]).alias("n")))
    listed = F.transform(F.filter("r.documentChanges", lambda d: d["textDocument"]["uri"].isNotNull() & d["edits"].isNotNull()), lambda d: F.struct(d["textDocument"]["uri"].alias("uri"), F.size(d["edits"]).alias("n")))
    return held.select(key, F.explode(F.coalesce(by_uri, listed)).alias("c")).select(key, S.uri_to_path(F.col("c.uri")).alias("file"), F.col("c.n").cast("long").alias("edit_count"))


def workspace_edits(results: DataFrame, key: str = "action_id") -> DataFrame:
    """key, file and edits, from changes and from documentChanges together."""
    held = results.select(key, F.from_json("result", _EDITS).alias("r"))
    changes = held.select(key, F.explode("r.changes").alias("uri", "edits"))
    documents = held.select(key, F.explode("r.documentChanges").alias("d")).select(key, F.col("d.textDocument.uri").alias("uri"), F.col("d.edits").alias("edits"))
    each = changes.unionByName(documents).select(key, "uri", F.explode("edits").alias("e"))
    at = F.col("e.range")
    return each.select(
        key, S.uri_to_path(F.col("uri")).alias("file"), at["start"]["line"].alias("start_line"), at["start"]["character"].alias("start_char"), at["end"]["line"].alias("end_line"), at["end"]["character"].alias("end_char"), F.coalesce("e.newText", F.lit("")).alias("new_text")
    )


def signatures(results: DataFrame, key: str = "target_id") -> DataFrame:
    """key, label, parameters (their texts), active_signature and active_parameter; a row for each signature."""
    shape = "struct<signatures: array<struct<label: string, parameters: array<struct<label: string>>>>, activeSignature: int, activeParameter: int>"
    held = results.select(key, F.from_json("result", shape).alias("r"))
    each = held.select(key, F.posexplode("r.signatures").alias("ord", "s"), F.col("r.activeSignature").alias("active_signature"), F.col("r.activeParameter").alias("active_parameter"))

    def text(p: Column) -> Column:  # [start, end) of the signature's label, or a text
        pair = F.from_json(p["label"], "array<int>")
        begin, end = (X.code_points(F.col("s.label"), pair[k]) for k in (0, 1))
        inside = F.substring(F.col("s.label"), begin + 1, end - begin)
        return F.when(p["label"].rlike(r"^\[\d+,\d+\]$"), inside).otherwise(p["label"])

    return each.select(key, "ord", F.col("s.label").alias("label"), F.transform(F.coalesce("s.parameters", F.array().cast("array<struct<label:string>>")), text).alias("parameters"), "active_signature", "active_parameter")


def publications(published: DataFrame) -> DataFrame:
    """seq, file and diagnostics (an array, maybe empty) of publishDiagnostics notifications (seq, params); without a severity they are errors."""
    related = f"array<struct<location: struct<uri: string, range: {_RANGE}>, message: string>>"
    shape = f"struct<uri: string, diagnostics: array<struct<range: {_RANGE}, severity: int, message: string, code: string, source: string, tags: array<int>, relatedInformation: {related}>>>"

    def one(d: Column) -> Column:
        at, severity = d["range"], F.coalesce(d["severity"], F.lit(1))
        tags = F.filter(F.transform(F.coalesce(d["tags"], F.array().cast("array<int>")), X.tag_name), lambda t: t.isNotNull())
        about = F.transform(F.coalesce(d["relatedInformation"], F.array().cast(related)), lambda r: F.struct(S.uri_to_path(r["location"]["uri"]).alias("file"), r["message"].alias("message")))
        return F.struct(
            F.when(severity.between(1, 3), severity).otherwise(4).alias("severity"), d["message"].alias("message"), d["code"].alias("code"), d["source"].alias("source"), tags.alias("tags"),
            (at["start"]["line"] + 1).alias("line"), (at["start"]["character"] + 1).alias("column"), (at["end"]["line"] + 1).alias("end_line"), (at["end"]["character"] + 1).alias("end_column"),
            about.alias("related"),
        )

    p = published.select("seq", F.from_json("params", shape).alias("p")).where("p.uri is not null and p.diagnostics is not null")
    return p.select("seq", S.uri_to_path(F.col("p.uri")).alias("file"), F.transform("p.diagnostics", one).alias("diagnostics"))


def diagnostics(published: DataFrame) -> DataFrame:
    """A row for each diagnostic of publishDiagnostics notifications (seq, params), and one without a message for an empty publication."""
    return publications(published).select("seq", "file", F.explode_outer("diagnostics").alias("d")).select("seq", "file", "d.*")


def code_actions(results: DataFrame) -> DataFrame:
    """file, ord, title, kind, is_preferred and data (the raw item); items without a title go."""
    each = results.select("file", F.posexplode(F.from_json("result", "array<string>")).alias("ord", "data"))
    get = lambda p: F.get_json_object("data", p)
    out = each.select("file", "ord", get("$.title").alias("title"), X.action_kind(get("$.kind")).alias("kind"), F.coalesce(get("$.isPreferred") == "true", F.lit(False)).alias("is_preferred"), "data")
    return out.where("title is not null")


def inlay_hints(results: DataFrame) -> DataFrame:
    """file, line, character, label (parts joined), kind and padding; positions as on the wire."""
    each = results.select("file", F.posexplode(F.from_json("result", f"array<struct<position: {_POSITION}, label: string, kind: int, paddingLeft: boolean, paddingRight: boolean>>")).alias("ord", "h"))
    parts = F.from_json("h.label", "array<struct<value: string>>")
    label = F.when(F.col("h.label").startswith("[{"), F.array_join(F.transform(parts, lambda p: p["value"]), "")).otherwise(F.col("h.label"))
    return each.select("file", F.col("h.position.line").alias("line"), F.col("h.position.character").alias("character"), label.alias("label"), X.inlay_kind(F.col("h.kind")).alias("kind"), F.coalesce("h.paddingLeft", F.lit(False)).alias("padding_left"), F.coalesce("h.paddingRight", F.lit(False)).alias("padding_right"))


def folding_ranges(results: DataFrame) -> DataFrame:
    each = results.select("file", F.explode(F.from_json("result", "array<struct<startLine: int, endLine: int, startCharacter: int, endCharacter: int, kind: string, collapsedText: string>>")).alias("f"))
    return each.select("file", F.col("f.startLine").alias("start_line"), F.col("f.endLine").alias("end_line"), F.col("f.startCharacter").alias("start_char"), F.col("f.endCharacter").alias("end_char"), X.folding_kind(F.col("f.kind")).alias("kind"), F.col("f.collapsedText").alias("collapsed_text"))


#: Levels of selection ranges in one batch.
_AT_ONCE = 1 << 14
_LEVELS = "ord int, level int, start_line int, start_char int, end_line int, end_char int"


def _int(x: object) -> int | None:
    return x if type(x) is int and -(1 << 31) <= x < 1 << 31 else None


def _chain(x: object) -> Iterator[tuple[int | None, ...]]:
    """A selection range and those round it, from the innermost: start line and character, end line and character."""
    while True:
        held = x if isinstance(x, dict) else {}
        whole = held.get("range") if isinstance(held.get("range"), dict) else {}
        ends = [whole.get(e) if isinstance(whole.get(e), dict) else {} for e in ("start", "end")]
        yield tuple(_int(e.get(k)) for e in ends for k in ("line", "character"))
        x = held.get("parent")
        if x is None:
            return


def _chains(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = json.JSONDecoder().raw_decode
    names = ["file", *(x.split()[0] for x in _LEVELS.split(", "))]
    types = [kind, *[pa.int32()] * 6]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for batch in batches:
        out: list[tuple] = []
        for file, text in zip(batch.column("file").to_pylist(), batch.column("result").to_pylist(), strict=True):
            try:
                held = read(text.lstrip())[0] if text else None
            except (ValueError, RecursionError):  # no JSON, or deeper than it is read
                continue
            for k, x in enumerate(held if isinstance(held, list) else []):
                for level, ends in enumerate(_chain(x)):
                    out.append((file, k, level, *ends))
                    if len(out) >= _AT_ONCE:
                        yield made(out)
                        out = []
        if out:
            yield made(out)


def selection_ranges(results: DataFrame) -> DataFrame:
    """file, ord (of the position), level (from the innermost) and range, up to the outermost one.

    An answer is read once, however many ranges lie round each other.
    """
    given = results.select("file", F.col("result").cast("string").alias("result"))
    kind = to_arrow_type(given.schema["file"].dataType)
    return given.mapInArrow(lambda batches: _chains(kind, batches), f"file {given.schema['file'].dataType.simpleString()}, {_LEVELS}")


def code_lenses(results: DataFrame) -> DataFrame:
    """file, start_line, title, command and data of lenses; null where a lens has no command yet."""
    shape = f"array<struct<range: {_RANGE}, command: struct<title: string, command: string, arguments: string>, data: string>>"
    each = results.select("file", F.explode(F.from_json("result", shape)).alias("c"))
    return each.select("file", F.col("c.range.start.line").alias("start_line"), F.col("c.command.title").alias("title"), F.col("c.command.command").alias("command"), F.col("c.command.arguments").alias("arguments"), F.col("c.data").alias("data"))


def hierarchy(results: DataFrame, key: str = "target_id") -> DataFrame:
    """key, ord, name, kind, file, line, column, detail and call_site of call- and type-hierarchy answers.

    Call answers wrap the item in from or to and carry the ranges of calls; the
    first one is the call's place.
    """
    item = f"struct<name: string, kind: int, detail: string, uri: string, range: {_RANGE}, selectionRange: {_RANGE}>"
    shape = f"array<struct<name: string, kind: int, detail: string, uri: string, range: {_RANGE}, selectionRange: {_RANGE}, from: {item}, to: {item}, fromRanges: array<{_RANGE}>>>"
    each = results.select(key, F.posexplode(F.from_json("result", shape)).alias("ord", "x"))
    own = F.when(F.col("x.name").isNotNull(), F.struct("x.name", "x.kind", "x.detail", "x.uri", "x.range", "x.selectionRange").cast(item))
    each = each.select(key, "ord", F.coalesce("x.from", "x.to", own).alias("i"), F.get("x.fromRanges", 0).alias("site")).where("i.name is not null")
    kinds = F.array(*[F.lit(k) for k in dims.KINDS])
    kind = F.when(F.col("i.kind").between(1, len(dims.KINDS)), F.try_element_at(kinds, F.col("i.kind"))).otherwise("variable")
    at = F.coalesce("i.selectionRange", "i.range")
    site = F.when(F.col("site").isNotNull(), F.struct((F.col("site.start.line") + 1).alias("line"), (F.col("site.start.character") + 1).alias("column")))
    return each.select(key, "ord", "i.name", kind.alias("kind"), S.uri_to_path(F.col("i.uri")).alias("file"), (at["start"]["line"] + 1).alias("line"), (at["start"]["character"] + 1).alias("column"), "i.detail", site.alias("call_site"))


def hovers(results: DataFrame, key: str = "target_id") -> DataFrame:
    """key, content and name of hover answers."""
    contents = F.to_json(F.try_variant_get(F.try_parse_json(F.col("result")), "$.contents", "variant"))
    held = results.select(key, X.hover_content(contents).alias("content"))
    return held.where("content is not null").withColumn("name", X.hover_name(F.col("content")))


def rename_targets(results: DataFrame, files: DataFrame) -> DataFrame:
    """target_id and placeholder of prepareRename answers (target_id, file, result): a placeholder, a range of the file's text, or the default (empty)."""
    at = F.coalesce(F.from_json(F.get_json_object("result", "$.range"), _RANGE), F.from_json("result", _RANGE))
    held = results.withColumn("at", at).join(files.select("file", "content"), "file", "left")
    line = F.get(F.split("content", "\r?\n"), F.col("at.start.line"))
    begin, end = (X.code_points(line, F.col(f"at.{side}.character")) for side in ("start", "end"))
    placeholder = F.coalesce(F.get_json_object("result", "$.placeholder"), F.when(F.get_json_object("result", "$.defaultBehavior") == "true", "").otherwise(F.nullif(F.substring(line, begin + 1, end - begin), F.lit(""))))
    return held.select("target_id", placeholder.alias("placeholder")).where("placeholder is not null")
