"""Operators on small tables, and streams against their batch forms."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lorewalk.functions import symbols as S
from lorewalk.functions import text as X
from lorewalk.operators import batch, diagnostics, edits, graph, search, symbols
from lorewalk.sources import files, ignore, rpc, wire
from lorewalk.streaming import folds


def tree(spark, rows):
    """rows: sym_id, parent_id, name, kind, depth; ord is sym_id."""
    df = spark.createDataFrame(rows, "sym_id long, parent_id long, name string, kind string, depth int").withColumn("ord", F.col("sym_id"))
    return symbols.with_paths(df, 2)


@pytest.fixture(scope="module")
def my_class(spark):
    rows = [(1, None, "MyClass", "class", 0), (2, 1, "update", "method", 1), (3, 1, "reset", "method", 1), (4, 1, "count", "variable", 1)]
    return tree(spark, rows).cache()


def names(df):
    return sorted(r.name for r in df.collect())


def test_paths_and_filters(my_class):
    assert sorted(r.name_path for r in my_class.collect()) == ["MyClass", "MyClass/count", "MyClass/reset", "MyClass/update"]
    assert names(symbols.find_symbols(my_class, "MyClass/update")) == ["update"]
    assert names(symbols.find_symbols(my_class, "*/reset")) == ["reset"]
    assert len(names(symbols.find_symbols(my_class, "MyClass/*"))) == 3
    assert names(symbols.find_symbols(my_class, include="method")) == ["reset", "update"]
    assert names(symbols.find_symbols(my_class, exclude="class")) == ["count", "reset", "update"]
    assert names(symbols.find_symbols(my_class, structural=True)) == ["MyClass", "reset", "update"]
    assert names(symbols.find_symbols(my_class, depth=0)) == ["MyClass"]
    assert names(symbols.find_symbols(my_class, substring="UP")) == ["update"]
    assert names(symbols.find_symbols(my_class, limit=2)) == ["MyClass", "update"] and len(names(symbols.find_symbols(my_class, limit=0))) == 4
    assert symbols.find_by_path(my_class, "MyClass/count").count() == 1


def test_overloads(spark):
    rows = [(1, None, "MyClass", "class", 0), (2, 1, "doSomething", "method", 1), (3, 1, "unique", "method", 1), (4, 1, "doSomething", "method", 1), (5, 1, "doSomething", "method", 1), (6, 4, "inner", "method", 2)]
    got = {r.sym_id: (r.overload_idx, r.name_path) for r in tree(spark, rows).collect()}
    assert got[2] == (0, "MyClass/doSomething[0]") and got[4] == (1, "MyClass/doSomething[1]") and got[5][0] == 2 and got[3] == (None, "MyClass/unique")
    assert got[6][1] == "MyClass/doSomething/inner"  # a parent's index is not part of its children's paths


def test_kind_lists():
    assert symbols.parse_kinds("Trait, method,, enummember") == ["interface", "method", "enum_member"]
    with pytest.raises(ValueError):
        symbols.parse_kinds("string")


def test_nesting_and_bodies(spark, my_class):
    r = symbols.nested(my_class, 1).first()
    assert [c.name for c in r.children] == ["update", "reset", "count"]
    df = spark.createDataFrame([("a\nb\r\nc",)], "c string")
    body = lambda a, b: df.select(symbols.body(F.col("c"), F.lit(a), F.lit(b)).alias("b")).first().b
    assert body(2, 3) == "b\nc" and body(3, 9) == "c" and body(4, 5) is None


def test_enclosing_and_innermost(spark):
    rows = [("f", 1, 10, 1, "A", 1, None, 0), ("f", 2, 5, 2, "m", 2, 1, 1), ("f", 4, 9, 3, "n", 3, 1, 1), ("f", 12, None, 4, "B", 4, None, 0)]
    s = spark.createDataFrame(rows, "file string, line int, end_line int, ord int, name string, sym_id long, parent_id long, depth int")
    p = spark.createDataFrame([(1, "f", 4), (2, "f", 8), (3, "f", 99), (4, "f", 11)], "pos_id int, file string, line int")
    assert {r.pos_id: r.name for r in symbols.enclosing(p, s.where("depth = 0")).collect()} == {1: "A", 2: "A", 3: "B"}
    # where siblings overlap the first one that holds the line is taken
    assert {r.pos_id: r.name for r in symbols.innermost(p, s).collect()} == {1: "m", 2: "n", 3: "B"}


def _crowded(spark, n):
    """A file of n symbols of one line each and as many positions: pairs of every two of them would never end."""
    s = spark.range(n).selectExpr("'f' as file", "cast(id as int) as line", "cast(id as int) as end_line", "id as ord", "concat('s', id) as name", "id as sym_id", "cast(null as long) as parent_id", "0 as depth", "5 as column")
    return spark.range(n).selectExpr("id as pos_id", "'f' as file", "cast(id as int) as line", "cast(if(id % 2 = 0, 6, 1) as int) as column"), s


def _spans(spark):
    """Positions and symbols of three levels, some without an end or a place, and who holds whom."""
    rng = random.Random(5)
    symbols_ = [(f"f{rng.randrange(2)}", a := rng.choice([None, *range(-3, 40)]), None if a is None or rng.random() < 0.2 else a + rng.randrange(-1, 30), k, f"s{k}", k, rng.randrange(20) if k >= 20 else None, min(k // 20, 2), rng.randrange(9)) for k in range(60)]
    positions = [(k, f"f{rng.randrange(3)}", rng.choice([None, *range(-5, 60)]), rng.randrange(12)) for k in range(120)]
    s = spark.createDataFrame(symbols_, "file string, line int, end_line int, ord int, name string, sym_id long, parent_id long, depth int, column int")
    holds = lambda p, x: None not in (p[2], x[1]) and p[1] == x[0] and x[1] <= p[2] and (x[2] is None or p[2] <= x[2])
    return spark.createDataFrame(positions, "pos_id int, file string, line int, column int"), s, positions, symbols_, holds


def test_enclosing_in_crowded_files(spark):
    p, s, positions, all_, holds = _spans(spark)
    want = {q[0]: x[0][4] for q in positions if (x := [x for x in all_ if holds(q, x)])}
    assert {r.pos_id: r.name for r in symbols.enclosing(p, s).collect()} == want
    p, s = _crowded(spark, 200_000)
    began = time.time()
    assert symbols.enclosing(p, s).where("name = concat('s', pos_id)").count() == 200_000
    assert time.time() - began < 60


def test_innermost_in_crowded_files(spark):
    p, s, positions, all_, holds = _spans(spark)
    want = {}
    for q in positions:
        at = None
        for depth in range(3):
            below = [x for x in all_ if holds(q, x) and x[7] == depth and (depth == 0 or x[6] == at)]
            if not below:
                break
            at, want[q[0]] = below[0][5], below[0][4]
    assert {r.pos_id: r.name for r in symbols.innermost(p, s).collect()} == want
    assert symbols.innermost(p, s.limit(0)).count() == symbols.innermost(p.limit(0), s).count() == 0
    p, s = _crowded(spark, 200_000)
    began = time.time()
    assert symbols.innermost(p, s).where("name = concat('s', pos_id)").count() == 200_000
    assert time.time() - began < 60


def test_targets_in_crowded_files(spark):
    p, s, positions, all_, holds = _spans(spark)
    named = lambda q, x: (q[1], q[2]) == (x[0], x[1]) and x[8] <= q[3] <= x[8] + len(x[4])
    want = {}
    for q in positions:
        found = sorted((not named(q, x), -x[7], x[3], x[5]) for x in all_ if x[1] is not None and (named(q, x) or holds(q, x)))
        if found:
            want[q[0]] = found[0][3]
    assert {r.pos_id: r.target_id for r in symbols.at_positions(p, s).collect()} == want
    p, s = _crowded(spark, 200_000)
    began = time.time()
    assert symbols.at_positions(p, s).where("target_id = pos_id").count() == 200_000
    assert time.time() - began < 60


def test_search(spark):
    f = spark.createDataFrame([("a", "python", "é the cat\r\nThe end \n\nlast"), ("b", "rust", "bathe\n"), ("c", "rust", "")], "file string, language string, content string")
    assert [(r.file, r.line, r.text) for r in search.lines(f).orderBy("file", "line").collect()] == [("a", 1, "é the cat"), ("a", 2, "The end "), ("a", 3, ""), ("a", 4, "last"), ("b", 1, "bathe")]
    rows = search.search_text(f, "the", ignore_case=True, word=True).orderBy("line").collect()
    assert [(r.line, r.column, r.text, r.match) for r in rows] == [(1, 4, "é the cat", "the"), (2, 1, "The end", "The")]
    assert search.search_text(f, "the", language="rust").count() == 1 and search.search_text(f, "e", limit=1).count() == 1
    around = search.search_with_context(f, "The", 1).first()
    assert around.context_before == ["é the cat\r"] and around.context_after == [""]
    assert search.pattern(r"a\\1 \(?=") == r"a\\1 \(?="
    for bad in ("  ", "(?=x)", r"(a)\1", r"\\\1"):
        with pytest.raises(ValueError):
            search.pattern(bad)
    assert search.file_type("TSX") == "ts"
    with pytest.raises(ValueError):
        search.file_type("cobol")


def test_phrases_of_any_length(spark):
    f = spark.createDataFrame([("x", "one two three\nfour five six"), ("y", "two three"), ("z", None)], "file string, content string")
    p = spark.createDataFrame([(1, "two three"), (2, "three four five six"), (3, "one two three four five six"), (4, " "), (5, None), (6, "two"), (7, "three")], "item_id long, text string")
    want = [("x", 1), ("x", 2), ("x", 3), ("x", 6), ("x", 7), ("y", 1), ("y", 6), ("y", 7)]
    assert sorted((r.file, r.item_id) for r in search.search_many(f, p).collect()) == want
    assert sorted((r.file, r.item_id) for r in search.search_many(f, p, most=2).collect()) == want


def test_deep_trees(spark):
    rows = [(i, i - 1 if i else None, f"n{i}", "class", i) for i in range(14)]
    df = spark.createDataFrame(rows, "sym_id long, parent_id long, name string, kind string, depth int").withColumn("ord", F.col("sym_id"))
    got = {r.sym_id: r.name_path for r in symbols.with_paths(df).collect()}
    assert len(got) == 14 and got[13] == "/".join(f"n{i}" for i in range(14))
    s = df.withColumns({"file": F.lit("f"), "line": F.lit(1), "end_line": F.lit(9)})
    assert symbols.innermost(spark.createDataFrame([(1, "f", 5)], "pos_id int, file string, line int"), s).first().name == "n13"


def test_ignore_rules(spark):
    paths = ["main.rs", "debug.log", "target/app", "a/keep.txt", "a/x.txt", "node_modules/x.js", ".hidden/y", "main.test.rs", "b/c/d.md", "deep/b/c/d.md"]
    rules = ignore.compile_rules("# note\n*.txt\n!keep.txt\n*.test.rs\n/b/**/d.md\n")
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    left = [r.p for r in df.where(~ignore.ignored(F.col("p"), rules)).collect()]
    assert left == ["main.rs", "a/keep.txt", "deep/b/c/d.md"]


def test_reading_a_directory(spark, tmp_path):
    for name, content in {"src/a.rs": b"fn a() {}\n", "src/b.py": "é = 1".encode(), "node_modules/x.js": b"x", "bin.dat": b"\0\1", "bad.txt": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.file: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.rs", "src/b.py", "bin.dat", "bad.txt"}
    assert got["src/a.rs"].language == "rust" and got["src/b.py"].content == "é = 1" and got["bin.dat"].error == "binary" and got["bad.txt"].error == "not UTF-8"
    assert sorted(r.language for r in files.project_languages(files.read_files(spark, str(tmp_path))).collect()) == ["python", "rust"]
    assert {r.error for r in files.read_files(spark, str(tmp_path), most=3).collect()} >= {"too large"}
    assert [r.file for r in files.read_files(spark, str(tmp_path), extensions=["rs"]).collect()] == ["src/a.rs"]
    for name, content in {".gitignore": "*.tmp\ndrop/\n", "a.tmp": "x", "drop/deep/x.rs": "x", "sub/.gitignore": "!keep.tmp\nno.rs\n", "sub/keep.tmp": "x", "sub/no.rs": "x", "no.rs": "x", ".lorewalk/ignore": "bad.txt\n", "Cargo.toml": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    read = files.read_files(spark, str(tmp_path))
    assert sorted(r.file for r in read.collect()) == ["Cargo.toml", "bin.dat", "no.rs", "src/a.rs", "src/b.py", "sub/keep.tmp"]
    assert {r.language: r.file for r in files.project_entries(read).collect()} == {"rust": "Cargo.toml", "python": "src/b.py", "toml": "Cargo.toml"}
    assert files.read_files(spark, str(tmp_path), extensions=["none"]).count() == 0


def test_graph(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "a")], "caller string, callee string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.steps) for r in graph.reached(e, start, 1).collect()} == {("b", 1), ("d", 1)}
    assert {(r.node, r.steps) for r in graph.reached(e, start, 9).collect()} == {("b", 1), ("d", 1), ("c", 2)}
    assert {r.caller for r in graph.calls(e, F.col("callee") == "a", "incoming").collect()} == {"b", "d"}
    d = spark.createDataFrame([(1, "node_modules/x.ts", 1), (1, "src/x.d.ts", 2), (1, "src/x.ts", 3), (2, "src/y.d.ts", 4)], "target_id int, file string, ord int")
    assert {r.target_id: r.file for r in graph.best_definition(d).collect()} == {1: "src/x.ts", 2: "src/y.d.ts"}
    r = spark.createDataFrame([(1, "f", 3, 1), (1, "f", 1, 2), (1, "g", 1, 1)], "target_id int, file string, line int, column int")
    assert {x.file: (x["count"], [p.line for p in x.locations]) for x in graph.impact(r, F.col("target_id") == 1).collect()} == {"f": (2, [1, 3]), "g": (1, [1])}


def test_diagnostics(spark):
    rows = [("f", 1, "a", "lint", 1), ("f", 2, "b", "lint", 2), ("g", None, "c", "tsc", 3), ("f", 4, "d", "lint", 4)]
    d = spark.createDataFrame(rows, "file string, severity int, message string, source string, seq long")
    text = lambda df: sorted(r.message for r in df.collect())
    assert text(diagnostics.filtered(d, "e")) == ["a", "c"] and text(diagnostics.filtered(d, "nonsense")) == []
    assert text(diagnostics.filtered(d, "w,hint", "lint")) == ["b", "d"] and len(text(diagnostics.filtered(d))) == 4
    more = spark.createDataFrame([("f", 1, "e", "lint", 4), ("h", 1, "x", "lint", 5), ("h", None, None, None, 6)], d.schema)
    assert {(r.file, r.message) for r in diagnostics.latest(d.union(more)).collect()} == {("f", "d"), ("f", "e"), ("g", "c")}
    a = spark.createDataFrame([("f", 1, "quickfix", False), ("f", 2, "refactor.extract", False), ("f", 3, "refactor", True)], "file string, ord int, kind string, is_preferred boolean")
    n = diagnostics.numbered_actions(a, "REFACTOR")
    assert [(r.ord, r["index"]) for r in n.orderBy("ord").collect()] == [(2, 0), (3, 1)]
    assert diagnostics.selected_action(n, preferred=True).first().ord == 3 and diagnostics.selected_action(n, index=0).first().ord == 2


def test_edits(spark):
    df = spark.createDataFrame([("héllo\r\nworld\n",)], "c string")
    one = lambda c: df.select(c.alias("x")).first().x
    e = lambda a, b, t: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("new_text"))
    assert one(edits.apply(F.col("c"), F.array(e(0, 1, "J"), e(7, 12, "all")))) == "Jéllo\r\nall\n"
    none = F.lit(None).cast("int")
    assert one(edits.replaced(F.col("c"), F.lit(1), F.lit(3), none, none, F.lit("X"))) == "héX\r\nworld\n"
    assert one(edits.replaced(F.col("c"), F.lit(1), F.lit(3), F.lit(2), F.lit(3), F.lit("-"))) == "hé-rld\n"
    assert one(edits.inserted(F.col("c"), F.lit(2), F.lit("new"), after=False)) == "héllo\r\nnew\nworld\n"
    assert one(edits.inserted(F.col("c"), F.lit(2), F.lit("new"), after=True)) == "héllo\r\nworld\nnew\n"
    r = spark.createDataFrame([("f", 1, 4)], "file string, line int, column int")
    assert edits.rename_plan(r, "abc", "abc").count() == 0 and edits.rename_plan(r, "abc", "x").first().end_column == 7


def test_batches(spark):
    lines = [(0, '{"command":"find_refs","location":"a:1"}'), (1, ""), (2, "junk"), (3, '{"command":"nonsense"}'), (4, '{"command":"find_symbol","file":"b"}'), (5, '{"command":"hover"}'), (6, '{"command":"hover","location":"a"}')]
    c = batch.parsed(spark.createDataFrame(lines, "index int, value string"))
    assert [(r["index"], r.file, r.line, r.error) for r in c.orderBy("index").collect()] == [(0, "a", 1, None), (4, "b", None, None), (6, None, None, "no position")]
    answers = spark.createDataFrame([(0, "x"), (0, "y")], "index int, result string")
    done = batch.answered(c, {"find_refs": answers, "hover": answers.limit(0)})
    assert {r["index"]: (r.success, r.result) for r in done.collect()} == {0: (True, ["x", "y"]), 4: (False, None), 6: (False, None)}
    assert batch.answered(c, {"find_refs": answers.limit(0)}).where("index = 0").first().result == []
    assert tuple(batch.summary(done).first()) == (3, 1, 2)
    assert batch.until_failure(done).count() == 2


def test_wire_shapes(spark):
    symbol = {"name": "A", "kind": 5, "range": {"start": {"line": 0, "character": 0}, "end": {"line": 9, "character": 1}}, "selectionRange": {"start": {"line": 1, "character": 6}, "end": {"line": 1, "character": 7}}, "children": [{"name": "f", "kind": 12, "range": {"start": {"line": 2, "character": 0}, "end": {"line": 3, "character": 0}}, "selectionRange": {"start": {"line": 2, "character": 4}, "end": {"line": 2, "character": 5}}}]}
    flat = {"name": "g", "kind": 99, "containerName": "", "location": {"uri": "file:///a.rs", "range": {"start": {"line": 4, "character": 0}, "end": {"line": 4, "character": 3}}}}
    rows = [("a.rs", json.dumps([symbol])), ("b.rs", json.dumps([flat])), ("c.rs", "null"), ("d.rs", "junk")]
    got = {(r.file, r.name): r for r in wire.symbols(spark.createDataFrame(rows, "file string, result string")).collect()}
    assert set(got) == {("a.rs", "A"), ("a.rs", "f"), ("b.rs", "g"), ("c.rs", "c.rs"), ("d.rs", "d.rs")}
    assert (got["a.rs", "A"].line, got["a.rs", "A"].column, got["a.rs", "A"].end_line) == (2, 7, 10)
    assert got["a.rs", "f"].container == "A" and got["a.rs", "f"].depth == 1 and got["b.rs", "g"].kind == "variable" and got["c.rs", "c.rs"].kind == "file"

    place = {"start": {"line": 3, "character": 1}, "end": {"line": 3, "character": 4}}
    answers = [(1, json.dumps({"uri": "file:///x%20y.rs", "range": place})), (2, json.dumps([{"targetUri": "file:///z.rs", "targetRange": place, "targetSelectionRange": place}])), (3, "null"), (4, json.dumps([{"uri": "file:///q", "range": place}] * 2))]
    locations = wire.locations(spark.createDataFrame(answers, "target_id int, result string")).collect()
    assert sorted((r.target_id, r.file, r.line, r.column, r.ord) for r in locations) == [(1, "/x y.rs", 4, 2, 0), (2, "/z.rs", 4, 2, 0), (4, "/q", 4, 2, 0), (4, "/q", 4, 2, 1)]

    edit = {"changes": {"file:///a": [{"range": place, "newText": "n"}], "file:///empty": []}, "documentChanges": [{"textDocument": {"uri": "file:///b"}, "edits": [{"range": place}]}]}
    e = wire.workspace_edits(spark.createDataFrame([(7, json.dumps(edit))], "action_id int, result string")).collect()
    assert sorted((r.file, r.start_line, r.new_text) for r in e) == [("/a", 3, "n"), ("/b", 3, "")]

    help_ = {"signatures": [{"label": "f(a, bc)", "parameters": [{"label": [2, 3]}, {"label": "bc"}]}], "activeSignature": 0}
    s = wire.signatures(spark.createDataFrame([(1, json.dumps(help_)), (2, '{"signatures":[]}')], "target_id int, result string")).collect()
    assert [(r.target_id, r.label, r.parameters) for r in s] == [(1, "f(a, bc)", ["a", "bc"])]

    published = {"uri": "file:///d.rs", "diagnostics": [{"range": place, "message": "m", "tags": [1, 2], "code": 7}, {"range": place, "message": "w", "severity": 2, "source": "x", "code": "E1"}]}
    d = wire.diagnostics(spark.createDataFrame([(5, json.dumps(published))], "seq long, params string")).orderBy("message").collect()
    assert [(r.file, r.severity, r.code, r.tags, r.line) for r in d] == [("/d.rs", 1, "7", ["unnecessary", "deprecated"], 4), ("/d.rs", 2, "E1", [], 4)]

    hints = [{"position": {"line": 1, "character": 2}, "label": [{"value": ": "}, {"value": "u8"}], "kind": 1}, {"position": {"line": 2, "character": 0}, "label": "x"}]
    h = wire.inlay_hints(spark.createDataFrame([("f", json.dumps(hints))], "file string, result string")).orderBy("line").collect()
    assert [(r.label, r.kind) for r in h] == [(": u8", "type"), ("x", None)]
    folds_ = [{"startLine": 1, "endLine": 4, "kind": "imports"}, {"startLine": 6, "endLine": 7, "kind": "odd"}]
    assert [r.kind for r in wire.folding_ranges(spark.createDataFrame([("f", json.dumps(folds_))], "file string, result string")).orderBy("start_line").collect()] == ["imports", "other"]
    chain = {"range": place}
    for _ in range(39):
        chain = {"range": place, "parent": chain}
    assert wire.selection_ranges(spark.createDataFrame([("f", json.dumps([chain]))], "file string, result string")).count() == 40
    nested = [{"range": place, "parent": {"range": symbol["range"]}}]
    assert [(r.ord, r.level, r.end_line) for r in wire.selection_ranges(spark.createDataFrame([("f", json.dumps(nested))], "file string, result string")).orderBy("level").collect()] == [(0, 0, 3), (0, 1, 9)]


def test_selection_ranges_are_read_once(spark):
    place = {"start": {"line": 3, "character": 1}, "end": {"line": 4}}
    odd = [{"range": place, "parent": None}, None, {"parent": {"range": 7, "parent": {"range": place}}}]
    rows = [("odd", json.dumps(odd)), ("null", "null"), ("none", None), ("junk", "[{"), ("one", json.dumps(odd[0]))]
    got = wire.selection_ranges(spark.createDataFrame(rows, "file string, result string")).orderBy("ord", "level").collect()
    ends = [(r.ord, r.level, r.start_line, r.start_char, r.end_line, r.end_char) for r in got]
    assert ends == [(0, 0, 3, 1, 4, None), (1, 0, *[None] * 4), (2, 0, *[None] * 4), (2, 1, *[None] * 4), (2, 2, 3, 1, 4, None)] and {r.file for r in got} == {"odd"}
    one = '{"range":{"start":{"line":1,"character":0},"end":{"line":2,"character":0}}'
    chain = "[" + ',"parent":'.join([one] * 400) + "}" * 400 + "]"
    began = time.time()
    assert wire.selection_ranges(spark.range(1500).select(F.col("id").cast("string").alias("file"), F.lit(chain).alias("result"))).where("start_line = 1").count() == 600_000
    assert time.time() - began < 60


def test_frames():
    a, b = b'{"id":1}', '{"x":"é"}'.encode()
    raw = b"".join(b"Content-Length: %d\r\nOther: x\r\n\r\n%s" % (len(x), x) for x in (a, b))
    assert wire.frames(raw + b"Content-Length: 9\r\n\r\n{") == [a.decode(), b.decode()]
    assert wire.frames(b"Content-Length: 2\r\n\r\n\xff{") == ["\ufffd{"]


def test_lines_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id":1,"method":"m","params":[1]}\n\n{"id":"x"}\nnot json\n')
    want = [("1", "m", "[1]", None), ('"x"', None, None, "invalid_request"), (None, None, None, "parse_error")]
    got = rpc.requests(rpc.lines(spark, str(tmp_path / "in")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    stream = rpc.requests(rpc.lines(spark, str(tmp_path / "in"), stream=True))
    answers = stream.select("id", F.when(F.col("error").isNull(), F.lit('"ok"')).alias("result"), "error", F.lit(None).cast("string").alias("detail"))
    rpc.write_lines(rpc.responses(answers), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    lines = sorted(r.value for r in rpc.lines(spark, str(tmp_path / "out")).collect())
    assert [json.loads(x) for x in lines] == sorted([json.loads(x) for x in lines], key=json.dumps) and {json.loads(x).get("result") for x in lines} == {"ok", None}
    assert {json.loads(x)["error"]["code"] for x in lines if "error" in x} == {-32700, -32600}
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "c.bin").write_bytes(b"Content-Length: 8\r\n\r\n" + b'{"id":1}')
    assert [(r.nth, r.kind) for r in rpc.kinds(rpc.captured(spark, str(tmp_path / "raw"))).collect()] == [(0, "response")]


def test_code_points_and_units(spark):
    df = spark.createDataFrame([("let 😀name",)], "t string")
    assert df.select(X.code_points(F.col("t"), F.lit(6)).alias("v")).first().v == 5 and df.select(X.utf16_units(F.col("t"), F.lit(5)).alias("v")).first().v == 6


# Streams


def streamed(spark, tmp_path, df, make, mode):
    """All rows that a stream over df's files gives, read in the order of seq."""
    source, name = str(tmp_path / "in"), f"out_{tmp_path.name.replace('-', '_')}"
    for k, part in enumerate((0, 1)):
        df.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
        if k == 0:
            time.sleep(1.1)
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


def test_versions_stream(spark, tmp_path):
    rows = [("f", 1, "a", 0), ("f", 2, "a", 0), ("g", 3, "x", 0), ("f", 4, "b", 1), ("f", 5, "a", 1), ("g", 6, "x", 1)]
    df = spark.createDataFrame(rows, "file string, seq long, content string, part int")
    assert streamed(spark, tmp_path, df, folds.versions_stream, "append") == sorted(map(tuple, folds.versions(df).collect()))


def test_failures_stream(spark, tmp_path):
    rows = [("s", i, i % 5 == 0, int(i > 6)) for i in range(1, 14)] + [("t", i, False, int(i > 6)) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "server string, seq long, healthy boolean, part int")
    want = sorted(map(tuple, folds.restarts(df).collect()))
    assert want == [("s", 3), ("s", 8), ("s", 13), ("t", 3), ("t", 6)]
    assert streamed(spark, tmp_path, df, folds.failures_stream, "append") == want
    assert {r.server: r.longest for r in folds.failures(df).collect()} == {"s": 4, "t": 8}


def test_latest_stream(spark, tmp_path):
    one = lambda *m: [(1, x) for x in m]
    rows = [("f", 1, one("a", "b"), 0), ("g", 2, one("c"), 0), ("h", 3, one("d"), 0), ("f", 4, one("e", "f"), 1), ("g", 5, [], 1)]
    df = spark.createDataFrame(rows, "file string, seq long, diagnostics array<struct<severity: int, message: string>>, part int")
    got = {r[0]: (r[1], [d.message for d in r[2]]) for r in streamed(spark, tmp_path, df, folds.latest_stream, "complete")}
    assert got == {"f": (4, ["e", "f"]), "g": (5, []), "h": (3, ["d"])}
    flat = df.select("file", "seq", F.explode_outer("diagnostics").alias("d")).select("file", "seq", "d.*")
    assert {(r.file, r.message) for r in diagnostics.latest(flat).collect()} == {("f", "e"), ("f", "f"), ("h", "d")}
    assert {(r.file, r.message) for r in folds.published(folds.latest_stream(df)).collect()} == {("f", "e"), ("f", "f"), ("h", "d")}


def test_correlation_and_sessions(spark):
    t = lambda s: F.to_timestamp(F.lit(f"2024-01-01 00:{s:02d}:00"))
    q = spark.range(1, 4).select(F.col("id"), t(0).alias("ts"))
    a = spark.createDataFrame([("1", "ok", 1), ("2", "late", 9), ("7", "lost", 1)], "id string, result string, m int").select("id", "result", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0)").alias("ts"))
    assert {r.id: (r.result, r.cancelled) for r in folds.correlated(q, a).collect()} == {"1": ("ok", False), "2": (None, True), "3": (None, True)}
    r = spark.createDataFrame([("p", "2024-01-01 00:00:00"), ("p", "2024-01-01 00:29:59"), ("p", "2024-01-01 01:10:00")], "project string, t string").select("project", F.to_timestamp("t").alias("ts"))
    assert sorted(x.requests for x in folds.sessions(r).collect()) == [1, 2]


def test_indexing_state(spark):
    rows = [("k", i, e) for i, e in enumerate(["edit", "open", "edit", "ready", "edit", "open", "timeout", "edit"])]
    got = [r.state for r in folds.indexing_state(spark.createDataFrame(rows, "key string, seq int, event string")).orderBy("seq").collect()]
    assert got == ["not_started", "in_progress", "in_progress", "ready", "stale", "in_progress", "timed_out", "stale"]


def test_registered_queries_are_whole():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) >= 55
    assert os.path.exists(e.__file__) and S is not None
