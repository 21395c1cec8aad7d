"""The project's questions over a small set of facts."""

import json

import pytest
from pyspark.sql import functions as F

from lorewalk.project import Project, Unsupported, counted, register, response

CODE = "class A:\n    def f(self):\n        return g()\n\ndef g():\n    return 1\n"


@pytest.fixture(scope="module")
def project(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema).cache()
    place = "target_id long, file string, line int, column int, ord int"
    facts = {
        "files": t([("a.py", "python", len(CODE), CODE), ("b.py", "python", 9, "x = g()\r\n")], "file string, language string, size long, content string"),
        "symbols": t(
            [
                (1, None, "a.py", "A", "class", None, 1, 7, 3, 19, 0, 1, None, "A"),
                (2, 1, "a.py", "f", "method", "A", 2, 9, 3, 19, 1, 2, None, "A/f"),
                (3, None, "a.py", "g", "function", None, 5, 5, 6, 13, 0, 3, None, "g"),
            ],
            "sym_id long, parent_id long, file string, name string, kind string, container string, line int, column int, end_line int, end_column int, depth int, ord int, overload_idx int, name_path string",
        ),
        "refs": t([(3, "a.py", 3, 16, 0), (3, "b.py", 1, 5, 1), (3, "a.py", 5, 5, 2)], place),
        "defs": t([(3, "node_modules/g.py", 1, 1, 0), (3, "a.py", 5, 5, 1)], place),
        "type_defs": t([(1, "a.py", 1, 7, 0)], place),
        "impl_edges": t([(1, "b.py", 1, 1, 0)], place),
        "call_edges": t([(2, 3, "a.py", 3, 16, 0)], "caller_id long, callee_id long, site_file string, site_line int, site_column int, ord int"),
        "type_edges": t([(2, 1, 0)], "sub_id long, super_id long, ord int"),
        "diagnostics": t([("a.py", 1, "bad", "E1", "lint", 1, 1, 1), ("a.py", 2, "meh", "W1", "lint", 2, 1, 2)], "file string, severity int, message string, code string, source string, line int, column int, seq long"),
        "code_actions": t([("a.py", 5, 5, 1, "Fix", "quickfix", False, 7), ("a.py", 5, 5, 2, "Move", "refactor", True, 8)], "file string, line int, column int, ord int, title string, kind string, is_preferred boolean, action_id int"),
        "edits": t([(7, "a.py", 4, 4, 4, 5, "h"), (7, "a.py", 2, 15, 2, 16, "h")], "action_id int, file string, start_line int, start_char int, end_line int, end_char int, new_text string"),
        "hovers": t([(3, "def g()", "g")], "target_id long, content string, name string"),
        "signatures": t([(3, 0, "g()", [])], "target_id long, ord int, label string, parameters array<string>"),
        "inlay_hints": t([("a.py", 3, 4, ": int", "type")], "file string, line int, character int, label string, kind string"),
        "folding_ranges": t([("a.py", 0, 2, "region")], "file string, start_line int, end_line int, kind string"),
    }
    return Project(spark, facts)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_symbols(project):
    assert rows(project.find_symbols("a.py"), "name") == [("A",), ("g",)]
    assert rows(project.find_symbols("a.py", "A/*", body=True), "name", "body") == [("f", "    def f(self):\n        return g()")]
    assert rows(project.workspace_symbols("F", "python"), "name") == [("f",)]


def test_navigation(project):
    assert rows(project.find_references("a.py:5:5"), "file", "line") == [("a.py", 3), ("a.py", 5), ("b.py", 1)]
    assert rows(project.goto_definition("a.py:5"), "file") == [("a.py",)]
    assert rows(project.goto_type_definition("a.py:1:7"), "line") == [(1,)]
    for ask in (lambda: project.find_implementations("a.py:1:7"), lambda: project.calls("a.py:5:5", "incoming"), lambda: project.types("a.py:1:7", "sub")):
        with pytest.raises(Unsupported, match="Python"):
            ask()
    rust = Project(project.spark, project.facts | {"symbols": project["symbols"].withColumn("file", F.lit("a.rs"))})
    assert rows(rust.find_implementations("a.rs:1:7"), "file") == [("b.py",)]
    assert rows(rust.calls("a.rs:5:5", "incoming"), "name", "site_line") == [("f", 3)] and rows(rust.calls("a.rs:2:9", "outgoing"), "name") == [("g",)]
    assert rows(rust.types("a.rs:1:7", "sub"), "name") == [("f",)] and rows(rust.types("a.rs:2:9", "super"), "name") == [("A",)]
    assert rows(project.impact("a.py:5:5"), "file", "count") == [("a.py", 2), ("b.py", 1)] and rows(project.impact("a.py:5:5", 2), "name", "steps") == [("f", 1)]
    assert rows(project.hover("a.py:5:5"), "content") == [("def g()",)] and project.signature_help("a.py:5:5").count() == 1
    assert project.inlay_hints("a.py", 0, 9).count() == 1 and project.of_file("folding_ranges", "a.py").count() == 1
    with pytest.raises(ValueError):
        project.find_references("a.py")
    assert not project.supported("python", "find_implementations") and project.supported("elm", "hover")


def test_search(project):
    assert rows(project.search_text(r"g\(\)"), "file", "line") == [("a.py", 3), ("a.py", 5), ("b.py", 1)]
    assert project.search_text("g", kind="python").count() == 3 and project.search_text("g", kind="rust").count() == 0
    assert project.node_types("python").count() == 12


def test_diagnostics_and_actions(project):
    assert rows(project.diagnostics("a.py", "w"), "severity", "message") == [("warning", "meh")]
    assert rows(project.code_actions("a.py:5:5", "quick"), "title", "index") == [("Fix", 0)]
    assert project.apply_action("a.py:5:5", kind="quickfix").first().content == CODE.replace("g()", "h()")
    assert project.apply_action("a.py:5:5", preferred=True).count() == 0


def test_edits(project):
    assert rows(project.rename_plan("a.py:5:5", "h"), "file", "line", "end_column") == [("a.py", 3, 17), ("a.py", 5, 6), ("b.py", 1, 6)]
    assert project.edit_replace("b.py:1:5", "h()").first().content == "x = h()\r\n"
    assert project.edit_insert("a.py", "g", "# note", after=False).first().content == CODE.replace("def g", "# note\ndef g")
    assert project.edit_insert("a.py", "A/f", "    # end", after=True).first().content == CODE.replace("g()\n\n", "g()\n    # end\n\n")
    assert project.edit_symbol("a.py", "g", "g = 1").first().content == CODE.replace("def g():\n    return 1", "g = 1")
    with pytest.raises(ValueError):
        project.edit_symbol("a.py", "none", "")


def test_names_to_rename(project, spark):
    assert project.name_at("a.py:5:5") == "g" and project.name_at("none.py:1") is None
    t = spark.createDataFrame([(3, "given")], "target_id long, placeholder string")
    assert Project(spark, project.facts | {"rename_targets": t}).name_at("a.py:5:5") == "given"
    unnamed = Project(spark, project.facts | {"symbols": project["symbols"].withColumn("name", F.lit(None).cast("string"))})
    assert unnamed.name_at("a.py:5") == "g"


def test_syntax_search_and_table_function(project, spark):
    assert rows(project.search_ast("(class_definition (function_definition name: (identifier) @n))", "python"), "text") == [("f",)]
    with pytest.raises(ValueError, match="class_definition"):
        project.search_ast("(a", "python")
    register(spark)
    got = spark.sql("select q.start_line, q.text from (select 'def f():\n  pass' as c) t, lateral ast_query(t.c, 'function_definition', 'python') q").collect()
    assert [(r.start_line, r.text) for r in got] == [(1, "def f():\n  pass")]


def test_batch_and_status(project, spark):
    lines = [(0, '{"command":"find_refs","location":"a.py:5"}'), (1, '{"command":"hover","location":"a.py:1"}'), (2, '{"command":"calls_incoming","location":"a.py:5"}'), (3, '{"command":"diagnostics","file":"a.py"}'), (4, '{"command":"rename","location":"a.py:5:5","new_name":"h"}')]
    got = {r["index"]: r for r in project.run_batch(spark.createDataFrame(lines, "index int, value string")).collect()}
    assert [got[k].success for k in range(5)] == [True, True, False, True, True]
    assert len(got[0].result) == 3 and got[1].result == [] and "Python" in got[2].error
    assert [json.loads(x) for x in got[4].result] == [{"file": "a.py", "edit_count": 2}, {"file": "b.py", "edit_count": 1}]
    assert rows(project.status(), "language", "files") == [("python", 2)] and rows(project.entries(), "file") == [("a.py",)]
    there = spark.createDataFrame([("gopls",)], "command string")
    d = project.doctor(there)
    assert d.where("installed").count() == 1 and project.doctor(there, missing_only=True).count() == 35
    assert tuple(counted(d).first()) == (1, 35) and tuple(counted(project.doctor(there, missing_only=True)).first()) == (0, 35)
    assert json.loads(response(project.status()))["count"] == 1


def test_calls_of_every_caller(spark, tmp_path):
    from lorewalk import catalog_project

    spark.createDataFrame([(42, "own", "Brand#11", 1), (2500, "far", "Brand#12", 1)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.createDataFrame([(1, 42, 2500, 3), (2, 42, 2500, 2), (3, 42, 42, 1), (4, 7, 42, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows(catalog_project.project_calls(spark, str(tmp_path)), "name", "line", "site_line") == [("far", 2501, 2), ("own", 43, 1)]


def test_a_batch_looks_only_for_what_it_asks(project, spark):
    never = project["call_edges"].withColumn("caller_id", F.raise_error(F.lit("not asked")).cast("long"))
    lines = [(0, '{"command":"hover","location":"a.py:5"}'), (1, '{"command":"find_refs","location":"a.py:1"}'), (2, '{"command":"find_typedef","location":"a.py:1"}')]
    got = {r["index"]: r for r in Project(spark, project.facts | {"call_edges": never}).run_batch(spark.createDataFrame(lines, "index int, value string")).collect()}
    assert [(got[k].success, len(got[k].result or [])) for k in range(3)] == [(True, 1), (True, 0), (True, 1)]
    assert Project(spark, project.facts).run_batch(spark.createDataFrame([], "index int, value string")).count() == 0
