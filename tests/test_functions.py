"""Scalar functions against golden rows and plain-Python models."""

import random

import pytest
from pyspark.sql import functions as F

from lorewalk import dims
from lorewalk.functions import symbols as S
from lorewalk.functions import text as X

PATHS = [
    ("MyClass/update", "update", True),
    ("MyClass/update", "MyClass/update", True),
    ("MyClass/update", "OtherClass/update", False),
    ("MyClass/update", "*/update", True),
    ("MyClass/update", "MyClass/*", True),
    ("MyClass/update", "*/reset", False),
    ("MyClass/update", "/MyClass/update", True),
    ("MyClass/update", "/update", False),
    ("MyClass/update", "/Other/MyClass/update", False),
    ("MyClass/doSomething[1]", "doSomething", True),
    ("MyClass/doSomething[1]", "doSomething[1]", True),
    ("MyClass/doSomething[1]", "doSomething[0]", False),
    ("MyClass/doSomething[1]", "MyClass/doSomething[1]", True),
    ("MyClass/doSomething[1]", "MyClass/doSomething[0]", False),
    ("A/aba", "ab*ba", True),
    ("A/x", "**", False),
    ("update", "MyClass/*", False),
]


def column(spark, rows, make):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], ", ".join(["i int", *(f"c{k} {t}" for k, t in enumerate(make[0]))]))
    return [r.v for r in df.select("i", make[1].alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("path,pattern,wanted", PATHS)
def test_path_patterns(spark, path, pattern, wanted):
    assert spark.createDataFrame([(path,)], "p string").select(S.matches(F.col("p"), pattern).alias("m")).first().m is wanted


def model(path, pattern):
    """The rules of path patterns once more, in words of their own."""

    def cut(x):
        head, bracket, tail = x.rpartition("[")
        digits = tail[:-1].removeprefix("+")
        return (head, int(digits)) if bracket and tail.endswith("]") and digits.isascii() and digits.isdigit() else (x, None)

    exact = pattern.startswith("/")
    want, n = cut(pattern[1:] if exact else pattern)
    base, m = cut(path)
    if n is not None and n != m:
        return False
    if "*" not in want:
        return base == want if exact else (base == want or base.endswith("/" + want)) if "/" in want else base.split("/")[-1] == want
    ps, vs = want.split("/"), base.split("/")
    if len(ps) > len(vs) or exact and len(ps) != len(vs):
        return False

    def part(v, p):
        if p == "*":
            return True
        if p.endswith("*"):
            return v.startswith(p[:-1])
        if p.startswith("*"):
            return v.endswith(p[1:])
        a, star, b = p.partition("*")
        return v.startswith(a) and v.endswith(b) if star else v == p

    return all(part(v, p) for v, p in zip(vs[-len(ps) :], ps, strict=True))


def test_path_patterns_against_a_model(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab*") for _ in range(rng.randint(1, 3)))
    paths = sorted({"/".join(word().replace("*", "c") for _ in range(rng.randint(1, 3))) + rng.choice(["", "[0]", "[1]"]) for _ in range(150)})
    df = spark.createDataFrame([(p,) for p in paths], "p string").cache()
    for _ in range(14):  # a job each: many patterns in one plan take long to compile
        pattern = rng.choice(["", "/"]) + "/".join(word() for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "[1]"])
        got = [(r.p, r.m) for r in df.select("p", S.matches(F.col("p"), pattern).alias("m")).collect()]
        assert sorted(got) == [(p, model(p, pattern)) for p in paths], pattern


def test_overload_suffix(spark):
    rows = ["method", "method[0]", "method[123]", "Class/method[2]", "method[abc]", "method["]
    got = column(spark, rows, (["string"], F.struct(*S.overload(F.col("c0")))))
    assert [tuple(x) for x in got] == [("method", None), ("method", 0), ("method", 123), ("Class/method", 2), ("method[abc]", None), ("method[", None)]


LOCATIONS = [
    ("lib/deep/tree.go:12:7", ("lib/deep/tree.go", 12, 7)),
    ("lib/deep/tree.go:12", ("lib/deep/tree.go", 12, 1)),
    ("/home/me/x y.py:3:4", ("/home/me/x y.py", 3, 4)),
    ("/données/ключ_é.kt:8:2", ("/données/ключ_é.kt", 8, 2)),
    (r"D:\work\app.cs:5:9", (r"D:\work\app.cs", 5, 9)),
    ("  a:b:3 ", ("a:b", 3, 1)),
    ("nothing", None),
    ("tree.go", None),
    ("tree.go:0:4", None),
    ("", None),
    ("tree.go:-2:1", None),
    ("tree.go:2:-1", None),
    ("tree.go:2:x", None),
    ("tree.go:2:0", None),
]


def test_locations(spark):
    got = column(spark, [x for x, _ in LOCATIONS], (["string"], S.location(F.col("c0"))))
    for (text, wanted), r in zip(LOCATIONS, got, strict=True):
        assert ((r.file, r.line, r.column) if r.error is None else None) == wanted, text
    by = dict(zip([x for x, _ in LOCATIONS], got, strict=True))
    assert "negative" in by["tree.go:-2:1"].error


def test_positions(spark):
    df = spark.range(1)
    ok = lambda line, col: df.select(S.position_valid(F.lit(3), F.lit(5), F.lit(line), F.lit(col)).alias("v")).first().v
    assert ok(2, 5) and ok(3, 6) and not ok(10, 1) and not ok(2, 7)
    assert df.select(S.zero_based(F.lit(10)).alias("v")).first().v == 9 and df.select(S.zero_based(F.lit(0)).alias("v")).first().v == 0


def test_uris(spark):
    paths = ["/src/one.go", "/my files/two.go", "/données/ключ.go", "/a~b+c*d%e"]
    uris = column(spark, paths, (["string"], S.path_to_uri(F.col("c0"))))
    assert uris[1] == "file:///my%20files/two.go" and uris[3] == "file:///a~b%2Bc%2Ad%25e"
    assert column(spark, uris, (["string"], S.uri_to_path(F.col("c0")))) == paths
    decoded = column(spark, ["one%20two", "up%2Fdown", "plain", "a+b", "100%zz!", "%C3%A9", "50%"], (["string"], S.percent_decoded(F.col("c0"))))
    assert decoded == ["one two", "up/down", "plain", "a+b", "100%!", "é", "50%"]


def test_relative_and_own_paths(spark):
    rows = ["/project/src/main.rs", "/other/file.rs", "/projects/x", "/project/node_modules/a", "/project/target/debug/x"]
    assert column(spark, rows, (["string"], S.relative(F.col("c0"), "/project")))[:3] == ["src/main.rs", "/other/file.rs", "/projects/x"]
    assert column(spark, rows, (["string"], S.own(F.col("c0"), "/project"))) == [True, False, False, False, False]


HOVERS = [
    ("```kotlin\nsuspend fun loadAll(): List<Row>\n```", "loadAll"),
    ("```rust\npub fn open(path: &Path) -> File\n```", "open"),
    ("def tidy_up(rows: list) -> None", "tidy_up"),
    ("public abstract class Ledger", "Ledger"),
    ("", None),
    ("```rust\nstore::pages\n```\n\n```rust\npub struct PageTable {\n```", "PageTable"),
    ("```rust\nstore::run\n```\n\n```rust\npub(crate) async fn flush_pages(n: u8)\n```", "flush_pages"),
]


def test_hover_names(spark):
    assert column(spark, [h for h, _ in HOVERS], (["string"], X.hover_name(F.col("c0")))) == [n for _, n in HOVERS]


def test_hover_contents(spark):
    rows = ['"plain"', '{"kind":"markdown","value":"marked"}', '["one",{"language":"rust","value":"two"}]']
    assert column(spark, rows, (["string"], X.hover_content(F.col("c0")))) == ["plain", "marked", "one\n\ntwo"]


def test_names(spark):
    rows = [(" run ", "a/b.rs", "function"), ("<unknown>", "a/b.rs", "function"), ("", "a/mod.py", "module"), ("<x>", "conf.json", "object"), ("", ".hidden", "class")]
    got = column(spark, rows, (["string", "string", "string"], S.normalized(F.col("c0"), F.col("c1"), F.col("c2"))))
    assert got == ["run", "b_fn", "mod_module", "conf_config", ".hidden_symbol"]
    assert column(spark, ["f<T>(x)", " g "], (["string"], S.without_type_parameters(F.col("c0")))) == ["f", "g"]


def test_errors(spark):
    rows = [(-32603, "internal error"), (-32603, "invalid offset 100"), (-32801, "content modified"), (-32002, "x"), (-32601, "textDocument/rename"), (1, "Server error [5]: inner")]
    got = column(spark, rows, (["int", "string"], X.friendly_error(F.col("c0"), F.col("c1"))))
    assert got[:4] == ["Operation failed. The position may be invalid.", "Invalid position: line or column exceeds file bounds.", "File changed during operation. Please retry.", "Server initializing. Try again in a moment."]
    assert got[4].startswith("Rename not supported") and got[5] == "inner"
    flags = column(spark, [(-32099, ""), (-32001, ""), (-32000, "feature"), (-32800, ""), (7, "Server stopped unexpectedly")], (["int", "string"], X.error_flags(F.col("c0"), F.col("c1"))))
    assert [(f.recoverable, f.needs_restart) for f in flags] == [(True, True), (True, False), (False, False), (True, False), (False, True)]
    assert flags[3].cancelled


def test_retry_delays(spark):
    assert column(spark, [0, 1, 2, 3, 4, 5], (["int"], X.retry_delay_ms(F.col("c0"), most=1000))) == [0, 100, 200, 400, 800, 1000]


def test_messages(spark):
    rows = ['{"jsonrpc":"2.0","id":1,"result":{}}', '{"id":"a","method":"m"}', '{"method":"m"}', "{}"]
    assert column(spark, rows, (["string"], X.message_kind(F.col("c0")))) == ["response", "request", "notification", "invalid"]


def test_log_levels_and_readiness(spark):
    rows = [("rust", "Failed to discover workspace", 1), ("go", "boom", 1), ("go", "an Exception", None), ("go", "a warning", None), ("go", "fine", None)]
    assert column(spark, rows, (["string", "string", "int"], X.log_level(F.col("c0"), F.col("c1"), F.col("c2")))) == ["ignore", "error", "error", "warn", "debug"]
    rows = [("rust", "experimental/serverStatus", '{"quiescent":true}'), ("python", "window/logMessage", '{"message":"Found 3 source files"}'), ("go", "$/progress", '{"value":{"kind":"end","title":"Indexing"}}'), ("go", "other", "{}")]
    assert column(spark, rows, (["string"] * 3, X.is_ready(F.col("c0"), F.col("c1"), F.col("c2")))) == [True, True, True, False]


def test_dimensions(spark):
    assert dims.kinds(spark).where("kind = 'class'").first().kind_id == 5 and dims.kinds(spark).where("kind = 'function'").first().kind_id == 12
    level = {(r.language, r.feature): r.level for r in dims.capabilities(spark).collect()}
    assert len(level) == 37 * 13
    assert level["rust", "find_implementations"] == "full" and level["python", "find_implementations"] == "none" and level["elm", "hover"] == "partial"
    assert dims.node_types(spark).count() == 152 and dims.servers(spark).count() == 36 and dims.languages(spark).count() == 36
    ext = {r.ext: r.language for r in dims.extensions(spark).collect()}
    assert [ext[x] for x in ("kt", "rs", "ts", "py", "go", "java")] == ["kotlin", "rust", "typescript", "python", "go", "java"] and "txt" not in ext
    timeout = lambda lang, op: 30 * dims.PROFILES[lang][0] * dims.OPERATIONS[op][0]
    assert [timeout("rust", "request"), timeout("kotlin", "workspace"), timeout("python", "initialization"), timeout("typescript", "rename")] == [45, 1800, 480, 750]
    assert dims.LIMITS["refs"] == 500 and len(dims.FILE_TYPES) == 40 and len(dims.IGNORED_NAMES) == 44
