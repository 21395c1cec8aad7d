"""Registered queries of a project's own questions, and of state and dimensions that they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewalk import dims, project
from lorewalk.catalog import METHODS, REFS, _values, query
from lorewalk.functions import symbols as S
from lorewalk.operators import batch, edits, search, symbols
from lorewalk.plans import facts
from lorewalk.sources import files, ignore, rpc
from lorewalk.streaming import folds


def _nested(spark, sf_dir) -> DataFrame:
    """A brand's parts as symbols of one file, four levels deep by size: every part holds the parts of a quarter of its lines that lie in it."""
    p = facts.table(spark, sf_dir, "part")
    level = (F.col("p_partkey") % 4).cast("int")
    width = F.element_at(F.array(F.lit(400), F.lit(100), F.lit(20), F.lit(3)), level + 1)
    line = F.col("p_size") * 7 + level * 2
    return p.select(
        F.col("p_brand").alias("file"), line.cast("int").alias("line"), (line + width).cast("int").alias("end_line"), F.col("p_partkey").alias("ord"),
        F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("sym_id"), F.when(level > 0, F.col("p_partkey") - 1).alias("parent_id"), level.alias("depth"),
    )


NESTED = """s AS (SELECT p_brand AS file, p_size * 7 + (p_partkey % 4) * 2 AS a, p_size * 7 + (p_partkey % 4) * 2 + [400, 100, 20, 3][p_partkey % 4 + 1] AS b, p_partkey AS ord, 's' || p_partkey AS name, p_partkey AS sym_id,
  CASE WHEN p_partkey % 4 > 0 THEN p_partkey - 1 END AS parent_id, p_partkey % 4 AS depth FROM part),
pos AS (SELECT p_partkey AS pos_id, p_brand AS file, p_size * 9 AS line FROM part), met AS (SELECT pos_id, s.* FROM pos JOIN s ON s.file = pos.file AND line BETWEEN a AND b)"""


@query(f"""WITH {NESTED}, l0 AS (SELECT pos_id, arg_min(sym_id, ord) AS sym_id FROM met WHERE depth = 0 GROUP BY pos_id),
l1 AS (SELECT m.pos_id, arg_min(m.sym_id, ord) AS sym_id FROM met m JOIN l0 ON l0.pos_id = m.pos_id AND m.parent_id = l0.sym_id WHERE depth = 1 GROUP BY m.pos_id),
l2 AS (SELECT m.pos_id, arg_min(m.sym_id, ord) AS sym_id FROM met m JOIN l1 ON l1.pos_id = m.pos_id AND m.parent_id = l1.sym_id WHERE depth = 2 GROUP BY m.pos_id),
l3 AS (SELECT m.pos_id, arg_min(m.sym_id, ord) AS sym_id FROM met m JOIN l2 ON l2.pos_id = m.pos_id AND m.parent_id = l2.sym_id WHERE depth = 3 GROUP BY m.pos_id)
SELECT l0.pos_id, 's' || coalesce(l3.sym_id, l2.sym_id, l1.sym_id, l0.sym_id) AS name FROM l0 LEFT JOIN l1 USING (pos_id) LEFT JOIN l2 USING (pos_id) LEFT JOIN l3 USING (pos_id)""")
def symbol_innermost(spark, sf_dir):
    p = facts.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos_id"), F.col("p_brand").alias("file"), (F.col("p_size") * 9).cast("int").alias("line"))
    return symbols.innermost(p, _nested(spark, sf_dir))


@query(f"""WITH {NESTED}, x AS (SELECT pos.pos_id, s.sym_id, pos.line = a AND 3 BETWEEN 2 AND 2 + length(name) AS exact, depth, ord FROM pos JOIN s ON s.file = pos.file AND (line BETWEEN a AND b))
SELECT pos_id, sym_id AS target_id FROM (SELECT *, row_number() OVER (PARTITION BY pos_id ORDER BY NOT exact, depth DESC, ord) AS nth FROM x) WHERE nth = 1""")
def symbol_targets(spark, sf_dir):
    p = facts.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos_id"), F.col("p_brand").alias("file"), (F.col("p_size") * 9).cast("int").alias("line"), F.lit(3).alias("column"))
    return symbols.at_positions(p, _nested(spark, sf_dir).withColumn("column", F.lit(2)))


@query("""WITH RECURSIVE t(k, path, depth) AS (SELECT p_partkey, 'n' || p_partkey, 0 FROM part WHERE p_partkey % 20 = 0 UNION ALL SELECT t.k + 1, path || '/n' || (t.k + 1), depth + 1 FROM t JOIN part ON p_partkey = t.k + 1 WHERE (t.k + 1) % 20 <> 0)
SELECT k AS sym_id, CAST(depth AS INTEGER) AS depth, path AS name_path FROM t""")
def symbols_deep_paths(spark, sf_dir):
    """Chains of twenty levels."""
    k = F.col("p_partkey")
    s = facts.table(spark, sf_dir, "part").select(k.alias("sym_id"), F.when(k % 20 != 0, k - 1).alias("parent_id"), F.concat(F.lit("n"), k.cast("string")).alias("name"), (k % 20).cast("int").alias("depth"), k.alias("ord"))
    return symbols.with_paths(s).select("sym_id", "depth", "name_path")


@query(f"WITH {METHODS} SELECT sym_id, name_path FROM methods WHERE sym_id % 3 IN (0, 2)")
def symbols_kind_names(spark, sf_dir):
    """Kinds by their other names, in any case, with blanks; what is excluded goes though it is included."""
    m = facts.methods(spark, sf_dir).withColumn("overload_idx", symbols.overload_index(["parent", "name"]).cast("int"))
    m = m.withColumn("name_path", symbols.suffixed(F.concat_ws("/", "parent", "name"), F.col("overload_idx")))
    k = F.col("sym_id") % 3
    m = m.withColumn("kind", F.when(k == 0, "interface").when(k == 1, "method").otherwise("enum_member"))
    return symbols.find_symbols(m, include=" Trait,, method , EnumMember", exclude="method").select("sym_id", "name_path")


@query("""WITH t(alias, type) AS (VALUES """ + _values(dims.FILE_TYPES.items()) + """) SELECT event_id, alias, type FROM events JOIN t ON alias = CASE event_type WHEN 'error' THEN 'rs' WHEN 'view' THEN 'golang' WHEN 'click' THEN 'c++' ELSE 'hs' END""")
def file_types(spark, sf_dir):
    kind = F.col("event_type")
    e = facts.table(spark, sf_dir, "events").select("event_id", F.when(kind == "error", "rs").when(kind == "view", "golang").when(kind == "click", "c++").otherwise("hs").alias("alias"))
    known = {a: search.file_type(a.upper()) for a in dims.FILE_TYPES}
    return e.withColumn("type", F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("alias")))


@query("""SELECT p_partkey FROM part WHERE p_partkey % 6 IN (0, 5)""")
def files_ignored_names(spark, sf_dir):
    """Names that are always ignored, whatever lets them in, endings, and hidden files."""
    k, n = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    path = F.concat(F.when(k == 0, "src/a").when(k == 1, "x/node_modules/a").when(k == 2, "b/.hidden/a").when(k == 3, "logs.d/a.swp").when(k == 4, "target/a").otherwise("src/targets/a"), F.when(k == 3, "").otherwise(n))
    p = facts.table(spark, sf_dir, "part").select("p_partkey", F.when(k == 3, F.concat(F.lit("d"), n, F.lit("/a.swp"))).otherwise(path).alias("file"))
    return p.where(~ignore.ignored(F.col("file"), ignore.compile_rules("!node_modules/\n!target/\n"))).select("p_partkey")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'binary' WHEN doc_id % 5 = 1 THEN 'not UTF-8' WHEN strlen(text) > 3000 THEN 'too large' ELSE '' END AS error FROM documents WHERE NOT (doc_id % 5 IN (0, 1) AND strlen(text) > 2999)
UNION ALL SELECT doc_id, 'too large' FROM documents WHERE doc_id % 5 IN (0, 1) AND strlen(text) > 2999""")
def files_validated(spark, sf_dir):
    d, k = facts.table(spark, sf_dir, "documents"), F.col("doc_id") % 5
    content = F.when(k == 0, F.concat(F.lit(b"\0"), F.col("text").cast("binary"))).when(k == 1, F.concat(F.lit(b"\xff"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    raw = d.select(F.col("doc_id").cast("string").alias("file"), F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))
    return files.checked(raw, most=3000).select(F.col("file").cast("bigint").alias("doc_id"), F.coalesce("error", F.lit("")).alias("error"))


@query("""WITH f AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'src/' || o_orderkey || '/' END || CASE o_orderkey % 5 WHEN 0 THEN 'setup.py' WHEN 1 THEN 'a.kt' WHEN 2 THEN 'Cargo.toml' WHEN 3 THEN 'b.rs' ELSE 'z.java' END AS file FROM orders)
SELECT 'java' AS language, min(file) AS file FROM f WHERE file LIKE '%.java' UNION ALL SELECT 'kotlin', min(file) FROM f WHERE file LIKE '%.kt' UNION ALL SELECT 'rust', min(file) FROM f WHERE file LIKE '%.rs' UNION ALL SELECT 'toml', min(file) FROM f WHERE file LIKE '%.toml' UNION ALL SELECT 'python', 'setup.py'""")
def project_entries(spark, sf_dir):
    k = F.col("o_orderkey")
    base = F.element_at(F.array(*map(F.lit, ("setup.py", "a.kt", "Cargo.toml", "b.rs", "z.java"))), (k % 5 + 1).cast("int"))
    f = facts.table(spark, sf_dir, "orders").select(F.concat(F.when(k % 50 == 0, "").otherwise(F.concat(F.lit("src/"), k.cast("string"), F.lit("/"))), base).alias("file"))
    return files.project_entries(files.with_language(f))


# A project over the sample tables: parts are the symbols of brands' files ------------


def _project(spark, sf_dir) -> project.Project:
    p = facts.table(spark, sf_dir, "part")
    file = F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".rs"))
    one = lambda n: F.lit(n).cast("int")
    s = p.select(
        F.col("p_partkey").alias("sym_id"), F.lit(None).cast("long").alias("parent_id"), file.alias("file"), F.col("p_name").alias("name"), F.lit("function").alias("kind"), F.lit(None).cast("string").alias("container"),
        (F.col("p_partkey") + 1).cast("int").alias("line"), one(4).alias("column"), (F.col("p_partkey") + 1).cast("int").alias("end_line"), one(60).alias("end_column"), one(0).alias("depth"), F.col("p_partkey").alias("ord"), F.lit(None).cast("int").alias("overload_idx"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("name_path"),
    )
    refs = facts.refs(spark, sf_dir).withColumns({"is_declaration": F.lit(False), "ord": F.col("line")})
    x = facts.table(spark, sf_dir, "lineitem")
    target = F.col("l_partkey").alias("target_id")
    impl = x.select(target, F.concat(F.lit("/i/"), F.col("l_suppkey").cast("string")).alias("file"), F.col("l_linenumber").cast("int").alias("line"), one(1).alias("column"), F.col("l_linenumber").cast("int").alias("ord"))
    calls = x.select(F.col("l_suppkey").alias("caller_id"), F.col("l_partkey").alias("callee_id"), F.lit("f").alias("site_file"), F.col("l_linenumber").cast("int").alias("site_line"), one(1).alias("site_column"), F.col("l_linenumber").cast("int").alias("ord"))
    held = p.select(file.alias("file"), F.struct("p_partkey", F.concat(F.lit("fn "), "p_name")).alias("l"))
    content = held.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda l: l["col2"]), "\n").alias("content"))  # noqa: E741
    tables = {
        "files": content.select("file", F.lit("rust").alias("language"), F.octet_length("content").cast("long").alias("size"), "content"),
        "symbols": s,
        "refs": refs,
        "impl_edges": impl,
        "call_edges": calls,
        "hovers": p.select(F.col("p_partkey").alias("target_id"), F.concat(F.lit("fn "), "p_name").alias("content"), F.col("p_name").alias("name")),
        "signatures": p.select(F.col("p_partkey").alias("target_id"), F.lit(0).alias("ord"), F.concat("p_name", F.lit("()")).alias("label"), F.array(F.lit("a")).alias("parameters")),
        "inlay_hints": p.select(file.alias("file"), F.col("p_size").alias("line"), one(1).alias("character"), F.col("p_name").alias("label"), F.lit("type").alias("kind")),
        "folding_ranges": p.select(file.alias("file"), F.col("p_size").alias("start_line"), (F.col("p_size") + 3).alias("end_line"), F.lit("region").alias("kind")),
        "diagnostics": p.select(file.alias("file"), (F.col("p_size") % 5).alias("severity"), F.col("p_name").alias("message"), F.lit("E").alias("code"), F.lit("lint").alias("source"), F.col("p_size").alias("line"), one(1).alias("column"), F.col("p_partkey").alias("seq")),
    }
    return project.Project(spark, tables)


@query("SELECT sym_id, name, file FROM (SELECT p_partkey AS sym_id, p_name AS name, replace(p_brand, '#', '_') || '.rs' AS file, p_partkey + 1 AS line FROM part WHERE contains(lower(p_name), 'wid')) ORDER BY file, line LIMIT 100")
def project_workspace_symbols(spark, sf_dir):
    return _project(spark, sf_dir).workspace_symbols("WID", "rust").select("sym_id", "name", "file")


@query("""SELECT DISTINCT '/i/' || l_suppkey AS file, CAST(l_linenumber AS INTEGER) AS line, 1 AS "column" FROM lineitem WHERE l_partkey = 42""")
def project_implementations(spark, sf_dir):
    return _project(spark, sf_dir).find_implementations(_place(spark, sf_dir, 42), limit=0)


def _place(spark, sf_dir, part: int) -> str:
    """Where a part stands, as file:line:column."""
    brand = facts.table(spark, sf_dir, "part").where(F.col("p_partkey") == part).first()["p_brand"]
    return f"{brand.replace('#', '_')}.rs:{part + 1}:5"


@query("SELECT 'fn ' || p_name AS content FROM part WHERE p_partkey = 42")
def project_hover(spark, sf_dir):
    return _project(spark, sf_dir).hover(_place(spark, sf_dir, 42))


@query("SELECT CAST(0 AS INTEGER) AS ord, p_name || '()' AS label, 'a' AS parameters FROM part WHERE p_partkey = 42")
def project_signature(spark, sf_dir):
    return _project(spark, sf_dir).signature_help(_place(spark, sf_dir, 42)).withColumn("parameters", F.array_join("parameters", ","))


@query("SELECT p_size AS line, p_name AS label FROM part WHERE p_brand = 'Brand#17' AND p_size BETWEEN 5 AND 20")
def project_inlay_hints(spark, sf_dir):
    return _project(spark, sf_dir).inlay_hints("Brand_17.rs", 5, 20).select("line", "label")


@query("SELECT p_size AS start_line, p_size + 3 AS end_line FROM part WHERE p_brand = 'Brand#17'")
def project_folding_ranges(spark, sf_dir):
    return _project(spark, sf_dir).of_file("folding_ranges", "Brand_17.rs").select("start_line", "end_line")


@query("""SELECT replace(p_brand, '#', '_') || '.rs' AS file, p_name AS name, CAST(p_partkey + 1 AS INTEGER) AS line, CAST(min(l_linenumber) AS INTEGER) AS site_line FROM lineitem JOIN part ON p_partkey = l_suppkey WHERE l_partkey = 42 GROUP BY ALL""")
def project_calls(spark, sf_dir):
    return _project(spark, sf_dir).calls(_place(spark, sf_dir, 42), "incoming", limit=0).select("file", "name", "line", "site_line")


@query("""WITH l AS (SELECT replace(p_brand, '#', '_') || '.rs' AS file, list('fn ' || p_name ORDER BY p_partkey) AS lines FROM part GROUP BY 1) SELECT file, array_to_string(list_concat(['use x;'], lines[2:]), chr(10)) AS content FROM l""")
def edits_symbol(spark, sf_dir):
    f = _project(spark, sf_dir)["files"]
    return f.select("file", edits.in_symbol(F.col("content"), F.lit(1), F.lit(None).cast("int"), F.lit("use x;")).alias("content"))


@query("""SELECT 'rust' AS language, count(DISTINCT p_brand) AS files, CAST(sum(strlen(p_name) + 3) + count(*) - count(DISTINCT p_brand) AS BIGINT) AS bytes FROM part""")
def project_status(spark, sf_dir):
    return _project(spark, sf_dir).status()


@query(f"WITH n(language, ord, category, node_type, example) AS (VALUES {_values((lang, k, *x) for lang, v in dims.NODE_TYPES.items() for k, x in enumerate(v) if chr(39) not in ''.join(x))}) SELECT language, CAST(ord AS INTEGER) AS ord, category, node_type, example FROM n WHERE language = 'rust' ORDER BY ord")
def project_node_types(spark, sf_dir):
    return _project(spark, sf_dir).node_types("rust")


_SERVERS = [(lang, s[0], s[1], s[4], s[5]) for lang, s in dims.SERVERS.items()]


@query("WITH s(language, server, command, install, tier) AS (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in _SERVERS) + ") SELECT language, server, command, install, tier FROM s WHERE command NOT IN ('gopls', 'clangd')")
def doctor_missing(spark, sf_dir):
    there = spark.createDataFrame([("gopls",), ("clangd",)], "command string")
    return _project(spark, sf_dir).doctor(there, missing_only=True).select("language", "server", "command", "install", "tier")


@query("SELECT CAST(3 AS BIGINT) AS installed, CAST(33 AS BIGINT) AS missing")
def doctor_counts(spark, sf_dir):
    """gopls, and one command that two languages share."""
    there = spark.createDataFrame([("gopls",), ("typescript-language-server",)], "command string")
    return project.counted(_project(spark, sf_dir).doctor(there))


@query("""WITH s AS (SELECT p_partkey, p_name, replace(p_brand, '#', '_') || '.rs' AS file FROM part), r AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(p_partkey AS INTEGER) AS index, CASE p_partkey % 4 WHEN 0 THEN 'hover' WHEN 1 THEN 'find_refs' WHEN 2 THEN 'find_typedef' ELSE 'find_impl' END AS command, p_partkey % 4 <> 2 AS success,
CAST(CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN coalesce(n, 0) WHEN 2 THEN -1 ELSE coalesce(n, 0) END AS INTEGER) AS rows FROM s LEFT JOIN r ON l_partkey = p_partkey""")
def batch_answers(spark, sf_dir):
    """A command for each part, one of four; nothing answers the third, and parts without references have empty answers."""
    pr = _project(spark, sf_dir)
    place = F.concat_ws(":", "file", F.col("line").cast("string"), F.lit("5"))
    command = F.element_at(F.array(*map(F.lit, ("hover", "find_refs", "find_typedef", "find_impl"))), (F.col("sym_id") % 4 + 1).cast("int"))
    lines = pr["symbols"].select(F.col("sym_id").cast("int").alias("index"), F.to_json(F.struct(command.alias("command"), place.alias("location"))).alias("value"))
    return pr.run_batch(lines).select("index", "command", "success", F.coalesce(F.size("result"), F.lit(-1)).alias("rows"))


@query(f"WITH u(language, feature, message) AS (VALUES {_values((i, f, dims.unsupported_message(i, f).replace(chr(39), chr(96))) for i, *_ in dims.LANGUAGES for f, _, _ in dims.FEATURES if dims.support_level(i, f) == 'none')}) SELECT * FROM u")
def capability_messages(spark, sf_dir):
    return dims.unsupported(spark).withColumn("message", F.replace("message", F.lit("'"), F.lit("`")))


@query(f"WITH s(language, yes) AS (VALUES {_values((i, int(i in dims.NODE_TYPES)) for i, *_ in dims.LANGUAGES)}) SELECT language, yes = 1 AS supported FROM s")
def syntax_support(spark, sf_dir):
    return spark.createDataFrame([(i, dims.syntax_supported(i)) for i, *_ in dims.LANGUAGES], "language string, supported boolean")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'src/a b.rs' WHEN o_orderkey % 3 = 1 THEN '/other/a b.rs' ELSE '/projects/a b.rs' END || ':' || (o_orderkey % 90) || ':' || (o_orderkey % 7) AS shown, CAST(greatest(o_orderkey % 90 - 1, 0) AS BIGINT) AS wire_line FROM orders""")
def places_shown(spark, sf_dir):
    """Paths below the project's root shown from there, lines as on the wire."""
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, "/project/src/a b.rs").when(k % 3 == 1, "/other/a b.rs").otherwise("/projects/a b.rs")
    return facts.table(spark, sf_dir, "orders").select("o_orderkey", S.shown(S.relative(path, "/project/"), k % 90, k % 7).alias("shown"), S.zero_based(k % 90).alias("wire_line"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), v AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM e WHERE before IS NULL OR before <> event_type)
SELECT '/u/' || user_id AS file, CAST(version AS BIGINT) AS version, '{"jsonrpc":"2.0","method":"textDocument/did' || CASE WHEN version = 1 THEN 'Open","params":{"textDocument":{"uri":"file:///u/' || user_id || '","version":1,"text":"' || event_type || '"}}}' ELSE 'Change","params":{"textDocument":{"uri":"file:///u/' || user_id || '","version":' || version || '},"contentChanges":[{"text":"' || event_type || '"}]}}' END AS value FROM v""")
def document_sync(spark, sf_dir):
    e = facts.table(spark, sf_dir, "events").select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"))
    return rpc.document_sync(folds.versions(e).join(e, ["file", "seq"]))


@query("""WITH l AS (SELECT source || '/' || doc_id || '.' || lang AS file, string_split(text, chr(10)) AS l FROM documents) SELECT file, md5(array_to_string(list_concat(['NEW'], l), chr(10))) AS content FROM l""")
def edits_insert_before(spark, sf_dir):
    f = facts.files(spark, sf_dir)
    return f.select("file", F.md5(edits.inserted(F.col("content"), F.lit(1), F.lit("NEW"), after=False)).alias("content"))


def _commands(spark, sf_dir) -> DataFrame:
    """A command for each supplier: callers in a Python file, callers in a Rust one, a place that can't be read."""
    k = F.col("s_suppkey")
    place = F.when(k % 3 == 0, "a.py:1").when(k % 3 == 1, "b.rs:1").otherwise("nowhere")
    return facts.table(spark, sf_dir, "supplier").select(k.cast("int").alias("index"), F.to_json(F.struct(F.lit("calls_incoming").alias("command"), place.alias("location"))).alias("value"))


@query(f"""SELECT CAST(s_suppkey AS INTEGER) AS index, CASE s_suppkey % 3 WHEN 0 THEN '{dims.unsupported_message("python", "incoming_calls").replace(chr(39), chr(39) * 2)}' WHEN 1 THEN '' ELSE 'no position' END AS error FROM supplier""")
def batch_gated(spark, sf_dir):
    languages = spark.createDataFrame([("a.py", "python"), ("b.rs", "rust")], "file string, language string")
    return batch.gated(batch.parsed(_commands(spark, sf_dir)), languages).select("index", F.coalesce("error", F.lit("")).alias("error"))


@query("SELECT CAST(s_suppkey AS INTEGER) AS index, s_suppkey % 3 = 1 AS success FROM supplier WHERE s_suppkey <= (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 3 <> 1)")
def batch_until_failure(spark, sf_dir):
    c = batch.parsed(_commands(spark, sf_dir))
    languages = spark.createDataFrame([("a.py", "python"), ("b.rs", "rust")], "file string, language string")
    none = spark.createDataFrame([], "index int, result string")
    return batch.until_failure(batch.answered(batch.gated(c, languages), {"calls_incoming": none})).select("index", "success")


@query("""SELECT p_brand AS file, count(*) AS n FROM part GROUP BY p_brand""")
def ast_bare_type(spark, sf_dir):
    """A type without brackets or capture, in SQL's table function."""
    p = facts.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("file")).agg(F.array_join(F.collect_list(F.concat(F.lit("def f"), F.col("p_partkey").cast("string"), F.lit("():\n    pass\n"))), "").alias("content"))
    project.register(spark)
    p.createOrReplaceTempView("code_by_brand")
    return spark.sql("SELECT c.file, count(*) AS n FROM code_by_brand c, LATERAL ast_query(c.content, 'function_definition', 'python') q GROUP BY c.file")


@query("WITH s(language, tier, init_s, request_s) AS (VALUES " + _values((lang, s[5], dims.TIERS[s[5]][0], dims.TIERS[s[5]][1]) for lang, s in dims.SERVERS.items()) + ") SELECT * FROM s")
def server_tiers(spark, sf_dir):
    return dims.servers(spark).select("language", "tier", "init_s", "request_s")


@query("WITH f(feature, shown, command) AS (VALUES " + _values(dims.FEATURES) + ") SELECT * FROM f")
def features_named(spark, sf_dir):
    return dims.features(spark)
