"""The registered queries and their SQL.

Every query runs over its whole tables.  SQL is given in DuckDB's dialect with
the sample tables as views; columns have the same names and types on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewalk import dims
from lorewalk.functions import symbols as S
from lorewalk.functions import text as X
from lorewalk.operators import ast, batch, diagnostics, edits, graph, search, symbols
from lorewalk.plans import facts
from lorewalk.sources import files, ignore, syntax
from lorewalk.streaming import folds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL of the fact tables, as in lorewalk.plans.facts
FILES = "files AS (SELECT source || '/' || doc_id || '.' || lang AS file, lang AS language, CAST(strlen(text) AS BIGINT) AS size, text AS content FROM documents)"
LINES = (
    FILES
    + """, held AS (SELECT file, language, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM (SELECT file, language, string_split(content, chr(10)) AS l FROM files)),
lines AS (SELECT file, language, CAST(unnest(generate_series(1, len(l))) AS INTEGER) AS line, unnest(l) AS text FROM held)"""
)
METHODS = """methods AS (SELECT *, parent || '/' || name || CASE WHEN idx IS NULL THEN '' ELSE '[' || idx || ']' END AS name_path FROM (
  SELECT p_partkey AS sym_id, p_brand AS parent, p_name AS name, p_partkey AS ord,
    CASE WHEN count(*) OVER (PARTITION BY p_brand, p_name) > 1 THEN CAST(row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS INTEGER) END AS idx FROM part))"""
PLACES = """places AS (
  SELECT r_regionkey + 1 AS sym_id, r_name AS name, 'module' AS kind, 0 AS depth, r_name AS name_path FROM region
  UNION ALL SELECT n_nationkey + 1000, n_name, 'namespace', 1, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_custkey + 1000000, c_name, 'class', 2, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
REFS = "refs AS (SELECT l_partkey AS target_id, '/src/' || l_orderkey || '.rs' AS file, CAST(l_linenumber AS INTEGER) AS line, CAST(l_suppkey AS INTEGER) AS col FROM lineitem)"
CALLS = "calls AS (SELECT DISTINCT 's' || l_suppkey AS caller, 'p' || l_partkey AS callee FROM lineitem)"
DIAGNOSTICS = """diagnostics AS (SELECT '/u/' || user_id AS file, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS severity,
  event_type AS message, json_extract_string(props, '$.k') AS source, event_id AS seq, ts FROM events)"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# Text search ----------------------------------------------------------------------


@query(f"WITH {LINES} SELECT file, line, CAST(strlen(regexp_extract(text, '^(.*?)the [a-z]+', 1)) + 1 AS INTEGER) AS \"column\", rtrim(text) AS text, regexp_extract(text, 'the [a-z]+') AS match FROM lines WHERE regexp_matches(text, 'the [a-z]+')")
def text_search(spark, sf_dir):
    return search.search_text(facts.files(spark, sf_dir), "the [a-z]+")


@query(f"WITH {LINES} SELECT file, line, CAST(strlen(regexp_extract(text, '(?i)^(.*?)THE [a-z]+', 1)) + 1 AS INTEGER) AS \"column\", rtrim(text) AS text, regexp_extract(text, '(?i)THE [a-z]+') AS match FROM lines WHERE regexp_matches(text, '(?i)THE [a-z]+')")
def text_search_icase(spark, sf_dir):
    return search.search_text(facts.files(spark, sf_dir), "THE [a-z]+", ignore_case=True)


@query(f"WITH {LINES} SELECT file, line, CAST(strlen(regexp_extract(text, '^(|.*?[^\\pL\\pN_])erst(?:$|[^\\pL\\pN_])', 1)) + 1 AS INTEGER) AS \"column\", rtrim(text) AS text, 'erst' AS match FROM lines WHERE regexp_matches(text, '(?:^|[^\\pL\\pN_])erst(?:$|[^\\pL\\pN_])')")
def text_search_word(spark, sf_dir):
    return search.search_text(facts.files(spark, sf_dir), "erst", word=True)


@query(f"WITH {LINES} SELECT file, line, CAST(strlen(regexp_extract(text, '^(.*?)und', 1)) + 1 AS INTEGER) AS \"column\", rtrim(text) AS text, 'und' AS match FROM lines WHERE language = 'de' AND contains(text, 'und')")
def text_search_type(spark, sf_dir):
    return search.search_text(facts.files(spark, sf_dir), "und", language="de")


@query(f"WITH {LINES} SELECT file, line, CAST(strlen(regexp_extract(text, '^(.*?)the', 1)) + 1 AS INTEGER) AS \"column\", rtrim(text) AS text, 'the' AS match FROM lines WHERE starts_with(file, 'src1/') AND contains(text, 'the')")
def text_search_path(spark, sf_dir):
    return search.search_text(facts.files(spark, sf_dir), "the", under="src1")


@query(f"""WITH {LINES} SELECT a.file, a.line, a.text, coalesce(b.text, '') AS context_before, coalesce(c.text, '') AS context_after
FROM lines a LEFT JOIN lines b ON b.file = a.file AND b.line = a.line - 1 LEFT JOIN lines c ON c.file = a.file AND c.line = a.line + 1 WHERE regexp_matches(a.text, 'ation[.] [A-Z]')""")
def text_search_context(spark, sf_dir):
    found = search.search_with_context(facts.files(spark, sf_dir), "ation[.] [A-Z]", 1)
    return found.withColumns({c: F.array_join(c, "\n") for c in ("context_before", "context_after")})


@query(f"WITH {LINES} SELECT file, line, CAST(strlen(regexp_extract(text, '^(.*?)the', 1)) + 1 AS INTEGER) AS \"column\", rtrim(text) AS text, 'the' AS match FROM lines WHERE contains(text, 'the') ORDER BY file, line LIMIT 100")
def text_search_limit(spark, sf_dir):
    return search.search_text(facts.files(spark, sf_dir), "the", limit=dims.LIMITS["search"])


@query(f"""WITH {FILES}, w AS (SELECT file, ' ' || array_to_string(list_filter(regexp_split_to_array(content, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM files),
b AS (SELECT item_id, ' ' || array_to_string(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM benchmark)
SELECT file, item_id FROM w JOIN b ON contains(w.t, b.t)""")
def text_search_phrases(spark, sf_dir):
    return search.search_many(facts.files(spark, sf_dir), facts.table(spark, sf_dir, "benchmark"))


@query(f"WITH {LINES} SELECT language, count(*) AS n_lines, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(max(line) AS INTEGER) AS longest FROM lines GROUP BY language")
def lines_stats(spark, sf_dir):
    per = search.lines(facts.files(spark, sf_dir)).groupBy("language")
    return per.agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("text")).alias("n_bytes"), F.max("line").alias("longest"))


# Files ----------------------------------------------------------------------------


@query(f"WITH {FILES} SELECT file, language, size FROM files")
def files_scan(spark, sf_dir):
    return facts.files(spark, sf_dir).select("file", "language", "size")


@query(f"WITH {FILES} SELECT file, size FROM files WHERE size <= 2048 AND NOT contains(content, chr(0))")
def files_size_cap(spark, sf_dir):
    f = facts.files(spark, sf_dir).select("file", F.col("size").alias("length"), F.col("content").cast("binary").alias("content"))
    return files.checked(f, most=2048).where("error is null").select("file", "size")


@query(f"WITH {FILES} SELECT DISTINCT language FROM files WHERE language IS NOT NULL")
def languages_distinct(spark, sf_dir):
    return files.project_languages(facts.files(spark, sf_dir))


@query(f"WITH {FILES} SELECT file FROM files WHERE NOT regexp_matches(file, '^src(1|12)/')")
def files_ignore_rules(spark, sf_dir):
    rules = ignore.compile_rules("src1/\nsrc12/\nsrc13/\n!src13/\n")
    return facts.files(spark, sf_dir).where(~ignore.ignored(F.col("file"), rules)).select("file")


# Symbols --------------------------------------------------------------------------


def _methods(spark, sf_dir):
    m = facts.methods(spark, sf_dir)
    m = m.withColumn("overload_idx", symbols.overload_index(["parent", "name"]).cast("int"))
    return m.withColumn("name_path", symbols.suffixed(F.concat_ws("/", "parent", "name"), F.col("overload_idx")))


@query("SELECT p_partkey AS sym_id, p_brand AS parent, p_name AS name, 'method' AS kind, 1 AS depth FROM part")
def symbols_flat(spark, sf_dir):
    return facts.methods(spark, sf_dir).select("sym_id", "parent", "name", "kind", "depth")


@query(f"WITH {METHODS} SELECT sym_id, coalesce(idx, -1) AS overload_idx, name_path FROM methods")
def symbols_overload_idx(spark, sf_dir):
    return _methods(spark, sf_dir).select("sym_id", F.coalesce("overload_idx", F.lit(-1)).alias("overload_idx"), "name_path")


@query(f"WITH {PLACES} SELECT CAST(sym_id AS BIGINT) AS sym_id, kind, depth, name_path FROM places")
def symbols_name_path(spark, sf_dir):
    return symbols.with_paths(facts.places(spark, sf_dir), 2).select("sym_id", "kind", "depth", "name_path")


def _pattern_query(name, pattern, condition):
    @query(f"WITH {METHODS} SELECT sym_id, name_path FROM methods WHERE {condition}", name)
    def run(spark, sf_dir):
        return symbols.find_symbols(_methods(spark, sf_dir), pattern).select("sym_id", "name_path")

    return run


_pattern_query("symbols_path_name", "red widget", "name = 'red widget'")
_pattern_query("symbols_path_relative", "Brand#1/red widget", "parent = 'Brand#1' AND name = 'red widget'")
_pattern_query("symbols_path_absolute", "/Brand#17/red widget", "parent = 'Brand#17' AND name = 'red widget'")
_pattern_query("symbols_path_wildcard", "Brand#1*/*widget", "starts_with(parent, 'Brand#1') AND ends_with(name, 'widget')")
_pattern_query("symbols_path_wildcard_middle", "*/sm*ing", "starts_with(name, 'sm') AND ends_with(name, 'ing')")
_pattern_query("symbols_path_overload", "Brand#17/red widget[1]", "parent = 'Brand#17' AND name = 'red widget' AND idx = 1")


@query(f"WITH {METHODS} SELECT sym_id, name_path FROM methods WHERE contains(lower(name), 'widg')")
def symbols_substring(spark, sf_dir):
    return symbols.find_symbols(_methods(spark, sf_dir), substring="WIDG").select("sym_id", "name_path")


def _kind_query(name, condition, **options):
    @query(f"WITH {PLACES} SELECT CAST(sym_id AS BIGINT) AS sym_id, name_path FROM places WHERE {condition}", name)
    def run(spark, sf_dir):
        return symbols.find_symbols(symbols.with_paths(facts.places(spark, sf_dir), 2), **options).select("sym_id", "name_path")

    return run


_kind_query("symbols_kind_include", "kind IN ('class', 'module')", include="class, module")
_kind_query("symbols_kind_exclude", "kind NOT IN ('namespace')", exclude="namespace")
_kind_query("symbols_structural", "kind <> 'variable'", structural=True)
_kind_query("symbols_depth", "depth <= 1", depth=1)
_kind_query("symbols_path_levels", "starts_with(name_path, 'ASIA/') AND depth = 2", path="ASIA/*/*")


@query(f"WITH {METHODS} SELECT sym_id, name_path FROM methods WHERE parent = 'Brand#17' ORDER BY ord LIMIT 25")
def symbols_limit(spark, sf_dir):
    return symbols.find_symbols(_methods(spark, sf_dir), "Brand#17/*", limit=25).select("sym_id", "name_path")


@query("SELECT CAST(min(l_orderkey) AS BIGINT) AS ord, l_partkey, l_suppkey FROM lineitem GROUP BY l_partkey, l_suppkey")
def symbols_dedupe(spark, sf_dir):
    x = facts.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord"), "l_partkey", "l_suppkey")
    return symbols.distinct_first(x, ["l_partkey", "l_suppkey"])


@query("SELECT name_path, sym_id FROM (WITH " + METHODS + " SELECT * FROM methods) WHERE name_path = 'Brand#17/red widget[0]' ORDER BY sym_id LIMIT 1")
def symbols_find_by_path(spark, sf_dir):
    return symbols.find_by_path(_methods(spark, sf_dir), "Brand#17/red widget[0]").select("name_path", "sym_id")


@query(f"WITH {FILES} SELECT file, CASE WHEN len(string_split(content, chr(10))) >= 2 THEN array_to_string(string_split(content, chr(10))[2:4], chr(10)) END AS body FROM files")
def symbols_body(spark, sf_dir):
    f = facts.files(spark, sf_dir)
    return f.select("file", symbols.body(F.col("content"), F.lit(2), F.lit(4)).alias("body"))


@query(f"""WITH {FILES}, sy AS (SELECT source || '/' || d.doc_id || '.' || lang AS file, 'q' || quality AS name, 'class' AS kind FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT file, name, kind FROM sy UNION ALL SELECT file, string_split(file, '/')[-1], 'file' FROM files WHERE file NOT IN (SELECT file FROM sy)""")
def symbols_file_fallback(spark, sf_dir):
    d, labels = facts.table(spark, sf_dir, "documents").drop("text"), facts.table(spark, sf_dir, "labels")
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    some = d.join(labels, "doc_id").select(name.alias("file"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("name"), F.lit("class").alias("kind"))
    return symbols.with_file_symbols(d.select(name.alias("file")), some)


@query("""WITH s AS (SELECT p_brand AS file, p_size * 10 AS a, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size * 10 + 25 END AS b, p_partkey AS ord, p_name AS name FROM part),
pos AS (SELECT p_partkey AS pos_id, p_brand AS file, p_size * 10 + 7 AS line FROM part)
SELECT pos_id, name FROM (SELECT pos_id, name, row_number() OVER (PARTITION BY pos_id ORDER BY ord) AS nth FROM pos JOIN s USING (file) WHERE line >= a AND (b IS NULL OR line <= b)) WHERE nth = 1""")
def symbol_at_position(spark, sf_dir):
    p = facts.table(spark, sf_dir, "part")
    line = F.col("p_size") * 10
    s = p.select(F.col("p_brand").alias("file"), line.alias("line"), F.when(F.col("p_partkey") % 7 != 0, line + 25).alias("end_line"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    return symbols.enclosing(p.select(F.col("p_partkey").alias("pos_id"), F.col("p_brand").alias("file"), (line + 7).alias("line")), s)


@query("SELECT r_name AS name, CAST(count(n.n_nationkey) AS INTEGER) AS n_children, string_agg(n_name, ',' ORDER BY n_nationkey) AS children FROM region LEFT JOIN nation n ON n_regionkey = r_regionkey GROUP BY r_name")
def symbols_nested(spark, sf_dir):
    two = facts.places(spark, sf_dir).where("depth <= 1")
    n = symbols.nested(two, 1)
    return n.select("name", F.coalesce(F.size("children"), F.lit(0)).alias("n_children"), F.array_join(F.transform("children", lambda c: c["name"]), ",").alias("children"))


# References, definitions, calls, types --------------------------------------------


@query(f'WITH {REFS} SELECT file, line, col AS "column" FROM refs WHERE target_id = 42')
def refs_of_target(spark, sf_dir):
    return graph.find_references(facts.refs(spark, sf_dir), F.col("target_id") == 42)


@query(f"WITH {REFS} SELECT file, line, col AS \"column\" FROM refs ORDER BY file, line, col LIMIT 500")
def refs_limit(spark, sf_dir):
    return graph.find_references(facts.refs(spark, sf_dir), F.lit(True), root="/src", limit=dims.LIMITS["refs"])


@query("""WITH x AS (SELECT l_partkey AS target_id, CASE l_linenumber WHEN 1 THEN '/r/node_modules/' WHEN 2 THEN '/r/vendor/' WHEN 3 THEN '/other/' ELSE '/r/src/' END || l_orderkey AS file FROM lineitem)
SELECT target_id, count(*) AS n FROM x WHERE starts_with(file, '/r/') AND NOT contains(file, 'node_modules') AND NOT contains(file, '/vendor/') GROUP BY target_id""")
def refs_project_filter(spark, sf_dir):
    x = facts.table(spark, sf_dir, "lineitem")
    folder = F.when(F.col("l_linenumber") == 1, "/r/node_modules/").when(F.col("l_linenumber") == 2, "/r/vendor/").when(F.col("l_linenumber") == 3, "/other/").otherwise("/r/src/")
    r = x.select(F.col("l_partkey").alias("target_id"), F.concat(folder, F.col("l_orderkey").cast("string")).alias("file"))
    return r.where(S.own(F.col("file"), "/r")).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT o_custkey AS target_id, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN '/node_modules/' ELSE '/src/' END || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '.d.ts' ELSE '.ts' END AS file FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY CASE WHEN NOT contains(file, 'node_modules') AND NOT ends_with(file, '.d.ts') THEN 1 WHEN NOT contains(file, 'node_modules') THEN 2 WHEN NOT ends_with(file, '.d.ts') THEN 3 ELSE 4 END, ord) AS nth FROM d)
SELECT target_id, file, ord FROM r WHERE nth = 1""")
def definition_best(spark, sf_dir):
    o = facts.table(spark, sf_dir, "orders")
    file = F.concat(F.when(F.col("o_orderstatus") == "F", "/node_modules/").otherwise("/src/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".d.ts").otherwise(".ts"))
    return graph.best_definition(o.select(F.col("o_custkey").alias("target_id"), file.alias("file"), F.col("o_orderkey").alias("ord")))


@query("SELECT o_custkey AS target_id, arg_min(o_orderstatus, o_orderkey) AS file FROM orders GROUP BY o_custkey")
def type_definition_first(spark, sf_dir):
    o = facts.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("file"))
    return graph.first_of(o, "target_id", "file")


@query("SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS implementor FROM lineitem WHERE l_partkey = 42")
def implementations(spark, sf_dir):
    edges = facts.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("target_id"), F.col("l_suppkey").alias("implementor"))
    return graph.find_implementations(edges, F.col("target_id") == 42, "implementor")


@query(f"WITH {REFS} SELECT file, count(*) AS count, string_agg(line || ':' || col, ',' ORDER BY line, col) AS locations FROM refs GROUP BY file")
def impact_by_file(spark, sf_dir):
    i = graph.impact(facts.refs(spark, sf_dir), F.lit(True))
    return i.withColumn("locations", F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["line"].cast("string"), x["column"].cast("string"))), ","))


@query(f"WITH {REFS} SELECT count(*) AS total, count(DISTINCT file) AS files FROM refs WHERE target_id = 42")
def impact_totals(spark, sf_dir):
    return graph.impact_totals(facts.refs(spark, sf_dir), F.col("target_id") == 42)


@query(f"""WITH {CALLS}, e AS (SELECT caller, callee FROM calls UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
one AS (SELECT DISTINCT caller AS node FROM e WHERE callee = 'p42'), two AS (SELECT DISTINCT e.caller AS node FROM e JOIN one ON e.callee = one.node WHERE e.caller NOT IN (SELECT node FROM one))
SELECT node, 1 AS steps FROM one UNION ALL SELECT node, 2 FROM two""")
def impact_depth2(spark, sf_dir):
    s = facts.table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("caller"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("callee"))
    return graph.reached(facts.call_edges(spark, sf_dir).unionByName(s), spark.createDataFrame([("p42",)], "node string"), 2)


@query(f"WITH {CALLS} SELECT caller FROM calls WHERE callee = 'p42'")
def calls_incoming(spark, sf_dir):
    return graph.calls(facts.call_edges(spark, sf_dir), F.col("callee") == "p42", "incoming")


@query(f"WITH {CALLS} SELECT callee FROM calls WHERE caller = 's7'")
def calls_outgoing(spark, sf_dir):
    return graph.calls(facts.call_edges(spark, sf_dir), F.col("caller") == "s7", "outgoing")


def _type_edges(spark, sf_dir):
    """sub and super: customers below nations, nations below regions."""
    r, n, c = (facts.table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("sub"), F.col("r_name").alias("super"))
    return up.unionByName(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("sub"), F.col("n_name").alias("super")))


@query("SELECT c_name AS sub, n_name AS super FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def supertypes(spark, sf_dir):
    return graph.types(_type_edges(spark, sf_dir), F.lit(True), "super")


@query("SELECT n_name AS sub FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def subtypes(spark, sf_dir):
    return graph.types(_type_edges(spark, sf_dir), F.col("super") == "ASIA", "sub")


@query("""WITH e AS (SELECT c_name AS sub, n_name AS super FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT node, steps FROM (SELECT sub AS node, 1 AS steps FROM e WHERE super = 'ASIA' UNION ALL SELECT b.sub, 2 FROM e a JOIN e b ON b.super = a.sub WHERE a.super = 'ASIA')""")
def type_closure(spark, sf_dir):
    edges = _type_edges(spark, sf_dir).select(F.col("sub").alias("caller"), F.col("super").alias("callee"))
    return graph.reached(edges, spark.createDataFrame([("ASIA",)], "node string"), 3)


# Diagnostics and actions ----------------------------------------------------------


@query(f"WITH {DIAGNOSTICS} SELECT file, severity, source, seq FROM diagnostics WHERE severity IN (1, 2) AND source = '7'")
def diagnostics_filter(spark, sf_dir):
    d = facts.diagnostics(spark, sf_dir)
    return diagnostics.filtered(d, "error, w, nonsense", "7").select("file", "severity", "source", "seq")


@query(f"WITH {DIAGNOSTICS} SELECT CASE severity WHEN 1 THEN 'error' WHEN 2 THEN 'warning' WHEN 3 THEN 'info' ELSE 'hint' END AS severity, count(*) AS n, count(DISTINCT file) AS files FROM diagnostics GROUP BY 1")
def diagnostics_summary(spark, sf_dir):
    d = facts.diagnostics(spark, sf_dir)
    return d.groupBy(X.severity_name(F.col("severity")).alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


_ACTIONS = """acts AS (SELECT 'f' || o_custkey AS file, o_orderkey AS ord, CASE o_orderpriority WHEN '1-URGENT' THEN 'quickfix' WHEN '2-HIGH' THEN 'refactor.extract' WHEN '3-MEDIUM' THEN 'refactor' WHEN '5-LOW' THEN 'source' ELSE 'other' END AS kind, o_orderstatus = 'P' AS is_preferred FROM orders)"""


def _actions(spark, sf_dir):
    o = facts.table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    raw = F.when(p == "1-URGENT", "quickfix.all").when(p == "2-HIGH", "refactor.extract").when(p == "3-MEDIUM", "refactor.move").when(p == "5-LOW", "source.sort").otherwise(p)
    return o.select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file"), F.col("o_orderkey").alias("ord"), X.action_kind(raw).alias("kind"), (F.col("o_orderstatus") == "P").alias("is_preferred"))


@query(f"WITH {_ACTIONS} SELECT file, kind, ord, CAST(row_number() OVER (PARTITION BY file ORDER BY ord) - 1 AS INTEGER) AS index FROM acts WHERE contains(kind, 'refactor')")
def actions_kind_filter(spark, sf_dir):
    return diagnostics.numbered_actions(_actions(spark, sf_dir), "Refactor").select("file", "kind", "ord", "index")


@query(f"WITH {_ACTIONS} SELECT file, kind, ord FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY is_preferred DESC, ord) AS nth FROM acts) WHERE nth = 1")
def actions_preferred(spark, sf_dir):
    return diagnostics.selected_action(diagnostics.numbered_actions(_actions(spark, sf_dir)), preferred=True).select("file", "kind", "ord")


# Edits ----------------------------------------------------------------------------


@query(f"WITH {FILES} SELECT file, md5(substr(content, 1, 2) || '<a>' || substr(content, 6, 5) || '<b>' || substr(content, 13)) AS content FROM files WHERE length(content) >= 20")
def edits_apply(spark, sf_dir):
    f = facts.files(spark, sf_dir).where(F.length("content") >= 20)
    e = lambda a, b, t: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("new_text"))
    return f.select("file", F.md5(edits.apply(F.col("content"), F.array(e(2, 5, "<a>"), e(10, 12, "<b>")))).alias("content"))


@query(f"WITH {FILES}, h AS (SELECT file, string_split(content, chr(10)) AS l FROM files) SELECT file, md5(array_to_string(list_concat(['NEW'], l[2:]), chr(10))) AS content FROM h")
def edits_replace_line(spark, sf_dir):
    f = facts.files(spark, sf_dir)
    one = F.lit(1)
    return f.select("file", F.md5(edits.replaced(F.col("content"), one, one, F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("NEW"))).alias("content"))


@query(f"WITH {FILES}, h AS (SELECT file, string_split(content, chr(10)) AS l FROM files) SELECT file, md5(array_to_string(list_concat(list_concat(l[1:1], ['NEW']), l[2:]), chr(10))) AS content FROM h")
def edits_insert(spark, sf_dir):
    f = facts.files(spark, sf_dir)
    return f.select("file", F.md5(edits.inserted(F.col("content"), F.lit(1), F.lit("NEW"), after=True)).alias("content"))


@query(f"WITH {REFS} SELECT file, count(*) AS edit_count FROM refs GROUP BY file")
def edits_per_file(spark, sf_dir):
    return edits.per_file(facts.refs(spark, sf_dir))


@query(f"WITH {REFS} SELECT file, line, col AS \"column\", col + 6 AS end_column, 'better' AS new_text FROM refs WHERE target_id = 42")
def rename_plan(spark, sf_dir):
    return edits.rename_plan(graph.find_references(facts.refs(spark, sf_dir), F.col("target_id") == 42), "widget", "better")


# Batches, dimensions, status ------------------------------------------------------


@query("""WITH r AS (SELECT user_id, event_type <> 'error' AS success FROM events) SELECT user_id, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM r GROUP BY user_id""")
def batch_summary(spark, sf_dir):
    e = facts.table(spark, sf_dir, "events").select("user_id", (F.col("event_type") != "error").alias("success"))
    return batch.summary(e, "user_id")


@query("""SELECT event_id AS index, CASE WHEN event_type = 'signup' THEN 'hover' ELSE 'find_refs' END AS command, 'a' AS file, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS line, 1 AS "column" FROM events WHERE event_type <> 'view' AND event_type <> 'click'""")
def batch_parse(spark, sf_dir):
    e = facts.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    place = F.concat(F.lit('"location":"a:'), (F.get_json_object("props", "$.k").cast("int") + 1).cast("string"), F.lit('"}'))
    text = F.when(kind == "view", "not json").when(kind == "click", '{"command":"find_refs"}').when(kind == "signup", F.concat(F.lit('{"command":"hover",'), place)).otherwise(F.concat(F.lit('{"command":"find_refs",'), place))
    return batch.parsed(e.select(F.col("event_id").alias("index"), text.alias("value"))).select("index", "command", "file", "line", "column")


def _values(rows):
    return ", ".join(str(tuple(r)) for r in rows)


_CAPABILITIES = [(lang, f, dims.support_level(lang, f)) for lang in [i for i, *_ in dims.LANGUAGES] + ["unknown"] for f, _, _ in dims.FEATURES]


@query(f"""WITH c(language, feature, level) AS (VALUES {_values(_CAPABILITIES)}), asked AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'rust' WHEN 'de' THEN 'kotlin' WHEN 'fr' THEN 'python' ELSE 'php' END AS language, 'rename' AS feature FROM documents)
SELECT doc_id, a.language, level, level <> 'none' AS supported FROM asked a JOIN c ON c.language = a.language AND c.feature = a.feature""")
def capability_lookup(spark, sf_dir):
    d = facts.table(spark, sf_dir, "documents")
    language = F.when(F.col("lang") == "en", "rust").when(F.col("lang") == "de", "kotlin").when(F.col("lang") == "fr", "python").otherwise("php")
    asked = d.select("doc_id", language.alias("language"), F.lit("rename").alias("feature"))
    return asked.join(dims.capabilities(spark), ["language", "feature"]).select("doc_id", "language", "level", (F.col("level") != "none").alias("supported"))


@query(f"WITH c(language, feature, level) AS (VALUES {_values(_CAPABILITIES)}) SELECT language, count(*) AS n, string_agg(feature, ',' ORDER BY feature) AS limited FROM c WHERE level = 'none' GROUP BY language")
def doctor_limited(spark, sf_dir):
    c = dims.capabilities(spark).where("level = 'none'")
    return c.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("limited"))


@query(f"""WITH e(ext, language) AS (VALUES {_values((x, i) for i, _, e, _, _ in dims.LANGUAGES for x in e.split())}), f AS (SELECT 'src/' || o_orderkey || '.' || CASE o_orderkey % 5 WHEN 0 THEN 'RS' WHEN 1 THEN 'kt' WHEN 2 THEN 'hpp' WHEN 3 THEN 'txt' ELSE 'py' END AS file FROM orders)
SELECT coalesce(language, 'unknown') AS language, count(*) AS n FROM f LEFT JOIN e ON e.ext = lower(string_split(file, '.')[-1]) GROUP BY 1""")
def language_by_extension(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    ext = F.when(k == 0, "RS").when(k == 1, "kt").when(k == 2, "hpp").when(k == 3, "txt").otherwise("py")
    f = facts.table(spark, sf_dir, "orders").select(F.concat(F.lit("src/"), F.col("o_orderkey").cast("string"), F.lit("."), ext).alias("file"))
    return files.with_language(f).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p(language, factor) AS (VALUES {_values((i, dims.PROFILES.get(i, dims.OTHER_PROFILE)[0]) for i, *_ in dims.LANGUAGES)}), o(operation, f2) AS (VALUES {_values((n, f) for n, (f, _) in dims.OPERATIONS.items())})
SELECT language, operation, CAST(30 * factor * f2 AS DOUBLE) AS seconds FROM p, o""")
def timeout_table(spark, sf_dir):
    o = dims.operations(spark).select("operation", F.col("factor").alias("f2"))
    return dims.profiles(spark).crossJoin(o).select("language", "operation", (F.lit(30.0) * F.col("factor") * F.col("f2")).alias("seconds"))


@query("SELECT CAST(a AS INTEGER) AS attempt, CAST(CASE WHEN a = 0 THEN 0 ELSE least(100 * 2 ** (a - 1), 1000) END AS BIGINT) AS delay_ms FROM range(0, 12) t(a)")
def retry_schedule(spark, sf_dir):
    return spark.range(12).select(F.col("id").cast("int").alias("attempt"), X.retry_delay_ms(F.col("id").cast("int"), most=1000).alias("delay_ms"))


# Streams, folded in batch ---------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations)
SELECT conv_id, turn AS asked, CASE WHEN next_role = 'assistant' THEN next_turn ELSE -1 END AS answered FROM c WHERE role = 'user'""")
def rpc_pairing(spark, sf_dir):
    return folds.paired(facts.table(spark, sf_dir, "conversations")).withColumn("answered", F.coalesce("answered", F.lit(-1).cast("bigint")))


@query("""WITH c AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations)
SELECT conv_id, turn AS asked FROM c WHERE role = 'user' AND next_role IS DISTINCT FROM 'assistant'""")
def rpc_unanswered(spark, sf_dir):
    return folds.paired(facts.table(spark, sf_dir, "conversations")).where("answered is null").select("conv_id", "asked")


@query("""WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, event_id, CAST(sum(CASE WHEN before IS NULL OR before <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS version FROM e""")
def doc_versions(spark, sf_dir):
    e = facts.table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"))
    return folds.versions(e).select(F.col("file").alias("user_id"), F.col("seq").alias("event_id"), "version")


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
r AS (SELECT user_id, island, count(*) FILTER (bad) AS n FROM e GROUP BY user_id, island) SELECT user_id, max(n) AS longest, max(n) >= 3 AS restarted FROM r GROUP BY user_id""")
def health_failures(spark, sf_dir):
    e = facts.table(spark, sf_dir, "events").select(F.col("user_id").alias("server"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("healthy"))
    return folds.failures(e).select(F.col("server").alias("user_id"), "longest", "restarted")


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS requests FROM s GROUP BY user_id""")
def idle_projects(spark, sf_dir):
    e = facts.table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.col("ts").cast("timestamp").alias("ts"))
    return folds.sessions(e).groupBy(F.col("project").alias("user_id")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("requests").alias("requests"))


@query("""WITH e AS (SELECT user_id, event_id, json_extract_string(props, '$.k') AS h, lag(json_extract_string(props, '$.k')) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
c AS (SELECT user_id, count(*) FILTER (before = h) AS hits, count(*) FILTER (before IS DISTINCT FROM h) AS misses FROM e GROUP BY user_id)
SELECT user_id, hits, misses, round(hits / (hits + misses), 6) AS hit_rate FROM c""")
def cache_stats(spark, sf_dir):
    e = facts.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").alias("hash"))
    return folds.cache_hits(e).select(F.col("key").alias("user_id"), "hits", "misses", F.round("hit_rate", 6).alias("hit_rate"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS nth FROM e WHERE bad) SELECT user_id, event_id FROM r WHERE nth % 3 = 0""")
def health_restarts(spark, sf_dir):
    e = facts.table(spark, sf_dir, "events").select(F.col("user_id").alias("server"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("healthy"))
    return folds.restarts(e).select(F.col("server").alias("user_id"), F.col("seq").alias("event_id"))


# Syntax nodes ---------------------------------------------------------------------


@query(r"""WITH p AS (SELECT page_id, regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS h FROM pages)
SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(h, '(?i)<p[ >]')) AS t FROM p) GROUP BY page_id""")
def ast_tag_search(spark, sf_dir):
    pages = facts.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("content"))
    found = ast.search_files(pages, "(p) @match", "html")
    return found.groupBy(F.col("file").cast("bigint").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))


_METHODS_OF = "m AS (SELECT p_brand AS file, replace(p_name, ' ', '_') || '_' || p_partkey AS name, p_size AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part)"


def _code(spark, sf_dir, head: str, method: str) -> DataFrame:
    """file and content: a class for each brand, with a method for each of its parts."""
    p = facts.table(spark, sf_dir, "part")
    name = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"))
    text = F.format_string(method, name, F.col("p_size"))
    held = p.groupBy(F.col("p_brand").alias("file")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", text.alias("t")))).alias("all"))
    return held.select("file", F.concat(F.lit(head), F.array_join(F.transform("all", lambda x: x["t"]), "")).alias("content"))


_PYTHON = ("class Brand:\n", "    def %s(self):\n        x = %d\n        return x\n")


@query(f"WITH {_METHODS_OF} SELECT file, 1 AS start_line, 'c' AS first, name FROM m")
def ast_captures(spark, sf_dir):
    found = ast.search_files(_code(spark, sf_dir, *_PYTHON), "(class_definition (function_definition name: (identifier) @n)) @c", "python", texts=["n"])
    return found.select("file", "start_line", F.col("captures")[0]["name"].alias("first"), F.col("captures")[1]["text"].alias("name"))


@query(f"WITH {_METHODS_OF} SELECT file, CAST(nth * 3 AS INTEGER) AS start_line, 8 AS start_column, 'x = ' || size AS text, 'return x' AS \"returns\" FROM m")
def ast_two_children(spark, sf_dir):
    found = ast.search_files(_code(spark, sf_dir, *_PYTHON), "(function_definition (assignment) @a (return_statement) @r)", "python")
    return found.select("file", "start_line", "start_column", "text", F.col("captures")[1]["text"].alias("returns"))


@query(f"WITH {_METHODS_OF} SELECT file, name FROM m WHERE starts_with(name, 'red_')")
def ast_predicate(spark, sf_dir):
    nodes = syntax.nodes(_code(spark, sf_dir, *_PYTHON), "python")
    return ast.search_ast(nodes, '((identifier) @name (#match? @name "^red_"))').select("file", F.col("text").alias("name"))


@query(f"WITH {_METHODS_OF} SELECT file, CAST(nth + 1 AS INTEGER) AS start_line, CAST(nth + 1 AS INTEGER) AS end_line, 'pub fn ' || name || '(a: &str) -> i32 {{ ' || size || ' }}' AS text, name FROM m")
def ast_rust_functions(spark, sf_dir):
    code = _code(spark, sf_dir, "impl Brand { // fn none() {}\n", "    pub fn %s(a: &str) -> i32 { %d }\n")
    found = ast.search_files(code, "(function_item name: (identifier) @n) @f", "rust")
    return found.select("file", "start_line", "end_line", "text", F.col("captures")[1]["text"].alias("name"))


from lorewalk import catalog_messages, catalog_project  # noqa: E402, F401  (they register their queries here)
