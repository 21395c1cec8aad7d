"""Registered queries over server messages: JSON is built from the sample tables, read by lorewalk.sources, and compared with what the tables say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewalk import dims
from lorewalk.catalog import query
from lorewalk.functions import symbols as S
from lorewalk.functions import text as X
from lorewalk.operators import diagnostics
from lorewalk.plans import facts
from lorewalk.sources import rpc, wire
from lorewalk.streaming import folds

KINDS = "[" + ", ".join(f"'{k}'" for k in dims.KINDS) + "]"


def _number(x) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("int")


def _at(line, character) -> Column:
    return F.struct(_number(line).alias("line"), _number(character).alias("character"))


def _range(a, b, c, d) -> Column:
    return F.struct(_at(a, b).alias("start"), _at(c, d).alias("end"))


def _object(**fields: Column) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _in_order(rows: DataFrame, key: str, order: str, item: Column) -> DataFrame:
    """key and result: a JSON list of the key's items."""
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))).alias("all"))
    return held.select(key, F.to_json(F.transform("all", lambda e: e["x"])).alias("result"))


# Symbols --------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT c_nationkey, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth FROM customer)
SELECT '/n/' || n_nationkey || '.rs' AS file, CAST(0 AS BIGINT) AS sym_id, CAST(-1 AS BIGINT) AS parent_id, n_name AS name, 'namespace' AS kind, '' AS container, 2 AS line, 8 AS "column", 100000 AS end_line, 2 AS end_column, 0 AS depth, 0 AS ord FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)
UNION ALL SELECT '/n/' || c_nationkey || '.rs', nth, 0, c_name, CASE WHEN c_custkey % 30 BETWEEN 1 AND 26 THEN {KINDS}[c_custkey % 30] ELSE 'variable' END, n_name, CAST(c_custkey + 2 AS INTEGER), 5, CAST(c_custkey + 3 AS INTEGER), 10, 1, CAST(nth AS INTEGER)
FROM c JOIN nation ON n_nationkey = c_nationkey""")
def wire_symbols(spark, sf_dir):
    c, n = facts.table(spark, sf_dir, "customer"), facts.table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    child = _object(name=F.col("c_name"), kind=(k % 30).cast("int"), range=_range(k, 0, k + 2, 9), selectionRange=_range(k + 1, 4, k + 1, 9))
    held = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list(F.struct(k.alias("o"), child.alias("x")))).alias("all")).join(n, "n_nationkey")
    top = _object(name=F.col("n_name"), kind=F.lit(3), range=_range(0, 0, 99999, 1), selectionRange=_range(1, 7, 1, 12), children=F.transform("all", lambda e: e["x"]))
    results = held.select(F.concat(F.lit("/n/"), F.col("n_nationkey").cast("string"), F.lit(".rs")).alias("file"), F.to_json(F.array(top)).alias("result"))
    return wire.symbols(results).withColumns({"parent_id": F.coalesce("parent_id", F.lit(-1).cast("long")), "container": F.coalesce("container", F.lit(""))})


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS nth FROM supplier)
SELECT '/s/' || s_nationkey || '.go' AS file, s_name AS name, 'function' AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'Outer' ELSE '' END AS container, CAST(s_suppkey + 1 AS INTEGER) AS line, 0 AS depth, CAST(nth AS INTEGER) AS ord FROM s
UNION ALL SELECT '/s/none.go', 'none.go', 'file', '', 1, 0, 0""")
def wire_symbols_flat(spark, sf_dir):
    s = facts.table(spark, sf_dir, "supplier").withColumn("file", F.concat(F.lit("/s/"), F.col("s_nationkey").cast("string"), F.lit(".go")))
    k = F.col("s_suppkey")
    item = _object(name=F.col("s_name"), kind=12, containerName=F.when(k % 2 == 0, "Outer").otherwise(""), location=_object(uri="file:///x", range=_range(k, 0, k, 3)))
    results = _in_order(s, "file", "s_suppkey", item).unionByName(spark.createDataFrame([("/s/none.go", "null")], "file string, result string"))
    return wire.symbols(results).select("file", "name", "kind", F.coalesce("container", F.lit("")).alias("container"), "line", "depth", "ord")


# Places and edits -----------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 100 + 1 AS INTEGER) AS line, CAST(o_custkey % 50 + 1 AS INTEGER) AS col FROM orders), n AS (SELECT *, unnest(CASE k % 5 WHEN 0 THEN [] WHEN 2 THEN [0, 1] ELSE [0] END) AS ord FROM o)
SELECT k AS target_id, '/s rc/' || k || '.rs' AS file, line, col AS "column", line + 1 AS end_line, col + 2 AS end_column, CAST(ord AS INTEGER) AS ord FROM n""")
def wire_locations(spark, sf_dir):
    k = F.col("o_orderkey")
    place = _range(k % 100, F.col("o_custkey") % 50, k % 100 + 1, F.col("o_custkey") % 50 + 2)
    uri = F.concat(F.lit("file:///s%20rc/"), k.cast("string"), F.lit(".rs"))
    one, link = _object(uri=uri, range=place), _object(targetUri=uri, targetRange=_range(0, 0, 0, 0), targetSelectionRange=place)
    shape = F.when(k % 5 == 0, "null").when(k % 5 == 1, F.to_json(one)).when(k % 5 == 2, F.to_json(F.array(one, one))).when(k % 5 == 3, F.to_json(F.array(link))).otherwise(F.to_json(link))
    return wire.locations(facts.table(spark, sf_dir, "orders").select(k.alias("target_id"), shape.alias("result")))


def _edits(spark, sf_dir):
    """Two edits in a file of changes for two orders of three, one in a document change for every second order; a file without edits besides."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("n"), k.cast("string"))
    edit = lambda line, **more: _object(range=_range(line, 1, line, 4), **more)
    a, b = (F.concat(F.lit(f"file:///{x}/"), F.col("o_custkey").cast("string")) for x in "ab")
    empty = F.array().cast("array<struct<range:struct<start:struct<line:int,character:int>,end:struct<line:int,character:int>>,newText:string>>")
    changes = F.create_map(a, F.array(edit(k % 9, newText=text), edit(k % 9 + 1, newText=text)), F.lit("file:///empty"), empty)
    documents = F.array(_object(textDocument=_object(uri=b), edits=F.array(edit(k % 7))))
    whole = _object(changes=F.when(k % 3 != 0, changes), documentChanges=F.when(k % 2 == 0, documents))
    return facts.table(spark, sf_dir, "orders").select(k.alias("action_id"), F.to_json(whole).alias("result"))


@query("""SELECT o_orderkey AS action_id, '/a/' || o_custkey AS file, CAST(o_orderkey % 9 + x AS INTEGER) AS start_line, 1 AS start_char, 4 AS end_char, 'n' || o_orderkey AS new_text FROM orders, (SELECT unnest([0, 1]) AS x) WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, '/b/' || o_custkey, CAST(o_orderkey % 7 AS INTEGER), 1, 4, '' FROM orders WHERE o_orderkey % 2 = 0""")
def wire_edits(spark, sf_dir):
    return wire.workspace_edits(_edits(spark, sf_dir)).select("action_id", "file", "start_line", "start_char", "end_char", "new_text")


@query("""SELECT o_orderkey AS action_id, '/a/' || o_custkey AS file, CAST(2 AS BIGINT) AS edit_count FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, '/empty', 0 FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, '/b/' || o_custkey, 1 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0""")
def wire_file_changes(spark, sf_dir):
    return wire.file_changes(_edits(spark, sf_dir))


@query("""SELECT p_partkey AS target_id, '😀' || p_name || '(x, yy)' AS label, 'x,yy' AS parameters, CAST(0 AS INTEGER) AS active_signature, CAST(p_size % 2 AS INTEGER) AS active_parameter FROM part WHERE p_size > 3""")
def wire_signatures(spark, sf_dir):
    label = F.concat(F.lit("😀"), F.col("p_name"), F.lit("(x, yy)"))
    start = F.length("p_name") + 3  # two units of the first character, the name and the bracket
    pair = F.format_string('{"label":[%d,%d]},{"label":"yy"}', start, start + 1)
    signature = F.concat(F.lit('{"label":'), F.to_json(F.array(label)).substr(F.lit(2), F.length(F.to_json(F.array(label))) - 2), F.lit(',"parameters":['), pair, F.lit("]}"))
    whole = F.concat(F.lit('{"signatures":['), F.when(F.col("p_size") > 3, signature).otherwise(""), F.lit('],"activeSignature":0,"activeParameter":'), (F.col("p_size") % 2).cast("string"), F.lit("}"))
    out = wire.signatures(facts.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), whole.alias("result")))
    return out.select("target_id", "label", F.array_join("parameters", ",").alias("parameters"), "active_signature", "active_parameter")


def _item(uri: Column, **more: Column) -> Column:
    k = F.col("c_custkey")
    return _object(name=F.col("c_name"), kind=(k % 30).cast("int"), uri=uri, range=_range(k, 0, k + 5, 0), selectionRange=_range(k + 1, 3, k + 1, 9), **more)


@query(f"""SELECT CAST(c_nationkey AS BIGINT) AS target_id, c_name AS name, CASE WHEN c_custkey % 30 BETWEEN 1 AND 26 THEN {KINDS}[c_custkey % 30] ELSE 'variable' END AS kind, '/c/' || c_custkey AS file, CAST(c_custkey + 2 AS INTEGER) AS line, 4 AS "column", c_mktsegment AS detail FROM customer""")
def wire_type_items(spark, sf_dir):
    uri = F.concat(F.lit("file:///c/"), F.col("c_custkey").cast("string"))
    rows = facts.table(spark, sf_dir, "customer").withColumn("target_id", F.col("c_nationkey").cast("bigint"))
    results = _in_order(rows, "target_id", "c_custkey", _item(uri, detail=F.col("c_mktsegment")))
    broken = results.withColumn("result", F.concat(F.lit('[{"kind":5},'), F.substring("result", 2, 1 << 30)))  # one without a name goes
    return wire.hierarchy(broken).select("target_id", "name", "kind", "file", "line", "column", "detail")


@query("""SELECT CAST(c_nationkey AS BIGINT) AS target_id, c_name AS name, '/c/' || c_custkey AS file, CAST(CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE c_custkey % 40 + 1 END AS INTEGER) AS site_line FROM customer""")
def wire_calls(spark, sf_dir):
    k, uri = F.col("c_custkey"), F.concat(F.lit("file:///c/"), F.col("c_custkey").cast("string"))
    sites = F.when(k % 4 != 0, F.array(_range(k % 40, 2, k % 40, 5), _range(k % 40 + 9, 2, k % 40 + 9, 5))).otherwise(F.array().cast("array<struct<start:struct<line:int,character:int>,end:struct<line:int,character:int>>>"))
    call = F.when(k % 2 == 0, F.to_json(_object(**{"from": _item(uri), "fromRanges": sites}))).otherwise(F.to_json(_object(to=_item(uri), fromRanges=sites)))
    rows = facts.table(spark, sf_dir, "customer").withColumn("target_id", F.col("c_nationkey").cast("bigint"))
    held = rows.groupBy("target_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(call), ","), F.lit("]")).alias("result"))
    return wire.hierarchy(held).select("target_id", "name", "file", F.coalesce("call_site.line", F.lit(-1)).alias("site_line"))


# Diagnostics, actions, hints ------------------------------------------------------


def _published(spark, sf_dir):
    """A publication for each event: none, one or two diagnostics of a user's file."""
    e = F.col("event_id")
    one = lambda n, **more: _object(range=_range(e % 50, n, e % 50, n + 3), message=F.concat(F.col("event_type"), F.lit(f" {n}")), code=(e % 7).cast("int"), **more)
    first = one(0, severity=F.when(e % 4 != 0, (e % 6).cast("int")), source=F.col("event_type"), tags=F.when(e % 2 == 0, F.array(F.lit(1), F.lit(2), F.lit(9))))
    second = one(1, severity=F.lit(2), source=F.lit("x"), tags=F.lit(None).cast("array<int>"))
    listed = F.when(e % 3 == 0, F.array().cast("array<struct<a:int>>").cast("string")).when(e % 3 == 1, F.to_json(F.array(first))).otherwise(F.to_json(F.array(first, second)))
    params = F.concat(F.lit('{"uri":"file:///u/'), F.col("user_id").cast("string"), F.lit('","diagnostics":'), F.when(e % 3 == 0, "[]").otherwise(listed), F.lit("}"))
    return facts.table(spark, sf_dir, "events").select(e.alias("seq"), params.alias("params"))


PUBLISHED = """p AS (SELECT event_id AS seq, '/u/' || user_id AS file, event_type, event_id, unnest(CASE event_id % 3 WHEN 0 THEN [-1] WHEN 1 THEN [0] ELSE [0, 1] END) AS n FROM events),
d AS (SELECT seq, file, n, CASE WHEN n >= 0 THEN event_type || ' ' || n END AS message, CASE n WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN 1 WHEN event_id % 6 BETWEEN 1 AND 3 THEN event_id % 6 ELSE 4 END WHEN 1 THEN 2 ELSE 0 END AS severity,
  CASE WHEN n >= 0 THEN CAST(event_id % 7 AS VARCHAR) END AS code, CASE WHEN n = 0 AND event_id % 2 = 0 THEN 'unnecessary,deprecated' ELSE '' END AS tags, CASE WHEN n >= 0 THEN event_id % 50 + 1 END AS line, CASE WHEN n >= 0 THEN n + 1 END AS col FROM p)"""


@query(f"""WITH {PUBLISHED} SELECT seq, file, CAST(severity AS INTEGER) AS severity, coalesce(message, '') AS message, coalesce(code, '') AS code, tags, CAST(coalesce(line, 0) AS INTEGER) AS line, CAST(coalesce(col, 0) AS INTEGER) AS "column" FROM d""")
def wire_diagnostics(spark, sf_dir):
    d = wire.diagnostics(_published(spark, sf_dir))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return d.select("seq", "file", F.coalesce("severity", F.lit(0)).alias("severity"), blank("message"), blank("code"), F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("column", F.lit(0)).alias("column"))


@query(f"""WITH {PUBLISHED}, l AS (SELECT file, max(seq) AS seq FROM d GROUP BY file) SELECT d.file, d.seq, CAST(severity AS INTEGER) AS severity, message, CAST(line AS INTEGER) AS line FROM d JOIN l ON l.file = d.file AND l.seq = d.seq WHERE n >= 0""")
def diagnostics_latest(spark, sf_dir):
    return diagnostics.latest(wire.diagnostics(_published(spark, sf_dir))).select("file", "seq", "severity", "message", "line")


@query(f"""WITH {PUBLISHED}, l AS (SELECT file, max(seq) AS seq FROM d GROUP BY file) SELECT d.file, d.seq, CAST(severity AS INTEGER) AS severity, message FROM d JOIN l ON l.file = d.file AND l.seq = d.seq WHERE n >= 0""")
def diagnostics_latest_fold(spark, sf_dir):
    return folds.published(folds.latest_stream(wire.publications(_published(spark, sf_dir)))).select("file", "seq", "severity", "message")


@query("""SELECT 'f' || o_custkey AS file, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS ord, 'Do ' || o_orderkey AS title, CASE o_orderpriority WHEN '1-URGENT' THEN 'quickfix' WHEN '2-HIGH' THEN 'refactor.extract' WHEN '3-MEDIUM' THEN 'refactor' WHEN '5-LOW' THEN 'source' ELSE 'other' END AS kind,
o_orderstatus = 'P' AS is_preferred FROM orders QUALIFY o_orderkey % 5 <> 0""")
def wire_actions(spark, sf_dir):
    o, p = facts.table(spark, sf_dir, "orders"), F.col("o_orderpriority")
    raw = F.when(p == "1-URGENT", "quickfix.all").when(p == "2-HIGH", "refactor.extract").when(p == "3-MEDIUM", "refactor.move").when(p == "5-LOW", "source.sort").otherwise(p)
    title = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("Do "), F.col("o_orderkey").cast("string")))
    rows = o.withColumn("file", F.concat(F.lit("f"), F.col("o_custkey").cast("string")))
    results = _in_order(rows, "file", "o_orderkey", _object(title=title, kind=raw, isPreferred=F.when(F.col("o_orderstatus") == "P", True)))
    return wire.code_actions(results).select("file", "ord", "title", "kind", "is_preferred")


@query("""SELECT p_partkey AS target_id, CASE p_partkey % 4 WHEN 0 THEN 'def ' || n || '(x)' WHEN 1 THEN '```rust' || chr(10) || 'pub async fn ' || n || '()' || chr(10) || '```' WHEN 2 THEN 'first' || chr(10) || chr(10) || '```kotlin' || chr(10) || 'class ' || n || chr(10) || '```' ELSE 'it is ' || n END AS content,
CASE p_partkey % 4 WHEN 3 THEN 'it' WHEN 2 THEN 'first' ELSE n END AS name FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n FROM part)""")
def wire_hovers(spark, sf_dir):
    p = facts.table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("n"))
    kind = F.col("p_partkey") % 4
    plain = F.to_json(_object(contents=F.concat(F.lit("def "), "n", F.lit("(x)"))))
    marked = F.to_json(_object(contents=_object(kind="markdown", value=F.concat(F.lit("```rust\npub async fn "), "n", F.lit("()\n```")))))
    listed = F.concat(F.lit('{"contents":["first",'), F.to_json(_object(language="kotlin", value=F.concat(F.lit("```kotlin\nclass "), "n", F.lit("\n```")))), F.lit("]}"))
    other = F.to_json(_object(contents=F.concat(F.lit("it is "), "n")))
    return wire.hovers(p.select(F.col("p_partkey").alias("target_id"), F.when(kind == 0, plain).when(kind == 1, marked).when(kind == 2, listed).otherwise(other).alias("result")))


@query("""SELECT '/l/' || l_orderkey AS file, CAST(l_linenumber AS INTEGER) AS line, CAST(l_suppkey AS INTEGER) AS "character", CASE WHEN l_linenumber % 2 = 0 THEN ': u8' ELSE 'x:' END AS label, CASE l_linenumber % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'type' ELSE 'parameter' END AS kind, l_linenumber % 2 = 1 AS padding_left, false AS padding_right FROM lineitem""")
def wire_inlay_hints(spark, sf_dir):
    n = F.col("l_linenumber")
    kind, left = F.when(n % 3 != 0, (n % 3).cast("int")), F.when(n % 2 == 1, True)
    place = _at(n, F.col("l_suppkey"))
    parts = F.to_json(_object(position=place, label=F.array(_object(value=": "), _object(value="u8")), kind=kind, paddingLeft=left))
    text = F.when(n % 2 == 0, parts).otherwise(F.to_json(_object(position=place, label="x:", kind=kind, paddingLeft=left)))
    rows = facts.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("/l/"), F.col("l_orderkey").cast("string")).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(text), ","), F.lit("]")).alias("result"))
    return wire.inlay_hints(rows).withColumn("kind", F.coalesce("kind", F.lit("none")))


@query("""SELECT '/l/' || l_orderkey AS file, CAST(l_linenumber AS INTEGER) AS start_line, CAST(l_linenumber + l_quantity AS INTEGER) AS end_line, CASE l_linenumber % 4 WHEN 0 THEN 'comment' WHEN 1 THEN 'imports' WHEN 2 THEN 'other' ELSE 'none' END AS kind FROM lineitem""")
def wire_folding_ranges(spark, sf_dir):
    n = F.col("l_linenumber")
    kind = F.when(n % 4 == 0, "comment").when(n % 4 == 1, "imports").when(n % 4 == 2, "odd")
    item = F.to_json(_object(startLine=n.cast("int"), endLine=(n + F.col("l_quantity")).cast("int"), kind=kind))
    rows = facts.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("/l/"), F.col("l_orderkey").cast("string")).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("result"))
    return wire.folding_ranges(rows).select("file", "start_line", "end_line", F.coalesce("kind", F.lit("none")).alias("kind"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS file, CAST(level AS INTEGER) AS level, CAST(100 - level AS INTEGER) AS start_line, CAST(100 + level AS INTEGER) AS end_line FROM (SELECT p_partkey, unnest(range(p_size)) AS level FROM part)""")
def wire_selection_ranges(spark, sf_dir):
    """Chains of as many ranges as a part's size, up to fifty; parts are dealt out first, as each becomes many rows."""
    p = facts.table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    text = lambda k, c: F.concat(F.lit('{"line":'), k.cast("string"), F.lit(f',"character":{c}}}'))
    one = lambda k: F.concat(F.lit('{"range":{"start":'), text(F.lit(100) - k, 0), F.lit(',"end":'), text(F.lit(100) + k, 1), F.lit("}"))
    levels = F.sequence(F.lit(0), F.col("p_size") - 1)
    chain = F.concat(F.array_join(F.transform(levels, one), ',"parent":'), F.repeat(F.lit("}"), F.col("p_size")))
    rows = p.where("p_size > 0").select(F.col("p_partkey").cast("string").alias("file"), F.concat(F.lit("["), chain, F.lit("]")).alias("result"))
    return wire.selection_ranges(rows).select("file", "level", "start_line", "end_line")


@query("""SELECT 'f' || o_custkey AS file, CAST(o_orderkey % 200 AS INTEGER) AS start_line, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Run ' || o_orderkey END AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'test.run' END AS command FROM orders""")
def wire_code_lenses(spark, sf_dir):
    k = F.col("o_orderkey")
    item = _object(range=_range(k % 200, 0, k % 200, 1), command=F.when(k % 3 != 0, _object(title=F.concat(F.lit("Run "), k.cast("string")), command="test.run", arguments=F.array(k))))
    rows = facts.table(spark, sf_dir, "orders").withColumn("file", F.concat(F.lit("f"), F.col("o_custkey").cast("string")))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return wire.code_lenses(_in_order(rows, "file", "o_orderkey", item)).select("file", "start_line", blank("title"), blank("command"))


@query("""SELECT p_partkey AS target_id, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_name ELSE '' END AS placeholder FROM part""")
def wire_rename_targets(spark, sf_dir):
    """A placeholder; a range of a line with a character of two UTF-16 units before the name; the default."""
    p = facts.table(spark, sf_dir, "part")
    file = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    files = p.select(file.alias("file"), F.concat(F.lit("one\r\nlet 😀"), "p_name", F.lit(" = 1\r\n")).alias("content"))
    place = _range(1, 6, 1, F.length("p_name") + 6)
    k = F.col("p_partkey") % 3
    answer = F.when(k == 0, F.to_json(_object(placeholder=F.col("p_brand"), range=place))).when(k == 1, F.to_json(place)).otherwise('{"defaultBehavior":true}')
    return wire.rename_targets(p.select(F.col("p_partkey").alias("target_id"), file.alias("file"), answer.alias("result")), files)


@query("""SELECT p_partkey, CAST(length(p_name) + 2 AS INTEGER) AS "column", '😀' || p_name || ' <new>' AS content FROM part""")
def wire_utf16_columns(spark, sf_dir):
    """A column behind a character of two units, in code points; and an edit there."""
    p = facts.table(spark, sf_dir, "part").withColumn("file", F.col("p_partkey").cast("string"))
    files = p.select("file", F.concat(F.lit("😀"), "p_name", F.lit(" old")).alias("content"))
    place = p.select("p_partkey", "file", F.lit(1).alias("line"), (F.length("p_name") + 3).cast("int").alias("column"))
    from lorewalk.operators import edits

    edit = p.select("file", F.lit(0).alias("start_line"), (F.length("p_name") + 3).alias("start_char"), F.lit(0).alias("end_line"), (F.length("p_name") + 6).alias("end_char"), F.lit("<new>").alias("new_text"))
    return wire.in_code_points(place, files).join(edits.applied(edit, files), "file").select("p_partkey", "column", "content")


# Names, URIs, locations -----------------------------------------------------------


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'mod_' || CASE p_size % 5 WHEN 0 THEN 'module' WHEN 1 THEN 'fn' WHEN 2 THEN 'export' WHEN 3 THEN 'config' ELSE 'symbol' END WHEN 2 THEN 'mod_' || CASE p_size % 5 WHEN 0 THEN 'module' WHEN 1 THEN 'fn' WHEN 2 THEN 'export' WHEN 3 THEN 'config' ELSE 'symbol' END ELSE p_brand END AS name FROM part""")
def names_normalized(spark, sf_dir):
    p, k = facts.table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).when(k == 1, "").when(k == 2, "<anonymous>").otherwise(F.col("p_brand"))
    kind = F.element_at(F.array(*map(F.lit, ("module", "function", "constant", "object", "class"))), F.col("p_size") % 5 + 1)
    return p.select("p_partkey", S.normalized(name, F.lit("src/mod.rs"), kind).alias("name"))


@query("SELECT p_partkey, p_name AS name FROM part")
def names_without_type_parameters(spark, sf_dir):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat("p_name", F.lit("<T, U>(x: T)"))).when(k == 1, F.concat("p_name", F.lit(" (a<b>)"))).otherwise(F.col("p_name"))
    return facts.table(spark, sf_dir, "part").select("p_partkey", S.without_type_parameters(name).alias("name"))


@query("""SELECT doc_id, 'file://' || replace(url_encode(p), '%2F', '/') AS uri, p AS path FROM (SELECT doc_id, '/d/' || substr(translate(text, chr(10) || '~*''()!', ''), 1, 40) AS p FROM documents)""")
def uris_round_trip(spark, sf_dir):
    path = F.concat(F.lit("/d/"), F.substring(F.translate("text", "\n~*'()!", ""), 1, 40))
    coded = facts.table(spark, sf_dir, "documents").select("doc_id", S.path_to_uri(path).alias("uri"))
    return coded.withColumn("path", S.uri_to_path(F.col("uri")))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber % 7 IN (4, 5, 6) THEN '' ELSE 'src/a:b ' || l_orderkey || '.rs' END AS file, CAST(CASE WHEN l_linenumber % 7 IN (4, 5, 6) THEN -1 ELSE l_linenumber END AS INTEGER) AS line, CAST(CASE WHEN l_linenumber % 7 IN (4, 5, 6) THEN -1 WHEN l_linenumber % 7 IN (1, 2) THEN 1 ELSE l_suppkey + 1 END AS INTEGER) AS "column",
CASE l_linenumber % 7 WHEN 4 THEN 'negative line' WHEN 5 THEN 'line from 1' WHEN 6 THEN 'no position' ELSE '' END AS error FROM lineitem""")
def locations_parsed(spark, sf_dir):
    n = F.col("l_linenumber")
    file = F.concat(F.lit("src/a:b "), F.col("l_orderkey").cast("string"), F.lit(".rs"))
    number, column = n.cast("int").cast("string"), (F.col("l_suppkey") + 1).cast("string")
    text = F.when((n % 7).isin(1, 2), F.concat_ws(":", file, number)).when(n % 7 == 4, F.concat(file, F.lit(":-3"))).when(n % 7 == 5, F.concat(file, F.lit(":0:1"))).when(n % 7 == 6, file).otherwise(F.concat_ws(":", file, number, column))
    rows = facts.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", S.location(text).alias("at"))
    either = lambda c, other: F.coalesce(f"at.{c}", F.lit(other)).alias(c)
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", either("file", ""), either("line", -1), either("column", -1), either("error", ""))


@query("SELECT doc_id, n >= 2 AND octet_length(encode(l[2])) + 1 >= 10 AS valid FROM (SELECT doc_id, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n FROM documents)")
def positions_valid(spark, sf_dir):
    lines = F.split("text", "\n")
    d = facts.table(spark, sf_dir, "documents").withColumn("l", lines)
    return d.select("doc_id", F.coalesce(S.position_valid(F.size("l"), F.octet_length(F.get("l", F.lit(1))), F.lit(2), F.lit(10)), F.lit(False)).alias("valid"))


# Errors and messages --------------------------------------------------------------

_CODES = "[-32099, -32800, -32003, -32001, -32601, -32603, 7]"


@query(f"""WITH e AS (SELECT event_id, {_CODES}[event_id % 7 + 1] AS code, event_type FROM events)
SELECT event_id, code = -32800 AS cancelled, code IN (-32800, -32099, -32003, -32001) AS recoverable, code IN (-32099, -32003) OR event_type = 'error' AS needs_restart FROM e""")
def error_flags(spark, sf_dir):
    codes = F.array(*[F.lit(c) for c in (-32099, -32800, -32003, -32001, -32601, -32603, 7)])
    message = F.when(F.col("event_type") == "error", "the Server stopped").otherwise("other")
    rows = facts.table(spark, sf_dir, "events").select("event_id", X.error_flags(F.element_at(codes, (F.col("event_id") % 7 + 1).cast("int")), message).alias("f"))
    return rows.select("event_id", "f.*")


_MESSAGES = (
    (-32601, "textDocument/prepareRename", "Rename not supported. Search the text for occurrences instead."),
    (-32601, "textDocument/implementation", "Find implementations not supported. Find references instead."),
    (-32601, "x/y", "Feature not supported: x/y"),
    (-32603, " Internal error ", "Operation failed. The position may be invalid."),
    (-32603, "file not found: a", "file not found: a"),
    (-32603, "request timeout", "Request timed out. The language server may be busy."),
    (-32801, "content modified", "File changed during operation. Please retry."),
    (-32002, "not yet", "Server initializing. Try again in a moment."),
    (1, "Server error [5]: inner", "inner"),
    (2, "plain", "plain"),
)


@query("WITH m(n, text) AS (VALUES " + ", ".join(f"({k}, '{t}')" for k, (_, _, t) in enumerate(_MESSAGES)) + ") SELECT event_id, text FROM events JOIN m ON n = event_id % 10")
def errors_friendly(spark, sf_dir):
    known = spark.createDataFrame([(k, c, m) for k, (c, m, _) in enumerate(_MESSAGES)], "n long, code int, message string")
    e = facts.table(spark, sf_dir, "events").withColumn("n", F.col("event_id") % 10).join(F.broadcast(known), "n")
    return e.select("event_id", X.friendly_error(F.col("code"), F.col("message")).alias("text"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'ignore' WHEN 'click' THEN 'warn' WHEN 'signup' THEN 'info' ELSE 'debug' END AS level, event_type = 'purchase' AS ready FROM events""")
def log_lines(spark, sf_dir):
    kind = F.col("event_type")
    message = F.when(kind == "error", "an Exception").when(kind == "view", "Background analysis done").when(kind == "click", "a Warning").when(kind == "purchase", "Found 12 source files").otherwise("hello")
    params = F.to_json(_object(message=message))
    level = X.log_level(F.lit("python"), message, F.when(kind == "signup", 3))
    return facts.table(spark, sf_dir, "events").select("event_id", level.alias("level"), X.is_ready(F.lit("python"), F.lit("window/logMessage"), params).alias("ready"))


def _messages(spark, sf_dir):
    """A line for each turn: a request, a response, a notification, an error, or none of these."""
    c = facts.table(spark, sf_dir, "conversations")
    k, key = F.col("turn") % 5, F.concat(F.lit('"'), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit('"'))
    line = (
        F.when(k == 0, F.concat(F.lit('{"jsonrpc":"2.0","id":'), key, F.lit(',"method":"hover","params":{"a":1}}')))
        .when(k == 1, F.concat(F.lit('{"id":'), key, F.lit(',"result":[1]}')))
        .when(k == 2, F.lit('{"method":"note"}'))
        .when(k == 3, F.concat(F.lit('{"id":'), key, F.lit(',"result":1,"error":{"code":-1}}')))
        .otherwise("no message")
    )
    return c.select("conv_id", "turn", line.alias("value"))


@query("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'request' WHEN 1 THEN 'response' WHEN 2 THEN 'notification' WHEN 3 THEN 'response' ELSE 'invalid' END AS kind FROM conversations")
def message_kinds(spark, sf_dir):
    return rpc.kinds(_messages(spark, sf_dir)).select("conv_id", "turn", "kind")


@query("""SELECT CASE WHEN turn % 5 IN (0, 1, 3) THEN '"' || conv_id || '.' || turn || '"' ELSE '' END AS id, CASE turn % 5 WHEN 0 THEN 'hover' WHEN 2 THEN 'note' ELSE '' END AS method, CASE turn % 5 WHEN 0 THEN '' WHEN 2 THEN '' WHEN 4 THEN 'parse_error' ELSE 'invalid_request' END AS error FROM conversations""")
def rpc_requests(spark, sf_dir):
    r = rpc.requests(_messages(spark, sf_dir))
    return r.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("id", "method", "error")])


@query("""SELECT '"' || conv_id || '.' || turn || '"' AS id, CASE turn % 5 WHEN 1 THEN '[1]' ELSE '' END AS result, CASE turn % 5 WHEN 3 THEN '{"code":-1}' ELSE '' END AS error FROM conversations WHERE turn % 5 IN (1, 3)""")
def rpc_results(spark, sf_dir):
    r = rpc.results(rpc.kinds(_messages(spark, sf_dir)).where("kind = 'response'"))
    return r.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("id", "result", "error")])


@query("""SELECT '{"jsonrpc":"2.0","id":' || event_id || CASE event_type WHEN 'error' THEN ',"error":{"code":-32601,"message":"Method not found: m"}}' WHEN 'view' THEN ',"error":{"code":-32700,"message":"Parse error"}}' WHEN 'click' THEN ',"result":null}' ELSE ',"result":[1]}' END AS value FROM events""")
def rpc_responses(spark, sf_dir):
    kind = F.col("event_type")
    error = F.when(kind == "error", "method_not_found").when(kind == "view", "parse_error")
    a = facts.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.when(kind != "click", "[1]").alias("result"), error.alias("error"), F.when(kind == "error", "m").alias("detail"))
    return rpc.responses(a)


# States ---------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'ready' WHEN 'error' THEN 'timeout' ELSE 'edit' END AS event FROM events),
w AS (SELECT *, max(CASE WHEN event = 'open' THEN event_id END) OVER p AS opened, max(CASE WHEN event IN ('ready', 'timeout') THEN event_id END) OVER p AS closed, max(CASE WHEN event = 'edit' THEN event_id END) OVER p AS edited,
  arg_max(event, event_id) FILTER (event IN ('ready', 'timeout')) OVER p AS settled FROM e WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, CASE WHEN opened IS NULL AND closed IS NULL THEN 'not_started' WHEN closed IS NULL OR opened > closed THEN 'in_progress' WHEN edited > closed THEN 'stale' WHEN settled = 'ready' THEN 'ready' ELSE 'timed_out' END AS state FROM w""")
def indexing_states(spark, sf_dir):
    kind = F.col("event_type")
    event = F.when(kind == "click", "open").when(kind == "view", "ready").when(kind == "error", "timeout").otherwise("edit")
    e = facts.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), event.alias("event"))
    return folds.indexing_state(e).select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "state")


@query("""SELECT CAST(q.event_id AS VARCHAR) AS id, coalesce(CAST(a.event_id AS VARCHAR), '') AS result, a.event_id IS NULL AS cancelled FROM events q LEFT JOIN events a ON a.event_id = q.event_id + 1 AND a.ts >= q.ts AND a.ts <= q.ts + INTERVAL 120 SECOND AND a.event_id % 2 = 1 WHERE q.event_id % 2 = 0""")
def rpc_correlated(spark, sf_dir):
    """Every second event is a request by number, the one after it its response by the same id as a text, in time or not."""
    e = facts.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    q = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), "ts")
    a = e.where("event_id % 2 = 1").select((F.col("event_id") - 1).cast("string").alias("id"), "ts", F.col("event_id").cast("string").alias("result"))
    return folds.correlated(q, a).select("id", F.coalesce("result", F.lit("")).alias("result"), "cancelled")


@query("""WITH q AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type <> 'error'), s AS (SELECT user_id, ts, value > 50 AS expected FROM events WHERE event_type = 'error'),
m AS (SELECT q.id, q.user_id, arg_min(s.expected, s.ts) AS expected FROM q JOIN s ON s.user_id = q.user_id AND q.ts <= s.ts WHERE q.id % 3 <> 0 GROUP BY 1, 2)
SELECT id, CASE WHEN expected THEN -32800 ELSE -32099 END AS code, CASE WHEN expected THEN 'request cancelled' ELSE user_id || ' ended unexpectedly' END AS message FROM m""")
def rpc_terminated(spark, sf_dir):
    e = facts.table(spark, sf_dir, "events").withColumn("server", F.col("user_id").cast("string"))
    q = e.where("event_type <> 'error'").select(F.col("event_id").alias("id"), "server", "ts", F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("answered_at"))
    return folds.terminated(q, e.where("event_type = 'error'").select("server", "ts", (F.col("value") > 50).alias("expected")))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS key FROM events GROUP BY user_id")
def cache_victims(spark, sf_dir):
    e = facts.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("key"), F.col("ts").alias("last_accessed"))
    return folds.victim(e, "user_id")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'not_running' WHEN 'click' THEN 'shutting_down' WHEN 'view' THEN 'initializing' ELSE 'healthy' END AS status FROM events")
def health_states(spark, sf_dir):
    kind = F.col("event_type")
    return facts.table(spark, sf_dir, "events").select("event_id", X.health_status(kind != "error", kind == "click", kind != "view").alias("status"))


@query("""WITH e AS (SELECT user_id, event_id, event_type IN ('error', 'view') AS bad FROM events), l AS (SELECT user_id, arg_max(bad, event_id) AS bad, max(event_id) FILTER (NOT bad) AS good FROM e GROUP BY user_id)
SELECT e.user_id, min(event_id) AS since FROM e JOIN l ON l.user_id = e.user_id WHERE l.bad AND e.bad AND (good IS NULL OR event_id > good) GROUP BY e.user_id""")
def servers_unhealthy(spark, sf_dir):
    e = facts.table(spark, sf_dir, "events").select(F.col("user_id").alias("server"), F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "view")).alias("healthy"))
    return folds.unhealthy(e).select(F.col("server").alias("user_id"), "since")
