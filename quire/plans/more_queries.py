"""Further queries: units, node tables, layout, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import layout, text
from quire.operators import blocks, catalog, preprocess, select, units
from quire.plans.queries import query, table
from quire.sources import readers
from quire.streaming import convert


@query("""
WITH u AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 10 = 0 THEN event_id END AS unit FROM events),
l AS (SELECT user_id, event_id, unit, last_value(unit IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN unit IS NULL THEN 1 ELSE 0 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unit_id FROM u)
SELECT event_id, unit_id FROM l WHERE unit IS NULL
""")
def innermost_unit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    starts = e.where("event_id % 10 = 0").select("user_id", "ts", F.col("event_id").alias("unit_id"))
    return units.innermost(e.where("event_id % 10 <> 0").select("event_id", "user_id", "ts"), starts, "user_id", "ts").select("event_id", "unit_id")


@query("SELECT conv_id, turn, number, CASE WHEN p IS NULL OR number = p + 1 THEN NULL WHEN number = p THEN 'repeat' WHEN number < p THEN 'backward' ELSE 'gap' END AS problem FROM (SELECT conv_id, turn, number, lag(number) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, turn + CASE WHEN (conv_id + turn) % 5 = 0 THEN 2 WHEN (conv_id + turn) % 7 = 0 THEN -1 ELSE 0 END AS number FROM conversations))")
def sequence_check(spark, sf_dir):
    """Turns with some of their numbers moved up or down."""
    at = F.col("conv_id") + F.col("turn")
    c = table(spark, sf_dir, "conversations").withColumn("number", F.col("turn") + F.when(at % 5 == 0, 2).when(at % 7 == 0, -1).otherwise(0))
    return units.sequence_check(c, ["conv_id"], "turn", "number").select("conv_id", "turn", "number", "problem")


@query("SELECT c_custkey AS passage_id, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderkey BETWEEN c_custkey AND c_custkey * 50")
def passages(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("passage_id"), F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("low"), (F.col("c_custkey") * 50).alias("high"))
    return units.passages(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), c, "o_custkey", "o_orderkey").select("passage_id", "o_orderkey")


@query("SELECT doc_id, o_orderkey, CASE WHEN n <= 26 THEN chr((96 + n)::INT) ELSE chr((96 + (n - 1) // 26)::INT) || chr((97 + (n - 1) % 26)::INT) END AS caller FROM (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders)")
def note_callers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id")
    return units.callers(o, ["doc_id", "o_orderstatus"], "o_orderkey").select("doc_id", "o_orderkey", "caller")


@query("SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 4 AS number FROM orders")
def stepped_markers(spark, sf_dir):
    """Orders of a customer as bare markers after a labelled one."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("@5 first\n"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("o_orderkey")), F.lit(2), F.size(F.collect_list("o_orderkey"))), lambda k: F.concat(F.lit("@ order "), k.cast("string"))), "\n")).alias("text"))
    return units.stepped(units.markers(preprocess.lines(o))).select("doc_id", "number")


@query("""
WITH u AS (SELECT l_orderkey AS doc_id, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS pos, (l_linenumber - 1) % 3 AS depth FROM lineitem),
d AS (SELECT DISTINCT doc_id, pos, depth FROM u)
SELECT a.doc_id, a.pos, min(b.pos) AS end_pos FROM d a LEFT JOIN d b ON b.doc_id = a.doc_id AND b.pos > a.pos AND b.depth <= a.depth GROUP BY 1, 2
""")
def unit_intervals(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"), ((F.col("l_linenumber") - 1) % 3).alias("depth")).distinct()  # noqa: E741
    return units.intervals(l).select("doc_id", "pos", "end_pos")


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'Ps:' || s_suppkey || ':1–3' ELSE 'Ps:' || s_suppkey || ':1–' || (s_suppkey + 1) || ':2' END AS cited FROM supplier")
def citations(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    low = F.array(F.lit("Ps"), k, F.lit("1"))
    high = F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("Ps"), k, F.lit("3"))).otherwise(F.array(F.lit("Ps"), (F.col("s_suppkey") + 1).cast("string"), F.lit("2")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", units.citation(low, high).alias("cited"))


@query("SELECT coalesce(a.k, b.k) AS k, a.t AS left_text, b.t AS right_text FROM (SELECT n_nationkey AS k, n_name AS t FROM nation WHERE n_regionkey <> 1) a FULL JOIN (SELECT n_nationkey AS k, lower(n_name) AS t FROM nation WHERE n_regionkey <> 2) b ON a.k = b.k")
def parallel_texts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey", F.col("n_name").alias("text"))
    return units.aligned(n.where("n_regionkey <> 1"), n.where("n_regionkey <> 2").withColumn("text", F.lower("text")), ["k"])


@query("SELECT p_partkey, 0 AS kind, p_size AS first, 1 AS second FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 1, p_size, NULL FROM part WHERE p_partkey % 2 = 1")
def label_keys(spark, sf_dir):
    label = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("a"))).otherwise(F.lower(text.to_roman("p_size")))
    key = units.union_key(label, units.int_key, units.roman_key)
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key")).select("p_partkey", F.get("key", F.lit(0)).alias("kind"), F.get("key", F.lit(1)).alias("first"), F.get("key", F.lit(2)).alias("second"))


def _order_documents(spark, sf_dir):
    """Customers as documents of sections (by order status) with lists of their orders."""
    o = table(spark, sf_dir, "orders")
    item = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("* order "), k.cast("string"))), "\n")
    part = o.groupBy("o_custkey", "o_orderstatus").agg(F.concat(F.lit("== "), "o_orderstatus", F.lit("\n\n[.orders]\n"), item, F.lit("\n")).alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderstatus", "part"))), lambda r: r["part"]), "\n")
    return part.groupBy("o_custkey").agg(F.concat(F.lit("= Orders\n\n"), body).alias("text")).select(F.col("o_custkey").alias("doc_id"), "text")


@query("SELECT o_custkey::VARCHAR AS doc_id, 'document' AS context, 1 AS n FROM orders GROUP BY 1 UNION ALL SELECT o_custkey::VARCHAR, 'section', count(DISTINCT o_orderstatus) FROM orders GROUP BY 1 UNION ALL SELECT o_custkey::VARCHAR, 'ulist', count(DISTINCT o_orderstatus) FROM orders GROUP BY 1 UNION ALL SELECT o_custkey::VARCHAR, 'list_item', count(*) FROM orders GROUP BY 1")
def parsed_nodes(spark, sf_dir):
    return blocks.parse(_order_documents(spark, sf_dir)).groupBy("doc_id", "context").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey::VARCHAR AS doc_id, 'order ' || o_orderkey AS source FROM orders WHERE o_orderstatus = 'F'")
def descendants(spark, sf_dir):
    """List items below the sections titled F."""
    nodes = blocks.parse(_order_documents(spark, sf_dir))
    tops = select.find_by(nodes, context="section").where("title = 'F'")
    return select.find_by(select.descendants(nodes, tops), context="list_item").select("doc_id", "source")


@query("SELECT o_custkey::VARCHAR AS doc_id, count(DISTINCT o_orderstatus) AS lists FROM orders GROUP BY 1")
def find_by_role(spark, sf_dir):
    return select.find_by(blocks.parse(_order_documents(spark, sf_dir)), role="orders").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lists"))


@query("""
WITH p AS (SELECT o_custkey AS c, o_orderstatus AS s, string_agg('<li>' || chr(10) || '<p>order ' || o_orderkey || '</p>' || chr(10) || '</li>' || chr(10), '' ORDER BY o_orderkey) AS items FROM orders GROUP BY 1, 2),
q AS (SELECT c, string_agg('<div class="sect1">' || chr(10) || '<h2>' || s || '</h2>' || chr(10) || '<div class="sectionbody">' || chr(10) || '<div class="ulist orders">' || chr(10) || '<ul>' || chr(10) || items || '</ul>' || chr(10) || '</div>' || chr(10) || '</div>' || chr(10) || '</div>' || chr(10), '' ORDER BY s) AS body FROM p GROUP BY c)
SELECT c::VARCHAR AS doc_id, '<h1>Orders</h1>' || chr(10) || body AS html FROM q
""")
def html_documents(spark, sf_dir):
    from quire.plans import render

    return render.to_html(blocks.parse(_order_documents(spark, sf_dir)))


@query("SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    return convert.counts_by_window(table(spark, sf_dir, "events"), "ts", "event_type")


@query("SELECT p_partkey, regexp_replace(p_name, '[ ]', '%20', 'g') AS encoded, 'p' || p_partkey AS root, '.tar' AS ending, 'p' || p_partkey || '.tar' AS base FROM part")
def path_parts(spark, sf_dir):
    p = F.concat(F.lit("a.b/c/p"), F.col("p_partkey").cast("string"), F.lit(".tar"))
    return table(spark, sf_dir, "part").select("p_partkey", text.encode_spaces("p_name").alias("encoded"), text.rootname(text.basename(p)).alias("root"), text.extension(p).alias("ending"), text.basename(p).alias("base"))


@query("SELECT s_suppkey, 'docs/' || s_nationkey || '/x.txt' AS inside, NULL::VARCHAR AS outside FROM supplier")
def resolved_paths(spark, sf_dir):
    n = F.col("s_nationkey").cast("string")
    return table(spark, sf_dir, "supplier").select("s_suppkey", readers.resolve_path(F.concat(F.lit("docs/./"), n, F.lit("/y")), F.lit("../x.txt"), "docs").alias("inside"), readers.resolve_path(F.concat(F.lit("docs/"), n), F.lit("../../etc"), "docs").alias("outside"))


@query("SELECT n_nationkey, 'data:image/png;base64,' || base64(encode(n_name)) AS uri FROM nation")
def data_uris(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", readers.data_uri(F.lit("a/b.PNG"), F.encode("n_name", "UTF-8")).alias("uri"))


@query("""
WITH b AS (SELECT l_orderkey AS doc_id, l_suppkey % 3 AS k, min(l_linenumber) AS f, max(l_linenumber) AS t FROM lineitem GROUP BY 1, 2),
c AS (SELECT doc_id, string_agg('{"at":"b' || k || '","first":' || f || ',"last":' || t || '}', ',' ORDER BY f, t, k) AS body FROM b GROUP BY doc_id),
p AS (SELECT l_orderkey AS doc_id, string_agg('"p' || l_linenumber || '"', ',' ORDER BY l_linenumber) AS labels FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1)
SELECT c.doc_id, '{"labels":[' || labels || '],"blocks":[' || body || ']}' AS map FROM c JOIN p ON p.doc_id = c.doc_id
""")
def page_map(spark, sf_dir):
    """Pages of blocks as JSON: orders as documents, lines as pages, suppliers as blocks."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return catalog.page_map(l.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("b"), (F.col("l_suppkey") % 3).cast("string")).alias("at"), F.col("l_linenumber").alias("page"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("label")))


@query(r"SELECT event_id, sha256('made TIME' || chr(10) || regexp_replace('Last updated today', '(?m)^Last updated .*$', 'Last updated TIME') || event_type) AS digest FROM (SELECT event_id, chr(10) || event_type AS event_type FROM events)")
def checksums(spark, sf_dir):
    """Outputs that say when they were made, by what is the same from run to run."""
    out = F.concat(F.lit("made "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC\nLast updated today\n"), "event_type")
    return table(spark, sf_dir, "events").select("event_id", text.golden(out).alias("digest"))


#: Codes and the patterns of their messages.
RULES = [("overdue", "^1-"), ("soon", "^[23]-"), ("late", "^4")]


@query("SELECT o_orderkey, o_orderpriority[1:1]::BIGINT AS number, CASE WHEN o_orderpriority LIKE '1-%' THEN 'overdue' WHEN o_orderpriority LIKE '2-%' OR o_orderpriority LIKE '3-%' THEN 'soon' WHEN o_orderpriority LIKE '4%' THEN 'late' ELSE 'other' END AS code FROM orders WHERE o_orderstatus = 'F'")
def diagnostics(spark, sf_dir):
    """Messages with the code of the first rule that matches, those of one severity."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "severity")
    return select.diagnostics(o, RULES, severity="F", message="o_orderpriority").select("o_orderkey", text.leading_int("o_orderpriority").alias("number"), "code")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, count(*) AS callouts FROM lineitem GROUP BY 1, 2")
def callout_links(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    marks = l.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("list_no"), F.col("l_linenumber").alias("ordinal"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"))
    items = l.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("list_no"), F.col("l_linenumber").alias("ordinal")).distinct()
    return catalog.callout_links(marks, items).select("doc_id", "ordinal", F.size(F.split("ids", " ")).cast("bigint").alias("callouts"))


@query("SELECT c_custkey, c_mktsegment || ',lead' AS added, 'lead' AS removed, true AS held FROM customer")
def role_sets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.array("c_mktsegment").alias("roles"), "c_mktsegment")
    added = c.withColumn("roles", select.add_role("lead")).withColumn("roles", select.add_role("lead"))
    return added.select("c_custkey", F.array_join("roles", ",").alias("added"), F.array_join(F.array_remove("roles", F.col("c_mktsegment")), ",").alias("removed"), F.array_contains("roles", "lead").alias("held"))


@query()
def filled_lines(spark, sf_dir):
    """Texts filled to 72 characters; which word ends a line depends on all before it, so the tests hold it against a plain loop."""
    return layout.fill(table(spark, sf_dir, "documents"), 72)


@query()
def hyphenated_words(spark, sf_dir):
    """Distinct part words parted by a small set of patterns."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return layout.hyphenate(words, ["1na", "n2d", "a1t", "1te", "e1r", ".in1", "1tion."])


@query("SELECT l_orderkey, arg_max(l_partkey, l_quantity * 100000000 - l_partkey) AS l_partkey FROM lineitem GROUP BY 1")
def best_reading(spark, sf_dir):
    """The reading of highest score, the lowest part among equals."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")  # noqa: E741
    return units.best(l, ["l_orderkey"], "l_quantity", "l_partkey").select("l_orderkey", "l_partkey")
