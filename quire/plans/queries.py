"""Queries over the star schema and the text tables, one or more per kind of operator, with SQL for DuckDB.

The tables hold prose and keys, not markup; where an operator reads markup,
the query writes it from the tables' columns first and then parses it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import inline, text
from quire.operators import catalog, preprocess, sections, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPECIAL = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("""
WITH k AS (SELECT c_custkey // 50 AS doc_id, c_custkey, c_name, row_number() OVER (PARTITION BY c_custkey // 50, c_custkey % 3 ORDER BY c_custkey) AS ord, c_custkey % 3 AS g FROM customer),
g AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS nth FROM (SELECT DISTINCT doc_id, g FROM k))
SELECT doc_id, 1 AS level, nth || '.' AS sectnum, 'Group ' || g AS title FROM g
UNION ALL SELECT k.doc_id, 2, nth || '.' || ord || '.', c_name FROM k JOIN g ON g.doc_id = k.doc_id AND g.g = k.g
""")
def section_outline(spark, sf_dir):
    """Flagship: numbered tables of contents of documents made of groups of customers, fifty to a document, so that documents grow in number with the table."""
    c = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 50).alias("doc_id"), "c_custkey", "c_name", (F.col("c_custkey") % 3).alias("g"))
    body = lambda items: F.array_join(F.transform(items, lambda r: F.concat(F.lit("=== "), r["c_name"], F.lit("\nText.\n"))), "\n")
    # one grouping by document: its groups are parts of one sorted list
    listed = c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("g", "c_custkey", "c_name"))).alias("all"))
    part = lambda g: F.concat(F.lit("== Group "), g.cast("string"), F.lit("\n\n"), body(F.filter("all", lambda r: r["g"] == g)))
    whole = F.array_join(F.transform(F.array_distinct(F.transform("all", lambda r: r["g"])), part), "\n")
    docs = listed.select("doc_id", F.concat(F.lit("= Book "), F.col("doc_id").cast("string"), F.lit("\n\n"), whole).alias("text"))
    return sections.outline(preprocess.lines(docs), 2).select("doc_id", "level", "sectnum", "title")


@query(f"SELECT doc_id, {SPECIAL} AS html FROM documents")
def special_characters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.special_characters("text").alias("html"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags("html").alias("plain"))


@query("SELECT page_id, trim(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS plain FROM pages")
def plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.plain_text("html").alias("plain"))


@query("""
WITH t AS (SELECT unnest(regexp_extract_all(regexp_replace(html, '<!--[\\s\\S]*?-->', '', 'g'), '</?[a-zA-Z][^\\s/>]*(?:"[^"]*"|''[^'']*''|[^"''>])*>')) AS tag FROM pages)
SELECT lower(regexp_extract(tag, '^</?([^\\s/>]+)', 1)) AS name, CASE WHEN tag LIKE '</%' THEN 'end' WHEN tag LIKE '%/>' THEN 'empty' ELSE 'start' END AS kind, count(*) AS n FROM t GROUP BY 1, 2
""")
def tag_counts(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select(F.explode(text.xml_tags("html")).alias("tag"))
    return tags.groupBy("tag.name", "tag.kind").agg(F.count(F.lit(1)).alias("n"))


TRIMMED = "rtrim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents) SELECT doc_id, line_no, {TRIMMED} AS text FROM x")
def document_lines(spark, sf_dir):
    return preprocess.lines(table(spark, sf_dir, "documents"))


@query(f"""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
m AS (SELECT doc_id, line_no, {TRIMMED} AS t, sum(CASE WHEN {TRIMMED} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM x)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(line_no)) AS par_no, min(line_no) AS first_line, max(line_no) AS last_line, string_agg(t, chr(10) ORDER BY line_no) AS text FROM m WHERE t <> '' GROUP BY doc_id, island
""")
def paragraphs(spark, sf_dir):
    return preprocess.paragraphs(preprocess.lines(table(spark, sf_dir, "documents")))


@query("SELECT event_id, event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS text FROM events WHERE event_type IN ('click', 'purchase') UNION ALL SELECT event_id, event_type, 'seen' FROM events WHERE event_type NOT IN ('click', 'view')")
def conditionals(spark, sf_dir):
    """Each event as a document of nested conditionals, with its type as an attribute."""
    e = table(spark, sf_dir, "events")
    body = "ifdef::click,purchase[]\nifeval::[{value} > 50]\nhigh\nendif::[]\nifeval::[{value} <= 50]\nlow\nendif::[]\nendif::[]\nifndef::click,view[seen]\nifdef::click+view[]\nnever\nendif::[]"
    docs = e.select(F.col("event_id").alias("doc_id"), "event_type", F.lit(body).alias("text"), F.map_from_arrays(F.array("event_type", F.lit("value")), F.array(F.lit(""), F.format_string("%.9f", "value"))).alias("attrs"))
    return preprocess.conditional_texts(docs, F.col("attrs")).select(F.col("doc_id").alias("event_id"), "event_type", "text")


@query(f"WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents) SELECT doc_id, line_no, {TRIMMED} AS text FROM x WHERE line_no BETWEEN 2 AND 3 OR line_no = 5 OR line_no >= 8")
def include_lines(spark, sf_dir):
    return preprocess.lines(table(spark, sf_dir, "documents")).where(preprocess.selected_lines("2..3;5;8.."))


@query("SELECT n_nationkey AS doc_id, n_name AS text FROM nation WHERE n_regionkey IN (1, 3)")
def include_tags(spark, sf_dir):
    """Nations in regions tagged by their key; two tags are chosen, one of them only in part."""
    n = table(spark, sf_dir, "nation")
    body = F.concat(F.lit("// tag::r"), F.col("n_regionkey").cast("string"), F.lit("[]\n"), "n_name", F.lit("\n// tag::no[]\nhidden\n// end::no[]\n// end::r"), F.col("n_regionkey").cast("string"), F.lit("[]\noutside"))
    rows = preprocess.lines(n.select(F.col("n_nationkey").alias("doc_id"), body.alias("text")))
    return preprocess.tagged_lines(rows, "r1;r3;!no").select("doc_id", "text")


@query("SELECT r_regionkey AS doc_id, n_nationkey AS key, n_name AS text FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, NULL, 'Unresolved directive: include::none[]' FROM region")
def nested_includes(spark, sf_dir):
    """Regions include a list that includes their nations' files; one file is missing."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    root = r.select(F.col("r_regionkey").alias("doc_id"), F.concat(F.lit("include::list-"), F.col("r_regionkey").cast("string"), F.lit("[]\ninclude::none[]\ninclude::gone[opts=optional]")).alias("text"))
    lists = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: F.concat(F.lit("include::n-"), k.cast("string"), F.lit("[lines=2]"))), "\n").alias("text")).select(F.concat(F.lit("list-"), F.col("n_regionkey").cast("string")).alias("doc_id"), "text")
    leaves = n.select(F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("doc_id"), F.concat(F.lit("first\n"), "n_name", F.lit("\nlast")).alias("text"))
    files = preprocess.lines(lists.unionByName(leaves)).withColumnRenamed("doc_id", "path")
    out = preprocess.expand_includes(preprocess.lines(root), files)
    return out.select("doc_id", F.nullif(F.regexp_extract(F.coalesce("path", F.lit("")), r"n-(\d+)", 1), F.lit("")).cast("int").alias("key"), "text")


@query("SELECT c_custkey, 'Dear ' || c_name || ', {unknown} ' || c_mktsegment || ' [' || c_nationkey || ']' AS kept, 'Dear ' || c_name || ',  ' || c_mktsegment || ' [' || c_nationkey || ']' AS dropped FROM customer")
def attribute_references(spark, sf_dir):
    attrs = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    t = F.lit("Dear {name}, {unknown} {Segment} {startsb}{nation}{endsb}")
    return table(spark, sf_dir, "customer").select("c_custkey", inline.attributes(t, attrs).alias("kept"), inline.attributes(t, attrs, "drop").alias("dropped"))


@query("SELECT o_custkey AS doc_id, count(*) AS entries, max(o_orderkey) AS last FROM orders GROUP BY 1")
def attribute_entries(spark, sf_dir):
    """The last of a document's entries of one name stands at its end."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit(":order: "), k.cast("string"))), "\n").alias("text"))
    entries = preprocess.attribute_entries(preprocess.lines(o))
    counts = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries"))
    ends = preprocess.attributes_at_end(entries).select(F.col("doc_id").alias("d"), F.col("attrs")["order"].cast("bigint").alias("last"))
    return counts.join(ends, F.col("doc_id") == F.col("d")).select("doc_id", "entries", "last")


WORDS = "list_filter(string_split(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'), ' '), lambda w: w <> '')"
#: Marks, and what they open and close, in the order in which a text's words take them.
MARKS = [("*", "<strong>", "</strong>"), ("_", "<em>", "</em>"), ("`", "<code>", "</code>"), ("#", "<mark>", "</mark>"), ("**", "<strong>", "</strong>"), ("__", "<em>", "</em>"), ("``", "<code>", "</code>"), ("##", "<mark>", "</mark>"), ("^", "<sup>", "</sup>"), ("~", "<sub>", "</sub>")]
_MARKED = "CASE (i - 1) % 10 " + " ".join(f"WHEN {i} THEN '{o}' || w[i] || '{c}'" for i, (_, o, c) in enumerate(MARKS)) + " END"


@query(f"WITH x AS (SELECT doc_id, {WORDS} AS w FROM documents), y AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM x) SELECT doc_id, string_agg({_MARKED}, ' ' ORDER BY i) || ' <strong class=\"lead\">x</strong> a*b*c' AS html FROM y GROUP BY doc_id")
def quote_marks(spark, sf_dir):
    """All words of each text, marked in turns."""
    w = F.filter(F.split(F.regexp_replace("text", "[^a-zA-Z]+", " "), " "), lambda x: x != "")
    mark = F.array(*[F.lit(m) for m, _, _ in MARKS])
    marked = F.transform(w, lambda x, i: F.concat(F.get(mark, i % len(MARKS)), x, F.get(mark, i % len(MARKS))))
    d = table(spark, sf_dir, "documents").where(F.size(w) > 0)
    return d.select("doc_id", inline.quotes(F.concat(F.array_join(marked, " "), F.lit(" [.lead]*x* a*b*c"))).alias("html"))


@query("SELECT p_partkey, p_name || '&#169; &#174; &#8482;&#8201;&#8212;&#8201;' || p_brand || '&#8230;&#8203; it&#8217;s &#8594; &#8656; &copy; &amp; a&#8212;&#8203;b (C)' AS html FROM part")
def replacements(spark, sf_dir):
    t = F.concat("p_name", F.lit("(C) (R) (TM) -- "), "p_brand", F.lit("... it's -> <= &copy; & a--b \\(C)"))
    return table(spark, sf_dir, "part").select("p_partkey", inline.replacements(text.special_characters(t)).alias("html"))


@query("SELECT c_custkey, '<kbd>Ctrl</kbd> <span class=\"keyseq\"><kbd>Ctrl</kbd>+<kbd>' || upper(c_mktsegment[1:1]) || '</kbd></span> <b class=\"button\">OK</b> <a href=\"https://x.org/' || c_custkey || '\">' || c_name || '</a> <a href=\"https://x.org/a\" class=\"bare\">https://x.org/a</a>, <a href=\"mailto:c' || c_custkey || '@x.org\">c' || c_custkey || '@x.org</a>' AS html FROM customer")
def inline_macros(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    t = F.concat(F.lit("kbd:[Ctrl] kbd:[Ctrl+"), F.upper(F.left("c_mktsegment", F.lit(1))), F.lit("] btn:[OK] https://x.org/"), key, F.lit("["), "c_name", F.lit("] https://x.org/a, c"), key, F.lit("@x.org"))
    return table(spark, sf_dir, "customer").select("c_custkey", inline.macros(t).alias("html"))


@query("SELECT s_suppkey, s_name || '<br>' || chr(10) || 'next' AS one, s_name || '<br>' || chr(10) || 'b<br>' || chr(10) || 'c' AS every FROM supplier")
def hard_breaks(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", inline.post_replacements(F.concat("s_name", F.lit(" +\nnext"))).alias("one"), inline.post_replacements(F.concat("s_name", F.lit("\nb\nc")), True).alias("every"))


def _supplier_tables(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 20).alias("nation"), F.col("s_suppkey").cast("string").alias("k"), "s_name", F.col("s_nationkey").cast("string").alias("n"))

    def build(fmt, line, head):
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("k").cast("int").alias("o"), line.alias("line")))), lambda r: r["line"]), "\n")
        return s.groupBy("nation").agg(F.concat(F.lit(head), lines).alias("text")).select(F.concat(F.lit(fmt + "-"), F.col("nation").cast("string")).alias("table_id"), "text", F.lit(fmt).alias("format"), F.lit(0).alias("columns"), F.lit(None).cast("boolean").alias("header"), F.lit(False).alias("footer"))

    csv = build("csv", F.concat("k", F.lit(',"'), "s_name", F.lit(' ""x"", y\nz", '), "n"), "key,name,nation\n\n")
    tsv = build("tsv", F.concat_ws("\t", "k", "s_name", "n"), "key\tname\tnation\n\n")
    dsv = build("dsv", F.concat("k", F.lit(":"), "s_name", F.lit("\\:d:"), "n"), "key:name:nation\n\n")
    psv = build("psv", F.concat(F.lit("|"), "k", F.lit(" |"), "s_name", F.lit("\\|p\n|"), "n"), "|key |name |nation\n\n")
    return csv.unionByName(tsv).unionByName(dsv).unionByName(psv)


@query("""
WITH s AS (SELECT s_suppkey // 20 AS t, s_nationkey AS n, s_suppkey AS k, s_name AS v, row_number() OVER (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey) AS r FROM supplier),
f AS (SELECT unnest(['csv', 'tsv', 'dsv', 'psv']) AS f),
c AS (SELECT f || '-' || t AS table_id, 'body' AS part, r AS row, unnest([0, 1, 2]) AS col, unnest([k::VARCHAR, v || CASE f WHEN 'csv' THEN ' "x", y' || chr(10) || 'z' WHEN 'dsv' THEN ':d' WHEN 'psv' THEN '|p' ELSE '' END, n::VARCHAR]) AS text FROM s, f)
SELECT table_id, part, row::INT AS row, col::INT AS col, text FROM c
UNION ALL SELECT f || '-' || t, 'head', 0, unnest([0, 1, 2]), unnest(['key', 'name', 'nation']) FROM (SELECT DISTINCT t FROM s), f
""")
def table_cells(spark, sf_dir):
    """Suppliers written as CSV, TSV, DSV and PSV tables with an implicit header, and read back."""
    return tables.parse(_supplier_tables(spark, sf_dir)).select("table_id", "part", "row", "col", "text")


@query("SELECT f || '-' || s_suppkey // 20 AS table_id, (count(*) + 1)::INT AS rows, 3 AS columns FROM supplier, (SELECT unnest(['csv', 'tsv', 'dsv', 'psv']) AS f) GROUP BY 1")
def table_sizes(spark, sf_dir):
    return tables.counts(tables.parse(_supplier_tables(spark, sf_dir)))


@query("""
WITH w AS (SELECT p_brand AS table_id, p_partkey AS idx, p_size AS width, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS back FROM part),
s AS (SELECT *, floor(round(width * 100.0::DOUBLE / sum(width) OVER (PARTITION BY table_id) * 10000, 6)) / 10000 AS share FROM w)
SELECT table_id, idx, round(CASE WHEN back = 1 THEN 100 - (sum(share) OVER (PARTITION BY table_id) - share) ELSE share END, 4) AS pcwidth FROM s
""")
def column_widths(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("idx"), F.col("p_size").alias("width"))
    return tables.column_widths(p).select("table_id", "idx", F.round("pcwidth", 4).alias("pcwidth"))


@query("SELECT p_partkey, unnest([0, 1, 2, 3, 4])::INT AS idx, unnest([p_size, p_size, 2, -1, 15]) AS width, unnest(['center', 'center', 'left', 'left', 'right']) AS halign, unnest(['bottom', 'bottom', 'top', 'top', 'top']) AS valign, unnest(['strong', 'strong', 'none', 'none', 'emphasis']) AS style FROM part")
def column_specs(spark, sf_dir):
    spec = F.concat(F.lit("2*^.>"), F.col("p_size").cast("string"), F.lit("s, 2,~,>15%e"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(tables.column_specs(spec)).alias("idx", "s"))
    return p.select("p_partkey", "idx", "s.width", "s.halign", "s.valign", "s.style")


@query("SELECT o_custkey AS doc_id, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS value FROM orders")
def counters(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("ord"))
    return catalog.counters(o).select("doc_id", "ord", "value")


@query("""
WITH b AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE o_orderstatus WHEN 'O' THEN 'image' WHEN 'F' THEN 'table' ELSE 'example' END AS context, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS title FROM orders),
n AS (SELECT *, sum(CASE WHEN title IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, context ORDER BY ord) AS n FROM b)
SELECT doc_id, ord, CASE WHEN title IS NOT NULL THEN CASE context WHEN 'image' THEN 'Figure' WHEN 'table' THEN 'Table' ELSE 'Example' END || ' ' || n || '. ' END AS caption FROM n
""")
def captions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "O", "image").when(F.col("o_orderstatus") == "F", "table").otherwise("example").alias("context"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("title"),
    )
    return catalog.captions(o).select("doc_id", "ord", "caption")


@query("""
WITH n AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'p' || o_orderkey % 3 END AS id FROM orders),
m AS (SELECT *, id IS NOT NULL AND ord > min(ord) OVER (PARTITION BY doc_id, id) AS is_ref FROM n),
c AS (SELECT *, sum(CASE WHEN is_ref THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS c FROM m)
SELECT doc_id, ord, is_ref, CASE WHEN is_ref THEN min(CASE WHEN NOT is_ref THEN c END) OVER (PARTITION BY doc_id, id) ELSE c END::BIGINT AS number FROM c
""")
def footnote_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string"))).alias("id"))
    return catalog.numbered_footnotes(o).select("doc_id", "ord", "is_ref", "number")


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' ELSE 'VII' END AS roman, l_linenumber AS back, chr(96 + l_linenumber::INT) AS alpha FROM lineitem")
def list_markers(spark, sf_dir):
    roman = text.to_roman("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", roman.alias("roman"), text.from_roman(roman).alias("back"), text.to_alpha("l_linenumber").alias("alpha"))


@query("SELECT l_orderkey % 100 AS doc_id, l_orderkey AS ord, l_linenumber AS nth, CASE WHEN l_partkey % 2 = 0 THEN 'order-' || l_orderkey END AS resolved_id FROM lineitem")
def cross_references(spark, sf_dir):
    """Line items refer to orders, written and parsed as inline references; odd parts refer to nothing."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    body = F.concat(F.lit("see <<"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("order-"), F.col("l_orderkey").cast("string"))).otherwise(F.lit("none-1")), F.lit(",the order>> now"))
    refs = l.select((F.col("l_orderkey") % 100).alias("doc_id"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("nth"), F.explode(inline.xrefs(body)).alias("x")).select("doc_id", "ord", "nth", "x.target")
    targets = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("doc_id"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("title"), F.col("o_orderkey").alias("ord"))
    return catalog.resolve(refs, targets).select("doc_id", "ord", "nth", "resolved_id")


@query("SELECT l_orderkey AS doc_id, count(*) AS missing FROM lineitem WHERE l_suppkey % 7 = 0 GROUP BY 1")
def unresolved_references(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("target"))  # noqa: E741
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.concat(F.lit("s"), k.cast("string")))).alias("id"))
    return catalog.unresolved(l, known).groupBy("doc_id").agg(F.count(F.lit(1)).alias("missing"))


@query("""
WITH f AS (SELECT p_brand AS doc_id, p_name AS title, min(p_partkey) AS k FROM part GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '[ A-Z]') THEN 'part-' || f.k END AS resolved_id FROM part JOIN f ON f.doc_id = p_brand AND f.title = p_name
""")
def natural_references(spark, sf_dir):
    """References by title: the first part of a name wins."""
    p = table(spark, sf_dir, "part")
    targets = p.select(F.col("p_brand").alias("doc_id"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord"))
    return catalog.resolve(p.select("p_partkey", F.col("p_brand").alias("doc_id"), F.col("p_name").alias("target")), targets).select("p_partkey", "resolved_id")


@query("SELECT p_partkey, '_' || replace(lower(p_name), ' ', '_') || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS id FROM (SELECT p_partkey, p_name, p_brand, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS n FROM part)")
def generated_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("line_no"), text.section_id("p_name").alias("base"))
    return sections.unique_ids(p).select("p_partkey", "id")


@query("""
WITH u AS (SELECT p_size AS doc_id, p_brand AS t1, p_type AS t2, p_name AS t3, p_partkey AS ord FROM part)
SELECT doc_id, upper(t1[1:1]) AS letter, t1, t2, t3, count(*) AS uses, string_agg('_i' || ord, ' ' ORDER BY ord) AS anchors FROM u GROUP BY doc_id, t1, t2, t3
""")
def index_catalog(spark, sf_dir):
    uses = table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.col("p_brand").alias("t1"), F.col("p_type").alias("t2"), F.col("p_name").alias("t3"), F.col("p_partkey").alias("ord"), F.concat(F.lit("_i"), F.col("p_partkey").cast("string")).alias("anchor"), F.lit(None).cast("string").alias("see"), F.lit(None).cast("array<string>").alias("see_also"))
    return catalog.index(uses).select("doc_id", "letter", "t1", "t2", "t3", "uses", F.array_join("anchors", " ").alias("anchors"))


@query("""
WITH w AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'), ' ')) AS w FROM documents)
SELECT upper(w[1:1]) AS letter, count(*) AS uses, count(DISTINCT lower(w)) AS terms FROM w WHERE w <> '' GROUP BY 1
""")
def index_letters(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.split(F.regexp_replace("text", "[^a-zA-Z]+", " "), " ")).alias("w")).where("w <> ''")
    return w.groupBy(catalog.index_letter("w").alias("letter")).agg(F.count(F.lit(1)).alias("uses"), F.countDistinct(F.lower("w")).alias("terms"))


@query("""
WITH p AS (SELECT DISTINCT o_custkey AS k, dayofmonth(o_orderdate)::INT AS page FROM orders),
r AS (SELECT k, page, page - row_number() OVER (PARTITION BY k ORDER BY page) AS run FROM p),
g AS (SELECT k, min(page) AS low, max(page) AS high FROM r GROUP BY k, run)
SELECT k, string_agg(CASE WHEN low = high THEN low::VARCHAR ELSE low || '-' || high END, ', ' ORDER BY low) AS ranges FROM g GROUP BY k
""")
def page_ranges(spark, sf_dir):
    return catalog.page_ranges(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.dayofmonth("o_orderdate").alias("page")), ["k"])


@query("SELECT c_custkey, string_split(c_name, '#')[1] AS firstname, 'K' AS middlename, string_split(c_name, '#')[2] AS lastname, 'c' || c_custkey || '@x.org' AS email FROM customer UNION ALL SELECT c_custkey, 'Second Name', NULL, NULL, NULL FROM customer")
def author_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    line = F.concat(F.replace("c_name", F.lit("#"), F.lit(" K ")), F.lit(" <c"), F.col("c_custkey").cast("string"), F.lit("@x.org>; Second_Name"))
    return c.select("c_custkey", F.explode(sections.authors(line)).alias("a")).select("c_custkey", "a.firstname", "a.middlename", "a.lastname", "a.email")


@query("SELECT o_orderkey, o_orderkey || '.0' AS revnumber, strftime(o_orderdate, '%Y-%m-%d') AS revdate, o_orderpriority AS revremark FROM orders")
def revision_lines(spark, sf_dir):
    line = F.concat(F.lit("v"), F.col("o_orderkey").cast("string"), F.lit(".0, "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(": "), "o_orderpriority")
    o = table(spark, sf_dir, "orders").select("o_orderkey", sections.revision(line).alias("r"))
    return o.select("o_orderkey", "r.revnumber", "r.revdate", "r.revremark")


@query("SELECT o_orderkey, string_agg(n::VARCHAR, ',' ORDER BY n) AS marked FROM (SELECT o_orderkey, unnest(range(o_orderkey % 7 + 1, o_orderkey % 7 + 6)) AS n FROM orders) WHERE n <> 4 GROUP BY 1")
def marked_lines(spark, sf_dir):
    n = F.col("o_orderkey") % 7 + 1
    spec = F.concat(n.cast("string"), F.lit("-"), (n + 4).cast("string"), F.lit(",!4"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(text.marked_lines(spec, F.lit(20)), lambda x: x.cast("string")), ",").alias("marked"))
