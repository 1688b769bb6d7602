"""Queries over scalar functions, lists, readers' functions and small catalogs, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import inline, layout, text
from quire.functions.kernel import kernel
from quire.operators import attributes, blocks, catalog, header, preprocess, schemes, sections, select, tables, units
from quire.plans.queries import query, table
from quire.sources import readers

NL = "chr(10)"


def key(column: str):
    return F.col(column).cast("string")


@query(r"""SELECT p_partkey, trim(p_name) AS trimmed, p_name[1:length(p_name) - 1] AS shorter, 'a-b' AS collapsed, floor(p_retailprice::DOUBLE * 10) / 10 AS cut, CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size // 2) || '.5' END AS shown,
  true AS uri, false AS no_uri, replace(replace(p_name, ' ', '%20'), '#', '%23') AS encoded, 'my-name' || p_size AS named, p_size % 2 = 0 AS same, p_size AS pieces FROM part""")
def text_scalars(spark, sf_dir):
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.trim(F.concat(F.lit(" \t"), "p_name", F.lit("\r\n "))).alias("trimmed"), text.drop_last("p_name").alias("shorter"), text.collapse_runs(F.concat(F.lit("a"), F.repeat(F.lit("-"), n + 1), F.lit("b")), "-").alias("collapsed"),
        text.truncate_places(F.col("p_retailprice").cast("double"), 1).alias("cut"), text.format_number(n / 2).alias("shown"), text.is_uri(F.concat(F.lit("https://x.org/"), key("p_partkey"))).alias("uri"), text.is_uri("p_name").alias("no_uri"),
        text.encode_component("p_name").alias("encoded"), text.attribute_name(F.concat(F.lit("My-Na!me"), key("p_size"))).alias("named"), text.uniform(F.concat(F.lit("=="), F.when(n % 2 == 0, "=").otherwise("-")), "=").alias("same"),
        F.size(text.split_drop_empty_end(F.concat(F.repeat(F.lit("x,"), n), F.lit(",,")), ",")).cast("bigint").alias("pieces"),
    )


@query("SELECT c_custkey, c_name || ': a' AS main, c_mktsegment AS subtitle, 'ab' AS cut, 'é & <' || c_custkey || '>' AS decoded, 'σς' AS low FROM customer")
def title_scalars(spark, sf_dir):
    t = text.partition_title(F.concat("c_name", F.lit(": a: "), "c_mktsegment"))
    e = text.decode_entities(F.concat(F.lit("&#233; &amp; &lt;"), key("c_custkey"), F.lit("&#x3e;")))
    return table(spark, sf_dir, "customer").select("c_custkey", t["main"].alias("main"), t["subtitle"].alias("subtitle"), text.limit_bytes(F.lit("abé"), 3).alias("cut"), e.alias("decoded"), F.concat(text.lower_plain_sigma(F.lit("Σ")), F.lit("ς")).alias("low"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_partkey::VARCHAR, '^9+$') THEN 'w' || repeat('0', length(p_partkey::VARCHAR)) ELSE 'v' || (p_partkey + 1) END AS next FROM part")
def counter_successors(spark, sf_dir):
    """The next label of ``v<number>``: numbers carry over, into the letter at last."""
    follow = kernel("string")(catalog.successor)
    return table(spark, sf_dir, "part").select("p_partkey", follow(F.concat(F.lit("v"), key("p_partkey"))).alias("next"))


@query(f"SELECT o_orderkey AS doc_id, 2 AS line_no, o_orderstatus AS text FROM orders UNION ALL SELECT o_orderkey, 6, 'end' FROM orders")
def lines_without_comments(spark, sf_dir):
    body = F.concat(F.lit("// c\n"), "o_orderstatus", F.lit("\n////\nhidden\n////\nend"))
    return preprocess.without_comments(preprocess.lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), body.alias("text"))))


@query("SELECT o_orderkey AS doc_id, i AS line_no, 'l' || i AS text FROM (SELECT o_orderkey, unnest(range(1, o_custkey % 5 + 3)) AS i FROM orders)")
def lines_to_an_end(spark, sf_dir):
    """Lines up to the end mark, which is kept out; comments are passed over."""
    n = (F.col("o_custkey") % 5 + 2).cast("int")
    body = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("l"), i.cast("string"))), "\n"), F.lit("\n--\nafter"))
    return preprocess.lines_until(preprocess.lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), body.alias("text"))), "--")


@query("SELECT c_custkey AS doc_id, (c_custkey % 4)::INT AS skipped FROM customer")
def leading_blanks(spark, sf_dir):
    body = F.concat(F.repeat(F.lit("\n"), (F.col("c_custkey") % 4).cast("int")), "c_name")
    return preprocess.leading_blanks(preprocess.lines(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), body.alias("text"))))


@query("SELECT s_suppkey AS doc_id, 1 AS level, s_name AS title FROM supplier")
def underlined_titles(spark, sf_dir):
    body = F.concat("s_name", F.lit("\n"), F.repeat(F.lit("-"), F.length("s_name") + 1), F.lit("\n\nno title here\n---"))
    found = sections.underlined_titles(preprocess.lines(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), body.alias("text"))))
    return found.select("doc_id", "level", "title")


@query("SELECT s_suppkey, 's' || s_suppkey AS name, (s_nationkey % 8 + 1)::VARCHAR AS volume FROM supplier")
def manual_headers(spark, sf_dir):
    h = sections.man_header(F.concat(F.lit("s"), key("s_suppkey"), F.lit("("), (F.col("s_nationkey") % 8 + 1).cast("string"), F.lit(")")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", h["name"].alias("name"), h["volume"].alias("volume"))


def _blocks(spark, sf_dir):
    """Suppliers as documents with one block of several kinds each."""
    s = table(spark, sf_dir, "supplier")
    body = F.concat(
        F.lit("[quote#q.big%open,Someone]\n____\n"), "s_name", F.lit("\n____\n\nTIP: "), "s_name", F.lit("\n\nterm:: meaning "), key("s_suppkey"), F.lit("\n\n----\ncode <1>\n----\n<1> why "), key("s_suppkey"),
        F.lit("\n\n[NOTE]\n====\ninside\n====\n\n3. third\n4. fourth\n6. sixth\n\n[[bib]]\n* [[[b"), key("s_suppkey"), F.lit(",B]]] entry\n\n'''\n\nimage::d/my_pic.png[]\n"),
    )
    return blocks.parse(s.select(key("s_suppkey").alias("doc_id"), body.alias("text")))


@query("""
SELECT s_suppkey::VARCHAR AS doc_id, unnest(['quote', 'paragraph', 'admonition', 'dlist', 'listing', 'colist', 'admonition', 'olist', 'ulist', 'thematic_break', 'image']) AS context, unnest([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS top FROM supplier
""")
def block_kinds(spark, sf_dir):
    """Kinds of blocks in their order; the quotation's paragraph is below it."""
    found = _blocks(spark, sf_dir).where(F.col("context").isin("quote", "paragraph", "admonition", "dlist", "listing", "colist", "olist", "ulist", "thematic_break", "image") & ~((F.col("context") == "paragraph") & (F.element_at("ord", 1) == 5)))
    return found.select("doc_id", "context", F.element_at("ord", 1).alias("top"))


@query("SELECT s_suppkey::VARCHAR AS doc_id, 'quote' AS style, 'q' AS id, 'big' AS role, true AS open, 'Someone' AS who FROM supplier")
def style_shorthand(spark, sf_dir):
    found = _blocks(spark, sf_dir).where("context = 'quote'")
    return found.select("doc_id", "style", "id", F.array_join("roles", " ").alias("role"), F.array_contains(select.options(), "open").alias("open"), F.try_element_at("attrs", F.lit("2")).alias("who"))


@query("SELECT s_suppkey::VARCHAR AS doc_id, 'TIP' AS style, s_name AS said FROM supplier")
def admonition_paragraphs(spark, sf_dir):
    return _blocks(spark, sf_dir).where("context = 'admonition' AND source IS NOT NULL").select("doc_id", "style", F.col("source").alias("said"))


@query("SELECT s_suppkey::VARCHAR AS doc_id, 'term' AS term, 'meaning ' || s_suppkey AS said FROM supplier")
def described_terms(spark, sf_dir):
    found = _blocks(spark, sf_dir).where(F.col("marker") == "::")
    return found.groupBy("doc_id").agg(F.max(F.when(F.col("context") == "dlist_term", F.col("source"))).alias("term"), F.max(F.when(F.col("context") == "list_item", F.col("source"))).alias("said"))


@query("SELECT s_suppkey::VARCHAR AS doc_id, 1 AS number, 'why ' || s_suppkey AS said FROM supplier")
def explained_callouts(spark, sf_dir):
    """Callouts of a listing joined with the items that explain them."""
    nodes = _blocks(spark, sf_dir)
    marks = nodes.where("context = 'listing'").select(F.col("doc_id").alias("m_doc"), F.explode(inline.callouts("source")).alias("number"))
    items = nodes.where(F.col("marker").rlike("^<[0-9]+>$")).select("doc_id", F.regexp_extract("marker", "[0-9]+", 0).cast("int").alias("ordinal"), F.col("source").alias("said"))
    return marks.join(items, (F.col("m_doc") == F.col("doc_id")) & (F.col("number") == F.col("ordinal"))).select("doc_id", "number", "said")


@query("SELECT s_suppkey::VARCHAR AS doc_id, 5 AS expected, 6 AS found, '3' AS start FROM supplier")
def list_marker_problems(spark, sf_dir):
    nodes = _blocks(spark, sf_dir)
    starts = nodes.where("context = 'olist'").select(F.col("doc_id").alias("l_doc"), F.try_element_at("attrs", F.lit("start")).alias("start"))
    return sections.marker_problems(nodes).join(starts, F.col("doc_id") == F.col("l_doc")).select("doc_id", "expected", "found", "start")


@query("SELECT s_suppkey::VARCHAR AS doc_id, 'b' || s_suppkey AS id, 'B' AS label FROM supplier")
def bibliography_anchors(spark, sf_dir):
    found = _blocks(spark, sf_dir).where(F.col("source").contains("[[[")).select("doc_id", F.explode(inline.biblio_anchors("source")).alias("b"))
    return found.select("doc_id", "b.id", "b.label")


@query("SELECT s_suppkey::VARCHAR AS doc_id, 'd/my_pic.png' AS target, 'my pic' AS alt FROM supplier")
def image_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).where("context = 'image'").select("doc_id", F.try_element_at("attrs", F.lit("target")).alias("target"), F.try_element_at("attrs", F.lit("alt")).alias("alt"))


@query("SELECT s_suppkey::VARCHAR AS doc_id, count(*) AS n FROM supplier GROUP BY 1")
def adjacent_blocks(spark, sf_dir):
    """The block after the quotation, its own paragraph passed over."""
    nodes = select.next_adjacent(_blocks(spark, sf_dir))
    after = nodes.where("context = 'quote'").select(F.col("doc_id").alias("q_doc"), F.col("next_id").alias("q_next"))
    return nodes.where("context = 'admonition'").join(after, (F.col("doc_id") == F.col("q_doc")) & (F.col("node_id") == F.col("q_next"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, '<a href=\"x\">' AS html, 0 AS start, length(p_name) AS stop, 'strong' AS kind FROM part UNION ALL SELECT p_partkey, '<a href=\"x\">', length(p_name) + 1, length(p_name) + 4, 'em' FROM part")
def inline_trees(spark, sf_dir):
    t = inline.quotes(F.concat(F.lit("*"), "p_name", F.lit("* _end_")))
    found = table(spark, sf_dir, "part").select("p_partkey", F.explode(inline.inline_tree(t)).alias("x"))
    return found.select("p_partkey", F.lit('<a href="x">').alias("html"), F.col("x.start").cast("bigint").alias("start"), F.col("x.stop").cast("bigint").alias("stop"), "x.kind")


@query("SELECT c_custkey AS doc_id, 'see ' || (c_custkey + 1) || ' and ' || (c_custkey + 2) || ' b' AS text FROM customer")
def folded_attributes(spark, sf_dir):
    """Counters and assignments in the order of a document."""
    body = F.concat(F.lit(":n: "), key("c_custkey"), F.lit("\nsee {counter:n} and {counter:n} {l}\n:l: b"))
    made = attributes.apply(table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(":l: b\n"), body).alias("text")), "c_custkey")
    return made.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


@query("SELECT s_suppkey, 'specialcharacters,replacements,quotes' AS passes FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'specialcharacters,callouts' FROM supplier WHERE s_suppkey % 2 = 1")
def substitution_lists(spark, sf_dir):
    listed = kernel("array<string>")(lambda base, spec: catalog.substitutions(base, spec))
    base = F.when(F.col("s_suppkey") % 2 == 0, inline.default_passes(F.lit("paragraph"))).otherwise(inline.default_passes(F.lit("listing")))
    spec = F.when(F.col("s_suppkey") % 2 == 0, "c,r,q").otherwise("-quotes")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(listed(base, spec), ",").alias("passes"))


@query("WITH r AS (SELECT DISTINCT c_nationkey % 5 AS id, c_mktsegment AS item FROM customer), n AS (SELECT id, count(*) AS n FROM r GROUP BY id) SELECT min(id) AS first, 1 AS chosen FROM n WHERE n = (SELECT max(n) FROM n)")
def smallest_cover(spark, sf_dir):
    """Of five groups that each reach all segments the first is enough."""
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("id"), F.col("c_mktsegment").alias("item"))
    cost = c.select("id").distinct().withColumn("cost", F.lit(1))
    best = catalog.smallest_cover(c, cost)
    return spark.createDataFrame([(int(best[0]), len(best))], "first long, chosen int")


@query("SELECT p_partkey, 'II' AS upper, 'ii' AS lower, 'b' AS alpha, 'β' AS greek, p_size AS n FROM part")
def list_styles(spark, sf_dir):
    two = F.lit(2)
    return table(spark, sf_dir, "part").select("p_partkey", sections.list_numbers("upperroman", two).alias("upper"), sections.list_numbers("lowerroman", two).alias("lower"), sections.list_numbers("loweralpha", two).alias("alpha"), sections.list_numbers("lowergreek", two).alias("greek"), sections.list_numbers("arabic", "p_size").cast("bigint").alias("n"))


@query("SELECT p_partkey, p_size::VARCHAR || 'r' AS label, p_size AS leaf, 0 AS side, 'v' AS next FROM part")
def leaf_labels(spark, sf_dir):
    label = F.concat(key("p_size"), F.lit("r"))
    after = kernel("string")(lambda x: schemes.next_label("folio", x)[0])(label)
    k = units.folio_key(label)
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), F.get(k, F.lit(0)).cast("bigint").alias("leaf"), F.get(k, F.lit(1)).alias("side"), F.right(after, F.lit(1)).alias("next"))


@query("SELECT s_suppkey, 's' || s_suppkey AS base, '../../a/x.png' AS seen, 'docs/etc/x' AS kept, NULL::VARCHAR AS secure FROM supplier")
def jailed_paths(spark, sf_dir):
    n = key("s_suppkey")
    base = F.concat(F.lit("docs/"), n)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", text.basename(readers.resolve_path(base, F.concat(F.lit("./../s"), n))).alias("base"), readers.relative_path(F.lit("a/x.png"), F.lit("b/c")).alias("seen"),
        readers.safe_path(base, F.lit("../../etc/x"), "docs").alias("kept"), readers.safe_path(base, F.lit("x"), "docs", "secure").alias("secure"),
    )


@query(f"SELECT n_nationkey, 'k: ' || n_nationkey AS front, n_name AS body FROM nation")
def front_matter(spark, sf_dir):
    f = readers.front_matter(F.concat(F.lit("---\nk: "), key("n_nationkey"), F.lit("\n---\n"), "n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", f["front_matter"].alias("front"), f["body"].alias("body"))


@query("SELECT n_nationkey, n_name AS one, n_name AS two, n_name AS three FROM nation")
def decoded_sources(spark, sf_dir):
    """Sources with a mark of UTF-8, and of UTF-16 in both orders."""
    raw = lambda mark, code: F.concat(F.unhex(F.lit(mark)), F.encode("n_name", code))
    return table(spark, sf_dir, "nation").select("n_nationkey", readers.decode(raw("EFBBBF", "UTF-8")).alias("one"), readers.decode(raw("FFFE", "UTF-16LE")).alias("two"), readers.decode(raw("FEFF", "UTF-16BE")).alias("three"))


@query("SELECT n_nationkey::VARCHAR AS key, 'png' AS kind, n_nationkey + 1 AS width, n_nationkey + 2 AS height, 1 AS orientation FROM nation")
def image_headers(spark, sf_dir):
    size = lambda add: F.unhex(F.lpad(F.hex((F.col("n_nationkey") + add).cast("bigint")), 8, "0"))
    content = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), size(1), size(2), F.unhex(F.lit("0802000000")))
    return readers.image_sizes(table(spark, sf_dir, "nation").select(key("n_nationkey").alias("path"), content.alias("content")))


@query("SELECT n_nationkey::VARCHAR AS key, n_name || '.txt' AS name, length(n_name) AS size FROM nation")
def zip_files(spark, sf_dir):
    from quire.functions import codec

    packed = codec.zip_archive(F.array(F.concat("n_name", F.lit(".txt"))), F.array(F.encode("n_name", "UTF-8")), F.array().cast("array<string>"))
    return readers.archive_entries(table(spark, sf_dir, "nation").select(key("n_nationkey").alias("path"), packed.alias("content"))).select("key", "name", "size")


@query("SELECT n_nationkey AS key, 0 AS nth, n_name || chr(10) || '  x' AS text FROM nation")
def embedded_sources(spark, sf_dir):
    """Documents held by code as heredocs."""
    code = F.concat(F.lit("input = <<~EOS\n    "), "n_name", F.lit("\n      x\n  EOS\nend"))
    return readers.heredocs(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("path"), code.alias("text")))


@query(f"SELECT s_suppkey, 'a b' || {NL} || 'c' AS filled, 2 AS lines FROM supplier")
def best_filled_lines(spark, sf_dir):
    return layout.fill(table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("a b c").alias("text")), 3, "s_suppkey", "text", "total").select("s_suppkey", "filled", "lines")


@query("SELECT p_partkey, 'Cell ' || p_size AS first, 2 AS paragraphs, 2 AS colspan FROM part")
def spanning_cells(spark, sf_dir):
    """Tables of a spanning cell of two paragraphs above two plain ones."""
    body = F.concat(F.lit("2+^|Cell "), key("p_size"), F.lit("\n\nmore\n|a |b"))
    given = table(spark, sf_dir, "part").select(key("p_partkey").alias("table_id"), body.alias("text"), F.lit("psv").alias("format"), F.lit(2).alias("columns"), F.lit(False).alias("header"), F.lit(False).alias("footer"))
    found = tables.parse(given).where("row = 0")
    return found.select(F.col("table_id").cast("bigint").alias("p_partkey"), F.get(tables.cell_paragraphs(F.col("text")), F.lit(0)).alias("first"), F.size(tables.cell_paragraphs(F.col("text"))).alias("paragraphs"), "colspan")


@query("SELECT c_custkey AS doc_id, 'Ann Lee' AS author, 2 AS n, 'AL' AS initials FROM customer")
def author_attributes(spark, sf_dir):
    body = F.concat(F.lit("= "), "c_name", F.lit("\nAnn Lee; Bo"))
    found = header.metadata(preprocess.lines(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), body.alias("text"))))
    got = lambda n: F.try_element_at(header.author_attributes(F.col("authors")), F.lit(n))
    return found.select("doc_id", got("author").alias("author"), got("authorcount").cast("int").alias("n"), got("authorinitials_1").alias("initials"))


@query("SELECT n_nationkey, n_name AS own, 'r' || n_regionkey AS inherited, 'none' AS fallback, true AS held FROM nation")
def inherited_attributes(spark, sf_dir):
    attrs = F.create_map(F.lit("name"), F.col("n_name"))
    doc = F.create_map(F.lit("region"), F.concat(F.lit("r"), key("n_regionkey")))
    n = table(spark, sf_dir, "nation").select("n_nationkey", attrs.alias("attrs"), doc.alias("doc_attrs"))
    return n.select("n_nationkey", select.attribute("name").alias("own"), select.attribute("region", fallback="region").alias("inherited"), select.attribute("x", "none", "y").alias("fallback"), select.has_attribute("region", inherit=True).alias("held"))


@query(f"SELECT p_partkey, '  ' || p_name || {NL} || '    b' AS indented FROM part")
def reindented_blocks(spark, sf_dir):
    t = F.concat(F.lit("      "), "p_name", F.lit("\n        b"))
    return table(spark, sf_dir, "part").select("p_partkey", preprocess.reindented(t, 2).alias("indented"))


@query("SELECT p_partkey, '<span class=\"menuseq\"><b class=\"menu\">File</b>&#160;<b class=\"caret\">&#8250;</b> <b class=\"menuitem\">' || p_name || '</b></span>' AS menu, '<span class=\"image\"><img src=\"i/p' || p_partkey || '.png\" alt=\"p' || p_partkey || '\"></span>' AS image, p_name AS term, 'k' AS note_id FROM part")
def further_macros(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    image = inline.images(F.concat(F.lit("image:i/p"), key("p_partkey"), F.lit(".png[]")))
    term = inline.index_terms(F.concat(F.lit("((("), "p_name", F.lit(", b)))")))
    note = inline.footnotes(F.concat(F.lit("x footnote:k["), "p_name", F.lit("]")))
    return p.select("p_partkey", inline.menus(F.concat(F.lit("menu:File["), "p_name", F.lit("]"))).alias("menu"), image.alias("image"), term[0]["terms"][0].alias("term"), note[0]["id"].alias("note_id"))


@query("SELECT p_partkey, 'a' || p_partkey AS id, p_name AS text FROM part")
def inline_anchors(spark, sf_dir):
    found = inline.anchors(F.concat(F.lit("x [[a"), key("p_partkey"), F.lit(","), "p_name", F.lit("]] y")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("a")).select("p_partkey", "a.id", "a.text")
