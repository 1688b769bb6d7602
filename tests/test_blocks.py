from quire.operators import blocks, select
from quire.plans import docbook, render

TEXT = """= Title
Ann B. Lee <a@x.org>
:toc:

Intro *bold*.

== One

.Figure
[#pic.wide]
image::a/my_pic.png[]

* a
** b
* c
+
more

. x
. y

term:: meaning
other::
text

=== Sub

[source,python]
----
if a < b:
----

====
Inside

NOTE: careful
====

== Two

[quote]
said so
"""


def shape(nodes, key=0):
    n = nodes[key]
    return [n["context"], *(shape(nodes, c["node_id"]) for c in sorted((c for c in nodes if c["parent_id"] == key), key=lambda c: c["ord"]))]


def test_tree():
    nodes = blocks.parse_text(TEXT)
    assert nodes[0]["title"] == "Title" and nodes[0]["attrs"]["author-line"] == "Ann B. Lee <a@x.org>" and "toc" in nodes[0]["attrs"]
    item = ["list_item"]
    assert shape(nodes) == [
        "document",
        ["preamble", ["paragraph"]],
        [
            "section",
            ["image"],
            ["ulist", ["list_item", ["ulist", item]], ["list_item", ["paragraph"], ["olist", item, item]]],
            ["dlist", ["dlist_term"], item, ["dlist_term"], item],
            ["section", ["listing"], ["example", ["paragraph"], ["admonition"]]],
        ],
        ["section", ["quote"]],
    ]
    image = next(n for n in nodes if n["context"] == "image")
    assert image["id"] == "pic" and image["roles"] == ["wide"] and image["attrs"]["alt"] == "my pic" and image["title"] == "Figure"
    code = next(n for n in nodes if n["context"] == "listing")
    assert code["source"] == "if a < b:" and code["style"] == "source"


def test_attribute_list():
    got = blocks.attribute_list('quote#x.a.b%hard,"Some, one",opts="p,q",n=1')
    assert got["style"] == "quote" and got["id"] == "x" and got["role"] == "a b" and got["2"] == "Some, one" and got["n"] == "1" and {"hard-option", "p-option", "q-option"} <= set(got)


def test_selection_and_html(spark):
    docs = spark.createDataFrame([("d", TEXT), ("e", None), ("f", "plain & <b>")], "doc_id string, text string")
    nodes = blocks.parse(docs).cache()
    assert select.find_by(nodes, context="list_item").count() == 7
    assert select.find_by(nodes, role="wide", id="pic").count() == 1
    top = nodes.where("title = 'One'")
    assert select.descendants(nodes, top).count() == 20
    assert select.pruned(nodes, top, keep_top=False).where("doc_id = 'd'").count() == nodes.where("doc_id = 'd'").count() - 21
    html = {r.doc_id: r.html for r in render.to_html(nodes).collect()}
    assert html["e"] == "" and html["f"] == '<div class="paragraph">\n<p>plain &amp; &lt;b&gt;</p>\n</div>\n'
    assert "<p>Intro <strong>bold</strong>.</p>" in html["d"] and "if a &lt; b:" in html["d"] and '<div class="sect2">' in html["d"] and html["d"].index("One") < html["d"].index("Two")


def test_docbook(spark):
    docs = spark.createDataFrame([("d", TEXT)], "doc_id string, text string")
    xml = docbook.to_docbook(blocks.parse(docs)).head().xml
    assert '<section>\n<title>One</title>' in xml and '<emphasis role="strong">bold</emphasis>' in xml and "<programlisting" in xml and xml.count("<section>") == xml.count("</section>") == 3
    import xml.etree.ElementTree as tree

    tree.fromstring(f"<article xmlns:xml='http://www.w3.org/XML/1998/namespace'>{xml}</article>")


def test_lone_delimiters_and_long_texts():
    assert [n["context"] for n in blocks.parse_text("----\nopen")] == ["document", "listing"]
    assert len(blocks.parse_text("a\n\n" * 5000)) == 5001
    assert len(blocks.parse_text("")) == 1
