"""Documents through whole conversions, and text functions on hard inputs."""

from pyspark.sql import functions as F

from quire.functions import codec, inline, pdf, text
from quire.operators import blocks, header, preprocess, select
from quire.plans import epub, manpage, mustache, pages, registry

DOCUMENT = """= Doc *T*

Pre footnote:[One _n_]. See <<_b>> and <<sec,that>> and xref:other.adoc#z[Z] footnote:k[Named] footnote:k[].

== A

[[sec]]Text <<tab>>. <<Sub>>

.Cap
[#tab]
|===
|a |b

|1 |2
|===

=== Sub

video::v.mp4[]

[source]
----
x < 1 // <1>
----
<1> one

== B

end [[anch]]here <<anch>>
"""


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).head().x


def test_pages(spark):
    nodes = blocks.parse(spark.createDataFrame([("d", DOCUMENT), ("e", None)], "doc_id string, text string"))
    html = {r.doc_id: r.html for r in pages.to_page(nodes, toc=2, numbers=3, standalone=True, xrefs="full", head="<meta x>\n").collect()}
    d = html["d"]
    for part in (
        '<li><a href="#_a">1. A</a>\n<ul class="sectlevel2">\n<li><a href="#_sub">1.1. Sub</a></li>', 'See <a href="#_b">Chapter 2, <em>B</em></a> and <a href="#sec">that</a> and <a href="other.html#z">Z</a>',
        '<a id="sec"></a>Text <a href="#tab">Table 1, &#8220;Cap&#8221;</a>. <a href="#_sub">Section 1.1, &#8220;Sub&#8221;</a>', '<caption class="title">Table 1. Cap</caption>', '<th class="tableblock halign-left valign-top">a</th>', "<video src=\"v.mp4\" controls>", 'x &lt; 1 <b class="conum">(1)</b>',
        '<sup class="footnoteref">[<a class="footnote" href="#_footnotedef_2" title="View footnote.">2</a>]</sup>', '<a href="#_footnoteref_1">1</a>. One <em>n</em>\n', "<title>Doc T</title>\n<meta x>\n</head>", '<h3 id="_sub">1.1. Sub</h3>',
    ):
        assert part in d, part
    assert "<title>Untitled</title>" in html["e"]
    split = {r.page: r for r in pages.to_pages(nodes.where("doc_id = 'd'")).collect()}
    assert {k: (r.prev, r.next) for k, r in split.items()} == {"index": (None, "_a"), "_a": ("index", "_b"), "_b": ("_a", None)} and 'href="_b.html#_b"' in split["index"].html and 'href="#tab"' in split["_a"].html
    book = {r.name: r.size for r in epub.entries(epub.to_epub(nodes.where("doc_id = 'd'"))).collect()}
    assert list(book)[0] == "mimetype" and book["mimetype"] == 20 and "EPUB/_b.xhtml" in book
    man = manpage.to_manpage(nodes.where("doc_id = 'd'")).head().man
    assert '.SH "A"\n' in man and ".SS \"Sub\"" in man and '.SH "NOTES"\n.IP [1]\nOne \\fIn\\fP' in man
    said = pdf.to_pdf(nodes).select("doc_id", pdf.pdf_pages("pdf").alias("p")).where("doc_id = 'd'").head().p
    assert said[0].text.startswith("Doc T\n")


def test_extensions(spark):
    docs = spark.createDataFrame([("d", "= T\n\nSee issue:12[bug].\n\nchart::a.csv[w=3]\n\n[shout]\nhello\n\ninclude::virt[]")], "doc_id string, text string")
    reg = registry.Registry()
    registry.InlineMacro("issue", lambda t, x: F.concat(F.lit("link:https://x.org/"), t, F.lit("["), x, F.lit("]"))).install(reg)
    registry.BlockMacro("chart", lambda t, a: registry.html(f"<chart src='{t}' w='{a.get('w')}'/>")).install(reg)
    registry.CustomBlock("shout", lambda s, a: registry.paragraph(s.upper(), "loud")).install(reg)
    registry.IncludeResolver("virtual", lambda t: "included *line*" if t == "virt" else None).install(reg)
    registry.Docinfo("info", lambda place: "<meta x>" if place == "head" else None).install(reg)
    registry.Postprocessor("post", lambda df: df.withColumn("html", F.concat("html", F.lit("<!-- end -->")))).install(reg)
    frozen = reg.copy()
    reg.unregister("post")
    html = frozen.convert(docs, standalone=True).head().html
    for part in ('<a href="https://x.org/12">bug</a>', "<chart src='a.csv' w='3'/>", '<div class="paragraph loud">\n<p>HELLO</p>', "<p>included <strong>line</strong></p>", "<meta x>\n</head>", "<!-- end -->"):
        assert part in html, part
    assert "<!-- end -->" not in reg.convert(docs).head().html
    registry.register_group("g", lambda r: registry.InlineMacro("x", lambda t, x: x).install(r))
    assert registry.activated(reg).hooks["inline_macro"][-1][0] == "x" and reg.hooks["inline_macro"][-1][0] == "issue"
    registry.unregister_group("g")
    uris = spark.createDataFrame([("u:a",), ("u:a",), ("u:b",)], "uri string")
    assert registry.fetched(uris, str.upper).count() == 0
    assert {r.uri: r.body for r in registry.fetched(uris, lambda u: u.upper() if u.endswith("a") else None, allowed=True).collect()} == {"u:a": "U:A", "u:b": None}


def test_templates_and_overrides(spark):
    nodes = blocks.parse(spark.createDataFrame([("d", "= T\n\npara *b*\n\n----\ncode\n----")], "doc_id string, text string"))
    mine = mustache.Converter({"paragraph": "<x>{{{text}}}</x>\n"})
    assert mustache.to_html(nodes, mine).head().html == '<h1>T</h1>\n<x>para <strong>b</strong></x>\n<div class="listingblock">\n<div class="content">\n<pre>code</pre>\n</div>\n</div>\n'
    loud = lambda f, usual: f.when(f.col("context") == "paragraph", f.upper(usual))
    assert "<P>PARA <STRONG>B</STRONG></P>" in mustache.to_html(nodes, override=loud).head().html


def test_long_inputs(spark):
    t = F.col("t")
    big = "<a " + "x='1' " * 20_000 + ">" + "<!-- " + "c-" * 50_000 + "--><b/>"
    assert one(spark, F.size(text.xml_tags(t)), big) == 2
    for mark in "~^*_`#":
        assert one(spark, F.length(inline.quotes(t)), mark + "x" * 1_000_000 + mark) > 1_000_000
    assert one(spark, F.length(inline.normal(t)), "+" + "y" * 100_000 + "+ pass:[" + "z" * 100_000 + "]") == 200_001
    name = "n" * 10_000
    assert one(spark, inline.attributes(t, F.create_map(F.lit(name), F.lit("v"))), "{" + name + "}") == "v"


def test_inline_parts(spark):
    t = F.col("t")
    for given, want in {
        "a *b* +*c*+ +++<u>x</u>+++ $$a<b$$": "a <strong>b</strong> *c* <u>x</u> a&lt;b", "pass:q,c[*y* <z>]": "<strong>y</strong> &lt;z&gt;", "stem:[x^2<3] latexmath:[a_b]": r"\$x^2&lt;3\$ \(a_b\)", "a+b c++": "a+b c++", "`+lit*+`": "<code>lit*</code>",
        "http://a.org/x_y_z[T] _em_": '<a href="http://a.org/x_y_z">T</a> <em>em</em>', "plain words, no marks": "plain words, no marks",
    }.items():
        assert one(spark, inline.normal(t), given) == want, given
    c = one(spark, inline.extract_callouts(t), "a <1>\nb // <.> <.>\nc\nd <!--2-->")
    assert c.text == "a\nb\nc\nd" and [(m.line, m.numbers) for m in c.marks] == [(0, [1]), (1, [1, 2]), (3, [2])]
    assert tuple(one(spark, inline.link_attributes(t), 'Text^,role="a b"')) == ("Text", "a b", "_blank", None) and one(spark, inline.link_attributes(t), "plain, text").text == "plain, text"
    assert one(spark, inline.macro_attributes(t), 's.r#i%o,k=v,"q, x"') == {"1": "s.r#i%o", "2": "q, x", "role": "r", "o-option": "", "style": "s", "id": "i", "k": "v"}
    assert one(spark, text.split_simple_csv(t), 'a, "b, c",,d') == ["a", "b, c", "", "d"] and one(spark, text.shape(t), "Ab漢9-é") == "Aao0-a"
    assert one(spark, text.normalize_text(t, unescape=True), " a\nb\\] ") == "a b]" and one(spark, text.literal_index(t, "c", 1), "abcabc") == 2 and one(spark, text.escape_html(t), "<'\">") == "&lt;&#x27;&quot;&gt;"
    assert one(spark, inline.default_passes(F.lit("listing"), F.lit("source"), True), "") == ["highlight", "callouts"] and one(spark, inline.default_passes(F.lit("paragraph")), "")[0] == "specialcharacters"
    assert one(spark, codec.adler32(t), "Wikipedia") == 0x11E60398


def test_lines(spark):
    rows = lambda body: preprocess.lines(spark.createDataFrame([(1, body)], "doc_id int, text string"))
    entries = {r.name: r.value for r in preprocess.attribute_entries(rows(":a: x \\\n  y \\\n  z \\\n  w\n:b!:\n:c: l + \\\nm")).collect()}
    assert entries == {"a": "x y z w", "b": None, "c": "l +\nm"}
    offsets = [r.value for r in preprocess.attribute_entries(rows(":leveloffset: +1\n:leveloffset: +2\n:leveloffset: 1\n:leveloffset: -1")).orderBy("line_no").collect()]
    assert offsets == ["1", "3", "1", "0"]
    files = preprocess.lines(spark.createDataFrame([("f", "= T\n// tag::x[]\n== A\n  i\n// end::x[]\ninclude::g[leveloffset=+1]"), ("g", "== G\nq"), ("loop", "include::loop[]")], "doc_id string, text string")).withColumnRenamed("doc_id", "path")
    out = preprocess.expand_includes(rows("a\ninclude::f[leveloffset=+1]\ninclude::f[tag=x,indent=4]\n\\include::f[]\ninclude::nope[]\ninclude::nope[opts=optional]"), files)
    assert [r.text for r in out.orderBy("ord").collect()] == ["a", "== T", "// tag::x[]", "=== A", "  i", "// end::x[]", "==== G", "q", "    == A", "      i", "include::f[]", "Unresolved directive: include::nope[]"]
    assert [r.text for r in preprocess.expand_includes(rows("include::loop[]"), files, depth=3).collect()] == ["Include depth exceeded: include::loop[]"]
    assert [r.text for r in preprocess.lines_until(rows("a\n// c\nb\n\nd"), break_on_blank=True, skip_comments=True).orderBy("line_no").collect()] == ["a", "b"]
    assert preprocess.leading_blanks(rows("\n\na")).head().skipped == 2 and preprocess.without_leading_blanks(rows("\n\na\n")).count() == 2
    assert one(spark, preprocess.expanded_tabs(F.col("t"), 4), "a\tb\n\tc") == "a   b\n    c"


def test_trees(spark):
    nodes = blocks.parse(spark.createDataFrame([("d", DOCUMENT)], "doc_id string, text string"))
    deep = "\n".join("*" * min(i, 5) + f" x{i}" if i <= 5 else f"{'.' * (i - 5)} x{i}" for i in range(1, 11))
    nested = blocks.parse(spark.createDataFrame([("e", deep)], "doc_id string, text string"))
    assert nested.agg(F.max("depth")).head()[0] >= 10 and select.next_adjacent(nested).where("next_id IS NOT NULL").count() == 0
    assert select.removed(nodes, nodes.where("context = 'section' AND title = 'A'")).where("context = 'table'").count() == 0
    assert {r.view for r in select.typed(nodes).collect()} >= {"Document", "Section", "SourceListing", "Table", "Video"}
    assert select.first_of_id(nodes, "tab", context="section").count() == 0 and select.first_of_id(nodes, "tab", context="table").count() == 1
    keyed = spark.createDataFrame([({"1": "a", "2": "b"},)], "attrs map<string,string>").select(select.rekeyed(F.col("attrs"), [None, "name"]).alias("x")).head().x
    assert keyed["name"] == "b"
    assert header.parse_header(spark.createDataFrame([(1, "= T\n:x: 1 \\\n 2\n\n:y: 3")], "doc_id int, text string")).head().attrs == {"x": "1 2"}


def test_command_line(spark, tmp_path, capsys):
    from quire import cli

    (tmp_path / "a.adoc").write_text("= A\n\nhi <<nope>>\n")
    (tmp_path / "out").mkdir()
    assert cli.main(["convert", "-D", str(tmp_path / "out"), "--failure-level", "info", str(tmp_path / "a.adoc")]) == 1
    assert "<title>A</title>" in (tmp_path / "out" / "a.html").read_text() and "possible invalid reference: nope" in capsys.readouterr().err
    (tmp_path / "s.yml").write_text("name: w\nlevels:\n- {name: chapter}\n")
    (tmp_path / "u.adoc").write_text("@1 one\n@2 two\n@4 four\n")
    assert cli.main(["check", "--scheme", str(tmp_path / "s.yml"), str(tmp_path / "u.adoc")]) == 1
    assert "chapter: 3\nline 3: gap" in capsys.readouterr().out


def test_sources(spark, tmp_path):
    from quire.sources import readers

    (tmp_path / "c" / "one").mkdir(parents=True)
    (tmp_path / "c" / "two").mkdir()
    (tmp_path / "c" / "one" / "input.adoc").write_text("= One")
    (tmp_path / "c" / "one" / "case.yml").write_text("expect: [a, 1]\n")
    (tmp_path / "c" / "two" / "input.adoc").write_text("= Two")
    (tmp_path / "c" / "code.rb").write_text("x = <<~EOS\n  = In\n    code\nEOS\n")
    found = {r.case.rsplit("/", 1)[-1]: (r.text, r.settings) for r in readers.cases(spark, str(tmp_path / "c")).collect()}
    assert found == {"one": ("= One", '{"expect": ["a", 1]}'), "two": ("= Two", None)}
    pooled = sorted((r.nth is None, r.text) for r in readers.pool(spark, str(tmp_path / "c")).collect())
    assert pooled == [(False, "= In\n  code"), (True, "= One"), (True, "= Two")]
    paths = spark.createDataFrame([("a/b.txt",), ("a-b/c.txt",), ("a/a.txt",)], "path string")
    assert [r.path for r in readers.by_path(paths).orderBy("ord").collect()] == ["a/a.txt", "a/b.txt", "a-b/c.txt"]
    t = F.col("t")
    assert one(spark, readers.safe_path(F.lit("docs/x"), t, "docs"), "../y.txt") == "docs/y.txt" and one(spark, readers.safe_path(F.lit("docs"), t, "docs"), "../../etc/p") == "docs/etc/p" and one(spark, readers.safe_path(F.lit("docs"), t, "docs", "unsafe"), "../etc") == "etc"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00"
    files = spark.createDataFrame([("a", bytearray(jpeg)), ("b", bytearray(b"no image"))], "path string, content binary")
    assert sorted(tuple(r) for r in readers.image_sizes(files).collect()) == [("a", "jpeg", 32, 16, 1), ("b", None, None, None, 1)]


def test_runs_hyphenators_and_fuzz(spark):
    from quire.functions import layout, synth

    assert layout.runs('a <strong>b <em>c</em></strong> &amp; <a href="u">d</a>') == [
        {"text": "a ", "bold": False, "italic": False, "mono": False, "raised": 0, "link": None}, {"text": "b ", "bold": True, "italic": False, "mono": False, "raised": 0, "link": None}, {"text": "c", "bold": True, "italic": True, "mono": False, "raised": 0, "link": None},
        {"text": " & ", "bold": False, "italic": False, "mono": False, "raised": 0, "link": None}, {"text": "d", "bold": False, "italic": False, "mono": False, "raised": 0, "link": "u"},
    ]
    sets = {"en": ["a1b"], "de": ["c1d"]}
    assert layout.hyphenator_for("en_US", sets) == layout.pattern_table(["a1b"]) and layout.hyphenator_for("nds", sets, {"nds": "de"}) == layout.pattern_table(["c1d"]) and layout.hyphenator_for("fr", sets) is None
    found = synth.fuzz(spark, lambda t: "has a listing" if "----" in t else None, ["a\nb", "c"], rounds=1, each=400).collect()
    assert [r.problem for r in found] == ["has a listing"] and "----" in found[0].text
    cut = synth.reduced(spark.createDataFrame([(1, "a\n\nb\nkey\nc\n\nd"), (2, "none")], "doc_id int, text string"), lambda t: "key" in t).collect()
    assert [(r.doc_id, r.text) for r in cut] == [(1, "key")]


def test_fonts_by_table(spark):
    from quire.functions import fonts

    index = spark.createDataFrame([("r", "Face", 400, 5, False), ("b", "Face", 700, 5, False), ("i", "Face", 400, 5, True), ("n", "Face", 400, 3, False)], "path string, family string, weight int, width int, italic boolean")
    asked = spark.createDataFrame([(1, "face", False, False, None), (2, "Face", True, False, None), (3, "Face", True, True, None), (4, "Face", False, False, 3), (5, "Other", False, False, None)], "ask_id int, family string, bold boolean, italic boolean, width int")
    assert {r.ask_id: r.path for r in fonts.matched(asked, index).collect()} == {1: "r", 2: "b", 3: "i", 4: "n", 5: None}
    parts = spark.createDataFrame([("f", 1, 2), ("f", 2, 3), ("f", 4, 5), ("g", 1, 9)], "font string, glyph int, part int")
    assert sorted(r.glyph for r in fonts.glyph_closure(parts, spark.createDataFrame([("f", 1)], "font string, glyph int")).collect()) == [1, 2, 3]
