from pyspark.sql import functions as F

from quire.functions import inline, layout, text
from quire.operators import catalog, preprocess, sections, tables, units
from quire.sources import readers


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).head().x


def test_text(spark):
    t = F.col("t")
    assert one(spark, text.decode_entities(t), "a &amp;lt; &#233;&#x1F600; &copy; &nbsp;b") == "a &lt; é😀 &copy;  b"
    assert one(spark, text.plain_text(t), " <b>x &lt; y</b>\n") == "x < y"
    assert one(spark, text.leading_int(t), "42abc") == 42 and one(spark, text.leading_int(t), "x") == 0
    assert one(spark, text.split_drop_empty_end(t, ","), "a,,b,,") == ["a", "", "b"]
    assert one(spark, text.section_id(t), "Über  the & Top. 1") == "_über_the_top_1"
    assert one(spark, text.section_id(t), "...") == "_"
    assert one(spark, text.limit_bytes(t, 5), "aébcdé") == "aébc" and one(spark, text.limit_bytes(t, 2), "aé") == "a"
    assert [one(spark, text.to_roman(F.lit(n))) for n in (4, 1999, 4001)] == ["IV", "MCMXCIX", "MMMMI"]
    assert [one(spark, text.to_alpha(F.lit(n))) for n in (1, 26, 27, 702, 703)] == ["a", "z", "aa", "zz", "aaa"]
    assert one(spark, text.marked_lines(t, F.lit(12), 3), "3-5;!4;10..") == [1, 3, 8, 9, 10]
    assert tuple(one(spark, text.partition_title(t), "A: b: c")) == ("A: b", "c")
    assert one(spark, text.special_characters(t), None) is None


def test_inline(spark):
    t = F.col("t")
    for given, want in {
        "a *b c* d*e*": "a <strong>b c</strong> d*e*", "**x**y": "<strong>x</strong>y", r"\*no*": "*no*", "[.r]#x#": '<span class="r">x</span>', "_a_ `b`": "<em>a</em> <code>b</code>", 'say "`hi`"': "say &#8220;hi&#8221;", "H~2~O x^2^": "H<sub>2</sub>O x<sup>2</sup>",
    }.items():
        assert one(spark, inline.quotes(t), given) == want
    assert one(spark, inline.replacements(t), r"(C) \(C) it's a--b ... -&gt;") == "&#169; (C) it&#8217;s a&#8212;&#8203;b &#8230;&#8203; &#8594;"
    assert one(spark, inline.images(t), "image:a/b_c.png[] image:x.png[Alt]") == '<span class="image"><img src="a/b_c.png" alt="b_c"></span> <span class="image"><img src="x.png" alt="Alt"></span>'
    assert [tuple(x) for x in one(spark, inline.index_terms(t), "((one)) (((a, b,c)))")] == [(True, ["one"]), (False, ["a", "b", "c"])]
    assert [tuple(x) for x in one(spark, inline.footnotes(t), "x footnote:[A] footnote:k[B] footnote:k[]")] == [(None, "A"), ("k", "B"), ("k", None)]


def test_preprocess(spark):
    attrs = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("x"))
    rows = lambda body: preprocess.lines(spark.createDataFrame([(1, body)], "doc_id int, text string"))
    kept = lambda body: [r.text for r in preprocess.conditionals(rows(body).withColumn("attrs", attrs), F.col("attrs")).orderBy("line_no").collect()]
    assert kept("ifdef::a[]\n1\nifdef::no[]\n2\nendif::[]\n3\nendif::[]\nifndef::a,no[]\n4\nendif::[]\n\\ifdef::x[]") == ["1", "3", "ifdef::x[]"]
    assert kept('ifeval::["{b}" == "x"]\n1\nendif::[]\nifeval::[{a} > "1"]\n2\nendif::[]\nifdef::a+b[both]') == ["1", "both"]
    tagged = rows("0\n// tag::a[]\n1\n// tag::b[]\n2\n// end::b[]\n// end::a[]\n3")
    pick = lambda tags: [r.text for r in preprocess.tagged_lines(tagged, tags).orderBy("line_no").collect()]
    assert pick("a") == ["1", "2"] and pick("a;!b") == ["1"] and pick("**") == ["0", "1", "2", "3"] and pick("!b") == ["0", "1", "3"]
    assert one(spark, preprocess.reindented(F.col("t"), 2), "    a\n      b\n\n    c") == "  a\n    b\n\n  c"


def test_sections(spark):
    body = "= T\n\n== A\n\n=== B\n\n=== C\n\n==== D\n\n== E\n\n=== F"
    toc = sections.outline(preprocess.lines(spark.createDataFrame([(1, body)], "doc_id int, text string")), 5).orderBy("line_no").collect()
    assert [r.sectnum for r in toc] == ["1.", "1.1.", "1.2.", "1.2.1.", "2.", "2.1."]
    a = one(spark, sections.authors(F.col("t")), "Ann_Mary B. Lee <a@x.org>; Bo")
    assert (a[0].firstname, a[0].lastname, a[0].email, a[1].firstname) == ("Ann Mary", "Lee", "a@x.org", "Bo")


def test_tables(spark):
    kind = "table_id string, text string, format string, columns int, header boolean, footer boolean"
    cells = lambda body, fmt, n: [(r.row, r.col, r.colspan, r.rowspan, r.text) for r in tables.parse(spark.createDataFrame([("t", body, fmt, n, False, False)], kind)).orderBy("row", "col").collect()]
    assert cells("|a |b\n2+|c\n|d |e", "psv", 2) == [(0, 0, 1, 1, "a"), (0, 1, 1, 1, "b"), (1, 0, 2, 1, "c"), (2, 0, 1, 1, "d"), (2, 1, 1, 1, "e")]
    assert cells("|a .2+|b\n|c\n|d", "psv", 2)[:3] == [(0, 0, 1, 1, "a"), (0, 1, 1, 2, "b"), (1, 0, 1, 1, "c")]
    assert cells('a,"b ""q"" \n x"\n', "csv", 2) == [(0, 0, 1, 1, "a"), (0, 1, 1, 1, 'b "q" \n x')]
    assert cells("a\\:b:c", "dsv", 2) == [(0, 0, 1, 1, "a:b"), (0, 1, 1, 1, "c")]


def test_catalog(spark):
    assert [catalog.successor(x) for x in ("a", "z", "az", "Zz", "9", "a-9", "a9", "")] == ["b", "aa", "ba", "AAa", "10", "a-10", "b0", ""]
    assert catalog.substitutions(["specialcharacters", "quotes"], "+macros,-quotes") == ["specialcharacters", "macros"]
    assert catalog.substitutions(["quotes"], "attributes+") == ["attributes", "quotes"]
    reach = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 3)], "id string, item int")
    cost = spark.createDataFrame([("a", 1), ("b", 1), ("c", 5)], "id string, cost int")
    assert catalog.smallest_cover(reach, cost) == ["a", "b"]


def test_units_and_layout(spark):
    assert one(spark, units.folio_key(F.lit("12vb"))) == [12, 1, 2] and one(spark, units.line_key(F.lit("1094a12"))) == [1094, 1, 12] and one(spark, units.int_key(F.lit("x"))) is None
    table = layout.pattern_table([".hy3p", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n"])
    assert layout.break_points("hyphenation", table) == [2, 6]
    assert layout.first_fit("aa bb cc dddddd".split(), 5) == [0, 0, 1, 2]
    assert layout.total_fit("aaa bb cc ddddd".split(), 6) == [0, 1, 1, 2]


def test_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.adoc").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "d" / "b.adoc").write_bytes("é".encode("utf-16-le"))
    (tmp_path / "d" / "_skip.adoc").write_text("no")
    (tmp_path / "c.adoc").write_bytes(b"\xff\xfe" + "ü".encode("utf-16-le"))
    found = readers.folder(spark, str(tmp_path)).collect()
    assert {r.path.rsplit("/", 1)[-1]: r.text for r in found if "b.adoc" not in r.path} == {"a.adoc": "hello", "c.adoc": "ü"}
    assert tuple(one(spark, readers.front_matter(F.col("t")), "---\nk: v\n---\nbody")) == ("k: v", "body")


def test_attribute_fold():
    from quire.operators.attributes import fold

    lines = [":x: 1", "a {x} {nope} {counter:n} {counter:n}", "{set:y:2}", "{y} {counter:l:az} {counter:l} {amp}", ":!x:", "{x}", r"\{y}"]
    assert fold(lines, {}) == ["a 1 {nope} 1 2", "2 az ba &", "{x}", "{y}"]
    assert fold(["{nope} a", "b {nope}"], {}, "drop-line") == [] and fold(["b {nope}"], {}, "drop") == ["b "]


def test_fill_and_hyphenate_against_loops(spark):
    import random

    draw = random.Random(3)
    texts = [" ".join("x" * draw.randrange(1, 14) for _ in range(draw.randrange(0, 60))) for _ in range(40)] + [None, ""]

    def loop(t, width):
        lines = []
        for w in (t or "").split():
            if lines and len(lines[-1]) + 1 + len(w) <= width:
                lines[-1] += " " + w
            else:
                lines.append(w)
        return "\n".join(lines)

    out = {r.doc_id: r for r in layout.fill(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 20).collect()}
    assert all(out[i].filled == loop(t, 20) and out[i].lines == (loop(t, 20).count("\n") + 1 if t else 0) for i, t in enumerate(texts))

    def brute(word, patterns):
        marked, digits = f".{word}.", [0] * (len(word) + 3)
        for p in patterns:
            letters = "".join(c for c in p if not c.isdigit())
            values, k = [0] * (len(letters) + 1), 0
            for c in p:
                if c.isdigit():
                    values[k] = int(c)
                else:
                    k += 1
            for at in range(len(marked) - len(letters) + 1):
                if marked[at : at + len(letters)] == letters:
                    digits[at : at + len(values)] = [max(a, b) for a, b in zip(digits[at : at + len(values)], values, strict=True)]
        return "".join(("-" if 2 <= i <= len(word) - 2 and digits[i + 1] % 2 else "") + c for i, c in enumerate(word))

    patterns = ["1na", "n2d", "a1t", "1te", "e1r", ".in1", "1tion."]
    words = ["intention", "inand", "natter", "a", "banana", "terminate"]
    parts = {r.word: r.parts for r in layout.hyphenate(spark.createDataFrame([(w,) for w in words], "word string"), patterns).collect()}
    assert parts == {w: brute(w, patterns) for w in words}


def test_older_marks_and_macros(spark):
    t = F.col("t")
    assert one(spark, inline.quotes(t, True), "``a b'' 'c' `d' +e+ ++f++g *h* _i_") == "&#8220;a b&#8221; <em>c</em> &#8216;d&#8217; <code>e</code> <code>f</code>g <strong>h</strong> <em>i</em>"
    assert one(spark, inline.macros(t), "icon:heart[] mailto:a@b.org[Me,Hi you]") == '<span class="icon">[heart&#93;</span> <a href="mailto:a@b.org?subject=Hi%20you">Me</a>'
