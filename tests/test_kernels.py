"""Functions that run as kernels, as plain Python."""

import os
import zlib
from xml.etree import ElementTree

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import codec, fonts, highlight, layout, mathml, pdf, svg, synth, unicode
from quire.operators import header, preprocess, schemes, tables
from quire.plans import balance, mustache, pages
from quire.sources import yaml


@given(st.lists(st.integers(0, 1000), min_size=2, max_size=40), st.integers(6, 15))
def test_code_lengths_are_a_full_code(weights, most):
    lengths = codec.code_lengths(weights, most)
    used = [n for n, w in zip(lengths, weights, strict=True) if w]
    assert all((n > 0) == (w > 0) for n, w in zip(lengths, weights, strict=True)) and max(used, default=0) <= most
    if len(used) > 1:
        assert sum(2.0**-n for n in used) == 1


def test_code_lengths_are_optimal():
    # the least sum of weights times lengths, against all codes of five symbols
    weights, most = [9, 5, 3, 1, 1], 4
    best = min(sum(w * n for w, n in zip(weights, x, strict=True)) for x in _codes(5, most))
    assert sum(w * n for w, n in zip(weights, codec.code_lengths(weights, most), strict=True)) == best


def _codes(n, most):
    import itertools

    return (x for x in itertools.product(range(1, most + 1), repeat=n) if sum(2.0**-k for k in x) <= 1)


def _png(width, height, rows, colour=2, interlace=0):
    import struct

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, interlace)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_filters_and_interlacing():
    pixels = bytes(range(27))
    plain = _png(3, 3, b"".join(b"\0" + pixels[9 * r : 9 * r + 9] for r in range(3)))
    assert codec.png_pixels.plain(plain)["samples"] == pixels
    left = b"\1" + bytes(pixels[i] - (pixels[i - 3] if i > 2 else 0) & 255 for i in range(9))
    above = b"".join(b"\2" + bytes((pixels[9 * r + i] - pixels[9 * (r - 1) + i]) & 255 for i in range(9)) for r in (1, 2))
    assert codec.png_pixels.plain(_png(3, 3, left + above))["samples"] == pixels
    grey = bytes(range(25))
    passes = b""
    for x, y, dx, dy in codec.PASSES:
        for r in range(y, 5, dy):
            row = bytes(grey[5 * r + c] for c in range(x, 5, dx))
            passes += b"\0" + row if row else b""
    assert codec.png_pixels.plain(_png(5, 5, passes, colour=0, interlace=1))["samples"] == grey
    assert codec.png_pixels.plain(b"no image") is None


def test_stream_filters():
    data = b"some bytes, some bytes" * 20
    assert codec.stream_decode.plain(zlib.compress(data), ["FlateDecode"]) == data
    assert codec.hex_decode(b"48 65 6c6C6f 7>") == b"Hellop" and codec.run_length_decode(bytes([2, 65, 66, 67, 254, 68, 128])) == b"ABCDDD"
    assert codec.base85_decode(b"<~87cURD]j7BEbo7~>") == b"Hello world"
    assert codec.lzw_decode(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert codec.stream_decode.plain(b"x", ["Unknown"]) is None and codec.zlib_decode.plain(b"broken") is None and codec.zip_entries.plain(b"broken") is None


def test_exif():
    block = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + (len(block) + 2).to_bytes(2, "big") + block + b"\xff\xd9"
    assert codec.exif_orientation.plain(jpeg) == 6 and codec.exif_orientation.plain(b"\xff\xd8\xff\xd9") == 1


@pytest.mark.parametrize(("text", "want"), [("ab cd", [3, 5]), ("a-b c", [2, 4, 5]), ("(a) b", [4, 5]), ("$3.50 x", [6, 7]), ("漢字", [1, 2]), ("漢。字", [2, 3]), ("e\u0301 x", [3, 4]), ("a\u00a0b c", [4, 5]), ("x\r\ny", [3, 4]), ("", []), ("\U0001f1e9\U0001f1ea\U0001f1eb\U0001f1f7", [2, 4]), ("don't stop", [6, 10])])
def test_line_breaks(text, want):
    assert [o for o, _ in unicode.break_offsets(text)] == want


def test_mandatory_breaks():
    assert unicode.break_offsets("a\nb\n") == [(2, True), (4, True)]


def test_paths():
    assert svg.absolute("m1 1 2,0h3v-1z") == [("M", [1.0, 1.0]), ("L", [3.0, 1.0]), ("L", [6.0, 1.0]), ("L", [6.0, 0.0]), ("Z", [])]
    assert svg.absolute("M0 0a5 5 0 0110 10")[-1] == ("A", [5.0, 5.0, 0.0, 0.0, 1.0, 10.0, 10.0])
    assert svg.absolute("M0 0Q1 1 2 0T4 0")[-1] == ("Q", [3.0, -1.0, 4.0, 0.0])
    assert svg.absolute("L1 1") == [] and svg.absolute("M0 0 L1 x") == [("M", [0.0, 0.0])]
    assert svg.path_box.plain("M1 2L3 -4") == {"left": 1, "top": -4, "right": 3, "bottom": 2}


def test_random_numbers():
    draw = synth.SplitMix(1234567)
    assert [draw.next() for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]
    assert all(0 <= synth.SplitMix(i).below(7) < 7 for i in range(50))


@settings(max_examples=200)
@given(st.text(max_size=60))
def test_disguises_keep_shape(text):
    out = synth.scrambled_text(text)
    assert len(out) == len(text) and [c.isspace() for c in out] == [c.isspace() for c in text] and out == synth.scrambled_text(text)


def test_sanitized_and_mutated():
    out = synth.sanitized_text(":toc: left\nPlain {attr} image::x[a]\n<<id>> kept", frozenset({"kept"}))
    assert out.startswith(":toc:") and "{attr}" in out and "<<id>>" in out and out.endswith(" kept") and "Plain" not in out
    assert synth.mutated_text("a\nb\nc", 9) == synth.mutated_text("a\nb\nc", 9) and any(synth.mutated_text("a\nb\nc", s) != "a\nb\nc" for s in range(5))
    assert synth.smallest(list(range(30)), lambda p: {4, 17} <= set(p)) == [4, 17]


@pytest.mark.parametrize("seed", range(20))
def test_random_documents_parse(seed):
    from quire.operators.blocks import parse_text

    text = synth.random_document(seed)
    assert text == synth.random_document(seed) and len(parse_text(text)) > 1
    assert parse_text(synth.mutated_text(text, seed, 12))  # whatever is written, there is a document


def test_highlight():
    out = highlight.highlighted('def f(x):\n  return "a\\"" # c', "python")
    assert out["html"] == '<span class="hljs-keyword">def</span> <span class="hljs-title">f</span>(x):\n  <span class="hljs-keyword">return</span> <span class="hljs-string">&quot;a\\&quot;&quot;</span> <span class="hljs-comment"># c</span>'
    assert highlight.highlighted("{x}", "json")["illegal"] and highlight.highlighted("a < b", "nothing")["html"] == "a &lt; b"
    own = {"toy": highlight.Grammar("toy", {"keywords": "go|3 stop", "contains": []})}
    assert highlight.highlighted("go stop", "toy", own)["relevance"] == 4


def test_formulas():
    inner = lambda x: x[x.index(">") + 1 : -len("</math>")]
    assert inner(mathml.plain_to_mathml("x^2/3")) == "<mfrac><msup><mi>x</mi><mn>2</mn></msup><mn>3</mn></mfrac>"
    assert inner(mathml.plain_to_mathml("sum_(i=0)^n alpha")) == "<munderover><mo>∑</mo><mrow><mi>i</mi><mo>=</mo><mn>0</mn></mrow><mi>n</mi></munderover><mi>α</mi>"
    assert inner(mathml.tex_to_mathml(r"\frac{a}{b}\le\sqrt[3]{x}")) == "<mfrac><mi>a</mi><mi>b</mi></mfrac><mo>≤</mo><mroot><mi>x</mi><mn>3</mn></mroot>"
    assert "<mtable><mtr><mtd><mi>a</mi></mtd><mtd><mi>b</mi></mtd></mtr>" in mathml.plain_to_mathml("[[a,b],[c,d]]") and "<mtable>" in mathml.tex_to_mathml(r"\begin{pmatrix}a&b\\c&d\end{pmatrix}")


@settings(max_examples=300)
@given(st.text("xy12+-/^_(){}[]\\ \"abcfrsqt|,&", max_size=30))
def test_formulas_are_well_formed(text):
    ElementTree.fromstring(mathml.plain_to_mathml(text))
    ElementTree.fromstring(mathml.tex_to_mathml(text))


FONT = "/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf"


@pytest.mark.skipif(not os.path.exists(FONT), reason="needs a font file")
def test_fonts():
    data = open(FONT, "rb").read()
    font = fonts.Font(data)
    chars = font.characters()
    assert font.names()[1] == "DejaVu Sans" and font.style() == (400, 5, False) and len(font.closure([chars[ord("é")]])) == 4
    assert font.width_of("AV") < font.width_of("A") + font.width_of("V")  # kerned
    part = font.subset("Hé")
    again = fonts.Font(part)
    a, b = again.outlines()[chars[ord("H")]], again.outlines()[chars[ord("Q")]]
    assert len(part) < len(data) / 3 and a[1] > a[0] and b[0] == b[1] and fonts.checksum(part) == 0xB1B0AFBA
    assert fonts.font_facts.plain(b"no font") is None


def test_page_files():
    pages_, outline = pdf.flowed([{"kind": "heading", "level": 0, "text": "Title"}, {"kind": "text", "level": 0, "text": "word " * 900}, {"kind": "code", "level": 0, "text": "a = (1)\nb \\ c"}])
    data = pdf.document(pages_, 612, 792, "Tïtle", outline, ["i", "ii"])
    reader = pdf.Reader(data)
    assert len(reader.pages()) == 2 and reader.text(reader.pages()[0]).startswith("Title\nword") and reader.text(reader.pages()[-1]).endswith("a = (1)\nb \\ c")
    assert len(pdf.Reader(data.replace(b"startxref", b"startxxxx")).pages()) == 2  # found by a scan
    assert data == pdf.document(pages_, 612, 792, "Tïtle", outline, ["i", "ii"])
    writer = pdf.Writer()
    assert isinstance(writer.objects[reader.as_form(writer, reader.pages()[0]).number - 1], pdf.Stream)


@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.binary(max_size=20) | st.text("abc/#( )é", min_size=1, max_size=8).map(pdf.Name), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abcXYZ", min_size=1, max_size=4), x, max_size=4), max_leaves=12))
def test_page_objects_round_trip(value):
    assert pdf.Scanner(pdf.written(value)).value() == value


def test_layout():
    lines = layout.justified("In olden times when wishing still helped one there lived a king whose daughters were all beautiful", 28)
    assert all(len(x) <= 29 for x in lines) and " ".join(lines).split() == "In olden times when wishing still helped one there lived a king whose daughters were all beautiful".split()
    assert layout.justified("aa hyphenation bb", 8, {"hyphenation": [2, 6]})[0] == "aa hy-"
    assert layout.paginated([10, 30, 10, 40], 50, [True, False, True, False], 2, [1, 3, 1, 4]) == [(0, 0, 1), (1, 0, 3), (2, 1, 1), (3, 1, 4)]
    heights = [3, 1, 4, 1, 5, 9, 2]
    placed = layout.balanced_columns(heights, 3)
    assert max(sum(h for h, c in zip(heights, placed, strict=True) if c == k) for k in range(3)) == 11 and placed == sorted(placed)
    assert layout.table_widths([1, 2, 3], [4, 8, 6], 12) == [2.5, 5.0, 4.5]
    assert layout.break_points("hyphenation", layout.pattern_table(["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n"])) == [2, 6]


def test_yaml():
    text = "# c\na: 1\nb:\n- x\n- {y: [1, 2], z: 'it''s'}\n- name: n\n  more: |\n    l1\n      l2\nc: >-\n  f1\n  f2\nd: [0x10, 1:30, yes, ~, 1.5]\n\"q\": \"\\u00e9\""
    assert yaml.load(text) == {"a": 1, "b": ["x", {"y": [1, 2], "z": "it's"}, {"name": "n", "more": "l1\n  l2\n"}], "c": "f1 f2", "d": [16, 90, True, None, 1.5], "q": "é"}
    assert yaml.resolved_theme({"base": {"size": 12, "line": "$base-size * 1.5"}, "w": "1in"}) == {"base_size": 12, "base_line": 18, "w": 72}
    with pytest.raises(ValueError):
        yaml.resolved_theme({"a": "$b", "b": "$a"})


def test_schemes():
    text = "name: bible\nlevels:\n- {name: book, kind: code, canon: c}\n- {name: chapter, separator: ' '}\n- {name: verse}\ncanons:\n  c:\n  - {code: Gen, names: [Genesis]}\n  - {code: Ps, names: [Psalm, Psalms]}\n"
    bible = schemes.Scheme.read(text)
    assert bible.parse("psalms 23:1") == [("book", "Ps"), ("chapter", "23"), ("verse", "1")] and bible.parse("Foo 1") is None
    assert [([x for _, x in a], b and [x for _, x in b]) for a, b in bible.parse_list("Ps 23:1-3, 5; 24:2, Gen 1")] == [(["Ps", "23", "1"], ["Ps", "23", "3"]), (["Ps", "23", "5"], None), (["Ps", "24", "2"], None), (["Gen", "1"], None)]
    law = schemes.Scheme("law", [schemes.Level("section"), schemes.Level("sub", "alpha", "(", close=")"), schemes.Level("para", "int", "(", close=")")])
    assert law.parse("552(a)(1)") == [("section", "552"), ("sub", "a"), ("para", "1")]
    walked = bible.walk([("Gen", False), ("1", False), ("1", False), (None, False), ("2", False), ("4", False), (None, True)])
    assert [(u["labels"], u["problem"]) for u in walked] == [(["Gen"], None), (["Gen", "1"], None), (["Gen", "1", "1"], None), (["Gen", "1", "2"], None), (["Gen", "2"], None), (["Gen", "2", "4"], None), (["Gen", "2"], None)] or walked[4]["level"] in ("chapter", "verse")
    keys = [schemes.label_key(k, x) for k, x in (("int", "12ZA"), ("int", "12"), ("int", "12A"), ("talmud", "2b"), ("talmud", "1a"), ("folio", "12vb"), ("stephanus", "327e"), ("bekker", "1094a12"), ("alpha", "bb"), ("roman", "xiv"), ("roman", "iix"))]
    assert keys[0] < keys[1] < keys[2] and keys[3:] == [[2, 1], None, [12, 1, 2], [327, 5], [1094, 1, 12], [28], [14], None]
    assert schemes.next_label("stephanus", "327e") == ["328a"] and schemes.next_label("talmud", "2b") == ["3a"] and schemes.next_label("bekker", "1094a3") == ["1094a4", "1094b1"]
    assert [schemes.filtered("15", f) for f in ("roman", "hebrew", "arabic-indic")] == ["xv", "טו", "١٥"]
    assert schemes.filled_template("{a|upper}{? ({b})?}", {"a": "x"}) == "X" and schemes.paired([("open", "a"), ("open", "a"), ("close", "a"), ("close", "b")]) == [None, 2, None, None]


def test_headers():
    assert header.with_attribute("= T\n:a: 1 \\\n 2\n\nx", "a", "9") == "= T\n:a: 9\n\nx" and header.with_attribute("= T\n\nx", "b", "") == "= T\n:b:\n\nx"
    assert header.with_attribute("text", "b", None) == ":!b:\n\ntext" and header.without_attribute("= T\n:a: 1 \\\n 2\n:c: d\n\n:a: kept", "a") == "= T\n:c: d\n\n:a: kept"


def test_balance_and_templates():
    assert balance.balanced_text('<p><b>a<i id="x">b</b>c</i></p><em>x</q>') == '<p><b>a<i id="x">b</i></b><i>c</i></p><em>x</em>'
    parts = mustache.parse_template("Hi {{name}} {{{raw}}}\n{{#items}}\n- {{.}}\n{{/items}}\n{{^none}}no{{/none}}{{! c }}{{>p}}")
    assert mustache.fill(parts, [{"name": "<A>", "raw": "<b>", "items": [1, 2]}], {"p": mustache.parse_template("[{{name}}]")}) == "Hi &lt;A&gt; <b>\n- 1\n- 2\nno[&lt;A&gt;]"
    with pytest.raises(ValueError):
        mustache.parse_template("{{#a}}")


def test_tags_at_any_depth():
    lines = [f"// tag::t{i}[]" for i in range(20)] + ["deep"] + [f"// end::t{i}[]" for i in range(19, -1, -1)]
    assert preprocess.chosen_by_tags(lines, "t12")[0][20] and not preprocess.chosen_by_tags(lines, "t3;!t15")[0][20]
    assert preprocess.chosen_by_tags(["a", "// tag::x[]", "b", "// end::x[]", "c"], "*")[0] == [False, False, True, False, False]
    assert preprocess.chosen_by_tags(["a", "// tag::x[]", "b", "// end::x[]", "c"], "**;!x")[0] == [True, False, False, False, True]
    problems = preprocess.chosen_by_tags(["// tag::a[]", "// tag::b[]", "// end::a[]", "// end::c[]"], "a;b;c;d")[1]
    assert problems == [(3, "mismatched end", "a"), (4, "unexpected end", "c"), (2, "not closed", "b"), (None, "not found", "c"), (None, "not found", "d")]
    assert preprocess.shown_lines([1] * 20 + [0] + [-1] * 20 + [0], [i != 8 for i in range(20)] + [True] * 22)[20:] == [False] * 21 + [True]


def test_chosen_lines():
    texts = [f"l{i}" for i in range(1, 9)]
    numbers = lambda o: [i for i, _ in preprocess.chosen_lines(texts, o)]
    assert numbers("lines=2..3;5") == [2, 3, 5] and numbers("lines=7..") == [7, 8] and numbers("lines=5;2;2") == [2, 5] and numbers("lines=0;3") == [] and numbers('lines="1,6..-1"') == [1, 6, 7, 8] and numbers("") == list(range(1, 9))
    assert preprocess.chosen_lines(["    a", "      b", ""], "indent=2") == [(1, "  a"), (2, "    b"), (3, "")]


def test_tables():
    spec = tables.Spec("2.3+^.>s")
    assert (spec.wide, spec.high, spec.copies, spec.halign, spec.valign, spec.style, spec.valid) == (2, 3, 1, "center", "bottom", "strong", True)
    assert tables.Spec("3*").copies == 3 and not tables.Spec("word").valid and not tables.Spec("2").valid
    cells, columns = tables.cells_of("|A |B\n\n2+|wide\n.2+|x |y\n|z", "psv")
    assert columns == 2 and [(c[0], c[1], c[2], c[3], c[4], c[8]) for c in cells] == [("head", 0, 0, 1, 1, "A"), ("head", 0, 1, 1, 1, "B"), ("body", 1, 0, 2, 1, "wide"), ("body", 2, 0, 1, 2, "x"), ("body", 2, 1, 1, 1, "y"), ("body", 3, 0, 1, 1, "z")]
    assert tables.shares([1, 1, 1]) == [33.3333, 33.3333, 33.3334] and tables.column_list("2*^.>3s,~,15%e")[-1] == {"width": 15, "halign": "left", "valign": "top", "style": "emphasis"}


def test_section_numbers():
    assert pages.numbers_of([0, 1, 2, 2, 1, 1, 2], [None, None, None, None, None, "appendix", None]) == ["I:", "1.", "1.1.", "1.2.", "2.", "A.", "A.1."]
    assert pages.nested_list([(1, "a", "A"), (2, "b", "B"), (1, "c", "C")]) == '<ul class="sectlevel1">\n<li><a href="#a">A</a>\n<ul class="sectlevel2">\n<li><a href="#b">B</a></li>\n</ul>\n</li>\n<li><a href="#c">C</a></li>\n</ul>\n'
