"""Whole HTML documents: ids, numbers, captions, footnotes, references and contents on top of the rendered nodes.

Each of these is a table by document and node that is joined to the nodes
before their templates are filled; what depends on the order of a whole
document (section numbers, nested contents) is a function over the short list
of its sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.durable import durable
from quire.functions import inline
from quire.functions.kernel import kernel
from quire.functions.text import let, section_id, strip_tags
from quire.operators import catalog
from quire.plans import render

FOOTNOTE = r"footnote:([\w-]*)\[((?:[^\]\\]|\\.)*+)\]"


def numbers_of(levels: list[int], styles: list[str | None]) -> list[str]:
    """Numbers of sections in order: ``1.2.`` by their ancestors; parts (level 0) count in Roman numerals apart, appendices in letters."""
    from quire.operators.catalog import successor

    counts, part, appendix, out = [0] * 8, 0, "", []
    roman = [(10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    for level, style in zip(levels, styles, strict=True):
        if level == 0:
            part, rest, mark = part + 1, part + 1, ""
            for value, letter in roman:
                while rest >= value:
                    mark, rest = mark + letter, rest - value
            out.append(mark + ":")
            continue
        for deeper in range(level + 1, len(counts)):
            counts[deeper] = 0
        if level == 1 and style == "appendix":
            appendix = successor(appendix) if appendix else "A"
            counts[1] = appendix
        else:
            counts[level] = (counts[level] if isinstance(counts[level], int) else 0) + 1
        out.append("".join(f"{counts[k]}." for k in range(1, level + 1)))
    return out


@kernel("array<string>")
def section_numbers(levels, styles):
    return numbers_of(levels, styles)


def section_facts(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, ord, level, title, sect_id (its own or made from the title, unique), number and sectname of each section and floating title."""
    found = nodes.where(F.col("context").isin("section", "floating_title")).select("doc_id", "node_id", "ord", "level", "style", "id", "title", "context", inline.title("title").alias("title_html"))
    base = found.withColumn("base", F.coalesce("id", section_id(strip_tags("title_html"))))
    nth = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy(F.col("id").isNull(), "ord"))
    named = base.withColumn("sect_id", F.when((nth == 1) | F.col("id").isNotNull(), F.col("base")).otherwise(F.concat("base", F.lit("_"), nth.cast("string"))))
    listed = named.where("context = 'section'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "node_id", "level", "style"))).alias("s"))
    numbered = listed.select("doc_id", F.explode(F.arrays_zip(F.transform("s", lambda x: x["node_id"]).alias("node"), section_numbers(F.transform("s", lambda x: x["level"]), F.transform("s", lambda x: x["style"])).alias("number"))).alias("x"))
    numbered = numbered.select(F.col("doc_id").alias("n_doc"), F.col("x.node").alias("n_node"), F.col("x.number").alias("number"))
    name = F.when(F.col("context") == "floating_title", "discrete").when(F.col("level") == 0, "part").when(F.col("style").isNotNull(), F.col("style")).when(F.col("level") == 1, "chapter").otherwise("section")
    joined = named.withColumn("sectname", name).join(numbered, (F.col("doc_id") == F.col("n_doc")) & (F.col("node_id") == F.col("n_node")), "left")
    return joined.select("doc_id", "node_id", "ord", "level", "title", "title_html", "sect_id", "number", "sectname")


def nested_list(entries: list[tuple[int, str, str]]) -> str:
    """The contents as nested lists, of (level, id, text)."""
    out, open_levels = [], []
    for level, key, text in entries:
        while open_levels and open_levels[-1] > level:
            out.append("</li>\n</ul>\n")
            open_levels.pop()
        if open_levels and open_levels[-1] == level:
            out.append("</li>\n")
        else:
            out.append(("\n" if open_levels else "") + f'<ul class="sectlevel{level}">\n')
            open_levels.append(level)
        out.append(f'<li><a href="#{key}">{text}</a>')
    out += ["</li>\n</ul>\n"] * len(open_levels)
    return "".join(out)


@kernel("string")
def contents_list(entries):
    return nested_list([(e["level"], e["id"], e["text"]) for e in entries])


def contents(facts: DataFrame, levels: int = 2, numbers: int = 0) -> DataFrame:
    """doc_id, toc: the contents of sections to ``levels``, numbered to the level ``numbers``."""
    shown = F.when((F.col("level") <= numbers) & F.col("number").isNotNull(), F.concat("number", F.lit(" "), "title_html")).otherwise(F.col("title_html"))
    some = facts.where((F.col("level") <= levels) & (F.col("sectname") != "discrete"))
    listed = some.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "level", F.col("sect_id").alias("id"), shown.alias("text")))), lambda x: F.struct(x["level"].alias("level"), x["id"].alias("id"), x["text"].alias("text"))).alias("entries"))
    return listed.select("doc_id", contents_list("entries").alias("toc"))


def reference_texts(facts: DataFrame, blocks: DataFrame, style: str = "basic") -> DataFrame:
    """doc_id, id, text: what references to sections and captioned blocks (doc_id, id, title, caption) say, in the ``full``, ``short`` or ``basic`` style; without a title, the id in brackets."""
    signifier = F.when(F.col("sectname") == "part", "Part").when(F.col("sectname") == "chapter", "Chapter").when(F.col("sectname") == "appendix", "Appendix").otherwise("Section")
    plain = F.rtrim(F.col("number"), F.lit(".:"))
    quoted = F.when(F.col("sectname").isin("part", "chapter", "appendix"), F.concat(F.lit("<em>"), "title_html", F.lit("</em>"))).otherwise(F.concat(F.lit("&#8220;"), "title_html", F.lit("&#8221;")))
    full, short = F.concat(signifier, F.lit(" "), plain, F.lit(", "), quoted), F.concat(signifier, F.lit(" "), plain)
    text = {"full": F.coalesce(full, F.col("title_html")), "short": F.coalesce(short, F.col("title_html")), "basic": F.col("title_html")}[style]
    of_sections = facts.select("doc_id", F.col("sect_id").alias("id"), text.alias("text"))
    caption = F.regexp_replace("caption", r"\. $", "")
    title = inline.title("title")
    of_blocks = {"full": F.when(F.col("caption").isNotNull(), F.concat(caption, F.lit(", &#8220;"), title, F.lit("&#8221;"))).otherwise(title), "short": F.coalesce(caption, title), "basic": title}[style]
    rest = blocks.where("id IS NOT NULL").select("doc_id", "id", F.coalesce(of_blocks, F.concat(F.lit("["), "id", F.lit("]"))).alias("text"))
    return of_sections.unionByName(rest)


def target_of(refid: Column, suffix: str = ".html") -> Column:
    """Struct of path (null: this document) and fragment (null: none) of a reference's target: ``file.adoc#id``, ``file.adoc``, ``file#id`` or ``id``."""
    path, fragment = F.regexp_extract(refid, r"^([^#]*)(?:#|$)", 1), F.regexp_extract(refid, "#(.*)$", 1)
    source = path.rlike(r"\.(?:adoc|asciidoc|asc|ad|txt)$")
    other = (refid.contains("#") & (path != "")) | source
    out = F.when(source, F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(suffix))).when(path.rlike(r"\.[^./]+$"), path).otherwise(F.concat(path, F.lit(suffix)))
    return F.struct(F.when(other, out).alias("path"), F.when(other, F.nullif(fragment, F.lit(""))).otherwise(F.ltrim(refid, F.lit("#"))).alias("fragment"))


XREF = r"&lt;&lt;((?:(?!&gt;&gt;)[\s\S])+?)&gt;&gt;|xref:([^\s\[]+)\[((?:[^\]\\]|\\.)*+)\]"


def linked(text: Column, known: Column, own: Column | None = None, titles: Column | None = None) -> Column:
    """References in converted text as links. ``known``: map of ids to their texts in this document; ``titles``: map of titles to ids, for references by title; ``own``: names under which this document (and what it includes) may be named, so that a reference to it stays inside."""

    def link(m: Column) -> Column:
        body = F.regexp_extract(m, r"^&lt;&lt;([\s\S]*)&gt;&gt;$", 1)
        short = m.startswith("&lt;&lt;")
        refid = F.btrim(F.when(short, F.regexp_extract(body, r"^([^,]*)", 1)).otherwise(F.regexp_extract(m, r"^xref:([^\[]+)\[", 1)))
        given = F.nullif(F.btrim(F.when(short, F.regexp_extract(body, r"^[^,]*,([\s\S]*)$", 1)).otherwise(F.replace(F.regexp_extract(m, r"\[([\s\S]*)\]$", 1), F.lit("\\]"), F.lit("]")))), F.lit(""))

        def made(t: Column) -> Column:
            by_title = F.try_element_at(titles, refid) if titles is not None else F.lit(None).cast("string")
            natural = F.when(refid.rlike(r"[ \p{Lu}]") & ~F.map_contains_key(known, refid), by_title)
            inside = t["path"].isNull() if own is None else t["path"].isNull() | F.array_contains(own, F.regexp_replace(t["path"], r"\.[^./]+$", ""))
            fragment = F.coalesce(natural, t["fragment"])
            here = F.concat(F.lit('<a href="#'), F.coalesce(fragment, F.lit("")), F.lit('">'), F.coalesce(given, F.try_element_at(known, fragment), F.concat(F.lit("["), F.coalesce(fragment, F.lit("^top")), F.lit("]"))), F.lit("</a>"))
            there = F.concat(F.lit('<a href="'), t["path"], F.coalesce(F.concat(F.lit("#"), t["fragment"]), F.lit("")), F.lit('">'), F.coalesce(given, t["path"]), F.lit("</a>"))
            return F.when(inside, here).otherwise(there)

        return let(target_of(refid), made)

    found = lambda ms: F.array_join(F.zip_with(F.split(text, XREF), F.transform(ms, link), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.contains("&lt;&lt;") | text.contains("xref:"), let(F.regexp_extract_all(text, F.lit(XREF), F.lit(0)), found)).otherwise(text)


def footnote_facts(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, pos, number, is_ref, text of each footnote in the nodes' converted text, numbered through the document."""
    held = nodes.where(F.col("text").contains("footnote:")).select("doc_id", "node_id", "ord", F.posexplode(F.regexp_extract_all("text", F.lit(FOOTNOTE), F.lit(0))).alias("pos", "m"))
    notes = held.select("doc_id", "node_id", F.struct("ord", "pos").alias("ord"), "pos", F.nullif(F.regexp_extract("m", FOOTNOTE, 1), F.lit("")).alias("id"), F.replace(F.regexp_extract("m", FOOTNOTE, 2), F.lit("\\]"), F.lit("]")).alias("body"))
    return catalog.numbered_footnotes(notes).select("doc_id", "node_id", "pos", "number", "is_ref", F.col("body").alias("text"))


def _with_footnotes(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    mark = F.when(F.col("is_ref"), F.concat(F.lit('<sup class="footnoteref">[<a class="footnote" href="#_footnotedef_'), F.col("number").cast("string"), F.lit('" title="View footnote.">'), F.col("number").cast("string"), F.lit("</a>]</sup>")))
    mark = mark.otherwise(F.concat(F.lit('<sup class="footnote">[<a id="_footnoteref_'), F.col("number").cast("string"), F.lit('" class="footnote" href="#_footnotedef_'), F.col("number").cast("string"), F.lit('" title="View footnote.">'), F.col("number").cast("string"), F.lit("</a>]</sup>")))
    marks = notes.select("doc_id", "node_id", "pos", mark.alias("mark")).groupBy(F.col("doc_id").alias("f_doc"), F.col("node_id").alias("f_node")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mark"))), lambda x: x["mark"]).alias("marks"))
    joined = nodes.join(marks, (F.col("doc_id") == F.col("f_doc")) & (F.col("node_id") == F.col("f_node")), "left")
    text = F.array_join(F.zip_with(F.split("text", FOOTNOTE), F.col("marks"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return joined.withColumn("text", F.when(F.col("marks").isNotNull(), text).otherwise(F.col("text"))).drop("f_doc", "f_node", "marks")


def footnote_list(notes: DataFrame) -> DataFrame:
    """doc_id, footnotes: the list at a document's end."""
    n = F.col("number").cast("string")
    one = F.concat(F.lit('<div class="footnote" id="_footnotedef_'), n, F.lit('">\n<a href="#_footnoteref_'), n, F.lit('">'), n, F.lit("</a>. "), "text", F.lit("\n</div>\n"))
    listed = notes.where("NOT is_ref").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", one.alias("one")))), lambda x: x["one"]), "").alias("all"))
    return listed.select("doc_id", F.concat(F.lit('<div id="footnotes">\n<hr>\n'), "all", F.lit("</div>\n")).alias("footnotes"))


ANCHOR = r"\[\[([\p{L}_:][\w:.-]*)(?:, *[^\]]+)?\]\]|anchor:([\p{L}_:][\w:.-]*)\[[^\]]*\]"


def facts_and_nodes(nodes: DataFrame, style: str = "basic", numbers: int = 0):
    """(section facts, footnote facts, nodes ready to be rendered): ids, numbers, captions, links, anchors and footnotes in their texts."""
    # several tables are made of the nodes and of their texts: both are written once
    nodes = durable(nodes, "nodes")
    facts = durable(section_facts(nodes), "sections")
    captioned = catalog.captions(nodes)
    texts = reference_texts(facts, captioned.select("doc_id", "id", "title", "caption").where("id IS NOT NULL"), style)
    anchors = nodes.where(F.col("source").contains("[[")).select("doc_id", F.explode(inline.anchors("source")).alias("a")).select("doc_id", "a.id", F.coalesce("a.text", F.concat(F.lit("["), F.col("a.id"), F.lit("]"))).alias("text"))
    known = texts.unionByName(anchors).where("id IS NOT NULL").groupBy("doc_id", "id").agg(F.min("text").alias("text")).groupBy(F.col("doc_id").alias("k_doc")).agg(F.map_from_entries(F.collect_list(F.struct("id", "text"))).alias("known"))
    said = facts.select("doc_id", "title_html", "sect_id", "ord").unionByName(captioned.where("id IS NOT NULL AND title IS NOT NULL AND context <> 'section'").select("doc_id", inline.title("title").alias("title_html"), F.col("id").alias("sect_id"), "ord"))
    titles = said.groupBy("doc_id", "title_html").agg(F.min_by("sect_id", "ord").alias("id")).groupBy(F.col("doc_id").alias("n_doc")).agg(F.map_from_entries(F.collect_list(F.struct("title_html", "id"))).alias("titles"))
    made = durable(render.ready(captioned), "texts")
    placed = facts.select(F.col("doc_id").alias("s_doc"), F.col("node_id").alias("s_node"), "sect_id", F.col("number").alias("sect_number"))
    joined = made.join(placed, (F.col("doc_id") == F.col("s_doc")) & (F.col("node_id") == F.col("s_node")), "left").join(known, F.col("doc_id") == F.col("k_doc"), "left")
    joined = joined.join(titles, F.col("doc_id") == F.col("n_doc"), "left")
    none = F.create_map().cast("map<string,string>")
    text = linked(F.col("text"), F.coalesce("known", none), titles=F.coalesce("titles", none))
    text = F.when(text.contains("[[") | text.contains("anchor:"), F.regexp_replace(text, ANCHOR, '<a id="$1$2"></a>')).otherwise(text)
    numbered = F.when((F.col("context") == "section") & (F.col("level") <= numbers) & F.col("sect_number").isNotNull(), F.concat("sect_number", F.lit(" "), "title_html"))
    title = F.coalesce(numbered, F.when(F.col("caption").isNotNull() & (F.col("context") != "section"), F.concat("caption", "title_html")), F.col("title_html"))
    out = joined.withColumns({"text": text, "title_html": title, "id": F.coalesce("id", "sect_id")}).drop("s_doc", "s_node", "sect_id", "sect_number", "k_doc", "known", "n_doc", "titles", "number", "caption")
    out = durable(out, "linked")
    notes = footnote_facts(out)
    return facts, notes, _with_footnotes(out, notes)


def stylesheet(css: str | None = None, href: str | None = None) -> str:
    """The head's element for a style sheet: linked by its address, or embedded."""
    return f'<link rel="stylesheet" href="{href}">\n' if href else f"<style>\n{css}\n</style>\n" if css else ""


def to_page(nodes: DataFrame, toc: int = 0, numbers: int = 0, standalone: bool = False, xrefs: str = "basic", head: str = "", header: str = "", footer: str = "", lang: str = "en") -> DataFrame:
    """doc_id, html: whole documents with section ids, captions, references, footnotes, and contents to the level ``toc``.

    ``standalone`` puts them into a page; ``head``, ``header`` and ``footer``
    are what is put into its head, before and after its content (a style
    sheet's element, for one).
    """
    facts, notes, out = facts_and_nodes(nodes, xrefs, numbers)
    body = render.assemble(out.select("doc_id", "ord", render.html(F.lit(render.HERE)).alias("made")), "html")
    joined = body.join(footnote_list(notes).withColumnRenamed("doc_id", "f_doc"), F.col("doc_id") == F.col("f_doc"), "left")
    if toc:
        joined = joined.join(contents(facts, toc, numbers).withColumnRenamed("doc_id", "t_doc"), F.col("doc_id") == F.col("t_doc"), "left")
        box = F.coalesce(F.concat(F.lit('<div id="toc" class="toc">\n<div id="toctitle">Table of Contents</div>\n'), F.col("toc"), F.lit("</div>\n")), F.lit(""))
        # the contents stand after the title, or before all
        joined = joined.withColumn("html", F.when(F.col("html").startswith("<h1>"), F.concat(F.regexp_extract("html", "^(<h1>[^\n]*\n)", 1), box, F.regexp_replace("html", "^<h1>[^\n]*\n", ""))).otherwise(F.concat(box, "html")))
    whole = F.concat("html", F.coalesce("footnotes", F.lit("")))
    if standalone:
        titles = out.where("context = 'document'").select(F.col("doc_id").alias("d_doc"), F.coalesce(strip_tags("title_html"), F.lit("Untitled")).alias("doc_title"))
        joined = joined.join(titles, F.col("doc_id") == F.col("d_doc"))
        whole = F.concat(F.lit(f'<!DOCTYPE html>\n<html lang="{lang}">\n<head>\n<meta charset="UTF-8">\n<meta name="viewport" content="width=device-width, initial-scale=1.0">\n<title>'), "doc_title", F.lit(f'</title>\n{head}</head>\n<body class="article">\n{header}<div id="content">\n'), whole, F.lit(f"</div>\n{footer}</body>\n</html>\n"))
    return joined.select("doc_id", whole.alias("html"))


def chapters(nodes: DataFrame) -> DataFrame:
    """Adds page to nodes: the id of the chapter (section of level 1) that they are in, ``index`` for what is in none."""
    ids = section_facts(nodes).where("level = 1").select(F.col("doc_id").alias("c_doc"), F.col("ord").alias("c_ord"), F.col("sect_id").alias("page"))
    top = F.when(F.size("ord") > 0, F.slice("ord", 1, 1))
    # a chapter below a part has a path of two; both are looked up by equality
    out = nodes.withColumns({"one": top, "two": F.when(F.size("ord") > 1, F.slice("ord", 1, 2))})
    first = ids.withColumnRenamed("page", "page_one")
    second = ids.select(F.col("c_doc").alias("d_doc"), F.col("c_ord").alias("d_ord"), F.col("page").alias("page_two"))
    out = out.join(first, (F.col("doc_id") == F.col("c_doc")) & (F.col("one") == F.col("c_ord")), "left").join(second, (F.col("doc_id") == F.col("d_doc")) & (F.col("two") == F.col("d_ord")), "left")
    return out.withColumn("page", F.coalesce("page_two", "page_one", F.lit("index"))).drop("one", "two", "c_doc", "c_ord", "page_one", "d_doc", "d_ord", "page_two")


def to_pages(nodes: DataFrame, numbers: int = 0) -> DataFrame:
    """doc_id, page, nth, html, prev, next: a page per chapter and one of what stands before, with links between them; references to other pages' ids lead there."""
    facts, notes, out = facts_and_nodes(nodes, "basic", numbers)
    paged = chapters(nodes).select(F.col("doc_id").alias("p_doc"), F.col("node_id").alias("p_node"), "page")
    placed = out.join(paged, (F.col("doc_id") == F.col("p_doc")) & (F.col("node_id") == F.col("p_node"))).drop("p_doc", "p_node")
    key = F.concat_ws("\x01", "doc_id", "page")
    made = placed.where("context <> 'document'").select(key.alias("doc_id"), "ord", render.html(F.lit(render.HERE)).alias("made"))
    body = render.assemble(made, "html").select(F.substring_index("doc_id", "\x01", 1).alias("doc_id"), F.substring_index("doc_id", "\x01", -1).alias("page"), "html")
    first = placed.where("context <> 'document'").groupBy(F.col("doc_id").alias("o_doc"), F.col("page").alias("o_page")).agg(F.min("ord").alias("first"))
    ids = placed.where("id IS NOT NULL").groupBy(F.col("doc_id").alias("i_doc")).agg(F.map_from_entries(F.collect_set(F.struct("id", "page"))).alias("pages"))
    joined = body.join(first, (F.col("doc_id") == F.col("o_doc")) & (F.col("page") == F.col("o_page"))).join(ids, F.col("doc_id") == F.col("i_doc"), "left")
    by = Window.partitionBy("doc_id").orderBy("first")
    joined = joined.withColumns({"nth": F.row_number().over(by), "prev": F.lag("page").over(by), "next": F.lead("page").over(by)})
    pattern = r'href="#([^"]+)"'

    def moved(m: Column) -> Column:
        target = F.regexp_extract(m, pattern, 1)
        page = F.try_element_at(F.coalesce("pages", F.create_map().cast("map<string,string>")), target)
        return F.when(page.isNotNull() & (page != F.col("page")), F.concat(F.lit('href="'), page, F.lit(".html#"), target, F.lit('"'))).otherwise(m)

    across = lambda ms: F.array_join(F.zip_with(F.split("html", pattern), F.transform(ms, moved), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = let(F.regexp_extract_all("html", F.lit(pattern), F.lit(0)), across)
    nav = F.concat(F.lit("<nav>"), F.coalesce(F.concat(F.lit('<a rel="prev" href="'), "prev", F.lit('.html">Previous</a>')), F.lit("")), F.coalesce(F.concat(F.lit('<a rel="next" href="'), "next", F.lit('.html">Next</a>')), F.lit("")), F.lit("</nav>\n"))
    return joined.select("doc_id", "page", "nth", F.concat(text, nav).alias("html"), "prev", "next")
