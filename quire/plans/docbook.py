"""DocBook of node tables, put together like the HTML: what stands before and after a node's children, sorted by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import inline
from quire.functions.text import let, special_characters
from quire.plans.render import HERE, assemble

#: Elements of kinds of nodes that only wrap their children.
WRAPPERS = {"ulist": "itemizedlist", "olist": "orderedlist", "colist": "calloutlist", "dlist": "variablelist", "sidebar": "sidebar", "example": "informalexample", "open": "para", "quote": "blockquote"}
#: How formatted text of HTML is named here.
INLINE = [("<strong>", '<emphasis role="strong">'), ("</strong>", "</emphasis>"), ("<em>", "<emphasis>"), ("</em>", "</emphasis>"), ("<code>", "<literal>"), ("</code>", "</literal>"), ("<sup>", "<superscript>"), ("</sup>", "</superscript>"), ("<sub>", "<subscript>"), ("</sub>", "</subscript>"), ("<br>", "<?asciidoc-br?>")]


def _text(t: Column) -> Column:
    out = inline.post_replacements(inline.replacements(inline.quotes(special_characters(t))))
    for a, b in INLINE:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _tag(name, inside: Column, title: bool = True) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    ident = F.when(F.col("id").isNotNull(), F.concat(F.lit(' xml:id="'), "id", F.lit('"'))).otherwise("")
    role = F.when(F.size("roles") > 0, F.concat(F.lit(' role="'), F.array_join("roles", " "), F.lit('"'))).otherwise("")
    head = F.when(F.col("title_xml").isNotNull(), F.concat(F.lit("<title>"), "title_xml", F.lit("</title>\n"))).otherwise("") if title else F.lit("")
    return F.concat(F.lit("<"), name, ident, role, F.lit(">\n"), head, inside, F.lit("</"), name, F.lit(">\n"))


def xml(inside: Column) -> Column:
    c, text, raw = F.col("context"), F.col("text"), F.col("raw")
    para = F.when(F.col("source").isNotNull(), F.concat(F.lit("<simpara>"), text, F.lit("</simpara>\n"))).otherwise("")
    wrapper = F.try_element_at(F.create_map(*[F.lit(y) for kv in WRAPPERS.items() for y in kv]), c)
    screen = lambda tag: F.concat(F.lit(f"<{tag}>"), raw, F.lit(f"</{tag}>\n"))
    return (
        F.when(c == "document", inside)
        .when(c == "preamble", inside)
        .when(c == "section", _tag("section", inside))
        .when(c == "floating_title", F.concat(F.lit('<bridgehead renderas="sect'), F.col("level").cast("string"), F.lit('">'), "title_xml", F.lit("</bridgehead>\n")))
        .when(c == "paragraph", para)
        .when(c == "dlist_term", F.concat(F.lit("<term>"), text, F.lit("</term>\n")))
        .when(c == "list_item", F.concat(F.lit("<listitem>\n"), para, inside, F.lit("</listitem>\n")))
        .when(c == "listing", F.when(F.col("style") == "source", F.concat(F.lit('<programlisting language="'), F.coalesce(F.try_element_at("attrs", F.lit("language")), F.try_element_at("attrs", F.lit("2")), F.lit("")), F.lit('">'), raw, F.lit("</programlisting>\n"))).otherwise(screen("screen")))
        .when(c == "literal", screen("literallayout"))
        .when(c == "verse", F.concat(F.lit("<blockquote>\n<literallayout>"), text, F.lit("</literallayout>\n</blockquote>\n")))
        .when(c == "admonition", _tag(F.lower(F.coalesce("style", F.lit("note"))), F.concat(para, inside)))
        .when(c == "image", F.concat(F.lit('<informalfigure>\n<mediaobject>\n<imageobject>\n<imagedata fileref="'), F.try_element_at("attrs", F.lit("target")), F.lit('"/>\n</imageobject>\n<textobject><phrase>'), F.try_element_at("attrs", F.lit("alt")), F.lit("</phrase></textobject>\n</mediaobject>\n</informalfigure>\n")))
        .when(c == "table", F.concat(F.when(F.col("title").isNotNull(), F.concat(F.lit("<table>\n<title>"), "title_xml", F.lit("</title>\n"))).otherwise("<informaltable>\n"), F.lit('<tgroup cols="'), F.coalesce(F.try_element_at("attrs", F.lit("colcount")), F.lit("1")), F.lit('">\n'), inside, F.lit("</tgroup>\n"), F.when(F.col("title").isNotNull(), "</table>\n").otherwise("</informaltable>\n")))
        .when(c == "table_part", F.concat(F.lit("<t"), F.col("style"), F.lit(">\n"), inside, F.lit("</t"), F.col("style"), F.lit(">\n")))
        .when(c == "table_row", F.concat(F.lit("<row>\n"), inside, F.lit("</row>\n")))
        .when(c == "table_cell", F.concat(F.lit('<entry align="'), F.coalesce(F.try_element_at("attrs", F.lit("halign")), F.lit("left")), F.lit('" valign="'), F.coalesce(F.try_element_at("attrs", F.lit("valign")), F.lit("top")), F.lit('"'), F.when(F.map_contains_key("attrs", F.lit("rowspan")), F.concat(F.lit(' morerows="'), (F.try_element_at("attrs", F.lit("rowspan")).cast("int") - 1).cast("string"), F.lit('"'))).otherwise(""), F.lit(">"), F.when(F.col("source").isNotNull() & (F.col("source") != ""), F.when(F.col("style") == "header", text).otherwise(F.concat(F.lit("<simpara>"), text, F.lit("</simpara>")))).otherwise(inside), F.lit("</entry>\n")))
        .when(c.isin("audio", "video"), F.concat(F.lit("<informalfigure>\n<mediaobject>\n<"), c, F.lit("object>\n<"), c, F.lit('data fileref="'), F.try_element_at("attrs", F.lit("target")), F.lit('"/>\n</'), c, F.lit("object>\n</mediaobject>\n</informalfigure>\n")))
        .when(c == "stem", F.concat(F.lit("<informalequation>\n<mathphrase>"), raw, F.lit("</mathphrase>\n</informalequation>\n")))
        .when(c == "pass", F.coalesce("source", F.lit("")))
        .when(c == "page_break", F.lit("<?asciidoc-pagebreak?>\n"))
        .when(c == "thematic_break", F.lit("<?asciidoc-hr?>\n"))
        .when(wrapper.isNotNull(), _tag(wrapper, F.concat(para, inside)))
        .otherwise(inside)
    )


def to_docbook(nodes: DataFrame) -> DataFrame:
    """doc_id, xml: the body of each document's article, its text passes but macros carried out."""
    source = F.replace(F.coalesce("source", F.lit("")), F.lit(HERE), F.lit(""))
    ready = nodes.withColumns({"text": let(source, _text), "raw": let(source, special_characters), "title_xml": let(F.col("title"), _text)})
    return assemble(ready.select("doc_id", "ord", xml(F.lit(HERE)).alias("made")), "xml")
