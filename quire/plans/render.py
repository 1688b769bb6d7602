"""HTML of node tables: a template per kind of node, put together in one aggregate per document.

A template is what stands before and after a node's children. Sorted by path,
with each node's end as the last of its children, these parts are the
document; so one shuffle by document joins a tree of any depth. Text passes
are Column expressions, computed once per node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import inline
from quire.functions.text import let, special_characters

#: Stands where a node's children go.
HERE = "\x00"
#: Greater than any child's number.
LAST = 2**31 - 1


def _title(tag: str = "div") -> Column:
    return F.when(F.col("title").isNotNull(), F.concat(F.lit(f'<{tag} class="title">'), F.col("title_html"), F.lit(f"</{tag}>\n"))).otherwise("")


def _classes(*names) -> Column:
    return F.concat(F.lit('<div class="'), F.array_join(F.concat(F.array(*names), "roles"), " "), F.lit('"'), F.when(F.col("id").isNotNull(), F.concat(F.lit(' id="'), "id", F.lit('"'))).otherwise(""), F.lit(">\n"))


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _table(inside: Column) -> Column:
    width = F.when(F.map_contains_key("attrs", F.lit("autowidth-option")), "fit-content").otherwise("stretch")
    classes = F.array_join(F.concat(F.array(F.lit("tableblock"), F.concat(F.lit("frame-"), F.coalesce(_attr("frame"), F.lit("all"))), F.concat(F.lit("grid-"), F.coalesce(_attr("grid"), F.lit("all")))), F.array(width), F.when(_attr("stripes").isNotNull(), F.array(F.concat(F.lit("stripes-"), _attr("stripes")))).otherwise(F.array().cast("array<string>")), "roles"), " ")
    ident = F.when(F.col("id").isNotNull(), F.concat(F.lit(' id="'), "id", F.lit('"'))).otherwise("")
    caption = F.when(F.col("title").isNotNull(), F.concat(F.lit('<caption class="title">'), F.col("title_html"), F.lit("</caption>\n"))).otherwise("")
    sized = F.transform(F.split(_attr("colwidths"), " "), lambda w: F.concat(F.lit('<col style="width: '), w, F.lit('%;">\n')))
    columns = F.when(_attr("colwidths").isNotNull(), F.array_join(sized, "")).otherwise(F.repeat(F.lit("<col>\n"), F.coalesce(_attr("colcount").try_cast("int"), F.lit(0))))
    return F.concat(F.lit("<table"), ident, F.lit(' class="'), classes, F.lit('">\n'), caption, F.lit("<colgroup>\n"), columns, F.lit("</colgroup>\n"), inside, F.lit("</table>\n"))


def _cell(inside: Column) -> Column:
    style = F.coalesce("style", F.lit("none"))
    tag = F.when(style == "header", "th").otherwise("td")
    span = lambda name: F.when(_attr(name).isNotNull(), F.concat(F.lit(f' {name}="'), _attr(name), F.lit('"'))).otherwise("")
    around = lambda name: F.concat(F.lit(f'<p class="tableblock"><{name}>'), F.regexp_replace("text", r"\n{2,}", f'</{name}></p>\n<p class="tableblock"><{name}>'), F.lit(f"</{name}></p>"))
    plain = F.concat(F.lit('<p class="tableblock">'), F.regexp_replace("text", r"\n{2,}", '</p>\n<p class="tableblock">'), F.lit("</p>"))
    body = (
        F.when(F.coalesce("source", F.lit("")) == "", F.when(style == "document", F.concat(F.lit('<div class="content">'), inside, F.lit("</div>"))).otherwise(""))
        .when(style == "header", F.col("text")).when(style == "strong", around("strong")).when(style == "emphasis", around("em")).when(style == "monospaced", around("code"))
        .when(style == "literal", F.concat(F.lit('<div class="literal"><pre>'), F.col("raw"), F.lit("</pre></div>"))).when(style == "verse", F.concat(F.lit('<div class="verse">'), F.col("text"), F.lit("</div>"))).otherwise(plain)
    )
    return F.concat(F.lit("<"), tag, F.lit(' class="tableblock halign-'), F.coalesce(_attr("halign"), F.lit("left")), F.lit(" valign-"), F.coalesce(_attr("valign"), F.lit("top")), F.lit('"'), span("colspan"), span("rowspan"), F.lit(">"), body, F.lit("</"), tag, F.lit(">\n"))


def html(inside: Column) -> Column:
    """The node's HTML around that of its children."""
    text, raw = F.col("text"), F.col("raw")
    content = F.when(F.col("source").isNotNull(), F.concat(text, F.lit("\n"), inside)).otherwise(inside)
    level = F.col("level")
    heading = F.concat(F.lit("<h"), (level + 1).cast("string"), F.when(F.col("id").isNotNull(), F.concat(F.lit(' id="'), "id", F.lit('"'))).otherwise(""), F.lit(">"), F.col("title_html"), F.lit("</h"), (level + 1).cast("string"), F.lit(">\n"))
    box = lambda name: F.concat(_classes(F.lit(name)), _title(), F.lit('<div class="content">\n'), content, F.lit("</div>\n</div>\n"))
    c = F.col("context")
    checked = F.when(F.map_contains_key("attrs", F.lit("checked")), "&#10003; ").when(F.map_contains_key("attrs", F.lit("checkbox")), "&#10063; ").otherwise("")
    return (
        F.when(c == "document", F.concat(F.when(F.col("title").isNotNull(), F.concat(F.lit("<h1>"), F.col("title_html"), F.lit("</h1>\n"))).otherwise(""), inside))
        .when((c == "section") & (level == 0), F.concat(F.lit('<h1 class="sect0">'), F.col("title_html"), F.lit("</h1>\n"), inside))
        .when((c == "section") & (level == 1), F.concat(F.lit('<div class="sect1">\n'), heading, F.lit('<div class="sectionbody">\n'), inside, F.lit("</div>\n</div>\n")))
        .when(c == "section", F.concat(F.lit('<div class="sect'), level.cast("string"), F.lit('">\n'), heading, inside, F.lit("</div>\n")))
        .when(c == "floating_title", heading)
        .when(c == "preamble", F.concat(F.lit('<div id="preamble">\n<div class="sectionbody">\n'), inside, F.lit("</div>\n</div>\n")))
        .when(c == "paragraph", F.concat(_classes(F.lit("paragraph")), _title(), F.lit("<p>"), text, F.lit("</p>\n</div>\n")))
        .when(c == "ulist", F.concat(_classes(F.lit("ulist")), _title(), F.lit("<ul>\n"), inside, F.lit("</ul>\n</div>\n")))
        .when(c == "olist", F.concat(_classes(F.lit("olist"), F.lit("arabic")), _title(), F.lit('<ol class="arabic"'), F.when(F.map_contains_key("attrs", F.lit("start")), F.concat(F.lit(' start="'), F.try_element_at("attrs", F.lit("start")), F.lit('"'))).otherwise(""), F.lit(">\n"), inside, F.lit("</ol>\n</div>\n")))
        .when(c == "colist", F.concat(_classes(F.lit("colist")), F.lit("<ol>\n"), inside, F.lit("</ol>\n</div>\n")))
        .when((c == "list_item") & F.col("marker").rlike("^(:{2,4}|;;)$"), F.concat(F.lit("<dd>\n<p>"), text, F.lit("</p>\n"), inside, F.lit("</dd>\n")))
        .when(c == "list_item", F.concat(F.lit("<li>\n<p>"), checked, text, F.lit("</p>\n"), inside, F.lit("</li>\n")))
        .when(c == "dlist", F.concat(_classes(F.lit("dlist")), _title(), F.lit("<dl>\n"), inside, F.lit("</dl>\n</div>\n")))
        .when(c == "dlist_term", F.concat(F.lit('<dt class="hdlist1">'), text, F.lit("</dt>\n")))
        .when((c == "listing") & (F.col("style") == "source"), F.concat(_classes(F.lit("listingblock")), _title(), F.lit('<div class="content">\n<pre class="highlight"><code'), F.coalesce(F.concat(F.lit(' class="language-'), F.coalesce(F.try_element_at("attrs", F.lit("language")), F.try_element_at("attrs", F.lit("2"))), F.lit('" data-lang="'), F.coalesce(F.try_element_at("attrs", F.lit("language")), F.try_element_at("attrs", F.lit("2"))), F.lit('"')), F.lit("")), F.lit(">"), raw, F.lit("</code></pre>\n</div>\n</div>\n")))
        .when(c == "listing", F.concat(_classes(F.lit("listingblock")), _title(), F.lit('<div class="content">\n<pre>'), raw, F.lit("</pre>\n</div>\n</div>\n")))
        .when(c == "literal", F.concat(_classes(F.lit("literalblock")), _title(), F.lit('<div class="content">\n<pre>'), raw, F.lit("</pre>\n</div>\n</div>\n")))
        .when(c == "pass", F.coalesce("source", F.lit("")))
        .when(c == "stem", F.concat(_classes(F.lit("stemblock")), F.lit('<div class="content">\n\\$'), raw, F.lit("\\$\n</div>\n</div>\n")))
        .when(c == "admonition", F.concat(_classes(F.lit("admonitionblock"), F.lower(F.coalesce("style", F.lit("note")))), F.lit('<table>\n<tr>\n<td class="icon">\n<div class="title">'), F.initcap(F.coalesce("style", F.lit("note"))), F.lit('</div>\n</td>\n<td class="content">\n'), _title(), content, F.lit("</td>\n</tr>\n</table>\n</div>\n")))
        .when(c == "quote", F.concat(_classes(F.lit("quoteblock")), _title(), F.lit("<blockquote>\n"), content, F.lit("</blockquote>\n</div>\n")))
        .when(c == "verse", F.concat(_classes(F.lit("verseblock")), _title(), F.lit('<pre class="content">'), text, F.lit("</pre>\n</div>\n")))
        .when(c == "sidebar", F.concat(_classes(F.lit("sidebarblock")), F.lit('<div class="content">\n'), _title(), content, F.lit("</div>\n</div>\n")))
        .when(c == "example", box("exampleblock"))
        .when(c == "open", box("openblock"))
        .when(c == "image", F.concat(_classes(F.lit("imageblock")), F.lit('<div class="content">\n<img src="'), F.try_element_at("attrs", F.lit("target")), F.lit('" alt="'), F.try_element_at("attrs", F.lit("alt")), F.lit('">\n</div>\n'), _title(), F.lit("</div>\n")))
        .when(c == "table", _table(inside))
        .when(c == "table_part", F.concat(F.lit("<t"), F.col("style"), F.lit(">\n"), inside, F.lit("</t"), F.col("style"), F.lit(">\n")))
        .when(c == "table_row", F.concat(F.lit("<tr>\n"), inside, F.lit("</tr>\n")))
        .when(c == "table_cell", _cell(inside))
        .when(c.isin("audio", "video"), F.concat(F.lit('<div class="'), c, F.lit('block">\n<div class="content">\n<'), c, F.lit(' src="'), _attr("target"), F.lit('"'), F.when(F.map_contains_key("attrs", F.lit("width")), F.concat(F.lit(' width="'), _attr("width"), F.lit('"'))).otherwise(""), F.when(F.map_contains_key("attrs", F.lit("autoplay-option")), " autoplay").otherwise(""), F.when(F.map_contains_key("attrs", F.lit("nocontrols-option")), "").otherwise(" controls"), F.when(F.map_contains_key("attrs", F.lit("loop-option")), " loop").otherwise(""), F.lit(">\nYour browser does not support the "), c, F.lit(" tag.\n</"), c, F.lit(">\n</div>\n</div>\n")))
        .when(c == "thematic_break", F.lit("<hr>\n"))
        .when(c == "page_break", F.lit('<div style="page-break-after: always;"></div>\n'))
        .otherwise(inside)
    )


def assemble(made: DataFrame, name: str) -> DataFrame:
    """doc_id and the whole document from (doc_id, ord, made), in which HERE stands where children go."""
    parts = made.select("doc_id", "ord", F.split("made", HERE).alias("parts"))
    begin = F.struct(F.col("ord").alias("place"), F.get("parts", F.lit(0)).alias("piece"))
    end = F.struct(F.array_append("ord", F.lit(LAST)).alias("place"), F.coalesce(F.get("parts", F.lit(1)), F.lit("")).alias("piece"))
    events = parts.select("doc_id", F.explode(F.array(begin, end)).alias("event"))
    return events.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event")), lambda r: r["piece"]), "").alias(name))


def verbatim(source: Column) -> Column:
    """The text of a listing: special characters as entities, callouts at lines' ends as numbers."""
    shown = lambda x: inline.restore_callouts(let(x["text"], special_characters), x["marks"])
    return F.when(source.contains("<"), let(inline.extract_callouts(source), shown)).otherwise(special_characters(source))


def ready(nodes: DataFrame) -> DataFrame:
    """Nodes with text, raw and title_html, what their passes make of source and title."""
    source = F.replace(F.coalesce("source", F.lit("")), F.lit(HERE), F.lit(""))
    listing = F.col("context").isin("listing", "literal")
    return nodes.withColumns({"text": F.when(~listing, inline.normal(source)), "raw": F.when(listing, verbatim(source)).otherwise(special_characters(source)), "title_html": inline.normal("title")})


def to_html(nodes: DataFrame) -> DataFrame:
    """doc_id, html: the embedded HTML of each document."""
    return assemble(ready(nodes).select("doc_id", "ord", html(F.lit(HERE)).alias("made")), "html")
