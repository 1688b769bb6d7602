"""Manual pages of node tables: roff requests before and after a node's children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import decode_entities, let, strip_tags
from quire.plans import pages
from quire.plans.render import HERE, assemble

#: Formatted text of HTML and its fonts, and characters with names of their own.
FONTS = [("<strong>", "\\fB"), ("</strong>", "\\fP"), ("<em>", "\\fI"), ("</em>", "\\fP"), ("<code>", "\\f(CR"), ("</code>", "\\fP"), ("<kbd>", "\\fB"), ("</kbd>", "\\fP"), ("<br>", "\n.br")]
CHARACTERS = [("\u2014", "\\(em"), ("\u2013", "\\(en"), ("\u2018", "\\(oq"), ("\u2019", "\\(cq"), ("\u201c", "\\(lq"), ("\u201d", "\\(rq"), ("\u2026", "..."), ("\u00a9", "\\(co"), ("\u00ae", "\\(rg"), ("\u2122", "\\(tm"), ("\u00a0", "\\ "), ("\u200b", "\\:"), ("\u2009", " "), ("\u2192", "\\(->"), ("\u2190", "\\(<-"), ("\u21d2", "\\(rA"), ("\u21d0", "\\(lA"), ("\u00b0", "\\(de"), ("\u2022", "\\(bu")]


def escaped(t: Column) -> Column:
    """Text that roff would read as requests or escapes, made plain."""
    out = F.replace(t, F.lit("\\"), F.lit("\\(rs"))
    out = F.regexp_replace(out, r"(?m)^\.", "\\\\\\\\&.")
    out = F.replace(F.replace(out, F.lit("-"), F.lit("\\-")), F.lit("'"), F.lit("\\(aq"))
    for a, b in CHARACTERS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def manified(html: Column) -> Column:
    """Converted text as roff: fonts for formatting, links as their text and address."""
    marks = html
    for i, (tag, _) in enumerate(FONTS):
        marks = F.replace(marks, F.lit(tag), F.lit(chr(0xE000 + i)))
    marks = F.regexp_replace(marks, r'<a href="([^"]*)" class="bare">[^<]*</a>', "$1")
    marks = F.regexp_replace(marks, r'<a href="(?:mailto:)?([^"#][^"]*)"[^>]*>([\s\S]*?)</a>', "$2 &lt;$1&gt;")
    out = let(decode_entities(strip_tags(marks)), escaped)
    for i, (_, font) in enumerate(FONTS):
        out = F.replace(out, F.lit(chr(0xE000 + i)), F.lit(font))
    return F.regexp_replace(out, "\n{2,}", "\n")


def roff(inside: Column) -> Column:
    c, text, raw = F.col("context"), F.col("text"), F.col("raw")
    title = F.when(F.col("title").isNotNull(), F.concat(F.lit(".sp\n.B "), "title_roff", F.lit("\n.br\n"))).otherwise("")
    block = F.when(F.col("source").isNotNull(), F.concat(F.lit(".sp\n"), text, F.lit("\n"))).otherwise("")
    shown = F.concat(F.lit(".sp\n.if n .RS 4\n.nf\n.fam C\n"), raw, F.lit("\n.fam\n.fi\n.if n .RE\n"))
    bullet = F.when(F.col("marker").rlike(r"^(?:[-*\u2022]+)$"), F.lit("\\(bu")).when(F.col("marker").startswith("<"), F.concat(F.lit("\\fB("), F.regexp_replace("marker", "[<>]", ""), F.lit(")\\fP"))).otherwise(F.concat(F.col("nth").cast("string"), F.lit(".")))
    item = F.concat(F.lit(".sp\n.RS 4\n.ie n \\{\\\n\\h'-04'"), bullet, F.lit("\\h'+03'\\c\n.\\}\n.el \\{\\\n.  sp -1\n.  IP "), bullet, F.lit(" 2.3\n.\\}\n"), text, F.lit("\n"), inside, F.lit(".RE\n"))
    boxed = F.concat(title, F.lit(".RS 3\n.ll -.6i\n"), block, inside, F.lit(".br\n.RE\n.ll\n"))
    return (
        F.when(c.isin("document", "preamble", "ulist", "olist", "colist", "dlist", "open", "example"), F.concat(F.when(c != "document", title).otherwise(""), block, inside))
        .when((c == "section") & (F.col("level") <= 1), F.concat(F.lit('.SH "'), F.upper("title_roff"), F.lit('"\n'), inside))
        .when(c.isin("section", "floating_title"), F.concat(F.lit('.SS "'), F.col("title_roff"), F.lit('"\n'), inside))
        .when(c == "paragraph", F.concat(title, block))
        .when(c == "dlist_term", F.concat(F.lit(".sp\n"), text, F.lit("\n")))
        .when((c == "list_item") & F.col("marker").rlike("^(:{2,4}|;;)$"), F.concat(F.lit(".RS 4\n"), text, F.lit("\n"), inside, F.lit(".RE\n")))
        .when(c == "list_item", item)
        .when(c.isin("listing", "literal", "verse", "stem"), F.concat(title, shown))
        .when(c == "admonition", F.concat(F.lit(".if n .sp\n.RS 4\n.it 1 an-trap\n.nr an-no-space-flag 1\n.nr an-break-flag 1\n.br\n.ps +1\n.B "), F.initcap(F.coalesce("style", F.lit("note"))), F.lit("\n.ps -1\n.br\n"), block, inside, F.lit(".sp .5v\n.RE\n")))
        .when(c.isin("quote", "sidebar"), boxed)
        .when(c == "table", F.concat(title, F.lit(".TS\nallbox tab(:);\n"), F.repeat(F.lit("lt "), F.coalesce(F.try_element_at("attrs", F.lit("colcount")).try_cast("int"), F.lit(1))), F.lit(".\n"), inside, F.lit(".TE\n.sp\n")))
        .when(c == "table_row", F.concat(inside, F.lit("\n")))
        .when(c == "table_cell", F.concat(F.lit("T{\n"), text, inside, F.lit("\nT}:")))
        .when(c == "image", F.concat(F.lit(".sp\n["), F.coalesce(F.try_element_at("attrs", F.lit("alt")), F.lit("")), F.lit("]\n")))
        .when(c == "thematic_break", F.lit(".sp\n.ce\n\\l'\\n(.lu*25u/100u\\(ap'\n"))
        .when(c == "pass", F.coalesce("source", F.lit("")))
        .otherwise(inside)
    )


def to_manpage(nodes: DataFrame, manual: str = "", source: str = "") -> DataFrame:
    """doc_id, man: each document as a manual page. A title ``name(volume)`` gives its name and volume; without one, volume 1."""
    source_text = F.replace(F.coalesce("source", F.lit("")), F.lit(HERE), F.lit(""))
    nth = F.row_number().over(Window.partitionBy("doc_id", "parent_id", "context").orderBy("ord"))
    # in two steps: Spark resolves a limited number of expressions inside each other at once
    _, notes, made = pages.facts_and_nodes(nodes)
    ready = made.withColumns({"raw": let(source_text, escaped), "nth": nth, "text": manified(F.col("text")), "title_roff": manified(F.col("title_html"))})
    body = assemble(ready.select("doc_id", "ord", roff(F.lit(HERE)).alias("made")), "body")
    listed = notes.where("NOT is_ref").groupBy(F.col("doc_id").alias("f_doc")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "text"))), lambda x: F.concat(F.lit(".IP ["), x["number"].cast("string"), F.lit("]\n"), manified(x["text"]), F.lit("\n"))), "").alias("notes"))
    body = body.join(listed, F.col("doc_id") == F.col("f_doc"), "left").withColumn("body", F.concat("body", F.coalesce(F.concat(F.lit('.SH "NOTES"\n'), "notes"), F.lit("")))).drop("f_doc", "notes")
    titles = nodes.where("context = 'document'").select(F.col("doc_id").alias("t_doc"), F.coalesce("title", F.col("doc_id")).alias("title"))
    pattern = r"^(.+?) *\( *(.+?) *\)$"
    name = F.when(F.col("title").rlike(pattern), F.regexp_extract("title", pattern, 1)).otherwise(F.col("title"))
    volume = F.when(F.col("title").rlike(pattern), F.regexp_extract("title", pattern, 2)).otherwise("1")
    head = F.concat(F.lit("'\\\" t\n.TH \""), let(F.upper(name), escaped), F.lit('" "'), volume, F.lit(f'" "" "{source}" "{manual}"\n.ie \\n(.g .ds Aq \\(aq\n.el       .ds Aq \'\n.ss \\n[.ss] 0\n.nh\n.ad l\n'))
    return body.join(titles, F.col("doc_id") == F.col("t_doc")).select("doc_id", F.concat(head, "body").alias("man"))

