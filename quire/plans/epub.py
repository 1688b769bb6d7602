"""EPUB 3 books: a page per chapter, the package document, contents in both forms, and the archive that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import codec
from quire.functions.text import special_characters, strip_tags
from quire.plans import balance, pages

CONTAINER = '<?xml version="1.0" encoding="UTF-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">\n<rootfiles>\n<rootfile full-path="EPUB/package.opf" media-type="application/oebps-package+xml"/>\n</rootfiles>\n</container>\n'


def xhtml(title, body):
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">\n<head>\n<title>'), title, F.lit("</title>\n</head>\n<body>\n"))
    # void elements end themselves in XML, and attributes have values
    closed = F.regexp_replace(body, r"<(br|hr|img|col|input|source)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)(?<!/)>", "<$1$2/>")
    closed = F.regexp_replace(closed, r" (controls|autoplay|loop|checked)(?=[ />])", ' $1="$1"')
    return F.concat(head, balance.balanced(closed), F.lit("</body>\n</html>\n"))


def to_epub(nodes: DataFrame, language: str = "en", modified: str = "2000-01-01T00:00:00Z", publisher: str | None = None) -> DataFrame:
    """doc_id, epub: an archive for each document. Equal documents give equal archives."""
    split = pages.to_pages(nodes)
    titles = nodes.where("context = 'document'").select(F.col("doc_id").alias("t_doc"), F.coalesce(special_characters("title"), F.lit("Untitled")).alias("book"))
    facts = pages.section_facts(nodes).where("level = 1").select(F.col("doc_id").alias("s_doc"), F.col("sect_id").alias("s_id"), strip_tags("title_html").alias("heading"))
    rows = split.join(titles, F.col("doc_id") == F.col("t_doc")).join(facts, (F.col("doc_id") == F.col("s_doc")) & (F.col("page") == F.col("s_id")), "left")
    rows = rows.withColumn("heading", F.coalesce("heading", F.col("book")))
    content = F.regexp_replace(F.regexp_replace("html", r"<nav>[\s\S]*?</nav>\n?$", ""), r'href="([^":#]+)\.html', 'href="$1.xhtml')
    rows = rows.select("doc_id", "book", "nth", "page", "heading", xhtml(F.col("heading"), content).alias("body"))
    listed = rows.groupBy("doc_id").agg(F.first("book").alias("book"), F.sort_array(F.collect_list(F.struct("nth", "page", "heading", "body"))).alias("p"))
    each = lambda made: F.array_join(F.transform("p", made), "")
    n = lambda x: x["nth"].cast("string")
    more = f"<dc:publisher>{publisher}</dc:publisher>\n" if publisher else ""
    package = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id">\n<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n<dc:identifier id="id">'), F.sha2("doc_id", 256), F.lit("</dc:identifier>\n<dc:title>"), "book",
        F.lit(f'</dc:title>\n<dc:language>{language}</dc:language>\n{more}<meta property="dcterms:modified">{modified}</meta>\n</metadata>\n<manifest>\n<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>\n<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>\n'),
        each(lambda x: F.concat(F.lit('<item id="p'), n(x), F.lit('" href="'), x["page"], F.lit('.xhtml" media-type="application/xhtml+xml"/>\n'))), F.lit('</manifest>\n<spine toc="ncx">\n'), each(lambda x: F.concat(F.lit('<itemref idref="p'), n(x), F.lit('"/>\n'))), F.lit("</spine>\n</package>\n"),
    )
    nav = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">\n<head>\n<title>'), "book", F.lit('</title>\n</head>\n<body>\n<nav epub:type="toc">\n<ol>\n'), each(lambda x: F.concat(F.lit('<li><a href="'), x["page"], F.lit('.xhtml">'), x["heading"], F.lit("</a></li>\n"))), F.lit("</ol>\n</nav>\n</body>\n</html>\n"))
    point = lambda x: F.concat(F.lit('<navPoint id="n'), n(x), F.lit('" playOrder="'), n(x), F.lit('">\n<navLabel><text>'), x["heading"], F.lit('</text></navLabel>\n<content src="'), x["page"], F.lit('.xhtml"/>\n</navPoint>\n'))
    ncx = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">\n<head>\n<meta name="dtb:uid" content="'), F.sha2("doc_id", 256), F.lit('"/>\n</head>\n<docTitle><text>'), "book", F.lit("</text></docTitle>\n<navMap>\n"), each(point), F.lit("</navMap>\n</ncx>\n"))
    names = F.concat(F.array(*map(F.lit, ("mimetype", "META-INF/container.xml", "EPUB/package.opf", "EPUB/nav.xhtml", "EPUB/toc.ncx"))), F.transform("p", lambda x: F.concat(F.lit("EPUB/"), x["page"], F.lit(".xhtml"))))
    bodies = F.concat(F.array(*[F.encode(x, "UTF-8") for x in (F.lit("application/epub+zip"), F.lit(CONTAINER), package, nav, ncx)]), F.transform("p", lambda x: F.encode(x["body"], "UTF-8")))
    return listed.select("doc_id", codec.zip_archive(names, bodies, F.array(F.lit("mimetype"))).alias("epub"))


def entries(books: DataFrame) -> DataFrame:
    """doc_id, name, size of what is in each book, for checks."""
    found = books.select("doc_id", F.explode(codec.zip_entries("epub")).alias("e"))
    return found.select("doc_id", "e.name", F.octet_length("e.content").alias("size"))

