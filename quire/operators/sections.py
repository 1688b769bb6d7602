"""Sections: titles, parents, numbers, ids and the outline, by windows over a document's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import section_id, to_alpha, to_roman

TITLE = r"^(={1,6}|#{1,6})[ \t]+(\S.*?)(?:[ \t]+\1)?$"


def titles(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, level (0 for one mark), title of each one-line section title."""
    return rows.where(F.col("text").rlike(TITLE)).select("doc_id", "line_no", (F.length(F.regexp_extract("text", TITLE, 1)) - 1).alias("level"), F.regexp_extract("text", TITLE, 2).alias("title"))


def underlined_titles(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, level, title of two-line titles: an underline of ``=-~^+`` as long as the title, give or take one."""
    under = F.lead("text").over(Window.partitionBy("doc_id").orderBy("line_no"))
    marks = F.array(*map(F.lit, "=-~^+"))
    pairs = rows.withColumn("under", under).where(F.col("under").rlike(r"^(=|-|~|\^|\+)\1+$") & F.col("text").rlike(r"[\p{L}\p{N}]") & (F.abs(F.length("text") - F.length("under")) <= 1))
    return pairs.select("doc_id", "line_no", (F.array_position(marks, F.left("under", F.lit(1))) - 1).cast("int").alias("level"), F.col("text").alias("title"))


def tree(sections: DataFrame, deepest: int = 5) -> DataFrame:
    """Adds parent_line (null at the top), path (lines of the section and its ancestors), warned (a level was skipped).

    The ancestor at each level is the last section of that level before this
    one, unless a shallower one came later: one window, no self-join.
    """
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.col("line_no")), True).over(before) for k in range(deepest + 1)}
    out = sections
    for k in range(deepest + 1):
        out = out.withColumn(f"at_{k}", last[k])
    alive = []
    for k in range(deepest + 1):
        newer = F.lit(False)
        for j in range(k):
            newer = newer | (F.col(f"at_{j}") > F.col(f"at_{k}"))
        alive.append(F.when((F.col("level") > k) & F.col(f"at_{k}").isNotNull() & ~F.coalesce(newer, F.lit(False)), F.col(f"at_{k}")))
    ancestors = F.filter(F.array(*alive), lambda x: x.isNotNull())
    out = out.withColumn("path", F.array_append(ancestors, F.col("line_no"))).withColumn("parent_line", F.get("path", F.size("path") - 2))
    above = F.lag("level").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return out.withColumn("warned", F.coalesce(F.col("level") > above + 1, F.lit(False))).drop(*[f"at_{k}" for k in range(deepest + 1)])


def numbered(sections: DataFrame) -> DataFrame:
    """Adds ordinal (within the parent) and sectnum (``1.2.3.``) to the rows of ``tree``; level 0 carries no number."""
    own = sections.withColumn("ordinal", F.when(F.col("level") > 0, F.row_number().over(Window.partitionBy("doc_id", "parent_line", (F.col("level") > 0)).orderBy("line_no"))))
    by_doc = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out, parts = own, []
    # an ancestor's ordinal is the last one seen at the line that the path names
    for k in range(1, 6):
        level = F.last(F.when(F.col("level") == k, F.col("ordinal")), True).over(by_doc)
        line = F.last(F.when(F.col("level") == k, F.col("line_no")), True).over(by_doc)
        parts.append(F.when(F.array_contains("path", line) & (F.col("level") >= k), level))
    number = F.array_join(F.filter(F.transform(F.array(*parts), lambda n: n.cast("string")), lambda n: n.isNotNull()), ".")
    return out.withColumn("sectnum", F.when(F.col("level") > 0, F.concat(number, F.lit("."))))


def numeral(ordinal, kind: str = "arabic") -> Column:
    """How an ordinal is shown: arabic, roman (parts) or alpha (appendices)."""
    n = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return {"arabic": n.cast("string"), "roman": to_roman(n), "alpha": to_alpha(n, True)}[kind]


def unique_ids(rows: DataFrame, base: str = "base", out: str = "id", group: str = "doc_id", order: str = "line_no", separator: str = "_") -> DataFrame:
    """Ids from base ids: the first of equal ones as it is, others with ``_2``, ``_3``."""
    nth = F.row_number().over(Window.partitionBy(group, base).orderBy(order))
    return rows.withColumn(out, F.when(nth == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit(separator), nth.cast("string"))))


def outline(rows: DataFrame, levels: int = 2) -> DataFrame:
    """doc_id, line_no, level, sectnum, title, id: the table of contents of documents given as lines."""
    found = numbered(tree(titles(rows)))
    return unique_ids(found.withColumn("base", section_id("title"))).where((F.col("level") >= 1) & (F.col("level") <= levels)).select("doc_id", "line_no", "level", "sectnum", "title", "id")


def outline_text(toc: DataFrame) -> DataFrame:
    """doc_id and the outline as indented lines, in order."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "sectnum", F.lit(" "), "title")
    return toc.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))), lambda r: r["line"]), "\n").alias("outline"))


#: The patterns of the author and revision lines.
AUTHOR = r"^([\p{L}\p{M}\p{Nd}\p{Pc}][\p{L}\p{M}\p{Nd}\p{Pc}\-'.]*)(?: +([\p{L}\p{M}\p{Nd}\p{Pc}][\p{L}\p{M}\p{Nd}\p{Pc}\-'.]*))?(?: +([\p{L}\p{M}\p{Nd}\p{Pc}][\p{L}\p{M}\p{Nd}\p{Pc}\-'.]*))?(?: +<([^>]+)>)?$"
REVISION = r"^(?:[^\d{]*(.*?),)? *(?!:)(.*?)(?: *(?!^),?: *(.*))?$"


def authors(line: Column) -> Column:
    """Structs of firstname, middlename, lastname, email, initials of an author line; underscores stand for spaces."""

    def parsed(a: Column) -> Column:
        part = lambda k: F.regexp_replace(F.regexp_extract(a, AUTHOR, k), "_", " ")
        one, two, three = part(1), part(2), part(3)
        ok = a.rlike(AUTHOR)
        first = F.when(ok, one).otherwise(a)
        middle, last = F.when(three != "", two), F.nullif(F.when(three != "", three).otherwise(two), F.lit(""))
        initials = F.concat_ws("", F.left(first, F.lit(1)), F.left(middle, F.lit(1)), F.left(last, F.lit(1)))
        return F.struct(first.alias("firstname"), middle.alias("middlename"), last.alias("lastname"), F.nullif(F.regexp_extract(a, AUTHOR, 4), F.lit("")).alias("email"), initials.alias("initials"))

    return F.transform(F.filter(F.split(line, r";(?: |$)"), lambda a: a != ""), parsed)


def revision(line: Column) -> Column:
    """Struct of revnumber, revdate, revremark of a revision line; a lone part is the number only if it begins with v."""
    number, date, remark = (F.nullif(F.btrim(F.regexp_extract(line, REVISION, k)), F.lit("")) for k in (1, 2, 3))
    alone = number.isNull() & date.startswith("v")
    return F.struct(F.when(alone, F.substring(date, 2, 1000)).otherwise(number).alias("revnumber"), F.when(~F.coalesce(alone, F.lit(False)), date).alias("revdate"), remark.alias("revremark"))


def man_header(title: Column) -> Column:
    """Struct of name and volume of a manual page's title ``name(1)``."""
    return F.struct(F.regexp_extract(title, r"^(.+?) *\( *(.+?) *\)$", 1).alias("name"), F.regexp_extract(title, r"^(.+?) *\( *(.+?) *\)$", 2).alias("volume"))


def xref_text(style: str, signifier: Column, number: Column, title: Column) -> Column:
    """Text of a reference to a section: full, short or basic."""
    full = F.concat_ws(" ", signifier, number)
    quoted = F.concat(F.lit("&#8220;"), title, F.lit("&#8221;"))
    return F.when(number.isNull(), title).otherwise({"full": F.concat(full, F.lit(", "), quoted), "short": full, "basic": title}[style])


def marker_problems(nodes: DataFrame) -> DataFrame:
    """doc_id, line_no, expected, found of items of ordered lists whose written number (or letter, or numeral) is not the one after that before; a list may begin with any."""
    from quire.functions.text import from_roman

    given = F.try_element_at("attrs", F.lit("ordinal"))
    items = nodes.where(F.col("context") == "list_item").select("doc_id", "parent_id", "ord", "line_no", given.alias("given")).where("given IS NOT NULL")
    by = Window.partitionBy("doc_id", "parent_id").orderBy("ord")
    first = F.first("given").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    number = F.when(F.col("given").rlike(r"^\d+$"), F.col("given").try_cast("int")).when(first.rlike("^[ivxIVX]+$") & F.col("given").rlike("^[ivxIVX]+$"), from_roman("given")).otherwise(F.ascii(F.lower("given")) - 96)
    numbered_ = items.withColumn("number", number)
    before = F.lag("number").over(by)
    return numbered_.withColumn("expected", before + 1).where("expected IS NOT NULL AND number <> expected").select("doc_id", "line_no", "expected", F.col("number").alias("found"))


def list_numbers(style: str, ordinal) -> Column:
    """How an item of an ordered list is marked: arabic, loweralpha, upperalpha, lowerroman, upperroman or lowergreek."""
    n = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    greek = F.array(*[F.lit(chr(c)) for c in (*range(0x3B1, 0x3C2), *range(0x3C3, 0x3CA))])
    return {"arabic": n.cast("string"), "loweralpha": to_alpha(n), "upperalpha": to_alpha(n, True), "lowerroman": F.lower(to_roman(n)), "upperroman": to_roman(n), "lowergreek": F.get(greek, (n - 1).cast("int"))}[style]
