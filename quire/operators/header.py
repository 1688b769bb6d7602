"""Document headers: the header alone, its metadata, and edits of its attribute entries in the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.kernel import kernel
from quire.functions.text import let
from quire.operators import sections
from quire.operators.preprocess import attribute_entries

COMMENT = r"^//(?!/)"


def header_lines(rows: DataFrame) -> DataFrame:
    """The lines of each document's header: from its title (or first attribute entry) to the first blank line after; blank lines and comments before are passed over. Documents that begin otherwise have none."""
    by = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    says = (F.col("text") != "") & ~F.col("text").rlike(COMMENT)
    first = F.first(F.when(says, F.col("text")), True).over(by)
    begun = F.sum(says.cast("int")).over(by) > 0
    starts = first.rlike(r"^(?:[=#][ \t]+\S|:!?[\w][\w-]*!?:(?:[ \t]|$))")
    blanks = F.sum((F.col("text") == "").cast("int")).over(by)
    marked = rows.withColumns({"begun": begun, "starts": F.coalesce(starts, F.lit(False)), "blanks": blanks})
    at_start = F.min(F.when(F.col("begun"), F.col("blanks"))).over(Window.partitionBy("doc_id"))
    return marked.withColumn("at_start", at_start).where(F.col("begun") & F.col("starts") & (F.col("blanks") == F.col("at_start"))).drop("begun", "starts", "blanks", "at_start")


def metadata(rows: DataFrame) -> DataFrame:
    """doc_id, doctitle, authors (structs of firstname, middlename, lastname, email, initials), revnumber, revdate, revremark of each document's header.

    The author and revision lines are the first and second line after the
    title that are neither entries nor comments. The entries ``author``,
    ``authors``, ``email``, ``revnumber``, ``revdate`` and ``revremark`` win
    over them.
    """
    head = header_lines(rows)
    plain = head.where(~F.col("text").rlike(r"^:!?[\w][\w-]*!?:") & ~F.col("text").rlike(COMMENT) & ~F.col("text").rlike(r"\\$"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    said = plain.withColumn("nth", nth).groupBy("doc_id").agg(*[F.max(F.when(F.col("nth") == i, F.col("text"))).alias(n) for i, n in ((1, "title"), (2, "author"), (3, "revision"))])
    titled = F.col("title").rlike(r"^[=#][ \t]+\S")
    said = said.select(F.col("doc_id").alias("s_doc"), F.when(titled, F.regexp_extract("title", r"^[=#][ \t]+(.*)$", 1)).alias("doctitle"), F.when(titled, F.col("author")).alias("author_line"), F.when(titled, F.col("revision")).alias("revision_line"))
    wanted = ["author", "authors", "email", "revnumber", "revdate", "revremark"]
    entries = attribute_entries(head).where(F.col("name").isin(wanted) & (F.col("op") == "set"))
    held = entries.groupBy(F.col("doc_id").alias("e_doc")).agg(*[F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("line_no"))).alias(f"e_{n}") for n in wanted])
    docs = rows.select("doc_id").distinct()
    joined = docs.join(said, F.col("doc_id") == F.col("s_doc"), "left").join(held, F.col("doc_id") == F.col("e_doc"), "left")
    line = F.coalesce("e_authors", "e_author", "author_line")
    own = sections.authors(line)
    mailed = F.transform(own, lambda a, i: F.struct(a["firstname"].alias("firstname"), a["middlename"].alias("middlename"), a["lastname"].alias("lastname"), F.when(i == 0, F.coalesce(F.col("e_email"), a["email"])).otherwise(a["email"]).alias("email"), a["initials"].alias("initials")))
    revised = sections.revision(F.col("revision_line"))
    return joined.select("doc_id", "doctitle", F.coalesce(mailed, F.array().cast("array<struct<firstname:string,middlename:string,lastname:string,email:string,initials:string>>")).alias("authors"), *[F.coalesce(f"e_{n}", revised[n]).alias(n) for n in ("revnumber", "revdate", "revremark")])


def author_attributes(authors: Column) -> Column:
    """The map of attributes that authors give: ``author``, ``firstname`` and so on of the first, with ``_1``, ``_2`` of each if there are several, and ``authorcount`` and ``authors``."""

    def of(a: Column, suffix: Column) -> Column:
        full = F.concat_ws(" ", a["firstname"], a["middlename"], a["lastname"])
        pairs = [("author", full), ("firstname", a["firstname"]), ("middlename", a["middlename"]), ("lastname", a["lastname"]), ("email", a["email"]), ("authorinitials", a["initials"])]
        return F.filter(F.array(*[F.struct(F.concat(F.lit(n), suffix).alias("key"), v.alias("value")) for n, v in pairs]), lambda p: p["value"].isNotNull())

    first = F.when(F.size(authors) > 0, of(F.get(authors, F.lit(0)), F.lit(""))).otherwise(of(F.get(authors, F.lit(0)), F.lit("")))
    every = F.when(F.size(authors) > 1, F.flatten(F.transform(authors, lambda a, i: of(a, F.concat(F.lit("_"), (i + 1).cast("string"))))))
    names = F.array_join(F.transform(authors, lambda a: F.concat_ws(" ", a["firstname"], a["middlename"], a["lastname"])), ", ")
    count = F.array(F.struct(F.lit("authorcount").alias("key"), F.size(authors).cast("string").alias("value")), F.struct(F.lit("authors").alias("key"), names.alias("value")))
    return F.map_from_entries(F.concat(first, F.coalesce(every, F.filter(first, lambda p: F.lit(False))), count))


def with_attribute(source: str, name: str, value: str | None) -> str:
    """A document's source with the entry of a header attribute set (or unset, if the value is None): in place of the last that is there, with its continuation lines, else after the title's lines, or before all where there is no header."""
    lines = source.split("\n")
    start, stop = _header_span(lines)
    entry = f":{name}: {value}".rstrip() if value is not None else f":!{name}:"
    spans = [s for s in _entry_spans(lines, start, stop) if s[2] == name.lower()]
    if spans:
        a, b, _ = spans[-1]
        return "\n".join([*lines[:a], entry, *lines[b:]])
    if start == stop:
        return "\n".join([entry, *([""] if lines and lines[0] else []), *lines])
    return "\n".join([*lines[:stop], entry, *lines[stop:]])


def without_attribute(source: str, name: str) -> str:
    """A document's source without any header entry of the attribute."""
    lines = source.split("\n")
    spans = [s for s in _entry_spans(lines, *_header_span(lines)) if s[2] == name.lower()]
    for a, b, _ in reversed(spans):
        del lines[a:b]
    return "\n".join(lines)


def _header_span(lines: list[str]) -> tuple[int, int]:
    at = 0
    while at < len(lines) and (not lines[at].strip() or lines[at].startswith("//") and not lines[at].startswith("///")):
        at += 1
    if at == len(lines) or not (lines[at].startswith(("= ", "# ")) or _name_of(lines[at])):
        return 0, 0
    stop = at
    while stop < len(lines) and lines[stop].strip():
        stop += 1
    return at, stop


def _name_of(line: str) -> str | None:
    body = line[1:].partition(":") if line.startswith(":") else ("", "", "")
    name = body[0].strip("!").lower()
    return name if body[1] and name.replace("-", "_").isidentifier() | name.replace("-", "").replace("_", "").isalnum() and (not body[2] or body[2][0] in " \t") else None


def _entry_spans(lines: list[str], start: int, stop: int):
    """(first line, line after the last, name) of each entry of a header."""
    at = start
    while at < stop:
        name = _name_of(lines[at])
        if not name:
            at += 1
            continue
        end = at + 1
        while end < stop and lines[end - 1].endswith(" \\"):
            end += 1
        yield at, end, name
        at = end


def set_attribute(text, name: str, value: str | None) -> Column:
    return kernel("string")(lambda t: with_attribute(t, name, value))(text)


def remove_attribute(text, name: str) -> Column:
    return kernel("string")(lambda t: without_attribute(t, name))(text)


def parse_header(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, title and attrs of each document, from its header alone: what comes after the first blank line below it is cut off before anything is parsed."""
    from quire.operators import blocks, preprocess

    head = header_lines(preprocess.lines(docs, doc_id, text))
    short = head.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    nodes = blocks.parse(short).where("context = 'document'")
    return nodes.select("doc_id", "title", let(F.col("attrs"), lambda a: a).alias("attrs"))
