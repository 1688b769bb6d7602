"""Delimited tables: column and cell specifications, PSV, CSV, TSV and DSV parsing, widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Alignment marks and style letters.
ALIGN = {"<": "left", ">": "right", "^": "center"}
VALIGN = {"<": "top", ">": "bottom", "^": "middle"}
STYLES = {"d": "none", "s": "strong", "e": "emphasis", "m": "monospaced", "h": "header", "l": "literal", "v": "verse", "a": "document"}
CELLS = "table_id string, part string, row int, col int, colspan int, rowspan int, halign string, valign string, style string, text string"


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(y) for kv in table.items() for y in kv]), key)


def column_specs(spec: Column) -> Column:
    """Structs of width (-1: automatic), halign, valign, style for a list such as ``3*,^.>2s,~,15%``; a bare number is a count."""
    plain = F.regexp_replace(spec, " ", "")
    counted = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), plain.try_cast("int"))), lambda _: F.lit(""))
    entries = F.when(plain.rlike(r"^\d+$"), counted).otherwise(F.split(plain, F.when(plain.contains(","), F.lit(",")).otherwise(F.lit(";"))))

    def parsed(e: Column) -> Column:
        # in this order, each of them optional: repeats and a star, alignment, a dot and vertical alignment, a width, a style
        times, rest = F.regexp_extract(e, r"^(\d+)\*", 1), F.regexp_replace(e, r"^\d+\*", "")
        halign, rest = F.regexp_extract(rest, "^([<^>])", 1), F.regexp_replace(rest, "^[<^>]", "")
        valign, rest = F.regexp_extract(rest, r"^\.([<^>])", 1), F.regexp_replace(rest, r"^\.[<^>]", "")
        width, rest = F.regexp_extract(rest, r"^(~|\d+)%?", 1), F.regexp_replace(rest, r"^(?:~|\d+%?)", "")
        ok = rest.rlike("^[a-z]?$")
        part = lambda c: F.when(ok, c)
        one = F.struct(
            F.when(ok & (width == "~"), -1).otherwise(F.coalesce(part(width).try_cast("int"), F.lit(1))).alias("width"),
            F.coalesce(_lookup(ALIGN, part(halign)), F.lit("left")).alias("halign"),
            F.coalesce(_lookup(VALIGN, part(valign)), F.lit("top")).alias("valign"),
            F.coalesce(_lookup(STYLES, part(rest)), F.lit("none")).alias("style"),
        )
        return F.array_repeat(one, F.coalesce(part(times).try_cast("int"), F.lit(1)))

    return F.flatten(F.transform(entries, parsed))


def column_widths(rows: DataFrame, table: str = "table_id", order: str = "idx", width: str = "width") -> DataFrame:
    """Adds pcwidth: shares of 100 cut to four places, the last column taking the balance; automatic columns (-1) share what the others leave."""
    by = Window.partitionBy(table)
    fixed = F.sum(F.when(F.col(width) >= 0, F.col(width))).over(by)
    autos = F.sum((F.col(width) < 0).cast("int")).over(by)
    cut = lambda x: F.floor(F.round(x * 10000, 6)) / 10000
    base = F.when(autos > 0, F.lit(100.0)).otherwise(fixed.cast("double"))
    share = F.when(F.col(width) < 0, cut((F.lit(100.0) - F.coalesce(fixed, F.lit(0))) / autos)).otherwise(cut(F.col(width) * 100.0 / base))
    placed = rows.withColumn("share", share)
    last = F.row_number().over(Window.partitionBy(table).orderBy(F.desc(order))) == 1
    others = F.sum("share").over(by) - F.col("share")
    return placed.withColumn("pcwidth", F.when(last, F.round(F.lit(100.0) - others, 4)).otherwise(F.col("share"))).drop("share")


class Spec:
    """What stands before a cell's mark: ``3*`` (copies) or ``2.3+`` (columns and rows that it spans), then alignment, a dot and vertical alignment, and a style letter."""

    def __init__(self, text: str):
        rest, number = text, ""
        while rest and (rest[0].isdigit() or rest[0] == "."):
            if rest[0] == "." and rest[1:2] in ALIGN:
                break
            number, rest = number + rest[0], rest[1:]
        mark = rest[:1] if number and rest[:1] in ("*", "+") else ""
        rest = rest[len(mark) :]
        wide, _, high = number.partition(".")
        self.copies = int(wide) if mark == "*" and wide.isdigit() else 1
        self.wide, self.high = (int(wide or 1), int(high or 1)) if mark == "+" else (1, 1)
        self.halign = ALIGN.get(rest[:1])
        rest = rest[1:] if self.halign else rest
        self.valign = VALIGN.get(rest[1:2]) if rest[:1] == "." else None
        rest = rest[2:] if self.valign else rest
        self.style = STYLES.get(rest) if rest else None
        self.valid = (not number or bool(mark)) and number.count(".") <= 1 and (len(rest) == 0 or len(rest) == 1 and rest.islower())


def trailing_spec(body: str) -> str:
    """The specification that ends a cell's text, for the next cell: its last word (or all of it), if it is one."""
    last = body[max(body.rfind(c) for c in " \t\n") + 1 :]
    return last if last and Spec(last).valid else ""


def split_records(text: str, fmt: str, separator: str | None = None):
    """Rows of (text, spec) of a table's text; PSV yields one row of all cells, as its rows follow from the column count."""
    import re

    sep = separator or {"csv": ",", "tsv": "\t", "dsv": ":", "psv": "|"}[fmt]
    if fmt in ("csv", "tsv"):
        rows, row, cell, at, quoted, opened = [], [], [], 0, False, False
        text = text.strip("\n")
        while at < len(text):
            c = text[at]
            if quoted:
                if c == '"' and text[at + 1 : at + 2] == '"':
                    cell.append('"')
                    at += 1
                elif c == '"':
                    quoted = False
                else:
                    cell.append(c)
            elif c == '"' and not "".join(cell).strip() and not opened:
                quoted, opened, cell = True, True, []
            elif text.startswith(sep, at) or c == "\n":
                row.append(("".join(cell).strip(), ""))
                cell, opened = [], False
                if c == "\n":
                    rows.append(row)
                    row = []
            elif not (opened and c in " \t"):
                cell.append(c)
            at += 1
        row.append(("".join(cell).strip(), ""))
        rows.append(row)
        return [r for r in rows if r != [("", "")]]
    if fmt == "dsv":
        out = []
        for line in text.split("\n"):
            if line.strip():
                parts = re.split(r"(?<!\\)" + re.escape(sep), line)
                out.append([(p.replace("\\" + sep, sep).strip(), "") for p in parts])
        return out
    cells, spec = [], None
    held, at = [], 0
    while at < len(text):
        if text.startswith("\\" + sep, at):
            held.append(sep)
            at += 1 + len(sep)
        elif text.startswith(sep, at):
            body = "".join(held)
            mark = trailing_spec(body)
            if spec is not None:
                cells.append((body[: len(body) - len(mark)].strip(), spec))
                spec = mark
            else:
                spec = body.strip() if Spec(body.strip()).valid else ""
            held = []
            at += len(sep)
        else:
            held.append(text[at])
            at += 1
    if spec is not None:
        cells.append(("".join(held).strip(), spec))
    return [cells]


def grid(records: list, columns: int, fmt: str):
    """(row, col, colspan, rowspan, spec, text) of each placed cell, and problems. Spans take the next free columns; rows that overflow or stay unfinished are dropped."""
    out, problems = [], []
    if fmt != "psv":
        for r, cells in enumerate(records):
            if len(cells) < columns:
                problems.append((r, "incomplete row"))
                continue
            out += [(r, c, 1, 1, s, t) for c, (t, s) in enumerate(cells[:columns])]
        kept = {r: k for k, r in enumerate(sorted({x[0] for x in out}))}
        return [(kept[x[0]], *x[1:]) for x in out], problems
    covered: dict[int, int] = {}
    row, col, now = 0, 0, []

    def full():
        return sum(x[2] for x in now) + covered.get(row, 0) >= columns

    for text, spec in records[0] if records else []:
        marks = Spec(spec)
        wide, high = marks.wide, marks.high
        for _ in range(marks.copies):
            if col + wide + covered.get(row, 0) > columns:
                problems.append((row, "cell exceeds the columns"))
                continue
            now.append((row, col, wide, high, spec, text))
            col += wide
            for below in range(row + 1, row + high):
                covered[below] = covered.get(below, 0) + wide
            if full():
                out += now
                row, col, now = row + 1, 0, []
    if now:
        problems.append((row, "incomplete row"))
    return out, problems


def cells_of(text: str, fmt: str, columns: int = 0, header=None, footer=False, separator: str | None = None):
    """(cells, columns) of a table's text: part, row, col, colspan, rowspan, halign, valign, style, text of each; columns 0: as many as the first row has; header None: if the first line stands alone before a blank one."""
    records = split_records(text, fmt, separator)
    if not columns:
        first = records[0] if records else []
        if fmt == "psv":
            line = next((x for x in text.split("\n") if x.strip()), "")
            first = split_records(line, "psv", separator)[0]
        columns = sum(m.wide * m.copies for m in (Spec(spec) for _, spec in first))
    columns = max(columns, 1)
    placed, _ = grid(records, columns, fmt)
    rows = 1 + max((c[0] for c in placed), default=-1)
    if header is None:
        lines = text.split("\n")
        header = rows > 1 and bool(lines[0].strip()) and len(lines) > 1 and not lines[1].strip()
    out = []
    for r, c, wide, high, spec, body in placed:
        marks = Spec(spec)
        part = "head" if header and r == 0 else "foot" if footer and r == rows - 1 and rows > 1 + bool(header) else "body"
        out.append((part, r, c, wide, high, marks.halign, marks.valign, marks.style, body))
    return out, columns


def parse(tables: DataFrame) -> DataFrame:
    """Cells of tables given as table_id, text, format (psv, csv, tsv, dsv), columns (0: by the first row), header and footer (booleans).

    Which cell begins a row depends on all before it, so a table is scanned
    as a whole, each within one row of the input.
    """
    kind = CELLS

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in kind.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for key, text, fmt, columns, header, footer in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                out += [(key, *cell) for cell in cells_of(text or "", fmt, columns or 0, header, bool(footer))[0]]
            columns_out = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_out, kinds, strict=True)], names=names)

    given = tables.select(F.col("table_id").cast("string"), "text", "format", F.col("columns").cast("int"), "header", "footer")
    return given.mapInArrow(run, kind)


def column_list(spec: str) -> list[dict]:
    """The columns of a specification as ``column_specs`` has them, for the block parser."""
    plain = spec.replace(" ", "")
    if not plain:
        return []
    entries = [""] * int(plain) if plain.isdigit() else plain.split("," if "," in plain else ";")
    out = []
    for e in entries:
        times, star, rest = e.partition("*")
        times, rest = (int(times), rest) if star and times.isdigit() else (1, e)
        halign = ALIGN.get(rest[:1])
        rest = rest[1:] if halign else rest
        valign = VALIGN.get(rest[1:2]) if rest[:1] == "." else None
        rest = rest[2:] if valign else rest
        style = STYLES.get(rest[-1:]) if rest[-1:].isalpha() else None
        width = rest[:-1] if rest[-1:].isalpha() else rest
        width = width.rstrip("%")
        one = {"width": -1 if width == "~" else int(width) if width.isdigit() else 1, "halign": halign or "left", "valign": valign or "top", "style": style or "none"}
        out += [one] * times
    return out


def shares(widths: list[int]) -> list[float]:
    """Percentages of widths, cut to four places, the last taking the balance; automatic ones (-1) share what the others leave."""
    import math

    fixed, autos = sum(w for w in widths if w >= 0), sum(w < 0 for w in widths)
    cut = lambda x: math.floor(round(x * 10000, 6)) / 10000
    out = [cut((100 - fixed) / autos) if w < 0 else cut(w * 100 / (100 if autos else fixed)) for w in widths]
    return [*out[:-1], round(100 - sum(out[:-1]), 4)] if out else out


def counts(cells: DataFrame) -> DataFrame:
    """table_id, rows, columns."""
    return cells.groupBy("table_id").agg((F.max("row") + 1).alias("rows"), F.max(F.col("col") + F.col("colspan")).alias("columns"))


def cell_paragraphs(text: Column) -> Column:
    """Paragraphs of a cell, parted by blank lines."""
    return F.filter(F.split(text, r"\n[ \t]*\n\s*"), lambda p: p != "")
