"""The block parser: lines of a document into a table of nodes.

This is the one step that is sequential in a document. A document is one row
of the input, so documents are parsed in parallel and none is split. Nodes
come out with their place (``ord``, an array path), so that everything after
is relational.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.tables import cells_of, column_list, shares

NODE = (
    "doc_id string, node_id int, parent_id int, ord array<int>, depth int, context string, style string, level int, id string, title string, "
    "source string, roles array<string>, attrs map<string,string>, marker string, line_no int"
)

#: Delimiters of blocks (four or more of the character where it repeats) and their contexts.
DELIMITERS = {"----": "listing", "....": "literal", "====": "example", "****": "sidebar", "____": "quote", "++++": "pass", "--": "open", "|===": "table", ",===": "table", ":===": "table", "////": "comment", "```": "listing"}
#: What an admonition begins with.
ADMONITIONS = ("NOTE", "TIP", "IMPORTANT", "WARNING", "CAUTION")
VERBATIM = {"listing", "literal", "pass", "table", "comment", "stem", "verse"}
#: Styles that turn a block into another.
MASQUERADE = {"source": "listing", "listing": "listing", "literal": "literal", "quote": "quote", "verse": "verse", "sidebar": "sidebar", "example": "example", "stem": "stem", "latexmath": "stem", "asciimath": "stem", "pass": "pass", "abstract": "open", "partintro": "open"} | {a: "admonition" for a in ADMONITIONS}

SECTION = re.compile(r"^(={1,6}|#{1,6})[ \t]+(\S.*?)(?:[ \t]+\1)?$")
ATTRLIST = re.compile(r"^\[(?!\[)(?:[\w.#,\"'%].*)?\]$")
ANCHOR = re.compile(r"^\[\[([\w:][\w:.-]*)(?:, *(.+))?\]\]$")
TITLE = re.compile(r"^\.(\.?[^ \t.].*)$")
UNORDERED = re.compile(r"^[ \t]*(-|\*{1,5}|\u2022)[ \t]+(\S.*)$")
ORDERED = re.compile(r"^[ \t]*(\.{1,5}|\d+\.|[a-zA-Z]\.|[IVXivx]+\))[ \t]+(\S.*)$")
DESCRIBED = re.compile(r"^[ \t]*([^\s/].*?)(:{2,4}|;;)(?:[ \t]+(\S.*))?$")
EXPLAINED = re.compile(r"^<(\d+|\.)>[ \t]+(\S.*)$")
MACRO = re.compile(r"^(image|video|audio|toc)::(\S*?|\S.*?\S)\[(.*)\]$")
CUSTOM = re.compile(r"^([a-z][\w-]*)::(\S*?|\S.*?\S)\[(.*)\]$")
ENTRY = re.compile(r"^:(!?[\w][\w-]*!?):(?:[ \t]+(.*))?$")
BREAKS = {"'''": "thematic_break", "---": "thematic_break", "***": "thematic_break", "<<<": "page_break"}


def attribute_list(text: str) -> dict[str, str]:
    """Positional (``1``, ``2``) and named attributes of ``style#id.role%option,name=value,"quoted"``; options become ``name-option``."""
    out: dict[str, str] = {}
    parts = re.findall(r"""\s*(?:([\w-]+)\s*=\s*)?("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^,]*)(?:,|$)""", text)
    at = 0
    for name, value in parts[: len(parts) - 1] if parts and parts[-1] == ("", "") else parts:
        value = value.strip()
        if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1].replace("\\" + value[0], value[0])
        if name:
            out[name] = value
            continue
        at += 1
        if at == 1 and value:
            head = re.match(r"^[^.#%]*", value)[0]
            if head:
                out["style"] = head
            roles = re.findall(r"\.([^.#%]+)", value)
            ids = re.findall(r"#([^.#%]+)", value)
            for option in re.findall(r"%([^.#%]+)", value):
                out[f"{option}-option"] = ""
            if roles:
                out["role"] = " ".join(roles)
            if ids:
                out["id"] = ids[0]
        if value:
            out[str(at)] = value
    if "options" in out or "opts" in out:
        for option in (out.get("options") or out["opts"]).split(","):
            out[f"{option.strip()}-option"] = ""
    return out


class Parser:
    """Parses one document. ``macros``: names of further block macros, whose nodes are custom_macro, with the name as style."""

    def __init__(self, text: str, macros: tuple[str, ...] = ()):
        self.macros = frozenset(macros)
        self.lines = [x.rstrip(" \t\n\x0b\x0c\r\0") for x in text.split("\n")]
        self.at, self.nodes, self.attributes = 0, [], {}

    def add(self, parent: int, context: str, line: int, meta: dict, **more) -> int:
        attrs = {k: v for k, v in meta.get("attrs", {}).items() if k not in ("id", "role", "style")}
        node = {
            "node_id": len(self.nodes), "parent_id": parent, "context": context, "style": meta.get("attrs", {}).get("style"), "level": None, "id": meta.get("attrs", {}).get("id") or meta.get("id"), "title": meta.get("title"),
            "source": None, "roles": meta.get("attrs", {}).get("role", "").split(), "attrs": attrs, "marker": None, "line_no": line,
        } | more
        self.nodes.append(node)
        return node["node_id"]

    def parse(self) -> list[dict]:
        root = self.add(None, "document", 1, {})
        self.header(root)
        stack = [(0, root)]
        meta: dict = {}
        while self.at < len(self.lines):
            line = self.lines[self.at]
            found = SECTION.match(line)
            if found and not meta.get("attrs", {}).get("style") == "discrete":
                level = len(found[1]) - 1
                while len(stack) > 1 and stack[-1][0] >= level:
                    stack.pop()
                key = self.add(stack[-1][1], "section", self.at + 1, meta, level=level, title=found[2])
                stack.append((level, key))
                meta, self.at = {}, self.at + 1
            else:
                meta = self.block(stack[-1][1], meta, None)
        self.place()
        return self.nodes

    def header(self, root: int) -> None:
        while self.at < len(self.lines) and (not self.lines[self.at] or self.lines[self.at].startswith("//") and not self.lines[self.at].startswith("////")):
            self.at += 1
        if self.at < len(self.lines) and re.match(r"^= +\S", self.lines[self.at]):
            self.nodes[root]["title"] = self.lines[self.at][2:].strip()
            self.at += 1
            row = 0
            while self.at < len(self.lines) and self.lines[self.at]:
                line = self.lines[self.at]
                entry = ENTRY.match(line)
                if entry:
                    self.entry(entry)
                    continue
                if not line.startswith("//"):
                    self.attributes[("author-line", "revision-line")[min(row, 1)]] = line
                    row += 1
                self.at += 1
        self.nodes[root]["attrs"] = self.attributes

    def entry(self, found) -> None:
        """An attribute entry at the current line, with the lines that a backslash at the end of one adds to it; moves on past them."""
        name, value = found[1].strip("!").lower(), found[2] or ""
        self.at += 1
        while value.endswith(" \\") and self.at < len(self.lines):
            value = value[:-1] + self.lines[self.at].lstrip()
            self.at += 1
        if "!" in found[1]:
            self.attributes.pop(name, None)
        else:
            self.attributes[name] = value

    def block(self, parent: int, meta: dict, until) -> dict:
        """Parse one block at the current line into ``parent``; returns block metadata that waits for the next one."""
        line = self.lines[self.at]
        if not line:
            self.at += 1
            return meta
        entry = ENTRY.match(line)
        if entry:
            self.entry(entry)
            return meta
        if line.startswith("//") and not line.startswith("////"):
            self.at += 1
            return meta
        anchor = ANCHOR.match(line)
        if anchor:
            self.at += 1
            return meta | {"id": anchor[1], "attrs": meta.get("attrs", {}) | ({"reftext": anchor[2]} if anchor[2] else {})}
        if ATTRLIST.match(line):
            self.at += 1
            return meta | {"attrs": meta.get("attrs", {}) | attribute_list(line[1:-1])}
        title = TITLE.match(line)
        if title and not ORDERED.match(line) and not line.startswith("...."):
            self.at += 1
            return meta | {"title": title[1]}
        start = self.at + 1
        style = meta.get("attrs", {}).get("style")
        mark = next((d for d in DELIMITERS if line == d or len(d) == 4 and d[0] == d[3] and len(line) > 4 and line == d[0] * len(line) or d == "```" and re.match(r"^```\w*$", line)), None)
        if mark:
            self.delimited(parent, meta, mark, line, style)
            return {}
        if line in BREAKS:
            self.add(parent, BREAKS[line], start, meta)
            self.at += 1
            return {}
        macro = MACRO.match(line)
        if macro:
            attrs = attribute_list(macro[3])
            if macro[1] == "image":
                attrs.setdefault("alt", attrs.get("1") or re.sub(r"[_-]", " ", re.sub(r"\.[^.]*$", "", macro[2].rsplit("/", 1)[-1])))
            self.add(parent, macro[1], start, meta | {"attrs": meta.get("attrs", {}) | attrs | {"target": macro[2]}})
            self.at += 1
            return {}
        custom = CUSTOM.match(line) if self.macros else None
        if custom and custom[1] in self.macros:
            self.add(parent, "custom_macro", start, meta | {"attrs": meta.get("attrs", {}) | attribute_list(custom[3]) | {"target": custom[2]}}, style=custom[1])
            self.at += 1
            return {}
        if EXPLAINED.match(line):
            self.explained(parent, meta)
            return {}
        if UNORDERED.match(line) or ORDERED.match(line):
            self.listed(parent, meta, [])
            return {}
        if DESCRIBED.match(line) and style not in MASQUERADE:
            self.described(parent, meta)
            return {}
        found = SECTION.match(line)
        if found and style == "discrete":
            self.add(parent, "floating_title", start, meta, level=len(found[1]) - 1, title=found[2])
            self.at += 1
            return {}
        self.paragraph(parent, meta, style, until)
        return {}

    def delimited(self, parent: int, meta: dict, mark: str, line: str, style) -> None:
        start = self.at + 1
        close = "```" if mark == "```" else line
        context = DELIMITERS[mark]
        if style in MASQUERADE and mark != "|===":
            context = MASQUERADE[style]
        if context == "listing" and mark == "```" and line[3:]:
            meta = meta | {"attrs": {"style": "source", "language": line[3:]} | meta.get("attrs", {})}
        body = []
        self.at += 1
        while self.at < len(self.lines) and self.lines[self.at] != close:
            body.append(self.lines[self.at])
            self.at += 1
        self.at += 1
        if context == "comment":
            return
        if context == "table":
            self.tabled(parent, meta, mark, body, start)
            return
        if context in VERBATIM:
            self.add(parent, context, start, meta, source="\n".join(body))
            return
        self.inside(self.add(parent, context, start, meta), body, start)

    def tabled(self, parent: int, meta: dict, mark: str, body: list[str], start: int) -> None:
        """A table with its parts (head, body, foot), rows and cells as nodes; a cell of a document has that document's blocks below it."""
        given = meta.get("attrs", {})
        fmt = given.get("format") or {",": "csv", ":": "dsv"}.get(mark[0], "psv")
        fmt = fmt if fmt in ("psv", "csv", "tsv", "dsv") else "psv"
        separator = {"\\t": "\t"}.get(given.get("separator"), given.get("separator"))
        while body and not body[0]:
            body = body[1:]
            given = given | {"noheader-option": ""}
        header = True if "header-option" in given else False if "noheader-option" in given else None
        specs = column_list(given.get("cols", ""))
        cells, columns = cells_of("\n".join(body), fmt, len(specs), header, "footer-option" in given, separator)
        specs = (specs + [{"width": 1, "halign": "left", "valign": "top", "style": "none"}] * columns)[:columns]
        attrs = given | {"colcount": str(columns), "rowcount": str(1 + max((c[1] for c in cells), default=-1))}
        if not any(x["width"] < 0 for x in specs) and "autowidth-option" not in given:
            attrs["colwidths"] = " ".join(f"{x:g}" for x in shares([x["width"] for x in specs]))
        key = self.add(parent, "table", start, meta | {"attrs": attrs}, source="\n".join(body))
        part = row = at = None
        for kind, r, c, wide, high, halign, valign, style, text in cells:
            if part is None or self.nodes[part]["style"] != kind:
                part, at = self.add(key, "table_part", start, {}, style=kind), None
            if r != at:
                row, at = self.add(part, "table_row", start, {}), r
            spec = specs[min(c, columns - 1)]
            style = "header" if kind == "head" else style or spec["style"]
            marks = {"halign": halign or spec["halign"], "valign": valign or spec["valign"]} | ({"colspan": str(wide)} if wide > 1 else {}) | ({"rowspan": str(high)} if high > 1 else {})
            cell = self.add(row, "table_cell", start, {"attrs": marks}, style=style, source=text if style != "document" else None)
            if style == "document":
                self.inside(cell, text.split("\n"), start)

    def inside(self, parent: int, body: list[str], start: int) -> None:
        """Blocks of other lines, below a node."""
        outer, self.lines, at, self.at = self.lines, body, self.at, 0
        base, held = len(self.nodes), {}
        while self.at < len(self.lines):
            held = self.block(parent, held, None)
        self.lines, self.at = outer, at
        for node in self.nodes[base:]:
            node["line_no"] += start

    def paragraph(self, parent: int, meta: dict, style, until) -> None:
        start, body = self.at + 1, []
        literal = self.lines[self.at][:1] in " \t"
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if not line or body and (line == "+" or ATTRLIST.match(line) or any(line == d for d in DELIMITERS if len(d) == 4) or until and until(line)):
                break
            body.append(line)
            self.at += 1
        text = "\n".join(body)
        note = re.match(r"^(" + "|".join(ADMONITIONS) + r"):[ \t]+", text)
        if style in MASQUERADE:
            self.add(parent, MASQUERADE[style], start, meta, source=text)
        elif literal:
            margin = min(len(x) - len(x.lstrip()) for x in body)
            self.add(parent, "literal", start, meta, source="\n".join(x[margin:] for x in body))
        elif note:
            key = self.add(parent, "admonition", start, meta | {"attrs": meta.get("attrs", {}) | {"name": note[1].lower()}}, style=note[1])
            self.nodes[key]["source"] = text[note.end() :]
        else:
            self.add(parent, "paragraph", start, meta, source=text)

    def listed(self, parent: int, meta: dict, markers: list[str]) -> None:
        """A list; an item's nested lists are those with other markers than all that are open."""

        def kind(line):
            u, o = UNORDERED.match(line), ORDERED.match(line)
            return ("ulist", u[1], u[2]) if u else ("olist", re.sub(r"^\d+\.$", "1.", re.sub(r"^[a-z]\.$", "a.", re.sub(r"^[A-Z]\.$", "A.", o[1]))), o[2]) if o else None

        context, marker, _ = kind(self.lines[self.at])
        more = meta
        first = ORDERED.match(self.lines[self.at])
        if first and re.match(r"^\d+\.$", first[1]) and first[1] != "1.":
            more = meta | {"attrs": {"start": first[1][:-1]} | meta.get("attrs", {})}
        key = self.add(parent, context, self.at + 1, more, marker=marker)
        while self.at < len(self.lines):
            now = kind(self.lines[self.at])
            if not now or now[:2] != (context, marker):
                break
            start, text = self.at + 1, [now[2]]
            ordered = ORDERED.match(self.lines[self.at])
            given = ordered[1].rstrip(".)") if context == "olist" and not ordered[1].startswith(".") else None
            self.at += 1
            while self.at < len(self.lines) and self.lines[self.at] and self.lines[self.at] != "+" and not kind(self.lines[self.at]) and not ATTRLIST.match(self.lines[self.at]) and not DESCRIBED.match(self.lines[self.at]):
                text.append(self.lines[self.at].strip())
                self.at += 1
            checked = re.match(r"^\[([ x*])\] ", text[0])
            attrs = {}
            if checked and context == "ulist":
                text[0] = text[0][4:]
                attrs = {"checkbox": ""} | ({} if checked[1] == " " else {"checked": ""})
            if given is not None:
                attrs = attrs | {"ordinal": given}
            item = self.add(key, "list_item", start, {"attrs": attrs}, source="\n".join(text), marker=marker)
            while self.at < len(self.lines):
                skip = self.at
                while skip < len(self.lines) and not self.lines[skip]:
                    skip += 1
                if skip >= len(self.lines):
                    self.at = skip
                    break
                nested = kind(self.lines[skip])
                if self.lines[self.at] == "+":
                    self.at += 1
                    held: dict = {}
                    before = len(self.nodes)
                    while self.at < len(self.lines) and len(self.nodes) == before:
                        held = self.block(item, held, None)
                elif nested and nested[:2] != (context, marker) and nested[1] not in markers:
                    self.at = skip
                    self.listed(item, {}, [*markers, marker])
                else:
                    if nested and nested[:2] == (context, marker):
                        self.at = skip
                    break

    def described(self, parent: int, meta: dict) -> None:
        key = self.add(parent, "dlist", self.at + 1, meta)
        mark = DESCRIBED.match(self.lines[self.at])[2]
        while self.at < len(self.lines):
            skip = self.at
            while skip < len(self.lines) and not self.lines[skip]:
                skip += 1
            found = DESCRIBED.match(self.lines[skip]) if skip < len(self.lines) else None
            if not found or found[2] != mark:
                break
            self.at = skip + 1
            term = self.add(key, "dlist_term", skip + 1, {}, source=found[1], marker=mark)
            text = [found[3]] if found[3] else []
            if not text:
                while self.at < len(self.lines) and not self.lines[self.at]:
                    self.at += 1
            while self.at < len(self.lines) and self.lines[self.at] and not DESCRIBED.match(self.lines[self.at]) and not SECTION.match(self.lines[self.at]) and self.lines[self.at] != "+" and self.lines[self.at] not in DELIMITERS:
                text.append(self.lines[self.at].strip())
                self.at += 1
            if text:
                item = self.add(key, "list_item", self.nodes[term]["line_no"], {}, source="\n".join(text), marker=mark)
                while self.at < len(self.lines) and self.lines[self.at] == "+":
                    self.at += 1
                    held: dict = {}
                    before = len(self.nodes)
                    while self.at < len(self.lines) and len(self.nodes) == before:
                        held = self.block(item, held, None)

    def explained(self, parent: int, meta: dict) -> None:
        key = self.add(parent, "colist", self.at + 1, meta)
        nth = 0
        while self.at < len(self.lines) and (found := EXPLAINED.match(self.lines[self.at])):
            nth = nth + 1 if found[1] == "." else int(found[1])
            self.add(key, "list_item", self.at + 1, {}, source=found[2], marker=f"<{nth}>")
            self.at += 1

    def place(self) -> None:
        """Paths and depths, and a preamble around what stands before the first section."""
        root = self.nodes[0]
        top = [n for n in self.nodes if n["parent_id"] == 0]
        before = [n for n in top if n["context"] != "section"]
        if root["title"] and before and any(n["context"] == "section" for n in top):
            preamble = len(self.nodes)
            self.add(0, "preamble", before[0]["line_no"], {})
            for n in before:
                n["parent_id"] = preamble
        children: dict = {}
        for n in self.nodes:
            children.setdefault(n["parent_id"], []).append(n)

        todo = [(root, [], 0)]
        while todo:
            node, path, depth = todo.pop()
            node["ord"], node["depth"] = path, depth
            own = sorted(children.get(node["node_id"], []), key=lambda n: (n["context"] == "section" and node["context"] == "document", n["line_no"], n["node_id"]))
            todo += [(n, [*path, k], depth + 1) for k, n in enumerate(own)]


def parse_text(text: str | None, macros: tuple[str, ...] = ()) -> list[dict]:
    return Parser(text or "", macros).parse()


def parse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", macros: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of documents (null text: an empty document), a row each."""
    names = [x.split()[0] for x in NODE.split(", ")]

    def run(batches):
        import pyarrow as pa

        kinds = {
            "doc_id": pa.string(), "node_id": pa.int32(), "parent_id": pa.int32(), "ord": pa.list_(pa.int32()), "depth": pa.int32(), "context": pa.string(), "style": pa.string(), "level": pa.int32(), "id": pa.string(), "title": pa.string(),
            "source": pa.string(), "roles": pa.list_(pa.string()), "attrs": pa.map_(pa.string(), pa.string()), "marker": pa.string(), "line_no": pa.int32(),
        }
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = []
                some = batch.slice(a, 500)
                for key, body in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    rows += [n | {"doc_id": key, "attrs": list(n["attrs"].items())} for n in parse_text(body, macros)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)

    return docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string")).mapInArrow(run, NODE)
