"""Page files: objects, a writer, a reader, and pages drawn from laid-out text.

Objects are Python values: None, bool, int, float, Name, str or bytes
(strings), list, dict, Stream and Ref. A document is written and read as one
binary value per row.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codec import MOST_DECODED, base85_decode, hex_decode, lzw_decode, run_length_decode, unpredict
from .kernel import kernel

SPACE, DELIMITERS = b" \t\r\n\f\0", b"()<>[]{}/%"


class Name(str):
    """A name object."""


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int = 0


@dataclass
class Stream:
    entries: dict
    data: bytes

    def decoded(self, resolve=lambda x: x) -> bytes:
        """The data behind the stream's filters; what a filter unknown here encodes stays as it is."""
        names, parms = resolve(self.entries.get("Filter")), resolve(self.entries.get("DecodeParms"))
        names = names if isinstance(names, list) else [names] if names else []
        parms = parms if isinstance(parms, list) else [parms] * len(names)
        out = self.data
        for name, parm in zip(names, parms, strict=False):
            p = resolve(parm) or {}
            if name == "FlateDecode":
                out = zlib.decompressobj().decompress(out, MOST_DECODED)
            elif name == "LZWDecode":
                out = lzw_decode(out, p.get("EarlyChange", 1))
            elif name in ("ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode"):
                out = {"ASCIIHexDecode": hex_decode, "ASCII85Decode": base85_decode, "RunLengthDecode": run_length_decode}[name](out)
            else:
                return out
            out = unpredict(out, p.get("Predictor", 1), p.get("Colors", 1), p.get("BitsPerComponent", 8), p.get("Columns", 1))
        return out


def written(value) -> bytes:
    """An object as it stands in a file."""
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return str(value).encode()
    if isinstance(value, float):
        return (f"{value:.5f}".rstrip("0").rstrip(".") or "0").replace("-0", "-0").encode()
    if isinstance(value, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else f"#{c:02X}".encode() for c in value.encode())
    if isinstance(value, Ref):
        return f"{value.number} {value.generation} R".encode()
    if isinstance(value, str):
        try:
            raw = value.encode("latin-1")
        except UnicodeEncodeError:
            raw = b"\xfe\xff" + value.encode("utf-16-be")
        return written(raw)
    if isinstance(value, bytes):
        return b"(" + re.sub(rb"[()\\\r\n]", lambda m: {b"\r": b"\\r", b"\n": b"\\n"}.get(m[0], b"\\" + m[0]), value) + b")"
    if isinstance(value, list):
        return b"[" + b" ".join(map(written, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b" ".join(written(Name(k)) + b" " + written(v) for k, v in value.items()) + b">>"
    if isinstance(value, Stream):
        return written(value.entries | {"Length": len(value.data)}) + b"\nstream\n" + value.data + b"\nendstream"
    raise TypeError(type(value).__name__)


class Writer:
    """Objects by number, written with a table of their places."""

    def __init__(self):
        self.objects: list = []

    def add(self, value=None) -> Ref:
        self.objects.append(value)
        return Ref(len(self.objects))

    def set(self, ref: Ref, value) -> Ref:
        self.objects[ref.number - 1] = value
        return ref

    def stream(self, data: bytes, packed: bool = True, **entries) -> Ref:
        return self.add(Stream(entries | ({"Filter": Name("FlateDecode")} if packed else {}), zlib.compress(data, 6) if packed else data))

    def finish(self, root: Ref, info: Ref | None = None) -> bytes:
        out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
        for i, value in enumerate(self.objects, 1):
            places.append(len(out))
            out += f"{i} 0 obj\n".encode() + written(value) + b"\nendobj\n"
        start = len(out)
        out += f"xref\n0 {len(places) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
        trailer = {"Size": len(places) + 1, "Root": root} | ({"Info": info} if info else {})
        return bytes(out + b"trailer\n" + written(trailer) + f"\nstartxref\n{start}\n%%EOF\n".encode())


class Scanner:
    """Objects read from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        data = self.data
        while self.at < len(data):
            if data[self.at] in SPACE:
                self.at += 1
            elif data[self.at] == 37:  # a comment
                stop = re.compile(rb"[\r\n]").search(data, self.at)
                self.at = stop.end() if stop else len(data)
            else:
                return

    def token(self) -> bytes:
        self.skip()
        start = self.at
        while self.at < len(self.data) and self.data[self.at] not in SPACE and self.data[self.at] not in DELIMITERS:
            self.at += 1
        return self.data[start : self.at]

    def value(self, resolve=None):
        self.skip()
        data, at = self.data, self.at
        two = data[at : at + 2]
        if two == b"<<":
            self.at += 2
            out = {}
            while True:
                self.skip()
                if self.data[self.at : self.at + 2] == b">>" or self.at >= len(data):
                    self.at += 2
                    break
                key = self.value()
                out[str(key)] = self.value(resolve)
            return self._stream(out, resolve)
        c = data[at : at + 1]
        if c == b"/":
            self.at += 1
            return Name(re.sub(rb"#([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), self.token()).decode("utf-8", "replace"))
        if c == b"(":
            return self._string()
        if c == b"<":
            stop = data.index(b">", at)
            self.at = stop + 1
            return hex_decode(data[at + 1 : stop] + b">")
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.data[self.at : self.at + 1] in (b"]", b""):
                    self.at += 1
                    return out
                out.append(self.value(resolve))
        word = self.token()
        if not word:
            self.at += 1
            return None
        if re.fullmatch(rb"[+-]?\d+", word):
            m = re.compile(rb"[\s\0]+(\d+)[\s\0]+R(?![a-zA-Z])").match(data, self.at)
            if m:
                self.at = m.end()
                return Ref(int(word), int(m[1]))
            return int(word)
        if re.fullmatch(rb"[+-]?(?:\d+\.\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Name("\0" + word.decode("latin-1")))

    def _string(self) -> bytes:
        data, out, depth = self.data, bytearray(), 0
        escapes = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
        while self.at < len(data):
            c = data[self.at]
            self.at += 1
            if c == 92:
                e = data[self.at]
                self.at += 1
                if 48 <= e <= 55:
                    m = re.compile(rb"[0-7]{1,3}").match(data, self.at - 1)
                    self.at = m.end()
                    out.append(int(m[0], 8) & 255)
                elif e in (10, 13):
                    self.at += e == 13 and data[self.at : self.at + 1] == b"\n"
                else:
                    out.append(escapes.get(e, e))
                continue
            depth += (c == 40) - (c == 41)
            if not depth:
                break
            if depth > 1 or c != 40:
                out.append(c)
        return bytes(out)

    def _stream(self, entries: dict, resolve):
        keep = self.at
        self.skip()
        if self.data[self.at : self.at + 6] != b"stream":
            self.at = keep
            return entries
        self.at += 6 + (2 if self.data[self.at + 6 : self.at + 8] == b"\r\n" else 1)
        size = entries.get("Length")
        size = resolve(size) if resolve and isinstance(size, Ref) else size
        stop = self.at + size if isinstance(size, int) else -1
        if stop < 0 or not re.compile(rb"\s*endstream").match(self.data, stop):
            stop = self.data.find(b"endstream", self.at)
            stop = len(self.data) if stop < 0 else stop
        data, self.at = self.data[self.at : stop], stop
        return Stream(entries, data)


class Reader:
    """A document's objects: by its tables and streams of places or, where these are broken, by a scan for objects."""

    def __init__(self, data: bytes):
        self.data, self.places, self.packed, self.trailer, self.held = data, {}, {}, {}, {}
        try:
            start = data.rindex(b"startxref")
            self._sections(int(Scanner(data, start + 9).token()))
            if not isinstance(self.resolve(self.trailer.get("Root")), dict):
                raise ValueError("no root")
        except (ValueError, IndexError, KeyError, TypeError, zlib.error, AttributeError):
            self._scan()

    def _sections(self, at: int) -> None:
        seen = set()
        while at not in seen and at is not None:
            seen.add(at)
            scanner = Scanner(self.data, at)
            scanner.skip()
            if self.data[scanner.at : scanner.at + 4] == b"xref":
                scanner.at += 4
                while (word := scanner.token()).isdigit():
                    first, count = int(word), int(scanner.token())
                    for i in range(count):
                        place, _, kind = int(scanner.token()), scanner.token(), scanner.token()
                        if kind == b"n":
                            self.places.setdefault(first + i, place)
                trailer = scanner.value()
                if isinstance(trailer.get("XRefStm"), int):
                    self._stream_section(trailer["XRefStm"])
            else:
                trailer = self._stream_section(at)
            self.trailer = trailer | self.trailer
            at = trailer.get("Prev")
            if at is None:
                return

    def _stream_section(self, at: int) -> dict:
        scanner = Scanner(self.data, at)
        scanner.token(), scanner.token(), scanner.token()
        stream = scanner.value()
        widths, body = stream.entries["W"], stream.decoded()
        index = stream.entries.get("Index") or [0, stream.entries["Size"]]
        row, size = 0, sum(widths)
        for first, count in zip(index[::2], index[1::2], strict=True):
            for i in range(count):
                fields, p = [], row * size
                for w in widths:
                    fields.append(int.from_bytes(body[p : p + w], "big") if w else 1)
                    p += w
                if fields[0] == 1:
                    self.places.setdefault(first + i, fields[1])
                elif fields[0] == 2:
                    self.packed.setdefault(first + i, (fields[1], fields[2]))
                row += 1
        return stream.entries

    def _scan(self) -> None:
        self.places, self.packed, self.held = {}, {}, {}
        for m in re.finditer(rb"(?<![\d.])(\d+)\s+(\d+)\s+obj\b", self.data):
            self.places[int(m[1])] = m.start()
        for number in list(self.places):
            value = self.object(number)
            if isinstance(value, Stream) and value.entries.get("Type") == "ObjStm":
                try:
                    head = Scanner(value.decoded())
                    for i in range(value.entries.get("N", 0)):
                        self.packed.setdefault(int(head.token()), (number, i))
                        head.token()
                except (ValueError, zlib.error):
                    pass
            if isinstance(value, dict) and value.get("Type") == "Catalog":
                self.trailer["Root"] = Ref(number)
        for m in re.finditer(rb"trailer", self.data):
            found = Scanner(self.data, m.end()).value()
            if isinstance(found, dict):
                self.trailer = self.trailer | {k: v for k, v in found.items() if k in ("Root", "Info") and k not in self.trailer}

    def object(self, number: int):
        if number not in self.held:
            self.held[number] = None  # an object that asks for itself is nothing
            if number in self.places:
                scanner = Scanner(self.data, self.places[number])
                scanner.token(), scanner.token(), scanner.token()
                self.held[number] = scanner.value(self.resolve)
            elif number in self.packed:
                holder, at = self.packed[number]
                stream = self.object(holder)
                if isinstance(stream, Stream):
                    body = stream.decoded(self.resolve)
                    head = Scanner(body)
                    starts = [(int(head.token()), int(head.token())) for _ in range(stream.entries["N"])]
                    self.held[number] = Scanner(body, stream.entries["First"] + starts[at][1]).value(self.resolve)
        return self.held[number]

    def resolve(self, value):
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.object(value.number)
        return None

    def pages(self) -> list[dict]:
        """Pages in order, each with what it takes from the nodes above it."""
        root = self.resolve(self.trailer.get("Root"))
        out, seen = [], set()

        def walk(ref, taken: dict) -> None:
            node = self.resolve(ref)
            if not isinstance(node, dict) or id(node) in seen or len(out) > 1_000_000:
                return
            seen.add(id(node))
            taken = taken | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            kids = self.resolve(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, taken)
            else:
                out.append(taken | node)

        if isinstance(root, dict):
            walk(root.get("Pages"), {})
        return out

    def content(self, page: dict) -> bytes:
        parts = self.resolve(page.get("Contents"))
        parts = parts if isinstance(parts, list) else [parts]
        return b"\n".join(p.decoded(self.resolve) for p in map(self.resolve, parts) if isinstance(p, Stream))

    def text(self, page: dict) -> str:
        """What a page's content shows, as its strings say (fonts with maps of their own are not looked up); a move to another line is a line break."""
        scanner, out, held = Scanner(self.content(page)), [], []
        while True:
            scanner.skip()
            if scanner.at >= len(scanner.data):
                return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")
            value = scanner.value()
            if isinstance(value, Name) and value.startswith("\0"):
                word = value[1:]
                if word in ("Tj", "'", '"') and held and isinstance(held[-1], bytes):
                    out.append(("\n" if word != "Tj" else "") + held[-1].decode("latin-1"))
                elif word == "TJ" and held and isinstance(held[-1], list):
                    out.append("".join(x.decode("latin-1") if isinstance(x, bytes) else " " if isinstance(x, (int, float)) and x < -200 else "" for x in held[-1]))
                elif word in ("Td", "TD", "T*", "Tm", "ET"):
                    out.append("\n")
                held = []
            else:
                held.append(value)

    def as_form(self, writer: Writer, page: dict) -> Ref:
        """A page as a graphic of another document, with copies of all that it uses."""
        copies: dict[int, Ref] = {}

        def copy(value):
            if isinstance(value, Ref):
                if value.number not in copies:
                    copies[value.number] = writer.add()
                    writer.set(copies[value.number], copy(self.object(value.number)))
                return copies[value.number]
            if isinstance(value, list):
                return [copy(x) for x in value]
            if isinstance(value, dict):
                return {k: copy(v) for k, v in value.items() if k != "Parent"}
            return Stream(copy(value.entries), value.data) if isinstance(value, Stream) else value

        box = self.resolve(page.get("CropBox") or page.get("MediaBox")) or [0, 0, 612, 792]
        return writer.stream(self.content(page), Type=Name("XObject"), Subtype=Name("Form"), BBox=box, Resources=copy(page.get("Resources") or {}))


@dataclass
class Canvas:
    """Operators of a page's content."""

    parts: list[bytes] = field(default_factory=list)

    def op(self, name: str, *values) -> "Canvas":
        self.parts.append(b" ".join([*map(written, values), name.encode()]))
        return self

    def text(self, x: float, y: float, font: str, size: float, line: str) -> "Canvas":
        raw = line.encode("cp1252", "replace")
        return self.op("BT").op("Tf", Name(font), size).op("Td", x, y).op("Tj", raw).op("ET")

    def line(self, x1: float, y1: float, x2: float, y2: float, width: float = 0.5) -> "Canvas":
        return self.op("w", width).op("m", x1, y1).op("l", x2, y2).op("S")

    def box(self, x: float, y: float, w: float, h: float, fill: tuple | None = None) -> "Canvas":
        if fill:
            return self.op("rg", *fill).op("re", x, y, w, h).op("f").op("rg", 0, 0, 0)
        return self.op("re", x, y, w, h).op("S")

    def path(self, segments: list) -> "Canvas":
        """Segments of a vector path (see svg.absolute); quadratic curves become cubic ones, arcs the line to their end."""
        x = y = 0.0
        for kind, v in segments:
            if kind == "Q":
                v = [x + 2 / 3 * (v[0] - x), y + 2 / 3 * (v[1] - y), v[2] + 2 / 3 * (v[0] - v[2]), v[3] + 2 / 3 * (v[1] - v[3]), v[2], v[3]]
                kind = "C"
            if kind == "A":
                kind, v = "L", v[-2:]
            self.op({"M": "m", "L": "l", "C": "c", "Z": "h"}[kind], *map(float, v))
            x, y = v[-2:] if v else (x, y)
        return self

    def content(self) -> bytes:
        return b"\n".join(self.parts)


def axial_shading(start: tuple, stop: tuple, first: tuple, last: tuple) -> dict:
    """A gradient between two points, of colours (parts from 0 to 1)."""
    return {"ShadingType": 2, "ColorSpace": Name("DeviceRGB"), "Coords": [*start, *stop], "Function": {"FunctionType": 2, "Domain": [0, 1], "C0": list(first), "C1": list(last), "N": 1}, "Extend": [True, True]}


def radial_shading(center: tuple, radius: float, first: tuple, last: tuple) -> dict:
    return {"ShadingType": 3, "ColorSpace": Name("DeviceRGB"), "Coords": [*center, 0, *center, radius], "Function": {"FunctionType": 2, "Domain": [0, 1], "C0": list(first), "C1": list(last), "N": 1}, "Extend": [True, True]}


#: The fonts that every viewer has.
STANDARD = ["Courier", "Courier-Bold", "Courier-BoldOblique", "Courier-Oblique", "Helvetica", "Helvetica-Bold", "Helvetica-BoldOblique", "Helvetica-Oblique", "Symbol", "Times-Bold", "Times-BoldItalic", "Times-Italic", "Times-Roman", "ZapfDingbats"]


def document(pages: list[tuple[bytes, list]], width: float, height: float, title: str | None = None, outline: list[tuple[str, int]] = (), labels: list[str] = ()) -> bytes:
    """A file of pages (content, links of (box, uri)), with an outline of (title, page from 0) and labels of pages."""
    w = Writer()
    root, tree = w.add(), w.add()
    fonts = {f"F{i}": w.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(f)} | ({"Encoding": Name("WinAnsiEncoding")} if f not in ("Symbol", "ZapfDingbats") else {})) for i, f in enumerate(STANDARD)}
    refs = []
    for content, links in pages:
        notes = [{"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": list(box), "Border": [0, 0, 0], "A": {"S": Name("URI"), "URI": uri}} for box, uri in links]
        refs.append(w.add({"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, width, height], "Resources": {"Font": fonts}, "Contents": w.stream(content)} | ({"Annots": notes} if notes else {})))
    w.set(tree, {"Type": Name("Pages"), "Kids": refs, "Count": len(refs)})
    catalog = {"Type": Name("Catalog"), "Pages": tree}
    if outline:
        top, items = w.add(), [w.add() for _ in outline]
        for i, ((text, page), ref) in enumerate(zip(outline, items, strict=True)):
            w.set(ref, {"Title": text, "Parent": top, "Dest": [refs[min(page, len(refs) - 1)], Name("Fit")]} | ({"Prev": items[i - 1]} if i else {}) | ({"Next": items[i + 1]} if i + 1 < len(items) else {}))
        w.set(top, {"Type": Name("Outlines"), "First": items[0], "Last": items[-1], "Count": len(items)})
        catalog["Outlines"] = top
    if labels:
        catalog["PageLabels"] = {"Nums": [x for i, label in enumerate(labels) for x in (i, {"P": label})]}
    w.set(root, catalog)
    return w.finish(root, w.add({"Title": title}) if title else None)


@kernel("array<struct<page:int,width:double,height:double,text:string>>")
def pdf_pages(data):
    """The pages of a file: size and what they say; null for what is no such file."""
    data = bytes(data)
    if b"%PDF-" not in data[:1024]:
        return None
    reader, out = Reader(data), []
    for i, page in enumerate(reader.pages()):
        box = reader.resolve(page.get("MediaBox")) or [0, 0, 612, 792]
        try:
            text = reader.text(page)
        except (ValueError, zlib.error, IndexError):
            text = None
        out.append({"page": i, "width": float(box[2] - box[0]), "height": float(box[3] - box[1]), "text": text})
    return out


@kernel("array<struct<number:int,kind:string,bytes:int>>")
def pdf_objects(data):
    """Number, kind and stream size of the objects of a file."""
    reader = Reader(bytes(data))
    kinds = {dict: "dictionary", list: "array", Stream: "stream", Name: "name", bytes: "string", int: "integer", float: "real", bool: "boolean"}
    out = []
    for number in sorted({*reader.places, *reader.packed}):
        value = reader.object(number)
        out.append({"number": number, "kind": kinds.get(type(value), "null"), "bytes": len(value.data) if isinstance(value, Stream) else 0})
    return out


#: Widths of some characters of the upright sans font, in thousandths; others count as 556.
NARROW = {" ": 278, "i": 222, "j": 222, "l": 222, "f": 278, "t": 278, "r": 333, "I": 278, ".": 278, ",": 278, ":": 278, ";": 278, "'": 191, "!": 278, "(": 333, ")": 333, "-": 333, "m": 833, "w": 722, "M": 833, "W": 944}


def line_width(text: str, size: float) -> float:
    return sum(NARROW.get(c, 667 if c.isupper() else 556) for c in text) * size / 1000


def wrapped(text: str, size: float, width: float) -> list[str]:
    """Lines that fit a width, filled greedily; a word too long for a line is cut."""
    out, line = [], ""
    for word in text.split():
        while line_width(word, size) > width and len(word) > 1:
            cut = max(1, next((i for i in range(len(word), 0, -1) if line_width(word[:i], size) <= width), 1))
            if line:
                out.append(line)
                line = ""
            out.append(word[:cut])
            word = word[cut:]
        whole = f"{line} {word}" if line else word
        if line and line_width(whole, size) > width:
            out.append(line)
            line = word
        else:
            line = whole
    return [*out, line] if line else out


def flowed(blocks: list[dict], width: float = 612, height: float = 792, margin: float = 54, size: float = 10.5) -> tuple[list, list]:
    """(pages, outline) of blocks (kind, level, text) laid out one below the other: headings stay with two lines of what follows, no page ends or begins with a single line of a paragraph of more, and a page break begins a new one."""
    canvas, pages, outline, y = Canvas(), [], [], height - margin
    room = width - 2 * margin

    def turn():
        nonlocal canvas, y
        pages.append((canvas.content(), []))
        canvas, y = Canvas(), height - margin

    for block in blocks:
        kind, text = block["kind"], block["text"] or ""
        if kind == "page_break":
            turn()
            continue
        heading = kind == "heading"
        points = max(22 - 3 * (block["level"] or 0), 12) if heading else size
        font = "F5" if heading else "F0" if kind == "code" else "F4"
        indent = 14 * (block["level"] or 0) if kind == "item" else 10 if kind == "code" else 0
        lines = text.split("\n") if kind == "code" else wrapped(("• " if kind == "item" else "") + text, points, room - indent)
        step = points * 1.35
        fits = int((y - margin) // step)
        if heading and fits < 3 or len(lines) > 1 and fits < 2:
            turn()
            fits = int((y - margin) // step)
        if heading:
            outline.append((text, len(pages)))
        at = 0
        while at < len(lines):
            left = len(lines) - at
            take = min(left, max(1, int((y - margin) // step)))
            if left - take == 1 and take > 2:
                take -= 1  # the last line is not alone on the next page
            for line in lines[at : at + take]:
                y -= step
                canvas.text(margin + indent, y, font, points, line)
            at += take
            if at < len(lines):
                turn()
        y -= size * 0.7
    if canvas.parts or not pages:
        pages.append((canvas.content(), []))
    return pages, outline


@kernel("binary")
def _typeset(blocks, title):
    pages, outline = flowed(blocks)
    return document(pages, 612, 792, title, outline, [str(i + 1) for i in range(len(pages))])


def to_pdf(nodes: DataFrame) -> DataFrame:
    """doc_id, pdf: each document's blocks on pages, with an outline and page labels. Text stands without its formatting; tables are rows of text."""
    from quire.functions import inline
    from quire.functions.text import plain_text

    c = F.col("context")
    kind = F.when(c.isin("section", "floating_title") | (c == "document"), "heading").when(c.isin("listing", "literal", "verse"), "code").when(c == "list_item", "item").when(c == "page_break", "page_break").otherwise("text")
    said = F.when(kind == "heading", F.col("title")).otherwise(F.col("source"))
    made = nodes.where(c != "table").withColumns({"kind": kind, "said": said}).where("said IS NOT NULL OR kind = 'page_break'")
    shown = made.withColumn("shown", inline.normal("said")).withColumn("shown", F.when(F.col("kind") == "code", F.col("said")).otherwise(plain_text("shown")))
    level = F.when(F.col("kind") == "item", F.greatest(F.lit(0), (F.col("depth") / 2).cast("int") - 1)).otherwise(F.coalesce("level", F.lit(0)))
    block = F.struct("ord", F.col("kind"), level.alias("level"), F.col("shown").alias("text"))
    docs = nodes.where("context = 'document'").select(F.col("doc_id").alias("d_doc"), F.coalesce("title", F.lit("Untitled")).alias("title"))
    listed = shown.groupBy("doc_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    joined = docs.join(listed, F.col("doc_id") == F.col("d_doc"), "left")
    blocks = F.coalesce("blocks", F.array().cast(listed.schema["blocks"].dataType))
    return joined.select(F.col("d_doc").alias("doc_id"), _typeset(blocks, F.col("title")).alias("pdf"))


def anchor_pages(placed: DataFrame) -> DataFrame:
    """doc_id, anchor, pages (distinct, in order) of where anchors are."""
    return placed.groupBy("doc_id", "anchor").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def rotated(box: Column, degrees: Column) -> Column:
    """Width and height of a box (left, bottom, right, top) after a turn by quarters."""
    w, h = F.get(box, F.lit(2)) - F.get(box, F.lit(0)), F.get(box, F.lit(3)) - F.get(box, F.lit(1))
    turned = F.pmod(degrees, F.lit(180)) == 90
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))
