"""Font files: tables, names, metrics and characters of TrueType and OpenType files, a match by family and style, and subsets.

A font is one binary value; its facts are read per row, so an index of many
files is a scan.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import kernel


def unwrapped(data: bytes) -> bytes | None:
    """The plain font of a WOFF file (each table deflated on its own); plain fonts as they are; None for what is no font, or is packed by a codec that is not here."""
    if data[:4] in (b"\x00\x01\x00\x00", b"OTTO", b"true"):
        return data
    if data[:4] != b"wOFF":
        return None
    flavour, count = data[4:8], struct.unpack(">H", data[12:14])[0]
    entries = [struct.unpack(">4sIIII", data[44 + 20 * i : 64 + 20 * i]) for i in range(count)]
    tables = {tag: data[at : at + packed] if packed == size else zlib.decompress(data[at : at + packed]) for tag, at, packed, size, _ in entries}
    return built(flavour, tables)


def built(flavour: bytes, tables: dict[bytes, bytes]) -> bytes:
    """A font file of tables, each padded to four bytes, with its checksums."""
    count = len(tables)
    power = 1 << (count.bit_length() - 1)
    head = flavour + struct.pack(">HHHH", count, power * 16, power.bit_length() - 1, count * 16 - power * 16)
    at, records, body = 12 + 16 * count, [], []
    for tag in sorted(tables):
        data = tables[tag]
        if tag == b"head":
            data = data[:8] + b"\0\0\0\0" + data[12:]
        records.append(struct.pack(">4sIII", tag, checksum(data), at, len(data)))
        body.append(data + b"\0" * (-len(data) % 4))
        at += len(body[-1])
    whole = bytearray(head + b"".join(records) + b"".join(body))
    if b"head" in tables:
        place = next(struct.unpack(">4sIII", r)[2] for r in records if r[:4] == b"head")
        whole[place + 8 : place + 12] = struct.pack(">I", (0xB1B0AFBA - checksum(bytes(whole))) & 0xFFFFFFFF)
    return bytes(whole)


def checksum(data: bytes) -> int:
    padded = data + b"\0" * (-len(data) % 4)
    return sum(struct.unpack(f">{len(padded) // 4}I", padded)) & 0xFFFFFFFF


class Font:
    """The tables of a plain font, read as they are asked for."""

    def __init__(self, data: bytes):
        plain = unwrapped(data)
        if plain is None:
            raise ValueError("no font")
        self.flavour, count = plain[:4], struct.unpack(">H", plain[4:6])[0]
        self.tables = {}
        for i in range(count):
            tag, _, at, size = struct.unpack(">4sIII", plain[12 + 16 * i : 28 + 16 * i])
            self.tables[tag] = plain[at : at + size]

    def number(self, table: bytes, at: int, form: str = "H") -> int:
        return struct.unpack_from(">" + form, self.tables[table], at)[0]

    @property
    def units(self) -> int:
        return self.number(b"head", 18)

    @property
    def glyphs(self) -> int:
        return self.number(b"maxp", 4)

    def names(self) -> dict[int, str]:
        """Names by their number (1 family, 2 style, 4 full, 16 and 17 typographic), Unicode ones first."""
        table = self.tables.get(b"name", b"\0" * 6)
        count, start = struct.unpack(">HH", table[2:6])
        out: dict[int, str] = {}
        for i in range(count):
            platform, _, _, key, size, at = struct.unpack(">HHHHHH", table[6 + 12 * i : 18 + 12 * i])
            raw = table[start + at : start + at + size]
            text = raw.decode("utf-16-be" if platform in (0, 3) else "latin-1", "replace")
            if key not in out or platform in (0, 3):
                out[key] = text
        return out

    def style(self) -> tuple[int, int, bool]:
        """Weight, width (1 to 9) and whether it is slanted."""
        if b"OS/2" in self.tables and len(self.tables[b"OS/2"]) >= 64:
            return self.number(b"OS/2", 4), self.number(b"OS/2", 6), bool(self.number(b"OS/2", 62) & 1)
        mac = self.number(b"head", 44)
        return 700 if mac & 1 else 400, 5, bool(mac & 2)

    def characters(self) -> dict[int, int]:
        """Glyph by code point, of the widest Unicode map (formats 4, 6 and 12)."""
        table = self.tables.get(b"cmap")
        if not table:
            return {}
        best = None
        for i in range(struct.unpack(">H", table[2:4])[0]):
            platform, encoding, at = struct.unpack(">HHI", table[4 + 8 * i : 12 + 8 * i])
            form = struct.unpack_from(">H", table, at)[0]
            rank = {12: 3, 4: 2, 6: 1}.get(form, 0)
            if (platform == 0 or platform == 3 and encoding in (1, 10)) and rank and (best is None or rank > best[0]):
                best = (rank, form, at)
        out: dict[int, int] = {}
        if best is None:
            return out
        _, form, at = best
        if form == 12:
            for i in range(struct.unpack_from(">I", table, at + 12)[0]):
                first, last, glyph = struct.unpack_from(">III", table, at + 16 + 12 * i)
                out.update({c: glyph + c - first for c in range(first, last + 1)})
        elif form == 6:
            first, count = struct.unpack_from(">HH", table, at + 6)
            out.update({first + i: struct.unpack_from(">H", table, at + 10 + 2 * i)[0] for i in range(count)})
        else:
            segments = struct.unpack_from(">H", table, at + 6)[0] // 2
            part = lambda k, form: struct.unpack_from(f">{segments}{form}", table, at + 14 + k)
            ends, starts, deltas, offsets = part(0, "H"), part(2 * segments + 2, "H"), part(4 * segments + 2, "h"), part(6 * segments + 2, "H")
            for i in range(segments):
                for c in range(starts[i], min(ends[i], 0xFFFE) + 1):
                    if offsets[i]:
                        place = at + 14 + 6 * segments + 2 + 2 * i + offsets[i] + 2 * (c - starts[i])
                        glyph = struct.unpack_from(">H", table, place)[0] if place + 2 <= len(table) else 0
                        glyph = (glyph + deltas[i]) & 0xFFFF if glyph else 0
                    else:
                        glyph = (c + deltas[i]) & 0xFFFF
                    if glyph:
                        out[c] = glyph
        return out

    def advances(self) -> list[int]:
        """Width of each glyph; the last one stands for all after it."""
        count = self.number(b"hhea", 34)
        own = [self.number(b"hmtx", 4 * i) for i in range(count)]
        return own + own[-1:] * (self.glyphs - count)

    def outlines(self) -> list[tuple[int, int]]:
        """Where each glyph's outline begins and ends."""
        long = self.number(b"head", 50, "h")
        n = self.glyphs + 1
        places = struct.unpack(f">{n}{'I' if long else 'H'}", self.tables[b"loca"][: n * (4 if long else 2)])
        places = places if long else [2 * p for p in places]
        return list(zip(places[:-1], places[1:], strict=True))

    def parts(self, glyph: int) -> list[int]:
        """The glyphs that a composite glyph is made of; none for others."""
        a, b = self.outlines()[glyph]
        data = self.tables[b"glyf"][a:b]
        if len(data) < 10 or struct.unpack(">h", data[:2])[0] >= 0:
            return []
        out, at = [], 10
        while True:
            flags, part = struct.unpack(">HH", data[at : at + 4])
            out.append(part)
            at += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 0x40 else 8 if flags & 0x80 else 0)
            if not flags & 0x20:
                return out

    def closure(self, glyphs) -> list[int]:
        """Glyphs with all that they are made of, and the first one."""
        seen, todo = set(), [0, *glyphs]
        while todo:
            g = todo.pop()
            if g not in seen and g < self.glyphs:
                seen.add(g)
                todo += self.parts(g) if b"glyf" in self.tables else []
        return sorted(seen)

    def subset(self, text: str) -> bytes:
        """The font with the outlines of the text's glyphs alone; glyphs keep their numbers, so nothing else changes."""
        chars = self.characters()
        kept = set(self.closure(chars[ord(c)] for c in set(text) if ord(c) in chars))
        outlines, places = [], [0]
        for g, (a, b) in enumerate(self.outlines()):
            data = self.tables[b"glyf"][a:b] if g in kept else b""
            outlines.append(data + b"\0" * (-len(data) % 4))
            places.append(places[-1] + len(outlines[-1]))
        tables = {t: d for t, d in self.tables.items() if t in (b"OS/2", b"cmap", b"cvt ", b"fpgm", b"head", b"hhea", b"hmtx", b"maxp", b"name", b"post", b"prep")}
        head = tables[b"head"]
        tables |= {b"glyf": b"".join(outlines), b"loca": struct.pack(f">{len(places)}I", *places), b"head": head[:50] + struct.pack(">h", 1) + head[52:]}
        return built(self.flavour, tables)

    def kerning(self) -> dict[tuple[int, int], int]:
        """Adjustments of pairs of glyphs, of the plain kern table."""
        table, out, at = self.tables.get(b"kern", b""), {}, 4
        if len(table) < 4:
            return out
        for _ in range(struct.unpack(">H", table[2:4])[0]):
            _, size, cover = struct.unpack(">HHH", table[at : at + 6])
            if cover >> 8 == 0 and cover & 1:
                count = struct.unpack(">H", table[at + 6 : at + 8])[0]
                for i in range(count):
                    a, b, value = struct.unpack(">HHh", table[at + 14 + 6 * i : at + 20 + 6 * i])
                    out[a, b] = value
            at += size or len(table)
        return out

    def width_of(self, text: str, size: float = 1.0) -> float:
        """The width of a line of text, kerned, in units of ``size``."""
        chars, advances, kerned = self.characters(), self.advances(), self.kerning()
        glyphs = [chars.get(ord(c), 0) for c in text]
        total = sum(advances[g] for g in glyphs) + sum(kerned.get(p, 0) for p in zip(glyphs, glyphs[1:], strict=False))
        return total * size / self.units

    def math_constants(self) -> dict[str, int] | None:
        """Some constants of the table for formulas; None without one."""
        table = self.tables.get(b"MATH")
        if not table:
            return None
        at = struct.unpack(">H", table[4:6])[0]
        value = lambda i: struct.unpack_from(">h", table, at + 8 + 4 * i)[0]
        percent = struct.unpack_from(">hh", table, at)
        return {"script_percent": percent[0], "script_script_percent": percent[1], "axis_height": value(1), "sub_shift_down": value(4), "sup_shift_up": value(7), "fraction_rule": value(34)}


FACTS = "struct<family:string,style:string,weight:int,width:int,italic:boolean,units:int,glyphs:int,characters:int>"


@kernel(FACTS)
def font_facts(data):
    """Family, style and sizes of a font file; null for what is none."""
    try:
        font = Font(bytes(data))
        names = font.names()
        weight, width, italic = font.style()
        return {"family": names.get(16) or names.get(1), "style": names.get(17) or names.get(2), "weight": weight, "width": width, "italic": italic, "units": font.units, "glyphs": font.glyphs, "characters": len(font.characters())}
    except (ValueError, KeyError, struct.error, zlib.error, IndexError):
        return None


def font_index(files: DataFrame, content: str = "content") -> DataFrame:
    """path and facts of each font file (path, content); what is no font is left out."""
    found = files.select("path", font_facts(content).alias("f")).where("f IS NOT NULL")
    return found.select("path", "f.*")


def matched(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Asked fonts (ask_id, family, bold, italic, width) with the path of the best of the index: of that family, by slant, then width, then weight; the first path among equals, null without the family. The index is grouped by family and slant before the join."""
    i = index.select(F.lower("family").alias("i_family"), "path", "weight", F.col("width").alias("i_width"), F.col("italic").alias("i_italic"))
    want = F.when(F.col("bold"), 700).otherwise(400)
    score = F.when(F.col("i_italic") == F.col("italic"), 0).otherwise(100000) + F.abs(F.col("i_width") - F.coalesce("width", F.lit(5))) * 1000 + F.abs(F.col("weight") - want)
    joined = asked.join(i, F.lower("family") == F.col("i_family"), "left").withColumn("score", score)
    best = F.row_number().over(Window.partitionBy("ask_id").orderBy("score", "path"))
    return joined.withColumn("best", best).where("best = 1").select("ask_id", "path", "score")


def glyph_closure(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """font, glyph of all glyphs that wanted ones (font, glyph) are made of, at any depth, themselves included: parts has font, glyph, part. One join per level of composites."""
    from quire.durable import durable

    edges = parts.select(F.col("font").alias("p_font"), F.col("glyph").alias("p_glyph"), "part")
    found = durable(wanted.select("font", "glyph").distinct(), "glyphs")
    front = found
    while True:
        new = front.join(edges, (F.col("font") == F.col("p_font")) & (F.col("glyph") == F.col("p_glyph"))).select("font", F.col("part").alias("glyph")).distinct()
        front = durable(new.join(found, ["font", "glyph"], "left_anti"), "glyphs")
        if front.isEmpty():
            return found
        found = durable(found.unionByName(front), "glyphs")


def subset_for(data, text) -> "F.Column":
    """A font with the outlines of a text's characters alone; null for what has no outlines of that kind."""

    def cut(d, t):
        try:
            font = Font(bytes(d))
            return font.subset(t or "") if b"glyf" in font.tables else None
        except (ValueError, KeyError, struct.error, IndexError):
            return None

    return kernel("binary")(cut)(data, text)


def text_width(data, text, size: float = 1.0) -> "F.Column":
    def measured(d, t):
        try:
            return Font(bytes(d)).width_of(t or "", size)
        except (ValueError, KeyError, struct.error, IndexError):
            return None

    return kernel("double")(measured)(data, text)
