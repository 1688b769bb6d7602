"""Numbered addresses of works: schemes of levels, the markers of a text as units, addresses and what they refer to, notes and layers.

A scheme is a small table on the driver. Markers, notes, ranges, references
and terms are found by expressions; which unit a marker opens depends on all
before it, so that walk is a function over the events of a document. Joins
are by address keys: arrays of level names and labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.kernel import kernel
from quire.operators.catalog import successor

ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def to_roman(n: int) -> str:
    out = ""
    for value, mark in ROMAN:
        out, n = out + mark * (n // value), n % value
    return out


def from_roman(text: str) -> int | None:
    total, rest = 0, text.upper()
    for value, mark in ROMAN:
        while rest.startswith(mark):
            total, rest = total + value, rest[len(mark) :]
    return total if not rest and total and to_roman(total) == text.upper() else None


def label_key(kind: str, label: str, names: list[str] | None = None) -> list[int] | None:
    """The sort key of a label of a kind, or None if it is no such label.

    int: ``12``, with an inserted letter ``12a`` (the British ``12ZA`` comes
    before ``12A``) or decimal ``12.5``; alpha: a, z, aa, or doubled letters;
    roman; talmud: leaf and side, from 2a; folio: leaf, side, column;
    stephanus: page and letter a to e; bekker: page, column, line; enum and
    code: a place in a list; name: any text, unordered.
    """
    t = label.strip()
    if kind == "int":
        m = re.fullmatch(r"(\d+)(?:(Z)?([A-Za-z])|\.(\d+))?", t)
        if not m:
            return None
        inserted = 0 if not m[3] else ord(m[3].lower()) - 96 if not m[2] else ord(m[3].lower()) - 150
        return [int(m[1]), int(m[4]) if m[4] else inserted]
    if kind == "alpha":
        m = re.fullmatch(r"[a-z]{1,4}|[A-Z]{1,4}", t)
        if not m:
            return None
        low = t.lower()
        if len(low) > 1 and len(set(low)) == 1:
            return [26 * (len(low) - 1) + ord(low[0]) - 96]
        value = 0
        for c in low:
            value = value * 26 + ord(c) - 96
        return [value]
    if kind == "roman":
        n = from_roman(t) if t and (t.isupper() or t.islower()) else None
        return [n] if n else None
    if kind == "talmud":
        m = re.fullmatch(r"(\d+)([ab])", t)
        return [int(m[1]), int(m[2] == "b")] if m and int(m[1]) >= 2 else None
    if kind == "folio":
        m = re.fullmatch(r"(\d+)([rv])?([a-d])?", t)
        return [int(m[1]), int(m[2] == "v"), ord(m[3]) - 96 if m[3] else 0] if m else None
    if kind == "stephanus":
        m = re.fullmatch(r"(\d+)([a-e])", t)
        return [int(m[1]), ord(m[2]) - 96] if m else None
    if kind == "bekker":
        m = re.fullmatch(r"(\d+)([ab])(\d+)?", t)
        return [int(m[1]), ord(m[2]) - 96, int(m[3] or 0)] if m else None
    if kind in ("enum", "code"):
        low = [n.lower() for n in names or []]
        return [low.index(t.lower())] if t.lower() in low else None
    return [] if kind == "name" and t else None


def next_label(kind: str, label: str, names: list[str] | None = None) -> list[str]:
    """The labels that may follow one: two for a stephanus page (its next letter, or the next page's first)."""
    if kind == "int":
        m = re.match(r"\d+", label)
        return [str(int(m[0]) + 1)] + ([label[:-1] + successor(label[-1])] if label[-1:].isalpha() else [])
    if kind == "alpha":
        return [successor(label)]
    if kind == "roman":
        up = to_roman(from_roman(label) + 1)
        return [up if label.isupper() else up.lower()]
    if kind == "talmud":
        return [label[:-1] + "b" if label.endswith("a") else f"{int(label[:-1]) + 1}a"]
    if kind == "folio":
        m = re.fullmatch(r"(\d+)([rv])?([a-d])?", label)
        return [f"{int(m[1]) + 1}"] if not m[2] else [f"{m[1]}v" if m[2] == "r" else f"{int(m[1]) + 1}r"]
    if kind == "stephanus":
        page, letter = int(label[:-1]), label[-1]
        return ([f"{page}{chr(ord(letter) + 1)}"] if letter < "e" else []) + [f"{page + 1}a"]
    if kind == "bekker":
        m = re.fullmatch(r"(\d+)([ab])(\d+)?", label)
        if m[3]:
            return [f"{m[1]}{m[2]}{int(m[3]) + 1}"] + ([f"{m[1]}b1"] if m[2] == "a" else [f"{int(m[1]) + 1}a1"])
        return [f"{m[1]}b" if m[2] == "a" else f"{int(m[1]) + 1}a"]
    if kind in ("enum", "code") and names:
        at = label_key(kind, label, names)
        return [names[at[0] + 1]] if at and at[0] + 1 < len(names) else []
    return []


@dataclass
class Level:
    """A level of a scheme: its kind of label, what parts it from the level above, and how it begins.

    ``hidden``: may be left out of addresses. ``auto``: what opens a unit
    without a marker (never, block, paragraph, item). ``breaks``: what stands
    before a unit when it is shown (none, line, block, heading).
    """

    name: str
    kind: str = "int"
    separator: str = ":"
    close: str = ""
    names: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    hidden: bool = False
    auto: str = "never"
    breaks: str = "none"
    first: str | None = None
    template: str = "{label}"

    def key(self, label: str) -> list[int] | None:
        return label_key(self.kind, self.aliases.get(label.lower(), label), self.names)

    def start(self) -> str:
        return self.first or {"int": "1", "alpha": "a", "roman": "I", "talmud": "2a", "folio": "1r", "stephanus": "1a", "bekker": "1a1"}.get(self.kind) or (self.names[0] if self.names else "1")


@dataclass
class Scheme:
    """Levels, outermost first; streams of notes (caller style and the level at which callers start again); kinds of ranges (role and template); term rules (pattern, role, replacement)."""

    name: str
    levels: list[Level]
    streams: dict[str, dict] = field(default_factory=dict)
    ranges: dict[str, dict] = field(default_factory=dict)
    terms: list[dict] = field(default_factory=list)

    @classmethod
    def read(cls, text: str) -> "Scheme":
        """A scheme from its YAML."""
        from quire.sources import yaml

        given = yaml.load(text)
        levels = []
        for x in given.get("levels") or []:
            canon = (given.get("canons") or {}).get(x.get("canon"), [])
            names = [b["code"] if isinstance(b, dict) else b for b in canon] or x.get("names") or []
            aliases = {str(n).lower(): b["code"] for b in canon if isinstance(b, dict) for n in [b["code"], *(b.get("names") or [])]}
            levels.append(Level(**{k: v for k, v in x.items() if k in Level.__dataclass_fields__ and k not in ("names", "aliases")}, names=[str(n) for n in names], aliases=aliases))
        return cls(given.get("name", ""), levels, given.get("streams") or {}, given.get("ranges") or {}, given.get("terms") or [])

    def parse(self, address: str) -> list[tuple[str, str]] | None:
        """(level, label) of a compound address such as ``Ps 23:1`` or ``552(a)(1)``, or None. A name of a canon is read as far as the longest that fits; hidden levels may be left out."""
        return self._parse(address.strip(), 0)

    def _parse(self, text: str, depth: int):
        if depth == len(self.levels):
            return [] if not text else None
        level = self.levels[depth]
        if not text:
            return []
        body = text
        if depth:
            sep = level.separator
            if body.startswith(sep):
                body = body[len(sep) :]
            elif not sep.strip() and body[:1].isspace() or self.levels[depth - 1].kind in ("code", "name", "enum") and body[:1].isspace():
                body = body.lstrip()
            else:
                return self._parse(text, depth + 1) if level.hidden else None
        for label, rest in self._labels(level, body):
            tail = self._parse(rest, depth + 1)
            if tail is not None:
                return [(level.name, label), *tail]
        return self._parse(text, depth + 1) if level.hidden else None

    def _labels(self, level: Level, text: str):
        """(label, what is left) of the ways to read a label at the start of a text, longest first."""
        if level.close:
            stop = text.find(level.close)
            if stop > 0 and level.key(text[:stop]) is not None:
                yield text[:stop], text[stop + len(level.close) :]
            return
        if level.kind in ("code", "enum"):
            options = sorted({*(n.lower() for n in level.names), *level.aliases}, key=len, reverse=True)
            low = text.lower()
            for name in options:
                if low.startswith(name) and (len(text) == len(name) or not text[len(name)].isalpha()):
                    code = level.aliases.get(name) or next(n for n in level.names if n.lower() == name)
                    yield code, text[len(name) :]
            return
        stop = len(text)
        while stop > 0:
            label = text[:stop]
            if not label[-1].isspace() and level.key(label) is not None:
                yield label, text[stop:]
            stop -= 1

    def parse_list(self, text: str) -> list[tuple[list, list | None]]:
        """(from, to) of a list such as ``Ps 23:1-3, 5; 24:2``: parts take the levels that they leave out from the part before. To is None for a single unit. Parts that are no address are left out."""
        out, before = [], []
        for part in re.split(r"\s*[,;]\s*", text.strip()):
            low, dash, high = (x.strip() for x in re.sub(r"[–—]", "-", part).partition("-"))
            start = self._within(low, before)
            if start is None:
                continue
            stop = self._within(high, start) if dash and high else None
            out.append((start, stop))
            before = stop or start
        return out

    def _within(self, text: str, context: list):
        """An address, or one whose outer levels come from the context: the innermost levels that it can be."""
        whole = self.parse(text)
        if whole and whole[0][0] == self.levels[0].name and (not context or len(whole) > 1 or self.levels[0].kind in ("code", "name", "enum")):
            return whole
        names = [level.name for level in self.levels]
        held = dict(context)
        for depth in range(len(context) - 1 if context else 0, -1, -1):
            inner = Scheme(self.name, self.levels[depth:]).parse(text)
            if inner and inner[0][0] == names[depth]:
                return [(n, held[n]) for n in names[:depth] if n in held] + inner
        return whole

    def walk(self, markers: list[tuple[str | None, bool]]) -> list[dict]:
        """A unit for each marker (label or None for a step, whether it closes): its level, labels from the outermost in, and whether the label came in sequence.

        A label goes to the level whose reading scores best: what follows the
        level's last label, or begins it anew below a unit that is open, more
        than any other label of the kind; deeper levels first among equals.
        """
        held: list[str | None] = [None] * len(self.levels)
        at, out = 0, []
        for label, closes in markers:
            if closes:
                depth = self._depth(label, held) if label else max((i for i, x in enumerate(held) if x is not None), default=0)
                for i in range(depth, len(held)):
                    held[i] = None
                out.append({"level": None, "depth": depth, "labels": [x for x in held if x is not None], "problem": None})
                continue
            if label is None:
                depth = at if held[at] is not None else next((i for i, x in enumerate(held) if x is None), len(held) - 1)
                level = self.levels[depth]
                label = (next_label(level.kind, held[depth], level.names) or [level.start()])[0] if held[depth] is not None else level.start()
            else:
                depth = self._depth(label, held)
            problem = self._sequence(depth, label, held)
            held[depth] = label
            for i in range(depth + 1, len(held)):
                held[i] = None
            at = depth
            out.append({"level": self.levels[depth].name, "depth": depth, "labels": [x for x in held[: depth + 1] if x is not None], "problem": problem})
        return out

    def _depth(self, label: str, held: list) -> int:
        best = (-1, 0)
        for depth, level in enumerate(self.levels):
            if level.key(label) is None:
                continue
            if held[depth] is not None and label in next_label(level.kind, held[depth], level.names):
                score = 4
            elif held[depth] is None and label == level.start() and (depth == 0 or held[depth - 1] is not None or self.levels[depth - 1].hidden):
                score = 3
            elif held[depth] is None and depth and held[depth - 1] is None and not self.levels[depth - 1].hidden:
                score = 0
            else:
                score = 1 if level.kind == "name" else 2
            best = max(best, (score, depth))
        return best[1]

    def _sequence(self, depth: int, label: str, held: list) -> str | None:
        level, last = self.levels[depth], held[depth]
        if last is None or level.kind == "name" or label in next_label(level.kind, last, level.names):
            return None
        a, b = level.key(last), level.key(label)
        if a is None or b is None:
            return None
        return "repeat" if a == b else "backward" if b < a else "gap"

    def keys(self, labels: list[tuple[str, str]]) -> list[int]:
        """Sort key of an address: its labels' keys one after the other, each closed by -1, so that a unit comes before what is in it."""
        by = {level.name: level for level in self.levels}
        return [n for name, label in labels for n in [*(by[name].key(label) or [0]), -1]]


#: Marker, range ends, note, reference and defined term, in this order of alternatives.
TOKENS = r"(?<![\w@\\])@(?:\([^)\s]+\)|[\w.\-]+)?!?|\[[a-z][\w-]*\}|\{[a-z][\w-]*\]|note:[\w-]+\[(?:[^\]\\]|\\.)*+\]|<<[^<>]+>>|\[\.dfn\]#[^#]+#"


def events(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, nth, kind, name, text of the tokens in lines (doc_id, line_no, text), in order.

    marker: text is its label (null: a step), name ``close`` if it closes;
    open and close: ends of a range of kind name; note: name is its stream;
    reference: text is its address; term: name is its id, made of its text.
    """
    found = rows.where(F.col("text").rlike(r"[@\[{<:]")).select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(TOKENS), F.lit(0))).alias("nth", "m"))
    m = F.col("m")
    kind = F.when(m.startswith("@"), "marker").when(m.startswith("note:"), "note").when(m.startswith("<<"), "reference").when(m.startswith("[.dfn]"), "term").when(m.startswith("["), "open").otherwise("close")
    label = F.nullif(F.regexp_replace(F.regexp_replace(m, r"^@|!$", ""), r"^\(|\)$", ""), F.lit(""))
    term = F.regexp_extract(m, "#([^#]+)#", 1)
    name = F.when(kind == "marker", F.when(m.endswith("!"), "close")).when(kind == "note", F.regexp_extract(m, r"^note:([\w-]+)", 1)).when(kind == "term", F.btrim(F.regexp_replace(F.lower(term), r"[^\p{L}\p{Nd}]+", "-"), F.lit("-"))).when(kind != "reference", F.regexp_extract(m, r"([a-z][\w-]*)", 1))
    text = F.when(kind == "marker", label).when(kind == "note", F.replace(F.regexp_extract(m, r"\[([\s\S]*)\]$", 1), F.lit("\\]"), F.lit("]"))).when(kind == "reference", F.regexp_extract(m, "<<([^<>]+)>>", 1)).when(kind == "term", term)
    return found.select("doc_id", "line_no", "nth", kind.alias("kind"), name.alias("name"), text.alias("text"))


def notes(tokens: DataFrame) -> DataFrame:
    """doc_id, line_no, nth, stream, lemma (what stands before ``|``; null without), body of the notes."""
    has = F.col("text").contains("|")
    return tokens.where("kind = 'note'").select("doc_id", "line_no", "nth", F.col("name").alias("stream"), F.when(has, F.btrim(F.substring_index("text", "|", 1))).alias("lemma"), F.btrim(F.when(has, F.substr(F.col("text"), F.instr("text", "|") + 1)).otherwise(F.col("text"))).alias("body"))


def terms(tokens: DataFrame) -> DataFrame:
    """doc_id, id, text of defined terms, the first of each id."""
    return tokens.where("kind = 'term'").groupBy("doc_id", F.col("name").alias("id")).agg(F.min_by("text", F.struct("line_no", "nth")).alias("text"))


def paired(opens: list[tuple[str, str]]) -> list[int | None]:
    """For (kind, name) of range ends in order, the place of each open one's close: the last open one of its name."""
    out: list[int | None] = [None] * len(opens)
    held: dict[str, list[int]] = {}
    for i, (kind, name) in enumerate(opens):
        if kind == "open":
            held.setdefault(name, []).append(i)
        elif held.get(name):
            out[held[name].pop()] = i
    return out


def ranges(tokens: DataFrame) -> DataFrame:
    """doc_id, name, start and stop (structs of line_no and nth; stop null if it is never closed) of ranges."""
    listed = tokens.where("kind IN ('open', 'close')").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "nth", "kind", "name"))).alias("e"))
    stops = kernel("array<int>")(lambda e: paired([(x["kind"], x["name"]) for x in e]))("e")
    found = listed.select("doc_id", "e", F.posexplode(F.arrays_zip("e", stops.alias("stop"))).alias("i", "x"))
    at = lambda x: F.struct(x["line_no"].alias("line_no"), x["nth"].alias("nth"))
    return found.where("x.e.kind = 'open'").select("doc_id", F.col("x.e.name").alias("name"), at(F.col("x.e")).alias("start"), F.when(F.col("x.stop").isNotNull(), at(F.get("e", F.col("x.stop")))).alias("stop"))


UNIT = "array<struct<level:string,depth:int,labels:array<string>,problem:string>>"


def units(tokens: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, start (line_no, nth), end (null: open to the end), level, depth, labels (from the outermost level in), id, problem of the units that markers open. A unit ends where one of its level or a shallower one begins, or is closed."""
    listed = tokens.where("kind = 'marker'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "nth", "text", "name"))).alias("e"))
    walked = kernel(UNIT)(lambda e: scheme.walk([(x["text"], x["name"] == "close") for x in e]))("e")
    rows = listed.select("doc_id", F.explode(F.arrays_zip("e", walked.alias("u"))).alias("x"))
    rows = rows.select("doc_id", F.struct(F.col("x.e.line_no").alias("line_no"), F.col("x.e.nth").alias("nth")).alias("start"), "x.u.*")
    after = Window.partitionBy("doc_id").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.when(F.col("depth") == d, F.first(F.when(F.col("depth") <= d, F.col("start")), True).over(after)) for d in range(len(scheme.levels))]
    placed = rows.withColumn("end", F.coalesce(*ends)).where("level IS NOT NULL")
    return placed.withColumn("id", default_id(F.col("labels")))


def default_id(labels: Column) -> Column:
    """The id that a unit has by default: its labels, joined by dots, in lower case."""
    return F.lower(F.array_join(F.transform(labels, lambda x: F.regexp_replace(x, r"\s+", "-")), "."))


def duplicates(found: DataFrame) -> DataFrame:
    """doc_id, id, start of units whose id came before in the document."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("start"))
    return found.withColumn("nth", nth).where("nth > 1").select("doc_id", "id", "start")


def automatic(blocks: DataFrame, level: Level, by: list[str], order: str) -> DataFrame:
    """Adds label to blocks of an automatic level: numbers (or letters, or numerals) from its first on, within each of ``by``."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    start = level.key(level.start())[0]
    number = n + F.lit(start - 1)
    from quire.functions.text import to_alpha
    from quire.functions.text import to_roman as roman

    return blocks.withColumn("label", {"alpha": to_alpha(number), "roman": roman(number)}.get(level.kind, number.cast("string")))


ADDRESSES = "array<struct<low:array<string>,high:array<string>,low_key:array<int>,high_key:array<int>,level:string>>"


def addresses(text, scheme: Scheme) -> Column:
    """The units and ranges that an address text names: labels from the outermost level in, and sort keys; high is null for single units."""

    def parsed(t):
        out = []
        for low, high in scheme.parse_list(t):
            out.append({"low": [x for _, x in low], "high": [x for _, x in high] if high else None, "low_key": scheme.keys(low), "high_key": scheme.keys(high) if high else None, "level": low[-1][0] if low else None})
        return out

    return kernel(ADDRESSES)(parsed)(text)


def resolved(references: DataFrame, found: DataFrame, scheme: Scheme, text: str = "text") -> DataFrame:
    """References (ref_id, work, text) with the units (work, labels, id) that they name: an equi-join on work and labels; units null where there is none. A range names its first unit; see ``passage``."""
    asked = references.select("ref_id", "work", F.explode(addresses(F.col(text), scheme)).alias("a")).select("ref_id", F.col("work").alias("r_work"), F.col("a.low").alias("low"), F.col("a.high").alias("high"))
    return asked.join(found.select("work", "labels", "id"), (F.col("r_work") == F.col("work")) & (F.col("low") == F.col("labels")), "left").select("ref_id", F.col("r_work").alias("work"), "low", "high", "id")


def in_context(references: DataFrame, found: DataFrame, scheme: Scheme, group: str = "doc_id", at: str = "pos") -> DataFrame:
    """References (doc_id, pos, text) with labels: what they leave out of the outer levels is taken from the unit that they stand in, the last that starts at or before them (doc_id, pos, labels). One sort of both together."""
    r = references.select(group, F.col(at).alias("p"), F.lit(1).alias("side"), F.lit(None).cast("array<string>").alias("labels"), F.struct(*references.columns).alias("rec"))
    u = found.select(group, F.col(at).alias("p"), F.lit(0).alias("side"), "labels", F.lit(None).cast(r.schema["rec"].dataType).alias("rec"))
    by = Window.partitionBy(group).orderBy("p", "side").rowsBetween(Window.unboundedPreceding, 0)
    held = r.unionByName(u).withColumn("context", F.last("labels", True).over(by)).where("side = 1")
    names = [level.name for level in scheme.levels]

    def full(text, context):
        inner = scheme._within(text, list(zip(names, context or [], strict=False)))
        return [x for _, x in inner] if inner else None

    return held.select("rec.*", kernel("array<string>")(full)(F.col("rec.text"), "context").alias("labels"))


def with_hidden(references: DataFrame, found: DataFrame, hidden: int) -> DataFrame:
    """References (ref_id, work, labels) that leave out the level at place ``hidden`` (from 0) with the first unit that fits with any label there: an equi-join on the labels without it."""
    bare = lambda x: F.concat(F.slice(x, 1, hidden), F.slice(x, hidden + 2, F.greatest(F.size(x) - hidden - 1, F.lit(0))))
    keyed = found.select(F.col("work").alias("u_work"), bare(F.col("labels")).alias("bare"), "labels", "id", "start").groupBy("u_work", "bare").agg(F.min_by("id", "start").alias("id"))
    return references.join(keyed, (F.col("work") == F.col("u_work")) & (F.col("labels") == F.col("bare")), "left").select("ref_id", "work", "labels", "id")


def passage(found: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (passage_id, work, low_key, high_key) with the units (work, key, id) from low to high, what is inside the last one included: an equi-join on the work with a range of sort keys."""
    a = asked.select("passage_id", F.col("work").alias("a_work"), "low_key", F.coalesce("high_key", "low_key").alias("high_key"))
    inside = (F.col("key") >= F.col("low_key")) & ((F.col("key") <= F.col("high_key")) | (F.slice("key", 1, F.size("high_key")) == F.col("high_key")))
    return found.join(a, (F.col("work") == F.col("a_work")) & inside).select("passage_id", "work", "id", "key")


def layer_notes(layer: DataFrame, found: DataFrame) -> DataFrame:
    """Notes kept elsewhere (work, labels, lemma, body) with the unit (work, labels, id, text) that they belong to and the place of their lemma in its text (from 0; null if it is not there, or no lemma is given)."""
    joined = layer.join(found.select(F.col("work").alias("u_work"), F.col("labels").alias("u_labels"), "id", "text"), (F.col("work") == F.col("u_work")) & (F.col("labels") == F.col("u_labels")), "left")
    at = F.nullif(F.instr("text", F.col("lemma")), F.lit(0))
    return joined.select("work", "labels", "lemma", "body", "id", (at - 1).alias("place"))


def overlaid(found: DataFrame, overlay: DataFrame) -> DataFrame:
    """Units (work, labels, text) with an edition's own text (work, labels, text) where it has one; edition says whether it has."""
    o = overlay.select(F.col("work").alias("o_work"), F.col("labels").alias("o_labels"), F.col("text").alias("o_text"))
    return found.join(o, (F.col("work") == F.col("o_work")) & (F.col("labels") == F.col("o_labels")), "left").withColumn("edition", F.col("o_text").isNotNull()).withColumn("text", F.coalesce("o_text", "text")).drop("o_work", "o_labels", "o_text")


def included_passage(rows: DataFrame, found: DataFrame, asked: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, text) of other documents from where a passage begins to where it ends: asked (passage_id, doc_id, low, high as labels), found (doc_id, labels, start, end)."""
    low = found.select(F.col("doc_id").alias("l_doc"), F.col("labels").alias("l_labels"), F.col("start.line_no").alias("first"))
    high = found.select(F.col("doc_id").alias("h_doc"), F.col("labels").alias("h_labels"), F.col("end.line_no").alias("past"))
    spans = asked.join(low, (F.col("doc_id") == F.col("l_doc")) & (F.col("low") == F.col("l_labels"))).join(high, (F.col("doc_id") == F.col("h_doc")) & (F.coalesce("high", "low") == F.col("h_labels"))).select("passage_id", F.col("doc_id").alias("s_doc"), "first", "past")
    inside = (F.col("line_no") >= F.col("first")) & (F.col("past").isNull() | (F.col("line_no") < F.col("past")))
    return rows.join(spans, (F.col("doc_id") == F.col("s_doc")) & inside).select("passage_id", "doc_id", "line_no", "text")


def repeated(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks asked for again by id (ask_id, doc_id, id): the first block of that id with all its columns, null if there is none."""
    first = nodes.where("id IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("ord"))).where("nth = 1").drop("nth")
    own = first.select(F.col("doc_id").alias("n_doc"), F.col("id").alias("n_id"), F.struct(*first.columns).alias("block"))
    return asked.join(own, (F.col("doc_id") == F.col("n_doc")) & (F.col("id") == F.col("n_id")), "left").select("ask_id", "doc_id", "id", "block")


def mapped(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """Units (work, labels) with their labels in another numbering: mapping (work, labels, other); those that it leaves out keep theirs."""
    m = mapping.select(F.col("work").alias("m_work"), F.col("labels").alias("m_labels"), "other")
    return found.join(m, (F.col("work") == F.col("m_work")) & (F.col("labels") == F.col("m_labels")), "left").withColumn("other", F.coalesce("other", "labels")).drop("m_work", "m_labels")


def term_roles(text, rules: list[dict]) -> Column:
    """A text in which what matches each rule (pattern, role, replacement) is marked ``[.role]#..#``; the first rule of the list that matches a place wins, as later rules leave marked text alone."""
    out = F.col(text) if isinstance(text, str) else text
    for rule in rules:
        body = rule.get("replacement", "$0")
        out = F.regexp_replace(out, rf"(?<![#\w])(?:{rule['pattern']})(?![#\w])", f"[.{rule['role']}]#{body}#")
    return out


def by_level(found: DataFrame) -> DataFrame:
    """doc_id, level, units: how many units of each level a document has."""
    return found.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("units"))


def report(found: DataFrame, problems: DataFrame) -> DataFrame:
    """doc_id, report: JSON of the counts by level and of the problems (doc_id, line_no, problem) of each document that has units or problems."""
    counts = by_level(found).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "units")))).alias("units"))
    wrong = problems.groupBy(F.col("doc_id").alias("p_doc")).agg(F.sort_array(F.collect_list(F.struct("line_no", "problem"))).alias("problems"))
    joined = counts.join(wrong, F.col("doc_id") == F.col("p_doc"), "full")
    return joined.select(F.coalesce("doc_id", "p_doc").alias("doc_id"), F.to_json(F.struct("units", "problems")).alias("report"))


def report_lines(reports: DataFrame) -> DataFrame:
    """doc_id, text: the same as lines to be read."""
    kind = "struct<units:map<string,bigint>,problems:array<struct<line_no:int,problem:string>>>"
    r = reports.select("doc_id", F.from_json("report", kind).alias("r"))
    empty = F.array().cast("array<string>")
    counts = F.transform(F.map_entries("r.units"), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))
    wrong = F.transform("r.problems", lambda p: F.concat(F.lit("line "), p["line_no"].cast("string"), F.lit(": "), p["problem"]))
    return r.select("doc_id", F.array_join(F.concat(F.coalesce(counts, empty), F.coalesce(wrong, empty)), "\n").alias("text"))


#: Hebrew letters by value, and the spellings of 15 and 16.
HEBREW = [(400, "ת"), (300, "ש"), (200, "ר"), (100, "ק"), (90, "צ"), (80, "פ"), (70, "ע"), (60, "ס"), (50, "נ"), (40, "מ"), (30, "ל"), (20, "כ"), (10, "י"), (9, "ט"), (8, "ח"), (7, "ז"), (6, "ו"), (5, "ה"), (4, "ד"), (3, "ג"), (2, "ב"), (1, "א")]


def filtered(value: str, name: str, argument: str | None = None) -> str:
    """A template's value put through a filter: lower, upper, titlecase, arabic-indic, roman, ROMAN, hebrew, every, pad, slug."""
    if name in ("lower", "upper"):
        return value.lower() if name == "lower" else value.upper()
    if name == "titlecase":
        return " ".join(w[:1].upper() + w[1:].lower() for w in value.split(" "))
    if name == "arabic-indic":
        return value.translate({48 + i: 0x660 + i for i in range(10)})
    if name in ("roman", "ROMAN") and value.isdigit() and int(value):
        mark = to_roman(int(value))
        return mark if name == "ROMAN" else mark.lower()
    if name == "hebrew" and value.isdigit() and int(value):
        n, out = int(value), ""
        for size, letter in HEBREW:
            while n >= size:
                if n in (15, 16):
                    return out + ("טו" if n == 15 else "טז")
                out, n = out + letter, n - size
        return out
    if name == "every" and value.isdigit():
        return value if int(value) % int(argument or 1) == 0 else ""
    if name == "pad":
        return value.rjust(int(argument or 2), "0")
    if name == "slug":
        return re.sub(r"[^\w]+", "-", value.lower()).strip("-")
    return value


def filled_template(template: str, values: dict[str, str]) -> str:
    """A template with ``{name}`` and ``{name|filter|filter:argument}`` filled; what is in ``{? .. ?}`` goes if a name in it has no value."""

    def value(m) -> str:
        name, *filters = m[1].split("|")
        out = values.get(name.strip()) or ""
        for f in filters:
            kind, _, argument = f.strip().partition(":")
            out = filtered(out, kind, argument or None)
        return out

    def optional(m) -> str:
        names = [x.split("|")[0].strip() for x in re.findall(r"\{([^{}?]+)\}", m[1])]
        return m[1] if all(values.get(n) for n in names) else ""

    return re.sub(r"\{([^{}?]+)\}", value, re.sub(r"\{\?(.*?)\?\}", optional, template))


def unit_text(template: str, values: Column) -> Column:
    """A template filled from a map column: ids, reference texts and printed labels of units."""
    return kernel("string")(lambda v: filled_template(template, dict(v)))(values)


def rendered(found: DataFrame, scheme: Scheme, text: str = "text") -> DataFrame:
    """doc_id, html: units with their printed labels, in order, each after the break of its level; notes' callers stand where ``caller`` (null: none) says."""
    level = {x.name: x for x in scheme.levels}

    def label(name, labels):
        x = level[name]
        values = dict(zip([y.name for y in scheme.levels], labels, strict=False)) | {"label": labels[-1]}
        mark = f'<span class="unit {name}">{filled_template(x.template, values)}</span>'
        return {"none": "", "line": "<br>\n", "block": "</p>\n<p>", "heading": "\n"}[x.breaks] + (f"<h{2 + list(level).index(name)}>{mark}</h{2 + list(level).index(name)}>\n" if x.breaks == "heading" else mark)

    caller = F.coalesce(F.concat(F.lit('<sup class="caller">'), "caller", F.lit("</sup>")), F.lit("")) if "caller" in found.columns else F.lit("")
    made = F.concat(kernel("string")(label)("level", "labels"), F.lit(" "), F.coalesce(text, F.lit("")), caller)
    return found.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", made.alias("made")))), lambda x: x["made"]), " ").alias("html"))
