"""Formulas as MathML: from the plain notation (``x^2/3``) and from the TeX notation (``\\frac{x^2}{3}``), and MathML as a tree.

Both notations are read by one small parser each, of a token list, into the
same elements. What a notation has no word for stands as text.
"""

from __future__ import annotations

import html
import re
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernel import kernel

#: Names of letters and signs in both notations.
GREEK = {n: chr(c) for n, c in zip("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split(), range(0x3B1, 0x3C2), strict=True)} | {n: chr(c) for n, c in zip("sigma tau upsilon phi chi psi omega".split(), range(0x3C3, 0x3CA), strict=True)}
GREEK |= {k.capitalize(): v.upper() for k, v in GREEK.items()}
SIGNS = {
    "times": "×", "cdot": "⋅", "div": "÷", "pm": "±", "mp": "∓", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "approx": "≈", "equiv": "≡", "sim": "∼", "prop": "∝", "propto": "∝", "in": "∈", "notin": "∉", "subset": "⊂", "subseteq": "⊆", "cup": "∪", "cap": "∩",
    "forall": "∀", "exists": "∃", "neg": "¬", "land": "∧", "lor": "∨", "to": "→", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "Leftrightarrow": "⇔", "infty": "∞", "partial": "∂", "nabla": "∇", "ldots": "…", "cdots": "⋯", "int": "∫", "oint": "∮", "sum": "∑", "prod": "∏", "emptyset": "∅",
}
BIG = {"∑", "∏", "∫", "∮", "lim", "max", "min"}
#: Functions, which stand upright.
FUNCTIONS = "sin cos tan sec csc cot arcsin arccos arctan sinh cosh tanh log ln exp lim max min det gcd dim".split()
#: Signs of the plain notation that are no words, longest first.
PLAIN_SIGNS = [("<=>", "⇔"), ("!in", "∉"), ("|->", "↦"), ("sube", "⊆"), ("<=", "≤"), (">=", "≥"), ("!=", "≠"), ("->", "→"), ("=>", "⇒"), ("+-", "±"), ("**", "∗"), ("xx", "×"), ("-:", "÷"), ("~~", "≈"), ("-=", "≡"), ("oo", "∞"), ("uu", "∪"), ("nn", "∩"), ("^^", "∧"), ("vv", "∨"), ("AA", "∀"), ("EE", "∃"), ("O/", "∅"), ("...", "…")]
ACCENTS = {"hat": "^", "bar": "¯", "vec": "→", "dot": ".", "ddot": "..", "tilde": "~", "overline": "¯"}
FONTS = {"bb": "bold", "mathbf": "bold", "cc": "script", "mathcal": "script", "tt": "monospace", "mathtt": "monospace", "fr": "fraktur", "mathfrak": "fraktur", "sf": "sans-serif", "mathsf": "sans-serif", "bbb": "double-struck", "mathbb": "double-struck"}


def element(tag: str, *inner: str, **attributes: str) -> str:
    return f"<{tag}{''.join(f' {k}=\"{html.escape(v)}\"' for k, v in attributes.items())}>{''.join(inner)}</{tag}>"


def leaf(tag: str, text: str, **attributes: str) -> str:
    return element(tag, html.escape(text, quote=False), **attributes)


def row(parts: list[str]) -> str:
    return parts[0] if len(parts) == 1 else element("mrow", *parts)


def scripted(base: str, sub: str | None, sup: str | None) -> str:
    """A base with what stands below and above it; sums and limits have these under and over them."""
    text = re.fullmatch(r"<m[oi][^>]*>([^<]*)</m[oi]>", base)
    under = bool(text and text[1] in BIG and text[1] not in "∫∮")
    names = ("munder", "mover", "munderover") if under else ("msub", "msup", "msubsup")
    if sub is not None and sup is not None:
        return element(names[2], base, sub, sup)
    return element(names[0], base, sub) if sub is not None else element(names[1], base, sup) if sup is not None else base


class Plain:
    """The plain notation: fractions by ``/``, scripts by ``_`` and ``^``, groups by brackets, words for signs."""

    OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "(:": "⟩", "{:": ""}, {")", "]", "}", ":)", ":}"}
    WORDS = FUNCTIONS + list(GREEK) + list(ACCENTS) + list(FONTS) + ["sqrt", "root", "frac", "text", "abs", "floor", "ceil", "norm", "sum", "prod", "int", "oint", "del", "grad", "in", "or", "and", "not", "if", "cdots", "ldots", "prop", "sub"]

    def __init__(self, text: str):
        self.tokens = list(self.split(text))
        self.at = 0

    def split(self, text: str):
        words = sorted({w for w in self.WORDS} | {s for s, _ in PLAIN_SIGNS}, key=len, reverse=True)
        at = 0
        while at < len(text):
            if text[at].isspace():
                at += 1
            elif text[at] == '"':
                stop = text.find('"', at + 1)
                stop = len(text) if stop < 0 else stop
                yield "text", text[at + 1 : stop]
                at = stop + 1
            elif m := re.match(r"\d+(?:\.\d+)?", text[at:]):
                yield "number", m[0]
                at += len(m[0])
            elif m := re.match(r"text\(([^()]*)\)", text[at:]):
                yield "text", m[1]
                at += len(m[0])
            elif m := re.match(r"\(:|\{:|:\)|:\}", text[at:]):
                yield "mark", m[0]
                at += 2
            else:
                word = next((w for w in words if text.startswith(w, at)), None)
                yield ("word", word) if word else ("mark", text[at])
                at += len(word or text[at])

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def expression(self, closing: bool = False) -> list[str]:
        out = []
        while self.at < len(self.tokens):
            kind, value = self.peek()
            if closing and kind == "mark" and value in self.CLOSE:
                break
            out.append(self.fraction())
        return out

    def fraction(self) -> str:
        top = self.script()
        while self.peek() == ("mark", "/"):
            self.at += 1
            top = element("mfrac", self.bare(top), self.bare(self.script()))
        return top

    def script(self) -> str:
        base, sub, sup = self.simple(), None, None
        while self.peek() in (("mark", "_"), ("mark", "^")):
            mark = self.peek()[1]
            self.at += 1
            inner = self.bare(self.simple())
            sub, sup = (inner, sup) if mark == "_" else (sub, inner)
        return scripted(base, sub, sup)

    @staticmethod
    def bare(part: str) -> str:
        """A group without the brackets that only hold it together."""
        m = re.fullmatch(r"<mrow><mo>[(\[{]</mo>(.*)<mo>[)\]}]</mo></mrow>", part, re.DOTALL)
        if m and m[1].count("<mrow><mo>(") == m[1].count("<mo>)</mo></mrow>"):
            return m[1] if len(re.findall(r"^<(\w+)[^>]*>.*</\1>$", m[1])) and m[1].count("<m") == 1 else element("mrow", m[1])
        return part

    def simple(self) -> str:
        if self.at >= len(self.tokens):
            return element("mrow")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return leaf("mn", value)
        if kind == "text":
            return leaf("mtext", value)
        if kind == "mark" and value in self.OPEN:
            inner = self.expression(True)
            close = self.peek()[1] if self.at < len(self.tokens) else ""
            self.at += 1
            matrix = self.matrix(inner, value, close)
            return matrix or element("mrow", leaf("mo", {"(:": "⟨", "{:": ""}.get(value, value)), *inner, leaf("mo", {":)": "⟩", ":}": ""}.get(close, close)))
        if kind == "mark":
            return leaf("mi", value) if value.isalpha() else leaf("mo", value)
        signs = dict(PLAIN_SIGNS)
        if value in signs:
            return leaf("mo", signs[value])
        if value in GREEK:
            return leaf("mi", GREEK[value])
        if value in FUNCTIONS:
            return leaf("mo" if value in BIG else "mi", value)
        if value == "sqrt":
            return element("msqrt", self.bare(self.simple()))
        if value in ("root", "frac"):
            first, second = self.bare(self.simple()), self.bare(self.simple())
            return element("mroot", second, first) if value == "root" else element("mfrac", first, second)
        if value in ("abs", "norm", "floor", "ceil"):
            a, b = {"abs": "||", "norm": "∥∥", "floor": "⌊⌋", "ceil": "⌈⌉"}[value]
            return element("mrow", leaf("mo", a), self.bare(self.simple()), leaf("mo", b))
        if value in ACCENTS:
            return element("mover", self.bare(self.simple()), leaf("mo", ACCENTS[value]))
        if value in FONTS:
            return element("mstyle", self.bare(self.simple()), mathvariant=FONTS[value])
        if value in ("and", "or", "if"):
            return leaf("mtext", value)
        return leaf("mo", {"del": "∂", "grad": "∇", "not": "¬", "sub": "⊂"}.get(value) or SIGNS.get(value, value))

    @staticmethod
    def matrix(inner: list[str], opens: str, closes: str) -> str | None:
        """Rows in brackets, parted by commas, inside brackets, are a matrix."""
        rows = [x for x in inner if x != leaf("mo", ",")]
        pattern = re.compile(r"<mrow><mo>([(\[])</mo>(.*)<mo>[)\]]</mo></mrow>", re.DOTALL)
        if len(rows) < 2 or len(inner) != 2 * len(rows) - 1 or not all(pattern.fullmatch(r) for r in rows):
            return None
        made = "".join(element("mtr", *(element("mtd", c) for c in pattern.fullmatch(r)[2].split(leaf("mo", ",")))) for r in rows)
        return element("mrow", leaf("mo", opens), element("mtable", made), leaf("mo", closes))


class Tex:
    """The TeX notation: commands, groups in braces, scripts, and environments of rows."""

    def __init__(self, text: str):
        self.tokens = re.findall(r"\\[a-zA-Z]+|\\.|\d+(?:\.\d+)?|[^\s]|\s+", text)
        self.at = 0

    def peek(self) -> str:
        while self.at < len(self.tokens) and self.tokens[self.at].isspace():
            self.at += 1
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        token = self.peek()
        self.at += 1
        return token

    def expression(self, ends: tuple[str, ...] = ()) -> list[str]:
        out = []
        while (token := self.peek()) and token not in ends:
            out.append(self.script())
        return out

    def group(self) -> str:
        """The next argument: a group, or one token."""
        if self.peek() == "{":
            self.take()
            inner = row(self.expression(("}",)) or [element("mrow")])
            self.take()
            return inner
        return self.simple()

    def raw(self) -> str:
        """The next group as it is written."""
        if self.peek() != "{":
            return self.take()
        self.take()
        held, depth = [], 1
        while self.at < len(self.tokens):
            token = self.tokens[self.at]
            self.at += 1
            depth += (token == "{") - (token == "}")
            if not depth:
                break
            held.append(token)
        return "".join(held)

    def script(self) -> str:
        base, sub, sup = self.simple(), None, None
        while self.peek() in ("_", "^", "'"):
            mark = self.take()
            if mark == "'":
                sup = leaf("mo", "′") if sup is None else element("mrow", sup, leaf("mo", "′"))
            else:
                inner = self.group()
                sub, sup = (inner, sup) if mark == "_" else (sub, inner)
        return scripted(base, sub, sup)

    def simple(self) -> str:
        token = self.take()
        if token == "{":
            inner = row(self.expression(("}",)) or [element("mrow")])
            self.take()
            return inner
        if token in ("_", "^"):
            self.at -= 1
            return element("mrow")
        if re.match(r"\d", token):
            return leaf("mn", token)
        if not token.startswith("\\"):
            return leaf("mi", token) if token.isalpha() else leaf("mo", token)
        return self.command(token[1:])

    def command(self, name: str) -> str:
        if name in GREEK or name.startswith("var") and name[3:] in GREEK:
            return leaf("mi", GREEK.get(name) or GREEK[name[3:]])
        if name in FUNCTIONS:
            return leaf("mo" if name in BIG else "mi", name)
        if name in ("frac", "dfrac", "tfrac"):
            return element("mfrac", self.group(), self.group())
        if name == "binom":
            return element("mrow", leaf("mo", "("), element("mfrac", self.group(), self.group(), linethickness="0"), leaf("mo", ")"))
        if name == "sqrt":
            if self.peek() == "[":
                self.take()
                index = row(self.expression(("]",)))
                self.take()
                return element("mroot", self.group(), index)
            return element("msqrt", self.group())
        if name in ("text", "mathrm", "mbox", "operatorname"):
            return leaf("mtext" if name in ("text", "mbox") else "mi", self.raw(), **({} if name in ("text", "mbox") else {"mathvariant": "normal"}))
        if name in FONTS:
            return element("mstyle", self.group(), mathvariant=FONTS[name])
        if name in ACCENTS:
            return element("mover", self.group(), leaf("mo", ACCENTS[name]), accent="true")
        if name == "underline":
            return element("munder", self.group(), leaf("mo", "_"))
        if name in ("left", "right"):
            mark = self.take()
            mark = {"\\{": "{", "\\}": "}", ".": "", "\\langle": "⟨", "\\rangle": "⟩", "\\|": "∥"}.get(mark, mark)
            if name == "right":
                return leaf("mo", mark)
            inner = self.expression(("\\right",))
            self.take()
            close = self.take()
            close = {"\\}": "}", "\\{": "{", ".": "", "\\rangle": "⟩", "\\langle": "⟨", "\\|": "∥"}.get(close, close)
            return element("mrow", leaf("mo", mark), *inner, leaf("mo", close))
        if name == "begin":
            return self.environment(self.raw())
        if name in ("quad", "qquad", ",", ";", ":", "!", " "):
            return f'<mspace width="{ {"quad": "1em", "qquad": "2em", ",": "0.167em", ":": "0.222em", ";": "0.278em", "!": "-0.167em", " ": "0.25em"}[name] }"/>'
        if name in ("langle", "rangle", "{", "}", "|"):
            return leaf("mo", {"langle": "⟨", "rangle": "⟩", "|": "∥"}.get(name, name))
        return leaf("mo", SIGNS[name]) if name in SIGNS else leaf("mtext", "\\" + name) if name.isalpha() else leaf("mo", name)

    def environment(self, name: str) -> str:
        if name == "array":
            self.raw()
        rows, cells = [], []
        while True:
            cells.append(row(self.expression(("&", "\\\\", "\\end")) or [element("mrow")]))
            token = self.take()
            if token == "&":
                continue
            rows.append(element("mtr", *(element("mtd", c) for c in cells)))
            cells = []
            if token != "\\\\":
                break
        self.raw()
        table = element("mtable", *rows)
        marks = {"pmatrix": "()", "bmatrix": "[]", "Bmatrix": "{}", "vmatrix": "||", "Vmatrix": "∥∥"}.get(name)
        if marks:
            return element("mrow", leaf("mo", marks[0]), table, leaf("mo", marks[1]))
        return element("mrow", leaf("mo", "{"), table) if name == "cases" else table


def math(parts: list[str], block: bool) -> str:
    return element("math", *parts, xmlns="http://www.w3.org/1998/Math/MathML", display="block" if block else "inline")


def plain_to_mathml(text: str, block: bool = False) -> str:
    return math(Plain(text).expression(), block)


def tex_to_mathml(text: str, block: bool = False) -> str:
    return math(Tex(text).expression(), block)


def from_plain(text, block: bool = False) -> Column:
    return kernel("string")(lambda t: plain_to_mathml(t, block))(text)


def from_tex(text, block: bool = False) -> Column:
    return kernel("string")(lambda t: tex_to_mathml(t, block))(text)


TREE = "array<struct<id:int,parent:int,depth:int,kind:string,text:string,attrs:map<string,string>>>"


@kernel(TREE)
def mathml_tree(text):
    """The elements of MathML in order, each with its parent; null if it is no well-formed XML."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return None
    out, todo = [], [(root, None, 0)]
    while todo:
        node, parent, depth = todo.pop()
        key = len(out)
        out.append({"id": key, "parent": parent, "depth": depth, "kind": node.tag.rpartition("}")[2], "text": (node.text or "").strip() or None, "attrs": list(node.attrib.items())})
        todo += [(child, key, depth + 1) for child in reversed(node)]
    return out


def formulas(html_text) -> Column:
    """Formulas between their marks in converted text (``\\\\$..\\\\$`` plain, ``\\\\(..\\\\)`` TeX) as MathML."""

    def made(text):
        text = re.sub(r"\\\$(.*?)\\\$", lambda m: plain_to_mathml(html.unescape(m[1])), text, flags=re.DOTALL)
        return re.sub(r"\\\((.*?)\\\)", lambda m: tex_to_mathml(html.unescape(m[1])), text, flags=re.DOTALL)

    t = F.col(html_text) if isinstance(html_text, str) else html_text
    return F.when(t.contains("\\$") | t.contains("\\("), kernel("string")(made)(t)).otherwise(t)
