"""Case mapping, case properties and line breaking by Unicode's rules.

Case is Java's full mapping, in expressions. Line breaking (UAX 14) is a
scan over the classes of a text's characters; the classes come from the
property tables of the ``regex`` library.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernel import kernel
from .text import col

#: What full case conversion leaves out of account around a letter, besides marks and formats.
CASE_IGNORABLE = r"[\p{Mn}\p{Me}\p{Cf}\p{Lm}\p{Sk}'­’.:·‘․‧︓﹒﹕＇．：]"


def upcase(x) -> Column:
    """Full mapping: one character may become several (ß, SS)."""
    return F.upper(col(x))


def downcase(x, final_sigma: bool = False) -> Column:
    """Full mapping. With ``final_sigma`` a capital sigma at a word's end becomes its final form, else always the plain one."""
    t = col(x)
    return F.lower(t) if final_sigma else F.lower(F.replace(t, F.lit("Σ"), F.lit("σ")))


def is_cased(x) -> Column:
    """Whether the first character is a cased letter: upper, lower or title case, by category or by the properties beyond it."""
    return F.substring(col(x), 1, 1).rlike(r"^[\p{IsUppercase}\p{IsLowercase}\p{Lt}]")


def is_case_ignorable(x) -> Column:
    return F.substring(col(x), 1, 1).rlike("^" + CASE_IGNORABLE)


#: Names of the classes that line breaking tells apart.
CLASSES = "BK CR LF CM NL SG WJ ZW GL SP ZWJ B2 BA BB HY CB CL CP EX IN NS OP QU IS NU PO PR SY AI AL CJ EB EM H2 H3 HL ID JL JV JT RI SA XX".split()


@lru_cache(1)
def _classes():
    import regex

    return [(c, regex.compile(rf"\p{{Line_Break={c}}}")) for c in CLASSES]


@lru_cache(1 << 16)
def line_break_class(c: str) -> str:
    """The class of a character, after the rule that resolves the ambiguous ones (a starter of small kana is NS, a mark of a complex script CM)."""
    found = next((name for name, pattern in _classes() if pattern.match(c)), "XX")
    if found in ("AI", "SG", "XX"):
        return "AL"
    if found == "SA":
        import unicodedata

        return "CM" if unicodedata.category(c) in ("Mn", "Mc") else "AL"
    return "NS" if found == "CJ" else found


def _wide(c: str) -> bool:
    import unicodedata

    return unicodedata.east_asian_width(c) in "FWH"


def break_offsets(text: str) -> list[tuple[int, bool]]:
    """(offset in characters, mandatory) of each place where a line may end, the end of the text included.

    Pairs of neighbouring classes decide, in the order of the rules; combining
    marks take the class of what they stand on.
    """
    out: list[tuple[int, bool]] = []
    if not text:
        return out
    kinds = [line_break_class(c) for c in text]
    base: list[str] = []  # classes with marks resolved
    glued: list[bool] = []  # whether the character belongs to the one before
    for k in kinds:
        joins = k in ("CM", "ZWJ") and base and base[-1] not in ("BK", "CR", "LF", "NL", "SP", "ZW")
        glued.append(bool(joins))
        base.append(base[-1] if joins else "AL" if k in ("CM", "ZWJ") else k)
    regional = 0
    before_space = base[0]  # the last class that is no space
    for i in range(1, len(text)):
        a, b = base[i - 1], base[i]
        if a != "SP":
            before_space = a
        if a == "RI" and not glued[i]:
            regional += 1
        elif a != "RI":
            regional = 0
        verdict = _between(text, kinds, base, glued, i, a, b, before_space, regional)
        if verdict:
            out.append((i, verdict == 2))
    out.append((len(text), kinds[-1] in ("BK", "CR", "LF", "NL")))
    return out


def _between(text, kinds, base, glued, i, a, b, held, regional) -> int:
    """0: no break between i - 1 and i, 1: may break, 2: must."""
    if a == "BK" or a in ("LF", "NL") or a == "CR" and b != "LF":
        return 2
    if a == "CR" or b in ("BK", "CR", "LF", "NL"):
        return 0
    if b in ("SP", "ZW"):
        return 0
    if held == "ZW":
        return 1
    if kinds[i - 1] == "ZWJ" or glued[i]:
        return 0
    if b == "WJ" or a == "WJ" or a == "GL":
        return 0
    if b == "GL" and a not in ("SP", "BA", "HY"):
        return 0
    if b in ("CL", "CP", "EX", "IS", "SY"):
        return 0
    if held == "OP":
        return 0
    if held == "QU" and b == "OP" or held in ("CL", "CP") and b == "NS" or held == "B2" and b == "B2":
        return 0
    if a == "SP":
        return 1
    if a == "QU" or b == "QU":
        return 0
    if a == "CB" or b == "CB":
        return 1
    if b in ("BA", "HY", "NS") or a == "BB":
        return 0
    if a in ("HY", "BA") and i > 1 and base[i - 2] == "HL" and b != "HL" or a == "SY" and b == "HL":
        return 0
    if b == "IN":
        return 0
    letters = ("AL", "HL")
    if a in letters and b == "NU" or a == "NU" and b in letters:
        return 0
    if a == "PR" and b in ("ID", "EB", "EM") or a in ("ID", "EB", "EM") and b == "PO":
        return 0
    if a in ("PR", "PO") and b in letters or a in letters and b in ("PR", "PO"):
        return 0
    if (a, b) in {("CL", "PO"), ("CP", "PO"), ("CL", "PR"), ("CP", "PR"), ("NU", "PO"), ("NU", "PR"), ("PO", "OP"), ("PO", "NU"), ("PR", "OP"), ("PR", "NU"), ("HY", "NU"), ("IS", "NU"), ("NU", "NU"), ("SY", "NU")}:
        return 0
    if a == "JL" and b in ("JL", "JV", "H2", "H3") or a in ("JV", "H2") and b in ("JV", "JT") or a in ("JT", "H3") and b == "JT":
        return 0
    hangul = ("JL", "JV", "JT", "H2", "H3")
    if a in hangul and b == "PO" or a == "PR" and b in hangul:
        return 0
    if a in letters and b in letters or a == "IS" and b in letters:
        return 0
    if (a in letters or a == "NU") and b == "OP" and not _wide(text[i]) or a == "CP" and not _wide(text[i - 1]) and (b in letters or b == "NU"):
        return 0
    if a == "RI" and b == "RI" and regional % 2:
        return 0
    if a == "EB" and b == "EM":
        return 0
    return 1


@kernel("array<struct<offset:int,mandatory:boolean>>")
def line_breaks(text):
    return [{"offset": o, "mandatory": m} for o, m in break_offsets(text)]


@kernel("string")
def break_class(c):
    """The line-breaking class of the first character; null for an empty text."""
    return line_break_class(c[0]) if c else None


