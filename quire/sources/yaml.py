"""The part of YAML 1.1 that configuration files use: mappings, lists, scalars, flow collections, block texts and comments; anchors and tags are not read."""

from __future__ import annotations

import re

#: Words that are truth values or nothing.
TRUE, FALSE, NOTHING = {"true", "yes", "on"}, {"false", "no", "off"}, {"", "~", "null"}


def scalar(text: str):
    """A plain or quoted scalar's value: numbers (decimal, octal, hexadecimal, binary, of base sixty), truth values, nothing, or text."""
    t = text.strip()
    if len(t) > 1 and t[0] == t[-1] == '"':
        return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], chr(int(m[1][1:], 16)) if m[1][0] in "ux" and len(m[1]) > 1 else m[1]), t[1:-1])
    if len(t) > 1 and t[0] == t[-1] == "'":
        return t[1:-1].replace("''", "'")
    low = t.lower()
    if low in NOTHING:
        return None
    if low in TRUE or low in FALSE:
        return low in TRUE
    n = low.replace("_", "")
    for pattern, base in ((r"[+-]?0x[0-9a-f]+", 16), (r"[+-]?0b[01]+", 2), (r"[+-]?0[0-7]+", 8), (r"[+-]?(?:0|[1-9]\d*)", 10)):
        if re.fullmatch(pattern, n):
            return int(n.replace("0x", "").replace("0b", ""), base)
    if re.fullmatch(r"[+-]?[1-9]\d*(?::[0-5]?\d)+", n):
        value = 0
        for part in n.lstrip("+-").split(":"):
            value = value * 60 + int(part)
        return -value if n[0] == "-" else value
    if re.fullmatch(r"[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:e[+-]?\d+)?", n):
        return float(n)
    return t


def _flow(text: str, at: int = 0):
    """A flow collection or scalar from ``at``: (value, where it ends)."""
    while at < len(text) and text[at] in " \n":
        at += 1
    if at < len(text) and text[at] in "[{":
        close, mapping, out, at = {"[": "]", "{": "}"}[text[at]], text[at] == "{", [], at + 1
        while True:
            while at < len(text) and text[at] in " \n,":
                at += 1
            if at >= len(text):
                raise ValueError("a flow collection is not closed")
            if text[at] == close:
                return (dict(out) if mapping else out), at + 1
            value, at = _flow(text, at)
            if mapping:
                while at < len(text) and text[at] in " :":
                    at += 1
                item, at = _flow(text, at) if at < len(text) and text[at] not in ",}" else (None, at)
                out.append((value, item))
            else:
                out.append(value)
    if at < len(text) and text[at] in "\"'":
        quote, stop = text[at], at + 1
        while stop < len(text) and (text[stop] != quote or quote == "'" and text[stop + 1 : stop + 2] == "'" or quote == '"' and text[stop - 1] == "\\"):
            stop += 2 if quote == "'" and text[stop : stop + 2] == "''" else 1
        return scalar(text[at : stop + 1]), stop + 1
    m = re.compile(r"[^,\[\]{}:]*(?::(?! )[^,\[\]{}:]*)*").match(text, at)
    return scalar(m[0]), m.end()


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " [{,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


KEY = re.compile(r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},#&*!|>'"%@`-][^:#]*?|-[^\s:][^:]*?|[^\s:]+?(?::[^\s:]+)*)\s*:(?:\s+(.*))?$""")


def load(text: str):
    """The value of a document."""
    lines = [(len(x) - len(x.lstrip(" ")), x) for x in text.replace("\t", "    ").split("\n") if not x.startswith(("---", "...", "%"))]
    value, _ = _block(lines, 0, 0)
    return value


def _skip(lines, at):
    while at < len(lines) and not _uncommented(lines[at][1]).strip():
        at += 1
    return at


def _block(lines, at, indent):
    at = _skip(lines, at)
    if at >= len(lines) or lines[at][0] < indent:
        return None, at
    indent = lines[at][0]
    body = _uncommented(lines[at][1]).strip()
    if body == "-" or body.startswith("- "):
        out = []
        while at < len(lines) and lines[at][0] == indent and (_uncommented(lines[at][1]).strip() + " ").startswith("- "):
            rest = _uncommented(lines[at][1]).strip()[1:].lstrip()
            if not rest:
                value, at = _block(lines, at + 1, indent + 1)
            elif KEY.match(rest) and rest[0] not in "\"'[{" or rest.startswith("- "):
                inner = indent + len(lines[at][1].strip()) - len(lines[at][1].strip()[1:].lstrip())
                lines[at] = (inner, " " * inner + rest)
                value, at = _block(lines, at, inner)
            else:
                value, at = _value(lines, at, rest, indent)
            out.append(value)
            at = _skip(lines, at)
        return out, at
    if not KEY.match(body):
        return _value(lines, at, body, indent - 1)
    out = {}
    while at < len(lines) and lines[at][0] == indent:
        m = KEY.match(_uncommented(lines[at][1]).strip())
        if not m:
            raise ValueError(f"no key: {lines[at][1]}")
        key, rest = scalar(m[1]), (m[2] or "").strip()
        if rest:
            out[key], at = _value(lines, at, rest, indent)
        else:
            at = _skip(lines, at + 1)
            # a list may stand as far out as its key
            deeper = at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].strip().startswith("- "))
            out[key], at = _block(lines, at, lines[at][0]) if deeper else (None, at)
        at = _skip(lines, at)
    return out, at


def _value(lines, at, first, indent):
    """A value that begins on a line: a block text, a flow collection (over lines if need be), or a scalar with the lines that continue it."""
    if first[0] in "|>":
        rows, stop = [], at + 1
        while stop < len(lines) and (not lines[stop][1].strip() or lines[stop][0] > indent):
            rows.append(lines[stop])
            stop += 1
        margin = min((n for n, x in rows if x.strip()), default=0)
        body = [x[margin:].rstrip() if x.strip() else "" for _, x in rows]
        while body and not body[-1] and "+" not in first:
            body.pop()
        text = "\n".join(body) if first[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(body))
        return text + ("" if "-" in first or not body else "\n"), stop
    if first[0] in "[{":
        held, stop = first, at + 1
        while True:
            try:
                return _flow(held)[0], stop
            except ValueError:
                if stop >= len(lines):
                    raise
                held, stop = held + " " + _uncommented(lines[stop][1]).strip(), stop + 1
    stop = at + 1
    while first[0] not in "\"'" and stop < len(lines) and lines[stop][1].strip() and lines[stop][0] > indent and not KEY.match(_uncommented(lines[stop][1]).strip()) and not lines[stop][1].strip().startswith("- "):
        first, stop = f"{first} {_uncommented(lines[stop][1]).strip()}", stop + 1
    return scalar(first), stop


def resolved_theme(theme: dict) -> dict[str, object]:
    """A theme's settings by flat names (``base_font_size``): ``$name`` stands for another setting, ``extends`` for a map that is read first, and sums of numbers are worked out, as are sizes in points, millimetres, centimetres and inches."""
    flat: dict[str, object] = {}

    def enter(prefix: str, value) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                enter(f"{prefix}_{k}" if prefix else str(k), v)
        else:
            flat[prefix.replace("-", "_")] = value

    base = theme.get("extends")
    if isinstance(base, dict):
        enter("", base)
    enter("", {k: v for k, v in theme.items() if k != "extends"})

    def value(name: str, open_names: tuple = ()):
        if name in open_names:
            raise ValueError(f"{name} refers to itself")
        return evaluated(flat.get(name), (*open_names, name))

    def evaluated(v, open_names):
        if isinstance(v, list):
            return [evaluated(x, open_names) for x in v]
        if not isinstance(v, str):
            return v
        whole = re.fullmatch(r"\$([\w-]+)", v.strip())
        if whole:
            return value(whole[1].replace("-", "_"), open_names)
        text = re.sub(r"\$([\w-]+)", lambda m: str(value(m[1].replace("-", "_"), open_names)), v)
        text = re.sub(r"(\d+(?:\.\d+)?)(mm|cm|in|pt|px)\b", lambda m: str(float(m[1]) * {"mm": 72 / 25.4, "cm": 72 / 2.54, "in": 72.0, "pt": 1.0, "px": 0.75}[m[2]]), text)
        return calculated(text)

    return {k: value(k) for k in flat}


def calculated(text: str):
    """The value of a sum, product or quotient of numbers (blanks around the marks), with round, floor and ceil; other texts as they are."""
    import math

    m = re.fullmatch(r"(round|floor|ceil)\((.*)\)", text.strip())
    if m:
        inner = calculated(m[2])
        return {"round": round, "floor": math.floor, "ceil": math.ceil}[m[1]](inner) if isinstance(inner, (int, float)) else text
    if not re.fullmatch(r"\s*-?\d+(?:\.\d+)?(?:\s+[*/+-]\s+-?\d+(?:\.\d+)?)*\s*", text):
        return text
    tokens = text.split()
    terms: list[float] = [float(tokens[0])]
    for mark, number in zip(tokens[1::2], tokens[2::2], strict=True):
        n = float(number)
        if mark in "*/":
            terms[-1] = terms[-1] * n if mark == "*" else terms[-1] / n
        else:
            terms.append(n if mark == "+" else -n)
    out = sum(terms)
    return int(out) if out == int(out) else round(out, 6)
