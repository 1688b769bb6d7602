"""Markup whose tags cross is put right: what crosses an end is closed before it and opened again after it."""

from __future__ import annotations

import re

from quire.functions.kernel import kernel

#: Elements that have no end.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*?)(/?)>", re.DOTALL)


def balanced_text(text: str, reopen: frozenset[str] = frozenset({"a", "b", "code", "em", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u"})) -> str:
    """The text with its tags nested: an end closes what was opened since (opened again after it, if it is one of ``reopen``), an end of nothing goes, and what is open at the end is closed."""
    out, at, opened = [], 0, []
    for m in TAG.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name or m[4] or name in VOID:
            out.append(m[0])
        elif not m[1]:
            opened.append((name, m[0]))
            out.append(m[0])
        elif any(n == name for n, _ in opened):
            crossed = []
            while opened[-1][0] != name:
                crossed.append(opened.pop())
                out.append(f"</{crossed[-1][0]}>")
            opened.pop()
            out.append(m[0])
            for inner in reversed([x for x in crossed if x[0] in reopen]):
                # an id stands once only
                again = re.sub(r"\s+id=(?:\"[^\"]*\"|'[^']*')", "", inner[1])
                opened.append((inner[0], again))
                out.append(again)
    out.append(text[at:])
    return "".join(out) + "".join(f"</{n}>" for n, _ in reversed(opened))


@kernel("string")
def balanced(text):
    return balanced_text(text)
