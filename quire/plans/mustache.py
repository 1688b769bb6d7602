"""Templates for kinds of nodes: logic-less, with sections, inverted sections, comments and partials.

A template says what a node becomes; converters are lists of them, in which
the first that has one for a kind of node wins. Rendered by templates or not,
nodes are put together like any other.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.kernel import kernel
from quire.operators import select
from quire.plans import render

#: Kinds of nodes that have none below them.
LEAVES = {"paragraph", "listing", "literal", "pass", "stem", "verse", "image", "audio", "video", "thematic_break", "page_break", "floating_title", "dlist_term"}


def parse_template(text: str) -> list:
    """A template as a tree: strings, and (kind, name, parts) of its tags. A tag of a section, comment or partial that stands alone takes its line along."""
    root: list = []
    stack = [("", root)]
    at = 0
    while True:
        start = text.find("{{", at)
        if start < 0:
            stack[-1][1].append(text[at:])
            break
        raw = text.startswith("{{{", start)
        stop = text.find("}}}" if raw else "}}", start)
        if stop < 0:
            raise ValueError("a tag is not closed")
        body = text[start + (3 if raw else 2) : stop].strip()
        after = stop + (3 if raw else 2)
        kind = "&" if raw else body[:1] if body[:1] in "#^/!>&" else ""
        name = body if raw or not kind else body[1:].strip()
        before = text[at:start]
        if kind in ("#", "^", "/", "!", ">") and kind:
            line, rest = before.rpartition("\n")[2], text[after:].partition("\n")
            if not line.strip() and not rest[0].strip() and (rest[1] or not text[after:].strip()) and (start == 0 or "\n" in before or at == 0 or text[at - 1 : at] == "\n"):
                before, after = before[: len(before) - len(line)], after + len(rest[0]) + len(rest[1])
        stack[-1][1].append(before)
        if kind in ("#", "^"):
            parts: list = []
            stack[-1][1].append((kind, name, parts))
            stack.append((name, parts))
        elif kind == "/":
            if len(stack) < 2 or stack[-1][0] != name:
                raise ValueError(f"{name} closes nothing")
            stack.pop()
        elif kind != "!":
            stack[-1][1].append((kind, name, []))
        at = after
    if len(stack) > 1:
        raise ValueError(f"{stack[-1][0]} is not closed")
    return root


def _value(name: str, scopes: list):
    if name == ".":
        return scopes[-1]
    head, *rest = name.split(".")
    for scope in reversed(scopes):
        if isinstance(scope, dict) and head in scope:
            value = scope[head]
            for part in rest:
                value = value.get(part) if isinstance(value, dict) else None
            return value
    return None


def fill(parts: list, scopes: list, partials: dict[str, list] | None = None, depth: int = 0) -> str:
    """A parsed template with values of the innermost scope that has them."""
    out = []
    for part in parts:
        if isinstance(part, str):
            out.append(part)
            continue
        kind, name, inner = part
        if kind == ">":
            if depth > 64:
                raise ValueError("partials nest without end")
            out.append(fill((partials or {}).get(name, []), scopes, partials, depth + 1))
            continue
        value = _value(name, scopes)
        if kind == "#":
            for scope in value if isinstance(value, list) else [value] if value not in (None, False, "") else []:
                out.append(fill(inner, [*scopes, scope], partials, depth))
        elif kind == "^":
            if value in (None, False, "", []):
                out.append(fill(inner, scopes, partials, depth))
        elif value is not None:
            text = str(value)
            out.append(text if kind == "&" else html.escape(text))
    return "".join(out)


def render_template(template: str, values: Column, partials: dict[str, str] | None = None) -> Column:
    """A template filled with a row's values: a struct, map or JSON text."""
    parsed, more = parse_template(template), {k: parse_template(v) for k, v in (partials or {}).items()}
    return kernel("string")(lambda v: fill(parsed, [json.loads(v) if isinstance(v, str) else v], more))(F.to_json(values) if not isinstance(values, str) else values)


class Converter:
    """Templates by kind of node (its context, or context and style as ``listing:source``). In them, ``content`` stands for what is below the node and ``text``, ``raw``, ``title_html``, ``id``, ``roles``, ``attrs`` and the rest for its own."""

    def __init__(self, templates: dict[str, str], partials: dict[str, str] | None = None):
        self.templates, self.partials = templates, partials

    def column(self) -> Column:
        """What the templates make of a node, null where there is none for it."""
        given = F.to_json(F.struct("context", "style", "level", "id", F.col("title_html").alias("title"), "text", "raw", F.array_join("roles", " ").alias("role"), "roles", "attrs", "marker", F.lit(render.HERE).alias("content")))
        out = F.lit(None).cast("string")
        for name, template in sorted(self.templates.items(), key=lambda x: ":" in x[0]):
            context, _, style = name.partition(":")
            mine = (F.col("context") == context) & (F.col("style") == style) if style else F.col("context") == context
            out = F.when(mine, kernel("string")(_filler(template, self.partials))(given)).otherwise(out)
        return out


def _filler(template: str, partials: dict[str, str] | None):
    parsed, more = parse_template(template), {k: parse_template(v) for k, v in (partials or {}).items()}
    return lambda v: fill(parsed, [json.loads(v)], more)


def composite(*columns: Column) -> Column:
    """The first converter's result that is not null."""
    return F.coalesce(*columns)


def to_html(nodes: DataFrame, *converters, override=None) -> DataFrame:
    """doc_id, html: by the first converter that has a template for a node, else as usual. ``override(node columns, usual)`` may give another Column for some nodes (null: as usual)."""
    ready = render.ready(nodes)
    usual = render.html(F.lit(render.HERE))
    made = composite(*[c.column() for c in converters], *([override(F, usual)] if override else []), usual)
    out = ready.withColumn("made", made)
    # what a template does not let in is left out, with all below it
    closed = [n.partition(":")[0] for c in converters for n, t in c.templates.items() if "content" not in t]
    parents = [n for n in closed if n not in LEAVES]
    if parents:
        out = select.pruned(out, out.where(F.col("context").isin(parents) & ~F.col("made").contains(render.HERE)))
    return render.assemble(out.select("doc_id", "ord", "made"), "html")
