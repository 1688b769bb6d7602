"""Extensions: named hooks that a conversion runs, and converters by backend.

Hooks over whole tables take and return a DataFrame. Hooks over one thing (a
macro, a block, a document's head) are plain Python functions; they run in
Arrow batches. Functions of macros and blocks return markup, made by the
helpers below or by hand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.kernel import kernel
from quire.functions.text import let

KINDS = ("preprocessor", "tree_processor", "postprocessor", "include_processor", "docinfo_processor", "block_processor", "block_macro", "inline_macro")
LOCATIONS = ("head", "header", "footer")


def paragraph(text: str, *roles: str) -> str:
    return (f"[.{'.'.join(roles)}]\n" if roles else "") + text.strip() + "\n"


def html(markup: str) -> str:
    """Markup that is passed through as it is."""
    return f"++++\n{markup}\n++++\n"


def listing(code: str, language: str | None = None) -> str:
    fence = "-" * max(4, 1 + max((len(x) for x in code.split("\n") if x and not x.strip("-")), default=0))
    return (f"[source,{language}]\n" if language else "") + f"{fence}\n{code}\n{fence}\n"


def image(target: str, alt: str = "") -> str:
    return f"image::{target}[{alt}]\n"


@dataclass
class Registry:
    """Hooks by kind, each with a name, in order."""

    hooks: dict[str, list[tuple[str, Callable]]] = field(default_factory=lambda: {k: [] for k in KINDS})

    def register(self, kind: str, name: str, hook: Callable, prefer: bool = False) -> "Registry":
        if kind not in self.hooks:
            raise ValueError(f"unknown kind of extension: {kind}")
        held = self.hooks[kind]
        held.insert(0, (name, hook)) if prefer else held.append((name, hook))
        return self

    def unregister(self, name: str) -> None:
        for held in self.hooks.values():
            held[:] = [x for x in held if x[0] != name]

    def copy(self) -> "Registry":
        """A snapshot, which later changes leave alone."""
        return Registry({k: list(v) for k, v in self.hooks.items()})

    def apply(self, kind: str, df: DataFrame) -> DataFrame:
        for _, hook in self.hooks[kind]:
            df = hook(df)
        return df

    def inline(self, text: Column) -> Column:
        """Each registered inline macro replaced: ``name:target[text]``, or what a pattern (a name that begins with ``^`` or holds a bracket) matches, by what its hook makes of two Columns: target and text, or the pattern's first two groups."""
        for name, hook in self.hooks["inline_macro"]:
            pattern = name if "(" in name else rf"(?<![\w\\]){name}:(?!:)([^\s\[]*)\[((?:[^\]\\]|\\.)*+)\]"
            text = let(text, _replaced(pattern, hook))
        return text

    def blocks(self, nodes: DataFrame) -> DataFrame:
        """Block macros and custom blocks replaced by what their hooks make: markup, parsed where it stands."""
        macros, styles = dict(self.hooks["block_macro"]), dict(self.hooks["block_processor"])
        if not macros and not styles:
            return nodes
        attrs = lambda a: dict(a or [])

        def made(context, style, source, given):
            if context == "custom_macro" and style in macros:
                a = attrs(given)
                return macros[style](a.get("target", ""), a)
            if style in styles:
                return styles[style](source or "", attrs(given))
            return None

        text = kernel("string")(made)("context", F.coalesce("style", F.lit("")), "source", "attrs")
        asked = F.when((F.col("context") == "custom_macro") | F.col("style").isin(list(styles)), text)
        from quire.operators import blocks as parser

        marked = nodes.withColumn("made", asked)
        new = marked.where("made IS NOT NULL").select(F.concat_ws("\x01", "doc_id", F.col("node_id").cast("string")).alias("doc_id"), F.col("made").alias("text"))
        inner = parser.parse(new).where("parent_id IS NOT NULL")
        place = marked.where("made IS NOT NULL").select(F.concat_ws("\x01", "doc_id", F.col("node_id").cast("string")).alias("m_key"), F.col("doc_id").alias("m_doc"), F.col("node_id").alias("m_node"), F.col("ord").alias("m_ord"), F.col("depth").alias("m_depth"), F.col("line_no").alias("m_line"))
        # ids of the new nodes come after all others of the document, a range for each block
        top = nodes.groupBy(F.col("doc_id").alias("t_doc")).agg((F.max("node_id") + 1).alias("top"))
        size = F.lit(100_000)
        joined = inner.join(place, F.col("doc_id") == F.col("m_key")).join(top, F.col("m_doc") == F.col("t_doc"))
        number = F.col("top") + F.col("m_node") * size + F.col("node_id")
        parent = F.when(F.col("parent_id") == 0, F.col("m_node")).otherwise(F.col("top") + F.col("m_node") * size + F.col("parent_id"))
        values = {"doc_id": F.col("m_doc"), "node_id": number.cast("int"), "parent_id": parent.cast("int"), "ord": F.concat("m_ord", "ord"), "depth": F.col("m_depth") + F.col("depth"), "line_no": F.col("m_line")}
        below = joined.select(*[values.get(c, F.col(c)).alias(c) for c in nodes.columns])
        gone = F.col("made").isNotNull()
        kept = marked.withColumns({"context": F.when(gone, "open_plain").otherwise(F.col("context")), "source": F.when(gone, F.lit(None)).otherwise(F.col("source"))}).select(*nodes.columns)
        return kept.unionByName(below)

    def docinfo(self, location: str) -> str:
        """What the docinfo hooks of a place (head, header or footer) say, a line each: a hook is a function of the place that gives text or None."""
        return "".join(f"{x}\n" for x in (hook(location) for _, hook in self.hooks["docinfo_processor"]) if x)

    def parse(self, docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
        """Nodes of documents (doc_id, text), after preprocessors, includes (``files``: path, line_no, text; what it lacks is asked of the include hooks), blocks, inline macros and tree processors."""
        from quire.operators import blocks

        given = self.apply("preprocessor", docs)
        if files is not None or self.hooks["include_processor"]:
            given = self._included(given, files)
        nodes = self.blocks(blocks.parse(given, macros=tuple(n for n, _ in self.hooks["block_macro"])))
        if self.hooks["inline_macro"]:
            verbatim = F.col("context").isin("listing", "literal", "pass", "stem", "table")
            nodes = nodes.withColumn("source", F.when(verbatim, F.col("source")).otherwise(self.inline(F.col("source"))))
        return self.apply("tree_processor", nodes)

    def _included(self, docs: DataFrame, files: DataFrame | None) -> DataFrame:
        from quire.operators import preprocess

        rows = preprocess.lines(docs)
        files = files if files is not None else docs.sparkSession.createDataFrame([], "path string, line_no int, text string")
        out = preprocess.expand_includes(rows, files, resolver=self._resolver if self.hooks["include_processor"] else None)
        return out.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))

    def _resolver(self, targets: DataFrame) -> DataFrame:
        """path, line_no, text of targets, by the first include hook (a function of the target) that gives a text for it."""
        hooks = [h for _, h in self.hooks["include_processor"]]
        found = targets.select(F.col("target").alias("path"), kernel("string")(lambda t: next((x for x in (h(t) for h in hooks) if x is not None), None))("target").alias("text")).where("text IS NOT NULL")
        return found.select("path", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).cast("int").alias("line_no"), "text")

    def convert(self, docs: DataFrame, files: DataFrame | None = None, backend: str = "html5", **options) -> DataFrame:
        """doc_id and the converted document, with all hooks."""
        if backend == "html5":
            options = {place: self.docinfo(place) for place in LOCATIONS} | options if self.hooks["docinfo_processor"] else options
        return self.apply("postprocessor", convert(self.parse(docs, files), backend, **options))


def _replaced(pattern: str, hook: Callable):
    def applied(t: Column) -> Column:
        made = lambda ms: F.transform(ms, lambda m: hook(F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)))
        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda ms: F.array_join(F.zip_with(F.split(t, pattern), made(ms), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))

    return applied


#: Groups of hooks by name, for all conversions that ask for them.
GROUPS: dict[str, Callable[[Registry], None]] = {}


def register_group(name: str, group: Callable[[Registry], None]) -> None:
    GROUPS[name] = group


def unregister_group(name: str) -> None:
    GROUPS.pop(name, None)


def activated(registry: Registry | None = None) -> Registry:
    """A registry with the global groups' hooks after its own."""
    out = registry.copy() if registry else Registry()
    for group in GROUPS.values():
        group(out)
    return out


@dataclass(frozen=True)
class Extension:
    """One typed extension; ``install`` puts it into a registry."""

    name: str
    hook: Callable

    def install(self, registry: Registry, prefer: bool = False) -> Registry:
        return registry.register(self.kind, self.name, self.hook, prefer)


class Preprocessor(Extension):
    """``documents -> documents`` (doc_id, text), before anything is parsed."""

    kind = "preprocessor"


class TreeProcessor(Extension):
    """``nodes -> nodes``."""

    kind = "tree_processor"


class Postprocessor(Extension):
    """``converted -> converted``."""

    kind = "postprocessor"


class Docinfo(Extension):
    """``place -> text or None``."""

    kind = "docinfo_processor"


class IncludeResolver(Extension):
    """``target -> text or None``."""

    kind = "include_processor"


class BlockMacro(Extension):
    """``target, attributes -> markup`` for ``name::target[attributes]``."""

    kind = "block_macro"


class InlineMacro(Extension):
    """``target column, text column -> column`` for ``name:target[text]`` or a pattern."""

    kind = "inline_macro"


class CustomBlock(Extension):
    """``source, attributes -> markup`` for blocks and paragraphs of that style."""

    kind = "block_processor"


def _html(nodes: DataFrame, **options) -> DataFrame:
    from quire.plans import pages, render

    return pages.to_page(nodes, **options) if options else render.to_html(nodes)


def _docbook(nodes: DataFrame, **options) -> DataFrame:
    from quire.plans import docbook

    return docbook.to_docbook(nodes)


def _manpage(nodes: DataFrame, **options) -> DataFrame:
    from quire.plans import manpage

    return manpage.to_manpage(nodes, **options)


def _epub(nodes: DataFrame, **options) -> DataFrame:
    from quire.plans import epub

    return epub.to_epub(nodes, **options)


def _pdf(nodes: DataFrame, **options) -> DataFrame:
    from quire.functions import pdf

    return pdf.to_pdf(nodes)


#: Converters by backend: functions of nodes and options.
BACKENDS: dict[str, Callable[..., DataFrame]] = {"html5": _html, "docbook5": _docbook, "manpage": _manpage, "epub3": _epub, "pdf": _pdf}


def register_backend(name: str, converter: Callable[..., DataFrame]) -> None:
    BACKENDS[name] = converter


def convert(nodes: DataFrame, backend: str = "html5", **options) -> DataFrame:
    if backend not in BACKENDS:
        raise ValueError(f"no converter for {backend}")
    return BACKENDS[backend](nodes, **options)


def highlighted_listings(nodes: DataFrame, highlighter: Callable[[str, str], str]) -> DataFrame:
    """Nodes whose source listings are passed through as what a highlighter (``code, language -> markup``) makes of them, in the usual boxes."""
    language = F.coalesce(F.try_element_at("attrs", F.lit("language")), F.try_element_at("attrs", F.lit("2")), F.lit(""))
    mine = (F.col("context") == "listing") & (F.col("style") == "source")
    body = kernel("string")(highlighter)("source", language)
    box = F.concat(F.lit('<div class="listingblock">\n<div class="content">\n<pre class="highlight"><code class="language-'), language, F.lit('">'), body, F.lit("</code></pre>\n</div>\n</div>\n"))
    return nodes.withColumns({"source": F.when(mine, box).otherwise(F.col("source")), "context": F.when(mine, "pass").otherwise(F.col("context"))})


def fetched(targets: DataFrame, fetch: Callable[[str], str | None], allowed: bool = False) -> DataFrame:
    """uri, body of remote targets (uri), each distinct one asked once of ``fetch`` (null: not found). Not allowed unless said so: then there are no rows."""
    asked = targets.select("uri").distinct()
    if not allowed:
        return asked.limit(0).select("uri", F.lit(None).cast("string").alias("body"))
    return asked.select("uri", kernel("string")(fetch)("uri").alias("body"))


def cached(targets: DataFrame, cache: DataFrame) -> DataFrame:
    """uri, body of remote targets that a table of fetched ones (uri, body) holds, null for the rest."""
    return targets.select("uri").distinct().join(cache.select(F.col("uri").alias("c_uri"), "body"), F.col("uri") == F.col("c_uri"), "left").drop("c_uri")


def macros_in(text: Column) -> Column:
    """Structs of name, target and text of the inline macros in a text, whatever their names."""
    pattern = r"(?<![\w\\])([a-z][\w-]*):(?!:)([^\s\[]*)\[((?:[^\]\\]|\\.)*+)\]"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("name"), F.regexp_extract(m, pattern, 2).alias("target"), F.regexp_extract(m, pattern, 3).alias("text")))

