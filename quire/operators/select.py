"""Selection over the node table: by kind, style, role and id, by subtree, by neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find_by(nodes: DataFrame, context: str | None = None, style: str | None = None, role: str | None = None, id: str | None = None) -> DataFrame:  # noqa: A002
    """Nodes that match every given condition, to be ordered by doc_id and ord; with an id, the first match of each document."""
    out = nodes
    if context is not None:
        out = out.where(F.col("context") == context)
    if style is not None:
        out = out.where(F.col("style") == style)
    if role is not None:
        out = out.where(F.array_contains("roles", role))
    if id is not None:
        out = out.where(F.col("id") == id)
        out = out.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where("nth = 1").drop("nth")
    return out


def _prefixes(ord_: Column) -> Column:
    """All proper prefixes of a path, as text."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(ord_) - 1, F.lit(0))), lambda k: F.array_join(F.slice(ord_, 1, k).cast("array<string>"), "."))


def descendants(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Nodes below the nodes ``of`` (doc_id, ord), these excluded: an equi-join on path prefixes, not a range join."""
    tops = of.select(F.col("doc_id").alias("t_doc"), F.array_join(F.col("ord").cast("array<string>"), ".").alias("t_path")).distinct()
    below = nodes.where(F.size("ord") > 0).withColumn("above", F.explode(_prefixes(F.col("ord"))))
    return below.join(tops, (F.col("doc_id") == F.col("t_doc")) & (F.col("above") == F.col("t_path")), "left_semi").drop("above").dropDuplicates(["doc_id", "node_id"])


def pruned(nodes: DataFrame, at: DataFrame, keep_top: bool = True) -> DataFrame:
    """Without what is below the nodes ``at`` (prune), and with ``keep_top`` false without these too (reject)."""
    out = nodes.join(descendants(nodes, at).select(F.col("doc_id").alias("d_doc"), F.col("node_id").alias("d_node")), (F.col("doc_id") == F.col("d_doc")) & (F.col("node_id") == F.col("d_node")), "left_anti")
    if not keep_top:
        out = out.join(at.select(F.col("doc_id").alias("r_doc"), F.col("node_id").alias("r_node")), (F.col("doc_id") == F.col("r_doc")) & (F.col("node_id") == F.col("r_node")), "left_anti")
    return out


def next_adjacent(nodes: DataFrame) -> DataFrame:
    """Adds next_id: the next sibling, else the parent's next, and so on: in document order, the next node that is not below this one. One window per depth that occurs."""
    deepest = nodes.agg(F.max("depth")).head()[0] or 0
    after = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    picks = [F.when(F.col("depth") == d, F.first(F.when(F.col("depth") <= d, F.struct("depth", "node_id")), True).over(after)["node_id"]) for d in range(1, deepest + 1)]
    return nodes.withColumn("next_id", F.coalesce(*picks) if picks else F.lit(None).cast("int"))


def attribute(name: str, default: str | None = None, fallback: str | None = None) -> Column:
    """An attribute of the node, else of its document (``doc_attrs``) by the fallback name, else the default."""
    out = [F.try_element_at("attrs", F.lit(name))]
    if fallback:
        out.append(F.try_element_at("doc_attrs", F.lit(fallback)))
    return F.coalesce(*out, F.lit(default))


def with_document(nodes: DataFrame) -> DataFrame:
    """Adds doc_attrs, the document's attributes, to each node."""
    docs = nodes.where("context = 'document'").select(F.col("doc_id").alias("d_doc"), F.col("attrs").alias("doc_attrs"))
    return nodes.join(docs, F.col("doc_id") == F.col("d_doc"), "left").drop("d_doc")


def options() -> Column:
    return F.transform(F.filter(F.map_keys("attrs"), lambda k: k.endswith("-option")), lambda k: F.regexp_replace(k, "-option$", ""))


def add_role(role: str) -> Column:
    return F.array_union("roles", F.array(F.lit(role)))


def remove_role(role: str) -> Column:
    return F.array_remove("roles", role)


def first_of_id(nodes: DataFrame, id: str, **more) -> DataFrame:  # noqa: A002
    """The first node of each document with that id, if it matches the other conditions: the search by id ends at it either way."""
    found = find_by(nodes, id=id)
    return find_by(found, **more) if more else found


def sections_only(nodes: DataFrame) -> DataFrame:
    """Sections, found without a look at what is in other blocks: the filter reaches the scan of a written node table."""
    return nodes.where("context = 'section'")


def with_nested_documents(nodes: DataFrame, nested: DataFrame, enter: bool = False) -> DataFrame:
    """Nodes, and with ``enter`` those of documents in table cells too (same columns, their paths below the cells')."""
    return nodes.unionByName(nested) if enter else nodes


def accepted(nodes: DataFrame, verdict: Column) -> DataFrame:
    """Nodes by verdicts, in document order: ``accept`` takes the node, ``skip`` does not, ``prune`` takes it without what is below, ``reject`` neither, and ``stop`` takes it and ends the document's search."""
    judged = nodes.withColumn("verdict", verdict)
    cut = judged.where(F.col("verdict").isin("prune", "reject"))
    left = pruned(judged, cut).where(~F.col("verdict").isin("reject", "skip"))
    ended = F.sum((F.col("verdict") == "stop").cast("int")).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return left.withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0").drop("ended", "verdict")


def has_attribute(name: str, value: str | None = None, inherit: bool = False) -> Column:
    """Whether the node (or, with ``inherit``, its document) has the attribute, and with that value if one is given."""
    own = F.map_contains_key("attrs", F.lit(name)) if value is None else F.coalesce(F.try_element_at("attrs", F.lit(name)) == value, F.lit(False))
    if not inherit:
        return own
    above = F.map_contains_key("doc_attrs", F.lit(name)) if value is None else F.coalesce(F.try_element_at("doc_attrs", F.lit(name)) == value, F.lit(False))
    return own | (~F.map_contains_key("attrs", F.lit(name)) & F.coalesce(above, F.lit(False)))


def rekeyed(attrs: Column, names: list[str]) -> Column:
    """Positions 1, 2, ... of an attribute map under names too (``None`` passes one over); a name that is given already stays."""
    added = attrs
    for i, name in enumerate(names, 1):
        if name:
            value = F.try_element_at(attrs, F.lit(str(i)))
            added = F.when(value.isNotNull() & ~F.map_contains_key(attrs, F.lit(name)), F.map_concat(added, F.map_from_arrays(F.array(F.lit(name)), F.array(value)))).otherwise(added)
    return added


def updated(attrs: Column, more: Column) -> Column:
    """A map with another's entries, which win."""
    return F.map_concat(F.map_filter(attrs, lambda k, v: ~F.map_contains_key(more, k)), more)


def appended(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Nodes with new blocks (doc_id, parent_id, context, source) as last children of their parents, in the order of their ``nth``; parents that do not exist give nothing."""
    parent = nodes.select(F.col("doc_id").alias("p_doc"), F.col("node_id").alias("p_node"), F.col("ord").alias("p_ord"), F.col("depth").alias("p_depth"))
    top = nodes.groupBy(F.col("doc_id").alias("t_doc")).agg(F.max("node_id").alias("most"))
    last = nodes.where("parent_id IS NOT NULL").groupBy(F.col("doc_id").alias("l_doc"), F.col("parent_id").alias("l_parent")).agg(F.max(F.element_at("ord", -1)).alias("last"))
    placed = blocks.join(parent, (F.col("doc_id") == F.col("p_doc")) & (F.col("parent_id") == F.col("p_node"))).join(top, F.col("doc_id") == F.col("t_doc"))
    placed = placed.join(last, (F.col("doc_id") == F.col("l_doc")) & (F.col("parent_id") == F.col("l_parent")), "left")
    own = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("nth"))
    among = F.row_number().over(Window.partitionBy("doc_id").orderBy("parent_id", "nth"))
    new = placed.withColumns({"ord": F.array_append("p_ord", F.coalesce("last", F.lit(-1)) + own), "node_id": F.col("most") + among, "depth": F.col("p_depth") + 1})
    made = {f.name: F.col(f.name) if f.name in ("doc_id", "node_id", "parent_id", "ord", "depth", "context", "source") else F.array().cast("array<string>") if f.name == "roles" else F.create_map().cast("map<string,string>") if f.name == "attrs" else F.lit(None) for f in nodes.schema.fields}
    return nodes.unionByName(new.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in nodes.schema.fields]))


def removed(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes without the nodes ``gone`` (doc_id, node_id, ord) and what is below them."""
    return pruned(nodes, gone, keep_top=False)


#: Names of the typed views of kinds of nodes.
VIEWS = {"document": "Document", "section": "Section", "paragraph": "Paragraph", "listing": "Listing", "literal": "Literal", "ulist": "BulletList", "olist": "OrderedList", "dlist": "DescriptionList", "colist": "CalloutList", "list_item": "ListItem", "table": "Table", "image": "Image", "video": "Video", "audio": "Audio", "admonition": "Admonition", "example": "Example", "quote": "Quote", "verse": "Verse", "sidebar": "Sidebar", "open": "Open", "pass": "Passthrough", "stem": "Formula", "thematic_break": "ThematicBreak", "page_break": "PageBreak", "floating_title": "FloatingTitle", "preamble": "Preamble"}


def typed(nodes: DataFrame) -> DataFrame:
    """Adds view, the name of the node's type, and the fields that only some have: target, language, checked, start."""
    get = lambda name: F.try_element_at("attrs", F.lit(name))
    view = F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for kv in VIEWS.items() for y in kv]), F.col("context")), F.lit("Block"))
    source = (F.col("context") == "listing") & (F.col("style") == "source")
    return nodes.withColumns({"view": F.when(source, "SourceListing").otherwise(view), "target": get("target"), "language": F.when(source, F.coalesce(get("language"), get("2"))), "checked": F.when(F.map_contains_key("attrs", F.lit("checkbox")), F.map_contains_key("attrs", F.lit("checked"))), "start": get("start").try_cast("int")})


def diagnostics(rows: DataFrame, rules: list[tuple[str, str]], severity: str | None = None, code: str | None = None, message: str = "message") -> DataFrame:
    """Messages with their code, that of the first rule (code, pattern) that matches, or ``other``; and only those of a severity or code, if given."""
    found = F.lit("other")
    for name, pattern in reversed(rules):
        found = F.when(F.col(message).rlike(pattern), name).otherwise(found)
    out = rows.withColumn("code", found)
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    return out.where(F.col("code") == code) if code is not None else out
