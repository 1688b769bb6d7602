"""Catalogs and what refers to them: ids, references, footnotes, captions, counters, callouts, the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.durable import durable


def register(rows: DataFrame, key: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(first registration of each key, later ones as duplicates)."""
    nth = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    return nth.where("nth = 1").drop("nth"), nth.where("nth > 1").drop("nth")


def resolve(refs: DataFrame, targets: DataFrame, doc: str = "doc_id") -> DataFrame:
    """References (doc, target) with resolved_id and how (id, title or null).

    By id first. Otherwise, only if the text has a space or a capital, by the
    title of the first target registered with it. ``targets``: doc, id,
    title, ord.
    """
    # which is first only matters for titles; both are grouped with sums in each task first
    by_id = targets.where(F.col("id").isNotNull()).groupBy(F.col(doc).alias("i_doc"), F.col("id").alias("i_id")).agg(F.lit(1).alias("once")).drop("once")
    by_title = targets.where(F.col("title").isNotNull()).groupBy(F.col(doc).alias("t_doc"), F.col("title").alias("t_title")).agg(F.min_by("id", "ord").alias("t_id"))
    natural = F.col("target").rlike(r"[ \p{Lu}]")
    out = refs.join(by_id, (F.col(doc) == F.col("i_doc")) & (F.col("target") == F.col("i_id")), "left").join(by_title, (F.col(doc) == F.col("t_doc")) & (F.col("target") == F.col("t_title")) & natural, "left")
    how = F.when(F.col("i_id").isNotNull(), "id").when(F.col("t_id").isNotNull(), "title")
    return out.withColumns({"resolved_id": F.coalesce("i_id", "t_id"), "how": how}).drop("i_doc", "i_id", "t_doc", "t_title", "t_id")


def unresolved(refs: DataFrame, targets: DataFrame, doc: str = "doc_id") -> DataFrame:
    """References whose target is no id of the document."""
    return refs.join(targets.select(F.col(doc).alias("i_doc"), F.col("id").alias("i_id")), (F.col(doc) == F.col("i_doc")) & (F.col("target") == F.col("i_id")), "left_anti")


def numbered_footnotes(notes: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """Adds number and is_ref. A note with an id that came before refers to it; others count up in order."""
    first = F.min(order).over(Window.partitionBy(doc, "id"))
    marked = notes.withColumn("is_ref", F.col("id").isNotNull() & (F.col(order) > first))
    count = F.sum((~F.col("is_ref")).cast("int")).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("number", F.when(~F.col("is_ref"), count))
    return marked.withColumn("number", F.coalesce("number", F.min("number").over(Window.partitionBy(doc, "id"))))


def captions(blocks: DataFrame, label: dict[str, str] | None = None) -> DataFrame:
    """Adds number and caption to titled blocks, counted per document and context."""
    label = label or {"image": "Figure", "table": "Table", "example": "Example", "listing": "Listing"}
    names = F.create_map(*[F.lit(y) for kv in label.items() for y in kv])
    titled = F.col("title").isNotNull()
    count = F.sum(titled.cast("int")).over(Window.partitionBy("doc_id", "context").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    out = blocks.withColumn("number", F.when(titled & F.map_contains_key(names, F.col("context")), count))
    return out.withColumn("caption", F.when(F.col("number").isNotNull(), F.concat(F.try_element_at(names, F.col("context")), F.lit(" "), F.col("number").cast("string"), F.lit(". "))))


def counters(uses: DataFrame, seed: int = 1) -> DataFrame:
    """Adds value to uses (doc_id, name, ord) of integer counters."""
    return uses.withColumn("value", F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("ord")) + (seed - 1))


def successor(value: str) -> str:
    """The next string: the last run of letters and digits counts up, carrying by kind (a9 is followed by b0, az by ba, Zz by AAa); without any, the last character's next."""
    if not value:
        return ""
    chars = list(value)
    known = [i for i, c in enumerate(chars) if c.isascii() and c.isalnum()]
    if not known:
        return value[:-1] + chr(ord(value[-1]) + 1)
    i = known[-1]
    while True:
        c = chars[i]
        if c == "9" or c in "zZ":
            chars[i] = {"9": "0", "z": "a", "Z": "A"}[c]
            if i - 1 < 0 or not (chars[i - 1].isascii() and chars[i - 1].isalnum()):
                chars.insert(i, {"9": "1", "z": "a", "Z": "A"}[c])
                return "".join(chars)
            i -= 1
        else:
            chars[i] = chr(ord(c) + 1)
            return "".join(chars)


def callout_links(callouts: DataFrame, items: DataFrame) -> DataFrame:
    """Items (doc_id, list_no, ordinal) with ids, the callouts that they explain (``CO<list>-<n>``), joined by spaces; null where there are none."""
    ids = callouts.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "list_no").orderBy("ord"))).withColumn("cid", F.concat(F.lit("CO"), F.col("list_no").cast("string"), F.lit("-"), F.col("nth").cast("string")))
    per = ids.groupBy(F.col("doc_id").alias("c_doc"), F.col("list_no").alias("c_list"), F.col("ordinal").alias("c_ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "cid"))), lambda r: r["cid"]), " ").alias("ids"))
    return items.join(per, (F.col("doc_id") == F.col("c_doc")) & (F.col("list_no") == F.col("c_list")) & (F.col("ordinal") == F.col("c_ord")), "left").drop("c_doc", "c_list", "c_ord")


def index_letter(term) -> "F.Column":
    """The letter that an index term stands under: its first, in capitals, or ``@``."""
    first = F.left(term if not isinstance(term, str) else F.col(term), F.lit(1))
    return F.when(first.rlike(r"\p{L}"), F.upper(first)).otherwise("@")


def index(uses: DataFrame) -> DataFrame:
    """letter, t1, t2, t3, uses, anchors (in order of use), see (the first), see_also (distinct, only without see) per document; order by sort_key, t1, t2, t3."""
    grouped = uses.groupBy("doc_id", "t1", "t2", "t3").agg(
        F.count(F.lit(1)).alias("uses"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "anchor"))), lambda r: r["anchor"]).alias("anchors"),
        F.min_by("see", F.when(F.col("see").isNotNull(), F.col("ord"))).alias("see"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "see_also"))), lambda r: F.coalesce(r["see_also"], F.array().cast("array<string>"))))).alias("see_also"),
    )
    key = F.translate("t1", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return grouped.withColumns({"see_also": F.when(F.col("see").isNull(), F.col("see_also")), "letter": index_letter("t1"), "sort_key": key})


def page_ranges(uses: DataFrame, key: list[str], page: str = "page") -> DataFrame:
    """key, ranges: distinct pages merged into runs, as ``1-3, 7``."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(page))
    runs = uses.select(*key, page).distinct().withColumn("run", F.col(page) - nth).groupBy(*key, "run").agg(F.min(page).alias("low"), F.max(page).alias("high"))
    shown = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat(F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string")))
    return runs.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", shown.alias("shown")))), lambda r: r["shown"]), ", ").alias("ranges"))


def substitutions(base: list[str], spec: str) -> list[str]:
    """The list of passes after ``subs=``: ``+x`` appends, ``-x`` takes away, ``x+`` puts first; plain names replace. Duplicates keep the first."""
    groups = {"none": [], "normal": ["specialcharacters", "quotes", "attributes", "replacements", "macros", "post_replacements"], "verbatim": ["specialcharacters", "callouts"], "specialchars": ["specialcharacters"]}
    hints = {"a": "attributes", "m": "macros", "n": "normal", "p": "post_replacements", "q": "quotes", "r": "replacements", "c": "specialcharacters", "v": "verbatim"}
    out: list[str] | None = None
    for entry in (x.strip() for x in spec.split(",") if x.strip()):
        mode = "append" if entry[0] == "+" else "remove" if entry[0] == "-" else "prepend" if entry[-1] == "+" else "set"
        name = entry.strip("+-")
        name = hints.get(name, name)
        names = groups.get(name, [name])
        held = list(base) if out is None and mode != "set" else out or []
        out = held + names if mode == "append" else [x for x in held if x not in names] if mode == "remove" else names + held if mode == "prepend" else held + names
    return list(dict.fromkeys(base if out is None else out))


def smallest_cover(reach: DataFrame, cost: DataFrame, forced: tuple = ()) -> list:
    """Candidates that cover all that any covers: forced ones first, then by (gain, lower cost, id), then without the redundant, costliest first.

    ``reach``: id, item; ``cost``: id, cost. Each round is one aggregate and
    one anti-join; only the chosen id comes to the driver.
    """
    chosen, left = [], reach.distinct()
    for key in forced:
        chosen.append(key)
        left = left.join(reach.where(F.col("id") == key).select("item"), "item", "left_anti")
    while True:
        best = left.groupBy("id").agg(F.count(F.lit(1)).alias("gain")).join(cost, "id").orderBy(F.desc("gain"), "cost", "id").limit(1).collect()
        if not best:
            break
        chosen.append(best[0]["id"])
        left = durable(left.join(reach.where(F.col("id") == best[0]["id"]).select("item"), "item", "left_anti"), "cover")
    price = {r["id"]: r["cost"] for r in cost.where(F.col("id").isin(chosen)).collect()}
    for key in sorted((x for x in chosen if x not in forced), key=lambda x: (-price.get(x, 0), str(x))):
        rest = [x for x in chosen if x != key]
        alone = reach.where(F.col("id") == key).select("item").distinct().join(reach.where(F.col("id").isin(rest)).select("item"), "item", "left_anti")
        if alone.isEmpty():
            chosen = rest
    return chosen


def page_map(uses: DataFrame) -> DataFrame:
    """doc_id, map: JSON of the pages' labels and of each block (at) with its first and last page: uses has doc_id, at, page (from 0), label."""
    blocks = uses.groupBy("doc_id", "at").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    listed = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "last", "at"))).alias("b"))
    labels = uses.groupBy("doc_id", "page").agg(F.min("label").alias("label")).groupBy(F.col("doc_id").alias("l_doc")).agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "label"))), lambda x: x["label"]).alias("labels"))
    joined = listed.join(labels, F.col("doc_id") == F.col("l_doc"))
    ordered = F.transform("b", lambda x: F.struct(x["at"].alias("at"), x["first"].alias("first"), x["last"].alias("last")))
    return joined.select("doc_id", F.to_json(F.struct("labels", ordered.alias("blocks"))).alias("map"))


def index_links(entries: DataFrame) -> DataFrame:
    """Index entries with see_id and see_also_ids: the ids of the primary entries (doc_id, t1, entry_id) whose plain terms they point to; null where there is none."""
    primary = entries.where("t2 IS NULL").groupBy(F.col("doc_id").alias("p_doc"), F.col("t1").alias("p_term")).agg(F.min("entry_id").alias("p_id"))
    seen = entries.join(primary, (F.col("doc_id") == F.col("p_doc")) & (F.col("see") == F.col("p_term")), "left").withColumn("see_id", F.col("p_id")).drop("p_doc", "p_term", "p_id")
    also = seen.select("doc_id", "entry_id", F.explode("see_also").alias("term")).join(primary, (F.col("doc_id") == F.col("p_doc")) & (F.col("term") == F.col("p_term")))
    listed = also.groupBy(F.col("doc_id").alias("a_doc"), F.col("entry_id").alias("a_id")).agg(F.sort_array(F.collect_set("p_id")).alias("see_also_ids"))
    return seen.join(listed, (F.col("doc_id") == F.col("a_doc")) & (F.col("entry_id") == F.col("a_id")), "left").drop("a_doc", "a_id")


def collation_key(term) -> "F.Column":
    """What index entries are sorted by: capitals A-Z as small letters, then the term as it is."""
    t = F.col(term) if isinstance(term, str) else term
    return F.struct(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("folded"), t.alias("term"))


def sorted_entries(entries: DataFrame, group: str = "doc_id", term: str = "term") -> DataFrame:
    """Adds place (from 1) of each entry in its document's index."""
    return entries.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(collation_key(term))))
