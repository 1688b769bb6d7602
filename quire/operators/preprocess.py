"""Line-level operators: lines, conditionals, includes, attribute entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.durable import durable
from quire.functions.kernel import kernel
from quire.functions.text import BLANKS, leading_double, leading_int, let

ENTRY = r"^:(!?[\w][\w-]*!?):(?:[ \t]+(.*))?$"


def directive(text: Column) -> Column:
    """Struct of name, target, body and escaped of a line ``name::target[body]``; null if it is none. A backslash before it escapes it."""
    bare = F.when(text.startswith("\\"), F.substr(text, F.lit(2))).otherwise(text)
    head = F.substring_index(bare, "[", 1)
    name = F.substring_index(head, "::", 1)
    target = F.substr(head, F.length(name) + 3)
    body = F.substr(bare, F.length(head) + 2, F.length(bare) - F.length(head) - 2)
    whole = text.endswith("]") & bare.contains("::") & (F.length(name) + 2 <= F.length(head)) & name.rlike("^[a-z]+$") & ~target.rlike(r"^\s|\s$")
    return F.when(whole, F.struct(name.alias("name"), target.alias("target"), body.alias("body"), text.startswith("\\").alias("escaped")))


def _parted(text: str) -> Column:
    return F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no (from 1), text: each line without white space at its end."""
    split = _parted(text)
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(split).alias("at", "raw")).select("doc_id", (F.col("at") + 1).alias("line_no"), F.rtrim(F.col("raw"), F.lit(BLANKS)).alias("text"))


def _by_line() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_no")


def paragraphs(rows: DataFrame) -> DataFrame:
    """doc_id, par_no (from 1), first_line, last_line, text: islands of lines that are not blank."""
    blank = (F.col("text") == "").cast("int")
    marked = rows.withColumn("island", F.sum(blank).over(_by_line().rowsBetween(Window.unboundedPreceding, 0))).where(F.col("text") != "")
    grouped = marked.groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n").alias("text"))
    return grouped.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")).alias("par_no"), "first_line", "last_line", "text")


def without_comments(rows: DataFrame) -> DataFrame:
    """Without ``//`` lines and ``////`` blocks."""
    fence = (F.col("text") == "////").cast("int")
    opened = F.sum(fence).over(_by_line().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("fences", opened).where((F.col("fences") % 2 == 0) & (F.col("text") != "////") & ~F.col("text").rlike(r"^//(?!/)")).drop("fences")


def _names(target: Column) -> Column:
    return F.split(F.lower(target), "[,+]")


def defined(target: Column, attrs: Column, negated: bool = False) -> Column:
    """Truth of ``ifdef`` (or ``ifndef``): any of names parted by commas, all of names parted by plus."""
    names = _names(target)
    has = lambda n: F.map_contains_key(attrs, n)
    every, some = F.forall(names, has), F.exists(names, has)
    hold = F.when(target.contains("+"), every).otherwise(some)
    return ~hold if negated else hold


def _operand(raw: Column, attrs: Column) -> Column:
    """Struct of kind (string, bool, number or null) and its value."""
    from quire.functions.inline import attributes

    def read(t: Column, filled: Column) -> Column:
        quoted = t.rlike("^(\"[^\"]*\"|'[^']*')$")
        body = F.regexp_replace(F.regexp_replace(filled, "^[\"']", ""), "[\"']$", "")
        kind = F.when(quoted, "string").when(filled == "", "null").when(filled.isin("true", "false"), "bool").otherwise("number")
        number = F.when(filled.contains("."), leading_double(filled)).otherwise(leading_int(filled).cast("double"))
        return let(kind, lambda k: F.struct(k.alias("kind"), F.when(quoted, body).when(k == "bool", filled).alias("text"), F.when(k == "number", number).alias("number")))

    return let(F.btrim(raw, F.lit(" ")), lambda t: let(attributes(t, attrs, "drop"), lambda filled: read(t, filled)))


def evaluated(expression: Column, attrs: Column) -> Column:
    """Truth of ``ifeval``: strings with strings, numbers with numbers; other pairs are unequal, and no order holds between them."""
    pattern = r"^(.+?) *([=!><]=|[><]) *(.+)$"

    def truth(op: Column, a: Column, b: Column) -> Column:
        same = a["kind"] == b["kind"]
        equal = same & F.coalesce(a["text"].eqNullSafe(b["text"]) & a["number"].eqNullSafe(b["number"]), F.lit(False))
        less = same & F.coalesce(F.when(a["kind"] == "number", a["number"] < b["number"]).when(a["kind"] == "string", a["text"] < b["text"]), F.lit(False))
        ordered = same & a["kind"].isin("number", "string")
        return F.when(op == "==", equal).when(op == "!=", ~equal).when(op == "<", less).when(op == "<=", ordered & (less | equal)).when(op == ">", ordered & ~less & ~equal).when(op == ">=", ordered & ~less).otherwise(False)

    a, op, b = _operand(F.regexp_extract(expression, pattern, 1), attrs), F.regexp_extract(expression, pattern, 2), _operand(F.regexp_extract(expression, pattern, 3), attrs)
    return let(F.struct(op.alias("op"), a.alias("a"), b.alias("b")), lambda x: truth(x["op"], x["a"], x["b"]))


def shown_lines(steps, truths):
    """Whether each line stands, given what it does (1 opens a frame, -1 closes one, 0 neither) and the truth of the frame that it opens: nowhere inside a false one. Directives themselves do not stand."""
    out, frames, false = [], [], 0
    for step, truth in zip(steps, truths, strict=True):
        if step > 0:
            frames.append(bool(truth))
            false += not truth
        elif step < 0 and frames:
            false -= not frames.pop()
        out.append(step == 0 and not false)
    return out


def _by_document(rows: DataFrame, verdict: Column) -> DataFrame:
    """Rows of documents for which ``verdict``, an array over ``line`` (structs of line_no and record, of a document in order), is true."""
    record = F.struct("line_no", F.struct(*rows.columns).alias("record"))
    listed = F.collect_list(record)
    # maps have no order, so records with them are compared by their line alone
    sorted_ = F.array_sort(listed, lambda a, b: a["line_no"] - b["line_no"]) if any(isinstance(f.dataType, T.MapType) for f in rows.schema.fields) else F.sort_array(listed)
    grouped = rows.groupBy("doc_id").agg(sorted_.alias("line"))
    kept = grouped.select(F.filter(F.arrays_zip("line", verdict.alias("keep")), lambda x: x["keep"]).alias("kept"))
    return kept.select(F.explode("kept").alias("x")).select("x.line.record.*")


def _judged(line: Column, attrs: Column) -> Column:
    """Struct of a line: step and truth (see ``shown_lines``), says (false for a single-line directive that fails) and passed, the text that it leaves."""

    def of(d: Column) -> Column:
        kind = F.when(~d["escaped"], d["name"])
        truth = F.when(kind == "ifdef", defined(d["target"], attrs)).when(kind == "ifndef", defined(d["target"], attrs, True)).when(kind == "ifeval", evaluated(d["body"], attrs))
        single = F.coalesce(kind.isin("ifdef", "ifndef") & (d["body"] != ""), F.lit(False))
        step = F.when(single | kind.isNull(), 0).when(kind == "endif", -1).otherwise(1)
        passed = F.when(single, d["body"]).when(d["escaped"], F.substr(line, F.lit(2))).otherwise(line)
        return let(F.coalesce(truth, F.lit(False)), lambda holds: F.struct(step.alias("step"), holds.alias("truth"), (~single | holds).alias("says"), passed.alias("passed")))

    plain = F.struct(F.lit(0).alias("step"), F.lit(False).alias("truth"), F.lit(True).alias("says"), line.alias("passed"))
    return F.when(line.rlike(r"^\\?(?:ifdef|ifndef|ifeval|endif)::"), let(directive(line), of)).otherwise(plain)


_shown = kernel("array<boolean>")(shown_lines)


def conditionals(rows: DataFrame, attrs: Column) -> DataFrame:
    """Lines that stand under true conditions only; directives go, single-line ones leave their text.

    The attributes are those of the start (a map column of ``rows``). Frames
    may nest to any depth: they are a stack over the lines of a document.
    Attributes that the text itself sets need ``attributes.apply``.
    """
    marked = rows.withColumn("judged", _judged(F.col("text"), attrs))
    verdict = _shown(F.transform("line", lambda x: x["record"]["judged"]["step"]), F.transform("line", lambda x: x["record"]["judged"]["truth"]))
    kept = _by_document(marked, verdict).where("judged.says")
    return kept.select(*[F.col("judged.passed").alias("text") if c == "text" else F.col(c) for c in rows.columns])


def conditional_texts(docs: DataFrame, attrs: Column, text: str = "text") -> DataFrame:
    """``conditionals(lines(docs), attrs)`` for texts that are whole: line_no, text and the other columns of ``docs``. Each row is judged by itself, so nothing is shuffled and ids may occur twice."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*others, attrs.alias("given"), F.transform(_parted(text), lambda raw: F.rtrim(raw, F.lit(BLANKS))).alias("line"))
    rows = rows.select(*others, F.transform("line", lambda x: _judged(x, F.col("given"))).alias("judged"))
    rows = rows.select(*others, "judged", _shown(F.transform("judged", lambda x: x["step"]), F.transform("judged", lambda x: x["truth"])).alias("keep"))
    kept = F.filter(F.transform(F.arrays_zip("judged", "keep"), lambda x, i: F.struct((i + 1).alias("line_no"), x["judged"]["passed"].alias("text"), (x["keep"] & x["judged"]["says"]).alias("stands"))), lambda x: x["stands"])
    return rows.select(*others, F.explode(kept).alias("x")).select(*others, "x.line_no", "x.text")


def selected_lines(spec: str, column: str = "line_no") -> Column:
    """Predicate of ``lines=1..3;7;10..`` over a line number; an open or negative end is the end of the file."""
    parts = [p.strip() for p in spec.replace(",", ";").split(";") if p.strip()]
    out = F.lit(False)
    for p in parts:
        low, dots, high = p.partition("..")
        n = F.col(column)
        out = out | ((n >= int(low or 1)) & (n <= int(high)) if dots and high and not high.startswith("-") else (n >= int(low or 1)) if dots else (n == int(low)))
    return out


class TagFilter:
    """Which regions a list such as ``a;!b;*;**`` takes: ``verdict(name, outer)`` of a region inside one that is taken or not (``None``: inside none), and ``base`` outside of all.

    A named tag decides for itself. Others follow ``*``, if it is given (or
    follows from ``**``), but never stand inside a region that is left out;
    without it they are no regions. ``**`` decides for lines outside.
    """

    def __init__(self, spec: str):
        self.named: dict[str, bool] = {}
        for t in (x.strip() for x in spec.replace(",", ";").split(";")):
            if t.strip("!"):
                self.named[t.lstrip("!")] = not t.startswith("!")
        order = list(self.named)
        every, star = self.named.pop("**", None), self.named.pop("*", None)
        if every is not None:
            self.base = every
            self.other = star if star is not None else True if not every and next(iter(self.named.values()), True) is False else None
        elif star is not None:
            self.other, self.base = star, not star if order[0] == "*" else False
        else:
            self.other, self.base = None, True not in self.named.values()

    def verdict(self, name: str, outer):
        if name in self.named:
            return self.named[name]
        if self.other is None:
            return None
        return False if outer is False else self.other


def tag_of(line: str):
    """(``tag`` or ``end``, name) of a line with a tag directive, else None."""
    for kind in ("tag", "end"):
        at = line.find(kind + "::")
        while at >= 0:
            stop = line.find("[]", at)
            name = line[at + 5 : stop] if stop > 0 else ""
            before, after = line[at - 1 : at], line[stop + 2 : stop + 3]
            if name and not any(c in " \t[]" for c in name) and not before.replace("_", "a").isalnum() and (not after or after in " \t" or line[stop + 2 :].startswith(("-->", "*/"))):
                return kind, name
            at = line.find(kind + "::", at + 1)
    return None


def chosen_by_tags(texts: list[str], spec: str):
    """(whether each line is chosen, problems): problems are (line from 1, kind, tag) of ends that close nothing or another region, of regions left open, and of wanted tags that never occur."""
    tags, regions, out, problems, seen = TagFilter(spec), [], [], [], set()
    for i, text in enumerate(texts, 1):
        found = tag_of(text)
        verdict = regions[-1][1] if regions else tags.base
        if not found:
            out.append(verdict)
            continue
        out.append(False)
        kind, name = found
        if kind == "tag":
            taken = tags.verdict(name, regions[-1][1] if regions else None)
            if taken is not None:
                regions.append((name, taken, i))
                seen.add(name)
        elif regions and regions[-1][0] == name:
            regions.pop()
        elif name in tags.named:
            at = next((k for k in range(len(regions) - 1, -1, -1) if regions[k][0] == name), None)
            problems.append((i, "unexpected end" if at is None else "mismatched end", name))
            if at is not None:
                del regions[at]
    problems += [(line, "not closed", name) for name, _, line in regions]
    problems += [(None, "not found", name) for name, wanted in tags.named.items() if wanted and name not in seen]
    return out, problems


def tagged_lines(rows: DataFrame, tags: str) -> DataFrame:
    """Lines selected by ``tags=a;!b;*;**``: the innermost open region decides, at any depth; lines with tag directives never pass."""
    verdict = kernel("array<boolean>")(lambda texts: chosen_by_tags(texts, tags)[0])(F.transform("line", lambda x: x["record"]["text"]))
    return _by_document(rows, verdict).select(*rows.columns)


def tag_problems(rows: DataFrame, tags: str) -> DataFrame:
    """doc_id, line_no (null for tags that never occur), problem, tag: what is wrong with the tags of each document for that selection."""
    grouped = rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("texts"))

    def found(texts):
        return [{"line_no": i, "problem": kind, "tag": name} for i, kind, name in chosen_by_tags(texts, tags)[1]]

    problems = kernel("array<struct<line_no:int,problem:string,tag:string>>")(found)
    return grouped.select("doc_id", F.explode(problems("texts")).alias("p")).select("doc_id", "p.*")


def chosen_lines(texts: list[str], options: str) -> list[tuple[int, str]]:
    """(number, text) of the lines that the options of an include choose: by ``lines``, else by ``tag`` or ``tags``, and set in by ``indent``.

    Line numbers are taken in rising order, each once; an end that is open or
    negative is the last line. As the list is walked along with the file, an
    entry of 0 is never reached and holds up all after it.
    """
    from quire.operators.blocks import attribute_list

    asked = attribute_list(options or "")
    numbered = list(enumerate(texts, 1))
    if asked.get("lines"):
        wanted: set[int] = set()
        for part in asked["lines"].replace(",", ";").split(";"):
            low, dots, high = (x.strip() for x in part.strip().partition(".."))
            start, stop = _number(low), _number(high)
            if dots:
                wanted.update(range(start, (len(texts) if stop is None or stop < 0 else min(stop, len(texts))) + 1) if start is not None else ())
            elif start is not None:
                wanted.add(start)
        numbered = [] if 0 in wanted else [x for x in numbered if x[0] in wanted]
    elif asked.get("tags") or asked.get("tag"):
        keep, _ = chosen_by_tags(texts, asked.get("tags") or asked["tag"])
        numbered = [x for x, k in zip(numbered, keep, strict=True) if k]
    if asked.get("indent", "").isdigit():
        margin = min((len(t) - len(t.lstrip(" ")) for _, t in numbered if t.strip()), default=0)
        numbered = [(i, " " * int(asked["indent"]) + t[margin:] if t.strip() else "") for i, t in numbered]
    return numbered


def _number(text: str):
    try:
        return int(text)
    except ValueError:
        return None


@kernel("array<struct<line_no:int,text:string>>")
def _chosen(texts, options):
    return [{"line_no": i, "text": t} for i, t in chosen_lines(texts, options or "")]


def include_targets(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, target, options of each include directive that is not escaped."""
    found = rows.select("doc_id", "line_no", directive(F.col("text")).alias("d")).where("d.name = 'include' AND NOT d.escaped AND d.target <> ''")
    return found.select("doc_id", "line_no", "d.target", F.col("d.body").alias("options"))


def expand_includes(rows: DataFrame, files: DataFrame, depth: int = 64, resolver=None) -> DataFrame:
    """doc_id, ord (array of line numbers), path, line_no, text with every include replaced by the chosen lines of its file.

    ``files``: path, line_no, text. One join per level, until no directive is
    left (or ``depth`` is reached, which leaves a visible line), each level
    written once; ``ord`` keeps nested order. ``lines``, ``tag``, ``tags``,
    ``indent``, ``leveloffset`` (added up over levels, shifting section
    titles) and ``opts=optional`` are honoured. A missing file leaves a
    visible line. ``resolver(targets)``: a DataFrame of path, line_no, text
    for the targets (target) that ``files`` lacks.
    """
    base = rows.select("doc_id", F.array(F.col("line_no").cast("int")).alias("ord"), F.lit(None).cast("string").alias("path"), F.col("line_no").cast("int").alias("line_no"), "text", F.lit(0).alias("shift"))
    body = files.groupBy(F.col("path").alias("f_path")).agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("texts"))
    done = None
    for _ in range(depth):
        level = durable(base.withColumn("d", F.when(F.col("text").contains("include::"), directive(F.col("text")))), "includes")
        asks = F.coalesce((F.col("d.name") == "include") & ~F.col("d.escaped") & (F.col("d.target") != ""), F.lit(False))
        plain = _shifted(level.where(~asks))
        done = plain if done is None else done.unionByName(plain)
        asked = level.where(asks).select("doc_id", "ord", "path", "line_no", "text", "shift", "d.target", F.col("d.body").alias("options"))
        if asked.isEmpty():
            return done
        if resolver is not None:
            lacking = asked.select("target").distinct().join(body.select("f_path"), F.col("target") == F.col("f_path"), "left_anti")
            more = resolver(lacking).groupBy(F.col("path").alias("f_path")).agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("texts"))
            body = durable(body.unionByName(more), "files")
        joined = asked.join(body, F.col("target") == F.col("f_path"), "left")
        optional = F.col("options").rlike(r"(?:^|[,%])\s*(?:(?:opts|options)=\"?[\w,]*)?optional")
        shown = joined.where(F.col("f_path").isNull() & ~optional).select("doc_id", "ord", "path", "line_no", F.concat(F.lit("Unresolved directive: "), F.col("text")).alias("text"))
        done = done.unionByName(shown)
        offset = F.coalesce(F.regexp_extract("options", r'leveloffset="?([+-]?\d+)', 1).try_cast("int"), F.lit(0))
        lines_of = joined.where("f_path IS NOT NULL").select("doc_id", "ord", "f_path", (F.col("shift") + offset).alias("shift"), F.explode(_chosen("texts", "options")).alias("x"))
        base = lines_of.select("doc_id", F.array_append("ord", F.col("x.line_no")).alias("ord"), F.col("f_path").alias("path"), F.col("x.line_no").alias("line_no"), F.col("x.text").alias("text"), "shift")
    left = durable(base, "includes")
    over = left.where(F.col("text").rlike(r"^include::"))
    return done.unionByName(_shifted(left.where(~F.col("text").rlike(r"^include::")))).unionByName(over.select("doc_id", "ord", "path", "line_no", F.concat(F.lit("Include depth exceeded: "), F.col("text")).alias("text")))


def _shifted(rows: DataFrame) -> DataFrame:
    """Section titles moved by their rows' level offset, between one mark and six; escaped directives without their backslash."""
    marks = F.regexp_extract("text", r"^(=+|#+)[ \t]+\S", 1)
    count = F.greatest(F.lit(1), F.least(F.lit(6), F.length(marks) + F.col("shift")))
    moved = F.concat(F.repeat(F.left(marks, F.lit(1)), count), F.substr(F.col("text"), F.length(marks) + 1))
    text = F.when((F.col("shift") != 0) & (marks != ""), moved).otherwise(F.regexp_replace("text", r"^\\(?=include::)", ""))
    return rows.select("doc_id", "ord", "path", "line_no", text.alias("text"))


def attribute_entries(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, name, value, op (set or unset) of each attribute entry; a ``\\`` at a line's end continues its value, over any number of lines, and one after `` +`` keeps the line break. ``leveloffset`` may be relative: it adds to what came before."""
    goes_on = F.coalesce(F.lag("text").over(_by_line()).rlike(r" \\$"), F.lit(False))
    placed = rows.withColumn("island", F.sum((~goes_on).cast("int")).over(_by_line().rowsBetween(Window.unboundedPreceding, 0)))
    whole = placed.groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("parts")).where(F.col("parts")[0]["text"].rlike(ENTRY))
    first = F.col("parts")[0]["text"]
    name = F.regexp_extract(first, ENTRY, 1)
    pieces = F.transform("parts", lambda p, i: F.when(i == 0, F.regexp_extract(p["text"], ENTRY, 2)).otherwise(F.ltrim(p["text"])))
    value = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r" \+ \\$"), F.concat(F.regexp_replace(p, r" \+ \\$", " +"), F.lit("\n"))).otherwise(F.regexp_replace(p, r"\\$", ""))), "")
    unset = name.startswith("!") | name.endswith("!")
    plain = F.lower(F.regexp_replace(name, "!", ""))
    alias = F.create_map(*[F.lit(y) for kv in {"numbered": "sectnums", "hardbreaks": "hardbreaks-option"}.items() for y in kv])
    out = whole.select("doc_id", F.col("parts")[0]["line_no"].alias("line_no"), F.coalesce(F.try_element_at(alias, plain), plain).alias("name"), F.when(~unset, value).alias("value"), F.when(unset, "unset").otherwise("set").alias("op"))
    relative = (F.col("name") == "leveloffset") & F.col("value").rlike(r"^[+-]\d+$")
    seed = F.sum(((F.col("name") == "leveloffset") & ~F.coalesce(relative, F.lit(False))).cast("int")).over(_by_line().rowsBetween(Window.unboundedPreceding, 0))
    run = Window.partitionBy("doc_id", "name", "seed").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    added = F.sum(F.col("value").try_cast("int")).over(run)
    return out.withColumn("seed", seed).withColumn("value", F.when(relative, added.cast("string")).otherwise(F.col("value"))).drop("seed")


def attributes_at_end(entries: DataFrame, overrides: Column | None = None) -> DataFrame:
    """doc_id and attrs: the last value of each name, under ``precedence``."""
    latest = entries.groupBy("doc_id", "name").agg(F.max_by(F.struct("value", "op"), F.col("line_no")).alias("last")).where(F.col("last.op") == "set")
    out = latest.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("last.value").alias("value"))))).alias("attrs"))
    return out if overrides is None else out.withColumn("attrs", precedence(F.col("attrs"), overrides))


def _soft(overrides: Column) -> Column:
    """Overrides that the document may change: those whose name or value ends in ``@``."""
    return F.map_filter(overrides, lambda k, v: k.endswith("@") | F.coalesce(v.endswith("@"), F.lit(False)))


def _bare(overrides: Column) -> Column:
    named = F.transform_keys(overrides, lambda k, v: F.lower(F.btrim(k, F.lit("!@"))))
    return F.transform_values(named, lambda k, v: F.regexp_replace(v, "@$", ""))


def _unset(overrides: Column) -> Column:
    """Names that overrides take away: ``!name``, ``name!``, or a null value."""
    off = F.map_filter(overrides, lambda k, v: k.startswith("!") | F.rtrim(k, F.lit("@")).endswith("!") | v.isNull())
    return F.transform(F.map_keys(off), lambda k: F.lower(F.btrim(k, F.lit("!@"))))


def precedence(document: Column, overrides: Column) -> Column:
    """The attributes that hold: hard overrides, then the document's, then soft overrides (``name@`` or a value that ends in ``@``). A hard ``!name`` keeps the name unset, a soft one until the document sets it."""
    soft = _soft(overrides)
    hard = F.map_filter(overrides, lambda k, v: ~F.map_contains_key(soft, k))
    gone, weak = _unset(hard), _unset(soft)
    set_soft = F.map_filter(_bare(soft), lambda k, v: ~F.array_contains(weak, k))
    set_hard = F.map_filter(_bare(hard), lambda k, v: ~F.array_contains(gone, k))
    own = F.map_filter(document, lambda k, v: ~F.array_contains(gone, k) & ~F.map_contains_key(set_hard, k))
    beneath = F.map_filter(set_soft, lambda k, v: ~F.map_contains_key(own, k) & ~F.map_contains_key(set_hard, k))
    return F.map_concat(beneath, own, set_hard)


def locked(name, overrides: Column) -> Column:
    """Whether a document may not change the attribute: a hard override sets or unsets it."""
    n = F.lit(name) if isinstance(name, str) else name
    soft = _soft(overrides)
    hard = F.map_filter(overrides, lambda k, v: ~F.map_contains_key(soft, k))
    return F.array_contains(F.transform(F.map_keys(hard), lambda k: F.lower(F.btrim(k, F.lit("!@")))), F.lower(n))


def leading_blanks(rows: DataFrame) -> DataFrame:
    """doc_id, skipped: blank lines at the start of each document."""
    said = F.min(F.when(F.col("text") != "", F.col("line_no")))
    return rows.groupBy("doc_id").agg(F.coalesce(said - 1, F.count(F.lit(1))).cast("int").alias("skipped"))


def without_leading_blanks(rows: DataFrame) -> DataFrame:
    said = F.max((F.col("text") != "").cast("int")).over(_by_line().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("said", said).where("said = 1").drop("said")


def lines_until(rows: DataFrame, terminator: str | None = None, break_on_blank: bool = False, break_on_continuation: bool = False, keep_last: bool = False, skip_comments: bool = False) -> DataFrame:
    """The lines of each document up to the first that ends it: the terminator, a blank one, or a lone ``+``, as asked for; that line itself with ``keep_last``. Comment lines are left out with ``skip_comments``."""
    ends = F.lit(False)
    if terminator is not None:
        ends = ends | (F.col("text") == terminator)
    if break_on_blank:
        ends = ends | (F.col("text") == "")
    if break_on_continuation:
        ends = ends | (F.col("text") == "+")
    before = F.coalesce(F.sum(ends.cast("int")).over(_by_line().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumns({"ended": before, "ends": ends}).where((F.col("ended") == 0) & (~F.col("ends") | F.lit(keep_last))).drop("ended", "ends")
    return out.where(~F.col("text").rlike(r"^//(?!/)")) if skip_comments else out


def expanded_tabs(text, size: int) -> Column:
    """Tabs as blanks up to the next stop of ``size`` columns, line by line."""
    return kernel("string")(lambda t: "\n".join(x.expandtabs(size) for x in t.split("\n")))(text)


def reindented(text: Column, indent: int = 0) -> Column:
    """The common indentation of a block's lines replaced by ``indent`` spaces."""
    rows = F.split(text, "\n")
    margin = F.array_min(F.transform(F.filter(rows, lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.length(F.regexp_extract(x, "^ *", 0))))
    return F.array_join(F.transform(rows, lambda x: F.when(F.btrim(x, F.lit(BLANKS)) == "", F.lit("")).otherwise(F.concat(F.lit(" " * indent), F.substr(x, F.coalesce(margin, F.lit(0)) + 1)))), "\n")
