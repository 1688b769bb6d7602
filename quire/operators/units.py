"""Numbered addresses: labels as key arrays, steps, sequence checks, passages, enclosing units, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import from_roman

MARKER = r"(?<![\w@])@(?:\(([^)\s]+)\)|([\w.\-]+))?(!)?"


def int_key(label: Column) -> Column:
    """``12`` is [12, 0]; with an inserted letter, ``12a`` is [12, 1]. Null if it is no such label."""
    ok = label.rlike(r"^\d+[a-z]?$")
    letter = F.regexp_extract(label, r"([a-z])$", 1)
    return F.when(ok, F.array(F.regexp_extract(label, r"^(\d+)", 1).cast("int"), F.when(letter == "", 0).otherwise(F.ascii(letter) - 96)))


def alpha_key(label: Column) -> Column:
    """a is [1], z [26], aa [27]."""
    low = F.lower(label)
    value = F.aggregate(F.transform(F.split(low, ""), lambda c: F.ascii(c) - 96), F.lit(0), lambda acc, v: acc * 26 + v)
    return F.when(low.rlike("^[a-z]{1,4}$"), F.array(value))


def roman_key(label: Column) -> Column:
    return F.when(F.upper(label).rlike("^M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (label != ""), F.array(from_roman(label)))


def folio_key(label: Column) -> Column:
    """``12r`` and ``12v`` with an optional column letter; also ``2a`` and ``2b`` sides."""
    side = F.regexp_extract(label, r"^\d+([rvab])", 1)
    column = F.regexp_extract(label, r"^\d+[rv]([a-d])$", 1)
    return F.when(label.rlike(r"^\d+(?:[rv][a-d]?|[ab])$"), F.array(F.regexp_extract(label, r"^(\d+)", 1).cast("int"), F.when(side.isin("r", "a"), 0).otherwise(1), F.when(column == "", 0).otherwise(F.ascii(column) - 96)))


def page_key(label: Column, letters: str = "abcde") -> Column:
    """Page and section, ``327a``."""
    return F.when(label.rlike(rf"^\d+[{letters}]$"), F.array(F.regexp_extract(label, r"^(\d+)", 1).cast("int"), F.ascii(F.right(label, F.lit(1))) - 96))


def line_key(label: Column) -> Column:
    """Page, column and line, ``1094a12``."""
    p = r"^(\d+)([ab])(\d+)$"
    return F.when(label.rlike(p), F.array(F.regexp_extract(label, p, 1).cast("int"), F.ascii(F.regexp_extract(label, p, 2)) - 96, F.regexp_extract(label, p, 3).cast("int")))


def enum_key(label: Column, names: list[str]) -> Column:
    at = F.array_position(F.array(*map(F.lit, names)), label).cast("int")
    return F.when(at > 0, F.array(at))


def union_key(label: Column, *kinds) -> Column:
    """The first kind that reads the label; its number goes first, so that kinds sort apart."""
    return F.coalesce(*[F.when(k(label).isNotNull(), F.concat(F.array(F.lit(i)), k(label))) for i, k in enumerate(kinds)])


def next_label(label: Column, kind: str) -> Column:
    """The label that a bare marker steps to."""
    from quire.functions.text import to_alpha, to_roman

    return {
        "int": (F.regexp_extract(label, r"^(\d+)", 1).cast("int") + 1).cast("string"),
        "alpha": to_alpha(alpha_key(label)[0] + 1),
        "roman": to_roman(from_roman(label) + 1),
    }[kind]


def markers(rows: DataFrame) -> DataFrame:
    """doc_id, pos (line and nth), label (null: a step), close of each ``@`` marker in lines."""
    found = rows.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(MARKER), F.lit(0))).alias("nth", "m"))
    label = F.nullif(F.coalesce(F.nullif(F.regexp_extract("m", MARKER, 1), F.lit("")), F.regexp_extract("m", MARKER, 2)), F.lit(""))
    return found.select("doc_id", F.struct("line_no", "nth").alias("pos"), label.alias("label"), F.col("m").endswith("!").alias("close"))


def stepped(events: DataFrame) -> DataFrame:
    """Adds number: a labelled marker's own, a bare one's the last number plus the steps since."""
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("label").try_cast("int")
    marked = events.withColumn("seed", F.count(own).over(by))
    return marked.withColumn("number", F.coalesce(F.first(own, True).over(Window.partitionBy("doc_id", "seed").orderBy("pos")), F.lit(0)) + F.row_number().over(Window.partitionBy("doc_id", "seed").orderBy("pos")) - F.when(F.col("seed") > 0, 1).otherwise(0)).drop("seed")


def intervals(units: DataFrame, order: str = "pos") -> DataFrame:
    """Adds end_pos (exclusive, null at the end): a unit ends where the next of its own or a shallower depth starts. One window per depth that occurs."""
    deepest = units.agg(F.max("depth")).head()[0] or 0
    after = Window.partitionBy("doc_id").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    ends = [F.when(F.col("depth") == d, F.first(F.when(F.col("depth") <= d, F.col(order)), True).over(after)) for d in range(int(deepest) + 1)]
    return units.withColumn("end_pos", F.coalesce(*ends))


def sequence_check(units: DataFrame, group: list[str], order: str, number: str) -> DataFrame:
    """Adds problem: gap, repeat or backward against the number before, null if it follows."""
    before = F.lag(number).over(Window.partitionBy(*group).orderBy(order))
    n = F.col(number)
    return units.withColumn("problem", F.when(before.isNull() | (n == before + 1), None).when(n == before, "repeat").when(n < before, "backward").otherwise("gap"))


def innermost(events: DataFrame, units: DataFrame, group: str, at: str) -> DataFrame:
    """Adds unit_id to events: the last unit that starts at or before each. One sort of both together, no range join."""
    e = events.select(F.col(group).alias("g"), F.col(at).alias("p"), F.lit(1).alias("kind"), F.lit(None).cast(units.schema["unit_id"].dataType).alias("unit_id"), F.struct(*events.columns).alias("rec"))
    u = units.select(F.col(group).alias("g"), F.col(at).alias("p"), F.lit(0).alias("kind"), "unit_id", F.lit(None).cast(e.schema["rec"].dataType).alias("rec"))
    by = Window.partitionBy("g").orderBy("p", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(u).withColumn("inner", F.last("unit_id", True).over(by)).where("kind = 1").select("rec.*", F.col("inner").alias("unit_id"))


def passages(units: DataFrame, asked: DataFrame, group: str, key: str) -> DataFrame:
    """asked (passage_id, group, low, high) with the units whose keys lie between: an equi-join on the group with a range filter."""
    a = asked.select("passage_id", F.col(group).alias("a_group"), "low", "high")
    return units.join(a, (F.col(group) == F.col("a_group")) & F.col(key).between(F.col("low"), F.col("high"))).drop("a_group", "low", "high")


def citation(low: Column, high: Column) -> Column:
    """Text of a range of addresses given as arrays of labels: what both share is said once."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.size(low)), lambda i: F.slice(low, 1, i) == F.slice(high, 1, i)))
    join = lambda x: F.array_join(x, ":")
    return F.when(low == high, join(low)).otherwise(F.concat(join(low), F.lit("–"), join(F.slice(high, same + 1, F.size(high)))))


def aligned(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Two texts unit by unit: all keys of either, left_text and right_text."""
    return left.select(*key, F.col("text").alias("left_text")).join(right.select(*key, F.col("text").alias("right_text")), key, "full")


def callers(notes: DataFrame, reset: list[str], order: str) -> DataFrame:
    """Adds caller: a letter that starts again in each unit of the reset level."""
    from quire.functions.text import to_alpha

    return notes.withColumn("caller", to_alpha(F.row_number().over(Window.partitionBy(*reset).orderBy(order))))


def best(readings: DataFrame, key: list[str], score: str, order: str) -> DataFrame:
    """The reading of highest score of each key, the first in order among equals: one aggregate, sums of which meet in each task first."""
    kept = [c for c in readings.columns if c not in key]
    found = readings.groupBy(*key).agg(F.max_by(F.struct(*kept), F.struct(F.col(score), -F.col(order))).alias("best"))
    return found.select(*key, "best.*")
