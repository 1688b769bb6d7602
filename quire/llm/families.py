"""Links inside families: groups of items of which any two may link.

Families come from candidate filters and may have any size, up to a large
share of all items. Small ones are compared in one group. Of a large one, a
few leaders are compared with all members first; what links to leaders is
connected by that, so members of the largest class so found need not be
compared with each other. Only the others are compared with the members of
near enough bands, in blocks. Every pair that may link is either compared or
connected already, so no link between classes is lost, and m near copies cost
some m comparisons instead of their square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table, tidy_group
from .graph import components

#: Items of one side of a comparison. Families up to this size are one group.
BLOCK = 256
#: Leaders of a large family, about.
LEADERS = 8
#: Rows of small tables (families, bands) up to which they are broadcast, some 40 bytes each; beyond, they are joined by a shuffle.
FEW = 200_000


def small(table: DataFrame, most: int = FEW) -> DataFrame:
    """Marked for broadcast if it was counted and is small; for tables that are written already."""
    return F.broadcast(table) if table.count() <= most else table


def _compared(placed: DataFrame, keys: list[str], compare, tasks: int, nth=None) -> DataFrame:
    """Edges (a, b) from groups of rows (node, payload, side) with the same keys: left (side -1) against right (side 1), or all of them (side 0) with each other. ``nth``: number of a group in its family; those of one family are dealt to tasks in turns."""
    turn = F.lit(0) if nth is None else F.pmod(nth, F.lit(tasks))
    task = F.pmod(F.pmod(F.xxhash64("component"), F.lit(tasks)) + turn, F.lit(tasks)).cast("int").alias("task")

    def run(table):
        import pyarrow as pa

        nodes, payloads, sides = (table.column(c).to_pylist() for c in ("node", "payload", "side"))
        groups: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(*(table.column(c).to_pylist() for c in keys), strict=True)):
            groups.setdefault(key, []).append(k)
        a, b = [], []
        for members in groups.values():
            left = [k for k in members if sides[k] <= 0]
            right = left if sides[members[0]] == 0 else [k for k in members if sides[k] > 0]
            for x, y in compare([nodes[k] for k in left], [payloads[k] for k in left], *((None, None) if right is left else ([nodes[k] for k in right], [payloads[k] for k in right]))):
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.select("node", "payload", "side", *keys, task).repartition(tasks, "task").groupBy("task").applyInArrow(tidy_group(run), "a long, b long")


def family_components(items: DataFrame, families: DataFrame, compare, tasks: int, label: str, block: int = BLOCK) -> DataFrame:
    """node and component of every node with a link: components of the links inside families.

    ``items``: node (unique), band and payload; two items can only link if
    their bands are equal or neighbours. ``families``: node, component.
    ``compare(nodes, payloads, other_nodes, other_payloads)`` gives pairs of
    nodes that connect all that link between the two lists, or, without the
    others, within the one. ``block``: items of one side of a comparison of
    those outside the main class; each is copied to a large family's size by
    it. Families without items: no rows.
    """
    large = shared_table(families.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK).withColumnRenamed("component", "large"), f"{label}-large")
    sized = families.join(small(large), F.col("component") == F.col("large"), "left").select(F.col("node").alias("member"), "component", "size")
    placed = shared_table(items.join(sized, F.col("node") == F.col("member")).select("node", "band", "payload", "component", "size"), f"{label}-items")
    edges = _compared(placed.where("size IS NULL").withColumn("side", F.lit(0)), ["component"], compare, tasks)
    if large.isEmpty():
        return components(edges, f"{label}-links")
    big = placed.where("size IS NOT NULL")
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = big.select("node", "payload", F.lit(1).alias("side"), "component", F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"))
    leads = F.pmod(F.xxhash64(F.lit(7), "node"), F.ceil(F.col("size") / LEADERS)) == 0
    leaders = big.where(leads).select("node", "payload", F.lit(-1).alias("side"), "component", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    led = shared_table(_compared(members.unionByName(leaders), ["component", "chunk"], compare, tasks, F.col("chunk")), f"{label}-led")
    joined = components(led, f"{label}-led").select(F.col("node").alias("led_node"), F.col("component").alias("led_class"))
    state = big.select("node", "band", "component").join(joined, F.col("node") == F.col("led_node"), "left").select("node", "band", "component", F.coalesce("led_class", "node").alias("class"))
    state = shared_table(state, f"{label}-classes")
    classes = state.groupBy("component", "class").agg(F.count(F.lit(1)).alias("n"))
    main = shared_table(classes.groupBy(F.col("component").alias("m_component")).agg(F.max(F.struct("n", "class"))["class"].alias("main")), f"{label}-main")
    others = shared_table(state.join(small(main), F.col("component") == F.col("m_component")).where("class <> main").select("node", "band", "component"), f"{label}-others")
    if others.isEmpty():
        return components(edges.unionByName(led), f"{label}-links")
    blocks = lambda rows, name: rows.groupBy("component", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    low = blocks(others, "rows").select(F.col("component").alias("m_component"), F.col("band").alias("low"), "rows", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("high"))
    meets = low.join(blocks(state, "columns"), (F.col("m_component") == F.col("component")) & (F.col("high") == F.col("band"))).drop("component", "band")
    meets = small(shared_table(meets, f"{label}-meets"))
    key = F.struct("component", "low", "high").alias("cell")
    of_others = others.join(meets, (F.col("component") == F.col("m_component")) & (F.col("band") == F.col("low")))
    of_others = of_others.select("node", F.lit(-1).alias("side"), key, F.pmod(F.xxhash64("node"), F.col("rows")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
    of_all = state.join(meets, (F.col("component") == F.col("m_component")) & (F.col("band") == F.col("high")))
    of_all = of_all.select("node", F.lit(1).alias("side"), key, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(F.xxhash64("node"), F.col("columns")).cast("int").alias("j"))
    cells = of_others.unionByName(of_all).withColumnRenamed("node", "member")
    cells = cells.join(big.select("node", "payload"), F.col("node") == F.col("member")).select("node", "payload", "side", "cell.*", "i", "j")
    rest = _compared(cells, ["component", "low", "high", "i", "j"], compare, tasks, F.col("low") * 31 + F.col("high") * 7 + F.col("i").cast("long") * 1009 + F.col("j"))
    return components(edges.unionByName(led).unionByName(rest), f"{label}-links")
