"""Conversations from messages that quote each other.

Quote levels are parsed from leading ``>`` marks. A quoted passage (a run of
lines of one level) is normalised and hashed, and so are the paragraphs,
lines and whole bodies that messages themselves hold; equal hashes within a
conversation link a quotation to the earliest message it can come from. A
passage that as a whole comes from nowhere is linked by its paragraphs, or
else by its lines, so that trimmed quotations are found. A message replies to the latest message that its outermost linked quotations
come from. Messages come out in reply order, without their quotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, ascii_lower, discard, let, shared_table, text_or_empty

QUOTED = r"^[ \t]*(?:>[ \t]*)+"


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(ascii_lower(text), SPACE_CLASS + "+", " "))


def _lines(text: Column) -> Column:
    """Structs of level and content; a blank line without marks has level -1, so that it parts paragraphs."""

    def line(x: Column) -> Column:
        def parsed(mark: Column) -> Column:
            level = F.length(F.regexp_replace(mark, "[^>]", ""))
            blank = F.btrim(x, F.lit(SPACES)) == ""
            return F.struct(F.when(blank, F.lit(-1)).otherwise(level).alias("level"), F.substr(x, F.length(mark) + 1).alias("content"))

        return let(F.regexp_extract(x, QUOTED, 0), parsed)

    return F.transform(F.split(text, "\n"), line)


def _runs(lines: Column) -> Column:
    """Structs of level, normalised passage and, of quotations, its normalised paragraphs and rows (single lines), a run of lines of one level each; empty passages are left out."""

    def of_starts(starts: Column) -> Column:
        def run(s: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(starts, k + 1), F.size(lines))
            joined = F.array_join(F.transform(F.slice(lines, s + 1, stop - s), lambda x: x["content"]), " ")
            level = F.get(lines, s)["level"]
            rows = F.array_join(F.transform(F.slice(lines, s + 1, stop - s), lambda x: normalised(x["content"])), "\n")
            parts = lambda by: F.when(level > 0, F.array_distinct(F.filter(F.transform(F.split(rows, by), normalised), lambda x: x != "")))
            return F.struct(level.alias("level"), normalised(joined).alias("passage"), parts("\n{2,}").alias("paragraphs"), parts("\n").alias("rows"))

        return F.filter(F.transform(starts, run), lambda r: (r["level"] >= 0) & (r["passage"] != ""))

    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    return let(starts, of_starts)


def _own(lines: Column) -> Column:
    return F.btrim(F.array_join(F.transform(F.filter(lines, lambda x: x["level"] <= 0), lambda x: x["content"]), "\n"), F.lit(SPACES))


def parse(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """row, conv, turn, role, body (without quotations), quotes (run, level, rank and hash of each passage, rank 0, and its paragraphs and lines, ranks 1 and 2) and holds (hashes of what the message itself says)."""
    digest = lambda x: F.unhex(F.sha2(x, 256))

    def parsed(lines: Column) -> Column:
        def hashes(runs: Column) -> Column:
            def quoted(r: Column, i: Column) -> Column:
                ranks = enumerate((F.array(r["passage"]), r["paragraphs"], r["rows"]))
                return F.concat(*[F.transform(x, lambda y, k=k: F.struct(i.alias("run"), r["level"].alias("level"), F.lit(k).alias("rank"), digest(y).alias("hash"))) for k, x in ranks])

            quotes = F.flatten(F.transform(F.filter(runs, lambda r: r["level"] > 0), quoted))
            paragraphs = F.transform(F.filter(runs, lambda r: r["level"] == 0), lambda r: r["passage"])
            single = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: normalised(x["content"]))
            whole = F.array(normalised(_own(lines)))
            holds = F.transform(F.array_distinct(F.filter(F.concat(paragraphs, single, whole), lambda x: x != "")), digest)
            return F.struct(_own(lines).alias("body"), quotes.alias("quotes"), holds.alias("holds"))

        return let(_runs(lines), hashes)

    source = messages.select(F.monotonically_increasing_id().alias("row"), F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), let(_lines(text_or_empty(F.col(text))), parsed).alias("p"))
    return source.select("row", "conv", "turn", "role", "p.*")


def link(parsed: DataFrame) -> DataFrame:
    """row and parent: the message that a message replies to, for messages with a linked quotation."""
    quotes = parsed.select("row", "conv", "turn", F.explode("quotes").alias("q")).select("row", "conv", "turn", "q.*")
    held = parsed.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", F.explode("holds").alias("held_hash"), F.struct("turn", "row").alias("at"))
    first = held.groupBy(F.col("conv").alias("held_conv"), "held_hash").agg(F.min("at").alias("origin"))
    linked = quotes.join(first, (F.col("conv") == F.col("held_conv")) & (F.col("hash") == F.col("held_hash"))).where(F.col("origin.turn") < F.col("turn"))
    # of each run, what the largest parts of it come from
    closest = F.max(F.struct((-F.col("rank")).alias("whole"), F.col("origin.turn").alias("turn"), F.col("origin.row").alias("row")))
    runs = linked.groupBy("row", "run", "level").agg(closest.alias("origin"))
    best = F.max(F.struct((-F.col("level")).alias("outer"), F.col("origin.turn").alias("turn"), F.col("origin.row").alias("row")))
    return runs.groupBy("row").agg(best.alias("best")).select("row", F.col("best.row").alias("parent"))


def reply_roots(parents: DataFrame, rows: DataFrame) -> DataFrame:
    """row, root, depth for rows (row) with their parents, by pointer doubling: as many joins as the depth has bits."""
    state = shared_table(rows.join(parents.withColumnRenamed("row", "child"), F.col("row") == F.col("child"), "left").select("row", F.col("parent").alias("up"), F.coalesce("parent", "row").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")), "replies")
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("row").alias("a_row"), F.col("up").alias("a_up"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"))
        joined = state.join(above, F.col("up") == F.col("a_row"), "left")
        before, state = state, shared_table(joined.select("row", F.col("a_up").alias("up"), F.coalesce("a_root", "root").alias("root"), (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth")), "replies")
        discard(before)
    return state.select("row", "root", "depth")


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``position``, from 0 in each group by ``order``. A group may have any share of the rows: ranges of the order are counted apart and then added up."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = shared_table(rows.repartitionByRange(ranges, F.col(group), *map(F.col, order)).withColumn("range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(F.col(group).alias("c_group"), F.col("range").alias("c_range")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c_group").orderBy("c_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("c_group", "c_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = placed.withColumn("nth", F.row_number().over(Window.partitionBy(group, "range").orderBy(*order)))
    joined = local.join(offsets, (F.col("range") == F.col("c_range")) & F.col(group).eqNullSafe(F.col("c_group")))
    return joined.withColumn("position", F.col("offset") + F.col("nth") - 1).drop("nth", "offset", "c_group", "c_range", "range")


def reply_order(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv, turn, role, body, parent_turn, root_turn, depth, position.

    ``position`` counts from 0 in the conversation: threads by the turn of
    their first message, within a thread by depth and then turn, so that each
    reply follows what it replies to. Null text is an empty body. Messages
    without conversation or turn are linked with nothing; those without
    conversation are numbered together. Repeated messages all stay. Empty
    input: no rows. Other columns are not read.
    """
    parsed = shared_table(parse(messages, conv, turn, role, text), "messages")
    parents = shared_table(link(parsed), "parents")
    roots = reply_roots(parents, parsed.select("row"))
    plain = parsed.select("row", "conv", "turn", "role", "body")
    turns = parsed.select(F.col("row").alias("t_row"), F.col("turn").alias("t_turn"))
    placed = plain.join(roots.withColumnRenamed("row", "r_row"), F.col("row") == F.col("r_row")).drop("r_row")
    placed = placed.join(turns.select(F.col("t_row").alias("root_row"), F.col("t_turn").alias("root_turn")), F.col("root") == F.col("root_row")).drop("root_row", "root")
    named = parents.join(turns, F.col("parent") == F.col("t_row")).select(F.col("row").alias("p_row"), F.col("t_turn").alias("parent_turn"))
    placed = placed.join(named, F.col("row") == F.col("p_row"), "left").drop("p_row")
    return ranked(placed, "conv", ["root_turn", "depth", "turn", "row"]).select("conv", "turn", "role", "body", "parent_turn", "root_turn", "depth", "position")
