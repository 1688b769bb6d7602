"""Exact deduplication with a heavy-hitter split.

Misra-Gries counters (Spark's ``freqItems``) name the digests that may be
frequent; an exact count verifies them, and the verified winners, at most
``1 / support`` rows, are broadcast so that their copies never shuffle.
Every other digest has fewer than ``support`` of the rows and is resolved by
ordinary shuffles of (row, id, digest) triples. Texts and records never
shuffle to find the copies; to drop them, records are tested against the
broadcast winners and against the ids of the other copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, shared_table, text_or_empty


def text_digest(text):
    """SHA-256 (binary) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(text_or_empty(text)), 256))


#: Copies (digest and id, 40 bytes each) up to which they are broadcast to the records; beyond, they are joined by a shuffle.
COPIES_BROADCAST = 500_000


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return shared_table(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("digest")), "digests")


def _split(keys: DataFrame, support: float) -> tuple[DataFrame, DataFrame]:
    """(digest, best, group_size) of the frequent digests, at most 1 / support of them, and of the others that occur twice or more."""
    total = keys.count()
    frequent = keys.select(F.xxhash64("digest").alias("key")).stat.freqItems(["key"], support).head()[0] if total else []
    candidate = F.xxhash64("digest").isin([int(k) for k in frequent or []])
    best = F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")
    counted = keys.where(candidate).groupBy("digest").agg(*best).where(F.col("group_size") >= max(2, int(support * total)))
    winners = shared_table(counted.select("digest", "best", "group_size"), "frequent-digests")
    others = keys.join(F.broadcast(winners.select(F.col("digest").alias("w_digest"))), F.col("digest") == F.col("w_digest"), "left_anti")
    groups = shared_table(others.groupBy("digest").agg(*best).where("group_size > 1").select(F.col("digest").alias("g_digest"), "best", "group_size"), "copied-digests")
    return winners, groups


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Texts are equal if identical after lower-casing A-Z. The row with the
    largest id of a group stays. Null text: as empty. Null id: smaller than
    any id; a group without ids has a null keep_id. Rows that agree in id and
    text: exactly one is kept. Empty input: no rows. Other columns of the
    input are not read. ``support``: the share of rows from which a digest is
    frequent; 1/support bounds the counters and the broadcast.
    """
    keys = _keys(docs, id_col, text_col)
    winners, groups = _split(keys, support)
    winners = F.broadcast(winners)
    hot = keys.join(winners, "digest").select("digest", "row", "id", "best", "group_size")
    rest = keys.join(winners, "digest", "left_anti").join(groups, F.col("digest") == F.col("g_digest"), "left")
    alone = F.struct("id", "row")
    rest = rest.select("digest", "row", "id", F.coalesce("best", alone).alias("best"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    return hot.unionByName(rest).select(F.col("id").alias("id"), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they were (one of rows that agree in id and text).

    Copies of frequent digests go at the scan, by the broadcast winners; the
    others by their digests and ids, which are broadcast if they are few.
    Only rows that agree with a kept one in id and text are grouped with their
    records, one record staying in each task before any moves.
    """
    keys = _keys(docs, id_col, text_col)
    winners, groups = _split(keys, support)
    copied = shared_table(keys.join(groups, F.col("digest") == F.col("g_digest")).select("digest", "id", "best"), "copies")
    gone = copied.where(~F.col("id").eqNullSafe(F.col("best.id"))).select(F.col("digest").alias("g_digest"), F.col("id").alias("g_id")).distinct()
    gone = shared_table(gone, "dropped-copies")
    hot = winners.select(F.col("digest").alias("w_digest"), F.col("best.id").alias("w_id"))
    at_best = keys.join(F.broadcast(hot), (F.col("digest") == F.col("w_digest")) & F.col("id").eqNullSafe(F.col("w_id"))).select("digest", "id")
    at_best = at_best.unionByName(copied.where(F.col("id").eqNullSafe(F.col("best.id"))).select("digest", "id"))
    repeated = shared_table(at_best.groupBy(F.col("digest").alias("r_digest"), F.col("id").alias("r_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated-rows")
    small = lambda table: F.broadcast(table) if table.count() <= COPIES_BROADCAST else table
    records = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"), F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("digest"))
    records = records.join(F.broadcast(hot), F.col("digest") == F.col("w_digest"), "left").where(F.col("w_digest").isNull() | F.col("id").eqNullSafe(F.col("w_id")))
    records = records.join(small(gone), (F.col("digest") == F.col("g_digest")) & F.col("id").eqNullSafe(F.col("g_id")), "left_anti")
    if repeated.isEmpty():
        return records.select("rec.*")
    again = (F.col("digest") == F.col("r_digest")) & F.col("id").eqNullSafe(F.col("r_id"))
    few = small(repeated)
    one = records.join(few, again, "left_semi").groupBy("digest", "id").agg(F.first("rec").alias("rec"))
    return records.join(few, again, "left_anti").select("rec").unionByName(one.select("rec")).select("rec.*")
