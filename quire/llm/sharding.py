"""Two-pass external shuffle into shards.

Pass one scatters records by a seeded hash into memory-sized buckets (one
exchange). Pass two orders each bucket canonically, applies Fisher-Yates
(Spark's ``shuffle``, seeded) and numbers the records from the bucket's
offset, so that the shuffled corpus is one gapless sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table, text_or_empty

#: Rows that agree in their scatter hash from which on they are dealt copy by copy.
HOT_ROWS = 10_000
#: Up to this many buckets (16 bytes each) their offsets are broadcast; beyond, they are joined by a shuffle.
OFFSETS_BROADCAST = 500_000


def shuffle_records(records: DataFrame, key: Column, size: Column, seed: int = 17, bucket_bytes: int = 64 << 20, least_buckets: int = 64) -> DataFrame:
    """``record`` (a struct of all columns of the input), ``bucket`` and ``position``, gapless from 0 over the whole shuffled table.

    ``key``: what the scatter hash reads, any type (nulls allowed); it should
    tell rows apart. Rows that agree in it share a bucket, but for HOT_ROWS
    and more of them: equal ones of these are counted (each task first) and
    dealt copy by copy, so that repeated rows, however many, spread over all
    buckets. ``size``: bytes of a record, for the number of buckets. Repeated
    rows are all kept. Empty input: no rows. Columns of the input, whatever their names, are only seen
    inside ``record``.
    """
    names = [F.col(f"`{c}`") for c in records.columns]
    tagged = records.select(F.xxhash64(F.lit(seed), key).alias("h"), F.struct(*names).alias("record"))
    total = records.agg(F.sum(size)).head()[0] or 0
    buckets = max(least_buckets, -(-int(total) // bucket_bytes))
    tagged = _spread(tagged, seed)
    tagged = tagged.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(buckets)).cast("int"))
    counts = tagged.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if buckets <= OFFSETS_BROADCAST:
        offsets = F.broadcast(offsets)
    filled = tagged.repartitionById(buckets, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("h", "record")).alias("rows"))
    dealt = filled.join(offsets, F.col("bucket") == F.col("b")).select("bucket", "offset", F.shuffle(F.sort_array("rows"), seed).alias("rows"))
    return dealt.select("bucket", "offset", F.posexplode("rows").alias("at", "row")).select("row.record", "bucket", (F.col("offset") + F.col("at")).alias("position"))


def _spread(tagged: DataFrame, seed: int) -> DataFrame:
    """Rows with hashes of their own for the copies of hashes that very many rows have."""
    hot = shared_table(tagged.groupBy(F.col("h").alias("hot_h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_ROWS).select("hot_h"), "hot-rows")
    count = hot.count()
    if not count:
        return tagged
    few = F.broadcast(hot) if count <= OFFSETS_BROADCAST else hot
    same = F.col("h") == F.col("hot_h")
    copies = tagged.join(few, same, "left_semi").groupBy("h", "record").agg(F.count(F.lit(1)).alias("n"))
    dealt = copies.select("h", "record", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).select(F.xxhash64(F.lit(seed), "h", F.xxhash64(F.to_json(F.struct("record"))), "copy").alias("h"), "record")
    return tagged.join(few, same, "left_anti").select("h", "record").unionByName(dealt)


def shard_records(records: DataFrame, key: Column, size: Column, shards: int = 16, **how) -> DataFrame:
    """``record``, ``shard`` (counts at most one apart) and ``slot`` (gapless from 0 in the shard), dealt from the shuffled sequence."""
    return shuffle_records(records, key, size, **how).select("record", F.pmod("position", F.lit(shards)).cast("int").alias("shard"), F.expr(f"position div {int(shards)}").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the records as one folder per shard, each part in slot order."""
    sharded.select("shard", "slot", "record.*").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.octet_length(text_or_empty(text)).cast("long") + 1


def text_crc32(text: Column) -> Column:
    return F.crc32(text_or_empty(text))
