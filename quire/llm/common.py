"""Shared helpers: text normalisation, durable intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract (space, and tab to carriage return), for Java and RE2 patterns.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: The same characters, for trim().
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text, as an array (empty if there are none)."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_CLASS + "+"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often (or inside what lambda) it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (only where unset, in tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is then the cluster's to clean
        pass


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back: lineage ends there, and any executor can read it again.

    The table lives until the application ends (the result is lazy and may be read at any time before), or until ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["quire_path"] = path
    return out


def discard(table: DataFrame) -> None:
    """Remove a shared table, once all that was made of it is written."""
    path = table.__dict__.get("quire_path")
    if path:
        _remove(table.sparkSession, path)


def most_counted(table: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of a written table with the greatest counts: at most ``most``, by a least count that is found from how many rows have which (sixteen steps to each doubling). No sort."""
    step = F.floor(F.log2(F.col(n)) * 16)
    kinds = sorted(((r["step"], r["rows"]) for r in table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    least, held = None, 0
    for s, rows in kinds:
        held += rows
        if held > most:
            break
        least = s
    return table.where(step >= least) if least is not None else table.limit(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def worker_cache(kind: str, key: str, make):
    """An object of this Python worker process, made once and kept for later tasks. One is held at a time: another kind or key frees the one before."""
    import builtins

    held = builtins.__dict__.get("_quire_worker_cache")
    if held is None or held[0] != (kind, key):
        builtins.__dict__["_quire_worker_cache"] = None
        del held
        release()
        held = builtins.__dict__["_quire_worker_cache"] = ((kind, key), make())
    return held[1]


def release() -> None:
    """Give the memory that this Python worker no longer uses back to the system, since workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """A function over Arrow batches that releases memory at the end of its task."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def tidy_group(run):
    """A function over one group's table that releases memory after it."""

    def tidied(table):
        try:
            return run(table)
        finally:
            release()

    return tidied


class Memo(dict):
    """A dictionary that computes what it lacks, of bounded size: the older half goes when ``most`` entries are held twice over."""

    def __init__(self, compute, most: int = 100_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def tidy_pair(run):
    """The same for a function over a group's key and table."""

    def tidied(key, table):
        try:
            return run(key, table)
        finally:
            release()

    return tidied


#: Rows of an Arrow batch: rows hold whole texts here, and ten thousand of them, Spark's own bound, may be gigabytes on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches of this session have at most BATCH_ROWS rows (and BATCH_BYTES bytes, where Spark knows that bound), unless they are set to less."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            found = spark.conf.get(key)  # with a default of ours, this would not give Spark's
        except Exception:  # this Spark has no such bound
            continue
        if not 0 < int(found.rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def gathered(batches, most: int, column: int = 1):
    """Batches put together while their column's bytes stay within ``most``: fewer, larger ones where each has costs of its own."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0

    def whole():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        n = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + n > most:
            yield whole()
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += n
    if held:
        yield whole()


#: Bytes of texts that an Arrow function works on at a time: their words and numbers take many times that.
SLICE_BYTES = 2 << 20


def row_slices(sizes, most: int = SLICE_BYTES):
    """(start, stop) runs of rows whose sizes add up to ``most`` or, for one row, more."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
