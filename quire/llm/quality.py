"""Quality rules with host verdicts.

Text rules are counted per document inside one scan. Failures are then
aggregated by host, each host's failure rate is shrunk towards the corpus
with a beta prior fitted to the hosts themselves (method of moments), and
hosts whose shrunk rate is too high lose all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, shared_table, text_or_empty, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Up to this many rejected hosts are broadcast; beyond, the join is salted.
HOSTS_BROADCAST = 100_000
SALTS = 64


def _repeat_words(w: Column) -> Column:
    """Words that lie in windows of five words found twice or more."""
    size = F.size(w)

    def of_windows(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            last = F.size(p) - 1
            like = lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(p, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(F.filter(p, like), lambda x: x["i"]))

        def covered(s: Column) -> Column:
            gaps = F.transform(s, lambda x, k: F.when(k == F.size(s) - 1, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(s, k + 1) - x)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(by_hash, starts), covered))

    hashes = F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(size < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, of_windows))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def rule_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs); null text has none of any."""
    whole = text_or_empty(text)

    def counts(t: Column) -> Column:
        return let(
            words(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                _dup_lines(t).alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
            ),
        )

    return let(whole, counts)


def base_failed(least_words: int = 10, repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def host_rates(rows: DataFrame, host: str = "host", failed: str = "failed", weight: float = 10.0) -> DataFrame:
    """host, n, fails, rate: the mean of the beta posterior of each host's failure rate.

    The prior's mean and strength are fitted by moments to the hosts' raw
    rates; where these do not vary (or vary more than a beta can), its
    strength is ``weight`` documents. Rows without host are not aggregated.
    """
    hosts = rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("fails"))
    hosts = shared_table(hosts, "hosts")
    m, v = hosts.agg(F.avg(F.col("fails") / F.col("n")), F.var_pop(F.col("fails") / F.col("n"))).head()
    m, v = m or 0.0, v or 0.0
    strength = m * (1 - m) / v - 1 if v > 1e-9 else weight
    strength = strength if strength > 0 else weight
    return hosts.withColumn("rate", (F.lit(m * strength) + F.col("fails")) / (F.lit(strength) + F.col("n")))


def join_hosts(rows: DataFrame, rejected: DataFrame, host: str = "host", most: int = HOSTS_BROADCAST) -> DataFrame:
    """``rows`` and ``host_rejected``; ``rejected`` has one row per rejected host. No host's rows meet in one task: few hosts are broadcast, many are joined by salted keys."""
    bad = rejected.select(F.col("host").alias("bad_host"))
    if rejected.count() <= most:
        joined = rows.join(F.broadcast(bad), F.col(host) == F.col("bad_host"), "left")
    else:
        salted = bad.withColumn("bad_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("row_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, (F.col(host) == F.col("bad_host")) & (F.col("row_salt") == F.col("bad_salt")), "left").drop("row_salt", "bad_salt")
    return joined.withColumn("host_rejected", F.col("bad_host").isNotNull()).drop("bad_host")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_rate: float = 0.6) -> DataFrame:
    """One row per input row: id, host, the five counts, failed, kept.

    Null text has no words and fails. Rows without host are judged by their
    text alone. Repeated rows count as often as they occur. Empty input: no
    rows. A host is rejected if its shrunk failure rate exceeds ``most_rate``.
    """
    rows = shared_table(_judged(docs, id_col, text_col, host_col), "quality")
    rejected = host_rates(rows).where(F.col("rate") > most_rate)
    return join_hosts(rows, rejected).withColumn("kept", ~F.col("failed") & ~F.col("host_rejected")).drop("host_rejected")


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, *more: Column) -> DataFrame:
    counted = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), rule_counts(F.col(text_col)).alias("c"), *more)
    return counted.select("id", "host", "c.*", *(["record"] if more else [])).withColumn("failed", base_failed())


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_rate: float = 0.6) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    As ``judge`` decides. The texts are counted in one pass that also writes
    the records that pass their own rules; the host verdicts are then joined
    to these.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    rows = shared_table(_judged(docs, id_col, text_col, host_col, record).select("host", "failed", F.when(~F.col("failed"), F.col("record")).alias("record")), "quality")
    rejected = host_rates(rows.select("host", "failed")).where(F.col("rate") > most_rate)
    return join_hosts(rows.where("NOT failed").select("host", "record"), rejected).where("NOT host_rejected").select("record.*")
