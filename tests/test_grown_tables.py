"""Queries on keys and values that only larger tables hold, against DuckDB."""

import duckdb
from pyspark.sql import functions as F

from quire.operators import preprocess
from quire.plans import format_queries  # noqa: F401  registers its queries
from quire.plans.queries import QUERIES, SQL


def both(spark, folder, name, table, rows, kind):
    """What Spark and DuckDB return for the query on a table of those rows, each sorted."""
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    df = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.sql(SQL[name]).select(*[f'"{c}"' for c in df.columns]).fetchall()
    return sorted(tuple(r) for r in df.collect()), sorted(found)


def test_unit_labels_of_keys_beyond_four_digits(spark, tmp_path):
    rows = [(k, k % 25) for k in (0, 7, 999, 9999, 10000, 10005, 59999, 123456)]
    given, want = both(spark, tmp_path, "unit_labels", "supplier", rows, "s_suppkey long, s_nationkey int")
    assert given == want and given[4] == (10000, "SUPPLIER 1000 *")


def test_conditionals_of_events_that_share_an_id(spark, tmp_path):
    rows = [(1, "click", 50.5), (1, "view", 60.0), (2, "purchase", 50.0), (2, "purchase", 50.0), (3, "error", -1.0), (4, "signup", 1e9)]
    given, want = both(spark, tmp_path, "conditionals", "events", rows, "event_id long, event_type string, value double")
    assert given == want and len(given) == 7


def test_conditionals_have_a_small_plan(spark):
    """Each use of a bound expression once held all of it: 1.6 million characters for the query, which the driver keeps at every new plan of a stage."""
    docs = spark.createDataFrame([(1, 'ifeval::["{a}" == "x"]\r\n1 \nendif::[]\nifdef::a[]\n2\nifndef::a[no]\nendif::[]\n\\ifdef::x[]\nifndef::b[yes]\nendif'), (2, None), (3, "")], "doc_id int, text string")
    attrs = F.create_map(F.lit("a"), F.lit("x"))
    by_row = preprocess.conditional_texts(docs, attrs)
    by_line = preprocess.conditionals(preprocess.lines(docs).withColumn("attrs", attrs), F.col("attrs")).select("doc_id", "line_no", "text")
    for df in (by_row, by_line):
        assert len(df._jdf.queryExecution().analyzed().toString()) < 50_000
        assert sorted(tuple(r) for r in df.collect()) == [(1, 2, "1"), (1, 5, "2"), (1, 8, "ifdef::x[]"), (1, 9, "yes"), (1, 10, "endif"), (3, 1, "")]
