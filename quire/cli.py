"""Batch conversion of files, and checks of units: ``python -m quire.cli convert -b html5 -D out docs/*.adoc``.

Files are read, converted and written by Spark; messages come out in the
order of the files, whatever the order in which they were converted.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of converted files.
SUFFIX = {"html5": ".html", "docbook5": ".xml", "manpage": ".1", "epub3": ".epub", "pdf": ".pdf"}


def options(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quire")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("convert", help="convert files")
    c.add_argument("files", nargs="+")
    c.add_argument("-b", "--backend", default="html5", choices=sorted(SUFFIX))
    c.add_argument("-D", "--destination-dir", default=None)
    c.add_argument("-a", "--attribute", action="append", default=[], help="name, name=value, name@=value or !name")
    c.add_argument("-s", "--embedded", action="store_true", help="without head and frame")
    c.add_argument("-n", "--section-numbers", action="store_true")
    c.add_argument("-j", "--jobs", default="*")
    c.add_argument("-t", "--timings", action="store_true")
    c.add_argument("-q", "--quiet", action="store_true")
    c.add_argument("--failure-level", default="fatal", choices=("info", "warning", "error", "fatal"))
    k = commands.add_parser("check", help="report units and problems")
    k.add_argument("files", nargs="+")
    k.add_argument("--scheme", required=True, help="a scheme's YAML file")
    k.add_argument("--json", action="store_true")
    k.add_argument("-j", "--jobs", default="*")
    return parser.parse_args(argv)


def given_attributes(values: list[str]) -> dict[str, str | None]:
    """Overrides by name: ``name=value``, ``name`` (empty), ``!name`` and ``name!`` (unset), with ``@`` at either end of name or value for soft ones."""
    out: dict[str, str | None] = {}
    for v in values:
        name, _, value = v.partition("=")
        out[name] = value
    return out


def sources(spark: SparkSession, files: list[str]) -> DataFrame:
    """doc_id (the path), ord, text of files, in the order given; patterns give theirs by name."""
    from quire.sources.readers import decode

    parts = [spark.read.format("binaryFile").load(f).select(F.lit(i).alias("nth"), F.col("path").alias("doc_id"), decode(F.col("content")).alias("text")) for i, f in enumerate(files)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select("doc_id", F.struct("nth", "doc_id").alias("ord"), "text")


def messages(nodes: DataFrame) -> DataFrame:
    """doc_id, line_no, severity, message: what a conversion has to say about documents: references to ids that are not there, ids that occur twice."""
    from quire.functions import inline

    ids = nodes.where("id IS NOT NULL")
    twice = ids.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("line_no")).where("n > 1").select("doc_id", "line_no", F.lit("warning").alias("severity"), F.concat(F.lit("id assigned to block already in use: "), "id").alias("message"))
    asked = nodes.where(F.col("source").contains("<<")).select("doc_id", "line_no", F.explode(inline.xrefs("source")).alias("x")).select("doc_id", "line_no", "x.target").where(~F.col("target").rlike(r"[#.\s\p{Lu}]"))
    known = ids.select(F.col("doc_id").alias("k_doc"), F.col("id").alias("k_id")).unionByName(_section_ids(nodes))
    lost = asked.join(known, (F.col("doc_id") == F.col("k_doc")) & (F.col("target") == F.col("k_id")), "left_anti").select("doc_id", "line_no", F.lit("info").alias("severity"), F.concat(F.lit("possible invalid reference: "), "target").alias("message"))
    return twice.unionByName(lost)


def _section_ids(nodes: DataFrame) -> DataFrame:
    from quire.plans.pages import section_facts

    return section_facts(nodes).select(F.col("doc_id").alias("k_doc"), F.col("sect_id").alias("k_id"))


def ordered(logs: DataFrame, docs: DataFrame) -> DataFrame:
    """Messages in the order of the files, then of their lines."""
    order = docs.select(F.col("doc_id").alias("o_doc"), "ord")
    return logs.join(order, F.col("doc_id") == F.col("o_doc")).orderBy("ord", "line_no", "message").select("doc_id", "line_no", "severity", "message")


def timing_summary(rows: DataFrame) -> DataFrame:
    """file, read, parse, convert, write, total in seconds: of each file, and of all (``all``)."""
    steps = ["read", "parse", "convert", "write"]
    per = rows.groupBy("file").pivot("step", steps).agg(F.sum("seconds")).select("file", *[F.coalesce(s, F.lit(0.0)).alias(s) for s in steps])
    total = per.agg(*[F.sum(s).alias(s) for s in steps]).select(F.lit("all").alias("file"), *steps)
    return per.unionByName(total).withColumn("total", sum((F.col(s) for s in steps), F.lit(0.0)))


def write_documents(made: DataFrame, out: str, suffix: str) -> DataFrame:
    """Writes each document (doc_id, body as text or bytes) to a file of its own below ``out``, named after its path; returns path and bytes. Files are written where the rows are, through the cluster's file system."""
    column = made.columns[1]
    body = F.col(column) if dict(made.dtypes)[column] == "binary" else F.encode(F.col(column), "UTF-8")
    name = F.concat(F.regexp_replace(F.element_at(F.split("doc_id", "/"), -1), r"\.[^.]*$", ""), F.lit(suffix))
    return made.select(F.concat(F.lit(out.rstrip("/") + "/"), name).alias("path"), body.alias("content"))


def main(argv: list[str] | None = None) -> int:
    args = options(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{args.jobs}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, began = {}, time.time()
    docs = sources(spark, args.files)
    if args.command == "check":
        return check(spark, docs, args)
    from quire.operators import attributes, blocks
    from quire.plans import registry

    overrides = given_attributes(args.attribute)
    text = docs.select("doc_id", "text")
    if overrides:
        attrs = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
        text = attributes.apply(text.withColumn("given", attrs), attrs="given")
    nodes = blocks.parse(text)
    took["parse"], began = time.time() - began, time.time()
    how = {} if args.embedded or args.backend != "html5" else {"standalone": True, "numbers": 3 if args.section_numbers else 0}
    made = registry.convert(nodes, args.backend, **how)
    pairs = write_documents(made, args.destination_dir or ".", SUFFIX[args.backend]).toLocalIterator()
    count = 0
    for row in pairs:  # one file at a time, in bounded memory
        with open(row["path"], "wb") as f:
            f.write(bytes(row["content"]))
        count += 1
    took["convert"] = time.time() - began
    worst = 0
    levels = {"info": 1, "warning": 2, "error": 3, "fatal": 4}
    for m in ordered(messages(nodes), docs).toLocalIterator():
        worst = max(worst, levels[m["severity"]])
        if not args.quiet:
            print(f"{m['doc_id']}: line {m['line_no']}: {m['severity']}: {m['message']}", file=sys.stderr)
    if args.timings:
        print(f"{count} files; " + ", ".join(f"{k}: {v:.2f} s" for k, v in took.items()), file=sys.stderr)
    return int(worst >= levels[args.failure_level])


def check(spark: SparkSession, docs: DataFrame, args: argparse.Namespace) -> int:
    from quire.operators import preprocess, schemes

    with open(args.scheme, encoding="utf-8") as f:
        scheme = schemes.Scheme.read(f.read())
    found = schemes.units(schemes.events(preprocess.lines(docs)), scheme)
    wrong = found.where("problem IS NOT NULL").select("doc_id", F.col("start.line_no").alias("line_no"), "problem")
    reports = schemes.report(found, wrong)
    shown = reports if args.json else schemes.report_lines(reports).withColumnRenamed("text", "report")
    bad = 0
    for r in shown.join(docs.select(F.col("doc_id").alias("o_doc"), "ord"), F.col("doc_id") == F.col("o_doc")).orderBy("ord").select("doc_id", "report").toLocalIterator():
        print(f"{r['doc_id']}\n{r['report']}")
        bad += '"problem"' in r["report"] or "line " in r["report"]
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
