"""Attributes in the order of a document: assignments, counters and references are a fold over its lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.inline import INTRINSIC
from quire.operators.catalog import successor

REFERENCE = re.compile(r"\\?\{(?:(set|counter2?):)?([\w][\w-]*)(?::([^{}]*))?\}")
ENTRY = re.compile(r"^:(!?[\w][\w-]*!?):(?:[ \t]+(.*))?$")


def fold(lines: list[str], attrs: dict[str, str], missing: str = "skip") -> list[str]:
    """Lines with attribute entries taken out, and references, counters and assignments carried out in order.

    An integer counter counts up, another takes its string successor; a line
    that held nothing but assignments goes.
    """
    held, out = {k.lower(): v for k, v in attrs.items()}, []
    for line in lines:
        entry = ENTRY.match(line)
        if entry:
            name = entry[1].strip("!").lower()
            if "!" in entry[1]:
                held.pop(name, None)
            else:
                held[name] = entry[2] or ""
            continue
        drop = False

        def replaced(m):
            nonlocal drop
            if m[0].startswith("\\"):
                return m[0][1:]
            kind, name, seed = m[1], m[2].lower(), m[3]
            if kind == "set":
                held[name] = seed or ""
                return "\0"
            if kind:
                now = held.get(name)
                if now is None:
                    now = seed if seed else "1"
                else:
                    now = str(int(now) + 1) if re.fullmatch(r"-?\d+", now) else successor(now)
                held[name] = now
                return "\0" if kind == "counter2" else now
            value = held.get(name, INTRINSIC.get(name))
            if value is None:
                if missing == "drop-line":
                    drop = True
                return m[0] if missing == "skip" else "\0"
            return value

        text = REFERENCE.sub(replaced, line) if "{" in line else line
        bare = text.replace("\0", "")
        if not drop and not (text != bare and not bare.strip()):
            out.append(bare)
    return out


def apply(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", attrs: str | None = None, missing: str = "skip") -> DataFrame:
    """doc_id, text with attributes applied, a document at a time."""
    given = F.col(attrs) if attrs else F.create_map().cast("map<string,string>")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            done = [None if t is None else "\n".join(fold(t.split("\n"), dict(a or []), missing)) for t, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"), given.alias("attrs")).mapInArrow(run, "doc_id string, text string")
