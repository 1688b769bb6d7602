"""Vector images: path data as absolute segments, and style rules by selector and specificity."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import kernel

TOKEN = re.compile(r"[MmZzLlHhVvCcSsQqTtAa]|[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
#: How many numbers each command takes.
TAKES = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
SEGMENTS = "array<struct<kind:string,points:array<double>>>"


def _tokens(data: str):
    """Commands and numbers; the flags of an arc may stand without anything between them."""
    at, command, held = 0, "", 0
    while at < len(data):
        if data[at] in " \t\r\n,":
            at += 1
            continue
        if command in ("A", "a") and held % 7 in (3, 4) and data[at] in "01":
            yield float(data[at])
            at, held = at + 1, held + 1
            continue
        m = TOKEN.match(data, at)
        if not m:
            return
        at = m.end()
        if m[0].isalpha():
            command, held = m[0], 0
            yield command
        else:
            held += 1
            yield float(m[0])


def absolute(data: str) -> list[tuple[str, list[float]]]:
    """Segments M, L, C, Q, A and Z with absolute points; short and relative forms are written out. What follows an error is left out, as renderers do."""
    out: list[tuple[str, list[float]]] = []
    x = y = start_x = start_y = 0.0
    control = None
    command, numbers = "", []

    def emit(kind: str, v: list[float]) -> None:
        nonlocal x, y, start_x, start_y, control
        upper, relative = kind.upper(), kind.islower()
        dx, dy = (x, y) if relative else (0.0, 0.0)
        if upper == "Z":
            out.append(("Z", []))
            x, y, control = start_x, start_y, None
            return
        if upper in "HV":
            v = [v[0] + dx, y] if upper == "H" else [x, v[0] + dy]
            upper = "L"
        elif upper == "A":
            v = [abs(v[0]), abs(v[1]), *v[2:5], v[5] + dx, v[6] + dy]
        else:
            v = [n + (dx, dy)[i % 2] for i, n in enumerate(v)]
        mirrored = (2 * x - control[1], 2 * y - control[2]) if control else (x, y)
        if upper == "S":
            v = [*(mirrored if control and control[0] == "C" else (x, y)), *v]
            upper = "C"
        elif upper == "T":
            v = [*(mirrored if control and control[0] == "Q" else (x, y)), *v]
            upper = "Q"
        control = ("C", v[2], v[3]) if upper == "C" else ("Q", v[0], v[1]) if upper == "Q" else None
        x, y = v[-2:]
        if upper == "M":
            start_x, start_y = x, y
        out.append((upper, v))

    for token in _tokens(data):
        if isinstance(token, str):
            if numbers or not out and token not in "Mm":
                break
            command = token
            if command in "Zz":
                emit(command, [])
            continue
        if not command or command in "Zz":
            break
        numbers.append(token)
        if len(numbers) == TAKES[command.upper()]:
            emit(command, numbers)
            numbers = []
            command = {"M": "L", "m": "l"}.get(command, command)  # further pairs after a move are lines
    return out


@kernel(SEGMENTS)
def path_segments(data):
    return [{"kind": k, "points": v} for k, v in absolute(data)]


@kernel("struct<left:double,top:double,right:double,bottom:double>")
def path_box(data):
    """The box around all points of a path, control points included; null without any."""
    points = [p for k, v in absolute(data) for p in ([v[-2:]] if k == "A" else [v[i : i + 2] for i in range(0, len(v), 2)])]
    if not points:
        return None
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return {"left": min(xs), "top": min(ys), "right": max(xs), "bottom": max(ys)}


def parse_selector(selector: str):
    """(type or None, id or None, classes) of ``type#id.class``; None for what is more than that."""
    m = re.fullmatch(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)", selector.strip())
    if not m or not m[0]:
        return None
    ids = re.findall(r"#([\w-]+)", m[2])
    return (None if m[1] in (None, "*") else m[1]), (ids[0] if ids else None), re.findall(r"\.([\w-]+)", m[2])


def stylesheet_rules(css: str) -> list[tuple]:
    """(order, selector, type, id, classes, specificity, property, value) of each declaration, a row for every selector of a list."""
    out = []
    body = re.sub(r"/\*.*?\*/", "", css, flags=re.DOTALL)
    for order, m in enumerate(re.finditer(r"([^{}]+)\{([^{}]*)\}", body)):
        for selector in m[1].split(","):
            parsed = parse_selector(selector)
            if not parsed:
                continue
            kind, key, classes = parsed
            weight = 100 * bool(key) + 10 * len(classes) + bool(kind)
            for declaration in m[2].split(";"):
                name, colon, value = declaration.partition(":")
                if colon and value.strip():
                    out.append((order, selector.strip(), kind, key, classes, weight, name.strip(), value.strip()))
    return out


def matched_styles(elements: DataFrame, css: str) -> DataFrame:
    """element_id, property, value: of each element (element_id, type, id, classes) the declaration that wins: most specific, then last. The rules are a small table, joined by a broadcast."""
    spark = elements.sparkSession
    rules = spark.createDataFrame(stylesheet_rules(css), "rank int, selector string, r_type string, r_id string, r_classes array<string>, weight int, property string, value string")
    applies = (F.col("r_type").isNull() | (F.col("r_type") == F.col("type"))) & (F.col("r_id").isNull() | (F.col("r_id") == F.col("id"))) & (F.size(F.array_except("r_classes", F.coalesce("classes", F.array().cast("array<string>")))) == 0)
    found = elements.join(F.broadcast(rules), applies)
    best = F.row_number().over(Window.partitionBy("element_id", "property").orderBy(F.desc("weight"), F.desc("rank")))
    return found.withColumn("best", best).where("best = 1").select("element_id", "property", "value")
