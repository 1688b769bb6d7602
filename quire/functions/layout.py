"""Hyphenation and line filling, as Arrow functions over columns of text.

Pattern sets and widths are parameters; no language tables are held here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pattern_table(patterns: list[str]) -> dict[str, list[int]]:
    """Letters of each pattern with the digits between them (``1b2a`` is ``ba`` with 1, 2, 0)."""
    out = {}
    for p in patterns:
        letters, digits = "", [0]
        for c in p:
            if c.isdigit():
                digits[-1] = int(c)
            else:
                letters += c
                digits.append(0)
        out[letters] = digits
    return out


def break_points(word: str, table: dict[str, list[int]], left: int = 2, right: int = 2, exceptions: dict[str, list[int]] | None = None) -> list[int]:
    """Places where a word may be parted: odd after the greatest digits of all patterns that occur."""
    low = word.lower()
    if exceptions and low in exceptions:
        return exceptions[low]
    marked, n = f".{low}.", len(low)
    score = [0] * (len(marked) + 1)
    longest = max(map(len, table), default=0)
    for i in range(len(marked)):
        for j in range(i + 1, min(len(marked), i + longest) + 1):
            for k, d in enumerate(table.get(marked[i:j], ())):
                score[i + k] = max(score[i + k], d)
    return [i for i in range(left, n - right + 1) if score[i + 1] % 2]


def hyphenate(words: DataFrame, patterns: list[str], column: str = "word", left: int = 2, right: int = 2) -> DataFrame:
    """Adds parts: each word with ``-`` where it may be parted. Null stays null."""
    table = pattern_table(patterns)
    fields = words.schema.names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.names.index(column)
            parts = []
            for w in batch.column(at).to_pylist():
                cuts = [] if w is None else break_points(w, table, left, right)
                parts.append(None if w is None else "-".join(w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)], strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.string())], names=[*fields, "parts"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    return words.mapInArrow(run, f"{kind}, parts string")


def first_fit(words: list[str], width: int) -> list[int]:
    """Number of the line of each word when lines are filled greedily; a word too long has a line of its own."""
    out, line, used = [], 0, 0
    for w in words:
        need = len(w) + (1 if used else 0)
        if used and used + need > width:
            line, used, need = line + 1, 0, len(w)
        used += need
        out.append(line)
    return out


def total_fit(words: list[str], width: int) -> list[int]:
    """Number of the line of each word when the sum over lines of the cubed share of free room, the last line's apart, is least."""
    n = len(words)
    ends = [0]
    for w in words:
        ends.append(ends[-1] + len(w))
    best, cut = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(j - 1, -1, -1):
            size = ends[j] - ends[i] + (j - i - 1)
            if size > width and j - i > 1:
                break
            cost = best[i] + (0.0 if j == n or size > width else ((width - size) / width) ** 3)
            if cost < best[j]:
                best[j], cut[j] = cost, i
    out, j, bounds = [0] * n, n, []
    while j > 0:
        bounds.append((cut[j], j))
        j = cut[j]
    for line, (a, b) in enumerate(reversed(bounds)):
        out[a:b] = [line] * (b - a)
    return out


def fill(df: DataFrame, width: int, key: str = "doc_id", text: str = "text", method: str = "first") -> DataFrame:
    """key, lines: how many lines the words of each text take, and filled: the text so filled."""
    fit = {"first": first_fit, "total": total_fit}[method]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            filled = []
            for t in batch.column(1).to_pylist():
                words = (t or "").split()
                rows: dict[int, list] = {}
                for w, i in zip(words, fit(words, width), strict=True):
                    rows.setdefault(i, []).append(w)
                filled.append("\n".join(" ".join(r) for r in rows.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.count("\n") + 1 if f else 0 for f in filled], pa.int32()), pa.array(filled, pa.string())], names=["key", "lines", "filled"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, lines int, filled string").withColumnRenamed("key", key)


def items(text: str, hyphens: dict[str, list[int]] | None = None) -> list[tuple]:
    """A paragraph as boxes (width, text), glue (width, stretch, shrink) and penalties (cost, width, flagged): a glue between words, a flagged penalty where a word may be parted, and at the end a glue that stretches without bound and a break that must be."""
    out: list[tuple] = []
    for i, word in enumerate(text.split()):
        if i:
            out.append(("glue", 1.0, 0.5, 0.33))
        at = 0
        for cut in [*((hyphens or {}).get(word.lower(), [])), len(word)]:
            out.append(("box", float(cut - at), word[at:cut]))
            if cut < len(word):
                out.append(("penalty", 50.0, 1.0, True))
            at = cut
    return [*out, ("glue", 0.0, float("inf"), 0.0), ("penalty", float("-inf"), 0.0, True)]


def demerits(ratio: float, penalty: float, flagged: bool, before_flagged: bool, fit: int, before_fit: int) -> float:
    """What a line costs: the cube of how far its glue is stretched or shrunk, its penalty, and more where two lines in a row end in a hyphen or differ much in tightness."""
    badness = 100 * abs(ratio) ** 3
    line = (1 + badness + max(penalty, 0)) ** 2 - (min(penalty, 0) ** 2 if penalty > float("-inf") else 0)
    return line + (3000 if flagged and before_flagged else 0) + (3000 if abs(fit - before_fit) > 1 else 0)


def best_breaks(parts: list[tuple], width: float, tolerance: float = 2.0) -> list[int]:
    """Places of the breaks of least total demerits; without any within the tolerance, it is raised until there are."""
    widths, stretches, shrinks = [0.0], [0.0], [0.0]
    for p in parts:
        glue = p[0] == "glue"
        widths.append(widths[-1] + (p[1] if p[0] in ("box", "glue") else 0))
        stretches.append(stretches[-1] + (p[2] if glue else 0))
        shrinks.append(shrinks[-1] + (p[3] if glue else 0))
    while True:
        # active: break, its line, tightness, whether it is flagged, cost, the node before
        active = [(-1, 0, 1, False, 0.0, None)]
        for i, p in enumerate(parts):
            legal = p[0] == "penalty" and p[1] < float("inf") or p[0] == "glue" and i and parts[i - 1][0] == "box"
            if not legal:
                continue
            forced, kept, best = p[0] == "penalty" and p[1] == float("-inf"), [], {}
            for node in active:
                start = node[0] + 1
                while start < i and parts[start][0] != "box":
                    start += 1
                size = widths[i] - widths[start] + (p[2] if p[0] == "penalty" else 0)
                stretch, shrink = stretches[i] - stretches[start], shrinks[i] - shrinks[start]
                ratio = 0.0 if size == width else (width - size) / stretch if size < width and stretch else (width - size) / shrink if size > width and shrink else (width - size) * 100 if size < width else -float("inf")
                if ratio >= -1 and not forced:
                    kept.append(node)
                if -1 <= ratio <= tolerance or forced and ratio >= -1:
                    fit = 0 if ratio < -0.5 else 1 if ratio <= 0.5 else 2 if ratio <= 1 else 3
                    flagged = p[0] == "penalty" and p[3]
                    cost = node[4] + demerits(min(ratio, 10.0), p[1] if p[0] == "penalty" else 0.0, flagged and not forced, node[3], fit, node[2])
                    if fit not in best or cost < best[fit][4]:
                        best[fit] = (i, node[1] + 1, fit, flagged and not forced, cost, node)
            active = kept + list(best.values())
            if not active:
                break
        done = [n for n in active if n[0] == len(parts) - 1]
        if done:
            node, out = min(done, key=lambda n: n[4]), []
            while node[5] is not None:
                out.append(node[0])
                node = node[5]
            return out[::-1]
        if tolerance > 1e6:  # a word is wider than the line: lines are filled as they come
            return []
        tolerance *= 10


def justified(text: str, width: int, hyphens: dict[str, list[int]] | None = None) -> list[str]:
    """A paragraph's lines at the best breaks; with a word wider than the line, filled greedily."""
    parts = items(text, hyphens)
    breaks = best_breaks(parts, float(width))
    words = text.split()
    if not breaks:
        rows: dict[int, list[str]] = {}
        for w, line in zip(words, first_fit(words, width), strict=True):
            rows.setdefault(line, []).append(w)
        return [" ".join(r) for r in rows.values()]
    out, start = [], 0
    for b in breaks:
        line = "".join(p[2] if p[0] == "box" else " " if p[0] == "glue" else "" for p in parts[start:b]).strip()
        out.append(line + ("-" if parts[b][0] == "penalty" and parts[b][1] > float("-inf") else ""))
        start = b + 1
    return out


def paginated(heights: list[float], room: float, keep_with_next: list[bool] | None = None, widows: int = 2, lines: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(box, page, lines on it) of boxes put on pages one below the other. A box of lines may be split, at least ``widows`` of them on either side; others, and those kept with the next, move whole. What is higher than a page has one of its own."""
    lines = lines or [1] * len(heights)
    keep = keep_with_next or [False] * len(heights)
    out, page, used, i = [], 0, 0.0, 0
    while i < len(heights):
        chain = [i]
        while keep[chain[-1]] and chain[-1] + 1 < len(heights):
            chain.append(chain[-1] + 1)
        last = chain[-1]
        head = sum(heights[k] for k in chain[:-1])
        step = heights[last] / lines[last]
        least = min(lines[last], widows)
        if used and used + head + least * step > room:
            page, used = page + 1, 0.0
        for k in chain[:-1]:
            out.append((k, page, lines[k]))
        used += head
        left = lines[last]
        while left:
            fits = int((room - used) / step + 1e-9)
            take = left if fits >= left else fits if lines[last] > 1 else 0
            if take < left and left - take < widows:
                take = left - widows
            if take < min(widows, left) or take <= 0:
                if used:
                    page, used = page + 1, 0.0
                    continue
                take = max(1, min(left, fits)) if lines[last] > 1 else left
            out.append((last, page, take))
            used += take * step
            left -= take
            if left:
                page, used = page + 1, 0.0
        i = last + 1
    return out


def balanced_columns(heights: list[float], columns: int) -> list[int]:
    """Column of each box so that the highest column is as low as can be, boxes in order."""
    low, high = max(heights, default=0.0), sum(heights)

    def placed(limit: float) -> list[int] | None:
        out, column, used = [], 0, 0.0
        for h in heights:
            if used and used + h > limit + 1e-9:
                column, used = column + 1, 0.0
            out.append(column)
            used += h
        return out if column < columns else None

    candidates = sorted({round(sum(heights[a:b]), 9) for a in range(len(heights)) for b in range(a + 1, len(heights) + 1) if low - 1e-9 <= sum(heights[a:b]) <= high + 1e-9})
    lo, hi = 0, len(candidates) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if placed(candidates[mid]) is not None else (mid + 1, hi)
    return placed(candidates[lo]) if candidates else []


def table_widths(least: list[float], most: list[float], room: float) -> list[float]:
    """Widths of a table's columns: what they want, if there is room; else what they need, and of what is left in proportion to what they want beyond it."""
    if sum(most) <= room:
        return list(most)
    if sum(least) >= room:
        return [x * room / sum(least) for x in least] if sum(least) else list(least)
    spare, wish = room - sum(least), sum(most) - sum(least)
    return [a + spare * (b - a) / wish for a, b in zip(least, most, strict=True)]


def hyphenator_for(tag: str, sets: dict[str, list[str]], aliases: dict[str, str] | None = None) -> dict[str, list[int]] | None:
    """The pattern table of a language tag: of the tag itself, of what it is another name of, or of its first part; None without any."""
    low = tag.lower().replace("_", "-")
    for name in (low, (aliases or {}).get(low), low.partition("-")[0], (aliases or {}).get(low.partition("-")[0])):
        if name and name in sets:
            return pattern_table(sets[name])
    return None


def runs(markup: str) -> list[dict]:
    """Inline markup as runs of text with their fonts: bold, italic, mono, raised (1 up, -1 down), link; entities are decoded, unknown elements pass their text on."""
    import html
    import re

    out: list[dict] = []
    state: list[tuple[str, dict]] = [("", {"bold": False, "italic": False, "mono": False, "raised": 0, "link": None})]
    marks = {"strong": {"bold": True}, "b": {"bold": True}, "em": {"italic": True}, "i": {"italic": True}, "code": {"mono": True}, "sup": {"raised": 1}, "sub": {"raised": -1}}

    def say(text: str) -> None:
        if text:
            now = state[-1][1]
            if out and {k: v for k, v in out[-1].items() if k != "text"} == now:
                out[-1]["text"] += text
            else:
                out.append({"text": text} | now)

    at = 0
    for m in re.finditer(r"<(/?)([a-zA-Z]+)([^<>]*?)(/?)>", markup):
        say(html.unescape(markup[at : m.start()]))
        at, name = m.end(), m[2].lower()
        if name == "br":
            say("\n")
        elif m[1]:
            depth = next((i for i in range(len(state) - 1, 0, -1) if state[i][0] == name), 0)
            if depth:
                del state[depth:]
        elif not m[4]:
            href = re.search(r'href="([^"]*)"', m[3])
            state.append((name, state[-1][1] | marks.get(name, {}) | ({"link": html.unescape(href[1])} if href else {})))
    say(html.unescape(markup[at:]))
    return out
