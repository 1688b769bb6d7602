"""Made-up and disguised texts: random numbers, words of the same shape, scrambled and mutated documents, and the smallest part of a document that still shows something."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import kernel

MASK = (1 << 64) - 1
WORD = re.compile(r"[^\W\d_]+")


class SplitMix:
    """The SplitMix64 generator: a state that counts up by an odd constant, mixed into each number."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        return z ^ (z >> 31)

    def below(self, n: int) -> int:
        """Evenly from 0 to n - 1: numbers of the incomplete last round are drawn anew."""
        most = (1 << 64) - (1 << 64) % n
        while (x := self.next()) >= most:
            pass
        return x % n

    def unit(self) -> float:
        return (self.next() >> 11) / (1 << 53)

    def pick(self, items):
        return items[self.below(len(items))]


def random_longs(spark, seed: int, count: int) -> DataFrame:
    """nth (from 0) and value (unsigned, as a decimal): the generator's numbers, made apart from each other, as the state of each is known."""
    step = kernel("decimal(20,0)")(_number(seed))
    return spark.range(count).select(F.col("id").alias("nth"), step("id").alias("value"))


def _number(seed: int):
    def made(n):
        from decimal import Decimal

        return Decimal(SplitMix((seed + n * 0x9E3779B97F4A7C15) & MASK).next())

    return made


#: What pseudo-words are made of, in turns.
CONSONANTS, VOWELS = "bcdfghjklmnprstvwz", "aeiou"


def pseudo_word(word: str, salt: str = "") -> str:
    """A word of the same shape: as long, capitals where they are, the same for the same word. Letters without case, and those of other scripts, stand for themselves."""
    draw = SplitMix(int.from_bytes(hashlib.blake2b(f"{salt}\0{word.lower()}".encode(), digest_size=8).digest(), "big"))
    vowel = draw.below(2) == 1
    out = []
    for c in word:
        if not (c.isascii() and c.isalpha()):
            out.append(c)
            continue
        letter = draw.pick(VOWELS if vowel else CONSONANTS)
        vowel = not vowel
        out.append(letter.upper() if c.isupper() else letter)
    return "".join(out)


def word_map(words: DataFrame, salt: str = "", column: str = "word") -> DataFrame:
    """word, disguise: a one-to-one map of a vocabulary (lower-cased, distinct). Where two words would get one disguise, all but the first are drawn again with their number as salt, which is joined by the disguise alone."""
    low = words.select(F.lower(F.col(column)).alias("word")).where("word IS NOT NULL AND word <> ''").distinct()
    made = kernel("string")(lambda w, n: pseudo_word(w, salt + (f"#{n}" if n else "")))
    taken, left = None, low.withColumn("turn", F.lit(0))
    from pyspark.sql import Window

    from quire.durable import durable

    for turn in range(64):
        drawn = durable(left.select("word", made("word", F.lit(turn)).alias("disguise")), "disguises")
        if taken is not None:
            drawn = drawn.join(taken.select(F.col("disguise").alias("held")), F.col("disguise") == F.col("held"), "left").withColumn("first", F.when(F.col("held").isNull(), F.row_number().over(Window.partitionBy("disguise").orderBy("word"))))
        else:
            drawn = drawn.withColumn("first", F.row_number().over(Window.partitionBy("disguise").orderBy("word")))
        won = durable(drawn.where("first = 1").select("word", "disguise"), "disguises")
        taken = won if taken is None else durable(taken.unionByName(won), "disguises")
        left = durable(drawn.where("first IS NULL OR first > 1").select("word"), "words")
        if left.isEmpty():
            return taken
    # words so short that all of their shapes are taken stay as they are, marked by a number
    return taken.unionByName(left.select("word", F.concat("word", F.lit("0")).alias("disguise")))


def scrambled_text(text: str, salt: str = "") -> str:
    """A text with each of its words disguised, everything else as it is."""
    return WORD.sub(lambda m: pseudo_word(m[0], salt), text)


def scramble(text, salt: str = "") -> Column:
    return kernel("string")(lambda t: scrambled_text(t, salt))(text)


#: What is markup in a line, and must stay: names of attributes, directives, macros, options, delimiters.
MARKUP = re.compile(r"^:!?[\w-]+!?:|^(?:if(?:n?def|eval)|endif|include)::[^\n]*$|\[[^\]\n]*\]|\{[\w:-]+\}|\b[a-z][\w-]*::?(?=\S*\[)|https?://\S+|<<[^>\n]*>>|&#?\w+;|^(?:NOTE|TIP|IMPORTANT|WARNING|CAUTION):", re.MULTILINE)


def sanitized_text(text: str, keep: frozenset[str] = frozenset(), salt: str = "") -> str:
    """A document with its prose disguised and its markup kept: what a parser looks at stays, as do words in ``keep``."""
    out, at = [], 0
    hide = lambda part: WORD.sub(lambda m: m[0] if m[0].lower() in keep else pseudo_word(m[0], salt), part)
    for m in MARKUP.finditer(text):
        out += [hide(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, hide(text[at:])])


def sanitize(text, keep: tuple[str, ...] = (), salt: str = "") -> Column:
    kept = frozenset(w.lower() for w in keep)
    return kernel("string")(lambda t: sanitized_text(t, kept, salt))(text)


#: What a mutation puts in, besides pieces of the text itself.
SNIPPETS = ["----", "====", "|===", "....", "****", "++++", "____", "--", "* ", ". ", "term:: ", "[source]", "[[id]]", "ifdef::x[]", "endif::[]", "include::x[]", ":name: value", "{name}", "<<id>>", "footnote:[x]", "image::x[]", "== ", "\\", "\t", " ", "\0", "<1>", "`", "*", "_", "#"]


def mutated_text(text: str, seed: int, edits: int = 4) -> str:
    """The text after some random edits: pieces taken out, doubled, swapped, or put in, characters changed. The same seed gives the same edits."""
    draw, lines = SplitMix(seed), text.split("\n")
    for _ in range(1 + draw.below(max(1, edits))):
        kind, at = draw.below(7), draw.below(len(lines))
        if kind == 0 and len(lines) > 1:
            del lines[at : at + 1 + draw.below(3)]
        elif kind == 1:
            lines[at:at] = lines[at : at + 1 + draw.below(3)]
        elif kind == 2:
            lines.insert(at, draw.pick(SNIPPETS))
        elif kind == 3:
            other = draw.below(len(lines))
            lines[at], lines[other] = lines[other], lines[at]
        elif lines[at]:
            line = lines[at]
            p = draw.below(len(line))
            lines[at] = line[:p] + ("" if kind == 4 else draw.pick(SNIPPETS) if kind == 5 else chr(32 + draw.below(95))) + line[p + (kind != 5) :]
        lines = lines or [""]
    return "\n".join(lines)


def mutate(text, seed, edits: int = 4) -> Column:
    return kernel("string")(lambda t, s: mutated_text(t, s or 0, edits))(text, seed)


def smallest(parts: list, shows) -> list:
    """Delta debugging: a list of parts from which none can be left out (one by one) without that ``shows(parts)`` ends. Chunks of half the list are tried first, then ever smaller ones."""
    n = 2
    while len(parts) >= 2:
        size = -(-len(parts) // n)
        for a in range(0, len(parts), size):
            rest = parts[:a] + parts[a + size :]
            if shows(rest):
                parts, n = rest, max(n - 1, 2)
                break
        else:
            if size == 1:
                return parts
            n = min(2 * n, len(parts))
    return [] if parts and shows([]) else parts


def reduced(df: DataFrame, shows, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text: each text cut down to lines that all matter to ``shows(text)``: paragraphs first, then lines. Texts that do not show it are left out."""

    def cut(t):
        if not shows(t):
            return None
        blocks = smallest(re.split(r"(?<=\n)\n+", t), lambda p: shows("\n".join(p)))
        lines = smallest("\n".join(blocks).split("\n"), lambda p: shows("\n".join(p)))
        return "\n".join(lines)

    return df.select(key, kernel("string")(cut)(F.col(text)).alias("text")).where("text IS NOT NULL")


def random_document(seed: int, blocks: int = 12) -> str:
    """A document of random blocks, which always is well formed: the same for the same seed."""
    draw = SplitMix(seed)
    word = lambda: "".join(draw.pick(VOWELS if i % 2 else CONSONANTS) for i in range(2 + draw.below(6)))
    prose = lambda n: " ".join(draw.pick([word, word, word, lambda: f"*{word()}*", lambda: f"_{word()}_", lambda: f"`{word()}`"])() for _ in range(1 + draw.below(n)))

    def item(mark: str) -> str:
        return "\n".join(f"{mark} {prose(6)}" for _ in range(1 + draw.below(4)))

    def table() -> str:
        columns = 1 + draw.below(4)
        return "\n".join(["|===", *("|" + " |".join(word() for _ in range(columns)) for _ in range(1 + draw.below(4))), "|==="])

    makers = [
        lambda: prose(30), lambda: prose(30), lambda: item("*"), lambda: item("."), table, lambda: f"[source,{draw.pick(['python', 'dart', 'sql'])}]\n----\n{word()} = {draw.below(100)}\n----", lambda: f"{draw.pick(['NOTE', 'TIP', 'WARNING'])}: {prose(10)}",
        lambda: f"====\n{prose(12)}\n====", lambda: f"[quote]\n____\n{prose(12)}\n____", lambda: f"image::{word()}.png[{word()}]", lambda: f"{word()}:: {prose(5)}\n{word()}:: {prose(5)}", lambda: "'''",
    ]
    out, level = [f"= {prose(4)}", ""], 1
    for _ in range(1 + draw.below(blocks)):
        if draw.below(4) == 0:
            level = 1 + draw.below(min(level + 1, 4))
            out += ["=" * (level + 1) + " " + word().capitalize(), ""]
        out += [draw.pick(makers)(), ""]
    return "\n".join(out)


def random_documents(spark, seed: int, count: int, blocks: int = 12) -> DataFrame:
    """doc_id, text: documents from seeds of their own, made in parallel."""
    made = kernel("string")(lambda n: random_document(SplitMix(seed * 1_000_003 + n).next(), blocks))
    return spark.range(count).select(F.col("id").alias("doc_id"), made("id").alias("text"))


def shape_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """shape, n: how often words of each shape occur."""
    from .text import shape

    words = texts.select(F.explode(F.split(F.col(column), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy(shape("word").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def coverage(reach: DataFrame, pool: str = "profile") -> DataFrame:
    """profile, reached: distinct items that each profile reaches, and ``all`` for those that any does."""
    by = reach.groupBy(F.col(pool).cast("string").alias("profile")).agg(F.countDistinct("item").alias("reached"))
    return by.unionByName(reach.agg(F.countDistinct("item").alias("reached")).select(F.lit("all").alias("profile"), "reached"))


def uncovered(reachable: DataFrame, reached: DataFrame) -> DataFrame:
    """Items that could be reached but are not."""
    return reachable.select("item").distinct().join(reached.select("item").distinct(), "item", "left_anti")


def fuzz(spark, check, seeds: list[str], rounds: int = 4, each: int = 64, seed: int = 1, seconds: float = 60.0) -> DataFrame:
    """text, problem: mutated texts for which ``check(text)`` gives a problem or raises. Every round mutates the texts of the round before that were found to be new to ``check`` (it may give ``new:<what>`` for those), in parallel, until the time is up."""
    import time

    began, pool, found = time.time(), list(seeds), []

    def tried(text, s):
        made = mutated_text(text, s)
        try:
            said = check(made)
        except Exception as e:  # whatever is raised is what is looked for
            said = type(e).__name__
        return {"text": made, "problem": said}

    for turn in range(rounds):
        if not pool or time.time() - began > seconds:
            break
        rows = [(t, seed * 1_000_003 + turn * 1_000_000 + i * each + k) for i, t in enumerate(pool) for k in range(each)]
        out = spark.createDataFrame(rows, "text string, seed long").select(kernel("struct<text:string,problem:string>")(tried)("text", "seed").alias("r")).select("r.*").where("problem IS NOT NULL")
        said = out.dropDuplicates(["problem"]).limit(1000).collect()
        found += [(r["text"], r["problem"]) for r in said if not r["problem"].startswith("new:")]
        pool = [r["text"] for r in said if r["problem"].startswith("new:")]
    return spark.createDataFrame(found, "text string, problem string").dropDuplicates(["problem"])
