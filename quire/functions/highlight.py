"""Syntax highlighting by grammars that are data: modes that begin and end, keywords, and modes inside modes.

A grammar is a dictionary, written by hand or read from JSON. It is compiled
once on the driver and shipped with the function; texts are scanned a row at
a time. Which language a text is in can be found by relevance.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import kernel

NUMBER = {"scope": "number", "begin": r"\b(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\b"}
QUOTED = [{"scope": "string", "begin": '"', "end": '"', "contains": [{"begin": r"\\."}], "illegal": r"\n"}, {"scope": "string", "begin": "'", "end": "'", "contains": [{"begin": r"\\."}], "illegal": r"\n"}]
LINE_COMMENT = {"scope": "comment", "begin": "//", "end": "$"}
BLOCK_COMMENT = {"scope": "comment", "begin": r"/\*", "end": r"\*/"}
#: A few grammars; more are a parameter.
GRAMMARS: dict[str, dict] = {
    "json": {"keywords": {"literal": "true false null"}, "contains": [{"scope": "attr", "begin": r'"(?:\\.|[^\\"\r\n])*"(?=\s*:)', "relevance": 1.01}, {"scope": "punctuation", "begin": r"[{}\[\],:]", "relevance": 0}, QUOTED[0], NUMBER], "illegal": r"\S"},
    "python": {
        "keywords": {"keyword": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda match nonlocal not or pass raise return try while with yield", "literal": "True False None", "built_in": "abs all any bool dict enumerate float int len list map max min open print range set sorted str sum super tuple type zip"},
        "contains": [{"scope": "comment", "begin": "#", "end": "$"}, {"scope": "string", "begin": '"""', "end": '"""', "relevance": 2}, *QUOTED, NUMBER, {"scope": "meta", "begin": r"^[ \t]*@\w+"}, {"begin_words": "def class", "scope": "title", "begin": r"(?<=def )\w+|(?<=class )\w+", "relevance": 2}],
    },
    "sql": {"insensitive": True, "keywords": {"keyword": "select from where group by order having join left right full outer inner on as insert into values update set delete create table view with union all distinct case when then else end and or not in is null limit over partition", "built_in": "count sum avg min max coalesce cast"}, "contains": [{"scope": "comment", "begin": "--", "end": "$"}, BLOCK_COMMENT, {"scope": "string", "begin": "'", "end": "'", "contains": [{"begin": "''"}]}, NUMBER]},
    "dart": {"keywords": {"keyword": "abstract as assert async await break case catch class const continue default do else enum extends final finally for if implements import in is late new return static super switch this throw try var void while with yield", "built_in": "int double String bool List Map Set Future Stream num Object", "literal": "true false null"}, "contains": [LINE_COMMENT, BLOCK_COMMENT, *QUOTED, NUMBER, {"scope": "meta", "begin": r"@[A-Za-z]+"}]},
    "bash": {"keywords": {"keyword": "if then else elif fi for while in do done case esac function", "built_in": "cd echo export local read set unset test"}, "contains": [{"scope": "meta", "begin": r"^#![^\n]*", "relevance": 10}, {"scope": "comment", "begin": "#", "end": "$"}, {"scope": "variable", "begin": r"\$\w+|\$\{[^}]+\}"}, *QUOTED]},
    "plaintext": {"contains": []},
}
#: Other names of languages.
ALIASES = {"py": "python", "sh": "bash", "shell": "bash", "text": "plaintext", "txt": "plaintext", "postgresql": "sql"}


def compiled_keywords(words, insensitive: bool) -> dict[str, tuple[str, float]]:
    """Keyword to (scope, relevance): a string is a list of keywords of the scope ``keyword``; ``word|2`` has that relevance, others one."""
    groups = {"keyword": words} if isinstance(words, (str, list)) else words or {}
    out = {}
    for scope, names in groups.items():
        for name in names.split() if isinstance(names, str) else names:
            word, _, weight = name.partition("|")
            out[word.lower() if insensitive else word] = (scope, float(weight) if weight else 1.0)
    return out


class Mode:
    """A compiled mode: what begins inside it, what ends it, its keywords."""

    def __init__(self, source: dict, root: dict, end: str | None = None):
        self.scope, self.relevance, self.end_pattern = source.get("scope"), source.get("relevance", 1), end
        flags = re.MULTILINE | (re.IGNORECASE if root.get("insensitive") else 0)
        self.insensitive = bool(root.get("insensitive"))
        self.keywords = compiled_keywords(source.get("keywords"), self.insensitive)
        self.inner = [Mode({"contains": [], **x}, root, x.get("end")) if x.get("end") or x.get("contains") else Mode(x, root) for x in source.get("contains", [])]
        for mode, x in zip(self.inner, source.get("contains", []), strict=True):
            mode.begin, mode.single = x["begin"], not x.get("end")
        parts = [f"(?P<m{i}>{m.begin})" for i, m in enumerate(self.inner)]
        if end:
            parts.insert(0, f"(?P<end>{end})")
        if self.keywords:
            parts.append(r"(?P<word>[A-Za-z_]\w*)")
        self.illegal = re.compile(source["illegal"], flags) if source.get("illegal") else None
        if self.illegal:
            parts.append(f"(?P<illegal>{source['illegal']})")
        self.scanner = re.compile("|".join(parts), flags) if parts else None


class Grammar:
    def __init__(self, name: str, source: dict):
        self.name, self.root = name, Mode(source, source)

    def tokens(self, text: str) -> tuple[list, float, bool]:
        """(tree, relevance, illegal): the tree is strings and (scope, tree); scanning goes on after something illegal, as plain text."""
        relevance, illegal = 0.0, False
        top: list = []
        stack = [(self.root, top)]
        at = 0
        seen: dict[str, int] = {}
        while at <= len(text):
            mode, tree = stack[-1]
            m = mode.scanner.search(text, at) if mode.scanner else None
            if not m:
                tree.append(text[at:])
                break
            tree.append(text[at : m.start()])
            kind = next((g for g in ("end", *(f"m{i}" for i in range(len(mode.inner))), "word", "illegal") if g in m.re.groupindex and m[g] is not None), None)
            at = m.end()
            if kind == "end":
                tree.append(m[0])
                stack.pop()
                if not m[0] and at >= len(text):
                    break
            elif kind == "illegal":
                illegal = True
                tree.append(m[0])
            elif kind == "word":
                found = mode.keywords.get(m[0].lower() if mode.insensitive else m[0])
                if found:
                    seen[m[0].lower()] = seen.get(m[0].lower(), 0) + 1
                    relevance += found[1] if seen[m[0].lower()] <= 7 else 0  # a word that is said all the time says no more
                    tree.append((found[0], [m[0]]))
                else:
                    illegal = illegal or bool(mode.illegal and mode.illegal.match(m[0]))
                    tree.append(m[0])
            else:
                inner = mode.inner[int(kind[1:])]
                relevance += inner.relevance
                branch: list = [m[0]]
                tree.append((inner.scope, branch) if inner.scope else branch[0] if inner.single else (None, branch))
                if not inner.single:
                    stack.append((inner, branch))
            if m.end() == m.start() and kind != "end":
                if at >= len(text):
                    break
                stack[-1][1].append(text[at])
                at += 1
        return top, relevance, illegal


def to_html(tree: list, prefix: str = "hljs-") -> str:
    """Nested scopes as nested spans, text escaped."""
    out = []
    for part in tree:
        if isinstance(part, str):
            out.append(html.escape(part, quote=True))
        else:
            scope, inner = part
            body = to_html(inner, prefix)
            out.append(f'<span class="{prefix}{scope}">{body}</span>' if scope and body else body)
    return "".join(out)


@lru_cache(64)
def grammar(name: str) -> Grammar | None:
    name = ALIASES.get(name.lower(), name.lower())
    return Grammar(name, GRAMMARS[name]) if name in GRAMMARS else None


def highlighted(code: str, language: str, grammars: dict[str, Grammar] | None = None) -> dict:
    """language, html, relevance, illegal of a code; an unknown language is plain text."""
    found = (grammars or {}).get(language) or grammar(language or "plaintext")
    if not found:
        return {"language": None, "html": html.escape(code, quote=True), "relevance": 0.0, "illegal": False}
    tree, relevance, illegal = found.tokens(code)
    return {"language": found.name, "html": to_html(tree), "relevance": 0.0 if illegal else relevance, "illegal": illegal}


RESULT = "struct<language:string,html:string,relevance:double,illegal:boolean>"


def highlight(code, language, more: dict[str, dict] | None = None) -> Column:
    """A code in a given language, with further grammars by name."""
    own = {k: Grammar(k, v) for k, v in (more or {}).items()}
    return kernel(RESULT)(lambda c, lang: highlighted(c, lang or "plaintext", own))(code, language)


def detect(codes: DataFrame, key: str, code: str = "code", languages: list[str] | None = None) -> DataFrame:
    """key, language, html, relevance, second: the language of highest relevance of each code (the first of the list among equals) and the one after it. Codes without any relevance are plain text."""
    names = languages or [x for x in GRAMMARS if x != "plaintext"]
    spark = codes.sparkSession
    listed = spark.createDataFrame(list(enumerate(names)), "rank int, tried string")
    tried = codes.join(F.broadcast(listed)).select(key, "rank", highlight(F.col(code), F.col("tried")).alias("h"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("h.relevance"), "rank"))
    best = tried.withColumn("place", place).where("place <= 2").groupBy(key).agg(F.max(F.when(F.col("place") == 1, F.col("h"))).alias("h"), F.max(F.when((F.col("place") == 2) & (F.col("h.relevance") > 0), F.col("h.language"))).alias("second"))
    some = F.col("h.relevance") > 0
    back = codes.select(F.col(key).alias("c_key"), F.col(code).alias("c_code"))
    joined = best.join(back, F.col(key) == F.col("c_key"))
    from .text import escape_html

    return joined.select(key, F.when(some, F.col("h.language")).otherwise("plaintext").alias("language"), F.when(some, F.col("h.html")).otherwise(escape_html("c_code")).alias("html"), F.col("h.relevance").alias("relevance"), "second")
