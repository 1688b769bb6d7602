"""Inline substitutions as Column expressions.

The passes run in a fixed order: special characters, quotes, attributes,
replacements, macros, post replacements. Passes that only look for patterns
are chains of ``regexp_replace`` behind a cheap guard; what depends on the
order of a whole document (counters, attribute assignments) is in
``quire.operators.attributes``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD, character_reference, col, let, special_characters

#: Built-in attributes.
INTRINSIC = {
    "startsb": "[", "endsb": "]", "vbar": "|", "caret": "^", "asterisk": "*", "tilde": "~", "plus": "&#43;", "backslash": "\\", "backtick": "`", "blank": "", "empty": "", "sp": " ",
    "two-colons": "::", "two-semicolons": ";;", "nbsp": "&#160;", "deg": "&#176;", "zwsp": "&#8203;", "quot": "&#34;", "apos": "&#39;", "lsquo": "&#8216;", "rsquo": "&#8217;", "ldquo": "&#8220;",
    "rdquo": "&#8221;", "wj": "&#8288;", "brvbar": "&#166;", "pp": "&#43;&#43;", "cpp": "C&#43;&#43;", "cxx": "C&#43;&#43;", "amp": "&", "lt": "<", "gt": ">",
}

#: Quote marks in the order in which they are looked for: kind, mark, closing mark,
#: what may not stand before a constrained mark besides word characters, what may not follow it, what opens and closes the result.
QUOTES = [
    ("strong", "**", "**", None, None, "<strong>", "</strong>"),
    ("strong", "*", "*", ";:}", "", "<strong>", "</strong>"),
    ("double", '"`', '`"', ";:}", "", "&#8220;", "&#8221;"),
    ("single", "'`", "`'", ";:`}", "", "&#8216;", "&#8217;"),
    ("monospaced", "``", "``", None, None, "<code>", "</code>"),
    ("monospaced", "`", "`", ";:\"'`}", "\"'`", "<code>", "</code>"),
    ("emphasis", "__", "__", None, None, "<em>", "</em>"),
    ("emphasis", "_", "_", ";:}", "", "<em>", "</em>"),
    ("mark", "##", "##", None, None, "<mark>", "</mark>"),
    ("mark", "#", "#", "&;:}", "", "<mark>", "</mark>"),
    ("superscript", "^", "^", None, None, "<sup>", "</sup>"),
    ("subscript", "~", "~", None, None, "<sub>", "</sub>"),
]

#: What stands in place of the first six in the older notation.
OLD_QUOTES = [
    QUOTES[0], QUOTES[1], ("double", "``", "''", ";:}", "", "&#8220;", "&#8221;"), ("emphasis", "'", "'", ";:}", "", "<em>", "</em>"), ("single", "`", "'", ";:}", "", "&#8216;", "&#8217;"),
    ("monospaced", "++", "++", None, None, "<code>", "</code>"), ("monospaced", "+", "+", ";:}", "", "<code>", "</code>"), *QUOTES[6:],
]

#: Typographic replacements after special characters, in order: what they are for, pattern, result.
REPLACEMENTS = [
    ("(C)", r"(?<!\\)\(C\)", "&#169;"),
    ("(R)", r"(?<!\\)\(R\)", "&#174;"),
    ("(TM)", r"(?<!\\)\(TM\)", "&#8482;"),
    ("--", r"(?m)(?: |\n|^)--(?: |\n|$)", "&#8201;&#8212;&#8201;"),
    ("--", "([" + WORD + r"])--(?=[" + WORD + "])", "$1&#8212;&#8203;"),
    ("...", r"(?<!\\)\.\.\.", "&#8230;&#8203;"),
    ("`'", r"(?<!\\)`'", "&#8217;"),
    ("'", r"([\p{L}\p{Nd}])'(?=\p{L})", "$1&#8217;"),
    ("-&gt;", r"(?<!\\)-&gt;", "&#8594;"),
    ("=&gt;", r"(?<!\\)=&gt;", "&#8658;"),
    ("&lt;-", r"(?<!\\)&lt;-", "&#8592;"),
    ("&lt;=", r"(?<!\\)&lt;=", "&#8656;"),
    ("&amp;", r"(?<!\\)&amp;(" + character_reference() + ")", "&$1"),
]
ESCAPED = r"\\(?=\(C\)|\(R\)|\(TM\)|\.\.\.|`'|-&gt;|=&gt;|&lt;-|&lt;=|&amp;[a-zA-Z#])"


def _literal(mark: str) -> str:
    return "".join("\\" + c if c in "*^~+`\"'_#" else c for c in mark).replace("\\_", "_").replace("\\#", "#").replace("\\`", "`").replace("\\'", "'").replace('\\"', '"')


def quotes(x, old: bool = False) -> Column:
    """Formatting marks as tags, in the notation of today or the older one. A mark may carry ``[.role]`` or ``[#id]``; a backslash before it leaves it as written."""
    # each rule's input is bound once: it is looked at by a guard and, if the mark occurs, by the patterns
    out = col(x)
    for rule in OLD_QUOTES if old else QUOTES:
        out = let(out, _quoted(rule))
    return out


def _quoted(rule: tuple):
    _, mark, close, before, after, opens, closes = rule
    m, c = _literal(mark), _literal(close)
    if before is None:
        inside = r"(\S+?)" if mark in "^~" else r"([\s\S]+?)"
        lead, follow = r"()(?<!\\)", ""
    else:
        inside = r"(\S|\S[\s\S]*?\S)"
        lead, follow = rf"(?m)(^|[^{WORD}\\{before}])", rf"(?![{WORD}{after}])"

    def applied(t: Column) -> Column:
        done = t
        if opens.startswith("<"):
            tag = opens.strip("<>")
            span = "span" if tag == "mark" else tag
            classed = F.regexp_replace(t, rf"{lead}\[\.([^\]#.\s]+)\]{m}{inside}{c}{follow}", f'$1<{span} class="$2">$3</{span}>')
            done = F.when(t.contains("]" + mark), F.regexp_replace(classed, rf"{lead}\[#([^\]#.\s]+)\]{m}{inside}{c}{follow}", f'$1<{tag} id="$2">$3</{tag}>')).otherwise(t)
        done = F.regexp_replace(done, f"{lead}{m}{inside}{c}{follow}", f"$1{opens}$2{closes}")
        whole = F.when(t.contains("\\"), F.regexp_replace(done, rf"\\(?={m}{inside}{c}{follow})", "")).otherwise(done)
        return F.when(t.contains(mark), whole).otherwise(t)

    return applied


def replacements(x) -> Column:
    """Typographic replacements, one after the other: without guards, as each text is one expression then and most texts that come here have one of the signs."""
    out = col(x)
    for _, pattern, result in REPLACEMENTS:
        out = F.regexp_replace(out, pattern, result)
    return F.regexp_replace(out, ESCAPED, "")


def post_replacements(x, hardbreaks: bool = False) -> Column:
    """A line that ends in space and plus breaks; with ``hardbreaks``, every line but the last."""
    t = col(x)
    if hardbreaks:
        return F.regexp_replace(t, r"(?: \+)?\n(?=[\s\S])", "<br>\n")
    return F.when(t.contains(" +"), F.regexp_replace(t, r"(?m)^(.*) \+$", "$1<br>")).otherwise(t)


def attributes(x, attrs: Column, missing: str = "skip") -> Column:
    """``{name}`` replaced from a map (names in lower case), then from the built-in ones.

    ``missing``: ``skip`` leaves an unknown reference as written, ``drop``
    leaves it out, ``drop-line`` leaves out its line.
    """
    t = col(x)
    pattern = r"\{[\w][\w-]*\}"
    builtin = F.create_map(*[F.lit(y) for kv in INTRINSIC.items() for y in kv])

    def value(ref: Column) -> Column:
        name = F.lower(F.btrim(ref, F.lit("{}")))
        found = F.coalesce(F.try_element_at(attrs, name), F.try_element_at(builtin, name))
        return F.coalesce(found, ref if missing == "skip" else F.lit("\x00" if missing == "drop-line" else ""))

    def filled(refs: Column) -> Column:
        return F.array_join(F.zip_with(F.split(t, pattern), F.transform(refs, value), lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")

    out = F.when(t.contains("{"), let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), filled)).otherwise(t)
    if missing == "drop-line":
        out = F.array_join(F.filter(F.split(out, "\n"), lambda line: ~line.contains("\x00")), "\n")
    return out


def kbd(x) -> Column:
    """``kbd:[Ctrl+T]``: one key as such, more in a sequence."""
    t = col(x)
    one = F.regexp_replace(t, r"kbd:\[([^\],+]+)\]", "<kbd>$1</kbd>")

    def rendered(found: Column) -> Column:
        keys = lambda m: F.transform(F.split(F.regexp_extract(m, r"kbd:\[([^\]]+)\]", 1), r"\s*[,+]\s*"), lambda k: F.concat(F.lit("<kbd>"), k, F.lit("</kbd>")))
        html = F.transform(found, lambda m: F.concat(F.lit('<span class="keyseq">'), F.array_join(keys(m), "+"), F.lit("</span>")))
        return F.array_join(F.zip_with(F.split(one, r"kbd:\[[^\]]+\]"), html, lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")

    return F.when(t.contains("kbd:["), let(F.regexp_extract_all(one, F.lit(r"kbd:\[[^\]]+\]"), F.lit(0)), rendered)).otherwise(t)


def buttons(x) -> Column:
    return F.regexp_replace(col(x), r"btn:\[([^\]]+)\]", '<b class="button">$1</b>')


def menus(x) -> Column:
    """``menu:File[Save]``: a menu and its item."""
    return F.regexp_replace(col(x), r"menu:([\w][^\[\]]*)\[([^\]]+)\]", '<span class="menuseq"><b class="menu">$1</b>&#160;<b class="caret">&#8250;</b> <b class="menuitem">$2</b></span>')


def images(x) -> Column:
    """``image:target[alt]``; without alt, the file's name without its ending."""
    t = F.regexp_replace(col(x), r"image:(?!:)([^\s\[]+)\[([^\],]+)[^\]]*\]", '<span class="image"><img src="$1" alt="$2"></span>')
    return F.regexp_replace(t, r"image:(?!:)((?:[^\s\[]*/)?([^\s\[/]+?)(?:\.[^.\s\[/]+)?)(\.[^.\s\[/]+)?\[\]", '<span class="image"><img src="$1$3" alt="$2"></span>')


def icons(x) -> Column:
    """``icon:name[]`` as its name in brackets, or its alt text."""
    named = F.regexp_replace(col(x), r"icon:(?!:)([^\s\[]+)\[(?:[^\]]*,)?alt=([^\],]+)[^\]]*\]", '<span class="icon">[$2&#93;</span>')
    return F.regexp_replace(named, r"icon:(?!:)([^\s\[]+)\[[^\]]*\]", '<span class="icon">[$1&#93;</span>')


def mailto(x) -> Column:
    """``mailto:a@b.c[Text,Subject,Body]``: a link to an address, with subject and body in it."""
    t = col(x)
    pattern = r"mailto:([^\s\[]+)\[([^\],]*)(?:,([^\],]*))?(?:,([^\]]*))?\]"
    encoded = lambda v: F.replace(F.url_encode(F.btrim(v)), F.lit("+"), F.lit("%20"))

    def link(m: Column) -> Column:
        part = lambda k: F.regexp_extract(m, pattern, k)
        query = F.concat_ws("&amp;", F.when(part(3) != "", F.concat(F.lit("subject="), encoded(part(3)))), F.when(part(4) != "", F.concat(F.lit("body="), encoded(part(4)))))
        return F.concat(F.lit('<a href="mailto:'), part(1), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.lit('">'), F.when(part(2) == "", part(1)).otherwise(part(2)), F.lit("</a>"))

    made = lambda ms: F.array_join(F.zip_with(F.split(t, pattern), F.transform(ms, link), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(t.contains("mailto:"), let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), made)).otherwise(t)


def links(x) -> Column:
    """URLs, alone or with ``[text]``, and ``link:target[text]``."""
    t = col(x)
    named = F.regexp_replace(t, r"(?:link:|(?=https?://|ftp://|irc://))((?:https?://|ftp://|irc://)?[^\s\[\]<]+)\[([^\]]+)\]", '<a href="$1">$2</a>')
    return F.when(t.contains("://") | t.contains("link:"), F.regexp_replace(named, r'(?<!["=>:\w])((?:https?|ftp|irc)://[^\s\[\]<]*[^\s.,\[\]<)!?;:])(?!\[)', '<a href="$1" class="bare">$1</a>')).otherwise(t)


def emails(x) -> Column:
    t = col(x)
    return F.when(t.contains("@"), F.regexp_replace(t, r"(?<![\w>:/.@+-])([\w][\w.%+-]*@[\w][\w.-]*\.[a-zA-Z]{2,5})\b", '<a href="mailto:$1">$1</a>')).otherwise(t)


def anchors(x) -> Column:
    """Structs of id and text of ``[[id,text]]`` and ``anchor:id[text]``."""
    found = F.regexp_extract_all(col(x), F.lit(r"\[\[[\p{L}_:][\w:.-]*(?:, *[^\]]+)?\]\]|anchor:[\p{L}_:][\w:.-]*\[[^\]]*\]"), F.lit(0))
    return F.transform(
        found,
        lambda m: F.struct(F.regexp_extract(m, r"^(?:\[\[|anchor:)([^,\[\]]+)", 1).alias("id"), F.nullif(F.regexp_extract(m, r"(?:, *|\[)([^\[\],]+)\]{1,2}$", 1), F.lit("")).alias("text")),
    )


def xrefs(x) -> Column:
    """Structs of target and text of ``<<id,text>>`` and ``xref:id[text]``, in order."""
    found = F.regexp_extract_all(col(x), F.lit(r"<<[^>]+>>|xref:[^\s\[]+\[[^\]]*\]"), F.lit(0))
    return F.transform(
        found,
        lambda m: F.struct(
            F.regexp_extract(m, r"^(?:<<|xref:)#?([^,\[>]+)", 1).alias("target"),
            F.nullif(F.regexp_extract(m, r"^(?:<<[^,>]+, *([^>]+)>>|xref:[^\[]+\[([^\]]*)\])$", 1), F.lit("")).alias("text"),
        ),
    )


def footnotes(x) -> Column:
    """Structs of id and text of ``footnote:[text]`` and ``footnote:id[text]``."""
    found = F.regexp_extract_all(col(x), F.lit(r"footnote:[\w-]*\[[^\]]*\]"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.nullif(F.regexp_extract(m, r"footnote:([\w-]*)\[", 1), F.lit("")).alias("id"), F.nullif(F.regexp_extract(m, r"\[([^\]]*)\]$", 1), F.lit("")).alias("text")))


def index_terms(x) -> Column:
    """Structs of shown and terms of ``((term))`` (shown) and ``(((a,b,c)))`` (hidden)."""
    found = F.regexp_extract_all(col(x), F.lit(r"\(\(\([^)]+\)\)\)|\(\([^)]+\)\)"), F.lit(0))
    return F.transform(
        found,
        lambda m: F.struct((~m.startswith("(((")).alias("shown"), F.slice(F.split(F.regexp_extract(m, r"\(+([^)]+)\)+", 1), r" *, *"), 1, 3).alias("terms")),
    )


def callouts(x) -> Column:
    """Numbers of the callouts ``<1>`` at line ends."""
    return F.transform(F.regexp_extract_all(col(x), F.lit(r"(?m)<(\d+)>(?=(?: ?<\d+>)*$)"), F.lit(1)), lambda n: n.cast("int"))


def macros(x) -> Column:
    out = col(x)
    for step in (kbd, buttons, menus, images, icons, mailto, links, emails):
        out = let(out, step)
    return out


#: Marks around the numbers of slots: texts that the passes must not see, and targets that formatting must leave alone.
SLOT, TARGET = "\u0096", "\u0086"
#: Names of the passes by their short forms.
HINTS = {"a": "attributes", "c": "specialcharacters", "m": "macros", "n": "normal", "p": "post_replacements", "q": "quotes", "r": "replacements", "v": "verbatim"}
PASSED = "|".join([
    r"(?<!\\)\+\+\+[\s\S]*?\+\+\+", r"(?<!\\)\+\+[\s\S]+?\+\+", r"(?<!\\)\$\$[\s\S]+?\$\$", r"(?<!\\)pass:[a-z,_-]*\[[\s\S]*?(?<!\\)\]", r"(?<!\\)(?:stem|latexmath|asciimath):[a-z,_-]*\[[\s\S]*?(?<!\\)\]",
    r"(?<![" + WORD + r";:\\+])\+(?:[^\s+]|[^\s+][\s\S]*?\S)\+(?![" + WORD + "+])",
])


def extract_passthroughs(x) -> Column:
    """Struct of text, with numbered slots in place of passthroughs, and slots: structs of body, subs (names of passes, short or long, parted by commas) and kind (pass, or the notation of a formula)."""
    t = col(x)

    def slot(m: Column) -> Column:
        named = m.startswith("pass:")
        math = F.regexp_extract(m, "^(stem|latexmath|asciimath):", 1)
        inner = F.replace(F.regexp_extract(m, r"^[a-z]+:[a-z,_-]*\[([\s\S]*)\]$", 1), F.lit("\\]"), F.lit("]"))
        subs = F.regexp_extract(m, r"^[a-z]+:([a-z,_-]*)\[", 1)
        fence = F.when(m.startswith("+++"), 3).when(m.startswith("++") | m.startswith("$$"), 2).otherwise(1)
        body = F.when(named | (math != ""), inner).otherwise(F.substr(m, fence + 1, F.length(m) - 2 * fence))
        passes = F.when(named, subs).when(math != "", F.when(subs == "", "c").otherwise(subs)).when(fence == 3, "").otherwise("c")
        return F.struct(body.alias("body"), passes.alias("subs"), F.when(math != "", math).otherwise("pass").alias("kind"))

    def numbered(found: Column) -> Column:
        holes = F.transform(found, lambda _, i: F.concat(F.lit(SLOT), i.cast("string"), F.lit(SLOT)))
        text = F.array_join(F.zip_with(F.split(t, PASSED), holes, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.struct(text.alias("text"), F.transform(found, slot).alias("slots"))

    some = t.contains("+") | t.contains("$$") | t.contains("pass:") | t.contains("stem:") | t.contains("math:")
    return let(F.when(some, F.regexp_extract_all(t, F.lit(PASSED), F.lit(0))).otherwise(F.array().cast("array<string>")), numbered)


def restore_passthroughs(x, slots: Column) -> Column:
    """A text with what its slots hold, each put through its own passes; formulas between the marks of their notation."""
    t = col(x)

    def through(s: Column) -> Column:
        subs = F.split(s["subs"], ",")
        has = lambda *names: F.arrays_overlap(subs, F.array(*map(F.lit, names)))
        body = F.when(has("c", "n", "v", "specialcharacters", "specialchars", "normal", "verbatim"), special_characters(s["body"])).otherwise(s["body"])
        body = let(body, lambda b: F.when(has("q", "n", "quotes", "normal"), quotes(b)).otherwise(b))
        body = let(body, lambda b: F.when(has("r", "n", "replacements", "normal"), replacements(b)).otherwise(b))
        body = let(body, lambda b: F.when(has("m", "n", "macros", "normal"), macros(b)).otherwise(b))
        opens = F.when(s["kind"] == "pass", "").when(s["kind"] == "latexmath", "\\(").otherwise("\\$")
        closes = F.when(s["kind"] == "pass", "").when(s["kind"] == "latexmath", "\\)").otherwise("\\$")
        return F.concat(opens, body, closes)

    pattern = SLOT + r"(\d+)" + SLOT

    def joined(bodies: Column) -> Column:
        asked = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda n: F.coalesce(F.get(bodies, n.cast("int")), F.lit("")))
        return F.array_join(F.zip_with(F.split(t, pattern), asked, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.when(F.size(slots) > 0, let(F.transform(slots, through), joined)).otherwise(t)


#: What is a target: a URL or the target of a link, cross reference or image macro.
TARGETS = r"(?:https?|ftp|irc)://[^\s\[\]<>]+|(?:link|xref|mailto|image|icon):[^\s\[\]:][^\s\[\]]*(?=\[)|&lt;&lt;[^\s&,]+(?=(?:,[^&]*)?&gt;&gt;)"


def protect_targets(x) -> Column:
    """Struct of text with numbered holes in place of targets, in which marks are no formatting, and targets."""
    t = col(x)

    def numbered(found: Column) -> Column:
        holes = F.transform(found, lambda _, i: F.concat(F.lit(TARGET), i.cast("string"), F.lit(TARGET)))
        return F.struct(F.array_join(F.zip_with(F.split(t, TARGETS), holes, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "").alias("text"), found.alias("targets"))

    some = t.contains(":") | t.contains("&lt;&lt;")
    return let(F.when(some, F.regexp_extract_all(t, F.lit(TARGETS), F.lit(0))).otherwise(F.array().cast("array<string>")), numbered)


def restore_targets(x, targets: Column) -> Column:
    t = col(x)
    pattern = TARGET + r"(\d+)" + TARGET
    asked = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda n: F.coalesce(F.get(targets, n.cast("int")), F.lit("")))
    return F.when(F.size(targets) > 0, F.array_join(F.zip_with(F.split(t, pattern), asked, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(t)


def formatted(x) -> Column:
    """``quotes`` that leaves targets as they are."""
    return let(protect_targets(x), lambda p: restore_targets(let(p["text"], lambda t: quotes(t)), p["targets"]))


#: A text without any of these is the same after all passes.
PLAIN = r"^[^*_`#^~\"'&<>()\[\]{}:@+$=.\\-]*+$"


def normal(x, attrs: Column | None = None, missing: str = "skip") -> Column:
    """All passes of an ordinary paragraph, passthroughs kept out of them. Plain texts skip them all."""

    def passes(p: Column) -> Column:
        out = formatted(let(p["text"], special_characters))
        if attrs is not None:
            out = let(out, lambda t: attributes(t, attrs, missing))
        out = let(macros(let(out, replacements)), lambda t: post_replacements(t))
        return let(out, lambda t: restore_passthroughs(t, p["slots"]))

    return let(col(x), lambda t: F.when(t.isNull() | t.rlike(PLAIN), t).otherwise(let(extract_passthroughs(t), passes)))


def _chain(*steps):
    def applied(x) -> Column:
        out = col(x)
        for step in steps:
            out = let(out, step)
        return out

    return applied


def header(x, attrs: Column | None = None) -> Column:
    """What is said in a document's header: special characters and attributes only."""
    out = special_characters(x)
    return out if attrs is None else let(out, lambda t: attributes(t, attrs))


def title(x) -> Column:
    """A title: all passes, with replacements before macros and without line breaks."""
    return let(extract_passthroughs(x), lambda p: let(_chain(special_characters, formatted, replacements, macros)(p["text"]), lambda t: restore_passthroughs(t, p["slots"])))


def reftext(x) -> Column:
    """The text of a reference: special characters, formatting and replacements."""
    return _chain(special_characters, lambda t: quotes(t), replacements)(x)


def quoted_attributes(x) -> Column:
    """Struct of id and roles of the short form ``#id.role`` before formatted text; a bare name is a role."""
    t = F.btrim(F.substring_index(col(x), ",", 1))
    roles = F.regexp_extract_all(t, F.lit(r"\.([^.#]+)"), F.lit(1))
    bare = F.regexp_extract(t, r"^([^.#]+)$", 1)
    return F.struct(F.nullif(F.regexp_extract(t, r"#([^.#]+)", 1), F.lit("")).alias("id"), F.when(bare != "", F.split(bare, " ")).otherwise(roles).alias("roles"))


def macro_attributes(x) -> Column:
    """The map of a macro's attribute list: positions, names, and ``style#id.role%option`` at the first place."""
    from quire.functions.kernel import kernel

    def parsed(t):
        from quire.operators.blocks import attribute_list

        return list(attribute_list(t).items())

    return kernel("map<string,string>")(parsed)(x)


def link_attributes(x) -> Column:
    """Struct of text, role, window and id of a link's text ``text,role=x,window=_blank``; ``^`` at the text's end opens a new window."""
    t = col(x)
    named = t.rlike(r"(?:^|,)\s*(?:role|window|id|opts|title)=")
    text = F.btrim(F.when(named, F.regexp_extract(t, r'^((?:"[^"]*+"|[^,"=])*+)(?=,|$)', 1)).otherwise(t))
    text = F.regexp_replace(text, r'^"([\s\S]*)"$', "$1")
    value = lambda name: F.nullif(F.btrim(F.regexp_extract(t, rf'(?:^|,)\s*{name}=("[^"]*"|[^,]*)', 1), F.lit('" ')), F.lit(""))
    window = F.when(text.endswith("^"), "_blank").when(named, value("window"))
    return F.struct(F.regexp_replace(text, r"\^$", "").alias("text"), F.when(named, value("role")).alias("role"), window.alias("window"), F.when(named, value("id")).alias("id"))


def stem(x) -> Column:
    """Inline formulas with the marks of their notation around them, their text escaped."""
    return let(extract_passthroughs(x), lambda p: restore_passthroughs(p["text"], p["slots"]))


def extract_callouts(x) -> Column:
    """Struct of text without the callouts at its lines' ends, and marks: structs of line (from 0) and numbers; ``<.>`` counts on. A comment mark before them goes too."""
    lines = F.split(col(x), "\n")
    tail = r"(?:[ \t]*(?://|#|--|;;)?[ \t]*)((?:<!--(?:\d+|\.)-->|<(?:\d+|\.)>)(?:[ \t]*(?:<!--(?:\d+|\.)-->|<(?:\d+|\.)>))*+)[ \t]*$"
    found = F.transform(lines, lambda s, i: F.struct(i.alias("line"), F.regexp_extract_all(F.regexp_extract(s, tail, 1), F.lit(r"<(?:!--)?(\d+|\.)(?:--)?>"), F.lit(1)).alias("marks")))

    def counted(rows: Column) -> Column:
        flat = F.flatten(F.transform(rows, lambda r: r["marks"]))
        before = lambda i: F.size(F.flatten(F.transform(F.slice(rows, 1, i), lambda r: r["marks"])))
        numbers = let(flat, lambda all_marks: F.transform(rows, lambda r: F.struct(r["line"].alias("line"), F.transform(r["marks"], lambda m, k: F.when(m == ".", F.size(F.filter(F.slice(all_marks, 1, before(r["line"]) + k + 1), lambda y: y == "."))).otherwise(m.try_cast("int"))).alias("numbers"))))
        return F.filter(numbers, lambda r: F.size(r["numbers"]) > 0)

    marks = F.when(col(x).contains("<"), let(found, counted)).otherwise(F.filter(F.transform(found, lambda r: F.struct(r["line"].alias("line"), F.array().cast("array<int>").alias("numbers"))), lambda r: F.lit(False)))
    return F.struct(F.array_join(F.transform(lines, lambda s: F.regexp_replace(s, tail, "")), "\n").alias("text"), marks.alias("marks"))


def restore_callouts(x, marks: Column) -> Column:
    """Lines with their callouts at the end again, as ``<b class="conum">(n)</b>``."""

    def line(s: Column, i: Column) -> Column:
        own = F.flatten(F.transform(F.filter(marks, lambda r: r["line"] == i), lambda r: r["numbers"]))
        shown = F.array_join(F.transform(own, lambda n: F.concat(F.lit('<b class="conum">('), n.cast("string"), F.lit(")</b>"))), " ")
        return F.when(F.size(own) > 0, F.concat_ws(" ", s, shown)).otherwise(s)

    return F.array_join(F.transform(F.split(col(x), "\n"), line), "\n")


#: The passes of each kind of block before ``subs`` changes them.
NORMAL = ("specialcharacters", "quotes", "attributes", "replacements", "macros", "post_replacements")
VERBATIM = ("specialcharacters", "callouts")


def default_passes(context, style=None, highlighter: bool = False) -> Column:
    """Names of the passes of a block of that context and style; with a highlighter, a source listing's special characters are left to it."""
    c, s = col(context), F.lit(None).cast("string") if style is None else col(style)
    names = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    listing = F.when((s == "source") & F.lit(highlighter), names(("highlight", "callouts"))).otherwise(names(VERBATIM))
    return F.when(c == "listing", listing).when(c == "literal", names(VERBATIM)).when(c == "stem", names(VERBATIM[:1])).when(c.isin("pass", "comment", "table"), names(())).otherwise(names(NORMAL))


def biblio_anchors(x) -> Column:
    """Structs of id and label of ``[[[id,label]]]`` at the start of a bibliography's entries; the label is the id without one."""
    found = F.regexp_extract_all(col(x), F.lit(r"\[\[\[([\p{L}_:][\w:.-]*(?:, *[^\]]+)?)\]\]\]"), F.lit(1))
    return F.transform(found, lambda m: F.struct(F.substring_index(m, ",", 1).alias("id"), F.coalesce(F.nullif(F.btrim(F.regexp_extract(m, ", *(.+)$", 1)), F.lit("")), F.substring_index(m, ",", 1)).alias("label")))


def inline_tree(html) -> Column:
    """The inline elements of converted text: structs of id, parent (null at the top), kind, start and stop, their places in the text without its tags (in characters, entities counting one)."""
    from quire.functions.kernel import kernel

    def tree(t):
        import html as entities
        import re

        out, opened, at, place = [], [], 0, 0
        for m in re.finditer(r"<(/?)([a-zA-Z][\w-]*)([^<>]*?)(/?)>", t):
            place += len(entities.unescape(t[at : m.start()]))
            at = m.end()
            if m[1]:
                names = [out[k]["kind"] for k in opened]
                if m[2] in names:
                    while opened:
                        k = opened.pop()
                        out[k]["stop"] = place
                        if out[k]["kind"] == m[2]:
                            break
                continue
            out.append({"id": len(out), "parent": opened[-1] if opened else None, "kind": m[2], "start": place, "stop": place})
            if not m[4] and m[2] not in ("br", "img", "hr", "input"):
                opened.append(len(out) - 1)
        place += len(entities.unescape(t[at:]))
        for k in opened:
            out[k]["stop"] = place
        return out

    return kernel("array<struct<id:int,parent:int,kind:string,start:int,stop:int>>")(tree)(html)
