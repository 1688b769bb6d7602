"""Scalar text functions as Column expressions.

Strings count code points. Trims are over ASCII white space. Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, as trims take it (and NUL, on the right only).
BLANKS = " \t\n\x0b\x0c\r"
#: Letters, marks, decimal digits and connectors: word characters in patterns.
WORD = r"\p{L}\p{M}\p{Nd}\p{Pc}"
#: The entity names that plain text decodes, and what they stand for.
ENTITY_NAMES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
#: Roman numerals, greedily taken.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def character_reference(hexadecimal: str = "a-fA-F") -> str:
    """Pattern of what follows the ``&`` of a character reference: a name of two letters or more with up to two digits after them, or a number of two to six decimal or two to five hexadecimal digits."""
    letters = "a-z" if hexadecimal == "a-f" else "a-zA-Z"
    return rf"(?:[{letters}]{{2,}}\d{{0,2}}|#(?:\d{{2,6}}|x[\d{hexadecimal}]{{2,5}}));"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(x) -> Column:
    return F.rtrim(F.btrim(col(x), F.lit(BLANKS)), F.lit(BLANKS + "\0"))


def trim_left(x) -> Column:
    return F.ltrim(col(x), F.lit(BLANKS))


def trim_right(x) -> Column:
    return F.rtrim(col(x), F.lit(BLANKS + "\0"))


def special_characters(x) -> Column:
    """``&``, ``<`` and ``>`` as entities. The guard skips texts without any."""
    t = col(x)
    escaped = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(t.rlike("[&<>]"), escaped).otherwise(t)


def strip_tags(x) -> Column:
    return F.regexp_replace(col(x), "<[^>]*>", "")


def _code_point(n: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def decode_entities(x) -> Column:
    """Six names, and decimal and hexadecimal references, decoded in one pass; other names stay as written."""
    t = col(x)
    pattern = "&(?:" + "|".join(ENTITY_NAMES) + r"|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"

    def decoded(e: Column) -> Column:
        name = F.substring(e, 2, 9)
        out = F.when(name.startswith("#x") | name.startswith("#X"), _code_point(F.conv(F.regexp_extract(e, "[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("bigint")))
        out = out.when(name.startswith("#"), _code_point(F.regexp_extract(e, "([0-9]+)", 1).cast("bigint")))
        for k, v in ENTITY_NAMES.items():
            out = out.when(name == k + ";", F.lit(v))
        return out

    def joined(found: Column) -> Column:
        parts = F.split(t, pattern)
        return F.array_join(F.zip_with(parts, F.transform(found, decoded), lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")

    return F.when(t.contains("&"), let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), joined)).otherwise(t)


def plain_text(x) -> Column:
    """Tags removed, entities decoded, trimmed."""
    return trim(decode_entities(strip_tags(x)))


def leading_int(x) -> Column:
    """The integer that a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(col(x), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def leading_double(x) -> Column:
    return F.coalesce(F.regexp_extract(col(x), r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def split_drop_empty_end(x, separator: str) -> Column:
    """``split`` without empty parts at the end; an empty text has no parts. ``separator`` is a pattern."""
    t = F.regexp_replace(col(x), f"(?:{separator})+$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, separator))


def drop_last(x) -> Column:
    t = col(x)
    return F.left(t, F.greatest(F.length(t) - 1, F.lit(0)))


def collapse_runs(x, char: str) -> Column:
    c = "\\" + char if not char.isalnum() else char
    return F.regexp_replace(col(x), f"{c}{{2,}}", char.replace("\\", "\\\\").replace("$", "\\$"))


def truncate_places(x, places: int = 4) -> Column:
    scale = float(10**places)
    v = col(x) * scale
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)) / scale


def format_number(x) -> Column:
    """Doubles with an integer's value print bare."""
    v = col(x)
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def to_roman(x) -> Column:
    """Greedy Roman numeral of a positive integer; above 3999 with further Ms."""
    n = col(x).cast("int")
    out = F.repeat(F.lit("M"), (n / 1000).cast("int"))
    rest = n % 1000
    for value, mark in ROMAN[1:]:
        out = F.concat(out, F.repeat(F.lit(mark), (rest / value).cast("int")))
        rest = rest % value
    return out


def from_roman(x) -> Column:
    """Value of a Roman numeral of any case."""
    t = F.upper(col(x))
    value = lambda c: F.coalesce(F.element_at(F.create_map(*[y for v, m in ROMAN if len(m) == 1 for y in (F.lit(m), F.lit(v))]), c), F.lit(0))
    values = F.transform(F.split(t, ""), value)
    signed = let(values, lambda v: F.transform(v, lambda a, i: F.when(a < F.coalesce(F.get(v, i + 1), F.lit(0)), -a).otherwise(a)))
    return F.aggregate(signed, F.lit(0), lambda a, v: a + v)


def to_alpha(x, upper: bool = False) -> Column:
    """1 is a, 26 z, 27 aa: letters of ordinals up to 18,278."""
    n = col(x).cast("int")
    base = 65 if upper else 97
    letter = lambda k: F.char(F.lit(base) + k)
    two = n - 27
    three = n - 703
    return (
        F.when(n <= 26, letter(n - 1))
        .when(n <= 702, F.concat(letter((two / 26).cast("int")), letter(two % 26)))
        .otherwise(F.concat(letter((three / 676).cast("int")), letter((three % 676 / 26).cast("int")), letter(three % 26)))
    )


def basename(x) -> Column:
    return F.element_at(F.split(col(x), "/"), -1)


def extension(x) -> Column:
    return F.regexp_extract(basename(x), r"(\.[^.]*)$", 1)


def rootname(x) -> Column:
    return F.regexp_replace(col(x), r"\.[^./]*$", "")


def is_uri(x) -> Column:
    return col(x).rlike(r"^[a-zA-Z][a-zA-Z0-9.+-]*:/{0,2}[^\s/]") & col(x).contains(":")


def encode_component(x) -> Column:
    return F.replace(F.url_encode(col(x)), F.lit("+"), F.lit("%20"))


def encode_spaces(x) -> Column:
    return F.replace(col(x), F.lit(" "), F.lit("%20"))


def attribute_name(x) -> Column:
    """Word characters and hyphens only, lower case."""
    return F.lower(F.regexp_replace(col(x), f"[^{WORD}-]", ""))


def uniform(x, char: str) -> Column:
    t = col(x)
    return (t != "") & (t == F.repeat(F.lit(char), F.length(t)))


def partition_title(x, separator: str = ":") -> Column:
    """main and subtitle, parted at the last separator that a space follows."""
    t = col(x)
    pattern = "^([\\s\\S]*)" + separator + " ([\\s\\S]*)$"
    return F.struct(F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)).otherwise(t).alias("main"), F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 2)).alias("subtitle"))


def limit_bytes(x, most: int = 4096) -> Column:
    """The longest beginning of at most ``most`` UTF-8 bytes that cuts no character."""
    t = col(x)
    # a cut inside a character leaves a replacement character at the end
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(t, "UTF-8"), 1, most).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(t) <= most, t).otherwise(cut)


def section_id(title, prefix: str = "_", separator: str = "_") -> Column:
    """Base of a section's id: lower case, other than word characters, spaces, dots and hyphens left out, runs of separators squeezed."""
    kept = F.regexp_replace(F.lower(col(title)), r"<[^>]+>|&" + character_reference("a-f") + "|[^ " + WORD + r".\-]+", "")
    whole = F.concat(F.lit(prefix), kept)
    if not separator:
        return F.regexp_replace(whole, " ", "")
    sep = separator[0]
    group = "[ .-]+" if sep in "-." else f"[ \\{sep}.-]+" if not sep.isalnum() else f"[ {sep}.-]+"
    out = F.regexp_replace(whole, group, sep)
    out = F.regexp_replace(out, f"\\{sep}$", "")
    if not prefix:
        out = F.regexp_replace(out, f"^\\{sep}", "")
    return F.when(out == "", F.lit(sep)).otherwise(out)


def lower_plain_sigma(x) -> Column:
    """Lower case in which a capital sigma is always the medial one."""
    t = col(x)
    return F.lower(F.replace(t, F.lit("Σ"), F.lit("σ")))


def marked_lines(spec, lines, start: int = 1) -> Column:
    """Line numbers of a list such as ``1-5,!2,10..``: ranges add, ``!`` takes away, an open end is the last line; sorted, shifted by ``start - 1``."""
    s, last = F.regexp_replace(col(spec), " ", ""), col(lines).cast("int")
    entries = F.filter(F.split(s, F.when(s.contains(","), F.lit(",")).otherwise(F.lit(";"))), lambda e: e != "")

    def numbers(e: Column) -> Column:
        e = F.regexp_replace(e, "^!", "")
        low = leading_int(F.regexp_extract(e, r"^(\d+)", 1)).cast("int")
        high = F.regexp_extract(e, r"(?:-|\.\.)(\d+)$", 1)
        top = F.when(high != "", leading_int(high).cast("int")).when(e.rlike(r"(?:-|\.\.)(?:-1)?$"), last).otherwise(low)
        return F.when(top >= low, F.sequence(low, top)).otherwise(F.array().cast("array<int>"))

    def step(held: Column, e: Column) -> Column:
        return F.when(e.startswith("!"), F.array_except(held, numbers(e))).otherwise(F.array_union(held, numbers(e)))

    return F.transform(F.array_sort(F.aggregate(entries, F.array().cast("array<int>"), step)), lambda n: n - (start - 1))


def xml_tags(x) -> Column:
    """Start, end and empty tags of a markup text, in order; comments, CDATA sections and instructions are passed over."""
    # possessive, so that a tag's length is no depth of recursion
    found = F.regexp_extract_all(col(x), F.lit(r"<!--(?:[^-]++|-(?!->))*+-->|<!\[CDATA\[(?:[^\]]++|\](?!\]>))*+\]\]>|<\?(?:[^?]++|\?(?!>))*+\?>|</?[a-zA-Z][^\s/>]*+(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"), F.lit(0))
    tags = F.filter(found, lambda t: ~t.startswith("<!") & ~t.startswith("<?"))
    return F.transform(
        tags,
        lambda t: F.struct(
            F.lower(F.regexp_extract(t, r"^</?([^\s/>]+)", 1)).alias("name"),
            F.when(t.startswith("</"), "end").when(t.endswith("/>"), "empty").otherwise("start").alias("kind"),
        ),
    )


def transliterate_squeeze(x, chars: str, to: str) -> Column:
    """Each run of the given characters as one ``to``."""
    group = "".join("\\" + c if not c.isalnum() and c != " " else c for c in chars)
    return F.regexp_replace(col(x), f"[{group}]+", to.replace("\\", "\\\\").replace("$", "\\$"))


def has_any(x, chars: str) -> Column:
    """Whether any of the characters occurs."""
    t = col(x)
    return F.translate(t, chars, "") != t if chars else F.lit(False)


def has_literal(x, literal: str) -> Column:
    return col(x).contains(literal)


def literal_index(x, literal: str, start: int = 0) -> Column:
    """Place of a literal from ``start`` on, in characters from 0; -1 if it is not there."""
    return F.locate(literal, col(x), start + 1) - 1


def escape_html(x) -> Column:
    """``&``, ``<``, ``>`` and both quotes as entities."""
    t = special_characters(x)
    return F.replace(F.replace(t, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def normalize_text(x, squeeze: bool = True, unescape: bool = False) -> Column:
    """Trimmed, line breaks as spaces, and ``\\]`` as ``]``, each if asked for."""
    t = trim(x)
    t = F.replace(t, F.lit("\n"), F.lit(" ")) if squeeze else t
    return F.replace(t, F.lit("\\]"), F.lit("]")) if unescape else t


def split_simple_csv(x) -> Column:
    """Values parted by commas, trimmed; in double quotes a comma is a character. An unclosed quote runs to the end."""
    pattern = r'(?:"[^"]*+(?:"|$)|[^",])++|(?<=,)(?=,)|^(?=,)|(?<=,)$'
    parts = F.regexp_extract_all(col(x), F.lit(pattern), F.lit(0))
    return F.when(col(x) == "", F.array().cast("array<string>")).otherwise(F.transform(parts, lambda p: F.btrim(F.replace(p, F.lit('"'), F.lit("")), F.lit(BLANKS))))


def fill_placeholder(template, value) -> Column:
    """``%s`` of a template, each with the value."""
    return F.replace(col(template), F.lit("%s"), col(value))


def filled_template(template, values: Column) -> Column:
    """``{{name}}`` of a template from a map; names that it lacks give nothing."""
    t = col(template)
    pattern = r"\{\{\s*([\w.-]+)\s*\}\}"
    found = lambda names: F.array_join(F.zip_with(F.split(t, pattern), F.transform(names, lambda n: F.coalesce(F.try_element_at(values, n), F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(t.contains("{{"), let(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), found)).otherwise(t)


def shape(x) -> Column:
    """Each letter as the class of its case or script (A, a, or o for letters without case), each digit as 0; the rest as it is."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(x), r"\p{Lu}|\p{Lt}", "A"), r"\p{Ll}", "a"), r"\p{Nd}", "0")
    return F.regexp_replace(t, r"[\p{L}&&[^Aa]]", "o")


def golden(x) -> Column:
    """SHA-256 of an output without what differs from run to run: dates, times and the lines that say when it was made."""
    t = F.regexp_replace(col(x), r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?: ?(?:Z|UTC|[+-]\d{2}:?\d{2}))?", "TIME")
    return F.sha2(F.regexp_replace(t, r"(?m)^Last updated .*$", "Last updated TIME"), 256)
