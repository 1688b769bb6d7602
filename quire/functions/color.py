"""Colours as CSS writes them, and their spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let

#: The colour names of CSS level 2, and grey by both spellings.
NAMES = {
    "aqua": "00ffff", "black": "000000", "blue": "0000ff", "fuchsia": "ff00ff", "gray": "808080", "green": "008000", "grey": "808080", "lime": "00ff00", "maroon": "800000",
    "navy": "000080", "olive": "808000", "orange": "ffa500", "purple": "800080", "red": "ff0000", "silver": "c0c0c0", "teal": "008080", "white": "ffffff", "yellow": "ffff00",
}

NUMBER = r"([+-]?(?:\d+\.?\d*|\.\d+)%?)"


def _rgba(r, g, b, a) -> Column:
    limit = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.round(v))).cast("int")
    return F.struct(limit(r).alias("r"), limit(g).alias("g"), limit(b).alias("b"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), a)).alias("a"))


def _part(text: Column, whole: float) -> Column:
    """A number, or a percentage of ``whole``."""
    return F.when(text.endswith("%"), F.rtrim(text, F.lit("%")).try_cast("double") * whole / 100).otherwise(text.try_cast("double"))


def _hue(h: Column, s: Column, light: Column, n: int) -> Column:
    k = F.pmod(F.lit(float(n)) + h / 30, F.lit(12.0))
    a = s * F.least(light, 1 - light)
    return 255 * (light - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0))))


def css_color(x, names: dict[str, str] | None = None) -> Column:
    """A struct of r, g, b (0 to 255) and a (0 to 1) of ``#rgb``, ``#rgba``, ``#rrggbb``, ``#rrggbbaa``, ``rgb()``, ``hsl()`` and a name; ``transparent`` is black of no opacity. Null if it is none of these.

    Parts are parted by commas or blanks, and the opacity by a comma or slash.
    ``names``: more names, with six hexadecimal digits each.
    """
    known = F.create_map(*[F.lit(v) for kv in (NAMES | (names or {})).items() for v in kv])

    def parsed(t: Column) -> Column:
        digits = F.coalesce(F.try_element_at(known, t), F.when(t.rlike("^#(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$"), F.substring(t, 2, 8)))

        def of_hex(d: Column) -> Column:
            full = F.when(F.length(d) < 6, F.regexp_replace(d, "(.)", "$1$1")).otherwise(d)
            byte = lambda at: F.conv(F.substring(full, at, 2), 16, 10).cast("double")
            return _rgba(byte(1), byte(3), byte(5), F.when(F.length(full) == 8, byte(7) / 255).otherwise(1.0))

        function = F.regexp_extract(t, r"^(rgb|hsl)a?\(", 1)
        parts = F.regexp_extract_all(F.regexp_extract(t, r"^(?:rgb|hsl)a?\(\s*([^)]*?)\s*\)$", 1), F.lit(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:%|deg)?)"), F.lit(1))

        def of_parts(p: Column) -> Column:
            part = lambda i, whole: _part(F.regexp_replace(F.get(p, F.lit(i)), "deg$", ""), whole)
            alpha = F.when(F.size(p) > 3, part(3, 1.0)).otherwise(1.0)
            rgb = _rgba(part(0, 255.0), part(1, 255.0), part(2, 255.0), alpha)
            h, s, light = part(0, 360.0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), part(1, 1.0))), F.greatest(F.lit(0.0), F.least(F.lit(1.0), part(2, 1.0)))
            hsl = _rgba(_hue(h, s, light, 0), _hue(h, s, light, 8), _hue(h, s, light, 4), alpha)
            return F.when(F.size(p).isin(3, 4) & (function == "rgb"), rgb).when(F.size(p).isin(3, 4) & (function == "hsl"), hsl)

        clear = _rgba(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
        return F.when(t == "transparent", clear).when(digits.isNotNull(), let(digits, of_hex)).when(function != "", let(parts, of_parts))

    return let(F.lower(F.trim(col(x))), parsed)


def to_gray(c: Column) -> Column:
    """Luma of a colour struct, 0 to 1."""
    return (0.299 * c["r"] + 0.587 * c["g"] + 0.114 * c["b"]) / 255


def to_cmyk(c: Column) -> Column:
    """A struct of c, m, y, k (0 to 1) of an opaque colour."""

    def of_black(k: Column) -> Column:
        ink = lambda v: F.when(k == 1, 0.0).otherwise((1 - v / 255 - k) / (1 - k))
        return F.struct(ink(c["r"]).alias("c"), ink(c["g"]).alias("m"), ink(c["b"]).alias("y"), k.alias("k"))

    return let(1 - F.greatest(c["r"], c["g"], c["b"]) / 255, of_black)


def from_cmyk(c: Column) -> Column:
    value = lambda ink: 255 * (1 - c[ink]) * (1 - c["k"])
    return _rgba(value("c"), value("m"), value("y"), F.lit(1.0))


def spot(name, tint, base: Column) -> Column:
    """A named ink with its tint (0 to 1) and the colour that shows it where the ink is missing."""
    return F.struct(col(name).alias("name"), col(tint).cast("double").alias("tint"), base.alias("base"))
