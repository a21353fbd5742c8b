"""Text and colour of drawings as column expressions."""

from __future__ import annotations

import colorsys

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StructType

# The first colours of the index.
BASIC = {0: (0, 0, 0), 1: (255, 0, 0), 2: (255, 255, 0), 3: (0, 255, 0), 4: (0, 255, 255), 5: (0, 0, 255), 6: (255, 0, 255), 7: (255, 255, 255), 8: (65, 65, 65), 9: (128, 128, 128)}
# Brightness of the five shades of a hue, and of the greys from 250 on.
SHADES, GREYS = (255, 165, 127, 76, 38), (51, 80, 105, 130, 190, 255)


def palette() -> list[tuple[int, int, int, int]]:
    """(index, red, green, blue) of all 256 colours: ten basic ones, 24 hues of five shades, full and half saturated, six greys."""
    out = [(i, *rgb) for i, rgb in BASIC.items()]
    for i in range(10, 250):
        hue, shade, half = (i - 10) // 10, (i % 10) // 2, i % 2
        v = SHADES[shade]
        r, g, b = colorsys.hsv_to_rgb(hue / 24, 0.5 if half else 1.0, 1.0)
        out.append((i, int(r * v), int(g * v), int(b * v)))
    return out + [(250 + k, v, v, v) for k, v in enumerate(GREYS)]


def with_rgb(df: DataFrame, index: str) -> DataFrame:
    """`df` with rgb_hex of the colour index column; null outside 0 to 255."""
    table = df.sparkSession.createDataFrame(palette(), "_aci int, _r int, _g int, _b int")
    joined = df.join(F.broadcast(table), F.col(index).cast("int") == F.col("_aci"), "left")  # 256 rows
    return joined.withColumn("rgb_hex", F.when(F.col("_r").isNotNull(), F.format_string("#%02X%02X%02X", "_r", "_g", "_b"))).drop("_aci", "_r", "_g", "_b")


def page_rgb(index: Column) -> Column:
    """Colour of an index on vector pages: the basic ones, 256 black, and for all others a hue by the golden angle."""
    hue = F.pmod(index.cast("double") * 137.508, F.lit(360.0))
    c, m = 0.7, 0.15  # saturation 0.7, lightness 0.5
    x = c * (1 - F.abs(F.pmod(hue / 60.0, F.lit(2.0)) - 1))
    sector = F.floor(hue / 60.0).cast("int")
    part = lambda *which: F.round((F.coalesce(*[F.when(sector == i, x if w == "x" else F.lit(c if w == "c" else 0.0)) for i, w in enumerate(which)]) + m) * 255).cast("int")
    other = F.format_string("#%02X%02X%02X", part(*"cx00xc"), part(*"xccx00"), part(*"00xccx"))
    fixed = F.create_map(*[F.lit(v) for i, rgb in {**BASIC, 256: (0, 0, 0)}.items() for v in (i, "#%02X%02X%02X" % rgb)])
    return F.coalesce(F.try_element_at(fixed, index.cast("int")), other)


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_attribute(text: Column) -> Column:
    return F.replace(F.replace(escape_xml(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))


def font_fallback(font: Column) -> Column:
    """Shape fonts and missing ones become Arial."""
    return F.when(font.isNull() | (F.trim(font) == "") | F.lower(font).endswith(".shx"), "Arial").otherwise(font)


def dash_array(dashes: Column) -> Column:
    """Stroke pattern of a linetype: lengths without sign, dots as 0.001, and a 0 first where it begins with a gap."""
    parts = F.transform(dashes, lambda d: F.when(d == 0, F.lit(0.001)).otherwise(F.abs(d)))
    led = F.when(F.try_element_at(dashes, F.lit(1)) < 0, F.concat(F.array(F.lit(0.0)), parts)).otherwise(parts)
    return F.array_join(F.transform(led, lambda d: F.regexp_replace(F.format_string("%.3f", d), r"\.?0+$", "")), ",")


def block_space(name: Column) -> Column:
    """'model', 'paper' or 'custom' by the exact name of a block; null stays null."""
    return F.when(name == "*Model_Space", "model").when(name.rlike(r"^\*Paper_Space[0-9]*$"), "paper").when(name.isNotNull(), "custom")


def paragraphs(text: Column) -> Column:
    """Paragraphs of a note."""
    return F.split(text, r"\\P")


_CODE = regex.compile(r"\\P|\\[LlOoKk]|\\S([^;\\]*);|\\U\+([0-9A-Fa-f]{4})|\\([fFHCAWQTp])([^;\\]*);|\\([\\{}])|[{}]")
_RUN = ArrayType(StructType().add("text", "string").add("font", "string").add("color", "string").add("height", "string").add("underline", "boolean").add("overline", "boolean").add("line", "integer"))


@pandas_udf(_RUN)
def note_runs(texts: pd.Series) -> pd.Series:
    """Runs of equal style of a note with inline codes: a stack of styles, one level per brace; null gives null."""

    def one(text: str | None) -> list | None:
        if text is None:
            return None
        style = {"font": None, "color": None, "height": None, "underline": False, "overline": False}
        stack, out, line, at = [], [], 0, 0

        def emit(s: str) -> None:
            if s:
                out.append({"text": s, **style, "line": line})

        for m in _CODE.finditer(text):
            emit(text[at : m.start()])
            at = m.end()
            t = m[0]
            if t == "\\P":
                line += 1
            elif t == "{":
                stack.append(dict(style))
            elif t == "}":
                style = stack.pop() if stack else style
            elif m[1] is not None:
                # a stack shows its two parts with a stroke, whatever parts them
                emit(regex.sub(r"[\^#]", "/", m[1]))
            elif m[2]:
                emit(chr(int(m[2], 16)))
            elif m[3] in ("f", "F"):
                style["font"] = m[4].split("|")[0]
            elif m[3] == "C":
                style["color"] = m[4]
            elif m[3] == "H":
                style["height"] = m[4]
            elif t in ("\\L", "\\l"):
                style["underline"] = t == "\\L"
            elif t in ("\\O", "\\o"):
                style["overline"] = t == "\\O"
            elif m[5]:
                emit(m[5])
        emit(text[at:])
        return out

    return texts.map(one)
