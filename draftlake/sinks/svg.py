"""Vector pages of drawings: fragments as column expressions, documents as rows (path, seq, line) in order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.text import escape_attribute, escape_xml, font_fallback, page_rgb


def number(v: Column) -> Column:
    """Up to six decimals, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v), r"0+$", ""), r"\.$", "")


def _attrs(stroke: Column, width: float) -> Column:
    return F.concat(F.lit(' fill="none" stroke="'), stroke, F.lit(f'" stroke-width="{width:g}"/>'))


def _tag(name: str, attributes: dict[str, Column], rest: Column) -> Column:
    parts = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        parts += [F.lit(f' {k}="'), number(v), F.lit('"')]
    return F.concat(*parts, rest)


def curve_fragment(c: Column, stroke: Column, width: float = 1.0) -> Column:
    """The element of a curve (see geometry.curve); a comment for a kind without a form, null for null."""
    rest = _attrs(stroke, width)
    line = _tag("line", {"x1": c["a"]["x"], "y1": c["a"]["y"], "x2": c["b"]["x"], "y2": c["b"]["y"]}, rest)
    circle = _tag("circle", {"cx": c["center"]["x"], "cy": c["center"]["y"], "r": c["radius"]}, rest)
    at = lambda angle: (c["center"]["x"] + c["radius"] * F.cos(angle), c["center"]["y"] + c["radius"] * F.sin(angle))
    (x1, y1), (x2, y2) = at(c["start_angle"]), at(c["end_angle"])
    large = F.when(F.abs(c["end_angle"] - c["start_angle"]) > math.pi, "1").otherwise("0")
    sweep = F.when(c["end_angle"] > c["start_angle"], "1").otherwise("0")
    arc = F.concat(F.lit('<path d="M '), number(x1), F.lit(" "), number(y1), F.lit(" A "), number(c["radius"]), F.lit(" "), number(c["radius"]), F.lit(" 0 "), large, F.lit(" "), sweep, F.lit(" "), number(x2), F.lit(" "), number(y2), F.lit('"'), rest)
    long = F.sqrt(c["major"]["x"] * c["major"]["x"] + c["major"]["y"] * c["major"]["y"])
    turn = F.degrees(F.atan2(c["major"]["y"], c["major"]["x"]))
    ellipse = F.concat(
        _tag("ellipse", {"cx": c["center"]["x"], "cy": c["center"]["y"], "rx": long, "ry": long * c["ratio"]}, F.lit(' transform="rotate(')), number(turn), F.lit(" "), number(c["center"]["x"]), F.lit(" "), number(c["center"]["y"]), F.lit(')"'), rest
    )
    other = F.concat(F.lit("<!-- "), F.replace(c["kind"], F.lit("--"), F.lit("- -")), F.lit(" has no form -->"))
    return F.when(c["kind"] == "line", line).when(c["kind"] == "circle", circle).when(c["kind"] == "arc", arc).when(c["kind"] == "ellipse", ellipse).when(c["kind"].isNotNull(), other)


def path_fragment(points: Column, closed: Column, stroke: Column, width: float = 1.0) -> Column:
    """One path through an array of points; null for fewer than two."""
    xy = F.transform(points, lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"])))
    d = F.concat(F.lit("M "), F.array_join(xy, " L "), F.when(closed, " Z").otherwise(""))
    return F.when(F.size(points) > 1, F.concat(F.lit('<path d="'), d, F.lit('"'), _attrs(stroke, width)))


def text_fragment(x: Column, y: Column, height: Column, text: Column, font: Column, rotation: Column) -> Column:
    """Upright text in the flipped page."""
    return F.concat(
        F.lit('<text transform="translate('), number(x), F.lit(","), number(y), F.lit(") scale(1,-1) rotate("), number(-F.degrees(rotation)), F.lit(')" font-size="'), number(height),
        F.lit('" font-family="'), escape_attribute(font_fallback(font)), F.lit('">'), escape_xml(text), F.lit("</text>"),
    )


def note_fragment(x: Column, y: Column, height: Column, runs: Column) -> Column:
    """A note from its runs (see text.note_runs): a span per run, a new line where the line number grows, styles as attributes."""

    def span(run: Column, i: Column) -> Column:
        first = F.when(i == 0, True).otherwise(F.get(runs, i - 1)["line"] < run["line"])
        steps = run["line"] - F.when(i == 0, F.lit(0)).otherwise(F.coalesce(F.get(runs, i - 1)["line"], F.lit(0)))
        line = F.when(first & (run["line"] > 0), F.concat(F.lit(' x="0" dy="'), number(height * 1.2 * steps), F.lit('"'))).otherwise("")
        attr = lambda name, v: F.when(v.isNull(), "").otherwise(F.concat(F.lit(f' {name}="'), v, F.lit('"')))
        drawn = F.concat_ws(" ", F.when(run["underline"], "underline"), F.when(run["overline"], "overline"))
        color = page_rgb(run["color"].try_cast("int"))
        return F.concat(
            F.lit("<tspan"), line, attr("font-family", F.when(run["font"].isNotNull(), escape_attribute(font_fallback(run["font"])))), attr("fill", F.when(run["color"].try_cast("int").isNotNull(), color)),
            attr("text-decoration", F.when(drawn != "", drawn)), F.lit(">"), escape_xml(run["text"]), F.lit("</tspan>"),
        )

    head = F.concat(F.lit('<text transform="translate('), number(x), F.lit(","), number(y), F.lit(') scale(1,-1)" font-size="'), number(height), F.lit('">'))
    return F.when(F.size(runs) > 0, F.concat(head, F.array_join(F.transform(runs, span), ""), F.lit("</text>")))


def dots(objects: DataFrame) -> DataFrame:
    """(path, n, handle, x, y, fragment): a dot for each object (path, n from 0 in order, handle), 17 apart in rows of 700."""
    x, y = F.lit(50.0) + F.pmod(F.col("n") * 17.0, F.lit(700.0)), F.lit(50.0) + F.pmod(F.col("handle"), F.lit(500)).cast("double")
    dot = F.concat(F.lit('<circle cx="'), number(F.col("x")), F.lit('" cy="'), number(F.col("y")), F.lit('" r="3" fill="none" stroke="#1A65BF" stroke-width="1.5" data-handle="0x'), F.hex("handle"), F.lit('"/>'))
    return objects.select("path", "n", "handle", x.alias("x"), y.alias("y")).withColumn("fragment", dot)


def hatch_fragment(points: Column, pattern: Column, color: Column) -> Column:
    """Even-odd fill of an outline: solid, a known pattern by reference, or solid with a comment."""
    known = F.upper(pattern).isin("ANSI31", "ANGLE")
    fill = F.when(known, F.concat(F.lit("url(#"), F.lower(pattern), F.lit(")"))).otherwise(color)
    xy = F.transform(points, lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"])))
    shape = F.concat(F.lit('<path fill-rule="evenodd" fill="'), fill, F.lit('" d="M '), F.array_join(xy, " L "), F.lit(' Z"/>'))
    return F.when(known | (F.upper(pattern) == "SOLID"), shape).otherwise(F.concat(F.lit("<!-- pattern "), F.replace(pattern, F.lit("--"), F.lit("- -")), F.lit(" drawn solid -->"), shape))


def dimension_points(a: Column, b: Column, offset: Column, height: Column) -> Column:
    """Line, extension lines, arrow heads and text place of a linear dimension; null for one without length.

    The dimension line lies perpendicular off the measured one; a head is half
    the text's height long and 0.3 of that to either side.
    """
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = F.sqrt(dx * dx + dy * dy)
    ux, uy = dx / n, dy / n
    ax, ay, bx, by = a["x"] - uy * offset, a["y"] + ux * offset, b["x"] - uy * offset, b["y"] + ux * offset
    h = height * 0.5
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    head = lambda x, y, s: F.array(p(x, y), p(x + s * ux * h - uy * h * 0.3, y + s * uy * h + ux * h * 0.3), p(x + s * ux * h + uy * h * 0.3, y + s * uy * h - ux * h * 0.3))
    return F.when(n > 0, F.struct(F.array(p(ax, ay), p(bx, by)).alias("line"), head(ax, ay, F.lit(1.0)).alias("head_a"), head(bx, by, F.lit(-1.0)).alias("head_b"), p((ax + bx) / 2, (ay + by) / 2).alias("text_at"), n.alias("measure")))


def title_block(x: float, y: float, width: float, height: float, fields: Column) -> Column:
    """Frame with a line of text for each struct(name, value) of an array."""
    frame = F.lit(f'<rect x="{x:g}" y="{y:g}" width="{width:g}" height="{height:g}" fill="none" stroke="#000000"/>')
    step = F.lit(float(height)) / F.greatest(F.size(fields), F.lit(1))
    lines = F.transform(fields, lambda f, i: F.concat(F.lit(f'<text x="{x + 4:g}" y="'), number(F.lit(float(y)) + step * (i + 0.7)), F.lit('">'), escape_xml(f["name"]), F.lit(": "), escape_xml(F.coalesce(f["value"], F.lit(""))), F.lit("</text>")))
    return F.concat(frame, F.array_join(lines, ""))


def viewport_clips(viewports: DataFrame) -> DataFrame:
    """Clip paths of (path, id, x, y, width, height), one per drawing and id: the first by its place."""
    attrs = F.concat(*[F.concat(F.lit(f' {c}="'), number(F.col(c)), F.lit('"')) for c in ("x", "y", "width", "height")])
    one = viewports.groupBy("path", "id").agg(F.min(F.struct("x", "y", "width", "height")).alias("v")).select("path", "id", "v.*")
    return one.select("path", "id", F.concat(F.lit('<clipPath id="vp-'), escape_attribute(F.col("id").cast("string")), F.lit('"><rect'), attrs, F.lit("/></clipPath>")).alias("definition"))


def page_size(mm: float, dpi: float = 96.0) -> float:
    return mm / 25.4 * dpi


def document(fragments: DataFrame, width: float, height: float, layout: str | None = None) -> DataFrame:
    """Rows (path, part, layer, seq, line) of whole documents from (path, layer, seq, fragment): prolog, groups per layer, end."""
    space = f' data-layout="{layout}"' if layout else ""
    fixed = [
        (0, f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" viewBox="0 0 {width:g} {height:g}"{space}><g transform="translate(0,{height:g}) scale(1,-1)">'),
        (2, "</g></svg>"),
    ]
    paths = fragments.select("path").distinct()
    frame = paths.select("path", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(t).alias("line")) for p, t in fixed])).alias("f")).select("path", "f.part", F.lit("").alias("layer"), F.lit(0).cast("bigint").alias("seq"), "f.line")
    layers = fragments.select("path", "layer").distinct()
    opened = layers.select("path", F.lit(1).alias("part"), "layer", F.lit(-1).cast("bigint").alias("seq"), F.concat(F.lit('<g data-layer="'), escape_attribute(F.col("layer")), F.lit('">')).alias("line"))
    closed = layers.select("path", F.lit(1).alias("part"), "layer", F.lit(2**62).cast("bigint").alias("seq"), F.lit("</g>").alias("line"))
    body = fragments.filter("fragment is not null").select("path", F.lit(1).alias("part"), "layer", F.col("seq").cast("bigint").alias("seq"), F.col("fragment").alias("line"))
    return frame.unionByName(opened).unionByName(body).unionByName(closed)


def write(rows: DataFrame, folder: str) -> None:
    """A folder per drawing with its lines in order."""
    rows.repartition("path").sortWithinPartitions("path", "part", "layer", "seq").select("path", "line").write.partitionBy("path").text(folder)
