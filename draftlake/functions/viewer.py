"""Arithmetic of a drawing viewer as column expressions: view states, dimension outlines, shared links."""

from __future__ import annotations

import base64
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from draftlake.functions import geometry as G

# Mark of a link's state, and most layers in it.
MAGIC, MOST_LAYERS = b"DWGV1   ", 512


def view(pan_x: Column, pan_y: Column, zoom: Column) -> Column:
    return F.struct(pan_x.alias("pan_x"), pan_y.alias("pan_y"), zoom.alias("zoom"))


def reset() -> Column:
    return view(F.lit(0.0), F.lit(0.0), F.lit(1.0))


def pan_by(v: Column, dx: Column, dy: Column) -> Column:
    return view(v["pan_x"] + dx, v["pan_y"] + dy, v["zoom"])


def zoom_at(v: Column, x: Column, y: Column, scale: Column) -> Column:
    """Scaled about a place of the viewport, which stays where it is; a scale of 0 or less changes nothing."""
    zoom = v["zoom"] * scale
    moved = view(x - (x - v["pan_x"]) / v["zoom"] * zoom, y - (y - v["pan_y"]) / v["zoom"] * zoom, zoom)
    return F.when(scale > 0, moved).otherwise(v)


def viewport(width: Column, height: Column) -> Column:
    """Sizes of a viewport are at least 1."""
    return F.struct(F.greatest(width, F.lit(1.0)).alias("width"), F.greatest(height, F.lit(1.0)).alias("height"))


def to_viewport(v: Column, x: Column, y: Column) -> Column:
    return F.struct((x * v["zoom"] + v["pan_x"]).alias("x"), (y * v["zoom"] + v["pan_y"]).alias("y"))


def to_drawing(v: Column, x: Column, y: Column) -> Column:
    """Place in the drawing; the origin for a zoom of 0."""
    back = lambda p, pan: F.when(v["zoom"] == 0, 0.0).otherwise((p - pan) / F.nullif(v["zoom"], F.lit(0.0)))
    return F.struct(back(x, v["pan_x"]).alias("x"), back(y, v["pan_y"]).alias("y"))


def in_section_box(box: Column, p: Column, enabled: Column) -> Column:
    """Whether a point shows: everything does while the box is off."""
    return ~enabled | G.contains(box, p)


# Outlines of dimensions: struct(segments, label_at)


def _outline(segments: list[Column], at: Column) -> Column:
    return F.struct(F.array(*segments).alias("segments"), at.alias("label_at"))


def _segment(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def radial_outline(center: Column, chord: Column) -> Column:
    """A leader from the centre to the arc, the text at its end."""
    return _outline([_segment(center, chord)], chord)


def angular_outline(a1: Column, a2: Column, b1: Column, b2: Column, arc: Column) -> Column:
    """Both legs, and straight lines from their middles to the arc's point, where the text stands."""
    mid = lambda p, q: G.lerp(p, q, 0.5)
    return _outline([_segment(a1, a2), _segment(b1, b2), _segment(mid(a1, a2), arc), _segment(mid(b1, b2), arc)], arc)


def angular_outline_of_vertex(vertex: Column, start: Column, end: Column, arc: Column) -> Column:
    return angular_outline(vertex, start, vertex, end, arc)


def ordinate_outline(feature: Column, leader: Column) -> Column:
    """A leg at the feature's height to below the leader's end, then up to it."""
    knee = G.point(leader["x"], feature["y"], 0.0)
    return _outline([_segment(feature, knee), _segment(knee, leader)], leader)


# States of links

_STATE = StructType().add("pan_x", "double").add("pan_y", "double").add("zoom", "double").add("is_model", "boolean").add("layout_index", "integer").add("layers", ArrayType(BooleanType())).add("problem", "string")


@pandas_udf(StringType())
def state_text(pan_x: pd.Series, pan_y: pd.Series, zoom: pd.Series, is_model: pd.Series, layout: pd.Series, layers: pd.Series) -> pd.Series:
    """A view with its space, layout and visible layers as text for a link; more layers than it holds are an error."""

    def one(x, y, z, model, index, shown) -> str:
        shown = list(shown) if shown is not None else []
        if len(shown) > MOST_LAYERS:
            raise ValueError(f"more than {MOST_LAYERS} layers")
        bits = sum(1 << i for i, v in enumerate(shown) if v)
        data = MAGIC + struct.pack("<dddBHH", x, y, z, 0 if model else 1, index, len(shown)) + bits.to_bytes((len(shown) + 7) // 8, "little")
        return base64.urlsafe_b64encode(data).decode().rstrip("=")

    return pd.Series([one(*row) for row in zip(pan_x, pan_y, zoom, is_model, layout, layers)])


@pandas_udf(_STATE)
def state_of(texts: pd.Series) -> pd.DataFrame:
    """The state of a link's text, or what is wrong with it."""

    def one(text: str | None) -> tuple:
        nothing = (None,) * 6
        if text is None:
            return (*nothing, "no text")
        try:
            data = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
        except ValueError:
            return (*nothing, "no base64")
        size = len(MAGIC) + struct.calcsize("<dddBHH")
        if len(data) < size or not data.startswith(MAGIC):
            return (*nothing, "no state")
        x, y, z, space, index, n = struct.unpack_from("<dddBHH", data, len(MAGIC))
        bits = int.from_bytes(data[size:], "little")
        if n > MOST_LAYERS or len(data) < size + (n + 7) // 8:
            return (*nothing, "layers cut short")
        return x, y, z, space == 0, index, [bool(bits >> i & 1) for i in range(n)], None

    return pd.DataFrame([one(t) for t in texts], columns=_STATE.names)
