"""Record layouts of drawings, as data, and the one interpreter that reads and writes them.

A layout is a text of fields in wire order: `name:CODE`, with
`name:CODE?condition` for fields that are only present where the condition on
earlier fields and the version `v` holds, `name:CODE*count` for as many values
as a condition-like expression says, `!default` for the value of an absent field, `name:n[CODE]` for a list behind
its count of code n, and `{...}` in place of a code for nested records. A name that
starts with `_` steers the layout and stays out of the result; `=` defines such
a name, or a derived field, by an expression. Schemas follow from the layouts.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from draftlake.functions.bits import BitReader, BitsExhausted, BitWriter
from draftlake.sources.limits import Limits, exceeded

P2, P3 = "struct<x:double,y:double>", "struct<x:double,y:double,z:double>"
HANDLE = "struct<code:tinyint,counter:tinyint,value:bigint>"
# Spark types of the wire codes.
TYPES = {
    "B": "boolean", "BB": "tinyint", "B3": "tinyint", "BS": "smallint", "BSu": "int", "BL": "int", "BLu": "bigint", "BLL": "bigint", "BD": "double",
    "RC": "smallint", "RS": "int", "RL": "bigint", "RD": "double", "H": HANDLE, "TV": "string", "BT": "double", "BE": P3,
    "2BD": P2, "2RD": P2, "3BD": P3, "3RD": P3, "DATA": "binary", "RLDATA": "binary", "RCDATA": "binary", "BYTES": "binary", "CHUNKS": "binary", "XLOOP": "array<struct<app:struct<code:tinyint,counter:tinyint,value:bigint>,data:binary>>",
}

#: Lowest number of a class that a drawing names.
FIRST_CLASS = 500
#: Most elements a count may claim, whatever the remaining bits allow.
MOST = 1_000_000
MOST_XDATA = 256


@dataclass
class Field:
    name: str
    code: str = ""
    when: str = ""
    count: str = ""
    expr: str = ""
    default: str = ""
    sub: list[Field] = field(default_factory=list)

    @property
    def hidden(self) -> bool:
        return self.name.startswith("_")


_TOKEN = re.compile(r"\s*(?:([\w]+)(?::|(=)))")


def _expression(text: str, at: int) -> tuple[str, int]:
    """A condition, count or default, up to white space or the next suffix outside of parentheses."""
    depth, start = 0, at
    while at < len(text) and (depth or not (text[at].isspace() or text[at] in "}]?*!" and text[at : at + 2] != "!=")):
        depth += {"(": 1, ")": -1}.get(text[at], 0)
        at += 1
    return text[start:at], at


def parse(text: str, at: int = 0) -> tuple[list[Field], int]:
    out = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text) or text[at] == "}":
            return out, at
        m = _TOKEN.match(text, at)
        f, at = Field(m[1]), m.end()
        if m[2]:
            f.expr, at = _expression(text, at)
            out.append(f)
            continue
        f.code, f.sub, f.count, at = _item(text, at)
        while at < len(text) and text[at] in "?*!":
            kind = text[at]
            value, at = _expression(text, at + 1)
            if kind == "?":
                f.when = value
            elif kind == "*":
                f.count = "=" + value
            else:
                f.default = value
        out.append(f)


def _item(text: str, at: int) -> tuple[str, list[Field], str, int]:
    """(code, nested fields, count code, position) of `CODE`, `{...}` or `n[item]`."""
    if text[at] == "{":
        sub, end = parse(text, at + 1)
        return "{}", sub, "", end + 1
    m = re.compile(r"\w+").match(text, at)
    code, at = m[0], m.end()
    if at < len(text) and text[at] == "[":
        inner, sub, count, at = _item(text, at + 1)
        if count:
            sub, inner = [Field("item", inner, "", count, "", "", sub)], "{item}"
        return inner, sub, code, at + 1
    return code, [], "", at


@lru_cache(maxsize=None)
def _compiled(expr: str):
    return compile(expr, "<layout>", "eval")


def _value(expr: str, env: dict):
    return eval(_compiled(expr), {"__builtins__": {}, "dict": dict, "len": len, "or0": lambda x: x or 0}, env)  # noqa: S307 - layouts are constants of this module


class Layout:
    def __init__(self, text: str):
        self.fields, _ = parse(text)

    def schema(self) -> str:
        return _schema(self.fields)

    def read(self, r: BitReader, version: int) -> dict:
        return _read(self.fields, r, {"v": version, "count": 1, "left": r.remaining})

    def write(self, w: BitWriter, version: int, record: dict) -> None:
        _write(self.fields, w, {"v": version, "count": 1, "left": lambda: 64}, record)


def _type(f: Field) -> str:
    if f.expr:
        return {"i": "int", "d": "double", "b": "boolean", "p": P3}[f.expr.partition("|")[0]] if "|" in f.expr else "int"
    base = _schema(f.sub) if f.code == "{}" else f"array<{_type(f.sub[0]).removeprefix('array<')[:-1]}>" if f.code == "{item}" else TYPES[f.code]
    if f.code == "{item}":
        base = _type(f.sub[0])
    return f"array<{base}>" if f.count else base


def _schema(fields: list[Field]) -> str:
    shown = [f for f in fields if not f.hidden]
    return "struct<" + ",".join(f"{f.name}:{_type(f)}" for f in shown) + ">" if shown else "struct<present:boolean>"


def _point(r: BitReader, code: str) -> dict:
    one = r.BD if code[1:] == "BD" else r.RD
    return {k: one() for k in "xyz"[: int(code[0])]}


def _one(f: Field, r: BitReader, env: dict):
    if f.code == "{}":
        return _read(f.sub, r, {**env})
    if f.code == "{item}":
        return _many(f.sub[0], r, env)
    if f.code[0] in "23" and len(f.code) == 3:
        return _point(r, f.code)
    if f.code == "BE":
        return dict(zip("xyz", r.BE()))
    if f.code == "CHUNKS":
        parts = []
        while r.B():
            n = r.BLu()
            if 8 * n > r.remaining():
                raise BitsExhausted(f"{n} bytes at {r.at} of {r.size}")
            parts.append(r.raw(n))
        return b"".join(parts)
    if f.code == "XLOOP":
        out = []
        while n := r.BSu():
            if len(out) >= MOST_XDATA:
                raise ValueError("too much extended data")
            out.append({"app": r.H(), "data": r.raw(n)})
        return out
    if f.code in ("DATA", "RLDATA", "RCDATA", "BYTES"):
        n = r.BLu() if f.code == "DATA" else r.RL() if f.code == "RLDATA" else r.RC() if f.code == "RCDATA" else env["_bytes"]
        if 8 * n > r.remaining():
            raise BitsExhausted(f"{n} bytes at {r.at} of {r.size}")
        return r.raw(n)
    return getattr(r, f.code)()


def _many(f: Field, r: BitReader, env: dict) -> list:
    n = _value(f.count[1:], env) if f.count[0] == "=" else getattr(r, f.count)()
    # every element takes at least a bit, so a larger count is an error before anything is allocated
    if n < 0 or n > MOST or n > r.remaining():
        raise BitsExhausted(f"{n} elements at {r.at} of {r.size}")
    return [_one(f, r, env) for _ in range(n)]


def _read(fields: list[Field], r: BitReader, env: dict) -> dict:
    out = {}
    for f in fields:
        if f.expr:
            env[f.name] = _value(f.expr.rpartition("|")[2], env)
        elif f.when and not _value(f.when, env):
            env[f.name] = _value(f.default, env) if f.default else None
        else:
            env[f.name] = _many(f, r, env) if f.count else _one(f, r, env)
        if not f.hidden:
            out[f.name] = env[f.name]
    return out or {"present": True}


def _write(fields: list[Field], w: BitWriter, env: dict, record: dict) -> None:
    for f in fields:
        if f.expr:
            env[f.name] = _value(f.expr.rpartition("|")[2], {**record, **env})
            continue
        value = record.get(f.name)
        env[f.name] = value
        if f.when and not _value(f.when, env):
            continue
        if f.count:
            _write_many(f, w, env, value or [])
        else:
            _write_one(f, w, env, value)


def _write_many(f: Field, w: BitWriter, env: dict, values: list) -> None:
    if f.count[0] != "=":
        getattr(w, f.count)(len(values))
    for v in values:
        _write_one(f, w, env, v)


def _write_one(f: Field, w: BitWriter, env: dict, value) -> None:
    if value is None and f.code not in ("{}", "{item}"):
        value = {"H": {"code": 0, "counter": 0, "value": 0}, "TV": "", "DATA": b"", "RCDATA": b"", "BYTES": b"", "CHUNKS": b""}.get(f.code, dict.fromkeys("xyz", 0.0) if f.code[0] in "23" else 0)
    if f.code == "{}":
        _write(f.sub, w, {**env}, value)
    elif f.code == "{item}":
        _write_many(f.sub[0], w, env, value)
    elif f.code[0] in "23" and len(f.code) == 3:
        for k in "xyz"[: int(f.code[0])]:
            (w.BD if f.code[1:] == "BD" else w.RD)(value[k])
    elif f.code == "BE":
        w.BE(tuple(value[k] for k in "xyz"))
    elif f.code == "CHUNKS":
        w.B(bool(value))
        if value:
            w.BLu(len(value))
            w.raw(bytes(value))
            w.B(False)
    elif f.code == "XLOOP":
        for x in value or []:
            w.BSu(len(x["data"]))
            w.H(x["app"])
            w.raw(bytes(x["data"]))
        w.BSu(0)
    elif f.code in ("DATA", "RLDATA", "RCDATA", "BYTES"):
        if f.code != "BYTES":
            {"DATA": w.BLu, "RLDATA": w.RL, "RCDATA": w.RC}[f.code](len(value or b""))
        w.raw(bytes(value or b""))
    else:
        getattr(w, f.code)(value)


# Field order of the records on the wire.
_TEXT = (
    "_flags:RC elevation:RD?_flags&1!0.0 insertion_point:2RD alignment_point:2RD?_flags&2 extrusion:BE thickness:BT oblique_angle:BD?_flags&4!0.0 rotation_angle:BD?_flags&8!0.0 "
    "height:BD width_factor:BD?_flags&16!1.0 text:TV generation:BS?_flags&32!0 h_align:BS?_flags&64!0 v_align:BS?_flags&128!0"
)
_DIMENSION = (
    "version_flag:RC?v>=2010 extrusion:3BD text_midpoint:2RD elevation:BD flags:RC user_text:TV text_rotation:BD horiz_dir:BD ins_scale:3BD ins_rotation:BD "
    "attachment:BS line_spacing_style:BS line_spacing_factor:BD actual_measurement:BD _unknown:B?v>=2007 flip_arrow_1:B?v>=2007 flip_arrow_2:B?v>=2007 def_point_12:2RD"
)
_SOLID = "acis_empty:B version:BS?(not(acis_empty)) sat_blob:CHUNKS?(not(acis_empty))"
_SAT = "sat:{empty:B version:BS?(not(empty)) bytes:CHUNKS?(not(empty))}"
_HEADER = "header:{name:TV is_xref_dependent:B xref_index_plus_1:BS is_xref_resolved:B} "
#: What stands before the fields of every entity.
COMMON = (
    "xdata:XLOOP has_graphics:B graphics:RLDATA?has_graphics entity_mode:BB num_reactors:BL no_xdictionary:B binary_data:B?v>=2004 no_links:B ltype_by_layer:B color_index:BS ltype_scale:BD ltype_flags:BB plotstyle_flags:BB "
    "material_flags:BB?v>=2007 shadow_flags:BB?v>=2007 full_visual_style:B?v>=2010 face_visual_style:B?v>=2010 edge_visual_style:B?v>=2010 invisibility:BS lineweight:RC?v>=2000"
)
ENTITIES: dict[str, tuple[int, str]] = {
    "TEXT": (0x01, _TEXT),
    "ATTRIB": (0x02, "text:{" + _TEXT + "} tag:TV field_length:BS flags:RC lock_position:B?v>=2018"),
    "ATTDEF": (0x03, "text:{" + _TEXT + "} prompt:TV tag:TV field_length:BS flags:RC lock_position:B?v>=2018"),
    "BLOCK": (0x04, "name:TV"),
    "ENDBLK": (0x05, ""),
    "INSERT": (0x07, "insertion_point:3BD _scale:BB _three:3BD?_scale==0 _one:BD?_scale==1 scale=p|((_three)if(_scale==0)else(dict(x=_one,y=_one,z=_one)if(_scale==1)else(dict(x=1.0,y=1.0,z=1.0)))) rotation:BD extrusion:BE has_attribs:B"),
    "VERTEX_2D": (0x0A, "flag:RC location:3BD start_width:BD end_width:BD bulge:BD vertex_id:BLu?v>=2010 tangent_direction:BD?flag&2"),
    "POLYLINE_2D": (0x0F, "flag:BSu curve_type:BS default_start_width:BD default_end_width:BD thickness:BT elevation:BD extrusion:BE"),
    "ARC": (0x11, "center:3BD radius:BD thickness:BT extrusion:BE start_angle:BD end_angle:BD"),
    "CIRCLE": (0x12, "center:3BD radius:BD thickness:BT extrusion:BE"),
    "LINE": (
        0x13,
        "is_2d:B _x:RD _dx:BD _y:RD _dy:BD _z:RD?(not(is_2d)) _dz:BD?(not(is_2d)) start=p|dict(x=_x,y=_y,z=(_z)if(not(is_2d))else(0.0)) end=p|dict(x=_x+_dx,y=_y+_dy,z=(_z+_dz)if(not(is_2d))else(0.0)) thickness:BT extrusion:BE",
    ),
    "DIMENSION_ORDINATE": (0x14, "common:{" + _DIMENSION + "} def_point_10:3BD feature_location_13:3BD leader_endpoint_14:3BD flag_2:RC"),
    "DIMENSION_LINEAR": (0x15, "common:{" + _DIMENSION + "} def_point_13:3BD def_point_14:3BD def_point_10:3BD extension_line_rotation:BD dim_rotation:BD"),
    "DIMENSION_ALIGNED": (0x16, "common:{" + _DIMENSION + "} def_point_13:3BD def_point_14:3BD def_point_10:3BD extension_line_rotation:BD"),
    "DIMENSION_ANG3PT": (0x17, "common:{" + _DIMENSION + "} def_point_10:3BD def_point_13:3BD def_point_14:3BD def_point_15:3BD"),
    "DIMENSION_ANG2LN": (0x18, "common:{" + _DIMENSION + "} def_point_13:3BD def_point_14:3BD def_point_15:3BD def_point_10:3BD def_point_16:2RD"),
    "DIMENSION_RADIUS": (0x19, "common:{" + _DIMENSION + "} def_point_10:3BD def_point_15:3BD leader_length:BD"),
    "DIMENSION_DIAMETER": (0x1A, "common:{" + _DIMENSION + "} def_point_15:3BD def_point_10:3BD leader_length:BD"),
    "POINT": (0x1B, "position:3BD thickness:BT extrusion:BE x_axis_angle:BD"),
    "3DFACE": (
        0x1C,
        "_plain:B _flat:B _p:{x:RD y:RD z:RD?(not(up))!0.0} _a:{x:BD y:BD z:BD?(not(up))!0.0} _b:{x:BD y:BD z:BD?(not(up))!0.0} _c:{x:BD y:BD z:BD?(not(up))!0.0}?(not(_plain)) invisible_edges:BSu?(not(_plain))!0".replace("up", "_flat"),
    ),
    "POLYFACE_MESH": (0x1D, "flags:BS vertex_count:BS face_count:BS m_density:BS n_density:BS first_vertex_handle:H last_vertex_handle:H"),
    "POLYGON_MESH": (0x1E, "flags:BS m_density:BS n_density:BS m_vert_count:BS n_vert_count:BS first_vertex_handle:H last_vertex_handle:H"),
    "SOLID": (0x1F, "thickness:BT elevation:BD corners:2RD*4 extrusion:BE"),
    "TRACE": (0x20, "thickness:BT elevation:BD corners:2RD*4 extrusion:BE"),
    "VIEWPORT": (0x22, "center:3BD width:BD height:BD"),
    "ELLIPSE": (0x23, "center:3BD major_axis:3BD extrusion:3BD axis_ratio:BD start_param:BD end_param:BD"),
    "SPLINE": (
        0x24,
        "scenario:BLu flag1:BLu?(v>=2013) knot_param:BLu?(v>=2013) degree:BD "
        "fit:{tolerance:BD start_tangent:3BD end_tangent:3BD points:BLu[3BD]}?(scenario==2) "
        "control:{rational:B closed:B periodic:B knot_tolerance:BD control_tolerance:BD knots:BLu[BD] points:BLu[3BD] weights:BD*(len(points)if(rational)else(0))}?(scenario==1)",
    ),
    "REGION": (0x25, _SOLID),
    "3DSOLID": (0x26, _SOLID),
    "BODY": (0x27, _SOLID),
    "RAY": (0x28, "start:3BD direction:3BD"),
    "XLINE": (0x29, "point:3BD direction:3BD"),
    "MTEXT": (
        0x2C,
        "insertion_point:3BD extrusion:3BD x_axis_direction:3BD rect_width:BD rect_height:BD?v>=2007 nominal_text_height:BD attachment_point:BS drawing_direction:BS "
        "extents_height:BD extents_width:BD text:TV linespace_style:BS linespace_factor:BD _unknown:B",
    ),
    "LEADER": (0x2D, "_unknown:B annot_type:BS path_type:BS points:BLu[3BD] end_projection:3BD extrusion:3BD horiz_direction:3BD offset_to_block_insertion:3BD"),
    "TOLERANCE": (0x2E, "unknown_short:BS?v>=2007 height:BD dimgap:BD insertion_point:3BD x_axis_direction:3BD extrusion:3BD text_string:TV dimstyle_handle:H"),
    "MLINE": (
        0x2F,
        "scale_factor:BD justification:RC scale_point:3BD extrusion:3BD open_closed_flags:BS num_lines:BS _n:BS "
        "vertices:{location:3BD direction:3BD miter:3BD lines:{segments:BS[BD] fills:BS[BD]}*num_lines}*_n",
    ),
    "OLE2FRAME": (0x4A, "ole_version:BS data:DATA oleobject_type:BS mode:RC"),
    "LWPOLYLINE": (
        0x4D,
        "flag:BSu elevation:BD?flag&1 thickness:BD?flag&2 extrusion:3BD?flag&4 _n:BLu _b:BLu?flag&0x400 _i:BLu?flag&0x8000 _w:BLu?flag&0x80 constant_width:BD?flag&0x20 "
        "vertices:2RD*_n bulges:BD*or0(_b) vertex_ids:BLu*or0(_i) widths:{start:BD end:BD}*or0(_w) closed=b|flag&8!=0",
    ),
    "HATCH": (
        0x4E,
        "_g:BS?v>=2004 gradient:{reserved:BLu angle:BD shift:BD single_color:BLu tint:BD colors:BLu[{value:BD index:BS}] name:TV}?(v>=2004)and(_g) "
        "elevation:BD extrusion:3BD pattern_name:TV solid_fill:B associative:B "
        "paths:BLu[{flags:BLu has_bulges:B?flags&2 closed:B?flags&2 vertices:BLu[{point:2BD bulge:BD?has_bulges}]?flags&2 "
        "edges:BLu[{kind:RC line_start:2BD?kind==1 line_end:2BD?kind==1 center:2BD?(kind in(2,3)) radius:BD?kind==2 major:2BD?kind==3 ratio:BD?kind==3 start_angle:BD?(kind in(2,3)) end_angle:BD?(kind in(2,3)) ccw:B?(kind in(2,3)) "
        "degree:BLu?kind==4 rational:B?kind==4 periodic:B?kind==4 _k:BLu?kind==4 _c:BLu?kind==4 knots:BD*((_k)if(kind==4)else(0)) controls:2BD*((_c)if(kind==4)else(0)) weights:BD*((_c)if((kind==4)and(rational))else(0)) fits:BLu[2BD]?kind==4}]?not(flags&2) "
        "boundary_handles:BLu[H]}] pattern_style:BS pattern_angle:BD?not(solid_fill) pattern_scale:BD?not(solid_fill) pattern_double:B?not(solid_fill) "
        "pattern_lines:BS[{angle:BD base:2BD offset:2BD dashes:BS[BD]}]?not(solid_fill) pixel_size:BS seed_points:BLu[2BD] _style:H?v>=2007",
    ),
    "PROXY_ENTITY": (0x1F2, "proxy_class_id:BLu raw_proxy_data:DATA handles:BLu[H]"),
    "CAMERA": (0x4F8, "origin:3BD direction:3BD focal_length:BD field_of_view:BD view_handle:H"),
    "SUN": (
        0x4F9,
        "version:BLu status:B sun_color_index:BS intensity:BD has_shadow:B julian_day:BLu time_of_day:BLu daylight_savings:B shadow_type_map_flag:B shadow_softness_flag:B shadow_map_size_flag:B shadow_softness_samples:BS",
    ),
    "LIGHT": (
        0x4FA,
        "version:BLu name:TV light_type:BLu is_on:B shadow_type:BS has_shadow_softness:B position:3BD?(light_type in(2,3,4)) target:3BD?(light_type in(3,4)) intensity:BD color_index:BS plot_glyph:B",
    ),
    "GEODATA": (
        0x4FB,
        "version:BLu block_handle:H origin:3BD design_to_ref_x_axis:3BD design_to_ref_y_axis:3BD reference_point:3BD reference_north_dir:3BD design_to_ref_x_scale:BD design_to_ref_y_scale:BD "
        "coordinate_system_def:TV geo_rss_tag:TV observation_from_tag:TV observation_to_tag:TV observation_coverage_tag:TV",
    ),
}
#: Classes of entities, by name; a drawing gives them codes of its own.
CLASS_ENTITIES: dict[str, str] = {
    "IMAGE": "_class:BLu insertion_point:3BD u_vector:3BD v_vector:3BD image_size:2RD display_flags:BS clipping:B brightness:RC contrast:RC fade:RC clip_mode:B?v>=2010!False "
    "clip_type:BS _n:BLu clip_boundary:2RD*((2)if(clip_type==1)else(_n))",
    "UNDERLAY": "insertion_point:3BD scale:3BD rotation:BD normal:3BD flags:RC contrast:RC fade:RC clip_polygon:BS[2BD] definition_handle:H",
    "WIPEOUT": "clip_state:BLu clip_polygon:BS[2BD] show_clipped:B brightness:RC contrast:RC fade:RC",
    "MULTILEADER": "class_version:BS content_type:BS draw_mleader_order_type:BS draw_leader_order_type:BS max_leader_segments_points:BLu first_seg_angle_constraint:BD second_seg_angle_constraint:BD leader_type:BS line_color:BS "
    "linetype_handle:H line_weight:BL enable_landing:B enable_dogleg:B landing_distance:BD arrow_head_size:BD content_type_again:BS mtext_default_text:TV text_normal_direction:3BD text_style_handle:H "
    "text_left_attachment_type:BS text_angle_type:BS text_alignment_type:BS text_color:BS text_height:BD text_frame_enabled:B use_default_mtext_text:B block_content_normal:3BD block_content_handle:H "
    "block_content_color:BS block_content_scale:3BD block_content_rotation:BD block_content_connection:BS is_annotative:B arrowhead_overrides:BS[{index:BLu handle:H}] block_labels:BS[{index:BLu value:BLu}] "
    "enable_text_attachment_to_leader:B enable_text_attachment_to_dogleg:B",
    "EXTRUDEDSURFACE": _SAT + " sweep_vector:3BD draft_angle:BD",
    "REVOLVEDSURFACE": _SAT + " axis_origin:3BD axis_direction:3BD sweep_angle:BD",
    "SWEPTSURFACE": _SAT + " path_handle:H align_option:BB",
    "LOFTEDSURFACE": _SAT + " cross_section_handles:BLu[H] start_tangent_mag:BD end_tangent_mag:BD",
    "HELIX": "axis_base_point:3BD start_point:3BD axis_vector:3BD radius:BD turns:BD turn_height:BD right_handed:B constrain_type:BS",
    "MESH": "version:BS blend_crease:B subdivision_level:BS vertices:BS[3BD] faces:BLu[BLu[BLu]] edges:BLu[{a:BS b:BS}] creases:BD*len(edges)",
    "IMAGEDEF": "class_version:BLu image_size_pixels:2RD file_path:TV is_loaded:B pixel_size_units:RC pixel_width_size:RD pixel_height_size:RD",
}
TABLES: dict[str, tuple[int, str]] = {
    "BLOCK_RECORD": (0x31, _HEADER + "is_anonymous:B has_attribs:B is_xref:B xref_overlay:B is_loaded_xref:B num_owned_objects:BLu?v>=2004 base_point:3BD xref_path:TV"),
    "LAYER": (0x33, _HEADER + "flags:BS plot_flag:B?v>=2000!True lineweight:BS color_index:BS"),
    "STYLE": (0x35, _HEADER + "flags:RC fixed_height:BD width_factor:BD oblique_angle:BD generation:RC last_height:BD font_filename:TV bigfont_filename:TV"),
    "LTYPE": (
        0x39,
        _HEADER + "flags:RC used_count:RS description:TV pattern_length:BD alignment:RC dashes:RC[{length:BD flags:BS shape_x:BD shape_y:BD scale:BD rotation:BD shape_number:BS text:TV?flags&2 style_handle:H?((flags&4)and(not(flags&2)))}]",
    ),
    "VIEW": (0x3D, _HEADER + "view_height:BD view_width:BD view_center:2BD target:3BD view_direction:3BD twist_angle:BD lens_length:BD front_clip:BD back_clip:BD view_mode:BS render_mode:RC is_paperspace:B is_associated_ucs:B"),
    "UCS": (0x3F, _HEADER + "origin:3BD x_axis:3BD y_axis:3BD elevation:BD ortho_view_type:BS base_ucs_handle:H"),
    "VPORT": (
        0x41,
        _HEADER + "view_height:BD aspect_ratio:BD view_center:2BD view_target:3BD view_direction:3BD view_twist:BD lens_length:BD front_clip:BD back_clip:BD view_mode:BS render_mode:RC lower_left:2RD upper_right:2RD "
        "ucs_at_origin:B ucs_per_vport:B snap_base:2RD snap_spacing:2RD grid_spacing:2RD snap_rotation:BD",
    ),
    "APPID": (0x43, _HEADER + "unknown:RC"),
    "DIMSTYLE": (0x45, _HEADER + "dimscale:BD dimasz:BD dimexo:BD dimexe:BD dimtxt:BD dimcen:BD dimtfac:BD dimlfac:BD dimtih:B dimtoh:B dimtad:RC dimtolj:RC dimaltf:BD dimaltrnd:BD dimupt:B"),
}
OBJECTS: dict[str, str] = {
    "DICTIONARY": "_n:BLu cloning_flag:BS _hard:RC hard_owner=b|_hard!=0 entries:{name:TV handle:H}*_n",
    "XRECORD": "data:DATA cloning_flags:BS?v>=2000",
    "CONTROL": "num_entries:BLu",
    "ACAD_GROUP": "name:TV unnamed:B selectable:B member_handles:BLu[H]",
    "ACAD_LAYOUT": "flags:BS layout_name:TV tab_order:BS paper_min_limits:2RD paper_max_limits:2RD insertion_base_point:3BD min_extents:3BD max_extents:3BD elevation:BD ucs_ortho_view_type:BS ucs_origin:3BD ucs_x_axis:3BD ucs_y_axis:3BD "
    "plot_settings_handle:H block_record_handle:H last_active_viewport_handle:H base_ucs_handle:H named_ucs_handle:H",
    "ACAD_MATERIAL": "name:TV description:TV ambient_color_method:BL ambient_color:BS ambient_color_factor:BD diffuse_color_method:BL diffuse_color:BS diffuse_color_factor:BD specular_color_factor:BD specular_gloss_factor:BD "
    "reflection_factor:BD opacity_factor:BD bump_amount:BD refraction_factor:BD translucence:BD self_illumination:BL luminance:BD luminance_mode:BL",
    "ACAD_MLINESTYLE": "name:TV description:TV flags:BS fill_color:BS start_angle:BD end_angle:BD lines:RC[{offset:BD color:BS linetype_index:BS}]",
    "ACAD_PLOTSETTINGS": "page_setup_name:TV printer_config_name:TV flags:BS paper_lower_left:2BD paper_upper_right:2BD plot_origin:2BD paper_units:BS plot_rotation:BS plot_type:BS window_lower_left:2BD window_upper_right:2BD "
    "numerator:BD denominator:BD shade_plot_mode:BS shade_plot_resolution_level:BS shade_plot_dpi:BS stylesheet_name:TV scale_to_fit:B shade_plot_object_handle:H",
    "ACAD_PROPERTYSET_DATA": "propset_definition_name:TV properties:BLu[{name:TV kind:BLu whole:BL?(kind in(1,4)) number:BD?(kind in(2,5)) text:TV?kind==3}]",
    "ACAD_SCALE": "scale_name:TV paper_units:BD drawing_units:BD flag:BS",
    "ACAD_VISUALSTYLE": "description:TV face_lighting_model:BS face_lighting_quality:BS face_color_mode:BS face_opacity:BD face_specular:BD face_mono_color:BS face_modifier:BS edge_model:BS edge_style_apply_flags:BL edge_intersection_color:BS "
    "edge_obscured_color:BS edge_color:BS edge_silhouette_color:BS",
    "CUSTOM_DICTIONARY": "entries:BS[{name:TV handle:H}]",
    "PROXY_OBJECT": "proxy_class_id:BLu raw_proxy_data:DATA handles:BLu[H]",
    "XDATA": "app_handle:H items:BLu[{code:BS text:TV?(1000<=code<=1003) data:RCDATA?code==1004 handle:H?code==1005 point:3BD?(1010<=code<=1013) real:BD?(1020<=code<=1042) short:BS?code==1070 whole:BL?code==1071}]",
}
#: Records that stand inside others, behind what those have in common, or in a section of their own.
PARTS: dict[str, str] = {
    "CLASS_MAP_EXTENSION": "entries:{class_number:BSu proxy_flags:BSu app_name:TV cpp_class_name:TV dxf_record_name:TV was_zombie:B?v>=2000!False item_class_id:BSu}*count",
    "PROXY_PASSTHROUGH": "proxy_class_id:BLu application_version:BLu data_size_bits:BLu _bytes=(data_size_bits+7)//8 raw_proxy_data:BYTES original_object_handle:H?(v>=2007)and(left()>=8)",
    "DIMENSION_LINEAR_SUFFIX": "extension_line_1_origin:3BD extension_line_2_origin:3BD dim_line_definition_point:3BD rotation_radians:BD oblique_angle_radians:BD",
    "DIMENSION_ALIGNED_SUFFIX": "extension_line_1_origin:3BD extension_line_2_origin:3BD dim_line_definition_point:3BD oblique_angle_radians:BD",
    "DIMENSION_ANG2LN_SUFFIX": "extension_line_1a:3BD extension_line_1b:3BD extension_line_2a:3BD extension_line_2b:3BD",
    "DIMENSION_ANG3PT_SUFFIX": "center:3BD first_extension_point:3BD second_extension_point:3BD",
    "DIMENSION_ORDINATE_SUFFIX": "feature_location:3BD leader_endpoint:3BD flags:RC",
    "DIMENSION_RADIUS_SUFFIX": "center_point:3BD first_arc_point:3BD leader_length:BD",
    "DIMENSION_DIAMETER_SUFFIX": "center_point:3BD first_arc_point:3BD leader_length:BD",
}
# Class names, besides those that are a kind's own name.
CLASS_NAMES: dict[str, str] = {
    "RASTERIMAGE": "IMAGE", "MLEADER": "MULTILEADER", "ACDBMULTILEADER": "MULTILEADER", "ACDBEXTRUDEDSURFACE": "EXTRUDEDSURFACE", "ACDBREVOLVEDSURFACE": "REVOLVEDSURFACE",
    "ACDBSWEPTSURFACE": "SWEPTSURFACE", "ACDBLOFTEDSURFACE": "LOFTEDSURFACE", "ACDBHELIX": "HELIX", "PDFUNDERLAY": "UNDERLAY", "ACDBPDFUNDERLAY": "UNDERLAY", "DWFUNDERLAY": "UNDERLAY",
    "ACDBDWFUNDERLAY": "UNDERLAY", "DGNUNDERLAY": "UNDERLAY", "ACDBDGNUNDERLAY": "UNDERLAY", "ACDBWIPEOUT": "WIPEOUT", "ACDBSUBDMESH": "MESH", "ACDBMESH": "MESH", "MATERIAL": "ACAD_MATERIAL",
    "PLOTSETTINGS": "ACAD_PLOTSETTINGS", "AEC_PROPERTY_SET": "ACAD_PROPERTYSET_DATA", "SCALE": "ACAD_SCALE", "VISUALSTYLE": "ACAD_VISUALSTYLE", "ACDBDICTIONARYWDFLT": "CUSTOM_DICTIONARY",
} | {k: k for k in CLASS_ENTITIES}
#: Kinds that begin with what stands before the fields of every entity.
WITH_COMMON = (set(ENTITIES) | set(CLASS_ENTITIES)) - {"IMAGEDEF"}
#: Versions from which on a record exists.
SINCE = {"CAMERA": 2007, "SUN": 2007, "LIGHT": 2007, "GEODATA": 2010, "MULTILEADER": 2010, "MESH": 2010, "ACAD_MATERIAL": 2007, "ACAD_VISUALSTYLE": 2007}

LAYOUTS: dict[str, Layout] = {k: Layout(t) for k, (_, t) in (ENTITIES | TABLES).items()} | {k: Layout(t) for k, t in (CLASS_ENTITIES | OBJECTS | PARTS).items()}


def _finish_face(env: dict) -> dict:
    p = [env["_p"]]
    for k in ("_a", "_b", "_c"):
        d = env[k]
        p.append({c: p[-1][c] + d[c] for c in "xyz"} if d else p[-1])
    return {"corners": p, "invisible_edges": env["invisible_edges"], "is_triangle": p[2] == p[3]}


def _prepare_line(r: dict) -> dict:
    s, e = r["start"], r["end"]
    return r | {f"_{c}": s[c] for c in "xyz"} | {f"_d{c}": e[c] - s[c] for c in "xyz"}


def _prepare_text(r: dict) -> dict:
    usual = {"elevation": 0.0, "alignment_point": None, "oblique_angle": 0.0, "rotation_angle": 0.0, "width_factor": 1.0, "generation": 0, "h_align": 0, "v_align": 0}
    bits = dict(zip(usual, (1, 2, 4, 8, 16, 32, 64, 128)))
    return r | {"_flags": sum(b for k, b in bits.items() if r.get(k) not in (None, usual[k]))}


def _prepare_insert(r: dict) -> dict:
    s = r["scale"]
    same = s["x"] == s["y"] == s["z"]
    return r | {"_scale": 3 if same and s["x"] == 1.0 else 1 if same else 0, "_one": s["x"], "_three": s}


def _prepare_polyline(r: dict) -> dict:
    n = {k: len(r.get(f) or []) for k, f in (("_n", "vertices"), ("_b", "bulges"), ("_i", "vertex_ids"), ("_w", "widths"))}
    have = {1: r.get("elevation") is not None, 2: r.get("thickness") is not None, 4: r.get("extrusion") is not None, 0x20: r.get("constant_width") is not None, 0x400: n["_b"], 0x8000: n["_i"], 0x80: n["_w"], 8: r.get("closed")}
    return r | n | {"flag": sum(b for b, on in have.items() if on)}


def _prepare_face(r: dict) -> dict:
    c = r["corners"]
    step = lambda a, b: {k: b[k] - a[k] for k in "xyz"}
    flat = all(p["z"] == 0.0 for p in c)
    plain = c[2] == c[3] and not r.get("invisible_edges")
    return r | {"_plain": plain, "_flat": flat, "_p": c[0], "_a": step(c[0], c[1]), "_b": step(c[1], c[2]), "_c": step(c[2], c[3])}


PREPARE = {
    "LINE": _prepare_line, "TEXT": _prepare_text, "INSERT": _prepare_insert, "LWPOLYLINE": _prepare_polyline, "3DFACE": _prepare_face,
    "ATTRIB": lambda r: r | {"text": _prepare_text(r["text"])}, "ATTDEF": lambda r: r | {"text": _prepare_text(r["text"])},
    "MLINE": lambda r: r | {"_n": len(r["vertices"])}, "DICTIONARY": lambda r: r | {"_n": len(r["entries"]), "_hard": int(bool(r["hard_owner"]))}, "HATCH": lambda r: r | {"_g": int(bool(r.get("gradient")))},
    "IMAGE": lambda r: r | {"_n": len(r["clip_boundary"])},
}

COMMON_LAYOUT = Layout(COMMON)

_FACE_SCHEMA = f"struct<corners:array<{P3}>,invisible_edges:int,is_triangle:boolean>"


def schema(kind: str) -> str:
    """Spark type of the decoded record of a kind."""
    return _FACE_SCHEMA if kind == "3DFACE" else LAYOUTS[kind].schema()


def read(kind: str, r: BitReader, version: int) -> dict:
    if version < SINCE.get(kind, 0):
        raise ValueError(f"{kind} needs version {SINCE[kind]}")
    if kind == "SPLINE":
        at = r.at
        if r.BLu() not in (1, 2):
            raise ValueError("scenario of a spline")
        r.at = at
    if kind == "3DFACE":
        env: dict = {"v": version}
        out = _read(LAYOUTS[kind].fields, r, env)
        return _finish_face(env) | out
    out = LAYOUTS[kind].read(r, version)
    if kind == "CLASS_MAP_EXTENSION" and any(e["class_number"] < FIRST_CLASS for e in out["entries"]):
        raise ValueError(f"a class below {FIRST_CLASS}")
    return out


def encode(kind: str, record: dict, version: int) -> bytes:
    """A record's fields on the wire."""
    w = BitWriter(version >= 2007)
    LAYOUTS[kind].write(w, version, PREPARE.get(kind, lambda r: r)(record))
    return w.bytes()


#: Dimension table of the fixed type codes, with the kind's class.
TYPE_CODES = [(code, kind, "entity") for kind, (code, _) in ENTITIES.items()] + [(code, kind, "table") for kind, (code, _) in TABLES.items()]
# Further codes, without a decoder behind them.
TYPE_CODES += [
    (0x00, "UNUSED", "other"), (0x06, "SEQEND", "entity"), (0x08, "MINSERT", "entity"), (0x0B, "VERTEX_3D", "entity"), (0x0C, "VERTEX_MESH", "entity"), (0x0D, "VERTEX_PFACE", "entity"), (0x0E, "VERTEX_PFACE_FACE", "entity"),
    (0x10, "POLYLINE_3D", "entity"), (0x21, "SHAPE", "entity"), (0x2A, "DICTIONARY", "object"), (0x2B, "OLEFRAME", "entity"), (0x30, "BLOCK_CONTROL", "control"), (0x32, "LAYER_CONTROL", "control"), (0x34, "STYLE_CONTROL", "control"),
    (0x38, "LTYPE_CONTROL", "control"), (0x3C, "VIEW_CONTROL", "control"), (0x3E, "UCS_CONTROL", "control"), (0x40, "VPORT_CONTROL", "control"), (0x42, "APPID_CONTROL", "control"), (0x44, "DIMSTYLE_CONTROL", "control"),
    (0x46, "VP_ENT_HDR_CONTROL", "control"), (0x47, "VP_ENT_HDR", "object"), (0x48, "ACAD_GROUP", "object"), (0x49, "ACAD_MLINESTYLE", "object"), (0x4B, "DUMMY", "other"), (0x4C, "LONG_TRANSACTION", "other"),
    (0x4F, "XRECORD", "object"), (0x50, "PLACEHOLDER", "object"), (0x51, "VBA_PROJECT", "object"), (0x52, "ACAD_LAYOUT", "object"), (0x1F3, "PROXY_OBJECT", "object"),
]
CONTROL_KINDS = {k: "CONTROL" for _, k, c in TYPE_CODES if c == "control"}


def write_body(kind: str, record: dict, version: int, common: dict | None = None) -> BitWriter:
    """An entity's body on the wire, with what stands before the fields of every entity."""
    w = BitWriter(version >= 2007)
    if common is not None:
        COMMON_LAYOUT.write(w, version, common)
    LAYOUTS[kind].write(w, version, PREPARE.get(kind, lambda r: r)(record))
    return w


def decode_entity(kind: str, data: bytes | None, version: int, at: int = 0) -> tuple[dict | None, dict | None, str, str | None, int]:
    """(common, record, status, message, bits read) of an entity's body."""
    if data is None or kind not in LAYOUTS:
        return None, *decode(kind, data, version, at)
    r = BitReader(bytes(data), version >= 2007, at)
    try:
        common = COMMON_LAYOUT.read(r, version)
    except (ValueError, OverflowError) as e:
        return None, None, "error", str(e)[:200], r.at - at
    rec, status, message, used = decode(kind, data, version, r.at)
    return common, rec, status, message, r.at - at + used


def decode(kind: str, data: bytes | None, version: int, at: int = 0) -> tuple[dict | None, str, str | None, int]:
    """(record, status, message, bits read): 'ok', 'error' with what failed, or 'unhandled' for a kind without a layout."""
    layout = CONTROL_KINDS.get(kind, kind)
    if layout not in LAYOUTS:
        return None, "unhandled", None, 0
    if data is None:
        return None, "error", "no bytes", 0
    r = BitReader(bytes(data), version >= 2007, at)
    try:
        return read(layout, r, version), "ok", None, r.at - at
    except (ValueError, OverflowError, KeyError, TypeError) as e:
        return None, "error", str(e)[:200] or type(e).__name__, r.at - at


def _limited(kind: str, got: tuple, limits: Limits) -> tuple:
    rec, status, message, used = got[-4:]
    much = exceeded(kind, rec, limits) if status == "ok" else None
    return (*got[:-4], None, "error", much, used) if much else got


def decode_records(rows: DataFrame, kind: str, data: str = "raw", version: str = "version", at: str | None = None, common: bool = False, strict: bool = False, limits: Limits | None = None) -> DataFrame:
    """`rows` with the columns rec, status, message and consumed_bits for records of one kind.

    `at` names a column with the bit where the body begins, else it is the first.
    With `common` what stands before the fields of every entity is read too, into
    a column of that name. Failures stay as rows with a null rec; `strict` raises
    on the first one. Columns of `rows` with those names are replaced. Null bytes
    are an error row, and so is a record with more than `limits` allow.
    """
    own = ["common"] * common + ["rec", "status", "message", "consumed_bits"]
    keep = [c for c in rows.columns if c not in own]
    inner = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    out = inner + f", common {COMMON_LAYOUT.schema()}" * common + f", rec {schema(kind)}, status string, message string, consumed_bits int"
    arrow = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = decode_entity if common else decode
        for batch in batches:
            starts = batch.column(at).to_pylist() if at else [0] * batch.num_rows
            got = [one(kind, d, v or 2018, s or 0) for d, v, s in zip(batch.column(data).to_pylist(), batch.column(version).to_pylist(), starts)]
            if limits:
                got = [_limited(kind, g, limits) for g in got]
            if strict:
                bad = next((g for g in got if g[-3] != "ok"), None)
                if bad:
                    raise ValueError(f"{kind}: {bad[-2] or bad[-3]}")
            cols = [pa.array([g[i] for g in got], arrow.field(c).type) for i, c in enumerate(own)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *cols], [*keep, *own])

    return rows.mapInArrow(run, out)


def _plain(v):
    """A decoded value for JSON: bytes in base 64, nulls of records left out."""
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items() if x is not None}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return base64.b64encode(v).decode() if isinstance(v, bytes) else v


def decode_all(rows: DataFrame, kind: str = "type_name", data: str = "raw", version: str = "version", at: str = "body_bit") -> DataFrame:
    """`rows` with status, message, consumed_bits and record for records of all kinds, in one pass.

    `kind` names the column with each record's kind; record is JSON as `to_json`
    would write it (`from_json` with `schema(kind)` gives it back). Kinds without
    a layout are 'unhandled', failures and null bytes 'error' rows. Columns of
    `rows` with those names are replaced.
    """
    own = ["status", "message", "consumed_bits", "record"]
    keep = [c for c in rows.columns if c not in own]
    inner = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    out = inner + ", status string, message string, consumed_bits int, record string"
    types = (pa.string(), pa.string(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for k, d, v, s in zip(*(batch.column(c).to_pylist() for c in (kind, data, version, at))):
                rec, status, message, used = (decode_entity(k, d, v or 2018, s or 0)[1:] if k in WITH_COMMON else decode(k, d, v or 2018, s or 0)) if k else (None, "unhandled", None, 0)
                got.append((status, message, used, None if rec is None else json.dumps(_plain(rec), ensure_ascii=False, separators=(",", ":"))))
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *cols], [*keep, *own])

    return rows.mapInArrow(run, out)


def with_kinds(objects: DataFrame, classes: DataFrame) -> DataFrame:
    """`with_types`, where custom codes have the kind that the class map of their file (path, class_number, dxf_class_name) names; of two classes with one number the first by name counts."""
    named = classes.groupBy("path", F.col("class_number").alias("type_code")).agg(F.min("dxf_class_name").alias("_class"))
    table = objects.sparkSession.createDataFrame(list(CLASS_NAMES.items()), "_class string, _kind string")
    custom = named.join(F.broadcast(table), "_class", "left").withColumn("_kind", F.coalesce("_kind", "_class")).drop("_class")
    typed = with_types(objects).join(custom, ["path", "type_code"], "left")
    return typed.withColumn("type_name", F.coalesce("_kind", "type_name")).withColumn("has_decoder", F.col("has_decoder") | F.col("type_name").isin(*LAYOUTS)).drop("_kind")


def type_table(spark) -> DataFrame:
    """(type_code, type_name, type_class, has_decoder) of the fixed codes; a table of constant size."""
    rows = [(c, k, cls, CONTROL_KINDS.get(k, k) in LAYOUTS) for c, k, cls in TYPE_CODES]
    return spark.createDataFrame(rows, "type_code int, type_name string, type_class string, has_decoder boolean")


def with_types(objects: DataFrame) -> DataFrame:
    """Objects with type_name and type_class of their code: fixed codes by the table, 500 and above 'CUSTOM', others 'UNKNOWN'; null stays unknown."""
    named = objects.join(F.broadcast(type_table(objects.sparkSession)), "type_code", "left")
    other = F.when(F.col("type_code") >= 500, "CUSTOM").otherwise("UNKNOWN")
    return named.withColumn("type_name", F.coalesce("type_name", other)).withColumn("type_class", F.coalesce("type_class", F.lower(other))).withColumn("has_decoder", F.coalesce("has_decoder", F.lit(False)))


def layer_is_frozen(flags: Column) -> Column:
    return flags.bitwiseAND(1) != 0


def layer_is_locked(flags: Column) -> Column:
    return flags.bitwiseAND(4) != 0
