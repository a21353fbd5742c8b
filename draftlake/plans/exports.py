"""Queries from drawing files to what is made of them: text, scenes, pages, reports, lookups; with SQL from the samples' known contents."""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.functions import geometry as G
from draftlake.functions import records
from draftlake.functions import text as T
from draftlake.plans import samples as S
from draftlake.plans.drawings import _values, _versions, contents, objects_with_version
from draftlake.runtime import checkpoint, load
from draftlake.sinks import dxf, gltf, svg
from draftlake.sources import drawing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_DRAWN = ("LINE", "CIRCLE", "ARC", "POINT", "LWPOLYLINE", "ELLIPSE", "3DFACE")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _sql(columns: str, rows_of: Callable[[int, int], list[tuple]], shown: str | None = None) -> str:
    """SQL of rows that a sound file of each version and content has."""
    rows = [(m, k, *row) for m, v in S.VERSIONS.items() for k in range(S.CONTENTS) for row in rows_of(v, k)]
    return f"select path, {shown or columns} from {S.FILES} f join (values {_values(rows)}) t(version_, k_, {columns}) on version = version_ and k = k_ where not broken"


def _records(v: int, k: int) -> list[tuple[int, str, dict]]:
    return S.drawing(v, k)[1]["records"]


def typed(spark: SparkSession, d: str) -> DataFrame:
    """Every object once decoded: path, seq (its handle), kind, status, record (JSON)."""
    rows = objects_with_version(spark, d).filter("raw is not null").select("path", F.col("handle.value").alias("seq"), "type_name", "version", "raw", "body_bit")
    return records.decode_all(rows).select("path", "seq", F.col("type_name").alias("kind"), "status", "record")


def with_records(rows: DataFrame, kinds: tuple[str, ...] = _DRAWN) -> tuple[DataFrame, dict[str, Column]]:
    """`rows` with a struct column per kind, and these columns: a record is parsed once, however many of its fields are read."""
    out = rows.select("path", "seq", "kind", *[F.when(F.col("kind") == k, F.from_json("record", records.schema(k))).alias(k) for k in kinds])
    return out, {k: F.col(k) for k in kinds}


# Text: file to pairs


def _expected_pairs(v: int, k: int) -> list[tuple]:
    f = lambda x: f"{x + 0.0:.16f}"
    turn = 180.0 / math.pi
    rows, other = [], Counter()
    for handle, kind, r in _records(v, k):
        head = [(5, f"{handle:X}"), (100, "AcDbEntity"), (8, "0")]
        xyz = lambda code, p: [(code, f(p["x"])), (code + 10, f(p["y"])), (code + 20, f(p["z"]))]
        if kind == "LINE":
            own = [(0, "LINE"), *head, (100, "AcDbLine"), *xyz(10, r["start"]), *xyz(11, r["end"])]
        elif kind == "CIRCLE":
            own = [(0, "CIRCLE"), *head, (100, "AcDbCircle"), *xyz(10, r["center"]), (40, f(r["radius"]))]
        elif kind == "ARC":
            own = [(0, "ARC"), *head, (100, "AcDbCircle"), *xyz(10, r["center"]), (40, f(r["radius"])), (100, "AcDbArc"), (50, f(r["start_angle"] * turn)), (51, f(r["end_angle"] * turn))]
        elif kind == "POINT":
            own = [(0, "POINT"), *head, (100, "AcDbPoint"), *xyz(10, r["position"])]
        elif kind == "LWPOLYLINE":
            own = [(0, "LWPOLYLINE"), *head, (100, "AcDbPolyline"), (90, str(len(r["vertices"]))), (70, "1" if r["closed"] else "0")]
            own += [p for q in r["vertices"] for p in ((10, f(q["x"])), (20, f(q["y"])))]
        else:
            other["LAYER_CONTROL" if kind == "CONTROL" else kind] += 1
            continue
        rows += [(3, handle, i, c, t) for i, (c, t) in enumerate(own)]
    rows += [(3, dxf.FIRST + 1, i, 999, f"skipped: {kind} x{n}") for i, (kind, n) in enumerate(sorted(other.items()))]
    layer = [(0, "LAYER"), (2, "0"), (70, "0"), (62, "7"), (6, "CONTINUOUS")]
    frame = [
        (0, 0, [(0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, "AC1032"), (0, "ENDSEC")]), (1, 0, [(0, "SECTION"), (2, "TABLES"), (0, "TABLE"), (2, "LAYER")]), (1, 1, layer), (1, dxf.LAST, [(0, "ENDTAB"), (0, "ENDSEC")]),
        (2, 0, [(0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "*Model_Space"), (0, "ENDBLK"), (0, "ENDSEC")]), (3, dxf.FIRST, [(0, "SECTION"), (2, "ENTITIES")]), (3, dxf.LAST, [(0, "ENDSEC")]), (4, 0, [(0, "SECTION"), (2, "OBJECTS"), (0, "ENDSEC")]), (5, 0, [(0, "EOF")]),
    ]
    return rows + [(s, q, i, c, t) for s, q, ps in frame for i, (c, t) in enumerate(ps)]


def document_rows(rows: DataFrame, rec: dict[str, Column]) -> DataFrame:
    """Whole documents of (path, seq, kind) with a struct column per kind: the default layer, the entities with a text form, comments on the kinds without one."""
    pairs = dxf.entity_pairs(F.col("kind"), rec, F.lit("0"), F.col("seq"))
    layer = rows.select("path").distinct().select("path", F.lit(dxf.TABLES).alias("section"), F.lit(1).cast("bigint").alias("seq"), F.posexplode(dxf.layer_pairs(F.lit("0"), F.lit(7), F.lit(False), F.lit(""))).alias("pair", "p")).select("path", "section", "seq", "pair", "p.code", "p.value")
    return dxf.entity_rows(rows, pairs).unionByName(dxf.comment_rows(dxf.skipped(rows, pairs))).unionByName(layer).unionByName(dxf.frame_rows(rows))


@query(_sql("section, seq, pair, code, value", _expected_pairs))
def x_dxf(spark, d):
    """Files as tagged text."""
    rows, rec = with_records(typed(spark, d))
    return document_rows(checkpoint(rows), rec)


# Scenes


def _expected_meshes(v: int, k: int) -> list[tuple]:
    out = []
    for _, kind, r in _records(v, k):
        pts, indices, mode = None, None, 1
        if kind == "LINE":
            pts = [r["start"], r["end"]]
        elif kind == "POINT":
            pts = [r["position"]] * 2
        elif kind in ("CIRCLE", "ARC", "ELLIPSE"):
            start, end = {"CIRCLE": (0.0, 2 * math.pi), "ARC": (r.get("start_angle"), r.get("end_angle")), "ELLIPSE": (r.get("start_param"), r.get("end_param"))}[kind]
            sweep = end - start if end > start else end - start + 2 * math.pi
            n = math.ceil(sweep * 64 / (2 * math.pi))
            c = r["center"]
            if kind == "ELLIPSE":
                a, e = r["major_axis"], r["extrusion"]
                size = math.sqrt(sum(x * x for x in e.values()))
                e = {q: x / size for q, x in e.items()}
                b = {"x": e["y"] * a["z"] - e["z"] * a["y"], "y": e["z"] * a["x"] - e["x"] * a["z"], "z": e["x"] * a["y"] - e["y"] * a["x"]}
                b = {q: x * r["axis_ratio"] for q, x in b.items()}
            else:
                a, b = {"x": r["radius"], "y": 0.0, "z": 0.0}, {"x": 0.0, "y": r["radius"], "z": 0.0}
            pts = [{q: c[q] + a[q] * math.cos(start + sweep * i / n) + b[q] * math.sin(start + sweep * i / n) for q in "xyz"} for i in range(n + 1)]
        elif kind == "LWPOLYLINE":
            pts = [{**p, "z": r.get("elevation", 0.0)} for p in r["vertices"]]
            pts += pts[:1] if r["closed"] else []
        elif kind == "3DFACE":
            pts, mode = r["corners"], 4
            indices = 3 if pts[2] == pts[3] else 6
        elif kind in ("EXTRUDEDSURFACE", "REVOLVEDSURFACE", "SWEPTSURFACE", "LOFTEDSURFACE"):
            pts, indices, mode = [{"x": a, "y": b, "z": c} for a in (-0.5, 0.5) for b in (-0.5, 0.5) for c in (-0.5, 0.5)], 36, 4
        if pts:
            box = [round(f(p[q] for p in pts), 3) + 0.0 for f in (min, max) for q in "xyz"]
            out.append((len(out), mode, "layer-7", len(pts), 2 * (len(pts) - 1) if indices is None else indices, *box))
    return out


_BOX = "min_x, min_y, min_z, max_x, max_y, max_z"


@query(_sql(f"node, mode, material, n_positions, n_indices, {_BOX}", _expected_meshes, "node, mode, material, n_positions, n_indices, " + ", ".join(f"cast({b} as double) as {b}" for b in _BOX.split(", "))))
def x_gltf(spark, d):
    """Files as scenes, read back from their bytes."""
    rows, rec = with_records(typed(spark, d))
    glb = gltf.documents(gltf.entity_meshes(checkpoint(rows), rec), dict([gltf.layer_material(7)]))
    box = [(F.round(F.col(c)[i], 3) + F.lit(0.0)).alias(f"{m}_{q}") for m, c in (("min", "low"), ("max", "high")) for i, q in enumerate("xyz")]
    return gltf.contents(glb).select("path", "node", "mode", "material", "n_positions", "n_indices", *box)


@query("select path, node, cast(mesh as integer) as mesh, x from (select distinct path from expanded_entities where path is not null) p, (values (0, 0, 0.0::double), (1, 1, 5.0), (2, 1, 7.5), (3, 0, 9.0)) t(node, mesh, x)")
def x_instances(spark, d):
    """Scenes whose nodes use meshes again under transforms; a mesh that there isn't stands for the first."""
    import numpy as np

    move = lambda x: [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    line, face = np.array([[0, 0, 0], [1, 0, 0]], np.float32), np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], np.float32)
    meshes = [("layer-1", gltf.LINES, line, np.array([0, 1])), ("layer-2", gltf.TRIANGLES, face, np.array([0, 1, 2]))]
    glb = gltf.scene(meshes, {}, [(0, None), (1, move(5.0)), (1, move(7.5)), (9, move(9.0))])
    paths = load(spark, d, "expanded_entities").select("path").filter("path is not null").distinct().withColumn("glb", F.lit(glb))
    return gltf.contents(paths).select("path", "node", "mesh", F.coalesce(F.col("matrix")[12], F.lit(0.0)).alias("x"))


# Pages


def _expected_dots(v: int, k: int) -> list[tuple]:
    return [(i, h, 50.0 + i * 17 % 700, 50.0 + h % 500, f'<circle cx="{50 + i * 17 % 700}" cy="{50 + h % 500}" r="3" fill="none" stroke="#1A65BF" stroke-width="1.5" data-handle="0x{h:X}"/>') for i, (h, _, _) in enumerate(_records(v, k))]


@query(_sql("n, handle, x, y, fragment", _expected_dots, "n, cast(handle as bigint) as handle, cast(x as double) as x, cast(y as double) as y, fragment"))
def x_dots(spark, d):
    """A dot for each object in the order of the file."""
    from pyspark.sql import Window

    rows = drawing.tables_of(contents(spark, d), "raw_objects").filter("status = 'ok'")
    # a file is read by one task anyway, so its objects fit a window
    numbered = rows.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("stream_offset")) - 1).alias("n"), F.col("handle.value").alias("handle"))
    return svg.dots(numbered)


def _expected_bases(v: int, k: int) -> list[tuple]:
    return [(h, r["insertion_point"]["x"], r["insertion_point"]["y"], r["elevation"], math.cos(r["rotation_angle"]), math.sin(r["rotation_angle"]), r["height"]) for h, kind, r in _records(v, k) if kind == "TEXT"]


@query(_sql("handle, x, y, z, dx, dy, height", _expected_bases, "cast(handle as bigint) as handle, " + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in ("x", "y", "z", "dx", "dy", "height"))))
def x_text_baselines(spark, d):
    b = typed(spark, d).filter("kind = 'TEXT'").select("path", F.col("seq").alias("handle"), G.text_baseline(F.from_json("record", records.schema("TEXT"))).alias("b"))
    return b.select("path", "handle", "b.origin.x", "b.origin.y", "b.origin.z", F.round("b.direction.x", 6).alias("dx"), F.round("b.direction.y", 6).alias("dy"), "b.height")


@query("select object_id, count(*) as spans from (select object_id, unnest(regexp_extract_all(rec.text, '[^\\\\{}]+')) from decoded_mtext where rec.text is not null and not contains(rec.text, '\\') and not contains(rec.text, '{') and not contains(rec.text, '}') and rec.text <> '') group by object_id")
def x_plain_notes(spark, d):
    """Notes without codes are one span each on the page."""
    rows = load(spark, d, "decoded_mtext").filter("rec.text is not null and not contains(rec.text, '\\\\') and not contains(rec.text, '{') and not contains(rec.text, '}') and rec.text <> ''")
    note = svg.note_fragment(F.lit(0.0), F.lit(0.0), F.lit(2.5), F.col("runs"))
    return rows.select("object_id", T.note_runs("rec.text").alias("runs")).select("object_id", note.alias("svg")).groupBy("object_id").agg(F.sum(F.size(F.split("svg", "<tspan")) - 1).alias("spans"))


# Reports


def _expected_info(v: int, k: int) -> list[tuple]:
    t = S.drawing(v, k)[1]
    m, maint, page, status, _ = t["files"][0]
    names = sorted(((s[0], s[3]) for s in t["sections"]))
    return [(json.dumps({"version": m, "maint_version": maint, "codepage": page, "status": status, "sections": [{"name": n, "size": size} for n, size in names]}, separators=(",", ":")),)]


@query(_sql("info", _expected_info))
def x_info(spark, d):
    """What a file is, as one JSON text."""
    made = checkpoint(contents(spark, d))
    sections = drawing.tables_of(made, "sections").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "size"))).alias("sections"))
    files = drawing.tables_of(made, "files").filter("section_map_status = 'Full' and version not in ('AC1014', 'AC1015')")
    return files.join(sections, "path").select("path", F.to_json(F.struct("version", "maint_version", "codepage", F.col("section_map_status").alias("status"), "sections")).alias("info"))


@query(_sql("name, payload_md5, status", lambda v, k: [(n, hashlib.md5(c).hexdigest(), "ok") for n, c in S.drawing(v, k)[1]["payloads"]]))
def x_sections(spark, d):
    """Every section unpacked: what an extraction writes, and whether it can."""
    made = drawing.tables_of(contents(spark, d), "payloads")
    files = _versions(load(spark, d, "files").groupBy("path").agg(F.max("version").alias("version"))).filter("version in (2004, 2010, 2013, 2018)")
    return made.join(files, "path", "left_semi").filter(F.length("path") % 17 != S.BROKEN).select("path", "name", F.md5("payload").alias("payload_md5"), "status")


def _expected_pages(v: int, k: int) -> list[tuple]:
    out: dict[str, list[int]] = {}
    for name, _, size, _ in S.drawing(v, k)[1]["section_pages"]:
        out.setdefault(name, []).append(size)
    return [(name, len(sizes), sum(sizes)) for name, sizes in out.items()]


@query(_sql("section_name, n_pages, packed", _expected_pages))
def x_write_report(spark, d):
    """Pages and packed bytes of each section, as its writer reports them."""
    return drawing.tables_of(contents(spark, d), "section_pages").groupBy("path", "section_name").agg(F.count("*").alias("n_pages"), F.sum("data_size").alias("packed"))


# Lookups


def resolved(handles: DataFrame, objects: DataFrame, kind: str) -> DataFrame:
    """Handles (path, handle) with the record of their object if it is of a kind, else null."""
    one = objects.filter((F.col("kind") == kind) & (F.col("status") == "ok")).select("path", F.col("seq").alias("handle"), F.from_json("record", records.schema(kind)).alias(kind.lower()))
    return handles.join(one, ["path", "handle"], "left")


def _expected_lookups(v: int, k: int) -> list[tuple]:
    out = []
    for h, kind, r in _records(v, k):
        out.append((h, r["font_filename"] if kind == "STYLE" else None, r["width_factor"] if kind == "STYLE" else None, ",".join(f"{x['length']:g}" for x in r["dashes"]) if kind == "LTYPE" else None, r["header"]["name"] if kind == "DIMSTYLE" else None, r["dimtxt"] if kind == "DIMSTYLE" else None, r["dimupt"] if kind == "DIMSTYLE" else None))
    return out


@query(_sql("handle, font, width_factor, pattern, dimstyle, dimtxt, dimupt", _expected_lookups, "cast(handle as bigint) as handle, font, cast(width_factor as double) as width_factor, pattern, dimstyle, cast(dimtxt as double) as dimtxt, dimupt"))
def x_styles(spark, d):
    """Every handle of a file as a text style, a linetype and a dimension style: null where it is of another kind."""
    objects = checkpoint(typed(spark, d))
    out = objects.select("path", F.col("seq").alias("handle"))
    for kind in ("STYLE", "LTYPE", "DIMSTYLE"):
        out = resolved(out, objects, kind)
    pattern = F.array_join(F.transform("ltype.dashes", lambda x: F.regexp_replace(x["length"].cast("string"), r"\.0$", "")), ",")
    return out.select("path", "handle", F.col("style.font_filename").alias("font"), "style.width_factor", pattern.alias("pattern"), F.col("dimstyle.header.name").alias("dimstyle"), "dimstyle.dimtxt", "dimstyle.dimupt")


def layer_info(layer: Column) -> Column:
    """struct(name, color, frozen, locked, plottable, linetype) of a layer's record; the colour lies within 0 and 255."""
    return F.struct(
        layer["header"]["name"].alias("name"), F.greatest(F.lit(0), F.least(F.lit(255), layer["color_index"].cast("int"))).alias("color"), records.layer_is_frozen(layer["flags"]).alias("frozen"), records.layer_is_locked(layer["flags"]).alias("locked"),
        layer["plot_flag"].alias("plottable"), F.lit("").alias("linetype"),
    )


@query(_sql("name, color, frozen, locked, plottable, linetype", lambda v, k: [(r["header"]["name"], min(255, max(0, r["color_index"])), bool(r["flags"] & 1), bool(r["flags"] & 4), r["plot_flag"], "") for _, kind, r in _records(v, k) if kind == "LAYER"]))
def x_layers(spark, d):
    layers = typed(spark, d).filter("kind = 'LAYER'").select("path", layer_info(F.from_json("record", records.schema("LAYER"))).alias("l"))
    return layers.select("path", "l.*")


def _custom(v: int, k: int) -> list[tuple]:
    names = Counter(kind for _, kind, _ in _records(v, k) if any(s.kind == kind and s.code in S.CLASSES for s in S.IN_FILES))
    return [(kind, n) for kind, n in names.items()]


@query(_sql("kind, n", _custom))
def x_classes(spark, d):
    """Objects of custom codes by the kind that the class map of their file gives."""
    return objects_with_version(spark, d).filter("type_code >= 500 and raw is not null").filter(~F.col("type_name").isin(*[k for _, k, _ in records.TYPE_CODES])).groupBy("path", F.col("type_name").alias("kind")).agg(F.count("*").alias("n"))


@query("select object_id, entry['name'] as name, entry['value'] as value_list from (select object_id, unnest([{'name': 'kind', 'value': kind}, {'name': 'status', 'value': status}]) as entry from decoded_objects)")
def x_name_values(spark, d):
    """Names with their values as a map of lists, and one looked up by name."""
    rows = load(spark, d, "decoded_objects")
    named = rows.select("object_id", F.map_from_entries(F.array(F.struct(F.lit("kind"), F.array("kind")), F.struct(F.lit("status"), F.array("status")))).alias("m"))
    return named.select("object_id", F.explode("m").alias("name", "values")).select("object_id", "name", F.element_at("values", 1).alias("value_list"))


@query(f"select case when version = 'AC1021' then 'DEFERRED' when broken and version in {tuple(S.VERSIONS)} then 'TRUNCATED' end as error_class, count(*) as n from {S.FILES} f group by 1")
def x_error_classes(spark, d):
    """Files by the class of what is wrong with them."""
    return drawing.tables_of(contents(spark, d), "files").groupBy(drawing.error_class(F.col("reason")).alias("error_class")).agg(F.count("*").alias("n"))


@query(_sql("handle, status, size_bytes", lambda v, k: [(o[3], "ok", o[1]) for o in S.drawing(v, k)[1]["raw_objects"]] + [(1_000_000, "missing", None)], "cast(handle as bigint) as handle, status, cast(size_bytes as bigint) as size_bytes"))
def x_objects_by_handle(spark, d):
    """Every handle of the index and one that no file has, looked up among the objects."""
    made = checkpoint(contents(spark, d))
    # the index is read once: its first entry brings the handle that no file has
    none = F.when(F.col("seq") == 0, F.lit(1_000_000).cast("bigint"))
    handles = drawing.tables_of(made, "handle_map").select("path", F.explode(F.array_compact(F.array("handle", none))).alias("handle"))
    return drawing.objects_at(made, handles).select("path", "handle", "status", "size_bytes")


# Outlines of records


def _expected_hatches(v: int, k: int) -> list[tuple]:
    out = []
    for h, kind, r in _records(v, k):
        for i, path in enumerate(r["paths"] if kind == "HATCH" else []):
            if "vertices" in path:
                pts = [q["point"] for q in path["vertices"]]
                steps = zip(pts, pts[1:] + pts[:1]) if path["closed"] else zip(pts, pts[1:])
                curves = [("line", a["x"], b["x"]) for a, b in steps]
            else:
                name = {1: "line", 2: "arc", 3: "ellipse", 4: "spline"}
                curves = [(name[e["kind"]], e["line_start"]["x"] if e["kind"] == 1 else e["center"]["x"] if e["kind"] in (2, 3) else None, e["line_end"]["x"] if e["kind"] == 1 else e["end_angle"] if e["kind"] in (2, 3) else None) for e in path["edges"]]
            out += [(h, i, n, r["elevation"], *c) for n, c in enumerate(curves)]
    return out


@query(_sql("handle, hatch_path, n, z, kind, x, until", _expected_hatches, "cast(handle as bigint) as handle, hatch_path, n, cast(z as double) as z, kind, cast(x as double) as x, cast(until as double) as until"))
def x_hatch_curves(spark, d):
    """Curves of every hatch's paths, at its elevation."""
    rows = typed(spark, d).filter("kind = 'HATCH'").select("path", F.col("seq").alias("handle"), F.from_json("record", records.schema("HATCH")).alias("r"))
    each = rows.select("path", "handle", "r.elevation", F.posexplode("r.paths").alias("hatch_path", "p"))
    c = each.select("path", "handle", "hatch_path", F.col("elevation").alias("z"), F.posexplode(G.hatch_curves(F.col("p"), F.col("elevation"))).alias("n", "c"))
    return c.select("path", "handle", "hatch_path", "n", "z", "c.kind", F.coalesce("c.a.x", "c.center.x").alias("x"), F.coalesce("c.b.x", "c.end_angle").alias("until"))


_DIMENSIONS = tuple(s.kind for s in S.SAMPLES if s.kind.startswith("DIMENSION") and s.family == "entity")


def _expected_segments(v: int, k: int) -> list[tuple]:
    out = []
    for h, kind, r in _records(v, k):
        if kind not in _DIMENSIONS:
            continue
        p = {n: r.get(f"def_point_{n}") for n in (10, 13, 14, 15)}
        if kind in ("DIMENSION_LINEAR", "DIMENSION_ALIGNED"):
            # the line through point 10, parallel to the measured one
            dx, dy = p[14]["x"] - p[13]["x"], p[14]["y"] - p[13]["y"]
            off = ((p[10]["x"] - p[13]["x"]) * -dy + (p[10]["y"] - p[13]["y"]) * dx) / (dx * dx + dy * dy)
            a, b = ({"x": q["x"] - dy * off, "y": q["y"] + dx * off} for q in (p[13], p[14]))
            segments = [(p[13], a), (p[14], b), (a, b)]
        else:
            segments = {
                "DIMENSION_ORDINATE": lambda: [(r["feature_location_13"], r["leader_endpoint_14"])], "DIMENSION_ANG3PT": lambda: [(p[15], p[13]), (p[15], p[14]), (p[10], p[15])],
                "DIMENSION_ANG2LN": lambda: [(p[13], p[14]), (p[15], p[10])], "DIMENSION_RADIUS": lambda: [(p[10], p[15])], "DIMENSION_DIAMETER": lambda: [(p[15], p[10])],
            }[kind]()
        out += [(h, i, kind, *(round(q[c], 6) + 0.0 for q in s for c in "xy")) for i, s in enumerate(segments)]
    return out


_ENDS = ("ax", "ay", "bx", "by_")


@query(_sql("handle, n, kind, " + ", ".join(_ENDS), _expected_segments, "cast(handle as bigint) as handle, n, kind, " + ", ".join(f"cast({c} as double) as {c}" for c in _ENDS)))
def x_dimension_segments(spark, d):
    """Line segments of the dimensions of all seven kinds."""
    rows, rec = with_records(typed(spark, d).filter(F.col("kind").isin(*_DIMENSIONS)), _DIMENSIONS)
    names = [f"def_point_{n}" for n in (10, 13, 14, 15)] + ["feature_location_13", "leader_endpoint_14"]
    have = {k: set(records.LAYOUTS[k].schema().replace("struct<", ",").replace(":", ",").split(",")) for k in _DIMENSIONS}
    points = F.struct(*[F.coalesce(*[rec[k][n] for k in _DIMENSIONS if n in have[k]]).alias(n) for n in names])
    each = rows.select("path", F.col("seq").alias("handle"), "kind", points.alias("r")).select("path", "handle", "kind", F.posexplode(G.dimension_segments(F.col("kind"), F.col("r"))).alias("n", "s"))
    r6 = lambda c: F.round(c, 6) + F.lit(0.0)
    return each.select("path", "handle", "n", "kind", *[r6(F.col(f"s.{c[0]}.{c[1]}")).alias(c) for c in _ENDS])


@query(_sql("handle, degree, n_weights, font", lambda v, k: [(h, int(r["degree"]), len(r["control"]["weights"]) if "control" in r and len(set(r["control"]["weights"])) > 1 else None, None) for h, kind, r in _records(v, k) if kind == "SPLINE"], "cast(handle as bigint) as handle, cast(degree as integer) as degree, cast(n_weights as integer) as n_weights"))
def x_spline_forms(spark, d):
    """Degree to draw a spline with, and its weights where they differ."""
    rows = typed(spark, d).filter("kind = 'SPLINE'").select("path", F.col("seq").alias("handle"), F.from_json("record", records.schema("SPLINE")).alias("r"))
    form = rows.select("path", "handle", G.spline_form(F.col("r.degree"), F.col("r.control.weights")).alias("f"))
    return form.select("path", "handle", "f.degree", F.when(F.col("f.weights").isNotNull(), F.size("f.weights")).alias("n_weights"))
