"""Binary scenes of drawings: meshes as rows, one binary document per drawing."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions import geometry as G
from draftlake.functions.text import palette

LINES, TRIANGLES = 1, 4


def _pad(data: bytes, fill: bytes) -> bytes:
    return data + fill * (-len(data) % 4)


def scene(meshes: list[tuple[str, int, np.ndarray, np.ndarray]], colors: dict[str, tuple[float, float, float]], instances: list[tuple[int, list[float] | None]] | None = None) -> bytes:
    """A GLB of (material, mode, positions as float32 rows, indices): two buffer views and accessors a mesh, behind each other.

    instances are (mesh, transform in rows or None), a node each; without any
    every mesh has one node. A mesh number that there isn't stands for the first.
    """
    materials = {m: i for i, m in enumerate(dict.fromkeys(m for m, *_ in meshes))}
    instances = [(k, None) for k in range(len(meshes))] if instances is None else [(k if 0 <= k < len(meshes) else 0, m) for k, m in instances]
    nodes = [{"mesh": k} | ({"matrix": transform_columns(m)} if m is not None else {}) for k, m in instances]
    doc: dict = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": list(range(len(nodes)))}], "nodes": nodes, "meshes": [], "accessors": [], "bufferViews": [], "materials": [{"name": m, "pbrMetallicRoughness": {"baseColorFactor": [*colors.get(m, (1.0, 1.0, 1.0)), 1.0]}} for m in materials]}
    binary = b""
    for k, (material, mode, positions, indices) in enumerate(meshes):
        p, i = np.ascontiguousarray(positions, "<f4"), np.ascontiguousarray(indices, "<u4")
        doc["bufferViews"] += [{"buffer": 0, "byteOffset": len(binary), "byteLength": p.nbytes, "target": 34962}, {"buffer": 0, "byteOffset": len(binary) + p.nbytes, "byteLength": i.nbytes, "target": 34963}]
        doc["accessors"] += [
            {"bufferView": 2 * k, "componentType": 5126, "count": len(p), "type": "VEC3", "min": p.min(0).tolist(), "max": p.max(0).tolist()},
            {"bufferView": 2 * k + 1, "componentType": 5125, "count": i.size, "type": "SCALAR"},
        ]
        doc["meshes"].append({"primitives": [{"attributes": {"POSITION": 2 * k}, "indices": 2 * k + 1, "material": materials[material], "mode": mode}]})
        binary += p.tobytes() + i.tobytes()
    doc["buffers"] = [{"byteLength": len(binary)}]
    head = _pad(json.dumps(doc, separators=(",", ":")).encode(), b" ")
    body = _pad(binary, b"\0")
    return struct.pack("<4sII", b"glTF", 2, 12 + 8 + len(head) + 8 + len(body)) + struct.pack("<I4s", len(head), b"JSON") + head + struct.pack("<I4s", len(body), b"BIN\0") + body


def layer_material(index: int) -> tuple[str, tuple[float, float, float]]:
    """(name, red, green, blue within 0 and 1) of a layer's colour index."""
    _, r, g, b = palette()[index]
    return f"layer-{index}", (r / 255.0, g / 255.0, b / 255.0)


def transform_columns(m: list[float]) -> list[float]:
    """A row-wise transform as single-precision columns."""
    return np.array(m, np.float32).reshape(4, 4).T.ravel().tolist()


def line_meshes(curves: DataFrame) -> DataFrame:
    """(path, seq, material, mode, positions, indices) from (path, seq, material, points): a strip of segments per curve."""
    n = F.size("points")
    steps = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.array(i, i + 1)))).otherwise(F.array().cast("array<int>"))
    flat = F.flatten(F.transform("points", lambda p: F.array(p["x"].cast("float"), p["y"].cast("float"), p["z"].cast("float"))))
    return curves.filter(n > 1).select("path", "seq", "material", F.lit(LINES).alias("mode"), flat.alias("positions"), steps.alias("indices"))


def triangle_meshes(faces: DataFrame) -> DataFrame:
    """(path, seq, material, mode, positions, indices) from (path, seq, material, points, triangles); meshes without a triangle are left out."""
    flat = F.flatten(F.transform("points", lambda p: F.array(p["x"].cast("float"), p["y"].cast("float"), p["z"].cast("float"))))
    return faces.filter(F.size("triangles") > 0).select("path", "seq", "material", F.lit(TRIANGLES).alias("mode"), flat.alias("positions"), F.flatten("triangles").alias("indices"))


#: Kinds that a cube stands for, as their shape isn't computed.
CUBES = ("EXTRUDEDSURFACE", "REVOLVEDSURFACE", "SWEPTSURFACE", "LOFTEDSURFACE")


def entity_meshes(entities: DataFrame, rec: dict[str, Column], material: str = "layer-7") -> DataFrame:
    """Meshes of (path, seq, kind) with a struct column per kind: lines of curves, triangles of faces, cubes of surfaces; other kinds have none."""
    kind = F.col("kind")
    lines = entities.withColumn("points", G.entity_points(kind, rec)).filter("points is not null").withColumn("material", F.lit(material))
    corners = rec["3DFACE"]["corners"]
    half = G.box(G.point(-0.5, -0.5, -0.5), G.point(0.5, 0.5, 0.5))
    cube = G.box_mesh(half)
    faces = entities.filter(kind.isin("3DFACE", *CUBES)).select(
        "path", "seq", F.lit(material).alias("material"), F.when(kind == "3DFACE", corners).otherwise(cube["points"]).alias("points"), F.when(kind == "3DFACE", G.face_triangles(corners)).otherwise(cube["triangles"]).alias("triangles")
    )
    return line_meshes(lines).unionByName(triangle_meshes(faces))


def contents(documents_: DataFrame) -> DataFrame:
    """What binary documents hold: (path, node, mesh, mode, material, n_positions, n_indices, low, high, matrix) a node, read from their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, glb in zip(batch.column("path").to_pylist(), batch.column("glb").to_pylist()):
                magic, version, size, n, tag = struct.unpack_from("<4sIII4s", glb)
                if (magic, version, tag) != (b"glTF", 2, b"JSON") or size != len(glb):
                    raise ValueError(f"no scene in {path}")
                doc = json.loads(glb[20 : 20 + n])
                data = glb[28 + n :]
                for k, node in enumerate(doc["nodes"]):
                    own = doc["meshes"][node["mesh"]]["primitives"][0]
                    places, order = doc["accessors"][own["attributes"]["POSITION"]], doc["accessors"][own["indices"]]
                    at, to = doc["bufferViews"][places["bufferView"]], doc["bufferViews"][order["bufferView"]]
                    points = np.frombuffer(data, "<f4", 3 * places["count"], at["byteOffset"]).reshape(-1, 3)
                    used = points[np.frombuffer(data, "<u4", order["count"], to["byteOffset"])]
                    rows.append((path, k, node["mesh"], own["mode"], doc["materials"][own["material"]]["name"], places["count"], order["count"], used.min(0).tolist(), used.max(0).tolist(), node.get("matrix")))
            cols = list(zip(*rows)) or [[]] * 10
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["path", "node", "mesh", "mode", "material", "n_positions", "n_indices", "low", "high", "matrix"])

    return documents_.select("path", "glb").mapInArrow(run, "path string, node int, mesh int, mode int, material string, n_positions int, n_indices int, low array<double>, high array<double>, matrix array<double>")


def documents(meshes: DataFrame, colors: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """(path, glb): one binary document per drawing, which is the unit of the format."""
    rgb = colors or {}

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        made = [(m, int(k), np.asarray(p, np.float32).reshape(-1, 3), np.asarray(i, np.uint32)) for m, k, p, i in zip(rows["material"], rows["mode"], rows["positions"], rows["indices"])]
        return pd.DataFrame({"path": [key[0]], "glb": [scene(made, rgb)]})

    return meshes.groupBy("path").applyInPandas(one, "path string, glb binary")
