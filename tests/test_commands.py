import struct

import pytest
from pyspark.sql import functions as F

from draftlake import __main__ as command
from draftlake.plans import samples
from draftlake.sources import container, drawing


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("drawings")
    (root / "a.dwg").write_bytes(samples.drawing(2018, 1)[0])
    (root / "b.dwg").write_bytes(samples.drawing(2004, 2)[0])
    (root / "c.dwg").write_bytes(samples.drawing(2018, 0)[0][:9000])
    (root / "d.dwg").write_bytes(b"AC1021" + bytes(300))
    return root


def rows(spark, folder, name, *rest):
    return [tuple(r) for r in command.run(spark, name, str(folder), list(rest)).collect()]


def test_reports(spark, folder):
    info = [r[0] for r in rows(spark, folder, "info")]
    assert len(info) == 4 and sum('"section_map_status":"Full"' in i for i in info) == 2 and sum("AcDb:AcDbObjects" in i for i in info) == 2
    assert dict(rows(spark, folder, "dump"))["CIRCLE"] == "2" and any(k.startswith("handle ") for k, _ in rows(spark, folder, "dump"))
    assert {r[0]: r[2] for r in rows(spark, folder, "corpus")} == {None: 4, "AC1018": 1, "AC1021": 1, "AC1032": 2}
    assert all(r[2] and not r[3] and not r[4] for r in rows(spark, folder, "coverage"))
    assert {(r[0], r[1]) for r in rows(spark, folder, "verify")} >= {("AcDb:Header", 2), ("AcDb:Handles", 2)}


def test_written_files(spark, folder, tmp_path):
    assert len(rows(spark, folder, "extract", "AcDb:Header", str(tmp_path / "h"))) == 2
    written = sorted((tmp_path / "h").iterdir())
    assert len(written) == 2 and written[0].read_bytes() == dict(samples.drawing(2018, 1)[1]["payloads"])["AcDb:Header"]
    rows(spark, folder, "to-gltf", str(tmp_path / "g"))
    scenes = sorted((tmp_path / "g").iterdir())
    assert len(scenes) == 2 and all(struct.unpack("<4sI", f.read_bytes()[:8]) == (b"glTF", 2) for f in scenes)
    rows(spark, folder, "to-dxf", str(tmp_path / "t"))
    texts = [p.read_text() for p in (tmp_path / "t").rglob("part-*.txt")]
    assert len(texts) == 2 and all(t.startswith("  0\nSECTION\n  2\nHEADER") and t.rstrip().endswith("  0\nEOF") for t in texts)
    rows(spark, folder, "dots", str(tmp_path / "s"))
    pages = [p.read_text() for p in (tmp_path / "s").rglob("part-*.txt")]
    assert len(pages) == 2 and all(p.startswith("<svg") and p.count("<circle") > 70 and p.rstrip().endswith("</svg>") for p in pages)


def test_objects_by_handle(spark, folder):
    files = spark.read.format("binaryFile").load(str(folder / "a.dwg"))
    path = files.first()["path"]
    wanted = spark.createDataFrame([(path, 16), (path, 17), (path, 99999), (path, 16)], "path string, handle bigint")
    got = {r["handle"]: r["status"] for r in drawing.objects_at(files, wanted).collect()}
    assert got == {16: "ok", 17: "ok", 99999: "missing"}
    assert drawing.objects_at(files, wanted.filter("handle < 20"), strict=True).count() == 2
    with pytest.raises(container.ContainerError):
        drawing.objects_at(files, wanted, strict=True)


def test_objects_by_handle_are_not_broadcast(spark):
    """Spark estimates what is decoded from files by their table, here of a few numbers, and would broadcast it."""
    content = samples.drawing(2018, 1)[0]
    files = spark.range(3).select(F.col("id").cast("string").alias("path"), F.lit(len(content)).cast("bigint").alias("length"), F.lit(content).alias("content"))
    handles = drawing.tables_of(files, "handle_map").select("path", "handle")
    found = drawing.objects_at(files, handles)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.filter("status = 'ok'").count() == handles.count() > 200


def test_error_classes(spark):
    texts = {"no drawing": "NOT_A_DRAWING", "system page at 9 beyond the file": "TRUNCATED", "32 bits at 5 of 9": "TRUNCATED", "page at 3 has tag 0x1 and packing 2": "BAD_MARK", "2007 header": "DEFERRED", "section 'x' over the limit": "LIMIT_EXCEEDED", "what": "OTHER", "": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", drawing.error_class(F.col("t")).alias("c")).collect()} == texts
