import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from draftlake.functions import bits, codecs, records
from draftlake.plans import samples
from draftlake.sources import container, drawing

P = lambda *a: dict(zip("xyz", map(float, a)))
UP = P(0, 0, 1)


def test_bit_values_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        values = [
            ("B", rng.random() < 0.5), ("BB", rng.randrange(4)), ("B3", rng.choice([0, 2, 6, 7])), ("BS", rng.choice([0, 256, 5, -1, -32768, 32767])), ("BSu", rng.randrange(65536)), ("BL", rng.choice([0, 255, 256, -1, 2**31 - 1])),
            ("BLL", rng.choice([0, 1, 2**40, 2**56 - 1])), ("BD", rng.choice([0.0, 1.0, -2.5, 1e300])), ("RC", rng.randrange(256)), ("RS", rng.randrange(65536)), ("RL", rng.randrange(2**32)), ("RD", rng.uniform(-1, 1)),
            ("MC", rng.randrange(-(2**40), 2**40)), ("MS", rng.randrange(2**30)), ("TV", rng.choice(["", "abc", "ёж", "x" * 300])), ("BT", rng.choice([0.0, 3.0])), ("BE", rng.choice([(0.0, 0.0, 1.0), (1.0, 2.0, 3.0)])),
        ]
        rng.shuffle(values)
        w = bits.BitWriter()
        for k, v in values:
            getattr(w, k)(v)
        r = bits.BitReader(w.bytes())
        assert [(k, getattr(r, k)()) for k, _ in values] == values
    for v in (0, 5, 2**63 - 1, -1, -(2**63)):
        w = bits.BitWriter()
        w.H({"code": 4, "counter": 0, "value": v})
        assert bits.BitReader(w.bytes()).H()["value"] == v


def test_bits_run_out():
    with pytest.raises(bits.BitsExhausted):
        bits.BitReader(b"\x00").RS()
    with pytest.raises(ValueError):
        bits.BitReader(b"\xff").BD()


@pytest.mark.parametrize(
    "kind,rec",
    [
        ("LINE", {"is_2d": False, "start": P(1, 2, 3), "end": P(4, 6, 3), "thickness": 0.0, "extrusion": UP}),
        ("LINE", {"is_2d": True, "start": P(1, 2, 0), "end": P(4, 6, 0), "thickness": 2.0, "extrusion": P(0, 1, 0)}),
        ("3DFACE", {"corners": [P(0, 0, 0), P(1, 0, 0), P(1, 1, 0), P(0, 1, 0)], "invisible_edges": 3, "is_triangle": False}),
        ("3DFACE", {"corners": [P(0, 0, 1), P(1, 0, 2), P(1, 1, 0), P(1, 1, 0)], "invisible_edges": 0, "is_triangle": True}),
        ("INSERT", {"insertion_point": P(1, 2, 0), "scale": P(2, 2, 2), "rotation": 0.5, "extrusion": UP, "has_attribs": False}),
        ("INSERT", {"insertion_point": P(1, 2, 0), "scale": P(1, 2, 3), "rotation": 0.5, "extrusion": UP, "has_attribs": True}),
        ("LWPOLYLINE", {"flag": 0x408, "elevation": None, "thickness": None, "extrusion": None, "constant_width": None, "vertices": [P(0, 0), P(1, 1)], "bulges": [0.5, 0.0], "vertex_ids": [], "widths": [], "closed": True}),
        ("XDATA", {"app_handle": {"code": 5, "counter": 1, "value": 9}, "items": [{"code": 1000, "text": "a", "data": None, "handle": None, "point": None, "real": None, "short": None, "whole": None}]}),
        ("DICTIONARY", {"cloning_flag": 1, "hard_owner": 0, "entries": [{"name": "k", "handle": {"code": 2, "counter": 1, "value": 7}}]}),
    ],
)
@pytest.mark.parametrize("version", [2000, 2007, 2018])
def test_records_round_trip(kind, rec, version):
    assert records.decode(kind, records.encode(kind, rec, version), version)[:2] == (rec, "ok")


@pytest.mark.parametrize("version", [2004, 2010, 2013, 2018])
def test_every_sample_decodes_to_its_values(version):
    """Values and consumed bits of records written by an encoder that knows no layout."""
    kinds = set()
    for s in samples.SAMPLES:
        kinds.add(s.kind)
        bits, want = samples.encode(s.text, version, 2)
        common = samples.encode(samples._PRE, version, 0)[0] if s.family == "entity" else ""
        data = samples._to_bytes(common + bits)
        rec, status, message, used = records.decode_entity(s.kind, data, version)[1:] if common else records.decode(s.kind, data, version)
        if version < s.since:
            assert status == "error", s.kind
        else:
            assert (records._plain(rec), status, message, used) == (want, "ok", None, len(common + bits)), s.kind
    assert kinds == set(records.LAYOUTS)


def test_a_class_below_the_first_is_an_error():
    bits = samples.encode("BS:499 BS:0 TV:a TV:b TV:c B:0 BS:498", 2018, 0)[0]
    assert records.decode("CLASS_MAP_EXTENSION", samples._to_bytes(bits), 2018)[1:3] == ("error", "a class below 500")


def test_stub_sections():
    data = samples.drawing(2018, 1)[0]
    d = container.Drawing(data[: len(data) // 2])
    assert d.status == "Fallback" and [s["name"] for s in d.sections][:3] == ["SectionPageMap", "AcDb:SummaryInfo", "AcDb:Preview"] and d.section("AcDb:SummaryInfo") == b""
    assert container.first_page(data[:0x110]) is None and container.first_page(bytes(0x200)) is None
    assert container.Drawing(data[:0x90]).sections == []


def test_every_layout_has_a_schema_and_survives_dirt(spark):
    rng = random.Random(2)
    for kind in records.LAYOUTS:
        spark.createDataFrame([], f"rec {records.schema(kind)}")
        for n in (0, 1, 7, 60):
            rec, status, message, _ = records.decode(kind, rng.randbytes(n), rng.choice([14, 2000, 2010, 2018]))
            assert status in ("ok", "error") and (rec is None) == (status != "ok") and (message is None) == (status == "ok")
    assert records.decode("SEQEND", b"", 2018)[1] == "unhandled" and records.decode("LINE", None, 2018)[1] == "error"
    assert records.decode("CAMERA", bytes(99), 2004)[1] == "error"


def test_decode_keeps_failures(spark):
    good = records.encode("CIRCLE", {"center": P(1, 2, 3), "radius": 4.0, "thickness": 0.0, "extrusion": UP}, 2018)
    df = spark.createDataFrame([(1, good, 2018, "a"), (2, b"\x00", 2018, "b"), (3, None, 2018, "c"), (1, good, None, "a")], "id int, raw binary, version int, message string")
    rows = {(r["id"], r["status"]) for r in records.decode_records(df, "CIRCLE").collect()}
    assert rows == {(1, "ok"), (2, "error"), (3, "error")}
    with pytest.raises(Exception):
        records.decode_records(df, "CIRCLE", strict=True).collect()
    assert records.decode_records(df.limit(0), "CIRCLE").count() == 0


def test_checksums_and_codes():
    assert codecs.page_checksum(b"Wikipedia", 1) == 0x11E60398 and codecs.crc32(b"123456789") == 0xCBF43926 and codecs.crc16(b"123456789") == 0xBB3D
    rng = random.Random(3)
    for n in (0, 4, 18, 19, 273, 274, 1000):
        data = rng.randbytes(n)
        assert codecs.lz77_decompress(codecs.lz77_compress(data)) == data
    for bad in (b"", b"\x02abc", b"\x01abcd\x05", b"\x11\x11"[:0], bytes([0x02]) + b"Hello" + bytes([0xFF, 0xFF])):
        with pytest.raises(codecs.Lz77Error):
            codecs.lz77_decompress(bad)
    # seven literals, then five bytes from three back, then two literals
    assert codecs.lz77_decompress(bytes([0x04]) + b"ABCDEFG" + bytes([0x6A, 0x00]) + b"XY" + b"\x11") == b"ABCDEFGEFGEFXY"
    word = codecs.rs_encode(rng.randbytes(239))
    for errors in range(9):
        broken = bytearray(word)
        for i in rng.sample(range(255), errors):
            broken[i] ^= rng.randrange(1, 256)
        assert codecs.rs_correct(bytes(broken)) == (word[:239], errors)
    x = rng.randbytes(30)
    assert codecs.rotate_windows(codecs.rotate_windows(x, 13), 43) == x


def test_column_codecs_equal_serial_ones(spark):
    texts = ["", "a", "Größe", "x" * 500, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    numbers = codecs.text_bytes(F.col("t"))
    for r in df.select("t", codecs.page_checksum_of(numbers, 1).alias("a"), codecs.rotate_add_of(numbers).alias("b"), codecs.crc16_of(numbers, 7).alias("c")).collect():
        if r["t"] is None:
            assert r["a"] is None
        else:
            data = r["t"].encode()
            assert (r["a"], r["b"], r["c"]) == (codecs.page_checksum(data, 1), codecs.rotate_add(data), codecs.crc16(data, 7))


def make(version, n=50):
    stream, index = bytes(4), []
    for k in range(n):
        body = records.write_body("CIRCLE", {"center": P(k, 1, 0), "radius": 2.0, "thickness": 0.0, "extrusion": UP}, version, {"xdata": [{"app": {"code": 5, "counter": 1, "value": 3}, "data": b"ab"}], "ltype_scale": 1.0, "color_index": 3})
        index.append((16 + k, len(stream)))
        stream += container.write_object(0x12, 16 + k, body, version)
    sections = {"AcDb:AcDbObjects": stream, "AcDb:Handles": container.write_handle_index(index), "AcDb:SummaryInfo": container.write_summary_info({"title": "Ü", "properties": [{"key": "a", "value": "b"}]}), "AcDb:Template": b"ab"}
    return container.build(version, sections, page_size=400), sections


@pytest.mark.parametrize("version", container.PAGED)
def test_container_round_trip(version):
    content, sections = make(version)
    d = container.Drawing(content)
    assert d.status == "Full" and {n: d.section(n) for n in sections} == sections
    assert d.section("AcDb:Header") is None
    with pytest.raises(container.ContainerError):
        d.section("AcDb:AcDbObjects", 10)
    m = container.masked_header(content)
    assert m["crc"] == m["crc_actual"]
    index = [(h, o) for _, h, o in container.handle_index(sections["AcDb:Handles"])]
    by_index = list(container.objects(sections["AcDb:AcDbObjects"], version, index))
    assert [o["raw"] for o in by_index] == [o["raw"] for o in container.objects(sections["AcDb:AcDbObjects"], version)] and len(by_index) == 50
    common, rec, status, _, _ = records.decode_entity("CIRCLE", by_index[7]["raw"], version, by_index[7]["body_bit"])
    assert status == "ok" and rec["center"]["x"] == 7.0 and common["color_index"] == 3 and common["xdata"][0]["data"] == b"ab"


def test_source_reads_files_and_keeps_bad_ones(spark, tmp_path):
    content, _ = make(2018)
    (tmp_path / "sub").mkdir()
    for name, data in (("a.dwg", content), ("sub/b.DWG", content[: len(content) // 2]), ("c.dwg", b"nothing"), ("d.dwg", b"AC9999" + bytes(300)), ("e.dwg", b""), ("f.txt", content), ("g.dwg", b"AC1021" + bytes(300))):
        (tmp_path / name).write_bytes(data)
    spark.dataSource.register(drawing.DrawingSource)
    read = lambda t, **o: spark.read.format("drawing").options(path=str(tmp_path), table=t, **o).load()
    status = {r["path"].rsplit("/", 1)[1]: r["section_map_status"] for r in read("files").collect()}
    assert status == {"a.dwg": "Full", "b.DWG": "Fallback", "c.dwg": "Error", "d.dwg": "Error", "e.dwg": "Error", "g.dwg": "Deferred"}
    assert read("raw_objects").filter("status = 'ok'").count() == 50 and read("handle_map").count() == 50 and read("sections").filter("path like '%a.dwg'").count() == 4
    assert {r["name"].split("(")[0] for r in read("sections").filter("path like '%b.DWG'").collect()} == {"SectionPageMap", "DataPage"}
    assert drawing.read(spark, str(tmp_path), "raw_objects").filter("status = 'ok'").count() == 50 and drawing.read(spark, str(tmp_path), "files").count() == 5  # empty files have no row there
    assert read("summary_info").first()["properties"][0]["key"] == "a" and read("pages").count() > 5 and read("section_pages").count() > 4
    assert read("files", maxFileBytes="10").filter("section_map_status = 'Error'").count() == 6
    with pytest.raises(Exception):
        read("files", mode="FAILFAST").collect()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "a.dwg").load(str(tmp_path))
    assert drawing.tables_of(files, "raw_objects").count() == 50 and drawing.tables_of(files.withColumn("length", F.lit(None).cast("long")), "raw_objects").count() == 50
    # index joins of the relational core agree with the source's own assembly
    from draftlake.operators import relational

    firsts = relational.page_offsets(read("sections").filter("path like '%a.dwg'"), read("section_pages"), read("pages")).collect()
    assert len(firsts) == 4 and all(r["file_offset"] == r["offset"] for r in firsts)


def test_metadata_sections(spark):
    import struct

    from draftlake.sources import metadata as M

    text = lambda s: struct.pack("<H", len(s)) + s.encode()
    wide = lambda s: struct.pack("<H", len(s)) + s.encode("utf-16-le")
    long = lambda s: struct.pack("<I", len(s)) + s.encode()
    assert M.app_info(text("A") + bytes(4) + text("") + text("<x/>") + text("9")) == {"name": "A", "product_xml": "<x/>", "version": "9", "comment": "", "product": ""}
    assert M.app_info(b"\x02\0\0\0" + wide("Ä") + bytes(20) + wide("1") + bytes(16) + wide("c") + bytes(16) + wide("p"))["product"] == "p"
    deps = M.file_dependencies(struct.pack("<I", 1) + long("xref") + struct.pack("<I", 2) + b"".join(long("f") + long("p") + long("g") + long("v") + struct.pack("<iii", k, 1, 2) + struct.pack("<H", 1) + struct.pack("<i", 3) for k in (0, 7)))
    assert [d["feature"] for d in deps] == ["xref", "?"]
    image = M.PNG + b"data"
    listed = M.PREVIEW_START + struct.pack("<IB", 50, 1) + struct.pack("<BII", 6, 30, len(image)) + image + M.PREVIEW_END
    assert M.preview(listed)["bmp"] == image and M.preview(M.PREVIEW_START + bytes(5) + image + M.PREVIEW_END)["bmp"] == image
    with pytest.raises(container.ContainerError):
        M.preview(b"x")
    with pytest.raises(container.ContainerError):
        M.file_dependencies(b"\xff\xff\xff\xff")
    w = bits.BitWriter()
    w.BD(1.5)
    w.BD(0.0)
    h = M.header_variables(M.HEADER_START + (68).to_bytes(4, "little") + w.bytes())
    assert h["valid_mark"] and M.leading(h["body"], "BD", 2) == [1.5, 0.0] and M.header_variables(b"")["body"] == b""
    content = container.build(2018, {"AcDb:Preview": listed, "AcDb:AppInfo": text("A") + bytes(4) + text("") + text("") + text("")})
    files = spark.createDataFrame([("p", len(content), content)], "path string, length bigint, content binary")
    assert drawing.tables_of(files, "previews").first()["bmp"] == image and drawing.tables_of(files, "app_info").first()["name"] == "A" and drawing.tables_of(files, "header_variables").count() == 0


def test_code_words_at_once_equal_one_by_one():
    rng = random.Random(8)
    words = []
    for errors in [*range(17)] * 6 + [255] * 5:
        word = bytearray(codecs.rs_encode(rng.randbytes(239)))
        for i in rng.sample(range(255), errors):
            word[i] ^= rng.randrange(1, 256)
        words.append(bytes(word))
    messages, corrected = codecs.rs_correct_all(np.frombuffer(b"".join(words), np.uint8).reshape(-1, 255))
    for word, message, n in zip(words, messages, corrected):
        try:
            assert codecs.rs_correct(word) == (message.tobytes(), n)
        except ValueError:
            assert n == -1
    assert (corrected >= 0).any() and (corrected < 0).any()
    back = codecs.rs_decoded.func(pd.Series([None, b"", b"x", words[3] + words[8], words[3] + words[-1]]))
    assert back["status"].tolist() == [None, "ok", "no whole code words", "ok", "more errors than the code corrects"] and back["corrected"][3] == 11
    assert back["data"][3] == messages[3].tobytes() + messages[8].tobytes() and back["data"][1] == b""


def test_many_code_words_take_little_time():
    """One by one, these take over ten seconds."""
    words = codecs.rs_encoded.func(pd.Series([b"%d" % i for i in range(5_000)] + [None, b"", bytes(240)]))
    assert words[4_999][:239] == b"4999" + bytes(235) and words[5_000] is None and words[5_001] == b"" and len(words[5_002]) == 510
    began = time.process_time()
    back = codecs.rs_decoded.func(words[:5_000].map(lambda w: bytes(w[:3]) + b"~" + w[4:90] + b"~~~~" + w[94:]))
    assert time.process_time() - began < 3 and (back["status"] == "ok").all() and back["data"][4_999][:4] == b"4999"
