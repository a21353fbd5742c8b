"""Tables of drawing files, as a Spark data source and as functions over a table of file contents.

    spark.dataSource.register(DrawingSource)
    spark.read.format("drawing").option("path", "/drawings").option("table", "raw_objects").load()

Files are read in groups of about the same bytes, or, through `read`, by the
`binaryFile` source, which also reads object stores. Options: table
(files, sections, pages, section_pages, handle_map, classes, raw_objects,
summary_info, payloads and more), mode (PERMISSIVE keeps failures as rows,
FAILFAST raises), limits (safe, paranoid or permissive), and maxFileBytes and
maxSectionBytes in place of theirs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from draftlake.functions import codecs
from draftlake.sources import container as C
from draftlake.sources import metadata
from draftlake.sources.limits import SAFE, named

H = "struct<code:tinyint,counter:tinyint,value:bigint>"
SCHEMAS = {
    "files": "path string, length bigint, version string, maint_version smallint, codepage int, section_map_status string, reason string",
    "sections": "path string, name string, kind string, offset bigint, size bigint, compressed boolean, encrypted boolean",
    "pages": "path string, seq int, number int, size bigint, file_offset bigint, is_gap boolean",
    "section_pages": "path string, section_name string, page_number bigint, data_size bigint, start_offset bigint",
    "handle_map": "path string, seq int, handle bigint, stream_offset bigint",
    "classes": "path string, class_number int, version smallint, app_name string, cpp_class_name string, dxf_class_name string, was_a_proxy boolean, item_class_id int",
    "raw_objects": f"path string, stream_offset bigint, size_bytes bigint, type_code int, handle {H}, raw binary, body_bit int, status string, reason string",
    "summary_info": "path string, title string, subject string, author string, keywords string, comments string, last_saved_by string, revision_number string, hyperlink_base string, total_edit_time_raw binary, create_date_raw binary, modified_date_raw binary, properties array<struct<key:string,value:string>>",
    "app_info": "path string, name string, product_xml string, version string, comment string, product string",
    "file_dependencies": "path string, full_filename string, found_path string, fingerprint_guid string, version_guid string, feature_index int, timestamp int, filesize int, affects_graphics boolean, reference_count int, feature string",
    "previews": "path string, overall_size bigint, bmp binary, wmf binary, header binary",
    "header_variables": "path string, valid_mark boolean, size_in_bits bigint, body binary",
    "payloads": "path string, name string, payload binary, status string",
}
MAX_FILE = SAFE.max_file_bytes


METADATA = {
    "summary_info": ("AcDb:SummaryInfo", C.summary_info),
    "app_info": ("AcDb:AppInfo", metadata.app_info),
    "file_dependencies": ("AcDb:FileDepList", metadata.file_dependencies),
    "previews": ("AcDb:Preview", metadata.preview),
    "header_variables": ("AcDb:Header", metadata.header_variables),
}


def _signed(v: int) -> int:
    v &= 2**64 - 1
    return v - 2**64 if v >> 63 else v


def rows_of(table: str, path: str, content: bytes | None, length: int, strict: bool = False, max_section: int = codecs.MAX_OUTPUT) -> Iterator[tuple]:
    """Rows of one table for one file. In the permissive mode a file that fails gives a row of `files` with the reason and no rows elsewhere."""
    try:
        if content is None:
            raise C.ContainerError("file over the limit")
        d = C.Drawing(bytes(content))
        if strict and d.status != "Full":
            raise C.ContainerError(d.reason)
    except C.ContainerError as e:
        if strict:
            raise
        if table == "files":
            yield path, length, None, None, None, "Error", str(e)
        return
    h = d.header
    if table == "files":
        yield path, length, h["version"], h["maint_version"], h["codepage"], d.status, d.reason
    elif table == "sections":
        first = {p["number"]: p["file_offset"] for p in reversed(d.pages) if not p["is_gap"]}
        for s in d.sections:
            offset = s.get("offset", first.get(s["pages"][0]["page_number"], 0) if s["pages"] else 0)
            yield path, s["name"], s.get("kind") or C.SECTIONS.get(s["name"], "unknown"), offset, s["size"], s["compressed"] == 2, s["encrypted"] == 1
    elif table == "pages":
        for p in d.pages:
            yield path, p["seq"], p["number"], p["size"], p["file_offset"], p["is_gap"]
    elif table == "section_pages":
        for s in d.sections:
            for r in s["pages"]:
                yield path, s["name"], r["page_number"], r["data_size"], r["start_offset"]
    else:
        try:
            yield from _decoded(table, path, d, max_section)
        except (C.ContainerError, codecs.Lz77Error) as e:
            if strict:
                raise C.ContainerError(str(e)) from e


def _decoded(table: str, path: str, d: C.Drawing, limit: int) -> Iterator[tuple]:
    if table == "handle_map":
        for seq, handle, offset in C.handle_index(d.section("AcDb:Handles", limit) or b""):
            yield path, seq, _signed(handle), offset
    elif table == "payloads":
        for s in d.sections:
            try:
                yield path, s["name"], d.section(s["name"], limit), "ok"
            except (C.ContainerError, codecs.Lz77Error) as e:
                yield path, s["name"], None, str(e)
    elif table == "classes":
        for c in C.class_map(d.section("AcDb:Classes", limit) or b"", d.number):
            yield (path, *c.values())
    elif table == "raw_objects":
        stream = d.section("AcDb:AcDbObjects", limit) or b""
        handles = d.section("AcDb:Handles", limit)
        index = [(h, o) for _, h, o in C.handle_index(handles)] if handles else None
        for o in C.objects(stream, d.number, index):
            yield path, o["stream_offset"], o.get("size_bytes"), o.get("type_code"), o.get("handle"), o.get("raw"), o.get("body_bit"), o["status"], o["reason"]
    else:
        section, parse = METADATA[table]
        data = d.section(section, limit)
        if data is not None:
            got = parse(data)
            for row in got if isinstance(got, list) else [got]:
                yield (path, *row.values())


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(len(files))
        self.files = files


#: Bytes and files in one partition of the source: many small files share a task.
GROUP_BYTES, GROUP_FILES = 64 << 20, 2_000


class DrawingReader(DataSourceReader):
    def __init__(self, options: dict, table: str):
        self.options, self.table = options, table

    def partitions(self) -> list[_Files]:
        root = self.options["path"]
        if os.path.isfile(root):
            found = [root]
        else:
            found = sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.lower().endswith(".dwg"))
        groups: list[list[tuple[str, int]]] = [[]]
        size = 0
        for path in found:
            own = os.path.getsize(path)
            if groups[-1] and (size + own > GROUP_BYTES or len(groups[-1]) >= GROUP_FILES):
                groups.append([])
                size = 0
            groups[-1].append((path, own))
            size += own
        return [_Files(g) for g in groups]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path, size in partition.files:
            yield from self._rows(path, size)

    def _rows(self, path: str, size: int) -> Iterator[tuple]:
        content = None
        limits = named(self.options.get("limits", "safe"))
        if size <= int(self.options.get("maxfilebytes", limits.max_file_bytes)):
            with open(path, "rb") as f:
                content = f.read()
        strict = self.options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        for row in rows_of(self.table, path, content, size, strict, int(self.options.get("maxsectionbytes", limits.max_section_bytes))):
            yield tuple((v["code"], v["counter"], v["value"]) if isinstance(v, dict) else [(p["key"], p["value"]) for p in v] if isinstance(v, list) else v for v in row)


class DrawingSource(DataSource):
    """Format "drawing" for folders that every executor sees; for object stores use `tables_of` over a binaryFile scan."""

    @classmethod
    def name(cls) -> str:
        return "drawing"

    def _table(self) -> str:
        table = self.options.get("table", "files")
        if table not in SCHEMAS:
            raise ValueError(f"no table {table!r}; there are {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> DrawingReader:
        return DrawingReader({k.lower(): v for k, v in dict(self.options).items()}, self._table())


def read(spark: SparkSession, path: str, table: str, **limits) -> DataFrame:
    """One table of all drawings below a path, local or in an object store; Spark groups small files into tasks and leaves out empty ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[dD][wW][gG]").load(path)
    return tables_of(files, table, **limits)


def tables_of(files: DataFrame, table: str, strict: bool = False, max_file: int = MAX_FILE, max_section: int = codecs.MAX_OUTPUT) -> DataFrame:
    """One table of a DataFrame (path, length, content), as `spark.read.format("binaryFile")` gives it. Null contents are files that fail, a null length is that of the content."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = SCHEMAS[table]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, content in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "content"))):
                length = len(content or b"") if length is None else length
                rows = list(rows_of(table, path, content if length <= max_file else None, length, strict, max_section))
                for at in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[at : at + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return files.select("path", "length", "content").mapInArrow(run, schema)


def objects_at(files: DataFrame, handles: DataFrame, strict: bool = False) -> DataFrame:
    """Objects of `files` by (path, handle), each handle with its object or with status 'missing'; `strict` raises on the first that isn't ok.

    Both sides are sorted and merged: Spark knows the size of the files at most,
    nothing of what is decoded from them, and would broadcast all objects.
    """
    rows = tables_of(files, "raw_objects").select("path", F.col("handle.value").alias("handle"), "stream_offset", "size_bytes", "type_code", "raw", "body_bit", "status", "reason")
    out = handles.select("path", "handle").distinct().hint("merge").join(rows.hint("merge"), ["path", "handle"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    bad = out.filter("status <> 'ok'").select("path", "handle", "status").head(1) if strict else []
    if bad:
        raise C.ContainerError(f"object {bad[0]['handle']:#x} of {bad[0]['path']}: {bad[0]['status']}")
    return out


# Classes of errors, by what their messages hold.
ERROR_CLASSES = {
    "NOT_A_DRAWING": "no drawing", "UNSUPPORTED_VERSION": "unsupported version|needs version|can't be written", "TRUNCATED": "beyond the file|cut short|shorter than|stream ends|of [0-9]+$", "BAD_MARK": "without its mark|has tag", "MISSING_PAGE": "which is missing|not in the page map",
    "LIMIT_EXCEEDED": "over the limit|over max_|too many|too much", "BAD_PACKING": "packing|opcode|reference [0-9]+ back", "UNKNOWN_SECTION": "unknown sections", "DEFERRED": "2007 header", "BAD_VALUE": "tag 3 of|modular number|handle of [0-9]+ bytes|scenario|class below",
}


def error_class(reason: Column) -> Column:
    """The class of a message, 'OTHER' for one of none, null for no message."""
    found = F.coalesce(*[F.when(reason.rlike(form), name) for name, form in ERROR_CLASSES.items()], F.lit("OTHER"))
    return F.when(reason.isNotNull() & (reason != ""), found)
