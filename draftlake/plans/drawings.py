"""Queries on drawing files: a file for every row of the files table, through the source and the decoders.

The files come from `samples`, whose encoder shares nothing with the reader; the
SQL states what it put into them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.functions import records
from draftlake.operators import relational as R
from draftlake.plans import samples as S
from draftlake.runtime import checkpoint, load, tasks_for
from draftlake.sources import container as C
from draftlake.sources import drawing


def contents(spark: SparkSession, d: str) -> DataFrame:
    """(path, length, content) for every path of the files table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                made = [S.content_of(p, v) for p, v in zip(part.column("path").to_pylist(), part.column("version").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("path"), pa.array(map(len, made), pa.int64()), pa.array(made, pa.binary())], ["path", "length", "content"])

    table = load(spark, d, "files").select("path", "version")
    # cut by rows: few bytes make much work here
    placed = table.repartition(tasks_for(spark, table.count(), 250), "path")
    return placed.groupBy("path").agg(F.max("version").alias("version")).mapInArrow(run, "path string, length bigint, content binary")


def _versions(df: DataFrame) -> DataFrame:
    return df.withColumn("version", F.expr("case version " + " ".join(f"when '{m}' then {v}" for m, v in C.VERSIONS.items()) + " end"))


def objects_with_version(spark: SparkSession, d: str) -> DataFrame:
    """Objects with the version of their file, the kind by fixed codes and by the classes of the file, and the bytes of their body."""
    made = checkpoint(contents(spark, d))
    files = _versions(drawing.tables_of(made, "files")).select("path", "version")
    return records.with_kinds(drawing.tables_of(made, "raw_objects").join(files, "path"), drawing.tables_of(made, "classes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Tables of the source: the columns of the query, and how they are shown.
_SHOWN = {
    "sections": "name, kind, offset, size, compressed, encrypted",
    "pages": "seq, number, size, file_offset, is_gap",
    "section_pages": "section_name, page_number, data_size, start_offset",
    "handle_map": "seq, handle, stream_offset",
    "classes": "class_number, class_version, app_name, cpp_class_name, dxf_class_name, was_a_proxy, item_class_id",
    "raw_objects": "stream_offset, size_bytes, type_code, handle, raw_md5, body_bit",
    "summary_info": "title, subject, author, keywords, comments, last_saved_by, revision_number, hyperlink_base, total_edit_time, create_date, modified_date, property_key, property_value",
    "app_info": "name, product_xml, app_version, comment, product",
    "file_dependencies": "full_filename, found_path, fingerprint_guid, version_guid, feature_index, timestamp_, filesize, affects_graphics, reference_count, feature",
    "previews": "overall_size, bmp, header",
    "header_variables": "valid_mark, size_in_bits, body",
}
_AS = {
    "raw_objects": {"handle": "handle.value", "raw_md5": "md5(raw)"},
    "summary_info": {"total_edit_time": "lower(hex(total_edit_time_raw))", "create_date": "lower(hex(create_date_raw))", "modified_date": "lower(hex(modified_date_raw))", "property_key": "properties[0].key", "property_value": "properties[0].value"},
    "classes": {"class_version": "version"},
    "app_info": {"app_version": "version"},
    "file_dependencies": {"timestamp_": "timestamp"},
    "previews": {"bmp": "lower(hex(bmp))", "header": "lower(hex(header))"},
    "header_variables": {"body": "lower(hex(body))"},
}


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    columns = _SHOWN[name].split(", ")

    def run(spark: SparkSession, d: str) -> DataFrame:
        return drawing.tables_of(contents(spark, d), name).selectExpr("path", *[f"{_AS.get(name, {}).get(c, c)} as {c}" for c in columns])

    return run


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(S._literal, r)) + ")" for r in rows)


def _of_variant(table: str) -> list[tuple]:
    return [(m, k, *row) for m, v in S.VERSIONS.items() for k in range(S.CONTENTS) for row in S.drawing(v, k)[1][table]]


_OLD = ("AC1014", "AC1015")
for _t, _columns in _SHOWN.items():
    QUERIES[f"s_{_t}"] = _table(_t)
    SQL[f"s_{_t}"] = S.expected_sql(_t, _columns.replace(" offset,", ' "offset",'))
_SECTIONS = _SHOWN["sections"].replace("offset", '"offset"')
# a file without its page map names the sections of its headers, one of before 2004 those of its locators
SQL["s_sections"] += f" union all select path, {_SECTIONS} from {S.FILES} f join (values {_values(_of_variant('broken_sections'))}) t(version_, k_, {_SECTIONS}) on version = version_ and k = k_ where broken"
SQL["s_sections"] += f" union all select path, {_SECTIONS} from {S.FILES} f join (values {_values([(m, *r) for m in _OLD for r in S.old_drawing(m)[1]])}) t(version_, {_SECTIONS}) on version = version_"
SQL["s_header_variables"] += f" union all select path, false, 0, '' from {S.FILES} f where version in {_OLD}"


def s_files(spark: SparkSession, d: str) -> DataFrame:
    return drawing.tables_of(contents(spark, d), "files")


_LENGTHS = [(m, k, len(S.drawing(v, k)[0])) for m, v in S.VERSIONS.items() for k in range(S.CONTENTS)]
SQL["s_files"] = (
    f"select path, n as length, version, k as maint_version, 30 as codepage, 'Full' as section_map_status, null as reason from {S.FILES} f join (values {_values(_LENGTHS)}) t(version_, k_, n) on version = version_ and k = k_ where not broken "
    f"union all select path, n, version, maint, page, status, reason from {S.FILES} f join (values {_values([(m, k, *r) for m, k, *r in _of_variant('broken')])}) t(version_, k_, n, magic, maint, page, status, reason) on version = version_ and k = k_ where broken "
    f"union all select path, n, version, 1, 29, case version when 'AC1021' then 'Deferred' else 'Full' end, case version when 'AC1021' then '2007 header' end from {S.FILES} f join (values {_values([(m, len(S.old_drawing(m)[0])) for m in (*_OLD, 'AC1021')])}) t(version_, n) on version = version_"
)
QUERIES["s_files"] = s_files


def decoded(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Typed records of a kind, shown as JSON; the body begins at a bit of the record, so the decoder gets record and bit."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        own = "CONTROL" if kind == "CONTROL" else kind
        wanted = F.col("type_name") == kind if kind != "CONTROL" else F.col("type_name").isin(*records.CONTROL_KINDS)
        rows = objects_with_version(spark, d).filter(wanted).select("path", F.col("handle.value").alias("handle"), "version", "raw", "body_bit")
        return records.decode_records(rows, own, at="body_bit", common=kind in records.WITH_COMMON).select("path", "handle", "status", F.to_json("rec").alias("record"))

    return run


def decoded_part(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Records that stand inside others."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = [(v, k, S.part_record(kind, v, k)[0]) for v in S.VERSIONS.values() for k in range(S.CONTENTS)]
        parts = F.broadcast(spark.createDataFrame(rows, "version int, k int, raw binary"))  # a row per version and content
        files = _versions(load(spark, d, "files").groupBy("path").agg(F.max("version").alias("version"))).withColumn("k", F.length("path") % S.CONTENTS)
        return records.decode_records(files.join(parts, ["version", "k"]), kind).select("path", "status", F.to_json("rec").alias("record"))

    return run


for _k in dict.fromkeys(s.kind for s in S.SAMPLES):
    _part = any(s.kind == _k and s.family == "part" for s in S.SAMPLES)
    QUERIES[f"s_decoded_{_k.lower()}"] = decoded_part(_k) if _part else decoded(_k)
    SQL[f"s_decoded_{_k.lower()}"] = S.part_sql(_k) if _part else S.records_sql(_k)


def s_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What decodes of every kind, by version, in one pass over all objects."""
    typed = objects_with_version(spark, d).filter("raw is not null").select("type_name", "version", "raw", "body_bit")
    return R.coverage(records.decode_all(typed).select("type_name", "version", "status"), ["type_name", "version"])


_KINDS = [(m, v, k, "LAYER_CONTROL" if own == "CONTROL" else own) for m, v in S.VERSIONS.items() for k in range(S.CONTENTS) for _, own, _ in S.drawing(v, k)[1]["records"]]
QUERIES["s_coverage"] = s_coverage
SQL["s_coverage"] = (
    f"select type_name, v as version, count(*) as decoded, 0 as unhandled, 0 as errored, count(*) as total, 1.0::double as decoded_ratio from {S.FILES} f join (values {_values(_KINDS)}) t(version_, v, k_, type_name) on version = version_ and k = k_ where not broken group by type_name, v"
)
