"""Queries on general data problems, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.operators import hierarchy as trees
from draftlake.operators import hotkeys, orphans, units
from draftlake.runtime import checkpoint, load, shuffle_partitions


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return checkpoint(units.measurements(load(spark, d, "decoded_objects")))


def _comparable(spark: SparkSession, d: str) -> DataFrame:
    """Widths with a named unit and scales, each under its thing."""
    measured = _measured(spark, d)
    widths = units.named_widths(measured).select("object_id", F.concat(F.lit("width:"), "thing").alias("thing"), "recorded", F.col("width_mm").alias("common"))
    scales = measured.filter("kind = 'scale'").select("object_id", F.concat(F.lit("scale:"), "thing").alias("thing"), "recorded", F.col("value").alias("common"))
    return widths.unionByName(scales)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.agreeing_pairs(_comparable(spark, d))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p1_found as pairs of classes with their sizes; `p1_members` says who is in them."""
    return units.agreeing_classes(_comparable(spark, d)).withColumn("n_pairs", F.when(F.col("same"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("bigint"))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    return _comparable(spark, d).filter("thing is not null and common > 0")


def p1_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Right assignments and posteriors of the mixture where the unit is known."""
    return units.calibration(_measured(spark, d))


def p1_widths(spark: SparkSession, d: str) -> DataFrame:
    return units.common_widths(_measured(spark, d))


def p1_scales(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).filter("kind = 'scale'").select("object_id", "thing", "recorded", F.col("value").alias("ratio"), F.col("unit").alias("units"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(load(spark, d, "handle_map"), load(spark, d, "decoded_objects"), load(spark, d, "raw_objects"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_field", "src_id", "target_handle")


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_month(_orphans(spark, d))


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.key_profile(load(spark, d, "raw_objects"), ["type_code", "kind"], shuffle_partitions(spark))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_profile(spark, d).filter("row_share >= 0.05").select("field", "key_text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    tree = trees.hierarchy(load(spark, d, "expanded_entities"))
    return tree.filter(F.col("in_cycle") | (F.col("recorded_depth") != F.col("depth"))).select("entity_id")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return trees.hierarchy(load(spark, d, "expanded_entities"), with_path=True).select("entity_id", "path", "handle", "in_cycle", "depth", "root_handle", F.array_join("node_path", "/").alias("node_path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return trees.descendants(trees.hierarchy(load(spark, d, "expanded_entities"), with_path=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (p1_found, p1_classes, p1_members, p1_mixture, p1_widths, p1_scales, p2_found, p2_by_month, p3_found, p3_profile, p4_found, p4_paths, p4_descendants)}

_TARGET = "case when r.code = 6 then own + 1 when r.code = 8 then own - 1 when r.code = 10 then own + r.value when r.code = 12 then own - r.value when r.code is not null and r.value <> 0 then r.value end"

_ORPHANS = f"""
with linked as (
  select path, object_id src_id, handle own, loaded_at, 'acad_layout.block_record_handle' ref_field, acad_layout.block_record_handle r from decoded_objects
  union all select path, object_id, handle, loaded_at, 'acad_group.member_handles', unnest(acad_group.member_handles) from decoded_objects
  union all select path, object_id, handle, loaded_at, 'lofted_surface.cross_section_handles', unnest(lofted_surface.cross_section_handles) from decoded_objects),
refs as (
  select path, target_handle, ref_field, src_id, min(loaded_at) ref_at from (
    select path, {_TARGET} target_handle, ref_field, src_id, loaded_at from linked
    union all select path, handle, 'handle_map.handle', entry_id, loaded_at from handle_map)
  where target_handle is not null and path is not null group by all),
objs as (
  select path, handle.value target_handle, min(loaded_at) first_at, arg_max(case when status = 'erased' then 1 else 0 end, epoch_us(loaded_at) * 2 + case when status = 'erased' then 1 else 0 end) erased
  from raw_objects where handle.value is not null and path is not null group by all),
orph as (
  select ref_field, src_id, refs.target_handle, ref_at, case when objs.path is null then 'missing' when erased = 1 then 'erased' when first_at > ref_at + interval 24 hour then 'late' end reason
  from refs left join objs on refs.path = objs.path and refs.target_handle = objs.target_handle)
"""

_KEYS = """
with rows_ as (
  select 'type_code' field, cast(type_code as varchar) key_text, object_id, path, size_bytes from raw_objects where type_code is not null
  union all select 'kind', kind, object_id, path, size_bytes from raw_objects where kind is not null),
objs as (select field, key_text, object_id, path, max(size_bytes) size_bytes, count(*) n from rows_ group by all),
prof as (
  select field, key_text, cast(sum(n) as bigint) n_rows, sum(n) / (select cast(count(*) as double) from raw_objects) row_share,
    count(distinct object_id) n_objects, cast(sum(coalesce(size_bytes, 0)) as bigint) n_bytes, count(distinct path) n_drawings from objs group by all)
"""

_TREE = """
with recursive nodes as (
  select path, handle, arg_max(owner_handle, epoch_us(loaded_at)) owner_, any_value(entity_id) entity_id, arg_max(depth, epoch_us(loaded_at)) recorded_depth
  from (select path, handle, coalesce(owner_handle, -1234567890123) owner_handle, entity_id, coalesce(depth, -2147483648) depth, loaded_at from expanded_entities where path is not null and handle is not null) group by path, handle),
linked as (
  select n.*, case when p.handle is null then null else n.owner_ end parent from nodes n left join nodes p on n.path = p.path and n.owner_ = p.handle),
walk as (
  select path, handle, cast(0 as bigint) depth, handle root_handle, cast(handle as varchar) node_path from linked where parent is null
  union all select l.path, l.handle, w.depth + 1, w.root_handle, w.node_path || '/' || l.handle from walk w join linked l on l.path = w.path and l.parent = w.handle),
tree as (
  select l.entity_id, l.path, l.handle, nullif(l.recorded_depth, -2147483648) recorded_depth, w.depth is null in_cycle, w.depth, w.root_handle, w.node_path
  from linked l left join walk w on l.path = w.path and l.handle = w.handle)
"""

def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# DuckDB's patterns know no look-ahead, so a unit is closed by what its words are, the longest first.
_SQL_UNIT = "(?:" + "|".join(w for w in sorted((w for g in units.SPELLINGS.values() for w in g), key=len, reverse=True)) + ")"
_SQL_DECIMAL = r"\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?"
_SQL_NUMBER = rf"\d+\s*-\s*\d+/\d+|\d+/\d+|{_SQL_DECIMAL}"
_SQL_SCALE = rf"^\D*?({_SQL_NUMBER})\s*({_SQL_UNIT})?\s*(?:=|:|/|per\b|auf\b|pour\b|to\b|zu\b)\s*({_SQL_NUMBER})?\s*({_SQL_UNIT})?"
_SQL_SIZED = rf"({_SQL_DECIMAL})\s*({_SQL_UNIT})(?:[^\pL]|$)"
_SQL_NAMED = rf"(?:given as|read as|taken as|size in|gives|units?\s*[=:]|unit is)\s*['\"‘“]?({_SQL_UNIT})(?:[^\pL]|$)"


def _extract(text: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({text}, '" + pattern.replace("'", "''") + f"', {group}, 'i'), '')"


def _unit(text: str) -> str:
    return "(case " + " ".join(f"when lower({text}) in ({_quoted(words)}) then '{unit}'" for unit, words in units.SPELLINGS.items()) + " end)"


def _mm(unit: str) -> str:
    return f"(case {unit} " + " ".join(f"when '{u}' then {mm}::double" for u, mm in units.MM.items()) + " end)"


def _decimal(text: str) -> str:
    part = lambda i: f"try_cast(replace(string_split_regex(regexp_replace({text}, '\\s', '', 'g'), '[-/]')[{i}], ',', '.') as double)"
    return f"(case when not contains({text}, '/') then try_cast(replace(trim({text}), ',', '.') as double) when contains({text}, '-') then {part(1)} + {part(2)} / nullif({part(3)}, 0) else {part(1)} / nullif({part(2)}, 0) end)"


_MEASURED = f"""
with parsed as (
  select object_id, loaded_at, path, image_def is not null as is_width, image_def.file_path as file_path, image_def.pixel_size_units as code, image_def.pixel_width_size as size, acad_scale.scale_name as name, acad_scale.paper_units as paper, acad_scale.drawing_units as drawing,
    {_extract("message", _SQL_SIZED, 1)} as sized_number, {_extract("message", _SQL_SIZED, 2)} as sized_unit, {_extract("message", _SQL_NAMED, 1)} as named_unit,
    {", ".join(f"{_extract('acad_scale.scale_name', _SQL_SCALE, i)} as side{i}" for i in (1, 2, 3, 4))}
  from decoded_objects where object_id is not null and (image_def is not null or acad_scale is not null)),
valued as (
  select *, (case code {" ".join(f"when {c} then '{u}'" for c, u in units.UNIT_OF_CODE.items())} end) as code_unit, coalesce({_unit("sized_unit")}, {_unit("named_unit")}) as text_unit, {_unit("side2")} as paper_unit, {_unit("side4")} as drawing_unit,
    coalesce(paper, {_decimal("side1")}) as paper_number, coalesce(drawing, {_decimal("side3")}, case when side4 is not null then 1.0 end) as drawing_number, coalesce(size, {_decimal("sized_number")}) as width from parsed),
rows_ as (
  select object_id, loaded_at, is_width, case when is_width then file_path else path end as thing, case when is_width then size else paper / nullif(drawing, 0) end as recorded,
    case when is_width then coalesce(code_unit, text_unit) else concat_ws('/', paper_unit, drawing_unit) end as unit,
    case when is_width then width when trim(name) <> '' and drawing_number <> 0 then paper_number / drawing_number * coalesce({_mm("paper_unit")} / {_mm("drawing_unit")}, 1.0) end as value from valued),
measured as (
  select * from (select *, row_number() over (partition by object_id order by loaded_at desc nulls last, is_width desc, thing desc nulls last, recorded desc nulls last, value desc nulls last, unit desc nulls last) as nth from rows_) where nth = 1),
comparable as (
  select object_id, 'width:' || thing as thing, recorded, value * {_mm("unit")} as common from measured where is_width and unit is not null union all select object_id, 'scale:' || thing, recorded, value from measured where not is_width)
"""
_APART = "abs({0} - {1}) > 0.001 * greatest(abs({0}), abs({1}))"

SQL = {
    "p1_found": _MEASURED + f"select a.object_id as object_id_a, b.object_id as object_id_b from comparable a join comparable b on a.thing = b.thing and a.object_id < b.object_id where a.common > 0 and b.common > 0 and not {_APART.format('a.common', 'b.common')} and (a.recorded is null or b.recorded is null or {_APART.format('a.recorded', 'b.recorded')})",
    "p1_classes": _MEASURED.rstrip() + f""",
classes as (select thing, common, recorded, count(*) as n from comparable where thing is not null and common > 0 group by all),
met as (select a.thing, a.common as common_a, a.recorded as recorded_a, a.n as n_a, b.common as common_b, b.recorded as recorded_b, b.n as n_b, a.common = b.common and a.recorded is not distinct from b.recorded as same from classes a join classes b
  on a.thing = b.thing and (a.common < b.common or a.common = b.common and coalesce(a.recorded, '-inf'::double) <= coalesce(b.recorded, '-inf'::double))
  where not {_APART.format('a.common', 'b.common')} and (a.recorded is null or b.recorded is null or {_APART.format('a.recorded', 'b.recorded')}))
select *, cast(case when same then n_a * (n_a - 1) / 2 else n_a * n_b end as bigint) as n_pairs from met where not same or n_a > 1""",
    "p1_members": _MEASURED + "select * from comparable where thing is not null and common > 0",
    "p1_scales": _MEASURED + "select object_id, thing, recorded, value as ratio, unit as units from measured where not is_width",
    "p2_found": _ORPHANS + "select ref_field, src_id, target_handle from orph where reason is not null",
    "p2_by_month": _ORPHANS + "select ref_field, strftime(ref_at, '%Y-%m') as month, reason, count(*) as n_refs, count(distinct src_id) as n_records from orph where reason is not null group by all",
    "p3_found": _KEYS + "select field, key_text from prof where row_share >= 0.05",
    "p3_profile": _KEYS + "select * from prof",
    "p4_found": _TREE + "select entity_id from tree where in_cycle or recorded_depth <> depth",
    "p4_paths": _TREE + "select entity_id, path, handle, in_cycle, depth, root_handle, node_path from tree",
    "p4_descendants": _TREE.rstrip() + """,
pairs as (
  select path, handle, parent up, 1 distance from linked where parent is not null and (path, handle) in (select (path, handle) from walk)
  union all select p.path, p.handle, l.parent, p.distance + 1 from pairs p join linked l on l.path = p.path and l.handle = p.up where l.parent is not null)
select path, up as handle, handle as descendant_handle, distance from pairs""",
}
