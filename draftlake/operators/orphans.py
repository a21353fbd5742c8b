"""References to records that do not exist.

Parents and references are united in one tagged long table and grouped by key
in one shuffle (with map-side combine); groups without a sound parent are kept
and joined back to their references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HANDLE_MAP = "handle_map.handle"
LAYOUT = "acad_layout.block_record_handle"
GROUP = "acad_group.member_handles"
LOFT = "lofted_surface.cross_section_handles"

#: A parent loaded more than this many microseconds after the reference is late.
LATE_US = 24 * 3600 * 1_000_000


def absolute_handle(ref: Column, own: Column) -> Column:
    """The absolute target of a typed handle, null where it refers to nothing.

    Codes 6 and 8 name the neighbours of the record's own handle, 10 and 12 are
    offsets from it; every other code holds the target, 0 meaning none. A null
    struct, code or value (where it is needed), or own handle gives null.
    """
    code, value = ref["code"], ref["value"]
    return (
        F.when(code == 6, own + 1)
        .when(code == 8, own - 1)
        .when(code == 10, own + value)
        .when(code == 12, own - value)
        .when(code.isNotNull() & (value != 0), value)
    )


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def references(handle_map: DataFrame, decoded: DataFrame) -> DataFrame:
    """Every reference once: (path, target_handle, ref_field, src_id, ref_us).

    `ref_us` is the earliest load time of the referring record. Repeated
    deliveries and repeated members collapse; null targets are dropped.
    """
    index = handle_map.select("path", F.col("handle").alias("target_handle"), F.lit(HANDLE_MAP).alias("ref_field"), F.col("entry_id").alias("src_id"), _micros(F.col("loaded_at")).alias("us"))
    own = F.col("handle")
    one = lambda field, ref: F.struct(F.lit(field).alias("ref_field"), absolute_handle(ref, own).alias("target_handle"))
    many = lambda field, refs: F.coalesce(F.transform(refs, lambda h: one(field, h)), F.array().cast("array<struct<ref_field:string,target_handle:bigint>>"))
    linked = (
        decoded.filter(F.col("acad_layout").isNotNull() | F.col("acad_group").isNotNull() | F.col("lofted_surface").isNotNull())
        .select(
            "path",
            F.col("object_id").alias("src_id"),
            _micros(F.col("loaded_at")).alias("us"),
            F.explode(
                F.concat(
                    F.array(one(LAYOUT, F.col("acad_layout.block_record_handle"))),
                    many(GROUP, F.col("acad_group.member_handles")),
                    many(LOFT, F.col("lofted_surface.cross_section_handles")),
                )
            ).alias("r"),
        )
        .select("path", "r.target_handle", "r.ref_field", "src_id", "us")
    )
    return (
        index.unionByName(linked)
        .filter(F.col("target_handle").isNotNull() & F.col("path").isNotNull())
        .groupBy("path", "target_handle", "ref_field", "src_id")
        .agg(F.min("us").alias("ref_us"))
    )


def orphan_references(handle_map: DataFrame, decoded: DataFrame, raw_objects: DataFrame) -> DataFrame:
    """Every reference without a sound parent, with the reason.

    Columns: path, ref_field, src_id, target_handle, ref_us, reason ('missing',
    'erased' or 'late'). A parent is erased if its latest delivery is (of two at
    the same time the erased one counts as later), late if first delivered more
    than 24 hours after the reference. Empty inputs give no rows. References
    without a load time are never late. A key that holds a third of all
    references is combined map-side before the grouping shuffle; in the join
    back, where the key side is unique, the skew-join split of the adaptive
    execution divides it.
    """
    refs = references(handle_map, decoded)
    parents = raw_objects.select(
        "path",
        F.col("handle.value").alias("target_handle"),
        _micros(F.col("loaded_at")).alias("us"),
        (F.col("status") == "erased").cast("long").alias("erased"),
    ).filter(F.col("target_handle").isNotNull() & F.col("path").isNotNull())
    null = F.lit(None).cast("long")
    tagged = refs.select("path", "target_handle", F.lit(1).alias("is_ref"), F.lit(0).alias("is_parent"), "ref_us", null.alias("first_us"), null.alias("last")).unionByName(
        parents.select(
            "path", "target_handle", F.lit(0).alias("is_ref"), F.lit(1).alias("is_parent"), null.alias("ref_us"), F.col("us").alias("first_us"),
            # time and state in one number, so that the aggregate stays a hash aggregate
            (F.coalesce("us", F.lit(0)) * 2 + F.coalesce("erased", F.lit(0))).alias("last"),
        )
    )
    keys = (
        tagged.groupBy("path", "target_handle")
        .agg(F.max("is_ref").alias("has_ref"), F.max("is_parent").alias("has_parent"), F.min("ref_us").alias("min_ref"), F.min("first_us").alias("first_us"), F.max("last").alias("last"))
        .withColumn("erased", F.coalesce(F.col("last") % 2 == 1, F.lit(False)))
        .filter((F.col("has_ref") == 1) & ((F.col("has_parent") == 0) | F.col("erased") | (F.col("first_us") > F.col("min_ref") + LATE_US)))
        .select("path", "target_handle", "has_parent", "erased", "first_us")
    )
    reason = F.when(F.col("has_parent") == 0, "missing").when(F.col("erased"), "erased").when(F.col("first_us") > F.col("ref_us") + LATE_US, "late")
    return refs.join(keys, ["path", "target_handle"]).withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("path", "ref_field", "src_id", "target_handle", "ref_us", "reason")


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """Counts per referring field, month of the referring record and reason."""
    # days since 1970, so that no time zone plays a part
    month = F.left(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ref_us") / 86_400_000_000).cast("int")).cast("string"), F.lit(7))
    return orphans.groupBy("ref_field", month.alias("month"), "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("src_id").alias("n_records"))
