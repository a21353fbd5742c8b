"""Filters, joins, aggregates and windows over drawing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions.text import block_space
from draftlake.runtime import checkpoint, shuffle_partitions

#: Error messages kept for a report; the rest is counted.
KEPT_MESSAGES = 1000

# Filters and projections


def in_block(df: DataFrame, owner: str, name: str) -> DataFrame:
    """Rows whose owner is the block of exactly that name."""
    return df.filter(F.col(owner) == name)


def in_space(df: DataFrame, owner: str, space: str) -> DataFrame:
    """Rows of the model, paper or custom blocks."""
    return df.filter(block_space(F.col(owner)) == space)


def membership(owner: Column) -> Column:
    """struct(kind, name): the name only for paper and custom blocks."""
    kind = block_space(owner)
    return F.struct(kind.alias("kind"), F.when(kind != "model", owner).alias("name"))


def plausible(v: Column, most: float = 1e12) -> Column:
    """Finite and below a band; null and NaN are not."""
    return F.coalesce(~F.isnan(v) & (F.abs(v) < most), F.lit(False))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, nulls last and ties by the other columns; a minimum, so rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.struct(c.isNull().alias("n"), c.alias("v")).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row"))
    return df.groupBy(*keys).agg(F.min(by)["row"].alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


# Joins


def page_offsets(sections: DataFrame, section_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections with the file offset of their first page, 0 where there is none; gap pages don't count."""
    first = section_pages.groupBy("path", F.col("section_name").alias("name")).agg(F.min_by("page_number", "start_offset").alias("number"))
    there = pages.filter("not is_gap").groupBy("path", F.col("number").cast("bigint").alias("number")).agg(F.min("file_offset").alias("file_offset"))
    return sections.join(first.join(there, ["path", "number"], "left").select("path", "name", "file_offset"), ["path", "name"], "left").withColumn("file_offset", F.coalesce("file_offset", F.lit(0).cast("bigint")))


def referenced(child: DataFrame, parent: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matched rows, references without a parent)."""
    unique = parent.dropDuplicates(keys)
    return child.join(unique, keys), child.join(unique.select(*keys), keys, "left_anti")


def by_handle(entries: DataFrame, objects: DataFrame, kind: str | None = None) -> DataFrame:
    """Index entries with their object, the first entry of a handle; `kind` keeps the entry but drops objects of another kind."""
    first = first_of(entries.filter("handle is not null").select("path", "handle", "seq", "stream_offset"), ["path", "handle"], [F.col("seq"), F.col("stream_offset")])
    on = (F.col("e.path") == F.col("o.path")) & (F.col("e.handle") == F.col("o.value"))
    if kind is not None:
        on = on & (F.col("o.kind") == kind)
    slim = objects.select("path", F.col("handle.value").alias("value"), "object_id", "kind", "status")
    return first.alias("e").join(slim.alias("o"), on, "left").select("e.path", "e.handle", "e.seq", "o.object_id", "o.kind", "o.status")


def with_classes(objects: DataFrame, classes: DataFrame) -> DataFrame:
    """Objects of custom codes with the class of their file, the first of a number by its names."""
    first = classes.groupBy("path", F.col("class_number").alias("type_code")).agg(F.min(F.struct("dxf_class_name", "cpp_class_name")).alias("c")).select("path", "type_code", "c.*")
    return objects.join(first, ["path", "type_code"], "left")


# Aggregates


def outcome(status: Column) -> Column:
    """decoded, unhandled or errored."""
    return F.when(status == "ok", "decoded").when(status.isin("skipped", "unhandled", "erased"), "unhandled").otherwise("errored")


def coverage(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Counts by outcome, total and the decoded part (0 for none), per keys."""
    o = outcome(F.col(status))
    count = lambda v: F.count_if(o == v)
    g = rows.groupBy(*keys) if keys else rows.groupBy()
    out = g.agg(count("decoded").alias("decoded"), count("unhandled").alias("unhandled"), count("errored").alias("errored"), F.count("*").alias("total"))
    return out.withColumn("decoded_ratio", F.coalesce(F.try_divide(F.col("decoded").cast("double"), F.col("total")), F.lit(0.0)))


def kept_messages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many messages each group has, keeps and leaves out; the kept ones are the first in order (`first_messages`)."""
    n = F.count("*")
    return rows.filter("reason is not null").groupBy(*keys).agg(n.alias("errors"), F.greatest(n - KEPT_MESSAGES, F.lit(0)).alias("suppressed"), F.least(n, F.lit(KEPT_MESSAGES)).alias("kept"))


def first_messages(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The messages that a report of a fixed length keeps."""
    return ends_of(rows.filter("reason is not null"), keys, order, KEPT_MESSAGES, 0)


def walk_confidence(decoded: Column, skipped: Column, errored: Column) -> Column:
    """Decoded part of all; 1 for nothing at all."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(decoded.cast("double"), decoded + skipped + errored), F.lit(1.0))))


def read_confidence(total: Column, skipped: Column, failed: Column, warnings: Column, partial: Column) -> Column:
    """Part of the total without any finding; 1 for a total of 0."""
    clean = F.greatest(total - (skipped + failed + warnings + partial), F.lit(0))
    return F.coalesce(F.try_divide(clean.cast("double"), total), F.lit(1.0))


def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def top(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n most frequent keys, ties by key."""
    return histogram(rows, key).orderBy(F.desc("n"), F.asc_nulls_last(key)).limit(n)


def totals(rows: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """Sums per key and over all, the latter under a null key with is_total."""
    aggs = [F.sum(c).alias(c) for c in sums]
    return rows.rollup(key).agg(F.grouping(key).cast("boolean").alias("is_total"), F.count("*").alias("n"), *aggs)


class Ranges:
    """Rows in ranges of (keys, order), so that a hot key is sorted and summed in several tasks.

    Ranges are cut by a sample of the rows, equal rows lie in one, and their
    number follows the rows; each range knows what the ranges of its key before
    it sum up to, or end with.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[Column]):
        tasks = shuffle_partitions(rows.sparkSession)
        self.keys, self.order = keys, order
        self.rows = checkpoint(rows.repartitionByRange(tasks, *keys, *order).withColumn("_range", F.spark_partition_id()))
        self.within = Window.partitionBy("_range", *keys).orderBy(*order)
        # one row for each range of a key
        self.before = Window.partitionBy(*keys).orderBy("_range")

    def _join(self, facts: DataFrame) -> DataFrame:
        on = [F.col(f"l.{k}").eqNullSafe(F.col(f"f.{k}")) for k in ("_range", *self.keys)]
        named = self.rows.alias("l").join(facts.alias("f"), reduce(Column.__and__, on), "left")
        return named.select("l.*", "f._fact")

    def summed(self, value: str, inclusive: bool) -> DataFrame:
        """The rows with _sum: of all values before in their key, and with their own where inclusive."""
        sums = self.rows.groupBy("_range", *self.keys).agg(F.sum(value).alias("_own"))
        facts = sums.withColumn("_fact", F.sum("_own").over(self.before.rowsBetween(Window.unboundedPreceding, -1))).drop("_own")
        own = F.sum(value).over(self.within.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
        return self._join(facts).withColumn("_sum", F.coalesce(own, F.lit(0)) + F.coalesce("_fact", F.lit(0))).drop("_range", "_fact")

    def lagged(self, value: str) -> DataFrame:
        """The rows with _lag: the value of the row before in their key."""
        last = self.rows.groupBy("_range", *self.keys).agg(F.max_by(value, F.struct(*[F.struct(c.isNotNull().alias("n"), c.alias("v")).alias(f"o{i}") for i, c in enumerate(self.order)])).alias("_own"))
        facts = last.withColumn("_fact", F.lag("_own").over(self.before)).drop("_own")
        return self._join(facts).withColumn("_lag", F.coalesce(F.lag(value).over(self.within), "_fact")).drop("_range", "_fact")


def running_offset(rows: DataFrame, keys: list[str], order: list[Column], size: str, base: int) -> DataFrame:
    """The place of each piece behind all before it in its group; rows that are equal in the order count in any order."""
    return Ranges(rows, keys, order).summed(size, False).withColumn("offset", F.lit(base) + F.col("_sum")).drop("_sum")


def deltas(rows: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Difference to the row before, the first to 0."""
    return Ranges(rows, keys, order).lagged(value).withColumn("delta", F.col(value) - F.coalesce("_lag", F.lit(0))).drop("_lag")


def undelta(rows: DataFrame, keys: list[str], order: list[Column], delta: str = "delta") -> DataFrame:
    return Ranges(rows, keys, order).summed(delta, True).withColumnRenamed("_sum", "value")


#: Parts of a group that are cut to their ends before the group is.
SALTS = 32


def ends_of(rows: DataFrame, keys: list[str], order: list[str], head: int, tail: int) -> DataFrame:
    """The first `head` and last `tail` rows of each group in ascending order, nulls first.

    Groups are split by a hash of the order; what is at neither end of its part
    is at no end of the group, so no task sorts a large group.
    """

    def cut(df: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by)
        up = F.row_number().over(w.orderBy(*[F.asc(c) for c in order]))
        numbered = df.withColumn("_u", up).withColumn("_n", F.count("*").over(w))
        return numbered.filter((F.col("_u") <= head) | (F.col("_u") > F.col("_n") - tail)).drop("_u", "_n")

    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    return cut(cut(salted, [*keys, "_salt"]), keys).drop("_salt")


def head_and_tail(rows: DataFrame, keys: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The first and last n rows of each group."""
    return ends_of(rows, keys, order, n, n)


def capped(rows: DataFrame, most: int) -> DataFrame:
    """The rows, or an error when there are more: nothing is dropped in silence."""
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows")
    return rows


def assert_known(objects: DataFrame) -> DataFrame:
    """The objects, or an error that names one of an unknown kind."""
    bad = objects.filter("type_class = 'unknown'").select("path", "type_code").head(1)
    if bad:
        raise ValueError(f"unknown type {bad[0]['type_code']} in {bad[0]['path']}")
    return objects


def prefer(full: DataFrame, stub: DataFrame, keys: list[str]) -> DataFrame:
    """All of the full list, and what only the stub has."""
    return full.unionByName(stub.join(full.select(*keys).distinct(), keys, "left_anti"))
