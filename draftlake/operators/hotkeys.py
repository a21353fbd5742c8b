"""Per-key results where a few keys hold most rows.

Fragment and replicate by load: keys are bin-packed to tasks, a key whose load
exceeds a task's share is split into proportionate shards, and the rows of the
matching side are replicated to just those shards.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.runtime import checkpoint


def pack(loads: list[tuple[object, int]], tasks: int) -> tuple[dict[object, list[int]], list[float]]:
    """Bins of each unit (several for a split one), and the load of each bin.

    Largest first onto the least loaded bin. A unit above the mean load per bin
    is split into equal shards of at most that load.
    """
    total = sum(n for _, n in loads)
    share = max(1.0, total / max(1, tasks))
    shards = []
    for unit, n in loads:
        k = max(1, math.ceil(n / share))
        shards += [(n / k, unit)] * k
    shards.sort(key=lambda s: (-s[0], str(s[1])))
    heap = [(0.0, b) for b in range(tasks)]
    bins: dict[object, list[int]] = {}
    filled = [0.0] * tasks
    for n, unit in shards:
        load, b = heapq.heappop(heap)
        bins.setdefault(unit, []).append(b)
        filled[b] = load + n
        heapq.heappush(heap, (filled[b], b))
    return bins, filled


class Layout:
    """Where the rows of each key go.

    Heavy keys are those with more than 1 / (4 * tasks) of all rows, so at most
    4 * tasks of them exist, whatever the data; they come to the driver and are
    broadcast as a table of at most 5 * tasks rows. Light keys are hashed into
    4 * tasks groups, which are packed as wholes and broadcast as a table of as
    many rows. `loads` is read three times: pass a written or checkpointed table.
    """

    def __init__(self, loads: DataFrame, keys: list[str], count: str, tasks: int):
        spark = loads.sparkSession
        self.keys, self.tasks, self.groups = keys, tasks, 4 * tasks
        self.total = loads.agg(F.sum(count)).first()[0] or 0
        floor = self.total / self.groups
        heavy = loads.filter(F.col(count) > floor).select(*keys, count).collect()
        light = loads.filter(F.col(count) <= floor).groupBy(self._group().alias("g")).agg(F.sum(count).alias("n")).collect()
        units = [(tuple(r[k] for k in keys), r[count]) for r in heavy] + [(r["g"], r["n"]) for r in light]
        bins, self.bin_loads = pack(units, tasks)
        rows = [(*key, len(bins[key]), bins[key]) for key in (tuple(r[k] for k in keys) for r in heavy)]
        types = dict(loads.dtypes)
        schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _n_shards int, _bins array<int>"
        self.heavy = spark.createDataFrame(rows, schema)
        self.light = spark.createDataFrame([(g, bins.get(g, [g % tasks])[0]) for g in range(self.groups)], "_group int, _light int")

    def _group(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.groups)).cast("int")

    def _with_bins(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.heavy), self.keys, "left").withColumn("_group", self._group()).join(F.broadcast(self.light), "_group")

    def _placed(self, df: DataFrame, shard: Column) -> DataFrame:
        out = df.withColumn("shard", shard).withColumn("bin", F.coalesce(F.element_at("_bins", F.col("shard") + 1), "_light"))
        return out.drop("_n_shards", "_bins", "_group", "_light")

    def fragment(self, df: DataFrame, by: Column) -> DataFrame:
        """`df` with columns shard and bin; rows of a heavy key are spread over its shards by `by`."""
        return self._placed(self._with_bins(df), F.coalesce(F.pmod(F.xxhash64(by), F.col("_n_shards").cast("long")).cast("int"), F.lit(0)))

    def replicate(self, df: DataFrame) -> DataFrame:
        """`df` with a copy of each row for every shard of its key, and the columns shard and bin."""
        return self._placed(self._with_bins(df), F.explode(F.sequence(F.lit(0), F.coalesce("_n_shards", F.lit(1)) - 1)))


def long_form(raw_objects: DataFrame, fields: list[str], *columns: str) -> DataFrame:
    """A row (field, key_text, *columns) for each field of each row, null values included."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key_text")) for f in fields])
    return raw_objects.select(*columns, F.explode(pairs).alias("k")).select("k.field", "k.key_text", *columns)


def key_profile(raw_objects: DataFrame, fields: list[str], tasks: int) -> DataFrame:
    """Per (field, key_text): n_rows, row_share, n_objects, n_bytes, n_drawings.

    n_rows counts repeated rows; row_share is its part of all rows, those with a
    null key included. An object under several paths is one object; its bytes
    count once in each path, with the largest recorded size, a null size as 0. A
    null id is no object and a null path no drawing. An empty table gives no
    rows. Two scans: the first counts rows and drawings of each key, combined
    before its shuffle; the second places the objects by these loads, whose rows
    are replicated to the shards of their key and meet the objects there, after
    one shuffle by bin.
    """
    counted = long_form(raw_objects, fields, "path").groupBy("field", "key_text", "path").agg(F.count("*").alias("n"))
    loads = checkpoint(counted.groupBy("field", "key_text").agg(F.sum("n").alias("n_rows"), F.count("path").alias("n_drawings")))
    total = loads.filter(F.col("field") == fields[0]).agg(F.sum("n_rows")).first()[0] or 0
    loads = loads.filter("key_text is not null")
    layout = Layout(loads, ["field", "key_text"], "n_rows", tasks)
    rows = long_form(raw_objects, fields, "object_id", "path", "size_bytes").filter("key_text is not null")
    facts = layout.fragment(rows, F.col("object_id"))
    placed = facts.unionByName(layout.replicate(loads), allowMissingColumns=True).repartitionById(tasks, F.col("bin"))
    shard = ["bin", "shard", "field", "key_text"]
    per_path = placed.groupBy(*shard, "object_id", "path").agg(F.max("size_bytes").alias("size_bytes"), F.max("n_rows").alias("n_rows"), F.max("n_drawings").alias("n_drawings"))
    # all rows of an object are in one shard of its key, so these are whole objects
    objects = per_path.groupBy(*shard, "object_id").agg(F.sum(F.coalesce("size_bytes", F.lit(0))).alias("n_bytes"), F.max("n_rows").alias("n_rows"), F.max("n_drawings").alias("n_drawings"))
    return (
        objects.groupBy("field", "key_text")
        .agg(F.max("n_rows").alias("n_rows"), F.count("object_id").alias("n_objects"), F.sum("n_bytes").alias("n_bytes"), F.max("n_drawings").alias("n_drawings"))
        .withColumn("row_share", F.col("n_rows") / F.lit(float(max(1, total))))
        .select("field", "key_text", "n_rows", "row_share", "n_objects", "n_bytes", "n_drawings")
    )
