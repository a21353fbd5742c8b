"""Tagged text of drawings: rows (path, seq, pair, code, value), in that order one pair after the other.

Nothing is gathered: a drawing's pairs are rows that are sorted when written.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Version names of the text format.
VERSIONS = {"R12": "AC1009", "R14": "AC1014", "R2000": "AC1015", "R2004": "AC1018", "R2007": "AC1021", "R2010": "AC1024", "R2013": "AC1027", "R2018": "AC1032"}
#: The sections and where their pairs stand.
HEADER, TABLES, BLOCKS, ENTITIES, OBJECTS, END = range(6)
#: First and last place in a section, around every handle.
FIRST, LAST = -(2**63), 2**63 - 1


def version_name(text: str) -> str:
    """The version a user means: trimmed, in upper case, by name or by magic."""
    t = text.strip().upper()
    if t in VERSIONS.values():
        return t
    if t not in VERSIONS:
        raise ValueError(f"no version {text!r}")
    return VERSIONS[t]


def real(v: Column) -> Column:
    """Sixteen decimals of the exact binary value, where a format string would print zeros behind the shortest form."""
    size = F.abs(v)
    whole = F.floor(size)
    high = F.floor((size - whole) * 2.0**26)
    low = F.floor(((size - whole) * 2.0**26 - high) * 2.0**26)
    # 10**16 / 2**26 and 10**16 / 2**52
    units = F.round(high.cast("decimal(9,0)") * F.lit(Decimal("149011611.9384765625")) + low.cast("decimal(9,0)") * F.lit(Decimal("2.220446049250313080847263")), 0).cast("bigint")
    carry = units >= 10**16
    text = F.concat((whole + carry.cast("bigint")).cast("string"), F.lit("."), F.lpad(F.when(carry, F.lit(0).cast("bigint")).otherwise(units).cast("string"), 16, "0"))
    return F.when(size < 2.0**52, F.concat(F.when(v < 0, "-").otherwise(""), text)).otherwise(F.format_string("%.16f", v))


def handle(v: Column) -> Column:
    return F.hex(v)


def pair(code: int, value: Column | str) -> Column:
    v = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.struct(F.lit(code).alias("code"), v.alias("value"))


def point_pairs(code: int, p: Column, three: bool = True) -> list[Column]:
    return [pair(code + 10 * i, real(p[k])) for i, k in enumerate("xyz" if three else "xy")]


def _degrees(v: Column) -> Column:
    return v * (180.0 / math.pi)


def entity_pairs(kind: Column, rec: dict[str, Column], layer: Column, handle_: Column, version: str = "AC1032") -> Column:
    """Pairs of an entity, null for a kind without a text form. rec has a struct column per kind."""
    marked = version != "AC1009"

    def head(name: str, mark: str) -> list[Column]:
        subclass = [pair(100, "AcDbEntity")] if marked else []
        return [pair(0, name), pair(5, handle(handle_)), *subclass, pair(8, layer), *([pair(100, mark)] if marked else [])]

    forms = {
        "LINE": lambda e: F.array(*head("LINE", "AcDbLine"), *point_pairs(10, e["start"]), *point_pairs(11, e["end"])),
        "CIRCLE": lambda e: F.array(*head("CIRCLE", "AcDbCircle"), *point_pairs(10, e["center"]), pair(40, real(e["radius"]))),
        "ARC": lambda e: F.array(
            *head("ARC", "AcDbCircle"), *point_pairs(10, e["center"]), pair(40, real(e["radius"])), *([pair(100, "AcDbArc")] if marked else []), pair(50, real(_degrees(e["start_angle"]))), pair(51, real(_degrees(e["end_angle"])))
        ),
        "POINT": lambda e: F.array(*head("POINT", "AcDbPoint"), *point_pairs(10, e["position"])),
        "LWPOLYLINE": lambda e: F.concat(
            F.array(*head("LWPOLYLINE", "AcDbPolyline"), pair(90, F.size(e["vertices"])), pair(70, F.when(e["closed"], "1").otherwise("0"))),
            F.flatten(F.transform(e["vertices"], lambda v: F.array(pair(10, real(v["x"])), pair(20, real(v["y"]))))),
        ),
    }
    return F.coalesce(*[F.when(kind == k, forms[k](e)) for k, e in rec.items() if k in forms])


def entity_rows(df: DataFrame, pairs: Column, order: str = "seq") -> DataFrame:
    """One row per pair of each entity; entities without a text form are left to `skipped`."""
    return df.select("path", F.lit(ENTITIES).alias("section"), F.col(order).cast("bigint").alias("seq"), F.posexplode(pairs).alias("pair", "p")).select("path", "section", "seq", "pair", "p.code", "p.value")


def skipped(df: DataFrame, pairs: Column) -> DataFrame:
    """How many entities of each kind have no text form, per drawing."""
    return df.filter(pairs.isNull()).groupBy("path", "kind").agg(F.count("*").alias("n"))


def comment_rows(skipped_: DataFrame) -> DataFrame:
    """A comment per kind without a text form, in the order of the kinds, at the head of the entities."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda k: F.concat(F.lit("skipped: "), k["kind"], F.lit(" x"), k["n"].cast("string")))
    lines = skipped_.groupBy("path").agg(listed.alias("lines")).select("path", F.posexplode("lines").alias("pair", "value"))
    return lines.select("path", F.lit(ENTITIES).alias("section"), F.lit(FIRST + 1).cast("bigint").alias("seq"), "pair", F.lit(999).alias("code"), "value")


def layer_pairs(name: Column, color: Column, frozen: Column, linetype: Column) -> Column:
    """Pairs of a layer; a frozen one has a negative colour, and layer 0 is always white."""
    aci = F.when(name == "0", 7).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), color.cast("int"))))
    return F.array(pair(0, "LAYER"), pair(2, name), pair(70, F.when(frozen, "1").otherwise("0")), pair(62, F.when(frozen, -aci).otherwise(aci)), pair(6, F.when(F.coalesce(linetype, F.lit("")) == "", "CONTINUOUS").otherwise(linetype)))


def frame_rows(paths: DataFrame, version: str = "AC1032") -> DataFrame:
    """The fixed pairs around a drawing's own: header, table and section starts and ends."""
    rows = [
        (HEADER, 0, [(0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, version), (0, "ENDSEC")]),
        (TABLES, 0, [(0, "SECTION"), (2, "TABLES"), (0, "TABLE"), (2, "LAYER")]),
        (TABLES, LAST, [(0, "ENDTAB"), (0, "ENDSEC")]),
        (BLOCKS, 0, [(0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "*Model_Space"), (0, "ENDBLK"), (0, "ENDSEC")]),
        (ENTITIES, FIRST, [(0, "SECTION"), (2, "ENTITIES")]),
        (ENTITIES, LAST, [(0, "ENDSEC")]),
        *([(OBJECTS, 0, [(0, "SECTION"), (2, "OBJECTS"), (0, "ENDSEC")])] if version != "AC1009" else []),
        (END, 0, [(0, "EOF")]),
    ]
    fixed = [F.struct(F.lit(s).alias("section"), F.lit(q).cast("bigint").alias("seq"), F.lit(i).alias("pair"), F.lit(c).alias("code"), F.lit(v).alias("value")) for s, q, ps in rows for i, (c, v) in enumerate(ps)]
    return paths.select("path").distinct().select("path", F.explode(F.array(*fixed)).alias("f")).select("path", "f.*")


def write(rows: DataFrame, folder: str) -> None:
    """A folder per drawing with its lines in order: drawings are spread, pairs of one sorted within its task."""
    lines = rows.withColumn("line", F.concat(F.lpad(F.col("code").cast("string"), 3, " "), F.lit("\n"), "value"))
    placed = lines.repartition("path").sortWithinPartitions("path", "section", "seq", "pair")
    placed.select("path", "line").write.partitionBy("path").text(folder)
