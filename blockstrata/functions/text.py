"""Text, number and key-value helpers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r"


def to_number(x: Column) -> Column:
    """A double, null where the text is none."""
    return x.try_cast("double")


def is_numeric(x: Column) -> Column:
    return to_number(x).isNotNull()


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def index_of(x: Column, part: str) -> Column:
    """Where a part begins, from 0; null where it is not."""
    return F.nullif(F.instr(x, part), F.lit(0)) - 1


def same_text(a: Column, b: Column) -> Column:
    """Equal but for case."""
    return F.lower(a) == F.lower(b)


def int_text(x: Column) -> Column:
    return x.cast("long").cast("string")


def checksum_ok(block: Column, crc: Column) -> Column:
    """Whether a checksum stands for what it covers; 0 stands for none."""
    return (crc == 0) | (F.crc32(block) == crc)


def pairs(x: Column, between: str = "&", equals: str = "=") -> Column:
    """``a=1&b=2`` as an array of (name, value), in order, names repeated as they are; no sign means an empty value."""
    part = lambda p: F.struct(F.trim(F.substring_index(p, equals, 1)).alias("name"), F.when(F.instr(p, equals) > 0, F.trim(F.substr(p, F.instr(p, equals) + F.lit(len(equals))))).otherwise("").alias("value"))
    return F.transform(F.filter(F.split(x, "\\Q" + between + "\\E"), lambda p: F.trim(p) != ""), part)


def relation_value(x: Column, name: str) -> Column:
    """The first value of a name; null where there is none."""
    return F.get(F.filter(x, lambda p: p["name"] == name), F.lit(0))["value"]


def relation_set(x: Column, name: str, value: Column) -> Column:
    """The name's first value replaced, or the pair appended."""
    has = F.exists(x, lambda p: p["name"] == name)
    first = F.array_position(F.transform(x, lambda p: p["name"]), name)
    replaced = F.transform(x, lambda p, i: F.when(i == first - 1, F.struct(p["name"].alias("name"), value.alias("value"))).otherwise(p))
    return F.when(has, replaced).otherwise(F.concat(x, F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))))


def relation_delete(x: Column, name: str) -> Column:
    return F.filter(x, lambda p: p["name"] != name)


def relation_merge(x: Column, other: Column) -> Column:
    """Both, with this one's value where both have a name."""
    names = F.transform(x, lambda p: p["name"])
    return F.concat(x, F.filter(other, lambda p: ~F.array_contains(names, p["name"])))


def relation_int(x: Column, name: str) -> Column:
    return relation_value(x, name).try_cast("long")


def relation_float(x: Column, name: str) -> Column:
    return relation_value(x, name).try_cast("double")


def quoted(x: Column) -> Column:
    """What stands between the first two quotes of one kind."""
    return F.coalesce(F.nullif(F.regexp_extract(x, '"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(x, "'([^']*)'", 1), F.lit("")))


def tag_name(x: Column) -> Column:
    """The name in ``<name ...`` or ``</name>``."""
    return F.nullif(F.regexp_extract(x, r"<\s*/?\s*([A-Za-z_:][\w:.-]*)", 1), F.lit(""))


def leading_number(x: Column) -> Column:
    """The number at the start of a text."""
    return F.regexp_extract(x, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def interned(rows: DataFrame, column: str) -> DataFrame:
    """Distinct texts with how often each occurs."""
    return rows.groupBy(column).agg(F.count("*").alias("uses"))


def exported(dims: list[tuple[str, bool]], digits: int = 15) -> Column:
    """Tab-separated text of a row: numbers with so many digits behind the point, binary as hexadecimal, null as nothing."""
    parts = [F.lower(F.hex(c)) if binary else F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))) for c, binary in dims]
    return F.concat_ws("\t", *(F.coalesce(p, F.lit("")) for p in parts))
