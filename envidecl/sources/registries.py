"""Reference registries: indicators, unit groups, enumerations, category trees and field tables as small tables.

Each reader is a column expression over text or XML; what does not join is a table of problems, never a silent gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_cell

UUID = r"^[0-9a-fA-F-]{36}$"
#: Indicators that inventories carry as flows; all others are results of impact methods.
INVENTORY_CODES = ["PERE", "PERM", "PERT", "PENRE", "PENRM", "PENRT", "SM", "RSF", "NRSF", "FW", "HWD", "NHWD", "RWD", "CRU", "MFR", "MER", "EEE", "EET"]


def code_of(name: Column) -> Column:
    """The code in the parentheses at a name's end, up to a comma; null without one."""
    inner = F.regexp_extract(F.trim(name), r"\(([^()]*)\)\s*$", 1)
    return F.nullif(F.trim(F.split_part(inner, F.lit(","), F.lit(1))), F.lit(""))


def indicators(spark: SparkSession, path: str, profile: str, separator: str = ";") -> DataFrame:
    """uuid, code, kind, name, unit, profile of a CSV with columns uuid, name, unit; rows without a UUID are left out."""
    rows = spark.read.option("header", "true").option("sep", separator).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.strip().lstrip("﻿").lower() for c in rows.columns])
    code = code_of(F.col("name"))
    return rows.where(F.trim("uuid").rlike(UUID)).select(
        F.lower(F.trim("uuid")).alias("uuid"), code.alias("code"), F.when(code.isin(INVENTORY_CODES), "flow").otherwise("lcia").alias("kind"), clean_cell(F.col("name")).alias("name"), clean_cell(F.col("unit")).alias("unit"), F.lit(profile).alias("profile")
    )


def registry(lists: list[DataFrame]) -> DataFrame:
    """One row per uuid; profiles are gathered in the order of the lists, the first name and unit stay."""
    all_ = None
    for k, rows in enumerate(lists):
        rows = rows.withColumn("_k", F.lit(k))
        all_ = rows if all_ is None else all_.unionByName(rows)
    first = lambda c: F.min_by(c, "_k").alias(c)
    return all_.groupBy("uuid").agg(first("code"), first("kind"), first("name"), first("unit"), F.transform(F.array_sort(F.collect_set(F.struct("_k", "profile"))), lambda s: s["profile"]).alias("profiles"))


def registry_gaps(known: DataFrame, earlier: DataFrame) -> DataFrame:
    """Entries of an earlier registry that are gone or have another code."""
    gone = earlier.join(known, "uuid", "left_anti").select("uuid", "code", F.lit("missing").alias("problem"))
    other = earlier.alias("e").join(known.alias("k"), "uuid").where("e.code <> k.code").select("uuid", F.col("e.code").alias("code"), F.lit("code differs").alias("problem"))
    return gone.unionByName(other)


def _local(name: str) -> str:
    return f"*[local-name()='{name}']"


def unit_groups(files: DataFrame) -> DataFrame:
    """group_uuid, unit, factor, is_reference from unit group datasets in column ``xml``."""
    xml = F.col("xml")
    get = lambda path: F.xpath(xml, F.lit(path))
    unit = f"//{_local('units')}/{_local('unit')}"
    zipped = F.arrays_zip(get(f"{unit}/@dataSetInternalID").alias("id"), get(f"{unit}/{_local('name')}/text()").alias("unit"), get(f"{unit}/{_local('meanValue')}/text()").alias("factor"))
    ref = F.trim(F.get(get(f"//{_local('referenceToReferenceUnit')}/text()"), F.lit(0)))
    rows = files.select(F.lower(F.trim(F.get(get(f"//{_local('UUID')}/text()"), F.lit(0)))).alias("group_uuid"), ref.alias("_ref"), F.explode(zipped).alias("u"))
    return rows.select("group_uuid", F.trim("u.unit").alias("unit"), F.trim("u.factor").try_cast("double").alias("factor"), (F.trim("u.id") == F.col("_ref")).alias("is_reference")).where("unit <> '' AND factor IS NOT NULL")


def conversions(groups: DataFrame) -> DataFrame:
    """unit, factor and the reference unit of its group."""
    ref = groups.where("is_reference").select("group_uuid", F.col("unit").alias("reference_unit"))
    return groups.join(ref, "group_uuid").select("group_uuid", "unit", "factor", "reference_unit")


def enumerations(files: DataFrame) -> DataFrame:
    """type and value of the enumerations of schema files in column ``xml``."""
    blocks = F.filter(F.split("xml", r"(?=<(?:\w+:)?simpleType\s)"), lambda b: b.rlike(r"^<(?:\w+:)?simpleType\s[^>]*name="))
    rows = files.select(F.explode(blocks).alias("b"))
    return rows.select(F.regexp_extract("b", r"name=\"([^\"]+)\"", 1).alias("type"), F.posexplode(F.regexp_extract_all("b", F.lit(r"<(?:\w+:)?enumeration\s[^>]*value=\"([^\"]*)\""), 1)).alias("ord", "value"))


def category_paths(nodes: DataFrame, most_levels: int = 12) -> DataFrame:
    """id and full path of a tree of (id, parent, name); one join per level, as trees of categories are shallow."""
    level = nodes.where("parent IS NULL").select("id", F.col("name").alias("path"))
    out = level
    for _ in range(most_levels):
        level = nodes.select("id", "parent", "name").join(level.select(F.col("id").alias("parent"), "path"), "parent").select("id", F.concat_ws(" / ", "path", "name").alias("path"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def property_table(lines: DataFrame) -> DataFrame:
    """property, identifier, unit, comment of a Markdown table, one line in each row's ``value``."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.select(cells.alias("c")).where((F.size("c") >= 3) & ~F.startswith(F.get("c", F.lit(0)), F.lit("**")) & (F.get("c", F.lit(1)) != "") & ~F.get("c", F.lit(0)).rlike(r"^[- ]*$") & ~F.startswith(F.get("c", F.lit(1)), F.lit("---")))
    return rows.select(F.get("c", F.lit(0)).alias("property"), F.get("c", F.lit(1)).alias("identifier"), F.coalesce(F.nullif(F.get("c", F.lit(2)), F.lit("")), F.lit("-")).alias("unit"), F.replace(F.coalesce(F.get("c", F.lit(3)), F.lit("")), F.lit("<br>"), F.lit(" ")).alias("comment"))


def missing_fields(fields: DataFrame, table: DataFrame) -> DataFrame:
    """Paths that are wanted and not in the field table; flow dataset paths are exempt. Any row fails a build."""
    return fields.where(~F.startswith("path", F.lit("flowDataSet/"))).join(table.select("path"), "path", "left_anti")


def read_categories(spark: SparkSession, path: str, section: str = "material_categories") -> list[tuple]:
    """Categories of a JSON dictionary, as ``rules.classify`` takes them: a bounded table of rules, not of data.

    The section is a list of objects with id, parent, strong, weak, patterns and pcr_hints.
    """
    item = "struct<id:string,parent:string,strong:array<string>,weak:array<string>,patterns:array<string>,pcr_hints:array<string>>"
    text = spark.read.option("wholetext", "true").text(path)
    found = text.select(F.explode(F.from_json(F.get_json_object("value", f"$.{section}"), f"array<{item}>")).alias("c")).select("c.*")
    return [(r["id"], r["parent"], *(list(r[k] or []) for k in ("strong", "weak", "patterns", "pcr_hints"))) for r in found.collect()]


def read_section(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """Rows of any other list of a JSON dictionary, in its order."""
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.posexplode(F.from_json(F.get_json_object("value", f"$.{section}"), f"array<struct<{schema}>>")).alias("ord", "c")).select("ord", "c.*")
