"""Facts: long results from nested records, product stages, modes, pivots, merges and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import tables as D
from ..schemas import RESULT_COLUMNS, VALUE

KEY = ["epd_uid", "indicator", "module", "scenario"]


def flatten(records: DataFrame) -> DataFrame:
    """One row per indicator, module and scenario: plain modules first, then scenarios not seen yet."""
    each = records.select("epd_uid", F.explode("results").alias("indicator", "_i"))
    plain = F.transform(
        F.coalesce(F.map_entries("_i.modules"), F.array()), lambda e: F.struct(e["key"].alias("module"), F.coalesce(e["value"]["scenario"], F.lit("")).alias("scenario"), e["value"].alias("v"))
    )
    by_scenario = F.flatten(
        F.transform(
            F.coalesce(F.map_entries("_i.scenario_modules"), F.array()),
            lambda e: F.transform(F.map_entries(e["value"]), lambda s: F.struct(e["key"].alias("module"), s["key"].alias("scenario"), s["value"].alias("v"))),
        )
    )
    fresh = F.filter(by_scenario, lambda s: ~F.exists(plain, lambda p: (p["module"] == s["module"]) & (p["scenario"] == s["scenario"])))
    rows = each.select("epd_uid", "indicator", F.col("_i.canonical_unit").alias("unit"), F.inline(F.concat(plain, fresh)))
    value = {c: F.col(f"v.{c}") for c in ("value", "status", "raw_value", "raw_unit", "source_page", "source_table", "confidence", "extraction_method", "provenance")}
    return rows.select("epd_uid", "indicator", "module", "scenario", *[v.alias(k) for k, v in value.items()], "unit", F.coalesce("v.human_edited", F.lit(False)).alias("human_edited")).select(RESULT_COLUMNS)


def nest(facts: DataFrame, key: str = "epd_uid") -> DataFrame:
    """The key and results as records hold them: plain slots, and scenarios by module."""
    fields = [c.split(":") for c in VALUE.removeprefix("struct<").removesuffix(">").split(",")]
    held = lambda n: F.col(n) if n in RESULT_COLUMNS and n != "scenario" else F.when(F.col("scenario") != "", F.col("scenario")) if n == "scenario" else F.lit(None)
    rows = facts.withColumn("_v", F.struct(*[held(n).cast(k).alias(n) for n, k in fields]))
    pack = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    unit = F.max("unit").alias("_u")
    plain = rows.where("scenario = ''").groupBy(key, "indicator").agg(pack("module", "_v").alias("modules"), unit)
    by_module = rows.where("scenario <> ''").groupBy(key, "indicator", "module").agg(pack("scenario", "_v").alias("_m"), unit)
    other = by_module.groupBy(key, "indicator").agg(pack("module", "_m").alias("scenario_modules"), F.max("_u").alias("_w"))
    both = plain.join(other, [key, "indicator"], "full_outer")
    one = F.struct(F.lit(None).cast("string").alias("method_profile"), F.coalesce("_u", "_w").alias("canonical_unit"), "modules", "scenario_modules")
    return both.withColumn("_i", one).groupBy(key).agg(pack("indicator", "_i").alias("results"))


def product_stage(total: Column, a1: Column, a2: Column, a3: Column) -> Column:
    """struct(value, provenance): a reported total wins; a split counts only if it is complete."""
    parts = a1 + a2 + a3
    how = F.when(total.isNotNull(), "reported").when(parts.isNotNull(), "calculated_from_split")
    return F.struct(F.coalesce(total, parts).alias("value"), how.alias("provenance"))


def a1_a3_mode(total: Column, parts: Column) -> Column:
    """How a declaration reports the product stage; total and parts say what is there (parts: a count of 0 to 3)."""
    return (
        F.when(~total & (parts == 0), "none")
        .when(total & (parts == 0), "aggregate_only")
        .when(total & (parts == 3), "split_plus_reported_total")
        .when(parts == 3, "split_only")
        .otherwise("partial_split")
    )


def first_value() -> Column:
    """The first value of a slot that has several: the surest, then the earliest in the document, then the smallest."""
    order = F.struct(-F.coalesce("confidence", F.lit(1.0)), F.coalesce("source_page", F.lit(1 << 30)), F.col("value"))
    return F.min_by("value", F.when(F.col("value").isNotNull(), order))


def pivot_modules(facts: DataFrame, modules: list[str] | None = None) -> DataFrame:
    """Values of plain slots side by side, first not null; the list of modules is fixed, so the plan is too."""
    own = facts.where("scenario = ''")
    return own.groupBy("epd_uid", "indicator").pivot("module", modules or D.MODULES + ["A1-A3"]).agg(first_value())


def stages(facts: DataFrame, indicator: str = "GWP-total") -> DataFrame:
    p = pivot_modules(facts.where(F.col("indicator") == indicator), ["A1-A3", "A1", "A2", "A3", "C3", "C4", "A4", "A5", "D"])
    return p.withColumn("stage", product_stage(F.col("A1-A3"), F.col("A1"), F.col("A2"), F.col("A3")))


def compare(facts: DataFrame, declared: DataFrame) -> DataFrame:
    """The pivot with a warning where the chosen declarations have several declared units."""
    units = declared.agg((F.count_distinct("declared_unit") > 1).alias("units_differ"))
    return pivot_modules(facts).crossJoin(F.broadcast(units))


def merge(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Slots of both sides; the primary wins wherever it has the slot, even with a null value."""
    rest = secondary.join(primary.select(KEY).distinct(), KEY, "left_anti")
    return primary.unionByName(rest)


def retain(facts: DataFrame, codes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facts of the codes, and per declaration the sorted codes that were dropped."""
    kept = facts.where(F.col("indicator").isin(codes))
    dropped = facts.where(~F.col("indicator").isin(codes)).groupBy("epd_uid").agg(F.array_sort(F.collect_set("indicator")).alias("dropped_indicators"))
    return kept, dropped


def apply_edits(facts: DataFrame, edits: DataFrame) -> DataFrame:
    """New slots are human entries; changed ones keep the first extracted value in raw_value; null is not recorded."""
    e = edits.select(*KEY, F.col("value").alias("_new"), F.lit(True).alias("_edited"))
    both = facts.join(e, KEY, "full_outer")
    some = F.coalesce(F.col("_edited"), F.lit(False))
    both = both.withColumn("_changed", some & ~F.col("value").eqNullSafe(F.col("_new")))
    both = both.withColumn("_fresh", some & F.col("status").isNull() & F.col("extraction_method").isNull())
    changed, fresh = F.col("_changed"), F.col("_fresh")
    out = (
        both.withColumn("raw_value", F.when(changed & F.col("raw_value").isNull(), F.col("value").cast("string")).otherwise(F.col("raw_value")))
        .withColumn("status", F.when(changed & F.col("_new").isNull(), "not_recorded").when(changed, "declared").otherwise(F.col("status")))
        .withColumn("provenance", F.when(changed & fresh, "human_entered").when(changed, "human_edited").otherwise(F.col("provenance")))
        .withColumn("human_edited", F.coalesce(F.col("human_edited"), F.lit(False)) | changed)
        .withColumn("value", F.when(changed, F.col("_new")).otherwise(F.col("value")))
    )
    return out.select(RESULT_COLUMNS)


def reporting_helper(total: Column, a4: Column, a5: Column, c3: Column, c4: Column, service_life: Column, period: int = 50) -> Column:
    """struct: replacements, their impact (B4), the whole and per year; D and B6 never count."""
    n = F.greatest(F.lit(0), F.ceil(F.lit(float(period)) / service_life) - 1).cast("long")
    n = F.when(service_life > 0, n)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    b4 = F.when(total.isNotNull() & n.isNotNull(), n * (total + zero(c3) + zero(c4)))
    some = total.isNotNull() | a4.isNotNull() | a5.isNotNull() | c3.isNotNull() | c4.isNotNull()
    whole = F.when(some, zero(total) + zero(a4) + zero(a5) + zero(c3) + zero(c4) + zero(b4))
    names = F.array(*[F.when(c.isNull(), F.lit(m)) for m, c in (("A1-A3", total), ("A4", a4), ("A5", a5), ("C3", c3), ("C4", c4))])
    return F.struct(n.alias("replacements"), b4.alias("b4"), whole.alias("total"), (whole / period).alias("per_year"), F.array_compact(names).alias("missing"))


def module_frame(declared: DataFrame, facts: DataFrame, indicator: str = "GWP-total") -> DataFrame:
    """Every declaration on the spine of all modules, with scope, declaration and value; A1 to A3 inherit A1-A3's scope."""
    spark = facts.sparkSession
    scope = {**{m: D.MODULE_SCOPE["A1-A3"] for m in ("A1", "A2", "A3")}, **D.MODULE_SCOPE}
    spine = spark.createDataFrame([(k, m, scope.get(m)) for k, m in enumerate(["A1-A3", *D.MODULES])], "ord int, module string, scope string")
    ids = facts.select("epd_uid").distinct()
    values = facts.where((F.col("indicator") == indicator) & (F.col("scenario") == "")).groupBy("epd_uid", "module").agg(first_value().alias("value"))
    return ids.crossJoin(F.broadcast(spine)).join(declared, ["epd_uid", "module"], "left").join(values, ["epd_uid", "module"], "left")
