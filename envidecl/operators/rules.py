"""Rule tables met with records: material categories, the checklist, and quality checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import tables as D
from ..functions.domain import data_specificity, electricity_mix, match_operators, profile_family, standard_profile, waste_context
from ..functions.dates import parse_date, validity
from ..functions.units import parse_declared_unit, unit_key
from .results import first_value, pivot_modules, product_stage, reporting_helper

REPEATS_IN_FULL_TEXT = 5
#: Characters of the text that operators are looked for in, and of the classifier's fields.
HEAD, COVER, BODY = 6000, 3000, 60_000
#: Hits that evidence keeps, fields that hints are looked for in, and fields that name a product.
EVIDENCE = 12
HINTED = ("pcr", "product_category", "ilcd_classification")
NAMING = ("product_name", "ilcd_classification")


def _escape(word: str) -> str:
    return re.sub(r"([.^$*+?{}\[\]\\|()/])", r"\\\1", word)


def _rules(categories: list[tuple] | None = None) -> list[tuple]:
    """ord, category, parent, kind, pattern, weight, word of every keyword, pattern and hint."""
    out = []
    for k, (cat, parent, strong, weak, patterns, hints) in enumerate(categories or D.CATEGORIES):
        for kind, words in (("strong", strong), ("weak", weak)):
            for w in dict.fromkeys(x.lower() for x in words):
                out.append((k, cat, parent, kind, rf"(?Ui)(?<![\w-]){_escape(w)}(?!\w)", D.KEYWORD_WEIGHTS[kind], w))
        out += [(k, cat, parent, "pattern", f"(?U){p}", D.KEYWORD_WEIGHTS["pattern"], p) for p in patterns]
        share = D.KEYWORD_WEIGHTS["pcr_hint"] / max(1, len(hints) // 2)
        out += [(k, cat, parent, "pcr_hint", rf"(?i){_escape(h)}", share, h) for h in hints]
    return out


def category_fields(records: DataFrame) -> DataFrame:
    """epd_uid, field, weight, text of the seven weighted fields."""
    text = {
        "ilcd_classification": F.col("metadata.ilcd_classification"),
        "product_name": F.col("metadata.product_name"),
        "pcr": F.col("metadata.pcr"),
        "product_category": F.col("metadata.product_category"),
        "product_description": F.col("metadata.product_description"),
        # The first page, where form feeds part pages.
        "cover_text": F.left(F.split_part(F.col("full_text"), F.lit("\f"), F.lit(1)), F.lit(COVER)),
        "full_text": F.left(F.col("full_text"), F.lit(BODY)),
    }
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(w).alias("weight"), text[k].alias("text")) for k, w in D.FIELD_WEIGHTS.items()])
    return records.select("epd_uid", F.inline(fields)).where(F.length("text") > 0)


def _first_word(word: str) -> str:
    """The word that a text must hold for a keyword to be in it, or none if the keyword does not begin with one."""
    found = re.match(r"\w+", word)
    return found[0] if found else ""


def category_hits(fields: DataFrame, categories: list[tuple] | None = None) -> DataFrame:
    """epd_uid, field, category, ord, parent, kind, word, n, points (of one hit): what counts for each category.

    A word inside a longer hit of another category does not count. A word counts once in a field, five times in the full text; of a
    category's hints the best one of a field counts.

    Rules are a fixed list of a few hundred, broadcast. A text meets those keywords whose first word it has: its words are matched
    with all first words at once, and only what is left is searched for. Patterns and hints are few and are searched for everywhere.
    """
    spark = fields.sparkSession
    rows = [(*r, _first_word(r[6]) if r[3] in ("strong", "weak") else "") for r in _rules(categories)]
    rules = F.broadcast(spark.createDataFrame(rows, "ord int, category string, parent string, kind string, pattern string, w double, word string, _first string"))
    firsts = F.array(*[F.lit(x) for x in sorted({r[-1] for r in rows} - {""})]).cast("array<string>")
    low = fields.withColumn("_low", F.lower("text"))
    held = low.withColumn("_first", F.explode(F.array_append(F.array_intersect(F.split("_low", r"(?U)\W+"), firsts), "")))
    hinted = (F.col("kind") != "pcr_hint") | F.col("field").isin(*HINTED)
    pairs = held.join(rules, "_first").where(((F.col("kind") == "pattern") | F.contains(F.col("_low"), F.lower("word"))) & hinted)
    hits = pairs.withColumn("n", F.regexp_count("text", F.col("pattern"))).where("n > 0").drop("text", "_low", "_first", "pattern")
    worded = hits.where("kind IN ('strong', 'weak')")
    other = worded.select(F.col("epd_uid").alias("_u"), F.col("field").alias("_f"), F.col("category").alias("_c"), F.col("word").alias("_w"), F.col("n").alias("_n"))
    inside = (F.col("epd_uid") == F.col("_u")) & (F.col("field") == F.col("_f")) & (F.col("category") != F.col("_c")) & (F.length("_w") > F.length("word")) & F.contains(F.col("_w"), F.col("word"))
    covered = worded.join(other, inside).groupBy("epd_uid", "field", "category", "word").agg(F.sum("_n").alias("_covered"))
    left = hits.join(covered, ["epd_uid", "field", "category", "word"], "left").withColumn("n", F.col("n") - F.coalesce("_covered", F.lit(0))).where("n > 0")
    hint = F.col("kind") == "pcr_hint"
    cap = F.when((F.col("field") == "full_text") & ~hint, REPEATS_IN_FULL_TEXT).otherwise(1)
    counted = left.select("epd_uid", "field", "category", "ord", "parent", "kind", "word", F.least("n", cap).cast("int").alias("n"), (F.col("w") * F.col("weight")).alias("points"))
    best = counted.where(hint).groupBy("epd_uid", "field", "category", "ord", "parent").agg(F.min_by(F.struct("kind", "word", "n", "points"), F.struct(-F.col("points"), "word")).alias("b"))
    return counted.where(~hint).unionByName(best.select("epd_uid", "field", "category", "ord", "parent", "b.*"))


def category_scores(fields: DataFrame, categories: list[tuple] | None = None) -> DataFrame:
    """epd_uid, category, ord, parent, score of the categories that a record has hits of; see ``category_hits``."""
    return category_hits(fields, categories).groupBy("epd_uid", "category", "ord", "parent").agg(F.sum(F.col("n") * F.col("points")).alias("score"))


def category_evidence(hits: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """Scores with ``evidence``: the first hits of each category, in the order of fields, kinds and words, by falling points, and ``named``: one is in the name.

    What is collected of a category is bounded by its rules, which are a fixed list.
    """
    order = F.create_map(*[F.lit(x) for k, f in enumerate(D.FIELD_WEIGHTS) for x in (f, k)])
    one = F.struct(F.coalesce(F.try_element_at(order, F.col("field")), F.lit(99)).alias("at"), (F.col("kind") == "pcr_hint").alias("hint"), -F.col("points"), "word", "field", "kind", F.bround("points", 2).alias("points"), "n")
    per = hits.groupBy("epd_uid", "category", "ord", "parent").agg(
        F.sum(F.col("n") * F.col("points")).alias("score"), F.array_sort(F.collect_list(one)).alias("_e"), F.max(F.col("field").isin(*NAMING)).alias("named")
    )
    entry = lambda e: F.struct(e["field"].alias("field"), e["word"].alias("keyword"), e["kind"].alias("kind"), e["points"].alias("points"))
    arrived = F.slice(F.flatten(F.transform("_e", lambda e: F.array_repeat(entry(e), e["n"]))), 1, most)
    ranked = F.transform(F.array_sort(F.transform(arrived, lambda e, k: F.struct((-e["points"]).alias("p"), k.alias("k"), e.alias("e")))), lambda x: x["e"])
    return per.select("epd_uid", "category", "ord", "parent", "score", "named", ranked.alias("evidence"))


def classify(records: DataFrame, least: float = 3.0, categories: list[tuple] | None = None) -> DataFrame:
    """epd_uid, category, confidence, score, margin to the best competitor, three alternatives with their scores, and evidence.

    A child with half its parent's score that the name or classification has a hit of takes its place. Competitors are neither the parent
    nor children of the chosen one.
    """
    scores = category_evidence(category_hits(category_fields(records), categories))
    w = Window.partitionBy("epd_uid").orderBy(F.desc("score"), "ord")
    ranked = scores.withColumn("_rank", F.row_number().over(w))
    per = ranked.groupBy("epd_uid").agg(F.array_sort(F.collect_list(F.struct("_rank", "category", "parent", "score", "named", "evidence"))).alias("_r"))
    top = F.get("_r", F.lit(0))
    child = F.get(F.filter("_r", lambda x: (x["parent"] == top["category"]) & (x["score"] >= 0.5 * top["score"]) & x["named"]), F.lit(0))
    joined = records.select("epd_uid").join(per, "epd_uid", "left").withColumn("_c", F.coalesce(child, top)).withColumn("_enough", F.coalesce(top["score"] >= least, F.lit(False)))
    chosen, enough = F.col("_c"), F.col("_enough")
    rival = F.get(F.filter("_r", lambda x: (x["category"] != chosen["category"]) & ~x["category"].eqNullSafe(chosen["parent"]) & ~x["parent"].eqNullSafe(chosen["category"])), F.lit(0))
    margin = F.greatest((chosen["score"] - F.coalesce(rival["score"], F.lit(0.0))) / F.greatest(chosen["score"], F.lit(1e-9)), F.lit(0.0))
    sure = F.bround(F.least(F.lit(0.98), 0.45 + 0.4 * margin + 0.15 * F.least(F.lit(1.0), chosen["score"] / 30)), 2)
    # Without a category every ranked one is an alternative.
    rest = F.slice(F.filter(F.coalesce("_r", F.array()), lambda x: ~enough | (x["category"] != chosen["category"])), 1, 3)
    return joined.select(
        "epd_uid",
        F.when(enough, chosen["category"]).otherwise(D.FALLBACK).alias("category"),
        F.when(enough, sure).otherwise(0.0).alias("category_confidence"),
        F.transform(rest, lambda x: x["category"]).alias("alternatives"),
        F.when(enough, chosen["score"]).alias("category_score"),
        F.when(enough, F.bround(margin, 4)).alias("category_margin"),
        F.transform(rest, lambda x: F.bround(x["score"], 2)).alias("alternative_scores"),
        F.when(enough, chosen["evidence"]).otherwise(F.slice(chosen["evidence"], 1, 0)).alias("category_evidence"),
    )


def override_category(classified: DataFrame, overrides: DataFrame) -> DataFrame:
    """Human choices (epd_uid, chosen) replace the category with full confidence; the old one is kept."""
    both = classified.join(overrides, "epd_uid", "left")
    some = F.col("chosen").isNotNull()
    return both.select(
        "epd_uid",
        F.coalesce("chosen", "category").alias("category"),
        F.when(some, 1.0).otherwise(F.col("category_confidence")).alias("category_confidence"),
        F.when(some, "human_review").otherwise("rules").alias("method"),
        F.when(some, F.col("category")).alias("overridden"),
    )


def indicator_matrix(facts: DataFrame, families: DataFrame) -> DataFrame:
    """epd_uid, group_id, code, present and values of required codes; an unknown family takes the +A2 list."""
    rows = [(g, fam, code) for g, new, old in D.INDICATOR_GROUPS for fam, codes in (("EN15804_A2", new), ("EN15804_A1", old)) for code in codes]
    codes = F.broadcast(facts.sparkSession.createDataFrame(rows, "group_id string, family string, indicator string"))
    need = families.select("epd_uid", F.coalesce("family", F.lit("EN15804_A2")).alias("family")).join(codes, "family")
    have = pivot_modules(facts, ["A1-A3", "A1", "A2", "A3", "A4", "A5", "B4", "B6", "C3", "C4", "D"])
    have = have.withColumn("stage", product_stage(F.col("A1-A3"), F.col("A1"), F.col("A2"), F.col("A3"))["value"])
    present = F.coalesce("stage", "A4", "A5", "B4", "B6", "C3", "C4", "D").isNotNull()
    return need.join(have, ["epd_uid", "indicator"], "left").withColumn("present", F.coalesce(present, F.lit(False)))


def group_status(matrix: DataFrame) -> DataFrame:
    n, has = F.count("*"), F.count_if("present")
    return matrix.groupBy("epd_uid", "group_id").agg(F.when(n == has, "pass").when(has > 0, "warning").otherwise("missing").alias("status"))


def worst(statuses: Column) -> Column:
    """The worst of an array of statuses."""
    rank = F.create_map(*[F.lit(x) for p in D.STATUS_RANK.items() for x in p])
    return F.array_min(F.transform(statuses, lambda s: F.struct(F.try_element_at(rank, s).alias("r"), s.alias("s"))))["s"]


def step1(records: DataFrame, facts: DataFrame) -> DataFrame:
    """epd_uid with the status of all twelve parameters, their worst, counts, and whether the mandatory three hold."""
    m = match_operators(
        records.select("*", F.col("metadata.programme_operator").alias("operator"), F.col("metadata.registration_number").alias("registration"), F.left("full_text", F.lit(HEAD)).alias("head"))
    )
    family = profile_family(F.coalesce("metadata.standard_profile", standard_profile(F.col("full_text"))))
    groups = group_status(indicator_matrix(facts, m.select("epd_uid", family.alias("family"))))
    impact = ["GWP", "ODP", "AP", "EP", "POCP", "ADP"]
    summed = groups.groupBy("epd_uid").agg(
        worst(F.collect_list(F.when(F.col("group_id").isin(impact), F.col("status")))).alias("impact"),
        worst(F.collect_list(F.when(~F.col("group_id").isin(impact), F.col("status")))).alias("resource"),
    )
    stage = pivot_modules(facts.where("indicator IN ('GWP-total', 'GWP')"), ["A1-A3", "A1", "A2", "A3"])
    stage = stage.groupBy("epd_uid").agg(F.bool_or(product_stage(F.col("A1-A3"), F.col("A1"), F.col("A2"), F.col("A3"))["value"].isNotNull()).alias("has_stage"))
    scoped = [m for m, scope in D.MODULE_SCOPE.items() if scope == "included"]
    gwp = facts.where("indicator IN ('GWP-total', 'GWP') AND scenario = '' AND value IS NOT NULL")
    held = facts.groupBy("epd_uid").agg(F.count("*").alias("n_facts")).join(
        gwp.where(F.col("module").isin(scoped)).groupBy("epd_uid").agg(F.count_distinct("module").cast("int").alias("n_scoped")), "epd_uid", "left"
    )
    mix = electricity_mix(F.col("full_text"))["type"]
    level = data_specificity(F.col("full_text"), F.col("metadata.ilcd_subtype"), F.col("metadata.manufacturer"))
    waste = waste_context(F.col("full_text"), F.col("metadata.geographical_scope"))
    verified, iso = F.lower("metadata.verification"), F.coalesce("metadata.iso14025", F.lit(False))
    from_xml = F.coalesce(F.col("source_format").isin("ilcd_xml", "ilcd_zip"), F.lit(False))
    status = {
        "core_standard": F.when(family == "EN15804_A2", "pass").when(family == "EN15804_A1", "warning").otherwise("missing"),
        "third_party_verification": F.when((verified == "external") & (iso | from_xml), "pass").when(verified == "external", "warning").when(verified == "internal", "fail").when(iso | (F.length("metadata.verifier") > 0), "warning").otherwise("missing"),
        "programme_operator": F.when(F.col("operator_id").isNotNull(), "pass").when(F.length("operator") > 0, "warning").otherwise("missing"),
        "reference_service_life": F.when(F.col("metadata.reference_service_life_years") > 0, "pass").when(F.col("metadata.reference_service_life_status") == "not_defined", "warning").otherwise("missing"),
        "unit_conversion_factor": F.when(F.coalesce("metadata.conversion_factor_to_1kg", "metadata.mass_per_declared_unit_kg").isNotNull(), "pass").otherwise("missing"),
        "life_cycle_modules": F.when(F.coalesce("has_stage", F.lit(False)), F.when(F.coalesce("n_scoped", F.lit(0)) == len(scoped), "pass").otherwise("warning")).when(F.col("n_facts") > 0, "fail").otherwise("missing"),
        "environmental_impact_indicators": F.coalesce("impact", F.lit("missing")),
        "resource_waste_indicators": F.coalesce("resource", F.lit("missing")),
        "electricity_mix": F.when(mix == "residual_mix", "pass").when(mix.isNotNull(), "warning").otherwise("missing"),
        "product_specific_data": F.when(level.isin("product_specific", "manufacturer_group"), "pass").when(level == "unknown", "missing").otherwise("warning"),
        "waste_treatment_context": F.when(waste == "danish", "pass").when(waste == "other", "warning").otherwise("missing"),
        "co2_reporting_unit": F.lit("info"),
    }
    out = m.join(summed, "epd_uid", "left").join(stage, "epd_uid", "left").join(held, "epd_uid", "left").select("epd_uid", *[c.alias(k) for k, c in status.items()])
    all_ = F.array(*map(F.col, status))
    must = [F.col(k).isin("pass", "warning") for k in ("core_standard", "third_party_verification", "life_cycle_modules")]
    counts = [F.size(F.filter(all_, _equal(k))).alias(f"n_{k}") for k in D.STATUS_RANK]
    return out.select("*", worst(all_).alias("worst"), (must[0] & must[1] & must[2]).alias("mandatory_ok"), *counts)


#: What a reader is told of each status of each parameter, in the engine's own words.
TOLD = {
    "core_standard": {"pass": "prepared by EN 15804+A2", "warning": "EN 15804+A1: accepted in a transition only, results do not compare with +A2", "missing": "no version of EN 15804 found"},
    "third_party_verification": {"pass": "verified externally", "warning": "verification is not certain to be external by ISO 14025", "fail": "verified internally only", "missing": "no statement of verification found"},
    "programme_operator": {"pass": "an accepted programme", "warning": "the programme is not on the list", "missing": "no programme operator found"},
    "reference_service_life": {"pass": "service life declared", "warning": "the declaration defines no service life", "missing": "no service life found"},
    "unit_conversion_factor": {"pass": "convertible to mass", "missing": "no mass, density or factor found"},
    "life_cycle_modules": {"pass": "product stage and all included modules have values", "warning": "included modules lack values", "fail": "results without the product stage", "missing": "no results"},
    "environmental_impact_indicators": {"pass": "all indicators found", "warning": "some indicators lack", "missing": "a group of indicators lacks"},
    "resource_waste_indicators": {"pass": "all indicators found", "warning": "some indicators lack", "missing": "a group of indicators lacks"},
    "electricity_mix": {"pass": "modelled with a residual mix", "warning": "modelled with another mix", "missing": "the text does not describe electricity"},
    "product_specific_data": {"pass": "data of the manufacturer", "warning": "average or generic data", "missing": "the level of the data is not stated"},
    "waste_treatment_context": {"pass": "end of life in Denmark", "warning": "end of life elsewhere", "missing": "no place of the end of life stated"},
    "co2_reporting_unit": {"info": "values are per declared unit"},
}


def step1_report(records: DataFrame, facts: DataFrame, checked: DataFrame, as_of: Column | None = None) -> DataFrame:
    """epd_uid, ord, parameter, requirement, status, value (JSON or null) and message: a row for each parameter, and the validity."""
    found = match_operators(
        records.select("*", F.col("metadata.programme_operator").alias("operator"), F.col("metadata.registration_number").alias("registration"), F.left("full_text", F.lit(HEAD)).alias("head"))
    )
    md, doc = F.col("metadata"), F.col("full_text")
    mix, level = electricity_mix(doc), data_specificity(doc, md["ilcd_subtype"], md["manufacturer"])
    slots = facts.where("indicator IN ('GWP-total', 'GWP') AND scenario = '' AND value IS NOT NULL").groupBy("epd_uid").agg(F.array_sort(F.collect_set("module")).alias("_available"))
    codes = facts.where("value IS NOT NULL").groupBy("epd_uid").agg(F.array_sort(F.collect_set("indicator")).alias("_present"))
    stage = pivot_modules(facts.where("indicator IN ('GWP-total', 'GWP')"), ["A1-A3", "A1", "A2", "A3", "A4", "A5", "C3", "C4"])
    total = product_stage(F.col("A1-A3"), F.col("A1"), F.col("A2"), F.col("A3"))["value"]
    stage = stage.groupBy("epd_uid").agg(F.min_by(F.struct(total.alias("total"), "A4", "A5", "C3", "C4"), "indicator").alias("_g"))
    rows = found.join(slots, "epd_uid", "left").join(codes, "epd_uid", "left").join(stage, "epd_uid", "left").join(checked, "epd_uid")
    g = F.col("_g")
    helper = reporting_helper(g["total"], g["A4"], g["A5"], g["C3"], g["C4"], md["reference_service_life_years"])
    end = md["valid_until"].try_cast("date")
    valid = validity(end, F.current_date() if as_of is None else as_of)
    js = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    value = {
        "core_standard": js(standard=F.coalesce(md["standard"], md["standard_profile"])),
        "third_party_verification": js(verification_type=md["verification"], verifier=md["verifier"], iso14025=md["iso14025"]),
        "programme_operator": js(programme_operator=md["programme_operator"], id=F.col("operator_id"), name=F.col("operator_name"), confidence=F.col("operator_confidence")),
        "reference_service_life": js(years=md["reference_service_life_years"], status=md["reference_service_life_status"]),
        "unit_conversion_factor": js(declared_unit=md["declared_unit_raw"], mass_per_declared_unit_kg=md["mass_per_declared_unit_kg"], conversion_factor_to_1kg=md["conversion_factor_to_1kg"]),
        "life_cycle_modules": js(available=F.col("_available")),
        "environmental_impact_indicators": js(present=F.col("_present")),
        "resource_waste_indicators": js(present=F.col("_present")),
        "electricity_mix": js(type=mix["type"], term=mix["term"]),
        "product_specific_data": js(level=level, ilcd_subtype=md["ilcd_subtype"]),
        "waste_treatment_context": js(context=waste_context(doc, md["geographical_scope"]), geography=md["geographical_scope"]),
        "co2_reporting_unit": F.to_json(helper),
    }
    told = {k: F.create_map(*[F.lit(x) for p in v.items() for x in p]) for k, v in TOLD.items()}
    one = lambda k, p, r: F.struct(F.lit(k).alias("ord"), F.lit(p).alias("parameter"), F.lit(r).alias("requirement"), F.col(p).alias("status"), value[p].alias("value"), F.try_element_at(told[p], F.col(p)).alias("message"))
    last = F.struct(
        F.lit(len(D.PARAMETERS)).alias("ord"), F.lit("validity").alias("parameter"), F.lit("record").alias("requirement"), F.when(valid["valid_today"], "pass").when(~valid["valid_today"], "warning").otherwise("missing").alias("status"),
        js(valid_until=end.cast("string"), valid_today=valid["valid_today"], days_remaining=valid["days_remaining"]).alias("value"), F.lit(None).cast("string").alias("message"),
    )
    return rows.select("epd_uid", F.inline(F.array(*[one(k, p, r) for k, (p, r) in enumerate(D.PARAMETERS)], last)))


def _equal(value: str):
    return lambda s: s == value


def sum_check(facts: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Slots whose A1 + A2 + A3 is off the reported A1-A3 by more than the tolerance."""
    p = pivot_modules(facts, ["A1-A3", "A1", "A2", "A3"])
    off = F.abs(F.col("A1") + F.col("A2") + F.col("A3") - F.col("A1-A3"))
    return p.where(off > F.greatest(F.lit(tolerance) * F.abs(F.col("A1-A3")), F.lit(1e-9))).select("epd_uid", "indicator", off.alias("difference"))


def component_check(facts: DataFrame) -> DataFrame:
    """Modules in which fossil, biogenic and land-use parts do not sum to the total within 5 % or 0.05."""
    parts = ["GWP-total", "GWP-fossil", "GWP-biogenic", "GWP-luluc"]
    p = facts.where((F.col("scenario") == "") & F.col("indicator").isin(parts)).groupBy("epd_uid", "module").pivot("indicator", parts).agg(first_value())
    off = F.abs(F.col("GWP-fossil") + F.col("GWP-biogenic") + F.col("GWP-luluc") - F.col("GWP-total"))
    return p.where(off > F.greatest(0.05 * F.abs(F.col("GWP-total")), F.lit(0.05))).select("epd_uid", "module", off.alias("difference"))


def unit_check(facts: DataFrame) -> DataFrame:
    """Raw units that mean another unit than the canonical one; unknown ones are not judged."""
    raw, own = unit_key(F.col("raw_unit")), unit_key(F.col("unit"))
    # Most units are spelled alike, and need no keys.
    other = (F.col("raw_unit") != F.col("unit")) & raw.isNotNull() & own.isNotNull() & (raw != own)
    return facts.where(other).select("epd_uid", "indicator", "raw_unit", "unit").distinct()


def validate(records: DataFrame, facts: DataFrame, classified: DataFrame, as_of: Column) -> DataFrame:
    """epd_uid, errors and warnings as arrays of codes."""
    low = facts.groupBy("epd_uid").agg(
        F.count("*").alias("_n"), F.count_if(F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0)) < 0.85).alias("_low"), F.bool_or(F.col("indicator").isin("GWP-total", "GWP")).alias("_gwp")
    )
    joined = records.join(low, "epd_uid", "left").join(classified.select("epd_uid", "category_confidence"), "epd_uid", "left")
    for name, check in (("_sum", sum_check(facts)), ("_part", component_check(facts)), ("_unit", unit_check(facts))):
        joined = joined.join(check.select("epd_uid", F.lit(True).alias(name)).distinct(), "epd_uid", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    errors = {
        "registration_number_missing": blank(F.col("metadata.registration_number")),
        "product_name_missing": blank(F.col("metadata.product_name")),
        "no_results": F.coalesce(F.col("_n"), F.lit(0)) == 0,
        "no_gwp": ~F.coalesce(F.col("_gwp"), F.lit(False)),
    }
    warnings = {
        "a1_a3_sum": F.col("_sum").isNotNull(),
        "gwp_components": F.col("_part").isNotNull(),
        "units": F.col("_unit").isNotNull(),
        "low_confidence": F.coalesce(F.col("_low"), F.lit(0)) > 0,
        "expired": F.coalesce(F.col("metadata.valid_until").try_cast("date") < as_of, F.lit(False)),
        "category_uncertain": F.coalesce(F.col("category_confidence") < 0.5, F.lit(False)),
    }
    listed = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return joined.select("epd_uid", listed(errors).alias("errors"), listed(warnings).alias("warnings"))


def normalized_search_text(*parts: Column) -> Column:
    return F.left(F.lower(F.concat_ws(" ", *parts)), F.lit(4000))


def summarize(records: DataFrame, facts: DataFrame, checked: DataFrame, classified: DataFrame) -> DataFrame:
    """One flat row per declaration for search, sorting and export."""
    gwp = pivot_modules(facts.where("indicator IN ('GWP-total', 'GWP')"), ["A1-A3", "A1", "A2", "A3", "D"])
    stage = product_stage(F.col("A1-A3"), F.col("A1"), F.col("A2"), F.col("A3"))
    # Of both codes the one of +A2, which comes last in their order.
    gwp = gwp.groupBy("epd_uid").agg(F.max_by(F.struct("indicator", stage.alias("s"), F.col("D").alias("d")), "indicator").alias("_g"))
    md, g = F.col("metadata"), F.col("_g")
    unit = parse_declared_unit(md["declared_unit_raw"])
    iso = lambda c: F.coalesce(parse_date(c)["iso"].cast("string"), c.try_cast("date").cast("string"))
    counts = [f"n_{k}" for k in ("pass", "warning", "fail", "missing")]
    joined = records.join(gwp, "epd_uid", "left").join(checked.select("epd_uid", "worst", "mandatory_ok", "programme_operator", "third_party_verification", *counts), "epd_uid", "left").join(classified, "epd_uid", "left")
    own = ("registration_number", "product_name", "manufacturer", "standard", "standard_profile", "mass_per_declared_unit_kg", "conversion_factor_to_1kg")
    none = F.lit(None).cast("string")
    member = F.coalesce((F.col("programme_operator") == "pass").cast("int"), F.lit(0))
    met = F.coalesce("mandatory_ok", F.lit(False)).cast("int")
    # Label and element of a category; one of another dictionary has its id as label.
    labels = F.create_map(*[F.lit(x) for c, (label, element) in D.CATEGORY_LABELS.items() for x in (f"{c} 0", label)] + [F.lit(x) for c, (_, element) in D.CATEGORY_LABELS.items() for x in (f"{c} 1", element)])
    named = lambda k: F.try_element_at(labels, F.concat(F.col("category"), F.lit(f" {k}")))
    told = lambda k: F.coalesce(named(0), F.initcap(F.translate("category", "_", " "))) if k == 0 else named(1)
    return joined.select(
        "epd_uid",
        *[md[c].alias(c) for c in own],
        md["programme_operator"].alias("programme_operator"),
        member.alias("eco_platform_member"),
        F.col("category"),
        told(0).alias("category_label"),
        told(1).alias("building_element"),
        "category_confidence",
        md["declared_unit_raw"].alias("declared_unit"),
        unit["quantity"].alias("declared_quantity"),
        unit["unit"].alias("declared_unit_code"),
        md["reference_service_life_years"].alias("rsl_years"),
        iso(md["publication_date"]).alias("publication_date"),
        iso(md["valid_until"]).alias("valid_until"),
        md["geographical_scope"].alias("geography"),
        g["indicator"].alias("gwp_indicator"),
        g["s"]["value"].alias("gwp_a1_a3"),
        g["s"]["provenance"].alias("gwp_a1_a3_provenance"),
        g["d"].alias("gwp_d"),
        F.col("third_party_verification").alias("verification"),
        *[F.col(c).alias(c.replace("n_", "step1_")) for c in counts],
        met.alias("dgnb_mandatory_met"),
        "source_format",
        (F.col("source_file") if "source_file" in records.columns else none).alias("source_file"),
        F.col("file_sha256").alias("source_sha256"),
        F.lit("extracted_not_approved").alias("review_status"),
        normalized_search_text(md["registration_number"], md["product_name"], md["manufacturer"], md["programme_operator"], md["pcr"], md["product_description"], F.col("category"), told(0), told(1)).alias("search_text"),
        # What the filters of search go by.
        F.col("category").alias("category_id"),
        F.col("worst").alias("step1_worst"),
        met.alias("dgnb_ready"),
        member.alias("eco_platform"),
        F.lit(0).alias("archived"),
    )
