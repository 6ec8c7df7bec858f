"""Operators over whole driver tables mapped to their own schemas, one query for each family, with SQL beside them.

Order lines stand for facts: a number of the order for the declaration, the part for the indicator,
the line for the module, the line status for the scenario.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import tables as D
from ..functions import domain, text
from ..operators import results, rules, search, store, views
from ..schemas import FACT_RESULT, RESULT_COLUMNS
from ..sources import documents, ilcd, registries
from .driver import AS_OF, register, t

CODES = ["GWP-total", "GWP-fossil", "GWP-biogenic", "GWP-luluc"]
LINES = ["A1-A3", "A1", "A2", "A3", "C3", "C4", "D"]
FACTS = (
    f"f AS (SELECT 'E' || (l_orderkey % 300) AS epd_uid, {CODES!r}[1 + (l_partkey % 4)::INT] AS indicator, {LINES!r}[l_linenumber] AS module, "
    "CASE l_linestatus WHEN 'O' THEN '' ELSE 'S' || (l_suppkey % 2) END AS scenario, max(CASE WHEN l_tax > 0.005 THEN l_quantity END) AS value FROM lineitem GROUP BY 1, 2, 3, 4)"
)


def facts(spark: SparkSession, d: str) -> DataFrame:
    at = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    rows = t(spark, d, "lineitem").groupBy(
        F.concat(F.lit("E"), F.col("l_orderkey") % 300).alias("epd_uid"),
        at(CODES, F.col("l_partkey") % 4).alias("indicator"),
        at(LINES, F.col("l_linenumber") - 1).alias("module"),
        F.when(F.col("l_linestatus") == "O", "").otherwise(F.concat(F.lit("S"), F.col("l_suppkey") % 2)).alias("scenario"),
    ).agg(F.max(F.when(F.col("l_tax") > 0.005, F.col("l_quantity"))).alias("value"))
    known = {
        "status": F.when(F.col("value").isNull(), "not_declared").otherwise("declared"), "unit": F.lit("kg CO2 eq"), "raw_unit": F.when(F.col("module") == "D", "MJ").otherwise("kg CO2-eqv."),
        "confidence": F.when(F.col("value") > 40, 0.8).otherwise(1.0), "source_page": F.floor("value"), "human_edited": F.lit(False),
    }
    kinds = dict(c.split() for c in FACT_RESULT.split(", "))
    rows = rows.withColumns(known)
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]).select(RESULT_COLUMNS)


@register(f"WITH {FACTS} SELECT epd_uid, indicator, module, scenario, value, CASE WHEN value IS NULL THEN 'not_declared' ELSE 'declared' END AS status, 'kg CO2 eq' AS unit FROM f")
def long_flatten(spark: SparkSession, d: str) -> DataFrame:
    return results.flatten(results.nest(facts(spark, d))).select("epd_uid", "indicator", "module", "scenario", "value", "status", "unit")


@register(
    f"WITH {FACTS} SELECT epd_uid, indicator, module, scenario, value FROM f WHERE epd_uid IN (SELECT 'E' || (o_orderkey % 300) FROM orders WHERE o_totalprice > 450000) "
    "AND indicator IN ('GWP-total', 'GWP-fossil') AND module IN ('A1-A3', 'D')"
)
def results_in_lists(spark: SparkSession, d: str) -> DataFrame:
    uids = t(spark, d, "orders").where("o_totalprice > 450000").select(F.concat(F.lit("E"), F.col("o_orderkey") % 300).alias("epd_uid"))
    return search.facts_of(facts(spark, d), uids, CODES[:2], ["A1-A3", "D"]).select("epd_uid", "indicator", "module", "scenario", "value")


def _side(modules: list[str]) -> str:
    return ", ".join(f"max(value) FILTER (module = '{m}') AS \"{m}\"" for m in modules)


ALL_MODULES = D.MODULES + ["A1-A3"]


@register(
    f"WITH {FACTS}, u AS (SELECT count(DISTINCT o_orderpriority) > 1 AS units_differ FROM orders) SELECT epd_uid, indicator, {_side(ALL_MODULES)}, any_value(units_differ) AS units_differ FROM f, u WHERE scenario = '' GROUP BY 1, 2"
)
def compare_pivot(spark: SparkSession, d: str) -> DataFrame:
    return results.compare(facts(spark, d), t(spark, d, "orders").select(F.col("o_orderpriority").alias("declared_unit")))


_STAGE = f"p AS (SELECT epd_uid, indicator, {_side(LINES)} FROM f WHERE scenario = '' GROUP BY 1, 2)"


@register(
    f"WITH {FACTS}, {_STAGE} SELECT epd_uid, coalesce(\"A1-A3\", A1 + A2 + A3) AS value, CASE WHEN \"A1-A3\" IS NOT NULL THEN 'reported' WHEN A1 + A2 + A3 IS NOT NULL THEN 'calculated_from_split' END AS provenance FROM p WHERE indicator = 'GWP-total'"
)
def stage_values(spark: SparkSession, d: str) -> DataFrame:
    return results.stages(facts(spark, d)).select("epd_uid", "stage.value", "stage.provenance")


@register(f"WITH {FACTS}, {_STAGE} SELECT epd_uid, indicator, abs(A1 + A2 + A3 - \"A1-A3\") AS difference FROM p WHERE abs(A1 + A2 + A3 - \"A1-A3\") > greatest(0.05 * abs(\"A1-A3\"), 1e-9)")
def qa_sum_check(spark: SparkSession, d: str) -> DataFrame:
    return rules.sum_check(facts(spark, d))


@register(
    f"WITH {FACTS}, c AS (SELECT epd_uid, module, max(value) FILTER (indicator = 'GWP-total') AS t, max(value) FILTER (indicator = 'GWP-fossil') + max(value) FILTER (indicator = 'GWP-biogenic') "
    "+ max(value) FILTER (indicator = 'GWP-luluc') AS s FROM f WHERE scenario = '' GROUP BY 1, 2) SELECT epd_uid, module, abs(s - t) AS difference FROM c WHERE abs(s - t) > greatest(0.05 * abs(t), 0.05)"
)
def qa_component_check(spark: SparkSession, d: str) -> DataFrame:
    return rules.component_check(facts(spark, d))


@register(f"WITH {FACTS} SELECT DISTINCT epd_uid, indicator, 'MJ' AS raw_unit, 'kg CO2 eq' AS unit FROM f WHERE module = 'D'")
def qa_unit_check(spark: SparkSession, d: str) -> DataFrame:
    return rules.unit_check(facts(spark, d))


@register(f"WITH {FACTS} SELECT epd_uid, indicator, module, scenario, value FROM f WHERE indicator IN ('GWP-total', 'GWP-luluc')")
def semi_retain(spark: SparkSession, d: str) -> DataFrame:
    return results.retain(facts(spark, d), ["GWP-total", "GWP-luluc"])[0].select("epd_uid", "indicator", "module", "scenario", "value")


@register(f"WITH {FACTS} SELECT epd_uid, string_agg(DISTINCT indicator, ',' ORDER BY indicator) AS dropped FROM f WHERE indicator NOT IN ('GWP-total', 'GWP-luluc') GROUP BY 1")
def dropped_indicators(spark: SparkSession, d: str) -> DataFrame:
    return results.retain(facts(spark, d), ["GWP-total", "GWP-luluc"])[1].select("epd_uid", F.array_join("dropped_indicators", ",").alias("dropped"))


@register(
    f"WITH {FACTS}, a AS (SELECT * FROM f WHERE module <> 'D'), b AS (SELECT epd_uid, indicator, module, scenario, -value AS value FROM f WHERE module IN ('C4', 'D')) "
    "SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.epd_uid = b.epd_uid AND a.indicator = b.indicator AND a.module = b.module AND a.scenario = b.scenario)"
)
def outer_merge(spark: SparkSession, d: str) -> DataFrame:
    long = facts(spark, d)
    second = long.where("module IN ('C4', 'D')").withColumn("value", -F.col("value"))
    return results.merge(long.where("module <> 'D'"), second).select("epd_uid", "indicator", "module", "scenario", "value")


@register(
    f"WITH {FACTS}, e AS (SELECT 'E' || (o_orderkey % 300) AS epd_uid, 'GWP-total' AS indicator, CASE o_orderstatus WHEN 'P' THEN 'B1' WHEN 'O' THEN 'C3' ELSE 'D' END AS module, '' AS scenario, "
    "max(CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus <> 'F' THEN o_orderkey % 7 END)::DOUBLE AS new FROM orders GROUP BY 1, 2, 3), "
    "j AS (SELECT coalesce(f.epd_uid, e.epd_uid) AS epd_uid, coalesce(f.indicator, e.indicator) AS indicator, coalesce(f.module, e.module) AS module, coalesce(f.scenario, e.scenario) AS scenario, value, new, "
    "e.epd_uid IS NOT NULL AND value IS DISTINCT FROM new AS changed, f.epd_uid IS NULL AS fresh FROM f FULL JOIN e ON f.epd_uid = e.epd_uid AND f.indicator = e.indicator AND f.module = e.module AND f.scenario = e.scenario) "
    "SELECT epd_uid, indicator, module, scenario, CASE WHEN changed THEN new ELSE value END AS value, CASE WHEN changed AND new IS NULL THEN 'not_recorded' WHEN changed THEN 'declared' WHEN fresh THEN NULL WHEN value IS NULL THEN 'not_declared' ELSE 'declared' END AS status, "
    "CASE WHEN changed AND fresh THEN 'human_entered' WHEN changed THEN 'human_edited' END AS provenance, changed AS human_edited FROM j"
)
def apply_edits(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    slot = [F.concat(F.lit("E"), F.col("o_orderkey") % 300).alias("epd_uid"), F.lit("GWP-total").alias("indicator"), F.when(status == "P", "B1").when(status == "O", "C3").otherwise("D").alias("module"), F.lit("").alias("scenario")]
    some = (F.col("o_orderpriority") == "5-LOW") & (status != "F")
    edits = t(spark, d, "orders").groupBy(*slot).agg(F.max(F.when(some, F.col("o_orderkey") % 7)).cast("double").alias("value"))
    return results.apply_edits(facts(spark, d), edits).select("epd_uid", "indicator", "module", "scenario", "value", "status", "provenance", "human_edited")


_SCOPE = {**{m: D.MODULE_SCOPE["A1-A3"] for m in ("A1", "A2", "A3")}, **D.MODULE_SCOPE}
_SPINE = "s(ord, module, scope) AS (VALUES " + ", ".join(f"({k}, '{m}', {repr(_SCOPE[m]) if m in _SCOPE else 'NULL'})" for k, m in enumerate(["A1-A3", *D.MODULES])) + ")"


@register(
    f"WITH {FACTS}, {_SPINE}, i AS (SELECT DISTINCT epd_uid FROM f), x AS (SELECT DISTINCT epd_uid, module, 'X' AS declared FROM f WHERE value > 20) "
    "SELECT i.epd_uid, ord, s.module, scope, declared, v.value FROM i CROSS JOIN s LEFT JOIN x ON x.epd_uid = i.epd_uid AND x.module = s.module "
    "LEFT JOIN f v ON v.epd_uid = i.epd_uid AND v.module = s.module AND v.indicator = 'GWP-total' AND v.scenario = ''"
)
def left_join_spine(spark: SparkSession, d: str) -> DataFrame:
    long = facts(spark, d)
    declared = ilcd.declarations(long.where("value > 20").select(F.lit(0).alias("archive"), F.col("epd_uid").alias("uuid"), "module")).select(F.col("uuid").alias("epd_uid"), "module", "declared")
    return results.module_frame(declared, long)


_GROUPS = "g(group_id, family, code) AS (VALUES " + ", ".join(f"('{g}', '{fam}', '{c}')" for g, new, old in D.INDICATOR_GROUPS for fam, codes in (("EN15804_A2", new), ("EN15804_A1", old)) for c in codes) + ")"
_MATRIX = (
    f"{FACTS}, {_STAGE}, {_GROUPS}, e AS (SELECT DISTINCT epd_uid, CASE WHEN epd_uid < 'E15' THEN 'EN15804_A2' WHEN epd_uid < 'E22' THEN 'EN15804_A1' ELSE 'EN15804_A2' END AS family FROM f), "
    'm AS (SELECT e.epd_uid, group_id, code, coalesce(coalesce("A1-A3", A1 + A2 + A3), C3, C4, D) IS NOT NULL AS present FROM e JOIN g ON g.family = e.family LEFT JOIN p ON p.epd_uid = e.epd_uid AND p.indicator = g.code)'
)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    long = facts(spark, d)
    families = long.select("epd_uid").distinct().withColumn("family", F.when(F.col("epd_uid") < "E15", "EN15804_A2").when(F.col("epd_uid") < "E22", "EN15804_A1"))
    return rules.indicator_matrix(long, families)


@register(f"WITH {_MATRIX} SELECT epd_uid, group_id, code AS indicator, present FROM m")
def indicator_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d).select("epd_uid", "group_id", "indicator", "present")


@register(f"WITH {_MATRIX} SELECT epd_uid, group_id, CASE WHEN bool_and(present) THEN 'pass' WHEN bool_or(present) THEN 'warning' ELSE 'missing' END AS status FROM m GROUP BY 1, 2")
def indicator_groups(spark: SparkSession, d: str) -> DataFrame:
    return rules.group_status(_matrix(spark, d))


@register(f"WITH {FACTS} SELECT epd_uid, indicator, module, scenario, CASE module WHEN 'D' THEN 'MJ' ELSE 'kg CO2-eqv.' END AS raw_unit, floor(value)::INT AS source_page, CASE WHEN value > 40 THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence FROM f")
def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    return views.evidence(facts(spark, d)).select("epd_uid", "indicator", "module", "scenario", "raw_unit", "source_page", "confidence")


@register(f"WITH {FACTS} SELECT epd_uid, count(value) AS n_values, count(DISTINCT indicator) AS n_indicators, count(DISTINCT floor(value)) AS n_pages FROM f GROUP BY 1")
def page_metrics(spark: SparkSession, d: str) -> DataFrame:
    return views.page_metrics(facts(spark, d))


# --- Search over a summary made of orders --------------------------------------------------------
_SUMMARY = (
    "s AS (SELECT 'E' || o_orderkey AS epd_uid, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS valid_until, (o_orderpriority = '5-LOW')::INT AS archived, (o_totalprice > 200000)::INT AS dgnb_ready, "
    "(o_orderpriority = '2-HIGH')::INT AS eco_platform, o_orderpriority AS category_id, 'M' || (o_custkey % 10) AS manufacturer, CASE WHEN o_custkey % 3 = 0 THEN 'EN15804_A1_CML' ELSE 'EN15804_A2_EF3.1' END AS standard_profile FROM orders)"
)
_VALID = f"(valid_until IS NULL OR valid_until >= DATE '{AS_OF}')"


def summary(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda c: c.cast("int")
    return t(spark, d, "orders").select(
        F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("epd_uid"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date").cast("string")).alias("valid_until"),
        flag(F.col("o_orderpriority") == "5-LOW").alias("archived"), flag(F.col("o_totalprice") > 200000).alias("dgnb_ready"), flag(F.col("o_orderpriority") == "2-HIGH").alias("eco_platform"),
        F.col("o_orderpriority").alias("category_id"), F.concat(F.lit("M"), F.col("o_custkey") % 10).alias("manufacturer"), F.when(F.col("o_custkey") % 3 == 0, "EN15804_A1_CML").otherwise("EN15804_A2_EF3.1").alias("standard_profile"),
        F.lower("o_orderpriority").alias("search_text"),
    )




def as_of():
    return F.lit(AS_OF).cast("date")


@register(f"WITH {_SUMMARY} SELECT epd_uid, archived FROM s WHERE archived = 0 AND {_VALID}")
def valid_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.search(summary(spark, d), only_valid=True, as_of=as_of()).select("epd_uid", "archived")


@register(f"WITH {_SUMMARY} SELECT epd_uid, manufacturer FROM s WHERE archived = 0 AND category_id = '1-URGENT' AND manufacturer = 'M3' AND standard_profile = 'EN15804_A1_CML'")
def equality_filters(spark: SparkSession, d: str) -> DataFrame:
    return search.search(summary(spark, d), category="1-URGENT", manufacturer="M3", standard="EN15804_A1_CML").select("epd_uid", "manufacturer")


@register(f"WITH {_SUMMARY} SELECT epd_uid, category_id FROM s WHERE dgnb_ready = 1")
def dgnb_and_archived(spark: SparkSession, d: str) -> DataFrame:
    return search.search(summary(spark, d), only_dgnb=True, include_archived=True).select("epd_uid", "category_id")


@register(
    f"WITH {_SUMMARY} SELECT count(*) AS total, count(*) FILTER (archived = 0) AS active, count(*) FILTER (archived = 0 AND {_VALID}) AS valid, count(*) FILTER (archived = 0 AND dgnb_ready = 1) AS dgnb, "
    "count(*) FILTER (archived = 0 AND eco_platform = 1) AS eco FROM s"
)
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.stats(summary(spark, d), as_of())


# --- Versions made of events ---------------------------------------------------------------------
@register("SELECT 'U' || user_id AS epd_uid, event_id::INT AS version, lag(event_id::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_version FROM events")
def version_lag(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("epd_uid"), F.col("event_id").cast("int").alias("version"))
    return store.history(rows)


@register(
    "WITH d AS (SELECT user_id, max(event_id) AS v FROM events GROUP BY 1), c AS (SELECT user_id, max(event_id) AS h FROM events WHERE event_type IN ('click', 'error') GROUP BY 1) "
    "SELECT 'U' || d.user_id AS epd_uid, v AS version FROM d LEFT JOIN c ON c.user_id = d.user_id WHERE h IS NULL OR v > h"
)
def newer_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("epd_uid"), F.col("event_id").alias("version"), "event_type")
    have = store.latest(rows.where("event_type IN ('click', 'error')"), ["epd_uid"], [F.desc("version")])
    return store.newer(rows.drop("event_type"), have)


@register(
    "WITH b AS (SELECT o_orderkey AS k, md5(o_orderstatus) AS h FROM orders WHERE o_orderstatus <> 'O'), n AS (SELECT o_orderkey AS k, md5(CASE WHEN o_orderpriority = '2-HIGH' THEN 'X' ELSE o_orderstatus END) AS h FROM orders WHERE o_orderstatus = 'O' OR o_orderpriority <> '5-LOW') "
    "SELECT coalesce(n.k, b.k) AS k, CASE WHEN n.k IS NULL THEN 'kept' WHEN b.h IS NULL THEN 'created' WHEN b.h = n.h THEN 'unchanged' ELSE 'updated' END AS status FROM b FULL JOIN n ON b.k = n.k"
)
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders")
    b = orders.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("k"), F.md5("o_orderstatus").alias("old"))
    n = orders.where("o_orderstatus = 'O' OR o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("k"), F.md5(F.when(F.col("o_orderpriority") == "2-HIGH", "X").otherwise(F.col("o_orderstatus"))).alias("new"))
    both = b.join(n, "k", "full_outer")
    return both.select("k", F.when(F.col("new").isNull(), "kept").otherwise(store.upsert_status(F.col("old"), F.col("new"))).alias("status"))


@register("SELECT c_custkey, sha256('{\"c_name\":\"' || c_name || '\",\"c_mktsegment\":' || CASE WHEN c_acctbal < 0 THEN 'null' ELSE '\"' || c_mktsegment || '\"' END || '}') AS digest FROM customer")
def content_hash_distinct(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    return rows.select("c_custkey", text.content_hash("c_name", "c_mktsegment").alias("digest"))


# --- Domain --------------------------------------------------------------------------------------
@register(
    "WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'EPD Danmark' WHEN 'O' THEN 'Institut  Bauen und Umwelt e.V.' ELSE 'someone' END AS field, "
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'NEPD-123-45' WHEN '2-HIGH' THEN ' s-p-00012' ELSE 'none' END AS reg, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'By BRE Global, IBUs' ELSE 'text' END AS head FROM orders) "
    "SELECT o_orderkey, CASE field WHEN 'EPD Danmark' THEN 'epd_danmark' WHEN 'someone' THEN CASE WHEN reg LIKE 'NEPD%' THEN 'epd_global_norway' WHEN reg LIKE ' s-p%' THEN 'epd_international' WHEN head <> 'text' THEN 'bre' END ELSE 'ibu' END AS operator_id, "
    "CASE WHEN field <> 'someone' THEN 0.97 WHEN reg <> 'none' THEN 0.9 WHEN head <> 'text' THEN 0.8 END::DOUBLE AS operator_confidence FROM o"
)
def operator_match(spark: SparkSession, d: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = t(spark, d, "orders").select(
        "o_orderkey",
        F.when(status == "F", "EPD Danmark").when(status == "O", "Institut  Bauen und Umwelt e.V.").otherwise("someone").alias("operator"),
        F.when(priority == "1-URGENT", "NEPD-123-45").when(priority == "2-HIGH", " s-p-00012").otherwise("none").alias("registration"),
        F.when(priority == "3-MEDIUM", "By BRE Global, IBUs").otherwise("text").alias("head"),
    )
    return domain.match_operators(rows).select("o_orderkey", "operator_id", "operator_confidence")


_WORDS = [
    ("metal", None, ["hot ring", "old bolt"], ["ring", "bolt"], [], []), ("colour", None, ["red widget"], ["red", "blue", "green"], [], []), ("finish", None, ["promo", "economy"], ["standard"], [r"\bS[A-Z]+L\b"], []), ("part", None, [], ["gear", "widget", "plate"], [], []),
]
_RULES = [(c, w, 3.0, w) for c, _, strong, *_ in _WORDS for w in strong] + [(c, w, 1.0, w) for c, _, _, weak, *_ in _WORDS for w in weak]


@register(
    "WITH w(category, word, points) AS (VALUES " + ", ".join(f"('{c}', '{w}', {p})" for c, w, p, _ in _RULES) + "), "
    "f AS (SELECT p_partkey, 'product_name' AS field, p_name AS txt, 5.0 AS weight FROM part UNION ALL SELECT p_partkey, 'pcr', p_type, 3.0 FROM part), "
    "h AS (SELECT p_partkey, field, category, word, points * weight AS points FROM f, w WHERE regexp_matches(lower(txt), '(^|[^a-z])' || word || '($|[^a-z])')), "
    # A word inside a longer hit of another category is covered: 'widget' of part by 'red widget' of colour.
    "k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.p_partkey = h.p_partkey AND o.field = h.field AND o.category <> h.category AND length(o.word) > length(h.word) AND contains(o.word, h.word)) "
    "UNION ALL SELECT p_partkey, field, 'finish', 'pattern', 2.5 * weight FROM f WHERE txt IN ('SMALL')) SELECT p_partkey, category, sum(points)::DOUBLE AS score FROM k GROUP BY 1, 2"
)
def category_score(spark: SparkSession, d: str) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), F.col(c).alias("text")) for f, w, c in (("product_name", 5.0, "p_name"), ("pcr", 3.0, "p_type"))])
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("epd_uid"), F.inline(fields))
    return rules.category_scores(rows, _WORDS).select(F.col("epd_uid").alias("p_partkey"), "category", "score")


@register("SELECT c_custkey AS epd_uid, CASE WHEN c_acctbal < 0 THEN 'wall' ELSE c_mktsegment END AS category, CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS category_confidence, CASE WHEN c_acctbal < 0 THEN 'human_review' ELSE 'rules' END AS method, CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS overridden FROM customer")
def category_override(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "customer")
    classified = rows.select(F.col("c_custkey").alias("epd_uid"), F.col("c_mktsegment").alias("category"), F.lit(0.5).alias("category_confidence"))
    return rules.override_category(classified, rows.where("c_acctbal < 0").select(F.col("c_custkey").alias("epd_uid"), F.lit("wall").alias("chosen")))


_VOTES = ", ".join(f"len(list_filter(ws, lambda x: x IN ({', '.join(repr(w) for w in stop)})))::INT AS n{k}" for k, stop in enumerate(D.STOP_WORDS.values()))
_NAMES = list(D.STOP_WORDS)


@register(
    f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zæøåäöüé]+') AS ws FROM documents), c AS (SELECT doc_id, {_VOTES} FROM w), "
    f"l AS (SELECT doc_id, list_reverse(list_sort([{', '.join(f'{{n: n{k}, o: -{k}, l: {chr(39)}{name}{chr(39)}}}' for k, name in enumerate(_NAMES))}])) AS r FROM c) "
    "SELECT doc_id, CASE WHEN r[1].n >= 5 THEN r[1].l END AS language, CASE WHEN r[1].n >= 5 THEN round_even(least(0.95, 0.5 + (r[1].n - r[2].n) / greatest(r[1].n, 1) * 0.5), 2) ELSE 0.0 END::DOUBLE AS confidence FROM l"
)
def language_vote(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", domain.language_vote(F.col("text")).alias("v")).select("doc_id", "v.language", "v.confidence")


@register("SELECT event_id, user_id, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS header_above FROM events")
def header_carry(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "events").withColumn("h", F.when(F.col("event_type").isin("signup", "error"), F.col("event_type")))
    return domain.last_header(rows, ["user_id"], ["event_id"], "h").select("event_id", "user_id", "header_above")


_LABELLED = [
    ("Water use", "EN15804_A2_UNKNOWN_EF", "m3 world eq deprived", "WDP"), ("Use of net fresh water", "unresolved", "m3", "FW"), ("GWP-fossil", "EN15804_A2_EF3.1", "kg CO2 eq", "GWP-fossil"), ("Global warming potential", "EN15804_A1_CML", "kg CO2 eq", "GWP"),
    ("Water use", "EN15804_A2_EF3.1", "m3", "FW"), ("Something else", "unresolved", "kg", None), ("PERT", "EN15804_A1_CML", "MJ", "PERT"), ("Acidification potential", "EN15804_A1_CML", "kg SO2 eq", "AP"),
]


@register("WITH c(k, label, profile, unit, code) AS (VALUES " + ", ".join(f"({k}, '{a}', '{p}', '{u}', {repr(c) if c else 'NULL'})" for k, (a, p, u, c) in enumerate(_LABELLED)) + ") SELECT o_orderkey, label, code FROM orders JOIN c ON o_orderkey % 8 = k")
def indicator_match(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda n: F.get(F.array(*[F.lit(r[n]) for r in _LABELLED]), (F.col("o_orderkey") % 8).cast("int"))
    rows = t(spark, d, "orders").select("o_orderkey", pick(0).alias("label"), pick(1).alias("profile"), pick(2).alias("unit"))
    return domain.match_indicators(rows).select("o_orderkey", "label", "code")


@register("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN NULL ELSE 1 + c_nationkey % 2 END AS page, CASE WHEN c_nationkey < 5 THEN NULL ELSE 'text_pattern' END AS method, 0.123::DOUBLE AS confidence FROM customer")
def found_pages(spark: SparkSession, d: str) -> DataFrame:
    named = lambda k: F.when(F.col("c_nationkey") % 2 == k, F.concat(F.lit("  Page of "), "c_name")).otherwise("another")
    pages = F.array(*[F.struct(F.lit(k + 1).alias("page_number"), named(k).alias("text")) for k in (0, 1)])
    page = text.find_page(pages, F.when(F.col("c_nationkey") < 5, "").otherwise(F.concat(F.lit("page   of "), "c_name")))
    e = text.evidence(page, F.col("c_name"), F.when(page.isNotNull(), "text_pattern"), F.lit(0.12345))
    return t(spark, d, "customer").select("c_custkey", e.alias("e")).select("c_custkey", F.col("e.source_page").alias("page"), F.col("e.extraction_method").alias("method"), "e.confidence")


@register(
    "SELECT p_partkey, round_even(coalesce(CASE WHEN p_size % 5 = 0 THEN p_retailprice END, p_size / nullif(CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE NULL END, 0.0), CASE p_size % 4 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_size * 1000.0 WHEN 2 THEN p_size * 2.5 ELSE p_size * 2400.0 END), 6) AS mass FROM part"
)
def mass_per_unit(spark: SparkSession, d: str) -> DataFrame:
    size, none = F.col("p_size"), F.lit(None).cast("double")
    unit = F.when(size % 4 == 0, "kg").when(size % 4 == 1, "t").when(size % 4 == 2, "m2").otherwise("m3")
    mass = documents.mass_per_unit(size.cast("double"), unit, F.when(size % 5 == 0, F.col("p_retailprice")), F.when(size % 3 == 0, 0.0), F.lit(2.5), F.lit(2400.0), none, none)
    return t(spark, d, "part").select("p_partkey", mass.alias("mass"))


# --- Registries ----------------------------------------------------------------------------------
@register(
    "WITH k AS (SELECT s_suppkey AS uuid, 'C' || s_nationkey AS code FROM supplier WHERE s_acctbal > 1000), e AS (SELECT s_suppkey AS uuid, CASE WHEN s_nationkey < 12 THEN 'C' || s_nationkey ELSE 'X' END AS code FROM supplier) "
    "SELECT e.uuid, e.code, CASE WHEN k.uuid IS NULL THEN 'missing' ELSE 'code differs' END AS problem FROM e LEFT JOIN k ON e.uuid = k.uuid WHERE k.uuid IS NULL OR k.code <> e.code"
)
def registry_anti(spark: SparkSession, d: str) -> DataFrame:
    rows, code = t(spark, d, "supplier"), F.concat(F.lit("C"), F.col("s_nationkey").cast("string"))
    known = rows.where("s_acctbal > 1000").select(F.col("s_suppkey").alias("uuid"), code.alias("code"))
    earlier = rows.select(F.col("s_suppkey").alias("uuid"), F.when(F.col("s_nationkey") < 12, code).otherwise("X").alias("code"))
    return registries.registry_gaps(known, earlier)


@register(
    "WITH l AS (SELECT 0 AS k, s_suppkey AS uuid, s_name AS name, 'A1' AS profile FROM supplier WHERE s_acctbal > 3000 UNION ALL SELECT 1, s_suppkey, 'second ' || s_name, 'A2' FROM supplier) "
    "SELECT uuid, arg_min(name, k) AS name, string_agg(profile, ',' ORDER BY k) AS profiles FROM l GROUP BY 1"
)
def registry_union(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "supplier")
    one = lambda name, profile: [F.col("s_suppkey").alias("uuid"), F.lit("c").alias("code"), F.lit("lcia").alias("kind"), name.alias("name"), F.lit("kg").alias("unit"), F.lit(profile).alias("profile")]
    lists = [rows.where("s_acctbal > 3000").select(*one(F.col("s_name"), "A1")), rows.select(*one(F.concat(F.lit("second "), "s_name"), "A2"))]
    return registries.registry(lists).select("uuid", "name", F.array_join("profiles", ",").alias("profiles"))


@register("SELECT 'r' || r_regionkey AS id, r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, r_name || ' / ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'c' || c_custkey, r_name || ' / ' || n_name || ' / ' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def category_paths(spark: SparkSession, d: str) -> DataFrame:
    node = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    top = t(spark, d, "region").select(node("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    mid = t(spark, d, "nation").select(node("n", "n_nationkey").alias("id"), node("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    low = t(spark, d, "customer").select(node("c", "c_custkey").alias("id"), node("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    return registries.category_paths(top.unionByName(mid).unionByName(low))


@register("SELECT p_name || CASE WHEN p_size > 25 THEN '/extra' ELSE '' END AS path, p_partkey FROM part WHERE p_size > 25")
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part")
    wanted = part.select(F.concat("p_name", F.when(F.col("p_size") > 25, "/extra").otherwise("")).alias("path"), "p_partkey").unionByName(part.select(F.concat(F.lit("flowDataSet/"), "p_name").alias("path"), "p_partkey"))
    return registries.missing_fields(wanted, part.select(F.col("p_name").alias("path")).distinct())


@register("SELECT c_name AS property, 'id' || c_custkey AS identifier, CASE WHEN c_nationkey < 10 THEN '-' ELSE 'kg' END AS unit, c_mktsegment || ' more' AS comment FROM customer")
def property_table(spark: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("c_nationkey") < 10, "").otherwise("kg")
    rows = F.array(F.concat(F.lit("| "), "c_name", F.lit(" | id"), F.col("c_custkey").cast("string"), F.lit(" | "), unit, F.lit(" | "), "c_mktsegment", F.lit("<br>more |")), F.lit("| --- | --- | --- | --- |"), F.lit("no table"))
    return registries.property_table(t(spark, d, "customer").select(F.explode(rows).alias("value")))


@register(
    "WITH g AS (SELECT lower('G-' || n_nationkey) AS group_uuid FROM nation), u(id, unit, factor) AS (VALUES (0, 'kg', 1.0), (1, 't', 1000.0)) SELECT group_uuid, unit, factor::DOUBLE AS factor, 'kg' AS reference_unit FROM g, u"
)
def unit_conversions(spark: SparkSession, d: str) -> DataFrame:
    unit = lambda k, name, f: f'<u:unit dataSetInternalID="{k}"><u:name> {name} </u:name><u:meanValue>{f}</u:meanValue></u:unit>'
    tail = f'</c:UUID><u:referenceToReferenceUnit>0</u:referenceToReferenceUnit><u:units>{unit(0, "kg", "1.0")}{unit(1, "t", "1000")}{unit(2, "", "5")}</u:units></u:unitGroupDataSet>'
    xml = F.concat(F.lit('<u:unitGroupDataSet xmlns:u="urn:u" xmlns:c="urn:c"><c:UUID>G-'), F.col("n_nationkey").cast("string"), F.lit(tail))
    return registries.conversions(registries.unit_groups(t(spark, d, "nation").select(xml.alias("xml"))))


@register("SELECT 'T' || n_nationkey AS type, o AS ord, CASE o WHEN 0 THEN n_name ELSE 'other' END AS value FROM nation, (VALUES (0), (1)) x(o)")
def enumerations(spark: SparkSession, d: str) -> DataFrame:
    xml = F.concat(
        F.lit('<xs:schema><xs:element name="e"/><xs:simpleType name="T'), F.col("n_nationkey").cast("string"), F.lit('"><xs:restriction base="s"><xs:enumeration value="'), "n_name", F.lit('"/><xs:enumeration value="other"/></xs:restriction></xs:simpleType></xs:schema>')
    )
    return registries.enumerations(t(spark, d, "nation").select(xml.alias("xml")))


@register(
    "WITH w(category, word, points) AS (VALUES " + ", ".join(f"('{c}', '{w}', {p})" for c, w, p, _ in _RULES) + "), "
    "f AS (SELECT p_partkey, 'product_name' AS field, 1 AS place, p_name AS txt, 5.0 AS weight FROM part UNION ALL SELECT p_partkey, 'pcr', 2, p_type, 3.0 FROM part), "
    "h AS (SELECT p_partkey, field, place, category, word, (points * weight)::DOUBLE AS points FROM f, w WHERE regexp_matches(lower(txt), '(^|[^a-z])' || word || '($|[^a-z])')), "
    "k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.p_partkey = h.p_partkey AND o.field = h.field AND o.category <> h.category AND length(o.word) > length(h.word) AND contains(o.word, h.word)) "
    "UNION ALL SELECT p_partkey, field, place, 'finish', 'pattern', (2.5 * weight)::DOUBLE FROM f WHERE txt IN ('SMALL')) "
    "SELECT p_partkey, category, string_agg(field || ' ' || word || ' ' || points::VARCHAR, ', ' ORDER BY points DESC, place, word) AS evidence, bool_or(field = 'product_name') AS named FROM k GROUP BY 1, 2"
)
def category_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The hits that a category's score is made of, the best first."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), F.col(c).alias("text")) for f, w, c in (("product_name", 5.0, "p_name"), ("pcr", 3.0, "p_type"))])
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("epd_uid"), F.inline(fields))
    found = rules.category_evidence(rules.category_hits(rows, _WORDS))
    word = lambda e: F.when(e["kind"] == "pattern", "pattern").otherwise(e["keyword"])
    line = F.transform("evidence", lambda e: F.concat_ws(" ", e["field"], word(e), e["points"].cast("string")))
    return found.select(F.col("epd_uid").alias("p_partkey"), "category", F.array_join(line, ", ").alias("evidence"), "named")
