"""Queries over the driver's tables, one for each family of operators, with DuckDB SQL beside them.

Each takes (spark, sf_dir) and reads whole tables. Limits stand only where paging is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, domain, numbers, text, units
from ..operators import results, rules, search, store

AS_OF = "1998-06-30"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a narrow table from which a task writes and reads documents.
SPREAD_ROWS = 50_000


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores: a file of a few megabytes, which one task would read, becomes much work a row."""
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.count() // SPREAD_ROWS))


def _found(spark: SparkSession, d: str) -> DataFrame:
    parts = t(spark, d, "part").select(
        "p_partkey", "p_name", "p_type", "p_retailprice", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("search_text"), F.lit(0).alias("archived")
    )
    return search.search(parts, text="bolt promo").drop("search_text", "archived")


_FOUND = "SELECT p_partkey, p_name, p_type, p_retailprice FROM part WHERE lower(p_name || ' ' || p_type) LIKE '%bolt%' AND lower(p_name || ' ' || p_type) LIKE '%promo%'"


@register(_FOUND + " ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25")
def search_tokens_page(spark: SparkSession, d: str) -> DataFrame:
    return search.page(_found(spark, d), "p_retailprice", 25, descending=True, key="p_partkey", allowed=["p_retailprice"])


@register(f"SELECT count(*) AS total FROM ({_FOUND})")
def search_total(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).agg(F.count("*").alias("total"))


@register("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def facet_category(spark: SparkSession, d: str) -> DataFrame:
    return search.facet(t(spark, d, "customer"), "c_mktsegment")


@register(
    "SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS facet, "
    "coalesce(o_orderstatus, o_orderpriority) AS value, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))"
)
def facet_all(spark: SparkSession, d: str) -> DataFrame:
    return search.facets(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@register(
    "WITH x AS (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 10) AS total, nullif(l_tax, 0.0) AS a, nullif(l_discount, 0.0) AS b, l_quantity AS c FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, coalesce(total, a + b + c) AS value, CASE WHEN total IS NOT NULL THEN 'reported' WHEN a + b + c IS NOT NULL THEN 'calculated_from_split' END AS provenance FROM x"
)
def product_stage(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.nullif("l_quantity", F.lit(10.0)), F.nullif("l_tax", F.lit(0.0)), F.nullif("l_discount", F.lit(0.0)), F.col("l_quantity")]
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", results.product_stage(*parts).alias("s")).select("l_orderkey", "l_linenumber", "s.value", "s.provenance")


_KINDS = "SELECT user_id, bool_or(event_type = 'purchase') AS t, (bool_or(event_type = 'click')::INT + bool_or(event_type = 'view')::INT + bool_or(event_type = 'signup')::INT) AS k FROM events GROUP BY 1"


@register(
    f"SELECT user_id, CASE WHEN NOT t AND k = 0 THEN 'none' WHEN t AND k = 0 THEN 'aggregate_only' WHEN t AND k = 3 THEN 'split_plus_reported_total' "
    f"WHEN k = 3 THEN 'split_only' ELSE 'partial_split' END AS mode FROM ({_KINDS})"
)
def reporting_mode(spark: SparkSession, d: str) -> DataFrame:
    has = lambda kind: F.bool_or(F.col("event_type") == kind)
    per = t(spark, d, "events").groupBy("user_id").agg(has("purchase").alias("t"), *[has(k).cast("int").alias(k) for k in ("click", "view", "signup")])
    return per.select("user_id", results.a1_a3_mode(F.col("t"), F.col("click") + F.col("view") + F.col("signup")).alias("mode"))


_PER = "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'click') AS c, (user_id % 40)::DOUBLE AS life FROM events GROUP BY 1"


@register(
    f"WITH x AS ({_PER}), y AS (SELECT *, CASE WHEN life > 0 THEN greatest(0, ceil(50 / life) - 1)::BIGINT END AS replacements, nullif(a, 0)::DOUBLE AS s, nullif(c, 0)::DOUBLE AS e FROM x) "
    "SELECT user_id, replacements, replacements * (s + coalesce(e, 0)) AS b4, CASE WHEN s IS NOT NULL OR e IS NOT NULL THEN coalesce(s, 0) + coalesce(e, 0) + coalesce(replacements * (s + coalesce(e, 0)), 0) END AS total, "
    "CASE WHEN s IS NOT NULL OR e IS NOT NULL THEN coalesce(s, 0) + coalesce(e, 0) + coalesce(replacements * (s + coalesce(e, 0)), 0) END / 50 AS per_year FROM y"
)
def reporting_helper(spark: SparkSession, d: str) -> DataFrame:
    count = lambda k: F.nullif(F.count_if(F.col("event_type") == k), F.lit(0)).cast("double")
    per = t(spark, d, "events").groupBy("user_id").agg(count("purchase").alias("s"), count("click").alias("e"))
    none = F.lit(None).cast("double")
    h = results.reporting_helper(F.col("s"), none, none, F.col("e"), none, F.when(F.col("user_id") % 40 > 0, (F.col("user_id") % 40).cast("double")))
    return per.select("user_id", h.alias("h")).select("user_id", "h.replacements", "h.b4", "h.total", "h.per_year")


@register(
    "SELECT o_custkey, arg_min(s, r) AS worst, count(*) AS n FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'P' THEN 'fail' WHEN 'F' THEN 'warning' ELSE 'pass' END AS s, "
    "CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 2 ELSE 4 END AS r FROM orders) GROUP BY 1"
)
def worst_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "fail").when(F.col("o_orderstatus") == "F", "warning").otherwise("pass")
    return t(spark, d, "orders").groupBy("o_custkey").agg(rules.worst(F.collect_set(status)).alias("worst"), F.count("*").alias("n"))


@register("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(t(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


_LABELS = [(0, "red bolt"), (1, "bolt"), (2, "red"), (3, "gear"), (4, "small widget")]


@register(
    "WITH l(ord, cand) AS (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in _LABELS) + "), p AS (SELECT DISTINCT lower(p_name) AS label FROM part), "
    "s AS (SELECT label, cand, ord, CASE WHEN label = cand THEN 1.0 WHEN starts_with(label, cand || ' ') THEN 0.92 WHEN length(cand) >= 12 AND contains(label, cand) THEN 0.88 ELSE 0.0 END::DOUBLE AS score FROM p, l), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, ord) AS r FROM s WHERE score > 0) SELECT label, cand, score FROM b WHERE r = 1"
)
def label_match(spark: SparkSession, d: str) -> DataFrame:
    cands = F.broadcast(spark.createDataFrame(_LABELS, "ord int, cand string"))
    labels = t(spark, d, "part").select(F.lower("p_name").alias("label")).distinct()
    score = domain.label_match(F.col("label"), F.col("cand"))
    best = labels.join(cands, score > 0).groupBy("label").agg(F.max_by(F.struct("cand", score.alias("score")), F.struct(score, -F.col("ord"))).alias("b"))
    return best.select("label", "b.cand", "b.score")


@register(
    "SELECT doc_id, trim(regexp_replace(lower(translate(text, '–—−‐‑₂₃₄²³⁺⁻“”„’‘', '-----23423+-\"\"\"''''')), '\\s+', ' ', 'g')) AS normal FROM documents"
)
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@register(
    "WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN replace(printf('%.2f', o_totalprice), '.', ',') WHEN 1 THEN printf('%.2f', o_totalprice) WHEN 2 THEN 'MND' ELSE printf('%.2f', o_totalprice) || '*' END AS raw FROM orders) "
    "SELECT o_orderkey, raw, CASE WHEN raw = 'MND' THEN NULL ELSE try_cast(replace(rtrim(raw, '*'), ',', '.') AS DOUBLE) END AS value FROM x"
)
def parse_number(spark: SparkSession, d: str) -> DataFrame:
    plain = F.format_string("%.2f", "o_totalprice")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.translate(plain, ".", ",")).when(k == 1, plain).when(k == 2, "MND").otherwise(F.concat(plain, F.lit("*")))
    return t(spark, d, "orders").select("o_orderkey", raw.alias("raw")).withColumn("value", numbers.parse_number(F.col("raw")))


@register(
    "WITH x AS (SELECT o_orderkey, o_orderdate AS v, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y') END AS raw FROM orders) "
    "SELECT o_orderkey, raw, CASE o_orderkey % 3 WHEN 2 THEN strftime(v, '%Y-01-01') ELSE strftime(v, '%Y-%m-%d') END AS iso, "
    "CASE o_orderkey % 3 WHEN 0 THEN month(v) <= 12 AND day(v) <= 12 AND month(v) <> day(v) ELSE false END AS ambiguous FROM x"
)
def parse_date(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return t(spark, d, "orders").select("o_orderkey", raw.alias("raw")).withColumn("d", dates.parse_date(F.col("raw"))).select("o_orderkey", "raw", F.col("d.iso").cast("string").alias("iso"), "d.ambiguous")


@register(
    "WITH u(unit, quantity, factor) AS (VALUES ('kg', 'mass', 1.0), ('g', 'mass', 0.001), ('m2', 'area', 1.0), ('kwh', 'energy', 3.6)), "
    "p AS (SELECT p_partkey, p_size, CASE p_size % 5 WHEN 0 THEN 'kg' WHEN 1 THEN 'g' WHEN 2 THEN 'm2' WHEN 3 THEN 'kWh' ELSE 'barrel' END AS raw FROM part) "
    "SELECT p_partkey, raw, quantity, factor::DOUBLE AS factor, (p_size * factor)::DOUBLE AS amount FROM p LEFT JOIN u ON lower(raw) = unit"
)
def unit_lookup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 5
    raw = F.when(k == 0, "kg").when(k == 1, "g").when(k == 2, "m2").when(k == 3, "kWh").otherwise("barrel")
    rows = t(spark, d, "part").select("p_partkey", "p_size", raw.alias("raw")).withColumn("u", units.unit_quantity(F.col("raw")))
    return rows.select("p_partkey", "raw", "u.quantity", "u.factor", (F.col("p_size") * F.col("u.factor")).alias("amount"))


@register(
    "SELECT c_custkey, left(trim(regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '-.'), 80) AS slug, 'rec-' || left(sha256(c_name), 20) AS uid FROM customer"
)
def slug_uid(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return t(spark, d, "customer").select("c_custkey", text.slug(F.col("c_name")).alias("slug"), text.record_uid(none, none, none, F.col("c_name")).alias("uid"))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@register(
    "WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'Tot.A1-A3' WHEN 1 THEN 'C' || (1 + l_quantity::INT % 4) || '/' || (1 + l_linenumber % 3) WHEN 2 THEN 'B' || (1 + l_quantity::INT % 7) ELSE 'n/a' END AS header FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, header, CASE WHEN header = 'Tot.A1-A3' THEN 'A1-A3' ELSE nullif(regexp_extract(header, '^([BC][1-7])', 1), '') END AS module, nullif(regexp_extract(header, '^C[1-4]/([0-9])$', 1), '') AS scenario FROM x"
)
def module_header(spark: SparkSession, d: str) -> DataFrame:
    k, q = F.col("l_linenumber") % 4, F.round("l_quantity").cast("int")
    header = F.when(k == 0, "Tot.A1-A3").when(k == 1, F.concat(F.lit("C"), 1 + q % 4, F.lit("/"), 1 + F.col("l_linenumber") % 3)).when(k == 2, F.concat(F.lit("B"), 1 + q % 7)).otherwise("n/a")
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", header.alias("header")).withColumn("m", domain.module_header(F.col("header")))
    return rows.select("l_orderkey", "l_linenumber", "header", "m.module", "m.scenario")


@register("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 100")
def paging(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return search.page(rows, "c_acctbal", 50, 100, descending=True, key="c_custkey", allowed=["c_acctbal"])


@register("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def import_summary(spark: SparkSession, d: str) -> DataFrame:
    return store.import_summary(t(spark, d, "orders").select(F.col("o_orderstatus").alias("status")))


@register(
    "WITH x AS (SELECT event_id, user_id, ts, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800, true) AS fresh FROM events) "
    "SELECT event_id, user_id, CAST(sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM x"
)
def session_segments(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.col("ts").cast("timestamp").cast("double")
    gap = seconds - F.lag(seconds).over(w)
    rows = t(spark, d, "events").withColumn("fresh", F.coalesce(gap > 1800, F.lit(True)).cast("int"))
    return rows.select("event_id", "user_id", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))


@register("SELECT p_partkey, p_size::DOUBLE AS quantity, 'kg' AS unit, 'mass' AS dimension FROM part")
def declared_unit_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").select("p_partkey", units.parse_declared_unit(F.concat(F.col("p_size"), F.lit(" kg"))).alias("u"))
    return rows.select("p_partkey", "u.quantity", "u.unit", "u.dimension")


