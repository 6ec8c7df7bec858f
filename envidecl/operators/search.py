"""Search, paging, point look-ups, facets and statistics over the summary table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_all

SORTABLE = ["updated_at", "product_name", "manufacturer", "category_id", "valid_until", "gwp_a1_a3", "registration_number"]


def search(
    summary: DataFrame,
    text: str = "",
    category: str | None = None,
    manufacturer: str | None = None,
    standard: str | None = None,
    only_valid: bool = False,
    only_dgnb: bool = False,
    include_archived: bool = False,
    as_of: Column | None = None,
) -> DataFrame:
    """All conditions hold; an empty filter is none. Count it before paging."""
    out = summary
    if tokens := text.split():
        out = out.where(contains_all(F.col("search_text"), tokens))
    for column, value in (("category_id", category), ("manufacturer", manufacturer), ("standard_profile", standard)):
        if value:
            out = out.where(F.col(column) == value)
    if only_valid:
        today = F.current_date() if as_of is None else as_of
        out = out.where(F.col("valid_until").isNull() | (F.col("valid_until").cast("date") >= today))
    if only_dgnb:
        out = out.where("dgnb_ready = 1")
    return out if include_archived else out.where("archived = 0")


def page(rows: DataFrame, sort: str, limit: int, offset: int = 0, descending: bool = False, key: str = "epd_uid", allowed: list[str] | None = None) -> DataFrame:
    """One page, nulls last either way; ties in the order of the key, so pages neither overlap nor skip."""
    allowed = SORTABLE if allowed is None else allowed
    column = F.col(sort if sort in allowed else allowed[0])
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return rows.orderBy(order, F.col(key).asc()).offset(offset).limit(limit)


def facts_of(facts: DataFrame, uids: list[str] | DataFrame, indicators: list[str] | None = None, modules: list[str] | None = None) -> DataFrame:
    """Facts of the declarations in total order; no ids give none. A frame of ids is a semi join."""
    if isinstance(uids, DataFrame):
        out = facts.join(uids.select("epd_uid").distinct(), "epd_uid", "left_semi")
    else:
        out = facts.where(F.col("epd_uid").isin(uids) if uids else F.lit(False))
    if indicators:
        out = out.where(F.col("indicator").isin(indicators))
    if modules:
        out = out.where(F.col("module").isin(modules))
    return out.orderBy("epd_uid", "indicator", "module", "scenario")


def facet(rows: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    rows = rows if keep_null else rows.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def facets(rows: DataFrame, *columns: str) -> DataFrame:
    """All facets in one pass, by grouping sets."""
    sets = ", ".join(f"({c})" for c in columns)
    cases = " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in columns)
    values = ", ".join(f"CAST({c} AS string)" for c in columns)
    query = f"SELECT CASE {cases} END AS facet, coalesce({values}) AS value, count(*) AS n FROM {{rows}} GROUP BY GROUPING SETS ({sets})"
    return rows.sparkSession.sql(query, rows=rows.select(*columns))


def stats(summary: DataFrame, as_of: Column | None = None) -> DataFrame:
    today = F.current_date() if as_of is None else as_of
    active = F.col("archived") == 0
    valid = F.col("valid_until").isNull() | (F.col("valid_until").cast("date") >= today)
    return summary.agg(
        F.count("*").alias("total"),
        F.count_if(active).alias("active"),
        F.count_if(active & valid).alias("valid"),
        F.count_if(active & (F.col("dgnb_ready") == 1)).alias("dgnb"),
        F.count_if(active & (F.col("eco_platform") == 1)).alias("eco"),
    )
