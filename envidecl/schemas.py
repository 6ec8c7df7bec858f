"""Schemas of the facts, dimensions and nested records."""

from __future__ import annotations

FACT_RESULT = (
    "epd_uid string, indicator string, module string, scenario string, value double, status string, unit string, raw_value string, "
    "raw_unit string, source_page int, source_table string, confidence double, extraction_method string, provenance string, human_edited boolean"
)
RESULT_COLUMNS = [c.split()[0] for c in FACT_RESULT.split(", ")]
VALUE = (
    "struct<value:double,status:string,provenance:string,raw_value:string,raw_unit:string,raw_indicator_label:string,raw_module_header:string,"
    "source_page:int,source_table:string,confidence:double,extraction_method:string,scenario:string,note:string,human_edited:boolean>"
)
INDICATOR = f"struct<method_profile:string,canonical_unit:string,modules:map<string,{VALUE}>,scenario_modules:map<string,map<string,{VALUE}>>>"
RECORD = (
    "epd_uid string, metadata struct<registration_number:string,product_name:string,manufacturer:string,programme_operator:string,declared_unit_raw:string,"
    "standard_profile:string,standard:string,publication_date:string,valid_until:string,reference_service_life_years:double,mass_per_declared_unit_kg:double,"
    "conversion_factor_to_1kg:double,pcr:string,product_category:string,product_description:string,ilcd_classification:string,ilcd_subtype:string,"
    "geographical_scope:string,verification:string,language:string,uuid:string,verifier:string,iso14025:boolean,reference_service_life_status:string>, "
    f"results map<string,{INDICATOR}>, declared map<string,string>, source_format string, file_sha256 string, full_text string"
)
FACT_VERSION = "epd_uid string, version int, saved_at timestamp, content_hash string, note string, archived boolean, record string"
PAGE = (
    "struct<page_number:int,width:double,height:double,text:string,words:array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>,"
    "tables:array<struct<table_number:int,cells:array<array<string>>>>,has_text:boolean>"
)
RAW_DOCUMENT = f"doc_id string, pages array<{PAGE}>, title_lines array<struct<text:string,size:double,y0:double>>"
