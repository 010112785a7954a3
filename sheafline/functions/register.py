"""Functions for SQL, under their names in templates."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, return type, body): SQL functions, which Catalyst inlines.
FUNCTIONS = {
    "is_external_link": ("link STRING", "BOOLEAN", "link RLIKE '^https?:'"),
    "is_special_anchor": ("anchor STRING", "BOOLEAN", "lower(anchor) IN ('', 'top')"),
    "normalize_base_url": ("base STRING", "STRING", "concat(regexp_replace(base, '/+$', ''), '/')"),
    "slug_ascii": ("s STRING", "STRING", "trim(BOTH '-' FROM regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-'))"),
    "escape_xml": ("s STRING", "STRING", "replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"),
    "strip_tags": ("s STRING", "STRING", "replace(regexp_replace(s, '<[^>]*(>|$)', ''), '>', '')"),
    "reading_minutes": ("n BIGINT, lang STRING", "BIGINT", "ceil(n / CASE split_part(lang, '-', 1) WHEN 'en' THEN 238 WHEN 'ko' THEN 202 WHEN 'zh' THEN 439 WHEN 'ja' THEN 653 ELSE 200 END)"),
    "needs_templating": ("s STRING", "BOOLEAN", "contains(s, '{{') OR contains(s, '{%')"),
    "content_hash": ("body STRING", "STRING", "sha2(regexp_replace(regexp_replace(body, '^\\\\s+', ''), '\\\\s+$', ''), 256)"),
    "get_hash": ("s STRING", "STRING", "base64(unhex(sha2(s, 384)))"),
    "matching": ("s STRING, pattern STRING", "BOOLEAN", "s RLIKE pattern"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session's SQL; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
