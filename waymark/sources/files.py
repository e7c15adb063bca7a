"""Readers and writers: registry JSON, sitemaps, robots, approval history, stages, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.functions import scalar as S
from waymark.operators import registry as R

REGISTRY_SCHEMA = (
    "version int, universities array<struct<id:string, officialName:string, shortName:string, officialRootUrl:string, officialDomains:array<string>, "
    "trustedSubdomains:array<string>, allowedDomains:array<string>, pages:map<string,string>>>"
)
STAGES = ("raw", "extracted", "approved")


def normalize_entries(entries: DataFrame) -> DataFrame:
    """Two-list domain model; entries that only carry ``allowedDomains`` are read as official."""
    official = F.coalesce("officialDomains", "allowedDomains", S.str_array([]))
    trusted = F.coalesce("trustedSubdomains", S.str_array([]))
    return entries.withColumns({"officialDomains": official, "trustedSubdomains": trusted}).withColumn(
        "allowedDomains", R.allowed_domains(F.col("officialDomains"), F.col("trustedSubdomains")),
    )


def read_registry(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Registry entries from JSON files: one registry a line, or one spread over a file."""
    raw = spark.read.schema(REGISTRY_SCHEMA).json(path, multiLine=multi_line)
    return normalize_entries(raw.select(F.inline("universities")))


def decode_xml(c: Column) -> Column:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def sitemap_entries(documents: DataFrame) -> DataFrame:
    """Sitemap XML to (loc, lastmod, root kind); a flat list of <loc> still parses."""
    xml = F.col("xml")
    kind = F.when(xml.rlike(r"(?i)<sitemapindex[\s>]"), "index").when(xml.rlike(r"(?i)<urlset[\s>]"), "urlset").otherwise("unknown")
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:url|sitemap)\b[^>]*>.*?</(?:url|sitemap)>"), F.lit(0))
    flat = F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*[^<\s]+\s*</loc>"), F.lit(0))
    loc = F.regexp_extract("block", r"(?i)<loc>\s*([^<\s]+)\s*</loc>", 1)
    lastmod = F.regexp_extract("block", r"(?i)<lastmod>\s*([^<\s]+)\s*</lastmod>", 1)
    return (
        documents.withColumn("root_kind", kind)
        .withColumn("block", F.explode(F.when(F.size(blocks) > 0, blocks).otherwise(flat)))
        .withColumns({"loc": decode_xml(loc), "lastmod": F.when(lastmod != "", lastmod)})
        .where(F.col("loc") != "").drop("block", "xml")
    )


def robots_sitemaps(documents: DataFrame) -> DataFrame:
    lines = documents.withColumn("line", F.explode(F.split("text", "\r?\n"))).drop("text")
    target = F.regexp_extract("line", r"(?i)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)", 1)
    return lines.withColumn("sitemap_url", target).where(F.col("sitemap_url") != "").drop("line")


def stage_path(base: str, stage: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    return f"{base}/{stage}"


def write_stage(df: DataFrame, base: str, stage: str) -> str:
    """Raw and extracted outputs; the approved stage has its own writer."""
    if stage == "approved":
        raise PermissionError("only append_approved writes the approved stage")
    path = stage_path(base, stage)
    df.write.mode("overwrite").parquet(path)
    return path


def append_approved(events: DataFrame, base: str, confirm: bool = False) -> str:
    """Append approval events, partitioned by day; the history is never rewritten."""
    if not confirm:
        raise PermissionError("approval needs confirm=True")
    path = stage_path(base, "approved")
    events.withColumn("event_date", F.to_date("at")).write.mode("append").partitionBy("event_date").parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path
