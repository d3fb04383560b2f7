"""Corpus manifests: nested JSON to one row for each version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.run import Tables

VERSION = "STRUCT<version: BIGINT, file: STRING, sourceType: STRING, status: STRING>"
MANIFEST = f"MAP<STRING, STRUCT<documents: MAP<STRING, STRUCT<currentVersion: BIGINT, versions: ARRAY<{VERSION}>>>>>"


def nested_manifest_explode(manifests: DataFrame) -> DataFrame:
    """(manifest_id, place, kb_id, document_id, version, file, source_type, status, deleted) from (manifest_id, manifest).

    A manifest maps bases to their documents, and these to versions. Rows are in the order of base, document and version, places
    from 0; a document without a current version is deleted. What isn't JSON of this form, null, and documents without versions
    give no row; repeated manifests of one id are numbered together; extra columns are ignored."""
    bases = manifests.select("manifest_id", F.explode(F.from_json("manifest", MANIFEST)).alias("kb_id", "base"))
    documents = bases.select("manifest_id", "kb_id", F.explode("base.documents").alias("document_id", "document"))
    versions = documents.select("manifest_id", "kb_id", "document_id", F.col("document.currentVersion").isNull().alias("deleted"), F.explode("document.versions").alias("v"))
    order = Window.partitionBy("manifest_id").orderBy("kb_id", "document_id", "v.version")
    place = (F.row_number().over(order) - 1).cast("long").alias("place")
    return versions.select("manifest_id", place, "kb_id", "document_id", "v.version", "v.file", F.col("v.sourceType").alias("source_type"), "v.status", "deleted")


def _exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of eight documents each."""
    tables = Tables(spark, sf_dir)
    held = tables["document_version"].join(tables["document"], "document_id")
    version = F.struct(F.col("version_no").cast("long").alias("version"), F.col("file_hash").alias("file"), F.lit("markdown").alias("sourceType"), F.when(F.col("version_id") == F.col("active_version_id"), "active").otherwise("superseded").alias("status"))
    current = F.max(F.when((F.col("version_id") == F.col("active_version_id")) & ~F.col("deleted"), F.col("version_no"))).cast("long")
    name = lambda c: F.col(c).cast("string")
    documents = held.groupBy(F.floor(F.col("document_id") / 8).alias("manifest_id"), "kb_id", "document_id").agg(current.alias("currentVersion"), F.collect_list(version).alias("versions"))
    bases = documents.groupBy("manifest_id", "kb_id").agg(F.map_from_entries(F.collect_list(F.struct(name("document_id"), F.struct("currentVersion", "versions")))).alias("documents"))
    whole = bases.groupBy("manifest_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(name("kb_id"), F.struct("documents"))))).alias("manifest"))
    return nested_manifest_explode(whole)


QUERIES = {"nested_manifest_explode": _exploded}
#: Straight from the tables that the manifests are made of.
ORACLES = {
    "nested_manifest_explode": """WITH v AS (SELECT doc_id AS version_id, CAST(floor(doc_id / 2) AS BIGINT) AS document_id, CAST(doc_id % 2 + 1 AS BIGINT) AS version, sha256(text) AS file FROM documents),
    d AS (SELECT DISTINCT document_id, document_id % 5 AS kb_id, document_id % 11 = 0 AS deleted, document_id * 2 + CASE WHEN document_id % 3 = 0 THEN 0 ELSE 1 END AS active FROM v),
    f AS (SELECT CAST(floor(v.document_id / 8) AS BIGINT) AS manifest_id, CAST(d.kb_id AS VARCHAR) AS kb_id, CAST(v.document_id AS VARCHAR) AS document_id, v.version, v.file, 'markdown' AS source_type, CASE WHEN v.version_id = d.active THEN 'active' ELSE 'superseded' END AS status,
        d.deleted OR NOT EXISTS (SELECT 1 FROM v o WHERE o.version_id = d.active) AS deleted FROM v JOIN d USING (document_id))
    SELECT manifest_id, CAST(row_number() OVER (PARTITION BY manifest_id ORDER BY kb_id, document_id, version) AS BIGINT) - 1 AS place, kb_id, document_id, version, file, source_type, status, deleted FROM f"""
}
