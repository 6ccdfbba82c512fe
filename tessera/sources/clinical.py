"""Clinical documents in XML: what their headers say and what their sections hold, by Spark's XML reader and XPath functions."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions import terms

#: Where a document's header has what names it.
HEADER = {
    "id": "/ClinicalDocument/id/@extension",
    "system": "/ClinicalDocument/id/@root",
    "code": "/ClinicalDocument/code/@code",
    "title": "/ClinicalDocument/title",
    "time": "/ClinicalDocument/effectiveTime/@value",
    "author": "/ClinicalDocument/author/assignedAuthor/representedOrganization/id/@extension",
    "custodian": "/ClinicalDocument/custodian/assignedCustodian/representedCustodianOrganization/name",
}
_SECTION = "code struct<_code string, _codeSystem string, _displayName string>, title string, text string, entry array<string>"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """`file` with a column for each header field, null where a document doesn't have it, and `written`, its time as a day or in UTC."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    found = files.select("file", *(F.nullif(F.xpath_string("value", F.lit(p)), F.lit("")).alias(f) for f, p in HEADER.items()))
    return found.withColumn("written", terms.health_time(F.col("time")))


def sections(spark: SparkSession, path: str) -> DataFrame:
    """`file, code, system, title, text, n_entries` of the sections of documents; large files are split between sections."""
    rows = spark.read.format("xml").option("rowTag", "section").option("ignoreNamespace", "true").schema(_SECTION).load(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("code._code").alias("code"), F.col("code._codeSystem").alias("system"), "title", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), F.coalesce(F.size("entry"), F.lit(0)).alias("n_entries"))
