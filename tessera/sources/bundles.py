"""Health records as they are handed over: bundles of JSON resources, exports in XML, and files in ZIP archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

#: Code systems whose codes name the format of a document.
FORMAT_SYSTEMS = (
    "http://terminology.hl7.org/CodeSystem/v3-HL7DocumentFormatCodes",
    "http://ihe.net/fhir/ValueSet/IHE.FormatCode.codesystem",
    "http://ihe.net/fhir/ihe.formatcode.fhir/CodeSystem/formatcode",
)
#: Fixed value: how the codes of structured clinical documents begin.
STRUCTURED = "urn:hl7-org:sdwg:ccda-structuredBody:"

_RESOURCE = "resourceType string, id string, hasMember array<string>, category array<struct<coding array<struct<code string>>>>, content array<struct<format struct<system string, code string>>>"


def resources(spark: SparkSession, path: str) -> DataFrame:
    """`file, at, url, json` of the resources of bundles, a file each; a file that is no bundle is an error, an empty bundle gives no row."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "resourceType string, entry array<struct<fullUrl string, resource string>>").alias("b"))
    entries = F.when(F.col("b.resourceType") == "Bundle", F.col("b.entry")).otherwise(F.raise_error(F.concat(F.lit("not a bundle: "), F.col("file"))))
    return files.select("file", F.posexplode(entries).alias("at", "e")).select("file", "at", F.col("e.fullUrl").alias("url"), F.col("e.resource").alias("json")).where("json is not null")


def records(found: DataFrame, kinds: DataFrame) -> DataFrame:
    """`found` with `type, id, kind`: the kind that `kinds` (`type, category, kind`) names for the resource's type and a category, or for the type alone where its category is null.

    Left out are resources without a kind, observations that group others, and references to structured clinical
    documents, which are sources of their own. Of several fitting kinds that of the least category comes first.
    """
    r = F.from_json("json", _RESOURCE)
    rows = found.withColumn("_r", r).withColumn("type", F.col("_r.resourceType")).withColumn("id", F.col("_r.id"))
    codes = F.flatten(F.transform(F.coalesce("_r.category", F.array()), lambda c: F.coalesce(F.transform(c.coding, lambda x: x.code), F.array())))
    document = F.exists(F.coalesce("_r.content", F.array()), lambda c: F.coalesce(c.format.system.isin(*FORMAT_SYSTEMS) & c.format.code.startswith(STRUCTURED), F.lit(False)))
    panel = (F.col("type") == "Observation") & (F.coalesce(F.size("_r.hasMember"), F.lit(0)) > 0)
    rows = rows.where(~(panel | ((F.col("type") == "DocumentReference") & document))).withColumn("_codes", codes)
    of_type = kinds.groupBy("type").agg(F.array_sort(F.collect_set(F.struct(F.col("category").isNull().alias("last"), "category", "kind"))).alias("_kinds"))  # the kinds' table is a vocabulary
    fit = F.filter("_kinds", lambda k: k.category.isNull() | F.array_contains(F.col("_codes"), k.category))
    return rows.join(of_type, "type").withColumn("kind", F.try_element_at(fit, F.lit(1)).kind).where("kind is not null").select(*found.columns, "type", "id", "kind")


def exported(spark: SparkSession, export: str, files: str) -> DataFrame:
    """`path, type, source, received, json` of the records that an XML export lists; `json` is null where no file has the path's last two parts."""
    listed = spark.read.format("xml").option("rowTag", "ClinicalRecord").schema("_type string, _sourceName string, _receivedDate string, _resourceFilePath string").load(export)
    listed = listed.select(F.ltrim(F.col("_resourceFilePath"), F.lit("/")).alias("path"), F.col("_type").alias("type"), F.col("_sourceName").alias("source"), F.try_to_timestamp("_receivedDate", F.lit("yyyy-MM-dd HH:mm:ss Z")).alias("received"))
    texts = spark.read.text(files, wholetext=True).select(F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1).alias("path"), F.col("value").alias("json"))
    return listed.join(texts, "path", "left")


def _unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for entry in archive.infolist():  # one file at a time; a wrong checksum is an error
                    if not entry.is_dir():
                        yield pd.DataFrame({"archive": [path], "name": [entry.filename], "content": [archive.read(entry)]})


def archived(spark: SparkSession, path: str) -> DataFrame:
    """`archive, name, content` of the files of ZIP archives, an archive a task at most; a broken archive is an error."""
    packed = spark.read.format("binaryFile").load(path).select("path", "content")
    return packed.mapInPandas(_unpacked, "archive string, name string, content binary")
