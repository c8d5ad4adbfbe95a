"""Scans of item records, their sidecars and frameworks; sinks of results, reports and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import stem
from dossier.operators.numbering import numbered

SIDECAR = ".verification.json"


def read_texts(spark: SparkSession, path: str | list[str], glob: str = "*.json") -> DataFrame:
    """``file_name, modified, raw`` of whole files; paths that are absent, and files that vanish meanwhile, are left out."""
    there = [p for p in ([path] if isinstance(path, str) else path) if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "file_name string, modified timestamp, raw string")
    rows = spark.read.option("pathGlobFilter", glob).option("ignoreMissingFiles", "true").text(there, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("raw"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def in_order(texts: DataFrame) -> DataFrame:
    """Files with their 1-based number in the order of names: names alone are sorted and numbered, over ranges of them, and joined back."""
    return texts.join(numbered(texts.select("file_name").distinct(), "file_name"), "file_name")


def parse_items(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Item records (``slug, file_name, raw, doc``) and the quarantine (``file_name, reason``): malformed text, or not an object."""
    rows = texts.filter(~F.col("file_name").endswith(SIDECAR)).withColumn("doc", F.try_parse_json("raw")).withColumn("slug", stem(F.col("file_name")))
    reason = F.when(F.col("doc").isNull(), "malformed").when(~F.schema_of_variant("doc").startswith("OBJECT"), "not an object")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason IS NULL").select("slug", "file_name", "raw", "doc"), rows.filter("reason IS NOT NULL").select("file_name", "reason")


def parse_sidecars(texts: DataFrame) -> DataFrame:
    """``slug, confidence, conflicts, notes``; unreadable sidecars are empty; a single note is a list of one."""
    schema = "struct<confidence:string,conflicts:array<string>,notes:string>"
    rows = texts.filter(F.col("file_name").endswith(SIDECAR)).select(F.regexp_replace("file_name", r"\.verification\.json$", "").alias("slug"), F.from_json("raw", schema).alias("v"))
    notes = F.coalesce(F.from_json("v.notes", "array<string>"), F.when(F.col("v.notes").isNotNull(), F.array("v.notes")), F.array().cast("array<string>"))
    return rows.select("slug", "v.confidence", F.coalesce("v.conflicts", F.array().cast("array<string>")).alias("conflicts"), notes.alias("notes"))


def latest(texts: DataFrame) -> DataFrame:
    """The document that was changed last (by name where several were)."""
    return texts.agg(F.max_by("file_name", F.struct("modified", "file_name")).alias("file_name"))


def write_results(results: DataFrame, path: str, by: str = "batch") -> None:
    """Result records as JSON text, one folder per batch; a batch written again replaces itself alone."""
    payload = F.to_json(F.struct(*[c for c in results.columns if c != by]))
    results.select(payload.alias("value"), by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as one text in parts: sorted by all columns but ``line``, dealt by ranges of them, so that the part files in their order are the text."""
    order = [c for c in lines.columns if c != "line"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def valid_page_name(name: Column) -> Column:
    """Whether a page's name is a bare file name that ends in ``.html``."""
    return name.rlike(r"^[^/\\]+\.html$")


def manifest(pages: DataFrame) -> DataFrame:
    """``path, bytes, title, warnings`` of rendered pages (``path, title, html``); bytes are those of UTF-8."""
    warn = F.array_compact(F.array(F.when(~valid_page_name(F.col("path")), F.lit("name")), F.when(~F.lower("html").contains("<!doctype html>"), F.lit("doctype"))))
    return pages.select("path", F.octet_length("html").cast("long").alias("bytes"), "title", warn.alias("warnings"))


FRAMEWORK = "struct<field_categories:array<struct<category:string,fields:array<struct<name:string,description:string,detail_level:string,required:boolean>>>>>"


def parse_framework(texts: DataFrame) -> DataFrame:
    """Framework rows ``category, category_pos, field, field_pos, description, detail_level, required`` of JSON framework files."""
    rows = texts.select(F.posexplode(F.from_json("raw", FRAMEWORK)["field_categories"]).alias("category_pos", "c"))
    rows = rows.select("category_pos", F.col("c.category").alias("category"), F.posexplode("c.fields").alias("field_pos", "f"))
    return rows.select("category", "category_pos", F.col("f.name").alias("field"), "field_pos", "f.description", "f.detail_level", F.coalesce("f.required", F.lit(False)).alias("required"))


OUTLINE = "struct<topic:string,items:array<struct<name:string,category:string,description:string>>,execution:struct<batch_size:int,items_per_agent:int,output_dir:string>>"


def parse_outline(texts: DataFrame) -> DataFrame:
    """Outline rows ``topic, pos, name, category, description`` of JSON outline files."""
    rows = texts.select(F.from_json("raw", OUTLINE).alias("o"))
    return rows.select("o.topic", F.posexplode("o.items").alias("pos", "i")).select("topic", "pos", "i.*")


def parse_execution(texts: DataFrame) -> DataFrame:
    """Execution settings ``topic, batch_size, items_per_agent, output_dir`` of JSON outline files, one item a batch and agent and ``results`` where they are absent."""
    o = texts.select(F.from_json("raw", OUTLINE).alias("o")).select("o.topic", "o.execution.*")
    return o.select("topic", F.coalesce("batch_size", F.lit(1)).alias("batch_size"), F.coalesce("items_per_agent", F.lit(1)).alias("items_per_agent"), F.coalesce("output_dir", F.lit("results")).alias("output_dir"))
