"""Coverage of a field framework by items: which fields are there, which miss, which are beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import percent


def load_framework(rows: DataFrame) -> DataFrame:
    """Dimension table of a framework: one row per field (its last category wins), categories in first-seen order."""
    order = rows.groupBy("category").agg(F.min("category_pos").alias("category_pos"))
    fields = rows.groupBy("field").agg(F.max_by("category", F.struct("category_pos", "field_pos")).alias("category"), F.bool_or("required").alias("required"))
    return fields.join(order, "category").select("category", "category_pos", "field", "required")


def framework_counts(framework: DataFrame) -> DataFrame:
    return framework.agg(
        F.count_distinct("field").alias("total"),
        F.count_distinct(F.when(F.col("required"), F.col("field"))).alias("required"),
        F.count_distinct(F.when(~F.col("required"), F.col("field"))).alias("optional"),
    )


def field_status(fields: DataFrame, framework: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """``item_id, field, status, required, category`` with status ``covered``, ``missing`` or ``extra``; presence counts, not certainty.

    One pass per item instead of items x framework joined back: present names are gathered once and the
    framework, a small dimension, is compared as an array.
    """
    names = fields.groupBy("item_id").agg(F.array_sort(F.collect_set("field")).alias("have"))
    if items is not None:
        names = items.select("item_id").distinct().join(names, "item_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    whole = framework.agg(F.array_sort(F.collect_list(F.struct("field", "required", "category"))).alias("frame"))
    rows = names.join(F.broadcast(whole), F.lit(True), "left").withColumn("frame", F.coalesce("frame", F.array().cast("array<struct<field:string,required:boolean,category:string>>")))
    known = F.transform("frame", lambda f: F.struct(f["field"].alias("field"), F.when(F.array_contains("have", f["field"]), "covered").otherwise("missing").alias("status"), f["required"].alias("required"), f["category"].alias("category")))
    extra = F.transform(F.array_except("have", F.transform("frame", lambda f: f["field"])), lambda x: F.struct(x.alias("field"), F.lit("extra").alias("status"), F.lit(False).alias("required"), F.lit("Unknown").alias("category")))
    return rows.select("item_id", F.explode(F.concat(known, extra)).alias("s")).select("item_id", "s.*")


def item_coverage(fields: DataFrame, framework: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row per item: counts, rate, sorted name lists, ``valid`` (no required field is missing)."""
    s, is_ = field_status(fields, framework, items), lambda x: F.col("status") == x
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("field"))))
    out = s.groupBy("item_id").agg(
        F.count_if(~is_("extra")).alias("total_defined"), F.count_if(is_("covered")).alias("covered"), F.count_if(is_("missing")).alias("missing"), F.count_if(is_("extra")).alias("extra"),
        names(is_("missing") & F.col("required")).alias("missing_required"), names(is_("missing") & ~F.col("required")).alias("missing_optional"), names(is_("extra")).alias("extra_fields"),
    )
    return out.withColumn("coverage_rate", percent(F.col("covered"), F.col("total_defined"))).withColumn("valid", F.size("missing_required") == 0)


def missing_by_category(fields: DataFrame, framework: DataFrame) -> DataFrame:
    """``item_id`` with a map from category to its sorted missing fields."""
    s = field_status(fields, framework).filter("status = 'missing'")
    per = s.groupBy("item_id", "category").agg(F.array_sort(F.collect_list("field")).alias("fields"))
    return per.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "fields")))).alias("missing_by_category"))


def run_summary(coverage: DataFrame) -> DataFrame:
    """The gate of a run: passed, total, mean coverage (0 without items), whether all passed."""
    return coverage.agg(F.count_if("valid").alias("passed"), F.count(F.lit(1)).alias("total"), F.coalesce(F.avg("coverage_rate"), F.lit(0.0)).alias("mean_coverage"), F.coalesce(F.bool_and("valid"), F.lit(True)).alias("gate"))


def first_extras(coverage: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` extra names and how many more there are."""
    return coverage.select("item_id", F.slice("extra_fields", 1, n).alias("shown"), F.greatest(F.size("extra_fields") - n, F.lit(0)).alias("more"))


def cross_item_fields(fields: DataFrame) -> DataFrame:
    """Every field with its number of items and the kinds of its values."""
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value").rlike(r"^-?[0-9]+$"), "integer").otherwise("string")
    return fields.groupBy("field").agg(F.count_distinct("item_id").alias("n_items"), F.array_sort(F.collect_set(kind)).alias("kinds"))


def numbered(items: DataFrame, group: str, order: str) -> DataFrame:
    """1-based number of each row in the order of ``order``, within ``group`` (a whole-table numbering would be one task)."""
    return items.withColumn("no", F.row_number().over(Window.partitionBy(group).orderBy(order)))
