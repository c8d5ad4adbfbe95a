"""Item records as a long field table, in the report's and the validator's reading."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from dossier.functions.records import compact, parsed
from dossier.functions.text import MARK, strip
from dossier.session import spread

# Keys that are no fields, and category keys with their names.
RESERVED = ("name", "item", "category", "description", "slug", "uncertain", "missing", "sources", "citations", "verification", "failed", "_source_file")
SKIPPED = ("_source_file", "uncertain")
CATEGORIES = {
    "Basic Info": ("basic_info", "Basic Info", "基本信息"),
    "Technical Features": ("technical_features", "technical_characteristics", "Technical Features", "技术特性"),
    "Performance Metrics": ("performance_metrics", "performance", "Performance Metrics", "性能指标"),
    "Milestone Significance": ("milestone_significance", "milestones", "Milestone Significance", "里程碑意义"),
    "Business Info": ("business_info", "commercial_info", "Business Info", "商业信息"),
    "Competition & Ecosystem": ("competition_ecosystem", "competition", "Competition & Ecosystem", "竞争与生态"),
    "History": ("history", "History", "历史"),
    "Market Positioning": ("market_positioning", "market", "Market Positioning", "市场定位"),
}
OTHER = "Other Info"
# Category keys of the validator's reading.
VALIDATOR_KEYS = (
    "basic_info", "Basic Info",
    "technical_features", "technical_characteristics", "Technical Features",
    "performance_metrics", "performance", "Performance Metrics",
    "milestone_significance", "milestones", "Milestone Significance",
    "business_info", "commercial_info", "Business Info",
    "competition_ecosystem", "competition", "Competition Ecosystem",
    "history", "History",
    "market_positioning", "market", "Market Positioning",
)
def alias_rows() -> list[tuple[str, str]]:
    return [(alias, name) for name, aliases in CATEGORIES.items() for alias in aliases]


def category_aliases(builtin: DataFrame, framework: DataFrame, merge_aliases: bool = False) -> DataFrame:
    """``alias, canonical``: a framework category replaces the built-in aliases of its name; framework fields stand for their category where no category has that alias."""
    named = framework.select(F.col("category").alias("alias"), F.col("category").alias("canonical")).distinct()
    own = builtin if merge_aliases else builtin.join(named.select("canonical"), "canonical", "left_anti")
    fields = framework.groupBy("field").agg(F.max_by("category", F.struct("category_pos", "field_pos")).alias("canonical")).withColumnRenamed("field", "alias")
    ranked = own.select("alias", "canonical", F.lit(1).alias("r")).unionByName(named.withColumn("r", F.lit(2))).unionByName(fields.select("alias", "canonical", F.lit(0).alias("r")))
    return ranked.groupBy("alias").agg(F.max_by("canonical", "r").alias("canonical"))


#: Category keys that may be given; they come to the driver as one map.
MOST_ALIASES = 100_000


def _report_fields(record: dict, names: dict[str, str]) -> Iterator[tuple[list[int], str, str, object]]:
    """Place, category, key and value of each field, by a stack of the objects that are walked."""
    stack: list[tuple[list[int], dict]] = [([], record)]
    while stack:
        at, obj = stack.pop()
        for i, (key, value) in enumerate(obj.items()):
            if key in RESERVED:
                continue
            if not isinstance(value, dict):
                yield [*at, i], names.get(key, OTHER), key, value
            elif key in names:
                yield from (([*at, i, j], names[key], k, v) for j, (k, v) in enumerate(value.items()) if k not in RESERVED)
            else:
                stack.append(([*at, i], value))


def _validator_fields(record: object) -> set[str]:
    out: set[str] = set()
    stack = [x for x in (record if isinstance(record, list) else [record]) if isinstance(x, dict)]
    while stack:
        for key, value in stack.pop().items():
            if key in VALIDATOR_KEYS:
                stack += [value] * isinstance(value, dict)
            elif key not in SKIPPED:
                out.add(key)
    return out


def _walked(items: DataFrame, walk: Callable[[object], Iterable[tuple]], columns: str) -> DataFrame:
    """Rows ``item_id`` and ``columns`` that ``walk`` makes of each record, which is parsed once, over Arrow batches; malformed records have none."""
    rows = spread(items.select("item_id", "raw"))
    made = T.StructType.fromDDL(columns)
    kinds = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    found = list(walk(parsed(raw)))
                except ValueError:
                    continue
                at += [i] * len(found)
                out += found
            values = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(v, k) for v, k in zip(values, kinds, strict=True)]], names=["item_id", *made.names])

    return rows.mapInArrow(run, T.StructType([rows.schema["item_id"], *made.fields]))


def explode_fields(items: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The report's field table of ``items`` (``item_id, raw``): ``item_id, pos, category, field, value, raw, json_type, is_uncertain``.

    An alias key with an object gives its entries to that category; other objects are walked through, to any depth; an alias key with another
    value belongs to its category, the rest to :data:`OTHER`. Reserved keys are dropped at every level. Each record is parsed once and walked with a stack in its
    own row, so the plan is the same for records of any depth; ``raw`` is a value's text, of texts their content. The aliases are a dimension, ``MOST_ALIASES`` at most.
    """
    names = dict(alias_rows())
    if aliases is not None:
        found = aliases.select("alias", "canonical").limit(MOST_ALIASES + 1).collect()
        if len(found) > MOST_ALIASES:
            raise ValueError(f"over {MOST_ALIASES} category keys")
        names = {r["alias"]: r["canonical"] for r in found}

    def walk(record: object) -> Iterator[tuple]:
        if not isinstance(record, dict):
            return
        listed = record.get("uncertain")
        listed = {x for x in listed if isinstance(x, str)} if isinstance(listed, list) else set()
        for pos, category, key, value in _report_fields(record, names):
            json_text = compact(value)
            yield pos, category, key, json_text, value if isinstance(value, str) else None if value is None else json_text, key in listed

    rows = _walked(items, walk, "pos array<int>, category string, field string, value string, raw string, listed boolean").withColumn("value", F.try_parse_json("value"))
    kind = F.schema_of_variant("value")
    text = F.col("raw")
    doubt = text.isNull() | F.col("listed") | ((kind == "STRING") & ((strip(text) == "") | text.contains(MARK)))
    return rows.select("item_id", "pos", "category", "field", "value", "raw", kind.alias("json_type"), F.coalesce(doubt, F.lit(True)).alias("is_uncertain"))


def reportable(fields: DataFrame) -> DataFrame:
    """Certain fields, the last value of each (item, category, field) at its first position."""
    w = Window.partitionBy("item_id", "category", "field")
    certain = fields.filter(~F.col("is_uncertain"))
    ranked = certain.withColumns({"__first": F.min("pos").over(w), "__n": F.row_number().over(w.orderBy(F.desc("pos")))})
    return ranked.filter("__n = 1").withColumn("pos", F.col("__first")).drop("__first", "__n")


def field_names(items: DataFrame) -> DataFrame:
    """The validator's reading of ``items`` (``item_id, raw``): distinct ``item_id, field``.

    Category keys with an object are descended, to any depth, with another value ignored; every other key is a field, and its value isn't
    looked into. A list at the root stands for its objects.
    """
    return _walked(items, lambda record: ((name,) for name in sorted(_validator_fields(record))), "field string").distinct()
