"""All registered queries of the evidence-table operators and their SQL.

Each query applies an operator to whole tables. Names start with the operator's row in the inventory. Lists are compared as joined
text, shares as whole numbers or fixed decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import text as X
from dossier.functions.values import as_markdown
from dossier.operators import coverage, decks, evidence, flatten, merge, numbering, report, review, specs
from dossier.plans.fixtures import FIXTURES, Fixtures, oracle
from dossier.session import configured, scratch_dir
from dossier.sources import files, reports
from dossier.sources import items as scan
from dossier.streaming import events as stream

Query = Callable[[Fixtures], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = oracle(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Fixtures(configured(spark), sf_dir))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def joined(c, sep: str = ","):
    return F.array_join(c, sep)


def _cover(fx: Fixtures) -> DataFrame:
    return coverage.item_coverage(fx("fx_field"), coverage.load_framework(fx("fx_framework")))


# -- scans and sources ---------------------------------------------------------------------------------------

_ITEM_TEXTS = """SELECT concat('part_', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 9 = 0 THEN '.verification.json' ELSE '.json' END) AS file_name, p_partkey AS item_id,
 CASE WHEN p_partkey % 50 = 1 THEN '{{broken' WHEN p_partkey % 50 = 2 THEN '[1]' ELSE concat('{{"name":"', p_name, '","v":', CAST(p_size AS STRING), '}}') END AS raw FROM {part}"""


def _item_texts(fx: Fixtures) -> DataFrame:
    return fx.sql(_ITEM_TEXTS.replace("{{", "\x01").replace("}}", "\x02")).withColumn("raw", F.translate("raw", "\x01\x02", "{}"))


@register("s1_item_scan", "SELECT concat('part_', CAST(p_partkey AS STRING)) AS slug, p_size AS v FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 50 NOT IN (1, 2)")
def s1(fx):
    good, _ = scan.parse_items(_item_texts(fx))
    return good.select("slug", F.variant_get("doc", "$.v", "int").alias("v"))


@register("s3_quarantine", "SELECT concat('part_', CAST(p_partkey AS STRING), '.json') AS file_name, CASE WHEN p_partkey % 50 = 1 THEN 'malformed' ELSE 'not an object' END AS reason FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 50 IN (1, 2)")
def s3(fx):
    return scan.parse_items(_item_texts(fx))[1]


@register("s5_framework", "SELECT category, min(category_pos) AS category_pos, string_agg(field, ',' ORDER BY field) AS fields FROM fx_framework GROUP BY category")
def s5(fx):
    f = coverage.load_framework(fx("fx_framework"))
    return f.groupBy("category").agg(F.min("category_pos").alias("category_pos"), joined(F.array_sort(F.collect_list("field"))).alias("fields"))


@register("s7_results", "SELECT p_partkey AS item_id, p_name AS name, CAST(p_partkey % 10 AS INT) AS batch FROM part")
def s7(fx):
    """Results written as JSON text, one folder a batch, a batch of them written again, and read back."""
    where = scratch_dir(fx.spark, "results")
    rows = fx("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 10).cast("int").alias("batch"))
    scan.write_results(rows.withColumn("name", F.when(F.col("batch") == 3, "old").otherwise(F.col("name"))), where)
    scan.write_results(rows.filter("batch = 3"), where)
    back = fx.spark.read.schema("value string, batch int").text(where)
    return back.select(F.from_json("value", "item_id long, name string").alias("r"), "batch").select("r.*", "batch")


@register("s9_page_manifest", "SELECT concat('page_', CAST(page_id AS STRING), '.html') AS path, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, CASE WHEN contains(lower(html), '<!doctype html>') THEN '' ELSE 'doctype' END AS warnings FROM pages")
def s9(fx):
    rows = fx("pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("").alias("title"), "html")
    return scan.manifest(rows).select("path", "bytes", joined("warnings").alias("warnings"))


@register("l1_files_in_order", "SELECT file_name, CAST(row_number() OVER (ORDER BY file_name) AS BIGINT) AS no FROM (SELECT 'page_' || page_id || '.json' AS file_name FROM pages)")
def l1(fx):
    return scan.in_order(fx("pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".json")).alias("file_name"))).select("file_name", "no")


@register("w1_items_in_order", "SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_name, p_partkey) AS no FROM part")
def w1_items(fx):
    return numbering.numbered(fx("part").select(F.col("p_partkey").alias("item_id"), "p_name"), "p_name", "item_id").select("item_id", "no")


@register("s6_outlines", "SELECT o_custkey AS topic, count(*) AS n_items, CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE 1 END AS batch_size, 1 AS items_per_agent, 'results' AS output_dir FROM orders GROUP BY o_custkey")
def s6(fx):
    """Outlines as JSON files, one a customer, read back: their items and execution settings."""
    items = F.array_join(F.collect_list(F.concat(F.lit('{"name":"'), F.col("o_orderkey").cast("string"), F.lit('"}'))), ",")
    execution = F.when(F.col("o_custkey") % 2 == 0, F.lit(',"execution":{"batch_size":3}')).otherwise(F.lit(""))
    texts = fx("orders").groupBy("o_custkey").agg(items.alias("i")).select(F.concat(F.lit('{"topic":"'), F.col("o_custkey").cast("string"), F.lit('","items":['), "i", F.lit("]"), execution, F.lit("}")).alias("raw"))
    counted = scan.parse_outline(texts).groupBy("topic").agg(F.count("name").alias("n_items"))
    return counted.join(scan.parse_execution(texts), "topic").withColumn("topic", F.col("topic").cast("long"))


@register("s12_latest_page", "SELECT max_by(url, page_id) AS file_name FROM pages")
def s12(fx):
    return scan.latest(fx("pages").select(F.col("url").alias("file_name"), F.col("page_id").alias("modified")))


# -- flattening ----------------------------------------------------------------------------------------------

_RAW = """SELECT p_partkey AS item_id, to_json(named_struct('name', p_name, 'basic_info', named_struct('brand', p_brand, 'kind', p_type), 'performance', named_struct('size', p_size), 'price', p_retailprice,
 'uncertain', CASE WHEN p_partkey % 11 = 0 THEN array('kind') ELSE array() END), map('ignoreNullFields', 'false')) AS raw FROM {part}"""


@register("f1_field_table", """SELECT p_partkey AS item_id, 'Basic Info' AS category, 'brand' AS field, p_brand AS raw, 'STRING' AS json_type, false AS is_uncertain FROM part
 UNION ALL SELECT p_partkey, 'Basic Info', 'kind', p_type, 'STRING', p_partkey % 11 = 0 FROM part UNION ALL SELECT p_partkey, 'Performance Metrics', 'size', CAST(p_size AS STRING), 'BIGINT', false FROM part
 UNION ALL SELECT p_partkey, 'Other Info', 'price', CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS STRING), 'NUMBER', false FROM part""")
def f1(fx):
    price = F.col("field") == "price"  # its text and decimal type depend on the figure
    raw = F.when(price, F.round(F.col("raw").try_cast("double") * 100).cast("long").cast("string")).otherwise(F.col("raw"))
    kind = F.when(price & F.col("json_type").rlike("^(DECIMAL|DOUBLE|BIGINT)"), "NUMBER").otherwise(F.col("json_type"))
    return flatten.explode_fields(fx.sql(_RAW)).select("item_id", "category", "field", raw.alias("raw"), kind.alias("json_type"), "is_uncertain")


@register("f2_validator_fields", """SELECT p_partkey AS item_id, unnest(['brand', 'kind', 'name', 'price', 'size']) AS field FROM part""")
def f2(fx):
    return flatten.field_names(fx.sql(_RAW))


@register("f4_uncertain_fields", "SELECT item_id, field FROM fx_field WHERE value IS NULL OR trim(value) = '' OR contains(value, '[uncertain]')")
def f4(fx):
    return fx("fx_field").filter(X.is_uncertain(F.col("value"))).select("item_id", "field")


@register("w6_last_value_wins", """SELECT item_id, path, max_by(value, seq) AS value, min(seq) AS pos FROM fx_round WHERE value IS NOT NULL AND NOT contains(value, '[uncertain]') GROUP BY ALL""")
def w6(fx):
    rows = fx("fx_round").select("item_id", F.col("seq").alias("pos"), F.lit("c").alias("category"), F.col("path").alias("field"), "value", X.is_uncertain(F.col("value")).alias("is_uncertain"))
    return flatten.reportable(rows).select("item_id", F.col("field").alias("path"), "value", "pos")


@register("a17_field_discovery", "SELECT field, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CASE WHEN value IS NULL THEN 'null' WHEN regexp_full_match(value, '-?[0-9]+') THEN 'integer' ELSE 'string' END, ',' ORDER BY CASE WHEN value IS NULL THEN 'null' WHEN regexp_full_match(value, '-?[0-9]+') THEN 'integer' ELSE 'string' END) AS kinds FROM fx_field GROUP BY field")
def a17(fx):
    return coverage.cross_item_fields(fx("fx_field")).withColumn("kinds", joined("kinds"))


# -- coverage ------------------------------------------------------------------------------------------------

_STATUS = """SELECT i.item_id, f.field, CASE WHEN h.field IS NULL THEN 'missing' ELSE 'covered' END AS status, f.required, f.category FROM (SELECT DISTINCT item_id FROM fx_field) i CROSS JOIN fx_framework f
 LEFT JOIN (SELECT DISTINCT item_id, field FROM fx_field) h ON h.item_id = i.item_id AND h.field = f.field
 UNION ALL SELECT DISTINCT item_id, field, 'extra', false, 'Unknown' FROM fx_field WHERE field NOT IN (SELECT field FROM fx_framework)"""
_NAMES = "coalesce(string_agg(field, ',' ORDER BY field) FILTER ({}), '')"
_COVER = f"""SELECT item_id, count(*) FILTER (status <> 'extra') AS total_defined, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extra,
 {_NAMES.format("status = 'missing' AND required")} AS missing_required, {_NAMES.format("status = 'missing' AND NOT required")} AS missing_optional, {_NAMES.format("status = 'extra'")} AS extra_fields,
 count(*) FILTER (status = 'covered') * 100.0::DOUBLE / count(*) FILTER (status <> 'extra') AS coverage_rate, count(*) FILTER (status = 'missing' AND required) = 0 AS valid FROM ({_STATUS}) GROUP BY item_id"""


@register("j3_field_status", _STATUS)
def j3(fx):
    return coverage.field_status(fx("fx_field"), coverage.load_framework(fx("fx_framework"))).select("item_id", "field", "status", "required", "category")


@register("a1_item_coverage", _COVER)
def a1(fx):
    return _cover(fx).withColumns({c: joined(c) for c in ("missing_required", "missing_optional", "extra_fields")})


@register("a2_missing_by_category", f"SELECT item_id, string_agg(category || ':' || fields, ';' ORDER BY category) AS missing FROM (SELECT item_id, category, string_agg(field, ',' ORDER BY field) AS fields FROM ({_STATUS}) WHERE status = 'missing' GROUP BY ALL) GROUP BY item_id")
def a2(fx):
    m = coverage.missing_by_category(fx("fx_field"), coverage.load_framework(fx("fx_framework")))
    return m.select("item_id", joined(F.array_sort(F.transform(F.map_entries("missing_by_category"), lambda e: F.concat(e["key"], F.lit(":"), joined(e["value"])))), ";").alias("missing"))


@register("a3_run_summary", f"SELECT count(*) FILTER (valid) AS passed, count(*) AS total, CAST(round(avg(coverage_rate) * 1000) AS BIGINT) AS mean_coverage, bool_and(valid) AS gate FROM ({_COVER})")
def a3(fx):
    return coverage.run_summary(_cover(fx)).withColumn("mean_coverage", F.round(F.col("mean_coverage") * 1000).cast("long"))


@register("l4_first_extras", """SELECT item_id, array_to_string(list_sort(list(field))[1:10], ',') AS shown, CAST(greatest(count(*) - 10, 0) AS INT) AS more FROM (SELECT item_id, field FROM fx_field WHERE field NOT IN (SELECT field FROM fx_framework) UNION ALL
 SELECT p_partkey, 'extra_' || CAST(k AS STRING) FROM part, range(15) r(k) WHERE k < p_partkey % 15) GROUP BY item_id UNION ALL SELECT DISTINCT item_id, '', 0 FROM fx_field WHERE item_id % 15 = 0 AND item_id NOT IN (SELECT item_id FROM fx_field WHERE field NOT IN (SELECT field FROM fx_framework))""")
def l4(fx):
    extra = fx("part").filter("p_partkey % 15 > 0").select(F.col("p_partkey").alias("item_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p_partkey") % 15 - 1)).alias("k"))
    fields = fx("fx_field").select("item_id", "field").unionByName(extra.select("item_id", F.concat(F.lit("extra_"), F.col("k").cast("string")).alias("field")))
    return coverage.first_extras(coverage.item_coverage(fields, coverage.load_framework(fx("fx_framework")))).withColumn("shown", joined("shown"))


@register("a4_framework_counts", "SELECT count(DISTINCT field) AS total, 0 AS required, count(DISTINCT field) AS optional FROM fx_field WHERE field NOT IN (SELECT field FROM fx_framework) UNION ALL SELECT count(DISTINCT field), count(DISTINCT field) FILTER (required), count(DISTINCT field) FILTER (NOT required) FROM fx_framework JOIN (SELECT DISTINCT field FROM fx_field) USING (field)")
def a4(fx):
    """Counts of the fields that the items have: those beyond the framework (none is required), and those of it."""
    have = fx("fx_field").select("field").distinct()
    frame = coverage.load_framework(fx("fx_framework"))
    beyond = have.join(frame, "field", "left_anti").withColumn("required", F.lit(False))
    return coverage.framework_counts(beyond).unionByName(coverage.framework_counts(frame.join(have, "field", "left_semi")))


@register("j2_category_aliases", "SELECT item_id, alias, CASE alias WHEN 'Basic Info' THEN 'Basic Info' WHEN 'basic_info' THEN 'basic_info' WHEN 'brand' THEN 'basic_info' WHEN 'size' THEN 'performance_metrics' WHEN 'market' THEN 'Market Positioning' END AS canonical FROM (SELECT DISTINCT item_id FROM fx_field), (SELECT unnest(['Basic Info', 'basic_info', 'brand', 'size', 'market']) AS alias)")
def j2(fx):
    """The categories of some keys of every item: built-in aliases, overlaid by the framework's categories, with its fields where no category has that name."""
    builtin = fx.spark.createDataFrame(flatten.alias_rows(), "alias string, canonical string")
    known = flatten.category_aliases(builtin, fx("fx_framework"))
    keys = fx("fx_field").select("item_id").distinct().withColumn("alias", F.explode(F.array(*[F.lit(k) for k in ("Basic Info", "basic_info", "brand", "size", "market")])))
    return keys.join(F.broadcast(known), "alias", "left").select("item_id", "alias", "canonical")


@register("f9_completed_items", f"SELECT item_id FROM ({_COVER}) WHERE valid")
def f9(fx):
    return _cover(fx).filter("valid").select("item_id")


@register("x12_percent", f"SELECT item_id, printf('%.1f', coverage_rate) AS rate, concat(covered, '/', total_defined) AS share FROM ({_COVER})")
def x12(fx):
    return _cover(fx).select("item_id", X.one_decimal(F.col("coverage_rate")).alias("rate"), F.concat("covered", F.lit("/"), "total_defined").alias("share"))


# -- merging -------------------------------------------------------------------------------------------------


@register("j4_resume", "SELECT DISTINCT c_custkey AS item_id FROM customer WHERE c_custkey NOT IN (SELECT item_id FROM fx_round)")
def j4(fx):
    return merge.remaining(fx("customer").select(F.col("c_custkey").alias("item_id")), fx("fx_round"), "item_id")


@register("j5_append_items", "SELECT k, name FROM fx_before UNION ALL SELECT k, name FROM fx_after WHERE k NOT IN (SELECT k FROM fx_before)")
def j5(fx):
    return merge.append_new(fx("fx_before").select("k", "name"), fx("fx_after").select("k", "name"), "k")


@register("j6_overlay", "SELECT k, n_lines FROM fx_after UNION ALL SELECT k, n_lines FROM fx_before WHERE k NOT IN (SELECT k FROM fx_after)")
def j6(fx):
    return merge.overlay(fx("fx_before").select("k", "n_lines"), fx("fx_after").select("k", "n_lines"), "k")


_LEAVES = """(SELECT item_id, path, max_by(value, seq) AS value FROM fx_round WHERE round_no = {} GROUP BY ALL)"""


@register("j7_deep_merge", f"SELECT coalesce(r.item_id, l.item_id) AS item_id, coalesce(r.path, l.path) AS path, CASE WHEN r.path IS NOT NULL THEN r.value ELSE l.value END AS value FROM {_LEAVES.format(1)} l FULL JOIN {_LEAVES.format(2)} r ON l.item_id = r.item_id AND l.path = r.path")
def j7(fx):
    leaves = lambda n: fx("fx_round").filter(f"round_no = {n}").groupBy("item_id", "path").agg(F.max_by("value", "seq").alias("value"))
    return merge.merge_leaves(leaves(1), leaves(2))


@register("j7_merged_documents", """SELECT p_partkey AS item_id, CASE WHEN p_partkey % 4 = 0 THEN '{"a":{"x":' || p_size || ',"y":"' || p_brand || '"},"n":[1,{"q":0}]}' WHEN p_partkey % 4 = 1 THEN '{"a":{"y":null,"z":{"w":"' || p_type || '"}},"n":[2],"m":true}'
 ELSE '{"a":{"x":' || p_size || ',"y":null,"z":{"w":"' || p_type || '"}},"n":[2],"m":true}' END AS raw FROM part""")
def j7_documents(fx):
    """Whole documents merged by key: pairs, left ones alone, right ones alone."""
    brand, kind = F.col("p_brand"), F.col("p_type")
    left = F.concat(F.lit('{"a":{"x":'), F.col("p_size").cast("string"), F.lit(',"y":"'), brand, F.lit('"},"n":[1,{"q":0}]}'))
    right = F.concat(F.lit('{"a":{"y":null,"z":{"w":"'), kind, F.lit('"}},"n":[2],"m":true}'))
    of = lambda use, raw: fx("part").filter(use).select(F.col("p_partkey").alias("item_id"), raw.alias("raw"))
    return merge.merge_documents(of("p_partkey % 4 <> 1", left), of("p_partkey % 4 <> 0", right))


_ROUNDS = """WITH last AS (SELECT item_id, round_no, path, max_by(value, seq) AS value FROM fx_round GROUP BY ALL),
 per AS (SELECT item_id, NOT bool_or(round_no = 1) AS failed, bool_or(round_no = 1) AND bool_or(round_no = 1 AND contains(value, '[uncertain]')) AND bool_or(round_no = 2) AS refined FROM last GROUP BY item_id)
 SELECT item_id, failed, CASE WHEN refined THEN 2 ELSE 1 END AS rounds_used, path, max_by(value, round_no) AS value FROM last JOIN per USING (item_id) WHERE NOT failed AND (round_no <> 2 OR refined) GROUP BY ALL
 UNION ALL SELECT item_id, true, 0, NULL, NULL FROM per WHERE failed"""


@register("j10_resolve_rounds", _ROUNDS)
def j10(fx):
    return merge.resolve_rounds(fx("fx_round"))


@register("a10_rounds_used", f"SELECT rounds_used, count(DISTINCT item_id) AS n FROM ({oracle(_ROUNDS)}) GROUP BY rounds_used")
def a10(fx):
    return merge.resolve_rounds(fx("fx_round")).groupBy("rounds_used").agg(F.count_distinct("item_id").alias("n"))


@register("a9_batch_rollup", f"SELECT item_id % 10 AS batch, count(*) AS total, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT failed) AS ok, count(*) FILTER (NOT failed AND unsure) AS uncertain, count(*) FILTER (NOT failed AND confidence = 'low') AS low_confidence, count(*) FILTER (NOT failed AND n_conflicts > 0) AS conflicts FROM (SELECT item_id, failed, bool_or(contains(coalesce(value, ''), '[uncertain]')) AS unsure FROM ({oracle(_ROUNDS)}) GROUP BY ALL) LEFT JOIN ({FIXTURES['fx_sidecar'].replace('{', '').replace('}', '')}) USING (item_id) GROUP BY 1")
def a9(fx):
    rows = merge.resolve_rounds(fx("fx_round")).groupBy("item_id", "failed").agg(F.bool_or(F.coalesce("value", F.lit("")).contains(X.MARK)).alias("uncertain"))
    rows = evidence.with_verification(rows, fx("fx_sidecar")).withColumns({"batch": F.col("item_id") % 10, "low_confidence": F.col("confidence") == "low", "conflicts": F.col("n_conflicts") > 0})
    return merge.batch_rollup(rows, "batch", ("uncertain", "low_confidence", "conflicts"))


@register("f7_gap_rows", f"SELECT item_id, field || ' (missing)' AS gap FROM ({_STATUS}) WHERE status = 'missing' UNION ALL SELECT item_id, field || ' (uncertain)' FROM fx_field WHERE value IS NULL OR contains(value, '[uncertain]')")
def f7(fx):
    fields = fx("fx_field")
    missing = coverage.field_status(fields, coverage.load_framework(fx("fx_framework"))).filter("status = 'missing'")
    return merge.gaps(missing, fields.filter(X.is_uncertain(F.col("value"))))


@register("o4_source_union", "SELECT item_id, string_agg(url, ',' ORDER BY ord, url) AS sources FROM (SELECT item_id, url, min(ord) AS ord FROM fx_source GROUP BY ALL) GROUP BY item_id")
def o4(fx):
    return merge.union_sources(fx("fx_source"), "item_id", "url", "ord").select("item_id", joined("sources").alias("sources"))


@register("w8_batches", "SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 6) AS BIGINT) AS batch, CAST(floor(((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 6) / 2) AS BIGINT) AS agent FROM orders")
def w8(fx):
    return merge.batches(fx("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3, 2).select("o_orderkey", "batch", "agent")


@register("x16_defaults", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'n/a' ELSE c_mktsegment END AS category, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS description FROM customer")
def x16(fx):
    return merge.with_defaults(fx("customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("category"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("description")))


# -- sources, citations, confidence --------------------------------------------------------------------------

_NUMBERED = "(SELECT item_id, url, row_number() OVER (PARTITION BY item_id ORDER BY ord, url) AS n FROM fx_source)"


@register("j1_with_verification", "SELECT p_partkey AS item_id, confidence, n_conflicts FROM part LEFT JOIN fx_sidecar ON p_partkey = item_id")
def j1(fx):
    return evidence.with_verification(fx("part").select(F.col("p_partkey").alias("item_id")), fx("fx_sidecar"))


@register("j8_cited_indices", f"SELECT c.item_id, c.field, c.ref_ord, c.ref, CAST(coalesce(s.n, coalesce(t.n, 0) + 1) AS BIGINT) AS idx FROM fx_citation c LEFT JOIN (SELECT item_id, url, min(n) AS n FROM {_NUMBERED} GROUP BY ALL) s ON s.item_id = c.item_id AND s.url = c.ref LEFT JOIN (SELECT item_id, count(*) AS n FROM fx_source GROUP BY ALL) t ON t.item_id = c.item_id")
def j8(fx):
    return evidence.cited_indices(fx("fx_citation"), fx("fx_source")).select("item_id", "field", "ref_ord", "ref", F.col("idx").cast("long").alias("idx"))


@register("w2_source_numbers", f"SELECT item_id, url, n FROM {_NUMBERED}")
def w2(fx):
    return evidence.numbered_sources(fx("fx_source")).select("item_id", "url", F.col("n").cast("long").alias("n"))


@register("x15_source_lines", f"SELECT item_id, '[' || n || '] ' || url || CASE WHEN item_id % 2 = 0 THEN ' — note' ELSE '' END AS line FROM {_NUMBERED}")
def x15(fx):
    n = evidence.numbered_sources(fx("fx_source"))
    return n.select("item_id", X.source_line(F.col("n"), F.col("url"), F.lit(None).cast("string"), F.when(F.col("item_id") % 2 == 0, "note")).alias("line"))


@register("f8_needs_review", "SELECT item_id FROM fx_sidecar WHERE confidence = 'low' OR n_conflicts > 0")
def f8(fx):
    return evidence.needs_review(fx("fx_sidecar")).select("item_id")


@register("a7_conflict_lines", "SELECT item_id, printf('item %d: %d conflict(s), confidence %s', item_id, n_conflicts, confidence) AS line FROM fx_sidecar WHERE n_conflicts > 0")
def a7(fx):
    return report.conflict_lines(fx("fx_sidecar"))


@register("a14_value_conflicts", "SELECT item_id, path AS field, count(DISTINCT value) AS n_values FROM fx_round GROUP BY ALL HAVING count(DISTINCT value) > 1")
def a14(fx):
    return evidence.conflicting(fx("fx_round").select("item_id", F.col("path").alias("field"), "value"))


@register("a15_confidence", "SELECT i.item_id, CASE WHEN coalesce(n_conflicts, 0) > 0 THEN 'low' WHEN coalesce(s.n, 0) >= 2 AND coalesce(u.n, 0) = 0 THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT p_partkey AS item_id FROM part) i LEFT JOIN fx_sidecar v USING (item_id) LEFT JOIN (SELECT item_id, count(*) AS n FROM fx_source GROUP BY ALL) s USING (item_id) LEFT JOIN (SELECT item_id, count(*) AS n FROM fx_field WHERE value IS NULL OR contains(value, '[uncertain]') GROUP BY ALL) u USING (item_id)")
def a15(fx):
    rows = fx("part").select(F.col("p_partkey").alias("item_id")).join(fx("fx_sidecar").select("item_id", F.col("n_conflicts").alias("conflicts")), "item_id", "left")
    rows = rows.join(fx("fx_source").groupBy("item_id").agg(F.count(F.lit(1)).alias("sources")), "item_id", "left")
    rows = rows.join(fx("fx_field").filter(X.is_uncertain(F.col("value"))).groupBy("item_id").agg(F.count(F.lit(1)).alias("uncertain")), "item_id", "left").fillna(0)
    return evidence.rate_confidence(rows).select("item_id", "confidence")


@register("a8_uncertainty", "SELECT item_id, string_agg(field, ',' ORDER BY pos) AS uncertain FROM fx_field WHERE contains(coalesce(value, '[uncertain]'), '[uncertain]') GROUP BY item_id")
def a8(fx):
    f = fx("fx_field")
    return evidence.uncertainty(f.select("item_id", "pos", "field", "value"), f.filter("value IS NULL").select("item_id", "pos", "field")).select("item_id", joined("uncertain").alias("uncertain"))


# -- reports -------------------------------------------------------------------------------------------------

_CERTAIN = "value IS NOT NULL AND trim(value) <> '' AND NOT contains(value, '[uncertain]')"
_WIDE = f"""SELECT i.item_id, coalesce(max(CASE WHEN field = 'brand' AND {_CERTAIN} THEN value END), '—') AS brand, coalesce(max(CASE WHEN field = 'kind' AND {_CERTAIN} THEN value END), '—') AS kind FROM (SELECT DISTINCT item_id FROM fx_field) i LEFT JOIN fx_field f USING (item_id) GROUP BY i.item_id"""


@register("a5_summary_fields", f"SELECT field, n_items FROM (SELECT field, count(DISTINCT item_id) AS n_items FROM fx_field WHERE {_CERTAIN} GROUP BY field HAVING count(DISTINCT item_id) >= 2) ORDER BY CASE field WHEN 'price' THEN 0 ELSE 1 END, field LIMIT 5")
def a5(fx):
    return report.summary_fields(fx("fx_field"))


@register("a5_top_level_fields", "SELECT 'price' AS field, count(*) AS n_items FROM part HAVING count(*) >= 2")
def a5_top(fx):
    """Of item records: brand, kind and size lie below a category, name is reserved, so price alone is a top-level scalar."""
    return report.summary_fields(flatten.explode_fields(fx.sql(_RAW)).withColumn("value", F.col("raw")))


@register("r2_comparison", _WIDE)
def r2(fx):
    return report.comparison(fx("fx_field"), ["brand", "kind"])


@register("a11_column_widths", f"SELECT name, CAST(greatest(length(name), max(length(v))) AS BIGINT) AS width FROM (SELECT 'brand' AS name, brand AS v FROM ({_WIDE}) UNION ALL SELECT 'kind', kind FROM ({_WIDE})) GROUP BY name")
def a11(fx):
    return report.widths(report.comparison(fx("fx_field"), ["brand", "kind"]), ["brand", "kind"])


@register("r2_comparison_lines", f"SELECT item_id, '| ' || rpad(brand, CAST(max(length(brand)) OVER () AS INT), ' ') || ' | ' || rpad(kind, CAST(max(length(kind)) OVER () AS INT), ' ') || ' |' AS line FROM ({_WIDE})")
def r2_lines(fx):
    return report.comparison_lines(report.comparison(fx("fx_field"), ["brand", "kind"]), ["brand", "kind"])


@register("r1_contents", f"SELECT item_id, item_id AS no, item_id || '. [' || slug || '](#' || slug || ')' || coalesce(' - ' || string_agg(field || ': ' || value, ' | ' ORDER BY pos) FILTER (field IN ('brand', 'kind') AND value IS NOT NULL), '') AS line FROM fx_field GROUP BY item_id, slug")
def r1(fx):
    f = fx("fx_field")
    items = f.select("item_id", F.col("item_id").alias("no"), F.col("slug").alias("name"), F.lit(False).alias("failed")).distinct()
    return report.contents(items, f.filter("field IN ('brand', 'kind') AND value IS NOT NULL").select("item_id", F.col("pos").alias("rank"), "field", "value"))


_CITED = "(SELECT item_id, field, string_agg('[' || idx || ']', '' ORDER BY ref_ord, idx) AS cited FROM (SELECT c.item_id, c.field, c.ref_ord, coalesce(s.n, coalesce(t.n, 0) + 1) AS idx FROM fx_citation c LEFT JOIN (SELECT item_id, url, min(n) AS n FROM " + _NUMBERED + " GROUP BY ALL) s ON s.item_id = c.item_id AND s.url = c.ref LEFT JOIN (SELECT item_id, count(*) AS n FROM fx_source GROUP BY ALL) t ON t.item_id = c.item_id) GROUP BY ALL)"
_SOURCE_LINES = f"SELECT item_id, '[' || n || '] ' || url AS line FROM {_NUMBERED}"


def _source_lines(fx: Fixtures) -> DataFrame:
    n = evidence.numbered_sources(fx("fx_source"))
    none = F.lit(None).cast("string")
    return n.select("item_id", "n", X.source_line(F.col("n"), F.col("url"), none, none).alias("line"))


@register("r3_detail_lines", f"SELECT item_id, '- **' || field || '**: ' || value || coalesce(' ' || cited, '') AS line FROM fx_field LEFT JOIN {_CITED} USING (item_id, field) WHERE {_CERTAIN} UNION ALL SELECT DISTINCT item_id, '### ' || category FROM fx_field WHERE {_CERTAIN} UNION ALL {_SOURCE_LINES} UNION ALL SELECT DISTINCT item_id, '**Sources**' FROM fx_source")
def r3(fx):
    return report.detail_lines(fx("fx_field"), evidence.cited_indices(fx("fx_citation"), fx("fx_source")), _source_lines(fx)).select("item_id", "line")


_SUMMARY = ["price", "brand", "kind", "size"]


@register("r4_synthesis", f"SELECT CASE field WHEN 'price' THEN 0 WHEN 'brand' THEN 1 WHEN 'kind' THEN 2 ELSE 3 END AS rank, field, item_id, slug || ': ' || left(value, 80) AS part FROM fx_field WHERE {_CERTAIN} AND field IN ('price', 'brand', 'kind', 'size')")
def r4(fx):
    return report.synthesis(fx("fx_field"), _SUMMARY)


@register("a6_category_members", f"SELECT DISTINCT category, item_id, slug FROM fx_field WHERE {_CERTAIN} AND category IN (SELECT category FROM fx_field WHERE {_CERTAIN} GROUP BY category HAVING count(DISTINCT item_id) < (SELECT count(DISTINCT item_id) FROM fx_field))")
def a6_members(fx):
    return report.category_members(fx("fx_field"))


def _sidecars(fx: Fixtures) -> DataFrame:
    each = lambda name, n: F.when(F.col("n_conflicts") > 0, F.array(F.concat(F.lit(f"{name} "), "item_id"))).otherwise(F.array().cast("array<string>")) if n else F.array(F.lit(""))
    return fx("fx_sidecar").select("item_id", "confidence", each("conflict", 1).alias("conflicts"), each("note", 1).alias("notes"))


_DOUBTS = "value IS NULL OR contains(value, '[uncertain]')"
_FLAGS = f"""SELECT DISTINCT item_id, '**Uncertain fields**:' AS line FROM fx_field WHERE {_DOUBTS} UNION ALL SELECT item_id, '- ' || field FROM fx_field WHERE {_DOUBTS}
 UNION ALL SELECT DISTINCT item_id, '**Missing fields**:' FROM fx_field WHERE item_id % 6 = 0 UNION ALL SELECT DISTINCT item_id, '- nickname' FROM fx_field WHERE item_id % 6 = 0
 UNION ALL SELECT item_id, '**Verification confidence**: ' || confidence FROM fx_sidecar SEMI JOIN part ON item_id = p_partkey UNION ALL SELECT item_id, unnest(['**Conflicts**:', '- conflict ' || item_id, '**Verification notes**: note ' || item_id]) FROM fx_sidecar SEMI JOIN part ON item_id = p_partkey WHERE n_conflicts > 0"""


def _flagged(fx: Fixtures) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    f = fx("fx_field")
    items = f.select("item_id").distinct()
    return items, f.filter(X.is_uncertain(F.col("value"))).select("item_id", "pos", "field"), items.filter("item_id % 6 = 0").select("item_id", F.lit(0).alias("pos"), F.lit("nickname").alias("field")), _sidecars(fx).join(items, "item_id", "left_semi")


@register("r5_uncertainty_lines", f"SELECT * FROM ({_FLAGS}) UNION ALL SELECT DISTINCT item_id, '_No uncertainty flags; verification metadata absent._' FROM fx_field WHERE item_id NOT IN (SELECT item_id FROM ({_FLAGS}))")
def r5(fx):
    return report.uncertainty_lines(*_flagged(fx)).select("item_id", "line")


_S8_LINES = [
    "SELECT unnest([1, 2, 3]) AS section",  # heads
    "SELECT unnest([1, 2, 3]) FROM (SELECT DISTINCT item_id FROM fx_field)",  # an item's line of contents, row and title
    "SELECT 2 FROM range(2)",  # the table's head and rule
    f"SELECT 3 FROM fx_field WHERE {_CERTAIN}",
    f"SELECT 3 FROM (SELECT DISTINCT item_id, category FROM fx_field WHERE {_CERTAIN})",
    f"SELECT 3 FROM (SELECT item_id FROM fx_field GROUP BY item_id HAVING count(*) FILTER ({_CERTAIN}) = 0)",
    "SELECT 3 FROM fx_source SEMI JOIN part ON item_id = p_partkey",
    "SELECT 3 FROM (SELECT DISTINCT item_id FROM fx_source SEMI JOIN part ON item_id = p_partkey)",
]


_S8_LINES += [
    "SELECT unnest([4, 4, 4, 5])",  # heads of the last sections
    f"SELECT 4 FROM fx_field WHERE {_CERTAIN} AND field IN ('price', 'brand', 'kind', 'size')",
    f"SELECT DISTINCT ON (category) 4 FROM fx_field WHERE {_CERTAIN}",
    f"SELECT 4 FROM (SELECT DISTINCT category, item_id FROM fx_field WHERE {_CERTAIN} AND category IN (SELECT category FROM fx_field WHERE {_CERTAIN} GROUP BY category HAVING count(DISTINCT item_id) < (SELECT count(DISTINCT item_id) FROM fx_field)))",
    "SELECT 4 FROM fx_sidecar SEMI JOIN part ON item_id = p_partkey WHERE n_conflicts > 0",
    "SELECT 5 FROM part",  # titles
    f"SELECT 5 FROM ({_FLAGS})",
    f"SELECT 5 FROM part WHERE p_partkey NOT IN (SELECT item_id FROM ({_FLAGS}))",
]


def _report(fx: Fixtures) -> DataFrame:
    items = fx("part").select(F.col("p_partkey").alias("item_id"), F.col("p_partkey").alias("no"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"), F.lit(False).alias("failed"))
    missing = items.filter("item_id % 6 = 0").select("item_id", F.lit(0).alias("pos"), F.lit("nickname").alias("field"))
    return report.report_lines(items, fx("fx_field"), _SUMMARY, _sidecars(fx), evidence.cited_indices(fx("fx_citation"), fx("fx_source")), _source_lines(fx), missing)


@register("s8_report_lines", f"SELECT section, count(*) AS n FROM ({' UNION ALL '.join(_S8_LINES)}) GROUP BY section")
def s8(fx):
    """Lines of the five sections by section; the lines themselves are those of r1 to r5 (and, in tests, a whole report)."""
    return _report(fx).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@register("s8_report_text", f"SELECT '- **' || field || '**: ' || value || coalesce(' ' || cited, '') AS line, count(*) AS n FROM fx_field LEFT JOIN {_CITED} USING (item_id, field) WHERE {_CERTAIN} GROUP BY ALL")
def s8_text(fx):
    """The report as one text file, read back: its lines of fields."""
    where = f"{scratch_dir(fx.spark, 'report')}/report.md"
    reports.write_report(_report(fx), where)
    return fx.spark.read.text(where).filter(F.col("value").rlike(r"^- [*][*].*[*][*]: ")).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@register("a6_category_coverage", f"SELECT category, count(DISTINCT item_id) AS n_items, (SELECT count(DISTINCT item_id) FROM fx_field) AS n_total, min(item_id) AS first_item, min_by(pos, item_id * 10 + pos) AS first_pos FROM fx_field WHERE {_CERTAIN} GROUP BY category")
def a6(fx):
    return report.category_coverage(fx("fx_field"))


@register("w1_item_numbers", "SELECT slug, category, field, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pos) AS INT) AS no FROM fx_field")
def w1(fx):
    return coverage.numbered(fx("fx_field"), "item_id", "pos").select("slug", "category", "field", "no")


@register("x1_anchor", "SELECT c_custkey, replace(regexp_replace(lower(trim(c_name || ' & ' || c_mktsegment)), '[^a-z0-9 _-]', '', 'g'), ' ', '-') AS anchor, regexp_replace(replace(c_name || '/' || c_mktsegment, ' ', '_'), '[^A-Za-z0-9_-]', '', 'g') AS file FROM customer")
def x1(fx):
    c = fx("customer")
    return c.select("c_custkey", X.anchor(F.concat("c_name", F.lit(" & "), "c_mktsegment")).alias("anchor"), X.file_slug(F.concat("c_name", F.lit("/"), "c_mktsegment")).alias("file"))


@register("x4_compact_cell", "SELECT page_id, left(array_to_string(list_filter(list_transform(string_split(html, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[ \\t\\r]+', ''), '[ \\t\\r]+$', '')), lambda x: x <> ''), ' '), 80) AS cell FROM pages")
def x4(fx):
    return fx("pages").select("page_id", X.compact(F.col("html")).alias("cell"))


@register("x7_truncate", "SELECT doc_id, CASE WHEN length(text) > 140 THEN regexp_replace(left(text, 139), '\\s+$', '') || '…' ELSE text END AS short FROM documents")
def x7(fx):
    return fx("documents").select("doc_id", X.truncate(F.col("text"), 140).alias("short"))


@register("x8_paths", "SELECT page_id, CASE WHEN regexp_matches(url, '[.][^./]+$') THEN regexp_replace(url, '[.][^./]+$', '.pptx') ELSE url || '.pptx' END AS plain, regexp_replace(url || '.html', '[.][^./]+$', '.pptx') AS swapped FROM pages")
def x8(fx):
    return fx("pages").select("page_id", X.swap_extension(F.col("url"), ".pptx").alias("plain"), X.swap_extension(F.concat("url", F.lit(".html")), ".pptx").alias("swapped"))


@register("x9_escape_html", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages")
def x9(fx):
    return fx("pages").select("page_id", F.md5(X.escape_html(F.col("html"))).alias("escaped_md5"))


@register("x11_item_names", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Part ' || p_partkey ELSE p_name END AS name FROM part")
def x11(fx):
    return fx("part").select("p_partkey", X.item_name(F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")), F.lit(" "), F.concat(F.lit("part_"), F.col("p_partkey").cast("string"))).alias("name"))


@register("x13_file_size", "SELECT event_id, CASE WHEN b >= 1024 THEN printf('%.1f', b / 1024) || ' KB' ELSE b || ' B' END AS size FROM (SELECT event_id, CAST(floor(value * 10) AS BIGINT) * 16 AS b FROM events)")
def x13(fx):
    return fx("events").select("event_id", X.file_size((F.floor(F.col("value") * 10) * 16)).alias("size"))


# -- review --------------------------------------------------------------------------------------------------


@register("j11_check_claims", "SELECT doc_id, c.subject, c.attribute, claimed, actual, CASE WHEN c.attribute <> 'n_chars' THEN 'unverifiable' WHEN actual IS NULL THEN 'unsupported' WHEN claimed = actual THEN 'verified' ELSE 'corrected' END AS verdict FROM fx_claim c LEFT JOIN fx_evidence e ON c.subject = e.subject AND c.attribute = e.attribute")
def j11(fx):
    return review.check_claims(fx("fx_claim"), fx("fx_evidence"), ("n_chars",))


_VERDICTS = "SELECT k, b.n_lines AS planned, a.n_lines AS real, CASE WHEN a.k IS NULL THEN 'unsupported' WHEN b.k IS NULL THEN 'missing' WHEN k % 7 = 3 THEN 'risky' WHEN a.n_lines = b.n_lines THEN 'correct' ELSE 'stale' END AS verdict FROM fx_before b FULL JOIN fx_after a USING (k)"


@register("j12_check_plan", _VERDICTS)
def j12(fx):
    return _verdicts(fx)


def _verdicts(fx: Fixtures) -> DataFrame:
    risks = fx("part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 7 != 3, "low").when(F.col("p_partkey") % 2 == 0, "high").otherwise("critical").alias("severity"))
    return review.check_plan(fx("fx_before"), fx("fx_after"), "k", "n_lines", risks)


_CHANGES = "SELECT k, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'deleted' WHEN a.n_lines = b.n_lines AND a.name = b.name THEN 'unchanged' ELSE 'modified' END AS status, coalesce(a.n_lines, 0) - coalesce(b.n_lines, 0) AS delta FROM fx_before b FULL JOIN fx_after a USING (k)"


@register("j13_changes", f"SELECT k, status FROM ({_CHANGES})")
def j13(fx):
    return review.changes(fx("fx_before"), fx("fx_after"), "k")


@register("a13_change_figures", f"SELECT status, count(*) AS files, CAST(sum(greatest(delta, 0)) AS BIGINT) AS lines_added, CAST(sum(greatest(-delta, 0)) AS BIGINT) AS lines_removed FROM ({_CHANGES}) GROUP BY ROLLUP (status)")
def a13(fx):
    return review.change_figures(fx("fx_before"), fx("fx_after"), "k", "n_lines")


@register("a13_new_modules", "SELECT k % 17 AS module, count(*) AS files FROM fx_after WHERE k % 17 NOT IN (SELECT k % 17 FROM fx_before) GROUP BY 1")
def a13_modules(fx):
    module = F.pmod("k", F.lit(17)).alias("module")
    return review.new_modules(fx("fx_before").select(module), fx("fx_after").select(module), "module")


@register("j14_requirement_status", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_matched, count(*) AS n_parts, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'gap' WHEN count(*) FILTER (o_orderstatus = 'F') < count(*) THEN 'partial' ELSE 'match' END AS status FROM orders GROUP BY o_custkey")
def j14(fx):
    return review.requirement_status(fx("orders").withColumn("m", F.col("o_orderstatus") == "F"), "o_custkey", "m")


@register("a12_status_rollup", "SELECT area, count(*) AS reviewed, count(*) FILTER (status = 'match') AS matched, count(*) FILTER (status = 'gap') AS gaps, count(*) FILTER (status = 'partial') AS partials, CAST(floor(count(*) FILTER (status = 'match') * 100 / count(*) + 0.5) AS BIGINT) AS coverage FROM fx_status GROUP BY ROLLUP (area)")
def a12(fx):
    return review.status_rollup(fx("fx_status"), "area")


@register("j15_uncovered", "SELECT DISTINCT i.deck_id, i.item_no FROM fx_inventory i ANTI JOIN fx_slide_map m ON i.deck_id = m.deck_id AND i.item_no = m.item_no")
def j15(fx):
    return review.uncovered(fx("fx_inventory"), fx("fx_slide_map"), ["deck_id", "item_no"])


@register("j16_over_limit", "SELECT kind, deck_id, count(*) AS n, 2 AS most FROM fx_inventory GROUP BY ALL HAVING count(*) > 2")
def j16(fx):
    inv = fx("fx_inventory")
    return review.over_limit(inv, inv.select("kind").distinct().withColumn("most", F.lit(2)), ["deck_id"], "kind").select("kind", "deck_id", "n", "most")


@register("a18_severity_matrix", "SELECT dimension, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical FROM fx_risk GROUP BY dimension")
def a18(fx):
    return review.severity_matrix(fx("fx_risk"))


@register("f10_since", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01'")
def f10(fx):
    return review.since(fx("orders").withColumn("d", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")), "d", "1996-01-01").select("o_orderkey")


@register("f15_route", "SELECT l_orderkey, CASE WHEN count(*) >= 15 THEN 'overview+detail' WHEN count(*) >= 4 OR count(DISTINCT l_returnflag) >= 3 THEN 'page' WHEN count(DISTINCT l_linestatus) >= 4 THEN 'page+nav' ELSE 'inline' END AS route FROM lineitem GROUP BY l_orderkey")
def f15(fx):
    per = fx("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_returnflag").alias("c"), F.count_distinct("l_linestatus").alias("s"))
    return per.select("l_orderkey", review.route(F.col("n"), F.col("c"), F.col("n"), F.col("s")).alias("route"))


@register("h7_extract_claims", "SELECT page_id, 'url' AS kind, unnest(regexp_extract_all(html, 'https?://[^\\s<>\"'']+')) AS claim FROM pages UNION ALL SELECT page_id, 'number', unnest(regexp_extract_all(html, '\\b[0-9]+(?:\\.[0-9]+)?%')) FROM pages UNION ALL SELECT page_id, 'path', unnest(regexp_extract_all(html, '\\b[A-Za-z0-9_-]+\\.(?:py|js|html|json|md)\\b')) FROM pages UNION ALL SELECT page_id, 'command', 'git page-' || page_id FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'name', 'f' || page_id || '()' FROM pages WHERE page_id % 2 = 0")
def h7(fx):
    said = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" run git page-"), "page_id", F.lit(" to call f"), "page_id", F.lit("() "))).otherwise(F.lit(""))
    return review.extract_claims(fx("pages").select("page_id", F.concat("html", said).alias("html")), "page_id", "html")


# -- specs ---------------------------------------------------------------------------------------------------

_SPECS = """SELECT c_custkey AS spec_id, to_json(named_struct('title', CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END, 'sections', array(named_struct('title', c_mktsegment, 'tone', CASE WHEN c_custkey % 5 = 0 THEN 'loud' ELSE 'info' END,
 'cards', array(named_struct('title', c_name, 'body', 'a < b & c')), 'table', named_struct('columns', array('x', 'y'), 'rows', CASE WHEN c_custkey % 3 = 0 THEN array(array('1')) ELSE array(array('1', '2')) END),
 'flow', named_struct('nodes', array(named_struct('id', 'a', 'label', 'A')), 'edges', array(named_struct('from', 'a', 'to', CASE WHEN c_custkey % 4 = 0 THEN 'b' ELSE 'a' END))))))) AS raw FROM {customer}"""


@register("a19_spec_errors", """SELECT spec_id, coalesce(string_agg(e, '; ' ORDER BY e) FILTER (e IS NOT NULL), '') AS errors FROM (SELECT c_custkey AS spec_id, unnest([CASE WHEN c_custkey % 7 = 0 THEN 'spec.title must be a non-empty string' END, CASE WHEN c_custkey % 5 = 0 THEN 'spec.sections[0].tone must be neutral, accent, positive, warning, danger, or info' END,
 CASE WHEN c_custkey % 3 = 0 THEN 'spec.sections[0].table.rows[0] must match the column count' END, CASE WHEN c_custkey % 4 = 0 THEN 'spec.sections[0].flow.edges[0].to must reference a flow node' END]) AS e FROM customer) GROUP BY spec_id""")
def a19(fx):
    return specs.validate(fx.sql(_SPECS)).select("spec_id", joined("errors", "; ").alias("errors"))


@register("r6_rendered_pages", """SELECT c_custkey AS spec_id, c_name AS title, md5('<section class="section" data-tone="info"><div class="section-head"><div><h2>' || c_mktsegment || '</h2></div><span class="section-kicker">01</span></div><div class="grid"><article class="card" data-tone="accent"><h3>' || c_name || '</h3><p>a &lt; b &amp; c</p></article></div><div class="table-wrap"><table><thead><tr><th scope="col">x</th><th scope="col">y</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table></div><div class="flow"><div class="grid"><article class="flow-node" data-tone="accent"><h3>A</h3></article></div><div class="flow-edges"><span class="flow-edge">a → a</span></div></div></section>') AS sections_md5 FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 4 <> 0""")
def r6(fx):
    pages = specs.render(fx.sql(_SPECS))
    return pages.select("spec_id", "title", F.md5(F.regexp_extract("html", r'(?s)<div class="sections">(.*)</div>\n</main>', 1)).alias("sections_md5"))


_BLOCKS = """SELECT c_custkey AS spec_id, concat('{{"title":"t","sections":[{{"title":"s","files":[{{"path":"', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'p' END, '","status":"', CASE WHEN c_custkey % 4 = 0 THEN 'lost' ELSE 'added' END, '"}}],"steps":',
 CASE WHEN c_custkey % 5 = 0 THEN '[]' ELSE '[{{"title":"x","status":"done"}}]' END, ',"callouts":[{{"body":"b"', CASE WHEN c_custkey % 6 = 0 THEN ',"odd":1' ELSE '' END, '}}],"evidence":[{{"label":"l"', CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ',"value":"v"' END, '}}],"cards":[{{"title":"c","meta":',
 CASE WHEN c_custkey % 8 = 0 THEN '["m",1]' ELSE '["m"]' END, '}}]', CASE WHEN c_custkey % 9 = 0 THEN ',"extra":[]' ELSE '' END, '}}]', CASE WHEN c_custkey % 10 = 0 THEN ',"more":0' ELSE '' END, '}}') AS raw FROM {customer}"""
_BLOCK_ERRORS = {
    3: "spec.sections[0].files[0].path must be a non-empty string", 4: "spec.sections[0].files[0].status must be added, modified, deleted, reviewed, or planned", 5: "spec.sections[0].steps must be a non-empty array",
    6: "spec.sections[0].callouts[0].odd is not supported", 7: "spec.sections[0].evidence[0].value must be a non-empty string", 8: "spec.sections[0].cards[0].meta must be an array of strings",
    9: "spec.sections[0].extra is not supported", 10: "spec.more is not supported",
}


@register("v8_block_errors", "SELECT c_custkey AS spec_id, coalesce(array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN c_custkey % {k} = 0 THEN '{e}' END" for k, e in _BLOCK_ERRORS.items()) + "], lambda x: x IS NOT NULL)), '; '), '') AS errors FROM customer")
def v8(fx):
    """Unknown keys at every level, texts, arrays of texts, enums and block rules (V1, V2, V3, V4, V5, V8)."""
    docs = fx.sql(_BLOCKS.replace("{{", "\x01").replace("}}", "\x02")).withColumn("raw", F.translate("raw", "\x01\x02", "{}"))
    return specs.validate(docs).select("spec_id", joined("errors", "; ").alias("errors"))


_ROUND_OUTPUT = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'base' WHEN 'O' THEN 'gap' ELSE 'verify' END AS kind, concat('<', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '"item":"i",' END, '"json":', CASE WHEN o_orderkey % 4 = 0 THEN '[]' ELSE '<>' END,
 CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN concat(',"verification":', CASE WHEN o_orderkey % 5 = 0 THEN '<"conflicts":"c","more":1>' ELSE '<"notes":"n">' END) ELSE concat(',"sources":', CASE WHEN o_orderkey % 5 = 0 THEN '[1]' ELSE '["s"]' END) END, CASE WHEN o_orderkey % 7 = 0 THEN ',"extra":null' ELSE '' END, '>') AS raw FROM {orders}"""


@register("v9_round_outputs", """SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'output.item must be a string' END, CASE WHEN o_orderkey % 4 = 0 THEN 'output.json must be an object' END,
 CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus NOT IN ('F', 'O') THEN 'output.verification.conflicts must be an array of strings' WHEN o_orderkey % 5 = 0 THEN 'output.sources must be an array of strings' END, CASE WHEN o_orderkey % 7 = 0 THEN 'output.extra is not supported' END], lambda x: x IS NOT NULL)), '; ') AS errors FROM orders""")
def v9(fx):
    return specs.round_errors(fx.sql(_ROUND_OUTPUT).withColumn("raw", F.translate("raw", "<>", "{}"))).select("o_orderkey", joined("errors", "; ").alias("errors"))


@register("j9_dangling_edges", "SELECT from_id, to_id, 'from' AS side FROM fx_flow_edge WHERE from_id NOT IN (SELECT id FROM fx_flow_node) UNION ALL SELECT from_id, to_id, 'to' FROM fx_flow_edge WHERE to_id NOT IN (SELECT id FROM fx_flow_node)")
def j9(fx):
    return specs.dangling(fx("fx_flow_edge"), fx("fx_flow_node"))


@register("a16_chart", "SELECT area, string_agg(status, ',' ORDER BY status) AS labels, string_agg(CAST(n AS STRING), ',' ORDER BY status) AS data FROM (SELECT area, status, count(*) AS n FROM fx_status GROUP BY ALL) GROUP BY area")
def a16(fx):
    counts = fx("fx_status").groupBy("area", "status").agg(F.count(F.lit(1)).cast("string").alias("n"))
    return specs.chart(counts, "area", "status", "n").select("area", joined("labels").alias("labels"), joined("data").alias("data"))


@register("x10_tone", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('neutral', 'accent', 'positive', 'warning', 'danger', 'info') THEN o_orderpriority WHEN o_orderkey % 2 = 0 THEN 'info' ELSE 'accent' END AS tone FROM orders")
def x10(fx):
    return fx("orders").select("o_orderkey", X.tone(F.when(F.col("o_orderkey") % 2 == 0, "info").otherwise(F.col("o_orderpriority"))).alias("tone"))


@register("w3_section_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 10 THEN '0' || l_linenumber ELSE CAST(l_linenumber AS STRING) END AS no FROM lineitem")
def w3(fx):
    return fx("lineitem").select("l_orderkey", "l_linenumber", X.zero_pad(F.col("l_linenumber"), 2).alias("no"))


# -- decks and pages -----------------------------------------------------------------------------------------


@register("w4_progress", "SELECT deck_id, slide_no, n || ' / ' || total || ' · ' || CAST(floor(n * 100 / total + 0.5) AS BIGINT) || '%' AS label FROM (SELECT deck_id, slide_no, row_number() OVER (PARTITION BY deck_id ORDER BY slide_no) AS n, count(*) OVER (PARTITION BY deck_id) AS total FROM fx_slide)")
def w4(fx):
    return decks.progress(fx("fx_slide")).select("deck_id", "slide_no", "label")


@register("w5_unique_text", "SELECT user_id, lower(event_type) AS v, min(event_id) AS first_id FROM events GROUP BY ALL")
def w5(fx):
    e = fx("events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("v"))
    return decks.unique_text(e, ["user_id"], "v", "event_id").select("user_id", F.lower("v").alias("v"), F.col("event_id").alias("first_id"))


@register("w10_runs_of_three", "SELECT deck_id, slide_no FROM (SELECT *, lag(composition, 1) OVER w AS b, lag(composition, 2) OVER w AS c FROM fx_slide WINDOW w AS (PARTITION BY deck_id ORDER BY slide_no)) WHERE composition = 'centered' AND b = 'centered' AND c = 'centered'")
def w10(fx):
    return decks.runs_of_three(fx("fx_slide"))


@register("w11_pagination", "SELECT deck_id, slide_no, CAST(ceil(row_number() OVER (PARTITION BY deck_id ORDER BY slide_no) / 8) AS BIGINT) AS page FROM fx_slide")
def w11(fx):
    return decks.paginated(fx("fx_slide"), "deck_id", "slide_no").select("deck_id", "slide_no", "page")


@register("a20_deck_summary", "SELECT deck_id, count(*) AS slide_count, min_by(title, slide_no) AS first_title FROM fx_slide GROUP BY deck_id")
def a20(fx):
    return decks.deck_summary(fx("fx_slide"))


_CLEAN = "regexp_replace(" * 7 + "html, '(?is)<!--.*?-->', '', 'g')" + "".join(f", '(?is)<{t}\\b.*?</{t}\\s*>', '', 'g')" for t in ("script", "style", "nav", "button", "svg", "canvas"))
_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"
_H4 = f"SELECT page_id, kind, CAST(pos - 1 AS BIGINT) AS pos, {_PLAIN} AS text FROM (SELECT page_id, kind, unnest(list) AS x, generate_subscripts(list, 1) AS pos FROM (" + " UNION ALL ".join(
    f"SELECT page_id, '{k}' AS kind, regexp_extract_all({_CLEAN}, '{p.replace(chr(39), chr(39) * 2)}', 1) AS list FROM pages" for k, p in decks.PATTERNS.items()
) + "))"


@register("h4_page_blocks", _H4)
def h4(fx):
    return decks.page_blocks(fx("pages"))


@register("h8_inventory", f"SELECT page_id, kind, count(*) AS n FROM ({_H4}) GROUP BY ALL")
def h8(fx):
    return decks.page_blocks(fx("pages")).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


_ARTICLE = f"regexp_extract({_CLEAN}, '(?is)<article>(.*?)</article>', 1)"
_LINE = _PLAIN.replace("(x,", "(replace(x, chr(160), ' '),", 1)
#: Blocks of the pages: an article is a card; its heading and paragraphs follow it, a paragraph ending where the next one starts.
_H1 = f"""SELECT page_id, 0 AS slide, CAST(pos AS INT) AS pos, kind, '' AS style, {_LINE} AS text, 0 AS n_rows FROM (
 SELECT page_id, unnest([0, 1]) AS pos, unnest(['card', 'heading']) AS kind, unnest([a, regexp_extract(a, '(?is)<h1[^>]*>(.*?)</h1>', 1)]) AS x FROM (SELECT page_id, {_ARTICLE} AS a FROM pages)
 UNION ALL SELECT page_id, i + 1, 'paragraph', regexp_replace(regexp_replace(p, '(?s)^[^>]*>', ''), '(?is)</p>.*', '') FROM (SELECT page_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT page_id, string_split_regex({_ARTICLE}, '(?i)<p\\b')[2:] AS l FROM pages))) WHERE text <> ''"""


def _cut(text: str, most: int) -> str:
    return f"CASE WHEN length({text}) > {most} THEN regexp_replace(left({text}, {most - 1}), '\\s+$', '') || '…' ELSE {text} END"


@register("h1_parsed_blocks", _H1)
def h1(fx):
    return decks.blocks(fx("pages")).withColumn("n_rows", F.coalesce(F.array_size("rows"), F.lit(0))).drop("rows")


@register("h5_slide_bodies", f"""SELECT page_id, 0 AS slide, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS n, kind, cut AS text FROM (
 SELECT *, row_number() OVER (PARTITION BY page_id, lower(cut) ORDER BY pos) AS again FROM (SELECT page_id, pos, kind, {_cut('text', 220)} AS cut, max(text) FILTER (kind = 'heading') OVER (PARTITION BY page_id) AS title FROM ({_H1}))
 WHERE kind <> 'heading' AND cut IS DISTINCT FROM title) WHERE again = 1 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 10""")
def h5(fx):
    return decks.body_parts(decks.blocks(fx("pages")))


_LONG_SQL = f"""SELECT doc_id, CASE WHEN said = '' THEN 'Diagram placeholder: render from the HTML deck for full fidelity.' ELSE 'Diagram source: ' || {_cut('said', 220)} END AS diagram, {_cut('lines', 850)} AS code, {_cut('said', 90)} AS cell,
 CASE WHEN length(said) > 160 THEN {_cut('said', 160)} ELSE '' END AS item, {_cut('said', 180)} AS subtitle FROM (SELECT doc_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS said, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t\\f\\r]+', ' ', 'g'), '\\s*\\n\\s*', '\n', 'g'), '^\\s+|\\s+$', '', 'g') AS lines
 FROM (SELECT doc_id, translate(coalesce(text, ''), '<&' || chr(160), '   ') AS t FROM documents))"""


@register("h2_long_blocks", _LONG_SQL)
def h2_long(fx):
    """A slide a document, with its whole text as code, a diagram's source, a cell, an item and a subtitle: each kind cut at its own length, most texts longer than all of them."""
    t = F.translate(F.coalesce("text", F.lit("")), "<&", "  ")
    parts = ('<section class="slide"><p class="subtitle">', '</p><pre>', '</pre><pre class="mermaid">', "</pre><table><tr><td>", "</td></tr></table><ul><li>")
    html = F.concat(*[x for part in parts for x in (F.lit(part), t)], F.lit("</li></ul></section>"))
    found = decks.slides(decks.blocks(fx("documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))))
    text = lambda c: F.coalesce(c, F.lit(""))
    return found.select(F.col("page_id").alias("doc_id"), F.get("body", F.lit(0)).alias("diagram"), text(F.get("codes", F.lit(0))).alias("code"), text(F.get(F.flatten(F.flatten("tables")), F.lit(0))).alias("cell"), text(F.get("body", F.lit(1))).alias("item"), "subtitle")


_DECK = """SELECT p_partkey AS page_id, concat('<div class="deck-nav">1</div><', CASE WHEN p_partkey % 11 = 0 THEN 'div' ELSE 'section' END, ' class="slide">', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('<h2>', p_name, '</h2>') END, '<p class="eyebrow">e</p><p class="subtitle">', p_brand, '</p><nav>menu</nav>',
 CASE WHEN p_partkey % 2 = 0 THEN concat('<table><tr><td> </td></tr><tr><th>k</th><td>', repeat(p_name, 10), '</td></tr></table>') ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN concat('<pre>a  b\n', 'box', CAST(p_size AS STRING), '</pre>') ELSE '' END,
 CASE p_partkey % 5 WHEN 0 THEN '<pre class="mermaid">a --&gt;  b</pre>' WHEN 1 THEN '<script class="diagram-source"> </script>' ELSE '<script>x</script>' END, '<ul><li>', p_type, '<li>', upper(p_type), '</ul><p>', p_name, '</p><div class="card">', 'box', CAST(p_size AS STRING), '</div></', CASE WHEN p_partkey % 11 = 0 THEN 'div' ELSE 'section' END, '><p>outside</p>') AS html FROM {part}"""


@register("h5_assembled_slides", """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 = 0 THEN 'Slide 1' ELSE p_name END AS title, p_brand AS subtitle,
 array_to_string(list_filter([CASE p_partkey % 5 WHEN 0 THEN 'Diagram source: a --> b' WHEN 1 THEN 'Diagram placeholder: render from the HTML deck for full fidelity.' END, p_type, 'box' || p_size, 'e', CASE WHEN p_partkey % 4 = 0 THEN p_name END], lambda x: x IS NOT NULL), '|') AS body,
 CASE WHEN p_partkey % 2 = 0 THEN 'k,' || CASE WHEN length(repeat(p_name, 10)) > 90 THEN rtrim(left(repeat(p_name, 10), 89)) || '…' ELSE repeat(p_name, 10) END ELSE '' END AS cells, CASE WHEN p_partkey % 3 = 0 THEN 'a b' || chr(10) || 'box' || p_size ELSE '' END AS code,
 CASE WHEN p_partkey % 2 = 0 THEN 'table' WHEN p_partkey % 3 = 0 THEN 'code' ELSE 'panel' END AS block FROM part""")
def h5_assembled(fx):
    """Ignored elements, slides by section or class, tables, code, diagrams, titles, bodies and the choice of a block (F12, F13, H1, H2, H3, H5, O5, W7, L7) over one slide a part."""
    found = decks.block_choice(decks.slides(decks.blocks(fx.sql(_DECK)).filter("slide = 1")))
    rows = F.flatten(F.flatten("tables"))
    return found.select("page_id", "title", "subtitle", joined("body", "|").alias("body"), joined(rows).alias("cells"), joined("codes", "|").alias("code"), "block")


@register("h6_slide_titles", "SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE p_name END AS title FROM part")
def h6(fx):
    marked = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('<h3 class="slide__display">'), "p_brand", F.lit("</h3>"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("<blockquote>"), "p_type", F.lit("</blockquote>"))).otherwise(F.lit(""))
    html = F.concat(F.lit('<section class="slide"><h2>'), "p_name", F.lit("</h2>"), marked, F.lit("</section>"))
    return decks.slide_titles(decks.blocks(fx("part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))).select("page_id", "title")


def _deck_files(fx: Fixtures) -> tuple[str, DataFrame]:
    """The pages as files of a folder, and what was written."""
    folder = scratch_dir(fx.spark, "decks")
    return folder, files.write_pages(fx("pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), "html"), folder)


@register("s9_written_pages", "SELECT 'page_' || page_id || '.html' AS path, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages")
def s9_written(fx):
    return _deck_files(fx)[1]


_TITLES = f"SELECT 'page_' || page_id || '.html' AS file_name, coalesce(nullif({_PLAIN.replace('(x,', '(t,', 1)}, ''), 'Slide 0') AS title FROM (SELECT page_id, regexp_extract({_CLEAN}, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS t FROM pages)"


@register("s10_deck_files", f"SELECT file_name, title, '' AS problem FROM ({_TITLES}) UNION ALL SELECT 'gone_' || r_regionkey || '.html', '', 'not found' FROM region")
def s10(fx):
    """Decks read from ``*.html`` files of a folder and from listed paths, some of them absent: each deck's title, and a warning for each absent path (S4, S10)."""
    folder, out = _deck_files(fx)
    out.write.format("noop").mode("overwrite").save()
    listed = [f"{folder}/gone_{r['r_regionkey']}.html" for r in fx("region").collect()]
    texts, problems = files.scan_files(fx.spark, [folder, *listed], "*.html")
    titles = decks.slide_titles(decks.blocks(texts.select(F.col("file_name").alias("page_id"), F.col("raw").alias("html"))))
    return titles.select(F.col("page_id").alias("file_name"), "title", F.lit("").alias("problem")).unionByName(problems.select("file_name", F.lit("").alias("title"), "problem"))


@register("v10_page_rules", """SELECT page_id, unnest(list_filter([CASE WHEN NOT (contains(l, '<html') AND contains(l, '</html>') AND contains(l, '<!doctype html>')) THEN 'complete document' END, CASE WHEN NOT regexp_matches(l, '<link[^>]*rel=["''][^"'']*icon') THEN 'favicon' END,
 CASE WHEN regexp_matches(l, '<pre[^>]*class=["'']mermaid') THEN 'bare mermaid' END, CASE WHEN regexp_matches(l, '[^a-z0-9_-]\\.node[ ]*\\{') THEN 'page-level .node' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT page_id, lower(html) AS l FROM pages)""")
def v10(fx):
    return decks.broken_rules(fx("pages"))


# -- events --------------------------------------------------------------------------------------------------


@register("f14_tool_results", "SELECT seq, call_id, bytes, CASE WHEN bytes >= 1024 THEN 'KB' ELSE 'B' END AS unit FROM fx_tool_event WHERE type = 'tool/result' AND call_id IS NOT NULL")
def f14(fx):
    return stream.matching(fx("fx_tool_event")).select("seq", "call_id", "bytes", F.regexp_extract("size", "([A-Z]+)$", 1).alias("unit"))


@register("w9_first_event", "SELECT call_id, min(seq) AS seq FROM fx_tool_event WHERE type = 'tool/result' AND call_id IS NOT NULL GROUP BY call_id")
def w9(fx):
    return stream.first_per_key(fx("fx_tool_event")).select("call_id", "seq")


def _in_files(rows: DataFrame, by: Column, where: str, n: int) -> DataFrame:
    """``rows`` as a stream of ``n`` batches, with those of equal ``by`` in one. A batch has as many files as all tasks wrote of it."""
    files = min(rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)
    for k in range(n):
        rows.filter(F.pmod(by, F.lit(n)) == k).coalesce(files).write.parquet(f"{where}/in/k={k}")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{where}/in/k=*")


def _streams(fx: Fixtures) -> str:
    return scratch_dir(fx.spark, "streams")


def _drained(stream_: DataFrame, where: str, keep: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    stream_.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()


@register("t1_first_arrivals", "SELECT call_id, min(seq) AS seq, count(*) > 0 AS published FROM fx_tool_event WHERE type = 'tool/result' AND call_id IS NOT NULL GROUP BY call_id")
def t1(fx):
    """The stream form over the events in three files out of order: what was published last of each key equals the batch form, whatever the days of its events."""
    where = _streams(fx)
    rows = fx("fx_tool_event").select("seq", "ts", "type", "call_id", "bytes")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows/batch={number}")

    _drained(stream.first_arrivals(_in_files(rows, F.col("seq") * -1, where, 3)).select("call_id", "seq"), where, keep)
    published = fx.spark.read.schema("call_id long, seq long, batch int").parquet(f"{where}/rows")
    return published.groupBy("call_id").agg(F.max_by("seq", "batch").alias("seq"), (F.count(F.lit(1)) > 0).alias("published"))


@register("t2_judged_arrivals", "SELECT o_orderkey AS item_id, o_totalprice > 100000 AS valid, 1 AS n FROM orders")
def t2(fx):
    """Orders judged as they arrive, in three files and then all again by a run from the start: each is added once (T2, T3)."""
    where = _streams(fx)
    rows = fx("orders").select(F.col("o_orderkey").alias("item_id"), "o_totalprice")
    source = _in_files(rows.unionByName(rows.filter("item_id % 5 = 0")), F.floor(F.col("item_id") / 7).cast("int"), where, 3)
    judge = lambda b: b.select("item_id", (F.col("o_totalprice") > 100000).alias("valid"))
    for run in ("first", "again"):
        stream.as_they_arrive(source, judge, f"{where}/out", "item_id", f"{where}/{run}", parts=8).trigger(availableNow=True).start().awaitTermination()
    back = stream.Arrivals(fx.spark, f"{where}/out", "item_id").rows(T.StructType.fromDDL("item_id long, valid boolean"))
    return back.groupBy("item_id", "valid").agg(F.count(F.lit(1)).cast("int").alias("n"))


@register("t4_round_states", _ROUNDS)
def t4(fx):
    """Rounds through the stream, a third of them as its first state and the others in two files; the state is read back from the store and resolved as the batch form does."""
    where = _streams(fx)
    rows = fx("fx_round").select(F.col("item_id").cast("long").alias("item_id"), "round_no", F.col("seq").cast("long").alias("seq"), "path", "value", F.array().cast("array<string>").alias("sources"))
    third = F.pmod(F.floor(F.col("seq") / 4), F.lit(3))
    source = _in_files(rows.filter(third > 0), third.cast("int"), where, 2)
    _drained(stream.round_states(source, before=rows.filter(third == 0)), where, lambda batch, number: batch.write.format("noop").mode("overwrite").save())
    return merge.resolve_rounds(stream.held_rounds(fx.spark, f"{where}/state"))


@register("x3_markdown_values", """SELECT p_partkey, 'o: a: 1' || chr(10) || 'n: ' || p_size || chr(10) || 'l: true, ' || p_brand || chr(10) || 'k: ' || p_name || chr(10) || 'd:   e:     f:       g:         h:           i: ' || p_size || '.5, ' || p_brand
 || chr(10) || 'q: > ' || repeat(p_name, 10) || chr(10) || 'r: ' || CASE WHEN length(p_name) * 3 <= 60 THEN p_name || ', ' || p_name || ', ' || p_name ELSE '- ' || p_name || chr(10) || '- ' || p_name || chr(10) || '- ' || p_name END AS markdown FROM part WHERE length(p_name) > 10
 UNION ALL SELECT p_partkey, p_name FROM part WHERE length(p_name) <= 10""")
def x3(fx):
    """Records of every kind of value, six levels deep, keys in their own order (short names as bare texts)."""
    name, brand, size = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    texts = F.concat(
        F.lit('{"o": [{"a":1},{"b":""}], "n":'), size, F.lit(',"l":[true,null,"'), brand, F.lit('"],"k":"'), name, F.lit('","d":{"e":{"f":{"g":{"h":{"i":['), size, F.lit('.50,"'), brand,
        F.lit('"]}}}}},"e":" ","q":"'), F.repeat(name, F.lit(10)), F.lit('","r":["'), name, F.lit('","'), name, F.lit('","'), name, F.lit('"]}'),
    )
    return fx("part").select("p_partkey", as_markdown(F.when(F.char_length("p_name") > 10, texts).otherwise(name)).alias("markdown"))


@register("f5_failed_items", f"SELECT DISTINCT item_id FROM ({oracle(_ROUNDS)}) WHERE failed")
def f5(fx):
    return merge.resolve_rounds(fx("fx_round")).filter("failed").select("item_id").distinct()


@register("f11_output_names", "SELECT page_id FROM pages WHERE regexp_full_match(CASE WHEN page_id % 2 = 0 THEN url ELSE 'page' || page_id || '.html' END, '[^/]+\\.html')")
def f11(fx):
    name = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")))
    return fx("pages").filter(scan.valid_page_name(name)).select("page_id")


@register("l5_body_caps", "SELECT user_id, string_agg(CAST(event_id AS STRING), ',' ORDER BY event_id) AS first_ten FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 10 GROUP BY user_id")
def l5(fx):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    few = fx("events").select("user_id", "event_id").withColumn("n", n).filter(F.col("n") <= decks.MOST_BODY)
    return few.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("first_ten"))


_L6 = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag"


@register("l6_clipped_tables", f"""SELECT l_orderkey, string_agg(CAST(l_linenumber AS STRING) || CASE WHEN l_linenumber % 4 = 0 THEN ',' || l_returnflag || ',c,d,e' WHEN l_linenumber % 2 = 0 THEN ',' || l_returnflag || CASE WHEN fours > 0 THEN ',,,' ELSE '' END WHEN fours > 0 THEN ',,,,' WHEN evens > 0 THEN ',' ELSE '' END, ';' ORDER BY n) AS rows
 FROM (SELECT *, count(*) FILTER (l_linenumber % 2 = 0) OVER (PARTITION BY l_orderkey) AS evens, count(*) FILTER (l_linenumber % 4 = 0) OVER (PARTITION BY l_orderkey) AS fours FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey {_L6}) AS n FROM lineitem) WHERE n <= 9) GROUP BY l_orderkey""")
def l6(fx):
    wide = [F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.lit("c"), F.lit("d"), F.lit("e"), F.lit("cut")]
    row = F.when(F.col("l_linenumber") % 4 == 0, F.array(*wide)).when(F.col("l_linenumber") % 2 == 0, F.array(*wide[:2])).otherwise(F.array(F.col("l_linenumber").cast("string")))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", row.alias("row"))
    per = fx("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["row"]).alias("t"))
    return per.select("l_orderkey", joined(F.transform(decks.clipped(F.col("t")), lambda r: joined(r)), ";").alias("rows"))


@register("l7_block_choice", "SELECT page_id, CASE WHEN contains(html, '<table') THEN 'table' WHEN contains(html, '<pre') THEN 'code' ELSE 'panel' END AS block FROM pages")
def l7(fx):
    html = F.col("html")
    return fx("pages").select("page_id", F.when(html.contains("<table"), "table").when(html.contains("<pre"), "code").otherwise("panel").alias("block"))


@register("x5_normalised_text", "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\f\\r]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), '^\\s+', ''), '\\s+$', '')) AS text_md5, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS line_md5 FROM documents")
def x5(fx):
    return fx("documents").select("doc_id", F.md5(X.normalise(F.col("text"))).alias("text_md5"), F.md5(X.one_line(F.col("text"))).alias("line_md5"))


@register("x14_padded_cells", "SELECT n_nationkey, rpad(n_name, CAST(greatest(length(n_name), 12) AS INT), ' ') AS cell FROM nation")
def x14(fx):
    return fx("nation").select("n_nationkey", X.pad(F.col("n_name"), F.lit(12)).alias("cell"))


@register("s2_sidecars", "SELECT 'part_' || p_partkey AS slug, CASE WHEN p_partkey % 2 = 0 THEN 'low' END AS confidence, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS notes FROM part")
def s2(fx):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"confidence":"low","notes":"'), "p_brand", F.lit('"}'))).otherwise(F.lit("unreadable"))
    texts = fx("part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string"), F.lit(scan.SIDECAR)).alias("file_name"), raw.alias("raw"))
    return scan.parse_sidecars(texts).select("slug", "confidence", joined("notes").alias("notes"))


@register("w7_first_headings", f"SELECT page_id, coalesce(nullif({_PLAIN.replace('(x,', '(t,', 1)}, ''), 'Slide 0') AS title FROM (SELECT page_id, regexp_extract({_CLEAN}, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS t FROM pages)")
def w7(fx):
    return decks.slide_titles(decks.blocks(fx("pages"))).select("page_id", "title")


@register("w12_category_order", "SELECT item_id, category, CAST(row_number() OVER (PARTITION BY item_id ORDER BY first_pos) AS INT) AS no FROM (SELECT item_id, category, min(pos) AS first_pos FROM fx_field GROUP BY ALL)")
def w12(fx):
    first = fx("fx_field").groupBy("item_id", "category").agg(F.min("pos").alias("first_pos"))
    return coverage.numbered(first, "item_id", "first_pos").select("item_id", "category", "no")


@register("o1_common_fields", "SELECT item_id, string_agg(field, ',' ORDER BY field) AS common FROM (SELECT DISTINCT item_id, field FROM fx_field WHERE field IN (SELECT field FROM fx_framework)) GROUP BY item_id")
def o1(fx):
    s = coverage.field_status(fx("fx_field"), coverage.load_framework(fx("fx_framework"))).filter("status = 'covered'")
    return s.groupBy("item_id").agg(joined(F.array_sort(F.collect_list("field"))).alias("common"))


_FIGURES = f"SELECT coalesce(status, 'all') AS f, count(*) AS files, CAST(sum(greatest(delta, 0)) AS BIGINT) AS lines_added, CAST(sum(greatest(-delta, 0)) AS BIGINT) AS lines_removed FROM ({_CHANGES}) GROUP BY ROLLUP (status)"


@register("r7_review_rows", f"""SELECT 'files' AS block, 'part ' || k AS label, status AS value FROM ({_CHANGES}) WHERE status <> 'unchanged' UNION ALL SELECT 'kpi', unnest(['files ' || f, 'lines_added ' || f, 'lines_removed ' || f]), unnest([files, lines_added, lines_removed])::VARCHAR FROM ({_FIGURES})
 UNION ALL SELECT 'compare', 'part ' || k, b.n_lines || ' → ' || a.n_lines FROM fx_before b JOIN fx_after a USING (k) WHERE b.n_lines <> a.n_lines OR b.name <> a.name UNION ALL SELECT 'risk', dimension || ' ' || severity, count(*)::VARCHAR FROM fx_risk GROUP BY dimension, severity
 UNION ALL SELECT 'decision', 'part ' || k, verdict FROM ({_VERDICTS}) WHERE verdict <> 'correct'""")
def r7(fx):
    return review.page_rows(fx("fx_before"), fx("fx_after"), "k", "n_lines", fx("fx_risk"), _verdicts(fx))
