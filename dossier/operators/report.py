"""Comparison tables, synthesis and report lines over the field table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import anchor, compact, is_uncertain, pad
from dossier.session import written

# Summary fields that go first, in this order.
PREFERRED = ("release_date", "github_stars", "google_scholar_cites", "swe_bench_score", "user_scale", "valuation", "price", "score")


def summary_fields(fields: DataFrame, top: int = 5) -> DataFrame:
    """Certain fields of two items or more: preferred ones first, then by name; the first ``top``. Of a field table with ``pos`` as an array and
    ``json_type``, only scalars at the top level count."""
    if dict(fields.dtypes).get("pos") == "array<int>" and "json_type" in fields.columns:
        fields = fields.filter((F.size("pos") == 1) & ~F.col("json_type").rlike("^(OBJECT|ARRAY)"))
    rank = F.coalesce(*[F.when(F.col("field") == f, i) for i, f in enumerate(PREFERRED)], F.lit(len(PREFERRED)))
    per = fields.filter(~is_uncertain(F.col("value"))).groupBy("field").agg(F.count_distinct("item_id").alias("n_items")).filter("n_items >= 2")
    return per.withColumn("__rank", rank).orderBy("__rank", "field").limit(top).drop("__rank")


def comparison(fields: DataFrame, columns: list[str]) -> DataFrame:
    """One row per item with a cell per summary field; absent and uncertain values are a dash."""
    cell = F.when(is_uncertain(F.col("value")), F.lit("—")).otherwise(compact(F.col("value")))
    wide = fields.filter(F.col("field").isin(*columns)).withColumn("cell", cell).groupBy("item_id").pivot("field", columns).agg(F.max_by("cell", "pos"))
    return fields.select("item_id").distinct().join(wide, "item_id", "left").fillna("—", columns)


def widths(table: DataFrame, columns: list[str]) -> DataFrame:
    """Width of each column, its header included: ``name, width``."""
    most = table.agg(*[F.greatest(F.lit(len(c)), F.max(F.char_length(c))).alias(c) for c in columns])
    return most.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("width")) for c in columns])).alias("w")).select("w.*")


def comparison_lines(table: DataFrame, columns: list[str]) -> DataFrame:
    """Aligned text rows of a comparison table: ``item_id, line``."""
    w = widths(table, columns).groupBy().pivot("name", columns).agg(F.first("width"))
    w = w.select(*[F.col(c).cast("int").alias(f"__w_{c}") for c in columns])
    padded = F.concat_ws(" | ", *[pad(F.col(c), F.col(f"__w_{c}")) for c in columns])
    return table.join(F.broadcast(w), F.lit(True), "left").select("item_id", F.concat(F.lit("| "), padded, F.lit(" |")).alias("line"))


def contents(items: DataFrame, shown: DataFrame) -> DataFrame:
    """Table-of-contents lines: number, linked name, summary values, failure mark. ``items``: ``item_id, no, name, failed``; ``shown``: ``item_id, rank, field, value``."""
    extra = shown.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("field", F.lit(": "), F.coalesce(compact(F.col("value")), F.lit(""))).alias("t")))), lambda s: s["t"]).alias("parts"))
    none = F.array().cast("array<string>")
    rows = items.join(extra, "item_id", "left").withColumn("parts", F.concat(F.coalesce("parts", none), F.when(F.col("failed"), F.array(F.lit("(research failed)"))).otherwise(none)))
    line = F.concat(F.col("no").cast("string"), F.lit(". ["), F.col("name"), F.lit("](#"), anchor(F.col("name")), F.lit(")"), F.when(F.size("parts") > 0, F.concat(F.lit(" - "), F.array_join("parts", " | "))).otherwise(""))
    return rows.select("item_id", "no", line.alias("line"))


def synthesis(fields: DataFrame, columns: list[str]) -> DataFrame:
    """``rank, field, item_id, part`` with a part ``name: value`` for every certain summary value; one row each, so that no field's values meet in one task.

    A report joins a field's parts in the order of the items (:func:`report_lines`).
    """
    rank = F.coalesce(*[F.when(F.col("field") == c, i) for i, c in enumerate(columns)])
    rows = fields.filter(F.col("field").isin(*columns) & ~is_uncertain(F.col("value")))
    return rows.select(rank.alias("rank"), "field", "item_id", F.concat(F.col("slug"), F.lit(": "), compact(F.col("value"))).alias("part"))


def category_coverage(fields: DataFrame) -> DataFrame:
    """Categories in first-seen order with the number of items that have a certain field there, of all items."""
    total = fields.agg(F.count_distinct("item_id").alias("n_total"))
    per = fields.filter(~is_uncertain(F.col("value"))).groupBy("category").agg(F.count_distinct("item_id").alias("n_items"), F.min(F.struct("item_id", "pos")).alias("__first"))
    return per.join(F.broadcast(total), F.lit(True)).select("category", "n_items", "n_total", F.col("__first.item_id").alias("first_item"), F.col("__first.pos").alias("first_pos"))


def category_members(fields: DataFrame) -> DataFrame:
    """``category, item_id, slug`` of the categories that some item lacks: the names that are listed beside ``n/N``."""
    partly = category_coverage(fields).filter("n_items < n_total").select("category")
    rows = fields.filter(~is_uncertain(F.col("value"))).select("category", "item_id", "slug").distinct()
    return rows.join(partly, "category", "left_semi")


def detail_lines(fields: DataFrame, citations: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Detail lines of each item in order: a heading where a category starts, its certain fields, its sources. ``item_id, ord, line``.

    A value of one line has its citations (``item_id, field, ref_ord, idx``) behind it, one of several lines stands below its name. ``sources``: ``item_id, n, line``.
    """
    first = F.min("pos").over(Window.partitionBy("item_id", "category"))
    rows = fields.filter(~is_uncertain(F.col("value")) & (F.col("value") != "")).withColumn("__cat", first)
    place = lambda part, cat, pos: F.struct(F.lit(part).alias("part"), cat.cast("long").alias("cat"), pos.cast("long").alias("pos"))
    heads = rows.select("item_id", "category", "__cat").distinct().select("item_id", place(0, F.col("__cat"), F.lit(-1)).alias("ord"), F.concat(F.lit("### "), "category").alias("line"))
    marks = F.lit("")
    if citations is not None:
        cited = citations.groupBy("item_id", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_ord", "idx"))), lambda x: F.concat(F.lit("["), x["idx"].cast("string"), F.lit("]"))), "").alias("__cited"))
        rows = rows.join(cited, ["item_id", "field"], "left")
        marks = F.coalesce(F.concat(F.lit(" "), "__cited"), F.lit(""))
    several = F.concat(F.lit("**"), "field", F.lit("**\n\n"), "value")
    line = F.when(F.col("value").contains("\n"), several).otherwise(F.concat(F.lit("- **"), "field", F.lit("**: "), "value", marks))
    out = heads.unionByName(rows.select("item_id", place(0, F.col("__cat"), F.col("pos")).alias("ord"), line.alias("line")))
    if sources is not None:
        out = out.unionByName(sources.select("item_id", place(1, F.lit(0), F.col("n")).alias("ord"), "line"))
        out = out.unionByName(sources.select("item_id").distinct().select("item_id", place(1, F.lit(0), F.lit(-1)).alias("ord"), F.lit("**Sources**").alias("line")))
    return out


def uncertainty_lines(items: DataFrame, uncertain: DataFrame, missing: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Lines of the uncertainty section: ``item_id, part, pos, line``.

    ``items``: ``item_id``; ``uncertain`` and ``missing``: ``item_id, pos, field``; ``sidecars``: ``item_id, confidence, conflicts, notes`` (arrays). An item without any of these says so.
    """
    line = lambda part, pos, text: (F.lit(part).alias("part"), pos.cast("long").alias("pos"), text.alias("line"))

    def listed(rows: DataFrame, part: int, title: str) -> DataFrame:
        heads = rows.select("item_id").distinct().select("item_id", *line(part, F.lit(-1), F.lit(f"**{title}**:")))
        return heads.unionByName(rows.select("item_id", *line(part, F.col("pos"), F.concat(F.lit("- "), F.col("field")))))

    conflicts = sidecars.select("item_id", F.posexplode("conflicts").alias("pos", "field"))
    notes = F.filter("notes", lambda n: n != "")
    out = listed(uncertain, 1, "Uncertain fields").unionByName(listed(missing, 2, "Missing fields"))
    out = out.unionByName(sidecars.filter("confidence <> ''").select("item_id", *line(3, F.lit(0), F.concat(F.lit("**Verification confidence**: "), "confidence"))))
    out = out.unionByName(listed(conflicts, 4, "Conflicts"))
    out = out.unionByName(sidecars.filter(F.size(notes) > 0).select("item_id", *line(5, F.lit(0), F.concat(F.lit("**Verification notes**: "), F.array_join(notes, "; ")))))
    none = items.select("item_id").join(out, "item_id", "left_anti").select("item_id", *line(6, F.lit(0), F.lit("_No uncertainty flags; verification metadata absent._")))
    return out.unionByName(none)


def item_rows(items: DataFrame, fields: DataFrame, columns: list[str], sidecars: DataFrame, citations: DataFrame, sources: DataFrame, missing: DataFrame) -> DataFrame:
    """One row per item with all that a report says of it, gathered by one shuffle of one tagged stream: each table is scanned once and none is joined.

    ``item_id, no, name, failed, cells`` (of ``columns``), ``fields`` (in order, each ``sure`` or not, with its category's first place ``cat`` and its citations ``cited``), ``sources``,
    ``missing``, ``sides``. What belongs to no item goes.
    """
    kinds = {"no": "long", "name": "string", "failed": "boolean", "pos": "int", "category": "string", "field": "string", "value": "string", "cite": "struct<ref_ord:long,idx:long>", "source": "struct<n:long,line:string>", "lack": "struct<pos:long,field:string>", "side": "struct<confidence:string,conflicts:array<string>,notes:array<string>>"}

    def tagged(df: DataFrame, **own: Column | str) -> DataFrame:
        return df.select("item_id", *[(F.lit(None) if c not in own else F.col(own[c]) if isinstance(own[c], str) else own[c]).cast(t).alias(c) for c, t in kinds.items()])

    rows = tagged(items, no="no", name="name", failed="failed")
    for more in (
        tagged(fields, pos="pos", category="category", field="field", value="value"), tagged(citations, field="field", cite=F.struct("ref_ord", "idx")),
        tagged(sources, source=F.struct("n", "line")), tagged(missing, lack=F.struct("pos", "field")), tagged(sidecars, side=F.struct("confidence", "conflicts", "notes")),
    ):
        rows = rows.unionByName(more)
    sure = ~is_uncertain(F.col("value"))
    first = F.min(F.when(sure, F.col("pos"))).over(Window.partitionBy("item_id", "category"))
    cites = F.array_sort(F.collect_list("cite").over(Window.partitionBy("item_id", "field")))
    cited = F.array_join(F.transform(cites, lambda x: F.concat(F.lit("["), x["idx"].cast("string"), F.lit("]"))), "")
    rows = rows.repartition("item_id")  # the windows and the groups below all find their rows there
    rows = rows.withColumns({"cat": first, "cited": F.when(F.col("pos").isNotNull(), cited)})
    field = F.when(F.col("pos").isNotNull(), F.struct("pos", "category", "field", "value", sure.alias("sure"), "cat", "cited"))
    per = rows.groupBy("item_id").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("no", "name", "failed")], F.array_sort(F.collect_list(field)).alias("fields"),
        F.array_sort(F.collect_list("source")).alias("sources"), F.array_sort(F.collect_list("lack")).alias("missing"), F.collect_list("side").alias("sides"),
    ).filter("no IS NOT NULL")

    def cell(column: str) -> Column:
        found = F.try_element_at(F.filter("fields", lambda f: f["field"] == column), F.lit(-1))
        return F.when(found["sure"], compact(found["value"])).otherwise(F.lit("—"))

    return per.withColumn("cells", F.array(F.coalesce("name", F.lit("")), *[F.coalesce(cell(c), F.lit("—")) for c in columns]))


def report_lines(items: DataFrame, fields: DataFrame, columns: list[str], sidecars: DataFrame, citations: DataFrame, sources: DataFrame, missing: DataFrame) -> DataFrame:
    """The whole report as ordered lines: ``section`` 1 to 5 (contents, comparison, details, synthesis, uncertainty), ``no, part, cat, pos, line``.

    ``items``: ``item_id, no, slug, name, failed``; the other tables as in the sections' own functions. :func:`item_rows` is written once, and each item's lines of all sections come
    from its row. Sorted by its columns (``reports.write_report`` of the sources) the lines are the report, however many items there are.
    """
    table = written(item_rows(items, fields, columns, sidecars, citations, sources, missing), "report-items")
    own = ["Name", *columns]

    def at(section, no, part, cat, pos, line) -> Column:
        number = lambda x, kind: (F.lit(x) if isinstance(x, int) else x).cast(kind)
        return F.struct(number(section, "int").alias("section"), number(no, "long").alias("no"), number(part, "int").alias("part"), number(cat, "long").alias("cat"), number(pos, "long").alias("pos"), line.alias("line"))

    def rank(field: Column) -> Column:
        return F.coalesce(*[F.when(field == c, i) for i, c in enumerate(columns)])

    no, name, found = F.col("no"), F.col("name"), F.col("fields")
    ok, sure = ~F.col("failed"), F.filter("fields", lambda f: f["sure"])
    when = lambda condition, lines: F.when(condition, lines).otherwise(F.slice(lines, 1, 0))

    # Contents and comparison.
    shown = F.array_sort(F.transform(F.filter(found, lambda f: f["field"].isin(*columns)), lambda f: F.struct(rank(f["field"]).alias("rank"), f["pos"], F.concat(f["field"], F.lit(": "), F.coalesce(compact(f["value"]), F.lit(""))).alias("t"))))
    parts = F.concat(F.transform(shown, lambda s: s["t"]), F.when(ok, F.array().cast("array<string>")).otherwise(F.array(F.lit("(research failed)"))))
    toc = F.concat(no.cast("string"), F.lit(". ["), name, F.lit("](#"), anchor(name), F.lit(")"), F.when(F.size(parts) > 0, F.concat(F.lit(" - "), F.array_join(parts, " | "))).otherwise(""))
    ruled = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    row = ruled(F.zip_with("cells", "widths", lambda c, w: pad(c, w)))
    lines = [F.array(at(1, no, 0, 0, 0, toc), at(2, no, 0, 0, 0, row), at(3, no, 0, -1, -1, F.concat(F.lit("## "), name, F.lit("\n"))), at(5, no, 0, 0, -1, F.concat(F.lit("## "), name, F.lit("\n"))))]

    # Details: categories, their fields, sources.
    several = lambda f: F.concat(F.lit("**"), f["field"], F.lit("**\n\n"), f["value"])
    single = lambda f: F.concat(F.lit("- **"), f["field"], F.lit("**: "), f["value"], F.when(f["cited"] != "", F.concat(F.lit(" "), f["cited"])).otherwise(""))
    heads = F.array_distinct(F.transform(F.filter(sure, lambda f: f["pos"] == f["cat"]), lambda f: at(3, no, 1, f["cat"], -1, F.concat(F.lit("### "), f["category"]))))
    lines += [
        when(~ok, F.array(at(3, no, 1, 0, 0, F.lit("> Research failed for this item (no results).\n")))), when(ok, heads),
        when(ok, F.transform(sure, lambda f: at(3, no, 1, f["cat"], f["pos"], F.when(f["value"].contains("\n"), several(f)).otherwise(single(f))))),
        when(ok & (F.size(sure) == 0), F.array(at(3, no, 1, 0, 0, F.lit("_No reportable fields (all values uncertain or empty)._\n")))),
        when(ok & (F.size("sources") > 0), F.array(at(3, no, 2, 0, -1, F.lit("**Sources**")))), when(ok, F.transform("sources", lambda s: at(3, no, 2, 0, s["n"], s["line"]))),
    ]

    # Synthesis of one item: its summary values and its contradictions.
    conflicts = F.flatten(F.transform("sides", lambda v: F.coalesce(v["conflicts"], F.array().cast("array<string>"))))
    lines += [
        F.transform(F.filter(sure, lambda f: f["field"].isin(*columns)), lambda f: at(4, 0, 0, rank(f["field"]), F.col("item_id"), F.concat(F.lit("- **"), f["field"], F.lit("** — "), name, F.lit(": "), compact(f["value"])))),
        F.transform(conflicts, lambda c, i: at(4, 1, 2, no, i, F.concat(F.lit("- "), name, F.lit(": "), c))),
    ]

    # Uncertainty.
    def listed(part: int, title: str, rows: Column, pos, text) -> list[Column]:
        return [when(F.size(rows) > 0, F.array(at(5, no, part, 0, -1, F.lit(f"**{title}**:")))), F.transform(rows, lambda x, i: at(5, no, part, 0, pos(x, i), F.concat(F.lit("- "), text(x))))]

    doubts = F.filter("fields", lambda f: ~f["sure"])
    rated = F.filter("sides", lambda v: F.coalesce(v["confidence"] != "", F.lit(False)))
    notes = F.filter(F.transform("sides", lambda v: F.array_join(F.filter(v["notes"], lambda n: n != ""), "; ")), lambda n: F.coalesce(n != "", F.lit(False)))
    none = (F.size(doubts) == 0) & (F.size("missing") == 0) & (F.size(rated) == 0) & (F.size(conflicts) == 0) & (F.size(notes) == 0)
    lines += [
        *listed(1, "Uncertain fields", doubts, lambda x, i: x["pos"], lambda x: x["field"]), *listed(2, "Missing fields", F.col("missing"), lambda x, i: x["pos"], lambda x: x["field"]),
        F.transform(rated, lambda v: at(5, no, 3, 0, 0, F.concat(F.lit("**Verification confidence**: "), v["confidence"]))), *listed(4, "Conflicts", conflicts, lambda x, i: i, lambda x: x),
        F.transform(notes, lambda n: at(5, no, 5, 0, 0, F.concat(F.lit("**Verification notes**: "), n))), when(none, F.array(at(5, no, 6, 0, 0, F.lit("_No uncertainty flags; verification metadata absent._")))),
    ]
    widths = table.agg(F.array(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.char_length(F.col("cells")[i])), F.lit(0))) for i, c in enumerate(own)]).alias("widths"))
    out = table.join(F.broadcast(widths), F.lit(True)).select(F.explode(F.concat(*lines)).alias("l")).select("l.*")  # one row of widths

    # What is said of all items together.
    whole = lambda df, *rows: df.select(F.explode(F.array(*rows)).alias("l")).select("l.*")
    head = [pad(F.lit(c), F.col("widths")[i]) for i, c in enumerate(own)]
    out = out.unionByName(whole(widths, at(2, -1, 1, 0, 0, ruled(F.array(*head))), at(2, -1, 1, 0, 1, ruled(F.transform("widths", lambda w: F.repeat(F.lit("-"), w))))))
    has = table.select("item_id", "name", F.explode(F.array_distinct(F.transform(sure, lambda f: F.struct(f["category"].alias("category"), f["cat"].alias("cat"))))).alias("c")).select("item_id", "name", "c.*")
    total = table.agg(F.count_if(F.size("fields") > 0).alias("n_total"), F.sum(F.size(conflicts)).alias("n_conflicts"))
    cover = has.groupBy("category").agg(F.count(F.lit(1)).alias("n_items"), F.min(F.struct("item_id", "cat")).alias("f")).join(F.broadcast(total), F.lit(True))  # one row of totals
    cover = cover.withColumn("order", F.col("f.item_id") * 1_000_000 + F.col("f.cat"))
    present = F.concat(F.lit("- **"), "category", F.lit("** — present in "), F.col("n_items").cast("string"), F.lit("/"), F.col("n_total").cast("string"), F.lit(" item(s)"))
    out = out.unionByName(whole(cover, at(4, 0, 1, F.col("order"), -1, present)))
    out = out.unionByName(whole(has.join(cover.filter("n_items < n_total").select("category", "order"), "category"), at(4, 0, 1, F.col("order"), F.col("item_id"), F.concat(F.lit("  - "), "name"))))
    said = F.when(F.col("n_conflicts") > 0, F.lit("\n## Contradictions (from verification)\n")).otherwise(F.lit("\nNo source contradictions were recorded in the verification metadata."))
    titles = ["# Table of Contents\n", "# Comparison\n", "# Detailed Content\n", "# Cross-Item Synthesis\n\n## Summary-field comparison\n", "# Uncertainty & Confidence\n"]
    return out.unionByName(whole(total, at(4, 1, 2, -1, -1, said), at(4, 0, 1, -1, -1, F.lit("\n## Category coverage\n")), *[at(k, -1, 0, 0, -1, F.lit(t)) for k, t in enumerate(titles, 1)]))


def conflict_lines(sidecars: DataFrame) -> DataFrame:
    """``item_id, line`` of every recorded conflict."""
    return sidecars.filter("n_conflicts > 0").select("item_id", F.format_string("item %d: %d conflict(s), confidence %s", "item_id", "n_conflicts", "confidence").alias("line"))
