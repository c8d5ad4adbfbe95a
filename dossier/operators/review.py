"""Reconciliation of claims with evidence, plans with reality, before with after, requirements with delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("low", "medium", "high", "critical")


def check_claims(claims: DataFrame, evidence: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Our rule: a claim of an uncheckable kind is unverifiable, one without evidence unsupported, an equal one verified, else corrected."""
    rows = claims.filter(F.col("attribute").isin(*kinds)).join(evidence, ["subject", "attribute"], "left")
    verdict = F.when(F.col("actual").isNull(), "unsupported").when(F.col("claimed") == F.col("actual"), "verified").otherwise("corrected")
    none = claims.filter(~F.col("attribute").isin(*kinds)).withColumns({"actual": F.lit(None).cast("long"), "verdict": F.lit("unverifiable")})
    out = rows.withColumn("verdict", verdict)
    return out.select("doc_id", "subject", "attribute", "claimed", "actual", "verdict").unionByName(none.select("doc_id", "subject", "attribute", "claimed", "actual", "verdict"))


def check_plan(plan: DataFrame, reality: DataFrame, key: str, value: str, risks: DataFrame | None = None) -> DataFrame:
    """Our rule: planned only is unsupported, real only missing; what is in both is risky if ``risks`` (``key, severity``) has a high or critical one for it, else
    correct where both are equal and stale where they differ."""
    p, r = plan.select(key, F.col(value).alias("planned"), F.lit(True).alias("__p")), reality.select(key, F.col(value).alias("real"), F.lit(True).alias("__r"))
    rows = p.join(r, key, "full")
    if risks is None:
        rows = rows.withColumn("__risky", F.lit(False))
    else:
        rows = rows.join(risks.filter(F.col("severity").isin("high", "critical")).select(key, F.lit(True).alias("__risky")).distinct(), key, "left")
    verdict = F.when(F.col("__r").isNull(), "unsupported").when(F.col("__p").isNull(), "missing").when(F.col("__risky"), "risky").when(F.col("planned").eqNullSafe(F.col("real")), "correct").otherwise("stale")
    return rows.select(key, "planned", "real", verdict.alias("verdict"))


def _both(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row per key of two snapshots, with their other columns as structs ``b`` and ``a``, and ``status``."""
    columns = [c for c in before.columns if c != key]
    side = lambda df, to: df.select(key, F.struct(*columns).alias(to))
    rows = side(before, "b").join(side(after, "a"), key, "full")
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("b").eqNullSafe(F.col("a")), "unchanged").otherwise("modified")
    return rows.withColumn("status", status)


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, status`` (added, deleted, modified, unchanged) of two snapshots, compared column by column; nulls are equal to nulls alone."""
    return _both(before, after, key).select(key, "status")


def change_figures(before: DataFrame, after: DataFrame, key: str, lines: str) -> DataFrame:
    """Files and lines added and removed by status, with a total row (status null)."""
    delta = F.coalesce(F.col("a")[lines], F.lit(0)) - F.coalesce(F.col("b")[lines], F.lit(0))
    rows = _both(before, after, key).select("status", delta.alias("delta"))
    return rows.rollup("status").agg(F.count(F.lit(1)).alias("files"), F.sum(F.greatest("delta", F.lit(0))).cast("long").alias("lines_added"), F.sum(F.greatest(-F.col("delta"), F.lit(0))).cast("long").alias("lines_removed"))


def page_rows(before: DataFrame, after: DataFrame, key: str, lines: str, risks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of a review page's tables, as ``block, label, value``: figures (``kpi``), changed files (``files``), figures of modified ones before and after (``compare``),
    risks by dimension and severity (``risk``; ``risks``: ``dimension, severity``) and what the plan's review says of all but correct parts (``decision``; ``verdicts``: ``key, verdict``)."""
    row = lambda block, label, value: (F.lit(block).alias("block"), label.alias("label"), value.cast("string").alias("value"))
    both, name = _both(before, after, key).filter("status <> 'unchanged'"), F.concat(F.lit("part "), F.col(key).cast("string"))
    figures = change_figures(before, after, key, lines).withColumn("of", F.coalesce("status", F.lit("all")))
    kpi = figures.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{c} "), "of").alias("label"), F.col(c).cast("string").alias("value")) for c in ("files", "lines_added", "lines_removed")])).alias("x"))
    out = kpi.select(*row("kpi", F.col("x.label"), F.col("x.value"))).unionByName(both.select(*row("files", name, F.col("status"))))
    change = F.concat(F.col("b")[lines].cast("string"), F.lit(" → "), F.col("a")[lines].cast("string"))
    out = out.unionByName(both.filter("status = 'modified'").select(*row("compare", name, change)))
    counted = risks.groupBy("dimension", "severity").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(counted.select(*row("risk", F.concat_ws(" ", "dimension", "severity"), F.col("n"))))
    return out.unionByName(verdicts.filter("verdict <> 'correct'").select(*row("decision", name, F.col("verdict"))))


def new_modules(before: DataFrame, after: DataFrame, module: str) -> DataFrame:
    """Modules of ``after`` that had no file before, with their files: ``module, files``."""
    return after.join(before.select(module).distinct(), module, "left_anti").groupBy(module).agg(F.count(F.lit(1)).alias("files"))


def requirement_status(parts: DataFrame, key: str, matched: str) -> DataFrame:
    """Per requirement: no part matched is a gap, some partial, all a match."""
    per = parts.groupBy(key).agg(F.count_if(F.col(matched)).alias("n_matched"), F.count(F.lit(1)).alias("n_parts"))
    return per.withColumn("status", F.when(F.col("n_matched") == 0, "gap").when(F.col("n_matched") < F.col("n_parts"), "partial").otherwise("match"))


def status_rollup(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Reviewed, match, gap, partial and the share of matches in whole percent; by group, a total row has a null group."""
    g = rows.rollup(by) if by else rows.groupBy()
    count = lambda s: F.count_if(F.col("status") == s)
    return g.agg(F.count(F.lit(1)).alias("reviewed"), count("match").alias("matched"), count("gap").alias("gaps"), count("partial").alias("partials"), F.floor(count("match") * 100 / F.count(F.lit(1)) + 0.5).cast("long").alias("coverage"))


def uncovered(inventory: DataFrame, mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct inventory rows that nothing maps."""
    return inventory.select(*keys).distinct().join(mapped, keys, "left_anti")


def over_limit(slides: DataFrame, limits: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Counts per slide and kind beyond the kind's limit (``kind, most``)."""
    n = slides.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))
    return n.join(limits, kind).filter("n > most")


def severity_matrix(risks: DataFrame) -> DataFrame:
    """Dimension x severity counts."""
    return risks.groupBy("dimension").pivot("severity", list(SEVERITIES)).count().fillna(0)


def since(items: DataFrame, column: str, first: str | None) -> DataFrame:
    """Items of a date or later; text that is no date goes, no limit keeps all."""
    return items if first is None else items.filter(F.try_to_date(F.col(column).cast("string")) >= F.lit(first).cast("date"))


def route(rows: Column, columns: Column, elements: Column, sections: Column) -> Column:
    """How a table or set of elements is best shown."""
    return F.when(elements >= 15, "overview+detail").when((rows >= 4) | (columns >= 3), "page").when(sections >= 4, "page+nav").otherwise("inline")


#: Kinds of checkable claims and their patterns.
CLAIMS = {
    "url": r"https?://[^\s<>\"']+", "number": r"\b[0-9]+(?:\.[0-9]+)?%", "path": r"\b[A-Za-z0-9_-]+\.(?:py|js|html|json|md)\b",
    "name": r"\b[A-Za-z_][A-Za-z0-9_]*\(\)", "command": r"\b(?:npm|npx|pip|git|python|node|docker|make) [a-z0-9._/-]+",
}


def extract_claims(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, claim`` of every match of :data:`CLAIMS`."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("claim")))

    every = F.concat(*[of(k, p) for k, p in CLAIMS.items()])
    return docs.select(key, F.explode(every).alias("c")).select(key, "c.*")
