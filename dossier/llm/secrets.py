"""Incremental secret scans over a ledger of blobs. DataFrame functions only.

Every version of a document is addressed by the SHA-256 of its content. The ledger, a folder of two tables, holds which blob was scanned
by which version of which rule, and what was found; a scan takes only the pairs that it lacks, once per distinct blob however many
paths hold it, adds its findings, then its pairs, and old and new findings are joined back to all paths. A scan that is lost in
between is done again; its findings count once.

A rule finds leftmost non-overlapping matches of its pattern and keeps those whose value (a group of the
pattern) is long enough, without another try inside a match that fails. Positions are code points: a text is
split by the pattern, and running sums over the lengths of the pieces and matches give each match's place.

Defined results: a null text is an empty blob without findings; repeated rows and copies share one scan; an
empty table, or one wholly in the ledger, adds nothing; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.shared import partitions, scratch, small, written


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    group: int
    min_chars: int

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The contract's patterns, in the order in which kinds are listed.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32),
)
#: Same matches after the length filter, without the many short ones in prose: a greedy run that is too short holds no longer one.
_SHORTCUT = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}


def blob_id(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


SCANNED, FOUND = "blob string, rule string", "blob string, rule string, version int, kind_order int, start long, end long, value string"


class Ledger:
    """The tables ``scanned`` and ``found`` in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name, schema in (("scanned", SCANNED), ("found", FOUND)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCANNED if name == "scanned" else FOUND).parquet(f"{self.path}/{name}")

    def add(self, name: str, rows: DataFrame) -> None:
        rows.coalesce(max(self.spark.sparkContext.defaultParallelism, partitions(self.spark) // 8)).write.mode("append").parquet(f"{self.path}/{name}")

    def findings(self, rules=RULES) -> DataFrame:
        """What the present versions of the ``rules`` found, in whichever scan."""
        keys = [r.key for r in rules]
        return self.table("found").filter(F.concat_ws("@", "rule", "version").isin(keys)).distinct()


def unseen(docs: DataFrame, scanned: DataFrame | None, rules=RULES) -> DataFrame:
    """Distinct blobs with the rules that have yet to scan them: ``blob, text, todo array<string>``. ``scanned``: ``blob, rule``."""
    blobs = docs.select(blob_id().alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(r.key) for r in rules])
    if scanned is None:
        return blobs.withColumn("todo", every)
    seen = scanned.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").withColumn("todo", todo).filter(F.size("todo") > 0).select("blob", "text", "todo")


def findings(blobs: DataFrame, rules=RULES) -> DataFrame:
    """``blob, rule, version, kind_order, start, end, value`` of the blobs' unseen rules."""
    parts = []
    for order, r in enumerate(rules):
        pattern = _SHORTCUT.get(r.name, r.pattern) if r in RULES else r.pattern
        hit = F.array_contains("todo", r.key) & F.col("text").rlike(pattern)
        matched = F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(order).alias("kind_order"),
            F.transform(F.split("text", pattern, -1), lambda x: F.char_length(x)).alias("gaps"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("matches"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(r.group)).alias("values"),
            F.lit(r.min_chars).alias("min_chars"),
        )
        parts.append(F.when(hit, matched))
    found = blobs.select("blob", F.explode(F.array_compact(F.array(*parts))).alias("f")).select("blob", "f.*")
    each = found.select("blob", "rule", "version", "kind_order", "min_chars", F.posexplode(F.arrays_zip("matches", "values", "gaps")).alias("i", "m")).filter(F.col("m.matches").isNotNull())
    each = each.select("blob", "rule", "version", "kind_order", "min_chars", "i", F.char_length("m.matches").alias("len"), F.col("m.gaps").alias("gap"), F.col("m.values").alias("value"))
    before = Window.partitionBy("blob", "rule", "version").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(before)).withColumn("start", F.col("end") - F.col("len"))
    return placed.filter(F.char_length("value") >= F.col("min_chars")).select("blob", "rule", "version", "kind_order", "start", "end", "value")


def scan(docs: DataFrame, ledger: Ledger, rules=RULES) -> None:
    """Scans the pairs of blobs and rule versions that the ``ledger`` lacks and adds findings and pairs to it."""
    with scratch(docs.sparkSession):
        new = written(findings(unseen(docs, ledger.table("scanned"), rules), rules), "secret-findings")
        pairs = docs.select(blob_id().alias("blob")).distinct().select("blob", F.explode(F.array(*[F.lit(r.key) for r in rules])).alias("rule"))
        pairs = written(pairs.join(ledger.table("scanned"), ["blob", "rule"], "left_anti"), "secret-pairs", narrow=True)
        ledger.add("found", new)
        ledger.add("scanned", pairs)


def by_path(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Findings of every path: ``doc_id`` and the columns of ``found``."""
    return docs.select("doc_id", blob_id().alias("blob")).join(small(found), "blob")
