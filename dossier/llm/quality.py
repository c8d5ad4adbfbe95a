"""Quality rules whose thresholds adapt to each language and source. DataFrame functions only.

Every document gets integer metrics. Quantile sketches per (lang, source) and metric (:mod:`.sketches`) give
quartiles; a metric beyond a fence ``quartile +- FACTOR x interquartile range`` rejects the document. The sketches alone decide where a fence lies: no metric has a constant of its own.

A share (``c`` marks in a text of ``n``) is uncertain in a short text. What is sketched is its cautious upper value ``(c + 1) / (n + 1)``: its spread is never zero where texts differ
in length, so groups in which a mark doesn't occur have a scale too. What is judged is its cautious lower value, ``CAUTION`` standard errors of a count below: ``(c - CAUTION sqrt(c)) / n``. So
neither a single mark of a short text nor a group of equal values rejects an ordinary document.

The logarithms of a group's quartiles are blended with its language's, and those with the corpus's (merged from the same
sketches), by the weight ``n / (n + PRIOR)``, whatever the group's size. A fence lies a sketch's error beyond its quartiles, so equal values never reject one another. The base rules (too few words, too much repetition) always hold.

Defined results: a null text has no words, so the base rules reject it; a null lang or source forms a group of
its own; equal rows get equal verdicts; an empty table gives an empty result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import small, written
from dossier.llm.sketches import ERROR, merge, quantiles, sketch

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Documents at which a group's own quartiles weigh as much as those of the wider group.
PRIOR = 100
#: Interquartile ranges between a quartile and its fence, and standard errors by which a share is judged lower.
FACTOR, CAUTION = 8, 2
#: Shares: the count and what it is a share of. Values are in millionths.
SHARES = {"symbol_share": ("__n_symbols", "__word_chars"), "mark_share": ("__n_marks", "__word_chars"), "dup_share": ("__n_dup_lines", "__n_lines"), "neighbour_share": ("__n_neighbours", "__n_words")}
#: Each metric: the value that is sketched, the value that is judged, and whether it may be too low as well.
METRICS = {"word_length": ("__word_length", "__word_length", True), **{m: (f"__upper_{m}", f"__lower_{m}", False) for m in SHARES}}
SCOPES = ([], ["lang"], ["lang", "source"])


def _repeated_words(h: Column) -> Column:
    """Words inside windows that occur twice or more, from the words' hashes."""
    size = F.size(h)
    windows = F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    return F.when(size <= WINDOW, F.array().cast("array<bigint>")).otherwise(windows)


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base figures ``__n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words`` and the values of :data:`METRICS`."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bare = t
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        bare = F.replace(bare, F.lit(c), F.lit(""))
    df = df.withColumns(
        {
            "__words": F.filter(F.split(t, SPACES), lambda w: w != ""),
            "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "__word_chars": F.length(bare).cast("long"),
            "__n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "__n_marks": F.regexp_count(t, F.lit(r"[!-/:-@\[-`{-~]")).cast("long"),
        }
    )
    df = df.withColumns({"__n_words": F.size("__words").cast("long"), "__hashes": F.transform("__words", lambda w: F.xxhash64(w)), "__n_lines": F.size("__lines"), "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")})
    df = df.withColumn("__n_neighbours", F.size(F.filter("__hashes", lambda w, i: (i > 0) & (w == F.get(F.col("__hashes"), i - 1)))).cast("long"))
    df = df.withColumn("__windows", _repeated_words(F.col("__hashes")))
    df = df.withColumn("__repeats", F.size("__windows") > F.size(F.array_distinct("__windows")))
    # Only texts with repeats are sorted. Neighbours with one hash are the repeated windows.
    df = df.withColumn("__sorted", F.when(F.col("__repeats"), F.array_sort(F.transform("__windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    at = lambda i: F.get(F.col("__sorted"), i)["h"]
    twice = F.filter(
        F.transform("__sorted", lambda p, i: F.when((F.coalesce(at(i - 1) == p["h"], F.lit(False))) | (F.coalesce(at(i + 1) == p["h"], F.lit(False))), p["i"])),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("__at", F.when(F.col("__repeats"), F.array_sort(twice)))
    covered = F.aggregate(
        "__at",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    df = df.withColumn("__n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    values = {"__word_length": F.coalesce(F.try_divide(F.col("__word_chars") * 1_000_000, F.col("__n_words")), F.lit(0)).cast("long")}
    for m, (count, of) in SHARES.items():
        c, n = F.col(count).cast("double"), F.col(of).cast("double")
        values[f"__upper_{m}"] = F.floor((c + 1) * 1_000_000 / (n + 1))
        values[f"__lower_{m}"] = F.floor((c - CAUTION * F.sqrt(c)) * 1_000_000 / F.greatest(n, F.lit(1.0)))
    df = df.withColumns({**values, "__base_failed": (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"))})
    return df.drop("__words", "__lines", "__hashes", "__n_lines", "__windows", "__repeats", "__sorted", "__at")


def thresholds(metrics: DataFrame) -> DataFrame:
    """One row per (lang, source), with the limits of every metric: ``lang, source, __limits map<metric, struct<low, high>>``.

    Documents that the base rules reject take no part. ``metrics`` has ``lang, source, __base_failed`` and the metrics.
    """
    names = [sketched for sketched, _, _ in METRICS.values()]
    fine = written(sketch(metrics.filter(~F.col("__base_failed")), ["lang", "source"], names), "quality-sketches", narrow=True)
    out = metrics.select("lang", "source").distinct().withColumn("__all", F.lit(0))
    for k, keys in enumerate(SCOPES):
        q = quantiles(merge(fine, keys), keys, [250, 750])
        per = q.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("n", "q250", "q750")))).alias(f"__q{k}"))
        per = per.select(*[F.col(c).alias(f"__k_{c}") for c in keys], F.lit(0).alias("__k___all"), f"__q{k}")
        out = out.join(per, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*keys, "__all"]], "left").drop("__k___all", *[f"__k_{c}" for c in keys])

    def blended(metric: str, q: str) -> Column:
        value = F.log1p(F.col("__q0")[metric][q])
        for k in range(1, len(SCOPES)):
            own = F.col(f"__q{k}")[metric]
            value = F.coalesce((own["n"] * F.log1p(own[q]) + PRIOR * value) / (own["n"] + PRIOR), value)
        return F.expm1(value)

    limits = []
    for m, (sketched, _, both) in METRICS.items():
        q1, q3 = blended(sketched, "q250"), blended(sketched, "q750")
        below = (q1 - FACTOR * (q3 - q1)) * (1 - ERROR) if both else F.lit(None).cast("double")
        limits += [F.lit(m), F.struct(below.alias("low"), ((q3 + FACTOR * (q3 - q1)) * (1 + ERROR)).alias("high"))]
    return out.select("lang", "source", F.create_map(*limits).alias("__limits"))


def judged(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """``metrics`` with ``__reasons`` (the metrics beyond their limits) and ``__kept``."""
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "__limits")
    joined = metrics.join(small(limits), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    bound = lambda m, side: F.col("__limits")[m][side]
    beyond = [F.when(F.coalesce(F.col(judged) > bound(m, "high"), F.lit(False)) | F.coalesce(F.col(judged) < bound(m, "low"), F.lit(False)), F.lit(m)) for m, (_, judged, _) in METRICS.items()]
    # One predicate over both sides of the join: a part of it alone would be pushed below, with all that it is made of.
    joined = joined.withColumn("__reasons", F.array_compact(F.array(F.when(F.col("__base_failed"), F.lit("base")), *beyond)))
    return joined.withColumn("__kept", F.size("__reasons") == 0).drop("__lang", "__source", "__limits")


METRIC_COLUMNS = ["lang", "source", "__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__base_failed", *dict.fromkeys(c for m in METRICS.values() for c in m[:2])]


def assess(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the base figures, ``base_failed``, ``kept`` and ``reasons``."""
    metrics = written(with_metrics(docs.select("doc_id", "text", "lang", "source")).select("doc_id", *METRIC_COLUMNS), "quality-metrics")
    out = judged(metrics, thresholds(metrics))
    return out.select(
        "doc_id",
        *[F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")],
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. The rows are written once with their metrics, so that neither is a text shuffled nor a metric made twice."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "lang", "source")
    measured = written(with_metrics(rows).select("row", *METRIC_COLUMNS), "quality-rows")
    return judged(measured, written(thresholds(measured), "quality-limits", narrow=True)).filter("__kept").select("row.*")
