"""Reply trees as formatted conversations. DataFrame functions only.

Messages form trees (``conv, node, parent``). Iterative self-joins over ids alone enumerate the root-to-leaf
paths: round k joins every path entry to its ancestor 2**k steps up, and the ancestor table to itself, so a path
of n turns takes log2(n) rounds. Each round is a written table. Branches are ranked by the sum of their nodes'
scores (ties: the longer, then the least leaf) and the best ones of each conversation are formatted.

The template puts ``<|role|>`` and a line end before, ``<|end|>`` and a line end after each turn. Inside texts
and roles, control strings of this and other common templates lose their first character to an escape
(backslash and digit); backslashes are escaped too, so :func:`unescape` gives back every text.

Defined results: a null text or role is empty; a node whose parent is absent is a root; a node on a cycle has
no root and its conversation's other paths are unaffected; a row with a null node is no message and is left out; of rows with one conversation
and node one stays, that of the least parent, then role, text and score (:func:`chain` gives repeated rows nodes of their own, so they are separate turns there);
a null conversation id is a conversation of its own; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.shared import written

# First characters of control strings, escaped where the rest follows.
_CONTROL = r"(?=\||/?s>|/?INST\]|</?SYS>>|/?SYS>>|start_of_turn>|end_of_turn>)"
END = "<|end|>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    out = F.regexp_replace(out, "<" + _CONTROL, r"\\1")
    return F.regexp_replace(out, r"\[" + _CONTROL, r"\\2")


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\2"), F.lit("[")), F.lit("\\1"), F.lit("<"))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\3"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\3"), F.lit("|")))


def chain(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows of linear conversations as trees: ``conv, node, parent, role, text``; each turn replies to the one before it."""
    w = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), "role", F.xxhash64("text"), "text")
    rows = messages.select(F.col(conv).alias("conv"), F.row_number().over(w).cast("long").alias("node"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def paths(nodes: DataFrame) -> DataFrame:
    """``conv, leaf, node, up``: every node of every root-to-leaf path, ``up`` steps above its leaf. ``nodes``: ``conv, node, parent``."""
    on = lambda a, b, x, y: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    ids = written(nodes.select("conv", "node", "parent"), "tree-nodes", narrow=True)
    hops = ids.filter("parent IS NOT NULL").alias("c").join(ids.alias("p"), on("c", "p", "parent", "node"), "left_semi").select("conv", "node", F.col("parent").alias("above"))
    hops = written(hops, "tree-hops", narrow=True)
    leaves = ids.alias("n").join(hops.alias("h"), on("n", "h", "node", "above"), "left_anti")
    parts = [written(leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "tree-paths", narrow=True)]
    step = 1
    total = ids.count()
    while not hops.isEmpty() and step <= total:
        so_far = parts[0]
        for p in parts[1:]:
            so_far = so_far.unionByName(p)
        more = so_far.alias("a").join(hops.alias("h"), on("a", "h", "node", "node")).select("a.conv", "a.leaf", F.col("h.above").alias("node"), (F.col("a.up") + step).alias("up"))
        parts.append(written(more, "tree-paths", narrow=True))
        hops = written(hops.alias("a").join(hops.alias("b"), on("a", "b", "above", "node")).select("a.conv", "a.node", "b.above"), "tree-hops", narrow=True)
        step *= 2
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` paths of each conversation, formatted.

    ``messages``: ``conv, node, parent, role, text, score``. Result: ``conv, leaf, rank, score, n_turns,
    formatted, loss`` with ``loss array<struct<start, end>>`` the code points of the assistant's texts.
    """
    fields = ("parent", "role", "text", "score")
    messages = messages.select("conv", "node", *fields).filter("node IS NOT NULL")
    if not messages.groupBy("conv", "node").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        messages = written(messages.groupBy("conv", "node").agg(F.min(F.struct(*fields)).alias("m")).select("conv", "node", "m.*"), "tree-messages")
    walk = paths(messages)
    scored = messages.select("conv", "node", "score")
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.node") == F.col(f"{b}.node"))
    ranked = walk.alias("w").join(scored.alias("s"), same("w", "s")).groupBy("w.conv", "w.leaf").agg(F.sum(F.coalesce("s.score", F.lit(0))).alias("score"), F.count(F.lit(1)).alias("n_turns"))
    best = Window.partitionBy("conv").orderBy(F.desc("score"), F.desc("n_turns"), "leaf")
    ranked = written(ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches), "tree-branches", narrow=True)
    chosen = walk.alias("w").join(ranked.alias("r"), F.col("w.conv").eqNullSafe(F.col("r.conv")) & (F.col("w.leaf") == F.col("r.leaf"))).select("w.*", "r.rank", "r.score", "r.n_turns")
    texts = messages.select("conv", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = chosen.alias("c").join(texts.alias("t"), same("c", "t")).select("c.conv", "c.leaf", "c.rank", "c.score", "c.n_turns", "c.up", "t.role", escape(F.col("t.text")).alias("body"))
    turns = turns.withColumn("head", F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>\n"))).withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("upto", F.sum(F.char_length("piece").cast("long")).over(before))
    end = F.col("upto") - len(END)
    turns = turns.withColumn("loss", F.when(F.col("role") == "assistant", F.struct((end - F.char_length("body")).alias("start"), end.alias("end"))))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece", "loss")))
    out = turns.groupBy("conv", "leaf", "rank", "score", "n_turns").agg(listed.alias("turns"))
    return out.select(
        "conv", "leaf", "rank", "score", "n_turns",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["loss"]), lambda x: x.isNotNull()).alias("loss"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: ``array<struct<role, text>>``."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")
    role = lambda p: F.substring_index(F.substring(p, F.lit(3), F.char_length(p)), "|>\n", 1)
    return F.transform(pieces, lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(F.substring(p, F.char_length(role(p)) + 6, F.char_length(p))).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
