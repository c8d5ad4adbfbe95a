"""Hand-made cases of the evidence-table operators."""

import json

import pytest
from pyspark.sql import functions as F

from dossier.functions import records
from dossier.functions import text as X
from dossier.functions.values import as_markdown, markdown
from dossier.operators import coverage, decks, flatten, merge, numbering, report, review, specs
from dossier.session import configured
from dossier.sources import files, reports
from dossier.sources import items as scan
from dossier.streaming import events as stream


def merged(spark, left, right):
    df = lambda rows: spark.createDataFrame([(1, p, v) for p, v in rows], "item_id long, path string, value string")
    return {(r["path"], r["value"]) for r in merge.merge_leaves(df(left), df(right)).collect()}


def test_merge_of_leaves(spark):
    assert merged(spark, [("a", "1"), ("b.c", "2")], [("b.d", "3")]) == {("a", "1"), ("b.c", "2"), ("b.d", "3")}
    assert merged(spark, [("b.c", "2"), ("b.e", "4")], [("b", "x")]) == {("b", "x")}  # a scalar replaces an object
    assert merged(spark, [("b", "x")], [("b.c", "2")]) == {("b.c", "2")}  # and an object a scalar
    assert merged(spark, [("b.c", "2")], [("b", "{}")]) == {("b.c", "2")}  # {} over an object keeps it
    assert merged(spark, [("b", "x")], [("b", "{}")]) == {("b", "{}")}
    assert merged(spark, [("b.c", "2")], [("b", None)]) == {("b", None)}  # an explicit null wins
    assert merged(spark, [("a", "1"), ("b.c", "2")], [("a", "1"), ("b.c", "2")]) == {("a", "1"), ("b.c", "2")}


def test_merged_documents(spark):
    pairs = [('{"a":{"b":1,"c":[1]},"k":"x"}', '{"a":{"c":[2],"d":{}},"k":{"y":1.50}}', '{"a":{"b":1,"c":[2],"d":{}},"k":{"y":1.50}}'), ('{"a":1}', '{"a":null}', '{"a":null}'), ("[1]", '{"a":2}', '{"a":2}'), ('{"a":{}}', '{"a":{"b":0}}', '{"a":{"b":0}}'), (None, '{"z":1}', '{"z":1}'), ('{"z":2}', None, '{"z":2}'), ("oops", "[3]", "[3]"), ('{"o":1}', "oops", '{"o":1}')]
    deep = ['{"k":' * 900 + v + "}" * 900 for v in ('{"l":1}', '{"r":2}', '{"l":1,"r":2}')]
    pairs.append(tuple(deep))
    side = lambda i: spark.createDataFrame([(k if k else None, p[i]) for k, p in enumerate(pairs) if p[i] is not None], "item_id long, raw string")
    got = {r["item_id"] or 0: r["raw"] for r in merge.merge_documents(side(0), side(1)).collect()}
    assert got == {k: p[2] for k, p in enumerate(pairs)}


def test_fields_of_items(spark):
    configured(spark)
    raw = json.dumps({"name": "n", "basic_info": {"z": 1, "a": None, "description": "x"}, "misc": {"history": {"y": True}, "deep": {"t": "v"}}, "performance": 3, "top": "[uncertain] t", "l": [1, 2], "uncertain": ["t"]})
    rows = flatten.explode_fields(spark.createDataFrame([(1, raw)], "item_id long, raw string")).orderBy("pos").collect()
    assert [(r["category"], r["field"], r["raw"], r["is_uncertain"]) for r in rows] == [
        ("Basic Info", "z", "1", False), ("Basic Info", "a", None, True), ("History", "y", "true", False), (flatten.OTHER, "t", "v", True),
        ("Performance Metrics", "performance", "3", False), (flatten.OTHER, "top", "[uncertain] t", True), (flatten.OTHER, "l", "[1,2]", False),
    ]
    names = flatten.field_names(spark.createDataFrame([(1, raw), (2, '[{"a":1},{"history":{"b":2}},3]')], "item_id long, raw string")).collect()
    assert {r["field"] for r in names if r["item_id"] == 1} == {"name", "z", "a", "description", "misc", "top", "l"}
    assert {r["field"] for r in names if r["item_id"] == 2} == {"a", "b"}


def test_category_aliases(spark):
    frame = spark.createDataFrame([("Basic Info", 1, "brand", 1), ("History", 2, "basic_info", 2)], "category string, category_pos int, field string, field_pos int")
    builtin = spark.createDataFrame(flatten.alias_rows(), "alias string, canonical string")
    got = {r["alias"]: r["canonical"] for r in flatten.category_aliases(builtin, frame).collect()}
    assert got["brand"] == got["Basic Info"] == "Basic Info" and got["basic_info"] == "History" and got["market"] == "Market Positioning"


def test_scan(spark, tmp_path):
    configured(spark)
    (tmp_path / "a.json").write_text('{"v": 1, "v": 2}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{oops")
    (tmp_path / "a.verification.json").write_text('{"confidence": "low", "conflicts": ["x"], "notes": "n"}')
    (tmp_path / "c.verification.json").write_text("nothing")
    texts = scan.read_texts(spark, str(tmp_path))
    good, bad = scan.parse_items(texts)
    assert [(r["slug"], r["v"]) for r in good.select("slug", F.variant_get("doc", "$.v", "int").alias("v")).collect()] == [("a", 2)]
    assert {(r["file_name"], r["reason"]) for r in bad.collect()} == {("b.json", "not an object"), ("c.json", "malformed")}
    side = {r["slug"]: r for r in scan.parse_sidecars(texts).collect()}
    assert side["a"]["notes"] == ["n"] and side["a"]["conflicts"] == ["x"] and side["c"]["confidence"] is None
    scan.write_results(spark.createDataFrame([(1, "x", 1)], "item_id long, v string, batch int"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).select("value").first()[0] == '{"item_id":1,"v":"x"}'
    frame = spark.createDataFrame([('{"field_categories":[{"category":"c","fields":[{"name":"f"}]}]}',)], "raw string")
    assert scan.parse_framework(frame).select("category", "field", "required").first() == ("c", "f", False)


def test_spec_errors(spark):
    spec = {"title": "t", "bad": 1, "sections": [{"title": "", "tone": "x", "risks": [{"title": "a", "body": "b", "severity": "huge"}, 3], "cards": [], "table": {"columns": ["a"], "rows": [["1", "2"], [3]]}, "flow": {"nodes": [{"id": "a", "label": "A"}], "edges": [{"from": "a", "to": "z"}]}}, 5]}
    df = spark.createDataFrame([(1, json.dumps(spec)), (2, "[]"), (3, '{"title":"t","sections":[]}'), (4, '{"title":"t","sections":[{"title":"s"}]}')], "spec_id long, raw string")
    got = {r["spec_id"]: r["errors"] for r in specs.validate(df).collect()}
    assert got[1] == sorted([
        "spec.bad is not supported", "spec.sections[0].title must be a non-empty string", "spec.sections[0].tone must be neutral, accent, positive, warning, danger, or info",
        "spec.sections[0].risks[0].severity must be low, medium, high, or critical", "spec.sections[0].risks[1] must be an object", "spec.sections[0].cards must be a non-empty array",
        "spec.sections[0].table.rows[0] must match the column count", "spec.sections[0].table.rows[1] must be an array of strings", "spec.sections[0].flow.edges[0].to must reference a flow node", "spec.sections[1] must be an object",
    ])
    assert got[2] == ["spec must be an object"] and got[3] == ["spec.sections must be a non-empty array"] and got[4] == []


def test_a_spec_is_parsed_once_for_its_page(spark):
    df = spark.createDataFrame([(1, '{"title":"t","sections":[{"title":"a"},{"title":"b"}]}'), (2, '{"title":"t","sections":[]}'), (3, "x"), (4, None)], "spec_id long, raw string")
    pages = specs.render(df)
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("parseJson") + pages._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") == 1
    assert [(r["spec_id"], r["title"], r["html"].count('class="section-kicker"')) for r in pages.collect()] == [(1, "t", 2)]


def test_requirement_audit(spark):
    rows = spark.createDataFrame([(i, "gap" if i == 3 else "match") for i in range(14)], "req_id long, status string")
    r = review.status_rollup(rows).first()
    assert (r["reviewed"], r["matched"], r["gaps"], r["coverage"]) == (14, 13, 1, 93)


def test_pages(spark):
    html = '<section class="slide"><h2 class="slide__heading">T<b>i</b></h2><p>one<p>two <script>"</p>"</script><ul><li>x<li>X</ul><pre>a\n b</pre><table><tr><td>c</table></section><section class="slide"><nav><p>n<p>m</nav><div class="card">k</div></section>'
    found = decks.blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    rows = found.orderBy("page_id", "pos").collect()
    assert [(r["slide"], r["kind"], r["text"]) for r in rows if r["kind"] not in ("table", "display")] == [(1, "heading", "Ti"), (1, "paragraph", "one"), (1, "paragraph", "two"), (1, "item", "x"), (1, "item", "X"), (1, "code", "a\nb"), (2, "card", "k")]
    assert [r["rows"] for r in rows if r["kind"] == "table"] == [[["c"]]]
    assert {(r["slide"], r["title"]) for r in decks.slide_titles(found).collect()} == {(1, "Ti"), (2, "Slide 2")}
    body = [r["text"] for r in decks.body_parts(found).filter("slide = 1").orderBy("n").collect()]
    assert body == ["x", "one", "two"]
    table = spark.createDataFrame([([["a"], ["b", "c", "d", "e", "f", "g"]],)], "t array<array<string>>")
    assert table.select(decks.clipped(F.col("t"))).first()[0] == [["a", "", "", "", ""], ["b", "c", "d", "e", "f"]]


def slides_of(spark, html):
    return decks.block_choice(decks.slides(decks.blocks(spark.createDataFrame([(1, html)], "page_id long, html string")))).filter("slide > 0").orderBy("slide").collect()


def test_references_without_an_end_are_text(spark):
    html = "<h1>a &amp b&amp; &lt;c&amp</h1><p>&notit; &#65 &#65;&#x42; &copy2 &;&&amp;lt;</p><script class='diagram-source'>x && y &amp; z</script>"
    found = {r["kind"]: r["text"] for r in decks.blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()}
    assert found == {"heading": "a &amp b& <c&amp", "paragraph": "&notit; &#65 AB &copy2 &;&&lt;", "diagram": "Diagram source: x && y &amp; z"}


def test_texts_of_blocks(spark):
    """Texts are normalised as the column expressions do, once, where pages are parsed: no expression over long texts follows, which a filter would run twice."""
    odd = [" a \xa0 b\t\x0b c\n\n d \u3000", "\x1c e\x85\u2028 f \x0b\n\x0b g\r\n", "\u3000\xa0 ", "x" * 84 + "  \u3000 y z", "\n \u2003\n h \x0b i"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", X.one_line(X.normalise(F.col("t"))).alias("line"), X.normalise(F.col("t")).alias("lines"), X.truncate(X.one_line(X.normalise(F.col("t"))), 90).alias("cut"))
    assert [(decks._line(t), decks._lines(t), decks._cut(decks._line(t), 90)) for t in odd] == [(r["line"], r["lines"], r["cut"]) for r in df.orderBy("i").collect()]
    found = decks.blocks(spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string"))
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_assembled_slides(spark):
    long_ = "word " * 100
    tables = "".join(f"<table><tr><td>{k}</td></tr><tr><td>&nbsp;</td></tr></table>" for k in range(3)) + "<table><tr><td></td></tr></table>"
    codes = "".join(f"<pre>  {k}\n\n x  y</pre>" for k in range(2)) + f"<pre>{long_ * 3}</pre>"
    items = "".join(f"<li>item {k}</li>" for k in range(12))
    first = f'<section class="slide"><h1>Title</h1><p class="kicker">kick</p><h2 class="subtitle"> </h2>{tables}{codes}<div class="mermaid">a --&gt; b <p>in it</p></div><script class="diagram-source"></script><ul>{items}<li>ITEM 3</li></ul><p>Title</p><p>kick</p><p>{long_}</p><div class="deck-hint">h</div></section>'
    second = '<section class="slide"><div class="panel">p</div><article>art <b>x</b></article><pre class="mermaid">m</pre></section>'
    got = slides_of(spark, f'<div class="slide"><p>no section</p></div>{first}{second}')
    one, two = got
    assert (one["title"], one["subtitle"], one["block"]) == ("Title", "kick", "table") and one["tables"] == [[["0"]], [["1"]]]
    assert one["codes"] == ["0\nx y", "1\nx y"] and len(one["body"]) == 10
    assert one["body"][:3] == ["Diagram source: a --> b in it", decks.NO_DIAGRAM, "item 0"]
    assert (two["title"], two["subtitle"], two["body"], two["block"]) == ("Slide 2", "", ["Diagram source: m", "p", "art x"], "panel")
    # Without sections, elements of the class that show something.
    fallback = slides_of(spark, f'<div class="slide"><div>bare</div></div><div class="slide"><p>{long_}</p><pre>{long_ * 9}</pre><table><tr><td>{long_}</td></tr></table></div>')
    assert len(fallback) == 1 and len(fallback[0]["body"][0]) == len(("word " * 44).strip()) + 1 and fallback[0]["body"][0].endswith("…")
    assert len(fallback[0]["codes"][0]) == 850 and len(fallback[0]["tables"][0][0][0]) == 90


def test_values_as_markdown(spark):
    configured(spark)

    def text(v, depth=0):  # what each kind of value says
        if v is None:
            return ""
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return "\n".join(f"> {x}" for x in v.split("\n")) if len(v) > 100 and "[uncertain]" not in v else v
        if isinstance(v, dict):
            return "\n".join(f"{'  ' * depth}{k}: {text(x, depth + 1)}" for k, x in v.items() if x is not None and not (isinstance(x, str) and not x.strip()))
        if isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
            rows = [" | ".join(f"{k}: {text(x)}" for k, x in e.items() if x is not None and x != "") for e in v]
            return "\n".join(r for r in rows if r)
        if isinstance(v, list):
            parts = [text(x, depth) for x in v]
            full = [x for x in parts if x]
            return ", ".join(full) if sum(map(len, parts)) <= 60 else "\n".join(f"- {x}" for x in full)
        return str(v)

    values = [None, True, 12, "short", "x" * 101, "a line\n" + "y" * 120, "[uncertain] " + "z" * 120, {"a": 1, "b": None, "c": " ", "d": {"e": "f", "g": [1, 2]}}, [], [1, "b", None, True], ["w" * 40, "v" * 40], [{"k": 1, "l": ""}, {"k": None}, {"m": [1, 2]}], [1, {"a": "b"}], {"z": 1.50, "a": {"y": {"x": {"w": {"v": {"u": [2, {"t": "s"}]}}}}}, "m": [{"q": {"p": 0}, "o": False}]}, {"a": {}, "b": [], "c": [{}]}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, raw string")
    got = {r["i"]: r["m"] for r in df.select("i", as_markdown(F.col("raw")).alias("m")).collect()}
    assert got == {i: text(v) for i, v in enumerate(values)}
    deep = '{"k":' * 3000 + "[1]" + "}" * 3000
    assert markdown(records.parsed(deep)) == "".join("  " * d + "k: " for d in range(3000)) + "1"
    odd = spark.createDataFrame([(None,), ("oops {",)], "raw string")
    assert [r["m"] for r in odd.select(as_markdown(F.col("raw")).alias("m")).collect()] == ["", "oops {"]


def test_records():
    deep = "[" * 5000 + '{"a": [1, {"b": 1.50, "c": "\\u00e9\\n"}], "d": {}, "a": []}' + "]" * 5000
    value = records.parsed(deep)
    assert records.compact(value) == "[" * 5000 + '{"a":[],"d":{}}' + "]" * 5000
    for text in ('{"a": [1, -2.50e3, {"b": null, "c": "é\\n"}], "d": {}, "e": [[], [true]]}', " 7 ", '"x"', "[]", "null"):
        assert records.compact(records._deep(text)) == records.compact(records.parsed(text)) == json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":")).replace("-2500.0", "-2.50e3")
    for text in ("", "{", "[1,]", "{,}", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", "1 2", "]", "[}", "nul", "NaN", "01", '{"a":1 "b":2}', "{1:2}", ":", ",", '["a":1]'):
        for read in (records.parsed, records._deep):
            with pytest.raises(ValueError):
                read(text)


def test_fields_of_any_depth(spark):
    configured(spark)
    nested = {"leaf": 1, "history": {"old": 2}}
    for _ in range(800):
        nested = {"n": nested}
    deep = flatten.explode_fields(spark.createDataFrame([(1, json.dumps(nested)), (2, "oops"), (3, None), (4, "[1]")], "item_id long, raw string"))
    assert [(r["item_id"], r["category"], r["field"], r["raw"], len(r["pos"])) for r in deep.orderBy("category").collect()] == [(1, "History", "old", "2", 802), (1, flatten.OTHER, "leaf", "1", 801)]
    plan = lambda d: flatten.explode_fields(spark.createDataFrame([(1, "{}" if not d else json.dumps(nested))], "item_id long, raw string"))._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(0) == plan(800)
    doc = {"history": {"y": 1}, "z": 2}
    for k in range(14):
        doc = {f"k{k}": doc, f"s{k}": '{"'}
    frame = {"t": 1}
    for k in ("history", "market", "basic_info", "Business Info", "performance", "milestones"):
        frame = {k: frame, f"n{k[0]}": 0}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(frame)), (3, "{}")], "item_id long, raw string")
    rows = flatten.explode_fields(df).filter("item_id = 1").orderBy("pos").collect()
    assert [(r["category"], r["field"]) for r in rows] == [("History", "y"), (flatten.OTHER, "z"), *[(flatten.OTHER, f"s{k}") for k in range(14)]]
    names = {r["field"] for r in flatten.field_names(df).filter("item_id = 2").collect()}
    assert names == {"t", "nh", "nm", "nb", "nB", "np"}


def test_report(spark, tmp_path):
    items = spark.createDataFrame([(1, 1, "a", "A item", False), (2, 2, "b", "B", False), (3, 3, "c", "C", True), (4, 4, "d", "D", False)], "item_id long, no int, slug string, name string, failed boolean")
    fields = spark.createDataFrame([(1, "a", 1, "Basic Info", "price", "5"), (1, "a", 2, "History", "born", "> long\n> text"), (2, "b", 1, "Basic Info", "price", "[uncertain] 6"), (2, "b", 2, "Basic Info", "kind", "k"), (3, "c", 1, "Basic Info", "price", "9"), (4, "d", 1, "Basic Info", "kind", None)], "item_id long, slug string, pos int, category string, field string, value string")
    sidecars = spark.createDataFrame([(1, "high", ["x vs y"], ["n1", "n2"]), (2, None, [], [])], "item_id long, confidence string, conflicts array<string>, notes array<string>")
    citations = spark.createDataFrame([(1, "price", 0, 2), (1, "price", 1, 1), (1, "born", 0, 1)], "item_id long, field string, ref_ord int, idx int")
    sources = spark.createDataFrame([(1, 1, "[1] u"), (1, 2, "[2] v — w")], "item_id long, n int, line string")
    missing = spark.createDataFrame([(2, 0, "born")], "item_id long, pos int, field string")
    lines = report.report_lines(items, fields, ["price", "kind"], sidecars, citations, sources, missing)
    scan.write_lines(lines, str(tmp_path / "report"))
    parts = sorted((tmp_path / "report").glob("part-*"))
    target = tmp_path / "report.md"
    target.write_text("old")
    reports.write_report(lines, f"file://{target}")
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("report.md")] == ["report.md"]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(x) for x in ("Relation [", "LogicalRDD", "LocalRelation")) < 20
    assert target.read_text() == "".join(p.read_text() for p in parts) == """# Table of Contents

1. [A item](#a-item) - price: 5
2. [B](#b) - price: [uncertain] 6 | kind: k
3. [C](#c) - price: 9 | (research failed)
4. [D](#d) - kind: 
# Comparison

| Name   | price | kind |
| ------ | ----- | ---- |
| A item | 5     | —    |
| B      | —     | k    |
| C      | 9     | —    |
| D      | —     | —    |
# Detailed Content

## A item

### Basic Info
- **price**: 5 [2][1]
### History
**born**

> long
> text
**Sources**
[1] u
[2] v — w
## B

### Basic Info
- **kind**: k
## C

> Research failed for this item (no results).

## D

_No reportable fields (all values uncertain or empty)._

# Cross-Item Synthesis

## Summary-field comparison

- **price** — A item: 5
- **price** — C: 9
- **kind** — B: k

## Category coverage

- **Basic Info** — present in 3/4 item(s)
  - A item
  - B
  - C
- **History** — present in 1/4 item(s)
  - A item

## Contradictions (from verification)

- A item: x vs y
# Uncertainty & Confidence

## A item

**Verification confidence**: high
**Conflicts**:
- x vs y
**Verification notes**: n1; n2
## B

**Uncertain fields**:
- price
**Missing fields**:
- born
## C

_No uncertainty flags; verification metadata absent._
## D

**Uncertain fields**:
- kind
"""


def test_item_rows_shuffle_once(spark):
    """All that a report says of an item meets in one shuffle."""
    empty = lambda schema: spark.createDataFrame([], schema)
    rows = report.item_rows(
        empty("item_id long, no long, name string, failed boolean"), empty("item_id long, pos int, category string, field string, value string"), ["price"], empty("item_id long, confidence string, conflicts array<string>, notes array<string>"),
        empty("item_id long, field string, ref_ord long, idx long"), empty("item_id long, n long, line string"), empty("item_id long, pos long, field string"),
    )
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_paths_and_order(spark, tmp_path):
    for name in ("b.json", "a.json", "c.txt"):
        (tmp_path / name).write_text('{"v": 1}')
    texts = scan.read_texts(spark, [str(tmp_path / "a.json"), str(tmp_path / "gone.json"), str(tmp_path / "b.json")])
    assert [(r["file_name"], r["no"]) for r in scan.in_order(texts).orderBy("no").collect()] == [("a.json", 1), ("b.json", 2)]
    assert scan.read_texts(spark, str(tmp_path / "nowhere")).count() == 0
    outline = spark.createDataFrame([('{"topic":"t","items":[{"name":"x"}],"execution":{"batch_size":4}}',), ('{"topic":"u","items":[]}',)], "raw string")
    assert {tuple(r) for r in scan.parse_execution(outline).collect()} == {("t", 4, 1, "results"), ("u", 1, 1, "results")} and scan.parse_outline(outline).first()["name"] == "x"


def test_files_and_warnings(spark, tmp_path):
    """Files of folders and listed paths, over several tasks; absent, vanished and undecodable ones are rows of their own."""
    (tmp_path / "in" / "sub.html").mkdir(parents=True)
    for k in range(5):
        (tmp_path / "in" / f"d{k}.html").write_text(f"<h1>é{k}</h1>")
    (tmp_path / "in" / "bad.html").write_bytes(b"\xff\xfe")
    (tmp_path / "in" / "x.txt").write_text("no")
    paths = [f"file://{tmp_path}/in", f"file://{tmp_path}/gone.html", f"file://{tmp_path}/in/x.txt"]
    old = files.FILES
    files.FILES = 2
    try:
        reader = files.FileReader(paths, "*.html")
        parts = reader.partitions()
        assert len(parts) == 4 and all(len(p.entries) <= 2 for p in parts)
        (tmp_path / "in" / "d4.html").unlink()
        rows = sorted((name, raw, problem) for p in parts for _, name, _, raw, problem in reader.read(p))
    finally:
        files.FILES = old
    assert rows == [("bad.html", None, "unreadable"), *[(f"d{k}.html", f"<h1>é{k}</h1>", None) for k in range(4)], ("d4.html", None, "not found"), ("gone.html", None, "not found"), ("x.txt", "no", None)]
    texts, problems = files.scan_files(spark, paths, "*.html")
    assert {r["file_name"] for r in texts.collect()} == {"d0.html", "d1.html", "d2.html", "d3.html", "x.txt"}
    assert {(r["file_name"], r["problem"]) for r in problems.collect()} == {("bad.html", "unreadable"), ("gone.html", "not found")}
    assert files.scan_files(spark, [])[0].count() == 0


def test_numbering(spark):
    rows = [(None if k % 50 == 0 else (k * 7919) % 301, k % 3) for k in range(3000)]
    df = spark.createDataFrame(rows, "v int, __part int").repartition(7)
    got = numbering.numbered(df, "v").orderBy("no").collect()
    assert [r["no"] for r in got] == list(range(1, 3001)) and set(got[0].asDict()) == {"v", "__part", "no"}
    assert [r["v"] for r in got] == sorted((r[0] for r in rows), key=lambda v: (v is not None, v or 0))
    assert numbering.numbered(df.limit(0), "v").count() == 0


def test_round_outputs(spark):
    rows = [("base", '{"item":"i","json":{},"notes":"n","uncertain":["a"]}', []), ("gap", '{"json":[],"missing":[1],"other":2}', ["output.item must be a string", "output.json must be an object", "output.missing must be an array of strings", "output.other is not supported"]), ("verify", '{"item":"i","json":{},"verification":{"conflicts":["c"],"extra":1}}', []), ("verify", '{"item":"i","json":{},"notes":"n"}', ["output.notes is not supported", "output.verification must be an object"]), ("base", "[]", ["output must be an object"]), ("odd", "{}", ["kind is not supported"])]
    got = specs.round_errors(spark.createDataFrame([r[:2] for r in rows], "kind string, raw string")).collect()
    assert [r["errors"] for r in got] == [r[2] for r in rows]


def test_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.truncate(F.lit("ab cd"), 4)) == "ab…" and one(X.truncate(F.lit("abcd"), 4)) == "abcd"
    assert one(X.escape_html(F.lit("<&>\"'"))) == "&lt;&amp;&gt;&quot;&#39;"
    assert one(X.file_size(F.lit(1536))) == "1.5 KB" and one(X.file_size(F.lit(5))) == "5 B"
    assert one(X.pad(F.lit("abc"), F.lit(2))) == "abc" and one(X.item_name(F.lit(" "), F.lit(None).cast("string"), F.lit("a_b-c"))) == "A B C"
    assert one(X.one_decimal(F.lit(12.25))) == "12.2" and one(X.stem(F.lit("d/a.b.json"))) == "a.b"


def drained(stream_, keep, checkpoint, mode="update"):
    stream_.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def in_files(spark, df, by, where):
    """A stream of one file a batch, in the order of ``by``."""
    for k in [r[0] for r in df.select(by).distinct().orderBy(by).collect()]:
        df.filter(F.col(by) == k).coalesce(1).write.parquet(str(where / f"k={k:03d}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(where / "k=*"))


def test_first_arrivals(spark, tmp_path):
    """Keys with events on two days, files out of order: one state a key; published at once with corrections, or once when settled."""
    configured(spark)
    rows = [(i, f"2024-01-0{1 + i % 2} 23:59:{i:02d}", "tool/result" if i % 3 else "other", None if i == 7 else i % 4, i * 500, (20 - i) // 7) for i in range(20)]
    events = spark.createDataFrame(rows, "seq long, ts string, type string, call_id long, bytes long, file int").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {r["call_id"]: r["seq"] for r in stream.first_per_key(events).collect()}
    source, seen = in_files(spark, events, "file", tmp_path / "in"), []
    drained(stream.first_arrivals(source), lambda b, n: seen.extend((n, r["call_id"], r["seq"]) for r in b.collect()), tmp_path / "c1")
    assert {c: s for _, c, s in sorted(seen)} == want and len(seen) > len(want) == 4
    # Settled: the stream ends with an event that moves the watermark beyond all others.
    last = spark.createDataFrame([(99, "2024-02-01 00:00:00", "tool/result", 50, 0, 8), (100, "2024-02-02 00:00:00", "tool/result", 51, 0, 9), (1, "2024-01-01 00:00:00", "tool/result", 2, 7, 10)], "seq long, ts string, type string, call_id long, bytes long, file int")
    source, once = in_files(spark, events.unionByName(last.withColumn("ts", F.col("ts").cast("timestamp"))), "file", tmp_path / "in2"), []
    drained(stream.settled_arrivals(source, "3 days", 3 * 86_400_000), lambda b, n: once.extend((r["call_id"], r["seq"]) for r in b.collect()), tmp_path / "c2", "append")
    assert sorted(x for x in once if x[0] < 50) == sorted(want.items())  # the late event of key 2, with seq 1, comes after


def test_streams_state(spark, tmp_path):
    """First arrivals without an expiry call no Python and publish a key only with a batch that brings an earlier event; a bucket of items is one value of the state, so a batch of it costs two calls."""
    configured(spark)
    rows = [(5, "tool/result", 1, 0), (9, "tool/result", 2, 0), (7, "tool/result", 1, 1), (3, "tool/result", 2, 1), (3, "tool/result", 2, 2)]
    events = spark.createDataFrame([(s, "2024-01-01 00:00:00", t, c, None, f) for s, t, c, f in rows], "seq long, ts string, type string, call_id long, bytes long, file int")
    first, seen = stream.first_arrivals(in_files(spark, events, "file", tmp_path / "in")), []
    assert "TransformWithState" not in first._jdf.queryExecution().analyzed().toString()
    drained(first, lambda b, n: seen.extend((n, r["call_id"], r["seq"], r["bytes"]) for r in b.collect()), tmp_path / "c")
    assert sorted(seen) == [(0, 1, 5, 0), (0, 2, 9, 0), (1, 2, 3, 0)]

    class Held:
        calls, value = 0, None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    class Clock:
        now = 0

        def getCurrentProcessingTimeInMs(self):  # noqa: N802
            return self.now

    state, clock = stream.RoundState(10), Clock()
    state.held = Held()
    batch = lambda *r: list(state.handleInputRows((1,), [dict(zip(("item_id", "round_no", "seq", "path", "value", "sources"), x, strict=True)) for x in r], clock))
    many = batch(*[(i % 2, 1, i, f"p{i}", "v", [f"u{i}"]) for i in range(50)])
    assert [len(m["values"]) for m in many] == [len(m["sources"]) for m in many] == [25, 25] and state.held.calls == 2
    clock.now = 11  # an entry goes that wasn't renewed, in an item that was
    assert [(m["item_id"], [(v["path"], v["value"]) for v in m["values"]]) for m in batch((1, 1, 99, "p1", "new", None))] == [(1, [("p1", "new")])]


def test_arrivals_once(spark, tmp_path):
    """Keys twice in a batch, in two batches, null keys, a run from the start, and a batch that died after half of its parts."""
    rows = [(k, None if i % 9 == 0 else i % 30, i) for i in range(120) for k in [i // 30]]
    source = in_files(spark, spark.createDataFrame(rows, "file int, key int, v int"), "file", tmp_path / "in")
    judge = lambda b: b.select("key", (F.col("v") * 0).alias("zero"))
    out = stream.Arrivals(spark, f"file://{tmp_path}/out", "key", 5)
    schema = spark.createDataFrame([], "key int, zero int").schema
    assert out.rows(schema).count() == 0
    keys = lambda: sorted((-1 if r["key"] is None else r["key"]) for r in out.rows(schema).collect())
    every = sorted({-1 if r[1] is None else r[1] for r in rows})
    for run in ("a", "b"):
        stream.as_they_arrive(source, judge, out.path, "key", str(tmp_path / run), 5).trigger(availableNow=True).start().awaitTermination()
        assert keys() == every
    more = spark.createDataFrame([(k, 1) for k in (100, 101, 102, 103, 104, 105, 3, None, 100)], "key int, zero int")
    real, calls = stream.Arrivals._commit, []

    def dies(self, batch):
        calls.append(batch)
        raise OSError("lost")

    stream.Arrivals._commit = dies
    try:
        with pytest.raises(OSError):
            out.add(more, "late")
    finally:
        stream.Arrivals._commit = real
    half = sorted(tmp_path.glob("out/rows/part=*/batch=late"))
    assert half and keys() == every  # what isn't complete isn't seen
    for x in half[: len(half) // 2]:
        for f in x.iterdir():
            f.unlink()
    for _ in range(2):
        out.add(more, "late")
        assert keys() == sorted([*every, *range(100, 106)])


def test_arrivals_files(spark, tmp_path, monkeypatch):
    """A batch has about as many files as shuffle partitions or parts, not one for each of both; keys that are there are found by large batches and by few rows."""
    out = stream.Arrivals(spark, f"file://{tmp_path}/out", "key", 16)
    rows = lambda a, b: spark.range(a, b).select(F.when(F.col("id") != 7, F.col("id")).alias("key"), F.lit(1).alias("one"))
    monkeypatch.setattr(stream, "FEW", 100, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for batch, (a, b) in enumerate([(0, 2000), (1000, 3000), (2990, 3010), (5, 9)]):
            out.add(rows(a, b), str(batch))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(tmp_path.glob("out/rows/part=*/batch=0/*.parquet"))) == 16
    held = [(r["key"], r["batch"]) for r in out.rows(rows(0, 1).schema).collect()]
    assert sorted(held, key=str) == sorted([(None if i == 7 else i, "0" if i < 2000 else "1" if i < 3000 else "2") for i in range(3010)], key=str)


def test_round_states(spark, tmp_path):
    configured(spark)
    rows = [(1, 1, 1, "a", "[uncertain]", ["u", "v"]), (1, 2, 2, "a", "x", ["w", "u"]), (2, 1, 3, "a", "v=;", None), (2, 2, 4, "a", "w", ["z"]), (3, 2, 5, "a", "z", None), (1, 1, 0, "a", "old", ["v"]), (4, 1, 6, "b", None, None)]
    rounds = spark.createDataFrame(rows, "item_id long, round_no int, seq long, path string, value string, sources array<string>")
    before, later = rounds.filter("seq IN (0, 3)"), rounds.filter("seq NOT IN (0, 3)")
    source, seen = in_files(spark, later.withColumn("file", (7 - F.col("seq")).cast("int")), "file", tmp_path / "in").drop("file"), []
    drained(stream.round_states(source, before=before), lambda b, n: seen.extend((n, r) for r in b.collect()), tmp_path / "c")
    got = {r["item_id"]: r for _, r in sorted(seen, key=lambda x: x[0])}
    batch = {r["item_id"]: (r["failed"], r["rounds_used"], [] if r["failed"] else [(r["path"], r["value"])]) for r in merge.resolve_rounds(rounds).collect()}
    assert {i: (r["failed"], r["rounds_used"], [(v["path"], v["value"]) for v in r["values"]]) for i, r in got.items()} == batch
    assert got[1]["sources"] == ["v", "u", "w"] and got[1]["gaps"] == []
    held = stream.held_rounds(spark, str(tmp_path / "c"))
    state = lambda df: sorted(map(str, merge.resolve_rounds(df).collect()))
    assert state(held) == state(rounds)


def test_empty_framework_and_items(spark):
    fields = spark.createDataFrame([(1, "a")], "item_id long, field string")
    frame = spark.createDataFrame([], "category string, category_pos int, field string, required boolean")
    r = coverage.item_coverage(fields, frame).first()
    assert r["coverage_rate"] == 100.0 and r["valid"] and r["extra_fields"] == ["a"]
    s = coverage.run_summary(coverage.item_coverage(fields.limit(0), frame)).first()
    assert (s["total"], s["mean_coverage"], s["gate"]) == (0, 0.0, True)
