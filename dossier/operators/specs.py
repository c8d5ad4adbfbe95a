"""Page specs: contract checks with exact error paths, and pages rendered from the valid ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import TONES, escape_html, tone, zero_pad
from dossier.session import spread

# The contract's keys, kinds and texts.
TOP = ("title", "subtitle", "summary", "sections")
SECTION = ("title", "subtitle", "summary", "tone", "cards", "table", "risks", "files", "steps", "flow", "callouts", "evidence")
SEVERITIES = ("low", "medium", "high", "critical")
FILES = ("added", "modified", "deleted", "reviewed", "planned")
STEPS = ("done", "current", "next", "blocked")
ENUMS = {"tone": (TONES, "must be neutral, accent, positive, warning, danger, or info"), "severity": (SEVERITIES, "must be low, medium, high, or critical"), "file": (FILES, "must be added, modified, deleted, reviewed, or planned"), "step": (STEPS, "must be done, current, next, or blocked")}
#: block: keys, required strings, optional strings, other checks by key.
BLOCKS = {
    "cards": (("title", "body", "meta", "tone"), ("title",), ("body",), {"meta": "strings", "tone": "tone"}),
    "risks": (("title", "body", "severity"), ("title", "body", "severity"), (), {"severity": "severity"}),
    "files": (("path", "detail", "status"), ("path",), ("detail",), {"status": "file"}),
    "steps": (("title", "body", "status"), ("title",), ("body",), {"status": "step"}),
    "callouts": (("title", "body", "tone"), ("body",), ("title",), {"tone": "tone"}),
    "evidence": (("label", "value", "source"), ("label", "value"), ("source",), {}),
}
NODES, EDGES = (("id", "label", "detail", "tone"), ("id", "label"), ("detail",), {"tone": "tone"}), (("from", "to", "label"), ("from", "to"), ("label",), {})
_ERRORS = "array<string>"


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _is(v: Column, kind: str) -> Column:
    return _type(v).startswith(kind)


def _when(bad: Column, *parts) -> Column:
    said = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.when(bad, F.array(said)).otherwise(F.array().cast(_ERRORS))


def _keys(v: Column, allowed: tuple[str, ...], path: Column) -> Column:
    extra = F.array_except(F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast(_ERRORS)), F.array(*[F.lit(k) for k in allowed]))
    return F.transform(extra, lambda k: F.concat(path, F.lit("."), k, F.lit(" is not supported")))


def _string(v: Column, path: Column, key: str, required: bool) -> Column:
    x = _get(v, key)
    if required:
        return _when(~_is(x, "STRING") | (F.coalesce(F.length(F.regexp_replace(_text(x), r"(?U)\s", "")), F.lit(0)) == 0), path, f".{key} must be a non-empty string")
    return _when(~_is(x, "STRING") & ~_is(x, "ABSENT"), path, f".{key} must be a string")


def _strings(x: Column, path: Column, least: int = 0) -> Column:
    """The error of an array that isn't one of strings."""
    items = F.try_variant_get(x, "$", "array<variant>")
    good = _is(x, "ARRAY") & (F.size(items) >= least) & F.forall(items, lambda i: _is(i, "STRING"))
    return _when(~F.coalesce(good, F.lit(False)), path, f" must be an array of strings{' with at least 1 item' if least else ''}")


def _enum(x: Column, path: Column, kind: str, optional: bool = True) -> Column:
    allowed, said = ENUMS[kind]
    bad = ~F.coalesce(_is(x, "STRING") & _text(x).isin(*allowed), F.lit(False))
    return _when(bad & ~_is(x, "ABSENT") if optional else bad, path, f" {said}")


def _object(v: Column, path: Column, rule: tuple) -> Column:
    keys, required, optional, other = rule
    parts = [_keys(v, keys, path), *[_string(v, path, k, True) for k in required], *[_string(v, path, k, False) for k in optional]]
    for k, kind in other.items():
        at = F.concat(path, F.lit(f".{k}"))
        parts.append(F.when(_is(_get(v, k), "ABSENT"), F.array().cast(_ERRORS)).otherwise(_strings(_get(v, k), at)) if kind == "strings" else _enum(_get(v, k), at, kind, kind != "severity"))
    return F.concat(*parts)


def _at(path: Column, i: Column) -> Column:
    return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))


def _each(x: Column, path: Column, rule: tuple, least: int = 1) -> Column:
    """Errors of an array of objects, in order."""
    items = F.try_variant_get(x, "$", "array<variant>")
    one = lambda v, i: F.when(~_is(v, "OBJECT"), F.array(F.concat(_at(path, i), F.lit(" must be an object")))).otherwise(_object(v, _at(path, i), rule))
    wrong = ~_is(x, "ARRAY") | (F.coalesce(F.size(items), F.lit(0)) < least)
    return F.when(wrong, F.array(F.concat(path, F.lit(" must be a non-empty array" if least else " must be an array")))).otherwise(F.flatten(F.transform(items, one)))


def parsed(specs: DataFrame) -> DataFrame:
    """``spec_id, doc`` of specs (``spec_id, raw``), each parsed once; text that is no JSON is null."""
    return spread(specs.select("spec_id", "raw")).select("spec_id", F.try_parse_json("raw").alias("doc"))


def sections(docs: DataFrame) -> DataFrame:
    """``spec_id, section_no, section`` of parsed specs whose sections are an array."""
    return docs.select("spec_id", F.posexplode(F.try_variant_get("doc", "$.sections", "array<variant>")).alias("section_no", "section"))


def _section_rules(section: Column, path: Column) -> dict[str, Column]:
    rules = {"keys": F.concat(_keys(section, SECTION, path), _string(section, path, "title", True), _string(section, path, "subtitle", False), _string(section, path, "summary", False), _enum(_get(section, "tone"), F.concat(path, F.lit(".tone")), "tone"))}
    for name, rule in BLOCKS.items():
        x = _get(section, name)
        rules[name] = F.when(_is(x, "ABSENT"), F.array().cast(_ERRORS)).otherwise(_each(x, F.concat(path, F.lit(f".{name}")), rule))
    table, at = _get(section, "table"), F.concat(path, F.lit(".table"))
    rows, columns = F.try_variant_get(table, "$.rows", "array<variant>"), F.try_variant_get(table, "$.columns", "array<variant>")
    row_at = lambda i: _at(F.concat(at, F.lit(".rows")), i)
    width = lambda r, i: _when(F.coalesce(_is(_get(table, "columns"), "ARRAY") & _is(r, "ARRAY") & (F.size(F.try_variant_get(r, "$", "array<variant>")) != F.size(columns)), F.lit(False)), row_at(i), " must match the column count")
    each_row = F.when(~_is(_get(table, "rows"), "ARRAY"), F.array(F.concat(at, F.lit(".rows must be an array")))).otherwise(F.flatten(F.transform(rows, lambda r, i: F.concat(_strings(r, row_at(i)), width(r, i)))))
    inside = F.concat(_keys(table, ("caption", "columns", "rows"), at), _string(table, at, "caption", False), _strings(_get(table, "columns"), F.concat(at, F.lit(".columns")), 1), each_row)
    rules["table"] = F.when(_is(table, "ABSENT"), F.array().cast(_ERRORS)).when(~_is(table, "OBJECT"), F.array(F.concat(at, F.lit(" must be an object")))).otherwise(inside)
    flow, at2 = _get(section, "flow"), F.concat(path, F.lit(".flow"))
    edges, ids = F.try_variant_get(flow, "$.edges", "array<variant>"), F.transform(F.coalesce(F.try_variant_get(flow, "$.nodes", "array<variant>"), F.array().cast("array<variant>")), lambda n: _text(_get(n, "id")))
    edge_at = lambda i: _at(F.concat(at2, F.lit(".edges")), i)
    end = lambda e, i, k: _when(F.coalesce(_is(_get(e, k), "STRING") & ~F.array_contains(F.array_compact(ids), _text(_get(e, k))), F.lit(False)), edge_at(i), f".{k} must reference a flow node")
    each_edge = F.transform(edges, lambda e, i: F.when(~_is(e, "OBJECT"), F.array(F.concat(edge_at(i), F.lit(" must be an object")))).otherwise(F.concat(_object(e, edge_at(i), EDGES), end(e, i, "from"), end(e, i, "to"))))
    inside = F.concat(_keys(flow, ("nodes", "edges"), at2), _each(_get(flow, "nodes"), F.concat(at2, F.lit(".nodes")), NODES), F.when(~_is(_get(flow, "edges"), "ARRAY"), F.array(F.concat(at2, F.lit(".edges must be an array")))).otherwise(F.flatten(each_edge)))
    rules["flow"] = F.when(_is(flow, "ABSENT"), F.array().cast(_ERRORS)).when(~_is(flow, "OBJECT"), F.array(F.concat(at2, F.lit(" must be an object")))).otherwise(inside)
    return rules


def validate(specs: DataFrame) -> DataFrame:
    """``spec_id, errors`` (sorted; empty where the spec is valid) of ``spec_id, raw``: one pass, each spec with its sections in its own row."""
    return judged(parsed(specs)).select("spec_id", "errors")


def judged(docs: DataFrame) -> DataFrame:
    """Parsed specs with ``errors``."""
    doc, root = F.col("doc"), F.lit("spec")
    listed = F.try_variant_get(doc, "$.sections", "array<variant>")
    is_list = _is(_get(doc, "sections"), "ARRAY") & (F.size(listed) > 0)
    top = F.concat(_keys(doc, TOP, root), _string(doc, root, "title", True), _string(doc, root, "subtitle", False), _string(doc, root, "summary", False), _when(~F.coalesce(is_list, F.lit(False)), "spec.sections must be a non-empty array"))

    def section(v: Column, i: Column) -> Column:
        path = _at(F.lit("spec.sections"), i)
        return F.when(~_is(v, "OBJECT"), F.array(F.concat(path, F.lit(" must be an object")))).otherwise(F.concat(*_section_rules(v, path).values()))

    inside = F.flatten(F.transform(F.coalesce(listed, F.array().cast("array<variant>")), section))
    errors = F.when(~_is(doc, "OBJECT"), F.array(F.lit("spec must be an object"))).otherwise(F.concat(top, inside))
    return docs.withColumn("errors", F.array_sort(errors))


#: The contract of a round's output: keys, required ones by kind, arrays of texts, optional texts; and of a verification.
ROUND_KEYS = {
    "base": ("item", "json", "uncertain", "missing", "sources", "notes", "confidence"),
    "gap": ("item", "json", "uncertain", "missing", "sources", "notes", "confidence"),
    "verify": ("item", "json", "verification"),
}
VERIFICATION = {"confidence": "text", "conflicts": "texts", "notes": "text"}


def round_errors(outputs: DataFrame) -> DataFrame:
    """``outputs`` (``kind, raw`` and more; kinds of :data:`ROUND_KEYS`) with ``errors``, sorted: required keys, no others, texts, objects and arrays of texts."""
    doc, root = F.try_parse_json("raw"), F.lit("output")
    absent = lambda x: _is(x, "ABSENT")
    none = F.array().cast(_ERRORS)
    text = lambda v, path, k: _string(v, path, k, False)
    texts = lambda v, path, k: F.when(absent(_get(v, k)), none).otherwise(_strings(_get(v, k), F.concat(path, F.lit(f".{k}"))))
    whole = lambda k: _when(~_is(_get(doc, k), "OBJECT"), f"output.{k} must be an object")

    def of(kind: str) -> Column:
        keys = ROUND_KEYS[kind]
        parts = [_keys(doc, keys, root), _when(~_is(_get(doc, "item"), "STRING"), "output.item must be a string"), whole("json")]
        if "verification" in keys:
            v, at = _get(doc, "verification"), F.lit("output.verification")
            inside = F.concat(*[(text if t == "text" else texts)(v, at, k) for k, t in VERIFICATION.items()])
            parts += [whole("verification"), F.when(_is(v, "OBJECT"), inside).otherwise(none)]
        else:
            parts += [texts(doc, root, k) for k in ("uncertain", "missing", "sources")] + [text(doc, root, k) for k in ("notes", "confidence")]
        return F.concat(*parts)

    rule = F.when(~_is(doc, "OBJECT"), F.array(F.lit("output must be an object")))
    for kind in ROUND_KEYS:
        rule = rule.when(F.col("kind") == kind, of(kind))
    return outputs.withColumn("errors", F.array_sort(rule.otherwise(F.array(F.lit("kind is not supported")))))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``from_id, to_id, side`` of edges whose end is no node."""
    ids = nodes.select("id").distinct()
    one = lambda side: edges.join(ids, edges[f"{side}_id"] == ids["id"], "left_anti").withColumn("side", F.lit(side))
    return one("from").unionByName(one("to"))


def chart(rows: DataFrame, by: str, label: str, value: str) -> DataFrame:
    """Aligned labels and values of each chart."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col(value).alias("v"))))
    return rows.groupBy(by).agg(pairs.alias("p")).select(by, F.transform("p", lambda x: x["l"]).alias("labels"), F.transform("p", lambda x: x["v"]).alias("data"))


_CARD = "array<struct<title:string,body:string,meta:array<string>,tone:string>>"
_SCHEMA = f"""struct<title:string,subtitle:string,summary:string,tone:string,cards:{_CARD},table:struct<caption:string,columns:array<string>,rows:array<array<string>>>,
risks:array<struct<title:string,body:string,severity:string>>,files:array<struct<path:string,detail:string,status:string>>,steps:array<struct<title:string,body:string,status:string>>,
flow:struct<nodes:array<struct<id:string,label:string,detail:string,tone:string>>,edges:array<struct<`from`:string,`to`:string,label:string>>>,
callouts:array<struct<title:string,body:string,tone:string>>,evidence:array<struct<label:string,value:string,source:string>>>"""


def _tag(name: str, attrs: str, *inside) -> Column:
    return F.concat(F.lit(f"<{name}{' ' if attrs else ''}{attrs}>"), *inside, F.lit(f"</{name}>"))


def _opt(c: Column, name: str, attrs: str = "") -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", _tag(name, attrs, escape_html(c))).otherwise("")


def _toned(name: str, kind: str, t: Column, *inside) -> Column:
    return F.concat(F.lit(f'<{name} class="{kind}" data-tone="'), tone(t), F.lit('">'), *inside, F.lit(f"</{name}>"))


def _list(items: Column, kind: str, one) -> Column:
    return F.when(items.isNull(), "").otherwise(_tag("div", f'class="{kind}"', F.array_join(F.transform(items, one), "")))


def render(specs: DataFrame, css: str = "") -> DataFrame:
    """``spec_id, title, html`` of specs (``spec_id, raw``) that are valid, parsed once for checks and page."""
    valid = F.when(F.size("errors") == 0, F.col("doc"))  # no filter: pushed below the parsing, it would parse the text anew at each place that names the document
    return rendered(judged(parsed(specs)).select("spec_id", valid.alias("doc")), css)


def rendered(docs: DataFrame, css: str = "") -> DataFrame:
    """``spec_id, title, html`` of parsed valid specs (null ones have no page). A section becomes HTML in its own row; a page gathers its own sections alone."""
    e = escape_html
    rows = docs.select("spec_id", F.named_struct(*[x for k in ("title", "subtitle", "summary") for x in (F.lit(k), _text(_get(F.col("doc"), k)))]).alias("d"), F.posexplode_outer(F.try_variant_get("doc", "$.sections", "array<variant>")).alias("section_no", "section"))
    rows = rows.filter("section_no IS NOT NULL").select("spec_id", "d", "section_no", F.from_json(F.to_json("section"), _SCHEMA).alias("s"))
    s = F.col("s")
    meta = lambda c: F.when(F.size(c["meta"]) > 0, _tag("div", 'class="meta"', F.array_join(F.transform(c["meta"], lambda m: _tag("span", 'class="chip"', e(m))), ""))).otherwise("")
    cards = _list(s["cards"], "grid", lambda c: _toned("article", "card", c["tone"], _tag("h3", "", e(c["title"])), _opt(c["body"], "p"), F.coalesce(meta(c), F.lit(""))))
    t = s["table"]
    head = F.array_join(F.transform(t["columns"], lambda c: _tag("th", 'scope="col"', e(c))), "")
    body = F.array_join(F.transform(t["rows"], lambda r: _tag("tr", "", F.array_join(F.transform(r, lambda c: _tag("td", "", e(c))), ""))), "")
    table = F.when(t.isNull(), "").otherwise(_tag("div", 'class="table-wrap"', _tag("table", "", _opt(t["caption"], "caption"), _tag("thead", "", _tag("tr", "", head)), _tag("tbody", "", body))))
    risks = _list(s["risks"], "risks", lambda r: F.concat(F.lit('<article class="risk" data-severity="'), r["severity"], F.lit('">'), _tag("span", 'class="severity"', r["severity"]), _tag("div", "", _tag("h3", "", e(r["title"])), _tag("p", "", e(r["body"]))), F.lit("</article>")))
    files = _list(s["files"], "files", lambda f: _tag("div", 'class="file"', _tag("span", 'class="status"', e(F.coalesce(f["status"], F.lit("file")))), _tag("div", "", _tag("code", "", e(f["path"])), _opt(f["detail"], "p"))))
    steps = _list(s["steps"], "steps", lambda x, i: _tag("div", 'class="step"', _tag("span", 'class="index"', (i + 1).cast("string")), _tag("div", "", _tag("h3", "", e(x["title"])), _opt(x["body"], "p"), _opt(x["status"], "span", 'class="status"'))))
    f = s["flow"]
    nodes = _tag("div", 'class="grid"', F.array_join(F.transform(f["nodes"], lambda n: _toned("article", "flow-node", n["tone"], _tag("h3", "", e(n["label"])), _opt(n["detail"], "p"))), ""))
    arrow = lambda x: _tag("span", 'class="flow-edge"', e(x["from"]), F.lit(" → "), e(x["to"]), F.when(F.coalesce(x["label"], F.lit("")) != "", F.concat(F.lit(" · "), e(x["label"]))).otherwise(""))
    flow = F.when(f.isNull(), "").otherwise(_tag("div", 'class="flow"', nodes, F.when(F.size(f["edges"]) > 0, _tag("div", 'class="flow-edges"', F.array_join(F.transform(f["edges"], arrow), ""))).otherwise("")))
    callouts = _list(s["callouts"], "callouts", lambda c: _toned("aside", "callout", c["tone"], _opt(c["title"], "h3"), _tag("p", "", e(c["body"]))))
    evidence = _list(s["evidence"], "evidence", lambda v: _tag("article", 'class="evidence-item"', _tag("h3", "", e(v["label"])), _tag("div", 'class="evidence-value"', e(v["value"])), _opt(v["source"], "div", 'class="evidence-source"')))
    title = _tag("div", 'class="section-head"', _tag("div", "", _tag("h2", "", e(s["title"])), _opt(s["subtitle"], "p", 'class="section-subtitle"')), _tag("span", 'class="section-kicker"', zero_pad(F.col("section_no") + 1, 2)))
    html = _toned("section", "section", s["tone"], title, _opt(s["summary"], "p", 'class="section-summary"'), cards, table, risks, files, steps, flow, callouts, evidence)
    gathered = rows.select("spec_id", "d", F.struct("section_no", html.alias("html")).alias("x")).groupBy("spec_id").agg(F.first("d").alias("d"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["html"]), "").alias("sections"))
    page = F.concat(
        F.lit('<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>'), e(F.col("d.title")), F.lit(f"</title>\n<style>\n{css}\n</style>\n</head>\n<body>\n<main>\n<header>"), _tag("h1", "", e(F.col("d.title"))),
        _opt(F.col("d.subtitle"), "p", 'class="subtitle"'), _opt(F.col("d.summary"), "p", 'class="summary"'), F.lit('</header>\n<div class="sections">'), F.col("sections"), F.lit("</div>\n</main>\n</body>\n</html>\n"),
    )
    return gathered.select("spec_id", F.col("d.title").alias("title"), page.alias("html"))
