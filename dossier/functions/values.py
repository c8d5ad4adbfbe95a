"""JSON values as Markdown text, by the kind of the value, at any depth."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.records import Number, parsed
from dossier.functions.text import MARK

#: Characters beyond which a text is a quotation, and up to which a list's values stand in one line.
LONG, SHORT = 100, 60


def _number(x: Number) -> str:
    """As readers of JSON say it: whole numbers as they are, others as the shortest text of their double."""
    return str(x) if x.lstrip("-").isdigit() else str(float(x))


def _plain(x) -> str:
    """A value that holds no others."""
    if x is None or x == {} or x == []:
        return ""
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, Number):
        return _number(x)
    return "\n".join(f"> {line}" for line in x.splitlines() or [x]) if MARK not in x and len(x) > LONG else x


@dataclass
class _Open:
    """A container whose values are being written: what stands before each, which line it is in, and the texts so far."""

    kind: str
    values: list
    depth: int
    labels: list[str]
    lines: list[int]
    texts: list[str] = field(default_factory=list)

    def text(self) -> str:
        if self.kind == "list":
            full = [t for t in self.texts if t]
            return ", ".join(full) if sum(map(len, self.texts)) <= SHORT else "\n".join(f"- {t}" for t in full)
        said = [f"{label}{text}" for label, text in zip(self.labels, self.texts, strict=True)]
        if self.kind == "object":
            return "\n".join(said)
        rows: dict[int, list[str]] = {}
        for line, part in zip(self.lines, said, strict=True):
            rows.setdefault(line, []).append(part)
        return "\n".join(" | ".join(parts) for parts in rows.values())


def _opened(x, depth: int) -> _Open:
    if isinstance(x, dict):
        shown = [(k, v) for k, v in x.items() if v is not None and not (isinstance(v, str) and not isinstance(v, Number) and not v.strip())]
        return _Open("object", [v for _, v in shown], depth + 1, ["  " * depth + f"{k}: " for k, _ in shown], [])
    if all(isinstance(e, dict) for e in x):
        cells = [(i, k, v) for i, e in enumerate(x) for k, v in e.items() if v is not None and not (isinstance(v, str) and v == "")]
        return _Open("rows", [v for *_, v in cells], 0, [f"{k}: " for _, k, _ in cells], [i for i, *_ in cells])
    return _Open("list", x, depth, [], [])


def markdown(value) -> str:
    """Null is empty, a boolean lower case, a long text a quotation, an object lines of ``key: value`` (inner ones indented), a list of objects a line each, a
    short list joined by commas, another list bullets. Keys come in the order of the record. Containers are kept on a stack of their own, so depth costs no calls."""
    stack: list[_Open] = []
    done: str | None = None
    todo, depth = value, 0
    while True:
        if done is None:
            if isinstance(todo, (dict, list)) and todo:
                stack.append(_opened(todo, depth))
            else:
                done = _plain(todo)
        if done is not None:
            if not stack:
                return done
            stack[-1].texts.append(done)
        top = stack[-1]
        if len(top.texts) == len(top.values):
            done = stack.pop().text()
        else:
            done, todo, depth = None, top.values[len(top.texts)], top.depth


def as_markdown(raw: Column) -> Column:
    """JSON texts as Markdown (:func:`markdown`); a null is empty, a text that isn't JSON stays as it is."""

    @F.pandas_udf("string")
    def formatted(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str:
            if text is None:
                return ""
            try:
                return markdown(parsed(text))
            except ValueError:
                return text

        return texts.map(one)

    return formatted(raw)
