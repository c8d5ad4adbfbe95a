"""JSON texts as values and back, at any depth, in the order of their keys.

Python's own reader stops where nesting exceeds the interpreter's stack; a text that does is read token by token with a stack of its own. A number keeps its text.
"""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


class Number(str):
    """A number as it is written."""

    __slots__ = ()


def _never(word: str):
    raise ValueError(word)


_READER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_never)


def parsed(text: str | None):
    """The value of a JSON text; of repeated keys the last value, at the first one's place. ``ValueError`` where it isn't one."""
    if text is None:
        raise ValueError("null")
    try:
        return _READER.decode(text)
    except RecursionError:
        return _deep(text)


def _deep(text: str):
    root: list = []
    stack: list[tuple] = [(root, None)]  # containers, each with the key that waits for a value
    at, expect = 0, "value"
    end = len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark, quoted, number, word = m.groups()
        holder, key = stack[-1]
        if mark == ":":
            if expect != "colon":
                raise ValueError(f"a colon at {at}")
            expect = "value"
            continue
        if mark == ",":
            if expect != "more" or len(stack) == 1:
                raise ValueError(f"a comma at {at}")
            expect = "key" if isinstance(holder, dict) else "value"
            continue
        if mark in ("}", "]"):
            if isinstance(holder, dict) != (mark == "}") or len(stack) == 1 or not (expect == "more" or (not holder and expect in ("key", "value") and key is None)):
                raise ValueError(f"an end at {at}")
            stack.pop()
            expect = "more"
            continue
        if expect == "key":
            if quoted is None:
                raise ValueError(f"no key at {at}")
            stack[-1], expect = (holder, json.loads(quoted)), "colon"
            continue
        if expect != "value" or (len(stack) == 1 and root):
            raise ValueError(f"a value at {at}")
        value = {} if mark == "{" else [] if mark == "[" else json.loads(quoted) if quoted is not None else Number(number) if number is not None else _WORDS[word]
        if isinstance(holder, dict):
            holder[key] = value
            stack[-1] = (holder, None)
        else:
            holder.append(value)
        expect = "more"
        if mark is not None:
            stack.append((value, None))
            expect = "key" if mark == "{" else "value"
    if len(stack) != 1 or not root:
        raise ValueError("it ends too early")
    return root[0]


def _scalar(value) -> str:
    return str(value) if isinstance(value, Number) else json.dumps(value, ensure_ascii=False)


def compact(value) -> str:
    """A value's JSON text without blanks, numbers as they were."""
    out: list[str] = []
    todo: list = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, _Text):
            out.append(x.text)
        elif isinstance(x, dict):
            parts = [p for i, (k, v) in enumerate(x.items()) for p in (_Text(f"{',' if i else ''}{json.dumps(k, ensure_ascii=False)}:"), v)]
            todo += reversed([_Text("{"), *parts, _Text("}")])
        elif isinstance(x, list):
            parts = [p for i, v in enumerate(x) for p in ((_Text(","), v) if i else (v,))]
            todo += reversed([_Text("["), *parts, _Text("]")])
        else:
            out.append(_scalar(x))
    return "".join(out)


class _Text:
    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text
