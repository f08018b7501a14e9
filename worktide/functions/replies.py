"""JSON in free text: strict, then normalised, then salvaged."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F

QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})


def normalised(reply: str) -> str:
    return re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", reply.translate(QUOTES)).strip()


def objects(text: str) -> list[str]:
    """Top-level {...} parts, quotes respected."""
    found, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            start = start if depth else i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                found.append(text[start : i + 1])
    return found


def closed(text: str) -> str | None:
    """A truncated object cut at its last complete element, brackets closed."""
    start = text.find("{")
    if start < 0:
        return None
    stack, quoted, escaped, best = [], False, False, None
    for i, c in enumerate(text[start:], start):
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            best = (i + 1, list(stack))
        elif c == "," and stack:
            best = (i, list(stack))
    return text[start : best[0]] + "".join(reversed(best[1])) if best else None


def parse_one(reply: str | None, key: str) -> tuple[str | None, str]:
    """The last object that has ``key``, as JSON text, and how it was read."""
    text = reply or ""
    for how, value in (("strict", text), ("normalised", normalised(text))):
        for part in reversed(objects(value)):
            try:
                got = json.loads(part)
            except ValueError:
                continue
            if key in got:
                return json.dumps(got, ensure_ascii=False, sort_keys=True), how
    try:
        got = json.loads(closed(normalised(text)) or "")
        if isinstance(got, dict) and key in got:
            return json.dumps(got, ensure_ascii=False, sort_keys=True), "salvaged"
    except ValueError:
        pass
    return None, "none"


def parsed(reply: Column, key: str) -> Column:
    """struct<json, how>. Repair is recursive, so it runs in Python, by batch."""

    def read(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_one(x, key) for x in batch], columns=["json", "how"])

    read.__annotations__ = {"batch": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(read, "json string, how string")(reply)
