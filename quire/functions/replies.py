"""Rows read from what a text service replies: JSON, JSON Lines, fenced, concatenated or slightly broken."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"\A```(?:jsonl?)?\s*(.*?)\s*```\Z", re.S)
_ID, _HTML = re.compile(r'"id"\s*:\s*"((?:[^"\\]|\\.)*)"'), re.compile(r'"translated_html"\s*:\s*"')
#: Escapes undone in recovered strings.
_ESCAPES = (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\/", "/"))


def _plain(s: str) -> str:
    for a, b in _ESCAPES:
        s = s.replace(a, b)
    return s


def _row(x: object) -> bool:
    return isinstance(x, dict) and "id" in x and "translated_html" in x


def _concatenated(text: str) -> list[dict] | None:
    """The objects of JSON values one after another, noise between them skipped; None if one is broken."""
    decoder, rows, at = json.JSONDecoder(), [], 0
    while m := re.compile(r"[{\[]").search(text, at):
        try:
            value, at = decoder.raw_decode(text, m.start())
        except json.JSONDecodeError:
            if _ID.match(text, m.start() + 1) or text[m.start() : m.start() + 40].lstrip("{ ").startswith('"id"'):
                return None  # a row that is broken
            at = m.start() + 1  # a bracket of the noise
            continue
        if isinstance(value, dict) and isinstance(value.get("rows"), list):
            value = value["rows"]
        rows += [x for x in (value if isinstance(value, list) else [value]) if _row(x)]
    return rows


def _recovered(text: str) -> list[dict]:
    """Objects with unescaped quotes in their html: it ends where the object does."""
    rows = []
    start = text.find("{")
    for chunk in re.split(r"(?<=\})\s*(?=\{)", text[start:].strip()) if start >= 0 else []:
        chunk = chunk if chunk.endswith("}") else chunk + "}"
        try:
            rows.append(json.loads(chunk))
            continue
        except json.JSONDecodeError:
            pass
        i, h = _ID.search(chunk), _HTML.search(chunk)
        if not i or not h:
            return []
        body = chunk[h.end() :].rstrip()[:-1].rstrip().removesuffix('"')
        rows.append({"id": _plain(i[1]), "translated_html": _plain(body)})
    return rows


def parse(reply: str) -> list[dict]:
    text = reply.strip()
    if m := _FENCE.match(text):
        text = m[1].strip()
    if not text:
        return []
    try:
        value = json.loads(text)
        if isinstance(value, dict) and isinstance(value.get("rows"), list):
            value = value["rows"]
        if isinstance(value, list):
            return [x for x in value if _row(x)]
    except json.JSONDecodeError:
        pass
    rows = _concatenated(text) or _recovered(text)
    if not rows:
        raise ValueError(f"no rows in the reply: {' '.join(text.split())[:240]}")
    return rows


def parsed(reply: Column) -> Column:
    """struct<rows, error>: array of struct<id, translated_html>, and why there is none."""

    @F.pandas_udf("rows array<struct<id:string,translated_html:string>>, error string")
    def read(replies: pd.Series) -> pd.DataFrame:
        out = []
        for r in replies:
            try:
                out.append(([{"id": str(x.get("id", "")), "translated_html": x.get("translated_html")} for x in parse(r or "")], None))
            except ValueError as e:
                out.append(([], str(e)))
        return pd.DataFrame(out, columns=["rows", "error"])

    return read(reply)
