"""Long texts cut near sentence or word ends, without loss."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_END = re.compile(r"[。！？.!?；;]\s*|\s+")


def cut(text: str, limit: int) -> list[str]:
    """Pieces of at most limit - 256 characters (500 at least): each ends at the last boundary in its second
    half, or is cut hard."""
    size, at, out = max(500, limit - 256), 0, []
    while len(text) - at > size:
        ends = [m.end() for m in _END.finditer(text[at : at + size + 1]) if m.end() >= size // 2]
        step = ends[-1] if ends else size
        out.append(text[at : at + step])
        at += step
    return [*out, text[at:]] if at < len(text) else out


def pieces(text: Column, limit: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: cut(x or "", limit))

    return run(text)
