"""Snippets: a window around the earliest match, with the matches marked."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from leafline.functions.text import clean

BEFORE, AFTER = 18, 90


def _needles(variants: list[str]) -> list[str]:
    return [n for n in (clean(v).casefold() for v in variants) if n]


def match_spans(text: str, variants: list[str]) -> list[tuple[int, int]]:
    """Spans of the matches, the earliest and then the longest first, none over another. Places are those of the folded text."""
    folded, spans = text.casefold(), []
    for needle in _needles(variants):
        at = folded.find(needle)
        while at >= 0:
            spans.append((at, -(at + len(needle))))
            at = folded.find(needle, at + len(needle))
    chosen: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if not chosen or begin >= chosen[-1][1]:
            chosen.append((begin, -end))
    return chosen


def marked(text: str, variants: list[str]) -> str:
    out, done = "", 0
    for begin, end in match_spans(text, variants):
        out += f"{text[done:begin]}<mark>{text[begin:end]}</mark>"
        done = end
    return out + text[done:]


def snippet(text: str | None, variants: list[str], before: int = BEFORE, after: int = AFTER) -> str:
    if not text:
        return ""
    folded = text.casefold()
    hits = [(folded.find(n), -len(n)) for n in _needles(variants) if n in folded]
    if not hits:
        return text if len(text) <= before + after else text[: before + after] + "…"
    at, size = min(hits)
    begin, end = max(0, at - before), min(len(text), at - size + after)
    return ("…" if begin else "") + marked(text[begin:end], variants) + ("…" if end < len(text) else "")


def snippet_column(text: Column, variants: list[str]) -> Column:
    """Snippets of a page of hits: to be applied after the limit."""

    @pandas_udf(StringType())
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: snippet(t, variants))

    return made(text)


def fuzzy_snippet(text: str | None) -> str:
    flat = " ".join((text or "").split())
    return flat if len(flat) <= 160 else flat[:160].rstrip() + "..."
