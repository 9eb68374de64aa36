"""Problem 1: one canonical form for text that looks the same.

The canonical form is NFC with compatibility widths and joined letters taken apart, invisible
characters dropped, every kind of space or hyphen written as the plain one (their number is
kept) and look-alike letters of other alphabets written in one alphabet. Raised digits, fractions,
circled numbers, case and accents stay different.

Quick check: a character is unstable if it is changed by the form, or may combine with its neighbour (NFC_QC of
"maybe", or any combining mark). Rows without such a character pass on the JVM unchanged; in the
others only the unstable segments, each with the starter before it, are rewritten and spliced back.

Cases: null text stays null and has no pair; empty text is its own form; rows delivered twice count once;
only the columns `id` and `text` are read, so others may have any name.
"""

from __future__ import annotations

import functools
import re
import unicodedata as ud
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Decomposition tags that change what a reader sees.
_VISIBLE = {"super", "sub", "fraction", "circle", "square", "vertical", "font"}
_HYPHENS = "\u2010\u2011\u2012\u2043\ufe63\uff0d"
# Letters of other alphabets that look like a Latin letter, in two rows of equal length.
_OTHERS = "аеорсухіѕјһԁԛԝАВЕКМНОРСТХІЅЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"
_LATINS = "aeopcyxisjhdqwABEKMHOPCTXISJABEZHIKMNOPTYXov"
_CYRILLIC_BACK = {ord(b): a for a, b in zip(_OTHERS[:28], _LATINS[:28])}
SALTS = 8


@functools.lru_cache(1)
def _tables() -> tuple[dict[int, str], dict[int, str], str]:
    """Map applied first, look-alike letters, and the ranges of unstable characters (a regex class)."""
    compat: dict[int, str] = {}
    for cp in [*range(0x110000)]:
        ch = chr(cp)
        parts = ud.decomposition(ch)
        cat = ud.category(ch)
        if cat == "Zs" or ch == "\t":
            compat[cp] = " "
        elif cat == "Cf" or 0xFE00 <= cp <= 0xFE0F or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            compat[cp] = ""
        elif ch in _HYPHENS:
            compat[cp] = "-"
        elif parts.startswith("<") and parts[1 : parts.index(">")] not in _VISIBLE:
            whole = ud.normalize("NFKC", ch)
            if " " not in whole:
                compat[cp] = whole
    compat.pop(0x20, None)
    alike = {ord(a): b for a, b in zip(_OTHERS, _LATINS)}
    unstable = {*compat, *alike, 0x200D}
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if ud.category(ch)[0] == "M" or (not 0xD800 <= cp < 0xE000 and not ud.is_normalized("NFC", ch)):
            unstable.add(cp)
        elif (d := ud.decomposition(ch)) and not d.startswith("<") and int(d.split()[0], 16) in alike:
            unstable.add(cp)
    unstable |= set(range(0x1160, 0x1200))  # conjoining vowels and finals
    runs: list[list[int]] = []
    for cp in sorted(unstable):
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return compat, alike, "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in runs)


def _segment(text: str) -> str:
    compat, alike, _ = _tables()
    return ud.normalize("NFC", ud.normalize("NFD", text.translate(compat)).translate(alike))


@functools.lru_cache(1)
def _unstable_segment() -> re.Pattern[str]:
    """A starter and the unstable characters after it, or unstable characters alone."""
    klass = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", _tables()[2])
    return re.compile(f"[^{klass}]?[{klass}]+")


@functools.lru_cache(1)
def _surely_stable() -> str:
    """A short regex class of frequent stable characters, for the JVM's own check of a row."""
    unstable = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", _tables()[2]) + "]")
    stable = [cp for a, b in ((0x20, 0x7E), (0xA1, 0x17F), (0x2013, 0x2026), (0x3001, 0x3003), (0x4E00, 0x9FFF)) for cp in range(a, b + 1) if not unstable.match(chr(cp))]
    runs: list[list[int]] = []
    for cp in stable:
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


def _may_change(text: Column) -> Column:
    # Most rows are ASCII, which a comparison of lengths tells.
    return ((F.octet_length(text) != F.length(text)) & text.rlike(f"[^{_surely_stable()}]")) | text.contains("\t")


_WORD = re.compile(r"[^\W\d_]+")


def canonical(text: str | None) -> str | None:
    """The canonical form of one text."""
    if text is None or text.isascii() and "\t" not in text:
        return text
    seen: dict[str, str] = {}

    def splice(m: re.Match[str]) -> str:
        got = seen.get(m[0])
        if got is None:
            got = seen[m[0]] = _segment(m[0])
        return got

    out = _unstable_segment().sub(splice, text)
    # Segments meet after invisible characters are dropped between a starter and its marks.
    if not ud.is_normalized("NFC", out):
        out = ud.normalize("NFC", out)
    return _WORD.sub(_one_alphabet, out) if any("\u0400" <= c < "\u0530" for c in out) else out


def _one_alphabet(m: re.Match[str]) -> str:
    """A word with a letter that only Cyrillic has, and none that only Latin has, is all Cyrillic.

    This depends on the canonical letters alone and can be undone, so equality is kept.
    """
    word = m[0]
    if not any("\u0400" <= c < "\u0530" for c in word):
        return word
    base = ud.normalize("NFD", word)
    if any(c.isalpha() and not "\u0400" <= c < "\u0530" and ord(c) not in _CYRILLIC_BACK for c in base):
        return word
    return ud.normalize("NFC", base.translate(_CYRILLIC_BACK))


@pandas_udf(StringType())
def _canonical_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(canonical, na_action="ignore")


def canonical_column(text: Column) -> Column:
    """Canonical form; only rows with a character that may be unstable reach Python."""
    needs = _may_change(text)
    return F.when(needs, _canonical_udf(F.when(needs, text))).otherwise(text)


def canonical_lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text): every chunk row once, in canonical form."""
    rows = chunks.select(F.col("id").alias("chunk_id"), "text").dropDuplicates(["chunk_id"])
    return rows.select("chunk_id", canonical_column(F.col("text")).alias("text"))


def lookalike_pairs(chunks: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b), smaller first: rows whose texts differ as strings but look the same.

    Of two different texts with one form, at most one is the form itself; so every pair has a row
    that was changed. The changed rows, few, are repeated once a salt and joined with all rows by the
    form's hash and salt: a form shared by a third of all rows is spread over SALTS tasks (AQE splits further).
    """
    form = canonical_column(F.col("text"))
    rows = chunks.select("id", "text").where(F.col("text").isNotNull() & F.col("id").isNotNull())
    keyed = rows.select("id", F.xxhash64("text").alias("th"), form.alias("form"), "text").select(
        "id", "th", F.xxhash64("form").alias("k1"), F.xxhash64(F.lit(7), "form").alias("k2"), (F.col("form") != F.col("text")).alias("changed")
    )
    every = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    # The filter before the UDF keeps stable rows of this side out of Python.
    few = (
        rows.where(_may_change(F.col("text")))
        .select("id", F.xxhash64("text").alias("th"), _canonical_udf("text").alias("form"), "text")
        .where(F.col("form") != F.col("text"))
        .select(F.col("id").alias("id2"), F.col("th").alias("th2"), F.xxhash64("form").alias("k1"), F.xxhash64(F.lit(7), "form").alias("k2"))
        .dropDuplicates(["id2"])
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    )
    met = every.join(few, ["k1", "k2", "salt"]).where((F.col("th") != F.col("th2")) & (~F.col("changed") | (F.col("id") < F.col("id2"))))
    return met.select(F.least("id", "id2").alias("chunk_id_a"), F.greatest("id", "id2").alias("chunk_id_b")).distinct()
