"""Normal form of text: compatibility composition, then no white space and no punctuation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str has it, inside a Java character class (Java's \s is ASCII only).
SPACE_CLASS = r"\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


class _Dropped(dict):
    """A translation table that drops white space and punctuation, filled as code points come up."""

    def __missing__(self, code: int) -> int | None:
        char = chr(code)
        out = None if char.isspace() or unicodedata.category(char)[0] == "P" else code
        self[code] = out
        return out


_dropped = _Dropped()


def normal_form(text: str | None) -> str:
    """The normal form of one Python string; null counts as empty."""
    if not text:
        return ""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).translate(_dropped)


def _normal_strings(texts: pd.Series) -> pd.Series:
    return texts.map(normal_form)


def _normal_arrays(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: None if texts is None else [normal_form(t) for t in texts])


def normalize(text: Column) -> Column:
    """Exact normal form. Spark has no NFKC, so this is a vectorised Python function: use it once a column, at the scan."""
    return F.pandas_udf(_normal_strings, "string")(text)


def normalize_all(texts: Column) -> Column:
    """Exact normal form of every string of an array."""
    return F.pandas_udf(_normal_arrays, "array<string>")(texts)


def normalize_composed(text: Column) -> Column:
    """The normal form of text that is in NFKC already, in the JVM. It differs from the exact one in punctuation that is
    newer than the JVM's Unicode tables (44 rare code points)."""
    return F.coalesce(F.regexp_replace(text, rf"[\p{{P}}{SPACE_CLASS}]+", ""), F.lit(""))


def normalize_all_composed(texts: Column) -> Column:
    return F.transform(texts, normalize_composed)


def strip(text: Column) -> Column:
    """Without white space, of any kind, at both ends; null counts as empty."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    bare = F.regexp_replace(F.regexp_replace(text, rf"^[{SPACE_CLASS}]+", ""), rf"[{SPACE_CLASS}]+$", "")
    return F.when(text.isNull(), F.lit("")).when(ends.rlike(f"[{SPACE_CLASS}]"), bare).otherwise(text)


def has_text(text: Column) -> Column:
    """Whether a string has more than white space; null: no."""
    return F.coalesce(text.rlike(f"[^{SPACE_CLASS}]"), F.lit(False))


def without_blanks(texts: Column) -> Column:
    """The strings of an array that have more than white space, in order; a null array is empty."""
    return F.filter(F.coalesce(texts, F.array().cast("array<string>")), has_text)


def characters(text: Column) -> Column:
    """The code points of a string; empty for an empty string (split alone gives one empty string there)."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def common_start(left: Column, right: Column) -> Column:
    """How many first code points two strings share: found by halving, so that no string is taken apart."""

    def shared(v: Column, bits: int) -> Column:
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(bits))))

        def step(at: Column, n: Column) -> Column:
            return F.when((at + n <= v["n"]) & (F.substring(v["l"], at + 1, n) == F.substring(v["r"], at + 1, n)), at + n).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)

    pair = F.array(F.struct(left.alias("l"), right.alias("r"), F.least(F.length(left), F.length(right)).alias("n")))
    return F.get(F.transform(pair, lambda v: F.when(v["n"] < 128, shared(v, 7)).otherwise(shared(v, 30))), 0)


class Normalizer:
    """Which normal form an operator uses: exact, or composed for text known to be in NFKC."""

    def __init__(self, one, many):
        self.one, self.many = one, many


EXACT = Normalizer(normalize, normalize_all)
COMPOSED = Normalizer(normalize_composed, normalize_all_composed)
#: For columns that hold normal forms already.
DONE = Normalizer(lambda t: F.coalesce(t, F.lit("")), lambda ts: ts)
