"""Phonetic units of normal text, by providers that can be swapped."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmend.functions.text import characters


class Characters:
    """Without a pronunciation table a text's units are its characters, so only equal texts sound alike."""

    name = "characters"

    def units(self, normal: Column) -> Column:
        return characters(normal)

    def spelled(self, normal: Column) -> Column:
        return normal


class Syllables:
    """Units by a table from character to syllable, given by the caller (so of known size); other characters stand for themselves."""

    name = "syllables"

    def __init__(self, table: Mapping[str, str]):
        self.table = dict(table)

    def units(self, normal: Column) -> Column:
        if not self.table:
            return characters(normal)
        table = F.create_map(*(F.lit(x) for pair in self.table.items() for x in pair))
        return F.transform(characters(normal), lambda c: F.coalesce(F.try_element_at(table, c), c))

    def spelled(self, normal: Column) -> Column:
        """The text with one code point for each unit, the same for the same unit: that of the unit itself if it is one that stands
        for itself, else of the table's first character of that unit. Distances of such texts are those of the units."""
        read = {c: unit for c, unit in self.table.items() if len(c) == 1 and unit is not None}
        shown: dict[str, str] = {}
        for c, unit in read.items():
            shown.setdefault(unit, unit if len(unit) == 1 and read.get(unit, unit) == unit else c)
        swapped = {c: shown[unit] for c, unit in read.items() if c != shown[unit]}
        return F.translate(normal, "".join(swapped), "".join(swapped.values())) if swapped else normal


class Library:
    """Units by the pypinyin library where it is installed: readings depend on their neighbours."""

    name = "library"

    def units(self, normal: Column) -> Column:
        @F.pandas_udf("array<string>")
        def read(texts: pd.Series) -> pd.Series:
            from pypinyin import lazy_pinyin

            def one(text: str) -> list[str]:
                try:
                    found = [u.strip() for u in lazy_pinyin(text, errors="default")]
                except Exception:  # the library's own failures mean: no reading
                    found = []
                return [u for u in found if u] or list(text)

            return texts.map(lambda t: one(t) if t else [])

        return read(normal)


def default_provider() -> Characters | Library:
    try:
        import pypinyin  # noqa: F401
    except ImportError:
        return Characters()
    return Library()


def joined(units: Column) -> Column:
    return F.array_join(units, " ")


def sound_alike(left: Column, right: Column) -> Column:
    """Whether two arrays of units are the same and not empty."""
    return (F.size(left) > 0) & (left == right)
