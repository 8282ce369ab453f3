"""Edit distances and error rates over code points and units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmend.functions.text import common_start

#: Up to so many code points texts are compared as they are.
SHORT = 64


def edit_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance in code points, unit costs. What two long texts share at their start and end is taken off first, which
    leaves the distance as it is: texts that differ in one place cost their length, not its square."""
    return F.when(left == right, F.lit(0)).when(_short(left, right), F.levenshtein(left, right)).otherwise(_differing(left, right, lambda v: F.levenshtein(v["l"], v["r"]))).cast("bigint")


def _short(left: Column, right: Column) -> Column:
    return F.greatest(F.length(left), F.length(right)) <= SHORT


def _differing(left: Column, right: Column, body: Callable[[Column], Column]) -> Column:
    """body of struct<l, r>: the texts without what they share at their start and at their end."""
    rest = F.transform(F.array(F.struct(left.alias("l"), right.alias("r"))), lambda v: _without_start(v["l"], v["r"]))
    turned = F.transform(rest, lambda v: _without_start(F.reverse(v["l"]), F.reverse(v["r"])))
    return F.get(F.transform(turned, body), 0)


def _without_start(left: Column, right: Column) -> Column:
    """struct<l, r>: two texts without the code points that both begin with."""
    return F.get(F.transform(F.array(common_start(left, right) + 1), lambda at: F.struct(F.substring(left, at, F.length(left)).alias("l"), F.substring(right, at, F.length(right)).alias("r"))), 0)


def within(left: Column, right: Column, most: int) -> Column:
    """The distance where it is at most the bound, else -1: the work is bounded too.

    Of long texts only what differs is compared, and only if one of most + 1 equal parts of the left one is found within
    most places of its own in the right one, as must be where the distance is at most the bound.
    """

    def long(v: Column) -> Column:
        size = F.ceil(F.length(v["l"]) / F.lit(float(most + 1))).cast("int")

        def found(k: Column) -> Column:
            part = F.substring(v["l"], k * size + 1, size)
            return F.contains(F.substring(v["r"], F.greatest(k * size + 1 - most, F.lit(1)), size + 2 * most), part)

        return F.when(F.abs(F.length(v["l"]) - F.length(v["r"])) > most, -1).when(F.exists(F.sequence(F.lit(0), F.lit(most)), found), F.levenshtein(v["l"], v["r"], most)).otherwise(-1)

    return F.when(left == right, F.lit(0)).when(_short(left, right), F.levenshtein(left, right, most)).otherwise(_differing(left, right, long)).cast("bigint")


def units_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance of two arrays: each distinct unit of the pair stands as one code point."""

    def told(v: Column) -> Column:
        def spelled(units: Column) -> Column:
            # Letters from U+3400 on: there are over 27 000 before the surrogates.
            return F.array_join(F.transform(units, lambda u: F.decode(F.unhex(F.lpad(F.hex(F.array_position(v["known"], u) + 0x3400), 4, "0")), "UTF-16BE")), "")

        return edit_distance(spelled(v["l"]), spelled(v["r"]))

    # The distinct units are found once a pair, not once a unit.
    pair = F.struct(left.alias("l"), right.alias("r"), F.array_distinct(F.concat(left, right)).alias("known"))
    return F.when(left == right, F.lit(0).cast("bigint")).otherwise(F.get(F.transform(F.array(pair), told), 0))


def error_rate(distance: Column, reference: Column, prediction: Column) -> Column:
    """Character error rate from a distance: over an empty reference 0 for an empty prediction, else 1. It can exceed 1."""
    return F.when(F.length(reference) == 0, F.when(F.length(prediction) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(distance / F.length(reference))


def cer(prediction: Column, reference: Column) -> Column:
    """Character error rate of texts in normal form."""
    return error_rate(edit_distance(prediction, reference), reference, prediction)
