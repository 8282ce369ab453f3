"""Evidence of correction records: hypotheses and texts, raw and in normal form, as columns computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmend.functions.text import EXACT, Normalizer, has_text, without_blanks


def field(df: DataFrame, path: str) -> Column | None:
    """A dotted field, or None if the schema hasn't got it."""
    schema = df.schema
    for name in path.split("."):
        names = getattr(schema, "names", None)
        if names is None or name not in names:
            return None
        schema = schema[name].dataType
    return F.col(".".join(f"`{name}`" for name in path.split(".")))


def text_field(df: DataFrame, path: str, default: str = "") -> Column:
    """A dotted field as text; missing or null: default."""
    found = field(df, path)
    return F.lit(default) if found is None else F.coalesce(found.cast("string"), F.lit(default))


def texts_field(df: DataFrame, path: str) -> Column:
    found = field(df, path)
    empty = F.array().cast("array<string>")
    return empty if found is None else F.coalesce(found.cast("array<string>"), empty)


def hotwords(df: DataFrame, root: str = "input.") -> Column | None:
    """Hot words as array<struct<text, score>>, given as strings or as structs with text; None without such a field."""
    found = field(df, f"{root}hotwords")
    if found is None:
        return None
    kind = df.select(found.alias("h")).schema["h"].dataType.elementType
    names = getattr(kind, "names", None)

    def one(h: Column) -> Column:
        text, score = (h["text"] if names else h), (h["score"] if names and "score" in names else F.lit(None))
        return F.struct(F.coalesce(text.cast("string"), F.lit("")).alias("text"), score.cast("double").alias("score"))

    return F.transform(found, one)


def scored(df: DataFrame, root: str = "input.") -> bool:
    """Whether hot words carry scores."""
    found = field(df, f"{root}hotwords")
    return found is not None and "score" in getattr(df.select(found.alias("h")).schema["h"].dataType.elementType, "names", ())


def support(df: DataFrame, top1: Column, nbest: Column, root: str = "input.") -> Column:
    """The texts of a record's evidence that may back an edit, as they are: root is where the evidence is."""
    others = tuple(text_field(df, f"{root}{k}") for k in ("reference", "corrected_text") if field(df, f"{root}{k}") is not None)
    hot = hotwords(df, root)
    parts = [F.array(top1, *others), F.coalesce(nbest, F.array().cast("array<string>"))]
    if hot is not None:
        parts.append(F.coalesce(F.transform(hot, lambda h: h["text"]), F.array().cast("array<string>")))
    return without_blanks(F.concat(*parts))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once a row, whatever refers to them later.

    The optimizer merges projections, and moves filters below them, by repeating what a column stands for; where such
    columns build on each other the work multiplies. A generator of one row stands in the way of that.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def pinned(df: DataFrame) -> DataFrame:
    """df behind the same barrier, all columns of it: whatever is made of it later, filters stay above and no column is cut
    off below, so that plans that use it twice share one shuffle."""
    return df.select(F.inline_outer(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def with_evidence(df: DataFrame, norm: Normalizer = EXACT, own_top1: bool = False) -> DataFrame:
    """df with struct column ev: top1, nbest (blanks dropped), nbest_all, and all of them and reference in normal form.

    Evidence is the input block where the record has one, else the record itself. top1 is input.asr_top1 where that is
    set, else the first hypothesis that is not blank; with own_top1 it is the evidence's asr_top1 or empty. Null counts
    as missing.
    """
    block = field(df, "input")
    raw = df if block is None else df
    all_nbest = texts_field(raw, "input.nbest" if block is not None else "nbest")
    if block is not None and field(df, "nbest") is not None:
        all_nbest = F.when(F.col("input").isNull(), texts_field(df, "nbest")).otherwise(all_nbest)
    given = field(df, "input.asr_top1")
    if own_top1:
        own = given if block is not None else field(df, "asr_top1")
        given = F.lit("") if own is None else F.coalesce(own.cast("string"), F.lit(""))
    # Each hypothesis is normalised once, blank or not.
    pairs = F.zip_with(all_nbest, norm.many(all_nbest), lambda t, n: F.struct(t.alias("t"), n.alias("n")))
    first = computed(df, _all=pairs)
    first = computed(first, _some=F.filter("_all", lambda p: has_text(p["t"])))
    top1 = F.coalesce(F.try_element_at("_some", F.lit(1))["t"], F.lit(""))
    if given is not None:
        top1 = F.coalesce(given.cast("string"), top1)
    second = first.withColumn("_top1", top1)
    ev = F.struct(
        F.col("_top1").alias("top1"),
        F.col("_some.t").alias("nbest"),
        F.col("_all.t").alias("nbest_all"),
        norm.one(text_field(df, "reference")).alias("reference_n"),
        norm.one(F.col("_top1")).alias("top1_n"),
        F.col("_some.n").alias("nbest_n"),
        F.col("_all.n").alias("nbest_all_n"),
    )
    return computed(second, ev=ev).drop("_all", "_some", "_top1")
