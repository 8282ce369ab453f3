"""The filter of training records: the first rule that applies names why a record goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmend.functions import edits as E
from voxmend.functions.distance import cer
from voxmend.functions.text import EXACT, Normalizer
from voxmend.operators.evidence import computed, field, support, text_field, texts_field


def with_reason(
    df: DataFrame, max_baseline_cer: float = 0.8, max_changed: int = 24, max_edits: int = 4, drop_empty_edits: bool = False, require_verifier_pass: bool = False, norm: Normalizer = EXACT, provider=None, edits_json: str | None = None
) -> DataFrame:
    """df with filter_reason: empty_text, baseline_cer_too_high, bad_edits, empty_edits (if asked), too_many_edits,
    too_many_changed_chars, verifier:<up to three reasons, with | between> (if asked), or kept.

    Bounds are exclusive. The reference falls back to output.corrected_text where it is missing. edits_json names a column
    with edits as JSON text, which may be malformed (bad_edits); typed edits never are. A record without edits has none.
    """
    corrected = field(df, "output.corrected_text")
    reference = field(df, "reference")
    reference = F.coalesce(*(x.cast("string") for x in (reference, corrected) if x is not None), F.lit(""))
    if edits_json:
        from voxmend.functions.model_text import parse_json_edits

        edits = parse_json_edits(F.col(edits_json))
    else:
        typed = field(df, "output.edits")
        edits = E.no_edits() if typed is None else E.clean_edits(typed.cast(E.EDITS))
    top1, nbest = text_field(df, "input.asr_top1"), texts_field(df, "input.nbest")
    ready = computed(df, _f=F.struct(norm.one(reference).alias("reference_n"), norm.one(top1).alias("top1_n"), edits.alias("edits")))
    if require_verifier_pass:
        ready = computed(ready, _s=F.struct(norm.many(nbest).alias("nbest_n"), norm.many(support(df, top1, nbest)).alias("support_n")))
        ready = computed(ready, _reasons=E.check_edits(F.coalesce("_f.edits", E.no_edits()), F.col("_f.top1_n"), F.col("_s.nbest_n"), F.col("_s.support_n"), max_changed, norm=norm, provider=provider))
    known = F.coalesce(F.col("_f.edits"), E.no_edits())
    pairs = F.zip_with(norm.many(F.transform(known, lambda e: e["from"])), norm.many(F.transform(known, lambda e: e["to"])), lambda f, t: F.struct(f.alias("from"), t.alias("to")))
    ready = computed(ready, _changed=E.changed_chars(pairs), _cer=cer(F.col("_f.top1_n"), F.col("_f.reference_n")))
    ladder = F.when((F.col("_f.reference_n") == "") | (F.col("_f.top1_n") == ""), "empty_text").when(F.col("_cer") > max_baseline_cer, "baseline_cer_too_high").when(F.col("_f.edits").isNull(), "bad_edits")
    if drop_empty_edits:
        ladder = ladder.when(F.size("_f.edits") == 0, "empty_edits")
    ladder = ladder.when(F.size("_f.edits") > max_edits, "too_many_edits").when(F.col("_changed") > max_changed, "too_many_changed_chars")
    if require_verifier_pass:
        ladder = ladder.when(F.size("_reasons") > 0, F.concat(F.lit("verifier:"), F.array_join(F.slice("_reasons", 1, 3), "|")))
    return computed(ready, filter_reason=ladder.otherwise("kept")).select(*(f"`{c}`" for c in df.columns), "filter_reason")


def kept(df: DataFrame, **limits) -> DataFrame:
    """The records that with_reason keeps, with their own columns."""
    return with_reason(df, **limits).where("filter_reason = 'kept'").drop("filter_reason")


def reason_counts(df: DataFrame, **limits) -> DataFrame:
    return with_reason(df, **limits).groupBy("filter_reason").agg(F.count("*").alias("records"))
