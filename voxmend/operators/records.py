"""Record transforms: raw hypotheses to training records, edits applied, rules applied, model replies parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmend.functions import edits as E
from voxmend.functions import prompts as P
from voxmend.functions.model_text import parse_model_edits
from voxmend.functions.phonetic import Characters, joined
from voxmend.functions.text import EXACT, Normalizer, strip, without_blanks
from voxmend.operators.evidence import computed, field, support, text_field, texts_field, with_evidence
from voxmend.operators.rules import rule_edits

#: Fixed value: the source of raw records that name no dataset.
DEFAULT_SOURCE = "chinesehp/aishell-1"


def training_records(raw: DataFrame, nbest_size: int = 5, output_mode: str = "edits", norm: Normalizer = EXACT, provider=None) -> DataFrame:
    """Raw records (dataset, split, id, reference, nbest, nbest_pinyin) as training records, columns in export order.

    Blank hypotheses go, then the first nbest_size (1 at least) stay; the first is asr_top1. Given pinyin is cut to as
    many and filled up from the provider. output is the minimal edits from asr_top1 to reference, or in mode text the
    corrected_text. Null fields count as missing.
    """
    if output_mode not in ("edits", "text"):
        raise ValueError(f"Unsupported output_mode: {output_mode}")
    provider = provider or Characters()
    kept = F.slice(without_blanks(texts_field(raw, "nbest")), 1, max(1, int(nbest_size)))
    base = raw.select(
        text_field(raw, "id").alias("id"),
        text_field(raw, "dataset", DEFAULT_SOURCE).alias("source"),
        text_field(raw, "split").alias("split"),
        text_field(raw, "reference").alias("reference"),
        kept.alias("nbest"),
        texts_field(raw, "nbest_pinyin").alias("given"),
    )
    top1 = F.coalesce(F.try_element_at("nbest", F.lit(1)), F.lit(""))
    base = computed(base.withColumn("nbest_n", norm.many(F.col("nbest"))).withColumn("reference_n", norm.one(F.col("reference"))).withColumn("top1", top1), _=F.lit(0)).drop("_")
    top1_n = F.coalesce(F.try_element_at("nbest_n", F.lit(1)), F.lit(""))
    if isinstance(provider, Characters):
        sounds = F.transform("nbest_n", lambda t: joined(provider.units(t)))
    else:  # a provider may run Python, which has no place inside a lambda: one call a hypothesis
        sounds = F.array(*(joined(provider.units(F.coalesce(F.try_element_at("nbest_n", F.lit(k + 1)), F.lit("")))) for k in range(max(1, int(nbest_size)))))
    pinyin = F.concat(F.slice("given", 1, F.size("nbest")), F.slice(sounds, F.least(F.size("given"), F.size("nbest")) + 1, F.greatest(F.size("nbest") - F.size("given"), F.lit(0))))
    base = computed(base, pinyin=pinyin, gold=E.minimal_edits(top1_n, F.col("reference_n")))
    block = F.struct(F.col("top1").alias("asr_top1"), F.col("nbest"), F.col("pinyin").alias("nbest_pinyin"), F.coalesce(F.try_element_at("pinyin", F.lit(1)), F.lit("")).alias("asr_top1_pinyin"))
    output = F.struct(F.col("gold").alias("edits")) if output_mode == "edits" else F.struct(F.col("reference").alias("corrected_text"))
    return base.select("id", "source", "split", F.lit(P.TASK).alias("task"), F.lit(P.INSTRUCTION).alias("instruction"), block.alias("input"), output.alias("output"), "reference")


def prepared(raw: DataFrame, split: str = "", limit: int = 0, order: str = "id", **options) -> DataFrame:
    """Training records of one split (empty: all), the first limit of them in the given order (0: all)."""
    chosen = raw.where(text_field(raw, "split") == split) if split else raw
    return training_records(chosen.orderBy(order).limit(limit) if limit else chosen, **options)


def edits_of(df: DataFrame, name: str) -> Column | None:
    """The edits in a column that is an edits array, or a struct with one."""
    inner = field(df, f"{name}.edits")
    found = inner if inner is not None else field(df, name)
    return None if found is None or (inner is None and not df.schema[name].dataType.simpleString().startswith("array")) else found


def apply_edits(df: DataFrame, edits_field: str = "predicted_edits", max_changed: int = E.MAX_CHANGED, norm: Normalizer = EXACT, provider=None) -> DataFrame:
    """df with correction_result and prediction. Edits are edits_field's where the column exists (null: none), else
    output's. Only the input block is evidence: a record without one has none, so any edit is refused."""
    edits = edits_of(df, edits_field)
    if edits is None:
        edits = edits_of(df, "output")
    edits = E.no_edits() if edits is None else E.clean_edits(edits.cast(E.EDITS))
    block = field(df, "input") is not None
    text = F.coalesce(field(df, "input.asr_top1"), F.lit("")) if block else text_field(df, "asr_top1")
    nbest = texts_field(df, "input.nbest")
    shown = text if block else F.lit("")
    backing = support(df, shown, nbest)
    ready = computed(df, _e=F.struct(edits.alias("edits"), norm.one(shown).alias("top1_n"), norm.many(nbest).alias("nbest_n"), norm.many(backing).alias("support_n")))
    reasons = E.check_edits(F.col("_e.edits"), F.col("_e.top1_n"), F.col("_e.nbest_n"), F.col("_e.support_n"), max_changed, norm=norm, provider=provider)
    ready = computed(ready, _reasons=reasons, _applied=E.apply_edits(text, F.col("_e.edits")))
    done = computed(ready, correction_result=E.safe_apply(text, F.col("_e.edits"), F.col("_reasons"), F.col("_applied")))
    return done.withColumn("prediction", F.col("correction_result.text")).drop("_e", "_reasons", "_applied")


def rule_correct(df: DataFrame, max_char_distance: int = 4, max_pinyin_distance: int = 1, min_candidate_support: int = 2, max_changed: int = E.MAX_CHANGED, norm: Normalizer = EXACT, provider=None) -> DataFrame:
    """df with predicted_edits, correction_result and prediction of the rule corrector.

    Evidence is the input block, or the whole record where there is none; then its reference is support as well.
    """
    ready = with_evidence(df, norm, own_top1=True)
    ready = computed(ready, _edits=rule_edits(F.col("ev"), max_char_distance, max_pinyin_distance, min_candidate_support, norm, provider))
    backing = support(df, F.col("ev.top1"), F.col("ev.nbest_all"), "input." if field(df, "input") is not None else "")
    ready = computed(ready.withColumn("_s", norm.many(backing)), _support=F.col("_s")).drop("_s")
    reasons = E.check_edits(F.col("_edits"), F.col("ev.top1_n"), F.col("ev.nbest_all_n"), F.col("_support"), max_changed, norm=norm, provider=provider)
    ready = computed(ready, _reasons=reasons, _applied=E.apply_edits(F.col("ev.top1"), F.col("_edits")))
    done = computed(ready, correction_result=E.safe_apply(F.col("ev.top1"), F.col("_edits"), F.col("_reasons"), F.col("_applied")))
    return done.withColumn("predicted_edits", F.struct(F.col("_edits").alias("edits"))).withColumn("prediction", F.col("correction_result.text")).drop("ev", "_edits", "_support", "_reasons", "_applied")


def parse_replies(df: DataFrame, text_field_name: str = "model_output", edits_field: str = "predicted_edits") -> DataFrame:
    """df with edits_field (struct<edits>) and parse_warnings from the replies in text_field_name."""
    parsed = computed(df.withColumn("_p", parse_model_edits(text_field(df, text_field_name))), _parsed=F.col("_p")).drop("_p")
    return parsed.withColumn(edits_field, F.struct(F.col("_parsed.edits").alias("edits"))).withColumn("parse_warnings", F.col("_parsed.parse_warnings")).drop("_parsed")


def asr_records(decoded: DataFrame, norm: Normalizer = EXACT, provider=None, source: str = "whisper-large-v3") -> DataFrame:
    """Flat records from a decoder's hypotheses (id, audio, reference, hypotheses): stripped, blanks dropped, first is asr_top1;
    all other columns as text in metadata."""
    provider = provider or Characters()
    rest = [c for c in decoded.columns if c not in ("id", "audio", "reference", "hypotheses")]
    metadata = F.create_map(*(x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string")))) if rest else F.create_map().cast("map<string,string>")
    kept = decoded.withColumn("_nbest", F.filter(F.transform("hypotheses", strip), lambda t: t != ""))
    kept = kept.withColumn("_n", norm.many(F.col("_nbest")))
    return kept.select(
        text_field(decoded, "id").alias("id"), text_field(decoded, "audio").alias("audio"), F.lit(source).alias("source"), F.coalesce(F.try_element_at("_nbest", F.lit(1)), F.lit("")).alias("asr_top1"),
        F.col("_nbest").alias("nbest"), F.transform("_n", lambda t: joined(provider.units(t))).alias("nbest_pinyin"), text_field(decoded, "reference").alias("reference"), metadata.alias("metadata"),
    )
