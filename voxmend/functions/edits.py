"""Edits as arrays of struct<from, to, reason>: derived from two texts, checked against evidence, applied.

A text changes by replacing the first place where an edit's from occurs; edits carry no position. Checks and derivation
work on normal forms, application on the text as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmend.functions.phonetic import Characters, sound_alike
from voxmend.functions.text import EXACT, Normalizer, common_start, strip, without_blanks

EDIT = "struct<`from`:string,`to`:string,reason:string>"
EDITS = f"array<{EDIT}>"
RESULT = f"struct<accepted:boolean,text:string,reasons:array<string>,applied_edits:{EDITS}>"
#: What derived edits name as their reason, and the default bound on changed characters.
SPAN_REASON = "middle_span_replace"
RULE_REASON = "rule_nbest_same_pinyin"
MAX_CHANGED = 12


def no_edits() -> Column:
    return F.array().cast(EDITS)


def no_texts() -> Column:
    return F.array().cast("array<string>")


def edit(source: Column, target: Column, reason: Column | str) -> Column:
    return F.struct(source.alias("from"), target.alias("to"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason")).cast(EDIT)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def minimal_edits(source: Column, target: Column) -> Column:
    """At most one edit between two normal texts: what is left between their common start and common end (which does not
    reach into the start). A bare insertion takes the character before it into both sides, or the one after it at the
    start of the text; out of an empty text nothing can be replaced."""

    def ends(v: Column) -> Column:
        shorter = F.least(F.length(v["s"]), F.length(v["t"]))
        return F.struct(v["s"], v["t"], v["start"], F.least(common_start(F.reverse(v["s"]), F.reverse(v["t"])), shorter - v["start"]).alias("end"))

    def spans(v: Column) -> Column:
        bare = F.length(v["s"]) - v["end"] == v["start"]
        left = F.when(bare & (v["start"] > 0), v["start"] - 1).otherwise(v["start"])
        more = F.when(bare & (v["start"] == 0), 1).otherwise(0)
        return F.struct(v["s"], v["t"], left.alias("left"), (F.length(v["s"]) - v["end"] + more).alias("s_end"), (F.length(v["t"]) - v["end"] + more).alias("t_end"))

    def made(v: Column) -> Column:
        old = F.substring(v["s"], v["left"] + 1, v["s_end"] - v["left"])
        new = F.substring(v["t"], v["left"] + 1, v["t_end"] - v["left"])
        return F.when((v["s"] == v["t"]) | (old == ""), no_edits()).otherwise(F.array(edit(old, new, SPAN_REASON)))

    texts = F.struct(source.alias("s"), target.alias("t"))
    started = let(texts, lambda v: F.struct(v["s"], v["t"], common_start(v["s"], v["t"]).alias("start")))
    return let(let(let(started, ends), spans), made)


def clean_edits(edits: Column) -> Column:
    """Typed edits with stripped fields; null is no edits, missing fields are empty."""
    return F.transform(F.coalesce(edits, no_edits()), lambda e: edit(strip(e["from"]), strip(e["to"]), strip(e["reason"])))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.instr(text, old)
    return F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))


def apply_edits(text: Column, edits: Column) -> Column:
    """struct<text, applied, rejected>: the edits one after the other on the text as it is. An empty from is rejected as
    empty_from, an absent one as missing_from:<from>."""
    start = F.named_struct(F.lit("text"), F.coalesce(text, F.lit("")), F.lit("applied"), no_edits(), F.lit("rejected"), no_texts())

    def one(so_far: Column, e: Column) -> Column:
        now, applied, rejected = so_far["text"], so_far["applied"], so_far["rejected"]
        problem = F.when(e["from"] == "", F.lit("empty_from")).when(~F.contains(now, e["from"]), F.concat(F.lit("missing_from:"), e["from"]))
        return F.named_struct(
            F.lit("text"),
            F.when(problem.isNull(), replace_first(now, e["from"], e["to"])).otherwise(now),
            F.lit("applied"),
            F.when(problem.isNull(), F.concat(applied, F.array(e))).otherwise(applied),
            F.lit("rejected"),
            F.when(problem.isNull(), rejected).otherwise(F.concat(rejected, F.array(problem))),
        )

    return F.aggregate(edits, start, one)


def support_texts(top1: Column, nbest: Column, others: tuple[Column, ...] = (), hotwords: Column | None = None) -> Column:
    """What may back an edit's target, blanks dropped: top1, other texts of the evidence, hypotheses, hot words."""
    found = F.concat(F.array(top1, *others), F.coalesce(nbest, no_texts()), no_texts() if hotwords is None else F.coalesce(hotwords, no_texts()))
    return without_blanks(found)


def check_edits(edits: Column, top1: Column, nbest: Column, support: Column, max_changed: int = MAX_CHANGED, require_support: bool = True, norm: Normalizer = EXACT, provider=None) -> Column:
    """The reasons against the edits, in order, one an edit at most; none: they pass.

    In this order: empty_span (from is empty in normal form); identity_edit:<from>; from_not_supported:<from> unless it is
    inside top1 or a hypothesis; then the longer side counts towards the running total, and above max_changed it is
    too_many_changed_chars; to_not_supported:<to> unless to is empty, inside a support text, or sounds like from.
    top1, nbest and support must be columns in normal form already: a Python function cannot run inside the fold.
    """
    provider = provider or Characters()
    sources = F.filter(F.concat(F.array(top1), nbest), lambda t: t != "")
    pairs = _normal_pairs(edits, norm)
    start = F.named_struct(F.lit("changed"), F.lit(0), F.lit("reasons"), no_texts())

    def one(so_far: Column, e: Column) -> Column:
        f, t = e["f"], e["t"]
        early = (
            F.when(f == "", F.lit("empty_span"))
            .when(f == t, F.concat(F.lit("identity_edit:"), f))
            .when(~F.exists(sources, lambda s: F.contains(s, f)), F.concat(F.lit("from_not_supported:"), f))
        )
        changed = so_far["changed"] + F.when(early.isNull(), F.greatest(F.length(f), F.length(t))).otherwise(0)
        backed = (t == "") | F.exists(support, lambda s: F.contains(s, t)) | sound_alike(provider.units(f), provider.units(t))
        late = F.when(changed > max_changed, F.lit("too_many_changed_chars")).when(F.lit(require_support) & ~backed, F.concat(F.lit("to_not_supported:"), t))
        reason = F.coalesce(early, late)
        return F.named_struct(F.lit("changed"), changed, F.lit("reasons"), F.when(reason.isNull(), so_far["reasons"]).otherwise(F.concat(so_far["reasons"], F.array(reason))))

    return F.aggregate(pairs, start, one, lambda end: end["reasons"])


def _normal_pairs(edits: Column, norm: Normalizer) -> Column:
    """Both sides of all edits through one call an array: a Python function cannot run inside a lambda."""
    old = norm.many(F.transform(edits, lambda e: e["from"]))
    new = norm.many(F.transform(edits, lambda e: e["to"]))
    return F.zip_with(old, new, lambda f, t: F.struct(f.alias("f"), t.alias("t")))


def safe_apply(text: Column, edits: Column, reasons: Column, done: Column) -> Column:
    """The result of applying checked edits (done: what apply_edits gives): all of them, or, for any reason or rejection,
    the text as it was and none."""
    against = F.when(F.size(reasons) > 0, reasons).otherwise(done["rejected"])
    ok = F.size(against) == 0
    return F.struct(
        ok.alias("accepted"),
        F.when(ok, done["text"]).otherwise(F.coalesce(text, F.lit(""))).alias("text"),
        F.when(ok, no_texts()).otherwise(against).alias("reasons"),
        F.when(ok, edits).otherwise(no_edits()).alias("applied_edits"),
    )


def changed_chars(edits: Column) -> Column:
    """The sum of the longer sides of edits in normal form."""
    return F.aggregate(edits, F.lit(0), lambda n, e: n + F.greatest(F.length(e["from"]), F.length(e["to"])))
