"""Prompts and training texts, byte for byte as downstream trainers expect them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmend.functions.text import strip

#: Literals of the exported records.
TASK = "asr_constrained_correction"
INSTRUCTION = "根据 ASR 输出、N-best 候选和拼音证据进行中文 ASR 后纠错。只做必要的最小修改；没有必要纠错时输出空 edits。"
CHAT_SYSTEM = '你是一个保守的中文 ASR 后纠错器。只输出合法 JSON，格式为 {"edits":[{"from":"...","to":"...","reason":"..."}]}。'
QUERY_HEADER = "Correct the ASR transcription using the N-best hypotheses and pinyin evidence. Return JSON edits only."
TEACHER_SYSTEM = (
    '你是一个保守的中文 ASR 后纠错标注器。只输出合法 JSON，格式为 {"edits":[{"from":"...","to":"...","reason":"..."}]}。'
    '只做有 N-best 或拼音证据支持的最小修改；没有必要修改时输出 {"edits":[]}。'
)
TEACHER_HEADER = "请根据以下证据输出 JSON edits。"
TEACHER_FOOTER = "输出要求：只输出 JSON，不要解释。"




def numbered(texts: Column) -> Column:
    """'1. text' and so on."""
    return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(t, F.lit(""))))


def _section(title: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(title)), lines)).otherwise(F.array().cast("array<string>"))


def hotword_lines(hotwords: Column, scored: bool = False) -> Column:
    """'- text' of hot words (array of struct<text, score>), with '(score=0.1234)' where there is a score.

    scored renders scores in Python, since the JVM rounds halves of the decimal notation and not of the number; leave it
    off where no score can occur.
    """
    plain = F.transform(F.coalesce(hotwords, F.array().cast("array<struct<text:string,score:double>>")), lambda h: F.concat(F.lit("- "), strip(h["text"])))
    if not scored:
        return plain

    @F.pandas_udf("array<string>")
    def scores(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: [] if xs is None else ["" if x is None or x != x else f" (score={x:.4f})" for x in xs])

    return F.zip_with(plain, scores(F.transform(hotwords, lambda h: h["score"])), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))


def input_block(top1: Column, nbest: Column, pinyin: Column, hotwords: Column | None = None, scored: bool = False) -> Column:
    """The evidence as text: sections ASR, N-best, Pinyin (as many as hypotheses, if there are any) and Hotwords, empty ones left out."""
    shown = F.when(F.size(F.coalesce(nbest, F.array().cast("array<string>"))) > 0, F.slice(pinyin, 1, F.size(nbest))).otherwise(pinyin)
    parts = [
        F.when(strip(top1) != "", F.array(F.concat(F.lit("ASR: "), strip(top1)))).otherwise(F.array().cast("array<string>")),
        _section("N-best:", numbered(nbest)),
        _section("Pinyin:", numbered(shown)),
    ]
    if hotwords is not None:
        parts.append(_section("Hotwords:", hotword_lines(hotwords, scored)))
    return strip(F.array_join(F.concat(*parts), "\n"))


def compact_json(value: Column) -> Column:
    """A struct as JSON without spaces, nulls written out, in the struct's order."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def under(instruction: Column, block: Column) -> Column:
    """The instruction, an empty line, the block; either alone if the other is empty."""
    told = strip(instruction)
    return F.when(told != "", strip(F.concat(told, F.lit("\n\n"), block))).otherwise(block)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(instruction: Column, block: Column, output: Column) -> Column:
    return F.array(message("system", F.lit(CHAT_SYSTEM)), message("user", under(instruction, block)), message("assistant", compact_json(output)))


def query(nbest: Column) -> Column:
    return strip(F.concat(F.lit(QUERY_HEADER + "\n"), F.array_join(numbered(nbest), "\n")))


def teacher_messages(block: Column) -> Column:
    user = F.concat(F.lit(TEACHER_HEADER + "\n\n"), block, F.lit("\n\n" + TEACHER_FOOTER))
    return F.array(message("system", F.lit(TEACHER_SYSTEM)), message("user", user))


def without_reply(messages: Column) -> Column:
    """Messages up to the assistant's closing one, if that is who closes."""
    return F.when(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.slice(messages, 1, F.size(messages) - 1)).otherwise(messages)


def plain_template(messages: Column, open_reply: bool = False) -> Column:
    """'<role>', a line break and the content of each message, joined by line breaks; open_reply adds '<assistant>' and a line break."""
    lines = F.transform(messages, lambda m: F.concat(F.lit("<"), m["role"], F.lit(">\n"), m["content"]))
    return F.array_join(F.concat(lines, F.array(F.lit("<assistant>\n"))) if open_reply else lines, "\n")


def capped(text: Column, max_length: int) -> Column:
    """The first 8 * max_length code points (1 at least): what training reads of a text."""
    return F.substring(text, 1, max(1, 8 * max_length))
