"""Steps that ask a model: a language model for edits, a teacher over HTTP, a recogniser for hypotheses.

Models are attached by factories: a factory is called once a batch stream on an executor, so weights load there and once,
and what it returns is called for each batch. Only the model's own input and output cross to Python, whatever else a
record has.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator, Sequence
from urllib import error, request

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmend.functions import prompts as P
from voxmend.functions.text import EXACT, Normalizer, strip
from voxmend.operators import exports
from voxmend.operators.evidence import computed, field, hotwords, scored, text_field, texts_field
from voxmend.operators.records import asr_records, parse_replies

Generate = Callable[[Sequence[str]], Sequence[str]]
Decode = Callable[[Sequence[str]], Sequence[Sequence[str]]]
Messages = list[dict[str, str]]


def asked(texts: Column, model: Callable[[], Callable], kind: str = "string") -> Column:
    """What the model that the factory makes says to each of the texts."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = model()
        for batch in batches:
            yield pd.Series(list(ask(batch.tolist())), dtype=object)

    return run(texts)


def first(df: DataFrame, limit: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(limit) if limit else df


def infer(df: DataFrame, model: Callable[[], Generate], input_format: str = "internal", template: Callable[[Column], Column] | None = None, limit: int = 0, order: str = "id") -> DataFrame:
    """df with model_output (stripped), predicted_edits and parse_warnings of a language model, for the first limit records
    in the given order (0: all). The prompt is the messages without their closing reply, in the template (the plain one)."""
    chats = exports.inference_messages(first(df, limit, order), input_format).select(*(f"`{c}`" for c in df.columns if c != "messages"), "messages")
    prompt = (template or (lambda messages: P.plain_template(messages, open_reply=True)))(F.col("messages"))
    said = computed(chats.withColumn("_said", asked(prompt, model)), model_output=strip(F.col("_said"))).drop("_said")
    return parse_replies(said if "messages" in df.columns else said.drop("messages"))


def teacher_prompt(df: DataFrame) -> DataFrame:
    """df with messages for a teacher, from the input block or, where there is none, the record."""
    root = "input." if field(df, "input") is not None else ""
    block = P.input_block(text_field(df, f"{root}asr_top1"), texts_field(df, f"{root}nbest"), texts_field(df, f"{root}nbest_pinyin"), hotwords(df, root), scored(df, root))
    return df.withColumn("messages", P.teacher_messages(block))


def teach(df: DataFrame, ask: Callable[[], Callable[[Messages], str]] | None = None, name: str = "", dry_run: bool = False, limit: int = 0, order: str = "id") -> DataFrame:
    """df with teacher_model (name), model_output, predicted_edits and parse_warnings of a teacher, for the first limit
    records (0: all). ask makes a function from messages to a reply (see chat_client). A dry run replies {"edits": []}."""
    shown = teacher_prompt(first(df, limit, order)).withColumn("teacher_model", F.lit(name))
    if dry_run:
        return parse_replies(shown.withColumn("model_output", F.lit('{"edits": []}'))).drop("messages")
    if ask is None:
        raise ValueError("a teacher is needed, or a dry run")

    def model() -> Generate:
        one = ask()
        return lambda texts: [one(json.loads(t)) for t in texts]

    return parse_replies(shown.withColumn("model_output", asked(F.to_json("messages"), model))).drop("messages")


def chat_client(base_url: str, model: str, key_names: Sequence[str], timeout: float = 120.0, delay: float = 0.0, max_tokens: int = 256) -> Callable[[], Callable[[Messages], str]]:
    """A factory for teach(): posts messages to base_url/chat/completions for a JSON reply at temperature 0, delay seconds
    apart. The key is the first of the named environment variables that executors have; without one it raises."""

    def connect() -> Callable[[Messages], str]:
        key = next((os.environ[k] for k in key_names if os.environ.get(k)), None)
        if key is None:
            raise RuntimeError(f"set one of {', '.join(key_names)} on executors")
        headers = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}

        def ask(messages: Messages) -> str:
            asked_for = {"model": model, "messages": messages, "temperature": 0, "max_tokens": max_tokens, "response_format": {"type": "json_object"}}
            post = request.Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps(asked_for).encode(), headers, method="POST")
            try:
                with request.urlopen(post, timeout=timeout) as reply:
                    said = json.load(reply)
            except error.HTTPError as refused:
                raise RuntimeError(f"HTTP {refused.code}: {refused.read().decode('utf-8', 'replace')[:500]}") from refused
            time.sleep(delay)
            return str(said["choices"][0]["message"]["content"])

        return ask

    return connect


def transcribe(manifest: DataFrame, model: Callable[[], Decode], source: str = "whisper-large-v3", norm: Normalizer = EXACT, provider=None, limit: int = 0, order: str = "id") -> DataFrame:
    """Flat records (see records.asr_records) of a manifest (id, audio, reference and more) by a recogniser from audio paths
    to hypotheses, best first; other columns go to metadata. A record without an audio path fails the query."""
    rows = first(manifest, limit, order)
    path = text_field(rows, "audio")
    missing = F.raise_error(F.concat(F.lit("Missing audio path for record "), text_field(rows, "id"))).cast("string")
    heard = computed(rows, _path=F.when(path == "", missing).otherwise(path)).withColumn("hypotheses", asked(F.col("_path"), model, "array<string>"))
    return asr_records(heard.drop("_path"), norm, provider, source)


def beams(num_beams: int = 8, num_return_sequences: int = 5) -> dict[str, int]:
    """Search options of a recogniser: as many beams as hypotheses at least."""
    return {"num_beams": max(num_beams, num_return_sequences), "num_return_sequences": num_return_sequences}
