"""Training records in the formats that trainers read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmend.functions import prompts as P
from voxmend.functions.text import strip
from voxmend.operators.evidence import hotwords, scored, text_field, texts_field

#: Names of each format, in any letter case.
FORMATS = {"internal": "internal", "qwen": "chat", "qwen-messages": "chat", "messages": "chat", "prompt-completion": "prompt", "prompt": "prompt", "query-response": "query"}


def block_of(df: DataFrame) -> Column:
    return P.input_block(text_field(df, "input.asr_top1"), texts_field(df, "input.nbest"), texts_field(df, "input.nbest_pinyin"), hotwords(df), scored(df))


def to_chat(df: DataFrame) -> DataFrame:
    """id, messages."""
    return df.select(text_field(df, "id").alias("id"), P.chat(text_field(df, "instruction"), block_of(df), F.col("output")).alias("messages"))


def to_prompt(df: DataFrame) -> DataFrame:
    """prompt, completion."""
    told, block = strip(text_field(df, "instruction")), block_of(df)
    prompt = F.when(block != "", strip(F.concat(told, F.lit("\n\n"), block))).otherwise(told)
    return df.select(prompt.alias("prompt"), P.compact_json(F.col("output")).alias("completion"))


def to_query(df: DataFrame) -> DataFrame:
    """query, response."""
    return df.select(P.query(texts_field(df, "input.nbest")).alias("query"), P.compact_json(F.col("output")).alias("response"))


def export(df: DataFrame, name: str) -> DataFrame:
    """df in the format of that name; internal is df itself."""
    kind = FORMATS.get(name.strip().lower())
    if kind is None:
        raise ValueError(f"Unsupported format: {name}")
    return {"internal": lambda x: x, "chat": to_chat, "prompt": to_prompt, "query": to_query}[kind](df)


def inference_messages(df: DataFrame, input_format: str = "internal") -> DataFrame:
    """df with messages to complete: of internal records the export without its reply, of chat records all but a closing reply."""
    if input_format == "internal":
        chat = P.chat(text_field(df, "instruction"), block_of(df), F.col("output"))
        return df.withColumn("messages", F.slice(chat, 1, 2))
    if input_format != "qwen-messages":
        raise ValueError(f"Unsupported input format: {input_format}")
    return df.withColumn("messages", P.without_reply(F.col("messages")))


def training_texts(df: DataFrame, input_format: str = "qwen-messages", max_length: int = 2048) -> DataFrame:
    """text: each record's messages in the plain template, cut to what training reads."""
    chats = df if input_format == "qwen-messages" else to_chat(df)
    if "messages" not in chats.columns:
        raise ValueError("qwen-messages input requires a messages field")
    return chats.select(P.capped(P.plain_template(F.col("messages")), max_length).alias("text"))
