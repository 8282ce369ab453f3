"""The functions by name, for SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from voxmend.functions.model_text import PARSED, read_replies
from voxmend.functions.text import normal_form

#: Functions that SQL itself can state: name and parameters, result, body.
STATED = (
    ("edit_distance(a STRING, b STRING)", "BIGINT", "CAST(levenshtein(a, b) AS BIGINT)"),
    ("error_rate(prediction STRING, reference STRING)", "DOUBLE", "CASE WHEN length(reference) = 0 THEN CASE WHEN length(prediction) = 0 THEN 0D ELSE 1D END ELSE levenshtein(prediction, reference) / CAST(length(reference) AS DOUBLE) END"),
    ("sounds_like(a ARRAY<STRING>, b ARRAY<STRING>)", "BOOLEAN", "size(a) > 0 AND a = b"),
)


def register(spark: SparkSession) -> list[str]:
    """Registers normal_text, model_edits and the functions in STATED in the session; returns their names."""

    @F.pandas_udf("string")
    def normal_text(texts: pd.Series) -> pd.Series:
        return texts.map(normal_form)

    spark.udf.register("normal_text", normal_text)
    spark.udf.register("model_edits", F.pandas_udf(read_replies, PARSED))
    for head, kind, body in STATED:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return ["normal_text", "model_edits", *(head.split("(")[0] for head, _, _ in STATED)]
