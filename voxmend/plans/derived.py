"""Records derived from plain tables, with the DuckDB text of the same: the tables hold no hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmend.functions.text import normalize_composed
from voxmend.operators.evidence import computed

#: What ends a sentence. A record is a sentence, as an utterance is.
SENTENCE_END = "[.!?\n]+"
#: More than any text has: to the end.
REST = 2**31 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer tasks (a small table is one row group, so one task); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (doc_id-number), turn (doc_id + number), lang, source, norm of every sentence of every document's whole text,
    in normal form; a document without text has one empty sentence."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    docs = docs.select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), SENTENCE_END)).alias("nth", "sentence"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), F.col("nth").cast("string"))
    return docs.select(named.alias("id"), (F.coalesce("doc_id", F.lit(0)) + F.col("nth")).alias("turn"), "lang", "source", normalize_composed(F.col("sentence")).alias("norm"))


def turn_of(record_id: Column) -> Column:
    """The turn of a sentence by its id."""
    return F.coalesce(F.nullif(F.substring_index(record_id, "-", 1), F.lit("")).cast("bigint"), F.lit(0)) + F.substring_index(record_id, "-", -1).cast("bigint")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records (dataset, split, id, reference, nbest) out of the sentences of documents: reference is the whole sentence in
    normal form; hypotheses are the reference with one character replaced, left out or put in, or reversed, in six
    arrangements."""
    docs = computed(sentences(spark, sf_dir), reference=F.col("norm")).select("id", "turn", "lang", "source", "reference", (F.lit(2) + F.col("turn") % 7).cast("int").alias("p"))
    r, p = F.col("reference"), F.col("p")

    def part(first: Column | int, n: Column | int) -> Column:
        return F.substring(r, F.lit(first) if isinstance(first, int) else first, F.lit(n) if isinstance(n, int) else n)

    swapped = F.concat(part(1, p - 1), F.lit("x"), part(p + 1, REST))
    shorter = F.concat(part(1, p - 1), part(p + 1, REST))
    longer = F.concat(part(1, p), F.lit("e"), part(p + 1, REST))
    docs = computed(docs, sb=swapped, dl=shorter, ins=longer, rv=F.reverse("reference"))
    kinds = [("reference", "sb", "dl"), ("sb", "reference", "reference", "dl"), ("dl", "sb", "ins", "reference"), ("ins", "dl", "dl"), ("rv", "reference", "reference"), ("''", "'  '", "sb", "reference")]
    nbest = F.when(F.lit(False), F.array().cast("array<string>"))
    for k, names in enumerate(kinds):
        nbest = nbest.when(F.col("turn") % 6 == k, F.array(*(F.expr(n) for n in names)))
    return docs.select("lang", "source", F.col("source").alias("dataset"), F.col("lang").alias("split"), "id", "turn", "reference", nbest.alias("nbest"))


def predicted_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records with predicted_edits of five kinds by turn: what the reference asks for; an unbacked word; two
    edits, one of an absent text; a deletion; an edit that changes nothing and one with an empty side."""
    from voxmend.operators.records import training_records
    from voxmend.functions.text import COMPOSED
    from voxmend.functions.edits import edit

    raw = raw_records(spark, sf_dir)
    made = training_records(raw, norm=COMPOSED)
    top1 = F.col("input.asr_top1")
    first, second, third = (F.substring(top1, a, n) for a, n in ((1, 3), (4, 2), (6, 3)))
    k = turn_of(F.col("id")) % 5
    chosen = (
        F.when(k == 0, F.col("output.edits"))
        .when(k == 1, F.array(edit(first, F.lit("zqj"), "made_up")))
        .when(k == 2, F.array(edit(first, second, "swap"), edit(F.lit("¤¤"), first, "absent")))
        .when(k == 3, F.array(edit(second, F.lit(""), "cut"), edit(third, F.lit(""), "cut")))
        .otherwise(F.array(edit(first, first, "same"), edit(F.lit(""), second, "empty")))
    )
    return computed(made, predicted_edits=F.struct(chosen.alias("edits")))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, model_output: replies around one edit, fenced, bare, as a list, in prose, and without any. The edit puts the
    second half of the whole text's normal form for its first."""
    from voxmend.functions.prompts import compact_json

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", normalize_composed(F.col("text")).alias("norm"))
    half = F.expr("length(norm) div 2").cast("int")
    old, new = F.substring("norm", F.lit(1), half), F.substring("norm", half + 1, F.lit(REST))
    one = compact_json(F.struct(old.alias("from"), new.alias("to"), F.lit("r").alias("reason")))
    k = F.col("doc_id") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("ok:\n```json\n{\"edits\":["), one, F.lit("]}\n```\ndone")))
        .when(k == 1, one)
        .when(k == 2, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")))
        .when(k == 3, F.concat(F.lit("I think ["), one, F.lit(","), one, F.lit("] is right")))
        .when(k == 4, F.lit("123"))
        .otherwise(F.col("norm"))
    )
    return docs.select("doc_id", text.alias("model_output"))
