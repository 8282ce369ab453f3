"""Mixing sources to target weights by a low-discrepancy schedule over equal blocks of words. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmend.llm.common import WORD, only, written

WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more often.
MAX_EPOCHS = 3
#: Words of a block; a source's words come within a few blocks of its target.
BLOCK_WORDS = 32
SEED = 20240607
#: Points lie in [0, RING). Point i is i * GOLDEN mod RING; GOLDEN is the odd number next to RING over the golden ratio.
#: A source's share of the ring is that of its target, to one part in RING: far under a block of any corpus.
RING = 1 << 40
GOLDEN = round(RING * (5**0.5 - 1) / 2) | 1
#: A slot's number is multiplied in two parts of so many bits, so that no product leaves 63 bits.
LOW_BITS = 20
#: The ring's cells: a point meets only the sources whose share reaches into its cell.
CELLS = 4096
#: Hexadecimal digits of a document's hash that name its range (what one window sorts), and slots of a stretch.
RANGE_DIGITS = 3
STRETCH = 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sid, source, source_size, weight, target, lo, hi of each row of sizes (source, source_size).

    Sources in code point order, null last, get the weights in turn. Targets share all words by weight; a target stops
    at max_epochs times its source's size and the excess goes to the others by weight until none is above. In the order
    of cap / weight the capped sources come first, so one pass of running sums finds them. [lo, hi) is the source's
    stretch of the ring. There is one row a source here, however many documents it has.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("sid", F.row_number().over(ranked) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    named = named.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    total, weight = F.sum("source_size").over(everything).cast("double"), F.sum("weight").over(everything)
    level = named.withColumns({"total": total, "left": total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_left": weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    level = level.withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("weight"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    rest = F.max("total").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    out = level.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(rest * F.col("weight") / free))
    running = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.sum("target").over(running) / F.nullif(F.sum("target").over(everything), F.lit(0.0))
    out = out.withColumn("hi", F.round(F.coalesce(share, F.lit(0.0)) * RING).cast("long"))
    out = out.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0).cast("long")))
    return out.select("sid", "source", "source_size", "weight", "target", "lo", "hi")


def points(slot: Column) -> Column:
    """slot * GOLDEN mod RING; slots below 2**42."""
    low = 1 << LOW_BITS
    return ((slot % low) * GOLDEN + F.floor(slot / low) * (GOLDEN * low % RING)) % RING


def dealt(targets: DataFrame, total: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, sid, blocks of every slot: the source whose stretch of the ring holds the slot's point, and its blocks."""
    slots = targets.sparkSession.range(-(-total // block_words)).select(F.col("id").alias("slot"), points(F.col("id")).alias("x"))
    width = RING // CELLS
    slots = slots.withColumn("cell", F.floor(F.col("x") / width))
    parts = targets.where("hi > lo").select("sid", "lo", "hi", F.ceil(F.col("source_size") / block_words).alias("blocks"), F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    return slots.join(parts, "cell").where("lo <= x and x < hi").select("slot", "sid", "blocks")


def schedule(targets: DataFrame, total: int, block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix in order: slot long, sid int, block long, epoch long.

    Slot i belongs to the source whose stretch of the ring holds point i; the r-th slot of a source (from 0) takes its
    block r mod blocks in epoch r div blocks. Slots past the last epoch are void. Ranks are counted within stretches of
    slots and added up over stretches, so no source is ranked in one task.
    """
    slots = dealt(targets, total, block_words).withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    counts = slots.groupBy("stretch", "sid").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("sid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("stretch").alias("s"), F.col("sid").alias("i"), F.coalesce(F.sum("n").over(upto), F.lit(0).cast("long")).alias("before"))
    local = F.row_number().over(Window.partitionBy("stretch", "sid").orderBy("slot")) - 1
    ranked = slots.withColumn("local", local).join(counts, (F.col("stretch") == F.col("s")) & (F.col("sid") == F.col("i")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local"))
    return ranked.where(F.col("rank") < F.col("blocks") * max_epochs).select("slot", "sid", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))


def turns(targets: DataFrame, total: int, block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sid, whole, more of each source that has a slot: how often the schedule takes every block of it, and how many of its
    first blocks once more.

    Slots of a source have the ranks 0 to n - 1, and rank r takes block r mod blocks: so the number of slots says how often
    any block comes up, and neither slots nor blocks need rows of their own past the scan that counts them.
    """
    counted = dealt(targets, total, block_words).groupBy("sid", "blocks").agg(F.count("*").alias("n"))
    counted = counted.withColumn("n", F.least("n", F.col("blocks") * max_epochs))
    return counted.select("sid", F.floor(F.col("n") / F.col("blocks")).alias("whole"), (F.col("n") % F.col("blocks")).alias("more"))


def shuffled(docs: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, size, mark) with sid, source_size, target and start: the words before the document in its
    source's shuffled order, by the MD5 of seed:doc_id, then mark.

    A source's documents are cut into ranges of the hash; sums of the ranges are added up, and only a range is sorted.
    """
    named = targets.select("sid", F.col("source").alias("its_source"), "source_size", "target")
    placed = docs.join(named, docs["source"].eqNullSafe(named["its_source"])).drop("its_source")
    placed = placed.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    sums = placed.groupBy("sid", "range").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("sid").alias("i"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(upto), F.lit(0).cast("long")).alias("before"))
    order = Window.partitionBy("sid", "range").orderBy("h", "mark")
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    joined = placed.withColumn("inside", inside).join(sums, (F.col("sid") == F.col("i")) & (F.col("range") == F.col("r")))
    return joined.withColumn("start", F.col("before") + F.col("inside")).drop("i", "r", "before", "inside")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, mark, sid, start of every row of docs (doc_id, text, source).

    Each source's documents, shuffled, form one run of words, cut into blocks of block_words (the last may be shorter);
    taken is the number of a document's words in the blocks that the schedule takes, repeats counted (see turns: a
    document's blocks are a stretch of its source's run, so they are met as a range). A source's taken words are within
    a few blocks of its target. Null text: size 0. A null source is a source of its own, ordered last.
    Repeated rows are documents of their own. Tables without a word: targets and taken 0. An empty table gives no rows.
    Extra columns are ignored. Reruns agree: order depends on the MD5 of doc_id and of the text (column mark) alone.
    """
    kept = only(docs, doc_id="long", text="string", source="string")
    sized = written(kept.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("mark")), "sized")
    targets = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs).coalesce(1), "targets")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    counted = turns(targets, total, block_words, max_epochs).withColumnRenamed("sid", "t_sid")
    met = shuffled(sized, targets, seed).join(counted, F.col("sid") == F.col("t_sid"), "left")
    once_more = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("more") * block_words) - F.col("start"))
    taken = F.coalesce(F.col("whole") * F.col("size") + once_more, F.lit(0)).cast("long")
    return met.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "mark", "sid", "start")


def repeated_as_mixed(docs: DataFrame) -> DataFrame:
    """docs' rows (doc_id, text, source and more), each as often as the mix takes it: taken / size rounded to the nearest whole number.

    A row without words (null or empty text) goes: the mix takes words. Rows that agree in doc_id, text and source are
    repeated as often as the first of them. A null doc_id or source is a value like any other. An empty table stays empty.
    """
    mixed = mix(docs).where("size > 0").groupBy("doc_id", "mark", "source").agg(F.round(F.max(F.col("taken") / F.col("size"))).cast("int").alias("copies"))
    mixed = mixed.where("copies > 0").select(F.col("doc_id").alias("m_doc_id"), F.col("mark").alias("m_mark"), F.col("source").alias("m_source"), "copies")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.m_doc_id")) & (F.md5("d.text") == F.col("m.m_mark")) & F.col("d.source").eqNullSafe(F.col("m.m_source"))
    met = docs.alias("d").join(mixed.alias("m"), same).select(F.struct("d.*").alias("d"), F.explode(F.sequence(F.lit(1), F.col("m.copies"))).alias("copy"))
    return met.select("d.*")
