"""Language model scores of whole documents: smoothed word counts of the corpus, and a gated recurrent model over them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmend.llm import gru
from voxmend.llm.common import let_go, one_thread, only, shipped, written
from voxmend.llm.wordkernel import LOWER, Layout, chunks

#: Words whose counts every task holds; counts of the others are joined.
KNOWN_WORDS = 200_000
#: Distinct texts, about (those low in a hash), that the common starting point is fitted on; every training document is learned from after that.
START_DOCS = 1500
START_RATE = 0.01
#: Learning rates of the rounds; each round learns from its share of the documents and ends with one network for all shards.
ROUND_RATES = (0.003, 0.002)
#: Tokens of a shard, about: what one network learns from alone in all rounds; and the most shards, which are larger then.
SHARD_TOKENS = 1 << 20
MAX_SHARDS = 1 << 16
#: Shards whose networks are averaged in one task.
GROUP_SHARDS = 256
#: Counts are told apart in so many steps to a doubling when the most frequent words are looked for.
COUNT_STEPS = 16
#: Symbols that a task gathers before it runs the network over them.
GATHERED = 1 << 20
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?"]] = True


def held_out() -> Column:
    """Whether crc32(doc_id as text) mod 7 is 2. Null doc_id: false."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


#: Bits of a word's key that say its tail class; the others are its hash.
_TAIL = gru.TAIL_CLASSES - 1
#: Words that a task counts at once, and distinct ones that it holds before it passes them on.
COUNTED, HELD = 1 << 20, 1 << 18


def words(data: np.ndarray, off: np.ndarray) -> tuple[Layout, np.ndarray]:
    """Layout and keys of the words of texts laid end to end in lower case: a hash, its lowest bits replaced by the word's
    tail class, which is by the last two bytes before one closing punctuation mark."""
    at = Layout(data, off)
    hashes = at.span(at.prefix(), at.start, at.end).view(np.int64)
    last = at.end - 1
    if len(last):
        last = last - ((last > at.start) & _PUNCTUATION[data[last]])
    two = data[last].astype(np.int64) * 257 + np.where(last > at.start, data[np.maximum(last - 1, 0)], 0)
    return at, (hashes & ~np.int64(_TAIL)) | (two * 40503 % 65537 & _TAIL)


def word_counts(docs: DataFrame) -> DataFrame:
    """hash (a word's key), count of every distinct word in the texts of docs; each task adds up what it can before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[np.ndarray] = []
        keys, n, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def add_up() -> None:
            nonlocal keys, n, fresh, size
            found = np.sort(np.concatenate([*fresh, np.zeros(0, np.int64)]))
            heads = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])[: len(found)])
            more = np.diff(np.append(heads, len(found)))
            found, fresh, size = np.concatenate([keys, found[heads]]), [], 0
            more = np.concatenate([n, more])
            order = np.argsort(found)
            found, more = found[order], more[order]
            heads = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])[: len(found)])
            keys, n = found[heads], np.add.reduceat(more, heads) if len(heads) else more

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["hash", "n"])

        for batch in batches:
            for _, _, data, off in chunks(batch.column("text")):
                fresh.append(words(LOWER[data], off)[1])
                size += len(fresh[-1])
                if size >= COUNTED:
                    add_up()
                    if len(keys) >= HELD:
                        yield passed_on()
                        keys, n = keys[:0], n[:0]
        add_up()
        yield passed_on()

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("count"))


class Vocabulary:
    """What a task needs to know of the counts: the words it holds (sorted by hash) with counts, and the symbols of the most frequent."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tail_mass: np.ndarray, tail_words: np.ndarray, n: int, v: int, ends: int):
        frequent = np.argsort(-counts, kind="stable")[: gru.HEAD - 1]
        self.symbol = np.full(len(hashes), -1, np.int32)
        self.symbol[frequent] = np.arange(1, len(frequent) + 1)
        self.hashes, self.counts = hashes, counts
        self.n, self.v, self.ends = n, v, ends
        # The denominators of words within their tail class, one unknown word included.
        self.tail_log = np.log10(tail_mass + tail_words + 1.0)
        self.log_count = np.log10(counts + 1.0)

        # Where the held words start whose hashes have the same first bits: a word is looked for among those few.
        self.bits = max(1, len(hashes).bit_length() + 1)
        self.first = np.searchsorted((hashes >> (64 - self.bits)) + (1 << (self.bits - 1)), np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, whether held) of each hash."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        slot = (hashes >> (64 - self.bits)) + (1 << (self.bits - 1))
        row, stop = self.first[slot], self.first[slot + 1]
        row = np.minimum(row, len(self.hashes) - 1)
        held = self.hashes[row] == hashes
        open_ = np.flatnonzero(~held & (row + 1 < stop))
        while len(open_):
            row[open_] += 1
            held[open_] = self.hashes[row[open_]] == hashes[open_]
            open_ = open_[~held[open_] & (row[open_] + 1 < stop[open_])]
        return row, held

    def symbols(self, at: Layout, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the texts with END after each, their offsets; and row, held, symbol of each word."""
        row, held = self.find(keys)
        symbol = np.where(held, self.symbol[row] if len(self.symbol) else -1, -1)
        symbol = np.where(symbol >= 0, symbol, gru.HEAD + (keys & _TAIL))
        off = np.concatenate([[0], np.cumsum(at.n_words + 1)])
        out = np.full(off[-1], gru.END, np.int64)
        out[np.arange(len(symbol)) + at.doc] = symbol
        return out, off, row, held, symbol


def vocabulary(counts: DataFrame, ends: int, known: int = KNOWN_WORDS) -> Vocabulary:
    """From counts (hash, count): about the known most frequent words and sums come to the driver, nothing that grows.

    How many words have counts of each size (COUNT_STEPS sizes to a doubling) says from which size on words are taken;
    of that size itself, those low in a hash.
    """
    sized = counts.withColumn("size", F.floor(F.log2("count") * COUNT_STEPS).cast("int"))
    above, least, share = 0, 1 << 30, 1.0
    for r in sized.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.col("size").desc()).collect():
        if above >= known:
            break
        least, share = r["size"], min(1.0, (known - above) / r["n"])
        above += r["n"]
    low = F.shiftrightunsigned(F.xxhash64("hash"), 11).cast("double") / float(1 << 53)
    top = sized.where((F.col("size") > least) | ((F.col("size") == least) & (low < share))).select("hash", "count").toPandas()
    top["tail"] = top["hash"] & _TAIL
    top = top.sort_values(["count", "hash"], ascending=[False, True], kind="stable")
    frequent = top.head(gru.HEAD - 1)
    mass, distinct = (np.zeros(gru.TAIL_CLASSES) for _ in range(2))
    n = v = 0
    for r in counts.groupBy(F.col("hash").bitwiseAND(F.lit(_TAIL)).alias("tail")).agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect():
        mass[r["tail"]], distinct[r["tail"]] = r["n"], r["v"]
        n, v = n + r["n"], v + r["v"]
    for tail, part in frequent.groupby("tail"):
        mass[tail] -= part["count"].sum()
        distinct[tail] -= len(part)
    top = top.sort_values("hash", kind="stable")
    return Vocabulary(top["hash"].to_numpy(np.int64), top["count"].to_numpy(np.float64), mass, distinct, n + ends, v + (ends > 0), ends)


def prepared(rows: DataFrame, found: Vocabulary) -> DataFrame:
    """row, doc_id, held_out, mark (a hash of the text), n_tokens, n_known, base, inside, rare (hashes of words whose counts
    are not held), symbols (little-endian uint16) of rows (doc_id, text, held_out): one scan, no shuffle."""
    vocab = shipped(rows.sparkSession, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        let_go()
        part, nth, v = TaskContext.get().partitionId(), 0, vocab()
        for batch in batches:
            for first, last, data, off in chunks(batch.column("text")):
                at, hashes = words(LOWER[data], off)
                symbols, places, where, held, symbol = v.symbols(at, hashes)
                counted = np.where(held, v.log_count[where] if len(v.log_count) else 0.0, 0.0)
                inside = at.per_text_words(np.where(symbol >= gru.HEAD, counted - v.tail_log[hashes & _TAIL], 0.0))
                base = at.per_text_words(counted) + math.log10(v.ends + 1.0)
                n = last - first
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at.per_text_words(~held))]).astype(np.int32)), pa.array(hashes[~held]))
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * places).astype("<i4")), pa.py_buffer(symbols.astype("<u2"))])
                row = (np.int64(part) << np.int64(40)) + np.arange(nth, nth + n)
                nth += n
                names = [batch.column(c).slice(first, n) for c in ("doc_id", "held_out", "mark")]
                yield pa.RecordBatch.from_arrays([pa.array(row), *names, pa.array(at.n_words + 1), pa.array(at.per_text_words(held) + (v.ends > 0)), pa.array(base), pa.array(inside), rare, raw], ["row", "doc_id", "held_out", "mark", "n_tokens", "n_known", "base", "inside", "rare", "symbols"])

    ready = rows.select("doc_id", "held_out", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    return ready.mapInArrow(run, "row long, doc_id long, held_out boolean, mark long, n_tokens long, n_known long, base double, inside double, rare array<long>, symbols binary")


def symbols_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in column]


def learned(ready: DataFrame, start: gru.Params, rate: float, shards: int) -> gru.Params:
    """The network after one pass over ready (mark, doc_id, symbols): every shard goes on from start over its own documents,
    and the networks are averaged by the symbols they saw.

    A document's shard, and its place in it, follow from hashes of its text and doc_id alone, and sums run in the order of
    shards: the result does not depend on how rows are dealt out. Networks are summed in groups on executors, and the
    driver gets one of a fixed size for each group.
    """
    spark = ready.sparkSession

    def rows_of(shard: int, weights: bytes, seen: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([weights], pa.binary()), pa.array([seen], pa.int64())], ["shard", "weights", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        now, teacher = None, None
        waiting: list[np.ndarray] = []
        size = 0

        def fed(last: bool) -> None:
            nonlocal waiting, size
            rest = teacher.feed(np.concatenate(waiting), last)
            waiting, size = [rest], len(rest)

        for batch in batches:
            for shard, symbols in zip(batch.column("shard").to_pylist(), symbols_of(batch.column("symbols"))):
                if shard != now:
                    if teacher:
                        fed(True)
                        yield rows_of(now, gru.pack(teacher.p), teacher.seen)
                    now, teacher, waiting, size = shard, gru.Trainer(gru.unpack(start_bytes.value), rate), [], 0
                waiting.append(symbols)
                size += len(symbols)
                if size >= GATHERED:
                    fed(False)
        if teacher:
            fed(True)
            yield rows_of(now, gru.pack(teacher.p), teacher.seen)

    def summed(pairs: Iterator[tuple[bytes, str, int]]) -> tuple[np.ndarray, int]:
        total, n = np.zeros(0), 0
        for weights, kind, seen in pairs:
            part = np.frombuffer(weights, kind).astype(np.float64) * (seen if kind == "<f4" else 1)
            total, n = (part if not n else total + part), n + seen
        return total, n

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs = None, []
        for batch in batches:
            for shard, weights, seen in zip(*(batch.column(c).to_pylist() for c in ("shard", "weights", "seen"))):
                group = shard // GROUP_SHARDS
                if group != now and pairs:
                    total, n = summed(pairs)
                    yield rows_of(now, total.tobytes(), n)
                    pairs = []
                now = group
                pairs.append((weights, "<f4", seen))
        if pairs:
            total, n = summed(pairs)
            yield rows_of(now, total.tobytes(), n)

    start_bytes = spark.sparkContext.broadcast(gru.pack(start))
    kinds = "shard int, weights binary, seen long"
    dealt = ready.select(F.pmod(F.xxhash64("mark", F.lit(9)), F.lit(shards)).cast("int").alias("shard"), "mark", "doc_id", "symbols")
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "mark", "doc_id").select("shard", "symbols")
    each = written(dealt.mapInArrow(run, kinds), "networks")
    groups = each.repartition(-(-shards // GROUP_SHARDS), F.floor(F.col("shard") / GROUP_SHARDS)).sortWithinPartitions("shard").mapInArrow(joined, kinds)
    total, n = summed((r["weights"], "<f8", r["seen"]) for r in sorted(groups.collect(), key=lambda r: r["shard"]))
    return gru.unpack((total / n).astype("<f4").tobytes()) if n else start


def trained(ready: DataFrame, tokens: int, texts: int, start_docs: int = START_DOCS) -> gru.Params:
    """The network of ready (mark, doc_id, symbols), which has so many tokens and rows.

    A start is fitted on the distinct texts below a hash bound that start_docs of all would be under; then every row is
    learned from once, in the rounds of ROUND_RATES, by shards whose number depends on tokens alone.
    """
    if not texts:
        return gru.fresh()
    low = F.shiftrightunsigned(F.xxhash64("mark", F.lit(3)), 11).cast("double") / float(1 << 53)
    sample = ready.where(low < start_docs / texts).dropDuplicates(["mark"]).withColumn("doc_id", F.lit(0).cast("long"))
    network = learned(sample, gru.fresh(), START_RATE, 1)
    shards = max(1, min(MAX_SHARDS, -(-tokens // SHARD_TOKENS)))
    turn = F.pmod(F.xxhash64("mark", "doc_id", F.lit(4)), F.lit(len(ROUND_RATES)))
    for k, rate in enumerate(ROUND_RATES):
        network = learned(ready.where(turn == k), network, rate, shards)
    return network


def scores(docs: DataFrame, known: int = KNOWN_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    A-Z are lower-cased; tokens are words (runs of anything but ASCII white space) and one end a document. Learned from
    all documents that are not held out: the count c of every token, N of all, V distinct ones, and the network.
    base_score sums log10((c + 1) / (N + V + 1)). score is the model's log10 probability of the text: a gated recurrent
    network, whose state runs through the whole document, gives a class and, for the most frequent words, the word in
    it; the other words have classes by their ending and, in a class of n tokens and v words, (c + 1) / (n + v + 1).

    Null or empty text: the end only. Repeated rows are scored alike and all learned from. A null doc_id is not held
    out. Without training documents counts are 0, N and V are 0, and the network is the untrained one. An empty table
    gives no rows; extra columns are ignored. Words are told apart by 64-bit hashes. Counts cover the whole corpus in
    a table in the shared folder; tasks hold the counts of about the known most frequent words, and the rest are joined.
    The scores do not depend on how rows are dealt out, but for rounding in the last places.
    """
    spark = docs.sparkSession
    rows = only(docs, doc_id="long", text="string").withColumn("held_out", held_out())
    training = rows.where("not held_out")
    counts = written(word_counts(training), "counts")
    ends = training.count()
    found = vocabulary(counts, ends, known)
    ready = written(prepared(rows, found), "prepared")
    network = spark.sparkContext.broadcast(gru.pack(trained(ready.where("not held_out").select("mark", "doc_id", "symbols"), int(found.n), ends)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        p = gru.unpack(network.value)
        for batch in batches:
            symbols = symbols_of(batch.column("symbols"))
            if not symbols:
                continue
            cuts, size = [0], 0
            for k, x in enumerate(symbols):
                size += len(x)
                if size >= GATHERED:
                    cuts.append(k + 1)
                    size = 0
            for a, b in zip(cuts, [*cuts[1:], len(symbols)]):
                if a < b:
                    off = np.concatenate([[0], np.cumsum([len(x) for x in symbols[a:b]])])
                    net = gru.document_scores(p, np.concatenate(symbols[a:b]), off) / math.log(10)
                    kept = [batch.column(c).slice(a, b - a) for c in names]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(net)], [*names, "net"])

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside"]
    kinds = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double"
    scored = ready.select(*names, "symbols").mapInArrow(run, f"{kinds}, net double")
    rare = ready.where(F.size("rare") > 0).select("row", F.explode("rare").alias("hash")).join(counts.select("hash", "count"), "hash")
    sums = rare.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("count") + 1.0)).alias("rare_log")).withColumnRenamed("row", "of")
    log_all = math.log10(found.n + found.v + 1.0)
    out = scored.join(sums, F.col("row") == F.col("of"), "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(found.n).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("net") + F.col("inside") + rare_log).alias("score"),
    )
