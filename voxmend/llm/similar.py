"""Near-duplicates by the Jaccard similarity of word shingles: wide SimHash prints and a pivot table find groups, exact shingle sets
decide in them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmend.llm.common import let_go, only, written
from voxmend.llm.components import components
from voxmend.llm.simhash import apart, distances, forest, groups, majorities, meetings, shingle_hashes, squared
from voxmend.llm.wordkernel import LOWER, chunks

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A print is two SimHashes of a text's shingle set, 128 bits. A bit of sets of Jaccard similarity J differs with a chance
#: of acos(2 J / (1 + J)) / pi: 0.15 at 0.8, so 19 bits of 128, and MOST_BITS or fewer but once in some ten thousand pairs.
PRINT_BITS = 128
MOST_BITS = 36
#: Prints meet under keys of sampled bits: KEYS keys of KEY_BITS bits for up to 2 ** (KEY_BITS + 6) prints. For more prints
#: keys get longer, so that unlike prints seldom meet, and as many more of them are taken as keeps alike ones meeting.
KEY_BITS, KEYS = 16, 160
#: Keys under which groups of near copies are found before all keys are looked at.
FIRST_KEYS = 3
#: Up to so many members of a key all pairs are looked at in one sweep; more go through a spanning forest.
SWEPT = 32
#: Pivots, of PRINT_BITS that are orthogonal to each other.
PIVOTS = 96
#: Shingles of a chunk of a group whose sets are compared in one task, about.
CHUNK_SHINGLES = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _SPREAD
    return x ^ (x >> np.uint64(29))


def sets_of(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each text, rising."""
    h, doc = shingle_hashes(data, off, n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], np.searchsorted(doc[first], np.arange(len(off)))


def prints_of(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The prints (two uint64 a text) of sets of shingles."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    return np.stack([majorities(h, doc, n), majorities(stirred(h ^ _SPREAD), doc, n)], axis=1)


def key_sizes(n_prints: int) -> tuple[int, int]:
    """(bits of a key, number of keys) for so many prints: longer keys for more prints, and more of them by the chance that
    alike prints agree in the further bits."""
    bits = min(PRINT_BITS // 4, max(KEY_BITS, n_prints.bit_length() - 6))
    agree = 1 - math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    return bits, math.ceil(KEYS * agree ** (KEY_BITS - bits))


def keys_of(prints: np.ndarray, bits: int, n_keys: int) -> np.ndarray:
    """The keys (int64, by print and key) of prints: the key's number, then the bits at its places."""
    rng = np.random.Generator(np.random.PCG64(11))
    weights = np.zeros((PRINT_BITS, n_keys))
    for k in range(n_keys):
        weights[rng.choice(PRINT_BITS, bits, replace=False), k] = 2.0 ** np.arange(bits)
    spread = np.unpackbits(np.ascontiguousarray(prints).astype(">u8").view(np.uint8).reshape(len(prints), PRINT_BITS // 8), axis=1)
    return (spread @ weights).astype(np.int64) + (np.arange(n_keys, dtype=np.int64) << bits)[None, :]


def orthogonal_pivots(n: int) -> np.ndarray:
    """n reference prints (rows of two uint64): rows of a Hadamard matrix, so each two differ in just half of the bits."""
    bits = np.bitwise_count(np.arange(n)[:, None] & np.arange(PRINT_BITS)[None, :]) & 1
    return np.packbits(bits.astype(np.uint8), axis=1).view(">u8").astype(np.uint64)


def pairs_within(values: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (left, right) of prints MOST_BITS apart or less, whose chains connect what all such pairs connect inside each of
    the groups of so many prints that lie end to end in values (rows of two uint64).

    Every pair goes through the pivot table first: of two prints d bits apart, the distances to one pivot differ by d at most
    (triangle inequality), and those to orthogonal pivots by differences whose squares add up to PRINT_BITS * d at most
    (Bessel's inequality: half of x - y, in signs, has d squares of 1, each pivot PRINT_BITS). One pivot discards next to
    nothing at MOST_BITS, all together most pairs that are unlike. Only what is left is compared bit by bit.
    """
    table = distances(values, orthogonal_pivots(PIVOTS))
    squares = PRINT_BITS * MOST_BITS
    off = np.concatenate([[0], np.cumsum(size)])
    group = np.repeat(np.arange(len(size)), size)
    swept = size[group] <= SWEPT
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(SWEPT, int(size.max(initial=0)))):
        i = np.flatnonzero((group[d:] == group[:-d]) & swept[d:])
        i = i[squared(table, i, i + d) <= squares]
        i = i[apart(values[i], values[i + d]) <= MOST_BITS]
        left.append(i)
        right.append(i + d)
    for g in np.flatnonzero(size > SWEPT):
        here = slice(off[g], off[g + 1])
        left.append(np.arange(off[g], off[g + 1]))
        right.append(off[g] + forest(values[here], MOST_BITS, table[here], squares))
    return np.concatenate(left), np.concatenate(right)


def edges_under(prints: DataFrame, bits: int, n_keys: int) -> DataFrame:
    """Edges (a, b) between names of prints (p0, p1, name), b < a: under each of so many keys, all prints that chains of prints
    MOST_BITS apart or less connect have their names connected (see pairs_within). Prints of one name need no edge."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(a, 1 << 12)
                found = keys_of(np.stack([part.column(c).to_numpy().view(np.uint64) for c in ("p0", "p1")], axis=1), bits, n_keys)
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, n_keys, dtype=np.int32), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], [*names, "keys"])

    def keyed(some: DataFrame) -> DataFrame:
        return some.mapInArrow(listed, "p0 long, p1 long, name long, keys array<long>").select(F.explode("keys").alias("key"), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, size in groups(batches, names):
            values, name = rows[:, :2], rows[:, 2].view(np.int64)
            least = least_linked(name, *pairs_within(values, size))
            hung = np.flatnonzero(least != name)
            edges = np.unique(np.stack([name[hung], least[hung]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    names = ["p0", "p1", "name"]
    return meetings(prints.select(*names), keyed).mapInArrow(run, "a long, b long").distinct()


def candidates(prints: DataFrame, n_prints: int) -> DataFrame:
    """Edges (a, b) between nodes of prints (node, p0, p1) whose chains connect all prints that meet under a key and are
    MOST_BITS apart or less.

    A few keys come first. What they connect has one name under all the keys after that, so that a group of near copies,
    which meets under most keys, gives about an edge a print and not one a key.
    """
    bits, n_keys = key_sizes(n_prints)
    first = written(components(edges_under(prints.withColumn("name", F.col("node")), bits, FIRST_KEYS)), "first")
    named = written(prints.join(first.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("p0", "p1", F.coalesce("label", "node").alias("name")), "named")
    return first.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(edges_under(named, bits, n_keys))


def least_linked(node: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each place the least of the numbers that links between places lead to."""
    out = node.copy()
    while len(left):
        low = np.minimum(out[left], out[right])
        before = out.copy()
        np.minimum.at(out, left, low)
        np.minimum.at(out, right, low)
        if (out == before).all():
            break
    return out


def node_of(prints: np.ndarray) -> np.ndarray:
    return (stirred(prints[:, 0]) + prints[:, 1]).view(np.int64)


def trees(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the number of the first set that chains of pairs at least so similar lead to. Exact.

    A set's shared shingles with all others not yet in a tree are counted through one index of them, which is made
    again whenever half of its sets are in trees: a dense group costs a few passes, not all its pairs.
    """
    size = np.array([len(s) for s in sets])
    label = np.full(len(sets), -1)

    def indexed(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([sets[i] for i in left])
        order = np.argsort(h, kind="stable")
        return h[order], np.repeat(left, size[left])[order]

    left = np.arange(len(sets))
    h, owner = indexed(left)
    inside = len(left)
    for seed in range(len(sets)):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        queue = [seed]
        while queue:
            v = queue.pop()
            left = left[label[left] < 0]
            if not len(left):
                break
            if 2 * len(left) < inside:
                h, owner = indexed(left)
                inside = len(left)
            a, b = np.searchsorted(h, sets[v], "left"), np.searchsorted(h, sets[v], "right")
            n = b - a
            met = owner[np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            who, shared = np.unique(met[label[met] < 0], return_counts=True)
            # shared / union >= similarity, for 0.8 in whole numbers: 5 * shared >= 4 * union
            close = who[shared >= similarity * (size[v] + size[who] - shared) - 1e-9]
            label[close] = seed
            queue.extend(close.tolist())
    return label


def sketched(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, text_hash, node, p0, p1, n (distinct shingles) of every row; one scan."""
    names = ["doc_id", "text_hash", "node", "p0", "p1", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for first, last, data, off in chunks(batch.column("text")):
                h, at = sets_of(LOWER[data], off, shingle_words)
                found = prints_of(h, at)
                rows = (batch.column(c).slice(first, last - first) for c in ("doc_id", "text_hash"))
                yield pa.RecordBatch.from_arrays([*rows, pa.array(node_of(found)), *(pa.array(x.copy().view(np.int64)) for x in found.T), pa.array(np.diff(at))], names)

    ready = only(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    return ready.mapInArrow(run, "doc_id long, text_hash long, node long, p0 long, p1 long, n long")


def similar_texts(docs: DataFrame, texts: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """Edges (a, b) between text_hashes of texts (text_hash, doc_id of one of its rows, node, p0, p1, n > 0): chains of them
    connect those that chains of texts at least so similar connect, where prints find them."""
    nodes = written(texts.select("node", "p0", "p1").distinct(), "prints")
    labels = components(candidates(nodes, nodes.count()))
    grouped = written(texts.join(labels, "node", "left").select("text_hash", "doc_id", "n", F.coalesce("label", "node").alias("label")), "candidates")
    # A group is cut into chunks by hash, and each two chunks, and each with itself, are compared in a task of their own.
    sizes = grouped.groupBy("label").agg(F.count("*").alias("texts"), F.ceil(F.sum("n") / F.lit(CHUNK_SHINGLES)).cast("int").alias("parts")).where("texts > 1")
    sizes = written(sizes, "sizes")  # joined as a table of its own, so that a label with many texts can be split
    mine = F.pmod(F.xxhash64("text_hash", F.lit(2)), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(mine, j) * F.col("parts") + F.greatest(mine, j))
    wanted = grouped.join(sizes, "label").select("label", "text_hash", F.col("doc_id").alias("of"), F.explode(pairs).alias("pair"))
    named = only(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    same = (named["text_hash"] == wanted["text_hash"]) & named["doc_id"].eqNullSafe(wanted["of"])
    found = named.join(wanted, same).select("label", "pair", wanted["text_hash"], "text")
    members = found.groupBy("label", "pair").agg(F.collect_list(F.struct("text_hash", "text")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                group = batch.column(0)[i].values
                ids, sets = group.field("text_hash").to_numpy(), []
                for _, _, data, off in chunks(group.field("text")):
                    h, at = sets_of(LOWER[data], off, shingle_words)
                    sets += [h[a:b] for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[trees(sets, similarity)])], ["a", "b"])

    return members.select("members").mapInArrow(run, "a long, b long")


def one_of_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Of each group of rows of docs (doc_id, text and more) that chains of similar texts connect exactly one row, with its
    columns: the smallest doc_id's (null last), of those the one with the smallest hash of its text.

    Texts are similar if the sets of their shingles (shingle_words words, A-Z lower-cased, joined by a space, or all words
    where there are fewer) have that Jaccard similarity or more. Null texts and texts without a word are alike. SimHash prints
    meet under keys, a pivot table discards pairs that are too far apart, the prints left are compared; every link then
    is decided on the exact sets; a pair is only missed if no chain of shared keys of their prints joins it (see KEYS).
    Of rows that agree in doc_id and text one stays, whatever their other columns. An empty table stays empty.
    """
    prints = written(sketched(docs, shingle_words), "sketches")
    # One row a text, whichever its copies' doc_ids: groups of exact copies are no larger than other texts from here on.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).alias("first")
    texts = written(prints.groupBy("text_hash").agg(first, *(F.min(c).alias(c) for c in ("node", "p0", "p1", "n"))).select("text_hash", "first", F.col("first.doc_id").alias("doc_id"), "node", "p0", "p1", "n"), "texts")
    labels = components(similar_texts(docs, texts.where("n > 0"), similarity, shingle_words))
    group = F.when(F.col("n") > 0, F.coalesce("label", "text_hash")).otherwise(F.lit(0))
    rows = texts.join(labels, texts["text_hash"] == labels["node"], "left").select("first", "text_hash", (F.col("n") > 0).alias("some"), group.alias("group"))
    best = rows.groupBy("group", "some").agg(F.min(F.struct("first", "text_hash")).alias("best"))
    kept = best.select(F.col("best.first.doc_id").alias("kept_doc_id"), F.col("best.text_hash").alias("kept_hash"))
    named = docs.withColumn("_hash", F.xxhash64(F.col("text").cast("string")))
    same = (named["_hash"] == kept["kept_hash"]) & named["doc_id"].cast("long").eqNullSafe(kept["kept_doc_id"])
    return named.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_hash"]).drop("_hash")
