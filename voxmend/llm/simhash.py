"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked exactly through pivot distance tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmend.llm.common import let_go, only, written
from voxmend.llm.components import components
from voxmend.llm.wordkernel import LOWER, Layout, chunks

SHINGLE_WORDS = 4
MAX_BITS = 4
#: XXH64's seed for shingles.
SEED = 42
#: A fingerprint is cut into so many blocks; two that differ in at most MAX_BITS bits agree in BLOCKS - MAX_BITS of them.
BLOCKS = 7
PIVOTS = 64
#: About so many members of a key are compared with each other in one task; a key with more is cut into chunks that meet in pairs.
KEY_MEMBERS = 1 << 14
#: One of so many members is looked at to tell which keys have more.
_LOOKED_AT = 16


def shingle_hashes(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of every shingle of the texts laid end to end, data already in lower case, in order."""
    at = Layout(data, off)
    if not len(at.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # The words with one space between: a shingle is then one slice.
    length = at.end - at.start
    to = np.cumsum(length + 1) - (length + 1)
    joined = np.full(int(to[-1] + length[-1]) + 1, 0x20, np.uint8)
    shift = np.repeat(to - at.start, length)
    inside = np.flatnonzero(at.solid)
    joined[inside + shift] = data[inside]
    raw = joined.tobytes()
    # A shingle starts at every word that has n - 1 more behind it in its text, or is the first of a shorter text.
    left = np.repeat(at.word_off[1:], at.n_words) - np.arange(len(to))
    first_word = np.repeat(at.word_off[:-1], at.n_words)
    here = np.flatnonzero((left >= n) | ((first_word == np.arange(len(to))) & (left < n)))
    final = here + np.minimum(left[here], n) - 1
    begin, stop = to[here], to[final] + length[final]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin.tolist(), stop.tolist())), np.uint64, len(here))
    return h, at.doc[here]


def majorities(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the 64 bits (uint64) that are set in more than half of its hashes; doc, rising, says whose a hash is."""
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    heads = np.flatnonzero(np.diff(doc, prepend=-1))
    counts = np.diff(np.append(heads, len(doc)))
    ones = np.zeros((len(heads), 64), np.int64)
    step = 1 << 16  # bits are spread out for so many hashes at a time
    for a in range(0, len(h), step):
        b = min(len(h), a + step)
        bits = np.unpackbits(h[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        i, j = np.searchsorted(heads, a, "right") - 1, np.searchsorted(heads, b, "left")
        cut = np.maximum(heads[i:j], a) - a
        ones[i:j] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > counts[:, None], axis=1)
    out[doc[heads]] = packed.reshape(-1).view(">u8").astype(np.uint64)
    return out


def fingerprints_of(data: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """The SimHash (uint64) of each of the texts laid end to end, data already in lower case."""
    return majorities(*shingle_hashes(data, off, n), len(off) - 1)


def simhash(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id long, fingerprint long (the 64 bits, signed) of every row of docs (doc_id, text); one scan, no shuffle.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a shingle is shingle_words of them joined
    by a space, repeats included, or the whole sequence where there are fewer. A bit is 1 if it is set in more than
    half of the shingles' XXH64 values. Null or empty text, or one without a word: 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, data, off in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(fingerprints_of(LOWER[data], off, shingle_words).view(np.int64))], ["doc_id", "fingerprint"]
                )

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fingerprint long")


def pivots(n: int) -> np.ndarray:
    """The reference fingerprints, the same in every run."""
    return np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, n, dtype=np.uint64)


def forest(values: np.ndarray, max_bits: int, table: np.ndarray | None = None, squares: int | None = None) -> np.ndarray:
    """For each of the values (rows of uint64) the number of the first value that chains of links of max_bits or less lead to.

    table: the values' Hamming distances to reference values, computed once. A pair whose distances differ by more than
    max_bits in any coordinate can't be linked (triangle inequality), so only the other pairs are verified. squares: what
    the squares of a linked pair's differences add up to at most, where the reference values allow such a bound; it is
    asked instead. A value that is in a tree is not compared again: a dense group costs a few passes over it, not all its pairs.
    """
    values = values.reshape(len(values), -1)
    root = np.arange(len(values))
    left = np.arange(len(values))
    while len(left):
        seed, left = left[0], left[1:]
        queue = [seed]
        while queue and len(left):
            v = queue.pop()
            close = left
            if table is not None and squares is not None:
                close = close[squared(table, close, v) <= squares]
            elif table is not None:
                for a in range(0, table.shape[1], 8):  # a few coordinates leave few of the pairs
                    close = close[(np.abs(table[close, a : a + 8] - table[v, a : a + 8]) <= max_bits).all(axis=1)]
                    if len(close) < 64:
                        break
            close = close[apart(values[close], values[v]) <= max_bits]
            if len(close):
                root[close] = seed
                queue.extend(close.tolist())
                left = left[~np.isin(left, close, assume_unique=True)]
    return root


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of uint64."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


#: Rows of a pivot table that are worked on at a time: what that needs besides stays small.
_TABLE_ROWS = 1 << 10


def squared(table: np.ndarray, left: np.ndarray, right: np.ndarray | int) -> np.ndarray:
    """The sums of the squared differences of rows of a pivot table, at places left and right (places, or one for all)."""
    out = np.empty(len(left), np.int32)
    for a in range(0, len(left), _TABLE_ROWS):
        here = slice(a, a + _TABLE_ROWS)
        differ = table[left[here]].astype(np.int32) - table[right[here] if np.ndim(right) else right]
        out[here] = np.einsum("ij,ij->i", differ, differ)
    return out


def distances(values: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The pivot table: each value's Hamming distance to each reference value (uint64, or rows of as many of them)."""
    if values.ndim == 1:
        return np.bitwise_count(values[:, None] ^ reference[None, :]).astype(np.int8)
    out = np.zeros((len(values), len(reference)), np.int16)
    for a in range(0, len(values), _TABLE_ROWS):
        for w in range(values.shape[1]):
            out[a : a + _TABLE_ROWS] += np.bitwise_count(values[a : a + _TABLE_ROWS, None, w] ^ reference[None, :, w])
    return out


def meetings(prints: DataFrame, keyed: Callable[[DataFrame], DataFrame], most: int = KEY_MEMBERS) -> DataFrame:
    """key, pair and the columns of prints, for every key that prints have, sorted by (key, pair) in each partition and dealt
    out so that no group of one (key, pair) is much larger than 2 * most and every two prints with a key in common are in
    a group together (see groups). keyed gives the rows (key, and columns of prints) of all keys of prints.

    Keys with more than about most members, told by every _LOOKED_AT-th print by hash, are cut into chunks by hash; each
    two chunks, and each with itself, are a group. Any cut gives the same pairs, so what the look misses costs no link.
    """
    names = prints.columns
    some = keyed(prints.where(F.pmod(F.xxhash64(*names), F.lit(_LOOKED_AT)) == 0)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * _LOOKED_AT > most)
    hot = written(some.select(F.col("key").alias("hot"), F.ceil(F.col("n") * _LOOKED_AT / F.lit(most)).cast("int").alias("chunks")), "hot-keys")
    marked = keyed(prints).join(hot, F.col("key") == F.col("hot"), "left")
    mine = F.pmod(F.xxhash64(*names, F.lit(1)), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(mine, j) * F.col("chunks") + F.greatest(mine, j))
    dealt = marked.select("key", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(pairs)).alias("pair"), *names)
    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair")


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values, sizes) of runs of whole groups in the sorted rows of meetings: values has the members (rows of uint64), one
    group after the other; groups of one member are left out. What is held is a batch and the group that it ends in."""
    held: list[np.ndarray] = []
    last = None

    def told(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        heads = np.flatnonzero(first)
        size = np.diff(np.append(heads, len(rows)))
        return rows[np.repeat(size > 1, size), 2:].view(np.uint64), size[size > 1]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64, copy=False) for c in ("key", "pair", *names)], axis=1)
        cut = len(rows) - 1  # where the batch's last group starts
        same = (rows[:, :2] == rows[-1, :2]).all(axis=1)
        cut = len(rows) - int(same[::-1].argmin()) if not same.all() else 0
        if cut or (last is not None and (rows[0, :2] != last).any()):
            done = np.concatenate([*held, rows[:cut]])
            held = []
            if len(done):
                yield told(done)
        held.append(rows[cut:])
        last = rows[-1, :2]
    if held:
        yield told(np.concatenate(held))


def block_masks(blocks: int, kept: int) -> list[int]:
    """The bit masks of all choices of kept out of blocks nearly equal blocks of 64 bits."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [sum(x) for x in combinations(one, kept)]


def links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, n_pivots: int = PIVOTS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fingerprint long) that connect exactly those that chains of
    links of max_bits or less connect: from each to the least of its chain under a key, which is mostly the same under
    all keys of a group of near copies.

    Two fingerprints max_bits apart agree in all bits of at least blocks - max_bits of the blocks, so they meet under
    one of the keys made of so many blocks (35 keys of about 27 bits by default, so that unlike fingerprints seldom
    meet). Each key's values (see meetings) go through forest(), where the pivot table discards pairs and the rest are
    verified; it gives at most one edge a value: a group of thousands of near copies yields thousands of edges, not
    millions of pairs.
    """
    reference = pivots(n_pivots)
    masks = block_masks(blocks, blocks - max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).alias("k"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(signed)))

    def keyed(some: DataFrame) -> DataFrame:
        return some.select("fingerprint", F.explode(keys).alias("key")).select(F.xxhash64("key.k", "key.v").alias("key"), "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members, sizes in groups(batches, ["fingerprint"]):
            found = []
            for values in np.split(members[:, 0], np.cumsum(sizes)[:-1]) if len(sizes) else ():
                values = np.unique(values)
                root = forest(values, max_bits, distances(values, reference))
                hung = np.flatnonzero(root != np.arange(len(root)))
                found.append(np.stack([values[hung], values[root[hung]]]).view(np.int64))
            if found:
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return meetings(prints.select("fingerprint"), keyed).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id long, fingerprint string (16 hex digits), component_id long (the smallest doc_id that links reach) of
    every row of docs (doc_id, text).

    Equal fingerprints count as one node with the smallest doc_id; nodes at most max_bits bits apart are linked, and no
    link is lost (see links). Null, empty and wordless texts share fingerprint zero and are linked like any other.
    Repeated rows stay. A null doc_id is kept and never chosen as component_id unless its whole component has none. An
    empty table gives no rows; extra columns are ignored. Fingerprints, edges and labels stay distributed and are cut
    into tables in the shared folder.
    """
    prints = written(simhash(docs, shingle_words), "prints")
    nodes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")), "nodes")
    edges = written(links(nodes.select("fingerprint"), max_bits), "links")
    labels = components(edges)  # node, label
    named = nodes.join(labels, nodes["fingerprint"] == labels["node"], "left").select(
        "fingerprint", "doc_id", F.coalesce("label", "fingerprint").alias("label")
    )
    # Only fingerprints that are linked need their component's smallest doc_id looked up.
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = named.join(smallest, "label").select("fingerprint", "component_id")
    return prints.join(of, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
