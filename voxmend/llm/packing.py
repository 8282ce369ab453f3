"""Best-fit decreasing packing of documents into sequences, planned once for all documents over lengths.

Best-fit decreasing looks at nothing but lengths, and equal lengths are interchangeable. So the plan is made from the
number of pieces of each length (at most the capacity's many numbers, whatever the corpus's size), with a segment tree
over remaining capacities that finds the tightest open bin in logarithmic time. Bins of one remaining capacity are kept
as ranges of sequence numbers, so a run of equal pieces is placed in one step. Every piece then looks its place up by its
length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmend.llm.common import give_back, only, written
from voxmend.llm.tokens import definition, encoder

CAPACITY = 4096


class OpenBins:
    """Ranges of open bins by remaining capacity, under a segment tree: a node is set if a capacity below it has bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def mark(self, room: int) -> None:
        node = self.leaves + room
        self.some[node] = bool(self.ranges[room])
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] | self.some[2 * node + 1]

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.ranges[room].append((first, n))
            if len(self.ranges[room]) == 1:
                self.mark(room)

    def take(self, room: int) -> tuple[int, int]:
        out = self.ranges[room].pop()
        if not self.ranges[room]:
            self.mark(room)
        return out

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity, of length or more, that an open bin has."""
        node = self.leaves + length
        if self.some[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Rows length, rank, n, sequence, offset: the pieces of that length with ranks rank to rank + n - 1 lie at offset in
    the n sequences from sequence on. Rows are in order of (length, rank)."""
    bins, rows, made = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit into {capacity}")
        while done < total:
            room = bins.tightest(length)
            if room is None:
                room, first, n, new = capacity, made, total - done, True
            else:
                (first, n), new = bins.take(room), False
            each = room // length  # a bin stays the tightest until none more fits
            full, rest = min(n, (total - done) // each), 0
            for layer in range(each if full else 0):
                rows.append((length, done, full, first, capacity - room + layer * length))
                done += full
            if full < n and done < total:
                rest = total - done if total - done < each else 0
                for layer in range(rest):
                    rows.append((length, done, 1, first + full, capacity - room + layer * length))
                    done += 1
            used = full + bool(rest)
            bins.put(room - each * length, first, full)
            if rest:
                bins.put(room - rest * length, first + full, 1)
            if new:
                made += used
            else:
                bins.put(room, first + used, n - used)
    rows.sort(key=lambda r: (r[0], r[1]))
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "n", "sequence", "offset"), columns))


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece int, start, length, ids_crc32 long of the pieces of docs (doc_id, text), with part int and nth long: the
    piece's rank among those of its length in the part. with_ids adds ids binary (little-endian uint32). One scan, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(definition(tokenizer_path))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        part, tok = TaskContext.get().partitionId(), encoder(model.value)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, last, ids, ends in tok.runs(batch.column("text"), end_id):
                begin = np.concatenate([[0], ends[:-1]])
                n = -(-(ends - begin) // capacity)
                doc = np.repeat(np.arange(last - first), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(ends[doc] - begin[doc] - start, capacity)
                # The rank of each piece among those of its length in this part.
                order = np.argsort(length, kind="stable")
                heads = np.flatnonzero(np.diff(length[order], prepend=-1))
                size = np.diff(np.append(heads, len(order)))
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.repeat(heads, size) + np.repeat(seen[length[order][heads]], size)
                seen[length[order][heads]] += size
                data = memoryview(ids.astype("<u4")).cast("B")
                spans = [data[4 * a : 4 * b] for a, b in zip((begin[doc] + start).tolist(), (begin[doc] + start + length).tolist())]
                made = [batch.column("doc_id").take(pa.array(first + doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(map(zlib.crc32, spans), pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays([*made, *[pa.array(map(bytes, spans), pa.binary())] * with_ids], names)

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids)


def packed(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (and its ids).

    Null or empty text: the end id only, a piece of length 1. Only a document longer than capacity is cut. Repeated rows
    are packed each for itself. A null doc_id stays null. An empty table gives no rows; extra columns are ignored. The
    driver gets one count for each length (capacity of them at most); pieces get their global rank from counts per part
    and length, so pieces of one length are never ranked in one task.
    """
    spark = docs.sparkSession
    pieces = written(cut(docs, tokenizer_path, end_id, capacity, with_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upto = counts.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))
    places = spark.sparkContext.broadcast(plan({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity))
    ranked = pieces.join(upto, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).withColumn("rank", F.col("before") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        first_row = np.searchsorted(at["length"], np.arange(capacity + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.zeros(len(length), np.int64)
            for one in np.unique(length):
                here, a, b = length == one, first_row[one], first_row[one + 1]
                row[here] = a + np.searchsorted(at["rank"][a:b], rank[here], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in names), pa.array(at["sequence"][row] + rank - at["rank"][row]), pa.array(at["offset"][row])], [*names, "sequence_id", "offset"]
            )

    return ranked.select(*names, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids binary (little-endian uint32) of packed pieces with their ids: one row a sequence, of
    capacity ids at most."""
    parts = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"])).alias("ids"))
