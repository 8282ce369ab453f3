"""Token ids in binary files of directly addressable codes.

A segment holds the ids of some whole documents in a row. Ids are split into chunks of 8 bits, lowest first. Level 0 has
the first chunk of every id, and a bit for each that says whether the id goes on; level k + 1 has the next chunk of those
that go on at level k, in order. Beside each bitmap stands a rank directory: the ones before every 512 bits. The place of
an id's next chunk is the rank of its bit, so any id is found without decoding another one.

Bytes of a segment (little endian): b"DAC1"; uint32 documents, uint32 levels, uint64 ids; int64 doc_id of each document
(with a byte before each: 1 if the doc_id is null); uint64 end of each document's ids; then for each level uint64 chunks,
the chunks (uint8), the bitmap (a bit a chunk, low bits first, padded to 64 bytes), the directory (uint32 a 64 bytes).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmend.llm.common import give_back, only, own_folder
from voxmend.llm.tokens import definition, encoder

MAGIC = b"DAC1"
DIRECTORY_BITS = 512
#: A segment is closed after the document that brings it to so many ids.
SEGMENT_IDS = 1 << 18
SEGMENTS = "part int, segment int, first long, last long, n_docs long, n_ids long, data binary"
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "1"}


def pack(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of documents whose ids end at ends in ids (uint32)."""
    levels = []
    rest = ids.astype(np.uint32)
    while len(rest) or not levels:
        on = rest >= 256
        bitmap = np.zeros(-(-len(rest) // DIRECTORY_BITS) * DIRECTORY_BITS // 8, np.uint8)
        bits = np.packbits(on, bitorder="little")
        bitmap[: len(bits)] = bits
        ones = np.bitwise_count(bitmap).reshape(-1, DIRECTORY_BITS // 8).sum(axis=1, dtype=np.uint32)
        directory = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = rest[on] >> 8
        if not len(rest):
            break
    nulls = np.array([x is None for x in doc_ids], np.uint8).tobytes()
    numbers = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    return b"".join([MAGIC, struct.pack("<IIQ", len(doc_ids), len(levels), len(ids)), nulls, numbers, np.asarray(ends, "<u8").tobytes(), *levels])


class Segment:
    """Random access to a packed segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n_docs, n_levels, self.n_ids = struct.unpack_from("<IIQ", data, 4)
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        nulls = take("u1", n_docs)
        self.doc_ids = [None if none else int(x) for none, x in zip(nulls, take("<i8", n_docs))]
        self.ends = take("<u8", n_docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // DIRECTORY_BITS)
            self.levels.append((take("u1", n), take("u1", blocks * DIRECTORY_BITS // 8), take("<u4", blocks)))

    @staticmethod
    def rank(bitmap: np.ndarray, directory: np.ndarray, i: int) -> int:
        """The ones before bit i."""
        block = i // DIRECTORY_BITS
        if block == len(directory):
            return int(directory[-1]) + int(np.bitwise_count(bitmap[(block - 1) * DIRECTORY_BITS // 8 :]).sum()) if block else 0
        byte = i // 8
        ones = int(directory[block]) + int(np.bitwise_count(bitmap[block * DIRECTORY_BITS // 8 : byte]).sum(dtype=np.int64))
        return ones + (int(bitmap[byte]) & ((1 << (i % 8)) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        """The id at place i of the segment."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * k)
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i = self.rank(bitmap, directory, i)
        return out

    def slice(self, first: int, last: int) -> np.ndarray:
        """The ids at places first to last - 1 (uint32), from the chunks of just these ids."""
        out = np.zeros(max(0, last - first), np.uint32)
        who = np.arange(len(out))
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            if first >= last:
                break
            out[who] |= chunks[first:last].astype(np.uint32) << np.uint32(8 * k)
            byte = first // 8
            on = np.unpackbits(bitmap[byte : -(-last // 8)], bitorder="little")[first - 8 * byte : last - 8 * byte].astype(bool)
            who = who[on]
            first = self.rank(bitmap, directory, first)
            last = first + len(who)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def read(self) -> tuple[np.ndarray, list[int], np.ndarray]:
        """(where each document starts, the checksum of its ids, all ids)."""
        begin = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)[: len(self.ends)]
        ids = self.slice(0, self.n_ids).astype("<u4")
        data = memoryview(ids).cast("B")
        return begin, [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), self.ends.tolist())], ids


def write_codes(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """The table of segments of docs (doc_id, text), in ascending doc_id: part int, segment int (in order within a part),
    part_first long (the ids of all parts before it), first long (the place of its first id among all), n_docs, n_ids
    long, data binary.

    Texts are dealt by ranges of doc_id, so parts are in order; each task writes its part's segments, and Spark's own
    committed writer keeps the table at path, or in the shared folder. Only one row a part is summed in one place.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(definition(tokenizer_path))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    # Rows of one doc_id are told apart by a hash of the text, so that many of them fill more than one part.
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark").asc()]
    marked = only(docs, doc_id="long", text="string").withColumn("mark", F.xxhash64("text"))
    sorted_docs = marked.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        part, tok = TaskContext.get().partitionId(), encoder(model.value)
        names, ends, ids, size, segment, before = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal names, ends, ids, size, segment, before
            data = pack(names, np.concatenate(ends), np.concatenate(ids))
            row = [[part], [segment], [before], [before + size], [len(names)], [size], [data]]
            segment, before = segment + 1, before + size
            names, ends, ids, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()))], ["part", "segment", "first", "last", "n_docs", "n_ids", "data"])

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, last, found, stops in tok.runs(batch.column("text"), end_id):
                k, done = 0, 0
                while k < last - first:
                    # Up to the document that fills the segment, or to the run's end.
                    to = min(last - first, int(np.searchsorted(stops, done + segment_ids - size)) + 1)
                    names += doc_ids[first + k : first + to]
                    ends.append(stops[k:to] - done + size)
                    ids.append(found[done : stops[to - 1]])
                    size += int(stops[to - 1]) - done
                    k, done = to, int(stops[to - 1])
                    if size >= segment_ids:
                        yield close()
        if names:
            yield close()

    made = sorted_docs.mapInArrow(run, SEGMENTS)
    path = path or f"{own_folder(spark)}/codes-{uuid.uuid4().hex}"
    # Plain pages of one segment each: a segment is read as it was written, without its neighbours.
    made.write.options(**PLAIN).parquet(f"{path}/segments")
    parts = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_first"), "n")
    upto.coalesce(1).write.parquet(f"{path}/parts")
    return open_codes(spark, path)


def open_codes(spark: SparkSession, path: str) -> DataFrame:
    """The segments that write_codes left at path: its columns, joined to the index of parts (one row a part)."""
    segments, parts = spark.read.schema(SEGMENTS).parquet(f"{path}/segments"), spark.read.parquet(f"{path}/parts")
    met = segments.join(F.broadcast(parts.select("part", "part_first")), "part")
    return met.select("part", "segment", "part_first", (F.col("first") + F.col("part_first")).alias("first"), "n_docs", "n_ids", "data")


def token_at(spark: SparkSession, path: str, place: int) -> int:
    """The id at a place among all ids of the codes at path. The index of parts names the part, and the scan's own filters
    on (part, first) leave one segment's page; nothing of it is decoded but this id."""
    part = spark.read.parquet(f"{path}/parts").where((F.col("part_first") <= place) & (F.col("part_first") + F.col("n") > place)).first()
    if part is None:
        raise IndexError(place)
    inside = place - part["part_first"]
    rows = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").where((F.col("part") == part["part"]) & (F.col("first") <= inside) & (F.col("last") > inside))
    row = rows.select("first", "data").first()
    return Segment(row["data"])[inside - row["first"]]


def read_codes(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (array) of every document in the segments; see digests() for less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, first in zip(batch.column("data"), batch.column("first").to_pylist()):
                seg = Segment(data.as_py())
                begin, crc, ids = seg.read()
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, seg.n_ids).astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(seg.doc_ids, pa.int64()), pa.array(begin + first), pa.array(seg.ends - begin), pa.array(crc, pa.int64()), lists], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return segments.select("first", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def digests(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 of every document, read back from the written segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, first in zip(batch.column("data"), batch.column("first").to_pylist()):
                seg = Segment(data.as_py())
                begin, crc, _ = seg.read()
                yield pa.RecordBatch.from_arrays([pa.array(seg.doc_ids, pa.int64()), pa.array(begin + first), pa.array(seg.ends - begin), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("first", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of docs, by way of the written segments.

    A null or empty text has the end id only. Repeated doc_ids are ordered by a hash of the text and each keeps its row; null doc_ids
    come first. Extra columns are ignored. An empty table gives no rows. Memory: a segment of about 2**18 ids, or one
    document with as many as it has.
    """
    return digests(write_codes(docs, tokenizer_path, end_id))
