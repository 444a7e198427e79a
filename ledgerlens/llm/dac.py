"""Token store of directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level k holds the k-th chunk
of every id that has one, and a bitmap says which ids go on to the next
level. The place of an id on the next level is the number of ones before it;
a directory of counts every 512 bits makes that a constant-time rank. Any id
is read from its chunks alone; no block is decoded.

Layout of one shard (little endian): magic ``DAC1``, u32 levels, u64 ids,
then per level: u64 size, the chunks, the bitmap bytes (lowest bit first), the
directory as u32. The store is a Parquet table in the shared folder with one
row per shard: its place in the order, the ids and sizes of its documents,
and the shard's bytes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import chunk_encoder, id_texts, offsets_of, read_text, shared_path, text_slices, written

MAGIC, RANK_BITS = b"DAC1", 512


def dac_encode(ids: np.ndarray) -> bytes:
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, dtype=np.int64)
        levels.append(struct.pack("<Q", len(rest)) + rest.astype(np.uint8).tobytes() + bitmap.tobytes() + offsets_of(blocks)[:-1].astype("<u4").tobytes())
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return MAGIC + struct.pack("<IQ", len(levels), len(ids)) + b"".join(levels)


class DacReader:
    """Random access to the ids of one shard."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC shard")
        n_levels, self.n = struct.unpack_from("<IQ", data, 4)
        at, self.levels = 16, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += len(bitmap)
            directory = np.frombuffer(data, "<u4", -(-n // RANK_BITS), at)
            at += directory.nbytes
            self.levels.append((chunks, bitmap, directory))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            before = np.unpackbits(bitmap[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i = int(directory[block]) + int(before.sum())
        return value

    def span(self, start: int, length: int) -> np.ndarray:
        """Ids start .. start + length, level by level; only their own chunks are read."""
        out = np.zeros(length, dtype=np.uint32)
        at = np.arange(length)
        lo, n = start, length
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            if not n:
                break
            out[at] |= chunks[lo : lo + n].astype(np.uint32) << np.uint32(8 * k)
            block = lo // RANK_BITS
            bits = np.unpackbits(bitmap[block * RANK_BITS // 8 : (lo + n - 1) // 8 + 1], bitorder="little")
            skip = lo - block * RANK_BITS
            more = bits[skip : skip + n].astype(bool)
            lo = int(directory[block]) + int(bits[:skip].sum())
            at = at[more]
            n = len(at)
        return out


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 20) -> None:
    """Tokenize every whole text and write the store in ascending ``id_col`` order.

    Null ids come first; documents with one id are in text order. A null text
    is empty (the end id alone). Range partitions follow each other, and each
    is streamed into shards of about ``shard_ids`` ids cut at document ends, so
    memory is bounded by a shard or by one document.
    """
    vocabulary = read_text(tokenizer)
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("shard", T.IntegerType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("docs", T.ArrayType(kind)),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("codes", T.BinaryType()),
        ]
    )

    end = end_id.to_bytes(4, "little")

    def shards(batches):
        encoder = chunk_encoder(vocabulary, spaced=True)
        part, number = TaskContext.get().partitionId(), 0
        rows, sizes, ids, held, id_type = [], [], [], 0, pa.int64()

        def flush():
            all_ids = np.frombuffer(b"".join(ids), "<u4")
            values = [[part], [number], [len(all_ids)], [rows], [sizes], [dac_encode(all_ids)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=schema.names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for some, texts in text_slices(*id_texts(batch), 2_000_000):
                got = [raw + end for raw in encoder.encode_all(texts)]
                rows, sizes, held = rows + some, sizes + [len(x) // 4 for x in got], held + sum(map(len, got)) // 4
                ids += got
                if held >= shard_ids:
                    yield flush()
                    number += 1
                    rows, sizes, ids, held = [], [], [], 0
        if rows:
            yield flush()

    ordered = docs.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    ordered.mapInArrow(shards, schema).write.option("compression", "none").parquet(path)


def store_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType.fromDDL(f"part int, shard int, n_ids bigint, docs array<{id_type.simpleString()}>, sizes array<bigint>, codes binary")


def shard_starts(store: DataFrame) -> DataFrame:
    """(part, shard, first): ids of the whole store before each shard.

    Running sums in two steps: over the parts (one row each), and within a part.
    """
    sizes = store.select("part", "shard", "n_ids")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("inside")).alias("first"))


def read_store(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """Documents of a store: (doc_id, start, n_tokens, ids) with ids as little-endian u32 bytes.

    The shards' starts (one narrow row each) are written first, so that the planner
    knows their size and sends them to the codes; the codes are not shuffled.
    """
    id_type = id_type or T.LongType()
    store = spark.read.schema(store_schema(id_type)).parquet(path)
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def documents(batches):
        for batch in batches:
            kind = batch.schema.field("docs").type.value_type
            for row in batch.to_pylist():
                reader, at = DacReader(row["codes"]), offsets_of(np.array(row["sizes"], dtype=np.int64))
                whole = reader.span(0, len(reader)).astype("<u4").tobytes()
                raw = [whole[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["docs"], kind), pa.array(row["first"] + at[:-1]), pa.array(row["sizes"], pa.int64()), pa.array(raw, pa.binary())], names=schema.names
                )

    starts = written(shard_starts(store), "token-starts")
    return store.drop("n_ids").join(starts, ["part", "shard"]).mapInArrow(documents, schema)


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """(position, id) for a table of global ``position``s: each is read directly from its shard's codes.

    Positions outside the store and null positions have no row; a repeated
    position is answered once per row.
    """
    store = spark.read.schema(store_schema(id_type or T.LongType())).parquet(path)
    spans = store.select("part", "shard", "n_ids").join(shard_starts(store), ["part", "shard"])
    step = F.lit(1 << 20)
    spans = spans.withColumn("step", F.explode(F.sequence(F.floor(F.col("first") / step), F.floor((F.col("first") + F.col("n_ids") - 1) / step))))
    wanted = (
        positions.select(F.col("position").cast("long").alias("position"))
        .withColumn("step", F.floor(F.col("position") / step))
        .join(spans, "step")
        .where((F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n_ids")))
        .select("part", "shard", "position", (F.col("position") - F.col("first")).alias("inside"))
    )

    def lookup(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict(
                {"position": pa.array([r["position"] for r in rows], pa.int64()), "id": pa.array([DacReader(r["codes"])[r["inside"]] for r in rows], pa.int64())}
            )

    return wanted.join(store.select("part", "shard", "codes"), ["part", "shard"]).mapInArrow(lookup, "position long, id long")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store to the shared folder and read its documents back."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_store(docs, tokenizer, end_id, path, id_col, text_col)
    return read_store(spark, path, docs.schema[id_col].dataType)
