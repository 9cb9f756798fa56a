"""Token-id output as length-delimited binary records with an offset index.

File format (little-endian), one record after another:

    u64 payload length | u32 masked checksum of those 8 bytes
    payload            | u32 masked checksum of the payload

A payload is one byte giving the width of an id (2 or 4), then the ids.  The
checksum is zlib's CRC-32, masked by a rotation and an offset so that a
checksum of data that itself holds checksums stays meaningful.  The index is
a Parquet table beside the shards: doc_id, part, shard, offset, length,
n_tokens, start_in_part; a reader can fetch records in any order.

Nulls and edge cases: a null text is an empty one and gives one record with
the end id alone; a null doc_id sorts first; rows that repeat a doc_id are
separate records ordered by text; an empty table writes no shard and an empty
index; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linden.llm.common import chunks, file_system
from linden.llm.wordids import encoder

HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
INDEX = "doc_id {key}, part int, shard string, offset long, length long, n_tokens long, start_in_part long"
#: Fixed values of the masking: rotation by 15 bits and this offset.
MASK_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + TAIL.pack(masked(head)) + payload + TAIL.pack(masked(payload))


def unframe(data: bytes) -> bytes:
    """Payload of one framed record; ValueError if a checksum or length is off."""
    if len(data) < HEAD.size + TAIL.size:
        raise ValueError("record is cut short")
    n, crc = HEAD.unpack_from(data)
    if crc != masked(data[:8]):
        raise ValueError("length checksum does not fit")
    payload = data[HEAD.size:HEAD.size + n]
    if len(data) != HEAD.size + n + TAIL.size or TAIL.unpack_from(data, HEAD.size + n)[0] != masked(payload):
        raise ValueError("payload checksum does not fit")
    return payload


def serialize(ids: np.ndarray) -> bytes:
    narrow = len(ids) == 0 or int(ids.max()) < 1 << 16
    return bytes([2 if narrow else 4]) + ids.astype("<u2" if narrow else "<u4").tobytes()


def deserialize(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


class ShardWriter:
    """Shards of one task.  A shard is written under a name of its own and
    moved into place when complete, so a repeated attempt replaces it whole."""

    def __init__(self, folder: str, part: int, limit: int):
        self.fs, self.root = file_system(folder)
        self.part, self.limit, self.number, self.out = part, limit, 0, None

    @property
    def name(self) -> str:
        return f"ids-{self.part:06d}-{self.number:04d}.rec"

    def add(self, record: bytes) -> tuple[str, int]:
        if self.out is not None and self.offset + len(record) > self.limit:
            self.close()
        if self.out is None:
            self.offset, self.temp = 0, f"{self.root}/_{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temp)
        at = self.offset
        self.out.write(record)
        self.offset += len(record)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.number, self.out = self.number + 1, None


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2,
                  shard_bytes: int = 64 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into record
    shards under ``folder`` and return the written index table."""
    import pyarrow as pa
    from pyspark import TaskContext

    spark = docs.sparkSession
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    index_path = f"{folder}/index"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = encoder(tokenizer), TaskContext.get().partitionId()
        shards, start = ShardWriter(folder, part, shard_bytes), 0
        for batch in batches:
            rows: list[tuple] = []
            for _, _, texts in chunks(batch.column(1)):
                ids, sizes, _, offsets = words.encode(texts)
                for o, n in zip(offsets.tolist(), sizes.tolist(), strict=True):
                    record = frame(serialize(np.append(ids[o:o + n], np.uint32(end_id))))
                    shard, at = shards.add(record)
                    rows.append((part, shard, at, len(record), n + 1, start))
                    start += n + 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                ["doc_id", "part", "shard", "offset", "length", "n_tokens", "start_in_part"])
        shards.close()

    docs = docs.select("doc_id", "text")
    schema = INDEX.format(key=docs.schema["doc_id"].dataType.simpleString())
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text") \
        .mapInArrow(write, schema).write.parquet(index_path)
    return spark.read.schema(schema).parquet(index_path)


def with_starts(index: DataFrame) -> DataFrame:
    """The index plus ``start``: ids in all records before this one.  Parts
    follow doc_id order, so only one sum per part is accumulated in order."""
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = sums.select("part", F.coalesce(F.sum("part_tokens").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    return index.join(before, "part").withColumn("start", F.col("part_start") + F.col("start_in_part"))


def read_records(index: DataFrame, folder: str, read_bytes: int = 8 << 20) -> DataFrame:
    """Every row of ``index`` with its record read back and checked: adds
    ``ids``, the token ids as packed little-endian u32.  Rows may come in any
    order; neighbours in a shard are fetched in one read of ``read_bytes``."""
    import pyarrow as pa

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            found: list[bytes | None] = [None] * batch.num_rows
            want = sorted(zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(),
                              batch.column("length").to_pylist(), range(batch.num_rows), strict=True))
            i, source, opened = 0, None, None
            while i < len(want):
                shard, begin, length, _ = want[i]
                j, end = i + 1, begin + length
                while j < len(want) and want[j][0] == shard and want[j][1] + want[j][2] - begin <= read_bytes:
                    end, j = max(end, want[j][1] + want[j][2]), j + 1
                if opened != shard:
                    source, opened = fs.open_input_file(f"{root}/{shard}"), shard
                data = source.read_at(end - begin, begin)
                for _, at, n, k in want[i:j]:
                    found[k] = deserialize(unframe(data[at - begin:at - begin + n])).tobytes()
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(read, f"{fields}, ids binary")
