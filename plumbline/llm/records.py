"""Token-ID output as length-delimited binary records with masked checksums and a separate offset index.

File format (version 1), one file per range of documents::

    record  = length u64 | masked crc32 of the length bytes u32 | payload | masked crc32 of the payload u32 | 0x0A
    payload = doc_id i64 | flags u8 (1: doc_id is null) | width u8 (2 or 4) | token ids, ``width`` bytes each

All integers are little-endian. A checksum is masked by rotating it right by 15 bits and adding a constant, so that a
checksum stored inside checksummed data does no harm. Spark's text sink writes the bytes (its line end is the closing
0x0A), so files appear only when a task commits and a lost executor leaves none behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.pretokens import encoder
from plumbline.llm.shared import kept, shared_folder

#: Fixed value: the addend of masked checksums in the public record format.
MASK_DELTA = 0xA282EAD8
HEAD, LEAD = struct.Struct("<QI"), struct.Struct("<qBB")
CLOSE = b"\n"


class CorruptRecord(ValueError):
    """A frame whose lengths or checksums do not agree."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """One record without its closing byte."""
    payload = LEAD.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def frames(content: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, size, doc_id, ids) of every record of a file; raises CorruptRecord."""
    at, view = 0, memoryview(content)
    while at < len(view):
        if at + HEAD.size > len(view):
            raise CorruptRecord(f"cut head at {at}")
        length, check = HEAD.unpack_from(view, at)
        stop = at + HEAD.size + length + 4
        if masked_crc(view[at : at + 8]) != check or stop >= len(view) or view[stop : stop + 1] != CLOSE:
            raise CorruptRecord(f"length at {at}")
        payload = view[at + HEAD.size : stop - 4]
        if masked_crc(payload) != struct.unpack_from("<I", view, stop - 4)[0]:
            raise CorruptRecord(f"payload at {at}")
        doc_id, null, width = LEAD.unpack_from(payload)
        yield at, stop + 1 - at, None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=LEAD.size)
        at = stop + 1


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, file_bytes: int = 8 << 20) -> None:
    """Write one record per row of ``docs`` (doc_id, text) to ``folder``, files and records in ascending doc_id order.

    A null text is empty, so its record holds only ``end_id``. A null doc_id comes first. Rows with equal doc_ids stand
    side by side in the order of their texts. An empty table writes no records. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    files = max(1, -(-total // file_bytes))

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        width = 4 if end_id >= 1 << 16 else encode.width
        for batch in batches:
            ids = encode.encode(batch.column(1).to_pylist())
            rows = [frame(d, np.concatenate([x, end]), width) for d, x in zip(batch.column(0).to_pylist(), ids)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encoded, "record binary").select(F.col("record").cast("string").alias("value")).write.text(folder)


INDEX = "file string, doc_id long, at long, size long, in_file long, n_tokens long, ids_crc32 long"


def scan_records(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back, check every record and return the offset index: file, byte range and a digest per record."""

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, before = [], 0
                for at, size, doc_id, ids in frames(content.as_buffer()):
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((path.rsplit("/", 1)[-1], doc_id, at, size, before, len(ids), crc))
                    before += len(ids)
                names = [part.split()[0] for part in INDEX.split(", ")]
                kinds = [pa.string()] + [pa.int64()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(index, INDEX)


def with_starts(index: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all records before this one, by sums per file (the numbers in file names give the order)."""
    sums = index.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")  # five digits at least, more from 100,000 files on
    earlier = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return index.join(sums, "file").withColumn("start", F.col("_before") + F.col("in_file")).drop("_before")


def export(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2) -> tuple[str, DataFrame]:
    """Write records and their index; returns the folder and the index as it is read back.

    Records are in ``folder``/records, the index is a Parquet table beside them in ``folder``/index.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-records")
    write_records(docs, f"{folder}/records", tokenizer, end_id)
    index = kept(scan_records(spark, f"{folder}/records"), "records-scan")
    with_starts(index).write.parquet(f"{folder}/index")
    return folder, spark.read.parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(file, at, doc_id, ids) of the records of ``folder``; with ``wanted`` (file, at) only those, found by offset.

    ``wanted`` is any part of the index, for instance a seeded sample for one step of shuffled reading.
    """
    schema = "file string, at long, doc_id long, ids array<long>"

    def some(key, left, right):
        import pandas as pd

        rows = []
        for content in right["content"]:
            view = memoryview(content)
            for at, size in zip(left["at"], left["size"]):
                _, _, doc_id, ids = next(frames(view[at : at + size]))
                rows.append((key[0], at, doc_id, ids.tolist()))
        return pd.DataFrame(rows, columns=["file", "at", "doc_id", "ids"]).astype({"doc_id": "Int64"})

    def every(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = [(path.rsplit("/", 1)[-1], at, d, ids.tolist()) for at, _, d, ids in frames(memoryview(content))]
                yield pd.DataFrame(rows, columns=["file", "at", "doc_id", "ids"]).astype({"doc_id": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/records")
    files = files.select("path", "content")
    if wanted is None:
        return files.mapInPandas(every, schema)
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    return wanted.select("file", "at", "size").groupBy("file").cogroup(files.groupBy("file")).applyInPandas(some, schema)


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """The index in a seeded order for shuffled reading; equal seeds give equal orders."""
    return index.orderBy(F.xxhash64("file", "at", F.lit(seed)), "file", "at")
