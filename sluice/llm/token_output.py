"""Token ids in length-delimited binary shards, with an offset index per shard.

Shard (little endian), one frame per document:
    u64 payload length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload
    payload: i64 doc_id | u8 flags (1: the id is NULL) | u8 bytes per id (2 or 4) | ids
Index, 24 bytes per frame: i64 doc_id | u64 byte offset of the frame | u64 tokens of the shard before it.
A checksum is masked as ((crc >> 15 | crc << 17) + 0xa282ead8) mod 2^32, so that a checksum over
data that holds checksums stays useful.

Documents are range-partitioned by doc_id and each task writes its own shards under names no other
attempt has; the manifest lists only the shards of the attempts that counted, so a lost executor leaves
stray files but no double rows.  Files are reached through Arrow's file systems, by the URI of the shared folder.

NULL text is empty (only the end id).  NULL doc_ids come first; rows with equal ids are ordered by text.
"""

from __future__ import annotations

import random
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sluice.llm.base import NO_ID, Sender, id_key, query, rows, table, text_bytes
from sluice.llm.tokens import END_ID, encoded, vocabulary_path, words_of
from sluice.session import scratch_path, stored

# A task starts another shard after so many bytes.
SHARD_BYTES = 256 << 20

_LENGTH, _CRC, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB")
_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("before", "<u8")])
_MANIFEST = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("path", pa.string()), ("records", pa.int64()),
                       ("tokens", pa.int64()), ("bytes", pa.int64())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return length + _CRC.pack(masked(length)) + payload + _CRC.pack(masked(payload))


def read_frame(file) -> bytes | None:
    """The next payload; None at the end.  A wrong checksum or a torn frame raises."""
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != _CRC.unpack(head[8:])[0]:
        raise ValueError("damaged frame length")
    size = _LENGTH.unpack(head[:8])[0]
    body = file.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != _CRC.unpack(body[size:])[0]:
        raise ValueError("damaged frame")
    return body[:size]


def pack(doc_id: int, ids: bytes) -> bytes:
    """Payload of one document; two bytes per id where all ids allow it."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 1 << 16
    head = _HEAD.pack(0 if doc_id == NO_ID else doc_id, doc_id == NO_ID, 2 if narrow else 4)
    return head + (wide.astype("<u2").tobytes() if narrow else ids)


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = _HEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size).astype("<u4")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    local = path.removeprefix("file:")
    return fs.LocalFileSystem(), local


def _writer(folder: str, vocabulary: str, end_id: int, shard_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        system, root = _place(folder)
        system.create_dir(root, recursive=True)
        words = words_of(vocabulary)
        send = Sender(_MANIFEST)
        file, index, offset, tokens, shard, name = None, None, 0, 0, 0, ""
        records = 0

        def close() -> None:
            nonlocal file, shard
            file.close()
            index.close()
            send.add((part, shard, f"{folder}/{name}", records, tokens, offset))
            shard += 1
            file = None

        for doc_id, ids in ((i, ids) for batch in batches for i, ids in
                            zip(batch.column("doc_id").to_pylist(), encoded(words, batch.column("text"), end_id), strict=True)):
            if file is None:
                name = f"part-{part:06d}-{shard:04d}-{uuid.uuid4().hex}"
                file = system.open_output_stream(f"{root}/{name}.bin")
                index = system.open_output_stream(f"{root}/{name}.idx")
                offset = tokens = records = 0
            framed = frame(pack(doc_id, ids))
            index.write(np.array([(doc_id, offset, tokens)], _ENTRY).tobytes())
            file.write(framed)
            offset += len(framed)
            tokens += len(ids) // 4
            records += 1
            if offset >= shard_bytes:
                close()
        if file is not None:
            close()
        yield send.take()

    return write


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order; returns the manifest, a row per shard.

    ``start`` of a shard is the number of ids in the shards before it.
    """
    done = stored(
        docs.select(id_key().alias("doc_id"), text_bytes().alias("text"))
        .repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
        .mapInArrow(_writer(folder, vocabulary or vocabulary_path(), end_id, shard_bytes),
                    "part long, shard long, path string, records long, tokens long, bytes long"))
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard only
    return done.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_shard(path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, tokens of the shard before it, ids) in file order."""
    system, place = _place(path)
    before = 0
    with system.open_input_stream(f"{place}.bin", buffer_size=1 << 20) as file:
        while (payload := read_frame(file)) is not None:
            doc_id, ids = unpack(payload)
            yield doc_id, before, ids
            before += len(ids)


def read_shuffled(path: str, seed: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """The same in an order drawn from ``seed``, by jumps through the offset index."""
    system, place = _place(path)
    with system.open_input_stream(f"{place}.idx") as file:
        index = np.frombuffer(file.read(), _ENTRY)
    order = list(range(len(index)))
    random.Random(seed).shuffle(order)
    with system.open_input_file(f"{place}.bin") as file:
        for i in order:
            file.seek(int(index["offset"][i]))
            doc_id, ids = unpack(read_frame(file))
            yield doc_id, int(index["before"][i]), ids


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    send = Sender(_DIGEST)
    for path, start in rows(batches):
        for doc_id, before, ids in read_shard(path):
            if send.add((doc_id, start + before, len(ids), zlib.crc32(ids.tobytes()))):
                yield send.take()
    yield send.take()


def token_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards."""
    shards = max(1, manifest.count())
    return (manifest.select("path", "start").repartition(shards, "path")
            .mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long"))


@query("op10_token_output")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens")))
