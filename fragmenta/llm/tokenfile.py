"""Token archives: frequency-ranked ids in byte-aligned codes with separate control bytes.

Texts are range-partitioned by document id and encoded once; their ids go to a table in the
shared folder. Counts over all of it rank the vocabulary, the most frequent id first, and a
second map over that table writes the archives: each rank as one to four bytes, the lengths as
two bits each in control bytes of their own. A reader looks a control byte up in a table and
gathers four ranks' bytes at once with numpy.

An archive is: MAGIC, vocabulary size, its ranked ids, then blocks. A block is: documents,
tokens, data bytes (three u32), document ids (i64, and a byte each that marks nulls), token
counts (u32), control bytes, data bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmenta.llm import subwords
from fragmenta.llm._shared import removed, shared_folder, written
from fragmenta.llm.warc import open_shared

MAGIC = b"FRTK0001"
#: Appended to each document; tokens of a block (one longer document is a block of its own), bytes of an archive.
END, BLOCK_TOKENS, ARCHIVE_BYTES = 2, 1 << 17, 64 << 20

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1  # of the four codes of a control byte


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of numbers below 2**32."""
    v = values.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    if not len(v) or size.max() <= 2:  # the usual case: no id needs a third byte
        raw = v.astype("<u2").view(np.uint8).reshape(-1, 2)
    else:
        raw = v.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(raw.shape[1]) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n numbers of a block."""
    size = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_sorted(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, seq, id, n, ids) in the shared folder: part and seq ascend with the document id, nulls first.

    ``ids`` are little-endian 16-bit (32-bit for vocabularies over 65,536) with END appended. Null and
    empty texts are END alone. Document ids are whole numbers; rows that share one, or have none, may be
    dealt over several parts, in the order of their texts' hashes, then texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("by"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            blobs, counts = [], []
            for _, ids, bounds in subwords.encode_column(batch.column(1), tokenizer, added=True):
                end = np.array([END], ids.dtype).tobytes()
                blobs += [ids[a:b].tobytes() + end for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                counts.append(np.diff(bounds) + 1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), batch.column(0), pa.array(np.concatenate([*counts, np.zeros(0, np.int64)])), pa.array(blobs, pa.binary())], ["part", "seq", "id", "n", "ids"])
            seq += n

    dealt = rows.repartitionByRange("id", "by").sortWithinPartitions("id", "by", "text").select("id", "text")
    return written(dealt.mapInArrow(run, "part int, seq long, id long, n long, ids binary"), "token-ids", "zstd")


def _width(tokenizer: str) -> type:
    return subwords.encoder(tokenizer).ids.dtype.type


def count_ids(encoded: DataFrame, size: int, dtype: type) -> np.ndarray:
    """How often each id of the vocabulary stands in all documents; one row for each id and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).slice(k, 200).to_pylist()), dtype), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["token", "n"])

    out = np.zeros(size, np.int64)
    for r in encoded.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r["token"]] = r["n"]
    return out


def write_archives(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Archives of all documents in ascending order of ids: (path, docs, tokens, bytes, base) of each.

    ``base`` is the number of ids in all archives before. Only files that this table names count.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    dtype = _width(tokenizer)
    encoded = encode_sorted(docs, tokenizer, id_col, text_col)
    size = subwords.encoder(tokenizer).size
    counts = count_ids(encoded, size, dtype)
    ranked = np.argsort(-counts, kind="stable").astype("<u4")  # ties: the smaller id first
    sent = spark.sparkContext.broadcast(ranked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = sent.value
        rank = np.empty(len(ranked), np.uint32)
        rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
        made: list[tuple] = []
        out, state = None, None
        held: list[tuple] = []

        def flush() -> None:
            if not held:
                return
            ids = np.frombuffer(b"".join(x[2] for x in held), dtype)
            control, data = pack(rank[ids])
            block = struct.pack("<III", len(held), len(ids), len(data))
            block += np.array([x[0] if x[0] is not None else 0 for x in held], "<i8").tobytes() + bytes(x[0] is None for x in held)
            block += np.array([x[1] for x in held], "<u4").tobytes() + control + data
            out.write(block)
            state["docs"] += len(held)
            state["tokens"] += len(ids)
            state["bytes"] += len(block)
            held.clear()

        def close() -> None:
            nonlocal out
            if out is not None:
                flush()
                out.close()
                made.append(tuple(state.values()))
                out = None

        try:
            size = 0
            for batch in batches:
                for part, seq, ident, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is not None and (state["part"] != part or state["bytes"] >= ARCHIVE_BYTES):
                        close()
                        size = 0
                    if out is None:
                        path = f"{folder}/{part:06d}-{seq:012d}-{uuid.uuid4().hex}.frtk"
                        out = open_shared(path, "wb")
                        head = MAGIC + struct.pack("<I", len(ranked)) + ranked.tobytes()
                        out.write(head)
                        state = {"part": part, "seq": seq, "path": path, "docs": 0, "tokens": 0, "bytes": len(head)}
                    if held and size + n > BLOCK_TOKENS:
                        flush()
                        size = 0
                    held.append((ident, n, ids))
                    size += n
            close()
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["part", "seq", "path", "docs", "tokens", "bytes"])

    listed = written(encoded.mapInArrow(run, "part int, seq long, path string, docs long, tokens long, bytes long"), "token-archives")
    removed(encoded)
    files = sorted(listed.collect(), key=lambda r: (r.part, r.seq))  # one row a file
    removed(listed)
    base = np.cumsum([0, *(r.tokens for r in files)])
    return spark.createDataFrame([(r.path, r.docs, r.tokens, r.bytes, int(b)) for r, b in zip(files, base, strict=False)], "path string, docs long, tokens long, bytes long, base long")


def read_blocks(path: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, token counts, ids) of each block of an archive."""
    with open_shared(path, "rb") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token archive")
        ranked = np.frombuffer(f.read(4 * struct.unpack("<I", f.read(4))[0]), "<u4")
        while head := f.read(12):
            docs, tokens, size = struct.unpack("<III", head)
            ids = np.frombuffer(f.read(8 * docs), "<i8")
            null = np.frombuffer(f.read(docs), np.uint8)
            counts = np.frombuffer(f.read(4 * docs), "<u4").astype(np.int64)
            control = np.frombuffer(f.read(-(-tokens // 4)), np.uint8)
            data = np.frombuffer(f.read(size), np.uint8)
            if len(data) != size:
                raise ValueError(f"{path} ends within a block")
            yield [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)], counts, ranked[unpack(control, data, tokens)]


def read_archives(archives: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for docs, counts, ids in read_blocks(path):
                    end = np.cumsum(counts)
                    raw = ids.tobytes()
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((end - counts).tolist(), end.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at + end - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    at += int(end[-1])

    dealt = archives.select("path", "base").repartition(max(1, archives.count()))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
