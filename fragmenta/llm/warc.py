"""Web archives: one Zstandard frame a record, under a dictionary that leads each file.

Pages are dealt over tasks; each task writes archives of its own to the shared folder. A file
begins with a skippable frame that holds the dictionary, then a warcinfo record, then one frame
for each record, so any record can be read alone from the index. Payloads that an earlier page
already brought become revisit records without a body. Files count only if the index names
them, so what a lost task left behind is ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.llm._shared import own_hash, shared_folder, text_or_empty, written

#: Skippable frame that holds a file's dictionary (fixed value of the format).
DICTIONARY_FRAME = 0x184D2A5D
#: Bounds of what the dictionary is trained on (records, characters of payload in each), and its size.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 1500, 8192, 65536
#: Payloads below this never become revisits; archives are closed at about this size.
LEAST_PAYLOAD, ARCHIVE_BYTES = 100, 64 << 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "path string, offset long, length long, page_id long, record_type string"


def open_shared(path: str, mode: str):
    """A file of the shared folder, wherever it is; only 'rb' and 'wb'."""
    if "://" not in path or path.startswith("file:"):
        path = path.removeprefix("file://").removeprefix("file:")
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_output_stream(inner) if mode == "wb" else fs.open_input_stream(inner)


def record_id(page_id: int | None) -> str:
    """A UUID (version 8) that holds the page's id; a null id gets a random one."""
    low = page_id & (1 << 64) - 1 if page_id is not None else 0
    head = 0xF7A6 << 48 if page_id is not None else int.from_bytes(os.urandom(6), "big")
    n = head << 64 | (low >> 62) << 66 | 8 << 76 | 2 << 62 | low & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=n)}>"


def page_id_of(ident: str) -> int | None:
    n = uuid.UUID(ident.strip("<>").removeprefix("urn:uuid:")).int
    if n >> 112 != 0xF7A6:
        return None
    low = (n >> 66 & 3) << 62 | n & (1 << 62) - 1
    return low - (1 << 64) if low >> 63 else low


def make_record(kind: str, fields: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(body)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    fields = [("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url:
        fields.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return make_record("response", fields, http + payload)
    return make_record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))], http)


def read_records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, body) of every record of an archive, the dictionary taken from its leading frame."""
    with open_shared(path, "rb") as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{path} does not begin with a dictionary frame")
        data = f.read(size)
        dictionary = zstandard.ZstdCompressionDict(data) if size else None
        stream = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(f, read_across_frames=True, read_size=1 << 18)
        held = b""
        at = 0

        def fill(n: int) -> bool:
            nonlocal held, at
            while len(held) - at < n:
                more = stream.read(max(1 << 18, n))
                if not more:
                    return False
                held, at = held[at:] + more, 0
            return True

        while fill(1):
            while (end := held.find(b"\r\n\r\n", at)) < 0:
                if not fill(len(held) - at + 1):
                    raise ValueError(f"{path} ends within a record's head")
            first, *rest = held[at:end].decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"{path}: no record where one should begin")
            fields = dict(x.split(": ", 1) for x in rest)
            n, head = int(fields["Content-Length"]), end + 4 - at
            if not fill(head + n + 4):
                raise ValueError(f"{path} ends within a record")
            yield fields, held[at + head : at + head + n]
            at += head + n + 4


def train_dictionary(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2020-01-01T00:00:00Z") -> bytes:
    """A dictionary from records of a bounded sample of pages, chosen by a hash of their id; empty if they are too few or too short.

    Ids are chosen first; then only these pages' texts are read, of each a window from anywhere in it. The
    sample only bears on size: whole payloads are stored whatever the dictionary holds.
    """
    html = text_or_empty(html_col)
    ids = pages.where(pages[id_col].isNotNull()).select(pages[id_col].alias("_i")).distinct()
    chosen = [r["_i"] for r in ids.orderBy(F.xxhash64("_i"), "_i").limit(SAMPLE_PAGES).collect()]
    begin = F.pmod(F.xxhash64(id_col, F.lit(6)), F.greatest(F.char_length(html) - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    rows = pages.where(pages[id_col].isin(chosen)).select(pages[id_col].cast("long").alias("i"), F.struct(html.substr(begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("t"), F.col(url_col).alias("u")).alias("s"))
    sample = []
    for r in rows.groupBy("i").agg(F.min("s").alias("s")).where("s.t <> ''").orderBy("i").collect():
        payload = r["s"]["t"].encode()
        sample.append(page_record(r["i"], r["s"]["u"], payload, hashlib.sha256(payload).hexdigest(), None, date))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes() if len(sample) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """The index (INDEX) of archives of all pages, written to ``folder`` in the shared storage.

    Of pages with equal payloads of at least LEAST_PAYLOAD bytes that with the smallest id is a
    response (all its repeated rows are), the others are revisits to it; a null id comes after all
    others and is never referred to. Null html is an empty payload, a null URL leaves its field out.
    Ids are whole numbers; other columns of ``pages`` are not read.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages, id_col, url_col, html_col, date))
    html = text_or_empty(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    first = rows.where(F.octet_length("html") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1 AND first IS NOT NULL").select(own_hash(F.col("digest")).alias("_of"), "first")
    joined = rows.withColumn("_by", own_hash(F.col("digest"))).join(first, F.col("_by") == F.col("_of"), "left")
    refers = F.when(F.col("first").isNull() | F.col("first").eqNullSafe(F.col("page_id")), None).otherwise(F.col("first"))
    whole = joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = dictionary.value
        trained = zstandard.ZstdCompressionDict(lead) if lead else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=trained)
        info = make_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: fragmenta\r\nformat: WARC File Format 1.1\r\n")
        out, path, at = None, "", 0
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, 500):
                    index = []
                    for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns), strict=True):
                        if out is not None and at >= ARCHIVE_BYTES:
                            out = out.close()
                        if out is None:
                            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                            out = open_shared(path, "wb")
                            frame = struct.pack("<II", DICTIONARY_FRAME, len(lead)) + lead + compressor.compress(info)
                            out.write(frame)
                            at = len(frame)
                        frame = compressor.compress(page_record(page_id, url, html.encode(), digest, refers_to, date))
                        out.write(frame)
                        index.append((path, at, len(frame), page_id, "response" if refers_to is None else "revisit"))
                        at += len(frame)
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in index], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["path", "offset", "length", "page_id", "record_type"])
        finally:
            if out is not None:
                out.close()

    return written(whole.mapInArrow(run, INDEX), "warc-index")


def read_record_at(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index: only the dictionary and the record's own frame are read."""
    with open_shared(path, "rb") as f:
        _, size = struct.unpack("<II", f.read(8))
        dictionary = zstandard.ZstdCompressionDict(f.read(size)) if size else None
        f.seek(offset)
        record = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(f.read(length))
    head, _, body = record.partition(b"\r\n\r\n")
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), body[:-4]


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every page record of the archives that ``index`` names: READ, and the payload if asked for (null in revisits).

    A response's length and digest are those of the payload read, and must agree with the fields
    stored beside it; a revisit's come from its fields.
    """
    paths = index.select("path").distinct()
    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * with_payload
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                for fields, body in read_records(path):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = body.partition(b"\r\n\r\n")
                    n = int(head.decode().rpartition("Content-Length: ")[2])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    refers_to = None
                    if kind == "response":
                        if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                    else:
                        payload, refers_to = None, page_id_of(fields["WARC-Refers-To"])
                    rows.append((page_id_of(fields["WARC-Record-ID"]), n, digest, kind, refers_to, fields.get("WARC-Target-URI"), *([payload] if with_payload else [])))
                    size += len(payload or b"") if with_payload else 0
                    if len(rows) == 2000 or size > 8 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    return paths.mapInArrow(run, READ + ", payload binary" * with_payload)
