"""Scores of texts by a small causal self-attention model on subword ids, and by a word unigram.

One pass encodes all texts and counts, over the training documents, words, pairs of ids and what
follows which context; the ids, from which byte-level BPE gives the text back without loss, are
kept in the shared folder. The attention model begins with the corpus' counts and learns on the
executors from all windows of all training documents, in two passes: some windows of each
document, then all others. In a pass each task goes on for itself from the same weights; their
mean is the model. A last pass over the ids scores each token once, in overlapping windows with
batched masked attention, and looks counts up.

A text is scored in segments. A place begins a segment where a hash of the ORDER ids before it
says so; a segment reaches to the next one. The model of a segment mixes the attention's
probability with what followed the same context in other training documents: with c of C times
the same segment, (c + p) / (C + 1). A document's own occurrences don't count for itself. So what
the corpus repeats is likely, and what the score draws from grows with the corpus.

Counts grow with the corpus, so they live in hash buckets whose number follows the size of the
texts. Those of the most frequent words, pairs, segments and contexts go to all workers; the others'
occurrences are dealt by bucket, meet their counts there, and come back as sums for a document.
No count is left out: rare pairs are met first, for a segment's probability rests on them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.llm import _text, attention, subwords
from fragmenta.llm._shared import heap_kept, removed, scratch, written

#: The first descent takes every so many-th window of each training document, and one at least; the second takes all others.
ONE_OF = 64
#: Steps' sizes in the first descent and in the second.
RATE, SECOND_RATE = 0.01, 0.003
#: Most words, and most segments and contexts of each, that are sent to all workers.
MOST_WORDS, MOST_SEGMENTS = 1 << 18, 1 << 17
#: Ids of a context, and bits of its hash that are zero where a segment begins.
ORDER, SPARSE = 8, 5
#: The word hash that stands for a document's end.
END_WORD = np.uint64(0x5EED0E0D5EED0E0D)
#: Bytes of text for each bucket.
BUCKET_BYTES = 12 << 20
#: What is counted: words by hash, pairs of ids by key, segments by hash of context and segment, contexts by hash. Segments whose pairs are not all known yet are of a kind of their own.
KINDS = WORDS, PAIRS, SEGMENTS, CONTEXTS = 0, 1, 2, 3
WAITING = 4
#: The number of a segment that stands for a place before all segments of its text.
NO_SEGMENT = np.uint32(0xFFFFFFFF)

U = np.uint64


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


def segments_of(targets: np.ndarray, bounds: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end, context, segment with its context) of the segments of a stream's texts; ``small``: ids fit 16 bits."""
    n = len(targets)
    none = np.zeros(0, np.int64)
    if n <= ORDER:
        return none, none, none, none.view(U), none.view(U)
    ids = targets.astype(U)
    with np.errstate(over="ignore"):
        total = np.zeros(n - ORDER, U)
        for k in range(ORDER):
            total += ids[k : n - ORDER + k] * _text._TURNS[k]
        total = _text.mix(total)
    begin = np.flatnonzero(total & U((1 << SPARSE) - 1) == 0) + ORDER
    text = np.searchsorted(bounds, begin, "right") - 1
    inside = begin - ORDER >= bounds[text]
    begin, text = begin[inside], text[inside]
    end = np.minimum(np.append(begin[1:], n), bounds[text + 1])
    width = 2 if small else 4
    raw = _text.spare(targets.astype("<u2" if small else "<u4").view(np.uint8))
    context = total[begin - ORDER]
    return text, begin, end, context, _text.mix(context ^ _text.mix(_text.hashes_of(raw, begin * width, end * width, 256)))


def _sorted_runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, places in it where a new value begins) of rows, by the first column, then the next."""
    order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, np.flatnonzero(new)


def _add(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys in order and their summed counts."""
    order, first = _sorted_runs(*keys)
    return tuple(k[order[first]] for k in keys), np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _joined(held: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([x[i] for x in held]) for i in range(len(held[0])))


class Counter:
    """Sums of one kind of keys in a task; hands on what doesn't combine well."""

    def __init__(self, kind: int, bits: int, most: int):
        self.kind, self.bits, self.most = kind, bits, most
        self.held: list[tuple] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``columns``: keys, then counts."""
        self.held.append(columns)
        self.size += len(columns[-1])
        if self.size > self.most:
            keys, counts = self._combined()
            self.held, self.size = [(*keys, counts)], len(counts)
            if self.size > self.most // 2:
                yield from self.rest()

    def _combined(self) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        *keys, counts = _joined(self.held)
        return _add(tuple(keys), counts)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, counts = self._combined()
            self.held, self.size = [], 0
            yield from _packed(self.kind, self.bits, keys, counts)


def _bucket_of(kind: int, keys: np.ndarray, bits: int) -> np.ndarray:
    spread = _text.mix(keys) if kind == PAIRS else keys  # the others are hashes
    return (spread >> U(64 - bits)).astype(np.int64)


def _runs(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(order, bounds) of the runs of a bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
    return order, list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))


FIRST = ["uid", "id", "held", "ids", "kind", "bucket", "keys", "counts"]
FIRST_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
FIRST_SCHEMA = "uid long, id long, held boolean, ids binary, kind int, bucket int, keys binary, counts binary"
#: What must meet its counts: keys, the document's number in its task, segment's number in the document (pairs, and waiting segments), the document's own occurrences (words: all), log10 probabilities (segments) or occurrences (contexts).
ASKED = {"keys": U, "seqs": np.uint32, "more": np.uint32, "own": np.uint32, "logs": np.float32}
SECOND = ["uid", "id", "held", "n_tokens", "n_known", "words", "score", "kind", "bucket", "part", *ASKED]
SECOND_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
SECOND_SCHEMA = "uid long, id long, held boolean, n_tokens long, n_known long, words double, score double, kind int, bucket int, part int, keys binary, seqs binary, more binary, own binary, logs binary"
#: What documents gain: words' sums and known words, and what their scores get.
GAINED = {"seqs": np.uint32, "words_gain": np.float64, "known_gain": np.int64, "gain": np.float64}
SETTLED = ["kind", "bucket", "part", *ASKED, *list(GAINED)[1:]]
SETTLED_SCHEMA = "kind int, bucket int, part int, keys binary, seqs binary, more binary, own binary, logs binary, words_gain binary, known_gain binary, gain binary"


def _rows(names: list[str], types: list[pa.DataType], n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)


def _packed(kind: int, bits: int, keys: tuple[np.ndarray, ...], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    order, runs = _runs(_bucket_of(kind, keys[0], bits))
    bucket = _bucket_of(kind, keys[0], bits)[order]
    blobs = [[c[order[a:b]].tobytes() for a, b in runs] for c in (keys[0], counts)]
    yield _rows(FIRST, FIRST_TYPES, len(runs), kind=[kind] * len(runs), bucket=[int(bucket[a]) for a, _ in runs], keys=blobs[0], counts=blobs[1])


def _encode_and_count(docs: DataFrame, tokenizer: str, bits: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents with their ids, and rows of counts by bucket, in one table of the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap_kept()
        uid = TaskContext.get().partitionId() << 33
        own = subwords.encoder(tokenizer)
        vocabulary, small = own.size + 1, own.size < 65536
        kind = np.uint32 if vocabulary**2 < 1 << 32 else np.uint64
        words, pairs, segments, contexts = (Counter(k, bits, most) for k, most in zip(KINDS, (1 << 19, 1 << 19, 1 << 18, 1 << 18), strict=True))
        raw: tuple[list[np.ndarray], list[np.ndarray]] = [], []
        waiting = 0

        def collapse() -> Iterator[pa.RecordBatch]:
            """Sorts the words and pairs gathered so far into counts."""
            nonlocal waiting
            waiting = 0
            for gathered, counter in zip(raw, (words, pairs), strict=True):
                keys = np.sort(np.concatenate(gathered))
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                gathered.clear()
                yield from counter.add(keys[first].astype(U), np.diff(np.append(first, len(keys))))

        for batch in batches:
            out = batch.column(2).to_numpy(zero_copy_only=False)
            blobs: list[bytes] = []
            for row, data, bounds in _text.chunks(batch.column(1)):
                n = len(bounds) - 1
                ids, cut = own.encode(data, bounds, added=True)
                blobs += [ids[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                found = _text.words(data, bounds)
                learn = ~out[row : row + n]
                mine = found.hash[np.repeat(learn, np.diff(found.first))]
                raw[0].append(np.append(mine, np.full(learn.sum(), END_WORD)))
                mine = ids[np.repeat(learn, np.diff(cut))].astype(np.int64)
                inputs, targets, ends = attention.stream(mine, np.concatenate([[0], np.cumsum(np.diff(cut)[learn])]), own.size)
                raw[1].append((inputs * vocabulary + targets).astype(kind))
                waiting += len(targets)
                if waiting > 1 << 20:
                    yield from collapse()
                _, _, _, context, segment = segments_of(targets, ends, small)
                for counter, keys in ((segments, segment), (contexts, context)):
                    yield from counter.add(keys, np.ones(len(keys), np.int64))
            n = batch.num_rows
            yield _rows(FIRST, FIRST_TYPES, n, uid=np.arange(uid, uid + n), id=batch.column(0), held=batch.column(2), ids=blobs)
            uid += n
        if raw[0]:
            yield from collapse()
        for c in (words, pairs, segments, contexts):
            yield from c.rest()

    return written(rows.mapInArrow(run, FIRST_SCHEMA), "lm-ids", "zstd")


def _unpacked(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(keys), U), np.frombuffer(b"".join(counts), np.int64)


def _merged(first: DataFrame) -> DataFrame:
    """(kind, bucket, keys, counts): one row a kind and bucket, keys in order."""

    def merge(rows: pa.Table) -> pa.Table:
        keys, counts = _unpacked(*(rows[c].to_pylist() for c in ("keys", "counts")))
        (keys,), counts = _add((keys,), counts)
        return pa.table([rows["kind"].slice(0, 1), rows["bucket"].slice(0, 1), *(pa.array([x.tobytes()], pa.binary()) for x in (keys, counts))], names=["kind", "bucket", "keys", "counts"])

    counted = first.where("bucket IS NOT NULL").select("kind", "bucket", "keys", "counts")
    return written(counted.groupBy("kind", "bucket").applyInArrow(merge, "kind int, bucket int, keys binary, counts binary"), "lm-counts", "zstd")


def _level(c: np.ndarray) -> np.ndarray:
    """Counts up to 1023 as they are, greater ones in sixteenths of a power of two."""
    return np.where(c < 1024, c, np.minimum(1024 + (np.log2(np.maximum(c, 1) / 1024) * 16).astype(np.int64), 2047))


def _least_of(level: int) -> int:
    return level if level <= 1024 else int(np.ceil(1024 * 2 ** ((level - 1024) / 16)))


def _levels(counts: DataFrame) -> tuple[int, int, dict[int, int]]:
    """(N, V, least count of what is sent to all workers by kind): from a histogram of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((len(KINDS), 2048), np.int64), np.zeros((len(KINDS), 2048), np.int64)
        for batch in batches:
            for kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = np.frombuffer(blob, np.int64)
                level = _level(c)
                n[kind] += np.bincount(level, minlength=2048)
                total[kind] += np.bincount(level, weights=c, minlength=2048).astype(np.int64)
        kind, found = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(found), pa.array(n[kind, found]), pa.array(total[kind, found])], ["kind", "level", "n", "total"])

    rows = counts.select("kind", "counts").mapInArrow(run, "kind int, level long, n long, total long").groupBy("kind", "level").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    least = {}
    for kind, left in ((WORDS, MOST_WORDS), (PAIRS, attention.MOST_PAIRS), (SEGMENTS, MOST_SEGMENTS), (CONTEXTS, MOST_SEGMENTS)):
        level = 2048
        for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: -r["level"]):
            if r["n"] > left:
                break
            level, left = r["level"], left - r["n"]
        least[kind] = _least_of(level)
    mine = [r for r in rows if r["kind"] == WORDS]
    return sum(r["total"] for r in mine), sum(r["n"] for r in mine), least


def _frequent(counts: DataFrame, least: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind the keys and counts of what is sent to all workers, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, keys, c in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k, n = np.frombuffer(keys, U), np.frombuffer(c, np.int64)
                keep = n >= least[kind]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), kind, np.int32)), pa.array(k[keep].view(np.int64)), pa.array(n[keep])], ["kind", "key", "n"])

    got = counts.select("kind", "keys", "counts").mapInArrow(run, "kind int, key long, n long").toPandas()
    out = {}
    for kind in KINDS:
        mine = got[got["kind"] == kind]
        key, n = mine["key"].to_numpy(np.int64).view(U), mine["n"].to_numpy(np.int64)
        order = np.argsort(key)
        out[kind] = key[order], n[order]
    return out


def _segment_gains(times: np.ndarray, own: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """What a segment's count adds to the attention's log10 probabilities ``logs``; ``own``: the document's own occurrences."""
    c = times - own.astype(np.int64)
    with np.errstate(divide="ignore"):
        return np.where(c > 0, np.log10(np.maximum(c, 0) + 10.0 ** np.maximum(logs, -300)) - logs, 0)


def _context_gains(times: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What a context's count adds to its segments' log10 probabilities."""
    return -np.log10(times - own.astype(np.int64) + 1.0)


def _counts_at(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The counts of keys, 0 of those that are not among the known ones in order."""
    hit, at = _found(known[0], keys)
    return np.where(hit, known[1][at], 0) if len(known[0]) else np.zeros(len(keys), np.int64)


def _summed_cells(counts: DataFrame, cells_of, width: int, rows: int, finish, schema: str) -> DataFrame:
    """Counts of pairs summed to a table of ``rows`` by ``width`` cells, in bands of rows, each of which ``finish`` takes."""
    band = -(-rows // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, c in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cells = cells_of((np.frombuffer(keys, U) // U(rows)).astype(np.int64), (np.frombuffer(keys, U) % U(rows)).astype(np.int64))
                times = np.tile(np.frombuffer(c, np.int64), len(cells) // max(1, len(c) // 8))
                (cells,), times = _add((cells,), times)
                which, edge = np.unique(cells // (band * width), return_index=True)
                edge = np.append(edge, len(cells)).tolist()
                blobs = [[x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)] for x in (cells, times)]
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["band", "cells", "times"])

    def together(got: pa.Table) -> pa.Table:
        b = got["band"][0].as_py()
        cells, times = (np.frombuffer(b"".join(got[c].to_pylist()), np.int64) for c in ("cells", "times"))
        n = min(band, rows - b * band)
        return finish(b * band, np.bincount(cells - b * band * width, times, n * width).reshape(n, width))

    pairs = counts.where(F.col("kind") == PAIRS).select("keys", "counts")
    return pairs.mapInArrow(run, "band int, cells binary, times binary").groupBy("band").applyInArrow(together, schema)


def _banded(bands: DataFrame, rows: int, **widths: int) -> list[np.ndarray]:
    """What bands of rows were made into, as whole arrays of 32-bit numbers."""
    out = [np.zeros((rows, w), np.float32) for w in widths.values()]
    for r in bands.collect():
        for whole, (name, w) in zip(out, widths.items(), strict=True):
            some = np.frombuffer(r[name], np.float32).reshape(-1, w)
            whole[r["first"] : r["first"] + len(some)] = some
    return out


def _band(first: int, **arrays: np.ndarray) -> pa.Table:
    return pa.table({"first": pa.array([first], pa.int64()), **{k: pa.array([x.astype(np.float32).tobytes()], pa.binary()) for k, x in arrays.items()}})


def _id_counts(counts: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id follows another, or a text's beginning, and how often a text ends."""
    finish = lambda first, sums: pa.table({"first": pa.array([first], pa.int64()), "n": pa.array([sums.astype(np.int64).tobytes()], pa.binary())})
    out = np.zeros(vocabulary, np.int64)
    for r in _summed_cells(counts, lambda before, ids: ids, 1, vocabulary, finish, "first long, n binary").collect():
        some = np.frombuffer(r["n"], np.int64)
        out[r["first"] : r["first"] + len(some)] = some
    return out


def _classes(counts: DataFrame, id_counts: np.ndarray) -> np.ndarray:
    """Classes of ids by their neighbours in all pairs."""
    column = attention.neighbour_columns(id_counts)
    cells = lambda before, ids: attention.neighbour_cells(before, ids, column)
    finish = lambda first, features: _band(first, **dict(zip(("z", "seen"), attention.neighbour_places(features), strict=True)))
    z, seen = _banded(_summed_cells(counts, cells, attention.COLUMNS, len(id_counts), finish, "first long, z binary, seen binary"), len(id_counts), z=attention.PLACE, seen=1)
    return attention.group_ids(z, seen[:, 0], id_counts)


def _classes_after(counts: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often each class follows each id, in all pairs."""
    cells = lambda before, ids: before * attention.CLASSES + classes[ids]
    finish = lambda first, sums: _band(first, sums=sums)
    return _banded(_summed_cells(counts, cells, attention.CLASSES, len(classes), finish, "first long, sums binary"), len(classes), sums=attention.CLASSES)[0]


def _found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether, where) keys stand among the ``known`` in order."""
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    return (known[at] == keys if len(known) else np.zeros(len(keys), bool)), at


class Places:
    """Where hashes stand among ``known`` ones in order: what ``_found`` gives, begun at their leading bits."""

    def __init__(self, known: np.ndarray):
        self.known, self.drop = known, U(64 - max(1, len(known).bit_length()))
        self.starts = np.searchsorted(known, np.arange(1 << (64 - int(self.drop)), dtype=U) << self.drop)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = len(self.known) - 1
        if last < 0:
            return _found(self.known, keys)
        at = np.minimum(self.starts.take((keys >> self.drop).astype(np.int64)), last)
        met = self.known.take(at)
        behind = np.flatnonzero(met < keys)
        while len(behind):
            behind = behind[at[behind] < last]
            at[behind] += 1
            met[behind] = self.known[at[behind]]
            behind = behind[met[behind] < keys[behind]]
        return met == keys, at


@functools.cache
def _vocabulary_bytes(tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds, first eight bytes as numbers) of all ids one behind the other: the inverse of the byte-level alphabet."""
    own = subwords.encoder(tokenizer)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    names = [own.tokenizer.id_to_token(i) or "" for i in range(own.size)]
    parts = [bytes(alphabet.get(c, 0x3F) for c in name) for name in names]
    data, cut = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return data, cut, _text.block(_text.spare(data), cut[:-1], np.diff(cut))


def texts_of(ids: np.ndarray, bounds: np.ndarray, vocabulary: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that ids stand for, and texts' byte bounds."""
    data, cut, heads = vocabulary
    size = np.diff(cut).take(ids)
    end = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(end[-1]) + 8, np.uint8)
    # eight bytes for every id, in order, so that the next one's take the place of those that are too many
    np.ndarray((len(out) - 7,), "<u8", out, strides=(1,))[end[:-1]] = heads.take(ids)
    long = np.flatnonzero(size > 8)
    more = size[long] - 8
    skip = np.repeat(np.cumsum(more) - more, more)
    at = np.arange(len(skip)) - skip + 8
    out[np.repeat(end[long], more) + at] = data[np.repeat(cut[ids[long]], more) + at]
    return out[: end[-1]], end[bounds]


def _streams(blobs: list[bytes], dtype: type, end: int, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, last, ids, id bounds, inputs, targets, target bounds) of runs of texts of about ``most`` bytes of ids, or of one longer."""
    a = 0
    while a < len(blobs):
        b, size = a, 0
        while b < len(blobs) and (b == a or size + len(blobs[b]) <= most):
            size += len(blobs[b])
            b += 1
        ids = np.frombuffer(b"".join(blobs[a:b]), dtype).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(x) // np.dtype(dtype).itemsize for x in blobs[a:b]])]).astype(np.int64)
        yield a, b, ids, bounds, *attention.stream(ids, bounds, end)
        a = b


def _pick(targets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number of each text that says which of its windows are learned from."""
    with np.errstate(over="ignore"):
        return (_text.mix(targets[bounds[:-1]].astype(U) * U(31) + np.diff(bounds).astype(U)) >> U(33)).astype(np.int64)


def pass_windows(targets: np.ndarray, bounds: np.ndarray, others: bool) -> np.ndarray:
    """Numbers of the windows that the first descent learns from, or of all ``others``."""
    chosen = attention.chosen_windows(bounds, _pick(targets, bounds), ONE_OF)
    if not others:
        return chosen
    left = np.ones(int(attention.window_starts(bounds)[-1]), bool)
    left[chosen] = False
    return np.flatnonzero(left)


#: Parts that the weights are summed in.
PARTS = 8


def _summed(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.float64) for x in rows["weights"].to_pylist()], axis=0)
    return pa.table([rows["part"].slice(0, 1), rows["salt"].slice(0, 1), pa.array([total.tobytes()], pa.binary()), pa.array([sum(rows["n"].to_pylist())], pa.int64())], names=["part", "salt", "weights", "n"])


def _first_descent(learned: DataFrame, model: attention.Model, dtype: type) -> attention.Model:
    """Learns from some windows of every training document."""
    return _descended(learned, model, dtype, RATE, False)[0]


def _second_descent(learned: DataFrame, model: attention.Model, dtype: type) -> attention.Model:
    """Learns from all windows that the first descent left."""
    return _descended(learned, model, dtype, SECOND_RATE, True)[0]


def _descended(learned: DataFrame, model: attention.Model, dtype: type, rate: float, others: bool) -> tuple[attention.Model, int]:
    """Every task goes on from ``model`` with its own documents' windows; the mean of their weights, by windows, and the windows."""
    sent = learned.sparkSession.sparkContext.broadcast(model)
    most, place = 16 * attention.BATCH, np.arange(attention.WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap_kept()
        descent, held, size, n = attention.Descent(sent.value, rate), [], 0, 0

        def step(least: int) -> None:
            nonlocal held, size, n
            if size < least:
                return
            inputs, aim, scored = _joined(held)
            order = np.random.default_rng(size).permutation(size)
            for a in range(0, size, attention.BATCH):
                mine = order[a : a + attention.BATCH]
                descent.learn(inputs.take(mine, axis=0), aim.take(mine, axis=0), scored.take(mine, axis=0))
            n += size
            held, size = [], 0

        for batch in batches:
            for *_, inputs, targets, ends in _streams(batch.column(0).to_pylist(), dtype, sent.value.end):
                numbers, before, aims = pass_windows(targets, ends, others), attention.windowed(inputs), attention.windowed(sent.value.classes.take(targets))
                begin, since, until = (x.take(numbers) for x in attention.window_spans(ends))
                for a in range(0, len(numbers), most):
                    at, since_, until_ = (x[a : a + most] for x in (begin, since, until))
                    held.append((before[at], aims[at], (place >= since_[:, None]) & (place < until_[:, None])))
                    size += len(at)
                    step(most)
        step(1)
        if n:
            parts = np.array_split(attention.weights_of(descent.model) * n, PARTS)
            salt = [TaskContext.get().partitionId() % 64] * PARTS
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(salt, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([n] * PARTS, pa.int64())], ["part", "salt", "weights", "n"])

    schema = "part int, salt int, weights binary, n long"
    sums = learned.select("ids").mapInArrow(run, schema).groupBy("part", "salt").applyInArrow(_summed, schema).groupBy("part").applyInArrow(_summed, schema)
    rows = sorted(sums.collect(), key=lambda r: r["part"])
    sent.unpersist()
    if not rows:
        return model, 0
    n = rows[0]["n"]
    return attention.with_weights(model, np.concatenate([np.frombuffer(r["weights"], np.float64) for r in rows]) / n), n


def _own_counts(text: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """How often each row's keys stand in its text."""
    order, first = _sorted_runs(text, *keys)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.diff(np.append(first, len(order))), np.diff(np.append(first, len(order))))
    return out


def _asked(kind: int, bits: int, columns: list[np.ndarray], uids: np.ndarray) -> list[dict]:
    """Columns of rows of what must meet its counts, by task of the first pass and bucket; ``columns``: as ASKED, ``uids`` for seqs."""
    out = []
    part = uids >> 33
    for p in np.unique(part).tolist():
        mine = np.flatnonzero(part == p)
        bucket = _bucket_of(kind, columns[0][mine], bits) if kind != WAITING else np.zeros(len(mine), np.int64)
        order, runs = _runs(bucket)
        blobs = {c: [x[mine[order[a:b]]].astype(t).tobytes() for a, b in runs] for (c, t), x in zip(ASKED.items(), columns, strict=True)}
        out.append({"kind": [kind] * len(runs), "part": [p] * len(runs), "bucket": [int(bucket[order[a]]) for a, _ in runs], **blobs})
    return out


def _read(rows: pa.Table, types: dict) -> tuple[np.ndarray, ...]:
    """Columns of blobs as arrays."""
    return tuple(np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in types.items())


def _uids(rows: pa.Table) -> np.ndarray:
    """The documents that rows of blobs stand for, by task and number."""
    seqs = [np.frombuffer(x, np.uint32).astype(np.int64) | p << 33 for p, x in zip(rows["part"].to_pylist(), rows["seqs"].to_pylist(), strict=True)]
    return np.concatenate([np.zeros(0, np.int64), *seqs])


def _score_rows(first: DataFrame, tokenizer: str, bits: int, model: attention.Model, frequent: dict, dtype: type) -> DataFrame:
    """Rows of documents with what is known so far, and rows of what must meet its counts by bucket."""
    sent = first.sparkSession.sparkContext.broadcast((model, *(frequent[k] for k in (WORDS, SEGMENTS, CONTEXTS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap_kept()
        m, (known, times), segments, contexts = sent.value
        table = attention.embeddings(m)
        logs10, word_places = np.log10(times + 1.0), Places(known)
        segment_places, context_places = Places(segments[0]), Places(contexts[0])
        vocabulary, small = _vocabulary_bytes(tokenizer), m.end < 65536
        held: dict[int, list[tuple]] = {k: [] for k in (*KINDS, WAITING)}
        size = 0

        def ask(kind: int, uids: np.ndarray, keys: np.ndarray, more=None, own=None, logs=None) -> None:
            nonlocal size
            none = np.zeros(len(keys), np.uint32)
            held[kind].append((uids, keys, none, *(none if x is None else x for x in (more, own, logs))))
            size += len(keys)

        def rare() -> Iterator[pa.RecordBatch]:
            nonlocal size
            size = 0
            for kind, parts in held.items():
                if parts:
                    uids, keys, _, *others = _joined(parts)
                    for columns in _asked(kind, bits, [keys, uids & 0x1FFFFFFFF, *others], uids):
                        yield _rows(SECOND, SECOND_TYPES, len(columns["kind"]), **columns)
                parts.clear()

        for batch in batches:
            for a, b, ids, bounds, inputs, targets, ends in _streams(batch.column(3).to_pylist(), dtype, m.end):
                uid, out = batch.column(0).to_numpy()[a:b], batch.column(2).to_numpy(zero_copy_only=False)[a:b]
                docs, unknown = b - a, []
                each = np.concatenate([[0.0], np.cumsum(attention.score_targets(m, inputs, targets, ends, table, unknown))])
                score = np.diff(each[ends])
                text, begin, end, context, segment = segments_of(targets, ends, small)
                logs = each[end] - each[begin]
                number = np.arange(len(text)) - np.searchsorted(text, text)
                waits = np.zeros(len(text), bool)
                place = unknown[0]
                if len(place):
                    of = np.searchsorted(ends, place, "right") - 1
                    at = np.searchsorted(begin, place, "right") - 1
                    within = np.flatnonzero(at >= 0)
                    within = within[place[within] < end[at[within]]]
                    waits[at[within]] = True
                    where = np.full(len(place), NO_SEGMENT)
                    where[within] = number[at[within]]
                    ask(PAIRS, uid[of], inputs[place].astype(U) * U(m.end + 1) + targets[place].astype(U), more=where)
                learn = ~out[text]
                own = _own_counts(text, segment) * learn
                hit, at = segment_places.of(segment)
                hit &= ~waits
                score += np.bincount(text[hit], weights=_segment_gains(segments[1][at[hit]], own[hit], logs[hit]), minlength=docs)
                for kind, mine in ((SEGMENTS, ~hit & ~waits), (WAITING, waits)):
                    ask(kind, uid[text[mine]], segment[mine], number[mine], own[mine], logs[mine])
                (context, text), n = _add((context, text), np.ones(len(text), np.int64))
                own = n * ~out[text]
                hit, at = context_places.of(context)
                score += np.bincount(text[hit], weights=n[hit] * _context_gains(contexts[1][at[hit]], own[hit]), minlength=docs)
                ask(CONTEXTS, uid[text[~hit]], context[~hit], None, own[~hit], n[~hit])
                found = _text.words(*texts_of(ids, bounds, vocabulary))
                text = np.concatenate([found.text_of_word(), np.arange(docs)])
                hashes = np.concatenate([found.hash, np.full(docs, END_WORD)])
                hit, at = word_places.of(hashes)
                words = np.bincount(text[hit], weights=logs10[at[hit]], minlength=docs)
                yield _rows(SECOND, SECOND_TYPES, docs, uid=uid, id=batch.column(1).slice(a, docs), held=batch.column(2).slice(a, docs), n_tokens=np.bincount(text, minlength=docs), n_known=np.bincount(text[hit], minlength=docs), words=words, score=score)
                rest, n = _add((hashes[~hit], text[~hit]), np.ones(int((~hit).sum()), np.int64))  # a word's occurrences in a text go as one
                ask(WORDS, uid[rest[1]], rest[0], None, n)
                if size > 1 << 18:
                    yield from rare()
        yield from rare()

    rows = first.where("uid IS NOT NULL").select("uid", "id", "held", "ids")
    return written(rows.mapInArrow(run, SECOND_SCHEMA), "lm-scores", "zstd")


def _settled(second: DataFrame, counts: DataFrame, bits: int, inside: np.ndarray) -> DataFrame:
    """Rows of documents' gains by the pairs that were not sent to all workers, and rows of the segments that waited for these."""
    shares = second.sparkSession.sparkContext.broadcast(inside)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """A row for each task that asked: numbers of documents and segments, and gains."""
        keys, seqs, more = _read(left, {c: ASKED[c] for c in ("keys", "seqs", "more")})
        part = np.repeat(np.array(left["part"].to_pylist(), np.int64), [len(x) // 4 for x in left["seqs"].to_pylist()])
        times = _counts_at(_unpacked(*(right[c].to_pylist() for c in ("keys", "counts"))), keys)
        known = np.flatnonzero(times)
        known = known[np.argsort(part[known], kind="stable")]
        gain = attention.later(shares.value[(keys[known] % U(len(shares.value))).astype(np.int64)], times[known])
        parts, edge = np.unique(part[known], return_index=True)
        edge = np.append(edge, len(known)).tolist()
        blobs = [[x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)] for x in (seqs[known], more[known], gain)]
        return pa.table([pa.array(parts, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["part", "seqs", "more", "gain"])

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        """A task's segments with the gains of their pairs, by bucket, and its documents' gains."""
        p = (left if left.num_rows else right)["part"][0].as_py()
        seqs, more, gain = _read(right, {"seqs": np.uint32, "more": np.uint32, "gain": np.float64})
        keys, of, number, own, logs = _read(left, ASKED)
        both = lambda s, n: s.astype(U) << U(32) | n.astype(U)
        own_places = both(of, number)
        order = np.argsort(own_places)
        place = both(seqs, more)
        hit, at = _found(own_places[order], place)
        logs = logs + np.bincount(order[at[hit]], weights=gain[hit], minlength=len(logs))
        out = []
        for columns in _asked(SEGMENTS, bits, [keys, of, number, own, logs], of.astype(np.int64) | p << 33):
            n = len(columns["kind"])
            out.append(pa.table([pa.array(columns[c], pa.binary() if c in ASKED else pa.int32()) if c in columns else pa.nulls(n, pa.binary()) for c in SETTLED], names=SETTLED))
        seen, which = np.unique(seqs, return_inverse=True)
        sums = {"seqs": seen, "words_gain": np.zeros(len(seen)), "known_gain": np.zeros(len(seen), np.int64), "gain": np.bincount(which, weights=gain, minlength=len(seen))}
        fixed = {"part": pa.array([p], pa.int32()), **{c: pa.nulls(1, pa.int32()) for c in ("kind", "bucket")}}
        out.append(pa.table([fixed[c] if c in fixed else pa.array([sums[c].tobytes() if c in sums else None], pa.binary()) for c in SETTLED], names=SETTLED))
        return pa.concat_tables(out)

    asked = second.where(F.col("kind") == PAIRS).select("bucket", "part", "keys", "seqs", "more")
    met = asked.groupBy("bucket").cogroup(counts.where(F.col("kind") == PAIRS).select("bucket", "keys", "counts").groupBy("bucket")).applyInArrow(meet, "part int, seqs binary, more binary, gain binary")
    waiting = second.where(F.col("kind") == WAITING).select("part", *ASKED)
    return written(waiting.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(settle, SETTLED_SCHEMA), "lm-settled", "zstd")


def _rare_sums(second: DataFrame, counts: DataFrame, bits: int, model: attention.Model) -> DataFrame:
    """(_uid, words_gain, known_gain, gain) of words, pairs, segments and contexts that were not sent to all workers."""
    schema = "part int, seqs binary, words_gain binary, known_gain binary, gain binary"

    def packed(uid: np.ndarray, *sums: np.ndarray) -> pa.Table:
        """A row for each task that scored: what its documents gain here."""
        part = uid >> 33  # in order
        parts, start = np.unique(part, return_index=True)
        edge = np.append(start, len(uid)).tolist()
        blobs = [[c[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)] for c in ((uid & 0x1FFFFFFFF).astype(np.uint32), *sums)]
        return pa.table([pa.array(parts, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["part", *GAINED])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return packed(*[np.zeros(0, np.int64)] * 4)
        kind = left["kind"][0].as_py()
        keys, own, logs = _read(left, {c: ASKED[c] for c in ("keys", "own", "logs")})
        times = _counts_at(_unpacked(*(right[c].to_pylist() for c in ("keys", "counts"))), keys)
        ids, which = np.unique(_uids(left), return_inverse=True)
        nothing = np.zeros(len(keys))
        gain = _segment_gains(times, own, logs.astype(np.float64)) if kind == SEGMENTS else logs * _context_gains(times, own) if kind == CONTEXTS else nothing
        more, known = (own * np.log10(times + 1.0), own * (times > 0)) if kind == WORDS else (nothing, nothing)
        more, known, gain = (np.bincount(which, weights=x, minlength=len(ids)) for x in (more, known, gain))
        return packed(ids, more, known.astype(np.int64), gain)

    def together(rows: pa.Table) -> pa.Table:
        """Sums for each document of a task."""
        seq, *sums = _read(rows, GAINED)
        seq = seq.astype(np.int64)
        size = int(seq.max(initial=-1)) + 1
        seen = np.flatnonzero(np.bincount(seq, minlength=size))
        more, known, gain = (np.bincount(seq, weights=c, minlength=size)[seen] for c in sums)
        return pa.table([pa.array(seen | rows["part"][0].as_py() << 33), pa.array(more), pa.array(known.round().astype(np.int64)), pa.array(gain)], names=["_uid", *list(GAINED)[1:]])

    settled = _settled(second, counts, bits, model.inside)
    columns = ["kind", "bucket", "part", *ASKED]
    rare = second.where(F.col("kind").isin(WORDS, SEGMENTS, CONTEXTS)).select(columns).unionByName(settled.where("kind IS NOT NULL").select(columns))
    met = rare.groupBy("kind", "bucket").cogroup(counts.where(F.col("kind") != PAIRS).groupBy("kind", "bucket")).applyInArrow(meet, schema)
    gained = met.unionByName(settled.where("kind IS NULL").select("part", *GAINED))
    return gained.groupBy("part").applyInArrow(together, "_uid long, words_gain double, known_gain long, gain double")


def score_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Tokens of the base are words (runs of other than ASCII white space, A-Z as a-z) and one end;
    base_score is the sum of log10((c + 1) / (N + V + 1)) over them, c, N and V from documents that
    are not held out. score is the model's log10 probability of the text and its end, for a training
    document with its own occurrences taken out of the memory of segments. Null and empty texts are
    one end. Repeated rows count and are scored each; without training documents counts are 0. Ids
    are whole numbers; columns other than the two named are not read. Words, contexts and segments
    are told apart by 64-bit hashes.
    """
    own = subwords.encoder(tokenizer)
    dtype = own.ids.dtype.type
    with scratch() as made:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        bits = max(4, int(np.ceil(np.log2(max(1, size / BUCKET_BYTES)))))
        first = _encode_and_count(docs, tokenizer, bits, id_col, text_col)
        learned = first.where("uid IS NOT NULL AND NOT held").coalesce(1 << bits)  # a mean of many short descents would learn little
        counts = _merged(first)
        n, v, least = _levels(counts)
        frequent = _frequent(counts, least)
        id_counts = _id_counts(counts, own.size + 1)
        classes = _classes(counts, id_counts)
        model = attention.begin(id_counts, *frequent.pop(PAIRS), classes, _classes_after(counts, classes))
        model = _second_descent(learned, _first_descent(learned, model, dtype), dtype)
        second = _score_rows(first, tokenizer, bits, model, frequent, dtype)
        removed(first)
        scored = second.where("uid IS NOT NULL").select("uid", "id", "held", "n_tokens", "n_known", "words", "score")
        met = scored.join(_rare_sums(second, counts, bits, model), F.col("uid") == F.col("_uid"), "left")
        base = F.col("words") + F.coalesce("words_gain", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))
        known = F.col("n_known") + F.coalesce("known_gain", F.lit(0))
        out = met.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"))
        return made.keep(written(out, "lm-result"))
