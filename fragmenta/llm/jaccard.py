"""Exact self-join on the Jaccard similarity of word shingles, and the classes of linked documents.

Two sets of x and y shingles that link at 3/4 differ in at most (x + y) / 7 of them. In each band
of sizes the universe of shingles is partitioned into more segments than that; a set is cut into
its segment subsets, and two sets that link have some subsets in common. The hash of a subset is
a signature; equal ones meet in a bucket, and every candidate is verified on the whole sets.

Signatures that many sets share would give the square of their number in candidates. A cost-based
allocation spends no pairs on them: the group's members are only compared with its first one. A
set stays complete as long as its remaining subsets outnumber the shingles by which a partner may
differ. Sets of which that isn't so are joined a second time on one-deletion neighbourhoods of
their subsets, each worth two differences; what has not enough of those either (members of large
families, mostly) is compared over all its shared subsets with the sets of other classes.

Equal sets are one set throughout. Nothing is collected, and no partner or candidate is capped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmenta.llm import _text
from fragmenta.llm._shared import remove_folder, removed, scratch, shared_folder, shuffles_removed, written

WORDS = 5
#: Segments of a band against the most differences in it; sets of a signature that are still all compared.
SPARE, CROWD = 1.4, 16

U = np.uint64


def _bands(most: int = 1 << 26) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size, greatest size, segments) of the bands: a pair is in the band of its smaller set."""
    low = [3]
    while low[-1] < most:
        low.append(max(low[-1] + 1, low[-1] * 16 // 9))
    low = np.array(low)
    small = low[1:] - 1
    high = small * 4 // 3
    return low[:-1], high, np.ceil(SPARE * ((small + high) // 7 + 1)).astype(np.int64)


LOW, HIGH, SEGMENTS = _bands()


class Sets(NamedTuple):
    first: np.ndarray  # sets' bounds
    shingles: np.ndarray  # each set's distinct hashes in order

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> Sets:
    """Each text's distinct shingles; fewer words than WORDS are one shingle."""
    found = _text.words(data, bounds)
    place, hashes = _text.windows(found, range(WORDS))
    texts = [found.text_of_word()[place]]
    parts = [hashes]
    counts = np.diff(found.first)
    for k in range(1, WORDS):
        short = np.flatnonzero(counts == k)
        if len(short):
            with np.errstate(over="ignore"):
                total = np.zeros(len(short), U)
                for o in range(k):
                    total += found.hash[found.first[short] + o] * _text._TURNS[o]
                parts.append(_text.mix(total + U(k)))
            texts.append(short)
    text, h = np.concatenate(texts), np.concatenate(parts)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return Sets(np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(counts)))]), h[keep])


class Subsets(NamedTuple):
    of: np.ndarray  # the set of each subset
    band: np.ndarray
    size: np.ndarray
    sign: np.ndarray
    cut: np.ndarray  # subsets' bounds in ``tokens``
    tokens: np.ndarray  # what each shingle adds to its subset's sum
    sums: np.ndarray
    salt: np.ndarray


def subsets(sets: Sets, back: int) -> Subsets:
    """The nonempty segment subsets of every set in its own band (back 0) or in the one below, where it belongs there too (back 1)."""
    sizes = sets.sizes
    band = np.searchsorted(LOW, sizes, "right") - 1 - back
    inside = (band >= 0) & (sizes >= 3)
    inside[inside] &= sizes[inside] <= HIGH[band[inside]]
    keep = np.repeat(inside, sizes)
    t = sets.shingles[keep]
    of = np.repeat(np.arange(len(sizes)), sizes)[keep]
    with np.errstate(over="ignore"):
        segment = ((t >> U(32)) * SEGMENTS[band[of]].astype(U)) >> U(32)  # ascends with the hash
        new = np.ones(len(t), bool)
        new[1:] = (of[1:] != of[:-1]) | (segment[1:] != segment[:-1])
        cut = np.flatnonzero(new)
        tokens = _text.mix(t)
        sums = np.add.reduceat(tokens, cut) if len(cut) else tokens
        of, segment = of[cut], segment[cut]
        salt = (band[of].astype(U) << U(40)) + segment + U(1)
        sign = _text.mix(sums + _text.mix(salt))
    return Subsets(of, band[of], np.diff(np.append(cut, len(t))), sign, np.append(cut, len(t)), tokens, sums, salt)


def need(sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
    """One more than the differences that a set of a size may have to a partner in the band."""
    small = LOW[np.minimum(band + 1, len(LOW) - 1)] - 1
    partner = np.where(sizes > small, small, np.minimum(HIGH[band], sizes * 4 // 3))
    return (sizes + partner) // 7 + 1


SET_SCHEMA = "id long, n long, h1 long, h2 long, bands array<int>, parts array<long>, full array<long>, single array<long>, need array<long>"


def describe_sets(docs: DataFrame) -> DataFrame:
    """SET_SCHEMA of each row of (id, text): size and hash of its set, and for each of its bands (modulo 4, its own
    first) the segments, its nonempty subsets, those of one shingle, and the subsets it needs to be complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in _text.chunks(batch.column(1)):
                sets = shingle_sets(data, bounds)
                n = len(sets.sizes)
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros((2, 1), U), np.cumsum(np.stack([_text.mix(sets.shingles + U(7)), _text.mix(sets.shingles * U(3))]), axis=1)], axis=1)
                    h1, h2 = ((x[sets.first[1:]] - x[sets.first[:-1]]).view(np.int64) for x in total)
                lists: list[list[list[int]]] = [[[] for _ in range(n)] for _ in range(5)]
                for back in (0, 1):
                    s = subsets(sets, back)
                    one, start = np.unique(s.of, return_index=True)
                    if not len(one):
                        continue
                    count = np.diff(np.append(start, len(s.of)))
                    single = np.add.reduceat((s.size == 1).astype(np.int64), start)
                    band = s.band[start]
                    for i, *row_of in zip(one.tolist(), (band & 3).tolist(), SEGMENTS[band].tolist(), count.tolist(), single.tolist(), need(sets.sizes[one], band).tolist(), strict=True):
                        for x, y in zip(lists, row_of, strict=True):
                            x[i].append(y)
                arrays = [pa.array(x, pa.list_(pa.int32() if k == 0 else pa.int64())) for k, x in enumerate(lists)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(sets.sizes), pa.array(h1), pa.array(h2), *arrays], ["id", "n", "h1", "h2", "bands", "parts", "full", "single", "need"])

    return docs.mapInArrow(run, SET_SCHEMA)


#: A signature in its bucket: 29 bits of hash, whether a token was deleted, and the band modulo 4.
_KEY, _DELETED, _BAND = np.uint32(0xFFFFFFF8 | 3), np.uint32(4), np.uint32(3)


def _prefixes(sets: Sets, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of the first shingles, by hash, of the ``thin`` sets.

    Sets that link share at least 3/4 of each; so there is a shared one among the first n - ceil(3n/4) + 1 of both.
    """
    one = np.flatnonzero(thin)
    n = sets.sizes[one]
    k = n - (3 * n + 3) // 4 + 1
    of = np.repeat(one, k)
    at = np.repeat(sets.first[one] - np.cumsum(k) + k, k) + np.arange(k.sum())
    with np.errstate(over="ignore"):
        return of, _text.mix(sets.shingles[at] * U(5) + U(11))


def _emit(docs: DataFrame, bits: int, wide: bool, deletions: bool, prefixes: bool = False, cut: bool = True) -> DataFrame:
    """Signatures of (id, text) by bucket: (bucket, signs, ids, crowds, local); with ``deletions`` their one-deletion neighbourhoods too.

    With ``prefixes`` sets whose subsets a partner's differences may all spoil have signatures of first shingles besides.
    With ``cut`` a signature that over CROWD sets of a run of a task share is sent once, for the first of
    them (``crowds`` names its place); that the others met the first is in ``local``, which goes to
    buckets by id, as (set, first set, band).
    """
    kind = np.int64 if wide else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            bucket, sign, ids = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.lexsort((sign, ids, bucket << 32 | (sign & _KEY).astype(np.int64)))
            bucket, sign, ids = bucket[order], sign[order], ids[order]
            key = bucket << 32 | (sign & _KEY).astype(np.int64)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (sign[1:] != sign[:-1])
            bucket, sign, ids, key = bucket[new], sign[new], ids[new], key[new]
            local: dict[int, bytes] = {}
            crowds: dict[int, np.ndarray] = {}
            if cut:
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                n = np.diff(np.append(start, len(key)))
                big, many = start[n > CROWD], n[n > CROWD]
                inside = np.repeat(big, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                met = np.stack([ids[inside].astype(np.int64), ids[np.repeat(big, many)].astype(np.int64), (sign[inside] & _BAND).astype(np.int64)])
                met = met[:, inside != np.repeat(big, many)]
                with np.errstate(over="ignore"):
                    to = (_text.mix(met[0].astype(U)) >> U(64 - bits)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                edge = np.flatnonzero(np.concatenate([[True], to[by][1:] != to[by][:-1], [True]])) if len(by) else np.zeros(0, np.int64)
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    local[int(to[by[x]])] = np.ascontiguousarray(met[:, by[x:y]]).tobytes()
                keep = np.ones(len(key), bool)
                keep[inside] = False
                keep[big] = True
                head = np.zeros(len(key), bool)
                head[big] = True
                bucket, sign, ids, head = bucket[keep], sign[keep], ids[keep], head[keep]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            rows: dict[int, tuple[bytes, bytes]] = {}
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                rows[int(bucket[x])] = sign[x:y].tobytes(), ids[x:y].tobytes()
                if cut and head[x:y].any():
                    crowds[int(bucket[x])] = np.flatnonzero(head[x:y]).astype(np.uint32)
            found = sorted(rows.keys() | local.keys())
            columns = [[rows.get(k, (b"", b""))[i] for k in found] for i in (0, 1)]
            columns += [[crowds[k].tobytes() if k in crowds else b"" for k in found], [local.get(k, b"") for k in found]]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "signs", "ids", "crowds", "local"])

        for batch in batches:
            names = batch.column(0).to_numpy()
            for row, data, bounds in _text.chunks(batch.column(1)):
                sets = shingle_sets(data, bounds)
                thin = np.zeros(len(sets.sizes), bool)
                for back in (0, 1):
                    s = subsets(sets, back)
                    if prefixes and len(s.of):
                        one, start, full = np.unique(s.of, return_index=True, return_counts=True)
                        thin[one] |= full < need(sets.sizes[one], s.band[start])
                    of, band, sign, flag = s.of, s.band, s.sign, np.zeros(len(s.of), np.uint32)
                    if deletions and len(s.of):
                        which = np.repeat(np.arange(len(s.of)), s.size)
                        which, token = which[s.size[which] > 1], s.tokens[s.size[which] > 1]
                        with np.errstate(over="ignore"):
                            less = _text.mix(s.sums[which] - token + _text.mix(s.salt[which]))
                        of, band, sign, flag = np.concatenate([of, of[which]]), np.concatenate([band, band[which]]), np.concatenate([sign, less]), np.concatenate([flag, np.full(len(which), _DELETED)])
                    short = ((sign & U(0xFFFFFFFF)).astype(np.uint32) & np.uint32(0xFFFFFFF8)) | flag | (band & 3).astype(np.uint32)
                    held.append(((sign >> U(64 - bits)).astype(np.int64), short, names[row + of].astype(kind)))
                    size += len(of)
                if thin.any():
                    of, sign = _prefixes(sets, thin)
                    held.append(((sign >> U(64 - bits)).astype(np.int64), (sign & U(0xFFFFFFF8)).astype(np.uint32), names[row + of].astype(kind)))
                    size += len(of)
                if size > 1 << 20:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    return docs.mapInArrow(run, "bucket int, signs binary, ids binary, crowds binary, local binary")


def _pairs_of(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within runs: the places of both, for runs of ``n`` from ``start``."""
    a, b = [], []
    for k in np.unique(n):
        i, j = np.triu_indices(int(k), 1)
        s = start[n == k][:, None]
        a.append((s + i).ravel())
        b.append((s + j).ravel())
    none = np.zeros(0, np.int64)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def _meet(emitted: DataFrame, wide: bool, deletions: bool) -> DataFrame:
    """(a, b, band, star, times): candidate pairs a < b and how often they met; for each set (b null) how many of its signatures are too crowded.

    Without ``deletions`` all of a small group's sets are paired; of a larger one each with the first
    (``star``). With them a whole subset is paired with those that are equal after a deletion.
    """
    kind = np.int64 if wide else np.uint32

    def run(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in rows["signs"].to_pylist()]
        sign = np.concatenate(parts)
        ids = np.concatenate([np.frombuffer(x, kind) for x in rows["ids"].to_pylist()]).astype(np.int64)
        many_of = np.zeros(len(sign), bool)
        base = np.cumsum([0, *map(len, parts)])
        for k, x in enumerate(rows["crowds"].to_pylist()):
            many_of[base[k] + np.frombuffer(x, np.uint32).astype(np.int64)] = True
        local = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in rows["local"].to_pylist()], axis=1)
        key = sign & _KEY
        order = np.lexsort((ids, key))
        key, ids, sign, many_of = key[order], ids[order], sign[order], many_of[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(key)))
        crowd = (n > CROWD) | (np.add.reduceat(many_of, start) > 0) if len(start) else np.zeros(0, bool)
        keep = (n > 1) | crowd
        start, n, crowd = start[keep], n[keep], crowd[keep]
        a, b = _pairs_of(start[~crowd], n[~crowd])
        if deletions:
            differ = (sign[a] ^ sign[b]) & _DELETED != 0
            a, b = a[differ], b[differ]
        big, many = start[crowd], n[crowd]
        inside = np.repeat(big, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        band = (sign & _BAND).astype(np.int64)
        met = len(inside) + local.shape[1]
        columns = [np.concatenate(x) for x in ((ids[a], ids[np.repeat(big, many)], local[1]), (ids[b], ids[inside], local[0]), (band[a], band[inside], local[2]), (np.zeros(len(a), np.int64), np.ones(met, np.int64)))]
        low, high = np.minimum(columns[0], columns[1]), np.maximum(columns[0], columns[1])
        differ = low != high
        pairs, times = _counted(np.stack([low, high, *columns[2:]])[:, differ])
        marks, crowded = _counted(np.concatenate([np.stack([ids[inside], band[inside]]), local[[0, 2]]], axis=1))
        none = pa.nulls(marks.shape[1], pa.int64())
        whole = [pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2].astype(np.int32)), pa.array(pairs[3] > 0), pa.array(times)]
        alone = [pa.array(marks[0]), none, pa.array(marks[1].astype(np.int32)), pa.array(np.ones(marks.shape[1], bool)), pa.array(crowded)]
        return pa.table([pa.chunked_array([x, y]) for x, y in zip(whole, alone, strict=True)], names=["a", "b", "band", "star", "times"])

    return emitted.groupBy("bucket").applyInArrow(run, "a long, b long, band int, star boolean, times long")


def _counted(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of a matrix, and how often each stands there."""
    if not columns.shape[1]:
        return columns, np.zeros(0, np.int64)
    return np.unique(columns, axis=1, return_counts=True)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the ids listed, each id once in ``ids``."""
    return docs.join(ids.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi")


def _dealt(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as a table in the shared folder, bucketed and sorted by id, and its name: later joins on ids move no text."""
    spark = docs.sparkSession
    name = f"sets_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_removed(spark):
        docs.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").bucketBy(buckets, "id").sortBy("id").saveAsTable(name)
    return spark.table(name), name


def _sets_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in _text.chunks(batch.column(1)):
                sets = shingle_sets(data, bounds)
                blobs = [sets.shingles[a:b].tobytes() for a, b in zip(sets.first[:-1].tolist(), sets.first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(blobs)), pa.array(blobs, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles binary")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link: 100 * intersection >= 75 * union."""
    pairs = written(pairs.select("a", "b").distinct(), "candidates")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(_sets_of(_only(docs, ids)), "sets")
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                if 4 * min(len(p), len(q)) < 3 * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= 75 * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = written(both.mapInArrow(run, "a long, b long"), "links")
    removed(pairs, sets)
    return links


def _own(col: str):
    """An equal value under another expression, so that a join exchanges both sides and may split a hot key."""
    return F.col(col).bitwiseXOR(F.lit(0x5EED))


#: Distinct links at most that the driver folds (4 MB); more are folded by stars, whose many small queries cost the driver far more than so few links.
FOLDED = 1 << 18


def folded(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, root) of the linked ids that are not the smallest they reach: roots go under smaller neighbours' until none is left."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        new, low = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, root):
            moved = root != np.arange(len(ids))
            return ids[moved], ids[root[moved]]
        root = new


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each linked id reaches, the smallest left out; by alternating large and small stars where links are many."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.count() <= FOLDED:
        got = edges.toArrow()
        removed(edges)
        ids, roots = folded(got["u"].to_numpy(), got["v"].to_numpy())
        return written(links.sparkSession.createDataFrame(pa.table([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], names=["id", "root"])), "components")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.least("u", "m").alias("m"), _own("u").alias("k"))
        if large:
            met = around.where("v > u").withColumn("_k", _own("u")).join(least, F.col("_k") == F.col("k"))
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            met = edges.withColumn("_k", _own("u")).join(least, F.col("_k") == F.col("k"))
            out = met.select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    before = None
    while True:
        last, edges = edges, written(star(star(edges, True), False), "edges")
        removed(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def _with_crowded(described: DataFrame, met: DataFrame) -> DataFrame:
    """``described`` with ``crowded``: for each band the set's signatures that are too crowded."""
    counts = met.where("b IS NULL").groupBy("a", "band").agg(F.sum("times").alias("times"))
    marks = counts.groupBy(F.col("a").alias("_a")).agg(F.map_from_entries(F.collect_list(F.struct("band", "times"))).alias("_marks"))  # two bands at most
    crowded = F.transform("bands", lambda b: F.coalesce(F.try_element_at("_marks", b), F.lit(0).cast("long")))
    return described.join(marks, F.col("id") == F.col("_a"), "left").select(*described.columns, crowded.alias("crowded"))


def _short(*terms: tuple[int, str]):
    """Whether a weighted sum of array columns is negative in any band."""
    total = None
    for factor, name in terms:
        term = _scaled(name, factor)
        total = term if total is None else F.zip_with(total, term, lambda x, y: x + y)
    return F.exists(total, lambda x: x < 0)


def _scaled(name: str, factor: int):
    return F.transform(name, lambda x: x * F.lit(factor))


def _plausible(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """Pairs (a, b) of small groups that met often enough to link.

    In the band of the smaller set, sets that link share all but (x + y) / 7 segments; shared ones
    are equal subsets that met, crowded in both, or empty in both.
    """
    sums = pairs.where("b IS NOT NULL AND NOT star").groupBy("a", "b", "band").agg(F.sum("times").alias("times"))
    side = lambda p: about.select(*(F.col(x).alias(f"{p}_{x}") for x in ("id", "n", "bands", "parts", "full", "crowded")))
    met = sums.join(side("x"), F.col("a") == F.col("x_id")).join(side("y"), F.col("b") == F.col("y_id"))
    own = F.when(F.col("x_n") <= F.col("y_n"), F.get("x_bands", F.lit(0))).otherwise(F.get("y_bands", F.lit(0)))
    at = lambda p, name: F.get(f"{p}_{name}", (F.array_position(f"{p}_bands", F.col("band")) - 1).cast("int"))
    parts = at("x", "parts")
    shared = F.col("times") + F.least(at("x", "crowded"), at("y", "crowded")) + parts - F.greatest(at("x", "full"), at("y", "full"))
    return met.where((F.col("band") == own) & (shared >= parts - F.floor((F.col("x_n") + F.col("y_n")) / 7)) & _alike("x_n", "y_n")).select("a", "b")


def _alike(x: str, y: str):
    """Sizes that allow a link."""
    return F.least(x, y) * 4 >= F.greatest(x, y) * 3


def _among(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of which both are among ``sets`` and alike in size."""
    small = sets.select("id", "n")
    met = pairs.select("a", "b").distinct().join(small.select(F.col("id").alias("a"), F.col("n").alias("_x")), "a").join(small.select(F.col("id").alias("b"), F.col("n").alias("_y")), "b")
    return met.where(_alike("_x", "_y")).select("a", "b")


def _shared_enough(sets: DataFrame) -> DataFrame:
    """(id, n, lone) of the sets that may link with any other of ``sets``: 3/4 of their shingles stand in another one too."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = np.frombuffer(blob, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), ident)), pa.array(t)], ["id", "t"])

    each = sets.mapInArrow(explode, "id long, t long")
    alone = each.groupBy("t").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1").groupBy(F.col("id").alias("_i")).agg(F.count("*").alias("lone"))
    sizes = sets.select("id", F.expr("octet_length(shingles) div 8").alias("n"))
    return sizes.join(alone, F.col("id") == F.col("_i"), "left").select("id", "n", F.coalesce("lone", F.lit(0).cast("long")).alias("lone")).where("4 * (n - lone) >= 3 * n")


#: Sets of a block of the last comparison.
BLOCK = 512


def _compare(rows: pa.Table) -> pa.Table:
    """Links (a, b) between sets of different classes of one pair of blocks, none that others imply.

    Intersections are products of 0/1 matrices over the shingles that both blocks hold.
    """
    side, ids, roots = rows["side"].to_numpy(), rows["id"].to_numpy(), rows["root"].to_numpy()
    sets = [np.frombuffer(x, U) for x in rows["shingles"].to_pylist()]
    size = np.array([len(x) for x in sets])
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side != 0)  # side 2: a block with itself
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    tokens, which = np.unique(flat, return_inverse=True)
    both = (np.bincount(which, minlength=len(tokens)) > 1).nonzero()[0]
    column = np.full(len(tokens), -1)
    column[both] = np.arange(len(both))
    column = column[which]
    total = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, len(both), 2048):
        mine = (column >= k) & (column < k + 2048)
        dense = np.zeros((len(sets), 2048), np.float32)
        dense[owner[mine], column[mine] - k] = 1
        total += dense[left] @ dense[right].T
    union = size[left][:, None] + size[right][None, :] - total
    i, j = np.nonzero((100 * total >= 75 * union) & (roots[left][:, None] != roots[right][None, :]))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    out = []
    for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
        p, q = find(int(roots[x])), find(int(roots[y]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(ids[x]), int(ids[y])))
    return pa.table([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], names=["a", "b"])


def _rest(docs: DataFrame, core: DataFrame, links: DataFrame, bits: int, wide: bool) -> DataFrame:
    """All links so far and those among core sets that join different classes.

    Core sets share subsets with crowds. Those with too many shingles of their own drop out. The rest
    form clusters over their shared subsets, and where two sets that link may have none in common, over
    their first shingles. In each crowd the set with the fewest shingles
    of its own is the centre, and all are compared with it; most of a family is then one class. What
    is outside its cluster's largest class is compared with all of the cluster, by blocks.
    """
    kind = np.int64 if wide else np.uint32
    sets = written(_sets_of(_only(docs, core)).dropDuplicates(["id"]), "core-shingles")
    kept = written(_shared_enough(sets), "core-kept")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, signs, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, i = np.frombuffer(signs, np.uint32), np.frombuffer(ids, kind).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(bucket) << 32) | s.astype(np.int64)), pa.array(i)], ["sign", "id"])

    shared = _emit(_only(docs, kept), bits, wide, False, prefixes=True, cut=False).select("bucket", "signs", "ids").mapInArrow(explode, "sign long, id long")
    lone = kept.select(F.col("id").alias("_k"), F.struct("lone", "id").alias("rank"))
    ranked = written(shared.join(lone, F.col("id") == F.col("_k")).select("sign", "id", "rank"), "core-signs")
    centres = ranked.groupBy("sign").agg(F.min("rank").alias("rank"), F.count("*").alias("k")).where("k > 1").select(_own("sign").alias("_s"), F.col("rank.id").alias("b"))
    stars = written(ranked.withColumn("_o", _own("sign")).join(centres, F.col("_o") == F.col("_s")).where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "core-stars")

    def with_root(df: DataFrame, roots: DataFrame, key: str, name: str) -> DataFrame:
        found = roots.select(F.col("id").alias(f"_{name}"), F.col("root").alias(name))
        return df.withColumn("_j", _own(key)).join(found, F.col("_j") == _own(f"_{name}"), "left").drop("_j", f"_{name}").withColumn(name, F.coalesce(name, key))

    before = components(links)  # before the stars
    open_ = with_root(with_root(stars, before, "a", "_ra"), before, "b", "_rb").where("_ra <> _rb").select("a", "b")
    size = kept.select("id", "n")
    near = verify(_among(open_, size), docs)
    removed(ranked, before)
    links, fewer = written(links.unionByName(near), "links"), links
    removed(near, fewer)
    after = components(links)
    cluster = components(stars)
    removed(stars)
    placed = written(with_root(with_root(kept.select("id"), cluster, "id", "cluster"), after, "id", "root"), "core-placed")
    removed(after, cluster)
    classes = placed.groupBy("cluster", "root").agg(F.count("*").alias("k"))
    main = classes.groupBy("cluster").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("all"), F.count("*").alias("classes")).where("classes > 1")
    main = main.select(F.col("cluster").alias("_c"), "main", F.ceil(F.col("most") / BLOCK).alias("inside"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("outside"))
    put = placed.withColumn("_o", _own("cluster")).join(main, F.col("_o") == _own("_c"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    inner = put.where("root = main").select("id", "root", "cluster", F.explode(F.sequence(F.lit(0), F.col("outside") - 1)).alias("i"), (F.col("outside") + block("inside")).alias("j"), F.lit(1).alias("side"))
    own = put.where("root <> main").withColumn("u", block("outside"))
    pairs = F.concat(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("outside") + F.col("inside") - 1), lambda k: F.struct(F.least("u", k).alias("i"), F.greatest("u", k).alias("j"), F.when(k == F.col("u"), 2).when(k > F.col("u"), 0).otherwise(1).alias("side")))
    )
    outer = own.select("id", "root", "cluster", F.explode(pairs).alias("p")).select("id", "root", "cluster", "p.i", "p.j", "p.side")
    dealt = inner.unionByName(outer)
    blobs = sets.select(_own("id").alias("_b"), "shingles")
    met = dealt.withColumn("_o", _own("id")).join(blobs, F.col("_o") == F.col("_b")).select("cluster", "i", "j", "side", "id", "root", "shingles")
    last = written(met.groupBy("cluster", "i", "j").applyInArrow(_compare, "a long, b long"), "core-links")
    out = written(links.unionByName(last), "links")
    removed(last, links, sets, kept, placed)
    return out


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of every row of ``docs``.

    component_id is the smallest id reachable by links, the row's own included. Words are runs of
    other than ASCII white space, A-Z as a-z; null and empty texts have no shingles and link with
    nothing. Rows with a null id keep their size and get a null component. Rows that share an id
    share its links. Ids are whole numbers. Shingles are told apart by 64-bit hashes, sets by 128 bits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = written(describe_sets(rows), "described")
    whole = described.where("n > 0 AND id IS NOT NULL")
    equal = whole.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = written(equal, "equal-sets")
    bounds = reps.agg(F.sum("n"), F.min("rep"), F.max("rep")).first()
    shingles, least, most = bounds[0] or 0, bounds[1] or 0, bounds[2] or 0
    wide = least < 0 or most >= 1 << 32
    bits = max(6, int(np.ceil(np.log2(max(1, shingles * 8 / 3e6)))))  # buckets of about 3 MB
    first = reps.where("n >= 3").select(F.col("rep").alias("id"))
    texts, name = _dealt(_only(rows, first))
    met = written(_meet(_emit(texts, bits, wide, False), wide, False), "met")
    own = whole.where("n >= 3").join(first.select(F.col("id").alias("_f")), F.col("id") == F.col("_f"), "left_semi").drop("h1", "h2").dropDuplicates(["id"])
    about = written(_with_crowded(own, met), "about")
    hard = written(about.where(_short((1, "full"), (-1, "need"), (-1, "crowded"))), "hard")
    again = written(_meet(_emit(_only(texts, hard), bits, wide, True), wide, True), "met-again")
    near = _among(met.where("b IS NOT NULL AND star"), hard).unionByName(_among(again.where("b IS NOT NULL AND NOT star"), hard))
    links = verify(_plausible(met, about).unionByName(near), texts)
    removed(met, about)
    left = _with_crowded(hard.withColumnRenamed("crowded", "before"), again)
    core = written(left.where(_short((2, "full"), (-1, "single"), (-1, "need"), (-2, "before"), (-1, "crowded"))).select("id"), "core-sets")
    removed(hard, again)
    if not core.isEmpty():
        links = _rest(texts, core, links, bits, wide)
    spark.sql(f"DROP TABLE {name}")
    remove_folder(f"{shared_folder(spark)}/{name}")
    removed(core)
    roots = components(links)
    removed(links)
    root_of = reps.join(roots.select(F.col("id").alias("_r"), "root"), F.col("rep") == F.col("_r"), "left").select("h1", "h2", F.col("n").alias("_n"), "copies", "rep", F.coalesce("root", "rep").alias("component"))
    moved = written(root_of.where("copies > 1 OR component <> rep").select(F.concat_ws("/", "h1", "h2", "_n").alias("_k"), "component"), "moved")
    removed(reps, roots)
    keyed = described.withColumn("_set", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.concat_ws("/", "h1", "h2", "n")))
    out = keyed.join(moved, F.col("_set") == F.col("_k"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of linked documents: that with the smallest id; repeated rows of one id are one. Null ids stay."""
    with scratch() as made:
        first = join_classes(docs, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_first")).distinct()
        first = made.keep(written(first, "first-of-class"))
    whole = docs.where(docs[id_col].isNotNull())
    kept = whole.join(first, whole[id_col] == first["_first"], "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(docs[id_col].isNull()))
