"""Read support of breakpoints, and reads found by motif."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns and their characters that are sent to all workers at once at most; more are matched in blocks.
BLOCK_PATTERNS, BLOCK_CHARS = 200_000, 16_000_000
#: Characters of texts that are hashed at once, or one longer text.
PIECE_CHARS = 1 << 20


def split_support(hits: DataFrame, bp: str = "bp", qname: str = "qname", order: list[str] | None = None) -> DataFrame:
    """(bp, sample, split): distinct fragments of each breakpoint; a fragment counts for the sample of its first read."""
    first = hits.groupBy(bp, qname).agg(F.min_by("sample", F.struct(*(order or ["mate"]))).alias("sample"))
    return first.groupBy(bp, "sample").agg(F.count("*").alias("split"))


def alt_count(fragments: Column, cigar: Column) -> Column:
    """The greater of distinct supporting fragments and CIGAR evidence."""
    return F.greatest(fragments, cigar)


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k characters that begin at each place."""
    n = len(codes) - k + 1
    total = np.zeros(max(n, 0), np.uint64)
    wide = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k if n > 0 else 0):
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += wide[j : j + n]
        return total * np.uint64(0xD6E8FEB86659FD93)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _seed_places(texts: DataFrame, seeds: list[str], k: int) -> DataFrame:
    """(_text, _at, _gram): where the ``seeds`` stand in ``texts`` (hash, text)."""
    sent = texts.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(sent.value)
        known = np.unique(np.concatenate([_gram_hashes(_codes(s), k) for s in sent.value]))
        likely = np.zeros(1 << 20, bool)
        likely[known >> np.uint64(44)] = True

        def found(idents: list[int], held: list[str]) -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in held])])
            hashes = _gram_hashes(_codes("".join(held)), k)
            at = np.flatnonzero(likely[hashes >> np.uint64(44)])
            at = at[known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]]
            of = np.searchsorted(bounds, at, "right") - 1
            rows = [(idents[j], p, g) for j, p in zip(of.tolist(), (at - bounds[of]).tolist(), strict=True) if (g := held[j][p : p + k]) in wanted]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string()))], ["_text", "_at", "_gram"])

        for batch in batches:
            idents, held, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                idents.append(i)
                held.append(t.as_py())
                size += len(held[-1])
                if size >= PIECE_CHARS:
                    yield found(idents, held)
                    idents, held, size = [], [], 0
            if held:
                yield found(idents, held)

    return texts.mapInArrow(run, "_text long, _at int, _gram string")


def kmer_hits(texts: DataFrame, patterns: DataFrame, k: int, text: str = "seq", pattern: str = "pattern") -> DataFrame:
    """``texts`` x ``patterns`` where the text contains the pattern; every pattern has at least ``k`` characters.

    The first k characters of the patterns, in blocks of bounded size with one pass for each, are looked
    up by hash at all places of the texts where they lie; only where one stands a row goes on, with the text's
    hash and the place. These are joined with the patterns, the texts are fetched by hash, and the
    whole pattern is compared at that place. A k-mer that many patterns share costs their number; one
    that many texts share is an ordinary skewed join key.
    """
    seeds = patterns.withColumn("_seed", F.substring(pattern, 1, k))
    hashed = texts.where(F.length(text) >= k).withColumn("_of", F.xxhash64(text))
    narrow = hashed.select("_of", F.col(text).alias("_seq"))
    grams = None
    for block in _blocks(seeds.where(F.length("_seed") == k).select("_seed").distinct().withColumn("_one", F.lit(1)), "_seed", "_one"):
        places = _seed_places(narrow, [s for s, _ in block], k)
        grams = places if grams is None else grams.unionByName(places)
    if grams is None:
        grams = texts.sparkSession.createDataFrame([], "_text long, _at int, _gram string")
    met = grams.join(seeds, F.col("_gram") == F.col("_seed")).drop("_gram", "_seed").distinct()  # equal texts meet once
    whole = hashed.join(met, F.col("_of") == F.col("_text"))
    return whole.where(F.substring(F.col(text), F.col("_at") + 1, F.length(pattern)) == F.col(pattern)).drop("_at", "_of", "_text")


def with_reverse(patterns: DataFrame, pattern: str, reverse: Column) -> DataFrame:
    """The patterns and their reverses, both under the same ids; equal ones once."""
    return patterns.unionByName(patterns.withColumn(pattern, reverse)).distinct()


def _blocks(patterns: DataFrame, pattern: str, ident: str) -> Iterator[list[tuple[str, int]]]:
    rows: list[tuple[str, int]] = []
    size = 0
    for r in patterns.select(pattern, ident).toLocalIterator():
        if not r[0]:
            continue
        if rows and (len(rows) == BLOCK_PATTERNS or size + len(r[0]) > BLOCK_CHARS):
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[0])
    if rows:
        yield rows


def automaton_hits(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str = "seq", pattern: str = "pattern", ident: str = "pattern_id") -> DataFrame:
    """(keys, ident): distinct matches by an Aho-Corasick automaton over Arrow batches, one pass for each block of patterns."""
    schema = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys) + f", {ident} {patterns.schema[ident].dataType.simpleString()}"
    rows = texts.select(*keys, text)
    out = None
    for block in _blocks(patterns, pattern, ident):
        sent = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            by_text: dict[str, list] = {}
            for p, i in sent.value:
                by_text.setdefault(p, []).append(i)
            machine = ahocorasick.Automaton()
            for p, ids in by_text.items():
                machine.add_word(p, ids)
            machine.make_automaton()
            for batch in batches:
                rows, found = [], []
                for k, t in enumerate(batch.column(len(keys)).to_pylist()):
                    for i in sorted({i for _, ids in machine.iter(t or "") for i in ids}):
                        rows.append(k)
                        found.append(i)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(len(keys))), pa.array(found)], [*keys, ident])

        hits = rows.mapInArrow(run, schema)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else texts.sparkSession.createDataFrame([], schema)


def fragments_of(reads: DataFrame, hits: DataFrame, qname: str = "qname") -> DataFrame:
    """All reads of the fragments that have a hit."""
    names = hits.select(F.col(qname).alias("_q")).distinct()
    return reads.join(names, F.col(qname) == F.col("_q"), "left_semi")
