"""Sequence kernels behind grouped maps: k-mer correction, assembly and alignment of a window's reads.

They show the boundary at which an assembler or aligner plugs in: a window's reads come as one
group, bounded by the caller (see ``filters.drop_crowded``), contigs or alignments go out. The
algorithms are simple ones; they claim no parity with any assembler.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def solid_kmers(reads: DataFrame, k: int = 31, least: int = 3, seq: str = "seq") -> DataFrame:
    """(kmer, n) that stand in the reads ``least`` times or more: an aggregation with map-side partial sums."""
    places = F.sequence(F.lit(1), F.length(seq) - k + 1)
    grams = reads.where(F.length(seq) >= k).select(F.explode(F.transform(places, lambda i: F.substring(F.col(seq), i, F.lit(k)))).alias("kmer"))
    return grams.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def correct(seq: str, solid: set[str], k: int, rounds: int = 3) -> str:
    """Single bases replaced where just one replacement makes the k-mers about them solid."""
    for _ in range(rounds):
        weak = [i for i in range(len(seq) - k + 1) if seq[i : i + k] not in solid]
        if not weak:
            return seq
        fixed = False
        for p in sorted({weak[0] + k - 1, weak[-1], weak[0]}):
            if p >= len(seq):
                continue
            cover = range(max(0, p - k + 1), min(p, len(seq) - k) + 1)
            options = [b for b in "ACGT" if b != seq[p] and all((seq[:p] + b + seq[p + 1 :])[i : i + k] in solid for i in cover)]
            if len(options) == 1:
                seq = seq[:p] + options[0] + seq[p + 1 :]
                fixed = True
                break
        if not fixed:
            return seq
    return seq


def _dealt(df: DataFrame, window: str) -> DataFrame:
    """Rows dealt by window over as many tasks as a shuffle has: the groups are small in bytes but long in work, so none are put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), window)


def _back(reads: DataFrame, found: DataFrame, window: str, seq: str) -> DataFrame:
    """``reads`` with what was ``found`` for the distinct sequences of each window."""
    other = found.withColumnsRenamed({window: "_w", seq: "_s"})
    return reads.join(other, (F.col(window) == F.col("_w")) & (F.col(seq) == F.col("_s"))).drop("_w", "_s")


def correct_reads(reads: DataFrame, window: str = "win", seq: str = "seq", k: int = 15, least: int = 3) -> DataFrame:
    """``reads`` (window, read_id, seq) with ``corrected``, by the k-mers of each window's own reads.

    Equal reads are corrected alike, so a group holds a window's distinct sequences and their numbers.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for s, n in zip(rows[seq], rows["_n"], strict=True):
            for i in range(len(s) - k + 1):
                counts[s[i : i + k]] += n
        solid = {x for x, n in counts.items() if n >= least}
        return rows[[window, seq]].assign(corrected=[correct(s, solid, k) for s in rows[seq]])

    each = reads.groupBy(window, seq).agg(F.count("*").alias("_n"))
    fixed = _dealt(each, window).groupBy(window).applyInPandas(run, f"{window} long, {seq} string, corrected string")
    return _back(reads.select(F.col(window).cast("long").alias(window), F.col("read_id").cast("long").alias("read_id"), seq), fixed, window, seq)


def greedy_contigs(seqs: list[str], least: int) -> list[str]:
    """Contigs by always joining the two sequences of the longest overlap of at least ``least``; contained ones are dropped."""
    left = sorted(set(seqs), key=lambda s: (-len(s), s))
    kept: list[str] = []
    for s in left:
        if not any(s in t for t in kept):
            kept.append(s)
    while True:
        best = (0, -1, -1)
        heads: dict[str, list[int]] = {}
        for j, t in enumerate(kept):
            heads.setdefault(t[:least], []).append(j)
        for i, s in enumerate(kept):
            for p in range(len(s) - least + 1):
                for j in heads.get(s[p : p + least], ()):
                    if i != j and len(s) - p < len(kept[j]) and kept[j].startswith(s[p:]) and len(s) - p > best[0]:
                        best = (len(s) - p, i, j)
        if not best[0]:
            return kept
        n, i, j = best
        joined = kept[i] + kept[j][n:]
        kept = [t for m, t in enumerate(kept) if m not in (i, j) and t not in joined] + [joined]


def assemble(reads: DataFrame, window: str = "win", seq: str = "seq", least: int = 20) -> DataFrame:
    """(window, cname, contig) of each window's reads."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        w = int(rows[window].iloc[0])
        found = sorted(greedy_contigs(rows[seq].tolist(), least), key=lambda s: (-len(s), s))
        return pd.DataFrame({window: w, "cname": [f"c_{w}_{i}" for i in range(len(found))], "contig": found})

    return _dealt(reads.select(window, seq).distinct(), window).groupBy(window).applyInPandas(run, f"{window} long, cname string, contig string")


def align(query: str, target: str, match: int = 1, mismatch: int = -4, gap: int = -6) -> tuple[int, int, int, int, int]:
    """(score, query start, query end, target start, target end) of the best local alignment, by rows of numpy."""
    whole = target.find(query)
    if whole >= 0 and query:
        return match * len(query), 0, len(query), whole, whole + len(query)
    t = np.frombuffer(target.encode(), np.uint8)
    n = len(t)
    score = np.zeros(n + 1, np.int64)
    start = [(0, j) for j in range(n + 1)]
    best = (0, 0, 0, 0, 0)
    for i, ch in enumerate(query.encode(), 1):
        new = np.zeros(n + 1, np.int64)
        origin = [(i, j) for j in range(n + 1)]
        diagonal = score[:-1] + np.where(t == ch, match, mismatch)
        down = score[1:] + gap
        for j in np.flatnonzero((diagonal > 0) | (down > 0)) + 1:
            options = ((int(diagonal[j - 1]), start[j - 1]), (int(down[j - 1]), start[j]), (int(new[j - 1]) + gap, origin[j - 1]))
            top = max(options, key=lambda x: x[0])
            if top[0] > 0:
                new[j], origin[j] = top
                if top[0] > best[0]:
                    best = (top[0], top[1][0], i, top[1][1], int(j))
        score, start = new, origin
    return best


def align_reads(reads: DataFrame, contigs: DataFrame, window: str = "win", seq: str = "seq") -> DataFrame:
    """(window, read_id, cname, score, contig_start, contig_end): each read's best contig of its window; ties go to the first name.

    Equal reads align alike, so each distinct sequence of a window is aligned once.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        targets = sorted(zip(right["cname"], right["contig"], strict=True))
        for s in left[seq]:
            found = [(align(s, t), name) for name, t in targets]
            if found:
                (score, _, _, a, b), name = max(found, key=lambda x: (x[0][0], [-ord(ch) for ch in x[1]]))
                rows.append((int(key[0]), s, name, score, a, b))
        return pd.DataFrame(rows, columns=[window, seq, "cname", "score", "contig_start", "contig_end"])

    each = _dealt(reads.select(window, seq).distinct(), window)
    found = each.groupBy(window).cogroup(_dealt(contigs, window).groupBy(window)).applyInPandas(run, f"{window} long, {seq} string, cname string, score long, contig_start long, contig_end long")
    return _back(reads.select(F.col(window).cast("long").alias(window), F.col("read_id").cast("long").alias("read_id"), seq), found, window, seq).drop(seq)


def clipped_realignment(reads: DataFrame, least_gain: int = 1) -> DataFrame:
    """Codes of discordant reads that were realigned: kept, moved near its mate, or lost to a better place.

    Columns: native_score, new_score, new_chr, new_pos, mate_chr, mate_pos.
    """
    c = F.col
    near = (c("new_chr") == c("mate_chr")) & (F.abs(c("new_pos") - c("mate_pos")) < 2000)
    better = c("new_score") >= c("native_score") + least_gain
    return reads.withColumn("code", F.when(~better, "KEPT").when(near, "CONCORDANT").otherwise("MOVED"))
