"""Predicates on reads and calls."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest corrected read, primer of adapters, mismatch share of salvage, flags of duplicates and failed reads.
LEAST_LENGTH, PRIMER, SALVAGE = 40, "CAAGCAGAAGACGGCAT", 0.02
DUPLICATE, FAILED, SECONDARY = 0x400, 0x200, 0x100


def bad_flags(flag: Column) -> Column:
    """Duplicates and reads that failed quality control."""
    return flag.bitwiseAND(F.lit(DUPLICATE | FAILED)) != 0


def orientation(chr1: Column, chr2: Column, pos: Column, mate_pos: Column, strand: Column, mate_strand: Column, by_position: bool = True) -> Column:
    """FR, RF, FF or RR; by position, the left-most read is named first."""
    swap = (pos > mate_pos) & (chr1 == chr2) if by_position else F.lit(False)
    a, b = F.when(swap, mate_strand).otherwise(strand), F.when(swap, strand).otherwise(mate_strand)
    name = lambda s: F.when(s == "+", "F").otherwise("R")
    return F.concat(name(a), name(b))


def read_rules(rules: str) -> Column:
    """The OR of a JSON rule object's conditions over strand, mate_strand, chr, mate_chr, clip, readlen, ins, del, mapped, mate_mapped."""
    r, c = json.loads(rules), F.col
    own = orientation(c("chr"), c("mate_chr"), F.lit(0), F.lit(0), c("strand"), c("mate_strand"), by_position=False)
    hits = []
    if r.get("orientations"):
        same = [o for o in r["orientations"] if o[0] == o[1]]
        mixed = [o for o in r["orientations"] if o[0] != o[1]]
        hits += [own.isin(same)] if same else []
        hits += [own.isin(mixed) & (c("chr") == c("mate_chr"))] if mixed else []
    if r.get("interchromosomal"):
        hits.append(c("chr") != c("mate_chr"))
    if "clip" in r:
        hits.append((c("clip") >= r["clip"]) & (c("readlen") - c("clip") >= r.get("length", 0)))
    hits += [c("ins")] if r.get("insertion") else []
    hits += [c("del")] if r.get("deletion") else []
    if r.get("half_mapped"):
        hits.append(c("mapped") != c("mate_mapped"))
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def many_mismatches(nm: Column, length: Column) -> Column:
    """Mismatch share over the salvage level, in single precision."""
    return nm.cast("float") / length.cast("float") > F.lit(SALVAGE).cast("float")


def rf_overlap(is_rf: Column, isize: Column, readlen: Column) -> Column:
    """RF pairs too close to be an event."""
    return is_rf & (F.abs(isize) < F.greatest(F.lit(200), 2 * readlen))


def mate_pass_mapq(mapq: Column, mate_pass: bool) -> Column:
    """Mapping quality 0 is rejected in the mate pass only."""
    return mapq > 0 if mate_pass else F.lit(True)


def has_adapter(has_indel: Column, isize: Column, full_isize: Column, length: Column, clip: Column, seq: Column) -> Column:
    """Reads that ran into the adapter: the insert is about as long as the read, or what isn't clipped is, or the primer shows."""
    close = F.abs(full_isize - length) < 5
    clipped = (clip > 0) & ((F.abs(length - clip - F.abs(isize)) <= 6) | seq.contains(PRIMER))
    return ~has_indel & (isize != 0) & (close | clipped)


def discordant(strand: Column, mate_strand: Column, chr1: Column, chr2: Column, isize: Column, cutoff: Column) -> Column:
    return ~((strand == "+") & (mate_strand == "-")) | (F.abs(isize) >= cutoff) | (chr1 != chr2)


def drop_crowded(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The rows of groups of at most ``most`` rows: a group over it is dropped whole."""
    few = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count("*").alias("_rows")).where(F.col("_rows") <= most)
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    return df.join(few, cond, "left_semi")


def has_minimal(t_split: Column, n_split: Column, tcount: Column, ncount: Column, distant: Column) -> Column:
    """At least two reads of any kind, and not from a distant region."""
    return (t_split + n_split + tcount + ncount >= 2) & ~distant


def assemblable(seq: Column, least: int) -> Column:
    """Sequences without N, long enough, and without a homopolymer of 40."""
    return ~(seq.contains("N") | (F.length(seq) < least) | seq.rlike("A{40}|C{40}|G{40}|T{40}"))


def viewer(text: Column, needle: str, ranges: dict[str, tuple], sets: dict[str, list]) -> Column:
    """Full text, ranges (a null value fails an active one) and sets."""
    out = text.contains(needle) if needle else F.lit(True)
    for name, (low, high) in ranges.items():
        x = F.col(name)
        out = out & F.coalesce((x >= low if low is not None else F.lit(True)) & (x <= high if high is not None else x.isNotNull()), F.lit(False))
    for name, values in sets.items():
        out = out & F.col(name).isin(values)
    return out


