"""Sequences, CIGAR strings and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def normalize(seq: Column) -> Column:
    """Without white space, a-z as A-Z."""
    return F.translate(F.regexp_replace(seq, r"\s+", ""), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def junction_kmer(seq: Column, cpos: Column, strand: Column, imprecise: Column, window: int = 20) -> Column:
    """``window`` bases about a contig's break (from 0), reversed on '-'; '.' where there is none."""
    start = cpos - (window // 2 - 1)
    kmer = F.substring(seq, start + 1, F.lit(window))
    bad = imprecise | seq.isNull() | (F.length(seq) == 0) | (start < 0) | (start + window > F.length(seq))
    return F.when(bad, ".").when(strand == "-", reverse_complement(kmer)).otherwise(kmer)


def flip(c1: Column, c2: Column, length: Column, flipped: Column) -> Column:
    """struct(c1, c2): contig positions on the strand that the contig aligned on."""
    return F.when(flipped, F.struct((length - c2).alias("c1"), (length - c1).alias("c2"))).otherwise(F.struct(c1.alias("c1"), c2.alias("c2")))


def homology(seq: Column, c1: Column, c2: Column, strand: Column) -> Column:
    """Bases that both sides of a break claim; '' if none."""
    s = F.substring(seq, c2 + 1, c1 - c2)
    return F.when(c1 > c2, F.when(strand == "-", reverse_complement(s)).otherwise(s)).otherwise("")


def insertion(seq: Column, c1: Column, c2: Column, strand: Column) -> Column:
    """Bases between the sides of a break; '' if none."""
    s = F.substring(seq, c1 + 1, c2 - c1)
    return F.when(c2 > c1, F.when(strand == "-", reverse_complement(s)).otherwise(s)).otherwise("")


def chromosome_key(name: Column) -> Column:
    """Order of chromosomes: 1 to 22, X, Y, M, then 1000 for all others."""
    bare = F.regexp_replace(name, "^chr", "")
    n = bare.try_cast("int")
    letter = F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(1000)
    return F.when((n >= 1) & (n <= 22), n).otherwise(letter)


def cigar_ops(cigar: Column) -> Column:
    """array of struct(op, len)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("len")))


def cigar_sum(ops: Column, kinds: str) -> Column:
    """Bases of the operations of the given kinds."""
    return F.aggregate(F.filter(ops, lambda x: F.lit(kinds).contains(x["op"])), F.lit(0), lambda t, x: t + x["len"])


def cigar_count(ops: Column, kinds: str) -> Column:
    return F.size(F.filter(ops, lambda x: F.lit(kinds).contains(x["op"])))


def cigar_longest(ops: Column, kind: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(ops, lambda x: x["op"] == kind), lambda x: x["len"])), F.lit(0))


def adjusted_nm(nm: Column, ops: Column) -> Column:
    """Mismatches beside the longest insertion and deletion."""
    return F.greatest(F.lit(0), nm - cigar_longest(ops, "I") - cigar_longest(ops, "D"))


def query_interval(ops: Column) -> Column:
    """struct(start, end) of the aligned part of a query, clipping left out."""
    head = F.when(F.get(ops, F.lit(0))["op"].isin("S", "H"), F.get(ops, F.lit(0))["len"]).otherwise(0)
    return F.struct(head.alias("start"), (head + cigar_sum(ops, "MI=X")).alias("end"))


def reciprocal_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the longer of two intervals."""
    both = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    return F.when(F.greatest(e1 - s1, e2 - s2) > 0, both / F.greatest(e1 - s1, e2 - s2)).otherwise(0.0)


def indel_key(chrom: Column, pos: Column, span: Column, insertion_: Column) -> Column:
    """chr_pos_lenI or D, by which indels of calls and reads meet."""
    return F.concat(F.concat_ws("_", chrom.cast("string"), pos.cast("string"), span.cast("string")), F.when(insertion_, "I").otherwise("D"))


def has_token(tokens: Column, token: Column) -> Column:
    return F.array_contains(F.split(tokens, ","), token)


def append_token(tokens: Column, token: Column) -> Column:
    """A comma list with ``token`` once more at its end, unless it holds it."""
    return F.array_join(F.array_union(F.filter(F.split(tokens, ","), lambda x: x != ""), F.array(token)), ",")


def parse_region(text: Column) -> Column:
    """struct(chrom, start, end) of ``chr:1,234-5M`` or ``chr``; K and M are thousands and millions."""
    chrom = F.regexp_extract(text, r"^([^:]+)", 1)

    def number(group: int) -> Column:
        found = F.regexp_replace(F.regexp_extract(text, r"^[^:]+:([0-9.,]+[kKmM]?)-([0-9.,]+[kKmM]?)$", group), ",", "")
        scale = F.when(F.lower(F.right(found, F.lit(1))) == "m", 1e6).when(F.lower(F.right(found, F.lit(1))) == "k", 1e3).otherwise(1.0)
        return (F.regexp_replace(found, "[kKmM]", "").try_cast("double") * scale).cast("long")

    return F.struct(chrom.alias("chrom"), number(1).alias("start"), number(2).alias("end"))


def longest_repeat(seq: Column) -> Column:
    """The longest homopolymer of 3 bases or more, the first of equals; else the longest dinucleotide repeat of 2 units; '' if none."""
    mono = F.regexp_extract_all(seq, F.lit(r"(A{3,}|C{3,}|G{3,}|T{3,})"), F.lit(1))
    pairs = [a + b for a in "ACGT" for b in "ACGT" if a != b]
    duo = F.regexp_extract_all(seq, F.lit("(" + "|".join(f"(?:{p}){{2,}}" for p in pairs) + ")"), F.lit(1))
    both = F.concat(mono, duo)
    longest = F.aggregate(both, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return longest
