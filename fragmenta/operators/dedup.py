"""Duplicate removal with deterministic winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.operators import intervals as iv


def canonical_ends(chr1: Column, pos1: Column, strand1: Column, chr2: Column, pos2: Column, strand2: Column) -> Column:
    """The two breakends of a pair, lower one first, so that AB and BA compare equal."""
    a = F.struct(chr1.alias("chr"), pos1.alias("pos"), strand1.alias("strand"))
    b = F.struct(chr2.alias("chr"), pos2.alias("pos"), strand2.alias("strand"))
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def canonical_pairs(bps: DataFrame, tie: str = "bp_num", mode: str = "reference") -> DataFrame:
    """One row of each unordered breakpoint pair: lowest somlod, then highest maxlod, then ``tie``.

    The winner is found by a map-side combined ``min_by``, so a pile-up of one pair costs no
    sorted window over its rows. Chromosomes are compared by ``chr1`` and ``chr2`` as they are: give
    sort keys to let all non-standard contigs collapse into one (mode 'reference' with keyed
    columns), names to keep them apart ('strict').
    """
    c = F.col
    key = canonical_ends(c("chr1"), c("pos1"), c("strand1"), c("chr2"), c("pos2"), c("strand2"))
    if mode == "strict" and {"name1", "name2"} <= set(bps.columns):
        key = canonical_ends(c("name1"), c("pos1"), c("strand1"), c("name2"), c("pos2"), c("strand2"))
    row = F.struct(*bps.columns)
    rank = F.struct(c("somlod"), (-c("maxlod")).alias("neg"), c(tie))
    return bps.groupBy(key.alias("_key")).agg(F.min_by(row, rank).alias("_row")).select("_row.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key under ``order``, which should be total."""
    return df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def union_tokens(df: DataFrame, keys: list[str], order: str, lists: list[str]) -> DataFrame:
    """One row of each key; comma lists become the union of the rows' tokens, in the order in which they first occur.

    A token's first occurrence is a minimum, so no list of a key's rows is made; keys are told apart from null ones.
    """

    def tokens(x: str) -> Column:
        parts = F.filter(F.split(F.coalesce(F.col(x), F.lit("")), ","), lambda t: t != "")
        return F.transform(parts, lambda t, i: F.struct(F.lit(x).alias("list"), t.alias("token"), F.struct(F.col(order).alias("o"), i.alias("i")).alias("at")))

    each = F.flatten(F.array(*(tokens(x) for x in lists)))
    first = df.select(*keys, F.explode(each).alias("_t")).groupBy(*keys, "_t.list", "_t.token").agg(F.min("_t.at").alias("at"))
    joined = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == x, F.struct("at", "token")))), lambda r: r["token"]), ",").alias(x) for x in lists]
    unions = first.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(*joined)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    met = df.groupBy(*keys).agg(F.count("*").alias("copies")).join(unions, cond, "left")
    return met.select(*keys, "copies", *(F.coalesce(x, F.lit("")).alias(x) for x in lists))


def fuzzy_pairs(bps: DataFrame, near: int = 10, far: int = 200, large: int = 400, crowd: int = 500) -> DataFrame:
    """Pairs that no lesser pair (by maxlod descending, then bp_num) of the same strands and PASS-ness lies near at both ends.

    "Near" is ``near`` bases, ``far`` for large events and between chromosomes. Ends with more than
    ``crowd`` neighbours are removed first, counted before anything is dropped, so the result does
    not depend on the order of rows.
    """
    c = F.col
    place = ["chr1", "pos1", "strand1", "chr2", "pos2", "strand2"]
    rank = F.struct(c("maxlod").alias("lod"), (-c("bp_num")).alias("neg"))
    # calls at one place have the same neighbours: places meet with their counts and best ranks, so a pile-up is one row
    best = [F.max(F.when((c("conf") == "PASS") == passed, F.when(c("maxlod").isNotNull(), rank))).alias(f"best_{passed}".lower()) for passed in (True, False)]
    places = bps.groupBy(*place).agg(F.count("*").alias("k"), *best)
    wide = (c("chr1") != c("chr2")) | (F.abs(c("pos2") - c("pos1")) > large)
    a = places.select(*place, F.when(wide, far).otherwise(near).alias("pad"))
    other = places.select(*(c(x).alias(f"o_{x}") for x in places.columns))
    met = iv.overlap_join(a, other, [("chr1", "o_chr1"), ("chr2", "o_chr2"), ("strand1", "o_strand1"), ("strand2", "o_strand2")], (c("pos1") - c("pad"), c("pos1") + c("pad")), (c("o_pos1"), c("o_pos1")), 512)
    met = met.where(F.abs(c("o_pos2") - c("pos2")) <= c("pad"))
    around = met.groupBy(*(c(x).alias(f"_{x}") for x in place)).agg(F.sum("o_k").alias("_n"), F.max("o_best_true").alias("_true"), F.max("o_best_false").alias("_false"))
    met = bps.join(around, [c(x) == c(f"_{x}") for x in place], "left")
    beaten = F.when(c("conf") == "PASS", c("_true") > rank).otherwise(c("_false") > rank) & c("conf").isNotNull() & c("maxlod").isNotNull()
    return met.where(~F.coalesce((c("_n") - 1 > crowd) | beaten, F.lit(False))).select(*bps.columns)
